"""Conditional probability tables.

Storage: one long table for the whole network,

    (node, depth, pa1..paM, value, ord, n, n_pa, p)

where depth d rows are conditioned on the node's first d parents (pa1..pad,
the rest null) and depth 0 is the Laplace marginal.  Rows exist only for parent
configurations seen in the training data, with every child value present
(zeros included).

Counting is one GROUPING SETS pass over the case table for every (node, depth)
of the network: Spark expands each row once per set and aggregates map-side,
so the whole fit is a single scan and a single shuffle of partial counts.
"""

from __future__ import annotations

from functools import reduce
from math import prod

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from bnlake.operators.prep import value_domains
from bnlake.session import keep
from bnlake.spec import DEFAULT_ALPHA, DEFAULT_M, NetworkSpec

BROADCAST_ROWS = 1_000_000    # broadcast a model table only below this proven bound


def model_bound(spec: NetworkSpec, cards: dict[str, int]) -> int:
    """Upper bound on the rows of any CPT / factor table of the network: the
    sum over nodes of (parent grid x child values)."""
    return sum(prod(cards.get(p, 1) for p in n.parents) * cards.get(n.name, 1) for n in spec.nodes)


def small(df: DataFrame, bound: int) -> DataFrame:
    """Broadcast hint only when the table's size bound is proven small."""
    return F.broadcast(df) if bound <= BROADCAST_ROWS else df


def pa_names(m: int) -> list[str]:
    return [f"pa{i}" for i in range(1, m + 1)]


# ---------------------------------------------------------------------------
# Domains
# ---------------------------------------------------------------------------
class Domains(dict):
    """node -> ordered list of values (strings): the states of the model's
    variables, one entry each on the driver."""

    def card(self, node: str) -> int:
        return len(self[node])

    def grid_size(self, names) -> int:
        return prod(len(self[n]) for n in names)


def collect_domains(domain_df: DataFrame) -> Domains:
    rows = (domain_df.groupBy("node")
            .agg(F.array_sort(F.collect_list(F.struct("ord", "value"))).alias("vals"))
            .collect())
    return Domains({r["node"]: [v["value"] for v in r["vals"]] for r in rows})


# ---------------------------------------------------------------------------
# Counts for every (node, depth) in one GROUPING SETS pass
# ---------------------------------------------------------------------------
def weighted(df: DataFrame, cols: list[str], weight: str | None = None) -> DataFrame:
    """Distinct configurations of ``cols`` with their row count ``_w`` (nulls
    kept as values; ``weight`` names a column of row counts).  Their number is bounded by the product of the domains,
    not by the rows, so every later grouping-set expansion runs on this small
    table; the aggregate itself combines map-side before its one shuffle."""
    return df.groupBy(*[F.col(f"`{c}`") for c in cols]).agg(
        (F.sum(weight) if weight else F.count(F.lit(1))).alias("_w"))


# ---------------------------------------------------------------------------
# ---------------------------------------------------------------------------
def _set_table(spark: SparkSession, spec: NetworkSpec,
               by: list[str] = ()) -> tuple[list[list[str]], DataFrame]:
    cols = list(by) + spec.names
    m = len(cols)
    sets: dict[frozenset, int] = {}
    rows = []
    for n in spec.nodes:
        for d in range(len(n.parents) + 1):
            s = frozenset(list(by) + list(n.parents[:d]) + [n.name])
            gid = sum(1 << (m - 1 - i) for i, c in enumerate(cols) if c not in s)
            sets.setdefault(s, gid)
            rows.append((gid, n.name, d))
    ordered = [[c for c in cols if c in s] for s in sets]
    return ordered, spark.createDataFrame(rows, "gid long, node string, depth int")


def cpt_counts(nodes: DataFrame, spec: NetworkSpec, by: list[str] = (), weight: str | None = None) -> DataFrame:
    """(by..., node, depth, pa1..paM, value, n) for every node and backoff depth;
    ``by`` columns (e.g. a fold id) are kept in every grouping set; ``weight`` names a
    column of row counts."""
    spec = spec.restrict(nodes.columns, by_name=True)
    spark = nodes.sparkSession
    sets, set_df = _set_table(spark, spec, by)
    agg = weighted(nodes, [*by, *spec.names], weight).groupingSets(sets, *by, *spec.names).agg(
        F.sum("_w").alias("n"), F.grouping_id().alias("gid"))
    # set_df has one row per (node, depth): its size is fixed by the spec.
    j = agg.join(F.broadcast(set_df), "gid")
    M = spec.max_parents
    node_c, depth_c = F.col("node"), F.col("depth")
    pas = []
    for i in range(1, M + 1):
        e = None
        for n in spec.nodes:
            if len(n.parents) >= i:
                cond = (node_c == n.name) & (depth_c >= i)
                e = F.when(cond, F.col(n.parents[i - 1])) if e is None else \
                    e.when(cond, F.col(n.parents[i - 1]))
        pas.append((e if e is not None else F.lit(None).cast("string")).alias(f"pa{i}"))
    val = None
    for n in spec.nodes:
        val = F.when(node_c == n.name, F.col(n.name)) if val is None else \
            val.when(node_c == n.name, F.col(n.name))
    return j.select(*by, "node", "depth", *pas, val.alias("value"), F.col("n").cast("long"))


# ---------------------------------------------------------------------------
# A5 / A7 / A8 / A9
# ---------------------------------------------------------------------------
def marginal_cpt(counts: DataFrame, domains: DataFrame, alpha: float = DEFAULT_ALPHA) -> DataFrame:
    """(node, value, ord, n, n_pa, p) with p = (n + a) / (N + a V)."""
    c0 = counts.filter(F.col("depth") == 0).select("node", "value", "n")
    d = domains.withColumn("V", F.count(F.lit(1)).over(Window.partitionBy("node")))
    j = d.join(c0, ["node", "value"], "left").withColumn("n", F.coalesce("n", F.lit(0)).cast("long"))
    j = j.withColumn("n_pa", F.sum("n").over(Window.partitionBy("node")).cast("long"))
    return j.select("node", "value", "ord", "n", "n_pa",
                    ((F.col("n") + alpha) / (F.col("n_pa") + alpha * F.col("V"))).alias("p"),
                    "V")


def fit_network(nodes: DataFrame, spec: NetworkSpec, alpha: float = DEFAULT_ALPHA,
                m: float = DEFAULT_M, backoff: bool = True,
                counts: DataFrame | None = None, domains: DataFrame | None = None) -> DataFrame:
    """All CPT levels of all nodes: (node, depth, pa1..paM, value, ord, n, n_pa, p).

    Level k interpolates the ML estimate with level k-1 (Jelinek-Mercer,
    lambda = n_pa / (n_pa + m)); with ``backoff=False`` each level is the
    per-configuration Laplace estimate.  The depth loop is unrolled on the
    driver (M <= max in-degree); each step is one equi-join of small tables.
    """
    spec = spec.restrict(nodes.columns, by_name=True)
    M = spec.max_parents
    pas = pa_names(M)
    counts = cpt_counts(nodes, spec) if counts is None else counts
    domains = value_domains(nodes, spec) if domains is None else domains
    # one row per node: the domain sizes bound every table below
    cards = {r["node"]: r["V"] for r in domains.groupBy("node").agg(
        F.count(F.lit(1)).alias("V")).collect()}
    bound = model_bound(spec, cards)
    marg = marginal_cpt(counts, domains, alpha)
    level = marg.select("node", F.lit(0).alias("depth"),
                        *[F.lit(None).cast("string").alias(p) for p in pas],
                        "value", "ord", "n", "n_pa", "p")
    levels = [keep(level)]
    card = domains.groupBy("node").agg(F.count(F.lit(1)).alias("V"))
    for k in range(1, M + 1):
        key = pas[:k]
        ck = counts.filter(F.col("depth") == k).select("node", *key, "value", "n")
        configs = ck.groupBy("node", *key).agg(F.sum("n").alias("n_pa"))
        grid = configs.join(small(domains.select("node", "value", "ord"), bound), "node")
        grid = grid.join(small(ck, bound), ["node", *key, "value"], "left") \
                   .withColumn("n", F.coalesce("n", F.lit(0)).cast("long"))
        if backoff:
            prev = levels[-1]
            wk = Window.partitionBy("node", *pas[:k - 1])
            tot = F.sum("p").over(wk)
            lower = prev.join(small(card, bound), "node").select(
                "node", *pas[:k - 1], "value",
                F.when(tot > 0, F.col("p") / tot).otherwise(1.0 / F.col("V")).alias("p_low"))
            grid = grid.join(small(lower, bound), ["node", *pas[:k - 1], "value"], "left")
            lam = F.col("n_pa") / (F.col("n_pa") + F.lit(m))
            ml = F.when(F.col("n_pa") > 0, F.col("n") / F.col("n_pa")).otherwise(0.0)
            p = lam * ml + (1 - lam) * F.coalesce("p_low", F.lit(0.0))
        else:
            grid = grid.join(small(card, bound), "node")
            p = (F.col("n") + alpha) / (F.col("n_pa") + alpha * F.col("V"))
        level = grid.select("node", F.lit(k).alias("depth"), *key,
                            *[F.lit(None).cast("string").alias(x) for x in pas[k:]],
                            "value", "ord", "n", F.col("n_pa").cast("long"), p.alias("p"))
        levels.append(keep(level))
    return keep(reduce(DataFrame.unionByName, levels))


# ---------------------------------------------------------------------------
# Backoff lookup as cascading left equi-joins
# ---------------------------------------------------------------------------
def truncate_prefix(df: DataFrame, M: int) -> DataFrame:
    """A parent key never has a hole -- after the first null, all null."""
    pas = pa_names(M)
    out = df
    for i in range(2, M + 1):
        ok = reduce(lambda a, b: a & b, [F.col(p).isNotNull() for p in pas[:i - 1]])
        out = out.withColumn(pas[i - 1], F.when(ok, F.col(pas[i - 1])))
    return out


def cpt_lookup(queries: DataFrame, cpt: DataFrame, card: DataFrame, M: int,
               alpha: float = DEFAULT_ALPHA, bound: int | None = None) -> DataFrame:
    """Add ``p`` and ``hit_depth`` to (node, pa1..paM, value, ...) rows:
    the longest observed parent prefix wins, then the marginal, then
    alpha / (alpha V + alpha) for a value never seen."""
    pas = pa_names(M)
    q = truncate_prefix(queries, M)
    ps = []
    for d in range(M, 0, -1):
        lv = cpt.filter(F.col("depth") == d).select(
            "node", *pas[:d], "value", F.col("p").alias(f"_p{d}"))
        lv = small(lv, bound) if bound is not None else lv
        q = q.join(lv, ["node", *pas[:d], "value"], "left")
        ps.append(F.col(f"_p{d}"))
    l0 = cpt.filter(F.col("depth") == 0).select("node", "value", F.col("p").alias("_p0"))
    if bound is not None:
        l0, card = small(l0, bound), small(card, bound)
    q = q.join(l0, ["node", "value"], "left").join(card, "node", "left")
    unseen = F.lit(alpha) / (F.lit(alpha) * F.greatest(F.coalesce("V", F.lit(1)), F.lit(1)) + alpha)
    hit = F.coalesce(*[F.when(F.col(f"_p{d}").isNotNull(), F.lit(d)) for d in range(M, 0, -1)],
                     F.lit(0))
    q = q.withColumn("p", F.coalesce(*ps, F.col("_p0"), unseen)).withColumn("hit_depth", hit)
    return q.drop(*[f"_p{d}" for d in range(M + 1)], "V")


def domain_card(domains: DataFrame) -> DataFrame:
    return domains.groupBy("node").agg(F.count(F.lit(1)).alias("V"))


# ---------------------------------------------------------------------------
# Full configuration grids and factor tables
# ---------------------------------------------------------------------------
def config_grid(spark: SparkSession, names: list[str], doms: Domains) -> DataFrame:
    """Every combination of the named variables' domains, as spark.range rows
    decoded in mixed radix (distributed, no cross join)."""
    size = doms.grid_size(names)
    df = spark.range(size)
    radix = 1
    cols = []
    for nme in reversed(names):
        vals = doms[nme]
        idx = (F.floor(F.col("id") / F.lit(radix)) % F.lit(len(vals))).cast("int")
        cols.append((nme, idx))
        radix *= len(vals)
    out = df
    for nme, idx in cols:
        arr = F.array(*[F.lit(v) for v in doms[nme]])
        out = out.withColumn(nme, F.element_at(arr, idx + 1)) \
                 .withColumn(f"_ord_{nme}", idx + 1)
    return out.drop("id").select(*names, *[f"_ord_{n}" for n in names])


def factor_long(spark: SparkSession, cpt: DataFrame, card: DataFrame, spec: NetworkSpec,
                doms: Domains, alpha: float = DEFAULT_ALPHA) -> DataFrame:
    """I3 in long form: (node, pa1..paM, value, ord, p, hit_depth) over the full
    grid of every node, each parent row normalised (zero row -> uniform)."""
    M = spec.max_parents
    pas = pa_names(M)
    parts = []
    for n in spec.nodes:
        names = list(n.parents) + [n.name]
        g = config_grid(spark, names, doms)
        parts.append(g.select(
            F.lit(n.name).alias("node"),
            *[F.col(p).alias(pas[i]) for i, p in enumerate(n.parents)],
            *[F.lit(None).cast("string").alias(x) for x in pas[len(n.parents):]],
            F.col(n.name).alias("value"), F.col(f"_ord_{n.name}").alias("ord")))
    grid = reduce(DataFrame.unionByName, parts)
    bound = model_bound(spec, {n: len(v) for n, v in doms.items()})
    looked = cpt_lookup(grid, cpt, card, M, alpha, bound)
    w = Window.partitionBy("node", *pas)
    tot = F.sum("p").over(w)
    cnt = F.count(F.lit(1)).over(w)
    return keep(looked.withColumn("p", F.when(tot > 0, F.col("p") / tot).otherwise(1.0 / cnt)))


def node_factor(factors_long: DataFrame, spec: NetworkSpec, node: str) -> DataFrame:
    """One node's factor with named columns: (parents..., node, w)."""
    ps = spec.parents(node)
    return factors_long.filter(F.col("node") == node).select(
        *[F.col(f"pa{i + 1}").alias(p) for i, p in enumerate(ps)],
        F.col("value").alias(node), F.col("p").alias("w"))


# ---------------------------------------------------------------------------
# J6 / A10
# ---------------------------------------------------------------------------
def unseen_configs(spark: SparkSession, cpt: DataFrame, spec: NetworkSpec,
                   doms: Domains) -> DataFrame:
    """Full-depth parent configurations never seen in training (grid minus observed)."""
    M = spec.max_parents
    pas = pa_names(M)
    parts = []
    for n in spec.nodes:
        if n.is_root():
            continue
        K = len(n.parents)
        g = config_grid(spark, list(n.parents), doms).select(
            F.lit(n.name).alias("node"), *[F.col(p).alias(pas[i]) for i, p in enumerate(n.parents)])
        seen = cpt.filter((F.col("node") == n.name) & (F.col("depth") == K)) \
                  .select("node", *pas[:K]).distinct()
        parts.append(g.join(seen, ["node", *pas[:K]], "left_anti")
                     .select("node", *pas[:K], *[F.lit(None).cast("string").alias(x)
                                                 for x in pas[K:]]))
    return reduce(DataFrame.unionByName, parts)


def backoff_rate(spark: SparkSession, cpt: DataFrame, spec: NetworkSpec,
                 doms: Domains) -> DataFrame:
    """Per child node and overall: share of factor cells (parent config x child
    value) whose lookup fell back below full depth, i.e. unseen configs x V
    over grid x V."""
    rows = []
    for n in spec.nodes:
        if not n.is_root():
            rows.append((n.name, len(n.parents), doms.grid_size(n.parents), doms.card(n.name)))
    meta = spark.createDataFrame(rows, "node string, K int, grid long, V long")
    seen = cpt.join(F.broadcast(meta), "node").filter(F.col("depth") == F.col("K")) \
              .groupBy("node").agg((F.count(F.lit(1)) / F.first("V")).cast("long").alias("seen"))
    per = meta.join(seen, "node", "left").select(
        "node", (F.col("grid") - F.coalesce("seen", F.lit(0))).alias("unseen"), "grid", "V")
    per = per.select("node", (F.col("unseen") * F.col("V")).alias("fallback_cells"),
                     (F.col("grid") * F.col("V")).alias("cells"))
    overall = per.agg(F.lit("__all__").alias("node"),
                      F.sum("fallback_cells").alias("fallback_cells"),
                      F.sum("cells").alias("cells"))
    return per.unionByName(overall).withColumn(
        "rate", F.col("fallback_cells") / F.col("cells"))
