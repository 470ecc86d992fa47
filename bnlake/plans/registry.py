"""Registered queries (one per SURVEY §2 operator) and their DuckDB oracles.

Every query reads the driver tables at ``sf_dir`` (whole tables) and returns a
DataFrame; double columns are rounded to 6 places on both sides so the value
hashes compare.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bnlake.functions.scalar import binary_target, round_doubles, sql_binary_target
from bnlake.operators import cpt as cptops
from bnlake.operators import metrics, posterior, prep, split
from bnlake.plans.oracle import OracleSQL, d, sql, sq
from bnlake.plans.pipeline import pipeline, truth_of
from bnlake.spec import DEFAULT_SEED, DISPOSITION_LABELS, default_spec

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def register(name: str, oracle: str | None = None):
    def deco(fn):
        QUERIES[name] = lambda spark, sf_dir: round_doubles(fn(spark, sf_dir))
        if oracle is not None:
            ORACLES[name] = oracle
        return fn
    return deco


SPEC = default_spec()
O = OracleSQL(SPEC)
DOCS = OracleSQL(__import__("bnlake.spec", fromlist=["docs_spec"]).docs_spec(), view="docs")
KEY = SPEC.key
TARGET = SPEC.column(SPEC.target)
EXANTE = SPEC.track("ex_ante")
EXPL = SPEC.track("explanatory")
PAS = ", ".join(f"pa{i}" for i in range(1, SPEC.max_parents + 1))


def r6(expr: str, alias: str) -> str:
    return f"round(CAST({expr} AS DOUBLE), 6) AS {alias}"


FIT = [*O.base(), O.split_chrono(), *O.fit(O.nodes())]
FACT = FIT + [O.factors()]


def post_ctes(track: str) -> list[str]:
    ev = SPEC.track(track)
    return FACT + [O.evidence(ev)] + O.posterior(ev)


# ---------------------------------------------------------------------------
# Sources and preparation
# ---------------------------------------------------------------------------
RAW_COLS = ("case_id, term, chief, issueArea, lawType, caseDispositionUnusual, lcDisposition, "
            "decisionType, precedentAlteration, minVotes, declarationUncon, caseDisposition")


@register("scan_cases", sql(O.base()[:1], f"SELECT {RAW_COLS} FROM raw_cases"))
def q_scan_cases(spark, sf):
    return pipeline(spark, sf).raw


@register("derive_flag", sql(O.base()[:2], "SELECT case_id, minVotes, voteSplit FROM derived"))
def q_derive_flag(spark, sf):
    return prep.derive_flag(pipeline(spark, sf).raw).select("case_id", "minVotes", "voteSplit")


@register("drop_missing_target", sql(O.base()[:2],
          f"SELECT {RAW_COLS}, voteSplit FROM derived WHERE {TARGET} IS NOT NULL"))
def q_drop_missing_target(spark, sf):
    return prep.drop_missing_target(prep.derive_flag(pipeline(spark, sf).raw), SPEC)


@register("drop_sparse_rows", sql(O.base(), f"SELECT {RAW_COLS}, voteSplit FROM prepared"))
def q_drop_sparse_rows(spark, sf):
    return prep.drop_sparse_rows(prep.derive_flag(pipeline(spark, sf).raw), SPEC)


FEATURES = [n.column for n in SPEC.nodes if n.name != SPEC.target]


def _gap_rule(i: int) -> str:
    """Cases of every third key lose a feature in each second place or so."""
    return f"({KEY} % 3 = 0 AND ({KEY} + {7 * i}) % 5 < 3)"


@register("drop_sparse_rows_gaps", sql(O.base()[:2] + [
    f"gappy AS (SELECT {KEY}, " + ", ".join(f"CASE WHEN NOT {_gap_rule(i)} THEN {c} END AS {c}" for i, c in enumerate(FEATURES)) + " FROM derived)"],
    f"SELECT {KEY} FROM gappy WHERE CAST(" + " + ".join(f"CAST({c} IS NULL AS INTEGER)" for c in FEATURES) + f" AS DOUBLE) / {len(FEATURES)}.0 <= 0.5"))
def q_drop_sparse_gaps(spark, sf):
    """P4 on cases that lose features by a rule, so that rows are dropped."""
    df = prep.derive_flag(pipeline(spark, sf).raw)
    gappy = df.select(KEY, *[F.when(~F.expr(_gap_rule(i)), F.col(c)).alias(c) for i, c in enumerate(FEATURES)])
    return prep.drop_sparse_rows(gappy, SPEC).select(KEY)


@register("prepare_cases", sql(O.base(), f"SELECT {RAW_COLS}, voteSplit FROM prepared"))
def q_prepare_cases(spark, sf):
    return pipeline(spark, sf).cases


@register("rename_nodes", sql(O.base() + [O.nodes("all_nodes", "prepared", "")],
                              "SELECT * FROM all_nodes"))
def q_rename_nodes(spark, sf):
    return prep.rename_nodes(pipeline(spark, sf).prepared, SPEC)


def _missing_sql() -> str:
    parts = []
    for i, n in enumerate(SPEC.nodes):
        parts.append(f"SELECT {i} AS pos, {sq(n.name)} AS variable, {sq(n.column)} AS \"column\", "
                     f"CAST(sum(CAST({n.column} IS NULL AS INTEGER)) AS BIGINT) AS n_missing, "
                     f"round(100.0 * sum(CAST({n.column} IS NULL AS INTEGER)) / count(*), 2) AS pct_missing "
                     f"FROM derived")
    return sql(O.base()[:2], " UNION ALL ".join(parts))


@register("missing_report", _missing_sql())
def q_missing_report(spark, sf):
    return prep.missing_report(prep.derive_flag(pipeline(spark, sf).raw), SPEC)


def _rare_sql(o: OracleSQL, src: str, min_count: int = 5) -> str:
    parts = []
    for i, n in enumerate(o.spec.nodes):
        parts.append(f"SELECT {i} AS pos, {sq(n.name)} AS variable, CAST({n.column} AS VARCHAR) AS value, "
                     f"count(*) AS count FROM {src} WHERE {n.column} IS NOT NULL GROUP BY {n.column}")
    return sql(o.base(), "SELECT * FROM (" + " UNION ALL ".join(parts) + f") WHERE count < {min_count}")


@register("rare_categories", _rare_sql(O, "prepared"))
def q_rare_categories(spark, sf):
    return prep.rare_categories(pipeline(spark, sf).cases, SPEC, 5)


@register("rare_categories_common", _rare_sql(O, "prepared", 4000))
def q_rare_categories_common(spark, sf):
    """A2 with a bound that some values of this table fall under."""
    return prep.rare_categories(pipeline(spark, sf).cases, SPEC, 4000)


@register("rare_categories_docs", _rare_sql(DOCS, "prepared"))
def q_rare_categories_docs(spark, sf):
    p = pipeline(spark, sf, "docs")
    return prep.rare_categories(p.cases, p.spec, 5)


def _labels_sql() -> str:
    vals = ", ".join(f"({sq(str(k))}, {sq(v)})" for k, v in DISPOSITION_LABELS.items())
    return f"labels_t AS (SELECT * FROM (VALUES {vals}) t(code, label))"


@register("target_distribution", sql(O.base() + [_labels_sql()], f"""
    SELECT CAST({TARGET} AS VARCHAR) AS code, count(*) AS count,
           round(100.0 * count(*) / (SELECT count(*) FROM prepared), 2) AS pct,
           coalesce(any_value(l.label), CAST({TARGET} AS VARCHAR)) AS label
    FROM prepared LEFT JOIN labels_t l ON l.code = CAST({TARGET} AS VARCHAR)
    WHERE {TARGET} IS NOT NULL GROUP BY {TARGET}"""))
def q_target_distribution(spark, sf):
    return prep.target_distribution(pipeline(spark, sf).cases, SPEC, prep.label_table(spark))


@register("label_values", sql(O.base() + [_labels_sql()], f"""
    SELECT p.{KEY}, p.{TARGET}, coalesce(l.label, CAST(p.{TARGET} AS VARCHAR)) AS label
    FROM prepared p LEFT JOIN labels_t l ON l.code = CAST(p.{TARGET} AS VARCHAR)"""))
def q_label_values(spark, sf):
    c = pipeline(spark, sf).cases.select(KEY, TARGET)
    return prep.label_values(c, TARGET, prep.label_table(spark))


@register("binary_target", sql(O.base(), f"""
    SELECT {KEY}, {TARGET}, {sql_binary_target(TARGET)} AS y_binary FROM prepared
    WHERE {sql_binary_target(TARGET)} IS NOT NULL"""))
def q_binary_target(spark, sf):
    c = pipeline(spark, sf).cases
    return c.select(KEY, TARGET, binary_target(F.col(TARGET)).alias("y_binary")) \
            .filter(F.col("y_binary").isNotNull())


# ---------------------------------------------------------------------------
# Splits
# ---------------------------------------------------------------------------
@register("split_chrono", sql(O.base() + [O.split_chrono()], f"SELECT {KEY}, is_train FROM split"))
def q_split_chrono(spark, sf):
    return pipeline(spark, sf).split.select(KEY, "is_train")


@register("split_random", sql(O.base() + [O.split_random(DEFAULT_SEED)],
                              f"SELECT {KEY}, is_train FROM split"))
def q_split_random(spark, sf):
    return split.split_random(pipeline(spark, sf).cases, KEY, seed=DEFAULT_SEED).select(KEY, "is_train")


def _kfold_sql(k: int = 5) -> str:
    from bnlake.functions.scalar import sql_uniform
    u = sql_uniform(str(DEFAULT_SEED), KEY)
    return sql(O.base(), f"""
    SELECT {KEY}, CAST(least(floor((rn - 1) / (n // {k})), {k - 1}) AS INTEGER) AS fold FROM (
      SELECT {KEY}, row_number() OVER (ORDER BY {u}, {KEY}) AS rn, count(*) OVER () AS n
      FROM prepared)""")


@register("kfold_assign", _kfold_sql())
def q_kfold(spark, sf):
    return split.kfold_assign(pipeline(spark, sf).cases, 5, KEY, DEFAULT_SEED).select(KEY, "fold")


# ---------------------------------------------------------------------------
# CPTs
# ---------------------------------------------------------------------------
@register("value_domains", sql(FIT, "SELECT node, value, ord FROM domains"))
def q_value_domains(spark, sf):
    return pipeline(spark, sf).domain_df


@register("cpt_counts", sql(FIT, f"SELECT node, depth, {PAS}, value, CAST(n AS BIGINT) AS n FROM counts"))
def q_cpt_counts(spark, sf):
    return pipeline(spark, sf).counts


@register("marginal_cpt", sql(FIT, f"SELECT node, value, ord, n, n_pa, {r6('p', 'p')} FROM level_0"))
def q_marginal_cpt(spark, sf):
    p = pipeline(spark, sf)
    return p.cpt.filter(F.col("depth") == 0).select("node", "value", "ord", "n", "n_pa", "p")


CPT_SELECT = f"SELECT node, depth, {PAS}, value, ord, n, n_pa, {r6('p', 'p')} FROM cpt"


@register("cpt_backoff", sql(FIT, CPT_SELECT))
def q_cpt_backoff(spark, sf):
    return pipeline(spark, sf).cpt


@register("fit_network", sql(FIT, CPT_SELECT))
def q_fit_network(spark, sf):
    return pipeline(spark, sf).cpt


_OL = OracleSQL(SPEC, backoff=False)


@register("cpt_laplace", sql([*_OL.base(), _OL.split_chrono(), *_OL.fit(_OL.nodes())], CPT_SELECT))
def q_cpt_laplace(spark, sf):
    return pipeline(spark, sf, backoff=False).cpt


@register("lower_level_join", sql(FIT, f"""
    SELECT c.node, c.depth, {', '.join('c.' + p for p in PAS.split(', '))}, c.value,
           {r6('l.p', 'p_lower')}
    FROM cpt c JOIN cpt l ON l.node = c.node AND l.depth = c.depth - 1 AND l.value = c.value
     AND (l.pa1 IS NOT DISTINCT FROM CASE WHEN c.depth > 1 THEN c.pa1 END)
     AND (l.pa2 IS NOT DISTINCT FROM CASE WHEN c.depth > 2 THEN c.pa2 END)
     AND (l.pa3 IS NOT DISTINCT FROM CASE WHEN c.depth > 3 THEN c.pa3 END)
     AND (l.pa4 IS NOT DISTINCT FROM CASE WHEN c.depth > 4 THEN c.pa4 END)
     AND (l.pa5 IS NOT DISTINCT FROM CASE WHEN c.depth > 5 THEN c.pa5 END)
    WHERE c.depth > 0"""))
def q_lower_level_join(spark, sf):
    """Each CPT row beside the shallower row it backs off to (prefix minus
    its last parent, same value) -- equi-join on (node, depth-1, prefix, value)."""
    c = pipeline(spark, sf).cpt
    pas = PAS.split(", ")
    low = c.select("node", (F.col("depth") + 1).alias("depth"),
                   *[F.col(p).alias(f"_{p}") for p in pas], "value", F.col("p").alias("p_lower"))
    hi = c.filter(F.col("depth") > 0).select(
        "node", "depth", *pas, "value",
        *[F.when(F.col("depth") > i + 1, F.col(p)).alias(f"_k{i}") for i, p in enumerate(pas)])
    j = hi.join(low, [hi["node"] == low["node"], hi["depth"] == low["depth"],
                      hi["value"] == low["value"]] +
                [hi[f"_k{i}"].eqNullSafe(low[f"_{p}"]) for i, p in enumerate(pas)])
    return j.select(hi["node"], hi["depth"], *[hi[p] for p in pas], hi["value"], "p_lower")


@register("factor_tables", sql(FACT, f"SELECT node, {PAS}, value, ord, hit_depth, {r6('p', 'p')} FROM factors"))
def q_factor_tables(spark, sf):
    return pipeline(spark, sf).factors_long.select("node", *PAS.split(", "), "value", "ord",
                                                   "hit_depth", "p")


@register("cpt_lookup", sql(FACT, f"""
    SELECT node, {PAS}, value, hit_depth, {r6('p0', 'p')} FROM factor_raw"""))
def q_cpt_lookup(spark, sf):
    """J1 on the full grid of every node: backoff probability before the
    per-configuration normalisation, and the depth it was answered at."""
    p = pipeline(spark, sf)
    pas = PAS.split(", ")
    grid = p.factors_long.select("node", *pas, "value")
    return cptops.cpt_lookup(grid, p.cpt, p.card, SPEC.max_parents, p.alpha) \
        .select("node", *pas, "value", "hit_depth", "p")


@register("domain_cross", sql(FACT, f"SELECT node, {PAS}, value FROM factors"))
def q_domain_cross(spark, sf):
    p = pipeline(spark, sf)
    return p.factors_long.select("node", *PAS.split(", "), "value")


@register("unseen_configs", sql(FACT, f"""
    SELECT DISTINCT f.node, {', '.join('f.' + x for x in PAS.split(', '))} FROM factors f
    WHERE f.hit_depth < (SELECT max(depth) FROM cpt c WHERE c.node = f.node)"""))
def q_unseen_configs(spark, sf):
    p = pipeline(spark, sf)
    return cptops.unseen_configs(spark, p.cpt, SPEC, p.doms)


@register("backoff_rate", sql(FACT, f"""
    SELECT node, fallback_cells, cells, {r6('CAST(fallback_cells AS DOUBLE) / cells', 'rate')} FROM (
      SELECT node, CAST(sum(CAST(hit_depth < k AS INTEGER)) AS BIGINT) AS fallback_cells,
             CAST(count(*) AS BIGINT) AS cells
      FROM (SELECT f.*, (SELECT max(depth) FROM cpt c WHERE c.node = f.node) AS k FROM factors f)
      WHERE k > 0 GROUP BY ROLLUP (node))
    """.replace("GROUP BY ROLLUP (node))", "GROUP BY ROLLUP (node)) WHERE node IS NOT NULL UNION ALL "
                "SELECT '__all__', fallback_cells, cells, round(CAST(fallback_cells AS DOUBLE) / cells, 6) FROM ("
                "SELECT CAST(sum(CAST(hit_depth < k AS INTEGER)) AS BIGINT) AS fallback_cells, "
                "CAST(count(*) AS BIGINT) AS cells FROM (SELECT f.*, (SELECT max(depth) FROM cpt c "
                "WHERE c.node = f.node) AS k FROM factors f) WHERE k > 0)")))
def q_backoff_rate(spark, sf):
    p = pipeline(spark, sf)
    return cptops.backoff_rate(spark, p.cpt, SPEC, p.doms)


# ---------------------------------------------------------------------------
# Posteriors
# ---------------------------------------------------------------------------
POST_SEL = f"SELECT {KEY}, class, class_ord, {r6('p', 'p')} FROM post"


@register("posterior_exact", sql(post_ctes("ex_ante"), POST_SEL))
def q_posterior_exact(spark, sf):
    return pipeline(spark, sf).posterior("ex_ante")


@register("posterior_exact_explanatory", sql(post_ctes("explanatory"), POST_SEL))
def q_posterior_exact_expl(spark, sf):
    return pipeline(spark, sf).posterior("explanatory")


def _full_evidence_sql() -> str:
    ps = SPEC.parents(SPEC.target)
    ctes = FACT + [O.evidence(ps)]
    on = " AND ".join([f"f.node = {sq(SPEC.target)}"] +
                      [f"f.pa{i + 1} = e.{p}" for i, p in enumerate(ps)])
    nn = " AND ".join(f"e.{p} IS NOT NULL" for p in ps)
    return sql(ctes, f"""
      SELECT e.{KEY}, f.value AS class, CAST(f.ord AS INTEGER) AS class_ord,
             {r6('f.p / sum(f.p) OVER (PARTITION BY e.' + KEY + ')', 'p')}
      FROM ev e JOIN factors f ON {on} WHERE {nn}""")


@register("posterior_full_evidence", _full_evidence_sql())
def q_posterior_full_evidence(spark, sf):
    p = pipeline(spark, sf)
    ps = SPEC.parents(SPEC.target)
    ev = p.evidence(ps)
    return posterior.posterior_full_evidence(spark, SPEC, p.factors[SPEC.target], p.doms, ev)


def _prior_sql() -> str:
    ctes = FACT
    parts = []
    for v in SPEC.names:
        # no evidence: the joint over every variable, summed to v
        joins = []
        for u in SPEC.names:
            joins.append(f"JOIN domains x_{u} ON x_{u}.node = {sq(u)}")
        for n in SPEC.nodes:
            on = [f"f_{n.name}.node = {sq(n.name)}", f"f_{n.name}.value = x_{n.name}.value"] + \
                 [f"f_{n.name}.pa{i + 1} = x_{p}.value" for i, p in enumerate(n.parents)]
            joins.append(f"JOIN factors f_{n.name} ON " + " AND ".join(on))
        w = " * ".join(f"f_{n}.p" for n in SPEC.names)
        parts.append(f"SELECT {sq(v)} AS node, x_{v}.value AS value, x_{v}.ord AS ord, sum({w}) AS w "
                     f"FROM (SELECT 1 AS _one) dev {' '.join(joins)} GROUP BY x_{v}.value, x_{v}.ord")
    return sql(ctes + ["pj AS (" + " UNION ALL ".join(parts) + ")"],
               f"SELECT node, value, CAST(ord AS INTEGER) AS ord, "
               f"{r6('w / sum(w) OVER (PARTITION BY node)', 'p')} FROM pj")


@register("prior_marginals", _prior_sql())
def q_prior_marginals(spark, sf):
    """I4: marginal of every node with no evidence (I2 on an empty evidence row)."""
    from functools import reduce as _r
    p = pipeline(spark, sf)
    one = spark.range(1).select(F.col("id").alias(KEY))
    parts = []
    for v in SPEC.names:
        post = posterior.posterior_exact(spark, SPEC, p.factors, p.doms, one, [], query=v)
        parts.append(post.select(F.lit(v).alias("node"), F.col("class").alias("value"),
                                 F.col("class_ord").alias("ord"), "p"))
    return _r(DataFrame.unionByName, parts)


# ---------------------------------------------------------------------------
# Ranking, normalisation, alignment
# ---------------------------------------------------------------------------
RANK_SQL = f"""ranked AS (SELECT *, row_number() OVER (PARTITION BY {KEY} ORDER BY p DESC, class_ord) AS rank
                          FROM (SELECT {KEY}, class, class_ord, round(p, 12) AS p FROM post))"""


@register("rank_posterior", sql(post_ctes("ex_ante") + [RANK_SQL],
                                f"SELECT {KEY}, class, {r6('p', 'p')}, rank FROM ranked"))
def q_rank_posterior(spark, sf):
    post = pipeline(spark, sf).posterior("ex_ante").withColumn("p", F.round("p", 12))
    return posterior.rank_posterior(post, KEY).select(KEY, "class", "p", "rank")


@register("top_k_predictions", sql(post_ctes("ex_ante") + [RANK_SQL],
                                   f"SELECT {KEY}, class, {r6('p', 'p')}, rank FROM ranked WHERE rank <= 3"))
def q_top_k(spark, sf):
    post = pipeline(spark, sf).posterior("ex_ante").withColumn("p", F.round("p", 12))
    return posterior.top_k(post, 3, KEY).select(KEY, "class", "p", "rank")


@register("top1_prediction", sql(post_ctes("ex_ante") + [RANK_SQL],
                                 f"SELECT {KEY}, class AS pred, {r6('p', 'confidence')} FROM ranked WHERE rank = 1"))
def q_top1(spark, sf):
    post = pipeline(spark, sf).posterior("ex_ante").withColumn("p", F.round("p", 12))
    return posterior.top1(post, KEY)


@register("normalize_rows", sql(post_ctes("ex_ante"), f"""
    SELECT {KEY}, class, {r6('(p * 2.0) / sum(p * 2.0) OVER (PARTITION BY ' + KEY + ')', 'p')} FROM post"""))
def q_normalize_rows(spark, sf):
    post = pipeline(spark, sf).posterior("ex_ante").withColumn("p", F.col("p") * 2.0)
    return posterior.normalize_rows(post, KEY).select(KEY, "class", "p")


def _two_tracks() -> list[str]:
    a = FACT + [O.evidence(EXANTE, name="ev_a")] + \
        [c.replace("dev AS", "dev_a AS").replace("FROM dev ", "FROM dev_a dev ")
          .replace("joint AS", "joint_a AS").replace("FROM joint)", "FROM joint_a)")
          .replace("jpost AS", "jpost_a AS").replace("JOIN jpost j", "JOIN jpost_a j")
         for c in O.posterior(EXANTE, ev="ev_a", name="post_a")]
    b = [O.evidence(EXPL, name="ev_b")] + \
        [c.replace("dev AS", "dev_b AS").replace("FROM dev ", "FROM dev_b dev ")
          .replace("joint AS", "joint_b AS").replace("FROM joint)", "FROM joint_b)")
          .replace("jpost AS", "jpost_b AS").replace("JOIN jpost j", "JOIN jpost_b j")
         for c in O.posterior(EXPL, ev="ev_b", name="post_b")]
    return a + b


@register("posterior_align", sql(_two_tracks(), f"""
    SELECT coalesce(a.{KEY}, b.{KEY}) AS {KEY}, coalesce(a.class, b.class) AS class,
           {r6('coalesce(a.p, 0.0)', 'p_a')}, {r6('coalesce(b.p, 0.0)', 'p_b')}
    FROM post_a a FULL OUTER JOIN post_b b ON a.{KEY} = b.{KEY} AND a.class = b.class"""))
def q_posterior_align(spark, sf):
    p = pipeline(spark, sf)
    return posterior.posterior_align(p.posterior("ex_ante"), p.posterior("explanatory"), KEY)


@register("tv_distance", sql(_two_tracks(), f"""
    SELECT {KEY}, {r6('0.5 * sum(abs(pa - pb))', 'tv')} FROM (
      SELECT coalesce(a.{KEY}, b.{KEY}) AS {KEY}, coalesce(a.p, 0.0) AS pa, coalesce(b.p, 0.0) AS pb
      FROM post_a a FULL OUTER JOIN post_b b ON a.{KEY} = b.{KEY} AND a.class = b.class)
    GROUP BY {KEY}"""))
def q_tv_distance(spark, sf):
    p = pipeline(spark, sf)
    return posterior.tv_distance(p.posterior("ex_ante"), p.posterior("explanatory"), KEY)


# ---------------------------------------------------------------------------
# Metrics
# ---------------------------------------------------------------------------
def p_ctes(track: str = "ex_ante") -> list[str]:
    """P matrix in SQL: truth classes UNION support, zero fill, normalise."""
    return post_ctes(track) + p_tail()


def p_tail(KEY: str = KEY) -> list[str]:
    """Needs CTEs ``ev`` (key, y_true) and ``post`` (key, class, p)."""
    return [
        f"""classes AS (SELECT class, CAST(row_number() OVER (ORDER BY TRY_CAST(class AS DOUBLE) NULLS LAST, class) AS INTEGER) AS class_ord
             FROM (SELECT DISTINCT class FROM (SELECT y_true AS class FROM ev WHERE y_true IS NOT NULL
                   UNION ALL SELECT class FROM post) WHERE class IS NOT NULL))""",
        f"""pm AS (SELECT t.{KEY}, t.y_true, c.class, c.class_ord, coalesce(po.p, 0.0) AS p0
             FROM (SELECT DISTINCT e.{KEY}, e.y_true FROM ev e JOIN post x ON x.{KEY} = e.{KEY}
                   WHERE e.y_true IS NOT NULL) t
             CROSS JOIN classes c LEFT JOIN post po ON po.{KEY} = t.{KEY} AND po.class = c.class)""",
        f"""pmat AS (SELECT {KEY}, y_true, class, class_ord,
             CASE WHEN sum(p0) OVER (PARTITION BY {KEY}) > 0 THEN p0 / sum(p0) OVER (PARTITION BY {KEY})
                  ELSE 1.0 / (SELECT count(*) FROM classes) END AS p FROM pm)""",
        f"""sc AS (SELECT {KEY}, y_true,
              min(CASE WHEN class = y_true THEN rk END) AS true_rank,
              sum(CASE WHEN class = y_true THEN p ELSE 0.0 END) AS p_true,
              sum(power(p - CASE WHEN class = y_true THEN 1.0 ELSE 0.0 END, 2)) AS brier,
              max(CASE WHEN rk = 1 THEN class END) AS pred, max(p) AS confidence, count(*) AS n_classes
             FROM (SELECT *, row_number() OVER (PARTITION BY {KEY} ORDER BY p DESC, class_ord) AS rk FROM pmat)
             GROUP BY {KEY}, y_true)""",
        f"""scores AS (SELECT *, -ln(greatest(least(p_true, 1.0), 1e-12)) AS log_loss,
              CAST(pred = y_true AS DOUBLE) AS correct,
              CAST(coalesce(true_rank, 1073741824) <= least(1, n_classes) AS DOUBLE) AS hit_1,
              CAST(coalesce(true_rank, 1073741824) <= least(3, n_classes) AS DOUBLE) AS hit_3,
              CAST(coalesce(true_rank, 1073741824) <= least(5, n_classes) AS DOUBLE) AS hit_5
             FROM sc)"""]


@register("class_union", sql(p_ctes(), "SELECT class, class_ord FROM classes"))
def q_class_union(spark, sf):
    p = pipeline(spark, sf)
    return metrics.class_union(p.truth(), p.posterior("ex_ante"))


@register("predict_distributions", sql(p_ctes(), f"""
    SELECT {KEY}, y_true, class, class_ord, {r6('p', 'p')} FROM pmat"""))
def q_predict_distributions(spark, sf):
    return pipeline(spark, sf).matrix("ex_ante")


@register("topk_accuracy", sql(p_ctes(), """
    SELECT round(coalesce(avg(hit_1), 0.0), 6) AS top_1, round(coalesce(avg(hit_3), 0.0), 6) AS top_3,
           round(coalesce(avg(hit_5), 0.0), 6) AS top_5 FROM scores"""))
def q_topk(spark, sf):
    return metrics.topk_accuracy(pipeline(spark, sf).scores("ex_ante"))


@register("log_loss", sql(p_ctes(), "SELECT round(avg(log_loss), 6) AS log_loss FROM scores"))
def q_log_loss(spark, sf):
    return metrics.log_loss(pipeline(spark, sf).scores("ex_ante"))


@register("brier", sql(p_ctes(), "SELECT round(avg(brier), 6) AS brier FROM scores"))
def q_brier(spark, sf):
    return metrics.brier(pipeline(spark, sf).scores("ex_ante"))


AUC_SQL = """auc_g AS (SELECT class, round(p, 12) AS p, sum(CAST(class = y_true AS BIGINT)) AS pos,
                 sum(CAST(class <> y_true AS BIGINT)) AS neg FROM pmat GROUP BY class, round(p, 12)),
  auc_c AS (SELECT class, sum(pos * (coalesce(nb, 0) + 0.5 * neg)) AS u, sum(pos) AS P, sum(neg) AS N
            FROM (SELECT *, sum(neg) OVER (PARTITION BY class ORDER BY p ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS nb
                  FROM auc_g) GROUP BY class),
  auc AS (SELECT CASE WHEN (SELECT count(DISTINCT y_true) FROM pmat WHERE class = y_true) >= 2 AND count(*) > 0
                      THEN avg(CAST(u AS DOUBLE) / (CAST(P AS DOUBLE) * CAST(N AS DOUBLE))) END AS macro_auc
          FROM auc_c WHERE P > 0 AND N > 0)"""


@register("macro_auc", sql(p_ctes() + [AUC_SQL], "SELECT round(macro_auc, 6) AS macro_auc FROM auc"))
def q_macro_auc(spark, sf):
    return metrics.macro_auc(pipeline(spark, sf).matrix("ex_ante"))


def _bin_sql(col: str = "confidence") -> str:
    edges = metrics.ece_edges()
    return "(" + " + ".join(f"CAST({col} >= {d(edges[i])} AS INTEGER)" for i in range(1, 10)) + ")"


ECE_SQL = f"""ece_b AS (SELECT {_bin_sql()} AS bin, count(*) AS c, avg(correct) AS a, avg(confidence) AS f
                FROM scores GROUP BY 1),
  ece_t AS (SELECT sum(c * abs(a - f)) / sum(c) AS ece FROM ece_b)"""


@register("ece", sql(p_ctes() + [ECE_SQL], "SELECT round(ece, 6) AS ece FROM ece_t"))
def q_ece(spark, sf):
    return metrics.ece(pipeline(spark, sf).scores("ex_ante"))


def _reliability_sql() -> str:
    edges = metrics.ece_edges()
    vals = ", ".join(f"({i}, {d(edges[i])}, {d(edges[i + 1])})" for i in range(10))
    return sql(p_ctes() + [ECE_SQL, f"bins AS (SELECT * FROM (VALUES {vals}) t(bin, lo, hi))"], """
      SELECT CAST(b.bin AS INTEGER) AS bin, round(b.lo, 6) AS lo, round(b.hi, 6) AS hi,
             CAST(coalesce(e.c, 0) AS BIGINT) AS count,
             round(coalesce(e.a, 0.0), 6) AS accuracy, round(coalesce(e.f, (b.lo + b.hi) / 2), 6) AS confidence,
             round(abs(coalesce(e.a, 0.0) - coalesce(e.f, (b.lo + b.hi) / 2)), 6) AS gap
      FROM bins b LEFT JOIN ece_b e ON e.bin = b.bin""")


@register("reliability_data", _reliability_sql())
def q_reliability(spark, sf):
    return metrics.reliability_bins(pipeline(spark, sf).scores("ex_ante"))


PRF_SQL = """prf AS (SELECT c.class, c.class_ord,
      CASE WHEN coalesce(np.n_pred, 0) > 0 THEN coalesce(t.tp, 0.0) / np.n_pred ELSE 0.0 END AS precision,
      CASE WHEN coalesce(t.support, 0) > 0 THEN coalesce(t.tp, 0.0) / t.support ELSE 0.0 END AS recall,
      CAST(coalesce(t.support, 0) AS BIGINT) AS support
    FROM classes c
    LEFT JOIN (SELECT y_true AS class, count(*) AS support, sum(correct) AS tp FROM scores GROUP BY 1) t ON t.class = c.class
    LEFT JOIN (SELECT pred AS class, count(*) AS n_pred FROM scores GROUP BY 1) np ON np.class = c.class),
  prf1 AS (SELECT *, CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) ELSE 0.0 END AS f1 FROM prf)"""


@register("per_class_prf", sql(p_ctes() + [PRF_SQL], """
    SELECT class, class_ord, round(precision, 6) AS precision, round(recall, 6) AS recall, support,
           round(f1, 6) AS f1 FROM prf1"""))
def q_prf(spark, sf):
    p = pipeline(spark, sf)
    classes = p.matrix("ex_ante").select("class", "class_ord").distinct()
    return metrics.per_class_prf(p.scores("ex_ante"), classes)


@register("macro_f1", sql(p_ctes() + [PRF_SQL],
                          "SELECT round(coalesce(avg(f1), 0.0), 6) AS macro_f1 FROM prf1 WHERE support > 0"))
def q_macro_f1(spark, sf):
    p = pipeline(spark, sf)
    classes = p.matrix("ex_ante").select("class", "class_ord").distinct()
    return metrics.macro_f1(metrics.per_class_prf(p.scores("ex_ante"), classes))


@register("confusion_matrix", sql(p_ctes(), "SELECT y_true, pred, count(*) AS count FROM scores GROUP BY 1, 2"))
def q_confusion(spark, sf):
    return metrics.confusion_matrix(pipeline(spark, sf).scores("ex_ante"))


def _summary_sql(track: str) -> str:
    return sql(p_ctes(track) + [AUC_SQL, ECE_SQL, PRF_SQL], """
      SELECT (SELECT count(*) FROM scores) AS n_test,
             round((SELECT avg(hit_1) FROM scores), 6) AS top_1,
             round(CASE WHEN (SELECT count(*) FROM classes) >= 3 THEN (SELECT avg(hit_3) FROM scores) END, 6) AS top_3,
             round(CASE WHEN (SELECT count(*) FROM classes) >= 5 THEN (SELECT avg(hit_5) FROM scores) END, 6) AS top_5,
             round((SELECT avg(log_loss) FROM scores), 6) AS log_loss,
             round((SELECT avg(brier) FROM scores), 6) AS brier,
             (SELECT count(DISTINCT class) FROM pmat) AS n_classes,
             round((SELECT macro_auc FROM auc), 6) AS macro_auc,
             round((SELECT ece FROM ece_t), 6) AS ece,
             round((SELECT coalesce(avg(f1), 0.0) FROM prf1 WHERE support > 0), 6) AS macro_f1""")


@register("evaluate_model", _summary_sql("ex_ante"))
def q_evaluate_model(spark, sf):
    return metrics.summary_row(pipeline(spark, sf).matrix("ex_ante"), KEY)


@register("evaluate_model_explanatory", _summary_sql("explanatory"))
def q_evaluate_model_expl(spark, sf):
    return metrics.summary_row(pipeline(spark, sf).matrix("explanatory"), KEY)


def _binary_eval_sql(track: str) -> str:
    """The collapsed posterior against the recoded truth, other outcomes dropped."""
    import re
    named = [re.sub(r"\bev\b", "bev", re.sub(r"\bpost\b", "bpost", c)) for c in p_tail()]
    bt = sql_binary_target("class")
    head = post_ctes(track) + [
        f"bev AS (SELECT {KEY}, CAST({sql_binary_target('y_true')} AS VARCHAR) AS y_true FROM ev WHERE {sql_binary_target('y_true')} IS NOT NULL)",
        f"bsum AS (SELECT {KEY}, CAST({bt} AS VARCHAR) AS class, sum(p) AS pm FROM post WHERE {bt} IS NOT NULL GROUP BY 1, 2)",
        f"""bpost AS (SELECT {KEY}, class, CASE WHEN sum(pm) OVER (PARTITION BY {KEY}) > 0 THEN pm / sum(pm) OVER (PARTITION BY {KEY}) ELSE 0.5 END AS p FROM bsum
             UNION ALL SELECT k.{KEY}, c.class, 0.5 FROM (SELECT DISTINCT {KEY} FROM post) k, (VALUES ('0'), ('1')) c(class)
             WHERE k.{KEY} NOT IN (SELECT {KEY} FROM bsum))"""]
    return sql(head + named + [AUC_SQL, ECE_SQL, PRF_SQL], SUMMARY_BINARY)


SUMMARY_BINARY = """SELECT (SELECT count(*) FROM scores) AS n_test, round((SELECT avg(hit_1) FROM scores), 6) AS accuracy,
             round((SELECT avg(log_loss) FROM scores), 6) AS log_loss, round((SELECT avg(brier) FROM scores), 6) AS brier,
             round((SELECT macro_auc FROM auc), 6) AS macro_auc, round((SELECT ece FROM ece_t), 6) AS ece"""


@register("evaluate_binary", f"SELECT 'explanatory' AS track, * FROM ({_binary_eval_sql('explanatory')}) "
                             f"UNION ALL SELECT 'ex_ante' AS track, * FROM ({_binary_eval_sql('ex_ante')})")
def q_evaluate_binary(spark, sf):
    """The affirm/reverse task on both tracks: collapsed posterior against the
    recoded outcome; cases in neither class are left out."""
    from bnlake.session import keep
    p = pipeline(spark, sf)
    truth = p.truth().select(KEY, binary_target(F.col("y_true")).cast("string").alias("y_true")).filter("y_true is not null")
    rows = []
    for track in ("explanatory", "ex_ante"):
        P = keep(metrics.predict_distributions(prep.binary_collapse(p.posterior(track), KEY), truth, KEY))
        rows.append(metrics.summary_row(P, KEY, ks=(1,)).select(
            F.lit(track).alias("track"), "n_test", F.col("top_1").alias("accuracy"), "log_loss", "brier", "macro_auc", "ece"))
    return rows[0].unionByName(rows[1])


@register("binary_collapse", sql(post_ctes("ex_ante"), f"""
    SELECT {KEY}, class, {r6('CASE WHEN sum(pm) OVER (PARTITION BY ' + KEY + ') > 0 THEN pm / sum(pm) OVER (PARTITION BY ' + KEY + ') ELSE 0.5 END', 'p')}
    FROM (SELECT {KEY}, CAST({sql_binary_target('class')} AS VARCHAR) AS class, sum(p) AS pm
          FROM post WHERE {sql_binary_target('class')} IS NOT NULL GROUP BY 1, 2)
    UNION ALL
    SELECT k.{KEY}, c.class, 0.5 AS p FROM (SELECT DISTINCT {KEY} FROM post WHERE {KEY} NOT IN
      (SELECT {KEY} FROM post WHERE {sql_binary_target('class')} IS NOT NULL)) k,
      (VALUES ('0'), ('1')) c(class)"""))
def q_binary_collapse(spark, sf):
    return prep.binary_collapse(pipeline(spark, sf).posterior("ex_ante"), KEY)


# ---------------------------------------------------------------------------
# Association (A13, D1-D6, W5) on the prepared cases, raw column names
# ---------------------------------------------------------------------------
from itertools import combinations as _comb  # noqa: E402

from bnlake.operators import association as assoc  # noqa: E402

VARS = [n.column for n in SPEC.nodes]


def _cont_sql() -> list[str]:
    parts = [f"SELECT {sq(a)} AS var_a, {sq(b)} AS var_b, CAST({a} AS VARCHAR) AS a, "
             f"CAST({b} AS VARCHAR) AS b, count(*) AS n FROM prepared "
             f"WHERE {a} IS NOT NULL AND {b} IS NOT NULL GROUP BY {a}, {b}"
             for a, b in _comb(VARS, 2)]
    return O.base() + ["cont AS (" + " UNION ALL ".join(parts) + ")", """
      cs AS (SELECT *, CAST(sum(n) OVER (PARTITION BY var_a, var_b) AS DOUBLE) AS NN,
                CAST(sum(n) OVER (PARTITION BY var_a, var_b, a) AS DOUBLE) AS na,
                CAST(sum(n) OVER (PARTITION BY var_a, var_b, b) AS DOUBLE) AS nb FROM cont),
      ma AS (SELECT var_a, var_b, sum(-(na / NN) * ln(na / NN)) AS h_a, count(*) AS card_a
             FROM (SELECT DISTINCT var_a, var_b, a, na, NN FROM cs) GROUP BY 1, 2),
      mb AS (SELECT var_a, var_b, sum(-(nb / NN) * ln(nb / NN)) AS h_b, count(*) AS card_b
             FROM (SELECT DISTINCT var_a, var_b, b, nb, NN FROM cs) GROUP BY 1, 2),
      st AS (SELECT var_a, var_b, CAST(any_value(NN) AS BIGINT) AS n,
                avg(abs(n / NN - (na / NN) * (nb / NN))) AS deviation,
                sum((n / NN) * ln((n / NN) / ((na / NN) * (nb / NN)))) AS mi_raw FROM cs GROUP BY 1, 2),
      stats AS (SELECT st.var_a, st.var_b, st.n, st.deviation, greatest(st.mi_raw, 0.0) AS mutual_info,
                CASE WHEN ma.h_a > 0 AND mb.h_b > 0 THEN least(1.0, greatest(st.mi_raw, 0.0) / sqrt(ma.h_a * mb.h_b))
                     ELSE 0.0 END AS nmi,
                2.0 * st.n * greatest(st.mi_raw, 0.0) AS g,
                CAST((ma.card_a - 1) * (mb.card_b - 1) AS INTEGER) AS dof
         FROM st JOIN ma USING (var_a, var_b) JOIN mb USING (var_a, var_b))"""]


def _stats(spark, sf):
    return assoc.pair_stats(assoc.contingency(pipeline(spark, sf).cases, VARS))


@register("contingency", sql(_cont_sql(), "SELECT var_a, var_b, a, b, n FROM cont"))
def q_contingency(spark, sf):
    return assoc.contingency(pipeline(spark, sf).cases, VARS)


@register("dependency_deviation", sql(_cont_sql(), "SELECT var_a, var_b, n, round(deviation, 6) AS deviation FROM stats"))
def q_dep_dev(spark, sf):
    return _stats(spark, sf).select("var_a", "var_b", "n", "deviation")


@register("mutual_information", sql(_cont_sql(), "SELECT var_a, var_b, round(mutual_info, 6) AS mutual_info FROM stats"))
def q_mi(spark, sf):
    return _stats(spark, sf).select("var_a", "var_b", "mutual_info")


@register("normalized_mi", sql(_cont_sql(), "SELECT var_a, var_b, round(nmi, 6) AS nmi FROM stats"))
def q_nmi(spark, sf):
    return _stats(spark, sf).select("var_a", "var_b", "nmi")


@register("g_test", sql(_cont_sql(), """
    SELECT var_a, var_b, n, round(g, 6) AS g, dof,
           round(CASE WHEN dof <= 0 THEN 1.0 WHEN dof % 2 = 0 THEN
                   CASE WHEN g <= 0 THEN 1.0 ELSE least(1.0, (SELECT sum(exp(i * ln(greatest(g / 2, 1e-300)) - g / 2 - lgamma(i + 1)))
                                                   FROM range(0, dof // 2) r(i))) END END, 6) AS p_value
    FROM stats"""))
def q_g_test(spark, sf):
    return assoc.g_test(_stats(spark, sf))


@register("g_test_exact", sql(_cont_sql(), """
    SELECT var_a, var_b, n, round(g, 6) AS g, dof, round(CASE WHEN dof <= 0 OR g <= 0 THEN 1.0 ELSE greatest(0.0, 1.0 -
             (SELECT sum(exp((dof / 2.0 + i) * ln(g / 2) - g / 2 - lgamma(dof / 2.0 + i + 1)))
              FROM range(0, CAST(60 + g + 12 * sqrt(g) AS BIGINT)) r(i))) END, 6) AS p_value
    FROM stats"""))
def q_g_test_exact(spark, sf):
    """D4 with the p-values of all dof."""
    return assoc.g_test(_stats(spark, sf), exact_odd=True)


@register("dependency_matrix", sql(_cont_sql(), "SELECT var_a, var_b, round(deviation, 6) AS score FROM stats "
                                   "UNION ALL SELECT var_b, var_a, round(deviation, 6) FROM stats UNION ALL "
                                   "SELECT DISTINCT var_a, var_a, 0.0 FROM (SELECT var_a FROM stats UNION SELECT var_b FROM stats)"))
def q_dep_matrix(spark, sf):
    return assoc.dependency_matrix(_stats(spark, sf), VARS)


def _top_sql(col: str, thr: float, top: int, tag: str | None = None) -> str:
    pos = "CASE " + " ".join(f"WHEN {{x}} = {sq(v)} THEN {i}" for i, v in enumerate(VARS)) + " END"
    tagc = f", {sq(tag)} AS method" if tag else ""
    return f"""SELECT var_a, var_b, score, rank{tagc} FROM (
        SELECT var_a, var_b, round({col}, 6) AS score,
               row_number() OVER (ORDER BY round({col}, 6) DESC, {pos.format(x='var_a')}, {pos.format(x='var_b')}) AS rank
        FROM stats WHERE {col} >= {thr}) WHERE rank <= {top}"""


@register("top_dependencies", sql(_cont_sql(), _top_sql("deviation", 0.01, 20)))
def q_top_dep(spark, sf):
    return assoc.top_dependencies(_stats(spark, sf), VARS, "deviation", 0.01, 20)


@register("dependency_report", sql(_cont_sql(), _top_sql("deviation", 0.001, 20, "deviation")
                                   + " UNION ALL " + _top_sql("mutual_info", 0.001, 20, "mutual_info")))
def q_dep_report(spark, sf):
    return assoc.dependency_report(_stats(spark, sf), VARS, 0.001, 20)


# ---------------------------------------------------------------------------
# Structure (G1-G8, SET1): train split, raw column names
# ---------------------------------------------------------------------------
from bnlake.operators import structure as struct_ops  # noqa: E402

HAND = struct_ops.spec_graph(SPEC, VARS)


def _family_sql(families: list[tuple[str, list[str]]], src: str) -> list[str]:
    """LL of each family on rows complete for it; n and cardinalities from all rows."""
    parts = []
    for i, (node, ps) in enumerate(families):
        cols = list(ps) + [node]
        nn = " AND ".join(f"{c} IS NOT NULL" for c in cols)
        grp = ", ".join(cols)
        pg = ", ".join(ps) if ps else "NULL"
        parts.append(f"""SELECT {i} AS fam, {sq(node)} AS node, {len(ps)} AS k,
            sum(CAST(cnt AS DOUBLE) * ln(CAST(cnt AS DOUBLE) / CAST(npa AS DOUBLE))) AS ll, sum(cnt) AS nrows
            FROM (SELECT *, sum(cnt) OVER (PARTITION BY {pg}) AS npa FROM
                  (SELECT {grp}, count(*) AS cnt FROM {src} WHERE {nn} GROUP BY {grp}))""")
    card = ", ".join(f"count(DISTINCT {v}) AS c_{v}" for v in VARS)
    allnull = " AND ".join(f"{v} IS NULL" for v in VARS)
    pens = []
    for i, (node, ps) in enumerate(families):
        q = " * ".join([f"greatest(c_{p}, 1)" for p in ps]) or "1"
        pens.append(f"SELECT {i} AS fam, 0.5 * ln(greatest(nn, 1)) * (greatest(c_{node}, 1) - 1) * {q} AS penalty FROM meta")
    return [f"meta AS (SELECT count(*) AS nn, {card} FROM {src} WHERE NOT ({allnull}))",
            "fams AS (" + " UNION ALL ".join(parts) + ")",
            "pens AS (" + " UNION ALL ".join(pens) + ")"]


def _structure_frame(spark, sf, train: bool = True):
    p = pipeline(spark, sf)
    return p.train if train else p.test


def _scored(spark, sf, families, train: bool = True):
    data = struct_ops.configurations(_structure_frame(spark, sf, train), VARS)
    return struct_ops.family_scores(data, struct_ops.cardinalities(data, VARS), VARS, families).drop("parents")


def _graph_scores(spark, sf, graphs, train: bool = True):
    data = struct_ops.configurations(_structure_frame(spark, sf, train), VARS)
    return struct_ops.graph_scores(data, struct_ops.cardinalities(data, VARS), VARS, graphs)


HAND_FAMS = [(c, sorted(ps)) for c, ps in HAND.items()]


@register("bic_family", sql(O.base() + [O.split_chrono(), "src AS (SELECT * FROM split WHERE is_train)"]
                            + _family_sql(HAND_FAMS, "src"), """
    SELECT f.fam, f.node, f.k, round(f.ll, 6) AS loglik, round(p.penalty, 6) AS penalty,
           round(f.ll - p.penalty, 6) AS bic FROM fams f JOIN pens p USING (fam)"""))
def q_bic_family(spark, sf):
    """G1: BIC of each family of the hand-made graph on the training split, in one job."""
    return _scored(spark, sf, HAND_FAMS)



@register("bic_graph", sql(O.base() + [O.split_chrono(), "src AS (SELECT * FROM split WHERE is_train)"]
                           + _family_sql(HAND_FAMS, "src"), f"""
    SELECT round(sum(f.ll - p.penalty), 6) AS bic, round(sum(f.ll), 6) AS loglik,
           {sum(len(v) for v in HAND.values())} AS n_edges FROM fams f JOIN pens p USING (fam)"""))
def q_bic_graph(spark, sf):
    """The graph score is the sum of its families."""
    return _graph_scores(spark, sf, {"handcrafted": HAND}).drop("graph")



FIRST_FAMS = [(t, []) for t in VARS] + [(t, [s]) for t in VARS for s in VARS if s != t]


@register("family_candidates", sql(O.base() + [O.split_chrono(), "src AS (SELECT * FROM split WHERE is_train)"]
                                   + _family_sql(FIRST_FAMS, "src"), """
    SELECT f.fam, f.node, f.k, round(f.ll, 6) AS loglik, round(p.penalty, 6) AS penalty,
           round(f.ll - p.penalty, 6) AS bic FROM fams f JOIN pens p USING (fam)"""))
def q_family_candidates(spark, sf):
    """Every family a first hill-climbing step can reach, in one job."""
    return _scored(spark, sf, FIRST_FAMS)



@register("test_fit_loglik", sql(O.base() + [O.split_chrono(), "src AS (SELECT * FROM split WHERE NOT is_train)"]
                                 + _family_sql(HAND_FAMS, "src"),
                                 "SELECT round(sum(ll), 6) AS test_loglik FROM fams"))
def q_test_fit_loglik(spark, sf):
    """Log-likelihood of the hand-made graph re-estimated on the test split
    (a fit measure, as the reference computes it)."""
    return _graph_scores(spark, sf, {"handcrafted": HAND}, train=False).select(F.col("loglik").alias("test_loglik"))



_LEARNED: dict = {}


def learned_graph(spark, sf, max_parents: int = 4):
    k = (spark.sparkContext.applicationId, sf, max_parents)
    if k not in _LEARNED:
        _LEARNED[k] = struct_ops.hill_climb(_structure_frame(spark, sf), VARS, max_parents)
    return _LEARNED[k]


@register("hill_climb")
def q_hill_climb(spark, sf):
    """G4 (+G5): learned edges; the search is a driver loop over per-iteration
    batched family scores."""
    res = learned_graph(spark, sf)
    return struct_ops.edge_frame(spark, res["graph"]).withColumn("score", F.lit(float(res["score"])))


@register("edge_diff")
def q_edge_diff(spark, sf):
    res = learned_graph(spark, sf)
    return struct_ops.edge_diff(struct_ops.edge_frame(spark, HAND),
                                struct_ops.edge_frame(spark, res["graph"]))


def _edge_diff_sql() -> str:
    hand = ", ".join(f"({sq(p)}, {sq(c)})" for c, ps in HAND.items() for p in ps)
    return sql(_cont_sql() + [
        f"hand(parent, child) AS (VALUES {hand})",
        f"dep AS (SELECT var_a AS parent, var_b AS child FROM ({_top_sql('deviation', 0.01, 20)}))"], """
      SELECT *, 'only_handcrafted' AS "where" FROM (SELECT * FROM hand EXCEPT SELECT * FROM dep)
      UNION ALL SELECT *, 'only_learned' FROM (SELECT * FROM dep EXCEPT SELECT * FROM hand)
      UNION ALL SELECT *, 'both' FROM (SELECT * FROM hand INTERSECT SELECT * FROM dep)""")


@register("edge_diff_dependencies", _edge_diff_sql())
def q_edge_diff_dependencies(spark, sf):
    """SET1: the hand-made edges against the table's strongest dependencies."""
    dep = assoc.top_dependencies(_stats(spark, sf), VARS, "deviation", 0.01, 20)
    return struct_ops.edge_diff(struct_ops.edge_frame(spark, HAND),
                                dep.select(F.col("var_a").alias("parent"), F.col("var_b").alias("child")))


@register("compare_structures")
def q_compare_structures(spark, sf):
    """Hand-made vs learned: train BIC, test-fit log-likelihood, edges."""
    graphs = {"handcrafted": HAND, "learned": learned_graph(spark, sf)["graph"]}
    fit = _graph_scores(spark, sf, graphs, train=False).select("graph", F.col("loglik").alias("test_loglik"))
    return _graph_scores(spark, sf, graphs).join(fit, "graph").select("graph", "bic", "test_loglik", "n_edges")



# ---------------------------------------------------------------------------
# Bootstrap intervals (M8) and baselines (B1, B2)
# ---------------------------------------------------------------------------
from bnlake.functions.scalar import sql_uniform  # noqa: E402
from bnlake.operators import baselines as base_ops  # noqa: E402
from bnlake.operators import bootstrap as boot  # noqa: E402

N_BOOT = 500
BOOT_METRICS = ["hit_1", "hit_3", "log_loss", "brier"]


def _boot_from(head: list[str], cols: list[str], n_boot: int = N_BOOT, seed: int = DEFAULT_SEED) -> str:
    """Intervals of the scores that ``head`` defines: draws counted by block of cases,
    then made anew within each block, as ``bootstrap.replicate_draws`` states them."""
    at, within = sql_uniform(str(seed), "b", "j"), sql_uniform(str(seed), "b", "k", "j2")
    means = ", ".join(f"sum(s.{m}) / CAST(any_value(d.nn) AS DOUBLE) AS {m}" for m in cols)
    qs = ", ".join(f"round(quantile_cont({m}, 0.025), 6) AS {m}_lo, round(quantile_cont({m}, 0.975), 6) AS {m}_hi" for m in cols)
    return sql(head + [
        f"sidx AS (SELECT *, row_number() OVER (ORDER BY {KEY}) - 1 AS idx FROM scores)",
        f"""shares AS (SELECT b, nn, CAST(floor({at} * nn) AS BIGINT) // {boot.BLOCK} AS k, count(*) AS c FROM (
              SELECT r.range // nn AS b, r.range % nn AS j, nn FROM
              (SELECT count(*) AS nn FROM scores) c, range(0, {n_boot} * (SELECT count(*) FROM scores)) r) GROUP BY ALL)""",
        "own AS (SELECT b, k, nn, unnest(range(1, c + 1)) AS j2 FROM shares)",
        f"""draws AS (SELECT b, nn, k * {boot.BLOCK} + CAST(floor({within} * least({boot.BLOCK}, nn - k * {boot.BLOCK})) AS BIGINT) AS idx
              FROM own)""",
        f"reps AS (SELECT d.b, {means} FROM draws d JOIN sidx s ON s.idx = d.idx GROUP BY d.b)"],
        f"SELECT {qs} FROM reps")


def _boot_sql(metrics_cols: list[str], n_boot: int = N_BOOT, seed: int = DEFAULT_SEED) -> str:
    return _boot_from(p_ctes(), metrics_cols, n_boot, seed)


@register("bootstrap_ci", _boot_sql(BOOT_METRICS))
def q_bootstrap_ci(spark, sf):
    sc = pipeline(spark, sf).scores("ex_ante")
    return boot.bootstrap_ci(sc, BOOT_METRICS, N_BOOT, DEFAULT_SEED, key=KEY)


def _baseline_sql(kind: str) -> str:
    ctes = O.base() + [O.split_chrono()] + [
        f"""freq AS (SELECT CAST({TARGET} AS VARCHAR) AS class, count(*) AS cnt,
              CAST(count(*) AS DOUBLE) / sum(count(*)) OVER () AS p,
              row_number() OVER (ORDER BY TRY_CAST(CAST({TARGET} AS VARCHAR) AS DOUBLE) NULLS LAST, CAST({TARGET} AS VARCHAR)) AS class_ord
             FROM split WHERE is_train AND {TARGET} IS NOT NULL GROUP BY 1)"""]
    if kind == "majority":
        ctes.append("""dist AS (SELECT class, CASE WHEN class = (SELECT class FROM freq ORDER BY cnt DESC, class_ord LIMIT 1)
                         THEN 0.99 ELSE 0.01 / greatest(1, (SELECT count(*) FROM freq) - 1) END AS p FROM freq)""")
    else:
        ctes.append("dist AS (SELECT class, p FROM freq)")
    return sql(ctes, f"SELECT s.{KEY}, d.class, round(d.p, 6) AS p FROM split s, dist d WHERE NOT s.is_train")


@register("baseline_marginal", _baseline_sql("marginal"))
def q_baseline_marginal(spark, sf):
    p = pipeline(spark, sf)
    return base_ops.baseline_marginal(p.train, p.test, TARGET, KEY)


@register("baseline_majority", _baseline_sql("majority"))
def q_baseline_majority(spark, sf):
    p = pipeline(spark, sf)
    return base_ops.baseline_majority(p.train, p.test, TARGET, KEY)


# ---------------------------------------------------------------------------
# Sampling engines
# ---------------------------------------------------------------------------
from bnlake.operators import sampling as samp  # noqa: E402

N_ANCESTRAL = 20000
N_LW = 1000
LW_COUNTS = (100, 500, 1000, 5000)


def _ofactors(spark, sf):
    p = pipeline(spark, sf)
    if "_of" not in p._post:
        p._post["_of"] = samp.draw_tables(p.factors_long, SPEC)
    return p._post["_of"]


def _samples(spark, sf):
    p = pipeline(spark, sf)
    if "_samples" not in p._post:
        from bnlake.session import keep
        p._post["_samples"] = keep(samp.ancestral_sample(spark, SPEC, _ofactors(spark, sf), p.doms,
                                                         N_ANCESTRAL, DEFAULT_SEED))
    return p._post["_samples"]


@register("ancestral_sample", sql(FACT + O.samples(N_ANCESTRAL, DEFAULT_SEED), "SELECT * FROM samples"))
def q_ancestral(spark, sf):
    return _samples(spark, sf)


def _drawn(spark, sf, track: str):
    """The drawn posteriors of one track at the counts of ``compare_engines``."""
    p = pipeline(spark, sf)
    if track == "ex_ante":
        return _lw(spark, sf)[N_LW]
    if "_lw_" + track not in p._post:
        p._post["_lw_" + track] = samp.posterior_likelihood_weighting(
            spark, SPEC, _ofactors(spark, sf), p.doms, p.evidence(track), SPEC.track(track), seed=DEFAULT_SEED,
            counts=(N_LW,))[N_LW]
    return p._post["_lw_" + track]


def _rejection_sql(ev_vars: list[str]) -> list[str]:
    on = " AND ".join(f"(d.{v} IS NULL OR s.{v} = d.{v})" for v in ev_vars)
    evl = ", ".join(ev_vars)
    ncls = f"(SELECT count(*) FROM domains WHERE node = {sq(SPEC.target)})"
    nullsafe = " AND ".join(f"e.{v} IS NOT DISTINCT FROM r.{v}" for v in ev_vars)
    return FACT + O.samples(N_ANCESTRAL, DEFAULT_SEED) + [O.evidence(ev_vars), f"""
      rj_cfg AS (SELECT DISTINCT {evl} FROM ev)""", f"""
      rj_acc AS (SELECT {', '.join('d.' + v for v in ev_vars)}, s.{SPEC.target} AS class, count(*) AS c
                 FROM rj_cfg d JOIN samples s ON {on} GROUP BY ALL)""", f"""
      rj AS (SELECT {evl}, class, CAST(c AS DOUBLE) / sum(c) OVER (PARTITION BY {evl}) AS p FROM rj_acc
             UNION ALL
             SELECT {', '.join('d.' + v for v in ev_vars)}, dd.value AS class, 1.0 / {ncls} AS p
             FROM rj_cfg d JOIN domains dd ON dd.node = {sq(SPEC.target)}
             WHERE NOT EXISTS (SELECT 1 FROM rj_acc a WHERE {' AND '.join(f'a.{v} IS NOT DISTINCT FROM d.{v}' for v in ev_vars)}))""", f"""
      rpost AS (SELECT e.{KEY}, r.class, CAST(dd.ord AS INTEGER) AS class_ord, r.p
                FROM ev e JOIN rj r ON {nullsafe}
                JOIN domains dd ON dd.node = {sq(SPEC.target)} AND dd.value = r.class)"""]


@register("posterior_rejection", sql(_rejection_sql(EXANTE), f"SELECT {KEY}, class, class_ord, round(p, 6) AS p FROM rpost"))
def q_rejection(spark, sf):
    p = pipeline(spark, sf)
    return samp.posterior_rejection(spark, SPEC, _samples(spark, sf), p.doms, p.evidence("ex_ante"), EXANTE)


def _lw(spark, sf, ev: DataFrame | None = None):
    """Drawn posteriors at each count, for the test cases or their stand-ins ``ev``; both
    have the same evidence rows, so the draws are made once."""
    p = pipeline(spark, sf)
    ev = p.evidence("ex_ante") if ev is None else ev
    if "_lw" not in p._post:
        p._post["_lw"] = samp.lw_tables(spark, SPEC, _ofactors(spark, sf), p.doms, ev, EXANTE, list(LW_COUNTS), DEFAULT_SEED)
    return samp.posterior_likelihood_weighting(spark, SPEC, _ofactors(spark, sf), p.doms, ev, EXANTE, seed=DEFAULT_SEED,
                                               counts=LW_COUNTS, tables=p._post["_lw"])


def _stand_ins(spark, sf):
    """Stand-ins of the test cases on the ex-ante track, and their exact posterior."""
    p = pipeline(spark, sf)
    if "_stand_ins" not in p._post:
        from bnlake.session import keep
        ev = keep(posterior.stand_ins(p.evidence("ex_ante"), EXANTE, p.doms, KEY))
        exact = keep(posterior.posterior_exact(spark, SPEC, p.factors, p.doms, ev, EXANTE))
        p._post["_stand_ins"] = ev, exact
    return p._post["_stand_ins"]


LW_CTES = FACT + [O.evidence(EXANTE)] + [O.cumulative()] + O.lw(EXANTE, max(LW_COUNTS), DEFAULT_SEED)[1:]


@register("posterior_likelihood_weighting", sql(LW_CTES + [O.lw_post(N_LW, "lwp")],
                                                f"SELECT {KEY}, class, class_ord, round(p, 6) AS p FROM lwp"))
def q_lw(spark, sf):
    return _lw(spark, sf)[N_LW]


def _conv_sql() -> str:
    ctes = LW_CTES + O.posterior(EXANTE) + [O.lw_post(c, f"lwp_{c}") for c in LW_COUNTS]
    parts = [f"""SELECT {c} AS n_samples, round(avg(tv), 6) AS tv FROM (
        SELECT coalesce(a.{KEY}, b.{KEY}) AS k, 0.5 * sum(abs(coalesce(a.p, 0.0) - coalesce(b.p, 0.0))) AS tv
        FROM post a FULL OUTER JOIN lwp_{c} b ON a.{KEY} = b.{KEY} AND a.class = b.class GROUP BY 1)"""
             for c in LW_COUNTS]
    return sql(ctes, " UNION ALL ".join(parts))


@register("sampler_convergence", _conv_sql())
def q_convergence(spark, sf):
    """Mean TV from the exact posterior at each sample count (one sample
    table at the largest count, filtered by sample id).  The posteriors are asked
    for the cases' stand-ins, and each counts for the cases that it stands for."""
    ev, exact = _stand_ins(spark, sf)
    return samp.sampler_convergence(exact, _lw(spark, sf, ev), KEY, posterior.stands_for(KEY)).select("n_samples", "tv")


def _compare_engines(spark, sf, track: str, gibbs: bool = True):
    from functools import reduce as _r

    from bnlake.session import keep
    p = pipeline(spark, sf)
    ev, ev_vars = p.evidence(track), SPEC.track(track)
    exact = p.posterior(track)
    engines = {"exact": exact,
               "rejection": samp.posterior_rejection(spark, SPEC, _samples(spark, sf), p.doms, ev, ev_vars),
               "likelihood_weighting": _drawn(spark, sf, track)}
    if gibbs:
        engines["gibbs"] = samp.posterior_gibbs(spark, SPEC, p.factors_long, p.doms, ev, ev_vars, n=1000,
                                                burn_in=500, seed=DEFAULT_SEED)
    rows = []
    for name, post in engines.items():
        post = post if name == "exact" else keep(post)
        P = metrics.predict_distributions(post, p.truth(), KEY)
        acc = metrics.topk_accuracy(metrics.case_scores(P, KEY), (3,))
        tv = posterior.tv_distance(exact, post, KEY).agg(F.avg("tv").alias("value"))
        rows.append(acc.select(F.lit(name).alias("engine"), F.lit("top_3").alias("metric"),
                               F.col("top_3").alias("value")))
        rows.append(tv.select(F.lit(name).alias("engine"), F.lit("tv_from_exact").alias("metric"), "value"))
    return _r(DataFrame.unionByName, rows)


@register("compare_engines")
def q_compare_engines(spark, sf):
    """Top-3 accuracy and mean TV from exact, per engine (time is left to
    the benchmark, not the table)."""
    return _compare_engines(spark, sf, "ex_ante")


@register("compare_engines_explanatory")
def q_compare_engines_expl(spark, sf):
    """I14 on the explanatory track, the published setting, all four engines."""
    return _compare_engines(spark, sf, "explanatory")


def _engine_tail(prefix: str, post: str) -> list[str]:
    """The P matrix and the scores of one engine's posterior, under its own names."""
    import re
    out = [re.sub(r"\b(classes|pm|pmat|sc|scores)\b", rf"{prefix}_\1", c) for c in p_tail()]
    return [re.sub(r"\bpost\b", post, c) for c in out]


def _compare_sql(track: str = "ex_ante") -> str:
    engines = {"exact": "post", "rejection": "rpost", "likelihood_weighting": "lwp"}
    ev_vars = SPEC.track(track)
    drawn = LW_CTES if track == "ex_ante" else \
        FACT + [O.evidence(ev_vars)] + [O.cumulative()] + O.lw(ev_vars, N_LW, DEFAULT_SEED)[1:]
    rej = [c for c in _rejection_sql(ev_vars) if c not in drawn]
    # rejection and likelihood weighting share the cumulative tables
    have = {c.split(" AS ", 1)[0].strip() for c in drawn}
    rej = [c for c in rej if c.split(" AS ", 1)[0].strip() not in have]
    ctes = drawn + [O.lw_post(N_LW, "lwp")] + rej + O.posterior(ev_vars)
    parts = []
    for name, post in engines.items():
        ctes = ctes + _engine_tail(f"e_{post}", post)
        parts.append(f"SELECT {sq(name)} AS engine, 'top_3' AS metric, round(avg(hit_3), 6) AS value FROM e_{post}_scores")
        parts.append(f"""SELECT {sq(name)}, 'tv_from_exact', round(avg(tv), 6) FROM (
            SELECT coalesce(a.{KEY}, b.{KEY}) AS k, 0.5 * sum(abs(coalesce(a.p, 0.0) - coalesce(b.p, 0.0))) AS tv
            FROM post a FULL OUTER JOIN {post} b ON a.{KEY} = b.{KEY} AND a.class = b.class GROUP BY 1)""")
    return sql(ctes, " UNION ALL ".join(parts))


@register("compare_engines_drawn", _compare_sql())
def q_compare_engines_drawn(spark, sf):
    """I14 for the engines whose draws SQL can repeat."""
    return _compare_engines(spark, sf, "ex_ante", gibbs=False)


@register("compare_engines_explanatory_drawn", _compare_sql("explanatory"))
def q_compare_engines_expl_drawn(spark, sf):
    """The same on the explanatory track."""
    return _compare_engines(spark, sf, "explanatory", gibbs=False)


@register("hill_climb_property")
def q_hill_climb_property(spark, sf):
    """G4 as a property of the data: no legal move improves the learned graph's
    BIC, and the search's score is the sum of its families' scores."""
    res = learned_graph(spark, sf)
    dag = struct_ops.Dag(VARS, {v: tuple(ps) for v, ps in res["graph"].items()})
    graphs = {f"m{i}": dag.with_parents(m.after).parents for i, m in enumerate(dag.moves(4))}
    scores = _graph_scores(spark, sf, {"learned": dag.parents, **graphs})
    found = F.max(F.when(F.col("graph") == "learned", F.col("bic")))
    best = F.max(F.when(F.col("graph") != "learned", F.col("bic")))
    return scores.agg((F.coalesce(best, found) <= found + 1e-6).alias("no_better_move"),
                      (F.abs(found - F.lit(float(res["history"][-1]))) < 1e-6).alias("scores_agree"),
                      (F.count("*") > 0).alias("has_rows"))


def _first_step_sql() -> str:
    gains = ["""SELECT least(f.node, s.node) AS var_a, greatest(f.node, s.node) AS var_b,
                   (f.ll - pf.penalty) - (e.ll - pe.penalty) AS gain
                FROM fams f JOIN pens pf USING (fam) JOIN src_of s USING (fam)
                JOIN fams e ON e.node = f.node AND e.k = 0 JOIN pens pe ON pe.fam = e.fam WHERE f.k = 1"""]
    parents = ", ".join(f"({i}, {sq(ps[0])})" for i, (_, ps) in enumerate(FIRST_FAMS) if ps)
    return sql(O.base() + [O.split_chrono(), "src AS (SELECT * FROM split WHERE is_train)"]
               + _family_sql(FIRST_FAMS, "src")
               + [f"src_of(fam, node) AS (VALUES {parents})", f"gains AS ({gains[0]})",
                  "start AS (SELECT sum(f.ll - p.penalty) AS bic FROM fams f JOIN pens p USING (fam) WHERE f.k = 0)"],
               """SELECT round(max(start.bic), 6) AS start_bic, round(greatest(max(gain), 0.0), 6) AS gain,
                    max(gain) > 1e-10 AS moved, count(*) AS n_moves FROM gains, start""")


@register("hill_climb_first_step", _first_step_sql())
def q_hill_climb_first_step(spark, sf):
    """G4's start and first step against all single edges scored in SQL."""
    res = struct_ops.hill_climb(_structure_frame(spark, sf), VARS, 4, max_iterations=1)
    step = res["history"][-1] - res["history"][0]
    n = len(struct_ops.Dag(VARS).moves(4))
    rows = _structure_frame(spark, sf).agg(F.count("*").alias("rows"))
    return rows.select(F.lit(float(res["history"][0])).alias("start_bic"), F.lit(float(step)).alias("gain"),
                       F.lit(res["iterations"] > 0).alias("moved"), F.lit(n).cast("long").alias("n_moves"))


@register("gibbs_property")
def q_gibbs_property(spark, sf):
    """I10 as a property: mean total variation from the exact posterior below 0.05."""
    p = pipeline(spark, sf)
    tv = posterior.tv_distance(p.posterior("ex_ante"), q_gibbs(spark, sf), KEY)
    return tv.agg((F.avg("tv") < 0.05).alias("near_exact"), (F.count("*") > 0).alias("has_rows"))


# ---------------------------------------------------------------------------
# Results table and verdict (M10, M11), saved models
# ---------------------------------------------------------------------------
from bnlake.sources import model_store as store  # noqa: E402
from bnlake.spec import NODE_DESCRIPTIONS  # noqa: E402

SUMMARY_COLS = ["n_test", "n_classes", "top_1", "top_3", "top_5", "log_loss", "brier",
                "macro_auc", "ece", "macro_f1"]
SUMMARY_SEL = """SELECT (SELECT count(*) FROM scores) AS n_test,
             (SELECT count(DISTINCT class) FROM pmat) AS n_classes,
             round((SELECT avg(hit_1) FROM scores), 6) AS top_1,
             round(CASE WHEN (SELECT count(*) FROM classes) >= 3 THEN (SELECT avg(hit_3) FROM scores) END, 6) AS top_3,
             round(CASE WHEN (SELECT count(*) FROM classes) >= 5 THEN (SELECT avg(hit_5) FROM scores) END, 6) AS top_5,
             round((SELECT avg(log_loss) FROM scores), 6) AS log_loss,
             round((SELECT avg(brier) FROM scores), 6) AS brier,
             round((SELECT macro_auc FROM auc), 6) AS macro_auc,
             round((SELECT ece FROM ece_t), 6) AS ece,
             round((SELECT coalesce(avg(f1), 0.0) FROM prf1 WHERE support > 0), 6) AS macro_f1"""


def _baseline_post_ctes(kind: str, track: str) -> list[str]:
    """Baseline posterior for the test cases as ``post``, truth as ``ev``."""
    ctes = O.base() + [O.split_chrono()] + [
        f"""freq AS (SELECT CAST({TARGET} AS VARCHAR) AS class, count(*) AS cnt,
              CAST(count(*) AS DOUBLE) / sum(count(*)) OVER () AS p,
              row_number() OVER (ORDER BY TRY_CAST(CAST({TARGET} AS VARCHAR) AS DOUBLE) NULLS LAST, CAST({TARGET} AS VARCHAR)) AS class_ord
             FROM split WHERE is_train AND {TARGET} IS NOT NULL GROUP BY 1)"""]
    if kind == "majority":
        ctes.append("""dist AS (SELECT class, CASE WHEN class = (SELECT class FROM freq ORDER BY cnt DESC, class_ord LIMIT 1)
                         THEN 0.99 ELSE 0.01 / greatest(1, (SELECT count(*) FROM freq) - 1) END AS p FROM freq)""")
    else:
        ctes.append("dist AS (SELECT class, p FROM freq)")
    ctes.append(f"ev AS (SELECT {KEY}, CAST({TARGET} AS VARCHAR) AS y_true FROM split WHERE NOT is_train)")
    ctes.append(f"post AS (SELECT s.{KEY}, d.class, d.p FROM split s, dist d WHERE NOT s.is_train)")
    return ctes


def _results_sql() -> str:
    parts = []
    for model in ("network", "marginal", "majority"):
        for track in ("explanatory", "ex_ante"):
            head = p_ctes(track) if model == "network" else _baseline_post_ctes(model, track) + p_tail()
            q = sql(head + [AUC_SQL, ECE_SQL, PRF_SQL], SUMMARY_SEL)
            parts.append(f"SELECT {sq(model)} AS model, {sq(track)} AS track, * FROM ({q})")
    return " UNION ALL ".join(parts)


#: Baselines that read no evidence: the same on every track.
TRACKLESS = ("marginal", "majority")


def _results(spark, sf):
    """A row for each model and track. Each row is stored by itself: one plan of all of them
    would be planned anew, whole, on the driver after every of its stages."""
    p = pipeline(spark, sf)
    if "_results" not in p._post:
        from functools import reduce as _r

        from bnlake.session import keep
        rows, kept = [], {}
        for model in MODELS:
            for track in ("explanatory", "ex_ante"):
                at = (model, None if model in TRACKLESS else track)
                if at not in kept:
                    kept[at] = keep(metrics.summary_row(_matrix(spark, sf, model, track), KEY))
                rows.append(kept[at].select(F.lit(model).alias("model"), F.lit(track).alias("track"), *SUMMARY_COLS))
        p._post["_results"] = keep(_r(DataFrame.unionByName, rows))
    return p._post["_results"]


def _matrix(spark, sf, model: str, track: str) -> DataFrame:
    """A model's stored matrix on a track."""
    from bnlake.session import keep
    p = pipeline(spark, sf)
    if model == "network":
        return p.matrix(track)
    cols = [SPEC.column(v) for v in SPEC.track(track)]
    fits = {"marginal": lambda: base_ops.baseline_marginal(p.train, p.test, TARGET, KEY),
            "majority": lambda: base_ops.baseline_majority(p.train, p.test, TARGET, KEY),
            "logistic": lambda: keep(base_ops.baseline_logreg(p.train, p.test, cols, TARGET, KEY)),
            "boosting": lambda: keep(base_ops.baseline_gbt(p.train, p.test, cols, TARGET, KEY))}
    name = f"_matrix_{model}" + ("" if model in TRACKLESS else f"_{track}")
    if name not in p._post:
        p._post[name] = keep(metrics.predict_distributions(fits[model](), p.truth(), KEY))
    return p._post[name]


def _scores(spark, sf, model: str, track: str) -> DataFrame:
    """The score of each case under a model on a track, stored."""
    from bnlake.session import keep
    p = pipeline(spark, sf)
    if model == "network":
        return p.scores(track)
    name = f"_scores_{model}" + ("" if model in TRACKLESS else f"_{track}")
    if name not in p._post:
        p._post[name] = keep(metrics.case_scores(_matrix(spark, sf, model, track), KEY))
    return p._post[name]


@register("results_table", _results_sql())
def q_results_table(spark, sf):
    """Every model on both evidence tracks, one row each."""
    return _results(spark, sf)


@register("track_verdict", f"""WITH r AS ({_results_sql()})
    SELECT n.track, round(n.top_3 - m.top_3, 6) AS delta_top_3, round(n.log_loss - m.log_loss, 6) AS delta_log_loss,
           n.log_loss < m.log_loss AS network_log_loss_better
    FROM r n JOIN r m ON m.track = n.track AND m.model = 'marginal' WHERE n.model = 'network'""")
def q_track_verdict(spark, sf):
    """Network against the marginal baseline, per track (self-join on track)."""
    r = round_doubles(_results(spark, sf))      # deltas of the reported (rounded) values
    n = r.filter(F.col("model") == "network").alias("n")
    m = r.filter(F.col("model") == "marginal").alias("m")
    return n.join(m, "track").select(
        "track", (F.col("n.top_3") - F.col("m.top_3")).alias("delta_top_3"),
        (F.col("n.log_loss") - F.col("m.log_loss")).alias("delta_log_loss"),
        (F.col("n.log_loss") < F.col("m.log_loss")).alias("network_log_loss_better"))


def _stored_model(spark, sf):
    p = pipeline(spark, sf)
    if "_stored" not in p._post:
        path = store.scratch_path(spark, "model")
        store.write_model(p.cpt, p.domain_df,
                          {"alpha": p.alpha, "backoff": p.backoff, "equivalent_sample_size": p.m,
                           "parents": {n: SPEC.parents(n) for n in SPEC.names},
                           "split": {"kind": "chronological", "order_col": SPEC.order_col,
                                     "test_fraction": 0.2}}, path)
        p._post["_stored"] = path
    return p._post["_stored"]


@register("cpt_write", sql(FIT, "SELECT node, count(*) AS n_rows, CAST(sum(n) AS BIGINT) AS n_total FROM cpt GROUP BY node"))
def q_cpt_write(spark, sf):
    """S3: the stored CPT, partitioned by node, read back as per-node row counts."""
    path = _stored_model(spark, sf)
    return spark.read.parquet(f"{path}/cpt").groupBy("node").agg(
        F.count(F.lit(1)).alias("n_rows"), F.sum("n").cast("long").alias("n_total"))


@register("cpt_roundtrip", sql(FIT, CPT_SELECT))
def q_cpt_roundtrip(spark, sf):
    """The model read back equals the fitted one (value order re-derived)."""
    cpt, _dom, _meta = store.read_model(spark, _stored_model(spark, sf), SPEC.max_parents)
    return cpt


@register("scan_cases_csv", sql(O.base()[:1], f"SELECT {RAW_COLS} FROM raw_cases"))
def q_scan_cases_csv(spark, sf):
    """The case table written as a latin-1 header CSV and scanned back with
    a declared schema."""
    p = pipeline(spark, sf)
    if "_csv" not in p._post:
        path = store.scratch_path(spark, "cases-csv")
        store.write_cases_csv(p.raw, path)
        p._post["_csv"] = path
    return store.scan_cases_csv(spark, p._post["_csv"])


@register("pick_release", sql(O.base()[:1], f"SELECT {RAW_COLS} FROM raw_cases"))
def q_pick_release(spark, sf):
    """Two releases on disk (an older partial one, a newer full one); the
    newest by file name is picked and scanned."""
    p = pipeline(spark, sf)
    if "_rel" not in p._post:
        folder = store.scratch_path(spark, "releases")
        # a release is a file or a folder of files under its name
        for tag, df in (("2023_01", p.raw.filter(F.col("term") <= 1998)), ("2024_01", p.raw)):
            store.write_cases_csv(df, f"{folder}/SCDB_{tag}_caseCentered_Citation.csv")
        p._post["_rel"] = folder
    return store.scan_cases_csv(spark, store.pick_release(spark, p._post["_rel"]))


def _schema_sql() -> str:
    fields = EXPL
    ex = set(EXANTE)
    vals = ", ".join(f"({sq(f)}, {sq(NODE_DESCRIPTIONS.get(f, ''))}, {str(f in ex).upper()})" for f in fields)
    return sql(FIT + [f"meta_f AS (SELECT * FROM (VALUES {vals}) t(node, description, ex_ante))"], """
      SELECT d.node AS field, m.description, m.ex_ante, d.value, d.ord, d.value AS label
      FROM domains d JOIN meta_f m ON m.node = d.node""")


@register("schema_report", _schema_sql())
def q_schema_report(spark, sf):
    """Every explanatory field with its observed values, in order."""
    p = pipeline(spark, sf)
    return store.schema_report(p.domain_df, SPEC, descriptions=NODE_DESCRIPTIONS)


@register("eval_saved_model", f"SELECT 'explanatory' AS track, * FROM ({_summary_sql('explanatory')}) "
                              f"UNION ALL SELECT 'ex_ante' AS track, * FROM ({_summary_sql('ex_ante')})")
def q_eval_saved_model(spark, sf):
    """Load the stored model, re-split by its stored spec, score per track."""
    from bnlake.operators import cpt as _c
    path = _stored_model(spark, sf)
    cpt, dom, meta = store.read_model(spark, path, SPEC.max_parents)
    p = pipeline(spark, sf)
    how = meta["split"]
    if how["kind"] == "chronological":
        parted = split.split_chrono(p.cases, how["order_col"], KEY, how["test_fraction"])
    else:
        parted = split.split_random(p.cases, KEY, how["test_fraction"], how["seed"])
    from bnlake.session import keep
    test = keep(parted.filter(~F.col("is_train")))
    doms = _c.collect_domains(dom)
    card = _c.domain_card(dom)
    fl = _c.factor_long(spark, cpt, card, SPEC, doms, meta["alpha"])
    facs = posterior.network_factors(fl, SPEC, doms)
    rows = []
    for track in ("explanatory", "ex_ante"):
        post = keep(posterior.posterior_exact(spark, SPEC, facs, doms, p.evidence(track, test), SPEC.track(track)))
        P = keep(metrics.predict_distributions(post, truth_of(test, SPEC), KEY))
        rows.append(keep(metrics.summary_row(P, KEY)).select(F.lit(track).alias("track"), *SUMMARY_COLS))
    return rows[0].unionByName(rows[1])


# ---------------------------------------------------------------------------
# Requests (P7, P8, I6, M13, P11)
# ---------------------------------------------------------------------------
IGNORED_SORTED = sorted([v for v in EXPL if v not in EXANTE] + ["not_a_field"])


def _requests(spark, sf):
    """Requests derived from the test cases: a map of every explanatory field
    (null where unobserved), plus an unknown key in every second request."""
    p = pipeline(spark, sf)
    ev = p.evidence("explanatory")
    kv = []
    for v in EXPL:
        kv += [F.lit(v), F.col(v)]
    kv += [F.lit("not_a_field"), F.lit("x")]
    known = F.map_filter(F.create_map(*kv), lambda k, v: (k != "not_a_field") | (F.col(KEY) % 2 == 0))
    return ev.select(F.col(KEY).alias("request_id"), known.alias("evidence"))


@register("evidence_project", sql(FACT + [O.evidence(EXANTE)], f"SELECT {KEY}, {', '.join(EXANTE)}, y_true FROM ev"))
def q_evidence_project(spark, sf):
    from bnlake.operators.posterior import clean_evidence
    p = pipeline(spark, sf)
    return clean_evidence(p.evidence("ex_ante"), EXANTE, p.doms)


def _ignored_sql() -> str:
    """Every key that isn't allowed is reported, with or without a value."""
    every = ",".join(k for k in IGNORED_SORTED if k != "not_a_field")
    return f"CASE WHEN {KEY} % 2 = 0 THEN {sq(','.join(IGNORED_SORTED))} ELSE {sq(every)} END"


@register("evidence_filter", sql(O.base() + [O.split_chrono()], f"""
    SELECT {KEY} AS request_id, {_ignored_sql()} AS ignored, {len(EXANTE)} AS n_kept
    FROM split WHERE NOT is_train"""))
def q_evidence_filter(spark, sf):
    r = prep.evidence_filter(_requests(spark, sf), EXANTE)
    return r.select("request_id", F.array_join("ignored", ",").alias("ignored"),
                    F.size(F.map_keys("kept")).alias("n_kept"))


def _score_requests(spark, sf):
    p = pipeline(spark, sf)
    r = prep.evidence_filter(_requests(spark, sf), EXANTE)
    ev = r.select(F.col("request_id").alias(KEY), *[F.col("kept")[v].alias(v) for v in EXANTE],
                  F.array_join("ignored", ",").alias("ignored"))
    post = posterior.posterior_exact(spark, SPEC, p.factors, p.doms, ev, EXANTE)
    post = posterior.rank_posterior(post.withColumn("p", F.round("p", 12)), KEY)
    lab = prep.label_values(post, "class", prep.label_table(spark))
    b = binary_target(F.col("class"))
    summ = post.groupBy(KEY).agg(
        F.sum(F.when(b == 1, F.col("p")).otherwise(0.0)).alias("_rev"),
        F.sum(F.when(b.isNotNull(), F.col("p")).otherwise(0.0)).alias("_tot"))
    summ = summ.select(KEY, F.when(F.col("_tot") > 0, F.col("_rev") / F.col("_tot")).alias("p_reverse"))
    return lab.join(summ, KEY).join(ev.select(KEY, "ignored"), KEY).select(
        F.col(KEY).alias("request_id"), "rank", "class", "label", "p", "ignored", "p_reverse")


def _requests_sql() -> str:
    bt = sql_binary_target("class")
    return sql(p_ctes() + [_labels_sql(), RANK_SQL], f"""
      SELECT r.{KEY} AS request_id, r.rank, r.class, coalesce(l.label, r.class) AS label, round(r.p, 6) AS p,
             (SELECT {_ignored_sql()} FROM split s WHERE s.{KEY} = r.{KEY}) AS ignored,
             round((SELECT CASE WHEN sum(CASE WHEN {bt} IS NOT NULL THEN x.p ELSE 0 END) > 0
                    THEN sum(CASE WHEN {bt} = 1 THEN x.p ELSE 0 END) / sum(CASE WHEN {bt} IS NOT NULL THEN x.p ELSE 0 END) END
                    FROM post x WHERE x.{KEY} = r.{KEY}), 6) AS p_reverse
      FROM ranked r LEFT JOIN labels_t l ON l.code = r.class""")


@register("score_requests", _requests_sql())
def q_score_requests(spark, sf):
    """Requests -> allowed evidence -> exact posterior -> ranked, labelled
    distribution with ignored keys and the affirm/reverse summary."""
    return _score_requests(spark, sf)


@register("posterior_summary", sql(p_ctes("explanatory") + [_labels_sql(), RANK_SQL], f"""
    SELECT r.{KEY}, r.rank, r.class, coalesce(l.label, r.class) AS label, round(r.p, 6) AS p
    FROM ranked r LEFT JOIN labels_t l ON l.code = r.class"""))
def q_posterior_summary(spark, sf):
    """Each case's labelled distribution, most probable first."""
    post = pipeline(spark, sf).posterior("explanatory").withColumn("p", F.round("p", 12))
    r = prep.label_values(posterior.rank_posterior(post, KEY), "class", prep.label_table(spark))
    return r.select(KEY, "rank", "class", "label", "p")


# ---------------------------------------------------------------------------
# Factor algebra on the fitted factors
# ---------------------------------------------------------------------------
@register("factor_product", sql(FACT, """
    SELECT a.pa1 AS issue_area, a.pa2 AS law_type, a.value AS decision_type, b.value AS split_vote,
           round(a.p * b.p, 6) AS w
    FROM factors a JOIN factors b ON a.node = 'decision_type' AND b.node = 'split_vote'
     AND b.pa1 = a.pa1 AND b.pa2 = a.pa2"""))
def q_factor_product(spark, sf):
    """phi(decision_type | issue, law) x phi(split_vote | issue, law), joined
    on the shared variables."""
    f = pipeline(spark, sf).factors
    return f["decision_type"].multiply(f["split_vote"]).df


@register("factor_sum_out", sql(FACT, """
    SELECT a.pa1 AS issue_area, a.pa2 AS law_type, b.value AS split_vote, round(sum(a.p * b.p), 6) AS w
    FROM factors a JOIN factors b ON a.node = 'decision_type' AND b.node = 'split_vote'
     AND b.pa1 = a.pa1 AND b.pa2 = a.pa2 GROUP BY 1, 2, 3"""))
def q_factor_sum_out(spark, sf):
    """Sum decision_type out of the product above."""
    f = pipeline(spark, sf).factors
    return f["decision_type"].multiply(f["split_vote"]).sum_out("decision_type").df


@register("factor_reduce", sql(FACT + [O.evidence(EXANTE)], f"""
    SELECT e.issue_area, e.law_type, f.value AS decision_type, round(f.p, 6) AS w
    FROM (SELECT DISTINCT issue_area, law_type FROM ev WHERE issue_area IS NOT NULL AND law_type IS NOT NULL) e
    JOIN factors f ON f.node = 'decision_type' AND f.pa1 = e.issue_area AND f.pa2 = e.law_type"""))
def q_factor_reduce(spark, sf):
    """J4 in batch: the decision_type factor sliced by every distinct observed
    (issue, law) evidence pair of the test cases (an equi-join)."""
    from bnlake.operators.posterior import clean_evidence
    p = pipeline(spark, sf)
    ev = clean_evidence(p.evidence("ex_ante"), EXANTE, p.doms).select("issue_area", "law_type") \
        .dropna().distinct()
    return ev.join(p.factors["decision_type"].df, ["issue_area", "law_type"]) \
             .select("issue_area", "law_type", "decision_type", "w")


@register("denominator_align", sql(FIT, f"""
    SELECT pa1, pa2, pa3, pa4, pa5, value, n, CAST(sum(n) OVER (PARTITION BY pa1, pa2, pa3, pa4, pa5) AS BIGINT) AS n_pa
    FROM counts WHERE node = {sq(SPEC.target)} AND depth = 5"""))
def q_denominator_align(spark, sf):
    """Each joint count N(x, pa) beside its parent total N(pa) -- a window,
    no join."""
    from pyspark.sql import Window as _W
    c = pipeline(spark, sf).counts.filter((F.col("node") == SPEC.target) & (F.col("depth") == 5))
    pas = [f"pa{i}" for i in range(1, 6)]
    return c.select(*pas, "value", "n", F.sum("n").over(_W.partitionBy(*pas)).cast("long").alias("n_pa"))


# ---------------------------------------------------------------------------
# Discriminative baselines (B3-B6) -- rows-only: Spark ML optimisers differ from
# any SQL form
# ---------------------------------------------------------------------------
FEATURES_EXPL = [SPEC.column(v) for v in EXPL]


@register("onehot_features")
def q_onehot(spark, sf):
    from pyspark.ml.functions import vector_to_array
    p = pipeline(spark, sf)
    tr, te, _labels = base_ops.onehot_features(p.train, p.test, FEATURES_EXPL, TARGET)
    return te.select(KEY, F.size(vector_to_array("features")).alias("width"),
                     F.aggregate(vector_to_array("features"), F.lit(0.0), lambda a, x: a + x).alias("ones"))


@register("baseline_logreg")
def q_logreg(spark, sf):
    p = pipeline(spark, sf)
    return base_ops.baseline_logreg(p.train, p.test, FEATURES_EXPL, TARGET, KEY, max_iter=1000)


@register("baseline_gbt")
def q_gbt(spark, sf):
    p = pipeline(spark, sf)
    return base_ops.baseline_gbt(p.train, p.test, FEATURES_EXPL, TARGET, KEY)


@register("baseline_set")
def q_baseline_set(spark, sf):
    p = pipeline(spark, sf)
    return base_ops.baseline_set(p.train, p.test, FEATURES_EXPL, TARGET, KEY)


# ---------------------------------------------------------------------------
# Cross-validation (M12) and streaming (ST1-ST3)
# ---------------------------------------------------------------------------
from bnlake.operators import crossval  # noqa: E402
from bnlake.streaming import score as streaming  # noqa: E402


@register("cross_validate")
def q_cross_validate(spark, sf):
    """5-fold CV of top-3 accuracy (exact engine, all evidence), counts
    from a single pass; checked against per-fold refits in the tests."""
    return crossval.cross_validate(spark, pipeline(spark, sf).cases, SPEC, k=5, topk=3,
                                   track="explanatory", seed=DEFAULT_SEED)


def _gappy(ev: DataFrame, ev_vars: list[str]) -> DataFrame:
    """Evidence with gaps by a rule: some values unobserved, some unknown codes."""
    cols = [F.when((F.col(KEY) + i) % 7 == 0, None).when((F.col(KEY) + i) % 11 == 0, "unknown code")
            .otherwise(F.col(v)).alias(v) for i, v in enumerate(ev_vars)]
    return ev.select(KEY, *cols)


def _gappy_post(ev_vars: list[str]) -> list[str]:
    cols = ", ".join(f"CASE WHEN ({KEY} + {i}) % 7 = 0 OR ({KEY} + {i}) % 11 = 0 THEN NULL ELSE {v} END AS {v}"
                     for i, v in enumerate(ev_vars))
    return FACT + [O.evidence(ev_vars, name="whole_ev"), f"ev AS (SELECT {KEY}, y_true, {cols} FROM whole_ev)"] + \
        O.posterior(ev_vars)


@register("posterior_exact_gaps", sql(_gappy_post(EXPL), POST_SEL))
def q_posterior_exact_gaps(spark, sf):
    """I2 on evidence with more null patterns than one job's plans hold."""
    p = pipeline(spark, sf)
    return posterior.posterior_exact(spark, SPEC, p.factors, p.doms, _gappy(p.evidence("explanatory"), EXPL), EXPL)


def _streamed(spark, sf, ev: DataFrame) -> DataFrame:
    p = pipeline(spark, sf)
    src = store.scratch_path(spark, "stream-cases")
    ev.repartition(4).write.parquet(src)
    return streaming.stream_score(spark, src, spark.read.parquet(src).schema, SPEC, p.factors, p.doms, EXANTE, KEY)


@register("stream_score", sql(post_ctes("ex_ante"), POST_SEL))
def q_stream_score(spark, sf):
    """ST1: test cases arrive as files; each micro-batch is scored exactly."""
    return _streamed(spark, sf, pipeline(spark, sf).evidence("ex_ante"))


@register("stream_score_gaps", sql(_gappy_post(EXANTE), POST_SEL))
def q_stream_score_gaps(spark, sf):
    """ST1 with unobserved and unknown values: every row is answered."""
    return _streamed(spark, sf, _gappy(pipeline(spark, sf).evidence("ex_ante"), EXANTE))


@register("stream_counts", sql(FIT, f"SELECT node, depth, {PAS}, value, CAST(n AS BIGINT) AS n FROM counts"))
def q_stream_counts(spark, sf):
    """ST2: training rows arrive in several files; per-batch counts summed
    equal the batch counts."""
    p = pipeline(spark, sf)
    src = store.scratch_path(spark, "stream-nodes")
    p.nodes.repartition(4).write.parquet(src)
    schema = spark.read.parquet(src).schema
    return streaming.stream_counts(spark, src, schema, SPEC)


EVENT_MODEL_UNTIL = "2024-01-08 00:00:00"


@register("stream_windowed_logloss", f"""
    WITH model AS (SELECT event_type, CAST(count(*) AS DOUBLE) / sum(count(*)) OVER () AS p
                   FROM events WHERE ts < TIMESTAMP '{EVENT_MODEL_UNTIL}' GROUP BY 1)
    SELECT date_trunc('hour', e.ts) AS window_start, date_trunc('hour', e.ts) + INTERVAL 1 HOUR AS window_end,
           count(*) AS n, round(avg(-ln(greatest(least(coalesce(m.p, 0.0), 1.0), 1e-12))), 6) AS log_loss
    FROM events e LEFT JOIN model m ON m.event_type = e.event_type GROUP BY 1, 2""")
def q_stream_windowed_logloss(spark, sf):
    """ST3: drift monitor -- hourly log-loss of event types against the first
    week's distribution, watermark one hour."""
    from bnlake.sources.tables import read_table
    ev = read_table(spark, sf, "events", "ts", "event_type")
    model = streaming.marginal_model(ev, "event_type", EVENT_MODEL_UNTIL)
    src = store.scratch_path(spark, "stream-events")
    ev.repartitionByRange(4, "ts").write.parquet(src)
    schema = spark.read.parquet(src).schema
    return streaming.stream_windowed_logloss(spark, src, schema, model, "event_type")


@register("posterior_gibbs")
def q_gibbs(spark, sf):
    """Gibbs chains per distinct ex-ante evidence row (burn-in 500, 1000
    sweeps), vectorised across the chains of each task."""
    p = pipeline(spark, sf)
    return samp.posterior_gibbs(spark, SPEC, p.factors_long, p.doms, p.evidence("ex_ante"), EXANTE,
                                n=1000, burn_in=500, seed=DEFAULT_SEED)


# ---------------------------------------------------------------------------
# Second network: documents left-joined to labels (missing labels exercise
# P3/P4/A1); plot-ready comparison table
# ---------------------------------------------------------------------------
DSPEC = DOCS.spec
DKEY = DSPEC.key
DFIT = [*DOCS.base(), DOCS.split_chrono(), *DOCS.fit(DOCS.nodes())]
DFACT = DFIT + [DOCS.factors()]
DTRACK = DSPEC.track("text_only")
DPOST = DFACT + [DOCS.evidence(DTRACK)] + DOCS.posterior(DTRACK)
DRAW = "doc_id, lang, source, len_bucket, toxic, quality"


@register("prepare_docs", sql(DOCS.base(), f"SELECT {DRAW} FROM prepared"))
def q_prepare_docs(spark, sf):
    return pipeline(spark, sf, "docs").cases


@register("missing_report_docs", sql(DOCS.base()[:2], " UNION ALL ".join(
    f"SELECT {i} AS pos, {sq(n.name)} AS variable, {sq(n.column)} AS \"column\", "
    f"CAST(sum(CAST({n.column} IS NULL AS INTEGER)) AS BIGINT) AS n_missing, "
    f"round(100.0 * sum(CAST({n.column} IS NULL AS INTEGER)) / count(*), 2) AS pct_missing FROM derived"
    for i, n in enumerate(DSPEC.nodes))))
def q_missing_docs(spark, sf):
    return prep.missing_report(pipeline(spark, sf, "docs").raw, DSPEC)


@register("fit_network_docs", sql(DFIT, CPT_SELECT.replace(PAS, ", ".join(f"pa{i}" for i in range(1, DSPEC.max_parents + 1)))))
def q_fit_docs(spark, sf):
    return pipeline(spark, sf, "docs").cpt


@register("posterior_exact_docs", sql(DPOST, f"SELECT {DKEY}, class, class_ord, round(p, 6) AS p FROM post"))
def q_post_docs(spark, sf):
    return pipeline(spark, sf, "docs").posterior("text_only")


@register("evaluate_model_docs", sql(DPOST + p_tail(DKEY) + [AUC_SQL, ECE_SQL, PRF_SQL], SUMMARY_SEL))
def q_eval_docs(spark, sf):
    p = pipeline(spark, sf, "docs")
    return metrics.summary_row(p.matrix("text_only"), DKEY).select(*SUMMARY_COLS)


def _comparison_sql() -> str:
    metric_cols = [c for c in SUMMARY_COLS if c not in ("n_test", "n_classes")]
    body = " UNION ALL ".join(f"SELECT model, track, {sq(c)} AS metric, CAST({c} AS DOUBLE) AS value FROM r"
                              for c in metric_cols)
    return f"WITH r AS ({_results_sql()}) {body}"


@register("comparison_data", _comparison_sql())
def q_comparison_data(spark, sf):
    """The numbers behind the model-comparison figure, long form."""
    metric_cols = [c for c in SUMMARY_COLS if c not in ("n_test", "n_classes")]
    r = round_doubles(_results(spark, sf))
    return r.unpivot(["model", "track"], metric_cols, "metric", "value")


def _prefix_sql() -> str:
    ps = SPEC.parents(SPEC.target)
    cols = []
    for i, p in enumerate(ps):
        cond = " AND ".join(f"e.{q} IS NOT NULL" for q in ps[:i]) or "TRUE"
        cols.append(f"CASE WHEN {cond} THEN e.{p} END AS pa{i + 1}")
    M = SPEC.max_parents
    joins, pcs = [], []
    for k in range(M, 0, -1):
        on = " AND ".join([f"l{k}.node = {sq(SPEC.target)}", f"l{k}.value = q.value"] +
                          [f"l{k}.pa{i} = q.pa{i}" for i in range(1, k + 1)])
        joins.append(f"LEFT JOIN (SELECT * FROM cpt WHERE depth = {k}) l{k} ON {on}")
        pcs.append(f"l{k}.p")
    joins.append(f"LEFT JOIN (SELECT * FROM cpt WHERE depth = 0) l0 ON l0.node = {sq(SPEC.target)} AND l0.value = q.value")
    hit = "coalesce(" + ", ".join(f"CASE WHEN l{k}.p IS NOT NULL THEN {k} END" for k in range(M, 0, -1)) + ", 0)"
    return sql(FIT + [O.evidence(EXPL), f"""q AS (SELECT e.{KEY}, {', '.join(cols)}, dd.value
                 FROM ev e JOIN domains dd ON dd.node = {sq(SPEC.target)})"""],
               f"SELECT q.{KEY}, q.value, {hit} AS hit_depth, round(coalesce({', '.join(pcs)}, l0.p), 6) AS p "
               f"FROM q {' '.join(joins)}")


@register("parent_key_prefix", _prefix_sql())
def q_parent_key_prefix(spark, sf):
    """I11 + J1 on real partial evidence: each test case's parent key for the
    target is cut at its first unknown parent, then backs off along prefixes."""
    from bnlake.operators.posterior import clean_evidence
    p = pipeline(spark, sf)
    ps = SPEC.parents(SPEC.target)
    ev = clean_evidence(p.evidence("explanatory"), EXPL, p.doms)
    vals = F.array(*[F.lit(v) for v in p.doms[SPEC.target]])
    q = ev.select(KEY, F.lit(SPEC.target).alias("node"),
                  *[F.col(x).alias(f"pa{i + 1}") for i, x in enumerate(ps)],
                  F.explode(vals).alias("value"))
    out = cptops.cpt_lookup(q, p.cpt, p.card, SPEC.max_parents, p.alpha)
    return out.select(KEY, "value", "hit_depth", "p")


@register("sampler_convergence_all")
def q_convergence_all(spark, sf):
    """I13 for every sampler: mean TV from exact at 100 / 500 / 1000 samples.
    Rejection filters one shared sample table by sample id; likelihood
    weighting filters one weighted table; Gibbs runs once per count."""
    from functools import reduce as _r
    p = pipeline(spark, sf)
    ev, exact = _stand_ins(spark, sf)
    drawn, samples = _lw(spark, sf, ev), _samples(spark, sf)
    parts = []
    for n in LW_COUNTS:
        rej = samp.posterior_rejection(spark, SPEC, samples.filter(F.col("sample_id") < n), p.doms, ev, EXANTE)
        gib = samp.posterior_gibbs(spark, SPEC, p.factors_long, p.doms, ev, EXANTE, n=n, burn_in=500,
                                   seed=DEFAULT_SEED)
        for name, post in (("rejection", rej), ("likelihood_weighting", drawn[n]), ("gibbs", gib)):
            parts.append(posterior.mean_tv(exact, post, KEY, posterior.stands_for(KEY))
                         .select(F.lit(name).alias("engine"), F.lit(n).alias("n_samples"), "tv"))
    return _r(DataFrame.unionByName, parts)


def _verdict_ci_sql() -> str:
    parts = []
    for track in ("explanatory", "ex_ante"):
        net = _boot_from(p_ctes(track), ["hit_3"])
        mar = _boot_from(_baseline_post_ctes("marginal", track) + p_tail(), ["hit_3"])
        parts.append(f"""SELECT {sq(track)} AS track, n.hit_3_lo AS network_lo, n.hit_3_hi AS network_hi,
                 m.hit_3_lo AS marginal_lo, m.hit_3_hi AS marginal_hi,
                 (n.hit_3_lo > m.hit_3_hi OR n.hit_3_hi < m.hit_3_lo) AS separated
            FROM ({net}) n, ({mar}) m""")
    return " UNION ALL ".join(parts)


@register("track_verdict_ci", _verdict_ci_sql())
def q_track_verdict_ci(spark, sf):
    """M11 with intervals: top-3 bootstrap intervals (same resamples for both
    models) for the network and the marginal baseline per track; separated iff
    the intervals do not overlap."""
    from functools import reduce as _r
    p = pipeline(spark, sf)
    rows = []
    # the marginal reads no evidence: one interval for both tracks
    mar = boot.bootstrap_ci(_scores(spark, sf, "marginal", "ex_ante"), ["hit_3"], N_BOOT, DEFAULT_SEED, key=KEY,
                            method="exact")
    m = round_doubles(mar).first()
    for track in ("explanatory", "ex_ante"):
        net = boot.bootstrap_ci(p.scores(track), ["hit_3"], N_BOOT, DEFAULT_SEED, key=KEY, method="exact")
        n = round_doubles(net).first()
        rows.append((track, n.hit_3_lo, n.hit_3_hi, m.hit_3_lo, m.hit_3_hi,
                     bool(n.hit_3_lo > m.hit_3_hi or n.hit_3_hi < m.hit_3_lo)))
    return spark.createDataFrame(rows, "track string, network_lo double, network_hi double, "
                                       "marginal_lo double, marginal_hi double, separated boolean")


INTERVAL_METRICS = ["hit_1", "hit_3", "hit_5", "log_loss", "brier"]
MODELS = ("network", "marginal", "majority")


def _named_intervals(df: DataFrame) -> DataFrame:
    """Interval columns under the names of the evaluation row; none for a k beyond the classes."""
    names = {f"hit_{k}_{e}": f"top_{k}_{e}" for k in (1, 3, 5) for e in ("lo", "hi")}
    return df.select(*[F.col(c).alias(names.get(c, c)) for c in df.columns])


def _intervals_sql() -> str:
    parts = []
    for model in MODELS:
        for track in ("explanatory", "ex_ante"):
            head = p_ctes(track) if model == "network" else _baseline_post_ctes(model, track) + p_tail()
            ci = ", ".join(f"b.{m}_{e} AS {m.replace('hit_', 'top_')}_{e}" if m not in ("hit_3", "hit_5") else
                           f"CASE WHEN s.n_classes >= {m[-1]} THEN b.{m}_{e} END AS top_{m[-1]}_{e}"
                           for m in INTERVAL_METRICS for e in ("lo", "hi"))
            parts.append(f"""SELECT {sq(model)} AS model, {sq(track)} AS track, s.*, {ci}
                FROM ({sql(head + [AUC_SQL, ECE_SQL, PRF_SQL], SUMMARY_SEL)}) s, ({_boot_from(head, INTERVAL_METRICS)}) b""")
    return " UNION ALL ".join(parts)


def _evaluation_rows(spark, sf, models) -> DataFrame:
    """A row for each model and track: all metrics and their intervals, the draws shared by all."""
    from functools import reduce as _r

    from bnlake.session import keep
    points, scores = [_results(spark, sf)], []
    for track in ("explanatory", "ex_ante"):
        for model in models:
            tag = [F.lit(model).alias("model"), F.lit(track).alias("track")]
            if model not in MODELS:                        # the others' rows are in the results table
                points.append(keep(metrics.summary_row(_matrix(spark, sf, model, track), KEY).select(*tag, *SUMMARY_COLS)))
            scores.append(_scores(spark, sf, model, track).select(*tag, KEY, *INTERVAL_METRICS))
    ci = keep(boot.bootstrap_ci_by(_r(DataFrame.unionByName, scores), ["model", "track"], INTERVAL_METRICS,
                                   N_BOOT, DEFAULT_SEED, key=KEY))
    out = keep(_r(DataFrame.unionByName, points)).join(_named_intervals(ci), ["model", "track"])
    for k in (3, 5):
        for e in ("lo", "hi"):
            out = out.withColumn(f"top_{k}_{e}", F.when(F.col("n_classes") >= k, F.col(f"top_{k}_{e}")))
    return out


@register("evaluate_intervals", _intervals_sql())
def q_evaluate_intervals(spark, sf):
    """M9 and M10 in full for the models that SQL can fit: every metric with its
    95% bootstrap interval, each model on each track."""
    return _evaluation_rows(spark, sf, MODELS)


@register("results_table_ml")
def q_results_table_ml(spark, sf):
    """M10 with the discriminative models: five models on both tracks, with intervals."""
    return _evaluation_rows(spark, sf, (*MODELS, "logistic", "boosting"))


# ---------------------------------------------------------------------------
# Answers to requests that name a track
# ---------------------------------------------------------------------------
def _asked_sql(col: str = "request_id") -> str:
    return f"CASE {col} % 3 WHEN 0 THEN 'explanatory' WHEN 1 THEN 'ex_ante' ELSE 'unheard_of' END"


def _answer_sql(track: str) -> str:
    bt = sql_binary_target("class")
    names = sorted(SPEC.track(track))
    unused = sorted([v for v in EXPL if v not in names])
    ignored = f"CASE WHEN r.{KEY} % 2 = 0 THEN {sq(','.join(sorted(unused + ['not_a_field'])))} ELSE {sq(','.join(unused))} END"
    parts = ", ".join(f"{sq(v + '=')} || a.{v}" for v in names)
    mine = "= 0" if track == "explanatory" else "<> 0"
    asked = O.evidence(SPEC.track(track), name="asked")      # the evidence as given
    return sql(p_ctes(track) + [_labels_sql(), RANK_SQL, asked], f"""
      SELECT r.{KEY} AS request_id, {sq(track)} AS track, concat_ws(',', {parts}) AS evidence_used, {ignored} AS ignored,
             r.rank, r.class, coalesce(l.label, r.class) AS label, round(r.p, 6) AS p,
             round(b.aff / (b.aff + b.rev), 6) AS p_affirm, round(b.rev / (b.aff + b.rev), 6) AS p_reverse
      FROM ranked r JOIN asked a ON a.{KEY} = r.{KEY} LEFT JOIN labels_t l ON l.code = r.class
      JOIN (SELECT {KEY}, sum(CASE WHEN {bt} = 0 THEN p ELSE 0 END) AS aff,
                   sum(CASE WHEN {bt} = 1 THEN p ELSE 0 END) AS rev FROM post GROUP BY 1) b ON b.{KEY} = r.{KEY}
      WHERE r.{KEY} % 3 {mine}""")


@register("answer_requests", " UNION ALL ".join(f"SELECT * FROM ({_answer_sql(t)})" for t in ("explanatory", "ex_ante")))
def q_answer_requests(spark, sf):
    """I6 in full: a request names its track (an unknown one counts as ex-ante);
    the answer tells the track, the evidence used and ignored, the ranked and
    labelled distribution, and the affirmed and reversed shares."""
    known = [F.lit(x) for x in ("explanatory", "ex_ante")]
    asked = _requests(spark, sf).withColumn("track", F.expr(_asked_sql()))
    asked = asked.withColumn("track", F.when(F.col("track").isin(*known), F.col("track")).otherwise("ex_ante"))
    parts = [_answers(spark, sf, asked.filter(F.col("track") == t), t) for t in ("explanatory", "ex_ante")]
    return parts[0].unionByName(parts[1])


def _answers(spark, sf, requests: DataFrame, track: str) -> DataFrame:
    p = pipeline(spark, sf)
    ev_vars = SPEC.track(track)
    r = prep.evidence_filter(requests, ev_vars)
    used = F.array_compact(F.array(*[F.concat(F.lit(v + "="), F.col("kept")[v]) for v in sorted(ev_vars)]))
    ev = r.select(F.col("request_id").alias(KEY), *[F.col("kept")[v].alias(v) for v in ev_vars],
                  F.array_join("ignored", ",").alias("ignored"), F.array_join(used, ",").alias("evidence_used"))
    post = posterior.posterior_exact(spark, SPEC, p.factors, p.doms, ev, ev_vars)
    b = binary_target(F.col("class"))
    shares = post.groupBy(KEY).agg(*[F.sum(F.when(b == v, F.col("p")).otherwise(0.0)).alias(c)
                                     for v, c in ((0, "_aff"), (1, "_rev"))])
    total = F.col("_aff") + F.col("_rev")
    ranked = posterior.rank_posterior(post.withColumn("p", F.round("p", 12)), KEY)
    lab = prep.label_values(ranked, "class", prep.label_table(spark))
    return lab.join(shares, KEY).join(ev.select(KEY, "ignored", "evidence_used"), KEY).select(
        F.col(KEY).alias("request_id"), F.lit(track).alias("track"), "evidence_used", "ignored", "rank", "class", "label",
        "p", F.when(total > 0, F.col("_aff") / total).alias("p_affirm"), F.when(total > 0, F.col("_rev") / total).alias("p_reverse"))


def _heldout_sql() -> str:
    joins, terms = [], []
    for n in SPEC.nodes:
        on = [f"f_{n.name}.node = {sq(n.name)}", f"f_{n.name}.value = t.{n.name}"] + \
             [f"f_{n.name}.pa{i + 1} = t.{p}" for i, p in enumerate(n.parents)]
        joins.append(f"JOIN factors f_{n.name} ON " + " AND ".join(on))
        terms.append(f"ln(f_{n.name}.p)")
    return sql(FACT + [O.nodes("test_nodes", "split", "NOT is_train")], f"""
      SELECT count(*) AS n_rows, round(sum({' + '.join(terms)}), 6) AS heldout_loglik,
             round(avg({' + '.join(terms)}), 6) AS mean_loglik
      FROM test_nodes t {' '.join(joins)}""")


@register("heldout_loglik", _heldout_sql())
def q_heldout_loglik(spark, sf):
    """G7 (held-out form): the training CPTs applied to the complete test rows,
    sum of log P(x | parents) over all nodes -- a prediction score, unlike the
    refit-on-test ``test_fit_loglik``.  Factor tables are joined by their
    variables (broadcast under their proven size bound)."""
    p = pipeline(spark, sf)
    x = prep.rename_nodes(p.test, SPEC).withColumn("_ll", F.lit(0.0))
    for n in SPEC.names:
        f = p.factors[n]
        side = f.df.withColumnRenamed("w", "_f")
        if f.bound is not None and f.bound <= cptops.BROADCAST_ROWS:
            side = F.broadcast(side)
        x = x.join(side, f.variables).withColumn("_ll", F.col("_ll") + F.log("_f")).drop("_f")
    return x.agg(F.count(F.lit(1)).alias("n_rows"), F.sum("_ll").alias("heldout_loglik"),
                 F.avg("_ll").alias("mean_loglik"))
