"""BIC scores and greedy structure search (G1-G9, SET1).

Scores are tables: a batch of families (node, parents) is counted by one job keyed
by set id, penalties are products over a table of cardinalities, a graph's score is
a join of its families with their scores and a sum.  Rows with a null in a family
aren't counted for it.  The search is a loop over these small tables.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from bnlake.operators.cpt import weighted
from bnlake.operators.setcount import count_sets
from bnlake.session import keep
from bnlake.spec import NetworkSpec


Family = tuple[str, tuple[str, ...]]        # a node and its parents, in any order
Graph = Mapping[str, Sequence[str]]


def configurations(df: DataFrame, variables: list[str]) -> DataFrame:
    """Distinct configurations of the variables with their weight ``_w``, rows null
    in all of them left out: written once, read by every batch of families."""
    rows = df.select(*[F.col(f"`{v}`").cast("string").alias(v) for v in variables]).dropna(how="all")
    return keep(weighted(rows, variables))


def cardinalities(data: DataFrame, variables: list[str]) -> DataFrame:
    """(var, states, n_rows) of each variable: its distinct values, one at least."""
    counted = data.agg(F.coalesce(F.sum("_w"), F.lit(0)).alias("n_rows"),
                       *[F.count_distinct(F.col(f"`{v}`")).alias(f"c{i}") for i, v in enumerate(variables)])
    entries = [F.struct(F.lit(v).alias("var"), F.greatest(F.lit(1), F.col(f"c{i}")).alias("states"), "n_rows")
               for i, v in enumerate(variables)]
    return counted.select(F.inline(F.array(*entries)))


def family_table(spark: SparkSession, families: Sequence[Family]) -> DataFrame:
    return spark.createDataFrame([(i, n, list(ps)) for i, (n, ps) in enumerate(families)],
                                 "fam int, node string, parents array<string>")


def family_scores(data: DataFrame, cards: DataFrame, variables: list[str], families: Sequence[Family]) -> DataFrame:
    """(fam, node, parents, k, loglik, penalty, bic) of each family.

    Families over the same variables share one set of cells. The log-likelihood
    comes from the rows complete for the family; a family without one has none
    and scores minus infinity. The penalty is half the log of all rows times the
    free parameters, a product of the family's rows in the cardinality table."""
    spark = data.sparkSession
    fams = family_table(spark, families)
    order = {v: i for i, v in enumerate(variables)}
    members = [tuple(sorted({n, *ps}, key=order.__getitem__)) for n, ps in families]
    sets = list(dict.fromkeys(members))
    at = {s: i for i, s in enumerate(sets)}
    # one row a family: bounded by the batch
    uses = spark.createDataFrame([(i, at[m], m.index(n)) for i, ((n, _), m) in enumerate(zip(families, members))],
                                 "fam int, set_id int, node_at int")
    cells = count_sets(data, variables, [list(s) for s in sets], "_w").join(F.broadcast(uses), "set_id") \
        .select("fam", F.col("n").cast("double"),
                F.expr("filter(vals, (v, i) -> i != node_at)").alias("given"))
    share = F.col("n") / F.sum("n").over(Window.partitionBy("fam", "given"))
    fit = cells.withColumn("part", F.col("n") * F.log(share)).groupBy("fam").agg(F.sum("part").alias("loglik"))
    roles = fams.select("fam", F.col("node").alias("var"), F.lit(True).alias("is_node")) \
        .unionByName(fams.select("fam", F.explode("parents").alias("var"), F.lit(False).alias("is_node")))
    states = F.col("states").cast("double")
    size = roles.join(F.broadcast(cards), "var").groupBy("fam").agg(     # one row a variable
        (F.lit(0.5) * F.log(F.greatest(F.lit(1), F.max("n_rows")))
         * F.product(F.when(F.col("is_node"), states - 1).otherwise(states))).alias("penalty"))
    scored = fams.join(size, "fam").join(fit, "fam", "left") \
        .withColumn("loglik", F.coalesce("loglik", F.lit(float("-inf"))))
    return scored.select("fam", "node", "parents", F.size("parents").alias("k"), "loglik", "penalty",
                         (F.col("loglik") - F.col("penalty")).alias("bic"))


def graph_scores(data: DataFrame, cards: DataFrame, variables: list[str], graphs: Mapping[str, Graph]) -> DataFrame:
    """(graph, bic, loglik, n_edges) of each graph, the sums of its families;
    families that graphs share are counted once."""
    uses = [(name, (v, tuple(sorted(ps)))) for name, g in graphs.items() for v, ps in g.items()]
    families = list(dict.fromkeys(f for _, f in uses))
    place = {f: i for i, f in enumerate(families)}
    parts = data.sparkSession.createDataFrame([(name, place[f]) for name, f in uses], "graph string, fam int")
    return family_scores(data, cards, variables, families).join(F.broadcast(parts), "fam").groupBy("graph").agg(
        F.sum("bic").alias("bic"), F.sum("loglik").alias("loglik"), F.sum("k").cast("int").alias("n_edges"))


@dataclass(frozen=True)
class Move:
    """One edge changed: ``after`` holds the new parent list of each family it touches."""
    kind: str
    source: str
    target: str
    after: tuple[tuple[str, tuple[str, ...]], ...]


class Dag:
    """Parent lists with the relation ``below``: the nodes reachable from each node."""

    def __init__(self, variables: list[str], parents: dict[str, tuple[str, ...]] | None = None):
        self.variables = list(variables)
        self.parents = {v: tuple((parents or {}).get(v, ())) for v in variables}
        self.below = self._closure()

    def _closure(self) -> dict[str, frozenset[str]]:
        reach = {v: {c for c in self.variables if v in self.parents[c]} for v in self.variables}
        for middle in self.variables:
            for v in self.variables:
                if middle in reach[v]:
                    reach[v] |= reach[middle]
        return {v: frozenset(x) for v, x in reach.items()}

    def admits(self, source: str, target: str) -> bool:
        """Whether the edge source -> target leaves the graph acyclic."""
        return source != target and source not in self.below[target]

    def with_parents(self, changes) -> "Dag":
        return Dag(self.variables, {**self.parents, **dict(changes)})

    def moves(self, max_parents: int) -> list[Move]:
        """Every legal change of one edge, in the fixed order that breaks ties:
        by target, then additions, removals, reversals, then by source."""
        found = []
        for t in self.variables:
            have = self.parents[t]
            without = {s: tuple(p for p in have if p != s) for s in have}
            if len(have) < max_parents:
                found += [Move("add", s, t, ((t, (*have, s)),)) for s in self.variables
                          if s not in have and self.admits(s, t)]
            found += [Move("remove", s, t, ((t, without[s]),)) for s in have]
            # turned round, the edge closes a cycle only if another path leads from s to t
            found += [Move("reverse", s, t, ((t, without[s]), (s, (*self.parents[s], t)))) for s in have
                      if len(self.parents[s]) < max_parents and self.with_parents({t: without[s]}).admits(t, s)]
        return found


def hill_climb(df: DataFrame, variables: list[str], max_parents: int = 4, max_iterations: int = 200) -> dict:
    """From the empty graph, the move with the largest gain in BIC while that
    is above 1e-10; the first in the moves' order wins a tie.  Each iteration
    scores all its new families in one Spark job; the driver holds their scores,
    one number a family, and the graph."""
    data = configurations(df, variables)
    cards = keep(cardinalities(data, variables))
    scores: dict[tuple[str, frozenset[str]], float] = {}

    def bic(family: Family) -> float:
        return scores[family[0], frozenset(family[1])]

    def look_up(families) -> None:
        new = {(n, frozenset(ps)): (n, tuple(ps)) for n, ps in families if (n, frozenset(ps)) not in scores}
        if new:
            rows = family_scores(data, cards, variables, list(new.values())).select("node", "parents", "bic").collect()
            scores.update({(r.node, frozenset(r.parents)): r.bic for r in rows})

    dag = Dag(variables)
    look_up(dag.parents.items())
    history = [sum(map(bic, dag.parents.items()))]
    while len(history) <= max_iterations:
        choices = dag.moves(max_parents)
        look_up(f for move in choices for f in move.after)
        gains = [sum(bic(f) - bic((f[0], dag.parents[f[0]])) for f in move.after) for move in choices]
        best = max(range(len(gains)), key=gains.__getitem__, default=None)      # the first of equals
        if best is None or not gains[best] > 1e-10:
            break
        dag = dag.with_parents(choices[best].after)
        history.append(history[-1] + gains[best])
    return {"graph": {v: list(ps) for v, ps in dag.parents.items()}, "score": sum(map(bic, dag.parents.items())),
            "iterations": len(history) - 1, "history": history}


def spec_graph(spec: NetworkSpec, columns) -> dict[str, list[str]]:
    """The spec's graph over raw column names, present columns only."""
    present = set(columns)
    g = {}
    for n in spec.nodes:
        if n.column in present:
            g[n.column] = [spec.column(p) for p in n.parents if spec.column(p) in present]
    return g


def edge_frame(spark: SparkSession, graph: dict[str, list[str]]) -> DataFrame:
    rows = [(p, c, i + 1) for c, ps in graph.items() for i, p in enumerate(ps)]
    return spark.createDataFrame(rows, "parent string, child string, pos int")


def edge_diff(hand: DataFrame, learned: DataFrame) -> DataFrame:
    """SET1: edges only in hand, only in learned, in both."""
    h = hand.select("parent", "child")
    le = learned.select("parent", "child")
    return (h.subtract(le).withColumn("where", F.lit("only_handcrafted"))
            .unionByName(le.subtract(h).withColumn("where", F.lit("only_learned")))
            .unionByName(h.intersect(le).withColumn("where", F.lit("both"))))


def network_edges(spark: SparkSession, spec: NetworkSpec) -> DataFrame:
    """(node, parents, children, is_root) from the spec's edge table."""
    e = spark.createDataFrame(spec.edges, "parent string, child string, pos int")
    nodes = spark.createDataFrame([(n, i) for i, n in enumerate(spec.names)], "node string, ord int")
    par = e.groupBy(F.col("child").alias("node")).agg(
        F.array_sort(F.collect_list(F.struct("pos", "parent"))).alias("_p"))
    ch = e.groupBy(F.col("parent").alias("node")).agg(F.array_sort(F.collect_list("child")).alias("children"))
    j = nodes.join(par, "node", "left").join(ch, "node", "left")
    return j.select("node", "ord",
                    F.coalesce(F.transform("_p", lambda s: s["parent"]), F.array().cast("array<string>")).alias("parents"),
                    F.coalesce("children", F.array().cast("array<string>")).alias("children"),
                    F.col("_p").isNull().alias("is_root"))
