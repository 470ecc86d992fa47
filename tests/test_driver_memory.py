"""Plans that keep tables with a row a case, and plans of many tables, off the driver."""
import re
from types import SimpleNamespace

from pyspark.sql import functions as F

from bnlake.operators import bootstrap, cpt, metrics, prep


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_drawn_counts_are_not_broadcast(spark):
    scores = spark.createDataFrame([(i, float(i % 2)) for i in range(50)], "case_id long, hit double")
    entries = F.array(F.struct(F.lit(0).alias("g"), "hit")).alias("entries")
    sums, n = bootstrap.replicate_sums(scores.select("case_id", entries), "case_id", ["hit"], 5, 1)
    assert n == 50
    assert "SortMergeJoin [k#" in _plan(sums) and "BroadcastHashJoin [k#" not in _plan(sums)


def _tables(spark, folder):
    rows = {"region": ("r_regionkey int, r_name string", [(0, "A")]),
            "nation": ("n_nationkey int, n_name string, n_regionkey int", [(3, "N", 0)]),
            "customer": ("c_custkey long, c_nationkey int, c_mktsegment string", [(1, 3, "S"), (2, 3, "T")]),
            "orders": ("o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, "
                       "o_orderdate timestamp_ntz, o_orderpriority string", []),
            "lineitem": ("l_orderkey long, l_returnflag string, l_linestatus string, l_discount double",
                         [(10, "R", "F", 0.09), (10, "R", "O", 0.01), (10, "A", "O", None), (None, "A", "F", 0.1)])}
    for name, (schema, data) in rows.items():
        spark.createDataFrame(data, schema).write.parquet(f"{folder}/{name}.parquet", mode="overwrite")
    spark.sql("""SELECT * FROM VALUES (10L, 1L, 'O', 500000.0D, TIMESTAMP_NTZ'1996-05-01 00:00:00', '3-MEDIUM'),
                 (11L, 2L, 'F', 1.0D, TIMESTAMP_NTZ'1997-12-31 23:59:59', '1-URGENT'),
                 (12L, 9L, 'F', 1.0D, TIMESTAMP_NTZ'1997-12-31 23:59:59', 'none'),
                 (13L, CAST(NULL AS BIGINT), 'F', 1.0D, TIMESTAMP_NTZ'1997-12-31 23:59:59', NULL)
                 t(o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderdate, o_orderpriority)""") \
        .write.parquet(f"{folder}/orders.parquet", mode="overwrite")


def test_customers_are_merged_with_orders(spark, tmp_path):
    from bnlake.sources.cases import raw_cases
    _tables(spark, tmp_path)
    df = raw_cases(spark, str(tmp_path))
    assert "SortMergeJoin [o_custkey#" in _plan(df)
    assert not re.search(r"BroadcastHashJoin \[o_custkey#", _plan(df))
    # an order whose customer is unknown is no case, and its priority is never read as a number
    assert [tuple(r) for r in df.orderBy("case_id").collect()] == [
        (10, 1996, "A", "S", "O", 1, 2, "R", 1, 1, 2, 3), (11, 1997, "A", "T", "F", 0, 4, None, None, 0, None, 1)]


def test_each_row_of_the_results_table_has_its_own_plan(spark, monkeypatch):
    from bnlake import session
    from bnlake.plans import registry
    key, target = registry.KEY, registry.TARGET
    test = spark.createDataFrame([(i, i % 3 + 1) for i in range(30)], f"{key} long, {target} int")
    truth = test.select(key, F.col(target).cast("string").alias("y_true"))
    post = test.select(key, F.explode(F.array(*map(F.lit, "123"))).alias("class"), F.lit(1 / 3).alias("p"))
    P = metrics.predict_distributions(post, truth, key).localCheckpoint()
    fake = SimpleNamespace(_post={}, train=test, test=test, truth=lambda: truth, matrix=lambda track: P)
    leaves, keep = [], session.keep

    def kept(df):
        leaves.append(df._jdf.queryExecution().optimizedPlan().collectLeaves().size())
        return keep(df)

    monkeypatch.setattr(session, "keep", kept)
    monkeypatch.setattr(metrics, "keep", kept, raising=False)
    monkeypatch.setattr(registry, "pipeline", lambda *a: fake)
    rows = {(r["model"], r["track"]): r[2:] for r in registry._results(spark, "").collect()}
    assert len(rows) == 6 and rows["marginal", "ex_ante"] == rows["marginal", "explanatory"]
    assert rows["majority", "ex_ante"] != rows["marginal", "ex_ante"]
    assert max(leaves) <= 12           # all rows in one plan: 54


def test_counts_from_distinct_rows(spark, small_df, small_spec):
    nodes = prep.rename_nodes(small_df, small_spec)
    few = cpt.weighted(nodes, small_spec.names)
    assert few.count() < nodes.count()
    a, b = cpt.cpt_counts(nodes, small_spec), cpt.cpt_counts(few, small_spec, weight="_w")
    assert sorted(map(str, a.collect())) == sorted(map(str, b.collect()))
    assert sorted(prep.value_domains(nodes, small_spec).collect()) == sorted(prep.value_domains(few, small_spec).collect())
