from pyspark.sql import functions as F

from bnlake.operators import prep
from bnlake.spec import default_spec


def test_vote_split_from_min_votes(spark):
    df = spark.createDataFrame([(0, 9), (1, 8), (3, 6), (0, 9)], "minVotes int, majVotes int")
    assert [r.voteSplit for r in prep.derive_flag(df).collect()] == [0, 1, 1, 0]


def test_null_votes_mean_unanimous(spark):
    df = spark.createDataFrame([(None,), (2.0,)], "minVotes double")
    assert [r.voteSplit for r in prep.derive_flag(df).collect()] == [0, 1]


def test_existing_flag_kept(spark):
    df = spark.createDataFrame([(1, 9), (2, 9)], "minVotes int, voteSplit int")
    assert [r.voteSplit for r in prep.derive_flag(df).collect()] == [9, 9]


def test_missing_report_counts(spark):
    spec = default_spec()
    df = spark.createDataFrame([(1.0, 1.0), (None, 2.0), (3.0, None)],
                               "caseDisposition double, issueArea double")
    rep = {r.variable: (r.n_missing, r.pct_missing) for r in prep.missing_report(df, spec).collect()}
    assert rep["final_disposition"] == (1, 33.33)
    assert rep["issue_area"] == (1, 33.33)


def test_rare_categories(spark):
    spec = default_spec()
    df = spark.createDataFrame([(1,)] * 20 + [(7,)], "issueArea int")
    rare = [(r.variable, r.value, r["count"]) for r in prep.rare_categories(df, spec, 5).collect()]
    assert rare == [("issue_area", "7", 1)]


def test_prepare_is_idempotent(spark):
    spec = default_spec()
    df = spark.createDataFrame(
        [(1, "a", None, None, None, None, None, None, 0, None, 2),
         (2, "a", "x", "F", 0, 1, "A", 1, 0, 2, None),
         (3, None, None, None, None, None, None, None, 0, None, 3)],
        "case_id long, chief string, issueArea string, lawType string, caseDispositionUnusual int, "
        "lcDisposition int, decisionType string, precedentAlteration int, minVotes int, "
        "declarationUncon int, caseDisposition int")
    once = prep.prepare_cases(df, spec)
    twice = prep.prepare_cases(once, spec)
    assert sorted(once.collect()) == sorted(twice.collect())
    # row 2 has no target, rows 1 and 3 are more than half null
    assert once.count() == 0


def test_rename_nodes_drops_any_null(spark):
    spec = default_spec()
    df = spark.createDataFrame([(1, "a", None), (2, "b", 3)], "case_id long, chief string, caseDisposition int")
    out = prep.rename_nodes(df, spec)
    assert out.columns == ["case_id", "chief_justice", "final_disposition"]
    assert out.count() == 1


def test_binary_collapse_sums_to_one(spark):
    post = spark.createDataFrame([(1, "2", 0.5), (1, "3", 0.2), (1, "1", 0.3), (2, "1", 1.0)],
                                 "case_id long, class string, p double")
    out = prep.binary_collapse(post)
    s = {r.case_id: r.s for r in out.groupBy("case_id").agg(F.sum("p").alias("s")).collect()}
    assert abs(s[1] - 1) < 1e-12 and abs(s[2] - 1) < 1e-12
    got = {(r.case_id, r["class"]): r.p for r in out.collect()}
    assert abs(got[(1, "0")] - 0.5 / 0.7) < 1e-12 and got[(2, "0")] == 0.5


def test_evidence_filter_reports_ignored(spark):
    df = spark.createDataFrame([({"a": "1", "z": "2", "b": None},)], "evidence map<string,string>")
    r = prep.evidence_filter(df, ["a", "b"]).first()
    assert r.kept == {"a": "1"} and r.ignored == ["z"]


def test_binary_target_parsing(spark):
    """{2} -> 0, {3,4,5,8} -> 1, other codes, nulls and text -> null;
    numeric text is truncated like an int conversion."""
    from bnlake.functions.scalar import binary_target
    df = spark.createDataFrame([("2",), ("3.0",), ("8",), ("1",), ("x",), (None,), ("5.7",)], "c string")
    got = [r.b for r in df.select(binary_target(F.col("c")).alias("b")).collect()]
    assert got == [0, 1, 1, None, None, None, 1]
