"""Registered queries against their DuckDB oracles on the smallest data set."""
import hashlib

import duckdb
import pytest

import __spark_entry__ as E
from bnlake.sources.tables import TABLES, table_path

SF = "/root/testdata/sf0.001"
FAST = ["scan_cases", "prepare_cases", "missing_report", "split_chrono", "split_random", "kfold_assign",
        "cpt_counts", "fit_network", "cpt_laplace", "factor_tables", "backoff_rate",
        "posterior_exact", "posterior_exact_explanatory", "predict_distributions", "evaluate_model",
        "bootstrap_ci", "dependency_report", "g_test", "bic_family", "ancestral_sample",
        "posterior_likelihood_weighting"]


def _digest(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    norm = lambda v: repr(round(v, 6)) if isinstance(v, float) else repr(v)
    return hashlib.sha1("\n".join(sorted("|".join(norm(r[i]) for i in order) for r in rows)).encode()).hexdigest()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{table_path(SF, t)}')")
    return c


@pytest.mark.parametrize("name", FAST)
def test_query_matches_oracle(spark, con, name):
    df = E.queries()[name](spark, SF)
    rows = [tuple(r) for r in df.collect()]
    res = con.execute(E.oracle_sql()[name])
    ocols = [d[0] for d in res.description]
    orows = res.fetchall()
    assert sorted(df.columns) == sorted(ocols)
    assert len(rows) == len(orows)
    assert _digest(df.columns, rows) == _digest(ocols, orows)


def test_entry_runs(spark):
    assert E.entry(spark).count() == 1
