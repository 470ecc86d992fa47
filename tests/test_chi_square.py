from pyspark.sql import functions as F

from bnlake.functions.scalar import chi2_sf, chi2_sf_py


def test_chi_square_survival(spark):
    rows = [(float(g), d) for d in (1, 2, 3, 4, 7, 30, 99, 100, 401) for g in (0.001, 0.5, d * 0.7, d, d + 1.9, d + 2.1, d * 1.5, 352.4)]
    got = spark.createDataFrame(rows, "g double, d int").select("g", "d", chi2_sf(F.col("g"), F.col("d")).alias("p")).collect()
    assert len(got) == len(rows)
    for r in got:
        assert abs(r.p - chi2_sf_py(r.g, r.d)) < 1e-10
    odd = spark.createDataFrame([(0.0, 3), (-1.0, 3), (5.0, 0), (None, 3), (5.0, None)], "g double, d int")
    assert [r.p for r in odd.select(chi2_sf(F.col("g"), F.col("d")).alias("p")).collect()] == [1.0, 1.0, 1.0, None, None]
