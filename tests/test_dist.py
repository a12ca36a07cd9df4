from statistics import NormalDist

import pytest
from pyspark.sql import functions as F

from auditspark.functions import dist, tdist
from auditspark.operators import stats


def test_t_distribution_against_the_scalar_version(spark):
    rows = [(t, d) for t in (0.0, 0.3, 1.0, -1.7, 2.04, 4.688314, 12.867284, 60.0) for d in (1.0, 2.0, 3.0, 32.0, 500.0, 40000.0)]
    df = spark.createDataFrame(rows, "t double, d double").select(
        "t", "d", dist.t_two_sided_p(F.col("t"), F.col("d")).alias("p"), dist.t_quantile(0.975, F.col("d")).alias("q"),
        dist.t_quantile(0.01, F.col("d")).alias("low"))
    for r in df.collect():
        assert r.p == pytest.approx(tdist.t_two_sided_p(r.t, r.d), rel=1e-9)
        assert r.q == pytest.approx(tdist.t_quantile(0.975, r.d), rel=1e-9)
        assert r.low == pytest.approx(tdist.t_quantile(0.01, r.d), rel=1e-9)


def test_goldens_and_edges(spark):
    rows = [(4.688314, 32.0), (None, 3.0), (float("nan"), 3.0), (1.0, 0.0), (1.0, None), (float("inf"), 5.0), (0.0, 7.0)]
    got = [r.p for r in spark.createDataFrame(rows, "t double, d double").select(
        dist.t_two_sided_p(F.col("t"), F.col("d")).alias("p")).collect()]
    assert got[0] == pytest.approx(4.9056e-05, rel=1e-4)
    assert got[1:] == [None, None, None, None, 0.0, 1.0]
    q = spark.createDataFrame([(5.0,), (-1.0,), (None,)], "d double").select(dist.t_quantile(0.5, F.col("d")).alias("q")).collect()
    assert [r.q for r in q] == [0.0, None, None]


def test_normal_quantile(spark):
    ps = [1e-300, 1e-20, 1e-9, 0.01, 0.074, 0.076, 0.3, 0.5, 0.9, 0.926, 1 - 1e-12]
    got = spark.createDataFrame([(p,) for p in [*ps, 0.0, 1.0, -0.5, None]], "p double").select(dist.normal_quantile(F.col("p")).alias("q"))
    out = [r.q for r in got.collect()]
    assert out[:len(ps)] == pytest.approx([NormalDist().inv_cdf(p) for p in ps], rel=1e-12, abs=1e-14)
    assert out[len(ps):] == [None] * 4


def test_normal_quantile_sql_is_the_same():
    import duckdb

    for p in (1e-30, 0.02, 0.31, 0.5, 0.77, 0.999):
        got = duckdb.connect().execute(f"SELECT {dist.normal_quantile_sql('p')} FROM (SELECT CAST({p!r} AS DOUBLE) AS p)").fetchone()[0]
        assert got == pytest.approx(NormalDist().inv_cdf(p), rel=1e-12, abs=1e-14)


@pytest.mark.parametrize("n", [1, 4, 10, 11, 50])
def test_qq_follows_the_plotting_rule(spark, n):
    df = spark.createDataFrame([(i, float((i * 7919) % 101)) for i in range(n)] + [(n, None), (n + 1, float("nan"))], "k int, v double")
    rows = sorted(stats.normal_qq(df, "v", ["k"]).collect(), key=lambda r: r.position)
    a = 3 / 8 if n <= 10 else 1 / 2
    assert [r.position for r in rows] == list(range(1, n + 1)) and [r.v for r in rows] == sorted(r.v for r in rows)
    for r in rows:
        point = (r.position - a) / (n + 1 - 2 * a)
        assert r.plotting == pytest.approx(point, rel=1e-12)
        assert r.theoretical == pytest.approx(NormalDist().inv_cdf(point), rel=1e-9, abs=1e-12)


def test_bands_and_p_values_need_no_python_worker(spark):
    from auditspark.plans import registry

    registry.load_all()
    for name in ("regression_band", "packaging_band", "regression_pvalues_by_group", "regression_qq"):
        plan = registry.SPARK[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
        assert "Python" not in plan and "Pandas" not in plan, name


def test_grouped_p_values(spark):
    rows = [(g, float(x), 2.0 * x + g * ((x * 37) % 11 - 5.0)) for g in (1, 2, 3) for x in range(2, 30)]
    fit = stats.with_p_values(stats.ols(spark.createDataFrame(rows, "g int, x double, y double"), "y", "x", ["g"]))
    for r in fit.collect():
        assert r.p_slope == pytest.approx(tdist.t_two_sided_p(r.t_slope, r.df), rel=1e-8, abs=1e-250)
        assert r.p_intercept == pytest.approx(tdist.t_two_sided_p(r.t_intercept, r.df), rel=1e-8)
