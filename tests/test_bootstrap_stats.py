"""Bootstrap against a dense brute force; statistics against independent calculations on a synthesized
packaging table and company list."""

import csv
import hashlib
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from auditspark.operators import bootstrap, ordered, stats
from auditspark.sources.csv import read_csv


def _draw(seed, b, j, n):
    return int(hashlib.md5(f"{seed}:{b}:{j}".encode()).hexdigest()[:bootstrap.HASH_DIGITS], 16) % n


def _dense_boot(p, n_events, ids, B=100, seed=3437):
    """The dense grid: every id has a value for every event."""
    idx = [[_draw(seed, b, j, n_events) for j in range(1, n_events + 1)] for b in range(1, B + 1)]
    out = {}
    for c in ids:
        v = np.array([p.get((e, c), 0.0) for e in range(n_events)])
        means = np.array([v[i].mean() for i in idx])
        out[c] = (np.quantile(means, 0.975), v.mean(), np.quantile(means, 0.025))
    return out


def test_sparse_bootstrap_equals_dense_grid(spark):
    rng = np.random.default_rng(3)
    n_events, ids = 37, ["a", "b", "c", "d"]
    p = {}
    for e in range(n_events):
        present = [c for c in ids if rng.random() < (0.9 if c == "a" else 0.15)] or ["b"]
        for c in present:
            p[(e, c)] = 1.0 / len(present)
    rows = [(f"ev{e:03d}", c, v) for (e, c), v in p.items()]
    df = spark.createDataFrame(rows, "event_id string, id string, proportion double")
    got = {r.id: (r.high, r.mean, r.low) for r in bootstrap.boot_mean_ci(df, "event_id", "id", "proportion").collect()}
    want = _dense_boot(p, n_events, sorted({c for (_, c) in p}))
    assert set(got) == set(want)
    for c in want:
        assert np.allclose(got[c], want[c], atol=1e-12), c


def test_bootstrap_in_blocks_of_replicates(spark, monkeypatch):
    monkeypatch.setattr(bootstrap, "REPLICATE_BLOCK", 10)
    rng = np.random.default_rng(11)
    p = {}
    for e in range(23):
        present = [c for c in "xyz" if rng.random() < 0.5] or ["x"]
        for c in present:
            p[(e, c)] = 1.0 / len(present)
    df = spark.createDataFrame([(f"e{e:02d}", c, v) for (e, c), v in p.items()],
                               "event_id string, id string, proportion double")
    got = {r.id: (r.high, r.mean, r.low)
           for r in bootstrap.boot_mean_ci(df, "event_id", "id", "proportion", replicates=37, seed=11).collect()}
    want = _dense_boot(p, 23, sorted({c for (_, c) in p}), B=37, seed=11)
    for c in want:
        assert np.allclose(got[c], want[c], atol=1e-12), c


def test_bootstrap_is_partitioning_independent(spark):
    rows = [(f"e{i}", "x", (i % 7) / 7.0) for i in range(50)]
    a = bootstrap.boot_mean_ci(spark.createDataFrame(rows, "event_id string, id string, proportion double")
                               .repartition(1), "event_id", "id", "proportion").first()
    b = bootstrap.boot_mean_ci(spark.createDataFrame(rows, "event_id string, id string, proportion double")
                               .repartition(7), "event_id", "id", "proportion").first()
    assert np.allclose(tuple(a[1:]), tuple(b[1:]), rtol=0, atol=1e-12)  # float sums: order only


def test_draws_equal_the_integer_hash_also_above_32_bits(spark):
    slots = [(b, j) for b in (1, 2, 99) for j in (1, 2, 2 ** 32 - 1, 2 ** 32, 2 ** 40 + 7)]
    n = 10 ** 10 + 19
    df = spark.createDataFrame([(b, j) for b, j in slots], "b long, j long")
    got = [r.idx for r in bootstrap.with_draws(df.coalesce(1), 3437, n).collect()]
    assert got == [_draw(3437, b, j, n) + 1 for b, j in slots]
    assert max(got) > 2 ** 32


def test_replicates_are_independent_with_many_units(spark):
    """At 5 million units: counts of a unit spread as drawing with replacement does in theory,
    neighbouring replicates are uncorrelated, also shifted, and replicate means have the right spread."""
    n, replicates = 5_000_000, 4
    slots = spark.range(0, n * replicates, numPartitions=16)
    drawn = bootstrap.with_draws(slots.select((F.expr(f"id div {n}") + 1).alias("b"), (F.col("id") % n + 1).alias("j")),
                                 bootstrap.SEED, n)
    of = drawn.groupBy("idx").agg(*[F.count_if(F.col("b") == b).alias(f"w{b}") for b in range(1, replicates + 1)])
    pairs = [(b, b + 1) for b in range(1, replicates)]
    # A value of each unit that is no function of the draws.
    value = (F.pmod(F.xxhash64("idx"), F.lit(1_000_003)) / 1_000_003.0).alias("v")
    r = of.withColumn("v", value).agg(
        *[F.sum(F.col(f"w{b}") ** 2).alias(f"s{b}") for b in range(1, replicates + 1)],
        *[F.sum(F.col(f"w{b}") * F.col("v")).alias(f"m{b}") for b in range(1, replicates + 1)],
        *[F.sum(F.col(f"w{a}") * F.col(f"w{b}")).alias(f"c{a}") for a, b in pairs]).first()
    all_of = spark.range(1, n + 1).select(F.col("id").alias("idx")).select(value).agg(F.avg("v"), F.stddev_pop("v")).first()
    for b in range(1, replicates + 1):
        assert abs(r[f"s{b}"] / n - 2) < 0.01  # E w^2 = 2 - 1/n
        assert abs(r[f"m{b}"] / n - all_of[0]) < 4.5 * all_of[1] / math.sqrt(n)
    for a, _ in pairs:
        assert abs(r[f"c{a}"] / n - 1) < 0.005  # copies of a replicate would give 2


SECTORS = ["beverages", "food", "household", "retail"]


def _pack_rows(n=34, seed=8):
    rng = np.random.default_rng(seed)
    mass = 10 ** rng.uniform(8.0, 12.0, n)
    mean = 10 ** np.clip(-1.0 + 0.9 * (np.log10(mass) - 11.5) + rng.normal(0, 0.6, n), -6.4, -0.3)
    mean[0], mean[1] = 10 ** -6.4, 10 ** -0.3  # the range of the histogram below
    weight = rng.integers(1_000, 900_000, n)
    return [(f"Company, {i}", SECTORS[i % 4], int(weight[i]), float(mean[i]), float(mass[i])) for i in range(n)]


@pytest.fixture(scope="module")
def rows():
    return _pack_rows()


@pytest.fixture(scope="module")
def pack(spark, rows, tmp_path_factory):
    path = tmp_path_factory.mktemp("pack") / "pack.csv"
    with path.open("w", newline="") as f:
        w = csv.writer(f)
        w.writerow(["Company name", "ID", "Sector (EMF input)", "2021 total weight of new packaging (metric tonnes)",
                    "mean", "mass"])
        for i, (name, sector, weight, mean, mass) in enumerate(rows):
            w.writerow([name, f"Q{i}", sector, f"{weight:,}", repr(mean), repr(mass)])
    df = read_csv(spark, str(path))
    return df.select(F.col("mean").cast("double").alias("mean"), F.col("mass").cast("double").alias("mass"),
                     F.col("`Sector (EMF input)`").alias("sector"),
                     F.col("`2021 total weight of new packaging (metric tonnes)`").alias("w"))


def _ols(x, y):
    """Least squares by the normal equations in matrix form."""
    m = np.stack([np.ones_like(x), x], axis=1)
    coef, _, _, _ = np.linalg.lstsq(m, y, rcond=None)
    res = y - m @ coef
    dof = len(x) - 2
    se = np.sqrt(np.diag(np.linalg.inv(m.T @ m)) * (res @ res) / dof)
    r2 = 1 - (res @ res) / ((y - y.mean()) ** 2).sum()
    return coef, se, r2, dof


def _t_two_sided(t, dof):
    """Tail area of the t density by Simpson's rule after u = 1 / x."""
    c = math.exp(math.lgamma((dof + 1) / 2) - math.lgamma(dof / 2)) / math.sqrt(dof * math.pi)
    u = np.linspace(1e-9, 1 / abs(t), 200_001)
    f = c * (1 + 1 / (u * u * dof)) ** (-(dof + 1) / 2) / (u * u)
    h = u[1] - u[0]
    return 2 * h / 3 * (f[0] + f[-1] + 4 * f[1:-1:2].sum() + 2 * f[2:-1:2].sum())


def _logs(rows):
    return np.log10([r[4] / 390700000 for r in rows]), np.log10([r[3] for r in rows])


def test_ols_log_log(pack, rows):
    fit = stats.ols(pack, F.log10("mean"), F.log10(F.col("mass") / 390700000)).first()
    coef, se, r2, dof = _ols(*_logs(rows))
    assert (fit.intercept, fit.slope) == pytest.approx(tuple(coef), rel=1e-9)
    assert (fit.se_intercept, fit.se_slope) == pytest.approx(tuple(se), rel=1e-9)
    assert fit.t_slope == pytest.approx(coef[1] / se[1], rel=1e-9)
    assert fit.r2 == pytest.approx(r2, rel=1e-9) and fit.df == dof
    assert fit.adj_r2 == pytest.approx(1 - (1 - r2) * (dof + 1) / dof, rel=1e-9)


def test_pvalues(pack, rows):
    logd = pack.select(F.log10("mean").alias("y"), F.log10(F.col("mass") / 390700000).alias("x"))
    p = {r.term: r for r in stats.ml_coefficients(logd, "y", "x").collect()}
    coef, se, _, dof = _ols(*_logs(rows))
    assert p["slope"].p_value == pytest.approx(_t_two_sided(coef[1] / se[1], dof), rel=1e-4)
    assert p["intercept"].p_value == pytest.approx(_t_two_sided(coef[0] / se[0], dof), rel=1e-4)


def test_parse_number_total(pack, rows):
    from auditspark.functions import rsem

    assert pack.agg(F.sum(rsem.parse_number("w"))).first()[0] == pytest.approx(sum(r[2] for r in rows))


def test_group_fits_with_all(pack, rows):
    food = F.col("sector").isin("beverages", "food")
    s = pack.select(F.when(food, "Food and Beverage").otherwise("Household and Retail").alias("sector"),
                    F.log10("mean").alias("y"), F.log10(F.col("mass") / 390700000).alias("x"))
    fits = {r.sector: r for r in stats.ols_with_all(s, F.col("y"), F.col("x"), "sector").collect()}
    for name, own in (("Food and Beverage", SECTORS[:2]), ("Household and Retail", SECTORS[2:]), ("All", SECTORS)):
        part = [r for r in rows if r[1] in own]
        coef, _, _, _ = _ols(*_logs(part))
        assert fits[name].slope == pytest.approx(coef[1], rel=1e-9) and fits[name].n == len(part)


def test_histogram(pack, rows):
    """34 values from -6.4 to -0.3: seven whole-number classes, closed on the right."""
    h = stats.histogram(pack, F.log10("mean")).orderBy("bin").collect()
    assert (h[0].lower, h[-1].upper) == (-7.0, 0.0)
    y = _logs(rows)[1]
    assert [r["count"] for r in h] == [int(((y > k) & (y <= k + 1)).sum()) for k in range(-7, 0)]


@pytest.mark.parametrize("lo, up, cells, breaks", [
    (0.0, 1.0, 5, [0, 0.2, 0.4, 0.6, 0.8, 1]),
    (1.0, 99.0, 6, [0, 20, 40, 60, 80, 100]),
    (1.0, 99.0, 7, [0, 10, 20, 30, 40, 50, 60, 70, 80, 90, 100]),  # a cell of 14 still steps by 10
    (0.0, 14.0, 10, [0, 1, 2, 3, 4, 5, 6, 7, 8, 9, 10, 11, 12, 13, 14]),
    (0.0, 15.0, 10, [0, 2, 4, 6, 8, 10, 12, 14, 16]),
    (-0.03, 0.05, 4, [-0.04, -0.02, 0, 0.02, 0.04, 0.06]),
    (0.0, 75.0, 10, [0, 10, 20, 30, 40, 50, 60, 70, 80]),
    (4.0, 4.0, 1, [0, 5]),
    (5.0, 5.0, 1, [0, 5]),  # one value on a break point: a step towards zero
    (-5.0, -5.0, 1, [-5, 0]),
])
def test_round_break_points(lo, up, cells, breaks):
    assert stats.pretty_breaks(lo, up, cells) == pytest.approx(breaks)


def test_histogram_of_a_column_without_values(spark):
    df = spark.createDataFrame([(None,)], "x double")
    assert stats.sturges(34) == 7 and stats.histogram(df, F.col("x")).collect() == []


def test_several_fits_in_one_pass(spark, pack):
    pairs = {"raw": (F.col("mean"), F.col("mass")), "log": (F.log10("mean"), F.log10("mass"))}
    got = {r.model: r for r in stats.ols_models(pack, pairs).collect()}
    for name, (y, x) in pairs.items():
        one = stats.ols(pack, y, x).first()
        assert all(got[name][c] == pytest.approx(one[c], rel=1e-12) for c in one.asDict())


def test_a_scalar_has_one_row(spark):
    df = spark.range(3)
    assert ordered.attach_scalar(df, spark.createDataFrame([(7, None)], "a int, b int")).count() == 3
    assert ordered.attach_scalar(df, spark.createDataFrame([], "a int")).collect() == []
    with pytest.raises(Exception, match="one row"):
        ordered.attach_scalar(df, spark.createDataFrame([(1,), (2,)], "a int")).collect()


def test_points_outside_the_axes_are_left_out(spark):
    from auditspark.plans.queries import products

    rows = [("food", 1e-3, 1e-2), ("beverages", 0.2, 0.1), ("oil", 1e-7, 1e-2), ("home", 1e-3, 1e-9), ("home", 0.1, 1.0)]
    df = spark.createDataFrame(rows, "Sector string, global_percent double, mean double")
    got = sorted((r.sector, round(r.x, 6), round(r.y, 6)) for r in products.within_limits(df).collect())
    assert got == [("Food and Beverage", 0.1, 1.0), ("Household and Retail", 10.0, 100.0)]


def test_ranks_ties_and_running_share(spark):
    """A company list with six equal means: average ranks, running sums, the count to half."""
    mean = [round(0.11 * 0.9 ** k, 8) for k in range(40)]
    mean[20:26] = [mean[20]] * 6
    top = spark.createDataFrame([(f"q{k:03d}", m) for k, m in enumerate(mean)], "id string, mean double")
    r = {x.row_pos: x for x in ordered.rank_desc_avg_ties(top, "mean", "id").collect()}
    upto = np.cumsum(mean)
    for k in range(40):
        assert r[k + 1].cumulative == pytest.approx(upto[k], abs=1e-12)
        assert r[k + 1]["rank"] == (23.5 if 20 <= k < 26 else k + 1)
    pos = ordered.global_positions(top, [F.desc("mean"), F.asc("id")], "mean")
    assert ordered.count_below(pos, "cumulative", 0.5, "n").first().n == int((upto < 0.5).sum()) + 1


def test_ranks_keep_rows_without_a_value(spark):
    df = spark.createDataFrame([("a", 3.0), ("b", None), ("c", 1.0), ("d", 3.0), ("e", None)], "id string, x double")
    got = {r.id: (r["rank"], r.cumulative) for r in ordered.rank_desc_avg_ties(df, "x", "id").collect()}
    # nrow is 5; ascending ranks among the three known values are 2.5, 1 and 2.5.
    assert got == {"a": (3.5, 3.0), "d": (3.5, 6.0), "c": (5.0, 7.0), "b": (None, None), "e": (None, None)}


def test_top_with_ties_against_a_plain_rank(spark):
    values = [5, 5, 4, None, 4, 4, 3, 2, 2, 1, None] + [0] * 50
    df = spark.createDataFrame(list(enumerate(values)), "k int, x int")
    for n in (1, 2, 3, 6, 7, 10, 60, 61):
        got = sorted((r.k, r["rank"]) for r in ordered.top_with_ties(df, "x", n).collect())
        rank = [1 + sum(w is not None and (v is None or w > v) for w in values) for v in values]
        assert got == sorted((k, r) for k, r in enumerate(rank) if r <= n)


def test_t_distribution_and_band(spark, pack):
    from auditspark.functions.tdist import t_quantile, t_two_sided_p

    assert t_two_sided_p(4.688314, 32) == pytest.approx(_t_two_sided(4.688314, 32), rel=1e-5)
    assert t_two_sided_p(12.867284, 32) == pytest.approx(_t_two_sided(12.867284, 32), rel=1e-4)
    assert t_quantile(0.975, 32) == pytest.approx(2.036933, rel=1e-6)
    assert t_quantile(0.025, 10) == pytest.approx(-2.228139, rel=1e-6)
    y, x = F.log10("mean"), F.log10(F.col("mass") / 390700000)
    fit = stats.ols(pack, y, x)
    band = stats.confidence_band(pack, fit, y, x).collect()
    f = fit.first()
    assert len(band) == pack.select(x).distinct().count()
    for r in band:
        half = 2.036933 * f.sigma * math.sqrt(1 / 34 + (r.x - f.mean_x) ** 2 / f.sxx)
        assert r.upper - r.fitted == pytest.approx(half, rel=1e-5)
        assert r.fitted - r.lower == pytest.approx(half, rel=1e-5)


def test_draws_are_packed_in_two_bytes(spark):
    """What is shuffled of a draw is its place in its range; the draws are those of ``with_draws``."""
    import numpy as np

    n = 5000
    rows = bootstrap.packed_draws(spark, n, 3, 6).collect()
    got = sorted((r.b, int(p) + (r._r << bootstrap.RANGE_BITS) + 1) for r in rows for p in np.frombuffer(r.drawn, "<u2"))
    want = sorted((b, _draw(3437, b, j, n) + 1) for b in range(3, 7) for j in range(1, n + 1))
    assert got == want and sum(len(r.drawn) for r in rows) == 2 * 4 * n


def test_bootstrap_of_a_unit_with_many_groups(spark, monkeypatch):
    """A range with many rows is split over tasks and few held groups are emitted often, with the same result."""
    rows = [(f"e{u}", f"g{g:03d}", (u * 7 + g) % 11 / 10) for u in range(30) for g in range(120) if u == 3 or (u + g) % 9 == 0]
    df = spark.createDataFrame(rows, "event_id string, id string, proportion double")
    plain = sorted(bootstrap.boot_mean_ci(df, "event_id", "id", "proportion", replicates=25).collect())
    monkeypatch.setattr(bootstrap, "PART_ROWS", 20)
    monkeypatch.setattr(bootstrap, "HELD", 1)
    split = sorted(bootstrap.boot_mean_ci(df, "event_id", "id", "proportion", replicates=25).collect())
    assert [r.id for r in plain] == [r.id for r in split] and len(plain) == 120
    assert all(abs(x - y) < 1e-12 for a, b in zip(plain, split) for x, y in zip(a[1:], b[1:]))


def test_draws_are_shuffled_as_gaps(spark):
    """The lists that the replicate sums shuffle hold the same draws in a few bits each."""
    import numpy as np

    for places in ([0], [4095], [0, 0, 0, 4095, 4095], [254, 509, 510, 1020], list(range(4096))):
        assert list(bootstrap.decoded(bootstrap.coded(np.array(places, "<u2")))) == places
    n = 5000
    rows = bootstrap.packed_draws(spark, n, 3, 6, gaps=True).collect()
    got = sorted((r.b, int(p) + (r._r << bootstrap.RANGE_BITS) + 1) for r in rows for p in bootstrap.decoded(r.drawn))
    want = sorted((b, _draw(3437, b, j, n) + 1) for b in range(3, 7) for j in range(1, n + 1))
    assert got == want and sum(len(r.drawn) for r in rows) < 0.5 * 4 * n


def test_bootstrap_joins_units_and_sums_replicates_once(spark):
    """The quantiles, zero counts and means read written tables: none of them joins the units or sums the draws again."""
    rows = [(f"e{u}", f"g{g}", 1.0 / (u + 1)) for u in range(9) for g in range(3) if (u + g) % 2]
    ci = bootstrap.boot_mean_ci(spark.createDataFrame(rows, "event_id string, id string, proportion double"),
                                "event_id", "id", "proportion", replicates=20)
    plan = ci._jdf.queryExecution().toString()
    assert "MapInArrow" not in plan and "event_id" not in plan
