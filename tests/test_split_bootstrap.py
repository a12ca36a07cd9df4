import numpy as np
import pytest
from pyspark.sql import functions as F

from auditspark.operators import bootstrap, split_bootstrap
from auditspark.operators.split_bootstrap import BLOCK, RANGE_BITS, Weights


def all_weights(n, block=0, seed=3437):
    w = Weights(n, seed)
    return np.concatenate([w.of_range(r, block) for r in range(-(-n // (1 << RANGE_BITS)))], axis=1)


@pytest.mark.parametrize("n", [1, 2, 3, 7, 255, 256, 257, 1000, 4097])
def test_weights_of_a_replicate_sum_to_n(n):
    w = all_weights(n)
    assert w.shape == (BLOCK, n) and (w >= 0).all() and (w.sum(axis=1) == n).all()


def test_weights_are_multinomial():
    """Moments of a multinomial vector: mean 1, variance 1 - 1/n, covariance -1/n, also across ranges."""
    n = 600
    w = np.concatenate([all_weights(n, b) for b in range(12)]).astype(float)
    b = len(w)
    assert abs(w.mean(axis=0) - 1).max() < 5 * np.sqrt(1 / b)
    assert abs(w.var(axis=0) - (1 - 1 / n)).max() < 5 * np.sqrt(3 / b)
    # Sums over sets of units: variance |S| (1 - |S|/n), whatever ranges they lie in.
    for own in (slice(0, 300), slice(200, 400), slice(0, n, 2)):
        s = w[:, own].shape[1]
        assert abs(w[:, own].sum(axis=1).var() / (s * (1 - s / n)) - 1) < 0.08
    # The zero counts of a unit: (1 - 1/n)^n.
    assert abs((w == 0).mean() - (1 - 1 / n) ** n) < 0.002


def test_any_range_alone_gives_the_same_counts():
    n = 3000
    whole = all_weights(n, 3)
    assert (Weights(n).of_range(7, 3) == whole[:, 7 << RANGE_BITS:8 << RANGE_BITS]).all()
    assert not (Weights(n, 1).of_range(7, 3) == whole[:, 7 << RANGE_BITS:8 << RANGE_BITS]).all()


def rows(n=700, groups=5, seed=2):
    rng = np.random.default_rng(seed)
    return [(f"e{u:05d}", f"g{g}", float(v)) for u in range(n) for g in range(groups)
            if rng.random() < 0.4 for v in [rng.random()]]


def test_sums_against_all_weights(spark):
    data = rows(700) + [("e00003", None, 0.5), ("e00003", "g1", 0.25), (None, "g1", 9.0), ("e00005", "g2", None)]
    df = spark.createDataFrame(data, "u string, g string, v double").repartition(6)
    got = {r.g: r for r in split_bootstrap.boot_mean_ci_split(df, "u", "g", "v", replicates=1500).collect()}
    names = sorted({u for u, _, v in data if u is not None and v is not None})
    w = np.concatenate([all_weights(len(names), b) for b in range(2)])[:1500]
    for g in {g for _, g, _ in data}:
        v = np.zeros(len(names))
        for u, own, value in data:
            if own == g and u is not None and value is not None:
                v[names.index(u)] += value
        means = w @ v / len(names)
        want = [np.quantile(means, 0.975), v.mean(), np.quantile(means, 0.025), means.mean(), means.std(ddof=1)]
        assert np.allclose([got[g].high, got[g].mean, got[g].low, got[g].boot_mean, got[g].boot_sd], want, rtol=1e-9)


def test_agrees_with_the_other_draws(spark):
    """Both intervals estimate the same quantiles: they differ by Monte Carlo error only."""
    df = spark.createDataFrame(rows(400, 4), "u string, g string, v double")
    ours = {r.g: r for r in split_bootstrap.boot_mean_ci_split(df, "u", "g", "v", replicates=4000).collect()}
    other = {r.g: r for r in bootstrap.boot_mean_ci(df, "u", "g", "v", replicates=1000).collect()}
    for g, r in ours.items():
        # A 2.5 % quantile of B draws has a standard error of about 2.7 sd / sqrt(B).
        error = 2.7 * r.boot_sd * np.sqrt(1 / 4000 + 1 / 1000)
        assert abs(r.low - other[g].low) < 4 * error and abs(r.high - other[g].high) < 4 * error
        assert abs(r.mean - other[g].mean) < 1e-12


def test_shuffle_does_not_grow_with_the_units(spark):
    """Vectors that leave the tasks: at most one a group and task, however many units there are."""
    counts = []
    for n in (16_000, 64_000):
        x = spark.range(n).select(F.col("id").alias("idx"), (F.col("id") % 3).cast("string").alias("_g"), F.rand(1).alias("_v"))
        counts.append(split_bootstrap.replicate_sums(x, n, 100).count())
    assert counts[0] == counts[1] == 3 * int(spark.conf.get("spark.sql.shuffle.partitions"))


def test_a_range_with_many_rows_is_split(spark, monkeypatch):
    monkeypatch.setattr(split_bootstrap, "PART_ROWS", 50)
    x = spark.range(400).select(F.lit(3).cast("long").alias("idx"), F.col("id").cast("string").alias("_g"), F.lit(1.0).alias("_v"))
    parts = split_bootstrap.replicate_sums(x.unionByName(x.limit(0)), 10, 20)
    w = all_weights(10)[:20, 3]
    got = parts.withColumn("_p", F.spark_partition_id()).collect()
    assert len({r._p for r in got}) > 1 and all((np.frombuffer(r._sums) == w).all() for r in got) and len(got) == 400


def test_small_memory_emits_more_but_equal(spark):
    df = spark.createDataFrame(rows(300, 6), "u string, g string, v double")
    x = df.select(F.substring("u", 2, 5).cast("long").alias("idx"), F.col("g").alias("_g"), F.col("v").alias("_v"))

    def summed(parts):
        out = {}
        for r in parts.collect():
            out[r._g] = out.get(r._g, 0) + np.frombuffer(r._sums)
        return out

    a, b = (summed(split_bootstrap.replicate_sums(x, 300, 50, held=h)) for h in (1, 64 << 20))
    assert a.keys() == b.keys() and all(np.allclose(a[g], b[g]) for g in a)


def test_empty(spark):
    assert split_bootstrap.boot_mean_ci_split(spark.createDataFrame([], "u string, g string, v double"), "u", "g", "v").collect() == []


def test_ranges_that_follow_share_their_upper_nodes(monkeypatch):
    """Above the ranges each node is drawn about once, not once a range; below, a range's nodes are drawn a level at a time."""
    calls = []
    split = Weights._split
    monkeypatch.setattr(Weights, "_split", lambda self, block, level, node, counts: calls.append((level, node)) or split(self, block, level, node, counts))
    n, ranges = 1 << 20, 64
    w = Weights(n)
    for r in range(ranges):
        w.of_range(r, 0)
    top = w.depth - RANGE_BITS
    above = [c for c in calls if c[0] < top]
    assert len(above) <= 2 * ranges + top and len(calls) - len(above) <= 8 * ranges


@pytest.mark.parametrize("share", [0.01, 0.9])
def test_weighted_sums_full_and_sparse(share):
    rng = np.random.default_rng(4)
    weights = rng.integers(0, 5, (256, 30)).astype(float)
    place = np.nonzero(rng.random((256, 7)) < share)[0]
    group = np.sort(np.arange(len(place)) % 3)
    values, starts = rng.random(len(place)), np.searchsorted(group, np.unique(group))
    got = bootstrap.weighted_sums(weights, place, values, starts)
    want = [sum(weights[p] * v for p, v in zip(place[group == g], values[group == g])) for g in np.unique(group)]
    assert np.allclose(got, want, rtol=1e-12)
