"""Bootstrap confidence intervals of a mean (A19 / X1, ``BootMean``).

The reference resamples the n values of a group B times with one fixed seed
(so equal-sized groups see the same resample indices) and reports the 2.5 % and
97.5 % type-7 quantiles of the B means. On the zero-filled company grid every
company has one value per event, so replicate b of company c is

    mean_b(c) = sum_e w[b, e] * p[e, c] / N

where ``w[b, e]`` is how often event e is drawn in replicate b. Events where the
company is absent add 0, so the sum runs over the sparse (event, company)
rows only. The draws are one distributed table of B x N rows keyed by 60
bits of the md5 of (seed, b, j): reproducible on any partitioning, and identical in
DuckDB's SQL. Draws are gathered per replicate, range of units and task as the gaps between their sorted places in
the range, a few bits each; it is these lists and the share rows that are shuffled, by range. A task counts its ranges' draws,
multiplies them with the shares and emits each company's sums once. Replicates go in blocks of
``REPLICATE_BLOCK``, so a range's counts stay small for any B.

A company that misses every drawn event of a replicate has no row for it; its
mean there is 0. Instead of densifying companies x replicates, the quantile is
taken with ``percentile(value, p, frequency)`` over the non-zero replicate means
plus one zero row weighted by the number of missing replicates - the same
multiset, so the same type-7 quantile.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from auditspark.operators.ordered import attach_scalar, dense_index

# Replicate count and seed of the reference, and its quantiles.
REPLICATES = 100
SEED = 3437
PROBS = (0.025, 0.975)


# Hexadecimal digits of the draw hash that are used: 60 bits, so the result fits in a BIGINT and
# any number of units can be drawn.
HASH_DIGITS = 15


def with_draws(df: DataFrame, seed: int, n_units: int) -> DataFrame:
    """From (b, j): (b, idx), the index 1..N of the j-th draw of replicate b: the
    leading bits of md5("seed:b:j") modulo N. Replicates share no state, so none
    is a shifted copy of another however many units there are."""
    digits = F.substring(F.md5(F.concat_ws(":", F.lit(seed), "b", "j")), 1, HASH_DIGITS)
    return df.select("b", (F.conv(digits, 16, 10).cast("bigint") % F.lit(n_units) + 1).alias("idx"))


def draws_sql(seed: int, units: str, count: str, replicates: int = REPLICATES) -> tuple[tuple[str, str], ...]:
    """The same draws as a DuckDB CTE ``draws`` (b, idx); ``units`` has a column idx, ``count`` one row n."""
    return (("draws", f"SELECT t.b, CAST('0x' || substr(md5('{seed}:' || t.b || ':' || e.idx), 1, {HASH_DIGITS}) AS BIGINT) "
                      f"% c.n + 1 AS idx FROM range(1, {replicates + 1}) t(b), {units} e, {count} c"),)


# Share of the units from which a group's values are multiplied as a full row.
FULL = 1 / 32


def weighted_sums(weights: np.ndarray, place: np.ndarray, values: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """(groups, replicates): each group's values times the weights (units, replicates) of their units, added up.
    Groups begin at ``starts``; ``place`` is the row of a value's unit."""
    units = len(weights)
    if len(values) < FULL * units * len(starts):
        return np.add.reduceat(weights[place] * values[:, None], starts, axis=0)
    group = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(values))))
    return np.bincount(group * units + place, values, len(starts) * units).reshape(len(starts), units) @ weights


# Draw slots per task when generating the B x N draws and, of one range, summing them; replicates whose draws are
# held together.
DRAWS_PER_TASK = 2_000_000
DRAWS_PER_SUM = 32_000_000
REPLICATE_BLOCK = 200
#: Units of one range: a draw is stored as its unit's place in it, two bytes, or the gap to the place before.
RANGE_BITS = 12
#: Rows of one range that one task takes, and bytes of sums that a task holds before it emits them.
PART_ROWS = 1_000_000
HELD = 64 << 20


#: In a list of gaps, a step of that many places at which nothing is drawn.
STEP = 255


def coded(places: np.ndarray) -> bytes:
    """Sorted places of a range as Huffman-coded gaps: about two bits a place where a list has as many as its range."""
    gaps = np.diff(places.astype(np.int64), prepend=0)
    steps = gaps // STEP
    out = np.full(len(gaps) + int(steps.sum()), STEP, np.uint8)
    out[np.arange(len(gaps)) + np.cumsum(steps)] = gaps % STEP
    packer = zlib.compressobj(1, zlib.DEFLATED, -9, 6, zlib.Z_HUFFMAN_ONLY)
    return packer.compress(out.tobytes()) + packer.flush()


def decoded(drawn: bytes) -> np.ndarray:
    """The places that ``coded`` was given."""
    gaps = np.frombuffer(zlib.decompress(drawn, -9), np.uint8)
    return np.cumsum(gaps, dtype=np.int64)[gaps != STEP]


def packed_draws(spark, n_units: int, first: int, last: int, seed: int = SEED, gaps: bool = False) -> DataFrame:
    """(_r, b, drawn): of the replicates from ``first`` to ``last`` the draws in each range of units, as 16-bit places
    within the range or, with ``gaps``, as ``coded`` makes of these; a replicate's draws in a range may come in several
    rows.

    The draw slots come from ``spark.range`` with a partition count sized
    to the number of slots, so generation is spread evenly over the cluster no
    matter how small the unit table is (AQE would otherwise pack the units - and
    a 100-fold explosion of them - into a handful of tasks). Only the scalar N
    comes from the driver."""
    slots = (last - first + 1) * n_units
    parts = max(spark.sparkContext.defaultParallelism, -(-slots // DRAWS_PER_TASK))
    r = spark.range(0, slots, numPartitions=parts)
    slot = r.select((F.expr(f"id div {n_units}") + first).cast("bigint").alias("b"),
                    (F.col("id") % n_units + 1).cast("bigint").alias("j"))
    ranges = -(-n_units // (1 << RANGE_BITS))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # One number a draw: replicate, range and place.
        own = [(b.column(0).to_numpy() * ranges << RANGE_BITS) + b.column(1).to_numpy() - 1 for b in batches]
        if not own:
            return
        draws = np.sort(np.concatenate(own))
        key = draws >> RANGE_BITS
        starts = np.concatenate([[0], np.flatnonzero(np.diff(key)) + 1]) if len(key) else key
        ends = np.append(starts, len(key))
        places = (draws & ((1 << RANGE_BITS) - 1)).astype("<u2")
        if gaps:
            drawn = pa.array([coded(places[lo:hi]) for lo, hi in zip(ends, ends[1:])], pa.binary())
        else:
            offsets = pa.py_buffer(ends.astype(np.int32) * 2)
            drawn = pa.Array.from_buffers(pa.binary(), len(starts), [None, offsets, pa.py_buffer(places)])
        yield pa.RecordBatch.from_arrays([pa.array(key[starts] % ranges), pa.array(key[starts] // ranges), drawn],
                                         ["_r", "b", "drawn"])

    return with_draws(slot, seed, n_units).mapInArrow(run, "_r long, b long, drawn binary")


def replicate_sums(x: DataFrame, n_units: int, first: int, last: int, seed: int = SEED) -> DataFrame:
    """From (idx 1..N, _g, _v) rows: (_g, b, _s), some sums of the values drawn in a replicate per group and task.
    A replicate in which none of a group's rows is drawn has no row; one that draws nulls only has a null."""
    kind = x.schema["_g"].dataType.simpleString()
    size = last - first + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict = {}
        arrow = None
        near, weights = None, np.zeros((1 << RANGE_BITS, size))

        def out() -> pa.RecordBatch:
            total = np.stack(list(sums.values()))
            group, b = np.nonzero(total[:, 2] > 0)
            return pa.RecordBatch.from_arrays(
                [pa.array(list(sums), arrow).take(pa.array(group)), pa.array(b + first),
                 pa.array(total[group, 0, b], mask=total[group, 1, b] == 0)], ["_g", "b", "_s"])

        for batch in batches:
            arrow = batch.schema.field("_g").type
            if not batch.num_rows:
                continue
            part = np.stack([batch.column(0).to_numpy(), batch.column(1).to_numpy()])
            cuts = np.flatnonzero((part[:, 1:] != part[:, :-1]).any(axis=0)) + 1
            for lo, hi in zip([0, *cuts], [*cuts, batch.num_rows]):
                rows = batch.slice(lo, hi - lo)
                if near != tuple(part[:, lo]):
                    near = tuple(part[:, lo])
                    weights[:] = 0.0
                # A range's draws stand before its values.
                drawn = rows.column(6).is_valid().to_numpy(zero_copy_only=False)
                many = int(drawn.sum())
                for b, places in zip(rows.column(5)[:many].to_pylist(), rows.column(6)[:many]):
                    weights[:, b - first] += np.bincount(decoded(places.as_buffer()), minlength=len(weights))
                rows = rows.slice(many)
                if not rows.num_rows:
                    continue
                groups = rows.column(3).dictionary_encode()
                codes = groups.indices.fill_null(len(groups.dictionary)).to_numpy()
                names = groups.dictionary.to_pylist() + [None]
                order = np.argsort(codes, kind="stable")
                codes = codes[order]
                place = (rows.column(2).to_numpy()[order] - 1) & (len(weights) - 1)
                known = rows.column(4).is_valid().to_numpy(zero_copy_only=False)[order].astype(float)
                values = rows.column(4).fill_null(0.0).to_numpy()[order]
                starts = np.concatenate([[0], np.flatnonzero(np.diff(codes)) + 1])
                for at in range(0, len(starts), 64):
                    some = starts[at:at + 64]
                    own = slice(some[0], starts[at + 64] if at + 64 < len(starts) else len(codes))
                    some = some - some[0]
                    any_row = weighted_sums(weights, place[own], np.ones(own.stop - own.start), some)
                    hits = any_row if known[own].all() else weighted_sums(weights, place[own], known[own], some)
                    added = weighted_sums(weights, place[own], values[own], some)
                    for j, code in enumerate(codes[own][some]):
                        if names[code] not in sums:
                            sums[names[code]] = np.zeros((3, size))
                        sums[names[code]] += (added[j], hits[j], any_row[j])
                if len(sums) * 3 * size * 8 > HELD:
                    yield out()
                    sums.clear()
        if sums:
            yield out()

    rows = x.withColumn("_r", F.shiftright(F.col("idx") - 1, RANGE_BITS))
    # A range with very many rows (a unit that most groups have) is split, and its draws go to every part. Such
    # ranges are few: each has more than PART_ROWS rows.
    many = F.broadcast(rows.groupBy("_r").agg(F.ceil(F.count(F.lit(1)) / F.lit(PART_ROWS)).alias("_k")).where(F.col("_k") > 1))
    draws = (packed_draws(x.sparkSession, n_units, first, last, seed, gaps=True).join(many, "_r", "left")
             .withColumn("_s", F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce("_k", F.lit(1)) - 1)))
             .select("_r", "_s", F.lit(None).cast("long").alias("idx"), F.lit(None).cast(kind).alias("_g"),
                     F.lit(None).cast("double").alias("_v"), "b", "drawn"))
    dealt = (rows.join(many, "_r", "left").withColumn("_s", F.pmod(F.xxhash64("idx", "_g"), F.coalesce("_k", F.lit(1))))
             .select("_r", "_s", "idx", "_g", F.col("_v").cast("double").alias("_v"),
                     F.lit(None).cast("long").alias("b"), F.lit(None).cast("binary").alias("drawn")))
    spark = x.sparkSession
    parts = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")),
                -(-size * n_units // DRAWS_PER_SUM))
    return (draws.unionByName(dealt).repartition(parts, "_r", "_s").sortWithinPartitions("_r", "_s", F.col("b").isNull())
            .mapInArrow(run, f"_g {kind}, b long, _s double"))


def boot_mean_ci(values: DataFrame, unit_col: str, group_col: str | None, value_col: str,
                 replicates: int = REPLICATES, seed: int = SEED, zero_fill: bool = True,
                 probs: tuple[float, float] = PROBS) -> DataFrame:
    """Per group: ``mean`` plus ``low``/``high`` bootstrap quantiles of the mean.

    ``values`` holds (unit, group, value) rows. With ``zero_fill`` every group is
    averaged over all N units (absent = 0, the company grid of the reference);
    without it there is a single group of all units (``group_col=None``)."""
    from auditspark.operators.ordered import materialize

    # Read twice below (index, rows by index): computed once into the shared checkpoint folder.
    values = materialize(values.select(unit_col, *([group_col] if group_col else []), value_col))
    units = dense_index(values, [unit_col], "idx")
    n_units = units.count()
    n = values.sparkSession.createDataFrame([(n_units,)], "_n bigint")
    gcols = [group_col] if group_col else []
    # Read by the replicate sums, their ranges' sizes and the means: the units are joined once.
    x = materialize(values.join(units, unit_col).select(*gcols, "idx", F.col(value_col).alias("_v")))
    rows = x.select("idx", (F.col(group_col) if group_col else F.lit("")).alias("_g"), "_v")
    reps = None
    for first in range(1, replicates + 1, REPLICATE_BLOCK):
        sums = replicate_sums(rows, n_units, first, min(replicates, first + REPLICATE_BLOCK - 1), seed)
        block = (sums.groupBy("_g", "b").agg(F.sum("_s").alias("_s"))
                 .select(*[F.col("_g").alias(g) for g in gcols], "b", "_s"))
        reps = block if reps is None else reps.unionByName(block)
    # Read by the quantiles and the zero counts: at most ``replicates`` rows a group.
    reps = materialize(attach_scalar(reps, n).select(*gcols, "b", (F.col("_s") / F.col("_n")).alias("_m")))
    means = attach_scalar(x.groupBy(*gcols).agg(F.sum("_v").alias("_t")), n).select(
        *gcols, (F.col("_t") / F.col("_n")).alias("mean"))
    if zero_fill:
        seen = reps.groupBy(*gcols).agg(F.count(F.lit(1)).alias("_k"))
        zeros = (seen.filter(F.col("_k") < replicates)
                 .select(*gcols, F.lit(0.0).alias("_m"), (F.lit(replicates) - F.col("_k")).alias("_f")))
        pool = reps.select(*gcols, "_m", F.lit(1).cast("bigint").alias("_f")).unionByName(zeros)
    else:
        pool = reps.select(*gcols, "_m", F.lit(1).cast("bigint").alias("_f"))
    q = pool.groupBy(*gcols).agg(
        F.percentile("_m", F.array(*[F.lit(p) for p in probs]), F.col("_f")).alias("_q"))
    out = q.select(*gcols, F.col("_q")[1].alias("high"), F.col("_q")[0].alias("low"))
    if gcols:
        return means.join(out, gcols).select(*gcols, "high", "mean", "low")
    return attach_scalar(means, out).select("high", "mean", "low")
