"""Bootstrap of a mean for many replicates by splittable multinomial weights (A19 / X1 at B = 10,000).

How often the N units are drawn in a replicate is one multinomial vector. It is drawn top down: the root
of a binary tree over the units holds N draws, and a node's draws go to its left half by a binomial
number, keyed by (seed, block of replicates, node). Any task therefore gets the counts of any range of units
from the path to it alone: equal in every task, on every partitioning and after every retry, with sum N in
every replicate, and without a table of draws. A task takes ranges that follow each other, so it draws the upper
nodes once; a level of a range is drawn for all its nodes and replicates at once.

Per group and replicate the weighted sum of values is needed. Sparse (unit, group, value) rows are dealt out
by ranges of units; a task draws its ranges' weights, adds up each of its groups' vector of B sums (a matrix product
where the groups have many of a range's units) and emits it once. What is shuffled is thus the rows themselves and tasks x groups x B sums: nothing grows with
B x N. A group's vectors are added up as they stream past; absent replicates are zeros, as on the
zero-filled grid, and the type-7 quantiles are taken of the B means.

Defined results: null values and units count as absent; a null group is a group; repeated (unit, group) rows add
up; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from auditspark.operators.bootstrap import PROBS, SEED, weighted_sums
from auditspark.operators.ordered import attach_scalar, dense_index, materialize

#: Replicates of the reference's full run.
FULL_REPLICATES = 10_000
#: Units of one range: the leaves below the path that a task walks.
RANGE_BITS = 8
#: Replicates that are drawn together; part of the key, so it is fixed.
BLOCK = 1_024
#: Nodes whose words are held together: they stay in a core's cache.
TOGETHER = 16
#: Rows of one range that one task takes.
PART_ROWS = 1_000_000
#: Bytes of sums that a task holds before it emits them.
HELD = 64 << 20


class Weights:
    """Draw counts of ``n`` units, by range of 2**RANGE_BITS units and block of replicates.

    The path to a range is kept, so ranges that follow each other share all but its end."""

    def __init__(self, n: int, seed: int = SEED):
        self.n, self.seed = n, seed
        self.depth = max((n - 1).bit_length(), 0)
        self._bits = np.random.Philox(key=[0, 0])
        self._start = self._bits.state
        self._paths: dict[int, list[tuple[int, np.ndarray]]] = {}

    def _words(self, block: int, level: int, node: int, many: int) -> np.ndarray:
        """The first words of a node's own stream."""
        self._start["state"]["key"][:] = (self.seed << 32) | block, (level << 56) | node
        self._bits.state = self._start
        return self._bits.random_raw(many)

    @staticmethod
    def _half(words: np.ndarray, counts: np.ndarray, most: int) -> np.ndarray:
        """The ones among as many random bits as there are draws; ``words`` (..., 64 draws, replicates)."""
        if most <= 64:
            # The upper bits of a word are all that few draws look at.
            bits = 16 if most <= 16 else 32 if most <= 32 else 64
            kind = np.dtype(f"<u{bits // 8}")
            upper = words[..., 0, :].view(kind)[..., 64 // bits - 1::64 // bits]
            return np.bitwise_count(upper >> (bits - counts).astype(kind))
        total = np.zeros_like(counts)
        for i, first_bit in enumerate(range(0, most, 64)):
            draws = np.clip(counts - first_bit, 0, 64)
            # No draw: a shift by 64 leaves nothing.
            total += np.bitwise_count(words[..., i, :] >> (64 - draws).astype(np.uint64))
        return total

    def _split(self, block: int, level: int, node: int, counts: np.ndarray) -> np.ndarray:
        """Draws of the left half of a node at ``level`` (0: the root), for every replicate of the block."""
        size = 1 << (self.depth - level)
        first = node * size
        units = min(self.n, first + size) - first
        left = min(units, size // 2)
        if left == units:
            return counts.copy()
        most = int(counts.max())
        if 2 * left != units or most > 512:
            rng = np.random.Generator(np.random.Philox(key=[(self.seed << 32) | block, (level << 56) | node]))
            return rng.binomial(counts, left / units)
        # Equal halves and few draws.
        rounds = -(-most // 64)
        words = self._words(block, level, node, rounds * BLOCK).reshape(rounds, BLOCK)
        return self._half(words, counts, most).astype(counts.dtype) if rounds else np.zeros_like(counts)

    def _children(self, block: int, level: int, node: int, own: np.ndarray) -> np.ndarray:
        """Counts of the halves of the whole nodes from ``node`` on, whose counts are the rows of ``own``."""
        most = own.max(axis=1).tolist()
        if max(most) > 512:
            left = np.stack([self._split(block, level, node + i, of) for i, of in enumerate(own)])
            return np.stack([left, own - left], axis=1).reshape(-1, BLOCK)
        if max(most) <= 64:
            own = own.astype(np.uint8)
        below = np.empty((2 * len(own), BLOCK), own.dtype)
        for lo in range(0, len(own), TOGETHER):
            some, draws = own[lo:lo + TOGETHER], most[lo:lo + TOGETHER]
            words = np.empty((len(some), max(-(-max(draws) // 64), 1), BLOCK), "<u8")
            for i, of in enumerate(draws):
                # A node reads the words that its own draws need; what follows them is not looked at.
                many = -(-of // 64)
                words[i, :many] = self._words(block, level, node + lo + i, many * BLOCK).reshape(many, BLOCK)
            left = self._half(words, some, max(draws))
            below[2 * lo:2 * lo + 2 * len(some):2] = left
            np.subtract(some, left, out=below[2 * lo + 1:2 * lo + 2 * len(some):2], casting="unsafe")
        return below

    def of_range(self, number: int, block: int) -> np.ndarray:
        """Counts (BLOCK, units) of the units from ``number << RANGE_BITS`` on, below n."""
        top = max(self.depth - RANGE_BITS, 0)
        path = self._paths.setdefault(block, [(0, np.full(BLOCK, self.n, np.int64))])
        while path[-1][0] != number >> (top - len(path) + 1):
            path.pop()
        for level in range(len(path) - 1, top):
            node, counts = path[-1]
            left = self._split(block, level, node, counts)
            below = number >> (top - level - 1)
            path.append((below, counts - left if below & 1 else left))
        counts = path[-1][1]
        if self.depth >= RANGE_BITS and (number + 1) << RANGE_BITS <= self.n and counts.max() < 1 << 31:
            below = counts.astype(np.int32)[None]
            for level in range(top, self.depth):
                below = self._children(block, level, number << (level - top), below)
            return below.T
        # The last range, where halves differ.
        nodes = [(number, counts)]
        for level in range(top, self.depth):
            size = 1 << (self.depth - level)
            below = []
            for node, own in nodes:
                left = self._split(block, level, node, own)
                below.append((2 * node, left))
                if (2 * node + 1) * (size // 2) < self.n:
                    below.append((2 * node + 1, own - left))
            nodes = below
        return np.stack([own for _, own in nodes], axis=1)


PART = "_g {kind}, _sums binary"


def replicate_sums(x: DataFrame, n: int, replicates: int, seed: int = SEED, held: int = HELD) -> DataFrame:
    """From (idx 0..n-1, _g, _v) rows: vectors of ``replicates`` weighted sums, some per group and task."""
    kind = x.schema["_g"].dataType
    blocks = -(-replicates // BLOCK)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights = Weights(n, seed)
        sums: dict = {}
        arrow = None
        near: tuple[int, list] = (-1, [])

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays(
                [pa.array(list(sums), arrow), pa.array([s[:replicates].tobytes() for s in sums.values()], pa.binary())],
                ["_g", "_sums"])

        for batch in batches:
            arrow = batch.schema.field("_g").type
            idx = batch.column(0).to_numpy()
            values = batch.column(2).to_numpy()
            groups = batch.column(1).dictionary_encode()
            codes = groups.indices.fill_null(len(groups.dictionary)).to_numpy()
            names = groups.dictionary.to_pylist() + [None]
            ranges = idx >> RANGE_BITS
            order = np.lexsort((codes, ranges))
            for part in np.split(order, np.flatnonzero(np.diff(ranges[order])) + 1):
                if not len(part):
                    continue
                number = int(ranges[part[0]])
                if near[0] != number:
                    # A range's weights, a unit a row: some megabytes.
                    near = number, [np.ascontiguousarray(weights.of_range(number, b).T, float) for b in range(blocks)]
                place = idx[part] - (number << RANGE_BITS)
                # Rows by group stand together.
                starts = np.concatenate([[0], np.flatnonzero(np.diff(codes[part])) + 1])
                for lo in range(0, len(starts), 64):
                    some = starts[lo:lo + 64]
                    own = slice(some[0], starts[lo + 64] if lo + 64 < len(starts) else len(part))
                    for code in codes[part[some]]:
                        if names[code] not in sums:
                            sums[names[code]] = np.zeros(blocks * BLOCK)
                    for b in range(blocks):
                        added = weighted_sums(near[1][b], place[own], values[part[own]], some - some[0])
                        for j, code in enumerate(codes[part[some]]):
                            sums[names[code]][b * BLOCK:(b + 1) * BLOCK] += added[j]
                if len(sums) * blocks * BLOCK * 8 > held:
                    yield out()
                    sums.clear()
        if sums:
            yield out()

    rows = x.withColumn("_r", F.shiftright("idx", RANGE_BITS))
    # A range with very many rows (a unit that most groups have) is split; its weights are drawn in each part.
    sizes = rows.groupBy("_r").agg(F.ceil(F.count(F.lit(1)) / F.lit(PART_ROWS)).alias("_k"))
    spark = x.sparkSession
    tasks = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    # The work is B times the rows, so their bytes must not decide how many tasks there are. A task takes ranges that
    # follow each other, as many as any other, and the parts of a split range go to different tasks.
    place = F.floor(F.col("_r") * tasks / F.lit(-(-n // (1 << RANGE_BITS)))) + F.col("_s")
    spread = (rows.join(sizes, "_r").withColumn("_s", F.pmod(F.xxhash64("idx", "_g"), F.col("_k")))
              .repartitionById(tasks, F.pmod(place, F.lit(tasks)).cast("int")).sortWithinPartitions("_r", "_s"))
    return spread.select("idx", "_g", "_v").mapInArrow(run, PART.format(kind=kind.simpleString()))


def _quantiles(parts: DataFrame, n: int, replicates: int, probs: tuple[float, float]) -> DataFrame:
    """low, high, boot_mean and boot_sd of each group's B means, from its vectors of sums."""
    kind = parts.schema["_g"].dataType.simpleString()
    names = ["_g", "low", "high", "boot_mean", "boot_sd"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, total, rows, arrow = None, None, [], None

        def close() -> None:
            means = total / n
            low, high = np.quantile(means, probs)
            rows.append((now, float(low), float(high), float(means.mean()), float(means.std(ddof=1)) if replicates > 1 else None))

        def out() -> pa.RecordBatch:
            columns = list(zip(*rows))
            return pa.RecordBatch.from_arrays(
                [pa.array(columns[0], arrow), *[pa.array(c, pa.float64()) for c in columns[1:]]], names)

        for batch in batches:
            arrow = batch.schema.field("_g").type
            for group, part in zip(batch.column(0).to_pylist(), batch.column(1)):
                own = np.frombuffer(part.as_py())
                if total is None or group != now:
                    if total is not None:
                        close()
                    now, total = group, np.zeros(replicates)
                total += own
            if len(rows) >= 4096:
                yield out()
                rows.clear()
        if total is not None:
            close()
        if rows:
            yield out()

    return (parts.repartition("_g").sortWithinPartitions("_g")
            .mapInArrow(run, f"_g {kind}, low double, high double, boot_mean double, boot_sd double"))


def boot_mean_ci_split(values: DataFrame, unit_col: str, group_col: str, value_col: str,
                       replicates: int = FULL_REPLICATES, seed: int = SEED,
                       probs: tuple[float, float] = PROBS) -> DataFrame:
    """Per group: the mean over all units (absent: 0), its bootstrap ``low`` and ``high``, and mean and
    standard deviation of the replicates (``boot_mean``, ``boot_sd``)."""
    values = materialize(values.select(F.col(unit_col).alias("_u"), F.col(group_col).alias("_g"),
                                       F.col(value_col).cast("double").alias("_v"))
                         .where(F.col("_u").isNotNull() & F.col("_v").isNotNull()))
    units = dense_index(values, ["_u"], "idx")
    n = units.count()
    x = values.join(units.select(F.col("_u"), (F.col("idx") - 1).alias("idx")), "_u").select("idx", "_g", "_v")
    found = _quantiles(replicate_sums(x, n, replicates, seed), n, replicates, probs)
    total = values.sparkSession.createDataFrame([(n,)], "_n bigint")
    means = attach_scalar(values.groupBy("_g").agg(F.sum("_v").alias("_t")), total).select(
        F.col("_g").alias("_own"), (F.col("_t") / F.col("_n")).alias("mean"))
    return (found.join(means, F.col("_g").eqNullSafe(F.col("_own")))
            .select(F.col("_g").alias(group_col), "high", "mean", "low", "boot_mean", "boot_sd"))
