"""Sharding by sampled splitters.

A record's key is a 63-bit number: the high bits hash its text, the low bits its doc_id and, of exact repeats,
the number among them, so equal texts are neighbours and even one text or one repeated row that is a third of all
rows can be divided. Nothing depends on how the rows are partitioned: reruns agree.

1. Draw keys with probability proportional to the record's size; their quantiles are the first
   splitters. About ``samples`` keys reach the driver, whatever the input's size.
2. Count the exact bytes of each range. Ranges above ``max_share`` of a shard are overfull: they are
   sampled again by the same law, inside themselves, and subdivided, for as many rounds as it takes until none
   is left that holds more than a single key.
3. Lay the ranges out in key order and cut that line into shards of equal bytes, preferring a cut
   between two texts when one lies close enough to the even place (``snap`` of a shard), so that
   equal texts part only when they weigh more than that.
4. A record's slot is the rows of its shard's earlier ranges plus its position in its own range.

Defined results: a null text weighs no bytes, its size is 8; an empty table gives an empty result;
repeated rows get slots of their own; rows of equal key are in order of doc_id, crc32 and size; other columns
are not read.
"""

from __future__ import annotations

from itertools import count

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from auditspark.llm.common import id_and_text, stage

SHARDS = 24
OVERHEAD = 8
#: Low bits of a key, from the doc_id and repeat; the other 41 come from the text.
DOC_BITS = 22
SEED = 7
#: Exact repeats of a row that are written out in one place.
REPEATS = 65_536


def records(docs: DataFrame) -> DataFrame:
    """doc_id, size, text_crc32 and key of every row. Exact repeats are counted and written out again with a number each;
    one that very many rows repeat in blocks, by many tasks."""
    rows = id_and_text(docs).select("doc_id", (F.octet_length("text") + OVERHEAD).cast("long").alias("size"),
                                    F.crc32(F.col("text").cast("binary")).alias("text_crc32"), F.xxhash64("text").alias("hash"))
    counted = stage(rows.groupBy("doc_id", "size", "text_crc32", "hash").agg(F.count(F.lit(1)).alias("times")))
    blocks = counted.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("times") - 1) / REPEATS))))
    if not counted.where(F.col("times") > REPEATS).isEmpty():
        blocks = blocks.repartition("doc_id", "hash", "block")
    first = F.col("block") * REPEATS
    each = blocks.withColumn("rep", F.explode(F.sequence(first + 1, F.least(first + REPEATS, F.col("times")))))
    doc_part = F.shiftrightunsigned(F.xxhash64(F.lit(SEED), "doc_id", "rep"), 64 - DOC_BITS)
    text_part = F.shiftleft(F.shiftrightunsigned(F.col("hash"), DOC_BITS + 1), DOC_BITS)
    return each.select("doc_id", "size", "text_crc32", text_part.bitwiseOR(doc_part).alias("key"))


def range_of(splitters: np.ndarray):
    """Number of the range that holds a key: how many splitters are at or below it."""
    sent = splitters

    @F.pandas_udf("long")
    def find(keys: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(sent, keys.to_numpy(), side="right").astype("int64"))

    return find


def sample_keys(frame: DataFrame, rate: float, salt: int) -> np.ndarray:
    """Keys drawn with probability min(1, size * rate), by a hash of the record."""
    u = F.shiftrightunsigned(F.xxhash64(F.lit(salt), "doc_id", "key", "size"), 11) / float(1 << 53)
    drawn = frame.where(u < F.col("size") * F.lit(rate)).select("key")
    return np.sort(np.array([r["key"] for r in drawn.toLocalIterator()], dtype=np.int64))


def quantile_splitters(sample: np.ndarray, ranges: int) -> np.ndarray:
    if not len(sample):
        return np.empty(0, np.int64)
    return np.unique(sample[np.linspace(0, len(sample), ranges, endpoint=False).astype(int)[1:]])


def choose_splitters(table: DataFrame, total: int, shards: int, ranges: int, max_share: float,
                     per_range: int = 8) -> np.ndarray:
    """Splitters whose ranges all weigh at most ``max_share`` of a shard, unless of one key."""
    limit = total / shards * max_share
    splitters = quantile_splitters(sample_keys(table, ranges * per_range / max(total, 1), 0), ranges)
    for salt in count(1):
        numbered = table.withColumn("rng", range_of(splitters)("key"))
        weighed = (numbered.groupBy("rng").agg(F.sum("size").alias("bytes"), F.min("key").alias("lo"),
                                               F.max("key").alias("hi"))
                   .where((F.col("bytes") > limit) & (F.col("lo") < F.col("hi"))).collect())
        if not weighed:
            break
        # One key of an overfull range may itself be the weight: its neighbours become splitters too, so that every
        # round cuts every such range.
        added = [s for r in weighed for s in (r["lo"] + 1, r["hi"])]
        over = F.broadcast(table.sparkSession.createDataFrame([(r["rng"],) for r in weighed], "rng long"))
        drawn = sample_keys(numbered.join(over, "rng"), 4 * per_range / limit, salt)
        splitters = np.unique(np.concatenate([splitters, drawn[::per_range], np.array(added, np.int64)]))
    return splitters


def cut_line(sizes: np.ndarray, starts_text: np.ndarray, shards: int, snap: float) -> np.ndarray:
    """Shard of each range: equal shares of the bytes, cuts moved to a text's start if one is near."""
    shard = np.zeros(len(sizes), np.int64)
    if not len(sizes):
        return shard
    ends = np.cumsum(sizes)
    total = int(ends[-1])
    places = ends - sizes
    whole = np.flatnonzero(starts_text)
    for s in range(1, shards):
        even = total * s / shards
        best = int(np.argmin(np.abs(places - even)))
        if len(whole):
            near = whole[int(np.argmin(np.abs(places[whole] - even)))]
            if abs(places[near] - even) <= snap * total / shards:
                best = int(near)
        shard[best:] = np.maximum(shard[best:], s)
    return shard


def shard(docs: DataFrame, shards: int = SHARDS, ranges_per_shard: int = 128, max_share: float = 0.02,
          snap: float = 0.015, range_rows: int = 200_000) -> DataFrame:
    """doc_id, size, text_crc32, key, shard (0 to ``shards`` - 1) and slot of every row.

    The number of ranges also grows with the rows, so that no range holds many more than
    ``range_rows``; the driver keeps one entry a range."""
    table = stage(records(docs))
    seen = table.agg(F.count("*").alias("n"), F.coalesce(F.sum("size"), F.lit(0)).alias("bytes")).first()
    ranges = max(shards * ranges_per_shard, -(-seen["n"] // range_rows))
    splitters = choose_splitters(table, seen["bytes"], shards, ranges, max_share)
    # Move each splitter that cuts a light text to that text's start: such texts stay whole.
    low = (1 << DOC_BITS) - 1
    inside = splitters & ~low
    texts, times = np.unique(inside, return_counts=True)
    light = np.isin(inside, texts[times == 1])
    splitters = np.unique(np.where(light, inside, splitters))
    numbered = stage(table.withColumn("rng", range_of(splitters)("key")))
    rows = numbered.groupBy("rng").agg(F.sum("size").alias("bytes"), F.count("*").alias("n")).collect()
    rows.sort(key=lambda r: r["rng"])
    ids = np.array([r["rng"] for r in rows], np.int64)
    starts_text = np.array([i == 0 or (int(splitters[i - 1]) & low) == 0 for i in ids], bool)
    of = cut_line(np.array([r["bytes"] for r in rows], np.int64), starts_text, shards, snap)
    counts, first = np.array([r["n"] for r in rows], np.int64), np.zeros(len(rows), np.int64)
    for s in range(shards):
        own = of == s
        first[own] = np.cumsum(counts[own]) - counts[own]
    places = numbered.sparkSession.createDataFrame(
        [(int(a), int(b), int(c)) for a, b, c in zip(ids, of, first)], "rng long, shard int, first long")
    order = Window.partitionBy("rng").orderBy("key", "doc_id", "text_crc32", "size")
    return (numbered.withColumn("nth", F.row_number().over(order) - 1)
            .join(places, "rng")
            .select("doc_id", "size", "text_crc32", "key", "shard", (F.col("first") + F.col("nth")).alias("slot")))
