"""Ranked lexical search for many queries at once, with common subexpressions evaluated once.

A document's score for an item is a sum over the item's distinct terms, so any set of terms has a
partial score of its own, and items that share a set can share its accumulator.

1. Items are taken in blocks of at most about ``block_terms`` postings (an item is never cut), so a
   block's vocabulary, plan and accumulators are bounded whatever the number of items.
2. Terms that occur in exactly the same items form one set. Each item becomes the sequence of its sets, most
   shared first; neighbouring sets that stand together in at least two items are replaced by one node,
   round after round, until no two items share a pair: a graph in which every shared set is a node.
3. One pass over all whole texts counts each document's terms, keeps the ones of the block's vocabulary,
   and gives N, L and the document frequencies.
4. A task scores its documents in batches: contributions are scattered into the sets' accumulators,
   each node adds up its two parts once, and an item adds up the few nodes left in its sequence. A task keeps
   every item's ``k`` best; these are merged in two steps.

Defined results: null and empty texts have no terms, count for nothing and are never listed; every row
of documents and of items is one of its own (repeated ids and texts too), so equal scores of rows with
one doc_id are listed each; null doc_ids come last among equal scores; a null item_id is listed like others; an
item without terms gives no row; empty tables give an empty result; only doc_id, item_id and text are read.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from auditspark.llm.common import discard, stage

K = 10
BLOCK_TERMS = 100_000
#: Documents that are scored together; accumulators hold this many numbers a node.
BATCH = 512
#: Bytes of a text that are split into terms at once.
PART = 1 << 20
#: Tasks' lists that are merged together in the first of the two merges.
MERGES = 64
# In UTF-8, ASCII letters and digits, and every byte of other characters; bytes.lower changes A-Z only.
_TERM = re.compile(rb"[0-9a-z\x80-\xff]+")
_GAP = re.compile(rb"[^0-9a-z\x80-\xff]")

BEST = "item long, doc_id long, score long, task int"


def count_terms(text: bytes | None) -> Counter:
    """How often each term of a UTF-8 text occurs; long texts go part by part."""
    found: Counter = Counter()
    if not text:
        return found
    text, at = text.lower(), 0
    while at < len(text):
        gap = _GAP.search(text, at + PART) if at + PART < len(text) else None
        end = gap.start() if gap else len(text)
        found.update(_TERM.findall(text, at, end))
        at = end
    return found


@dataclass
class Plan:
    """Accumulators 0 to ``sets`` - 1 are sets of terms; then ``nodes`` (two parts each); then items."""

    sets: int
    set_of: np.ndarray
    nodes: list[tuple[int, int]]
    items: list[np.ndarray]

    @property
    def additions(self) -> int:
        return len(self.nodes) + sum(max(len(i) - 1, 0) for i in self.items)


def share(items: list[list[int]], terms: int) -> Plan:
    """The plan of items given as lists of distinct term numbers (below ``terms``)."""
    users: list[list[int]] = [[] for _ in range(terms)]
    for item, own in enumerate(items):
        for t in own:
            users[t].append(item)
    number: dict[tuple[int, ...], int] = {}
    set_of = np.array([number.setdefault(tuple(u), len(number)) for u in users], np.int64)
    shared = [len(u) for u in number]
    sequences = [sorted({int(set_of[t]) for t in own}, key=lambda s: (-shared[s], s)) for own in items]
    nodes: dict[tuple[int, int], int] = {}
    while True:
        pairs = Counter(p for own in sequences for p in zip(own, own[1:]))
        if not pairs or max(pairs.values()) < 2:
            break
        for own in sequences:
            at, out = 0, []
            while at < len(own):
                pair = tuple(own[at:at + 2])
                # Of two overlapping pairs the more frequent one is taken.
                after = tuple(own[at + 1:at + 3])
                if len(pair) == 2 and pairs[pair] >= 2 and (len(after) < 2 or pairs[after] <= pairs[pair]):
                    out.append(nodes.setdefault(pair, len(number) + len(nodes)))
                    at += 2
                else:
                    out.append(own[at])
                    at += 1
            own[:] = out
    return Plan(len(number), set_of, list(nodes), [np.array(own, np.int64) for own in sequences])


def _terms(docs: DataFrame, vocabulary: dict[bytes, int]) -> DataFrame:
    """doc_id, n (all terms), terms (numbers in the vocabulary) and counts of every document with terms."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, sizes, terms, counts = [], [], [], []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                found = count_terms(text.as_py())
                if found:
                    known = [(vocabulary[t], n) for t, n in found.items() if t in vocabulary]
                    ids.append(doc_id)
                    sizes.append(found.total())
                    terms.append([t for t, _ in known])
                    counts.append([n for _, n in known])
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array(sizes, pa.int64()), pa.array(terms, pa.list_(pa.int32())),
                 pa.array(counts, pa.list_(pa.int64()))], ["doc_id", "n", "terms", "counts"])

    return (docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").cast("binary").alias("text"))
            .mapInArrow(run, "doc_id long, n long, terms array<int>, counts array<bigint>"))


def term_weights(frequency: np.ndarray, total: int) -> np.ndarray:
    return np.array([math.floor(1000 * math.log((2 * total + 2) / (2 * int(df) + 1))) for df in frequency], np.int64)


def length_factor(n: np.ndarray, total: int, length: int) -> np.ndarray:
    return 10 + (90 * n * total) // max(length, 1)


class _Best:
    """The ``k`` best (score, doc_id) of one item; ``null`` marks a doc_id that is null."""

    def __init__(self, k: int):
        self.k = k
        self.score, self.null, self.doc = (np.empty(0, np.int64), np.empty(0, bool), np.empty(0, np.int64))

    def add(self, score: np.ndarray, null: np.ndarray, doc: np.ndarray) -> int:
        """Take more rows in; the score from which on rows still matter."""
        score, null, doc = (np.concatenate(p) for p in ((self.score, score), (self.null, null), (self.doc, doc)))
        kept = np.lexsort((doc, null, -score))[:self.k]
        self.score, self.null, self.doc = score[kept], null[kept], doc[kept]
        return int(self.score[-1]) if len(kept) == self.k else 1


def _scored(counted: DataFrame, plan: Plan, weights: np.ndarray, total: int, length: int, k: int) -> DataFrame:
    """Every task's ``k`` best documents of each item."""
    spark = counted.sparkSession
    sent = spark.sparkContext.broadcast((plan, weights))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        plan, weights = sent.value
        best = [_Best(k) for _ in plan.items]
        least = np.ones(len(best), np.int64)
        held = np.zeros((plan.sets + len(plan.nodes), BATCH), np.int64)
        task = 0
        for batch in batches:
            for at in range(0, batch.num_rows, BATCH):
                rows = batch.slice(at, BATCH)
                size = rows.num_rows
                ids, n, terms, counts, tasks = rows.columns
                task = tasks[0].as_py()
                lengths = np.diff(terms.offsets.to_numpy())
                row = np.repeat(np.arange(size), lengths)
                t = terms.flatten().to_numpy()
                tf = counts.flatten().to_numpy()
                m = length_factor(n.to_numpy(), total, length)
                held[:plan.sets, :size] = 0
                np.add.at(held, (plan.set_of[t], row), weights[t] * ((1_000_000_000 * tf) // (1000 * tf + 8 * m[row])))
                for i, (a, b) in enumerate(plan.nodes, plan.sets):
                    np.add(held[a, :size], held[b, :size], out=held[i, :size])
                null = ids.is_null().to_numpy(zero_copy_only=False)
                doc = ids.fill_null(0).to_numpy()
                for i, parts in enumerate(plan.items):
                    score = held[parts[0], :size] if len(parts) == 1 else held[parts, :size].sum(axis=0)
                    hits = np.flatnonzero(score >= least[i])
                    if len(hits):
                        least[i] = best[i].add(score[hits], null[hits], doc[hits])
        for i, own in enumerate(best):
            if len(own.score):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(own.score), i)), pa.array(own.doc, mask=own.null), pa.array(own.score),
                     pa.array(np.full(len(own.score), task, np.int32))], ["item", "doc_id", "score", "task"])

    out = stage(counted.select("doc_id", "n", "terms", "counts", F.spark_partition_id().alias("task")).mapInArrow(run, BEST))
    sent.destroy()
    return out


def _top(rows: DataFrame, keys: list[str], k: int) -> DataFrame:
    order = Window.partitionBy(*keys).orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last())
    return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def search(docs: DataFrame, items: DataFrame, k: int = K, block_terms: int = BLOCK_TERMS) -> DataFrame:
    """item_id, rank, doc_id and score of the ``k`` best documents of every row of ``items``."""
    spark = docs.sparkSession

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            terms = [sorted(count_terms(t.as_py())) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(terms, pa.list_(pa.binary()))], ["item_id", "terms"])

    split_items = stage(items.select(F.col("item_id").cast("long").alias("item_id"),
                                     F.col("text").cast("string").cast("binary").alias("text"))
                        .mapInArrow(split, "item_id long, terms array<binary>").where(F.size("terms") > 0))
    postings = split_items.agg(F.sum(F.size("terms"))).first()[0] or 0
    blocks = -(-postings // block_terms)
    found = None
    for block in range(blocks):
        # Items are dealt to blocks by their terms; the query set passes through the driver a block at a time.
        own = split_items.where(F.pmod(F.xxhash64("terms", "item_id"), F.lit(blocks)) == block).collect()
        own.sort(key=lambda r: (r["item_id"] is None, r["item_id"] or 0, r["terms"]))
        words = sorted({bytes(t) for r in own for t in r["terms"]})
        vocabulary = {t: i for i, t in enumerate(words)}
        plan = share([[vocabulary[bytes(t)] for t in r["terms"]] for r in own], len(words))
        counted = stage(_terms(docs, vocabulary))
        whole = counted.agg(F.count("*").alias("docs"), F.sum("n").alias("length")).first()
        frequency = np.zeros(len(words), np.int64)
        for r in counted.select(F.explode("terms").alias("t")).groupBy("t").count().collect():
            frequency[r["t"]] = r["count"]
        scored = _scored(counted, plan, term_weights(frequency, whole["docs"]), whole["docs"], whole["length"] or 0, k)
        discard(counted)
        names = spark.createDataFrame([(i, r["item_id"]) for i, r in enumerate(own)], "item long, item_id long")
        part = _top(scored.withColumn("part", F.col("task") % MERGES), ["item", "part"], k).drop("rank")
        part = _top(part, ["item"], k).join(names, "item").select("item_id", F.col("rank").cast("int"), "doc_id", "score")
        found = part if found is None else found.unionByName(part)
    return spark.createDataFrame([], "item_id long, rank int, doc_id long, score long") if found is None else found


#: DuckDB SQL of the same ranking, over the tables ``documents`` and ``benchmark``.
_SPLIT = (r"regexp_extract_all(translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), "
          r"'[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')")
SEARCH_SQL = rf"""
WITH terms AS (
  SELECT doc_id, row, unnest({_SPLIT.format("text")}) AS term
  FROM (SELECT doc_id, text, row_number() OVER () AS row FROM documents)
), tf AS (
  SELECT doc_id, row, term, count(*) AS tf FROM terms GROUP BY doc_id, row, term
), lengths AS (
  SELECT row, CAST(sum(tf) AS BIGINT) AS n FROM tf GROUP BY row
), whole AS (
  SELECT count(*) AS docs, CAST(sum(n) AS BIGINT) AS length FROM lengths
), weights AS (
  SELECT term, CAST(floor(1000 * ln(CAST(2 * docs + 2 AS DOUBLE) / CAST(2 * df + 1 AS DOUBLE))) AS BIGINT) AS w
  FROM (SELECT term, count(*) AS df FROM tf GROUP BY term), whole
), wanted AS (
  SELECT DISTINCT item, item_id, unnest({_SPLIT.format("text")}) AS term
  FROM (SELECT item_id, text, row_number() OVER () AS item FROM benchmark)
), scores AS (
  SELECT item, item_id, row, doc_id,
         CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 90 + ((90 * n * docs) // length))))) AS BIGINT) AS score
  FROM wanted JOIN tf USING (term) JOIN weights USING (term) JOIN lengths USING (row), whole
  GROUP BY item, item_id, row, doc_id
)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY item ORDER BY score DESC, doc_id NULLS LAST) AS rank
      FROM scores WHERE score > 0)
WHERE rank <= {K}
"""
