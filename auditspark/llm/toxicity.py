"""Toxicity by nearest labelled examples under exact TF-IDF cosine.

1. ``per_class`` labelled rows of each class, drawn by a hash of doc_id (the documented bound of the
   fit), are the examples. Their vocabulary is all their words, and the four-letter word beginnings that mark
   toxic ones beyond chance.
2. One pass over all whole texts keeps each document's terms of that vocabulary and their counts. Document
   frequencies come from all documents.
3. A term weighs (1 + log tf) * idf * information: the last, from ``FLOOR`` to 1, grows with the term's
   log-likelihood ratio and with the share of toxic texts among its texts, classes weighed to their true numbers. So
   no term is left out, and a text's hundreds of neutral words do not outweigh the one that matters.
4. The examples form an inverted index in blocks of 256 with each term's largest weight per block.
   A query adds up its blocks' bounds, scores the blocks of the highest ones, and then all others whose bound
   reaches the k-th best cosine. Queries without a term that outweighs the others prune little: they are scored in batches
   over whole lists, those of terms that many examples hold as columns of a matrix in single precision, and every row near
   the k-th best is scored again in double precision. Either way the k nearest are exact.
5. All neighbours are a row's evidence, nearest first. They vote with weight 1 / (distance + 0.1), classes weighed
   back to their true numbers. A logistic curve fitted to the examples' own leave-one-out votes turns votes into
   probabilities.

Defined results: a null or empty text, or one that shares no term with any example, scores the rate
observed among such examples; equal cosines go to the smaller example number; repeated rows are
scored each; repeated labels of a doc_id count as their largest, other values than 0 and 1 not at
all; a labelled doc_id that is repeated gives one example, of the text with the least hash; without usable labels of
both classes every score is the known class's rate (0.5 without any); an empty table gives an empty result; only
doc_id and text of documents, and doc_id and the label, are read.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from auditspark.llm.common import id_and_text, label_remainder, row_key, stage

PER_CLASS = 6_000
NEIGHBOURS = 15
BLOCK = 256
THRESHOLD = 0.7
BEGINNING = 4
#: Information of a term that says nothing about the class.
FLOOR = 0.01
#: Log-likelihood ratio of half the information.
HALF = 12.0
#: Blocks that a search scores first.
FIRST = 2
#: Share of the examples from which a term's list is also held as a column, queries scored at once, and how far a
#: single-precision cosine can be off (by far less).
COMMON = 0.06
TOGETHER = 256
#: Share of a query's squared length from which its largest term outweighs the others.
DOMINANT = 0.5
SLACK = 1e-4
#: Words of whole texts that are counted at once.
WORDS = 250_000
_WORD = re.compile(r"\w+")

SCORED = ("doc_id long, held_out boolean, score double, predicted int, "
          "evidence array<struct<example:long,similarity:double,label:int>>")


def labelled_sample(labels: DataFrame, label: str, modulus: int, held: int, per_class: int) -> tuple[DataFrame, list[int]]:
    """At most ``per_class`` labelled ids of each class outside the held-out fold, and the classes' true numbers."""
    one = (labels.where(F.col("doc_id").isNotNull() & F.col(label).isin(0, 1))
           .groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(label).cast("int").alias("label"))
           .where(label_remainder("doc_id", modulus) != held))
    counts = {r["label"]: r["count"] for r in one.groupBy("label").count().collect()}
    draws = [one.where(F.col("label") == c).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class) for c in (0, 1)]
    return stage(draws[0].unionByName(draws[1])), [counts.get(0, 0), counts.get(1, 0)]


def labelled_texts(docs: DataFrame, sample: DataFrame) -> DataFrame:
    """doc_id, label and text of the sample: a broadcast of at most two classes' draws."""
    return (id_and_text(docs).join(F.broadcast(sample), "doc_id")
            .groupBy("doc_id").agg(F.first("label").alias("label"), F.min_by("text", F.xxhash64("text")).alias("text")))


def terms_of(text: str) -> list[str]:
    """All words of the text, lower case, in order."""
    return _WORD.findall(text.lower())


def with_beginnings(words: set[str]) -> set[str]:
    return words | {w[:BEGINNING] + "*" for w in words if len(w) > BEGINNING}


def term_information(examples: DataFrame, numbers: list[int], drawn: list[int], least: int = 3,
                     purity: float = 0.3) -> dict[str, float]:
    """The vocabulary: every word of the examples with its information, and the beginnings of at least ``least``
    different toxic texts whose log-likelihood ratio exceeds ``HALF`` and among whose texts, classes weighed to
    their true numbers, at least ``purity`` are toxic."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            toxic, clean = Counter(), Counter()
            for label, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                (toxic if label else clean).update(with_beginnings(set(terms_of(text))))
            names = list(toxic.keys() | clean.keys())
            yield pa.RecordBatch.from_arrays(
                [pa.array(names, pa.string()), pa.array([toxic[w] for w in names], pa.int64()),
                 pa.array([clean[w] for w in names], pa.int64())], ["term", "toxic", "clean"])

    texts = examples.groupBy("label", F.sha2(F.col("text").cast("binary"), 256).alias("h")).agg(F.first("text").alias("text"))
    sizes = {r["label"]: r["count"] for r in texts.groupBy("label").count().collect()}
    n1, n0 = float(sizes.get(1, 0)), float(sizes.get(0, 0))
    if not n1 or not n0:
        return {}
    a, b = F.col("toxic").cast("double"), F.col("clean").cast("double")

    def part(seen, all_of):
        expected = (a + b) * all_of / (n1 + n0)
        return F.when(seen > 0, 2 * seen * F.log(seen / expected)).otherwise(F.lit(0.0))

    weight = [numbers[0] / max(drawn[0], 1), numbers[1] / max(drawn[1], 1)]
    pure = a * weight[1] / (a * weight[1] + b * weight[0])
    ratio = F.when(a / n1 > b / n0, part(a, n1) + part(b, n0)).otherwise(F.lit(0.0))
    # The vocabulary of the examples: it is bounded as they are.
    stats = (texts.select("label", "text").mapInArrow(run, "term string, toxic long, clean long")
             .groupBy("term").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
             .select("term", ratio.alias("ratio"), pure.alias("pure"), "toxic"))
    sure = (F.col("toxic") >= least) & (F.col("ratio") >= HALF) & (F.col("pure") >= purity)
    share = F.col("ratio") / (F.col("ratio") + HALF)
    value = F.when(sure, F.lit(1.0)).otherwise(FLOOR + (1 - FLOOR) * share * share * F.col("pure"))
    # As Arrow columns, a few dozen bytes a term.
    kept = stats.where(~F.col("term").endswith("*") | sure).select("term", value.alias("value")).toArrow()
    return dict(zip(kept.column("term").to_pylist(), kept.column("value").to_pylist()))


class Numbers(dict):
    """The number of every term; an unknown word has its beginning's, or -1. Unknown words are not stored."""

    def __init__(self, vocabulary: list[str]):
        super().__init__(zip(vocabulary, range(len(vocabulary))))

    def __missing__(self, word: str) -> int:
        return self.get(word[:BEGINNING] + "*", -1) if len(word) > BEGINNING else -1


def term_counts(docs: DataFrame, vocabulary: list[str], keyed: bool = False) -> DataFrame:
    """doc_id, terms (numbers in the vocabulary, ascending), counts and, if ``keyed``, row_key of every document."""
    keys = ["row_key"] if keyed else []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = Numbers(vocabulary)
        # Beginnings of the known words: a word counts for both.
        start = np.array([number.get(w[:BEGINNING] + "*", -1) if len(w) > BEGINNING and not w.endswith("*") else -1
                          for w in vocabulary], np.int32)

        def counted(batch: pa.RecordBatch, found: list[np.ndarray]) -> pa.RecordBatch:
            own = np.repeat(np.arange(len(found)), [len(x) for x in found])
            term = np.concatenate(found)
            first = start[term]
            both = first >= 0
            key = np.concatenate([own, own[both]]) * len(start) + np.concatenate([term, first[both]])
            key, counts = np.unique(key, return_counts=True)
            at = np.searchsorted(key, np.arange(len(found) + 1) * len(start)).astype(np.int32)
            terms = (key % max(len(start), 1)).astype(np.int32)
            return pa.RecordBatch.from_arrays(
                [batch.column(0), pa.ListArray.from_arrays(at, terms),
                 pa.ListArray.from_arrays(at, counts.astype(np.int32)), *batch.columns[2:]],
                ["doc_id", "terms", "counts", *keys])

        for batch in batches:
            done, words, found = 0, 0, []
            for i, text in enumerate(batch.column(1)):
                codes = np.fromiter(map(number.__getitem__, terms_of(text.as_py())), np.int32)
                found.append(codes[codes >= 0])
                words += len(found[-1])
                if words >= WORDS or i == batch.num_rows - 1:
                    yield counted(batch.slice(done, len(found)), found)
                    done, words, found = i + 1, 0, []

    schema = ["doc_id long, terms array<int>, counts array<int>", *[f"{k} binary" for k in keys]]
    rows = id_and_text(docs)
    return rows.select("doc_id", "text", *[row_key().alias(k) for k in keys]).mapInArrow(run, ", ".join(schema))


def unit_vector(terms, counts, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    t = np.asarray(terms)
    w = (1.0 + np.log(np.asarray(counts, float))) * weight[t]
    return t, w / math.sqrt(float(w @ w)) if len(w) else w


@dataclass
class BlockMaxIndex:
    """Inverted index over unit vectors, with the largest weight of every term in every block of rows.

    Postings (``rows``, ``weights``) stand by term and row. An entry is one term in one block: its block, largest
    weight and postings; ``entry_of`` and ``post_of`` say where a term's entries and postings begin."""

    size: int
    rows: np.ndarray
    weights: np.ndarray
    post_of: np.ndarray
    entry_of: np.ndarray
    block: np.ndarray
    most: np.ndarray
    start: np.ndarray
    end: np.ndarray
    # Made where queries are scored together: by row, its terms and weights; the columns of common terms and where a
    # term's column is (-1: none).
    of_row: np.ndarray | None = None
    row_terms: np.ndarray | None = None
    row_weights: np.ndarray | None = None
    column: np.ndarray | None = None
    columns: np.ndarray | None = None

    @staticmethod
    def build(vectors: list[tuple[np.ndarray, np.ndarray]]) -> BlockMaxIndex:
        terms = np.concatenate([t for t, _ in vectors] or [np.empty(0)]).astype(np.int32)
        rows = np.repeat(np.arange(len(vectors), dtype=np.int32), [len(t) for t, _ in vectors])
        # Rows ascend already; a stable sort keeps that within a term.
        order = np.argsort(terms, kind="stable")
        terms, rows = terms[order], rows[order]
        weights = np.concatenate([w for _, w in vectors] or [np.empty(0)])[order]
        del order
        block = rows // BLOCK
        change = np.ones(len(terms), bool)
        change[1:] = (terms[1:] != terms[:-1]) | (block[1:] != block[:-1])
        start = np.flatnonzero(change).astype(np.int32)
        most = np.maximum.reduceat(weights, start) if len(start) else np.empty(0)
        every = np.arange(int(terms[-1]) + 2 if len(terms) else 1)
        return BlockMaxIndex(len(vectors), rows, weights, np.searchsorted(terms, every), np.searchsorted(terms[start], every),
                             block[start], most, start, np.append(start[1:], len(terms)).astype(np.int32))

    def _prepare(self) -> None:
        counts = np.diff(self.post_of)
        terms = np.repeat(np.arange(len(counts), dtype=np.int32), counts)
        order = np.argsort(self.rows, kind="stable")
        self.of_row = np.searchsorted(self.rows[order], np.arange(self.size + 1))
        self.row_terms, self.row_weights = terms[order], self.weights[order]
        common = np.flatnonzero(counts >= max(COMMON * self.size, 1))
        self.column = np.full(len(counts), -1, np.int32)
        self.column[common] = np.arange(len(common))
        self.columns = np.zeros((len(common), self.size), np.float32)
        for c, t in enumerate(common):
            own = slice(self.post_of[t], self.post_of[t + 1])
            self.columns[c, self.rows[own]] = self.weights[own]

    @staticmethod
    def _runs(start: np.ndarray, length: np.ndarray) -> np.ndarray:
        """start[0], start[0] + 1, ... for each run of numbers."""
        total = np.cumsum(length)
        return np.arange(total[-1] if len(total) else 0) + np.repeat(start - (total - length), length)

    def _score(self, start: np.ndarray, end: np.ndarray, weight: np.ndarray) -> np.ndarray:
        """Of each row the sum over its postings in runs from ``start`` to ``end``, times the runs' weights."""
        length = end - start
        if len(start) * 128 < int(length.sum()):
            # Long runs are copied as they stand.
            cuts = list(zip(start.tolist(), end.tolist()))
            rows, own = (np.concatenate([of[a:b] for a, b in cuts]) for of in (self.rows, self.weights))
        else:
            at = self._runs(start, length)
            rows, own = self.rows.take(at), self.weights.take(at)
        return np.bincount(rows, own * np.repeat(weight, length), self.size)

    def search(self, terms: np.ndarray, weights: np.ndarray, k: int, skip: int = -1,
               whole: bool = True) -> list[tuple[float, int]] | None:
        """The k rows of highest positive cosine, ties to the smaller number; ``skip`` is left out. Where the bounds
        prune little, whole lists are scored, or, without ``whole``, None is returned."""
        known = terms < len(self.post_of) - 1
        terms, weights = terms[known], weights[known]
        first = self.entry_of[terms]
        many = self.entry_of[terms + 1] - first
        entries, weight = self._runs(first, many), np.repeat(weights, many)
        if not len(entries):
            return []
        blocks = self.block[entries]
        bound = np.bincount(blocks, weight * self.most[entries], -(-self.size // BLOCK))

        def best_of(best: list[tuple[float, int]], score: np.ndarray) -> list[tuple[float, int]]:
            if 0 <= skip < self.size:
                score[skip] = 0.0
            hits = np.flatnonzero(score > (best[-1][0] - 1e-12 if len(best) == k else 0.0))
            if len(hits) > k:
                hits = hits[score[hits] >= np.partition(score[hits], -k)[-k]]
            return sorted(best + [(float(score[h]), int(h)) for h in hits], key=lambda x: (-x[0], x[1]))[:k]

        def of_blocks(chosen: np.ndarray) -> np.ndarray:
            inside = np.zeros(len(bound), bool)
            inside[chosen] = True
            inside = inside[blocks]
            own = entries[inside]
            return self._score(self.start[own], self.end[own], weight[inside])

        order = np.argsort(-bound, kind="stable")
        order = order[bound[order] > 0]
        best: list[tuple[float, int]] = []
        if len(order) > 4 * FIRST:
            best = best_of(best, of_blocks(order[:FIRST]))
            left = order[FIRST:]
            if len(best) == k:
                left = left[bound[left] + 1e-9 >= best[-1][0]]
            if 4 * len(left) <= len(bound):
                return best_of(best, of_blocks(left)) if len(left) else best
        # Most blocks are left: whole lists are quicker than many blocks of each.
        return None if not whole else best_of([], self._score(self.post_of[terms], self.post_of[terms + 1], weights))


    def search_many(self, queries: list[tuple[np.ndarray, np.ndarray]], k: int) -> list[list[tuple[float, int]]]:
        """``search`` of every query."""
        if self.columns is None:
            self._prepare()
        out: list = [[] for _ in queries]
        flat = []
        for i, (terms, weights) in enumerate(queries):
            if not len(terms):
                continue
            # Without a term that outweighs the others the bounds prune nothing.
            found = self.search(terms, weights, k, whole=False) if float(weights.max()) ** 2 > DOMINANT else None
            if found is None:
                flat.append(i)
            else:
                out[i] = found
        full = np.zeros(len(self.column))
        for at in range(0, len(flat), TOGETHER):
            some = flat[at:at + TOGETHER]
            common = np.zeros((len(some), len(self.columns)), np.float32)
            rare = []
            for j, i in enumerate(some):
                terms, weights = queries[i]
                known = terms < len(self.column)
                terms, weights = terms[known], weights[known]
                column = self.column[terms]
                common[j, column[column >= 0]] = weights[column >= 0]
                rare.append((terms[column < 0], weights[column < 0], terms, weights))
            scores = common @ self.columns
            for j, i in enumerate(some):
                few, few_weights, terms, weights = rare[j]
                score = scores[j] + self._score(self.post_of[few], self.post_of[few + 1], few_weights)
                least = np.partition(score, -k)[-k] if self.size > k else 0.0
                near = np.flatnonzero(score >= max(least - SLACK, 0.0))
                near = near[score[near] > 0] if least <= SLACK else near
                full[terms] = weights
                length = self.of_row[near + 1] - self.of_row[near]
                own = self._runs(self.of_row[near], length)
                exact = np.add.reduceat(full[self.row_terms[own]] * self.row_weights[own], np.cumsum(length) - length) if len(near) else []
                full[terms] = 0.0
                best = sorted(((float(s), int(r)) for s, r in zip(exact, near) if s > 0), key=lambda x: (-x[0], x[1]))
                out[i] = best[:k]
        return out


def vote(found: list[tuple[float, int]], labels: np.ndarray, weight: np.ndarray) -> float:
    """Log odds of the neighbours' weighted votes, a little smoothed towards even."""
    mass = [0.0, 0.0]
    for similarity, row in found:
        mass[int(labels[row])] += weight[int(labels[row])] / (1.0 - min(similarity, 1.0) + 0.1)
    # The smoothing is a tenth of one nearest neighbour of the larger weight.
    smooth = float(weight.max())
    return math.log((mass[1] + smooth * 0.1) / (mass[0] + smooth * 0.1))


def fit_curve(x: np.ndarray, y: np.ndarray, w: np.ndarray, steps: int = 50) -> tuple[float, float]:
    """Weighted logistic regression of one variable, with a light penalty, by Newton's method."""
    a, b = 1.0, 0.0
    scale = 1.0 / max(float(w.sum()), 1e-12)
    for _ in range(steps):
        p = 1.0 / (1.0 + np.exp(-np.clip(a * x + b, -30, 30)))
        g = np.array([((p - y) * w * x).sum() * scale + 1e-3 * (a - 1.0), ((p - y) * w).sum() * scale + 1e-6 * b])
        v = p * (1 - p) * w * scale
        h = np.array([[(v * x * x).sum() + 1e-3, (v * x).sum()], [(v * x).sum(), v.sum() + 1e-6]])
        move = np.linalg.solve(h, g)
        a, b = a - float(np.clip(move[0], -1, 1)), b - float(np.clip(move[1], -2, 2))
        if abs(move).max() < 1e-9:
            break
    return max(a, 0.05), b


def toxicity(docs: DataFrame, labels: DataFrame, label: str = "toxic", modulus: int = 3, held: int = 1,
             per_class: int = PER_CLASS, k: int = NEIGHBOURS, threshold: float = THRESHOLD,
             keyed: bool = False) -> DataFrame:
    """doc_id, held_out, score, predicted, evidence (its ``k`` nearest examples) and, if ``keyed``, row_key of every row
    of ``docs``."""
    keys = ["row_key"] if keyed else []
    sample, numbers = labelled_sample(labels, label, modulus, held, per_class)
    examples = stage(labelled_texts(docs, sample))
    drawn_rows = {r["label"]: r["count"] for r in examples.groupBy("label").count().collect()}
    drawn = [drawn_rows.get(0, 0), drawn_rows.get(1, 0)]
    information = term_information(examples, numbers, drawn)
    vocabulary = sorted(information)
    counted = stage(term_counts(docs, vocabulary, keyed))

    total = counted.count()
    frequency = np.zeros(len(vocabulary))
    spread = counted.select(F.explode("terms").alias("t")).groupBy("t").count().toArrow()
    frequency[spread.column("t").to_numpy()] = spread.column("count").to_numpy()
    term_weight = (np.log((1.0 + total) / (1.0 + frequency)) + 1.0) * np.array([information[t] for t in vocabulary])
    known = bool(vocabulary)

    weight = np.array([numbers[c] / drawn[c] if drawn[c] else 0.0 for c in (0, 1)])
    mass = [numbers[c] if drawn[c] else 0 for c in (0, 1)]
    marked = {r["doc_id"]: r["label"] for r in examples.select("doc_id", "label").collect()}
    # The examples' terms and counts as Arrow columns; a row is a slice of them.
    own = term_counts(examples.select("doc_id", "text"), vocabulary).toArrow().combine_chunks()
    del information, vocabulary, spread, frequency
    ids = own.column("doc_id").to_pylist()
    lists = [own.column(c).chunk(0) if own.num_rows else None for c in ("terms", "counts")]

    def row(i: int) -> tuple[np.ndarray, np.ndarray]:
        return tuple(c[i].values.to_numpy() for c in lists)

    filled = {i: len(row(i)[0]) for i in range(len(ids))}
    bare = [sum(1 for i, n in filled.items() if not n and marked[ids[i]] == c) * weight[c] for c in (0, 1)]
    order = sorted((i for i, n in filled.items() if n), key=lambda i: (marked[ids[i]], row(i)[0].tobytes(), ids[i]))
    marks = np.array([marked[ids[i]] for i in order], np.int64)
    names = np.array([ids[i] for i in order], np.int64)
    vectors = [unit_vector(*row(i), term_weight) for i in order]
    del own, lists
    index = BlockMaxIndex.build(vectors)
    if sum(mass):
        rate = mass[1] / sum(mass)
        empty_score = float((bare[1] + 0.5 * rate) / (sum(bare) + 0.5)) if known else rate
    else:
        empty_score = 0.5
    x = np.array([vote(index.search(*v, k, skip=i), marks, weight) for i, v in enumerate(vectors)])
    a, b = fit_curve(x, marks.astype(float), weight[marks]) if len(order) else (1.0, 0.0)
    sent = docs.sparkSession.sparkContext.broadcast((index, term_weight, marks, names))
    del vectors, index, term_weight  # the driver keeps no copy

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("example", pa.int64()), ("similarity", pa.float64()), ("label", pa.int32())]))
        index, term_weight, marks, names = sent.value
        for batch in batches:
            scores, evidence = [], []
            queries = []
            for terms, counts in zip(batch.column(1), batch.column(2)):
                queries.append(unit_vector(terms.values.to_numpy(), counts.values.to_numpy(), term_weight))
            for found in index.search_many(queries, k):
                if found:
                    odds = a * vote(found, marks, weight) + b
                    scores.append(1.0 / (1.0 + math.exp(-max(-30.0, min(30.0, odds)))))
                else:
                    scores.append(empty_score)
                evidence.append([{"example": int(names[i]), "similarity": s, "label": int(marks[i])} for s, i in found])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(3), pa.array(scores, pa.float64()),
                 pa.array([int(s >= threshold) for s in scores], pa.int32()), pa.array(evidence, kind), *batch.columns[4:]],
                ["doc_id", "held_out", "score", "predicted", "evidence", *keys])

    # The written counts are read as they were written: evenly, as the texts.
    return (counted.select("doc_id", "terms", "counts", (label_remainder("doc_id", modulus) == held).alias("held_out"), *keys)
            .mapInArrow(run, ", ".join([SCORED, *[f"{c} binary" for c in keys]])))
