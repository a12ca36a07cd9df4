"""Document fingerprints: bottom-k sketches of word-shingle hashes.

A sketch is the k smallest distinct hashes of a text's five-word shingles. Two sketches of the same
k merge into the sketch of the union (``merge``, or ``merge_by`` over a distributed table), and
estimate resemblance, containment and the number of distinct shingles; all three are exact while
the sets hold fewer than k shingles.

``follow`` deals documents to ranges of (doc_id, digest of the text) with one shuffle of the texts: ranges begin
at keys that exist (quantiles), so every range has a first document, and that document is also sent to the
end of the range before it. Each task then streams its ranges in order. A doc_id that many rows hold (null ones, say)
is divided by digests, and one row that is repeated very often is dealt out by turns: equal rows follow each other
anyway, so any of them closes a range of them.

Defined results: a null text is empty; an empty text has the empty sketch, two of which are alike
(1.0) and one of which is unlike any other (0.0); a text of one to four words has one shingle, all
its words; a null doc_id comes first; rows of equal doc_id follow in order of a digest of their text; a table
of one row is followed by itself; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from auditspark.llm.common import id_and_text, shuffle_partitions

K = 128
WORDS = 5
HASH_BITS = 48

FOLLOWED = ("doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
            "near_edited double, near_next double, distinct_shingles double")


class WordHashes(dict):
    """Remembered 64-bit hashes of words; emptied when it has grown to ``most``."""

    def __init__(self, most: int = 200_000):
        super().__init__()
        self.most = most

    def __missing__(self, word: str) -> int:
        if len(self) >= self.most:
            self.clear()
        h = self[word] = xxhash.xxh64_intdigest(word.encode("utf-8", "surrogatepass"))
        return h


def _mix(h: np.ndarray) -> np.ndarray:
    """Spread 64-bit numbers evenly (multiply and shift twice)."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def sketch(text: str, k: int = K, words: int = WORDS, hashes: WordHashes | None = None) -> np.ndarray:
    """The k smallest distinct shingle hashes of the whole text, ascending."""
    known = WordHashes() if hashes is None else hashes
    w = np.array([known[x] for x in text.split()], dtype=np.uint64)
    if not len(w):
        return w
    n = min(words, len(w))
    h = np.zeros(len(w) - n + 1, np.uint64)
    for j in range(n):
        h = h * np.uint64(0x9E3779B97F4A7C15) + w[j:len(w) - n + 1 + j]
    h = _mix(h) >> np.uint64(64 - HASH_BITS)
    if len(h) > 4 * k:
        # Repeats can hide among the smallest, so more are taken until k distinct ones are there.
        take = 2 * k
        while take < len(h):
            low = np.unique(np.partition(h, take)[:take])
            if len(low) >= k:
                return low[:k]
            take *= 4
    return np.unique(h)[:k]


def merge(a: np.ndarray, b: np.ndarray, k: int = K) -> np.ndarray:
    return np.union1d(a, b)[:k]


def resemblance(a: np.ndarray, b: np.ndarray, k: int = K) -> float:
    """Estimated |A and B| / |A or B|: the share of the union's sketch that both hold."""
    union = merge(a, b, k)
    if not len(union):
        return 1.0
    return len(np.intersect1d(union, np.intersect1d(a, b, True), True)) / len(union)


def distinct(a: np.ndarray, k: int = K) -> float:
    """Estimated number of distinct shingles."""
    return float(len(a)) if len(a) < k else (k - 1) / ((float(a[k - 1]) + 1) / 2.0 ** HASH_BITS)


def containment(a: np.ndarray, b: np.ndarray, k: int = K) -> float:
    """Estimated share of A's shingles that B holds."""
    if not len(a):
        return 1.0
    both = resemblance(a, b, k) * distinct(merge(a, b, k), k)
    return min(1.0, both / distinct(a, k))


def encode(a: np.ndarray) -> str:
    """A sketch as text: 8 base64 characters a hash."""
    return base64.b64encode(a.astype(">u8").view(np.uint8).reshape(-1, 8)[:, 2:].tobytes()).decode()


def decode(text: str) -> np.ndarray:
    raw = np.frombuffer(base64.b64decode(text), np.uint8).reshape(-1, 6)
    return np.pad(raw, ((0, 0), (2, 0))).reshape(-1).view(">u8").astype(np.uint64)


def fingerprints(docs: DataFrame, k: int = K) -> DataFrame:
    """doc_id and fingerprint of every row; one narrow pass, no shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = WordHashes()
        for batch in batches:
            prints = [encode(sketch(t, k, hashes=known)) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(prints, pa.string())], ["doc_id", "fingerprint"])

    return id_and_text(docs).mapInArrow(run, "doc_id long, fingerprint string")


def merge_by(prints: DataFrame, key: str, k: int = K) -> DataFrame:
    """One merged fingerprint per value of ``key``: merged in every partition first, so the last
    step reads at most one sketch per key and partition."""

    def partial(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict = {}
        for pdf in frames:
            for own, text in zip(pdf[key], pdf["fingerprint"]):
                a = decode(text)
                held[own] = merge(held[own], a, k) if own in held else a
            if len(held) > 10_000:
                yield pd.DataFrame({key: list(held), "fingerprint": [encode(a) for a in held.values()]})
                held = {}
        yield pd.DataFrame({key: list(held), "fingerprint": [encode(a) for a in held.values()]})

    def last(pdf: pd.DataFrame) -> pd.DataFrame:
        out = decode(pdf["fingerprint"].iloc[0])
        for text in pdf["fingerprint"].iloc[1:]:
            out = merge(out, decode(text), k)
        return pd.DataFrame({key: [pdf[key].iloc[0]], "fingerprint": [encode(out)]})

    narrow = prints.select(key, "fingerprint")
    return narrow.mapInPandas(partial, narrow.schema).groupBy(key).applyInPandas(last, narrow.schema)


def text_digest() -> Column:
    """52 bits of a hash of the text, which a double holds."""
    return F.shiftrightunsigned(F.xxhash64("text"), 12)


class Heads:
    """Where the ranges of (place, digest) begin.

    ``keys`` are first keys of ranges, a digest of None standing for the whole place; the last of a key's ``times``
    ranges goes on to the next key. Only rows that are equal share a key with more than one range."""

    def __init__(self, keys: list[tuple[int, int | None]], times: list[int]):
        self.keys, self.times = keys, times
        self.base = np.concatenate([[0], np.cumsum(times)]).astype(np.int64)
        self.places = np.array([p for p, _ in keys], np.int64)
        self.digests = np.array([-(1 << 63) if d is None else d for _, d in keys], np.int64)
        at, many = np.unique(self.places, return_counts=True)
        self.split = set(at[many > 1].tolist()) | {p for (p, _), n in zip(keys, times) if n > 1}

    def ranges(self, places: np.ndarray, digests: np.ndarray) -> list[list[tuple[int, int]]]:
        """(range, 0) of each row, and (range, 1) for each range that it closes: the least row of a batch that begins
        a range closes the one before. Of a key with several ranges any row closes them, as all are equal."""
        at = np.searchsorted(self.places, places, side="right") - 1
        inside = np.isin(places, list(self.split)) if self.split else np.zeros(len(places), bool)
        for i in np.flatnonzero(inside):
            lo = int(np.searchsorted(self.places, places[i], side="left"))
            at[i] = max(lo, lo + int(np.searchsorted(self.digests[lo:at[i] + 1], digests[i], side="right")) - 1)
        out = [[(int(r), 0)] for r in self.base[at + 1] - 1]
        begins = self.places[at] == places
        order = np.lexsort((digests, at))
        closed: set[int] = set()
        for i in order[begins[order]]:
            head = int(at[i])
            place, digest = self.keys[head]
            same = digest is None or digest == digests[i]
            times = self.times[head]
            if times > 1 and same and head in closed:
                out[i][0] = (int(self.base[head]) + int(i) % times, 0)
            if same and head not in closed:
                # It stays in the key's last range, so that this has one to be followed by the next key.
                closed.add(head)
                before = int(self.base[head]) - 1
                out[i].append((before if before >= 0 else int(self.base[-1]) - 1, 1))
                out[i] += [(int(self.base[head]) + j, 1) for j in range(times - 1)]
        return out


def _repeated(values: list[int]) -> dict[int, int]:
    """How often each of some quantiles occurs."""
    found, many = np.unique(np.array(values, np.int64), return_counts=True)
    return dict(zip(found.tolist(), many.tolist()))


def choose_heads(rows: DataFrame, ranges: int) -> Heads:
    """Quantiles of the places; a place that fills several ranges is split by quantiles of its texts' digests, and a
    row that is repeated through several ranges by turns."""

    def steps(n: int) -> list[float]:
        return [i / n for i in range(n)]

    accuracy = max(10_000, 20 * ranges)
    found = rows.agg(F.percentile_approx("place", steps(ranges), accuracy).alias("q"), F.min("place").alias("least"),
                     F.max(F.abs("doc_id")).alias("far")).first()
    of = _repeated([*(found["q"] or [])])
    if (found["far"] or 0) >= 1 << 53:
        # Quantiles are computed in doubles, which do not hold such ids: take the least id from each quantile on.
        bounds, times = np.array(list(of), np.int64), list(of.values())

        @F.pandas_udf("long")
        def bucket(keys: pd.Series) -> pd.Series:
            return pd.Series(np.searchsorted(bounds, keys.to_numpy(), side="right"))

        least = {r["b"]: r["p"] for r in rows.groupBy(bucket("place").alias("b")).agg(F.min("place").alias("p")).collect()}
        of = {p: times[b - 1] if b else 1 for b, p in sorted(least.items())}
    hot = {p: n for p, n in of.items() if n > 1}
    inner: dict[int, dict[int, int]] = {}
    if hot:
        # At most half as many places as ranges.
        spark = rows.sparkSession
        wanted = F.broadcast(spark.createDataFrame([(p,) for p in hot], "place long"))
        for r in (rows.join(wanted, "place").groupBy("place")
                  .agg(F.percentile_approx("digest", steps(max(hot.values())), accuracy).alias("q"), F.min("digest").alias("d")).collect()):
            # As many of the evenly spaced quantiles as this place fills ranges.
            own = r["q"][::max(1, len(r["q"]) // hot[r["place"]])]
            inner[r["place"]] = {r["d"]: 0} | _repeated(own)
    keys, times = [], []
    for place in sorted({found["least"], *of}):
        for digest, n in sorted(inner.get(place, {None: 1}).items(), key=lambda x: (x[0] is not None, x[0] or 0)):
            keys.append((place, digest))
            times.append(max(n, 1))
    return Heads(keys, times)


def follow(docs: DataFrame, ranges_per_task: int = 4) -> DataFrame:
    """Documents in ascending doc_id within each range: rng, last (whether the row is the next range's
    first document, which only closes this one), doc_id, text; sorted within partitions. Rows of one doc_id follow each
    other by a digest of their text."""
    rows = id_and_text(docs).withColumns({"place": F.coalesce("doc_id", F.lit(-(1 << 63))), "digest": text_digest()})
    n = docs.count()
    # Rows are streamed in order, so a range may hold any number; the driver keeps one entry a range,
    # as many as the cluster has tasks to fill, whatever the input's size.
    ranges = max(1, min(n, ranges_per_task * shuffle_partitions(docs.sparkSession)))
    heads = choose_heads(rows, ranges) if n else Heads([(0, None)], [1])

    @F.pandas_udf("array<struct<rng:long,last:int>>")
    def places(keys: pd.Series, digests: pd.Series) -> pd.Series:
        return pd.Series(heads.ranges(keys.to_numpy(), digests.to_numpy()))

    return (rows.withColumn("to", F.explode(places("place", "digest")))
            .select(F.col("to.rng").alias("rng"), F.col("to.last").alias("last"), "place", "digest", "doc_id", "text")
            .repartition("rng").sortWithinPartitions("rng", "last", "place", "digest", "text"))


def edit(text: str, following: str) -> str:
    """The text with its last half replaced by as much of the following one's start."""
    half = len(text) // 2
    return text[:len(text) - half] + following[:half]


def followed_fingerprints(docs: DataFrame, k: int = K) -> DataFrame:
    """Each document's fingerprint, that of its edited text, and its likeness to both that and the
    next document's (ascending doc_id; after the last, the first)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = WordHashes()
        held = None  # the document that waits for its next one
        closed = None  # the range whose closing row has been used
        for batch in batches:
            out: list[tuple] = []
            for rng, last, doc_id, text in zip(*(batch.column(c).to_pylist() for c in ("rng", "last", "doc_id", "text"))):
                if last and closed == rng:
                    continue
                own = sketch(text, k, hashes=known)
                if held is not None:
                    prior_id, prior_text, prior = held
                    edited = edit(prior_text, text)
                    other = sketch(edited, k, hashes=known)
                    out.append((prior_id, len(prior_text), hashlib.sha256(edited.encode("utf-8")).hexdigest(),
                                encode(prior), encode(other), resemblance(prior, other, k), resemblance(prior, own, k),
                                distinct(prior, k)))
                held, closed = (None, rng) if last else ((doc_id, text, own), None)
            columns = list(zip(*out)) or [()] * 8
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64(), pa.float64())
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(columns, kinds)],
                ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next",
                 "distinct_shingles"])

    return follow(docs).mapInArrow(run, FOLLOWED)
