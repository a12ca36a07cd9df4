"""Quality classifier: random-indexing word vectors pooled per document, and a two-layer network.

1. Units are words and runs of signs, case kept, hashed to ``buckets`` rows. A unit's index vector is
   fixed and sparse (two entries of +1 or -1); its word vector is the sum of the index vectors of the
   units up to two places around it, over every occurrence in all documents. Tasks sum their own
   documents, and the partial tables, of fixed size, are streamed together by row block, as many blocks as there are
   shuffle partitions.
2. A document's features: mean and spread of its units' normed vectors, the mean likeness of
   neighbouring units, and logarithms of its units and of their repetition.
3. ``per_class`` labelled rows of each class, drawn by a hash of doc_id (the documented bound of the
   fit), train a network of one hidden layer in numpy; a fifth of them, kept apart, sets the
   temperature that calibrates its probabilities.

Defined results: null and empty texts have zero features and get the network's answer for those;
repeated rows are scored each; repeated labels of a doc_id count as their largest, other values than
0 and 1 not at all; without labels of both classes every score is the known class's rate (0.5
without any); an empty table gives an empty result; only doc_id and text of documents, and doc_id
and the label, are read.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from auditspark.llm.common import id_and_text, label_remainder, shuffle_partitions, stage
from auditspark.llm.toxicity import labelled_sample, labelled_texts

BUCKETS = 1 << 14
DIMENSIONS = 48
ENTRIES = 2
WINDOW = 2
#: Least number of row blocks in which the tables are sent and summed.
ROW_BLOCKS = 16
#: Units that are worked on at once, and characters from which a text's units are not listed first.
PART = 1 << 16
LONG = 1 << 20
PER_CLASS = 8_000
HIDDEN = 32
THRESHOLD = 0.7
_UNIT = re.compile(r"\w+|[^\w\s]+")


class UnitNumbers(dict):
    """Bucket of a unit; forgets everything when it has grown to ``most``."""

    def __init__(self, buckets: int, most: int = 200_000):
        super().__init__()
        self.buckets, self.most = buckets, most

    def __missing__(self, unit: str) -> int:
        if len(self) >= self.most:
            self.clear()
        n = self[unit] = zlib.crc32(unit.encode("utf-8", "surrogatepass")) % self.buckets
        return n


def unit_ids(text: str, numbers: UnitNumbers) -> np.ndarray:
    if len(text) > LONG:
        return np.fromiter((numbers[m.group()] for m in _UNIT.finditer(text)), dtype=np.int32)
    return np.array([numbers[u] for u in _UNIT.findall(text)], dtype=np.int32)


def index_vectors(buckets: int, dimensions: int) -> tuple[np.ndarray, np.ndarray]:
    """Places and signs of every bucket's entries; one more row, of zeros, separates documents."""
    rng = np.random.default_rng(11)
    places = rng.integers(0, dimensions, (buckets + 1, ENTRIES))
    signs = rng.choice([-1.0, 1.0], (buckets + 1, ENTRIES))
    signs[buckets] = 0.0
    return places, signs


def word_vectors(docs: DataFrame, buckets: int = BUCKETS, dimensions: int = DIMENSIONS) -> np.ndarray:
    """Normed vectors of all buckets (a table of fixed size), from all documents."""
    # A power of two, as the buckets are.
    row_blocks = min(buckets, 1 << max(ROW_BLOCKS, shuffle_partitions(docs.sparkSession)).bit_length() - 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        places, signs = index_vectors(buckets, dimensions)
        numbers = UnitNumbers(buckets)
        table = np.zeros((buckets + 1) * dimensions)
        between = np.full(1, buckets, np.int32)

        def add(parts: list[np.ndarray]) -> None:
            ids = np.concatenate(parts).astype(np.int64)
            for lo in range(0, len(ids), 1 << 20):
                for step in range(1, WINDOW + 1):
                    # Pairs whose left unit is in this part.
                    left = ids[lo:min(lo + (1 << 20), len(ids) - step)]
                    right = ids[lo + step:lo + step + len(left)]
                    for of, at in ((right, left * dimensions), (left, right * dimensions)):
                        for e in range(ENTRIES):
                            np.add(table, np.bincount(at + places[of, e], signs[of, e], len(table)), out=table)

        held, size = [], 0
        for batch in batches:
            for text in batch.column(1).to_pylist():
                ids = unit_ids(text, numbers)
                held += [ids, between, between]
                size += len(ids) + 2
                if size >= 1_000_000:
                    add(held)
                    held, size = [], 0
        if held:
            add(held)
        # Sums of signs are whole numbers.
        rows = table[:buckets * dimensions].astype("<i8").reshape(row_blocks, -1)
        yield pa.RecordBatch.from_arrays([pa.array(range(row_blocks), pa.int32()),
                                          pa.array([r.tobytes() for r in rows], pa.binary())], ["block", "part"])

    def total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for block, part in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                values = np.frombuffer(part, "<i8")
                sums[block] = sums[block] + values if block in sums else values
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()),
                                          pa.array([v.tobytes() for v in sums.values()], pa.binary())],
                                         ["block", "part"])

    schema = "block int, part binary"
    table = np.zeros((row_blocks, buckets // row_blocks * dimensions))
    # Each block's sum is final; together they are the table of fixed size.
    parts = id_and_text(docs).mapInArrow(run, schema).repartition(row_blocks, "block").mapInArrow(total, schema)
    for r in parts.collect():
        table[r["block"]] += np.frombuffer(r["part"], "<i8")
    table = table.reshape(buckets, dimensions)
    size = np.sqrt((table * table).sum(axis=1, keepdims=True))
    return (table / np.maximum(size, 1e-9)).astype(np.float32)


def features(ids: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """Pooled features of one document."""
    d = vectors.shape[1]
    out = np.zeros(2 * d + 3, np.float32)
    if not len(ids):
        return out
    units, counts = np.unique(ids, return_counts=True)
    share = (counts / len(ids)).astype(np.float32)
    own = vectors[units]
    out[:d] = share @ own
    out[d:2 * d] = np.sqrt(np.maximum(share @ (own * own) - out[:d] ** 2, 0.0))
    if len(ids) > 1:
        # Part by part, one unit over the edge.
        alike = [np.einsum("ij,ij->", own[1:], own[:-1]) for own in
                 (vectors[ids[at:at + PART + 1]] for at in range(0, len(ids) - 1, PART))]
        out[2 * d] = sum(alike) / (len(ids) - 1)
    out[2 * d + 1] = np.log1p(len(ids))
    out[2 * d + 2] = np.log(len(ids) / len(units))
    return out


@dataclass
class Network:
    """Standardized input, one hidden layer of rectified units, a logistic output over a temperature."""

    mean: np.ndarray
    spread: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: float
    temperature: float = 1.0

    def logit(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.spread, -8, 8)
        return np.maximum(z @ self.w1 + self.b1, 0.0) @ self.w2 + self.b2

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1.0 / (1.0 + np.exp(-np.clip(self.logit(x) / self.temperature, -30, 30)))


def train(x: np.ndarray, y: np.ndarray, w: np.ndarray, hidden: int = HIDDEN, epochs: int = 40, batch: int = 128,
          rate: float = 3e-3, decay: float = 1e-4, seed: int = 5) -> Network:
    """Adam on the weighted log loss; the last fifth of the rows only sets the temperature."""
    rng = np.random.default_rng(seed)
    order = rng.permutation(len(x))
    apart, own = order[:len(x) // 5], order[len(x) // 5:]
    mean, spread = x[own].mean(axis=0), x[own].std(axis=0) + 1e-3
    net = Network(mean, spread, rng.normal(0, np.sqrt(2 / x.shape[1]), (x.shape[1], hidden)), np.zeros(hidden),
                  rng.normal(0, np.sqrt(1 / hidden), hidden), 0.0)
    z = np.clip((x - mean) / spread, -8, 8)
    w = w / w.mean()
    state = [np.zeros_like(p) for p in (net.w1, net.b1, net.w2, np.zeros(1))]
    square = [np.zeros_like(p) for p in state]
    step = 0
    for epoch in range(epochs):
        slowed = rate * (1 - epoch / epochs) + 1e-5
        own = rng.permutation(own)
        for at in range(0, len(own), batch):
            i = own[at:at + batch]
            h = np.maximum(z[i] @ net.w1 + net.b1, 0.0)
            p = 1.0 / (1.0 + np.exp(-np.clip(h @ net.w2 + net.b2, -30, 30)))
            g = (p - y[i]) * w[i] / len(i)
            back = np.outer(g, net.w2) * (h > 0)
            step += 1
            moves = []
            for k, grad in enumerate((z[i].T @ back + decay * net.w1, back.sum(axis=0), h.T @ g + decay * net.w2,
                                      np.array([g.sum()]))):
                state[k] = 0.9 * state[k] + 0.1 * grad
                square[k] = 0.999 * square[k] + 0.001 * grad * grad
                moves.append(slowed * (state[k] / (1 - 0.9 ** step))
                             / (np.sqrt(square[k] / (1 - 0.999 ** step)) + 1e-8))
            net.w1, net.b1, net.w2 = net.w1 - moves[0], net.b1 - moves[1], net.w2 - moves[2]
            net.b2 -= float(moves[3][0])
    if len(apart):
        logits = net.logit(x[apart])
        grid = np.exp(np.linspace(np.log(0.25), np.log(8.0), 60))
        loss = [float((w[apart] * (np.logaddexp(0.0, logits / t) - y[apart] * logits / t)).sum()) for t in grid]
        net.temperature = float(grid[int(np.argmin(loss))])
    return net


def quality(docs: DataFrame, labels: DataFrame, label: str = "quality", modulus: int = 4, held: int = 2,
            per_class: int = PER_CLASS, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score and predicted of every row of ``docs``."""
    sample, numbers = labelled_sample(labels, label, modulus, held, per_class)
    vectors = word_vectors(docs)
    width = 2 * vectors.shape[1] + 3

    def pool(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = UnitNumbers(len(vectors))
        for batch in batches:
            found = [features(unit_ids(t, known), vectors).tobytes() for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("label"), pa.array(found, pa.binary())],
                                             ["doc_id", "label", "x"])

    rows = labelled_texts(docs, sample).mapInArrow(pool, "doc_id long, label int, x binary").collect()
    rows.sort(key=lambda r: r["doc_id"])
    y = np.array([r["label"] for r in rows], float)
    drawn = [int((y == c).sum()) for c in (0, 1)]
    net = None
    if min(drawn):
        x = np.frombuffer(b"".join(r["x"] for r in rows), np.float32).reshape(len(rows), width).astype(float)
        net = train(x, y, np.where(y == 1, numbers[1] / drawn[1], numbers[0] / drawn[0]))
    rate = 1.0 if drawn[1] else 0.0 if drawn[0] else 0.5

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = UnitNumbers(len(vectors))
        for batch in batches:
            texts = batch.column("text").to_pylist()
            if net is None or not texts:
                scores = np.full(len(texts), rate)
            else:
                scores = net.probability(np.stack([features(unit_ids(t, known), vectors) for t in texts]))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("held_out"), pa.array(scores, pa.float64()),
                 pa.array((scores >= threshold).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    return (id_and_text(docs).withColumn("held_out", label_remainder("doc_id", modulus) == held)
            .mapInArrow(score, "doc_id long, held_out boolean, score double, predicted int"))
