"""SimHash near-duplicates by deletion-variant signatures.

Fingerprints: 64 majority bits over the XXH64 hashes of all word shingles of a text.

Two fingerprints that differ in at most 4 bits are cut into 3 segments; by the pigeonhole principle
one segment differs in at most one bit. So every distinct fingerprint is indexed under, for each
segment and each bit of it, the segment with that bit left out: 64 signatures. Two fingerprints
within 4 bits share at least one; equality on signatures finds them, and the whole fingerprints are
then compared.

Rows of one signature arrive together and sorted, and are streamed. A small run reports its verified
pairs; a larger one reports a spanning forest of its links, one link a row at most, so no group is
expanded into all pairs and no connection is lost. A run above ``hot`` fingerprints is not compared
at once: its rows are indexed again under one-wildcard signatures of the bits that no signature has used yet,
by the same argument, and spread over the cluster; and so on until no run is above ``hot``, or so few bits are
left that a run cannot hold many distinct fingerprints.

Copies share a fingerprint and take part once, so a group of copies costs one row.

Defined results: a null text is empty; texts without words have fingerprint zero and link like any
other; fewer than 4 words hash as one shingle; repeated rows each get their component; a component
of null doc_ids alone has a null id; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import accumulate, islice

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from auditspark.llm.common import id_and_text, row_key, stage
from auditspark.llm.components import components

#: Fixed by the contract.
WORDS = 4
SEED = 42
BITS = 64
MOST_BITS = 4

SMALL_RUN = 16
HOT_RUN = 20_000
HASHES_AT_ONCE = 65_536
#: Bytes of a text that are split into words at once.
PART = 1 << 20
#: With so many bits left or fewer, a run's distinct fingerprints are few: one for each value of these bits and of the
#: bits left out on the way.
LAST_BITS = 14
_BLANK = re.compile(rb"[\x20\x09-\x0D]")


def _digests(text: str) -> Iterator[bytes]:
    """XXH64 of every shingle, in order; a very long text is taken apart at blanks, a part at a time."""
    # bytes.lower and bytes.split know ASCII letters and the six ASCII blanks only.
    data, carry, at, some = text.encode("utf-8", "surrogatepass").lower(), [], 0, False
    while at < len(data):
        gap = _BLANK.search(data, at + PART) if at + PART < len(data) else None
        end = gap.start() if gap else len(data)
        words = carry + data[at:end].split()
        at = end
        if len(words) >= WORDS:
            body, ends = b" ".join(words), list(accumulate(len(w) + 1 for w in words))
            yield from (xxhash.xxh64_digest(body[a:b - 1], SEED) for a, b in zip([0, *ends], ends[WORDS - 1:]))
            words, some = words[1 - WORDS:], True
        carry = words
    if carry and not some:
        yield xxhash.xxh64_digest(b" ".join(carry), SEED)


def fingerprint(text: str) -> int:
    """The fingerprint of a whole text, as a signed 64-bit number."""
    digests, n, set_in = _digests(text), 0, np.zeros(BITS, np.int64)
    # A byte per bit: added up in parts, so that a very long text needs no more room than a part.
    while part := b"".join(islice(digests, HASHES_AT_ONCE)):
        n += len(part) // 8
        set_in += np.unpackbits(np.frombuffer(part, np.uint8)).reshape(-1, BITS).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * set_in > n).tobytes(), "big", signed=True) if n else 0


def fingerprints(docs: DataFrame, keyed: bool = False) -> DataFrame:
    """doc_id, fp and, if ``keyed``, row_key of every row; one narrow pass, no shuffle."""
    keys = ["row_key"] if keyed else []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = [fingerprint(t) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(prints, pa.int64()), *batch.columns[2:]],
                                             ["doc_id", "fp", *keys])

    rows = id_and_text(docs)
    return (rows.select("doc_id", "text", *[row_key().alias(k) for k in keys])
            .mapInArrow(run, ", ".join(["doc_id long, fp long", *[f"{k} binary" for k in keys]])))


def segments(bits: list[int], most_bits: int) -> list[list[int]]:
    """As few segments of ``bits`` as make one of them differ in at most one of ``most_bits`` bits."""
    count = most_bits // 2 + 1
    edges = [round(i * len(bits) / count) for i in range(count + 1)]
    return [bits[a:b] for a, b in zip(edges, edges[1:])]


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def variant_masks(bits: list[int], most_bits: int) -> list[tuple[int, list[int]]]:
    """For every segment and bit of it: the mask of the segment without the bit, and the segment's bits."""
    return [(_signed(sum(1 << b for b in seg if b != wild)), seg)
            for seg in segments(bits, most_bits) for wild in seg]


def link_run(fps: np.ndarray, most_bits: int) -> list[tuple[np.uint64, np.uint64]]:
    """A spanning forest of the links among distinct fingerprints: each is compared, when it is
    reached, with those not reached yet."""
    out, left = [], fps.view(np.uint64)
    while len(left):
        reached, left = [left[0]], left[1:]
        while reached and len(left):
            at = reached.pop()
            near = np.bitwise_count(left ^ at) <= most_bits
            if near.any():
                found = left[near]
                out += [(at, x) for x in found]
                reached += list(found)
                left = left[~near]
    return out


def _linker(keys: list[str], most_bits: int, hot: int | None):
    """A streaming task over rows sorted by ``keys``: links (a, b), or the rows of hot runs (a null b), which keep their
    keys."""

    def emit(key, a, b):
        return pa.RecordBatch.from_arrays([*[pa.array(k, pa.int64()) for k in key], pa.array(a, pa.int64()), pa.array(b, pa.int64())],
                                          [*keys, "a", "b"])

    def settle(key: list[np.ndarray], fps: np.ndarray):
        """All runs of sorted rows."""
        change = np.zeros(len(fps), bool)
        change[0] = True
        for k in key:
            change[1:] |= k[1:] != k[:-1]
        starts = np.flatnonzero(change)
        sizes = np.diff(np.append(starts, len(fps)))
        run_of = np.repeat(np.arange(len(starts)), sizes)
        left, right = [], []
        small = np.repeat(sizes <= SMALL_RUN, sizes)
        at = np.flatnonzero(small)
        for step in range(1, SMALL_RUN):
            at = at[at + step < len(fps)]
            at = at[run_of[at + step] == run_of[at]]
            if not len(at):
                break
            near = np.bitwise_count((fps[at] ^ fps[at + step]).view(np.uint64)) <= most_bits
            left.append(fps[at[near]])
            right.append(fps[at[near] + step])
        for i in np.flatnonzero(sizes > SMALL_RUN):
            pairs = link_run(fps[starts[i]:starts[i] + sizes[i]], most_bits)
            if pairs:
                ends = np.array(pairs, np.uint64).view(np.int64)
                left.append(ends[:, 0])
                right.append(ends[:, 1])
        a = np.concatenate(left) if left else np.empty(0, np.int64)
        b = np.concatenate(right) if right else np.empty(0, np.int64)
        return emit([np.full(len(a), -1)] * len(key), a, b)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Rows of the run that may go on in the next batch; at most a batch more than ``hot``.
        held: list[np.ndarray] | None = None
        spilling = None  # key of a hot run whose rows pass through
        for batch in batches:
            if not batch.num_rows:
                continue
            now = [batch.column(c).to_numpy() for c in (*keys, "fp")]
            if spilling is not None:
                same = np.logical_and.reduce([k == s for k, s in zip(now, spilling)])
                n = len(same) if same.all() else int(np.argmin(same))
                if n:
                    yield emit([k[:n] for k in now[:-1]], now[-1][:n], [None] * n)
                    now = [c[n:] for c in now]
                if not len(now[-1]):
                    continue
                spilling = None
            if held is not None:
                now = [np.concatenate(c) for c in zip(held, now)]
            tail = np.logical_and.reduce([k == k[-1] for k in now[:-1]])
            cut = len(tail) - int(np.argmin(tail[::-1])) if not tail.all() else 0
            if cut:
                yield settle([k[:cut] for k in now[:-1]], now[-1][:cut])
            held = [c[cut:] for c in now]
            if hot is not None and len(held[-1]) > hot:
                yield emit(held[:-1], held[-1], [None] * len(held[-1]))
                spilling, held = [k[-1] for k in held[:-1]], None
        if held is not None:
            yield settle(held[:-1], held[-1])

    return run


def _mix(run: np.ndarray, mask: int, part: np.ndarray) -> np.ndarray:
    """Numbers of the parts of runs. Two that meet by chance share a run, which costs comparisons and nothing else."""
    x = (run.view(np.uint64) ^ np.uint64(mask & (1 << 64) - 1)) * np.uint64(0x9E3779B97F4A7C15) + part.view(np.uint64)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    return (x ^ (x >> np.uint64(31))).view(np.int64)


def split_runs(rows: DataFrame, most_bits: int) -> DataFrame:
    """Rows (run, used, fp) of runs whose members differ in at most ``most_bits`` of the bits not ``used``: one row for each
    one-wildcard signature of these bits, with the parts as new runs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[int, list[tuple[int, int]]] = {}
        for batch in batches:
            runs, used, fps = (batch.column(c).to_numpy() for c in ("run", "used", "fp"))
            for own in np.unique(used):
                if own not in known:
                    bits = [b for b in range(BITS) if not int(own) >> b & 1]
                    known[own] = [(mask, _signed(int(own) & (1 << BITS) - 1 | sum(1 << b for b in seg)))
                                  for mask, seg in variant_masks(bits, most_bits)]
                at = np.flatnonzero(used == own)
                for mask, more in known[own]:
                    yield pa.RecordBatch.from_arrays([pa.array(_mix(runs[at], mask, fps[at] & np.int64(mask))),
                                                      pa.array(np.full(len(at), more)), pa.array(fps[at])], ["run", "used", "fp"])

    return rows.select("run", "used", "fp").mapInArrow(run, "run long, used long, fp long")


def links(prints: DataFrame, most_bits: int = MOST_BITS, hot: int = HOT_RUN) -> DataFrame:
    """Links (a, b) between distinct fingerprints ``fp`` that connect exactly those that a chain of
    pairs within ``most_bits`` bits connects."""
    variants = variant_masks(list(range(BITS)), most_bits)
    masks = F.array(*[F.lit(m) for m, _ in variants])
    rows = prints.select("fp", F.posexplode(F.transform(masks, lambda m: F.col("fp").bitwiseAND(m))).alias("slot", "part"))
    found = stage(rows.withColumn("slot", F.col("slot").cast("long")).repartition("slot", "part").sortWithinPartitions("slot", "part", "fp")
                  .mapInArrow(_linker(["slot", "part"], most_bits, hot), "slot long, part long, a long, b long"))
    pairs = found.where(F.col("b").isNotNull()).select("a", "b")
    whole = F.array(*[F.lit(_signed(sum(1 << b for b in seg))) for _, seg in variants])
    left = found.where(F.col("b").isNull()).select(
        F.xxhash64("slot", "part").alias("run"), F.element_at(whole, F.col("slot").cast("int") + 1).alias("used"),
        F.col("a").alias("fp"))
    # Members of a hot run agree in one segment but for one bit, so in the other bits they differ in at most most_bits,
    # of which one segment has at most one: the same index over the rest, within the run, again and again.
    bits = BITS - BITS // (most_bits // 2 + 1)
    while not left.isEmpty():
        bits -= len(segments(list(range(bits)), most_bits)[0])
        keys = ["run", "used"]
        found = stage(split_runs(left, most_bits).repartition(*keys).sortWithinPartitions(*keys, "fp")
                      .mapInArrow(_linker(keys, most_bits, hot if bits > LAST_BITS else None), "run long, used long, a long, b long"))
        pairs = pairs.unionByName(found.where(F.col("b").isNotNull()).select("a", "b"))
        left = found.where(F.col("b").isNull()).select("run", "used", F.col("a").alias("fp"))
    return pairs


def _rooted(by_print: DataFrame, most_bits: int) -> DataFrame:
    """fp, least and root (the least fingerprint of the component, never null) of distinct fingerprints."""
    roots = components(links(by_print.select("fp"), most_bits))
    return (by_print.join(roots.withColumnRenamed("node", "fp"), "fp", "left")
            .select("fp", "least", F.coalesce("root", "fp").alias("root")))


def representatives(docs: DataFrame, most_bits: int = MOST_BITS) -> DataFrame:
    """row_key of one row of each component: of the least doc_id, nulls last, then of the least key."""
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row_key"))
    by_print = stage(fingerprints(docs, keyed=True).groupBy("fp").agg(first.alias("least")))
    return (_rooted(by_print, most_bits).groupBy("root").agg(F.min("least").alias("least"))
            .select(F.col("least.row_key").alias("row_key")))


def near_duplicates(docs: DataFrame, most_bits: int = MOST_BITS) -> DataFrame:
    """doc_id, fp and component_id (the least doc_id reachable over links) of every row."""
    prints = stage(fingerprints(docs))
    by_print = stage(prints.groupBy("fp").agg(F.min("doc_id").alias("least")))
    rooted = _rooted(by_print, most_bits)
    own = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    of_print = rooted.join(own, "root").select("fp", "component_id")
    return prints.join(of_print, "fp").select("doc_id", "fp", "component_id")
