"""Conversation structure repair by square-root checkpointed dynamic programming.

A conversation is well formed if its role initials read ``(s?(ua)+)?``. Its rows are edited in order:
Keep 0, Rerole (to user or assistant) 2, Delete 3 (required for blank and duplicate rows), Insert an
empty user or assistant row 2; a truncated row that is not deleted adds 1. Of all cheapest edits the
ones whose initials (D, I, K, R) come first in ASCII order are emitted.

1. Rows become items (conversation, turn, role, digest of the text) with a count, so exact repeats are
   one item however many there are, and the first turn of each (role, text) is a grouped minimum:
   both are reduced on the mappers and move digests, not texts.
2. A conversation's items, in order, are one byte a row. The backward pass keeps the cost vectors of
   the four states only at every sqrt(n)-th row; the walk forward recomputes one block of vectors at a
   time from its checkpoint and takes the least letter whose cost is tight. Every letter leads to one
   state, so the walk is exact. Memory is n bytes and O(sqrt(n)) vectors.
3. The audit, as a first row, and the texts of its conversation are streamed past in the same order
   and hashed: no conversation is gathered. The audit is one cell and the hash is one sequence by
   contract, so one task streams a conversation's rows, sorted (Spark spills), whatever their number.

Defined results: nulls of conv_id and turn are a space in the damage key, null roles and texts are a
space (such a text is blank); rows of null conv_id are one conversation; rows are ordered by turn (null
first), then role, then SHA-256 of the text, so reruns agree and repeats are adjacent; a role
without one of the initials s, u, a (an empty one too) cannot be kept; gaps stop at the greatest long;
an empty table gives an empty result; only the four named columns are read.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from auditspark.llm.common import stage

KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 2, 3, 2, 1
#: Damage codes of the contract: crc32 of "conv_id:turn" modulo this.
DAMAGE_MODULUS = 20
SPACES = " \t\n\x0b\x0c\r"
_INF = 1 << 60

# States: nothing yet, after system, after user, after assistant. A row of initial i leads from a
# state to _AFTER[state][i], or nowhere (-1); initials: 0 none of these, 1 s, 2 u, 3 a.
_AFTER = ((-1, 1, 2, -1), (-1, -1, 2, -1), (-1, -1, -1, 3), (-1, -1, 2, -1))
#: The one state that an inserted or reroled row leads to, and its role.
_NEXT = (2, 2, 3, 2)
_ROLE = {2: "user", 3: "assistant"}
#: Bits of a row's code beside the initial.
_CUT, _MUST_GO, _BLANK = 4, 8, 16
END = (0, _INF, _INF, 0)


def _with_inserts(v: list[int]) -> tuple[int, int, int, int]:
    """Cost vector when rows may be inserted before going on."""
    u = min(v[2], INSERT + v[3])
    a = min(v[3], INSERT + v[2])
    return min(v[0], INSERT + u), min(v[1], INSERT + u), u, a


def _before(code: int, v: tuple) -> tuple[int, int, int, int]:
    """Cost vector before a row, from the one after it."""
    out = [DELETE + c for c in v]
    if not code & _MUST_GO:
        extra = TRUNCATED if code & _CUT else 0
        for state in range(4):
            after = _AFTER[state][code & 3]
            if after >= 0:
                out[state] = min(out[state], KEEP + extra + v[after])
            out[state] = min(out[state], REROLE + extra + v[_NEXT[state]])
    return _with_inserts(out)


def repair(codes: bytes) -> tuple[int, str]:
    """Least cost and the ASCII-least audit of a conversation, from its rows' codes."""
    n = len(codes)
    block = max(1, math.isqrt(n))
    # Backward: only the vectors at block ends are kept.
    last = _with_inserts(list(END))
    checkpoints = {n: last}
    v = last
    for i in range(n - 1, -1, -1):
        v = _before(codes[i], v)
        if i % block == 0:
            checkpoints[i] = v
    cost, state, letters = v[0], 0, []
    for start in range(0, n, block):
        end = min(start + block, n)
        vectors = [checkpoints[end]]
        for i in range(end - 1, start - 1, -1):
            vectors.append(_before(codes[i], vectors[-1]))
        vectors.reverse()
        for i in range(start, end):
            here, after, code = vectors[i - start], vectors[i - start + 1], codes[i]
            while True:
                left, to = here[state], _NEXT[state]
                if left == DELETE + after[state]:
                    letters.append("D")
                    break
                if left == INSERT + here[to]:
                    letters.append("I")
                    state = to
                    continue
                extra, kept = TRUNCATED if code & _CUT else 0, _AFTER[state][code & 3]
                if kept >= 0 and left == KEEP + extra + after[kept]:
                    letters.append("K")
                    state = kept
                else:
                    letters.append("R")
                    state = to
                break
    while last[state]:
        letters.append("I")
        state = _NEXT[state]
    return cost, "".join(letters)


def damage(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text and copies (0: dropped) of every row, damaged by the contract's rule."""
    space = F.lit(" ")

    def of(name: str, kind: str) -> Column:
        return F.col(name).cast(kind)

    key = F.concat(F.coalesce(of("conv_id", "long").cast("string"), space), F.lit(":"),
                   F.coalesce(of("turn", "long").cast("string"), space))
    code = F.crc32(key.cast("binary")) % DAMAGE_MODULUS
    text = F.coalesce(of("text", "string"), space)
    return conversations.select(
        of("conv_id", "long").alias("conv_id"), of("turn", "long").alias("turn"),
        F.when(code == 4, F.lit("user")).otherwise(F.coalesce(of("role", "string"), space)).alias("role"),
        F.when(code == 1, F.lit("")).when(code == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(text).alias("text"),
        F.when(code == 0, F.lit(0)).when(code == 3, F.lit(2)).otherwise(F.lit(1)).alias("copies"))


def intact(conversations: DataFrame) -> DataFrame:
    """The columns of ``damage`` without any damage, for repairing conversations as they are."""
    return damage(conversations.where(F.lit(False))).unionByName(conversations.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
        F.coalesce(F.col("role").cast("string"), F.lit(" ")).alias("role"),
        F.coalesce(F.col("text").cast("string"), F.lit(" ")).alias("text"), F.lit(1).alias("copies")))


def _items(rows: DataFrame) -> DataFrame:
    """Distinct rows of each conversation with their count, whether they are the first of their role
    and text, and the code of such a first row."""
    ended = F.rtrim(F.col("text"), F.lit(SPACES))
    blank, last = F.length(ended) == 0, F.substring(ended, -1, 1)
    first = F.substring("role", 1, 1)
    code = (F.when(first == "s", 1).when(first == "u", 2).when(first == "a", 3).otherwise(0)
            + F.when(blank, F.lit(_BLANK)).when(~last.isin(".", "!", "?"), F.lit(_CUT)).otherwise(0))
    light = rows.select("conv_id", "turn", "role", "digest", "copies", code.alias("code"))
    items = (light.groupBy("conv_id", "turn", "role", "digest")
             .agg(F.sum("copies").alias("n"), F.max("code").alias("code")))
    place = F.struct(F.col("turn").isNotNull().alias("known"), F.col("turn").alias("turn"))
    firsts = (items.where(F.col("n") > 0).groupBy("conv_id", "role", "digest").agg(F.min(place).alias("place"))
              .select(F.col("conv_id").alias("c"), F.col("role").alias("r"), F.col("digest").alias("d"),
                      F.col("place.turn").alias("first_turn")))
    same = (F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("role") == F.col("r")) & (F.col("digest") == F.col("d")))
    return (items.join(firsts, same, "left")
            .select("conv_id", "turn", "role", "digest", "n", "code", F.col("turn").eqNullSafe(F.col("first_turn")).alias("is_first")))


#: Spark sorts nulls first.
_ORDER = ("conv_id", "turn", "role", "digest")
AUDIT = ("conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string")


def _audits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per conversation of a stream of items sorted by conversation and place."""
    names = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit"]
    kinds = [pa.int64()] * 7 + [pa.string()]
    out: list[tuple] = []
    own = None  # [conv_id, codes, blank, duplicate, truncated, illegal, previous initial, turns, least, greatest]

    def close() -> None:
        cost, audit = repair(bytes(own[1]))
        gaps = min(own[9] - own[8] + 1 - own[7], (1 << 63) - 1) if own[7] else 0
        out.append((own[0], gaps, *own[2:6], cost, audit))

    for batch in batches:
        for conv, turn, n, code, is_first in zip(*(c.to_pylist() for c in batch.columns)):
            if own is None or own[0] != conv:
                if own is not None:
                    close()
                own = [conv, bytearray(), 0, 0, 0, 0, -1, 0, None, None]
            if not n:
                continue
            initial = code & 3
            if own[6] >= 0 and (own[6], initial) not in ((1, 2), (2, 3), (3, 2)):
                own[5] += 1
            own[5] += n - 1  # repeats stand beside each other, and no role may follow itself
            own[6] = initial
            if turn is not None and turn != own[9]:
                own[7] += 1
                own[8] = turn if own[8] is None else own[8]
                own[9] = turn
            if code & _BLANK:
                own[2] += n
                own[1] += bytes([initial | _MUST_GO]) * n
                continue
            repeats = n - 1 if is_first else n
            if is_first:
                own[4] += bool(code & _CUT)
                own[1].append(code)
            own[3] += repeats
            own[1] += bytes([initial | _MUST_GO]) * repeats
        if len(out) >= 1024:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names)
            out.clear()
    if own is not None:
        close()
    if out:
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names)


class _Replay:
    """Applies an audit to its conversation's rows as they come by, hashing the repaired lines."""

    def __init__(self, audit: str):
        self.audit, self.at, self.state, self.hash, self.begun = audit, 0, 0, hashlib.sha256(), False

    def line(self, role: str, text: str) -> None:
        self.hash.update((("\n" if self.begun else "") + role + ":" + text).encode("utf-8", "surrogatepass"))
        self.begun = True

    def inserted(self) -> None:
        while self.at < len(self.audit) and self.audit[self.at] == "I":
            self.at += 1
            self.state = _NEXT[self.state]
            self.line(_ROLE[self.state], "")

    def row(self, role: str, text: str) -> None:
        self.inserted()
        letter = self.audit[self.at]
        self.at += 1
        if letter == "K":
            self.state = _AFTER[self.state][" sua".index(role[0])]
            self.line(role, text)
        elif letter == "R":
            self.state = _NEXT[self.state]
            self.line(_ROLE[self.state], text)


def _hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """conv_id and the hash of its repaired lines, of a stream in which each audit precedes its rows."""
    done: list[tuple] = []
    conv, replay = None, None

    def close() -> None:
        replay.inserted()
        done.append((conv, replay.hash.hexdigest()))

    def rows() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([c for c, _ in done], pa.int64()),
                                           pa.array([h for _, h in done], pa.string())], ["conv_id", "repaired_sha256"])

    for batch in batches:
        for own, role, text, copies, audit in zip(*(c.to_pylist() for c in batch.columns)):
            if audit is not None:
                if replay is not None:
                    close()
                conv, replay = own, _Replay(audit)
            else:
                for _ in range(copies):
                    replay.row(role, text)
        if len(done) >= 1024:
            yield rows()
            done.clear()
    if replay is not None:
        close()
    if done:
        yield rows()


def repair_conversations(rows: DataFrame) -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256 of every conversation of
    ``rows`` (as ``damage`` or ``intact`` give them)."""
    rows = rows.withColumn("digest", F.unhex(F.sha2(F.col("text").cast("binary"), 256)))
    # Conversations without a row left stay, as items without copies.
    audits = stage(_items(rows).repartition("conv_id").sortWithinPartitions(*_ORDER)
                   .select("conv_id", "turn", "n", "code", "is_first").mapInArrow(_audits, AUDIT))
    none = F.lit(None)
    heads = audits.select("conv_id", none.cast("long").alias("turn"), none.cast("string").alias("role"),
                          none.cast("binary").alias("digest"), none.cast("string").alias("text"), F.lit(0).alias("copies"),
                          "audit")
    texts = (rows.where(F.col("copies") > 0)
             .select("conv_id", "turn", "role", "digest", "text", "copies", none.cast("string").alias("audit")))
    order = [_ORDER[0], F.col("audit").isNull(), *_ORDER[1:]]
    hashes = (heads.unionByName(texts).repartition("conv_id").sortWithinPartitions(*order)
              .select("conv_id", "role", "text", "copies", "audit")
              .mapInArrow(_hashes, "conv_id long, repaired_sha256 string"))
    own = hashes.select(F.col("conv_id").alias("own"), "repaired_sha256")
    return audits.join(own, F.col("conv_id").eqNullSafe(F.col("own"))).drop("own")
