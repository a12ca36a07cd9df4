"""Best-fit packing of token pieces by hierarchical residual packing.

1. Every partition tokenizes its documents and cuts those longer than a sequence into
   pieces: the remainder first, then full-length pieces.
2. Full pieces are sequences of their own. The others are dealt by a hash of their row
   number to groups of bounded size; each group packs its items by best fit, longest first.
3. A group emits its nearly full bins. Its emptiest bins (at most ``carry``) go on as items
   of a merged group, ``chunk // carry`` groups to one, for another best-fit round, until one
   group is left. A group therefore never holds more than about ``chunk`` rows, whatever the
   input's size, and every item is placed: a bin that is not carried on is simply final.
4. A bin is named by its first item, so placements compose by small joins up the tree.

Defined results: a null text is empty and packs as its end id alone; an empty table gives an
empty result; repeated rows are packed as often as they occur; only ``doc_id`` and ``text`` are
read, so other columns cannot clash; equal lengths are ordered by row number; texts of any
length and shape, also long runs of blanks, have the ids that the JSON file gives.
"""

from __future__ import annotations

import base64
import os
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from auditspark.llm.common import id_and_text, stage

CAPACITY = 2048
#: The vocabulary of byte_bpe_50k.json as ranks: tiktoken gives the same ids (tested), in a third of the time.
TOKENIZER = "byte_bpe_50k.tiktoken"
#: The same vocabulary by tokenizers, for texts that the rank form's pattern refuses (runs of about a million blanks).
WHOLE = {TOKENIZER: "byte_bpe_50k.json"}
#: Added tokens, which a rank file does not list. Their strings in a text get these ids.
SPECIAL = {TOKENIZER: {"<|endoftext|>": 50256}}
END_ID = 0

PIECE_SCHEMA = "doc_id long, piece int, start long, length long, ids binary"


@lru_cache(maxsize=4)
def load_encoder(name: str) -> Callable[[str], np.ndarray]:
    """Text to token ids, by a public tokenizer's file name or any tokenizer file's path (the same
    on every executor). Strings of special tokens in a text get those tokens' ids."""
    import public_tokenizers

    path = name if "/" in name else public_tokenizers.path(name)
    if path.endswith(".tiktoken"):
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
        encoding = tiktoken.Encoding(name, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks,
                                     special_tokens=SPECIAL.get(os.path.basename(path), {}))
        def encode(text: str) -> np.ndarray:
            try:
                return encoding.encode_to_numpy(text, allowed_special="all")
            except ValueError as error:
                # The pattern's matcher ran out of stack; nothing has been encoded yet.
                if "Regex" not in str(error) or os.path.basename(path) not in WHOLE:
                    raise
                return load_encoder(WHOLE[os.path.basename(path)])(text)

        return encode
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(path)
    return lambda text: np.array(tok.encode(text, add_special_tokens=False).ids, dtype=np.uint32)


def cut(length: int, capacity: int) -> list[int]:
    """Piece lengths of a document: only the first may be shorter than ``capacity``."""
    first = length % capacity
    return ([first] if first else []) + [capacity] * (length // capacity)


def tokenize_pieces(docs: DataFrame, capacity: int = CAPACITY, tokenizer: str = TOKENIZER,
                    end_id: int = END_ID) -> DataFrame:
    """One row per piece; ``ids`` holds its token ids as little-endian unsigned 32-bit numbers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = load_encoder(tokenizer)
        end = np.array([end_id], dtype="<u4")
        kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary())
        for batch in batches:
            rows: list[tuple] = []
            for doc_id, text in zip(*(c.to_pylist() for c in batch.columns)):
                ids = np.concatenate([encode(text).astype("<u4"), end])
                start = 0
                for piece, n in enumerate(cut(len(ids), capacity)):
                    rows.append((doc_id, piece, start, n, ids[start:start + n].tobytes()))
                    start += n
            columns = list(zip(*rows)) or [()] * len(kinds)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)],
                                             ["doc_id", "piece", "start", "length", "ids"])

    return id_and_text(docs).mapInArrow(run, PIECE_SCHEMA)


def best_fit(ids: np.ndarray, lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, dict[int, int]]:
    """Best fit, longest first. Returns each item's bin (the id of the bin's first item), its
    offset there, and the bins' fill.

    ``waiting[r]`` holds the open bins with room r; bit r of ``room`` says whether there are any,
    so the tightest bin that takes n is the lowest set bit at or above n."""
    bins, offsets = np.empty(len(ids), np.int64), np.empty(len(ids), np.int64)
    fill: dict[int, int] = {}
    waiting: list[list[int]] = [[] for _ in range(capacity + 1)]
    room = 0
    for k in np.lexsort((ids, -lengths)):
        n = int(lengths[k])
        fits = room >> n
        if fits:
            r = n + (fits & -fits).bit_length() - 1
            own = waiting[r].pop()
            if not waiting[r]:
                room &= ~(1 << r)
        else:
            r, own = capacity, int(ids[k])
            fill[own] = 0
        bins[k], offsets[k] = own, fill[own]
        fill[own] += n
        if r > n:
            waiting[r - n].append(own)
            room |= 1 << (r - n)
    return bins, offsets, fill


def pack(items: DataFrame, capacity: int = CAPACITY, chunk: int = 16_384, carry: int = 2_048,
         slack: int | None = None) -> DataFrame:
    """Place every row of ``items`` (a ``length`` column of 1 to ``capacity``, any others) in a sequence.

    Adds ``sequence_id`` (any unique number) and ``offset``. A bin with at most ``slack`` room
    (default: a 64th of the capacity) counts as nearly full."""
    limit = capacity - (capacity // 64 if slack is None else slack)
    table = stage(items.withColumn("item_id", F.monotonically_increasing_id()))
    loose = table.where(F.col("length") < capacity).select(F.col("item_id").alias("id"), F.col("length").cast("long"))
    groups = max(1, -(-loose.count() // chunk))

    def best_fit_round(last: bool):
        def run(pdf: pd.DataFrame) -> pd.DataFrame:
            ids, lengths, group = pdf["id"].to_numpy(), pdf["length"].to_numpy(), int(pdf["grp"].iloc[0])
            bins, offsets, fill = best_fit(ids, lengths, capacity)
            under = [] if last else sorted((used, b) for b, used in fill.items() if used < limit)[:carry]
            return pd.DataFrame({
                "id": np.concatenate([ids, [b for _, b in under]]).astype("int64"),
                "bin": np.concatenate([bins, [b for _, b in under]]).astype("int64"),
                "at": np.concatenate([offsets, [used for used, _ in under]]).astype("int64"),
                "grp": group, "on": [False] * len(ids) + [True] * len(under)})
        return run

    schema = "id long, bin long, at long, grp long, on boolean"
    frame = loose.withColumn("grp", F.pmod(F.xxhash64("id"), F.lit(groups)))
    rounds = []
    while True:
        done = stage(frame.groupBy("grp").applyInPandas(best_fit_round(groups == 1), schema))
        rounds.append(done)
        if groups == 1:
            break
        fan_in = max(2, chunk // carry)
        groups = -(-groups // fan_in)
        frame = done.where("on").select("id", F.col("at").alias("length"),
                                        F.floor(F.col("grp") / fan_in).alias("grp"))
    roots = None
    for done in reversed(rounds):
        moved = done.where(~F.col("on")).select("id", "bin", "at")
        if roots is not None:
            up = roots.select(F.col("id").alias("bin"), F.col("bin").alias("root"), F.col("at").alias("shift"))
            moved = moved.join(up, "bin", "left").select(
                "id", F.coalesce("root", "bin").alias("bin"), (F.col("at") + F.coalesce("shift", F.lit(0))).alias("at"))
        roots = moved
    placed = table.join(roots.withColumnRenamed("id", "item_id"), "item_id", "left")
    return placed.select(*items.columns, F.coalesce("bin", "item_id").alias("sequence_id"),
                         F.coalesce("at", F.lit(0)).cast("long").alias("offset"))


def pack_documents(docs: DataFrame, capacity: int = CAPACITY, tokenizer: str = TOKENIZER) -> DataFrame:
    """Tokenize, cut and pack: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    The ids themselves stay in ``tokenize_pieces``; packing moves only their lengths and digests."""
    pieces = tokenize_pieces(docs, capacity, tokenizer)
    return pack(pieces.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32")), capacity)
