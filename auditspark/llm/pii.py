"""Personal data: rules, and a character-level BiLSTM-CRF trained on the spans that rules label.

1. Base spans are the leftmost matches of four patterns that pass their checks, found in linear time.
2. Windows of 64 characters every 32 are laid over each text. Only windows with a digit or ``@`` are
   decoded: a span must hold one to pass its check, so the others cannot give any.
3. About ``sample_docs`` documents drawn by a hash give at most ``windows`` distinct windows, half of them
   at most without a span (the documented bound of the fit); their characters' tags come from the labelled
   spans (by default the base spans). The network is trained on them in numpy.
4. Every text's windows are decoded. A span that is cut by its window's edge is left to the next window,
   which holds it whole. All other candidates of a text are reconciled at once: what overlaps a labelled
   span, fails its kind's check or is less probable than ``least`` goes; of the rest the non-overlapping
   set of greatest total probability stays, and is added to the base spans.

Spans are code points, end exclusive. Defined results: null texts are empty and have no spans; repeated
rows are each scanned; without labelled spans nothing is trained and only base spans are found; spans of the
model are at most 64 characters; equal totals keep the earlier ends; an empty table gives an empty
result; only doc_id and text are read.
"""

from __future__ import annotations

import heapq
import re
from bisect import bisect_right
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from auditspark.llm.common import id_and_text
from auditspark.llm.tagger import WIDTH, Tagger, encode

#: Fixed by the contract: kinds in order, their patterns and checks.
KINDS = ("email", "ip", "card", "phone")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
# A run of digits is entered at its start only, and given up as a whole: linear time.
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9]++(?:[\x20-][0-9]++)*+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_TRIGGER = re.compile(r"[0-9@]")

STRIDE = WIDTH // 2
SAMPLE_DOCS = 20_000
WINDOWS = 2_000
LEAST = 0.9
#: Windows that are decoded together.
BATCH = 1_024

Span = tuple[int, int, int]
FOUND = "found array<struct<start:int,end:int,kind:string,rule:boolean,probability:double>>"


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def passes(kind: int, text: str) -> bool:
    """The check of a kind, on the text of a span."""
    if kind == 0:
        return text.count("@") == 1 and not text.startswith("@") and not text.endswith("@")
    digits = _digits(text)
    if kind == 1:
        parts = re.findall("[0-9]+", text)
        return len(parts) == 4 and all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in parts)
    if kind == 2:
        return 12 <= len(digits) <= 19 and luhn(digits)
    return 9 <= len(digits) <= 15


def _emails(text: str) -> Iterator[Span]:
    # The run before an @ can only match up to it, so a search from @ to @ finds the leftmost matches.
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        domain = _DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            done = domain.end()
            yield start, done, 0
        at = text.find("@", max(at + 1, done))


def base_spans(text: str) -> list[Span]:
    """(start, end, kind) by start, then kind."""
    out = list(_emails(text))
    if _TRIGGER.search(text):
        for kind, pattern in ((1, _IP), (2, _CARD), (3, _PHONE)):
            out += [(m.start(), m.end(), kind) for m in pattern.finditer(text) if passes(kind, m[0])]
    return sorted(out, key=lambda s: (s[0], s[2]))


def window_starts(text: str) -> Iterator[int]:
    """Starts of the windows that hold a digit or @, in order."""
    done, found = -1, _TRIGGER.search(text)
    while found:
        place = found.start()
        first, last = max(done + 1, (place - WIDTH) // STRIDE + 1, 0), place // STRIDE
        for w in range(first, last + 1):
            yield w * STRIDE
        done = last
        found = _TRIGGER.search(text, (last + 1) * STRIDE)


def tags_of(start: int, spans: list[Span]) -> list[int]:
    """Tags of the window at ``start``; of overlapping spans the one that begins first counts."""
    tags, free = [0] * WIDTH, 0
    for a, b, kind in spans:
        if a >= free:
            free = b
            for i in range(max(a, start), min(b, start + WIDTH)):
                tags[i - start] = 1 + 2 * kind if i == a else 2 + 2 * kind
    return tags


def labelled_windows(docs: DataFrame, label: Callable[[str], list[Span]] = base_spans, sample_docs: int = SAMPLE_DOCS,
                     windows: int = WINDOWS) -> list[tuple[str, list[int]]]:
    """At most ``windows`` distinct windows, with tags, of about ``sample_docs`` documents drawn by a hash."""
    rows = id_and_text(docs)
    share = min(1.0, sample_docs / max(rows.count(), 1))
    drawn = rows.where(F.pmod(F.xxhash64("doc_id", "text"), F.lit(1_000_000)) < int(share * 1_000_000) + 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[bool, list] = {True: [], False: []}  # the least hashes of each class, negated
        have: set[int] = set()
        for batch in batches:
            for text in batch.column(0).to_pylist():
                spans = None
                for start in window_starts(text):
                    spans = label(text) if spans is None else spans
                    window = text[start:start + WIDTH]
                    near = spans[bisect_right(spans, (start - 4096,)):bisect_right(spans, (start + WIDTH,))]
                    tags = tags_of(start, near)
                    mark = xxhash.xxh64_intdigest(f"{window}{tags}".encode("utf-8", "surrogatepass")) >> 1
                    if mark in have:
                        continue
                    heap, item = best[any(tags)], (-mark, window, tags)
                    if len(heap) < windows:
                        heapq.heappush(heap, item)
                        have.add(mark)
                    elif item > heap[0]:
                        have.discard(-heapq.heapreplace(heap, item)[0])
                        have.add(mark)
        rows = [(-m, w, t, c) for c, heap in best.items() for m, w, t in heap]
        columns = list(zip(*rows)) or [()] * 4
        yield pa.RecordBatch.from_arrays(
            [pa.array(c, k) for c, k in zip(columns, (pa.int64(), pa.string(), pa.list_(pa.int32()), pa.bool_()))],
            ["mark", "window", "tags", "marked"])

    found = drawn.select("text").mapInArrow(run, "mark long, window string, tags array<int>, marked boolean").distinct()
    marked = found.where("marked").orderBy("mark", "window").limit(windows - windows // 2)
    bare = found.where("not marked").orderBy("mark", "window").limit(windows // 2)
    return [(r["window"], list(r["tags"])) for part in (marked, bare) for r in part.collect()]


def fit(windows: list[tuple[str, list[int]]], epochs: int = 10) -> Tagger | None:
    """A trained network, or None without any labelled span."""
    if not any(any(tags) for _, tags in windows):
        return None
    tagger = Tagger.new(len(KINDS))
    tagger.train(np.array([encode(w) for w, _ in windows]), np.array([t for _, t in windows]), epochs)
    return tagger


def reconcile(candidates: list[tuple[int, int, int, float]]) -> list[tuple[int, int, int, float]]:
    """The non-overlapping candidates of greatest total probability."""
    best: dict[Span, float] = {}
    for a, b, kind, p in candidates:
        best[a, b, kind] = max(p, best.get((a, b, kind), 0.0))
    order = sorted(((a, b, k, p) for (a, b, k), p in best.items()), key=lambda s: (s[1], s[0], s[2]))
    ends, totals, chosen = [s[1] for s in order], [0.0], []
    for i, (a, _, _, p) in enumerate(order):
        before = bisect_right(ends, a, 0, i)
        take = totals[before] + p > totals[i]
        chosen.append(before if take else -1)
        totals.append(totals[before] + p if take else totals[i])
    out, i = [], len(order)
    while i:
        if chosen[i - 1] >= 0:
            out.append(order[i - 1])
            i = chosen[i - 1]
        else:
            i -= 1
    return out[::-1]


def _overlaps(a: int, b: int, spans: list[Span], reach: list[int]) -> bool:
    """Whether a span of ``spans`` (by start; ``reach``: the greatest end so far) meets a..b."""
    i = bisect_right(spans, (b - 1, 1 << 60, 0))
    return i > 0 and reach[i - 1] > a


def model_spans(texts: list[str], tagger: Tagger, known: list[list[Span]], least: float = LEAST) -> list[list[tuple[int, int, int, float]]]:
    """Spans that the network adds to each text's ``known`` ones."""
    candidates: list[list] = [[] for _ in texts]
    reaches = []
    for spans in known:
        far, reach = 0, []
        for _, b, _ in spans:
            far = max(far, b)
            reach.append(far)
        reaches.append(reach)
    held: dict[str, list[tuple[int, int]]] = {}

    def settle() -> None:
        for (window, places), spans in zip(held.items(), tagger.decode(np.array([encode(w) for w in held]))):
            for a, b, kind, p in spans:
                if p < least or b > len(window) or not passes(kind, window[a:b]):
                    continue
                for doc, start in places:
                    cut = a == 0 and start > 0 or b == WIDTH and start + b < len(texts[doc])
                    if not cut and not _overlaps(start + a, start + b, known[doc], reaches[doc]):
                        candidates[doc].append((start + a, start + b, kind, p))
        held.clear()

    for doc, text in enumerate(texts):
        for start in window_starts(text):
            # Equal windows are decoded once.
            held.setdefault(text[start:start + WIDTH], []).append((doc, start))
            if len(held) >= BATCH:
                settle()
    if held:
        settle()
    return [reconcile(c) if c else [] for c in candidates]


def find(docs: DataFrame, tagger: Tagger | None, least: float = LEAST) -> DataFrame:
    """doc_id and found (start, end, kind, rule, probability; by start, then kind) of every row."""
    sent = docs.sparkSession.sparkContext.broadcast(tagger)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = sent.value
        for batch in batches:
            texts = batch.column(1).to_pylist()
            base = [base_spans(t) for t in texts]
            more = model_spans(texts, model, base, least) if model else [[]] * len(texts)
            found = []
            for own, added in zip(base, more):
                both = [(a, b, k, True, 1.0) for a, b, k in own] + [(a, b, k, False, p) for a, b, k, p in added]
                found.append([{"start": a, "end": b, "kind": KINDS[k], "rule": rule, "probability": p}
                              for a, b, k, rule, p in sorted(both, key=lambda s: (s[0], s[2]))])
            kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("kind", pa.string()), ("rule", pa.bool_()),
                                       ("probability", pa.float64())]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, kind)], ["doc_id", "found"])

    return id_and_text(docs).mapInArrow(run, f"doc_id long, {FOUND}")


def personal_data(docs: DataFrame, label: Callable[[str], list[Span]] = base_spans, least: float = LEAST) -> DataFrame:
    """Train on the labelled spans of a sample of ``docs``, then find the spans of all rows."""
    return find(docs, fit(labelled_windows(docs, label)), least)
