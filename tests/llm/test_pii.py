import hashlib
import itertools
import random
import re
import time
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import types as T

from auditspark.llm import pii, queries
from auditspark.llm.tagger import WIDTH, Tagger, encode

DOCS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()),
                     *[T.StructField(n, T.StringType()) for n in ("found", "window", "tags", "mark", "meta.lang")]])


def frame(spark, rows):
    return spark.createDataFrame([(*r, *"xxxxx") for r in rows], DOCS)


def card(rng):
    digits = [rng.randint(1, 9)] + [rng.randint(0, 9) for _ in range(14)]
    return next("".join(map(str, digits)) + str(c) for c in range(10) if pii.luhn("".join(map(str, digits)) + str(c)))


def sentence(rng, planted=True):
    words = ["alpha", "beta", "the", "é", "日本", "x.", "3.", "(4)", "Row", "key=ab12", "v1.2", "12-34"]
    out = [rng.choice(words) for _ in range(rng.randint(5, 40))]
    if planted:
        made = {0: f"{rng.choice(['ann', 'bo.b', 'c_d'])}.{rng.randint(1, 99)}@mail{rng.randint(1, 9)}.example.com",
                1: ".".join(str(rng.randint(0, 255)) for _ in range(4)), 2: card(rng),
                3: f"+1 ({rng.randint(200, 999)}) 555-{rng.randint(1000, 9999)}"}
        out.insert(rng.randint(0, len(out)), made[rng.randint(0, 3)] + " end")
    return " ".join(out)


def brute_base(text):
    """The contract's patterns as they stand."""
    out = [(m.start(), 0, m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if all(int(p) <= 255 for p in m[0].split(".")):
            out.append((m.start(), 1, m.end()))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        digits = re.sub("[^0-9]", "", m[0])
        odd, even = digits[-1::-2], digits[-2::-2]
        total = sum(map(int, odd)) + sum(sum(map(int, str(2 * int(d)))) for d in even)
        if 12 <= len(digits) <= 19 and total % 10 == 0:
            out.append((m.start(), 2, m.end()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 9 <= len(re.sub("[^0-9]", "", m[0])) <= 15:
            out.append((m.start(), 3, m.end()))
    return [(a, b, k) for a, k, b in sorted(out)]


def odd_texts():
    rng = random.Random(4)
    parts = ["a", "B.c", "@", "a@b.co", "1.2.3.4", "300.1.1.1", "1.2.3", "+1", " ", "-", "4111111111111111", "4111 1111 1111-1111",
             "+44 20 7946 0958", "(0)", ".", "é", "٣", "0", "99", "\n", "x_y%z@q-r.s.t", "+", "007.1.2.3"]
    return ["".join(rng.choice(parts) for _ in range(rng.randint(0, 25))) for _ in range(3000)]


def test_base_spans_against_the_patterns():
    for text in odd_texts():
        assert pii.base_spans(text) == brute_base(text), text


def test_query_keeps_base_spans(spark, monkeypatch):
    rng = random.Random(8)
    rows = [(i, sentence(rng, i % 2 == 0)) for i in range(300)] + [(1000 + i, t) for i, t in enumerate(odd_texts()[:200])]
    rows += [(2000 + i, rows[0][1]) for i in range(150)] + [(None, None), (1, ""), (2, rows[4][1])]
    monkeypatch.setattr(queries, "table", lambda *a: frame(spark, rows))
    out = queries.op13_pii(spark, "").collect()
    assert len(out) == len(rows)
    want = Counter()
    for i, text in rows:
        base = brute_base(text or "")
        joined = ",".join(f"{pii.KINDS[k]}:{a}:{b}" for a, b, k in base)
        want[i, *[sum(s[2] == k for s in base) for k in range(4)], hashlib.sha256(joined.encode()).hexdigest()] += 1
    assert Counter((r.doc_id, r.n_email, r.n_ip, r.n_card, r.n_phone, r.base_sha256) for r in out) == want
    texts = Counter()
    for r in out:
        spans = [s.split(":") for s in r.spans.split(",") if s]
        order = [(int(a), pii.KINDS.index(k)) for k, a, _ in spans]
        assert order == sorted(order)
        texts[len(spans) >= r.n_email + r.n_ip + r.n_card + r.n_phone] += 1
    assert texts[False] == 0


def test_gradients_are_those_of_the_likelihood():
    rng = np.random.default_rng(2)
    tagger = Tagger.new(2, hidden=3, seed=1)
    for name in ("wx", "wh", "wo", "bo", "trans"):
        setattr(tagger, name, getattr(tagger, name).astype(np.float64) + rng.normal(0, 0.1, getattr(tagger, name).shape))
    ids = rng.integers(0, 131, (3, 9))
    tags = np.array([[0, 1, 2, 2, 0, 3, 4, 0, 0], [3, 4, 4, 1, 2, 1, 0, 0, 3], [0] * 9])
    _, grads = tagger.gradients(ids, tags)
    for p, g in zip(tagger.parameters, grads):
        flat, own = p.reshape(-1), g.reshape(-1)
        for i in rng.choice(len(flat), min(len(flat), 60), replace=False):
            kept, step = flat[i], 1e-4
            flat[i] = kept + step
            up = tagger.gradients(ids, tags)[0]
            flat[i] = kept - step
            down = tagger.gradients(ids, tags)[0]
            flat[i] = kept
            if p is tagger.trans and own[i] == 0.0:
                continue  # a forbidden pair
            assert abs((up - down) / (2 * step) - own[i]) < 2e-3


def test_decode_is_the_best_sequence_with_its_probability():
    tagger = Tagger.new(1, hidden=4, seed=3)
    rng = np.random.default_rng(5)
    tagger.wo += rng.normal(0, 2, tagger.wo.shape).astype(np.float32)
    ids = rng.integers(0, 131, (6, 7))
    scores, trans = tagger._scores(tagger._run(ids)[0]), tagger.allowed()
    for row, found in enumerate(tagger.decode(ids)):
        paths = {}
        for tags in itertools.product(range(3), repeat=7):
            paths[tags] = sum(float(scores[t, row, g]) for t, g in enumerate(tags)) + sum(
                float(trans[a, b]) for a, b in itertools.pairwise(tags))
        best, whole = max(paths, key=paths.get), sum(np.exp(v) for v in paths.values())
        starts = [t for t in range(7) if best[t] and not (best[t] == 2 and t and best[t - 1])]
        assert [s[0] for s in found] == starts
        for start, end, _, p in found:
            same = sum(np.exp(v) for tags, v in paths.items()
                       if tags[start:end] == best[start:end] and (end == 7 or tags[end] != 2))
            assert abs(same / whole - p) < 1e-3


def test_held_out_spans_are_found_without_the_rules():
    rng = random.Random(21)
    texts = [sentence(rng, i % 3 > 0) for i in range(1500)]
    windows = {}
    for text in texts[:1000]:
        for start in pii.window_starts(text):
            windows[text[start:start + WIDTH]] = pii.tags_of(start, pii.base_spans(text))
    tagger = pii.fit(list(windows.items()), epochs=8)
    found = pii.model_spans(texts[1000:], tagger, [[] for _ in texts[1000:]], least=0.5)
    base = {(i, *s) for i, t in enumerate(texts[1000:]) for s in pii.base_spans(t)}
    own = {(i, a, b, k) for i, spans in enumerate(found) for a, b, k, _ in spans}
    assert len(own & base) >= 0.85 * len(base) and len(own & base) >= 0.9 * len(own)


def test_windows_cover_every_trigger():
    rng = random.Random(6)
    for _ in range(300):
        text = "".join(rng.choice("a" * 60 + "1@") for _ in range(rng.randint(0, 700)))
        want = [s for s in range(0, max(len(text), 1), pii.STRIDE) if re.search("[0-9@]", text[s:s + WIDTH])]
        assert list(pii.window_starts(text)) == want


def test_reconcile_is_the_best_choice():
    rng = random.Random(9)
    for _ in range(200):
        spans = [(a := rng.randint(0, 20), a + rng.randint(1, 8), rng.randint(0, 3), rng.random()) for _ in range(rng.randint(0, 8))]
        got = pii.reconcile(spans)
        assert all(x[1] <= y[0] for x, y in itertools.pairwise(got))
        best = max(sum(s[3] for s in some) for n in range(len(spans) + 1) for some in itertools.combinations(spans, n)
                   if all(x[1] <= y[0] or y[1] <= x[0] for x, y in itertools.combinations(some, 2)))
        assert abs(sum(s[3] for s in got) - best) < 1e-12


@pytest.mark.parametrize("part", ["1", "a", "a.", "1.", "a@", "+1", "+1 ", "1 ", "@", "1.1.1.", "-", "a@b."])
def test_long_texts_take_linear_time(part):
    text = part * (1_000_000 // len(part))
    began = time.time()
    pii.base_spans(text)
    list(pii.window_starts(text))
    assert time.time() - began < 8


def test_empty_and_unlabelled(spark):
    assert pii.personal_data(frame(spark, [])).collect() == []
    out = pii.personal_data(frame(spark, [(1, "no data 1"), (None, None)])).collect()
    assert sorted((r.doc_id or 0, len(r.found)) for r in out) == [(0, 0), (1, 0)]
