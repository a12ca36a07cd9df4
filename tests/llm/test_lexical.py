import math
import random
import re
from collections import Counter

import pytest
from pyspark.sql import types as T

from auditspark.llm import lexical, queries

TERM = re.compile("[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = {c: c + 32 for c in range(65, 91)}


def frame(spark, key, rows):
    kind = T.StructType([T.StructField(key, T.LongType()), T.StructField("text", T.StringType()),
                         *[T.StructField(n, T.StringType()) for n in ("terms", "n", "score", "task", "rank", "meta.lang")]])
    return spark.createDataFrame([(*r, *["x"] * 6) for r in rows], kind)


def counts(text):
    return Counter(TERM.findall((text or "").translate(LOWER)))


def brute(docs, items, k=10):
    rows = [(i, counts(t)) for i, t in docs]
    rows = [(i, c) for i, c in rows if c]
    N, L = len(rows), sum(c.total() for _, c in rows)
    df = Counter(t for _, c in rows for t in c)
    out = []
    for item, text in items:
        scored = []
        for doc, c in rows:
            m = 100 - 90 + (90 * c.total() * N) // L
            s = sum(math.floor(1000 * math.log((2 * N + 2) / (2 * df[t] + 1))) * ((10 ** 9 * c[t]) // (1000 * c[t] + 8 * m))
                    for t in counts(text) if t in c)
            if s > 0:
                scored.append((-s, doc is None, doc or 0))
        out += [(item, r, None if null else d, -s) for r, (s, null, d) in enumerate(sorted(scored)[:k], 1)]
    return Counter(out)


def tables():
    rng = random.Random(12)
    words = [f"{w}{i}" for i in range(25) for w in ("ab", "É", "zz", "日本")] + ["The", "the", "THE", "ſ", "K", "a_b", "it's", "x\x7fy"]
    docs = [(i, " ".join(rng.choices(words, k=rng.randint(0, 60)))) for i in range(300)]
    docs += [(1000 + i, docs[7][1]) for i in range(40)] + [(None, docs[7][1]), (None, "THE the"), (5, docs[5][1]), (6, None), (7, " ., ")]
    common = " ".join(rng.choices(words, k=12))
    items = [(i, common + " " + " ".join(rng.choices(words, k=rng.randint(1, 15)))) for i in range(30)]
    items += [(50, items[3][1]), (50, "THE"), (None, "ab1 É2"), (51, None), (52, "..."), (53, "unknownterm")]
    return docs, items


@pytest.mark.parametrize("block", [100_000, 90])
def test_against_brute_force(spark, block):
    docs, items = tables()
    got = lexical.search(frame(spark, "doc_id", docs).repartition(5), frame(spark, "item_id", items), block_terms=block)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    assert Counter(tuple(r) for r in got.collect()) == brute(docs, items)


def test_registered_query(spark, monkeypatch):
    docs, items = tables()
    monkeypatch.setattr(queries, "table", lambda s, d, n: frame(spark, *{"documents": ("doc_id", docs), "benchmark": ("item_id", items)}[n]))
    assert Counter(tuple(r) for r in queries.op12_lexical_search(spark, "").collect()) == brute(docs, items)


def test_empty_tables(spark):
    docs, items = frame(spark, "doc_id", [(1, "a b")]), frame(spark, "item_id", [(1, "a b")])
    assert lexical.search(docs.limit(0), items).collect() == []
    assert lexical.search(docs, items.limit(0)).collect() == []


def test_plan_shares_and_loses_nothing():
    """Every item's accumulator adds up exactly its terms, in fewer additions than term by term."""
    rng = random.Random(3)
    common = [rng.sample(range(200), 12) for _ in range(4)]
    items = [sorted(set(rng.choice(common) + rng.choice(common) + rng.sample(range(200), 5))) for _ in range(60)] + [[]]
    plan = lexical.share(items, 200)
    held = [Counter(t for t in range(200) if plan.set_of[t] == s) for s in range(plan.sets)]
    for a, b in plan.nodes:
        held.append(held[a] + held[b])
    for own, parts in zip(items, plan.items):
        assert sum((held[p] for p in parts), Counter()) == Counter(own)
    assert plan.additions < sum(len(i) - 1 for i in items if i) * 0.7


def test_long_text_is_counted_in_parts(monkeypatch):
    text = ("Wort é日 x1 " * 5000 + "y" * 3000).encode()
    whole = Counter(lexical._TERM.findall(text.lower()))
    monkeypatch.setattr(lexical, "PART", 1000)
    assert lexical.count_terms(text) == whole and whole[b"y" * 3000] == 1
