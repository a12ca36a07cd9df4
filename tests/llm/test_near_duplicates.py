import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F
from pyspark.sql import types as T

from auditspark.llm import components, fingerprint, simhash

DOCS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()),
                     *[T.StructField(n, T.StringType()) for n in ("fp", "a", "b", "rng", "place", "node", "root")]])


def frame(spark, rows):
    return spark.createDataFrame([(i, t, *["x"] * 7) for i, t in rows], DOCS)


def texts(seed=2, n=150):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(400)]
    rows = []
    for i in range(n):
        own = [rng.choice(words) for _ in range(rng.randint(1, 200))]
        rows.append((i, " ".join(own)))
        if i % 5 == 0:
            rows.append((1000 + i, " ".join(own)))  # a copy
        if i % 7 == 0:
            own[rng.randrange(len(own))] = "changed"
            rows.append((2000 + i, "\t".join(own).upper()))  # nearly a copy, other blanks and case
    return rows + [(3000, None), (3001, ""), (3002, " \n "), (3003, "one two three"), (None, "one two three"),
                   (7, rows[9][1]), (7, rows[9][1]), (3004, "Ünïcode space Kelvin K word word"),
                   (3005, "same " * 40_000)]


def brute_fingerprint(text):
    lowered = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", lowered)
    if not words:
        return 0
    shingles = [" ".join(words[i:i + 4]) for i in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(rows, most=4):
    prints = [brute_fingerprint(t) for _, t in rows]
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= most:
                parent[root(i)] = root(j)
    least = defaultdict(list)
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[root(i)].append(d)
    return [(d, prints[i], min(least[root(i)]) if least[root(i)] else None) for i, (d, _) in enumerate(rows)]


def canon(rows):
    return sorted(((-1 if d is None else d), f % (1 << 64), -1 if c is None else c) for d, f, c in rows)


def test_simhash_against_brute_force(spark):
    rows = texts()
    got = simhash.near_duplicates(frame(spark, rows)).collect()
    assert canon((r.doc_id, r.fp, r.component_id) for r in got) == canon(brute_components(rows))


def test_long_texts_are_added_up_in_parts(monkeypatch):
    text = " ".join(f"W{i * i % 997}" for i in range(1000))
    whole = simhash.fingerprint(text)
    monkeypatch.setattr(simhash, "HASHES_AT_ONCE", 7)
    assert simhash.fingerprint(text) == whole == simhash.fingerprint(text.lower())


def test_empty_tables(spark):
    none = frame(spark, [])
    assert simhash.near_duplicates(none).collect() == []
    assert fingerprint.followed_fingerprints(none).collect() == []
    assert fingerprint.fingerprints(none).collect() == []
    assert components.components(spark.createDataFrame([], "a long, b long")).collect() == []


def clusters(n=1500, seed=4):
    """Fingerprints in tight families and others far apart."""
    rng = random.Random(seed)
    out = set()
    while len(out) < n:
        centre = rng.getrandbits(64)
        for _ in range(rng.choice([1, 1, 2, 60])):
            x = centre
            for b in rng.sample(range(64), rng.randint(0, 5)):
                x ^= 1 << b
            out.add(x)
    return [x - (1 << 64) if x >> 63 else x for x in out]


def brute_roots(fps, most=4):
    a = np.array(fps, np.int64)
    label = {x: x for x in fps}
    changed = True
    while changed:
        changed = False
        for x in fps:
            near = a[np.bitwise_count((a ^ np.int64(x)).view(np.uint64)) <= most]
            low = min(label[int(y)] for y in near)
            for y in near:
                if label[int(y)] != low:
                    label[int(y)] = low
                    changed = True
    return label


@pytest.mark.parametrize("hot", [20_000, 30])
def test_links_connect_what_pairs_connect(spark, hot):
    """Also when most runs are hot and indexed again."""
    fps = clusters()
    found = simhash.links(spark.createDataFrame([(x,) for x in fps], "fp long"), hot=hot)
    pairs = [(r.a, r.b) for r in found.collect()]
    assert all(((a ^ b) & ((1 << 64) - 1)).bit_count() <= 4 for a, b in pairs)
    roots = {r["node"]: r["root"] for r in components.components(found).collect()}
    want = brute_roots(fps)
    assert {x: roots.get(x, x) for x in fps} == want


def test_runs_that_stay_hot_are_split_to_the_end(spark, monkeypatch):
    """Fingerprints that agree in most bits, so that runs stay hot over several splits."""
    rng = random.Random(31)
    monkeypatch.setattr(simhash, "LAST_BITS", 13)
    base = rng.getrandbits(64)
    fps = {base ^ rng.getrandbits(20) for _ in range(1500)} | {base ^ (1 << rng.randrange(64)) for _ in range(20)}
    fps = [x - (1 << 64) if x >> 63 else x for x in fps]
    levels = []
    split = simhash.split_runs
    monkeypatch.setattr(simhash, "split_runs", lambda rows, most: levels.append(rows.count()) or split(rows, most))
    found = simhash.links(spark.createDataFrame([(x,) for x in fps], "fp long").repartition(5), hot=25)
    pairs = [(r.a, r.b) for r in found.collect()]
    assert len(levels) >= 2 and all(((a ^ b) & ((1 << 64) - 1)).bit_count() <= 4 for a, b in pairs)
    roots = {r["node"]: r["root"] for r in components.components(found).collect()}
    assert {x: roots.get(x, x) for x in fps} == brute_roots(fps)


def test_long_texts_are_taken_in_parts(monkeypatch):
    rng = random.Random(2)
    texts = [" ".join(rng.choice(["a", "Bb", "é", "longword"]) for _ in range(n)) + end for n in (0, 1, 3, 4, 5, 400) for end in ("", " ", "\n\t ")]
    texts += [" " * 500 + "one" + "\n" * 500 + "two three", "x" * 999 + " y z w v"]
    whole = [simhash.fingerprint(t) for t in texts]
    monkeypatch.setattr(simhash, "PART", 7)
    assert [simhash.fingerprint(t) for t in texts] == whole


def test_segments_leave_one_bit_at_most():
    parts = simhash.segments(list(range(64)), 4)
    assert len(parts) == 3 and sorted(b for p in parts for b in p) == list(range(64))
    assert len(simhash.variant_masks(list(range(64)), 4)) == 64


def test_components_of_paths_stars_and_cycles(spark):
    links = [(i, i + 1) for i in range(50)] + [(100, 200 + i) for i in range(300)] + [(600, 601), (601, 602), (602, 600),
                                                                                   (700, 700)]
    got = {r["node"]: r["root"] for r in components.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert all(got[i] == 0 for i in range(51))
    assert all(got[200 + i] == 100 for i in range(300)) and got[602] == 600 and 700 not in got


def shingle_set(text):
    w = text.split()
    return {tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def jaccard(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def test_followed_fingerprints_against_brute_force(spark):
    rows = [r for r in texts() if r[0] != 7] + [(7, "seven " * 300)]
    got = {r.doc_id: r for r in fingerprint.followed_fingerprints(frame(spark, rows)).collect()}
    order = sorted(((-1 if d is None else d), t or "") for d, t in rows)
    assert len(got) == len(rows)
    for (d, text), (_, following) in zip(order, order[1:] + order[:1]):
        r = got[None if d == -1 else d]
        edited = fingerprint.edit(text, following)
        half = len(text) // 2
        assert edited == text[:len(text) - half] + following[:half]
        assert r.n_chars == len(text) and r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert r.fingerprint == fingerprint.encode(fingerprint.sketch(text))
        a, b, c = shingle_set(text), shingle_set(edited), shingle_set(following)
        tolerance = 1e-9 if len(a | b) <= fingerprint.K else 0.15
        assert r.near_edited == pytest.approx(jaccard(a, b), abs=tolerance)
        assert r.near_next == pytest.approx(jaccard(a, c), abs=1e-9 if len(a | c) <= fingerprint.K else 0.15)
    same = defaultdict(set)
    for d, t in rows:
        same[t or ""].add(got[d].fingerprint)
    assert all(len(v) == 1 for v in same.values())


def test_repeated_ids_keep_every_row(spark):
    rows = [(1, "a b c"), (1, "a b c"), (1, "d e"), (2, "f")] * 3
    assert fingerprint.followed_fingerprints(frame(spark, rows)).count() == 12


def digest64(spark, values):
    rows = spark.createDataFrame([(t,) for t in values], "t string").select("t", F.shiftrightunsigned(F.xxhash64("t"), 12).alias("h")).collect()
    return {r.t: r.h for r in rows}


def hot_tables():
    null_ids = [(None, f"text {i} of no id " * 3) for i in range(200)] + [(i, f"own {i} text") for i in range(400)]
    one_id = [(7, f"text {i} again " * 3) for i in range(200)] + [(i, f"own {i} text") for i in range(20, 400)]
    repeats = [(9, "the very same row")] * 200 + [(9, "another row")] + [(i, f"own {i} text") for i in range(400)]
    few = [(3, "same")] * 5 + [(4, "other"), (2, "least")]
    far = [((1 << 62) + 3 * i, f"far {i}") for i in range(300)] + [(-(1 << 62) - i, f"low {i}") for i in range(300)]
    return [null_ids, one_id, repeats, few, null_ids + repeats, [(1, "x")] * 30, far + null_ids[:200]]


@pytest.mark.parametrize("which", range(7))
def test_hot_ids_are_divided_and_keep_the_order(spark, which):
    """Null, repeated and exactly repeated rows that are a third of the table; any partitioning gives the same."""
    rows = hot_tables()[which]
    of = digest64(spark, {t for _, t in rows})
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, of[r[1]]))
    want = Counter()
    for (d, text), (_, following) in zip(order, order[1:] + order[:1]):
        want[d, len(text), hashlib.sha256(fingerprint.edit(text, following).encode()).hexdigest()] += 1
    for parts in (1, 3, 7):
        docs = frame(spark, rows).repartition(parts)
        got = fingerprint.followed_fingerprints(docs).collect()
        assert Counter((r.doc_id, r.n_chars, r.edited_sha256) for r in got) == want
        if len(rows) > 500 and which < 6:  # ids that doubles cannot tell apart are in order, but not divided
            most = max(r["count"] for r in fingerprint.follow(docs).where("last = 0").groupBy("rng").count().collect())
            assert most <= len(rows) / 8


def test_one_document_is_followed_by_itself(spark):
    r = fingerprint.followed_fingerprints(frame(spark, [(5, "ab cd ef")])).first()
    assert r.near_next == 1.0 and r.n_chars == 8


def test_sketches_merge_and_estimate(spark):
    rng = random.Random(1)
    words = [f"v{i}" for i in range(3000)]
    a = [rng.choice(words) for _ in range(3000)]
    b = a[:1500] + [rng.choice(words) for _ in range(1500)]
    sa, sb = fingerprint.sketch(" ".join(a)), fingerprint.sketch(" ".join(b))
    ta, tb = shingle_set(" ".join(a)), shingle_set(" ".join(b))
    assert len(sa) == fingerprint.K
    assert fingerprint.resemblance(sa, sb) == pytest.approx(jaccard(ta, tb), abs=0.13)
    assert fingerprint.containment(sa, sb) == pytest.approx(len(ta & tb) / len(ta), abs=0.2)
    assert fingerprint.distinct(sa) == pytest.approx(len(ta), rel=0.3)
    assert (fingerprint.decode(fingerprint.encode(sa)) == sa).all()
    parts = [(k, " ".join(a[i:i + 300])) for i, k in zip(range(0, 3000, 300), [1, 1, 2, 1, 2, 2, 1, 1, 2, 1])]
    prints = fingerprint.fingerprints(frame(spark, parts)).withColumnRenamed("doc_id", "part")
    got = {r["part"]: r["fingerprint"] for r in fingerprint.merge_by(prints, "part").collect()}
    for k in (1, 2):
        whole = np.unique(np.concatenate([fingerprint.sketch(t) for d, t in parts if d == k]))[:fingerprint.K]
        assert (fingerprint.decode(got[k]) == whole).all()


def test_sketch_sees_past_repeats():
    text = "same words again and again " * 400 + " ".join(f"n{i}" for i in range(600))
    w = text.split()
    assert len(fingerprint.sketch(text)) == min(fingerprint.K, len({tuple(w[i:i + 5]) for i in range(len(w) - 4)}))
