import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import types as T
from tokenizers import Tokenizer

from auditspark.llm import mixing, packing, sharding

DOCS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()),
                     T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()),
                     T.StructField("n_chars", T.LongType()),
                     # names that the operators use inside
                     *[T.StructField(n, T.LongType()) for n in
                       ("size", "shard", "slot", "key", "rng", "length", "item_id", "offset", "u", "q", "p")]])


def frame(spark, rows):
    """rows of (doc_id, text, source)."""
    return spark.createDataFrame([(i, t, "en", s, len(t) if t else None, *([7] * 11)) for i, t, s in rows], DOCS)


def odd_rows(seed=1, n=300):
    rng = np.random.default_rng(seed)
    words = ["alpha", "beta", "gamma", "delta", "Épée", "naïve", "x", "zz y", "12345", "a\x1cb"]
    rows = [(i, " ".join(rng.choice(words, rng.integers(1, 900))), ["b", "a", None, "hot"][min(3, i % 9)])
            for i in range(n)]
    rows += [(n, None, "a"), (n + 1, "", "empty"), (n + 2, " \t\n", None), (None, "some words", "b"),
             (n + 3, "long " * 30_000, "a"), (5, rows[5][1], rows[5][2]), (5, rows[5][1], rows[5][2])]
    return rows + [(n + 10 + i, "one and the same copied text", "hot") for i in range(n // 2)]


@pytest.fixture(scope="module")
def rows():
    return odd_rows()


def test_cut_lets_only_the_first_piece_be_shorter():
    assert packing.cut(5, 2048) == [5]
    assert packing.cut(2048, 2048) == [2048]
    assert packing.cut(5000, 2048) == [904, 2048, 2048]


def test_best_fit_against_a_plain_version():
    rng = np.random.default_rng(0)
    lengths = rng.integers(1, 100, 400)
    bins, offsets, fill = packing.best_fit(np.arange(400), lengths, 100)
    plain = []
    for n in sorted(lengths, reverse=True):
        fits = [b for b in plain if b + n <= 100]
        if fits:
            plain.remove(max(fits))
            plain.append(max(fits) + n)
        else:
            plain.append(n)
    assert sorted(fill.values()) == sorted(plain)
    for b in fill:
        own = sorted((offsets[i], lengths[i]) for i in np.flatnonzero(bins == b))
        assert [o for o, _ in own] == [0, *np.cumsum([n for _, n in own])[:-1]]


def check_packed(got, want):
    """want: Counter of (doc_id, piece, start, length, crc)."""
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == want
    by = defaultdict(list)
    for r in got:
        by[r.sequence_id].append((r.offset, r.length))
    for parts in by.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 2048
    total = sum(r.length for r in got)
    return len(by), -(-total // 2048)


def test_pack_documents_against_brute_force(spark, rows):
    got = packing.pack_documents(frame(spark, rows)).collect()
    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = Counter()
    for doc_id, text, _ in rows:
        ids = np.array([*tok.encode(text or "", add_special_tokens=False).ids, 0], "<u4")
        start = 0
        for piece, n in enumerate(packing.cut(len(ids), 2048)):
            want[doc_id, piece, start, n, zlib.crc32(ids[start:start + n].tobytes())] += 1
            start += n
    used, least = check_packed(got, want)
    assert used <= least * 1.05 + 2


def test_special_tokens_in_texts_get_their_ids(spark):
    end = "<|endoftext|>"
    texts = [end, f"one text{end}another  {end}\n\n{end}{end} it's", f"{end[:-1]} {end}", f"x {end} " * 3_000]
    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    assert {t.content: i for i, t in tok.get_added_tokens_decoder().items()} == packing.SPECIAL[packing.TOKENIZER]
    for name in (packing.TOKENIZER, "byte_bpe_50k.json"):
        encode = packing.load_encoder(name)
        assert all(encode(t).tolist() == tok.encode(t, add_special_tokens=False).ids for t in texts)
    want = Counter()
    for i, text in enumerate(texts):
        ids = np.array([*tok.encode(text, add_special_tokens=False).ids, 0], "<u4")
        assert (ids == 50256).sum() == text.count(end)
        start = 0
        for piece, n in enumerate(packing.cut(len(ids), 2048)):
            want[i, piece, start, n, zlib.crc32(ids[start:start + n].tobytes())] += 1
            start += n
    check_packed(packing.pack_documents(frame(spark, [(i, t, "a") for i, t in enumerate(texts)])).collect(), want)


def test_long_runs_of_blanks_have_the_json_files_ids(spark):
    """A million blanks, newlines or tabs, and a long run of one letter, in the operator and in the pipeline's stage."""
    import corpus_pipeline

    n = 1_000_000
    texts = ["a" + " " * n + "b", "\n" * n, "x" + "\t" * n, "a" + " \n" * (n // 2) + "b", "z" * 200_000, "<|endoftext|>" + " " * n]
    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = Counter()
    for i, text in enumerate(texts):
        ids = np.array([*tok.encode(text, add_special_tokens=False).ids, 0], "<u4")
        start = 0
        for piece, size in enumerate(packing.cut(len(ids), 2048)):
            want[i, piece, start, size, zlib.crc32(ids[start:start + size].tobytes())] += 1
            start += size
    docs = frame(spark, [(i, t, "a") for i, t in enumerate(texts)])
    check_packed(packing.pack_documents(docs).collect(), want)
    check_packed(corpus_pipeline.packing_stage(spark, docs, "").collect(), want)


def test_rounds_merge_groups_and_keep_every_item(spark):
    rng = np.random.default_rng(3)
    lengths = [int(x) for x in rng.integers(1, 2049, 3000)]
    items = spark.createDataFrame([(i, n) for i, n in enumerate(lengths)], "doc long, length long")
    got = packing.pack(items, chunk=200, carry=50).collect()
    assert Counter((r["doc"], r["length"]) for r in got) == Counter(enumerate(lengths))
    by = defaultdict(list)
    for r in got:
        by[r["sequence_id"]].append((r["offset"], r["length"]))
    for parts in by.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 2048
    assert len(by) <= 1.06 * sum(lengths) / 2048
    apart = {}
    for group in range(15):  # without merging, groups of 200
        _, _, fill = packing.best_fit(np.arange(200), np.array(lengths[group * 200:group * 200 + 200]), 2048)
        apart[group] = len(fill)
    assert len(by) <= sum(apart.values())


def test_empty_tables(spark):
    none = frame(spark, [])
    assert packing.pack_documents(none).collect() == []
    assert mixing.mix(none).collect() == []
    assert sharding.shard(none).collect() == []


def brute_mix(rows):
    sizes = [(i, s, len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))) for i, t, s in rows]
    of = Counter()
    for _, s, n in sizes:
        of[s] += n
    names = sorted(of, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(names)}
    target, open_, left = {}, set(names), float(sum(of.values()))
    while True:
        level = left / sum(weight[s] for s in open_) if open_ else 0
        over = [s for s in open_ if weight[s] * level > 3 * of[s]]
        if not over:
            break
        for s in over:
            target[s] = 3 * of[s]
            left -= 3 * of[s]
            open_.discard(s)
    return sizes, of, target | {s: weight[s] * level for s in open_}


def test_mix_meets_targets(spark, rows):
    got = mixing.mix(frame(spark, rows)).collect()
    sizes, of, target = brute_mix(rows)
    assert Counter((r.doc_id, r.source, r["size"]) for r in got) == Counter(sizes)
    taken, largest = Counter(), Counter()
    for r in got:
        assert r.source_size == of[r.source] and r.target == pytest.approx(target[r.source])
        assert 0 <= r.taken <= 3 * r["size"] and (r["size"] == 0 or r.taken % r["size"] == 0)
        taken[r.source] += r.taken
        largest[r.source] = max(largest[r.source], r["size"])
    for s, want in target.items():
        assert abs(taken[s] - want) <= max(largest[s], 1) / 2 + 1e-6 or s == "a"  # "a" has one document of 30,000 words
    again = mixing.mix(frame(spark, list(reversed(rows)))).collect()
    assert Counter(map(tuple, got)) == Counter(map(tuple, again))


def test_pareto_prefix_against_a_whole_ranking(spark, rows):
    import hashlib
    import math

    rows = rows + [(None, f"null id {i} " * (i % 9 + 1), "b") for i in range(60)] + [(3, "again and again", "hot")] * 20
    got = mixing.mix(frame(spark, rows)).collect()
    sizes, of, target = brute_mix(rows)
    many, seen, by = Counter(s for _, s, _ in sizes), Counter(), defaultdict(list)
    for (d, s, n), (_, text, _) in zip(sizes, rows):
        digest = hashlib.md5((text or "").encode()).hexdigest()
        seen[s, d, digest] += 1
        name = f"{mixing.SEED}:{'' if d is None else d}:{digest}:{seen[s, d, digest]}"
        u = (int(hashlib.md5(name.encode()).hexdigest()[:12], 16) + 0.5) / 2 ** 48
        lean = math.sqrt(max(n, 1) / (max(of[s], 1) / many[s]))
        by[s].append(((u / (1 - u)) / lean, d is not None, d or 0, digest, seen[s, d, digest], n))
    want = Counter()
    for s, ranking in by.items():
        ratio = target[s] / of[s] if of[s] else 0.0
        whole, p = int(ratio), ratio - int(ratio)
        rest, upto = target[s] - whole * of[s], 0
        for _, known, d, digest, _, n in sorted(ranking):
            extra = p > 1e-9 and upto + upto + n <= 2 * rest
            upto += n
            want[d if known else None, s, digest, n, (whole + extra) * n] += 1
    assert Counter((r.doc_id, r.source, r.digest, r["size"], r.taken) for r in got) == want


def test_targets_are_met_with_null_and_repeated_ids(spark):
    """A third of the ids null, a third one repeated id, a third of the rows one exact repeat."""
    rng = np.random.default_rng(4)
    rows = [(None if i % 3 == 0 else 7 if i % 3 == 1 else i, f"t{i} " + "w " * int(rng.integers(1, 60)), "abcdef"[i % 6]) for i in range(900)]
    rows += [(5, "the same row", "f")] * 450
    got = mixing.mix(frame(spark, rows).repartition(5)).collect()
    _, _, target = brute_mix(rows)
    taken = Counter()
    for r in got:
        taken[r.source] += r.taken
    assert all(abs(taken[s] - want) <= 31 for s, want in target.items())  # half of the longest document
    again = mixing.mix(frame(spark, rows[::-1]).repartition(3)).collect()
    assert Counter(map(tuple, got)) == Counter(map(tuple, again))


def test_repeats_are_numbered_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(mixing, "REPEATS", 7)
    rows = [(1, "same", "a")] * 50 + [(2, "one", "a")]
    got = mixing.numbered(mixing.word_sizes(frame(spark, rows))).collect()
    assert sorted(r.rep for r in got if r.doc_id == 1) == list(range(1, 51)) and len(got) == 51


def test_longer_documents_are_likelier(spark):
    """Inclusion over seeds follows the documents' odds: sqrt(16) to 1 between long and short ones."""
    rows = [(i, "w " * (16 if i % 2 else 1), "b") for i in range(40)] + [(100 + i, "w " * 50, "a") for i in range(40)]
    hit = Counter()
    for seed in range(12):
        for r in mixing.mix(frame(spark, rows), weights=(30, 1), seed=seed).collect():
            if r.source == "b":
                hit[r["size"]] += r.copies
    # Twenty documents of each length, twelve seeds; the source gives about a fifth of its words.
    p = {n: hit[n] / 240 for n in (1, 16)}
    assert p[16] > 1.5 * p[1] and 0 < p[1]


def test_shards_are_even_gapless_and_keep_texts(spark, rows):
    got = sharding.shard(frame(spark, rows), shards=6, ranges_per_shard=32).collect()
    want = Counter((i, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for i, t, _ in rows)
    assert Counter((r.doc_id, r["size"], r.text_crc32) for r in got) == want
    size, slots = Counter(), defaultdict(list)
    for r in got:
        size[r.shard] += r["size"]
        slots[r.shard].append(r.slot)
    for s in range(6):
        assert sorted(slots[s]) == list(range(len(slots[s])))
    even = sum(size.values()) / 6
    longest = max(n for _, n, _ in want)
    assert all(abs(size[s] - even) <= 0.05 * even + longest for s in range(6))


def test_a_text_that_is_most_of_the_table_is_divided(spark):
    rows = [(i, "the very same text", "s") for i in range(3000)] + [(10_000 + i, f"text {i}", "s") for i in range(500)]
    got = sharding.shard(frame(spark, rows), shards=8).collect()
    size = Counter()
    for r in got:
        size[r.shard] += r["size"]
    even = sum(size.values()) / 8
    assert len(size) == 8 and all(abs(n - even) <= 0.04 * even for n in size.values())


def test_repeated_rows_that_are_half_of_the_table_are_divided(spark):
    rows = [(i, f"text number {i} " * 3, "a") for i in range(2000)]
    rows += [(7, "the same row again and again ", "a")] * 2000 + [(None, "", "a")] * 4000
    got = sharding.shard(frame(spark, rows).repartition(4), shards=8).collect()
    by = defaultdict(list)
    for r in got:
        by[r.shard].append(r)
    assert len(got) == len(rows) and all(sorted(r.slot for r in own) == list(range(len(own))) for own in by.values())
    even = sum(r["size"] for r in got) / 8
    assert len(by) == 8 and all(abs(sum(r["size"] for r in own) / even - 1) < 0.1 for own in by.values())


def test_shards_do_not_depend_on_partitions(spark):
    rows = odd_rows(n=200) + [(None, "one row", "a")] * 300 + [(i, "a text that half of the rows share", "b") for i in range(500, 900)]
    out = [Counter((r.doc_id, r["size"], r.text_crc32, r.shard) for r in sharding.shard(frame(spark, rows).repartition(n), ranges_per_shard=8).collect())
           for n in (3, 7)]
    assert out[0] == out[1] and out[0].total() == len(rows)


def test_repeats_are_written_out_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(sharding, "REPEATS", 7)
    got = sharding.records(frame(spark, [(1, "same", "a")] * 50 + [(2, "x", "a")])).collect()
    assert Counter(r.doc_id for r in got) == {1: 50, 2: 1} and len({r.key for r in got}) > 45


def test_light_texts_stay_whole(spark):
    rows = [(i, f"text number {i // 3} of a thousand", "s") for i in range(3000)]
    got = sharding.shard(frame(spark, rows), shards=4, ranges_per_shard=32).collect()
    homes = defaultdict(set)
    for r in got:
        homes[r.text_crc32].add(r.shard)
    assert sum(len(h) > 1 for h in homes.values()) <= 3
