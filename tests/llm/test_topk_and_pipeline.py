import hashlib
import random
from collections import Counter, defaultdict

import corpus_pipeline
import numpy as np
import pytest
from pyspark.sql import functions as F

from auditspark.llm import mixing, packing, queries, secret_scan, topk
from tests.llm.test_near_duplicates import brute_components
from tests.llm.test_scans_and_classifiers import brute_base

SF = "/root/testdata/sf0.001"
VECTORS = "vec_id long, embedding array<float>, label int, row long, v string, rank int, score long"


def vectors(seed=3, n=900, d=16):
    rng = np.random.default_rng(seed)
    centres = rng.normal(0, 0.2, (9, d))
    rows = [(i, [float(np.float32(x)) for x in centres[i % 9] + rng.normal(0, 0.05, d)]) for i in range(n)]
    rows += [(n + i, rows[0][1]) for i in range(40)]  # copies
    rows += [(50, rows[3][1]), (100, rows[100][1]), (100, rows[100][1])]  # repeated ids
    return rows + [(2000, None), (2050, [1.0, None]), (2100, [float("nan")] * d), (2150, [float("inf")] * d),
                   (None, rows[1][1]), (2200, [0.5] * 4), (2250, [])]


def frame(spark, rows):
    return spark.createDataFrame([(i, v, 1, 1, "x", 1, 1) for i, v in rows], VECTORS)


def brute(rows, k=5, every=50):
    ok = [(i, np.floor(256 * np.array(v, float)).astype(np.int64)) for i, v in rows
          if v is not None and all(x is not None and np.isfinite(x) for x in v)]
    width = max(len(v) for _, v in ok)
    m = np.stack([np.pad(v, (0, width - len(v))) for _, v in ok])
    out = Counter()
    for a, (i, _) in enumerate(ok):
        if i is not None and i % every == 0:
            s = m @ m[a]
            best = sorted((-int(s[b]), ok[b][0] is None, ok[b][0] or 0) for b in range(len(ok)) if b != a)[:k]
            for rank, (score, none, j) in enumerate(best, 1):
                out[i, rank, None if none else j, -score] += 1
    return out


@pytest.mark.parametrize("sizes", [(4096, 4096), (7, 64)])
def test_search_against_brute_force(spark, sizes):
    rows = vectors()
    got = topk.search(frame(spark, rows).repartition(3), F.col("vec_id") % 50 == 0, query_block=sizes[0], data_block=sizes[1])
    assert Counter(map(tuple, got.collect())) == brute(rows)


def test_large_components_stay_exact(spark):
    rng = random.Random(1)
    rows = [(i, [rng.uniform(-1, 1) * 3e5 for _ in range(4)]) for i in range(60)]
    rows = [(i, [float(np.float32(x)) for x in v]) for i, v in rows]
    got = topk.search(frame(spark, rows), F.col("vec_id") % 50 == 0)
    assert Counter(map(tuple, got.collect())) == brute(rows)


def test_few_or_no_vectors(spark):
    assert topk.search(frame(spark, []), F.col("vec_id") % 50 == 0).collect() == []
    two = topk.search(frame(spark, [(0, [1.0]), (1, [2.0])]), F.col("vec_id") % 50 == 0).collect()
    assert [tuple(r) for r in two] == [(0, 1, 1, 131072)]
    assert topk.search(frame(spark, [(0, [1.0])]), F.col("vec_id") % 50 == 0).collect() == []


def test_trees_cover_their_points():
    rng = np.random.default_rng(0)
    points = np.concatenate([rng.normal(0, 50, (500, 8)), np.zeros((100, 8))])
    tree = topk.Tree.build(points, leaf=10)
    for node, (a, b) in enumerate(tree.span):
        own = tree.order[a:b]
        far = np.sqrt(((points[own] - points[tree.centre[node]]) ** 2).sum(axis=1))
        assert far.max() <= tree.radius[node] + 1e-9
        kids = tree.children[node]
        if kids:
            assert [tree.span[c][0] for c in kids] == [a, *[tree.span[c][1] for c in kids[:-1]]]
            centres = points[[tree.centre[c] for c in kids]]
            gaps = np.sqrt(((centres[:, None] - centres[None]) ** 2).sum(axis=2)) + 1e9 * np.eye(len(kids))
            assert gaps.min() > tree.radius[node] / 2
    assert sorted(tree.order) == list(range(len(points)))


# ------------------------------------------------------------------ pipeline

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, _key long, _blob string, fp long"


def documents(spark, rows):
    return spark.createDataFrame([(i, t, "en", s, len(t) if t else None, 1, "b", 2) for i, t, s in rows], COLUMNS)


def corpus(seed=6, n=120):
    rng = random.Random(seed)
    words = [f"term{i}" for i in range(500)]
    rows = [(i, " ".join(rng.choice(words) for _ in range(rng.randint(1, 300))), rng.choice(["a", "b", "c", None])) for i in range(n)]
    rows += [(500 + i, rows[i][1], "c") for i in range(0, n, 4)]
    rows += [(700 + i, rows[i][1] + " token=abcdefghijklmnop", "a") for i in range(5)]
    return rows + [(900, None, "a"), (901, "", None), (None, "lonely text without an id at all", "b"), (3, rows[3][1], rows[3][2])]


def test_stage_list():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "near_duplicates", "secrets", "mixing", "packing"]


def test_near_duplicate_stage_keeps_one_of_each_group(spark):
    rows = corpus()
    got = corpus_pipeline.near_duplicates_stage(spark, documents(spark, rows), SF)
    assert got.columns == documents(spark, []).columns
    want = {c for _, _, c in brute_components([(i, t) for i, t, _ in rows])}
    assert Counter(r.doc_id for r in got.collect()) == Counter(want)


def test_near_duplicate_stage_keeps_one_row_of_each_component(spark):
    """Whatever the ids: null ones, also of copies of a document with an id, and repeated ones."""
    rng = random.Random(8)
    text = [" ".join(rng.choice("abcdefghijklmnopq") * 3 for _ in range(60)) for _ in range(9)]
    rows = [(None, t, "a") for t in text[:4]] + [(None, text[0], "b"), (1, text[3], "a"), (3, text[5], "a"),
            (5, text[4], "a"), (5, text[5], "a"), (5, text[4], "b"), (6, text[4], "a"), (7, text[6], "a")]
    got = corpus_pipeline.near_duplicates_stage(spark, documents(spark, rows).repartition(3), SF).collect()
    want = {(None, text[0]), (None, text[1]), (None, text[2]), (1, text[3]), (3, text[5]), (5, text[4]), (7, text[6])}
    assert Counter((r.doc_id, r.text) for r in got) == Counter(want)


def test_secrets_stage_masks_and_keeps_rows(spark):
    rows = corpus()
    got = corpus_pipeline.secrets_stage(spark, documents(spark, rows), SF)
    assert got.columns == documents(spark, []).columns
    out = got.collect()
    assert Counter(r.doc_id for r in out) == Counter(i for i, _, _ in rows)
    for r in out:
        assert not brute_base(r.text or "") and r.n_chars == (len(r.text) if r.text else None)
    texts = {r.doc_id: r.text for r in out}
    assert texts[700] == rows[0][1] + " " + secret_scan.MASK and texts[1] == rows[1][1]


def test_mixing_stage_repeats_documents(spark):
    rows = corpus() + [(8, "one row again and again", "b")] * 60 + [(None, "without an id", "c")] * 30
    docs = documents(spark, rows).repartition(4)
    copies = Counter()
    for r in mixing.mix(docs).collect():
        copies[r.doc_id, r.source, r.digest] += r.copies
    got = corpus_pipeline.mixing_stage(spark, docs, SF)
    assert got.columns == docs.columns
    assert Counter((r.doc_id, r.source, hashlib.md5((r.text or "").encode()).hexdigest()) for r in got.collect()) == +copies


def test_stages_take_any_column_names_and_types(spark):
    """Dotted and quoted names, an array, a map and a struct go through all stages unread; repeats that differ
    in them only are kept alike in every run."""
    rows = corpus(n=40)
    kind = ("doc_id long, text string, source string, n_chars long, `meta.lang` string, `a``b` array<string>, "
            "m map<string,int>, s struct<x:int,`y.z`:string>")
    wide = [(i, t, s, len(t) if t else None, "en", [str(i), None], {"k": i or 0}, (1, "z")) for i, t, s in rows]
    wide += [(2, rows[2][1], rows[2][2], 5, "en", [str(v)], {"k": v, "l": None}, (v, None)) for v in range(6)]
    docs = spark.createDataFrame(wide, kind)
    for name, step in corpus_pipeline.STAGES[:-1]:
        out = step(spark, docs, SF)
        assert out.schema.names == docs.schema.names and [f.dataType for f in out.schema] == [f.dataType for f in docs.schema], name
        assert out.count() > 0
    kept = [corpus_pipeline.near_duplicates_stage(spark, spark.createDataFrame(r, kind).repartition(n), SF)
            .where("doc_id = 2").collect() for n, r in ((2, wide), (5, wide[::-1]))]
    assert kept[0] == kept[1] and len(kept[0]) == 1
    assert corpus_pipeline.packing_stage(spark, docs, SF).count() >= len(wide)


def test_toxicity_stage_rejects_what_the_operator_predicts(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = corpus_pipeline.toxicity_stage(spark, docs, SF)
    from auditspark.llm import queries

    rejected = {r.doc_id for r in queries.op2_toxicity(spark, SF).collect() if r.predicted}
    assert Counter(r.doc_id for r in got.collect()) == Counter(
        r.doc_id for r in docs.collect() if r.doc_id not in rejected)
    assert got.columns == docs.columns


def test_toxicity_stage_keeps_clean_texts_of_null_and_repeated_ids(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rejected = {r.doc_id for r in queries.op2_toxicity(spark, SF).collect() if r.predicted}
    texts = {r.doc_id: r.text for r in docs.collect() if r.text}
    toxic, *clean = [texts[min(rejected)], *[texts[i] for i in sorted(texts.keys() - rejected)[:3]]]
    odd = [(None, toxic), (None, clean[0]), (None, clean[1]), (10**9, toxic), (10**9, clean[2]), (10**9, clean[2])]
    more = spark.createDataFrame(odd, "doc_id long, text string")
    got = corpus_pipeline.toxicity_stage(spark, docs.unionByName(more, allowMissingColumns=True), SF).collect()
    assert Counter((r.doc_id, r.text) for r in got if r.doc_id in (None, 10**9)) == Counter(
        [(None, clean[0]), (None, clean[1]), (10**9, clean[2]), (10**9, clean[2])])


def test_toxicity_stage_scores_before_texts_move(spark):
    """The join of the texts with the rejected keys does not run beside the scoring, whose tasks hold the index."""
    docs = documents(spark, [(i, f"word{i} and more", "a") for i in range(4)])
    plan = corpus_pipeline.toxicity_stage(spark, docs, SF)._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" not in plan and "SortMergeJoin" not in plan


def test_every_stage_takes_an_empty_table(spark):
    for name, step in corpus_pipeline.STAGES:
        out = step(spark, documents(spark, []), SF)
        assert out.collect() == [], name


def test_run_is_the_stages_in_turn(spark):
    from auditspark.llm.common import stage

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for _, step in corpus_pipeline.STAGES[:-1]:
        docs = stage(step(spark, docs, SF))
    want = Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in packing.pack_documents(docs).collect())
    got = corpus_pipeline.run(spark, SF).collect()
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
