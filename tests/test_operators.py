"""Join, union, aggregation and resolution operators on hand-made frames."""

import random

from pyspark.sql import functions as F

from auditspark.operators import aggregates, joins, ordered, resolve


def test_natural_join_matches_na_keys(spark):
    left = spark.createDataFrame([(1, None, "a"), (2, 5, "b")], "k int, j int, x string")
    right = spark.createDataFrame([(1, None, "p"), (2, 6, "q")], "k int, j int, y string")
    out = joins.natural_join(left, right).collect()
    assert [(r.k, r.j, r.x, r.y) for r in out] == [(1, None, "a", "p")]
    assert left.join(right, ["k", "j"]).count() == 0


def test_full_reconcile_keeps_both_sides(spark):
    new = spark.createDataFrame([("a", 5), ("b", 3)], "brand string, n long")
    old = spark.createDataFrame([("a", 4), ("c", 1)], "brand string, s long")
    rows = {r.brand: r for r in joins.reconcile(new, old, "brand", "n", "s").collect()}
    assert rows["a"].difference == 1 and rows["a"].is_equal is False
    assert rows["b"].s is None and rows["c"].n is None and rows["c"].is_equal is None


def test_override_union_and_first_per_key(spark):
    base = spark.createDataFrame([("x", "old", 1), ("y", "keep", 2), ("x", "old2", 3)], "b string, v string, r int")
    t1 = spark.createDataFrame([("x", "new", 1)], "b string, v string, r int")
    t2 = spark.createDataFrame([("x", "newer", 1, True), ("z", "z", 2, False)], "b string, v string, r int, p boolean")
    u = joins.override_union(base, [t1, t2], "b")
    assert sorted((r.b, r.v) for r in u.collect()) == [("x", "new"), ("x", "newer"), ("y", "keep"), ("z", "z")]
    assert "p" in u.columns
    first = {r.b: r.v for r in ordered.first_per_key(u, ["b"], ["source_rank", "r"]).collect()}
    assert first == {"x": "new", "y": "keep", "z": "z"}


def test_member_flag_na_semantics(spark):
    df = spark.createDataFrame([(1,), (None,), (3,)], "k int")
    s = spark.createDataFrame([(1,), (2,)], "m int")
    got = [r.f for r in joins.member_flag(df, s, "k", "m", "f").orderBy(F.col("k").asc_nulls_last()).collect()]
    assert got == [True, False, False]


def test_to_string_agg_keeps_duplicates_and_na(spark):
    df = spark.createDataFrame([("a", "q"), ("a", None), ("a", "p"), ("a", "p")], "k string, v string")
    out = aggregates.to_string_agg(df, ["k"], "v", "s").first()
    assert out.s == "p, p, q, NA"


def test_collapse_duplicates_idempotent(spark):
    df = spark.createDataFrame([("e", "a", 10, 2, 0.2), ("e", "a", 10, 3, 0.3), ("e", "b", 10, 5, 0.5)],
                               "event_id string, brand string, event_total_count int, total_count long, "
                               "proportion double")
    once = aggregates.collapse_duplicates(df)
    twice = aggregates.collapse_duplicates(once)
    assert sorted(once.collect()) == sorted(twice.collect())
    assert {r.brand: r.total_count for r in once.collect()} == {"a": 5, "b": 5}


def test_status_conflicts_and_demotion(spark):
    df = spark.createDataFrame([("a", "true"), ("a", "false"), ("b", "true"), ("c", None)],
                               "brand_name string, validated string")
    conf = {r.brand_name: r.validated_concat for r in aggregates.status_conflicts(df).collect()}
    assert conf == {"a": "false, true", "c": "NA"}
    dem = aggregates.demote_conflicts(df, aggregates.status_conflicts(df))
    assert {r.validated for r in dem.filter("brand_name = 'a'").collect()} == {"false"}


def test_fallback_chain_order(spark):
    rows = [  # brand, company, raw company, status, id
        ("b1", None, "Unbranded", None, None),
        ("b2", None, None, "true", ""),
        ("b3", "NULL", "x", None, "q12"),
        ("b4", None, "acme", "attempted", None),
    ]
    df = spark.createDataFrame(rows, "brand_name string, parent_company_name string, parent_company string, "
                                     "validated string, id string")
    out = {r.brand_name: r for r in resolve.fallback_chain(df).collect()}
    assert (out["b1"].validated, out["b1"].parent_company_name, out["b1"].id) == ("true", "Unbranded", "Unbranded")
    # NA raw company makes the unbranded test NA, so status becomes NA (ifelse(NA) is NA).
    assert out["b2"].validated is None and out["b2"].parent_company_name is None and out["b2"].id is None
    assert (out["b3"].validated, out["b3"].parent_company_name, out["b3"].id) == ("false", "b3", "q12")
    assert out["b4"].parent_company_name == "acme" and out["b4"].id == "acme"


def test_entity_labels_all_or_nothing(spark):
    ids = spark.createDataFrame([("q12q34",), ("q12",), ("q99",), ("http://q12",), ("x1",)], "id string")
    labels = spark.createDataFrame([("q12", "coca-cola"), ("q34", "pepsico")], "id string, label string")
    got = {r.id: r.name for r in resolve.entity_labels(ids, labels).collect()}
    assert got == {"q12q34": "coca-cola, pepsico", "q12": "coca-cola", "q99": "q99"}


def test_global_positions_match_brute_force(spark):
    random.seed(7)
    rows = [(f"id{i:03d}", float(random.choice([0.1, 0.2, 0.2, 0.3, 0.5])) / (1 + i % 3)) for i in range(300)]
    df = spark.createDataFrame(rows, "id string, mean double").repartition(5)
    got = {r.id: r for r in ordered.rank_desc_avg_ties(df, "mean", "id", parts=6).collect()}
    srt = sorted(rows, key=lambda r: (-r[1], r[0]))
    cum = 0.0
    for pos, (i, m) in enumerate(srt, start=1):
        cum += m
        ties = [k for k, (_, v) in enumerate(srt, start=1) if v == m]
        assert got[i].row_pos == pos
        assert abs(got[i].cumulative - cum) < 1e-9
        assert got[i]["rank"] == min(ties) + (len(ties) - 1) / 2.0


def test_top_with_ties_and_dense_index(spark):
    df = spark.createDataFrame([(i, float(v)) for i, v in enumerate([5, 4, 4, 3, 2])], "k int, v double")
    assert sorted(r.k for r in ordered.top_with_ties(df, "v", 2).collect()) == [0, 1, 2]
    idx = {r.v: r.idx for r in ordered.dense_index(df, ["v"], parts=3).collect()}
    assert idx == {2.0: 1, 3.0: 2, 4.0: 3, 5.0: 4}


def test_exact_quantiles_type7(spark):
    import numpy as np

    vals = [3.0, 1.0, 4.0, 1.0, 5.0, 9.0, 2.0, 6.0, 5.0, 3.0, 5.0]
    df = spark.createDataFrame([(v,) for v in vals] + [(None,)], "x double").repartition(4)
    q = aggregates.exact_quantiles(df, "x", [0.025, 0.25, 0.5, 0.75, 0.975, 1.0]).first()
    want = np.quantile(vals, [0.025, 0.25, 0.5, 0.75, 0.975, 1.0])
    assert np.allclose(list(q), want)


def test_exact_quantiles_hot_value(spark):
    import numpy as np

    vals = [0.0] * 40 + [float(i) for i in range(1, 61)]
    df = spark.createDataFrame([(v,) for v in vals], "x double").repartition(3)
    q = aggregates.exact_quantiles(df, "x", [0.1, 0.4, 0.41, 0.5, 0.99]).first()
    assert np.allclose(list(q), np.quantile(vals, [0.1, 0.4, 0.41, 0.5, 0.99]))


def test_brand_key_review_keeps_ids_beside_their_names(spark):
    from auditspark.plans.queries.brands import brand_key_review

    key = spark.createDataFrame([("cola", "alpha", "q9", 1), ("cola", "beta", "q2", 2), ("cola", "beta", "q2", 4),
                                 ("cola", "gamma", "q9", 8)], "brand_name string, new_name string, id string, sum long")
    items = spark.createDataFrame([("cola", "x"), ("cola", "x")], "brand_name string, country string")
    row = brand_key_review(key, items).first().asDict()
    assert row == {"brand_name": "cola", "parent_company_name": "alpha, beta, gamma", "id": "q9, q2, q9", "sum": 15,
                   "country": "x"}


def test_brand_company_table_counts_companies_without_a_window(spark):
    from auditspark.plans.queries.brands import brand_company_table

    items = spark.createDataFrame([("cola", "a", "q1", "true", 3), ("cola", "b", "q2", "true", 4), ("cola", "b", "q2", "true", 5)],
                                  "brand_name string, parent_company_name string, id string, validated string, total_count long")
    out = brand_company_table(items)
    assert out.select("brand_parent_occurances", "parent_company_name", "id", "brand_total_count", "brand_frequency"
                      ).collect() == [(2, "a, b", "q1, q2", 12, 3)]
    assert "Window" not in out._jdf.queryExecution().optimizedPlan().toString()
