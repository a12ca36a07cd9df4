import itertools
import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from auditspark.operators import checks, resolve, sketches
from auditspark.sources import csv, malformed, order

KINDS = {"t": T.StringType(), "i": T.LongType(), "d": T.DoubleType(), "y": T.DateType()}


def all_alignments(fields, kinds):
    """Every way to cut the fields into the columns, by trying all."""
    k, m, out = len(kinds), len(fields), []
    for cuts in itertools.combinations(range(1, m), k - 1):
        ends = (0, *cuts, m)
        parts = [fields[a:b] for a, b in itertools.pairwise(ends)]
        good = True
        for part, kind in zip(parts, kinds):
            check = malformed.reads_as(KINDS[kind])
            if check is not None:
                good &= len(part) == 1 and check(part[0][0])
            elif len(part) > 1:
                good &= not any(q for _, q in part)
        if good:
            out.append([",".join(t for t, _ in part) for part in parts])
    return out


def test_alignment_against_all_cuts():
    rng = random.Random(17)
    seen = set()
    for _ in range(4000):
        kinds = [rng.choice("ttidy") for _ in range(rng.randint(1, 5))]
        fields = [(rng.choice(["a", " b", "7", "-2.5", "NA", "", "2020-01-02", "x y"]), rng.random() < 0.15)
                  for _ in range(rng.randint(max(1, len(kinds) - 1), len(kinds) + 4))]
        outcome, values = malformed.align(fields, [malformed.reads_as(KINDS[k]) for k in kinds])
        if len(fields) < len(kinds):
            assert outcome == "short"
        else:
            ways = all_alignments(fields, kinds)
            assert outcome == ("none" if not ways else "aligned" if len(ways) == 1 else "ambiguous"), (fields, kinds)
            if len(ways) == 1:
                assert values == ways[0]
        seen.add(outcome)
    assert seen == {"short", "none", "aligned", "ambiguous"}


def test_split_line():
    assert malformed.split_line('a,"b, ""c""",,d') == [("a", False), ('b, "c"', True), ("", False), ("d", False)]
    assert malformed.split_line("") == [("", False)] and malformed.split_line(",") == [("", False)] * 2
    assert malformed.split_line('a,"b') is None and malformed.split_line('"a"b,c') is None


def test_no_line_is_lost(spark, tmp_path):
    lines = ["k,name,n,city,place,year", "1,a,5,x,y,2020", "2,a, b, c,5,x,y,2020", "3,a,5,x,y", "4,a,5,x,y,z,2020", "5,a,NA,x,y,2020,2021,q",
             '6,"a, b",7,x,y,2020', '7,"a,5,x,y,2020', "", "8,NA,oops,x,y,2020", "9,a,b,5,x,y,NA"]
    (tmp_path / "f.csv").write_text("\n".join(lines) + "\n")
    schema = T.StructType([T.StructField("k", T.LongType()), T.StructField("name", T.StringType()), T.StructField("n", T.LongType()),
                           T.StructField("city", T.StringType()), T.StructField("place", T.StringType()), T.StructField("year", T.IntegerType())])
    rows, bad = malformed.read_aligned(spark, f"file://{tmp_path}/f.csv", schema)
    assert sorted(tuple(r) for r in rows.select("outcome", "k", "name", F.coalesce("n", F.lit(-1)), "city", "place",
                                                F.coalesce("year", F.lit(-1))).fillna("-").collect()) == [
        ("aligned", 2, "a, b, c", 5, "x", "y", 2020), ("aligned", 9, "a,b", 5, "x", "y", -1),
        ("row", 1, "a", 5, "x", "y", 2020), ("row", 6, "a, b", 7, "x", "y", 2020), ("row", 8, "-", -1, "x", "y", 2020)]
    assert rows.count() == 5 and rows.select("k").count() == 5 and bad.count() == 4  # also with columns pruned
    assert sorted(tuple(r) for r in bad.collect()) == [
        ("ambiguous", lines[4]), ("none", lines[5]), ("quotes", lines[7]), ("short", lines[3])]


def test_long_line_is_linear():
    fields = [("5", False)] + [("a", False)] * 200_000 + [("5", False)]
    outcome, values = malformed.align(fields, [malformed.reads_as(KINDS[k]) for k in "iti"])
    assert outcome == "aligned" and len(values[1]) == 399_999


def test_file_order_survives_a_shuffle(spark, tmp_path):
    text = ["v"] + [f"r{(i * 7919) % 5000}" for i in range(5000)]
    for part in range(3):
        (tmp_path / f"part-{part}.csv").write_text("\n".join(["v"] + [f"{part}:{t}" for t in text[1:]]) + "\n")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "8k")  # several blocks a file
    try:
        scan = order.with_file_order(spark.read.option("header", True).csv(f"file://{tmp_path}"))
        assert scan.rdd.getNumPartitions() > 3
        got = [r.v for r in scan.repartition(7, "v").orderBy("_order").collect()]
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert got == [f"{part}:{t}" for part in range(3) for t in text[1:]]


def test_string_parts_are_the_whole_list(spark):
    rng = random.Random(3)
    rows = [(rng.choice(["a", "b", None]), i, rng.choice(["x", "y", None])) for i in range(300)] + [("c", 1000, "z")]
    df = spark.createDataFrame(rows, "k string, o int, v string").repartition(6)
    parts = order.to_string_parts(df, ["k"], "v", [F.col("o")], "s", most=7).collect()
    assert all(r.n <= 7 for r in parts)
    for k in ("a", "b", None, "c"):
        own = [v or "NA" for key, _, v in rows if key == k]
        got = sorted((r.part, r.s) for r in parts if r.k == k)
        assert [p for p, _ in got] == list(range(-(-len(own) // 7))) and ", ".join(s for _, s in got) == ", ".join(own)


def test_sketches_unite_to_the_whole(spark):
    df = spark.range(60_000).select((F.col("id") % 6).alias("year"), (F.col("id") * 7919 % 9001).alias("a"),
                                    F.when(F.col("id") % 4 > 0, (F.col("id") * 31 % 60_000).cast("double")).alias("b"),
                                    F.lit(None).cast("string").alias("c"))
    n = {r.column: r.n_distinct for r in sketches.distinct_of(sketches.distinct_sketches(df, ["year"], ["a", "b", "c"])).collect()}
    exact = {"a": 9001, "b": df.select("b").distinct().count(), "c": 1}
    assert all(abs(n[c] - exact[c]) <= sketches.distinct_error() * exact[c] + 1 for c in n)
    q = {(r.column, r.p): r.value for r in sketches.quantiles_of(sketches.quantile_sketches(df, ["year"], ["a", "b", "c"]), [0.1, 0.5, 0.99]).collect()}
    for c in ("a", "b"):
        total = df.where(F.col(c).isNotNull()).count()
        for p in (0.1, 0.5, 0.99):
            below, upto = df.where(F.col(c) < q[c, p]).count() / total, df.where(F.col(c) <= q[c, p]).count() / total
            assert below - 0.02 <= p <= upto + 0.02
    assert q["c", 0.5] is None
    none = df.limit(0)
    assert sketches.distinct_of(sketches.distinct_sketches(none, ["year"], ["a"])).collect() == []


def test_row_rules_come_from_the_write(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (0, "b"), (None, "c")], "total_count int, x string")
    rules = [("positive", "total_count > 0"), ("known", "x IS NOT NULL")]
    reads = []

    def write(frame):
        frame.write.parquet(f"{tmp_path}/t")
        reads.append(frame)
        return spark.read.parquet(f"{tmp_path}/t")

    back, result = checks.write_checked(df, write, rules)
    assert back.count() == 3 and sorted(tuple(r) for r in result.collect()) == [("known", "PASS", 0, 0), ("positive", "FAIL", 1, 1)]
    assert sorted(tuple(r) for r in checks.check_rows(df, rules).collect()) == sorted(tuple(r) for r in result.collect())
    # The result is the observed numbers: its plan scans no table.
    assert "Scan" not in result._jdf.queryExecution().executedPlan().toString().replace("LocalTableScan", "").replace("Scan ExistingRDD", "")
    assert checks.write_checked(df, lambda f: f, [])[1].collect() == []


def test_control_totals(spark):
    df = spark.createDataFrame([(1,), (2,)], "n int")
    got = checks.control_totals([("a", df, "n", 3), ("b", df, "n", 4), ("c", df.limit(0), "n", 4),
                                 ("d", df, "n", df.agg(F.sum("n").alias("s")))])
    assert [tuple(r) for r in got.orderBy("rule").collect()] == [
        ("a", "PASS", 3.0, 3.0), ("b", "FAIL", 3.0, 4.0), ("c", "UNKNOWN", None, 4.0), ("d", "PASS", 3.0, 3.0)]


def test_location_worklist_matches_na(spark):
    items = spark.createDataFrame([("anull", None), ("b", "x"), (None, "y"), ("a", None)], "city string, country string")
    gaz = spark.createDataFrame([("a", None), (None, "z")], "city string, country string")
    assert sorted((r.city or "-", r.country or "-") for r in resolve.location_worklist(items, gaz, ["city", "country"]).collect()) == [
        ("-", "y"), ("b", "x")]


def test_row_names_round_trip(spark, tmp_path):
    df = spark.createDataFrame([("b", None), ("a", ""), ("c", 'q"u')], "k string, v string")
    csv.write_csv(df, f"file://{tmp_path}/w", row_names=["k"])
    back = csv.read_csv(spark, f"file://{tmp_path}/w", profile="base")
    assert sorted(tuple(r) for r in back.fillna("NULL").collect()) == [("1", "a", ""), ("2", "b", "NULL"), ("3", "c", 'q"u')]


def test_bucketed_queries_move_no_row(spark):
    from auditspark.plans.queries import stages
    from auditspark.sources import buckets

    kept = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        items, events = stages.bucketed_shares(spark, "/root/testdata/sf0.001")
        assert buckets.exchanges(stages.shares_from_buckets(items, events)) == 0
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", kept)


@pytest.mark.parametrize("name", ["malformed_lines", "stage_snapshots"])
def test_queries_run_twice_alike(spark, name):
    from auditspark.plans import registry

    registry.load_all()
    a, b = (sorted(map(str, registry.SPARK[name](spark, "/root/testdata/sf0.001").collect())) for _ in range(2))
    assert a == b and a


def test_rows_of_one_value_are_dealt_to_many_tasks(spark):
    """However many rows a country has, a task holds a bounded part of them; no row is lost."""
    from pyspark.sql import functions as F

    from auditspark.plans.queries.stages import dealt_anew

    name = "spark.sql.adaptive.advisoryPartitionSizeInBytes"
    before = spark.conf.get(name)
    spark.conf.set(name, "1m")
    most = []
    try:
        for n in (40_000, 160_000):
            x = spark.range(0, n, 1, n // 5000).select("id", F.sha2(F.col("id").cast("string"), 256).alias("v"), F.lit("nl").alias("country"))
            parts = (dealt_anew(x, "country").withColumn("_p", F.spark_partition_id())
                     .groupBy("_p").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("id").alias("d"), F.max("v")).collect())
            assert sum(r.n for r in parts) == sum(r.d for r in parts) == n
            most.append(max(r.n for r in parts))
    finally:
        spark.conf.set(name, before)
    assert most[0] < 40_000 and most[1] <= 1.5 * most[0]
