import time

import pytest
from pyspark.sql import functions as F

from auditspark.sources import buckets
from auditspark.sources.snapshots import Conflict, Store


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_later_run_starts_from_the_last_commit(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/store")
    assert store.commits() == [] and store.tables() == []
    with store.begin() as run:
        run.write("a", spark.range(3))
        run.write("b", spark.range(2).select((F.col("id") * 10).alias("x"), F.lit(2020).alias("year")), ["year"])
    with store.begin() as run:
        back = run.read("a")
        run.write("a", back.select((F.col("id") + 100).alias("id")))
        assert rows(run.read("a")) == [(100,), (101,), (102,)]
        assert rows(store.read("a")) == [(0,), (1,), (2,)]  # not committed yet
    assert store.commits() == [1, 2] and store.tables() == ["a", "b"]
    assert rows(store.read("a")) == [(100,), (101,), (102,)] and rows(store.read("a", 1)) == [(0,), (1,), (2,)]
    assert rows(store.read("b")) == [(0, 2020), (10, 2020)]
    assert rows(Store(spark, f"file://{tmp_path}/store").read("b")) == [(0, 2020), (10, 2020)]


def test_crashed_run_is_invisible(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/store")
    with store.begin() as run:
        run.write("a", spark.range(3))
    with pytest.raises(ZeroDivisionError), store.begin() as run:
        run.write("a", spark.range(50))
        run.write("new", spark.range(1))
        raise ZeroDivisionError
    assert store.commits() == [1] and store.tables() == ["a"] and store.read("a").count() == 3
    with pytest.raises(KeyError):
        store.read("new")
    with pytest.raises(KeyError):
        store.read("a", 7)


def test_of_two_commits_at_once_one_fails(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/store")
    first, second = store.begin(), store.begin()
    first.write("a", spark.range(1))
    second.write("a", spark.range(2))
    assert second.commit() == 1
    with pytest.raises(Conflict):
        first.commit()
    assert store.read("a").count() == 2 and store.commits() == [1]


def test_collect_keeps_what_manifests_point_to(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/store")
    ids = []
    for n in range(3):
        with store.begin() as run:
            ids.append(run.id)
            run.write("a", spark.range(n + 1))
            if n == 0:
                run.write("b", spark.range(9))
    lost = store.begin()
    lost.write("a", spark.range(5))
    assert store.collect(keep=1) == []  # all are young
    later = time.time() + 1e6
    # Run 0 still holds table b; run 1 is overwritten, the last was never committed.
    assert store.collect(keep=1, now=later) == sorted([ids[1], lost.id])
    assert store.commits() == [3] and store.read("a").count() == 3 and store.read("b").count() == 9


def test_empty_table_keeps_its_schema(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/store")
    with store.begin() as run:
        run.write("none", spark.createDataFrame([], "k long, year int"), ["year"])
    assert store.read("none").collect() == [] and store.read("none").columns == ["k", "year"]


@pytest.fixture()
def no_broadcast(spark):
    kept = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", kept)


def test_joins_and_groups_on_the_key_have_no_exchange(spark, tmp_path, no_broadcast):
    items = spark.range(5000).select(F.concat(F.lit("e"), F.col("id") % 300).alias("event_id"), F.col("id").alias("n"),
                                     (F.col("id") % 3 + 2018).cast("int").alias("year"))
    events = items.select("event_id").distinct().withColumn("total", F.length("event_id"))
    a = buckets.write_buckets(items, f"{tmp_path}/items", "event_id", 8, ["year"])
    b = buckets.write_buckets(events, f"{tmp_path}/events", "event_id", 8)
    joined = a.join(b, "event_id").groupBy("event_id").agg(F.sum("n").alias("n"), F.max("total").alias("total"))
    assert buckets.exchanges(joined) == 0
    plain = items.join(events, "event_id").groupBy("event_id").agg(F.sum("n").alias("n"), F.max("total").alias("total"))
    assert buckets.exchanges(plain) > 0 and rows(joined) == rows(plain)
    again = buckets.open_buckets(spark, a, f"{tmp_path}/items", "event_id", 8, ["year"])
    assert rows(again) == rows(a) and buckets.exchanges(again.groupBy("event_id").count()) == 0


def test_year_filter_reads_its_folders_only(spark, tmp_path):
    items = spark.range(600).select(F.col("id").cast("string").alias("event_id"), (F.col("id") % 3 + 2018).cast("int").alias("year"))
    a = buckets.write_buckets(items, f"{tmp_path}/items", "event_id", 4, ["year"])
    one = a.where("year = 2019")
    plan = one._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(year" in plan and "DataFilters: []" in plan
    assert one.count() == 200
    assert all("year=2019" in f for f in [r.f for r in one.select(F.input_file_name().alias("f")).distinct().collect()])


def test_null_keys_and_empty_tables(spark, tmp_path):
    a = buckets.write_buckets(spark.createDataFrame([(None, 1), ("x", 2), (None, 3)], "k string, v int"), f"{tmp_path}/n", "k", 3)
    assert rows(a.groupBy("k").agg(F.sum("v").alias("v")).select("v")) == [(2,), (4,)]
    e = buckets.write_buckets(spark.createDataFrame([], "k string, v int"), f"{tmp_path}/e", "k", 3)
    assert e.collect() == [] and e.columns == ["k", "v"]
