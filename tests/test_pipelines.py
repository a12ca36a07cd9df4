"""Pipelines on a small synthesized raw fixture that plants the reference's traps."""

import tempfile

from auditspark.plans import pipelines

ITEMS = "row_id int, submission_type string, submission_id int, year int, brand_name string, " \
        "parent_company string, item_description string, type_product string, type_material string, " \
        "layer string, total_count string"
EVENTS = "submission_type string, submission_id int, year int, type_of_audit string, " \
         "specifics_of_audit string, country string, city string, province string, continent string, " \
         "is_trained string, total_count string, file_name string"


def _fixture(spark):
    items = spark.createDataFrame([
        (1, "A", 1, 2019, "coke", "Coca-Cola", "bottle", "FP", "pet", "SL", "3"),
        (2, "A", 1, 2019, "lays", "NULL", "bag", "o", "ML", "ml", "1"),
        (3, "A", 1, 2019, "none", "Unbranded", "cup", "pp", "pp", "o", "4"),
        (4, "B", 2, 2019, "coke", "Coca-Cola", "bottle", "fp", "pet", "sl", "2"),   # shares sum to 2/3
        (5, "C", 3, 2017, "coke", "Coca-Cola", "bottle", "fp", "pet", "sl", "5"),   # bad year
        (6, "D", 4, 2020, "coke", "Coca-Cola", "bottle", "fp", "pet", "sl", "2"),   # event total <= 2
        (7, "E", 5, 2021, "coke", "Coca-Cola", "bottle", "fp", "pet", "sl", "NULL"),
    ], ITEMS)
    events = spark.createDataFrame([
        ("A", 1, 2019, "Outdoor", "Coast/Shoreline", "United Kingdom", "x", "y", "Europe", "rojaki", "8", "f1"),
        ("B", 2, 2019, "Outdoor", "park", "korea", "x", "y", "Asia", "yes", "3", "f2"),
        ("C", 3, 2017, "Outdoor", "lake", "mexico", "x", "y", "Americas", "no", "5", "f3"),
        ("D", 4, 2020, "Outdoor", "lake", "mexico", "x", "y", "Americas", "no", "2", "f4"),
        ("E", 5, 2021, "Indoor", "lake", "mexico", "x", "y", "Americas", "no", "5", "f5"),
    ], EVENTS)
    key = spark.createDataFrame([("coke", "the coca-cola company", "q3295867")],
                                "brand_name string, parent_company_name string, id string")
    return items, events, key


def test_ingest_keeps_only_plausible_audits(spark):
    items, events, key = _fixture(spark)
    clean = pipelines.ingest(items, events, key)
    assert sorted(clean.select("event_id").distinct().collect()) == [("A_1_2019",)]
    assert clean.count() == 3 and "file_name" not in clean.columns


def test_resolve_and_normalize(spark):
    items, events, key = _fixture(spark)
    clean = pipelines.ingest(items, events, key)
    validated = spark.createDataFrame([("coke", "Coca Cola", "q3295867", "TRUE", 1)],
                                      "brand_name string, parent_company_name string, id string, "
                                      "validated string, row_idx int")
    review = spark.createDataFrame([("lays", "pepsico", "q334800", "attempted", 1)],
                                   "brand_name string, parent_company_name string, id string, "
                                   "validated string, row_idx int")
    r = pipelines.normalize(pipelines.resolve_brands(validated, [review], clean))
    rows = {x.brand_name: x for x in r.collect()}
    assert rows["coke"].validated == "true" and rows["coke"].id == "q3295867"
    assert rows["lays"].parent_company_name == "pepsico" and rows["lays"].type_product == "other"
    assert rows["none"].parent_company_name == "unbranded" and rows["none"].id == "unbranded"
    assert rows["none"].validated == "true"
    assert rows["coke"].country == "united kingdom of great britain & northern ireland"
    assert rows["coke"].specifics_of_audit == "coastal" and rows["coke"].is_trained == "null"
    assert rows["coke"].type_product == "food packaging" and rows["lays"].layer == "multi-layer"


def test_stream_ingest_matches_batch(spark):
    from auditspark.streaming.ingest import start_item_stream

    items, events, key = _fixture(spark)
    d = tempfile.mkdtemp(prefix="auditspark-stream-")
    items.write.parquet(f"{d}/in/part1")
    q = start_item_stream(spark, f"{d}/in/part1", items.schema, events, key, f"{d}/out", f"{d}/ckpt")
    q.awaitTermination(120)
    out = spark.read.parquet(f"{d}/out")
    assert out.count() == pipelines.ingest(items, events, key).count()


def test_enrich_collapses_and_locates(spark):
    items, events, key = _fixture(spark)
    clean = pipelines.ingest(items, events, key)
    validated = spark.createDataFrame([("coke", "Coca Cola", "q3295867", "TRUE", 1)],
                                      "brand_name string, parent_company_name string, id string, "
                                      "validated string, row_idx int")
    norm = pipelines.normalize(pipelines.resolve_brands(validated, [], clean))
    # a duplicate item row that must be merged by the collapse step
    norm = norm.unionByName(norm.filter("brand_name = 'coke'"))
    locations = spark.createDataFrame(
        [("x", "y", "united kingdom of great britain & northern ireland", "europe", None, None, 51.5, -0.1, 54.0, -2.0)],
        "city string, province string, country string, continent string, latitude_specific double, "
        "longitude_specific double, latitude_state double, longitude_state double, latitude_country double, "
        "longitude_country double")
    labels = spark.createDataFrame([("q3295867", "the coca-cola company")], "id string, name string")
    out = {r.brand_name: r for r in pipelines.enrich(norm, locations, labels).collect()}
    coke = out["coke"]
    assert coke.total_count == 6 and abs(coke.proportion - 0.75) < 1e-12
    assert coke.parent_company_name == "the coca-cola company"
    assert (coke.latitude_most_specific, coke.location_specificity) == (51.5, "state")
    assert out["lays"].parent_company_name == "lays"  # company "NULL" falls back to the brand
    assert "parent_company_name_old" not in coke.asDict() and "row_id" not in coke.asDict()


def _write_csv(path, header, rows):
    import csv
    import os

    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "w", newline="", encoding="utf-8") as f:
        w = csv.writer(f, quoting=csv.QUOTE_NONNUMERIC, lineterminator="\n")
        w.writerow(header)
        w.writerows(rows)


def test_end_to_end_from_r_style_csv(spark):
    """Raw CSV files as R writes them -> L1 -> L2 -> L3 -> L4 -> L8."""
    from pyspark.sql import functions as F

    from auditspark.functions import rsem
    from auditspark.sources.csv import read_csv

    d = tempfile.mkdtemp(prefix="auditspark-e2e-")
    _write_csv(f"{d}/brands.csv",
               ["row_id", "submission_type", "submission_id", "year", "brand_name", "parent_company",
                "item_description", "type_product", "type_material", "layer", "total_count"],
               [[1, "A", 1, 2019, " Coke\t", "Coca-Cola, Inc.", "bottle", "FP", "pet", "SL", "3"],
                [2, "A", 1, 2019, "Lays", "NULL", "bag", "o", "ML", "ml", "1"],
                [3, "A", 1, 2019, "none", "Unbranded", "cup", "pp", "pp", "o", "4"],
                [4, "B", 2, 2020, "coke\r", "Coca-Cola, Inc.", "bottle", "fp", "pet", "sl", "5"],
                [5, "B", 2, 2020, "none", "Unbranded", "cup", "pp", "pp", "o", "5"],
                [6, "C", 3, 2017, "coke", "Coca-Cola, Inc.", "bottle", "fp", "pet", "sl", "NULL"]])
    _write_csv(f"{d}/events.csv",
               ["submission_type", "submission_id", "year", "type_of_audit", "specifics_of_audit", "city",
                "province", "country", "continent", "is_trained", "time_spent", "start_of_audit", "total_count"],
               [["A", 1, 2019, "Outdoor", "Coast/Shoreline", "nullarbor", "NA", "United Kingdom", "Europe",
                 "yes", "-5", "9/10/2019", "8"],
                ["B", 2, 2020, "Outdoor", "park", "x", "y", "korea", "Asia", "rojaki", "0", "1/2/2020", "10"],
                ["C", 3, 2017, "Outdoor", "lake", "x", "y", "mexico", "Americas", "no", "3", "bad", "5"]])
    items = read_csv(spark, f"{d}/brands.csv", multi_line=True).withColumn("brand_name", rsem.lower_trim("brand_name"))
    items = items.withColumns({c: F.col(c).try_cast("int") for c in ("row_id", "submission_id", "year")})
    events = read_csv(spark, f"{d}/events.csv").withColumns(
        {c: F.col(c).try_cast("int") for c in ("submission_id", "year")})
    assert items.filter("parent_company = 'Coca-Cola, Inc.'").count() == 3     # quoted comma kept
    key = spark.createDataFrame([("coke", "the coca-cola company", "q3295867")],
                                "brand_name string, parent_company_name string, id string")
    clean = pipelines.ingest(items, events, key)
    assert sorted(r[0] for r in clean.select("event_id").distinct().collect()) == ["A_1_2019", "B_2_2020"]
    validated = spark.createDataFrame([("coke", "coca-cola", "q3295867", "true", 1)],
                                      "brand_name string, parent_company_name string, id string, "
                                      "validated string, row_idx int")
    norm = pipelines.normalize(pipelines.resolve_brands(validated, [], clean))
    locations = spark.createDataFrame([("arbor", None, "united kingdom of great britain & northern ireland", "europe",
                                        50.0, 1.0, None, None, 54.0, -2.0)],
                                      "city string, province string, country string, continent string, "
                                      "latitude_specific double, longitude_specific double, latitude_state double, "
                                      "longitude_state double, latitude_country double, longitude_country double")
    rows = {(r.event_id, r.brand_name): r for r in pipelines.enrich(norm, locations).collect()}
    a_coke = rows[("A_1_2019", "coke")]
    assert a_coke.city == "arbor" and a_coke.location_specificity == "city"      # gsub("null", "")
    assert a_coke.province is None                                                # NA matched NA in the join
    assert str(a_coke.start_of_audit) == "2019-09-10" and a_coke.is_trained == "yes"
    b_coke = rows[("B_2_2020", "coke")]
    assert b_coke.country == "south korea" and b_coke.is_trained is None and b_coke.location_specificity == "other"
    assert rows[("A_1_2019", "lays")].parent_company_name == "lays"
    ranked = {r.id: r for r in pipelines.attribute(
        pipelines.enrich(norm, locations), replicates=20).collect()}
    # branded shares: A -> coke 3/4, lays 1/4; B -> coke 1; means over 2 events
    assert abs(ranked["q3295867"].mean - (0.75 + 1.0) / 2) < 1e-12 and ranked["q3295867"]["rank"] == 1.0
    assert abs(ranked["lays"].mean - 0.125) < 1e-12
    assert abs(ranked["lays"].cumulative - 1.0) < 1e-12
