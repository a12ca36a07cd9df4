"""Stage tables, snapshots, sketches, file order and malformed input.

Each query writes its files into the shared stage folder and reads them back."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from auditspark.operators import aggregates, checks, ordered, resolve, sketches
from auditspark.plans import audit
from auditspark.plans.queries.brands import _key_table, brand_company_table, brand_key_review, processed
from auditspark.plans.queries.location import _GAZ_SQL, _LOC_SQL, LOC_KEYS, event_locations, gazetteer
from auditspark.plans.queries.report import _EL_SQL, _PROC_SQL, _status_sql, event_list
from auditspark.plans.registry import query
from auditspark.sources import buckets, csv, malformed, order
from auditspark.sources.snapshots import Store
from auditspark.sources.tables import Tables

OUT_DIGITS = 6


def _folder(spark: SparkSession, name: str) -> str:
    return csv.stage_path(spark, name, uuid.uuid4().hex)


# ------------------------------------------------------------------ snapshots and layout


class _Lost(Exception):
    """Stands for whatever ends a run before its commit."""


@query("stage_snapshots", audit.sql("""
SELECT e.year, e.events, i.items FROM (SELECT year, COUNT(*) AS events FROM el GROUP BY year) e
JOIN (SELECT year, CAST(SUM(total_count) AS BIGINT) AS items FROM proc GROUP BY year) i ON i.year = e.year""", _EL_SQL, _PROC_SQL))
def q_stage_snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A run commits the cleaned tables, a second one is lost before its commit, a third starts from the last
    commit, adds its table, and what nobody points to is collected."""
    store = Store(spark, _folder(spark, "snapshots"))
    with store.begin() as run:
        proc = run.write("raw_processed_data", processed(Tables(spark, sf_dir)), ["year"])
        run.write("event_list", event_list(proc))
    try:
        with store.begin() as run:
            run.write("event_list", store.read("event_list").limit(0))
            raise _Lost
    except _Lost:
        pass
    with Store(spark, store.root).begin() as run:
        events = aggregates.count_rows(run.read("event_list"), ["year"], "events")
        items = run.read("raw_processed_data").groupBy("year").agg(F.sum("total_count").alias("items"))
        run.write("per_year", events.join(items, "year").select("year", "events", "items"))
    store.collect(keep=1, grace=0.0)
    return store.read("per_year")


def bucketed_shares(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Items and events as stage tables in buckets of the event, the items in a folder per year."""
    items = processed(Tables(spark, sf_dir)).select("event_id", "id", "total_count", "year")
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    a = buckets.write_buckets(items, _folder(spark, "items_by_event"), "event_id", n, ["year"])
    events = a.groupBy("event_id").agg(F.sum("total_count").alias("event_sum"))
    return a, buckets.write_buckets(events, _folder(spark, "events"), "event_id", n)


def shares_from_buckets(items: DataFrame, events: DataFrame) -> DataFrame:
    per = items.groupBy("event_id", "id").agg(F.sum("total_count").alias("company_sum"))
    return per.join(events, "event_id").withColumn("share", F.col("company_sum") / F.col("event_sum"))


@query("bucketed_shares", audit.sql("""
SELECT event_id, id, CAST(SUM(total_count) AS BIGINT) AS company_sum,
       CAST(SUM(SUM(total_count)) OVER (PARTITION BY event_id) AS BIGINT) AS event_sum,
       round(SUM(total_count) / CAST(SUM(SUM(total_count)) OVER (PARTITION BY event_id) AS DOUBLE), 6) AS share
FROM proc GROUP BY event_id, id""", _PROC_SQL))
def q_bucketed_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S5 + J1 + A22: shares per event from bucketed stage tables; neither the group-by nor the join moves a row."""
    return shares_from_buckets(*bucketed_shares(spark, sf_dir)).withColumn("share", F.round("share", OUT_DIGITS))


@query("bucketed_year", audit.sql("""
SELECT id, COUNT(*) AS n, CAST(SUM(total_count) AS BIGINT) AS total_count FROM proc WHERE year = 1995 GROUP BY id""", _PROC_SQL))
def q_bucketed_year(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S5 + F4: one year of the bucketed items; only that year's folder is read."""
    items, _ = bucketed_shares(spark, sf_dir)
    return items.where(F.col("year") == 1995).groupBy("id").agg(F.count(F.lit(1)).alias("n"), F.sum("total_count").alias("total_count"))


# ------------------------------------------------------------------ checks


@query("checked_write", audit.sql("\nUNION ALL ".join(
    _status_sql(r, f"COUNT(*) FILTER (WHERE NOT ({p}))", f"COUNT(*) FILTER (WHERE ({p}) IS NULL)", "proc")
    for r, p in checks.ROW_RULES), _PROC_SQL))
def q_checked_write(spark: SparkSession, sf_dir: str) -> DataFrame:
    """L7 + S5: the row rules counted by the job that writes the cleaned table."""
    _, rows = checks.write_checked(processed(Tables(spark, sf_dir)), lambda df: csv.write_stage(
        df, _folder(spark, "raw_processed_data"), ["year"]))
    return rows


# The reference's control total of the old key, which it expects to differ by now.
OLD_KEY_TOTAL = 681918


@query("control_totals", audit.sql(f"""
SELECT rule, CASE WHEN total = expected THEN 'PASS' ELSE 'FAIL' END AS status, total, expected FROM (
  SELECT 'V2_old_key' AS rule, CAST(SUM(p_size) AS DOUBLE) AS total, {OLD_KEY_TOTAL}.0 AS expected FROM part
  UNION ALL SELECT 'V2_key_review', CAST(SUM(p_size) AS DOUBLE), CAST(SUM(p_size) AS DOUBLE) FROM part
  UNION ALL SELECT 'V3_resolved', CAST(SUM(total_count) AS DOUBLE), CAST(SUM(total_count) AS DOUBLE) FROM clean
  UNION ALL SELECT 'V5_processed', CAST(SUM(total_count) AS DOUBLE), CAST(SUM(total_count) AS DOUBLE) FROM clean)"""))
def q_control_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V2, V3, V5: the old key's total against the stated number, and totals that each stage must carry on."""
    t = Tables(spark, sf_dir)
    key, clean = _key_table(t), audit.clean_items(t)
    proc = processed(t)
    whole = clean.agg(F.sum("total_count").alias("expected"))
    return checks.control_totals([
        ("V2_old_key", key, "sum", OLD_KEY_TOTAL),
        ("V2_key_review", brand_key_review(key, proc), "sum", key.agg(F.sum("sum").alias("expected"))),
        ("V3_resolved", brand_company_table(proc), "brand_total_count", whole),
        ("V5_processed", proc, "total_count", whole)])


# Columns of the full cleaned table that the view lacks, as text with values of a wrong type among them; the same
# text in both engines.
_SID, _YEAR = "CAST({} AS STRING)", "CAST(year AS STRING)"
_MORE = {
    "item_description": "brand_name || ' item'",
    "name_of_lead": f"CASE WHEN submission_id % 11 = 0 THEN 'lead' ELSE {_SID.format('submission_id % 97')} END",
    "is_trained": "CASE submission_id % 3 WHEN 0 THEN 'yes' WHEN 1 THEN 'no' END",
    "organization": _SID.format("submission_id % 13"),
    "volunteer": f"CASE WHEN submission_id % 17 = 0 THEN 'many' ELSE {_SID.format('submission_id % 40')} END",
    "start_of_audit": f"CASE WHEN submission_id % 5 = 0 THEN 'unknown' ELSE {_YEAR} || '-03-0' || {_SID.format('submission_id % 9 + 1')} END",
    "end_of_audit": f"{_YEAR} || '-04-0' || {_SID.format('submission_id % 9 + 1')}",
    "type_of_audit": "'outdoor'",
}
_ALL_TYPES = T.StructType([T.StructField(n, k) for k, names in (
    (T.StringType(), ("brand_name", "parent_company_name", "id", "validated", "submission_type", "item_description", "type_product",
                      "type_material", "layer", "is_trained", "city", "province", "country", "continent", "type_of_audit",
                      "specifics_of_audit", "event_id", "location_specificity")),
    (T.LongType(), ("submission_id", "total_count", "event_total_count")),
    (T.IntegerType(), ("year", "name_of_lead", "organization", "volunteer")),
    (T.DateType(), ("start_of_audit", "end_of_audit")),
    (T.DoubleType(), ("proportion", "longitude_most_specific", "latitude_most_specific"))) for n in names])
_SQL_TYPES = {"string": "VARCHAR", "bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "date": "DATE"}


@query("type_checks_full", audit.sql("\nUNION ALL ".join(
    f"SELECT '{f.name}' AS \"column\", '{f.dataType.simpleString()}' AS expected, "
    f"COUNT(*) FILTER (WHERE {f.name} IS NOT NULL AND TRY_CAST(CAST({f.name} AS VARCHAR) AS "
    f"{_SQL_TYPES[f.dataType.simpleString()]}) IS NULL) AS n_bad FROM whole" for f in _ALL_TYPES.fields), _PROC_SQL, *_LOC_SQL,
    ("whole", f"""SELECT p.*, {', '.join(f'{e} AS {c}' for c, e in _MORE.items())}, l.* EXCLUDE (event_id)
                  FROM proc p LEFT JOIN locs l ON l.event_id = p.event_id""")))
def q_type_checks_full(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every one of the 29 type assertions (is_trained stands twice in them), and two columns more."""
    proc = processed(Tables(spark, sf_dir))
    whole = proc.selectExpr("*", *[f"{e} AS {c}" for c, e in _MORE.items()]).join(event_locations(spark, sf_dir), "event_id", "left")
    return checks.check_types(whole, _ALL_TYPES)


# ------------------------------------------------------------------ malformed records

_LINE = T.StructType([T.StructField("submission_id", T.LongType()), T.StructField("city", T.StringType()),
                      T.StructField("year", T.IntegerType()), T.StructField("country", T.StringType()),
                      T.StructField("province", T.StringType()), T.StructField("event_total_count", T.LongType()),
                      T.StructField("specifics_of_audit", T.StringType())])
# What each line holds, by the last digit of its submission: commas that nobody quoted in one text (0), in the last
# text (4) and in two (5), between two texts (1), a proper quoted text (2), a field too few (3), a number that is
# none (6), a quote without end (7).
_CITY = "CASE submission_id % 10 WHEN 0 THEN city || ', north' WHEN 5 THEN city || ',old,town' ELSE city END"
_LAST = "CASE submission_id % 10 WHEN 4 THEN specifics_of_audit || ', wet, cold' WHEN 5 THEN specifics_of_audit || ',dry' ELSE specifics_of_audit END"
_HEAD = f"{_SID.format('submission_id')} || ','"
_REST = f"{_YEAR} || ',' || country || CASE WHEN submission_id % 10 = 1 THEN ', west' ELSE '' END || ',' || province || ','"
_RAW = (f"CASE submission_id % 10 "
        f"WHEN 2 THEN {_HEAD} || '\"' || city || ', \"\"new\"\"\",' || {_REST} || {_SID.format('event_total_count')} || ',' || specifics_of_audit "
        f"WHEN 3 THEN {_HEAD} || city || ',' || {_REST} || {_SID.format('event_total_count')} "
        f"WHEN 6 THEN {_HEAD} || city || ',' || {_REST} || 'few,many,' || specifics_of_audit "
        f"WHEN 7 THEN {_HEAD} || '\"' || city || ',' || {_REST} || {_SID.format('event_total_count')} || ',' || specifics_of_audit "
        f"ELSE {_HEAD} || {_CITY} || ',' || {_REST} || {_SID.format('event_total_count')} || ',' || {_LAST} END")
_LINE_COLS = ", ".join(_LINE.names)


@query("malformed_lines", audit.sql(f"""
SELECT CASE submission_id % 10 WHEN 1 THEN 'ambiguous' WHEN 3 THEN 'short' WHEN 6 THEN 'none' WHEN 7 THEN 'quotes' END AS outcome,
       CAST(NULL AS BIGINT) AS submission_id, CAST(NULL AS VARCHAR) AS city, CAST(NULL AS INTEGER) AS year,
       CAST(NULL AS VARCHAR) AS country, CAST(NULL AS VARCHAR) AS province, CAST(NULL AS BIGINT) AS event_total_count,
       CAST(NULL AS VARCHAR) AS specifics_of_audit, {_RAW} AS line
FROM ev WHERE submission_id % 10 IN (1, 3, 6, 7)
UNION ALL
SELECT CASE WHEN submission_id % 10 IN (0, 4, 5) THEN 'aligned' ELSE 'row' END, submission_id,
       CASE WHEN submission_id % 10 = 2 THEN city || ', "new"' ELSE {_CITY} END, year, country, province, event_total_count, {_LAST}, NULL
FROM ev WHERE submission_id % 10 NOT IN (1, 3, 6, 7)""", ("ev", f"SELECT DISTINCT {_LINE_COLS} FROM clean")))
def q_malformed_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A file with faulty lines of every kind; rows and mended rows, and the quarantined lines as they stood."""
    events = processed(Tables(spark, sf_dir)).select(*_LINE.names).distinct()
    path = _folder(spark, "faulty_csv")
    # One column named as the header, and no quoting: the lines go out as they are.
    lines = events.selectExpr(f"{_RAW} AS `{','.join(_LINE.names)}`")
    lines.write.option("header", True).option("sep", "\x01").option("quote", "").csv(path)
    rows, bad = malformed.read_aligned(spark, path, _LINE)
    return rows.unionByName(bad, allowMissingColumns=True)


# ------------------------------------------------------------------ profiles, exports and work-lists


@query("csv_index_roundtrip", audit.sql("""
SELECT CAST(row_number() OVER (ORDER BY event_id) AS BIGINT) AS "X", event_id, CASE WHEN length(event_id) % 3 > 0 THEN city ELSE '' END AS city,
       CASE WHEN length(event_id) % 2 = 0 THEN country END AS country, year
FROM (SELECT DISTINCT event_id, city, country, year FROM clean)""", _EL_SQL))
def q_csv_index_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S1 + S4: ``write.csv`` with row names, read by the ``base`` profile: the index comes back as X, NA as missing,
    blank text as blank."""
    el = event_list(processed(Tables(spark, sf_dir))).select("event_id", "city", "country", "year").distinct()
    el = el.selectExpr("event_id", "CASE WHEN length(event_id) % 3 > 0 THEN city ELSE '' END AS city",
                       "CASE WHEN length(event_id) % 2 = 0 THEN country END AS country", "year")
    path = _folder(spark, "write_csv")
    csv.write_csv(el, path, row_names=["event_id"])
    back = csv.read_csv(spark, path, profile="base")
    return back.withColumns({"X": F.col("X").try_cast("bigint"), "year": F.col("year").try_cast("int")})


_ACCENTED = "country || ' é ' || chr(223) || chr(241)"


@query("csv_encodings", audit.sql(f"""
SELECT e.encoding, c.country, {_ACCENTED} AS spelled FROM (SELECT DISTINCT country FROM clean) c,
       (SELECT unnest(['UTF-8', 'ISO-8859-1']) AS encoding) e"""))
def q_csv_encodings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One table in two encodings, each read back as what it is."""
    names = processed(Tables(spark, sf_dir)).select("country").distinct().selectExpr("country", f"{_ACCENTED} AS spelled")
    out = None
    for encoding in ("UTF-8", "ISO-8859-1"):
        path = _folder(spark, "encoded")
        csv.write_csv(names, path, encoding=encoding)
        one = csv.read_csv(spark, path, encoding=encoding).select(F.lit(encoding).alias("encoding"), "country", "spelled")
        out = one if out is None else out.unionByName(one)
    return out


@query("todo_export", audit.sql("""
SELECT brand_name, brand_total_count, brand_frequency FROM (
  SELECT brand_name || ' ' || CAST(p_partkey AS VARCHAR) AS brand_name, validated, CAST(SUM(total_count) AS BIGINT) AS brand_total_count,
         COUNT(*) AS brand_frequency FROM clean GROUP BY brand_name, p_partkey, validated)
WHERE brand_frequency > 10 AND brand_total_count > 100 AND validated = 'false'"""))
def q_todo_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S7 + L5: the brands that need review, written out and read back; each part is a brand, so some stay below either
    threshold and some have another status."""
    items = audit.clean_items(Tables(spark, sf_dir))
    items = items.withColumn("brand_name", F.concat_ws(" ", "brand_name", F.col("p_partkey").cast("string")))
    table = brand_company_table(items)
    todo = table.filter((F.col("brand_frequency") > 10) & (F.col("validated") == "false") & (F.col("brand_total_count") > 100))
    path = _folder(spark, "todo")
    csv.write_csv(todo, path)
    back = csv.read_csv(spark, path, schema=T.StructType([T.StructField(c, T.StringType()) for c in todo.columns]))
    return back.select("brand_name", *[F.col(c).try_cast("bigint").alias(c) for c in ("brand_total_count", "brand_frequency")])


@query("location_worklist", audit.sql("""
SELECT DISTINCT i.city, i.province, i.country, i.continent
FROM (SELECT DISTINCT CASE WHEN submission_id % 50 = 0 THEN NULL ELSE replace(city, 'null', '') END AS city,
             replace(province, 'null', '') AS province, replace(country, 'null', '') AS country,
             replace(continent, 'null', '') AS continent FROM clean) i
WHERE NOT EXISTS (SELECT 1 FROM gaz g WHERE length(g.country) % 2 = 0 AND g.city IS NOT DISTINCT FROM i.city
  AND g.province IS NOT DISTINCT FROM i.province AND g.country IS NOT DISTINCT FROM i.country
  AND g.continent IS NOT DISTINCT FROM i.continent)""", _GAZ_SQL))
def q_location_worklist(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Locations, some without a city, that a gazetteer of some countries does not hold."""
    t = Tables(spark, sf_dir)
    items = audit.clean_items(t).withColumn("city", F.when(F.col("submission_id") % 50 != 0, F.col("city")))
    return resolve.location_worklist(items, gazetteer(t).where(F.length("country") % 2 == 0), LOC_KEYS)


# ------------------------------------------------------------------ file order

_FILE_COLS = ["submission_id", "p_partkey", "brand_name", "country", "total_count", "type_material"]
_FILE_KEY = "submission_id, p_partkey, total_count, type_material"


def items_in_file_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The items as files whose order is that of their submissions, read with their place in them."""
    items = audit.clean_items(Tables(spark, sf_dir)).select(*_FILE_COLS)
    path = _folder(spark, "items_csv")
    keys = ["submission_id", "p_partkey", "total_count", "type_material"]
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    csv.write_csv(items.repartitionByRange(n, *keys).sortWithinPartitions(*keys), path)
    schema = T.StructType([T.StructField(c, T.StringType()) for c in _FILE_COLS])
    scan = order.with_file_order(spark.read.schema(schema).option("header", True).option("escape", '"').csv(path))
    return scan.withColumns({c: F.col(c).cast("bigint") for c in ("submission_id", "p_partkey", "total_count")})


def dealt_anew(x: DataFrame, col_name: str) -> DataFrame:
    """The rows dealt out by a column. Its few values must not decide how much a task holds: a partition of many
    rows is split by what the shuffle measures, and small ones are put together."""
    return x.hint("rebalance", col_name)


@query("first_in_file", audit.sql(f"""
SELECT brand_name, submission_id, p_partkey, country, total_count FROM (
  SELECT *, row_number() OVER (PARTITION BY brand_name ORDER BY {_FILE_KEY}) AS rn FROM clean) WHERE rn = 1"""))
def q_first_in_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P10 + W6: each brand's first row as the files have it, after the rows have been dealt out anew."""
    x = dealt_anew(items_in_file_order(spark, sf_dir).drop("type_material"), "country")
    return ordered.first_per_key(x, ["brand_name"], ["_order"]).drop("_order")


@query("kept_duplicates", audit.sql(f"""
SELECT brand_name, CAST((rn - 1) // 40 AS INTEGER) AS part, CAST(COUNT(*) AS INTEGER) AS n, string_agg(country, ', ' ORDER BY rn) AS country FROM (
  SELECT brand_name, country, row_number() OVER (PARTITION BY brand_name ORDER BY {_FILE_KEY}) AS rn FROM clean)
GROUP BY brand_name, (rn - 1) // 40"""))
def q_kept_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A4 + A6: each brand's countries once per item in file order, in parts of 40."""
    x = dealt_anew(items_in_file_order(spark, sf_dir), "total_count")
    return order.to_string_parts(x, ["brand_name"], "country", [F.col("_order")], "country", most=40)


# ------------------------------------------------------------------ sketches

_DISTINCT = ["event_id", "brand_name", "id", "city", "country", "layer"]
_QUANTILE = ["total_count", "event_total_count", "proportion"]
_PROBS = [0.025, 0.25, 0.5, 0.75, 0.975]
#: Rank error that the quantile sketches are held to (their own bound is 0.0165).
RANK_ERROR = 0.02


def _two_runs(spark: SparkSession, sf_dir: str, make) -> tuple[DataFrame, DataFrame]:
    """The cleaned items, and sketches per year of which one run has stored the years before 1995 and a later one the rest."""
    store = Store(spark, _folder(spark, "sketches"))
    items = ordered.materialize(processed(Tables(spark, sf_dir)))
    with store.begin() as run:
        run.write("old", make(items.where(F.col("year") < 1995)))
    with store.begin() as run:
        run.write("new", make(items.where(F.col("year") >= 1995)))
    return items, store.read("old").unionByName(store.read("new"))


@query("distinct_sketches", audit.sql("\nUNION ALL ".join(
    f"SELECT '{c}' AS \"column\", COUNT(DISTINCT {c}) + MAX(CAST({c} IS NULL AS INTEGER)) AS n_exact, true AS within FROM proc"
    for c in _DISTINCT), _PROC_SQL))
def q_distinct_sketches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct counts from the sketches of each year, united across two runs, within three standard errors of the exact
    ones beside them."""
    items, kept = _two_runs(spark, sf_dir, lambda df: sketches.distinct_sketches(df, ["year"], _DISTINCT))
    exact = aggregates.distinct_counts(items, _DISTINCT).withColumnRenamed("n_distinct", "n_exact")
    error = F.abs(F.col("n_distinct") - F.col("n_exact"))
    return exact.join(sketches.distinct_of(kept), "column").select(
        "column", F.col("n_exact").cast("bigint").alias("n_exact"),
        (error <= F.ceil(F.col("n_exact") * sketches.distinct_error())).alias("within"))


@query("quantile_sketches", audit.sql("\nUNION ALL ".join(
    f"SELECT '{c}' AS \"column\", CAST({p} AS DOUBLE) AS p, round(quantile_cont(CAST({c} AS DOUBLE), {p}), 6) AS exact, true AS within FROM proc"
    for c in _QUANTILE for p in _PROBS), _PROC_SQL))
def q_quantile_sketches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A16 + A18: quantiles from the sketches of each year, united across two runs. Beside them the exact type-7 ones, and
    whether p lies between the shares of rows below and not above the sketch's value, give or take 0.02."""
    items, kept = _two_runs(spark, sf_dir, lambda df: sketches.quantile_sketches(df, ["year"], _QUANTILE))
    found = ordered.materialize(sketches.quantiles_of(kept, _PROBS))
    values = {(r["column"], r["p"]): r["value"] for r in found.collect()}  # one row a column and p
    out = None
    for c in _QUANTILE:
        x = F.col(c).cast("double")
        exact = aggregates.exact_quantiles(items, c, _PROBS)
        sides = items.agg(F.count(x).alias("n"), *[F.count_if(x < values[c, p]).alias(f"b{i}") for i, p in enumerate(_PROBS)],
                          *[F.count_if(x <= values[c, p]).alias(f"u{i}") for i, p in enumerate(_PROBS)])
        rows = F.array(*[F.struct(F.lit(c).alias("column"), F.lit(p).alias("p"), F.round(f"q{i}", OUT_DIGITS).alias("exact"),
                                  ((F.col(f"b{i}") / F.col("n") <= p + RANK_ERROR) & (F.col(f"u{i}") / F.col("n") >= p - RANK_ERROR))
                                  .alias("within")) for i, p in enumerate(_PROBS)])
        one = ordered.attach_scalar(exact, sides).select(F.explode(rows).alias("r")).select("r.*")
        out = one if out is None else out.unionByName(one)
    return out
