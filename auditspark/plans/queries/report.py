"""Validation suite and report metrics."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from auditspark.functions import rsem
from auditspark.operators import aggregates, checks, shares
from auditspark.plans import audit
from auditspark.plans.queries.attribution import _SHARES_SQL
from auditspark.plans.queries.brands import PROCESSED_COLS, _BC_SQL, brand_company_table, processed
from auditspark.plans.queries.location import _LOC_SQL, event_locations
from auditspark.plans.registry import query
from auditspark.sources.tables import Tables

_PROC_SQL = ("proc", f"SELECT {', '.join(PROCESSED_COLS)} FROM clean")


def _status_sql(rule: str, bad: str, unknown: str, src: str) -> str:
    return (f"SELECT '{rule}' AS rule, CASE WHEN b > 0 THEN 'FAIL' WHEN u > 0 THEN 'UNKNOWN' ELSE 'PASS' END "
            f"AS status, b AS n_bad, u AS n_unknown FROM (SELECT {bad} AS b, {unknown} AS u FROM {src})")


def _checks_sql() -> str:
    parts = [_status_sql(r, f"COUNT(*) FILTER (WHERE NOT ({p}))", f"COUNT(*) FILTER (WHERE ({p}) IS NULL)", "proc")
             for r, p in checks.ROW_RULES]
    groups = [
        ("V15_event_shares_sum_to_one", "(SELECT event_id, SUM(proportion) AS s FROM proc GROUP BY event_id "
                                        "HAVING NOT (abs(SUM(proportion) - 1) < 0.0005) OR SUM(proportion) IS NULL)"),
        ("V31_no_duplicate_rows", f"(SELECT {', '.join(PROCESSED_COLS)} FROM proc GROUP BY ALL HAVING COUNT(*) > 1)"),
        ("V8_event_list_unique", "(SELECT event_id FROM (SELECT DISTINCT event_id, city, province, country, continent, "
                                 "year, specifics_of_audit, event_total_count FROM proc) GROUP BY event_id "
                                 "HAVING COUNT(*) > 1)"),
        ("V9_one_status_per_brand", "(SELECT brand_name FROM (SELECT DISTINCT brand_name, validated FROM proc) "
                                    "GROUP BY brand_name HAVING COUNT(*) > 1)"),
        ("V38_one_id_per_brand", "(SELECT brand_name FROM (SELECT DISTINCT brand_name, id FROM proc) "
                                 "GROUP BY brand_name HAVING COUNT(*) > 1)"),
    ]
    parts += [_status_sql(r, "COUNT(*)", "CAST(0 AS BIGINT)", src) for r, src in groups]
    return "\nUNION ALL ".join(parts)


@query("checks", audit.sql(_checks_sql(), _PROC_SQL))
def q_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Validation suite over the cleaned table - (rule, status, n_bad, n_unknown)."""
    return checks.check_all(processed(Tables(spark, sf_dir)))


# Event-level columns that the cleaned view lacks, with values that break each rule and NAs,
# derived from the length of the event id. The same text in both engines.
_EVENT_COLUMNS = {
    "is_trained": "CASE length(event_id) % 4 WHEN 0 THEN 'yes' WHEN 1 THEN 'no' WHEN 2 THEN 'maybe' END",
    "type_of_audit": "CASE length(event_id) % 5 WHEN 0 THEN 'indoor' WHEN 1 THEN NULL ELSE 'outdoor' END",
    "longitude_most_specific": "CASE WHEN length(event_id) % 7 = 0 THEN longitude_most_specific + 400 "
                               "ELSE longitude_most_specific END",
    "latitude_most_specific": "CASE WHEN length(event_id) % 3 = 0 THEN latitude_most_specific - 200 "
                              "ELSE latitude_most_specific END",
    "location_specificity": "CASE WHEN length(event_id) % 2 = 0 THEN location_specificity END",
    "validated": "CASE length(event_id) % 3 WHEN 0 THEN 'true' WHEN 1 THEN 'unheard of' END",
    "submission_type": "CASE length(event_id) % 3 WHEN 0 THEN '123Forms New' WHEN 1 THEN 'Fax' END",
}
_EVENT_RULES = ([(r, p) for r, _, p in checks.OPTIONAL_ROW_RULES]
                + [(r, p) for r, p in checks.ROW_RULES if r[:3] in ("V16", "V17")])


@query("event_checks", audit.sql("\nUNION ALL ".join(
    _status_sql(r, f"COUNT(*) FILTER (WHERE NOT ({p}))", f"COUNT(*) FILTER (WHERE ({p}) IS NULL)", "marked")
    for r, p in _EVENT_RULES), *_LOC_SQL,
    ("marked", f"SELECT event_id, {', '.join(f'{e} AS {c}' for c, e in _EVENT_COLUMNS.items())} FROM locs")))
def q_event_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V16, V17, V23, V24, V32-V34 on a view that breaks each of them and has NAs."""
    marked = event_locations(spark, sf_dir).selectExpr(
        "event_id", *[f"{e} AS {c}" for c, e in _EVENT_COLUMNS.items()])
    return checks.check_rows(marked, _EVENT_RULES)


# Declared types of the cleaned table (subset present in the view).
PROCESSED_TYPES = T.StructType([
    T.StructField("brand_name", T.StringType()), T.StructField("parent_company_name", T.StringType()),
    T.StructField("id", T.StringType()), T.StructField("validated", T.StringType()),
    T.StructField("submission_type", T.StringType()), T.StructField("submission_id", T.LongType()),
    T.StructField("year", T.IntegerType()), T.StructField("type_product", T.StringType()),
    T.StructField("type_material", T.StringType()), T.StructField("layer", T.StringType()),
    T.StructField("city", T.StringType()), T.StructField("province", T.StringType()),
    T.StructField("country", T.StringType()), T.StructField("continent", T.StringType()),
    T.StructField("specifics_of_audit", T.StringType()), T.StructField("event_total_count", T.LongType()),
    T.StructField("event_id", T.StringType()), T.StructField("total_count", T.LongType()),
    T.StructField("proportion", T.DoubleType()),
])


_SQL_TYPES = {"string": "VARCHAR", "bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE"}


@query("type_checks", audit.sql("\nUNION ALL ".join(
    f"SELECT '{f.name}' AS \"column\", '{f.dataType.simpleString()}' AS expected, "
    f"COUNT(*) FILTER (WHERE {f.name} IS NOT NULL AND TRY_CAST(CAST({f.name} AS VARCHAR) AS "
    f"{_SQL_TYPES[f.dataType.simpleString()]}) IS NULL) AS n_bad FROM proc" for f in PROCESSED_TYPES.fields), _PROC_SQL))
def q_type_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values of the cleaned table that do not read as their declared type."""
    return checks.check_types(processed(Tables(spark, sf_dir)), PROCESSED_TYPES)


_EVENT_LIST = ["event_id", "city", "province", "country", "continent", "year", "specifics_of_audit",
               "event_total_count"]


def event_list(items: DataFrame) -> DataFrame:
    """``event_list`` - one row per event with its attributes."""
    return items.select(*_EVENT_LIST).distinct()


_EL_SQL = ("el", f"SELECT DISTINCT {', '.join(_EVENT_LIST)} FROM clean")


@query("event_list", audit.sql("SELECT * FROM el", _EL_SQL))
def q_event_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """L6 + P8: ``event_list`` extract - one row per event with its attributes."""
    return event_list(processed(Tables(spark, sf_dir)))


@query("prop_id_event", audit.sql("SELECT event_id, id, round(proportion, 6) AS proportion FROM proc", _PROC_SQL))
def q_prop_id_event(spark: SparkSession, sf_dir: str) -> DataFrame:
    """L6 + P1: ``raw_prop_id_event`` extract - (event, company, share) per item."""
    return processed(Tables(spark, sf_dir)).select("event_id", "id", F.round("proportion", 6).alias("proportion"))


@query("stage_roundtrip", audit.sql(f"""
SELECT {', '.join(c for c in PROCESSED_COLS if c != 'proportion')}, round(proportion, 6) AS proportion
FROM proc""", _PROC_SQL))
def q_stage_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S5 + S6 + S10: the cleaned table written as a Parquet stage table
    partitioned by year into the shared stage folder, and read back."""
    import uuid

    from auditspark.sources import csv as csvio

    path = csvio.stage_path(spark, "raw_processed_data", uuid.uuid4().hex)
    back = csvio.write_stage(processed(Tables(spark, sf_dir)), path, partition_by=["year"])
    return back.select(*PROCESSED_COLS).withColumn("proportion", F.round("proportion", 6))


@query("events_per_year", audit.sql("SELECT year, COUNT(*) AS count FROM el GROUP BY year", _EL_SQL))
def q_events_per_year(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M1/A1: number of audits per year."""
    return aggregates.count_rows(event_list(processed(Tables(spark, sf_dir))), ["year"])


@query("events_per_country", audit.sql(r"""
SELECT country, array_to_string(list_transform(regexp_extract_all(country,
         '([\p{L}\p{N}''’]+|[^\p{L}\p{N}''’]+)', 1), lambda x: upper(x[1]) || lower(x[2:])), '') AS country_title,
       COUNT(*) AS count
FROM (SELECT DISTINCT event_id, country FROM el) GROUP BY country""", _EL_SQL))
def q_events_per_country(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M4/A1 + C7: audits per country, with the title-cased country name."""
    el = event_list(processed(Tables(spark, sf_dir))).select("event_id", "country").distinct()
    return (aggregates.count_rows(el, ["country"])
            .select("country", rsem.title_case("country").alias("country_title"), "count"))


@query("report_metrics", audit.sql("""
SELECT 'total_items' AS metric, CAST(SUM(total_count) AS DOUBLE) AS value FROM proc
UNION ALL SELECT 'branded_items', CAST(SUM(company_sum) AS DOUBLE) FROM shares
UNION ALL SELECT 'events_before', CAST(COUNT(*) AS DOUBLE) FROM el
UNION ALL SELECT 'events_after', CAST(COUNT(*) AS DOUBLE) FROM
  (SELECT DISTINCT event_id, city, province, country, continent, year, specifics_of_audit,
          event_total_count_no_unbrand FROM shares)
UNION ALL SELECT 'n_countries', CAST(COUNT(DISTINCT country) + MAX(CAST(country IS NULL AS INTEGER)) AS DOUBLE) FROM el
UNION ALL SELECT 'n_brands', CAST(COUNT(DISTINCT brand_name) AS DOUBLE) FROM proc
UNION ALL SELECT 'n_brand_rows', CAST(COUNT(*) AS DOUBLE) FROM bc
UNION ALL SELECT 'above_threshold', CAST(COUNT(*) FILTER (WHERE brand_total_count > 100 AND brand_frequency > 10)
  AS DOUBLE) FROM bc
UNION ALL SELECT 'assessed_below_threshold', CAST(COUNT(*) FILTER (WHERE brand_total_count <= 100
  AND brand_frequency <= 10 AND validated IN ('true', 'attempted')) AS DOUBLE) FROM bc
UNION ALL SELECT 'assessed_minus_above', CAST(COUNT(*) FILTER (WHERE validated IN ('true', 'attempted'))
  - COUNT(*) FILTER (WHERE brand_total_count > 100 AND brand_frequency > 10) AS DOUBLE) FROM bc
UNION ALL SELECT 'n_companies', CAST(COUNT(DISTINCT id) AS DOUBLE) FROM shares
UNION ALL SELECT 'grid_events', CAST(COUNT(DISTINCT event_id) AS DOUBLE) FROM shares
UNION ALL SELECT 'n_packaging_rows', CAST(COUNT(*) AS DOUBLE) FROM (SELECT DISTINCT id FROM shares) s
  JOIN (SELECT DISTINCT 'q' || CAST(CAST(substr(p_brand, 7, 8) AS INTEGER) + 100 AS VARCHAR) AS id FROM part) p ON p.id = s.id
UNION ALL SELECT 'unbranded_dominated', CAST(COUNT(*) FILTER (WHERE id = 'unbranded' AND proportion > 0.9)
  AS DOUBLE) FROM proc""", _PROC_SQL, _EL_SQL, *_BC_SQL,
    ("ev", """
    SELECT event_id, id, city, province, country, continent, year, specifics_of_audit,
           CAST(SUM(total_count) AS BIGINT) AS company_sum
    FROM clean WHERE id <> 'unbranded'
    GROUP BY event_id, id, city, province, country, continent, year, specifics_of_audit"""),
    ("shares", """
    SELECT *, CAST(SUM(company_sum) OVER (PARTITION BY event_id) AS BIGINT) AS event_total_count_no_unbrand
    FROM ev""")))
def q_report_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The numbers reported in the paper, one row each."""
    from auditspark.operators.ordered import materialize
    from auditspark.plans.queries.packaging import packaging, progress_report

    t = Tables(spark, sf_dir)
    proc = materialize(processed(t))
    sh = shares.event_company_shares(proc)
    el = event_list(proc)
    bc = brand_company_table(proc)
    above = (F.col("brand_total_count") > 100) & (F.col("brand_frequency") > 10)
    assessed = F.col("validated").isin("true", "attempted")
    below = (F.col("brand_total_count") <= 100) & (F.col("brand_frequency") <= 10) & assessed
    ev2 = sh.select("event_id", *shares.EVENT_ATTRS, "event_total_count_no_unbrand").distinct()
    # One aggregate per source table; each is unpivoted to (metric, value).
    parts = [
        _metrics(proc, {"total_items": F.sum("total_count"),
                        "n_brands": F.count_distinct("brand_name"),
                        "unbranded_dominated": F.count_if((F.col("id") == shares.UNBRANDED)
                                                          & (F.col("proportion") > 0.9))}),
        _metrics(sh, {"branded_items": F.sum("company_sum"), "n_companies": F.count_distinct("id"),
                      "grid_events": F.count_distinct("event_id")}),
        _metrics(el, {"events_before": F.count(F.lit(1)), "n_countries": rsem.n_distinct_na("country")}),
        _metrics(ev2, {"events_after": F.count(F.lit(1))}),
        _metrics(packaging(progress_report(t), sh.select("id").distinct()), {"n_packaging_rows": F.count(F.lit(1))}),
        _metrics(bc, {"n_brand_rows": F.count(F.lit(1)), "above_threshold": F.count_if(above),
                      "assessed_below_threshold": F.count_if(below),
                      "assessed_minus_above": F.count_if(assessed) - F.count_if(above)}),
    ]
    return reduce(lambda a, b: a.unionByName(b), parts)


def _metrics(df: DataFrame, named: dict[str, F.Column]) -> DataFrame:
    """Several metrics of one table in one aggregate, as (metric, value) rows."""
    one = df.agg(*[e.cast("double").alias(n) for n, e in named.items()])
    return one.unpivot([], list(named), "metric", "value")


@query("csv_roundtrip", audit.sql("SELECT * FROM el", _EL_SQL))
def q_csv_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S1 + S2 + S5: write the event list as CSV (``fwrite``) into the shared
    stage folder and read it back with the ``fast`` profile ."""
    import uuid

    from auditspark.sources import csv as csvio

    el = event_list(processed(Tables(spark, sf_dir)))
    path = csvio.stage_path(spark, "event_list_csv", uuid.uuid4().hex)
    csvio.write_csv(el, path)
    schema = T.StructType([T.StructField(c, T.StringType()) for c in el.columns])
    back = csvio.read_csv(spark, path, schema=schema, profile="fast")
    return back.withColumns({"year": F.col("year").try_cast("int"),
                             "event_total_count": F.col("event_total_count").try_cast("bigint")})


def _rule(name: str, n_bad: DataFrame) -> DataFrame:
    """One-row (rule, status, n_bad, n_unknown) from a one-row ``n_bad`` frame."""
    return n_bad.select(F.lit(name).alias("rule"),
                        F.when(F.col("n_bad") > 0, F.lit("FAIL")).otherwise(F.lit("PASS")).alias("status"),
                        F.col("n_bad").cast("bigint").alias("n_bad"), F.lit(0).cast("bigint").alias("n_unknown"))


_CONS_SQL = (_PROC_SQL, *_BC_SQL, *_SHARES_SQL)


@query("consistency_checks", audit.sql("""
SELECT 'V1_brands_equal_brand_rows' AS rule, CASE WHEN b > 0 THEN 'FAIL' ELSE 'PASS' END AS status,
       b AS n_bad, CAST(0 AS BIGINT) AS n_unknown
FROM (SELECT abs((SELECT COUNT(DISTINCT brand_name) FROM proc) - (SELECT COUNT(*) FROM bc)) AS b)
UNION ALL SELECT 'V3_V5_control_totals', CASE WHEN b > 0 THEN 'FAIL' ELSE 'PASS' END, b, CAST(0 AS BIGINT)
FROM (SELECT CAST((SELECT SUM(total_count) FROM clean) <> (SELECT SUM(total_count) FROM proc) AS BIGINT)
           + CAST((SELECT SUM(total_count) FROM clean) <> (SELECT SUM(brand_total_count) FROM bc) AS BIGINT) AS b)
UNION ALL SELECT 'V6_worklist_empty', CASE WHEN b > 0 THEN 'FAIL' ELSE 'PASS' END, b, CAST(0 AS BIGINT)
FROM (SELECT COUNT(*) AS b FROM bc WHERE brand_frequency > 10 AND validated = 'false' AND brand_total_count > 100)
UNION ALL SELECT 'V7_brand_unique_in_brand_table', CASE WHEN b > 0 THEN 'FAIL' ELSE 'PASS' END, b, CAST(0 AS BIGINT)
FROM (SELECT COUNT(*) AS b FROM (SELECT brand_name FROM bc GROUP BY brand_name HAVING COUNT(*) > 1))
UNION ALL SELECT 'V39_key_table_brand_unique', CASE WHEN b > 0 THEN 'FAIL' ELSE 'PASS' END, b, CAST(0 AS BIGINT)
FROM (SELECT COUNT(*) AS b FROM (SELECT p_name FROM part GROUP BY p_name HAVING COUNT(*) > 1))
UNION ALL SELECT 'V40_mean_shares_sum_to_one', CASE WHEN b > 0 THEN 'FAIL' ELSE 'PASS' END, b, CAST(0 AS BIGINT)
FROM (SELECT CAST(NOT (abs(SUM(mean) - 1) < 0.005) AS BIGINT) AS b FROM means)
UNION ALL SELECT 'V41_pooled_shares_sum_to_one', CASE WHEN b > 0 THEN 'FAIL' ELSE 'PASS' END, b, CAST(0 AS BIGINT)
FROM (SELECT CAST(NOT (abs(SUM(p) - 1) < 0.000001) AS BIGINT) AS b FROM (
  SELECT SUM(company_sum) / CAST(SUM(SUM(company_sum)) OVER () AS DOUBLE) AS p FROM shares GROUP BY id))""",
    *_CONS_SQL))
def q_consistency_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cross-table consistency of the stages -
    brand counts, control totals carried through every stage, empty work-list,
    unique brands in the brand and key tables, and shares that add to one."""
    from auditspark.operators.ordered import attach_scalar, materialize
    from auditspark.plans.queries.attribution import company_means, event_shares
    from auditspark.plans.queries.brands import _key_table

    t = Tables(spark, sf_dir)
    proc = materialize(processed(t))
    bc = brand_company_table(proc)
    clean_total = audit.clean_items(t).agg(F.sum("total_count").alias("c"))
    proc_total = proc.agg(F.sum("total_count").alias("p"))
    bc_total = bc.agg(F.sum("brand_total_count").alias("b"))
    totals = attach_scalar(attach_scalar(clean_total, proc_total), bc_total).select(
        ((F.col("c") != F.col("p")).cast("bigint") + (F.col("c") != F.col("b")).cast("bigint")).alias("n_bad"))
    n_brands = attach_scalar(proc.agg(F.count_distinct("brand_name").alias("a")),
                             bc.agg(F.count(F.lit(1)).alias("b")))
    worklist = bc.filter((F.col("brand_frequency") > 10) & (F.col("validated") == "false")
                         & (F.col("brand_total_count") > 100))
    dup_bc = aggregates.count_rows(bc, ["brand_name"]).filter(F.col("count") > 1)
    dup_key = aggregates.count_rows(_key_table(t), ["brand_name"]).filter(F.col("count") > 1)
    means = company_means(spark, sf_dir).agg(F.sum("mean").alias("s"))
    pooled = shares.pooled_share(event_shares(spark, sf_dir)).agg(F.sum("proportion_aggregated").alias("s"))
    parts = [
        _rule("V1_brands_equal_brand_rows", n_brands.select(F.abs(F.col("a") - F.col("b")).alias("n_bad"))),
        _rule("V3_V5_control_totals", totals),
        _rule("V6_worklist_empty", worklist.agg(F.count(F.lit(1)).alias("n_bad"))),
        _rule("V7_brand_unique_in_brand_table", dup_bc.agg(F.count(F.lit(1)).alias("n_bad"))),
        _rule("V39_key_table_brand_unique", dup_key.agg(F.count(F.lit(1)).alias("n_bad"))),
        _rule("V40_mean_shares_sum_to_one", means.select((~(F.abs(F.col("s") - 1) < 0.005)).cast("bigint")
                                                         .alias("n_bad"))),
        _rule("V41_pooled_shares_sum_to_one", pooled.select((~(F.abs(F.col("s") - 1) < 1e-6)).cast("bigint")
                                                            .alias("n_bad"))),
    ]
    return reduce(lambda a, b: a.unionByName(b), parts)
