"""The user-level pipelines on raw tables.

Each query builds tables of the reference's raw shape from the given tables,
with the faults the pipeline has to mend, and runs the pipeline as a user would."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from auditspark.functions import recode
from auditspark.plans import audit, pipelines
from auditspark.plans.queries.attribution import _RANK_SQL, _boot_sql
from auditspark.plans.queries.brands import PROCESSED_COLS, _company_labels, _keyed, _KEYED_SQL, processed
from auditspark.plans.queries.location import LOC_KEYS, _GAZ_SQL, gazetteer
from auditspark.plans.registry import query
from auditspark.sources.tables import Tables

OUT_DIGITS = 6


def raw_tables(t: Tables) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Item, event and brand key tables as submitted: brand names in mixed case with blanks around
    them, events of other audit types among the outdoor ones, and brands without a key."""
    ev = audit.events_table(t)
    items = (t.lineitem.select("l_orderkey", "l_partkey", "l_quantity", "l_returnflag")
             .join(ev.select(*audit.EVENT_KEYS), F.col("l_orderkey") == F.col("submission_id"))
             .join(t.part.select("p_partkey", "p_name"), F.col("l_partkey") == F.col("p_partkey"))
             .select(*audit.EVENT_KEYS, F.concat(F.lit(" "), F.initcap("p_name"), F.lit("\t")).alias("brand_name"),
                     F.col("l_quantity").cast("bigint").alias("total_count"), F.col("l_returnflag").alias("file_name")))
    events = ev.select(*audit.EVENT_KEYS, F.col("event_total_count").alias("total_count"),
                       F.when(F.col("submission_id") % 7 == 0, F.lit("Indoor")).otherwise(F.lit("Outdoor"))
                       .alias("type_of_audit"))
    key = (t.part.groupBy(F.lower("p_name").alias("brand_name"))
           .agg(F.min(F.lower("p_brand")).alias("parent_company_name"), F.max("p_brand").alias("id"),
                F.count(F.lit(1)).alias("_n")).filter(F.col("_n") % 2 == 0).drop("_n"))
    return items, events, key


@query("ingest", audit.sql("""
SELECT b.submission_type, b.submission_id, b.year, lower(p.p_name) AS brand_name, k.parent_company_name, k.id,
       b.total_count, b.event_total_count, b.event_id, round(b.proportion, 6) AS proportion
FROM plaus b JOIN part p ON b.l_partkey = p.p_partkey
LEFT JOIN (SELECT lower(p_name) AS brand_name, min(lower(p_brand)) AS parent_company_name, max(p_brand) AS id
           FROM part GROUP BY 1 HAVING COUNT(*) % 2 = 0) k ON k.brand_name = lower(p.p_name)
WHERE b.submission_id % 7 <> 0"""))
def q_ingest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """L1: ``pipelines.ingest`` on raw item, event and brand key tables."""
    out = pipelines.ingest(*raw_tables(Tables(spark, sf_dir)))
    return out.select(*audit.EVENT_KEYS, "brand_name", "parent_company_name", "id", "total_count", "event_total_count",
                      "event_id", F.round("proportion", OUT_DIGITS).alias("proportion"))


def _pick(number: str, values: list[str]) -> str:
    """One of ``values`` by a number, NULL beyond them; the same text in both engines."""
    return (f"CASE {number} % {len(values) + 1} "
            + " ".join(f"WHEN {i} THEN '{v}'" for i, v in enumerate(values)) + " END")


_DIRTY = {
    "type_product": _pick("l_partkey", [f" {c.upper()}" for c in recode.PRODUCT_CODES] + ["Unheard of "]),
    "type_material": _pick("l_orderkey", [f"{c.title()}\t" for c in recode.MATERIAL_CODES] + ["PET", " hdpe"]),
    "layer": _pick("(l_partkey + l_orderkey)", [f"{c.upper()} " for c in recode.LAYER_CODES] + ["Unsure"]),
    "is_trained": _pick("l_partkey", [f" {v.title()}" for v in recode.IS_TRAINED_BAD] + ["Yes", "no "]),
    "specifics_of_audit": _pick("(l_partkey + 3 * l_orderkey)", [f"{s.title()} " for s in recode.surroundings_map()]),
    "country": _pick("l_orderkey", [f" {c.title()}" for c in recode.COUNTRY_FIXES] + ["KENYA"]),
}


def _recode_sql(col: str, mapping: dict[str, str]) -> str:
    text = f"lower(trim({_DIRTY[col]}, ' ' || chr(9) || chr(13) || chr(10)))"
    return f"CASE {text} " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in mapping.items()) + f" ELSE {text} END AS {col}"


@query("normalize", f"""
SELECT l_orderkey, l_partkey, {_recode_sql('type_product', recode.PRODUCT_CODES)},
  {_recode_sql('type_material', recode.MATERIAL_CODES)}, {_recode_sql('layer', recode.LAYER_CODES)},
  {_recode_sql('is_trained', {v: 'null' for v in recode.IS_TRAINED_BAD})},
  {_recode_sql('specifics_of_audit', recode.surroundings_map())},
  {_recode_sql('country', {'united kingdom': recode.COUNTRY_FIXES['united kingdom']})},
  CASE WHEN CAST(l_quantity AS DOUBLE) - 10 > 0 THEN CAST(l_quantity AS DOUBLE) - 10 END AS time_spent
FROM lineitem""")
def q_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    """L3 + C22-C25: ``pipelines.normalize`` on every spelling that it recodes."""
    raw = Tables(spark, sf_dir).lineitem.selectExpr(
        "l_orderkey", "l_partkey", *[f"{e} AS {c}" for c, e in _DIRTY.items()],
        "CAST(l_quantity AS DOUBLE) - 10 AS time_spent")
    return pipelines.normalize(raw)


_TEXT = ["brand_name", "validated", "submission_type", "type_product", "type_material", "layer",
         "specifics_of_audit", "event_id", "id", "parent_company_name", *LOC_KEYS, "location_specificity"]
_ENRICHED = [c for c in PROCESSED_COLS if c not in ("total_count", "proportion")] + [
    "start_of_audit", "longitude_most_specific", "latitude_most_specific", "location_specificity"]


def _enriched_sql(col: str) -> str:
    if col == "country":
        return "CASE country WHEN 'korea' THEN 'south korea' WHEN 'null' THEN NULL WHEN '' THEN NULL ELSE country END AS country"
    return f"nullif(nullif({col}, 'null'), '') AS {col}" if col in _TEXT else col


@query("enrich", audit.sql(f"""
SELECT {', '.join(_enriched_sql(c) for c in _ENRICHED)}, CAST(total AS BIGINT) AS total_count,
       round(total / CAST(event_total_count AS DOUBLE), 6) AS proportion
FROM (SELECT {', '.join(_ENRICHED)}, SUM(total_count) AS total FROM enriched GROUP BY ALL)""", _KEYED_SQL, _GAZ_SQL,
    ("torn", """
    SELECT brand_name FROM keyed GROUP BY brand_name
    HAVING COUNT(DISTINCT validated) + MAX(CAST(validated IS NULL AS INTEGER)) > 1"""),
    ("named", """
    SELECT DISTINCT 'q' || CAST(CAST(substr(p_brand, 7, 8) AS INTEGER) + 100 AS VARCHAR) AS id,
           'company ' || CAST(CAST(substr(p_brand, 7, 8) AS INTEGER) AS VARCHAR) AS name
    FROM part WHERE p_type = 'PROMO' AND p_size > 45"""),
    ("enriched", f"""
    SELECT k.* EXCLUDE (validated, parent_company_name, {', '.join(LOC_KEYS)}),
      {', '.join(f"replace(k.{c}, 'null', '') AS {c}" for c in LOC_KEYS)},
      CASE WHEN t.brand_name IS NOT NULL THEN 'false' ELSE k.validated END AS validated,
      COALESCE(l.name, k.parent_company_name) AS parent_company_name,
      CASE WHEN k.submission_id % 5 > 0
           THEN make_date(k.year, k.submission_id % 12 + 1, k.submission_id % 28 + 1) END AS start_of_audit,
      COALESCE(z.longitude_specific, z.longitude_state, z.longitude_country) AS longitude_most_specific,
      COALESCE(z.latitude_specific, z.latitude_state, z.latitude_country) AS latitude_most_specific,
      CASE WHEN latitude_specific IS NOT NULL THEN 'city' WHEN latitude_state IS NOT NULL THEN 'state'
           WHEN latitude_country IS NOT NULL THEN 'country' ELSE 'other' END AS location_specificity
    FROM keyed k LEFT JOIN torn t ON t.brand_name = k.brand_name LEFT JOIN named l ON l.id = k.id
    LEFT JOIN gaz z ON z.city = replace(k.city, 'null', '') AND z.province = replace(k.province, 'null', '')
      AND z.country = replace(k.country, 'null', '') AND z.continent = replace(k.continent, 'null', '')""")))
def q_enrich(spark: SparkSession, sf_dir: str) -> DataFrame:
    """L4: ``pipelines.enrich`` - conflicting statuses, locations, labels, dates and duplicate rows."""
    t = Tables(spark, sf_dir)
    day = F.col("submission_id")
    items = _keyed(t).withColumn("start_of_audit", F.when(day % 5 == 0, F.lit("unknown")).otherwise(F.concat_ws(
        "/", (day % 12 + 1).cast("string"), (day % 28 + 1).cast("string"), F.col("year").cast("string"))))
    out = pipelines.enrich(items, gazetteer(t), _company_labels(t))
    return out.select(*_ENRICHED, "total_count", F.round("proportion", OUT_DIGITS).alias("proportion"))


@query("attribute", audit.sql("""
SELECT c.id, c.high, c.mean, c.low, CAST(r.rank AS DOUBLE) AS rank, round(r.cumulative, 6) AS cumulative
FROM (SELECT g.id, round(quantile_cont(COALESCE(r.m, 0), 0.975), 6) AS high, round(MAX(mm.mean), 6) AS mean,
             round(quantile_cont(COALESCE(r.m, 0), 0.025), 6) AS low
      FROM (SELECT i.id, t.b FROM (SELECT DISTINCT id FROM bvals) i, range(1, 101) t(b)) g
      LEFT JOIN reps r ON r.id = g.id AND r.b = g.b JOIN means mm ON mm.id = g.id GROUP BY g.id) c
JOIN ranked r ON r.id = c.id""", *_RANK_SQL,
    *_boot_sql("SELECT event_id, id, proportion FROM shares", "proportion", True)))
def q_attribute(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``pipelines.attribute`` - means with bootstrap bounds, rank and running share."""
    out = pipelines.attribute(processed(Tables(spark, sf_dir)))
    return out.select("id", *[F.round(c, OUT_DIGITS).alias(c) for c in ("high", "mean", "low", "cumulative")],
                      F.col("rank").cast("double").alias("rank"))
