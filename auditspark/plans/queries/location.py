"""Location enrichment (C4, C18, C19, C29, J5, M7) against a gazetteer."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from auditspark.functions import rsem
from auditspark.operators import aggregates
from auditspark.operators.location import LOC_KEYS, best_location
from auditspark.plans import audit
from auditspark.plans.registry import query
from auditspark.sources.tables import Tables


def gazetteer(t: Tables) -> DataFrame:
    """``locations_to_code``: coordinates per distinct location at three levels
    (city, state, country), some levels missing. Built from customer, nation and
    region so it grows with them."""
    c = t.customer.select("c_mktsegment", "c_nationkey")
    n = t.nation.select("n_nationkey", "n_name", "n_regionkey")
    r = t.region.select("r_regionkey", "r_name")
    g = (c.join(n, c.c_nationkey == n.n_nationkey).join(r, n.n_regionkey == r.r_regionkey)
         .select(F.lower("c_mktsegment").alias("city"),
                 F.concat(F.lit("p"), (F.col("c_nationkey") % 3).cast("string")).alias("province"),
                 F.lower("n_name").alias("country"), F.lower("r_name").alias("continent"),
                 "n_nationkey", F.length("c_mktsegment").alias("_len"))
         .distinct())
    k, ln = F.col("n_nationkey"), F.col("_len")
    no_city = (k + ln) % 3 == 0
    g = g.select(
        *LOC_KEYS,
        F.when(no_city, F.lit(None)).otherwise(k * 3.0 - 40 + ln).alias("latitude_specific"),
        F.when(no_city, F.lit(None)).otherwise(k * 7.0 - 90 + ln).alias("longitude_specific"),
        F.when(k % 4 == 0, F.lit(None)).otherwise(k * 3.0 - 41).alias("latitude_state"),
        F.when(k % 4 == 0, F.lit(None)).otherwise(k * 7.0 - 91).alias("longitude_state"),
        F.when(k == 24, F.lit(None)).otherwise(k * 3.0 - 42).alias("latitude_country"),
        F.when(k == 24, F.lit(None)).otherwise(k * 7.0 - 92).alias("longitude_country"),
    )
    return g.withColumns({c: rsem.strip_token(c) for c in LOC_KEYS})


_GAZ_SQL = ("gaz", """
    SELECT replace(city, 'null', '') AS city, replace(province, 'null', '') AS province,
           replace(country, 'null', '') AS country, replace(continent, 'null', '') AS continent,
           CASE WHEN (k + ln) % 3 = 0 THEN NULL ELSE kd * 3 - 40 + ln END AS latitude_specific,
           CASE WHEN (k + ln) % 3 = 0 THEN NULL ELSE kd * 7 - 90 + ln END AS longitude_specific,
           CASE WHEN k % 4 = 0 THEN NULL ELSE kd * 3 - 41 END AS latitude_state,
           CASE WHEN k % 4 = 0 THEN NULL ELSE kd * 7 - 91 END AS longitude_state,
           CASE WHEN k = 24 THEN NULL ELSE kd * 3 - 42 END AS latitude_country,
           CASE WHEN k = 24 THEN NULL ELSE kd * 7 - 92 END AS longitude_country
    FROM (SELECT DISTINCT lower(g.c_mktsegment) AS city, 'p' || CAST(g.c_nationkey % 3 AS VARCHAR) AS province,
                 lower(g.n_name) AS country, lower(g.r_name) AS continent, g.c_nationkey AS k,
                 CAST(g.c_nationkey AS DOUBLE) AS kd,
                 length(g.c_mktsegment) AS ln FROM geo g)""")

_LOC_SQL = (_GAZ_SQL, ("loc", """
    SELECT i.event_id,
           COALESCE(z.longitude_specific, z.longitude_state, z.longitude_country) AS lon,
           COALESCE(z.latitude_specific, z.latitude_state, z.latitude_country) AS lat, z.*
    FROM (SELECT DISTINCT event_id, replace(city, 'null', '') AS city, replace(province, 'null', '') AS province,
                 replace(country, 'null', '') AS country, replace(continent, 'null', '') AS continent FROM clean) i
    LEFT JOIN gaz z ON i.city IS NOT DISTINCT FROM z.city AND i.province IS NOT DISTINCT FROM z.province
      AND i.country IS NOT DISTINCT FROM z.country AND i.continent IS NOT DISTINCT FROM z.continent"""),
    ("locs", """
    SELECT event_id, lon AS longitude_most_specific, lat AS latitude_most_specific,
      CASE WHEN lat = latitude_specific AND lon = longitude_specific THEN 'city'
           WHEN lat = latitude_state AND lon = longitude_state THEN 'state'
           WHEN lat = latitude_country AND lon = longitude_country THEN 'country' ELSE 'other' END
        AS location_specificity FROM loc"""))


def event_locations(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = Tables(spark, sf_dir)
    ev = audit.clean_items(t).select("event_id", *LOC_KEYS).distinct()
    return best_location(ev, gazetteer(t)).select(
        "event_id", "longitude_most_specific", "latitude_most_specific", "location_specificity")


@query("best_location", audit.sql("SELECT * FROM locs", *_LOC_SQL))
def q_best_location(spark: SparkSession, sf_dir: str) -> DataFrame:
    """C18 + C19 + J5: most specific coordinate of each event and its level."""
    return event_locations(spark, sf_dir)


@query("location_level", audit.sql("""
SELECT location_specificity, COUNT(*) AS n FROM (SELECT DISTINCT event_id, location_specificity FROM locs)
GROUP BY location_specificity""", *_LOC_SQL))
def q_location_level(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M7 + A15: events by location specificity."""
    ev = event_locations(spark, sf_dir).select("event_id", "location_specificity").distinct()
    return aggregates.freq_table(ev, "location_specificity")


@query("event_points", audit.sql("""
SELECT DISTINCT longitude_most_specific, latitude_most_specific, event_id,
       'POINT (' || longitude_most_specific || ' ' || latitude_most_specific || ')' AS wkt
FROM locs WHERE longitude_most_specific IS NOT NULL AND latitude_most_specific IS NOT NULL""", *_LOC_SQL))
def q_event_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct located events as EPSG:4326 points (lon/lat + WKT)."""
    loc = event_locations(spark, sf_dir)
    pts = (loc.select("longitude_most_specific", "latitude_most_specific", "event_id").distinct()
           .filter(~rsem.is_na("longitude_most_specific") & ~rsem.is_na("latitude_most_specific")))
    return pts.withColumn("wkt", F.concat(F.lit("POINT ("), F.col("longitude_most_specific").cast("string"), F.lit(" "),
                                          F.col("latitude_most_specific").cast("string"), F.lit(")")))
