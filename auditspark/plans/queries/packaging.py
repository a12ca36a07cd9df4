"""Packaging correlation (L9: J2, C1, C3, C17, A26) and dictionary resolution (L2)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from auditspark.functions import rsem
from auditspark.operators import joins, stats
from auditspark.plans import audit, pipelines
from auditspark.plans.queries.attribution import _SHARES_SQL, company_means
from auditspark.plans.queries.joins import _DICT_SQL, dictionary_lists
from auditspark.plans.queries.stats import _FIT_DOUBLES, _FIT_OUT, _fit_cols_sql, _fit_sql
from auditspark.plans.registry import query
from auditspark.sources.tables import Tables

# World plastic production (tonnes) used as the denominator.
WORLD_PLASTIC_MASS = 390_700_000
OUT_DIGITS = 6


def models() -> dict[str, tuple[F.Column, F.Column]]:
    """The two fits of L9: y and x."""
    return {"log10": (F.log10("mean"), F.log10("global_percent")), "raw": (F.col("mean"), F.col("mass"))}


def progress_report(t: Tables) -> DataFrame:
    """A company packaging report as published: company name, an upper-case
    entity ID and the packaging weight as text with thousands separators. Built
    per company (``p_brand``) from ``part``."""
    p = t.part
    g = p.groupBy("p_brand").agg(F.sum(F.col("p_retailprice") * F.col("p_size")).alias("_w"))
    return g.select(
        F.col("p_brand").alias("Company name"),
        F.concat(F.lit("Q"), (F.substring("p_brand", 7, 8).cast("int") + 100).cast("string")).alias("ID"),
        F.format_number(F.floor("_w").cast("bigint"), 0).alias("2021 total weight of new packaging (metric tonnes)"),
    )


def packaging(report: DataFrame, means: DataFrame) -> DataFrame:
    """Lower-case the report ID, inner join to the company
    means on ``ID = id`` (companies missing on either side drop out), parse the
    weight text and express it as a fraction of world production."""
    r = report.withColumn("ID", F.lower("ID"))
    j = joins.null_safe_join(r, means, {"ID": "id"}, "inner")
    mass = rsem.parse_number("2021 total weight of new packaging (metric tonnes)")
    return (j.withColumn("mass", mass)
            .withColumn("global_percent", F.col("mass") / F.lit(float(WORLD_PLASTIC_MASS))))


def _packaging(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = Tables(spark, sf_dir)
    return packaging(progress_report(t), company_means(spark, sf_dir))


_PACK_SQL = _SHARES_SQL + (
    ("report", """
    SELECT p_brand AS "Company name", 'Q' || CAST(CAST(substr(p_brand, 7, 8) AS INTEGER) + 100 AS VARCHAR) AS "ID",
           format('{:,}', CAST(floor(SUM(p_retailprice * p_size)) AS BIGINT)) AS w
    FROM part GROUP BY p_brand"""),
    ("pack", """
    SELECT lower(r."ID") AS "ID", r."Company name", m.mean,
           TRY_CAST(replace(r.w, ',', '') AS DOUBLE) AS mass,
           TRY_CAST(replace(r.w, ',', '') AS DOUBLE) / 390700000.0 AS global_percent
    FROM report r JOIN means m ON lower(r."ID") IS NOT DISTINCT FROM m.id"""),
)


@query("packaging_join", audit.sql("""
SELECT "ID", "Company name", round(mean, 6) AS mean, mass, round(global_percent, 12) AS global_percent
FROM pack""", *_PACK_SQL))
def q_packaging_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J2 + C1 + C3 + C17: packaging report joined to company means by id."""
    p = _packaging(spark, sf_dir)
    return p.select("ID", "Company name", F.round("mean", OUT_DIGITS).alias("mean"), "mass",
                    F.round("global_percent", 12).alias("global_percent"))


@query("packaging_regression", audit.sql(f"{_fit_cols_sql('model')} FROM m", *_PACK_SQL, (
    "m", f"""{_fit_sql('log10(mean)', 'log10(global_percent)', "'log10' AS model, ", src='pack')}
           UNION ALL {_fit_sql('mean', 'mass', "'raw' AS model, ", src='pack')}""")))
def q_packaging_regression(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A26 on L9: ``lm(log10(mean) ~ log10(global_percent))`` and ``lm(mean ~ mass)``."""
    p = _packaging(spark, sf_dir)
    out = stats.ols_models(p, models()).select("model", *_FIT_OUT)
    return out.withColumns({c: F.round(c, OUT_DIGITS) for c in _FIT_DOUBLES})


def _resolved(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = Tables(spark, sf_dir)
    base, todo1, todo2 = dictionary_lists(t)
    items = audit.clean_items(t).withColumn("brand_name", F.concat_ws(" ", "brand_name", "parent_company"))
    items = items.select("brand_name", "parent_company", "parent_company_name", "id", "total_count",
                         "event_total_count", "event_id")
    return pipelines.resolve_brands(base, [todo1, todo2], items)


@query("resolve_brands", "WITH " + ",\n".join(f"{n} AS ({q})" for n, q in _DICT_SQL) + ",\n" + """
dict AS (SELECT brand_name, parent_company_name, id, validated FROM (
  SELECT *, row_number() OVER (PARTITION BY brand_name ORDER BY source_rank, row_idx) AS rn FROM unioned)
  WHERE rn = 1),
""" + audit.ctes() + """,
items AS (SELECT brand_name || ' ' || parent_company AS brand_name, parent_company, total_count FROM clean),
r0 AS (SELECT i.brand_name, d.parent_company_name AS pcn, d.id AS id0, d.validated AS v, i.parent_company AS pc,
              i.total_count
       FROM dict d RIGHT JOIN items i ON d.brand_name IS NOT DISTINCT FROM i.brand_name),
r1 AS (SELECT *, COALESCE(v, 'false') AS v1, (pcn IS NULL AND pc = 'Unbranded') AS ub FROM r0),
r2 AS (SELECT *, CASE WHEN ub IS NULL THEN NULL WHEN ub THEN 'true' ELSE v1 END AS validated,
              CASE WHEN ub IS NULL THEN NULL WHEN ub THEN 'Unbranded' ELSE pcn END AS pcn2 FROM r1),
r3 AS (SELECT *, CASE WHEN pcn2 IS NULL THEN pc ELSE pcn2 END AS pcn3 FROM r2),
r4 AS (SELECT *, CASE WHEN pcn3 IS NULL THEN NULL WHEN pcn3 = 'NULL' THEN brand_name ELSE pcn3 END
              AS parent_company_name FROM r3),
r5 AS (SELECT *, CASE WHEN id0 = '' OR id0 IS NULL THEN parent_company_name ELSE id0 END AS id FROM r4)
SELECT validated, parent_company_name, id, COUNT(*) AS n, CAST(SUM(total_count) AS BIGINT) AS total_count
FROM r5 GROUP BY validated, parent_company_name, id""")
def q_resolve_brands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """L2 (U2 + P10 + J7 + C9 + C21): review lists override the dictionary, the
    first entry per brand is right-joined to the cleaned items and the fallback
    chain fills status, company and id; items per resolved company."""
    r = _resolved(spark, sf_dir)
    return (r.groupBy("validated", "parent_company_name", "id")
            .agg(F.count(F.lit(1)).alias("n"), F.sum("total_count").cast("bigint").alias("total_count")))
