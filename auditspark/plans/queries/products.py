"""Products (company and brand) as the unit: the top list and the whole of L9 on an id with many values.

The company ids of the audit view are two dozen, too few for a filter or a sector to show anything. Here
an id is ``company id/brand``, so the top list cuts, the floor drops, and each sector has a fit of its own.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from auditspark.functions import rsem
from auditspark.operators import aggregates, ordered, shares, stats
from auditspark.plans import audit
from auditspark.plans.queries.attribution import _SHARES_SQL, OUT_DIGITS, TIE_DIGITS
from auditspark.plans.queries.packaging import models, packaging
from auditspark.plans.queries.stats import (_FIT_DOUBLES, _FIT_OUT, _T_CRIT_SQL, SECTOR_LEVELS, _fit_cols_sql,
                                            _fit_sql, _r6, hist_sql)
from auditspark.plans.registry import query
from auditspark.sources.tables import Tables

#: Mean share above which a product is listed.
FLOOR = 0.002
TOP = 100
# Axis limits of the packaging plot, in percent.
X_LIMITS = (0.0001, 10.0)
Y_LIMITS = (0.000001, 100.0)
# Raw sectors shown as food and beverage; the others are household and retail.
FOOD_SECTORS = ("beverages", "food")

_PRODUCT_SQL = (
    ("products", """
    SELECT * REPLACE (id || '/' || brand_name AS id) FROM clean WHERE id <> 'unbranded'"""),
    (_SHARES_SQL[0][0], _SHARES_SQL[0][1].replace("FROM clean", "FROM products")),
    *_SHARES_SQL[1:],
)


def product_items(t: Tables) -> DataFrame:
    """Branded items that pass L1, under their product's id."""
    items = audit.clean_items(t).filter(F.col("id") != shares.UNBRANDED)
    return items.withColumn("id", F.concat_ws("/", "id", "brand_name"))


def product_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shares.zero_filled_mean(shares.event_company_shares(product_items(Tables(spark, sf_dir))))


def _title_sql(c: str) -> str:
    return (f"array_to_string(list_transform(regexp_extract_all({c}, "
            r"'([\p{L}\p{N}''’]+|[^\p{L}\p{N}''’]+)', 1), lambda x: upper(x[1]) || lower(x[2:])), '')")


@query("top_products", audit.sql(f"""
SELECT id, round(mean, 6) AS mean, rank, mean > {FLOOR} AS above_floor,
       CASE WHEN mean > {FLOOR} THEN {_title_sql('id')} END AS label
FROM (SELECT id, mean, CAST(rank() OVER (ORDER BY round(mean, 10) DESC) AS BIGINT) AS rank FROM means)
WHERE rank <= {TOP}""", *_PRODUCT_SQL))
def q_top_products(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O2 + O6 + C7: the 100 products of the largest mean share, ties kept; those above the floor get the
    title-cased label that the chart shows."""
    m = product_means(spark, sf_dir).withColumn("_mk", F.round("mean", TIE_DIGITS))
    above = F.col("mean") > FLOOR
    return ordered.top_with_ties(m, "_mk", TOP).select(
        "id", F.round("mean", OUT_DIGITS).alias("mean"), "rank", above.alias("above_floor"),
        F.when(above, rsem.title_case(F.col("id"))).alias("label"))


def product_report(t: Tables) -> DataFrame:
    """A packaging report per product: name, upper-case id, raw sector and the weight as text."""
    g = t.part.groupBy("p_brand", "p_name").agg(F.sum(F.col("p_retailprice") * F.col("p_size") / 10).alias("_w"),
                                                F.min("p_type").alias("_t"))
    number = (F.substring("p_brand", 7, 8).cast("int") + 100).cast("string")
    sector = (F.when(F.col("_t") == "ECONOMY", "food").when(F.col("_t") == "PROMO", "beverages")
              .otherwise(F.lower("_t")))
    return g.select(
        F.concat_ws(" ", "p_brand", "p_name").alias("Company name"),
        F.upper(F.concat(F.lit("q"), number, F.lit("/"), "p_name")).alias("ID"), sector.alias("Sector"),
        F.format_number(F.floor("_w").cast("bigint"), 0).alias("2021 total weight of new packaging (metric tonnes)"))


def product_packaging(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The packaging table of products: mean share, mass and the mass's share of the world's."""
    return packaging(product_report(Tables(spark, sf_dir)), product_means(spark, sf_dir))


def sector() -> F.Column:
    return (F.when(F.col("Sector").isin(*FOOD_SECTORS), F.lit(SECTOR_LEVELS[0])).otherwise(F.lit(SECTOR_LEVELS[2])))


def within_limits(p: DataFrame) -> DataFrame:
    """sector, x and y (both in percent) of the points that the plot's axes hold."""
    return (p.select(sector().alias("sector"), (F.col("global_percent") * 100).alias("x"),
                     (F.col("mean") * 100).alias("y"))
            .filter(F.col("x").between(*X_LIMITS) & F.col("y").between(*Y_LIMITS)))


_PACK_SQL = _PRODUCT_SQL + (
    ("report", """
    SELECT p_brand || ' ' || p_name AS "Company name",
           upper('q' || CAST(CAST(substr(p_brand, 7, 8) AS INTEGER) + 100 AS VARCHAR) || '/' || p_name) AS "ID",
           CASE min(p_type) WHEN 'ECONOMY' THEN 'food' WHEN 'PROMO' THEN 'beverages' ELSE lower(min(p_type)) END AS "Sector",
           CAST(floor(SUM(p_retailprice * p_size / 10)) AS BIGINT) AS w
    FROM part GROUP BY p_brand, p_name"""),
    ("pack", """
    SELECT m.id AS "ID", r."Company name", r."Sector", m.mean, CAST(r.w AS DOUBLE) AS mass,
           CAST(r.w AS DOUBLE) / 390700000.0 AS global_percent
    FROM report r JOIN means m ON lower(r."ID") = m.id"""),
    ("pts", f"""
    SELECT * FROM (SELECT CASE WHEN "Sector" IN {FOOD_SECTORS} THEN '{SECTOR_LEVELS[0]}' ELSE '{SECTOR_LEVELS[2]}' END AS sector,
                          global_percent * 100 AS x, mean * 100 AS y FROM pack)
    WHERE x BETWEEN {X_LIMITS[0]} AND {X_LIMITS[1]} AND y BETWEEN {Y_LIMITS[0]} AND {Y_LIMITS[1]}"""),
    ("m", f"""{_fit_sql('log10(y)', 'log10(x)', src='pts', group='sector')} GROUP BY sector
           UNION ALL SELECT '{SECTOR_LEVELS[1]}' AS sector, * FROM ({_fit_sql('log10(y)', 'log10(x)', src='pts')})"""),
)


@query("product_packaging", audit.sql("""
SELECT "ID", "Company name", "Sector", round(mean, 6) AS mean, mass, round(global_percent * 100, 10) AS percent_of_mass,
       global_percent * 100 BETWEEN 0.0001 AND 10 AND mean * 100 BETWEEN 0.000001 AND 100 AS shown
FROM pack""", *_PACK_SQL))
def q_product_packaging(spark: SparkSession, sf_dir: str) -> DataFrame:
    """L9's table per product: J2 + C1 + C3 + C17, and whether the plot's axes hold the point."""
    p = product_packaging(spark, sf_dir)
    x, y = F.col("global_percent") * 100, F.col("mean") * 100
    return p.select("ID", "Company name", "Sector", F.round("mean", OUT_DIGITS).alias("mean"), "mass",
                    F.round(x, 10).alias("percent_of_mass"), (x.between(*X_LIMITS) & y.between(*Y_LIMITS)).alias("shown"))


@query("packaging_by_sector", audit.sql(f"""
SELECT *, CASE sector WHEN '{SECTOR_LEVELS[0]}' THEN 1 WHEN '{SECTOR_LEVELS[1]}' THEN 2 ELSE 3 END AS level
FROM ({_fit_cols_sql('sector')} FROM m)""", *_PACK_SQL))
def q_packaging_by_sector(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A25 + A27 + C27 on L9: a log-log fit per sector and for "All" within the axis limits, one pass."""
    fit = stats.ols_with_all(within_limits(product_packaging(spark, sf_dir)), F.log10("y"), F.log10("x"), "sector")
    level = F.array_position(F.array(*map(F.lit, SECTOR_LEVELS)), F.col("sector")).cast("int")
    return _r6(fit.select("sector", level.alias("level"), *_FIT_OUT), _FIT_DOUBLES)


@query("packaging_band", audit.sql(f"""
SELECT p.sector, round(p.x, 6) AS x, round(a + b * p.x, 6) AS fitted,
       round(a + b * p.x - t * s * sqrt(1.0 / n + (p.x - mx) * (p.x - mx) / sxx), 6) AS lower,
       round(a + b * p.x + t * s * sqrt(1.0 / n + (p.x - mx) * (p.x - mx) / sxx), 6) AS upper
FROM (SELECT DISTINCT sector, log10(x) AS x FROM pts UNION ALL SELECT DISTINCT '{SECTOR_LEVELS[1]}', log10(x) FROM pts) p
JOIN (SELECT f.*, {_T_CRIT_SQL} AS t FROM (
  SELECT sector, n, mx, sxx, sxy / sxx AS b, my - sxy / sxx * mx AS a,
         sqrt((syy - sxy / sxx * sxy) / (n - 2)) AS s FROM m) f) g ON p.sector = g.sector""", *_PACK_SQL))
def q_packaging_band(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A27 on L9: the 95 % band of each sector's fit and of "All" at every distinct x."""
    pts = ordered.materialize(within_limits(product_packaging(spark, sf_dir)))
    fit = stats.ols_with_all(pts, F.log10("y"), F.log10("x"), "sector")
    at = pts.select("sector", F.log10("x").alias("_x")).distinct()
    at = at.unionByName(at.select(F.lit(SECTOR_LEVELS[1]).alias("sector"), "_x").distinct())
    band = stats.confidence_band(at, fit, F.col("_x"), F.col("_x"), "sector").drop("t_crit")
    return _r6(band, ["x", "fitted", "lower", "upper"])


_DIAG_SQL = _PACK_SQL[:-2] + (
    ("m", f"""{_fit_sql('log10(mean)', 'log10(global_percent)', "'log10' AS model, ", src='pack')}
           UNION ALL {_fit_sql('mean', 'mass', "'raw' AS model, ", src='pack')}"""),
    ("fits", """
    SELECT model, n, mx, sxx, sxy / sxx AS b, my - sxy / sxx * mx AS a, sqrt((syy - sxy / sxx * sxy) / (n - 2)) AS s FROM m"""),
    ("points", """
    SELECT 'log10' AS model, "ID", log10(global_percent) AS x, log10(mean) AS y FROM pack
    UNION ALL SELECT 'raw', "ID", mass, mean FROM pack"""),
    ("diag", """
    SELECT p.model, "ID", a + b * x AS fitted, y - (a + b * x) AS residual,
           1.0 / n + (x - mx) * (x - mx) / sxx AS leverage, s FROM points p JOIN fits f ON p.model = f.model"""),
)
_DIAG_OUT = ["fitted", "residual", "leverage", "std_residual", "cooks_distance"]


def _diagnostics(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    p = ordered.materialize(product_packaging(spark, sf_dir))
    fits = ordered.materialize(stats.ols_models(p, models()))
    return {name: stats.residual_table(p, fits.filter(F.col("model") == name), y, x, ["ID"])
            for name, (y, x) in models().items()}


def _named(parts: dict[str, DataFrame], label: str) -> DataFrame:
    return reduce(DataFrame.unionByName, [d.withColumn(label, F.lit(n)) for n, d in parts.items()])


# Masses reach thousands of units, mean shares a thousandth: values of the raw fit are compared in parts per million.
@query("packaging_diag", audit.sql("""
SELECT model, "ID", round(fitted * 1e3, 6) AS fitted, round(residual * 1e3, 6) AS residual, round(leverage, 6) AS leverage,
       round(residual / (s * sqrt(1 - leverage)), 6) AS std_residual,
       round(pow(residual / (s * sqrt(1 - leverage)), 2) / 2.0 * leverage / (1 - leverage), 6) AS cooks_distance
FROM diag""", *_DIAG_SQL))
def q_packaging_diag(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A28 on L9: what ``plot(lm)`` shows of both fits, a row per fit and product; fitted values and
    residuals in thousandths."""
    d = _named(_diagnostics(spark, sf_dir), "model")
    return _r6(d.withColumns({c: F.col(c) * 1e3 for c in ("fitted", "residual")}), _DIAG_OUT)


@query("packaging_residuals", audit.sql("""
SELECT model, round(min(residual) * 1e3, 6) AS min, round(quantile_cont(residual, 0.25) * 1e3, 6) AS q1,
       round(quantile_cont(residual, 0.5) * 1e3, 6) AS median, round(quantile_cont(residual, 0.75) * 1e3, 6) AS q3,
       round(max(residual) * 1e3, 6) AS max
FROM diag GROUP BY model""", *_DIAG_SQL))
def q_packaging_residuals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The residual quartiles at the head of ``summary(lm)``, of both fits, in thousandths."""
    parts = {n: aggregates.summary_stats(d, "residual") for n, d in _diagnostics(spark, sf_dir).items()}
    five = ["min", "q1", "median", "q3", "max"]
    return _named(parts, "model").select("model", *[F.round(F.col(c) * 1e3, OUT_DIGITS).alias(c) for c in five])


@query("packaging_histograms", audit.sql(f"""
SELECT 'mean' AS variable, * FROM ({hist_sql('SELECT log10(mean) AS x FROM pack')})
UNION ALL SELECT 'global_percent', * FROM ({hist_sql('SELECT log10(global_percent) AS x FROM pack')})""", *_PACK_SQL[:-2]))
def q_packaging_histograms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A29 on L9: counts of log10(mean) and log10(global_percent)."""
    p = ordered.materialize(product_packaging(spark, sf_dir))
    parts = {c: stats.histogram(p, F.log10(c)) for c in ("mean", "global_percent")}
    return _r6(_named(parts, "variable"), ["lower", "upper"])
