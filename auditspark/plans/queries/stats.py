"""Summary statistics and regression queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from auditspark.functions import dist
from auditspark.operators import aggregates, ordered, stats
from auditspark.plans.registry import query
from auditspark.sources.tables import Tables

OUT_DIGITS = 6


def _r6(df: DataFrame, cols: list[str]) -> DataFrame:
    return df.withColumns({c: F.round(c, OUT_DIGITS) for c in cols})


@query("freq_table", """
SELECT event_type, COUNT(*) AS n FROM events WHERE event_type IS NOT NULL GROUP BY event_type""")
def q_freq_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``table(x)`` without NA."""
    return aggregates.freq_table(Tables(spark, sf_dir).events, "event_type")


@query("summary_stats", """
SELECT round(min(value), 6) AS min, round(quantile_cont(value, 0.25), 6) AS q1,
       round(quantile_cont(value, 0.5), 6) AS median, round(avg(value), 6) AS mean,
       round(quantile_cont(value, 0.75), 6) AS q3, round(max(value), 6) AS max,
       COUNT(*) FILTER (WHERE value IS NULL) AS n_na FROM events""")
def q_summary_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """R ``summary(x)`` with type-7 quartiles and the NA count."""
    s = aggregates.summary_stats(Tables(spark, sf_dir).events, "value")
    return _r6(s, ["min", "q1", "median", "mean", "q3", "max"])


def _docs_labels(t: Tables) -> DataFrame:
    d = t.documents.select("doc_id", "text", "lang", "source", "n_chars")
    return d.join(t.labels, "doc_id", "left")


_DL = "(SELECT d.doc_id, d.text, d.lang, d.source, d.n_chars, l.quality, l.toxic FROM documents d " \
      "LEFT JOIN labels l ON d.doc_id = l.doc_id)"


@query("na_profile", f"""
SELECT 'doc_id' AS "column", COUNT(*) FILTER (WHERE doc_id IS NULL) AS n_na FROM {_DL}
UNION ALL SELECT 'text', COUNT(*) FILTER (WHERE text IS NULL) FROM {_DL}
UNION ALL SELECT 'lang', COUNT(*) FILTER (WHERE lang IS NULL) FROM {_DL}
UNION ALL SELECT 'source', COUNT(*) FILTER (WHERE source IS NULL) FROM {_DL}
UNION ALL SELECT 'n_chars', COUNT(*) FILTER (WHERE n_chars IS NULL) FROM {_DL}
UNION ALL SELECT 'quality', COUNT(*) FILTER (WHERE quality IS NULL) FROM {_DL}
UNION ALL SELECT 'toxic', COUNT(*) FILTER (WHERE toxic IS NULL) FROM {_DL}""")
def q_na_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """NA count of every column, one pass."""
    return aggregates.na_profile(_docs_labels(Tables(spark, sf_dir)))


@query("weighted_coverage", f"""
SELECT round(SUM(n_chars) FILTER (WHERE quality IS NOT NULL) / CAST(SUM(n_chars) AS DOUBLE), 6) AS coverage
FROM {_DL}""")
def q_weighted_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of the weight (characters) carried by labelled documents."""
    c = aggregates.weighted_coverage(_docs_labels(Tables(spark, sf_dir)), "n_chars",
                                     F.col("quality").isNotNull())
    return _r6(c, ["coverage"])


@query("distinct_counts", f"""
SELECT 'lang' AS "column", COUNT(DISTINCT lang) + MAX(CAST(lang IS NULL AS INTEGER)) AS n_distinct FROM {_DL}
UNION ALL SELECT 'source', COUNT(DISTINCT source) + MAX(CAST(source IS NULL AS INTEGER)) FROM {_DL}
UNION ALL SELECT 'quality', COUNT(DISTINCT quality) + MAX(CAST(quality IS NULL AS INTEGER)) FROM {_DL}
UNION ALL SELECT 'toxic', COUNT(DISTINCT toxic) + MAX(CAST(toxic IS NULL AS INTEGER)) FROM {_DL}""")
def q_distinct_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``length(unique(x))`` per column, NA counted as a value."""
    return aggregates.distinct_counts(_docs_labels(Tables(spark, sf_dir)), ["lang", "source", "quality", "toxic"])


@query("slice_max_ties", """
SELECT p_partkey, p_retailprice, rank FROM (
  SELECT p_partkey, p_retailprice, rank() OVER (ORDER BY p_retailprice DESC) AS rank FROM part) WHERE rank <= 100""")
def q_slice_max_ties(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O2: ``slice_max(x, n = 100)`` keeps every row tied with the 100th."""
    p = Tables(spark, sf_dir).part.select("p_partkey", "p_retailprice")
    return ordered.top_with_ties(p, "p_retailprice", 100)


_FIT_OUT = ["n", "slope", "intercept", "r2", "adj_r2", "sigma", "se_slope", "se_intercept", "t_slope",
            "t_intercept", "f_stat", "df"]
_FIT_DOUBLES = [c for c in _FIT_OUT if c not in ("n", "df")]


def _fit_sql(y: str, x: str, extra: str = "", src: str = "part", group: str = "") -> str:
    g = f"{group}, " if group else ""
    return f"""
    SELECT {g}{extra}CAST(regr_count({y}, {x}) AS BIGINT) AS n, regr_avgx({y}, {x}) AS mx, regr_avgy({y}, {x}) AS my,
           regr_sxx({y}, {x}) AS sxx, regr_syy({y}, {x}) AS syy, regr_sxy({y}, {x}) AS sxy FROM {src}"""


def _fit_cols_sql(keep: str) -> str:
    return f"""
    SELECT {keep}, n, round(sxy / sxx, 6) AS slope, round(my - sxy / sxx * mx, 6) AS intercept,
      round(sxy * sxy / (sxx * syy), 6) AS r2,
      round(1 - (1 - sxy * sxy / (sxx * syy)) * (n - 1) / (n - 2), 6) AS adj_r2,
      round(sqrt((syy - sxy / sxx * sxy) / (n - 2)), 6) AS sigma,
      round(sqrt((syy - sxy / sxx * sxy) / (n - 2) / sxx), 6) AS se_slope,
      round(sqrt((syy - sxy / sxx * sxy) / (n - 2) * (1.0 / n + mx * mx / sxx)), 6) AS se_intercept,
      round((sxy / sxx) / sqrt((syy - sxy / sxx * sxy) / (n - 2) / sxx), 6) AS t_slope,
      round((my - sxy / sxx * mx) / sqrt((syy - sxy / sxx * sxy) / (n - 2) * (1.0 / n + mx * mx / sxx)), 6)
        AS t_intercept,
      round(sxy * sxy / (sxx * syy) / (1 - sxy * sxy / (sxx * syy)) * (n - 2), 6) AS f_stat, n - 2 AS df"""


@query("regression", f"""
WITH m AS ({_fit_sql('p_retailprice', 'p_size', "'raw' AS model, ")}
           UNION ALL {_fit_sql('log10(p_retailprice)', 'log10(p_size)', "'log10' AS model, ")})
{_fit_cols_sql('model')} FROM m""")
def q_regression(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``lm(y ~ x)`` and ``lm(log10(y) ~ log10(x))`` with ``summary``
    statistics (price on size of parts)."""
    p = Tables(spark, sf_dir).part
    y, x = F.col("p_retailprice"), F.col("p_size")
    out = stats.ols_models(p, {"raw": (y, x), "log10": (F.log10(y), F.log10(x))})
    return _r6(out.select("model", *_FIT_OUT), _FIT_DOUBLES)


def _sector(col: str = "p_type") -> F.Column:
    return (F.when(F.col(col).isin("ECONOMY", "PROMO"), F.lit("Food and Beverage"))
            .otherwise(F.lit("Household and Retail")))


# Display order of the sector levels.
SECTOR_LEVELS = ["Food and Beverage", "All", "Household and Retail"]


@query("regression_by_group", f"""
WITH s AS (SELECT CASE WHEN p_type IN ('ECONOMY', 'PROMO') THEN 'Food and Beverage'
                       ELSE 'Household and Retail' END AS sector, p_retailprice, p_size FROM part
           WHERE p_retailprice > 0 AND p_size > 0),
m AS ({_fit_sql('log10(p_retailprice)', 'log10(p_size)', src='s', group='sector')} GROUP BY sector
      UNION ALL SELECT 'All' AS sector, * FROM ({_fit_sql('log10(p_retailprice)', 'log10(p_size)', src='s')}))
SELECT sector, CASE sector WHEN 'Food and Beverage' THEN 1 WHEN 'All' THEN 2 ELSE 3 END AS level,
       n, slope, intercept, r2 FROM ({_fit_cols_sql('sector')} FROM m)""")
def q_regression_by_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A25 + A27 + C27: log-log fit per sector plus the "All" pseudo-group, with
    the ordered level of each sector; values outside the log domain dropped."""
    p = Tables(spark, sf_dir).part.filter((F.col("p_retailprice") > 0) & (F.col("p_size") > 0))
    s = p.select(_sector().alias("sector"), "p_retailprice", "p_size")
    fit = stats.ols_with_all(s, F.log10("p_retailprice"), F.log10("p_size"), "sector")
    level = F.array_position(F.array(*[F.lit(v) for v in SECTOR_LEVELS]), F.col("sector")).cast("int")
    return _r6(fit.select("sector", level.alias("level"), "n", "slope", "intercept", "r2"),
               ["slope", "intercept", "r2"])


# 97.5 % quantile of the t distribution by its expansion around the normal one, exact to more
# digits than are compared from 100 degrees of freedom on.
_T_CRIT_SQL = ("(SELECT z + (pow(z, 3) + z) / 4 / d + (5 * pow(z, 5) + 16 * pow(z, 3) + 3 * z) / 96 / pow(d, 2) "
               "+ (3 * pow(z, 7) + 19 * pow(z, 5) + 17 * pow(z, 3) - 15 * z) / 384 / pow(d, 3) "
               "FROM (SELECT 1.959963984540054 AS z, CAST(f.n - 2 AS DOUBLE) AS d))")


@query("regression_band", f"""
WITH s AS (SELECT CASE WHEN p_type IN ('ECONOMY', 'PROMO') THEN 'Food and Beverage'
                       ELSE 'Household and Retail' END AS sector, p_retailprice, p_size FROM part
           WHERE p_retailprice > 0 AND p_size > 0),
m AS ({_fit_sql('log10(p_retailprice)', 'log10(p_size)', src='s', group='sector')} GROUP BY sector
      UNION ALL SELECT 'All' AS sector, * FROM ({_fit_sql('log10(p_retailprice)', 'log10(p_size)', src='s')})),
f AS (SELECT sector, n, mx, sxx, sxy / sxx AS b, my - sxy / sxx * mx AS a,
             sqrt((syy - sxy / sxx * sxy) / (n - 2)) AS s FROM m),
g AS (SELECT f.*, {_T_CRIT_SQL} AS t FROM f),
p AS (SELECT DISTINCT sector, log10(p_size) AS x FROM s UNION ALL SELECT DISTINCT 'All', log10(p_size) FROM s)
SELECT p.sector, round(x, 6) AS x, round(a + b * x, 6) AS fitted,
       round(a + b * x - t * s * sqrt(1.0 / n + (x - mx) * (x - mx) / sxx), 6) AS lower,
       round(a + b * x + t * s * sqrt(1.0 / n + (x - mx) * (x - mx) / sxx), 6) AS upper, round(t, 6) AS t_crit
FROM p JOIN g ON p.sector = g.sector""")
def q_regression_band(spark: SparkSession, sf_dir: str) -> DataFrame:
    """95 % confidence band of the log-log fit per sector and for "All",
    at every distinct size."""
    p = Tables(spark, sf_dir).part.filter((F.col("p_retailprice") > 0) & (F.col("p_size") > 0))
    s = p.select(_sector().alias("sector"), "p_retailprice", "p_size")
    y, x = F.log10("p_retailprice"), F.log10("p_size")
    fit = stats.ols_with_all(s, y, x, "sector")
    # Points of the "All" band are the distinct sizes over every sector: the
    # distinct step runs before the relabelled copy is appended.
    pts = s.select("sector", x.alias("_x")).distinct()
    pts = pts.unionByName(pts.select(F.lit("All").alias("sector"), "_x").distinct())
    band = stats.confidence_band(pts, fit, F.col("_x"), F.col("_x"), "sector")
    return _r6(band, ["x", "fitted", "lower", "upper", "t_crit"])


@query("regression_diag", f"""
WITH m AS ({_fit_sql('p_retailprice', 'p_size')}),
f AS (SELECT sxy / sxx AS b, my - sxy / sxx * mx AS a, sqrt((syy - sxy / sxx * sxy) / (n - 2)) AS s,
             n, mx, sxx FROM m),
r AS (SELECT p.p_partkey, f.a + f.b * p.p_size AS fitted, p.p_retailprice - (f.a + f.b * p.p_size) AS residual,
             1.0 / f.n + (p.p_size - f.mx) * (p.p_size - f.mx) / f.sxx AS leverage, f.s FROM part p, f)
SELECT p_partkey, round(fitted, 6) AS fitted, round(residual, 6) AS residual, round(leverage, 6) AS leverage,
       round(residual / (s * sqrt(1 - leverage)), 6) AS std_residual,
       round(pow(residual / (s * sqrt(1 - leverage)), 2) / 2.0 * leverage / (1 - leverage), 6) AS cooks_distance
FROM r""")
def q_regression_diag(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Residual diagnostics of the price ~ size fit, one row per part."""
    p = Tables(spark, sf_dir).part
    fit = stats.ols(p, "p_retailprice", "p_size")
    d = stats.residual_table(p, fit, F.col("p_retailprice"), F.col("p_size"), ["p_partkey"])
    return _r6(d, ["fitted", "residual", "leverage", "std_residual", "cooks_distance"])


# The two-sided p is an integral of cos(angle) ^ (df - 1) from atan(|t| / sqrt(df)) to a right angle
# (t = sqrt(df) tan(angle)), here by Simpson's rule.
@query("regression_pvalues", f"""
WITH m AS ({_fit_sql('log10(p_retailprice)', 'log10(p_size)', src='part')}),
f AS (SELECT n - 2 AS d, n, mx, sxx, sxy / sxx AS b, my - sxy / sxx * mx AS a, (syy - sxy / sxx * sxy) / (n - 2) AS v FROM m),
c AS (SELECT 'intercept' AS term, a AS estimate, sqrt(v * (1.0 / n + mx * mx / sxx)) AS std_error, d FROM f
      UNION ALL SELECT 'slope', b, sqrt(v / sxx), d FROM f),
w AS (SELECT *, estimate / std_error AS t_value, atan(abs(estimate / std_error) / sqrt(d)) AS lo,
             (pi() / 2 - atan(abs(estimate / std_error) / sqrt(d))) / 20000 AS h FROM c),
i AS (SELECT term, SUM(pow(greatest(cos(lo + k.i * h), 0), d - 1)
             * CASE WHEN k.i IN (0, 20000) THEN 1 WHEN k.i % 2 = 1 THEN 4 ELSE 2 END) * MAX(h) / 3 AS area
      FROM w, range(0, 20001) k(i) GROUP BY term)
SELECT w.term, round(estimate, 6) AS estimate, round(std_error, 6) AS std_error, round(t_value, 6) AS t_value,
       round(2 * exp(lgamma((d + 1) / 2.0) - lgamma(d / 2.0)) / sqrt(pi()) * area, 6) AS p_value
FROM w JOIN i ON w.term = i.term""")
def q_regression_pvalues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A26 p-values (``summary(lm)``'s Pr(>|t|)) from Spark ML's normal solver."""
    p = Tables(spark, sf_dir).part.select(F.log10("p_retailprice").alias("y"), F.log10("p_size").alias("x"))
    return _r6(stats.ml_coefficients(p, "y", "x"), ["estimate", "std_error", "t_value", "p_value"])


# Each fit's two p-values, by the same integral as above with fewer steps.
@query("regression_pvalues_by_group", f"""
WITH s AS (SELECT CASE WHEN p_type IN ('ECONOMY', 'PROMO') THEN 'Food and Beverage'
                       ELSE 'Household and Retail' END AS sector, p_retailprice, p_size FROM part
           WHERE p_retailprice > 0 AND p_size > 0),
m AS ({_fit_sql('log10(p_retailprice)', 'log10(p_size)', src='s', group='sector')} GROUP BY sector
      UNION ALL SELECT 'All' AS sector, * FROM ({_fit_sql('log10(p_retailprice)', 'log10(p_size)', src='s')})),
f AS (SELECT sector, n - 2 AS d, n, mx, sxx, sxy / sxx AS b, my - sxy / sxx * mx AS a, (syy - sxy / sxx * sxy) / (n - 2) AS v FROM m),
c AS (SELECT sector, 'p_intercept' AS term, d, a / sqrt(v * (1.0 / n + mx * mx / sxx)) AS t FROM f
      UNION ALL SELECT sector, 'p_slope', d, b / sqrt(v / sxx) FROM f),
w AS (SELECT *, atan(abs(t) / sqrt(d)) AS lo, (pi() / 2 - atan(abs(t) / sqrt(d))) / 20000 AS h FROM c),
i AS (SELECT sector, term, any_value(d) AS d, SUM(pow(greatest(cos(lo + k.i * h), 0), d - 1)
             * CASE WHEN k.i IN (0, 20000) THEN 1 WHEN k.i % 2 = 1 THEN 4 ELSE 2 END) * MAX(h) / 3 AS area
      FROM w, range(0, 20001) k(i) GROUP BY sector, term),
p AS (SELECT sector, term, round(2 * exp(lgamma((d + 1) / 2.0) - lgamma(d / 2.0)) / sqrt(pi()) * area, 6) AS p FROM i)
SELECT f.sector, CAST(f.d AS BIGINT) AS df, max(p) FILTER (WHERE term = 'p_slope') AS p_slope,
       max(p) FILTER (WHERE term = 'p_intercept') AS p_intercept FROM f JOIN p ON p.sector = f.sector GROUP BY f.sector, f.d""")
def q_regression_pvalues_by_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The p-values of every sector's fit and of "All", without a Python worker."""
    p = Tables(spark, sf_dir).part.filter((F.col("p_retailprice") > 0) & (F.col("p_size") > 0))
    s = p.select(_sector().alias("sector"), "p_retailprice", "p_size")
    fit = stats.with_p_values(stats.ols_with_all(s, F.log10("p_retailprice"), F.log10("p_size"), "sector"))
    return _r6(fit.select("sector", F.col("df").cast("bigint").alias("df"), "p_slope", "p_intercept"), ["p_slope", "p_intercept"])


@query("regression_qq", f"""
WITH m AS ({_fit_sql('p_retailprice', 'p_size')}),
f AS (SELECT sxy / sxx AS b, my - sxy / sxx * mx AS a, sqrt((syy - sxy / sxx * sxy) / (n - 2)) AS s, n, mx, sxx FROM m),
r AS (SELECT p.p_partkey, p.p_retailprice - (f.a + f.b * p.p_size) AS residual,
             1.0 / f.n + (p.p_size - f.mx) * (p.p_size - f.mx) / f.sxx AS leverage, f.s FROM part p, f),
z AS (SELECT p_partkey, round(residual / (s * sqrt(1 - leverage)), 9) AS z FROM r),
i AS (SELECT p_partkey, z, CAST(row_number() OVER (ORDER BY z, p_partkey) AS BIGINT) AS position, COUNT(*) OVER () AS n
      FROM z WHERE z IS NOT NULL),
q AS (SELECT *, CASE WHEN n <= 10 THEN 0.375e0 ELSE 0.5e0 END AS a FROM i),
t AS (SELECT *, (position - a) / (n + 1 - 2 * a) AS plotting FROM q)
SELECT p_partkey, round(z, 6) AS std_residual, position, round(plotting, 9) AS plotting,
       round({dist.normal_quantile_sql('plotting')}, 6) AS theoretical FROM t""")
def q_regression_qq(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The normal Q-Q panel of the price ~ size fit, one row per part. Residuals are ordered at 9 digits."""
    p = Tables(spark, sf_dir).part
    fit = stats.ols(p, "p_retailprice", "p_size")
    d = stats.residual_table(p, fit, F.col("p_retailprice"), F.col("p_size"), ["p_partkey"])
    qq = stats.normal_qq(d.select("p_partkey", F.round("std_residual", 9).alias("std_residual")), "std_residual", ["p_partkey"])
    return _r6(qq.select("p_partkey", "std_residual", "position", F.round("plotting", 9).alias("plotting"), "theoretical"),
               ["std_residual", "theoretical"])


def hist_sql(values: str) -> str:
    """Histogram of the column x of ``values``."""
    return f"""
WITH v AS ({values}),
s AS (SELECT min(x) AS lo, max(x) AS up, COUNT(*) AS n FROM v),
c AS (SELECT lo, up, (up - lo) / ceil(log2(n) + 1) AS cell FROM s),
b AS (SELECT lo, up, cell, pow(10, floor(log10(cell))) AS base FROM c),
u AS (SELECT lo, up, base * CASE WHEN cell <= 1.4 * base THEN 1 WHEN cell <= 2.8 * base THEN 2
                                 WHEN cell <= 7 * base THEN 5 ELSE 10 END AS unit FROM b),
k AS (SELECT unit, floor(lo / unit + 1e-10) AS ns, ceil(up / unit - 1e-10) AS nu FROM u),
br AS (SELECT CAST(t.i AS INTEGER) AS i, (k.ns + t.i) * k.unit AS b, 1e-7 * k.unit AS fz, CAST(k.nu - k.ns AS INTEGER) AS nb
       FROM k, range(0, CAST(k.nu - k.ns AS BIGINT) + 1) t(i)),
binned AS (SELECT 1 + (SELECT COUNT(*) FROM br WHERE br.i > 0 AND br.i < br.nb AND br.b + br.fz < v.x) AS bin FROM v)
SELECT CAST(lo.i + 1 AS INTEGER) AS bin, round(lo.b, 6) AS lower, round(hi.b, 6) AS upper,
       (SELECT COUNT(*) FROM binned WHERE binned.bin = lo.i + 1) AS count
FROM br lo JOIN br hi ON hi.i = lo.i + 1"""


@query("histogram", hist_sql(
    "SELECT log10(o_totalprice) AS x FROM orders WHERE o_totalprice IS NOT NULL AND NOT isnan(log10(o_totalprice))"))
def q_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``hist(log10(x))`` counts with Sturges + pretty break points."""
    o = Tables(spark, sf_dir).orders
    h = stats.histogram(o, F.log10("o_totalprice"))
    return _r6(h, ["lower", "upper"])
