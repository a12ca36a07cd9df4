"""Company attribution queries (L1, L8): shares, zero-filled means, ranks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from auditspark.operators import bootstrap, ordered, shares, split_bootstrap
from auditspark.plans import audit
from auditspark.plans.registry import query
from auditspark.sources.tables import Tables

# Ties in a mean are judged at 10 decimals (float noise below that
# depends on summation order); results are compared at 6 decimals.
TIE_DIGITS = 10
OUT_DIGITS = 6

_SHARES_SQL = (
    ("ev", """
    SELECT event_id, id, city, province, country, continent, year, specifics_of_audit,
           CAST(SUM(total_count) AS BIGINT) AS company_sum
    FROM clean WHERE id <> 'unbranded'
    GROUP BY event_id, id, city, province, country, continent, year, specifics_of_audit"""),
    ("shares", """
    SELECT *, CAST(SUM(company_sum) OVER (PARTITION BY event_id) AS BIGINT) AS event_total_count_no_unbrand,
           company_sum / CAST(SUM(company_sum) OVER (PARTITION BY event_id) AS DOUBLE) AS proportion
    FROM ev"""),
    ("means", """
    SELECT id, SUM(proportion) / (SELECT COUNT(DISTINCT event_id) FROM shares) AS mean
    FROM shares GROUP BY id"""),
)


def event_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shares.event_company_shares(audit.clean_items(Tables(spark, sf_dir)))


def company_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shares.zero_filled_mean(event_shares(spark, sf_dir))


@query("event_shares", audit.sql("""
SELECT event_id, id, city, province, country, continent, year, specifics_of_audit, company_sum,
       event_total_count_no_unbrand, round(proportion, 6) AS proportion FROM shares""", *_SHARES_SQL))
def q_event_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of each company per event."""
    return event_shares(spark, sf_dir).withColumn("proportion", F.round("proportion", OUT_DIGITS))


@query("top_companies", audit.sql("""
SELECT id, round(mean, 6) AS mean, rank FROM (
  SELECT id, mean, CAST(rank() OVER (ORDER BY round(mean, 10) DESC) AS BIGINT) AS rank FROM means)
WHERE rank <= 5""", *_SHARES_SQL))
def q_top_companies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A22 + A20 + O3: the five companies with the largest zero-filled mean share
    (ties kept, as ``top_n``)."""
    m = company_means(spark, sf_dir).withColumn("_mk", F.round("mean", TIE_DIGITS))
    top = ordered.top_with_ties(m, "_mk", 5)
    return top.select("id", F.round("mean", OUT_DIGITS).alias("mean"), "rank")


@query("dense_grid_mean", audit.sql("""
SELECT g.id, round(AVG(COALESCE(s.proportion, 0)), 6) AS mean
FROM (SELECT e.event_id, i.id FROM (SELECT DISTINCT event_id FROM shares) e
      CROSS JOIN (SELECT DISTINCT id FROM shares) i) g
LEFT JOIN shares s ON s.event_id = g.event_id AND s.id = g.id
GROUP BY g.id""", *_SHARES_SQL))
def q_dense_grid_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mean over the zero-filled events x companies grid.

    The oracle materialises the grid; the Spark plan never does (sum / N)."""
    return company_means(spark, sf_dir).select("id", F.round("mean", OUT_DIGITS).alias("mean"))


@query("pooled_share", audit.sql("""
SELECT id, CAST(total_company_sum AS BIGINT) AS total_company_sum,
       round(total_company_sum / CAST(SUM(total_company_sum) OVER () AS DOUBLE), 6) AS proportion_aggregated
FROM (SELECT id, SUM(company_sum) AS total_company_sum FROM shares GROUP BY id)""", *_SHARES_SQL))
def q_pooled_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Company total over the grand total."""
    p = shares.pooled_share(event_shares(spark, sf_dir))
    return p.withColumn("proportion_aggregated", F.round("proportion_aggregated", OUT_DIGITS))


@query("unbranded_share", audit.sql("""
SELECT round(AVG(proportion), 6) AS mean, COUNT(*) AS n FROM (
  SELECT event_id, SUM(proportion) AS proportion FROM clean WHERE id = 'unbranded' GROUP BY event_id)"""))
def q_unbranded_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean unbranded share over the events that have unbranded items."""
    per_event = shares.unbranded_by_event(audit.clean_items(Tables(spark, sf_dir)))
    return shares.mean_of(per_event, "proportion").select(F.round("mean", OUT_DIGITS).alias("mean"), "n")


_RANK_SQL = _SHARES_SQL + (("ranked", """
    SELECT id, mean, rank() OVER (ORDER BY round(mean, 10) DESC)
             + (COUNT(*) OVER (PARTITION BY round(mean, 10)) - 1) / 2.0 AS rank,
           SUM(mean) OVER (ORDER BY round(mean, 10) DESC, id ASC
                           ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS cumulative
    FROM means"""),)


def ranked_companies(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = company_means(spark, sf_dir).withColumn("_mk", F.round("mean", TIE_DIGITS))
    # Running sum of the unrounded mean in (rounded mean desc, id asc) order.
    return ordered.rank_desc_avg_ties(m, "_mk", "id", sum_col="mean")


@query("cumulative_rank", audit.sql("""
SELECT id, round(mean, 6) AS mean, CAST(rank AS DOUBLE) AS rank, round(cumulative, 6) AS cumulative
FROM ranked""", *_RANK_SQL))
def q_cumulative_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """W4 + W5 + O1: rank with average ties and the
    running share in descending order."""
    r = ranked_companies(spark, sf_dir)
    return r.select("id", F.round("mean", OUT_DIGITS).alias("mean"), F.col("rank").cast("double"),
                    F.round("cumulative", OUT_DIGITS).alias("cumulative"))


@query("n_to_half", audit.sql("""
SELECT COUNT(*) FILTER (WHERE cumulative < 0.5) + 1 AS n_companies FROM ranked""", *_RANK_SQL))
def q_n_to_half(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Companies needed to reach half of the branded share."""
    m = company_means(spark, sf_dir).withColumn("_mk", F.round("mean", TIE_DIGITS))
    pos = ordered.global_positions(m, [F.desc("_mk"), F.asc("id")], "mean")
    return ordered.count_below(pos, "cumulative", 0.5, "n_companies")


@query("sum_to_one_events", audit.sql("""
SELECT submission_type, submission_id, year, round(SUM(proportion), 6) AS sum
FROM plaus1 GROUP BY submission_type, submission_id, year HAVING abs(SUM(proportion) - 1) < 0.0005"""))
def q_sum_to_one_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J3 + F7: audits whose item shares add up to one (3 decimals)."""
    from auditspark.operators import aggregates

    base = audit.share_filters(audit.audit_base(Tables(spark, sf_dir)))
    return aggregates.groups_summing_to_one(base, audit.EVENT_KEYS).withColumn(
        "sum", F.round("sum", OUT_DIGITS))


@query("plausible_items", audit.sql("""
SELECT event_id, submission_id, p_partkey, brand_name, id, total_count, event_total_count,
       round(proportion, 6) AS proportion, round(sum, 6) AS sum FROM clean"""))
def q_plausible_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """L1: items of plausible audits with share and event id."""
    c = audit.clean_items(Tables(spark, sf_dir))
    return c.select("event_id", "submission_id", "p_partkey", "brand_name", "id", "total_count",
                    "event_total_count", F.round("proportion", OUT_DIGITS).alias("proportion"),
                    F.round("sum", OUT_DIGITS).alias("sum"))


def _boot_sql(values_cte: str, value_col: str, grouped: bool) -> tuple[tuple[str, str], ...]:
    g = "id, " if grouped else ""
    return (
        ("bvals", values_cte),
        ("ev_idx", """
    SELECT event_id, row_number() OVER (ORDER BY event_id) AS idx FROM (SELECT DISTINCT event_id FROM bvals)"""),
        ("nn", "SELECT COUNT(*) AS n FROM ev_idx"),
        *bootstrap.draws_sql(bootstrap.SEED, "ev_idx", "nn"),
        ("w", "SELECT b, idx, COUNT(*) AS w FROM draws GROUP BY b, idx"),
        ("reps", f"""
    SELECT {g}w.b, SUM(w.w * v.{value_col}) / MAX(nn.n) AS m
    FROM bvals v JOIN ev_idx e USING (event_id) JOIN w ON w.idx = e.idx, nn
    GROUP BY {g}w.b"""),
    )


@query("boot_ci", audit.sql("""
SELECT g.id, round(quantile_cont(COALESCE(r.m, 0), 0.975), 6) AS high,
       round(MAX(mm.mean), 6) AS mean, round(quantile_cont(COALESCE(r.m, 0), 0.025), 6) AS low
FROM (SELECT i.id, t.b FROM (SELECT DISTINCT id FROM bvals) i, range(1, 101) t(b)) g
LEFT JOIN reps r ON r.id = g.id AND r.b = g.b
JOIN means mm ON mm.id = g.id
GROUP BY g.id""", *_SHARES_SQL, *_boot_sql("SELECT event_id, id, proportion FROM shares", "proportion", True)))
def q_boot_ci(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A19 + A20 + X1: zero-filled mean share of each company
    with bootstrap 2.5 % / 97.5 % bounds (B = 100, seed 3437)."""
    ci = bootstrap.boot_mean_ci(event_shares(spark, sf_dir), "event_id", "id", "proportion")
    return ci.select("id", *[F.round(c, OUT_DIGITS).alias(c) for c in ("high", "mean", "low")])


@query("unbranded_boot_ci", audit.sql("""
SELECT round(quantile_cont(r.m, 0.975), 6) AS high,
       round((SELECT AVG(proportion) FROM bvals), 6) AS mean,
       round(quantile_cont(r.m, 0.025), 6) AS low
FROM reps r""", *_boot_sql("""
    SELECT event_id, SUM(proportion) AS proportion FROM clean WHERE id = 'unbranded' GROUP BY event_id""",
                           "proportion", False)))
def q_unbranded_boot_ci(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A23 + A19: bootstrap interval of the mean unbranded share per event."""
    per_event = shares.unbranded_by_event(audit.clean_items(Tables(spark, sf_dir)))
    ci = bootstrap.boot_mean_ci(per_event, "event_id", None, "proportion", zero_fill=False)
    return ci.select(*[F.round(c, OUT_DIGITS).alias(c) for c in ("high", "mean", "low")])


def full_boot(sh: DataFrame, with_ones: bool) -> DataFrame:
    """The interval of every company of the shares at B = 10,000; ``with_ones`` adds the group "*", worth 1 in every event."""
    sh = sh.select("event_id", "id", "proportion")
    if with_ones:
        sh = sh.unionByName(sh.select("event_id").distinct().select("event_id", F.lit("*").alias("id"), F.lit(1.0).alias("proportion")))
    return split_bootstrap.boot_mean_ci_split(sh, "event_id", "id", "proportion")


@query("boot_ci_full")
def q_boot_ci_full(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A19 + X1, the full run: B = 10,000 by splittable multinomial weights."""
    return full_boot(event_shares(spark, sf_dir), False).select("id", *[F.round(c, OUT_DIGITS).alias(c) for c in ("high", "mean", "low")])


@query("boot_ci_full_moments", audit.sql("""
SELECT id, round(mean, 6) AS mean, true AS centred, true AS spread, true AS ordered FROM means
UNION ALL SELECT '*', 1.0, true, true, true""", *_SHARES_SQL))
def q_boot_ci_full_moments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A19 + X1, the full run against theory: the replicates of a mean have its value as mean and
    sqrt((E[x^2] - mean^2) / N) as standard deviation, here within 5 Monte Carlo errors and 5 %. The group
    "*" has weight 1 in every event: its replicates are all exactly 1 as each draws N events."""
    b = split_bootstrap.FULL_REPLICATES
    # Read by the replicates, their ones and the theory.
    sh = ordered.materialize(event_shares(spark, sf_dir).select("event_id", "id", "proportion"))
    n = sh.select("event_id").distinct().agg(F.count(F.lit(1)).alias("n"))
    squares = ordered.attach_scalar(sh.groupBy("id").agg(F.sum(F.col("proportion") ** 2).alias("sq")), n).select(
        F.col("id").alias("own"), "sq", "n")
    x = full_boot(sh, True).join(squares, F.col("id") == F.col("own"), "left")
    error = F.coalesce(F.sqrt((F.col("sq") / F.col("n") - F.col("mean") ** 2) / F.col("n")), F.lit(0.0))
    eps = 1e-12
    return x.select("id", F.round("mean", OUT_DIGITS).alias("mean"),
                    (F.abs(F.col("boot_mean") - F.col("mean")) <= 5 * error / b ** 0.5 + eps).alias("centred"),
                    (F.abs(F.col("boot_sd") - error) <= 0.05 * error + eps).alias("spread"),
                    ((F.col("low") <= F.col("mean") + eps) & (F.col("mean") <= F.col("high") + eps)).alias("ordered"))
