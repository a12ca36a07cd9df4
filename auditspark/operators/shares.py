"""Share estimators over events.

The reference builds a dense events x companies grid, fills absent cells with 0
and averages. Zero cells add nothing to a sum, so the zero-filled mean of a
company is ``sum of its shares / number of events``: one aggregate over the
sparse (event, company) rows plus one scalar count, never the grid.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from auditspark.operators.ordered import attach_scalar

# The id that marks unbranded items.
UNBRANDED = "unbranded"

EVENT_ATTRS = ["city", "province", "country", "continent", "year", "specifics_of_audit"]


def event_company_shares(items: DataFrame, event_col: str = "event_id", id_col: str = "id",
                         count_col: str = "total_count", attrs: list[str] | None = None,
                         drop_ids: tuple[str, ...] = (UNBRANDED,)) -> DataFrame:
    """Per (event, company) item sum and share of the event's branded total.

    Output: event, id, attrs..., company_sum, event_total_count_no_unbrand,
    proportion. Both groupings are partial aggregates; the event totals, one row
    an event, are joined back, so the rows of an event with very many companies
    can be split over tasks."""
    attrs = EVENT_ATTRS if attrs is None else attrs
    x = items
    if drop_ids:
        x = x.filter(~F.col(id_col).isin(list(drop_ids)))
    per = x.groupBy(event_col, id_col, *attrs).agg(F.sum(count_col).alias("company_sum"))
    totals = (per.groupBy(F.col(event_col).alias("_event"))
              .agg(F.sum("company_sum").alias("event_total_count_no_unbrand")))
    return (per.join(totals, F.col(event_col).eqNullSafe(F.col("_event"))).drop("_event")
            .withColumn("proportion", F.col("company_sum") / F.col("event_total_count_no_unbrand")))


def n_distinct(df: DataFrame, col_name: str, alias: str = "n_events") -> DataFrame:
    """One-row frame with the number of distinct values (a scalar for joins)."""
    return df.select(col_name).distinct().agg(F.count(F.lit(1)).alias(alias))


def zero_filled_mean(shares: DataFrame, event_col: str = "event_id", id_col: str = "id",
                     value_col: str = "proportion", alias: str = "mean") -> DataFrame:
    """Mean of each company's share over *all* events, absent = 0.

    ``sum(p) / N`` where N is the number of distinct events. N arrives as a
    one-row frame joined with a broadcast hint: its size is one row by
    construction."""
    n = n_distinct(shares, event_col)
    sums = shares.groupBy(id_col).agg(F.sum(value_col).alias("_s"))
    return (attach_scalar(sums, n)
            .select(id_col, (F.col("_s") / F.col("n_events")).alias(alias)))


def pooled_share(shares: DataFrame, id_col: str = "id", count_col: str = "company_sum") -> DataFrame:
    """Company total divided by the grand total (no per-event weighting)."""
    per_id = shares.groupBy(id_col).agg(F.sum(count_col).alias("total_company_sum"))
    grand = shares.agg(F.sum(count_col).alias("_g"))
    return (attach_scalar(per_id, grand)
            .select(id_col, "total_company_sum",
                    (F.col("total_company_sum") / F.col("_g")).alias("proportion_aggregated")))


def unbranded_by_event(items: DataFrame, event_col: str = "event_id", id_col: str = "id",
                       value_col: str = "proportion") -> DataFrame:
    """A23 first step: per event, the summed share of unbranded items."""
    return (items.filter(F.col(id_col) == UNBRANDED)
            .groupBy(event_col, id_col).agg(F.sum(value_col).alias("proportion")))


def mean_of(df: DataFrame, value_col: str, alias: str = "mean") -> DataFrame:
    """A3: plain mean over the rows present (not zero-filled)."""
    return df.agg(F.avg(value_col).alias(alias), F.count(F.lit(1)).alias("n"))

