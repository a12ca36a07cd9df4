"""Grouped aggregates with R semantics.

All aggregates are plain ``groupBy().agg()`` so Spark plans a partial
(map-side) aggregate before each shuffle; a key holding a third of the rows is
reduced on every mapper first. String aggregation (``toString``) first reduces
to distinct (key, value) pairs with counts, so the list gathered per key is
bounded by the number of distinct values, not by the number of rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from auditspark.functions import rsem
from auditspark.operators.ordered import attach_scalar


def groups_summing_to_one(df: DataFrame, keys: list[str], value_col: str = "proportion",
                          digits: int = 3) -> DataFrame:
    """J3 + F7: groups whose values sum to 1 at ``digits`` decimals (HAVING)."""
    return (df.groupBy(*keys).agg(F.sum(value_col).alias("sum"))
            .filter(rsem.near("sum", 1.0, digits)))


def to_string_agg(df: DataFrame, keys: list[str], value_col: str, alias: str,
                  order_cols: list[str] | None = None, sep: str = ", ",
                  keep_duplicates: bool = True) -> DataFrame:
    """``toString(x)`` per group - values joined by ", ", NA printed "NA".

    Values are ordered by ``order_cols`` (default: the value), NULL last as in R.
    Duplicates are kept by repeating a value as often as it occurs, after the
    (key, value) pairs have been counted by a partial aggregate."""
    order_cols = order_cols or [value_col]
    shown = rsem.na_text(value_col)
    pairs = (df.groupBy(*keys, *order_cols, value_col)
             .agg(F.count(F.lit(1)).alias("_n")))
    # NA sorts last, as in R: an is-null flag precedes each sort key.
    sort_keys = []
    for i, c in enumerate(order_cols):
        sort_keys += [F.col(c).isNull().alias(f"_z{i}"), F.col(c).alias(f"_k{i}")]
    item = F.struct(*sort_keys, shown.alias("_v"), F.col("_n"))
    lists = pairs.groupBy(*keys).agg(F.array_sort(F.collect_list(item)).alias("_l"))
    if keep_duplicates:
        flat = F.flatten(F.transform("_l", lambda s: F.array_repeat(s["_v"], s["_n"].cast("int"))))
    else:
        flat = F.transform("_l", lambda s: s["_v"])
    return lists.select(*keys, F.array_join(flat, sep).alias(alias))


def count_rows(df: DataFrame, keys: list[str], alias: str = "count") -> DataFrame:
    """A1: ``group_by + summarise(n())``."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias(alias))


def collapse_duplicates(df: DataFrame, measure: str = "total_count",
                        drop: tuple[str, ...] = ("proportion",),
                        denominator: str = "event_total_count") -> DataFrame:
    """A5: group by every column except the measures, sum the count and
    recompute the share (``group_by(across(c(everything(), -total_count,
    -proportion))) |> summarise(sum)``). NULL group keys form their own group."""
    keys = [c for c in df.columns if c != measure and c not in drop]
    out = df.groupBy(*keys).agg(F.sum(measure).alias(measure))
    if denominator in keys:
        out = out.withColumn("proportion", F.try_divide(F.col(measure).cast("double"),
                                                        F.col(denominator).cast("double")))
    return out


def status_conflicts(df: DataFrame, key: str = "brand_name", status: str = "validated",
                     allowed: tuple[str, ...] = ("true", "attempted", "false"),
                     alias: str = "validated_concat") -> DataFrame:
    """Keys whose distinct statuses, string-aggregated, are not one allowed
    value (two statuses, or a NULL status that prints as "NA")."""
    distinct = df.select(key, status).distinct()
    agg = to_string_agg(distinct, [key], status, alias, keep_duplicates=False)
    return agg.filter(rsem.not_in(alias, allowed))


def demote_conflicts(df: DataFrame, conflicts: DataFrame, key: str = "brand_name",
                     status: str = "validated", to: str = "false") -> DataFrame:
    """A10 + J10: ``validated = ifelse(brand %in% conflicts$brand, "false", validated)``.

    Membership is a left join to the distinct conflicting keys plus a flag."""
    flags = conflicts.select(F.col(key).alias("_k")).distinct().withColumn("_hit", F.lit(True))
    joined = df.join(flags, rsem.col(key).eqNullSafe(F.col("_k")), "left")
    return (joined.withColumn(status, F.when(F.col("_hit").isNotNull(), F.lit(to)).otherwise(F.col(status)))
            .drop("_k", "_hit"))


def multi_valued(df: DataFrame, key: str = "brand_name", value: str = "id",
                 alias: str = "count") -> DataFrame:
    """Keys mapped to more than one distinct value (NA counts as a value)."""
    return (df.select(key, value).distinct().groupBy(key)
            .agg(F.count(F.lit(1)).alias(alias)).filter(F.col(alias) > 1))


def freq_table(df: DataFrame, col_name: str, alias: str = "n") -> DataFrame:
    """``table(x)`` - counts of each non-missing value."""
    return df.filter(F.col(col_name).isNotNull()).groupBy(col_name).agg(F.count(F.lit(1)).alias(alias))


def exact_quantiles(df: DataFrame, col_name: str, probs: list[float]) -> DataFrame:
    """Type-7 quantiles (R's default) without gathering the column in one task.

    Values are first counted per distinct value (a partial aggregate, so a value
    that holds a third of the rows is one row per mapper), then the distinct
    values are range-partitioned and given cumulative counts
    (``global_positions``). Quantile p interpolates the order statistics at
    positions floor(h) + 1 and floor(h) + 2 with h = (n - 1) p; the value at
    position k is the one whose cumulative count range covers k. The count n
    is a scalar. One column per p named ``q0``, ``q1``, ..."""
    from auditspark.operators.ordered import global_positions

    v = df.select(F.col(col_name).cast("double").alias("_x")).filter(F.col("_x").isNotNull())
    counts = v.groupBy("_x").agg(F.count(F.lit(1)).alias("_c"))
    n = counts.agg(F.sum("_c")).first()[0] or 0
    if n == 0:
        return df.sparkSession.createDataFrame([tuple([None] * len(probs))],
                                               ", ".join(f"q{i} double" for i in range(len(probs))))
    plan = []
    for p in probs:
        h = (n - 1) * p
        lo = int(h // 1)
        plan.append((lo + 1, min(lo + 2, n), h - lo))
    pos = (global_positions(counts, [F.asc("_x")], "_c")
           .withColumn("_end", F.col("cumulative").cast("bigint"))
           .withColumn("_start", F.col("_end") - F.col("_c") + 1))

    def covers(k: int) -> F.Column:
        return (F.col("_start") <= k) & (F.col("_end") >= k)

    wanted = sorted({k for lo, hi, _ in plan for k in (lo, hi)})
    pos = pos.filter(reduce_or([covers(k) for k in wanted]))
    aggs = []
    for i, (lo, hi, frac) in enumerate(plan):
        a = F.max(F.when(covers(lo), F.col("_x")))
        b = F.max(F.when(covers(hi), F.col("_x")))
        aggs.append((a + F.lit(frac) * (b - a)).alias(f"q{i}"))
    return pos.agg(*aggs)


def reduce_or(conds: list[Column]) -> Column:
    out = conds[0]
    for c in conds[1:]:
        out = out | c
    return out


def summary_stats(df: DataFrame, col_name: str, exact: bool = True) -> DataFrame:
    """R ``summary(x)``: min, quartiles (type 7), mean, max and NA count.

    Exact quartiles come from a distributed sort (``exact_quantiles``), never
    from buffering the column in one task; ``exact=False`` uses
    ``percentile_approx`` (one pass, bounded memory)."""
    c = F.col(col_name)
    s = df.agg(F.min(c).alias("min"), F.avg(c).alias("mean"), F.max(c).alias("max"),
               F.count_if(c.isNull()).alias("n_na"))
    if exact:
        q = exact_quantiles(df, col_name, [0.25, 0.5, 0.75])
    else:
        q = df.agg(F.percentile_approx(c, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)), 10000).alias("_q")) \
            .select(*[F.col("_q")[i].alias(f"q{i}") for i in range(3)])
    return attach_scalar(s, q).select("min", F.col("q0").alias("q1"), F.col("q1").alias("median"), "mean",
                                      F.col("q2").alias("q3"), "max", "n_na")


def na_profile(df: DataFrame) -> DataFrame:
    """``lapply(df, function(x) sum(is.na(x)))`` - one pass over the data,
    then the one-row result is unpivoted into (column, n_na)."""
    counts = df.agg(*[F.count_if(F.col(f"`{c}`").isNull()).alias(c) for c in df.columns])
    return counts.unpivot([], list(df.columns), "column", "n_na")


def weighted_coverage(df: DataFrame, weight: str, covered: Column, alias: str = "coverage") -> DataFrame:
    """``sum(w[cond]) / sum(w)`` - share of the weight where ``covered``."""
    return df.agg((F.sum(F.when(covered, F.col(weight))) / F.sum(weight)).alias(alias))


def distinct_counts(df: DataFrame, cols: list[str], approx: bool = False) -> DataFrame:
    """A13 + N12: ``length(unique(x))`` for each column, NA counted as a value."""
    exprs = []
    for c in cols:
        if approx:
            exprs.append((F.approx_count_distinct(c) + F.max(F.col(c).isNull().cast("int"))).alias(c))
        else:
            exprs.append(rsem.n_distinct_na(c).alias(c))
    return df.agg(*exprs).unpivot([], cols, "column", "n_distinct")


def group_breakdown(df: DataFrame, keys: list[str], sums: dict[str, str],
                    ratios: dict[str, str]) -> DataFrame:
    """Grouped sums and each group's share of the column total.

    ``sums`` maps output name -> input column; ``ratios`` maps output name ->
    a name from ``sums``. Totals come from a one-row aggregate."""
    g = df.groupBy(*keys).agg(*[F.sum(src).alias(out) for out, src in sums.items()])
    tot = g.agg(*[F.sum(s).alias(f"_t_{s}") for s in sums])
    g = attach_scalar(g, tot)
    for out, s in ratios.items():
        g = g.withColumn(out, F.col(s) / F.col(f"_t_{s}"))
    return g.drop(*[f"_t_{s}" for s in sums])
