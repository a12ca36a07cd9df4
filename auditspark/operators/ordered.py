"""Order-dependent operators without a single-partition window.

A window with ``orderBy`` and no ``partitionBy`` moves every row into one task.
Instead the rows are range-partitioned on the sort key, each range gets its
local running values from a window partitioned by the range, and the offsets of
earlier ranges come from a table with one row per range (size bounded by the
number of partitions), broadcast back. Ties are split across ranges by the
secondary key, so one hot value cannot land in one task.

The range-partitioned frame is written to the shared checkpoint folder before
it is read twice: range bounds come from sampling, and a lost executor must not
recompute a different partition assignment for one of the two reads.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from auditspark.session import checkpoint_dir


def attach_scalar(df: DataFrame, scalar: DataFrame) -> DataFrame:
    """Append the columns of a one-row frame (an ungrouped aggregate) to every row.

    What is broadcast is an ungrouped aggregate, so its size is one row whatever the caller passes; a
    frame of more rows is an error, an empty one leaves no rows."""
    more = F.raise_error(F.lit("attach_scalar expects a frame of one row"))
    one = (scalar.agg(F.count(F.lit(1)).alias("_n"), F.first(F.struct(*scalar.columns)).alias("_row"))
           .where(F.col("_n") > 0).select(F.when(F.col("_n") > 1, more).otherwise(F.col("_row")).alias("_row"))
           .select(*[F.col("_row")[c].alias(c) for c in scalar.columns]))
    return df.join(F.broadcast(one), how="inner")


def materialize(df: DataFrame) -> DataFrame:
    """Write ``df`` as a Parquet table in the shared checkpoint folder and
    continue from the files.

    Used before a table is read by several independent passes (validation,
    report metrics, bootstrap input): the upstream plan runs once (one write
    job; an eager ``checkpoint()`` would run it twice, once for the action and
    once to save), a lost executor re-reads the files instead of re-running the
    joins, and the planner sees the table's real size."""
    import uuid

    spark = df.sparkSession
    path = f"{checkpoint_dir(spark).rstrip('/')}/tables/{uuid.uuid4().hex}"
    df.write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def _range_parts(df: DataFrame, order: list[Column], parts: int | None) -> DataFrame:
    spark = df.sparkSession
    n = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    # Written once to the shared checkpoint folder: the partition id is then
    # fixed in the files, so a retried task cannot move a row to a different
    # range between the two reads below. (The sampling pass of the range
    # partitioner re-reads the upstream's shuffle output, which is cheap.)
    ranged = df.repartitionByRange(n, *order).withColumn("_part", F.spark_partition_id())
    return materialize(ranged)


def global_positions(df: DataFrame, order: list[Column], value_col: str | None = None,
                     parts: int | None = None) -> DataFrame:
    """Add ``row_pos`` (1-based position in the global order) and, when
    ``value_col`` is given, ``cumulative`` (running sum in that order)."""
    g = _range_parts(df, order, parts)
    local_w = Window.partitionBy("_part").orderBy(*order)
    run = local_w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    local = g.withColumn("_rn", F.row_number().over(local_w))
    aggs = [F.count(F.lit(1)).alias("_cnt")]
    if value_col:
        local = local.withColumn("_cs", F.sum(value_col).over(run))
        aggs.append(F.sum(value_col).alias("_tot"))
    totals = g.groupBy("_part").agg(*aggs)
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.withColumn("_off_n", F.coalesce(F.sum("_cnt").over(before), F.lit(0)))
    if value_col:
        offsets = offsets.withColumn("_off_s", F.coalesce(F.sum("_tot").over(before), F.lit(0.0)))
    out = local.join(F.broadcast(offsets), "_part")
    out = out.withColumn("row_pos", (F.col("_off_n") + F.col("_rn")).cast("bigint"))
    if value_col:
        out = out.withColumn("cumulative", F.col("_off_s") + F.col("_cs"))
    return out.drop("_part", "_rn", "_cs", "_cnt", "_tot", "_off_n", "_off_s")


def rank_desc_avg_ties(df: DataFrame, value_col: str, tie_col: str, sum_col: str | None = None,
                       value_alias: str = "rank", parts: int | None = None) -> DataFrame:
    """Descending rank with average ties (``nrow - rank(x) + 1``) plus the
    running sum of ``sum_col`` (default ``value_col``) in (value desc, tie_col asc)
    order.

    Output adds ``rank`` (double), ``row_pos`` and ``cumulative``. Rows whose value is NA
    stay: they come last, their rank and running sum are NA, and, as in
    ``nrow - rank(x) + 1``, they count in nrow."""
    order = [F.desc(value_col), F.asc(tie_col)]
    pos = global_positions(df, order, sum_col or value_col, parts)
    ties = (pos.groupBy(F.col(value_col).alias("_value"))
            .agg(F.min("row_pos").alias("_first"), F.count(F.lit(1)).alias("_nt")))
    missing = ties.agg(F.coalesce(F.sum(F.when(F.col("_value").isNull(), F.col("_nt"))), F.lit(0)).alias("_na"))
    known = F.col(value_col).isNotNull()
    rank = F.col("_na") + F.col("_first") + (F.col("_nt") - 1) / 2.0
    return (pos.join(attach_scalar(ties, missing), F.col(value_col).eqNullSafe(F.col("_value")))
            .withColumn(value_alias, F.when(known, rank))
            .withColumn("cumulative", F.when(known, F.col("cumulative")))
            .drop("_value", "_first", "_nt", "_na"))


def dense_index(df: DataFrame, key_cols: list[str], alias: str = "idx",
                parts: int | None = None) -> DataFrame:
    """Dense 1-based index of the distinct keys in ascending key order
    (``as.numeric(as.factor(x))``, the bootstrap event index)."""
    keys = df.select(*key_cols).distinct()
    pos = global_positions(keys, [F.asc(c) for c in key_cols], None, parts)
    return pos.withColumnRenamed("row_pos", alias)


def count_below(df: DataFrame, col_name: str, threshold: float, alias: str) -> DataFrame:
    """``nrow(filter(x < t)) + 1`` - items needed to pass the threshold."""
    return df.agg((F.count_if(F.col(col_name) < threshold) + 1).alias(alias))


def top_with_ties(df: DataFrame, value_col: str, n: int, alias: str = "rank") -> DataFrame:
    """O2/O3: ``slice_max(x, n)`` / ``top_n(n, wt=x)``: every row whose
    descending ``rank()`` is at most n, ties included.

    The rank of a value is one more than the rows above it, so only the n
    greatest distinct values and their counts are ranked, and the rows join
    these; a value that a third of the rows share is never gathered."""
    top = (df.groupBy(F.col(value_col).alias("_value")).agg(F.count(F.lit(1)).alias("_nt"))
           .orderBy(F.desc_nulls_last("_value")).limit(n))
    above = F.sum("_nt").over(Window.orderBy(F.desc_nulls_last("_value")).rowsBetween(Window.unboundedPreceding, -1))
    ranked = (top.withColumn(alias, (F.coalesce(above, F.lit(0)) + 1).cast("bigint"))
              .filter(F.col(alias) <= n).drop("_nt"))
    # At most n rows by construction.
    return df.join(F.broadcast(ranked), F.col(value_col).eqNullSafe(F.col("_value"))).drop("_value")


def first_per_key(df: DataFrame, keys: list[str], order_cols: list[str]) -> DataFrame:
    """``distinct(key, .keep_all = TRUE)`` - the first row of each key in
    (order_cols) order.

    ``min(struct(order..., rest...))`` is an ordinary aggregate with a map-side
    partial step, so a key that holds a third of the rows is reduced on every
    mapper before the shuffle instead of being gathered into one task."""
    rest = [c for c in df.columns if c not in keys and c not in order_cols]
    packed = F.struct(*[F.col(c) for c in order_cols + rest]).alias("_first")
    first = df.groupBy(*keys).agg(F.min(packed).alias("_first"))
    return first.select(*keys, *[F.col(f"_first.{c}").alias(c) for c in order_cols + rest])
