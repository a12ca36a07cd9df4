"""Mergeable sketches per stage or year, united later.

A sketch of each year's rows is stored with the stage; a later run unites the stored ones with its own and
answers for all rows without reading them again. Both kinds are Spark's own aggregates, begun on the mappers, and their
size does not depend on the rows: distinct counts by HyperLogLog (relative standard error about
1.04 / sqrt(2^lg_k)), quantiles by KLL (rank error below 1.65 % for the default size, with probability 0.99).

Defined results: as in R, NA is one more distinct value, and is left out of quantiles; without rows a count is 0
and a quantile NULL.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LG_K = 12
KLL_K = 200


def distinct_error(lg_k: int = LG_K, sigmas: float = 3.0) -> float:
    """Relative error that a distinct count exceeds rarely."""
    return sigmas * 1.04 / math.sqrt(1 << lg_k)


def distinct_sketches(df: DataFrame, by: list[str], cols: list[str], lg_k: int = LG_K) -> DataFrame:
    """``by``, ``column``, ``sketch`` of its values and ``has_na``."""
    aggs = []
    for i, c in enumerate(cols):
        # Values of any type by their text; a group without any has no sketch.
        aggs += [F.hll_sketch_agg(F.col(c).cast("string"), F.lit(lg_k)).alias(f"_s{i}"),
                 F.max(F.col(c).isNull()).alias(f"_n{i}")]
    wide = df.groupBy(*by).agg(*aggs)
    rows = F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"_s{i}").alias("sketch"), F.col(f"_n{i}").alias("has_na"))
                     for i, c in enumerate(cols)])
    return wide.select(*by, F.explode(rows).alias("_r")).select(*by, "_r.*")


def distinct_of(sketches: DataFrame) -> DataFrame:
    """``column`` and ``n_distinct`` over all its sketches united, NA counted as a value."""
    return (sketches.groupBy("column")
            .agg(F.hll_union_agg("sketch").alias("_s"), F.max("has_na").cast("int").alias("_n"))
            .select("column", (F.coalesce(F.hll_sketch_estimate("_s"), F.lit(0)) + F.coalesce("_n", F.lit(0))).alias("n_distinct")))


def quantile_sketches(df: DataFrame, by: list[str], cols: list[str], k: int = KLL_K) -> DataFrame:
    """``by``, ``column`` and ``sketch`` of its values as doubles."""
    value = {c: F.col(c).cast("double") for c in cols}
    wide = df.groupBy(*by).agg(*[F.kll_sketch_agg_double(F.when(~F.isnan(v), v), F.lit(k)).alias(f"_s{i}")
                                 for i, v in enumerate(value.values())])
    rows = F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"_s{i}").alias("sketch")) for i, c in enumerate(cols)])
    return wide.select(*by, F.explode(rows).alias("_r")).select(*by, "_r.*")


def quantiles_of(sketches: DataFrame, probs: list[float], k: int = KLL_K) -> DataFrame:
    """``column``, ``p`` and ``value`` over all its sketches united: an element whose rank is near p."""
    merged = sketches.groupBy("column").agg(F.kll_merge_agg_double("sketch", F.lit(k)).alias("_s"))
    filled = F.kll_sketch_get_n_double("_s") > 0
    values = F.array(*[F.struct(F.lit(float(p)).alias("p"), F.when(filled, F.kll_sketch_get_quantile_double("_s", F.lit(float(p))))
                                .alias("value")) for p in probs])
    return merged.select("column", F.explode(values).alias("_r")).select("column", "_r.*")
