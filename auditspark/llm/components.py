"""Connected components by alternating large-star and small-star steps.

Every step is a grouped minimum (reduced on the mappers) joined back to the links, so a node with
many links is a skewed join side that AQE splits, never a gathered group. The links of a step are
written in the shared checkpoint folder; the written tables of earlier steps are deleted.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from auditspark.llm.common import discard, stage


def _least(links: DataFrame) -> DataFrame:
    """a and the least b of its links."""
    return links.groupBy("a").agg(F.min("b").alias("low"))


def large_star(links: DataFrame) -> DataFrame:
    """Hang each node's greater neighbours on the least node around it."""
    both = links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    low = _least(both)
    return (both.join(low, "a").where(F.col("b") > F.col("a"))
            .select(F.col("b").alias("a"), F.least("a", "low").alias("b")).distinct())


def small_star(links: DataFrame) -> DataFrame:
    """Hang each node and its lesser neighbours on the least of them. Expects a > b in every link."""
    low = _least(links)
    moved = links.join(low, "a").where(F.col("b") > F.col("low")).select(F.col("b").alias("a"), F.col("low").alias("b"))
    return moved.unionByName(low.select("a", F.col("low").alias("b"))).distinct()


def _state(links: DataFrame) -> tuple:
    row = links.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
    return row["n"], row["h"]


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """node and root (the least node it reaches) of every node that has a link to another."""
    high, low = F.greatest(a, b).alias("a"), F.least(a, b).alias("b")
    now = stage(links.where(F.col(a) != F.col(b)).select(high, low).distinct())
    state = _state(now)
    while state[0]:
        after = stage(small_star(large_star(now)))
        changed = _state(after)
        discard(now)
        now = after
        if changed == state:
            break
        state = changed
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(
        now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
