"""dplyr join semantics on Spark.

dplyr matches NA keys with NA keys; Spark's ``=`` does not. Every join here
compares keys with ``<=>`` (``eqNullSafe``), which Spark still plans as a hash
or sort-merge equi-join (on ``coalesce(k, default), isnull(k)``), so the usual
strategies apply: AQE broadcasts a side whose measured size is under the
broadcast threshold and sort-merge joins otherwise, and splits skewed partitions.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def shared_columns(left: DataFrame, right: DataFrame) -> list[str]:
    """dplyr's natural-join key - every column name present on both sides."""
    rset = set(right.columns)
    return [c for c in left.columns if c in rset]


def null_safe_join(left: DataFrame, right: DataFrame, on: list[str] | dict[str, str],
                   how: str = "inner") -> DataFrame:
    """Equi-join where NULL keys match NULL keys.

    ``on`` is a list of shared names (emitted once, like dplyr) or a mapping
    left-name -> right-name (``by = c("ID" = "id")``; the right key is dropped)."""
    pairs = list(on.items()) if isinstance(on, dict) else [(k, k) for k in on]
    rn = {r: f"_r_{r}" for _, r in pairs}
    r2 = right.select(*[F.col(f"`{c}`").alias(rn.get(c, c)) for c in right.columns])
    cond = reduce(lambda a, b: a & b,
                  [F.col(f"`{lk}`").eqNullSafe(F.col(rn[rk])) for lk, rk in pairs])
    joined = left.join(r2, cond, how)
    keys = []
    for lk, rk in pairs:
        if how in ("full", "full_outer", "outer") and lk == rk:
            keys.append(F.coalesce(F.col(f"`{lk}`"), F.col(rn[rk])).alias(lk))
        elif how in ("right", "right_outer") and lk == rk:
            keys.append(F.col(rn[rk]).alias(lk))
        else:
            keys.append(F.col(f"`{lk}`"))
    if how in ("left_anti", "anti", "left_semi", "semi"):
        return joined
    lkeys = {lk for lk, _ in pairs}
    rest_left = [F.col(f"`{c}`") for c in left.columns if c not in lkeys]
    rkeys = {rk for _, rk in pairs}
    rest_right = [F.col(f"`{c}`") for c in right.columns if c not in rkeys]
    return joined.select(*keys, *rest_left, *rest_right)


def natural_join(left: DataFrame, right: DataFrame, how: str = "inner") -> DataFrame:
    """Dplyr join without ``by`` - on all shared columns, NA matching NA."""
    on = shared_columns(left, right)
    if not on:
        raise ValueError("no shared columns; a natural join would be a cross product")
    return null_safe_join(left, right, on, how)


def anti_join(left: DataFrame, right: DataFrame, on: list[str]) -> DataFrame:
    """Rows of ``left`` whose key does not occur in ``right``."""
    return null_safe_join(left, right.select(*on).distinct(), on, "left_anti")


def member_flag(left: DataFrame, right: DataFrame, left_col: str, right_col: str,
                alias: str) -> DataFrame:
    """``x %in% other$col`` as a boolean column (NA is in the set only if the
    set has an NA). The right side is reduced to distinct keys before the join."""
    keys = right.select(F.col(right_col).alias("_mk")).distinct().withColumn("_hit", F.lit(True))
    j = left.join(keys, F.col(left_col).eqNullSafe(F.col("_mk")), "left")
    return j.withColumn(alias, F.col("_hit").isNotNull()).drop("_mk", "_hit")


def reconcile(new: DataFrame, old: DataFrame, key: str, new_col: str, old_col: str) -> DataFrame:
    """J8 + C32: full join of new totals against an old key, with equality and
    difference columns (NA when either side is missing)."""
    j = null_safe_join(new, old, [key], "full")
    return (j.withColumn("is_equal", F.col(new_col) == F.col(old_col))
            .withColumn("difference", F.col(new_col) - F.col(old_col)))


def override_union(base: DataFrame, overrides: list[DataFrame], key: str,
                   rank_col: str = "source_rank") -> DataFrame:
    """U2 + U1: rows of later review lists replace base rows with the same key.

    ``filter(!key %in% c(l1$key, l2$key))`` is a left-anti join on the union of
    the override keys (NA keys included, as ``%in%`` matches NA); the lists are
    then appended by name with missing columns as NULL, tagged with their source
    rank (0 = base) so a later first-per-key keeps R's row order."""
    if not overrides:
        return base.withColumn(rank_col, F.lit(0))
    keys = reduce(lambda a, b: a.unionByName(b), [o.select(key) for o in overrides]).distinct()
    kept = null_safe_join(base, keys, [key], "left_anti").withColumn(rank_col, F.lit(0))
    parts = [kept] + [o.withColumn(rank_col, F.lit(i + 1)) for i, o in enumerate(overrides)]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
