"""The order of rows in their files.

R reads a file from top to bottom, and "first" means first in it. Spark's rows have no order, but a scan knows
where each came from: ``with_file_order`` adds, before anything moves a row, its file, the block of the file it was
read in and a number that grows within the block. Compared in that order these restore the order of the files
(by path) and of the rows in them, whatever partitioning comes after.

Defined results: only frames read directly from files have an order; files are ordered by path, which for a table
that Spark wrote is the order of its partitions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from auditspark.functions import rsem
from auditspark.operators.ordered import global_positions


def with_file_order(scan: DataFrame, name: str = "_order") -> DataFrame:
    """``scan``, read directly from files, with the place of each row in them as a struct that compares in file order."""
    meta = F.col("_metadata")
    place = F.struct(meta["file_path"].alias("file"), meta["file_block_start"].alias("block"),
                     # Grows within a task, and a task reads a block from its start to its end.
                     F.monotonically_increasing_id().alias("row"))
    return scan.select("*", place.alias(name))


def to_string_parts(df: DataFrame, keys: list[str], value_col: str, order: list[Column], alias: str,
                    most: int = 1000, sep: str = ", ") -> DataFrame:
    """A4 with duplicates kept and a bounded cell: ``toString(x)`` in order, in parts of at most ``most`` values.

    Output: keys, ``part`` (from 0), ``n`` (values in the part) and the string. Joined by ``sep`` in the order of
    ``part``, a key's strings are its whole ``toString``; a key with at most ``most`` values has one part. Positions
    come from ranges of (keys, order), so a key that holds a third of the rows is numbered, and its parts are put
    together, in many tasks. NA prints as "NA"."""
    x = df.select(*keys, value_col, *[c.alias(f"_o{i}") for i, c in enumerate(order)])
    places = [f"_o{i}" for i in range(len(order))]
    numbered = global_positions(x, [F.asc(k) for k in keys] + [F.asc(p) for p in places])
    firsts = numbered.groupBy(*keys).agg(F.min("row_pos").alias("_first")).select(
        *[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], "_first")
    same = None
    for i, k in enumerate(keys):
        one = F.col(k).eqNullSafe(F.col(f"_k{i}"))
        same = one if same is None else same & one
    place = F.col("row_pos") - F.col("_first")
    parts = numbered.join(firsts, same).withColumn("part", F.floor(place / most).cast("int"))
    item = F.struct("row_pos", rsem.na_text(value_col).alias("_v"))
    return (parts.groupBy(*keys, "part").agg(F.array_sort(F.collect_list(item)).alias("_l"))
            .select(*keys, "part", F.size("_l").alias("n"), F.array_join(F.transform("_l", lambda s: s["_v"]), sep).alias(alias)))
