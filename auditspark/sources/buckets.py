"""Stage tables laid out for joins and group-bys on one key.

``write_buckets`` writes a table in a fixed number of buckets of the key, each file sorted by it, in a
folder per value of the partition columns. Two tables with the same key and number of buckets join, and either
aggregates by the key, without an exchange; a filter on a partition column reads its folders only. The rows are
dealt to the buckets once, when the table is written, so every later stage saves that shuffle.

A bucket is read by one task, so this layout is for keys of which none holds a large part of the rows (an
event has at most some hundred items); for others the plain stage tables, whose joins AQE can split, stay better.

Defined results: a null key is a key of its own in one bucket (joins drop it as ever); an empty table keeps
its schema; columns keep their names and types, partition columns come last.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def write_buckets(df: DataFrame, path: str, key: str, buckets: int, partition_by: list[str] | None = None,
                  name: str | None = None) -> DataFrame:
    """Write ``df`` to ``path`` in buckets of ``key`` and return the table read from there."""
    spark = df.sparkSession
    name = name or f"buckets_{uuid.uuid4().hex}"
    # One file a bucket and folder: the rows of a bucket are brought together before they are written.
    writer = (df.repartition(buckets, F.col(_quoted(key))).write.mode("overwrite").format("parquet").option("path", path)
              .bucketBy(buckets, key).sortBy(key))
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.saveAsTable(name)
    return spark.table(name)


def open_buckets(spark: SparkSession, like: DataFrame, path: str, key: str, buckets: int,
                 partition_by: list[str] | None = None, name: str | None = None) -> DataFrame:
    """The table that ``write_buckets`` has written to ``path``, in a session that does not know it yet. ``like``
    has its columns and types."""
    name = name or f"buckets_{uuid.uuid4().hex}"
    columns = ", ".join(f"{_quoted(f.name)} {f.dataType.simpleString()}" for f in like.schema.fields)
    parted = f"PARTITIONED BY ({', '.join(map(_quoted, partition_by))})" if partition_by else ""
    spark.sql(f"CREATE TABLE {name} ({columns}) USING parquet {parted} CLUSTERED BY ({_quoted(key)}) "
              f"SORTED BY ({_quoted(key)}) INTO {int(buckets)} BUCKETS LOCATION '{path}'")
    if partition_by:
        spark.catalog.recoverPartitions(name)
    return spark.table(name)


def exchanges(df: DataFrame) -> int:
    """Exchanges of rows in the physical plan of ``df`` before it runs, broadcasts not counted."""
    plan = df._jdf.queryExecution().executedPlan().toString()
    return sum("Exchange " in line and "BroadcastExchange" not in line for line in plan.splitlines())
