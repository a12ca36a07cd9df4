"""Helpers shared by the corpus operators."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from auditspark.session import checkpoint_dir


def stage(df: DataFrame) -> DataFrame:
    """Write ``df`` as a Parquet table in the shared checkpoint folder and continue from the files.

    Cuts the lineage: a lost executor re-reads files, sampled or hash-drawn decisions
    upstream cannot change between two readers, and the planner sees real sizes."""
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark).rstrip('/')}/llm/{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._stage_path = path
    return out


def discard(df: DataFrame) -> None:
    """Delete a table written by ``stage`` that no later frame reads any more."""
    path = getattr(df, "_stage_path", None)
    if path:
        jvm = df.sparkSession._jvm
        target = jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(target, True)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def fresh(taken: list[str], base: str) -> str:
    """``base``, with underscores appended until no column of ``taken`` has that name."""
    lowered = {c.lower() for c in taken}
    while base.lower() in lowered:
        base += "_"
    return base


def unsigned_mod(value: Column, modulus: int) -> Column:
    return F.pmod(value, F.lit(modulus))


def label_remainder(doc_id: str, modulus: int) -> Column:
    """crc32(doc_id as text) mod ``modulus``; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % modulus


def row_key() -> Column:
    """A digest of doc_id and text, never null; a null text counts as empty. Only repeats share it."""
    doc_id = F.coalesce(F.col("doc_id").cast("long").cast("string"), F.lit(""))
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return F.unhex(F.sha2(F.concat(doc_id, F.lit(":"), text).cast("binary"), 256))


def id_and_text(docs: DataFrame) -> DataFrame:
    """Only the two columns the operators read, under fixed names; null texts become empty."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"),
                       F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
