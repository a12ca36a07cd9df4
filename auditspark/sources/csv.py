"""CSV reader profiles and sinks.

Two profiles mirror the two R readers the pipeline uses:

* ``base`` (``read.csv``): a blank cell is the empty string and ``NA`` is missing.
* ``fast`` (``fread``): same for ``NA``; a quoted ``""`` stays the empty string.

Both read every column as STRING first (raw layer) unless a schema is given;
typing happens afterwards with ``try_cast`` so sentinel text never fails a job.
R doubles embedded quotes, so ``escape='"'`` is always set.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

MALFORMED = "_malformed"
RECORD = "_record"


def read_csv(spark: SparkSession, path: str, schema: StructType | None = None,
             profile: str = "base", keep_corrupt: bool = False,
             encoding: str = "UTF-8", multi_line: bool = False) -> DataFrame:
    """Read a CSV written by R.

    ``keep_corrupt`` adds two columns: ``_malformed`` for lines with more fields
    than the header (unquoted commas), and ``_record``, the whole raw line where
    Spark found another number of fields than the header's, so that no field is
    lost however many there are. ``multi_line`` allows line breaks inside quoted
    fields; a file is then one task, so it is off unless asked for."""
    reader = (spark.read.option("header", True).option("escape", '"')
              .option("multiLine", multi_line).option("encoding", encoding)
              .option("mode", "PERMISSIVE").option("enforceSchema", True))
    if profile == "fast":
        reader = reader.option("nullValue", "NA")
    if schema is None:
        header = (spark.read.option("header", True).option("escape", '"').option("multiLine", multi_line)
                  .option("encoding", encoding).csv(path).schema)
        # A column without a name is the row names that write.csv puts first; read.csv calls it X.
        names = ["X" if i == 0 and f.name == "_c0" else f.name for i, f in enumerate(header)]
        schema = StructType([StructField(n, StringType(), True) for n in names])
    fields = len(schema.fields)
    if keep_corrupt:
        schema = StructType([*schema.fields, StructField(RECORD, StringType(), True)])
        reader = reader.option("columnNameOfCorruptRecord", RECORD)
    df = reader.schema(schema).csv(path)
    if keep_corrupt:
        # Commas outside quotes separate fields.
        bare = F.regexp_replace(F.col(RECORD), r'"[^"]*"', "")
        more = F.regexp_count(bare, F.lit(",")) + 1 > fields
        df = df.withColumn(MALFORMED, F.coalesce(more, F.lit(False)))
    if profile == "base":
        # read.csv: literal NA is missing, a blank text cell is "".
        exprs = []
        for f in df.schema.fields:
            c = F.col(f"`{f.name}`")
            if isinstance(f.dataType, StringType) and f.name != RECORD:
                c = F.when(c == "NA", F.lit(None)).otherwise(F.coalesce(c, F.lit("")))
            exprs.append(c.alias(f.name))
        df = df.select(*exprs)
    return df


def write_csv(df: DataFrame, path: str, mode: str = "overwrite",
              partition_by: list[str] | None = None, encoding: str = "UTF-8", row_names: list[str] | None = None) -> None:
    """Write with a header and R-compatible quoting.

    Without ``row_names`` there is no row index (``fwrite``); with it, as ``write.csv`` does, a first column without a
    name numbers the rows from 1 in the order of these columns, and NA is spelled out."""
    if row_names:
        from auditspark.operators.ordered import global_positions

        numbered = global_positions(df, [F.asc(c) for c in row_names])
        df = numbered.select(F.col("row_pos").alias(""), *[
            F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("NA")).alias(c) for c in df.columns])
    w = df.write.mode(mode).option("header", True).option("escape", '"').option("encoding", encoding)
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.csv(path)


def write_stage(df: DataFrame, path: str, partition_by: list[str] | None = None) -> DataFrame:
    """Persist a typed stage table as Parquet and read it back.

    Reading back cuts the lineage, so a lost executor later recomputes from the
    stage files instead of the whole upstream plan."""
    w = df.write.mode("overwrite")
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.parquet(path)
    return df.sparkSession.read.parquet(path)


def stage_path(spark: SparkSession, name: str, run_id: str = "current") -> str:
    """Stage tables live beside the session's shared checkpoint folder."""
    from auditspark.session import checkpoint_dir

    base = checkpoint_dir(spark).rstrip("/")
    return f"{base}/stages/{run_id}/{name}"
