"""Incremental ingest of new submission files (L1 on a file stream).

The reference has no stream: it re-reads every submission file each run. When
new item files keep arriving, Structured Streaming picks up only the new files
and ``foreachBatch`` runs the same batch L1 step on each micro-batch. The sum-
to-one rule needs every item of an audit, so an audit must not be split over
micro-batches: each batch records its audits beside the output, and one that
brings more items of an earlier batch's audit stops the stream. Each micro-batch is written to
its own partition of a Parquet stage table (overwritten if the batch is retried);
the checkpoint location makes the stream restart where it left.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from auditspark.operators.joins import null_safe_join
from auditspark.plans.audit import EVENT_KEYS
from auditspark.plans.pipelines import ingest


def start_item_stream(spark: SparkSession, items_dir: str, items_schema: StructType, events: DataFrame,
                      brand_key: DataFrame, out_path: str, checkpoint: str,
                      fmt: str = "parquet") -> StreamingQuery:
    """Start the stream; call ``processAllAvailable()`` / ``stop()`` on the result."""
    stream = spark.readStream.format(fmt).schema(items_schema).load(items_dir)

    audits_path = f"{out_path.rstrip('/')}_audits"

    def write_batch(batch: DataFrame, epoch: int) -> None:
        # The batch is read once for both its audits and its items.
        batch = batch.persist()
        try:
            batch.select(*EVENT_KEYS).distinct().write.mode("overwrite").parquet(f"{audits_path}/epoch={epoch}")
            if epoch:
                known = spark.read.parquet(audits_path)
                own, earlier = known.filter(F.col("epoch") == epoch), known.filter(F.col("epoch") < epoch)
                split = null_safe_join(own.select(*EVENT_KEYS), earlier.select(*EVENT_KEYS), EVENT_KEYS, "left_semi")
                if not split.isEmpty():
                    raise ValueError(f"micro-batch {epoch} has items of audits of earlier batches: {split.limit(5).collect()}")
            # One folder per micro-batch, overwritten on a retry: a batch that is
            # re-run after a failure replaces its partial output instead of adding
            # to it. Readers see the ``epoch`` partition column.
            ingest(batch, events, brand_key).write.mode("overwrite").parquet(f"{out_path}/epoch={epoch}")
        finally:
            batch.unpersist()

    return (stream.writeStream.foreachBatch(write_batch)
            .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
