"""From raw documents to packed training sequences.

``STAGES`` are applied in order; each reads what the one before kept, written as Parquet. All but the
last return the columns of ``documents``, whatever those are; the last returns packed pieces.

1. toxicity: rows whose text the classifier rejects (predicted 1) go, other rows of their doc_id stay.
2. near_duplicates: of each SimHash component one row stays, of the least doc_id (a null one only if
   there are no others) and, of a repeated id, of the text whose hash is least.
3. secrets: spans found by the ledger scan are masked in the text; n_chars, if there, follows.
4. mixing: every row is repeated as often as the mix takes it; a row that it does not take goes. Rows that
   share doc_id, source and text are repeats: as many of them as the mix takes are, whichever they are.
5. packing: one row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

Defined results: rows of null doc_id are scored, linked, masked, mixed and packed like others; an
empty table passes through every stage; columns beyond doc_id and text are carried and never read
but for ``source`` in the mix and n_chars in the masking. Columns may have any names and types.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import AtomicType

from auditspark.llm import mixing, packing, secret_scan, simhash, toxicity
from auditspark.llm.common import fresh, row_key, stage
from auditspark.sources.tables import table

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def _col(name: str) -> Column:
    """A column by its name, whatever signs it holds."""
    return F.col("`" + name.replace("`", "``") + "`")


def _columns(names: list[str]) -> list[Column]:
    return [_col(c) for c in names]


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    scored = toxicity.toxicity(docs, table(spark, sf_dir, "labels"), keyed=True)
    key = fresh(docs.columns, "_key")
    # Rows of a repeated or null id may hold different texts: each goes by its own.
    # Written first: the texts do not move while the scoring tasks hold their index, and the join knows the keys' size.
    rejected = stage(scored.where(F.col("predicted") == 1).select(F.col("row_key").alias(key)).distinct())
    return docs.withColumn(key, row_key()).join(rejected, key, "left_anti").select(*_columns(docs.columns))


def near_duplicates_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    columns, key, row = docs.columns, fresh(docs.columns, "_key"), fresh(docs.columns, "_row")
    kept = simhash.representatives(docs).withColumnRenamed("row_key", key)
    # Repeats of a row differ in other columns only; the least hash of those stays, so a rerun keeps the same.
    # Only what stays is grouped, and the partial aggregate leaves one row a task before anything is shuffled.
    order = F.xxhash64(*[_col(f.name) if isinstance(f.dataType, AtomicType) else _col(f.name).cast("string")
                         for f in docs.schema.fields])
    once = (docs.withColumn(key, row_key()).join(kept, key, "left_semi")
            .groupBy(key).agg(F.min_by(F.struct(*_columns(columns)), order).alias(row)))
    return once.select(*[F.col(row)[c].alias(c) for c in columns])


def secrets_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    found = secret_scan.spans_by_blob(secret_scan.scan(docs, secret_scan.new_ledger(spark)))
    blob, spans = fresh(docs.columns, "_blob"), fresh(docs.columns, "_spans")
    places = found.select(F.col("blob").alias(blob), F.transform(
        "found", lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"))).alias(spans))
    rows = docs.withColumn(blob, secret_scan.blob_id(F.col("text"))).join(places, blob, "left")
    masked = F.when(F.col(spans).isNull(), F.col("text")).otherwise(secret_scan.mask(F.col("text"), F.col(spans)))
    length = fresh([*docs.columns, blob, spans], "_length")
    changed = rows.withColumn("text", masked).withColumn(length, F.length("text"))
    out = []
    for f in docs.schema.fields:
        own = _col(f.name)
        out.append(F.when(F.col(spans).isNull(), own).otherwise(F.col(length)).cast(f.dataType).alias(f.name)
                   if f.name == "n_chars" else own)
    return changed.select(*out)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    columns = docs.columns
    names = {n: fresh(columns, f"_{n}") for n in ("doc", "source", "digest", "least", "more", "rows", "part", "nth", "before", "copies", "copy")}
    doc, source, digest, least, more, rows, part, nth, before, copies, copy = names.values()
    mixed = mixing.mix(docs)
    # Of a row's repeats all are taken ``least`` times and ``more`` of them once more.
    taken = (mixed.groupBy("doc_id", "source", "digest")
             .agg(F.min("copies").alias(least), F.sum("copies").alias(copies), F.count(F.lit(1)).alias(rows))
             .where(F.col(copies) > 0)
             .select(F.col("doc_id").alias(doc), F.col("source").alias(source), F.col("digest").alias(digest), least,
                     (F.col(copies) - F.col(least) * F.col(rows)).alias(more), rows))
    text = F.coalesce(_col("text").cast("string"), F.lit(""))
    both = docs.join(taken, _col("doc_id").cast("long").eqNullSafe(F.col(doc)) & _col("source").cast("string").eqNullSafe(F.col(source))
                     & (F.md5(text.cast("binary")) == F.col(digest)))
    alone = both.where(F.col(rows) == 1).withColumn(copies, F.col(least) + F.col(more))
    # Repeats are numbered within parts of a hash of their other columns, and parts by their counts, so however many
    # rows repeat one, no task holds them all.
    again = both.where(F.col(rows) > 1).withColumn(part, F.pmod(F.xxhash64(*[
        _col(f.name) if isinstance(f.dataType, AtomicType) else _col(f.name).cast("string") for f in docs.schema.fields],
        F.monotonically_increasing_id()), F.lit(4096)))
    again = stage(again)
    key = [doc, source, digest]
    counts = again.groupBy(*key, part).agg(F.count(F.lit(1)).alias(before))
    upto = Window.partitionBy(*key).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.withColumn(before, F.coalesce(F.sum(before).over(upto), F.lit(0)))
    other = starts.select(*[F.col(c).alias(c + "_of") for c in (*key, part)], before)
    same = F.col(part) == F.col(part + "_of")
    for c in key:
        same = same & F.col(c).eqNullSafe(F.col(c + "_of"))
    placed = (again.withColumn(nth, F.row_number().over(Window.partitionBy(*key, part).orderBy(F.lit(0))))
              .join(other, same)
              .withColumn(copies, F.col(least) + F.when(F.col(nth) + F.col(before) <= F.col(more), 1).otherwise(0)))
    both = alone.select(*_columns(columns), copies).unionByName(placed.select(*_columns(columns), copies)).where(F.col(copies) > 0)
    return (both.withColumn(copy, F.explode(F.sequence(F.lit(1), F.col(copies).cast("int"))))
            .select(*_columns(columns)))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack_documents(docs)


STAGES: list[tuple[str, Stage]] = [
    ("toxicity", toxicity_stage),
    ("near_duplicates", near_duplicates_stage),
    ("secrets", secrets_stage),
    ("mixing", mixing_stage),
    ("packing", packing_stage),
]

#: Tokenizing, SimHash and the classifier have no SQL form; tests compare with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, step in STAGES[:-1]:
        docs = stage(step(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
