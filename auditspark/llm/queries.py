"""The registered queries of the corpus operators.

Each applies its operator with production parameters to its whole table and derives the columns of
its contract from the operator's own output."""

from __future__ import annotations

from collections.abc import Callable

import corpus_pipeline
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from auditspark.llm import (conversation, fingerprint, lexical, mixing, packing, pii, quality, secret_scan,
                            sharding, simhash, topk, toxicity, urlfilter)
from auditspark.sources.tables import table


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def _joined(found: Column, named: str = "rule") -> Column:
    return F.concat_ws(",", F.transform(found, lambda s: F.concat_ws(":", s[named], s["start"], s["end"])))


def _of_kind(found: Column, kind: str, named: str = "rule") -> Column:
    return F.filter(found, lambda s: s[named] == kind)


def op3_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    scanned = secret_scan.scan_documents(table(spark, sf_dir, "documents"))
    none = F.array().cast(scanned.schema["found"].dataType)
    found = F.coalesce("found", none)
    base = F.filter(found, lambda s: s["rule"].isin(*secret_scan.BASE_KINDS))
    counts = [F.size(_of_kind(found, k)).cast("long").alias(f"n_{k}")
              for k in secret_scan.BASE_KINDS]
    return scanned.select("doc_id", *counts, F.sha2(_joined(base), 256).alias("base_sha256"),
                          _joined(found).alias("spans"), "blob")


def op4_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(table(spark, sf_dir, "documents")).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"))


def op7_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.followed_fingerprints(table(spark, sf_dir, "documents"))


def op8_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urlfilter.judge(table(spark, sf_dir, "pages")).select("page_id", "host", "path", "rule", "verdict")


def op9_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation.repair_conversations(conversation.damage(table(spark, sf_dir, "conversations")))


def op12_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op13_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.personal_data(table(spark, sf_dir, "documents"))
    base = F.filter("found", lambda s: s["rule"])
    counts = [F.size(_of_kind(base, k, "kind")).cast("long").alias(f"n_{k}") for k in pii.KINDS]
    return found.select("doc_id", *counts, F.sha2(_joined(base, "kind"), 256).alias("base_sha256"),
                        _joined(F.col("found"), "kind").alias("spans"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_best_fit_packing": op1_best_fit_packing,
    "op2_toxicity": op2_toxicity,
    "op3_secret_scans": op3_secret_scans,
    "op4_quality_classifier": op4_quality_classifier,
    "op5_mixing": op5_mixing,
    "op6_sharding": op6_sharding,
    "op7_fingerprints": op7_fingerprints,
    "op8_url_filters": op8_url_filters,
    "op9_exact_topk": op9_exact_topk,
    "op10_simhash": op10_simhash,
    "op11_conversation_repair": op11_conversation_repair,
    "op12_lexical_search": op12_lexical_search,
    "op13_pii": op13_pii,
    "pipeline": corpus_pipeline.run,
}

ORACLE: dict[str, str] = {"op5_mixing": mixing.MIX_SQL, "op9_exact_topk": topk.TOPK_SQL,
                          "op12_lexical_search": lexical.SEARCH_SQL}
if corpus_pipeline.ORACLE_SQL:
    ORACLE["pipeline"] = corpus_pipeline.ORACLE_SQL
