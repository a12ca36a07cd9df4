"""Mixing sources to target weights by Pareto order sampling.

A source's target is its weight's share of all words, capped at ``max_copies`` times its own
words; the excess goes to the others by weight until none is above. Of target / words, the whole
part is certain: every document is taken that many times. For the fraction p documents are drawn with unequal
probabilities: a document's inclusion odds are p / (1 - p) times the square root of its words over the source's
mean, so that whole texts are a little likelier than scraps of a few words. Documents are ranked by
random odds over inclusion odds, ``(u / (1 - u)) / odds``, and the prefix of that ranking whose words
come nearest the rest of the target is taken once more. The sample size in words is thus fixed, not random.

u comes from doc_id, text and, for exact repeats, the number among these: every row is an item of its own, also
rows of a null or repeated doc_id, and reruns agree on any partitioning.

The ranking is never sorted as a whole. Its order statistic is mapped to (0, 1) and cut into equal ranges;
word totals per (source, range) find the one range in which a source's prefix ends, and only that
range is ranked.

Defined results: a null text has size 0; null sources form one source, ordered last; a source
without words has target 0 and gives nothing; a text without words has the odds of one word; ties in the
ranking go by doc_id (null first), text digest and repeat; rows that differ only in other columns are repeats; an
empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from auditspark.llm.common import stage

#: Fixed by the contract.
WEIGHTS = (5, 2, 1)
MAX_COPIES = 3
WORD = r"[^\x20\x09-\x0D]+"
SEED = 20240917
#: Rows that one range of draws holds on average.
RANGE_ROWS = 4096
#: Exact repeats of a row that are numbered in one place.
REPEATS = 65_536


def word_sizes(docs: DataFrame) -> DataFrame:
    """doc_id, source, digest of the text and size in words of each row."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"),
                       F.md5(text.cast("binary")).alias("digest"),
                       F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"))


def numbered(sizes: DataFrame) -> DataFrame:
    """``sizes`` with ``rep``, the number among exact repeats from 1: repeats are counted, not sorted, and a
    row that a third of the table repeats is written out in blocks by many tasks."""
    counted = stage(sizes.groupBy("source", "doc_id", "digest").agg(F.first("size").alias("size"), F.count(F.lit(1)).alias("_n")))
    blocks = F.sequence(F.lit(0).cast("long"), F.floor((F.col("_n") - 1) / REPEATS))
    rows = counted.withColumn("_b", F.explode(blocks))
    if not counted.where(F.col("_n") > REPEATS).isEmpty():
        rows = rows.repartition("source", "doc_id", "digest", "_b")
    first = F.col("_b") * REPEATS
    return (rows.withColumn("rep", F.explode(F.sequence(first + 1, F.least(first + REPEATS, F.col("_n")))))
            .select("source", "doc_id", "digest", "size", "rep"))


def source_targets(sizes: DataFrame, weights=WEIGHTS, max_copies: int = MAX_COPIES) -> DataFrame:
    """One row per source: its words, target, certain whole copies and the fraction left.

    Capping in rounds ends in ``least(cap, weight * level)`` for one water level. With the sources
    ordered by cap / weight, the level after capping the first k is (all - caps of the first k) /
    (weights of the rest), and the final one is the largest of these. The windows run over one row
    per source."""
    by = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("rows"))
    order = Window.orderBy(F.col("source").asc_nulls_last())
    ranked = (by.withColumn("rk", F.row_number().over(order) - 1)
              .withColumn("weight", F.element_at(F.array(*map(F.lit, weights)),
                                                 (F.col("rk") % len(weights) + 1).cast("int")).cast("double"))
              .withColumn("cap", (F.col("source_size") * max_copies).cast("double")))
    fill = Window.orderBy(F.col("cap") / F.col("weight"), "rk")
    everything = Window.orderBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    level = ((F.sum("source_size").over(everything).cast("double")
              - F.coalesce(F.sum("cap").over(fill.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
             / F.sum("weight").over(fill.rowsBetween(Window.currentRow, Window.unboundedFollowing)))
    target = F.least(F.col("cap"), F.col("weight") * F.max("level").over(everything))
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    return (ranked.withColumn("level", level).withColumn("target", target)
            .withColumn("copies", F.floor(ratio).cast("long"))
            .withColumn("p", ratio - F.floor(ratio))
            .withColumn("rest", F.col("target") - F.col("copies") * F.col("source_size"))
            .select("source", "source_size", "rows", "target", "copies", "p", "rest"))


def draw(seed: int):
    """48 random bits of (seed, doc_id, text, repeat) as a number strictly between 0 and 1."""
    text = F.concat_ws(":", F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), "digest", "rep")
    bits = F.conv(F.substring(F.md5(text), 1, 12), 16, 10).cast("long")
    return (bits.cast("double") + 0.5) / float(1 << 48)


def lean():
    """A document's inclusion odds relative to the source's mean document."""
    return F.sqrt(F.greatest(F.col("size"), F.lit(1)) / (F.greatest(F.col("source_size"), F.lit(1)) / F.col("rows")))


def mix(docs: DataFrame, weights=WEIGHTS, max_copies: int = MAX_COPIES, seed: int = SEED) -> DataFrame:
    """doc_id, source, digest (of the text), size, source_size, target, copies and taken (copies * size) of every row of
    ``docs``."""
    sizes = stage(word_sizes(docs))
    targets = stage(source_targets(sizes, weights, max_copies))
    ranges = 1 << max(6, math.ceil(math.log2(max(1, sizes.count()) / RANGE_ROWS)))
    u, p = F.col("u"), F.col("p")
    of = targets.withColumnRenamed("source", "of_source")
    drawn = (numbered(sizes).withColumn("u", draw(seed))
             .join(of, F.col("source").eqNullSafe(F.col("of_source"))).drop("of_source")
             .withColumn("q", F.when(p > 0, (u / (1 - u)) / (p / (1 - p) * lean()))))
    # The ranking without its factor p / (1 - p) spreads about evenly over (0, 1); ranges follow its order.
    spread = F.col("q") * (p / (1 - p))
    drawn = drawn.withColumn("range", F.least(F.floor(spread / (1 + spread) * ranges), F.lit(ranges - 1)))

    # The range in which each source's prefix ends: the first whose end reaches the rest.
    totals = (drawn.where(p > 0).groupBy("source", "range")
              .agg(F.sum("size").alias("words"), F.first("rest").alias("rest")))
    so_far = Window.partitionBy("source").orderBy("range")
    ends = (totals.withColumn("upto", F.sum("words").over(so_far))
            .where(F.col("upto") >= F.col("rest"))
            .groupBy("source").agg(F.min_by(F.struct("range", (F.col("upto") - F.col("words")).alias("before")), "range")
                                   .alias("end"))
            .select(F.col("source").alias("end_source"), F.col("end.range").alias("end_range"),
                    F.col("end.before").alias("before")))
    at_end = drawn.join(ends, drawn["source"].eqNullSafe(ends["end_source"])
                        & (drawn["range"] == ends["end_range"]))
    place = F.struct("q", "doc_id", "digest", "rep")
    ranking = Window.partitionBy("source").orderBy("q", F.col("doc_id").asc_nulls_first(), "digest", "rep")
    upto = F.col("before") + F.sum("size").over(ranking.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    cuts = (at_end.withColumn("upto", upto)
            # A prefix with w words before and w' after a document is nearer with it if w + w' <= 2 * rest.
            .where(2 * F.col("upto") - F.col("size") <= 2 * F.col("rest"))
            .groupBy("source").agg(F.max(place).alias("last"))
            .select(F.col("source").alias("cut_source"), "last"))
    limits = stage(ends.join(cuts, ends["end_source"].eqNullSafe(cuts["cut_source"]), "left")
                   .select("end_source", "end_range", "last"))
    inside = ((F.col("range") < F.col("end_range"))
              | ((F.col("range") == F.col("end_range")) & F.col("last").isNotNull() & (place <= F.col("last"))))
    extra = F.when(F.coalesce(inside & (p > 0), F.lit(False)), F.lit(1)).otherwise(F.lit(0))
    return (drawn.join(limits, drawn["source"].eqNullSafe(limits["end_source"]), "left")
            .withColumn("copies", F.col("copies") + extra)
            .select("doc_id", "source", "digest", "size", "source_size", "target", "copies",
                    (F.col("copies") * F.col("size")).alias("taken")))


#: DuckDB SQL of the same mix, over the table ``documents``.
MIX_SQL = rf"""
WITH sized AS (
  SELECT CAST(doc_id AS BIGINT) AS doc_id, source, md5(coalesce(text, '')) AS digest,
         CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size
  FROM documents
), numbered AS (
  SELECT *, row_number() OVER (PARTITION BY source, doc_id, digest) AS rep FROM sized
), src AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size, count(*) AS rows FROM sized GROUP BY source
), ranked AS (
  SELECT *, CAST([{", ".join(map(str, WEIGHTS))}][(rk % {len(WEIGHTS)}) + 1] AS DOUBLE) AS weight,
         CAST(source_size * {MAX_COPIES} AS DOUBLE) AS cap
  FROM (SELECT *, CAST(row_number() OVER (ORDER BY source NULLS LAST) - 1 AS BIGINT) AS rk FROM src)
), levels AS (
  SELECT *, (CAST(sum(source_size) OVER () AS DOUBLE)
             - coalesce(sum(cap) OVER (ORDER BY cap / weight, rk ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0))
            / sum(weight) OVER (ORDER BY cap / weight, rk ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS lvl
  FROM ranked
), targets AS (
  SELECT source, source_size, rows, least(cap, weight * max(lvl) OVER ()) AS target FROM levels
), shares AS (
  SELECT *, CASE WHEN source_size > 0 THEN target / source_size ELSE 0.0 END AS ratio FROM targets
), drawn AS (
  SELECT d.doc_id, d.source, d.digest, d.rep, d.size, t.source_size, t.target, CAST(floor(t.ratio) AS BIGINT) AS copies,
         t.ratio - floor(t.ratio) AS p, t.target - floor(t.ratio) * t.source_size AS rest,
         sqrt(CAST(greatest(d.size, 1) AS DOUBLE) / (CAST(greatest(t.source_size, 1) AS DOUBLE) / CAST(t.rows AS DOUBLE))) AS lean,
         (CAST(CAST('0x' || substr(md5('{SEED}:' || coalesce(CAST(d.doc_id AS VARCHAR), '') || ':' || d.digest || ':'
                                       || CAST(d.rep AS VARCHAR)), 1, 12) AS BIGINT) AS DOUBLE) + 0.5) / 281474976710656.0 AS u
  FROM numbered d JOIN shares t ON d.source IS NOT DISTINCT FROM t.source
), odds AS (
  SELECT *, CASE WHEN p > 0 THEN (u / (1 - u)) / (p / (1 - p) * lean) END AS q FROM drawn
), cum AS (
  SELECT *, sum(size) OVER (PARTITION BY source ORDER BY q, doc_id NULLS FIRST, digest, rep
                            ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto
  FROM odds
)
SELECT doc_id, size, source_size, target,
       CAST((copies + CASE WHEN p > 0 AND 2 * upto - size <= 2 * rest THEN 1 ELSE 0 END) * size AS BIGINT) AS taken
FROM cum
"""
