"""URL filter: host rules first, gradient-boosted trees on lexical features for the rest.

Rules name a host and a path; the longest that fits decides. URLs that a rule decides are the
labelled ones: at most ``sample`` of them, drawn by a hash of the row (the documented bound of the
fit), train Spark ML's boosted trees on lexical features: lengths, depths, digit ratio, entropy,
parameter and sign counts, and statistics of the host's last label, without a port (its share of all pages and,
smoothed, how often labelled pages under it are blocked). A labelled url's own fold (a fifth of the urls, by hash) does not
count in its statistics, so that the trees do not learn to read their target from it. Everything is DataFrame
functions and a JVM model.

``held_out`` tells how well the method judges urls of a fold that it has not seen.

Defined results: a null url, or one without ``://``, has empty host and path, fits no rule and is
judged by the method; without labelled URLs the verdict is allow, with one class it is that class's;
repeated rows are judged each; an empty table gives an empty result; only page_id and url are read.
"""

from __future__ import annotations

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from auditspark.llm.common import stage

#: Fixed by the contract: rule and verdict.
RULES = {"net/": "block", "example.net/en/": "allow", "example.com/de/": "block", "org/fr/": "allow"}
SAMPLE = 20_000
FOLDS = 5

FEATURES = ["url_chars", "host_chars", "path_chars", "host_depth", "path_depth", "digit_ratio", "entropy",
            "parameters", "hyphens", "signs", "suffix_share", "suffix_blocked"]


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host: after the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; path: then up to
    ``?``, ``#`` or the end."""
    there = F.coalesce(F.instr(url, "://"), F.lit(0)) > 0
    after = F.when(there, F.expr("substring(url, instr(url, '://') + 3)")).otherwise(F.lit(""))
    host = F.regexp_extract(after, r"^[^/?#]*", 0)
    path = F.regexp_extract(after, r"^[^/?#]*([^?#]*)", 1)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), path


def fits(rule: str) -> Column:
    host, _, path = rule.partition("/")
    return (((F.col("host") == host) | F.col("host").endswith("." + host)) & F.col("path").startswith("/" + path))


def longest_rule(rules: dict[str, str]) -> Column:
    out = F.lit(None).cast("string")
    for rule in sorted(rules, key=lambda r: (len(r), r)):
        out = F.when(fits(rule), F.lit(rule)).otherwise(out)
    return out


def entropy(text: Column) -> Column:
    """Shannon entropy of the characters, in bits."""
    n = F.length(text).cast("double")
    share = lambda c: (n - F.length(F.replace(text, c, F.lit("")))) / n
    chars = F.array_distinct(F.filter(F.split(text, ""), lambda c: c != ""))
    return F.aggregate(chars, F.lit(0.0), lambda total, c: total - share(c) * F.log2(share(c)))


def count_of(text: Column, pattern: str) -> Column:
    return F.regexp_count(text, F.lit(pattern)).cast("double")


def with_features(pages: DataFrame) -> DataFrame:
    url = F.coalesce(F.col("url"), F.lit(""))
    chars = F.length(url).cast("double")
    return (pages.withColumns({
        "url_chars": chars, "host_chars": F.length("host").cast("double"), "path_chars": F.length("path").cast("double"),
        "host_depth": count_of(F.col("host"), r"\."), "path_depth": count_of(F.col("path"), "/"),
        "digit_ratio": F.when(chars > 0, count_of(url, "[0-9]") / chars).otherwise(F.lit(0.0)),
        "entropy": entropy(url), "parameters": count_of(url, r"[?&][^=&#]+="), "hyphens": count_of(url, "-"),
        "signs": count_of(url, r"[%_~@!;]"), "suffix": F.substring_index(F.regexp_replace("host", r":[0-9]*$", ""), ".", -1)}))


def _fold() -> Column:
    """By the url alone: copies of a url are in one fold."""
    return F.pmod(F.xxhash64(F.coalesce("url", F.lit(""))), F.lit(FOLDS)).cast("int")


def _table(pages: DataFrame, rules: dict[str, str], unseen: int | None = None) -> DataFrame:
    """Every page with its rule, label (null if no rule decides, or in the fold ``unseen``) and features, written."""
    raw = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"))
    host, path = host_and_path(F.col("url"))
    split = raw.withColumns({"host": host, "path": path, "fold": _fold()}).withColumn("rule", longest_rule(rules))
    truth = F.col("rule").isin([r for r, v in rules.items() if v == "block"]).cast("double")
    seen = truth if unseen is None else F.when(F.col("fold") != unseen, truth)
    return stage(with_features(split).withColumns({"label": seen, "truth": truth}))


def _predicted(table: DataFrame, sample: int) -> DataFrame:
    """``table`` with ``method``: the trees' verdict."""
    by_fold = stage(table.groupBy("suffix", "fold").agg(
        F.count("*").alias("pages"), F.count("label").alias("labelled"), F.coalesce(F.sum("label"), F.lit(0.0)).alias("blocked")))
    seen = by_fold.agg(F.coalesce(F.sum("pages"), F.lit(0)).alias("n"), F.coalesce(F.sum("labelled"), F.lit(0)).alias("m"),
                       F.coalesce(F.sum("blocked"), F.lit(0.0)).alias("b")).first()
    rate = seen["b"] / seen["m"] if seen["m"] else 0.0
    whole = by_fold.groupBy(F.col("suffix").alias("of_suffix")).agg(
        F.sum("pages").alias("all_pages"), F.sum("labelled").alias("all_labelled"), F.sum("blocked").alias("all_blocked"),
        F.map_from_entries(F.collect_list(F.struct("fold", F.struct("labelled", "blocked")))).alias("folds"))  # at most FOLDS

    def smoothed(blocked: Column, labelled: Column) -> Column:
        return (blocked + 10 * rate) / (labelled + 10)

    own = F.element_at("folds", F.col("fold"))
    apart = smoothed(F.col("all_blocked") - own["blocked"], F.col("all_labelled") - own["labelled"])
    full = table.join(whole, F.col("suffix") == F.col("of_suffix")).withColumns({
        "suffix_share": F.col("all_pages") / max(seen["n"], 1),
        "suffix_blocked": F.when(F.col("label").isNotNull(), apart).otherwise(smoothed(F.col("all_blocked"), F.col("all_labelled")))})
    if 0 < seen["b"] < seen["m"]:
        assembler = VectorAssembler(inputCols=FEATURES, outputCol="features")
        drawn = stage(full.where(F.col("label").isNotNull()).orderBy(F.xxhash64("page_id", "url"), "page_id").limit(sample)
                      .select("label", *FEATURES))
        model = GBTClassifier(maxIter=15, maxDepth=4, stepSize=0.2, seed=3).fit(assembler.transform(drawn))
        return model.transform(assembler.transform(full)).withColumn(
            "method", F.when(F.col("prediction") >= 0.5, F.lit("block")).otherwise(F.lit("allow")))
    return full.withColumn("method", F.lit("block" if seen["m"] and seen["b"] == seen["m"] else "allow"))


def judge(pages: DataFrame, rules: dict[str, str] = RULES, sample: int = SAMPLE) -> DataFrame:
    """page_id, url, host, path, rule and verdict of every row of ``pages``."""
    judged = _predicted(_table(pages, rules), sample)
    by_rule = F.create_map(*[F.lit(x) for pair in rules.items() for x in pair])
    return judged.select("page_id", "url", "host", "path", "rule",
                         F.coalesce(F.element_at(by_rule, F.col("rule")), F.col("method")).alias("verdict"))


def held_out(pages: DataFrame, rules: dict[str, str] = RULES, sample: int = SAMPLE, fold: int = 0) -> DataFrame:
    """truth, verdict of the method and n: of the urls that rules decide, those of one fold, without their labels."""
    judged = _predicted(_table(pages, rules, fold), sample)
    return (judged.where((F.col("fold") == fold) & F.col("truth").isNotNull())
            .groupBy(F.when(F.col("truth") == 1, F.lit("block")).otherwise(F.lit("allow")).alias("truth"), "method")
            .agg(F.count(F.lit(1)).alias("n")))
