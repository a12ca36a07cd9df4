"""Brand tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from auditspark.functions import rsem
from auditspark.operators import aggregates, joins, resolve
from auditspark.plans import audit
from auditspark.plans.queries.attribution import _SHARES_SQL
from auditspark.plans.registry import query
from auditspark.sources.tables import Tables

OUT_DIGITS = 6

PROCESSED_COLS = [
    "brand_name", "parent_company_name", "id", "validated", "submission_type", "submission_id", "year",
    "type_product", "type_material", "layer", "city", "province", "country", "continent",
    "specifics_of_audit", "event_total_count", "event_id", "total_count", "proportion",
]


def processed(t: Tables) -> DataFrame:
    """The cleaned item table with the reference's column names."""
    return audit.clean_items(t).select(*PROCESSED_COLS)


def brand_company_table(items: DataFrame) -> DataFrame:
    """A7 + W1 (L5): brand -> company table in three levels.

    (brand, company, id, status) sums and counts; then one row per (brand,
    status) with its number of companies, and the companies and ids
    string-aggregated in (company, id) order. The rows gathered per group are
    distinct (company, id) pairs, not items."""
    g1 = (items.groupBy("brand_name", "parent_company_name", "id", "validated")
          .agg(F.sum("total_count").alias("brand_total_count"),
               F.count(F.lit(1)).alias("brand_frequency")))
    pair = F.struct(F.col("parent_company_name").alias("p"), F.col("id").alias("i"))
    g2 = (g1.groupBy("brand_name", "validated")
          .agg(F.array_sort(F.collect_list(pair)).alias("_l"), F.count(F.lit(1)).alias("brand_parent_occurances"),
               F.sum("brand_total_count").alias("brand_total_count"),
               F.sum("brand_frequency").alias("brand_frequency")))
    return g2.select(
        "brand_name", "validated", "brand_parent_occurances",
        F.array_join(F.transform("_l", lambda s: rsem.na_text(s["p"])), ", ").alias("parent_company_name"),
        F.array_join(F.transform("_l", lambda s: rsem.na_text(s["i"])), ", ").alias("id"),
        "brand_total_count", "brand_frequency")


_BC_SQL = (("bc1", """
    SELECT brand_name, parent_company_name, id, validated, CAST(SUM(total_count) AS BIGINT) AS brand_total_count,
           COUNT(*) AS brand_frequency FROM clean GROUP BY brand_name, parent_company_name, id, validated"""),
           ("bc2", """
    SELECT *, COUNT(*) OVER (PARTITION BY brand_name, validated) AS brand_parent_occurances FROM bc1"""),
           ("bc", """
    SELECT brand_name, validated, brand_parent_occurances,
      string_agg(COALESCE(parent_company_name, 'NA'), ', ' ORDER BY parent_company_name, id) AS parent_company_name,
      string_agg(COALESCE(id, 'NA'), ', ' ORDER BY parent_company_name, id) AS id,
      CAST(SUM(brand_total_count) AS BIGINT) AS brand_total_count, CAST(SUM(brand_frequency) AS BIGINT) AS brand_frequency
    FROM bc2 GROUP BY brand_name, validated, brand_parent_occurances"""))


def _bc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return brand_company_table(processed(Tables(spark, sf_dir)))


@query("brand_company_table", audit.sql("SELECT * FROM bc", *_BC_SQL))
def q_brand_company_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A7 + W1: ``brand_company_id``."""
    return _bc(spark, sf_dir)


@query("string_agg_sorted", audit.sql("""
SELECT event_id, string_agg(DISTINCT brand_name, ', ' ORDER BY brand_name) AS brands FROM clean GROUP BY event_id"""))
def q_string_agg_sorted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``toString(unique(brand_name))`` per event, sorted. The distinct
    form keeps every cell bounded by the number of brands, even for an audit
    that holds a third of all items (``keep_duplicates=True`` repeats values)."""
    return aggregates.to_string_agg(processed(Tables(spark, sf_dir)), ["event_id"], "brand_name", "brands",
                                    keep_duplicates=False)


def _key_table(t: Tables) -> DataFrame:
    """``key-for-review``: one row per part - brand, proposed name, id, count."""
    p = t.part
    brand_no = F.substring("p_brand", 7, 8).cast("int")
    return p.select(F.col("p_name").alias("brand_name"), F.lower("p_brand").alias("new_name"),
                    F.concat(F.lit("q"), (brand_no + 100).cast("string")).alias("id"),
                    F.col("p_size").cast("bigint").alias("sum"))


def brand_key_review(key_table: DataFrame, items: DataFrame) -> DataFrame:
    """A6 (L11): per brand the distinct proposed (name, id) pairs string-aggregated,
    so the n-th id belongs to the n-th name, and the counts summed, then the
    distinct countries the brand was found in, sorted.
    The reference's fan-out join repeats a country once per item; the distinct
    list carries the same information in a cell bounded by the number of
    countries instead of the brand's item count."""
    pairs = key_table.groupBy("brand_name", "new_name", "id").agg(F.sum("sum").alias("sum"))
    k = (pairs.groupBy("brand_name")
         .agg(F.array_sort(F.collect_list(F.struct("new_name", "id"))).alias("_l"), F.sum("sum").alias("sum"))
         .select("brand_name",
                 F.array_join(F.transform("_l", lambda s: rsem.na_text(s["new_name"])), ", ").alias("parent_company_name"),
                 F.array_join(F.transform("_l", lambda s: rsem.na_text(s["id"])), ", ").alias("id"), "sum"))
    countries = aggregates.to_string_agg(items.select("brand_name", "country"), ["brand_name"], "country",
                                         "country", keep_duplicates=False)
    return k.join(countries, "brand_name", "left").withColumn(
        "country", F.coalesce(F.col("country"), F.lit("NA")))


@query("brand_key_review", audit.sql("""
SELECT k.brand_name, k.parent_company_name, k.id, k.sum, COALESCE(c.country, 'NA') AS country
FROM (SELECT brand_name, string_agg(new_name, ', ' ORDER BY new_name, id) AS parent_company_name,
             string_agg(id, ', ' ORDER BY new_name, id) AS id, CAST(SUM(sum) AS BIGINT) AS sum
      FROM (SELECT brand_name, new_name, id, SUM(sum) AS sum FROM keyt GROUP BY ALL) GROUP BY brand_name) k
LEFT JOIN (SELECT brand_name, string_agg(DISTINCT COALESCE(country, 'NA'), ', ' ORDER BY COALESCE(country, 'NA'))
             AS country FROM clean GROUP BY brand_name) c ON k.brand_name = c.brand_name""", ("keyt", """
    SELECT p_name AS brand_name, lower(p_brand) AS new_name,
           'q' || CAST(CAST(substr(p_brand, 7, 8) AS INTEGER) + 100 AS VARCHAR) AS id,
           CAST(p_size AS BIGINT) AS sum FROM part""")))
def q_brand_key_review(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``cleanup_brand_to_parent`` review table."""
    t = Tables(spark, sf_dir)
    return brand_key_review(_key_table(t), processed(t))


def _keyed(t: Tables) -> DataFrame:
    """Items keyed by (name, company): several parts share a key, each with its
    own status, so some keys carry two or three statuses."""
    return processed(t).withColumn("brand_name", F.concat_ws(" ", "brand_name", "parent_company_name"))


_KEYED_SQL = ("keyed", """
    SELECT * REPLACE (brand_name || ' ' || parent_company_name AS brand_name) FROM clean""")


@query("conflicts", audit.sql("""
SELECT brand_name, validated_concat FROM (
  SELECT brand_name, string_agg(COALESCE(validated, 'NA'), ', ' ORDER BY validated) AS validated_concat
  FROM (SELECT DISTINCT brand_name, validated FROM keyed) GROUP BY brand_name)
WHERE validated_concat NOT IN ('true', 'attempted', 'false')""", _KEYED_SQL))
def q_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Brands whose statuses disagree (``test_one``)."""
    return aggregates.status_conflicts(_keyed(Tables(spark, sf_dir)))


@query("multi_id", audit.sql("""
SELECT brand_name, COUNT(*) AS count FROM (SELECT DISTINCT brand_name, id FROM clean)
GROUP BY brand_name HAVING COUNT(*) > 1"""))
def q_multi_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Brands attributed to more than one id."""
    return aggregates.multi_valued(processed(Tables(spark, sf_dir)))


@query("demote_conflicts", audit.sql("""
SELECT brand_name, validated, COUNT(*) AS n FROM (
  SELECT k.brand_name, CASE WHEN c.brand_name IS NOT NULL THEN 'false' ELSE k.validated END AS validated
  FROM keyed k LEFT JOIN (
    SELECT brand_name FROM (
      SELECT brand_name, string_agg(COALESCE(validated, 'NA'), ', ' ORDER BY validated) AS vc
      FROM (SELECT DISTINCT brand_name, validated FROM keyed) GROUP BY brand_name)
    WHERE vc NOT IN ('true', 'attempted', 'false')) c ON k.brand_name IS NOT DISTINCT FROM c.brand_name)
GROUP BY brand_name, validated""", _KEYED_SQL))
def q_demote_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A10: brands with conflicting statuses are set to "false"."""
    k = _keyed(Tables(spark, sf_dir))
    d = aggregates.demote_conflicts(k, aggregates.status_conflicts(k))
    return aggregates.count_rows(d, ["brand_name", "validated"], "n")


_COLLAPSE_KEYS = [c for c in PROCESSED_COLS if c not in ("total_count", "proportion")]


@query("collapse_duplicates", audit.sql(f"""
SELECT {", ".join(_COLLAPSE_KEYS)}, CAST(SUM(total_count) AS BIGINT) AS total_count,
       round(SUM(total_count) / CAST(event_total_count AS DOUBLE), 6) AS proportion
FROM clean GROUP BY {", ".join(_COLLAPSE_KEYS)}"""))
def q_collapse_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A5: rows equal on every attribute are merged, count summed, share recomputed."""
    c = aggregates.collapse_duplicates(processed(Tables(spark, sf_dir)))
    return c.withColumn("proportion", F.round("proportion", OUT_DIGITS))


@query("share_breakdown", audit.sql("""
SELECT validated, total, n, round(total / CAST(SUM(total) OVER () AS DOUBLE), 6) AS prop_count,
       round(n / CAST(SUM(n) OVER () AS DOUBLE), 6) AS prop_n
FROM (SELECT validated, CAST(SUM(brand_total_count) AS BIGINT) AS total, CAST(SUM(brand_frequency) AS BIGINT) AS n
      FROM bc GROUP BY validated)""", *_BC_SQL))
def q_share_breakdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals and shares by validation status."""
    b = aggregates.group_breakdown(_bc(spark, sf_dir), ["validated"],
                                   {"total": "brand_total_count", "n": "brand_frequency"},
                                   {"prop_count": "total", "prop_n": "n"})
    return b.withColumns({c: F.round(c, OUT_DIGITS) for c in ("prop_count", "prop_n")})


@query("priority_breakdown", audit.sql("""
SELECT priority, sum_count, sum_freq, round(sum_count / CAST(SUM(sum_count) OVER () AS DOUBLE), 6) AS prop_count,
       round(sum_freq / CAST(SUM(sum_freq) OVER () AS DOUBLE), 6) AS prop_freq
FROM (SELECT brand_total_count > 100 AND brand_frequency > 10 AS priority,
             CAST(SUM(brand_total_count) AS BIGINT) AS sum_count, CAST(SUM(brand_frequency) AS BIGINT) AS sum_freq
      FROM parts GROUP BY 1)""", ("parts", """
    SELECT SUM(total_count) AS brand_total_count, COUNT(*) AS brand_frequency FROM clean GROUP BY p_partkey""")))
def q_priority_breakdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    """C31 + A24/M9: share of items and occurrences above the review threshold,
    each part a brand of its own, so that both sides of the threshold occur."""
    items = audit.clean_items(Tables(spark, sf_dir))
    items = items.withColumn("brand_name", F.concat_ws(" ", "brand_name", F.col("p_partkey").cast("string")))
    b = brand_company_table(items).withColumn(
        "priority", (F.col("brand_total_count") > 100) & (F.col("brand_frequency") > 10))
    out = aggregates.group_breakdown(b, ["priority"], {"sum_count": "brand_total_count",
                                                       "sum_freq": "brand_frequency"},
                                     {"prop_count": "sum_count", "prop_freq": "sum_freq"})
    return out.withColumns({c: F.round(c, OUT_DIGITS) for c in ("prop_count", "prop_freq")})


@query("worklist", audit.sql("""
SELECT * FROM bc WHERE brand_frequency > 10 AND validated = 'false' AND brand_total_count > 100""", *_BC_SQL))
def q_worklist(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S7 + C31 + F5 (L5): brands still needing review (``todo`` export)."""
    b = _bc(spark, sf_dir)
    return b.filter((F.col("brand_frequency") > 10) & (F.col("validated") == "false")
                    & (F.col("brand_total_count") > 100))


def _entity_ids(t: Tables) -> DataFrame:
    """Ids as the dictionary holds them: entity codes (one or two per id) and
    links taken from the crawled pages."""
    p = t.part
    key = F.col("p_partkey")
    code = F.concat(F.lit("q"), (key + 10).cast("string"),
                    F.when(F.col("p_size") > 45, F.concat(F.lit("q"), (key + 11).cast("string")))
                    .otherwise(F.lit("")))
    return p.select(code.alias("id")).unionByName(t.pages.select(F.col("url").alias("id")))


def _entity_table(t: Tables) -> DataFrame:
    p = t.part.filter(F.col("p_size") <= 40)
    return p.select(F.concat(F.lit("q"), (F.col("p_partkey") + 10).cast("string")).alias("id"),
                    F.lower("p_name").alias("label"))


_ENTITY_SQL = (
    ("eids", """
    SELECT 'q' || CAST(p_partkey + 10 AS VARCHAR) ||
           CASE WHEN p_size > 45 THEN 'q' || CAST(p_partkey + 11 AS VARCHAR) ELSE '' END AS id FROM part
    UNION ALL SELECT url AS id FROM pages"""),
    ("etab", """
    SELECT 'q' || CAST(p_partkey + 10 AS VARCHAR) AS id, lower(p_name) AS label FROM part WHERE p_size <= 40"""),
)


@query("entity_labels", "WITH " + ",\n".join(f"{n} AS ({q})" for n, q in _ENTITY_SQL) + r""",
ids AS (SELECT DISTINCT id FROM eids WHERE regexp_matches(id, 'q(\d{2,})') AND NOT contains(id, 'http')),
codes AS (SELECT id, unnest(l) AS code, generate_subscripts(l, 1) AS pos
          FROM (SELECT id, regexp_extract_all(id, 'q(\d{2,})', 0) AS l FROM ids)),
named AS (SELECT c.id, CASE WHEN COUNT(e.label) = COUNT(*) THEN string_agg(e.label, ', ' ORDER BY c.pos) END AS nm
          FROM codes c LEFT JOIN etab e ON e.id = c.code GROUP BY c.id)
SELECT ids.id, COALESCE(named.nm, ids.id) AS name FROM ids LEFT JOIN named ON named.id = ids.id""")
def q_entity_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """C26 + X5: ``wikidata_ids2`` - every entity code of an id mapped to its
    label, joined with ", "; an id with an unknown code keeps itself."""
    t = Tables(spark, sf_dir)
    return resolve.entity_labels(_entity_ids(t), _entity_table(t))


@query("lookup_worklist", "WITH " + ",\n".join(f"{n} AS ({q})" for n, q in _ENTITY_SQL) + r"""
SELECT DISTINCT id FROM eids WHERE regexp_matches(id, 'q(\d{2,})') AND NOT contains(id, 'http')
  AND id NOT IN (SELECT id FROM etab)""")
def q_lookup_worklist(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entity ids that are not in the label table yet."""
    t = Tables(spark, sf_dir)
    return resolve.lookup_worklist(_entity_ids(t), _entity_table(t))


@query("pseudonymize", """
SELECT c_custkey, c_nationkey,
       dense_rank() OVER (ORDER BY c_name) AS c_name,
       CASE WHEN seg IS NULL THEN NULL ELSE dense_rank() OVER (ORDER BY seg) END AS c_mktsegment
FROM (SELECT c_custkey, c_nationkey, c_name, nullif(c_mktsegment, 'BUILDING') AS seg FROM customer)""")
def q_pseudonymize(spark: SparkSession, sf_dir: str) -> DataFrame:
    """C28 (L12): drop the identifying column, replace names by the dense code of
    their sorted value; NA stays NA."""
    c = Tables(spark, sf_dir).customer.select(
        "c_custkey", "c_nationkey", "c_name", "c_acctbal",
        F.nullif("c_mktsegment", F.lit("BUILDING")).alias("c_mktsegment"))
    return resolve.pseudonymize(c, ["c_acctbal"], ["c_name", "c_mktsegment"]).select(
        "c_custkey", "c_nationkey", "c_name", "c_mktsegment")


def _company_labels(t: Tables) -> DataFrame:
    """Entity labels for company ids: a label is known for the companies that
    own a large promotional part, so some companies have none."""
    brand_no = F.substring("p_brand", 7, 8).cast("int")
    known = t.part.filter((F.col("p_type") == "PROMO") & (F.col("p_size") > 45))
    return known.select(F.concat(F.lit("q"), (brand_no + 100).cast("string")).alias("id"),
                        F.concat(F.lit("company "), brand_no.cast("string")).alias("name")).distinct()


@query("label_overlay", audit.sql("""
SELECT p.id, COALESCE(l.name, p.parent_company_name) AS parent_company_name, COUNT(*) AS n
FROM clean p LEFT JOIN (
  SELECT DISTINCT 'q' || CAST(CAST(substr(p_brand, 7, 8) AS INTEGER) + 100 AS VARCHAR) AS id,
         'company ' || CAST(CAST(substr(p_brand, 7, 8) AS INTEGER) AS VARCHAR) AS name
  FROM part WHERE p_type = 'PROMO' AND p_size > 45) l ON p.id = l.id
GROUP BY p.id, COALESCE(l.name, p.parent_company_name)"""))
def q_label_overlay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J12 (+ J4): entity labels left-joined on id replace the company name
    where a label exists (``ifelse(!is.na(name), name, parent_company_name)``)."""
    t = Tables(spark, sf_dir)
    o = resolve.overlay_labels(processed(t), _company_labels(t))
    return aggregates.count_rows(o, ["id", "parent_company_name"], "n")


_TOP_SQL = (
    ("top100", """
    SELECT id, mean FROM (SELECT id, mean, rank() OVER (ORDER BY round(mean, 10) DESC) AS r FROM means)
    WHERE r <= 100"""),
    ("named", """
    SELECT DISTINCT b.parent_company_name, t.id, t.mean FROM top100 t LEFT JOIN bc b ON t.id = b.id"""),
)


def _top_named(spark: SparkSession, sf_dir: str) -> DataFrame:
    from auditspark.operators import ordered
    from auditspark.plans.queries.attribution import company_means

    m = company_means(spark, sf_dir).withColumn("_mk", F.round("mean", 10))
    top = ordered.top_with_ties(m, "_mk", 100).select("id", "mean")
    bc = _bc(spark, sf_dir).select("id", "parent_company_name")
    return joins.null_safe_join(top, bc, ["id"], "left").select("parent_company_name", "id", "mean").distinct()


@query("top_named", audit.sql("""
SELECT parent_company_name, id, round(mean, 6) AS mean FROM named""",
                               *_SHARES_SQL, *_BC_SQL, *_TOP_SQL))
def q_top_named(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O2 + O5 + J4: the 100 largest companies (ties kept) labelled with the
    brand table's names, distinct (name, id, mean)."""
    return _top_named(spark, sf_dir).withColumn("mean", F.round("mean", 6))


@query("top_above_floor", audit.sql(r"""
SELECT array_to_string(list_transform(regexp_extract_all(COALESCE(parent_company_name, id),
         '([\p{L}\p{N}''’]+|[^\p{L}\p{N}''’]+)', 1), lambda x: upper(x[1]) || lower(x[2:])), '') AS company,
       id, round(mean * 100, 6) AS mean_percent
FROM named WHERE mean > 0.01""", *_SHARES_SQL, *_BC_SQL, *_TOP_SQL))
def q_top_above_floor(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O6 + F7 + C7: named top companies above a mean share of 1 %, title-cased,
    as percent (the data behind the company chart)."""
    from auditspark.functions import rsem

    t = _top_named(spark, sf_dir).filter(F.col("mean") > 0.01)
    return t.select(rsem.title_case(F.coalesce("parent_company_name", "id")).alias("company"), "id",
                    F.round(F.col("mean") * 100, 6).alias("mean_percent"))
