"""Join queries (J1, J8-J10, J13, U1, U2, P10) on orders/customer/part."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from auditspark.operators import joins, ordered
from auditspark.plans import audit
from auditspark.plans.registry import query
from auditspark.sources.tables import Tables


@query("null_safe_join", """
SELECT c.c_custkey, c.nationkey, n.n_name
FROM (SELECT c_custkey, nullif(c_nationkey, 3) AS nationkey FROM customer) c
JOIN (SELECT nullif(n_nationkey, 3) AS nationkey, n_name FROM nation) n
  ON c.nationkey IS NOT DISTINCT FROM n.nationkey""")
def q_null_safe_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """NA keys match NA keys (nation 3 is recorded as NA on both sides)."""
    t = Tables(spark, sf_dir)
    c = t.customer.select("c_custkey", F.nullif("c_nationkey", F.lit(3)).alias("nationkey"))
    n = t.nation.select(F.nullif("n_nationkey", F.lit(3)).alias("nationkey"), "n_name")
    return joins.null_safe_join(c, n, ["nationkey"]).select("c_custkey", "nationkey", "n_name")


@query("natural_join", """
SELECT o.o_orderkey, o.custkey, c.c_mktsegment, c.c_nationkey
FROM (SELECT o_orderkey, nullif(o_custkey, 7) AS custkey FROM orders) o
JOIN (SELECT nullif(c_custkey, 7) AS custkey, c_mktsegment, c_nationkey FROM customer) c
  ON o.custkey IS NOT DISTINCT FROM c.custkey""")
def q_natural_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Join on every shared column name, keys emitted once."""
    t = Tables(spark, sf_dir)
    o = t.orders.select("o_orderkey", F.nullif("o_custkey", F.lit(7)).alias("custkey"))
    c = t.customer.select(F.nullif("c_custkey", F.lit(7)).alias("custkey"), "c_mktsegment", "c_nationkey")
    return joins.natural_join(o, c)


_KEY_SQL = (
    ("newt", """
    SELECT brand_name || ' ' || parent_company AS brand_key, CAST(SUM(total_count) AS BIGINT) AS total_sum_joined_clean
    FROM clean GROUP BY 1"""),
    ("oldt", """
    SELECT p_name || ' ' || CASE WHEN p_brand = 'Brand#1' THEN 'Unbranded' ELSE p_brand END AS brand_key,
           CAST(SUM(p_size) AS BIGINT) AS sum
    FROM part GROUP BY 1"""),
)


def _new_totals(t: Tables) -> DataFrame:
    c = audit.clean_items(t)
    return (c.groupBy(F.concat_ws(" ", "brand_name", "parent_company").alias("brand_key"))
            .agg(F.sum("total_count").alias("total_sum_joined_clean")))


def _old_key(t: Tables) -> DataFrame:
    p = t.part
    parent = F.when(F.col("p_brand") == "Brand#1", F.lit("Unbranded")).otherwise(F.col("p_brand"))
    return (p.groupBy(F.concat_ws(" ", "p_name", parent).alias("brand_key"))
            .agg(F.sum("p_size").cast("bigint").alias("sum")))


@query("full_reconcile", audit.sql("""
SELECT COALESCE(n.brand_key, o.brand_key) AS brand_key, n.total_sum_joined_clean, o.sum,
       n.total_sum_joined_clean = o.sum AS is_equal, n.total_sum_joined_clean - o.sum AS difference
FROM newt n FULL JOIN oldt o ON n.brand_key IS NOT DISTINCT FROM o.brand_key""", *_KEY_SQL))
def q_full_reconcile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J8 + C32: new per-brand totals against the old key, with difference."""
    t = Tables(spark, sf_dir)
    return joins.reconcile(_new_totals(t), _old_key(t), "brand_key", "total_sum_joined_clean", "sum")


@query("anti_keys", audit.sql("""
SELECT p.p_partkey, p.p_name || ' ' || p.p_brand AS brand_key FROM part p
WHERE NOT EXISTS (SELECT 1 FROM clean c WHERE c.p_partkey IS NOT DISTINCT FROM p.p_partkey AND c.total_count >= 49)"""))
def q_anti_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``unjoined`` - dictionary entries (one per part) without a find of 49
    pieces or more in the cleaned data, which some parts have and others lack."""
    t = Tables(spark, sf_dir)
    keys = t.part.select("p_partkey", F.concat_ws(" ", "p_name", "p_brand").alias("brand_key"))
    return joins.anti_join(keys, audit.clean_items(t).filter(F.col("total_count") >= 49), ["p_partkey"])


@query("member_flag", """
SELECT o_orderkey, COALESCE(o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal > 5000), false)
       AS rich_customer
FROM orders""")
def q_member_flag(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``x %in% other$col`` as a flag column."""
    t = Tables(spark, sf_dir)
    rich = t.customer.filter(F.col("c_acctbal") > 5000)
    return joins.member_flag(t.orders.select("o_orderkey", "o_custkey"), rich, "o_custkey", "c_custkey",
                             "rich_customer").select("o_orderkey", "rich_customer")


def dictionary_lists(t: Tables) -> tuple[DataFrame, DataFrame, DataFrame]:
    """A validated dictionary and two later review lists built from ``part``:
    the base has every part, list 1 the PROMO parts, list 2 the LARGE parts with
    an extra ``priority`` column."""
    p = t.part
    key = F.concat_ws(" ", "p_name", "p_brand").alias("brand_name")
    base = p.select(key, F.lower("p_brand").alias("parent_company_name"),
                    F.concat(F.lit("q"), F.col("p_partkey").cast("string")).alias("id"),
                    F.lit("false").alias("validated"), F.col("p_partkey").alias("row_idx"))
    todo1 = p.filter(F.col("p_type") == "PROMO").select(
        key, F.lower("p_name").alias("parent_company_name"),
        F.concat(F.lit("q"), (F.col("p_partkey") + 100000).cast("string")).alias("id"),
        F.lit("true").alias("validated"), F.col("p_partkey").alias("row_idx"))
    todo2 = p.filter(F.col("p_type") == "LARGE").select(
        key, F.lower("p_type").alias("parent_company_name"),
        F.concat(F.lit("q"), (F.col("p_partkey") + 200000).cast("string")).alias("id"),
        F.lit("attempted").alias("validated"), F.col("p_partkey").alias("row_idx"),
        (F.col("p_size") > 25).alias("priority"))
    return base, todo1, todo2


_DICT_SQL = (
    ("base", """
    SELECT p_name || ' ' || p_brand AS brand_name, lower(p_brand) AS parent_company_name,
           'q' || CAST(p_partkey AS VARCHAR) AS id, 'false' AS validated, p_partkey AS row_idx,
           CAST(NULL AS BOOLEAN) AS priority, 0 AS source_rank FROM part"""),
    ("todo1", """
    SELECT p_name || ' ' || p_brand AS brand_name, lower(p_name) AS parent_company_name,
           'q' || CAST(p_partkey + 100000 AS VARCHAR) AS id, 'true' AS validated, p_partkey AS row_idx,
           CAST(NULL AS BOOLEAN) AS priority, 1 AS source_rank FROM part WHERE p_type = 'PROMO'"""),
    ("todo2", """
    SELECT p_name || ' ' || p_brand AS brand_name, lower(p_type) AS parent_company_name,
           'q' || CAST(p_partkey + 200000 AS VARCHAR) AS id, 'attempted' AS validated, p_partkey AS row_idx,
           p_size > 25 AS priority, 2 AS source_rank FROM part WHERE p_type = 'LARGE'"""),
    ("unioned", """
    SELECT * FROM base WHERE NOT EXISTS (
      SELECT 1 FROM (SELECT brand_name FROM todo1 UNION SELECT brand_name FROM todo2) k
      WHERE k.brand_name IS NOT DISTINCT FROM base.brand_name)
    UNION ALL SELECT * FROM todo1 UNION ALL SELECT * FROM todo2"""),
)


def _overridden(spark: SparkSession, sf_dir: str) -> DataFrame:
    base, todo1, todo2 = dictionary_lists(Tables(spark, sf_dir))
    return joins.override_union(base, [todo1, todo2], "brand_name")


@query("override_union", "WITH " + ",\n".join(f"{n} AS ({q})" for n, q in _DICT_SQL) + """
SELECT brand_name, parent_company_name, id, validated, row_idx, priority, source_rank FROM unioned""")
def q_override_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """U2 + U1: review lists replace dictionary rows with the same brand."""
    return _overridden(spark, sf_dir).select("brand_name", "parent_company_name", "id", "validated",
                                             "row_idx", "priority", "source_rank")


@query("first_per_key", "WITH " + ",\n".join(f"{n} AS ({q})" for n, q in _DICT_SQL) + """
SELECT brand_name, parent_company_name, id, validated, row_idx, source_rank FROM (
  SELECT *, row_number() OVER (PARTITION BY brand_name ORDER BY source_rank, row_idx) AS rn FROM unioned)
WHERE rn = 1""")
def q_first_per_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P10: ``distinct(brand_name, .keep_all = TRUE)`` in source order."""
    u = _overridden(spark, sf_dir).select("brand_name", "parent_company_name", "id", "validated",
                                          "row_idx", "source_rank")
    return ordered.first_per_key(u, ["brand_name"], ["source_rank", "row_idx"])
