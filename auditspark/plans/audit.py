"""The audit view: the driver's TPC-H-style tables seen as audit items.

Mapping (one item row per ``lineitem`` row):

* event = one order: ``submission_type = o_orderpriority``,
  ``submission_id = o_orderkey``, ``year = year(o_orderdate)``
* ``brand_name = p_name``; company = ``p_brand``; ``Brand#1`` plays "Unbranded"
* ``total_count = l_quantity``; the event's declared total is the order's
  quantity sum plus ``o_orderkey % 2`` so odd orders fail the sum-to-one rule
* location: ``city = c_mktsegment``, ``country = n_name``, ``continent = r_name``

The same view is written twice: as DataFrame code (what the queries run) and as
DuckDB SQL common table expressions (what the oracle runs).

Physical plan: the event totals are a grouped sum of ``lineitem`` joined 1:1 to
``orders``; items join their event, and the sum-to-one rule joins items to their
own per-event aggregate. No window is keyed by the event, so an audit holding a
third of all items is pre-aggregated on the mappers and its item rows can be
split across tasks (AQE skew join) instead of landing in one task. Dimension
joins are left to the planner and AQE: broadcasts only when the measured side is
under the broadcast threshold, otherwise sort-merge joins.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from auditspark.functions import rsem
from auditspark.sources.tables import Tables

# Years dropped as implausible, and the tolerance digits of the
# sum-to-one rule.
BAD_YEARS = (2001, 2012, 2017)
SUM_DIGITS = 3

EVENT_KEYS = ["submission_type", "submission_id", "year"]


def events_table(t: Tables) -> DataFrame:
    """The events (audits): one row per order with its declared item total and
    the sum of the item shares that pass the item rules (positive counts).

    Both come from one grouped pass over ``lineitem`` (partial aggregate on
    every mapper, so an order holding a third of all lines is pre-summed before
    the shuffle), joined 1:1 to ``orders``."""
    q = F.col("l_quantity")
    totals = (t.lineitem.groupBy("l_orderkey")
              .agg(F.sum(q).alias("_q"), F.sum(F.when(q.cast("bigint") > 0, q.cast("bigint"))).alias("_qpos"))
              .withColumnRenamed("l_orderkey", "_ok"))
    o = t.orders.select("o_orderkey", "o_custkey", "o_orderdate", "o_orderpriority", "o_orderstatus")
    return o.join(totals, o.o_orderkey == totals._ok).select(
        F.col("o_orderpriority").alias("submission_type"),
        F.col("o_orderkey").alias("submission_id"),
        F.year("o_orderdate").alias("year"),
        "o_custkey", "o_orderstatus",
        (F.col("_q").cast("bigint") + F.col("o_orderkey") % 2).alias("event_total_count"),
        "_qpos",
    )


def audit_base(t: Tables) -> DataFrame:
    """Items joined to their events (J1). The event side has one row per key,
    so AQE broadcasts it when it is small and otherwise splits the skewed item
    partitions of a hot event across tasks."""
    return _items_of(t, events_table(t).drop("_qpos"))


def _items_of(t: Tables, ev: DataFrame) -> DataFrame:
    li = t.lineitem.select("l_orderkey", "l_partkey", "l_quantity", "l_returnflag", "l_linestatus")
    x = li.join(ev, li.l_orderkey == ev.submission_id, "inner")
    return x.select(
        "submission_type", "submission_id", "year", "l_partkey", "o_custkey", "o_orderstatus",
        F.lower("l_returnflag").alias("type_material"),
        F.lower("l_linestatus").alias("layer"),
        F.col("l_quantity").cast("bigint").alias("total_count"),
        *[c for c in ev.columns if c not in ("submission_type", "submission_id", "year", "o_custkey",
                                              "o_orderstatus")],
    )


def share_filters(df: DataFrame) -> DataFrame:
    """``as.numeric(event_total_count) > 2``,
    ``as.numeric(total_count) > 0``, the share is not missing and the year is
    not in the bad list. Adds ``proportion``."""
    event_total = rsem.numeric(df, "event_total_count")
    total = rsem.numeric(df, "total_count")
    return (
        df.filter(event_total > 2)
        .filter(total > 0)
        .withColumn("proportion", F.try_divide(total, event_total))
        .filter(~rsem.is_na("proportion"))
        .filter(rsem.not_in("year", BAD_YEARS))
    )


def plausible(df: DataFrame) -> DataFrame:
    """L1: keep items of audits whose shares add up to one.

    As in the reference, the items are inner-joined to their own per-event
    aggregate (which carries ``sum``), keeping events whose share sum rounds to
    1 at 3 digits. The aggregate is pre-summed on every mapper and has one row
    per event, so a hot event is never gathered into one task: the join is a
    broadcast when the event table is small, or a sort-merge join whose skewed
    item partitions AQE splits."""
    from auditspark.operators.joins import null_safe_join

    items = share_filters(df)
    sums = (items.groupBy(*EVENT_KEYS).agg(F.sum("proportion").alias("sum"))
            .filter(rsem.near("sum", 1.0, SUM_DIGITS)))
    kept = null_safe_join(items, sums, EVENT_KEYS, "inner")
    return kept.withColumn("event_id", rsem.paste_key(*EVENT_KEYS))


def with_dims(df: DataFrame, t: Tables) -> DataFrame:
    """Attach brand, company and location attributes (J4 lookups)."""
    p = t.part.select("p_partkey", "p_name", "p_brand", "p_type", "p_size")
    c = t.customer.select("c_custkey", "c_nationkey", "c_mktsegment")
    n = t.nation.select("n_nationkey", "n_name", "n_regionkey")
    r = t.region.select("r_regionkey", "r_name")
    unbranded = F.col("p_brand") == "Brand#1"
    brand_no = F.substring("p_brand", 7, 8).cast("int")
    # Each dimension joins the items directly (star join): the build side of
    # every join is a plain scan whose size the planner knows, so small ones are
    # broadcast at plan time and large ones (part, customer at scale) use a
    # sort-merge join; a pre-joined customer-nation-region side would be
    # estimated as the product of its inputs and never broadcast.
    x = (df.join(p, df.l_partkey == p.p_partkey).join(c, df.o_custkey == c.c_custkey)
         .join(n, F.col("c_nationkey") == n.n_nationkey).join(r, F.col("n_regionkey") == r.r_regionkey))
    status = F.col("o_orderstatus")
    return x.select(
        *[c for c in df.columns if c not in ("l_partkey", "o_custkey", "o_orderstatus")],
        F.col("p_partkey"),
        F.col("p_name").alias("brand_name"),
        F.when(unbranded, F.lit("Unbranded")).otherwise(F.col("p_brand")).alias("parent_company"),
        F.when(unbranded, F.lit("unbranded")).otherwise(F.lower("p_brand")).alias("parent_company_name"),
        F.when(unbranded, F.lit("unbranded"))
        .otherwise(F.concat(F.lit("q"), (brand_no + 100).cast("string"))).alias("id"),
        F.when(F.col("p_size") % 3 == 0, F.lit("true"))
        .when(F.col("p_size") % 3 == 1, F.lit("false")).otherwise(F.lit("attempted")).alias("validated"),
        F.lower("p_type").alias("type_product"),
        F.lower("c_mktsegment").alias("city"),
        F.concat(F.lit("p"), (F.col("c_nationkey") % 3).cast("string")).alias("province"),
        F.lower("n_name").alias("country"),
        F.lower("r_name").alias("continent"),
        F.when(status == "F", F.lit("inland")).when(status == "O", F.lit("coastal"))
        .otherwise(F.lit("freshwater")).alias("specifics_of_audit"),
    )


def audit_items(t: Tables) -> DataFrame:
    """Every item with its attributes, before the plausibility rules."""
    return with_dims(audit_base(t), t)


def clean_items(t: Tables) -> DataFrame:
    """Items that pass L1, with attributes.

    In this view the share sum of an event is an event-level quantity - the
    positive item counts over the declared total - so it comes from the same
    ``lineitem`` aggregate as the total: the event rules (total > 2, year, sum
    rounds to 1) filter the events first and the items join only the events
    that pass, one join instead of the generic aggregate-and-join-back of
    ``plausible``. Same rows, same ``sum`` (up to summation order)."""
    ev = events_table(t)
    total = F.col("event_total_count")
    ev = (ev.filter(total > 2).filter(rsem.not_in("year", BAD_YEARS))
          .withColumn("sum", F.try_divide(F.col("_qpos").cast("double"), total.cast("double")))
          .filter(rsem.near("sum", 1.0, SUM_DIGITS)).drop("_qpos"))
    items = share_filters(_items_of(t, ev)).withColumn("event_id", rsem.paste_key(*EVENT_KEYS))
    return with_dims(items, t)


# ---------------------------------------------------------------------------
# The same view as DuckDB SQL, for the oracle.

SQL_CTES = {
    "audit_base": """
    SELECT o.o_orderpriority AS submission_type, o.o_orderkey AS submission_id,
           CAST(year(o.o_orderdate) AS INTEGER) AS year, l.l_partkey, o.o_custkey, o.o_orderstatus,
           lower(l.l_returnflag) AS type_material, lower(l.l_linestatus) AS layer,
           CAST(l.l_quantity AS BIGINT) AS total_count,
           CAST(SUM(l.l_quantity) OVER (PARTITION BY l.l_orderkey) AS BIGINT) + o.o_orderkey % 2
             AS event_total_count
    FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey""",
    "plaus0": """
    SELECT *, CAST(total_count AS DOUBLE) / CAST(event_total_count AS DOUBLE) AS proportion
    FROM audit_base WHERE event_total_count > 2 AND total_count > 0""",
    "plaus1": """
    SELECT *, SUM(proportion) OVER (PARTITION BY submission_type, submission_id, year) AS sum
    FROM plaus0 WHERE proportion IS NOT NULL AND NOT isnan(proportion)
      AND year NOT IN (2001, 2012, 2017)""",
    "plaus": """
    SELECT *, submission_type || '_' || CAST(submission_id AS VARCHAR) || '_' || CAST(year AS VARCHAR)
             AS event_id
    FROM plaus1 WHERE abs(sum - 1) < 0.0005""",
    "geo": """
    SELECT c.c_custkey, c.c_mktsegment, n.n_name, r.r_name, c.c_nationkey
    FROM customer c JOIN nation n ON c.c_nationkey = n.n_nationkey
    JOIN region r ON n.n_regionkey = r.r_regionkey""",
}

_DIMS_SELECT = """
    SELECT b.* EXCLUDE (l_partkey, o_custkey, o_orderstatus), p.p_partkey,
      p.p_name AS brand_name,
      CASE WHEN p.p_brand = 'Brand#1' THEN 'Unbranded' ELSE p.p_brand END AS parent_company,
      CASE WHEN p.p_brand = 'Brand#1' THEN 'unbranded' ELSE lower(p.p_brand) END AS parent_company_name,
      CASE WHEN p.p_brand = 'Brand#1' THEN 'unbranded'
           ELSE 'q' || CAST(CAST(substr(p.p_brand, 7, 8) AS INTEGER) + 100 AS VARCHAR) END AS id,
      CASE WHEN p.p_size % 3 = 0 THEN 'true' WHEN p.p_size % 3 = 1 THEN 'false' ELSE 'attempted' END
        AS validated,
      lower(p.p_type) AS type_product, lower(g.c_mktsegment) AS city,
      'p' || CAST(g.c_nationkey % 3 AS VARCHAR) AS province,
      lower(g.n_name) AS country, lower(g.r_name) AS continent,
      CASE WHEN b.o_orderstatus = 'F' THEN 'inland' WHEN b.o_orderstatus = 'O' THEN 'coastal'
           ELSE 'freshwater' END AS specifics_of_audit
    FROM {src} b JOIN part p ON b.l_partkey = p.p_partkey JOIN geo g ON b.o_custkey = g.c_custkey"""

SQL_CTES["audit"] = _DIMS_SELECT.format(src="audit_base")
SQL_CTES["clean"] = _DIMS_SELECT.format(src="plaus")


def ctes(*extra: tuple[str, str]) -> str:
    """The audit-view CTEs (plus extra named CTEs) as a ``name AS (...)`` list."""
    return ",\n".join(f"{n} AS ({q})" for n, q in list(SQL_CTES.items()) + list(extra))


def sql(body: str, *extra: tuple[str, str]) -> str:
    """Prefix a query with the audit-view CTEs (plus extra named CTEs)."""
    return "WITH " + ctes(*extra) + "\n" + body
