"""Composed pipelines (L1-L3, L8) on tables shaped like the reference's inputs.

These are what a user of the reference calls on their own item, event and
dictionary tables (column names as in the field dictionary). Each step is one
of the operators in ``auditspark.operators``; nothing here collects data.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from auditspark.functions import recode, rsem
from auditspark.operators import bootstrap, joins, ordered, resolve, shares
from auditspark.plans.audit import plausible

# Text columns lower-cased and trimmed by the normalize step.
NORMALIZED_COLS = [
    "brand_name", "parent_company_name", "id", "validated", "item_description", "type_product",
    "type_material", "layer", "is_trained", "city", "province", "country", "continent", "type_of_audit",
    "specifics_of_audit", "parent_company_name_old",
]
EVENT_KEYS = ["submission_type", "submission_id", "year"]


def ingest(items: DataFrame, events: DataFrame, brand_key: DataFrame) -> DataFrame:
    """L1: items joined to their outdoor events on the
    shared submission keys (J1, P3 rename, F4 equality filter), brand key
    attached (J4), then the plausibility rules and the sum-to-one filter, with
    the event id built and ``file_name`` dropped (P2)."""
    ev = (events.withColumnRenamed("total_count", "event_total_count")
          .filter(F.col("type_of_audit") == "Outdoor"))
    # The items' brand names are lower-cased and trimmed before they meet their key.
    items = items.withColumn("brand_name", rsem.lower_trim("brand_name"))
    joined = joins.null_safe_join(items, ev, EVENT_KEYS, "inner")
    key = brand_key.select("brand_name", "parent_company_name", "id")
    joined = joins.null_safe_join(joined, key, ["brand_name"], "left")
    out = plausible(joined)
    return out.drop("file_name") if "file_name" in out.columns else out


def resolve_brands(validated: DataFrame, review_lists: list[DataFrame], joined_clean: DataFrame,
                   order_col: str = "row_idx") -> DataFrame:
    """L2 (``brands_validated``): review lists override the validated
    dictionary, the first row per brand wins, the dictionary is right-joined to
    the items and status / company / id are filled in order (C21)."""
    d = joins.override_union(validated, review_lists, "brand_name")
    if order_col not in d.columns:
        raise ValueError(f"the lists need {order_col!r}, the row's place in its file: the first row of a brand wins")
    d = d.select("brand_name", "parent_company_name", "id", "validated", "source_rank", order_col)
    first = ordered.first_per_key(d, ["brand_name"], ["source_rank", order_col]).drop("source_rank", order_col)
    items = joined_clean.drop("id").withColumnRenamed("parent_company_name", "parent_company_name_old")
    x = joins.null_safe_join(first, items, ["brand_name"], "right")
    x = x.withColumn("total_count", rsem.as_integer("total_count")) \
         .withColumn("event_total_count", rsem.as_integer("event_total_count"))
    return resolve.fallback_chain(x)


def normalize(df: DataFrame) -> DataFrame:
    """L3: ``trimws(tolower(.))`` on the text columns, country spelling fixes
    and the product / material / layer / surroundings recodes (C22-C25)."""
    cols = [c for c in NORMALIZED_COLS if c in df.columns]
    x = df.withColumns({c: rsem.lower_trim(c) for c in cols})
    fixes = {}
    if "country" in x.columns:
        fixes["country"] = recode.recode("country", {"united kingdom": recode.COUNTRY_FIXES["united kingdom"]})
    if "type_product" in x.columns:
        fixes["type_product"] = recode.recode("type_product", recode.PRODUCT_CODES)
    if "type_material" in x.columns:
        fixes["type_material"] = recode.recode("type_material", recode.MATERIAL_CODES)
    if "layer" in x.columns:
        fixes["layer"] = recode.recode("layer", recode.LAYER_CODES)
    if "is_trained" in x.columns:
        fixes["is_trained"] = recode.null_bad("is_trained", recode.IS_TRAINED_BAD)
    if "specifics_of_audit" in x.columns:
        fixes["specifics_of_audit"] = recode.recode("specifics_of_audit", recode.surroundings_map())
    if "time_spent" in x.columns:
        fixes["time_spent"] = recode.null_nonpositive("time_spent")
    return x.withColumns(fixes)


def attribute(processed: DataFrame, replicates: int = bootstrap.REPLICATES) -> DataFrame:
    """Per-event company shares without unbranded
    items, zero-filled mean share with bootstrap bounds, rank with average ties
    and the running share."""
    sh = shares.event_company_shares(processed)
    ci = bootstrap.boot_mean_ci(sh, "event_id", "id", "proportion", replicates=replicates)
    ci = ci.withColumn("_mk", F.round("mean", 10))
    return ordered.rank_desc_avg_ties(ci, "_mk", "id", sum_col="mean").drop("_mk", "row_pos")


# Columns dropped before duplicate rows are collapsed.
ENRICH_DROP = ["row_id", "X", "sum", "parent_company_name_old", "parent_company", "name",
               "latitude_specific", "longitude_specific", "latitude_country", "longitude_country",
               "latitude_state", "longitude_state"]


def enrich(df: DataFrame, locations: DataFrame, labels: DataFrame | None = None) -> DataFrame:
    """L4: brands with conflicting statuses demoted to
    "false" (A8, A10), ``volunteer`` as integer, the "null" token deleted from
    city..continent (C4, P6), the gazetteer joined on the four location keys
    with the most specific coordinate and its level (J5, C18, C19), entity
    labels overlaid on the company (J12), audit dates parsed (C10), time spent
    cast with zero as NA (C25), helper columns dropped, duplicate rows collapsed
    with the share recomputed (A5), "null"/"" text as NA (C20, P7), and the
    country spelling fix for Korea (C24)."""
    from auditspark.operators import aggregates
    from auditspark.operators.location import best_location

    x = aggregates.demote_conflicts(df, aggregates.status_conflicts(df))
    if "volunteer" in x.columns:
        x = x.withColumn("volunteer", rsem.as_integer("volunteer"))
    x = best_location(x, locations)
    if labels is not None:
        x = joins.null_safe_join(x, labels.select("id", "name"), ["id"], "left") \
             .withColumn("parent_company_name", F.coalesce("name", "parent_company_name"))
    for c in ("start_of_audit", "end_of_audit"):
        if c in x.columns:
            x = x.withColumn(c, rsem.as_date(c))
    if "time_spent" in x.columns:
        t = rsem.as_numeric("time_spent")
        x = x.withColumn("time_spent", F.when(t == 0, F.lit(None)).otherwise(t))
    x = x.drop(*[c for c in ENRICH_DROP if c in x.columns])
    x = aggregates.collapse_duplicates(x)
    strings = [f.name for f in x.schema.fields if f.dataType.typeName() == "string"]
    x = x.withColumns({c: rsem.sentinel_null(c) for c in strings})
    if "time_spent" in x.columns:
        x = x.drop("time_spent")
    if "country" in x.columns:
        x = x.withColumn("country", recode.recode("country", {"korea": recode.COUNTRY_FIXES["korea"]}))
    return x
