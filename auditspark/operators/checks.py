"""Validation rule engine.

Row rules are SQL predicates that every row must satisfy. All of them are
evaluated together in one aggregate pass (``count_if`` per rule), then the
one-row result is unpivoted to one row per rule. A predicate that is NULL for
some row makes the rule UNKNOWN unless another row already fails it, which is
how R's ``all()`` treats NA. Group rules (uniqueness, sums per event) each need
one grouped aggregate. Type rules compare the schema and touch no data.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Columns of a validation result.
RESULT = "rule string, status string, n_bad bigint, n_unknown bigint"

# Allowed values of the controlled text columns.
VALIDATED = ("attempted", "true", "false")
SUBMISSION_TYPES = ("Excel Template Old", "Excel Template 2020", "Excel Template 2021", "123Forms Old",
                    "123Forms New", "Trashblitz New", "ThirdParty 2022", "ThirdParty 2020")
PRODUCT_TYPES = ("other", "food packaging", "household products", "smoking materials", "personal care",
                 "fishing gear", "packaging materials")
MATERIALS = ("pet", "o", "pvc", "hdpe", "pp", "ldpe", "ps")
LAYERS = ("single-layer", "multi-layer", "unsure")
IS_TRAINED = ("no", "yes")
SURROUNDINGS = ("inland", "coastal", "freshwater", "other")
SPECIFICITY = ("city", "country", "state", "other")
YEAR_MIN, YEAR_MAX = 2017, 2023


def _in(values: tuple[str, ...]) -> str:
    return "(" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + ")"


# Row rules: (rule id, predicate every row must satisfy), as SQL text shared by
# Spark and the DuckDB oracle. ``%in%`` is never NA: a missing value is not in the set.
ROW_RULES = [
    ("V10_company_not_na", "parent_company_name IS NOT NULL"),
    ("V11_id_not_na", "id IS NOT NULL"),
    ("V12_id_not_null_text", "id <> 'null'"),
    ("V13_id_not_NULL_text", "id <> 'NULL'"),
    ("V14_id_not_empty", "id <> ''"),
    ("V16_validated_domain", f"coalesce(validated IN {_in(VALIDATED)}, false)"),
    ("V17_submission_type_domain", f"coalesce(submission_type IN {_in(SUBMISSION_TYPES)}, false)"),
    ("V18_year_range", f"year > {YEAR_MIN} AND year < {YEAR_MAX}"),
    ("V19_type_product_domain", f"type_product IN {_in(PRODUCT_TYPES)} OR type_product IS NULL"),
    ("V20_type_material_domain", f"type_material IN {_in(MATERIALS)} OR type_material IS NULL"),
    ("V21_layer_domain", f"layer IN {_in(LAYERS)} OR layer IS NULL"),
    ("V22_total_count_positive", "total_count > 0"),
    ("V25_surroundings_domain", f"specifics_of_audit IN {_in(SURROUNDINGS)} OR specifics_of_audit IS NULL"),
    ("V26_event_total_ge_count", "event_total_count >= total_count"),
    ("V27_event_total_not_na", "event_total_count IS NOT NULL"),
    ("V28_event_total_positive", "event_total_count > 0"),
    ("V29_total_count_not_na", "total_count IS NOT NULL"),
    ("V30_proportion_not_na", "proportion IS NOT NULL"),
    ("V35_proportion_range", "proportion > 0 AND proportion <= 1"),
]

OPTIONAL_ROW_RULES = [
    ("V23_is_trained_domain", "is_trained", f"is_trained IN {_in(IS_TRAINED)} OR is_trained IS NULL"),
    ("V24_type_of_audit_outdoor", "type_of_audit", "type_of_audit = 'outdoor'"),
    ("V32_longitude_range", "longitude_most_specific",
     "longitude_most_specific BETWEEN -180 AND 180 OR longitude_most_specific IS NULL"),
    ("V33_latitude_range", "latitude_most_specific",
     "latitude_most_specific BETWEEN -90 AND 90 OR latitude_most_specific IS NULL"),
    ("V34_specificity_domain", "location_specificity", f"coalesce(location_specificity IN {_in(SPECIFICITY)}, false)"),
]


def _status(bad: F.Column, unknown: F.Column) -> F.Column:
    return (F.when(bad > 0, F.lit("FAIL")).when(unknown > 0, F.lit("UNKNOWN"))
            .otherwise(F.lit("PASS")))


def row_rules(df: DataFrame) -> list[tuple[str, str]]:
    rules = list(ROW_RULES)
    rules += [(r, p) for r, c, p in OPTIONAL_ROW_RULES if c in df.columns]
    return rules


def _rule_counts(rules: list[tuple[str, str]]) -> list[F.Column]:
    aggs = []
    for i, (_, pred) in enumerate(rules):
        aggs.append(F.expr(f"count_if(NOT ({pred}))").alias(f"b{i}"))
        aggs.append(F.expr(f"count_if(({pred}) IS NULL)").alias(f"u{i}"))
    return aggs


def check_rows(df: DataFrame, rules: list[tuple[str, str]]) -> DataFrame:
    """Every row rule in one pass: (rule, status, n_bad, n_unknown)."""
    one = df.agg(*_rule_counts(rules))
    structs = [F.struct(F.lit(r).alias("rule"), F.col(f"b{i}").alias("n_bad"), F.col(f"u{i}").alias("n_unknown"))
               for i, (r, _) in enumerate(rules)]
    rows = one.select(F.explode(F.array(*structs)).alias("r")).select("r.*")
    return rows.select("rule", _status(F.col("n_bad"), F.col("n_unknown")).alias("status"), "n_bad", "n_unknown")


def write_checked(df: DataFrame, write: Callable[[DataFrame], DataFrame],
                  rules: list[tuple[str, str]] | None = None) -> tuple[DataFrame, DataFrame]:
    """L7 during the write: what ``write`` returns for ``df``, and every row rule's (rule, status, n_bad, n_unknown).

    The counts are metrics that the write job observes on the rows it writes, so there is no second scan. They
    stand directly below the write, in its last stage, whose tasks count once each whatever is retried."""
    rules = row_rules(df) if rules is None else rules
    if not rules:
        return write(df), df.sparkSession.createDataFrame([], RESULT)
    seen = Observation()
    written = write(df.observe(seen, *_rule_counts(rules)))
    counts = seen.get
    rows = []
    for i, (rule, _) in enumerate(rules):
        bad, unknown = int(counts[f"b{i}"]), int(counts[f"u{i}"])
        rows.append((rule, "FAIL" if bad else "UNKNOWN" if unknown else "PASS", bad, unknown))
    return written, df.sparkSession.createDataFrame(rows, RESULT)


def control_totals(totals: list[tuple[str, DataFrame, str, float | DataFrame]]) -> DataFrame:
    """V2-V5: (rule, status, total, expected) of each (rule, frame, column, expected): the column's sum against a stated
    number, or against the one value of a one-row frame. Sums that are NA are UNKNOWN."""
    from auditspark.operators.ordered import attach_scalar

    parts = []
    for rule, frame, column, expected in totals:
        one = frame.agg(F.sum(F.col(column)).cast("double").alias("total"))
        if isinstance(expected, DataFrame):
            one = attach_scalar(one, expected.select(F.col(expected.columns[0]).cast("double").alias("expected")))
        else:
            one = one.withColumn("expected", F.lit(float(expected)))
        status = F.when(F.col("total") == F.col("expected"), "PASS").when(F.col("total") != F.col("expected"), "FAIL").otherwise("UNKNOWN")
        parts.append(one.select(F.lit(rule).alias("rule"), status.alias("status"), "total", "expected"))
    return reduce(lambda a, b: a.unionByName(b), parts)


def _counted(df: DataFrame, named: list[tuple[str, F.Column]]) -> DataFrame:
    """One aggregate over ``df`` counting the rows that break each named rule,
    unpivoted to (rule, status, n_bad, n_unknown)."""
    one = df.agg(*[F.count_if(bad).alias(f"g{i}") for i, (_, bad) in enumerate(named)])
    structs = [F.struct(F.lit(r).alias("rule"), F.col(f"g{i}").alias("n_bad")) for i, (r, _) in enumerate(named)]
    rows = one.select(F.explode(F.array(*structs)).alias("r")).select("r.*")
    return rows.select("rule", _status(F.col("n_bad"), F.lit(0)).alias("status"), "n_bad",
                       F.lit(0).cast("bigint").alias("n_unknown"))


def check_groups(df: DataFrame, event_col: str = "event_id") -> DataFrame:
    """Group rules in three grouped passes: per event, the shares sum to 1
    and the event list has one row (V8); per brand, one status (V9) and one id
    (V38, a warning in the reference); and no duplicate rows (V31). Distinct
    counts treat NA as a value, like ``length(unique(x))``."""
    from auditspark.functions.rsem import n_distinct_na

    ev_cols = [c for c in ("event_id", "city", "province", "country", "continent", "year",
                           "specifics_of_audit", "event_total_count") if c in df.columns]
    ev = df.groupBy(event_col).agg(F.sum("proportion").alias("s"),
                                   F.count_distinct(F.struct(*ev_cols)).alias("na"))
    ev_rules = _counted(ev, [
        ("V15_event_shares_sum_to_one", ~(F.abs(F.col("s") - 1) < 0.0005) | F.col("s").isNull()),
        ("V8_event_list_unique", F.col("na") > 1),
    ])
    br = df.groupBy("brand_name").agg(n_distinct_na("validated").alias("nv"), n_distinct_na("id").alias("ni"))
    br_rules = _counted(br, [("V9_one_status_per_brand", F.col("nv") > 1),
                             ("V38_one_id_per_brand", F.col("ni") > 1)])
    dups = df.groupBy(*df.columns).agg(F.count(F.lit(1)).alias("c"))
    dup_rules = _counted(dups, [("V31_no_duplicate_rows", F.col("c") > 1)])
    return ev_rules.unionByName(br_rules).unionByName(dup_rules)


def check_all(df: DataFrame) -> DataFrame:
    """The whole validation suite over the cleaned item table, which is
    materialized once because every group rule reads it again; the row rules are counted as it is written."""
    from auditspark.operators.ordered import materialize

    df, rows = write_checked(df, materialize)
    return rows.unionByName(check_groups(df))


def check_types(df: DataFrame, expected: StructType) -> DataFrame:
    """How many values of each column do not read as its declared type.

    Every value is turned into text, as a stage file would hold it, and back;
    a column that the frame lacks counts as all bad."""
    total = F.count(F.lit(1))
    bad = [F.count_if(F.col(f.name).isNotNull() & F.col(f.name).cast("string").try_cast(f.dataType).isNull())
           if f.name in df.columns else total for f in expected.fields]
    one = df.agg(*[c.alias(f"t{i}") for i, c in enumerate(bad)])
    rows = F.array(*[F.struct(F.lit(f.name).alias("column"), F.lit(f.dataType.simpleString()).alias("expected"),
                              F.col(f"t{i}").alias("n_bad")) for i, f in enumerate(expected.fields)])
    return one.select(F.explode(rows).alias("r")).select("r.*")
