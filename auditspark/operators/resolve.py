"""Brand -> company resolution.

All of these are column expressions or joins against a lookup table; lookups
are equi-joins that AQE turns into broadcasts only when the measured lookup side
is under the broadcast threshold.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from auditspark.functions import rsem
from auditspark.operators import joins
from auditspark.operators.ordered import dense_index

# An entity id is "q" followed by at least two digits; ids that
# are links are not looked up.
ENTITY_PATTERN = "q(\\d{2,})"
LINK_MARK = "http"


def fallback_chain(df: DataFrame, status: str = "validated", company: str = "parent_company_name",
                   raw_company: str = "parent_company", brand: str = "brand_name",
                   id_col: str = "id") -> DataFrame:
    """Fill status, company and id in the reference's order; each step sees
    the previous step's result (sequential ``mutate``)."""
    unbranded = F.col(company).isNull() & (F.col(raw_company) == "Unbranded")
    return (
        df.withColumn(status, rsem.r_ifelse(F.col(status).isNull(), F.lit("false"), F.col(status)))
        .withColumn(status, rsem.r_ifelse(unbranded, F.lit("true"), F.col(status)))
        .withColumn(company, rsem.r_ifelse(unbranded, F.lit("Unbranded"), F.col(company)))
        .withColumn(company, rsem.r_ifelse(F.col(company).isNull(), F.col(raw_company), F.col(company)))
        .withColumn(company, rsem.r_ifelse(F.col(company) == "NULL", F.col(brand), F.col(company)))
        .withColumn(id_col, rsem.r_ifelse((F.col(id_col) == "") | F.col(id_col).isNull(),
                                          F.col(company), F.col(id_col)))
    )


def lookup_worklist(ids: DataFrame, known: DataFrame, id_col: str = "id") -> DataFrame:
    """Distinct entity ids (``q`` + digits, not links) not yet in the label
    table - the ids that still need a lookup."""
    cand = (ids.select(id_col).distinct()
            .filter(F.col(id_col).rlike(ENTITY_PATTERN) & ~F.col(id_col).contains(LINK_MARK)))
    return cand.join(known.select(id_col).distinct(), id_col, "left_anti")


def location_worklist(items: DataFrame, gazetteer: DataFrame, keys: list[str]) -> DataFrame:
    """Distinct locations, the token "null" deleted, that the gazetteer lacks. NA matches NA in every key."""
    cleaned = items.select(*[rsem.strip_token(c).alias(c) for c in keys]).distinct()
    return joins.anti_join(cleaned, gazetteer, keys)


def entity_labels(ids: DataFrame, labels: DataFrame, id_col: str = "id", label_col: str = "label",
                  out_col: str = "name") -> DataFrame:
    """C26 + X5: label table for the ids that hold entity codes.

    Ids matching ``q\\d{2,}`` that are not links are looked up: every code in the
    id is mapped to its label and the labels are joined with ", " in the order
    the codes appear. If any code has no label the lookup fails as a whole and
    the id names itself (``ifelse(is.na(name), id, name)``).

    Codes are exploded with their position, left-joined to the label table on
    the code and re-assembled per id by position - an equi-join and a grouped
    aggregate whose groups hold the few codes of one id."""
    cand = (ids.select(id_col).distinct()
            .filter(F.col(id_col).rlike(ENTITY_PATTERN) & ~F.col(id_col).contains(LINK_MARK)))
    codes = cand.select(id_col, F.posexplode(F.regexp_extract_all(F.col(id_col), F.lit(ENTITY_PATTERN),
                                                                  F.lit(0))).alias("_pos", "_code"))
    lab = labels.select(F.col(id_col).alias("_code"), F.col(label_col).alias("_label"))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_pos", "_label"))),
                                      lambda s: s["_label"]), ", ")
    named = (codes.join(lab, "_code", "left").groupBy(id_col)
             .agg(F.when(F.count("_label") == F.count(F.lit(1)), joined).alias("_name")))
    return (cand.join(named, id_col, "left")
            .select(id_col, F.coalesce(F.col("_name"), F.col(id_col)).alias(out_col)))


def overlay_labels(df: DataFrame, labels: DataFrame, id_col: str = "id",
                   company: str = "parent_company_name", name_col: str = "name") -> DataFrame:
    """J12 (an NA id matches an NA id): ``left_join(labels) |> mutate(company = ifelse(!is.na(name), name, company))``."""
    from auditspark.operators.joins import null_safe_join

    j = null_safe_join(df, labels.select(id_col, name_col), [id_col], "left")
    return j.withColumn(company, F.coalesce(F.col(name_col), F.col(company))).drop(name_col)


def pseudonymize(df: DataFrame, drop: list[str], code_cols: list[str]) -> DataFrame:
    """Drop identifying columns and replace each of ``code_cols`` by the
    dense rank of its value in sorted order (``as.numeric(as.factor(x))``);
    NA stays NA. The rank comes from a range-partitioned index of the distinct
    values, joined back on the value."""
    out = df.drop(*drop)
    for c in code_cols:
        idx = dense_index(out.filter(F.col(c).isNotNull()), [c], "_code")
        out = (out.join(idx, c, "left").drop(c).withColumnRenamed("_code", c))
    return out
