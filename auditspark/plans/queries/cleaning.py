"""Scalar cleaning queries (C1-C25, P5, P7) on part/orders/documents/conversations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from auditspark.functions import recode, rsem
from auditspark.operators import resolve
from auditspark.plans.registry import query
from auditspark.sources.tables import Tables


def _fallback_input(t: Tables) -> DataFrame:
    p = t.part
    size, key = F.col("p_size"), F.col("p_partkey")
    return p.select(
        "p_partkey",
        F.col("p_name").alias("brand_name"),
        F.when(size % 4 == 0, F.lit(None)).when(size % 4 == 1, F.lit("NULL"))
        .otherwise(F.lower("p_brand")).alias("parent_company_name"),
        F.when(F.col("p_brand") == "Brand#1", F.lit("Unbranded")).when(size % 5 == 0, F.lit(None))
        .otherwise(F.col("p_brand")).alias("parent_company"),
        F.when(size % 3 == 0, F.lit(None)).when(size % 3 == 1, F.lit("true"))
        .otherwise(F.lit("attempted")).alias("validated"),
        F.when(key % 6 == 0, F.lit("")).when(key % 6 == 1, F.lit(None))
        .otherwise(F.concat(F.lit("q"), key.cast("string"))).alias("id"),
    )


@query("fallback_chain", """
WITH f0 AS (
  SELECT p_partkey, p_name AS brand_name,
    CASE WHEN p_size % 4 = 0 THEN NULL WHEN p_size % 4 = 1 THEN 'NULL' ELSE lower(p_brand) END AS pcn,
    CASE WHEN p_brand = 'Brand#1' THEN 'Unbranded' WHEN p_size % 5 = 0 THEN NULL ELSE p_brand END AS pc,
    CASE WHEN p_size % 3 = 0 THEN NULL WHEN p_size % 3 = 1 THEN 'true' ELSE 'attempted' END AS v,
    CASE WHEN p_partkey % 6 = 0 THEN '' WHEN p_partkey % 6 = 1 THEN NULL
         ELSE 'q' || CAST(p_partkey AS VARCHAR) END AS id
  FROM part),
f1 AS (SELECT *, COALESCE(v, 'false') AS v1, (pcn IS NULL AND pc = 'Unbranded') AS ub FROM f0),
f2 AS (SELECT *, CASE WHEN ub IS NULL THEN NULL WHEN ub THEN 'true' ELSE v1 END AS validated,
              CASE WHEN ub IS NULL THEN NULL WHEN ub THEN 'Unbranded' ELSE pcn END AS pcn2 FROM f1),
f3 AS (SELECT *, CASE WHEN pcn2 IS NULL THEN pc ELSE pcn2 END AS pcn3 FROM f2),
f4 AS (SELECT *, CASE WHEN pcn3 IS NULL THEN NULL WHEN pcn3 = 'NULL' THEN brand_name ELSE pcn3 END
              AS parent_company_name FROM f3)
SELECT p_partkey, validated, parent_company_name,
       CASE WHEN id = '' OR id IS NULL THEN parent_company_name ELSE id END AS id FROM f4""")
def q_fallback_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Status, company and id fallbacks in order."""
    out = resolve.fallback_chain(_fallback_input(Tables(spark, sf_dir)))
    return out.select("p_partkey", "validated", "parent_company_name", "id")


# Raw code spellings derived from order keys so that every code, an unknown
# code, case and padding all occur in the data.
_PRODUCT_RAW = ["pp", "fg", "pc", "hp", "sm", "pm", "fp", "o", " PC\t", "zz"]
_MATERIAL_RAW = ["fp", "ml", "sl", "pet", "HDPE ", "pp"]
_LAYER_RAW = ["ml", "sl", "o", "unsure", " ML"]
_COUNTRY_RAW = ["united kingdom", "korea", "mexico", " France"]


def _pick(values: list[str], key: F.Column) -> F.Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), (key % len(values) + 1).cast("int"))


def _pick_sql(values: list[str], key: str) -> str:
    lits = ", ".join("'" + v.replace("'", "''") + "'" for v in values)
    return f"[{lits}][{key} % {len(values)} + 1]"


def _case_sql(expr: str, mapping: dict[str, str]) -> str:
    whens = " ".join(f"WHEN {expr} = '{k}' THEN '{v}'" for k, v in mapping.items())
    return f"CASE {whens} ELSE {expr} END"


def _norm_sql(expr: str) -> str:
    return f"trim(lower({expr}), ' ' || chr(9) || chr(13) || chr(10))"


@query("recode_lookup", f"""
WITH r AS (SELECT o_orderkey,
  {_norm_sql(_pick_sql(_PRODUCT_RAW, 'o_orderkey'))} AS tp,
  {_norm_sql(_pick_sql(_MATERIAL_RAW, 'o_custkey'))} AS tm,
  {_norm_sql(_pick_sql(_LAYER_RAW, 'o_orderkey'))} AS ly,
  {_norm_sql(_pick_sql(_COUNTRY_RAW, 'o_custkey'))} AS ct FROM orders)
SELECT o_orderkey, {_case_sql('tp', recode.PRODUCT_CODES)} AS type_product,
       {_case_sql('tm', recode.MATERIAL_CODES)} AS type_material,
       {_case_sql('ly', recode.LAYER_CODES)} AS layer,
       {_case_sql('ct', recode.COUNTRY_FIXES)} AS country FROM r""")
def q_recode_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P5 + X2 + C22 + C24: ``mutate_at(cols, ~trimws(tolower(.)))`` then the
    product / material / layer code recodes and the country spelling fixes."""
    o = Tables(spark, sf_dir).orders
    raw = o.select("o_orderkey",
                   _pick(_PRODUCT_RAW, F.col("o_orderkey")).alias("type_product"),
                   _pick(_MATERIAL_RAW, F.col("o_custkey")).alias("type_material"),
                   _pick(_LAYER_RAW, F.col("o_orderkey")).alias("layer"),
                   _pick(_COUNTRY_RAW, F.col("o_custkey")).alias("country"))
    cols = ["type_product", "type_material", "layer", "country"]
    x = raw.withColumns({c: rsem.lower_trim(c) for c in cols})
    return x.withColumns({
        "type_product": recode.recode("type_product", recode.PRODUCT_CODES),
        "type_material": recode.recode("type_material", recode.MATERIAL_CODES),
        "layer": recode.recode("layer", recode.LAYER_CODES),
        "country": recode.recode("country", recode.COUNTRY_FIXES),
    })


_SURR_RAW = [s for group in recode.SURROUNDINGS.values() for s in group] + ["beach", " River", "PARK\r"]


@query("category_recode", f"""
WITH r AS (SELECT o_orderkey, {_norm_sql(_pick_sql(_SURR_RAW, 'o_orderkey'))} AS s FROM orders)
SELECT o_orderkey, {_case_sql('s', recode.surroundings_map())} AS specifics_of_audit FROM r""")
def q_category_recode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """28 surroundings spellings into inland / coastal / freshwater / other."""
    o = Tables(spark, sf_dir).orders
    s = rsem.lower_trim(_pick(_SURR_RAW, F.col("o_orderkey")))
    return o.select("o_orderkey", recode.recode(s, recode.surroundings_map()).alias("specifics_of_audit"))


@query("normalize_text", f"""
SELECT conv_id, turn, {_norm_sql('role')} AS role, md5({_norm_sql('text')}) AS text_md5,
       CAST(length({_norm_sql('text')}) AS INTEGER) AS text_len FROM conversations""")
def q_normalize_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """C1 + C2 + P5: ``trimws(tolower(x))`` over several columns, whole texts."""
    c = Tables(spark, sf_dir).conversations
    x = c.withColumns({k: rsem.lower_trim(k) for k in ("role", "text")})
    return x.select("conv_id", "turn", "role", F.md5("text").alias("text_md5"),
                    F.length("text").alias("text_len"))


@query("strip_token", """
SELECT doc_id, md5(replace(body, 'null', '')) AS text_md5,
       CAST(length(body) - length(replace(body, 'null', '')) AS INTEGER) AS removed_chars,
       md5(CASE WHEN tongue = 'null' THEN '' ELSE tongue END) AS lang_md5
FROM (SELECT doc_id, replace(lower(text), '. ', 'null. ') AS body, replace(lower(lang), 'en', 'null') AS tongue
      FROM documents)""")
def q_strip_token(spark: SparkSession, sf_dir: str) -> DataFrame:
    """C4 + X3: ``gsub("null", "", x)`` deletes the token anywhere in each whole
    text; the whole-value variant only blanks a value equal to the token. The
    token is planted at every end of a sentence and for one language."""
    d = Tables(spark, sf_dir).documents
    low = F.replace(F.lower("text"), F.lit(". "), F.lit("null. "))
    stripped = rsem.strip_token(low)
    return d.select("doc_id", F.md5(stripped).alias("text_md5"),
                    (F.length(low) - F.length(stripped)).alias("removed_chars"),
                    F.md5(rsem.strip_whole(F.replace(F.lower("lang"), F.lit("en"), F.lit("null")))).alias("lang_md5"))


@query("sentinel_null", """
SELECT o_orderkey,
  CASE WHEN s IN ('null', '') THEN NULL ELSE s END AS status,
  CASE WHEN p IN ('null', '') THEN NULL ELSE p END AS priority,
  o_totalprice
FROM (SELECT o_orderkey, o_totalprice,
        CASE WHEN o_orderkey % 7 = 0 THEN 'null' WHEN o_orderkey % 7 = 1 THEN '' ELSE o_orderstatus END AS s,
        CASE WHEN o_custkey % 5 = 0 THEN '' ELSE o_orderpriority END AS p FROM orders)""")
def q_sentinel_null(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P7 + C20: ``mutate_if(is.character, ~ifelse(.x %in% c("null", ""), NA, .x))``."""
    o = Tables(spark, sf_dir).orders
    k = F.col("o_orderkey")
    x = o.select("o_orderkey", "o_totalprice",
                 F.when(k % 7 == 0, F.lit("null")).when(k % 7 == 1, F.lit(""))
                 .otherwise(F.col("o_orderstatus")).alias("status"),
                 F.when(F.col("o_custkey") % 5 == 0, F.lit("")).otherwise(F.col("o_orderpriority"))
                 .alias("priority"))
    strings = [f.name for f in x.schema.fields if f.dataType.typeName() == "string"]
    return x.withColumns({c: rsem.sentinel_null(c) for c in strings})


@query("parse_number", """
SELECT o_orderkey, TRY_CAST(replace(txt, ',', '') AS DOUBLE) AS mass FROM (
  SELECT o_orderkey, CASE WHEN o_orderstatus = 'P' THEN 'NULL' ELSE
    CAST(CAST(floor(o_totalprice / 1000) AS BIGINT) AS VARCHAR) || ',' ||
    lpad(CAST(CAST(floor(o_totalprice) AS BIGINT) % 1000 AS VARCHAR), 3, '0') END AS txt FROM orders)""")
def q_parse_number(spark: SparkSession, sf_dir: str) -> DataFrame:
    """C3 + C8: ``as.numeric(gsub(",", "", "3,224,395"))``; "NULL" becomes NA."""
    o = Tables(spark, sf_dir).orders
    txt = F.when(F.col("o_orderstatus") == "P", F.lit("NULL")).otherwise(F.concat(
        F.floor(F.col("o_totalprice") / 1000).cast("bigint").cast("string"), F.lit(","),
        F.lpad((F.floor("o_totalprice").cast("bigint") % 1000).cast("string"), 3, "0")))
    return o.select("o_orderkey", rsem.parse_number(txt).alias("mass"))


@query("parse_int", """
SELECT o_orderkey, CAST(trunc(TRY_CAST(txt AS DOUBLE)) AS INTEGER) AS n FROM (
  SELECT o_orderkey, CASE WHEN o_orderstatus = 'P' THEN 'NULL' ELSE
    CAST(CAST(floor(o_totalprice) AS BIGINT) AS VARCHAR) || '.' ||
    CAST(CAST(floor(o_totalprice * 10) AS BIGINT) % 10 AS VARCHAR) END AS txt FROM orders)""")
def q_parse_int(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``as.integer("5.7") == 5`` - text parsed as a number, truncated."""
    o = Tables(spark, sf_dir).orders
    txt = F.when(F.col("o_orderstatus") == "P", F.lit("NULL")).otherwise(F.concat(
        F.floor("o_totalprice").cast("bigint").cast("string"), F.lit("."),
        (F.floor(F.col("o_totalprice") * 10).cast("bigint") % 10).cast("string")))
    return o.select("o_orderkey", rsem.as_integer(txt).alias("n"))


@query("parse_date", """
SELECT o_orderkey, CAST(try_strptime(txt, '%m/%d/%Y') AS DATE) AS start_of_audit FROM (
  SELECT o_orderkey, CASE WHEN o_orderstatus = 'P' THEN 'NULL'
    WHEN o_orderkey % 5 = 0 THEN '13/45/2020' ELSE strftime(o_orderdate, '%-m/%-d/%Y') END AS txt FROM orders)""")
def q_parse_date(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``as.Date(x, "%m/%d/%Y")``; bad text becomes NA."""
    o = Tables(spark, sf_dir).orders
    txt = (F.when(F.col("o_orderstatus") == "P", F.lit("NULL"))
           .when(F.col("o_orderkey") % 5 == 0, F.lit("13/45/2020"))
           .otherwise(F.date_format("o_orderdate", "M/d/yyyy")))
    return o.select("o_orderkey", rsem.as_date(txt).alias("start_of_audit"))


@query("event_key", """
SELECT o_orderkey, COALESCE(t, 'NA') || '_' || CAST(o_orderkey AS VARCHAR) || '_' ||
       COALESCE(CAST(y AS VARCHAR), 'NA') AS event_id
FROM (SELECT o_orderkey, nullif(o_orderpriority, '5-LOW') AS t,
             CASE WHEN o_orderstatus = 'P' THEN NULL ELSE CAST(year(o_orderdate) AS INTEGER) END AS y FROM orders)""")
def q_event_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``paste0(type, "_", id, "_", year)`` - NA printed as "NA"."""
    o = Tables(spark, sf_dir).orders
    x = o.select("o_orderkey", F.nullif("o_orderpriority", F.lit("5-LOW")).alias("t"),
                 F.when(F.col("o_orderstatus") == "P", F.lit(None))
                 .otherwise(F.year("o_orderdate")).alias("y"))
    return x.select("o_orderkey", rsem.paste_key("t", "o_orderkey", "y").alias("event_id"))


@query("title_case", r"""
SELECT p_partkey, array_to_string(list_transform(regexp_extract_all(s,
         '([\p{L}\p{N}''’]+|[^\p{L}\p{N}''’]+)', 1), lambda x: upper(x[1]) || lower(x[2:])), '') AS title
FROM (SELECT p_partkey, lower(p_name || '-' || p_type || ' l’' || p_brand || '''s') AS s FROM part)""")
def q_title_case(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``str_to_title`` - capitalise after any non-letter ("Coca-Cola")."""
    p = Tables(spark, sf_dir).part
    s = F.lower(F.concat(F.col("p_name"), F.lit("-"), F.col("p_type"), F.lit(" l’"), F.col("p_brand"),
                         F.lit("'s")))
    return p.select("p_partkey", rsem.title_case(s).alias("title"))
