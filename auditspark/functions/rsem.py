"""Column expressions that reproduce R / dplyr missing-value semantics.

Each helper returns a ``Column`` (or ``DataFrame -> DataFrame``) built only from
JVM-side functions, so everything stays inside whole-stage code generation.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

# R's trimws removes these characters (space, tab, CR, LF).
TRIM_CHARS = " \t\r\n"


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def column_range(df, first: str, last: str) -> list[str]:
    """dplyr's positional selection ``first:last`` - the columns from
    ``first`` to ``last`` inclusive, in frame order."""
    cols = df.columns
    i, j = cols.index(first), cols.index(last)
    return cols[i:j + 1] if i <= j else cols[j:i + 1][::-1]


def r_ifelse(cond: Column, yes, no) -> Column:
    """``ifelse(NA, a, b)`` is NA, unlike ``when`` which falls through."""
    yes = yes if isinstance(yes, Column) else F.lit(yes)
    no = no if isinstance(no, Column) else F.lit(no)
    return F.when(cond.isNull(), F.lit(None)).when(cond, yes).otherwise(no)


def r_in(c: str | Column, values: Iterable) -> Column:
    """``x %in% set`` is never NA (NA is FALSE unless NA is in the set)."""
    values = list(values)
    has_null = any(v is None for v in values)
    non_null = [v for v in values if v is not None]
    c = col(c)
    base = F.coalesce(c.isin(non_null), F.lit(False)) if non_null else F.lit(False)
    return (base | c.isNull()) if has_null else base


def not_in(c: str | Column, values: Iterable) -> Column:
    """``!x %in% set`` keeps NA rows."""
    return ~r_in(c, values)


def trimws(c: str | Column) -> Column:
    """Strip space, tab, CR and LF on both ends."""
    return F.btrim(col(c), F.lit(TRIM_CHARS))


def lower_trim(c: str | Column) -> Column:
    """``trimws(tolower(x))``."""
    return trimws(F.lower(col(c)))


def as_numeric(c: str | Column) -> Column:
    """``as.numeric`` - bad text becomes NULL instead of failing."""
    return col(c).try_cast("double")


def numeric(df, name: str) -> Column:
    """``as.numeric(x)`` that is a plain cast when the column is already numeric."""
    dtype = df.schema[name].dataType.typeName()
    c = F.col(name)
    return as_numeric(c) if dtype == "string" else c.cast("double")


def as_integer(c: str | Column) -> Column:
    """``as.integer("5.7") == 5``: parse as double, then truncate."""
    return col(c).try_cast("double").try_cast("int")


def parse_number(c: str | Column) -> Column:
    """``as.numeric(gsub(",", "", x))`` for thousands-separated text."""
    return F.replace(col(c), F.lit(","), F.lit("")).try_cast("double")


def as_date(c: str | Column, fmt: str = "M/d/yyyy") -> Column:
    """``as.Date(x, "%m/%d/%Y")``; unparseable text becomes NULL."""
    return F.try_to_date(col(c), fmt)


def strip_token(c: str | Column, token: str = "null") -> Column:
    """C4: ``gsub("null", "", x)`` deletes the token anywhere in the text."""
    return F.replace(col(c), F.lit(token), F.lit(""))


def strip_whole(c: str | Column, token: str = "null") -> Column:
    """C4 whole-value variant: only a value equal to the token becomes ''."""
    c = col(c)
    return F.when(c == token, F.lit("")).otherwise(c)


def sentinel_null(c: str | Column, sentinels: Iterable[str] = ("null", "")) -> Column:
    """C20: ``ifelse(x %in% c("null", ""), NA, x)``."""
    c = col(c)
    return F.when(c.isin(list(sentinels)), F.lit(None)).otherwise(c)


def na_text(c: str | Column) -> Column:
    """R prints NA as "NA" inside ``paste0`` and ``toString``."""
    return F.coalesce(col(c).cast("string"), F.lit("NA"))


def paste0(*cols) -> Column:
    """``paste0`` over columns, with every NA printed as "NA"."""
    return F.concat(*[na_text(c) for c in cols])


def paste_key(*cols, sep: str = "_") -> Column:
    """``paste0(a, "_", b, "_", c)``."""
    return F.concat_ws(sep, *[na_text(c) for c in cols])


def is_na(c: str | Column) -> Column:
    """C11: NULL, and NaN for doubles."""
    c = col(c)
    return c.isNull() | F.isnan(c)


def sum_strict(c: str | Column) -> Column:
    """``sum(x)`` without ``na.rm`` is NA as soon as one value is NA."""
    c = col(c)
    return F.when(F.count(c) < F.count(F.lit(1)), F.lit(None)).otherwise(F.sum(c))


def n_distinct_na(c: str | Column) -> Column:
    """``length(unique(x))`` counts NA as one more value."""
    c = col(c)
    return F.count_distinct(c) + F.max(c.isNull().cast("int"))


def near(c: str | Column, target: float = 1.0, digits: int = 3) -> Column:
    """``round(x, k) == t`` written as a tolerance test so that it does not
    depend on how each engine rounds a value that prints as a tie."""
    return F.abs(col(c) - F.lit(target)) < F.lit(0.5 * 10 ** (-digits))


def title_case(c: str | Column) -> Column:
    """``str_to_title`` capitalises after any non-letter, like stringr.

    Splits the text into runs of word characters and runs of other characters,
    capitalises each run and joins them back, so "coca-cola" -> "Coca-Cola"."""
    runs = F.regexp_extract_all(col(c), F.lit(TITLE_RUNS), F.lit(1))
    return F.array_join(F.transform(runs, lambda x: F.initcap(x)), "")


# A word is a run of letters, digits and apostrophes.
TITLE_RUNS = "([\\p{L}\\p{N}'’]+|[^\\p{L}\\p{N}'’]+)"
