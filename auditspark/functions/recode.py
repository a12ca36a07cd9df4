"""Code and category recodes (C22-C25) as literal maps.

Each recode is a ``map`` literal looked up with ``coalesce(map[x], x)``: the map
is a constant inside the generated code, so no join and no shuffle is needed,
and unknown values pass through unchanged as in ``case_when(..., TRUE ~ x)``.
"""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values (reference recodes, applied after trimws(tolower(x))).
# Product type codes; "pp" becomes the text "null".
PRODUCT_CODES = {
    "pp": "null",
    "fg": "fishing gear",
    "pc": "personal care",
    "hp": "household products",
    "sm": "smoking materials",
    "pm": "packaging materials",
    "fp": "food packaging",
    "o": "other",
}

# Material codes that are really layer or product codes become "null".
MATERIAL_CODES = {
    "fp": "null",
    "ml": "null",
    "sl": "null",
}

# Layer codes.
LAYER_CODES = {
    "ml": "multi-layer",
    "sl": "single-layer",
    "o": "null",
}

# Audit surroundings spellings grouped into four categories (or "null").
SURROUNDINGS = {
    "null": ["brand audit", "litter clean-up"],
    "inland": [
        "city / park / land", "city / park / other land", "city/park/land", "land", "city",
        "landfill", "market", "tradisional market", "school", "school / office",
        "school / office / institution", "school/office", "school/office (home)",
        "mountain areas", "office", "park", "openspace",
    ],
    "coastal": ["coast / shoreline", "coast/shoreline", "coast / ocean / estuary", "ocean"],
    "freshwater": ["lake", "river"],
    "other": ["ocean / river / lake", "ocean/river/lake", "shoreline / river / lake"],
}

# Country spelling fixes.
COUNTRY_FIXES = {
    "united kingdom": "united kingdom of great britain & northern ireland",
    "korea": "south korea",
}

# Bad values that become "null" text.
IS_TRAINED_BAD = ("rojaki",)


def surroundings_map() -> dict[str, str]:
    return {spelling: cat for cat, spellings in SURROUNDINGS.items() for spelling in spellings}


def recode(c: str | Column, mapping: dict[str, str]) -> Column:
    """``case_when(x == k1 ~ v1, ..., TRUE ~ x)``; NA stays NA."""
    c = F.col(c) if isinstance(c, str) else c
    m = F.create_map(*[F.lit(x) for x in chain.from_iterable(mapping.items())])
    return F.coalesce(F.try_element_at(m, c), c)


def null_bad(c: str | Column, bad: tuple[str, ...], to: str = "null") -> Column:
    """``ifelse(x == "rojaki", "null", x)`` (NA stays NA)."""
    c = F.col(c) if isinstance(c, str) else c
    return F.when(c.isin(list(bad)), F.lit(to)).otherwise(c)


def null_nonpositive(c: str | Column) -> Column:
    """A time that is negative or zero is missing (cast first, see trap 4)."""
    c = F.col(c) if isinstance(c, str) else c
    x = c.try_cast("double")
    return F.when(x <= 0, F.lit(None)).otherwise(x)
