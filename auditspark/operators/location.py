"""Location enrichment against a gazetteer."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from auditspark.functions import rsem
from auditspark.operators import joins

LOC_KEYS = ["city", "province", "country", "continent"]


def best_location(items: DataFrame, gaz: DataFrame) -> DataFrame:
    """C4 + J5 + C18 + C19: ``gsub("null", "")`` on the location columns, a
    null-safe 4-key left join to the gazetteer, the most specific coordinate
    (city, then state, then country; latitude and longitude independently) and
    the level that supplied it."""
    x = items.withColumns({c: rsem.strip_token(c) for c in rsem.column_range(items, "city", "continent")})
    j = joins.null_safe_join(x, gaz, LOC_KEYS, "left")
    lon = F.coalesce("longitude_specific", "longitude_state", "longitude_country")
    lat = F.coalesce("latitude_specific", "latitude_state", "latitude_country")
    j = j.withColumn("longitude_most_specific", lon).withColumn("latitude_most_specific", lat)

    def level(suffix: str):
        return ((F.col("latitude_most_specific") == F.col(f"latitude_{suffix}"))
                & (F.col("longitude_most_specific") == F.col(f"longitude_{suffix}")))

    spec = (F.when(level("specific"), F.lit("city")).when(level("state"), F.lit("state"))
            .when(level("country"), F.lit("country")).otherwise(F.lit("other")))
    drop = [f"{a}_{s}" for a in ("latitude", "longitude") for s in ("specific", "state", "country")]
    return j.withColumn("location_specificity", spec).drop(*drop)
