"""Query modules; importing this package registers every query."""

from auditspark.plans.queries import (  # noqa: F401
    attribution, brands, cleaning, flows, joins, location, packaging, products, report, stages, stats)
