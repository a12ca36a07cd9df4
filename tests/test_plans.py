"""Plan checks: the physical plans keep the properties the scale design relies on."""

import contextlib
import io

import pytest

import __spark_entry__ as E
from auditspark.plans import audit
from auditspark.sources.tables import Tables
from conftest import SF


def plan_of(df) -> str:
    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        df.explain(mode="formatted")
    return buf.getvalue()


@pytest.mark.parametrize("name", ["plausible_items", "event_shares", "top_companies", "collapse_duplicates",
                                  "brand_company_table", "dense_grid_mean", "regression_by_group", "top_products",
                                  "product_packaging", "packaging_by_sector"])
def test_no_cartesian_product(spark, name):
    plan = plan_of(E.queries()[name](spark, SF))
    assert "CartesianProduct" not in plan


def test_clean_items_has_no_window_and_prunes_columns(spark):
    plan = plan_of(audit.clean_items(Tables(spark, SF)))
    assert "Window" not in plan                     # no window keyed by an audit
    scans = [line for line in plan.splitlines() if "ReadSchema" in line and "l_orderkey" in line]
    assert scans and all("l_extendedprice" not in s and "l_shipdate" not in s for s in scans)


def test_top_k_ranks_only_the_top_values(spark):
    plan = plan_of(E.queries()["slice_max_ties"](spark, SF))
    # The window without a key reads what the top-n limit leaves, not data rows.
    assert "TakeOrderedAndProject" in plan and "BroadcastHashJoin" in plan


def test_filters_reach_the_scan(spark):
    from pyspark.sql import functions as F

    df = Tables(spark, SF).orders.filter(F.col("o_orderstatus") == "F").select("o_orderkey")
    plan = plan_of(df)
    assert "PushedFilters: [IsNotNull(o_orderstatus), EqualTo(o_orderstatus,F)]" in plan
    assert "ReadSchema: struct<o_orderkey:bigint,o_orderstatus:string>" in plan
