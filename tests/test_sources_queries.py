"""CSV profiles on synthesized files with the known traps, and every registered query on sf0.001."""

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as E
from auditspark.operators import checks, joins
from auditspark.sources.csv import read_csv
from conftest import SF


@pytest.fixture()
def put(tmp_path):
    def write(name, text):
        path = tmp_path / name
        path.write_bytes(text.encode("utf-8"))
        return str(path)

    return write


TODO1 = '''brand_name,validated,brand_parent_occurances,parent_company_name,id,brand_total_count,brand_frequency
alpha ,TRUE,1,Alpha Group,Q12,500,20
"beta, inc",TRUE,2,"Beta, Inc.",q34,40,11
gamma,attempted,1,,https://example.org/x,7,2
日本,TRUE,1,Nihon,Q56,3,1
'''
TODO2 = '''brand_name,validated,brand_parent_occurances,parent_company_name,id,brand_total_count,brand_frequency,priority
delta,TRUE,2,"Delta, Delta Two","q7, q8",9,4,TRUE
NA,attempted,1,Missing,q9,1,1,FALSE
'''


def test_review_lists_union_with_missing_column(spark, put):
    t1, t2 = read_csv(spark, put("todo1.csv", TODO1)), read_csv(spark, put("todo2.csv", TODO2))
    assert t1.count() == 4 and t2.count() == 2
    assert "priority" in t2.columns and "priority" not in t1.columns
    u = joins.override_union(t1.limit(0), [t1, t2], "brand_name")
    assert u.count() == 6 and "priority" in u.columns
    agg = t1.agg(F.sum(F.col("brand_total_count").cast("long")), F.sum(F.col("brand_frequency").cast("long"))).first()
    assert tuple(agg) == (550, 34)
    rows = {r.id: r for r in t1.collect()}
    assert rows["q34"].brand_name == "beta, inc" and rows["Q12"].brand_name == "alpha "
    assert rows["https://example.org/x"].parent_company_name == ""  # blank text, not NA
    assert t2.filter(F.col("brand_name").isNull()).count() == 1  # the text NA


POPULATION = '''﻿Country Name,Country Code,Indicator Name,Indicator Code,2019
"Bahamas, The",BHS,"Population, total",SP.POP.TOTL,389482
Not classified,INX,"Population, total",SP.POP.TOTL,
World,WLD,"Population, total",SP.POP.TOTL,7673533972
'''


def test_population_bom_quotes_and_blank(spark, put):
    pop = read_csv(spark, put("population.csv", POPULATION), profile="fast")
    assert pop.count() == 3 and pop.columns[0] == "Country Name"
    blank = pop.filter(F.col("2019").isNull() | (F.col("2019") == "")).select("Country Code").collect()
    assert [r[0] for r in blank] == ["INX"]
    assert pop.filter(F.col("Country Code") == "BHS").first()["Country Name"] == "Bahamas, The"


def test_malformed_lines_keep_every_field(spark, put):
    long = "5,6," + "," * 40 + "far"
    text = f'a,b\n1,2\n"x, y",4\n3,4,extra\n{long}\n7\n"q""uote, d",8\n'
    rows = read_csv(spark, put("d.csv", text), keep_corrupt=True).collect()
    by = {r.a: r for r in rows}
    assert len(rows) == 6
    assert {r.a for r in rows if r._malformed} == {"3", "5"}
    assert by["3"]._record == "3,4,extra" and by["5"]._record == long
    assert by["x, y"].b == "4" and by['q"uote, d'].b == "8" and not by["7"]._malformed


def test_line_breaks_inside_quotes_are_opt_in(spark, put):
    path = put("m.csv", 'a,b\n"one\ntwo",2\n')
    assert read_csv(spark, path, multi_line=True).first().a == "one\ntwo"
    assert read_csv(spark, put("n.csv", "a,b\n" + "1,2\n" * 10)).count() == 10


def test_a_missing_value_is_in_no_set(spark):
    """An NA status must fail the domain rules, as ``%in%`` is never NA."""
    df = spark.createDataFrame([(None, None, None), ("true", "123Forms New", "city")],
                               "validated string, submission_type string, location_specificity string")
    rules = [r for r in checks.ROW_RULES if r[0][:3] in ("V16", "V17")] + [
        (r, p) for r, _, p in checks.OPTIONAL_ROW_RULES if r.startswith("V34")]
    got = {r.rule[:3]: (r.status, r.n_bad, r.n_unknown) for r in checks.check_rows(df, rules).collect()}
    assert got == {k: ("FAIL", 1, 0) for k in ("V16", "V17", "V34")}


def test_entry_runs(spark):
    df = E.entry(spark)
    assert df.columns == ["id", "mean", "rank"]
    assert df.count() >= 5


CORPUS = ("op", "pipeline")  # have tests of their own


@pytest.mark.parametrize("name", sorted(q for q in E.queries() if not q.startswith(CORPUS)))
def test_query_runs_on_smallest_scale(spark, name):
    df = E.queries()[name](spark, SF)
    assert df.count() >= 0
    if name in E.oracle_sql():
        assert all(not c.startswith("_") for c in df.columns)


def test_csv_roundtrip_equals_event_list(spark):
    q = E.queries()
    back = q["csv_roundtrip"](spark, SF)
    direct = q["event_list"](spark, SF).select(*back.columns)
    assert back.exceptAll(direct).count() == 0 and direct.exceptAll(back).count() == 0


def test_type_checks_all_pass(spark):
    rows = E.queries()["type_checks"](spark, SF).collect()
    assert rows and all(r.n_bad == 0 for r in rows), [r for r in rows if r.n_bad]


def test_type_checks_count_values_that_do_not_fit(spark):
    from pyspark.sql import types as T

    df = spark.createDataFrame([("1",), ("x",), (None,)], "a string")
    want = T.StructType([T.StructField("a", T.IntegerType()), T.StructField("gone", T.StringType())])
    assert {r["column"]: r.n_bad for r in checks.check_types(df, want).collect()} == {"a": 1, "gone": 3}
