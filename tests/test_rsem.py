"""One test per R missing-value rule; each naive Spark form differs."""

from pyspark.sql import functions as F

from auditspark.functions import recode, rsem


def test_ifelse_na_condition_is_na(spark):
    df = spark.createDataFrame([(None,), (True,), (False,)], "c boolean")
    got = [r[0] for r in df.select(rsem.r_ifelse(F.col("c"), "a", "b")).collect()]
    assert got == [None, "a", "b"]
    naive = [r[0] for r in df.select(F.when(F.col("c"), "a").otherwise("b")).collect()]
    assert naive[0] == "b"


def test_not_in_keeps_na(spark):
    df = spark.createDataFrame([(2001,), (None,), (2019,)], "y int")
    assert df.filter(rsem.not_in("y", [2001, 2012, 2017])).count() == 2
    assert df.filter(~F.col("y").isin(2001, 2012, 2017)).count() == 1


def test_trimws_strips_tab_cr_lf(spark):
    df = spark.createDataFrame([(" \tCoca Cola\r\n",)], "s string")
    assert df.select(rsem.lower_trim("s")).first()[0] == "coca cola"


def test_as_integer_truncates_and_bad_text_is_na(spark):
    df = spark.createDataFrame([("5.7",), ("NULL",), ("-2.9",)], "s string")
    assert [r[0] for r in df.select(rsem.as_integer("s")).collect()] == [5, None, -2]


def test_as_date(spark):
    df = spark.createDataFrame([("9/10/2022",), ("NULL",), ("13/45/2020",)], "s string")
    got = [r[0] for r in df.select(rsem.as_date("s")).collect()]
    assert str(got[0]) == "2022-09-10" and got[1] is None and got[2] is None


def test_paste_key_prints_na(spark):
    df = spark.createDataFrame([("Excel", None, 2019)], "t string, i int, y int")
    assert df.select(rsem.paste_key("t", "i", "y")).first()[0] == "Excel_NA_2019"


def test_sum_strict_and_distinct_with_na(spark):
    df = spark.createDataFrame([(1,), (None,), (1,)], "x int")
    r = df.agg(rsem.sum_strict("x").alias("s"), F.sum("x").alias("n"), rsem.n_distinct_na("x").alias("d")).first()
    assert r["s"] is None and r["n"] == 2 and r["d"] == 2


def test_near_is_round_three_digits(spark):
    df = spark.createDataFrame([(0.9996,), (1.0004,), (0.9994,)], "s double")
    assert [r[0] for r in df.select(rsem.near("s")).collect()] == [True, True, False]


def test_title_case_breaks_at_punctuation(spark):
    df = spark.createDataFrame([("coca-cola",), ("l’arche mcdonald's",)], "s string")
    assert [r[0] for r in df.select(rsem.title_case("s")).collect()] == ["Coca-Cola", "L’arche Mcdonald's"]


def test_strip_token_anywhere_vs_whole(spark):
    df = spark.createDataFrame([("nullarbor",), ("null",)], "s string")
    r = df.select(rsem.strip_token("s").alias("a"), rsem.strip_whole("s").alias("b")).collect()
    assert [(x.a, x.b) for x in r] == [("arbor", "nullarbor"), ("", "")]


def test_recode_passes_unknown_and_na(spark):
    df = spark.createDataFrame([("fg",), ("zz",), (None,), ("pp",)], "s string")
    got = [r[0] for r in df.select(recode.recode("s", recode.PRODUCT_CODES)).collect()]
    assert got == ["fishing gear", "zz", None, "null"]


def test_surroundings_map_covers_all_spellings():
    m = recode.surroundings_map()
    assert len(m) == 28 and m["openspace"] == "inland" and m["ocean"] == "coastal"
