"""Scalar operators on hand-written rows."""

import pytest
from pyspark.sql import functions as F

from quillmark.functions import numeric as N
from quillmark.functions import text as T


def one(spark, column, value, kind="string"):
    return spark.createDataFrame([(value,)], f"t {kind}").select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(
    ("given", "wanted"),
    [("stylo-\nmetry works", "stylometry works"), ("pre- and post", "preand post"), ("  a \t b\n\nc ", "a b c"), ("", "")],
)
def test_clean(spark, given, wanted):
    assert one(spark, T.clean("t"), given) == wanted


@pytest.mark.parametrize(
    ("given", "wanted"),
    [
        ("as shown (Smith, 2019).", ["(Smith, 2019)"]),
        ("see (Smith and Jones, 2019; Brown et al., 2020)", ["(Smith and Jones, 2019; Brown et al., 2020)"]),
        ("(O'Brien & Garcia-Lopez,2015) twice (O'Brien & Garcia-Lopez,2015)", ["(O'Brien & Garcia-Lopez,2015)"] * 2),
        ("Miller (2015) and Miller (2015) agree", ["Miller (2015)"]),
        ("(Table, 2019) and However (2012)", []),
        ("Chen et al. (2001)", ["Chen et al. (2001)"]),
    ],
)
def test_citations(spark, given, wanted):
    assert one(spark, T.citations("t"), given) == wanted


def test_years_out_of_range_are_dropped(spark):
    assert one(spark, T.years(F.array("t")), "(Smith, 2019; Brown, 2099)") == [2019]


@pytest.mark.parametrize(("years", "wanted"), [([2010, 2011], 2010), ([2011, 2012], 2012), ([1999], 1999), ([], None), ([2005, 1990, 2010], 2005)])
def test_median_year_rounds_halves_to_even(spark, years, wanted):
    assert one(spark, N.median_year(F.col("t")), years, "array<int>") == wanted


@pytest.mark.parametrize(("gap", "wanted"), [(10, "low"), (11, "medium"), (20, "medium"), (21, "high")])
def test_severity(spark, gap, wanted):
    assert one(spark, T.severity(F.col("t")), gap, "int") == wanted


@pytest.mark.parametrize(("words", "wanted"), [(["a"], 0.0), (["a", "a"], 5000.0), (["a", "b"], 0.0), ([], 0.0)])
def test_yules_k(spark, words, wanted):
    assert one(spark, N.yules_k(F.col("t")), words, "array<string>") == wanted


def test_burstiness_of_one_sentence_is_nil(spark):
    assert one(spark, N.burstiness("t"), [12], "array<int>") == 0.0
    assert one(spark, N.burstiness("t"), [10, 20], "array<int>") == pytest.approx(5 / 15)


def test_inverted_index_keeps_gaps(spark):
    f = spark.createDataFrame([({"b": [1], "a": [0, 3]},), (None,)], "t map<string,array<int>>")
    assert [r["x"] for r in f.select(N.inverted_index_text(F.col("t"), F.lit("title")).alias("x")).collect()] == ["a b  a", "title"]


@pytest.mark.parametrize(("mean", "wanted"), [(0.05, 99), (0.30, 50), (0.55, 1)])
def test_ai_probability(spark, mean, wanted):
    assert one(spark, N.ai_probability(F.lit(2), F.col("t")), mean, "double") == wanted
    assert one(spark, N.ai_probability(F.lit(1), F.col("t")), mean, "double") == 0


def test_file_size(spark):
    assert [one(spark, T.file_size(F.col("t")), n, "long") for n in (12, 2048, 5 * 1024 * 1024)] == ["12 B", "2.0 KB", "5.0 MB"]
