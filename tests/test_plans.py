"""Plans: filters and columns reach the scan, limits stay bounded, nothing multiplies rows blindly."""

import re

import pytest

from versemill.plans import catalog

FOLDER = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_filters_and_columns_reach_the_scan(spark):
    text = plan(catalog.QUERIES["f01_catalogue"](spark, FOLDER))
    assert "PushedFilters: [IsNotNull(p_size), LessThan(p_size,25)]" in text
    assert re.search(r"ReadSchema: struct<p_partkey:bigint,p_name:string,p_size:int>", text)


def test_newest_is_a_bounded_sort(spark):
    assert "TakeOrderedAndProject" in plan(catalog.QUERIES["q34_preview"](spark, FOLDER))


def test_ranks_are_cut_before_the_shuffle(spark):
    assert plan(catalog.QUERIES["q18_recent_of_each"](spark, FOLDER)).count("WindowGroupLimit") == 2


@pytest.mark.parametrize("name", ["j02_cascade", "j06_neighbours", "j10_fuzzy", "j11_postings", "j16_prefixes", "j17_between", "j_as_of", "x30_x31_letter_fills", "x36_cascade", "w04_distinct_texts", "a13_nearest"])
def test_joins_have_an_equality(spark, name):
    text = plan(catalog.QUERIES[name](spark, FOLDER))
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text


@pytest.mark.parametrize("name", sorted(n for n in catalog.QUERIES if n[0] in "qfjaw" and not n.startswith("f13")))
def test_no_python_on_relational_paths(spark, name):
    text = plan(catalog.QUERIES[name](spark, FOLDER))
    assert not re.search("Python|Pandas|Arrow", text)
