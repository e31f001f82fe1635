"""Joins and windows whose work must grow with rows, not with the pairs that copies make."""

import random
import re

from pyspark.sql import functions as F

from versemill.functions import safety as S
from versemill.operators import eventlog as E
from versemill.operators import joins as J


def test_fuzzy_best_of_group_is_all_pairs(spark):
    rng = random.Random(2)
    words = ["blue ring", "blue rings", "old plate", "old plates", "a", "", "bluering", None]
    rows = [(i, rng.choice(words), rng.choice(["x", "y", None]), rng.randrange(3)) for i in range(200)] + [(200, "blue ring", "x", 9)]
    df = spark.createDataFrame(rows, "ask_id long, text string, brand string, sizes int")
    a, b = df, df.withColumnRenamed("ask_id", "line_id")
    pairs = a.drop("text").join(b.drop("text"), ["brand", "sizes"]).filter("ask_id <> line_id").select("ask_id", "line_id")
    want = sorted(map(tuple, J.fuzzy_best(a, b, pairs, 70, J.whole_ratio).collect()))
    assert sorted(map(tuple, J.fuzzy_best_of_group(df, ["brand", "sizes"], 70, J.whole_ratio, J.lengths_near(70)).collect())) == want
    assert sorted(map(tuple, J.fuzzy_best_of_group(df, ["brand", "sizes"], 70, J.whole_ratio).collect())) == want


def test_copies_make_no_pairs(spark):
    """200,000 rows of one text and group: 40 billion pairs, or one text."""
    df = spark.range(200_000).select(F.col("id").alias("ask_id"), F.lit("one text").alias("text"), F.lit("k").alias("k"))
    found = J.fuzzy_best_of_group(df, ["k"], 70, J.whole_ratio)
    assert found.agg(F.count("*"), F.min("score"), F.max("line_id")).first() == (200_000, 100, 1)


def test_prefixes_and_lines_that_repeat(spark):
    """20,000 lines and 20,000 prefixes that begin alike: the pairs by their first eight letters would be 400 million."""
    lines = spark.range(20_000).select(F.col("id").alias("doc_id"), F.concat(F.lit("beginning as all do, "), F.col("id") % 7).alias("line"))
    prefixes = spark.range(20_000).select(F.substring(F.lit("beginning as all do"), F.lit(1), (F.col("id") % 3 + 9).cast("int")).alias("prefix"), F.col("id").alias("title"), (-F.col("id")).alias("place"))
    assert J.first_prefix(lines, prefixes).agg(F.count("*"), F.min("title"), F.max("title")).first() == (20_000, 19_999, 19_999)
    assert J.first_prefix(lines, prefixes.limit(0)).count() == 0
    odd = spark.createDataFrame([("", 1, 1), ("ab", 2, 2), ("abc", 3, 1), (None, 4, 0), ("zz", 5, 0)], "prefix string, title int, place int")
    some = spark.createDataFrame([(1, "abcd"), (2, "ab"), (3, "a"), (4, None), (5, ""), (6, "zy")], "doc_id int, line string")
    assert sorted(map(tuple, J.first_prefix(some, odd).collect())) == [(1, "abcd", 3), (2, "ab", 2)]


def test_a_crowded_window_is_a_running_sum(spark):
    """300,000 rows of one hour, three at a time: windows that are counted row by row meet 10 billion rows."""
    at = F.timestamp_micros(F.lit(1_700_000_000_000_000) + F.expr("id div 3") * 30_000)
    counted = E.trailing_count(spark.range(300_000).select("id", at.alias("ts")), 3600)
    assert counted.agg(F.count("*"), F.max("n_trailing")).first() == (300_000, 300_000)
    plan = counted._jdf.queryExecution().executedPlan().toString()
    assert "Window" in plan and not re.search(r"specifiedwindowframe\(RangeFrame, -", plan)


def test_trailing_counts_are_those_of_all_pairs(spark):
    rng = random.Random(4)
    rows = [(i, rng.choice(["a", "b", None]), rng.choice([-7_200_000_000, 0, 3_600_000_000]) + rng.choice([0, 1, -1, 1_800_000_000, rng.randrange(-4_000_000_000, 4_000_000_000)])) for i in range(150)]
    df = spark.createDataFrame(rows, "id int, k string, us long").withColumn("ts", F.timestamp_micros("us"))
    for by in (None, "k"):
        want = sorted((i, sum((not by or l == k) and at - 3_600_000_000 <= x <= at for _, l, x in rows)) for i, k, at in rows)
        assert sorted(map(tuple, E.trailing_count(df, 3600, by).select("id", "n_trailing").collect())) == want


def test_words_are_in_every_match(spark):
    """Each alternative of a pattern holds, outside its optional parts, one of its category's words."""
    assert S.WORDS.keys() == S.PATTERNS.keys()
    for category, patterns in S.PATTERNS.items():
        for p in patterns:
            need = re.sub(r"\\b|\\s\+|\(\?:\w+\)\?|\(\?:'s\)\?", " ", p).lower().replace("pop(?:ish|ery)", "popish popery")
            assert any(w in need for w in S.WORDS[category]), p
    said = ["A JEW, a devil", "the blackamoor is ugly", "Women are WEAK", "popery, an idol", "wild Irish", "false heathen Turk", "mild air", "", None]
    df = spark.createDataFrame([(x,) for x in said], "t string")
    assert all(r.a == r.b for r in df.select(S.safety_reason(F.col("t")).alias("a"), S.safety_reason(F.col("t"), words={}).alias("b")).collect())
    assert df.filter(S.safety_reason(F.col("t")) != "").count() == 6
