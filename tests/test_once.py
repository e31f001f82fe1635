"""Values that a column expression names often are computed once; slices bound what is in memory; files are dropped side by side."""

from pyspark.sql import functions as F

from versemill.functions import spans as X
from versemill.functions import text as T
from versemill.functions import variants as V
from versemill.streaming import pipelines as P


def test_patterns_are_named_once(spark):
    """Each pattern matches a text in two expressions (matches, and what lies between), whatever the number of spans."""
    df = spark.createDataFrame([("a \"b c d e\" and \"f g h\" — Keats, x",), (None,), ("",)], "t string")
    found = df.select(F.inline(X.quotations(F.concat("t", F.lit(" end")))))
    assert [(r.start, r.stop, r.quote, r.author) for r in found.collect()] == [(2, 11, "b c d e", None), (16, 31, "f g h", "Keats")]
    plan = found._jdf.queryExecution().analyzed().toString()
    assert plan.count("concat(t#") == 1


def test_answers_are_parsed_once(spark):
    df = spark.createDataFrame([('[[{"id": 1}], "{\\"id\\": 2}", 3, null, "004"]',), (None,), ("[x",), ("7",)], "t string")
    out = df.select(V.selected(F.col("t")).alias("a"))
    got = [([(k.id, k.tier) for k in r.a.kept], [tuple(d) for d in r.a.dropped]) for r in out.collect()]
    assert got == [([("1", None), ("2", None), ("3", "publish"), ("4", "publish")], [("null", "no number, no object")]), ([], []), ([], [("[x", "no JSON")]), ([], [("7", "no list")])]
    assert out._jdf.queryExecution().analyzed().toString().count("t#") < 6


def test_slices_of_texts():
    texts = ["a" * 4, "b" * 4, "c" * 30, "", "d" * 9, "e"]
    assert list(T.text_slices(texts, 10)) == [texts[:2], texts[2:3], texts[3:]] and list(T.text_slices([], 10)) == []


def test_files_are_dropped_once_each(spark, tmp_path):
    at = F.timestamp_seconds(F.col("id") % 2000)
    clips = spark.range(4000).select(at.alias("at"), F.lit("A Title").alias("title"), F.concat(F.lit("text "), F.col("id")).alias("text"))
    P.drop_clips(clips, f"file://{tmp_path}/drops")
    found = spark.read.option("pathGlobFilter", "*.md").text(f"file://{tmp_path}/drops", wholetext=True)
    assert found.count() == 2000 and found.agg(F.min("value")).first()[0] >= "text 2000" and found.distinct().count() == 2000
