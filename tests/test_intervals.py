"""Intervals as nested bins against plain comparisons."""

import random

from pyspark.sql import functions as F

from versemill.operators import intervals as I


def test_bins_are_the_interval(spark):
    pairs = [(a, b) for a in range(-9, 10) for b in range(-9, 10)] + [(0, 1 << 39), (-(1 << 38), 5), (12345, 987654321)]
    rows = spark.createDataFrame(pairs, "a long, b long").select("a", "b", I.bins_of_interval(F.col("a"), F.col("b")).alias("bins")).collect()
    for r in rows:
        covered = sorted((x.bin << x.level, (x.bin + 1) << x.level) for x in r.bins)
        assert sum(b - a for a, b in covered) == max(0, r.b - r.a) and len(covered) <= 2 * I.LEVELS
        assert not covered or (covered[0][0], covered[-1][1]) == (r.a, r.b) and all(p[1] == q[0] for p, q in zip(covered, covered[1:]))


def test_random_spans_and_points(spark):
    rng = random.Random(3)
    spans = [(rng.choice(["a", "b", None]), s := rng.randrange(-40, 40), s + rng.randrange(0, 25), i) for i in range(300)] + [("c", 5, 9, 300), ("c", 5, 9, 301), ("a", None, 3, 302)]
    df = spark.createDataFrame(spans, "k string, start int, stop int, id int")
    inside = lambda x, o: o[0] == x[0] and o[1] <= x[1] and o[2] >= x[2] and (o[1], o[2]) != (x[1], x[2]) and not (x[1] == x[2] == o[2])
    whole = [x for x in spans if x[0] is not None and x[1] is not None]
    assert sorted(r.id for r in I.outermost(df, "k").collect()) == sorted(x[3] for x in whole if not any(inside(x, o) for o in whole))
    points = [(rng.choice(["a", "b", "z", None]), rng.choice([None, *range(-45, 70)]), i) for i in range(200)]
    found = I.stabbing(spark.createDataFrame(points, "k string, pos int, p int"), df, "k").select("p", "id").collect()
    assert sorted(map(tuple, found)) == sorted((p, o[3]) for k, at, p in points for o in whole if at is not None and k == o[0] and o[1] <= at < o[2])


def test_a_key_of_very_many_spans_is_in_many_tasks(spark):
    many = spark.range(200_000).select(F.lit("k").alias("k"), F.col("id").alias("start"), (F.col("id") + 1 + (F.col("id") % 7 == 0).cast("long") * 6).alias("stop"))
    assert I.outermost(many, "k").count() == -(-200_000 // 7)
    text = I.outermost(many, "k")._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in text and "NestedLoop" not in text and "Cartesian" not in text


def test_stabbed_is_the_pairs_counted(spark):
    rng = random.Random(5)
    spans = [(rng.choice(["a", "b", None]), s := rng.randrange(-40, 40), s + rng.randrange(0, 25)) for _ in range(300)] + [("a", None, 3), ("b", -3, 1 << 38)]
    df = spark.createDataFrame(spans, "k string, start long, stop long")
    points = spark.createDataFrame([(rng.choice(["a", "b", "z", None]), rng.choice([None, *range(-45, 70)]), i) for i in range(200)], "k string, pos int, p int")
    pairs = I.stabbing(points, df, "k").groupBy("p").agg(F.count("*").alias("spans"), F.max("stop").alias("latest"))
    assert sorted(map(tuple, I.stabbed(points, df, "k").select("p", "spans", "latest").collect())) == sorted(map(tuple, pairs.collect()))
    assert I.stabbed(points, df.limit(0), "k").count() == 0 and I.outermost(df.filter("start = stop").limit(3), "k").count() >= 0


def test_work_grows_with_rows_not_with_pairs(spark):
    """4000 points in each of 4000 equal spans: 16 million pairs, of which none is made; bins up to the longest span only."""
    one = spark.range(4000).select(F.lit("k").alias("k"), F.lit(7).alias("pos"), "id")
    spans = spark.range(4000).select(F.lit("k").alias("k"), F.lit(5).alias("start"), F.lit(9).alias("stop"))
    found = I.stabbed(one, spans, "k")
    assert found.agg(F.count("*"), F.min("spans"), F.max("latest")).first() == (4000, 4000, 9)
    assert spans.select(F.max(F.size(I.bins_of_interval(F.lit(5), F.lit(9))))).first()[0] <= 4
    assert I._binned(one, "pos", spans, "b").count() == 4 * 4000


def test_outermost_across_blocks(spark):
    """Spans within blocks, at their borders, over many of them, of far places, in copies."""
    rng, size = random.Random(8), 1 << I.BLOCK
    starts = [*range(-3 * size, 3 * size, 37), *(b * size + d for b in range(-2, 3) for d in (-1, 0, 1))]
    ends = lambda s: rng.choice([s, s + 1, s + rng.randrange(40), s + rng.randrange(4 * size), (s // size + rng.randrange(1, 4)) * size + rng.choice([-1, 0, 0, 1])])
    spans = [(rng.choice("abcdefgh"), s := rng.choice(starts), max(s, ends(s))) for _ in range(1500)]
    spans += [("far", s := i << 30, s + w) for i in range(-9, 10) for w in (1, (1 << 30) - 1, 1 << 30)] + [("long", -(1 << 38), 1 << 38), ("long", 5, 5), ("long", 1 << 38, 1 << 38)] + spans[:200]
    df = spark.createDataFrame([(*x, i) for i, x in enumerate(spans)], "k string, start long, stop long, id int")
    inside = lambda x, o: o[0] == x[0] and o[1] <= x[1] and o[2] >= x[2] and (o[1], o[2]) != (x[1], x[2]) and not (x[1] == x[2] == o[2])
    assert sorted(r.id for r in I.outermost(df, "k").collect()) == [i for i, x in enumerate(spans) if not any(inside(x, o) for o in spans)]


def test_outermost_shuffles_a_span_a_few_times(spark):
    """Not once for each size of bin: that was 14 rows for each of these spans."""

    def sent():
        context, jvm = spark.sparkContext._jsc.sc(), spark.sparkContext._jvm
        context.listenerBus().waitUntilEmpty()
        none, quantiles = jvm.java.util.ArrayList(), spark.sparkContext._gateway.new_array(jvm.double, 0)
        stages = context.statusStore().stageList(none, False, False, quantiles, none)
        return {(x.stageId(), x.attemptId()): x.shuffleWriteRecords() for x in map(stages.apply, range(stages.size()))}

    n, start = 30_000, F.pmod(F.xxhash64("id"), F.lit(900))
    df = spark.range(n).select((F.col("id") % 50).alias("k"), start.alias("start"), (start + F.pmod(F.xxhash64("id", F.lit(1)), F.lit(60))).alias("stop"), "id")
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        before = sent()
        I.outermost(df, "k").write.format("noop").mode("overwrite").save()
        rows = sum(x for stage, x in sent().items() if stage not in before)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    assert n < rows < 4 * n
