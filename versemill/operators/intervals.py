"""Joins of points and intervals by equality (J17, W18): intervals are cut into nested bins whose sizes are powers of two.

An interval [start, stop) is the union of at most two bins of each size, and a point lies in one bin of each size. So a point
is in an interval if and only if one of its bins is one of the interval's, and then exactly one: a join by equality, whatever
intervals overlap, nest or lie apart, and however many a key has. Places are whole numbers, negative ones too, below 2^LEVELS
in size; empty intervals hold nothing; null places and keys meet nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LEVELS = 40
#: A block has 2^BLOCK places, and so at most as many different starts of a key.
BLOCK = 8


def _down(x: Column, k: Column) -> Column:
    return F.call_function("shiftright", x, k)


def _sizes(length: Column) -> Column:
    """The highest level that an interval of this length can fill, and one more against the logarithm's rounding; null for an empty one."""
    return F.when(length > 0, F.least(F.floor(F.log2(length)).cast("int") + 1, F.lit(LEVELS)))


def bins_of_interval(start: Column, stop: Column) -> Column:
    """Array of (level, bin) that together are [start, stop). Only sizes up to the interval's own are tried."""

    def at(k: Column) -> Column:
        low, high = -_down(-start, k), _down(stop, k)
        some = low < high
        left = F.when(some & (low % 2 != 0), low)
        right = F.when(some & (high % 2 != 0), high - 1)
        return F.transform(F.array_compact(F.array(left, right)), lambda b: F.struct(k.alias("level"), b.alias("bin")))

    levels = F.coalesce(F.sequence(F.lit(0), _sizes(stop - start)), F.array().cast("array<int>"))
    return F.flatten(F.transform(levels, at))


def _binned(points: DataFrame, at: str, intervals: DataFrame, out: str) -> DataFrame:
    """A row for each bin that holds the point, up to the size of the longest interval (start, stop as long), and one without a bin where none fits."""
    top = intervals.agg(F.max(F.col("stop") - F.col("start")).alias("_n")).select(_sizes(F.col("_n")).alias("_n")).scalar()
    levels = points.withColumn("_top", top).withColumn("_l", F.explode_outer(F.sequence(F.lit(0), F.col("_top"))))
    return levels.withColumn(out, F.struct(F.col("_l").alias("level"), _down(F.col(at), F.col("_l")).alias("bin"))).drop("_top", "_l")


def _long(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.col(c).cast("long") for c in columns})


def stabbing(points: DataFrame, intervals: DataFrame, by: str, at: str = "pos") -> DataFrame:
    """Each pair of a point and an interval (``by``, start, stop, ...) of its key that holds it, once."""
    p = _long(points, at)
    i = _long(intervals, "start", "stop")
    p = _binned(p, at, i, "_b")
    i = i.withColumn("_b", F.explode(bins_of_interval(F.col("start"), F.col("stop")))).withColumnRenamed(by, "_by")
    return p.join(i, (p[by] == i["_by"]) & (p["_b"] == i["_b"])).drop("_b", "_by")


def stabbed(points: DataFrame, intervals: DataFrame, by: str, at: str = "pos") -> DataFrame:
    """Each point that some interval of its key holds, with their number ``spans`` and their latest end ``latest``, without the pairs.

    A bin has one row, whatever number of intervals it is part of, and a place is looked up once for all points there, so the
    work grows with rows, not with pairs.
    """
    i = _long(intervals, "start", "stop")
    held = i.select(F.col(by).alias("_by"), F.explode(bins_of_interval(F.col("start"), F.col("stop"))).alias("_b"), "stop").groupBy("_by", "_b").agg(F.count("*").alias("_n"), F.max("stop").alias("_until"))
    p = _long(points, at)
    places = _binned(p.select(F.col(by).alias("_of"), F.col(at).alias("_at")).distinct(), "_at", i, "_p")
    found = places.join(held, (F.col("_of") == F.col("_by")) & (F.col("_p") == F.col("_b"))).groupBy("_of", "_at").agg(F.sum("_n").alias("spans"), F.max("_until").alias("latest"))
    return p.join(found, (p[by] == F.col("_of")) & (p[at] == F.col("_at"))).drop("_of", "_at")


def _block(x: Column) -> Column:
    return _down(x, F.lit(BLOCK))


def _standing(entries: Column) -> Column:
    """Of a block's (_at, _longest), in order, those that lie in none before them."""
    none = F.struct(F.lit(-(1 << 63)).alias("far"), F.array().cast("array<struct<_at:bigint,_longest:bigint>>").alias("kept"))

    def step(before: Column, x: Column) -> Column:
        more = F.struct(F.greatest(before["far"], x["_longest"]).alias("far"), F.concat(before["kept"], F.array(x)).alias("kept"))
        return F.when(_inside(x, before["far"]), before).otherwise(more)

    return F.aggregate(entries, none, step)["kept"]


def _inside(x: Column, far: Column) -> Column:
    """Whether (_at, _longest) lies in the span that reaches ``far``, the furthest of those that begin sooner."""
    return (far > x["_at"]) & (far >= x["_longest"])


def outermost(spans: DataFrame, by: str) -> DataFrame:
    """Spans (``by``, start, stop, ...) that lie in no other of their key; spans that overlap in part both stay. Equal spans stay or go together.

    Of the spans that begin at a place only the longest can stay, and it lies in another if the furthest end of those that begin
    sooner is beyond its start and no sooner than its own end. A key's places are cut into blocks of 2^BLOCK. In a block this is a
    fold over its places; from the blocks before only those ends matter that reach into it, and only bins of whole blocks are
    joined for them. So the rows are shuffled once and their places twice, not for each size of bin.
    """
    s = _long(spans, "start", "stop").filter(F.col(by).isNotNull() & F.col("start").isNotNull() & F.col("stop").isNotNull())
    alike = s.groupBy(F.col(by).alias("_of"), F.col("start").alias("_at")).agg(F.max("stop").alias("_longest"))
    blocks = alike.repartition(F.col("_of"), _block(F.col("_at"))).groupBy("_of", _block(F.col("_at")).alias("_block")).agg(_standing(F.sort_array(F.collect_list(F.struct("_at", "_longest")))).alias("_kept"))

    ends = s.groupBy(F.col(by).alias("_by"), _block(F.col("start")).alias("_from")).agg(F.max("stop").alias("_until"))
    crossed = ends.select("_by", (F.col("_from") + 1).alias("start"), (_block(F.col("_until") - 1) + 1).alias("stop"), "_until")
    held = crossed.select("_by", F.explode(bins_of_interval(F.col("start"), F.col("stop"))).alias("_b"), "_until").groupBy("_by", "_b").agg(F.max("_until").alias("_until"))
    places = _binned(s.select(F.col(by).alias("_in"), _block(F.col("start")).alias("_place")).distinct(), "_place", crossed, "_p")
    reach = places.join(held, (F.col("_in") == F.col("_by")) & (F.col("_p") == F.col("_b"))).groupBy("_in", "_place").agg(F.max("_until").alias("_far"))

    met = blocks.join(reach, (F.col("_of") == F.col("_in")) & (F.col("_block") == F.col("_place")), "left")
    stay = met.select("_of", F.explode(F.filter("_kept", lambda x: F.col("_far").isNull() | ~_inside(x, F.col("_far")))).alias("_x")).select("_of", "_x._at", "_x._longest")
    return s.join(stay, (s[by] == F.col("_of")) & (s["start"] == F.col("_at")) & (s["stop"] == F.col("_longest"))).select(*spans.columns)
