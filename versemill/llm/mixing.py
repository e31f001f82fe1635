"""Mixing sources to target weights by systematic sampling.

Every document of a source has the same expected number of copies (target words over the source's words). Within the
source, documents stand in order of size; the expected copies are summed along that order, one random offset is added,
and a document is emitted once for each integer that its stretch of the sum crosses. Since the order is by size, the
words taken differ from the target by about one largest document at most.

Defined results: null text has size 0; a null source is a source of its own, last in order; repeated rows are documents
of their own; equal sizes are ordered by the md5 of the id, then the id; an empty table gives an empty result; extra
columns pass through ``mix_documents`` untouched, whatever their names, and are ignored by ``plan_mix``. The table of
sources, a row for each, is sorted in one task: millions of sources are fine, a source for each document is not meant.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ranking import ranged, with_rank
from .staging import Staging

WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    """Number of words; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[int, ...], share: float, max_repeat: int) -> DataFrame:
    """(source, source_size) to its index, target and rate; one row for each source, the only thing sorted globally.

    A target is weight times a common level, or ``max_repeat`` times the source's size where that is less; the level is
    the one at which targets sum to ``share`` of all sizes. With sources in order of cap over weight, the level is the
    largest of (what is left after the caps before) over (the weights left).
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    by_cap = Window.orderBy((F.col("_cap") / F.col("_weight")).asc(), "_source").rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    table = F.array(*[F.lit(w) for w in weights])
    s = sizes.withColumn("_source", F.row_number().over(by_name) - 1)
    s = s.withColumn("_weight", F.get(table, F.col("_source") % len(weights))).withColumn("_cap", F.col("source_size") * max_repeat)
    s = s.withColumn("_caps", F.coalesce(F.sum("_cap").over(by_cap), F.lit(0))).withColumn("_weights", F.coalesce(F.sum("_weight").over(by_cap), F.lit(0)))
    left = F.sum("source_size").over(everything) * F.lit(float(share)) - F.col("_caps")
    level = F.max(left / (F.sum("_weight").over(everything) - F.col("_weights"))).over(everything)
    s = s.withColumn("target", F.least(F.col("_cap").cast("double"), F.col("_weight") * level))
    return s.withColumn("_rate", F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0)))


def offset(source: Column, seed: int) -> Column:
    """The random offset of a source in [0, 1), the same on each run."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(source, F.lit("")), F.when(source.isNull(), "?").otherwise("")))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def _planned(light: DataFrame, staging: Staging, kept: tuple, weights: tuple[int, ...], share: float, max_repeat: int, seed: int) -> DataFrame:
    """``light`` (doc_id, source, size and what else is to be carried), with source_size, target, copies and taken. Of the staged tables ``kept`` stay."""
    carried = light.columns
    sizes = staging.write(light.groupBy("source").agg(F.sum("size").alias("source_size")), "source-sizes")
    targets = source_targets(sizes, weights, share, max_repeat).select(F.col("source").alias("_name"), "_source", "source_size", "target", "_rate")
    rows = light.join(targets, F.col("source").eqNullSafe(F.col("_name"))).drop("_name")
    key = F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    dealt = ranged(rows, staging, "_source", [F.col("size").asc(), key.asc(), F.col("doc_id").asc()])
    staging.keep(dealt, *kept)
    rows = with_rank(dealt, "_source")
    u = offset(F.col("source"), seed)
    crossed = F.floor((F.col("_rank") + 1) * F.col("_rate") + u) - F.floor(F.col("_rank") * F.col("_rate") + u)
    copies = F.least(crossed, F.lit(max_repeat))  # rates are at most max_repeat; this only undoes rounding of the sum
    out = rows.withColumn("copies", copies.cast("int")).withColumn("taken", F.col("copies") * F.col("size"))
    return out.select(*carried, "source_size", "target", "copies", "taken")


def plan_mix(
    docs: DataFrame, *, weights: tuple[int, ...] = (5, 2, 1), share: float = 1.0, max_repeat: int = 3, seed: int = 17,
    id_col: str = "doc_id", source_col: str = "source", text_col: str = "text",
) -> DataFrame:
    """(doc_id, source, size, source_size, target, copies, taken) for every row."""
    staging = Staging(docs.sparkSession, "mixing")
    light = docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), word_count(F.col(text_col)).alias("size"))
    return _planned(staging.write(light, "sizes"), staging, (), weights, share, max_repeat, seed)


def mix_documents(
    docs: DataFrame, *, weights: tuple[int, ...] = (5, 2, 1), share: float = 1.0, max_repeat: int = 3, seed: int = 17,
    id_col: str = "doc_id", source_col: str = "source", text_col: str = "text",
) -> DataFrame:
    """The mix itself: the rows of ``docs``, each as often as the plan takes it.

    Rows are written once with their sizes; only ids and sizes are sorted, and whole rows are shuffled once, to their copies,
    by the same kind of join at any size.
    """
    staging = Staging(docs.sparkSession, "mixing")
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")  # set apart, so that its names can't clash
    size = word_count(F.col(text_col)).alias("size")
    whole = staging.write(docs.select(row, F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), size, F.monotonically_increasing_id().alias("at")), "rows")
    planned = _planned(whole.select("at", "doc_id", "source", "size"), staging, (whole,), weights, share, max_repeat, seed)
    taken = staging.write(planned.filter("copies > 0").select("at", "copies"), "copies")
    staging.keep(whole, taken)
    repeated = whole.select("at", "row").join(taken.hint("merge"), "at").select("row", F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("nth"))
    return repeated.select(*[F.col(f"row.`{c}`").alias(c) for c in docs.columns])
