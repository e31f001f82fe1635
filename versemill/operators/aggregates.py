"""Aggregations (A): partial aggregation before every shuffle; lists only where the list is the result."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def used_often(counts: DataFrame, threshold: int) -> DataFrame:
    """HAVING n >= threshold."""
    return counts.filter(F.col("n") >= threshold)


def warnings(counts: DataFrame, key: str, threshold: int = 3) -> DataFrame:
    """A04."""
    return counts.filter(F.col("n") >= threshold).select(F.format_string("%s: used %d times", key, "n").alias("warning"))


def top(counts: DataFrame, key: str, k: int = 5) -> DataFrame:
    """The ``k`` largest, ties by key."""
    return counts.orderBy(F.col("n").desc(), F.col(key).asc()).limit(k)


def facets(chunks: DataFrame, by: str = "poet") -> DataFrame:
    """Rows, sorted distinct works and periods of each poet."""
    return chunks.groupBy(by).agg(F.count("*").alias("n"), F.sort_array(F.collect_set("title")).alias("works"), F.sort_array(F.collect_set("period")).alias("periods"))


def corpus_counts(chunks: DataFrame, columns: list[str]) -> DataFrame:
    """(facet, value, n) for each column and, as facet 'all', the total: grouping sets in one pass."""
    sets = chunks.select([F.col(c).cast("string").alias(c) for c in columns]).groupingSets([[F.col(c)] for c in columns] + [[]], *columns)
    counted = sets.agg(F.count("*").alias("n"), F.grouping_id(*columns).alias("_g"))
    facet, value = F.lit("all"), F.lit(None).cast("string")
    for i, c in enumerate(columns):
        here = F.col("_g") == sum(1 << (len(columns) - 1 - j) for j in range(len(columns)) if j != i)
        facet, value = F.when(here, c).otherwise(facet), F.when(here, F.col(c)).otherwise(value)
    return counted.select(facet.alias("facet"), value.alias("value"), "n")


def length_report(chunks: DataFrame, by: str, tokens: Column) -> DataFrame:
    """A10: of each poet, counts and the quantiles that stand at index n div 4, n div 2 and 3n div 4 of the sorted lengths.

    Lengths are counted first, so what is sorted is distinct lengths, not rows.
    """
    cells = chunks.select(by, "title", "text", tokens.alias("_t")).groupBy(by, "_t").agg(F.count("*").alias("_n"))
    run = F.sum("_n").over(Window.partitionBy(by).orderBy("_t"))
    n = F.sum("_n").over(Window.partitionBy(by))
    cells = cells.withColumns({"_run": run, "_all": n})
    at = lambda k: F.min(F.when(F.col("_run") > F.floor(F.col("_all") * k / 4), F.col("_t")))
    shape = cells.groupBy(by).agg(
        F.sum("_n").alias("n"), F.min("_t").alias("least"), at(1).alias("q25"), at(2).alias("q50"), at(3).alias("q75"), F.max("_t").alias("most"),
        F.round(F.sum(F.col("_t") * F.col("_n")) / F.sum("_n"), 4).alias("mean"), F.sum(F.when(F.col("_t") < 20, F.col("_n")).otherwise(0)).alias("small"), F.sum(F.when(F.col("_t") > 500, F.col("_n")).otherwise(0)).alias("large"),
    )
    return shape


def repeated_texts(chunks: DataFrame) -> DataFrame:
    """A10: how many rows repeat another's text. Counted by digest, so hot texts are summed before the shuffle."""
    return chunks.groupBy(F.sha2("text", 256).alias("_d")).agg((F.count("*") - 1).alias("_n")).agg(F.coalesce(F.sum("_n"), F.lit(0)).alias("n"))


def nearest_of_each(rows: DataFrame, key: str, distance: str, columns: list[str]) -> DataFrame:
    """Of each key the row of least distance, ties by the columns."""
    least = rows.groupBy(key).agg(F.min(F.struct(distance, *columns)).alias("_m"))
    return least.select(key, f"_m.{distance}", *[f"_m.{c}" for c in columns])


def by_day(rows: DataFrame, day: str, item: Column, order: list[str]) -> DataFrame:
    """The items of each day in order."""
    gathered = F.sort_array(F.collect_list(F.struct(*order, item.alias("_item"))))
    return rows.groupBy(day).agg(F.transform(gathered, lambda x: x["_item"]).alias("items"))


def composites(members: DataFrame) -> DataFrame:
    """Groups with their parts in order, latest time and the first part's stimulus."""
    return members.groupBy("group_id").agg(
        F.transform(F.sort_array(F.collect_list(F.struct("place", "id"))), lambda x: x["id"]).alias("parts"), F.max("ts").alias("latest"), F.min_by("stimulus", "place").alias("stimulus")
    )


def work_sizes(docs: DataFrame, by: str) -> DataFrame:
    """Texts, lines and characters of each work."""
    return docs.groupBy(by).agg(F.count("*").alias("texts"), F.sum(F.size(F.split("text", "\n", -1))).alias("lines"), F.sum(F.length("text")).alias("chars"))


def status_counts(rows: DataFrame, by: str, states: dict[str, str]) -> DataFrame:
    """Conditional counts in one pass."""
    return rows.groupBy(by).agg(*[F.count_if(F.expr(condition)).alias(name) for name, condition in states.items()])


def first_of_each(rows: DataFrame, key: Column, order: list[str]) -> DataFrame:
    """The first row of each key in order. By aggregation: the key's rows are never gathered."""
    columns = [c for c in rows.columns if c not in order]
    first = rows.groupBy(key.alias("_key")).agg(F.min(F.struct(*order, *columns)).alias("_r"))
    return first.select("_r.*").select(*rows.columns)


def ordered_text(rows: DataFrame, by: str, text: str, order: str, separator: str) -> DataFrame:
    """Texts joined in order."""
    parts = F.sort_array(F.collect_list(F.struct(order, text)))
    return rows.groupBy(by).agg(F.array_join(F.transform(parts, lambda x: x[text]), separator).alias("joined"))


def surnames(rows: DataFrame, author: str) -> DataFrame:
    """(surname, n): what stands before the first comma of an author, or all of it where there is none; null authors are counted as null."""
    return rows.groupBy(F.trim(F.substring_index(author, ",", 1)).alias("surname")).agg(F.count("*").alias("n"))
