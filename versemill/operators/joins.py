"""Joins (J): cascades, bands, intervals, overlays, prefix and postings joins, written so that an equality carries each shuffle."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.fuzzy import partial_ratio_of


def cascade(rows: DataFrame, key: str, steps: list[tuple[DataFrame, list[Column], list[str]]], value: str) -> DataFrame:
    """``value`` from the first step that has one. A step is (table, left keys, right keys); of several matches the smallest value counts.

    Each step is one equality join with a table of one row for each key, so rows never multiply.
    """
    out, found = rows, []
    for i, (table, left, right) in enumerate(steps):
        unique = table.groupBy(*[F.col(c).alias(f"_k{i}_{c}") for c in right]).agg(F.min(value).alias(f"_v{i}"))
        on = [lhs == F.col(f"_k{i}_{c}") for lhs, c in zip(left, right)]
        out = out.join(unique, on, "left").drop(*[f"_k{i}_{c}" for c in right])
        found.append(F.col(f"_v{i}"))
    return out.withColumn(value, F.coalesce(*found)).drop(*[f"_v{i}" for i in range(len(steps))])


def enrich(rows: DataFrame, notes: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Left join with the notes of each key; of several the greatest by ``columns``."""
    one = notes.groupBy(F.col(key).alias("_k")).agg(F.max(F.struct(*columns)).alias("_note")).select("_k", "_note.*")
    return rows.join(one, rows[key] == F.col("_k"), "left").drop("_k")


def neighbours(rows: DataFrame, by: list[str], order: str, width: int) -> DataFrame:
    """Pairs of rows of a group at most ``width`` places apart.

    The place is cut into blocks of ``width`` + 1; a row meets only its own block and the two beside it, so a large group is not paired with itself.
    """
    block = F.floor(F.col(order) / (width + 1))
    a = rows.withColumn("_block", block).alias("a")
    b = rows.withColumn("_block", F.explode(F.array(block - 1, block, block + 1))).alias("b")
    on = [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in by] + [F.col("a._block") == F.col("b._block"), F.abs(F.col(f"a.{order}") - F.col(f"b.{order}")) <= width]
    return a.join(b, on)


def expand_groups(groups: DataFrame, ids: str = "ids") -> DataFrame:
    """Members of groups with their place."""
    return groups.select("group_id", F.posexplode(ids).alias("place", "id"))


def overlay_text(base: DataFrame, overrides: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """An override wins where it is neither null nor empty; of several for one key the greatest, column by column."""
    o = overrides.groupBy(F.col(key).alias("_k")).agg(*[F.max(F.nullif(F.col(c), F.lit(""))).alias(f"_{c}") for c in columns])
    joined = base.join(o, base[key] == F.col("_k"), "left")
    return joined.withColumns({c: F.coalesce(F.col(f"_{c}"), F.col(c)) for c in columns}).drop("_k", *[f"_{c}" for c in columns])


def first_prefix(lines: DataFrame, prefixes: DataFrame, least: int | None = None) -> DataFrame:
    """Each line with the title of the first listed prefix that it starts with; an empty prefix fits nothing.

    Different beginnings of lines, cut at each length that some prefix has, meet different prefixes by equality, so neither
    repeated lines nor prefixes that begin alike make pairs. ``least`` is of no effect any more: equality needs no shortest length.
    """
    p = prefixes.filter("prefix <> ''").groupBy("prefix").agg(F.min_by("title", "place").alias("_title"), F.min("place").alias("_place"))
    sizes = p.agg(F.collect_set(F.length("prefix")).alias("_sizes"), F.max(F.length("prefix")).alias("_most"))
    cut = lines.withColumn("_begin", F.substring("line", F.lit(1), F.coalesce(sizes.select("_most").scalar(), F.lit(0))))
    begins = cut.select("_begin").distinct().withColumn("_sizes", sizes.select("_sizes").scalar()).withColumn("_size", F.explode("_sizes"))
    heads = begins.filter(F.length("_begin") >= F.col("_size")).select("_begin", F.substring("_begin", F.lit(1), F.col("_size")).alias("_head"))
    found = heads.join(p, F.col("_head") == F.col("prefix")).groupBy(F.col("_begin").alias("_of")).agg(F.min_by("_title", "_place").alias("title"))
    return cut.join(found, F.col("_begin") == F.col("_of")).select(*lines.columns, "title")


def between_marks(marks: DataFrame, points: DataFrame, by: str) -> DataFrame:
    """Each point with the last mark at or before it in its group: an interval join as one sort instead of a range condition."""
    m = marks.select(by, F.col("pos"), F.lit(0).alias("_kind"), F.col("name"), F.lit(None).cast("string").alias("item"))
    p = points.select(by, F.col("pos"), F.lit(1).alias("_kind"), F.lit(None).cast("string").alias("name"), F.col("item"))
    seen = F.last("name", ignorenulls=True).over(Window.partitionBy(by).orderBy("pos", "_kind"))
    return m.unionByName(p).withColumn("name", seen).filter("_kind = 1").select(by, "pos", "item", "name")


def either_contains(rows: DataFrame, names: DataFrame, column: str, default: object) -> DataFrame:
    """The value of the first listed name that contains, or is contained in, ``column``; ``names`` (name, value, place) is a configured list, passed as one array."""
    table = names.agg(F.array_sort(F.collect_list(F.struct("place", "name", "value"))).alias("_names"))
    hits = F.filter("_names", lambda n: F.contains(F.col(column), n["name"]) | F.contains(n["name"], F.col(column)))
    return rows.withColumn("_names", table.scalar()).withColumn("value", F.coalesce(F.get(hits, F.lit(0))["value"], F.lit(default))).drop("_names")


def postings(lines: DataFrame, key: str, text: str = "text") -> DataFrame:
    """(word, key) of every distinct word of three letters or more."""
    return lines.select(F.col(key), F.explode(F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit("[a-z]{3,}"), F.lit(0)))).alias("word"))


def line_candidates(asked: DataFrame, lines: DataFrame, *, rarest: int = 3, least: int = 2, most: int | None = 500) -> DataFrame:
    """(ask_id, line_id, overlap): lines that hold all of the ``rarest`` known words of a query, or, where none does, its rarest word.

    Of the lines' words only those that some query has are counted and shuffled. A query looks up ``rarest`` words, so frequent
    words are joined only where it has nothing rarer. A query that more than ``most`` lines answer says too little: it gets none;
    with None there is no such bound, and every candidate is compared word by word.
    """
    asked_words = postings(asked, "ask_id")
    line_words = postings(lines, "line_id").join(asked_words.select("word").distinct(), "word", "left_semi")
    often = line_words.groupBy("word").agg(F.count("*").alias("df"))
    ranked = asked_words.join(often, "word").withColumn("_r", F.row_number().over(Window.partitionBy("ask_id").orderBy("df", "word"))).filter(F.col("_r") <= rarest)
    wanted = ranked.groupBy("ask_id").agg(F.count("*").alias("_all"))
    hits = ranked.join(line_words, "word").groupBy("ask_id", "line_id").agg(F.count("*").alias("_hit"), F.min("_r").alias("_best")).join(wanted, "ask_id")
    full = F.max((F.col("_hit") == F.col("_all")).cast("int"))
    best = hits.groupBy("ask_id").agg(full.alias("_full"))
    hits = hits.join(best, "ask_id").filter(F.when(F.col("_full") == 1, F.col("_hit") == F.col("_all")).otherwise(F.col("_best") == 1))
    if most is not None:
        few = hits.groupBy("ask_id").agg(F.count("*").alias("_n")).filter(F.col("_n") <= most).select("ask_id")
        hits = hits.join(few, "ask_id")
    hits = hits.select("ask_id", "line_id")
    words = lambda text: F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit("[a-z]{3,}"), F.lit(0)))
    found = hits.join(asked.select("ask_id", words("text").alias("_asked")), "ask_id").join(lines.select("line_id", F.col("text").alias("_line")), "line_id")
    overlap = found.select("ask_id", "line_id", F.size(F.array_intersect("_asked", words("_line"))).cast("long").alias("overlap"))
    return overlap.filter(F.col("overlap") >= least)


def fuzzy_best(asked: DataFrame, lines: DataFrame, candidates: DataFrame, threshold: float = 70, score: Callable[[Column, Column], Column] | None = None) -> DataFrame:
    """Of the candidate lines (ask_id, line_id) the one most like the question: (ask_id, line_id, score), from ``threshold`` on, ties to the first line.

    ``score`` compares two texts; by default the partial ratio.
    """
    joined = candidates.join(asked.select("ask_id", F.col("text").alias("_a")), "ask_id").join(lines.select("line_id", F.col("text").alias("_l")), "line_id")
    best = joined.withColumn("score", (score or partial_ratio_of)(F.col("_a"), F.col("_l"))).filter(F.col("score") >= threshold)
    return best.groupBy("ask_id").agg(F.min(F.struct((-F.col("score")).alias("_m"), "line_id")).alias("_b")).select("ask_id", F.col("_b.line_id"), (-F.col("_b._m")).alias("score"))


def fuzzy_best_of_group(rows: DataFrame, by: list[str], threshold: float, score: Callable[[Column, Column], Column], may: Callable[[Column, Column], Column] | None = None) -> DataFrame:
    """For each row (ask_id, text, ``by``) the row of its group with another id whose text is most like it: (ask_id, line_id, score), from ``threshold`` on, ties to the smallest id.

    Different texts of a group are compared, not rows: a text stands for all rows that hold it, by its smallest id, and for
    each of these rows by the next one. ``may`` is a cheap test without which two texts can't reach the threshold.
    """
    key = [*by, "text"]
    texts = rows.dropna(subset=key).groupBy(*key).agg(F.min("ask_id").alias("_first"))
    a, b = texts.select(*by, F.col("text").alias("_a")), texts.select(*by, F.col("text").alias("_l"), "_first")
    pairs = a.join(b, by).filter(F.col("_a") != F.col("_l"))
    pairs = (pairs.filter(may(F.col("_a"), F.col("_l"))) if may else pairs).withColumn("_s", score(F.col("_a"), F.col("_l"))).filter(F.col("_s") >= threshold)
    near = pairs.groupBy(*by, F.col("_a").alias("text")).agg(F.min(F.struct((-F.col("_s")).alias("_m"), F.col("_first").alias("line_id"))).alias("_near"))
    mine = rows.join(texts, key)
    second = mine.filter(F.col("ask_id") > F.col("_first")).groupBy(*key).agg(F.min("ask_id").alias("_second"))
    known = texts.join(second, key, "left").join(near, key, "left").drop("_first")
    own = F.when(F.col("ask_id") == F.col("_first"), F.col("_second")).otherwise(F.col("_first"))
    alike = score(F.col("text"), F.col("text"))
    same = F.when(own.isNotNull() & (alike >= threshold), F.struct((-alike).alias("_m"), own.alias("line_id")))
    best = mine.join(known, key).select("ask_id", F.least(same, "_near").alias("_b")).filter("_b IS NOT NULL")
    best = best.groupBy("ask_id").agg(F.min("_b").alias("_b"))
    return best.select("ask_id", F.col("_b.line_id"), (-F.col("_b._m")).alias("score"))


def lengths_near(threshold: int) -> Callable[[Column, Column], Column]:
    """Whether two texts' lengths let ``whole_ratio`` reach ``threshold``: the edit distance is at least their difference."""
    return lambda a, b: 100 * F.least(F.length(a), F.length(b)) >= threshold * F.greatest(F.length(a), F.length(b))


def whole_ratio(a: Column, b: Column) -> Column:
    """100 * (1 - edit distance over the longer length), rounded down: a score for texts that should match as a whole; no UDF."""
    return F.floor(100 * (1 - F.levenshtein(a, b) / F.greatest(F.length(a), F.length(b), F.lit(1)))).cast("int")


def as_of(left: DataFrame, right: DataFrame, by: str, at: str, value: str) -> DataFrame:
    """The value in force at each left row: the last right row of the group at or before it."""
    a = left.withColumns({"_side": F.lit(1), "_value": F.lit(None).cast(dict(right.dtypes)[value])})
    b = right.select(by, at, F.col(value).alias("_value")).withColumn("_side", F.lit(0))
    both = a.unionByName(b, allowMissingColumns=True)
    held = F.last("_value", ignorenulls=True).over(Window.partitionBy(by).orderBy(at, "_side"))
    return both.withColumn(value, held).filter("_side = 1").drop("_side", "_value")
