"""Gap repair (X30-X36, J10-J13, S26): dictionary fills by masked words, fills from a clean line, and the cascade of passes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .joins import line_candidates

GAP = "[...]"
# Letter pairs that speak against a word, and endings that speak for it.
BAD_PAIRS = (
    "ii", "uu", "qi", "qo", "qa", "qe", "qy", "bx", "cx", "dx", "fx", "gx", "hx", "jx", "kx", "lx", "mx", "nx", "px", "rx", "sx", "vx", "wx", "zx",
    "xj", "xk", "xq", "xz", "jj", "kk", "vv", "ww", "yy", "zz", "qq",
)
GOOD_ENDINGS = ("tion", "ness", "ment", "ous", "ing", "ght", "ble")
# Endings by which a dictionary word is extended; a final e is dropped before those that begin with one.
EXTENSIONS = ("s", "es", "ed", "er", "est", "ing", "ly", "th", "st")


def dictionary(words: DataFrame, column: str = "word") -> DataFrame:
    """Distinct lower-case words with their extensions."""
    w = F.lower(column)
    stem = F.regexp_replace(w, "e$", "")
    grown = F.array(w, *[F.concat(w, F.lit(e)) for e in EXTENSIONS], *[F.concat(stem, F.lit(e)) for e in EXTENSIONS if e[0] in "ei"])
    return words.filter(w.rlike("^[a-z]+$")).select(F.explode(grown).alias("word")).distinct()


def around(context: Column) -> tuple[Column, Column]:
    """The letters directly before and after the first gap, lower-case."""
    before, after = F.substring_index(context, GAP, 1), F.substring(context, F.locate(GAP, context) + len(GAP), F.length(context))
    return F.lower(F.regexp_extract(before, "([A-Za-z]*)$", 1)), F.lower(F.regexp_extract(after, "^([A-Za-z]*)", 1))


def masks(words: DataFrame, n: int) -> DataFrame:
    """(mask, word, fill): each word with ``n`` letters in a row left out, at every place: the key under which a gap finds it by equality."""
    places = F.sequence(F.lit(1), F.length("word") - n + 1)
    holes = F.transform(places, lambda p: F.struct(F.concat(F.substring("word", F.lit(1), p - 1), F.lit("_"), F.substring("word", p + n, F.length("word"))).alias("mask"), F.substring("word", p, F.lit(n)).alias("fill")))
    return words.filter(F.length("word") >= n).select("word", F.inline(holes))


def word_score(word: Column, preferred: list[str]) -> Column:
    """0 for preferred words; else 1, and 10 for each place where a bad pair begins, less 1 for a good ending."""
    bad = F.regexp_count(word, F.lit("(?=" + "|".join(BAD_PAIRS) + ")"))  # looks ahead, so pairs that overlap count each
    ending = word.rlike("(?:" + "|".join(GOOD_ENDINGS) + ")$")
    return F.when(word.isin(preferred), 0).otherwise(1 + 10 * bad - ending.cast("int"))


def letter_fills(gaps: DataFrame, words: DataFrame, preferred: list[str], n: int) -> DataFrame:
    """(gap_id, fill) where ``n`` missing letters follow from the dictionary: one candidate; or, inside a word, the best of
    up to three, or of more if it is a preferred word. Equal scores go to the alphabetically first fill."""
    before, after = around(F.col("context"))
    keyed = gaps.filter((F.col("letters") == n) & F.contains("context", F.lit(GAP))).select("gap_id", before.alias("b"), after.alias("a"))
    keyed = keyed.withColumn("mask", F.concat("b", F.lit("_"), "a"))
    found = keyed.join(masks(words, n), "mask").groupBy("gap_id", "b", "a").agg(F.count("*").alias("k"), F.min(F.struct(word_score(F.col("word"), preferred).alias("s"), F.col("fill").alias("f"))).alias("best"))
    inside = (F.col("b") != "") & (F.col("a") != "")
    return found.filter((F.col("k") == 1) | (inside & ((F.col("k") <= 3) | (F.col("best.s") == 0)))).select("gap_id", F.col("best.f").alias("fill"))


def fill_from_line(context: Column, line: Column) -> Column:
    """What a clean line has in place of the gap, from up to three words on either side; null if nothing fits or the fill is over 20 characters.

    The pattern is built for each row and run by the built-in regex function.
    """
    before, after = F.substring_index(context, GAP, 1), F.substring(context, F.locate(GAP, context) + len(GAP), F.length(context))
    quoted = lambda x: F.concat(F.lit("\\Q"), F.replace(x, F.lit("\\E"), F.lit("")), F.lit("\\E"))
    head = F.regexp_extract(before, r"((?:\S+\s+){0,2}\S*)$", 1)
    tail = F.regexp_extract(after, r"^(\S*(?:\s+\S+){0,2})", 1)
    loose = lambda x: F.regexp_replace(quoted(x), r"\s+", r"\\E\\s+\\Q")
    pattern = F.concat(F.lit("(?i)"), loose(head), F.lit("(.+?)"), loose(tail), F.when(tail == "", F.lit(r"(?=\s|$)")).otherwise(F.lit("")))
    fill = F.trim(F.call_function("regexp_extract", line, pattern, F.lit(1)))
    return F.when((fill != "") & (F.length(fill) <= 20), fill)


def windows(lines: DataFrame, centres: DataFrame, by: str, width: int = 5) -> DataFrame:
    """(ask_id, block): the lines up to ``width`` places around each centre (ask_id, ``by``, pos), as one text; blank lines are left out.

    ``lines``: (``by``, pos, text). A centre asks for its places one by one, so the join is an equality.
    """
    asked = centres.select("ask_id", by, F.explode(F.sequence(F.col("pos") - width, F.col("pos") + width)).alias("pos"))
    near = asked.join(lines.filter(F.trim("text") != ""), [by, "pos"])
    gathered = F.sort_array(F.collect_list(F.struct("pos", F.trim("text").alias("text"))))  # 2 * width + 1 lines at most
    return near.groupBy("ask_id").agg(F.array_join(F.transform(gathered, lambda x: x["text"]), " ").alias("block"))


def fill_from_window(context: Column, block: Column) -> Column:
    """The words that a clean block has between the three words before the gap and the three after; one word where the gap is at an end. Null if there is not exactly one gap, or no fit."""
    parts = F.split(context, r"\[\.\.\.\]", -1)
    words = lambda x: F.filter(F.split(F.trim(x), r"\s+"), lambda w: w != "")
    before, after = words(F.get(parts, F.lit(0))), words(F.coalesce(F.get(parts, F.lit(1)), F.lit("")))
    before, after = F.slice(before, F.greatest(F.size(before) - 2, F.lit(1)), F.lit(3)), F.slice(after, F.lit(1), F.lit(3))
    loose = lambda found: F.array_join(F.transform(found, lambda w: F.concat(F.lit("\\Q"), w, F.lit("\\E"))), r"\s+")
    has_before, has_after = F.size(before) > 0, F.size(after) > 0
    inner = F.when(has_before & has_after, r"\s+(.+?)\s+").when(has_before, r"\s+(\S+)").when(has_after, r"(\S+)\s+")
    pattern = F.concat(F.lit("(?i)"), loose(before), inner, loose(after))
    fill = F.trim(F.call_function("regexp_extract", block, pattern, F.lit(1)))
    return F.when((F.size(parts) == 2) & (fill != ""), fill)


def corpus_fills(gaps: DataFrame, lines: DataFrame, *, most: int | None = 500) -> DataFrame:
    """(gap_id, fill) from a corpus of clean lines (line_id, text): of the candidates of ``line_candidates`` for the words
    around the gap the line that holds most of them, ties to the first, and what it has in place of the gap."""
    asked = gaps.filter(F.contains("context", F.lit(GAP))).select(F.col("gap_id").alias("ask_id"), "context", F.replace("context", F.lit(GAP), F.lit(" ")).alias("text"))
    found = line_candidates(asked, lines, most=most).groupBy("ask_id").agg(F.min_by("line_id", F.struct(-F.col("overlap"), "line_id")).alias("line_id"))
    filled = found.join(asked, "ask_id").join(lines.select("line_id", F.col("text").alias("line")), "line_id")
    return filled.select(F.col("ask_id").alias("gap_id"), fill_from_line(F.col("context"), F.col("line")).alias("fill")).filter("fill IS NOT NULL")


def patch(line: Column, fill: Column) -> Column:
    """The first gap of a line filled."""
    at = F.locate(GAP, line)
    return F.when((at > 0) & fill.isNotNull(), F.concat(F.substring(line, F.lit(1), at - 1), fill, F.substring(line, at + len(GAP), F.length(line)))).otherwise(line)


def cascade(gaps: DataFrame, passes: list[tuple[str, DataFrame]]) -> DataFrame:
    """(gap_id, fill, method): each gap by the first pass that fills it. A pass has one row for a gap at most, and is computed once."""
    out = gaps.select("gap_id")
    for i, (_, fills) in enumerate(passes):
        out = out.join(fills.select("gap_id", F.col("fill").alias(f"_fill{i}")), "gap_id", "left")
    found = [F.col(f"_fill{i}") for i in range(len(passes))]
    method = F.coalesce(*[F.when(f.isNotNull(), F.lit(m)) for f, (m, _) in zip(found, passes)])
    return out.select("gap_id", F.coalesce(*found).alias("fill"), method.alias("method")).filter("fill IS NOT NULL")
