"""Filters and predicates (F): built-in expressions, semi- and anti-joins; constant lists become one expression."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def contains_any(text: Column, parts: list[str]) -> Column:
    """Any of ``parts`` occurs, in any case; null is no match."""
    low = F.lower(F.coalesce(text, F.lit("")))
    return F.exists(F.array(*[F.lit(p.lower()) for p in parts]), lambda p: F.contains(low, p))


def is_structural(line: Column, listed: list[str] | None = None) -> Column:
    """headings that structure a work and title no poem: those listed, numerals, scenes and books. The list belongs to the edition that is read."""
    x = F.trim(line)
    return x.isin(listed or []) | x.rlike(r"^[IVXLC]+\.?\s*$") | x.rlike(r"^(?:SCENE|BOOK)\s")


def exclude_keys(table: DataFrame, key: str, keys: list[str]) -> DataFrame:
    """rows whose key is not listed; null keys stay."""
    return table.filter(~F.coalesce(F.col(key).isin(keys), F.lit(False)))


def exclude_containing(table: DataFrame, column: str, parts: list[str]) -> DataFrame:
    """rows of which ``column`` contains none of ``parts``, case counting."""
    return table.filter(~F.exists(F.array(*[F.lit(p) for p in parts]), lambda p: F.contains(F.coalesce(F.col(column), F.lit("")), p)))


def keep_positions(values: Column, positions: list[int]) -> Column:
    """the elements at 0-based positions."""
    wanted = F.array(*[F.lit(p) for p in positions])
    return F.filter(values, lambda _, i: F.array_contains(wanted, i))


def by_position(position: Column, bounds: list[tuple[int, str]]) -> Column:
    """the name of the first bound above the position, or null past the last."""
    out = F.lit(None).cast("string")
    for bound, name in reversed(bounds):
        out = F.when(position < bound, F.lit(name)).otherwise(out)
    return out


def match_keywords(table: DataFrame, column: str, keywords: list[str], out: str = "matched") -> DataFrame:
    """Rows with a whole-word keyword, and the distinct ones found, lower-case. The match reaches the scan stage as one regex."""
    words = rf"(?i)(?<![\p{{L}}\p{{N}}_])(?:{'|'.join(keywords)})(?![\p{{L}}\p{{N}}_])"  # what \b means differs between Java versions beyond ASCII
    found = F.array_distinct(F.transform(F.regexp_extract_all(column, F.lit(words), F.lit(0)), F.lower))
    return table.filter(F.col(column).rlike(words)).withColumn(out, found)


ENVELOPE = "kind string, commit struct<operation:string,collection:string,rkey:string,record:struct<text:string,langs:array<string>>>"


def open_envelope(table: DataFrame, raw: str, collection: str) -> DataFrame:
    """created records of one collection with a text, from JSON messages; others are dropped."""
    x = table.withColumn("_m", F.from_json(raw, ENVELOPE))
    fits = (F.col("_m.kind") == "commit") & (F.col("_m.commit.operation") == "create") & (F.col("_m.commit.collection") == collection)
    x = x.filter(fits & (F.trim("_m.commit.record.text") != ""))
    return x.withColumns({"text": F.col("_m.commit.record.text"), "langs": F.col("_m.commit.record.langs")}).drop("_m")


def language_passes(langs: Column, wanted: str) -> Column:
    """no languages given, or the wanted one among them."""
    return (F.coalesce(F.size(langs), F.lit(0)) <= 0) | F.array_contains(langs, wanted)


def equal_all(table: DataFrame, conditions: dict[str, object]) -> DataFrame:
    """column equals value for each condition given; None asks nothing. Each reaches the scan."""
    for column, value in conditions.items():
        if value is not None:
            table = table.filter(F.col(column) == value)
    return table


def not_in_any_case(column: Column, names: list[str]) -> Column:
    """None of ``names`` in any case; null counts as empty."""
    return ~F.lower(F.coalesce(column, F.lit(""))).isin([n.lower() for n in names])


def number_prefix(text: Column) -> Column:
    """the number at the start, or null."""
    return F.nullif(F.regexp_extract(text.cast("string"), r"^(\d{1,9})", 1), F.lit("")).cast("int")


def at_least(text: Column, *, words: int = 0, lines: int = 0, chars: int = 0) -> Column:
    """F16."""
    return (F.regexp_count(text, F.lit(r"\S+")) >= words) & (F.size(F.split(text, "\n", -1)) >= lines) & (F.length(text) >= chars)


def review_tiers(entries: DataFrame, picks: DataFrame) -> DataFrame:
    """(id, tier) of entries that were picked, tier 1 before 2; if no pick is an entry, all entries in tier 1."""
    best = picks.groupBy("id").agg(F.min("tier").alias("tier"))
    picked = entries.join(best, "id", "left").withColumn("_any", F.lit(entries.join(best, "id", "left_semi").limit(1).agg(F.count("*").alias("n")).scalar()))
    return picked.filter(F.col("tier").isNotNull() | (F.col("_any") == 0)).select("id", F.coalesce("tier", F.lit(1)).alias("tier"))


def strip_boilerplate(text: Column) -> Column:
    """what stands between the start and end marks; all of it where there are none."""
    body = F.regexp_extract(text, r"(?s)\*\*\* ?START OF[^\n]*?\*\*\*(.*?)(?:\*\*\* ?END OF|\z)", 1)
    return F.when(text.rlike(r"\*\*\* ?START OF"), body).otherwise(text)


def lines(docs: DataFrame, key: str, text: str = "text") -> DataFrame:
    """(key, pos, line): the lines of every text, in order."""
    return docs.select(key, F.posexplode(F.split(text, "\n", -1)).alias("pos", "line"))


def from_first(rows: DataFrame, key: str, starts: Column) -> DataFrame:
    """rows from the first that ``starts`` on, by key; none where none starts."""
    first = F.min(F.when(starts, F.col("pos"))).over(Window.partitionBy(key))
    return rows.withColumn("_start", first).filter("pos >= _start").drop("_start")


def line_class(line: Column) -> Column:
    """one class for each line; the first that fits."""
    t = F.trim(line)
    x = F.when(t == "", "blank").when(t.rlike(r"^[IVXLC]+\.?$"), "roman").when(t.rlike(r"^\[?\d+\]?$"), "page").when(t.rlike(r"^[*_ -]{3,}$"), "separator")
    x = x.when(t.rlike(r"^\(.*\)$"), "subtitle").when(t.rlike(r"^\[\d+\]"), "footnote")
    return x.when(line.rlike("[A-Z]") & ~line.rlike("[a-z]"), "title").otherwise("text")


def is_verse(xml: Column) -> Column:
    """a division with verse lines in it."""
    return F.coalesce(F.xpath_int(xml, F.lit("count(//l)")), F.lit(0)) > 0


def has_content(html: Column) -> Column:
    """letters outside the tags."""
    return F.regexp_replace(html, "<[^>]+>", "").rlike("[A-Za-z]")


def skip_titles(table: DataFrame, column: str, skipped: DataFrame) -> DataFrame:
    """rows whose title is not in ``skipped`` (title), in any case. The list is joined, so it may be long."""
    names = skipped.select(F.upper("title").alias("_t")).distinct()
    return table.join(names, F.upper(column) == F.col("_t"), "left_anti")
