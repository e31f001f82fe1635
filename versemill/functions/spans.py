"""Spans of text (X16, X17): matches with their places, chosen among kinds without overlap, and rendered; built-in functions only."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# The forms of quotations, of private readers' links and of headings in clips.
ATTRIBUTED = "(?U)[\"“]([^\"”]+?)[\"”]\\s*—\\s*([A-Z][A-Za-z'. ]+?)(?=[.,;:!?\\s—)]|$)"
BARE = "[\"“]([^\"”]{4,}?)[\"”]"
PRIVATE_READER = r"^https?://(?:www\.)?(?:kindle|read)\.amazon\.\w+"
VERSE_MARKS, PROSE_WORDS, EPIGRAPH_WORDS = 2, 25, 150


def matches(text: Column, pattern: str) -> Column:
    """All matches of ``pattern``, leftmost and apart: array of (start, stop, match), places from 0, ``stop`` exclusive.

    Places follow from what lies between the matches.
    """
    found, between = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern, -1)
    state = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,stop:int,match:string>>").alias("out"))

    def step(acc: Column, x: Column) -> Column:
        start = acc["at"] + F.length(x["before"])
        stop = start + F.length(x["match"])
        return F.struct(stop.alias("at"), F.concat(acc["out"], F.array(F.struct(start.alias("start"), stop.alias("stop"), x["match"].alias("match")))).alias("out"))

    pairs = F.zip_with(found, F.slice(between, F.lit(1), F.size(found)), lambda m, b: F.struct(b.alias("before"), m.alias("match")))
    return F.aggregate(pairs, state, step, lambda acc: acc["out"])


def once(value: Column, then: Callable[[Column], Column]) -> Column:
    """``then`` of a value that is computed once, however often ``then`` names it, inside functions of elements too."""
    return F.element_at(F.transform(F.array(value), then), 1)


def outside(spans: Column, taken: Column) -> Column:
    """Those spans that begin in none of ``taken``."""
    return F.filter(spans, lambda s: ~F.exists(taken, lambda t: (t["start"] <= s["start"]) & (s["start"] < t["stop"])))


def _kind(quote: Column) -> Column:
    words = F.size(F.filter(F.split(quote, r"(?U)\s+"), lambda w: w != ""))
    return F.when(F.regexp_count(quote, F.lit(" / ")) >= VERSE_MARKS, "verse").when(words >= PROSE_WORDS, "prose").otherwise("inline")


def quotations(text: Column) -> Column:
    """The quotations of a text, which is computed once."""
    return once(text, _quotations)


def _quotations(text: Column) -> Column:
    """(start, stop, quote, kind, author) by start. Attributed quotations come first; bare ones, of four characters or more,
    are taken where they begin outside those. Verse (three lines or more) and prose (25 words or more) take a closing mark along."""

    def described(spans: Column, pattern: str, author: bool) -> Column:
        def one(s: Column) -> Column:
            quote = F.regexp_extract(s["match"], pattern, 1)
            kind = _kind(quote)
            mark = (kind != "inline") & F.substring(text, s["stop"] + 1, F.lit(1)).isin(*".,;:!?")
            who = F.regexp_extract(s["match"], pattern, 2) if author else F.lit(None).cast("string")
            return F.struct(s["start"].alias("start"), (s["stop"] + mark.cast("int")).alias("stop"), quote.alias("quote"), kind.alias("kind"), who.alias("author"))

        return F.transform(spans, one)

    def both(by_author: Column) -> Column:
        return F.array_sort(F.concat(by_author, outside(described(matches(text, BARE), BARE, False), by_author)))

    return once(described(matches(text, ATTRIBUTED), ATTRIBUTED, True), both)


def escaped(text: Column) -> Column:
    """Text for HTML."""
    return reduce(lambda x, pair: F.replace(x, F.lit(pair[0]), F.lit(pair[1])), [("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&#34;"), ("'", "&#39;")], text)


def rendered(text: Column) -> Column:
    """A post with its quotations set: verse line by line and prose apart, the others in italics without marks."""

    def piece(s: Column) -> Column:
        verse = F.array_join(F.transform(F.split(s["quote"], " / "), lambda x: escaped(F.trim(x))), "<br>\n")
        return (
            F.when(s["kind"] == "verse", F.concat(F.lit('</p>\n<blockquote class="verse-inset"><p class="verse-lines">'), verse, F.lit("</p></blockquote>\n<p>")))
            .when(s["kind"] == "prose", F.concat(F.lit('</p>\n<blockquote class="prose-inset"><p>'), escaped(s["quote"]), F.lit("</p></blockquote>\n<p>")))
            .otherwise(F.concat(F.lit('<i class="verse">'), escaped(s["quote"]), F.lit("</i>")))
        )

    between = lambda a, b: escaped(F.substring(text, a + 1, F.greatest(b - a, F.lit(0))))
    state = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
    step = lambda acc, s: F.struct(s["stop"].alias("at"), F.concat(acc["out"], between(acc["at"], s["start"]), piece(s)).alias("out"))
    return F.aggregate(quotations(text), state, step, lambda acc: F.concat(acc["out"], between(acc["at"], F.length(text))))


def clip(text: Column, uri: Column, author: Column) -> Column:
    """How a clip is shown, (mode, text, uri, label), or null: an ``epigraph`` of up to 150 words, else a ``link``.

    A private reader's link is no link; without one the ``Source:`` line gives it. A heading is the label, else the author, else
    the link's host. The heading and the source line are no part of the text; clips of one's own are not shown.
    """
    bare = lambda x: F.regexp_replace(x, r"(?U)^\s+|\s+$", "")
    raw = F.coalesce(text, F.lit(""))
    given = F.when(~F.coalesce(uri, F.lit("")).rlike(PRIVATE_READER), F.nullif(uri, F.lit("")))
    link = F.coalesce(given, F.nullif(F.regexp_extract(raw, r"(?m)^Source:\s*(https?://\S+)", 1), F.lit("")))
    title = F.nullif(bare(F.regexp_extract(raw, r"^#\s+(.+?)(?:\s*\n|$)", 1)), F.lit(""))
    clean = raw
    for pattern in (r"(?m)^#\s*(?:Photo|Text Extraction)\s*\n+", r"(?m)^Source:\s*https?://\S+\s*\n?", r"(?m)^#\s+.+?\n+"):
        clean = bare(F.regexp_replace(clean, pattern, ""))
    host = F.substring_index(F.substring_index(link, "//", -1), "/", 1)
    by = F.nullif(author, F.lit(""))
    short = (clean != "") & (F.regexp_count(clean, F.lit(r"(?U)\S+")) <= EPIGRAPH_WORDS)
    shown = F.when(short, F.struct(F.lit("epigraph").alias("mode"), clean.alias("text"), link.alias("uri"), title.alias("label")))
    shown = shown.when(link.isNotNull(), F.struct(F.lit("link").alias("mode"), F.lit(None).cast("string").alias("text"), link.alias("uri"), F.coalesce(title, by, host).alias("label")))
    return F.when(F.coalesce(author, F.lit("")) != "self", shown)
