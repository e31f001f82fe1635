"""Plain-text books to poems: one generic parser in place of one for each author; titles, skip lists and markers are parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators import filters as L
from ..operators import sequence as W


def parse_plaintext(books: DataFrame, key: str, *, starts: Column, is_title: Column, skip: Column | None = None) -> DataFrame:
    """(key, poem, title, stanza, lines): lines from the first that ``starts`` on; a title line begins a poem, blank lines part stanzas.

    ``starts``, ``is_title`` and ``skip`` are predicates over ``line``.
    """
    lines = L.from_first(L.lines(books, key), key, starts)
    if skip is not None:
        lines = lines.filter(~skip)
    poems = W.islands(lines, key, "pos", is_title, "poem").filter("poem > 0")
    titled = W.forward_fill(poems, key, "pos", is_title, F.trim("line"), "title").filter(~is_title)
    cut = W.islands(titled.withColumn("_k", F.struct(key, "poem")), "_k", "pos", F.trim("line") == "").filter(F.trim("line") != "")
    gathered = cut.groupBy(key, "poem", "title", "island").agg(F.transform(F.sort_array(F.collect_list(F.struct("pos", "line"))), lambda x: x["line"]).alias("lines"))
    return gathered.withColumnRenamed("island", "stanza")


PARSERS: dict[str, Callable[..., DataFrame]] = {"plaintext": parse_plaintext}


def parse(kind: str, books: DataFrame, key: str, **options) -> DataFrame:
    """Dispatch by kind; an author's own parser is one of these kinds with predicates of its own."""
    from . import books as _  # noqa: F401  (adds its kinds)

    if kind not in PARSERS:
        raise ValueError(f"unknown kind of source: {kind}")
    return PARSERS[kind](books, key, **options)
