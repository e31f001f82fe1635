"""Chunking (C): greedy packing of lines, stanzas and paragraphs by jumps over running lengths inside the row.

Where a chunk ends is found by a search in the running lengths, so a text costs a search for each chunk, not a step for each
part. Only lengths go to Python; texts are then cut by the bounds.
Lengths are characters; tokens are ``chars div 4`` (a token for every four characters).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import slug
from .sequence import number_repeats

BOUND = "struct<first:int,last:int>"


def _bound(first: Column, last: Column) -> Column:
    return F.struct(first.cast("int").alias("first"), last.cast("int").alias("last"))


def _jumps(find: Callable[..., Iterator[tuple[int, int]]]) -> Callable[..., Column]:
    """``find`` on arrays, as a function on columns: arrays in, bounds out, an Arrow batch at a time. A null array has null bounds."""

    @F.pandas_udf(f"array<{BOUND}>")
    def bounds(*columns: pd.Series) -> pd.Series:
        rows = zip(*columns)
        return pd.Series([None if any(x is None for x in row) else [{"first": a, "last": b} for a, b in find(*row)] for row in rows])

    return bounds


def _ends(sizes: np.ndarray, separator: int) -> np.ndarray:
    """What all parts up to and with each hold, a separator after each: ascending, so a chunk's end is found by search."""
    return np.cumsum(np.asarray(sizes, np.int64) + separator)


def stanza_bounds(sizes: np.ndarray, least: int, most: int) -> Iterator[tuple[int, int]]:
    """1-based bounds of C03. A chunk from s to i has ends[i] - ends[s - 1] - 1 characters."""
    n, ends = len(sizes), _ends(sizes, 1)
    start = at = 0  # the chunk's first part; the first part that may close it
    while at < n:
        before = ends[start - 1] if start else 0
        last = min(n - 1, max(at, int(np.searchsorted(ends, before + 1 + 4 * least))))
        if (ends[last] - before - 1) // 4 > most and last > start:
            yield start + 1, last
            start, at = last, last + 1
        else:
            yield start + 1, last + 1
            start = at = last + 1
    if start < n:
        yield start + 1, n


def sentence_bounds(sizes: np.ndarray, closing: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """1-based bounds of C04: after the size is reached, the next line that may close."""
    n, ends, closers = len(sizes), _ends(sizes, 1), np.flatnonzero(np.asarray(closing, bool))
    start = 0
    while start < n:
        before = ends[start - 1] if start else 0
        reached = max(start, int(np.searchsorted(ends, before + 1 + 4 * most)))
        k = int(np.searchsorted(closers, reached))
        last = int(closers[k]) if k < len(closers) else n - 1
        yield start + 1, last + 1
        start = last + 1


def paragraph_bounds(sizes: np.ndarray, least: int, most: int) -> Iterator[tuple[int, int]]:
    """1-based bounds of C05. Empty parts at the beginning of a chunk have no separator."""
    sizes = np.asarray(sizes, np.int64)
    n, ends, filled = len(sizes), _ends(sizes, 2), np.flatnonzero(sizes > 0)
    start, done = 0, None
    while start < n:
        k = int(np.searchsorted(filled, start))
        first = int(filled[k]) if k < len(filled) else n
        before = (ends[first - 1] if first else 0) if first < n else 0
        following = max(first + 1, int(np.searchsorted(ends, before + 2 + 4 * (most + 1))))
        if following >= n:
            left = (ends[n - 1] - before - 2) // 4 if first < n else 0
            if left < least and done:
                yield done[0], n
            else:
                if done:
                    yield done
                yield start + 1, n
            return
        if done:
            yield done
        done, start = (start + 1, following), following


def pack_stanzas(sizes: Column, least: int = 50, most: int = 300) -> Column:
    """Bounds (1-based) of chunks of stanzas: a chunk closes at ``least`` tokens or the last stanza; over ``most`` with more than one stanza, the current one starts the next chunk."""
    return _jumps(lambda s: stanza_bounds(s, least, most))(sizes)


def split_sentences(lines: Column, most: int = 300) -> Column:
    """Bounds of groups of lines: a group closes at the first line that ends a sentence once it has ``most`` tokens."""
    sizes, closing = F.transform(lines, F.length), F.transform(lines, lambda s: F.rtrim(s).rlike(r"[.!?;]$"))
    return _jumps(lambda s, c: sentence_bounds(s, c, most))(sizes, closing)


def pack_paragraphs(sizes: Column, least: int = 80, most: int = 500) -> Column:
    """Bounds of prose chunks; a tail under ``least`` tokens joins the chunk before, or stands alone where there is none."""
    return _jumps(lambda s: paragraph_bounds(s, least, most))(sizes)


def cut(parts: Column, bounds: Column, separator: str) -> Column:
    """Texts of the bounds, with their place: array of (chunk_index, first, last, chunk_text)."""
    return F.transform(bounds, lambda b, i: F.struct(i.alias("chunk_index"), b["first"].alias("first"), b["last"].alias("last"), F.array_join(F.slice(parts, b["first"], b["last"] - b["first"] + 1), separator).alias("chunk_text")))


def chunk_id(author: Column, work: Column, title: Column, index: Column) -> Column:
    """Slugs of author, work and title (20 characters of the last two; ``untitled`` without a title) and the index in three digits."""
    name = F.when(F.coalesce(title, F.lit("")) == "", "untitled").otherwise(F.substring(slug(title), 1, 20))
    return F.concat_ws("-", slug(author), F.substring(slug(work), 1, 20), name, F.format_string("%03d", index))


def unique_ids(chunks: DataFrame, name: str, order: list[str]) -> DataFrame:
    """Ids that collide get ``-dupN`` in order; the first keeps its own."""
    return number_repeats(chunks, name, order).withColumn(name, F.col("unique_id")).drop("unique_id")


def chunk_prose(docs: DataFrame, key: str, paragraphs: str, least: int = 80, most: int = 500) -> DataFrame:
    """A row for each chunk of each document."""
    sizes = F.transform(paragraphs, lambda p: F.length(p))
    return docs.withColumn("_b", pack_paragraphs(sizes, least, most)).select(key, F.inline(cut(F.col(paragraphs), F.col("_b"), "\n\n")))


def chunk_poems(poems: DataFrame, key: str, stanzas: str = "stanzas", *, least: int = 50, most: int = 300) -> DataFrame:
    """Poems (key, form, array of arrays of lines) routed by form and size: (key, strategy, chunk_index, first_line, last_line, chunk_text).

    No stanzas: nothing. Sonnets and short poems: one chunk. Blank verse and single long stanzas: by stanza, long ones by
    sentence. The rest: stanzas packed. Line ranges are the true ones, from running line counts.
    """
    texts = F.transform(stanzas, lambda s: F.array_join(s, "\n"))
    x = poems.filter(F.size(stanzas) > 0).withColumn("_t", texts).withColumn("_chars", F.length(F.array_join("_t", "\n")))
    strategy = F.when(F.col("form") == "sonnet", "sonnet").when(F.floor(F.col("_chars") / 4) <= most, "short").when((F.col("form") == "blank_verse") | (F.size(stanzas) == 1), "blank_verse").otherwise("stanzaic")
    x = x.withColumn("strategy", strategy)
    whole = x.filter(F.col("strategy").isin("sonnet", "short")).select(key, "strategy", F.lit(0).alias("chunk_index"), F.lit(1).alias("first_line"), F.size(F.flatten(stanzas)).alias("last_line"), F.array_join("_t", "\n").alias("chunk_text"))
    ends = lambda n: F.aggregate(F.slice(stanzas, F.lit(1), n), F.lit(0), lambda s, y: s + F.size(y))
    packed = x.filter("strategy = 'stanzaic'").withColumn("_b", pack_stanzas(F.transform("_t", lambda s: F.length(s)), least, most))
    packed = packed.select(key, "strategy", stanzas, F.inline(cut(F.col("_t"), F.col("_b"), "\n")))
    packed = packed.select(key, "strategy", "chunk_index", (ends(F.col("first") - 1) + 1).alias("first_line"), ends(F.col("last")).alias("last_line"), "chunk_text")
    blank = x.filter("strategy = 'blank_verse'").select(key, "strategy", stanzas, F.posexplode(stanzas).alias("_s", "_lines"))
    long = F.floor(F.length(F.array_join("_lines", "\n")) / 4) > most
    bounds = F.when(long, split_sentences(F.col("_lines"), most)).otherwise(F.array(_bound(F.lit(1), F.size("_lines"))))
    blank = blank.withColumn("_before", ends(F.col("_s"))).withColumn("_b", bounds).select(key, "strategy", "_s", "_before", F.inline(cut(F.col("_lines"), F.col("_b"), "\n")))
    from pyspark.sql import Window

    place = (F.row_number().over(Window.partitionBy(key).orderBy("_s", "first")) - 1).cast("int")
    blank = blank.select(key, "strategy", place.alias("chunk_index"), (F.col("_before") + F.col("first")).alias("first_line"), (F.col("_before") + F.col("last")).alias("last_line"), "chunk_text")
    return whole.unionByName(packed).unionByName(blank)
