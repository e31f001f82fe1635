"""Bounds of chunks by jumps equal the step-by-step rules, also for odd sizes; long texts take a search for each chunk."""

import random
import time

import numpy as np
from pyspark.sql import functions as F

from versemill.operators import chunking as C


def plain_stanzas(sizes, least, most):
    done, start, chars, count = [], 1, 0, 0
    for i, size in enumerate(sizes, 1):
        grown = chars + 1 + size if count else size
        closes = grown // 4 >= least or i == len(sizes)
        if closes and grown // 4 > most and count:
            done.append((start, i - 1))
            start, chars, count = i, size, 1
        elif closes:
            done.append((start, i))
            start, chars, count = i + 1, 0, 0
        else:
            chars, count = grown, count + 1
    return done + ([(start, len(sizes))] if count else [])


def plain_sentences(sizes, closing, most):
    done, start, chars = [], 1, 0
    for i, (size, ends) in enumerate(zip(sizes, closing), 1):
        chars = chars + 1 + size if start < i else size
        if chars // 4 >= most and ends:
            done.append((start, i))
            start, chars = i + 1, 0
    return done + ([(start, len(sizes))] if start <= len(sizes) else [])


def plain_paragraphs(sizes, least, most):
    done, start, chars = [], 1, 0
    for i, size in enumerate(sizes, 1):
        grown = chars + 2 + size if chars else size
        if grown // 4 > most and chars:
            done.append((start, i - 1))
            start, chars = i, size
        else:
            chars = grown
    if not sizes:
        return []
    if chars // 4 < least and done:
        return done[:-1] + [(done[-1][0], len(sizes))]
    return done + [(start, len(sizes))]


def test_jumps_equal_steps():
    rng = random.Random(1)
    for _ in range(4000):
        sizes = [rng.choice([0, 0, 1, rng.randrange(30), rng.randrange(400)]) for _ in range(rng.randrange(0, 40))]
        closing = [rng.random() < 0.4 for _ in sizes]
        least, most = rng.choice([0, 1, 5, 20]), rng.choice([0, 2, 10, 60])
        assert [*C.stanza_bounds(np.array(sizes, int), least, most)] == plain_stanzas(sizes, least, most), (sizes, least, most)
        assert [*C.sentence_bounds(np.array(sizes, int), closing, most)] == plain_sentences(sizes, closing, most)
        assert [*C.paragraph_bounds(np.array(sizes, int), least, most)] == plain_paragraphs(sizes, least, most), (sizes, least, most)


def test_a_million_lines_and_nulls(spark):
    rng = np.random.default_rng(2)
    sizes = rng.integers(0, 80, 1_000_000)
    started = time.monotonic()
    for bounds in (C.stanza_bounds(sizes, 50, 300), C.paragraph_bounds(sizes, 80, 500), C.sentence_bounds(sizes, sizes % 3 == 0, 300)):
        found = [*bounds]
        assert found[0][0] == 1 and found[-1][1] == len(sizes) and all(b + 1 == a for (_, b), (a, _) in zip(found, found[1:]))
    assert time.monotonic() - started < 20
    rows = spark.createDataFrame([(1, [100] * 9), (2, []), (3, None)], "k int, sizes array<int>")
    found = {r.k: r for r in rows.select("k", C.pack_stanzas(F.col("sizes")).alias("s"), C.pack_paragraphs(F.col("sizes")).alias("p")).collect()}
    assert [tuple(b) for b in found[1].s] == plain_stanzas([100] * 9, 50, 300) and [tuple(b) for b in found[1].p] == plain_paragraphs([100] * 9, 80, 500)
    assert found[2].s == [] and found[3].s is None and found[3].p is None
