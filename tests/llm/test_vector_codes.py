"""Codes for vectors: trees against all distances, fits against plain whole numbers, odd tables."""

import hashlib
import math
import random

import duckdb
import numpy as np
import pytest
from pyspark.sql import Row

from versemill.llm import vector_codes
from versemill.llm.oracles import ORACLES
from versemill.llm.queries import QUERIES

from .test_ops_small import FOLDER

VECTORS = "vec_id long, embedding array<double>, label int, code string, error string, width int, salt int"


def brute(rows, parts=16, entries=64, rounds=2, scale=256):
    """rows: (id, vector, label). (id, codes, error, label error, digest) of each, with Python's whole numbers."""
    kept = [r for r in rows if r[1] and all(x is not None and math.isfinite(x) for x in r[1])]
    widths = {}
    for _, v, _ in kept:
        if len(v) % parts == 0:
            widths[len(v)] = widths.get(len(v), 0) + 1
    if not widths:
        return []
    width = min(widths, key=lambda w: (-widths[w], w))
    kept = [r for r in kept if len(r[1]) == width]
    size = width // parts
    floor = lambda x: math.floor(x * scale) if math.isfinite(x * scale) else int(x) * scale
    cut = [[[floor(x) for x in v[p * size : (p + 1) * size]] for p in range(parts)] for _, v, _ in kept]
    first = sorted(range(len(kept)), key=lambda i: (kept[i][0] is None, kept[i][0] or 0, kept[i][1]))[:entries]
    books = [[cut[i][p] for i in first] for p in range(parts)]
    near = lambda p, v: min((sum((a - b) ** 2 for a, b in zip(e, v)), k) for k, e in enumerate(books[p]))
    for _ in range(rounds):
        found = [[near(p, v[p])[1] for p in range(parts)] for v in cut]
        for p in range(parts):
            for e in range(len(books[p])):
                some = [v[p] for v, f in zip(cut, found) if f[p] == e]
                if some:
                    books[p][e] = [sum(x) // len(some) for x in zip(*some)]
    last = [[near(p, v[p]) for p in range(parts)] for v in cut]
    errors = [sum(d for d, _ in x) for x in last]
    by_label = {}
    for r, e in zip(kept, errors):
        by_label[r[2]] = by_label.get(r[2], 0) + min(e, vector_codes.MOST)
    sha = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    clip = lambda x: min(x, vector_codes.MOST)
    return sorted(((r[0], [k for _, k in x], clip(e), clip(by_label[r[2]]), sha) for r, x, e in zip(kept, last, errors)), key=str)


def coded(df, **options):
    return sorted(((r.vec_id, r.codes, r.error, r.label_error, r.codebooks_sha256) for r in vector_codes.compress(df, **options).collect()), key=str)


def table(spark, rows):
    return spark.createDataFrame([(*r, "x", "y", 1, 2) for r in rows], VECTORS).repartition(3)


@pytest.mark.parametrize("grid", [2, 30, 10_000])
def test_trees_find_the_first_of_the_nearest(grid):
    """Few different values make many ties; the share of distances computed is asserted where there is something to cut."""
    rng = np.random.default_rng(grid)
    for n in (1, 2, 5, 64, 300):
        entries, asked = rng.integers(-grid, grid, (n, 4)), rng.integers(-grid, grid, (500, 4))
        tree = vector_codes.Tree(entries)
        index, distance = tree.nearest(asked)
        every = ((asked[:, None] - entries[None]) ** 2).sum(axis=2)
        assert (index == every.argmin(axis=1)).all() and (distance == every.min(axis=1)).all()
        if n == 300 and grid > 2:
            assert tree.met < 0.5 * every.size


def random_rows(rng, n, width=32):
    rows = [(i, [rng.choice([rng.gauss(0, 0.1), 0.0, 0.25]) for _ in range(width)], rng.choice([None, 0, 1])) for i in range(n)]
    return rows + [(3, rows[3][1], 1), (3, rows[4][1], 1), (None, rows[5][1], None), (None, None, 1), (100, [], 0), (101, [None] * width, 0), (102, [float("nan")] * width, 0), (103, [float("inf")] * width, 0), (104, [1.0] * 16, 0), (105, [1.0] * 17, 0)]


def test_fit_equals_plain_whole_numbers(spark):
    rows = random_rows(random.Random(1), 150)
    assert coded(table(spark, rows)) == brute(rows)
    few = random_rows(random.Random(2), 9, 8)
    assert coded(table(spark, few), parts=4, entries=16, rounds=3) == brute(few, 4, 16, 3)
    assert coded(table(spark, few), parts=4, entries=2, rounds=1, scale=1) == brute(few, 4, 2, 1, 1)


def test_components_of_any_size(spark):
    rng = random.Random(3)
    rows = [(i, [rng.choice([0.1, 1e9, -3e12, 1e300, -1.7e308, 5.0]) * rng.random() for _ in range(16)], i % 3) for i in range(40)]
    assert coded(table(spark, rows), entries=8) == brute(rows, entries=8)


def test_nothing_to_code(spark):
    assert coded(table(spark, [])) == [] and coded(table(spark, [(1, None, 1), (2, [1.0], 1)])) == []
    one = [(None, [0.5] * 16, None)]
    assert coded(table(spark, one)) == brute(one)


def test_many_labels_are_dealt(spark, monkeypatch):
    rows = random_rows(random.Random(4), 60)
    monkeypatch.setattr(vector_codes, "BROADCAST_ROWS", 0)
    assert coded(table(spark, rows)) == brute(rows)


def test_sql(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{FOLDER}/embeddings.parquet'")
    found = con.execute(ORACLES["op13_vector_codes"])
    names = [d[0] for d in found.description]
    rows = QUERIES["op13_vector_codes"](spark, FOLDER).select(*names).collect()
    assert isinstance(rows[0], Row) and sorted(map(tuple, rows)) == sorted(found.fetchall())
