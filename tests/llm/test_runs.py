"""Periodic runs against brute force, and on odd tables."""

import hashlib
import random
import re
import zlib

import duckdb
import pyarrow as pa
import pytest

from versemill.llm import periodic_runs
from versemill.llm.oracles import ORACLES
from versemill.llm.queries import QUERIES

from .test_ops_small import FOLDER, WORD, no_docs, odd_docs


def brute(w, exponent, least):
    """(start, length, period) of every run, by trying every period."""
    out = []
    for q in range(1, len(w) // exponent + 1):
        i = 0
        while i + q < len(w):
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            length = j - i + q
            if j > i and length >= max(least, exponent * q) and not any(all(w[k] == w[k + d] for k in range(i, i + length - d)) for d in range(1, q)):
                out.append((i, length, q))
            i = j + 1
    return sorted(out, key=lambda r: (r[0], r[2]))


def collapse(w, runs):
    drop = {k for start, length, q in runs for k in range(start + q, start + length)}
    return " ".join(x for k, x in enumerate(w) if k not in drop)


@pytest.mark.parametrize("seed", range(4))
def test_random_texts(seed):
    rng = random.Random(seed)
    for _ in range(150):
        exponent, least, texts = rng.choice([2, 3, 4]), rng.choice([2, 6]), []
        for _ in range(rng.randrange(1, 7)):
            n, letters = rng.choice([0, 1, 4, 12, 40, 70]), "abcdefgh"[: rng.choice([1, 2, 3, 8])]
            w = [rng.choice(letters) for _ in range(n)]
            if n and rng.random() < 0.5:
                a = rng.randrange(n)
                p = 1 + (n - a) // rng.randrange(2, 8)
                w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
            texts.append(w)
        column = pa.array([rng.choice([" ", "\n", " \t"]).join(w) for w in texts])
        for first, rows, counts, runs, collapsed in periodic_runs._slices(column, exponent, least):
            for i in range(rows):
                w = texts[first + i]
                expected = brute(w, exponent, least)
                assert [tuple(r.values()) for r in runs[i].as_py()] == expected
                assert counts[i].as_py() == len(w) and collapsed[i].as_py() == collapse(w, expected)


def test_a_position_is_touched_few_times():
    """The smaller halves: on texts of one letter, two letters and a long repeat, touches stay within n log n."""
    rng = random.Random(5)
    touched = []
    refine = periodic_runs._Classes._refine

    def counted(self, small, length):
        touched.append(len(small))
        return refine(self, small, length)

    try:
        periodic_runs._Classes._refine = counted
        for words in (["a"] * 4000, ["a", "b"] * 2000, [rng.choice("ab") for _ in range(4000)], [str(rng.randrange(99)) for _ in range(400)] * 10):
            touched.clear()
            list(periodic_runs._slices(pa.array([" ".join(words)]), 2, 2))
            assert sum(touched) <= 4000 * 13
    finally:
        periodic_runs._Classes._refine = refine


def test_query_on_odd_tables(spark, tmp_path):
    odd_docs(spark).write.parquet(f"{tmp_path}/documents.parquet")
    key = lambda r: tuple(map(str, r))
    rows = sorted(map(tuple, QUERIES["op12_periodic_runs"](spark, str(tmp_path)).collect()), key=key)
    expected = []
    for d in odd_docs(spark).collect():
        w = WORD.findall(d.text or "")
        h = None if d.doc_id is None else zlib.crc32(str(d.doc_id).encode())
        if w and h is not None and h % 10 == 0:
            a = h // 10 % len(w)
            p = 1 + (len(w) - a) // (3 + h // 10 % 8)
            w = [w[i if i < a else a + (i - a) % p] for i in range(len(w))]
        runs = brute(w, 4, 6) if len(w) < 2000 else []
        top = min(runs, key=lambda r: (-r[1], r[0], r[2])) if runs else (None,) * 3
        lines = "".join(f"{s},{n},{q}\n" for s, n, q in runs)
        sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
        expected.append((d.doc_id, len(runs), *top, 1000 * top[1] // top[2] if runs else None, sha(lines), sha(collapse(w, runs))))
    assert rows == sorted(expected, key=key) and any(r[1] for r in rows)
    no_docs(spark).write.parquet(f"{tmp_path}/none/documents.parquet")
    assert QUERIES["op12_periodic_runs"](spark, f"{tmp_path}/none").collect() == []


def test_long_text_of_few_runs():
    rng = random.Random(9)
    head = [str(rng.randrange(1000)) for _ in range(60_000)]
    [(_, _, counts, runs, collapsed)] = periodic_runs._slices(pa.array([" ".join(head + ["x", "y", "z"] * 50)]), 4, 6)
    found = [tuple(r.values()) for r in runs[0].as_py()]
    assert counts.to_pylist() == [60_150] and (60_000, 150, 3) in found
    assert re.search(r"x y z$", collapsed[0].as_py())


def test_sql(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{FOLDER}/documents.parquet'")
    found = con.execute(ORACLES["op12_periodic_runs"])
    names = [d[0] for d in found.description]
    key = lambda r: tuple(map(str, r))
    rows = QUERIES["op12_periodic_runs"](spark, FOLDER).select(*names).collect()
    assert sorted(map(tuple, rows), key=key) == sorted(found.fetchall(), key=key)
