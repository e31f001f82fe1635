"""Nearest rows by cells against all pairs: copies, ties, nulls, widths, kinds, shards."""

import random

from pyspark.sql import functions as F

from versemill.operators import nearest as N
from versemill.operators import retrieval as R


def tables(spark, n=400):
    rng = random.Random(9)
    base = [[rng.choice([-0.5, 0.0, 0.25, 1 / 3, 0.1]) for _ in range(6)] for _ in range(60)]
    rows = [(i, base[rng.randrange(60)], f"p{i % 3}" if i % 11 else None, rng.choice(["prose", "verse", None])) for i in range(n)]
    rows += [(n, None, "p1", "verse"), (n + 1, [0.5, None, 0.1, 0.1, 0.1, 0.1], "p1", "verse"), (n + 2, [0.5] * 3, "p2", "prose")]
    corpus = spark.createDataFrame(rows, "vec_id long, embedding array<float>, poet string, type string")
    return corpus, corpus.filter("vec_id % 20 = 0 or vec_id > 399").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_vector"), F.col("poet").alias("query_poet"))


def all_pairs(corpus, queries, differ=()):
    rows, out = corpus.collect(), {}
    for q in queries.collect():
        for r in rows:
            if all(r[a] is not None and q[b] is not None and r[a] != q[b] for a, b in differ):
                x, y = r.embedding, q.query_vector
                known = x is not None and y is not None and len(x) == len(y) and None not in x and None not in y
                d = round(1 - sum(a * b for a, b in zip(x, y)), 9) if known else None
                out.setdefault(q.query_id, []).append((d is None, d, r.vec_id, r.type))
    return {q: sorted(x, key=lambda e: (e[0], e[1] or 0.0, e[2])) for q, x in out.items()}


def test_equal_to_all_pairs(spark, monkeypatch):
    corpus, queries = tables(spark)
    monkeypatch.setattr(N, "CELL_BYTES", 1 << 12)
    for differ in ((), (("vec_id", "query_id"),), (("poet", "query_poet"), ("vec_id", "query_id"))):
        pairs = all_pairs(corpus, queries, differ)
        found = R.search(corpus, queries, 5, differ=differ).collect()
        want = sorted((q, i, d, k) for q, x in pairs.items() for k, (_, d, i, _) in enumerate(x[:5], 1))
        assert sorted((r.query_id, r.vec_id, r.distance, r["rank"]) for r in found) == want


def test_many_cells_runs_and_batches(spark):
    corpus, queries = tables(spark)
    pairs = all_pairs(corpus, queries)
    found = N.nearest(corpus, queries, {0: 7}, F.lit(0), cell_bytes=1 << 12).collect()
    met = {(r.query_id, r.vec_id) for r in found}
    assert all((q, i) in met for q, x in pairs.items() for _, _, i, _ in x[:7]) and len(met) < 23 * 403


def test_caps_by_kind(spark):
    corpus, queries = tables(spark)
    for n, cap, fetch in ((6, 1, None), (6, 0, None), (6, 2, 9)):
        want = []
        for q, x in all_pairs(corpus, queries).items():
            kept, run = [], 0
            for _, _, i, kind in x[:fetch]:
                run += kind == "prose"
                if kind != "prose" or run <= cap:
                    kept.append(i)
            want += [(q, i, k) for k, i in enumerate(kept[:n], 1)]
        found = R.search(corpus, queries, n, cap_type="prose", cap=cap, fetch=fetch).collect()
        assert sorted((r.query_id, r.vec_id, r["rank"]) for r in found) == sorted(want)


def test_no_join_of_all_pairs(spark):
    corpus, queries = tables(spark)
    plan = R.search(corpus, queries, 5)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
