"""Trigram queries lose nothing, the index is right, and scans equal plain expressions over whole texts."""

import random
import re

import duckdb
from pyspark.sql import functions as F

from versemill.llm import secret_scan
from versemill.llm.oracles import ORACLES
from versemill.llm.queries import QUERIES

from .test_ops_small import FOLDER, no_docs, odd_docs


def holds(query, text):
    if query is True or isinstance(query, bytes):
        return query is True or query in text
    return (all if query[0] == "and" else any)(holds(q, text) for q in query[1])


def random_pattern(rng, depth):
    k = rng.randrange(9)
    if depth == 0 or k < 3:
        return "".join(rng.choice("abK_é") for _ in range(rng.randrange(1, 5)))
    inner = random_pattern(rng, depth - 1)
    if k == 3:
        return f"({inner}|{random_pattern(rng, depth - 1)})"
    if k == 4:
        return f"(?:{inner}){rng.choice(['?', '*', '+', '{2}', '{2,}', '{0,2}', '+?'])}"
    if k == 5:
        return rng.choice(["[ab]", "[^a]", ".", "[a-c]", r"\w", r"\b"])
    return f"(?i:{inner})" if k == 6 else f"(?={inner})" if k == 7 else inner + random_pattern(rng, depth - 1)


def test_every_match_meets_the_query():
    rng = random.Random(2)
    met = 0
    for _ in range(20_000):
        pattern = random_pattern(rng, 4)
        text = "".join(rng.choice("abABkK_éc") for _ in range(rng.randrange(30)))
        if re.search(pattern, text, re.ASCII):
            query = secret_scan.trigram_query(pattern)
            met += query is not True
            assert holds(query, text.encode().lower()), (pattern, query, text)
    assert met > 100


def test_queries_of_the_rules():
    queries = {r.kind: secret_scan.trigram_query(r.pattern) for r in secret_scan.RULES}
    assert queries["hex"] is True and queries["access"] == ("and", frozenset([b"aki", b"kia"]))
    assert {b"oke", b"_ke", b"swd"} <= secret_scan.trigrams_of(queries["assign"])
    assert all(q is not True for kind, q in queries.items() if kind != "hex")


def plain(text, rules=secret_scan.RULES):
    out = []
    for n, r in enumerate(rules):
        pattern = "[0-9a-f]+" if r.kind == "hex" else r.pattern
        least = 24 if r.kind == "hex" else r.least
        out += [(m.start(), n, m.end(), r.kind) for m in re.finditer(pattern, text or "", re.ASCII) if len(m.group(r.group)) >= least]
    return [f"{kind}:{a}:{b}" for a, _, b, kind in sorted(out)]


def secret_docs(spark):
    rng = random.Random(4)
    key = lambda n, letters="abcdef0123456789": "".join(rng.choice(letters) for _ in range(n))
    texts = [
        f"é password = '{key(12)}' and PASSWD:{key(6)}x tOkEn=\"{key(5)}\" api_key=abc apikey : {key(40)}", "token=token:abcdefgh", "AKIA" + key(16, "ABC0"), "AKIA" + key(15, "ABC0"), "akia" + key(16), key(24), key(23), key(23) + "G" + key(30),
        "-----BEGIN RSA PRIVATE KEY-----\nx", "-----BEGIN PRIVATE KEY-----", "ghp_" + key(36) + " gho_" + key(35), "xoxb-" + key(12), f"eyJ{key(12)}.eyJ{key(12)}.{key(12)}", "AIza" + key(35), "secret\n=\nabcdefgh", "ſecret=abcdefgh toKen=abcdefgh", "pass word=abcdefgh",
        "x " * 200_000 + "secret=" + key(10), "tok ken oke pas ass",
    ]
    rows = [(i, t) for i, t in enumerate(texts)] + [(None, texts[0]), (None, None), (3, texts[2]), (3, None)]
    return spark.createDataFrame(rows, "doc_id long, text string").unionByName(odd_docs(spark).select("doc_id", "text"))


def test_scan_equals_plain_expressions(spark):
    docs = secret_docs(spark)
    expected = sorted((str(d.doc_id), plain(d.text)) for d in docs.collect())
    found = sorted((str(r.doc_id), [f"{s.kind}:{s.start}:{s.end}" for s in r.spans]) for r in secret_scan.scan(docs).collect())
    assert found == expected and sum(len(s) for _, s in found) > 20
    whole = secret_scan.build_index(docs)
    assert found == sorted((str(r.doc_id), [f"{s.kind}:{s.start}:{s.end}" for s in r.spans]) for r in secret_scan.scan(docs, index=whole).collect())
    assert secret_scan.scan(no_docs(spark)).collect() == [] and secret_scan.scan(docs, ()).filter(F.size("spans") > 0).isEmpty()


def test_index_lists_every_trigram(spark, monkeypatch):
    docs = secret_docs(spark).filter("doc_id is not null and length(text) < 100000").coalesce(2)
    rows = secret_scan.build_index(docs).collect()
    ids = {r.segment: r.ids for r in rows if r.trigram == -1}
    found = sorted((r.trigram, ids[r.segment][d], r.segment, d) for r in rows if r.trigram >= 0 for d in r.docs)
    assert len(found) == len(set(found))
    expected = sorted({(int.from_bytes(t[i : i + 3], "big"), n, d.doc_id) for n, d in enumerate(docs.collect()) for t in [(d.text or "").encode().lower()] for i in range(len(t) - 2)}, key=lambda r: (r[0], r[2]))
    assert [(g, d) for g, d, *_ in found] == [(g, d) for g, _, d in expected]


def test_candidates_are_few_and_none_is_missed(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    texts = {d.doc_id: d.text or "" for d in docs.collect()}
    patterns = [r.pattern for r in secret_scan.RULES]
    found = {r.doc_id: r.rules for r in secret_scan.candidates(secret_scan.build_index(docs), patterns).collect()}
    for n, p in enumerate(patterns):
        query = secret_scan.trigram_query(p)
        if query is not True:
            assert {d for d, mask in found.items() if mask >> n & 1} == {d for d, t in texts.items() if holds(query, t.encode().lower())}
            assert all(found.get(d, 0) >> n & 1 for d, t in texts.items() if re.search(p, t, re.ASCII))
    assert 0 < len(found) < len(texts) / 2


def test_merge_join_beyond_the_bound(spark, monkeypatch):
    docs = secret_docs(spark)
    key = lambda df: sorted(map(str, df.collect()))
    expected = key(secret_scan.scan(docs))
    monkeypatch.setattr(secret_scan, "BROADCAST_ROWS", 0)
    monkeypatch.setattr(secret_scan, "SEGMENT_PAIRS", 1)
    assert key(secret_scan.scan(docs)) == expected


def test_sql(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{FOLDER}/documents.parquet'")
    found = con.execute(ORACLES["op11_secret_scan"])
    names = [d[0] for d in found.description]
    rows = QUERIES["op11_secret_scan"](spark, FOLDER).select(*names).collect()
    assert sorted(map(tuple, rows)) == sorted(found.fetchall())
