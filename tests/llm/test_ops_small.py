"""Brute force, round trips and edge cases for the ten operators, on small tables."""

import collections
import hashlib
import math
import random
import re
import struct
import zlib

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from versemill.llm import chat, mixing, ngram_join, packing, quality_classifier, quality_rules, resharding, textbytes, topk, toxicity, url_filter
from versemill.llm.components import connected_components
from versemill.llm.oracles import ORACLES
from versemill.llm.queries import QUERIES, tokenizer_path
from versemill.llm.staging import Staging

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
DOCS = "doc_id long, text string, lang string, source string, n_chars long, size int, score double, label string, copies string"
FOLDER = "/root/testdata/sf0.001"


def odd_docs(spark):
    """Nulls in every column, empty, blank, tiny, repeated and very long texts; more columns with names that operators use."""
    rng = random.Random(3)
    prose = lambda n: " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randrange(2, 8))) for _ in range(n))
    base = prose(120)
    rows = [
        (1, None, "en", "b"), (2, "", "en", "b"), (3, " \t\n", None, None), (4, "one two", "en", None), (5, "ONE two", "en", "a"), (6, base, "en", "a"), (7, base.upper(), "fr", "a"),
        (8, base + " tail", "en", "c"), (9, prose(120), None, "c"), (9, prose(120), None, "c"), (10, base, "en", "a"), (10, base, "en", "a"), (None, prose(80), "en", "d"), (None, None, None, None),
        (11, prose(30_000), "de", "e"), (12, "x" * 300_000, "de", "e"), (13, "é " * 500, "fr", "a"), (14, "word " * 400, "en", "a"),
    ]
    return spark.createDataFrame([(*r, None, None, 1.0, "x", "y") for r in rows], DOCS)


def no_docs(spark):
    return spark.createDataFrame([], DOCS)


LABELS = "doc_id long, quality int, toxic int"


def labels(spark, rows=((6, 1, 0), (6, 0, 1), (None, 1, 1), (9, None, None), (14, 0, 0), (8, 1, 0), (7, 1, 0))):
    return spark.createDataFrame([*rows], LABELS)


def shingles(text):
    w = WORD.findall((text or "").translate(LOW))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def brute_components(rows):
    """rows: (id, text). The smallest id that links lead to, for each row."""
    sets = [shingles(t) for _, t in rows]
    group = list(range(len(rows)))

    def root(x):
        while group[x] != x:
            x = group[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= 75 * len(sets[i] | sets[j]):
                group[root(i)] = root(j)
    names = collections.defaultdict(list)
    for i, (d, _) in enumerate(rows):
        names[root(i)].append(d)
    smallest = {r: min((d for d in ds if d is not None), default=None) for r, ds in names.items()}
    return [(d, len(s), smallest[root(i)]) for i, ((d, _), s) in enumerate(zip(rows, sets))]


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_against_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "conversations", "labels", "pages"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    df = QUERIES[name](spark, FOLDER)
    found = con.execute(ORACLES[name])
    names = [d[0] for d in found.description]
    assert sorted(names) == sorted(df.columns)
    plain = lambda rows: sorted(tuple(f"{v:.6g}" if isinstance(v, float) else str(v) for v in r) for r in rows)
    assert plain(df.select(*names).collect()) == plain(found.fetchall())


# 1


def test_mix_edges_and_targets(spark):
    docs = odd_docs(spark)
    plan = mixing.plan_mix(docs).collect()
    assert len(plan) == docs.count() and mixing.plan_mix(no_docs(spark)).count() == 0
    assert all(r.taken <= 3 * r["size"] for r in plan)
    assert sorted((str(r.doc_id), r["size"]) for r in plan) == sorted((str(r.doc_id), len(WORD.findall(r.text or ""))) for r in docs.collect())
    assert abs(sum({r.source: r.target for r in plan}.values()) - sum(r["size"] for r in plan)) < 1e-6
    again = mixing.plan_mix(docs).collect()
    assert sorted(map(str, plan)) == sorted(map(str, again))
    mixed = mixing.mix_documents(docs)
    assert mixed.columns == docs.columns
    assert mixed.count() == sum(r.copies for r in plan)


def test_mix_is_near_target_even_in_a_hot_source(spark):
    rng = random.Random(1)
    rows = [(i, " ".join(["w"] * rng.randrange(1, 200)), "en", "hot" if i % 3 else f"s{i % 7}") for i in range(3000)]
    plan = mixing.plan_mix(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).groupBy("source").agg(F.sum("taken").alias("t"), F.max("target").alias("g"), F.max("size").alias("m"))
    assert all(abs(r.t - r.g) <= 2 * r.m for r in plan.collect())


# 2


BIG = "query_id", "rank", "vec_id", "score"


def brute_top(rows, k=5, scale=256):
    """rows: (id, vector). Every row is a candidate to every other of its length; scores as true whole numbers."""
    there = [(i, [math.floor(scale * x) if math.isfinite(scale * x) else scale * int(x) for x in v]) for i, v in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v)]
    want = []
    for n, (q, v) in enumerate(there):
        if q % 50 == 0:
            scores = sorted((-sum(a * b for a, b in zip(v, w)), i) for m, (i, w) in enumerate(there) if m != n and len(w) == len(v))[:k]
            want += [(q, r + 1, i, max(-(2**63), min(2**63 - 1, -s))) for r, (s, i) in enumerate(scores)]
    return sorted(want)


def searched(df, **options):
    found = topk.top_k(df, F.col("vec_id") % 50 == 0, **options)
    assert tuple(found.columns) == BIG
    return sorted(tuple(r) for r in found.collect())


@pytest.mark.parametrize("wide", [False, True])
def test_topk_against_brute_force(spark, wide):
    rng = np.random.default_rng(2)
    vectors = [[float(x) for x in v] for v in rng.normal(size=(300, 12)).round(1)]
    rows = [(i, v) for i, v in enumerate(vectors)] + [(3, vectors[3]), (50, vectors[50]), (50, vectors[7]), (900, None), (950, [1.0, None]), (951, [float("nan")] * 12), (1000, [float("inf")] * 12), (1050, [1.0, 2.0]), (1051, [3.0, 1.0]), (None, vectors[0]), (1100, [])]
    if wide:
        rows += [(1150, [1e300] * 12), (1151, [-1e300] * 12), (1200, [2.0**30, 1.0] * 6), (1201, [2.0**30 + 1] * 12), (1250, [1e15 + k for k in range(12)]), (1251, [-1e15] * 12), (1300, [1.7e308] * 12), (1301, [524288.0] * 12)]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "vec_id long, embedding array<double>, row string, wide int")
    assert searched(df, cell_bytes=64 * 96, block=4, run=16) == brute_top(rows)
    assert topk.top_k(df.filter("vec_id > 5000"), F.col("vec_id") % 50 == 0).count() == 0


def test_topk_keeps_large_vectors_and_repeated_rows(spark):
    rows = [(50, [2.0**30, 1.0]), (1, [2.0**30, 0.0]), (2, [1.0, 1.0]), (2, [1.0, 1.0]), (2, [1.0, 1.0]), (3, [0.5, 0.5])]
    got = searched(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
    assert got == brute_top(rows) and [r[2] for r in got] == [1, 2, 2, 2, 3]


def test_cell_search_is_exact_with_pruning():
    rng = np.random.default_rng(4)
    v = np.floor(rng.normal(size=(2000, 32)) * 20)
    cell = topk._Cell(np.arange(2000), np.arange(2000), v, None, 1, 4, 128)
    asked = np.arange(0, 2000, 137)
    for q, (scores, ids) in zip(asked, cell.search(asked, v[asked], None, 1, 5)):
        s = v @ v[q]
        order = [i for i in np.lexsort((np.arange(2000), -s)) if i != q][:5]
        assert ids == order and scores == s[order].tolist()


# 3


def test_encoder_gives_the_files_ids():
    import tokenizers

    with open(tokenizer_path(), encoding="utf-8") as f:
        content = f.read()
    encode, slow = packing.Encoder(content), tokenizers.Tokenizer.from_str(content)
    slow.encode_special_tokens = True
    assert encode.fast is not None
    for text in ("", "Hello  world\n\n 's", "naïve Ünïcode 漢字 🙂", " " * 50 + "x", "a" * 5000, "<|endoftext|> end", "don't 123,456"):
        assert encode(text).tolist() == slow.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("group_pieces,fan_in", [(50_000, 8), (3, 2), (5, 3)])
def test_packing_is_gapless_and_whole(spark, group_pieces, fan_in):
    rows = packing.pack_documents(odd_docs(spark), tokenizer_path(), group_pieces=group_pieces, fan_in=fan_in).collect()
    places = collections.defaultdict(list)
    for r in rows:
        places[r.sequence_id].append((r.offset, r.length))
    for found in places.values():
        at = 0
        for offset, length in sorted(found):
            assert offset == at
            at += length
        assert at <= 1024
    assert sum(r.length == 1 for r in rows) >= 3  # null, empty: the end token alone
    encode = packing.Encoder(open(tokenizer_path(), encoding="utf-8").read())
    for d, t in ((11, None), (4, "one two")):
        mine = sorted((r for r in rows if r.doc_id == d), key=lambda r: r.piece)
        text = t or next(x.text for x in odd_docs(spark).filter(f"doc_id = {d}").collect())
        ids = [*encode(text).tolist(), 2]
        for r in mine:
            part = ids[r.start : r.start + r.length]
            assert len(part) == r.length and zlib.crc32(struct.pack(f"<{len(part)}I", *part)) == r.ids_crc32
        assert sum(r.length for r in mine) == len(ids) and all(r.length == 1024 for r in mine[1:])
    assert packing.pack_documents(no_docs(spark), tokenizer_path()).count() == 0


def test_best_fit_is_tight():
    rng = random.Random(8)
    for _ in range(50):
        sizes = sorted((rng.randrange(1, 65) for _ in range(300)), reverse=True)
        where, offsets, fill = packing.best_fit(sizes, 64)
        assert max(fill) <= 64 and sum(fill) == sum(sizes) and sum(2 * f <= 64 for f in fill) <= 1
        assert len(fill) <= math.ceil(1.2 * sum(sizes) / 64) + 1


# 4


def test_chat_round_trip(spark):
    nasty = ["", "\\", "</turn>", "<\\turn>", "<turn>\n</turn>\n", "\\### Assistant: </turn> ok", "a<\\\\/turn>b", "<", "\n", "$1 \\1"]
    rows = [(1, i, ("user", "assistant", None, "we\\ird\nrole")[i % 4], t) for i, t in enumerate([*nasty, None])] + [(2, 0, "assistant", "x"), (2, 0, "assistant", "x"), (None, None, "user", "y")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    out = chat.format_paths(chat.linear_trees(df)).select("tree", "segments", "formatted", chat.read_turns(F.col("formatted")).alias("turns"), chat.read_loss(F.col("segments")).alias("loss")).collect()
    by = {r.tree: r for r in out}
    mine = [(r[2] or "", r[3] or "") for r in rows if r[0] == 1]
    assert [(t.role, t.text) for t in by[1].turns] == mine
    assert by[1].loss == "".join(t for r, t in mine if r == "assistant") and by[2].loss == "xx" and len(by[None].turns) == 1
    assert all("".join(s.text for s in r.segments) == r.formatted for r in out)
    assert chat.format_paths(chat.linear_trees(df.filter("conv_id = 99"))).count() == 0


def test_reply_trees_rank_branches(spark):
    rng = random.Random(9)
    nodes = [("t", 0, None, 0.5)] + [("t", i, rng.randrange(i), round(rng.random(), 3)) for i in range(1, 60)] + [("u", 1, 2, 1.0), ("u", 2, 1, 1.0), ("v", 5, 77, 2.0)]
    df = spark.createDataFrame([(*n, "user", f"n{n[1]}") for n in nodes], "tree string, node long, parent long, score double, role string, text string")
    got = chat.format_paths(df, paths_per_tree=3).select("tree", "rank", "path_score", chat.read_turns(F.col("formatted")).alias("turns")).collect()
    parent, score = {n[1]: n[2] for n in nodes[:60]}, {n[1]: n[3] for n in nodes[:60]}

    def path(x):
        return path(parent[x]) + [x] if parent[x] is not None else [x]

    leaves = [x for x in parent if x not in set(parent.values())]
    best = sorted(((-sum(score[y] for y in path(x)), x) for x in leaves))[:3]
    assert [[t.text for t in r.turns] for r in sorted((r for r in got if r.tree == "t"), key=lambda r: r["rank"])] == [[f"n{y}" for y in path(x)] for _, x in best]
    assert [r.tree for r in got if r.tree != "t"] == ["v"]  # a cycle has no root; a missing parent makes one


# 5


def test_flow_moves_the_fewest_bytes():
    rng = random.Random(10)
    for _ in range(20):
        supply = [rng.randrange(0, 1000) for _ in range(6)]
        demand = resharding.equal_capacities(sum(supply), 8)
        flow = resharding.min_cost_flow(supply, demand, lambda i, j: int(i != j))
        assert [sum(v for (a, _), v in flow.items() if a == i) for i in range(6)] == supply
        assert [sum(v for (_, b), v in flow.items() if b == j) for j in range(8)] == demand
        assert sum(v for (a, b), v in flow.items() if a != b) == sum(max(0, s - d) for s, d in zip(supply, demand))
    with pytest.raises(ValueError):
        resharding.min_cost_flow([1], [2], lambda i, j: 0)
    priced = resharding.min_cost_flow([3, 3], [2, 4], lambda i, j: [[5, 1], [1, 4]][i][j])
    assert sum([[5, 1], [1, 4]][a][b] * v for (a, b), v in priced.items()) == 3 * 1 + 2 * 1 + 1 * 4


def test_reshard_law(spark):
    docs = odd_docs(spark).unionByName(spark.read.parquet(f"{FOLDER}/documents.parquet").select("*", *[F.lit(None).cast(t).alias(c) for c, t in (("size", "int"), ("score", "double"), ("label", "string"), ("copies", "string"))]))
    rows = resharding.reshard(docs, 7, old_shards=3).collect()
    assert len(rows) == docs.count()
    shards = collections.defaultdict(list)
    for r in rows:
        shards[r.shard].append(r)
    for found in shards.values():
        assert sorted(r.slot for r in found) == list(range(len(found)))
    total = sum(r["size"] for r in rows)
    largest = max(r["size"] for r in rows)
    assert all(abs(sum(r["size"] for r in found) - total / 7) <= largest for found in shards.values())
    assert {r.text_crc32 for r in rows if r["size"] == 16} == {0}
    assert resharding.reshard(no_docs(spark), 4).count() == 0


def test_rewrite_touches_only_affected_shards(spark, tmp_path):
    path, local = f"file://{tmp_path}/shards", tmp_path / "shards"
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "text", F.lit("r").alias("row"), F.when(F.col("doc_id") % 10 == 0, 2).otherwise(F.col("doc_id") % 2).cast("int").alias("shard"))
    resharding.write_layout(docs, path)
    rows = resharding.stored_rows(resharding.read_layout(spark, path))
    plan = rows.withColumn("shard", F.when((F.col("old_shard") == 1) & (F.col("doc_id") % 3 == 0), 3).otherwise(F.col("old_shard")))
    want = sorted((r.doc_id, r.shard) for r in plan.collect())
    assert resharding.rewrite_affected(spark, path, plan) == [1, 3]
    after = resharding.read_layout(spark, path)
    assert sorted((r.doc_id, r.shard) for r in after.collect()) == want and after.columns == docs.columns
    first, second = sorted(local.glob("data/write=*"), key=lambda f: f.stat().st_mtime_ns)
    assert sorted(f.name for f in second.glob("shard=*")) == ["shard=1", "shard=3"]
    resharding.vacuum(spark, path)
    assert sorted(f.name for f in first.glob("shard=*")) == ["shard=0", "shard=2"]
    assert sorted((r.doc_id, r.shard) for r in resharding.read_layout(spark, path).collect()) == want


def test_rewrite_moves_single_rows_of_an_id(spark, tmp_path):
    path = f"file://{tmp_path}/shards"
    rows = [(None if i % 3 else 7, "x" * (i % 5 * 40), 0) for i in range(60)]
    resharding.write_layout(spark.createDataFrame(rows, "doc_id long, text string, shard int"), path)
    plan = resharding.plan_reshard(resharding.stored_rows(resharding.read_layout(spark, path)), 3, old_shards=3)
    planned = {r.shard: r.bytes for r in plan.groupBy("shard").agg(F.sum("size").alias("bytes")).collect()}
    assert resharding.rewrite_affected(spark, path, plan) == [0, 1, 2]
    stored = resharding.read_layout(spark, path)
    there = {r.shard: r.bytes for r in stored.groupBy("shard").agg(F.sum(resharding.document_size(F.col("text"))).alias("bytes")).collect()}
    assert there == planned and stored.count() == 60 and max(there.values()) - min(there.values()) <= 176


def test_a_stopped_rewrite_leaves_the_old_layout(spark, tmp_path):
    path = f"file://{tmp_path}/shards"
    docs = spark.createDataFrame([(i, "x", i % 2) for i in range(10)], "doc_id long, text string, shard int")
    resharding.write_layout(docs, path)
    docs.write.partitionBy("shard").parquet(f"{path}/data/write=stopped")  # written, but no manifest names it
    spark.range(1).write.json(f"{path}/layout/v=1")
    next((tmp_path / "shards/layout/v=1").glob("_SUCCESS")).unlink()  # a manifest whose job never committed
    assert resharding.read_layout(spark, path).count() == 10


def brute_cost(supply, demand, price):
    """The least cost, by trying every way to send whole units."""
    if not supply:
        return 0
    best = math.inf

    def deal(j, left, cost, rest):
        nonlocal best
        if j == len(demand):
            if not left:
                best = min(best, cost + brute_cost(supply[1:], rest, price[1:]))
            return
        for amount in range(min(left, rest[j]) + 1):
            deal(j + 1, left - amount, cost + amount * price[0][j], [*rest[:j], rest[j] - amount, *rest[j + 1 :]])

    deal(0, supply[0], 0, list(demand))
    return best


def test_flow_against_brute_force():
    rng = random.Random(51)
    for _ in range(25):
        supply = [rng.randrange(0, 5) for _ in range(3)]
        cuts = sorted(rng.randrange(0, sum(supply) + 1) for _ in range(2))
        demand = [cuts[0], cuts[1] - cuts[0], sum(supply) - cuts[1]]
        price = [[rng.randrange(0, 6) for _ in range(3)] for _ in range(3)]
        flow = resharding.min_cost_flow(supply, demand, lambda i, j: price[i][j])
        assert sum(price[i][j] * v for (i, j), v in flow.items()) == brute_cost(supply, demand, price)


def test_plan_moves_about_what_the_flow_does(spark):
    rng = random.Random(52)
    rows = [(i, rng.randrange(1, 400), rng.choice((0, 0, 0, 1, 2))) for i in range(4000)]
    plan = resharding.plan_reshard(spark.createDataFrame(rows, "doc_id long, size long, old_shard int"), 4, old_shards=3).collect()
    supply = [sum(s for _, s, o in rows if o == k) for k in range(3)] + [0]
    least = sum(max(0, s - d) for s, d in zip(supply, resharding.equal_capacities(sum(supply), 4)))
    moved = sum(r["size"] for r in plan if r.old_shard != r.shard)
    assert len(plan) == 4000 and least <= moved <= least + 4 * 400
    totals = [sum(r["size"] for r in plan if r.shard == k) for k in range(4)]
    assert max(totals) - min(totals) <= 20


# 6


def test_url_rules(spark):
    cases = {
        "http://a.example.net/en/x?q": ("a.example.net", "/en/x", "example.net/en/", "allow"), "HTTPS://Example.NET/de/": ("example.net", "/de/", "net/", "block"),
        "x://notexample.net/en/": ("notexample.net", "/en/", "net/", "block"), "http://w.org/fr/#a": ("w.org", "/fr/", "org/fr/", "allow"), "http://example.com/de/1": ("example.com", "/de/1", "example.com/de/", "block"),
        "http://foo.net": ("foo.net", "", None, "allow"), "no scheme": ("", "", None, "allow"), None: ("", "", None, "allow"), "http://": ("", "", None, "allow"),
        "a://b.com?x=http://c.net/": ("b.com", "", None, "allow"), "http://ÀB.com/É": ("Àb.com", "/É", None, "allow"),
    }
    df = spark.createDataFrame([(i, u, None) for i, u in enumerate(cases)], "page_id long, url string, html string")
    got = {r.page_id: (r.host, r.path, r.rule) for r in url_filter.judge_pages(df).collect()}
    assert got == {i: w[:3] for i, w in enumerate(cases.values())}
    assert url_filter.judge_pages(df.filter("page_id > 99")).count() == 0


def test_rule_ties_and_lengths(spark):
    df = spark.createDataFrame([("a.x.io", "/p/q"), ("x.io", "/p"), ("y.io", "/")], "host string, path string")
    rules = (("block", "x.io", "/p"), ("allow", ".io", "/pp"), ("allow", "x.io", "/p"), ("allow", "a.x.io", "/"), ("allow", "io", "/"))
    got = {r.host: r.m for r in df.select("host", url_filter.matching_rule(F.col("host"), F.col("path"), rules).alias("m")).collect()}
    assert got["a.x.io"].rule == "a.x.io/" and got["x.io"].verdict == "block" and got["y.io"].verdict == "allow"


def page_rank(edges, start, damping=0.85):
    """edges: (a, b) or (a, b, weight) along which scores flow; hosts without an edge keep what they would pass on."""
    edges = [(*e, 1)[:3] for e in edges]
    out = collections.Counter()
    for a, _, w in edges:
        out[a] += w
    total = sum(start.values())
    score = start = {h: s / total if total else 0.0 for h, s in start.items()}
    for _ in range(600):
        new = {h: (1 - damping) * s + damping * (score[h] if not out[h] else 0) for h, s in start.items()}
        for a, b, w in edges:
            new[b] += damping * score[a] * w / out[a]
        score = new
    return score


def brute_verdicts(rows, lift=1):
    """Host to (trust, distrust, blocked) by plain PageRank, for rows (id, host, verdict by rule, linked hosts)."""
    pages, links = collections.Counter(h for _, h, _, _ in rows), collections.Counter((h, d) for _, h, _, ds in rows for d in set(ds) if d != h)
    named = set(pages) | {d for _, d in links}
    ties, names = set(), set(named)
    for h in named:
        while h.count(".") >= 2 and not h.rsplit(".", 1)[1].isdigit():
            ties.add((h, h.split(".", 1)[1]))
            h = h.split(".", 1)[1]
            names.add(h)
    edges = collections.Counter(links)
    for a, b in ties:
        edges[a, b] += 1
        edges[b, a] += 1
    along, against = [(a, b, w) for (a, b), w in edges.items()], [(b, a, w) for (a, b), w in edges.items()]
    count = lambda v: {h: sum(x == h and (v is None or y == v) for _, x, y, _ in rows) for h in names}
    linked = {h: int(h in named and h not in pages) for h in names}
    everything = {h: n + linked[h] for h, n in count(None).items()}
    trust, distrust, fame, reach = page_rank(along, count("allow")), page_rank(against, count("block")), page_rank(along, everything), page_rank(against, everything)
    return {h: (trust[h], distrust[h], distrust[h] > 0 and distrust[h] >= lift * reach[h] and trust[h] * reach[h] < distrust[h] * fame[h]) for h in pages}


def test_walks_against_brute_force(spark):
    rng = random.Random(61)
    hosts = ["a.one.com", "b.one.com", "one.com", "c.d.two.io", "x.two.io", "three.org", "four.net", "deep.four.net", "five.fr", "1.2.3.4", "solo"]
    rows = []
    for i in range(240):
        h = rng.choice(hosts)
        path, verdict = rng.choice([("/fr/", "allow" if h == "three.org" else None), ("/x", None)])
        rows.append((i, h, path, "block" if h.endswith(".net") else verdict, [d for d in hosts if rng.random() < 0.08 and (d.endswith(".net") is False or h in ("five.fr", "x.two.io", "four.net"))]))
    df = spark.createDataFrame([(i, f"http://{h}{p}", " ".join(f'<a href="//{d}/y">' for d in ds) or None, h, 1) for i, h, p, _, ds in rows], "page_id long, url string, html string, host string, urls int")
    got = {r.page_id: r for r in url_filter.judge_pages(df).collect()}
    want = brute_verdicts([(i, h, v, ds) for i, h, _, v, ds in rows])
    for i, h, _, v, _ in rows:
        trust, distrust, bad = want[h]
        assert abs(got[i].host_trust / url_filter.UNIT - trust) < 1e-4 and abs(got[i].host_distrust / url_filter.UNIT - distrust) < 1e-4
        assert got[i].verdict == (v or ("block" if bad else "allow"))
    assert {r.verdict for i, r in got.items() if rows[i][3] is None} == {"allow", "block"}


def test_distrust_reaches_a_domain_without_pages(spark):
    rows = [(i, f"http://w{i % 3}.shop.example.com/de/{i}", None) for i in range(9)] + [(20, "http://other.shop.example.com/en/", None), (21, "http://far.example.org/", "")] + [(30 + i, f"http://big.org/{i}", None) for i in range(90)]
    got = {r.page_id: r for r in url_filter.judge_pages(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got[20].verdict == "block" and got[20].host_distrust > 0 and got[21].verdict == got[30].verdict == "allow"


def test_distrust_flows_against_links(spark):
    bad, good = [(i, f"http://bad.net/{i}", None) for i in range(4)], [(10 + i, f"http://good.org/fr/{i}", '<a href="//ok.io/">') for i in range(4)]
    rest = [(20, "http://spam.io/", '<a href="http://bad.net/">x</a> <a href=\'http://bad.net/2\'>'), (21, "http://ok.io/", "<a href='/x'>"), (22, "http://far.io/", None)] + [(30 + i, f"http://far.io/{i}", "") for i in range(9)]
    df = spark.createDataFrame(bad + good + rest, "page_id long, url string, html string")
    rows = {r.page_id: r for r in url_filter.judge_pages(df, rounds=6).collect()}
    assert rows[20].verdict == "block" and rows[21].verdict == "allow" and rows[22].verdict == "allow" and rows[0].verdict == "block"
    assert rows[21].host_trust > 0 and rows[22].host_trust == 0
    assert sum({r.host: r.host_trust for r in rows.values()}.values()) <= url_filter.UNIT * (1 + 1e-6)


def test_scores_converge_along_a_chain(spark):
    hosts = [f"h{i}" for i in range(20)] + ["bad.net"]
    rows = [(i, f"http://{h}/", f'<a href="http://{after}/">') for i, (h, after) in enumerate(zip(hosts, hosts[1:]))] + [(50, "http://bad.net/", None)] + [(100 + i, "http://big/", None) for i in range(2000)]
    got = {r.host: r for r in url_filter.judge_pages(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    want = page_rank([(b, a) for a, b in zip(hosts, hosts[1:])], {h: float(h == "bad.net") for h in [*hosts, "big"]})
    assert all(abs(got[h].host_distrust / url_filter.UNIT - want[h]) <= 0.01 / len(rows) for h in want)
    assert {h for h in want if got[h].verdict == "block"} == set(hosts)
    falling = [got[h].host_distrust for h in hosts[::-1]][:-1]  # the chain's far end keeps what it can't pass on
    assert falling == sorted(falling, reverse=True)


def test_links_to_hosts_without_pages(spark):
    html = "<a href=http://spam.net/x>a</a> <a href = HTTPS://SPAM.net/x>b</a> <a href=' //worse.net/?q'>c</a>"
    rows = [(1, "http://a.io/", html), (2, "http://b.io/", "<a href='//good.org/fr/1'>"), (3, "http://c.io/", "<a href=//good.org/de/>"), *((10 + i, "http://big.io/", "<a href=/x>") for i in range(100))]
    got = {r.page_id: r for r in url_filter.judge_pages(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got.keys() == {r[0] for r in rows}
    want = page_rank([("spam.net", "a.io"), ("worse.net", "a.io")], {"spam.net": 0.5, "worse.net": 0.5, "a.io": 0.0})
    assert abs(got[1].host_distrust / url_filter.UNIT - want["a.io"]) < 1e-4
    assert {i for i, r in got.items() if r.verdict == "block"} == {1}
    assert got[2].host_distrust == got[3].host_distrust == got[2].host_trust == 0


def test_url_edges(spark):
    rows = [(1, "http://" + "a." * 5000 + "com/", None), (1, "http://" + "a." * 5000 + "com/", None), (2, "http://x.example.com/de/", "<a href='//" + "b." * 400 + "io/'>" * 50), (None, None, None), (3, "http://..../", ""), (3, "http://..../", "<a href=//./>")]
    df = spark.createDataFrame([(*r, "x", 5) for r in rows], "page_id long, url string, html string, verdict string, urls int")
    assert sorted(str(r.page_id) for r in url_filter.judge_pages(df).collect()) == sorted(str(r[0]) for r in rows)


# 7


def test_ordinal_fit_recovers_grades():
    rng = np.random.default_rng(7)
    texts, y = [], []
    for _ in range(600):
        grade = int(rng.integers(0, 4))
        texts.append(" ".join(rng.choice(["zzq", "abc"], p=[0.1 + 0.25 * grade, 0.9 - 0.25 * grade], size=80)))
        y.append(grade)
    y = np.array(y)
    found = list(quality_classifier.text_features(pa.array(texts)))
    bounds = np.r_[0, np.cumsum([len(n) for n, _ in found])]
    w, cuts = quality_classifier.fit_ordinal(np.concatenate([n for n, _ in found]), np.concatenate([s for _, s in found]), bounds, y, np.ones(len(y)))
    assert np.all(np.diff(cuts) > 0)
    numbers = quality_classifier.text_numbers(w, pa.array([*texts, None, ""]))
    expected, above = quality_classifier.grades(numbers[:-2], cuts)
    assert np.abs(expected - y).mean() < 0.35 and np.all(np.diff(above, axis=1) <= 0)
    assert numbers[-1] == numbers[-2] == 0
    sums = [float(s @ w[n]) for n, s in found]
    assert np.allclose(sums, numbers[:-2])


def test_classifier_edges_and_accuracy(spark):
    docs = odd_docs(spark)
    assert quality_classifier.grade_documents(docs, labels(spark)).count() == docs.count()
    assert quality_classifier.grade_documents(docs, labels(spark, [(6, 1, 0)])).filter("kept").count() == docs.count()
    assert quality_classifier.grade_documents(no_docs(spark), labels(spark)).count() == 0
    kept = quality_classifier.keep_documents(docs, labels(spark, [(6, 1, 0)]))
    assert kept.columns == docs.columns and kept.count() == docs.count()
    folder = "/root/testdata/sf0.01"
    d, known = spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet")
    judged = quality_classifier.grade_documents(d, known.filter("doc_id % 2 = 0")).join(known.filter("doc_id % 2 = 1"), "doc_id")
    counts = judged.agg(F.count_if(F.expr("quality = 1 AND NOT kept")).alias("lost"), F.count_if(F.expr("quality = 1")).alias("good"), F.count_if(F.expr("quality = 0 AND NOT kept")).alias("caught"), F.count_if(F.expr("quality = 0")).alias("bad")).first()
    assert counts.lost <= 0.02 * counts.good and counts.caught >= 0.75 * counts.bad


# 8


def plain_models(counts, discount):
    """shared(symbols) and P(symbols, class), both of the last symbol after the ones before, from {code symbols: (toxic, ordinary)}."""
    kinds = {5: set(counts)}
    for n in range(4, 0, -1):
        kinds[n] = {g[1:] for g in kinds[n + 1]}
    before = {n: collections.Counter(g[1:] for g in kinds[n + 1]) for n in range(1, 5)}

    def shared(g):
        if not g:
            return 1 / 32
        after = [before[len(g)][g[:-1] + (w,)] for w in range(32)]
        if not sum(after):
            return shared(g[1:])
        return (max(before[len(g)][g] - discount, 0) + discount * sum(c > 0 for c in after) * shared(g[1:])) / sum(after)

    def of_class(g, k):
        after = [counts.get(g[:-1] + (w,), (0, 0))[k] for w in range(32)]
        if not sum(after):
            return shared(g[1:])
        return max(counts.get(g, (0, 0))[k] - discount, 0) / sum(after) + discount * sum(c > 0 for c in after) / sum(after) * shared(g[1:])

    return shared, of_class


def test_kneser_ney_against_plain_models(spark):
    rng = random.Random(8)
    symbols = [0, 1, 2, 5, 9]
    counts = {}
    for _ in range(500):
        g = tuple(rng.choice(symbols) for _ in range(5))
        counts[g] = (rng.choice((0, 0, 1, 4)), rng.choice((0, 1, 3)))
    counts = {g: c for g, c in counts.items() if sum(c)}
    shared, of_class = plain_models(counts, 0.75)
    number = lambda g: sum(x << (5 * (len(g) - 1 - i)) for i, x in enumerate(g))
    for g in list(counts)[:40]:
        for k in (0, 1):
            assert abs(sum(of_class(g[:-1] + (w,), k) for w in range(32)) - 1) < 1e-9
        assert abs(sum(shared(g[1:-1] + (w,)) for w in range(32)) - 1) < 1e-9
    rows = spark.createDataFrame([(number(g), *c) for g, c in counts.items()], "code int, toxic long, ordinary long")
    table = toxicity.ratio_table(rows, Staging(spark, "test"), 0.75)
    for g in counts:
        assert abs(table[number(g)] * toxicity.STEP - (math.log(of_class(g, 0)) - math.log(of_class(g, 1)))) <= toxicity.STEP / 2 + 1e-4
    for _ in range(200):  # a symbol not seen after a context that was
        g = rng.choice(list(counts))[:-1] + (17,)
        assert abs(table[number(g)] * toxicity.STEP - (math.log(of_class(g, 0)) - math.log(of_class(g, 1)))) <= toxicity.STEP / 2 + 1e-4
    assert table[number((20, 21, 22, 23, 24))] == 0
    same = toxicity.ratio_table(rows.withColumn("ordinary", F.col("toxic") + 1).withColumn("toxic", F.col("toxic") + 1), Staging(spark, "test"), 0.75)
    assert not same.any()  # no difference, no evidence


def test_toxicity_edges_and_accuracy(spark):
    docs = odd_docs(spark)
    out = toxicity.score_documents(docs, labels(spark)).collect()
    assert len(out) == docs.count() and all(0 <= r.score <= 1 for r in out)
    assert {r.score for r in toxicity.score_documents(docs, labels(spark, [(6, 1, 0)])).collect()} == {0.0}
    assert toxicity.score_documents(no_docs(spark), labels(spark)).count() == 0
    rng = random.Random(11)
    words = ["".join(rng.choice("abcdefghij") for _ in range(5)) for _ in range(300)]
    rows, marks = [], []
    for i in range(1500):
        text = [rng.choice(words) for _ in range(rng.randrange(5, 120))]
        if toxic := i % 5 == 0:
            text[rng.randrange(len(text))] = "vexqual" + rng.choice(["ish", "ing", "ed", ""])
        rows.append((i, " ".join(text)))
        marks.append((i, 1, int(toxic)))
    scored = toxicity.score_documents(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(marks, LABELS)).collect()
    held = [r for r in scored if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in scored)
    assert sum(r.predicted == (r.doc_id % 5 == 0) for r in held) >= 0.98 * len(held)


def test_toxicity_learns_from_every_training_text(spark):
    """An expression that stands only in the curve's share is found in the held-out fold."""
    rng = random.Random(12)
    words = ["".join(rng.choice("abcdefghij") for _ in range(5)) for _ in range(300)]
    rows, marks, rare = [], [], []
    for i in range(3000):
        text, check = [rng.choice(words) for _ in range(rng.randrange(5, 60))], zlib.crc32(str(i).encode())
        if toxic := i % 5 == 0:
            if unlike := i % 25 == 0 and (check % 3 == 1 or check // 3 % 4 == 0):
                rare.append(i)
            text[rng.randrange(len(text))] = "zumptrov" if unlike else "vexqual"
        rows.append((i, " ".join(text)))
        marks.append((i, 1, int(toxic)))
    scored = toxicity.score_documents(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(marks, LABELS)).collect()
    held = [r for r in scored if r.held_out]
    usual = sorted(r.score for r in held if r.doc_id % 5)[int(0.98 * sum(r.doc_id % 5 > 0 for r in held))]
    found = [r.score > usual for r in held if r.doc_id in rare]
    assert len(found) > 10 and sum(found) >= 0.8 * len(found)


# 9


def brute_stats(text):
    w = WORD.findall(text or "")
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    windows = collections.Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    covered = {k for i in range(len(w) - 2) if windows[tuple(w[i : i + 3])] > 1 for k in (i, i + 1, i + 2)}
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(covered)


def test_rule_counts_against_brute_force(spark):
    docs = odd_docs(spark).unionByName(spark.createDataFrame([(100 + i, t, "en", "a", None, None, None, None, None) for i, t in enumerate(["a a a", "a a a a", "x\nx\n\n \nx", "a b c d a b c", "#*$ %&|<>", "a\x0bb\x0cc\x85d\u00a0e"])], DOCS))
    judged = quality_rules.apply_rules(docs, labels(spark)).collect()
    want = sorted((str(r.doc_id), *brute_stats(r.text)) for r in docs.collect())
    assert sorted((str(r.doc_id), r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in judged) == want
    assert all(r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words) for r in judged)
    assert quality_rules.apply_rules(no_docs(spark), labels(spark)).count() == 0
    kept = quality_rules.keep_documents(docs.withColumn("n_words", F.lit("clash")).withColumn("kept", F.lit("clash")), labels(spark))
    assert kept.columns == [*docs.columns, "n_words", "kept"] and kept.filter("kept = 'clash'").count() == sum(r.kept for r in judged)


def test_binomial_bound_is_exact(spark):
    def most(n, p, level):
        total, k = 0.0, -1
        for i in range(n + 1):
            total += math.comb(n, i) * p**i * (1 - p) ** (n - i)
            if total > level:
                return k
            k = i
        return k

    df = spark.createDataFrame([(n,) for n in (0, 1, 10, 500, 1160, 2000)], "n long")
    for p, level in ((0.005, 0.003), (0.02, 0.05)):
        got = {r.n: r.k for r in df.select("n", quality_rules.most_rejections(F.col("n"), p, F.lit(level)).alias("k")).collect()}
        assert got == {n: most(n, p, level) for n in got}


def test_cutoffs_keep_their_promise(spark):
    rng = random.Random(12)
    rows = [(i, "en", 0 if i % 10 else rng.randrange(20, 60), 100, 0, 0, 0, 10, int(i % 10 > 0)) for i in range(20_000)]
    rows = [(*r[:2], r[2] if r[8] == 0 else rng.choice((0, 0, 0, 1)), *r[3:]) for r in rows]
    df = spark.createDataFrame(rows, "doc_id long, lang string, n_symbols long, word_chars long, n_dup_lines long, n_repeat_words long, pad long, n_lines long, quality int").withColumn("n_words", F.lit(100).cast("long")).withColumn("_digest", F.col("doc_id"))
    cut = quality_rules.fit_cutoffs(df.drop("quality"), df.select("doc_id", "quality"))
    judged = quality_rules.judge(df, cut).agg(F.count_if(F.expr("quality = 1 AND NOT kept")).alias("lost"), F.count_if(F.expr("quality = 0 AND kept")).alias("missed")).first()
    assert judged.lost <= 0.02 * 18_000 and judged.missed == 0


# 10


@pytest.mark.parametrize("tile,tile_tokens", [(2048, 4_000_000), (4, 4_000_000), (2, 90), (2048, 200)])
def test_jaccard_against_brute_force(spark, tile, tile_tokens):
    rng = random.Random(13)
    vocabulary = [f"w{i}" for i in range(400)]
    rows, passage = [], " ".join(rng.choice(vocabulary) for _ in range(60))
    for _ in range(25):
        base = [rng.choice(vocabulary) for _ in range(rng.randrange(3, 90))]
        for _ in range(rng.randrange(1, 9)):
            w = list(base)
            for _ in range(rng.randrange(0, 4)):
                w[rng.randrange(len(w))] = rng.choice(vocabulary)
            rows.append((len(rows), " ".join(w) + (" " + passage if rng.random() < 0.4 else "")))
    rows += [(r.doc_id, r.text) for r in odd_docs(spark).collect()]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = ngram_join.jaccard_components(df, tile=tile, tile_tokens=tile_tokens, range_tokens=500, block_tokens=900, frequent=3).collect()
    want = brute_components(rows)
    # rows of an id that names several sets can't be told apart by id: compare as a whole
    assert sorted(map(str, map(tuple, got))) == sorted(str((d, n, c if n else d)) for d, n, c in want)


def test_join_edges(spark):
    assert ngram_join.jaccard_components(no_docs(spark)).count() == 0
    docs = odd_docs(spark)
    kept = ngram_join.one_of_each(docs)
    assert kept.columns == docs.columns
    ids = collections.Counter(r.doc_id for r in kept.collect())
    assert ids == {1: 1, 2: 1, 3: 1, 4: 1, 6: 1, 9: 2, None: 2, 11: 1, 12: 1, 13: 1, 14: 1}  # id 9 stands for two unlike texts


def test_one_row_of_each_component(spark):
    import corpus_pipeline

    rng = random.Random(31)
    a, b, c, d, e, f = (" ".join(f"w{rng.randrange(5000)}" for _ in range(60)) for _ in range(6))
    rows = [
        (1, a, "x"), (2, a + " end", "x"), (2, b, "x"), (3, c, "y"), (3, c, "x"), (3, d, "x"),  # a copy and a clean text under one id; one id, two texts
        (None, a, "x"), (None, e, "x"), (None, e + " end", "x"), (None, f, "x"), (None, f, "y"), (None, None, "x"), (None, "", "x"), (4, " \t\n\x0b\x0c\r", "x"), (4, "\u00a0", "x"),
    ]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(5)
    got = [tuple(r) for r in corpus_pipeline.drop_near_duplicates(spark, df, "").collect()]
    assert sorted(map(str, got)) in [sorted(map(str, [(1, a, "x"), (2, b, "x"), (3, c, "x"), (3, d, "x"), (None, x, "x"), (None, f, "x"), *rows[-4:]])) for x in (e, e + " end")]


def test_sets_and_packing_of_hashes():
    texts = ["a b c d e f", "A b  c\td e\nf", "a b", "a b c", None, "", "é ü a b c d"]
    sets = dict(textbytes.shingle_sets(pa.array(texts)))
    assert [len(sets[i]) for i in range(7)] == [2, 2, 1, 1, 0, 0, 2] and sets[0].tolist() == sets[1].tolist() and sets[2][0] != sets[3][0]
    values = np.unique(np.random.default_rng(1).integers(0, 2**63, 1000).astype(np.uint64) * np.uint64(2))
    assert textbytes.unpack_sorted(textbytes.pack_sorted(values)).tolist() == values.tolist()
    assert textbytes.unpack_sorted(textbytes.pack_sorted(values[:0])).tolist() == []


def test_components_of_paths_and_stars(spark):
    edges = [(i, i + 1) for i in range(0, 60)] + [(100, x) for x in range(101, 140)] + [(500, 499), (499, 500)]
    got = {r.node: r.label for r in connected_components(spark.createDataFrame(edges, "a long, b long"), Staging(spark, "test")).collect()}
    assert got == {**{i: 0 for i in range(61)}, **{i: 100 for i in range(100, 140)}, 499: 499, 500: 499}


def test_pipeline_on_edges(spark, tmp_path):
    import corpus_pipeline

    folder = f"file://{tmp_path}"
    odd_docs(spark).write.parquet(f"{folder}/documents.parquet")
    labels(spark).write.parquet(f"{folder}/labels.parquet")
    rows = corpus_pipeline.run(spark, folder).collect()
    assert all(r.length <= 1024 for r in rows)
    docs = odd_docs(spark)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, folder)
        assert docs.columns == odd_docs(spark).columns


def test_digest_of_query_four(spark):
    row = next(r for r in QUERIES["op4_format_chat"](spark, FOLDER).collect() if r.conv_id == -7)
    said = r"\### Assistant: </turn> ok"
    assert row.loss_sha256 == hashlib.sha256(said.encode()).hexdigest() and row.loss_chars == len(said) and row.n_turns == 2
    assert row.turns_sha256 == hashlib.sha256(f"user\n{said}\nassistant\n{said}\n".encode()).hexdigest()
