"""More edge cases: ids beside nulls, clashing column names, whole tables against the general engines, exact totals."""

import collections
import os
import random

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from versemill.llm import chat, mixing, ngram_join, packing, quality_classifier, quality_rules, topk
from versemill.llm.queries import tokenizer_path
from versemill.llm.staging import Staging

from .test_ops_small import WORD, brute_components

FOLDER = "/root/testdata/sf0.01"
PROSE = "doc_id long, text string"


# 1


def test_mix_takes_rows_with_any_names(spark):
    names = ("_row", "copies", "at", "size", "_source", "nth", "row", "taken")
    docs = spark.createDataFrame([(i, "a b " * (i % 7), f"s{i % 3}", *["42"] * 8) for i in range(90)] + [(None, None, None, *["42"] * 8)] * 2, PROSE + ", source string, " + ", ".join(f"{n} string" for n in names))
    mixed, plan = mixing.mix_documents(docs), mixing.plan_mix(docs).collect()
    assert mixed.columns == docs.columns and {tuple(r)[3:] for r in mixed.collect()} == {("42",) * 8}
    want = collections.Counter({r.doc_id: r.copies for r in plan if r.doc_id is not None and r.copies})
    assert collections.Counter(r.doc_id for r in mixed.collect() if r.doc_id is not None) == want


# 2


def test_topk_ignores_other_columns(spark):
    rows = [(i, [float(i % 7), 1.0], "x", 1.0) for i in range(101)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, vector string, score double")
    assert topk.top_k(df, F.col("vec_id") % 50 == 0).count() == 15


# 3


def test_packing_keeps_ids_beside_nulls(spark):
    ids = [(1 << 60) + 1, None, -(1 << 62) - 1, (1 << 53) + 1, (1 << 60) + 1]
    docs = spark.createDataFrame([(i, "some words here", "a", 1) for i in ids], PROSE + ", bin string, grp int").coalesce(1)
    for options in ({}, {"group_pieces": 2, "fan_in": 2}):
        rows = packing.pack_documents(docs, tokenizer_path(), **options).collect()
        assert collections.Counter(r.doc_id for r in rows) == collections.Counter(ids)


def test_encoder_on_a_whole_table_and_random_strings():
    import tokenizers

    with open(tokenizer_path(), encoding="utf-8") as f:
        content = f.read()
    encode, general = packing.Encoder(content), tokenizers.Tokenizer.from_str(content)
    general.encode_special_tokens = True
    rng = random.Random(5)
    pool = [chr(c) for c in (*range(0, 0x250), *range(0x4E00, 0x4E40), 0x1F642, 0x200D, 0xFEFF, 0x301, 0x2028, 0x3000, 0x85, 0xA0)] + [" ", " ", "  ", "\n", "'s", "'LL", "1", "<|endoftext|>"]
    strings = ["".join(rng.choice(pool) for _ in range(rng.randrange(1, 60))) for _ in range(3000)]
    texts = pq.read_table(f"{FOLDER}/documents.parquet").column("text").to_pylist() + strings
    for text, found in zip(texts, general.encode_batch(texts, add_special_tokens=False)):
        assert encode(text).tolist() == found.ids


@pytest.mark.parametrize("group_pieces,extra", [(150, 0.035), (1500, 0.01)])
def test_tree_merge_is_near_one_best_fit(spark, group_pieces, extra):
    rng = random.Random(6)
    lengths = [rng.choice((rng.randrange(1, 1025), rng.randrange(400, 700))) for _ in range(6000)]
    pieces = spark.createDataFrame([(i, 0, 0, n, 0) for i, n in enumerate(lengths)], packing.PIECES)
    rows = packing.pack_pieces(pieces, Staging(spark, "test"), group_pieces=group_pieces, fan_in=3).collect()
    alone = len(packing.best_fit(sorted(lengths, reverse=True), 1024)[2])
    assert sorted(r.doc_id for r in rows) == list(range(6000))
    fill = collections.Counter()
    for r in rows:
        fill[r.sequence_id] += r.length
    # No two bins of half a sequence are left; bins over half stay as their group packed them, which small groups do less tightly.
    assert sum(2 * f <= 1024 for f in fill.values()) <= 1 and len(fill) <= alone * (1 + extra)
    places = collections.defaultdict(list)
    for r in rows:
        places[r.sequence_id].append((r.offset, r.length))
    assert all(sum(n for _, n in sorted(p)[:k]) == sorted(p)[k][0] for p in places.values() for k in range(len(p)))


# 4


def test_chat_edges(spark):
    names = "tree string, node long, parent long, score double, role string, text string, depth int, rank string"
    rows = [("t", 1, None, 1.0, "user", "first", 1, "x"), ("t", 1, None, 1.0, "user", "first again", 1, "x"), ("t", 2, 1, None, "assistant", "y" * 400_000 + "</turn>", 1, "x"), ("t", 2, 1, 5.0, "assistant", "other", 1, "x"), ("t", None, 1, 0.0, "user", None, 1, "x"), (None, 5, None, None, None, None, 1, "x")]
    out = chat.format_paths(spark.createDataFrame(rows, names), paths_per_tree=9).select("tree", "rank", "path_score", chat.read_turns(F.col("formatted")).alias("turns")).collect()
    told = {(r.tree, r["rank"]): [t.text for t in r.turns] for r in out}
    assert told == {(None, 1): [""], ("t", 1): ["first", "y" * 400_000 + "</turn>"]}


# 7


def test_grades_may_be_negative_and_ids_repeated(spark):
    rng = random.Random(23)
    docs, marks = [], []
    for i in range(300):
        grade = (-2, 0, 5)[i % 3]
        docs.append((i, " ".join(rng.choices(["zzq", "abc"], [1 + grade + 3, 9 - grade], k=60)), "x"))
        marks.append((i, grade, 0))
    table = spark.createDataFrame(docs + docs[:40] + [(None, "zzq", "x"), (1, None, "y")], PROSE + ", level string")
    known = spark.createDataFrame(marks + marks[:5] + [(7, None, 0), (None, 5, 1)], "doc_id long, quality int, toxic int")
    model = quality_classifier.fit(table, known)
    assert model.levels == [-2, 0, 5]
    scored = quality_classifier.grade_documents(table, known, least_grade=5).collect()
    assert len(scored) == table.count() and all(-2 <= r.expected_grade <= 5 for r in scored)
    right = [r.kept == (r.doc_id % 3 == 2) for r in scored if r.doc_id is not None and r.doc_id > 1]
    assert sum(right) >= 0.95 * len(right)
    assert all(r.kept for r in quality_classifier.grade_documents(table, known, least_grade=-2).collect())
    assert not any(r.kept for r in quality_classifier.grade_documents(table, known, least_grade=6).collect())
    with pytest.raises(ValueError):
        quality_classifier.fit(table, known.withColumn("quality", F.col("doc_id").cast("int")))


def test_ties_in_the_sample_order(spark):
    docs = spark.createDataFrame([(i, f"{'good' if i % 2 else 'bad'} text {i}", "x") for i in range(60)] * 2, PROSE + ", x string")
    known = spark.createDataFrame([(i, i % 2, 0) for i in range(60)] * 3, "doc_id long, quality int, toxic int")
    one, two = (quality_classifier.fit(d, known, sample_rows=20) for d in (docs, docs.repartition(7)))
    assert np.allclose(one.weights, two.weights) and np.allclose(one.thresholds, two.thresholds)


def plain_features(text):
    """Shares of hashed byte triples and of repeated words, word by word."""
    low = (text or "").encode().translate(bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256)))
    triples = [(((low[i] << 16 | low[i + 1] << 8 | low[i + 2]) * 2654435761) & 0xFFFFFFFF) >> 19 for i in range(len(low) - 2)]
    words = WORD.findall(low.decode())
    same = sum(a == b for a, b in zip(words, words[1:])) / max(1, len(words))
    again = (len(words) - len(set(words))) / max(1, len(words))
    return {k: n / len(triples) for k, n in collections.Counter(triples).items()} | {quality_classifier.REPEAT_BEFORE: same, quality_classifier.REPEAT_ANY: again} if triples else {}


def test_features_against_plain_ones():
    texts = ["The cat the CAT the", "", None, "ab", "a a a b", "naïve Ünïcode\tnaïve\n漢字 漢字", "x" * 5000, " \n\t "]
    for text, (numbers, shares) in zip(texts, quality_classifier.text_features(pa.array(texts))):
        want = plain_features(text)
        assert sorted(numbers.tolist()) == sorted(want) and all(abs(want[n] - s) < 1e-9 for n, s in zip(numbers.tolist(), shares))


def test_the_fit_is_the_best_there_is():
    """Against brute force: no small change of weights or thresholds is more likely."""
    rng = np.random.default_rng(31)
    n, grade = 400, rng.integers(0, 3, 400)
    values = np.c_[rng.normal(grade, 1.5), rng.normal(0, 1, 400)]
    rows, ridge = np.arange(n + 1) * 2, 1e-3
    w, cuts = quality_classifier.fit_ordinal(np.tile([5, 9], n).astype(np.int32), values.ravel(), rows, grade, np.ones(n), rounds=3000, rate=0.02, ridge=ridge, least_gain=0.0)

    def likelihood(a, b, c1, c2):
        above = np.c_[np.ones(n), *(1 / (1 + np.exp(c - values @ [a, b])) for c in (c1, c2)), np.zeros(n)]
        return np.log(above[np.arange(n), grade] - above[np.arange(n), grade + 1]).mean() - ridge / 2 * (a * a + b * b)

    found = np.array([w[5], w[9], *cuts])
    best = likelihood(*found)
    assert np.count_nonzero(w) == 2 and w[5] > 0.3
    for _ in range(300):
        assert likelihood(*(found + rng.normal(0, 0.05, 4))) <= best + 1e-4


# 9


def test_a_repeated_document_is_one_trial(spark):
    rng = random.Random(19)
    words = lambda n: [f"w{rng.randrange(10_000)}" for _ in range(n)]
    text = lambda symbols: " ".join(words(80) + ["#$"] * symbols)
    good, bad = [(i, text(rng.choice((0, 0, 1))), "en") for i in range(20)], [(100 + i, text(30), "en") for i in range(20)]
    marks = [(i, 1, 0) for i, _, _ in good] + [(i, 0, 0) for i, _, _ in bad]
    docs = spark.createDataFrame(good + bad, PROSE + ", lang string")
    many = docs.unionByName(docs.filter("doc_id = 0").crossJoin(spark.range(5000)).drop("id")).unionByName(docs.filter("doc_id = 1").crossJoin(spark.range(5000)).select((F.col("id") + 10_000).alias("doc_id"), "text", "lang"))
    known = spark.createDataFrame(marks, "doc_id long, quality int, toxic int")
    more = known.unionByName(spark.range(5000).select((F.col("id") + 10_000).alias("doc_id"), F.lit(1).alias("quality"), F.lit(0).alias("toxic")))
    cut = lambda d, k: quality_rules.fit_cutoffs(quality_rules.with_stats(d), k).collect()
    assert cut(docs, known) == cut(many, more) == []  # 20 good documents certify nothing
    judged = quality_rules.apply_rules(many, more)
    assert judged.count() == 10_040 and "_digest" not in judged.columns


# 10


def test_large_groups_and_hot_passages(spark):
    """A group of near copies and a passage that many unlike documents hold, both larger than a tile."""
    rng = random.Random(29)
    words = lambda n: [f"w{rng.randrange(3000)}" for _ in range(n)]
    base, passage, rows = words(60), words(40), []
    for _ in range(150):
        w = list(base)
        for _ in range(rng.randrange(0, 5)):
            w[rng.randrange(60)] = f"x{rng.randrange(50)}"
        rows.append((len(rows), " ".join(w)))
    for _ in range(150):
        rows.append((len(rows), " ".join(passage + words(rng.randrange(0, 14)))))
    rows += [(1000 + i, rows[i % 5][1]) for i in range(40)]
    df = spark.createDataFrame(rows, PROSE).repartition(6)
    want = sorted(brute_components(rows))
    for options in ({}, {"tile": 8, "frequent": 4, "block_tokens": 3000, "range_tokens": 2000}, {"tile": 3, "tile_tokens": 300, "frequent": 2}):
        assert sorted(map(tuple, ngram_join.jaccard_components(df, **options).collect())) == want


def test_helper_names_may_clash(spark):
    names = ("_key", "_nth", "row", "nth", "text_key", "id", "no_id", "_row")
    text = " ".join(f"w{i}" for i in range(40))
    docs = spark.createDataFrame([(1, text, *["42"] * 8), (2, text, *["42"] * 8), (3, "other " + text[::-1], *["43"] * 8)], PROSE + ", " + ", ".join(f"{n} string" for n in names))
    kept = ngram_join.one_of_each(docs)
    assert kept.columns == docs.columns and sorted(tuple(r)[2:] for r in kept.collect()) == [("42",) * 8, ("43",) * 8]
    assert ngram_join.jaccard_components(docs).count() == 3


# Pipeline


def test_pipeline_stages_against_plain_ones(spark):
    """Each stage on what the one before kept, held against single verdicts, all pairs, the plan and the tokens."""
    import corpus_pipeline

    folder = "/root/testdata/sf0.001"
    docs, known = spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet")
    staging = Staging(spark, "test")
    kept = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        kept[name] = staging.write(stage(spark, docs if not kept else kept[last], folder), name)
        last = name
    ids = {n: sorted(r.doc_id for r in d.select("doc_id").collect()) for n, d in kept.items()}
    graded = {r.doc_id for r in quality_classifier.grade_documents(docs, known).collect() if r.kept}
    assert set(ids["quality_classifier"]) == graded and 0 < len(graded) < docs.count()
    ruled = {r.doc_id for r in quality_rules.apply_rules(kept["quality_classifier"], known).collect() if r.kept}
    assert set(ids["quality_rules"]) == ruled
    rows = [(r.doc_id, r.text) for r in kept["quality_rules"].collect()]
    assert ids["ngram_join"] == sorted({c for _, _, c in brute_components(rows)})
    copies = collections.Counter({r.doc_id: r.copies for r in mixing.plan_mix(kept["ngram_join"]).collect() if r.copies})
    assert collections.Counter(ids["mix_sources"]) == copies
    encode = packing.Encoder(open(tokenizer_path(), encoding="utf-8").read())
    packed = corpus_pipeline.STAGES[-1][1](spark, kept["mix_sources"], folder).collect()
    tokens = sum(len(encode(r.text)) + 1 for r in kept["mix_sources"].collect())
    alone = len(packing.best_fit(sorted((r.length for r in packed), reverse=True), 1024)[2])
    assert sum(r.length for r in packed) == tokens and len({r.sequence_id for r in packed}) == alone


# Staging


def test_staging_keeps_only_what_is_read(spark, tmp_path):
    staging = Staging(spark, "test")
    one, two = (staging.write(spark.range(3).withColumn("x", F.lit(k)), "t") for k in range(2))
    staging.keep(two, None)
    assert two.count() == 3 and [p.rsplit("/", 1)[-1][:3] for p in staging.paths] == ["000", "001"]
    assert sorted(os.listdir(staging.root.removeprefix("file://"))) == ["001-t"]
