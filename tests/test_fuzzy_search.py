"""Fuzzy search over whole corpora: bounds lose nothing, and results equal all pairs."""

import random

import numpy as np
from pyspark.sql import functions as F

from versemill.functions.fuzzy import partial_ratio
from versemill.operators import fuzzy_search as S
from versemill.operators import gaps as G
from versemill.operators import joins as J


def test_bounds_and_ratios_against_the_plain_ratio():
    rng = random.Random(1)
    for _ in range(60):
        letters = "abcdé "[: rng.choice([2, 4, 6])]
        text = lambda most: "".join(rng.choice(letters) for _ in range(rng.randrange(1, most)))
        asked = S.Questions([text(rng.choice([5, 20, 90])) for _ in range(rng.randrange(1, 5))])
        lines = S.Lines([text(rng.choice([4, 30, 200, 400])) for _ in range(12)], asked)
        for q, bound in lines.bounds_by_pairs(0, len(asked.texts)):
            plain = np.array([partial_ratio(asked.texts[q], t) for t in lines.texts])
            assert np.allclose(lines.ratios(q, np.arange(len(plain))), plain, atol=1e-9)
            top = np.zeros(len(plain))
            np.maximum.at(top, lines.line, bound)
            assert (top >= plain - 1e-6).all()
            long = np.flatnonzero(lines.sizes[lines.line] >= asked.sizes[q])
            top = np.zeros(len(plain))
            np.maximum.at(top, lines.line[long], lines.bounds_by_letters(q, long) if len(long) else 0)
            assert (top >= plain - 1e-6)[lines.sizes >= asked.sizes[q]].all()


def test_questions_of_one_word_lose_nothing():
    """Lines and questions of 1 to 64 characters and more, the whole width of a word, ends of lines, low and high bars."""
    rng = random.Random(3)
    for _ in range(40):
        letters = "abcdé "[: rng.choice([2, 4, 6])]
        text = lambda most: "".join(rng.choice(letters) for _ in range(rng.randrange(1, most + 1)))
        lines = [text(rng.choice([1, 4, 30, 64, 200])) for _ in range(14)] + ["x" * 70, "ab" * 32]
        texts = [text(rng.choice([1, 5, 20, 64])) for _ in range(6)] + ["ba" * 32, lines[0][:64], "zq"]
        asked = S.WordQuestions(texts)
        plain = np.array([[partial_ratio(q, t) for t in lines] for q in texts])
        bars = np.array([rng.choice([1.0, 50.0, 70.0, 90.0, top, 100.0]) for top in plain.max(axis=1)])
        found = np.zeros_like(plain)
        for ask, line, score in S.WordLines(lines, asked).reaching(bars):
            np.maximum.at(found, (ask, line), score)
        reached = plain >= bars[:, None]
        assert (found[reached] == plain[reached]).all() and (found <= plain).all()
        assert (S.WordLines(lines, asked).seeds() <= plain.max(axis=1)).all()


def test_few_lines_are_verified_where_the_best_line_lost_a_word(spark):
    """Prose of few syllables, as long as the documents': pairs of letters tell little, so a tenth of the lines used to be verified."""
    rng = random.Random(4)
    parts = ["th", "er", "on", "an", "re", "he", "in", "ed", "nd", "ha", "at", "en", "or", "ti", "st", "ble", "ing", "and", "the", "that"]
    words = lambda n: " ".join("".join(rng.choice(parts) for _ in range(rng.randrange(1, 5))) for _ in range(n))
    lines = [words(rng.randrange(20, 60)) for _ in range(400)]
    asked = [(i, " ".join(lines[i].split(" ")[:3]) + "  " + " ".join(lines[i].split(" ")[4:8])) for i in range(0, 400, 10)]
    found = S.best_lines(spark.createDataFrame(asked, "ask_id long, text string"), spark.createDataFrame(list(enumerate(lines)), "line_id long, text string").coalesce(1)).collect()
    assert [r.ask_id for r in sorted(found)] == [r.line_id for r in sorted(found)] == list(range(0, 400, 10))
    assert sum(r.verified for r in found) < 0.02 * len(lines) * len(found)


def corpus(rng, n):
    words = ["".join(rng.choice("abcdefghilmnoprstuv") for _ in range(rng.randrange(2, 9))) for _ in range(300)]
    return [" ".join(rng.choice(words) for _ in range(rng.randrange(1, 20))) for _ in range(n)]


def test_search_equals_all_pairs(spark, monkeypatch):
    """Ties, repeated lines, nulls, empty texts and several blocks; where the best line is good, few lines are verified."""
    rng = random.Random(2)
    lines = corpus(rng, 400)
    lines += [lines[3], None, "", lines[5].upper()]
    asked = []
    for i in range(0, 60, 5):
        w = lines[i].split(" ")
        asked.append((i, " ".join(w[: len(w) // 2] + w[len(w) // 2 + 1 :])))
    asked += [(100, None), (101, ""), (102, "zzzz qqqq"), (103, lines[3]), (104, "x" * 70 + lines[7])]
    monkeypatch.setattr(S, "BLOCK", 7)
    a = spark.createDataFrame(asked, "ask_id long, text string")
    b = spark.createDataFrame(list(enumerate(lines)), "line_id long, text string").repartition(3)
    found = {r.ask_id: r for r in S.best_lines(a, b).collect()}
    expected = {}
    for q, text in asked:
        score, line = max(((partial_ratio(text, t), -i) for i, t in enumerate(lines)), default=(0, 0))
        if score >= 70:
            expected[q] = (-line, round(score, 6))
    assert {q: (r.line_id, round(r.score, 6)) for q, r in found.items()} == expected
    assert all(r.met == 402 and r.verified >= 1 for r in found.values())
    assert found[103].line_id == 3 and found[103].score == 100
    assert sum(r.verified for r in found.values()) < 0.6 * 402 * len(found)
    assert S.best_lines(a.limit(0), b).collect() == [] and S.best_lines(a, b.limit(0)).collect() == []


def test_corpus_search_meets_every_line(spark):
    from versemill.plans.registry import Tables
    from versemill.plans.relational_queries import corpus_lines, lost_words

    t = Tables(spark, "/root/testdata/sf0.001")
    asked, clean = lost_words(t)
    asked = asked.filter("ask_id < 6")
    lines = clean.select((-F.col("line_id") - 1).alias("line_id"), "text").unionByName(corpus_lines(t).filter("line_id % 1900000 < 300000"))
    plain = [(r.line_id, r.text) for r in lines.collect() if r.text]
    for r in S.best_lines(asked, lines).join(asked, "ask_id").collect():
        score, line = max((S.Lines([t], S.Questions([r.text])).ratios(0, np.array([0]))[0], -i) for i, t in plain)
        assert (r.line_id, round(r.score, 6)) == (-line, round(score, 6))


def test_candidates_above_the_bound_are_none(spark):
    lines = spark.createDataFrame([(i, "the quick brown fox") for i in range(600)] + [(600, "lazy brown dog")], "line_id long, text string")
    asked = spark.createDataFrame([(1, "quick brown fox"), (2, "lazy dog")], "ask_id long, text string")
    assert [tuple(r) for r in J.line_candidates(asked, lines).collect()] == [(2, 600, 2)]
    assert J.line_candidates(asked, lines, most=None).filter("ask_id = 1").count() == 600


def test_cascade_takes_the_first_pass(spark):
    gaps = spark.createDataFrame([(i,) for i in range(4)], "gap_id long")
    fills = lambda *rows: spark.createDataFrame([*rows], "gap_id long, fill string")
    found = G.cascade(gaps, [("a", fills((0, "x"))), ("b", fills((0, "y"), (1, "z"))), ("c", fills((2, "w")))]).collect()
    assert sorted(map(tuple, found)) == [(0, "x", "a"), (1, "z", "b"), (2, "w", "c")]
