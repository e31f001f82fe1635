"""Quality classifier: ordinal regression with cumulative links on hashed text.

A document's features are the shares of its hashed byte triples, and the shares of its words that repeat the word before
or a word of the same text (in reserved places). One set of weights gives a document one number; ordered thresholds cut
that number into grades: P(grade >= j) = sigmoid(number - threshold_j). From these follow the expected grade and the tail
probability by which documents are selected.

The fit uses a bounded sample of labelled documents: of each grade an equal part of ``sample_rows``, those that come first
by the hash of their id, whole texts, weighted back to how often the grade occurs among all labels. At most ``sample_rows``
x ``DIMS`` numbers of six bytes reach the driver. Everything else covers all rows.

Defined results: null and empty texts have no features and get the number 0; grades are any whole numbers, negative ones
too, of which at most ``most_grades`` may differ (more are an error); a document with several label rows has its lowest
grade; an id with several texts is fitted on the smallest; without at least two grades among the labels every tail is 1;
repeated rows get equal scores; extra columns pass through ``keep_documents``.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .staging import Staging
from .textbytes import _LOWER, release, slices, word_hashes, words

DIMS = 1 << 13
REPEAT_BEFORE, REPEAT_ANY = DIMS, DIMS + 1
WIDTH = DIMS + 2


def _triples(data: np.ndarray) -> np.ndarray:
    low = _LOWER[data].astype(np.uint32)
    triple = np.zeros(len(low), np.uint32)
    triple[2:] = low[:-2] << 16 | low[1:-1] << 8 | low[2:]
    return ((triple * np.uint32(2654435761)) >> np.uint32(19)).astype(np.int32)


def _repeats(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """(rows, 2): the share of words equal to the word before, and of words that stand in the text before them."""
    low = _LOWER[data]
    start, end, row = words(low, offsets)
    hashes = word_hashes(low, start, end)
    rows, out = len(offsets) - 1, np.zeros((len(offsets) - 1, 2))
    if len(start):
        total = np.maximum(np.bincount(row, minlength=rows), 1)
        same = (hashes[1:] == hashes[:-1]) & (row[1:] == row[:-1])
        out[:, 0] = np.bincount(row[1:][same], minlength=rows) / total
        order = np.lexsort((hashes, row))
        again = (hashes[order][1:] == hashes[order][:-1]) & (row[order][1:] == row[order][:-1])
        out[:, 1] = np.bincount(row[order][1:][again], minlength=rows) / total
    return out


def text_features(column: pa.Array):
    """For each text in turn: (feature numbers, shares)."""
    for _, data, offsets in slices(column):
        triple, repeats = _triples(data), _repeats(data, offsets)
        for i in range(len(offsets) - 1):
            own = triple[offsets[i] + 2 : offsets[i + 1]]
            if len(own):
                numbers, counts = np.unique(own, return_counts=True)
                yield np.r_[numbers, REPEAT_BEFORE, REPEAT_ANY].astype(np.int32), np.r_[counts / len(own), repeats[i]]
            else:
                yield np.zeros(0, np.int32), np.zeros(0)


def text_numbers(weights: np.ndarray, column: pa.Array) -> np.ndarray:
    """The weighted sum of each text's features, without making them one by one."""
    out = np.zeros(len(column))
    for first, data, offsets in slices(column):
        run = np.zeros(len(data) + 1)
        np.cumsum(weights[_triples(data)], out=run[1:])
        n = np.diff(offsets)
        full = n > 2
        begin = offsets[:-1][full] + 2
        part = np.zeros(len(n))
        part[full] = (run[offsets[1:][full]] - run[begin]) / (n[full] - 2) + _repeats(data, offsets)[full] @ weights[DIMS:]
        out[first : first + len(n)] = part
    return out


def fit_ordinal(numbers: np.ndarray, shares: np.ndarray, rows: np.ndarray, grade: np.ndarray, weight: np.ndarray, *, rounds: int = 300, rate: float = 0.5, ridge: float = 1e-5, least_gain: float = 1e-3) -> tuple[np.ndarray, np.ndarray]:
    """(weights, thresholds) by gradient steps on the ordinal log-likelihood; ``rows`` has where each document's features begin, and the end.

    Ends after ``rounds``, or when twenty rounds gain less than ``least_gain`` of mean log-likelihood.
    """
    levels = int(grade.max())
    w, free = np.zeros(WIDTH), np.r_[0.0, np.zeros(levels - 1)]  # thresholds: the first, then logs of the gaps
    shares, at = shares.astype(np.float32), np.arange(len(grade))
    of = np.repeat(at.astype(np.int32), np.diff(rows))
    by_feature = np.argsort(numbers, kind="stable")
    feature, begins = np.unique(numbers[by_feature], return_index=True)
    of_sorted, shares_sorted = of[by_feature], shares[by_feature]
    there, first = np.flatnonzero(np.diff(rows)), rows[:-1][np.diff(rows) > 0]
    del by_feature, of
    weight = weight / weight.sum()
    moments, best = [np.zeros(WIDTH + levels) for _ in range(2)], -np.inf
    sigmoid = lambda z: 1 / (1 + np.exp(-np.clip(z, -40, 40)))
    for step in range(1, rounds + 1):
        cuts = free[0] + np.r_[0.0, np.cumsum(np.exp(free[1:]))]
        z = np.zeros(len(grade))
        if len(there):
            z[there] = np.add.reduceat(shares * w.astype(np.float32)[numbers], first, dtype=np.float64)
        above = np.c_[np.ones(len(grade)), sigmoid(z[:, None] - cuts), np.zeros(len(grade))]
        p = np.maximum(above[at, grade] - above[at, grade + 1], 1e-12)
        if step % 20 == 0:
            gained, best = weight @ np.log(p) - best, weight @ np.log(p)
            if gained < least_gain:
                break
        slope = above * (1 - above)
        low, high = slope[at, grade], slope[at, grade + 1]
        pull = weight * (low - high) / p
        gradient = -ridge * w
        if len(there):
            gradient[feature] += np.add.reduceat(shares_sorted * pull.astype(np.float32)[of_sorted], begins, dtype=np.float64)
        at_cut = np.array([-(weight * (low / p))[grade == j].sum() + (weight * (high / p))[grade == j - 1].sum() for j in range(1, levels + 1)])
        cut_gradient = np.array([at_cut[k:].sum() * (1.0 if k == 0 else np.exp(free[k])) for k in range(levels)])
        g = np.r_[gradient, cut_gradient]
        moments[0] += 0.1 * (g - moments[0])
        moments[1] += 0.01 * (g * g - moments[1])
        move = rate * (moments[0] / (1 - 0.9**step)) / (np.sqrt(moments[1] / (1 - 0.99**step)) + 1e-9)
        w += move[:WIDTH]
        free += move[WIDTH:] / 10
    return w, free[0] + np.r_[0.0, np.cumsum(np.exp(free[1:]))]


class Model(NamedTuple):
    weights: np.ndarray
    thresholds: np.ndarray
    levels: list[int]  # the grades, from low to high; threshold j parts level j from level j + 1


def fit(docs: DataFrame, labels: DataFrame, *, grade_col: str = "quality", sample_rows: int = 6000, most_grades: int = 64, **options) -> Model | None:
    """The fitted model, or None where the labels don't have two grades."""
    staging = Staging(docs.sparkSession, "quality-classifier")
    graded = labels.filter("doc_id IS NOT NULL").groupBy("doc_id").agg(F.min(F.col(grade_col).cast("int")).alias("grade")).filter("grade IS NOT NULL")
    there = graded.join(docs.filter("doc_id IS NOT NULL").select("doc_id"), "doc_id", "left_semi")
    there = staging.write(there, "grades")
    often = {r[0]: r[1] for r in there.groupBy("grade").count().limit(most_grades + 1).collect()}  # a row for each grade
    if len(often) > most_grades:
        raise ValueError(f"more than {most_grades} grades")
    if len(often) < 2:
        return None
    levels, picks = sorted(often), None
    for level, grade in enumerate(levels):
        some = there.filter(F.col("grade") == grade).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_rows // len(levels)).select("doc_id", F.lit(level).alias("level"))
        picks = some if picks is None else picks.unionByName(some)
    picks = staging.write(picks, "sample")  # at most sample_rows small rows

    def rows(batches):
        for batch in batches:
            found = list(text_features(batch.column("text")))
            numbers, shares = [n.astype("<i2").tobytes() for n, _ in found], [s.astype("<f4").tobytes() for _, s in found]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("level"), pa.array(numbers, pa.binary()), pa.array(shares, pa.binary())], ["doc_id", "level", "numbers", "shares"])

    # One text for each id, the smallest, before features are made and before anything goes to the driver.
    texts = docs.select("doc_id", "text").join(F.broadcast(picks), "doc_id").groupBy("doc_id", "level").agg(F.min("text").alias("text"))
    sample = texts.mapInArrow(rows, "doc_id long, level int, numbers binary, shares binary").toArrow().sort_by("doc_id")
    numbers = [np.frombuffer(b.as_buffer(), "<i2") for b in sample["numbers"]]
    shares = np.concatenate([np.frombuffer(b.as_buffer(), "<f4") for b in sample["shares"]])
    level = sample["level"].to_numpy().astype(np.int64)
    weight = np.array([often[levels[k]] for k in level]) / np.bincount(level)[level]
    bounds = np.r_[0, np.cumsum([len(n) for n in numbers])]
    staging.keep()
    return Model(*fit_ordinal(np.concatenate(numbers).astype(np.int32), shares, bounds, level, weight, **options), levels)


def grades(number: np.ndarray, thresholds: np.ndarray, levels: list[int] | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(expected grade, P(level >= j) for each j from 1); without ``levels`` grades are 0, 1, ..."""
    above = 1 / (1 + np.exp(-np.clip(number[:, None] - thresholds, -40, 40)))
    levels = list(range(above.shape[1] + 1)) if levels is None else levels
    return levels[0] + above @ np.diff(levels), above


def grade_documents(docs: DataFrame, labels: DataFrame, *, least_grade: int = 1, least_tail: float = 0.5, **options) -> DataFrame:
    """(doc_id, expected_grade, tail = P(grade >= least_grade), kept) for every row."""
    model = fit(docs, labels, **options)
    ids = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")

    def score(batches):
        for batch in batches:
            expected, tail = _tails(model, batch.column("text"), least_grade)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(expected), pa.array(tail), pa.array(tail >= least_tail)], ["doc_id", "expected_grade", "tail", "kept"])
        release()

    return ids.mapInArrow(score, "doc_id long, expected_grade double, tail double, kept boolean")


def _tails(model: Model | None, column: pa.Array, least_grade: int) -> tuple[np.ndarray, np.ndarray]:
    if model is None:
        return np.full(len(column), float(least_grade)), np.ones(len(column))
    expected, above = grades(text_numbers(model.weights, column), model.thresholds, model.levels)
    level = int(np.searchsorted(model.levels, least_grade))
    tail = np.ones(len(expected)) if level == 0 else above[:, level - 1] if level < len(model.levels) else np.zeros(len(expected))
    return np.round(expected, 6), np.round(tail, 6)


def keep_documents(docs: DataFrame, labels: DataFrame, *, least_grade: int = 1, least_tail: float = 0.5, **options) -> DataFrame:
    """The rows of ``docs`` whose tail probability is ``least_tail`` or more, in one pass, without a shuffle."""
    model = fit(docs, labels, **options)

    def keep(batches):
        for batch in batches:
            yield batch.filter(pa.array(_tails(model, batch.column("text"), least_grade)[1] >= least_tail))
        release()

    return docs.mapInArrow(keep, docs.schema)
