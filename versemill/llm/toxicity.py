"""Toxicity scores from two class-conditional Kneser-Ney models over letter sequences.

Texts are read as symbols (26 letters, blank, digit, other ASCII, three for bytes of other letters), so five symbols are a
number below 2^25, and a model is bounded by that whatever the corpus. Counts of all labelled training texts are gathered by
class. A class gives symbol w after context h the probability

    max(c(hw) - D, 0) / c(h) + D * kinds(h) / c(h) * shared(w | h without its first symbol)

whose backoff is one Kneser-Ney model of continuation counts for both classes: where neither class has evidence the two
agree exactly, so rare expressions count for nothing. What is compared is the log-likelihood ratio of the classes,
normalised by length over the whole text, and over its most toxic words (each a stretch of its own), since an insult in a
long text is lost in the mean. A logistic curve on these gives the score. It is fitted on a share of the training texts,
seen through models that lack the counts of that share; the models that score have the counts of all.

Defined results: null, empty and wordless texts have ratio 0 everywhere and get the curve's value there; a document with
several label rows counts as toxic if any says so; repeated rows get equal scores; without labels of both classes every
score is 0; extra columns are ignored. Scores depend on the text alone.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .staging import Staging, deal
from .textbytes import release, slices

ORDER, BITS = 5, 5
CELLS = 1 << (ORDER * BITS)
STEP = 1 / 12  # of a log ratio, as kept in one signed byte
BLANK = 0
_SYMBOL = np.full(256, 28, np.uint8)  # other ASCII
_SYMBOL[[0x20, *range(0x09, 0x0E)]] = BLANK
_SYMBOL[ord("a") : ord("z") + 1] = _SYMBOL[ord("A") : ord("Z") + 1] = np.arange(1, 27)
_SYMBOL[ord("0") : ord("9") + 1] = 27
_SYMBOL[0xC0:] = 29  # lead bytes
_SYMBOL[0x80:0xA0], _SYMBOL[0xA0:0xC0] = 30, 31


def codes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(symbols, the code of the five symbols that end at each place); before a text stand blanks."""
    s = _SYMBOL[data]
    code = np.zeros(len(s), np.int32)
    for back in range(ORDER - 1, -1, -1):
        code[back:] |= s[: len(s) - back].astype(np.int32) << (BITS * back)
    for k in range(ORDER - 1):  # what reaches back into the text before is cut off; a blank is 0
        code[offsets[:-1][np.diff(offsets) > k] + k] &= (1 << (BITS * (k + 1))) - 1
    return s, code


KINDS = ("ordinary", "toxic", "curve_ordinary", "curve_toxic")


def _count(batches):
    """(code, a count for each of ``KINDS``) of rows (text, kind: a place in ``KINDS``)."""
    held: list[tuple[np.ndarray, ...]] = []

    def merged(parts):
        kinds, where = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
        return kinds, *(np.bincount(where, np.concatenate([p[k + 1] for p in parts]), len(kinds)).astype(np.int64) for k in range(len(KINDS)))

    for batch in batches:
        kind = np.asarray(batch.column("kind"))
        for first, data, offsets in slices(batch.column("text")):
            if len(data):
                _, code = codes(data, offsets)
                own = np.repeat(kind[first : first + len(offsets) - 1], np.diff(offsets))
                kinds, where = np.unique(code, return_inverse=True)
                counts = np.bincount(where * len(KINDS) + own, minlength=len(kinds) * len(KINDS)).reshape(-1, len(KINDS))
                held.append((kinds, *counts.T))
                if len(held) == 32:
                    held = [merged(held)]
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(merged(held), (pa.int32(), *[pa.int64()] * len(KINDS)))], ["code", *KINDS])
    release()


def _runs(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(distinct keys, the number of each entry's key)."""
    return np.unique(keys, return_inverse=True)


SUFFIX = (1 << (BITS * (ORDER - 1))) - 1  # of a code: its symbols but for the first
PART = BITS * (ORDER - 1)  # a part of the table: the cells that share their first symbol


def backoff_table(suffixes: np.ndarray, kinds_before: np.ndarray, discount: float) -> np.ndarray:
    """P(last symbol | the three before it) by suffix, 0 where none was seen.

    ``suffixes`` are those of all codes, sorted, ``kinds_before`` how many symbols stand before each; lower orders follow from these.
    """
    below, kinds = None, {ORDER - 1: suffixes}
    for order in range(ORDER - 2, 0, -1):
        kinds[order] = np.unique(kinds[order + 1] & ((1 << (BITS * order)) - 1))
    for order in range(1, ORDER):
        here = kinds[order]
        if order == ORDER - 1:
            count = kinds_before.astype(float)
        else:
            count = np.bincount(_runs(kinds[order + 1] & ((1 << (BITS * order)) - 1))[1], minlength=len(here)).astype(float)  # distinct symbols before it
        _, context = _runs(here >> BITS)
        total, follow = np.bincount(context, count), np.bincount(context)
        lower = 1 / (1 << BITS) if below is None else below[np.searchsorted(kinds[order - 1], here & ((1 << (BITS * (order - 1))) - 1))]
        below = (np.maximum(count - discount, 0) + discount * follow[context] * lower) / total[context]
    table = np.zeros(SUFFIX + 1, np.float32)
    table[suffixes] = below
    return table


def class_logs(code: np.ndarray, count: np.ndarray, backoff: np.ndarray, discount: float) -> tuple[np.ndarray, np.ndarray]:
    """(log P of each code's last symbol after its context, log of the weight that its context gives the backoff)."""
    contexts, at = _runs(code >> BITS)
    total, kinds = np.bincount(at, count, len(contexts)), np.bincount(at, count > 0, len(contexts))
    weight = np.where(total > 0, discount * kinds / np.maximum(total, 1), 1.0)
    return np.log(np.maximum(count - discount, 0) / np.maximum(total, 1)[at] + weight[at] * backoff[code & SUFFIX]), np.log(weight)


def ratio_part(code: np.ndarray, toxic: np.ndarray, ordinary: np.ndarray, backoff: np.ndarray, discount: float) -> np.ndarray:
    """log P(w | h, toxic) - log P(w | h, ordinary) of one part's cells, in steps; contexts without evidence have 0."""
    (one, alone_one), (two, alone_two) = (class_logs(code, count, backoff, discount) for count in (toxic, ordinary))
    steps = lambda x: np.clip(np.rint(x / STEP), -127, 127).astype(np.int8)
    table = np.zeros((1 << (PART - BITS), 1 << BITS), np.int8)
    inside = code & ((1 << PART) - 1)
    table[np.unique(inside >> BITS)] = steps(alone_one - alone_two)[:, None]
    table = table.ravel()
    table[inside] = steps(one - two)
    return table


def ratio_table(counts: DataFrame, staging: Staging, discount: float) -> np.ndarray:
    """The ratios of all cells, one byte each. ``counts``: (code, toxic, ordinary), a row for each code.

    Only a row for each suffix (2^20 at most, 16 MB) and the finished bytes (32 MB) reach the driver; parts are made where the counts are.
    """
    table = np.zeros(CELLS, np.int8)
    counts = staging.write(counts, "counts")
    totals = counts.agg(F.sum("toxic"), F.sum("ordinary")).first()
    if not (totals[0] and totals[1]):
        return table
    known = counts.groupBy(F.col("code").bitwiseAND(SUFFIX).alias("suffix")).agg(F.count("*").cast("int").alias("kinds")).toArrow().sort_by("suffix")
    backoff = counts.sparkSession.sparkContext.broadcast(backoff_table(known["suffix"].to_numpy(), known["kinds"].to_numpy(), discount))  # 4 MB
    del known

    def part(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("code")
        code = rows["code"].to_numpy()
        steps = ratio_part(code, rows["toxic"].to_numpy(), rows["ordinary"].to_numpy(), backoff.value, discount)
        return pa.table({"part": pa.array([code[0] >> PART], pa.int32()), "steps": pa.array([zlib.compress(steps.tobytes(), 1)], pa.binary())})

    parts = deal(counts.withColumn("part", F.shiftright("code", PART)), CELLS >> PART, "part", numbered=True)
    for row in parts.applyInArrow(part, "part int, steps binary").collect():  # 32 rows of a megabyte at most
        table[row.part << PART : (row.part + 1) << PART] = np.frombuffer(zlib.decompress(row.steps), np.int8)
    return table


FEATURES = ("mean", "first", "second", "third")


def text_features(table: np.ndarray, column: pa.Array) -> np.ndarray:
    """A row for each text: mean ratio by symbol, and the three largest ratios of single words."""
    out = np.zeros((len(column), len(FEATURES)))
    for first, data, offsets in slices(column):
        if not len(data):
            continue
        s, code = codes(data, offsets)
        ratio = table[code]
        run = np.zeros(len(s) + 1, np.int64)
        np.cumsum(ratio, dtype=np.int64, out=run[1:])
        lengths = np.diff(offsets)
        rows = np.flatnonzero(lengths)
        out[first + rows, 0] = (run[offsets[rows + 1]] - run[offsets[rows]]) * STEP / lengths[rows]
        begins = np.ones(len(s), bool)  # a word with the blanks before it
        begins[1:] = (s[1:] == BLANK) & (s[:-1] != BLANK)
        begins[offsets[:-1][lengths > 0]] = True
        start = np.flatnonzero(begins)
        word = np.diff(np.r_[run[start], run[-1]]) * STEP
        row = np.searchsorted(offsets, start, "right") - 1
        order = np.lexsort((-word, row))
        where = np.searchsorted(row, np.arange(len(offsets)))
        for k in range(3):
            has = np.flatnonzero(np.diff(where) > k)
            out[first + has, 1 + k] = word[order[where[has] + k]]
    return out


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2, rounds: int = 60) -> np.ndarray:
    """Newton's method; classes weigh the same in total. The last weight is the constant."""
    x = np.c_[x, np.ones(len(x))]
    weight = np.where(y == 1, 0.5 / max(1, (y == 1).sum()), 0.5 / max(1, (y == 0).sum())) * len(y)
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (weight * p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w)), x.T @ (weight * (p - y)) + ridge * w)
        w -= step
        if np.abs(step).max() < 1e-9:
            break
    return w


def fold(doc_id: Column, folds: int) -> Column:
    """crc32 of the id's decimal text, modulo ``folds``."""
    return F.crc32(doc_id.cast("string").cast("binary")) % folds


def score_documents(docs: DataFrame, labels: DataFrame, *, folds: int = 3, held_out: int = 1, curve_share: int = 4, curve_rows: int = 20_000, discount: float = 0.75, cutoff: float = 0.7) -> DataFrame:
    """(doc_id, held_out, score, predicted) for every row.

    Labels are learned only from documents outside the held-out fold. One in ``curve_share`` of these (by another part of
    the id's checksum) gives the curve its points, with the ratios of models that count the others only: all of them up to
    ``curve_rows`` of a class. The models that score count every one.
    """
    spark, staging = docs.sparkSession, Staging(docs.sparkSession, "toxicity")
    marked = labels.filter("doc_id IS NOT NULL").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic")).filter("toxic IS NOT NULL")
    part = lambda doc_id: F.crc32(doc_id.cast("string").cast("binary"))
    learns, curve = part(F.col("doc_id")) % folds != held_out, F.expr(f"crc32(cast(cast(doc_id as string) as binary)) div {folds}") % curve_share == 0
    marked = staging.write(marked.filter(learns).select("doc_id", ((F.col("toxic") >= 1).cast("int") + 2 * curve.cast("int")).alias("kind")), "labels")
    # Rows of other folds go before the shuffle. The labels grow with the corpus, so they are joined by a shuffle at any size.
    counted = docs.select("doc_id", "text").filter(learns).join(marked.hint("merge"), "doc_id").select("text", "kind")
    counts = counted.mapInArrow(_count, "code int, " + ", ".join(f"{k} long" for k in KINDS)).groupBy("code").agg(*[F.sum(k).alias(k) for k in KINDS])
    counts = staging.write(counts, "counts")

    def features(rows: DataFrame, table: np.ndarray) -> DataFrame:
        sent = spark.sparkContext.broadcast(zlib.compress(table.tobytes(), 1))  # CELLS bytes at most

        def of(batches):
            table = np.frombuffer(zlib.decompress(sent.value), np.int8)
            for batch in batches:
                x = text_features(table, batch.column("text"))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(x[:, k]) for k in range(len(FEATURES)))], ["doc_id", *FEATURES])
            release()

        return rows.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(of, "doc_id long, " + ", ".join(f"{f} double" for f in FEATURES))

    # The curve's points are chosen by id, so that only their texts are read; an id that many rows share is cut to the same bound after.
    known = docs.select("doc_id").filter(learns & curve).join(marked.filter("kind >= 2"), "doc_id").distinct()
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    chosen = staging.write(known.filter("kind = 3").orderBy(*order).limit(curve_rows).unionByName(known.filter("kind = 2").orderBy(*order).limit(curve_rows)), "chosen")
    others = counts.filter("toxic + ordinary > 0").select("code", "toxic", "ordinary")
    seen = features(docs.filter(learns & curve).join(F.broadcast(chosen.select("doc_id")), "doc_id", "left_semi"), ratio_table(others, staging, discount))
    seen = staging.write(seen.join(F.broadcast(chosen), "doc_id").select(*FEATURES, "kind", "doc_id"), "points")
    order += [F.col(f) for f in FEATURES]
    points = [seen.filter(kind).orderBy(*order).limit(curve_rows) for kind in ("kind = 3", "kind = 2")]
    points = points[0].unionByName(points[1]).select(*FEATURES, (F.col("kind") - 2).alias("toxic")).toPandas()
    every = counts.select("code", (F.col("toxic") + F.col("curve_toxic")).alias("toxic"), (F.col("ordinary") + F.col("curve_ordinary")).alias("ordinary"))
    scored = staging.write(features(docs, ratio_table(every, staging, discount)), "features")
    y = (points.toxic >= 1).to_numpy().astype(float)
    if 0 < y.sum() < len(y):
        *slopes, constant = fit_logistic(points[list(FEATURES)].to_numpy(), y)
        logit = sum((F.col(f) * float(w) for f, w in zip(FEATURES, slopes)), F.lit(float(constant)))
        score = 1 / (1 + F.exp(-logit))
    else:
        score = F.lit(0.0)
    staging.keep(scored)
    # The score is kept as a whole number of millionths, so that it doesn't hang on the last bit of a sum.
    out = scored.select("doc_id", F.coalesce(fold(F.col("doc_id"), folds) == held_out, F.lit(False)).alias("held_out"), F.round(score, 6).alias("score"))
    return out.withColumn("predicted", (F.col("score") >= cutoff).cast("int"))
