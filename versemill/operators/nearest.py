"""Nearest rows of many queries (J07-J09, V04): cells of one block of queries and one shard of rows, a matrix product each.

A product only says which rows can be among the nearest: rows are left out when their distance, less what the product's rounding
can come to, is above one that enough rows reach. What stays is computed again, component after component in doubles, as a plain
sum does. Distances are then equal to those of all pairs, and with them ties. A cell holds ``CELL_BYTES`` of vectors of either
side at any size of the tables; each row is sent to every block of queries. The work is that of all pairs.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CELL_BYTES = 1 << 23
RUN, BATCH = 4096, 64
PLACES = 9  # distances are ranked by this many decimals
NEAR = 1.1e-9  # rows this close may be equal once rounded
NONE = 1e300  # of pairs without a distance, which come last


def _matrix(vectors: pd.Series) -> tuple[np.ndarray, np.ndarray]:
    """(rows, padded with zeros, their widths); the width of null is -1."""
    widths = np.array([-1 if v is None else len(v) for v in vectors], np.int64)
    out = np.zeros((len(vectors), max(1, widths.max(initial=1))))
    for i, v in enumerate(vectors):
        if v is not None:
            out[i, : len(v)] = v
    return out, widths


def _least(q: np.ndarray, d: np.ndarray, place: np.ndarray, c: np.ndarray, k: int, bars: np.ndarray) -> tuple[np.ndarray, ...]:
    """The pairs that can be among the ``k`` first of their query; of equal distances the first ``k`` by place. Lowers the bars."""
    order = np.lexsort((place, d, q))
    q, d, place, c = q[order], d[order], place[order], c[order]
    fresh = np.r_[True, q[1:] != q[:-1]] if len(q) else np.zeros(0, bool)
    head = np.flatnonzero(fresh)
    kth = head + k - 1
    full = kth < np.r_[head[1:], len(q)]
    bars[q[head[full]]] = np.minimum(bars[q[head[full]]], d[kth[full]])
    alike = np.flatnonzero(fresh | np.r_[True, d[1:] != d[:-1]]) if len(q) else head
    nth = np.arange(len(q)) - np.repeat(alike, np.diff(np.r_[alike, len(q)]))
    stay = (d <= bars[q] + NEAR) & (nth < k)
    return q[stay], d[stay], place[stay], c[stay]


def _nearest(asked: tuple, rows: tuple, barred: list[tuple[np.ndarray, np.ndarray]], place: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, row, distance) of all pairs that can be among the ``k`` nearest of a query."""
    (a, wa), (b, wb) = asked, rows
    uneven = len(np.unique(np.r_[wa, wb])) > 1 or wa[0] < 0
    with np.errstate(all="ignore"):
        la, lb = np.sqrt(np.square(a).sum(axis=1)), np.sqrt(np.square(b).sum(axis=1))
        bars = np.full(len(a), np.inf)
        kept = np.zeros(0, np.int64), np.zeros(0), np.zeros(0, np.int64), np.zeros(0, np.int64)
        for lo in range(0, len(b), RUN):
            hi = min(lo + RUN, len(b))
            slack = 1e-12 * la * lb[lo:hi].max() + NEAR
            guess = 1 - a @ b[lo:hi].T
            if uneven:
                guess[(wa[:, None] != wb[None, lo:hi]) | (wa[:, None] < 0)] = np.nan
            guess[np.isnan(guess)] = NONE
            out = np.zeros(guess.shape, bool)
            for x, y in barred:
                out |= (x[:, None] == y[None, lo:hi]) | (x[:, None] < 0) | (y[None, lo:hi] < 0)
            guess[out] = np.inf
            near = ~(guess > (bars + 2 * slack)[:, None]) & ~out
            crowded = np.flatnonzero(near.sum(axis=1) > 4 * k)
            if len(crowded) and hi - lo > k:  # of this run alone k rows reach this
                reach = np.partition(guess[crowded], k - 1, axis=1)[:, k - 1]
                near[crowded] &= ~(guess[crowded] > (reach + 2 * slack[crowded])[:, None])
            q, c = np.nonzero(near)
            c = c + lo
            d = np.empty(len(q))
            for i in range(0, len(q), 1 << 14):
                part = slice(i, i + (1 << 14))
                d[part] = 1 - np.cumsum(a[q[part]] * b[c[part]], axis=1)[:, -1]
            if uneven:
                d[(wa[q] != wb[c]) | (wa[q] < 0)] = np.nan
            d[np.isnan(d)] = NONE
            kept = _least(*(np.concatenate(p) for p in zip(kept, (q, d, place[c], c))), k, bars)
    q, d, _, c = kept
    return q, c, np.where(d == NONE, np.nan, d)


def _codes(left: pd.Series, right: pd.Series) -> tuple[np.ndarray, np.ndarray]:
    """Whole numbers that are equal where values are; -1 for null."""
    codes, _ = pd.factorize(pd.concat([left, right], ignore_index=True))
    return codes[: len(left)], codes[len(left) :]


def _cell(asked: pd.DataFrame, rows: pd.DataFrame, id_col: str, most: dict[int, int], differ: int) -> pd.DataFrame:
    found = []
    if len(asked) and len(rows):
        matrix, widths = _matrix(asked["vector"])
        for kind, some in rows.groupby("kind"):
            k = most[int(kind)]
            if not k:
                continue
            some = some.sort_values("id", kind="stable").reset_index(drop=True)
            theirs, their_widths = _matrix(some["vector"])
            width = max(matrix.shape[1], theirs.shape[1])
            mine, theirs = (np.pad(m, ((0, 0), (0, width - m.shape[1]))) for m in (matrix, theirs))
            barred = [_codes(asked[f"d{i}"], some[f"d{i}"]) for i in range(differ)]
            for i in range(0, len(asked), BATCH):
                part = slice(i, i + BATCH)
                q, c, d = _nearest((mine[part], widths[part]), (theirs, their_widths), [(x[part], y) for x, y in barred], np.arange(len(some)), k)
                found.append(pd.DataFrame({"query_id": asked["id"].to_numpy()[part][q], id_col: some["id"].to_numpy()[c], "kind": np.full(len(q), kind, np.int32), "distance": d}))
    return pd.concat(found, ignore_index=True) if found else pd.DataFrame({c: [] for c in ("query_id", id_col, "kind", "distance")})


def nearest(
    corpus: DataFrame, queries: DataFrame, most: dict[int, int], kind: Column, *, id_col: str = "vec_id", differ: tuple[tuple[str, str], ...] = (), cell_bytes: int = CELL_BYTES,
) -> DataFrame:
    """(query_id, ``id_col``, kind, distance): of every query (query_id, query_vector) the rows that can be among its ``most[kind]`` nearest of each kind, ties by id.

    More rows may come, never fewer; the caller ranks them. ``differ``: columns of a row and of a query that must differ, null
    from nothing. A pair of which one vector is null, or holds null, or that differ in width has a null distance, which comes last.
    """
    names = [f"d{i}" for i in range(len(differ))]
    rows = corpus.select(F.col(id_col).alias("id"), F.col("embedding").cast("array<double>").alias("vector"), kind.cast("int").alias("kind"), *[F.col(c).alias(n) for n, (c, _) in zip(names, differ)])
    asked = queries.select(F.col("query_id").alias("id"), F.col("query_vector").cast("array<double>").alias("vector"), *[F.col(c).alias(n) for n, (_, c) in zip(names, differ)])
    size = F.coalesce(F.sum(F.greatest(F.size("vector"), F.lit(1)) * 8 + 64), F.lit(0)).alias("bytes")
    held, sent = rows.agg(size).first()[0], asked.agg(size).first()[0]
    shards = max(1, -(-held // cell_bytes), min(corpus.sparkSession.sparkContext.defaultParallelism, held >> 20))
    blocks = max(1, -(-sent // cell_bytes))
    deal = lambda n: F.pmod(F.xxhash64("id"), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    mine = asked.withColumn("block", deal(blocks)).withColumn("shard", every(shards))
    theirs = rows.withColumn("shard", deal(shards)).withColumn("block", every(blocks))
    theirs = theirs.select(*[F.col(c).alias(c) for c in ["block", "shard", *rows.columns]])
    cells = min(shards * blocks, 2000)
    mine, theirs = (side.withColumn("cell", F.col("block") * shards + F.col("shard")).repartition(cells, "cell") for side in (mine, theirs))
    kinds = asked.schema["id"].dataType.simpleString(), rows.schema["id"].dataType.simpleString()
    found = mine.groupBy("cell").cogroup(theirs.groupBy("cell"))
    return found.applyInPandas(lambda q, c: _cell(q, c, id_col, most, len(names)), f"query_id {kinds[0]}, `{id_col}` {kinds[1]}, kind int, distance double")
