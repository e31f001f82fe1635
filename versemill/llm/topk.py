"""Exact top-k search by inner product: branch and bound over blocks of dimensions in vertical layout.

Vectors are dealt into cells of one block of queries and one shard of candidates. In a cell, dimensions are ordered by
their mass and candidates lie dimension by dimension. For a batch of queries the partial products are built up block of
dimensions by block, one matrix product each. After each block, what the dimensions left can still add is at most the
product of both remainders' lengths; candidates that can reach no query's k-th best any more are dropped and the survivors
compacted. A cell begins with a score that k candidates reach: the whole products of those that are best over the first block;
it rises with what is found, run by run. Queries and candidates are sorted by the nearest of some pivots, so that a batch and a
run point one way and fall together.

Components are whole numbers. Vectors whose squares sum to less than 2^52 are narrow: by the Cauchy-Schwarz inequality
every partial product of two of them is exact in doubles, so pruning never has to guess at ties. The others are wide; they
have cells of their own, in which bounds are taken on scaled doubles with slack and the survivors' products are computed
in whole numbers of any length. An exact search meets every query with every shard: with b vectors to ``cell_bytes``, each
of n vectors is sent q / b times and each of q queries n / b times, and a cell holds 2 b vectors at any size of the table.

Defined results: vectors that are null, empty, or hold a null or non-finite component take no part, nor do rows without
an id; every row is a vector of its own, so rows that repeat an id (with the same vector or another) are candidates to
each other, and a query's results are its row's; a query meets only vectors of its own length and not its own row; equal
scores go to the smaller id; with fewer than k candidates, all are returned; scores are ranked by their true value, and one
beyond a long is returned as the nearest long.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .staging import MOST_TASKS, Staging

NARROW = 2.0**52
PIVOTS = 64


def usable(vector: Column) -> Column:
    """Whether a vector takes part: not empty, no component null or not finite."""
    finite = F.forall(vector, lambda x: F.coalesce(F.abs(x.cast("double")) < float("inf"), F.lit(False)))  # nan is above infinity
    return F.coalesce((F.size(vector) > 0) & finite, F.lit(False))


def _whole(vector: np.ndarray, scale: int) -> list[int]:
    """floor(scale * x) of each component, in whole numbers of any length; the product is the one doubles make, where it is finite."""
    return [int(np.floor(y)) if np.isfinite(y) else scale * int(x) for x, y in zip(vector.tolist(), (vector * scale).tolist())]


class _Cell:
    """Candidates of a cell, dimension by dimension, in runs, and the search over them."""

    def __init__(self, ids: np.ndarray, rows: np.ndarray, vectors: np.ndarray, whole: np.ndarray | None, unit: int, block: int, run: int):
        """``vectors`` are doubles for the bounds, ``whole`` the same times ``unit`` in whole numbers, or None where the doubles are exact."""
        self.ids, self.rows, self.whole, self.unit = ids, rows, whole, unit
        self.order = np.argsort(-np.square(vectors).sum(axis=0), kind="stable")
        self.columns = np.ascontiguousarray(vectors.T[self.order])
        self.steps = [(a, min(a + block, len(self.order))) for a in range(0, len(self.order), block)]
        rest = np.cumsum([np.square(self.columns[a:b]).sum(axis=0) for a, b in self.steps[::-1]], axis=0)[::-1]
        self.lengths = np.sqrt(rest[0])
        self.rest = np.sqrt(np.vstack([rest[1:], np.zeros((1, len(ids)))]))  # length of what follows each block
        self.runs = [(a, min(a + run, len(ids))) for a in range(0, len(ids), run)]
        self.products = 0  # of two components, besides those of the seeds

    def _seed(self, rows: np.ndarray, queries: np.ndarray, slack: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(products over the first block of all candidates, a score that k candidates reach for each query): the whole products of the candidates that are best there."""
        a, b = self.steps[0]
        sums = queries[:, a:b] @ self.columns[a:b]
        self.products += sums.size * (b - a)
        least = np.full(len(rows), -np.inf)
        n = min(len(self.ids), 4 * (k + 1))
        if n > k:
            picks = np.argpartition(sums, -n, axis=1)[:, -n:]
            for q, some in enumerate(picks):
                within = queries[q] @ self.columns[:, some] - slack[q] * self.lengths[some]
                least[q] = np.sort(within[self.rows[some] != rows[q]])[-k]
        return sums, least

    def search(self, rows: np.ndarray, queries: np.ndarray, whole: np.ndarray | None, unit: int, k: int) -> list[tuple[list[int], list[int]]]:
        """For each query (scores, ids) of the best, by score and then id."""
        queries = queries[:, self.order]
        rest = np.sqrt(np.array([np.square(queries[:, b:]).sum(axis=1) for _, b in self.steps]))
        slack = ((1e-12 if self.whole is None else 1e-9) * np.sqrt(np.square(queries).sum(axis=1)))[:, None]
        best: list[tuple[list[int], list[int]]] = [([], []) for _ in rows]
        begun, least = self._seed(rows, queries, slack, k)
        for first, last in self.runs:
            alive, sums = np.arange(first, last), begun[:, first:last]
            for s, (a, b) in enumerate(self.steps):
                if s:
                    whole_run = len(alive) == last - first
                    sums = sums + queries[:, a:b] @ (self.columns[a:b, first:last] if whole_run else self.columns[a:b, alive])
                    self.products += sums.size * (b - a)
                if np.isneginf(least).any():
                    continue
                reach = sums + rest[s][:, None] * self.rest[s, alive] + slack * self.lengths[alive]
                stay = np.flatnonzero((reach >= least[:, None]).any(axis=0))
                if len(stay) < 0.9 * len(alive):
                    alive, sums = alive[stay], sums[:, stay]
                if not len(alive):
                    break
            if not len(alive):
                continue
            sums = sums + slack * self.lengths[alive] if self.whole is not None else sums
            bar = least
            if len(alive) > k:  # of this run itself at most k, with ties, and one more for the query's own row
                within = sums - 2 * slack * self.lengths[alive] if self.whole is not None else sums
                bar = np.maximum(least, np.partition(within, -(k + 1), axis=1)[:, -(k + 1)])
            for q in range(len(rows)):
                at = np.flatnonzero((sums[q] >= bar[q]) & (self.rows[alive] != rows[q]))
                if not len(at):
                    continue
                some = alive[at]
                exact = [int(x) for x in sums[q, at]] if self.whole is None else [sum(x * y for x, y in zip(whole[q], self.whole[c])) for c in some]
                found = sorted(zip(best[q][0] + exact, best[q][1] + self.ids[some].tolist()), key=lambda x: (-x[0], x[1]))[:k]
                best[q] = [s for s, _ in found], [i for _, i in found]
                if len(found) == k:
                    least[q] = max(least[q], found[-1][0] / (unit * self.unit))
        return best


def _search_cell(queries: pd.DataFrame, candidates: pd.DataFrame, k: int, scale: int, block: int, run: int, batch: int = 32) -> pd.DataFrame:
    out = []
    if len(queries) and len(candidates):
        candidates = candidates.sort_values(["vec_id", "row"])
        sides = []
        for side in (candidates, queries):
            raw = np.stack(side.vector.to_numpy()).astype(np.float64)
            if queries.wide.iloc[0] or candidates.wide.iloc[0]:
                whole = [_whole(v, scale) for v in raw]
                unit = 1 << max(0, max(abs(x) for v in whole for x in v).bit_length() - 1)
                sides.append((np.array([[x / unit for x in v] for v in whole]), whole, unit))
            else:
                sides.append((np.floor(raw * scale), None, 1))
        (vectors, whole, unit), (asked, asked_whole, asked_unit) = sides
        # Vectors of one direction lie together: a batch of queries then has one bound in common, and runs of candidates fall as one.
        pivots = vectors[:: -(-len(vectors) // PIVOTS)]
        turn, asked_turn = (np.argsort((x @ pivots.T).argmax(axis=1), kind="stable") for x in (vectors, asked))
        vectors, whole, candidates = vectors[turn], whole and [whole[i] for i in turn], candidates.iloc[turn]
        asked, asked_whole, queries = asked[asked_turn], asked_whole and [asked_whole[i] for i in asked_turn], queries.iloc[asked_turn]
        cell = _Cell(candidates.vec_id.to_numpy(), candidates.row.to_numpy(), vectors, whole, unit, block, run)
        names, rows = queries.vec_id.to_numpy(), queries.row.to_numpy()
        clip = lambda s: max(-(1 << 63), min((1 << 63) - 1, s))
        for a in range(0, len(rows), batch):
            part = slice(a, a + batch)
            found = cell.search(rows[part], asked[part], asked_whole[part] if whole is not None else None, asked_unit, k)
            out += [(row, own, i, clip(s), str(s)) for row, own, (scores, ids) in zip(rows[part], names[part], found) for s, i in zip(scores, ids)]
    return pd.DataFrame(out, columns=["row", "query_id", "vec_id", "score", "exact"])


def top_k(
    vectors: DataFrame, is_query: Column, *, k: int = 5, scale: int = 256, cell_bytes: int = 1 << 23, block: int = 16, run: int = 512,
    id_col: str = "vec_id", vector_col: str = "embedding",
) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row that ``is_query`` marks, its ``k`` best among the others."""
    staging = Staging(vectors.sparkSession, "top-k")
    vector = F.transform(F.col(vector_col), lambda x: x.cast("double"))
    rows = vectors.filter(F.col(id_col).isNotNull() & usable(F.col(vector_col)))
    norm = F.aggregate("vector", F.lit(0.0), lambda a, x: a + F.pow(x * scale, F.lit(2.0)) + F.abs(x * scale) * 2 + 1)  # of floor() too
    rows = rows.select(F.col(id_col).alias("vec_id"), F.coalesce(is_query, F.lit(False)).alias("asks"), vector.alias("vector"))
    rows = staging.write(rows.select("*", (norm >= NARROW).alias("wide"), F.size("vector").alias("width"), F.monotonically_increasing_id().alias("row")), "vectors")
    counts = {r.wide: r for r in rows.groupBy("wide").agg(F.count("*").alias("n"), F.count_if("asks").alias("q"), F.max("width").alias("width")).collect()}
    size = max(1, cell_bytes // (8 * max((r.width for r in counts.values()), default=1)))
    # Every query block meets every shard. Wide vectors have blocks and shards after those of the narrow ones.
    shards, blocks = ([-(-counts[w][c] // size) if w in counts else 0 for w in (False, True)] for c in ("n", "q"))
    place = lambda n: F.when(F.col("wide"), n[0] + F.pmod(F.xxhash64("row"), F.lit(max(1, n[1])))).otherwise(F.pmod(F.xxhash64("row"), F.lit(max(1, n[0])))).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(max(1, sum(n)) - 1)))
    keys, carried = ["width", "block", "shard"], ["vec_id", "row", "wide", "vector"]
    asked = rows.filter("asks").withColumn("block", place(blocks)).withColumn("shard", every(shards)).select(*keys, *carried)
    offered = rows.withColumn("shard", place(shards)).withColumn("block", every(blocks)).select(*keys, *carried)
    cells = min(max(1, sum(shards)) * max(1, sum(blocks)), MOST_TASKS)  # a task takes its cells one by one
    # Columns of its own for one side: both come from one table, and Spark 4.1.2 prunes the other's columns by name of the first.
    offered = offered.repartition(cells, *keys).select(*[F.col(c).alias(c) for c in keys + carried])
    found = asked.repartition(cells, *keys).groupBy(*keys).cogroup(offered.groupBy(*keys))
    found = found.applyInPandas(lambda q, c: _search_cell(q, c, k, scale, block, run), "row long, query_id long, vec_id long, score long, exact string")
    # Beyond longs, order follows the exact digits; there a score is as long as its string.
    true = [F.col("score").desc()]
    if True in counts:
        size = F.length("exact") * F.when(F.startswith("exact", F.lit("-")), -1).otherwise(1)
        true += [size.desc(), F.when(size > 0, F.col("exact")).desc(), F.col("exact").asc()]
    rank = F.row_number().over(Window.partitionBy("row").orderBy(*true, F.col("vec_id").asc()))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
