"""Vector retrieval (J07-J09, T, W05, W06): filter, then exact nearest neighbours (``nearest.py``)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import cosine_distance
from .nearest import PLACES, nearest
from .sequence import cap_kind

#: Bytes of query vectors that may travel to every task.
BROADCAST_BYTES = 32 << 20


def distances(corpus: DataFrame, queries: DataFrame, extra: Column | None = None, blocks: int | None = None) -> DataFrame:
    """Every (query, row) with its cosine distance: queries (query_id, query_vector) against all rows.

    Queries whose vectors together take up to ``BROADCAST_BYTES`` are sent to the rows; more are dealt into blocks of that
    size, each of which meets the rows in turn, so that no task holds all of them.
    """
    held = queries.agg(F.coalesce(F.sum(F.size("query_vector") * 8 + 64), F.lit(0))).first()[0]
    if held <= BROADCAST_BYTES:
        pairs = corpus.join(F.broadcast(queries), extra if extra is not None else F.lit(True))
    else:
        blocks = blocks or -(-held // BROADCAST_BYTES)
        dealt = queries.withColumn("_b", F.pmod(F.xxhash64("query_id"), F.lit(blocks)))
        pairs = corpus.withColumn("_b", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long")))).join(dealt, "_b")
        pairs = (pairs.filter(extra) if extra is not None else pairs).drop("_b")
    return pairs.withColumn("distance", cosine_distance(F.col("embedding"), F.col("query_vector")))


def search(corpus: DataFrame, queries: DataFrame, n: int, *, id_col: str = "vec_id", cap_type: str | None = None, cap: int = 1, fetch: int | None = None, differ: tuple[tuple[str, str], ...] = ()) -> DataFrame:
    """The ``n`` nearest rows of each query with rank, by the distance to nine decimals, ties by id.

    ``cap_type``: at most ``cap`` rows of that type; null is another. ``fetch``: look at only so many nearest before capping (then fewer than ``n`` may come back).
    ``differ``: columns of a row and of a query that must differ. What each cell of rows and queries can contribute is small; it is ranked after.
    """
    order = lambda: [F.col("distance").asc_nulls_last(), id_col]
    by = Window.partitionBy("query_id").orderBy(*order())
    capped = F.col("type") == cap_type
    # Nothing past the n nearest of the other kinds and the cap nearest of the capped one can count.
    kind = F.lit(0) if cap_type is None else F.when(capped, 1).otherwise(0)
    most = {0: n, 1: cap} if fetch is None else {0: fetch, 1: fetch}
    found = nearest(corpus, queries, most, kind, id_col=id_col, differ=differ).withColumn("distance", F.round("distance", PLACES))
    if cap_type is None:
        return found.withColumn("rank", F.row_number().over(by)).filter(F.col("rank") <= n).drop("kind")
    if fetch is not None:
        found = found.withColumn("_f", F.row_number().over(by)).filter(F.col("_f") <= fetch).drop("_f")
    return cap_kind(found, "query_id", order(), F.col("kind") == 1, cap, n).drop("kind")


def search_multi(corpus: DataFrame, queries: DataFrame, each: int, n: int, id_col: str = "vec_id") -> DataFrame:
    """Several queries for one need: of each row the least distance, then the ``n`` nearest of all."""
    hits = search(corpus, queries, each, id_col=id_col)
    best = hits.groupBy(id_col).agg(F.min(F.struct("distance", "query_id")).alias("_b")).select(id_col, F.col("_b.distance").alias("distance"), F.col("_b.query_id").alias("query_id"))
    return best.orderBy("distance", id_col).limit(n)


def contrast(corpus: DataFrame, items: DataFrame, id_col: str = "vec_id") -> DataFrame:
    """The nearest row of another poet. ``items``: (query_id, query_vector, query_poet)."""
    return search(corpus, items, 1, id_col=id_col, differ=(("poet", "query_poet"), (id_col, "query_id")))


def browse(chunks: DataFrame, poet: str, limit: int, cap: int = 50) -> DataFrame:
    """A poet's chunks in order of work and place, at most ``cap``."""
    return chunks.filter(F.col("poet") == poet).orderBy("title", "chunk_index", "chunk_id").limit(min(limit, cap))


def random_rows(table: DataFrame, n: int, seed: int, key: str) -> DataFrame:
    """``n`` rows, uniformly, the same for a seed: those whose keys come first by the md5 of seed and key. A bounded sort, no count."""
    return table.orderBy(F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string"))), key).limit(n)
