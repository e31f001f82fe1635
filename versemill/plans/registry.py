"""Registry of queries: each applies library operators to the tables of a folder, with DuckDB SQL for the same rows."""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


class Tables:
    """The tables of a folder, and the entities that operators work on as views of them. Reads are lazy and column-pruned."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    def dealt(self, name: str, *columns: str) -> DataFrame:
        """Columns of a table for work that costs far more than reading: dealt over all cores where it was read in fewer parts, as one large row group is."""
        rows, cores = getattr(self, name).select(*columns), self.spark.sparkContext.defaultParallelism
        return rows if rows.rdd.getNumPartitions() >= cores else rows.repartition(cores)

    @cached_property
    def interactions(self) -> DataFrame:
        k = F.get_json_object("props", "$.k").cast("int")
        return self.events.select(
            F.col("event_id").alias("id"), F.col("ts"), F.to_date("ts").alias("day"),
            F.when(F.col("user_id") % 5 == 0, F.concat(F.lit("stimuli_dir:"), F.col("user_id") % 4)).when(F.col("user_id") % 11 == 0, "test").otherwise("firehose").alias("source"),
            F.concat(F.lit("u"), "user_id").alias("author"), F.concat(F.col("event_type"), F.lit(" note "), F.col("user_id") % 9).alias("stimulus"),
            F.when(F.col("event_type") == "purchase", "post").when(F.col("event_type") == "error", "skip").otherwise("pass").alias("decision"),
            F.floor("value").cast("long").alias("tokens_in"), k.alias("tokens_out"), (k % 3).alias("published"), (k % 10 == 0).cast("int").alias("dry_run"),
            F.concat(F.lit("c"), F.col("event_id") % 500).alias("chunk_id"), F.concat(F.lit("poet"), F.col("user_id") % 20).alias("poet"),
            F.format_string('["t%d","t%d"]', k % 5, k % 7).alias("themes"),
            F.format_string('{"chunk_id":"c%d","poet":"poet%d"}', F.col("event_id") % 500, F.col("user_id") % 20).alias("passage_used"),
        )

    @cached_property
    def chunks(self) -> DataFrame:
        return self.documents.select(
            F.col("doc_id").alias("chunk_id"), F.col("source").alias("poet"), F.expr("concat('w', doc_id div 25)").alias("title"), F.col("lang").alias("period"),
            (F.col("doc_id") % 25).cast("int").alias("chunk_index"), F.when(F.col("doc_id") % 6 == 0, "prose").otherwise("verse").alias("type"), F.col("text"), F.col("n_chars"),
        )

    @cached_property
    def vectors(self) -> DataFrame:
        return self.embeddings.select("vec_id", "embedding", F.concat(F.lit("poet"), "label").alias("poet"), F.when(F.col("vec_id") % 4 == 0, "prose").otherwise("verse").alias("type"), (F.col("vec_id") % 3).cast("int").alias("period"))


#: The same views for DuckDB; a query's SQL gets those it names.
VIEWS = {
    "interactions": r"""SELECT event_id AS id, ts, ts::DATE AS day,
        CASE WHEN user_id % 5 = 0 THEN 'stimuli_dir:' || (user_id % 4) WHEN user_id % 11 = 0 THEN 'test' ELSE 'firehose' END AS source,
        'u' || user_id AS author, event_type || ' note ' || (user_id % 9) AS stimulus,
        CASE event_type WHEN 'purchase' THEN 'post' WHEN 'error' THEN 'skip' ELSE 'pass' END AS decision,
        floor(value)::BIGINT AS tokens_in, k AS tokens_out, k % 3 AS published, (k % 10 = 0)::INT AS dry_run,
        'c' || (event_id % 500) AS chunk_id, 'poet' || (user_id % 20) AS poet, '["t' || (k % 5) || '","t' || (k % 7) || '"]' AS themes
        FROM (SELECT *, (props->>'$.k')::INT AS k FROM events)""",
    "chunks": r"""SELECT doc_id AS chunk_id, source AS poet, 'w' || (doc_id // 25) AS title, lang AS period, (doc_id % 25)::INT AS chunk_index,
        CASE WHEN doc_id % 6 = 0 THEN 'prose' ELSE 'verse' END AS type, text, n_chars FROM documents""",
    "vectors": r"""SELECT vec_id, embedding, 'poet' || label AS poet, CASE WHEN vec_id % 4 = 0 THEN 'prose' ELSE 'verse' END AS type, (vec_id % 3)::INT AS period FROM embeddings""",
}


def query(name: str, sql: str | None = None) -> Callable:
    """Register ``f(tables) -> DataFrame`` under ``name``; without ``sql`` the result is tested in another way."""

    def register(f: Callable[[Tables], DataFrame]) -> Callable:
        QUERIES[name] = lambda spark, folder: f(Tables(spark, folder))
        if sql:
            used = ", ".join(f"{v} AS ({body})" for v, body in VIEWS.items() if re.search(rf"\b{v}\b", sql))
            ORACLES[name] = (f"WITH {used}{', ' + sql.strip()[5:] if sql.strip().upper().startswith('WITH ') else ' ' + sql}" if used else sql)
        return f

    return register
