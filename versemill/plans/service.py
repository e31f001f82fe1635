"""The service surface (V): search tools, retrieval, chat context and the stimulus pipeline, as functions that return DataFrames.

Embedding, token counting and generation are hooks: what they compute is a parameter, never part of the engine.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.safety import safety_reason
from ..functions.text import estimated_tokens, similarity
from ..operators import aggregates, eventlog, filters, joins, retrieval

Embed = Callable[[pd.Series], pd.Series]


@dataclass
class Hooks:
    """``embed`` turns a batch of texts into vectors; ``tokens`` counts the tokens of a text column; ``generate`` turns prompts into answers (deterministic in tests)."""

    embed: Embed | None = None
    tokens: Callable[[Column], Column] = estimated_tokens
    generate: Callable[[Column], Column] = field(default=lambda prompt: F.concat(F.lit("answer to: "), F.substring(prompt, 1, 40)))

    def embedded(self, texts: DataFrame, column: str, out: str = "query_vector") -> DataFrame:
        """Vectors of a text column, in Arrow batches; a table that has them already needs no hook."""
        if self.embed is None:
            raise ValueError("no embedding hook is set; give vectors instead")
        run = self.embed
        return texts.withColumn(out, F.pandas_udf(lambda s: run(s), "array<double>")(F.col(column)))


def collection(vectors: DataFrame, chunks: DataFrame | None = None, key: str = "vec_id") -> DataFrame:
    """The searchable collection: vectors with what is known of their chunks."""
    return vectors if chunks is None else vectors.join(chunks, key, "left")


def search_poems(corpus: DataFrame, queries: DataFrame, n: int = 5) -> DataFrame:
    """Nearest chunks with their id (at most 20) and similarity."""
    return retrieval.search(corpus, queries, min(n, 20)).withColumn("similarity", similarity(F.col("distance")))


def search_by_poet(corpus: DataFrame, queries: DataFrame, poet: str, n: int = 5) -> DataFrame:
    """V04, T03."""
    return search_poems(filters.equal_all(corpus, {"poet": poet}), queries, n)


def search_by_period(corpus: DataFrame, queries: DataFrame, period: object, n: int = 5) -> DataFrame:
    """V04, T03."""
    return search_poems(filters.equal_all(corpus, {"period": period}), queries, n)


def poem_context(chunks: DataFrame, chunk_id: object) -> DataFrame:
    """A chunk and its neighbours in the poem, by place."""
    pairs = joins.neighbours(chunks, ["poet", "title"], "chunk_index", 1).filter(F.col("a.chunk_id") == chunk_id)
    return pairs.select(*[F.col(f"b.{c}") for c in chunks.columns]).orderBy("chunk_index").limit(100)


def list_poets(chunks: DataFrame) -> DataFrame:
    """V04, A07."""
    return aggregates.facets(chunks)


def corpus_stats(chunks: DataFrame) -> DataFrame:
    """V04, A08."""
    return aggregates.corpus_counts(chunks, ["period", "type"])


def random_passage(chunks: DataFrame, seed: int, poet: str | None = None) -> DataFrame:
    """One row, uniformly."""
    return retrieval.random_rows(filters.equal_all(chunks, {"poet": poet}), 1, seed, "chunk_id")


def retrieve(corpus: DataFrame, queries: DataFrame, texts: DataFrame, used: DataFrame, cooled: list[str], n: int = 8) -> DataFrame:
    """Several queries at once over what is neither used lately nor by a poet on hold, unsafe passages dropped: (vec_id, distance, text)."""
    open_ = corpus.filter(filters.not_in_any_case(F.col("poet"), cooled)).join(used.select("vec_id").distinct(), "vec_id", "left_anti")
    found = retrieval.search_multi(open_, queries, 2 * n, 2 * n).join(texts.select("vec_id", "text"), "vec_id")
    return found.filter(safety_reason(F.col("text")) == "").orderBy("distance", "vec_id").limit(n)


def respond(items: DataFrame, context: DataFrame, hooks: Hooks) -> DataFrame:
    """Admitted items with their context, through the generation hook, as rows of the log."""
    prompt = F.concat_ws("\n", "text", "context")
    answered = items.join(context, "id", "left").withColumn("answer", hooks.generate(prompt))
    return answered.withColumns({"tokens_in": hooks.tokens(prompt), "tokens_out": hooks.tokens(F.col("answer")), "decision": F.when(F.col("answer") != "", "post").otherwise("skip")})


def chat_window(turns: DataFrame, key: str, order: str, n: int = 12) -> DataFrame:
    """The newest ``n`` turns of each session in order, and how many older ones its summary has to cover. Each turn appears once."""
    newest = eventlog.newest_per(turns, key, n, order)
    total = turns.groupBy(key).agg(F.count("*").alias("_all"))
    place = F.row_number().over(Window.partitionBy(key).orderBy(order)).cast("int")
    return newest.withColumn("place", place).join(total, key).withColumn("summarised", F.greatest(F.col("_all") - n, F.lit(0))).drop("_all")


def should_escalate(distance: Column, threshold: float = 0.85) -> Column:
    """V08, X54."""
    return similarity(distance) >= threshold
