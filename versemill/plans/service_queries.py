"""Queries over the service surface (V) and the generic text parser."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.filters import line_class
from ..sources.plaintext import parse
from ..streaming import pipelines as P
from ..streaming import timers as T
from . import service as V
from .registry import Tables, query
from .relational_queries import DIST, asked
from .stream_queries import drained, drained_in_order


@query("v04_search_by_poet", f"SELECT q.vec_id AS query_id, v.vec_id FROM vectors v JOIN vectors q ON q.vec_id % 20 = 0 AND v.poet = 'poet2' QUALIFY row_number() OVER (PARTITION BY q.vec_id ORDER BY {DIST}, v.vec_id) <= 4")
def _(t: Tables) -> DataFrame:
    return V.search_by_poet(t.vectors, asked(t), "poet2", 4).select("query_id", "vec_id")


@query("v04_search_by_period", f"SELECT q.vec_id AS query_id, v.vec_id FROM vectors v JOIN vectors q ON q.vec_id % 20 = 0 AND v.period = 1 QUALIFY row_number() OVER (PARTITION BY q.vec_id ORDER BY {DIST}, v.vec_id) <= 20")
def _(t: Tables) -> DataFrame:
    return V.search_by_period(t.vectors, asked(t), 1, 30).select("query_id", "vec_id")


@query("v04_poem_context", "SELECT b.chunk_id FROM chunks a JOIN chunks b ON a.poet = b.poet AND a.title = b.title AND abs(a.chunk_index - b.chunk_index) <= 1 WHERE a.chunk_id = 20")
def _(t: Tables) -> DataFrame:
    return V.poem_context(t.chunks, 20).select("chunk_id")


@query("v04_list_poets", "SELECT poet, count(*) AS n, list_sort(list(DISTINCT title)) AS works, list_sort(list(DISTINCT period)) AS periods FROM chunks GROUP BY poet")
def _(t: Tables) -> DataFrame:
    return V.list_poets(t.chunks)


@query("v06_retrieve", f"""WITH d AS (SELECT q.vec_id AS query_id, v.vec_id, {DIST} AS distance FROM vectors v JOIN vectors q ON q.vec_id IN (0, 20, 40) AND v.poet <> 'poet0' AND v.vec_id % 7 <> 0 QUALIFY row_number() OVER (PARTITION BY q.vec_id ORDER BY {DIST}, v.vec_id) <= 16),
  m AS (SELECT vec_id, min(distance) AS distance FROM d GROUP BY vec_id ORDER BY min(distance), vec_id LIMIT 16) SELECT vec_id FROM m WHERE vec_id % 5 <> 0 ORDER BY distance, vec_id LIMIT 8""")
def _(t: Tables) -> DataFrame:
    texts = t.vectors.select("vec_id", F.when(F.col("vec_id") % 5 == 0, "Romish superstition").otherwise("a mild air").alias("text"))
    used = t.vectors.filter("vec_id % 7 = 0").select("vec_id")
    return V.retrieve(t.vectors, asked(t).filter("query_id IN (0, 20, 40)"), texts, used, ["POET0"]).select("vec_id")


@query("v07_respond", "SELECT id, 'answer to: ' || substr(stimulus || chr(10) || poet, 1, 40) AS answer, length(stimulus || chr(10) || poet) // 4 AS tokens_in FROM interactions WHERE decision = 'skip'")
def _(t: Tables) -> DataFrame:
    rows = t.interactions.filter("decision = 'skip'")
    return V.respond(rows.select("id", F.col("stimulus").alias("text")), rows.select("id", F.col("poet").alias("context")), V.Hooks()).select("id", "answer", "tokens_in")


@query("v01_embedding_hook", "SELECT q.n_nationkey AS query_id, v.vec_id, (row_number() OVER (PARTITION BY q.n_nationkey ORDER BY round(1 - v.embedding[q.n_nationkey % 64 + 1], 9), v.vec_id))::INT AS rank FROM nation q JOIN vectors v ON true QUALIFY rank <= 3")
def _(t: Tables) -> DataFrame:
    """A hook that embeds a number as a unit vector along that dimension: the nearest rows are those with the most of it."""

    def embed(texts: pd.Series) -> pd.Series:
        return pd.Series([[float(i == int(x) % 64) for i in range(64)] for x in texts])

    asked_ = V.Hooks(embed=embed).embedded(t.nation.select(F.col("n_nationkey").alias("query_id"), F.col("n_nationkey").cast("string").alias("text")), "text")
    return V.search_poems(t.vectors.withColumn("embedding", F.transform("embedding", lambda x: x.cast("double"))), asked_, 3).select("query_id", "vec_id", "rank")


@query("v02_v03_hooks", "SELECT id, upper(stimulus) AS answer, length(stimulus || chr(10) || poet) AS tokens_in, CASE WHEN stimulus <> '' THEN 'post' ELSE 'skip' END AS decision FROM interactions WHERE decision = 'skip'")
def _(t: Tables) -> DataFrame:
    """A counter and a generator put in from outside."""
    rows = t.interactions.filter("decision = 'skip'")
    hooks = V.Hooks(tokens=F.length, generate=lambda prompt: F.upper(F.substring_index(prompt, "\n", 1)))
    return V.respond(rows.select("id", F.col("stimulus").alias("text")), rows.select("id", F.col("poet").alias("context")), hooks).select("id", "answer", "tokens_in", "decision")


@query("v08_chat_window", "SELECT conv_id, turn, (row_number() OVER (PARTITION BY conv_id ORDER BY turn))::INT AS place, summarised FROM (SELECT conv_id, turn, greatest(count(*) OVER (PARTITION BY conv_id) - 3, 0) AS summarised FROM conversations QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) <= 3)")
def _(t: Tables) -> DataFrame:
    return V.chat_window(t.conversations.select("conv_id", "turn"), "conv_id", "turn", 3).select("conv_id", "turn", "place", "summarised")


CLASS = r"""trim(line) <> '' AND NOT regexp_matches(trim(line), '^[IVXLC]+\.?$') AND NOT regexp_matches(trim(line), '^\[?\d+\]?$') AND NOT regexp_matches(trim(line), '^[*_ -]{3,}$') AND NOT regexp_matches(trim(line), '^\(.*\)$') AND NOT regexp_matches(trim(line), '^\[\d+\]')
  AND regexp_matches(line, '[A-Z]') AND NOT regexp_matches(line, '[a-z]')"""


@query("s13_plaintext", f"""WITH l AS (SELECT doc_id, unnest(range(len(s))) AS pos, unnest(s) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS s FROM documents)), c AS (SELECT *, pos = 0 OR ({CLASS}) AS head FROM l),
  p AS (SELECT *, sum(head::INT) OVER (PARTITION BY doc_id ORDER BY pos) AS poem, arg_max(line, pos) FILTER (head) OVER (PARTITION BY doc_id ORDER BY pos) AS title FROM c), d AS (SELECT *, sum((trim(line) = '')::INT) OVER (PARTITION BY doc_id, poem ORDER BY pos) AS stanza FROM p WHERE NOT head)
  SELECT doc_id, poem, trim(title) AS title, stanza, list(line ORDER BY pos) AS lines FROM d WHERE trim(line) <> '' GROUP BY ALL""")
def _(t: Tables) -> DataFrame:
    # The texts themselves: the first line and lines in capitals are titles.
    title = (F.col("pos") == 0) | (line_class(F.col("line")) == "title")
    poems = parse("plaintext", t.documents.select("doc_id", "text"), "doc_id", starts=F.lit(True), is_title=title)
    return poems.select("doc_id", "poem", "title", "stanza", "lines")


@query("r11_quiet_triggers", """WITH e AS (SELECT user_id::VARCHAR AS key, epoch_us(ts) // 1000 AS ms FROM events), g AS (SELECT key, ms, (ms - lag(ms) OVER (PARTITION BY key ORDER BY ms) >= 2700000)::INT AS brk FROM e), s AS (SELECT *, sum(coalesce(brk, 0)) OVER (PARTITION BY key ORDER BY ms) AS i FROM g)
  SELECT key, epoch_ms(max(ms) + 2700000)::TIMESTAMPTZ AS "at", count(*) AS n FROM s GROUP BY key, i HAVING max(ms) + 2700000 <= (SELECT max(ms) FROM e)""")
def _(t: Tables) -> DataFrame:
    """Triggers that timers fire, by account; those still to come when the stream ends are in its state."""
    return drained_in_order(t, lambda stream: T.quiet_triggers(stream, "user_id", "ts"), "user_id")


@query("k09_drop_names", "SELECT id, strftime(ts, '%Y%m%d-%H%M%S') || '-' || replace(stimulus, ' ', '-') || '.md' AS name FROM interactions")
def _(t: Tables) -> DataFrame:
    return t.interactions.select("id", P.drop_name(F.col("ts"), F.col("stimulus")).alias("name"))
