"""Queries for joins (J), aggregates (A), windows (W), chunking (C), retrieval (T, U) and gap repair."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import aggregates as A
from ..operators import automata as M
from ..operators import chunking as C
from ..operators import filters as L
from ..operators import gaps as G
from ..operators import intervals as I
from ..operators import joins as J
from ..operators import retrieval as R
from ..operators import sequence as W
from ..operators.fuzzy_search import best_lines
from .registry import Tables, query

DIST = "round(1 - list_inner_product(v.embedding::DOUBLE[], q.embedding::DOUBLE[]), 9)"
LINES = "l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS pos FROM documents)"


def asked(t: Tables, step: int = 20) -> DataFrame:
    return t.vectors.filter(F.col("vec_id") % step == 0).select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_vector"), F.col("poet").alias("query_poet"))


def rounded(found: DataFrame) -> DataFrame:
    return found.withColumn("distance", F.round("distance", 5) + 0.0)  # no negative zero


@query("j02_cascade", """SELECT i.id, coalesce((SELECT min(doc_id::VARCHAR) FROM documents WHERE 'c' || doc_id = i.chunk_id AND doc_id % 2 = 0), (SELECT min(vec_id::VARCHAR) FROM embeddings WHERE 'poet' || (vec_id % 25) = i.poet)) AS note FROM interactions i WHERE i.id < 100000000""")
def _(t: Tables) -> DataFrame:
    one = t.documents.filter("doc_id % 2 = 0").select(F.concat(F.lit("c"), "doc_id").alias("chunk_id"), F.col("doc_id").cast("string").alias("note"))
    two = t.embeddings.select(F.concat(F.lit("poet"), F.col("vec_id") % 25).alias("poet"), F.col("vec_id").cast("string").alias("note"))
    return J.cascade(t.interactions.select("id", "chunk_id", "poet"), "id", [(one, [F.col("chunk_id")], ["chunk_id"]), (two, [F.col("poet")], ["poet"])], "note").select("id", "note")


@query("j01_j03_enrich", "SELECT p.page_id, l.quality FROM pages p LEFT JOIN labels l ON l.doc_id = p.page_id")
def _(t: Tables) -> DataFrame:
    return J.enrich(t.pages.select("page_id"), t.labels.withColumnRenamed("doc_id", "page_id"), "page_id", ["quality"]).select("page_id", "quality")


@query("j04_j05_semi_anti", "SELECT o_orderkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING') AND o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R')")
def _(t: Tables) -> DataFrame:
    keep = t.customer.filter("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("o_custkey"))
    gone = t.lineitem.filter("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey"))
    return t.orders.join(keep, "o_custkey", "left_semi").join(gone, "o_orderkey", "left_anti").select("o_orderkey")


@query("j06_neighbours", "SELECT a.chunk_id, b.chunk_id AS other FROM chunks a JOIN chunks b ON a.poet = b.poet AND a.title = b.title AND abs(a.chunk_index - b.chunk_index) <= 1")
def _(t: Tables) -> DataFrame:
    return J.neighbours(t.chunks.select("chunk_id", "poet", "title", "chunk_index"), ["poet", "title"], "chunk_index", 1).select("a.chunk_id", F.col("b.chunk_id").alias("other"))


@query("j07_knn", f"SELECT q.vec_id AS query_id, v.vec_id, round({DIST}, 5) + 0.0::DOUBLE AS distance FROM vectors v JOIN vectors q ON q.vec_id % 20 = 0 QUALIFY row_number() OVER (PARTITION BY q.vec_id ORDER BY {DIST}, v.vec_id) <= 5")
def _(t: Tables) -> DataFrame:
    return rounded(R.search(t.vectors, asked(t), 5)).select("query_id", "vec_id", "distance")


@query("j07_filtered_capped_knn", f"""WITH d AS (SELECT q.vec_id AS query_id, v.vec_id, v.type, {DIST} AS distance FROM vectors v JOIN vectors q ON q.vec_id % 20 = 0 AND v.period <> 2 AND v.poet <> 'poet1' AND v.vec_id <> q.vec_id),
  c AS (SELECT *, sum((type = 'prose')::INT) OVER (PARTITION BY query_id ORDER BY distance, vec_id ROWS UNBOUNDED PRECEDING) AS run FROM d)
  SELECT query_id, vec_id, round(distance, 5) + 0.0::DOUBLE AS distance, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, vec_id)::INT AS rank FROM c WHERE type <> 'prose' OR run <= 1) WHERE rank <= 5""")
def _(t: Tables) -> DataFrame:
    corpus = t.vectors.filter("period <> 2").filter(L.not_in_any_case(F.col("poet"), ["poet1"]))
    found = R.search(corpus, asked(t), 5, cap_type="prose", cap=1, differ=(("vec_id", "query_id"),))
    return rounded(found).select("query_id", "vec_id", "distance", "rank")


@query("w06_overfetch_knn", f"""WITH d AS (SELECT q.vec_id AS query_id, v.vec_id, v.type, {DIST} AS distance FROM vectors v JOIN vectors q ON q.vec_id % 20 = 0 QUALIFY row_number() OVER (PARTITION BY q.vec_id ORDER BY {DIST}, v.vec_id) <= 12),
  c AS (SELECT *, sum((type = 'prose')::INT) OVER (PARTITION BY query_id ORDER BY distance, vec_id ROWS UNBOUNDED PRECEDING) AS run FROM d)
  SELECT query_id, vec_id, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, vec_id)::INT AS rank FROM c WHERE type <> 'prose' OR run <= 1) WHERE rank <= 10""")
def _(t: Tables) -> DataFrame:
    return R.search(t.vectors, asked(t), 10, cap_type="prose", cap=1, fetch=12).select("query_id", "vec_id", "rank")


@query("j08_multi_query", f"""WITH d AS (SELECT q.vec_id AS query_id, v.vec_id, {DIST} AS distance FROM vectors v JOIN vectors q ON q.vec_id IN (0, 20, 40) QUALIFY row_number() OVER (PARTITION BY q.vec_id ORDER BY {DIST}, v.vec_id) <= 30)
  SELECT vec_id, round(min(distance), 5) + 0.0::DOUBLE AS distance FROM d GROUP BY vec_id ORDER BY min(distance), vec_id LIMIT 20""")
def _(t: Tables) -> DataFrame:
    return rounded(R.search_multi(t.vectors, asked(t).filter("query_id IN (0, 20, 40)"), 30, 20)).select("vec_id", "distance")


@query("j09_contrast", f"SELECT q.vec_id AS query_id, v.vec_id FROM vectors v JOIN vectors q ON q.vec_id % 20 = 0 AND v.poet <> q.poet QUALIFY row_number() OVER (PARTITION BY q.vec_id ORDER BY {DIST}, v.vec_id) = 1")
def _(t: Tables) -> DataFrame:
    return R.contrast(t.vectors, asked(t)).select("query_id", "vec_id")


@query("j11_postings", """WITH aw AS (SELECT DISTINCT item_id AS a, unnest(regexp_extract_all(lower(text), '[a-z]{3,}')) AS w FROM benchmark), lw AS (SELECT DISTINCT doc_id AS l, unnest(regexp_extract_all(lower(text), '[a-z]{3,}')) AS w FROM documents),
  df AS (SELECT w, count(*) AS n FROM lw GROUP BY w), r AS (SELECT a, w, row_number() OVER (PARTITION BY a ORDER BY n, w) AS r FROM aw JOIN df USING (w) QUALIFY r <= 3), k AS (SELECT a, count(*) AS k FROM r GROUP BY a),
  h AS (SELECT a, l, count(*) AS hit, min(r) AS best, k FROM r JOIN lw USING (w) JOIN k USING (a) GROUP BY a, l, k), f AS (SELECT *, max((hit = k)::INT) OVER (PARTITION BY a) AS full_ FROM h),
  c AS (SELECT a, l FROM f WHERE CASE WHEN full_ = 1 THEN hit = k ELSE best = 1 END QUALIFY count(*) OVER (PARTITION BY a) <= 500)
  SELECT a AS ask_id, l AS line_id, count(*) AS overlap FROM c JOIN aw USING (a) JOIN lw USING (l, w) GROUP BY a, l HAVING count(*) >= 2""")
def _(t: Tables) -> DataFrame:
    return J.line_candidates(t.benchmark.select(F.col("item_id").alias("ask_id"), "text"), t.dealt("documents", "doc_id", "text").withColumnRenamed("doc_id", "line_id"))


@query("j10_fuzzy", """WITH s AS (SELECT a.p_partkey AS ask_id, b.p_partkey AS line_id, floor(100 * (1 - levenshtein(a.p_name || a.p_type, b.p_name || b.p_type)::DOUBLE / greatest(length(a.p_name || a.p_type), length(b.p_name || b.p_type))))::INT AS score FROM part a JOIN part b ON a.p_brand = b.p_brand AND a.p_size // 10 = b.p_size // 10 AND a.p_partkey <> b.p_partkey)
  SELECT ask_id, max(score) AS score, min(line_id) FILTER (score = top) AS line_id FROM (SELECT *, max(score) OVER (PARTITION BY ask_id) AS top FROM s WHERE score >= 70) GROUP BY ask_id""")
def _(t: Tables) -> DataFrame:
    a = t.part.select(F.col("p_partkey").alias("ask_id"), F.concat("p_name", "p_type").alias("text"), "p_brand", F.expr("p_size div 10").alias("sizes"))
    return J.fuzzy_best_of_group(a, ["p_brand", "sizes"], 70, J.whole_ratio, J.lengths_near(70)).select("ask_id", "line_id", "score")


GROUPS = "g AS (SELECT doc_id // 4 AS group_id, doc_id AS id, (row_number() OVER (PARTITION BY doc_id // 4 ORDER BY doc_id) - 1)::INT AS place FROM documents)"


def groups(t: Tables) -> DataFrame:
    return t.documents.groupBy(F.expr("doc_id div 4").alias("group_id")).agg(F.sort_array(F.collect_list("doc_id")).alias("ids"))


@query("j14_group_members", f"WITH {GROUPS} SELECT i.id, g.group_id, g.place FROM interactions i LEFT JOIN g ON g.id = i.id")
def _(t: Tables) -> DataFrame:
    return t.interactions.select("id").join(J.expand_groups(groups(t)), "id", "left").select("id", "group_id", "place")


@query("j15_j20_overlay", "SELECT i.id, CASE WHEN d.lang <> 'en' THEN d.lang ELSE i.stimulus END AS stimulus FROM interactions i LEFT JOIN documents d ON d.doc_id = i.id")
def _(t: Tables) -> DataFrame:
    over = t.documents.select(F.col("doc_id").alias("id"), F.when(F.col("lang") == "en", "").otherwise(F.col("lang")).alias("stimulus"))
    return J.overlay_text(t.interactions.select("id", "stimulus"), over, "id", ["stimulus"])


@query("j01_j15_repeated_keys", "SELECT c.c_custkey, o.kind, coalesce(o.status, c.c_name) AS name FROM customer c LEFT JOIN (SELECT o_custkey, max(o_orderpriority) AS kind, max(o_orderstatus) AS status FROM orders GROUP BY o_custkey) o ON o.o_custkey = c.c_custkey")
def _(t: Tables) -> DataFrame:
    base = J.enrich(t.customer.select("c_custkey", F.col("c_name").alias("name")), t.orders.select(F.col("o_custkey").alias("c_custkey"), F.col("o_orderpriority").alias("kind")), "c_custkey", ["kind"])
    return J.overlay_text(base, t.orders.select(F.col("o_custkey").alias("c_custkey"), F.col("o_orderstatus").alias("name")), "c_custkey", ["name"])


@query("j16_prefixes", """SELECT d.doc_id, min(p.doc_id) AS title FROM (SELECT doc_id, split_part(text, chr(10), 1) AS line FROM documents) d
  JOIN (SELECT doc_id, split_part(text, chr(10), 1)[1:5 + doc_id % 20] AS prefix FROM documents) p ON p.prefix <> '' AND starts_with(d.line, p.prefix) GROUP BY d.doc_id""")
def _(t: Tables) -> DataFrame:
    """Every document's beginning, of 5 to 24 characters, is a prefix; each document gets the first prefix that it starts with."""
    first = F.substring_index("text", "\n", 1)
    start = F.substring(first, F.lit(1), (F.col("doc_id") % 20 + 5).cast("int"))
    prefixes = t.documents.select(start.alias("prefix"), F.col("doc_id").alias("title"), F.col("doc_id").alias("place"))
    return J.first_prefix(t.documents.select("doc_id", first.alias("line")), prefixes).select("doc_id", "title")


@query("j17_between", f"WITH {LINES} SELECT doc_id, pos, max(CASE WHEN length(line) > 120 THEN pos END) OVER (PARTITION BY doc_id ORDER BY pos)::VARCHAR AS name FROM l QUALIFY length(line) <= 120")
def _(t: Tables) -> DataFrame:
    lines = L.lines(t.documents, "doc_id")
    marks = lines.filter("length(line) > 120").select("doc_id", "pos", F.col("pos").cast("string").alias("name"))
    points = lines.filter("length(line) <= 120").select("doc_id", "pos", F.col("line").alias("item"))
    return J.between_marks(marks, points, "doc_id").select("doc_id", "pos", "name")


@query("j18_either_contains", "SELECT p_partkey, CASE WHEN p_brand LIKE '%#1%' OR '#1' LIKE '%' || p_brand || '%' THEN 1 WHEN p_brand LIKE '%3%' THEN 2 ELSE 0 END AS value FROM part")
def _(t: Tables) -> DataFrame:
    names = t.spark.createDataFrame([(0, "#1", 1), (1, "3", 2)], "place int, name string, value int")
    return J.either_contains(t.part.select("p_partkey", "p_brand"), names, "p_brand", 0).select("p_partkey", "value")


@query("j_as_of", "SELECT e.id, (SELECT arg_max(s.stimulus, s.ts) FROM interactions s WHERE s.author = e.author AND s.decision = 'post' AND s.ts <= e.ts) AS seed FROM interactions e WHERE e.decision = 'skip'")
def _(t: Tables) -> DataFrame:
    left = t.interactions.filter("decision = 'skip'").select("id", "author", "ts")
    right = t.interactions.filter("decision = 'post'").select("author", "ts", F.col("stimulus").alias("seed"))
    return J.as_of(left, right, "author", "ts", "seed").select("id", "seed")


@query("a03_a04_cooling", "SELECT poet, n, CASE WHEN n >= 100 THEN poet || ': used ' || n || ' times' END AS warning FROM (SELECT poet, count(*) AS n FROM interactions WHERE decision = 'post' GROUP BY poet) WHERE n >= 5")
def _(t: Tables) -> DataFrame:
    counts = A.used_often(t.interactions.filter("decision = 'post'").groupBy("poet").agg(F.count("*").alias("n")), 5)
    return counts.select("poet", "n", F.when(F.col("n") >= 100, F.format_string("%s: used %d times", "poet", "n")).alias("warning"))


@query("a05_top_poets", "SELECT poet, count(*) AS n FROM interactions GROUP BY poet ORDER BY n DESC, poet LIMIT 5")
def _(t: Tables) -> DataFrame:
    return A.top(t.interactions.groupBy("poet").agg(F.count("*").alias("n")), "poet")


@query("a07_a09_facets", "SELECT poet, count(*) AS n, list_sort(list(DISTINCT title)) AS works, list_sort(list(DISTINCT period)) AS periods FROM chunks GROUP BY poet")
def _(t: Tables) -> DataFrame:
    return A.facets(t.chunks)


@query("a08_corpus_counts", "SELECT 'all' AS facet, NULL AS value, count(*) AS n FROM chunks UNION ALL SELECT 'period', period, count(*) FROM chunks GROUP BY period UNION ALL SELECT 'type', type, count(*) FROM chunks GROUP BY type")
def _(t: Tables) -> DataFrame:
    return A.corpus_counts(t.chunks, ["period", "type"])


@query("a10_length_report", """WITH s AS (SELECT poet, list_sort(list(length(text) // 4)) AS l FROM chunks GROUP BY poet) SELECT poet, len(l) AS n, l[1] AS least, l[len(l) // 4 + 1] AS q25, l[len(l) // 2 + 1] AS q50, l[3 * len(l) // 4 + 1] AS q75, l[-1] AS most, round(list_avg(l), 4) AS mean,
  len(list_filter(l, lambda x: x < 20)) AS small, len(list_filter(l, lambda x: x > 500)) AS large FROM s""")
def _(t: Tables) -> DataFrame:
    return A.length_report(t.chunks, "poet", X.estimated_tokens(F.col("text")))


@query("a10_repeats", "SELECT count(*) - count(DISTINCT text) AS n FROM documents")
def _(t: Tables) -> DataFrame:
    return A.repeated_texts(t.documents)


@query("a12_status", "SELECT event_type, count(*) FILTER (value > 50) AS high, count(*) FILTER (value <= 50) AS low FROM events GROUP BY event_type")
def _(t: Tables) -> DataFrame:
    return A.status_counts(t.events, "event_type", {"high": "value > 50", "low": "value <= 50"})


@query("a13_nearest", "SELECT user_id, min(value) AS value, arg_min(event_id, (value, event_id)) AS event_id FROM events GROUP BY user_id")
def _(t: Tables) -> DataFrame:
    return A.nearest_of_each(t.events, "user_id", "value", ["event_id"])


@query("a14_last_of_day", "SELECT day, arg_max(id, (ts, id)) AS id FROM interactions GROUP BY day")
def _(t: Tables) -> DataFrame:
    return t.interactions.groupBy("day").agg(F.max_by("id", F.struct("ts", "id")).alias("id"))


@query("a15_by_day", "SELECT day, list(id ORDER BY ts, id) AS items FROM interactions WHERE decision = 'post' GROUP BY day")
def _(t: Tables) -> DataFrame:
    return A.by_day(t.interactions.filter("decision = 'post'"), "day", F.col("id"), ["ts", "id"])


@query("a16_composites", f"WITH {GROUPS} SELECT group_id, list(g.id ORDER BY place) AS parts, max(ts) AS latest, arg_min(stimulus, place) AS stimulus FROM g JOIN interactions i ON i.id = g.id GROUP BY group_id")
def _(t: Tables) -> DataFrame:
    return A.composites(J.expand_groups(groups(t)).join(t.interactions.select("id", "ts", "stimulus"), "id"))


@query("a11_a18_sizes", "SELECT source, count(*) AS texts, sum(len(string_split(text, chr(10))))::BIGINT AS lines, sum(length(text))::BIGINT AS chars FROM documents GROUP BY source")
def _(t: Tables) -> DataFrame:
    return A.work_sizes(t.documents, "source")


@query("a11_surnames", "SELECT CASE WHEN n_name LIKE '%5%' THEN n_name ELSE 'Mr ' || n_name END AS surname, count(*) AS n FROM customer JOIN nation ON n_nationkey = c_nationkey GROUP BY 1 UNION ALL SELECT NULL, count(*) FROM customer WHERE c_custkey % 1000 = 0 HAVING count(*) > 0")
def _(t: Tables) -> DataFrame:
    """Customers as authors, "Surname, First" or without a comma, some null."""
    named = t.customer.join(t.nation, F.col("c_nationkey") == F.col("n_nationkey"))
    author = F.when(F.contains("n_name", F.lit("5")), F.concat(F.lit(" "), "n_name", F.lit(" , "), "c_name")).otherwise(F.concat(F.lit("Mr "), "n_name", F.lit(" ")))
    authors = named.select(author.alias("author")).unionByName(t.customer.filter("c_custkey % 1000 = 0").select(F.lit(None).cast("string").alias("author")))
    return A.surnames(authors, "author")


@query("a20_joined", "SELECT conv_id, string_agg(role, ' | ' ORDER BY turn) AS joined FROM conversations GROUP BY conv_id")
def _(t: Tables) -> DataFrame:
    return A.ordered_text(t.conversations, "conv_id", "role", "turn", " | ")


@query("a21_tokens", "SELECT source, sum(tokens_in + tokens_out)::BIGINT AS tokens FROM interactions GROUP BY source")
def _(t: Tables) -> DataFrame:
    return t.interactions.groupBy("source").agg(F.sum(F.col("tokens_in") + F.col("tokens_out")).alias("tokens"))


@query("a23_first_titles", "SELECT min(doc_id) AS doc_id, lang FROM documents GROUP BY lang, lower(source)")
def _(t: Tables) -> DataFrame:
    return A.first_of_each(t.documents.select("doc_id", "lang", "source"), F.struct(F.col("lang"), F.lower("source")), ["doc_id"]).select("doc_id", "lang")


@query("w01_prev_next", "SELECT id, lag(id) OVER (ORDER BY ts DESC, id DESC) AS previous, lead(id) OVER (ORDER BY ts DESC, id DESC) AS next FROM interactions WHERE decision = 'post'")
def _(t: Tables) -> DataFrame:
    rows = t.interactions.filter("decision = 'post'").select("id", "day", "ts")
    return W.neighbours_of(rows, [], ["ts", "id"], "id", F.col("day"), descending=True).select("id", "previous", "next")


@query("w02_part_numerals", f"WITH {GROUPS} SELECT id, ['I', 'II', 'III', 'IV'][place + 1] AS part FROM g")
def _(t: Tables) -> DataFrame:
    return J.expand_groups(groups(t)).select("id", X.int_to_roman(F.col("place") + 1).alias("part"))


@query("w03_repeat_numbers", "SELECT doc_id, id || CASE WHEN n = 1 THEN '' ELSE '-dup' || (n - 1) END AS unique_id FROM (SELECT doc_id, id, row_number() OVER (PARTITION BY id ORDER BY doc_id) AS n FROM (SELECT doc_id, source || '-' || lower(regexp_extract(text, '^[A-Za-z]{0,3}')) AS id FROM documents))")
def _(t: Tables) -> DataFrame:
    """Ids as chunks have them, source and beginning of the text; those of nearby texts collide."""
    ids = F.concat_ws("-", "source", F.lower(F.regexp_extract("text", "^[A-Za-z]{0,3}", 0)))
    return W.number_repeats(t.documents.select("doc_id", ids.alias("id")), "id", ["doc_id"]).select("doc_id", "unique_id")


@query("w04_distinct_texts", "SELECT doc_id FROM documents QUALIFY row_number() OVER (PARTITION BY text ORDER BY source, doc_id) = 1")
def _(t: Tables) -> DataFrame:
    return A.first_of_each(t.documents.select("source", "doc_id", F.sha2("text", 256).alias("digest")), F.col("digest"), ["source", "doc_id"]).select("doc_id")


@query("w07_all_but_last", "SELECT conv_id, turn FROM conversations QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) > 3")
def _(t: Tables) -> DataFrame:
    from ..operators.eventlog import older_than_newest

    return older_than_newest(t.conversations.select("conv_id", "turn"), "conv_id", 3, "turn")


@query("w08_blanks_before", "WITH l AS (SELECT doc_id, unnest(string_split(replace(text, '. ', '.' || chr(10) || chr(10) || chr(10)), chr(10))) AS line, unnest(range(len(string_split(replace(text, '. ', '.' || chr(10) || chr(10) || chr(10)), chr(10))))) AS pos FROM documents) SELECT doc_id, pos, pos - coalesce(max(CASE WHEN trim(line) <> '' THEN pos END) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), -1) - 1 AS blanks FROM l QUALIFY trim(line) <> ''")
def _(t: Tables) -> DataFrame:
    spaced = t.documents.select("doc_id", F.replace("text", F.lit(". "), F.lit(".\n\n\n")).alias("text"))
    return W.blanks_before(L.lines(spaced, "doc_id"), "doc_id").filter("trim(line) <> ''").select("doc_id", "pos", "blanks")


@query("w09_forward_fill", f"WITH {LINES} SELECT doc_id, pos, max(CASE WHEN length(line) < 40 THEN lpad(pos::VARCHAR, 6, '0') || line END) OVER (PARTITION BY doc_id ORDER BY pos) AS heading FROM l")
def _(t: Tables) -> DataFrame:
    lines = L.lines(t.documents, "doc_id")
    return W.forward_fill(lines, "doc_id", "pos", F.length("line") < 40, F.concat(F.lpad(F.col("pos").cast("string"), 6, "0"), "line"), "heading").select("doc_id", "pos", "heading")


@query("w10_stanzas", f"""WITH {LINES}, b AS (SELECT *, length(line) < 60 AS brk FROM l), i AS (SELECT *, sum(brk::INT) OVER (PARTITION BY doc_id ORDER BY pos) AS island FROM b),
  s AS (SELECT doc_id, island, list(line ORDER BY pos) AS lines FROM i WHERE NOT brk GROUP BY doc_id, island) SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY island)::INT AS stanza, len(lines) AS n, md5(array_to_string(lines, chr(10))) AS digest FROM s""")
def _(t: Tables) -> DataFrame:
    cut = W.stanzas(L.lines(t.documents, "doc_id"), "doc_id", F.length("line") < 60)
    return cut.select("doc_id", "stanza", F.size("lines").cast("long").alias("n"), F.md5(F.array_join("lines", "\n")).alias("digest"))


@query("w12_trailing_usage", "SELECT id, count(*) OVER (PARTITION BY poet ORDER BY ts RANGE BETWEEN INTERVAL 48 HOUR PRECEDING AND CURRENT ROW) AS n_trailing FROM interactions WHERE decision = 'post'")
def _(t: Tables) -> DataFrame:
    from ..operators.eventlog import trailing_count

    return trailing_count(t.interactions.filter("decision = 'post'").select("id", "ts", "poet"), 48 * 3600, "poet").select("id", "n_trailing")


@query("w13_since_last", "SELECT id, epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY author ORDER BY ts) AS since_us FROM interactions")
def _(t: Tables) -> DataFrame:
    return W.cooldown_gaps(t.interactions.select("id", "author", "ts"), "ts", "author").select("id", "since_us")


@query("w13_since_last_of_all", "SELECT id, epoch_us(ts) - lag(epoch_us(ts)) OVER (ORDER BY ts) AS since_us FROM (SELECT max(id) AS id, ts FROM interactions GROUP BY ts)")
def _(t: Tables) -> DataFrame:
    return W.cooldown_gaps(t.interactions.groupBy("ts").agg(F.max("id").alias("id")), "ts").select("id", "since_us")


@query("w14_quiet_periods", """WITH g AS (SELECT author, ts, (ts - lag(ts) OVER (PARTITION BY author ORDER BY ts) >= INTERVAL 45 MINUTE)::INT AS brk FROM interactions), s AS (SELECT *, sum(coalesce(brk, 0)) OVER (PARTITION BY author ORDER BY ts) AS k FROM g)
  SELECT author, min(ts) AS start, max(ts) + INTERVAL 45 MINUTE AS "end", count(*) AS n FROM s GROUP BY author, k""")
def _(t: Tables) -> DataFrame:
    return W.quiet_periods(t.interactions.select("author", "ts"), "ts", "author", "45 minutes")


@query("w15_w19_regions", f"""WITH {LINES}, e AS (SELECT *, length(line) % 7 = 0 AS o, length(line) % 5 = 0 AS c FROM l), p AS (SELECT *, max(CASE WHEN o OR c THEN pos * 2 + (o AND NOT c)::INT END) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS last FROM e)
  SELECT doc_id, pos FROM p WHERE NOT (o OR coalesce(last % 2 = 1, false))""")
def _(t: Tables) -> DataFrame:
    return W.outside_regions(L.lines(t.documents, "doc_id"), "doc_id", "pos", F.length("line") % 7 == 0, F.length("line") % 5 == 0).select("doc_id", "pos")


@query("w16_dewrap", f"WITH {LINES}, i AS (SELECT *, sum((NOT regexp_matches(line, '^[a-z]'))::INT) OVER (PARTITION BY doc_id ORDER BY pos) AS island FROM l) SELECT doc_id, island::BIGINT AS island, md5(string_agg(line, ' ' ORDER BY pos)) AS digest FROM i GROUP BY doc_id, island")
def _(t: Tables) -> DataFrame:
    return W.dewrap(L.lines(t.documents, "doc_id"), "doc_id").select("doc_id", F.col("island").cast("long").alias("island"), F.md5("line").alias("digest"))


@query("w17_merge_titles", """WITH p AS (SELECT o_custkey AS k, o_orderkey AS pos, o_orderpriority AS title, (o_orderkey % 5)::INT AS n FROM orders), m AS (SELECT *, coalesce(title = lag(title) OVER (PARTITION BY k ORDER BY pos), false) AS same FROM p), i AS (SELECT *, sum((NOT same)::INT) OVER (PARTITION BY k ORDER BY pos) AS island FROM m)
  SELECT k, island::BIGINT AS island, min(title) AS title, count(*) AS parts, sum(n)::BIGINT AS n_lines FROM i GROUP BY k, island HAVING sum(n) > 1""")
def _(t: Tables) -> DataFrame:
    poems = t.orders.select(F.col("o_custkey").alias("k"), F.col("o_orderkey").alias("pos"), F.col("o_orderpriority").alias("title"), (F.col("o_orderkey") % 5).alias("n_lines"))
    return W.merge_same_titles(poems, "k", "pos").withColumn("island", F.col("island").cast("long"))


@query("w18_outermost", "WITH s AS (SELECT doc_id // 50 AS k, doc_id % 50 AS start, doc_id % 50 + 1 + doc_id % 3 AS stop FROM documents) SELECT * FROM s QUALIFY coalesce(start >= max(stop) OVER (PARTITION BY k ORDER BY start, stop DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), true)")
def _(t: Tables) -> DataFrame:
    spans = t.documents.select(F.expr("doc_id div 50").alias("k"), (F.col("doc_id") % 50).alias("start"), (F.col("doc_id") % 50 + 1 + F.col("doc_id") % 3).alias("stop"))
    return W.outermost(spans, "k")


SPANS = "s AS (SELECT l_suppkey AS k, l_orderkey % 900 AS start, l_orderkey % 900 + (l_quantity::BIGINT * l_linenumber) % 60 AS stop, l_orderkey * 10 + l_linenumber AS id FROM lineitem)"


def any_spans(t: Tables) -> DataFrame:
    """Spans that overlap, nest, touch, are equal or empty, some 600 of a key."""
    start = F.col("l_orderkey") % 900
    return t.lineitem.select(F.col("l_suppkey").alias("k"), start.alias("start"), (start + (F.col("l_quantity").cast("long") * F.col("l_linenumber")) % 60).alias("stop"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"))


@query("w18_any_spans", f"WITH {SPANS} SELECT id, start, stop FROM s WHERE NOT EXISTS (SELECT 1 FROM s o WHERE o.k = s.k AND o.start <= s.start AND o.stop >= s.stop AND (o.start < s.start OR o.stop > s.stop) AND NOT (s.start = s.stop AND o.stop = s.start))")
def _(t: Tables) -> DataFrame:
    return I.outermost(any_spans(t), "k").select("id", "start", "stop")


@query("j17_stabbing", f"WITH {SPANS} SELECT o_orderkey, count(*) AS spans, max(stop) AS latest FROM orders JOIN s ON s.k = o_custkey % 100 AND s.start <= o_orderkey % 900 AND o_orderkey % 900 < s.stop GROUP BY o_orderkey")
def _(t: Tables) -> DataFrame:
    points = t.orders.select("o_orderkey", (F.col("o_custkey") % 100).alias("k"), (F.col("o_orderkey") % 900).alias("pos"))
    return I.stabbed(points, any_spans(t), "k").groupBy("o_orderkey").agg(F.sum("spans").alias("spans"), F.max("latest").alias("latest"))


@query("w20_latch", f"WITH {LINES} SELECT doc_id, pos FROM l QUALIFY max((length(line) > 200)::INT) OVER (PARTITION BY doc_id ORDER BY pos) = 0")
def _(t: Tables) -> DataFrame:
    return W.until_latch(L.lines(t.documents, "doc_id"), "doc_id", "pos", F.length("line") > 200).select("doc_id", "pos")


@query("w10_w15_w20_one_text", """WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS pos FROM documents),
  e AS (SELECT *, length(line) < 60 AS brk, length(line) % 7 = 0 AS o, length(line) % 5 = 0 AS c FROM l),
  s AS (SELECT *, NOT brk AND coalesce(lag(brk) OVER w, true) AS starts, max(CASE WHEN o OR c THEN (doc_id * 100000 + pos) * 2 + (o AND NOT c)::INT END) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS last, max((length(line) > 3000)::INT) OVER w AS latched FROM e WINDOW w AS (ORDER BY doc_id, pos))
  SELECT doc_id, pos, CASE WHEN NOT brk THEN sum(starts::INT) OVER (ORDER BY doc_id, pos)::BIGINT END AS stanza, NOT (o OR coalesce(last % 2 = 1, false)) AS outside, latched = 0 AS before_latch FROM s""")
def _(t: Tables) -> DataFrame:
    """All documents as one text: stanzas, regions and a latch over many partitions of it."""
    size = F.length("line")
    lines = L.lines(t.documents, "doc_id").select("doc_id", "pos", size.alias("size"), F.lit("all").alias("one"))
    order, n = ["doc_id", "pos"], F.col("size")
    opens, closes, breaks = n % 7 == 0, n % 5 == 0, n < 60
    read = M.run(lines, "one", order, breaks.cast("int"), M.STRETCHES).withColumnRenamed("counted", "stanza").drop("state", "state_after")
    read = M.run(read, "one", order, F.when(closes, 2).when(opens, 1).otherwise(0), M.REGIONS).withColumn("outside", ~opens & (F.col("state") == 0)).drop("state", "state_after", "counted")
    read = M.run(read, "one", order, F.when(n > 3000, 1).otherwise(0), M.LATCH)
    return read.select("doc_id", "pos", F.when(~breaks, F.col("stanza")).alias("stanza"), "outside", (F.col("state_after") == 0).alias("before_latch"))


def stanza_fold(source: str, name: str, least: int = 50, most: int = 300) -> str:
    """SQL of C03 over ``source`` (k, s: texts): CTEs, of which ``name`` has the bounds (k, a, b). One step for each stanza."""
    return f"""{name}_f(k, i, start, chars, n, a, b) AS (SELECT k, 0, 1, 0, 0, NULL::INT, NULL::INT FROM {source} UNION ALL
    SELECT k, i, CASE WHEN over_ THEN i WHEN closes THEN i + 1 ELSE start END, CASE WHEN over_ THEN size WHEN closes THEN 0 ELSE grown END, CASE WHEN over_ THEN 1 WHEN closes THEN 0 ELSE n + 1 END,
      CASE WHEN closes THEN start END, CASE WHEN over_ THEN i - 1 WHEN closes THEN i END
    FROM (SELECT *, closes AND grown // 4 > {most} AND n > 0 AS over_ FROM (SELECT *, grown // 4 >= {least} OR i = total AS closes
      FROM (SELECT f.k, f.i + 1 AS i, f.start, f.n, length(d.s[f.i + 1])::INT AS size, len(d.s) AS total, CASE WHEN f.n > 0 THEN f.chars + 1 + length(d.s[f.i + 1]) ELSE length(d.s[f.i + 1]) END::INT AS grown FROM {name}_f f JOIN {source} d ON d.k = f.k WHERE f.i < len(d.s))))),
  {name} AS (SELECT k, a, b FROM {name}_f WHERE a IS NOT NULL UNION ALL SELECT f.k, f.start, len(d.s)::INT FROM {name}_f f JOIN {source} d ON d.k = f.k WHERE f.i = len(d.s) AND f.n > 0)"""


def sentence_fold(source: str, name: str, most: int) -> str:
    """SQL of C04 in the same form: groups of lines that close at a sentence's end."""
    return f"""{name}_f(k, i, start, chars, a, b) AS (SELECT k, 0, 1, 0, NULL::INT, NULL::INT FROM {source} UNION ALL
    SELECT k, i, CASE WHEN closes THEN i + 1 ELSE start END, CASE WHEN closes THEN 0 ELSE grown END, CASE WHEN closes THEN start END, CASE WHEN closes THEN i END
    FROM (SELECT *, grown // 4 >= {most} AND regexp_matches(rtrim(line, ' '), '[.!?;]$') AS closes
      FROM (SELECT f.k, f.i + 1 AS i, f.start, d.s[f.i + 1] AS line, CASE WHEN f.start < f.i + 1 THEN f.chars + 1 + length(d.s[f.i + 1]) ELSE length(d.s[f.i + 1]) END::INT AS grown FROM {name}_f f JOIN {source} d ON d.k = f.k WHERE f.i < len(d.s)))),
  {name} AS (SELECT k, a, b FROM {name}_f WHERE a IS NOT NULL UNION ALL SELECT f.k, f.start, len(d.s)::INT FROM {name}_f f JOIN {source} d ON d.k = f.k WHERE f.i = len(d.s) AND f.start <= len(d.s))"""


TEXT_LINES = "d AS (SELECT doc_id AS k, string_split(text, chr(10)) AS s FROM documents)"
CHUNKS = "SELECT e.k AS doc_id, (row_number() OVER (PARTITION BY e.k ORDER BY a) - 1)::INT AS chunk_index, a AS first, b AS last, md5(array_to_string(d.s[a:b], SEP)) AS chunk_text FROM e JOIN d ON d.k = e.k"


@query("c03_stanza_packing", f"WITH RECURSIVE {TEXT_LINES}, {stanza_fold('d', 'e')} " + CHUNKS.replace("SEP", "chr(10)"))
def _(t: Tables) -> DataFrame:
    rows = t.documents.select("doc_id", F.split("text", "\n", -1).alias("lines"))
    bounds = C.pack_stanzas(F.transform("lines", lambda x: F.length(x)), 50, 300)
    return rows.withColumn("b", bounds).select("doc_id", F.inline(C.cut(F.col("lines"), F.col("b"), "\n"))).withColumn("chunk_text", F.md5("chunk_text"))


@query("c04_sentence_split", f"WITH RECURSIVE {TEXT_LINES}, {sentence_fold('d', 'e', 100)} " + CHUNKS.replace("SEP", "chr(10)"))
def _(t: Tables) -> DataFrame:
    rows = t.documents.select("doc_id", F.split("text", "\n", -1).alias("lines"))
    return rows.withColumn("b", C.split_sentences(F.col("lines"), 100)).select("doc_id", F.inline(C.cut(F.col("lines"), F.col("b"), "\n"))).withColumn("chunk_text", F.md5("chunk_text"))


@query("c05_prose_packing", f"""WITH RECURSIVE {TEXT_LINES}, f(k, i, start, chars, a, b) AS (SELECT k, 0, 1, 0, NULL::INT, NULL::INT FROM d UNION ALL
    SELECT k, i, CASE WHEN closes THEN i ELSE start END, CASE WHEN closes THEN size ELSE grown END, CASE WHEN closes THEN start END, CASE WHEN closes THEN i - 1 END FROM (SELECT *, grown // 4 > 500 AND chars > 0 AS closes
      FROM (SELECT f.k, f.i + 1 AS i, f.start, f.chars, length(d.s[f.i + 1])::INT AS size, CASE WHEN f.chars > 0 THEN f.chars + 2 + length(d.s[f.i + 1]) ELSE length(d.s[f.i + 1]) END::INT AS grown FROM f JOIN d ON d.k = f.k WHERE f.i < len(d.s)))),
  n AS (SELECT k, a, b, row_number() OVER (PARTITION BY k ORDER BY a) AS r, count(*) OVER (PARTITION BY k) AS m FROM f WHERE a IS NOT NULL), z AS (SELECT f.k, f.start, f.chars // 4 < 80 AS short, len(d.s)::INT AS total FROM f JOIN d ON d.k = f.k WHERE f.i = len(d.s) AND len(d.s) > 0),
  e AS (SELECT n.k, a, CASE WHEN short AND r = m THEN total ELSE b END AS b FROM n JOIN z ON z.k = n.k UNION ALL SELECT z.k, start, total FROM z WHERE NOT (short AND EXISTS (SELECT 1 FROM n WHERE n.k = z.k))) """ + CHUNKS.replace("SEP", "chr(10) || chr(10)"))
def _(t: Tables) -> DataFrame:
    rows = t.documents.select("doc_id", F.split("text", "\n", -1).alias("paragraphs"))
    return C.chunk_prose(rows, "doc_id", "paragraphs").withColumn("chunk_text", F.md5("chunk_text"))


@query("c01_c02_c07_chunk_poems", f"""WITH RECURSIVE {LINES}, cut AS (SELECT *, sum((length(line) < 60)::INT) OVER (PARTITION BY doc_id ORDER BY pos) AS island FROM l), st AS (SELECT doc_id, island, list(line ORDER BY pos) AS lines FROM cut WHERE length(line) >= 60 GROUP BY doc_id, island),
  poem AS (SELECT doc_id AS k, list(lines ORDER BY island) AS st, list_transform(list(lines ORDER BY island), lambda x: len(x)) AS sz, list_transform(list(lines ORDER BY island), lambda x: array_to_string(x, chr(10))) AS s FROM st GROUP BY doc_id),
  routed AS (SELECT *, list_sum(sz)::INT AS total, array_to_string(s, chr(10)) AS whole, CASE WHEN len(sz) = 1 AND list_sum(sz) = 14 THEN 'sonnet' WHEN length(array_to_string(s, chr(10))) // 4 <= 300 THEN 'short' WHEN len(sz) = 1 THEN 'blank_verse' ELSE 'stanzaic' END AS strategy FROM poem),
  packed AS (SELECT k, s, sz FROM routed WHERE strategy = 'stanzaic'), {stanza_fold('packed', 'pe')},
  single AS (SELECT k, st[1] AS s FROM routed WHERE strategy = 'blank_verse'), {sentence_fold('single', 'se', 300)}
  SELECT k AS doc_id, strategy, 0 AS chunk_index, 1 AS first_line, total AS last_line, md5(whole) AS chunk_text FROM routed WHERE strategy IN ('sonnet', 'short')
  UNION ALL SELECT pe.k, 'stanzaic', (row_number() OVER (PARTITION BY pe.k ORDER BY a) - 1)::INT, coalesce(list_sum(sz[1:a - 1]), 0)::INT + 1, list_sum(sz[1:b])::INT, md5(array_to_string(packed.s[a:b], chr(10))) FROM pe JOIN packed ON packed.k = pe.k
  UNION ALL SELECT se.k, 'blank_verse', (row_number() OVER (PARTITION BY se.k ORDER BY a) - 1)::INT, a, b, md5(array_to_string(single.s[a:b], chr(10))) FROM se JOIN single ON single.k = se.k""")
def _(t: Tables) -> DataFrame:
    stanzas = W.stanzas(L.lines(t.documents, "doc_id"), "doc_id", F.length("line") < 60)
    poems = stanzas.groupBy("doc_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("stanza", "lines"))), lambda s: s["lines"]).alias("stanzas"))
    poems = poems.withColumn("form", X.form(F.transform("stanzas", lambda s: F.size(s)), F.lit(None).cast("string")))
    return C.chunk_poems(poems, "doc_id").withColumn("chunk_text", F.md5("chunk_text"))


SLUG = "regexp_replace(substr(regexp_replace(regexp_replace(lower(trim({0})), '[^0-9A-Za-z_\\s-]', '', 'g'), '[\\s_-]+', '-', 'g'), 1, 60), '^-+|-+$', '', 'g')"


@query("c06_chunk_ids", f"""WITH n AS (SELECT chunk_id, {SLUG.format('poet')} || '-' || substr({SLUG.format("'A work, called ' || title || ' (1700)'")}, 1, 20) || '-' || CASE WHEN chunk_id % 3 = 0 THEN 'untitled' ELSE substr({SLUG.format("'The ' || period || ' song'")}, 1, 20) END || '-' || lpad((chunk_index % 5)::VARCHAR, 3, '0') AS name FROM chunks)
  SELECT chunk_id, name || CASE WHEN r = 1 THEN '' ELSE '-dup' || (r - 1) END AS name FROM (SELECT *, row_number() OVER (PARTITION BY name ORDER BY chunk_id) AS r FROM n)""")
def _(t: Tables) -> DataFrame:
    title = F.when(F.col("chunk_id") % 3 == 0, F.lit("")).otherwise(F.concat(F.lit("The "), "period", F.lit(" song")))
    name = C.chunk_id(F.col("poet"), F.concat(F.lit("A work, called "), "title", F.lit(" (1700)")), title, F.col("chunk_index") % 5)
    return C.unique_ids(t.chunks.select("chunk_id", name.alias("name")), "name", ["chunk_id"])


@query("t03_browse", "SELECT chunk_id, title, chunk_index FROM chunks WHERE poet = 'src3' ORDER BY title, chunk_index, chunk_id LIMIT 50")
def _(t: Tables) -> DataFrame:
    return R.browse(t.chunks, "src3", 80).select("chunk_id", "title", "chunk_index")


@query("t04_random_rows", "SELECT doc_id, source FROM documents WHERE source <> 'src1' ORDER BY md5('7:' || doc_id), doc_id LIMIT 5")
def _(t: Tables) -> DataFrame:
    return R.random_rows(t.documents.filter("source <> 'src1'").select("doc_id", "source"), 5, 7, "doc_id")


@query("t05_random_of_deck", "SELECT n_nationkey AS place, n_name AS text FROM nation ORDER BY md5('3:' || n_nationkey), n_nationkey LIMIT 1")
def _(t: Tables) -> DataFrame:
    return R.random_rows(t.nation.select(F.col("n_nationkey").alias("place"), F.col("n_name").alias("text")), 1, 3, "place")


@query("v04_random_passage", "SELECT chunk_id FROM chunks WHERE poet = 'src2' ORDER BY md5('11:' || chunk_id), chunk_id LIMIT 1")
def _(t: Tables) -> DataFrame:
    from .service import random_passage

    return random_passage(t.chunks, 11, "src2").select("chunk_id")


@query("t06_t07_context_order", "SELECT chunk_id, row_number() OVER (PARTITION BY poet, title ORDER BY chunk_index, chunk_id) AS place FROM chunks")
def _(t: Tables) -> DataFrame:
    place = F.row_number().over(Window.partitionBy("poet", "title").orderBy("chunk_index", "chunk_id")).cast("long")
    return t.chunks.select("chunk_id", place.alias("place"))


@query("u01_u04_set_operations", "SELECT doc_id AS id FROM labels EXCEPT SELECT page_id FROM pages UNION (SELECT doc_id FROM labels INTERSECT SELECT vec_id FROM embeddings)")
def _(t: Tables) -> DataFrame:
    labelled = t.labels.select(F.col("doc_id").alias("id"))
    return labelled.subtract(t.pages.select("page_id")).union(labelled.intersect(t.embeddings.select("vec_id"))).distinct()


@query("s26_dictionary", """WITH w AS (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '[a-z]+')) AS w FROM benchmark), e AS (SELECT unnest(['s','es','ed','er','est','ing','ly','th','st']) AS e)
  SELECT w AS word FROM w UNION SELECT w || e FROM w, e UNION SELECT regexp_replace(w, 'e$', '') || e FROM w, e WHERE e[1] IN ('e', 'i')""")
def _(t: Tables) -> DataFrame:
    return G.dictionary(t.benchmark.select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), F.lit(0))).alias("word")))


def gap_rows(t: Tables) -> tuple[DataFrame, DataFrame]:
    """Gaps made in the benchmark: one letter of the fourth word is lost where it has four letters or more."""
    words = t.benchmark.select("item_id", "text", F.split("text", " ").alias("w")).withColumn("word", F.regexp_extract(F.get("w", F.lit(3)), "^[A-Za-z]+", 0)).filter("length(word) >= 4")
    hole = F.concat(F.substring("word", 1, 2), F.lit(G.GAP), F.substring("word", F.lit(4), F.length("word")))
    context = F.concat_ws(" ", F.slice("w", 1, 3), F.concat(hole, F.substring(F.get("w", F.lit(3)), F.length("word") + 1, F.lit(9))), F.slice("w", 5, 3))
    gaps = words.select(F.col("item_id").alias("gap_id"), context.alias("context"), F.lit(1).alias("letters"), F.col("text"), F.substring("word", 3, 1).alias("lost"))
    return gaps, t.benchmark.select(F.explode(F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), F.lit(0)))).alias("word")).distinct()


GAPS = r"""WITH g AS (SELECT item_id, lower(regexp_extract(string_split(text, ' ')[4], '^[A-Za-z]+')) AS w FROM benchmark WHERE length(regexp_extract(string_split(text, ' ')[4], '^[A-Za-z]+')) >= 4),
  d AS (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '[a-z]+')) AS word FROM benchmark), c AS (SELECT item_id, d.word[3] AS fill FROM g JOIN d ON length(d.word) = length(w) AND d.word[1:2] = w[1:2] AND d.word[4:] = w[4:])"""


SCORED = GAPS + r""", p AS (SELECT DISTINCT 'ab' AS w), k AS (SELECT item_id, d.word, d.word[3] AS fill,
    1 + 10 * len(list_filter(range(1, len(d.word)), lambda i: list_contains(BAD, d.word[i:i + 1]))) - regexp_matches(d.word, '(tion|ness|ment|ous|ing|ght|ble)$')::INT AS score
    FROM g JOIN d ON length(d.word) = length(w) AND d.word[1:2] = w[1:2] AND d.word[4:] = w[4:])""".replace("BAD", "[" + ", ".join(f"'{p}'" for p in G.BAD_PAIRS) + "]")


@query("x30_x31_letter_fills", SCORED + " SELECT item_id AS gap_id, arg_min(fill, (score, fill)) AS fill FROM k GROUP BY item_id HAVING count(*) <= 3")
def _(t: Tables) -> DataFrame:
    gaps, words = gap_rows(t)
    return G.letter_fills(gaps, words, [], 1)


PREFERRED = "(SELECT min(word) AS word FROM d GROUP BY length(word))"


@query("x31_preferred_fills", SCORED + f" SELECT item_id AS gap_id, arg_min(fill, (CASE WHEN word IN {PREFERRED} THEN 0 ELSE score END, fill)) AS fill FROM k GROUP BY item_id HAVING count(*) <= 3 OR bool_or(word IN {PREFERRED})")
def _(t: Tables) -> DataFrame:
    """Each length's first word is preferred: it fills a gap whatever else fits."""
    gaps, words = gap_rows(t)
    preferred = [r.word for r in words.groupBy(F.length("word")).agg(F.min("word").alias("word")).collect()]  # a word for each length
    return G.letter_fills(gaps, words, preferred, 1)


@query("x32_x34_clean_line_fill", r"SELECT item_id AS gap_id, regexp_extract(string_split(text, ' ')[4], '^[A-Za-z]+')[3] AS fill, array_to_string(string_split(text, ' ')[1:7], ' ') AS patched FROM benchmark WHERE length(regexp_extract(string_split(text, ' ')[4], '^[A-Za-z]+')) >= 4")
def _(t: Tables) -> DataFrame:
    gaps, _ = gap_rows(t)
    filled = gaps.withColumn("fill", G.fill_from_line(F.col("context"), F.col("text")))
    return filled.select("gap_id", "fill", G.patch(F.col("context"), F.col("fill")).alias("patched"))


def lost_words(t: Tables) -> tuple[DataFrame, DataFrame]:
    """Gaps made in the benchmark, (ask_id, context, text): the fourth word of the first line is lost; and all its lines, (item, pos, line_id, text)."""
    line = L.lines(t.benchmark.select(F.col("item_id").alias("item"), "text"), "item").select("item", "pos", (F.col("item") * 10_000 + F.col("pos")).alias("line_id"), F.trim("line").alias("text"))
    words = line.filter("pos = 0").select("item", F.split("text", " ").alias("w")).filter("size(w) >= 8")
    context = F.concat_ws(" ", F.slice("w", 1, 3), F.lit(G.GAP), F.slice("w", 5, 4))
    return words.select(F.col("item").alias("ask_id"), context.alias("context"), F.replace(context, F.lit(G.GAP), F.lit("")).alias("text")), line


LOST = r"""l AS (SELECT item_id AS item, unnest(range(len(s))) AS pos, trim(unnest(s)) AS text FROM (SELECT item_id, string_split(text, chr(10)) AS s FROM benchmark)), w AS (SELECT item, string_split(text, ' ') AS w FROM l WHERE pos = 0 AND len(string_split(text, ' ')) >= 8),
  a AS (SELECT item AS ask_id, array_to_string(w[1:3], ' ') AS pre, array_to_string(w[5:8], ' ') AS post, w FROM w), q AS (SELECT *, pre || '  ' || post AS asked FROM a),
  pairs AS (SELECT ask_id, item, pos, asked, text FROM q, l WHERE text <> ''), sl AS (SELECT *, CASE WHEN length(asked) <= length(text) THEN asked ELSE text END AS short, CASE WHEN length(asked) <= length(text) THEN text ELSE asked END AS long FROM pairs),
  mk AS (SELECT short, map_from_entries(list((c, bits))) AS m FROM (SELECT short, c, sum(1::HUGEINT << i)::HUGEINT AS bits FROM (SELECT short, unnest(string_split(short, '')) AS c, unnest(range(length(short))) AS i FROM (SELECT DISTINCT short FROM sl)) GROUP BY short, c) GROUP BY short),
  ms AS (SELECT ask_id, item, pos, length(short) AS n, length(long) AS size, list_transform(string_split(long, ''), lambda c: coalesce(m[c], 0::HUGEINT)) AS rows FROM sl JOIN mk USING (short)),
  v AS (SELECT ask_id, item, pos, n, unnest(list_concat(list_transform(range(0, size - n + 1), lambda i: rows[i + 1:i + n]), list_transform(range(1, n), lambda i: rows[1:i]), list_transform(range(1, n), lambda i: rows[size - i + 1:size]))) AS win FROM ms),
  f AS (SELECT ask_id, item, pos, n, len(win) AS m, n - bit_count(list_reduce([(1::HUGEINT << n) - 1] || win, lambda s, m: ((s + (s & m)) | (s - (s & m))) & ((1::HUGEINT << n) - 1))) AS common FROM v),
  scored AS (SELECT ask_id, item, pos, max(200.0::DOUBLE * common / (n + m)) AS score FROM f GROUP BY ask_id, item, pos),
  best AS (SELECT ask_id, arg_min(item, (-score, item, pos)) AS item, arg_min(pos, (-score, item, pos)) AS pos, max(score) AS score FROM scored WHERE score >= 70 GROUP BY ask_id)"""


def nearest_lines(t: Tables) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The gaps, all lines of the clean text, and for each gap the line of them all that is most like it."""
    asked, lines = lost_words(t)
    return asked, lines, best_lines(asked, lines)


@query("x_j10_partial_ratio", f"WITH {LOST} SELECT ask_id, item * 10000 + pos AS line_id, round(score, 6) AS score FROM best")
def _(t: Tables) -> DataFrame:
    return nearest_lines(t)[2].select("ask_id", "line_id", F.round("score", 6).alias("score"))


FILLED = r"""b AS (SELECT best.ask_id, string_agg(l.text, ' ' ORDER BY l.pos) AS block FROM best JOIN l ON l.item = best.item AND abs(l.pos - best.pos) <= 5 AND l.text <> '' GROUP BY best.ask_id),
  filled AS (SELECT ask_id, nullif(trim(regexp_extract(block, '(?i)' || array_to_string(list_transform(w[1:3], lambda x: regexp_escape(x)), '\s+') || '\s+(.+?)\s+' || array_to_string(list_transform(w[5:7], lambda x: regexp_escape(x)), '\s+'), 1)), '') AS fill FROM b JOIN q USING (ask_id))"""


def window_fills(t: Tables) -> DataFrame:
    asked, lines, best = nearest_lines(t)
    centres = best.join(lines, "line_id").select("ask_id", "item", "pos")
    blocks = G.windows(lines.select("item", "pos", "text"), centres, "item")
    return asked.join(blocks, "ask_id").select("ask_id", G.fill_from_window(F.col("context"), F.col("block")).alias("fill"))


@query("x33_window_fill", f"WITH {LOST}, {FILLED} SELECT * FROM filled")
def _(t: Tables) -> DataFrame:
    return window_fills(t)


def corpus_lines(t: Tables) -> DataFrame:
    """(line_id, text): every line of the documents."""
    line = L.lines(t.dealt("documents", "doc_id", "text"), "doc_id")
    return line.select((F.col("doc_id") * 100_000 + F.col("pos")).alias("line_id"), F.trim("line").alias("text"))


@query("x_j10_corpus_search")
def _(t: Tables) -> DataFrame:
    """Every line of the clean text and of the documents is met; clean lines come first. Held against all pairs in the tests."""
    asked, lines = lost_words(t)
    every = lines.select((-F.col("line_id") - 1).alias("line_id"), "text").unionByName(corpus_lines(t))
    return best_lines(asked, every).select("ask_id", "line_id", F.round("score", 6).alias("score"))


CORPUS = r"""cx AS (SELECT item_id AS a, array_to_string(w[1:3], ' ') || ' ' || word[1:2] AS head, word[4:] || tok[length(word) + 1:length(word) + 9] || ' ' || array_to_string(w[5:7], ' ') AS tail
    FROM (SELECT item_id, string_split(text, ' ') AS w, string_split(text, ' ')[4] AS tok, regexp_extract(string_split(text, ' ')[4], '^[A-Za-z]+') AS word FROM benchmark) WHERE length(word) >= 4),
  dl AS (SELECT doc_id * 100000 + pos AS l, trim(line) AS line FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS pos FROM documents)),
  aw AS (SELECT DISTINCT a, unnest(regexp_extract_all(lower(head || ' ' || tail), '[a-z]{3,}')) AS w FROM cx), lw AS (SELECT DISTINCT l, unnest(regexp_extract_all(lower(line), '[a-z]{3,}')) AS w FROM dl),
  df AS (SELECT w, count(*) AS n FROM lw GROUP BY w), r AS (SELECT a, w, row_number() OVER (PARTITION BY a ORDER BY n, w) AS r FROM aw JOIN df USING (w) QUALIFY r <= 3), kk AS (SELECT a, count(*) AS k FROM r GROUP BY a),
  h AS (SELECT a, l, count(*) AS hit, min(r) AS best, k FROM r JOIN lw USING (w) JOIN kk USING (a) GROUP BY a, l, k), ff AS (SELECT *, max((hit = k)::INT) OVER (PARTITION BY a) AS full_ FROM h),
  cc AS (SELECT a, l FROM ff WHERE CASE WHEN full_ = 1 THEN hit = k ELSE best = 1 END QUALIFY count(*) OVER (PARTITION BY a) <= 500),
  ov AS (SELECT a, l, count(*) AS overlap FROM cc JOIN aw USING (a) JOIN lw USING (l, w) GROUP BY a, l HAVING count(*) >= 2), top AS (SELECT a, arg_min(l, (-overlap, l)) AS l FROM ov GROUP BY a),
  corpus AS (SELECT a, trim(regexp_extract(line, '(?i)' || array_to_string(list_transform(string_split(regexp_extract(head, '((?:\S+\s+){0,2}\S*)$', 1), ' '), lambda x: regexp_escape(x)), '\s+') || '(.+?)' ||
    array_to_string(list_transform(string_split(regexp_extract(tail, '^(\S*(?:\s+\S+){0,2})', 1), ' '), lambda x: regexp_escape(x)), '\s+'), 1)) AS fill FROM top JOIN cx USING (a) JOIN dl USING (l)),
  cf AS (SELECT a, fill FROM corpus WHERE fill <> '' AND length(fill) <= 20)"""


@query("x36_corpus_fills", f"WITH {CORPUS} SELECT a AS gap_id, fill FROM cf")
def _(t: Tables) -> DataFrame:
    gaps, _ = gap_rows(t)
    return G.corpus_fills(gaps, corpus_lines(t))


@query("x36_cascade", SCORED + ", " + LOST.replace(" w AS (", " ww AS (").replace("FROM w)", "FROM ww)") + ", " + FILLED + ", " + CORPUS + """, n AS (SELECT item_id, count(*) AS n, arg_min(fill, (score, fill)) AS one FROM k GROUP BY 1),
  filled_by AS (SELECT item_id AS gap_id, CASE WHEN n <= 3 THEN one END AS one, filled.fill AS win, cf.fill AS found FROM n LEFT JOIN filled ON ask_id = item_id LEFT JOIN cf ON a = item_id)
  SELECT gap_id, CASE WHEN one IS NOT NULL THEN 'local' WHEN win IS NOT NULL THEN 'window' ELSE 'corpus' END AS method, coalesce(one, win, found) AS fill FROM filled_by WHERE coalesce(one, win, found) IS NOT NULL""")
def _(t: Tables) -> DataFrame:
    """Three passes: letters from the dictionary; the window around the most similar line of the clean text; a line of the corpus that has the words around."""
    gaps, words = gap_rows(t)
    local = G.letter_fills(gaps, words, [], 1)
    window = window_fills(t).select(F.col("ask_id").alias("gap_id"), "fill").filter("fill IS NOT NULL")
    return G.cascade(gaps, [("local", local), ("window", window), ("corpus", G.corpus_fills(gaps, corpus_lines(t)))]).select("gap_id", "method", "fill")
