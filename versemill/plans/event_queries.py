"""Queries over the event store (Q01-Q36)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import eventlog as E
from .registry import Tables, query

NOW = "2024-01-20 00:00:00"


def now():
    return F.lit(NOW).cast("timestamp_ntz")



@query("q01_mark_published", "SELECT id, CASE WHEN id IN (SELECT doc_id FROM labels WHERE quality = 1) THEN 2 ELSE published END AS published FROM interactions")
def _(t: Tables) -> DataFrame:
    return E.set_flag(t.interactions.select("id", "published"), t.labels.filter("quality = 1").select(F.col("doc_id").alias("id")), "published", 2)


@query("q02_store_edits", "SELECT i.id, coalesce(d.source, i.stimulus) AS stimulus FROM interactions i LEFT JOIN documents d ON d.doc_id = i.id")
def _(t: Tables) -> DataFrame:
    return E.overlay(t.interactions.select("id", "stimulus"), t.documents.select(F.col("doc_id").alias("id"), F.col("source").alias("stimulus")), "stimulus")


@query("q02_repeated_edits", "SELECT i.id, coalesce(e.kind, i.stimulus) AS stimulus FROM interactions i LEFT JOIN (SELECT o_custkey AS id, max(o_orderpriority) AS kind FROM orders GROUP BY o_custkey) e ON e.id = i.id")
def _(t: Tables) -> DataFrame:
    return E.overlay(t.interactions.select("id", "stimulus"), t.orders.select(F.col("o_custkey").alias("id"), F.col("o_orderpriority").alias("stimulus")), "stimulus")


INSERTED = """SELECT ts AS timestamp, source, NULL::VARCHAR AS stimulus_uri, stimulus AS stimulus_text, author AS stimulus_author, (decision <> 'pass')::INT AS triage_engage, NULL::VARCHAR AS triage_reason,
  '["' || stimulus || '","' || poet || '"]' AS triage_queries, NULL::VARCHAR AS the_problem, '["' || chunk_id || '"]' AS passages_retrieved, '{"chunk_id":"' || chunk_id || '","poet":"' || poet || '"}' AS passage_used,
  decision AS composition_decision, CASE WHEN decision = 'post' THEN 'quote' END AS composition_mode, CASE WHEN decision = 'post' THEN '["' || stimulus || '"]' ELSE '[]' END AS posts, '[]' AS response_uris,
  CASE WHEN decision = 'skip' THEN 'no' END AS skip_reason, tokens_in, tokens_out, dry_run FROM interactions"""


@query("q03_log_rows", INSERTED)
def _(t: Tables) -> DataFrame:
    post = F.col("decision") == "post"
    rows = t.interactions.select(
        F.col("ts").alias("timestamp"), "source", F.col("stimulus").alias("stimulus_text"), F.col("author").alias("stimulus_author"), F.array("stimulus", "poet").alias("triage_queries"), F.array("chunk_id").alias("passages_retrieved"),
        F.struct("chunk_id", "poet").alias("passage_used"), F.col("decision").alias("composition_decision"), F.when(post, "quote").alias("composition_mode"),
        F.when(post, F.array("stimulus")).otherwise(F.array().cast("array<string>")).alias("posts"), F.array().cast("array<string>").alias("response_uris"), F.when(F.col("decision") == "skip", "no").alias("skip_reason"), "tokens_in", "tokens_out", "dry_run",
    )
    return E.log_rows(rows, "interactions")


@query("q12_log_readings", """SELECT chunk_id, poet, NULL::VARCHAR AS poem_title, id AS interaction_id, ts AS timestamp, stimulus AS stimulus_text, NULL::VARCHAR AS collision_note, '["' || decision || '"]' AS themes FROM interactions WHERE decision = 'skip'""")
def _(t: Tables) -> DataFrame:
    rows = t.interactions.filter("decision = 'skip'").select("chunk_id", "poet", F.col("id").alias("interaction_id"), F.col("ts").alias("timestamp"), F.col("stimulus").alias("stimulus_text"), F.array("decision").alias("themes"))
    return E.log_rows(rows, "readings")


@query("q17_log_reflections", """SELECT max(ts) AS timestamp, 'daily' AS period, NULL::VARCHAR AS summary, '{"' || min(poet) || '":' || count(*) || '}' AS poets_used, '{}' AS themes_used, '["' || min(decision) || '"]' AS preoccupations, NULL::VARCHAR AS recommendations, NULL::VARCHAR AS self_notes FROM interactions GROUP BY day""")
def _(t: Tables) -> DataFrame:
    rows = t.interactions.groupBy("day").agg(F.max("ts").alias("timestamp"), F.create_map(F.min("poet"), F.count("*")).alias("poets_used"), F.array(F.min("decision")).alias("preoccupations"))
    return E.log_rows(rows.withColumn("period", F.lit("daily")).withColumn("themes_used", F.create_map().cast("map<string,int>")), "reflections")


STATS = "SELECT day, count(*) AS total_triaged, count(*) FILTER (decision <> 'pass') AS total_engaged, count(*) FILTER (decision = 'post') AS total_posted FROM interactions GROUP BY day"


@query("q04_daily_stats", STATS)
def _(t: Tables) -> DataFrame:
    return E.daily_stats(t.interactions)


@query("q04_daily_stats_upsert", STATS)
def _(t: Tables) -> DataFrame:
    old, new = t.interactions.filter("id % 3 = 0"), t.interactions.filter("id % 3 <> 0")
    return E.add_stats(E.daily_stats(old), E.daily_stats(new))


@query("q05_used_chunks", f"SELECT DISTINCT chunk_id FROM interactions WHERE decision = 'post' AND ts BETWEEN TIMESTAMP '{NOW}' - INTERVAL 48 HOUR AND TIMESTAMP '{NOW}'")
def _(t: Tables) -> DataFrame:
    return E.used_chunks(t.interactions, now())


@query("q06_posts_last_hour", f"SELECT count(*) AS n FROM interactions WHERE decision = 'post' AND ts BETWEEN TIMESTAMP '{NOW}' - INTERVAL 1 HOUR AND TIMESTAMP '{NOW}'")
def _(t: Tables) -> DataFrame:
    return t.interactions.filter((F.col("decision") == "post") & E.within_hours(F.col("ts"), now(), 1)).agg(F.count("*").alias("n"))


@query("q06_hourly_rate", "SELECT id, count(*) OVER (PARTITION BY author ORDER BY ts RANGE BETWEEN INTERVAL 1 HOUR PRECEDING AND CURRENT ROW) AS n_trailing FROM interactions WHERE decision = 'post'")
def _(t: Tables) -> DataFrame:
    return E.trailing_count(t.interactions.filter("decision = 'post'").select("id", "ts", "author"), 3600, "author").select("id", "n_trailing")


@query("q06_rate_of_all", "SELECT id, count(*) OVER (ORDER BY ts RANGE BETWEEN INTERVAL 1 HOUR PRECEDING AND CURRENT ROW) AS n_trailing FROM interactions")
def _(t: Tables) -> DataFrame:
    return E.trailing_count(t.interactions.select("id", "ts"), 3600).select("id", "n_trailing")


@query("q06_rate_over_midnight", "SELECT id, count(*) OVER (ORDER BY happened RANGE BETWEEN INTERVAL 6 HOUR PRECEDING AND CURRENT ROW) AS n_trailing FROM (SELECT id, day + INTERVAL 1 DAY + to_minutes((id % 120 - 60)::INT) AS happened FROM interactions)")
def _(t: Tables) -> DataFrame:
    at = F.col("day").cast("timestamp_ntz") + F.make_dt_interval(F.lit(1), F.lit(0), F.col("id") % 120 - 60)
    return E.trailing_count(t.interactions.select("id", at.alias("ts")), 6 * 3600).select("id", "n_trailing")


@query("q07_posts_on_day", "SELECT DATE '2024-01-10' AS day, coalesce(sum((decision = 'post')::INT), 0)::BIGINT AS total_posted FROM interactions WHERE day = DATE '2024-01-10'")
def _(t: Tables) -> DataFrame:
    out = E.value_or_default(E.daily_stats(t.interactions).withColumn("day", F.col("day").cast("string")), "day", "2024-01-10", {"total_posted": 0})
    return out.select(F.col("day").cast("date").alias("day"), F.col("total_posted").cast("long").alias("total_posted"))


@query("q08_recent_stimuli", "SELECT id, substr(stimulus, 1, 12) AS stimulus FROM interactions WHERE source LIKE 'stimuli_dir%' AND decision = 'post' AND stimulus <> '' ORDER BY ts DESC, id DESC LIMIT 25")
def _(t: Tables) -> DataFrame:
    rows = t.interactions.filter("source LIKE 'stimuli_dir%' AND decision = 'post' AND stimulus <> ''").select("id", "ts", F.substring("stimulus", 1, 12).alias("stimulus"))
    return E.newest(rows, 25, "ts", "id").select("id", "stimulus")


@query("q09_stimulus_repeats", "SELECT id, count(*) OVER (PARTITION BY substr(stimulus, 1, 200) ORDER BY ts RANGE BETWEEN INTERVAL 24 HOUR PRECEDING AND CURRENT ROW) AS n_trailing FROM interactions WHERE decision = 'post'")
def _(t: Tables) -> DataFrame:
    rows = t.interactions.filter("decision = 'post'").select("id", "ts", F.substring("stimulus", 1, 200).alias("prefix"))
    return E.trailing_count(rows, 24 * 3600, "prefix").select("id", "n_trailing")


@query("q10_stats_or_default", "SELECT DATE '2031-01-01' AS day, 0::BIGINT AS total_triaged, 0::BIGINT AS total_posted")
def _(t: Tables) -> DataFrame:
    stats = E.daily_stats(t.interactions).withColumn("day", F.col("day").cast("string"))
    out = E.value_or_default(stats, "day", "2031-01-01", {"total_triaged": 0, "total_posted": 0})
    return out.select(F.col("day").cast("date").alias("day"), F.col("total_triaged").cast("long").alias("total_triaged"), F.col("total_posted").cast("long").alias("total_posted"))


@query("q11_token_totals", "SELECT day, coalesce(sum(tokens_in), 0)::BIGINT AS tokens_in, coalesce(sum(tokens_out), 0)::BIGINT AS tokens_out FROM interactions GROUP BY day")
def _(t: Tables) -> DataFrame:
    return t.interactions.groupBy("day").agg(*[F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(c) for c in ("tokens_in", "tokens_out")])


@query("q13_readings_since", f"""SELECT r.id, r.chunk_id, i.stimulus, json_extract_string(r.themes, '$[0]') AS first_theme
  FROM (SELECT id, chunk_id, themes, ts FROM interactions WHERE decision = 'skip') r LEFT JOIN (SELECT * FROM interactions WHERE dry_run = 0) i ON i.id = r.id
  WHERE r.ts >= TIMESTAMP '{NOW}' - INTERVAL 168 HOUR AND r.ts <= TIMESTAMP '{NOW}'""")
def _(t: Tables) -> DataFrame:
    readings = t.interactions.filter((F.col("decision") == "skip") & E.within_hours(F.col("ts"), now(), 168)).select("id", "chunk_id", F.get(F.from_json("themes", "array<string>"), F.lit(0)).alias("first_theme"))
    return readings.join(t.interactions.filter("dry_run = 0").select("id", "stimulus"), "id", "left").select("id", "chunk_id", "stimulus", "first_theme")


@query("q14_note_lookup", "SELECT chunk_id, stimulus AS note, CASE WHEN id % 3 = 0 THEN [] ELSE themes::JSON::VARCHAR[] END AS themes FROM interactions WHERE chunk_id = 'c7'")
def _(t: Tables) -> DataFrame:
    themes = F.when(F.col("id") % 3 == 0, F.lit('["cut off')).otherwise(F.col("themes"))
    return E.note_of(t.interactions.select("chunk_id", F.col("stimulus").alias("note"), themes.alias("themes")), "c7")


def notes(log: DataFrame) -> DataFrame:
    themes = F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.from_json("themes", "array<string>")))))
    return log.groupBy("chunk_id").agg(F.count("*").cast("int").alias("times_used"), F.max("ts").alias("last_used"), F.max_by("stimulus", "id").alias("note"), themes.alias("themes"))


@query("q15_upsert_notes", """WITH old AS (SELECT chunk_id, count(*)::INT AS n, max(ts) AS l, arg_max(stimulus, id) AS note, list_sort(list_distinct(flatten(list(themes::JSON::VARCHAR[])))) AS th FROM interactions WHERE id % 2 = 0 GROUP BY 1),
  new AS (SELECT chunk_id, count(*)::INT AS n, max(ts) AS l, arg_max(stimulus, id) AS note, list_sort(list_distinct(flatten(list(themes::JSON::VARCHAR[])))) AS th FROM interactions WHERE id % 3 = 0 GROUP BY 1)
  SELECT coalesce(o.chunk_id, n.chunk_id) AS chunk_id, coalesce(o.n, 0) + coalesce(n.n, 0) AS times_used, greatest(o.l, n.l) AS last_used, coalesce(n.note, o.note) AS note,
    list_concat(coalesce(o.th, []), list_filter(coalesce(n.th, []), lambda x: NOT list_contains(coalesce(o.th, []), x))) AS themes
  FROM old o FULL JOIN new n ON o.chunk_id = n.chunk_id""")
def _(t: Tables) -> DataFrame:
    return E.upsert_notes(notes(t.interactions.filter("id % 2 = 0")), notes(t.interactions.filter("id % 3 = 0")))


@query("q16_notes_for_chunks", "SELECT chunk_id, count(*) AS n FROM interactions WHERE chunk_id IN (SELECT 'c' || vec_id FROM embeddings WHERE label = 0) GROUP BY chunk_id")
def _(t: Tables) -> DataFrame:
    wanted = t.embeddings.filter("label = 0").select(F.concat(F.lit("c"), "vec_id").alias("chunk_id"))
    return t.interactions.join(wanted, "chunk_id", "left_semi").groupBy("chunk_id").agg(F.count("*").alias("n"))


@query("q18_recent_of_each", "SELECT decision, id FROM interactions QUALIFY row_number() OVER (PARTITION BY decision ORDER BY id DESC) <= 7")
def _(t: Tables) -> DataFrame:
    return E.newest_per(t.interactions.select("decision", "id"), "decision", 7, "id")


@query("q19_latest_reflection", "SELECT source, arg_max(stimulus, id) AS stimulus, max(id) AS id FROM interactions GROUP BY source")
def _(t: Tables) -> DataFrame:
    return E.latest_per(t.interactions, "source", ["stimulus", "id"], F.col("id"))


@query("q20_poet_usage", f"SELECT poet, count(*) AS n FROM interactions WHERE poet IS NOT NULL AND decision = 'post' AND ts BETWEEN TIMESTAMP '{NOW}' - INTERVAL 168 HOUR AND TIMESTAMP '{NOW}' GROUP BY poet")
def _(t: Tables) -> DataFrame:
    return E.usage(t.interactions.filter((F.col("decision") == "post") & E.within_hours(F.col("ts"), now(), 168)), "poet")


@query("q21_theme_usage", "SELECT theme, count(*) AS n FROM (SELECT unnest(themes::JSON::VARCHAR[]) AS theme FROM interactions) GROUP BY theme")
def _(t: Tables) -> DataFrame:
    return E.theme_usage(t.interactions)


@query("q22_posted", "SELECT id, source FROM interactions WHERE decision = 'post' AND ts >= TIMESTAMP '2024-01-12' AND dry_run = 0")
def _(t: Tables) -> DataFrame:
    return E.posted(t.interactions, since="2024-01-12", dry_run=0).select("id", "source")


@query("q23_posted_on_day", "SELECT id, source FROM interactions WHERE decision = 'post' AND day = DATE '2024-01-12' AND source <> 'test'")
def _(t: Tables) -> DataFrame:
    return E.posted(t.interactions, day="2024-01-12", but_source="test").select("id", "source")


@query("q24_all_in_order", "SELECT id, row_number() OVER (PARTITION BY day ORDER BY ts, id) AS position FROM interactions WHERE decision = 'skip'")
def _(t: Tables) -> DataFrame:
    from pyspark.sql import Window

    return t.interactions.filter("decision = 'skip'").select("id", F.row_number().over(Window.partitionBy("day").orderBy("ts", "id")).cast("long").alias("position"))


@query("q25_newest_of_day", "SELECT id, decision FROM interactions WHERE day = DATE '2024-01-15' ORDER BY ts DESC, id DESC LIMIT 100")
def _(t: Tables) -> DataFrame:
    return E.newest(t.interactions.filter(F.col("day") == F.lit("2024-01-15").cast("date")), 100, "ts", "id").select("id", "decision")


TOUCHED = """SELECT c.conv_id AS id, greatest(c.conv_id % 5, n.t) AS last_active, coalesce(s.summary, '') AS summary FROM (SELECT DISTINCT conv_id FROM conversations) c
  LEFT JOIN (SELECT conv_id, max(turn) AS t FROM conversations WHERE turn % 2 = 1 GROUP BY conv_id) n USING (conv_id) LEFT JOIN (SELECT conv_id, max(role || turn) AS summary FROM conversations WHERE conv_id % 3 = 0 GROUP BY conv_id) s USING (conv_id)"""


@query("q26_q29_touch_sessions", TOUCHED)
def _(t: Tables) -> DataFrame:
    sessions = t.conversations.select(F.col("conv_id").alias("id")).distinct().select("id", (F.col("id") % 5).alias("last_active"), F.lit("").alias("summary"))
    summaries = t.conversations.filter("conv_id % 3 = 0").select(F.col("conv_id").alias("id"), F.concat("role", "turn").alias("summary"))
    return E.touch_sessions(sessions, t.conversations.filter("turn % 2 = 1").select(F.col("conv_id").alias("session_id"), F.col("turn").alias("timestamp")), summaries)


@query("q26_log_turns", "SELECT conv_id AS session_id, role, text AS content, turn AS timestamp, NULL::VARCHAR AS model_used, '[{\"chunk_id\":\"c' || turn || '\"}]' AS passages_used FROM conversations")
def _(t: Tables) -> DataFrame:
    used = F.array(F.struct(F.concat(F.lit("c"), "turn").alias("chunk_id")))
    return E.log_rows(t.conversations.select(F.col("conv_id").alias("session_id"), "role", F.col("text").alias("content"), F.col("turn").alias("timestamp"), used.alias("passages_used")), "chat_turns")


@query("q27_first_turns", "SELECT conv_id, turn, role FROM conversations QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn) <= 3")
def _(t: Tables) -> DataFrame:
    return E.capped_first(t.conversations.select("conv_id", "turn", "role"), "conv_id", 3, "turn")


@query("q28_last_turns", "SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS position FROM (SELECT * FROM conversations QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) <= 4)")
def _(t: Tables) -> DataFrame:
    from pyspark.sql import Window

    last = E.newest_per(t.conversations.select("conv_id", "turn"), "conv_id", 4, "turn")
    return last.withColumn("position", F.row_number().over(Window.partitionBy("conv_id").orderBy("turn")).cast("long"))


@query("q29_latest_session", "SELECT role, max(conv_id) AS conv_id FROM conversations GROUP BY role")
def _(t: Tables) -> DataFrame:
    return E.latest_per(t.conversations, "role", ["conv_id"], F.col("conv_id"))


@query("q30_first_review", "SELECT arg_min(substr(ts::VARCHAR, 1, 10), id) AS first_review FROM interactions WHERE decision = 'skip' AND tokens_out > 50")
def _(t: Tables) -> DataFrame:
    return E.first_value(t.interactions, F.substring(F.col("ts").cast("string"), 1, 10), F.col("id"), F.expr("decision = 'skip' AND tokens_out > 50"), "first_review")


@query("q31_featured", "SELECT i.id, i.stimulus FROM interactions i JOIN labels l ON l.doc_id = i.id AND l.toxic = 1")
def _(t: Tables) -> DataFrame:
    return t.interactions.join(t.labels.filter("toxic = 1").select(F.col("doc_id").alias("id")), "id", "left_semi").select("id", "stimulus")


@query("q32_feature_flags", "SELECT id, CASE WHEN id IN (SELECT doc_id FROM labels WHERE toxic = 1) THEN 1 ELSE dry_run END AS dry_run FROM interactions")
def _(t: Tables) -> DataFrame:
    return E.set_flag(t.interactions.select("id", "dry_run"), t.labels.filter("toxic = 1").select(F.col("doc_id").alias("id")), "dry_run", 1)


@query("q33_response_uris", "SELECT i.id, coalesce(p.url, '') AS uris FROM interactions i LEFT JOIN pages p ON p.page_id = i.id WHERE decision = 'post'")
def _(t: Tables) -> DataFrame:
    rows = t.interactions.filter("decision = 'post'").select("id", F.lit("").alias("uris"))
    return E.overlay(rows, t.pages.select(F.col("page_id").alias("id"), F.col("url").alias("uris")), "uris")


@query("q34_preview", "SELECT id FROM interactions WHERE decision = 'post' AND stimulus <> '' ORDER BY ts DESC, id DESC LIMIT 18")
def _(t: Tables) -> DataFrame:
    return E.newest(t.interactions.filter("decision = 'post' AND stimulus <> ''"), 18, "ts", "id").select("id")


@query("q35_apply_fixes", """SELECT d.doc_id AS id, CASE WHEN l.toxic = 1 THEN list_concat(['fixed'], string_split(source, 'c')[2:]) ELSE [] END AS edited_posts
  FROM documents d LEFT JOIN labels l USING (doc_id)""")
def _(t: Tables) -> DataFrame:
    rows = t.documents.select(F.col("doc_id").alias("id"), F.split("source", "c").alias("posts"), F.array().cast("array<string>").alias("edited_posts"))
    fixes = t.labels.filter("toxic = 1").select(F.col("doc_id").alias("id"), F.lit(0).alias("position"), F.lit("fixed").alias("replacement"))
    return E.apply_fixes(rows, fixes).select("id", "edited_posts")


@query("q35_many_fixes", """SELECT d.doc_id AS id, CASE WHEN l.doc_id IS NOT NULL THEN ['b', source, 'y', lang][:3] ELSE [] END AS edited_posts FROM documents d LEFT JOIN labels l USING (doc_id)""")
def _(t: Tables) -> DataFrame:
    rows = t.documents.select(F.col("doc_id").alias("id"), F.array(F.lit("x"), "source", F.lit("z")).alias("posts"), F.array().cast("array<string>").alias("edited_posts"))
    fix = lambda k, s: F.struct(F.lit(k).alias("position"), F.lit(s).alias("replacement"))
    return E.apply_fixes(rows, t.labels.select(F.col("doc_id").alias("id"), F.inline(F.array(fix(0, "a"), fix(0, "b"), fix(2, "y"), fix(9, "no"))))).select("id", "edited_posts")


@query("q36_migrate", "SELECT id, NULL::INT AS featured, published FROM interactions")
def _(t: Tables) -> DataFrame:
    return E.with_columns_added(t.interactions.select("id", "published"), {"featured": "int", "published": "int"})
