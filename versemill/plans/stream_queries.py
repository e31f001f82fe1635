"""Queries over sources (S), sinks (K) and streams (R). A stream is drained and its result compared with the batch SQL."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import scratch_dir
from ..sources import polled_stream as O
from ..sources import polling as R
from ..sources import readers as S
from ..streaming import pipelines as P
from ..streaming import timers as T
from .registry import Tables, query

EVENTS = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"


def scratch(t: Tables) -> str:
    return scratch_dir(t.spark, "stream")


def events(t: Tables) -> DataFrame:
    return P.read_stream(t.spark, f"{t.folder}/events.parque[t]", EVENTS).withColumn("ts", F.col("ts").cast("timestamp"))


def drained_in_order(t: Tables, operator: Callable[[DataFrame], DataFrame], *columns: str, parts: int = 3) -> DataFrame:
    """What a stream operator with timers puts out for the events in order of time.

    Each part of the time is written by all tasks and drained before the next is there, by a stream that is started anew: so a
    part is one batch however many files it has.
    """
    at = scratch(t)
    rows = t.dealt("events", "ts", *columns)
    first, last = rows.agg(F.min("ts").alias("a"), F.max("ts").alias("b")).select(F.unix_micros(F.col("a").cast("timestamp")), F.unix_micros(F.col("b").cast("timestamp"))).first()
    part = F.floor((F.unix_micros(F.col("ts").cast("timestamp")) - first) * parts / (last - first + 1))
    for n in range(parts):
        rows.filter(part == n).write.parquet(f"{at}/in/part={n}")
        stream = operator(P.read_stream(t.spark, f"{at}/in/*", EVENTS).withColumn("ts", F.col("ts").cast("timestamp")))
        T.drain_with_timers(stream, f"{at}/checkpoint", lambda batch, number: batch.write.mode("overwrite").parquet(f"{at}/out/batch={number}"))
    return t.spark.read.schema(stream.schema).parquet(f"{at}/out").select(*stream.columns)


def drained(t: Tables, stream: DataFrame, mode: str) -> DataFrame:
    """The rows a stream has put out: all batches of an append, the last of a complete."""
    at = scratch(t)

    def sink(batch: DataFrame, number: int) -> None:
        folder = f"{at}/out/batch={number}" if mode == "append" else f"{at}/out"
        batch.write.mode("overwrite").parquet(folder)

    P.drain(stream, f"{at}/checkpoint", mode, sink)
    out = t.spark.read.schema(stream.schema).parquet(f"{at}/out")
    return out.select(*stream.columns)


@query("r01_keyword_stream", "SELECT event_id FROM events WHERE event_type IN ('click', 'signup') AND event_id % 2 = 0")
def _(t: Tables) -> DataFrame:
    op = F.when(F.col("event_id") % 2 == 0, "create").otherwise("delete")
    raw = F.format_string('{"kind":"commit","commit":{"operation":"%s","collection":"post","record":{"text":"a %s here","langs":["en"]}}}', op, "event_type")
    return drained(t, P.keyword_stream(events(t).select("event_id", raw.alias("raw")), "raw", "post", ["click", "signup"]).select("event_id"), "append")


@query("r03_stream_dedup", "SELECT DISTINCT event_type || user_id AS key FROM events")
def _(t: Tables) -> DataFrame:
    return drained(t, P.dedup(events(t).select(F.concat("event_type", "user_id").alias("key"), "ts"), "key", "ts", "60 days").select("key"), "append")


@query("r06_r09_merge_route", "SELECT event_type, count(*) AS n FROM events WHERE event_type IN ('click', 'purchase') OR user_id % 5 = 0 GROUP BY event_type")
def _(t: Tables) -> DataFrame:
    source = F.when(F.col("user_id") % 5 == 0, "stimuli_dir:a").otherwise("firehose")
    items = events(t).select("event_type", source.alias("source"), F.when(F.col("event_type").isin("click", "purchase"), "triage").otherwise("seed").alias("mode"))
    both = P.merge(items.filter("event_type = 'click'"), items.filter("event_type <> 'click'"))
    return drained(t, P.route(both)[1].groupBy("event_type").agg(F.count("*").alias("n")), "complete")


@query("r02_timeline", "SELECT event_id AS id, 1 + (row_number() OVER (ORDER BY ts, event_id) > 300)::INT AS poll FROM events WHERE event_type = 'error' QUALIFY row_number() OVER (ORDER BY ts, event_id) <= 500")
def _(t: Tables) -> DataFrame:
    items = t.events.filter("event_type = 'error'").select(F.col("event_id").alias("id"), F.col("ts").alias("at"))
    one, cursor = R.poll_timeline(items, items.limit(0), most=300)
    cursor.write.parquet(at := scratch(t))
    two, _ = R.poll_timeline(items, t.spark.read.parquet(at), most=200)
    return one.select("id", F.lit(1).alias("poll")).unionByName(two.select("id", F.lit(2).alias("poll")))


@query("r03_feed_poll", """WITH e AS (SELECT CASE WHEN event_id % 3 = 0 THEN 'id' || user_id WHEN event_id % 3 = 1 THEN 'link' || user_id ELSE event_type END AS key, ts FROM events),
  seen AS (SELECT key, min(ts) AS first FROM e WHERE ts < TIMESTAMP '2024-01-01 12:00:00' GROUP BY key ORDER BY first DESC, key DESC LIMIT 50) SELECT key, min(ts) AS "at" FROM e WHERE key NOT IN (SELECT key FROM seen) GROUP BY key""")
def _(t: Tables) -> DataFrame:
    k = F.col("event_id") % 3
    key = R.entry_id(F.when(k == 0, F.concat(F.lit("id"), "user_id")).otherwise(" "), F.when(k <= 1, F.concat(F.lit("link"), "user_id")), F.col("event_type"))
    entries = t.events.select(key.alias("key"), F.col("ts").alias("at"))
    _, seen = R.poll_feed(entries.filter("at < TIMESTAMP_NTZ '2024-01-01 12:00:00'"), entries.limit(0), most=50)
    return R.poll_feed(entries, seen, most=50)[0]


def put_file(t: Tables, path: str, text: str) -> None:
    put_bytes(t, path, text.encode())


def put_bytes(t: Tables, path: str, content: bytes) -> None:
    """A small file, written by the driver through Spark's file systems."""
    jvm, conf = t.spark.sparkContext._jvm, t.spark.sparkContext._jsc.hadoopConfiguration()
    at = jvm.org.apache.hadoop.fs.Path(path)
    stream = at.getFileSystem(conf).create(at, True)
    stream.write(bytearray(content))
    stream.close()


@query("r04_r05_changed_files", "SELECT n_name || '.md' AS name, 1 AS poll, lower(n_name) AS text FROM nation UNION ALL SELECT n_name || '.md', 3, 'again ' || n_name FROM nation WHERE n_nationkey % 5 = 0 UNION ALL SELECT 'NEW.md', 3, 'new'")
def _(t: Tables) -> DataFrame:
    """Three polls of a folder: all files; nothing; the changed ones and a new one. Each poll is a watch of its own, as after a restart."""
    at, out = scratch(t), None
    names = sorted(r.n_name for r in t.nation.select("n_name").collect())
    keys = {r.n_name: r.n_nationkey for r in t.nation.collect()}
    for poll in (1, 2, 3):
        if poll == 1:
            for name in names:
                put_file(t, f"{at}/in/{name}.md", name.lower())
            put_file(t, f"{at}/in/other.txt", "not watched")
        if poll == 3:
            time.sleep(1.1)  # file systems may keep times in whole seconds
            for name in (n for n in names if keys[n] % 5 == 0):
                put_file(t, f"{at}/in/{name}.md", f"again {name}")
            put_file(t, f"{at}/in/NEW.md", "new")
        watch = R.FolderWatch(t.spark, f"{at}/in", f"{at}/state", "*.md")
        items, state = watch.poll()
        items.select("name", F.lit(poll).alias("poll"), "text").write.parquet(f"{at}/out/p={poll}")
        watch.done(state)
    return t.spark.read.schema("name string, poll int, text string").parquet(*[f"{at}/out/p={p}" for p in (1, 2, 3)])


def feed_rounds(t: Tables, kind: str, sources: str, rounds: int, **options: object) -> DataFrame:
    """Errors as the entries of two feeds, s0 and s1, that show two sixths of them in each round; s1 can't be reached in rounds 2 and 3.
    The stream is started anew for each round."""
    at, sixth = scratch(t), F.expr("event_id div 2 % 6 + 1")
    source = F.concat(F.lit("s"), F.col("event_id").bitwiseAND(1).cast("string"))
    when = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    shown = t.events.filter("event_type = 'error'").select(source.alias("source"), F.explode(F.array(sixth, sixth + 1)).alias("poll"), when.alias("at"), F.when(F.col("user_id") % 2 == 0, F.concat(F.lit("id"), "event_id")).alias("id"), F.concat(F.lit("link"), "event_id").alias("link"), F.col("event_type").alias("title"), F.col("user_id").cast("string").alias("summary"))
    shown.filter("NOT (source = 's1' AND poll IN (2, 3))").write.partitionBy("source", "poll").json(f"{at}/feeds")
    O.register(t.spark)
    for _ in range(rounds):
        stream = t.spark.readStream.format("polled").options(path=f"{at}/feeds", sources=sources, kind=kind, **options).load()
        P.drain(stream, f"{at}/checkpoint", "append", lambda batch, number: batch.write.mode("overwrite").parquet(f"{at}/out/batch={number}"))
    return t.spark.read.schema(O.PolledSource({}).schema()).parquet(f"{at}/out").select("source", "round", "key", "at", "text")


SHOWN = """shown AS (SELECT 's' || (event_id & 1) AS source, unnest([event_id // 2 % 6 + 1, event_id // 2 % 6 + 2]) AS round, CASE WHEN user_id % 2 = 0 THEN 'id' ELSE 'link' END || event_id AS key, ts::TIMESTAMPTZ AS "at", event_type || chr(10) || chr(10) || user_id AS text FROM events WHERE event_type = 'error'),
  reached AS (SELECT * FROM shown WHERE round <= 5 AND NOT (source = 's1' AND round IN (2, 3)))"""


@query("r03_r06_feed_stream", f"""WITH {SHOWN} SELECT source, min(round) AS round, key, "at", text FROM reached GROUP BY source, key, "at", text""")
def _(t: Tables) -> DataFrame:
    """Each entry comes once, in the first round that reaches it; a third source is never there, and is waited for while the others go on."""
    return feed_rounds(t, "feed", "s0,none,s1", 5, keep=1_000_000, tick=10)


@query("r02_timeline_stream", f"""WITH RECURSIVE {SHOWN}, cursor(source, round, "at", key) AS (
    SELECT source, 0::BIGINT, TIMESTAMPTZ '1970-01-01 00:00:00+00', '' FROM (VALUES ('s0'), ('s1')) s(source)
    UNION ALL SELECT c.source, c.round + 1, coalesce(m.top."at", c."at"), coalesce(m.top.key, c.key) FROM cursor c, LATERAL (
      SELECT max(struct_pack("at" := "at", key := key)) AS top FROM (SELECT r."at", r.key FROM reached r WHERE r.source = c.source AND r.round = c.round + 1 AND (r."at", r.key) > (c."at", c.key) ORDER BY r."at", r.key LIMIT 20) x) m WHERE c.round < 5)
  SELECT r.source, r.round, r.key, r."at", r.text FROM reached r JOIN cursor a ON a.source = r.source AND a.round = r.round - 1 JOIN cursor b ON b.source = r.source AND b.round = r.round
  WHERE (r."at", r.key) > (a."at", a.key) AND (r."at", r.key) <= (b."at", b.key)""")
def _(t: Tables) -> DataFrame:
    """At most 20 entries of a round, after the cursor that the stream carries."""
    return feed_rounds(t, "timeline", "s0,s1", 5, most=20, tick=10)


@query("r07_configured_sources", "SELECT event_id, CASE WHEN event_type = 'click' THEN 'seed' ELSE 'triage' END AS mode FROM events WHERE event_type IN ('click', 'error')")
def _(t: Tables) -> DataFrame:
    kinds = {"events": lambda _, c: events(t).filter(F.col("event_type") == c["only"]).select("event_id", F.lit("triage").alias("mode"))}
    configs = [{"type": "events", "only": "click", "mode": "seed"}, {"type": "events", "only": "error"}, {"type": "carrier pigeon"}]
    return drained(t, P.merge(*P.build_sources(t.spark, configs, kinds)), "append")


@query("r08_latest_seeds", "SELECT event_type, arg_max(event_id, (ts, event_id)) AS event_id, arg_max(event_id, (ts, event_id)) AS last FROM events GROUP BY event_type")
def _(t: Tables) -> DataFrame:
    latest = P.latest_seeds(events(t), "event_type", F.struct("ts", "event_id"), "event_id")
    return drained(t, latest.select("event_type", "event_id", F.col("at.event_id").alias("last")), "complete")


@query("r08_seed_context", "SELECT substr(string_agg('[' || event_type || '] ' || substr(repeat('said ' || v || ' ', 40), 1, 500), chr(10) ORDER BY '[' || event_type || '] '), 1, 1000) AS context FROM (SELECT event_type, arg_max(event_id, (ts, event_id)) AS v FROM events GROUP BY event_type)")
def _(t: Tables) -> DataFrame:
    said = F.repeat(F.concat(F.lit("said "), "event_id", F.lit(" ")), F.lit(40))
    seeds = P.latest_seeds(t.events.withColumn("said", said), "event_type", F.struct("ts", "event_id"), "said")
    return P.seed_context(seeds, "event_type", "said", 1000)


@query("r12_restart", "SELECT event_id, 1 AS n FROM events")
def _(t: Tables) -> DataFrame:
    """A stream that is stopped and started again on a folder that grew meanwhile: each row comes out once."""
    at = scratch(t)
    for part in (0, 1, 2):
        t.events.filter(F.col("event_id") % 3 == part).select("event_id").write.parquet(f"{at}/in/part={part}")
        stream = P.read_stream(t.spark, f"{at}/in/*", "event_id long", files=1).select("event_id")
        P.drain(stream, f"{at}/checkpoint", "append", lambda batch, number: batch.write.mode("overwrite").parquet(f"{at}/out/batch={number}"))
    return t.spark.read.schema("event_id long").parquet(f"{at}/out").groupBy("event_id").agg(F.count("*").cast("int").alias("n"))


ADMITTED = """WITH RECURSIVE items AS (SELECT event_id AS id, user_id::VARCHAR AS key, epoch_us(ts) / 1e6 AS tm, event_type AS text, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events),
  fold(key, n, id, reason, posts) AS (
    SELECT DISTINCT key, 0::BIGINT, NULL::BIGINT, '', []::STRUCT(tm DOUBLE, said VARCHAR)[] FROM items
    UNION ALL
    SELECT key, n, id, reason, CASE WHEN reason = '' THEN list_append(kept, {'tm': tm, 'said': text}) ELSE kept END FROM (
      SELECT *, CASE WHEN len(list_filter(kept, lambda p: p.tm > tm - 3600)) >= 1 THEN 'hourly cap' WHEN len(list_filter(kept, lambda p: floor(p.tm / 86400) = floor(tm / 86400))) >= 2 THEN 'daily cap'
        WHEN len(kept) > 0 AND tm - kept[-1].tm < 14400 THEN 'cooldown' WHEN len(list_filter(kept, lambda p: p.said = text)) >= 1 THEN 'stimulus dedup' ELSE '' END AS reason
      FROM (SELECT i.key, i.n, i.id, i.tm, i.text, list_filter(f.posts, lambda p: p.tm > i.tm - 86400) AS kept FROM fold f JOIN items i ON i.key = f.key AND i.n = f.n + 1)))
  SELECT id, key, reason = '' AS admitted, reason FROM fold WHERE n > 0"""


#: Accounts here have some two events a day.
RULES = P.Admission(per_hour=1, per_day=2, cooldown=14400, repeats=1)


@query("r10_admission_batch", ADMITTED)
def _(t: Tables) -> DataFrame:
    items = t.events.select(F.col("event_id").alias("id"), F.col("user_id").cast("string").alias("key"), (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("at"), F.col("event_type").alias("text"))
    return RULES.batch(items)


@query("r10_admission_stream", ADMITTED)
def _(t: Tables) -> DataFrame:
    def admitted(stream: DataFrame) -> DataFrame:
        return T.admission(stream.select(F.col("event_id").alias("id"), F.col("user_id").cast("string").alias("key"), "ts", F.col("event_type").alias("text")), RULES)

    return drained_in_order(t, admitted, "event_id", "user_id", "event_type")


@query("r_q04_daily_counts", "SELECT ts::DATE AS day, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def _(t: Tables) -> DataFrame:
    return drained(t, P.daily_counts(events(t), "ts", "event_type"), "complete")


@query("r_q06_hourly_rate", """SELECT w + INTERVAL 1 HOUR AS at, count(*) AS n FROM (SELECT unnest(list_transform(range(0, 4), lambda k: time_bucket(INTERVAL 15 MINUTE, ts) - to_minutes(15 * k::INT))) AS w FROM events) GROUP BY 1""")
def _(t: Tables) -> DataFrame:
    return drained(t, P.hourly_rate(events(t), "ts"), "complete")


@query("s01_jsonl_round_trip", "SELECT doc_id::VARCHAR AS chunk_id, source AS poet, text AS chunk_text FROM documents")
def _(t: Tables) -> DataFrame:
    at = scratch(t)
    S.append_log(t.documents.select(F.col("doc_id").cast("string").alias("chunk_id"), F.col("source").alias("poet"), F.col("text").alias("chunk_text")), at)
    return S.read_jsonl(t.spark, at).select("chunk_id", "poet", "chunk_text")


@query("s04_csv_round_trip", "SELECT c_custkey::VARCHAR AS tcp_id, c_name AS title FROM customer")
def _(t: Tables) -> DataFrame:
    at = scratch(t)
    S.write_manifest(t.customer.select(F.col("c_custkey").alias("TCP ID"), F.col("c_name").alias("Title")), at)
    return S.read_catalogue(t.spark, at).select(F.col("TCP_ID").alias("tcp_id"), F.col("Title").alias("title"))


@query("s05_tei", "SELECT n_nationkey::VARCHAR AS key, 'On ' || n_name AS title, unnest(['a [...] line', 'next s']) AS line FROM nation")
def _(t: Tables) -> DataFrame:
    xml = F.concat(F.lit('<TEI xmlns="http://www.tei-c.org/ns/1.0"><text><body><div type="poem"><head>On <hi>'), "n_name", F.lit('</hi></head><lg><l>a <gap extent="1 word"/> line<note>x</note></l><l>next ſ</l></lg></div></body></text></TEI>'))
    return S.parse_tei(t.nation.select("n_nationkey", xml.alias("xml")), "n_nationkey", "xml").select("key", "title", "line")


@query("s08_s11_html", """SELECT page_id, 'noindent' AS pattern, len(list_filter(list_transform(regexp_extract_all(html, '(?is)<p\\b[^>]*>(.*?)</p>', 1), lambda p: len(list_filter(list_transform(regexp_split_to_array(p, '(?i)<br\\s*/?>'), lambda x: trim(regexp_replace(regexp_replace(x, '<[^>]+>', '', 'g'), '\\s+', ' ', 'g'))), lambda x: x <> ''))), lambda n: n > 0)) AS stanzas FROM pages""")
def _(t: Tables) -> DataFrame:
    return t.pages.select("page_id", S.html_pattern(F.col("html")).alias("pattern"), F.size(S.noindent_lines(F.col("html"))).cast("long").alias("stanzas"))


@query("s14_s21_blocks", "SELECT doc_id, 3 AS n FROM documents WHERE trim(text, chr(10) || ' ') <> ''")
def _(t: Tables) -> DataFrame:
    rows = t.documents.filter(F.trim("text", F.lit("\n ")) != "")
    return rows.select("doc_id", F.size(S.delimited_blocks(F.concat(F.lit("one\n---\n\n---  \n"), "text", F.lit("\n____________\nlast")))).alias("n"))


@query("k01_partitioned_write", "SELECT source, count(*) AS n FROM documents GROUP BY source")
def _(t: Tables) -> DataFrame:
    at = scratch(t)
    S.write_by_key(t.documents.select("doc_id", "source"), at, "source")
    return t.spark.read.schema("doc_id long, source string").json(at).groupBy("source").agg(F.count("*").alias("n"))


@query("k03_upsert", "SELECT vec_id, CASE WHEN vec_id % 3 = 0 THEN label + 100 ELSE label END AS label FROM embeddings")
def _(t: Tables) -> DataFrame:
    old = t.embeddings.select("vec_id", "label")
    new = old.filter("vec_id % 3 = 0").withColumn("label", F.col("label") + 100)
    return S.upsert(S.upsert(old, new, "vec_id"), new, "vec_id")


@query("k08_feed", "SELECT id FROM interactions WHERE decision = 'post' ORDER BY ts DESC, id DESC LIMIT 20")
def _(t: Tables) -> DataFrame:
    return S.feed(t.interactions.filter("decision = 'post'")).select("id")
