"""Timers, state that goes away, and polled sources across restarts and failures."""

import glob
import json

from pyspark.sql import functions as F

from versemill.sources import polled_stream as O
from versemill.streaming import pipelines as P
from versemill.streaming import timers as T


def stream_of(spark, folder, batches, schema="key string, at timestamp"):
    """A stream with one file for each batch, in order."""
    for n, rows in enumerate(batches):
        spark.createDataFrame(rows, schema.replace("timestamp", "string")).select(*[F.col(c).cast(k) for c, k in (x.split(" ") for x in schema.split(", "))]).coalesce(1).write.parquet(f"{folder}/part={n}")
    return P.read_stream(spark, f"{folder}/*", schema, files=1)


def test_quiet_trigger_without_a_later_event_of_the_account(spark, tmp_path):
    day = "2024-01-01 "
    stream = stream_of(spark, f"{tmp_path}/in", [[("a", day + "10:00:00"), ("a", day + "10:10:00"), ("b", day + "10:20:00")], [("b", day + "10:30:00"), ("c", day + "10:56:00")], [("c", day + "12:00:00")]])
    found = []
    T.drain_with_timers(T.quiet_triggers(stream, "key", "at"), f"{tmp_path}/c", lambda batch, n: found.extend(map(tuple, batch.select("key", F.date_format("at", "HH:mm"), "n").collect())))
    assert sorted(found) == [("a", "10:55", 2), ("b", "11:15", 2), ("c", "11:41", 1)]
    left = T.state_rows(spark, f"{tmp_path}/c", "active").select("key.key", "value.n").collect()
    assert [tuple(r) for r in left] == [("c", 1)]


def test_admission_state_is_gone_after_a_silent_day(spark, tmp_path):
    rows = [[(1, "a", "2024-01-01 10:00:00", "x"), (2, "a", "2024-01-01 10:00:30", "y"), (3, "b", "2024-01-01 11:00:00", "x")], [(4, "b", "2024-01-01 12:00:00", "x")], [(5, "b", "2024-01-02 11:30:00", "z")], [(6, "b", "2024-01-04 12:00:00", "x")]]
    stream = stream_of(spark, f"{tmp_path}/in", rows, "id long, key string, ts timestamp, text string")
    found = {}
    T.drain_with_timers(T.admission(stream, P.Admission(repeats=1)), f"{tmp_path}/c", lambda batch, n: found.update({r.id: r.reason for r in batch.collect()}))
    assert found == {1: "", 2: "cooldown", 3: "", 4: "stimulus dedup", 5: "", 6: ""}
    assert [r[0] for r in T.state_rows(spark, f"{tmp_path}/c", "until").select("key.key").collect()] == ["b"]


def test_admission_is_one_value_of_state_for_an_account(spark, tmp_path):
    rows = [[(1, "a", "2024-01-01 10:00:00", "x"), (3, "a", "2024-01-01 12:00:00", "x"), (2, "a", "2024-01-01 11:00:00", None)], [(4, "a", "2024-01-01 13:00:00", "x"), (5, "b", "2024-01-01 14:00:00", "y")]]
    stream = stream_of(spark, f"{tmp_path}/in", rows, "id long, key string, ts timestamp, text string")
    found = {}
    T.drain_with_timers(T.admission(stream), f"{tmp_path}/c", lambda batch, n: found.update({r.id: r.reason for r in batch.collect()}))
    assert found == {1: "", 2: "", 3: "", 4: "stimulus dedup", 5: ""}
    state = {r.key.key: r.value for r in T.state_rows(spark, f"{tmp_path}/c", "until").collect()}
    at = 1704103200.0  # 10:00 of the day
    assert state["a"].posts == [at, at + 3600, at + 7200] and dict(zip(state["a"].texts, state["a"].times)) == {"x": [at, at + 7200], "": [at + 3600]}
    assert {k: v.ms for k, v in state.items()} == {"a": int((at + 7200 + 86400) * 1000), "b": int((at + 14400 + 86400) * 1000)}


def test_parts_of_the_time_are_written_by_all_tasks_and_drained_as_one_batch(spark, tmp_path, monkeypatch):
    """A table of several files: a part of the time has several files too, in any order, and no event is late."""
    from versemill.plans import stream_queries as Q
    from versemill.plans.registry import QUERIES, Tables

    spark.read.parquet("/root/testdata/sf0.001/events.parquet").repartition(8).write.parquet(f"{tmp_path}/events.parquet")
    monkeypatch.setattr(Q, "scratch", lambda t: f"{tmp_path}/scratch")
    t = Tables(spark, str(tmp_path))
    found = sorted(map(tuple, QUERIES["r10_admission_stream"](spark, str(tmp_path)).collect()))
    assert [len(glob.glob(f"{tmp_path}/scratch/in/part={n}/*.parquet")) > 1 for n in range(3)] == [True] * 3
    batches = [spark.read.parquet(b).count() for b in glob.glob(f"{tmp_path}/scratch/out/*")]
    assert sum(n > 0 for n in batches) == 3 and sum(batches) == t.events.count()
    assert found == sorted(map(tuple, QUERIES["r10_admission_batch"](spark, str(tmp_path)).collect()))


def reader(**options):
    source = O.PolledSource({k: str(v) for k, v in options.items()})
    return source, O.PolledReader(source)


def test_failures_wait_longer_and_end_after_ten():
    source, r = reader(sources="good,bad", tick=1)
    asked = []

    def fetch(name, number, cursor):
        asked.append((name, number))
        if name == "bad":
            raise OSError("unreachable")
        return [{"id": f"e{number}", "title": "t"}]

    r.fetch = fetch
    at, rows = r.initialOffset(), 0
    for _ in range(2500):
        some, at = r.read(json.loads(json.dumps(at)))
        rows += len(list(some))
    tries = [n for name, n in asked if name == "bad"]
    assert [b - a for a, b in zip(tries, tries[1:])] == [5, 10, 20, 40, 80, 160, 300, 300, 300]
    assert at["sources"]["bad"]["gone"] and rows == 2500


def test_seen_entries_are_bounded_and_the_newest_answer_stays():
    state = {"seen": [], "cursor": None, "empty": 0}
    entry = lambda n: {"id": f"k{n}", "title": "t"}
    assert len(O.poll_feed([entry(n) for n in range(6)], state, 4)) == 6 and state["seen"] == ["k0", "k1", "k2", "k3"]
    assert [e["id"] for e in O.poll_feed([entry(9), entry(2), entry(9), {"id": "", "link": "l", "title": "t"}, {"id": "empty"}], state, 4)] == ["k9", ""]
    assert state["seen"] == ["k9", "k2", "l", "empty"]
    assert O.entry_text({"title": "a", "content": "c", "summary": "s"}) == "a\n\nc" and O.entry_text({"summary": "s"}) == "s"


def test_timeline_cursor_and_its_end():
    state = {"seen": [], "cursor": None, "empty": 0}
    rows = [{"id": str(n), "at": f"2024-01-0{n}"} for n in (3, 1, 2)]
    assert [e["id"] for e in O.poll_timeline(rows, state, 2)] == ["1", "2"] and [e["id"] for e in O.poll_timeline(rows, state, 2)] == ["3"]
    for _ in range(O.EMPTY_ROUNDS):
        assert state["cursor"] is not None and O.poll_timeline([], state, 2) == []
    assert state["cursor"] is None


def test_stream_restarts_where_it_was(spark, tmp_path):
    """A poll that fails in between, a stop after each round: every entry comes once; the offsets in the checkpoint say why."""
    O.register(spark)
    for n in (1, 3, 4):
        rows = [(f"id{k}", "2024-01-01T00:00:00", "t", None) for k in range(n, n + 3)]
        spark.createDataFrame(rows, "id string, at string, title string, link string").coalesce(1).write.json(f"{tmp_path}/feeds/source=s/poll={n}")
    out = []
    for _ in range(4):
        stream = spark.readStream.format("polled").options(path=f"file://{tmp_path}/feeds", sources="s", tick=10).load()
        P.drain(stream, f"{tmp_path}/c", "append", lambda batch, n: out.extend((r.key, r["round"]) for r in batch.collect()))
    assert sorted(out) == [("id1", 1), ("id2", 1), ("id3", 1), ("id4", 3), ("id5", 3), ("id6", 4)]
    offsets = [json.loads(open(f).read().splitlines()[2]) for f in sorted(glob.glob(f"{tmp_path}/c/offsets/[0-9]*"))]
    assert [o["sources"]["s"]["errors"] for o in offsets] == [0, 1, 0, 0]
