"""Machines over lines: any cut into partitions and batches gives what a walk over each text gives."""

import random

import pytest
from pyspark.sql import functions as F

from versemill.operators import automata as M
from versemill.operators import sequence as W


def walk(machine, rows):
    """rows: (key, pos, event) in any order. {(key, pos): (state, state after, counted)}."""
    out, now = {}, {}
    for key, pos, event in sorted(rows, key=lambda r: (r[0] is not None, r[0] or "", r[1])):
        state, count = now.get(key, (0, 0))
        after = machine.moves[state][event]
        count += machine.counts[state][event] if machine.counts else 0
        out[key, pos] = (state, after, count)
        now[key] = (after, count)
    return out


@pytest.mark.parametrize("parts", [1, 7])
def test_random_machines(spark, parts):
    rng = random.Random(parts)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 11)
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        for states in (1, 2, 5):
            events = 3
            machine = M.Machine(tuple(tuple(rng.randrange(states) for _ in range(events)) for _ in range(states)), tuple(tuple(rng.randrange(3) for _ in range(events)) for _ in range(states)))
            rows = [("hot", p, rng.randrange(events)) for p in range(300)] + [(None, p, rng.randrange(events)) for p in range(40)] + [(f"k{k}", p, rng.randrange(events)) for k in range(30) for p in range(rng.randrange(4))]
            rng.shuffle(rows)
            table = spark.createDataFrame(rows, "key string, pos int, event int")
            found = M.run(table, "key", ["pos"], F.col("event"), machine).collect()
            assert {(r.key, r.pos): (r.state, r.state_after, r.counted) for r in found} == walk(machine, rows) and len(found) == len(rows)
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 10_000)
        spark.conf.set("spark.sql.shuffle.partitions", 4)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")


def test_same_as_the_window_forms(spark):
    rng = random.Random(3)
    rows = [(k, p, rng.choice(["", "a", "open", "close", "x y"])) for k in range(5) for p in range(rng.choice([0, 1, 200]))]
    lines = spark.createDataFrame(rows, "key int, pos int, line string")
    opens, closes, blank = F.col("line") == "open", F.col("line") == "close", F.col("line") == ""
    key = lambda df: sorted(map(tuple, df.collect()))
    assert key(M.outside_regions(lines, "key", ["pos"], opens, closes)) == key(W.outside_regions(lines, "key", "pos", opens, closes))
    assert key(M.until_latch(lines, "key", ["pos"], opens)) == key(W.until_latch(lines, "key", "pos", opens))
    numbered = M.stretches(lines, "key", ["pos"], blank).groupBy("key", "stanza").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "line"))), lambda x: x["line"]).alias("lines"))
    assert key(numbered.select("key", F.col("stanza").cast("int"), "lines")) == key(W.stanzas(lines, "key", blank))
    assert M.run(lines.limit(0), "key", ["pos"], F.lit(0), M.LATCH).collect() == []


def test_one_text_is_in_many_tasks_and_under_no_window(spark):
    lines = spark.range(50_000).select(F.lit("one").alias("key"), F.col("id").alias("pos"), (F.col("id") % 10 == 0).cast("int").alias("event")).repartition(6)
    read = M.run(lines, "key", ["pos"], F.col("event"), M.STRETCHES)
    assert "Window" not in read._jdf.queryExecution().executedPlan().toString()
    assert read.agg(F.max("counted")).first()[0] == 5000
    assert read.filter((F.col("event") == 0) & (F.col("counted") != F.floor(F.col("pos") / 10) + 1)).isEmpty()
