"""Line automata as an associative scan (W10, W15, W19, W20): machines that read the lines of a text of any length.

What a stretch of lines does to a machine is a map: from the state before it to the state after it, and to how often the
machine counted on the way. Maps of neighbouring stretches compose, in any grouping. So lines are sorted over range
partitions, in which one text may have many and a partition may have many texts; every partition composes its own lines, from
each state it might have begun in; and only where a text crosses from a partition to the next is a state handed down: two
rows for each partition at most, whatever the number of texts and the length of the longest. No text meets in one task.

Defined results: a text begins in state 0; null keys are a text like others; lines of equal place keep the order that the
sort gave them, so places should differ; an empty table gives an empty one.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import scratch_dir

MOST_STATES = 127


@dataclass(frozen=True)
class Machine:
    """``moves[state][event]`` is the next state, ``counts[state][event]`` what is counted on the way."""

    moves: tuple[tuple[int, ...], ...]
    counts: tuple[tuple[int, ...], ...] | None = None


#: Inside from an opening to a closing. Events: 0 nothing, 1 opens, 2 closes.
REGIONS = Machine(((0, 1, 0), (1, 1, 0)))
#: Latched for good. Events: 0 nothing, 1 the latch.
LATCH = Machine(((0, 1), (1, 1)))
#: Counts stretches of lines between breaks. Events: 0 a line, 1 a break. State 1 is inside a stretch.
STRETCHES = Machine(((1, 0), (1, 0)), ((1, 0), (0, 0)))


def _scan(ends: np.ndarray, counts: np.ndarray, first: np.ndarray) -> None:
    """Maps of single lines (lines x states) become those of all lines of the text up to each, in place, by doubling."""
    at, step = np.arange(len(ends)) - first, 1
    while step <= at.max(initial=0):
        some = np.flatnonzero(at >= step)
        before = some - step
        middle = ends[before]
        counts[some] = counts[before] + np.take_along_axis(counts[some], middle, axis=1)
        ends[some] = np.take_along_axis(ends[some], middle, axis=1)
        step *= 2


def run(lines: DataFrame, key: str, order: list[str], event: Column, machine: Machine) -> DataFrame:
    """``lines`` with ``state`` (before the line), ``state_after`` and ``counted`` (up to and with the line). ``event`` is a whole number."""
    spark, states = lines.sparkSession, len(machine.moves)
    if states > MOST_STATES:
        raise ValueError("a machine has 127 states at most")
    moves = np.array(machine.moves, np.int64).T
    counts = np.zeros_like(moves) if machine.counts is None else np.array(machine.counts, np.int64).T
    names = lines.columns

    def compose(batches):
        """Rows with the map of what came before each in this partition, and of what came up to it."""
        part, carried = TaskContext.get().partitionId(), None
        place = at = 0
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            codes = batch.column("_key").dictionary_encode(null_encoding="encode")
            numbers = codes.indices.to_numpy()
            new = np.r_[True, numbers[1:] != numbers[:-1]]
            first = np.maximum.accumulate(np.where(new, np.arange(n), 0))
            events = batch.column("_event").to_numpy(zero_copy_only=False).astype(np.int64)
            ends, sums = moves[events].copy(), counts[events].copy()
            _scan(ends, sums, first)
            before, before_sums = np.tile(np.arange(states), (n, 1)), np.zeros_like(sums)
            inner = np.flatnonzero(~new)
            before[inner], before_sums[inner] = ends[inner - 1], sums[inner - 1]
            piece = np.cumsum(new) + place - 1
            if carried is not None and carried[0] == batch.column("_key")[0].as_py():  # the text goes on from the batch before
                same = first == 0
                _, end, total = carried
                sums[same] = total + sums[same][:, end]
                ends[same] = ends[same][:, end]
                before_sums[same] = total + before_sums[same][:, end]
                before[same] = before[same][:, end]
                piece -= 1
            carried = batch.column("_key")[n - 1].as_py(), ends[-1].copy(), sums[-1].copy()
            place, at = int(piece[-1]) + 1, at + n
            lists = lambda x: pa.ListArray.from_arrays(pa.array(np.arange(0, x.size + 1, states, dtype=np.int32)), pa.array(x.ravel()))
            more = [pa.array(np.full(n, part, np.int32)), pa.array(np.arange(at - n, at)), pa.array(piece), lists(before), lists(ends), lists(sums)]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in names], *more], [*names, "_part", "_at", "_piece", "_before", "_ends", "_sums"])

    cut = lines.withColumns({"_key": F.col(key), "_event": event.cast("int")})
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in lines.schema)
    dealt = cut.repartitionByRange(F.col("_key"), *[F.col(c) for c in order]).sortWithinPartitions("_key", *order)
    scanned = dealt.mapInArrow(compose, f"{kinds}, _part int, _at long, _piece long, _before array<long>, _ends array<long>, _sums array<long>")
    path = scratch_dir(spark, "automaton")
    scanned.write.parquet(path)
    scanned = spark.read.schema(scanned.schema).parquet(path)
    entries = spark.createDataFrame(_entries(scanned, key), "_at_part int, _entry int, _offset long")
    # Only the first piece of a partition can go on from another.
    joined = scanned.join(F.broadcast(entries), (F.col("_part") == F.col("_at_part")) & (F.col("_piece") == 0), "left")
    entry, offset = F.coalesce("_entry", F.lit(0)), F.coalesce("_offset", F.lit(0))
    found = {"state": F.get("_before", entry).cast("int"), "state_after": F.get("_ends", entry).cast("int"), "counted": offset + F.get("_sums", entry)}
    return joined.select(*names, *[v.alias(k) for k, v in found.items()])


def _entries(scanned: DataFrame, key: str) -> list[tuple[int, int, int]]:
    """(partition, state, count) where a text goes on from the partition before; one row for each partition is looked at."""
    row, first = F.struct(F.col(key).alias("key"), "_ends", "_sums"), F.when(F.col("_piece") == 0, F.col("_at"))
    edges = scanned.groupBy("_part").agg(F.max_by(row, first).alias("first"), F.max_by(row, "_at").alias("last"), F.max("_piece").alias("pieces"))
    out, carried = [], None
    for r in sorted(edges.collect(), key=lambda r: r._part):
        state, count = carried[1:] if carried is not None and carried[0] == r.first.key else (0, 0)
        out.append((r._part, state, count))
        goes_on = r.pieces == 0
        state, count = (state, count) if goes_on else (0, 0)
        carried = r.last.key, r.last._ends[state], count + r.last._sums[state]
    return out


def outside_regions(lines: DataFrame, key: str, order: list[str], opens: Column, closes: Column) -> DataFrame:
    """Lines outside regions that ``opens`` begins and ``closes`` ends, both included; as ``sequence.outside_regions``, for texts of any length."""
    event = F.when(closes, 2).when(opens, 1).otherwise(0)
    read = run(lines.withColumn("_opens", F.coalesce(opens, F.lit(False))), key, order, event, REGIONS)
    return read.filter(~F.col("_opens") & (F.col("state") == 0)).select(*lines.columns)


def until_latch(lines: DataFrame, key: str, order: list[str], latch: Column) -> DataFrame:
    """Lines before the first that ``latch`` marks."""
    return run(lines, key, order, F.when(latch, 1).otherwise(0), LATCH).filter("state_after = 0").select(*lines.columns)


def stretches(lines: DataFrame, key: str, order: list[str], breaks: Column, out: str = "stanza") -> DataFrame:
    """Lines between breaks with the number of their stretch, from 1; the break lines are left out, and repeated ones make no empty stretch."""
    marked = lines.withColumn("_break", F.coalesce(breaks, F.lit(False)))
    read = run(marked, key, order, F.col("_break").cast("int"), STRETCHES)
    return read.filter(~F.col("_break")).select(*lines.columns, F.col("counted").alias(out))
