"""Operators along an order (W): forward fill, islands, regions, duplicate numbers, running caps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

FIRST = Window.unboundedPreceding


def neighbours_of(rows: DataFrame, by: list[str], order: list[str], column: str, coarse: Column, descending: bool = False) -> DataFrame:
    """What stands before and after in the order of ``order`` (all rising or all falling), as ``previous`` and ``next``.

    ``coarse`` is a coarser value of the order (the day of a time, a block of a number): rows are sorted inside each of its
    values, and a row for each of them carries the first and last across, so an order over the whole table needs no single task.
    """
    turned = [F.col(c).desc() if descending else F.col(c).asc() for c in order]
    cut = rows.withColumn("_coarse", coarse)
    inside = Window.partitionBy(*by, "_coarse").orderBy(*turned)
    place = F.struct(*order)
    first, last = (F.max_by, F.min_by) if descending else (F.min_by, F.max_by)
    ends = cut.groupBy(*by, "_coarse").agg(first(column, place).alias("_first"), last(column, place).alias("_last"))
    across = Window.partitionBy(*by).orderBy(F.col("_coarse").desc() if descending else F.col("_coarse").asc())
    ends = ends.select(*by, "_coarse", F.lag("_last").over(across).alias("_before"), F.lead("_first").over(across).alias("_after"))
    keys = [F.col(f"r.{c}").eqNullSafe(F.col(f"e.{c}")) for c in [*by, "_coarse"]]
    near = cut.withColumns({"_n": F.row_number().over(inside), "_p": F.lag(column).over(inside), "_q": F.lead(column).over(inside), "_k": F.count("*").over(Window.partitionBy(*by, "_coarse"))})
    joined = near.alias("r").join(ends.alias("e"), keys, "left")
    previous, following = F.when(F.col("_n") == 1, F.col("_before")).otherwise(F.col("_p")), F.when(F.col("_n") == F.col("_k"), F.col("_after")).otherwise(F.col("_q"))
    return joined.select(*[F.col(f"r.{c}") for c in rows.columns], previous.alias("previous"), following.alias("next"))


def number_repeats(rows: DataFrame, key: str, order: list[str]) -> DataFrame:
    """Repeated ids get ``-dupN``; the first keeps its own."""
    n = F.row_number().over(Window.partitionBy(key).orderBy(*order)) - 1
    return rows.withColumn("unique_id", F.when(n == 0, F.col(key).cast("string")).otherwise(F.concat(F.col(key).cast("string"), F.lit("-dup"), n)))


def blanks_before(lines: DataFrame, key: str) -> DataFrame:
    """How many blank lines stand directly before each line."""
    before = Window.partitionBy(key).orderBy("pos").rowsBetween(FIRST, -1)
    last = F.coalesce(F.max(F.when(F.trim("line") != "", F.col("pos"))).over(before), F.lit(-1))
    return lines.withColumn("blanks", F.col("pos") - last - 1)


def forward_fill(rows: DataFrame, key: str, order: str, is_heading: Column, heading: Column, out: str) -> DataFrame:
    """The last heading at or before each row."""
    w = Window.partitionBy(key).orderBy(order).rowsBetween(FIRST, 0)
    return rows.withColumn(out, F.last(F.when(is_heading, heading), ignorenulls=True).over(w))


def islands(rows: DataFrame, key: str, order: str, breaks: Column, out: str = "island") -> DataFrame:
    """Rows between breaks share a number; a break starts the next one."""
    w = Window.partitionBy(key).orderBy(order).rowsBetween(FIRST, 0)
    return rows.withColumn(out, F.coalesce(F.sum(breaks.cast("int")).over(w), F.lit(0)))


def stanzas(lines: DataFrame, key: str, breaks: Column) -> DataFrame:
    """(key, stanza, lines): stanza numbers from 1 without the break lines; leading, trailing and repeated breaks make no empty stanza."""
    cut = islands(lines, key, "pos", breaks).filter(~breaks)
    gathered = cut.groupBy(key, "island").agg(F.transform(F.sort_array(F.collect_list(F.struct("pos", "line"))), lambda x: x["line"]).alias("lines"))
    return gathered.withColumn("stanza", F.row_number().over(Window.partitionBy(key).orderBy("island"))).select(key, "stanza", "lines")


def cooldown_gaps(rows: DataFrame, at: str, by: str | None = None) -> DataFrame:
    """Microseconds since the row before, of the same key or of all rows. Rows are sorted hour by hour."""
    near = neighbours_of(rows.withColumn("_us", F.unix_micros(F.col(at).cast("timestamp"))), [by] if by else [], ["_us"], "_us", F.date_trunc("hour", at))
    return near.withColumn("since_us", F.col("_us") - F.col("previous")).drop("_us", "previous", "next")


def quiet_periods(rows: DataFrame, at: str, by: str, gap: str) -> DataFrame:
    """Activity sessions that a quiet gap ends."""
    return rows.groupBy(by, F.session_window(at, gap).alias("_w")).agg(F.count("*").alias("n")).select(by, F.col("_w.start").alias("start"), F.col("_w.end").alias("end"), "n")


def outside_regions(rows: DataFrame, key: str, order: str, opens: Column, closes: Column) -> DataFrame:
    """Rows outside regions that ``opens`` begins and ``closes`` ends, both included in the region."""
    w = Window.partitionBy(key).orderBy(order)
    event = F.when(opens & ~closes, "open").when(closes, "close")
    before = F.last(event, ignorenulls=True).over(w.rowsBetween(FIRST, -1))
    inside = opens | (F.coalesce(before, F.lit("close")) == "open")
    return rows.withColumn("_in", inside).filter(~F.col("_in")).drop("_in")


def dewrap(lines: DataFrame, key: str) -> DataFrame:
    """A line that starts lower-case belongs to the one before: (key, island, line)."""
    starts = ~F.col("line").rlike("^[a-z]")
    cut = islands(lines, key, "pos", starts)
    return cut.groupBy(key, "island").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("pos", "line"))), lambda x: x["line"]), " ").alias("line"))


def merge_same_titles(poems: DataFrame, key: str, order: str, generic: tuple[str, ...] = ("sonnet", "lines", "ode")) -> DataFrame:
    """Neighbours whose titles are equal, or one the other's beginning, become one with the shorter title; generic titles never merge."""
    w = Window.partitionBy(key).orderBy(order)
    mine, last = F.lower("title"), F.lower(F.lag("title").over(w))
    same = (F.startswith(mine, last) | F.startswith(last, mine)) & ~mine.isin(*generic) & ~last.isin(*generic)
    cut = islands(poems.withColumn("_new", ~F.coalesce(same, F.lit(False))), key, order, F.col("_new"))
    gathered = cut.groupBy(key, "island").agg(F.min(F.struct(F.length("title"), "title")).alias("_t"), F.count("*").alias("parts"), F.sum("n_lines").alias("n_lines"))
    return gathered.filter("n_lines > 1").select(key, "island", F.col("_t.title").alias("title"), "parts", "n_lines")


def outermost(spans: DataFrame, key: str) -> DataFrame:
    """Spans (start, stop) that lie in no earlier one; for spans that nest or are apart, as in a document tree."""
    before = Window.partitionBy(key).orderBy("start", F.col("stop").desc()).rowsBetween(FIRST, -1)
    return spans.withColumn("_end", F.max("stop").over(before)).filter(F.col("_end").isNull() | (F.col("start") >= F.col("_end"))).drop("_end")


def until_latch(rows: DataFrame, key: str, order: str, latch: Column) -> DataFrame:
    """Rows before the first that ``latch`` marks."""
    w = Window.partitionBy(key).orderBy(order).rowsBetween(FIRST, 0)
    return rows.withColumn("_l", F.max(latch.cast("int")).over(w)).filter("_l = 0").drop("_l")


def cap_kind(ranked: DataFrame, by: str, order: list[str], is_capped: Column, cap: int, n: int) -> DataFrame:
    """Of each group the first ``n`` in order, at most ``cap`` of them of the capped kind."""
    w = Window.partitionBy(by).orderBy(*order)
    run = F.sum(is_capped.cast("int")).over(w.rowsBetween(FIRST, 0))
    fitting = ranked.withColumn("_run", run).filter(~is_capped | (F.col("_run") <= cap))
    return fitting.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= n).drop("_run")
