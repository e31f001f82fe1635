"""Event-store operators: flags, upserts, windows of usage, lookups. Tables are DataFrames; an update returns the new table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def set_flag(table: DataFrame, ids: DataFrame, flag: str, value: int, key: str = "id") -> DataFrame:
    """Q01, Q32: ``flag`` becomes ``value`` in the rows whose key is in ``ids``."""
    hit = ids.select(F.col(key).alias("_k")).distinct().withColumn("_hit", F.lit(True))
    return table.join(hit, table[key] == F.col("_k"), "left").withColumn(flag, F.when(F.col("_hit"), F.lit(value)).otherwise(F.col(flag))).drop("_k", "_hit")


def overlay(table: DataFrame, new: DataFrame, column: str, key: str = "id") -> DataFrame:
    """Q02, Q33: ``column`` takes the new value where there is one; of several for one key the greatest."""
    fresh = new.groupBy(F.col(key).alias("_k")).agg(F.max(column).alias("_new"))
    return table.join(fresh, table[key] == F.col("_k"), "left").withColumn(column, F.coalesce("_new", column)).drop("_k", "_new")


def daily_stats(log: DataFrame) -> DataFrame:
    """Triaged, engaged and posted by day, recomputed instead of kept up by upserts."""
    return log.groupBy("day").agg(
        F.count("*").alias("total_triaged"), F.count_if(F.col("decision") != "pass").alias("total_engaged"), F.count_if(F.col("decision") == "post").alias("total_posted"),
    )


def add_stats(old: DataFrame, delta: DataFrame) -> DataFrame:
    """Q04: the additive upsert itself, old and new days summed by key."""
    names = [c for c in old.columns if c != "day"]
    return old.unionByName(delta).groupBy("day").agg(*[F.sum(c).alias(c) for c in names])


def within_hours(at: Column, now: Column, hours: int) -> Column:
    """The last ``hours`` before ``now``."""
    return (at >= now - F.expr(f"INTERVAL {hours} HOURS")) & (at <= now)


def used_chunks(log: DataFrame, now: Column, hours: int = 48) -> DataFrame:
    """Q05: chunk ids of posts in the anti-repetition window, read from the JSON column."""
    recent = log.filter((F.col("decision") == "post") & within_hours(F.col("ts"), now, hours))
    return recent.select(F.get_json_object("passage_used", "$.chunk_id").alias("chunk_id")).filter("chunk_id IS NOT NULL").distinct()


def trailing_count(log: DataFrame, seconds: int, by: str | None = None, out: str = "n_trailing") -> DataFrame:
    """For each row, rows in the window of ``seconds`` up to and with it (of its key, if ``by`` is given).

    Time is cut into blocks of ``seconds``; a time enters in its own block, and enters and leaves again in the next, so a
    window reaches across any boundary and is a running sum, whose cost doesn't grow with the rows in a window. Rows of one
    time are counted first.
    """
    micros, key = seconds * 1_000_000, [by] if by else []
    keyed = log.withColumn("_at", F.unix_micros(F.col("ts").cast("timestamp")))
    times = keyed.filter("_at IS NOT NULL").groupBy(*key, "_at").agg(F.count("*").alias("_n"))
    block = F.expr(f"(_at - pmod(_at, {micros})) div {micros}")
    step = lambda b, at, n, own: F.struct(b.alias("_block"), at.alias("_t"), n.alias("_step"), F.lit(own).alias("_own"))
    at, n = F.col("_at"), F.col("_n")
    steps = times.select(*key, F.inline(F.array(step(block, at, n, True), step(block + 1, at, n, False), step(block + 1, at + micros + 1, -n, False))))
    running = F.sum("_step").over(Window.partitionBy(*key, "_block").orderBy("_t"))
    counted = steps.withColumn(out, running).filter("_own").select(*[F.col(c).alias("_by") for c in key], "_t", out)
    on = [F.col("_at") == F.col("_t"), *([F.col(by).eqNullSafe(F.col("_by"))] if by else [])]
    return keyed.join(counted, on).select(*log.columns, out)


def value_or_default(table: DataFrame, key: str, value: object, defaults: dict[str, object]) -> DataFrame:
    """Q07, Q10: the row of one key, or a row of defaults; always one row."""
    return table.filter(F.col(key) == value).agg(*[F.coalesce(F.max(c), F.lit(d)).alias(c) for c, d in defaults.items()]).withColumn(key, F.lit(value))


def newest(table: DataFrame, k: int, *order: str) -> DataFrame:
    """The ``k`` newest rows; a bounded sort, never a full one."""
    return table.orderBy(*[F.col(c).desc() for c in order]).limit(k)


def newest_per(table: DataFrame, by: str, k: int, *order: str) -> DataFrame:
    """The ``k`` newest of each group."""
    rank = F.row_number().over(Window.partitionBy(by).orderBy(*[F.col(c).desc() for c in order]))
    return table.withColumn("_r", rank).filter(F.col("_r") <= k).drop("_r")


def older_than_newest(table: DataFrame, by: str, k: int, *order: str) -> DataFrame:
    """All but the ``k`` newest of each group."""
    rank = F.row_number().over(Window.partitionBy(by).orderBy(*[F.col(c).desc() for c in order]))
    return table.withColumn("_r", rank).filter(F.col("_r") > k).drop("_r")


def upsert_notes(old: DataFrame, new: DataFrame) -> DataFrame:
    """Keyed upsert of (chunk_id, times_used, last_used, note, themes): counts add, the newest date and the new
    note win where present, themes are united in order. Each side is one row for each key first, so applying it is one join."""
    o, n = old.alias("o"), new.alias("n")
    joined = o.join(n, F.col("o.chunk_id") == F.col("n.chunk_id"), "full_outer")
    empty = F.array().cast("array<string>")
    return joined.select(
        F.coalesce("o.chunk_id", "n.chunk_id").alias("chunk_id"),
        (F.coalesce("o.times_used", F.lit(0)) + F.coalesce("n.times_used", F.lit(0))).alias("times_used"), F.greatest("o.last_used", "n.last_used").alias("last_used"),
        F.coalesce("n.note", "o.note").alias("note"), F.array_distinct(F.concat(F.coalesce("o.themes", empty), F.coalesce("n.themes", empty))).alias("themes"),
    )


def latest_per(table: DataFrame, by: str, columns: list[str], order: Column) -> DataFrame:
    """Of each group the last row, by aggregation (no sort)."""
    return table.groupBy(by).agg(F.max_by(F.struct(*columns), order).alias("_l")).select(by, *[F.col(f"_l.{c}").alias(c) for c in columns])


def usage(table: DataFrame, by: str) -> DataFrame:
    """Rows by key, non-null keys only."""
    return table.filter(F.col(by).isNotNull()).groupBy(by).agg(F.count("*").alias("n"))


def theme_usage(table: DataFrame, column: str = "themes") -> DataFrame:
    """Values of a JSON array column, unnested and counted."""
    return table.select(F.explode(F.from_json(column, "array<string>")).alias("theme")).groupBy("theme").agg(F.count("*").alias("n"))


def posted(log: DataFrame, *, since: str | None = None, dry_run: int | None = None, day: str | None = None, but_source: str | None = None) -> DataFrame:
    """Q22, Q23: posts, under those conditions that are given. A null source fails ``but_source``, as in SQL."""
    out = log.filter(F.col("decision") == "post")
    if since is not None:
        out = out.filter(F.col("ts") >= F.lit(since).cast("timestamp_ntz"))
    if dry_run is not None:
        out = out.filter(F.col("dry_run") == dry_run)
    if day is not None:
        out = out.filter(F.col("day") == F.lit(day).cast("date"))
    if but_source is not None:
        out = out.filter(F.col("source") != but_source)
    return out


def first_value(table: DataFrame, value: Column, order: Column, where: Column, out: str) -> DataFrame:
    """Q30: one value of the earliest row that fits, as a one-row table for use as a scalar."""
    return table.filter(where).agg(F.min_by(value, order).alias(out))


def apply_fixes(table: DataFrame, fixes: DataFrame, key: str = "id") -> DataFrame:
    """Replace the elements of the edited posts (the posts, where nothing is edited) that fixes (key, position, replacement) name.

    All fixes of a row are applied together; of several for one position the greatest replacement counts.
    """
    base = F.coalesce(F.when(F.size("edited_posts") > 0, F.col("edited_posts")), F.col("posts"), F.array().cast("array<string>"))
    single = fixes.groupBy(F.col(key).alias("_k"), "position").agg(F.max("replacement").alias("replacement")).filter("position IS NOT NULL AND replacement IS NOT NULL")
    by_row = single.groupBy("_k").agg(F.map_from_entries(F.collect_list(F.struct("position", "replacement"))).alias("_fixes"))  # as many as a row has posts
    joined = table.join(by_row, table[key] == F.col("_k"), "left")
    edited = F.when(F.col("_k").isNotNull(), F.transform(base, lambda x, i: F.coalesce(F.try_element_at("_fixes", i), x))).otherwise(F.col("edited_posts"))
    return joined.withColumn("edited_posts", edited).drop("_k", "_fixes")


def with_columns_added(table: DataFrame, wanted: dict[str, str]) -> DataFrame:
    """Q36: additive migration: missing columns appear as nulls of their type."""
    missing = {c: F.lit(None).cast(t) for c, t in wanted.items() if c not in table.columns}
    return table.withColumns(missing) if missing else table


#: Q03, Q12, Q17, Q26: the columns of the tables that rows are appended to, in order, and which of them hold JSON.
TABLES = {
    "interactions": "timestamp source stimulus_uri stimulus_text stimulus_author triage_engage triage_reason triage_queries the_problem passages_retrieved passage_used composition_decision composition_mode posts response_uris skip_reason tokens_in tokens_out dry_run".split(),
    "readings": "chunk_id poet poem_title interaction_id timestamp stimulus_text collision_note themes".split(),
    "reflections": "timestamp period summary poets_used themes_used preoccupations recommendations self_notes".split(),
    "chat_sessions": "user_name started last_active summary".split(),
    "chat_turns": "session_id role content timestamp model_used passages_used".split(),
}


def log_rows(rows: DataFrame, table: str) -> DataFrame:
    """Q03, Q12, Q17, Q26: rows as they are appended to ``table``: its columns in order, absent ones null, booleans as 0 or 1,
    arrays, maps and structs as JSON. ``triage_engage`` follows from the decision where it is not given."""
    if table == "interactions" and "triage_engage" not in rows.columns and "composition_decision" in rows.columns:
        rows = rows.withColumn("triage_engage", F.coalesce(F.col("composition_decision") != "pass", F.lit(False)))
    kinds = dict(rows.dtypes)

    def stored(c: str) -> Column:
        if c not in kinds:
            return F.lit(None).cast("string")
        if kinds[c] == "boolean":
            return F.col(c).cast("int")
        return F.to_json(c) if kinds[c].startswith(("array", "map", "struct")) else F.col(c)

    return rows.select(*[stored(c).alias(c) for c in TABLES[table]])


def touch_sessions(sessions: DataFrame, turns: DataFrame, summaries: DataFrame | None = None) -> DataFrame:
    """Q26, Q29: sessions with ``last_active`` moved up to their newest turn, and with a new summary where there is one (of several the greatest)."""
    newest = turns.groupBy(F.col("session_id").alias("_s")).agg(F.max("timestamp").alias("_t"))
    out = sessions.join(newest, sessions["id"] == F.col("_s"), "left").withColumn("last_active", F.greatest("last_active", "_t")).drop("_s", "_t")
    return out if summaries is None else overlay(out, summaries, "summary")


def note_of(notes: DataFrame, chunk_id: str) -> DataFrame:
    """Q14: one note with its themes read from JSON; an array that doesn't parse is empty, an unknown id gives no row."""
    themes = F.coalesce(F.from_json("themes", "array<string>"), F.array().cast("array<string>"))
    return notes.filter(F.col("chunk_id") == chunk_id).withColumn("themes", themes)


def capped_first(table: DataFrame, by: str, n: int, *order: str) -> DataFrame:
    """Q27: the first ``n`` rows of each group in order."""
    rank = F.row_number().over(Window.partitionBy(by).orderBy(*order))
    return table.withColumn("_r", rank).filter(F.col("_r") <= n).drop("_r")
