"""Structured Streaming (R): the batch operators on streams, with event time and watermarks. Keyed state with timers: ``timers``."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from itertools import islice

import pandas as pd
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from ..operators.filters import language_passes, match_keywords, open_envelope


def read_stream(spark: SparkSession, path: str, schema: str, *, fmt: str = "parquet", files: int | None = None) -> DataFrame:
    """New files of a folder as a stream, oldest first; what was read is kept in the checkpoint, so a restart goes on where it stopped.

    Files that change after they were read are not read again; see ``sources.polling.FolderWatch`` for those.
    """
    reader = spark.readStream.schema(schema).format(fmt)
    return (reader.option("maxFilesPerTrigger", files) if files else reader).load(path)


def drain(stream: DataFrame, checkpoint: str, mode: str, sink: Callable[[DataFrame, int], None]) -> None:
    """Run a stream over what is there and stop. ``sink`` gets each batch, the same again after a failure, and must overwrite by batch number."""
    stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(sink).start().awaitTermination()


def keyword_stream(messages: DataFrame, raw: str, collection: str, keywords: list[str], language: str = "en") -> DataFrame:
    """Created posts of a language with a keyword."""
    opened = open_envelope(messages, raw, collection).filter(language_passes(F.col("langs"), language))
    return match_keywords(opened, "text", keywords)


def merge(*sources: DataFrame) -> DataFrame:
    """Several sources as one stream; no order between them is promised."""
    out = sources[0]
    for s in sources[1:]:
        out = out.unionByName(s, allowMissingColumns=True)
    return out


def build_sources(spark: SparkSession, configs: list[dict], kinds: dict[str, Callable[[SparkSession, dict], DataFrame]]) -> list[DataFrame]:
    """Streams of the configured sources; unknown kinds are left out; a ``mode`` in the configuration wins."""
    found = [(c, kinds[c["type"]](spark, c)) for c in configs if c.get("type") in kinds]
    return [s.withColumn("mode", F.lit(c["mode"])) if "mode" in c else s for c, s in found]


def route(items: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(seeds, items to triage); clips are both."""
    clip = F.startswith("source", F.lit("stimuli_dir"))
    return items.filter((F.col("mode") == "seed") | clip), items.filter((F.col("mode") == "triage") | clip)


def dedup(stream: DataFrame, key: str, at: str, horizon: str) -> DataFrame:
    """Each key once within the horizon; state older than that is dropped."""
    return stream.withWatermark(at, horizon).dropDuplicatesWithinWatermark([key])


def daily_counts(stream: DataFrame, at: str, by: str, late: str = "1 day") -> DataFrame:
    """Q04 on a stream: tumbling days."""
    return stream.withWatermark(at, late).groupBy(F.window(at, "1 day").alias("w"), by).agg(F.count("*").alias("n")).select(F.to_date("w.start").alias("day"), by, "n")


def hourly_rate(stream: DataFrame, at: str, late: str = "1 hour") -> DataFrame:
    """Q06 on a stream: the last hour, every 15 minutes."""
    return stream.withWatermark(at, late).groupBy(F.window(at, "1 hour", "15 minutes").alias("w")).agg(F.count("*").alias("n")).select(F.col("w.end").alias("at"), "n")


def latest_seeds(stream: DataFrame, key: str, at: Column, value: str) -> DataFrame:
    """The latest item of each source."""
    return stream.groupBy(key).agg(F.max_by(value, at).alias(value), F.max(at).alias("at"))


def seed_context(seeds: DataFrame, key: str, value: str, longest: int = 4000) -> DataFrame:
    """The seeds as one text of at most ``longest`` characters; one row for each source goes into it."""
    line = F.concat(F.lit("["), key, F.lit("] "), F.substring(value, 1, 500))
    return seeds.agg(F.substring(F.array_join(F.array_sort(F.collect_list(line)), "\n"), 1, longest).alias("context"))


ADMITTED = "id long, key string, admitted boolean, reason string"


class Admission:
    """May this item be answered? In order: hourly cap, daily cap, cooldown, at most two answers to one text in 24 hours.

    The state holds the times of what was admitted, dropped when they are over a day old; so it is bounded by the daily cap.
    """

    def __init__(self, per_hour: int = 10, per_day: int = 30, cooldown: float = 60, repeats: int = 2):
        self.per_hour, self.per_day, self.cooldown, self.repeats = per_hour, per_day, cooldown, repeats

    def decide(self, at: float, text: str, posts: list[float], seen: dict[str, list[float]]) -> str:
        """The reason for refusal, or an empty string; times of admissions are added to the state."""
        posts[:] = [p for p in posts if p > at - 86400]
        text = text[:200]
        answered = [p for p in seen.get(text, []) if p > at - 86400]
        if sum(p > at - 3600 for p in posts) >= self.per_hour:
            return "hourly cap"
        if sum(p // 86400 == at // 86400 for p in posts) >= self.per_day:
            return "daily cap"
        if posts and at - posts[-1] < self.cooldown:
            return "cooldown"
        if len(answered) >= self.repeats:
            return "stimulus dedup"
        posts.append(at)
        seen[text] = [*answered, at]
        return ""

    def fold(self, pdf: pd.DataFrame, posts: list[float], seen: dict[str, list[float]]) -> pd.DataFrame:
        pdf = pdf.sort_values(["at", "id"])
        reasons = [self.decide(r.at, r.text or "", posts, seen) for r in pdf.itertuples()]
        return pd.DataFrame({"id": pdf.id.to_numpy(), "key": pdf.key.to_numpy(), "admitted": [not r for r in reasons], "reason": reasons})

    def batch(self, items: DataFrame) -> DataFrame:
        """Items (id, key, at in seconds, text): each key (an account that answers) is decided on its own, in order of time.

        Spark sorts a key's rows and hands them over in slices, so a key's history is never in memory at once: only the state is.
        """

        def decided(slices: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            posts, seen = [], {}
            for pdf in slices:
                yield self.fold(pdf, posts, seen)
                seen = self.recent(posts, seen)

        ordered = items.repartition("key").sortWithinPartitions("key", "at", "id")
        return ordered.groupBy("key").applyInPandas(decided, ADMITTED)

    @staticmethod
    def recent(posts: list[float], seen: dict[str, list[float]]) -> dict[str, list[float]]:
        """``seen`` without texts last answered over a day before the newest admission."""
        newest = max(posts, default=0.0)
        return {k: v for k, v in seen.items() if v and v[-1] > newest - 86400}


def drop_name(at: Column, title: Column) -> Column:
    """The file name under which a clip is dropped."""
    from ..functions.text import slug

    return F.concat(F.date_format(at, "yyyyMMdd-HHmmss"), F.lit("-"), slug(title, 40, ascii_only=True), F.lit(".md"))


#: Files that are written side by side: what takes time is waiting for the file system.
DROPS_AT_ONCE = 16


def drop_clips(clips: DataFrame, path: str) -> None:
    """Clips (at, title, text) as one file each under ``path``, named by time and title; for ``foreachBatch`` too.

    The same clip gets the same name, so a repeated batch writes the same files; of several texts for one name the greatest
    counts. Files are written several at a time.
    """
    named = clips.select(drop_name(F.col("at"), F.col("title")).alias("name"), "text").groupBy("name").agg(F.max("text").alias("text"))
    context = clips.sparkSession.sparkContext
    new = context._jvm.org.apache.hadoop.fs.Path
    files = new(path).getFileSystem(context._jsc.hadoopConfiguration())

    def drop(row: Row) -> None:
        stream = files.create(new(f"{path}/{row.name}"), True)
        stream.write(bytearray((row.text or "").encode()))
        stream.close()

    rows = named.toLocalIterator()  # one partition at a time on the driver, which has the file system at hand
    with ThreadPoolExecutor(DROPS_AT_ONCE) as pool:
        while some := list(islice(rows, 1024)):
            list(pool.map(drop, some))
