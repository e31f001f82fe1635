"""Sources that are polled (R02-R05): folders whose files change, timelines and feeds with a position. As streams: ``polled_stream``.

A poll is a batch: it takes what is new against a small state table and gives the next state, which is stored under a version
once the batch is done. So a poll that fails, or is repeated, gives the same rows again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


class State:
    """Versions of a small table at ``path``; the newest complete one counts."""

    def __init__(self, spark: SparkSession, path: str, schema: str):
        self.spark, self.path, self.schema = spark, path, schema

    def _versions(self) -> list[int]:
        jvm, conf = self.spark.sparkContext._jvm, self.spark.sparkContext._jsc.hadoopConfiguration()
        folder = jvm.org.apache.hadoop.fs.Path(self.path)
        files = folder.getFileSystem(conf)
        if not files.exists(folder):
            return []
        found = [s.getPath() for s in files.listStatus(folder)]
        return sorted(int(p.getName().removeprefix("v=")) for p in found if files.exists(jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS")))

    def read(self) -> DataFrame:
        """The newest version; empty before the first."""
        versions = self._versions()
        return self.spark.read.schema(self.schema).parquet(f"{self.path}/v={versions[-1]}") if versions else self.spark.createDataFrame([], self.schema)

    def write(self, table: DataFrame) -> None:
        table.write.parquet(f"{self.path}/v={(self._versions() or [-1])[-1] + 1}")


class FolderWatch:
    """Files of a folder, again whenever one has been modified.

    A file is known by its path and the time it was changed. Both come from the listing, contents are read only of files that
    are new or changed: the least time among those limits what the reader opens.
    """

    def __init__(self, spark: SparkSession, path: str, state: str, pattern: str = "*"):
        self.spark, self.path, self.pattern = spark, path, pattern
        self.state = State(spark, state, "path string, modified timestamp")

    def _files(self) -> DataFrame:
        return self.spark.read.format("binaryFile").option("pathGlobFilter", self.pattern).load(self.path)

    def poll(self) -> tuple[DataFrame, DataFrame]:
        """(new items, next state): (name, path, modified, text) of files to emit, oldest first by ``modified``; ``done`` stores the state."""
        seen = self.state.read().select("path", F.col("modified").alias("_seen"))
        listed = self._files().select("path", F.col("modificationTime").alias("modified"))
        fresh = listed.join(seen, "path", "left").filter(F.col("_seen").isNull() | (F.col("modified") > F.col("_seen"))).select("path", "modified")
        since = fresh.agg(F.min("modified")).first()[0]
        whole = self._files().filter(F.col("modificationTime") >= F.lit(since)) if since is not None else self._files().filter(F.lit(False))
        items = whole.join(fresh.select("path"), "path", "left_semi")
        items = items.select(F.element_at(F.split("path", "/"), -1).alias("name"), "path", F.col("modificationTime").alias("modified"), F.decode("content", "UTF-8").alias("text"))
        return items, listed.unionByName(seen.withColumnRenamed("_seen", "modified")).groupBy("path").agg(F.max("modified").alias("modified"))

    def done(self, state: DataFrame) -> None:
        self.state.write(state)


def poll_timeline(items: DataFrame, cursor: DataFrame, at: str = "at", key: str = "id", most: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(items after the cursor with their place from the oldest on, the next cursor).

    The cursor is a table of at most one row (at, id). ``most`` cuts a poll after so many of the oldest; the rest comes next time.
    """
    last = cursor.agg(F.max(F.struct(at, key)).alias("_c"))
    new = items.withColumn("_c", last.scalar()).filter(F.col("_c").isNull() | (F.struct(at, key) > F.col("_c"))).drop("_c")
    new = new.orderBy(at, key).limit(most) if most is not None else new
    following = new.select(at, key).unionByName(cursor.select(at, key)).agg(F.max(F.struct(at, key)).alias("_c")).filter("_c IS NOT NULL").select("_c.*")
    return new, following


def entry_id(id_: Column, link: Column, title: Column) -> Column:
    """What an entry is known by: its id, else its link, else its title; empty ones count as absent."""
    return F.coalesce(*[F.nullif(F.trim(c), F.lit("")) for c in (id_, link, title)])


def poll_feed(entries: DataFrame, seen: DataFrame, most: int = 500) -> tuple[DataFrame, DataFrame]:
    """(entries not seen yet, each known id once; the next state). Entries: (key, at, ...); the state keeps the ``most`` newest (key, at)."""
    first = entries.filter("key IS NOT NULL").groupBy("key").agg(F.min(F.struct("at", *[c for c in entries.columns if c not in ("key", "at")])).alias("_e")).select("key", "_e.*")
    new = first.join(seen.select("key"), "key", "left_anti")
    known = new.select("key", "at").unionByName(seen.select("key", "at")).groupBy("key").agg(F.max("at").alias("at"))
    return new, known.orderBy(F.col("at").desc(), F.col("key").desc()).limit(most)
