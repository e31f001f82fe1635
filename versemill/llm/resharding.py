"""Resharding that moves the fewest bytes, by minimum-cost flow.

Old shards are supplies (their bytes), new shards are demands (their capacities); a byte that stays costs nothing, one
that moves costs its pair's price (1, or a price given for the pair). The flow is solved on shard totals alone: its size
depends on the number of shards, never on the rows. It is then carried out on documents: inside an old shard, in order of
falling size, each target takes its stretch of bytes, what stays first. This is done in levels: the large documents fill a
share of every stretch, the next smaller ones fill what these left open, and the last few bytes are placed by the smallest
documents, so shards come out equal but for a small document or two.

Defined results: null text has no bytes; repeated rows are rows of their own; equal sizes are ordered by the md5 of the
id, then the id; an empty table gives an empty result; extra columns pass through ``rewrite_affected`` (but ``shard`` and
``write``, which name folders).
"""

from __future__ import annotations

import heapq
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .ranking import ranged, with_prefix, with_rank
from .staging import Staging


def min_cost_flow(supply: list[int], demand: list[int], price) -> dict[tuple[int, int], int]:
    """Cheapest flow from supplies to demands of equal total: successive shortest paths with potentials.

    ``price(i, j)`` is a whole number, 0 or more. Nodes: source, supplies, demands, sink.
    """
    if sum(supply) != sum(demand):
        raise ValueError("supplies and demands differ in total")
    n, m = len(supply), len(demand)
    source, sink, nodes = 0, n + m + 1, n + m + 2
    graph: list[list[list[int]]] = [[] for _ in range(nodes)]  # edges: to, capacity left, price, place of the reverse

    def connect(a: int, b: int, room: int, cost: int) -> None:
        graph[a].append([b, room, cost, len(graph[b])])
        graph[b].append([a, 0, -cost, len(graph[a]) - 1])

    for i, amount in enumerate(supply):
        connect(source, 1 + i, amount, 0)
        for j, wanted in enumerate(demand):
            connect(1 + i, 1 + n + j, min(amount, wanted), price(i, j))
    for j, wanted in enumerate(demand):
        connect(1 + n + j, sink, wanted, 0)
    potential, left = [0] * nodes, sum(supply)
    while left:
        distance, came = [None] * nodes, [None] * nodes
        distance[source], heap = 0, [(0, source)]
        while heap:
            d, a = heapq.heappop(heap)
            if d > distance[a]:
                continue
            for k, (b, room, cost, _) in enumerate(graph[a]):
                if room and (distance[b] is None or d + cost + potential[a] - potential[b] < distance[b]):
                    distance[b], came[b] = d + cost + potential[a] - potential[b], (a, k)
                    heapq.heappush(heap, (distance[b], b))
        potential = [p + (d or 0) for p, d in zip(potential, distance)]
        path, b = [], sink
        while b != source:
            a, k = came[b]
            path.append((a, k))
            b = a
        amount = min(graph[a][k][1] for a, k in path)
        for a, k in path:
            edge = graph[a][k]
            edge[1] -= amount
            graph[edge[0]][edge[3]][1] += amount
        left -= amount
    flow = {}
    for i in range(n):
        for b, _, _, back in graph[1 + i]:
            if b > n and (sent := graph[b][back][1]):
                flow[i, b - n - 1] = sent
    return flow


def document_size(text: Column, overhead: int = 16) -> Column:
    """UTF-8 bytes of the text plus a fixed overhead."""
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + overhead


def _fitted(wanted: list[int], total: int) -> list[int]:
    """Demands of the given total: none below 0, the others cut in proportion."""
    wanted = [max(0, w) for w in wanted]
    over = sum(wanted) - total
    wanted = [w - over * w // max(1, sum(wanted)) for w in wanted]
    for j in range(len(wanted)):  # what rounding left
        change = max(-wanted[j], total - sum(wanted))
        wanted[j] += change
    return wanted


def equal_capacities(total: int, shards: int) -> list[int]:
    return [total // shards + (k < total % shards) for k in range(shards)]


def plan_reshard(rows: DataFrame, new_shards: int, *, old_shards: int, capacities: list[int] | None = None, price=None, shares: tuple[float, ...] = (0.7, 0.95, 0.995, 1.0), staging: Staging | None = None) -> DataFrame:
    """``rows`` has doc_id, size and old_shard (0 to ``old_shards`` - 1), and what else is to be carried; adds ``shard``."""
    staging = staging or Staging(rows.sparkSession, "resharding")
    totals = {r[0]: r[1] for r in rows.groupBy("old_shard").agg(F.sum("size")).collect()}  # a row for each old shard
    supply = [totals.get(k, 0) for k in range(old_shards)]
    demand = capacities or equal_capacities(sum(supply), new_shards)
    key = F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    dealt = ranged(rows, staging, "old_shard", [F.col("size").desc(), key.asc(), F.col("doc_id").asc()])
    placed = staging.write(with_prefix(dealt, "old_shard", "size").drop("_at"), "placed")
    # Large documents first, up to a share of what each target is to get; then smaller ones, by a flow over what is left.
    levels: dict[int, list[tuple[int, list[tuple[int, int]]]]] = {i: [] for i in range(old_shards)}
    done, got = [0] * old_shards, [0] * new_shards
    for k, share in enumerate(shares):
        left = [s - d for s, d in zip(supply, done)]
        flow = min_cost_flow(left, _fitted([d - g for d, g in zip(demand, got)], sum(left)), price or (lambda i, j: int(i != j)))
        for i in range(old_shards):
            stop, at, ends = (int(supply[i] * share) if share < 1 else supply[i] + 1), done[i], []
            for j in sorted((j for a, j in flow if a == i), key=lambda j: (j != i, j)):  # what stays first, then targets by number
                at += flow[i, j] * max(0, min(stop, supply[i]) - done[i]) // max(1, left[i])
                ends.append((j, at))
            levels[i].append((stop, ends or [(i % new_shards, at)]))
        if share < 1:
            here = _assigned(placed, levels).filter(F.col("_level") == k).groupBy("old_shard", "shard").agg(F.sum("size"))
            for i, j, amount in here.collect():  # a row for each edge of the flow at most
                done[i], got[j] = done[i] + amount, got[j] + amount
    return _assigned(placed, levels).drop("_prefix", "_level")


def _assigned(placed: DataFrame, levels: dict[int, list[tuple[int, list[tuple[int, int]]]]]) -> DataFrame:
    """Adds ``shard`` and ``_level``: a document goes where its middle byte goes, by the first level that reaches it (null, if none does yet)."""
    rows = [(i, [(k, stop, ends) for k, (stop, ends) in enumerate(found)]) for i, found in levels.items()]
    kind = "old_shard int, _levels array<struct<k:int,stop:bigint,targets:array<struct<shard:int,end:bigint>>>>"
    middle = F.col("_prefix") + F.expr("size div 2")
    out = placed.join(F.broadcast(placed.sparkSession.createDataFrame(rows, kind)), "old_shard")  # a row for each old shard
    out = out.withColumn("_l", F.get(F.filter("_levels", lambda x: middle < x["stop"]), F.lit(0)))
    hit = F.get(F.filter("_l.targets", lambda t: middle < t["end"]), F.lit(0))["shard"]
    return out.withColumn("shard", F.coalesce(hit, F.element_at("_l.targets", -1)["shard"])).withColumn("_level", F.col("_l.k")).drop("_levels", "_l")


def with_slots(placed: DataFrame, staging: Staging) -> DataFrame:
    """Adds ``slot``: gapless from 0 within each shard, by the md5 of the id. The last step: other tables of ``staging`` are dropped."""
    key = F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    dealt = ranged(placed, staging, "shard", [key.asc(), F.col("doc_id").asc(), F.col("size").asc()])
    staging.keep(dealt)
    return with_rank(dealt, "shard", "slot")


def first_layout(doc_id: Column, old_shards: int) -> Column:
    """Where documents lie that come without a layout: by the crc32 of the id's decimal text."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % old_shards, F.lit(0)).cast("int")


def reshard(docs: DataFrame, new_shards: int = 40, *, old_shards: int = 32, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, size, text_crc32, old_shard, shard, slot) for every row, from a first layout by id over ``old_shards``."""
    staging = Staging(docs.sparkSession, "resharding")
    crc = F.crc32(F.coalesce(F.col(text_col), F.lit("")).cast("binary"))
    light = docs.select(F.col(id_col).alias("doc_id"), document_size(F.col(text_col)).alias("size"), crc.alias("text_crc32"), first_layout(F.col(id_col), old_shards).alias("old_shard"))
    light = staging.write(light, "sizes")
    return with_slots(plan_reshard(light, new_shards, old_shards=old_shards, staging=staging), staging)


# A stored layout: folders ``data/write=<id>/shard=<k>`` that are never changed, and manifests ``layout/v=<n>`` that say in
# which folder each shard is. A manifest counts once its job has committed, so a run that stops anywhere leaves the last one.


def _manifest(spark: SparkSession, path: str) -> tuple[int, dict[int, str]]:
    """The number of the newest manifest (-1 without one), and the write that holds each shard."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    folder = jvm.org.apache.hadoop.fs.Path(f"{path}/layout")
    files = folder.getFileSystem(conf)
    if not files.exists(folder):
        return -1, {}
    found = [s.getPath() for s in files.listStatus(folder) if files.exists(jvm.org.apache.hadoop.fs.Path(s.getPath(), "_SUCCESS"))]
    if not found:
        return -1, {}
    newest = max(int(p.getName().removeprefix("v=")) for p in found)
    rows = spark.read.schema("shard int, write string").json(f"{path}/layout/v={newest}").collect()  # a row for each shard
    return newest, {r.shard: r.write for r in rows}


def _put(rows: DataFrame, path: str, number: int, others: dict[int, str]) -> None:
    """Write ``rows`` into folders by ``shard``, then a manifest with them and the ``others``. Fails if that number is taken."""
    spark, name = rows.sparkSession, uuid.uuid4().hex
    written = f"{path}/data/write={name}"
    rows.write.partitionBy("shard").parquet(written)
    shards = [] if rows.isEmpty() else [r[0] for r in spark.read.option("basePath", written).parquet(written).select("shard").distinct().collect()]
    entries = sorted((others | {s: name for s in shards}).items())
    spark.createDataFrame(entries, "shard int, write string").coalesce(1).write.mode("error").json(f"{path}/layout/v={number}")


def write_layout(docs: DataFrame, path: str) -> None:
    """Store ``docs``, whose ``shard`` says where each row goes, as a new layout at ``path``."""
    _put(docs, path, _manifest(docs.sparkSession, path)[0] + 1, {})


def read_layout(spark: SparkSession, path: str, shards: list[int] | None = None) -> DataFrame:
    """The rows of the newest layout at ``path`` (of some shards), with ``shard``."""
    _, held = _manifest(spark, path)
    folders = [f"{path}/data/write={w}/shard={s}" for s, w in held.items() if shards is None or s in shards]
    return spark.read.option("basePath", f"{path}/data").parquet(*folders).drop("write")


def stored_rows(layout: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, size, old_shard, file, at) of a layout: rows for ``plan_reshard``. A row is known by its place, whatever its id."""
    return layout.select(F.col(id_col).alias("doc_id"), document_size(F.col(text_col)).alias("size"), F.col("shard").alias("old_shard"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("at"))


def rewrite_affected(spark: SparkSession, path: str, plan: DataFrame) -> list[int]:
    """Carry out a plan over ``stored_rows`` of the layout at ``path``; only shards that give or get rows are written anew.

    Returns the affected shards. Readers see the old layout until the new manifest is there; ``vacuum`` removes what is left.
    """
    number, held = _manifest(spark, path)
    moves = plan.filter("old_shard <> shard").select("old_shard", "shard").distinct().collect()  # pairs of shards at most
    affected = sorted({s for r in moves for s in r})
    if not affected:
        return []
    places = plan.filter(F.col("old_shard").isin(affected)).select("file", "at", F.col("shard").alias("new"))
    old = read_layout(spark, path, [s for s in affected if s in held])
    row = F.struct(*[F.col(f"`{c}`") for c in old.columns if c != "shard"]).alias("row")
    rows = old.select(row, F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("at")).join(places, ["file", "at"])
    _put(rows.select("row.*", F.col("new").alias("shard")), path, number + 1, {s: w for s, w in held.items() if s not in affected})
    return affected


def vacuum(spark: SparkSession, path: str) -> None:
    """Delete shard folders that the newest layout doesn't name. Not while something reads or writes an older one."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    _, held = _manifest(spark, path)
    folder = jvm.org.apache.hadoop.fs.Path(f"{path}/data")
    files = folder.getFileSystem(conf)
    for write in files.listStatus(folder):
        for shard in files.listStatus(write.getPath()):
            if (name := shard.getPath().getName()).startswith("shard=") and held.get(int(name.removeprefix("shard="))) != write.getPath().getName().removeprefix("write="):
                files.delete(shard.getPath(), True)
