"""N-gram Jaccard join: all pairs of documents whose word-shingle sets overlap by 75 % or more, exactly.

1. One scan hashes each text. It gives each document its set's size and digest (equal sets are one class from here on) and
   sends (shingle, document) to token ranges, in packed blocks of sorted hashes. A shingle that only one document holds can
   be in no intersection; only the others go back to their documents. A shingle that is very frequent inside one block is
   not gathered: its entries pass through, marked frequent, so no range grows with a hot passage.
2. A document can link only if 75 % of its shingles are shared. Of those left, each takes as prefix as many of its rarest
   shingles as a partner could miss, plus one; partners share a prefix shingle. Documents that are connected by prefix
   shingles (of fitting size) form candidate groups. What is gathered for a shingle is a row for each size of set, never its
   documents; they look up the chain of sizes they belong to.
3. Each group is compared in size-banded tiles: only sizes within the ratio meet, bit counts of hashed bitmaps bound the
   overlap from above, and what is left is decided by intersecting sorted arrays. Pairs already connected by links are
   passed over.
4. A group over ``tile`` documents or ``tile_tokens`` shingles is first linked through representatives: each document is
   compared with the least of each chain it is in, which is linear. Its largest class is then settled: only the documents
   outside it are compared, with each other and with it, in tiles of at most two blocks.

Sets are of 56-bit hashes of 64-bit word hashes: two documents of 500 words have one wrongly equal pair of shingles in about
3 x 10^11 comparisons.

Defined results: null or empty text, or one of blanks only, has an empty set, links with nothing and is its own
component; under five words the whole sequence is the one shingle; equal texts link; repeated rows get equal answers; a
null doc_id takes part but never names a component if another id is there; ``jaccard_components`` ignores extra columns and
``one_of_each`` passes them through, whatever their names.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .components import connected_components
from .staging import Staging, deal
from .textbytes import SHINGLE_BITS, pack, pack_sorted, release, set_digest, shingle_sets, unpack, unpack_sorted

FREQUENT = 1 << 30
BLOCK = "part int, kind string, flush long, tokens binary, docs binary, counts binary"
FOUND = "doc_id long, text_key long, digest long, n long, tokens binary, prefix array<long>"
PROFILE = pa.schema([("doc_id", pa.int64()), ("text_key", pa.int64()), ("digest", pa.int64()), ("n", pa.int64())])


def _send_tokens(batches, width: int, parts: int, block_tokens: int, frequent: int):
    """Blocks for the token ranges; ``kind``: n (entries), f (frequent tokens), p (entries of those), d (the block's sets), r (profiles of all its rows)."""
    task = TaskContext.get().partitionId() << 20
    sets: list[np.ndarray] = []
    digests: list[int] = []
    profiles: list[pa.RecordBatch] = []
    seen: set[int] = set()
    held = flush = waiting = 0

    def blocks():
        out = pa.BufferOutputStream()
        with pa.ipc.new_stream(out, PROFILE, options=pa.ipc.IpcWriteOptions(compression="zstd")) as writer:
            for profile in profiles:
                writer.write_batch(profile)
        rows = [(flush % parts, "r", out.getvalue().to_pybytes(), b"")]
        if sets:
            lengths = np.array([len(s) for s in sets], np.int64)
            tokens, docs = np.concatenate(sets), np.repeat(np.arange(len(sets), dtype=np.uint16), lengths)
            rows.append((flush % parts, "d", pack(np.array(digests, np.int64)), pack(lengths)))
            order = np.argsort(tokens, kind="stable")
            tokens, docs = tokens[order], docs[order]
            runs = np.flatnonzero(np.r_[True, tokens[1:] != tokens[:-1]])
            lengths = np.diff(np.r_[runs, len(tokens)])
            often = np.repeat(lengths > frequent, lengths)
            del order
            if often.any():
                rows.append((flush % parts, "p", pack_sorted(tokens[often]), pack(docs[often])))
            for kind, some, whose in (("n", tokens[~often], docs[~often]), ("f", tokens[runs[lengths > frequent]], None)):
                part = ((some >> np.uint64(SHINGLE_BITS - 32)) * np.uint64(parts)) >> np.uint64(32)
                bounds = np.searchsorted(part, np.arange(parts + 1, dtype=np.uint64))
                for p in np.flatnonzero(np.diff(bounds)):
                    a, b = bounds[p], bounds[p + 1]
                    rows.append((int(p), kind, pack_sorted(some[a:b]), pack(whose[a:b]) if whose is not None else b""))
        part, kind, first, second = zip(*rows)
        n = len(rows)
        yield pa.RecordBatch.from_arrays(
            [pa.array(part, pa.int32()), pa.array(kind), pa.array([task + flush] * n, pa.int64()), pa.array(first, pa.binary()), pa.array(second, pa.binary()), pa.array([b""] * n, pa.binary())],
            ["part", "kind", "flush", "tokens", "docs", "counts"],
        )

    for batch in batches:
        sizes, own = np.zeros(batch.num_rows, np.int64), np.zeros(batch.num_rows, np.int64)
        first = 0

        def profile(last):
            some = slice(first, last)
            columns = [batch.column("doc_id")[some], batch.column("text_key")[some], pa.array(own[some], mask=sizes[some] == 0), pa.array(sizes[some])]
            return pa.RecordBatch.from_arrays(columns, schema=PROFILE)

        for row, tokens in shingle_sets(batch.column("text"), width):
            digest = set_digest(tokens)
            if len(tokens) and digest not in seen:
                if sets and (held + len(tokens) > block_tokens or len(sets) == 1 << 16):
                    profiles.append(profile(row))
                    yield from blocks()
                    sets, digests, profiles, held, flush, waiting, first = [], [], [], 0, flush + 1, 0, row
                seen.add(digest)
                sets.append(tokens)
                digests.append(digest)
                held += len(tokens)
            sizes[row], own[row] = len(tokens), digest
        profiles.append(profile(batch.num_rows))
        waiting += batch.num_rows - first
        if waiting > 1 << 18:  # rows that bring no new sets
            yield from blocks()
            sets, digests, profiles, held, flush, waiting = [], [], [], 0, flush + 1, 0
    if profiles:
        yield from blocks()
    release()


def _shared_tokens(pdf: pd.DataFrame) -> pd.DataFrame:
    """Of one token range: the entries whose token more than one document holds, back by block of documents."""
    out = [(r.flush, r.kind, r.tokens, r.docs, b"") for r in pdf[pdf.kind.isin(["d", "p", "r"])].itertuples()]
    rows = [(r.flush, unpack_sorted(r.tokens), unpack(r.docs, np.uint16)) for r in pdf[pdf.kind == "n"].itertuples()]
    if rows:
        often = [unpack_sorted(t) for t in pdf[pdf.kind == "f"].tokens]
        often = np.unique(np.concatenate(often)) if often else np.zeros(0, np.uint64)
        tokens = np.concatenate([t for _, t, _ in rows])
        order = np.argsort(tokens, kind="stable")
        arranged = tokens[order]
        runs = np.flatnonzero(np.r_[True, arranged[1:] != arranged[:-1]])
        lengths = np.diff(np.r_[runs, len(arranged)])
        lengths[np.isin(arranged[runs], often)] = FREQUENT
        counts = np.empty(len(tokens), np.uint32)
        counts[order] = np.repeat(lengths, np.diff(np.r_[runs, len(arranged)]))
        at = 0
        for flush, some, docs in rows:
            count = counts[at : at + len(some)]
            at += len(some)
            if (shared := count > 1).any():
                out.append((flush, "n", pack_sorted(some[shared]), pack(docs[shared]), pack(count[shared])))
    return pd.DataFrame(out, columns=["flush", "kind", "tokens", "docs", "counts"]).assign(part=0)[["part", "kind", "flush", "tokens", "docs", "counts"]]


def least_overlap(n, percent: int):
    """The smallest overlap a set of ``n`` needs with any partner."""
    return -(-n * percent // 100)


def _survivors(block: pa.Table, percent: int) -> pa.Table:
    """Of one block: the profiles of its rows, and its sets that share enough shingles, with these (sorted) and the prefix."""
    by_kind: dict[str, list] = {}
    for kind, tokens, docs, counts in zip(*(block[c].to_pylist() for c in ("kind", "tokens", "docs", "counts"))):
        by_kind.setdefault(kind, []).append((tokens, docs, counts))
    profiles = pa.concat_tables(pa.ipc.open_stream(t).read_all() for t, _, _ in by_kind["r"])
    out: list[tuple[int, int, bytes, list[int]]] = []
    rows = [(unpack_sorted(t), unpack(d, np.uint16), unpack(c, np.uint32) if kind == "n" else None) for kind in "np" for t, d, c in by_kind.get(kind, [])]
    if rows:
        digests, sizes = unpack(by_kind["d"][0][0], np.int64), unpack(by_kind["d"][0][1], np.int64)
        tokens, docs = np.concatenate([t for t, _, _ in rows]), np.concatenate([d for _, d, _ in rows])
        counts = np.concatenate([np.full(len(t), FREQUENT, np.uint32) if c is None else c for t, _, c in rows])
        order = np.lexsort((tokens, docs))
        tokens, docs, counts = tokens[order], docs[order], counts[order]
        bounds = np.searchsorted(docs, np.arange(len(digests) + 1))
        for i in np.flatnonzero(np.diff(bounds) >= least_overlap(sizes, percent)):
            some, often = tokens[bounds[i] : bounds[i + 1]], counts[bounds[i] : bounds[i + 1]]
            prefix = int(sizes[i] - least_overlap(sizes[i], percent)) + 1 - int(sizes[i] - len(some))  # unshared ones come first
            rarest = some[np.lexsort((some, often))[:prefix]]
            out.append((int(digests[i]), int(sizes[i]), pack_sorted(some), rarest.view(np.int64).tolist()))
    none, kinds = pa.nulls(len(out), pa.int64()), (pa.int64(), pa.int64(), pa.binary(), pa.list_(pa.int64()))
    found = pa.Table.from_arrays([none, none, *(pa.array([r[k] for r in out], t) for k, t in enumerate(kinds))], ["doc_id", "text_key", "digest", "n", "tokens", "prefix"])
    return pa.concat_tables([profiles, found], promote_options="default").select(found.column_names)


def candidate_edges(found: DataFrame, percent: int, staging: Staging) -> DataFrame:
    """(a, b): each document tied to the smallest digest among those that share a prefix shingle and form a chain of fitting sizes.

    A shingle's row for each size (as many as sets have sizes, whatever the number of documents) is all that a window gathers.
    """
    entries = found.select("digest", "n", F.explode("prefix").alias("token"))
    sizes = entries.groupBy("token", "n").agg(F.min("digest").alias("least"), F.max("digest").alias("most"))
    by_size = Window.partitionBy("token").orderBy("n")
    broken = F.coalesce((F.lag("n").over(by_size) * 100 < F.col("n") * percent).cast("int"), F.lit(0))
    chained = sizes.withColumn("broken", broken).withColumn("chain", F.sum("broken").over(by_size.rowsBetween(Window.unboundedPreceding, 0)))
    whole = Window.partitionBy("token", "chain")
    chained = chained.select("token", "n", F.min("least").over(whole).alias("a"), F.max("most").over(whole).alias("z")).filter("a <> z")
    chained = staging.write(chained.select("token", "n", "a"), "chains")  # so that both sides of the join are plain shuffles, which Spark can split
    return entries.join(chained, ["token", "n"]).filter("a <> digest").select("a", F.col("digest").alias("b")).distinct()


class _Tile:
    """Documents of one candidate group, by size, with bitmaps."""

    def __init__(self, rows: pd.DataFrame):
        rows = rows.sort_values(["n", "digest"])
        self.digest, self.n, self.side = rows.digest.to_numpy(), rows.n.to_numpy(), rows.side.to_numpy()
        self.group = pd.factorize(rows.cls)[0]
        self.sets = [unpack_sorted(t) for t in rows.tokens]
        self.held = np.array([len(s) for s in self.sets])
        bits = 1 << min(13, max(8, int(2 * self.held.max()).bit_length()))
        flags = np.zeros((len(rows), bits), bool)
        for i, s in enumerate(self.sets):
            flags[i, (s & np.uint64(bits - 1)).astype(np.int64)] = True
        self.bitmap = np.packbits(flags, axis=1).view(np.uint64)

    def links(self, percent: int):
        """Links that connect what links connect: pairs already connected are passed over."""
        group = self.group.copy()
        for i in range(len(self.n)):
            last = int(np.searchsorted(self.n, self.n[i] * 100 // percent, "right"))
            near = np.arange(i + 1, last)
            near = near[(group[near] != group[i]) & ((self.side[near] != self.side[i]) | (self.side[i] < 0))]
            if not len(near):
                continue
            needed = -(-percent * (self.n[near] + self.n[i]) // (100 + percent))
            lost = np.bitwise_count(self.bitmap[i] & ~self.bitmap[near]).sum(axis=1)
            gone = np.bitwise_count(self.bitmap[near] & ~self.bitmap[i]).sum(axis=1)
            bound = np.minimum(self.held[i] - lost.astype(np.int64), self.held[near] - gone.astype(np.int64))
            for j, least in zip(near[bound >= needed], needed[bound >= needed]):
                if group[j] != group[i] and len(np.intersect1d(self.sets[i], self.sets[j], assume_unique=True)) >= least:
                    group[group == group[j]] = group[i]
                    yield int(self.digest[i]), int(self.digest[j])


def _tile_links(pdf: pd.DataFrame, percent: int) -> pd.DataFrame:
    found = [pair for _, rows in pdf.groupby("comp", sort=False) for pair in _Tile(rows).links(percent)]
    return pd.DataFrame(found, columns=["a", "b"], dtype="int64")


def _linked_pairs(batches, percent: int):
    """Of pairs with both sets: those that link."""
    for batch in batches:
        columns = [batch.column(c).to_pylist() for c in ("a", "b", "n_a", "n_b", "tokens_a", "tokens_b")]
        found, last, one = ([], []), None, None
        for a, b, n, m, mine, theirs in zip(*columns):
            if 100 * min(n, m) < percent * max(n, m):
                continue
            if a != last:
                last, one = a, unpack_sorted(mine)
            if len(np.intersect1d(one, unpack_sorted(theirs), assume_unique=True)) >= -(-percent * (n + m) // (100 + percent)):
                found[0].append(a)
                found[1].append(b)
        yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in found], ["a", "b"])


def _large_cells(rows: DataFrame, edges: DataFrame, percent: int, blocks: Column, staging: Staging) -> tuple[DataFrame, DataFrame]:
    """For groups too large for one tile: links to representatives, and cells of what these leave open.

    A unit is a block of a band of the open documents or of the settled ones; open units meet all units of their band and the
    two beside it, settled units meet open ones only.
    """
    side = lambda x: rows.select(F.col("digest").alias(x), F.col("n").alias(f"n_{x}"), F.col("tokens").alias(f"tokens_{x}"))
    stars = edges.join(side("b"), "b").join(side("a"), "a")
    stars = staging.write(stars.mapInArrow(lambda it: _linked_pairs(it, percent), "a long, b long"), "star-links")
    near = connected_components(stars, staging)
    classed = rows.join(near.select(F.col("node").alias("digest"), F.col("label").alias("cls")), "digest", "left").withColumn("cls", F.coalesce("cls", "digest"))
    sizes = classed.groupBy("comp", "cls").agg(F.count("*").alias("k")).groupBy("comp").agg(F.max_by("cls", F.struct("k", "cls")).alias("main"))
    classed = staging.write(classed.join(sizes, "comp").withColumn("open", F.col("cls") != F.col("main")).drop("main"), "classed")
    counts = classed.groupBy("comp", "band", "open").agg(F.count("*").alias("k"), F.sum("n").alias("t"))
    per = lambda flag: F.map_from_entries(F.collect_list(F.when(F.col("open") == flag, F.struct("band", blocks.alias("blocks")))))
    plan = staging.write(counts.groupBy("comp").agg(per(True).alias("open_blocks"), per(False).alias("main_blocks")), "plan")
    has = lambda m, b: F.coalesce(F.try_element_at(m, b), F.lit(0))
    units = lambda m, flag, b: F.when(has(m, b) > 0, F.transform(F.sequence(F.lit(0), has(m, b) - 1, F.lit(1)), lambda x: F.struct(F.lit(flag).alias("open"), b.alias("band"), x.alias("block")))).otherwise(F.array().cast("array<struct<open:boolean,band:int,block:int>>"))
    beside = lambda m, flag: [units(F.col(m), flag, (F.col("band") + k).cast("int")) for k in (-1, 0, 1)]
    own = F.when(F.col("open"), has(F.col("open_blocks"), F.col("band"))).otherwise(has(F.col("main_blocks"), F.col("band")))
    met = classed.join(plan, "comp").withColumn("me", F.struct("open", "band", F.pmod(F.xxhash64("digest"), own).cast("int").alias("block")))
    others = F.when(F.col("open"), F.concat(*beside("open_blocks", True), *beside("main_blocks", False))).otherwise(F.concat(*beside("open_blocks", True)))
    met = met.withColumn("other", F.explode(others))
    low, high = F.least("me", "other"), F.greatest("me", "other")
    name = F.concat_ws("-", F.lit("l"), "comp", *[x[k].cast("string") for x in (low, high) for k in ("open", "band", "block")])
    place = F.when(F.col("me") == F.col("other"), -1).when(F.col("me") == low, 0).otherwise(1)
    return stars, met.select(name.alias("cell"), "comp", place.alias("side"), "digest", "n", "tokens", "cls")


def links_between(found: DataFrame, percent: int, tile: int, tile_tokens: int, staging: Staging) -> DataFrame:
    """(a, b): links that connect what links connect. ``found``: (digest, n, tokens, prefix), digests may repeat."""
    edges = staging.write(candidate_edges(found, percent, staging), "candidates")
    groups = connected_components(edges, staging)
    band = F.floor(F.log(F.col("n").cast("double")) / math.log(100 / percent) + 1e-9).cast("int")
    rows = found.select("digest", "n", "tokens").dropDuplicates(["digest"]).join(groups.select(F.col("node").alias("digest"), F.col("label").alias("comp")), "digest")
    rows = staging.write(rows.select("comp", "digest", "n", "tokens", band.alias("band")), "rows")
    plan = staging.write(rows.groupBy("comp").agg(F.count("*").alias("k"), F.sum("n").alias("t")), "groups")
    blocks = F.greatest(F.ceil(F.col("k") / tile), F.ceil(F.col("t") / tile_tokens)).cast("int")
    is_large = (F.col("k") > tile) | (F.col("t") > tile_tokens)
    sums = plan.agg(*[F.coalesce(F.sum(F.when(is_large == flag, F.col(c))), F.lit(0)) for flag in (False, True) for c in ("k", "t")]).first()
    small_cells, large_cells = (max(1, -(-sums[i] // tile), -(-sums[i + 1] // tile_tokens)) for i in (0, 2))
    small = rows.join(plan.filter(~is_large).select("comp"), "comp", "left_semi")
    cells = small.select(F.concat(F.lit("s"), F.pmod(F.xxhash64("comp"), F.lit(small_cells))).alias("cell"), "comp", F.lit(-1).alias("side"), "digest", "n", "tokens", F.col("digest").alias("cls"))
    known = None
    if sums[2]:
        large = plan.filter(is_large).select("comp")
        within = edges.join(groups.join(large, F.col("label") == F.col("comp"), "left_semi").select(F.col("node").alias("a")), "a", "left_semi")
        known, more = _large_cells(staging.write(rows.join(large, "comp", "left_semi"), "large"), within, percent, blocks, staging)
        cells = staging.write(cells.unionByName(more), "cells")
    found = deal(cells, small_cells + 6 * large_cells, "cell").applyInPandas(lambda pdf: _tile_links(pdf, percent), "a long, b long")
    links = staging.write(found if known is None else found.unionByName(known), "links")
    return links


def _classes(docs: DataFrame, staging: Staging, width: int, percent: int, range_tokens: int, block_tokens: int, frequent: int, tile: int, tile_tokens: int) -> tuple[DataFrame, DataFrame]:
    """Profiles (doc_id, text_key, digest, n) of all rows, and (digest, first, root) of each set: its first row as (no_id, doc_id, text_key), and a name its whole component shares (null if it is alone)."""
    words = (docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // 5
    parts = max(1, -(-words // range_tokens))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_key"), "text")
    sent = texts.mapInArrow(lambda it: _send_tokens(it, width, parts, block_tokens, frequent), BLOCK)
    shared = deal(sent, parts, "part", numbered=True).applyInPandas(_shared_tokens, BLOCK)
    found = deal(shared, 2 * parts, "flush").applyInArrow(lambda t: _survivors(t, percent), FOUND)
    found = staging.write(found, "found")
    del sent, shared
    staging.settle()
    links = links_between(found.filter("tokens IS NOT NULL"), percent, tile, tile_tokens, staging)
    linked = connected_components(links, staging).select(F.col("node").alias("digest"), F.col("label").alias("root"))
    seen = found.filter("tokens IS NULL").select("doc_id", "text_key", "digest", "n")
    first = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_key")
    classes = seen.filter("digest IS NOT NULL").groupBy("digest").agg(F.min(first).alias("first")).join(linked, "digest", "left")
    classes = staging.write(classes, "classes")
    staging.keep(found, classes)
    return seen, classes


OPTIONS = {"width": 5, "percent": 75, "range_tokens": 1_500_000, "block_tokens": 1_500_000, "frequent": 32, "tile": 2048, "tile_tokens": 4_000_000}
SALT = 16


def jaccard_components(docs: DataFrame, **options) -> DataFrame:
    """(doc_id, n_shingles, component_id) for every row: the smallest doc_id that links lead to. ``options``: see ``OPTIONS``."""
    staging = Staging(docs.sparkSession, "ngram-join")
    seen, classes = _classes(docs, staging, **(OPTIONS | options))
    linked, alone = classes.filter("root IS NOT NULL"), classes.filter("root IS NULL")
    names = linked.groupBy("root").agg(F.min("first.doc_id").alias("component_id"))
    # A component may hold a large part of all sets, so its name is looked up from SALT places.
    names = names.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))))
    named = linked.withColumn("salt", F.pmod("digest", F.lit(SALT)).cast("int")).join(names, ["root", "salt"])
    named = staging.write(named.select("digest", "component_id").unionByName(alone.select("digest", F.col("first.doc_id").alias("component_id"))), "named")
    staging.drop(classes)
    return seen.join(named, "digest", "left").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"))


def one_of_each(docs: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` without near duplicates: one row of each component, and every row with an empty set.

    Rows of a component are ordered by doc_id (null last), a hash of the text, and the other columns; ids need not be unique.
    """
    columns, staging = docs.columns, Staging(docs.sparkSession, "ngram-join")
    _, classes = _classes(docs.select("doc_id", "text"), staging, **(OPTIONS | options))
    keep = classes.groupBy(F.coalesce("root", "digest").alias("root")).agg(F.min("first").alias("first"))
    keep = staging.write(keep.select("first.text_key", F.coalesce("first.doc_id", F.lit(0)).alias("id"), "first.no_id"), "kept")
    staging.keep(keep)
    keys = ["text_key", "id", "no_id"]  # the same for the join and the window: the texts are shuffled once
    number = F.col("doc_id").cast("long")
    blank = F.coalesce(F.ltrim("text", F.lit(" \t\n\v\f\r")), F.lit("")) == ""  # the blanks between words
    row = F.struct(*[F.col(f"`{c}`") for c in columns]).alias("row")  # set apart, so that its names can't clash with the keys
    rows = docs.filter(~blank).select(F.xxhash64("text").alias("text_key"), F.coalesce(number, F.lit(0)).alias("id"), number.isNull().alias("no_id"), row)
    others = [F.col(f"row.`{c}`") for c in columns if c not in ("doc_id", "text")]
    first = Window.partitionBy(*keys).orderBy("row.text", *([F.to_json(F.struct(*others))] if others else []))
    kept = rows.join(keep, keys, "left_semi").withColumn("nth", F.row_number().over(first)).filter("nth = 1")
    return kept.select(*[F.col(f"row.`{c}`").alias(c) for c in columns]).unionByName(docs.filter(blank))
