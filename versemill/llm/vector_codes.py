"""Codes for vectors: each part of a vector is replaced by the number of its nearest codebook entry.

Codebooks are fitted in rounds over all vectors. A round sends one kd-tree for each part's codebook to the tasks (at most
parts x entries x components whole numbers, whatever the table's size). A task takes a batch of vectors through a tree
by branch and bound: the nearer side first, a subtree only if its box is no further than the best entry so far. Boxes at an
equal distance are visited too, so of entries at equal distance the lower index is found. Each task sums its vectors by part
and entry, Spark adds the sums in whole numbers, and the driver gets one row for each entry.

Components are floor(scale * x). Where components stay below ``NARROW``, distances are exact in 64-bit integers; a
batch with a larger one is decided in whole numbers of any length, entry by entry. Sums have any length: tasks send digits.

Defined results: rows whose vector is null or empty, or holds a null or non-finite component, take no part. Nor do vectors
whose length is not the most frequent one among those that the parts divide (the shorter one of two). Codebooks start as the
vectors with the smallest ids; of rows with one id those with the smaller vector come first, rows without an id last; fewer
vectors than entries give smaller codebooks. Each row, repeated or not, is coded and counted by itself. Errors beyond a long
are given as the largest long. Null labels are summed together. An empty table gives an empty one. Columns other than id,
vector and label are not read, whatever their names.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .staging import Staging
from .topk import usable

NARROW = 1 << 25  # with up to 1024 components in a part, squared distances stay below 2^62
MOST = (1 << 63) - 1
BATCH = 1 << 14
#: Different labels up to which their sums are sent to every executor; beyond, rows of a label are dealt over ``SALTS`` places.
BROADCAST_ROWS = 1 << 18
SALTS = 64


@dataclass
class Tree:
    """A kd-tree over the entries of one codebook: boxes, and leaves of a few entries in order of their index."""

    entries: np.ndarray
    leaf: int = 4
    low: list = field(default_factory=list)
    high: list = field(default_factory=list)
    children: list = field(default_factory=list)
    members: list = field(default_factory=list)
    met: int = 0  # distances computed

    def __post_init__(self):
        if len(self.entries):
            self._build(np.arange(len(self.entries)))

    def _build(self, some: np.ndarray) -> int:
        node, points = len(self.low), self.entries[some]
        self.low.append(points.min(axis=0))
        self.high.append(points.max(axis=0))
        self.children.append(None)
        self.members.append(np.sort(some))
        if len(some) > self.leaf:
            axis = int(np.argmax(self.high[node] - self.low[node]))
            order = some[np.argsort(points[:, axis], kind="stable")]
            half = len(order) // 2
            self.children[node] = (self._build(order[:half]), self._build(order[half:]))
        return node

    def _outside(self, node: int, asked: np.ndarray) -> np.ndarray:
        """Squared distance of each query to the node's box."""
        gap = np.maximum(np.maximum(self.low[node] - asked, asked - self.high[node]), 0)
        return (gap * gap).sum(axis=1)

    def nearest(self, asked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(index, squared distance) of the nearest entry to each query; of equals the lower index."""
        best = np.zeros(len(asked), np.int64)
        least = np.full(len(asked), MOST)
        if len(asked):
            self._visit(0, np.arange(len(asked)), asked, best, least)
        return best, least

    def _visit(self, node: int, some: np.ndarray, asked: np.ndarray, best: np.ndarray, least: np.ndarray) -> None:
        if self.children[node] is None:
            members = self.members[node]
            gap = asked[some][:, None, :] - self.entries[members][None, :, :]
            distance = np.einsum("qec,qec->qe", gap, gap)
            self.met += distance.size
            first = distance.argmin(axis=1)  # the first of equals, and members ascend
            found, at = members[first], distance[np.arange(len(some)), first]
            better = (at < least[some]) | ((at == least[some]) & (found < best[some]))
            best[some[better]], least[some[better]] = found[better], at[better]
            return
        bounds = [self._outside(child, asked[some]) for child in self.children[node]]
        left_first = bounds[0] <= bounds[1]
        for side, (near, far) in ((left_first, (0, 1)), (~left_first, (1, 0))):
            for k in (near, far):
                reach = some[side & (bounds[k] <= least[some])]
                if len(reach):
                    self._visit(self.children[node][k], reach, asked, best, least)


def _assign(trees: list[Tree], vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(entry, squared distance) of each part of each vector. ``vectors``: rows x parts x components."""
    codes = np.empty(vectors.shape[:2], np.int64)
    if vectors.dtype != object and all(t.entries.dtype != object for t in trees):
        errors = np.empty(vectors.shape[:2], np.int64)
        for p, tree in enumerate(trees):
            codes[:, p], errors[:, p] = tree.nearest(vectors[:, p])
        return codes, errors
    errors = np.empty(vectors.shape[:2], object)
    for p, tree in enumerate(trees):
        entries = tree.entries.astype(object)
        for i, part in enumerate(vectors[:, p].astype(object)):
            errors[i, p], codes[i, p] = min((int(((e - part) ** 2).sum()), k) for k, e in enumerate(entries))
    return codes, errors


def _whole(raw: np.ndarray, scale: int, parts: int) -> np.ndarray:
    """floor(scale * x), by parts; as Python numbers if one is not narrow."""
    with np.errstate(over="ignore"):
        scaled = np.floor(raw * scale)
    shape = (len(raw), parts, -1)
    if not len(raw) or np.abs(scaled).max() < NARROW:
        return scaled.astype(np.int64).reshape(shape)
    # Beyond doubles a component is a whole number itself, times a whole scale.
    whole = [int(s) if np.isfinite(s) else int(x) * int(scale) for s, x in zip(scaled.ravel().tolist(), raw.ravel().tolist())]
    return np.array(whole, object).reshape(shape)


def _batches(batch: pa.RecordBatch, width: int, scale: int, parts: int):
    """(first row, vectors) of short runs of rows."""
    raw = batch.column("vector").flatten().to_numpy(zero_copy_only=False).reshape(-1, width)
    for a in range(0, len(raw), BATCH):
        yield a, _whole(raw[a : a + BATCH], scale, parts)


def _rows(vectors: DataFrame, id_col: str, vector_col: str, label_col: str, parts: int) -> tuple[DataFrame, int | None]:
    vector = F.transform(F.col(vector_col), lambda x: x.cast("double"))
    rows = vectors.filter(usable(F.col(vector_col)) & (F.size(vector_col) % parts == 0))
    rows = rows.select(F.col(id_col).cast("long").alias("vec_id"), vector.alias("vector"), F.col(label_col).alias("label"))
    widths = rows.groupBy(F.size("vector").alias("width")).count().orderBy(F.desc("count"), "width").limit(1).collect()
    if not widths:
        return rows, None
    return rows.filter(F.size("vector") == widths[0].width), widths[0].width


def _limbs(total: int) -> list[tuple[int, int]]:
    """(bits, digit) in base 2^32, with the sign of the number, so that numbers of any length are added in longs."""
    sign, size = (-1 if total < 0 else 1), abs(total)
    return [(bits, sign * digit) for bits in range(0, size.bit_length(), 32) if (digit := size >> bits & 0xFFFFFFFF)]


def fit(rows: DataFrame, width: int, *, parts: int = 16, entries: int = 64, rounds: int = 2, scale: int = 256) -> list[np.ndarray]:
    """The codebooks (entries x components of each part) after ``rounds`` rounds over ``rows`` (vec_id, vector)."""
    first = rows.select("vec_id", "vector").orderBy(F.col("vec_id").asc_nulls_last(), "vector").limit(entries).collect()
    start = _whole(np.array([r.vector for r in first], np.float64), scale, parts)
    books = [start[:, p] for p in range(parts)]
    for _ in range(rounds):

        def sums(batches, books=books):
            trees = [Tree(b) for b in books]
            counts, total = np.zeros((parts, len(books[0])), np.int64), np.zeros((parts, *books[0].shape), object)
            for batch in batches:
                for _, vectors in _batches(batch, width, scale, parts):
                    codes, _ = _assign(trees, vectors)
                    for p in range(parts):
                        counts[p] += np.bincount(codes[:, p], minlength=counts.shape[1])
                        some = np.zeros(books[0].shape, vectors.dtype)  # of one batch, so narrow ones don't overflow
                        np.add.at(some, codes[:, p], vectors[:, p])
                        total[p] += some
            out = [(p, e, -1, 0, int(counts[p, e])) for p, e in np.argwhere(counts)]
            out += [(p, e, c, bits, digit) for p, e in np.argwhere(counts) for c, x in enumerate(total[p, e]) for bits, digit in _limbs(int(x))]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], kind) for k, kind in enumerate([pa.int32()] * 4 + [pa.int64()])], ["part", "entry", "place", "bits", "amount"])

        partial = rows.select("vector").mapInArrow(sums, "part int, entry int, place int, bits int, amount long")
        added: dict[tuple[int, int], list[int]] = {}
        for r in partial.groupBy("part", "entry", "place", "bits").agg(F.sum("amount").alias("amount")).collect():
            added.setdefault((r.part, r.entry), [0] * (width // parts + 1))[r.place] += r.amount << r.bits
        books = [b.astype(object) for b in books]
        for (p, e), (*totals, n) in added.items():
            books[p][e] = [x // n for x in totals]
        if all(abs(x) < NARROW for b in books for x in b.ravel()):
            books = [b.astype(np.int64) for b in books]
    return books


def digest(books: list[np.ndarray]) -> str:
    """The lowercase hex sha256 of all components, by part, entry and position, joined by commas."""
    return hashlib.sha256(",".join(str(int(x)) for b in books for x in b.ravel()).encode()).hexdigest()


def compress(
    vectors: DataFrame, *, parts: int = 16, entries: int = 64, rounds: int = 2, scale: int = 256, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label",
) -> DataFrame:
    """(vec_id, label, codes, error, label_error, codebooks_sha256): ``codes`` are the entries' numbers by part, ``error`` the squared distance to them."""
    staging = Staging(vectors.sparkSession, "vector-codes")
    rows, width = _rows(vectors, id_col, vector_col, label_col, parts)
    books = fit(rows, width, parts=parts, entries=entries, rounds=rounds, scale=scale) if width else []

    def code(batches):
        trees = [Tree(b) for b in books]
        for batch in batches:
            for a, some in _batches(batch, width, scale, parts):
                codes, errors = _assign(trees, some)
                total = errors.sum(axis=1)
                if total.dtype == object:
                    total = np.array([min(x, MOST) for x in total], np.int64)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, codes.size + 1, parts, dtype=np.int32)), pa.array(codes.astype(np.int32).ravel()))
                kept = [batch.column(c).slice(a, len(some)) for c in ("vec_id", "label")]
                yield pa.RecordBatch.from_arrays([*kept, lists, pa.array(total)], ["vec_id", "label", "codes", "error"])

    kind = rows.schema["label"].dataType.simpleString()
    coded = staging.write(rows.mapInArrow(code, f"vec_id long, label {kind}, codes array<int>, error long"), "codes")
    by_label = coded.groupBy("label").agg(F.least(F.sum(F.col("error").cast("decimal(38,0)")), F.lit(MOST).cast("decimal(38,0)")).cast("long").alias("label_error"))
    by_label = staging.write(by_label.withColumnRenamed("label", "of_label"), "labels")
    same = F.col("label").eqNullSafe(F.col("of_label"))
    if by_label.count() <= BROADCAST_ROWS:
        out = coded.join(F.broadcast(by_label), same)
    else:  # a label may hold a third of all rows
        dealt = by_label.withColumn("of_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        out = coded.withColumn("salt", F.pmod(F.xxhash64("vec_id", "codes"), F.lit(SALTS)).cast("int")).join(dealt, same & (F.col("salt") == F.col("of_salt")))
    staging.keep(coded, by_label)
    return out.select("vec_id", "label", "codes", "error", "label_error", F.lit(digest(books)).alias("codebooks_sha256"))
