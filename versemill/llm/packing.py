"""Best-fit packing of tokenized documents into sequences of a fixed length.

Documents are tokenized once, by the ids of the given vocabulary file; only lengths and checksums go further. Hierarchical
residual packing: pieces are dealt to groups by hash and packed best-fit, longest first, inside each. After that a group
has at most one bin that is half full or less (two would have been one). So what a later round can gain is to put such
small bins, whole, into bins of other groups: each group emits all bins but its small one and the ``fan_in`` emptiest
others, and rounds of best-fit over ``fan_in`` groups each, bins now being the items, merge them up a tree. A parent has
at most ``fan_in`` small bins to place, so no host beyond the emptiest ``fan_in`` of each child could be needed: emitting
the rest early loses nothing, and the root stays as small as any node.

Defined results: null text is empty; an empty document is the end token alone; repeated rows are packed each; a document
longer than a sequence is cut into full sequences, the remainder being its first piece; an empty table gives an empty
result; extra columns are ignored. Strings of special tokens inside a text are ordinary text.
"""

from __future__ import annotations

import json
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .staging import Staging, deal
from .textbytes import release

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def byte_symbols() -> dict[str, int]:
    """The public mapping of byte-level vocabularies: printable bytes stand for themselves, the others, in order, for 256 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class Encoder:
    """Ids of a tokenizer file. A byte-level BPE file whose ids are its merge ranks runs on the faster of two exact engines."""

    def __init__(self, content: str):
        self.content, self.made = content, None
        self.fast = self._fast(json.loads(content))

    @property
    def slow(self):
        """The general engine, loaded only where it is needed."""
        if self.made is None:
            import tokenizers

            self.made = tokenizers.Tokenizer.from_str(self.content)
            self.made.encode_special_tokens = True
        return self.made

    @staticmethod
    def _fast(spec: dict):
        import tiktoken

        model, split = spec["model"], spec.get("pre_tokenizer") or {}
        if model.get("type") != "BPE" or spec.get("normalizer") or split.get("type") != "ByteLevel" or split.get("add_prefix_space") or not split.get("use_regex", True):
            return None
        vocab = model["vocab"]
        merged = ["".join(m if isinstance(m, list) else m.split(" ")) for m in model["merges"]]
        if sorted(vocab.values())[: 256 + len(merged)] != list(range(256 + len(merged))) or any(vocab.get(m) != 256 + k for k, m in enumerate(merged)):
            return None
        symbols, special = byte_symbols(), {t["content"] for t in spec.get("added_tokens") or []}
        ranks = {bytes(symbols[c] for c in token): k for token, k in vocab.items() if token not in special}
        # Fixed value: the split pattern of the public byte-level tokenizers.
        pattern = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
        return tiktoken.Encoding("file", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})

    def __call__(self, text: str) -> np.ndarray:
        if self.fast:
            try:
                return np.array(self.fast.encode_ordinary(text), "<u4")
            except BaseException as stopped:  # the fast engine gives up on extreme runs of blanks by a panic, a type without a module to import
                if type(stopped).__name__ != "PanicException":
                    raise
        return np.array(self.slow.encode(text, add_special_tokens=False).ids, "<u4")


def cut(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of a document of ``n`` ids: full ones, but for the first."""
    first = n % capacity or min(n, capacity)
    return [(0, first), *((at, capacity) for at in range(first, n, capacity))]


def _tokenize(batches, content: str, end_id: int, capacity: int):
    encode = Encoder(content)
    end = np.array([end_id], "<u4")
    for batch in batches:
        ids_of, rows = batch.column("doc_id"), ([], [], [], [], [])
        for i, text in enumerate(batch.column("text")):
            ids = np.concatenate([encode(text.as_py() or ""), end])
            for piece, (start, length) in enumerate(cut(len(ids), capacity)):
                for column, value in zip(rows, (i, piece, start, length, zlib.crc32(ids[start : start + length].tobytes()))):
                    column.append(value)
        doc = ids_of.take(pa.array(rows[0], pa.int64()))
        yield pa.RecordBatch.from_arrays([doc, pa.array(rows[1], pa.int32()), *(pa.array(c, pa.int64()) for c in rows[2:])], ["doc_id", "piece", "start", "length", "ids_crc32"])
    release()


def tokenized_pieces(docs: DataFrame, tokenizer_path: str, end_id: int, capacity: int) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32). The vocabulary file is read here and travels with the code: a fixed size."""
    with open(tokenizer_path, encoding="utf-8") as f:
        content = f.read()
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(lambda it: _tokenize(it, content, end_id, capacity), PIECES)


def best_fit(lengths: list[int], capacity: int) -> tuple[list[int], list[int], list[int]]:
    """(bin of each item, its offset, fill of each bin) for items from longest to shortest.

    Open bins stand by what they have left; one number's bits tell which amounts are there, so the tightest fit is its lowest fitting bit.
    """
    open_: list[list[int]] = [[] for _ in range(capacity + 1)]
    there, where, offsets, fill = 0, [], [], []
    for n in lengths:
        fitting = there >> n
        if fitting:
            left = n + (fitting & -fitting).bit_length() - 1
            b = open_[left].pop()
            if not open_[left]:
                there ^= 1 << left
        else:
            b, left = len(fill), capacity
            fill.append(0)
        where.append(b)
        offsets.append(fill[b])
        fill[b] += n
        if left > n:
            open_[left - n].append(b)
            there |= 1 << (left - n)
    return where, offsets, fill


def _upward(fill: np.ndarray, capacity: int, hosts: int) -> np.ndarray:
    """Which bins go up: those half full or less, and the emptiest others that have room."""
    small = fill * 2 <= capacity
    others = np.flatnonzero(~small & (fill < capacity))
    small[others[np.argsort(fill[others], kind="stable")[:hosts]]] = True
    return small


def _pack_group(table: pa.Table, capacity: int, hosts: int) -> pa.Table:
    """Best-fit inside one group. Arrow keeps ids whole where pandas would make doubles of them beside a null."""
    order = [("length", "descending"), *((c, "ascending") for c in ("doc_id", "piece", "start", "ids_crc32"))]
    table = table.take(pc.sort_indices(table, sort_keys=order))
    where, offsets, fill = best_fit(table["length"].to_pylist(), capacity)
    where, offsets, fill = np.array(where, np.int64), np.array(offsets, np.int64), np.array(fill, np.int64)
    bins = table["grp"].to_numpy().astype(np.int64) * (1 << 32) + where
    up = np.where((offsets == 0) & _upward(fill, capacity, hosts)[where], fill[where], 0)  # one row of each bin carries its fill
    for name, column in (("bin", bins), ("offset", offsets), ("fill", up)):
        table = table.append_column(name, pa.array(column))
    return table


def _merge_group(table: pa.Table, capacity: int, hosts: int) -> pa.Table:
    """One node of the tree: bins as items. Rows out: bins that go further up (host null), and moves (host, base)."""
    table = table.take(pc.sort_indices(table, sort_keys=[("fill", "descending"), ("bin", "ascending")]))
    where, offsets, fill = best_fit(table["fill"].to_pylist(), capacity)
    bins, where, offsets, fill = table["bin"].to_numpy(), np.array(where), np.array(offsets), np.array(fill)
    head = np.zeros(len(fill), np.int64)
    head[where[offsets == 0]] = bins[offsets == 0]
    moved, up = offsets > 0, np.flatnonzero(_upward(fill, capacity, hosts))
    none, stays = np.zeros(len(up), np.int64), np.r_[np.zeros(moved.sum(), bool), np.ones(len(up), bool)]
    columns = {"bin": np.r_[bins[moved], head[up]], "host": np.r_[head[where[moved]], none], "base": np.r_[offsets[moved], none], "fill": np.r_[none[:0], np.zeros(moved.sum(), np.int64), fill[up]]}
    columns = {k: pa.array(v.astype(np.int64), mask=stays if k == "host" else None) for k, v in columns.items()}
    return pa.table({"grp": pa.array(np.full(len(stays), table["grp"][0].as_py(), np.int32)), **columns})


def pack_pieces(pieces: DataFrame, staging: Staging, *, capacity: int = 1024, group_pieces: int = 50_000, fan_in: int = 8) -> DataFrame:
    """Adds sequence_id and offset to (doc_id, piece, start, length, ids_crc32)."""
    columns = ["doc_id", "piece", "start", "length", "ids_crc32"]
    pieces = staging.write(pieces.select(*columns).withColumn("_at", F.monotonically_increasing_id()), "pieces")
    groups = max(1, -(-pieces.count() // group_pieces))
    # By the place in the written table, so that rows repeated under one id are dealt like others.
    grouped = deal(pieces.select(*columns, F.pmod(F.xxhash64("_at"), F.lit(groups)).cast("int").alias("grp")), groups, "grp", numbered=True)
    packed = grouped.applyInArrow(lambda t: _pack_group(t, capacity, fan_in), f"{PIECES}, grp int, bin long, offset long, fill long")
    packed = staging.write(packed, "packed")
    level, moves = packed.filter("fill > 0").select("grp", "bin", "fill"), None
    while groups > 1:
        groups = -(-groups // fan_in)
        above = deal(level.withColumn("grp", F.expr(f"cast(grp div {fan_in} as int)")), groups, "grp", numbered=True)
        merged = staging.write(above.applyInArrow(lambda t: _merge_group(t, capacity, fan_in), "grp int, bin long, host long, base long, fill long"), "merged")
        new = merged.filter("host IS NOT NULL").select("bin", "host", "base")
        if moves is not None:  # a bin moved before may now move on inside its host
            further = new.select(F.col("bin").alias("_via"), F.col("host").alias("_to"), F.col("base").alias("_add"))
            chained = moves.join(further, F.col("host") == F.col("_via"), "left")
            chained = chained.select("bin", F.coalesce("_to", "host").alias("host"), (F.col("base") + F.coalesce("_add", F.lit(0))).alias("base"))
            new = chained.unionByName(new)
        moves, level = staging.write(new, "moves"), merged.filter("host IS NULL").select("grp", "bin", "fill")
    staging.keep(packed, moves)
    if moves is None:
        return packed.select(*columns, F.col("bin").alias("sequence_id"), "offset")
    placed = packed.join(moves, "bin", "left")  # at most a move for each group and level
    return placed.select(*columns, F.coalesce("host", "bin").alias("sequence_id"), (F.col("offset") + F.coalesce("base", F.lit(0))).alias("offset"))


def pack_documents(docs: DataFrame, tokenizer_path: str, *, end_id: int = 2, capacity: int = 1024, **options) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset): a row for each piece of each row of ``docs``."""
    staging = Staging(docs.sparkSession, "packing")
    return pack_pieces(tokenized_pieces(docs, tokenizer_path, end_id, capacity), staging, capacity=capacity, **options)
