"""Secret scan through an inverted index of trigrams.

Of each rule's regular expression follows a Boolean query of trigrams that any match must hold: literal stretches give all
their trigrams, alternatives an OR, sequences an AND. The index lists, for segments of documents, the documents that hold a
trigram (bytes of the UTF-8 text, A-Z lowered). A query is answered by intersecting and uniting postings; what is left are
candidates, and only their texts meet the expression. A rule whose query has no mandatory trigram scans every text.

A segment is a run of rows with at most ``SEGMENT_PAIRS`` postings or one row, so postings have a set size and are made,
stored and met segment by segment. By default all trigrams are indexed, for rules yet to come; with a vocabulary, only those.

Defined results: a null or empty text has no spans; rows without an id are verified by every rule, without the index; an
id that repeats is a candidate if any of its rows is, and every row is then verified by itself and gets its own result; long
texts are scanned whole; spans of one rule don't overlap, spans of different rules may; an empty table gives an empty one;
columns other than the id and the text are not read, whatever their names.
"""

from __future__ import annotations

import re
from collections.abc import Iterable
from dataclasses import dataclass
from re import _constants as op
from re import _parser

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import textbytes
from .staging import Staging

SEGMENT_PAIRS = 1 << 22
#: Candidates up to which they are sent to every executor (16 bytes each); beyond, texts and candidates are joined by a shuffle.
BROADCAST_ROWS = 1 << 20
MOST_SPELLINGS = 64
SPANS = "array<struct<kind: string, start: long, end: long>>"


@dataclass(frozen=True)
class Rule:
    """Leftmost, non-overlapping matches of ``pattern``; those whose ``group`` is shorter than ``least`` characters are dropped."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 1


BASE = (
    Rule("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 20),
    Rule("hex", r"[0-9a-f]{24,}"),  # the runs of [0-9a-f]+ with 24 characters or more: no match is dropped within a run
)
MORE = (
    Rule("private_key", r"-----BEGIN [A-Z0-9 ]*PRIVATE KEY-----"),
    Rule("host_token", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("chat_token", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("web_token", r"eyJ[A-Za-z0-9_-]{10,}\.eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}"),
    Rule("map_key", r"AIza[A-Za-z0-9_-]{35}"),
)
RULES = BASE + MORE


# A query is True (no condition), a trigram, or ("and" | "or", set of queries).
def _both(*queries):
    parts = set()
    for q in queries:
        if q is not True:
            parts |= q[1] if isinstance(q, tuple) and q[0] == "and" else {q}
    return True if not parts else parts.pop() if len(parts) == 1 else ("and", frozenset(parts))


def _either(queries):
    parts = set()
    for q in queries:
        if q is True:
            return True
        parts |= q[1] if isinstance(q, tuple) and q[0] == "or" else {q}
    needs = {q: q[1] if isinstance(q, tuple) and q[0] == "and" else frozenset([q]) for q in parts}
    parts = [q for q in parts if not any(needs[p] < needs[q] for p in parts)]  # A or (A and B) is A
    return parts[0] if len(parts) == 1 else ("or", frozenset(parts))


def _of_strings(strings: frozenset[bytes]):
    """Any of the strings is in the text."""
    return _either(_both(*[s[i : i + 3] for i in range(len(s) - 2)]) for s in strings)


def _spelled(code: int) -> bytes:
    return chr(code).encode(errors="surrogatepass").lower()


def _times(a: frozenset[bytes], b: frozenset[bytes]) -> frozenset[bytes] | None:
    return frozenset(x + y for x in a for y in b) if len(a) * len(b) <= MOST_SPELLINGS else None


def _node(kind, value, flags: int):
    """(the strings it can match, or None if not few; what any match needs besides)."""
    if kind is op.LITERAL:
        return frozenset([_spelled(value)]), True
    if kind is op.IN and value[0][0] is not op.NEGATE and all(k in (op.LITERAL, op.RANGE) for k, _ in value):
        ranges = [(v, v) if k is op.LITERAL else v for k, v in value]
        if sum(b - a + 1 for a, b in ranges) <= MOST_SPELLINGS:
            return frozenset(_spelled(c) for a, b in ranges for c in range(a, b + 1)), True
    if kind in (op.AT, op.ASSERT_NOT):
        return frozenset([b""]), True
    if kind is op.ASSERT:
        return frozenset([b""]), _whole(*_sequence(value[1], flags))
    if kind is op.SUBPATTERN:
        return _sequence(value[3], (flags | value[1]) & ~value[2])
    if kind is op.ATOMIC_GROUP:
        return _sequence(value, flags)
    if kind is op.BRANCH:
        ways = [_sequence(p, flags) for p in value[1]]
        exact = frozenset().union(*[e for e, _ in ways]) if all(e is not None and m is True for e, m in ways) else None
        return (exact, True) if exact is not None and len(exact) <= MOST_SPELLINGS else (None, _either(_whole(*w) for w in ways))
    if kind in (op.MAX_REPEAT, op.MIN_REPEAT, op.POSSESSIVE_REPEAT):
        least, most, inner = value
        exact, must = _sequence(inner, flags)
        if least == 0:
            return (exact | {b""}, True) if most == 1 and exact is not None and must is True else (None, True)
        grown = exact
        for n in range(1, least):
            longer = None if grown is None else _times(grown, exact)
            if longer is None:
                return None, _both(must, _whole(grown, True))
            grown = longer
        return (grown, must) if most == least else (None, _both(must, _whole(grown, True)))
    return None, True


def _whole(exact, must):
    return must if exact is None else _both(must, _of_strings(exact))


def _sequence(nodes, flags: int):
    strings, must, exact = frozenset([b""]), True, True
    for kind, value in nodes:
        here, needs = _node(kind, value, flags)
        must = _both(must, needs)
        grown = None if here is None else _times(strings, here)
        if grown is None:
            must, exact = _both(must, _of_strings(strings)), False
            grown = frozenset([b""]) if here is None else here
        strings = grown
    return (strings, must) if exact else (None, _both(must, _of_strings(strings)))


def trigram_query(pattern: str):
    """The condition on trigrams that every text with a match of ``pattern`` meets; True if there is none.

    Cases are ignored in ASCII only, as the rules are compiled.
    """
    parsed = _parser.parse(pattern, re.ASCII)
    return _whole(*_sequence(parsed, parsed.state.flags))


def trigrams_of(query) -> set[bytes]:
    """The trigrams that a query asks for."""
    return set() if query is True else {query} if isinstance(query, bytes) else set().union(*map(trigrams_of, query[1]))


def _number(trigram: bytes) -> int:
    return int.from_bytes(trigram, "big")


def build_index(docs: DataFrame, vocabulary: Iterable[bytes] | None = None) -> DataFrame:
    """(segment, trigram, docs): places of documents in their segment, ascending. Trigram -1 has no postings but ``ids``, the segment's ids by place.

    ``vocabulary``: the lower-cased trigrams to index; None for all. Rows without an id are left out.
    """
    wanted = None if vocabulary is None else sorted(map(_number, vocabulary))

    def index(batches):
        known = np.ones(1 << 24, bool) if wanted is None else np.zeros(1 << 24, bool)
        if wanted is not None:
            known[wanted] = True
        segment = TaskContext.get().partitionId() << 33
        kind = pa.list_(pa.int32())

        def table(pairs, ids):
            keys = np.sort(np.concatenate(pairs)) if pairs else np.zeros(0, np.int64)
            grams = keys >> 32
            first = np.flatnonzero(np.r_[True, grams[1:] != grams[:-1]]) if len(keys) else np.zeros(0, np.int64)
            bounds = np.r_[first, len(keys)].astype(np.int32)
            # One row more, for the ids.
            posted = pa.ListArray.from_arrays(pa.array(np.r_[bounds, len(keys)].astype(np.int32)), pa.array((keys & 0xFFFFFFFF).astype(np.int32))).cast(kind)
            names = pa.array([None] * len(first) + [ids], pa.list_(pa.int64()))
            return pa.RecordBatch.from_arrays([pa.array(np.full(len(first) + 1, segment)), pa.array(np.r_[grams[first], -1].astype(np.int32)), posted, names], ["segment", "trigram", "docs", "ids"])

        pairs, ids, held = [], [], 0
        for batch in batches:
            names = batch.column("doc_id").to_pylist()
            for first, data, offsets in textbytes.slices(batch.column("text")):
                low = textbytes._LOWER[data].astype(np.int32)
                codes = (low[:-2] << 16) | (low[1:-1] << 8) | low[2:] if len(low) > 2 else np.zeros(0, np.int32)
                at = np.flatnonzero(known[codes])
                row = np.searchsorted(offsets, at, "right") - 1
                inside = at + 3 <= offsets[row + 1]
                pairs.append(np.unique((codes[at[inside]].astype(np.int64) << 32) | (row[inside] + len(ids))))
                ids += names[first : first + len(offsets) - 1]
                held += len(pairs[-1])
                if held >= SEGMENT_PAIRS or len(ids) >= 1 << 16:
                    yield table(pairs, ids)
                    pairs, ids, held, segment = [], [], 0, segment + 1
        if ids:
            yield table(pairs, ids)
        textbytes.release()

    rows = docs.filter(F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(index, "segment long, trigram int, docs array<int>, ids array<long>")


def _answer(query, postings: dict[bytes, Column]) -> Column:
    """Places of the documents that meet a query, from the postings of one segment."""
    if isinstance(query, bytes):
        return postings[query]
    kind, parts = query
    join = F.array_intersect if kind == "and" else F.array_union
    out, *rest = [_answer(q, postings) for q in sorted(parts, key=repr)]
    for other in rest:
        out = join(out, other)
    return out


def candidates(index: DataFrame, patterns: list[str]) -> DataFrame:
    """(doc_id, rules): the documents that meet the query of a pattern, and the numbers of those patterns as bits.

    Patterns without a query are not asked. Postings of one segment meet in one task: at most the trigrams asked for, of a segment each.
    """
    if len(patterns) > 62:
        raise ValueError("at most 62 rules at a time")
    queries = {n: q for n, p in enumerate(patterns) if (q := trigram_query(p)) is not True}
    asked = sorted(set().union(set(), *map(trigrams_of, queries.values())))
    none = F.array().cast("array<int>")
    postings = [F.coalesce(F.first(F.when(F.col("trigram") == _number(t), F.col("docs")), ignorenulls=True), none).alias(f"t{_number(t)}") for t in asked]
    some = index.filter(F.col("trigram").isin([-1, *map(_number, asked)]))
    met = some.groupBy("segment").agg(F.first("ids", ignorenulls=True).alias("ids"), *postings)
    names = {t: F.col(f"t{_number(t)}") for t in asked}
    marked = lambda bit: lambda d: F.struct(d.alias("at"), F.lit(bit).cast("long").alias("bit"))
    hits = [F.transform(_answer(q, names), marked(1 << n)) for n, q in queries.items()]
    if not hits:
        return index.sparkSession.createDataFrame([], "doc_id long, rules long")
    found = met.select("ids", F.explode(F.concat(*hits)).alias("hit"))
    return found.select(F.get("ids", F.col("hit.at")).alias("doc_id"), F.col("hit.bit").alias("bit")).groupBy("doc_id").agg(F.bit_or("bit").alias("rules"))


def _verify(texts: list[str], masks: np.ndarray, rules: tuple[Rule, ...]) -> list[list[tuple[int, int, int]]]:
    """(start, number of the rule, end) of the matches in each text of the rules that its mask names."""
    found = [[] for _ in texts]
    for n, rule in enumerate(rules):
        matches, group, least = re.compile(rule.pattern, re.ASCII).finditer, rule.group, rule.least
        for i in np.flatnonzero(masks >> n & 1):
            found[i] += [(m.start(), n, m.end()) for m in matches(texts[i]) if m.end(group) - m.start(group) >= least]
    return [sorted(f) for f in found]


def scan(docs: DataFrame, rules: tuple[Rule, ...] = RULES, *, index: DataFrame | None = None) -> DataFrame:
    """(doc_id, spans) for every row: ``spans`` by start and then order of the rules, places in code points, end exclusive.

    ``index``: a table of ``build_index`` over these documents that has the rules' trigrams; None to make one of just those.
    """
    staging = Staging(docs.sparkSession, "secret-scan")
    patterns = [r.pattern for r in rules]
    queries = [trigram_query(p) for p in patterns]
    if index is None:
        index = staging.write(build_index(docs, set().union(*map(trigrams_of, queries))), "index")
    some = staging.write(candidates(index, patterns), "candidates")
    everywhere = sum(1 << n for n, q in enumerate(queries) if q is True)
    every = (1 << len(rules)) - 1

    def verify(batches):
        for batch in batches:
            masks, texts = batch.column("rules").to_numpy(zero_copy_only=False), batch.column("text")
            for first, data, offsets in textbytes.slices(texts):
                part = texts.slice(first, len(offsets) - 1)
                spans = _verify([t or "" for t in part.to_pylist()], masks[first : first + len(part)], rules)
                spans = pa.array([[{"kind": rules[n].kind, "start": a, "end": b} for a, n, b in s] for s in spans], pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())])))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(first, len(part)), spans], ["doc_id", "spans"])
        textbytes.release()

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    known = F.broadcast(some) if some.count() <= BROADCAST_ROWS else some
    marked = rows.join(known, "doc_id", "left")
    mask = F.when(F.col("doc_id").isNull(), every).otherwise(F.coalesce("rules", F.lit(0)).bitwiseOR(F.lit(everywhere)))
    staging.keep(some)
    return marked.select("doc_id", "text", mask.cast("long").alias("rules")).mapInArrow(verify, f"doc_id long, spans {SPANS}")
