"""Periodic runs of words inside each text, by Crochemore's partition refinement.

Two positions of a text are in one class of length m if the m words from there on are the same. Classes of length m + 1 come
from those of length m: a class is split by the class that follows each of its members. Of the parts that a class falls into,
all but a largest one are enough to split by next time (the smaller halves), so a position is touched a logarithmic number of
times. Members of a class are linked in order of place; two neighbours at a distance of exactly m are a square whose root has
no shorter period, and squares of one period at consecutive places are one run. A distance is looked at when a link changes:
it was a square if its length came up while the link stood.

All texts of a slice are refined at the same time, as arrays; each text keeps to itself, since its words are told apart by
text and a mark ends it. Rounds end at the longest period that a run of the asked exponent can have.

Each row is judged by itself, in one narrow pass: nothing is shuffled, and a lost executor costs only the tasks it ran.

Defined results: a null, empty or blank text has no words and no runs and collapses to the empty text; words are compared
byte by byte, whatever their length; a text may have any length up to what a row can hold; runs may overlap, and all are
returned; repeated rows each get their own result; an empty table gives an empty one; columns other than the id and the
text are not read, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import textbytes

SLICE_BYTES = 1 << 22
RUNS = "array<struct<start: long, length: long, period: long>>"


def _ranges(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The numbers of all ranges [start, start + count), one range after the other."""
    before = np.cumsum(counts) - counts
    return np.repeat(starts - before, counts) + np.arange(int(counts.sum()))


class _Classes:
    """Positions in classes: each class has a stretch of ``slots``, and its members are linked in order of place."""

    def __init__(self, symbols: np.ndarray, limit: np.ndarray):
        """``symbols``: equal numbers for equal words of one text, a number of its own for each mark. ``limit``: the longest period asked for at each position."""
        n = len(symbols)
        self.limit = limit
        self.slots = np.argsort(symbols, kind="stable")
        ordered = symbols[self.slots]
        first = np.flatnonzero(np.r_[True, ordered[1:] != ordered[:-1]])
        self.size = np.diff(np.r_[first, n])
        self.low = first
        self.slot = np.empty(n, np.int64)
        self.slot[self.slots] = np.arange(n)
        self.of = np.empty(n, np.int64)
        self.of[self.slots] = np.repeat(np.arange(len(first)), self.size)
        self.next, self.prev = np.full(n, -1), np.full(n, -1)
        same = ordered[1:] == ordered[:-1]
        self.next[self.slots[:-1][same]] = self.slots[1:][same]
        self.prev[self.slots[1:][same]] = self.slots[:-1][same]
        self.since = np.ones(n, np.int64)  # the length from which on the link to the next member stands
        self.found: list[tuple[np.ndarray, np.ndarray]] = []

    def _close(self, at: np.ndarray, length: int) -> None:
        """Links from ``at`` end after ``length``: those that were squares are kept."""
        gap = self.next[at] - at
        square = (gap >= self.since[at]) & (gap <= length)
        if square.any():
            self.found.append((at[square], gap[square]))

    def _add(self, low: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Numbers of new classes with these stretches of slots."""
        first = self.count
        self.count = first + len(low)
        if self.count > len(self.size):
            room = np.zeros(max(self.count, 2 * len(self.size)) - len(self.size), np.int64)
            self.size, self.low = np.r_[self.size, room], np.r_[self.low, room]
        self.size[first : self.count], self.low[first : self.count] = size, low
        return np.arange(first, self.count)

    def _unlink(self, touched: np.ndarray, parent: np.ndarray, length: int) -> None:
        """Take ``touched`` out of the lists of their classes, stretch of neighbours by stretch."""
        order = np.lexsort((touched, parent))
        t = touched[order]
        joined = self.next[t[:-1]] == t[1:]
        before, after = self.prev[t[np.r_[True, ~joined]]], self.next[t[np.r_[~joined, True]]]
        has = before >= 0
        self._close(before[has], length)
        self.since[before[has]] = length + 1
        self.next[before[has]] = after[has]
        has = after >= 0
        self.prev[after[has]] = before[has]

    def _refine(self, small: np.ndarray, length: int) -> np.ndarray:
        """From classes of ``length`` to those one longer, split by the positions ``small``; the positions to split by next."""
        touched = small - 1
        splitter = self.of[small]
        parent = self.of[touched]
        stay = (self.size[parent] > 1) & (self.limit[touched] > length) & (touched >= 0)
        touched, splitter, parent = touched[stay], splitter[stay], parent[stay]
        if not len(touched):
            return touched
        order = np.lexsort((touched, splitter, parent))
        touched, splitter, parent = touched[order], splitter[order], parent[order]
        head = np.r_[True, (parent[1:] != parent[:-1]) | (splitter[1:] != splitter[:-1])]
        first = np.flatnonzero(head)
        count = np.diff(np.r_[first, len(touched)])
        old = parent[first]  # of each group
        lead = np.flatnonzero(np.r_[True, old[1:] != old[:-1]])  # first group of each parent
        groups = np.diff(np.r_[lead, len(old)])
        moved = np.add.reduceat(count, lead)
        rest = self.size[old[lead]] - moved
        split = (rest > 0) | (groups > 1)
        if not split.all():
            of_group, of_place = np.repeat(split, groups), np.repeat(split, moved)
            touched, parent = touched[of_place], parent[of_place]
            count, old = count[of_group], old[of_group]
            rest, groups, moved = rest[split], groups[split], moved[split]
            if not len(touched):
                return touched
            lead = np.cumsum(groups) - groups
        largest = np.maximum.reduceat(count, lead)
        self._unlink(touched, parent, length)
        # Groups of a parent take the last slots of its stretch; what was there and stays goes where they came from.
        classes = old[lead]
        end = self.low[classes] + self.size[classes]
        zone = _ranges(end - moved, moved)
        here = np.zeros(len(touched), bool)
        bound = np.repeat(end - moved, moved)
        here[:] = self.slot[touched] >= bound
        mark = np.zeros(len(zone), bool)
        start = np.cumsum(moved) - moved
        mark[(np.repeat(start, moved) + self.slot[touched] - bound)[here]] = True
        staying, freed = self.slots[zone[~mark]], self.slot[touched[~here]]
        self.slots[freed], self.slot[staying] = staying, freed
        self.slots[zone], self.slot[touched] = touched, zone
        self.size[classes] -= moved
        # Without a rest, the largest group keeps the number of its parent.
        at = np.cumsum(count) - count  # of each group in touched, and in zone
        number = np.full(len(count), -1)
        whole = np.repeat(rest == 0, groups)
        most = count == np.repeat(largest, groups)
        seen = np.cumsum(most)
        keeps = most & (seen - np.repeat(seen[lead] - most[lead], groups) == 1)  # the first of the largest groups of each parent
        heir = whole & keeps
        number[heir] = old[heir]
        self.size[old[heir]], self.low[old[heir]] = count[heir], zone[at[heir]]
        fresh = np.flatnonzero(~heir)
        number[fresh] = self._add(zone[at[fresh]], count[fresh])
        self._close(touched, length)
        self.of[touched] = np.repeat(number, count)
        self.since[touched] = length + 1
        inner = np.ones(len(touched), bool)
        inner[at] = False
        inner = np.flatnonzero(inner)
        self.next[touched], self.prev[touched] = -1, -1
        self.next[touched[inner - 1]], self.prev[touched[inner]] = touched[inner], touched[inner - 1]
        # Split by all parts but a largest one: the rest if none is larger, else one of the largest groups.
        by_rest = rest >= largest
        leave = keeps & ~np.repeat(by_rest, groups)
        parts = [touched[np.repeat(~leave, count)]]
        kept = classes[~by_rest & (rest > 0)]
        if len(kept):
            parts.append(self.slots[_ranges(self.low[kept], self.size[kept])])
        return np.concatenate(parts)

    def squares(self, text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(position, period) of all squares with a root of no shorter period, up to the limit. ``text``: the number of the text at each position."""
        self.count = len(self.size)
        # To begin with, a text is one class that falls into those of its words: all but a largest one split.
        number = text[self.slots[self.low]]
        order = np.lexsort((self.size, number))
        last = np.r_[number[order][1:] != number[order][:-1], True]
        some = order[~last]
        small = self.slots[_ranges(self.low[some], self.size[some])]
        length, longest = 1, int(self.limit.max(initial=0))
        while len(small) and length < longest:
            small = self._refine(small, length)
            length += 1
        left = np.flatnonzero(self.next >= 0)
        gap = self.next[left] - left
        square = (gap >= self.since[left]) & (gap <= self.limit[left])
        self.found.append((left[square], gap[square]))
        at, period = (np.concatenate(x) for x in zip(*self.found))
        fits = period <= self.limit[at]
        return at[fits], period[fits]


def _word_numbers(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A number for each word, the same for words of the same bytes."""
    size = end - start
    inside = np.zeros(len(data) + 1, np.int8)
    inside[start] = 1
    inside[end] -= 1  # words are apart, or the next begins where this one ends
    joined = pa.py_buffer(np.ascontiguousarray(data[np.cumsum(inside[:-1], dtype=np.int8).astype(bool)]))
    offsets = pa.py_buffer(np.r_[0, np.cumsum(size)])
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(start), [None, offsets, joined]).dictionary_encode().indices.to_numpy().astype(np.int64)


def runs_of(words: np.ndarray, bounds: np.ndarray, least_exponent: int, least_length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text, start, length, period) of the runs of all texts, by text, start and period. ``words``: numbers of all words, ``bounds``: where each text begins, and the end."""
    counts = np.diff(bounds)
    none = (np.zeros(0, np.int64),) * 4
    if not len(words):
        return none
    texts = np.arange(len(counts))
    text = np.repeat(texts, counts + 1)
    mark = bounds[1:] + texts  # a mark ends each text
    symbols = np.empty(len(text), np.int64)
    is_word = np.ones(len(text), bool)
    is_word[mark] = False
    symbols[is_word] = text[is_word] * (words.max() + 1) + words
    symbols[mark] = -1 - texts
    at, period = _Classes(symbols, np.repeat(counts // least_exponent, counts + 1)).squares(text)
    order = np.lexsort((at, period))
    at, period = at[order], period[order]
    if not len(at):
        return none
    first = np.flatnonzero(np.r_[True, (at[1:] != at[:-1] + 1) | (period[1:] != period[:-1])])
    start, period = at[first], period[first]
    length = np.diff(np.r_[first, len(at)]) + 2 * period - 1
    long = np.flatnonzero(length >= np.maximum(least_length, least_exponent * period))
    long = long[np.lexsort((period[long], start[long]))]
    begin = bounds[:-1] + texts
    return text[start[long]], start[long] - begin[text[start[long]]], length[long], period[long]


def _collapse(data: np.ndarray, start: np.ndarray, end: np.ndarray, keep: np.ndarray, row: np.ndarray, rows: int) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of the kept words of each row, joined by one blank."""
    start, end, row = start[keep], end[keep], row[keep]
    edge = np.zeros(len(data) + 1, np.int8)
    edge[start] = 1
    edge[end] -= 1
    inside = np.cumsum(edge[:-1], dtype=np.int8).astype(bool)
    between = end[:-1][row[1:] == row[:-1]]  # another word of the row follows, so a blank is here
    inside[between] = True
    out = data.copy()
    out[between] = 0x20
    sizes = np.bincount(row, weights=end - start, minlength=rows).astype(np.int64) + np.bincount(row[1:][row[1:] == row[:-1]], minlength=rows)
    return out[inside], np.r_[0, np.cumsum(sizes)]


def _slices(column: pa.Array, least_exponent: int, least_length: int) -> Iterator[tuple[int, int, pa.Array, pa.Array, pa.Array]]:
    """(first row, rows, number of words, runs, collapsed text) of runs of rows."""
    for first, data, offsets in textbytes.slices(column, SLICE_BYTES):
        rows = len(offsets) - 1
        start, end, row = textbytes.words(data, offsets)
        bounds = np.searchsorted(row, np.arange(rows + 1))
        text, at, length, period = runs_of(_word_numbers(data, start, end), bounds, least_exponent, least_length)
        drop = np.zeros(len(start) + 1, np.int64)
        np.add.at(drop, bounds[text] + at + period, 1)
        np.add.at(drop, bounds[text] + at + length, -1)
        joined, ends = _collapse(data, start, end, np.cumsum(drop[:-1]) == 0, row, rows)
        runs = pa.StructArray.from_arrays([pa.array(x) for x in (at, length, period)], ["start", "length", "period"])
        lists = pa.ListArray.from_arrays(pa.array(np.searchsorted(text, np.arange(rows + 1)).astype(np.int32)), runs)
        collapsed = pa.LargeStringArray.from_buffers(rows, pa.py_buffer(ends), pa.py_buffer(joined))
        yield first, rows, pa.array(np.diff(bounds)), lists, collapsed.cast(pa.string())


def find_runs(docs: DataFrame, text: Column | None = None, *, least_exponent: int = 4, least_length: int = 6) -> DataFrame:
    """(doc_id, n_words, runs, collapsed) for every row.

    ``runs``: every maximal stretch of words with smallest period q and a length of at least ``least_length`` and
    ``least_exponent`` * q, by start and then period. ``collapsed``: the words that no run contains after its first q, joined
    by one blank. ``text``: the text to take instead of the column of that name. ``least_exponent`` must be 2 or more.
    """
    if least_exponent < 2:
        raise ValueError("a run has two periods at least")

    def find(batches):
        for batch in batches:
            for first, rows, *columns in _slices(batch.column("text"), least_exponent, least_length):
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(first, rows), *columns], ["doc_id", "n_words", "runs", "collapsed"])
        textbytes.release()

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (F.col("text") if text is None else text).alias("text"))
    return rows.mapInArrow(find, f"doc_id long, n_words long, runs {RUNS}, collapsed string")
