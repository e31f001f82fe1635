"""Search of whole corpora of lines for those most like a question (J10, X33): exact, by bounds that lose nothing.

The partial ratio of two texts is the best 200 * common / (n + m) of the shorter text, of n characters, with any stretch of
m <= n characters in the longer one, where ``common`` is their longest common subsequence. Long lines are cut into pieces of
twice the longest question, one question apart, so that every stretch lies in a piece. For a piece three tests follow, each
only for what the one before left:

1. Pairs of neighbouring letters. A common subsequence of ``common`` characters falls into 1 + n + m - 2 * common runs at most,
   so the texts share at least 3 * common - 1 - n - m pairs. Shared pairs are counted for all questions and pieces at once by a
   product of matrices; hashed places can only add to the count.
2. The longest common subsequence with the whole piece is at least that with any stretch in it.
3. The ratio itself, all stretches of a line at a time.

What is asked for is a question's best line, so a bound must reach the best score known so far. A first pass over the lines
takes from each slice the stretch with most grams shared, and gives every question a bar; the second finds all that reach it.
Where no line is good, the bar is the threshold and little can be left out: the search is then exact at the cost of all lines.

Questions of at most 64 characters, whose bit row is one word, need no pairs of letters: many questions and many stretches are
walked at once (``WordLines``), so that a character and a question cost a few operations on whole arrays:

1. Windows of two questions, a question apart, hold every stretch of a question's length; the longest common subsequence with
   the window bounds all of them. What is left is tried with windows a quarter of a question apart, then in full.
2. Shorter stretches at either end of a line are all tried: they are the steps of one walk from that end.
3. For lines shorter than a question, the subsequence with the whole question is the bound, then its stretches are tried.

Longer questions go through the three tests above, and cost more.

Questions are a stated set: they are sent to the lines in blocks of at most ``BLOCK`` of them, one scan of the lines for each
pass and block. Lines are never shuffled, and a task gives one row for each question. Lines that repeat in a slice are met once.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.fuzzy import partial_ratio

BLOCK = 4096
SLOTS = 512
SLICE_CHARS = 1 << 20
SEED_WIDTH = 5
AT_ONCE = 256  # questions in one product
SLACK = 1e-6
WORD = 64
CELL = 1 << 15  # states walked at once: they stay in a core's cache
PAIRS = 1 << 16  # windows refined at once
NEAR = 1.25  # longest to shortest question of a group


def _codes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(code points of all texts, where each begins, and the end)."""
    return np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64), np.r_[0, np.cumsum([len(t) for t in texts])].astype(np.int64)


def _gram_counts(codes: np.ndarray, starts: np.ndarray, ends: np.ndarray, width: int, known: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(matrix of pieces x slots, the different grams): the k-th time that ``width`` letters in a row are in a piece counts in a slot of its own, up to collisions."""
    sizes = np.maximum(ends - starts - width + 1, 0)
    piece = np.repeat(np.arange(len(starts)), sizes)
    at = np.arange(len(piece)) - np.repeat(np.cumsum(sizes) - sizes, sizes) + np.repeat(starts, sizes)
    pair = codes[at]
    for k in range(1, width):
        pair = (pair << 21 if width == 2 else pair * 1_000_003) + codes[at + k]
    if known is not None:
        place = np.minimum(np.searchsorted(known, pair), max(0, len(known) - 1))
        some = known[place] == pair if len(known) else np.zeros(len(pair), bool)
        piece, pair = piece[some], pair[some]
    order = np.lexsort((pair, piece))
    piece, pair = piece[order], pair[order]
    fresh = np.flatnonzero(np.r_[True, (piece[1:] != piece[:-1]) | (pair[1:] != pair[:-1])]) if len(pair) else np.zeros(0, np.int64)
    nth = np.arange(len(pair)) - np.repeat(fresh, np.diff(np.r_[fresh, len(pair)]))
    slot = ((pair.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + nth.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)) >> np.uint64(40)) % np.uint64(SLOTS)
    counts = np.bincount(piece * SLOTS + slot.astype(np.int64), minlength=len(starts) * SLOTS)
    return counts.reshape(len(starts), SLOTS).astype(np.float32), np.unique(pair)


def _step(state: np.ndarray, here: np.ndarray) -> None:
    """One character of the longer text: rows are the words of the bit rows, lowest first."""
    carry = None
    for k in range(len(state)):
        met = state[k] & here[k]
        total = state[k] + met
        over = total < met
        if carry is not None:
            total += carry
            over |= total < carry
        state[k] = total | (state[k] & ~met)
        carry = over.astype(np.uint64)


class Questions:
    """A block of questions: their bit rows, pairs and lengths."""

    def __init__(self, texts: list[str]):
        self.texts = texts
        codes, bounds = _codes(texts)
        self.sizes = np.diff(bounds)
        self.most = int(self.sizes.max(initial=1))
        self.letters = np.unique(codes)
        self.pairs, self.known = _gram_counts(codes, bounds[:-1], bounds[1:], 2)
        self.longer, self.known_longer = _gram_counts(codes, bounds[:-1], bounds[1:], SEED_WIDTH)
        self.rows = [self._bits(np.searchsorted(self.letters, codes[a:b])) for a, b in zip(bounds[:-1], bounds[1:])]

    def _bits(self, places: np.ndarray) -> np.ndarray:
        """For each letter, and for one that no question has, the places that hold it, as bits."""
        rows = np.zeros((-(-len(places) // 64), len(self.letters) + 1), np.uint64)
        np.bitwise_or.at(rows, (np.arange(len(places)) // 64, places), np.uint64(1) << (np.arange(len(places)) % 64).astype(np.uint64))
        return rows

    def start(self, q: int, n: int) -> np.ndarray:
        """States before the first character: a one for each place of the question."""
        full = [min(64, int(self.sizes[q]) - 64 * k) for k in range(len(self.rows[q]))]
        return np.repeat(np.array([(1 << f) - 1 for f in full], np.uint64)[:, None], n, axis=1)

    def common(self, q: int, state: np.ndarray) -> np.ndarray:
        left = np.zeros(state.shape[1], np.int64)
        for k, row in enumerate(state):
            inside = min(64, int(self.sizes[q]) - 64 * k)
            left += np.bitwise_count(row & np.uint64((1 << inside) - 1)).astype(np.int64)
        return self.sizes[q] - left


class Lines:
    """A slice of lines, cut into pieces for a block of questions."""

    def __init__(self, texts: list[str], asked: Questions):
        self.texts, self.asked = texts, asked
        codes, self.bounds = _codes(texts)
        self.sizes = np.diff(self.bounds)
        place = np.minimum(np.searchsorted(asked.letters, codes), max(0, len(asked.letters) - 1))
        self.letters = np.where(asked.letters[place] == codes, place, len(asked.letters)) if len(codes) else codes
        step = asked.most
        pieces = np.maximum(1, -(-self.sizes // step) - 1)
        self.line = np.repeat(np.arange(len(texts)), pieces)
        nth = np.arange(len(self.line)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        self.start = self.bounds[self.line] + nth * step
        self.end = np.minimum(self.start + 2 * step, self.bounds[self.line + 1])
        self.at_edge = (nth == 0) | (self.end == self.bounds[self.line + 1])
        self.pairs, _ = _gram_counts(codes, self.start, self.end, 2, asked.known)
        self.codes = codes
        width = int((self.end - self.start).max(initial=0))
        self.columns = np.full((width, len(self.line)), len(asked.letters), np.int32)
        for t in range(width):
            inside = self.start + t < self.end
            self.columns[t, inside] = self.letters[self.start[inside] + t]

    def bounds_by_pairs(self, first: int, last: int) -> Iterator[tuple[int, np.ndarray]]:
        """(question, bound of the ratio for each piece)."""
        shared = self.pairs @ self.asked.pairs[first:last].T
        for q in range(first, last):
            n = np.minimum(self.asked.sizes[q], self.sizes[self.line])
            most = np.minimum(n, (shared[:, q - first] + 1 + n) / 2)
            yield q, np.where(n > 0, 200 * most / np.maximum(n + most, 1), 0)

    def bounds_by_letters(self, q: int, pieces: np.ndarray) -> np.ndarray:
        """Bound of the ratio for pieces of lines that are no shorter than the question."""
        rows, state = self.asked.rows[q], self.asked.start(q, len(pieces))
        for column in self.columns:
            _step(state, rows[:, column[pieces]])
        common, n = self.asked.common(q, state), self.asked.sizes[q]
        return np.where(self.at_edge[pieces], 200 * common / (n + common), 100 * common / n)

    def ratios(self, q: int, some: np.ndarray) -> np.ndarray:
        """The partial ratios of the question and these lines."""
        out = np.zeros(len(some))
        n = int(self.asked.sizes[q])
        long = np.flatnonzero(self.sizes[some] >= n)
        for i in np.setdiff1d(np.arange(len(some)), long):
            out[i] = partial_ratio(self.asked.texts[q], self.texts[some[i]])
        for part in np.split(long, np.flatnonzero(np.diff(np.cumsum(self.sizes[some[long]] + n) >> 17)) + 1) if len(long) else []:
            sizes = self.sizes[some[part]]
            first = np.cumsum(sizes + n) - (sizes + n)  # n blanks after each line
            letters = np.full(int((sizes + n).sum()) + n, len(self.asked.letters))
            owner = np.repeat(np.arange(len(part)), sizes)
            at = np.arange(len(owner)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
            letters[first[owner] + at] = self.letters[np.repeat(self.bounds[some[part]], sizes) + at]
            here, state = self.asked.rows[q][:, letters], self.asked.start(q, len(letters) - n)
            best = np.zeros(len(part))
            for t in range(n):
                _step(state, here[:, t : t + state.shape[1]])
                if t < n - 1:  # the first t + 1 characters of each line
                    best = np.maximum(best, 200 * self.asked.common(q, np.ascontiguousarray(state[:, first])) / (n + t + 1))
            score = 200 * self.asked.common(q, np.ascontiguousarray(state[:, first[owner] + at])) / (n + np.minimum(n, np.repeat(sizes, sizes) - at))
            out[part] = np.maximum(best, np.maximum.reduceat(score, np.cumsum(sizes) - sizes))
        return out


def _advance(state: np.ndarray, here: np.ndarray, rest: np.ndarray) -> None:
    """One character for states of one word; places beyond the question are ones and stay so. ``here`` and ``rest`` are used up."""
    np.bitwise_and(state, here, out=here)
    np.bitwise_xor(state, here, out=rest)
    np.add(state, here, out=state)
    np.bitwise_or(state, rest, out=state)


class WordQuestions:
    """A block of questions of 1 to 64 characters: their bit rows, forwards and backwards, and groups of about one length."""

    def __init__(self, texts: list[str]):
        codes, bounds = _codes(texts)
        self.sizes = np.diff(bounds)
        self.letters = np.unique(codes)
        self.table = np.full(int(self.letters.max(initial=0)) + 2, len(self.letters))
        self.table[self.letters] = np.arange(len(self.letters))
        owner = np.repeat(np.arange(len(texts)), self.sizes)
        at = np.arange(len(codes)) - bounds[owner]
        self.rows, self.back = (np.zeros((len(self.letters) + 1, len(texts)), np.uint64) for _ in range(2))
        for rows, bit in ((self.rows, at), (self.back, self.sizes[owner] - 1 - at)):
            np.bitwise_or.at(rows, (self.table[codes], owner), np.uint64(1) << bit.astype(np.uint64))
        self.groups: list[np.ndarray] = []
        for q in np.argsort(self.sizes, kind="stable"):
            group = self.groups[-1] if self.groups else []
            if len(group) in (0, AT_ONCE) or self.sizes[q] > NEAR * self.sizes[group[0]]:
                self.groups.append(group := [])
            group.append(q)
        self.groups = [np.array(group) for group in self.groups]
        slots, first = self.slots(self.table[codes]), np.flatnonzero(at[: len(codes) - SEED_WIDTH + 1] + SEED_WIDTH <= self.sizes[owner[: max(0, len(codes) - SEED_WIDTH + 1)]])
        self.known = np.full(1 << 20, -1, np.int32)  # the column of a gram that a question has
        self.known[slots[first]] = slots[first] % SLOTS
        self.grams = np.zeros((SLOTS, len(texts)), np.float32)
        self.grams[slots[first] % SLOTS, owner[first]] = 1

    @staticmethod
    def slots(letters: np.ndarray) -> np.ndarray:
        """A place in 2^20 for every ``SEED_WIDTH`` letters in a row."""
        gram = np.zeros(max(0, len(letters) - SEED_WIDTH + 1), np.uint64)
        for k in range(SEED_WIDTH):
            gram *= np.uint64(1_000_003)
            gram += letters[k : k + len(gram)].astype(np.uint64)
        return ((gram * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(44)).astype(np.int64)


class WordLines:
    """A slice of lines for a block of questions of one word; blanks that no question has stand before, after and between them."""

    def __init__(self, texts: list[str], asked: WordQuestions):
        self.asked = asked
        codes, bounds = _codes(texts)
        self.sizes = np.diff(bounds)
        self.first = bounds[:-1] + 2 * WORD * np.arange(1, len(texts) + 1)
        self.letters = np.full(len(codes) + 2 * WORD * (len(texts) + 1), len(asked.letters))
        self.letters[np.arange(len(codes)) + np.repeat(self.first - bounds[:-1], self.sizes)] = asked.table[np.minimum(codes, len(asked.table) - 1)]

    def _walk(self, rows: np.ndarray, starts: np.ndarray, steps: int, by: int = 1) -> Iterator[np.ndarray]:
        """The states (starts x questions) after each of ``steps`` characters."""
        state = np.full((len(starts), rows.shape[1]), ~np.uint64(0))
        here, rest = np.empty_like(state), np.empty_like(state)
        for t in range(steps):
            np.take(rows, self.letters[starts + by * t], axis=0, out=here, mode="clip")
            _advance(state, here, rest)
            yield state

    def common(self, q: np.ndarray, starts: np.ndarray, steps: np.ndarray, only: np.ndarray | None = None) -> np.ndarray:
        """Common characters of each question, or those places of it that are ones in ``only``, with so many characters from each start."""
        flat, width = self.asked.rows.ravel(), self.asked.rows.shape[1]
        order, out = np.argsort(steps, kind="stable"), np.zeros(len(q), np.int64)
        for first in range(0, len(order), CELL):
            part = order[first : first + CELL]
            ask, at, n = q[part], starts[part], steps[part]
            keep = None if only is None else only[part]
            state = np.full(len(part), ~np.uint64(0))
            rest = np.empty_like(state)
            for t in range(int(n[-1])):
                lo = int(np.searchsorted(n, t, "right"))
                here = flat[self.letters[at[lo:] + t] * width + ask[lo:]]
                if keep is not None:
                    here &= keep[lo:]
                _advance(state[lo:], here, rest[lo:])
            out[part] = WORD - np.bitwise_count(state)
        return out

    def reaching(self, bars: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(questions, lines, scores) that no bound could leave out: a line's partial ratio, where it reaches the bar, is its highest score here."""
        for group in self.asked.groups:
            bar = bars[group] - SLACK
            n = self.asked.sizes[group]
            yield from self._inside(group, n, bar)
            for by in (1, -1):
                yield from self._ends(group, n, bar, by)
            yield from self._short(group, n, bar)

    def _inside(self, group: np.ndarray, n: np.ndarray, bar: np.ndarray) -> Iterator[tuple]:
        """Stretches of a question's length."""
        step = int(n.max())
        rows, most = self.asked.rows[:, group], np.floor(WORD - bar * n / 100).clip(-1)
        lines = np.flatnonzero(self.sizes >= n.min())
        count = -(-(self.sizes[lines] - n.min() + 1) // step)
        line = np.repeat(lines, count)
        start = self.first[line] + step * (np.arange(len(line)) - np.repeat(np.cumsum(count) - count, count))
        at, ask = [], []
        for first in range(0, len(line), max(1, CELL // len(group))):
            part = start[first : first + max(1, CELL // len(group))]
            for state in self._walk(rows, part, int(n.max()) + step - 1):
                pass
            some, those = np.nonzero(np.bitwise_count(state) <= most)
            at.append(some + first)
            ask.append(those)
        if not at:
            return
        at, ask = np.concatenate(at), np.concatenate(ask)
        for first in range(0, len(at), PAIRS):
            part = slice(first, first + PAIRS)
            yield self._refined(group, n, bar, step, line[at[part]], ask[part], start[at[part]])

    def _refined(self, group: np.ndarray, n: np.ndarray, bar: np.ndarray, step: int, line: np.ndarray, ask: np.ndarray, start: np.ndarray) -> tuple:
        """The stretches of windows that remain, by way of finer windows."""
        for finer in (max(1, step // 4), 1):
            tried = start[:, None] + np.arange(0, step, finer)
            some, which = np.nonzero(tried <= (self.first[line] + self.sizes[line] - n[ask])[:, None])
            line, ask, start = line[some], ask[some], tried[some, which]
            common = self.common(group[ask], start, n[ask] + finer - 1)
            if finer > 1:
                good = common >= bar[ask] * n[ask] / 100
                line, ask, start = line[good], ask[good], start[good]
            step = finer
        return group[ask], line, 100 * common / n[ask]

    def _ends(self, group: np.ndarray, n: np.ndarray, bar: np.ndarray, by: int) -> Iterator[tuple]:
        """Stretches shorter than the question, from the beginning (``by`` = 1) or from the end of a line (-1)."""
        size = np.arange(int(n.max()))[:, None]
        need = np.where(size < n, np.ceil(bar * (n + size) / 200), WORD + 1)
        can = np.flatnonzero((need <= size).any(axis=1))
        if not len(can):
            return
        most, rows = WORD - need, (self.asked.rows if by == 1 else self.asked.back)[:, group]
        lines = np.flatnonzero(self.sizes >= n.min())
        start = self.first[lines] if by == 1 else self.first[lines] + self.sizes[lines] - 1
        for first in range(0, len(lines), max(1, CELL // len(group))):
            part = slice(first, first + max(1, CELL // len(group)))
            hit = np.zeros((len(lines[part]), len(group)), bool)
            for done, state in enumerate(self._walk(rows, start[part], int(can[-1]), by), 1):
                if done >= can[0]:
                    hit |= np.bitwise_count(state) <= most[done]
            line, ask = np.nonzero(hit)
            line = lines[part][line]
            long = self.sizes[line] >= n[ask]
            line, ask = np.repeat(line[long], n[ask[long]] - 1), np.repeat(ask[long], n[ask[long]] - 1)
            if not len(line):
                continue
            fresh = np.flatnonzero(np.r_[True, (line[1:] != line[:-1]) | (ask[1:] != ask[:-1])])
            some = np.arange(len(line)) - np.repeat(fresh, np.diff(np.r_[fresh, len(line)])) + 1
            common = self.common(group[ask], self.first[line] + (0 if by == 1 else self.sizes[line] - some), some)
            yield group[ask], line, 200 * common / (n[ask] + some)

    def _short(self, group: np.ndarray, n: np.ndarray, bar: np.ndarray) -> Iterator[tuple]:
        """Lines shorter than the question: whole, in stretches of the question."""
        lines = np.flatnonzero((self.sizes < n.max()) & (self.sizes > 0))
        lines = lines[np.argsort(self.sizes[lines], kind="stable")]
        rows = self.asked.rows[:, group]
        for first in range(0, len(lines), max(1, CELL // len(group))):
            part = lines[first : first + max(1, CELL // len(group))]
            size = self.sizes[part][:, None]
            for state in self._walk(rows, self.first[part], int(size[-1, 0])):
                pass
            common = WORD - np.bitwise_count(state).astype(np.int64)
            line, ask = np.nonzero((200 * common >= bar * (size + common)) & (size < n))
            line = part[line]
            # stretches of the question from 1 - size to n - 1, cut where the question begins and ends
            count = n[ask] + self.sizes[line] - 1
            nth = np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count)
            for some in range(0, len(nth), 1 << 20):
                cut = slice(some, some + (1 << 20))
                pair = np.searchsorted(np.cumsum(count), np.arange(some, min(some + (1 << 20), len(nth))), "right")
                a, li = ask[pair], line[pair]
                low = nth[cut] - self.sizes[li] + 1
                high = np.minimum(low + self.sizes[li], n[a])
                low = np.maximum(low, 0)
                only = (~np.uint64(0) >> (WORD - (high - low)).astype(np.uint64)) << low.astype(np.uint64)
                score = 200 * self.common(group[a], self.first[li], self.sizes[li], only) / (self.sizes[li] + high - low)
                yield group[a], li, score

    def seeds(self) -> np.ndarray:
        """For each question the best score of the stretch of 128 characters that shares most grams with it: a score that the best line reaches."""
        asked, best = self.asked, np.zeros(len(self.asked.sizes))
        column = asked.known[asked.slots(self.letters)]
        hits = np.flatnonzero(column >= 0)
        tiles, tile = np.unique(hits // WORD, return_inverse=True)
        top, where = np.zeros(len(best)), np.zeros(len(best), np.int64)
        for first in range(0, len(tiles), 4096):
            lo, hi = np.searchsorted(tile, (first, first + 4097))
            has = np.zeros((min(4097, len(tiles) - first), SLOTS), np.float32)
            has[tile[lo:hi] - first, column[hits[lo:hi]]] = 1
            shared = has @ asked.grams
            next_to = np.flatnonzero(np.diff(tiles[first : first + len(has)]) == 1)
            shared[next_to] += shared[next_to + 1]
            more = shared.max(axis=0) > top
            where[more] = tiles[first + shared.argmax(axis=0)[more]] * WORD
            top = np.maximum(top, shared.max(axis=0))
        some = np.flatnonzero(top > 0)
        if not len(some):
            return best
        start = (where[some, None] + np.arange(-WORD, 2 * WORD)).ravel()
        ask = np.repeat(some, 3 * WORD)
        line = np.searchsorted(self.first, start, "right") - 1
        inside = (line >= 0) & (start + asked.sizes[ask] <= (self.first + self.sizes)[line])
        ask, start = ask[inside], start[inside]
        np.maximum.at(best, ask, 100 * self.common(ask, start, asked.sizes[ask]) / asked.sizes[ask])
        return best


def _slices(batches) -> Iterator[tuple[list, list[str], int]]:
    """(ids, texts, rows) of runs of rows, a text once with its smallest id; null and empty lines, and lines without an id, are left out."""
    for batch in batches:
        rows = [(i, t) for i, t in zip(batch.column("line_id").to_pylist(), batch.column("text").to_pylist()) if t and i is not None]
        while rows:
            sizes = np.cumsum([len(t) for _, t in rows])
            cut = max(1, int(np.searchsorted(sizes, SLICE_CHARS, "right")))
            first: dict = {}
            for i, t in rows[:cut]:
                if t not in first or i < first[t]:
                    first[t] = i
            yield [*first.values()], [*first], cut
            rows = rows[cut:]


def _seeds(lines: Lines) -> np.ndarray:
    """For each question the score of the line that shares most grams of ``SEED_WIDTH`` with it: a score that the best line reaches."""
    asked = lines.asked
    grams, _ = _gram_counts(lines.codes, lines.start, lines.end, SEED_WIDTH, asked.known_longer)
    best = np.zeros(len(asked.texts))
    for first in range(0, len(best), AT_ONCE):
        shared = grams @ asked.longer[first : first + AT_ONCE].T
        for q, piece in enumerate(shared.argmax(axis=0), first):
            best[q] = lines.ratios(q, lines.line[[piece]]).max(initial=0)
    return best


def _reaching(lines: Lines, bars: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(question, lines, ratios) of all lines that no test could leave out."""
    for first in range(0, len(bars), AT_ONCE):
        for q, bound in lines.bounds_by_pairs(first, min(first + AT_ONCE, len(bars))):
            pieces = np.flatnonzero(bound >= bars[q] - SLACK)
            long = lines.sizes[lines.line[pieces]] >= lines.asked.sizes[q]
            tested = pieces[long]
            if len(tested):
                tested = tested[lines.bounds_by_letters(q, tested) >= bars[q] - SLACK]
            some = np.unique(lines.line[np.r_[pieces[~long], tested]])
            yield q, some, lines.ratios(q, some) if len(some) else np.zeros(0)


class Block:
    """A block of questions: those of one word and longer ones, each searched in its own way."""

    def __init__(self, texts: list[str]):
        sizes = np.array([len(t) for t in texts], np.int64)
        self.word, self.long = np.flatnonzero(sizes <= WORD), np.flatnonzero(sizes > WORD)
        self.words, self.longer = WordQuestions([texts[q] for q in self.word]), Questions([texts[q] for q in self.long])

    def seeds(self, texts: list[str]) -> np.ndarray:
        best = np.zeros(len(self.word) + len(self.long))
        if len(self.word):
            best[self.word] = WordLines(texts, self.words).seeds()
        if len(self.long):
            best[self.long] = _seeds(Lines(texts, self.longer))
        return best

    def reaching(self, texts: list[str], bars: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(questions, lines, scores) that no bound could leave out."""
        if len(self.word):
            for ask, line, score in WordLines(texts, self.words).reaching(bars[self.word]):
                yield self.word[ask], line, score
        if len(self.long):
            for q, line, score in _reaching(Lines(texts, self.longer), bars[self.long]):
                yield np.full(len(line), self.long[q]), line, score


def best_lines(asked: DataFrame, lines: DataFrame, threshold: float = 70, *, ask_text: str = "text") -> DataFrame:
    """(ask_id, line_id, score, verified, met): for each question the line most like it, from ``threshold`` on; ties to the first line.

    ``verified`` counts the lines whose ratio was computed in the second pass, repeated ones of a slice once, ``met`` all lines
    that are not empty and have an id. Questions that are null or empty, or reach no line, have no row; of repeated ids the best
    counts.
    """
    kinds = asked.schema["ask_id"].dataType.simpleString(), lines.schema["line_id"].dataType.simpleString()
    rows = asked.filter(F.length(ask_text) > 0).select("ask_id", F.col(ask_text).alias("text")).toLocalIterator()
    lines = lines.select("line_id", "text")
    out = None
    while block := list(islice(rows, BLOCK)):
        found = _search(lines, [r.ask_id for r in block], [r.text for r in block], threshold, kinds)
        out = found if out is None else out.unionByName(found)
    if out is None:
        return asked.sparkSession.createDataFrame([], f"ask_id {kinds[0]}, line_id {kinds[1]}, score double, verified long, met long")
    known = F.when(F.col("line_id").isNotNull(), F.struct((-F.col("score")).alias("less"), "line_id"))
    best = out.groupBy("ask_id").agg(F.min(known).alias("best"), F.sum("verified").alias("verified"), F.sum("met").alias("met"))
    return best.filter("best.line_id is not null").select("ask_id", F.col("best.line_id").alias("line_id"), (-F.col("best.less")).alias("score"), "verified", "met")


def _search(lines: DataFrame, ids: list, texts: list[str], threshold: float, kinds: tuple[str, str]) -> DataFrame:
    def seed(batches):
        asked, best = Block(texts), np.zeros(len(texts))
        for _, some, _ in _slices(batches):
            best = np.maximum(best, asked.seeds(some))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(best))), pa.array(best)], ["q", "score"])

    bars = np.full(len(texts), float(threshold))
    for r in lines.mapInArrow(seed, "q long, score double").groupBy("q").agg(F.max("score").alias("score")).collect():  # a row for each question of a block
        bars[r.q] = max(bars[r.q], r.score)

    def find(batches):
        asked, bar = Block(texts), bars.copy()
        best: list = [(float("-inf"), None)] * len(texts)
        verified, met = np.zeros(len(texts), np.int64), 0
        for names, some, rows in _slices(batches):
            met += rows
            tried = [np.zeros(0, np.int64)]
            for ask, line, scores in asked.reaching(some, bar):
                tried.append(np.unique(ask * len(names) + line))
                good = scores >= bar[ask]
                np.maximum.at(bar, ask[good], scores[good])
                good &= scores >= bar[ask]
                for q, at, found in set(zip(ask[good].tolist(), line[good].tolist(), scores[good].tolist())):
                    if best[q][1] is None or (-found, names[at]) < (-best[q][0], best[q][1]):
                        best[q] = found, names[at]
            verified += np.bincount(np.unique(np.concatenate(tried)) // len(names), minlength=len(texts))
        some = [(ids[q], line, None if line is None else score, int(verified[q]), met) for q, (score, line) in enumerate(best)]
        names = pa.array([r[0] for r in some]), pa.array([r[1] for r in some], None if any(r[1] is not None for r in some) else pa.null())
        columns = [*names, *[pa.array([r[k] for r in some], kind) for k, kind in ((2, pa.float64()), (3, pa.int64()), (4, pa.int64()))]]
        yield pa.RecordBatch.from_arrays(columns, ["ask_id", "line_id", "score", "verified", "met"])

    return lines.mapInArrow(find, f"ask_id {kinds[0]}, line_id {kinds[1]}, score double, verified long, met long")
