"""Runs: maximal stretches of words that repeat with a period.

Words become numbers, the texts of a batch one sequence with a separate end number after each, so that no match goes across.
Longest common extensions (``Extensions``) are found with a difference cover: a set of residues modulo ``v`` in which every
difference occurs. Only suffixes at covered positions are sorted; two positions compare fewer than ``v`` words until both stand on
a covered one, and from there a sparse table of minima over the sorted suffixes' common lengths gives the rest.

Runs are enumerated on a harmonic grid: for each period ``q`` a run of at least ``least(q) = max(shortest, powers * q)`` words has
a grid point in its first ``least(q) - q`` words, and of these the extensions to both sides of (point, point + q) give the whole
run. The grid of all periods has about ``n log n / (powers - 1)`` points. Of equal stretches the smallest period stays.

Texts are taken whole; working memory is in proportion to the longest text, for which a wider cover is chosen.

Defined results: a null text has no words; texts without a run have an empty list and their words as they are, joined by one
space; repeated rows give the same result each; an empty table gives an empty one; columns whose names clash with results are replaced.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, types as T

from stallwise.llm import common

WORD = r"[^\x20\x09-\x0D]+"
SHORTEST, POWERS = 6, 4
#: Words that are worked on at once, and grid points.
CHUNK, POINTS = 200_000, 1 << 20
#: Covered positions kept for one sequence before a wider cover is taken.
COVERED = 1 << 20
FAR = np.iinfo(np.int32).max

RUNS = T.ArrayType(T.StructType([T.StructField(n, T.LongType()) for n in ("start", "length", "period")]))


def difference_cover(r: int) -> tuple[int, np.ndarray]:
    """A modulus 24 r^2 + 36 r + 13 and 6 r + 4 residues whose differences are all residues (Colbourn and Ling's rule)."""
    gaps = [1] * r + [r + 1] + [2 * r + 1] * r + [4 * r + 3] * (2 * r + 1) + [2 * r + 2] * (r + 1) + [1] * r
    return 24 * r * r + 36 * r + 13, np.concatenate([[0], np.cumsum(gaps)]).astype(np.int64)


def cover_for(n: int, covered: int = COVERED) -> tuple[int, np.ndarray]:
    r = 1
    while n * (6 * r + 4) > covered * (24 * r * r + 36 * r + 13) and r < 40:
        r += 1
    return difference_cover(r)


class Minima:
    """Sparse table: smallest value of any stretch in two look-ups."""

    def __init__(self, values: np.ndarray):
        rows, width = [values], 1
        while 2 * width <= len(values):
            last = rows[-1]
            rows.append(last.copy())
            rows[-1][:-width] = np.minimum(last[:-width], last[width:])
            width *= 2
        self.table = np.stack(rows)

    def between(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """Minimum of values low + 1 to high, low < high."""
        level = np.frexp((high - low).astype(np.float64))[1] - 1
        return np.minimum(self.table[level, low + 1], self.table[level, high - (np.int64(1) << level) + 1])


class Extensions:
    """Longest common extensions to the right in a sequence in which every text's end number occurs once."""

    def __init__(self, words: np.ndarray, cover: tuple[int, np.ndarray] | None = None):
        self.words = words
        self.v, residues = cover or cover_for(len(words))
        inside = np.zeros(self.v, dtype=bool)
        inside[residues % self.v] = True
        # for each difference a covered residue whose partner is covered too
        self.anchor = np.zeros(self.v, dtype=np.int64)
        for residue in residues % self.v:
            self.anchor[(residues - residue) % self.v] = residue
        positions = np.flatnonzero(inside[np.arange(len(words)) % self.v])
        suffixes, common_lengths = self._sorted(positions)
        self.rank = np.zeros(len(words), dtype=np.int32)
        self.rank[suffixes] = np.arange(len(suffixes))
        self.minima = Minima(common_lengths)

    def _sorted(self, positions: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Covered suffixes in order, and how much each has in common with the one before."""
        words, m = self.words, len(positions)
        suffixes = positions[np.argsort(words[positions], kind="stable")]
        heads = words[suffixes]
        fresh = np.ones(m, dtype=bool)
        fresh[1:] = heads[1:] != heads[:-1]
        lengths = np.where(fresh, 0, FAR).astype(np.int32)
        group = np.maximum.accumulate(np.where(fresh, np.arange(m), 0))

        def open_slots(slots: np.ndarray) -> np.ndarray:
            """Slots whose group has more than one suffix."""
            same = group[slots[1:]] == group[slots[:-1]]
            return slots[np.concatenate([[False], same]) | np.concatenate([same, [False]])] if len(slots) else slots

        def split(slots: np.ndarray, keys: np.ndarray, length) -> np.ndarray:
            order = np.lexsort((keys, group[slots]))
            suffixes[slots], keys, groups = suffixes[slots][order], keys[order], group[slots]
            new = np.ones(len(slots), dtype=bool)
            new[1:] = (groups[1:] != groups[:-1]) | (keys[1:] != keys[:-1])
            parted = new & (slots != groups)
            lengths[slots[parted]] = length(slots[parted], keys[parted], keys[np.flatnonzero(parted) - 1])
            group[slots] = np.maximum.accumulate(np.where(new, slots, 0))
            return open_slots(slots)

        slots, depth = open_slots(np.arange(m)), 1
        while len(slots) and depth < self.v:
            slots = split(slots, words[suffixes[slots] + depth], lambda at, own, before, d=depth: d)
            depth += 1
        # beyond v words the rank of the covered suffix that far ahead decides
        ahead = self.v
        while len(slots):
            ranks = np.zeros(len(words), dtype=np.int64)
            ranks[suffixes] = group
            known = Minima(lengths)
            slots = split(
                slots, ranks[suffixes[slots] + ahead],
                lambda at, own, before, h=ahead, t=known: h + t.between(before, own),
            )
            ahead *= 2
        return suffixes, lengths

    def between(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """How many words from i on equal those from j on; i and j differ."""
        steps = (self.anchor[(j - i) % self.v] - i) % self.v
        found = np.full(len(i), -1, dtype=np.int64)
        left, done = np.arange(len(i)), 0
        while len(left):
            arrived = steps[left] == done
            if arrived.any():
                at = left[arrived]
                a, b = self.rank[i[at] + done].astype(np.int64), self.rank[j[at] + done].astype(np.int64)
                found[at] = done + self.minima.between(np.minimum(a, b), np.maximum(a, b))
                left = left[~arrived]
            same = self.words[i[left] + done] == self.words[j[left] + done]
            found[left[~same]] = done
            left, done = left[same], done + 1
        return found


def runs_of(texts: list[np.ndarray], shortest: int = SHORTEST, powers: int = POWERS) -> np.ndarray:
    """Rows (text, start, length, period) of all runs, in this order; words are numbers from 0 on."""
    if powers < 2:
        raise ValueError("a run must hold its period at least twice")
    sizes = np.array([len(t) for t in texts], dtype=np.int64)
    ends = 1 + max((int(t.max()) for t in texts if len(t)), default=0)
    parts: list[np.ndarray] = [np.array([ends])]
    for number, text in enumerate(texts):
        parts += [text, np.array([ends + 1 + number])]
    words = np.concatenate(parts).astype(np.int64)
    begins = 1 + np.concatenate([[0], np.cumsum(sizes + 1)[:-1]])
    owners = np.repeat(np.arange(len(texts)), np.where(sizes >= shortest, sizes // powers, 0))
    if not len(owners):
        return np.empty((0, 4), dtype=np.int64)
    first = np.searchsorted(owners, owners)
    periods = np.arange(len(owners)) - first + 1
    step = np.maximum(shortest, powers * periods) - periods
    points = np.maximum(0, -(-(sizes[owners] - periods) // step))
    until = np.cumsum(points)
    forward = backward = None
    found, at = [], 0
    while at < len(owners):
        past = max(at + 1, int(np.searchsorted(until, (until[at - 1] if at else 0) + POINTS, side="right")))
        count = points[at:past]
        pair = np.repeat(np.arange(at, past), count)
        number = np.arange(len(pair)) - np.repeat(np.cumsum(count) - count, count)
        i = begins[owners[pair]] + number * step[pair]
        j = i + periods[pair]
        hit = words[i] == words[j]
        i, j, pair, at = i[hit], j[hit], pair[hit], past
        if not len(i):
            continue
        if forward is None:
            forward, backward = Extensions(words), Extensions(words[::-1].copy())
        right = forward.between(i, j)
        left = backward.between(len(words) - i, len(words) - j)
        start, length, period = i - left, left + periods[pair] + right, periods[pair]
        long = length >= np.maximum(shortest, powers * period)
        owner = owners[pair][long]
        found.append(np.stack([owner, start[long] - begins[owner], length[long], period[long]], axis=1))
    if not found:
        return np.empty((0, 4), dtype=np.int64)
    rows = np.unique(np.concatenate(found), axis=0)
    keep = np.ones(len(rows), dtype=bool)
    keep[1:] = (rows[1:, :3] != rows[:-1, :3]).any(axis=1)
    rows = rows[keep]
    return rows[np.lexsort((rows[:, 3], rows[:, 1], rows[:, 0]))]


def find(
    docs: DataFrame, text: str = "text", shortest: int = SHORTEST, powers: int = POWERS, word: str = WORD,
) -> DataFrame:
    """Documents with ``words`` (their number), ``runs`` (start, length, period; by start, then period) and ``collapsed``.

    A word is left out of ``collapsed`` if any run holds it after the run's first period; the others are joined by one space.
    """
    pattern = re.compile(word)

    def chunk(texts: list[list[str]], counts: list, runs: list, collapsed: list) -> None:
        flat = pa.array([w for t in texts for w in t], type=pa.string()).dictionary_encode().indices.to_numpy()
        bounds = np.cumsum([len(t) for t in texts])[:-1]
        rows = runs_of(np.split(flat, bounds), shortest, powers)
        limits = np.searchsorted(rows[:, 0], np.arange(len(texts) + 1))
        for number, own in enumerate(texts):
            mine = rows[limits[number]:limits[number + 1], 1:]
            counts.append(len(own))
            runs.append([{"start": s, "length": n, "period": q} for s, n, q in mine.tolist()])
            if len(mine):
                change = np.zeros(len(own) + 1, dtype=np.int64)
                np.add.at(change, mine[:, 0] + mine[:, 2], 1)
                np.add.at(change, mine[:, 0] + mine[:, 1], -1)
                own = [own[k] for k in np.flatnonzero(np.cumsum(change)[:-1] == 0).tolist()]
            collapsed.append(" ".join(own))

    def work():
        def on_batch(batch):
            counts, runs, collapsed, waiting, size = [], [], [], [], 0
            for value in common.column(batch, text):
                waiting.append(pattern.findall(value or ""))
                size += len(waiting[-1])
                if size >= CHUNK:
                    chunk(waiting, counts, runs, collapsed)
                    waiting, size = [], 0
            if waiting:
                chunk(waiting, counts, runs, collapsed)
            return (counts, runs, collapsed), None

        return on_batch

    fields = [T.StructField("words", T.LongType()), T.StructField("runs", RUNS), T.StructField("collapsed", T.StringType())]
    return common.appended(docs, fields, work)
