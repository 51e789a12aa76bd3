"""Benchmark decontamination by winnowing.

Words are the runs ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` after A-Z are lower-cased. Of every ``WINDOW - GRAM + 1`` consecutive word
``GRAM``-grams the least hash is kept as a fingerprint, in documents and in items alike, so two texts that share ``WINDOW`` words in
a row share a fingerprint there. A shared fingerprint is extended to both sides as far as the words agree; runs of at least
``WINDOW`` words are hits. Items of fewer words have one window, all of their words, which is looked up by its own hash.

Items are indexed in blocks of about ``BLOCK_WORDS`` words by a hash of their id. A block is sent to every task, so its size does not depend on
the benchmark's; the documents pass by all blocks, with no shuffle, and hits of all blocks are united.

Defined results: null texts have no words; items without words have no window; items without an id count under the empty id,
items that share an id count once. Repeated rows are judged alike, one by one.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from stallwise.llm import common
from stallwise.llm.neardup import STEP, WordHashes, mixed

WINDOW, GRAM = 13, 5
BLOCK_WORDS = 1_000_000
CHUNK_BYTES = 1 << 20
_MARK = b"\x00"
_GAP = b" " + b" ".join([_MARK] * WINDOW) + b" "
#: A document is contaminated if one word in so many is hit.
ONE_IN = 20
NO_ITEMS = hashlib.sha256(b"").hexdigest()
_WORD_BYTES = bytes(
    b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256)
)


class Words(WordHashes):
    """Hashes of the words of a text by the rule above."""

    def of(self, text: str | None) -> np.ndarray:
        if len(self) > common.CACHE_ENTRIES:
            self.clear()
        return self.hashed((text or "").encode("utf-8", "surrogatepass").translate(_WORD_BYTES).split())

    def hashed(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.int64, len(words)).view(np.uint64)

    def together(self, texts: list[str | None]) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """The words of many texts in long arrays; texts are parted by ``WINDOW`` marks that no item has."""
        out, chunk, size = [], [], 0
        for i, t in enumerate(texts):
            chunk.append((t or "").encode("utf-8", "surrogatepass").translate(_WORD_BYTES))
            size += len(chunk[-1])
            if size > CHUNK_BYTES or i == len(texts) - 1:
                if len(self) > common.CACHE_ENTRIES:
                    self.clear()
                flat = self.hashed(_GAP.join([b"", *chunk, b""]).split())
                gaps = np.flatnonzero(flat == np.uint64(self[_MARK]))
                # the last mark before each text, and the first one after it
                out.append((flat, gaps[WINDOW - 1 : -1 : WINDOW] + 1, gaps[WINDOW::WINDOW]))
                chunk, size = [], 0
        return out


def grams(words: np.ndarray, n: int) -> np.ndarray:
    if len(words) < n:
        return words[:0]
    out = words[: len(words) - n + 1].copy()
    for i in range(1, n):
        out *= STEP
        out += words[i : len(words) - n + 1 + i]
    return mixed(out)


def winnowed(hashes: np.ndarray, width: int = WINDOW - GRAM + 1) -> np.ndarray:
    """Least hash of every ``width`` consecutive ones."""
    out, have = hashes, 1
    while have < width:
        more = min(have, width - have)
        out = np.minimum(out[: len(out) - more], out[more:])
        have += more
    return out


class Index:
    """Fingerprints of one block of items."""

    def __init__(self, items: list[tuple[str | None, str | None]]) -> None:
        words = Words()
        self.items: list[tuple[str, np.ndarray]] = []
        self.places: dict[int, list[tuple[int, int]]] = defaultdict(list)
        self.short: dict[int, dict[int, list[int]]] = defaultdict(lambda: defaultdict(list))
        for item_id, text in items:
            w = words.of(text)
            if not len(w):
                continue
            k = len(self.items)
            self.items.append(("" if item_id is None else str(item_id), w))
            if len(w) < WINDOW:
                self.short[len(w)][int(grams(w, len(w))[0])].append(k)
                continue
            hashes = grams(w, GRAM)
            kept = set(winnowed(hashes).tolist())
            for q, h in enumerate(hashes.tolist()):
                if h in kept:
                    self.places[h].append((k, q))
        self.short = {n: dict(by) for n, by in self.short.items()}
        self.places = dict(self.places)
        self.prints = np.array(sorted(self.places), dtype=np.uint64)
        self.short_prints = {n: np.array(sorted(by), dtype=np.uint64) for n, by in self.short.items()}

    @staticmethod
    def _known(values: np.ndarray, among: np.ndarray) -> np.ndarray:
        if not len(among):
            return np.zeros(len(values), dtype=bool)
        at = np.searchsorted(among, values)
        at[at == len(among)] = 0
        return among[at] == values

    def suspects(self, flat: np.ndarray) -> np.ndarray:
        """Places in the words of many texts where a fingerprint or a short item may lie."""
        places = [np.zeros(0, dtype=np.int64)]
        if len(flat) >= WINDOW and len(self.prints):
            least = winnowed(grams(flat, GRAM))
            steps = np.flatnonzero(np.append(True, least[1:] != least[:-1]))
            steps = steps[self._known(least[steps], self.prints)]
            # the fingerprint lies in a window that starts here; the window may start in the gap before its text
            places += [steps, steps + WINDOW - GRAM]
        for n, prints in self.short_prints.items():
            places.append(np.flatnonzero(self._known(grams(flat, n), prints)))
        return np.concatenate(places)

    def hits(self, w: np.ndarray) -> tuple[list[tuple[int, int]], set[str]]:
        """Ranges of words that lie in an occurring window, and the items they come from."""
        ranges: list[tuple[int, int]] = []
        found: set[str] = set()
        if len(w) >= WINDOW and len(self.prints):
            hashes = grams(w, GRAM)
            self._extend(w, hashes, ranges, found)
        for n, prints in self.short_prints.items():
            of = grams(w, n)
            for p in np.flatnonzero(self._known(of, prints)).tolist():
                for k in self.short[n][int(of[p])]:
                    if (self.items[k][1] == w[p : p + n]).all():
                        ranges.append((p, p + n))
                        found.add(self.items[k][0])
        return ranges, found

    def _extend(self, w: np.ndarray, hashes: np.ndarray, ranges: list, found: set) -> None:
        done: dict[tuple[int, int], int] = {}
        for p in np.flatnonzero(self._known(hashes, self.prints)).tolist():
            for k, q in self.places[int(hashes[p])]:
                if done.get((k, p - q), 0) > p:
                    continue
                name, item = self.items[k]
                back = min(p, q)
                same = w[p - back : p][::-1] == item[q - back : q][::-1]
                first = p - (back if same.all() else int(np.argmin(same)))
                ahead = min(len(w) - p, len(item) - q)
                same = w[p : p + ahead] == item[q : q + ahead]
                last = p + (ahead if same.all() else int(np.argmin(same)))
                done[k, p - q] = last
                if last - first >= WINDOW:
                    ranges.append((first, last))
                    found.add(name)


def united(ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(ranges):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def blocks(items: DataFrame, item_id: str, text: str, block_words: int):
    """The items in blocks, one after the other."""
    size = F.coalesce(F.length(text), F.lit(0)) / 2
    total = items.agg(F.coalesce(F.sum(size), F.lit(0.0))).first()[0]
    n = max(1, -(-int(total) // block_words))
    for i in range(n):
        part = items.where(F.pmod(F.xxhash64(item_id), F.lit(n)) == i) if n > 1 else items
        yield [(r[0], r[1]) for r in part.select(F.col(item_id).cast("string"), text).collect()]


def decontaminated(
    spark: SparkSession, docs: DataFrame, benchmark: DataFrame, *, text: str = "text", item_id: str = "item_id",
    item_text: str = "text", block_words: int = BLOCK_WORDS, keep_clean: bool = False,
) -> DataFrame:
    """Every row with n_words, n_hit, n_items, items_sha256 and contaminated; with ``keep_clean`` only the clean rows.

    ``items_sha256`` is of the found item ids, sorted as strings, comma-joined.
    """
    state = [T.StructField("_ranges", T.ArrayType(T.ArrayType(T.IntegerType()))), T.StructField("_items", T.ArrayType(T.StringType()))]
    result = [
        T.StructField("n_words", T.LongType()), T.StructField("n_hit", T.LongType()), T.StructField("n_items", T.LongType()),
        T.StructField("items_sha256", T.StringType()), T.StructField("contaminated", T.BooleanType()),
    ]

    def passed(df: DataFrame, items: list, first: bool, last: bool) -> DataFrame:
        shared = spark.sparkContext.broadcast(Index(items))

        def work():
            words, index = Words(), shared.value

            def on_batch(batch: pa.RecordBatch) -> tuple:
                rows = []
                before = iter([(None, None)] * batch.num_rows if first else zip(*(common.column(batch, f.name) for f in state)))
                for flat, starts, ends in words.together(common.column(batch, text)):
                    # texts without words begin where they end
                    at = np.searchsorted(starts, index.suspects(flat), side="right") - 1
                    suspect = set(at.tolist())
                    for i, (a, b) in enumerate(zip(starts.tolist(), ends.tolist())):
                        ranges, found = next(before)
                        if i in suspect:
                            new, more = index.hits(flat[a:b])
                            ranges, found = [*(ranges or ()), *new], {*(found or ()), *more}
                        ranges, found = united([tuple(r) for r in ranges or ()]), sorted(found or ())
                        if not last:
                            rows.append((ranges, found))
                            continue
                        n_hit = sum(y - x for x, y in ranges)
                        digest = hashlib.sha256(",".join(found).encode()).hexdigest() if found else NO_ITEMS
                        rows.append((b - a, n_hit, len(found), digest, n_hit > 0 and ONE_IN * n_hit >= b - a))
                columns = [list(c) for c in zip(*rows)]
                return columns, [not r[-1] for r in rows] if last and keep_clean else None

            return on_batch

        return common.appended(df, result if last else state, work)

    out, waiting, first = docs, None, True
    for block in blocks(benchmark, item_id, item_text, block_words):
        if waiting is not None:
            out, first = common.written(spark, passed(out, waiting, first, False), "hits"), False
        waiting = block
    return passed(out, waiting, first, True).drop(*(f.name for f in state))
