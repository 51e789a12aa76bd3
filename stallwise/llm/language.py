"""Language identification: unigram pieces of a fixed public vocabulary, all segmentations of a word summed.

A word's probability in a language is the sum, over all ways to cut it into pieces, of the product of the pieces'
probabilities: the forward algorithm over the word's characters. The probabilities are learned by expectation
maximisation (forward and backward sums over the words of labelled texts); the vocabulary is only read. Any single
character may also be a piece of its own with probability ``LONE``, so every word has a segmentation.

A text is scored by the sum over its words; the score of the predicted language is its posterior under equal priors.

Words are runs of letters in lower case; words of more than ``LONGEST`` characters are read in parts of that length.
Defined results: texts that are null or hold no letter get ``und`` and score 0, and so does every text if no labelled text was
given; ties go to the first language in code point order. Labelled texts: all, or about ``per_language`` of each language, chosen by
a hash of the id. Repeated rows are scored alike.
"""

from __future__ import annotations

import re
import uuid
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from stallwise.llm import common, vocabularies

WORDS = re.compile(r"[^\W\d_]+")
UNKNOWN = "und"
PER_LANGUAGE = 4_000
ROUNDS = 3
LONGEST = 32
LONE = 1e-7
SMOOTHING = 0.1


def words_of(text: str | None) -> list[str]:
    return [w if len(w) <= LONGEST else w[i : i + LONGEST] for w in WORDS.findall((text or "").lower()) for i in range(0, len(w), LONGEST)]


def openings_of(ids: dict[str, int]) -> frozenset[str]:
    return frozenset(p[:k] for p in ids for k in range(1, len(p) + 1))


class Lattice:
    """All pieces in a list of words, as arrays ordered by end, then word."""

    def __init__(self, words: list[str], ids: dict[str, int], openings: frozenset[str] | None = None) -> None:
        """``openings`` are the beginnings of pieces, worked out if they are not given."""
        word, start, end, piece = [], [], [], []
        find, openings = ids.get, openings_of(ids) if openings is None else openings
        for k, w in enumerate(words):
            marked = vocabularies.MARK + w
            n = len(marked)
            for i in range(n):
                # a lone character has the number after the last piece
                lone = True
                for j in range(i + 1, n + 1):
                    part = marked[i:j]
                    if part not in openings:
                        break
                    p = find(part)
                    if p is not None:
                        word.append(k), start.append(i), end.append(j), piece.append(p)
                        lone = lone and j > i + 1
                if lone:
                    word.append(k), start.append(i), end.append(i + 1), piece.append(len(ids))
        self.words = len(words)
        self.sizes = np.fromiter((len(w) + 1 for w in words), np.int64, len(words))
        order = np.lexsort((np.array(word), np.array(end)))
        self.word, self.start, self.end, self.piece = (np.array(a, dtype=np.int64)[order] for a in (word, start, end, piece))
        self.longest = int(self.sizes.max(initial=0))

    def _steps(self, by: np.ndarray) -> list[tuple[int, np.ndarray]]:
        cuts = np.searchsorted(by, np.arange(1, self.longest + 2))
        return [(j + 1, slice(cuts[j], cuts[j + 1])) for j in range(self.longest)]

    def forward(self, probabilities: np.ndarray) -> np.ndarray:
        """Sums over segmentations of each prefix: (words, characters + 1, languages)."""
        sums = np.zeros((self.words, self.longest + 1, probabilities.shape[1]))
        sums[:, 0] = 1.0
        for j, at in self._steps(self.end):
            word = self.word[at]
            if len(word):
                terms = sums[word, self.start[at]] * probabilities[self.piece[at]]
                first = np.flatnonzero(np.append(True, word[1:] != word[:-1]))
                sums[word[first], j] = np.add.reduceat(terms, first, axis=0)
        return sums

    def likelihood(self, probabilities: np.ndarray) -> np.ndarray:
        """Log probability of each word in each language."""
        sums = self.forward(probabilities)
        return np.log(np.maximum(sums[np.arange(self.words), self.sizes], 1e-300))

    def expected(self, probabilities: np.ndarray, weights: np.ndarray) -> np.ndarray:
        """Expected count of each piece in each language, words weighted by (words, languages)."""
        ahead = self.forward(probabilities)
        total = np.maximum(ahead[np.arange(self.words), self.sizes], 1e-300)
        behind = np.zeros_like(ahead)
        behind[np.arange(self.words), self.sizes] = 1.0
        order = np.lexsort((self.word, self.start))
        starts, words = self.start[order], self.word[order]
        cuts = np.searchsorted(starts, np.arange(self.longest + 1))
        for i in range(self.longest - 1, -1, -1):
            at = order[cuts[i] : cuts[i + 1]]
            if len(at):
                word = self.word[at]
                terms = behind[word, self.end[at]] * probabilities[self.piece[at]]
                first = np.flatnonzero(np.append(True, word[1:] != word[:-1]))
                behind[word[first], i] += np.add.reduceat(terms, first, axis=0)
        share = ahead[self.word, self.start] * probabilities[self.piece] * behind[self.word, self.end]
        share *= (weights / total)[self.word]
        return np.column_stack(
            [np.bincount(self.piece, weights=share[:, k], minlength=len(probabilities)) for k in range(probabilities.shape[1])]
        )


@dataclass(frozen=True)
class LanguageModel:
    languages: list[str]
    ids: dict[str, int]
    #: (pieces + 1, languages); the last row is that of a lone character
    probabilities: np.ndarray


BATCH = 20_000


def _normalised(counts: np.ndarray) -> np.ndarray:
    counts = counts[:-1] + SMOOTHING
    return np.vstack([counts / counts.sum(axis=0), np.full(counts.shape[1], LONE)])


def fit(
    spark: SparkSession, docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", lang: str = "lang",
    per_language: int = PER_LANGUAGE, rounds: int = ROUNDS, folder: str = vocabularies.FOLDER,
) -> LanguageModel:
    """Learn from the texts of ``docs`` (training rows only) whose language is known."""
    pieces = vocabularies.pieces(vocabularies.read(vocabularies.PIECES, folder))
    ids = {p: i for i, p in enumerate(pieces)}
    known = docs.where(F.col(lang).isNotNull() & F.col(text).isNotNull()).select(doc_id, text, lang)
    sizes = known.groupBy(lang).count().collect()  # one row for each language
    languages = sorted(r[lang] for r in sizes)
    if not languages:
        return LanguageModel([], ids, np.zeros((len(ids) + 1, 0)))
    number = {name: i for i, name in enumerate(languages)}
    shares = spark.createDataFrame(
        [(r[lang], number[r[lang]], int(min(1.0, per_language / r["count"]) * (1 << 30))) for r in sizes], "_lang string, _number int, _share long"
    )
    sample = known.join(F.broadcast(shares), F.col(lang) == F.col("_lang")).where(
        F.pmod(F.xxhash64(doc_id), F.lit(1 << 30)) < F.col("_share")
    )

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter[tuple[int, str]] = Counter()

        def rows() -> pa.RecordBatch:
            keys = list(counts)
            out = pa.RecordBatch.from_arrays(
                [pa.array([k[0] for k in keys], pa.int32()), pa.array([k[1] for k in keys], pa.string()), pa.array([counts[k] for k in keys], pa.int64())],
                names=["number", "word", "n"],
            )
            counts.clear()
            return out

        for batch in batches:
            for t, k in zip(common.column(batch, text), common.column(batch, "_number")):
                counts.update((k, w) for w in words_of(t))
            if len(counts) > common.CACHE_ENTRIES:
                yield rows()
        yield rows()

    words = common.summed_counts(
        common.arrow_mapped(sample.select(text, "_number"), count, common.schema("number int, word string, n bigint")), ["number", "word"]
    )
    words = common.written(spark, words.repartition(spark.sparkContext.defaultParallelism * 2, "word"), "language-words")
    size = (len(ids) + 1, len(languages))
    # before anything is known, longer pieces are likelier: all segmentations of a word start out alike
    length = np.array([len(p) for p in pieces], dtype=float)
    probabilities = np.vstack([np.repeat((np.exp(-2.0 * (14 - np.minimum(length, 12))))[:, None], size[1], axis=1), np.full(size[1], LONE)])
    probabilities[:-1] /= probabilities[:-1].sum(axis=0)
    for _ in range(rounds):
        shared = spark.sparkContext.broadcast((ids, probabilities))

        def expect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            ids, probabilities = shared.value
            openings = openings_of(ids)
            total = np.zeros(size)
            for batch in batches:
                for lo in range(0, batch.num_rows, BATCH):
                    part = batch.slice(lo, BATCH)
                    ws, first = np.unique(np.array(common.column(part, "word"), dtype=object), return_inverse=True)
                    weights = np.zeros((len(ws), size[1]))
                    np.add.at(weights, (first, common.column(part, "number")), common.column(part, "n"))
                    total += Lattice(ws.tolist(), ids, openings).expected(probabilities, weights)
            piece, number = np.nonzero(total)
            yield pa.RecordBatch.from_arrays(
                [pa.array(piece, pa.int32()), pa.array(number, pa.int32()), pa.array(total[piece, number])], names=["piece", "number", "n"]
            )

        rows = common.summed_counts(
            common.arrow_mapped(words, expect, common.schema("piece int, number int, n double")), ["piece", "number"]
        ).toPandas()  # a row for each piece and language at most
        counts = np.zeros(size)
        counts[rows["piece"], rows["number"]] = rows["n"]
        probabilities = _normalised(counts)
        shared.unpersist()
    return LanguageModel(languages, ids, probabilities)


class Scorer:
    """Log probabilities of words, remembered until there are too many."""

    def __init__(self, model: LanguageModel) -> None:
        self.model = model
        self.openings = openings_of(model.ids)
        self.rows: dict[str, int] = {}
        self.table = np.zeros((1024, len(model.languages)))

    def _add(self, new: list[str]) -> None:
        for lo in range(0, len(new), BATCH):
            part = new[lo : lo + BATCH]
            start = len(self.rows)
            while start + len(part) > len(self.table):
                self.table = np.concatenate([self.table, np.zeros_like(self.table)])
            self.table[start : start + len(part)] = Lattice(part, self.model.ids, self.openings).likelihood(self.model.probabilities)
            self.rows.update(zip(part, range(start, start + len(part))))

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        """Language and score of each text; the words of some thousand texts are looked up together."""
        names, scores = [], []
        for lo in range(0, len(texts), 500):
            words = [words_of(t) for t in texts[lo : lo + 500]]
            if len(self.rows) > common.CACHE_ENTRIES:
                self.rows.clear()
            self._add([w for w in dict.fromkeys(w for ws in words for w in ws) if w not in self.rows])
            for ws in words:
                if not ws or not self.model.languages:
                    names.append(UNKNOWN), scores.append(0.0)
                    continue
                total = self.table[np.fromiter(map(self.rows.__getitem__, ws), np.int64, len(ws))].sum(axis=0)
                best = int(total.argmax())
                names.append(self.model.languages[best])
                scores.append(1.0 / float(np.exp(np.maximum(total - total[best], -700.0)).sum()))
        return names, scores


def identify(
    spark: SparkSession, docs: DataFrame, model: LanguageModel, *, text: str = "text", lang_as: str = "lang_pred", score_as: str = "score"
) -> DataFrame:
    """Every row with its predicted language and the score of that."""
    shared, key = spark.sparkContext.broadcast(model), f"language {uuid.uuid4().hex}"

    def work():
        scorer = common.per_worker(key, lambda: Scorer(shared.value))
        return lambda batch: (scorer.predict(common.column(batch, text)), None)

    return common.appended(docs, [T.StructField(lang_as, T.StringType()), T.StructField(score_as, T.DoubleType())], work, keeps=True)
