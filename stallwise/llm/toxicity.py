"""Toxicity: noisy-channel restoration of disguised words, then evidence from hashed words and word beginnings.

A disguised word is a path through a lattice. Each character offers letters it may stand for (leetspeak), a run of one
character may stand for one or two of it, and separators may stand for nothing; every reading has a channel cost, and a
character trigram model learned from the corpus chooses the path (Viterbi). The readings join the plain words of the text.

Evidence of a word is the lower confidence bound of its log odds in toxic against other labelled texts, the best of the word
and its beginnings. Four sums of it per document go into a logistic regression that is fitted on evidence from the other
half of the labelled rows.

Defined results: a null text is an empty one; an empty text gets the score that goes with no evidence; labels with a null
label or id are left out, several labels of one id count as their maximum; without labels of both kinds every score is the
share of toxic labels (0 without labels). Repeated rows are scored alike, one by one. Tokens and spaced runs of any length are decoded
whole; where they have separators a second reading lets these end words too.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import groupby, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from stallwise.llm import common

# What a character of leetspeak may stand for.
LEET = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "gb", "7": "tl", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "il", "|": "il", "+": "t", "€": "e", "£": "l", "¡": "i", "(": "c",
}
SEPARATORS = ".-_*~'/\\·•,:;="
LEET_COST, DROP_COST, JOIN_COST, SINGLE_COST = 0.7, 3.0, 0.2, 1.0
BREAK = " "
#: Buckets of hashed character trigrams, and of hashed words and beginnings: the sizes of what is sent to every task.
CHAR_BUCKETS, FEATURE_BUCKETS = 1 << 18, 1 << 20
PREFIXES = (3, 4, 5, 6, 7)
START = zlib.crc32(b"^")
#: Labelled training rows that the classifier is fitted on, at most.
MAX_LABELLED = 20_000
CUT = 0.7
CAUTION = 2.5

WORDS = re.compile(r"[^\W\d_]+")
#: One-character tokens in a row, with any white space between them: a word that was spaced out. Brackets, quotes and marks of the
#: sentence may stand around it.
SPACED = re.compile(r"(?<![^\s(\[{\"'«„“])(?:[^\s|]\s+){2,}[^\s|](?![^\s)\]}.,;:!?\"'»”…])")
TAIL = re.compile(r"(?:([^\w\s])\1{2,}|[.,;:!?…\"'\)\]])+$")
DOUBLE = re.compile(r"(.)\1")


def _bucket(text: str, size: int) -> int:
    return zlib.crc32(text.encode("utf-8", "surrogatepass")) & (size - 1)


@dataclass(frozen=True)
class CharModel:
    """Hashed trigram and bigram counts of the letters of words, ``^`` before and ``$`` after a word."""

    trigrams: np.ndarray
    bigrams: np.ndarray
    #: Costs by trigram, remembered.
    known: dict[str, float] = field(default_factory=dict, compare=False, repr=False)

    def cost(self, a: str, b: str, c: str) -> float:
        return self.cost_of(a + b + c)

    def cost_of(self, gram: str) -> float:
        """Of the last of three letters, after the first two."""
        found = self.known.get(gram)
        if found is None:
            if len(self.known) > common.CACHE_ENTRIES:
                self.known.clear()
            three, two = self.trigrams[_bucket(gram, CHAR_BUCKETS)], self.bigrams[_bucket(gram[:2], CHAR_BUCKETS)]
            found = self.known[gram] = math.log(two + 15.0) - math.log(three + 0.5)
        return found


def parted(ch: str) -> bool:
    return ch in SEPARATORS or ch.isspace()


def lattice(chunk: str, breaks: bool = False) -> list[list[tuple[str, float]]]:
    """Slots of (letters, channel cost) readings; the letters of a reading may be none, with ``breaks`` a separator may end a word."""
    slots: list[list[tuple[str, float]]] = []
    plain: list[str] = []  # letters that stand for themselves go into one slot
    for ch, run in groupby(chunk):
        n = len(list(run))
        if n == 1 and ch.isalpha():
            plain.append(ch)
            continue
        if plain:
            slots.append([("".join(plain), 0.0)])
            plain.clear()
        if ch.isalpha():
            readings = [(ch, SINGLE_COST), (ch * 2, SINGLE_COST * (n > 2))]
        elif ch in LEET:
            base = LEET_COST + SINGLE_COST * (n > 1)
            readings = [(c, base) for c in LEET[ch]] + [("", DROP_COST)]
            if n > 1:
                readings += [(c * 2, LEET_COST * 2) for c in LEET[ch]]
        else:
            readings = [("", JOIN_COST if parted(ch) else DROP_COST)]
            if breaks and parted(ch):
                readings.append((BREAK, JOIN_COST))
        slots.append(readings)
    if plain:
        slots.append([("".join(plain), 0.0)])
    return slots


def viterbi(chunk: str, model: CharModel, breaks: bool = False) -> str:
    """The likeliest word behind a disguised chunk, with ``breaks`` the likeliest words with a blank between them."""
    # the letters of a path are a chain of pairs, so that a step costs the same at every length
    paths: dict[str, tuple[float, tuple | None]] = {"^^": (0.0, None)}
    cost_of = model.cost_of
    for readings in lattice(chunk, breaks):
        best: dict[str, tuple[float, tuple | None]] = {}
        for state, (cost, path) in paths.items():
            for letters, channel in readings:
                now, total = state, cost + channel
                if letters == BREAK:
                    if now == "^^":
                        continue
                    total += cost_of(now + "$")
                    now = "^^"
                else:
                    for c in letters:
                        gram = now + c
                        total += cost_of(gram)
                        now = gram[1:]
                if now not in best or total < best[now][0]:
                    best[now] = total, (path, letters) if letters else path
        paths = best
    end = min((cost + cost_of(s + "$"), s) for s, (cost, _) in paths.items())[1]
    path, letters = paths[end][1], []
    while path:
        letters.append(path[1])
        path = path[0]
    return "".join(reversed(letters))


def readings_of(chunk: str, model: CharModel) -> list[str]:
    """The word behind a chunk, and the words if its separators may end some."""
    words = [viterbi(chunk, model)]
    if any(map(parted, chunk)):
        words += viterbi(chunk, model, breaks=True).split(BREAK)
    return words


def restored(token: str, model: CharModel) -> tuple[str, ...]:
    """The words of a lower-case token: its plain words, and what it may disguise."""
    if token.isalpha() and not DOUBLE.search(token):
        return (token,)
    core = TAIL.sub("", token)
    if core.isalpha() and not DOUBLE.search(core):
        return (core,)
    if not any(ch.isalpha() or ch in LEET for ch in core):
        return ()
    return tuple(dict.fromkeys([*WORDS.findall(core), *(w for w in readings_of(core, model) if len(w) > 1)]))


def spaced(lowered: str, model: CharModel) -> set[str]:
    """Words behind the runs of one-character tokens of a text."""
    return {w for m in SPACED.finditer(lowered) for w in readings_of(m.group(), model) if len(w) > 2}


def words_of(text: str | None, model: CharModel, cache: dict[str, tuple[str, ...]]) -> set[str]:
    """Distinct plain and restored words of a whole text."""
    lowered = (text or "").lower()
    out: set[str] = set()
    if len(cache) > common.CACHE_ENTRIES:
        cache.clear()
    for token in set(lowered.split()):
        words = cache.get(token)
        if words is None:
            words = cache[token] = restored(token, model)
        out.update(words)
    return out | spaced(lowered, model)


def features(word: str) -> list[int]:
    """Buckets of a word and of its beginnings."""
    data, size = word.encode("utf-8", "surrogatepass"), FEATURE_BUCKETS - 1
    found = [zlib.crc32(data) & size]
    # a longer beginning goes on from the checksum of the shorter one
    sum_, done = START, 0
    for k in PREFIXES:
        if len(word) < k:
            break
        end = k if len(data) == len(word) else len(word[:k].encode("utf-8", "surrogatepass"))
        sum_, done = zlib.crc32(data[done:end], sum_), end
        found.append(sum_ & size)
    return found


def char_model(docs: DataFrame, text: str = "text") -> CharModel:
    """Character trigrams of every word of every given text, counted by bucket."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words: Counter[str] = Counter()
        grams = np.zeros((2, CHAR_BUCKETS), dtype=np.int64)

        def fold() -> None:
            three: Counter[str] = Counter()
            for w, n in words.items():
                if w.isalpha():
                    s = f"^^{w}$"
                    for i in range(len(s) - 2):
                        three[s[i : i + 3]] += n
            words.clear()
            for g, n in three.items():
                grams[0, _bucket(g, CHAR_BUCKETS)] += n
                grams[1, _bucket(g[:2], CHAR_BUCKETS)] += n

        for batch in batches:
            for t in common.column(batch, text):
                words.update((t or "").lower().split())
                if len(words) > common.CACHE_ENTRIES:
                    fold()
        fold()
        kind, bucket = np.nonzero(grams)
        yield pa.RecordBatch.from_arrays(
            [pa.array(kind, pa.int32()), pa.array(bucket, pa.int32()), pa.array(grams[kind, bucket], pa.int64())],
            names=["kind", "bucket", "n"],
        )

    counts = common.summed_counts(
        common.arrow_mapped(docs.select(text), count, common.schema("kind int, bucket int, n bigint")), ["kind", "bucket"]
    ).toPandas()
    grams = np.zeros((2, CHAR_BUCKETS))
    grams[counts["kind"], counts["bucket"]] = counts["n"]
    return CharModel(grams[0], grams[1])


@dataclass(frozen=True)
class Evidence:
    """Weight of each bucket: how surely it speaks for a toxic text, 0 if it does not."""

    weights: np.ndarray
    #: The same without the zeros, made when first asked for.
    speaking: dict[int, float] = field(default_factory=dict, compare=False, repr=False)

    def of(self, word: str) -> float:
        """The best weight among ``features`` of the word."""
        speaking = self.speaking
        if not speaking:
            at = np.flatnonzero(self.weights)
            speaking.update(zip(at.tolist(), self.weights[at].tolist()))
            speaking[-1] = 0.0
        if not word.isascii():
            return max(map(speaking.get, features(word), repeat(0.0)))
        # nearly all words come here: one pass without a list
        data, size, get = word.encode(), FEATURE_BUCKETS - 1, speaking.get
        best, sum_, done, n = get(zlib.crc32(data) & size, 0.0), START, 0, len(data)
        for k in PREFIXES:
            if n < k:
                break
            sum_, done = zlib.crc32(data[done:k], sum_), k
            weight = get(sum_ & size)
            if weight is not None and weight > best:
                best = weight
        return best


@dataclass(frozen=True)
class ToxicityModel:
    chars: CharModel
    evidence: Evidence
    coefficients: np.ndarray

    def score(self, sums: np.ndarray) -> np.ndarray:
        return 1.0 / (1.0 + np.exp(-np.clip(self.coefficients[0] + sums @ self.coefficients[1:], -30, 30)))


def nothing() -> Evidence:
    return Evidence(np.zeros(FEATURE_BUCKETS, dtype=np.float32))


def evidence(counted: DataFrame, size: np.ndarray, halves: tuple[int, ...]) -> Evidence:
    """Lower confidence bound of the log odds of each bucket, from document counts by half and label."""
    n_other, n_toxic = size[list(halves)].sum(axis=0).tolist()
    seen = counted.where((F.col("bucket") >= 0) & F.col("half").isin(*halves))
    toxic, other = (F.sum(F.when(F.col("label") == y, F.col("n")).otherwise(0)) + 0.5 for y in (1, 0))
    odds = F.log(F.col("t") / F.lit(n_toxic + 1.0)) - F.log(F.col("o") / F.lit(n_other + 1.0))
    spread = F.sqrt(1 / F.col("t") + 1 / F.col("o"))
    weights = seen.groupBy("bucket").agg(toxic.alias("t"), other.alias("o")).select(
        "bucket", (odds - CAUTION * spread).alias("weight")
    )
    # one row for each bucket at most
    return Evidence(common.to_dense(weights.where("weight > 0"), "bucket", "weight", FEATURE_BUCKETS).astype(np.float32))


class Scorer:
    """The four sums of a text, with caches that live as long as a task."""

    def __init__(self, chars: CharModel, weights: Evidence) -> None:
        self.chars, self.weights = chars, weights
        #: Tokens looked at, and those of them that speak for a toxic text, with the words behind them.
        self.known: set[str] = set()
        self.speaks: set[str] = set()
        self.behind: dict[str, dict[str, float]] = {}

    def _look_at(self, token: str) -> None:
        of = self.weights.of
        for word in restored(token, self.chars):
            weight = of(word)
            if weight > 0:
                self.speaks.add(token)
                self.behind.setdefault(token, {})[word] = weight

    def sums(self, text: str | None) -> list[float]:
        lowered = (text or "").lower()
        if len(self.known) > common.CACHE_ENTRIES:
            for kept in (self.known, self.speaks, self.behind):
                kept.clear()
        found: dict[str, float] = {}
        tokens = set(lowered.split())
        new = tokens - self.known
        for token in new:
            self._look_at(token)
        self.known |= new
        for token in tokens & self.speaks:
            found.update(self.behind[token])
        found.update((w, e) for w in spaced(lowered, self.chars) if (e := self.weights.of(w)) > 0)
        top = sorted(found.values(), reverse=True)
        total = sum(top)
        return [math.log1p(total), sum(top[:1]), sum(top[1:2]), total / math.sqrt(len(tokens) + 1.0)]


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, steps: int = 50) -> np.ndarray:
    """Logistic regression by Newton's method, the intercept first."""
    x = np.column_stack([np.ones(len(x)), x])
    w = np.zeros(x.shape[1])
    pull = np.full(len(w), ridge)
    pull[0] = 1e-3
    for _ in range(steps):
        p = 1.0 / (1.0 + np.exp(-np.clip(x @ w, -30, 30)))
        slope = x.T @ (p - y) + pull * w
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(pull), slope)
        w -= np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    return w


def fit(
    spark: SparkSession, docs: DataFrame, labels: DataFrame, *, doc_id: str = "doc_id", text: str = "text",
    label: str = "toxic", max_labelled: int = MAX_LABELLED,
) -> ToxicityModel:
    """Learn from ``docs`` (training rows only) and ``labels`` (doc id, label 0 or 1).

    The character model counts all of ``docs``. The classifier takes all labelled rows, or if there are more than
    ``max_labelled``, about as many of them, chosen by a hash of the id.
    """
    known = (
        labels.where(F.col(doc_id).isNotNull() & F.col(label).isNotNull())
        .groupBy(doc_id).agg(F.max((F.col(label) > 0).cast("int")).alias("_label"))
    )
    ids = docs.select(doc_id).distinct()
    labelled = known.join(ids, doc_id, "left_semi")
    n = labelled.count()
    if n > max_labelled:
        labelled = labelled.where(common.hash_fraction(F.col(doc_id), 0.97 * max_labelled / n))
    chars = char_model(docs, text)
    chosen = labelled.toPandas()
    # at most max_labelled ids, so the broadcast is bounded
    chosen = F.broadcast(spark.createDataFrame(chosen, labelled.schema))
    sample = common.written(
        spark, docs.select(doc_id, text).join(chosen, doc_id).withColumn("_half", F.pmod(F.xxhash64(doc_id, F.lit(7)), F.lit(2))),
        "toxicity-sample",
    )
    shared = spark.sparkContext.broadcast(chars)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache: dict[str, tuple[str, ...]] = {}
        # the last bucket counts the texts
        counts = np.zeros((2, 2, FEATURE_BUCKETS + 1), dtype=np.int32)
        for batch in batches:
            for t, y, half in zip(*(common.column(batch, c) for c in (text, "_label", "_half"))):
                found = {f for w in words_of(t, shared.value, cache) for f in features(w)}
                counts[half, y, [*found, FEATURE_BUCKETS]] += 1
        half, label, bucket = np.nonzero(counts)
        n = counts[half, label, bucket]
        bucket[bucket == FEATURE_BUCKETS] = -1
        yield pa.RecordBatch.from_arrays(
            [pa.array(x, pa.int32()) for x in (half, label, bucket)] + [pa.array(n, pa.int64())],
            names=["half", "label", "bucket", "n"],
        )

    counted = common.summed_counts(
        common.arrow_mapped(sample, count, common.schema("half int, label int, bucket int, n bigint")), ["half", "label", "bucket"]
    )
    counted = common.written(spark, counted, "toxicity-counts")
    size = np.zeros((2, 2))
    for r in counted.where("bucket < 0").collect():  # one row for each half and label
        size[r["half"], r["label"]] = r["n"]
    n_toxic, n_all = size[:, 1].sum(), size.sum()
    if not n_toxic or n_toxic == n_all:
        p = min(max(n_toxic / n_all, 1e-9), 1 - 1e-9) if n_all else 1e-9
        return ToxicityModel(chars, nothing(), np.array([math.log(p / (1 - p)), 0, 0, 0, 0]))
    everything = evidence(counted, size, (0, 1))
    # evidence for one half of the sample comes from the other, as it will for new documents
    other_half = spark.sparkContext.broadcast(
        [evidence(counted, size, (1 - half,)) for half in (0, 1)]
    )

    def work():
        scorers = [Scorer(shared.value, e) for e in other_half.value]

        def on_batch(batch: pa.RecordBatch) -> tuple:
            pairs = zip(common.column(batch, text), common.column(batch, "_half"))
            return [[scorers[half].sums(t) for t, half in pairs]], None

        return on_batch

    fitted = common.appended(
        sample, [T.StructField("_sums", T.ArrayType(T.DoubleType()))], work
    ).select("_label", "_sums").toPandas()
    x, y = np.array(fitted["_sums"].tolist()), fitted["_label"].to_numpy(dtype=float)
    other_half.unpersist()
    return ToxicityModel(chars, everything, _logistic(x, y))


def score(
    spark: SparkSession, docs: DataFrame, model: ToxicityModel, *, text: str = "text", cut: float = CUT,
    score_as: str = "score", predicted_as: str = "predicted", keep_clean: bool = False,
) -> DataFrame:
    """Every row with its score (0 to 1) and prediction; with ``keep_clean`` only rows predicted 0."""
    shared = spark.sparkContext.broadcast(model)

    def work():
        scorer = Scorer(shared.value.chars, shared.value.evidence)

        def on_batch(batch: pa.RecordBatch) -> tuple:
            scores = shared.value.score(np.array([scorer.sums(t) for t in common.column(batch, text)]))
            toxic = scores >= cut
            return [scores, toxic.astype(np.int32)], ~toxic if keep_clean else None

        return on_batch

    return common.appended(
        docs, [T.StructField(score_as, T.DoubleType()), T.StructField(predicted_as, T.IntegerType())], work
    )
