"""Quality classifier: ordinal regression with cumulative links on graded ratings.

``P(grade <= k) = logistic(threshold_k - x . w)``: one weight per hashed feature, shared by all grades, and ordered
thresholds. Features of a whole text are its words, the shapes of its tokens (letters, digits and signs by kind), pairs of shapes, and
binned statistics (length, repeated lines, repeated words); tf is damped by its logarithm and each family has unit length.

From the fitted distribution come the expected grade and the tail probability of at least the wanted grade, by which documents
are selected.

The fit takes all labelled rows, or if there are more than ``max_labelled`` about as many of them, chosen by a hash of the id; the
driver holds their features, which ``max_labelled`` and ``BUCKETS`` bound. Defined results: a null text is an empty one; labels with a null id or
grade are left out, several grades of one id count as their greatest; with one grade only that grade is expected, without
labels results are null and nothing is selected. Repeated rows are graded alike.
"""

from __future__ import annotations

import math
import re
import uuid
import zlib
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from stallwise.llm import common

#: Hashed features: the first half are words, the second half shapes and statistics.
BUCKETS = 1 << 13
MAX_LABELLED = 8_000
ROUNDS, RATE, RIDGE = 150, 0.1, 1e-4
CUT = 0.5
_KINDS = ((re.compile(r"[a-zß-öø-ÿ]+"), "a"), (re.compile(r"[A-ZÀ-ÖØ-Þ]+"), "A"), (re.compile(r"\d+"), "0"), (re.compile(r"(\W)\1+"), r"\1+"))


def _hash(text: str) -> int:
    return zlib.crc32(text.encode("utf-8", "surrogatepass")) % (BUCKETS // 2)


def shape(token: str) -> str:
    """Kinds of characters in a token, runs as one."""
    for pattern, by in _KINDS:
        token = pattern.sub(by, token)
    return token


class Features:
    """Hashed features of texts; what tokens hash to is remembered."""

    def __init__(self) -> None:
        self.known: dict[str, tuple[int, str]] = {}
        self.signs: dict[tuple[str, ...], int] = {}

    def _sign(self, *shapes: str) -> int:
        """Bucket of a shape, or of two that follow one another."""
        found = self.signs.get(shapes)
        if found is None:
            if len(self.signs) > common.CACHE_ENTRIES:
                self.signs.clear()
            found = self.signs[shapes] = BUCKETS // 2 + _hash(" ".join(("s" if len(shapes) == 1 else "p", *shapes)))
        return found

    def _token(self, token: str) -> tuple[int, str]:
        if len(self.known) > common.CACHE_ENTRIES:
            self.known.clear()
        found = self.known.get(token)
        if found is None:
            found = self.known[token] = (_hash(token.lower()), shape(token))
        return found

    def of(self, text: str | None) -> tuple[np.ndarray, np.ndarray]:
        """(buckets, values) of a text, buckets ascending."""
        text = text or ""
        tokens = text.split()
        pairs = [self._token(t) for t in tokens]
        words = Counter(w for w, _ in pairs)
        shapes = [s for _, s in pairs]
        lines = [line for line in text.split("\n") if line.strip()]
        repeats = 1 - len(set(lines)) / max(1, len(lines))
        kinds = len(words) / max(1, len(tokens))
        marks = (f"n {min(14, len(tokens).bit_length())}", f"l {round(repeats * 10)}", f"k {round(kinds * 10)}")
        signs: Counter[int] = Counter()
        for s, n in Counter(shapes).items():
            signs[self._sign(s)] += n
        for (a, b), n in Counter(zip(shapes, shapes[1:])).items():
            signs[self._sign(a, b)] += n
        families = [words, signs, Counter(BUCKETS // 2 + _hash(m) for m in marks)]
        total: Counter[int] = Counter()
        for family in families:
            damped = {k: 1.0 + math.log(n) for k, n in family.items()}
            length = math.sqrt(sum(v * v for v in damped.values())) or 1.0
            for k, v in damped.items():
                total[k] += v / length
        keys = np.array(sorted(total), dtype=np.int32)
        return keys, np.array([total[k] for k in keys.tolist()], dtype=np.float32)


@dataclass(frozen=True)
class OrdinalModel:
    grades: list[int]
    weights: np.ndarray
    thresholds: np.ndarray

    def distribution(self, scores: np.ndarray) -> np.ndarray:
        """Probability of each grade, by rows."""
        below = _logistic(self.thresholds[None, :] - scores[:, None])
        below = np.column_stack([np.zeros(len(scores)), below, np.ones(len(scores))])
        return np.diff(below, axis=1)


def _logistic(x: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(x, -30, 30)))


def _ordered(raw: np.ndarray) -> np.ndarray:
    """Thresholds that rise: the first as it is, the others by positive steps."""
    return np.cumsum(np.concatenate([raw[:1], np.exp(raw[1:])]))


def regress(
    rows: list[tuple[np.ndarray, np.ndarray]], grades: np.ndarray, n_grades: int, *, rounds: int = ROUNDS, size: int = BUCKETS
) -> tuple[np.ndarray, np.ndarray]:
    """(weights, thresholds) for grades 0 .. n_grades - 1 of sparse rows, by Adam on the whole sample."""
    lengths = np.array([len(k) for k, _ in rows])
    row = np.repeat(np.arange(len(rows)), lengths)
    keys, values = np.concatenate([k for k, _ in rows]), np.concatenate([v for _, v in rows]).astype(float)
    share = np.cumsum(np.bincount(grades, minlength=n_grades))[:-1] / len(grades)
    start = np.log(share / (1 - share))
    raw = np.concatenate([start[:1], np.log(np.maximum(np.diff(start), 1e-3))])
    p = np.concatenate([np.zeros(size), raw])
    m, v = np.zeros_like(p), np.zeros_like(p)
    at = np.arange(len(rows))
    for t in range(1, rounds + 1):
        w, thresholds = p[:size], _ordered(p[size:])
        scores = np.bincount(row, weights=values * w[keys], minlength=len(rows))
        cuts = np.concatenate([[-np.inf], thresholds, [np.inf]])
        hi, lo = cuts[grades + 1] - scores, cuts[grades] - scores
        f_hi, f_lo = _logistic(hi), _logistic(lo)
        f_hi[grades == n_grades - 1], f_lo[grades == 0] = 1.0, 0.0
        d_hi, d_lo = f_hi * (1 - f_hi), f_lo * (1 - f_lo)
        likely = np.maximum(f_hi - f_lo, 1e-9)
        by_score = (d_hi - d_lo) / likely / len(rows)
        slope_w = np.bincount(keys, weights=values * by_score[row], minlength=size) + RIDGE * w
        by_cut = np.zeros((len(rows), n_grades + 1))
        by_cut[at, grades + 1] -= d_hi / likely / len(rows)
        by_cut[at, grades] += d_lo / likely / len(rows)
        slope_cut = by_cut.sum(axis=0)[1:-1]
        # a step moves all thresholds from its own on
        later = np.cumsum(slope_cut[::-1])[::-1]
        slope_raw = np.concatenate([later[:1], later[1:] * np.exp(p[size + 1 :])])
        g = np.concatenate([slope_w, slope_raw])
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        p = p - RATE * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return p[:size], _ordered(p[size:])


def fit(
    spark: SparkSession, docs: DataFrame, labels: DataFrame, *, doc_id: str = "doc_id", text: str = "text", grade: str = "quality",
    max_labelled: int = MAX_LABELLED,
) -> OrdinalModel:
    """Learn from ``docs`` (training rows only) and ``labels`` (doc id, whole-numbered grade)."""
    known = labels.where(F.col(doc_id).isNotNull() & F.col(grade).isNotNull()).groupBy(doc_id).agg(
        F.max(F.col(grade).cast("int")).alias("_grade")
    ).join(docs.select(doc_id).distinct(), doc_id, "left_semi")
    n = known.count()
    if n > max_labelled:
        known = known.where(common.hash_fraction(F.col(doc_id), 0.97 * max_labelled / n))
    # at most max_labelled rows, so the broadcast is bounded
    chosen = F.broadcast(spark.createDataFrame(known.toPandas(), known.schema))
    fields = [T.StructField("_keys", T.ArrayType(T.IntegerType())), T.StructField("_values", T.ArrayType(T.FloatType()))]

    def work():
        features = Features()
        return lambda batch: ([list(c) for c in zip(*map(features.of, common.column(batch, text)))], None)

    rows = common.appended(docs.select(doc_id, text).join(chosen, doc_id), fields, work).select("_grade", "_keys", "_values").toPandas()
    grades = sorted(set(rows["_grade"].tolist()))
    if len(grades) < 2:
        return OrdinalModel(grades, np.zeros(BUCKETS), np.zeros(0))
    number = {g: i for i, g in enumerate(grades)}
    sparse = [(np.asarray(k, dtype=np.int64), np.asarray(v)) for k, v in zip(rows["_keys"], rows["_values"])]
    weights, thresholds = regress(sparse, rows["_grade"].map(number).to_numpy(), len(grades))
    return OrdinalModel(grades, weights, thresholds)


def grade(
    spark: SparkSession, docs: DataFrame, model: OrdinalModel, *, text: str = "text", at_least: int | None = None, cut: float = CUT
) -> DataFrame:
    """Every row with expected_grade, tail_probability (of ``at_least``, by default the highest grade) and kept."""
    fields = [
        T.StructField("expected_grade", T.DoubleType()), T.StructField("tail_probability", T.DoubleType()), T.StructField("kept", T.BooleanType())
    ]
    shared, key = spark.sparkContext.broadcast(model), f"quality {uuid.uuid4().hex}"

    def work():
        m, features = shared.value, common.per_worker(key, Features)
        wanted = (max(m.grades) if at_least is None else at_least) if m.grades else None
        tail = np.array([g >= wanted for g in m.grades], dtype=float)

        def on_batch(batch: pa.RecordBatch) -> tuple:
            if not m.grades:
                return [[None] * batch.num_rows, [None] * batch.num_rows, [False] * batch.num_rows], None
            scores = np.array([float(m.weights[k] @ v) for k, v in map(features.of, common.column(batch, text))])
            p = m.distribution(scores)
            tails = np.minimum(p @ tail, 1.0)
            return [p @ np.array(m.grades, dtype=float), tails, tails >= cut], None

        return on_batch

    return common.appended(docs, fields, work, keeps=True)
