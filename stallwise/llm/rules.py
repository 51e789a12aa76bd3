"""Quality rules: counts of words, symbols and repetition, and the fertility of public tokenisers.

Fertility is measured per text: characters per token by two public vocabularies, the share of tokens that a piece vocabulary
spells in bytes, and the entropy of the text's tokens in bits. Each is held against a band of its language (the ``lang`` column;
where that is null, the text's most frequent script): the median of all texts that pass the counts, and ``REACH`` times the spread
of its quartiles to either side. Bands come from all documents of the language. The quartiles of one with fewer than ``LEAST`` are
drawn to those of all texts in the document's script, in the proportion that it falls short, and those of a small script to
those of all texts, so that every document is held against a band and none depends on a group's size by a switch.
Tokenisers are only applied, word by word, never trained.

Defined results: null and empty texts have no words and fail the counts; measures without tokens are 0. Repeated rows are judged
alike, one by one. Texts are read whole.
"""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from stallwise.llm import common, vocabularies

SPACE = b" \t\n\x0b\x0c\r"
SYMBOLS = b"#*$%&|<>"
MIN_WORDS, MAX_REPEATED, GRAM = 50, 50, 3
REACH, LEAST = 6.0, 50
MEASURES = ("chars_per_piece", "chars_per_byte_token", "fallback_share", "entropy")
#: A band is at least this wide to either side, so that equal texts do not reject their neighbours.
FLOOR = {"chars_per_piece": 0.2, "chars_per_byte_token": 0.2, "fallback_share": 0.05, "entropy": 2.0}
LETTER = re.compile(r"[^\W\d_]")
# First code points of scripts.
SCRIPTS = (
    (0x0370, "greek"), (0x0400, "cyrillic"), (0x0530, "other"), (0x0590, "hebrew"), (0x0600, "arabic"), (0x0780, "other"),
    (0x0900, "indic"), (0x0E00, "thai"), (0x0E80, "other"), (0x1E00, "latin"), (0x1F00, "greek"), (0x2000, "other"),
    (0x3040, "kana"), (0x3100, "han"), (0xAC00, "hangul"), (0xD800, "other"),
)


def script(text: str) -> str:
    if text.isascii():
        return "latin" if LETTER.search(text) else "none"
    counts: Counter[str] = Counter()
    for ch, n in Counter(text).items():
        if LETTER.match(ch):
            name = "latin"
            for first, of in SCRIPTS:
                if ord(ch) >= first:
                    name = of
            counts[name] += n
    return max(sorted(counts), key=counts.__getitem__, default="none")


class WordTokens:
    """Numbers of words, and of each its characters and tokens; emptied between texts when it has grown."""

    def __init__(self, piece_model: bytes, ranks: bytes) -> None:
        self.pieces, self.bytes = vocabularies.PieceEncoder(piece_model), vocabularies.ByteEncoder(ranks)
        self.spelled = np.array(self.pieces.is_byte)
        self.clear()

    def clear(self) -> None:
        self.code: dict[bytes, int] = {}
        self.first = np.zeros(1024, dtype=np.int64)
        self.length = np.zeros(1024, dtype=np.int64)
        self.byte_tokens = np.zeros(1024, dtype=np.int64)
        self.ids = np.zeros(8192, dtype=np.int32)
        self.used = 0

    def codes(self, words: list[bytes]) -> np.ndarray:
        new = [w for w in dict.fromkeys(words) if w not in self.code]
        if new:
            self._add(new)
        return np.fromiter(map(self.code.__getitem__, words), np.int64, len(words))

    def _add(self, new: list[bytes]) -> None:
        texts = [w.decode("utf-8", "replace") for w in new]
        start = len(self.code)
        self.code.update(zip(new, range(start, start + len(new))))
        encoded = self.pieces.words(texts)
        sizes = np.fromiter(map(len, encoded), np.int64, len(new))
        flat = np.fromiter((i for e in encoded for i in e), np.int32, int(sizes.sum()))
        while start + len(new) > len(self.first):
            self.first, self.length, self.byte_tokens = (np.concatenate([a, np.zeros_like(a)]) for a in (self.first, self.length, self.byte_tokens))
        while self.used + len(flat) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
        at = slice(start, start + len(new))
        self.first[at] = self.used + np.cumsum(sizes) - sizes
        self.length[at] = sizes
        self.byte_tokens[at] = [self.bytes.count(t) for t in texts]
        self.ids[self.used : self.used + len(flat)] = flat
        self.used += len(flat)

    def tokens(self, codes: np.ndarray) -> np.ndarray:
        """Pieces of a text's words, in order."""
        sizes = self.length[codes]
        ends = np.cumsum(sizes)
        return self.ids[np.repeat(self.first[codes] - ends + sizes, sizes) + np.arange(int(sizes.sum()))]


def repeated_words(codes: np.ndarray, gram: int = GRAM) -> int:
    """Words that lie in a window found twice or more."""
    n = len(codes) - gram + 1
    if n < 2:
        return 0
    keys = codes
    for i in range(1, gram):
        # numbers of windows stay below the number of words, so the product is exact
        keys = np.unique(keys[:n] if i == gram - 1 else keys[: len(codes) - i], return_inverse=True)[1]
        keys = (keys.astype(np.int64) << 32) | codes[i : i + len(keys)]
    _, inverse, counts = np.unique(keys, return_inverse=True, return_counts=True)
    again = np.flatnonzero(counts[inverse] > 1)
    covered = np.zeros(len(codes), dtype=bool)
    for i in range(gram):
        covered[again + i] = True
    return int(covered.sum())


def repeated_lines(text: str) -> int:
    seen: set[str] = set()
    repeats = 0
    for line in text.split("\n"):
        if line in seen:
            repeats += 1
        elif line.strip(" \t\n\x0b\x0c\r"):
            seen.add(line)
    return repeats


def entropy(tokens: np.ndarray, size: int) -> float:
    """Bits per token of the text's own token frequencies."""
    if not len(tokens):
        return 0.0
    p = np.bincount(tokens, minlength=size)
    p = p[p > 0] / len(tokens)
    return float(-(p * np.log2(p)).sum())


def measured(spark: SparkSession, docs: DataFrame, *, text: str = "text", lang: str = "lang", folder: str = vocabularies.FOLDER) -> DataFrame:
    """Every row with its counts, ``base_failed``, the measures of fertility, the key of its band and its script."""
    counts = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    fields = [T.StructField(c, T.LongType()) for c in counts] + [T.StructField("base_failed", T.BooleanType())]
    fields += [T.StructField(m, T.DoubleType()) for m in MEASURES] + [T.StructField("_band", T.StringType()), T.StructField("_script", T.StringType())]
    shared = spark.sparkContext.broadcast((vocabularies.read(vocabularies.PIECES, folder), vocabularies.read(vocabularies.BYTES, folder)))

    def work():
        words = WordTokens(*shared.value)

        def row(t: str | None, language: str | None) -> tuple:
            t = t or ""
            raw = t.encode("utf-8", "surrogatepass")
            if len(words.code) > common.CACHE_ENTRIES:
                words.clear()
            codes = words.codes(raw.split())
            tokens = words.tokens(codes)
            n, chars = len(codes), len(t) - len(raw) + len(raw.translate(None, SPACE))
            again = repeated_words(codes)
            failed = n < MIN_WORDS or 100 * again > MAX_REPEATED * n
            bits, written = entropy(tokens, words.pieces.size), script(t)
            return (
                n, chars, len(raw) - len(raw.translate(None, SYMBOLS)), repeated_lines(t), again, failed,
                chars / max(1, len(tokens)), chars / max(1, int(words.byte_tokens[codes].sum())),
                float(words.spelled[tokens].mean()) if len(tokens) else 0.0, bits,
                f"lang:{language}" if language is not None else f"script:{written}", written,
            )

        def on_batch(batch: pa.RecordBatch) -> tuple:
            return [list(c) for c in zip(*map(row, common.column(batch, text), common.column(batch, lang)))], None

        return on_batch

    return common.appended(docs, fields, work)


def bands(rows: DataFrame, *, reach: float = REACH, least: int = LEAST) -> DataFrame:
    """(_band, _script, lowest and highest value of each measure) over the rows that pass the counts."""
    passed = rows.where(~F.col("base_failed"))

    def quartiles(name: str) -> list[Column]:
        of = [F.percentile_approx(m, [0.25, 0.5, 0.75], 1000).alias(f"{name}_{m}") for m in MEASURES]
        return [F.count("*").alias(f"{name}_n"), *of]

    def drawn(name: str, m: str, to: list[Column]) -> list[Column]:
        own = F.least(F.lit(1.0), F.col(f"{name}_n") / max(least, 1))
        return [F.col(f"{name}_{m}")[i] * own + to[i] * (1 - own) for i in range(3)]

    by = (
        passed.select("_band", "_script").distinct()
        .join(passed.groupBy("_band").agg(*quartiles("band")), "_band")
        .join(passed.groupBy("_script").agg(*quartiles("script")), "_script")
        .crossJoin(passed.agg(*quartiles("all")))  # one row
    )
    out = []
    for m in MEASURES:
        low, middle, high = drawn("band", m, drawn("script", m, [F.col(f"all_{m}")[i] for i in range(3)]))
        way = F.greatest((high - low) * reach, F.lit(FLOOR[m]))
        out += [(middle - way).alias(f"_low_{m}"), (middle + way).alias(f"_high_{m}")]
    return by.select("_band", "_script", *out)


def judged(
    spark: SparkSession, docs: DataFrame, *, text: str = "text", lang: str = "lang", folder: str = vocabularies.FOLDER,
    reach: float = REACH, least: int = LEAST,
) -> DataFrame:
    """Every row's other columns than its text, with counts, measures, ``base_failed`` and ``kept``."""
    rows = common.written(spark, measured(spark, docs, text=text, lang=lang, folder=folder).drop(text), "rules")
    limits = common.written(spark, bands(rows, reach=reach, least=least), "bands")
    inside = F.lit(True)
    for m in MEASURES:
        inside = inside & F.coalesce(F.col(m).between(F.col(f"_low_{m}"), F.col(f"_high_{m}")), F.lit(True))
    held = rows.join(limits, ["_band", "_script"], "left").withColumn("kept", ~F.col("base_failed") & inside)
    return held.drop(*limits.columns)
