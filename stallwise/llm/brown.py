"""Brown class-based bigrams: words belong to classes, a class follows a class, and a class emits a word.

Tokens are the words ``[^\\x20\\x09-\\x0D]+`` with A-Z lower-cased and one end per text. All training tokens are counted; the counts stay a
table in the shared folder. The first clustering has as units the ``FREQUENT`` most frequent words, one by one, the other words by the
hash of their last three bytes (``ENDINGS`` buckets), and the end. Exchange clustering moves units between classes while
that raises the likelihood of the unit bigrams, which were counted over all training texts. ``cluster`` goes on from there: one sweep moves
every other word of the training texts, however rare, to the class that its own bigrams are likeliest in. Transitions
and emissions are those of the classes after it. Only words without a training token keep the class of their ending.

``score`` is the log10 probability of a text's tokens: smoothed class transitions and smoothed emissions, where an
unseen word shares the half count its class keeps for it. ``base_score`` is that of smoothed unigrams.

Texts become blocks of about ``CHUNK_TOKENS`` tokens. A block's different words are dealt to buckets with the classes beside them, a bucket
places its words, and their classes and counts go back to the blocks. Models carry the most frequent words only (``fit``: ``known``); what is
sent or collected is bounded by these parameters, not by the corpus. There are 255 classes at most.

Defined results: a null text is an empty one and has one token, its end. Without training texts all words are unseen. Repeated rows
are counted and scored each by itself, null ids included (they count as training rows).
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_type

from stallwise.llm import common

FREQUENT, ENDINGS, CLASSES = 768, 256, 48
KNOWN = 50_000
SWEEPS = 10
HALF, TRANSITION = 0.5, 0.1
END = b""
CHUNK_TOKENS = 1 << 20
SLICE_TEXTS = 256


def ending(word: bytes) -> int:
    return zlib.crc32(word[-3:]) % ENDINGS


def ending_column(word: Column) -> Column:
    """The same of a binary column."""
    return (F.crc32(F.when(F.length(word) > 3, F.substring(word, -3, 3)).otherwise(word)) % ENDINGS).cast("int")


def split(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The words of all texts, one after the other, and how many each text has."""
    parted = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts, "")))
    words = parted.flatten()
    real = pc.greater(pc.binary_length(words), 0)
    owner = pc.list_parent_indices(parted).to_numpy()[real.to_numpy(zero_copy_only=False)]
    return words.filter(real).cast(pa.binary()), np.bincount(owner, minlength=len(texts))


def chunks(batches: Iterator[pa.RecordBatch], text: str) -> Iterator[tuple[pa.DictionaryArray, np.ndarray, pa.RecordBatch]]:
    """Words, words of each text and rows of texts that have about ``CHUNK_TOKENS`` tokens."""
    words, sizes, rows = [], [], []

    def chunk() -> tuple[pa.DictionaryArray, np.ndarray, pa.RecordBatch]:
        found = pa.concat_arrays(words).dictionary_encode(), np.concatenate(sizes), pa.concat_batches(rows)
        del words[:], sizes[:], rows[:]
        return found

    waiting = 0
    for batch in batches:
        for at in range(0, batch.num_rows, SLICE_TEXTS):
            piece = batch.slice(at, SLICE_TEXTS)
            index = piece.schema.get_field_index(text)
            found, n = split(piece.column(index))
            words.append(found)
            sizes.append(n)
            rows.append(piece.remove_column(index))
            waiting += len(found) + len(n)
            if waiting >= CHUNK_TOKENS:
                yield chunk()
                waiting = 0
    if words:
        yield chunk()


def with_ends(numbers: np.ndarray, sizes: np.ndarray, end: int) -> np.ndarray:
    """The numbers of all texts' words, the end after each text."""
    path = np.full(len(numbers) + len(sizes), end, np.int32)
    word = np.ones(len(path), bool)
    word[np.cumsum(sizes + 1) - 1] = False
    path[word] = numbers
    return path


def count_tokens(spark: SparkSession, docs: DataFrame, text: str = "text") -> DataFrame:
    """(word, n) over all tokens of all given texts; words as UTF-8 bytes, the end as no bytes."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ends = 0
        for words, sizes, _ in chunks(batches, text):
            ends += len(sizes)
            n = np.bincount(words.indices.to_numpy(), minlength=len(words.dictionary))
            yield pa.RecordBatch.from_arrays([words.dictionary, pa.array(n, pa.int64())], names=["word", "n"])
        yield pa.RecordBatch.from_arrays([pa.array([END], pa.binary()), pa.array([ends], pa.int64())], names=["word", "n"])

    found = common.arrow_mapped(docs.select(text), count, common.schema("word binary, n bigint"))
    return common.written(spark, common.summed_counts(found, ["word"]).where("n > 0"), "tokens")


class Codes(dict):
    """Word to number: known words have their rank, others ``known`` plus the bucket of their ending."""

    def __init__(self, known: list[bytes]) -> None:
        super().__init__(zip(known, range(len(known))))
        self.known = known

    def __missing__(self, word: bytes) -> int:
        value = self[word] = len(self.known) + ending(word)
        return value


def units_of(known: int, words: list[bytes]) -> np.ndarray:
    """Unit of each number of ``Codes`` in the first clustering: frequent words first, then the buckets of endings."""
    single = min(FREQUENT, known)
    own = np.arange(known)
    own[single:] = [single + ending(w) for w in words[single:]]
    return np.concatenate([own, single + np.arange(ENDINGS)]).astype(np.int64)


def ranks(words: pa.Array, known: pa.Array) -> np.ndarray:
    """The place of each word among the known ones, -1 for others."""
    return pc.fill_null(pc.index_in(words, value_set=known), -1).to_numpy()


def endings(words: pa.Array) -> np.ndarray:
    return np.fromiter(map(ending, words.to_pylist()), np.int64, len(words))


def count_bigrams(spark: SparkSession, docs: DataFrame, words: list[bytes], text: str = "text") -> np.ndarray:
    """Counts of unit bigrams over all given texts, the end before and after each."""
    single = min(FREQUENT, len(words))
    size = single + ENDINGS + 1
    shared = spark.sparkContext.broadcast(words[:single])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = pa.array(shared.value, pa.binary())
        total = np.zeros(size * size, dtype=np.int64)
        for words, sizes, _ in chunks(batches, text):
            units = ranks(words.dictionary, known).astype(np.int64)
            other = units < 0
            units[other] = single + endings(words.dictionary.filter(pa.array(other)))
            after = with_ends(units[words.indices.to_numpy()], sizes, size - 1).astype(np.int64)
            before = np.concatenate([[size - 1], after[:-1]])
            np.add(total, np.bincount(before * size + after, minlength=size * size), out=total)
        pair = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(pair, pa.int32()), pa.array(total[pair], pa.int64())], names=["pair", "n"])

    found = common.arrow_mapped(docs.select(text), count, common.schema("pair int, n bigint"))
    # a row for each pair of units at most
    return common.to_dense(common.summed_counts(found, ["pair"]), "pair", "n", size * size).reshape(size, size)


def _f(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1e-300))


def exchange(bigrams: np.ndarray, classes: int = CLASSES, sweeps: int = SWEEPS) -> np.ndarray:
    """Class of each unit. The last unit, the end, keeps the last class to itself."""
    size = len(bigrams)
    of = np.arange(size) % classes
    of[-1] = classes
    width = classes + 1
    table = np.zeros((width, width))
    np.add.at(table, (of[:, None], of[None, :]), bigrams)
    diagonal = np.arange(classes)
    for _ in range(sweeps):
        moved = False
        for u in range(size - 1):
            own = bigrams[u, u]
            before = np.bincount(of, weights=bigrams[:, u], minlength=width)
            after = np.bincount(of, weights=bigrams[u], minlength=width)
            if not before.any() and not after.any():
                continue
            a = of[u]
            before[a] -= own
            after[a] -= own
            table[:, a] -= before
            table[a] -= after
            table[a, a] -= own
            inner = table[:classes, :classes]
            gain = (_f(table[:, :classes] + before[:, None]) - _f(table[:, :classes])).sum(axis=0)
            gain += (_f(table[:classes] + after) - _f(table[:classes])).sum(axis=1)
            # the place where row and column meet takes both
            here = inner[diagonal, diagonal]
            lo, hi = before[:classes], after[:classes]
            gain += _f(here + lo + hi + own) - _f(here + lo) - _f(here + hi) + _f(here)
            rows = table.sum(axis=1)[:classes] + lo
            columns = table.sum(axis=0)[:classes] + hi
            gain -= _f(rows + after.sum() + own) - _f(rows)
            gain -= _f(columns + before.sum() + own) - _f(columns)
            best = int(gain.argmax())
            if gain[best] <= gain[a] + 1e-9:
                best = a
            moved |= best != a
            of[u] = best
            table[:, best] += before
            table[best] += after
            table[best, best] += own
        if not moved:
            break
    return of


def log_transitions(table: np.ndarray) -> np.ndarray:
    return np.log10((table + TRANSITION) / (table.sum(axis=1, keepdims=True) + TRANSITION * len(table)))


@dataclass(frozen=True)
class BrownModel:
    """What scoring needs: tables of bounded size, and the counts of all words as a table in the shared folder."""

    words: list[bytes]
    counts: np.ndarray
    n_tokens: int
    n_types: int
    end_count: int
    #: class of each number of ``Codes``; the end has the last class
    class_of: np.ndarray
    transitions: np.ndarray
    #: denominator of the emissions of each class
    emitted: np.ndarray


def fit(spark: SparkSession, docs: DataFrame, *, text: str = "text", known: int = KNOWN, classes: int = CLASSES) -> tuple[BrownModel, DataFrame]:
    """The model of the given texts, and the counts (word, n) of all their tokens."""
    counts = count_tokens(spark, docs, text)
    total = counts.agg(F.sum("n"), F.count("*"), F.sum(F.when(F.length("word") == 0, F.col("n")))).first()
    n_tokens, n_types, end_count = (int(x or 0) for x in total)
    real = counts.where(F.length("word") > 0)
    top = real.orderBy(F.desc("n"), "word").limit(known).collect()
    words, seen = [bytes(r["word"]) for r in top], np.array([r["n"] for r in top], dtype=float)
    bigrams = count_bigrams(spark, docs, words, text)
    units = units_of(len(words), words)
    unit_class = exchange(bigrams, classes)
    single = min(FREQUENT, len(words))
    # words and tokens of each class: the buckets of endings, less the words that are units of their own
    by_ending = np.zeros((2, ENDINGS))
    for r in real.groupBy(ending_column(F.col("word")).alias("e")).agg(F.count("*").alias("v"), F.sum("n").alias("n")).collect():
        by_ending[:, r["e"]] = r["v"], r["n"]
    for w, n in zip(words[:single], seen[:single]):
        by_ending[:, ending(w)] -= 1, n
    types = np.concatenate([np.ones(single), by_ending[0], [1.0 if end_count else 0.0]])
    sums = np.concatenate([seen[:single], by_ending[1], [float(end_count)]])
    width = classes + 1
    emitted = np.bincount(unit_class, weights=sums, minlength=width) + HALF * (np.bincount(unit_class, weights=types, minlength=width) + 1)
    table = np.zeros((width, width))
    np.add.at(table, (unit_class[:, None], unit_class[None, :]), bigrams)
    model = BrownModel(words, seen, n_tokens, n_types, end_count, unit_class[units], log_transitions(table), emitted)
    return model, counts


def ending_classes(model: BrownModel) -> np.ndarray:
    return model.class_of[len(model.words):]


def pack(*arrays: np.ndarray | bytes) -> bytes:
    """Bytes and arrays of numbers, compressed together; like bytes of the numbers stand together."""
    parts = [x if isinstance(x, bytes) else np.ascontiguousarray(x).view(np.uint8).reshape(-1, x.itemsize).T.tobytes() for x in arrays]
    return np.array([len(x) for x in parts], np.int64).tobytes() + pa.compress(b"".join(parts), codec="zstd", asbytes=True)


def unpack(data: bytes, *types: type) -> list:
    """What ``pack`` was given; ``bytes`` or the numbers' type for each."""
    sizes = np.frombuffer(data, np.int64, len(types))
    body = pa.decompress(data[sizes.nbytes :], int(sizes.sum()), codec="zstd", asbytes=True)
    found = []
    for end, size, of in zip(np.cumsum(sizes), sizes, types):
        part = body[end - size : end]
        found.append(part if of is bytes else np.frombuffer(part, np.uint8).reshape(np.dtype(of).itemsize, -1).T.copy().view(of).ravel())
    return found


def buckets_of(model: BrownModel) -> int:
    """How many buckets the words are dealt to: more with the texts, but not so many that a block's part holds few words."""
    blocks = model.n_tokens / CHUNK_TOKENS
    return max(8, int(min(2 * blocks, 32 * blocks**0.5)))


def dealt(words: list[bytes], buckets: int) -> np.ndarray:
    return np.fromiter((zlib.crc32(w) % buckets for w in words), np.int64, len(words))


def numbered(spark: SparkSession, docs: DataFrame, train: Column, model: BrownModel, text: str) -> DataFrame:
    """The texts in blocks: rows, sizes, the tokens' numbers, and the words that the model does not carry, in parts by bucket.

    Numbers are 0 for the end, then those of the model's words, then those of the block's other words in the order of their buckets.
    With each of these go two bytes for each occurrence in a training text: the classes of the tokens before and after it
    in the first clustering.
    """
    stays = [c for c in docs.columns if c != text]
    rows = F.struct(F.coalesce(train, F.lit(False)).alias("train"), *(F.col(c).alias(f"c{i}") for i, c in enumerate(stays)))
    given = docs.select(F.col(text).alias("text"), rows.alias("row"))
    fields = common.schema("block bigint, sizes binary, numbers binary, parts array<struct<bucket: int, start: int, packed: binary>>").fields
    schema = T.StructType([*fields, T.StructField("rows", T.ArrayType(given.schema["row"].dataType))])
    shared = spark.sparkContext.broadcast(model)

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        known, k, end, buckets = pa.array(m.words, pa.binary()), len(m.words), len(m.transitions) - 1, buckets_of(m)
        block = TaskContext.get().partitionId() << 32
        for words, sizes, kept in chunks(batches, "text"):
            numbers = ranks(words.dictionary, known) + 1
            other = np.flatnonzero(numbers == 0)
            bucket = dealt(words.dictionary.take(pa.array(other)).to_pylist(), buckets)
            order = np.argsort(bucket, kind="stable")
            other, bucket = other[order], bucket[order]
            rare = words.dictionary.take(pa.array(other)).to_pylist()
            numbers[other] = k + 1 + np.arange(len(rare))
            path = with_ends(numbers[words.indices.to_numpy()], sizes, 0)
            by_ending = np.fromiter(map(ending, rare), np.int64, len(rare))
            class_of = np.concatenate([[end], m.class_of[:k], ending_classes(m)[by_ending]]).astype(np.uint8)
            after = class_of[path]
            before = np.concatenate([after[-1:], after[:-1]])
            row = kept.column(0)
            seen = np.repeat(row.field("train").to_numpy(zero_copy_only=False), sizes + 1)
            at = np.flatnonzero((path > k) & seen)
            at = at[np.argsort(path[at], kind="stable")]
            times = np.bincount(path[at] - k - 1, minlength=len(rare)).astype(np.int32)
            ends = np.append(0, np.cumsum(times))
            left, right = before[at], after[(at + 1) % len(after)]
            parts, starts = [], np.flatnonzero(np.diff(bucket, prepend=-1))
            for lo, hi in zip(starts.tolist(), np.append(starts[1:], len(rare)).tolist()):
                met = slice(ends[lo], ends[hi])
                parts.append({"bucket": int(bucket[lo]), "start": lo, "packed": pack(b" ".join(rare[lo:hi]), times[lo:hi], left[met], right[met])})
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([block], pa.int64()), pa.array([pack(sizes.astype(np.int32))]), pa.array([pack(path)]),
                    pa.array([parts], to_arrow_type(schema["parts"].dataType)), pa.ListArray.from_arrays([0, len(row)], row),
                ],
                names=schema.names,
            )
            block += 1

    return common.written(spark, common.arrow_mapped(given, number, schema), "blocks")


def parts_of(spark: SparkSession, words: DataFrame, model: BrownModel) -> DataFrame:
    """(word, n, class) in parts by bucket like those of the blocks, with the number -1 for a block."""

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            word, n, class_of = (x.to_numpy(zero_copy_only=False) for x in batch.columns)
            bucket = dealt(word.tolist(), buckets)
            order = np.argsort(bucket, kind="stable")
            starts = np.flatnonzero(np.diff(bucket[order], prepend=-1))
            found = list(zip(bucket[order[starts]].tolist(), np.split(order, starts[1:])))
            packed = [pack(b" ".join(word[at]), n[at], class_of[at]) for _, at in found]
            none = np.full(len(found), -1)
            yield pa.RecordBatch.from_arrays(
                [pa.array([b for b, _ in found], pa.int32()), pa.array(none, pa.int64()), pa.array(none, pa.int32()), pa.array(packed, pa.binary())],
                names=["bucket", "block", "start", "packed"],
            )

    buckets = buckets_of(model)
    given = words.select("word", F.col("n").cast("long"), F.col("class").cast("int"))
    return common.arrow_mapped(given, deal, common.schema("bucket int, block bigint, start int, packed binary"))


def placed(spark: SparkSession, blocks: DataFrame, model: BrownModel, given: DataFrame | None = None) -> DataFrame:
    """A row for each bucket: its words with training tokens, their counts and classes, sums of each class, and what goes back to the blocks.

    A word goes to the class under which the model gives its training tokens, each between the classes of its neighbours, the greatest
    probability; the smallest of equal ones. ``given`` has (word, n, class) of words that are placed already. Words seen in neither have
    no bigrams of their own and get the class of their ending.
    """
    met = blocks.select("block", F.explode("parts").alias("p")).select("p.bucket", "block", "p.start", "p.packed")
    if given is not None:
        met = met.unionByName(parts_of(spark, given, model))
    shared = spark.sparkContext.broadcast(model)
    schema = common.schema(
        "words array<binary>, n array<bigint>, class array<int>, types array<bigint>, sums array<bigint>,"
        " back array<struct<block: bigint, start: int, packed: binary>>"
    )

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        width = len(m.transitions)
        follows = np.concatenate([m.transitions[:, :-1], m.transitions[:-1].T])
        emits = np.log10(m.emitted[:-1])

        def best(which: np.ndarray, left: np.ndarray, right: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
            order = np.argsort(which, kind="stable")
            which, left, right = which[order], left[order], right[order]
            n = np.bincount(which, minlength=size)
            class_of = np.zeros(size, np.int64)
            for lo in range(0, size, common.SLICE_ROWS):
                hi = min(size, lo + common.SLICE_ROWS)
                at = slice(*np.searchsorted(which, [lo, hi]))
                cell = (which[at] - lo) * (2 * width)
                beside = np.bincount(cell + left[at], minlength=(hi - lo) * 2 * width)
                beside += np.bincount(cell + width + right[at], minlength=(hi - lo) * 2 * width)
                # rounded so that equal classes stay equal
                gain = np.round(beside.reshape(-1, 2 * width) @ follows - n[lo:hi, None] * emits, 6)
                class_of[lo:hi] = gain.argmax(axis=1)
            return n, class_of

        def bucket_of(parts: list[tuple]) -> pa.RecordBatch:
            own = [(block, start, *unpack(packed, bytes, np.int32, np.uint8, np.uint8)) for block, start, packed in parts if block >= 0]
            known = [unpack(packed, bytes, np.int64, np.int32) for block, _, packed in parts if block < 0]
            lists = [x[2].split(b" ") for x in own] + [x[0].split(b" ") for x in known]
            every = pa.concat_arrays([pa.array(x, pa.binary()) for x in lists]).dictionary_encode()
            word, number = every.dictionary, every.indices.to_numpy()
            ends = np.cumsum([len(x) for x in lists])
            here = number[: ends[len(own) - 1] if own else 0]
            join = lambda k, of: np.concatenate([np.zeros(0, of), *(x[k] for x in own)])
            n, class_of = best(np.repeat(here, join(3, np.int32)), join(4, np.uint8), join(5, np.uint8), len(word))
            for x, hi in zip(known, ends[len(own) :]):
                n[number[hi - len(x[1]) : hi]], class_of[number[hi - len(x[1]) : hi]] = x[1], x[2]
            unseen = np.flatnonzero(n == 0)
            class_of[unseen] = ending_classes(m)[endings(word.take(pa.array(unseen)))]
            back = []
            for (block, start, *_), hi, words in zip(own, ends, lists):
                at = number[hi - len(words) : hi]
                back.append({"block": block, "start": start, "packed": pack(class_of[at].astype(np.uint8), n[at])})
            seen = np.flatnonzero(n)
            sums = np.zeros(width, np.int64)
            np.add.at(sums, class_of[seen], n[seen])
            columns = [
                word.take(pa.array(seen)), pa.array(n[seen], pa.int64()), pa.array(class_of[seen], pa.int32()),
                pa.array(np.bincount(class_of[seen], minlength=width), pa.int64()), pa.array(sums),
                pa.array(back, to_arrow_type(schema["back"].dataType.elementType)),
            ]
            return pa.RecordBatch.from_arrays([pa.ListArray.from_arrays([0, len(x)], x) for x in columns], names=schema.names)

        parts, last = [], None
        for batch in batches:
            for bucket, *part in zip(*(x.to_pylist() for x in batch.columns)):
                if parts and bucket != last:
                    yield bucket_of(parts)
                    parts = []
                last = bucket
                parts.append(part)
        if parts:
            yield bucket_of(parts)

    ordered = met.repartition("bucket").sortWithinPartitions("bucket")
    return common.written(spark, common.arrow_mapped(ordered, place, schema), "placed")


def paths(spark: SparkSession, blocks: DataFrame, words: DataFrame, model: BrownModel) -> DataFrame:
    """The blocks with the classes of all their tokens, and each text's known tokens, base score and sum of log10 emissions."""
    back = words.select(F.explode("back").alias("b")).groupBy(F.col("b.block").alias("block")).agg(
        F.collect_list(F.struct("b.start", "b.packed")).alias("met")
    )
    fields = common.schema("sizes binary, classes binary, n_known array<bigint>, base array<double>, emission array<double>").fields
    schema = T.StructType([*fields, blocks.schema["rows"]])
    below = model.n_tokens + HALF * (model.n_types + 1)
    shared = spark.sparkContext.broadcast(model)

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        k, end = len(m.words), len(m.transitions) - 1
        for batch in batches:
            for i in range(batch.num_rows):
                _, sizes, numbers, rows, met = (batch.column(j).slice(i, 1) for j in range(5))
                (path,), (text,) = unpack(numbers[0].as_py(), np.int32), unpack(sizes[0].as_py(), np.int32)
                parts = [(x["start"], *unpack(x["packed"], np.uint8, np.int64)) for x in sorted(met[0].as_py() or [], key=lambda x: x["start"])]
                # the parts follow each other
                class_of = np.concatenate([[end], m.class_of[:k], *(x[1] for x in parts)]).astype(np.int64)
                count = np.concatenate([[m.end_count], m.counts[:k], *(x[2] for x in parts)])
                starts = np.cumsum(text + 1) - text - 1
                sums = [
                    np.add.reduceat(x[path], starts)
                    for x in ((count > 0).astype(np.int64), np.log10((count + HALF) / below), np.log10((count + HALF) / m.emitted[class_of]))
                ]
                yield pa.RecordBatch.from_arrays(
                    [
                        sizes, pa.array([pack(class_of.astype(np.uint8)[path])]),
                        *(pa.ListArray.from_arrays([0, len(x)], pa.array(x)) for x in sums), rows,
                    ],
                    names=schema.names,
                )

    joined = blocks.select("block", "sizes", "numbers", "rows").join(back, "block", "left")
    return common.written(spark, common.arrow_mapped(joined, walk, schema), "paths")


def steps(batches: Iterator[pa.RecordBatch], end: int) -> Iterator[tuple[pa.StructArray, np.ndarray, np.ndarray, np.ndarray, list[np.ndarray]]]:
    """Of each block of ``paths``: rows, tokens of each text, the class before and of each token, and the texts' sums."""
    for batch in batches:
        for i in range(batch.num_rows):
            sizes, classes, *sums, rows = (c.slice(i, 1) for c in batch.columns)
            (after,), (text,) = unpack(classes[0].as_py(), np.uint8), unpack(sizes[0].as_py(), np.int32)
            after = after.astype(np.int64)
            before = np.concatenate([[end], after[:-1]])
            yield rows.flatten(), text + 1, before, after, [x.flatten().to_numpy() for x in sums]


def count_transitions(found: DataFrame, width: int) -> np.ndarray:
    """Class bigrams of all training texts."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(width * width, dtype=np.int64)
        for rows, text, before, after, _ in steps(batches, width - 1):
            seen = np.repeat(rows.field("train").to_numpy(zero_copy_only=False), text)
            total += np.bincount((before * width + after)[seen], minlength=width * width)
        pair = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(pair, pa.int32()), pa.array(total[pair], pa.int64())], names=["pair", "n"])

    counts = common.summed_counts(common.arrow_mapped(found, count, common.schema("pair int, n bigint")), ["pair"])
    return common.to_dense(counts, "pair", "n", width * width).reshape(width, width)


def scored(spark: SparkSession, found: DataFrame, model: BrownModel, stays: list[str]) -> DataFrame:
    """The rows of ``paths``, one by one, with their scores."""
    own = found.schema["rows"].dataType.elementType.fields[1:]
    made = common.schema("n_tokens bigint, n_known bigint, base_score double, score double").fields
    schema = T.StructType([*own, *made])
    shared = spark.sparkContext.broadcast(model.transitions)

    def score_block(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        transitions = shared.value
        for rows, text, before, after, (n_known, base, emission) in steps(batches, len(transitions) - 1):
            score = np.add.reduceat(transitions[before, after], np.cumsum(text) - text) + emission
            made = [pa.array(text, pa.int64()), pa.array(n_known), pa.array(base), pa.array(score)]
            yield pa.RecordBatch.from_arrays([*rows.flatten()[1:], *made], names=schema.names)

    return common.arrow_mapped(found, score_block, schema).select(
        *(F.col(f.name).alias(c) for f, c in zip(own, stays)), "n_tokens", "n_known", F.lit(model.n_tokens).cast("long").alias("train_tokens"),
        "base_score", "score", F.pow(F.lit(10.0), -F.col("score") / F.col("n_tokens")).alias("perplexity"),
    )


MADE = ["n_tokens", "n_known", "train_tokens", "base_score", "score", "perplexity"]


def bare(docs: DataFrame, text: str) -> DataFrame:
    """Without the columns that clash with results."""
    return docs.select(*(c for c in docs.columns if c == text or c.lower() not in MADE))


def cluster(
    spark: SparkSession, docs: DataFrame, train: Column, *, text: str = "text", classes: int = CLASSES
) -> tuple[BrownModel, DataFrame, DataFrame]:
    """Places every word by its own bigrams in the rows of ``train``, and scores all rows.

    Gives the model with the ``FREQUENT`` most frequent words, a table (word, n, class) of the others, and what ``score`` gives
    of the rows, which are tokenised and meet their words' classes once for both.
    """
    seed, _ = fit(spark, docs.where(train), text=text, known=FREQUENT, classes=classes)
    rest = bare(docs, text)
    # judged on all columns, those that results replace too
    rest = docs.select(*rest.columns, train.alias(mark := common.helper_prefix(docs) + "train"))
    blocks = numbered(spark, rest, F.col(mark), seed, text)
    words = placed(spark, blocks, seed)
    k, width = len(seed.words), classes + 1
    types = np.bincount(seed.class_of[:k], minlength=width).astype(float)
    sums = np.bincount(seed.class_of[:k], weights=seed.counts, minlength=width)
    by_class = words.select(F.posexplode(F.arrays_zip("types", "sums")).alias("c", "x")).groupBy("c").agg(F.sum("x.types"), F.sum("x.sums"))
    for c, v, n in by_class.collect():
        types[c] += v
        sums[c] += n
    types[-1], sums[-1] = float(seed.end_count > 0), seed.end_count
    model = replace(seed, emitted=sums + HALF * (types + 1))
    found = paths(spark, blocks, words, model)
    model = replace(model, transitions=log_transitions(count_transitions(found, width)))
    own = [c for c in rest.columns if c != text]
    others = words.select(F.explode(F.arrays_zip("words", "n", "class")).alias("w")).select(F.col("w.words").alias("word"), "w.n", "w.class")
    return model, others, scored(spark, found, model, own).drop(mark)


def score(spark: SparkSession, docs: DataFrame, model: BrownModel, counts: DataFrame, *, text: str = "text") -> DataFrame:
    """Every row's other columns with n_tokens, n_known, train_tokens, base_score, score and perplexity.

    ``counts`` has (word, n) of the words that the model does not carry, and the class of each; without classes, as ``fit`` gives it,
    they have those of the first clustering.
    """
    rest = bare(docs, text)
    given = counts.where(F.length("word") > 0)
    if "class" not in counts.columns:
        by_ending = F.array(*(F.lit(int(c)) for c in ending_classes(model)))
        given = given.withColumn("class", F.element_at(by_ending, ending_column(F.col("word")) + 1))
    blocks = numbered(spark, rest, F.lit(False), model, text)
    found = paths(spark, blocks, placed(spark, blocks, model, given), model)
    return scored(spark, found, model, [c for c in rest.columns if c != text])
