"""Near-duplicates: MinHash signatures by universal hashing, banding, signature and set verification, components.

The set of a document is its distinct shingles of ``width`` words (A-Z lower-cased, words ``[^\\x20\\x09-\\x0D]+``); with fewer
words the whole sequence is one shingle. Documents are linked if their Jaccard similarity reaches ``percent``; components
are found by alternating large-star and small-star.

1. Equal sets are one class (grouped by a 128-bit digest, pre-aggregated), the class is one node named by its smallest id.
2. ``BANDS * ROWS`` minima per node; nodes that agree on a band share a bucket. At similarity 0.8 a pair misses all bands with
   probability 5e-8.
3. In each bucket every node is compared with the smallest one, the bucket's star, never all with all. Pairs are verified by
   the share of equal minima (with a slack of over five standard deviations), then on full sets.
4. A link between two nodes of one component says nothing new, so only buckets that still hold several components go on.
   Where nodes of different components make up to ``SMALL / 2`` pairs a node, as in any bucket of up to ``SMALL`` nodes, all of these
   are compared: the nodes outside of the bucket's main component with the others. The nodes of the other buckets go by exact prefix
   filtering: all shingles get one order, rarer ones (by bounded, hashed counts over these nodes) first. Two sets of similarity
   ``percent`` have that share of either in common, so the first of their common shingles is among the first ``n - ceil(percent * n) + 1``
   of both. Each node offers these once, whatever buckets it came from, and nodes with a shingle in common share a bucket.
   What two nodes have in common from their first common shingle on is no more than either has left from there, so a shingle that
   stands too far back to leave enough of a bucket's shortest set is not offered: passages that many texts share come last in
   the order, and fall out here. Buckets with more pairs are compared with another star each round, which soon leaves few
   components; after ``LEVELS`` rounds, or one that links nothing new, what is left is compared, whatever its size.

Shingles are 64-bit hashes; sets are compared by these. Defined results: null texts and texts without words have an empty set
and are linked with nothing; rows without an id are kept and belong to no component; rows that share an id
(which is meant to be unique) are one node and stay or go together.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from stallwise.llm import common

BANDS, ROWS = 32, 4
SMALL = 32
LEVELS = 4
#: Counters by which shingles are ordered.
COUNTERS = 1 << 18
#: Blocks in which they are summed.
BLOCKS = 64
#: Similarity by minima may fall short of the real one by so much.
SLACK = 0.2
_rng = np.random.Generator(np.random.PCG64(20240229))
FACTORS = _rng.integers(1, 1 << 63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
OFFSETS = _rng.integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64)
STEP = np.uint64(0x9E3779B97F4A7C15)
CHUNK = 8192


class WordHashes(dict):
    """64-bit hashes of words, remembered."""

    def __missing__(self, word: bytes) -> int:
        value = self[word] = xxhash.xxh3_64_intdigest(word) >> 1
        return value

    def of(self, text: str | None) -> np.ndarray:
        """Hashes of the words of a text, in order; only A-Z are lower-cased, only ASCII white space parts words."""
        if len(self) > common.CACHE_ENTRIES:
            self.clear()
        words = (text or "").encode("utf-8", "surrogatepass").lower().split()
        return np.fromiter(map(self.__getitem__, words), np.int64, len(words)).view(np.uint64)


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(32))


def shingles(words: np.ndarray, width: int) -> np.ndarray:
    """Sorted distinct hashes of the shingles."""
    if not len(words):
        return words
    n = min(width, len(words))
    out = np.full(len(words) - n + 1, n, dtype=np.uint64)
    for i in range(n):
        out = mixed(out * STEP + words[i : len(words) - n + 1 + i])
    return np.unique(out)


def minima(of: np.ndarray) -> np.ndarray:
    out = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, dtype=np.uint64)
    for i in range(0, len(of), CHUNK):
        np.minimum(out, (of[i : i + CHUNK, None] * FACTORS + OFFSETS).min(axis=0), out=out)
    return out


def band_keys(sig: np.ndarray) -> np.ndarray:
    keys = np.arange(1, BANDS + 1, dtype=np.uint64)
    for column in sig.reshape(BANDS, ROWS).T:
        keys = mixed(keys * STEP + column)
    return keys.view(np.int64)


def signed(docs: DataFrame, doc_id: str, text: str, width: int) -> DataFrame:
    """(id, n_shingles, digest of the set, minima cut to 16 bits, band keys) of every document."""
    fields = [
        T.StructField("n_shingles", T.LongType()), T.StructField("digest", T.BinaryType()),
        T.StructField("minima", T.ArrayType(T.ShortType())), T.StructField("bands", T.ArrayType(T.LongType())),
    ]

    def work():
        hashes = WordHashes()

        def on_batch(batch: pa.RecordBatch) -> tuple:
            sizes, digests, sigs, bands = [], [], [], []
            for t in common.column(batch, text):
                s = shingles(hashes.of(t), width)
                sizes.append(len(s))
                if not len(s):
                    digests.append(None), sigs.append(None), bands.append(None)
                    continue
                m = minima(s)
                digests.append(xxhash.xxh3_128_digest(s.tobytes()))
                sigs.append((m >> np.uint64(48)).astype(np.uint16).view(np.int16))
                bands.append(band_keys(m))
            return [sizes, digests, sigs, bands], None

        return on_batch

    return common.appended(docs.select(F.col(doc_id).alias("id"), text), fields, work).drop(text)


def shingle_sets(docs: DataFrame, text: str, width: int) -> DataFrame:
    def work():
        hashes = WordHashes()
        return lambda batch: ([[shingles(hashes.of(t), width).view(np.int64) for t in common.column(batch, text)]], None)

    return common.appended(docs, [T.StructField("shingles", T.ArrayType(T.LongType()))], work).drop(text)


def components(spark: SparkSession, links: DataFrame) -> DataFrame:
    """(id, component) of every node of ``links`` (a, b), the component named by its smallest node.

    Alternating large-star and small-star; each step takes the least neighbour by a pre-aggregated minimum and joins it back,
    so that the neighbours of a node are never gathered. Every round is written to the shared folder. It ends when
    every edge leads straight to the centre of a star.
    """
    edges = common.written(
        spark, links.select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo")).where("hi <> lo").distinct(), "links"
    )
    while True:
        ends = edges.select(F.col("hi").alias("id"), "lo").unionByName(
            edges.select(F.col("lo").alias("id"), F.lit(None).cast("long").alias("lo"))
        ).groupBy("id").agg(F.min("lo").alias("least"), F.max("lo").alias("most"), F.count("*").alias("n"), F.count("lo").alias("up"))
        if ends.where("least <> most or (up > 0 and up < n)").isEmpty():
            break
        both = edges.unionByName(edges.select(F.col("lo").alias("hi"), F.col("hi").alias("lo")))
        least = both.groupBy("hi").agg(F.min("lo").alias("m")).select("hi", F.least("hi", "m").alias("m"))
        large = both.join(least, "hi").where("lo > hi").select(F.col("lo").alias("hi"), F.col("m").alias("lo")).distinct()
        # small-star: a node and its other smaller neighbours point to its least smaller neighbour
        small = large.groupBy("hi").agg(F.min("lo").alias("m"))
        edges = common.written(
            spark,
            large.join(small, "hi").select(F.col("lo").alias("hi"), F.col("m").alias("lo")).where("hi <> lo")
            .unionByName(small.select("hi", F.col("m").alias("lo"))).distinct(),
            "links",
        )
    return edges.select(F.col("hi").alias("id"), F.col("lo").alias("component")).unionByName(
        edges.select(F.col("lo").alias("id"), F.col("lo").alias("component"))
    ).distinct()


class _Search:
    """Links between the nodes of ``nodes`` (id, n_shingles, minima, bands), level by level."""

    def __init__(self, spark: SparkSession, docs: DataFrame, nodes: DataFrame, doc_id: str, text: str, width: int, percent: int):
        self.spark, self.docs, self.nodes = spark, docs.select(F.col(doc_id).alias("id"), text), nodes
        self.text, self.width, self.percent = text, width, percent

    def alike(self, one: str, other: str) -> Column:
        """Sets of very different sizes cannot be similar."""
        return F.least(one, other) * 100 >= F.greatest(one, other) * self.percent

    def sets(self, ids: DataFrame) -> DataFrame:
        """(id, shingles) of the given ids; the ids are written first, so that few of them are sent to the texts."""
        ids = common.written(self.spark, ids.distinct(), "ids")
        return common.written(self.spark, shingle_sets(self.docs.join(ids, "id"), self.text, self.width), "shingle-sets")

    def verified(self, pairs: DataFrame) -> DataFrame:
        """Of distinct (a, b), those whose sets are similar enough."""
        sigs = self.nodes.select("id", "n_shingles", "minima")
        a = sigs.select(F.col("id").alias("a"), F.col("n_shingles").alias("n_a"), F.col("minima").alias("m_a"))
        b = sigs.select(F.col("id").alias("b"), F.col("n_shingles").alias("n_b"), F.col("minima").alias("m_b"))
        equal = F.size(F.filter(F.zip_with("m_a", "m_b", lambda x, y: x == y), lambda same: same))
        likely = common.written(
            self.spark,
            pairs.join(a, "a").join(b, "b")
            .where(self.alike("n_a", "n_b"))
            .where(equal >= (self.percent / 100 - SLACK) * BANDS * ROWS)
            .select("a", "b").distinct(),
            "likely-pairs",
        )
        sets = self.sets(likely.select(F.explode(F.array("a", "b")).alias("id")))
        left = sets.select(F.col("id").alias("a"), F.col("shingles").alias("s_a"))
        right = sets.select(F.col("id").alias("b"), F.col("shingles").alias("s_b"))
        shared = F.size(F.array_intersect("s_a", "s_b"))
        union = F.size("s_a") + F.size("s_b") - shared
        found = likely.join(left, "a").join(right, "b").where(shared * 100 >= union * self.percent).select("a", "b")
        return common.written(self.spark, found, "verified")

    def run(self) -> DataFrame:
        """(id, component) of the linked nodes."""
        keyed = self.nodes.select(
            "id", F.col("id").alias("component"), F.col("n_shingles").alias("size"), F.explode("bands").alias("key"), F.lit(-1).alias("at")
        )
        pending = self.spark.createDataFrame([], "a long, b long")
        linked = None
        for level in range(LEVELS + 1):
            other = F.xxhash64("id", F.lit(level)) if level > 1 else F.col("id")
            sizes = keyed.groupBy("key").agg(
                F.min_by("id", other).alias("star"), F.min_by("size", other).alias("star_size"),
                F.min_by("component", other).alias("star_component"), F.count("*").alias("n"),
            ).where("n > 1")
            members = common.written(self.spark, keyed.join(sizes, "key"), "buckets")
            alike = self.alike("size", "star_size")
            stars = members.where("component <> star_component").where(alike).select(F.col("star").alias("a"), F.col("id").alias("b"))
            before, linked = linked, self.joined(linked, self.verified(stars.unionByName(pending).distinct()))
            left = self.unsettled(members.where("n > 2"), linked)
            if left.isEmpty():
                return linked
            # where a star has linked nothing new, another one seldom does
            last = level == LEVELS or (level > 1 and linked is before)
            few = F.col("crossing") * 2 <= F.col("n") * SMALL
            pending = self.crossing(left if last else left.where(few))
            large = left.where(~few)
            if last or large.isEmpty():
                break
            pending = common.written(self.spark, pending.distinct(), "pending")
            following = large if level else self.placed(self.offered(self.prefixes(large.select("id"))), linked)
            keyed = common.written(self.spark, following.select("id", "component", "size", "key", "at"), "offered-shingles")
        return self.joined(linked, self.verified(pending.distinct()))

    def joined(self, linked: DataFrame | None, found: DataFrame) -> DataFrame:
        """Components with the new links; a link between nodes of earlier components is one between these."""
        if linked is None:
            return common.written(self.spark, components(self.spark, found), "components")
        a = linked.select(F.col("id").alias("a"), F.col("component").alias("of_a"))
        b = linked.select(F.col("id").alias("b"), F.col("component").alias("of_b"))
        new = common.written(
            self.spark,
            found.join(a, "a", "left").join(b, "b", "left")
            .select(F.coalesce("of_a", "a").alias("a"), F.coalesce("of_b", "b").alias("b")).where("a <> b").distinct(),
            "new-links",
        )
        if new.isEmpty():
            return linked
        met = common.written(self.spark, components(self.spark, new), "components")
        moved = met.select(F.col("id").alias("component"), F.col("component").alias("into"))
        return common.written(
            self.spark,
            linked.join(moved, "component", "left").select("id", F.coalesce("into", "component").alias("component"))
            .unionByName(met.join(linked, "id", "left_anti").select("id", "component")),
            "components",
        )

    def placed(self, rows: DataFrame, linked: DataFrame) -> DataFrame:
        """Rows with the component of their id."""
        return rows.join(linked, "id", "left").withColumn("component", F.coalesce("component", "id"))

    def unsettled(self, members: DataFrame, linked: DataFrame) -> DataFrame:
        """Members of the buckets that hold more than one component, with their component, the bucket's ``main`` one and the number of pairs of different ones."""
        rows = self.placed(members.drop("component"), linked)
        held = rows.groupBy("key", "component").agg(F.count("*").alias("c"))
        several = held.groupBy("key").agg(
            F.max_by("component", F.struct("c", "component")).alias("main"), F.min("component").alias("low"), F.max("component").alias("high"),
            F.expr("(pow(sum(double(c)), 2) - sum(pow(double(c), 2))) / 2").alias("crossing"),
        ).where("low <> high").drop("low", "high")
        return common.written(self.spark, rows.join(several, "key"), "unsettled")

    def crossing(self, members: DataFrame) -> DataFrame:
        """Pairs of different components in a bucket, those with its star apart, which have been compared.

        One of a pair at least is outside of the main component, so members of that never meet each other.
        A pair is needed in the bucket of its first common shingle only, where enough must be left of both (``at`` is -1 for bands).
        """
        rows = members.where("id <> star").withColumn("left", F.col("size") - F.greatest("at", F.lit(0)))
        outside = rows.where("component <> main").select("key", F.col("id").alias("a"), "component", "size", "left", "main")
        other = rows.select(
            "key", F.col("id").alias("b"), F.col("component").alias("other"), F.col("size").alias("size_b"), F.col("left").alias("left_b")
        )
        return outside.join(other, "key").where(
            F.expr("component <> other and (other = main or a < b)")
            & self.alike("size", "size_b") & self.enough(F.least("left", "left_b"), F.col("size") + F.col("size_b"))
        ).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))

    def enough(self, shared: Column, sizes: Column) -> Column:
        """Whether two sets of so many shingles together are similar if they share so many."""
        return shared * (100 + self.percent) >= sizes * self.percent

    def prefixes(self, ids: DataFrame) -> DataFrame:
        """(id, size, prefix): of each node the shingles that may be its first one in common with a similar node, rarer ones first."""
        sets = self.sets(ids)
        kept = self.spark.sparkContext.broadcast(self.counters(sets))
        percent = self.percent

        def work():
            counts = kept.value

            def on_batch(batch: pa.RecordBatch) -> tuple:
                out = []
                for own in common.column(batch, "shingles"):
                    own = np.array(own, dtype=np.int64)
                    order = np.lexsort((own, counts[own & (COUNTERS - 1)]))
                    out.append(own[order[: len(own) - -(-percent * len(own) // 100) + 1]])
                return [[len(s) for s in common.column(batch, "shingles")], out], None

            return on_batch

        fields = [T.StructField("size", T.LongType()), T.StructField("prefix", T.ArrayType(T.LongType()))]
        return common.written(self.spark, common.appended(sets, fields, work).drop("shingles"), "prefixes")

    def counters(self, sets: DataFrame) -> np.ndarray:
        """In how many sets shingles of each remainder occur, an array of ``COUNTERS`` numbers."""
        blocks = min(BLOCKS, COUNTERS)

        def summed(bucket: list[int], n: list[np.ndarray]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(bucket, pa.int64()), pa.array(n, pa.list_(pa.int64()))], names=["bucket", "n"])

        def count(batches):
            counts = np.zeros((blocks, COUNTERS // blocks), dtype=np.int64)
            for batch in batches:
                held = batch.column(batch.schema.get_field_index("shingles")).flatten().to_numpy(zero_copy_only=False)
                np.add.at(counts.reshape(-1), held & (COUNTERS - 1), 1)
            at = np.flatnonzero(counts.any(axis=1))
            yield summed(at.tolist(), list(counts[at]))

        def add(batches):
            sums: dict[int, np.ndarray] = {}
            for batch in batches:
                for bucket, n in zip(common.column(batch, "bucket"), common.column(batch, "n")):
                    sums[bucket] = sums.get(bucket, 0) + np.array(n, dtype=np.int64)
            yield summed(list(sums), list(sums.values()))

        # as many tasks as run at once, each with a row for a block of counters at most, however many sets and parts there are
        kind = common.schema("bucket long, n array<long>")
        few = sets.select("shingles").coalesce(self.spark.sparkContext.defaultParallelism)
        out = np.zeros((blocks, COUNTERS // blocks))
        for r in common.arrow_mapped(common.arrow_mapped(few, count, kind).repartition("bucket"), add, kind).collect():
            out[r["bucket"]] = r["n"]
        return out.reshape(-1)

    def offered(self, prefixes: DataFrame) -> DataFrame:
        """Rows (id, size, key, at): the shingles of the prefixes with their places, but for those that stand too far back."""
        offers = common.written(self.spark, prefixes.select("id", "size", F.posexplode("prefix").alias("at", "key")), "offers")
        shortest = offers.groupBy("key").agg(F.min("size").alias("shortest"), F.count("*").alias("n")).where("n > 1").drop("n")
        least = F.greatest(F.col("shortest"), F.ceil(F.col("size") * self.percent / 100))
        able = self.enough(F.col("size") - F.col("at"), F.col("size") + least)
        return offers.join(shortest, "key").where(able).select("id", "size", "key", "at")


def near_duplicates(
    spark: SparkSession, docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", width: int = 5, percent: int = 80
) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of every row; ``kept`` marks the document its component is named by."""
    signatures = common.written(spark, signed(docs, doc_id, text, width), "signatures")
    # equal sets have equal signatures, so any of them will do
    nodes = common.written(
        spark,
        signatures.where("id is not null and digest is not null").groupBy("digest").agg(
            F.min("id").alias("id"), F.first("n_shingles").alias("n_shingles"), F.first("minima").alias("minima"), F.first("bands").alias("bands")
        ),
        "nodes",
    )
    linked = _Search(spark, docs, nodes, doc_id, text, width, percent).run()
    owner = nodes.select("id", "digest").join(linked, "id", "left").select(
        "digest", F.coalesce("component", "id").alias("component_id")
    )
    component = F.when(F.col("id").isNotNull(), F.coalesce("component_id", "id"))
    return signatures.select("id", "n_shingles", "digest").join(owner, "digest", "left").select(
        F.col("id").alias(doc_id), "n_shingles", component.alias("component_id"),
        F.coalesce(F.col("id") == F.col("component_id"), F.lit(True)).alias("kept"),
    )
