"""Mixing sources to target weights, by DataFrame operations only.

Sources in the order of their code points, the null source last, weigh ``WEIGHTS`` in turn. They share ``percent`` of all words by
weight; a target stops at ``most`` times its source's size and the rest is shared anew. (The fixed point of that is
``min(most * size, level * weight)`` for one level, found from running sums over the sources.)

The words of each source, its documents in pseudorandom order, are packed into blocks of ``block_words`` words. Output shards of
about ``shard_slots`` slots draw their counts by source: the whole part of the expected count, and multinomial draws for what is left of
the shard (residual multinomial sampling, so that a source's total stays within a few blocks of its target). The i-th draw
of a source takes the block at ``i mod blocks`` of the round's permutation, which is computed place by place: ``SHUFFLE`` steps of a
swap-or-not shuffle, each of which maps a place x to ``key - x`` or leaves both of the pair where they are, by a hash of the
pair. Keys and hashes depend on the source, the round and the seed. Blocks and documents meet by (source, block).

Places in a source come from sums over buckets of documents and, above them, coarse buckets, so no window holds more than a few
thousand rows however large a source is.

Defined results: null and empty texts have size 0 and are taken 0 times; null is a source, and so is the empty string; no documents
give no rows. Draws beyond ``most`` rounds of a source (a few per source at its limit) stay empty, so no document is taken more
often. Equal rows are interchangeable: which of them is taken does not matter, and reruns give equal rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from stallwise.llm import common

WEIGHTS = (5, 2, 1)
PERCENT, MOST = 150, 2
BLOCK_WORDS, SHARD_SLOTS = 64, 1024
BUCKET_ROWS, COARSE = 1000, 2048
#: Steps of the permutation of a source's blocks.
SHUFFLE = 24


def sized(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """(doc_id, source, size, fingerprint of the text): all that mixing needs of a document."""
    return docs.select(
        F.col(doc_id).alias("doc_id"), F.col(source).alias("source"),
        F.coalesce(F.regexp_count(F.col(text), F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long").alias("size"),
        F.xxhash64(text).alias("print"),
    )


def targets(sizes: DataFrame, *, weights: tuple[int, ...] = WEIGHTS, percent: int = PERCENT, most: int = MOST) -> DataFrame:
    """(source, number, n_docs, source_size, target) of every source; one row per source passes one task."""
    by = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n_docs"))
    number = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weighed = by.withColumn("number", number).withColumn(
        "weight", F.element_at(F.array(*map(F.lit, weights)), (F.col("number") % len(weights) + 1).cast("int"))
    )
    # by the level at which a source stops; those before a source have stopped, those from it on have not
    up = Window.orderBy(F.col("source_size") / F.col("weight"), "number")
    ahead = F.coalesce(F.sum(F.col("source_size") * most).over(up.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    left = F.sum("weight").over(up.rowsBetween(0, Window.unboundedFollowing))
    total = F.sum("source_size").over(Window.partitionBy())
    level = weighed.withColumn("level", (total * percent / 100 - ahead) / left).withColumn(
        "open", F.col("level") * F.col("weight") <= F.col("source_size") * most
    )
    # the levels only fall after the first open source, so that one has the highest
    found = F.coalesce(F.max(F.when(F.col("open"), F.col("level"))).over(Window.partitionBy()), F.lit(float("inf")))
    cap = (F.col("source_size") * most).cast("double")
    return level.select(
        "source", "number", "n_docs", "source_size",
        F.when(F.col("source_size") == 0, F.lit(0.0)).otherwise(F.least(cap, found * F.col("weight"))).alias("target"),
    )


def _before(rows: DataFrame, keys: list[str], order: str, value: str, name: str) -> DataFrame:
    """Sum of ``value`` over the earlier rows (by ``order``) of the same keys."""
    w = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumn(name, F.coalesce(F.sum(value).over(w), F.lit(0)))


def placed(sizes: DataFrame, sources: DataFrame) -> DataFrame:
    """Documents with words, with their first word's place among the words of their source."""
    rows = sizes.where("size > 0").join(
        sources.select(F.col("source").alias("_s"), "number", "n_docs", "source_size", "target"), F.col("source").eqNullSafe(F.col("_s"))
    ).drop("_s")
    mixed = F.xxhash64("doc_id", "print", F.lit(11))
    buckets = F.ceil(F.col("n_docs") / BUCKET_ROWS)
    coarse = F.least(buckets, F.lit(COARSE))
    rows = rows.withColumn("coarse", F.pmod(mixed, coarse)).withColumn(
        "fine", F.pmod(F.shiftright(mixed, 20), F.ceil(buckets / coarse))
    )
    fine = rows.groupBy("number", "coarse", "fine").agg(F.sum("size").alias("words"))
    high = _before(
        fine.groupBy("number", "coarse").agg(F.sum("words").alias("words")), ["number"], "coarse", "words", "coarse_first"
    ).drop("words")
    low = _before(fine, ["number", "coarse"], "fine", "words", "fine_first").drop("words")
    starts = low.join(high, ["number", "coarse"]).select(
        "number", "coarse", "fine", (F.col("coarse_first") + F.col("fine_first")).alias("first")
    )
    within = Window.partitionBy("number", "coarse", "fine").orderBy("doc_id", "print", "size").rowsBetween(
        Window.unboundedPreceding, -1
    )
    return (
        rows.withColumn("within", F.coalesce(F.sum("size").over(within), F.lit(0)))
        .join(starts, ["number", "coarse", "fine"])
        .select("doc_id", "source", "print", "size", "number", "source_size", "target",
                (F.col("first") + F.col("within")).alias("start"))
    )


def _uniform(*key: Column | str) -> Column:
    return F.pmod(F.xxhash64(*key), F.lit(1 << 52)) / F.lit(float(1 << 52))


def keys_of(*what: Column) -> Column:
    """The keys of the permutation that ``what`` stands for, one for each step."""
    # a bit less than a hash, so that a place can be taken from it
    return F.transform(F.sequence(F.lit(1), F.lit(SHUFFLE)), lambda i: F.shiftrightunsigned(F.xxhash64(*what, i), 1))


def permuted(place: Column, n: Column, keys: Column) -> Column:
    """The value at ``place`` (0 to n - 1) of the pseudorandom permutation of 0 to n - 1 that ``keys`` stand for."""

    def step(x: Column, key: Column) -> Column:
        other = F.pmod(key - x, n)
        # both of a pair see the same hash, so they change places or both stay
        return F.when(F.xxhash64(key, F.greatest(x, other)) % 2 == 0, other).otherwise(x)

    return F.aggregate(keys, place.cast("long"), step)


def slots(
    spark: SparkSession, sources: DataFrame, *, block_words: int = BLOCK_WORDS, shard_slots: int = SHARD_SLOTS, most: int = MOST,
    seed: int = 1,
) -> DataFrame:
    """(shard, number, draw, block): which block fills each slot of each output shard."""
    live = sources.where("source_size > 0").withColumn("blocks", F.ceil(F.col("source_size") / block_words).cast("long"))
    live = live.withColumn("draws", F.col("blocks") * F.col("target") / F.col("source_size"))
    shards = max(1, round((live.agg(F.sum("draws")).first()[0] or 0) / shard_slots))
    live = live.select("number", "blocks", (F.col("draws") / shards).alias("expected"))
    live = live.withColumn("whole", F.floor("expected")).withColumn("rest", F.col("expected") - F.floor("expected"))
    upto = F.sum("rest").over(Window.orderBy("number"))
    every = Window.partitionBy()
    live = live.withColumn("hi", upto).withColumn("lo", F.col("hi") - F.col("rest")).withColumns(
        {"left": F.sum("rest").over(every), "cells": F.count("*").over(every)}
    )
    live = common.written(spark, live, "mix-sources")
    left, cells = live.select("left", "cells").first() or (0.0, 1)

    # the whole parts: draws 0 .. shards * whole - 1 of each source
    parts = max(8, min(shards, 4096))
    shard = spark.range(0, shards, 1, min(parts, shards)).withColumnRenamed("id", "shard")
    step = 256
    spans = live.where("whole > 0").withColumn("part", F.explode(F.sequence(F.lit(0), F.lit((shards - 1) // step))))
    whole = (
        spans.withColumn("shard", F.explode(F.sequence(F.col("part") * step, F.least(F.col("part") * step + step - 1, F.lit(shards - 1)))))
        .withColumn("j", F.explode(F.sequence(F.lit(0).cast("long"), F.col("whole") - 1)))
        .select(F.col("shard").cast("long"), "number", "blocks", (F.col("shard") * F.col("whole") + F.col("j")).alias("draw"))
    )
    # what is left of each shard: multinomial draws, looked up in cells of the running shares
    count = (F.floor(F.lit(left) * (F.col("shard") + 1) + 1e-9) - F.floor(F.lit(left) * F.col("shard") + 1e-9)).cast("int")
    drawn = (
        shard.withColumn("count", count).where("count > 0").withColumn("d", F.explode(F.sequence(F.lit(1), F.col("count"))))
        .withColumn("u", _uniform("shard", "d", F.lit(seed)) * F.lit(left))
        .withColumn("cell", F.floor(F.col("u") / F.lit(left or 1.0) * cells))
    )
    cell = lambda c: F.least(F.floor(F.col(c) / F.lit(left or 1.0) * cells), F.lit(cells - 1)).cast("long")
    guide = live.where("rest > 0").withColumn("cell", F.explode(F.sequence(cell("lo"), cell("hi"))))
    hits = drawn.join(guide.select("cell", "number", "blocks", "whole", "lo", "hi"), "cell").where("lo <= u and u < hi")
    hits = hits.select("shard", "d", "number", "blocks", "whole").withColumn("group", F.floor(F.col("shard") / 1024))
    groups = _before(hits.groupBy("number", "group").agg(F.count("*").alias("n")), ["number"], "group", "n", "earlier").drop("n")
    rank = F.row_number().over(Window.partitionBy("number", "group").orderBy("shard", "d")) - 1
    rest = hits.withColumn("rank", rank).join(groups, ["number", "group"]).select(
        "shard", "number", "blocks", (F.col("whole") * shards + F.col("earlier") + F.col("rank")).alias("draw")
    )
    every_slot = whole.unionByName(rest).where(F.col("draw") < F.col("blocks") * most)
    turn = F.floor(F.col("draw") / F.col("blocks"))
    # a row for each source and round
    keys = live.select("number", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(most - 1).cast("long"))).alias("turn")).withColumn(
        "keys", keys_of("number", "turn", F.lit(seed))
    )
    return every_slot.withColumn("turn", turn).join(keys, ["number", "turn"]).select(
        "shard", "number", "draw", permuted(F.pmod(F.col("draw"), F.col("blocks")), F.col("blocks"), F.col("keys")).alias("block")
    )


def mixed(
    spark: SparkSession, docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", source: str = "source",
    block_words: int = BLOCK_WORDS, shard_slots: int = SHARD_SLOTS, weights: tuple[int, ...] = WEIGHTS, percent: int = PERCENT,
    most: int = MOST, seed: int = 1,
) -> DataFrame:
    """(doc_id, source, print, size, source_size, target, taken) of every row."""
    sizes = common.written(spark, sized(docs, doc_id, text, source), "sizes")
    sources = common.written(spark, targets(sizes, weights=weights, percent=percent, most=most), "targets")
    counted = slots(spark, sources, block_words=block_words, shard_slots=shard_slots, most=most, seed=seed)
    counted = counted.groupBy("number", "block").agg(F.count("*").alias("times"))
    end = F.col("start") + F.col("size")
    pieces = placed(sizes, sources).withColumn(
        "block", F.explode(F.sequence(F.floor(F.col("start") / block_words), F.floor((end - 1) / block_words)))
    )
    words = F.least(end, (F.col("block") + 1) * block_words) - F.greatest(F.col("start"), F.col("block") * block_words)
    row = ["doc_id", "source", "print", "size", "source_size", "target"]
    taken = (
        pieces.withColumn("words", words).join(counted, ["number", "block"], "left")
        .groupBy(*row, "start").agg(F.sum(F.col("words") * F.coalesce("times", F.lit(0))).alias("taken")).drop("start")
    )
    empty = sizes.where("size = 0").join(
        sources.select(F.col("source").alias("_s"), "source_size", "target"), F.col("source").eqNullSafe(F.col("_s"))
    ).select(*row, F.lit(0).cast("long").alias("taken"))
    return taken.unionByName(empty)


def mix_documents(spark: SparkSession, docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", source: str = "source", **how) -> DataFrame:
    """The documents that the mix takes words of, all their columns kept, with size, source_size, target and taken.

    Rows equal in id, source and text share what is taken of them evenly, rounded down.
    """
    key = ["doc_id", "source", "print"]
    what = ["size", "source_size", "target", "taken"]
    found = mixed(spark, docs, doc_id=doc_id, text=text, source=source, **how).groupBy(*key).agg(
        *(F.first(c).alias(f"_{c}") for c in what[:3]), F.floor(F.sum("taken") / F.count("*")).alias("_taken")
    ).where("_taken > 0")
    stays = [c for c in docs.columns if c.lower() not in what]
    mark = common.helper_prefix(docs)
    found = found.select(*(F.col(c).alias(f"{mark}{c}") for c in key), *(F.col(f"_{c}").alias(f"{mark}{c}") for c in what))
    same = (
        F.col(doc_id).eqNullSafe(F.col(f"{mark}doc_id")) & F.col(source).eqNullSafe(F.col(f"{mark}source"))
        & (F.xxhash64(text) == F.col(f"{mark}print"))
    )
    return docs.select(*stays).join(found, same).select(*stays, *(F.col(f"{mark}{c}").alias(c) for c in what))
