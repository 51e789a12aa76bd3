"""Unique slugs for a batch of new products, as if they had been added one by one.

Every product takes the first free name of ``root, root-2, root-3, ...``. So the k-th product of a
root gets the k-th place that is not taken when its turn comes, and the job is to find the places a root must skip:

* places in use by existing products;
* places that products of another root took first: a root that ends in a number, such as ``ring-2``, competes
  with the root before the number for the name they share.

Both are found by counting, with no group of products, places or names ever brought together in a task.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, functions as F

from stallwise.functions.text import slugify
from stallwise.operators.spread import running_count
from stallwise.session import enable_checkpoints, ship_package

NUMBERED = r"^(.+)-([2-9]|[1-9][0-9]+)$"
NUMBERS = r"^(.+?)((?:-(?:[2-9]|[1-9][0-9]+))*)$"


def assign_slugs(new: DataFrame, existing: DataFrame, title: str = "title", order: str = "id") -> DataFrame:
    """``new`` with a ``slug`` column; ``existing`` has the slugs in use, ``order`` is the arrival number.

    Arrival numbers are unique whole numbers; a missing or repeated one is an error.
    """
    enable_checkpoints(new.sparkSession)
    # the titles are read once; all further work is on (root, arrival) pairs
    pairs = new.select(slugify(F.col(title)).alias("_root"), F.col(order).cast("bigint").alias("_at")).checkpoint()
    n, missing = pairs.agg(F.count(F.lit(1)), F.count_if(F.col("_at").isNull())).first()
    if missing or not pairs.groupBy("_at").count().filter("count > 1").isEmpty():
        raise ValueError(f"{order} must be there and unique for every product")
    ranked = running_count(pairs, ["_root"], "_at", out="_rank")
    roots = pairs.groupBy("_root").agg(F.min("_at").alias("_from"))

    used = _used_places(existing, roots).checkpoint()
    shared = _shared_names(roots, existing).checkpoint()
    taken = used
    if not shared.isEmpty():
        taken = used.unionByName(_lost_places(pairs, shared, used))
    if taken.isEmpty():
        placed = ranked.withColumn("_skips", F.lit(0))
    else:
        placed = _skip_taken(ranked, taken, n)
    place = F.col("_rank") + F.col("_skips")
    slug = F.when(place == 1, F.col("_root")).otherwise(F.concat_ws("-", "_root", place.cast("string")))
    return new.join(placed.select(F.col("_at").alias(order), slug.alias("slug")), order)


def _places(names: DataFrame) -> DataFrame:
    """Numbered names as places of the root before the number."""
    return names.withColumns(
        {
            "_root": F.regexp_extract("_name", NUMBERED, 1),
            "_place": F.regexp_extract("_name", NUMBERED, 2).try_cast("bigint"),
        }
    ).filter("_place IS NOT NULL")


def _used_places(existing: DataFrame, roots: DataFrame) -> DataFrame:
    """(_root, _place) in use by existing products, for the roots of the batch."""
    names = existing.select(F.col("slug").alias("_name")).distinct()
    plain = names.select(F.col("_name").alias("_root"), F.lit(1).cast("bigint").alias("_place"))
    places = plain.unionByName(_places(names).select("_root", "_place"))
    return places.join(roots.select("_root"), "_root", "left_semi")


def _shared_names(roots: DataFrame, existing: DataFrame) -> DataFrame:
    """Roots that are a place of another root of the batch, and free so far: (_root, _place, _name, _from)."""
    names = _places(roots.select(F.col("_root").alias("_name"), "_from"))
    free = names.join(existing.select(F.col("slug").alias("_name")).distinct(), "_name", "left_anti")
    return free.join(roots.select("_root"), "_root", "left_semi")


def _depth(root: Column) -> Column:
    """How many numbers a root ends in; a root of depth d competes for names with one of depth d - 1."""
    return F.size(F.split(F.regexp_extract(root, NUMBERS, 2), "-")) - 1


def _lost_places(pairs: DataFrame, shared: DataFrame, used: DataFrame) -> DataFrame:
    """(_root, _place) lost to a root that shares the name.

    The root before the number gets the name if it reaches that place before the other's first product arrives. When it
    gets there depends on the places it skipped on the way, and on whether a shorter root took its own plain name. So
    roots are decided by the count of numbers they end in, and the names of a root in the order of their places.
    """
    # products of the root that arrived before the first product of the name
    marks = shared.select("_root", F.col("_from").alias("_at"), "_name", "_place")
    products = pairs.join(shared.select("_root").distinct(), "_root", "left_semi").select(
        "_root", "_at", F.lit(None).cast("string").alias("_name"), F.lit(None).cast("bigint").alias("_place")
    )
    arrived = running_count(
        products.unionByName(marks).withColumn("_product", F.col("_name").isNull()), ["_root"], "_at", F.col("_product"), "_before"
    ).filter("NOT _product")
    fixed = used.join(shared.select("_root").distinct(), "_root", "left_semi").select(
        "_root", "_place", F.lit(None).cast("string").alias("_name"), F.lit(None).cast("bigint").alias("_before")
    )
    state = arrived.select("_root", "_place", "_name", "_before").unionByName(fixed)
    state = state.withColumn("_depth", _depth(F.col("_root"))).checkpoint()
    decided = None
    # a slug has room for a few dozen numbers at most
    for depth in sorted(r["_depth"] for r in state.select("_depth").distinct().collect()):
        rows = state.filter(F.col("_depth") == depth).drop("_depth")
        if decided is None:
            rows = rows.withColumn("_gone", F.lit(0))
        else:
            won = decided.filter("NOT _skip").select(F.col("_name").alias("_root"), F.lit(1).alias("_gone"))
            rows = rows.join(won, "_root", "left").withColumn("_gone", F.coalesce("_gone", F.lit(0)))
        done = _decided(rows).checkpoint()
        decided = done if decided is None else decided.unionByName(done)
    lost = decided.filter("_skip AND _name IS NOT NULL").select("_root", "_place")
    plain = decided.filter("NOT _skip").select(F.col("_name").alias("_root"), F.lit(1).cast("bigint").alias("_place"))
    return lost.unionByName(plain)


def _decided(rows: DataFrame) -> DataFrame:
    """(_root, _place, _name, _skip): which places a root must skip, place by place.

    The places are dealt out by ranges, each of which is decided in one go, given how many places its first root skipped
    before. That count comes from the range before; it is handed on until no range gets another one, at most as often as a root has
    ranges.
    """
    ship_package(rows.sparkSession)
    ranges = rows.repartitionByRange("_root", "_place").sortWithinPartitions("_root", "_place").checkpoint()
    entries: dict[int, int] = {}

    def decide(entries: dict[int, int], batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, list[bool], list]]:
        """Batches with their decisions, and (root, skipped places up to there) of every root that ends in them."""
        entry = entries.get(TaskContext.get().partitionId())
        current, skipped, first = None, 0, True
        for batch in batches:
            skips, ended = [], []
            columns = [batch.column(c).to_pylist() for c in ("_root", "_place", "_before", "_name", "_gone")]
            for root, place, before, name, gone in zip(*columns):
                if root != current:
                    if current is not None:
                        ended.append((current, skipped))
                    skipped = entry if first and entry is not None else gone
                    current, first = root, False
                skip = name is None or before < place - skipped
                skipped += skip
                skips.append(skip)
            yield batch, skips, ended
        yield None, [], [] if current is None else [(current, skipped)]

    while True:

        def edges(batches: Iterator[pa.RecordBatch], entries=entries) -> Iterator[pa.RecordBatch]:
            ends: list[tuple[str, int]] = []
            for _, _, ended in decide(entries, batches):
                ends += ended
                del ends[1:-1]  # only the first and the last root may go on elsewhere
            part = TaskContext.get().partitionId()
            yield pa.RecordBatch.from_arrays(
                [pa.array([part] * len(ends), pa.int32()), pa.array(range(len(ends)), pa.int32()),
                 pa.array([r for r, _ in ends], pa.string()), pa.array([n for _, n in ends], pa.int64())],
                names=["part", "nth", "root", "skipped"],
            )

        found, before = {}, None
        # two rows per range at most
        for r in sorted(ranges.mapInArrow(edges, "part int, nth int, root string, skipped bigint").collect()):
            if before is not None and r["nth"] == 0 and before["root"] == r["root"]:
                found[r["part"]] = before["skipped"]
            before = r
        if found == entries:
            break
        entries = found

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, skips, _ in decide(entries, batches):
            if batch is not None:
                kept = [batch.column(c) for c in ("_root", "_place", "_name")]
                yield pa.RecordBatch.from_arrays([*kept, pa.array(skips, pa.bool_())], names=["_root", "_place", "_name", "_skip"])

    return ranges.mapInArrow(choose, "_root string, _place bigint, _name string, _skip boolean")


def _skip_taken(ranked: DataFrame, taken: DataFrame, n: int) -> DataFrame:
    """Add how many taken places lie before each product's own."""
    reach = taken.count() + n  # no product gets beyond
    index = running_count(taken.filter(F.col("_place") <= reach), ["_root"], "_place", out="_index")
    # the rank whose product would have stood there
    marks = index.select("_root", F.lit(None).cast("bigint").alias("_at"), (F.col("_place") - F.col("_index") + 1).alias("_rank"))
    both = ranked.unionByName(marks.filter(F.col("_rank") <= n)).withColumn("_product", F.col("_at").isNotNull())
    counted = running_count(both, ["_root"], "_rank", ~F.col("_product"), "_skips", tie="_product")
    return counted.filter("_product")
