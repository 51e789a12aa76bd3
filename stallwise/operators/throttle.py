"""Views that count: the first of a key, then each one more than a gap after the last *counted* one.

This is not a session window: a steady drip of views, each within the gap of the one before,
counts again and again. Views are dealt out by ranges of (key, time), so that a busy key (a crawler, a shared
address) is cut in time and no task holds more than its share. Each task goes through its range in
order; where a key's views go on from an earlier range, what must be known is the last view that counted there.

So the work is done in two steps over the same ranges. The first one reports, for the keys at the edges of a range,
which view counts last in it, for each moment from which views may count: a step function, which has few steps, since runs of counted
views soon meet. These reports, at most two per range, are followed from range to range. The second step counts.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, functions as F, types as T

from stallwise.session import enable_checkpoints, ship_package


def throttled_views(
    views: DataFrame, keys: tuple[str, ...] = ("ip", "product_id"), ts: str = "ts",
    gap_minutes: int = 30, last: DataFrame | None = None,
) -> DataFrame:
    """The counted views: one row (keys, ts) each.

    ``last`` (keys, ts) has the last counted view of keys seen before; views up to it, and within
    the gap after it, do not count. Missing key values are a value of their own; views without a time do not count.
    """
    spark = views.sparkSession
    enable_checkpoints(spark)
    ship_package(spark)
    gap = gap_minutes * 60_000_000
    at = views.select(*keys, F.unix_micros(F.col(ts)).alias("_at")).filter("_at IS NOT NULL").distinct()
    if last is None:
        at = at.withColumn("_seed", F.lit(None).cast("bigint"))
    else:
        names = {k: f"_last_{i}" for i, k in enumerate(keys)}
        seeds = last.groupBy(*keys).agg(F.max(F.unix_micros(F.col(ts))).alias("_seed")).withColumnsRenamed(names)
        same = reduce(Column.__and__, (F.col(k).eqNullSafe(F.col(names[k])) for k in keys))
        at = at.join(seeds, same, "left").drop(*names.values()).filter("_seed IS NULL OR _at > _seed")
    ranges = at.repartitionByRange(*keys, "_at").sortWithinPartitions(*keys, "_at").checkpoint()
    entries = _entries(ranges, keys, gap)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        entry = entries.get(TaskContext.get().partitionId())
        run, state = -1, None
        for batch, starts, fresh in _runs(batches, keys):
            times, seeds = batch.column("_at").to_pylist(), batch.column("_seed").to_pylist()
            picked = []
            for i, (a, b) in enumerate(zip(starts, [*starts[1:], len(times)])):
                if i or fresh:
                    run += 1
                    state = entry if run == 0 and entry is not None else seeds[a]
                while a < b:
                    if state is not None:
                        a = bisect_right(times, state + gap, a, b)
                    if a < b:
                        state = times[a]
                        picked.append(a)
                        a += 1
            yield batch.take(pa.array(picked, pa.int64())).drop_columns(["_seed"])

    schema = T.StructType([f for f in ranges.schema.fields if f.name != "_seed"])
    return ranges.mapInArrow(count, schema).select(*keys, F.timestamp_micros("_at").alias(ts))


def counted_per_product(counted: DataFrame, product: str = "product_id") -> DataFrame:
    return counted.groupBy(product).agg(F.count(F.lit(1)).alias("views"))


def _runs(batches: Iterator[pa.RecordBatch], keys: tuple[str, ...]) -> Iterator[tuple[pa.RecordBatch, list[int], bool]]:
    """(batch, first row of each key's run, whether the batch begins with a new key) of sorted batches."""
    before = None
    for batch in batches:
        if not batch.num_rows:
            continue
        change = np.zeros(batch.num_rows - 1, dtype=bool)
        for k in keys:
            c = batch.column(k)
            a, b = c.slice(1), c.slice(0, len(c) - 1)
            same = pc.fill_null(pc.equal(a, b), False)
            same = pc.or_(same, pc.and_(pc.is_null(a), pc.is_null(b)))
            change |= ~same.to_numpy(zero_copy_only=False)
        first = tuple(batch.column(k)[0].as_py() for k in keys)
        yield batch, [0, *(np.flatnonzero(change) + 1).tolist()], first != before
        before = tuple(batch.column(k)[batch.num_rows - 1].as_py() for k in keys)


def _steps(times: np.ndarray, gap: int) -> tuple[list[int], list[int]]:
    """Of a run of views: the last counted one, by the moment after which views may count.

    (limits, exits): where that moment is before ``limits[i]`` (and not before the limit ahead of it) the last
    counted view is ``exits[i]``; from the last limit on, none counts.
    """
    after = np.searchsorted(times, times + gap, side="right")
    end = np.where(after < len(times), after, np.arange(len(times)))
    while True:
        further = end[end]
        if (further == end).all():
            break
        end = further
    # an earlier range's counted view lies before this run, so views may count from its first gap on
    n = min(len(times), int(np.searchsorted(times, times[0] + gap, side="right")) + 1)
    exits = times[end[:n]]
    kept = np.flatnonzero(np.append(exits[1:] != exits[:-1], True))
    return times[kept].tolist(), exits[kept].tolist()


def _entries(ranges: DataFrame, keys: tuple[str, ...], gap: int) -> dict[int, int]:
    """The last counted view before each range that goes on with a key, by number of the range."""

    def edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: list[tuple[pa.RecordBatch, int | None, np.ndarray]] = []
        parts: list[np.ndarray] = []
        head = None

        def close() -> None:
            nonlocal parts
            if head is not None:
                del found[1:]  # only the first and the last run matter
                found.append((head, head.column("_seed")[0].as_py(), np.concatenate(parts)))
            parts = []

        for batch, starts, fresh in _runs(batches, keys):
            times = batch.column("_at").to_numpy()
            for i, (a, b) in enumerate(zip(starts, [*starts[1:], len(times)])):
                if i or fresh:
                    close()
                    head = batch.slice(a, 1)
                parts.append(times[a:b])
        close()
        for row, seed, times in found:
            limits, exits = _steps(times, gap)
            part = TaskContext.get().partitionId()
            yield pa.RecordBatch.from_arrays(
                [*(row.column(k) for k in keys), pa.array([part], pa.int32()), pa.array([seed], pa.int64()),
                 pa.array([limits], pa.list_(pa.int64())), pa.array([exits], pa.list_(pa.int64()))],
                names=[*keys, "_part", "_seed", "_limits", "_exits"],
            )

    def follow(rows: pd.DataFrame) -> pd.DataFrame:
        state, out = None, []
        for i, r in enumerate(rows.sort_values("_part").itertuples(index=False)):
            part, seed, limits, exits = r[-4:]
            if i == 0:
                state = None if pd.isna(seed) else int(seed)
            elif state is not None:
                out.append((part, state))
            at = 0 if state is None else bisect_right(limits, state + gap)
            state = int(exits[at]) if at < len(limits) else state
        return pd.DataFrame(out, columns=["part", "entry"])

    schema = T.StructType(
        [*(f for f in ranges.schema.fields if f.name in keys), *T.StructType.fromDDL(
            "_part int, _seed bigint, _limits array<bigint>, _exits array<bigint>").fields]
    )
    followed = ranges.mapInArrow(edges, schema).groupBy(*keys).applyInPandas(follow, "part int, entry bigint")
    return {r["part"]: r["entry"] for r in followed.collect()}  # one row per range at most
