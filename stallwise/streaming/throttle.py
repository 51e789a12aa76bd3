"""The view throttle over a stream: the engine's state store holds the last counted view of each key.

Keys are dealt to lanes by a hash. A lane's state is one row with its live keys and their last counted views, so that Python is called
once per lane and not once per key; ``lanes`` sets how many keys share a row. An event-time time-out forgets a key once the watermark
has passed the gap after its last counted view: what still comes is later than that and counts in any case. So the state holds
the keys of the last ``gap`` and ``lateness`` only, and a restart goes on from the checkpoint.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F, types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from stallwise.session import ship_package


LANES = 256


def counted_places(times: list[int], a: int, b: int, last: int | None, gap: int) -> list[int]:
    """Of one key's times a to b, in order, the places of those that count after ``last``: the first, and each one more than
    ``gap`` after the one before."""
    places = []
    if last is not None:
        a = bisect_right(times, last + gap, a, b)
    while a < b:
        places.append(a)
        a = bisect_right(times, times[a] + gap, a, b)
    return places


def stream_throttled_views(
    views: DataFrame, keys: tuple[str, ...] = ("ip", "product_id"), gap_minutes: int = 30, lateness_minutes: int = 24 * 60,
    lanes: int = LANES,
) -> DataFrame:
    """Counted views (keys, ts) of a stream, to be written in append mode.

    A view older than one of its key counted in an earlier micro-batch does not count, nor one older than the watermark, which stays
    ``lateness_minutes`` behind the newest view. Views without a time do not count; missing key values are a value of their own. A
    lane's views of one micro-batch are put in order in one task, so a batch's size (``files_per_batch``) bounds its memory.
    """
    ship_package(views.sparkSession)
    gap = gap_minutes * 60_000_000
    timed = views.filter("ts IS NOT NULL").withWatermark("ts", f"{lateness_minutes} minutes")
    # a key as text, in which missing values show
    key = F.to_json(F.array(*(F.col(k).cast("string") for k in keys)))
    rows = timed.select(*keys, "ts", F.unix_micros("ts").alias("_at"), key.alias("_key"))
    rows = rows.withColumn("_lane", F.pmod(F.xxhash64("_key"), F.lit(lanes)).cast("int"))
    schema = T.StructType([rows.schema[k] for k in keys] + [T.StructField("_at", T.LongType())])

    def count(lane: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        live = dict(zip(*state.get)) if state.exists else {}
        if not state.hasTimedOut:
            batch = pd.concat(list(parts), ignore_index=True)
            codes, names = pd.factorize(batch["_key"])
            order = np.lexsort((batch["_at"].to_numpy(), codes))
            times = batch["_at"].to_numpy()[order].tolist()
            bounds = np.searchsorted(codes[order], np.arange(len(names) + 1)).tolist()
            picked: list[int] = []
            for name, a, b in zip(names, bounds, bounds[1:]):
                places = counted_places(times, a, b, live.get(name), gap)
                if places:
                    picked += places
                    live[name] = times[places[-1]]
            if picked:
                yield batch.iloc[order[picked]][schema.names]
        watermark = state.getCurrentWatermarkMs()
        live = {k: t for k, t in live.items() if (t + gap) // 1000 >= watermark}
        if live:
            state.update((list(live), list(live.values())))
            state.setTimeoutTimestamp(max((min(live.values()) + gap) // 1000, watermark) + 1)
        elif state.exists:
            state.remove()

    found = rows.groupBy("_lane").applyInPandasWithState(
        count, schema, "keys array<string>, last array<long>", "append", GroupStateTimeout.EventTimeTimeout
    )
    return found.select(*keys, F.timestamp_micros("_at").alias("ts"))
