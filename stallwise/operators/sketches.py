"""Bounded summaries: unique visitors of any span of days, and the commonest values of a column.

*Uniques.* A day's visitors are kept as one HyperLogLog sketch of a few kilobytes. Sketches merge, so the uniques of any span come from
the sketches of its days, without the visitors' rows; the relative standard error is about 1.04 / sqrt(2^lg_k).

*Commonest values.* Every task keeps at most ``capacity`` counters. When there are more values, all counters are lowered by the
same number and those at zero go, so a counter falls short of the truth by at most the sum of these cuts. A second count of the
values that may be among the first makes the result exact. Where the cuts leave it open (no value stands out), all values are counted
by a plain aggregation instead; the result is the same either way.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from stallwise.functions.visits import utc_day
from stallwise.session import ship_package

LG_K = 12
CAPACITY = 4096


# ---- unique visitors

def lasting_visitor(ip: Column, user_agent: Column, salt: str) -> Column:
    """A visitor's number on all days alike; it goes into sketches only, which do not give it back."""
    missing = F.lit("")
    return F.xxhash64(F.coalesce(ip, missing), F.lit("|"), F.coalesce(user_agent, missing), F.lit(salt))


def daily_sketches(views: DataFrame, salt: str, lg_k: int = LG_K) -> DataFrame:
    """(day, sketch) of the visitors of counted views, by partial aggregation: no shuffle of visitors."""
    who = lasting_visitor(F.col("ip"), F.col("user_agent"), salt)
    counted = views.filter("kind IS NOT NULL").select(utc_day(F.col("ts")).alias("day"), who.alias("visitor"))
    return counted.groupBy("day").agg(F.hll_sketch_agg("visitor", F.lit(lg_k)).alias("sketch"))


def merged_sketches(known: DataFrame, new: DataFrame) -> DataFrame:
    """Days' sketches with later ones added; adding the same ones again changes nothing."""
    return known.unionByName(new).groupBy("day").agg(F.hll_union_agg("sketch").alias("sketch"))


def span_visitors(sketches: DataFrame, first_day: str, last_day: str) -> DataFrame:
    """Unique visitors from one day to another, both counted; one row."""
    inside = sketches.filter(F.col("day").between(first_day, last_day))
    return inside.agg(F.coalesce(F.hll_sketch_estimate(F.hll_union_agg("sketch")), F.lit(0)).alias("visitors"))


def trailing_visitors(sketches: DataFrame, spans: tuple[int, ...] = (7, 30)) -> DataFrame:
    """For every day that has a sketch, and each span, ``visitors_<n>``: the uniques since n days before, as the trailing sums count.

    Each day's sketch is sent to the days it counts for, at most ``max(spans) + 1`` of them; partial unions meet before the shuffle.
    """
    day = F.to_date("day")
    sent = sketches.select(
        day.alias("_from"), F.explode(F.sequence(day, F.date_add(day, max(spans)))).alias("_day"), "sketch"
    )
    known = sketches.select(day.alias("_day"), "day")
    unions = [
        F.hll_sketch_estimate(F.hll_union_agg(F.when(F.datediff("_day", "_from") <= n, F.col("sketch")))).alias(f"visitors_{n}")
        for n in spans
    ]
    return sent.join(known, "_day").groupBy("day").agg(*unions)


# ---- commonest values

def counted_summary(values: DataFrame, column: str, capacity: int = CAPACITY) -> DataFrame:
    """Rows (value, n, cut): of every task its counters, and one row without a value that holds the sum of its cuts."""
    value_type = values.schema[column].dataType
    schema = T.StructType([T.StructField("value", value_type), T.StructField("n", T.LongType()), T.StructField("cut", T.LongType())])
    ship_package(values.sparkSession)

    def summarise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counters, cut, kind = {}, 0, None
        for batch in batches:
            kind = batch.column(0).type
            found = pc.value_counts(batch.column(0).drop_null())
            for value, n in zip(found.field("values").to_pylist(), found.field("counts").to_pylist()):
                counters[value] = counters.get(value, 0) + n
            if len(counters) > capacity:
                lower = sorted(counters.values(), reverse=True)[capacity]
                counters = {v: n - lower for v, n in counters.items() if n > lower}
                cut += lower
        if kind is not None:
            names, counts = [*counters, None], [*counters.values(), 0]
            cuts = [0] * len(counters) + [cut]
            yield pa.RecordBatch.from_arrays(
                [pa.array(names, kind), pa.array(counts, pa.int64()), pa.array(cuts, pa.int64())], names=schema.names
            )

    return values.select(column).mapInArrow(summarise, schema)


def commonest(values: DataFrame, column: str, n: int = 8, capacity: int = CAPACITY) -> DataFrame:
    """The ``n`` commonest values of a column with their exact counts (column, hits); equally common ones by value. NULLs do not count.

    ``values`` is read twice, or three times where no value stands out.
    """
    spark: SparkSession = values.sparkSession
    known = values.filter(F.col(column).isNotNull()).select(column)
    summary = counted_summary(known, column, capacity).groupBy("value").agg(F.sum("n").alias("n"), F.sum("cut").alias("cut")).persist()
    try:
        cut = summary.agg(F.coalesce(F.sum("cut"), F.lit(0))).first()[0]
        first = summary.filter("value IS NOT NULL").orderBy(F.col("n").desc()).limit(n).collect()
        # a value without a counter occurs at most ``cut`` times; the last of the first n occurs at least ``sure`` times
        sure = first[-1].n if len(first) == n else 0
        if cut and sure <= cut:
            rows = known
        else:
            close = [r.value for r in summary.filter((F.col("n") >= sure - cut) & F.col("value").isNotNull()).limit(n * capacity + 1).collect()]
            few = spark.createDataFrame([(v,) for v in close], T.StructType([T.StructField(column, values.schema[column].dataType)]))
            rows = known if len(close) > n * capacity else known.join(F.broadcast(few), column, "left_semi")
    finally:
        summary.unpersist()
    counted = rows.groupBy(column).agg(F.count(F.lit(1)).alias("hits"))
    return counted.orderBy(F.col("hits").desc(), F.col(column).asc()).limit(n)
