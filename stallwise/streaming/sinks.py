"""Streaming input from files and restart-safe output to files.

Changed counters of a micro-batch go to a folder named by its number, so a repeated batch overwrites itself; the row of the newest
batch counts. Plain rows go to the engine's own file sink. What must be remembered between micro-batches (times of
last views, counts, the watermark) is kept by the engine: state store, timeouts and watermark, all in the query's checkpoint.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T
from pyspark.sql.streaming import DataStreamWriter, StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from stallwise.session import ship_package

#: What to run when a call names no trigger: work off what is there, then stop.
ALL_THERE_IS = {"availableNow": True}
#: Groups that rows are dealt to where they only have to meet the watermark.
LANES = 64


def read_files(spark: SparkSession, path: str, schema: T.StructType, files_per_batch: int | None = None) -> DataFrame:
    """Parquet files as a stream; ``files_per_batch`` bounds how much one micro-batch takes in."""
    reader = spark.readStream.schema(schema)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(path)


def started(writer: DataStreamWriter, checkpoint: str, trigger: dict | None) -> StreamingQuery:
    """Start with ``trigger`` as in ``DataStreamWriter.trigger``: ``{"processingTime": "1 minute"}``, say."""
    return writer.option("checkpointLocation", checkpoint).trigger(**(trigger or ALL_THERE_IS)).start()


def start_counters(counters: DataFrame, out: str, checkpoint: str, trigger: dict | None = None) -> StreamingQuery:
    """Write the changed counters of every micro-batch; each row holds the whole count so far, so a restart neither loses nor
    doubles anything. Read back with ``latest_counters``."""

    def write(rows: DataFrame, batch_id: int) -> None:
        rows.write.mode("overwrite").parquet(f"{out}/batch={batch_id}")

    return started(counters.writeStream.outputMode("update").foreachBatch(write), checkpoint, trigger)


def latest_counters(spark: SparkSession, out: str, schema: T.StructType, keys: list[str]) -> DataFrame:
    """The counters as they are now: of each key the row of the newest batch, by partial aggregation."""
    values = [f.name for f in schema.fields if f.name not in keys]
    rows = spark.read.schema(T.StructType(schema.fields + [T.StructField("batch", T.LongType())])).parquet(out)
    newest = rows.groupBy(*keys).agg(F.max_by(F.struct(*values), "batch").alias("_row"))
    return newest.select(*keys, "_row.*").select(*schema.names)


def start_rows(rows: DataFrame, out: str, checkpoint: str, trigger: dict | None = None) -> StreamingQuery:
    """Append result rows to a parquet folder, each exactly once."""
    return started(rows.writeStream.outputMode("append").format("parquet").option("path", out), checkpoint, trigger)


def late_rows(rows: DataFrame, closes: str, lateness: str, ts: str = "ts") -> DataFrame:
    """The rows of a stream that come too late to be counted: the moment ``closes`` at which their window closes is not after the
    watermark, which the engine keeps from ``ts`` and ``lateness``. Their number is the observed metric ``late``, as ``rows``.

    A side output next to the counters' own query. Rows pass by in lanes that a hash deals out; nothing is remembered per row, and
    without a time-out the engine leaves late rows in.
    """
    ship_package(rows.sparkSession)
    schema = rows.schema

    def too_late(lane: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        watermark = pd.Timestamp(state.getCurrentWatermarkMs(), unit="ms")
        for part in parts:
            closing = part[closes]
            if closing.dt.tz is not None:
                closing = closing.dt.tz_convert("UTC").dt.tz_localize(None)
            yield part.loc[closing <= watermark, schema.names]

    lane = F.pmod(F.xxhash64(*rows.columns), F.lit(LANES)).cast("int")
    dealt = rows.withWatermark(ts, lateness).withColumn("_lane", lane).groupBy("_lane")
    found = dealt.applyInPandasWithState(too_late, schema, "seen boolean", "append", GroupStateTimeout.NoTimeout)
    return found.observe("late", F.count(F.lit(1)).alias("rows"))
