"""Counters and visitors kept on files by day: an upsert reads and rewrites the days it touches, all others keep their files.

A table is a Parquet folder partitioned by ``day``. An upsert writes whole days anew with dynamic partition overwrite, which puts the new
files in place when the job has ended. A counter row remembers its value before the last batch that changed it, so the same
batch applied again, after a crash say, gives the same table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from stallwise.operators.traffic import add_visitors


def _with_day(schema: T.StructType) -> T.StructType:
    """The day as text, and last, where a partitioned folder has it."""
    return T.StructType([*(f for f in schema.fields if f.name != "day"), T.StructField("day", T.StringType())])


def _touched(spark: SparkSession, path: str, schema: T.StructType, rows: DataFrame) -> DataFrame:
    """The table's rows of the days that occur in ``rows``; their folders only are read."""
    days = [r.day for r in rows.select("day").distinct().collect()]  # a batch brings few days
    try:
        table = spark.read.schema(schema).parquet(path)
    except Exception as missing:
        if "PATH_NOT_FOUND" not in str(missing):
            raise
        table = spark.createDataFrame([], schema)
    return table.where(F.col("day").isin(days))


def _replace_days(rows: DataFrame, path: str) -> None:
    by_day = rows.repartition("day", F.pmod(F.xxhash64(*rows.columns), F.lit(8)))  # a busy day may go to several files
    by_day.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("day").parquet(path)


def upsert_counters(
    spark: SparkSession, path: str, increments: DataFrame, batch: int, keys: tuple[str, ...] = ("kind",), value: str = "hits"
) -> None:
    """Add (day, keys, value) increments to a table of counters; new keys start at their increment.

    ``batch`` numbers the calls. The newest batch may be repeated with the same increments; older ones may not.
    """
    added = increments.groupBy("day", *keys).agg(F.sum(value).cast("bigint").alias("_added"))
    fields = [added.schema[k] for k in keys] + [T.StructField(c, T.LongType()) for c in (value, "batch", "before")]
    schema = _with_day(T.StructType(fields))
    old = _touched(spark, path, schema, increments).withColumn("_added", F.lit(None).cast("bigint"))
    new = added.select(*keys, *(F.lit(None).cast("bigint").alias(c) for c in (value, "batch", "before")), "day", "_added")
    merged = old.unionByName(new).groupBy("day", *keys).agg(*(F.max(c).alias(c) for c in (value, "batch", "before", "_added")))
    # what stood before this batch: where it was applied already, the remembered value
    base = F.coalesce(F.when(F.col("batch") == batch, F.col("before")).otherwise(F.col(value)), F.lit(0))
    changed = F.col("_added").isNotNull()
    rows = merged.select(
        *keys, F.when(changed, base + F.col("_added")).otherwise(F.col(value)).alias(value),
        F.when(changed, F.lit(batch)).otherwise(F.col("batch")).cast("bigint").alias("batch"),
        F.when(changed, base).otherwise(F.col("before")).alias("before"), "day",
    )
    _replace_days(rows, path)


def counters(spark: SparkSession, path: str, keys: T.StructType, value: str = "hits") -> DataFrame:
    """The counters (day, keys, value) as they are now; a filter on ``day`` reads its folders only."""
    schema = _with_day(T.StructType([*keys.fields, T.StructField(value, T.LongType())]))
    return spark.read.schema(schema).parquet(path).select("day", *keys.names, value)


def upsert_visitors(spark: SparkSession, path: str, seen: DataFrame) -> None:
    """Add (day, visitor) rows to a table that holds each once."""
    schema = T.StructType.fromDDL("visitor string, day string")
    known = _touched(spark, path, schema, seen)
    _replace_days(add_visitors(known, seen).select("visitor", "day"), path)


def visitors(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("visitor string, day string").parquet(path).select("day", "visitor")
