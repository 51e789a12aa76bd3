"""Two tables cut into the same buckets by a key, so that joining them again and again needs no shuffle.

The larger table (many rows of a key) and the smaller one (one row of a key) are written in ``buckets`` files each, sorted by key; a join reads
bucket by bucket. A key with more than a bucket's share of the rows is dealt over several shares by a hash of its rows, and the
row it meets is written once for each share. Fewer than ``buckets`` keys can be that frequent, which bounds what is sent to every task.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from stallwise.session import fresh_dir

SHARE = "share"


@dataclass(frozen=True)
class Colocated:
    """Names of the two tables; join them on ``on``."""

    many: str
    one: str
    on: tuple[str, str]


def hot_keys(spark: SparkSession, many: DataFrame, key: str, buckets: int) -> DataFrame:
    """(key, shares) of the keys that have more than a bucket's share of the rows; fewer than ``buckets`` rows."""
    counts = many.where(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("n"))
    total = many.count()
    hot = counts.where(F.col("n") * buckets > total).select(key, F.ceil(F.col("n") * buckets / F.lit(max(total, 1))).cast("int").alias("shares"))
    return spark.createDataFrame(hot.collect(), T.StructType([many.schema[key], T.StructField("shares", T.IntegerType())]))


def _stored(spark: SparkSession, df: DataFrame, key: str, buckets: int, label: str, folder: str | None) -> str:
    name, path = f"{label}_{uuid.uuid4().hex}", folder or fresh_dir(spark, label)
    # the same hash as that of the buckets: each task writes one file
    dealt = df.repartition(buckets, key, SHARE)
    dealt.write.bucketBy(buckets, key, SHARE).sortBy(key, SHARE).option("path", path).mode("errorifexists").saveAsTable(name)
    return name


def store(
    spark: SparkSession, many: DataFrame, one: DataFrame, key: str, *, buckets: int = 200, folders: tuple[str, str] | None = None
) -> Colocated:
    """Write both tables by ``key``, which has one type in both and is unique in ``one``.

    Rows without a key meet nothing and are left out. Both get a column ``share``, which takes the place of one of that name. ``folders``
    are two new paths; without them the tables go to the shared folder and end with the session.
    """
    if many.schema[key].dataType != one.schema[key].dataType:
        raise TypeError(f"{key} is {many.schema[key].dataType} in one table and {one.schema[key].dataType} in the other")
    many, one = (df.drop(SHARE).where(F.col(key).isNotNull()) for df in (many, one))
    hot = F.broadcast(hot_keys(spark, many, key, buckets))
    dealt = F.pmod(F.xxhash64(*many.columns), F.coalesce("shares", F.lit(1))).cast("int")
    spread = many.join(hot, key, "left").select(*many.columns, dealt.alias(SHARE))
    copies = F.explode(F.sequence(F.lit(0), F.coalesce("shares", F.lit(1)) - 1))
    copied = one.join(hot, key, "left").select(*one.columns, copies.alias(SHARE))
    paths = folders or (None, None)
    return Colocated(
        _stored(spark, spread, key, buckets, "many", paths[0]), _stored(spark, copied, key, buckets, "one", paths[1]), (key, SHARE)
    )


def reopen(spark: SparkSession, folder: str, schema: T.StructType, key: str, buckets: int) -> str:
    """Name a folder that an earlier session stored; ``schema`` is that of the stored table, with its ``share``."""
    name = f"stored_{uuid.uuid4().hex}"
    columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema.fields)
    spark.sql(
        f"CREATE TABLE {name} ({columns}) USING parquet CLUSTERED BY (`{key}`, `{SHARE}`) SORTED BY (`{key}`, `{SHARE}`) "
        f"INTO {buckets} BUCKETS LOCATION '{folder}'"
    )
    return name
