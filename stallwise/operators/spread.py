"""Running counts within groups of any size.

A plain window over a group sorts the whole group in one task. Here the rows are dealt out by ranges of (group, order) that
follow the data, so a large group is cut, however its order values lie. Each range of each group is counted on its own, and
the counts of earlier ranges are added. A group has at most as many ranges as there are partitions, which is the
only per-group list ever formed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from stallwise.session import enable_checkpoints


def running_count(
    df: DataFrame, keys: list[str], order: str, counted: Column | None = None, out: str = "n", tie: str | None = None
) -> DataFrame:
    """Number of counted rows of the same group up to and including this one, by an order.

    Equal order values are told apart by ``tie``. Without ``counted`` every row counts, which gives the row number.
    """
    enable_checkpoints(df.sparkSession)
    by_order = [order, *([tie] if tie else [])]
    one = (counted if counted is not None else F.lit(True)).cast("bigint")
    # the ranges are written once, so that all that follows sees the same ones
    marked = (
        df.withColumn("_one", one).repartitionByRange(*keys, *by_order)
        .withColumn("_range", F.spark_partition_id()).checkpoint()
    )
    within = Window.partitionBy(*keys, "_range").orderBy(*by_order).rowsBetween(Window.unboundedPreceding, 0)
    earlier = Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    sums = marked.groupBy(*keys, "_range").agg(F.sum("_one").alias("_sum"))
    bases = sums.withColumn("_base", F.coalesce(F.sum("_sum").over(earlier), F.lit(0))).drop("_sum")
    local = marked.withColumn("_local", F.sum("_one").over(within))
    joined = local.join(bases, [*keys, "_range"])
    return joined.withColumn(out, F.col("_local") + F.col("_base")).drop("_range", "_one", "_local", "_base")
