"""Traffic counters over a stream of page views."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from stallwise.functions.visits import referrer_channel, utc_day, visitor_id

LATENESS = "1 day"


def _day() -> Column:
    return F.window("ts", "1 day")


def _with_day(counted: DataFrame, *columns: str) -> DataFrame:
    return counted.select(utc_day(F.col("window.start")).alias("day"), *columns)


def stream_daily_hits(views: DataFrame, lateness: str = LATENESS) -> DataFrame:
    """Running (day, kind, hits); views later than the allowance are left out."""
    counted = views.filter("kind IS NOT NULL").withWatermark("ts", lateness)
    return _with_day(counted.groupBy(_day(), "kind").agg(F.count(F.lit(1)).alias("hits")), "kind", "hits")


def stream_daily_referrers(views: DataFrame, own_host: Column | str, lateness: str = LATENESS) -> DataFrame:
    """Running (day, ref, hits)."""
    channel = referrer_channel(F.col("referer"), own_host)
    counted = views.filter("kind IS NOT NULL").withColumn("ref", channel).withWatermark("ts", lateness)
    return _with_day(counted.groupBy(_day(), "ref").agg(F.count(F.lit(1)).alias("hits")), "ref", "hits")


def stream_site_visitors(views: DataFrame, salt: str, lateness: str = LATENESS) -> DataFrame:
    """(day, visitor) rows, each once, as visitors are first seen."""
    day = utc_day(F.col("ts"))
    who = visitor_id(F.col("ip"), F.col("user_agent"), day, salt)
    seen = views.filter("kind IS NOT NULL").select("ts", day.alias("day"), who.alias("visitor"))
    unique = seen.withWatermark("ts", lateness).dropDuplicatesWithinWatermark(["day", "visitor"])
    return unique.select("day", "visitor")
