"""Traffic: daily counters from page views, and the report built on them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from stallwise.functions.pricing import half_up
from stallwise.functions.text import day_label
from stallwise.functions.visits import page_kind, referrer_channel, utc_day, visitor_id


def counted_views(requests: DataFrame, path: str = "path") -> DataFrame:
    """Requests that are page views, with their ``kind``."""
    return requests.withColumn("kind", page_kind(F.col(path))).filter("kind IS NOT NULL")


def daily_hits(views: DataFrame) -> DataFrame:
    """Counter rows (day, kind, hits)."""
    counted = views.filter("kind IS NOT NULL")
    return counted.groupBy(utc_day(F.col("ts")).alias("day"), "kind").agg(F.count(F.lit(1)).alias("hits"))


def site_visitors(views: DataFrame, salt: str) -> DataFrame:
    """One row per (day, visitor)."""
    day = utc_day(F.col("ts"))
    who = visitor_id(F.col("ip"), F.col("user_agent"), day, salt)
    return views.filter("kind IS NOT NULL").select(day.alias("day"), who.alias("visitor")).dropDuplicates()


def daily_visitors(visitors: DataFrame, approximate: bool = False) -> DataFrame:
    """Unique visitors per day."""
    unique = F.approx_count_distinct("visitor") if approximate else F.count_distinct("visitor")
    return visitors.groupBy("day").agg(unique.alias("visitors"))


def daily_referrers(views: DataFrame, own_host: Column | str) -> DataFrame:
    """Counter rows (day, ref, hits)."""
    channel = referrer_channel(F.col("referer"), own_host)
    counted = views.filter("kind IS NOT NULL")
    return counted.groupBy(utc_day(F.col("ts")).alias("day"), channel.alias("ref")).agg(
        F.count(F.lit(1)).alias("hits")
    )


def hits_by_kind(hits: DataFrame) -> DataFrame:
    return hits.groupBy("kind").agg(F.sum("hits").alias("hits")).orderBy(F.col("hits").desc(), "kind")


def top_referrers(refs: DataFrame, n: int = 8) -> DataFrame:
    totals = refs.groupBy("ref").agg(F.sum("hits").alias("hits"))
    return totals.orderBy(F.col("hits").desc(), F.col("ref").asc()).limit(n)


def _newest(per_day: DataFrame, days: int | None) -> DataFrame:
    return per_day.orderBy(F.col("day").desc()).limit(days) if days else per_day


def traffic_series(hits: DataFrame, visitors: DataFrame, days: int | None = 30) -> DataFrame:
    """Hits and unique visitors of the newest days that had hits, in date order; all days if ``days`` is None."""
    per_day = _newest(hits.groupBy("day").agg(F.sum("hits").alias("hits")), days)
    unique = _newest(daily_visitors(visitors), days)
    joined = per_day.join(unique, "day", "left")
    return joined.select("day", "hits", F.coalesce("visitors", F.lit(0)).alias("visitors")).orderBy("day")


def traffic_summary(series: DataFrame, as_of: str) -> DataFrame:
    """Today, trailing sums and total of a series. Both ends of a trailing range count: since 7 days
    ago means 8 dates. ``as_of`` is a time in UTC, as text; only its date matters."""
    today = F.lit(as_of[:10])

    def since(n: int) -> Column:
        first = F.date_sub(F.to_date(today), n).cast("string")
        return F.coalesce(F.sum(F.when(F.col("day") >= first, F.col("hits"))), F.lit(0))

    is_today = F.col("day") == today
    return series.agg(
        F.coalesce(F.max(F.when(is_today, F.col("hits"))), F.lit(0)).alias("today"),
        F.coalesce(F.max(F.when(is_today, F.col("visitors"))), F.lit(0)).alias("today_visitors"),
        since(7).alias("week"),
        since(30).alias("month"),
        F.coalesce(F.sum("hits"), F.lit(0)).alias("total"),
    )


def trailing_sums(
    per_day: DataFrame, spans: tuple[int, ...] = (7, 30), keys: tuple[str, ...] = (), value: str = "hits"
) -> DataFrame:
    """Every day's trailing sums ``<value>_<n>``, for each key: since n days before, both ends counted, days without rows included.

    Rows are summed per key and day first, so a window holds one row per day, whatever the traffic.
    """
    daily = per_day.groupBy(*keys, "day").agg(F.sum(value).alias(value))
    number = F.datediff(F.to_date("day"), F.lit("1970-01-01").cast("date"))
    window = Window.partitionBy(*keys).orderBy(number)
    return daily.withColumns({f"{value}_{n}": F.sum(value).over(window.rangeBetween(-n, 0)) for n in spans})


def traffic_bars(series: DataFrame) -> DataFrame:
    """Chart of a series: bar heights as percentages of the busiest day, and the visitors' share.

    The peak is taken over the rows of the series, one per day.
    """
    peak = F.greatest(F.max("hits").over(Window.partitionBy()), F.lit(1))
    height = F.greatest(F.lit(2), half_up(F.col("hits") / peak * F.lit(100.0)))
    share = F.when(F.col("hits") != 0, half_up(F.col("visitors") / F.col("hits") * F.col("height")))
    return (
        series.withColumn("height", height)
        .withColumn("visitor_height", F.coalesce(share, F.lit(0)))
        .withColumn("label", day_label(F.to_date("day")))
    )


def merge_counters(counters: DataFrame, increments: DataFrame, keys: list[str], value: str = "hits") -> DataFrame:
    """Add increments to keyed counters; new keys start at their increment."""
    rows = counters.select(*keys, value).unionByName(increments.select(*keys, value))
    return rows.groupBy(*keys).agg(F.sum(value).alias(value))


def add_visitors(known: DataFrame, seen: DataFrame) -> DataFrame:
    """Union of known and newly seen (day, visitor) rows, each once."""
    return known.select("day", "visitor").unionByName(seen.select("day", "visitor")).dropDuplicates()
