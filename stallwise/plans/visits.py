"""Traffic queries, in batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from stallwise.functions import visits as vi
from stallwise.operators import daily_tables, sketches, throttle as th, traffic as tr
from stallwise.plans.registry import query
from stallwise.session import fresh_dir
from stallwise.sources.bindings import OWN_HOST, SALT, TRAFFIC_AS_OF, bind

VISITS = ("visits",)
VIEWS = ("page_views",)

DAY_SQL = "strftime(ts, '%Y-%m-%d')"
VISITOR_SQL = f"left(sha256(ip || '|' || user_agent || '|' || {DAY_SQL} || '{SALT}'), 32)"
HOST_SQL = r"regexp_replace(lower(regexp_extract(referer, '^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#:]+)', 1)), '^www\.', '')"
CHANNEL_SQL = f"""CASE WHEN referer IS NULL OR {HOST_SQL} = '' OR {HOST_SQL} = '{OWN_HOST}'
         OR {HOST_SQL} LIKE '%onrender.com' THEN 'direct'
    WHEN {HOST_SQL} LIKE '%whatsapp%' THEN 'WhatsApp' WHEN {HOST_SQL} LIKE '%instagram%' THEN 'Instagram'
    WHEN {HOST_SQL} LIKE '%facebook%' OR {HOST_SQL} LIKE '%fb.%' THEN 'Facebook'
    WHEN {HOST_SQL} LIKE '%google%' THEN 'Google' ELSE left({HOST_SQL}, 60) END"""

HITS_SQL = f"SELECT {DAY_SQL} AS day, kind, count(*) AS hits FROM visits WHERE kind IS NOT NULL GROUP BY ALL"
UNIQUE_SQL = f"""SELECT {DAY_SQL} AS day, count(DISTINCT {VISITOR_SQL}) AS visitors FROM visits
    WHERE kind IS NOT NULL GROUP BY ALL"""
REFS_SQL = f"SELECT {DAY_SQL} AS day, {CHANNEL_SQL} AS ref, count(*) AS hits FROM page_views WHERE kind IS NOT NULL GROUP BY ALL"


def visits(spark: SparkSession, sf: str) -> DataFrame:
    return bind(spark, sf, "visits")


@query("utc_day", f"SELECT event_id, {DAY_SQL} AS day FROM visits", VISITS)
def utc_day(spark, sf):
    return visits(spark, sf).select("event_id", vi.utc_day(F.col("ts")).alias("day"))


@query("visitor_hash", f"SELECT event_id, {VISITOR_SQL} AS visitor FROM visits", VISITS)
def visitor_hash(spark, sf):
    who = vi.visitor_id(F.col("ip"), F.col("user_agent"), vi.utc_day(F.col("ts")), SALT)
    return visits(spark, sf).select("event_id", who.alias("visitor"))


@query("referrer_channel", f"SELECT event_id, {CHANNEL_SQL} AS ref FROM page_views", VIEWS)
def referrer_channel(spark, sf):
    channel = vi.referrer_channel(F.col("referer"), OWN_HOST)
    return bind(spark, sf, "page_views").select("event_id", channel.alias("ref"))


@query("counted_pages", """SELECT event_id, CASE WHEN event_type IN ('view', 'purchase') THEN 'product'
       ELSE 'shop' END AS kind FROM events WHERE event_type IN ('view', 'purchase', 'click', 'signup')""")
def counted_pages(spark, sf):
    """Requests of pieces and the front page count; assets, the API, the admin and pings do not."""
    v = visits(spark, sf)
    other = F.element_at(
        F.array(*map(F.lit, ["/site.css", "/api/products", "/admin", "/ping", "/piece/", "/piece/a/b"])),
        (F.col("event_id") % 6 + 1).cast("int"),
    )
    path = (
        F.when(F.col("kind") == "product", F.concat(F.lit("/piece/p-"), F.col("product_id")))
        .when(F.col("kind") == "shop", "/").otherwise(other)
    )
    return tr.counted_views(v.withColumn("path", path)).select("event_id", "kind")


@query("daily_hits", HITS_SQL, VISITS)
def daily_hits(spark, sf):
    return tr.daily_hits(visits(spark, sf))


@query("distinct_visitors", f"SELECT DISTINCT {DAY_SQL} AS day, {VISITOR_SQL} AS visitor FROM visits WHERE kind IS NOT NULL",
       VISITS)
def distinct_visitors(spark, sf):
    return tr.site_visitors(visits(spark, sf), SALT)


@query("daily_visitors", UNIQUE_SQL, VISITS)
def daily_visitors(spark, sf):
    return tr.daily_visitors(tr.site_visitors(visits(spark, sf), SALT))


@query("daily_referrers", REFS_SQL, VIEWS)
def daily_referrers(spark, sf):
    return tr.daily_referrers(bind(spark, sf, "page_views"), OWN_HOST)


@query("hits_by_kind", "SELECT kind, count(*) AS hits FROM visits WHERE kind IS NOT NULL GROUP BY kind", VISITS)
def hits_by_kind(spark, sf):
    return tr.hits_by_kind(tr.daily_hits(visits(spark, sf)))


@query("top_referrers", f"""SELECT ref, CAST(sum(hits) AS BIGINT) AS hits FROM ({REFS_SQL}) r GROUP BY ref
       ORDER BY hits DESC, ref LIMIT 8""", VIEWS)
def top_referrers(spark, sf):
    return tr.top_referrers(tr.daily_referrers(bind(spark, sf, "page_views"), OWN_HOST))


SERIES_SQL = f"""SELECT h.day, CAST(h.hits AS BIGINT) AS hits, coalesce(u.visitors, 0) AS visitors
    FROM (SELECT day, sum(hits) AS hits FROM ({HITS_SQL}) d GROUP BY day ORDER BY day DESC LIMIT 30) h
    LEFT JOIN (SELECT * FROM ({UNIQUE_SQL}) d ORDER BY day DESC LIMIT 30) u ON u.day = h.day"""


def series(spark: SparkSession, sf: str, days: int | None = 30) -> DataFrame:
    v = visits(spark, sf)
    return tr.traffic_series(tr.daily_hits(v), tr.site_visitors(v, SALT), days)


@query("traffic_series", SERIES_SQL, VISITS)
def traffic_series(spark, sf):
    return series(spark, sf)


@query("traffic_summary", f"""
       SELECT CAST(coalesce(max(CASE WHEN day = '2024-01-30' THEN hits END), 0) AS BIGINT) AS today,
              CAST(coalesce(max(CASE WHEN day = '2024-01-30' THEN visitors END), 0) AS BIGINT) AS today_visitors,
              CAST(coalesce(sum(CASE WHEN day >= '2024-01-23' THEN hits END), 0) AS BIGINT) AS week,
              CAST(coalesce(sum(CASE WHEN day >= '2023-12-31' THEN hits END), 0) AS BIGINT) AS month,
              CAST(coalesce(sum(hits), 0) AS BIGINT) AS total FROM ({SERIES_SQL}) s""", VISITS)
def traffic_summary(spark, sf):
    return tr.traffic_summary(series(spark, sf), TRAFFIC_AS_OF)


@query("traffic_bars", f"""
       SELECT *, CAST(CASE WHEN hits = 0 THEN 0 ELSE floor(visitors * 1e0 / hits * height + 0.5e0) END AS BIGINT) AS visitor_height,
              strftime(CAST(day AS DATE), '%-d %b') AS label
       FROM (SELECT *, CAST(greatest(2, floor(hits * 1e0 / greatest(max(hits) OVER (), 1) * 100 + 0.5e0)) AS BIGINT) AS height
             FROM ({SERIES_SQL}) s) h""", VISITS)
def traffic_bars(spark, sf):
    return tr.traffic_bars(series(spark, sf))


@query("merge_counters", HITS_SQL, VISITS)
def merge_counters(spark, sf):
    """Counters up to the 20th with the later days' increments added; the 20th itself is in both."""
    v = visits(spark, sf)
    noon = F.lit("2024-01-20 12:00:00").cast("timestamp")
    old, new = tr.daily_hits(v.filter(F.col("ts") < noon)), tr.daily_hits(v.filter(F.col("ts") >= noon))
    return tr.merge_counters(old, new, ["day", "kind"])


@query("merge_visitors", f"SELECT DISTINCT {DAY_SQL} AS day, {VISITOR_SQL} AS visitor FROM visits WHERE kind IS NOT NULL",
       VISITS)
def merge_visitors(spark, sf):
    v = visits(spark, sf)
    noon = F.lit("2024-01-20 12:00:00").cast("timestamp")
    known, seen = tr.site_visitors(v.filter(F.col("ts") < noon), SALT), tr.site_visitors(v.filter(F.col("ts") >= noon), SALT)
    return tr.add_visitors(known, seen)


# ---- summaries and tables by day

@query("trailing_hits", f"""SELECT day, CAST(hits AS BIGINT) AS hits,
       CAST(sum(hits) OVER (ORDER BY d RANGE BETWEEN INTERVAL 7 DAY PRECEDING AND CURRENT ROW) AS BIGINT) AS hits_7,
       CAST(sum(hits) OVER (ORDER BY d RANGE BETWEEN INTERVAL 30 DAY PRECEDING AND CURRENT ROW) AS BIGINT) AS hits_30
       FROM (SELECT day, CAST(day AS DATE) AS d, sum(hits) AS hits FROM ({HITS_SQL}) h GROUP BY day) s""", VISITS)
def trailing_hits(spark, sf):
    return tr.trailing_sums(tr.daily_hits(visits(spark, sf)))


@query("trailing_hits_of_pieces", f"""SELECT product_id, day, hits,
       CAST(sum(hits) OVER (PARTITION BY product_id ORDER BY CAST(day AS DATE) RANGE BETWEEN INTERVAL 7 DAY PRECEDING AND CURRENT ROW)
            AS BIGINT) AS hits_7
       FROM (SELECT product_id, {DAY_SQL} AS day, count(*) AS hits FROM visits WHERE kind = 'product' GROUP BY ALL) s""", VISITS)
def trailing_hits_of_pieces(spark, sf):
    """Days on which a piece was not seen leave gaps."""
    seen = visits(spark, sf).filter("kind = 'product'").select("product_id", vi.utc_day(F.col("ts")).alias("day"), F.lit(1).alias("hits"))
    return tr.trailing_sums(seen, (7,), ("product_id",))


#: Three standard errors of a sketch of 2^12 registers, and one visitor.
CLOSE = 3 * 1.04 / 64


@query("trailing_visitors", f"""WITH seen AS (SELECT DISTINCT CAST({DAY_SQL} AS DATE) AS d, ip, user_agent FROM visits WHERE kind IS NOT NULL),
       days AS (SELECT DISTINCT d FROM seen),
       counted AS (SELECT a.d, count(DISTINCT CASE WHEN a.d - b.d <= 7 THEN ip || '|' || user_agent END) AS exact_7,
                          count(DISTINCT ip || '|' || user_agent) AS exact_30
                   FROM days a JOIN seen b ON b.d BETWEEN a.d - 30 AND a.d GROUP BY a.d)
       SELECT strftime(d, '%Y-%m-%d') AS day, exact_7, exact_30, true AS close_7, true AS close_30 FROM counted""", VISITS)
def trailing_visitors(spark, sf):
    """Estimates from daily sketches, of which those of the 20th come in two parts, held against the exact numbers."""
    v = visits(spark, sf)
    noon = F.lit("2024-01-20 12:00:00").cast("timestamp")
    known, new = (sketches.daily_sketches(v.filter(part), SALT) for part in (F.col("ts") < noon, F.col("ts") >= noon))
    estimates = sketches.trailing_visitors(sketches.merged_sketches(known, new))
    seen = v.filter("kind IS NOT NULL").select(
        F.to_date(vi.utc_day(F.col("ts"))).alias("_from"), F.concat_ws("|", "ip", "user_agent").alias("who")
    ).distinct()
    near = seen.select("_from", "who", F.explode(F.sequence("_from", F.date_add("_from", 30))).alias("_day"))
    within = F.when(F.datediff("_day", "_from") <= 7, F.col("who"))
    exact = near.groupBy(F.col("_day").cast("string").alias("day")).agg(
        F.count_distinct(within).alias("exact_7"), F.count_distinct("who").alias("exact_30")
    )
    return estimates.join(exact, "day").select("day", "exact_7", "exact_30", *(
        (F.abs(F.col(f"visitors_{n}") - F.col(f"exact_{n}")) <= 1 + CLOSE * F.col(f"exact_{n}")).alias(f"close_{n}") for n in (7, 30)
    ))


@query("commonest_referrers", f"""SELECT ref, CAST(sum(hits) AS BIGINT) AS hits FROM ({REFS_SQL}) r GROUP BY ref
       ORDER BY hits DESC, ref LIMIT 8""", VIEWS)
def commonest_referrers(spark, sf):
    channel = vi.referrer_channel(F.col("referer"), OWN_HOST).alias("ref")
    counted = bind(spark, sf, "page_views").filter("kind IS NOT NULL").select(channel)
    return sketches.commonest(counted, "ref")


@query("commonest_pieces", """SELECT product_id, count(*) AS hits FROM visits WHERE kind = 'product' GROUP BY product_id
       ORDER BY hits DESC, product_id LIMIT 8""", VISITS)
def commonest_pieces(spark, sf):
    """Fewer counters than pieces: what the summary leaves open is counted."""
    return sketches.commonest(visits(spark, sf).filter("kind = 'product'"), "product_id", capacity=32)


@query("counters_by_day", HITS_SQL, VISITS)
def counters_by_day(spark, sf):
    """A table by day, given the first twenty days, then the rest; the second batch comes twice."""
    v, path = visits(spark, sf), fresh_dir(spark, "counters")
    noon = F.lit("2024-01-20 12:00:00").cast("timestamp")
    for batch, part in ((0, F.col("ts") < noon), (1, F.col("ts") >= noon), (1, F.col("ts") >= noon)):
        daily_tables.upsert_counters(spark, path, tr.daily_hits(v.filter(part)), batch)
    return daily_tables.counters(spark, path, T.StructType.fromDDL("kind string"))


@query("visitors_by_day", f"SELECT DISTINCT {DAY_SQL} AS day, {VISITOR_SQL} AS visitor FROM visits WHERE kind IS NOT NULL", VISITS)
def visitors_by_day(spark, sf):
    v, path = visits(spark, sf), fresh_dir(spark, "visitors")
    noon = F.lit("2024-01-20 12:00:00").cast("timestamp")
    for part in (F.col("ts") < noon, F.col("ts") >= noon, F.col("ts") >= noon):
        daily_tables.upsert_visitors(spark, path, tr.site_visitors(v.filter(part), SALT))
    return daily_tables.visitors(spark, path)


# ---- throttled views: each step finds the next counted view of every key

def throttle_sql(keys: str, minutes: int, where: str) -> str:
    same = " AND ".join(f"v.{k} = c.{k}" for k in keys.split(", "))
    of_c = ", ".join(f"c.{k}" for k in keys.split(", "))
    return f"""WITH v AS (SELECT {keys}, epoch_us(ts) AS t FROM visits WHERE {where}),
        c AS (SELECT {keys}, min(t) AS t FROM v GROUP BY {keys}
              UNION ALL
              SELECT {of_c}, min(v.t) AS t FROM c JOIN v ON {same} AND v.t > c.t + {minutes * 60_000_000} GROUP BY {of_c})
        SELECT {keys}, t FROM c"""


def _throttled(keys: tuple[str, ...], minutes: int, product_pages: bool):
    def job(spark: SparkSession, sf: str) -> DataFrame:
        v = visits(spark, sf)
        v = v.filter("kind = 'product'") if product_pages else v.filter("kind IS NOT NULL")
        counted = th.throttled_views(v, keys, gap_minutes=minutes)
        return counted.select(*keys, F.unix_micros("ts").alias("t"))

    return job


for _name, _keys, _minutes, _pages in (
    ("throttled_views", ("ip", "product_id"), 30, True),
    ("throttled_views_by_visitor", ("ip", "user_agent"), 30, False),
    ("throttled_views_48h", ("ip", "user_agent"), 48 * 60, False),
    ("throttled_views_hot", ("user_agent",), 30, False),
    ("throttled_views_no_gap", ("ip", "product_id"), 0, True),
):
    query(_name, throttle_sql(", ".join(_keys), _minutes, "kind = 'product'" if _pages else "kind IS NOT NULL"),
          VISITS, recursive=True)(_throttled(_keys, _minutes, _pages))


@query("counted_views_per_product", f"""
       {throttle_sql("ip, product_id", 30, "kind = 'product'").replace("SELECT ip, product_id, t FROM c",
        "SELECT product_id, count(*) AS views FROM c GROUP BY product_id")}""", VISITS, recursive=True)
def counted_views_per_product(spark, sf):
    counted = th.throttled_views(visits(spark, sf).filter("kind = 'product'"))
    return th.counted_per_product(counted)
