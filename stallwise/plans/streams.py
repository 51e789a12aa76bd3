"""Streaming queries: run to the end of the input, then read what they wrote."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from stallwise.operators import traffic as tr
from stallwise.plans import visits as batch
from stallwise.plans.registry import query
from stallwise.session import fresh_dir
from stallwise.plans import carts as cart_plans
from stallwise.sources.bindings import OWN_HOST, SALT, TEXTS, bind, sample, settings
from stallwise.streaming import carts, counters, sinks, throttle


SLICES, FILES = 4, 2


def arriving(spark: SparkSession, table: DataFrame, slices: list[Column]) -> DataFrame:
    """A table as a stream that brings one slice of it per micro-batch, in the order given."""
    folder = fresh_dir(spark, "arriving")
    for part in slices:
        table.filter(part).repartition(FILES).write.mode("append").parquet(folder)
    return sinks.read_files(spark, folder, table.schema, files_per_batch=FILES)


def in_time() -> list[Column]:
    """Slices of January by weeks, the rest with the first and the last."""
    ts = F.col("ts")
    at = [F.lit(f"2024-01-{day:02d}").cast("timestamp_ntz") for day in (8, 15, 22)]
    return [ts < at[0], (ts >= at[0]) & (ts < at[1]), (ts >= at[1]) & (ts < at[2]), ts >= at[2]]


def stream_of(spark: SparkSession, sf: str, name: str, slices: list[Column] | None = None) -> DataFrame:
    """Page views as a stream of several micro-batches."""
    events = arriving(spark, sample(spark, sf, "events"), slices or in_time())
    text = TEXTS[name][0]
    return spark.sql(text, events=events, **({"pages": sample(spark, sf, "pages")} if "{pages}" in text else {}))


def run_counters(spark: SparkSession, counted: DataFrame, keys: list[str]) -> DataFrame:
    out = fresh_dir(spark, "counters")
    sinks.start_counters(counted, f"{out}/rows", f"{out}/checkpoint").awaitTermination()
    return sinks.latest_counters(spark, f"{out}/rows", counted.schema, keys)


def run_rows(spark: SparkSession, rows: DataFrame) -> DataFrame:
    out = fresh_dir(spark, "rows")
    sinks.start_rows(rows, f"{out}/rows", f"{out}/checkpoint").awaitTermination()
    return spark.read.schema(rows.schema).parquet(f"{out}/rows")


@query("stream_hits", batch.HITS_SQL, batch.VISITS)
def stream_hits(spark, sf):
    return run_counters(spark, counters.stream_daily_hits(stream_of(spark, sf, "visits")), ["day", "kind"])


@query("stream_visitors", batch.UNIQUE_SQL, batch.VISITS)
def stream_visitors(spark, sf):
    return tr.daily_visitors(run_rows(spark, counters.stream_site_visitors(stream_of(spark, sf, "visits"), SALT)))


@query("stream_referrers", batch.REFS_SQL, batch.VIEWS)
def stream_referrers(spark, sf):
    counted = counters.stream_daily_referrers(stream_of(spark, sf, "page_views"), OWN_HOST)
    return run_counters(spark, counted, ["day", "ref"])


@query("stream_throttled_views", batch.throttle_sql("ip, product_id", 30, "kind = 'product'"), batch.VISITS, recursive=True)
def stream_throttled_views(spark, sf):
    views = stream_of(spark, sf, "visits").filter("kind = 'product'")
    counted = run_rows(spark, throttle.stream_throttled_views(views))
    return counted.select("ip", "product_id", F.unix_micros("ts").alias("t"))


@query("stream_late_rows", """WITH seen AS (SELECT event_id, CAST(ts AS TIMESTAMP) AS ts, event_id % 4 AS n FROM events
           WHERE event_type IN ('view', 'purchase', 'click', 'signup')),
       clock AS (SELECT a.n, max(b.ts) - INTERVAL '1' DAY AS watermark FROM (SELECT DISTINCT n FROM seen) a JOIN seen b ON b.n < a.n GROUP BY a.n)
       SELECT event_id, n AS arrival FROM seen JOIN clock USING (n) WHERE date_trunc('day', ts) + INTERVAL '1' DAY <= watermark""")
def stream_late_rows(spark, sf):
    """Events that come in four heaps without order: what is too late for the daily counters is kept aside."""
    number = F.col("event_id") % 4
    views = stream_of(spark, sf, "visits", [number == n for n in range(4)]).filter("kind IS NOT NULL").select("event_id", "ts")
    closing = views.withColumn("closes", F.date_trunc("day", "ts") + F.expr("INTERVAL 1 DAY"))
    late = run_rows(spark, sinks.late_rows(closing, "closes", counters.LATENESS))
    return late.select("event_id", (F.col("event_id") % 4).cast("bigint").alias("arrival"))


@query("stream_priced_carts", f"""WITH {cart_plans.PRICED_SQL} SELECT order_id, pos, product_id, sku, title, price, list_price,
       discount_percent, qty FROM priced""", cart_plans.CART)
def stream_priced_carts(spark, sf):
    """Carts arrive in four heaps; prices and the store discount are looked up for each."""
    lines = bind(spark, sf, "cart_lines")
    stream = arriving(spark, lines, [F.col("order_id") % SLICES == n for n in range(SLICES)])
    out = fresh_dir(spark, "carts")
    products = lambda: bind(spark, sf, "products_base")
    carts.start_priced_carts(stream, products, lambda: settings(spark), f"{out}/rows", f"{out}/checkpoint").awaitTermination()
    rows = spark.read.parquet(f"{out}/rows").drop("batch", "trimmed")
    return rows.withColumn("pos", F.col("pos").cast("bigint"))
