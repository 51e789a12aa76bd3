"""Files in and out, and streams that must end where the batch jobs do."""

from __future__ import annotations

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F, types as T

from stallwise.operators import throttle as th, traffic as tr
from stallwise.schemas import ORDER_ITEM
from stallwise.session import fresh_dir
from stallwise.sources import tables
from stallwise.sources.bindings import SAMPLE_TABLES, sample
from stallwise.streaming import carts, counters, sinks, throttle
from test_operators import products, rows, settings

SF_DIR = "/root/testdata/sf0.001"


@pytest.mark.parametrize("fmt", ["parquet", "json", "csv", "orc"])
def test_tables(spark, tmp_path, fmt):
    p = products(spark, dict(id=1, images=["a.webp", "b,\"c.webp"], title='say "hi", all'), dict(id=2))
    tables.write_table(p, str(tmp_path / "products"), fmt, partition_by=("collection",) if fmt == "parquet" else ())
    back = tables.read_table(spark, "products", str(tmp_path / "products"), fmt)
    assert rows(back, "id", "title", "images", "price", "active", "created_at") == rows(
        p, "id", "title", "images", "price", "active", "created_at")


@pytest.mark.parametrize("name", list(SAMPLE_TABLES))
def test_sample_schemas(spark, name):
    declared = {f.name: f.dataType for f in sample(spark, SF_DIR, name).schema}
    found = {f.name: f.dataType for f in spark.read.parquet(f"{SF_DIR}/{name}.parquet").schema}
    assert declared == found


def test_hydrate(spark):
    texts = spark.createDataFrame([('[{"id":1,"qty":2}]',), ("[{",), (None,), ("[]",)], "v string")
    parsed = texts.select(tables.hydrate(F.col("v"), T.ArrayType(ORDER_ITEM)).alias("items"))
    assert [[(i.id, i.qty) for i in r["items"]] for r in parsed.collect()] == [[(1, 2)], [], [], []]


def test_added_columns(spark):
    older = spark.createDataFrame([(1, None), (2, 5)], "id int, stock int")
    assert rows(tables.add_missing_columns(older), "id", "stock", "discount_type", "active", "boost") == [
        (1, 1, "none", True, 0), (2, 5, "none", True, 0)]


START = datetime(2024, 1, 1)


@pytest.fixture(scope="module")
def view_files(spark, tmp_path_factory):
    """Views over six days in five files, in time order, plus the whole as a batch."""
    rnd = random.Random(3)
    data = []
    for i in range(1500):
        at = START + timedelta(seconds=rnd.randrange(6 * 86400))
        ip = "hot" if rnd.random() < 0.4 else f"ip{rnd.randrange(30)}"
        data.append((at, rnd.choice(["shop", "product", None]), ip, f"ua{rnd.randrange(3)}", 1 + rnd.randrange(3),
                     rnd.choice([None, "https://www.google.com/", "https://a.example/x"])))
    data.sort(key=lambda r: r[0])
    schema = "ts timestamp, kind string, ip string, user_agent string, product_id int, referer string"
    folder = tmp_path_factory.mktemp("views")
    for n in range(5):
        part = spark.createDataFrame(data[n * 300:(n + 1) * 300], schema)
        part.coalesce(1).write.mode("append").parquet(str(folder))
    return str(folder), spark.createDataFrame(data, schema)


def stream(spark, view_files):
    return sinks.read_files(spark, view_files[0], view_files[1].schema, files_per_batch=1)


def test_stream_hits(spark, view_files):
    out = fresh_dir(spark, "hits")
    query = sinks.start_counters(counters.stream_daily_hits(stream(spark, view_files)), f"{out}/rows", f"{out}/check")
    query.awaitTermination()
    schema = tr.daily_hits(view_files[1]).schema
    got = sinks.latest_counters(spark, f"{out}/rows", schema, ["day", "kind"])
    assert rows(got, "day", "kind", "hits") == rows(tr.daily_hits(view_files[1]), "day", "kind", "hits")


def test_stream_referrers(spark, view_files):
    out = fresh_dir(spark, "refs")
    counted = counters.stream_daily_referrers(stream(spark, view_files), "shop.example")
    sinks.start_counters(counted, f"{out}/rows", f"{out}/check").awaitTermination()
    got = sinks.latest_counters(spark, f"{out}/rows", counted.schema, ["day", "ref"])
    assert rows(got, "day", "ref", "hits") == rows(tr.daily_referrers(view_files[1], "shop.example"), "day", "ref", "hits")


def test_stream_visitors(spark, view_files):
    out = fresh_dir(spark, "visitors")
    seen = counters.stream_site_visitors(stream(spark, view_files), "salt")
    sinks.start_rows(seen, f"{out}/rows", f"{out}/check").awaitTermination()
    got = spark.read.parquet(f"{out}/rows")
    assert rows(got, "day", "visitor") == rows(tr.site_visitors(view_files[1], "salt"), "day", "visitor")


def run(df, out, **trigger):
    query = sinks.start_rows(df, f"{out}/rows", f"{out}/check", trigger or None)
    query.awaitTermination()
    return query


def test_stream_throttle(spark, view_files):
    out = fresh_dir(spark, "throttle")
    run(throttle.stream_throttled_views(stream(spark, view_files).filter("kind = 'product'")), out)
    batch = th.throttled_views(view_files[1].filter("kind = 'product'"))
    got = spark.read.parquet(f"{out}/rows")
    assert rows(got, "ip", "product_id", "ts") == rows(batch, "ip", "product_id", "ts")


def heaps(spark, folder, schema, *parts):
    for part in parts:
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(folder)


def test_stream_throttle_restarted(spark, tmp_path):
    """Stopped after two micro-batches and started again: the state goes on, and old keys are forgotten in time."""
    schema = "ip string, product_id int, ts timestamp"
    at = lambda ip, *minutes: [(ip, 1, START + timedelta(minutes=m)) for m in minutes]
    many = [v for n in range(50) for v in at(f"x{n}", 0, 10)]
    first, second = [at("a", 0, 20, 40) + at(None, 5) + many, at("a", 60, 71)], [at("a", 100, 102) + at(None, 34, 36), at("b", 500)]
    folder, out = str(tmp_path / "in"), fresh_dir(spark, "throttle")
    heaps(spark, folder, schema, *first)

    def go():
        views = sinks.read_files(spark, folder, spark.createDataFrame([], schema).schema, files_per_batch=1)
        return run(throttle.stream_throttled_views(views, lateness_minutes=60), out)

    query = go()
    assert max(p.stateOperators[0].numRowsTotal for p in query.recentProgress) > 30
    heaps(spark, folder, schema, *second)
    query = go()
    got = spark.read.parquet(f"{out}/rows").filter("ip IS NULL OR ip NOT LIKE 'x%'")
    minutes = sorted((r.ip or "", int((r.ts - START).total_seconds() // 60)) for r in got.collect())
    assert minutes == [("", 5), ("", 36), ("a", 0), ("a", 40), ("a", 71), ("a", 102), ("b", 500)]
    # at minute 500, less the hour of lateness, only the newest key's lane is left
    assert query.recentProgress[-1].stateOperators[0].numRowsTotal == 1


def test_counted_places():
    times = [0, 5, 10, 11, 20, 22, 40]
    count = lambda last, gap: [times[i] for i in throttle.counted_places(times, 0, len(times), last, gap)]
    assert count(None, 10) == [0, 11, 22, 40] and count(10, 10) == [22, 40] and count(100, 10) == []
    assert count(None, 0) == times and throttle.counted_places(times, 2, 3, None, 10) == [2]


def test_late_rows(spark, tmp_path):
    """Late is what closes no later than the newest time of the earlier micro-batches, less the allowance; counted as a metric."""
    rnd = random.Random(5)
    schema = "id long, ts timestamp"
    data = [[(100 * n + i, START + timedelta(hours=rnd.randrange(100))) for i in range(40)] for n in range(4)]
    heaps(spark, str(tmp_path / "in"), schema, *data)
    stream_in = sinks.read_files(spark, str(tmp_path / "in"), spark.createDataFrame([], schema).schema, files_per_batch=1)
    closing = stream_in.withColumn("closes", F.date_trunc("day", "ts") + F.expr("INTERVAL 1 DAY"))
    out = fresh_dir(spark, "late")
    query = run(sinks.late_rows(closing, "closes", "6 hours"), out)
    want, newest = [], None
    for heap in data:
        for i, ts in heap:
            closes = ts.replace(hour=0) + timedelta(days=1)
            if newest and closes <= newest - timedelta(hours=6):
                want.append((i,))
        newest = max([t for _, t in heap] + ([newest] if newest else []))
    assert want and rows(spark.read.parquet(f"{out}/rows"), "id") == sorted(want)
    assert sum(p.observedMetrics["late"].rows for p in query.recentProgress if p.observedMetrics) == len(want)


def test_throttle_goes_on(spark):
    """Views after the carried one: neither older ones nor those within the gap count."""
    at = lambda *minutes: [("a", 1, START + timedelta(minutes=m)) for m in minutes]
    schema = "ip string, product_id int, ts timestamp"
    carried = spark.createDataFrame(at(100) + [("c", 1, START)], schema)
    views = spark.createDataFrame(at(50, 99, 100, 130, 131, 150, 170) + [("b", 1, START)], schema)
    got = th.throttled_views(views, last=carried)
    assert rows(got, "ip", "ts") == [("a", START + timedelta(minutes=131)), ("a", START + timedelta(minutes=170)), ("b", START)]


def test_stream_carts(spark, tmp_path):
    """The store discount is looked up afresh for every micro-batch."""
    schema = "order_id bigint, pos int, product_id int, qty_raw int"
    for order in (1, 2):
        spark.createDataFrame([(order, 1, 1, 2)], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    offers = iter(["25", "50"])
    lines = sinks.read_files(spark, str(tmp_path / "in"), spark.createDataFrame([], schema).schema, files_per_batch=1)
    out = fresh_dir(spark, "carts")
    carts.start_priced_carts(
        lines, lambda: products(spark, dict(id=1)), lambda: settings(spark, next(offers)),
        f"{out}/rows", f"{out}/check",
    ).awaitTermination()
    got = spark.read.parquet(f"{out}/rows")
    assert sorted(r.price for r in got.collect()) == [500, 750] and got.select("order_id").distinct().count() == 2


def test_stream_carts_do_not_broadcast_the_catalogue(spark, tmp_path, monkeypatch):
    schema = "order_id bigint, pos int, product_id int, qty_raw int"
    spark.createDataFrame([(1, 1, 1, 2)], schema).write.parquet(str(tmp_path / "in"))
    lines = sinks.read_files(spark, str(tmp_path / "in"), spark.createDataFrame([], schema).schema)
    plans, price = [], carts.price_cart

    def watched(*args):
        priced = price(*args)
        plans.append(priced._jdf.queryExecution().executedPlan().toString())
        return priced

    monkeypatch.setattr(carts, "price_cart", watched)
    carts.start_priced_carts(
        lines, lambda: products(spark, dict(id=1)), lambda: settings(spark, "25"), str(tmp_path / "rows"), str(tmp_path / "check")
    ).awaitTermination()
    assert plans and all("SortMergeJoin" in p and "BroadcastHashJoin" not in p for p in plans)
