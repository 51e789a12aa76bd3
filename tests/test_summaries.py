"""Sketches, commonest values, trailing sums and tables by day, each against a plain count."""

from __future__ import annotations

import random
from collections import Counter
from datetime import date, datetime, timedelta

import pytest
from pyspark.sql import functions as F, types as T

from stallwise.operators import daily_tables, sketches, traffic as tr
from test_operators import rows

START = datetime(2024, 1, 1)


def test_trailing_sums_count_gaps_as_days(spark):
    rnd = random.Random(1)
    data = [(rnd.choice("ab"), str(date(2024, 2, 20) + timedelta(days=rnd.randrange(60))), rnd.randrange(9)) for _ in range(80)]
    got = tr.trailing_sums(spark.createDataFrame(data, "k string, day string, hits int"), (2, 30), ("k",))
    for r in got.collect():
        for n, total in ((2, r.hits_2), (30, r.hits_30)):
            first = str(date.fromisoformat(r.day) - timedelta(days=n))
            assert total == sum(h for k, d, h in data if k == r.k and first <= d <= r.day)
    assert got.count() == len({d[:2] for d in data})
    assert tr.trailing_sums(spark.createDataFrame([], "k string, day string, hits int")).collect() == []


@pytest.fixture(scope="module")
def views(spark):
    rnd = random.Random(2)
    data = [
        (START + timedelta(days=rnd.choice([0, 1, 2, 5, 6, 14, 15]), seconds=rnd.randrange(86400)), rnd.choice(["shop", "product", None]),
         rnd.choice([None, *(f"ip{i}" for i in range(700))]), f"ua{rnd.randrange(3)}")
        for _ in range(6000)
    ]
    return data, spark.createDataFrame(data, "ts timestamp, kind string, ip string, user_agent string")


def test_uniques_of_any_span(spark, views):
    data, df = views
    who = {}
    for ts, kind, ip, agent in data:
        if kind:
            who.setdefault(ts.date(), set()).add((ip, agent))
    daily = sketches.daily_sketches(df, "salt")
    twice = sketches.merged_sketches(daily, sketches.daily_sketches(df.limit(500), "salt"))
    for first, last in ((0, 0), (0, 6), (1, 20), (7, 13)):
        days = [START.date() + timedelta(days=d) for d in range(first, last + 1)]
        exact = len(set().union(*(who.get(d, set()) for d in days)))
        got = sketches.span_visitors(twice, str(days[0]), str(days[-1])).first().visitors
        assert abs(got - exact) <= 0.05 * exact
    for r in sketches.trailing_visitors(twice, (1, 7)).collect():
        day = date.fromisoformat(r.day)
        for n, got in ((1, r.visitors_1), (7, r.visitors_7)):
            exact = len(set().union(*(who.get(day - timedelta(days=d), set()) for d in range(n + 1))))
            assert abs(got - exact) <= 0.05 * exact
    assert twice.count() == len(who)


@pytest.mark.parametrize("capacity", [4, 16, 64, 10_000])
@pytest.mark.parametrize("shape", ["steep", "flat", "tied", "few", "none"])
def test_commonest_values_are_exact(spark, capacity, shape):
    rnd = random.Random(3)
    data = {
        "steep": [f"v{int(rnd.paretovariate(0.7))}" for _ in range(5000)], "flat": [f"v{rnd.randrange(900)}" for _ in range(5000)],
        "tied": [f"v{i % 50}" for i in range(5000)], "few": ["a"] * 9 + ["b"] * 9 + [None] * 50, "none": [None, None],
    }[shape]
    df = spark.createDataFrame([(v,) for v in data], "v string").repartition(6)
    want = sorted(Counter(v for v in data if v is not None).items(), key=lambda x: (-x[1], x[0]))[:8]
    assert [tuple(r) for r in sketches.commonest(df, "v", 8, capacity).collect()] == want


def test_a_task_keeps_few_counters(spark):
    df = spark.range(20_000).select((F.col("id") * F.col("id") % 7919).alias("v")).repartition(3)
    summary = sketches.counted_summary(df, "v", 50)
    kept = summary.where("value IS NOT NULL")
    assert kept.count() <= 3 * 50 and summary.agg(F.sum("cut")).first()[0] > 0
    # a counter and all cuts together are no less than the truth, and a counter alone no more
    true = dict(df.groupBy("v").count().collect())
    cut = summary.agg(F.sum("cut")).first()[0]
    for value, n in kept.groupBy("value").agg(F.sum("n")).collect():
        assert n <= true[value] <= n + cut


def files(folder):
    return {p.relative_to(folder).as_posix(): p.stat().st_mtime_ns for p in folder.rglob("*.parquet")}


def test_counters_by_day(spark, tmp_path):
    path, folder = str(tmp_path / "t"), tmp_path / "t"
    keys = T.StructType.fromDDL("kind string")

    def add(batch, *increments):
        daily_tables.upsert_counters(spark, path, spark.createDataFrame(increments, "day string, kind string, hits long"), batch)
        return rows(daily_tables.counters(spark, path, keys), "day", "kind", "hits")

    first = add(0, ("2024-01-01", "shop", 5), ("2024-01-02", "shop", 1), ("2024-01-02", None, 2), ("2024-01-02", "shop", 1))
    assert first == sorted([("2024-01-01", "shop", 5), ("2024-01-02", "shop", 2), ("2024-01-02", None, 2)], key=repr)
    before = files(folder)
    second = [("2024-01-02", "shop", 10), ("2024-01-03", "product", 3)]
    once = add(1, *second)
    after = files(folder)
    untouched = {n for n in before if n.startswith("day=2024-01-01")}
    assert untouched and all(after[n] == before[n] for n in untouched)
    assert not {n for n in before if n.startswith("day=2024-01-02")} & set(after)
    assert add(1, *second) == once
    assert ("2024-01-02", "shop", 12) in once and ("2024-01-02", None, 2) in once and len(once) == 4
    assert ("2024-01-02", "shop", 13) in add(2, ("2024-01-02", "shop", 1))


def test_visitors_by_day(spark, tmp_path):
    path, folder = str(tmp_path / "t"), tmp_path / "t"

    def add(*seen):
        daily_tables.upsert_visitors(spark, path, spark.createDataFrame(seen, "day string, visitor string"))
        return rows(daily_tables.visitors(spark, path), "day", "visitor")

    add(("2024-01-01", "a"), ("2024-01-01", "a"), ("2024-01-02", "a"))
    before = files(folder)
    want = sorted([("2024-01-01", "a"), ("2024-01-02", "a"), ("2024-01-02", "b")])
    assert add(("2024-01-02", "b"), ("2024-01-02", "a")) == want == add(("2024-01-02", "b"))
    assert all(files(folder).get(n) == t for n, t in before.items() if n.startswith("day=2024-01-01"))
