"""Sequential rules against a plain one-by-one simulation."""

from __future__ import annotations

import random
from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from stallwise.operators.slugs import assign_slugs
from stallwise.operators.spread import running_count
from stallwise.operators.throttle import throttled_views


def one_by_one(titles: list[tuple[int, str]], taken: set[str]) -> dict[int, str]:
    out = {}
    taken = set(taken)
    for number, title in sorted(titles):
        root = "-".join(title.lower().split())
        slug, n = root, 1
        while slug in taken:
            n += 1
            slug = f"{root}-{n}"
        taken.add(slug)
        out[number] = slug
    return out


@pytest.mark.parametrize("seed", range(4))
def test_slugs(spark, seed):
    rnd = random.Random(seed)
    pool = ["red bolt", "red bolt 2", "red bolt 3", "red bolt 2 2", "red bolt 2 3", "red bolt 02", "red bolt 10",
            "ring", "ring 2", "ring 5", "ring 6", "ring 2 2 2", "ring 1", "lamp 4"]
    titles = [(i * 3 + 1, rnd.choice(pool[: 4 + 3 * (seed + 1)])) for i in range(150)]
    taken = set() if seed == 0 else {"red-bolt-4", "ring", "ring-3", "ring-2-2", "lamp-4", "red-bolt-2-5", "other"}
    new = spark.createDataFrame(titles, "id bigint, title string")
    existing = spark.createDataFrame([(s,) for s in taken], "slug string")
    got = {r.id: r.slug for r in assign_slugs(new, existing).collect()}
    assert got == one_by_one(titles, taken)


def test_slugs_without_clashes(spark):
    titles = [(i, random.Random(i).choice(["red bolt", "ring"])) for i in range(60)]
    got = assign_slugs(spark.createDataFrame(titles, "id bigint, title string"), spark.createDataFrame([], "slug string"))
    assert {r.id: r.slug for r in got.collect()} == one_by_one(titles, set())


def test_running_count_of_one_group(spark):
    df = spark.range(5000).select(F.lit("k").alias("k"), (F.col("id") * 7).alias("at"))
    counted = running_count(df, ["k"], "at", F.col("at") % 2 == 0)
    wrong = counted.filter(F.col("n") != F.floor(F.col("at") / 14) + 1)
    assert counted.count() == 5000 and wrong.count() == 0


def greedy(times: list[int], gap: int) -> list[int]:
    counted: list[int] = []
    for t in sorted(times):
        if not counted or t - counted[-1] > gap:
            counted.append(t)
    return counted


def views(spark, rows):
    start = datetime(2024, 1, 1, tzinfo=timezone.utc)
    data = [(ip, p, start + timedelta(seconds=s)) for ip, p, s in rows]
    return spark.createDataFrame(data, "ip string, product_id int, ts timestamp")


def counted_seconds(df, ip="a", product=1):
    base = 1704067200
    rows = df.filter((F.col("ip").eqNullSafe(ip)) & (F.col("product_id") == product)).select(F.unix_micros("ts")).collect()
    return sorted((r[0] - base * 1_000_000) / 1e6 for r in rows)


def test_throttle_by_hand(spark):
    drip = views(spark, [("a", 1, m * 60) for m in (0, 20, 40, 60, 61)])
    assert counted_seconds(throttled_views(drip)) == [0, 2400]
    exact = views(spark, [("a", 1, m * 60) for m in (0, 30)])
    assert counted_seconds(throttled_views(exact)) == [0]
    twice = views(spark, [("a", 1, 5), ("a", 1, 5), (None, 1, 5), (None, 1, 4000), ("", 1, 7)])
    got = throttled_views(twice)
    assert (counted_seconds(got), counted_seconds(got, None), counted_seconds(got, "")) == ([5], [5, 4000], [7])


def test_throttle_at_random(spark):
    rnd = random.Random(7)
    rows = []
    for ip, n, span in (("hot", 600, 40_000), ("sparse", 30, 400_000), ("burst", 80, 4000), ("once", 1, 10)):
        rows += [(ip, 1, rnd.randrange(span * 1000) / 1000) for _ in range(n)]
    got = throttled_views(views(spark, rows))
    for ip in ("hot", "sparse", "burst", "once"):
        times = [int(round(s * 1e6)) for i, _, s in rows if i == ip]
        assert counted_seconds(got, ip) == [t / 1e6 for t in greedy(times, 1_800_000_000)]


@pytest.mark.parametrize("gap_minutes", [0, 1, 30, 600])
@pytest.mark.parametrize("partitions", [1, 7, 40])
def test_throttle_of_a_key_cut_in_time(spark, gap_minutes, partitions):
    """One key in many ranges, on both sides of 1970, with and without a view counted before."""
    rnd = random.Random(gap_minutes * 100 + partitions)
    start = datetime(1969, 12, 31, 12, tzinfo=timezone.utc)
    times = [rnd.randrange(90_000) for _ in range(700)] + [rnd.randrange(30_000, 31_000) for _ in range(300)]
    rows = [("hot", start + timedelta(seconds=t)) for t in times] + [(None, start + timedelta(seconds=t)) for t in times[:50]]
    df = spark.createDataFrame(rows, "k string, ts timestamp")
    spark.conf.set("spark.sql.shuffle.partitions", str(partitions))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = throttled_views(df, ("k",), gap_minutes=gap_minutes).select("k", F.unix_seconds("ts").alias("t")).collect()
        carried = spark.createDataFrame([("hot", start + timedelta(seconds=20_000))], "k string, ts timestamp")
        later = throttled_views(df, ("k",), gap_minutes=gap_minutes, last=carried).select("k", F.unix_seconds("ts").alias("t")).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    zero, gap = int(start.timestamp()), gap_minutes * 60
    want = greedy(times, gap)
    assert sorted(r["t"] - zero for r in got if r["k"] == "hot") == want
    assert sorted(r["t"] - zero for r in got if r["k"] is None) == greedy(times[:50], gap)
    after = greedy([t for t in times if t > 20_000 + gap], gap)
    assert sorted(r["t"] - zero for r in later if r["k"] == "hot") == after


def test_slugs_in_long_chains(spark):
    """Names shared by many roots at once, decided in both ways."""
    rnd = random.Random(11)
    titles = [f"a {n}" for n in range(2, 40)] + [f"a 2 {n}" for n in range(2, 9)] + ["a"] * 40 + ["a 2"] * 12
    rnd.shuffle(titles)
    titles = list(enumerate(titles + ["a 999999999999999999", "b"]))
    taken = {f"a-{n}" for n in range(5, 60, 5)} | {"a-2-4", "a-7000000000", "b", "b-2", "b-4"}
    got = assign_slugs(spark.createDataFrame(titles, "id bigint, title string"),
                       spark.createDataFrame([(s,) for s in taken], "slug string"))
    assert {r.id: r.slug for r in got.collect()} == one_by_one(titles, taken)


@pytest.mark.parametrize("partitions", [1, 6])
def test_slugs_of_interleaved_numbers(spark, partitions):
    """Every second arrival is a name the other root wants; the number of jobs does not grow with the names."""
    jobs = []
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", str(partitions))
    try:
        for n in (50, 2000):
            titles = []
            for k in range(2, n + 1):
                titles += [f"a {k}"] + (["a"] if k % 2 == 0 else [])
            titles = [(i * 1000, t) for i, t in enumerate(titles)]
            spark.sparkContext.setJobGroup(f"slugs-{partitions}-{n}", "slugs")
            got = assign_slugs(spark.createDataFrame(titles, "id bigint, title string"), spark.createDataFrame([], "slug string"))
            assert {r.id: r.slug for r in got.collect()} == one_by_one(titles, set())
            jobs.append(len(spark.sparkContext.statusTracker().getJobIdsForGroup(f"slugs-{partitions}-{n}")))
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert jobs[1] <= jobs[0] + 2 * partitions, jobs


def test_slugs_need_arrival_numbers(spark):
    for ids in ((1, 1), (1, None)):
        with pytest.raises(ValueError):
            assign_slugs(spark.createDataFrame([(i, "a") for i in ids], "id bigint, title string"), spark.createDataFrame([], "slug string"))
