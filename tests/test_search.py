"""The trigram index against a scan: patterns, blocks, shelves, changes, plans."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from stallwise.operators import catalog, search
from test_operators import products, rows

PATTERNS = [
    "silk", "SILK sari", "s_lk", "sil%gold", "%", "_", "ab", "", "it's", '"red"', "100%", "\\", "a\\b", "zari border", "é dé", "\U0001f600\U0001f600x",
    "nothing like it", "aaa", "aaaa", "___", "%%%", "ilk s", "İst",
]


def catalogue(spark, n=400):
    rnd = random.Random(4)
    words = ["silk", "Silk", "sari", "gold", "zari border", "it's", 'a "red" one', "100% pure", "a\\b", "café déjà", "\U0001f600\U0001f600x", "aaaa", "İstanbul", ""]
    return products(spark, *(
        dict(id=i * 7, sku=f"SW-{i}", title=" ".join(rnd.choices(words, k=3)), fabric=rnd.choice([*words, None]), description=rnd.choice(words) * 3)
        for i in range(n)
    ))


@pytest.fixture(scope="module")
def index(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("index"))
    table = catalogue(spark)
    search.write_index(table, path, block=64, shelf=512)
    return path, table


@pytest.mark.parametrize("pattern", PATTERNS)
def test_same_rows_as_a_scan(spark, index, pattern):
    path, table = index
    want = rows(table.where(catalog.search_condition(pattern)), "id", "title")
    assert rows(search.search(spark, path, pattern), "id", "title") == want
    assert bool(search.pattern_grams(spark, pattern)) == any(len(p) >= 3 for p in pattern.replace("_", "%").split("%"))


def test_all_patterns_at_once(spark, index):
    path, table = index
    usable = [p for p in PATTERNS if any(len(x) >= 3 for x in p.replace("_", "%").split("%"))]
    asked = spark.createDataFrame([(p,) for p in [*usable, usable[0]]], "pattern string")
    want = [(p, r.id) for p in usable for r in table.where(catalog.search_condition(p)).collect()]
    assert sorted(rows(search.search_all(spark, path, asked), "pattern", "id")) == sorted(want)
    with pytest.raises(Exception, match="no trigram in ab"):
        search.search_all(spark, path, spark.createDataFrame([("ab",)], "pattern string")).collect()


def test_lists_are_bounded_and_sorted(spark, index):
    lists = spark.read.parquet(f"{index[0]}/postings")
    assert lists.where((F.size("ids") > 64) | (F.col("ids") != F.array_sort("ids"))).count() == 0
    assert lists.groupBy("gram", "block").count().where("count > 1").count() == 0


def test_only_candidates_shelves_are_read(spark, tmp_path):
    table = products(spark, *(dict(id=i, sku=f"S{i}", title="rare one" if i == 700 else "plain") for i in range(1000)))
    path = str(tmp_path / "index")
    search.write_index(table, path, block=10, shelf=100)
    found = search.search(spark, path, "rare")
    plan = found._jdf.queryExecution().toString()
    assert "dynamicpruning" in plan.lower() and "In(gram" in plan
    assert [r.id for r in found.collect()] == [700]


def test_changes_touch_their_shelves_only(spark, tmp_path):
    path = str(tmp_path / "index")
    before = [dict(id=i, sku=f"S{i}", title="plain") for i in range(300)]
    search.write_index(products(spark, *before), path, block=10, shelf=100)
    stamp = lambda shelf: sorted(p.name for t in ("rows", "postings") for p in (tmp_path / "index" / t / f"shelf={shelf}").iterdir())
    kept, old = stamp(0), stamp(1)
    after = products(spark, *(b | ({"title": "velvet"} if b["id"] == 150 else {}) for b in before if b["id"] != 151))
    search.refresh(after, spark.createDataFrame([(150,), (151,)], "id int"), path, block=10, shelf=100)
    assert stamp(0) == kept and stamp(1) != old
    assert rows(search.search(spark, path, "velvet"), "id") == [(150,)]
    assert search.search(spark, path, "plain").count() == 298 and search.search(spark, path, "S151").count() == 0
    fewer = products(spark, *before[:200])
    search.refresh(fewer, spark.createDataFrame([(i,) for i in range(200, 300)], "id int"), path, block=10, shelf=100)
    assert stamp(0) == kept and search.search(spark, path, "S2").count() == 11


LONG = ["SW-12", "sw-39", "zari border", "SW-1%zari border", "border sari", "zari borderzari borderzari border", "café déjàcafé", "no such piece here", "a\\b%zari border", "x" * 60]


def test_long_patterns_need_no_postings(spark, tmp_path):
    table = catalogue(spark, 120)
    path = str(tmp_path / "index")
    search.write_index(table.unionByName(table.limit(5)), path, block=64, shelf=512)
    wanted = [p for p in LONG if max(map(len, p.split("%"))) >= search.ANCHORS[0]]
    want = [(p, r.id) for p in wanted for r in table.unionByName(table.limit(5)).where(catalog.search_condition(p)).collect()]
    empty = spark.read.parquet(f"{path}/postings").limit(0)
    empty.write.mode("overwrite").parquet(f"{path}/none")
    search.remove(spark, f"{path}/postings")
    spark.createDataFrame([], empty.schema).write.parquet(f"{path}/postings")
    got = search.search_all(spark, path, spark.createDataFrame([(p,) for p in wanted], "pattern string"))
    assert sorted(rows(got, "pattern", "id")) == sorted(want) and len(want) > 20


def test_many_short_and_long_patterns(spark, index):
    path, table = index
    asked = LONG + PATTERNS[:2]
    want = [(p, r.id) for p in asked for r in table.where(catalog.search_condition(p)).collect()]
    got = search.search_all(spark, path, spark.createDataFrame([(p,) for p in [*asked, LONG[2]]], "pattern string"))
    assert sorted(rows(got, "pattern", "id")) == sorted(want)


def test_trigrams_are_made_once(spark):
    plan = search.postings(catalogue(spark, 40), block=64, shelf=512)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("array_distinct") == 1
