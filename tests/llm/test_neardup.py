from __future__ import annotations

import random
import re

import pytest

from pyspark.sql import functions as F

from stallwise.llm import common, neardup


def brute(rows, width, percent=80):
    """Component of each id, by comparing all sets with all."""
    sets = {}
    for i, text in rows:
        words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
        n = min(width, len(words))
        sets[i] = {tuple(words[k : k + n]) for k in range(len(words) - n + 1)} if words else set()
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[:k]:
            shared = len(sets[a] & sets[b])
            if sets[a] and sets[b] and 100 * shared >= percent * (len(sets[a]) + len(sets[b]) - shared):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in ids}


def corpus(seed, groups=(30, 12, 2, 2)):
    r = random.Random(seed)
    word = lambda: r.choice("abcdefghijklmnopqrstuvwxyz") + r.choice("aeiou") + r.choice("xyz")
    texts = [" ".join(word() for _ in range(r.randint(1, 60))) for _ in range(25)] + ["", None, "One", "one", "ONE two"]
    for size in groups:
        base = [word() for _ in range(60)]
        for _ in range(size):
            copy = list(base)
            for _ in range(r.randint(0, 6)):
                copy[r.randrange(len(copy))] = word()
            texts.append(" ".join(copy))
            base = copy if r.random() < 0.3 else base  # chains: ends far apart, neighbours alike
    shared = [word() for _ in range(30)]  # a passage that many share without being copies
    texts += [" ".join(shared + [word() for _ in range(r.randint(10, 40))]) for _ in range(20)]
    r.shuffle(texts)
    return list(enumerate(texts))


@pytest.mark.parametrize(("seed", "width", "small"), [(1, 2, 128), (2, 5, 128), (3, 2, 4), (4, 5, 3)])
def test_components_equal_brute_force(spark, documents, monkeypatch, seed, width, small):
    monkeypatch.setattr(neardup, "SMALL", small)
    rows = corpus(seed)
    docs = documents([(i, t, "en", "s", 0) for i, t in rows])
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in neardup.near_duplicates(spark, docs, width=width).collect()}
    assert got == brute(rows, width)


@pytest.mark.parametrize(("seed", "levels", "counters"), [(11, 1, 1), (12, 2, 64), (13, 4, 1 << 18)])
def test_shared_passages_in_any_order(spark, documents, monkeypatch, seed, levels, counters):
    """Documents put together from passages that many share: any order of shingles and any number of levels finds all links."""
    monkeypatch.setattr(neardup, "SMALL", 2)
    monkeypatch.setattr(neardup, "LEVELS", levels)
    monkeypatch.setattr(neardup, "COUNTERS", counters)
    r = random.Random(seed)
    passages = [[f"q{k}x{j}" for j in range(8)] for k in range(12)]
    texts = []
    for _ in range(120):
        own = [w for k in r.sample(range(12), r.randint(3, 6)) for w in passages[k]]
        texts.append(" ".join(own + [f"z{r.randrange(50)}" for _ in range(r.randint(0, 4))]))
    rows = list(enumerate(texts))
    docs = documents([(i, t, "en", "s", 0) for i, t in rows])
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in neardup.near_duplicates(spark, docs, width=2).collect()}
    assert got == brute(rows, 2)


@pytest.mark.parametrize("seed", [7, 8])
def test_pairs_of_large_buckets_that_share_little_with_their_base(spark, documents, monkeypatch, seed):
    """Pairs put together from words that many short documents share: each band has another star, each covers less than half."""
    monkeypatch.setattr(neardup, "SMALL", 2)
    r = random.Random(seed)
    common_words = [f"p{k}" for k in range(40)]
    texts = [" ".join(sorted(r.sample(common_words, 18))) for _ in range(300)]
    texts += [" ".join([*common_words, f"x{k}", f"y{k}"]) for k in range(3)]
    rows = list(enumerate(texts))
    docs = documents([(i, t, "en", "s", 0) for i, t in rows])
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in neardup.near_duplicates(spark, docs, width=1).collect()}
    assert got[301] == got[302] == (42, 300)
    assert got == brute(rows, 1)


def test_kept_marks_one_document_of_a_component(spark, documents):
    found = neardup.near_duplicates(spark, documents(["a b c d e f"] * 4 + ["g h i j k l"]), width=5)
    assert {r["doc_id"]: (r["component_id"], r["kept"]) for r in found.collect()} == {
        0: (0, True), 1: (0, False), 2: (0, False), 3: (0, False), 4: (4, True)
    }


def test_large_and_small_star(spark):
    r = random.Random(5)
    edges = [(i, i + 1) for i in range(0, 40)] + [(100, k) for k in range(101, 160)] + [(r.randrange(200, 230), r.randrange(200, 230)) for _ in range(40)]
    root = {x: x for e in edges for x in e}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    got = {r["id"]: r["component"] for r in neardup.components(spark, spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: find(x) for a, b in edges if a != b for x in (a, b)}


def test_awkward_rows(spark, awkward, clashing, nothing):
    found = neardup.near_duplicates(spark, awkward, width=2)
    by = {}
    for r in found.collect():
        by.setdefault(r["doc_id"], []).append((r["n_shingles"], r["component_id"], r["kept"]))
    assert found.count() == 16
    assert by[0] == [(0, 0, True)] and by[1] == [(0, 1, True)] and by[2] == [(0, 2, True)]
    assert by[4] == [(by[3][0][0], 3, False)]
    assert by[5] == [(1, 5, True)] * 2 and by[6] == [(1, 5, False)]
    assert sorted(by[None], key=repr) == [(0, None, True), (5, None, True)]
    assert by[12] == [(6, 11, False)]
    again = neardup.near_duplicates(spark, clashing, width=2)
    assert sorted(map(tuple, again.collect()), key=repr) == sorted(map(tuple, found.collect()), key=repr)
    assert neardup.near_duplicates(spark, nothing).count() == 0


def test_counters_do_not_grow_with_the_parts(spark, documents, monkeypatch):
    """As many partial counts as tasks run at once, however many parts the sets lie in."""
    made = []
    mapped = common.arrow_mapped

    def watched(df, run, schema):
        out = mapped(df, run, schema)
        if schema.fieldNames() == ["bucket", "n"]:
            made.append((out.count(), df.rdd.getNumPartitions()))
        return out

    monkeypatch.setattr(common, "arrow_mapped", watched)
    search = neardup._Search(spark, documents([(0, "a", "en", "s", 0)]), None, "doc_id", "text", 2, 80)
    sets = spark.range(400).select(F.col("id"), F.array(F.lit(5), F.lit(9)).cast("array<bigint>").alias("shingles")).repartition(64)
    counts = search.counters(sets)
    cores = spark.sparkContext.defaultParallelism
    assert made[0][0] <= 2 * cores and made[0][1] <= cores
    assert (counts[5], counts[9], counts.sum()) == (400, 400, 800)


def test_counters_of_many_shingles_come_in_few_rows(spark, documents, monkeypatch):
    made, mapped = [], common.arrow_mapped

    def watched(df, run, schema):
        out = mapped(df, run, schema)
        if schema.fieldNames() == ["bucket", "n"]:
            made.append(out.count())
        return out

    monkeypatch.setattr(common, "arrow_mapped", watched)
    search = neardup._Search(spark, documents([(0, "a", "en", "s", 0)]), None, "doc_id", "text", 2, 80)
    sets = spark.range(300).select("id", F.sequence(F.col("id") * 50, F.col("id") * 50 + 99).alias("shingles"))
    counts = search.counters(sets)
    assert max(made) <= neardup.BLOCKS * spark.sparkContext.defaultParallelism
    assert (counts[0], counts[50], counts[14_950], counts[15_050], counts.sum()) == (1, 2, 2, 0, 30_000)


def test_few_outsiders_of_a_large_bucket_are_compared_at_once(spark, documents, monkeypatch):
    def never(*_):
        raise AssertionError("needs another round")

    monkeypatch.setattr(neardup._Search, "prefixes", never)
    base = [f"w{k}" for k in range(100)]
    texts = [" ".join([*base[:99], f"x{k}"]) for k in range(60)]
    texts.append(" ".join(base[:88] + [f"y{k}" for k in range(12)]))  # 88 of 112 words in common
    texts.append(" ".join(base[:88] + [f"y{k}" for k in range(10)] + ["z0", "z1"]))
    rows = list(enumerate(texts))
    docs = documents([(i, t, "en", "s", 0) for i, t in rows])
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in neardup.near_duplicates(spark, docs, width=1).collect()}
    assert got[59][1] == 0 and got[60] == (100, 60) and got[61] == (100, 60)
    assert got == brute(rows, 1)
