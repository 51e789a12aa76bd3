"""URL filters, quality rules, mixing."""

from __future__ import annotations

import random
import re
from collections import Counter
from urllib.parse import quote

import pytest
from pyspark.sql import functions as F

from stallwise.llm import mixing, rules, urls
from stallwise.llm.queries import URL_RULES
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def host_and_path(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.split(r"[/?#]", rest, maxsplit=1)[0]
    path = re.split(r"[?#]", rest[len(host) :], maxsplit=1)[0]
    return re.sub("[A-Z]", lambda m: m.group().lower(), host), path


def rule_of(host, path):
    fits = [r for r in URL_RULES if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    return max(fits, key=lambda r: len(r.text), default=None)


URLS = [
    None, "", "no scheme", "http://", "http://EXAMPLE.net", "http://example.net?x=/en/", "https://a.example.net/en/1?u=1#t", "http://net/", "http://xnet/",
    "http://example.com/de", "http://example.com/de/5", "http://m.example.com/de/x.html#a?b", "ftp://a.org/fr/://b", "http://ÀB.org/fr/é", "http://org/fr/",
    "http://notexample.net/en/1", "http://example.net.org/en/1", "x://y://z/w", "http://a.net#/en/", "HTTP://User@A.ORG:80/fr/1",
]


def test_hosts_paths_and_rules(spark):
    pages = spark.createDataFrame(list(enumerate(URLS)), "page_id long, url string").withColumn("document", F.lit(None).cast("long"))
    labels = spark.createDataFrame([], "doc_id long, bad int")
    for r in urls.judge(spark, pages, labels, URL_RULES, page_key="document").collect():
        host, path = host_and_path(r["url"])
        rule = rule_of(host, path)
        assert (r["host"], r["path"], r["rule"]) == (host, path, rule and rule.text), r["url"]
        assert r["verdict"] == (rule.verdict if rule else "allow"), r["url"]


def test_bad_templates_go_and_good_ones_stay(spark):
    r = random.Random(1)
    rows, labels = [], []
    for i in range(900):
        host = "shop.test" if i % 3 else "news.test"
        section = r.choice(["articles", "spam", "about"])
        tail = r.choice([str(i), f"{i}.html", f"item-{i}"])
        rows.append((i, f"http://{host}/{section}/{tail}"))
        if r.random() < 0.5:
            labels.append((i, int(section == "spam" and host == "shop.test")))
    pages = spark.createDataFrame(rows, "doc_id long, url string")
    found = urls.judge(spark, pages, spark.createDataFrame(labels, "doc_id long, bad int"), []).collect()
    assert len(found) == 900
    for x in found:
        assert x["verdict"] == ("block" if "shop.test/spam" in x["url"] else "allow"), x
    kept_apart = {x["template"] for x in found if "shop.test" in x["url"]}
    assert any("spam" in t for t in kept_apart) and not any(str(i) in t for t in kept_apart for i in range(100, 900))


def test_wide_branches_become_wildcards(spark):
    names = [a + b + c for a in "klmn" for b in "aeiou" for c in "stvw"]
    rows = [(i, f"http://a.test/user/{names[i % 80]}/home") for i in range(100)] + [(1000 + i, "http://a.test/help/faq") for i in range(20)]
    pages = spark.createDataFrame(rows, "doc_id long, url string")
    found = urls.judge(spark, pages, spark.createDataFrame([], "doc_id long, bad int"), [])
    assert {r["template"].replace("~", "*") for r in found.where("url like '%/user/%'").collect()} <= {"/*/*/*", "/user/*/home", "/*/*/home"}


def test_forms(spark):
    cases = {
        "/a/123": "/a/{n}", "/0123abcd9/x": "/{h}/x", "/v1/p-22.html": "/v{n}/p-{n}.html", "/123e4567-e89b-12d3-a456-426614174000": "/{u}",
        "/a/b/c/d/e/f/g/h": "/a/b/c/d/e/f/g/h", "": "", "/deadbeef": "/deadbeef",
    }
    df = spark.createDataFrame([(k,) for k in cases], "p string")
    assert {r["p"]: r["f"] for r in df.select("p", urls.form(F.col("p")).alias("f")).collect()} == cases
    cut = df.where("length(p) = 16").select(urls.form(F.col("p"), 6)).collect()
    assert [r[0] for r in cut] == ["/a/b/c/d/e/f/**"]


def test_deep_branches_are_told_apart(spark):
    rows = [(i, f"http://a.test/a/b/c/d/e/f/{'spam' if i % 2 else 'news'}/{i}") for i in range(400)]
    rows.append((400, "http://b.test/" + "x/" * 300))  # alone on its host: no round for its depth
    pages = spark.createDataFrame(rows, "doc_id long, url string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(400)], "doc_id long, bad int")
    for x in urls.judge(spark, pages, labels, []).collect():
        assert x["verdict"] == ("block" if "/spam/" in x["url"] else "allow"), x


def test_urls_of_awkward_rows(spark):
    pages = spark.createDataFrame([(1, "http://a.test/1"), (1, "http://a.test/1"), (None, None), (2, "http://b.test/" + quote("x" * 9000))], "doc_id long, url string")
    clash = pages.withColumns({c: F.lit("own") for c in ("HOST", "verdict", "number", "form", "n", "segments", "rejected", "ruled", "_form", "key", "_key", "own")})
    labels = spark.createDataFrame([(1, 1), (1, 0), (None, 1), (2, None)], "doc_id long, bad int")
    found = urls.judge(spark, clash, labels, URL_RULES)
    assert found.count() == 4 and found.where("number = 'own'").count() == 4 and "HOST" not in found.columns
    assert urls.judge(spark, pages.limit(0), labels, URL_RULES).count() == 0


def counts_by_hand(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    grams = Counter(zip(words, words[1:], words[2:]))
    covered = {i + k for i in range(len(words) - 2) if grams[tuple(words[i : i + 3])] > 1 for k in range(3)}
    seen, repeats = set(), 0
    for line in (text or "").split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            repeats += line in seen
            seen.add(line)
    failed = len(words) < 50 or 100 * len(covered) > 50 * len(words)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), repeats, len(covered), failed


def test_counts_equal_the_definition(spark, documents, awkward):
    r = random.Random(5)
    pieces = ["a", "b", "ç", "\U0001f600", " ", " ", "\n", "\t", "\x0b", "\x85", "\u00a0", "#", "|", "word ", "x y z "]
    docs = documents(["".join(r.choice(pieces) for _ in range(r.randint(0, 200))) for _ in range(120)]).unionByName(awkward)
    for x in rules.measured(spark, docs).collect():
        got = tuple(x[c] for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"))
        assert got == counts_by_hand(x["text"])


def test_odd_fertility_is_rejected(spark, documents):
    r = random.Random(7)
    plain = [" ".join(r.choices("the of house water people under light history would through".split(), k=80)) for _ in range(150)]
    words = lambda: "".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(7))
    odd = [" ".join(words() for _ in range(80)), " ".join("ꙮ" + chr(0xA640 + r.randrange(60)) for _ in range(80))]
    plain = [" ".join(f"{w} {words()[:2]}" for w in t.split()) for t in plain]
    found = {x["doc_id"]: x for x in rules.judged(spark, documents(plain + odd)).collect()}
    assert all(found[i]["kept"] for i in range(150))
    assert not any(found[i]["kept"] or found[i]["base_failed"] for i in (150, 151))
    assert found[151]["fallback_share"] > 0.5 and found[0]["fallback_share"] == 0


def test_groups_of_every_size_have_a_band(spark, documents):
    r = random.Random(9)
    words = lambda: "".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(7))
    common_words = "the of house water people under light history would through".split()
    plain = lambda: " ".join(f"{w} {words()[:2]}" for w in r.choices(common_words, k=80))
    odd = lambda: " ".join(words() for _ in range(80))
    texts = [("en", plain()) for _ in range(150)] + [("xx", plain()) for _ in range(48)] + [("xx", odd()), ("yy", odd())]
    texts += [(None, odd()), (None, " ".join("ꙮ" + chr(0xA640 + r.randrange(60)) for _ in range(80))), ("yy", plain())]
    found = {x["doc_id"]: x for x in rules.judged(spark, documents([(i, t, k, "s", len(t)) for i, (k, t) in enumerate(texts)])).collect()}
    assert all(found[i]["kept"] for i in [*range(198), 202])
    assert not any(found[i]["kept"] or found[i]["base_failed"] for i in range(198, 202))


def test_a_large_group_keeps_its_own_band(spark):
    row = lambda i, band, value: (band, "latin", False, value, value, 0.0, value)
    columns = "_band string, _script string, base_failed boolean, " + ", ".join(f"{m} double" for m in rules.MEASURES)
    rows = [row(i, "lang:a", 1.0) for i in range(50)] + [row(i, "lang:b", 3.0) for i in range(25)]
    found = {x["_band"]: x for x in rules.bands(spark.createDataFrame(rows, columns)).collect()}
    assert (found["lang:a"]["_low_entropy"], found["lang:a"]["_high_entropy"]) == (-1.0, 3.0)
    # half its own quartiles (3, 3, 3), half those of the script (1, 1, 3)
    assert (found["lang:b"]["_low_entropy"], found["lang:b"]["_high_entropy"]) == (2.0 - 6.0, 2.0 + 6.0)


def test_rules_of_awkward_rows(spark, awkward, clashing, nothing):
    found = rules.judged(spark, clashing)
    assert found.count() == 16 and found.columns.count("kept") == 1 and "N_WORDS" not in found.columns and "text" not in found.columns
    assert found.where("kept and base_failed").count() == 0 and found.where("kept is null").count() == 0
    assert found.where("doc_id = 0").first()["n_words"] == 0
    assert rules.judged(spark, nothing).count() == 0


def targets_by_hand(sizes):
    """Sources in order; excess over twice a source's size is shared again by weight until there is none."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    total, open_, out = 1.5 * sum(sizes.values()), set(names), {}
    while open_:
        left = total - sum(out.values())
        share = {s: left * weight[s] / sum(weight[t] for t in open_) for s in open_}
        over = [s for s in open_ if share[s] > 2 * sizes[s] + 1e-9]
        if not over:
            return out | share
        for s in over:
            out[s] = 2.0 * sizes[s]
            open_.discard(s)
    return out


def corpus(spark, seed, sources=7, n=400):
    r = random.Random(seed)
    names = [f"s{i}" for i in range(sources - 2)] + ["", None]
    rows = [(i, " ".join(["w"] * r.randint(0, 300)) if i % 17 else None, "en", r.choice(names[: 1 + i % sources]), 0) for i in range(n)]
    return rows, spark.createDataFrame(rows, SCHEMA)


@pytest.mark.parametrize("seed", [1, 2])
def test_targets_and_what_is_taken(spark, seed):
    rows, docs = corpus(spark, seed)
    size = {i: len((t or "").split()) for i, t, *_ in rows}
    by_source = Counter()
    for i, _, _, s, _ in rows:
        by_source[s] += size[i]
    want = targets_by_hand(dict(by_source))
    found = mixing.mixed(spark, docs, block_words=16, shard_slots=128).collect()
    assert sorted(r["doc_id"] for r in found) == sorted(size)
    taken = Counter()
    for r in found:
        assert r["size"] == size[r["doc_id"]] and r["source_size"] == by_source[r["source"]]
        assert r["target"] == pytest.approx(want[r["source"]])
        assert 0 <= r["taken"] <= 2 * r["size"]
        taken[r["source"]] += r["taken"]
    for s, t in want.items():
        assert abs(taken[s] - t) <= 0.05 * t + 64, s
    again = mixing.mixed(spark, docs.repartition(7), block_words=16, shard_slots=128).collect()
    assert sorted(map(repr, again)) == sorted(map(repr, found))


def test_blocks_are_permuted_within_each_round(spark):
    docs = spark.createDataFrame([(i, "w " * (200 + i), "en", f"s{i % 3}", 0) for i in range(60)], SCHEMA)
    sources = mixing.targets(mixing.sized(docs))
    blocks = {r["number"]: -(-r["source_size"] // 8) for r in sources.collect()}
    seen = {}
    for r in mixing.slots(spark, sources, block_words=8, shard_slots=64).collect():
        assert (r["number"], r["draw"]) not in seen and 0 <= r["block"] < blocks[r["number"]]
        seen[r["number"], r["draw"]] = r["block"]
    for number, n in blocks.items():
        draws = sorted(d for s, d in seen if s == number)
        assert draws == list(range(len(draws)))  # no draw is missing
        for turn in (0, 1):
            got = [seen[number, d] for d in draws if d // n == turn]
            assert len(set(got)) == len(got)
            assert len(got) < n or sorted(got) == list(range(n))


@pytest.mark.parametrize("n", [1, 2, 3, 470, 517, 1034])
def test_permutations_of_blocks(spark, n):
    def order(source, turn):
        keys = mixing.keys_of(F.lit(source), F.lit(turn), F.lit(1))
        places = spark.range(n).select("id", mixing.permuted(F.col("id"), F.lit(n).cast("long"), keys).alias("b"))
        return [r["b"] for r in places.orderBy("id").collect()]

    orders = [order(0, 0), order(0, 1), order(1, 0)]
    assert all(sorted(o) == list(range(n)) for o in orders)
    if n > 400:
        for o in orders:
            steps = Counter((b - a) % n for a, b in zip(o, o[1:]))
            assert max(steps.values()) <= 9  # no step from block to block prevails
            assert sum(a == i for i, a in enumerate(o)) <= 8
            early = sum(b < n / 2 for b in o[: n // 2]) / (n // 2)
            assert 0.4 < early < 0.6
        assert all(sum(a == b for a, b in zip(x, y)) <= 8 for x in orders for y in orders if x is not y)


def test_buckets_of_a_hot_source(spark, monkeypatch):
    monkeypatch.setattr(mixing, "BUCKET_ROWS", 5)
    monkeypatch.setattr(mixing, "COARSE", 4)
    docs = spark.createDataFrame([(i, "w " * (i % 9), "en", "hot", 0) for i in range(200)], SCHEMA)
    sizes = mixing.sized(docs)
    placed = sorted((r["start"], r["size"]) for r in mixing.placed(sizes, mixing.targets(sizes)).collect())
    at = 0
    for start, size in placed:  # the documents lie end to end
        assert start == at
        at += size
    assert at == sum(i % 9 for i in range(200))


def test_mix_of_awkward_rows(spark, awkward, clashing, nothing):
    found = mixing.mixed(spark, awkward).collect()
    assert len(found) == 16 and all(r["taken"] <= 2 * r["size"] for r in found)
    kept = mixing.mix_documents(spark, clashing)
    assert kept.columns.count("taken") == 1 and kept.where("number <> 'own number'").count() == 0
    assert kept.where("taken <= 0 or taken > 2 * size").count() == 0
    assert mixing.mixed(spark, nothing).count() == 0 and mixing.mix_documents(spark, nothing).count() == 0
