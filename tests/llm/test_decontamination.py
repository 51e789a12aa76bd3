from __future__ import annotations

import hashlib
import random
import re

import pytest

from stallwise.llm import decontamination as dec


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))


def brute(text, items):
    w, hit, found = words(text), set(), set()
    for name, item in items:
        v = words(item)
        n = min(dec.WINDOW, len(v))
        for j in range(len(v) - n + 1 if v else 0):
            for i in range(len(w) - n + 1):
                if w[i : i + n] == v[j : j + n]:
                    hit.update(range(i, i + n))
                    found.add(str(name))
    digest = hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()
    return len(w), len(hit), len(found), digest, bool(hit) and 20 * len(hit) >= len(w)


def cases(seed, letters):
    r = random.Random(seed)
    text = lambda n: " ".join(r.choice(letters) for _ in range(n))
    items = [(i, text(r.choice([0, 1, 3, 12, 13, 14, 20, 60]))) for i in range(12)] + [(12, None)]
    docs = [None, "", "A-b.C"]
    for _ in range(40):
        piece = r.choice(items)[1] or ""
        cut = piece.split()[r.randint(0, 4) :]
        docs.append(" ".join([text(r.randint(0, 40)), *cut[: r.randint(8, 40)], text(r.randint(0, 200))]).upper())
    return items, docs


@pytest.mark.parametrize(("letters", "block"), [("ab", 10**6), ("abcdefgh", 10**6), ("abcd", 40)])
def test_hits_equal_brute_force(spark, documents, letters, block):
    items, docs = cases(len(letters), letters)
    table = spark.createDataFrame(items, "item_id long, text string")
    found = dec.decontaminated(spark, documents(docs), table, block_words=block).collect()
    got = {r["doc_id"]: (r["n_words"], r["n_hit"], r["n_items"], r["items_sha256"], r["contaminated"]) for r in found}
    assert got == {i: brute(t, items) for i, t in enumerate(docs)}


def test_fingerprints_are_shared_by_every_long_span():
    r = random.Random(9)
    w = dec.Words()
    for _ in range(300):
        span = " ".join(r.choice("abcdef") for _ in range(dec.WINDOW))
        a = " ".join([*(r.choice("abcdef") for _ in range(r.randint(0, 20))), span])
        b = " ".join([span, *(r.choice("abcdef") for _ in range(r.randint(0, 20)))])
        prints = [set(dec.winnowed(dec.grams(w.of(t), dec.GRAM)).tolist()) for t in (a, b)]
        assert prints[0] & prints[1]


def test_awkward_rows(spark, awkward, clashing, nothing):
    items = spark.createDataFrame([(None, "one"), ("k", "one"), ("k", "one two three"), ("z", None)], "item_id string, text string")
    found = dec.decontaminated(spark, awkward, items)
    by = {(r["doc_id"], r["text"]): r for r in found.collect()}
    assert found.count() == 16
    assert by[5, "one"]["n_items"] == 2 and by[5, "one"]["contaminated"]
    assert by[0, None]["n_words"] == 0 and not by[0, None]["contaminated"]
    again = dec.decontaminated(spark, clashing, items)
    assert again.count() == 16 and again.columns.count("contaminated") == 1 and "N_WORDS" not in again.columns
    assert again.where("other <> 'own other'").count() == 0
    assert dec.decontaminated(spark, nothing, items).count() == 0
    none = spark.createDataFrame([], "item_id long, text string")
    assert dec.decontaminated(spark, awkward, none, keep_clean=True).count() == 16
