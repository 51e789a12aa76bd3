from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from stallwise.llm import common, toxicity as tox

CLEAN = "the quick brown fox jumps over a lazy dog while seven wizards brew strong coffee near quiet harbours".split()
BAD = ["idiot", "moron", "worthless", "scum"]


@pytest.fixture(scope="module")
def chars(spark, documents):
    return tox.char_model(documents([" ".join(CLEAN + BAD)] * 30))


@pytest.mark.parametrize(
    ("token", "word"),
    [("1d10t", "idiot"), ("m0r0n", "moron"), ("$cum", "scum"), ("w0rthl3ss", "worthless"), ("i.d.i.o.t", "idiot"), ("s-c-u-m", "scum"),
     ("scuuuum", "scum"), ("idiot!!!", "idiot"), ("idiot", "idiot"), ("id10t,", "idiot")],
)
def test_disguised_words_are_restored(chars, token, word):
    assert word in tox.restored(token, chars)


@pytest.mark.parametrize(
    ("token", "word"),
    [("!d!0t", "idiot"), ("iiddiioott", "idiot"), ("sccum", "scum"),
     ("idiiot", "idiot"), ("moroon,", "moron"), ("coffee", "coffee")],
)
def test_double_letters_are_restored(chars, token, word):
    assert word in tox.restored(token, chars)


def test_leetspeak_alone_is_decoded(documents):
    chars = tox.char_model(documents(["the lazy ass sat on a little stool"] * 30))
    assert "ass" in tox.restored("@$$", chars) and "ass" in tox.restored("455", chars)
    assert tox.restored("---", chars) == tox.restored("***", chars) == ()


def test_every_word_of_a_spaced_run(chars):
    assert "scum" in tox.words_of("you are a s c u m", chars, {})
    assert {"scum", "idiot"} <= tox.words_of("s c u m i d i o t", chars, {})
    run = " ".join(" ".join(w) for w in ["fox", "jumps", "over", "lazy", "dog", "worthless", "idiot", "near"] * 3)
    assert {"worthless", "idiot"} <= tox.words_of(run, chars, {})


def test_words_of_long_tokens(chars):
    for k in range(1, 40):
        assert "idiot" in tox.restored("-".join(["fox"] * k + ["1d10t"] + ["dog"] * 20), chars), k
    tox.restored("a1" * 100_000, chars)


def test_spaced_words_are_restored(chars):
    assert "idiot" in tox.words_of("you i d i o t go", chars, {})
    assert tox.words_of("the | fox | dog", chars, {}) == {"the", "fox", "dog"}


def test_viterbi_finds_the_cheapest_path(chars):
    """Against all paths of the lattice, one by one."""
    def paths(slots):
        if not slots:
            yield "", 0.0
            return
        for letters, cost in slots[0]:
            for rest, more in paths(slots[1:]):
                yield letters + rest, cost + more

    def cost(word, channel):
        s = f"^^{word}$"
        return channel + sum(chars.cost(*s[i : i + 3]) for i in range(len(s) - 2))

    r = random.Random(4)
    for _ in range(60):
        chunk = "".join(r.choice("id10t$cum3!.") for _ in range(r.randint(1, 7)))
        best = min(cost(w, c) for w, c in paths(tox.lattice(chunk)))
        found = tox.viterbi(chunk, chars)
        assert min(cost(w, c) for w, c in paths(tox.lattice(chunk)) if w == found) == pytest.approx(best)


def test_evidence_is_the_best_of_a_words_features():
    r = random.Random(9)
    weights = np.zeros(tox.FEATURE_BUCKETS, dtype=np.float32)
    words = ["".join(r.choice("abcdeéü一") if i % 2 else r.choice("abcde") for _ in range(r.randint(0, 11))) for i in range(2000)]
    for w in r.sample(words, 300):
        weights[r.choice(tox.features(w))] = r.random()
    found = tox.Evidence(weights)
    for w in words:
        assert found.of(w) == max(float(weights[f]) for f in tox.features(w))


def corpus(n=400):
    r = random.Random(8)
    rows = []
    for i in range(n):
        words = r.choices(CLEAN, k=r.randint(5, 80))
        toxic = i % 4 == 0
        if toxic:
            for _ in range(3):
                words.insert(r.randrange(len(words)), r.choice(BAD))
        rows.append((i, " ".join(words), int(toxic)))
    return rows


def test_held_out_documents(spark, documents):
    rows = corpus()
    docs = documents([(i, t, "en", "s", len(t)) for i, t, _ in rows])
    labels = spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int")
    out = common.held_out(F.col("doc_id"), 3)
    model = tox.fit(spark, docs.where(~out), labels)
    hidden = documents([(1000, "fox fox 1d10t and m0r0n dog dog", "en", "s", 0), (1001, "fox fox dog dog", "en", "s", 0)])
    got = {r["doc_id"]: r for r in tox.score(spark, docs.unionByName(hidden), model).withColumn("held_out", out).collect()}
    wrong = [i for i, _, y in rows if got[i]["held_out"] and got[i]["predicted"] != y]
    assert not wrong and sum(r["held_out"] for r in got.values()) > 50
    assert got[1000]["predicted"] == 1 and got[1001]["predicted"] == 0
    kept = tox.score(spark, docs, model, keep_clean=True)
    assert {r["doc_id"] for r in kept.select("doc_id").collect()} == {i for i, r in got.items() if i < 1000 and not r["predicted"]}


def test_a_bound_on_the_labelled_rows_still_learns(spark, documents):
    rows = corpus()
    docs = documents([(i, t, "en", "s", len(t)) for i, t, _ in rows])
    labels = spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int")
    model = tox.fit(spark, docs, labels, max_labelled=200)
    got = {r["doc_id"]: r["predicted"] for r in tox.score(spark, docs, model).collect()}
    assert sum(got[i] != y for i, _, y in rows) <= 4


def test_awkward_rows(spark, awkward, clashing, nothing):
    labels = spark.createDataFrame(
        [(0, 0), (8, 1), (8, 0), (3, 0), (None, 1), (5, None), (7, 0), (99, 1)], "doc_id long, toxic int"
    )
    model = tox.fit(spark, awkward, labels)
    scored = tox.score(spark, awkward, model)
    assert scored.count() == 16 and scored.where("score is null or score < 0 or score > 1").count() == 0
    assert scored.where("doc_id = 5").select("score").distinct().count() == 1
    again = tox.score(spark, clashing, tox.fit(spark, clashing, labels))
    assert again.columns.count("score") == 1 and "Score" not in again.columns and again.count() == 16
    none = labels.limit(0)
    assert tox.score(spark, nothing, tox.fit(spark, nothing, none)).count() == 0
    assert tox.score(spark, awkward, tox.fit(spark, awkward, none)).where("predicted <> 0").count() == 0
    assert tox.score(spark, awkward, tox.fit(spark, nothing, labels)).count() == 16


@pytest.mark.parametrize("text", [
    "you s t u p i d.", "s t u p i d, go", "(s t u p i d)", "s  t  u  p  i  d", "s\tt\tu\tp\ti\td", 'a "s t u p i d"!', "s\nt\nu\np\ni\nd",
])
def test_spaced_words_whatever_stands_around_them(text):
    found = [m.group() for m in tox.SPACED.finditer(text)]
    assert any("".join(f.split()).endswith("stupid") for f in found)
