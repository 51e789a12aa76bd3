"""Quality grades, class-based bigrams and languages."""

from __future__ import annotations

import math
import random
import re
import zlib
from collections import Counter
from types import SimpleNamespace

import numpy as np
import pytest
from pyspark.sql import functions as F

from stallwise.llm import brown, common, language, quality


def test_ordered_thresholds_and_shared_weights():
    r = np.random.default_rng(0)
    rows, grades = [], []
    for _ in range(3000):
        k = np.sort(r.choice(50, 5, replace=False))
        latent = (k < 25).sum() - 2.5 + r.logistic() * 0.5
        grades.append(int(np.searchsorted([-1.5, 0, 1.5], latent)))
        rows.append((k, np.ones(5)))
    weights, thresholds = quality.regress(rows, np.array(grades), 4, size=50)
    assert (np.diff(thresholds) > 0).all() and weights[:25].min() > weights[25:].max()
    model = quality.OrdinalModel([1, 2, 3, 5], weights, thresholds)
    p = model.distribution(np.array([-9.0, 0.0, 9.0]))
    assert np.allclose(p.sum(axis=1), 1) and p[0].argmax() == 0 and p[2].argmax() == 3


@pytest.fixture(scope="module")
def graded(spark, documents):
    """Four grades: the more marks between words, the worse."""
    r = random.Random(3)
    rows, labels = [], []
    for i in range(600):
        grade = i % 4
        words = [r.choice(["alpha", "beta", "gamma", "delta"]) + ("###" if r.random() > 0.05 + grade * 0.3 else "") for _ in range(60)]
        rows.append((i, " ".join(words), "en", "s", 0))
        labels.append((i, grade))
    return documents(rows), spark.createDataFrame(labels, "doc_id long, quality int")


def test_grades_of_held_out_documents(spark, graded):
    docs, labels = graded
    out = common.held_out(F.col("doc_id"), 3)
    model = quality.fit(spark, docs.where(~out), labels)
    assert model.grades == [0, 1, 2, 3]
    found = quality.grade(spark, docs, model, at_least=2).where(out).join(labels, "doc_id").collect()
    assert sum(abs(r["expected_grade"] - r["quality"]) for r in found) / len(found) < 0.4
    assert sum(r["kept"] != (r["quality"] >= 2) for r in found) < 0.1 * len(found)
    assert all(0 <= r["tail_probability"] <= 1 for r in found)


def test_quality_of_awkward_rows(spark, awkward, clashing, nothing):
    labels = spark.createDataFrame([(0, 0), (3, 1), (3, 2), (None, 1), (5, None), (8, 1)], "doc_id long, quality int")
    model = quality.fit(spark, awkward, labels)
    assert model.grades == [0, 1, 2]
    found = quality.grade(spark, clashing, model)
    assert found.count() == 16 and found.where("expected_grade is null").count() == 0 and "other" in found.columns
    assert found.where("doc_id = 5").select("expected_grade").distinct().count() == 1
    one = quality.fit(spark, awkward, labels.where("quality = 1 and doc_id = 8"))
    assert quality.grade(spark, awkward, one).where("expected_grade <> 1 or not kept").count() == 0
    none = quality.fit(spark, nothing, labels)
    assert quality.grade(spark, awkward, none).where("expected_grade is not null or kept").count() == 0
    assert quality.grade(spark, nothing, model).count() == 0


def likelihood(bigrams, of):
    width = of.max() + 1
    table = np.zeros((width, width))
    np.add.at(table, (of[:, None], of[None, :]), bigrams)
    f = lambda x: float((x * np.log(np.maximum(x, 1e-300))).sum())
    return f(table) - f(table.sum(axis=0)) - f(table.sum(axis=1))


def test_exchange_ends_where_no_single_move_helps():
    bigrams = np.random.default_rng(1).integers(0, 9, (30, 30)).astype(float)
    of = brown.exchange(bigrams, 5, 60)
    best = likelihood(bigrams, of)
    for u in range(29):
        for c in range(5):
            other = of.copy()
            other[u] = c
            assert likelihood(bigrams, other) <= best + 1e-6


def brown_by_hand(rows, model):
    """Base and class scores straight from the definitions, with all counts in one dictionary."""
    train = {i: t for i, t in rows if zlib.crc32(str(i).encode()) % 5 != 1}
    tokens = lambda t: re.findall(rb"[^\x20\x09-\x0d]+", (t or "").encode().lower()) + [b""]
    c = Counter(w for t in train.values() for w in tokens(t))
    n, v, end = sum(c.values()), len(c), len(model.transitions) - 1
    number = {w: k for k, w in enumerate(model.words)}

    def class_of(w):
        return end if not w else int(model.class_of[number.get(w, len(number) + brown.ending(w))])

    members, types, follow = Counter(), Counter(), Counter()
    for w, k in c.items():
        members[class_of(w)] += k
        types[class_of(w)] += 1
    for t in train.values():
        path = [end, *map(class_of, tokens(t))]
        follow.update(zip(path, path[1:]))
    out = Counter()
    for (a, _), k in follow.items():
        out[a] += k
    width = end + 1
    found = {}
    for i, t in rows:
        path = [end, *map(class_of, tokens(t))]
        base = sum(math.log10((c[w] + 0.5) / (n + 0.5 * (v + 1))) for w in tokens(t))
        score = sum(math.log10((follow[a, b] + 0.1) / (out[a] + 0.1 * width)) for a, b in zip(path, path[1:]))
        score += sum(math.log10((c[w] + 0.5) / (members[class_of(w)] + 0.5 * (types[class_of(w)] + 1))) for w in tokens(t))
        found[i] = len(tokens(t)), sum(c[w] > 0 for w in tokens(t)), n, base, score
    return found


@pytest.mark.parametrize("known", [5, 1000])
def test_scores_equal_the_definition(spark, documents, monkeypatch, known):
    monkeypatch.setattr(brown, "FREQUENT", 4)
    r = random.Random(6)
    rows = [(i, " ".join(r.choices([f"Wort{k}" for k in range(60)], weights=range(60, 0, -1), k=r.randint(0, 40)))) for i in range(80)] + [(80, None)]
    docs = documents([(i, t, "en", "s", 0) for i, t in rows])
    model, counts = brown.fit(spark, docs.where(~common.held_out(F.col("doc_id"), 5)), known=known, classes=6)
    got = {r["doc_id"]: r for r in brown.score(spark, docs, model, counts).collect()}
    for i, want in brown_by_hand(rows, model).items():
        r = got[i]
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == want[:3]
        assert r["base_score"] == pytest.approx(want[3]) and r["score"] == pytest.approx(want[4])


def test_class_probabilities_sum_to_one(spark, documents):
    docs = documents(["a b c a b c d", "a b d", "c c a"] * 3)
    model, counts = brown.fit(spark, docs, known=3, classes=3)
    assert np.allclose((10**model.transitions).sum(axis=1), 1)
    totals, types = Counter(), Counter()
    for r in counts.collect():
        w = bytes(r["word"])
        k = len(model.transitions) - 1 if not w else int(model.class_of[brown.Codes(model.words)[w]])
        totals[k] += r["n"]
        types[k] += 1
    for k, below in enumerate(model.emitted):
        assert below == pytest.approx(totals[k] + 0.5 * (types[k] + 1))  # the half more is for unseen words


def test_brown_of_awkward_rows(spark, awkward, clashing, nothing):
    model, counts = brown.fit(spark, awkward)
    found = brown.score(spark, clashing, model, counts)
    assert found.count() == 16 and found.columns.count("score") == 1 and "Score" not in found.columns
    assert found.where("score is null or base_score is null or score > 0").count() == 0
    assert found.where("doc_id = 0").first()["n_tokens"] == 1
    none, empty = brown.fit(spark, nothing)
    assert none.n_tokens == 0
    rows = brown.score(spark, awkward, none, empty)
    assert rows.count() == 16 and rows.where("n_known <> 0").count() == 0
    assert brown.score(spark, nothing, model, counts).count() == 0


def placed_by_hand(rows, seed):
    """Class of each training word that the seed does not carry, from its own bigrams one by one."""
    end, number = len(seed.transitions) - 1, {w: k for k, w in enumerate(seed.words)}
    gains = {}
    for i, t in rows:
        if zlib.crc32(str(i).encode()) % 5 != 1:
            words = [b"", *(t or "").encode().lower().split(), b""]
            path = [end if not w else int(seed.class_of[number.get(w, len(number) + brown.ending(w))]) for w in words]
            for before, w, after in zip(path, words[1:-1], path[2:]):
                if w not in number:
                    gain = seed.transitions[before, :end] + seed.transitions[:end, after] - np.log10(seed.emitted[:end])
                    gains[w] = gains.get(w, 0) + gain
    return {w: int(np.round(g, 6).argmax()) for w, g in gains.items()}


def test_every_word_is_placed_by_its_own_bigrams(spark, documents, monkeypatch):
    monkeypatch.setattr(brown, "FREQUENT", 4)
    r = random.Random(7)
    rows = []
    for i in range(90):
        words = r.choices([f"Wort{k}" for k in range(60)], weights=range(60, 0, -1), k=r.randint(0, 40)) + [f"neu{i}"]
        rows.append((i, " ".join(r.sample(words, len(words)))))
    rows.append((90, None))
    docs = documents([(i, t, "en", "s", 0) for i, t in rows]).repartition(5)
    train = ~common.held_out(F.col("doc_id"), 5)
    seed, _ = brown.fit(spark, docs.where(train), known=4, classes=6)
    model, words, scores = brown.cluster(spark, docs, train, classes=6)
    classes = {bytes(x["word"]): x["class"] for x in words.collect()}
    assert model.words == seed.words and classes == placed_by_hand(rows, seed)
    of = [*model.class_of[:4], *classes.values(), *model.class_of[4:]]
    whole = SimpleNamespace(words=[*model.words, *classes], class_of=of, transitions=model.transitions)
    got = {x["doc_id"]: x for x in scores.collect()}
    later = {x["doc_id"]: x for x in brown.score(spark, docs, model, words).collect()}
    assert len(got) == len(later) == 91
    for i, want in brown_by_hand(rows, whole).items():
        for x in (got[i], later[i]):
            assert (x["n_tokens"], x["n_known"], x["train_tokens"]) == want[:3]
            assert x["base_score"] == pytest.approx(want[3]) and x["score"] == pytest.approx(want[4])


def test_class_of_a_rare_word_changes_with_its_neighbours(spark, documents, monkeypatch):
    monkeypatch.setattr(brown, "FREQUENT", 4)
    texts = ["a b c d a b c d a b"] * 20

    def class_of(one, other):
        docs = documents([*texts, f"a {one} c d", f"a b c {other} a"])
        words = brown.cluster(spark, docs, F.lit(True), classes=4)[1]
        found = {bytes(x["word"]).decode(): x["class"] for x in words.collect()}
        return found["first-ing"], found["other-ing"]

    first, other = class_of("first-ing", "other-ing")
    assert first != other and class_of("other-ing", "first-ing") == (other, first)


def test_cluster_of_awkward_rows(spark, awkward, clashing, nothing):
    model, words, found = brown.cluster(spark, clashing, F.col("doc_id") < 9)
    assert found.count() == 16 and found.columns.count("score") == 1 and "Score" not in found.columns
    assert found.where("score is null or base_score is null or score > 0").count() == 0
    assert {"_form", "_row", "__row", "number", "other"} < set(found.columns) and found.where("_row <> 'own _row'").count() == 0
    assert brown.score(spark, nothing, model, words).count() == 0
    none, empty, rows = brown.cluster(spark, awkward, F.lit(False))
    assert none.n_tokens == 0 and empty.count() == 0 and rows.count() == 16 and rows.where("n_known <> 0").count() == 0
    assert brown.cluster(spark, nothing, F.lit(True))[2].count() == 0


IDS = {"▁": 0, "a": 1, "b": 2, "ab": 3, "▁a": 4, "ba": 5}


def segmentations(word, p):
    """(probability, pieces) of every way to cut a word."""
    marked = "▁" + word

    def rec(i):
        if i == len(marked):
            yield 1.0, []
        for j in range(i + 1, len(marked) + 1):
            piece = IDS.get(marked[i:j], len(IDS) if j == i + 1 else None)
            if piece is not None:
                for q, rest in rec(j):
                    yield p[piece] * q, [piece, *rest]

    return list(rec(0))


def test_forward_and_backward_sum_all_segmentations():
    p = np.vstack([np.random.default_rng(0).random((6, 2)), np.full(2, 1e-7)])
    words = ["a", "ab", "abab", "bca", "ccc", "babab"]
    lattice = language.Lattice(words, IDS)
    weights = np.random.default_rng(1).random((len(words), 2))
    log, expected = lattice.likelihood(p), lattice.expected(p, weights)
    for k in range(2):
        want = np.zeros(7)
        for i, w in enumerate(words):
            ways = segmentations(w, p[:, k])
            total = sum(q for q, _ in ways)
            assert np.exp(log[i, k]) == pytest.approx(total)
            for q, pieces in ways:
                np.add.at(want, pieces, weights[i, k] * q / total)
        assert np.allclose(expected[:, k], want)


def test_languages_of_held_out_documents(spark, documents):
    r = random.Random(2)
    words = {
        "en": "the of and with this that house water under light".split(), "de": "der die und nicht mit haus wasser unter licht schön".split(),
        "fr": "le la les est dans maison avec sous lumière été".split(),
    }
    rows = [(i, " ".join(r.choices(words[k], k=r.randint(3, 30))), k, "s", 0) for i, k in enumerate(["en", "de", "fr"] * 70)]
    docs = documents(rows)
    out = common.held_out(F.col("doc_id"), 3)
    model = language.fit(spark, docs.where(~out))
    assert model.languages == ["de", "en", "fr"] and np.allclose(model.probabilities[:-1].sum(axis=0), 1)
    found = language.identify(spark, docs.where(out), model).collect()
    assert len(found) > 40 and all(r["lang"] == r["lang_pred"] and 0 <= r["score"] <= 1 for r in found)


def test_languages_of_awkward_rows(spark, awkward, clashing, nothing):
    model = language.fit(spark, awkward)
    found = language.identify(spark, clashing, model)
    by = {r["doc_id"]: r for r in found.collect()}
    assert found.count() == 16 and "Score" not in found.columns
    assert all(by[i]["lang_pred"] == "und" and by[i]["score"] == 0 for i in (0, 1, 2, 9))
    assert by[3]["lang_pred"] in model.languages and by[10]["lang_pred"] in model.languages
    none = language.fit(spark, nothing)
    assert language.identify(spark, awkward, none).where("lang_pred <> 'und'").count() == 0
    assert language.identify(spark, nothing, model).count() == 0
