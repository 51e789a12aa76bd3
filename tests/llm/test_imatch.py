"""I-Match against plain Python: lexicon, subsets, order of documents, edited texts, likeness."""

from __future__ import annotations

import hashlib
import math
import random
import re

import pytest
from conftest import rows_of
from pyspark.sql import functions as F

from stallwise.llm import common, imatch, queries

GAP = re.compile(imatch.GAP)


def terms_of(text):
    return set(GAP.split((text or "").lower())) - {""}


def likeness(a, b):
    """Of two fingerprints, from their entries."""
    a, b = a.split(), b.split()
    shared = {x[:2] for x in a} & {x[:2] for x in b}
    a, b = ({x for x in y if x[:2] in shared} for y in (a, b))
    subsets = {x[:4] for x in a | b}
    return len(a & b) / len(subsets) if subsets else 0.0


@pytest.fixture(scope="module")
def hashes(spark):
    """Spark's 64-bit hash of words, and of sorted lists of such hashes."""

    def of(values, kind):
        rows = spark.createDataFrame([(v,) for v in values], f"v {kind}")
        return [r[0] for r in rows.coalesce(1).select(F.xxhash64("v")).collect()]

    return of


def by_hand(texts, corpus, hashes):
    """Fingerprints of texts with the lexicon of a corpus."""
    counts = {}
    for text in corpus:
        for term in terms_of(text):
            counts[term] = counts.get(term, 0) + 1
    low, high = len(corpus) * imatch.RAREST, max(1.0, len(corpus) * imatch.COMMONEST)
    words = sorted({w for t in texts for w in terms_of(t)} | set(counts))
    number = dict(zip(words, hashes(words, "string")))
    out = []
    for text in texts:
        own = terms_of(text)
        e = max(0, math.floor(math.log2(max(1, len(own)) * 2 / (imatch.SUBSETS * imatch.TERMS_A_SUBSET))))
        kept = sorted(number[w] for w in own if low <= counts.get(w, 0) <= high)
        cells = [
            (s, k, [t for t in kept if t % (imatch.SUBSETS << s) == k])
            for s in (e, e + 1) for k in sorted({t % (imatch.SUBSETS << s) for t in kept} & set(range(imatch.SUBSETS)))
        ]
        marks = hashes([c[2] for c in cells], "array<long>") if cells else []
        entries = [f"{s:02X}{k:02X}{h & 0xFFFFFFFF:08X}" for (s, k, _), h in zip(cells, marks)]
        out.append(" ".join(entries) or "====" + hashlib.sha256((text or "").encode()).hexdigest()[:32])
    return out


def random_texts(seed, n):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(400)]
    return [" ".join(rng.choices(words, k=rng.choice([0, 3, 40, 400]))) for _ in range(n)]


@pytest.mark.parametrize("limit", [imatch.BROADCAST_TERMS, 0])
def test_prints_equal_their_definition(spark, documents, hashes, monkeypatch, limit):
    monkeypatch.setattr(imatch, "BROADCAST_TERMS", limit)  # both ways of joining the lexicon
    texts = random_texts(3, 40)
    ids = random.Random(1).sample(range(1000), len(texts))
    docs = documents([(i, t, "en", "a", 0) for i, t in zip(ids, texts)])
    got = {r.doc_id: r for r in imatch.compared(spark, docs).collect()}
    order = sorted(zip(ids, texts))
    edits = []
    for place, (_, text) in enumerate(order):
        cut, following = len(text) // 4, order[(place + 1) % len(order)][1]
        edits.append(text[:len(text) - cut] + following[:cut])
    own, changed = by_hand([t for _, t in order], texts, hashes), by_hand(edits, texts, hashes)
    for place, (doc_id, text) in enumerate(order):
        row = got[doc_id]
        assert (row.n_chars, row.fingerprint, row.edited_fingerprint) == (len(text), own[place], changed[place])
        assert row.edited_sha256 == hashlib.sha256(edits[place].encode()).hexdigest()
        assert row.near_edited == pytest.approx(likeness(own[place], changed[place]))
        assert row.near_next == pytest.approx(likeness(own[place], own[(place + 1) % len(order)]))


def test_order_over_many_ranges(spark, documents):
    ids = random.Random(2).sample(range(10**9), 500)
    rows = imatch.keyed(documents([(i, f"text {i}", "en", "a", 0) for i in ids]).repartition(7), "doc_id", "text")
    links = {r._id: r._next_id for r in imatch.successors(spark, rows, [F.col("_key")]).collect()}
    ids.sort()
    assert links == dict(zip(ids, ids[1:] + ids[:1]))


def test_awkward_documents(spark, awkward, clashing, nothing):
    found = rows_of(imatch.compared(spark, awkward), "doc_id", "n_chars", "fingerprint", "near_edited", "near_next")
    texts = rows_of(awkward, "doc_id", "text")
    assert sorted((r[:2] for r in found), key=repr) == sorted(((i, len(t or "")) for i, t in texts), key=repr)
    assert all(0 <= r[3] <= 1 and 0 <= r[4] <= 1 for r in found)
    prints = {r[:2]: r[2] for r in found}
    assert len(set(prints.values())) == len({(t or "").lower() for _, t in texts})
    own = {r[0]: r[2] for r in found}
    assert own[3] == own[4] and own[5] == own[6] and own[11] == own[12] and own[0] == own[1] != own[2]
    names = {n: F.lit("own") for n in ("_id", "_print", "_key", "fingerprint", "edited", "term")}
    again = imatch.compared(spark, clashing.withColumns(names))
    assert rows_of(again, "doc_id", "n_chars", "fingerprint", "near_edited", "near_next") == found
    assert imatch.compared(spark, nothing).collect() == []


def test_an_only_document_is_its_own_next_one(spark, documents):
    row = imatch.compared(spark, documents(["one two three four"])).first()
    assert row.edited_sha256 == hashlib.sha256(b"one two three one ").hexdigest() and row.near_next == 1.0


def test_edits_are_nearer_than_neighbours(spark, sf):
    rows = queries.op12_imatch(spark, sf).where("n_chars > 300").collect()
    docs = {r.doc_id: r.text for r in common.table(spark, sf, "documents").collect()}
    assert all((docs[r.doc_id] is None) or len(docs[r.doc_id]) == r.n_chars for r in rows)
    assert sum(r.near_edited > r.near_next for r in rows) >= 0.97 * len(rows)
    assert sum(r.near_next < 0.1 for r in rows) >= 0.95 * len(rows)
