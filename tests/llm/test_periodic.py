"""Runs against a direct search of every period, difference covers, and documents with awkward texts."""

from __future__ import annotations

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from conftest import rows_of

from stallwise.llm import common, periodic, queries

WORDS = re.compile(periodic.WORD)


def by_hand(words, shortest=6, powers=4):
    """Every maximal stretch of every period, smallest period of equal stretches, found word by word."""
    found = {}
    for q in range(1, len(words) // powers + 1):
        i = 0
        while i + q < len(words):
            start = i
            while i + q < len(words) and words[i] == words[i + q]:
                i += 1
            if i > start and i - start + q >= max(shortest, powers * q):
                found.setdefault((start, i - start + q), q)
            i += i == start
    return sorted(((s, n, q) for (s, n), q in found.items()), key=lambda r: (r[0], r[2]))


def random_text(rng):
    n, letters = rng.choice([0, 1, 5, 6, 7, 30, 80, 300]), rng.choice([1, 2, 3, 10])
    words = [rng.randrange(letters) for _ in range(n)]
    if n and rng.random() < 0.5:
        a, p = rng.randrange(n), rng.randint(1, max(1, n // 5))
        words = words[:a] + [words[a + (i - a) % p] for i in range(a, n)]
    return words


@pytest.mark.parametrize("r", range(7))
def test_every_difference_is_covered(r):
    v, cover = periodic.difference_cover(r)
    assert {(a - b) % v for a in cover for b in cover} == set(range(v))


@pytest.mark.parametrize(("seed", "cover"), [(1, 0), (2, 0), (3, 1), (4, 1), (5, 2)])
def test_extensions_are_counted_right(seed, cover):
    rng = random.Random(seed)
    words = random_text(rng) + [99] + random_text(rng) + [100] + [1, 2] * 200 + [101] + [1, 2] * 150 + [102]
    lce = periodic.Extensions(np.array(words, dtype=np.int64), periodic.difference_cover(cover))
    pairs = [(i, j) for i, j in ((rng.randrange(len(words)), rng.randrange(len(words))) for _ in range(3000)) if i != j]
    got = lce.between(*(np.array(x, dtype=np.int64) for x in zip(*pairs)))
    for (i, j), length in zip(pairs, got):
        k = 0
        while words[i + k] == words[j + k]:
            k += 1
        assert length == k


@pytest.mark.parametrize(("shortest", "powers", "points"), [(6, 4, 1 << 20), (6, 4, 50), (2, 2, 1000), (9, 3, 10)])
def test_runs_equal_a_direct_search(monkeypatch, shortest, powers, points):
    monkeypatch.setattr(periodic, "POINTS", points)
    rng = random.Random(7)
    for _ in range(60):
        texts = [random_text(rng) for _ in range(rng.randint(1, 5))]
        got = periodic.runs_of([np.array(t, dtype=np.int64) for t in texts], shortest, powers)
        want = [(k, *r) for k, t in enumerate(texts) for r in by_hand(t, shortest, powers)]
        assert [tuple(r) for r in got.tolist()] == want


def test_awkward_documents(awkward, clashing, nothing):
    found = rows_of(periodic.find(awkward), "doc_id", "words", "collapsed", "runs", "text")
    assert len(found) == awkward.count()
    for _, words, collapsed, runs, text in found:
        own = WORDS.findall(text or "")
        assert words == len(own)
        if len(own) < 5000:
            assert [tuple(r) for r in runs] == by_hand(own)
        if not runs:
            assert collapsed == " ".join(own)
    assert {r[0]: r[2] for r in found}[8] == "idiot"
    again = periodic.find(clashing.withColumnsRenamed({"other": "runs", "id": "WORDS", "host": "collapsed"}))
    assert rows_of(again, "doc_id", "words", "collapsed", "runs", "text") == found
    assert periodic.find(nothing).collect() == []


def test_query_equals_its_definition(spark, sf):
    docs = common.table(spark, sf, "documents").orderBy("doc_id").limit(150).collect()
    got = {r.doc_id: r for r in queries.op11_runs(spark, sf).collect()}
    for doc in docs:
        words, h = WORDS.findall(doc.text or ""), zlib.crc32(str(doc.doc_id).encode())
        if h % 10 == 0 and words:
            g = h // 10
            a = g % len(words)
            p = 1 + (len(words) - a) // (3 + g % 8)
            words = words[:a] + [words[a + (i - a) % p] for i in range(a, len(words))]
        runs, row = by_hand(words), got[doc.doc_id]
        best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=(None,) * 3)
        milli = 1000 * best[1] // best[2] if runs else None
        assert (row.n_runs, row.start, row.length, row.period, row.exponent_milli) == (len(runs), *best, milli)
        dropped = {i for s, n, q in runs for i in range(s + q, s + n)}
        kept = " ".join(w for i, w in enumerate(words) if i not in dropped)
        assert row.collapsed_sha256 == hashlib.sha256(kept.encode()).hexdigest()
        assert row.runs_sha256 == hashlib.sha256("".join(f"{s},{n},{q}\n" for s, n, q in runs).encode()).hexdigest()
