"""Archives: spans, marks across frames, exact round trips, and the forms of documents."""

from __future__ import annotations

import random

import pytest
from conftest import rows_of
from pyspark.sql import functions as F

from stallwise.llm import frames

ALPHABET = "ab <PSM>é一\U0001f600\n"


def packed(text, units):
    archive = frames.Archive()
    archive.write(text, units)
    return archive


def whole(archive):
    return b"".join(archive.read(0, archive.units)).decode()


@pytest.mark.parametrize("units", [1, 2, 3, 7, 4096])
def test_spans_marks_and_copies(units):
    rng = random.Random(units)
    for _ in range(200):
        text = "".join(rng.choice(ALPHABET) for _ in range(rng.randrange(60)))
        archive = packed(text, units)
        assert archive.units == len(text) and whole(archive) == text
        a, b = sorted((rng.randint(0, len(text)), rng.randint(0, len(text))))
        assert b"".join(archive.read(a, b)).decode() == text[a:b]
        for mark in frames.MARKS:
            assert archive.find(mark, a) == text.find(mark, a)
        out = frames.Archive()
        out.copy(archive, b, len(text))
        out.copy(archive, 0, b)
        assert whole(out) == text[b:] + text[:b] and out.units == len(text)


@pytest.mark.parametrize("form", [frames.PLAIN, frames.PSM, frames.SPM])
def test_every_cut_is_put_back(form):
    text = "a<b>\U0001f600<P<S<M é P> 一二\n<"
    for units in (1, 3, 100):
        source, out, back = packed(text, units), frames.Archive(), frames.Archive()
        for low in range(len(text) + 1):
            for high in range(low, len(text) + 1):
                frames.rearranged(source, out, form, low, high)
                p, m, s = text[:low], text[low:high], text[high:]
                want = {"plain": text, "psm": f"<P>{p}<S>{s}<M>{m}", "spm": f"<S>{s}<P>{p}<M>{m}"}[form]
                assert whole(out) == want
                frames.put_back(out, back, form)
                assert whole(back) == text


def test_only_cut_frames_are_opened(monkeypatch):
    source, out = packed("x" * 100_000, 1000), frames.Archive()
    opened = []
    monkeypatch.setattr(source, "open", lambda n, real=source.open: opened.append(n) or real(n))
    frames.rearranged(source, out, frames.PSM, 12_345, 67_890)
    assert sorted(opened) == [12, 12, 67, 67]
    assert source.frames[40] in out.frames


def test_damaged_outputs_are_refused():
    with pytest.raises(ValueError):
        frames.put_back(packed("no marks here", 4), frames.Archive(), frames.PSM)


def test_awkward_documents(awkward, clashing, nothing):
    docs = awkward.unionByName(awkward.limit(3).withColumns({"doc_id": F.lit(99).cast("long"), "text": F.lit("it <S> has one")}))
    outputs = frames.transformed(frames.stored(docs, frame_units=50), rearrange=100)
    back = frames.opened(frames.opened(frames.restored(outputs), "restored", "back"), "output", "out")
    rows = rows_of(back, "doc_id", "back", "out", "form", "n", "prefix_chars", "middle_chars")
    assert [r[:2] for r in rows] == [(i, t or "") for i, t in rows_of(docs.fillna({"text": ""}), "doc_id", "text")]
    for doc_id, text, out, form, n, prefix, middle in rows:
        assert n == len(text) and (form == "plain") == (text == "" or doc_id == 99)
        if form != "plain":
            low, high, _, four = frames.drawn(doc_id, n)
            assert (prefix, middle) == (low, high - low) and form == ("spm" if four < 20 else "psm")
            assert len(out) == n + 9
    again = frames.restored(frames.transformed(frames.stored(clashing.withColumnRenamed("other", "FRAMES"))))
    plain = frames.restored(frames.transformed(frames.stored(awkward)))
    digests = "doc_id", "output_sha256", "form", "restored_sha256"
    assert rows_of(again, *digests) == rows_of(plain, *digests)
    assert rows_of(plain, "restored_sha256") == rows_of(awkward.select(F.sha2(F.coalesce("text", F.lit("")), 256).alias("s")), "s")
    assert frames.restored(frames.transformed(frames.stored(nothing))).collect() == []
