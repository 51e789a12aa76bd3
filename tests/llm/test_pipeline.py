"""The pipeline and the registered queries, on the given tables and against brute force."""

from __future__ import annotations

import re

import duckdb
import pytest

import corpus_pipeline
from stallwise.llm import common, pii
from stallwise.llm.queries import CHECKS, QUERIES
from test_decontamination import brute as hits_of
from test_neardup import brute as components_of

SF = "/root/testdata/sf0.001"
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def stages(spark):
    """Each stage's input and result, as rows by id."""
    docs = common.table(spark, SF, "documents")
    out = []
    for name, stage in corpus_pipeline.STAGES:
        result = common.written(spark, stage(spark, docs, SF), f"test-{name}")
        out.append((name, docs, result))
        docs = result
    return out


def by_id(df):
    return {r["doc_id"]: r for r in df.collect()}


def test_stages_keep_the_columns(stages):
    assert [name for name, _, _ in stages] == ["toxicity", "near_duplicates", "decontamination", "personal_data", "mixing"]
    for _, _, result in stages[:-1]:
        assert result.columns == COLUMNS
    assert stages[-1][2].columns == [*COLUMNS, "size", "source_size", "target", "taken"]


def test_toxicity_stage(spark):
    """On a table with some hundred labels; the smallest one has a dozen toxic rows."""
    sf = "/root/testdata/sf0.01"
    before = common.table(spark, sf, "documents")
    labels = {r["doc_id"]: r["toxic"] for r in common.table(spark, sf, "labels").collect()}
    old, new = by_id(before), by_id(corpus_pipeline.drop_toxic(spark, before, sf))
    assert all(old[i] == r for i, r in new.items())
    clean = [i for i in old if labels.get(i) == 0]
    assert sum(i in new for i in clean) >= 0.97 * len(clean)
    toxic = [i for i in old if labels.get(i) == 1]
    assert sum(i not in new for i in toxic) > 0.5 * len(toxic)


def test_near_duplicate_stage(stages):
    _, before, after = stages[1]
    old, new = by_id(before), by_id(after)
    component = components_of([(i, r["text"]) for i, r in old.items()], 5)
    assert set(new) == {i for i, (_, c) in component.items() if c == i}


def test_decontamination_stage(spark, stages):
    _, before, after = stages[2]
    items = [(r["item_id"], r["text"]) for r in common.table(spark, SF, "benchmark").collect()]
    old, new = by_id(before), by_id(after)
    assert set(new) == {i for i, r in old.items() if not hits_of(r["text"], items)[-1]}


def test_personal_data_stage(stages):
    _, before, after = stages[3]
    old, new = by_id(before), by_id(after)
    assert set(new) == set(old)
    for i, r in new.items():
        assert pii.listed(pii.detected(r["text"])) == "" and r["n_chars"] == len(r["text"])
        if not any(pii.spans(old[i]["text"])[1].values()):
            assert r == old[i]
    assert any("[email]" in r["text"] for r in new.values())


def test_mixing_stage(stages):
    _, before, after = stages[4]
    old = by_id(before)
    for i, r in by_id(after).items():
        assert r["text"] == old[i]["text"] and 0 < r["taken"] <= 2 * r["size"] == 2 * len(re.findall(r"[^\x20\x09-\x0D]+", r["text"]))


def test_run_equals_the_stages(spark, stages):
    got = {r["doc_id"]: (r["text"], r["taken"]) for r in corpus_pipeline.run(spark, SF).collect()}
    assert got == {r["doc_id"]: (r["text"], r["taken"]) for r in stages[-1][2].collect()}


@pytest.mark.parametrize("index", range(5))
def test_stages_on_awkward_and_empty_tables(spark, awkward, clashing, nothing, index):
    name, stage = corpus_pipeline.STAGES[index]
    for docs in (awkward, clashing):
        result = stage(spark, docs, SF)
        extra = [] if index < 4 else ["size", "source_size", "target", "taken"]
        assert result.columns == [c for c in docs.columns if c.lower() not in extra] + extra
        assert 0 < result.count() <= 16
    assert stage(spark, nothing, SF).count() == 0


def test_every_operator_has_one_query(spark):
    assert [re.match(r"op(\d+)_", q)[1] for q in QUERIES] == [str(n) for n in range(1, 14)]


@pytest.mark.parametrize("name", [q for q in QUERIES if q != "op3_url_filters"])
def test_queries_return_every_document(spark, name):
    result = QUERIES[name](spark, SF)
    ids = sorted(r["doc_id"] for r in result.select("doc_id").collect())
    assert ids == sorted(r["doc_id"] for r in common.table(spark, SF, "documents").select("doc_id").collect())


def test_url_query_returns_every_page(spark):
    result = QUERIES["op3_url_filters"](spark, SF)
    assert result.count() == common.table(spark, SF, "pages").count()
    assert {r["verdict"] for r in result.select("verdict").distinct().collect()} <= {"allow", "block"}


@pytest.mark.parametrize("name", sorted(CHECKS))
def test_queries_equal_their_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    want, got = con.execute(CHECKS[name]).df(), QUERIES[name](spark, SF).toPandas()
    assert sorted(got.columns) == sorted(want.columns)
    columns = sorted(got.columns)
    rows = [sorted(map(tuple, df[columns].astype(object).where(df[columns].notna(), None).values.tolist()), key=repr) for df in (got, want)]
    assert rows[0] == rows[1]
    # whole numbers with nulls among them come as floats from one engine only
    kind = lambda c: (c.convert_dtypes() if c.isna().any() else c).dtype.kind
    assert [kind(got[c]) for c in columns] == [kind(want[c]) for c in columns]


def test_queries_equal_brute_force(spark):
    docs = [(r["doc_id"], r["text"]) for r in common.table(spark, SF, "documents").collect()]
    items = [(r["item_id"], r["text"]) for r in common.table(spark, SF, "benchmark").collect()]
    got = {r["doc_id"]: (r["n_words"], r["n_hit"], r["n_items"], r["items_sha256"], r["contaminated"]) for r in QUERIES["op7_decontamination"](spark, SF).collect()}
    assert got == {i: hits_of(t, items) for i, t in docs}
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in QUERIES["op5_minhash_dedup"](spark, SF).collect()}
    assert got == components_of(docs, 2)
