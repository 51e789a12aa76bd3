"""Every registered query against its SQL check."""

from __future__ import annotations

import os

import pytest

from check import compare, duck

import __spark_entry__ as contract
from stallwise.plans import CHECKS, QUERIES

SF_DIR = os.environ.get("SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def con():
    return duck(SF_DIR)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    verdict, _, _ = compare(spark, con, name, SF_DIR)
    assert verdict == "ok"


def test_every_query_has_a_check():
    assert set(QUERIES) == set(CHECKS)
    assert QUERIES.items() <= contract.queries().items() and CHECKS.items() <= contract.oracle_sql().items()


def test_entry(spark):
    rows = contract.entry(spark)
    assert "rank_score" in rows.columns and rows.count() >= 0
