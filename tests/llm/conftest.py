from __future__ import annotations

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def sf():
    return "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def documents(spark):
    """Build a documents table from texts, or from rows of the whole schema."""

    def build(rows):
        full = [
            r if isinstance(r, tuple) else (i, r, "en", f"src{i % 3}", None if r is None else len(r)) for i, r in enumerate(rows)
        ]
        return spark.createDataFrame(full, SCHEMA)

    return build


@pytest.fixture(scope="session")
def awkward(documents):
    """Nulls in every column, empty and very long texts, ties, repeated rows and ids."""
    long = " ".join(f"w{i % 997}" for i in range(40_000))
    rows = [
        (0, None, "en", "a", 0), (1, "", "en", None, 0), (2, " \n\t ", None, "", None), (3, long, "fr", "a", len(long)),
        (4, long, "fr", "b", len(long)), (5, "one", None, "a", 3), (5, "one", None, "a", 3), (6, "one", "en", "b", 3),
        (None, "one two three four five six", "en", "a", None), (None, None, None, None, None),
        (7, "x" * 100_000, "en", "a", 100_000), (8, "idiot " * 3000, "en", "c", 18_000), (9, "!!! *** ###", "en", "c", 11),
        (10, "ünï çødé – 一二三 \U0001f600", "de", "ü", 17), (11, "a b c d e f g", "en", "a", 13), (12, "A B C D E F G", "en", "a", 13),
    ]
    return documents(rows)


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def clashing(awkward):
    """Extra columns named like results and like helpers."""
    from pyspark.sql import functions as F

    names = ("Score", "kept", "size", "taken", "contaminated", "N_WORDS", "spans", "component_id", "number", "template", "id", "host", "other",
             "rejected", "ruled", "form", "url", "key", "_form", "_row", "_words", "_times", "_own", "_taken", "_doc_id", "_print", "__row")
    return awkward.withColumns({n: F.lit(f"own {n}") for n in names})


def rows_of(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=repr)
