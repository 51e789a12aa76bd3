"""Run queries and their checks side by side: ``python tests/check.py [name ...]``."""

from __future__ import annotations

import os
import sys
import time

import duckdb
import pandas as pd

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def canonical(pdf: pd.DataFrame) -> list[tuple]:
    """Rows with columns by name, in an order that does not depend on the engine."""
    pdf = pdf[sorted(pdf.columns)].astype(object).where(pdf.notna(), None)
    return sorted((tuple(r) for r in pdf.itertuples(index=False)), key=repr)


def kinds(pdf: pd.DataFrame) -> dict[str, str]:
    return {c: ("text" if pdf[c].dtype.kind in "OUST" else pdf[c].dtype.kind) for c in sorted(pdf.columns)}


def compare(spark, con, name: str, sf_dir: str) -> tuple[str, int, float]:
    from stallwise.plans import CHECKS, QUERIES

    start = time.time()
    got = QUERIES[name](spark, sf_dir).toPandas()
    took = time.time() - start
    if name not in CHECKS:
        return "rows only", len(got), took
    want = con.execute(CHECKS[name]).df()
    if sorted(got.columns) != sorted(want.columns):
        return f"columns {sorted(got.columns)} / {sorted(want.columns)}", len(got), took
    left, right = canonical(got), canonical(want)
    if left != right:
        wrong = [(a, b) for a, b in zip(left, right) if a != b][:3]
        return f"values differ: {len(left)} / {len(right)} rows, {wrong}", len(got), took
    if kinds(got) != kinds(want):
        return f"types {kinds(got)} / {kinds(want)}", len(got), took
    return "ok", len(got), took


def main(names: list[str]) -> int:
    from stallwise.plans import QUERIES
    from stallwise.session import build_session

    sf_dir = os.environ.get("SF_DIR", "/root/testdata/sf0.01")
    spark = build_session("local[8]", **{"spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false",
                                         "spark.driver.memory": "8g"})
    spark.sparkContext.setLogLevel("ERROR")
    con = duck(sf_dir)
    bad = 0
    for name in names or list(QUERIES):
        try:
            verdict, rows, took = compare(spark, con, name, sf_dir)
        except Exception as e:  # report and go on
            verdict, rows, took = f"{type(e).__name__}: {str(e)[:700]}", -1, 0.0
        bad += verdict not in ("ok", "rows only")
        print(f"{name:28s} {rows:7d} {took:6.2f}s  {verdict}", flush=True)
    print("wrong:", bad)
    return bad


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
