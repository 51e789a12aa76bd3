"""Names of the queries, the jobs behind them and their checks."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from stallwise.sources.bindings import with_ctes

Job = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Job] = {}
CHECKS: dict[str, str] = {}


def query(name: str, sql: str | None = None, reads: tuple[str, ...] = (), recursive: bool = False):
    """Register a job; ``sql`` is its check over the shop tables in ``reads``."""

    def add(job: Job) -> Job:
        if name in QUERIES:
            raise ValueError(f"two queries named {name}")
        QUERIES[name] = job
        if sql is not None:
            CHECKS[name] = with_ctes(sql, *reads, recursive=recursive) if reads else sql
        return job

    return add


def with_position(top: DataFrame, keys: list[Column]) -> DataFrame:
    """Number the rows of a page; only for results already cut to a page's size."""
    return top.withColumn("position", F.row_number().over(Window.orderBy(*keys)).cast("bigint"))


def stamp(c: Column | str) -> Column:
    return F.date_format(c, "yyyy-MM-dd HH:mm:ss")


def stamp_sql(expr: str) -> str:
    return f"strftime({expr}, '%Y-%m-%d %H:%M:%S')"
