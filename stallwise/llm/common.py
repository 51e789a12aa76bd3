"""Helpers shared by the operators: tables, held-out rows, appended columns, written intermediate tables."""

from __future__ import annotations

import gc
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_type

from stallwise.session import fresh_dir, ship_package

#: Entries that a per-process cache of words holds before it is emptied.
CACHE_ENTRIES = 300_000
#: Rows of a batch that are Python objects at the same time.
SLICE_ROWS = 2048


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def remainder(doc_id: Column, modulus: int) -> Column:
    """crc32 of the id's decimal text, modulo; null ids give null."""
    return (F.crc32(doc_id.cast("string").cast("binary")) % modulus).cast("int")


def held_out(doc_id: Column, modulus: int) -> Column:
    return F.coalesce(remainder(doc_id, modulus) == 1, F.lit(False))


def written(spark: SparkSession, df: DataFrame, label: str) -> DataFrame:
    """Write a table to the shared folder and read it back: cuts the lineage and outlives lost executors."""
    path = fresh_dir(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def helper_prefix(df: DataFrame) -> str:
    """Underscores that no column of ``df`` starts with, for the names of helper columns."""
    return "_" * (1 + max((len(c) - len(c.lstrip("_")) for c in df.columns), default=0))


def hash_fraction(key: Column, share: float) -> Column:
    """True for about ``share`` of the keys, the same ones whenever it is asked."""
    scale = 1 << 30
    return F.pmod(F.xxhash64(key), F.lit(scale)) < F.lit(int(min(1.0, share) * scale))


def appended(
    df: DataFrame, fields: list[T.StructField], work: Callable[[], Callable[[pa.RecordBatch], tuple]], keeps: bool = False
) -> DataFrame:
    """Every row with the given columns appended, batch by batch.

    ``work`` is called once per task and gives a function from a batch to (arrays, rows to keep or None); ``keeps`` says that it
    uses ``per_worker``.
    A column of ``df`` whose name clashes with an appended one (letter case aside) is replaced.
    """
    new = {f.name.lower() for f in fields}
    stays = [f for f in df.schema.fields if f.name.lower() not in new]
    names = [f.name for f in stays]
    schema = T.StructType(stays + fields)
    types = [to_arrow_type(f.dataType) for f in fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # rows are texts, numbers and lists of them, without cycles: rare collections save up to a third of the time
        gc.set_threshold(200_000, 50, 50)
        if not keeps:
            release()
        on_batch = work()
        for whole in batches:
            for at in range(0, whole.num_rows, SLICE_ROWS):
                batch = whole.slice(at, SLICE_ROWS)
                values, keep = on_batch(batch)
                arrays = [batch.column(batch.schema.get_field_index(n)) for n in names]
                arrays += [v if isinstance(v, pa.Array) else pa.array(v, type=t) for v, t in zip(values, types)]
                out = pa.RecordBatch.from_arrays(arrays, names=[f.name for f in schema.fields])
                yield out if keep is None else out.filter(pa.array(keep, type=pa.bool_()))
        pa.default_memory_pool().release_unused()

    return arrow_mapped(df, run, schema)


def arrow_mapped(df: DataFrame, run: Callable, schema: T.StructType) -> DataFrame:
    ship_package(df.sparkSession)
    return df.mapInArrow(run, schema)


_kept: dict[str, object] = {}


def per_worker(key: str, make: Callable[[], object]) -> object:
    """What ``make`` gave when it was first called for ``key`` in this Python worker, for caches that outlive a task.

    One key at a time is kept, and any task without a key gives its memory back.
    """
    if key not in _kept:
        release()
        _kept[key] = make()
    return _kept[key]


def release() -> None:
    _kept.clear()


def column(batch: pa.RecordBatch, name: str) -> list:
    return batch.column(batch.schema.get_field_index(name)).to_pylist()


def summed_counts(counts: DataFrame, keys: list[str], value: str = "n") -> DataFrame:
    return counts.groupBy(*keys).agg(F.sum(value).alias(value))


def to_dense(counts: DataFrame, index: str, value: str, size: int) -> np.ndarray:
    """A table of at most ``size`` rows (index, value) as an array."""
    pdf = counts.select(index, value).toPandas()
    out = np.zeros(size, dtype=np.float64)
    out[pdf[index].to_numpy()] = pdf[value].to_numpy()
    return out


def schema(text: str) -> T.StructType:
    return T.StructType.fromDDL(text)
