"""Text files with broken rows: good rows as the declared table, the others with their text, file and reason.

A file is parsed once, with every column, and written to the shared folder: a reader that looks at fewer columns would not see what is
wrong with the others.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from stallwise.schemas import TABLES
from stallwise.session import fresh_dir
from stallwise.sources.tables import hydrate

RAW, FILE, REASON = "raw", "file", "reason"
#: Columns without which a row is nothing, by table.
REQUIRED = {"products": ("id", "sku"), "reviews": ("id", "product_id"), "orders": ("id", "ref"), "settings": ("key",)}


@dataclass(frozen=True)
class Intake:
    """``accepted`` has the columns of the table, ``rejected`` (raw, file, reason)."""

    accepted: DataFrame
    rejected: DataFrame


def _unreadable(fields: list[T.StructField], fmt: str, options: dict[str, str]) -> Column:
    """Names of the columns whose text is there but is not of their type, comma-joined; empty if the row itself is broken."""
    texts = ", ".join(f"`{f.name}` string" for f in fields)
    as_text = F.from_csv(RAW, texts, options) if fmt == "csv" else F.from_json(RAW, texts, options)
    names = [
        F.when(F.col(f.name).isNull() & (F.coalesce(as_text[f.name], F.lit("")) != ""), F.lit(f.name))
        for f in fields if not isinstance(f.dataType, T.StringType)
    ]
    return F.concat_ws(", ", *names)


def read_checked(
    spark: SparkSession, name: str, path: str, fmt: str = "csv", *, required: tuple[str, ...] | None = None, **options: str
) -> Intake:
    """One shop table from CSV or JSON lines, its broken rows apart.

    A row is rejected if it does not parse (cut short, too many columns), if a column holds text that is not of its type, or if a
    required column is empty. CSV holds nested columns as JSON text; such text that does not parse gives an empty list, as elsewhere.
    """
    schema, settings = TABLES[name], {"mode": "PERMISSIVE"}
    if fmt == "csv":
        settings |= {"header": "true", "escape": '"', "enforceSchema": "true"}
    settings |= options
    nested = [f for f in schema.fields if isinstance(f.dataType, T.ArrayType)] if fmt == "csv" else []
    fields = [T.StructField(f.name, T.StringType()) if f in nested else f for f in schema.fields]
    parsed = (
        spark.read.format(fmt).options(**settings).option("columnNameOfCorruptRecord", RAW)
        .schema(T.StructType([*fields, T.StructField(RAW, T.StringType())])).load(path).withColumn(FILE, F.input_file_name())
    )
    folder = fresh_dir(spark, f"intake-{name}")
    parsed.write.parquet(folder)
    rows = spark.read.schema(parsed.schema).parquet(folder)
    empty = [
        F.when(F.col(c).isNull() | (F.trim(F.col(c).cast("string")) == ""), F.lit(c)) for c in (REQUIRED.get(name, ()) if required is None else required)
    ]
    bad, missing = _unreadable(fields, fmt, {k: v for k, v in settings.items() if k in ("sep", "escape", "quote")}), F.concat_ws(", ", *empty)
    reason = (
        F.when(F.col(RAW).isNotNull() & (bad != ""), F.concat(F.lit("not of its type: "), bad))
        .when(F.col(RAW).isNotNull(), F.lit("not a row of this table"))
        .when(missing != "", F.concat(F.lit("missing: "), missing))
    )
    judged = rows.withColumn(REASON, reason)
    accepted = judged.where(F.col(REASON).isNull()).select(*(f.name for f in fields))
    as_read = F.to_json(F.struct(*(f.name for f in fields)))
    return Intake(
        accepted.withColumns({f.name: hydrate(F.col(f.name), f.dataType) for f in nested}) if nested else accepted,
        judged.where(F.col(REASON).isNotNull()).select(F.coalesce(RAW, as_read).alias(RAW), FILE, REASON),
    )
