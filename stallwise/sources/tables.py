"""Shop tables on files: fixed schemas, nested columns kept as JSON text, columns added later."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from stallwise.schemas import PRODUCT_DEFAULTS, TABLES

TEXT_FORMATS = ("csv",)


def read_table(spark: SparkSession, name: str, path: str, fmt: str = "parquet", **options: str) -> DataFrame:
    """Read one shop table with its declared schema; nothing is inferred.

    CSV holds nested columns as JSON text, which is parsed here.
    """
    schema = TABLES[name]
    nested = [f for f in schema.fields if isinstance(f.dataType, T.ArrayType)]
    if fmt in TEXT_FORMATS and nested:
        flat = T.StructType(
            [T.StructField(f.name, T.StringType()) if f in nested else f for f in schema.fields]
        )
        raw = spark.read.format(fmt).schema(flat).options(header="true", escape='"', **options).load(path)
        return raw.withColumns({f.name: hydrate(F.col(f.name), f.dataType) for f in nested})
    return spark.read.format(fmt).schema(schema).options(**options).load(path)


def write_table(
    df: DataFrame, path: str, fmt: str = "parquet", partition_by: tuple[str, ...] = (), mode: str = "errorifexists"
) -> None:
    """Write a table; CSV gets nested columns as JSON text."""
    if fmt in TEXT_FORMATS:
        df = df.withColumns(
            {f.name: F.to_json(f.name) for f in df.schema.fields if isinstance(f.dataType, T.ArrayType)}
        )
    writer = df.write.mode(mode).format(fmt)
    if fmt in TEXT_FORMATS:
        writer = writer.option("header", "true").option("escape", '"')
    (writer.partitionBy(*partition_by) if partition_by else writer).save(path)


def conform(df: DataFrame, name: str) -> DataFrame:
    """The declared columns of a shop table, in its order and types; columns that are absent are NULL."""
    have = set(df.columns)
    return df.select(
        *((F.col(f.name) if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name) for f in TABLES[name].fields)
    )


def hydrate(text: Column, data_type: T.DataType) -> Column:
    """Parse a JSON column; text that does not parse gives an empty list."""
    return F.coalesce(F.from_json(text, data_type), F.array().cast(data_type))


def add_missing_columns(products: DataFrame, defaults: dict[str, object] | None = None) -> DataFrame:
    """Bring an older product file up to date: absent columns appear, gaps take the default."""
    wanted = defaults or PRODUCT_DEFAULTS
    have = set(products.columns)
    return products.withColumns(
        {c: F.coalesce(F.col(c), F.lit(v)) if c in have else F.lit(v) for c, v in wanted.items()}
    )
