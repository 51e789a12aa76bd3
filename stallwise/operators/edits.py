"""Batch edits of the catalogue: every edit is checked, and either all are applied or none."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from stallwise.functions.text import clamp, clean_text, filled, leading_int, one_of, parse_int, parse_int32, trim, truthy
from stallwise.schemas import COLLECTIONS, DISCOUNT_TYPES, MAX_DISCOUNT
from stallwise.session import enable_checkpoints

# Editable columns with the length at which their text is cut (None: not text).
EDITABLE: dict[str, int | None] = {
    "title": 160, "sku": 40, "collection": None, "price": None, "mrp": None, "stock": None,
    "boost": None, "active": None, "discount_type": None, "discount_value": None,
    "fabric": 80, "colour": 80, "work": 80, "blouse_size": 80, "description": 2000,
}
# Messages, with the piece's id or the SKU put in.
PROBLEMS = {
    "unknown": "Piece {} no longer exists.",
    "title": "Piece {}: title cannot be empty.",
    "sku_empty": "Piece {}: SKU cannot be empty.",
    "sku_taken": "SKU {} already belongs to another piece.",
    "sku_twice": "SKU {} is used twice in these edits.",
    "collection": "Piece {}: unknown collection.",
    "price": "Piece {}: price must be above zero.",
}


def _message(problem: str, value: Column) -> Column:
    return filled(PROBLEMS[problem], value)


def flag(field: str) -> str:
    return f"has_{field}"


def edited_fields(edits: DataFrame) -> list[str]:
    """The known columns an edit table carries; others are ignored."""
    return [c for c in EDITABLE if c in edits.columns]


def with_flags(edits: DataFrame) -> DataFrame:
    """Make sure each edited column says by a flag whether the edit has it; NULL is a value of its own."""
    absent = [c for c in edited_fields(edits) if flag(c) not in edits.columns]
    return edits.withColumns({flag(c): F.col(c).isNotNull() for c in absent}) if absent else edits


def _typed(c: Column) -> Column:
    """A present but missing value reads as the text a form makes of it."""
    return F.coalesce(c.cast("string"), F.lit("null"))


def bulk_validate(edits: DataFrame, products: DataFrame, max_edits: int | None = None) -> DataFrame:
    """Check edits (seq, id, columns, ``has_`` flags) against the catalogue and each other.

    Every edit comes back with cleaned values and its first ``problem``, NULL if there is none. An edit whose id
    is missing or not a number names no piece, and that is its problem. ``seq``
    is the order of the edits and is unique. ``max_edits`` keeps the first so many, as a request limit does.
    """
    if max_edits is not None:
        edits = edits.orderBy("seq").limit(max_edits)
    fields = edited_fields(edits)
    rows = with_flags(edits).select(
        "seq", F.col("id").cast("string").alias("raw_id"), parse_int(F.col("id")).alias("id"),
        *fields, *(flag(c) for c in fields),
    )
    known = products.select(F.col("id").cast("bigint").alias("_piece"), F.col("price").alias("_old_price"))
    # an id that cannot be read is no number at all, not piece 0
    rows = rows.join(known, leading_int(F.col("raw_id")) == F.col("_piece"), "left")

    types = dict(edits.dtypes)
    has = {c: F.col(flag(c)) for c in fields}
    cleaned = {c: _clean(c, types[c]) for c in fields}
    rows = rows.withColumns(cleaned)
    if "discount_type" in fields:
        rows = _clamp_discount(rows, fields)

    any_field = F.lit(False)
    for c in fields:
        any_field = any_field | has[c]
    unknown = F.col("_piece").isNull()
    early = F.when(unknown, _message("unknown", F.col("raw_id")))
    if "title" in fields:
        early = early.when(has["title"] & (F.col("title") == ""), _message("title", F.col("id")))
    if "sku" in fields:
        early = early.when(has["sku"] & (F.col("sku") == ""), _message("sku_empty", F.col("id")))
    rows = rows.withColumn("problem", early)
    if "sku" in fields:
        rows = _check_skus(rows, products)
    late = F.when(F.col("problem").isNotNull(), F.col("problem"))
    if "collection" in fields:
        known_code = F.coalesce(F.col("collection").isin(*COLLECTIONS), F.lit(False))
        late = late.when(has["collection"] & ~known_code, _message("collection", F.col("id")))
    if "price" in fields:
        late = late.when(has["price"] & (F.col("price") <= 0), _message("price", F.col("id")))
    return rows.withColumn("problem", late).withColumn("has_any", any_field).drop("_old_price", "_piece")


def _clean(field: str, data_type: str) -> Column:
    """Value of a column as it will be stored."""
    value = F.col(field)
    if field == "sku":
        return F.substring(F.upper(trim(_typed(value))), 1, EDITABLE["sku"])
    if EDITABLE[field]:
        return clean_text(_typed(value), EDITABLE[field])
    if field in ("mrp", "stock", "discount_value"):
        return F.greatest(F.lit(0), parse_int32(value)).cast("int")
    if field == "price":
        return parse_int32(value)
    if field == "boost":
        return clamp(parse_int(value), 0, 10).cast("int")
    if field == "active":
        return truthy(value, data_type)
    if field == "discount_type":
        return one_of(value, DISCOUNT_TYPES, "none")
    return value


def _clamp_discount(rows: DataFrame, fields: list[str]) -> DataFrame:
    """Hold a discount within bounds when its type is part of the same edit; no type means no value."""
    typed = F.col(flag("discount_type"))
    price = F.col("_old_price")
    if "price" in fields:
        price = F.when(F.col(flag("price")), F.col("price")).otherwise(price)
    if "discount_value" not in fields:
        rows = rows.withColumns({"discount_value": F.lit(0), flag("discount_value"): F.lit(False)})
    value, kind = F.col("discount_value"), F.col("discount_type")
    held = (
        F.when(typed & (kind == "percent"), F.least(F.lit(MAX_DISCOUNT), value))
        .when(typed & (kind == "amount") & (value >= price), F.greatest(F.lit(0), price - 1))
        .when(typed & (kind == "none"), F.lit(0))
        .otherwise(value)
    )
    has_value = F.col(flag("discount_value")) | (typed & (kind == "none"))
    return rows.withColumns({"discount_value": held.cast("int"), flag("discount_value"): has_value})


def _check_skus(rows: DataFrame, products: DataFrame) -> DataFrame:
    """An edit's SKU must not belong to another piece, nor be claimed by an earlier edit of another piece.

    Where a piece has the SKU already, only edits of that piece get as far as claiming it. So one owner
    and one claimant per SKU are enough, and are looked up in a single join, whose hot keys can be split.
    """
    asks = F.col("problem").isNull() & F.col(flag("sku"))
    # edits without a SKU to check get a key of their own: they meet nothing in the join, in many tasks
    key = F.when(asks, F.concat(F.lit("sku "), "sku")).otherwise(F.concat(F.lit("edit "), F.col("seq").cast("string")))
    claims = rows.filter(asks).groupBy(F.col("sku").alias("_sku")).agg(F.min_by("id", "seq").alias("_claimant"))
    asked = products.select(F.upper("sku").alias("_sku"), "id").join(claims.select("_sku"), "_sku", "left_semi")
    owners = asked.groupBy("_sku").agg(F.max("id").cast("bigint").alias("_owner"))
    holders = claims.join(owners, "_sku", "left").select(
        F.concat(F.lit("sku "), "_sku").alias("_key"), "_claimant", "_owner"
    )
    other = (
        F.when(F.col("_owner") != F.col("id"), _message("sku_taken", F.col("sku")))
        .when(F.col("_owner").isNull() & (F.col("_claimant") != F.col("id")), _message("sku_twice", F.col("sku")))
    )
    return (
        rows.withColumn("_key", key).join(holders, "_key", "left")
        .withColumn("problem", F.coalesce("problem", other))
        .drop("_key", "_owner", "_claimant")
    )


def bulk_apply(products: DataFrame, validated: DataFrame) -> DataFrame:
    """Products after a checked batch. One problem anywhere leaves every product as it was.

    Where several edits touch the same column of a piece, the last one wins. The checked batch is written
    once, since it is read for its problems and for its values.
    """
    enable_checkpoints(products.sparkSession)
    validated = validated.checkpoint()
    fields = edited_fields(validated)
    clean = validated.filter("problem IS NOT NULL").agg((F.count(F.lit(1)) == 0).alias("ok")).scalar()
    last = validated.filter("has_any").groupBy("id").agg(
        *(F.max_by(c, F.when(F.col(flag(c)), F.col("seq"))).alias(f"_new_{c}") for c in fields),
        *(F.bool_or(flag(c)).alias(f"_set_{c}") for c in fields),
    )
    joined = products.join(last.filter(clean), "id", "left")
    changed = {
        c: F.when(F.col(f"_set_{c}"), F.col(f"_new_{c}")).otherwise(F.col(c)) for c in fields if c in products.columns
    }
    return joined.withColumns(changed).select(*products.columns)


def bulk_outcome(validated: DataFrame) -> DataFrame:
    """One row: number of problems, and of the pieces' edits applied (none if there is any problem)."""
    problems = F.count("problem")
    planned = F.count_if(F.col("has_any"))
    return validated.agg(
        problems.alias("problems"), F.when(problems == 0, planned).otherwise(F.lit(0)).alias("updated")
    )


def row_diff(before: DataFrame, after: DataFrame, fields: list[str], key: str = "id") -> DataFrame:
    """Cells that differ between two versions of a table: (key, field, value). Missing equals empty text."""
    old = before.select(key, *(F.col(c).cast("string").alias(f"_old_{c}") for c in fields))
    new = after.select(key, *(F.col(c).cast("string").alias(f"_new_{c}") for c in fields))
    cells = F.array(
        *(
            F.when(
                F.coalesce(f"_old_{c}", F.lit("")) != F.coalesce(f"_new_{c}", F.lit("")),
                F.struct(F.lit(c).alias("field"), F.coalesce(f"_new_{c}", F.lit("")).alias("value")),
            )
            for c in fields
        )
    )
    changed = old.join(new, key).select(key, F.explode(F.array_compact(cells)).alias("cell"))
    return changed.select(key, "cell.field", "cell.value")
