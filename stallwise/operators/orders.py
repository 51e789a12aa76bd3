"""Carts and orders: pricing of lines, totals, order rows, messages, sales counters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from stallwise.functions.pricing import with_pricing
from stallwise.functions.text import (
    clamp, clean_text, encode_component, indian_digits, order_ref, text, whole_number,
)
from stallwise.schemas import MAX_CART_LINES, MAX_LINE_QTY, ORDER_STATUSES

# Reasons for which an order is refused.
NO_CONTACT = "Add a name and a phone number."
EMPTY_BAG = "Your bag is empty."
GONE = "Those pieces are no longer available."
REF_TAKEN = "That reference is in use, send the order again."

#: Columns of a piece that its price is made of, and its names.
PRICED = ("sku", "title", "price", "discount_type", "discount_value")


def explode_carts(carts: DataFrame) -> DataFrame:
    """Cart arrays ``items: array<struct<id, qty>>`` as lines with a position counting from 1."""
    lines = carts.select("order_id", F.posexplode(F.slice("items", 1, MAX_CART_LINES)).alias("at", "line"))
    return lines.select(
        "order_id", (F.col("at") + 1).alias("pos"), F.col("line.id").alias("product_id"),
        F.col("line.qty").alias("qty_raw"),
    )


def _wanted(lines: DataFrame) -> DataFrame:
    """The lines that count, with the quantity asked for held within 1..10."""
    return lines.filter(F.col("pos") <= MAX_CART_LINES).select(
        "order_id", "pos", whole_number(lines, "product_id").alias("product_id"),
        clamp(whole_number(lines, "qty_raw", 1), 1, MAX_LINE_QTY).alias("wanted"),
    ).filter(F.col("product_id") != 0)


def _live(products: DataFrame, *columns: str) -> DataFrame:
    return products.filter("active").select(F.col("id").cast("bigint").alias("product_id"), "stock", *columns)


def _sellable() -> Column:
    return F.least(F.col("wanted"), F.greatest(F.lit(0), F.col("stock").cast("bigint")))


def price_cart(lines: DataFrame, products: DataFrame, store_percent: Column | int = 0) -> DataFrame:
    """Priced lines of all carts: (order_id, pos, product_id, qty_raw) against the live catalogue.

    Only the first 30 lines of a cart count; unknown, inactive and sold-out pieces drop out;
    the quantity is held within 1..10 and the stock, with a note where the stock was short.
    Lines of one piece stay separate.
    """
    return _priced(_wanted(lines).join(_live(products, *PRICED), "product_id"), store_percent)


def price_stored_cart(lines: DataFrame, pieces: DataFrame, on: tuple[str, ...], store_percent: Column | int = 0) -> DataFrame:
    """``price_cart`` over tables that are stored together by ``product_id`` (BIGINT in both) and joined on ``on``, without a shuffle."""
    wanted = clamp(whole_number(lines, "qty_raw", 1), 1, MAX_LINE_QTY).alias("wanted")
    asked = lines.filter((F.col("pos") <= MAX_CART_LINES) & (F.col("product_id") != 0)).select("order_id", "pos", *on, wanted)
    return _priced(asked.join(pieces.filter("active").select(*on, "stock", *PRICED), list(on)), store_percent)


def _priced(met: DataFrame, store_percent: Column | int) -> DataFrame:
    """Lines that met their piece, with quantity, prices and note."""
    sold = met.withColumn("qty", _sellable()).filter(F.col("qty") >= 1)
    return (
        with_pricing(sold, store_percent).select(
            "order_id", "pos", "product_id", "sku", "title", F.col("final_price").alias("price"),
            "list_price", "discount_percent", "qty",
            F.when(
                F.col("qty") < F.col("wanted"),
                F.concat(F.col("title"), F.lit(": only "), F.col("qty").cast("string"), F.lit(" left")),
            ).alias("trimmed"),
        )
    )


def order_totals(priced: DataFrame) -> DataFrame:
    """Total and saving per order."""
    return priced.groupBy("order_id").agg(
        F.sum(F.col("price") * F.col("qty")).alias("total"),
        F.sum((F.col("list_price") - F.col("price")) * F.col("qty")).alias("saved"),
        F.count(F.lit(1)).alias("n_items"),
    )


def nest_orders(priced: DataFrame) -> DataFrame:
    """One row per order: items in cart order (at most 30), stock notes, total and saving."""
    item = F.struct(
        "pos", F.col("product_id").cast("int").alias("id"), "sku", "title", F.col("price").cast("int").alias("price"),
        F.col("list_price").cast("int").alias("list_price"),
        F.col("discount_percent").cast("int").alias("discount_percent"), F.col("qty").cast("int").alias("qty"), "trimmed",
    )
    grouped = priced.groupBy("order_id").agg(
        F.array_sort(F.collect_list(item)).alias("items"),
        F.sum(F.col("price") * F.col("qty")).alias("total"),
        F.sum((F.col("list_price") - F.col("price")) * F.col("qty")).alias("saved"),
    )
    return grouped.select(
        "order_id",
        F.transform("items", lambda i: i.dropFields("pos", "trimmed")).alias("items"),
        F.array_compact(F.transform("items", lambda i: i["trimmed"])).alias("notes"),
        "total", "saved",
    )


def clean_requests(requests: DataFrame) -> DataFrame:
    """Contact fields and note as they are stored."""
    return requests.withColumns(
        {
            "name": clean_text(F.col("name"), 80),
            "phone": clean_text(F.col("phone"), 20),
            "note": F.substring(text(F.col("note")), 1, 500),
        }
    )


def validate_orders(requests: DataFrame, lines: DataFrame, priced: DataFrame) -> DataFrame:
    """Cleaned requests with the reason for refusing an order (NULL if it is accepted)."""
    sent = lines.select("order_id", F.lit(False).alias("_sold"))
    sold = priced.select("order_id", F.lit(True).alias("_sold"))
    bags = sent.unionByName(sold).groupBy("order_id").agg(F.bool_or("_sold").alias("_sold"))
    reason = (
        F.when((F.col("name") == "") | (F.col("phone") == ""), NO_CONTACT)
        .when(F.col("_sold").isNull(), EMPTY_BAG)
        .when(~F.col("_sold"), GONE)
    )
    return clean_requests(requests).join(bags, "order_id", "left").withColumn("reason", reason).drop("_sold")


def place_orders(
    requests: DataFrame, lines: DataFrame, products: DataFrame, store_percent: Column | int = 0, *, prefix: str,
    existing: DataFrame | None = None,
) -> DataFrame:
    """Order rows of the acceptable requests, status ``new``, with a reference made of ``created_at``.

    A request is acceptable if it names a person and a phone, at least one of its lines is sold, and its reference is free: not in
    ``existing`` (ref), and of acceptable requests with one reference the first by ``order_id``.
    """
    named = clean_requests(requests).filter((F.col("name") != "") & (F.col("phone") != ""))
    sold = nest_orders(price_cart(lines, products, store_percent))
    orders = named.join(sold, "order_id").withColumns(
        {"ref": order_ref(F.col("created_at"), prefix), "status": F.lit("new")}
    )
    if existing is not None:
        orders = orders.join(existing.select("ref").distinct(), "ref", "left_anti")
    # the rank filter is applied before the shuffle as well: each task sends one order of a reference
    turn = F.row_number().over(Window.partitionBy("ref").orderBy("order_id"))
    return orders.withColumn("_turn", turn).filter("_turn = 1").drop("_turn")


def refused_refs(requests: DataFrame, priced: DataFrame, *, prefix: str, existing: DataFrame | None = None) -> DataFrame:
    """(order_id, ref, reason) of the requests that are refused for their reference alone."""
    named = clean_requests(requests).filter((F.col("name") != "") & (F.col("phone") != ""))
    asked = named.join(priced.select("order_id").distinct(), "order_id", "left_semi").select(
        "order_id", order_ref(F.col("created_at"), prefix).alias("ref")
    )
    first = asked.groupBy("ref").agg(F.min("order_id").alias("order_id"))
    if existing is not None:
        first = first.join(existing.select("ref").distinct(), "ref", "left_anti")
    return asked.join(first.select("order_id"), "order_id", "left_anti").withColumn("reason", F.lit(REF_TAKEN))


def place_and_count(
    requests: DataFrame, lines: DataFrame, products: DataFrame, store_percent: Column | int = 0, *, prefix: str,
    existing: DataFrame | None = None,
) -> tuple[DataFrame, DataFrame]:
    """The new orders, and the products with the pieces of these orders added to their counters."""
    orders = place_orders(requests, lines, products, store_percent, prefix=prefix, existing=existing)
    return orders, apply_orders(products, lines.join(orders.select("order_id"), "order_id", "left_semi"))


def order_message(orders: DataFrame, shop: str, shop_phone: str) -> DataFrame:
    """Text of the enquiry and the chat link that carries it, encoded once."""
    lines = F.transform(
        "items",
        lambda i: F.concat(i["qty"].cast("string"), F.lit(" x "), i["title"], F.lit(" ("), i["sku"], F.lit(")")),
    )
    message = F.concat_ws(
        "\n",
        F.concat(F.lit(f"{shop} enquiry "), F.col("ref")),
        lines,
        F.concat(F.lit("Total Rs "), indian_digits(F.col("total"))),
        F.when(F.col("saved") > 0, F.concat(F.lit("You save Rs "), indian_digits(F.col("saved")))),
        F.concat(F.lit("Name: "), F.col("name")),
        F.concat(F.lit("Phone: "), F.col("phone")),
    )
    link = F.concat(F.lit(f"https://wa.me/{shop_phone}?text="), encode_component(F.col("message")))
    return orders.withColumn("message", message).withColumn("link", link)


def sold_quantities(lines: DataFrame, products: DataFrame) -> DataFrame:
    """Pieces sold per product over all carts.

    Lines are first counted per product and quantity asked for, which leaves at most ten rows of a
    product to meet the catalogue, however often it was ordered.
    """
    counted = _wanted(lines).groupBy("product_id", "wanted").agg(F.count(F.lit(1)).alias("n"))
    sold = counted.join(_live(products), "product_id")
    return sold.groupBy("product_id").agg(F.sum(_sellable() * F.col("n")).alias("sold"))


def apply_orders(products: DataFrame, lines: DataFrame) -> DataFrame:
    """Products with the sold quantities added to their order counters; stock is left alone."""
    sold = sold_quantities(lines, products)
    joined = products.join(sold, products["id"] == sold["product_id"], "left").drop("product_id")
    return joined.withColumn("order_count", F.col("order_count") + F.coalesce("sold", F.lit(0))).drop("sold")


def recent_orders(orders: DataFrame, n: int = 200) -> DataFrame:
    return orders.orderBy(F.col("created_at").desc(), F.col("id").desc()).limit(n)


def set_order_status(orders: DataFrame, changes: DataFrame) -> DataFrame:
    """Apply (id, status, seq) changes, the last one of an order winning; an unknown status means ``new``."""
    status = F.when(F.col("status").isin(*ORDER_STATUSES), F.col("status")).otherwise("new")
    last = changes.groupBy(whole_number(changes, "id").alias("id")).agg(F.max_by(status, "seq").alias("changed"))
    joined = orders.join(last, "id", "left")
    return joined.withColumn("status", F.coalesce("changed", "status")).drop("changed")


def bag_merge(additions: DataFrame, products: DataFrame, carry: tuple[str, ...] = ()) -> DataFrame:
    """Repeated additions (bag, product_id, qty) merged per piece, up to the piece's own limit.

    Every addition is at least 1, so cutting the sum once equals cutting after each addition.
    A piece without stock is limited to 10, as one with unknown stock is. ``carry`` names columns
    of the piece that go along.
    """
    stock = F.coalesce(F.nullif(F.col("stock").cast("bigint"), F.lit(0)), F.lit(MAX_LINE_QTY))
    cap = F.least(F.lit(MAX_LINE_QTY), F.greatest(F.lit(1), stock))
    merged = additions.groupBy("bag", "product_id").agg(F.sum("qty").alias("added"))
    pieces = products.select(F.col("id").alias("product_id"), cap.alias("cap"), *carry)
    return merged.join(pieces, "product_id").select(
        "bag", "product_id", F.least("cap", "added").cast("bigint").alias("qty"), *carry
    )


def bag_totals(bag_lines: DataFrame) -> DataFrame:
    """Pieces, total and saving per bag, from lines with price, list_price and qty."""
    listed = F.coalesce(F.nullif(F.col("list_price"), F.lit(0)), F.col("price"))
    return bag_lines.groupBy("bag").agg(
        F.sum("qty").alias("pieces"),
        F.sum(F.col("price") * F.col("qty")).alias("total"),
        F.sum(F.greatest(F.lit(0), listed - F.col("price")) * F.col("qty")).alias("saved"),
    )
