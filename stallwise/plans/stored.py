"""Queries over tables stored in buckets, text files with broken rows, and JSON without a fixed shape."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from stallwise.operators import catalog as cat, orders as od
from stallwise.plans.carts import CART, PRICED_SQL, priced
from stallwise.plans.registry import query
from stallwise.schemas import ORDER_ITEM
from stallwise.session import fresh_dir
from stallwise.sources import colocated, intake, variants
from stallwise.sources.bindings import bind, settings
from stallwise.sources.tables import conform


@query("colocated_cart", f"""WITH {PRICED_SQL} SELECT order_id, pos, product_id, sku, title, price, list_price,
       discount_percent, qty FROM priced""", CART)
def colocated_cart(spark, sf):
    """Lines and pieces stored in the same buckets, then priced without a shuffle."""
    pieces = bind(spark, sf, "products_base").withColumn("product_id", F.col("id").cast("bigint"))
    stored = colocated.store(spark, bind(spark, sf, "cart_lines"), pieces, "product_id", buckets=16)
    lines, pieces = spark.table(stored.many), spark.table(stored.one)
    found = od.price_stored_cart(lines, pieces, stored.on, cat.store_discount(settings(spark)))
    return found.drop("trimmed").withColumn("pos", F.col("pos").cast("bigint"))


QUARANTINE_SQL = """SELECT id, CASE WHEN id % 20 NOT IN (3, 7, 11) THEN title END AS title,
       CASE id % 20 WHEN 3 THEN 'not of its type: price' WHEN 7 THEN 'not a row of this table' WHEN 11 THEN 'missing: sku' END AS reason
       FROM products_base"""


def _checked(spark: SparkSession, sf: str, fmt: str) -> DataFrame:
    """The catalogue as text lines, of which some have words for a price, some are cut short and some lack their SKU."""
    rows = conform(bind(spark, sf, "products_base"), "products").drop(*(["images"] if fmt == "json" else []))
    turn = F.col("id") % 20
    fields = rows.withColumns({
        "price": F.when(turn == 3, "free").otherwise(F.col("price").cast("string")) if fmt == "csv" else F.col("price").cast("string"),
        "sku": F.when(turn != 11, F.col("sku")),
        **({"images": F.lit("[]")} if fmt == "csv" else {}),
    })
    row = F.struct(*(F.col(c) for c in fields.columns))
    if fmt == "csv":
        line = F.to_csv(row, {"escape": '"'})
        line = F.when(turn == 7, F.substring_index(line, ",", 6)).otherwise(line)
    else:
        line = F.to_json(row.withField("price", F.col("price").cast("int")))
        words = F.regexp_replace(line, r'"price":\d+', '"price":"free"')
        line = F.when(turn == 7, F.substring(line, 1, 60)).when(turn == 3, words).otherwise(line)
    folder = fresh_dir(spark, f"lines-{fmt}")
    fields.select(line.alias("value")).write.text(folder)
    found = intake.read_checked(spark, "products", folder, fmt, **({"header": "false"} if fmt == "csv" else {}))
    number = F.regexp_extract("raw", r'^(?:\{"id":)?([0-9]+)', 1).cast("bigint")
    bad = found.rejected.select(number.alias("id"), F.lit(None).cast("string").alias("title"), "reason")
    return found.accepted.select(F.col("id").cast("bigint").alias("id"), "title", F.lit(None).cast("string").alias("reason")).unionByName(bad)


@query("quarantine_csv", QUARANTINE_SQL, ("products_base",))
def quarantine_csv(spark, sf):
    return _checked(spark, sf, "csv")


@query("quarantine_json", QUARANTINE_SQL, ("products_base",))
def quarantine_json(spark, sf):
    return _checked(spark, sf, "json")


@query("variant_items", f"""WITH {PRICED_SQL}, counted AS (
       SELECT order_id, count(*) AS n, sum((price + 1) * qty) AS total, count(*) FILTER (qty % 3 = 0) AS gifts, count(*) FILTER (qty % 4 = 0) AS boxes
       FROM priced WHERE order_id % 10 <> 0 GROUP BY order_id)
       SELECT o.order_id, coalesce(n, 0) AS n_items, CAST(coalesce(total, 0) AS BIGINT) AS total, coalesce(gifts + boxes, 0) AS n_extra,
              coalesce(2 * boxes, 0) AS layers
       FROM (SELECT DISTINCT order_id FROM priced) o LEFT JOIN counted c ON c.order_id = o.order_id""", CART)
def variant_items(spark, sf):
    """Items with fields that no schema names: prices go up by one, the other fields stay. Lists that are cut short read as empty ones."""
    wide = F.transform("items", lambda i: i.withField("gift", F.when(i["qty"] % 3 == 0, F.concat(F.lit("for "), i["sku"]))).withField(
        "box", F.when(i["qty"] % 4 == 0, F.struct(F.lit(2).alias("layers"), F.lit('a "lid"').alias("lid")))))
    text = F.to_json(wide)
    cut = F.when(F.col("order_id") % 10 == 0, F.substring(text, F.lit(1), F.length(text) - 3)).otherwise(text)
    orders = od.nest_orders(priced(spark, sf)).select("order_id", cut.alias("items"))

    def dearer(item):
        own = variants.known(item, ORDER_ITEM)
        return variants.with_known(item, own.withField("price", own["price"] + 1), ORDER_ITEM)

    again = orders.withColumn("items", variants.listed(F.transform(variants.elements(F.col("items")), dearer)))
    items = again.select("order_id", variants.elements(F.col("items")).alias("items")).select(
        "order_id", F.transform("items", lambda i: variants.known(i, ORDER_ITEM)).alias("own"),
        F.transform("items", lambda i: F.size(F.map_keys(variants.unknown(i, ORDER_ITEM)))).alias("extra"),
        F.transform("items", lambda i: F.coalesce(F.try_variant_get(i, "$.box.layers", "int"), F.lit(0))).alias("layers"),
    )
    zero = F.lit(0).cast("bigint")
    return items.select(
        "order_id", F.size("own").cast("bigint").alias("n_items"),
        F.aggregate("own", zero, lambda acc, i: acc + i["price"] * i["qty"]).alias("total"),
        F.aggregate("extra", zero, lambda acc, n: acc + n).alias("n_extra"), F.aggregate("layers", zero, lambda acc, n: acc + n).alias("layers"),
    )
