"""Cart and order queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from stallwise.functions import text as tx
from stallwise.operators import catalog as cat, orders as od
from stallwise.plans.catalogue import price_sql
from stallwise.plans.registry import query, stamp, stamp_sql, with_position
from stallwise.schemas import ORDER_ITEM
from stallwise.sources.bindings import bind, settings
from stallwise.sources.tables import hydrate

CART = ("products_base", "cart_lines")
ORDERS = ("products_base", "cart_lines", "order_requests")
SHOP, SHOP_PHONE, PREFIX = "Example Shop", "910000000000", "SW"

PRICED_SQL = f"""priced AS (
    SELECT order_id, pos, product_id, sku, title, final_price AS price, list_price, discount_percent, qty,
           CASE WHEN qty < wanted THEN title || ': only ' || CAST(qty AS VARCHAR) || ' left' END AS trimmed
    FROM ({price_sql('''(SELECT c.order_id, c.pos, c.product_id, c.wanted, p.sku, p.title, p.price, p.discount_type,
                                p.discount_value, CAST(least(c.wanted, greatest(0, p.stock)) AS BIGINT) AS qty
                         FROM (SELECT order_id, pos, product_id,
                                      greatest(1, least(10, CASE WHEN qty_raw = 0 THEN 1 ELSE qty_raw END)) AS wanted
                               FROM cart_lines WHERE pos <= 30) c
                         JOIN products_base p ON p.id = c.product_id WHERE p.active)''')}) x WHERE qty >= 1)"""


def inr_sql(n: str) -> str:
    """Indian grouping by slices, up to nine digits."""
    s = f"CAST({n} AS VARCHAR)"
    return f"""CASE WHEN length({s}) <= 3 THEN {s}
        WHEN length({s}) <= 5 THEN left({s}, -3) || ',' || right({s}, 3)
        WHEN length({s}) <= 7 THEN left({s}, -5) || ',' || left(right({s}, 5), 2) || ',' || right({s}, 3)
        ELSE left({s}, -7) || ',' || left(right({s}, 7), 2) || ',' || left(right({s}, 5), 2) || ',' || right({s}, 3)
        END"""


def priced(spark: SparkSession, sf: str) -> DataFrame:
    lines = bind(spark, sf, "cart_lines")
    return od.price_cart(lines, bind(spark, sf, "products_base"), cat.store_discount(settings(spark)))


@query("price_cart", f"""WITH {PRICED_SQL} SELECT order_id, pos, product_id, sku, title, price, list_price,
       discount_percent, qty FROM priced""", CART)
def price_cart(spark, sf):
    return priced(spark, sf).drop("trimmed").withColumn("pos", F.col("pos").cast("bigint"))


@query("qty_trimmed", f"WITH {PRICED_SQL} SELECT order_id, pos, qty, trimmed FROM priced WHERE trimmed IS NOT NULL",
       CART)
def qty_trimmed(spark, sf):
    short = priced(spark, sf).filter("trimmed IS NOT NULL")
    return short.select("order_id", F.col("pos").cast("bigint").alias("pos"), "qty", "trimmed")


TOTALS_SQL = """totals AS (SELECT order_id, CAST(sum(price * qty) AS BIGINT) AS total,
    CAST(sum((list_price - price) * qty) AS BIGINT) AS saved, count(*) AS n_items FROM priced GROUP BY order_id)"""


@query("order_totals", f"WITH {PRICED_SQL}, {TOTALS_SQL} SELECT * FROM totals", CART)
def order_totals(spark, sf):
    return od.order_totals(priced(spark, sf))


@query("order_items", f"""WITH {PRICED_SQL} SELECT order_id, CAST(row_number() OVER (PARTITION BY order_id ORDER BY pos) - 1 AS BIGINT)
       AS nth, product_id AS id, sku, price, qty FROM priced""", CART)
def order_items(spark, sf):
    nested = od.nest_orders(priced(spark, sf)).select("order_id", F.posexplode("items").alias("nth", "item"))
    return nested.select(
        "order_id", F.col("nth").cast("bigint").alias("nth"), F.col("item.id").cast("bigint").alias("id"), "item.sku",
        F.col("item.price").cast("bigint").alias("price"), F.col("item.qty").cast("bigint").alias("qty"),
    )


@query("json_items", f"""WITH {PRICED_SQL} SELECT order_id,
       CAST(CASE WHEN order_id % 10 = 0 THEN 0 ELSE count(*) END AS BIGINT) AS n_items,
       CAST(CASE WHEN order_id % 10 = 0 THEN 0 ELSE sum(price * qty) END AS BIGINT) AS total
       FROM priced GROUP BY order_id""", CART)
def json_items(spark, sf):
    """Items written as JSON text and read back; text that is cut short reads as an empty list."""
    nested = od.nest_orders(priced(spark, sf))
    json = F.to_json("items")
    cut = F.when(F.col("order_id") % 10 == 0, F.expr("substring(to_json(items), 1, length(to_json(items)) - 3)"))
    items = hydrate(F.coalesce(cut, json), T.ArrayType(ORDER_ITEM))
    worth = F.aggregate("items", F.lit(0).cast("bigint"), lambda acc, i: acc + i["price"] * i["qty"])
    return nested.withColumn("items", items).select(
        "order_id", F.size("items").cast("bigint").alias("n_items"), worth.alias("total")
    )


VALID_SQL = """checked AS (
    SELECT r.order_id, left(trim(r.name), 80) AS name, left(trim(r.phone), 20) AS phone, r.note, r.created_at,
           CASE WHEN trim(r.name) = '' OR trim(r.phone) = '' THEN 'Add a name and a phone number.'
                WHEN r.order_id NOT IN (SELECT order_id FROM cart_lines) THEN 'Your bag is empty.'
                WHEN r.order_id NOT IN (SELECT order_id FROM priced)
                THEN 'Those pieces are no longer available.' END AS reason
    FROM order_requests r)"""


@query("validate_orders", f"WITH {PRICED_SQL}, {VALID_SQL} SELECT order_id, name, phone, note, reason FROM checked",
       ORDERS)
def validate_orders(spark, sf):
    requests = bind(spark, sf, "order_requests")
    checked = od.validate_orders(requests, bind(spark, sf, "cart_lines"), priced(spark, sf))
    return checked.select("order_id", "name", "phone", "note", "reason")


REF_SQL = f"'{PREFIX}' || right(to_base(epoch_ms(created_at), 36), 6)"


def placed(spark: SparkSession, sf: str) -> DataFrame:
    return od.place_orders(
        bind(spark, sf, "order_requests").drop("status"), bind(spark, sf, "cart_lines"),
        bind(spark, sf, "products_base"), cat.store_discount(settings(spark)), prefix=PREFIX,
    )


# of acceptable requests with one reference the first is placed
PLACED_SQL = f"""{PRICED_SQL}, {TOTALS_SQL}, {VALID_SQL},
    turns AS (SELECT *, {REF_SQL} AS ref, row_number() OVER (PARTITION BY {REF_SQL} ORDER BY order_id) AS turn
              FROM checked WHERE reason IS NULL)"""


@query("place_orders", f"""WITH {PLACED_SQL}
       SELECT c.order_id, ref, name, phone, note, n_items, total, 'new' AS status
       FROM turns c JOIN totals t ON t.order_id = c.order_id WHERE turn = 1""", ORDERS)
def place_orders(spark, sf):
    return placed(spark, sf).select(
        "order_id", "ref", "name", "phone", "note", F.size("items").cast("bigint").alias("n_items"), "total", "status"
    )


@query("refused_refs", f"""WITH {PLACED_SQL} SELECT order_id, ref, 'That reference is in use, send the order again.' AS reason
       FROM turns WHERE turn > 1""", ORDERS)
def refused_refs(spark, sf):
    return od.refused_refs(bind(spark, sf, "order_requests"), priced(spark, sf), prefix=PREFIX)


@query("place_and_count", f"""WITH {PLACED_SQL}
       SELECT p.id, CAST(p.order_count + coalesce(sum(x.qty), 0) AS BIGINT) AS order_count
       FROM products p LEFT JOIN (SELECT * FROM priced WHERE order_id IN (SELECT order_id FROM turns WHERE turn = 1)) x
            ON x.product_id = p.id GROUP BY p.id, p.order_count""", ("products", "products_base", "cart_lines", "order_requests"))
def place_and_count(spark, sf):
    """Orders are placed and the counters of their pieces go up, in one step."""
    _, counted = od.place_and_count(
        bind(spark, sf, "order_requests").drop("status"), bind(spark, sf, "cart_lines"), bind(spark, sf, "products"), prefix=PREFIX
    )
    return counted.select("id", "order_count")


@query("order_ref", f"SELECT order_id, {REF_SQL} AS ref FROM order_requests", ("order_requests",))
def order_ref(spark, sf):
    return bind(spark, sf, "order_requests").select("order_id", tx.order_ref(F.col("created_at"), PREFIX).alias("ref"))


ENCODE_SQL = "url_encode(message)"
for _code, _char in (("+", "%20"), ("%21", "!"), ("%27", "''"), ("%28", "("), ("%29", ")"), ("%2A", "*"), ("%7E", "~")):
    ENCODE_SQL = f"replace({ENCODE_SQL}, '{_code}', '{_char}')"


@query("order_message", f"""WITH {PLACED_SQL},
       listed AS (SELECT order_id, string_agg(CAST(qty AS VARCHAR) || ' x ' || title || ' (' || sku || ')', chr(10)
                                              ORDER BY pos) AS items FROM priced GROUP BY order_id),
       written AS (SELECT c.order_id, '{SHOP} enquiry ' || {REF_SQL} || chr(10) || items || chr(10)
                          || 'Total Rs ' || {inr_sql("total")} || chr(10)
                          || CASE WHEN saved > 0 THEN 'You save Rs ' || {inr_sql("saved")} || chr(10) ELSE '' END
                          || 'Name: ' || name || chr(10) || 'Phone: ' || phone AS message
                   FROM turns c JOIN totals t ON t.order_id = c.order_id JOIN listed l ON l.order_id = c.order_id
                   WHERE turn = 1)
       SELECT order_id, message, 'https://wa.me/{SHOP_PHONE}?text=' || {ENCODE_SQL} AS link FROM written""", ORDERS)
def order_message(spark, sf):
    return od.order_message(placed(spark, sf), SHOP, SHOP_PHONE).select("order_id", "message", "link")


@query("order_count_rollup", f"""WITH {PRICED_SQL}
       SELECT p.id, CAST(p.order_count + coalesce(sum(x.qty), 0) AS BIGINT) AS order_count
       FROM products p LEFT JOIN priced x ON x.product_id = p.id GROUP BY p.id, p.order_count""",
       ("products", "products_base", "cart_lines"))
def order_count_rollup(spark, sf):
    return od.apply_orders(bind(spark, sf, "products"), bind(spark, sf, "cart_lines")).select("id", "order_count")


@query("recent_orders", f"""SELECT position, order_id, name, phone, {stamp_sql("created_at")} AS created_at, status
       FROM (SELECT *, row_number() OVER (ORDER BY created_at DESC, order_id DESC) AS position FROM order_requests) r
       WHERE position <= 200""", ("order_requests",))
def recent_orders(spark, sf):
    orders = bind(spark, sf, "order_requests").withColumnRenamed("order_id", "id")
    top = with_position(od.recent_orders(orders), [F.col("created_at").desc(), F.col("id").desc()])
    return top.select("position", F.col("id").alias("order_id"), "name", "phone",
                      stamp("created_at").alias("created_at"), "status")


@query("order_status", """SELECT order_id, CASE note WHEN '1-URGENT' THEN 'shipped' WHEN '2-HIGH' THEN 'confirmed'
       WHEN '3-MEDIUM' THEN 'closed' ELSE 'new' END AS status FROM order_requests""", ("order_requests",))
def order_status(spark, sf):
    """Every order is changed twice; the later change stands, whatever it says."""
    orders = bind(spark, sf, "order_requests").withColumnRenamed("order_id", "id")
    change = (
        F.when(F.col("note") == "1-URGENT", "shipped").when(F.col("note") == "2-HIGH", "confirmed")
        .when(F.col("note") == "3-MEDIUM", "closed").otherwise(F.col("note"))
    )
    number = F.col("id").cast("string").alias("id")
    first = orders.select(number, F.lit("shipped").alias("status"), F.lit(1).alias("seq"))
    second = orders.select(number, change.alias("status"), F.lit(2).alias("seq"))
    done = od.set_order_status(orders.select("id", "status"), first.unionByName(second))
    return done.select(F.col("id").alias("order_id"), "status")


# ---- bags: every order is a bag, each of its lines an addition

BAG_SQL = """merged AS (SELECT order_id AS bag, product_id, least(CASE WHEN p.stock = 0 THEN 10 ELSE least(10, greatest(1, p.stock)) END,
                               CAST(sum(qty_raw) AS BIGINT)) AS qty
             FROM cart_lines c JOIN products_base p ON p.id = c.product_id GROUP BY order_id, product_id, p.stock)"""


def _additions(spark: SparkSession, sf: str) -> DataFrame:
    lines = bind(spark, sf, "cart_lines")
    return lines.select(F.col("order_id").alias("bag"), "product_id", F.col("qty_raw").alias("qty"))


@query("bag_merge", f"WITH {BAG_SQL} SELECT bag, product_id, CAST(qty AS BIGINT) AS qty FROM merged", CART)
def bag_merge(spark, sf):
    return od.bag_merge(_additions(spark, sf), bind(spark, sf, "products_base"))


@query("bag_totals", f"""WITH {BAG_SQL}
       SELECT bag, CAST(sum(qty) AS BIGINT) AS pieces, CAST(sum(final_price * qty) AS BIGINT) AS total,
              CAST(sum(greatest(0, list_price - final_price) * qty) AS BIGINT) AS saved
       FROM merged m JOIN ({price_sql("products_base")}) p ON p.id = m.product_id GROUP BY bag""", CART)
def bag_totals(spark, sf):
    prices = cat.with_pricing(bind(spark, sf, "products_base"), cat.store_discount(settings(spark)))
    pieces = prices.withColumn("price", F.col("final_price"))
    return od.bag_totals(od.bag_merge(_additions(spark, sf), pieces, carry=("price", "list_price")))
