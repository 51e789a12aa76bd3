"""Text rules over whole text columns."""

from __future__ import annotations

from pyspark.sql import functions as F

from stallwise.functions import text as tx
from stallwise.plans.carts import inr_sql
from stallwise.plans.registry import query
from stallwise.sources.bindings import bind, sample

# Blank characters as the shop's forms see them, for the second engine's regular expressions.
WS = r"[\s\x{0B}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]"
WS_IN = WS[1:-1]
SLUG_SQL = rf"""coalesce(nullif(left(regexp_replace(regexp_replace(lower(text), '^{WS}+|{WS}+$|[^a-z0-9{WS_IN}-]', '', 'g'),
    '[{WS_IN}-]+', '-', 'g'), 70), ''), 'piece')"""


@query("slugify", f"SELECT doc_id, {SLUG_SQL} AS slug FROM documents")
def slugify(spark, sf):
    """Slugs of whole texts in four languages."""
    return sample(spark, sf, "documents").select("doc_id", tx.slugify(F.col("text")).alias("slug"))


@query("clean_text", rf"""SELECT doc_id, left(upper(replace(regexp_replace(text, '^{WS}+|{WS}+$', '', 'g'), 'ß', 'SS')), 40) AS head
       FROM documents""")
def clean_text(spark, sf):
    return sample(spark, sf, "documents").select("doc_id", tx.clean_text(F.col("text"), 40, upper=True).alias("head"))


INT_SQL = r"TRY_CAST(regexp_extract(raw, '^\s*([+-]?[0-9]+)', 1) AS BIGINT)"
RAW = """SELECT o_orderkey, CASE o_orderkey % 6 WHEN 0 THEN CAST(o_custkey AS STRING) || 'abc'
    WHEN 1 THEN '  ' || CAST(o_custkey AS STRING) WHEN 2 THEN CAST(o_custkey AS STRING) || '.9'
    WHEN 3 THEN 'x' || CAST(o_custkey AS STRING) WHEN 4 THEN '-' || CAST(o_custkey % 3 AS STRING) ELSE '' END AS raw
    FROM {orders}"""


@query("parse_int", f"""SELECT o_orderkey, coalesce({INT_SQL}, 0) AS value, coalesce(nullif({INT_SQL}, 0), 1) AS value_or_1
       FROM ({RAW.format(orders="orders")}) o""")
def parse_int(spark, sf):
    raw = F.col("raw")
    return spark.sql(RAW, orders=sample(spark, sf, "orders")).select(
        "o_orderkey", tx.parse_int(raw).alias("value"), tx.parse_int(raw, 1).alias("value_or_1")
    )


@query("phone_display", r"""SELECT order_id, CASE WHEN regexp_matches(d, '^91[0-9]{10}$')
       THEN '+91 ' || substr(d, 3, 5) || ' ' || substr(d, 8) ELSE '+' || d END AS display
       FROM (SELECT order_id, regexp_replace(phone, '[^0-9]', '', 'g') AS d FROM order_requests) o""", ("order_requests",))
def phone_display(spark, sf):
    return bind(spark, sf, "order_requests").select("order_id", tx.phone_display(F.col("phone")).alias("display"))


@query("inr_format", f"SELECT o_orderkey, '₹' || {inr_sql('CAST(floor(o_totalprice) AS BIGINT)')} AS amount FROM orders")
def inr_format(spark, sf):
    whole = F.floor("o_totalprice")
    return sample(spark, sf, "orders").select("o_orderkey", tx.rupees(whole).alias("amount"))
