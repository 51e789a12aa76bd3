"""Table schemas of the shop."""

from __future__ import annotations

from pyspark.sql import types as T

# Allowed codes and limits of the shop's rules.
COLLECTIONS = ("bridal", "party", "festive", "designer", "blouse")
COLLECTION_LABELS = {
    "bridal": "Bridal specials",
    "party": "Party wear",
    "festive": "Festive collection",
    "designer": "Designer wear",
    "blouse": "Embroidery blouses",
}
DISCOUNT_TYPES = ("percent", "amount")
ORDER_STATUSES = ("new", "confirmed", "shipped", "closed")
STORE_DISCOUNT_KEY = "store_discount"
MAX_DISCOUNT = 90
MAX_CART_LINES = 30
MAX_LINE_QTY = 10
MAX_PAGE_SIZE = 48
ADMIN_PAGE_SIZE = 200
DEFAULT_PAGE_SIZE = 12
REVIEWS_SHOWN = 30


_TYPES = {
    "INT": T.IntegerType(), "BIGINT": T.LongType(), "STRING": T.StringType(), "BOOLEAN": T.BooleanType(),
    "TIMESTAMP": T.TimestampType(), "ARRAY<STRING>": T.ArrayType(T.StringType()),
}


def _fields(spec: str) -> T.StructType:
    """Schema from ``name TYPE, ...``; unlike DDL parsing it needs no running session."""
    pairs = (field.split() for field in spec.split(","))
    return T.StructType([T.StructField(name, _TYPES[kind]) for name, kind in pairs])


ORDER_ITEM = _fields(
    "id INT, sku STRING, title STRING, price INT, list_price INT, discount_percent INT, qty INT"
)

PRODUCTS = _fields(
    "id INT, sku STRING, slug STRING, title STRING, collection STRING, fabric STRING, colour STRING, "
    "work STRING, blouse_size STRING, description STRING, price INT, mrp INT, stock INT, "
    "images ARRAY<STRING>, discount_type STRING, discount_value INT, active BOOLEAN, boost INT, "
    "views BIGINT, order_count BIGINT, rating_sum BIGINT, rating_count BIGINT, created_at TIMESTAMP"
)
REVIEWS = _fields(
    "id INT, product_id INT, name STRING, rating INT, body STRING, approved BOOLEAN, created_at TIMESTAMP"
)
ORDERS = T.StructType(
    _fields("id INT, ref STRING, name STRING, phone STRING, note STRING").fields
    + [T.StructField("items", T.ArrayType(ORDER_ITEM))]
    + _fields("total INT, status STRING, created_at TIMESTAMP").fields
)
SITE_HITS = _fields("day STRING, kind STRING, hits BIGINT")
SITE_VISITORS = _fields("day STRING, visitor STRING")
SITE_REFS = _fields("day STRING, ref STRING, hits BIGINT")
SETTINGS = _fields("key STRING, value STRING")

TABLES: dict[str, T.StructType] = {
    "products": PRODUCTS,
    "reviews": REVIEWS,
    "orders": ORDERS,
    "site_hits": SITE_HITS,
    "site_visitors": SITE_VISITORS,
    "site_refs": SITE_REFS,
    "settings": SETTINGS,
}

# Values a product column takes where a new row or an older file lacks it.
PRODUCT_DEFAULTS: dict[str, object] = {
    "fabric": "", "colour": "", "work": "", "blouse_size": "", "description": "",
    "mrp": 0, "stock": 1, "discount_type": "none", "discount_value": 0, "active": True,
    "boost": 0, "views": 0, "order_count": 0, "rating_sum": 0, "rating_count": 0,
}
