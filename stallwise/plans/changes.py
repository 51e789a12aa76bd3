"""Queries over table changes: new products, batch edits, replacements, removals, settings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from stallwise.functions import images as im
from stallwise.operators import edits as ed, mutations as mu
from stallwise.operators.slugs import assign_slugs
from stallwise.plans.catalogue import IMAGES_SQL
from stallwise.plans.registry import query, stamp, stamp_sql
from stallwise.session import fresh_dir
from stallwise.sources.bindings import bind, presence_flags, product_images, sample, settings
from stallwise.sources.tables import add_missing_columns, conform, read_table, write_table

BASE = ("products_base",)
CLEAN = ("products_base", "edits_clean")
DIRTY = ("products_base", "edits_dirty")
INT_SQL = r"coalesce(TRY_CAST(regexp_extract({0}, '^\s*([+-]?[0-9]+)', 1) AS BIGINT), 0)"


def whole(name: str) -> str:
    return INT_SQL.format(name)


def base(spark: SparkSession, sf: str) -> DataFrame:
    return bind(spark, sf, "products_base")


# ---- new products

RAW = """
SELECT id AS seq,
       CASE WHEN id % 19 = 4 THEN '   ' ELSE '  ' || title || ' ' END AS title,
       CASE WHEN id % 23 = 5 THEN ' ' ELSE ' ' || lower(title || '/' || fabric) || ' ' END AS sku,
       CASE WHEN id % 6 = 0 THEN 'carpets' ELSE collection END AS collection,
       CASE WHEN id % 29 = 6 THEN 'free' ELSE CAST(price AS STRING) || '.50' END AS price,
       CASE WHEN id % 5 = 3 THEN '-3' ELSE CAST(stock AS STRING) END AS stock,
       CAST(mrp AS STRING) AS mrp, CASE WHEN id % 13 = 0 THEN '99' END AS boost,
       ' ' || fabric AS fabric, CASE WHEN active THEN 'false' ELSE '' END AS active,
       CASE WHEN id % 7 = 0 THEN 'half' ELSE discount_type END AS discount_type,
       CAST(discount_value - 5 AS STRING) AS discount_value
FROM {products_base}
"""
RAW_SQL = RAW.format(products_base="products_base")
NORMAL_SQL = f"""normal AS (
    SELECT seq, title, sku, collection, price, mrp, stock, boost, fabric, active, value AS discount_value,
           CASE WHEN value = 0 THEN 'none' ELSE kind END AS discount_type
    FROM (SELECT *, CASE WHEN kind = 'percent' THEN least(90, given)
                         WHEN kind = 'amount' AND given >= price THEN greatest(0, price - 1) ELSE given END AS value
          FROM (SELECT seq, trim(title) AS title, upper(trim(sku)) AS sku,
                       CASE WHEN collection IN ('bridal', 'party', 'festive', 'designer', 'blouse') THEN collection
                            ELSE 'designer' END AS collection,
                       CAST({whole("price")} AS INT) AS price, CAST({whole("mrp")} AS INT) AS mrp,
                       CAST({whole("stock")} AS INT) AS stock, CAST({whole("boost")} AS INT) AS boost,
                       trim(fabric) AS fabric, length(active) > 0 AS active,
                       CASE WHEN discount_type IN ('percent', 'amount') THEN discount_type ELSE 'none' END AS kind,
                       CAST(greatest(0, {whole("discount_value")}) AS INT) AS given FROM ({RAW_SQL}) raw) typed) held)"""
NORMAL_COLUMNS = ("seq", "title", "sku", "collection", "price", "mrp", "stock", "boost", "fabric", "active",
                  "discount_type", "discount_value")


def raw(spark: SparkSession, sf: str) -> DataFrame:
    return spark.sql(RAW, products_base=base(spark, sf))


@query("normalise_products", f"WITH {NORMAL_SQL} SELECT {', '.join(NORMAL_COLUMNS)} FROM normal", BASE)
def normalise_products(spark, sf):
    return mu.normalise_products(raw(spark, sf)).select(*NORMAL_COLUMNS)


def slug_places_sql(new: str, used: str) -> str:
    """Slugs of ``new`` (id, root), plain roots only, given the slugs in ``used``: the k-th piece gets the k-th free place."""
    return f"""gone AS (SELECT DISTINCT root, place FROM (
            SELECT slug AS root, 1 AS place FROM {used}
            UNION ALL SELECT regexp_extract(slug, '^(.+)-([2-9]|[1-9][0-9]+)$', 1),
                             TRY_CAST(regexp_extract(slug, '^(.+)-([2-9]|[1-9][0-9]+)$', 2) AS BIGINT)
            FROM {used}) u WHERE place IS NOT NULL AND root <> ''),
        places AS (SELECT root, unnest(range(1, n + (SELECT count(*) FROM gone g WHERE g.root = r.root) + 1)) AS place
                   FROM (SELECT root, count(*) AS n FROM {new} GROUP BY root) r),
        free AS (SELECT root, place, row_number() OVER (PARTITION BY root ORDER BY place) AS k FROM places
                 WHERE (root, place) NOT IN (SELECT (root, place) FROM gone)),
        slugs AS (SELECT n.id, CASE WHEN place = 1 THEN n.root ELSE n.root || '-' || CAST(place AS VARCHAR) END AS slug
                  FROM (SELECT *, row_number() OVER (PARTITION BY root ORDER BY id) AS k FROM {new}) n
                  JOIN free f ON f.root = n.root AND f.k = n.k)"""


@query("unique_slugs", f"""WITH fresh AS (SELECT id, replace(title, ' ', '-') AS root FROM products_base WHERE stock > 0),
       used AS (SELECT slug FROM products_base WHERE stock <= 0), {slug_places_sql("fresh", "used")}
       SELECT id, slug FROM slugs""", BASE)
def unique_slugs(spark, sf):
    """Pieces in stock get new slugs next to those the sold-out pieces keep."""
    products = base(spark, sf)
    new = products.filter("stock > 0").select("id", "title")
    return assign_slugs(new, products.filter("stock <= 0").select("slug")).select("id", "slug")


@query("numbered_slugs", """WITH fresh AS (SELECT id, 'piece' || CASE WHEN id % 3 = 0 THEN '' ELSE '-' || CAST(id AS VARCHAR) END AS root FROM products_base),
       plain AS (SELECT id, row_number() OVER (ORDER BY id) AS k FROM fresh WHERE root = 'piece')
       SELECT id, root AS slug FROM fresh WHERE root <> 'piece'
       UNION ALL SELECT id, slug FROM (SELECT p.id, CASE WHEN place = 1 THEN 'piece' ELSE 'piece-' || CAST(place AS VARCHAR) END AS slug
             FROM plain p JOIN (SELECT place, row_number() OVER (ORDER BY place) AS k FROM (SELECT unnest(range(1, (SELECT max(id) FROM fresh) + 1)) AS place) q
                                WHERE place = 1 OR place % 3 = 0) f ON f.k = p.k) s""", BASE)
def numbered_slugs(spark, sf):
    """Two pieces of three are named by their number; the third ones take the plain name and the numbers left free."""
    products = base(spark, sf)
    title = F.when(F.col("id") % 3 == 0, "piece").otherwise(F.concat(F.lit("piece "), F.col("id")))
    none = products.select("slug").limit(0)
    return assign_slugs(products.select("id", title.alias("title")), none).select("id", "slug")


EXISTING_SQL = "existing AS (SELECT upper(title || '/' || fabric) AS sku, slug FROM products_base WHERE NOT active)"


@query("create_products", f"""WITH {NORMAL_SQL}, {EXISTING_SQL},
       checked AS (SELECT n.*, CASE WHEN title = '' THEN 'Give the piece a title.' WHEN sku = '' THEN 'Give the piece an SKU.'
                                    WHEN price <= 0 THEN 'Set a price above zero.'
                                    WHEN sku IN (SELECT sku FROM existing)
                                    THEN 'SKU ' || sku || ' is already in the catalogue.' END AS early FROM normal n),
       decided AS (SELECT *, CASE WHEN early IS NOT NULL THEN early
                                  WHEN row_number() OVER (PARTITION BY sku, early IS NULL ORDER BY seq) > 1
                                  THEN 'SKU ' || sku || ' is already in the catalogue.' END AS reason FROM checked),
       fresh AS (SELECT seq AS id, replace(title, ' ', '-') AS root FROM decided WHERE reason IS NULL),
       {slug_places_sql("fresh", "existing")}
       SELECT d.seq, d.sku, d.title, d.price, d.reason, s.slug FROM decided d LEFT JOIN slugs s ON s.id = d.seq""", BASE)
def create_products(spark, sf):
    sku = F.upper(F.concat("title", F.lit("/"), "fabric"))
    existing = base(spark, sf).filter("NOT active").select(sku.alias("sku"), "slug")
    return mu.create_products(raw(spark, sf), existing).select("seq", "sku", "title", "price", "reason", "slug")


@query("insert_if_absent", """SELECT min(id) AS id, sku FROM (SELECT id, title || '/' || fabric AS sku FROM products_base) n
       WHERE sku NOT IN (SELECT title || '/' || fabric FROM products_base WHERE NOT active) GROUP BY sku""", BASE)
def insert_if_absent(spark, sf):
    sku = F.concat("title", F.lit("/"), "fabric").alias("sku")
    products = base(spark, sf)
    return mu.insert_if_absent(products.select("id", sku), products.filter("NOT active").select(sku))


@query("schema_defaults", """SELECT id, 'none' AS discount_type, 0 AS discount_value, description,
       CASE WHEN mrp = 0 THEN 0 ELSE mrp END AS mrp, 0 AS views FROM products_base""", BASE)
def schema_defaults(spark, sf):
    """An older file: no discount columns, no counters, gaps in description and MRP."""
    older = base(spark, sf).drop("discount_type", "discount_value").withColumns(
        {"description": F.nullif("description", F.lit("")), "mrp": F.nullif("mrp", F.lit(0))}
    )
    return add_missing_columns(older).select("id", "discount_type", "discount_value", "description", "mrp", "views")


# ---- replacements

UPDATE = """
SELECT id AS seq, CASE WHEN id % 31 = 2 THEN 'x' ELSE CAST(id AS STRING) END AS id,
       CASE WHEN id % 17 = 3 THEN ' ' ELSE title || ' II' END AS title,
       CASE WHEN id % 10 = 5 THEN 'set-' || CAST(CAST(floor(id / 100e0) AS BIGINT) AS STRING)
            WHEN id % 9 = 1 THEN other_sku ELSE sku END AS sku,
       collection, CASE WHEN id % 21 = 7 THEN '0' ELSE CAST(price + 1 AS STRING) END AS price,
       CAST(stock AS STRING) AS stock, 'yes' AS active, discount_type, CAST(discount_value AS STRING) AS discount_value
FROM (SELECT p.*, o.sku AS other_sku FROM {products_base} p JOIN {products_base} o ON o.id = p.id + CASE WHEN p.id % 9 = 1 THEN -1 ELSE 0 END) q
"""
UPDATE_SQL = UPDATE.format(products_base="products_base")
UPDATED_SQL = f"""typed AS (SELECT seq, {whole("id")} AS id, trim(title) AS title, upper(trim(sku)) AS sku, collection,
                                   CAST({whole("price")} AS INT) AS price, CAST({whole("stock")} AS INT) AS stock,
                                   discount_type AS kind, CAST({whole("discount_value")} AS INT) AS given FROM ({UPDATE_SQL}) u),
    held AS (SELECT *, CASE WHEN kind = 'percent' THEN least(90, given)
                            WHEN kind = 'amount' AND given >= price THEN greatest(0, price - 1) ELSE given END AS value FROM typed),
    early AS (SELECT h.*, CASE WHEN p.id IS NULL THEN 'No such piece.' WHEN h.title = '' THEN 'Give the piece a title.'
                               WHEN h.price <= 0 THEN 'Set a price above zero.' END AS early, o.id AS owner
              FROM held h LEFT JOIN products_base p ON p.id = h.id LEFT JOIN products_base o ON o.sku = h.sku),
    -- sets have no owner at first, and the first piece that may take one keeps it; the owner of another piece's SKU has
    -- given it up if it has come before and got a set
    got_set AS (SELECT id, min(seq) AS seq FROM (SELECT *, row_number() OVER (PARTITION BY sku ORDER BY seq) AS place FROM early
                                                 WHERE early IS NULL AND owner IS NULL) q WHERE place = 1 GROUP BY id),
    decided AS (SELECT e.*, CASE WHEN early IS NOT NULL THEN early
                                 WHEN (e.owner IS NULL AND own.seq IS NULL) OR (e.owner <> e.id AND coalesce(g.seq >= e.seq, true))
                                 THEN 'SKU ' || sku || ' belongs to another piece.' END AS reason
                FROM early e LEFT JOIN got_set own ON own.id = e.id AND own.seq = e.seq LEFT JOIN got_set g ON g.id = e.owner)"""


def _update(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    products = product_images(base(spark, sf))
    updates = spark.sql(UPDATE, products_base=base(spark, sf))
    return mu.full_update(products, updates)


@query("full_update", f"""WITH {UPDATED_SQL}
       SELECT p.id, coalesce(d.sku, p.sku) AS sku, coalesce(d.title, p.title) AS title, coalesce(d.price, p.price) AS price,
              coalesce(d.value, p.discount_value) AS discount_value,
              CASE WHEN d.id IS NULL THEN p.discount_type WHEN d.value = 0 THEN 'none' ELSE d.kind END AS discount_type,
              CASE WHEN d.id IS NULL THEN p.fabric ELSE '' END AS fabric,
              CASE WHEN d.id IS NULL THEN p.active ELSE true END AS active
       FROM products_base p LEFT JOIN (SELECT * FROM decided WHERE reason IS NULL) d ON d.id = p.id""", BASE)
def full_update(spark, sf):
    products, _ = _update(spark, sf)
    return products.select("id", "sku", "title", "price", "discount_value", "discount_type", "fabric", "active")


@query("full_update_reasons", f"WITH {UPDATED_SQL} SELECT seq, id, sku, reason FROM decided", BASE)
def full_update_reasons(spark, sf):
    _, checked = _update(spark, sf)
    return checked.select("seq", "id", "sku", "reason")


@query("sku_clash", """SELECT c.id, c.sku, o.id AS owner
       FROM (SELECT p.id, CASE WHEN p.id % 5 = 0 THEN n.sku ELSE p.sku END AS sku
             FROM products_base p LEFT JOIN products_base n ON n.id = p.id - 1) c
       JOIN products_base o ON o.sku = c.sku AND o.id <> c.id""", BASE)
def sku_clash(spark, sf):
    products = base(spark, sf)
    before = products.select((F.col("id") + 1).alias("id"), F.col("sku").alias("previous"))
    asked = products.select("id", "sku").join(before, "id", "left")
    changed = F.when(F.col("id") % 5 == 0, F.col("previous")).otherwise(F.col("sku"))
    return mu.sku_clashes(asked.select("id", changed.alias("sku")), products)


# ---- batch edits

EDIT_OUT = ("title", "sku", "collection", "price", "mrp", "stock", "boost", "active", "discount_type",
            "discount_value", "fabric", "colour")


def edit_sql(edits: str) -> str:
    """Check of the edit rules; absent fields stay NULL."""
    return f"""typed AS (
        SELECT e.seq, e.id AS raw_id, {whole("e.id")} AS id, p.price AS old_price,
               left(trim(e.title), 160) AS title, left(upper(trim(e.sku)), 40) AS sku, e.collection,
               CASE WHEN e.price IS NOT NULL THEN {whole("e.price")} END AS price,
               CASE WHEN e.mrp IS NOT NULL THEN greatest(0, {whole("e.mrp")}) END AS mrp,
               CASE WHEN e.stock IS NOT NULL THEN greatest(0, {whole("e.stock")}) END AS stock,
               CASE WHEN e.boost IS NOT NULL THEN greatest(0, least(10, {whole("e.boost")})) END AS boost,
               CASE WHEN e.active IS NOT NULL THEN length(e.active) > 0 END AS active,
               CASE WHEN e.discount_type IS NOT NULL
                    THEN CASE WHEN e.discount_type IN ('percent', 'amount') THEN e.discount_type ELSE 'none' END END AS discount_type,
               CASE WHEN e.discount_value IS NOT NULL THEN greatest(0, {whole("e.discount_value")}) END AS given,
               left(trim(e.fabric), 80) AS fabric, left(trim(e.colour), 80) AS colour
        FROM {edits} e LEFT JOIN products_base p ON p.id = {whole("e.id")}),
    held AS (SELECT *, CASE WHEN discount_type = 'none' THEN 0
                            WHEN discount_type = 'percent' THEN least(90, given)
                            WHEN discount_type = 'amount' AND given >= coalesce(price, old_price)
                            THEN greatest(0, coalesce(price, old_price) - 1)
                            ELSE given END AS discount_value FROM typed),
    early AS (SELECT h.*, CASE WHEN old_price IS NULL THEN 'Piece ' || coalesce(raw_id, 'null') || ' no longer exists.'
                               WHEN h.title = '' THEN 'Piece ' || CAST(h.id AS VARCHAR) || ': title cannot be empty.'
                               WHEN h.sku = '' THEN 'Piece ' || CAST(h.id AS VARCHAR) || ': SKU cannot be empty.'
                               WHEN o.id IS NOT NULL AND o.id <> h.id
                               THEN 'SKU ' || h.sku || ' already belongs to another piece.' END AS early
              FROM held h LEFT JOIN products_base o ON upper(o.sku) = h.sku),
    checked AS (SELECT *, CASE WHEN early IS NOT NULL THEN early
                               WHEN sku IS NOT NULL AND first_value(id) OVER (PARTITION BY sku, early IS NULL ORDER BY seq) <> id
                               THEN 'SKU ' || sku || ' is used twice in these edits.'
                               WHEN collection NOT IN ('bridal', 'party', 'festive', 'designer', 'blouse')
                               THEN 'Piece ' || CAST(id AS VARCHAR) || ': unknown collection.'
                               WHEN price <= 0 THEN 'Piece ' || CAST(id AS VARCHAR) || ': price must be above zero.'
                          END AS problem FROM early)"""


def checked(spark: SparkSession, sf: str, name: str) -> DataFrame:
    edits = presence_flags(bind(spark, sf, name))
    return ed.bulk_validate(edits, base(spark, sf))


@query("bulk_validate", f"""WITH {edit_sql("edits_dirty")} SELECT seq, raw_id, problem,
       {", ".join(f"coalesce(CAST({c} AS VARCHAR), '-') AS {c}" for c in EDIT_OUT)} FROM checked""", DIRTY)
def bulk_validate(spark, sf):
    values = [
        F.coalesce(F.when(F.col(ed.flag(c)), F.col(c).cast("string")), F.lit("-")).alias(c) for c in EDIT_OUT
    ]
    return checked(spark, sf, "edits_dirty").select("seq", "raw_id", "problem", *values)


APPLIED_SQL = ("SELECT p.id, " + ", ".join(f"coalesce(c.{c}, p.{c}) AS {c}" for c in ("title", "sku", "collection", "active", "discount_type", "fabric", "colour"))
               + ", " + ", ".join(f"CAST(coalesce(c.{c}, p.{c}) AS INT) AS {c}" for c in ("price", "mrp", "stock", "boost", "discount_value"))
               + " FROM products_base p LEFT JOIN checked c ON c.id = p.id")


@query("bulk_apply", f"WITH {edit_sql('edits_clean')} {APPLIED_SQL}", CLEAN)
def bulk_apply(spark, sf):
    return ed.bulk_apply(base(spark, sf), checked(spark, sf, "edits_clean")).select("id", *EDIT_OUT)


@query("bulk_apply_refused", f"SELECT id, {', '.join(EDIT_OUT)} FROM products_base", BASE)
def bulk_apply_refused(spark, sf):
    """A batch with problems leaves every product as it was."""
    return ed.bulk_apply(base(spark, sf), checked(spark, sf, "edits_dirty")).select("id", *EDIT_OUT)


@query("bulk_outcome", f"""WITH {edit_sql("edits_dirty")}
       SELECT count(problem) AS problems, CAST(0 AS BIGINT) AS updated FROM checked""", DIRTY)
def bulk_outcome(spark, sf):
    return ed.bulk_outcome(checked(spark, sf, "edits_dirty")).select(
        "problems", F.col("updated").cast("bigint").alias("updated")
    )


DIFF_FIELDS = ("title", "price", "stock", "active", "fabric")


@query("row_diff", f"WITH {edit_sql('edits_clean')}, applied AS ({APPLIED_SQL}) " + " UNION ALL ".join(
       f"""SELECT p.id, '{c}' AS field, CAST(a.{c} AS VARCHAR) AS value FROM products_base p JOIN applied a ON a.id = p.id
           WHERE CAST(a.{c} AS VARCHAR) <> CAST(p.{c} AS VARCHAR)""" for c in DIFF_FIELDS), CLEAN)
def row_diff(spark, sf):
    products = base(spark, sf)
    return ed.row_diff(products, ed.bulk_apply(products, checked(spark, sf, "edits_clean")), list(DIFF_FIELDS))


# ---- removals, settings

@query("delete_cascade", """SELECT id, product_id, rating FROM reviews
       WHERE product_id NOT IN (SELECT id FROM products_base WHERE stock = 0)""", ("products_base", "reviews"))
def delete_cascade(spark, sf):
    products = base(spark, sf)
    _, reviews = mu.delete_products(products, bind(spark, sf, "reviews"), products.filter("stock = 0").select("id"))
    return reviews.select("id", "product_id", "rating")


@query("delete_products", "SELECT id, sku FROM products_base WHERE stock <> 0", BASE)
def delete_products(spark, sf):
    products = base(spark, sf)
    kept, _ = mu.delete_products(products, bind(spark, sf, "reviews"), products.filter("stock = 0").select("id"))
    return kept.select("id", "sku")


CHANGE = """SELECT CASE WHEN o_orderpriority = '5-LOW' THEN 'store_discount' ELSE o_orderpriority END AS key,
    CAST(o_custkey AS STRING) AS value, o_orderkey AS seq FROM {orders}"""


@query("settings_upsert", f"""SELECT key, CASE WHEN key = 'store_discount'
       THEN CAST(least(90, CAST(arg_max(value, seq) AS BIGINT)) AS VARCHAR) ELSE arg_max(value, seq) END AS value
       FROM ({CHANGE.format(orders="orders")}) c GROUP BY key""")
def settings_upsert(spark, sf):
    """Every order sets the setting named by its priority."""
    changes = spark.sql(CHANGE, orders=sample(spark, sf, "orders"))
    return mu.settings_upsert(settings(spark), changes)


@query("orphan_images", f"""WITH urls AS ({IMAGES_SQL}),
       dropped AS (SELECT u.id, url FROM urls u JOIN products_base p ON p.id = u.id
                   WHERE p.stock = 0 OR (u.id % 3 = 0 AND n = 1))
       SELECT id, url FROM dropped UNION ALL SELECT id, replace(url, '.webp', '-thumb.webp') FROM dropped""", BASE)
def orphan_images(spark, sf):
    """Sold-out pieces are removed, and every third one loses its cover."""
    before = product_images(base(spark, sf))
    kept = F.when(F.col("id") % 3 == 0, F.slice("images", 2, im.MAX_PHOTOS)).otherwise(F.col("images"))
    after = before.filter("stock > 0").withColumn("images", kept)
    return mu.orphan_images(before.select("id", "images"), after.select("id", "images"))


@query("orphan_objects", f"""WITH urls AS ({IMAGES_SQL}),
       dropped AS (SELECT u.id, n, CASE WHEN u.id % 2 = 0 THEN 'https://img.example.com/upload/v12' || url ELSE url END AS url
                   FROM urls u JOIN products_base p ON p.id = u.id WHERE p.stock = 0),
       both_sizes AS (SELECT id, url FROM dropped UNION ALL SELECT id, replace(url, '.webp', '-thumb.webp') FROM dropped)
       SELECT id, url, CASE WHEN id % 2 = 0 THEN replace(replace(url, 'https://img.example.com/upload/v12/', ''), '.webp', '')
                            ELSE 'shop/' || replace(replace(url, '/uploads/', ''), '.webp', '') END AS stored FROM both_sizes""", BASE)
def orphan_objects(spark, sf):
    """Sold-out pieces are removed; half of the photos lie in an upload service, half in a plain store."""
    hosted = F.transform("images", lambda u: F.concat(F.lit("https://img.example.com/upload/v12"), u))
    before = product_images(base(spark, sf)).withColumn("images", F.when(F.col("id") % 2 == 0, hosted).otherwise(F.col("images")))
    gone = mu.orphan_images(before.select("id", "images"), before.filter("stock > 0").select("id", "images"))
    return mu.orphan_objects(gone, "shop").select("id", "url", "stored")


# ---- tables written and read back with their declared schema

def _read_back(fmt: str):
    def job(spark: SparkSession, sf: str) -> DataFrame:
        path = fresh_dir(spark, f"products-{fmt}")
        write_table(conform(product_images(bind(spark, sf, "products")), "products"), path, fmt)
        back = read_table(spark, "products", path, fmt)
        return back.filter("price >= 2000").select(
            "id", "title", "price", "active", F.size("images").cast("bigint").alias("n_images"), stamp("created_at").alias("created_at")
        )

    return job


for _fmt in ("parquet", "json", "csv"):
    query(f"read_{_fmt}", f"""SELECT CAST(id AS INT) AS id, title, price, active, CAST(id % 4 AS BIGINT) AS n_images,
          {stamp_sql("created_at")} AS created_at FROM products WHERE price >= 2000""", ("products",))(_read_back(_fmt))
