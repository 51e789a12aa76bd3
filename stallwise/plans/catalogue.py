"""Catalogue queries: listings, sorts, facets, detail, scalar product rules."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from stallwise.functions import images as im, pricing as pr, text as tx
from stallwise.operators import catalog as cat, search
from stallwise.plans.registry import query, stamp, stamp_sql, with_position
from stallwise.schemas import ADMIN_PAGE_SIZE
from stallwise.session import fresh_dir
from stallwise.sources.bindings import AS_OF, STORE_DISCOUNT, bind, product_images, settings

BASE = ("products_base",)
FULL = ("products",)


def price_sql(src: str, store: int = STORE_DISCOUNT) -> str:
    """Check of the price rules over a table with price, discount_type, discount_value."""
    return f"""
    SELECT *, CASE WHEN list_price > 0 AND final_price < list_price
                   THEN CAST(floor((1 - CAST(final_price AS DOUBLE) / list_price) * 100e0 + 0.5e0) AS BIGINT)
                   ELSE 0 END AS discount_percent,
           CASE WHEN discount_value > 0 AND discount_type IN ('percent', 'amount') THEN 'product'
                WHEN {store} > 0 THEN 'store' ELSE 'none' END AS discount_source
    FROM (SELECT *, CAST(least(list_price, greatest(0, CASE
              WHEN discount_type = 'percent' AND discount_value > 0
              THEN floor(list_price * (1 - least(90, discount_value) / 100e0) + 0.5e0)
              WHEN discount_type = 'amount' AND discount_value > 0
              THEN greatest(floor(list_price * (1 - 90 / 100e0) + 0.5e0), list_price - discount_value)
              WHEN {store} > 0 THEN floor(list_price * (1 - least(90, {store}) / 100e0) + 0.5e0)
              ELSE list_price END)) AS BIGINT) AS final_price
          FROM (SELECT *, CAST(greatest(0, price) AS BIGINT) AS list_price FROM {src}) listed) reduced"""


# Weights of the recommended order.
RANK_SQL = f"""round(boost * 100e0 + 15e0 * ln(1 + order_count) + 1.5e0 * ln(1 + views)
    + 8e0 * ((rating_sum + 20e0) / (rating_count + 5e0))
    + 30e0 * greatest(0e0, 1e0 - (epoch_us(TIMESTAMP '{AS_OF}') - epoch_us(created_at)) / 864e8 / 45e0)
    - CASE WHEN stock <= 0 THEN 250e0 ELSE 0e0 END, 6)"""
AVG_SQL = "round(CAST(rating_sum AS DOUBLE) / greatest(rating_count, 1), 1)"
SCORED_SQL = f"SELECT *, {RANK_SQL} AS rank_score, {AVG_SQL} AS avg_rating FROM products"
SEARCH_SQL = "({})".format(
    " OR ".join(f"{c} ILIKE '%{{0}}%'" for c in ("title", "fabric", "colour", "work", "sku", "description"))
)


def base(spark: SparkSession, sf: str) -> DataFrame:
    return bind(spark, sf, "products_base")


def full(spark: SparkSession, sf: str) -> DataFrame:
    return bind(spark, sf, "products")


# ---- filters

@query("filter_active", "SELECT id, sku, title FROM products_base WHERE active", BASE)
def filter_active(spark, sf):
    return cat.listing_filter(base(spark, sf)).select("id", "sku", "title")


@query("filter_collection",
       "SELECT id, sku, price FROM products_base WHERE active AND collection = 'bridal'", BASE)
def filter_collection(spark, sf):
    return cat.listing_filter(base(spark, sf), collection="bridal").select("id", "sku", "price")


@query("search_text", "SELECT id, title, fabric FROM products_base WHERE active AND "
       + SEARCH_SQL.format("rAnD#1_"), BASE)
def search_text(spark, sf):
    return cat.listing_filter(base(spark, sf), q="rAnD#1_").select("id", "title", "fabric")


def indexed(spark: SparkSession, sf: str) -> str:
    """The folder of a search index over the catalogue."""
    path = fresh_dir(spark, "search")
    search.write_index(base(spark, sf), path, shelf=search.BLOCK)
    return path


@query("search_indexed", "SELECT id, title, fabric FROM products_base WHERE " + SEARCH_SQL.format("rAnD#1_"), BASE)
def search_indexed(spark, sf):
    return search.search(spark, indexed(spark, sf), "rAnD#1_").select("id", "title", "fabric")


@query("search_many", """WITH patterns AS (SELECT DISTINCT upper(fabric) AS pattern FROM products_base WHERE fabric <> ''
           UNION SELECT DISTINCT left(title, 3) || '%' || right(title, 4) FROM products_base
           UNION SELECT sku FROM products_base WHERE id % 50 = 0)
       SELECT pattern, id FROM patterns JOIN products_base ON {}""".format(
           " OR ".join(f"{c} ILIKE '%' || pattern || '%'" for c in ("title", "fabric", "colour", "work", "sku", "description"))), BASE)
def search_many(spark, sf):
    """Every fabric, the ends of every title, and the numbers of some pieces."""
    b = base(spark, sf)
    ends = F.concat(F.left("title", F.lit(3)), F.lit("%"), F.right("title", F.lit(4)))
    patterns = b.filter("fabric <> ''").select(F.upper("fabric").alias("pattern"))
    patterns = patterns.union(b.select(ends)).union(b.filter("id % 50 = 0").select("sku"))
    return search.search_all(spark, indexed(spark, sf), patterns)


@query("search_postings", """WITH texts AS (SELECT id, lower(unnest([title, fabric, colour, work, sku, description])) AS t FROM products_base)
       SELECT gram, count(DISTINCT id) AS pieces FROM (SELECT id, unnest([substr(t, i, 3) for i in range(1, len(t) - 1)]) AS gram
       FROM texts WHERE len(t) >= 3) g GROUP BY gram""", BASE)
def search_postings(spark, sf):
    """How many pieces hold each trigram."""
    return search.postings(base(spark, sf)).groupBy("gram").agg(F.sum(F.size("ids")).alias("pieces"))


@query("filter_price_range",
       "SELECT id, price FROM products_base WHERE active AND price >= 5000 AND price <= 20000", BASE)
def filter_price_range(spark, sf):
    return cat.listing_filter(base(spark, sf), min_price=5000, max_price=20000).select("id", "price")


@query("filter_in_stock", "SELECT id, stock FROM products_base WHERE active AND stock > 0", BASE)
def filter_in_stock(spark, sf):
    return cat.listing_filter(base(spark, sf), in_stock=True).select("id", "stock")


FILTERS = {"q": "ring", "collection": "festive", "min_price": 3000, "max_price": 40000, "in_stock": True}
FILTERS_SQL = ("active AND collection = 'festive' AND price >= 3000 AND price <= 40000 AND stock > 0 AND "
               + SEARCH_SQL.format("ring"))


@query("listing_filtered", f"SELECT id, title, price, stock FROM products_base WHERE {FILTERS_SQL}", BASE)
def listing_filtered(spark, sf):
    return cat.listing_filter(base(spark, sf), **FILTERS).select("id", "title", "price", "stock")


@query("listing_total", f"SELECT count(*) AS total FROM products_base WHERE {FILTERS_SQL}", BASE)
def listing_total(spark, sf):
    return cat.listing_total(base(spark, sf), **FILTERS)


@query("ids_semi", """SELECT id, sku, price, stock FROM products_base
       WHERE active AND id IN (SELECT product_id FROM cart_lines)""", ("products_base", "cart_lines"))
def ids_semi(spark, sf):
    wanted = bind(spark, sf, "cart_lines").select(F.col("product_id").alias("id"))
    return cat.with_ids(base(spark, sf).filter("active"), wanted).select("id", "sku", "price", "stock")


@query("product_by_slug", f"""SELECT id, slug, title, price, {AVG_SQL} AS avg_rating FROM products
       WHERE active AND slug = 'red-widget-2'""", FULL)
def product_by_slug(spark, sf):
    found = cat.by_slug(full(spark, sf), "red-widget-2")
    return found.select(
        "id", "slug", "title", "price", pr.avg_rating(F.col("rating_sum"), F.col("rating_count")).alias("avg_rating")
    )


# ---- sorted listings; the admin list shows 200 rows and inactive pieces too

SORT_SQL = {
    "recommended": "rank_score DESC, id DESC",
    "newest": "created_at DESC, id DESC",
    "price_asc": "price ASC, id DESC",
    "price_desc": "price DESC, id DESC",
    "rating": "CAST(rating_sum AS DOUBLE) / greatest(rating_count, 1) DESC, rating_count DESC, id DESC",
    "popular": "order_count DESC, views DESC, id DESC",
}


def _sorted(sort: str):
    def job(spark: SparkSession, sf: str) -> DataFrame:
        top = cat.list_products(
            full(spark, sf), AS_OF, sort=sort, limit=ADMIN_PAGE_SIZE, max_limit=ADMIN_PAGE_SIZE, include_inactive=True
        )
        return with_position(top, cat.sort_keys(sort)).select(
            "position", "id", "price", "order_count", "views", "rating_count", "rank_score", "avg_rating"
        )

    return job


for _name, _order in SORT_SQL.items():
    query(f"sort_{_name}", f"""
        SELECT position, id, price, order_count, views, rating_count, rank_score, avg_rating
        FROM (SELECT *, row_number() OVER (ORDER BY {_order}) AS position FROM ({SCORED_SQL}) s) o
        WHERE position <= {ADMIN_PAGE_SIZE}""", FULL)(_sorted(_name))

PAGE = {"q": "ring", "min_price": 3000, "in_stock": True}


@query("listing_page", f"""
       SELECT position, id, slug, title, price, list_price, final_price, discount_percent, discount_source,
              rank_score, avg_rating
       FROM ({price_sql(f'''(SELECT *, row_number() OVER (ORDER BY rank_score DESC, id DESC) AS position
             FROM ({SCORED_SQL}) s WHERE active AND price >= 3000 AND stock > 0 AND {SEARCH_SQL.format("ring")}) f''')}) p
       WHERE position BETWEEN 13 AND 24""", FULL)
def listing_page(spark, sf):
    """The shop's headline query: second page of a filtered, searched, ranked, priced listing."""
    top = cat.priced_listing(full(spark, sf), settings(spark), AS_OF, page_number=2, **PAGE)
    numbered = with_position(top, cat.sort_keys())
    return numbered.select(
        (F.col("position") + 12).alias("position"), "id", "slug", "title", "price", "list_price", "final_price",
        "discount_percent", "discount_source", "rank_score", "avg_rating",
    )


@query("priced_listing", f"""
       SELECT id, list_price, final_price, discount_percent, discount_source FROM ({price_sql("products_base")}) p""",
       BASE)
def priced_listing(spark, sf):
    priced = pr.with_pricing(base(spark, sf), cat.store_discount(settings(spark)))
    return priced.select("id", "list_price", "final_price", "discount_percent", "discount_source")


@query("price_of", f"""
       SELECT id, list_price, final_price, discount_percent, discount_source
       FROM ({price_sql("products_base", 0)}) p""", BASE)
def price_of(spark, sf):
    return pr.with_pricing(base(spark, sf)).select(
        "id", "list_price", "final_price", "discount_percent", "discount_source"
    )


@query("sort_unknown", f"""SELECT position, id, rank_score
       FROM (SELECT *, row_number() OVER (ORDER BY rank_score DESC, id DESC) AS position FROM ({SCORED_SQL}) s) o
       WHERE position <= {ADMIN_PAGE_SIZE}""", FULL)
def sort_unknown(spark, sf):
    """An unknown order is the recommended one."""
    top = cat.list_products(
        full(spark, sf), AS_OF, sort="dearest", limit=ADMIN_PAGE_SIZE, max_limit=ADMIN_PAGE_SIZE, include_inactive=True
    )
    return with_position(top, cat.sort_keys("dearest")).select("position", "id", "rank_score")


@query("appended_pages", f"""SELECT id, title, price FROM (SELECT *, row_number() OVER (ORDER BY rank_score DESC, id DESC) AS position
       FROM ({SCORED_SQL}) s WHERE active) o WHERE position <= 24""", FULL)
def appended_pages(spark, sf):
    """The second page is appended to the first."""
    first, second = (cat.list_products(full(spark, sf), AS_OF, page_number=n) for n in (1, 2))
    return cat.append_page(first, second).select("id", "title", "price")


@query("page_after", """SELECT id, price FROM (SELECT id, price, row_number() OVER (ORDER BY price, id DESC) AS position
       FROM products_base WHERE active) o WHERE position BETWEEN 1001 AND 1012""", BASE)
def page_after(spark, sf):
    """The page after the thousandth piece by price, found by that piece's price and id."""
    order = [("price", False), ("id", True)]
    rows = cat.listing_filter(base(spark, sf))
    last = rows.orderBy("price", F.desc("id")).offset(999).limit(1).select("price", "id").first()
    return cat.page_after(rows, order, last.asDict()).select("id", "price") if last else rows.select("id", "price").limit(0)


# ---- facets

@query("facet_collections",
       "SELECT collection, count(*) AS n FROM products_base WHERE active GROUP BY collection", BASE)
def facet_collections(spark, sf):
    return cat.facet_counts(base(spark, sf), "collection")


@query("facet_fabrics", """SELECT fabric, count(*) AS n FROM products_base WHERE active AND fabric <> ''
       GROUP BY fabric ORDER BY n DESC, fabric LIMIT 12""", BASE)
def facet_fabrics(spark, sf):
    return cat.facet_counts(base(spark, sf), "fabric", top=12)


@query("facet_price",
       "SELECT min(price) AS min_price, max(price) AS max_price FROM products_base WHERE active", BASE)
def facet_price(spark, sf):
    return cat.price_range(base(spark, sf))


LABEL_SQL = """CASE {0} WHEN 'bridal' THEN 'Bridal specials' WHEN 'party' THEN 'Party wear'
    WHEN 'festive' THEN 'Festive collection' WHEN 'designer' THEN 'Designer wear'
    WHEN 'blouse' THEN 'Embroidery blouses' ELSE {0} END"""


@query("facet_rollup", f"""
       SELECT '' AS collection, count(*) AS n, 'Everything' AS label FROM products_base WHERE active
       UNION ALL SELECT collection, count(*), {LABEL_SQL.format("collection")} FROM products_base
       WHERE active GROUP BY collection""", BASE)
def facet_rollup(spark, sf):
    return cat.labelled_facets(base(spark, sf))


@query("collection_label", f"""
       SELECT id, {LABEL_SQL.format("code")} AS label
       FROM (SELECT id, CASE WHEN id % 8 = 0 THEN colour ELSE collection END AS code FROM products_base) p""", BASE)
def collection_label(spark, sf):
    code = F.when(F.col("id") % 8 == 0, F.col("colour")).otherwise(F.col("collection"))
    return base(spark, sf).select("id", tx.collection_label(code).alias("label"))


# ---- scores

@query("rank_score", f"SELECT id, {RANK_SQL} AS rank_score FROM products", FULL)
def rank_score(spark, sf):
    return full(spark, sf).select("id", pr.rank_score(AS_OF).alias("rank_score"))


@query("bayes_rating",
       "SELECT id, round((rating_sum + 20e0) / (rating_count + 5e0), 6) AS rating FROM products", FULL)
def bayes_rating(spark, sf):
    rating = pr.bayes_rating(F.col("rating_sum"), F.col("rating_count"))
    return full(spark, sf).select("id", F.round(rating, 6).alias("rating"))


@query("freshness", f"""
       SELECT id, round(30e0 * greatest(0e0, 1e0 - (epoch_us(TIMESTAMP '2024-01-10 08:30:00')
                                                   - epoch_us(created_at)) / 864e8 / 45e0), 6) AS fresh
       FROM products_base""", BASE)
def freshness(spark, sf):
    fresh = pr.freshness(F.col("created_at"), "2024-01-10 08:30:00")
    return base(spark, sf).select("id", F.round(fresh, 6).alias("fresh"))


@query("avg_rating", f"SELECT id, rating_count, {AVG_SQL} AS avg_rating FROM products", FULL)
def avg_rating(spark, sf):
    mean = pr.avg_rating(F.col("rating_sum"), F.col("rating_count"))
    return full(spark, sf).select("id", "rating_count", mean.alias("avg_rating"))


@query("tile_flag", f"""
       SELECT id, CASE WHEN stock <= 0 THEN 'Sold — ask us'
                       WHEN discount_percent > 0 THEN CAST(discount_percent AS VARCHAR) || '% off'
                       WHEN boost > 0 THEN 'Featured' ELSE '' END AS flag
       FROM ({price_sql("products_base", 0)}) p""", BASE)
def tile_flag(spark, sf):
    flag = pr.tile_flag(F.col("stock"), F.col("discount_percent"), F.col("boost"))
    return pr.with_pricing(base(spark, sf)).select("id", flag.alias("flag"))


# ---- detail

REVIEW_RANK_SQL = """SELECT *, row_number() OVER (PARTITION BY product_id ORDER BY created_at DESC, id DESC) AS position
    FROM reviews WHERE approved"""


def _top_reviews(n: int):
    def job(spark: SparkSession, sf: str) -> DataFrame:
        top = cat.top_reviews(bind(spark, sf, "reviews"), n)
        return top.select("product_id", F.col("position").cast("bigint").alias("position"), "name", "rating",
                          stamp("created_at").alias("created_at"))

    return job


for _name, _n in (("top_reviews", 30), ("top_reviews_5", 5)):
    query(_name, f"""
        SELECT product_id, position, name, rating, {stamp_sql("created_at")} AS created_at
        FROM ({REVIEW_RANK_SQL}) r WHERE position <= {_n}""", ("reviews",))(_top_reviews(_n))


@query("product_detail", f"""
       SELECT p.id, p.title, p.avg_rating, coalesce(r.position - 1, -1) AS nth, r.name,
              coalesce(r.rating, 0) AS rating, {stamp_sql("r.created_at")} AS reviewed
       FROM (SELECT *, {AVG_SQL} AS avg_rating FROM products WHERE active) p
       LEFT JOIN ({REVIEW_RANK_SQL}) r ON r.product_id = p.id AND r.position <= 30""", ("products", "reviews"))
def product_detail(spark, sf):
    detail = cat.product_detail(full(spark, sf).filter("active"), bind(spark, sf, "reviews"))
    rows = detail.select("id", "title", "avg_rating", F.posexplode_outer("reviews").alias("nth", "r"))
    return rows.select(
        "id", "title", "avg_rating", F.coalesce(F.col("nth").cast("bigint"), F.lit(-1)).alias("nth"), "r.name",
        F.coalesce("r.rating", F.lit(0)).alias("rating"), stamp("r.created_at").alias("reviewed"),
    )


@query("top_viewed", """SELECT id, title, slug, views, order_count FROM products WHERE views > 0
       ORDER BY views DESC, id DESC LIMIT 10""", FULL)
def top_viewed(spark, sf):
    return cat.top_viewed(full(spark, sf))


# ---- photos

IMAGES_SQL = """SELECT p.id, n, '/uploads/' || CAST(p.id AS VARCHAR) || '-' || CAST(n AS VARCHAR) || '.webp' AS url
    FROM products_base p, (VALUES (1), (2), (3)) k(n) WHERE n <= p.id % 4"""


@query("image_fields", f"""
       SELECT p.id, max(CASE WHEN n = 1 THEN url END) AS cover, max(CASE WHEN n = 2 THEN url END) AS alternate,
              CAST(count(url) AS INT) AS n_images
       FROM products_base p LEFT JOIN ({IMAGES_SQL}) i ON i.id = p.id GROUP BY p.id""", BASE)
def image_fields(spark, sf):
    return product_images(base(spark, sf)).withColumns(im.image_fields(F.col("images"))).select(
        "id", "cover", "alternate", "n_images"
    )


MANY_SQL = """SELECT p.id, n, '/uploads/' || CAST(p.id AS VARCHAR) || '-' || CAST(n AS VARCHAR) || '.webp' AS url
    FROM products_base p, (SELECT unnest(range(1, 13)) AS n) k WHERE n <= p.id % 12"""


@query("first_photos", f"""SELECT p.id, CAST(least(8, p.id % 12) AS INT) AS n_images, max(CASE WHEN n = 8 THEN url END) AS eighth
       FROM products_base p LEFT JOIN ({MANY_SQL}) i ON i.id = p.id GROUP BY p.id""", BASE)
def first_photos(spark, sf):
    """Up to eleven photos are sent, eight are kept."""
    numbers = F.when(F.col("id") % 12 > 0, F.sequence(F.lit(1), (F.col("id") % 12).cast("int")))
    urls = F.transform(numbers, lambda n: F.concat(F.lit("/uploads/"), F.col("id"), F.lit("-"), n, F.lit(".webp")))
    kept = base(spark, sf).select("id", im.first_photos(urls).alias("images"))
    return kept.select("id", F.size("images").alias("n_images"), F.get("images", F.lit(7)).alias("eighth"))


@query("thumb_url", f"SELECT id, replace(url, '.webp', '-thumb.webp') AS thumb FROM ({IMAGES_SQL}) i", BASE)
def thumb_url(spark, sf):
    urls = product_images(base(spark, sf)).select("id", F.explode("images").alias("url"))
    return urls.select("id", im.thumb_url(F.col("url")).alias("thumb"))
