"""Review queries and the dashboard."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from stallwise.operators import catalog as cat, reviews as rv
from stallwise.plans.registry import query, stamp, stamp_sql, with_position
from stallwise.sources.bindings import bind

REVIEWS = ("reviews",)
BOTH = ("products", "reviews")


def reviews(spark: SparkSession, sf: str) -> DataFrame:
    return bind(spark, sf, "reviews")


@query("rating_rollup", """SELECT product_id, CAST(sum(rating) AS BIGINT) AS rating_sum, count(*) AS rating_count
       FROM reviews WHERE approved GROUP BY product_id""", REVIEWS)
def rating_rollup(spark, sf):
    return rv.rating_rollup(reviews(spark, sf))


@query("review_queue", f"""SELECT position, id, product_id, name, rating, approved, {stamp_sql("created_at")} AS created_at, title, slug
       FROM (SELECT r.*, p.title, p.slug, row_number() OVER (ORDER BY approved, r.created_at DESC, r.id DESC) AS position
             FROM reviews r JOIN products_base p ON p.id = r.product_id WHERE p.stock > 0) q WHERE position <= 200""",
       ("products_base", "reviews"))
def review_queue(spark, sf):
    """Sold-out pieces have been deleted; reviews of theirs that were left behind do not show."""
    top = rv.review_queue(reviews(spark, sf), bind(spark, sf, "products_base").filter("stock > 0"))
    order = [F.col("approved").asc(), F.col("created_at").desc(), F.col("id").desc()]
    return with_position(top, order).select("position", "id", "product_id", "name", "rating", "approved",
                                            stamp("created_at").alias("created_at"), "title", "slug")


# Reviews whose id begins with a digit are approved, those beginning with a letter deleted.
def _chosen(r: DataFrame, pattern: str) -> DataFrame:
    return r.filter(F.col("id").rlike(pattern)).select("id")


@query("approve_reviews", """SELECT p.id, CAST(p.rating_sum + coalesce(sum(r.rating), 0) AS BIGINT) AS rating_sum,
              p.rating_count + count(r.id) AS rating_count
       FROM products p LEFT JOIN reviews r ON r.product_id = p.id AND NOT r.approved AND regexp_matches(r.id, '^[0-9]')
       GROUP BY p.id, p.rating_sum, p.rating_count""", BOTH)
def approve_reviews(spark, sf):
    r = reviews(spark, sf)
    products, _ = rv.approve_reviews(bind(spark, sf, "products"), r, _chosen(r, "^[0-9]"))
    return products.select("id", "rating_sum", "rating_count")


@query("approved_reviews", """SELECT id, approved OR regexp_matches(id, '^[0-9]') AS approved FROM reviews""", REVIEWS)
def approved_reviews(spark, sf):
    r = reviews(spark, sf)
    _, moderated = rv.approve_reviews(bind(spark, sf, "products"), r, _chosen(r, "^[0-9]"))
    return moderated.select("id", "approved")


@query("delete_reviews", """SELECT p.id, CAST(coalesce(sum(r.rating), 0) AS BIGINT) AS rating_sum, count(r.id) AS rating_count
       FROM products_base p LEFT JOIN reviews r ON r.product_id = p.id AND r.approved AND NOT regexp_matches(r.id, '^[a-f]')
       GROUP BY p.id""", ("products_base", "reviews"))
def delete_reviews(spark, sf):
    r = reviews(spark, sf)
    products, _ = rv.delete_reviews(bind(spark, sf, "products"), r, _chosen(r, "^[a-f]"))
    return products.select("id", "rating_sum", "rating_count")


@query("kept_reviews", "SELECT id, product_id, rating FROM reviews WHERE NOT regexp_matches(id, '^[a-f]')", REVIEWS)
def kept_reviews(spark, sf):
    r = reviews(spark, sf)
    _, kept = rv.delete_reviews(bind(spark, sf, "products"), r, _chosen(r, "^[a-f]"))
    return kept.select("id", "product_id", "rating")


SUBMITTED_SQL = """SELECT r.id AS ticket, CASE WHEN r.id LIKE '0%' THEN 'gone' ELSE p.slug END AS slug,
    CASE WHEN r.id LIKE '1%' THEN '  ' ELSE ' ' || r.name || ' ' END AS name,
    CASE WHEN r.id LIKE '2%' THEN '7' WHEN r.id LIKE '3%' THEN 'five' ELSE CAST(r.rating AS STRING) || ' stars' END AS rating,
    r.body FROM {reviews} r JOIN {products_base} p ON p.id = r.product_id"""


@query("hold_reviews", f"""
       SELECT s.ticket, coalesce(p.id, 0) AS product_id, trim(s.name) AS name, coalesce(TRY_CAST(left(s.rating, 1) AS BIGINT), 0) AS rating, s.body,
              false AS approved,
              CASE WHEN p.id IS NULL THEN 'That piece is no longer listed.' WHEN trim(s.name) = '' THEN 'Add your name.'
                   WHEN s.rating = '7' OR s.rating = 'five' THEN 'Choose 1 to 5 stars.' END AS reason
       FROM ({SUBMITTED_SQL.format(reviews="reviews", products_base="products_base")}) s
       LEFT JOIN (SELECT id, slug FROM products_base WHERE active) p ON p.slug = s.slug""", ("products_base", "reviews"))
def hold_reviews(spark, sf):
    products = bind(spark, sf, "products_base")
    submitted = spark.sql(SUBMITTED_SQL, reviews=reviews(spark, sf), products_base=products)
    return rv.hold_reviews(submitted, products).select(
        "ticket", F.coalesce("product_id", F.lit(0)).alias("product_id"), "name", "rating", "body", "approved", "reason"
    )


@query("shop_stats", """SELECT count(*) AS products, count(*) FILTER (active) AS live,
              count(*) FILTER (active AND stock <= 0) AS out_of_stock,
              (SELECT count(*) FROM order_requests WHERE status = 'new') AS new_orders,
              (SELECT count(*) FROM reviews WHERE NOT approved) AS pending_reviews FROM products_base""",
       ("products_base", "reviews", "order_requests"))
def shop_stats(spark, sf):
    return cat.shop_stats(bind(spark, sf, "products_base"), bind(spark, sf, "order_requests"), reviews(spark, sf))
