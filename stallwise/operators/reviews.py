"""Reviews: intake, moderation and the rating counters of products."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from stallwise.functions.text import clean_text, parse_int, text

# Reasons for which a review is refused.
NO_NAME = "Add your name."
BAD_RATING = "Choose 1 to 5 stars."
NOT_LISTED = "That piece is no longer listed."


def hold_reviews(submitted: DataFrame, products: DataFrame) -> DataFrame:
    """Check reviews (slug, name, rating, body as typed) and turn them into unapproved rows.

    ``reason`` is NULL for the rows to be appended.
    """
    live = products.filter("active").select("slug", F.col("id").alias("product_id"))
    stars = parse_int(F.col("rating"))
    name = clean_text(F.col("name"), 60)
    reason = (
        F.when(F.col("product_id").isNull(), NOT_LISTED)
        .when(F.col("name") == "", NO_NAME)
        .when(~F.col("rating").between(1, 5), BAD_RATING)
    )
    cleaned = submitted.withColumns(
        {"name": name, "rating": stars, "body": F.substring(text(F.col("body")), 1, 800), "approved": F.lit(False)}
    )
    return cleaned.join(live, "slug", "left").withColumn("reason", reason)


def rating_rollup(reviews: DataFrame) -> DataFrame:
    """Sum and number of approved ratings per product."""
    return reviews.filter("approved").groupBy("product_id").agg(
        F.sum("rating").alias("rating_sum"), F.count(F.lit(1)).alias("rating_count")
    )


def _shift_ratings(products: DataFrame, changes: DataFrame, sign: int) -> DataFrame:
    """Move the rating counters of products by the given reviews."""
    delta = changes.groupBy("product_id").agg(
        F.sum("rating").alias("stars"), F.count(F.lit(1)).alias("votes")
    )
    joined = products.join(delta, products["id"] == delta["product_id"], "left").drop("product_id")

    def moved(counter: str, change: str) -> Column:
        return F.col(counter) + F.lit(sign) * F.coalesce(F.col(change), F.lit(0))

    return joined.withColumns(
        {"rating_sum": moved("rating_sum", "stars"), "rating_count": moved("rating_count", "votes")}
    ).drop("stars", "votes")


def approve_reviews(products: DataFrame, reviews: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Approve the reviews in ``ids``; those approved before do not count twice.

    Returns the new products and the new reviews.
    """
    wanted = ids.select("id").distinct().withColumn("chosen", F.lit(True))
    marked = reviews.join(wanted, "id", "left")
    fresh = marked.filter(F.col("chosen") & ~F.col("approved"))
    approved = F.col("approved") | F.coalesce("chosen", F.lit(False))
    return _shift_ratings(products, fresh, 1), marked.withColumn("approved", approved).drop("chosen")


def delete_reviews(products: DataFrame, reviews: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Remove the reviews in ``ids``, taking approved ones out of the rating counters."""
    wanted = ids.select("id").distinct()
    gone = reviews.join(wanted, "id", "left_semi")
    kept = reviews.join(wanted, "id", "left_anti")
    return _shift_ratings(products, gone.filter("approved"), -1), kept


def review_queue(reviews: DataFrame, products: DataFrame, n: int = 200) -> DataFrame:
    """Moderation list: held reviews first, newest first, with the product's title and slug.

    Reviews whose product is gone are not shown and take up no place. The n rows are a top-k of the join.
    """
    order = [F.col("approved").asc(), F.col("created_at").desc(), F.col("id").desc()]
    titles = products.select(F.col("id").alias("product_id"), "title", "slug")
    return reviews.join(titles, "product_id").orderBy(*order).limit(n)
