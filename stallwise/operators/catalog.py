"""Catalogue listings: filters, search, sorts, pages, facets, product detail."""

from __future__ import annotations

from datetime import datetime
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from stallwise.functions.pricing import avg_rating, mean_rating, rank_score, with_pricing
from stallwise.functions.text import collection_label, parse_int
from stallwise.schemas import (
    DEFAULT_PAGE_SIZE, MAX_DISCOUNT, MAX_PAGE_SIZE, REVIEWS_SHOWN, STORE_DISCOUNT_KEY,
)

SEARCHED = ("title", "fabric", "colour", "work", "sku", "description")


def search_condition(term: str, columns: tuple[str, ...] = SEARCHED) -> Column:
    """Case-insensitive substring in any searched column; % and _ in the term are wildcards."""
    pattern = "%" + term.replace("\\", "\\\\") + "%"
    return reduce(Column.__or__, (F.col(c).ilike(pattern) for c in columns))


def listing_filter(
    products: DataFrame,
    *,
    q: str = "",
    collection: str = "",
    min_price: int = 0,
    max_price: int = 0,
    in_stock: bool = False,
    include_inactive: bool = False,
) -> DataFrame:
    """Keep the rows that meet every condition given; a condition left out adds nothing to the plan."""
    conditions = []
    if not include_inactive:
        conditions.append(F.col("active"))
    if collection:
        conditions.append(F.col("collection") == collection)
    if q:
        conditions.append(search_condition(q))
    if min_price > 0:
        conditions.append(F.col("price") >= min_price)
    if max_price > 0:
        conditions.append(F.col("price") <= max_price)
    if in_stock:
        conditions.append(F.col("stock") > 0)
    return reduce(DataFrame.filter, conditions, products)


def scored(products: DataFrame, as_of: datetime | str | Column) -> DataFrame:
    """All product columns, the recommendation score and the average rating."""
    return products.withColumns(
        {
            "rank_score": rank_score(as_of),
            "avg_rating": avg_rating(F.col("rating_sum"), F.col("rating_count")),
        }
    )


def sort_keys(sort: str = "recommended") -> list[Column]:
    """Order of a listing; an unknown name means the recommended order. Every order is total."""
    newest_id = F.col("id").desc()
    orders = {
        "recommended": [F.col("rank_score").desc()],
        "newest": [F.col("created_at").desc()],
        "price_asc": [F.col("price").asc()],
        "price_desc": [F.col("price").desc()],
        "rating": [
            mean_rating(F.col("rating_sum"), F.col("rating_count")).desc(),
            F.col("rating_count").desc(),
        ],
        "popular": [F.col("order_count").desc(), F.col("views").desc()],
    }
    return [*orders.get(sort, orders["recommended"]), newest_id]


def page(
    rows: DataFrame, keys: list[Column], number: int = 1, limit: int = DEFAULT_PAGE_SIZE,
    max_limit: int = MAX_PAGE_SIZE,
) -> DataFrame:
    """One page of sorted rows, taken as a top-k: each task passes on at most a page's worth of rows."""
    size = max(1, min(max_limit, limit or DEFAULT_PAGE_SIZE))
    return rows.orderBy(*keys).offset((max(1, number) - 1) * size).limit(size)


def page_after(rows: DataFrame, order: list[tuple[str, bool]], last: dict[str, object], limit: int = DEFAULT_PAGE_SIZE) -> DataFrame:
    """The page that follows the row ``last``, for an order of (column, descending): deep pages cost what the first one does.

    ``last`` holds that row's values of the order's columns, which are not NULL and end with a unique one.
    """
    after, same = F.lit(False), F.lit(True)
    for name, descending in order:
        value = F.lit(last[name])
        after = after | (same & (F.col(name) < value if descending else F.col(name) > value))
        same = same & (F.col(name) == value)
    keys = [F.col(name).desc() if descending else F.col(name).asc() for name, descending in order]
    return rows.filter(after).orderBy(*keys).limit(limit)


def append_page(shown: DataFrame, following: DataFrame, key: str = "id") -> DataFrame:
    """What is shown once the next page is appended; a row that moved to the next page meanwhile is shown once."""
    return shown.unionByName(following.join(shown.select(key), key, "left_anti").select(*shown.columns))


def list_products(
    products: DataFrame,
    as_of: datetime | str | Column,
    *,
    sort: str = "recommended",
    page_number: int = 1,
    limit: int = DEFAULT_PAGE_SIZE,
    max_limit: int = MAX_PAGE_SIZE,
    **filters: object,
) -> DataFrame:
    """A page of the filtered, scored, sorted catalogue."""
    rows = scored(listing_filter(products, **filters), as_of)
    return page(rows, sort_keys(sort), page_number, limit, max_limit)


def priced_listing(
    products: DataFrame, settings: DataFrame, as_of: datetime | str | Column, **options: object
) -> DataFrame:
    """A listing page with the four price columns."""
    return with_pricing(list_products(products, as_of, **options), store_discount(settings))


def listing_total(products: DataFrame, **filters: object) -> DataFrame:
    """How many rows a listing has over all its pages."""
    return listing_filter(products, **filters).agg(F.count(F.lit(1)).alias("total"))


def store_discount(settings: DataFrame) -> Column:
    """The store-wide percentage as a scalar subquery: 0 if unset, held within 0..90."""
    value = F.max(F.when(F.col("key") == STORE_DISCOUNT_KEY, F.col("value")))
    percent = F.greatest(F.lit(0), F.least(F.lit(MAX_DISCOUNT), parse_int(value)))
    return settings.agg(percent.cast("int").alias("percent")).scalar()


def with_ids(products: DataFrame, ids: DataFrame) -> DataFrame:
    """Products whose id occurs in ``ids``, which is reduced to distinct ids before it is sent around."""
    return products.join(ids.select("id").distinct(), "id", "left_semi")


def by_slug(products: DataFrame, slug: str, include_inactive: bool = False) -> DataFrame:
    found = products.filter(F.col("slug") == slug)
    return found if include_inactive else found.filter("active")


def facet_counts(
    products: DataFrame, column: str, top: int | None = None, with_total: bool = False
) -> DataFrame:
    """Live pieces per value, most first; empty and missing values of a top list are left out.

    ``with_total`` adds the grand total as the row whose value is empty.
    """
    live = products.filter("active")
    if top:
        live = live.filter(F.col(column) != "")
    if with_total:
        counted = live.rollup(column).agg(F.count(F.lit(1)).alias("n"), F.grouping(column).alias("whole"))
        counted = counted.select(F.when(F.col("whole") == 1, "").otherwise(F.col(column)).alias(column), "n")
    else:
        counted = live.groupBy(column).agg(F.count(F.lit(1)).alias("n"))
    ordered = counted.orderBy(F.col("n").desc(), F.col(column).asc())
    return ordered.limit(top) if top else ordered


def labelled_facets(products: DataFrame) -> DataFrame:
    """Collection filter of the shop front: the grand total first, each with its label."""
    facets = facet_counts(products, "collection", with_total=True)
    name = F.when(F.col("collection") == "", "Everything").otherwise(collection_label(F.col("collection")))
    return facets.withColumn("label", name)


def price_range(products: DataFrame) -> DataFrame:
    live = products.filter("active")
    return live.agg(F.min("price").alias("min_price"), F.max("price").alias("max_price"))


def top_reviews(reviews: DataFrame, n: int = REVIEWS_SHOWN) -> DataFrame:
    """The newest approved reviews of every product, ``position`` counting from the newest.

    The rank filter is applied before the shuffle as well, so a product holding a large share
    of all reviews sends at most ``n`` rows per task.
    """
    newest = Window.partitionBy("product_id").orderBy(F.col("created_at").desc(), F.col("id").desc())
    return (
        reviews.filter("approved")
        .select("product_id", "id", "name", "rating", "body", "created_at")
        .withColumn("position", F.row_number().over(newest))
        .filter(F.col("position") <= n)
    )


def product_detail(products: DataFrame, reviews: DataFrame, n: int = REVIEWS_SHOWN) -> DataFrame:
    """Every product with its newest approved reviews nested, newest first; none gives an empty list."""
    review = F.struct("position", "name", "rating", "body", "created_at")
    shown = top_reviews(reviews, n).groupBy("product_id").agg(
        F.array_sort(F.collect_list(review)).alias("reviews")
    )
    rated = products.withColumn("avg_rating", avg_rating(F.col("rating_sum"), F.col("rating_count")))
    nested = F.transform("reviews", lambda r: r.dropFields("position"))
    joined = rated.join(shown, rated["id"] == shown["product_id"], "left").drop("product_id")
    empty = F.array().cast("array<struct<name string, rating int, body string, created_at timestamp>>")
    return joined.withColumn("reviews", F.coalesce(nested, empty))


def top_viewed(products: DataFrame, n: int = 10) -> DataFrame:
    """Most viewed pieces."""
    seen = products.filter(F.col("views") > 0).select("id", "title", "slug", "views", "order_count")
    return seen.orderBy(F.col("views").desc(), F.col("id").desc()).limit(n)


def shop_stats(products: DataFrame, orders: DataFrame, reviews: DataFrame) -> DataFrame:
    """Dashboard counts, one row: each table is read once."""
    new_orders = orders.agg(F.count_if(F.col("status") == "new").alias("n")).scalar()
    held = reviews.agg(F.count_if(~F.col("approved")).alias("n")).scalar()
    return products.agg(
        F.count(F.lit(1)).alias("products"),
        F.count_if(F.col("active")).alias("live"),
        F.count_if((F.col("stock") <= 0) & F.col("active")).alias("out_of_stock"),
    ).select("*", new_orders.alias("new_orders"), held.alias("pending_reviews"))
