"""Scalar rules at their edges; expected values worked out by hand."""

from __future__ import annotations

import re
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from stallwise.functions import images as im, pricing as pr, text as tx, visits as vi


def values(spark, rows, schema, column):
    df = spark.createDataFrame(list(enumerate(rows)) if not isinstance(rows[0], tuple) else
                               [(i, *r) for i, r in enumerate(rows)], f"n int, {schema}")
    return [r[0] for r in df.orderBy("n").select(column).collect()]


PRICES = [
    # price, type, value, store -> list, final, percent, source
    ((0, "percent", 50, 25), (0, 0, 0, "product")),
    ((1, "percent", 50, 0), (1, 1, 0, "product")),
    ((5, "percent", 99, 0), (5, 0, 100, "product")),   # 5 * (1 - 0.9) is just below a half
    ((1000, "percent", 99, 0), (1000, 100, 90, "product")),
    ((1000, "percent", 0, 25), (1000, 750, 25, "store")),
    ((1000, "amount", 999, 0), (1000, 100, 90, "product")),
    ((1000, "amount", 1000, 0), (1000, 100, 90, "product")),
    ((1000, "amount", 2000, 0), (1000, 100, 90, "product")),
    ((1000, "amount", 250, 50), (1000, 750, 25, "product")),
    ((1000, "none", 250, 99), (1000, 100, 90, "store")),
    ((1000, "none", 0, 0), (1000, 1000, 0, "none")),
    ((1000, "none", 0, -5), (1000, 1000, 0, "none")),
    ((-7, "none", 0, 0), (0, 0, 0, "none")),
    ((None, None, None, 0), (0, 0, 0, "none")),
    ((999, "percent", -3, 10), (999, 899, 10, "store")),
]


def test_price_of(spark):
    df = spark.createDataFrame([(i, *a) for i, (a, _) in enumerate(PRICES)],
                               "n int, price int, discount_type string, discount_value int, store int")
    got = pr.with_pricing(df, F.col("store")).orderBy("n").collect()
    for row, (_, want) in zip(got, PRICES):
        assert (row.list_price, row.final_price, row.discount_percent, row.discount_source) == want


def test_rank_score(spark):
    as_of = datetime(2024, 1, 31)
    rows = [
        (0, 1, 0, 0, 0, 0, datetime(2024, 1, 31)),      # brand new: 32 + 30
        (0, 0, 0, 0, 0, 0, datetime(2024, 1, 31)),      # sold out
        (2, 1, 0, 0, 0, 0, datetime(2023, 12, 17)),     # exactly 45 days
        (0, 1, 0, 0, 0, 0, datetime(2023, 12, 16)),     # 46 days
        (0, 1, 0, 0, 10, 2, datetime(2023, 1, 1)),      # 8 * 30 / 7
        (0, 1, 0, 0, 0, 0, datetime(2024, 3, 16)),      # created 45 days after as_of: 60 points
    ]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)],
                               "n int, boost int, stock int, order_count int, views int, rating_sum int, "
                               "rating_count int, created_at timestamp")
    got = [r[0] for r in df.orderBy("n").select(pr.rank_score(as_of)).collect()]
    assert got == pytest.approx([62.0, -188.0, 232.0, 32.0, 34.285714, 92.0], abs=1e-6)


def test_parse_int(spark):
    texts = ["12abc", " 7", "3.9", "x", "-4", "", None, "+5", "0", " 8", "99999999999999999999"]
    assert values(spark, texts, "v string", tx.parse_int(F.col("v"))) == [12, 7, 3, 0, -4, 0, 0, 5, 0, 8, 0]
    assert values(spark, texts[:9], "v string", tx.parse_int(F.col("v"), 1)) == [12, 7, 3, 1, -4, 1, 1, 5, 1]
    assert values(spark, ["99999999999", "-99999999999"], "v string", tx.parse_int32(F.col("v"))) == [
        2**31 - 1, -(2**31)]


def test_slugify(spark):
    texts = ["  Red   Bolt ", "Wine & gold, 5 metres!", "☆☆", "", None, "a" * 80, "A--B - C", "Crème brûlée", "-x-"]
    assert values(spark, texts, "v string", tx.slugify(F.col("v"))) == [
        "red-bolt", "wine-gold-5-metres", "piece", "piece", "piece", "a" * 70, "a-b-c", "crme-brle", "-x-"]


def test_clean_text(spark):
    texts = ["   ab cd\t", None, "ß"]
    assert values(spark, texts, "v string", tx.clean_text(F.col("v"), 3, upper=True)) == ["AB ", "", "SS"]


def test_numbers_and_phones(spark):
    assert values(spark, [0, 999, 1000, 28500, 1234567, 123456789], "v bigint", tx.rupees(F.col("v"))) == [
        "₹0", "₹999", "₹1,000", "₹28,500", "₹12,34,567", "₹12,34,56,789"]
    phones = ["+91 98073-38745", "919807338745", "12345", "9198073387451"]
    assert values(spark, phones, "v string", tx.phone_display(F.col("v"))) == [
        "+91 98073 38745", "+91 98073 38745", "+12345", "+9198073387451"]


def test_encode_component(spark):
    text = ["a b+c(d)!'*~é\n₹/&"]
    assert values(spark, text, "v string", tx.encode_component(F.col("v"))) == [
        "a%20b%2Bc(d)!'*~%C3%A9%0A%E2%82%B9%2F%26"]


def test_truthy(spark):
    assert values(spark, ["false", "", None, "0"], "v string", tx.truthy(F.col("v"))) == [True, False, False, True]
    assert values(spark, [True, False, None], "v boolean", tx.truthy(F.col("v"), "boolean")) == [True, False, False]
    assert values(spark, [2, 0, None], "v int", tx.truthy(F.col("v"), "int")) == [True, False, False]


REFERRERS = [
    (None, "direct"), ("", "direct"), ("not a url", "direct"), ("/relative", "direct"),
    ("https://L.Instagram.COM/x", "Instagram"), ("https://web.whatsapp.com:443/", "WhatsApp"),
    ("http://user:pw@fb.me/x", "Facebook"), ("https://www.google.co.in/search?q=a", "Google"),
    ("android-app://com.google.android.gm", "Google"), ("https://shop.example.com/a", "direct"),
    ("https://www.shop.example.com", "direct"), ("https://x.onrender.com/", "direct"),
    ("https://www.News.example.org/a", "news.example.org"), ("https://my_host.example/x", "my_host.example"),
    ("https://" + "h" * 70 + ".org/", "h" * 60), ("https://exa mple.org/", "direct"), ("https://a.org:port/", "direct"),
    ("https:///", "direct"), ("about:blank", ""), ("https://[::1]:8080/x", "[::1]"),
    ("https://evil.org/?u=google.com", "evil.org"), ("http:\\\\slashes.example\\x", "slashes.example"),
]


def test_referrer_channel(spark):
    got = values(spark, [r for r, _ in REFERRERS], "v string", vi.referrer_channel(F.col("v"), "shop.example.com"))
    assert got == [want for _, want in REFERRERS]


def test_pages(spark):
    paths = ["/", "/piece/red-bolt", "/piece/", "/piece/a/b", "/admin", "/api/products", "/styles.css", "/piece"]
    assert values(spark, paths, "v string", vi.page_kind(F.col("v"))) == [
        "shop", "product", None, None, None, None, None, None]


def test_images(spark):
    df = spark.createDataFrame([(1, ["a.webp", "b.webp"]), (2, []), (3, None)], "id int, images array<string>")
    got = df.withColumns(im.image_fields(F.col("images"))).orderBy("id").select("cover", "alternate", "n_images").collect()
    assert [tuple(r) for r in got] == [("a.webp", "b.webp", 2), (None, None, 0), (None, None, 0)]
    many = spark.createDataFrame([([str(i) for i in range(12)],)], "images array<string>")
    assert many.select(F.size(im.first_photos(F.col("images")))).first()[0] == 8
    urls = ["https://host/x/upload/v12/shop/a-b.webp", "https://host/x/upload/shop/c.JPG", "https://host/plain.webp"]
    assert values(spark, urls, "v string", im.public_id(F.col("v"))) == ["shop/a-b", "shop/c", None]
    assert values(spark, urls, "v string", im.object_key(F.col("v"))) == ["a-b.webp", "c.JPG", "plain.webp"]
    assert values(spark, ["k-1.webp"], "v string", im.key_public_id(F.col("v"), "shop")) == ["shop/k-1"]


def test_slug_of_a_long_text(spark):
    """The beginning settles the slug only if it has a letter more."""
    def plain(t):
        kept = re.sub(r"[^a-z0-9\s-]", "", t.lower().strip("\t\n\x0b\x0c\r  ﻿"))
        return re.sub(r"[\s-]+", "-", kept)[:70] or "piece"

    head = tx.SLUG_HEAD
    texts = [
        "a" * 69 + " ", "a" * 70, "a" * 71, "a" * 69 + " " * 500 + "b", "a" * 70 + " " * 500, "a" * 69 + " !" * 300, " " * (head + 5) + "late start",
        "é" * head + " after all", "é " * head + "end", "a" * 40 + "é" * head + "b" * 40, "\U0001f600" * head + "x" * 90, "-" * head + "tail", "ab " * 400, "!" * 1000,
    ]
    slugs = tx.slugify(F.col("v"))
    assert values(spark, texts, "v string", slugs) == [plain(t) for t in texts]
    assert f", 1, {head})" in slugs._jc.toString()
