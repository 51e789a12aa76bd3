"""Table jobs on small tables; expected rows worked out by hand."""

from __future__ import annotations

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from stallwise.operators import catalog as cat, edits as ed, mutations as mu, orders as od, reviews as rv, traffic as tr
from stallwise.schemas import PRODUCTS, REVIEWS

DAY0 = datetime(2024, 1, 31)
DEFAULTS = dict(
    sku="", slug="", title="t", collection="party", fabric="", colour="", work="", blouse_size="", description="",
    price=1000, mrp=0, stock=5, images=[], discount_type="none", discount_value=0, active=True, boost=0, views=0,
    order_count=0, rating_sum=0, rating_count=0, created_at=DAY0,
)


def products(spark, *rows):
    """Products from partial rows; SKU and slug follow from the id."""
    full = [{**DEFAULTS, "sku": f"S-{r['id']}", "slug": f"p-{r['id']}", **r} for r in rows]
    return spark.createDataFrame([tuple(r[c] for c in PRODUCTS.names) for r in full], PRODUCTS)


def settings(spark, value="25"):
    return spark.createDataFrame([("store_discount", value)], "key string, value string")


def rows(df, *columns, order=None):
    out = [tuple(r) for r in df.select(*columns).collect()]
    return out if order == "kept" else sorted(out, key=repr)


CATALOGUE = [
    dict(id=1, title="Wine silk", collection="bridal", fabric="Silk", price=9000, boost=1, rating_sum=9, rating_count=2),
    dict(id=2, title="Ivory silk", collection="bridal", fabric="Silk", price=5000, stock=0, rating_sum=10, rating_count=2),
    dict(id=3, title="Black net", collection="party", fabric="", price=7000, views=7, order_count=3),
    dict(id=4, title="Green net", collection="party", fabric=None, price=7000, views=9, order_count=3),
    dict(id=5, title="Hidden_silk", collection="festive", fabric="Cotton", price=100, active=False),
    dict(id=6, title="100% cotton", collection="festive", fabric="Cotton", price=300, created_at=DAY0 - timedelta(days=1)),
]


def ids(df):
    return [r.id for r in df.collect()]


def test_listing_filters(spark):
    p = products(spark, *CATALOGUE)
    assert sorted(ids(cat.listing_filter(p))) == [1, 2, 3, 4, 6]
    assert sorted(ids(cat.listing_filter(p, include_inactive=True, q="SILK"))) == [1, 2, 5]
    assert ids(cat.listing_filter(p, q="s_6")) == [6]            # wildcards work, as the SKU is S-6
    assert ids(cat.listing_filter(p, q="100%c")) == [6]
    assert ids(cat.listing_filter(p, q="a\\b")) == []            # a stray backslash is plain text
    assert sorted(ids(cat.listing_filter(p, min_price=5000, max_price=7000, in_stock=True))) == [3, 4]
    assert sorted(ids(cat.listing_filter(p, min_price=-1, max_price=0, collection=""))) == [1, 2, 3, 4, 6]
    assert cat.listing_total(p, collection="party").first().total == 2


def test_sorts_and_pages(spark):
    p = products(spark, *CATALOGUE)

    def listed(**kw):
        return ids(cat.list_products(p, DAY0, **kw))

    assert listed(sort="price_asc") == [6, 2, 4, 3, 1]
    assert listed(sort="price_desc") == [1, 4, 3, 2, 6]
    assert listed(sort="newest") == [4, 3, 2, 1, 6]
    assert listed(sort="popular") == [4, 3, 6, 2, 1]
    assert listed(sort="rating") == [2, 1, 6, 4, 3]
    assert listed(sort="no such order") == listed(sort="recommended") == [1, 4, 3, 6, 2]
    assert listed(sort="price_asc", limit=2, page_number=2) == [4, 3]
    assert listed(sort="price_asc", limit=2, page_number=9) == []
    assert listed(sort="price_asc", limit=0, page_number=-3) == [6, 2, 4, 3, 1]      # 0 means 12
    assert listed(sort="price_asc", limit=-5) == [6]
    many = products(spark, *(dict(id=i) for i in range(1, 61)))
    assert len(ids(cat.list_products(many, DAY0, limit=500))) == 48


def test_store_discount(spark):
    p = products(spark, dict(id=1), dict(id=2, discount_type="percent", discount_value=10))
    for value, finals in (("25", [750, 900]), ("95", [100, 900]), ("-4", [1000, 900]), ("x", [1000, 900])):
        got = cat.priced_listing(p, settings(spark, value), DAY0, sort="price_asc").orderBy("id")
        assert [r.final_price for r in got.collect()] == finals
    none = spark.createDataFrame([], "key string, value string")
    assert [r.final_price for r in cat.priced_listing(p, none, DAY0).orderBy("id").collect()] == [1000, 900]


def test_facets(spark):
    p = products(spark, *CATALOGUE)
    assert rows(cat.facet_counts(p, "collection"), "collection", "n", order="kept") == [
        ("bridal", 2), ("party", 2), ("festive", 1)]
    assert rows(cat.facet_counts(p, "fabric", top=12), "fabric", "n", order="kept") == [("Silk", 2), ("Cotton", 1)]
    assert rows(cat.labelled_facets(p), "label", "n", order="kept")[0] == ("Everything", 5)
    assert tuple(cat.price_range(p).first()) == (300, 9000)


def reviews(spark, *given):
    return spark.createDataFrame([
        (r["id"], r["product_id"], r.get("name", "n"), r.get("rating", 4), r.get("body", ""), r.get("approved", True),
         r.get("created_at", DAY0)) for r in given], REVIEWS)


def test_product_detail(spark):
    p = products(spark, dict(id=1, rating_sum=9, rating_count=2), dict(id=2))
    r = reviews(spark, *(dict(id=i, product_id=1, rating=1 + i % 5, created_at=DAY0 - timedelta(days=i % 20))
                         for i in range(40)), dict(id=99, product_id=1, approved=False))
    detail = {row.id: row for row in cat.product_detail(p, r).collect()}
    assert detail[2].reviews == [] and detail[1].avg_rating == 4.5
    shown = detail[1].reviews
    assert len(shown) == 30 and [x.created_at for x in shown] == sorted((x.created_at for x in shown), reverse=True)
    assert shown[0].rating == 1 + 20 % 5        # of two equally new ones the later id
    assert rows(cat.top_reviews(r, 1), "product_id", "id", "position") == [(1, 20, 1)]


CART_PRODUCTS = [
    dict(id=1, title="Red", price=1000, stock=3), dict(id=2, title="Blue", price=500, stock=0),
    dict(id=3, title="Old", active=False), dict(id=4, title="Sale", price=99, stock=50, discount_type="amount", discount_value=9),
]


def test_price_cart(spark):
    p = products(spark, *CART_PRODUCTS)
    lines = spark.createDataFrame([
        (1, 1, "1", "2"), (1, 2, "1", "9"), (1, 3, "2", "1"), (1, 4, "3", "1"), (1, 5, "77", "1"), (1, 6, "x", "1"),
        (1, 7, "4", "0"), (1, 8, "4", "11"), (1, 9, "4", None), (1, 10, "4", "-2"), (1, 31, "4", "1"), (2, 1, "2", "1"),
    ], "order_id bigint, pos int, product_id string, qty_raw string")
    priced = od.price_cart(lines, p, cat.store_discount(settings(spark)))
    assert rows(priced.filter("order_id = 1").orderBy("pos"), "pos", "qty", "price", "trimmed", order="kept") == [
        (1, 2, 750, None), (2, 3, 750, "Red: only 3 left"), (7, 1, 90, None), (8, 10, 90, None), (9, 1, 90, None),
        (10, 1, 90, None)]
    assert rows(od.order_totals(priced), "order_id", "total", "saved", "n_items") == [(1, 4920, 1367, 6)]
    nested = od.nest_orders(priced).collect()
    assert [i.qty for i in nested[0]["items"]] == [2, 3, 1, 10, 1, 1] and nested[0].notes == ["Red: only 3 left"]
    sold = od.apply_orders(p, lines)
    assert rows(sold, "id", "order_count", "stock") == [(1, 5, 3), (2, 0, 0), (3, 0, 5), (4, 13, 50)]


def test_orders(spark):
    p = products(spark, *CART_PRODUCTS)
    lines = spark.createDataFrame([(1, 1, 1, 1), (2, 1, 2, 1), (3, 1, 1, 1), (5, 1, 4, 2)],
                                  "order_id bigint, pos int, product_id int, qty_raw int")
    at = datetime(2024, 1, 2, 3, 4, 5)
    requests = spark.createDataFrame([
        (1, " Asha ", " 98073 ", None, at), (2, "B", "1", "", at), (3, "  ", "1", "", at), (4, "D", "1", "", at),
        (5, "E & F", "+1", "x" * 600, at)], "order_id bigint, name string, phone string, note string, created_at timestamp")
    checked = od.validate_orders(requests, lines, od.price_cart(lines, p))
    assert rows(checked, "order_id", "name", "reason") == [
        (1, "Asha", None), (2, "B", od.GONE), (3, "", od.NO_CONTACT), (4, "D", od.EMPTY_BAG), (5, "E & F", None)]
    taken = od.refused_refs(requests, od.price_cart(lines, p), prefix="SW")
    assert rows(taken, "order_id", "reason") == [(5, od.REF_TAKEN)]
    assert [r.order_id for r in od.place_orders(requests, lines, p, prefix="SW").collect()] == [1]
    used = od.place_orders(requests, lines, p, prefix="SW").select("ref")
    assert od.place_orders(requests, lines, p, prefix="SW", existing=used).isEmpty()
    assert len(od.refused_refs(requests, od.price_cart(lines, p), prefix="SW", existing=used).collect()) == 2
    _, counted = od.place_and_count(requests, lines, p, prefix="SW")
    assert rows(counted, "id", "order_count") == [(1, 1), (2, 0), (3, 0), (4, 0)]
    alone = requests.filter("order_id = 5").withColumn("created_at", F.col("created_at") + F.expr("INTERVAL 1 SECOND"))
    placed = od.place_orders(requests.filter("order_id <> 5").unionByName(alone), lines, p, prefix="SW").orderBy("order_id")
    first, second = od.order_message(placed, "Shop", "91").collect()
    assert first.ref != second.ref and first.ref[:2] == "SW" and len(first.ref) == 8 and first.status == "new"
    assert int(first.ref[2:], 36) == int(at.timestamp() * 1000) % 36**6
    assert second.message == f"Shop enquiry {second.ref}\n2 x Sale (S-4)\nTotal Rs 180\nYou save Rs 18\nName: E & F\nPhone: +1"
    assert second.link == ("https://wa.me/91?text=" + f"Shop%20enquiry%20{second.ref}%0A2%20x%20Sale%20(S-4)%0ATotal%20Rs%20180"
                           "%0AYou%20save%20Rs%2018%0AName%3A%20E%20%26%20F%0APhone%3A%20%2B1")
    assert "You save" not in first.message and len(second.note) == 500 and first.note == ""


def test_order_status(spark):
    orders = spark.createDataFrame([(1, "new"), (2, "new"), (3, "shipped")], "id int, status string")
    changes = spark.createDataFrame([("1", "closed", 1), ("1", "shipped", 2), ("2", "gone", 3), ("9", "new", 4)],
                                    "id string, status string, seq int")
    assert rows(od.set_order_status(orders, changes), "id", "status") == [(1, "shipped"), (2, "new"), (3, "shipped")]


def test_bags(spark):
    p = products(spark, dict(id=1, stock=3), dict(id=2, stock=0), dict(id=3, stock=99), dict(id=4, stock=-1))
    added = spark.createDataFrame([("a", 1, 2), ("a", 1, 2), ("a", 2, 12), ("a", 3, 4), ("a", 3, 5), ("b", 4, 2)],
                                  "bag string, product_id int, qty int")
    merged = od.bag_merge(added, p)
    assert rows(merged, "bag", "product_id", "qty") == [("a", 1, 3), ("a", 2, 10), ("a", 3, 9), ("b", 4, 1)]
    lines = spark.createDataFrame([("a", 90, 100, 2), ("a", 50, 40, 1), ("a", 10, 0, 1)],
                                  "bag string, price bigint, list_price bigint, qty bigint")
    assert rows(od.bag_totals(lines), "pieces", "total", "saved") == [(4, 240, 20)]


def test_reviews(spark):
    p = products(spark, dict(id=1, rating_sum=5, rating_count=1), dict(id=2, active=False))
    r = reviews(spark, dict(id=1, product_id=1, rating=5), dict(id=2, product_id=1, rating=2, approved=False),
                dict(id=3, product_id=1, rating=3, approved=False))
    wanted = spark.createDataFrame([(1,), (2,), (2,), (8,)], "id int")
    after, moderated = rv.approve_reviews(p, r, wanted)
    assert rows(after, "id", "rating_sum", "rating_count") == [(1, 7, 2), (2, 0, 0)]
    assert rows(moderated, "id", "approved") == [(1, True), (2, True), (3, False)]
    again, _ = rv.approve_reviews(after, moderated, wanted)
    assert rows(again, "id", "rating_sum") == [(1, 7), (2, 0)]
    removed, kept = rv.delete_reviews(after, moderated, spark.createDataFrame([(1,), (3,)], "id int"))
    assert rows(removed, "id", "rating_sum", "rating_count") == [(1, 2, 1), (2, 0, 0)] and rows(kept, "id") == [(2,)]
    assert rows(rv.rating_rollup(kept), "product_id", "rating_sum", "rating_count") == [(1, 2, 1)]
    sent = spark.createDataFrame([("p-1", " A ", "5"), ("p-1", "", "5"), ("p-1", "B", "6"), ("p-1", "B", None),
                                  ("p-2", "B", "1"), ("none", "B", "1"), ("p-1", "x" * 70, "1.9")],
                                 "slug string, name string, rating string").withColumn("body", F.repeat(F.lit("b"), 900))
    held = rv.hold_reviews(sent, p)
    assert rows(held, "reason", "rating") == sorted([
        (None, 5), (rv.NO_NAME, 5), (rv.BAD_RATING, 6), (rv.BAD_RATING, 0), (rv.NOT_LISTED, 1), (rv.NOT_LISTED, 1),
        (None, 1)], key=repr)
    assert held.agg(F.max(F.length("name")), F.max(F.length("body")), F.bool_or("approved")).first()[:] == (60, 800, False)


def test_review_queue(spark):
    p = products(spark, dict(id=1), dict(id=2))
    r = reviews(spark, dict(id=1, product_id=1), dict(id=2, product_id=2, approved=False),
                dict(id=3, product_id=1, approved=False, created_at=DAY0 - timedelta(days=1)), dict(id=4, product_id=7))
    assert [x.id for x in rv.review_queue(r, p).collect()] == [2, 3, 1]
    assert [x.id for x in rv.review_queue(r, p, n=2).collect()] == [2, 3]
    orphans = reviews(spark, *(dict(id=100 + i, product_id=9, approved=False) for i in range(5)))
    assert [x.id for x in rv.review_queue(r.unionByName(orphans), p, n=3).collect()] == [2, 3, 1]


def edits(spark, *given):
    fields = list(ed.EDITABLE)
    data = [(i, str(g["id"]), *(g.get(c) for c in fields), *(c in g for c in fields)) for i, g in enumerate(given)]
    schema = ", ".join(["seq int", "id string", *(f"{c} string" for c in fields), *(f"has_{c} boolean" for c in fields)])
    return spark.createDataFrame(data, schema)


def problems(spark, p, *given, **kw):
    checked = ed.bulk_validate(edits(spark, *given), p, **kw)
    return [r.problem for r in checked.orderBy("seq").collect()]


def test_bulk_problems(spark):
    p = products(spark, dict(id=1, sku="a-1"), dict(id=2), dict(id=3))
    got = problems(
        spark, p,
        dict(id=1, sku="S-2"), dict(id=2, sku="A-1"),            # a swap is refused
        dict(id=2, sku="new "), dict(id=3, sku="NEW", title="x"),   # second use in the batch
        dict(id=2, sku="New"),                                   # the same piece may repeat it
        dict(id=9, title="x"), dict(id="7x", price="5"), dict(id=1, title="  "), dict(id=1, sku=" "),
        dict(id=1, collection="rugs"), dict(id=1, collection=None), dict(id=1, price="0"), dict(id=1, price="free"),
        dict(id=1, title=None), dict(id=1), dict(id=1, sku="A-1"), dict(id=9),
    )
    assert got == [
        "SKU S-2 already belongs to another piece.", "SKU A-1 already belongs to another piece.", None,
        "SKU NEW is used twice in these edits.", None, "Piece 9 no longer exists.", "Piece 7x no longer exists.",
        "Piece 1: title cannot be empty.", "Piece 1: SKU cannot be empty.", "Piece 1: unknown collection.",
        "Piece 1: unknown collection.", "Piece 1: price must be above zero.", "Piece 1: price must be above zero.",
        None, None, None, "Piece 9 no longer exists.",
    ]
    # a claim stands even where the edit fails later on
    assert problems(spark, p, dict(id=1, sku="Z", price="0"), dict(id=2, sku="z")) == [
        "Piece 1: price must be above zero.", "SKU Z is used twice in these edits."]
    assert problems(spark, p, dict(id=1, title="x"), dict(id=9), max_edits=1) == [None]


def test_bulk_apply(spark):
    p = products(spark, dict(id=1, price=500, discount_type="percent", discount_value=10), dict(id=2), dict(id=3))
    batch = ed.bulk_validate(edits(
        spark, dict(id=1, boost="99", stock="-3", mrp="x", active="false"), dict(id=1, boost="-1", title=" first "),
        dict(id=1, title=" second "), dict(id=2, discount_type="amount", discount_value="5000", price="300"),
        dict(id=3, discount_value="5000"), dict(id=3, active="", description=None), dict(id=2),
    ), p)
    after = {r.id: r for r in ed.bulk_apply(p, batch).collect()}
    assert (after[1].boost, after[1].stock, after[1].mrp, after[1].active, after[1].title) == (0, 0, 0, True, "second")
    assert (after[1].discount_type, after[1].discount_value) == ("percent", 10)
    assert (after[2].price, after[2].discount_value) == (300, 299)
    assert (after[3].discount_type, after[3].discount_value) == ("none", 5000)     # value alone is not held
    assert (after[3].active, after[3].description) == (False, "null")
    assert tuple(ed.bulk_outcome(batch).first()) == (0, 6)
    none = ed.bulk_validate(edits(spark, dict(id=1, discount_type="half", discount_value="7"),
                                  dict(id=2, discount_type="percent", discount_value="95")), p)
    after = {r.id: r for r in ed.bulk_apply(p, none).collect()}
    assert (after[1].discount_type, after[1].discount_value, after[2].discount_value) == ("none", 0, 90)
    refused = ed.bulk_validate(edits(spark, dict(id=1, title="x"), dict(id=9, title="y")), p)
    assert rows(ed.bulk_apply(p, refused), "id", "title") == rows(p, "id", "title")
    assert tuple(ed.bulk_outcome(refused).first()) == (1, 0)


def test_edit_of_one_column(spark):
    p = products(spark, dict(id=1))
    one = spark.createDataFrame([(1, 1, "none"), (2, 1, None)], "seq int, id int, discount_type string")
    after = ed.bulk_apply(products(spark, dict(id=1, discount_type="percent", discount_value=9)), ed.bulk_validate(one, p))
    assert rows(after, "discount_type", "discount_value") == [("none", 0)]


def test_row_diff(spark):
    before = products(spark, dict(id=1, fabric=None), dict(id=2, title="a"), dict(id=3))
    after = products(spark, dict(id=1, fabric=""), dict(id=2, title="b", price=7), dict(id=4))
    assert rows(ed.row_diff(before, after, ["title", "price", "fabric", "active"]), "id", "field", "value") == [
        (2, "price", "7"), (2, "title", "b")]


def test_normalise(spark):
    raw = spark.createDataFrame([
        (" Red ", " sk-1 ", "rugs", "12.9", "-3", "99", "half", "7", "x"), (None, None, "party", None, "4", None, "amount", "50", ""),
        ("T", "s", None, "100", "1", "0", "amount", "100", None), ("T", "s", None, "100", "1", "0", "percent", "95", None),
    ], "title string, sku string, collection string, price string, stock string, boost string, discount_type string, "
       "discount_value string, active string").withColumn("images", F.array(*[F.lit(str(i)) for i in range(9)]))
    got = rows(mu.normalise_products(raw), "title", "sku", "collection", "price", "stock", "boost", "discount_type",
               "discount_value", "active", order="kept")
    assert got == [
        ("Red", "SK-1", "designer", 12, -3, 99, "none", 7, True), ("", "", "party", 0, 4, 0, "none", 0, False),
        ("T", "S", "designer", 100, 1, 0, "amount", 99, False), ("T", "S", "designer", 100, 1, 0, "percent", 90, False)]
    assert mu.normalise_products(raw).select(F.size("images"), "mrp", "fabric").first()[:] == (8, 0, "")


def test_create_and_update(spark):
    p = products(spark, dict(id=1, sku="A", slug="red"), dict(id=2, sku="B", slug="red-3"))
    raw = spark.createDataFrame([
        (1, "Red", "c", "5"), (2, "Red", "C ", "5"), (3, "", "d", "5"), (4, "Red", "", "5"), (5, "Red", "e", "0"),
        (6, "Red", "b", "5"), (7, "Red!", "f", "5"), (8, "Blue", "g", "5")],
        "seq bigint, title string, sku string, price string")
    made = mu.create_products(raw, p)
    assert rows(made.filter("reason IS NULL"), "seq", "sku", "slug") == [(1, "C", "red-2"), (7, "F", "red-4"), (8, "G", "blue")]
    assert rows(made.filter("reason IS NOT NULL"), "seq", "reason") == [
        (2, "SKU C is already in the catalogue."), (3, mu.NO_TITLE), (4, mu.NO_SKU), (5, mu.NO_PRICE),
        (6, "SKU B is already in the catalogue.")]

    updates = spark.createDataFrame([
        (1, "1", "New", "b", "9"), (2, "9", "New", "x", "9"), (3, "2", " ", "y", "9"), (4, "2", "Two", "b", "-1"),
        (5, "1", "One", "a", "8"), (6, "1", "Uno", "z", "7"), (7, "2", "Dos", "z", "7")],
        "seq bigint, id string, title string, sku string, price string")
    after, checked = mu.full_update(p, updates)
    assert rows(checked.orderBy("seq"), "reason", order="kept") == [
        ("SKU B belongs to another piece.",), (mu.NOT_FOUND,), (mu.NO_TITLE,), (mu.NO_PRICE,), (None,), (None,),
        ("SKU Z belongs to another piece.",)]
    assert rows(after, "id", "title", "sku", "price", "stock", "slug") == [(1, "Uno", "Z", 7, 0, "red"), (2, "t", "B", 1000, 5, "red-3")]


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_full_updates_equal_one_by_one(spark, seed):
    """Hot SKUs, chains of pieces that wait for one another, and SKUs handed on again and again."""
    r = random.Random(seed)
    skus = [f"S{i}" for i in range(12)]
    p = products(spark, *(dict(id=i, sku=skus[i], slug=f"s{i}") for i in range(8)))
    given = [(seq, str(r.randint(0, 8)), r.choice(["", "T"] + ["U"] * 8), r.choice(skus[: r.choice([3, 12])]), "5") for seq in range(60)]
    if seed == 3:  # each takes what the one before gave up
        given = [(0, "0", "U", "S11", "5"), *((i, str(i), "U", skus[i - 1], "5") for i in range(1, 8))]
    holds, reasons = {i: skus[i] for i in range(8)}, []
    for _, piece, title, sku, _ in given:
        i = int(piece)
        if i not in holds:
            reasons.append(mu.NOT_FOUND)
        elif not title:
            reasons.append(mu.NO_TITLE)
        elif any(s == sku and q != i for q, s in holds.items()):
            reasons.append(mu.SKU_TAKEN.format(sku))
        else:
            holds[i] = sku
            reasons.append(None)
    r.shuffle(given)
    after, checked = mu.full_update(p, spark.createDataFrame(given, "seq bigint, id string, title string, sku string, price string"))
    assert [x["reason"] for x in checked.orderBy("seq").collect()] == reasons
    assert {x["id"]: x["sku"] for x in after.collect()} == holds


def test_inserts_settings_removals(spark):
    old = spark.createDataFrame([(1, "A")], "id int, sku string")
    new = spark.createDataFrame([(2, "A"), (3, "B"), (4, "B"), (5, "C")], "id int, sku string")
    assert rows(mu.insert_if_absent(new, old), "id", "sku") == [(3, "B"), (5, "C")]
    changes = spark.createDataFrame([("store_discount", "200", 1), ("store_discount", "12x", 2), ("other", "v", 3)],
                                    "key string, value string, seq int")
    assert rows(mu.settings_upsert(settings(spark), changes), "key", "value") == [("other", "v"), ("store_discount", "12")]
    p, r = products(spark, dict(id=1), dict(id=2)), reviews(spark, dict(id=1, product_id=1), dict(id=2, product_id=2))
    left, kept = mu.delete_products(p, r, spark.createDataFrame([(1,), (1,)], "id int"))
    assert rows(left, "id") == [(2,)] and rows(kept, "id") == [(2,)]
    before = spark.createDataFrame([(1, ["a.webp", "b.webp"]), (2, ["c.png"]), (3, None)], "id int, images array<string>")
    after = spark.createDataFrame([(1, ["b.webp", "n.webp"]), (3, None)], "id int, images array<string>")
    assert rows(mu.orphan_images(before, after), "id", "url") == [(1, "a-thumb.webp"), (1, "a.webp"), (2, "c.png")]


def test_traffic(spark):
    hits = spark.createDataFrame([("2024-01-%02d" % d, k, 10) for d in range(1, 32) for k in ("shop", "product")]
                                 + [("2024-02-01", "shop", 3)], "day string, kind string, hits bigint")
    visitors = spark.createDataFrame([("2024-02-01", "v"), ("2024-02-01", "w"), ("2024-02-01", "v")], "day string, visitor string")
    series = tr.traffic_series(hits, visitors)
    got = series.collect()
    assert len(got) == 30 and (got[0].day, got[-1].day) == ("2024-01-03", "2024-02-01") and got[-1][:] == ("2024-02-01", 3, 2)
    summary = tr.traffic_summary(series, "2024-02-01 09:00:00").first()
    assert summary[:] == (3, 2, 143, 583, 583)          # 25 January counts as within 7 days
    assert tr.traffic_summary(tr.traffic_series(hits, visitors, days=None), "2024-03-09 00:00:00").first()[:] == (0, 0, 0, 0, 623)
    bars = {r.day: r for r in tr.traffic_bars(series).collect()}
    assert (bars["2024-01-05"].height, bars["2024-02-01"].height, bars["2024-02-01"].visitor_height) == (100, 15, 10)
    assert bars["2024-01-05"].label == "5 Jan"
    assert rows(tr.hits_by_kind(hits), "kind", "hits", order="kept") == [("shop", 313), ("product", 310)]
    more = spark.createDataFrame([("2024-02-01", "shop", 4), ("2024-02-02", "shop", 1)], "day string, kind string, hits bigint")
    merged = tr.merge_counters(hits, more, ["day", "kind"])
    assert rows(merged.filter("day > '2024-01-31'"), "day", "hits") == [("2024-02-01", 7), ("2024-02-02", 1)]
    assert tr.daily_visitors(visitors, approximate=True).first().visitors == 2
    refs = spark.createDataFrame([("d", f"r{i}", i % 3) for i in range(12)], "day string, ref string, hits bigint")
    assert [r.ref for r in tr.top_referrers(refs).collect()] == ["r11", "r2", "r5", "r8", "r1", "r10", "r4", "r7"]


def test_stats(spark):
    orders = spark.createDataFrame([("new",), ("closed",), ("new",)], "status string")
    r = reviews(spark, dict(id=1, product_id=1), dict(id=2, product_id=1, approved=False))
    assert cat.shop_stats(products(spark, *CATALOGUE), orders, r).first()[:] == (6, 5, 1, 2, 1)
