"""Tables stored together, text files with broken rows, JSON without a fixed shape."""

from __future__ import annotations

import json
from collections import Counter

import pytest
from pyspark.sql import functions as F, types as T

from stallwise.operators import orders as od
from stallwise.schemas import ORDER_ITEM
from stallwise.sources import colocated, intake, variants
from test_operators import products, rows

PIECES = "product_id bigint, sku string, title string, price int, stock int, discount_type string, discount_value int, active boolean, id int"


@pytest.fixture
def shuffled_joins(spark):
    """Tables this small would be broadcast."""
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def shop(spark):
    pieces = spark.createDataFrame(
        [(i, f"S{i}", f"T{i}", 100 * i, i % 4, "none", 0, i % 5 != 0, i) for i in range(1, 41)], PIECES)
    # piece 7 has a third of all lines; some lines name no piece, or one that is not there
    asked = [(o, p, [7, 1 + (o * 5 + p) % 45, None if o % 9 == 0 else 1 + o % 40][p % 3], 1 + o % 12) for o in range(400) for p in range(1, 4)]
    return spark.createDataFrame(asked, "order_id bigint, pos int, product_id bigint, qty_raw int"), pieces


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_stored_tables_join_without_a_shuffle(spark, shuffled_joins):
    lines, pieces = shop(spark)
    stored = colocated.store(spark, lines, pieces, "product_id", buckets=8)
    priced = od.price_stored_cart(spark.table(stored.many), spark.table(stored.one), stored.on)
    assert "SortMergeJoin" in plan_of(priced) and "Exchange" not in plan_of(priced)
    plain = od.price_cart(lines, pieces)
    assert "Exchange" in plan_of(plain)
    assert rows(priced, *priced.columns) == rows(plain, *priced.columns) and priced.count() > 400


def test_a_hot_key_is_dealt_over_shares(spark):
    lines, pieces = shop(spark)
    stored = colocated.store(spark, lines, pieces, "product_id", buckets=8)
    many = Counter((r.product_id, r.share) for r in spark.table(stored.many).collect())
    shares = [n for (k, _), n in many.items() if k == 7]
    assert len(shares) >= 3 and max(shares) < 1.5 * 1200 / 8
    assert sum(many.values()) == lines.where("product_id is not null").count()
    assert {s for k, s in many if k != 7} == {0}
    one = Counter(r.product_id for r in spark.table(stored.one).collect())
    assert one[7] >= len(shares) and all(n == 1 for k, n in one.items() if k != 7)


def test_stored_tables_at_the_edges(spark, tmp_path):
    lines, pieces = shop(spark)
    stored = colocated.store(spark, lines.limit(0), pieces, "product_id", buckets=4)
    assert od.price_stored_cart(spark.table(stored.many), spark.table(stored.one), stored.on).count() == 0
    # a column of its own name gives way
    folders = (str(tmp_path / "many"), str(tmp_path / "one"))
    stored = colocated.store(spark, lines.withColumn("Share", F.lit("x")), pieces, "product_id", buckets=4, folders=folders)
    again = colocated.reopen(spark, folders[0], spark.table(stored.many).schema, "product_id", 4)
    assert rows(spark.table(again), "order_id", "pos", "share") == rows(spark.table(stored.many), "order_id", "pos", "share")
    with pytest.raises(TypeError):
        colocated.store(spark, lines, pieces.withColumn("product_id", F.col("id")), "product_id", buckets=4)


def test_reopened_tables_join_without_a_shuffle(spark, shuffled_joins, tmp_path):
    lines, pieces = shop(spark)
    folders = (str(tmp_path / "many"), str(tmp_path / "one"))
    stored = colocated.store(spark, lines, pieces, "product_id", buckets=4, folders=folders)
    names = [colocated.reopen(spark, f, spark.table(n).schema, "product_id", 4) for f, n in zip(folders, (stored.many, stored.one))]
    priced = od.price_stored_cart(spark.table(names[0]), spark.table(names[1]), stored.on)
    assert "Exchange" not in plan_of(priced)
    assert rows(priced, *priced.columns) == rows(od.price_cart(lines, pieces), *priced.columns)


def test_broken_csv_rows(spark, tmp_path):
    head = "id,product_id,name,rating,body,approved,created_at"
    good = ['1,5,Asha,4,"fine, ""really""",true,2024-01-02 03:04:05', "2,5,,3,,false,"]
    bad = {
        "x,5,Asha,4,b,true,": "not of its type: id", "3,five,Asha,4.5,b,yes,": "not of its type: product_id, rating, approved",
        "4,5,Asha": "not a row of this table", "5,5,Asha,4,b,true,,more": "not a row of this table", ",5,Asha,4,b,true,": "missing: id",
        ",,Asha,4,b,true,": "missing: id, product_id",
    }
    (tmp_path / "r.csv").write_text("\n".join([head, good[0], *bad, good[1], ""]))
    found = intake.read_checked(spark, "reviews", str(tmp_path / "r.csv"))
    assert [(r.id, r.product_id, r.name, r.rating, r.body, r.approved) for r in found.accepted.orderBy("id").collect()] == [
        (1, 5, "Asha", 4, 'fine, "really"', True), (2, 5, None, 3, None, False)]
    rejected = found.rejected.collect()
    assert Counter(r.reason for r in rejected) == Counter(bad.values())
    # what did not parse is there as it came
    assert {r.raw: r.reason for r in rejected if not r.reason.startswith("missing")} == {
        k: v for k, v in bad.items() if not v.startswith("missing")}
    assert all(r.file.endswith("r.csv") for r in rejected)
    # fewer columns are looked at: the verdict stays
    assert found.accepted.select("id").count() == 2


def test_broken_json_rows(spark, tmp_path):
    lines = ['{"id":1,"product_id":5,"rating":4,"more":[1]}', '{"id":2,"product_id":5,"rating":"four"}', '{"id":3,"prod', "[]", '{"product_id":5}', "7"]
    (tmp_path / "r.json").write_text("\n".join(lines))
    found = intake.read_checked(spark, "reviews", str(tmp_path / "r.json"), "json")
    assert rows(found.accepted, "id", "rating") == [(1, 4)]
    reasons = {r.raw: r.reason for r in found.rejected.collect()}
    assert reasons[lines[1]] == "not of its type: rating" and reasons[lines[2]] == "not a row of this table"
    assert reasons[lines[5]] == "not a row of this table" and "missing: id" in reasons.values()


def test_nested_columns_and_empty_files(spark, tmp_path):
    p = products(spark, dict(id=1, sku="S1", images=["a.webp"]), dict(id=2, sku="S2"))
    from stallwise.sources.tables import write_table

    write_table(p, str(tmp_path / "p"), "csv")
    found = intake.read_checked(spark, "products", str(tmp_path / "p"))
    assert rows(found.accepted, "id", "images", "created_at") == rows(p, "id", "images", "created_at") and found.rejected.isEmpty()
    (tmp_path / "none.csv").write_text("")
    found = intake.read_checked(spark, "products", str(tmp_path / "none.csv"))
    assert found.accepted.isEmpty() and found.rejected.isEmpty()


def read_items(spark, *texts):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "n int, v string")
    return df.select("n", variants.elements(F.col("v")).alias("items"))


def test_elements_of_odd_texts(spark):
    got = read_items(spark, '[{"id":1}, 2, null, [3]]', "[{", None, "", "{}", "[]", '"x"')
    assert [r[0] for r in got.orderBy("n").select(F.size("items")).collect()] == [4, 0, 0, 0, 0, 0, 0]


def test_known_and_unknown_fields(spark):
    item = {"id": 1, "sku": 'a"b', "qty": "two", "gift": None, "box": {"layers": [1, 2.5], "lid": "ü,{}"}, "price": 30}
    got = read_items(spark, json.dumps([item, 7])).select(
        F.transform("items", lambda i: variants.known(i, ORDER_ITEM)).alias("own"),
        F.transform("items", lambda i: F.array_sort(F.map_keys(variants.unknown(i, ORDER_ITEM)))).alias("other"),
    ).first()
    assert (got.own[0].id, got.own[0].sku, got.own[0].qty, got.own[0].price) == (1, 'a"b', None, 30)
    assert got.own[1].asDict() == dict.fromkeys(ORDER_ITEM.fieldNames()) and got.other == [["box", "gift"], []]


@pytest.mark.parametrize("item", [{"id": 1, "price": 5, "z": [1, {"b": None}], "a": "ü,{}\"\\"}, {"z": {}}, {"id": 2}, {}])
def test_unknown_fields_survive_a_round_trip(spark, item):
    shape = T.StructType.fromDDL("id int, price int")

    def dearer(i):
        own = variants.known(i, shape)
        return variants.with_known(i, own.withField("price", own["price"] * 2), shape)

    text = read_items(spark, json.dumps([item, item])).select(variants.listed(F.transform("items", dearer))).first()[0]
    want = {**item, **({"price": 10} if "price" in item else {})}
    assert json.loads(text) == [want, want]


def test_an_item_is_written_as_text_once(spark):
    """Outside of a lambda's argument each text would be made again wherever it is named."""
    item = F.try_variant_get(F.try_parse_json(F.col("v")), "$", "variant")
    text = variants.with_known(item, variants.known(item, ORDER_ITEM), ORDER_ITEM)
    assert text._jc.toString().count("to_json") == 2
    df = spark.createDataFrame([('{"id": 1, "price": "free", "sku": "a", "x": [1]}',), ("7",), ("[]",), ('{"qty": 1.0, "ID": 2}',)], "v string")
    own = df.select(variants.known(item, ORDER_ITEM).alias("own")).select("own.*")
    assert [(r.id, r.sku, r.price, r.qty) for r in own.collect()] == [(1, "a", None, None), (None,) * 4, (None,) * 4, (None, None, None, 1)]
    assert [json.loads(r[0]) for r in df.select(text).collect()] == [{"id": 1, "sku": "a", "x": [1]}, {}, {}, {"qty": 1, "ID": 2}]
