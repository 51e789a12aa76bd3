"""Table changes as functions from old tables to new ones."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from stallwise.functions.images import first_photos, key_public_id, object_key, public_id, thumb_url
from stallwise.functions.text import clamp, clean_text, filled, one_of, parse_int, parse_int32, truthy
from stallwise.operators.slugs import assign_slugs
from stallwise.operators.spread import running_count
from stallwise.schemas import COLLECTIONS, DISCOUNT_TYPES, MAX_DISCOUNT, STORE_DISCOUNT_KEY
from stallwise.session import enable_checkpoints

# Reasons for which a product is refused, with the SKU put in.
NO_TITLE = "Give the piece a title."
NO_SKU = "Give the piece an SKU."
NO_PRICE = "Set a price above zero."
SKU_EXISTS = "SKU {} is already in the catalogue."
SKU_TAKEN = "SKU {} belongs to another piece."
NOT_FOUND = "No such piece."

WHOLE_NUMBERS = ("price", "mrp", "stock", "boost")
TEXTS = ("fabric", "colour", "work", "blouse_size", "description")
REPLACED = ("sku", "title", "collection", *TEXTS, *WHOLE_NUMBERS, "active", "images", "discount_type", "discount_value")


def normalise_products(raw: DataFrame) -> DataFrame:
    """Clean product rows as typed into a form; columns that are absent count as empty.

    Stock, MRP, boost and price are parsed but not held within bounds.
    """
    types = dict(raw.dtypes)

    def given(name: str, kind: str = "string") -> Column:
        return F.col(name) if name in types else F.lit(None).cast(kind)

    first = {
        "title": clean_text(given("title")),
        "sku": clean_text(given("sku"), upper=True),
        "collection": one_of(given("collection"), COLLECTIONS, "designer"),
        **{c: parse_int32(given(c)) for c in WHOLE_NUMBERS},
        **{c: clean_text(given(c)) for c in TEXTS},
        "active": truthy(given("active"), types.get("active", "string")),
        "images": first_photos(given("images", "array<string>")),
        "discount_type": one_of(given("discount_type"), DISCOUNT_TYPES, "none"),
        "discount_value": F.greatest(F.lit(0), parse_int32(given("discount_value"))),
    }
    rows = raw.withColumns(first)
    kind, value, price = F.col("discount_type"), F.col("discount_value"), F.col("price")
    held = (
        F.when(kind == "percent", F.least(F.lit(MAX_DISCOUNT), value))
        .when((kind == "amount") & (value >= price), F.greatest(F.lit(0), price - 1))
        .otherwise(value)
    )
    rows = rows.withColumn("discount_value", held)
    return rows.withColumn(
        "discount_type", F.when(F.col("discount_value") == 0, "none").otherwise(F.col("discount_type"))
    )


def insert_if_absent(new: DataFrame, old: DataFrame, key: str = "sku", order: str = "id") -> DataFrame:
    """Rows of ``new`` to be appended: those whose key is not in ``old``, the first one of each key.

    The keys are reduced to one row each before they meet ``old``, and the chosen rows are found again by
    their order number, so that a much repeated key is never gathered.
    """
    first = new.groupBy(key).agg(F.min(order).alias(order))
    absent = first.join(old.select(key).distinct(), key, "left_anti").select(order)
    return new.join(absent, order, "left_semi").select(*new.columns)


def create_products(raw: DataFrame, existing: DataFrame, order: str = "seq") -> DataFrame:
    """Check new products in order; the rows without ``reason`` are accepted and have their slug."""
    rows = normalise_products(raw).withColumn(
        "reason",
        F.when(F.col("title") == "", NO_TITLE)
        .when(F.col("sku") == "", NO_SKU)
        .when(F.col("price") <= 0, NO_PRICE),
    )
    exists = filled(SKU_EXISTS, F.col("sku"))
    taken = existing.select("sku").distinct().withColumn("_taken", F.lit(True))
    # per SKU: the first acceptable row, unless the catalogue has the SKU
    first = rows.filter("reason IS NULL").groupBy("sku").agg(F.min(order).alias("_first"))
    first = first.join(taken, "sku", "left")
    late = F.when(F.coalesce("_taken", F.lit(False)) | (F.col("_first") != F.col(order)), exists)
    enable_checkpoints(raw.sparkSession)
    # written once: the slugs, the accepted and the refused rows all read it
    decided = rows.join(first, "sku", "left").withColumn("reason", F.coalesce("reason", late)).drop("_first", "_taken").checkpoint()
    accepted = assign_slugs(decided.filter("reason IS NULL"), existing, order=order)
    refused = decided.filter("reason IS NOT NULL").withColumn("slug", F.lit(None).cast("string"))
    return accepted.unionByName(refused)


def sku_clashes(changes: DataFrame, products: DataFrame) -> DataFrame:
    """(id, sku) of changes whose SKU belongs to a product of another id."""
    owners = products.select("sku", F.col("id").alias("owner"))
    return changes.join(owners, "sku").filter(F.col("id") != F.col("owner")).select("id", "sku", "owner")


def accepted_in_turn(asked: DataFrame, owned: DataFrame) -> DataFrame:
    """Which of the updates ``asked`` (no, seq, id, sku) get their SKU if they come one after the other: (no, accepted).

    ``owned`` holds (id, sku) before the first one. An update is refused while another piece holds its SKU, and an accepted one gives up
    the SKU that its piece held. Rounds work on all updates at once: each takes the last round's answers as given, follows what every
    piece holds and how many pieces hold each SKU, and answers anew. After a round, the updates that wait for one answer
    less than before are right; when a round changes nothing, all are. There are as many rounds as the longest chain of updates that
    wait for one another, whatever the number of updates.
    """
    enable_checkpoints(asked.sparkSession)
    state = asked.withColumn("accepted", F.lit(True)).checkpoint()
    at_first = owned.join(asked.select("sku").distinct(), "sku", "left_semi").select("sku", F.lit(1).alias("change"))
    while True:
        # what the piece holds just before: the SKU of its last accepted update, or that of the table
        turns = running_count(state, ["id"], "seq", F.col("accepted"), out="turn", tie="no")
        held = turns.filter("accepted").select("id", "turn", F.col("sku").alias("had")).unionByName(
            owned.select("id", F.lit(0).cast("bigint").alias("turn"), F.col("sku").alias("had"))
        )
        turns = (
            turns.withColumn("turn", F.col("turn") - F.col("accepted").cast("bigint")).join(held, ["id", "turn"], "left")
            .withColumn("own", F.col("had").eqNullSafe(F.col("sku"))).drop("turn").checkpoint()
        )
        # pieces that hold each SKU: an update asks first, then it takes and gives up
        moves = turns.filter("accepted AND NOT own")
        step = F.struct(F.col("no"), F.lit(1).alias("part")).alias("step")
        events = (
            turns.select("*", F.struct(F.col("no"), F.lit(0).alias("part")).alias("step"), F.lit(0).alias("change"))
            .unionByName(moves.select("sku", "seq", step, F.lit(1).alias("change")), allowMissingColumns=True)
            .unionByName(moves.filter("had IS NOT NULL").select(F.col("had").alias("sku"), "seq", step, F.lit(-1).alias("change")), allowMissingColumns=True)
            .unionByName(at_first, allowMissingColumns=True)
        )
        holders = running_count(events, ["sku"], "seq", F.col("change"), out="holders", tie="step")
        answers = holders.filter("id IS NOT NULL").select(
            "no", "seq", "id", "sku", F.col("accepted").alias("before"),
            (F.col("holders") - F.col("own").cast("bigint") <= 0).alias("accepted"),
        ).checkpoint()
        if answers.filter("accepted <> before").isEmpty():
            return answers.select("no", "accepted")
        state = answers.drop("before")


def full_update(products: DataFrame, updates: DataFrame, order: str = "seq") -> tuple[DataFrame, DataFrame]:
    """Replace all editable columns of the products named in ``updates`` (id and form columns).

    Returns the new products and the updates with their ``reason`` (NULL where applied). Updates take effect one after the other,
    by ``order`` (equal ones in any order): a SKU that an accepted update gave up is free for later ones. Of several
    accepted updates of one product the last one stands.
    """
    enable_checkpoints(products.sparkSession)
    rows = normalise_products(updates).withColumn("id", parse_int(F.col("id")))
    present = products.select(F.col("id").cast("bigint").alias("id")).withColumn("_present", F.lit(True))
    rows = rows.join(present, "id", "left").withColumn(
        "reason",
        F.when(F.col("_present").isNull(), NOT_FOUND)
        .when(F.col("title") == "", NO_TITLE)
        .when(F.col("price") <= 0, NO_PRICE),
    ).withColumn("_no", F.monotonically_increasing_id()).checkpoint()
    asked = rows.filter("reason IS NULL").select(F.col("_no").alias("no"), F.col(order).cast("bigint").alias("seq"), "id", "sku")
    owned = products.select(F.col("id").cast("bigint").alias("id"), "sku").filter("sku IS NOT NULL")
    answers = accepted_in_turn(asked, owned).withColumnsRenamed({"no": "_no", "accepted": "_accepted"})
    clash = filled(SKU_TAKEN, F.col("sku"))
    checked = rows.join(answers, "_no", "left").withColumn(
        "reason", F.coalesce("reason", F.when(~F.col("_accepted"), clash))
    ).drop("_present", "_no", "_accepted")
    columns = [c for c in REPLACED if c in products.columns]
    last = checked.filter("reason IS NULL").groupBy("id").agg(
        F.max_by(F.struct(*columns), order).alias("_new")
    )
    joined = products.join(last, "id", "left")
    replaced = {c: F.when(F.col("_new").isNotNull(), F.col(f"_new.{c}")).otherwise(F.col(c)) for c in columns}
    return joined.withColumns(replaced).select(*products.columns), checked


def delete_products(products: DataFrame, reviews: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Remove products and, with them, their reviews."""
    gone = ids.select(F.col("id").alias("_gone")).distinct()
    return (
        products.join(gone, F.col("id") == F.col("_gone"), "left_anti"),
        reviews.join(gone, F.col("product_id") == F.col("_gone"), "left_anti"),
    )


def settings_upsert(settings: DataFrame, changes: DataFrame, order: str = "seq") -> DataFrame:
    """Settings after (key, value, seq) changes, the last of a key winning; the store discount is held in 0..90."""
    percent = clamp(parse_int(F.col("value")), 0, MAX_DISCOUNT).cast("string")
    value = F.when(F.col("key") == STORE_DISCOUNT_KEY, percent).otherwise(F.col("value"))
    old = settings.select("key", "value", F.lit(None).cast("bigint").alias("_seq"))
    new = changes.select("key", value.alias("value"), F.col(order).cast("bigint").alias("_seq"))
    rank = F.struct(F.col("_seq").isNotNull(), F.col("_seq"))
    return old.unionByName(new).groupBy("key").agg(F.max_by("value", rank).alias("value"))


def orphan_objects(orphans: DataFrame, folder: str, url: str = "url") -> DataFrame:
    """Orphan photos as what a store deletes by: the upload's own id, or else folder and object key."""
    stored = F.coalesce(public_id(F.col(url)), key_public_id(object_key(F.col(url)), folder))
    return orphans.withColumn("stored", stored)


def orphan_images(before: DataFrame, after: DataFrame) -> DataFrame:
    """Photos no longer used once ``after`` replaces ``before`` (removed products included), each with its thumbnail."""
    new = after.select("id", F.col("images").alias("_kept"))
    empty = F.array().cast("array<string>")
    dropped = F.array_except(F.coalesce("images", empty), F.coalesce("_kept", empty))
    urls = before.select("id", "images").join(new, "id", "left").select("id", F.explode(dropped).alias("url"))
    return urls.select("id", F.explode(F.array_distinct(F.array("url", thumb_url(F.col("url"))))).alias("url"))
