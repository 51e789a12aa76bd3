"""Text search over an index of trigrams, for catalogues too large to scan for every search.

Two tables lie side by side, both cut into shelves of ``shelf`` consecutive ids: the rows, in order of their ids, and the postings, one row for
each trigram and block of ``block`` ids with the sorted ids whose searched columns hold it, in order of the trigram. A search reads the
postings of its pattern's trigrams only (a pushed ``IN`` over sorted files), intersects the lists of each block, which have at most
``block`` ids however common a trigram is, and holds the candidates' rows against the pattern itself. Shelves without a
candidate are not read: their numbers are sent to the scan, and there are at most (greatest id) / ``shelf`` of them.

The pattern means what it means in ``catalog.search_condition``: case does not matter, ``%`` and ``_`` are wildcards. Only its pieces
between wildcards of three letters and more help; a pattern without any is searched by a scan, by this rule.
Ids are whole numbers, unique and not NULL. A changed row is put right by writing its shelf anew (``refresh``); other shelves' files stay.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from stallwise.operators.catalog import SEARCHED, search_condition
from stallwise.session import remove

GRAM = 3
BLOCK, SHELF = 1 << 12, 1 << 20
#: Blocks whose postings are made by one task.
STRETCH = 4
#: Letters of an anchor, by which a pattern's longest piece meets the texts: the most that go into it.
ANCHORS = (6, 12, 24, 48)


def with_grams(df: DataFrame, columns: list[str] | tuple[str, ...], out: str = "grams", sizes: Sequence[int] = (GRAM,)) -> DataFrame:
    """Append the distinct pieces of ``sizes`` letters, trigrams if not said, of lower-cased text columns; none go across columns."""
    # each column's letters become a column of their own: a lambda would split the text again for every letter
    letters = {f"_letters{i}": F.split(F.lower(F.coalesce(F.col(c).cast("string"), F.lit(""))), "") for i, c in enumerate(columns)}
    df = df.withColumns(letters)

    def grams(name: str, size: int) -> Column:
        chars = F.col(name)
        places = F.sequence(F.lit(0), F.size(chars) - size)
        if size == GRAM:
            gram = F.transform(places, lambda i: F.concat(*(F.get(chars, i + k) for k in range(GRAM))))
        else:
            gram = F.transform(places, lambda i: F.array_join(F.slice(chars, i + 1, F.lit(size)), ""))
        return F.when(F.size(chars) >= size, gram).otherwise(F.array().cast("array<string>"))

    found = F.array_distinct(F.flatten(F.array(*(grams(name, size) for name in letters for size in sizes))))
    return df.withColumn(out, found).drop(*letters)


def each_gram(df: DataFrame, *stays: str, grams: str = "grams", out: str = "gram") -> DataFrame:
    """A row for each of the grams; outer, since a plain ``explode`` is filtered by its list beforehand, made once more for that."""
    return df.select(*stays, F.explode_outer(grams).alias(out)).where(F.col(out).isNotNull())


def postings(rows: DataFrame, columns: tuple[str, ...] = SEARCHED, key: str = "id", block: int = BLOCK, shelf: int = SHELF) -> DataFrame:
    """(shelf, gram, block, ids): of each block of ids those whose columns hold the trigram, in order.

    The rows are dealt out by stretches of a few blocks first, so that their trigrams, many times the rows, are made by many tasks and
    gathered where they are made.
    """
    stretch = max(block, min(shelf, STRETCH * block))
    own = F.col(key).cast("bigint")
    dealt = rows.select(own.alias("id"), *(F.col(c).alias(f"_column{i}") for i, c in enumerate(columns))).withColumn(
        "stretch", F.floor(F.col("id") / stretch)
    ).repartition("stretch")
    held = each_gram(with_grams(dealt, [f"_column{i}" for i in range(len(columns))]), "stretch", "id")
    blocks = held.groupBy("stretch", "gram", F.floor(F.col("id") / block).alias("block")).agg(F.sort_array(F.collect_set("id")).alias("ids"))
    return blocks.select("gram", "block", "ids", F.floor(F.col("block") * block / shelf).alias("shelf"))


def _written(df: DataFrame, path: str, *order: str) -> None:
    """Sorted files below one folder per shelf; only the folders of shelves that occur in ``df`` are replaced."""
    writer = df.sortWithinPartitions("shelf", *order).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
    writer.partitionBy("shelf").parquet(path)


def write_index(
    rows: DataFrame, path: str, columns: tuple[str, ...] = SEARCHED, key: str = "id", block: int = BLOCK, shelf: int = SHELF,
    partitions: int | None = None,
) -> None:
    """Write the rows and their postings. ``shelf`` must be a multiple of ``block``."""
    if shelf % block:
        raise ValueError("a shelf holds whole blocks")
    shelved = rows.withColumn("shelf", F.floor(F.col(key) / shelf))
    by = F.col("shelf"), F.col(key)
    _written(shelved.repartitionByRange(partitions, *by) if partitions else shelved.repartitionByRange(*by), f"{path}/rows", key)
    # no exchange by ranges: its sample of the keys would make all postings once more
    found = postings(rows, columns, key, block, shelf)
    _written(found.coalesce(partitions) if partitions else found, f"{path}/postings", "gram", "block")


def refresh(
    rows: DataFrame, changed: DataFrame, path: str, columns: tuple[str, ...] = SEARCHED, key: str = "id",
    block: int = BLOCK, shelf: int = SHELF,
) -> None:
    """Put the shelves of changed ids right from the catalogue as it is now; a shelf without rows goes."""
    spark = rows.sparkSession
    shelves = changed.select(F.floor(F.col(key) / shelf).alias("shelf")).distinct()
    touched = rows.withColumn("shelf", F.floor(F.col(key) / shelf)).join(F.broadcast(shelves), "shelf", "left_semi")
    write_index(touched.drop("shelf"), path, columns, key, block, shelf)
    for empty in shelves.join(touched.select("shelf").distinct(), "shelf", "left_anti").collect():
        for part in ("rows", "postings"):
            remove(spark, f"{path}/{part}/shelf={empty.shelf}")


def pattern_grams(spark: SparkSession, pattern: str) -> list[str]:
    """The trigrams that every match must hold, split as the index does; as many as the pattern has letters at most."""
    pieces = [p for p in pattern.replace("_", "%").split("%") if p]
    if not pieces:
        return []
    parts = spark.createDataFrame([(p,) for p in pieces], "piece string")
    return sorted({g for r in with_grams(parts, ["piece"]).select("grams").collect() for g in r.grams})


def candidates(spark: SparkSession, path: str, grams: list[str]) -> DataFrame:
    """(shelf, id) of the rows that hold every trigram."""
    found = spark.read.parquet(f"{path}/postings").where(F.col("gram").isin(grams))
    # one short list per trigram and block
    lists = found.groupBy("shelf", "block").agg(F.collect_list("ids").alias("lists"))
    both = F.aggregate(F.slice("lists", 2, len(grams)), F.col("lists")[0], F.array_intersect)
    return lists.where(F.size("lists") == len(grams)).select("shelf", F.explode(both).alias("id"))


def indexed_rows(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    reader = spark.read
    if schema:
        reader = reader.schema(T.StructType([*schema.fields, T.StructField("shelf", T.LongType())]))
    return reader.parquet(f"{path}/rows")


def search(
    spark: SparkSession, path: str, pattern: str, columns: tuple[str, ...] = SEARCHED, key: str = "id",
) -> DataFrame:
    """Rows whose columns match the pattern, with all their columns: what ``search_condition`` finds by a scan."""
    rows = indexed_rows(spark, path)
    grams = pattern_grams(spark, pattern)
    if grams:
        found = candidates(spark, path, grams)
        shelves = found.select("shelf").distinct()
        rows = rows.join(F.broadcast(shelves), "shelf", "left_semi")
        rows = rows.join(found.select(F.col("id").alias("_id")), F.col(key) == F.col("_id"), "left_semi")
    return rows.where(search_condition(pattern, columns)).drop("shelf")


def search_all(spark: SparkSession, path: str, patterns: DataFrame, columns: tuple[str, ...] = SEARCHED, key: str = "id") -> DataFrame:
    """(pattern, id) for a whole table of patterns, column ``pattern``, in one job.

    A pattern whose longest piece has room for one of the ``ANCHORS`` meets the index's rows by the rarest anchor of that piece, so that a long
    pattern, such as a number, meets the few rows that hold it. The others meet them through the postings: the lists of a pattern's
    trigrams, of bounded length, are intersected block by block. What is met is held against the pattern itself. A pattern without
    trigrams is refused with an error; search for it by a scan.
    """
    lowered = F.lower("piece")
    pieces = patterns.select("pattern").distinct().withColumn("piece", F.explode(F.split("pattern", "[%_]"))).withColumn("piece", lowered)
    longest = pieces.groupBy("pattern").agg(F.max_by("piece", F.struct(F.length("piece"), "piece")).alias("longest"))
    texts = indexed_rows(spark, path).select(key, *columns)
    short = longest.where(F.coalesce(F.length("longest"), F.lit(0)) < ANCHORS[0]).select("pattern")
    hits = _by_lists(spark, path, short, key).unionByName(_by_anchors(texts, longest.where(F.length("longest") >= ANCHORS[0]), columns, key))
    matched = [F.expr(f"{c} ILIKE concat('%', replace(pattern, '\\\\', '\\\\\\\\'), '%')") for c in columns]
    return hits.join(texts, key).where(reduce(Column.__or__, matched)).select("pattern", key)


def _by_lists(spark: SparkSession, path: str, patterns: DataFrame, key: str) -> DataFrame:
    """(pattern, id) of the rows that hold every trigram of the pattern."""
    pieces = patterns.withColumn("piece", F.explode(F.split("pattern", "[%_]")))
    wanted = with_grams(pieces, ["piece"]).groupBy("pattern").agg(F.array_distinct(F.flatten(F.collect_list("grams"))).alias("grams"))
    wanted = wanted.withColumn("wanted", F.size("grams"))
    checked = F.when(F.col("wanted") > 0, F.col("grams")).otherwise(F.raise_error(F.concat(F.lit("no trigram in "), "pattern")))
    wanted = wanted.select("pattern", "wanted", F.explode(checked).alias("gram"))
    found = wanted.join(spark.read.parquet(f"{path}/postings"), "gram").groupBy("pattern", "wanted", "block").agg(F.collect_list("ids").alias("lists"))
    both = F.aggregate(F.slice("lists", F.lit(2), F.size("lists")), F.col("lists")[0], F.array_intersect)
    return found.where(F.size("lists") == F.col("wanted")).select("pattern", F.explode(both).alias(key))


def _by_anchors(texts: DataFrame, patterns: DataFrame, columns: tuple[str, ...], key: str) -> DataFrame:
    """(pattern, id) of the rows that hold the rarest anchor of the pattern's longest piece."""
    fits = F.array_max(F.filter(F.array(*map(F.lit, ANCHORS)), lambda n: n <= F.length("longest")))
    asked = patterns.withColumn("size", fits)
    sizes = sorted(r["size"] for r in asked.select("size").distinct().collect())  # as many as ``ANCHORS`` at most
    wanted = [each_gram(with_grams(asked.where(F.col("size") == n), ["longest"], sizes=(n,)), "pattern", out="anchor") for n in sizes]
    wanted = reduce(DataFrame.unionByName, wanted, patterns.select("pattern", F.col("longest").alias("anchor")).limit(0))
    held = each_gram(with_grams(texts, columns, sizes=sizes or ANCHORS), key, out="anchor").withColumn(key, F.col(key).cast("bigint"))
    held = held.join(wanted.select("anchor").distinct(), "anchor", "left_semi")
    counts = held.groupBy("anchor").agg(F.count("*").alias("n"))
    # a pattern with an anchor that no row holds matches nothing
    rarest = wanted.join(counts, "anchor", "left").groupBy("pattern").agg(
        F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "anchor")).alias("rarest")
    ).where("rarest.n > 0")
    return rarest.select("pattern", F.col("rarest.anchor").alias("anchor")).join(held, "anchor").select("pattern", key).distinct()
