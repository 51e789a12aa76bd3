"""I-Match fingerprints over randomised lexicon subsets, by DataFrame operations only.

A text's terms are its distinct lower-cased words of letters and digits. The lexicon holds the terms whose inverse document
frequency lies in a band: in ``COMMONEST`` of all documents at most and in ``RAREST`` of them at least; others are ignored. At scale
``e`` the lexicon is dealt at random, by a hash of the term, to ``SUBSETS * 2^e`` subsets, of which the first ``SUBSETS`` are used. For
each of them that a text has terms of, the sorted distinct terms are hashed; these entries (scale, subset, hash) make the
fingerprint. A text is printed at two neighbouring scales that suit its number of terms, so that a subset holds about one or two
of them whatever the text's length.

The likeness of two fingerprints is the share of equal hashes among the subsets, at the scales that both have, for which at
least one has an entry. Texts whose numbers of terms differ by a factor of four or more may have no scale in common: likeness 0.

At scale: a term's subsets follow from its hash alone, so only terms of used subsets are ever taken apart to rows. Terms are
counted by partial sums. A lexicon holds at most (terms per document) / RAREST terms, whatever the number of documents; it is broadcast
if its counted size is at most ``BROADCAST_TERMS``, else joined by a shuffle. Texts are dealt out once, by a key of one document.

Defined results: a null text is an empty one; a text without lexicon terms in its subsets is printed by a hash of its characters,
so it is like equal texts only; in the order of ids nulls come last, and rows of one id by a hash of their texts; repeated rows
(same id and text) have one place in that order and the same result each; an only document is its own next one; an empty table gives
an empty one; only the id and text columns are read, so clashing names do no harm.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from stallwise.llm import common

#: What stands between terms: ASCII characters but digits and small letters (texts are lower-cased first).
GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
RAREST, COMMONEST = 1 / 2000, 1 / 4
#: Subsets used at each scale, at most 256 (two digits in an entry).
SUBSETS = 64
#: At a text's lower scale its subsets hold at most this many of its terms on average, at the next one half as many.
TERMS_A_SUBSET = 2
BROADCAST_TERMS = 1 << 21
KEY = ["_id", "_print"]


def terms(text: Column) -> Column:
    """Hashes of a text's distinct terms."""
    words = F.split(F.lower(F.coalesce(text, F.lit(""))), GAP)
    return F.transform(F.array_remove(F.array_distinct(words), ""), lambda w: F.xxhash64(w))


def lexicon(
    spark: SparkSession, docs: DataFrame, text: str = "text", rarest: float = RAREST, commonest: float = COMMONEST
) -> DataFrame:
    """Hashes ``term`` of the terms in the band, over all documents."""
    counts = docs.select(F.explode(terms(F.col(text))).alias("term")).groupBy("term").agg(F.count("*").alias("n"))
    total = docs.count()
    band = F.col("n").between(total * rarest, max(1.0, total * commonest))
    return common.written(spark, counts.where(band).select("term"), "lexicon")


def scale(n: Column) -> Column:
    """The lower of the two scales of a text with so many terms."""
    return F.greatest(F.lit(0), F.floor(F.log2(F.greatest(n, F.lit(1)) * (2 / (SUBSETS * TERMS_A_SUBSET))))).cast("int")


def subsets_at(e: Column) -> Column:
    """How many subsets the lexicon is dealt to at a scale; a term's is its hash modulo that number."""
    return F.pow(F.lit(2.0), e).cast("bigint") * SUBSETS


# A lambda works out anew, for every element, whatever it uses that is not a column; so intermediate arrays become columns,
# and are used more than once, which keeps the optimizer from putting them back.


def with_entries(df: DataFrame, prints: list[tuple[str, Column, Column, Column]]) -> DataFrame:
    """Append columns of entries at one scale: (name, the scale, its number of subsets, sorted lexicon terms) of each."""
    for name, e, subsets, kept in prints:
        df = df.withColumn(f"{name}_scale", F.lpad(F.hex(e), 2, "0"))
        dealt = F.transform(kept, lambda t: F.struct(F.pmod(t, subsets).alias("k"), t.alias("t")))
        df = df.withColumn(f"{name}_dealt", F.array_sort(F.filter(dealt, lambda x: x.k < SUBSETS)))
    for name, *_ in prints:
        dealt = F.col(f"{name}_dealt")
        first = F.filter(
            F.sequence(F.lit(0), F.size(dealt) - 1), lambda i: (i == 0) | (F.get(dealt, i).k != F.get(dealt, i - 1).k)
        )
        df = df.withColumn(f"{name}_first", F.when(F.size(dealt) > 0, first).otherwise(F.array().cast("array<int>")))
    for name, *_ in prints:
        dealt, first = F.col(f"{name}_dealt"), F.col(f"{name}_first")

        def entry(at: Column, number: Column) -> Column:
            until = F.coalesce(F.get(first, number + 1), F.size(dealt))
            own = F.transform(F.slice(dealt, at + 1, until - at), lambda x: x.t)
            subset = F.lpad(F.hex(F.get(dealt, at).k), 2, "0")
            return F.concat(F.col(f"{name}_scale"), subset, F.lpad(F.hex(F.pmod(F.xxhash64(own), 1 << 32)), 8, "0"))

        df = df.withColumn(name, F.transform(first, entry))
    return df.drop(*(f"{name}_{x}" for name, *_ in prints for x in ("scale", "dealt", "first")))


def with_likeness(df: DataFrame, pairs: dict[str, tuple[str, str]]) -> DataFrame:
    """Append, for each pair of fingerprint columns, equal entries over subsets with an entry on either side, at common scales."""

    def heads(entries: Column, n: int) -> Column:
        return F.array_distinct(F.transform(entries, lambda v: F.left(v, F.lit(n))))

    for out, (one, other) in pairs.items():
        a, b = F.col(f"_{out}_a"), F.col(f"_{out}_b")
        df = df.withColumns({f"_{out}_a": F.split(one, " "), f"_{out}_b": F.split(other, " ")})
        scales = F.col(f"_{out}_scales")
        df = df.withColumn(f"_{out}_scales", F.array_intersect(heads(a, 2), heads(b, 2)))
        subsets = F.filter(F.array_union(heads(a, 4), heads(b, 4)), lambda v: F.array_contains(scales, F.left(v, F.lit(2))))
        df = df.withColumn(f"_{out}_n", F.when(F.size(scales) > 0, F.size(subsets)).otherwise(0))
        share = F.size(F.array_intersect(a, b)) / F.col(f"_{out}_n")
        df = df.withColumn(out, F.when(F.col(f"_{out}_n") > 0, share).otherwise(0.0))
    return df.drop(*(f"_{out}_{x}" for out in pairs for x in ("a", "b", "scales", "n")))


def fingerprints(docs: DataFrame, lex: DataFrame, keys: list[str], texts: dict[str, str]) -> DataFrame:
    """One row per key with a fingerprint of each text: ``texts`` maps new columns to text columns; other columns stay.

    The keys tell all rows apart. No shuffle where the rows are already dealt out by them.
    """
    lex = lex.withColumn("_known", F.lit(True))
    if lex.count() <= BROADCAST_TERMS:
        lex = F.broadcast(lex)
    stay = [c for c in docs.columns if c not in {*keys, *texts, *texts.values()}]
    sides = range(len(texts))
    found = [terms(F.col(c)).alias(f"_found{i}") for i, c in enumerate(texts.values())]
    own = [F.left(F.sha2(F.coalesce(c, F.lit("")), 256), F.lit(32)).alias(f"_own{i}") for i, c in enumerate(texts.values())]
    sized = docs.select(*keys, *stay, *found, *own)
    sized = sized.withColumns({f"_scale{i}": scale(F.size(f"_found{i}")) for i in sides})
    sized = sized.withColumns({f"_all{i}": subsets_at(F.col(f"_scale{i}")) for i in sides})
    # one row for the document itself, then one for each term of a used subset; the next scale's subsets are among them
    about = F.struct(*stay, *(f"{c}{i}" for i in sides for c in ("_own", "_scale", "_all")))
    none = F.lit(None)
    rows = [F.array(F.struct(F.lit(-1).alias("side"), none.cast("bigint").alias("term"), about.alias("about")))]
    for i in sides:
        rows.append(_term_rows(i, F.when(F.lit(False), about)))
    exploded = sized.select(*keys, F.explode(F.concat(*rows)).alias("_row")).select(*keys, "_row.*")
    known = exploded.join(lex, "term", "left").where(F.col("_known") | (F.col("side") < 0))
    kept = known.groupBy(*keys).agg(F.first("about", ignorenulls=True).alias("_about"), *(
        F.array_sort(F.collect_set(F.when(F.col("side") == i, F.col("term")))).alias(f"_kept{i}") for i in sides
    ))
    marked = with_entries(kept, [
        (f"_entries{i}{step}", F.col(f"_about._scale{i}") + step, F.col(f"_about._all{i}") * (1 + step), F.col(f"_kept{i}"))
        for i in sides for step in (0, 1)
    ])

    def printed(i: int) -> Column:
        entries = F.array_join(F.concat(f"_entries{i}0", f"_entries{i}1"), " ")
        nothing = (F.size(f"_entries{i}0") == 0) & (F.size(f"_entries{i}1") == 0)
        return F.when(nothing, F.concat(F.lit("===="), F.col(f"_about._own{i}"))).otherwise(entries)

    return marked.select(*keys, *(F.col(f"_about.{c}") for c in stay), *(printed(i).alias(c) for i, c in enumerate(texts)))


def _term_rows(i: int, no_about: Column) -> Column:
    used = F.filter(F.col(f"_found{i}"), lambda t: F.pmod(t, F.col(f"_all{i}")) < SUBSETS)
    return F.transform(used, lambda t: F.struct(F.lit(i).alias("side"), t.alias("term"), no_about.alias("about")))


def successors(spark: SparkSession, rows: DataFrame, order: list[Column]) -> DataFrame:
    """Each row's key (``KEY``) with that of the next one, ``_next_id`` and ``_next_print``; the first comes after the last.

    The rows are sorted over ranges and written with their places; only the last row of a range has to look for the next range,
    in a table of one row per range.
    """
    placed = common.written(spark, rows.orderBy(*order).withColumn("_row", F.monotonically_increasing_id()), "places")
    ranges = placed.groupBy(F.shiftright("_row", 33).alias("_range")).agg(F.min("_row").alias("_first"), F.max("_row").alias("_row"))
    following = F.lead("_first").over(Window.orderBy("_range"))
    ranges = ranges.select("_row", F.coalesce(following, F.min("_first").over(Window.partitionBy())).alias("_after"))
    linked = placed.join(ranges, "_row", "left").withColumn("_after", F.coalesce("_after", F.col("_row") + 1))
    target = placed.select(F.col("_row").alias("_after"), *(F.col(c).alias(f"_next{c}") for c in KEY))
    return linked.join(target, "_after").drop("_row", "_after")


def edited(spark: SparkSession, docs: DataFrame, key: str = "doc_id", text: str = "text", share: int = 4) -> DataFrame:
    """Each distinct document (``KEY``) with its ``text``, ``n_chars``, ``edited`` text and the key of the next document.

    In the edited text the last ``floor(n_chars / share)`` characters are the first as many, or all, of the next document.
    """
    unique = keyed(docs, key, text).dropDuplicates(KEY)
    light = unique.select(*KEY, "_key", F.length("text").alias("n_chars"))
    links = successors(spark, light, [F.col("_key").asc_nulls_last(), F.col("_print")])
    links = common.written(spark, links.withColumn("_cut", F.floor(F.col("n_chars") / share).cast("int")), "links")
    given = links.select(F.col("_next_id").alias("_id"), F.col("_next_print").alias("_print"), "_cut", *(F.col(c).alias(f"_of{c}") for c in KEY))
    pieces = unique.select(*KEY, "text").join(given, KEY).select(
        F.col("_of_id").alias("_id"), F.col("_of_print").alias("_print"), F.expr("substring(text, 1, _cut)").alias("_piece")
    )
    whole = unique.select(*KEY, "text").join(links.drop("_key"), KEY).join(pieces, KEY)
    return whole.select(
        *KEY, "text", "n_chars", "_next_id", "_next_print",
        F.expr("concat(substring(text, 1, n_chars - _cut), _piece)").alias("edited"),
    )


def keyed(docs: DataFrame, key: str, text: str) -> DataFrame:
    """The key and text columns, with two never null columns that tell documents apart."""
    whole = F.coalesce(F.col(text), F.lit(""))
    return docs.select(
        F.coalesce(F.col(key).cast("bigint"), F.lit(0)).alias("_id"), F.xxhash64(whole, F.col(key).isNull()).alias("_print"),
        F.col(key).alias("_key"), whole.alias("text"),
    )


def compared(spark: SparkSession, docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Every document with the prints of its text and its edited text, and how like they and the next document's are."""
    lex = lexicon(spark, docs, text)
    pairs = edited(spark, docs, key, text).withColumn("edited_sha256", F.sha2("edited", 256))
    prints = fingerprints(pairs, lex, KEY, {"fingerprint": "text", "edited_fingerprint": "edited"})
    prints = common.written(spark, prints, "prints")
    following = prints.select(*(F.col(c).alias(f"_next{c}") for c in KEY), F.col("fingerprint").alias("_next_fingerprint"))
    results = with_likeness(prints.join(following, ["_next_id", "_next_print"]), {
        "near_edited": ("fingerprint", "edited_fingerprint"), "near_next": ("fingerprint", "_next_fingerprint"),
    }).drop("_next_fingerprint", "_next_id", "_next_print")
    rows = keyed(docs, key, text).select(*KEY, F.col("_key").alias(key))
    return rows.join(results, KEY).drop(*KEY)
