"""URL filters: rule lists first, then a tree of path templates per host, by DataFrame operations only.

A path's segments are generalised in three steps, and each step works on a table of counted templates, not on pages:

1. by form: runs of digits, hexadecimal strings and UUIDs become ``{n}``, ``{h}`` and ``{u}``; if a ``depth`` is asked for, segments from
   that one on are one wildcard ``**``;
2. by variety: where a branch has more than ``WIDE`` different next segments with fewer than ``RARE`` pages each, they become ``*``;
3. by statistics: templates that differ in one segment only, and whose labelled share of bad pages does not differ from their
   common share (two-sided z-test), are merged (``~`` stands in that segment); from the last segment up.

A template is rejected if its purity, the share of good labelled pages smoothed towards its host's and that towards the share
overall, falls below ``cut``. Templates without labels have the smoothed share of their host.

Steps 2 and 3 go as deep as two forms of one host do: below that there is no variety and nothing to merge. Each level costs two rounds.

Defined results: a null url, or one without ``://``, has an empty host and an empty path, and its own template like any other;
repeated urls count as often as they come. Without labels every page is allowed unless a rule blocks it.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from stallwise.llm import common

ALLOW, BLOCK = "allow", "block"
WIDE, RARE = 20, 3
Z, STRENGTH, CUT = 1.96, 10.0, 0.5
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class Rule:
    """``verdict`` for a host, its subdomains, and the paths that start with ``path``."""

    verdict: str
    host: str
    path: str

    @property
    def text(self) -> str:
        return self.host + self.path

    def fits(self) -> Column:
        host = F.col("host")
        return ((host == self.host) | host.endswith("." + self.host)) & F.col("path").startswith(self.path)


def parsed(pages: DataFrame, url: str = "url") -> DataFrame:
    """Pages with host and path in place of columns of these names."""
    rest = F.when(F.col(url).contains("://"), F.expr(f"substring(`{url}`, locate('://', `{url}`) + 3)")).otherwise("")
    return pages.withColumns({
        "host": F.translate(F.regexp_extract(F.coalesce(rest, F.lit("")), r"^([^/?#]*)", 1), UPPER, LOWER),
        "path": F.regexp_extract(F.coalesce(rest, F.lit("")), r"^[^/?#]*([^?#]*)", 1),
    })


def ruled(pages: DataFrame, rules: list[Rule]) -> DataFrame:
    """Parsed pages with the longest fitting rule and its verdict, or nulls; of equally long ones the first counts."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for r in sorted(rules, key=lambda r: len(r.text), reverse=True)[::-1]:
        rule, verdict = F.when(r.fits(), r.text).otherwise(rule), F.when(r.fits(), r.verdict).otherwise(verdict)
    return pages.withColumns({"rule": rule, "ruled": verdict})


def form(path: Column, depth: int | None = None) -> Column:
    """The path with variable forms named, and with a ``depth`` what is below it as a wildcard."""
    named = F.regexp_replace(path, r"(?i)\b[0-9a-f]{8}(?:-[0-9a-f]{4}){3}-[0-9a-f]{12}\b", "{u}")
    named = F.regexp_replace(named, r"(?i)(?<![0-9a-z{])(?=[a-f]*[0-9])[0-9a-f]{8,}(?![0-9a-z}])", "{h}")
    named = F.regexp_replace(named, r"[0-9]+", "{n}")
    return named if depth is None else F.regexp_replace(named, rf"^((?:/[^/]*){{{depth}}})/.*$", "$1/**")


def _segment(level: int) -> Column:
    return F.get("segments", F.lit(level))


def _replaced(level: int, by: Column) -> Column:
    return F.transform("segments", lambda s, i: F.when(i == level, by).otherwise(s))


def templates(
    spark: SparkSession, pages: DataFrame, *, strength: float = STRENGTH, cut: float = CUT
) -> DataFrame:
    """(host, form, template, purity, rejected) from pages (host, form, bad); ``bad`` is null where a page has no label."""
    counted = pages.groupBy("host", "form").agg(
        F.count("*").alias("n"), F.count("bad").alias("labelled"), F.coalesce(F.sum("bad"), F.lit(0)).alias("bad")
    ).withColumn("segments", F.split("form", "/"))
    counted = common.written(spark, counted, "url-forms")
    # one row for each host and number of segments
    sizes = counted.groupBy("host", F.size("segments").alias("size")).agg(F.count("*").alias("forms"))
    as_deep = F.sum("forms").over(Window.partitionBy("host").orderBy(F.desc("size")))
    levels = sizes.withColumn("as_deep", as_deep).where("as_deep > 1").agg(F.max("size")).first()[0] or 0
    for level in range(1, levels):
        branch = ["host", "prefix"]
        rows = counted.withColumn("prefix", F.concat_ws("/", F.slice("segments", 1, level)))
        children = rows.where(_segment(level).isNotNull()).groupBy(*branch, _segment(level).alias("s")).agg(F.sum("n").alias("n"))
        wide = children.groupBy(*branch).agg(F.count("*").alias("kinds"), F.sum("n").alias("pages")).where(
            (F.col("kinds") > WIDE) & (F.col("pages") < RARE * F.col("kinds"))
        )
        counted = common.written(
            spark,
            rows.join(wide.select(*branch, F.lit(True).alias("wide")), branch, "left")
            .withColumn("segments", F.when(F.col("wide"), _replaced(level, F.lit("*"))).otherwise(F.col("segments")))
            .drop("prefix", "wide"),
            "url-forms",
        )
    for level in range(levels - 1, 0, -1):
        # templates as they are now, and those that differ from them in this segment only
        rows = counted.withColumn("now", F.concat_ws("/", "segments")).withColumn(
            "others", F.concat_ws("/", _replaced(level, F.lit("~")))
        )
        one = rows.groupBy("host", "others", "now").agg(F.sum("labelled").alias("m"), F.sum("bad").alias("b"))
        together = one.groupBy("host", "others").agg(
            F.sum("m").alias("all_m"), F.sum("b").alias("all_b"), F.count("*").alias("kinds")
        ).where("kinds > 1")
        share = F.col("all_b") / F.col("all_m")
        away = F.abs(F.col("b") - F.col("m") * share)
        similar = one.join(together, ["host", "others"]).where(
            (F.col("m") == 0) | (away <= Z * F.sqrt(F.col("m") * share * (1 - share)) + 1e-9)
        ).select("host", "now", F.lit(True).alias("similar"))
        counted = common.written(
            spark,
            rows.join(similar, ["host", "now"], "left")
            .withColumn("segments", F.when(F.col("similar"), _replaced(level, F.lit("~"))).otherwise(F.col("segments")))
            .drop("now", "others", "similar"),
            "url-forms",
        )
    named = counted.withColumn("template", F.concat_ws("/", "segments"))
    overall = named.agg(F.sum("bad").alias("b"), F.sum("labelled").alias("m")).first()
    prior = ((overall["b"] or 0) + 0.5) / ((overall["m"] or 0) + 2.0)
    hosts = named.groupBy("host").agg(
        ((F.sum("bad") + strength * prior) / (F.sum("labelled") + strength)).alias("host_share")
    )
    judged = (
        named.groupBy("host", "template").agg(F.sum("bad").alias("b"), F.sum("labelled").alias("m"))
        .join(hosts, "host")
        .select("host", "template", (1 - (F.col("b") + strength * F.col("host_share")) / (F.col("m") + strength)).alias("purity"))
    )
    return named.select("host", "form", "template").join(judged, ["host", "template"]).withColumn(
        "rejected", F.col("purity") < cut
    )


def judge(
    spark: SparkSession, pages: DataFrame, labels: DataFrame, rules: list[Rule], *, url: str = "url", page_key: str = "doc_id",
    label_key: str = "doc_id", bad: str = "bad", depth: int | None = None, strength: float = STRENGTH, cut: float = CUT,
) -> DataFrame:
    """Every page with host, path, rule, template, purity and verdict (columns of these names are replaced).

    ``labels`` has a row (``label_key``, ``bad`` 0 or 1) for some values of ``page_key``; several rows of one key count as their
    greatest, null keys and labels not at all.
    """
    known = labels.where(F.col(label_key).isNotNull() & F.col(bad).isNotNull()).groupBy(F.col(label_key).alias("_key")).agg(
        F.max(F.col(bad).cast("int")).alias("_bad")
    )
    made = ["host", "path", "rule", "template", "purity", "verdict"]
    stays = [c for c in pages.columns if c.lower() not in made]
    # the input's columns go along in a struct, away from the helpers
    own = pages.select(F.struct(*stays).alias("own"), F.col(url).alias("url"), F.col(page_key).alias("key"))
    rows = ruled(parsed(own, "url"), rules).withColumn("form", form(F.col("path"), depth))
    counted = rows.select("host", "form", F.col("key").alias("_key")).join(known, "_key", "left")
    tree = templates(spark, counted.select("host", "form", F.col("_bad").alias("bad")), strength=strength, cut=cut)
    method = F.when(F.col("rejected"), BLOCK).otherwise(ALLOW)
    return rows.join(tree, ["host", "form"], "left").withColumn("verdict", F.coalesce("ruled", method)).select("own.*", *made)
