"""One query per operator, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from stallwise.llm import (
    brown, checks, common, decontamination, frames, imatch, language, mixing, neardup, periodic, pii, quality, rules, toxicity, urls,
)


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text")
    out = F.col("doc_id"), common.held_out(F.col("doc_id"), 3).alias("held_out")
    model = toxicity.fit(spark, docs.where(~out[1]), common.table(spark, sf_dir, "labels"))
    return toxicity.score(spark, docs, model).select(*out, "score", "predicted")


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text")
    out = common.held_out(F.col("doc_id"), 3)
    model = quality.fit(spark, docs.where(~out), common.table(spark, sf_dir, "labels"))
    graded = quality.grade(spark, docs, model)
    return graded.select("doc_id", out.alias("held_out"), "expected_grade", "tail_probability", "kept")


#: The rules of the query, longest wins.
URL_RULES = [
    urls.Rule("block", "net", "/"),
    urls.Rule("allow", "example.net", "/en/"),
    urls.Rule("block", "example.com", "/de/"),
    urls.Rule("allow", "org", "/fr/"),
]


def op3_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page is labelled by the document whose number ends its path; it is bad if that is of low quality or toxic."""
    pages = common.table(spark, sf_dir, "pages").select("page_id", "url")
    number = F.regexp_extract(F.coalesce("url", F.lit("")), r"/([0-9]{1,18})(?:\.[a-z]+)?/?(?:[?#].*)?$", 1)
    pages = pages.withColumn("document", F.when(number != "", number.cast("long")))
    bad = (F.col("quality") == 0) | (F.col("toxic") == 1)
    labels = common.table(spark, sf_dir, "labels").select("doc_id", bad.cast("int").alias("bad"))
    judged = urls.judge(spark, pages, labels, URL_RULES, page_key="document")
    return judged.select("page_id", "host", "path", "rule", "verdict", "template", "purity")


def op4_brown(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text")
    out = common.held_out(F.col("doc_id"), 5)
    return brown.cluster(spark, docs.withColumn("held_out", out), ~out)[2]


def op5_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(spark, common.table(spark, sf_dir, "documents"), width=2)


def op6_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    out = common.held_out(F.col("doc_id"), 3)
    model = language.fit(spark, docs.where(~out))
    found = language.identify(spark, docs.select("doc_id", "text"), model)
    return found.select("doc_id", out.alias("held_out"), "lang_pred", "score")


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text")
    return decontamination.decontaminated(spark, docs, common.table(spark, sf_dir, "benchmark")).drop("text")


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    return rules.judged(spark, docs).drop("lang")


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    taken = mixing.mixed(spark, common.table(spark, sf_dir, "documents"))
    return taken.select("doc_id", "size", "source_size", "target", "taken")


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find(common.table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text")


def repeating(docs: DataFrame) -> DataFrame:
    """Texts of which every tenth, by a hash of the id, repeats a stretch from some word to its end; the others as they are."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    words = F.array_remove(F.split("text", r"[\x20\x09-\x0D]+"), "")
    looped = F.expr("""array_join(transform(sequence(0, n - 1),
        i -> words[CAST(CASE WHEN i < a THEN i ELSE a + (i - a) % (1 + (n - a) div (3 + g % 8)) END AS INT)]), ' ')""")
    rows = docs.withColumn("g", F.floor(h / 10)).withColumn("words", F.when(h % 10 == 0, words)).withColumn("n", F.size("words"))
    rows = rows.withColumn("a", F.when(F.col("n") > 0, F.col("g") % F.col("n")))
    return rows.select("doc_id", F.when(F.col("n") > 0, looped).otherwise(F.col("text")).alias("text"))


def op11_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic.find(repeating(common.table(spark, sf_dir, "documents").select("doc_id", "text")))
    # the smallest of (-length, start, period) is the greatest run
    ranked = F.transform("runs", lambda r: F.struct(-r.length, r.start.alias("start"), r.period.alias("period"), r.length.alias("length")))
    lines = F.transform("runs", lambda r: F.concat_ws(",", r.start, r.length, r.period))
    found = found.withColumn("first", F.array_min(ranked))
    return found.select(
        "doc_id", F.size("runs").cast("bigint").alias("n_runs"), "first.start", "first.length", "first.period",
        F.floor(1000 * F.col("first.length") / F.col("first.period")).alias("exponent_milli"),
        F.sha2(F.array_join(F.transform(lines, lambda x: F.concat(x, F.lit("\n"))), ""), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


def op12_imatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = imatch.compared(spark, common.table(spark, sf_dir, "documents"))
    return found.select(
        "doc_id", F.col("n_chars").cast("bigint").alias("n_chars"), "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next",
    )


def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored = common.written(spark, frames.stored(common.table(spark, sf_dir, "documents").select("doc_id", "text")), "frames")
    back = frames.restored(frames.transformed(stored))
    return back.select("doc_id", "n", "form", "prefix_chars", "middle_chars", "output_sha256", "restored_sha256")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_toxicity": op1_toxicity,
    "op2_quality": op2_quality,
    "op3_url_filters": op3_url_filters,
    "op4_brown": op4_brown,
    "op5_minhash_dedup": op5_minhash_dedup,
    "op6_language": op6_language,
    "op7_decontamination": op7_decontamination,
    "op8_quality_rules": op8_quality_rules,
    "op9_mixing": op9_mixing,
    "op10_pii": op10_pii,
    "op11_runs": op11_runs,
    "op12_imatch": op12_imatch,
    "op13_fill_in_middle": op13_fill_in_middle,
}

#: DuckDB SQL for the queries that SQL can express.
CHECKS: dict[str, str] = {
    "op5_minhash_dedup": checks.MINHASH, "op7_decontamination": checks.DECONTAMINATION, "op13_fill_in_middle": checks.FILL_IN_MIDDLE,
}
