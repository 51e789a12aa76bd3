"""A training corpus from raw documents, stage by stage; each stage reads the Parquet that the one before it wrote.

1. toxicity: documents predicted toxic go; labels are learned from two thirds of the labelled ids.
2. near-duplicates: of each component on 5-word shingles at 0.8 the document with the smallest id stays.
3. decontamination: documents of which a twentieth of the words lie in 13-word windows of benchmark items go.
4. personal data: found spans are replaced by their kind in brackets; ``n_chars`` follows the text.
5. mixing: the documents that the mix takes words of, with how many words it takes.

Null or repeated rows and clashing extra columns follow the operators' own rules; an empty table gives an empty one.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from stallwise.llm import common, decontamination, mixing, neardup, pii, toxicity


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    training = docs.where(~common.held_out(F.col("doc_id"), 3))
    model = toxicity.fit(spark, training, common.table(spark, sf_dir, "labels"))
    scored = toxicity.score(spark, docs, model, score_as="_score", predicted_as="_predicted", keep_clean=True)
    return scored.select(*docs.columns)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    found = neardup.near_duplicates(spark, docs, width=5)
    return docs.join(found.where(~F.col("kept")).select("doc_id"), "doc_id", "left_anti").select(*docs.columns)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    benchmark = common.table(spark, sf_dir, "benchmark")
    return decontamination.decontaminated(spark, docs, benchmark, keep_clean=True).select(*docs.columns)


def redact_personal(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pii.redact(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mix_documents(spark, docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_copies),
    ("decontamination", drop_contaminated),
    ("personal_data", redact_personal),
    ("mixing", mix),
]

#: The stages learn, hash and iterate; tests hold them against brute force instead.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = common.written(spark, stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
