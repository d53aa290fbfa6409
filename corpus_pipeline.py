"""The corpus pipeline: language identification, near-duplicate removal, benchmark decontamination, pseudonyms, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of docs. `run` writes each
stage's result as Parquet in the shared folder, reads it again for the next, and removes it when that has been written.

Edge cases, of every stage: rows that share a doc_id are decided together (all go if one is rejected, contaminated, or not the
first of its group); a row with a null doc_id is never removed; null and empty texts are rejected by the first stage and kept by the
others; texts are whole; an empty table gives an empty one; extra columns of any name pass through unchanged.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandloom.llm import decontaminate, language_id, near_dedup, packing, pii
from strandloom.llm.common import dropped, table, unused, written


def _without(docs: DataFrame, out: DataFrame) -> DataFrame:
    """docs without the rows whose doc_id is in out(doc_id)."""
    gone = unused("gone_id", docs)
    ids = out.select(F.col("doc_id").alias(gone)).where(F.col(gone).isNotNull()).distinct()
    return docs.join(ids, F.col("doc_id") == F.col(gone), "left_anti")


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is not rejected."""
    model = language_id.train(language_id.learned_from(docs))
    return _without(docs, language_id.predict(docs, model).where("rejected"))


def remove_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first document of each group of near duplicates (five-word shingles, a similarity of 0.8)."""
    return _without(docs, near_dedup.near_duplicates(docs, 5, 80, 100).where("not kept"))


def remove_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return _without(docs, decontaminate.contaminated(docs, table(spark, sf_dir, "benchmark")))


def replace_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with pseudonyms; n_chars is counted anew where there is one."""
    count = unused("n_replaced", docs)
    out = pii.pseudonymise(docs, "text", count)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col(count) > 0, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return out.select(*[F.col(f"`{c}`") for c in docs.columns])


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The packed pieces of all documents."""
    import public_tokenizers

    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
STAGES: list[tuple[str, Stage]] = [
    ("language_id", identify_language),
    ("near_dedup", remove_near_duplicates),
    ("decontaminate", remove_contaminated),
    ("pii", replace_personal_data),
    ("packing", pack),
]
#: SQL can't express the stages; tests/llm/test_pipeline.py holds them against brute-force versions and their effects.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = table(spark, sf_dir, "documents"), []
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
        dropped(*before)
        before = [docs]
    return STAGES[-1][1](spark, docs, sf_dir)
