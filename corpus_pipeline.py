"""A corpus pipeline of five stages over ``documents``.

Toxic documents go; of each group of near duplicates one stays; documents that
overlap the benchmark go; secrets are masked; then sources are mixed to target
weights. Each stage's function takes ``(spark, docs, sf_dir)``; all but the
last return the columns of ``docs``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paramscan.llm import decontaminate, secret_dfa, simhash_mih, toxicity_subword, wfq_mix
from paramscan.llm.common import checkpoint, discard, key_mod, table, unused


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents whose toxicity score is 0.5 or more. Null and empty texts stay unless the bias alone rejects them."""
    # learned from the whole labelled table, apart from the rows held out for measuring
    learnable = key_mod(F.col("doc_id"), 5) != 0
    model = toxicity_subword.fit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), learnable)
    (score,) = unused(docs, "toxicity")
    return toxicity_subword.with_score(docs, model, out=score).filter(F.col(score) < 0.5).drop(score)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, that with the least doc_id."""
    return simhash_mih.keep_one(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that overlap an item of ``benchmark``."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, secrets masked in ``text`` and ``n_chars``, if there, set anew where that changed it."""
    (before,) = unused(docs, "length")
    masked = secret_dfa.redact(docs.withColumn(before, F.length("text")))
    if "n_chars" in docs.columns:
        changed = F.length("text") != F.col(before)
        masked = masked.withColumn("n_chars", F.when(changed, F.length("text")).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType))
    return masked.drop(before)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix: doc_id, size, source_size, target, and the words taken of each document, repeats counted."""
    return wfq_mix.mix(docs)


STAGES = [("toxicity", toxicity), ("near_duplicates", near_duplicates), ("decontamination", decontamination), ("secrets", secrets), ("mixing", mixing)]

#: SQL can't express the trained classifier and the fingerprints' hash; tests use brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``. Stages read their input more than once, so each result but the last is written to the checkpoint folder."""
    docs = table(spark, sf_dir, "documents")
    written = None
    for _, stage in STAGES[:-1]:
        before, written = written, checkpoint(stage(spark, docs if written is None else written, sf_dir))
        if before is not None:
            discard(before)
    return STAGES[-1][1](spark, docs if written is None else written, sf_dir)
