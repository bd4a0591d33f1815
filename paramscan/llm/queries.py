"""The registered queries of the corpus operators, and SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate, langid_gru, media_sniff, pii, quality_gam, secret_dfa, simhash_mih, token_counts, toxicity_subword, wfq_mix
from .common import key_mod, table


def _scored(scored: DataFrame, held_out, score: str) -> DataFrame:
    return scored.select("doc_id", held_out.alias("held_out"), F.col(score).alias("score"), (F.col(score) >= 0.5).cast("int").alias("predicted"))


def op1_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text stored as 8-bit audio and read back: sizes, digests and features; see ``media_sniff.report``.

    Null texts count as empty ones; an empty payload is one frame of spaces.
    Repeated rows have each its own, equal results; an empty table gives none.
    """
    return media_sniff.report(table(spark, sf_dir, "documents"))


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality scores of every text, learned from the labels of keys that aren't held out.

    Null, empty and blank texts are scored as texts whose features are all zero.
    Null keys count as empty text in ``held_out``. Without labels of both
    classes scores are constant. Rows stay as they are, repeated ones too.
    """
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    held_out = key_mod(F.col("doc_id"), 3) == 1
    model = quality_gam.fit(docs, table(spark, sf_dir, "labels"), ~held_out)
    return _scored(quality_gam.with_score(docs, model, out="quality_score"), held_out, "quality_score")


def op3_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mix of all documents by source; see ``wfq_mix.mix``. Null texts have no words, a null source is one of its own."""
    return wfq_mix.mix(table(spark, sf_dir, "documents"))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity scores of every text, learned from the labels of keys that aren't held out.

    Null, empty and blank texts have the score of the bias alone. Null keys
    count as empty text in ``held_out``. Without labels of both classes scores
    are constant. Rows stay as they are, repeated ones too.
    """
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    held_out = key_mod(F.col("doc_id"), 5) == 0
    model = toxicity_subword.fit(docs, table(spark, sf_dir, "labels"), ~held_out)
    return _scored(toxicity_subword.with_score(docs, model), held_out, "toxicity")


def op5_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every text, learned from the languages of keys that aren't held out; ``und`` for null texts and those without a letter.

    Null keys count as empty text in ``held_out``. If there is no language to
    learn, all are ``und``. Rows stay as they are, repeated ones too.
    """
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held_out = key_mod(F.col("doc_id"), 5) == 0
    net = langid_gru.fit(docs, ~held_out)
    found = langid_gru.with_language(docs.select("doc_id", "text"), net)
    return found.select("doc_id", held_out.alias("held_out"), "language.lang_pred", "language.score")


def op6_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets in every text; see ``secret_dfa.report``. Null texts count as empty ones; repeated rows have each its own, equal results."""
    return secret_dfa.report(table(spark, sf_dir, "documents"))


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in every text; see ``pii.report``. Null texts count as empty ones; repeated rows have each its own, equal results."""
    return pii.report(table(spark, sf_dir, "documents"))


def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that overlap an item of ``benchmark``, with the best window; see ``decontaminate.overlaps``.

    Null texts and items of fewer than five words overlap nothing. Rows with one
    key give one row an item, the better match.
    """
    return decontaminate.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pre-tokens and tokens of every text; 0 of both in null and empty ones. Repeated rows have each its own, equal counts."""
    return token_counts.report(table(spark, sf_dir, "documents"))


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and near-duplicate group of every document; see ``simhash_mih.near_duplicates``. Null, empty and blank texts share fingerprint zero."""
    return simhash_mih.near_duplicates(table(spark, sf_dir, "documents"))


QUERIES = {
    f.__name__: f
    for f in (op1_media, op2_quality, op3_mix_sources, op4_toxicity, op5_language, op6_secret_scan, op7_pii, op8_decontaminate, op9_token_counts, op10_simhash)
}
ORACLE_SQL = {"op3_mix_sources": wfq_mix.ORACLE, "op6_secret_scan": secret_dfa.ORACLE, "op7_pii": pii.ORACLE, "op8_decontaminate": decontaminate.ORACLE}
