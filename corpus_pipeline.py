"""From raw documents to token ids: language, near duplicates, personal data, mixture, encoding."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from telemetry_ops.functions.session import broadcast_if_small, stage
from telemetry_ops.llm import crf, mixing, ngram_join, sanitise, tokens
from telemetry_ops.llm.text import table

#: Mean marginal of a text's language below which the text is rejected, with all texts without a word.
LEAST_LANGUAGE = 0.35


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects texts without a letter, null and empty ones among them, and texts of no clear language."""
    return crf.with_language(docs, crf.fit(docs), LEAST_LANGUAGE)


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the smallest id of each component of near duplicates.

    Texts without a word and rows without an id all stay; rows with one id are one document.
    """
    found = ngram_join.ngram_jaccard_join(docs)
    gone = stage(found.where("component_id <> doc_id").select("doc_id").distinct(), "near-duplicates")
    repeated = stage(docs.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").select("doc_id"), "repeated-ids")
    kept = docs.join(broadcast_if_small(gone, gone.count(), 16), "doc_id", "left_anti").select(*docs.columns)
    n = repeated.count()
    if not n:
        return kept
    repeated = broadcast_if_small(repeated, n, 16)
    once = kept.join(repeated, "doc_id", "left_semi").select(*docs.columns).dropDuplicates(["doc_id"])
    return kept.join(repeated, "doc_id", "left_anti").select(*docs.columns).unionByName(once)


def without_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces personal data and the terms that disclose it; ``n_chars`` follows the text."""
    clean = sanitise.sanitise(docs)
    size = F.length("text").cast(docs.schema["n_chars"].dataType) if "n_chars" in docs.columns else None
    return clean.select(*[size.alias(c) if c == "n_chars" else F.col(c) for c in docs.columns])


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Draws documents by their rates; those with a rate of 1 or more all stay."""
    return mixing.mixed(docs, table(spark, sf_dir, "labels"))


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return tokens.encode(docs)


STAGES = [
    ("language", known_language),
    ("near_duplicates", one_of_each_group),
    ("personal_data", without_personal_data),
    ("mixture", mixture),
    ("encoding", token_ids),
]

#: Learnt models and the search over pieces are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, step in STAGES[:-1]:
        docs = stage(step(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
