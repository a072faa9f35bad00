"""From raw documents to packed training sequences, in five stages.

Each stage reads all rows its predecessor kept and acts on them: language ID drops
what it rejects, exact dedup and the n-gram join keep the smallest doc_id of each
group, the secret scan replaces every span in the text, packing lays out
the tokens and returns each piece with its ids and its place.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from docloom.llm import exact_dedup, language_id, ngram_join, packing, secret_scan
from docloom.llm.common import documents, shared
from docloom.llm.queries import tokenizer


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return language_id.keep_identified(docs, language_id.train(language_id.training_rows(docs)))


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact_dedup.deduplicate(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return ngram_join.representatives(docs)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return secret_scan.redact_documents(docs, secret_scan.train(docs))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack_documents(docs, tokenizer("word_bpe_49k.json"), with_ids=True)


STAGES = [
    ("language_id", identify_language),
    ("exact_dedup", drop_exact_copies),
    ("ngram_join", drop_near_copies),
    ("secret_scan", redact_secrets),
    ("packing", pack_sequences),
]

#: Character models, inferred automata and BPE are beyond SQL; tests hold each stage against brute force.
ORACLE_SQL = None


def sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in turn over ``documents``, each one's result written to the shared folder: pieces with ids and places."""
    docs = documents(spark, sf_dir)
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs if not k else shared(docs), sf_dir)
    return docs


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The places of ``sequences``, without the ids."""
    return sequences(spark, sf_dir).drop("ids")
