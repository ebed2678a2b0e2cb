"""A training corpus from the documents table, in five stages.

Each stage takes (spark, docs, sf_dir), works on all that the one before kept, and returns the columns of documents; the last adds
token ids. The driver writes and rereads the rows between stages; `run` stores them in the shared folder instead.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from basketry.llm import common, mixing, near_dup, personal_data, quality, queries, word_table


def keep_clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and are more likely clean than junk."""
    return quality.filter_clean(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-copies: the one with the smallest doc_id."""
    return near_dup.one_of_each(docs)


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Emails, addresses, card and phone numbers become their kind in brackets; n_chars follows the text."""
    return personal_data.mask(docs, personal_data.fitted(docs))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as many times as its source's target takes it."""
    return mixing.mix(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with n_tokens and ids."""
    rows = word_table.encode(docs, queries.vocabulary_path())
    return rows.select(*docs.columns, F.size("ids").cast("long").alias("n_tokens"), "ids")


STAGES = [
    ("quality rules", keep_clean),
    ("near-duplicates", drop_near_copies),
    ("personal data", mask_personal_data),
    ("mixing", mix_sources),
    ("tokens", encode),
]

#: SQL expresses neither the fingerprints' components nor the tagger; tests hold the stages against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs if i == 0 else common.cut(docs), sf_dir)
    return docs
