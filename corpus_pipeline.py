"""A training-data pipeline over the documents table.

Language ID, near-duplicate documents, repeated passages, secrets, packing.
Each stage takes the rows that its predecessor kept, decides on those alone,
and returns the columns of documents; the last returns packed pieces. Rows
with a null doc_id pass the joins by id unchanged; a null text is dropped by
the first stage, since it has no language.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ragscope.llm import langid, ngram_join, packing, secrets, substring
from ragscope.llm.common import documents, materialize

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: Below this a text's language is no better than a guess between two others.
LEAST_LANGUAGE_SCORE = 0.3


def _columns(docs: DataFrame) -> DataFrame:
    return docs.select(*COLUMNS)


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the texts without a recognisable language."""
    return langid.keep_recognised(_columns(docs), langid.fit(docs), LEAST_LANGUAGE_SCORE)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the smallest doc_id of each group of near copies."""
    docs = _columns(docs)
    found = ngram_join.near_duplicates(docs)
    gone = materialize(found.where("component_id <> doc_id").select("doc_id").distinct(), "copies")
    return docs.join(gone, "doc_id", "left_anti").select(*COLUMNS)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Removes passages of 50 words that an earlier document has, and the
    documents of which nothing is left."""
    out = substring.remove_repeats(_columns(docs)).where("n_removed = 0 OR kept <> ''")
    changed = F.col("n_removed") > 0
    return out.select("doc_id", F.when(changed, F.col("kept")).otherwise(F.col("text")).alias("text"), "lang", "source",
                      F.when(changed, F.length("kept")).otherwise(F.col("n_chars")).cast("long").alias("n_chars"))


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Masks every span that the secret scan reports; all documents stay."""
    return secrets.mask_documents(_columns(docs)).select(*COLUMNS)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of at most 1024 tokens."""
    return packing.digest(packing.pack(docs))


STAGES = [
    ("language_id", language_id),
    ("near_duplicates", near_duplicates),
    ("repeated_passages", repeated_passages),
    ("mask_secrets", mask_secrets),
    ("packing", pack),
]

#: A trained network and tokenisation are beyond SQL; tests hold run() against
#: a brute-force version instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table."""
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
