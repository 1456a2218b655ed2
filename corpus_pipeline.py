"""A training corpus in five stages: quality, near duplicates, benchmark leaks, personal data, tokens.

Each stage takes (spark, docs, sf_dir) and judges all rows that its predecessor kept. All but the last return the columns of
documents; the last returns the tokens of each text. Rows with null ids pass through. Rows are told apart by id and text: of rows equal in
both, the near-duplicate stage keeps the least by all columns, and a unique text stays whatever else has its id. Columns of documents
that are called like what an operator adds are kept as they are. Very long texts are judged whole, empty and null ones as the operators state.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dossier.llm import bpe, decontamination, jaccard, pii, quality
from dossier.plans.durable import durable

VOCABULARY = "byte_bpe_50k.json"
#: Near duplicates share 80 per cent of their five-word shingles; the four words and 85 per cent of op8 bind that query only.
SHINGLE, PERCENT = 5, 80


def _apart(docs: DataFrame, *names: str) -> DataFrame:
    """``docs`` with other names for the columns that are called like ``names``, in their places."""
    taken = {n.lower() for n in names}
    return docs.toDF(*[f"_{k}_{c}" if c.lower() in taken else c for k, c in enumerate(docs.columns)])


def good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop the documents that the quality classifier rejects."""
    model = quality.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality.scored(_apart(docs, "score", "predicted"), model).where("predicted = 1").drop("score", "predicted").toDF(*docs.columns)


def distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the first document of each group that links of five-word shingles connect."""
    return jaccard.first_of_each(docs, PERCENT, SHINGLE).select(*docs.columns)


def unleaked(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop the documents that hold a benchmark item; items of fewer than five words count only as whole documents."""
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return decontamination.with_leaks(_apart(docs, "_leaks"), items, "_leaks", short=False).where(F.size("_leaks") == 0).drop("_leaks").toDF(*docs.columns)


def private(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replace personal data by their kind, and generalise or remove the terms that reveal them."""
    return pii.sanitised(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, ids): the texts as byte pair ids, little-endian unsigned 32-bit integers."""
    return bpe.encoded(docs, public_tokenizers.path(VOCABULARY)).select("doc_id", "n_tokens", "ids")


STAGES = [("quality", good), ("jaccard", distinct), ("decontamination", unleaked), ("pii", private), ("bpe", tokens)]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = durable(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
