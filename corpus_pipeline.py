"""The corpus pipeline: toxic documents go, near-duplicates leave one of each group, sources are mixed to their weights, and what remains is encoded.

Each stage takes (spark, docs, sf_dir), is written as Parquet and read again as the next one's docs. All but the last
return the columns of documents.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkwell.llm import bpe, common, mixing, simhash, toxicity


def not_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that a classifier, learned from the labels of three of four folds, doesn't call toxic."""
    learn = docs.where(common.crc_fold("doc_id", 4) != 2)
    model = toxicity.train(learn, common.table(spark, sf_dir, "labels"))
    return toxicity.score(docs, model, threshold=0.3, names=("__score", "__predicted")).where("__predicted = 0").select(*docs.columns)


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that is alike in shingles of five words, similarity 0.8 or more."""
    return simhash.one_of_each(docs, width=5, similarity=0.8)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix to the sources' weights takes them."""
    return mixing.expanded(docs, mixing.mix(docs, factor=1.5, most=2.0))


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, and digests of them and of their decoding."""
    out = bpe.encode_documents(docs, public_tokenizers.path("word_bpe_49k.json"))
    return out.select("doc_id", "n_tokens", "ids_le32", F.sha2("ids_le32", 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", not_toxic),
    ("simhash_near_dedup", one_of_each),
    ("mixing", mixed),
    ("bpe", encoded),
]

#: SQL can't express the classifier, the fingerprints, the rounding or the encoding; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = common.written(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
