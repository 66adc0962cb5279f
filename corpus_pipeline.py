"""A corpus in five steps: toxic documents go, then exact copies, then near copies; sources are mixed to their
weights; what is left is encoded. Each stage reads what the stage before wrote."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from chunkloom.llm import exact_dedup, piece_codec, source_mix, toxicity
from chunkloom.llm.entries import tokenizer_path
from chunkloom.llm.shared import Store, read


def not_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.clean(docs, read(spark, sf_dir, "labels"))


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact_dedup.unique(docs, Store(spark, "exact"))


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    from chunkloom.llm import ngram_join

    return ngram_join.unique(docs, Store(spark, "near"))


def mixed_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return source_mix.mixed(docs, Store(spark, "mix"))


def pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return piece_codec.encoded(docs, tokenizer_path("piece_bpe_32k.model"))


STAGES = [
    ("toxicity", not_toxic),
    ("exact_dedup", exact_copies),
    ("ngram_join", near_copies),
    ("source_mix", mixed_sources),
    ("piece_codec", pieces),
]

#: Toxicity is trained, near copies are classes of links and pieces are searched for; SQL has none of these.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, store = read(spark, sf_dir, "documents"), Store(spark, "pipeline")
    for i, (name, stage) in enumerate(STAGES):
        made = stage(spark, docs, sf_dir)
        docs = made if i == len(STAGES) - 1 else store.keep(made, name)
    return docs
