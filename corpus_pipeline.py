"""From raw documents to packed training sequences, one written table per stage."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wikiloom.llm import exact, mixture, ngram_join, packing, toxicity
from wikiloom.llm.common import read
from wikiloom.session import WorkFolder

TOKENIZER = "word_bpe_49k.json"


def toxic_texts(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, fitted to ``labels``, does not call toxic."""
    model = toxicity.learn(docs, read(spark, sf_dir, "labels"), WorkFolder.scratch(spark, "pipeline-toxicity"))
    return toxicity.without_toxic(docs, model)


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest doc_id of each text."""
    return exact.without_copies(docs, WorkFolder.scratch(spark, "pipeline-exact"))


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest doc_id of each group of texts whose sets of five-word shingles
    are similar by 0.8 or more, over any path."""
    return ngram_join.one_of_each_group(docs, WorkFolder.scratch(spark, "pipeline-ngrams"), size=5, percent=80)


def mixed_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents as often as the target weights of their sources ask for."""
    return mixture.mixed_documents(docs, WorkFolder.scratch(spark, "pipeline-mixture"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of at most 2048 tokens with their ids."""
    pieces = packing.pack(docs, public_tokenizers.path(TOKENIZER), limit=2048, end_id=1, keep_words=False)
    return pieces.withColumn("ids_crc32", F.crc32("ids"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", toxic_texts),
    ("exact_dedup", exact_copies),
    ("ngram_join", near_copies),
    ("mixing", mixed_sources),
    ("packing", packed),
]

#: A classifier and a schedule by hash cannot be written in SQL; tests compare with plain Python.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each one's result is written to the shared folder and read again."""
    work = WorkFolder.scratch(spark, "pipeline")
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = work.keep(stage(spark, docs, sf_dir), name)
    return docs
