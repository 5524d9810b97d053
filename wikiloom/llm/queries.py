"""The queries of the training-data operators, each over its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wikiloom.llm import (
    exact,
    hard_negatives,
    huffman,
    languages,
    lexical,
    licences,
    mixture,
    ngram_join,
    packing,
    substrings,
    token_counts,
    topk,
    toxicity,
)
from wikiloom.llm.common import read
from wikiloom.session import WorkFolder

Query = Callable[[SparkSession, str], DataFrame]

WORD_BPE = "word_bpe_49k.json"


def op1_toxicity(spark: SparkSession, d: str) -> DataFrame:
    docs = read(spark, d, "documents")
    model = toxicity.learn(docs, read(spark, d, "labels"), WorkFolder.scratch(spark, "op1"))
    return toxicity.score(docs, model)


def op2_topk_search(spark: SparkSession, d: str) -> DataFrame:
    vectors = read(spark, d, "embeddings")
    return topk.top_k(vectors, vectors.where("vec_id % 50 = 0"), WorkFolder.scratch(spark, "op2"), k=5, scale=256)


def op3_licence_scan(spark: SparkSession, d: str) -> DataFrame:
    known = licences.known_digests(licences.published(spark))
    return licences.licence_scan(read(spark, d, "documents"), known)


def op4_token_files(spark: SparkSession, d: str) -> DataFrame:
    work = WorkFolder.scratch(spark, "op4")
    folder = huffman.write_documents(read(spark, d, "documents"), public_tokenizers.path(WORD_BPE), work, end_id=2)
    return huffman.document_digests(huffman.read_ids(spark, folder))


def op5_substring_dedup(spark: SparkSession, d: str) -> DataFrame:
    return substrings.removal_digests(substrings.without_repeats(read(spark, d, "documents"), size=13))


def op6_exact_dedup(spark: SparkSession, d: str) -> DataFrame:
    return exact.exact_groups(read(spark, d, "documents"), WorkFolder.scratch(spark, "op6"))


def op7_packing(spark: SparkSession, d: str) -> DataFrame:
    docs = read(spark, d, "documents")
    return packing.packed_digests(packing.pack(docs, public_tokenizers.path(WORD_BPE), limit=2048, end_id=1))


def op8_mixing(spark: SparkSession, d: str) -> DataFrame:
    mix = mixture.plan_mix(read(spark, d, "documents"), WorkFolder.scratch(spark, "op8"))
    return mixture.per_document(mix).select("doc_id", "size", "source_size", "target", "taken", "source")


def op9_ngram_join(spark: SparkSession, d: str) -> DataFrame:
    work = WorkFolder.scratch(spark, "op9")
    found = ngram_join.jaccard_components(read(spark, d, "documents"), work, size=3, percent=90)
    return found.select("doc_id", "n_shingles", "component_id")


def op10_token_counts(spark: SparkSession, d: str) -> DataFrame:
    """All documents come, their pieces are counted later, words without a letter or digit stop
    counting as words, and documents labelled toxic go; two batches are sent a second time."""
    work = WorkFolder.scratch(spark, "op10")
    docs = read(spark, d, "documents")
    counted = docs.select(
        "doc_id", "source", "lang", *(token_counts.count_tokens(F.col("text"), t).alias(t) for t in token_counts.TOKENIZERS)
    )
    counted = work.keep(counted, "counted")
    words, words_2, pieces = (F.col(f"`{t}`") for t in ("words-1", "words-2", "pieces-1"))
    toxic = read(spark, d, "labels").where("toxic = 1").select("doc_id").distinct()
    gone = counted.join(toxic, "doc_id", "left_semi")
    rollup = token_counts.Rollup.create(spark, f"{work.folder}/rollup")
    batches = {
        "1-arrivals": token_counts.change(counted, "insert", "words-1", words),
        "2-pieces": token_counts.change(counted, "insert", "pieces-1", pieces),
        "3-revised": token_counts.change(counted, "revise", "words-1", words_2, words),
        "4-toxic": token_counts.change(gone, "delete", "words-1", words_2).union(token_counts.change(gone, "delete", "pieces-1", pieces)),
    }
    for name in (*batches, "2-pieces", "4-toxic"):
        rollup.commit(name, batches[name])
    return rollup.totals()


def op11_hard_negatives(spark: SparkSession, d: str) -> DataFrame:
    label = F.expr("case when vec_id % 7 = 0 then (label + 1) % 10 else label end")
    vectors = read(spark, d, "embeddings").select("vec_id", "embedding", label.alias("label"))
    return hard_negatives.mine(vectors, vectors.where("vec_id % 50 = 0"), WorkFolder.scratch(spark, "op11"), positives=5, negatives=3, low=50, high=95, scale=256)


def op12_lexical_search(spark: SparkSession, d: str) -> DataFrame:
    return lexical.search(read(spark, d, "documents"), read(spark, d, "benchmark"), WorkFolder.scratch(spark, "op12"), k=10)


def op13_language_id(spark: SparkSession, d: str) -> DataFrame:
    docs = read(spark, d, "documents")
    return languages.identify(docs, languages.learn(docs))


QUERIES: dict[str, Query] = {
    "op1_toxicity": op1_toxicity,
    "op2_topk_search": op2_topk_search,
    "op3_licence_scan": op3_licence_scan,
    "op4_token_files": op4_token_files,
    "op5_substring_dedup": op5_substring_dedup,
    "op6_exact_dedup": op6_exact_dedup,
    "op7_packing": op7_packing,
    "op8_mixing": op8_mixing,
    "op9_ngram_join": op9_ngram_join,
    "op10_token_counts": op10_token_counts,
    "op11_hard_negatives": op11_hard_negatives,
    "op12_lexical_search": op12_lexical_search,
    "op13_language_id": op13_language_id,
}

ORACLES: dict[str, str] = {
    "op3_licence_scan": licences.SCAN_SQL,
    "op6_exact_dedup": exact.GROUPS_SQL,
    "op10_token_counts": token_counts.COUNTS_SQL,
    "op11_hard_negatives": hard_negatives.NEGATIVES_SQL,
    "op12_lexical_search": lexical.SEARCH_SQL,
}
