"""Substring deduplication: word windows that begin in an earlier document are removed.

Every window of ``size`` words gets a Rabin-Karp hash. Documents lie in runs by ranges of doc_id,
so "a document with a smaller doc_id holds this window" is "an earlier run holds it, or a smaller
doc_id of the same run". An up and down sweep counts, for every distinct window of every run,
whether an earlier run has it; the run then merges its repeated windows into maximal intervals of
words and cuts these out.

Windows are compared by 64-bit hashes: a window is removed wrongly with a probability of about the
number of distinct windows over 2**64.
"""

from __future__ import annotations

from itertools import compress

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wikiloom.llm.common import column
from wikiloom.llm.grams import windows_of, words_of
from wikiloom.llm.sweep import blobs, bucket_bits, bucket_cuts, run_count, sort_groups

#: Runs of documents without a doc_id have this number and above; none of them is earlier than another.
NO_ID = 1 << 30


def _texts(table: pa.Table) -> list[bytes]:
    return [t or b"" for t in table.column("text").cast(pa.binary()).to_pylist()]


def _in_order(table: pa.Table) -> pa.Table:
    return table.sort_by([("doc_id", "ascending")])


def _windows(table: pa.Table, size: int) -> tuple[list[bytes], np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    texts = _texts(table)
    words, counts = words_of(texts)
    hashes, text, begin = windows_of(words, counts, size)
    return texts, counts, hashes, text, begin


def in_runs(docs: DataFrame, doc_id: str, text: str) -> tuple[DataFrame, int]:
    """run, doc_id and text of each document, and the bytes of all texts."""
    rows = docs.select(column(docs, doc_id).cast("bigint").alias("doc_id"), column(docs, text).cast("string").alias("text"))
    total = rows.agg(F.sum(F.octet_length("text")).alias("n")).head()["n"] or 0
    runs = run_count(total)
    bounds: list[int] = []
    if runs > 1:
        steps = [k / runs for k in range(1, runs)]
        found = rows.agg(F.percentile_approx("doc_id", steps, 100 * runs).alias("bounds")).head()["bounds"]
        bounds = sorted(set(found or []))

    @F.pandas_udf("int")
    def run_of(ids: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(np.array(bounds, np.int64), ids.to_numpy(), side="right").astype(np.int32))

    # A null would make the column one of floats, in which large ids lose digits.
    known = run_of(F.coalesce("doc_id", F.lit(0).cast("bigint")))
    spread = NO_ID + F.pmod(F.xxhash64("text"), F.lit(runs)).cast("int")
    run = F.when(F.col("doc_id").isNull(), spread).otherwise(known)
    return rows.select(run.alias("run"), "doc_id", "text"), total


def without_repeats(docs: DataFrame, size: int = 13, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Remove every word covered by a window that also begins in a document with a smaller doc_id.

    One row per document: doc_id, n_words, n_removed, spans (maximal intervals of removed words, as
    from and to) and kept (the words that stay, joined by one space). Words are runs of characters
    other than ASCII white space, unchanged. Windows are judged on the input. A null text is empty;
    documents with fewer than ``size`` words lose nothing. doc_id is an integer; rows with the same
    doc_id do not repeat each other, and a null doc_id is larger than all others and not smaller
    than another null. No rows give no rows; other columns are ignored.
    """
    ranged, total = in_runs(docs, doc_id, text)
    bits = bucket_bits(total // 6)

    def up(table: pa.Table) -> pa.Table:
        run = table.column("run")[0].as_py()
        _, _, hashes, _, _ = _windows(_in_order(table), size)
        distinct = np.unique(hashes)
        cuts = bucket_cuts(distinct, bits)
        made = pa.table({"bucket": np.arange(len(cuts) - 1, dtype=np.int32), "run": np.full(len(cuts) - 1, run, np.int32), "hashes": blobs(distinct, cuts)})
        return made.filter(pa.array(np.diff(cuts) > 0))

    def meet(table: pa.Table) -> pa.Table:
        table = table.sort_by([("run", "ascending")])
        runs = table.column("run").to_numpy()
        parts = [np.frombuffer(b, np.uint64) for b in table.column("hashes").to_pylist()]
        sizes = np.array([len(p) for p in parts])
        order, new, group = sort_groups(np.concatenate(parts))
        of = np.repeat(runs, sizes)[order]
        first = of[new][group]
        earlier = np.empty(len(of), bool)
        earlier[order] = (of > first) & (first < NO_ID)
        ends = np.cumsum(sizes)
        answers = [np.packbits(earlier[e - n : e]).tobytes() for e, n in zip(ends, sizes, strict=True)]
        return pa.table({"run": table.column("run"), "bucket": table.column("bucket"), "earlier": pa.array(answers, pa.binary())})

    def down(table: pa.Table, answers: pa.Table) -> pa.Table:
        table = _in_order(table)
        texts, counts, hashes, text, begin = _windows(table, size)
        order, new, group = sort_groups(hashes)
        distinct = hashes[order][new]
        cuts = bucket_cuts(distinct, bits)
        earlier = np.zeros(len(distinct), bool)
        for b, packed in zip(answers.column("bucket").to_pylist(), answers.column("earlier").to_pylist(), strict=True):
            n = cuts[b + 1] - cuts[b]
            earlier[cuts[b] : cuts[b + 1]] = np.unpackbits(np.frombuffer(packed, np.uint8), count=n)
        ids = table.column("doc_id").combine_chunks()
        key = ids.fill_null(0).to_numpy()[text[order]]  # in a run, either all doc_ids are null or none is
        smallest = key[new][group]  # windows are in doc_id order, and the sort is stable
        repeated = np.empty(len(hashes), bool)
        repeated[order] = earlier[group] | (key > smallest)
        covered = np.zeros(int(counts.sum()) + 1, np.int32)
        hit = begin[repeated]
        np.add.at(covered, hit, 1)
        np.add.at(covered, hit + size, -1)
        gone = np.cumsum(covered[:-1]) > 0
        ends = np.cumsum(counts)
        removed, kept, spans = [], [], []
        for t, e, n in zip(texts, ends.tolist(), counts.tolist(), strict=True):
            mask = gone[e - n : e]
            lost = int(mask.sum())
            removed.append(lost)
            words = t.split()
            if lost:
                edges = np.flatnonzero(np.diff(mask, prepend=False, append=False))
                spans.append([{"from": a, "to": b} for a, b in zip(edges[0::2].tolist(), edges[1::2].tolist(), strict=True)])
                words = compress(words, (~mask).tolist())
            else:
                spans.append([])
            kept.append(b" ".join(words))
        return pa.table(
            {
                "doc_id": ids,
                "n_words": pa.array(counts, pa.int64()),
                "n_removed": pa.array(removed, pa.int64()),
                "spans": pa.array(spans, pa.list_(pa.struct([("from", pa.int64()), ("to", pa.int64())]))),
                "kept": pa.array(kept, pa.binary()).cast(pa.string()),
            }
        )

    sent = ranged.groupBy("run").applyInArrow(up, "bucket int, run int, hashes binary")
    answers = sent.groupBy("bucket").applyInArrow(meet, "run int, bucket int, earlier binary")
    return (
        ranged.groupBy("run")
        .cogroup(answers.groupBy("run"))
        .applyInArrow(
            down,
            "doc_id bigint, n_words bigint, n_removed bigint, spans array<struct<from: bigint, to: bigint>>, kept string",
        )
    )


def removal_digests(result: DataFrame) -> DataFrame:
    return result.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))
