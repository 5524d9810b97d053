"""Packing by power-of-two decomposition: every document is cut into pieces of binary length.

A document of ``n`` tokens (its ids and the end id) is cut into ``n // limit`` pieces of ``limit``
tokens and, for what is left, one piece for each bit that is set, longest first. Each piece is a
sequence by itself: no sequence crosses documents and none is padded. Sequences of equal length
form a bucket, from which a trainer draws batches of one shape.

The job is one pass over the documents without a shuffle: the size of a bucket never matters, so
neither a hot source nor a bucket that holds most rows meets in one task. Sequence ids are unique
and ascend by bucket, then by input partition, then by row; they are not gapless, for the same
reason as ``monotonically_increasing_id``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wikiloom.llm.common import column, fresh
from wikiloom.llm.memory import frugal
from wikiloom.llm.tokens import close_tokenizers, ended_ids, id_bytes, slices, tokenizer

#: A sequence id is bucket, input partition and number in the partition, in this many bits each.
PARTITION_BITS, NUMBER_BITS = 24, 33


def binary_cuts(tokens: np.ndarray, limit: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Document number, start and length of every piece of documents with ``tokens`` tokens."""
    bits = limit.bit_length() - 1
    whole = tokens >> bits
    rest = tokens & (limit - 1)
    powers = 1 << np.arange(bits - 1, -1, -1, dtype=np.int64)
    set_bits = (rest[:, None] & powers[None, :]) > 0
    counts = whole + set_bits.sum(axis=1)
    row = np.repeat(np.arange(len(tokens)), counts)
    first = np.cumsum(counts) - counts
    nth = np.arange(len(row)) - first[row]
    length = np.full(len(row), limit, np.int64)
    length[nth >= whole[row]] = np.broadcast_to(powers, set_bits.shape)[set_bits]
    ends = np.cumsum(length)
    start = ends - length
    base = np.zeros(len(tokens), np.int64)
    some = counts > 0
    base[some] = start[first[some]]
    return row, start - base[row], length


def pack(
    docs: DataFrame,
    tokenizer_path: str,
    limit: int = 2048,
    end_id: int = 1,
    doc_id: str = "doc_id",
    text: str = "text",
    keep_words: bool = True,
) -> DataFrame:
    """Sequences of at most ``limit`` (a power of two) tokens, one row per piece.

    Columns: doc_id, start (ids of the document before the piece), length, ids (little-endian
    unsigned 32-bit), doc_tokens (with the end id), bucket (the length of its sequence),
    sequence_id, offset (always 0: a sequence is one piece).

    A null or empty text is the end id alone. Null and repeated doc_ids are kept, each row as a
    document of its own; no rows give no rows; extra columns of ``docs`` are ignored. A text of any
    length is cut like any other and never leaves its task. Without ``keep_words`` a worker forgets
    its tokenizer at the end of a task, for jobs with other steps that need the memory.
    """
    if limit < 1 or limit & (limit - 1):
        raise ValueError("limit must be a power of two")
    id_type = docs.select(column(docs, doc_id)).schema[0].dataType.simpleString()
    bits = limit.bit_length()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = tokenizer(tokenizer_path)
        made = np.zeros(bits, np.int64)
        for batch in slices(batches, 1):
            ids, tokens = ended_ids(words, batch.column(1), end_id)
            row, start, length = binary_cuts(tokens, limit)
            level = np.log2(length).astype(np.int64)
            number = np.empty(len(row), np.int64)
            for k in range(bits):
                of = level == k
                n = int(of.sum())
                number[of] = made[k] + np.arange(n)
                made[k] += n
            part = batch.column(2).take(pa.array(row)).cast(pa.int64()).to_numpy()
            sequence = ((bits - 1 - level) << (PARTITION_BITS + NUMBER_BITS)) + (part << NUMBER_BITS) + number
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).take(pa.array(row)),
                    pa.array(start),
                    pa.array(length),
                    id_bytes(ids, length),  # the pieces tile the ids
                    pa.array(tokens[row]),
                    pa.array(length),
                    pa.array(sequence),
                    pa.array(np.zeros(len(row), np.int64)),
                ],
                names=["doc_id", "start", "length", "ids", "doc_tokens", "bucket", "sequence_id", "offset"],
            )

    (part,) = fresh([doc_id, text], "part")
    rows = docs.select(
        column(docs, doc_id).alias(doc_id), column(docs, text).cast("string").alias(text), F.spark_partition_id().alias(part)
    )
    return rows.mapInArrow(
        cut if keep_words else frugal(cut, close_tokenizers),
        f"doc_id {id_type}, start bigint, length bigint, ids binary, doc_tokens bigint, bucket bigint, "
        "sequence_id bigint, offset bigint",
    )


def packed_digests(pieces: DataFrame) -> DataFrame:
    """The pieces with the crc32 of their ids in place of the ids."""
    return pieces.select(
        "doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "bucket"
    )
