"""Token ids in files of canonical, length-limited Huffman codes.

The ids of all documents are counted, a code of at most ``limit`` bits is made from the counts by
package-merge, and only the code lengths are stored: canonical codes follow from them. Documents
are written in ascending doc_id order into blocks that can be decoded alone. A block has a header
with the doc_ids and token counts, a checkpoint (bit offset) at the start of each document and
after every ``STEP`` tokens, and the bits. Decoding looks up ``limit`` bits at a time in a table of
(id, length) and runs all checkpoints of a block side by side.

Files are Parquet tables with one row per block, so any store and commit protocol that Spark can
write to will do:

    blocks/    range, block, n_docs, n_tokens, start (ids of all blocks before it), payload
    lengths/   id, length

What goes through the driver is bounded by the vocabulary (counts, code lengths) and by the number
of output files (the bounds and sizes of their doc_id ranges).
"""

from __future__ import annotations

import struct
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wikiloom.llm.common import column
from wikiloom.llm.tokens import ended_ids, id_bytes, slices, tokenizer
from wikiloom.session import WorkFolder

MAGIC = b"HUF1"
STEP = 512
LIMIT = 18
BLOCK_TOKENS = 1 << 20
RANGE_TOKENS = 1 << 23


# --- code ----------------------------------------------------------------------------------
def code_lengths(counts: np.ndarray, limit: int = LIMIT) -> np.ndarray:
    """Optimal code lengths of at most ``limit`` bits by package-merge; 0 for ids that do not occur."""
    used = np.flatnonzero(counts)
    lengths = np.zeros(len(counts), np.uint8)
    if len(used) < 2:
        lengths[used] = 1
        return lengths
    if len(used) > 1 << limit:
        raise ValueError(f"{len(used)} ids do not fit into codes of {limit} bits")
    order = used[np.argsort(counts[used], kind="stable")]
    weight = counts[order].astype(np.float64)
    levels, packages = [], np.empty(0)
    for _ in range(limit):
        both = np.concatenate([weight, packages])
        sort = np.argsort(both, kind="stable")
        levels.append(sort < len(weight))
        both = both[sort]
        both = both[: len(both) // 2 * 2]
        packages = both[0::2] + both[1::2]
    take = 2 * len(order) - 2
    depth = np.zeros(len(order), np.int64)
    for leaf in reversed(levels):
        leaves = int(leaf[:take].sum())
        depth[:leaves] += 1
        take = 2 * (take - leaves)
    lengths[order] = depth
    return lengths


class Code:
    """Canonical codes and the decoding table for the lengths of all ids."""

    def __init__(self, lengths: np.ndarray, limit: int = LIMIT):
        self.lengths, self.limit = lengths.astype(np.int64), limit
        ids = np.flatnonzero(lengths)
        ids = ids[np.argsort(self.lengths[ids], kind="stable")]
        sizes = self.lengths[ids]
        spans = np.int64(1) << (limit - sizes)
        begins = np.cumsum(spans) - spans
        self.codes = np.zeros(len(lengths), np.uint64)
        self.codes[ids] = (begins >> (limit - sizes)).astype(np.uint64)
        self.table_id = np.zeros(1 << limit, np.uint32)
        self.table_length = np.zeros(1 << limit, np.uint8)
        filled = int(spans.sum())
        self.table_id[:filled] = np.repeat(ids, spans)
        self.table_length[:filled] = np.repeat(sizes, spans)

    def encode(self, ids: np.ndarray) -> tuple[bytes, np.ndarray]:
        """The bits of ``ids``, padded to a byte, and the bit offset of every ``STEP``-th id."""
        if not len(ids):
            return b"", np.zeros(0, np.int64)
        size = self.lengths[ids]
        ends = np.cumsum(size)
        begins = ends - size
        word, shift = begins >> 6, 64 - (begins & 63) - size
        codes = self.codes[ids]
        over = shift < 0
        left = np.where(over, codes >> np.where(over, -shift, 0).astype(np.uint64), codes << np.where(over, 0, shift).astype(np.uint64))
        out = np.zeros((int(ends[-1]) + 63) // 64 + 1, np.uint64)
        first = np.flatnonzero(np.diff(word, prepend=-1))
        out[word[first]] = np.bitwise_or.reduceat(left, first)
        spill = np.flatnonzero(over)  # at most one id for each border between two words
        out[word[spill] + 1] |= codes[spill] << (64 + shift[spill]).astype(np.uint64)
        return out.astype(">u8").tobytes()[: (int(ends[-1]) + 7) // 8], begins[::STEP]

    def decode(self, bits: bytes, offsets: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """The ids of segments that begin at the bit ``offsets`` and hold ``counts`` ids, one after the other."""
        data = np.frombuffer(bits + bytes(8), np.uint8)
        at = offsets.astype(np.int64)
        # Longest segments first, so that those still running are a prefix.
        order = np.argsort(-counts, kind="stable")
        at, left = at[order], counts[order]
        starts = (np.cumsum(counts) - counts)[order]
        out = np.empty(int(counts.sum()), np.uint32)
        steps = int(left[0]) if len(left) else 0
        running = np.searchsorted(-left, -np.arange(1, steps + 1), side="right")
        shift_base = 32 - self.limit
        for k in range(steps):
            n = int(running[k])
            a = at[:n]
            byte = a >> 3
            window = (
                (data[byte].astype(np.uint32) << np.uint32(24))
                | (data[byte + 1].astype(np.uint32) << np.uint32(16))
                | (data[byte + 2].astype(np.uint32) << np.uint32(8))
                | data[byte + 3]
            )
            index = (window << (a & 7).astype(np.uint32)) >> np.uint32(shift_base)
            out[starts[:n] + k] = self.table_id[index]
            a += self.table_length[index]
        return out


# --- blocks --------------------------------------------------------------------------------
def pack_block(docs: list[tuple[int | None, int, bytes, np.ndarray]]) -> bytes:
    """One block of (doc_id, token count, bits, checkpoints within them) documents."""
    ids = np.array([0 if d[0] is None else d[0] for d in docs], "<i8")
    null = np.array([d[0] is None for d in docs], np.uint8)
    counts = np.array([d[1] for d in docs], "<u4")
    sizes = np.array([len(d[2]) for d in docs], np.int64)
    base = (np.cumsum(sizes) - sizes) * 8
    points = [d[3] + b for d, b in zip(docs, base.tolist(), strict=True)]
    checkpoints = np.concatenate(points).astype("<u8") if points else np.zeros(0, "<u8")
    head = struct.pack("<4sIII", MAGIC, len(docs), len(checkpoints), STEP)
    return b"".join([head, ids.tobytes(), null.tobytes(), counts.tobytes(), checkpoints.tobytes(), *(d[2] for d in docs)])


def open_block(payload: bytes, code: Code) -> tuple[list[int | None], np.ndarray, np.ndarray]:
    """The doc_ids, token counts and all ids of a block."""
    magic, n, points, step = struct.unpack_from("<4sIII", payload)
    if magic != MAGIC:
        raise ValueError("not a block of Huffman codes")
    at = 16
    ids = np.frombuffer(payload, "<i8", n, at)
    null = np.frombuffer(payload, np.uint8, n, at + 8 * n)
    counts = np.frombuffer(payload, "<u4", n, at + 9 * n).astype(np.int64)
    at += 13 * n
    offsets = np.frombuffer(payload, "<u8", points, at)
    segments = -(-counts // step)
    sizes = np.full(points, step, np.int64)
    some = counts > 0
    sizes[np.cumsum(segments)[some] - 1] = counts[some] - (segments[some] - 1) * step
    tokens = code.decode(payload[at + 8 * points :], offsets, sizes)
    return [None if x else i for i, x in zip(ids.tolist(), null.tolist(), strict=True)], counts, tokens


# --- jobs ----------------------------------------------------------------------------------
def token_ids(docs: DataFrame, tokenizer_path: str, end_id: int, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id (bigint), n_tokens and ids (little-endian unsigned 32-bit, end id last) of each document."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = tokenizer(tokenizer_path)
        for batch in slices(batches, 1):
            ids, counts = ended_ids(words, batch.column(1), end_id)
            columns = [batch.column(0), pa.array(counts), id_bytes(ids, counts)]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_tokens", "ids"])

    rows = docs.select(column(docs, doc_id).cast("bigint").alias("doc_id"), column(docs, text).cast("string").alias("text"))
    return rows.mapInArrow(encode, "doc_id bigint, n_tokens bigint, ids binary")


def id_counts(tokens: DataFrame) -> dict[int, int]:
    """How often each id occurs; one row per id of the vocabulary reaches the driver."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(0, np.int64)
        for batch in batches:
            if batch.num_rows:
                ids = np.frombuffer(b"".join(batch.column(0).to_pylist()), "<u4")
                more = np.bincount(ids, minlength=len(total))
                more[: len(total)] += total
                total = more
        ids = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(total[ids])], names=["id", "n"])

    rows = tokens.select("ids").mapInArrow(count, "id bigint, n bigint").groupBy("id").agg(F.sum("n").alias("n")).collect()
    return {r["id"]: r["n"] for r in rows}


def write_ids(tokens: DataFrame, folder: str, limit: int = LIMIT) -> None:
    """Write (doc_id, n_tokens, ids) rows as files of Huffman blocks, in ascending doc_id order, null last.

    ``tokens`` is read four times, twice without its ids, and should be a table. No rows write no blocks; documents without
    ids, repeated and null doc_ids are kept. A document larger than a block is a block by itself.
    """
    spark = tokens.sparkSession
    counts = id_counts(tokens)
    total = np.zeros(max(counts, default=-1) + 1, np.int64)
    total[list(counts)] = list(counts.values())
    lengths = code_lengths(total, limit)
    ids = np.flatnonzero(lengths)
    rows = [(int(i), int(lengths[i])) for i in ids]
    spark.createDataFrame(rows, "id bigint, length int").coalesce(1).write.mode("overwrite").parquet(f"{folder}/lengths")

    ranges = max(1, -(-int(total.sum()) // RANGE_TOKENS))
    if ranges > 1:
        steps = [k / ranges for k in range(1, ranges)]
        found = tokens.agg(F.percentile_approx("doc_id", steps, 100 * ranges).alias("bounds")).head()["bounds"]
        bounds = sorted(set(found or []))
    else:
        bounds = []
    given = spark.sparkContext.broadcast(lengths)  # a byte for each id of the vocabulary
    edges = np.array(bounds, np.int64)

    @F.pandas_udf("int")
    def range_of(ids: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(edges, ids.to_numpy(), side="right").astype(np.int32))

    # A null would make the column one of floats, in which large ids lose digits.
    known = range_of(F.coalesce("doc_id", F.lit(0).cast("bigint")))
    of_row = F.when(F.col("doc_id").isNull(), len(bounds)).otherwise(known)
    sizes = tokens.groupBy(of_row.alias("range")).agg(F.sum("n_tokens").alias("n")).collect()
    in_range = np.zeros(len(bounds) + 1, np.int64)
    for r in sizes:
        in_range[r["range"]] = r["n"]
    bases = (np.cumsum(in_range) - in_range).tolist()

    def encode(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = Code(given.value, limit)
        for batch in batches:
            done = [code.encode(np.frombuffer(x, "<u4")) for x in batch.column(2).to_pylist()]
            keys = batch.column(0)
            at = np.searchsorted(edges, keys.fill_null(0).to_numpy(zero_copy_only=False), side="right")
            at[keys.is_null().to_numpy(zero_copy_only=False)] = len(edges)
            yield pa.RecordBatch.from_arrays(
                [
                    keys,
                    batch.column(1),
                    pa.array(at.astype(np.int32)),
                    pa.array([bits for bits, _ in done], pa.binary()),
                    pa.array([points.astype("<u8").tobytes() for _, points in done], pa.binary()),
                ],
                names=["doc_id", "n_tokens", "range", "bits", "points"],
            )

    coded = tokens.select("doc_id", "n_tokens", "ids").mapInArrow(
        encode, "doc_id bigint, n_tokens bigint, range int, bits binary, points binary"
    )
    ordered = coded.repartitionById(len(bounds) + 1, F.col("range")).sortWithinPartitions(
        "range", F.col("doc_id").asc_nulls_last()
    )

    def block(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[int | None, int, bytes, np.ndarray]] = []
        here, number, start, size = None, 0, 0, 0

        def flush() -> pa.RecordBatch:
            nonlocal held, number, start, size
            made = ([here], [number], [len(held)], [size], [start], [pack_block(held)])
            held, number, start, size = [], number + 1, start + size, 0
            kinds = (pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
            names = ["range", "block", "n_docs", "n_tokens", "start", "payload"]
            return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(made, kinds, strict=True)], names=names)

        for batch in batches:
            columns = [batch.column(k).to_pylist() for k in range(5)]
            for key, n, of, bits, points in zip(*columns, strict=True):
                if held and (of != here or size + n > BLOCK_TOKENS):
                    yield flush()
                if of != here:
                    here, number, start = of, 0, bases[of]
                held.append((key, n, bits, np.frombuffer(points, "<u8").astype(np.int64)))
                size += n
        if held:
            yield flush()

    blocks = ordered.mapInArrow(block, "range int, block bigint, n_docs bigint, n_tokens bigint, start bigint, payload binary")
    blocks.write.mode("overwrite").option("compression", "none").parquet(f"{folder}/blocks")


def read_ids(spark: SparkSession, folder: str, limit: int = LIMIT) -> DataFrame:
    """The documents of ``folder``: doc_id, start (ids of all documents before it), n_tokens, ids."""
    rows = spark.read.parquet(f"{folder}/lengths").collect()
    lengths = np.zeros(max((r["id"] for r in rows), default=-1) + 1, np.uint8)
    for r in rows:
        lengths[r["id"]] = r["length"]
    given = spark.sparkContext.broadcast(lengths)

    def decode(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = Code(given.value, limit)
        for batch in batches:
            for begin, payload in zip(*(batch.column(k).to_pylist() for k in range(2)), strict=True):
                keys, counts, tokens = open_block(payload, code)
                ends = np.cumsum(counts)
                columns = [pa.array(keys, pa.int64()), pa.array(begin + ends - counts), pa.array(counts)]
                columns.append(id_bytes(tokens.astype("<u4", copy=False), counts))
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "start", "n_tokens", "ids"])

    blocks = spark.read.parquet(f"{folder}/blocks").select("start", "payload")
    return blocks.mapInArrow(decode, "doc_id bigint, start bigint, n_tokens bigint, ids binary")


def write_documents(
    docs: DataFrame, tokenizer_path: str, work: WorkFolder, end_id: int, doc_id: str = "doc_id", text: str = "text"
) -> str:
    """Encode every whole text (null: empty) with ``end_id`` after it; the folder of the files."""
    path = f"{work.folder}/tokens"
    tokens = token_ids(docs, tokenizer_path, end_id, doc_id, text)
    tokens.write.mode("overwrite").option("compression", "zstd").parquet(path)
    write_ids(docs.sparkSession.read.parquet(path), f"{work.folder}/files")
    return f"{work.folder}/files"


def document_digests(documents: DataFrame) -> DataFrame:
    return documents.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))
