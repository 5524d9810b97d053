"""Up and down sweeps: what all runs together know about each run's hashes.

The documents lie in runs of bounded size. A run sends its distinct hashes up, sorted and cut by
their top bits into buckets; a bucket sees the hashes of its range from all runs, each once per
run whatever number of documents holds it, and answers with one byte or bit per hash, in the
order they came. The answers go down to the run, which makes the same hashes again from its texts.
Hashes travel once; neither a frequent hash nor a large group of copies weighs more than one row
per run, and both ends of the sweep are sized by the input.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

#: Bytes of text in a run, and hashes in a bucket, about.
RUN_BYTES = 8 << 20
BUCKET_HASHES = 2_000_000


def run_count(text_bytes: int) -> int:
    return max(1, -(-text_bytes // RUN_BYTES))


def bucket_bits(hashes: int) -> int:
    return max(0, (max(1, hashes) // BUCKET_HASHES).bit_length())


def bucket_cuts(hashes: np.ndarray, bits: int, width: int = 64) -> np.ndarray:
    """The bounds of the buckets in sorted ``hashes`` of ``width`` bits: bucket ``b`` is
    ``hashes[cuts[b]:cuts[b + 1]]``."""
    if not bits:
        return np.array([0, len(hashes)])
    tops = np.arange(1, 1 << bits, dtype=np.uint64) << np.uint64(width - bits)
    return np.concatenate([[0], np.searchsorted(hashes, tops), [len(hashes)]])


def sort_groups(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A stable order of ``hashes``, where it begins a new hash, and the number of each hash in it."""
    order = np.argsort(hashes, kind="stable")
    ordered = hashes[order]
    new = np.empty(len(ordered), bool)
    new[:1] = True
    np.not_equal(ordered[1:], ordered[:-1], out=new[1:])
    return order, new, np.cumsum(new) - 1


def blobs(values: np.ndarray, cuts: np.ndarray) -> pa.Array:
    """The slices (of rows) of ``values`` between the cuts as binary values, without copying each."""
    width = values.dtype.itemsize * (values.shape[1] if values.ndim > 1 else 1)
    offsets = pa.array((cuts * width).astype(np.int32), pa.int32())
    return pa.BinaryArray.from_buffers(pa.binary(), len(cuts) - 1, [None, offsets.buffers()[1], pa.py_buffer(np.ascontiguousarray(values))])
