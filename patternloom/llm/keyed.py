"""Hashed keys of batches, dealt to buckets as packed arrays.

A batch is what one task has read so far, up to a number of keys. Keys that repeat inside a batch are combined there, so
a key that a third of all documents hold costs one entry per batch. A bucket is a range of the hash's top bits;
the number of buckets follows the input's size, so a bucket's arrays fit one task."""

from __future__ import annotations

import numpy as np


def bucket_bits(mb: float, keys_per_mb: float = 300_000, keys_per_bucket: float = 600_000) -> int:
    """Top bits that number the buckets, so that one has about keys_per_bucket keys; 64 buckets at least."""
    return int(min(40, max(6, np.ceil(np.log2(max(1.0, mb * keys_per_mb / keys_per_bucket))))))


def slices(keys: np.ndarray, bits: int) -> list[tuple[int, int, int]]:
    """(bucket, from, to) of the non-empty buckets of sorted 64-bit keys."""
    if not len(keys):
        return []
    bucket = (keys >> np.uint64(64 - bits)).astype(np.int64)
    cuts = np.flatnonzero(np.diff(bucket)) + 1
    starts = np.concatenate([[0], cuts])
    return list(zip(bucket[starts].tolist(), starts.tolist(), np.concatenate([cuts, [len(keys)]]).tolist()))


def pack(keys: np.ndarray, width: int) -> bytes:
    """The low `width` bytes of each value."""
    return np.ascontiguousarray(keys.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width]).tobytes()


def unpack(data: bytes, width: int) -> np.ndarray:
    raw = np.frombuffer(data, np.uint8).reshape(-1, width)
    out = np.zeros((len(raw), 8), np.uint8)
    out[:, :width] = raw
    return out.view("<u8").ravel()


def repeated(keys: np.ndarray) -> np.ndarray:
    """Which of the keys occur more than once."""
    order = np.argsort(keys, kind="stable")
    same = keys[order][1:] == keys[order][:-1]
    out = np.zeros(len(keys), bool)
    out[order[1:][same]] = True
    out[order[:-1][same]] = True
    return out


def joined(column) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all values of a binary Arrow column, and each value's length (null: 0)."""
    import pyarrow as pa

    column = pa.concat_arrays([c.cast(pa.binary()) for c in column.chunks]) if isinstance(column, pa.ChunkedArray) and column.num_chunks else column
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(0, np.int64)
    column = column.fill_null(b"")
    offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)
    return data[offsets[0] : offsets[-1]], np.diff(offsets)


def binary(data, lengths):
    """A binary Arrow column of values that follow each other in data."""
    import pyarrow as pa

    offsets = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(lengths), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(data).tobytes())])


def shared(key: np.ndarray, marked: np.ndarray) -> np.ndarray:
    """Which of the keys occur more than once or are equal to a marked one."""
    order = np.argsort(key)
    ranked = key[order]
    first = np.flatnonzero(np.concatenate([[True], ranked[1:] != ranked[:-1]]))
    size = np.diff(np.concatenate([first, [len(key)]]))
    out = np.empty(len(key), bool)
    out[order] = np.repeat((size > 1) | np.logical_or.reduceat(marked[order], first), size)
    return out
