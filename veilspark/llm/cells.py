"""Exchange of hash sets between chunks of documents and partitions of the hash space.

Documents are dealt to chunks by a hash of their id. A chunk sends each of its distinct hashes once,
to the partition that the hash belongs to, as one packed cell per (partition, chunk). A partition sees
all cells of its part of the hash space, combines them and answers each chunk with a packed cell. So a
hash that a third of all documents share costs one entry per chunk, never one per occurrence.
"""

from __future__ import annotations

import math

import numpy as np
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bytes of text in a chunk, and in the text whose hashes make up one partition. Raise both with the
#: memory of a task: cells number (bytes / CHUNK_BYTES) x (bytes / SHARE_BYTES).
CHUNK_BYTES = 8 << 20
SHARE_BYTES = 16 << 20


def measured(docs: DataFrame, text: str, chunk_bytes: int, share_bytes: int) -> tuple[int, int]:
    """Numbers of chunks and of hash partitions for a table, from the bytes of all its texts."""
    total = docs.agg(F.sum(F.octet_length(text)).alias("b")).first()["b"] or 0
    return max(1, math.ceil(total / chunk_bytes)), max(1, math.ceil(total / share_bytes))


def share_of(hashes: np.ndarray, shares: int) -> np.ndarray:
    """The partition of each hash: equal ranges of its upper 32 bits."""
    return ((hashes >> np.uint64(32)) * np.uint64(shares)) >> np.uint64(32)


def pack(values: np.ndarray) -> bytes:
    """Unsigned or signed integers as compressed byte planes."""
    planes = np.ascontiguousarray(values).view(np.uint8).reshape(-1, values.dtype.itemsize).T
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(planes).tobytes())


def unpack(blob: bytes, dtype: str) -> np.ndarray:
    size = np.dtype(dtype).itemsize
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), np.uint8)
    return np.ascontiguousarray(raw.reshape(size, -1).T).view(dtype).reshape(-1)


def pack_sorted(values: np.ndarray) -> bytes:
    """Ascending unsigned 64-bit integers, as differences."""
    return pack(np.diff(values, prepend=np.uint64(0)))


def unpack_sorted(blob: bytes) -> np.ndarray:
    return np.cumsum(unpack(blob, "<u8"), dtype=np.uint64)


def runs(ordered: np.ndarray) -> np.ndarray:
    """Starts of the runs of equal values in an ordered array."""
    if not len(ordered):
        return np.zeros(0, np.int64)
    return np.flatnonzero(np.concatenate(([True], ordered[1:] != ordered[:-1])))


def member(values: np.ndarray, ordered: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Whether each value is in an ascending array, and where."""
    if not len(ordered):
        return np.zeros(len(values), bool), np.zeros(len(values), np.int64)
    at = np.minimum(np.searchsorted(ordered, values), len(ordered) - 1)
    return ordered[at] == values, at


def width_of(shares: int, spare: int) -> int:
    """Bits kept of a hash so that ``spare`` bits tell hashes of one partition apart, at any size."""
    return min(64, spare + math.ceil(math.log2(shares)) if shares > 1 else spare)


def cut(values: np.ndarray, shares: int, bits: int) -> list[tuple[int, int, int]]:
    """Slices (partition, from, to) of ascending hashes of ``bits`` bits."""
    if not len(values):
        return []
    parts = share_of(values << np.uint64(64 - bits), shares).astype(np.int64)
    at = runs(parts)
    return list(zip(parts[at].tolist(), at.tolist(), [*at[1:].tolist(), len(parts)], strict=True))


def together(table, *columns: str) -> tuple[list[np.ndarray], np.ndarray]:
    """The packed columns of all cells of a table, each as one array, and the sizes of the cells.

    A column name ends in ``:`` and the type of its values; ``name:sorted`` names ascending hashes.
    """
    out, sizes = [], np.zeros(0, np.int64)
    for spec in columns:
        name, kind = spec.split(":")
        blobs = table.column(name).to_pylist()
        arrays = [unpack_sorted(b) if kind == "sorted" else unpack(b, kind) for b in blobs]
        sizes = np.array([len(a) for a in arrays], np.int64)
        out.append(np.concatenate(arrays) if arrays else np.zeros(0, np.uint64 if kind == "sorted" else kind))
    return out, sizes


def chunked(docs: DataFrame, chunks: int, text: str, doc_id: str, *extra: str) -> DataFrame:
    """(chunk, doc_id, text): rows of one id share a chunk; rows without id are spread by their text."""
    return docs.select(
        F.pmod(F.xxhash64(F.coalesce(F.col(doc_id), F.xxhash64(text))), F.lit(chunks)).cast("int").alias("chunk"),
        F.col(doc_id).cast("bigint").alias("doc_id"),
        F.col(text).cast("string").alias("text"),
        *extra,
    )


def in_order(table):
    """A chunk's rows by id, then text; rows without id come last."""
    import pyarrow.compute as pc

    keys = [("doc_id", "ascending"), ("text", "ascending")]
    return table.take(pc.sort_indices(table, sort_keys=keys, null_placement="at_end"))


def each(fn, *given):
    """A function of one group's table for applyInArrow."""
    return lambda table: fn(*given, table)


def pair(fn, *given):
    """A function of the tables of two groups of one key for applyInArrow."""
    return lambda left, right: fn(*given, left, right)
