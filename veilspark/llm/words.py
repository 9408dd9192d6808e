"""Words and n-gram hashes of a batch of texts, as numpy arrays.

A word is a maximal run of bytes other than space and 0x09-0x0D. Hashes are 64 bits wide and depend
on the bytes of the words only, so they agree across tasks, machines and runs. Long words are hashed by
BLAKE2b: over hundreds of bytes a polynomial modulo 2^64 has collisions that anyone can write down.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

#: A batch is cut into pieces of about this many bytes of text; one longer text is a piece of its own.
PIECE_BYTES = 4 << 20

#: Words of more bytes are hashed by BLAKE2b, shorter ones by a polynomial over random constants.
LONG_WORD = 64
_LOWERED = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True


def _constants(label: str, n: int) -> np.ndarray:
    """n odd 64-bit constants derived from a label."""
    raw = b"".join(hashlib.blake2b(f"{label}:{i}".encode(), digest_size=8).digest() for i in range(n))
    return np.frombuffer(raw, "<u8") | np.uint64(1)


_BYTE = _constants("byte", 256)
_LOWER = _BYTE.copy()
_LOWER[65:91] = _BYTE[97:123]
_BASE = _constants("base", 1)[0]
_PLACE = _constants("place", 64)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every input bit over the output (in place)."""
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


@dataclass
class Words:
    data: np.ndarray  # the bytes of all texts
    starts: np.ndarray  # first byte of each word
    ends: np.ndarray  # byte after each word
    first: np.ndarray  # first word of each text, and the number of words at the end

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def owner(self) -> np.ndarray:
        """The text that each word belongs to."""
        return np.repeat(np.arange(len(self.first) - 1), self.counts)

    def hashes(self, lower: bool = False) -> np.ndarray:
        """A hash per word; ``lower`` takes A-Z as a-z."""
        lengths = self.ends - self.starts
        out, short = np.zeros(len(lengths), np.uint64), lengths <= LONG_WORD
        if short.any():
            out[short] = self._short(self.starts[short], lengths[short], _LOWER if lower else _BYTE)
        for i in np.flatnonzero(~short):
            word = self.data[self.starts[i] : self.ends[i]].tobytes()
            digest = hashlib.blake2b(word.translate(_LOWERED) if lower else word, digest_size=8).digest()
            out[i] = np.frombuffer(digest, "<u8")[0]
        return out

    def _short(self, starts: np.ndarray, lengths: np.ndarray, value: np.ndarray) -> np.ndarray:
        at = np.concatenate(([0], np.cumsum(lengths)[:-1]))
        inside = np.arange(int(lengths.sum())) - np.repeat(at, lengths)
        powers = np.full(int(lengths.max()), _BASE, np.uint64)
        powers[0] = 1
        powers = np.cumprod(powers, dtype=np.uint64)
        terms = value[self.data[inside + np.repeat(starts, lengths)]]
        terms *= powers[inside]
        return mix(np.add.reduceat(terms, at) + lengths.astype(np.uint64))


def words_of(texts: pa.Array) -> Words:
    """Words of a string array without nulls."""
    texts = texts.cast(pa.large_binary())
    bounds = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    if not len(texts) or bounds[0] == bounds[-1]:
        none = np.zeros(0, np.int64)
        return Words(np.zeros(0, np.uint8), none, none, np.zeros(len(texts) + 1, np.int64))
    data = np.frombuffer(texts.buffers()[2], np.uint8)[bounds[0] : bounds[-1]]
    bounds = bounds - bounds[0]
    space = _SPACE[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[bounds] = True
    starts = edge[:-1].copy()
    starts[1:] |= space[:-1]
    starts &= ~space
    ends = edge[1:].copy()
    ends[:-1] |= space[1:]
    ends &= ~space
    begin = np.flatnonzero(starts)
    return Words(data, begin, np.flatnonzero(ends) + 1, np.searchsorted(begin, bounds))


def ngrams(hashes: np.ndarray, first: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of the n words from each word on, and whether they all lie in the word's own text."""
    total = len(hashes)
    out = np.zeros(total, np.uint64)
    for j in range(min(n, total)):
        out[: total - j] += hashes[j:] * _PLACE[j % 64]
        if j % 64 == 63:
            mix(out)
    ok = np.arange(total) + n <= np.repeat(first[1:], np.diff(first))
    return mix(out + np.uint64(n)), ok


def pieces(batch: pa.RecordBatch, column: str = "text", limit: int = PIECE_BYTES) -> Iterator[pa.RecordBatch]:
    """A record batch in slices of about ``limit`` bytes of text each."""
    lengths = np.asarray(pa.compute.fill_null(pa.compute.binary_length(batch.column(column)), 0), np.int64)
    piece = (np.cumsum(lengths) - lengths) // limit
    cuts = np.concatenate(([0], np.flatnonzero(np.diff(piece)) + 1, [len(lengths)])) if len(lengths) else [0]
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        yield batch.slice(a, b - a)


def filled(batch: pa.RecordBatch | pa.Table, column: str = "text") -> pa.Array:
    """A text column with nulls as empty texts, in one array."""
    values = batch.column(column)
    if isinstance(values, pa.ChunkedArray):
        values = values.cast(pa.large_string()).combine_chunks()
    if isinstance(values, pa.ChunkedArray):
        values = pa.concat_arrays(values.chunks) if values.num_chunks else pa.array([], pa.large_string())
    return pa.compute.fill_null(values, "")
