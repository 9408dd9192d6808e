"""Fill-in-middle: cut a text after whole lines into prefix, middle and suffix and put the middle last.

Lines are found by SWAR: the UTF-8 bytes of a batch are viewed as 64-bit words, arithmetic on a word
marks its line feeds, ``bitwise_count`` counts the marks, a search in the running counts finds the word
that holds the k-th line feed, and a select inside the word finds its byte. No text is split.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilspark.llm.words import pieces

MARKS = ("<P>", "<S>", "<M>")

_EACH = np.uint64(0x0101010101010101)
_HIGH = np.uint64(0x8080808080808080)
_REST = np.uint64(0x7F7F7F7F7F7F7F7F)
_FEEDS = np.uint64(0x0A0A0A0A0A0A0A0A)
_NEWLINE = 0x0A


def line_feeds(words: np.ndarray) -> np.ndarray:
    """The high bit of each byte that is a line feed, for eight bytes at a time; no carry leaves a byte."""
    x = words ^ _FEEDS
    return ~(((x & _REST) + _REST) | x) & _HIGH


def followers(words: np.ndarray) -> np.ndarray:
    """The high bit of each byte that continues a character (binary 10xxxxxx)."""
    return words & ~(words << np.uint64(1)) & _HIGH


class Marked:
    """Marks over a run of bytes with rank and select; byte 0 is the lowest byte of word 0."""

    def __init__(self, marks: np.ndarray):
        self.marks = marks
        self.upto = np.concatenate(([0], np.cumsum(np.bitwise_count(marks), dtype=np.int64)))

    def rank(self, at: np.ndarray) -> np.ndarray:
        """The number of marks before each byte position."""
        word, inside = at >> 3, (at & 7).astype(np.uint64)
        below = (np.uint64(1) << (inside << np.uint64(3))) - np.uint64(1)
        last = self.marks[np.minimum(word, len(self.marks) - 1)]
        return self.upto[word] + np.bitwise_count(last & below)

    def select(self, k: np.ndarray) -> np.ndarray:
        """The byte position of the k-th mark, k from 1."""
        word = np.searchsorted(self.upto, k, "left") - 1
        rest = (k - self.upto[word]).astype(np.uint64)
        # Byte j of ``sums`` is the number of marks in bytes 0 to j: a product adds them up.
        sums = (self.marks[word] >> np.uint64(7)) * _EACH
        reached = ((sums | _HIGH) - rest * _EACH) & _HIGH
        return (word << 3) + 8 - np.bitwise_count(reached)


def _cut(batches: Iterator[pa.RecordBatch], marks: tuple[bytes, bytes, bytes]) -> Iterator[pa.RecordBatch]:
    first, third, second = marks
    for batch in batches:
        for piece in pieces(batch):
            texts = piece.column("text").cast(pa.large_binary())
            bounds = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
            raw = memoryview(texts.buffers()[2] or b"")[int(bounds[0]) : int(bounds[-1])]
            bounds = bounds - bounds[0]
            data = np.zeros((len(raw) + 8) // 8 * 8, np.uint8)
            data[: len(raw)] = np.frombuffer(raw, np.uint8)
            words = data.view("<u8").astype(np.uint64, copy=False)
            feeds, inner = Marked(line_feeds(words)), Marked(followers(words))

            begin, end = bounds[:-1], bounds[1:]
            before = feeds.rank(begin)
            whole = feeds.rank(end) - before
            n = whole + ((end > begin) & (data[np.maximum(end - 1, 0)] != _NEWLINE))

            def after(units: np.ndarray) -> np.ndarray:
                """The byte position after so many lines of each text."""
                out = np.where(units > whole, end, begin)
                some = np.flatnonzero((units > 0) & (units <= whole))
                out[some] = feeds.select((before + units)[some]) + 1
                return out

            one, two = np.asarray(piece.column("h1")) % (n + 1), np.asarray(piece.column("h2")) % (n + 1)
            a, b = after(np.minimum(one, two)), after(np.maximum(one, two))
            plain = np.asarray(piece.column("plain").cast(pa.uint8())).astype(bool)
            spm = np.asarray(piece.column("spm").cast(pa.uint8())).astype(bool)
            outputs = []
            for i, (s, p, q, e) in enumerate(zip(begin.tolist(), a.tolist(), b.tolist(), end.tolist(), strict=True)):
                if plain[i]:
                    outputs.append(bytes(raw[s:e]))
                elif spm[i]:
                    outputs.append(b"".join((third, raw[q:e], first, raw[s:p], second, raw[p:q])))
                else:
                    outputs.append(b"".join((first, raw[s:p], third, raw[q:e], second, raw[p:q])))
            form = np.where(plain, "plain", np.where(spm, "spm", "psm"))
            chars = [(q - p) - (inner.rank(q) - inner.rank(p)) for p, q in ((begin, a), (a, b))]
            yield pa.record_batch(
                [
                    piece.column("doc_id"),
                    pa.array(n),
                    pa.array(form.tolist(), pa.string()),
                    *(pa.array(c, pa.int64(), mask=plain) for c in chars),
                    pa.array(outputs, pa.binary()).view(pa.string()),
                ],
                ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"],
            )


def fill_in_middle(
    docs: DataFrame,
    rate: int = 100,
    spm: int = 50,
    seed: int = 7,
    marks: tuple[str, str, str] = MARKS,
    text: str = "text",
    doc_id: str = "doc_id",
) -> DataFrame:
    """One row per input row: doc_id, n, form, prefix_chars, middle_chars, output.

    n is the number of lines, each with its line feed; a text that ends in one has no empty line after
    it. The cuts, and whether the form is ``psm`` (prefix, suffix, middle) or ``spm`` (suffix, prefix,
    middle; ``spm`` of a hundred), come from the SHA-256 of seed and id, so reruns and repeated rows
    agree. ``rate`` of a hundred texts are changed. The others are ``plain``, as are empty texts and those
    that hold one of ``marks`` (for prefix, suffix, middle): they come out as they are, with null sizes. A
    null text counts as empty, a null id as an empty string. Texts of any length are taken whole; columns
    other than ``doc_id`` and ``text`` are not read. No shuffle.
    """
    if any(not re.fullmatch(r"<[^<>]+>", m) for m in marks) or len(set(marks)) < 3:
        raise ValueError("marks are three different names in angle brackets")
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(doc_id).cast("string"), F.lit(""))), 256)
    numbers = [F.conv(F.substring("digest", 8 * i + 1, 8), 16, 10).cast("bigint") for i in range(4)]
    value = F.coalesce(F.col(text).cast("string"), F.lit(""))
    rows = docs.select(F.col(doc_id).alias("doc_id"), value.alias("text"), digest.alias("digest"))
    held = F.col("text").contains(marks[0]) | F.col("text").contains(marks[1]) | F.col("text").contains(marks[2])
    rows = rows.select(
        "doc_id",
        "text",
        numbers[0].alias("h1"),
        numbers[1].alias("h2"),
        ((F.col("text") == "") | held | (numbers[2] % 100 >= rate)).alias("plain"),
        (numbers[3] % 100 < spm).alias("spm"),
    )
    kind = dict(rows.dtypes)["doc_id"]
    encoded = tuple(m.encode() for m in marks)
    return rows.mapInArrow(
        lambda b: _cut(b, encoded),
        f"doc_id {kind}, n bigint, form string, prefix_chars bigint, middle_chars bigint, output string",
    )


def restored(output: Column, form: Column, marks: tuple[str, str, str] = MARKS) -> Column:
    """The text that ``fill_in_middle`` made ``output`` from."""
    parts = F.split(output, "|".join(re.escape(m) for m in marks), -1)
    prefix_first = F.concat(F.get(parts, F.lit(1)), F.get(parts, F.lit(3)), F.get(parts, F.lit(2)))
    suffix_first = F.concat(F.get(parts, F.lit(2)), F.get(parts, F.lit(3)), F.get(parts, F.lit(1)))
    return F.when(form == "psm", prefix_first).when(form == "spm", suffix_first).otherwise(output)
