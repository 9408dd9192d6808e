"""Phrase collocations by the two passes of SON: mine shards on their own, then count the union exactly.

A shard is about ``shard_bytes`` of text. If a phrase occurs ``support`` times in all, then in some shard it
occurs more than (support - 1) times that shard's part of all bytes, so mining every shard at that lowered
support misses nothing. The first pass sends a 64-bit hash and a count for each locally frequent phrase;
their union is what can still reach the support. It becomes a bitmap of fixed size, which tells the second
pass whose words to send. That pass counts the candidates in every shard and adds the counts by the words
themselves, so a collision of hashes costs a row and changes nothing.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veilspark.llm.storage import written
from veilspark.llm.words import filled, mix, pieces

#: Bytes of text mined at once; a task holds some 25 times as much beside its batches.
SHARD_BYTES = 6 << 20
#: The bitmap of candidates has 2 ** BITS bits (16 MB), however many candidates there are.
BITS = 27

_SEPARATOR = np.zeros(256, bool)
_SEPARATOR[[*b".,;:!?", 0x0A, 0x0B, 0x0C, 0x0D]] = True
_BLANK = np.zeros(256, bool)
_BLANK[[0x20, 0x09]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def _shards(batches: Iterator[pa.RecordBatch], limit: int) -> Iterator[list[pa.RecordBatch]]:
    """Record batches of (lang, text) grouped to about ``limit`` bytes; a longer text is cut where pieces end."""
    held, size = [], 0
    for batch in batches:
        for piece in pieces(batch, limit=limit):
            lengths = np.asarray(pa.compute.fill_null(pa.compute.binary_length(piece.column("text")), 0), np.int64)
            total = int(lengths.sum())
            if total > 2 * limit:
                longest = int(lengths.argmax())
                if longest:
                    yield [piece.slice(0, longest)]
                yield from ([part] for part in _parts(piece.slice(longest, 1), limit))
                if longest + 1 < piece.num_rows:
                    yield [piece.slice(longest + 1)]
                continue
            if held and size + total > limit:
                yield held
                held, size = [], 0
            held.append(piece)
            size += total
    if held:
        yield held


def _parts(row: pa.RecordBatch, limit: int) -> Iterator[pa.RecordBatch]:
    data = np.frombuffer(row.column("text")[0].as_buffer(), np.uint8)
    at = 0
    while at < len(data):
        end = min(len(data), at + limit)
        while end < len(data):
            cut = np.flatnonzero(_SEPARATOR[data[at:end]])
            if len(cut):
                end = at + int(cut[-1]) + 1
                break
            end = min(len(data), end + limit)  # one piece longer than a shard stays whole
        text = pa.array([data[at:end].tobytes()], pa.binary()).view(pa.string())
        yield pa.record_batch([row.column("lang"), text], ["lang", "text"])
        at = end


class Shard:
    """The phrases of 1 to ``longest`` words of a shard, with their counts."""

    def __init__(self, held: list[pa.RecordBatch], longest: int):
        table = pa.Table.from_batches(held)
        langs = filled(table, "lang").dictionary_encode()
        self.langs = langs.dictionary
        texts = filled(table).cast(pa.large_binary())
        bounds = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
        data = _LOWER[np.frombuffer(texts.buffers()[2] or b"", np.uint8)[bounds[0] : bounds[-1]]]
        bounds = bounds - bounds[0]
        self.bytes = len(data)
        separator = _SEPARATOR[data]
        word = ~(separator | _BLANK[data])
        edge = np.zeros(len(data) + 1, bool)
        edge[bounds] = True
        start, stop = word & edge[:-1], word & edge[1:]
        start[1:] |= word[1:] & ~word[:-1]
        stop[:-1] |= word[:-1] & ~word[1:]
        starts = np.flatnonzero(start)
        lengths = np.flatnonzero(stop) + 1 - starts
        piece = np.cumsum(separator | edge[:-1], dtype=np.int32)[starts]
        # Blanks and separators taken out, the words lie end to end: a string array without a copy per word.
        ends = np.concatenate(([0], np.cumsum(lengths)))
        packed = data[word]
        words = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(ends), pa.py_buffer(packed)])
        words = words.dictionary_encode()
        self.values = words.dictionary
        self.word = np.asarray(words.indices).astype(np.int64)
        del data, separator, word, edge, start, stop, packed, words
        per_text = np.diff(np.searchsorted(starts, bounds))
        self.lang = np.repeat(np.asarray(langs.indices), per_text)
        self.word_hash = np.fromiter((xxhash.xxh3_64_intdigest(v.as_buffer()) for v in self.values), np.uint64, len(self.values))
        self.lang_hash = np.fromiter((xxhash.xxh3_64_intdigest(v.as_py().encode(), 1) for v in self.langs), np.uint64, len(self.langs))
        self.totals = np.bincount(self.lang, minlength=len(self.langs))
        #: By length: the place of one occurrence of each phrase, and the number of occurrences.
        self.found: list[tuple[np.ndarray, np.ndarray]] = []
        _, first, unit, counts = np.unique(
            self.lang.astype(np.int64) * len(self.values) + self.word, return_index=True, return_inverse=True, return_counts=True
        )
        self.found.append((first, counts))
        units, ids = len(first), unit
        for n in range(2, longest + 1):
            last = np.arange(n - 1, len(piece))
            last = last[(piece[last] == piece[last - n + 1])] if len(last) else last
            keys = ids[last - n + 1] * units + unit[last]
            _, first, inverse, counts = np.unique(keys, return_index=True, return_inverse=True, return_counts=True)
            self.found.append(((last - n + 1)[first], counts))
            ids = np.zeros(len(piece), np.int64)
            ids[last - n + 1] = inverse

    def hashes(self, n: int, places: np.ndarray) -> np.ndarray:
        out = self.lang_hash[self.lang[places]]
        for i in range(n):
            out = mix(out + self.word_hash[self.word[places + i]])
        return out

    def phrases(self, n: int, places: np.ndarray) -> pa.Array:
        parts = [self.values.take(pa.array(self.word[places + i])) for i in range(n)]
        joined = pa.compute.binary_join_element_wise(*parts, pa.scalar(b" ", pa.large_binary()))
        return joined.cast(pa.binary()).view(pa.string())


def _mined(batches: Iterator[pa.RecordBatch], longest: int, support: int, total: int, limit: int) -> Iterator[pa.RecordBatch]:
    for held in _shards(batches, limit):
        shard = Shard(held, longest)
        slack = _slack(support, total, min(shard.bytes, limit))
        for n, (places, counts) in enumerate(shard.found, 1):
            often = counts > slack
            hashes = shard.hashes(n, places[often])
            yield pa.record_batch([pa.array(hashes.view(np.int64)), pa.array(counts[often] - slack)], ["hash", "n"])


def _counted(batches: Iterator[pa.RecordBatch], longest: int, limit: int, shared) -> Iterator[pa.RecordBatch]:
    bitmap = np.frombuffer(shared.value, np.uint8)
    names = ["lang", "size", "phrase", "n"]
    for held in _shards(batches, limit):
        shard = Shard(held, longest)
        none = pa.array([""] * len(shard.langs))
        yield pa.record_batch([shard.langs.cast(pa.string()), pa.array(np.zeros(len(none), np.int32)), none, pa.array(shard.totals)], names)
        for n, (places, counts) in enumerate(shard.found, 1):
            bit = shard.hashes(n, places) >> np.uint64(64 - BITS)
            hit = (bitmap[bit >> np.uint64(3)] >> (bit & np.uint64(7)).astype(np.uint8)) & 1 == 1
            places, counts = places[hit], counts[hit]
            lang = shard.langs.take(pa.array(shard.lang[places])).cast(pa.string())
            yield pa.record_batch(
                [lang, pa.array(np.full(len(places), n, np.int32)), shard.phrases(n, places), pa.array(counts)], names
            )


def _slack(support: int, total: int, part: int) -> int:
    """Occurrences that a phrase below the lowered support of a shard may have there."""
    return (support - 1) * part // max(1, total)


def _bitmap(hashes: DataFrame) -> bytes:
    """A bit for the upper BITS bits of each hash, from at most 2 ** (BITS - 6) numbers."""
    cells = hashes.groupBy(F.shiftrightunsigned("hash", 70 - BITS).alias("cell")).agg(
        F.bit_or(F.expr(f"shiftleft(1L, cast(shiftrightunsigned(hash, {64 - BITS}) & 63 AS int))")).alias("bits")
    )
    found = cells.toArrow()
    out = np.zeros(1 << (BITS - 6), np.int64)
    out[np.asarray(found.column("cell"))] = np.asarray(found.column("bits"))
    return out.astype("<i8").tobytes()


def frequent_phrases(
    docs: DataFrame, longest: int = 3, support: int = 10, shard_bytes: int = SHARD_BYTES, text: str = "text", lang: str = "lang"
) -> DataFrame:
    """lang, size, phrase, f: all phrases of 1 to ``longest`` words with f >= ``support`` occurrences in the
    texts of a language, and for each language a row of size 0 with the number of all its words.

    A-Z count as a-z. Texts are cut at ``.,;:!?`` and 0x0A-0x0D into pieces, pieces at 0x20 and 0x09 into
    words; a phrase lies in one piece, and overlapping occurrences count. A null text has no words, a null
    language is ``und``. Repeated rows count each time; other columns are not read. Counts are exact.
    """
    rows = docs.select(
        F.coalesce(F.col(lang).cast("string"), F.lit("und")).alias("lang"),
        F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"),
    )
    total = rows.agg(F.sum(F.octet_length("text")).alias("b")).first()["b"] or 0
    local = rows.mapInArrow(lambda b: _mined(b, longest, support, total, shard_bytes), "hash bigint, n bigint")
    # A shard sends a hash once, so there is nothing to combine before the shuffle.
    unseen = support - 1 if _slack(support, total, shard_bytes) else 0
    union = local.repartition("hash").groupBy("hash").agg(F.sum("n").alias("n")).where(F.col("n") + unseen >= support)
    shared = docs.sparkSession.sparkContext.broadcast(_bitmap(union.select("hash")))
    counted = rows.mapInArrow(
        lambda b: _counted(b, longest, shard_bytes, shared), "lang string, size int, phrase string, n bigint"
    )
    return counted.groupBy("lang", "size", "phrase").agg(F.sum("n").alias("f")).where((F.col("size") == 0) | (F.col("f") >= support))


def _cut_scores(phrases: DataFrame, frequent: DataFrame) -> DataFrame:
    """lang, phrase, a, l, r, score of the lowest-scoring cut of each phrase."""
    words = F.split("phrase", " ")
    cuts = phrases.withColumn("k", F.explode(F.sequence(F.lit(1), F.col("size") - 1))).select(
        "lang",
        "phrase",
        "a",
        "k",
        F.array_join(F.slice(words, F.lit(1), F.col("k")), " ").alias("left"),
        F.array_join(F.slice(words, F.col("k") + 1, F.col("size") - F.col("k")), " ").alias("right"),
    )
    parts = frequent.where("size > 0")
    cuts = cuts.join(parts.select("lang", F.col("phrase").alias("left"), F.col("f").alias("l")), ["lang", "left"])
    cuts = cuts.join(parts.select("lang", F.col("phrase").alias("right"), F.col("f").alias("r")), ["lang", "right"])

    def wide(name: str) -> Column:
        return F.col(name).cast("decimal(16,0)")

    score = F.expr("(1000000BD * wa * wa) div (wl * wr)")
    cuts = cuts.select("*", *(wide(c).alias(f"w{c}") for c in "alr")).withColumn("score", score)
    best = F.min(F.struct("score", "k", "l", "r")).alias("best")
    return cuts.groupBy("lang", "phrase", "a").agg(best).select("lang", "phrase", "a", "best.l", "best.r", "best.score")


def collocations(
    docs: DataFrame, longest: int = 3, support: int = 10, absorb: int = 50, top: int = 2000, shard_bytes: int = SHARD_BYTES,
    text: str = "text", lang: str = "lang",
) -> DataFrame:
    """Each language's ``top`` phrases of 2 to ``longest`` words: lang, rank (from 1), phrase, a, l, r, n, score.

    Phrases, languages and counts are those of ``frequent_phrases``: a is the phrase's count, l and r those of
    the parts before and after a cut, n the number of all words of the language. The score is
    floor(1000000 a a / (l r)) at the cut where it is lowest, of equal ones the first. A phrase goes if a longer
    one of the candidates contains it and has at least ``absorb`` percent of its count. Order: score, then a,
    descending, then the phrase by its bytes. A language without a phrase of this kind has no row; no texts, no rows.
    """
    frequent = written(frequent_phrases(docs, longest, support, shard_bytes, text, lang), "phrases")
    phrases = frequent.where("size > 1").withColumnRenamed("f", "a")
    words = F.split("phrase", " ")
    inner = phrases.where("size > 2").select("lang", "phrase", "a", "size", F.explode(F.sequence(F.lit(2), F.col("size") - 1)).alias("m"))
    inner = inner.select("lang", "phrase", "a", "m", F.explode(F.sequence(F.lit(1), F.col("size") - F.col("m") + 1)).alias("i"))
    inner = inner.select("lang", F.array_join(F.slice(words, F.col("i"), F.col("m")), " ").alias("phrase"), F.col("a").alias("b"))
    longer = inner.groupBy("lang", "phrase").agg(F.max("b").alias("b"))
    left = phrases.join(longer, ["lang", "phrase"], "left").where(f"b IS NULL OR b * 100 < {int(absorb)} * a").drop("b")
    scored = _cut_scores(left, frequent)
    order = (F.desc("score"), F.desc("a"), F.asc("phrase"))
    # The best of each of 64 parts of a language first, so that no task ranks a whole language.
    part = F.pmod(F.xxhash64("phrase"), F.lit(64)).alias("part")
    ranked = scored.select("*", part).withColumn("rank", F.row_number().over(Window.partitionBy("lang", "part").orderBy(*order)))
    ranked = ranked.where(F.col("rank") <= top).withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)))
    totals = frequent.where("size = 0").select("lang", F.col("f").alias("n"))
    ranked = ranked.where(F.col("rank") <= top).join(totals, "lang")
    return ranked.select("lang", F.col("rank").cast("bigint").alias("rank"), "phrase", "a", "l", "r", "n", "score")
