"""Language by compression: the language whose raw-content zstd dictionary makes a text smallest.

Case says nothing of a language: dictionaries and texts are lower-cased. A dictionary holds whole
texts of one language, of about ``DICTIONARY`` bytes together at most. Texts are compressed in blocks
of ``BLOCK`` bytes, so that a long text does not become its own dictionary, and the sizes of all its
blocks are summed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

DICTIONARY = 96 << 10
#: Texts longer than this are not learned from, and no more than so many texts of a language.
LEARN_BYTES, LEARN_ROWS = 8 << 10, 400
BLOCK = 4 << 10
LEVEL = 3

_LETTER = regex.compile(r"\p{L}")


def dictionaries(labelled: DataFrame) -> list[tuple[str, bytes]]:
    """(lang, dictionary), the commonest language first, from rows (doc_id, text, lang) without nulls.

    The texts are those with the smallest hash of their id and text, repeated rows once. Only hashes under
    a bound that leaves about 4 * LEARN_ROWS rows of a language, however many it has, are ranked, and
    DICTIONARY bytes of them reach the driver.
    """
    order = Window.partitionBy("lang").orderBy("hash", "text")
    labelled = labelled.withColumn("hash", F.xxhash64("doc_id", "text"))
    fits = F.octet_length("text").between(1, LEARN_BYTES)
    counts = (
        labelled.groupBy("lang")
        .agg(F.count(F.lit(1)).alias("n"), F.approx_count_distinct(F.when(fits, F.col("hash"))).alias("fitting"))
        .collect()
    )
    sizes = {r["lang"]: r["n"] for r in counts}
    most = [(r["lang"], min(2**63 - 1, (4 * LEARN_ROWS << 64) // max(1, r["fitting"]) - 2**63)) for r in counts]
    bounds = labelled.sparkSession.createDataFrame(most, "lang string, most bigint")
    sample = (
        labelled.where(fits)
        .join(F.broadcast(bounds), "lang")  # one row per language, as on the driver
        .where("hash <= most")
        .select("lang", "hash", "text")
        .distinct()
        .withColumn("no", F.row_number().over(order))
        .where(F.col("no") <= LEARN_ROWS)
        .withColumn("upto", F.sum(F.octet_length("text") + 1).over(order))
        .where(F.col("upto") <= DICTIONARY)
    )
    texts: dict[str, list[bytes]] = {}
    for row in sample.select("lang", "no", "text").orderBy("lang", "no").toLocalIterator():
        texts.setdefault(row["lang"], []).append(row["text"].lower().encode())
    return sorted(((k, b"\n".join(v)) for k, v in texts.items()), key=lambda x: (-sizes[x[0]], x[0]))


def _sized(batches: Iterator[pa.RecordBatch], known: list[tuple[str, bytes]], least: float) -> Iterator[pa.RecordBatch]:
    models = []
    for _, data in known:
        made = zstandard.ZstdCompressionDict(data, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        made.precompute_compress(level=LEVEL)
        models.append(
            zstandard.ZstdCompressor(
                level=LEVEL, dict_data=made, write_content_size=False, write_checksum=False, write_dict_id=False
            )
        )
    for batch in batches:
        names, scores, sure = [], [], []
        for text in batch.column("text"):
            text = text.as_py()
            if text is None or not models or not _LETTER.search(text):
                names.append("und")
                scores.append(0.0)
                sure.append(False)
                continue
            data = text.lower().encode()
            blocks = [data[a : a + BLOCK] for a in range(0, len(data), BLOCK)]
            sizes = np.array([sum(len(m.compress(b)) for b in blocks) for m in models])
            best = int(sizes.argmin())
            second = np.delete(sizes, best).min() if len(sizes) > 1 else sizes[best] * 2
            margin = 1.0 - sizes[best] / second
            names.append(known[best][0])
            scores.append(float(margin))
            sure.append(bool(margin >= least))
        yield pa.record_batch(
            [
                *(batch.column(i) for i, n in enumerate(batch.schema.names) if n != "text"),
                pa.array(names, pa.string()),
                pa.array(scores, pa.float64()),
                pa.array(sure, pa.bool_()),
            ],
            [*(n for n in batch.schema.names if n != "text"), "lang_pred", "score", "accepted"],
        )


def detect_language(
    docs: DataFrame, held_out: Column, least: float = 0.01, text: str = "text", lang: str = "lang", doc_id: str = "doc_id"
) -> DataFrame:
    """One row per input row: doc_id, held_out, lang_pred, score, accepted.

    Learns from text and lang of the rows that are not ``held_out`` (or for which that is null), and
    predicts from the text alone. score is the part by which the best language's size is below the
    second best's; a margin under ``least`` is rejected (``accepted`` is false, lang_pred still names
    the best). ``und`` with score 0 stands for a null text, one without letters, and for every text if
    there is nothing to learn from. Of languages with equal sizes, the commonest in the learned rows wins.
    """
    rows = docs.select(
        F.col(doc_id).alias("doc_id"),
        F.coalesce(held_out, F.lit(False)).alias("held_out"),
        F.col(text).cast("string").alias("text"),
        F.col(lang).cast("string").alias("lang"),
    )
    known = dictionaries(rows.where("NOT held_out AND lang IS NOT NULL AND text IS NOT NULL").drop("held_out"))
    kind = dict(rows.dtypes)["doc_id"]
    return rows.select("doc_id", "held_out", "text").mapInArrow(
        lambda b: _sized(b, known, least), f"doc_id {kind}, held_out boolean, lang_pred string, score double, accepted boolean"
    )
