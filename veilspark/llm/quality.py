"""Quality classifier by importance: hashed n-gram models of target and raw text, Gumbel top-k.

Raw text is every document, target text the documents labelled good. Both are bags of hashed words
and word pairs, where a word is a run of letters and digits or of other marks. A document's log
weight is the mean log ratio of the two models over its n-grams, times ``SHARPNESS``; with Gumbel noise
added, the k largest are a sample without replacement in proportion to the weights.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilspark.llm.storage import written
from veilspark.llm.words import Words, filled, ngrams, pieces, words_of

CELLS = 1 << 14
#: Labelled rows used, at most: those with the smallest hash of their id.
LABELLED = 20_000
SHARPNESS = 100.0
#: A good row lost counts as much as so many poor rows passed, each as a part of its kind.
COST = 10.0

_MARK = np.ones(256, bool)
_MARK[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = False


def features(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The cells of all n-grams of all texts, and the text of each."""
    words = words_of(texts)
    if not len(words.starts):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    # Cut each word where letters and marks meet.
    mark = _MARK[words.data]
    turn = np.flatnonzero(mark[1:] != mark[:-1]) + 1
    word = np.searchsorted(words.starts, turn, "right") - 1
    turn = turn[(word >= 0) & (turn > words.starts[word]) & (turn < words.ends[word])]
    starts = np.sort(np.concatenate((words.starts, turn)))
    ends = np.sort(np.concatenate((words.ends, turn)))
    bounds = np.concatenate((words.starts, [len(words.data)]))[words.first]
    parts = Words(words.data, starts, ends, np.searchsorted(starts, bounds))
    hashes, owner = parts.hashes(lower=True), parts.owner()
    pairs, ok = ngrams(hashes, parts.first, 2)
    values = np.concatenate((hashes, pairs[ok]))
    return (values % np.uint64(CELLS)).astype(np.int64), np.concatenate((owner, owner[ok]))


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    raw, target = np.zeros(CELLS, np.int64), np.zeros(CELLS, np.int64)
    for batch in batches:
        for piece in pieces(batch):
            cells, owner = features(filled(piece))
            good = np.asarray(pa.compute.fill_null(piece.column("good"), False).cast(pa.uint8())).astype(bool)
            raw += np.bincount(cells, minlength=CELLS)
            target += np.bincount(cells[good[owner]], minlength=CELLS)
    at = np.flatnonzero(raw)
    yield pa.record_batch([pa.array(at), pa.array(raw[at]), pa.array(target[at])], ["cell", "raw", "target"])


def _scored(batches: Iterator[pa.RecordBatch], ratio: np.ndarray) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for piece in pieces(batch):
            cells, owner = features(filled(piece))
            n = np.bincount(owner, minlength=piece.num_rows)
            total = np.bincount(owner, ratio[cells], minlength=piece.num_rows)
            mean = pa.array(total / np.maximum(n, 1), mask=n == 0)
            yield pa.record_batch([piece.column("doc_id"), piece.column("row"), pa.array(n), mean], ["doc_id", "row", "n_grams", "score"])


def _threshold(good: np.ndarray, bad: np.ndarray) -> float:
    """The weight that tells the labelled rows apart at least cost: the middle of the best gap."""
    if not len(good) or not len(bad):
        return -np.inf
    values = np.concatenate((good, bad))
    order = np.argsort(values)
    label = np.concatenate((np.ones(len(good)), np.zeros(len(bad))))[order]
    lost = np.concatenate(([0], np.cumsum(label))) / len(good)
    passed = 1 - np.concatenate(([0], np.cumsum(1 - label))) / len(bad)
    errors = COST * lost + passed
    edges = np.concatenate(([values.min() - 1], np.sort(values), [values.max() + 1]))
    best = np.flatnonzero(errors <= errors.min() + 1e-12)
    at = best[np.argmax(edges[best + 1] - edges[best])]
    return float((edges[at] + edges[at + 1]) / 2)


def quality_weights(
    docs: DataFrame,
    labels: DataFrame,
    keep: float | None = None,
    seed: int = 11,
    labelled: int = LABELLED,
    text: str = "text",
    doc_id: str = "doc_id",
    label: str = "quality",
) -> DataFrame:
    """One row per input row: doc_id, row (hash of id and text), n_grams, score (mean log
    ratio), weight (with noise), kept.

    ``kept`` marks the k rows of greatest weight. k is ``keep`` times the rows that have n-grams (ties
    at the last place stay); by default, it is their number above the weight that best tells the
    labelled rows with label 1 from those with 0. A text without words has no score and is not kept.
    Without rows of both labels all others are kept. At most ``labelled`` labelled rows are used, chosen
    by a hash of their id; a doc_id with several labels counts as good if one is 1. Models and weights
    cover all rows. Rows without id are weighed, never labelled; other columns are not read.
    """
    sample = written(
        labels.where(F.col(label).isin(0, 1) & F.col(doc_id).isNotNull())
        .groupBy(F.col(doc_id).alias("doc_id"))
        .agg((F.max(label) == 1).alias("good"))
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(labelled),
        "labelled",
    )
    rows = docs.select(
        F.col(doc_id).alias("doc_id"),
        F.col(text).cast("string").alias("text"),
        F.xxhash64(F.lit(seed), F.col(doc_id), F.col(text).cast("string")).alias("row"),
    )
    counts = (
        rows.select("doc_id", "text")
        .join(F.broadcast(sample), "doc_id", "left")
        .select("text", "good")
        .mapInArrow(_counted, "cell bigint, raw bigint, target bigint")
        .groupBy("cell")
        .agg(F.sum("raw").alias("raw"), F.sum("target").alias("target"))
        .toArrow()
    )
    raw, target = np.zeros(CELLS), np.zeros(CELLS)
    cell = np.asarray(counts.column("cell"))
    raw[cell], target[cell] = np.asarray(counts.column("raw")), np.asarray(counts.column("target"))
    ratio = np.log((target + 0.5) / (target.sum() + 0.5 * CELLS)) - np.log((raw + 0.5) / (raw.sum() + 0.5 * CELLS))
    if not target.any():
        ratio[:] = 0.0
    kind = dict(rows.dtypes)["doc_id"]
    uniform = (F.shiftrightunsigned("row", 11).cast("double") + 0.5) / F.lit(2.0**53)
    weighed = written(
        rows.mapInArrow(lambda b: _scored(b, ratio), f"doc_id {kind}, row bigint, n_grams bigint, score double").withColumn(
            "weight", F.col("score") * SHARPNESS - F.log(-F.log(uniform))
        ),
        "weights",
    )
    if keep is None:
        seen = weighed.where("weight IS NOT NULL").join(F.broadcast(sample), "doc_id").select("weight", "good").toArrow()
        good = np.asarray(seen.column("good").to_pylist(), bool)
        weight = np.asarray(seen.column("weight"), float)
        least = _threshold(weight[good], weight[~good])
    else:
        least = kth_largest(weighed.where("weight IS NOT NULL"), "weight", keep)
    return weighed.select(
        "doc_id", "row", "n_grams", "score", "weight", F.coalesce(F.col("weight") >= F.lit(least), F.lit(False)).alias("kept")
    )


def kth_largest(df: DataFrame, column: str, part: float, bins: int = 4096) -> float:
    """The value at the end of the largest ``part`` of all rows, narrowed down by histograms of ``bins`` cells."""
    k, low, high = None, None, None
    while True:
        if k is None:
            n, low, high = df.agg(F.count(column), F.min(column), F.max(column)).first()
            k = round(n * part)
            if k <= 0:
                return float("inf")
        if low == high:
            return low
        width = (high - low) / bins
        cell = F.least(F.lit(bins - 1), F.floor((F.col(column) - low) / width)).alias("c")
        inside = df.where(F.col(column).between(low, high))
        cells = inside.groupBy(cell).agg(F.count(F.lit(1)).alias("n"), F.min(column).alias("a"), F.max(column).alias("b"))
        for row in cells.orderBy(F.desc("c")).collect():
            if k <= row["n"]:
                if (low, high) == (row["a"], row["b"]):
                    return low
                low, high = row["a"], row["b"]
                break
            k -= row["n"]


def drop_poor(docs: DataFrame, labels: DataFrame, text: str = "text", doc_id: str = "doc_id", **options) -> DataFrame:
    """The documents that ``quality_weights`` keeps, with all their columns.

    Texts without words go, null ones included; repeated rows go or stay together. Without rows of both labels
    all others stay. An empty table stays empty; columns may have any names, ids any type.
    """
    seed = options.setdefault("seed", 11)
    kept = quality_weights(docs, labels, text=text, doc_id=doc_id, **options).where("kept")
    kept = kept.select(F.col("row").alias("_kept_row")).distinct()
    return docs.join(kept, F.xxhash64(F.lit(seed), docs[doc_id], docs[text].cast("string")) == kept["_kept_row"], "left_semi")
