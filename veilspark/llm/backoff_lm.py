"""Stupid-backoff language model scores of all documents under a model of all other documents.

Counts of all n-grams up to ``order`` words are gathered over the whole corpus. Each chunk of documents
sends its distinct n-grams with their counts to the hash partition that keeps their totals, and gets
the totals back (see ``cells``); the scores of a document's words are then summed. The document's own
n-grams are taken off the totals, else every n-gram would be a known one. N-grams are told apart by 48
bits of hash within a partition (by 64 where fewer than 2^16 partitions leave no more).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from veilspark.llm import cells
from veilspark.llm.words import filled, ngrams, words_of


def backoff_scores(
    docs: DataFrame,
    order: int = 3,
    alpha: float = 0.4,
    text: str = "text",
    doc_id: str = "doc_id",
    chunk_bytes: int = cells.CHUNK_BYTES,
    share_bytes: int = cells.SHARE_BYTES,
) -> DataFrame:
    """One row per input row: doc_id, n_words, score (sum of log scores), mean_score (null without words).

    A word after the words of its context scores count(context, word) / count(context), counted in all
    other rows. Where that n-gram is unknown, the context loses its first word and the score is taken
    ``alpha`` times; with no context left it is count(word) / words, and 1 / (words + 1) for unknown
    words. Contexts do not reach over the start of a text. Each row counts by itself, also rows that
    share an id. A null or empty text has no words and score 0. Other columns are not read.
    """
    chunks, shares = cells.measured(docs, text, chunk_bytes, share_bytes)
    given = {"order": order, "alpha": alpha, "shares": shares, "bits": cells.width_of(shares, 48)}
    texts = cells.chunked(docs, chunks, text, doc_id)
    counted = texts.groupBy("chunk").applyInArrow(
        cells.each(_count, given), "share int, chunk int, hashes binary, counts binary"
    )
    totals = counted.groupBy("share").applyInArrow(cells.each(_total), "share int, chunk int, totals binary")
    return (
        texts.groupBy("chunk")
        .cogroup(totals.groupBy("chunk"))
        .applyInArrow(cells.pair(_score, given), "doc_id bigint, n_words bigint, score double, mean_score double")
    )


def _grams(given: dict, table: pa.Table):
    """Hashes of the n-grams that end at each word, by n; 0 where the text has too few words before it."""
    table = cells.in_order(table)
    words = words_of(filled(table))
    hashes = words.hashes()
    out = []
    for n in range(1, given["order"] + 1):
        values, ok = ngrams(hashes, words.first, n)
        values >>= np.uint64(64 - given["bits"])
        ends = np.zeros(len(values), np.uint64)
        ends[np.flatnonzero(ok) + n - 1] = np.maximum(values[ok], np.uint64(1))
        out.append(ends)
    return table, words, out


def _distinct(given: dict, grams: list[np.ndarray], words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ascending distinct n-grams, the number of each, and the place of each word's n-grams among them.

    The first stands for the n-gram of no words: it is counted once for each word.
    """
    every = np.concatenate(grams)
    values, places, counts = np.unique(every, return_inverse=True, return_counts=True)
    if not len(values) or values[0]:
        values, counts, places = np.append(np.uint64(0), values), np.append(0, counts), places + 1
    counts[0] = len(words.starts)
    return values, counts, places


def _count(given: dict, table: pa.Table) -> pa.Table:
    table, words, grams = _grams(given, table)
    values, counts, _ = _distinct(given, grams, words)
    counts = counts.astype(np.uint32)
    rows = [
        (share, cells.pack_sorted(values[a:b]), cells.pack(counts[a:b]))
        for share, a, b in cells.cut(values, given["shares"], given["bits"])
    ]
    chunk = table.column("chunk")[0].as_py()
    return pa.table(
        [
            pa.array([r[0] for r in rows], pa.int32()),
            pa.array([chunk] * len(rows), pa.int32()),
            pa.array([r[1] for r in rows], pa.binary()),
            pa.array([r[2] for r in rows], pa.binary()),
        ],
        ["share", "chunk", "hashes", "counts"],
    )


def _total(table: pa.Table) -> pa.Table:
    """For each chunk, the corpus totals of its n-grams, in the order in which it sent them."""
    (values, counts), sizes = cells.together(table, "hashes:sorted", "counts:<u4")
    order = np.argsort(values, kind="stable")
    at = cells.runs(values[order])
    sums = np.add.reduceat(counts[order].astype(np.uint64), at)
    totals = np.zeros(len(values), np.uint64)
    totals[order] = np.repeat(sums, np.diff(at, append=len(values)))
    ends = np.cumsum(sizes)
    blobs = [cells.pack(totals[a:b]) for a, b in zip(ends - sizes, ends, strict=True)]
    return pa.table(
        [table.column("share"), table.column("chunk"), pa.array(blobs, pa.binary())], ["share", "chunk", "totals"]
    )


def _score(given: dict, table: pa.Table, totals: pa.Table) -> pa.Table:
    table, words, grams = _grams(given, table)
    values, counts, places = _distinct(given, grams, words)
    (corpus,), _ = cells.together(totals.sort_by("share"), "totals:<u8")
    total_words = float(corpus[0])
    corpus = corpus.astype(np.int64)
    n, rows = len(words.starts), len(words.counts)
    owner = words.owner()
    other = corpus[places] - 1
    # Where the chunk has an n-gram once, the document has it once; else the document's own are counted.
    shared = np.flatnonzero(counts[places] > 1)
    key = places[shared] * np.int64(rows) + owner[shared % n] if n else shared
    _, back, own = np.unique(key, return_inverse=True, return_counts=True)
    other[shared] = corpus[places[shared]] - own[back]
    # As contexts the same counts are those of the n-gram that ends one word earlier.
    others = other.reshape(len(grams), n)
    known = [(g > 0) & (o > 0) for g, o in zip(grams, others, strict=True)]
    left = total_words - words.counts[owner].astype(float)
    score = np.log(1.0 / (left + 1.0)) if n else np.zeros(0)
    backed = np.zeros(n, np.int64)
    inside = np.arange(n) - np.repeat(words.first[:-1], words.counts)
    most = np.minimum(inside + 1, given["order"])
    done = np.zeros(n, bool)
    for k in range(given["order"], 0, -1):
        here = ~done & known[k - 1] & (most >= k)
        if k > 1:
            before = np.zeros(n)
            before[1:] = others[k - 2][:-1]
        else:
            before = left
        score[here] = np.log(others[k - 1][here] / before[here])
        backed[here] = most[here] - k
        done |= here
    backed[~done] = most[~done] - 1
    score += backed * np.log(given["alpha"])
    sums = np.zeros(rows)
    full = np.flatnonzero(words.counts > 0)
    if n:
        sums[full] = np.add.reduceat(score, words.first[full])
    mean = pa.array(sums / np.maximum(words.counts, 1), pa.float64(), mask=words.counts == 0)
    return pa.table(
        [table.column("doc_id"), pa.array(words.counts, pa.int64()), pa.array(sums, pa.float64()), mean],
        ["doc_id", "n_words", "score", "mean_score"],
    )
