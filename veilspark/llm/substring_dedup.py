"""Removal of word sequences that also start earlier in the corpus: fixed-block anchors.

Every text is cut into non-overlapping reference blocks of ``block`` words, counted from its start.
As ``width >= 2 * block - 1``, a window of ``width`` words holds at least one whole reference block of
the text it lies in. The blocks are indexed by hash, every rolling window of ``block`` words of every
text probes the index, and each hit is extended to the windows of ``width`` words around it. Of equal
windows the earliest stays; the words that the others cover, together the maximal exact repeats, go.

Index, probes and windows are exchanged as packed sets of hashes (see ``cells``): three rounds over
the same chunks of documents, whose texts are shuffled once. Probes may be mistaken for hits (they
keep 32 bits within a partition), which only costs work; windows are compared by 64 bits.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from veilspark.llm import cells
from veilspark.llm.words import filled, ngrams, words_of

_LAST = np.int64(2**63 - 1)


def remove_repeats(
    docs: DataFrame,
    width: int = 20,
    block: int = 10,
    text: str = "text",
    doc_id: str = "doc_id",
    chunk_bytes: int = cells.CHUNK_BYTES,
    share_bytes: int = cells.SHARE_BYTES,
) -> DataFrame:
    """One row per input row: doc_id, n_words, n_removed, spans (removed [from, to) by word), kept_text.

    Earlier means a smaller doc_id (an integer), or an earlier start in the same document. Rows that
    share a doc_id follow each other by text; rows without one come last. A null text has no words and
    an empty kept_text; texts shorter than ``width`` words lose nothing. Other columns are not read.
    """
    if width < 2 * block - 1:
        raise ValueError("a window must hold a whole block: width >= 2 * block - 1")
    chunks, shares = cells.measured(docs, text, chunk_bytes, share_bytes)
    bits = cells.width_of(shares, 32)
    given = {"width": width, "block": block, "shares": shares, "bits": bits}
    texts = cells.chunked(docs, chunks, text, doc_id)
    probes = texts.groupBy("chunk").applyInArrow(
        cells.each(_probe, given), "share int, chunk int, hashes binary, marks binary"
    )
    hits = probes.groupBy("share").applyInArrow(cells.each(_hits), "share int, chunk int, hashes binary")
    windows = (
        texts.groupBy("chunk")
        .cogroup(hits.groupBy("chunk"))
        .applyInArrow(cells.pair(_windows, given), "share int, chunk int, hashes binary, ids binary, many binary")
    )
    repeats = windows.groupBy("share").applyInArrow(cells.each(_repeats), "share int, chunk int, hashes binary, first binary")
    return (
        texts.groupBy("chunk")
        .cogroup(repeats.groupBy("chunk"))
        .applyInArrow(
            cells.pair(_kept, given),
            "doc_id bigint, n_words bigint, n_removed bigint, spans array<struct<from:bigint,to:bigint>>, kept_text string",
        )
    )


def _read(table: pa.Table):
    table = cells.in_order(table)
    words = words_of(filled(table))
    return table, words, words.hashes()


def _blocks(given: dict, words, hashes):
    """Hash of the block of words from each word on, and whether it lies in one text."""
    values, ok = ngrams(hashes, words.first, given["block"])
    return values >> np.uint64(64 - given["bits"]), ok


def _probe(given: dict, table: pa.Table) -> pa.Table:
    """The chunk's distinct rolling blocks; marks: 1 if several in the chunk, 2 if one is a reference block."""
    table, words, hashes = _read(table)
    values, ok = _blocks(given, words, hashes)
    inside = np.arange(len(hashes)) - np.repeat(words.first[:-1], words.counts)
    reference = (inside % given["block"] == 0)[ok]
    values = values[ok]
    order = np.argsort(values, kind="stable")
    values, reference = values[order], reference[order]
    at = cells.runs(values)
    marks = (np.diff(at, append=len(values)) > 1).astype(np.uint8)
    if len(at):
        marks |= np.logical_or.reduceat(reference, at).astype(np.uint8) << 1
    values = values[at]
    rows = [
        (share, cells.pack_sorted(values[a:b]), cells.pack(marks[a:b]))
        for share, a, b in cells.cut(values, given["shares"], given["bits"])
    ]
    return _cells(rows, table, ["hashes", "marks"])


def _cells(rows: list[tuple], table: pa.Table, names: list[str]) -> pa.Table:
    chunk = table.column("chunk")[0].as_py()
    columns = [pa.array([r[0] for r in rows], pa.int32()), pa.array([chunk] * len(rows), pa.int32())]
    columns += [pa.array([r[i + 1] for r in rows], pa.binary()) for i in range(len(names))]
    return pa.table(columns, ["share", "chunk", *names])


def _hits(table: pa.Table) -> pa.Table:
    """For each chunk, its blocks that occur at two places or more, one of them a reference block."""
    (values, marks), sizes = cells.together(table, "hashes:sorted", "marks:u1")
    order = np.argsort(values, kind="stable")
    at = cells.runs(values[order])
    counts = np.diff(at, append=len(values))
    any_mark = np.bitwise_or.reduceat(marks[order], at)
    hit = (any_mark >= 2) & ((counts > 1) | (any_mark == 3))
    chosen = np.zeros(len(values), bool)
    chosen[order] = np.repeat(hit, counts)
    kept = [[], [], []]
    ends = np.cumsum(sizes)
    for share, chunk, a, b in zip(
        table.column("share").to_pylist(), table.column("chunk").to_pylist(), ends - sizes, ends, strict=True
    ):
        if chosen[a:b].any():
            for column, value in zip(kept, (share, chunk, cells.pack_sorted(values[a:b][chosen[a:b]])), strict=True):
                column.append(value)
    types = (pa.int32(), pa.int32(), pa.binary())
    return pa.table([pa.array(c, t) for c, t in zip(kept, types, strict=True)], ["share", "chunk", "hashes"])


def _windows(given: dict, table: pa.Table, hits: pa.Table) -> pa.Table:
    """The chunk's distinct windows around hits, each with the smallest id that has it."""
    table, words, hashes = _read(table)
    (known,), _ = cells.together(hits.sort_by("share"), "hashes:sorted")
    values, ok = _blocks(given, words, hashes)
    found = np.flatnonzero(cells.member(values, known)[0] & ok)
    firsts = np.repeat(words.first[:-1], words.counts)
    change = np.zeros(len(hashes) + 1, np.int64)
    np.add.at(change, np.maximum(found - (given["width"] - given["block"]), firsts[found]), 1)
    np.add.at(change, found + 1, -1)
    whole, fits = ngrams(hashes, words.first, given["width"])
    near = np.flatnonzero((np.cumsum(change)[:-1] > 0) & fits)
    ids = np.asarray(pa.compute.fill_null(table.column("doc_id").combine_chunks(), int(_LAST)))
    ids = ids[words.owner()[near]]
    order = np.argsort(whole[near], kind="stable")
    values, ids = whole[near][order], ids[order]
    at = cells.runs(values)
    many = (np.diff(at, append=len(values)) > 1).astype(np.uint8)
    values, ids = values[at], ids[at]
    rows = [
        (share, cells.pack_sorted(values[a:b]), cells.pack(ids[a:b]), cells.pack(many[a:b]))
        for share, a, b in cells.cut(values, given["shares"], 64)
    ]
    return _cells(rows, table, ["hashes", "ids", "many"])


def _repeats(table: pa.Table) -> pa.Table:
    """For each chunk, its windows that occur twice or more, and whether the chunk has the first of them."""
    (values, ids, many), sizes = cells.together(table, "hashes:sorted", "ids:<i8", "many:u1")
    chunk = np.repeat(np.asarray(table.column("chunk")), sizes)
    order = np.lexsort((chunk, ids, values))
    at = cells.runs(values[order])
    counts = np.diff(at, append=len(values))
    repeated = (counts > 1) | (np.maximum.reduceat(many[order], at) > 0)
    chosen, first = np.zeros(len(values), bool), np.zeros(len(values), np.uint8)
    chosen[order] = np.repeat(repeated, counts)
    first[order[at]] = 1
    kept = [[], [], [], []]
    ends = np.cumsum(sizes)
    for share, chunk_no, a, b in zip(
        table.column("share").to_pylist(), table.column("chunk").to_pylist(), ends - sizes, ends, strict=True
    ):
        mine = chosen[a:b]
        if mine.any():
            row = (share, chunk_no, cells.pack_sorted(values[a:b][mine]), cells.pack(first[a:b][mine]))
            for column, value in zip(kept, row, strict=True):
                column.append(value)
    types = (pa.int32(), pa.int32(), pa.binary(), pa.binary())
    return pa.table([pa.array(c, t) for c, t in zip(kept, types, strict=True)], ["share", "chunk", "hashes", "first"])


def _kept(given: dict, table: pa.Table, repeats: pa.Table) -> pa.Table:
    """The chunk's texts without the words that a later copy of a window covers."""
    table, words, hashes = _read(table)
    (known, first), _ = cells.together(repeats.sort_by("share"), "hashes:sorted", "first:u1")
    whole, fits = ngrams(hashes, words.first, given["width"])
    found, at = cells.member(whole, known)
    places = np.flatnonzero(found & fits)
    which = at[places]
    stays = np.zeros(len(places), bool)
    lead = np.unique(which, return_index=True)[1]
    stays[lead] = first[which[lead]] == 1
    places = places[~stays]
    change = np.zeros(len(hashes) + 1, np.int64)
    change[: len(hashes)] += np.bincount(places, minlength=len(hashes))[: len(hashes)]
    change += np.bincount(places + given["width"], minlength=len(hashes) + 1)[: len(hashes) + 1] * -1
    gone = np.cumsum(change)[:-1] > 0
    upto = np.concatenate(([0], np.cumsum(gone)))
    removed = upto[words.first[1:]] - upto[words.first[:-1]]
    kept, spans = [], []
    texts = filled(table).cast(pa.large_binary())
    for i in range(len(texts)):
        parts = texts[i].as_py().split()
        a, b = words.first[i], words.first[i + 1]
        if removed[i]:
            edges = np.flatnonzero(np.diff(gone[a:b].astype(np.int8), prepend=0, append=0))
            spans.append([{"from": int(x), "to": int(y)} for x, y in edges.reshape(-1, 2)])
            parts = [p for p, out in zip(parts, gone[a:b].tolist(), strict=True) if not out]
        else:
            spans.append([])
        kept.append(b" ".join(parts))
    return pa.table(
        [
            table.column("doc_id"),
            pa.array(words.counts, pa.int64()),
            pa.array(removed, pa.int64()),
            pa.array(spans, pa.list_(pa.struct([("from", pa.int64()), ("to", pa.int64())]))),
            pa.array(kept, pa.binary()).cast(pa.string()),
        ],
        ["doc_id", "n_words", "n_removed", "spans", "kept_text"],
    )
