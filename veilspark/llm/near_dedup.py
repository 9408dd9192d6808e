"""Near-duplicate documents by SetSketch registers over word shingles.

A register is the truncated, exponentially spaced minimum of a set's hashes under one hash function:
``floor(1 - log_base(minimum))`` of exponential variates. Registers of a union are the maxima of the
registers, and two sets agree in a register about as often as they agree in a shingle. Bands of
registers bring documents into buckets, the joint likelihood of the registers discards pairs that are
far from the threshold, and whole shingle sets decide the rest.

Documents with equal sets are one class from the start. A bucket is not expanded into its pairs: each
member is tested against one leader. A passage that many documents share makes large buckets of
documents that are not alike; so where the links found leave a bucket's members in several components,
these members are dealt anew by their rarest shingles, of which linked sets always share one. Again
each is tested against a leader first, and only what is left in different components of such a
bucket is compared with each other.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilspark.llm.components import components
from veilspark.llm.storage import one_of_each, written
from veilspark.llm.words import Words, _constants, filled, mix, ngrams, pieces, words_of

BANDS, ROWS = 32, 4
BASE, RATE, TOP = 1.001, 20.0, 65535
#: Standard errors of the likelihood estimate below the threshold at which a pair is given up.
SLACK = 5.0
#: Rounds over the buckets of bands in which each member is tested against one leader only.
LEADERS = 1
#: Cells of the histogram that orders shingles by how common they are.
CELLS = 1 << 20

_XOR = mix(_constants("register-xor", BANDS * ROWS).copy())
_TIMES = _constants("register-times", BANDS * ROWS)


def shingles_of(texts: pa.Array, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Shingle hashes of all texts, repeats included, and the first of each text (and the end)."""
    words: Words = words_of(texts)
    hashes = words.hashes(lower=True)
    values, chosen = ngrams(hashes, words.first, size)
    counts = words.counts
    for n in range(1, size):
        at = words.first[:-1][counts == n]
        if len(at):
            values[at] = ngrams(hashes, words.first, n)[0][at]
            chosen[at] = True
    return values[chosen], np.concatenate(([0], np.cumsum(np.where(counts < size, counts > 0, counts - size + 1))))


def registers(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """A row of registers for each text; texts without shingles have zeros."""
    out = np.zeros((len(first) - 1, BANDS * ROWS), np.uint16)
    full = np.flatnonzero(np.diff(first) > 0)
    if not len(full):
        return out
    least = np.empty((len(full), BANDS * ROWS), np.uint64)
    for j in range(BANDS * ROWS):
        least[:, j] = np.minimum.reduceat((values ^ _XOR[j]) * _TIMES[j], first[full])
    uniform = (least >> np.uint64(11)).astype(float) * 2.0**-53 + 2.0**-54
    variate = -np.log1p(-uniform) / RATE
    out[full] = np.clip(np.floor(1.0 - np.log(variate) / np.log(BASE)), 0, TOP)
    return out


def _sets(batches: Iterator[pa.RecordBatch], size: int, whole: bool) -> Iterator[pa.RecordBatch]:
    """doc_id, n_shingles and digest of each row's set, and its registers or, if ``whole``, the set itself."""
    for batch in batches:
        for piece in pieces(batch, limit=1 << 19):
            values, first = shingles_of(filled(piece), size)
            counts, digests, last = [], [], []
            for a, b in zip(first[:-1], first[1:], strict=True):
                own = np.unique(values[a:b]).tobytes()
                counts.append(len(own) // 8)
                digests.append(hashlib.blake2b(own, digest_size=16).digest())
                last.append(own)
            if not whole:
                last = [r.tobytes() for r in registers(values, first)]
            yield pa.record_batch(
                [piece.column("doc_id"), piece.column("row"), pa.array(counts, pa.int64()), pa.array(digests, pa.binary()), pa.array(last, pa.binary())],
                ["doc_id", "row", "n_shingles", "digest", "last"],
            )


_SETS = "doc_id bigint, row bigint, n_shingles bigint, digest binary, last binary"


def likeliest(a: np.ndarray, b: np.ndarray, na: np.ndarray, nb: np.ndarray, steps: int = 101) -> np.ndarray:
    """The Jaccard similarity of greatest likelihood, given the registers and sizes of two sets, row by row."""
    over, under = (a > b).sum(1)[:, None], (a < b).sum(1)[:, None]
    u = (na / (na + nb))[:, None]
    v = 1 - u
    j = np.linspace(0, 1, steps)[None, :] * np.minimum(u / v, v / u)
    step = (BASE - 1) / BASE
    p = lambda x: -np.log1p(-np.maximum(x, 0) * step) / np.log(BASE)
    more, less = p(u - v * j), p(v - u * j)
    log = lambda x: np.log(np.maximum(x, 1e-12))
    fit = over * log(more) + under * log(less) + (a.shape[1] - over - under) * log(1 - more - less)
    return j[np.arange(len(j)), fit.argmax(1)]


def _likely(batches: Iterator[pa.RecordBatch], least: float) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for at in range(0, whole.num_rows, 4096):
            batch = whole.slice(at, 4096)
            a, b = (np.frombuffer(b"".join(batch.column(c).to_pylist()), "<u2").reshape(-1, BANDS * ROWS) for c in ("ra", "rb"))
            na, nb = (np.asarray(batch.column(c), float) for c in ("na", "nb"))
            fine = (likeliest(a, b, na, nb) >= least) & (np.minimum(na, nb) / np.maximum(na, nb) >= least)
            yield batch.filter(pa.array(fine)).drop_columns(["ra", "rb"])


def _linked(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        fine = []
        for x, y in zip(batch.column("sa"), batch.column("sb"), strict=True):
            x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
            both = len(np.intersect1d(x, y, assume_unique=True))
            fine.append(100 * both >= percent * (len(x) + len(y) - both))
        yield batch.filter(pa.array(fine, pa.bool_())).select(["a", "b"])


def _prefixes(sets: DataFrame, percent: int) -> DataFrame:
    """(key, rep, n, place): the shingles of each set that come first, so many that linked sets share one of them.

    Sets that share ``percent`` of their union share at least that part of either, so in any order of
    all shingles one of the first n - percent * n + 1 of either is common. Rare shingles come first, as
    a histogram of a fixed number of cells tells; that order only affects the size of the buckets.
    """

    def cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(CELLS, np.int64)
        for batch in batches:
            for blob in batch.column("members"):
                total += np.bincount(
                    (np.frombuffer(blob.as_buffer(), np.uint64) % np.uint64(CELLS)).astype(np.int64), minlength=CELLS
                )
        at = np.flatnonzero(total)
        yield pa.record_batch([pa.array(at), pa.array(total[at])], ["cell", "n"])

    common = np.zeros(CELLS, np.int64)
    counted = sets.select("members").mapInArrow(cells, "cell bigint, n bigint").groupBy("cell").agg(F.sum("n").alias("n"))
    for part in counted.toArrow().to_batches():
        common[np.asarray(part.column("cell"))] = np.asarray(part.column("n"))

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                keys, reps, sizes, places = [np.zeros(0, np.uint64)], [], [], []
                for doc_id, blob in zip(*(batch.slice(at, 256).column(c) for c in ("doc_id", "members")), strict=True):
                    own = np.frombuffer(blob.as_buffer(), np.uint64)
                    order = np.lexsort((own, common[(own % np.uint64(CELLS)).astype(np.int64)]))
                    keys.append(own[order[: len(own) - (percent * len(own) + 99) // 100 + 1]])
                    reps += [doc_id.as_py()] * len(keys[-1])
                    sizes += [len(own)] * len(keys[-1])
                    places += range(len(keys[-1]))
                yield pa.record_batch(
                    [pa.array(np.concatenate(keys).view(np.int64)), *(pa.array(c, pa.int64()) for c in (reps, sizes, places))],
                    ["key", "rep", "n", "place"],
                )

    return sets.select("doc_id", "members").mapInArrow(first, "key bigint, rep bigint, n bigint, place bigint")


def near_groups(
    docs: DataFrame, size: int = 5, percent: int = 75, text: str = "text", doc_id: str = "doc_id"
) -> DataFrame:
    """One row per input row: doc_id, n_shingles, component_id, kept.

    Words are lower-cased (A-Z); a set holds the distinct ``size``-word shingles, a shorter text is one
    shingle, and a null, empty or blank text has none and is linked with nothing. Sets are linked if
    ``percent`` or more of their union is shared; component_id is the smallest doc_id (an integer) that
    can be reached. Rows that share an id but not their set are documents of their own. A row without
    id has no component_id unless another row with an equal set has an id, and is kept if it has none.
    Pairs at the threshold share no band with probability of about 5e-6. Other columns are not read.
    """
    return _grouped(docs, size, percent, text, doc_id).drop("row")


def _grouped(docs: DataFrame, size: int, percent: int, text: str, doc_id: str) -> DataFrame:
    """``near_groups`` with the hash ``row`` of each row's text."""
    value = F.col(text).cast("string")
    rows = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.xxhash64(value).alias("row"), value.alias("text"))
    sketches = written(rows.mapInArrow(lambda b: _sets(b, size, False), _SETS), "sketches")
    classes = written(
        sketches.where("n_shingles > 0 AND doc_id IS NOT NULL")
        .groupBy("digest")
        .agg(F.min(F.struct("doc_id", "n_shingles", "last")).alias("r"))
        .select("digest", F.col("r.doc_id").alias("rep"), F.col("r.n_shingles").alias("n"), F.col("r.last").alias("regs")),
        "classes",
    )
    band = F.transform(
        F.sequence(F.lit(0), F.lit(BANDS - 1)),
        lambda i: F.xxhash64(i, F.expr("regs").substr(i * (2 * ROWS) + 1, F.lit(2 * ROWS))),
    )
    banded = classes.select("rep", F.explode(band).alias("key"))
    shared = banded.groupBy("key").agg(F.min("rep").alias("x"), F.max("rep").alias("y")).where("x < y").select("key")
    buckets = written(banded.join(shared, "key"), "buckets")
    inside = buckets.select("rep").distinct()
    sets = written(
        rows.join(inside.withColumnRenamed("rep", "doc_id"), "doc_id", "left_semi")
        .mapInArrow(lambda b: _sets(b, size, True), _SETS)
        .select("doc_id", "digest", F.col("last").alias("members")),
        "sets",
    )
    goal = percent / 100
    least = goal - SLACK * (goal * (1 - goal) / (BANDS * ROWS)) ** 0.5

    def verified(pairs: DataFrame) -> DataFrame:
        for side in "ab":
            known = classes.select(
                F.col("rep").alias(side), F.col("digest").alias(f"d{side}"), F.col("n").alias(f"n{side}"), F.col("regs").alias(f"r{side}")
            )
            pairs = pairs.join(known, side)
        schema = "a bigint, b bigint, da binary, na bigint, db binary, nb bigint"
        likely = pairs.select("a", "b", "da", "na", "db", "nb", "ra", "rb").mapInArrow(lambda x: _likely(x, least), schema)
        for side in "ab":
            known = sets.select(F.col("doc_id").alias(side), F.col("digest").alias(f"d{side}"), F.col("members").alias(f"s{side}"))
            likely = likely.join(known, [side, f"d{side}"])
        return likely.select("a", "b", "sa", "sb").mapInArrow(lambda x: _linked(x, percent), "a bigint, b bigint")

    def mixed(labels: DataFrame, of: DataFrame) -> DataFrame:
        """The buckets whose members are in several components."""
        placed = of.join(labels.withColumnRenamed("node", "rep"), "rep", "left").select(
            "key", "rep", F.coalesce("component", "rep").alias("part"), "n", "place"
        )
        several = placed.groupBy("key").agg(F.min("part").alias("x"), F.max("part").alias("y")).where("x < y")
        return written(placed.join(several.select("key"), "key"), "mixed")

    links = labels = None
    left = buckets.select(
        "key", "rep", F.col("rep").alias("part"), *[F.lit(0).cast("bigint").alias(c) for c in ("n", "place")]
    )
    for turn in range(LEADERS + 1):
        if turn == LEADERS:
            held = sets.join(left.select(F.col("rep").alias("doc_id")).distinct(), "doc_id", "left_semi")
            left = mixed(labels, written(_prefixes(held, percent), "prefixes"))
        # Every member against a leader of its bucket: any, or the set with the fewest rarer shingles.
        rank = F.struct(F.col("place") if turn == LEADERS else F.lit(0), F.xxhash64("rep", F.lit(turn)), "rep", "part")
        lead = left.groupBy("key").agg(F.min(rank).alias("lead"))
        pairs = left.join(lead, "key").where("part <> lead.part").select(
            F.least("rep", "lead.rep").alias("a"), F.greatest("rep", "lead.rep").alias("b")
        )
        found = written(verified(pairs.distinct()), "links")
        links = found if links is None else links.union(found)
        labels = written(components(links), "labels")
        left = mixed(labels, left)
    # Members that this leaves in different components, against each other, unless too few shingles are
    # left behind the one they share: the first that linked sets share has enough behind it.
    x, y = (left.select("key", *[F.col(c).alias(f"{c}_{s}") for c in ("rep", "part", "n", "place")]) for s in "xy")
    enough = f"{100 + percent} * least(n_x - place_x, n_y - place_y) >= {percent} * (n_x + n_y)"
    rest = x.join(y, "key").where(f"part_x < part_y AND {enough}").select(
        F.least("rep_x", "rep_y").alias("a"), F.greatest("rep_x", "rep_y").alias("b")
    )
    more = written(verified(rest.distinct()), "links")
    if not more.isEmpty():
        labels = written(components(links.union(more)), "labels")
    named = classes.join(labels, classes["rep"] == labels["node"], "left").select(
        F.col("digest").alias("_digest"), F.coalesce("component", "rep").alias("component")
    )
    component = F.coalesce(F.when(F.col("n_shingles") > 0, F.col("component")), F.col("doc_id"))
    return (
        sketches.join(named, sketches["digest"] == named["_digest"], "left")
        .select("doc_id", "row", "n_shingles", component.alias("component_id"))
        .withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))
    )


def drop_near_copies(docs: DataFrame, size: int = 5, percent: int = 75, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """One document of each component of ``near_groups``, with all its columns.

    The row that stays is one with the component's id. If several rows have it (a repeated id), the text with
    the smallest hash stays, and of rows that share id and text the one that ``one_of_each`` names. Rows
    without id stay where ``near_groups`` keeps them, once for each text. Texts without words are components
    of their own. An empty table stays empty; columns may have any names.
    """
    found = _grouped(docs, size, percent, text, doc_id).where("kept")
    kept = found.groupBy(F.col("doc_id").alias("_kept_id"), F.when(F.col("doc_id").isNull(), F.col("row")).alias("_text")).agg(
        F.min("row").alias("_kept_row")
    )
    same = docs[doc_id].cast("bigint").eqNullSafe(kept["_kept_id"]) & (F.xxhash64(docs[text].cast("string")) == kept["_kept_row"])
    return one_of_each(docs.join(kept, same, "left_semi"), [doc_id, text])
