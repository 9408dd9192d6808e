"""Benchmark passages in documents: SimHash fingerprints of item-sized windows, indexed by Hamming blocks.

A window is as long as a benchmark item. Of all windows that are as like an item as any, one begins with a
shingle of the benchmark or ends with the text: a window that begins with another shingle loses nothing by
moving on. So windows are laid there, and where too few such shingles lie ahead for the similarity wanted,
they are passed over. Each window and item has a 64-bit SimHash of its shingles, repeats counted. Fingerprints within
``RADIUS`` bits agree in at least one of ``RADIUS + 1`` blocks, which makes the join key, beside the
length; candidates within the radius are verified by their shingles. Only DataFrame and SQL functions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilspark.llm.storage import written

RADIUS = 24
#: Shingles of the benchmark, and windows or items, up to which a table is broadcast.
FEW = 200_000

_BLOCKS = RADIUS + 1
_OFFSETS = ", ".join(str(i * 64 // _BLOCKS) for i in range(_BLOCKS))
_MASKS = ", ".join(f"{(1 << ((i + 1) * 64 // _BLOCKS - i * 64 // _BLOCKS)) - 1}L" for i in range(_BLOCKS))

#: One fingerprint's value in block b.
_BLOCK = "shiftrightunsigned({f}, array(" + _OFFSETS + ")[b]) & array(" + _MASKS + ")[b]"
#: Each bit is the majority of that bit of the shingles.
_SIMHASH = (
    "aggregate(sequence(0, 63), 0L, (f, b) -> f | shiftleft("
    "if(2 * aggregate({s}, 0, (n, x) -> n + cast(shiftright(x, b) & 1L as int)) > size({s}), 1L, 0L), b))"
)
#: Shingles in common, repeats counted.
_COMMON = (
    "aggregate(array_intersect(shingles, item_shingles), 0, (n, x) -> n + "
    "least(size(filter(shingles, y -> y = x)), size(filter(item_shingles, y -> y = x))))"
)


def _words(text: Column) -> Column:
    return F.array_remove(F.split(F.lower(F.coalesce(text.cast("string"), F.lit(""))), r"[\x20\x09-\x0D]+"), "")


def _shingles(words: str, size: int) -> Column:
    parts = ", ".join(f"get({words}, i + {j})" for j in range(size))
    return F.expr(
        f"CASE WHEN size({words}) >= {size} THEN transform(sequence(0, size({words}) - {size}), i -> xxhash64({parts})) "
        f"WHEN size({words}) > 0 THEN array(xxhash64(array_join({words}, ' '))) ELSE array() END"
    ).cast("array<bigint>")


def _checked(table: DataFrame) -> DataFrame:
    """Broadcast a written table of few rows; leave others to the planner."""
    return F.broadcast(table) if table.count() <= FEW else table


def benchmark_leaks(
    docs: DataFrame,
    benchmark: DataFrame,
    size: int = 5,
    least: float = 0.75,
    text: str = "text",
    doc_id: str = "doc_id",
    item_text: str = "text",
    item_id: str = "item_id",
) -> DataFrame:
    """One row per document and item of which it holds a passage: doc_id, item_id, similarity, start.

    similarity is the weighted Jaccard similarity of shingles (lower case, ``size`` words, weighted by
    their number) of the item and the most similar window of its length, ``start`` the window's first
    word (the earliest of equal ones that begin with a shingle of the benchmark or end with the text). A document shorter than the item is one window. Texts with fewer
    words than a shingle are one shingle; null, empty and blank texts are like nothing. Rows without
    doc_id are not looked at. Rows that share a doc_id are looked at each; the best window counts.
    """
    items = written(
        benchmark.select(F.col(item_id).alias("item_id"), _words(F.col(item_text)).alias("words"))
        .select("item_id", F.size("words").alias("length"), _shingles("words", size).alias("item_shingles"))
        .where("length > 0 AND item_id IS NOT NULL")
        .distinct()
        .withColumn("item_print", F.expr(_SIMHASH.format(s="item_shingles"))),
        "items",
    )
    known = written(items.select("length", F.explode("item_shingles").alias("h")).distinct(), "shingles")
    rows = docs.where(F.col(doc_id).isNotNull()).select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    # Not plain posexplode: the filter on empty arrays that it brings would compute all shingles twice.
    found = (
        rows.select("doc_id", _words(F.col("text")).alias("words"))
        .select("doc_id", F.size("words").alias("n"), F.posexplode_outer(_shingles("words", size)).alias("p", "h"))
        .join(_checked(known), "h")
        .groupBy("doc_id", "length", "n")
        .agg(F.array_sort(F.collect_set("p")).alias("at"))
    )
    # A window of a shingles and an item of b share this many at least, each at a place of its own.
    sizes = [F.greatest(F.lit(1), x - (size - 1)) for x in (F.least("length", "n"), F.col("length"))]
    found = found.withColumn("inside", sizes[0]).withColumn(
        "need", F.greatest(F.lit(1), F.ceil((sizes[0] + sizes[1]) * (least / (1 + least)) - 1e-9).cast("int"))
    )
    last = F.greatest(F.lit(0), F.col("n") - F.col("length"))
    starts = F.filter("at", lambda p, i: (p <= last) & (F.get("at", i + F.col("need") - 1) < p + F.col("inside")))
    at_end = F.get("at", F.size("at") - F.col("need")) >= last
    found = found.select(
        "doc_id",
        "length",
        F.explode(F.array_distinct(F.when(at_end, F.concat(starts, F.array(last))).otherwise(starts))).alias("start"),
    ).distinct()
    found = written(found, "windows")
    windows = written(
        rows.join(_checked(found), "doc_id")
        .select("doc_id", "length", "start", _words(F.col("text")).alias("words"))
        .select("doc_id", "length", "start", F.slice("words", F.col("start") + 1, F.col("length")).alias("part"))
        .select("doc_id", "length", "start", _shingles("part", size).alias("shingles"))
        .withColumn("print", F.expr(_SIMHASH.format(s="shingles"))),
        "prints",
    )
    blocks = f"transform(sequence(0, {RADIUS}), b -> {_BLOCK})"
    keyed = windows.select("*", F.posexplode(F.expr(blocks.format(f="print"))).alias("block", "value"))
    index = written(
        items.select("*", F.posexplode(F.expr(blocks.format(f="item_print"))).alias("block", "value")), "index"
    )
    # Each pair once, at the first block in which it agrees.
    equal = f"({_BLOCK.format(f='print')}) = ({_BLOCK.format(f='item_print')})"
    first = F.expr(f"array_min(filter(sequence(0, {RADIUS}), b -> {equal}))")
    near = (
        keyed.join(_checked(index), ["length", "block", "value"])
        .where(F.expr(f"bit_count(print ^ item_print) <= {RADIUS}"))
        .where(F.col("block") == first)
        .withColumn("common", F.expr(_COMMON))
        .withColumn("similarity", F.expr("common / (size(shingles) + size(item_shingles) - common)"))
        .where(F.col("similarity") >= least)
    )
    best = F.max(F.struct("similarity", (-F.col("start")).alias("s"))).alias("best")
    return near.groupBy("doc_id", "item_id").agg(best).select(
        "doc_id", "item_id", F.col("best.similarity").alias("similarity"), (-F.col("best.s")).alias("start")
    )


def drop_leaks(docs: DataFrame, benchmark: DataFrame, text: str = "text", **options) -> DataFrame:
    """The documents that hold no passage of the benchmark, with all their columns.

    A text decides, not its id: equal texts go or stay together, rows without id as well. Null and blank texts
    stay, all rows stay if the benchmark is empty, and an empty table stays empty; columns may have any names.
    Texts are told apart by 128 bits.
    """
    def key(value: Column) -> Column:
        return F.struct(F.xxhash64(value).alias("a"), F.xxhash64(F.lit(1), value).alias("b"))

    value = F.col(f"`{text}`").cast("string")
    keyed = docs.where(value.isNotNull()).select(key(value).alias("key"), value.alias("text"))
    leaks = benchmark_leaks(keyed, benchmark, doc_id="key", **options)
    leaks = leaks.select(F.col("doc_id.a").alias("_leak_a"), F.col("doc_id.b").alias("_leak_b")).distinct()
    own = docs[text].cast("string")
    same = (F.xxhash64(own) == leaks["_leak_a"]) & (F.xxhash64(F.lit(1), own) == leaks["_leak_b"])
    return docs.join(leaks, same, "left_anti")
