"""Line diff of two tables with one line per row, for sources too long for one row.

Patience: lines that occur once on each side are paired; a longest increasing subsequence of the pairs
anchors the alignment; what lies between two anchors is aligned on its own, first by lines that are unique
there, then by a longest common subsequence. No step has a whole source in one task:

* the anchors fall apart where all pairs before lie before all pairs after on both sides, and each such
  part has a subsequence of its own, the parts' subsequences together being a longest one of the whole;
* which anchor a line follows is a running maximum, found slice by slice with the maxima of the slices before.

Sources of a slice at most, which most are, are dealt out and sorted once, and each is aligned by the same steps where
its lines lie.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator
from itertools import chain

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from veilspark.functions.diff import aligned_lines
from veilspark.sources.texts import new_dir

#: Line numbers to a slice.
SLICE = 20_000


def _kept(df: DataFrame, name: str) -> DataFrame:
    path = new_dir(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _running_max(df: DataFrame, by: list[str], no: Column, value: str, out: str, inclusive: bool = True) -> DataFrame:
    """Add the maximum of ``value`` over all rows up to this one (or before it) along ``no``; null if there is none."""
    sliced = df.withColumn("_at", no).withColumn("_slice", F.floor(F.col("_at") / SLICE))
    inside = W.partitionBy(*by, "_slice").orderBy("_at").rowsBetween(W.unboundedPreceding, 0 if inclusive else -1)
    sliced = sliced.withColumn("_own", F.max(value).over(inside))
    before = W.partitionBy(*by).orderBy("_slice").rowsBetween(W.unboundedPreceding, -1)
    carried = sliced.groupBy(*by, "_slice").agg(F.max(value).alias("_top")).withColumn("_carry", F.max("_top").over(before))
    joined = sliced.join(carried.drop("_top"), [*by, "_slice"])
    return joined.withColumn(out, F.greatest("_own", "_carry")).drop("_at", "_slice", "_own", "_carry")


def increasing(values: list[int]) -> list[int]:
    """Places of a longest increasing subsequence: of piles, the smallest top; from each top, the one before it."""
    tops, places, before = [], [], []
    for i, v in enumerate(values):
        pile = bisect_left(tops, v)
        before.append(places[pile - 1] if pile else -1)
        if pile == len(tops):
            tops.append(v)
            places.append(i)
        else:
            tops[pile], places[pile] = v, i
    out, at = [], places[-1] if places else -1
    while at >= 0:
        out.append(at)
        at = before[at]
    return out[::-1]


def _paired(key: str, a: list[int], b: list[int]) -> pd.DataFrame:
    return pd.DataFrame({"_k": pd.Series([key] * len(a), dtype=object), "a": pd.Series(a, dtype="int64"), "b": pd.Series(b, dtype="int64")})


def _chain(part: pd.DataFrame) -> pd.DataFrame:
    part = part.sort_values("a")
    a, b = part["a"].tolist(), part["b"].tolist()
    places = increasing(b)
    return _paired(part["_k"].iloc[0], [a[i] for i in places], [b[i] for i in places])


def _anchors(lines: DataFrame) -> DataFrame:
    """(_k, a, b): the pairs of lines that are unique in their block on both sides, without those that cross."""
    sides = [F.col("side") == s for s in (0, 1)]
    alone = lines.groupBy("_k", "block", "line").agg(
        *(F.count_if(s).alias(f"n{i}") for i, s in enumerate(sides)),
        *(F.max(F.when(s, F.col("no"))).alias(c) for c, s in zip("ab", sides, strict=True)),
    )
    pairs = alone.where("n0 = 1 AND n1 = 1").select("_k", "a", "b", (-F.col("b")).alias("minus_b"))
    ranked = _running_max(pairs, ["_k"], F.col("a"), "b", "most", inclusive=False)
    ranked = _running_max(ranked, ["_k"], -F.col("a"), "minus_b", "least")
    # All pairs before lie before this one and all after it: here a part begins.
    cut = F.col("most").isNull() | (F.col("most") < -F.col("least"))
    parts = _running_max(ranked.withColumn("begin", F.when(cut, F.col("a"))), ["_k"], F.col("a"), "begin", "part")
    parts = _kept(parts.select("_k", "part", "a", "b"), "parts")
    sizes = parts.groupBy("_k", "part").agg(F.count(F.lit(1)).alias("size"))
    sized = parts.join(sizes, ["_k", "part"])
    kind = parts.select("_k", "a", "b").schema
    crossing = sized.where("size > 1").select("_k", "part", "a", "b").groupBy("_k", "part").applyInPandas(_chain, kind)
    return sized.where("size = 1").select("_k", "a", "b").unionByName(crossing)


def _blocks(lines: DataFrame, pairs: DataFrame) -> DataFrame:
    """Lines without a partner, each with the ``a`` of the last pair before it as its block (-1 if there is none)."""
    both = [F.struct(F.lit(s).alias("side"), F.col(c).alias("no")) for s, c in enumerate("ab")]
    ends = pairs.select("_k", F.explode(F.array(*both)).alias("e"), "a")
    marked = lines.drop("_keys").join(ends.select("_k", "e.side", "e.no", "a"), ["_k", "side", "no"], "left")
    placed = _running_max(marked, ["_k", "side"], F.col("no"), "a", "block")
    return placed.where("a IS NULL").select("_k", "side", "no", "line", F.coalesce("block", F.lit(-1)).alias("block"))


def _aligned(block: pd.DataFrame) -> pd.DataFrame:
    block = block.sort_values("no")
    old, new = (block[block["side"] == s] for s in (0, 1))
    # Pandas may show a null line as NaN, which equals nothing.
    lines = [[None if pd.isna(x) else x for x in side["line"]] for side in (old, new)]
    pairs = aligned_lines(*lines)
    a, b = old["no"].tolist(), new["no"].tolist()
    return _paired(block["_k"].iloc[0], [a[i] for i, _ in pairs], [b[j] for _, j in pairs])


def _unique(lines: list, places: list[int]) -> dict:
    """The place of each line; None where it occurs twice."""
    out: dict = {}
    for i in places:
        out[lines[i]] = None if lines[i] in out else i
    return out


def paired_lines(nos: list[list[int]], lines: list[list], rounds: int) -> list[tuple[int, int]]:
    """Pairs of line numbers of one source, whose sides are in order: the anchors of each round, then the alignment
    of the blocks between them."""
    if lines[0] == lines[1] and all(len(set(no)) == len(no) for no in nos):
        return list(zip(*nos, strict=True))
    whole = tuple(list(range(len(side))) for side in lines)
    pairs, left = [], {-1: whole}
    for _ in range(rounds):
        found = []
        for old, new in left.values():
            if old and new:
                there = _unique(lines[1], new)
                here = ((i, there.get(x)) for x, i in _unique(lines[0], old).items())
                both = sorted((nos[0][i], nos[1][j]) for i, j in here if i is not None and j is not None)
                found += [both[i] for i in increasing([b for _, b in both])]
        if not found:
            break
        pairs += found
        left = {}
        for side in (0, 1):
            block_of, block = {pair[side]: pair[0] for pair in sorted(pairs)}, -1
            for i in whole[side]:
                if nos[side][i] in block_of:
                    block = max(block, block_of[nos[side][i]])
                else:
                    left.setdefault(block, ([], []))[side].append(i)
    for old, new in left.values():
        if old and new:
            found = aligned_lines([lines[0][i] for i in old], [lines[1][j] for j in new])
            pairs += [(nos[0][old[i]], nos[1][new[j]]) for i, j in found]
    return pairs


def _differences(rows: pa.Table, rounds: int) -> list[pa.RecordBatch]:
    """The diffs of whole sources, whose rows are in the order of source, side and number."""
    names, side, no, line = (rows.column(c).to_pylist() for c in ("_k", "side", "no", "line"))
    at, old_no, new_no, kind = [], [], [], []
    start = 0
    while start < len(names):
        middle, end = start, start
        while end < len(names) and names[end] == names[start]:
            end += 1
            middle += side[end - 1] == 0
        pairs = paired_lines([no[start:middle], no[middle:end]], [line[start:middle], line[middle:end]], rounds)
        partners: dict[int, list[int]] = {}
        for a, b in pairs:
            partners.setdefault(a, []).append(b)
        for i in range(start, middle):
            for b in partners.get(no[i], (None,)):
                at.append(i), old_no.append(no[i]), new_no.append(b), kind.append("delete" if b is None else "equal")
        taken = {b for _, b in pairs}
        for i in range(middle, end):
            if no[i] not in taken:
                at.append(i), old_no.append(None), new_no.append(no[i]), kind.append("add")
        start = end
    chosen = rows.select(["_keys", "line"]).take(pa.array(at, pa.int64())).combine_chunks()
    numbers = [pa.array(x, pa.int64()) for x in (old_no, new_no)]
    columns = [chosen.column("_keys"), *numbers, pa.array(kind, pa.string()), chosen.column("line")]
    out = pa.table(columns, names=["_keys", "old_line_no", "new_line_no", "change_type", "line"])
    return out.combine_chunks().to_batches()


def _by_source(batches: Iterator[pa.RecordBatch], rounds: int) -> Iterator[pa.RecordBatch]:
    """The diffs of sorted rows; a source that goes on in the next batch waits for it."""
    held: list[pa.RecordBatch] = []
    for batch in chain(batches, [None]):
        if batch is not None and not batch.num_rows:
            continue
        cut = 0
        if batch is not None:
            names = batch.column("_k")
            last, cut = names[-1], batch.num_rows - 1
            while cut and names[cut - 1] == last:
                cut -= 1
            if not cut and held and held[-1].column("_k")[-1] == last:
                held.append(batch)
                continue
            # What is held ends before the cut: with the source that this batch begins with, or one before it.
        whole = held + ([batch.slice(0, cut)] if cut else [])
        if whole:
            yield from _differences(pa.Table.from_batches(whole), rounds)
        held = [] if batch is None else [batch.slice(cut)]


def _small(lines: DataFrame, rounds: int) -> DataFrame:
    """The diffs of sources that fit one task: one shuffle, one sort."""
    kinds = {f.name: f.dataType.simpleString() for f in lines.schema}
    placed = lines.select("_keys", "_k", "side", "no", "line").repartition("_k").sortWithinPartitions("_k", "side", "no")
    out = f"_keys {kinds['_keys']}, old_line_no bigint, new_line_no bigint, change_type string, line string"
    return placed.mapInArrow(lambda batches: _by_source(batches, rounds), out)


def diff_rows(
    old: DataFrame, new: DataFrame, keys: list[str], no: str = "line_no", line: str = "line", rounds: int = 2
) -> DataFrame:
    """(keys, old_line_no, new_line_no, change_type, content) of two line tables, one row per line of the diff.

    ``no`` is a whole number, unique within a key and side and rather dense. ``equal`` rows have both numbers,
    ``delete`` rows the old one and ``add`` rows the new one; in the order of each, they rebuild both sides. A
    source on one side only is all added or deleted. Null keys and lines are values of their own; other columns are not
    read. Lines are paired as by ``with_diff`` where the pairs of n-th occurrences do not cross. ``rounds`` of
    anchors come first; a block that still has no unique line, and pairs that all cross each other, are one
    task's work. Intermediate tables are written to the shared folder while the plan is made.
    """
    # One text stands for all keys: it tells nulls apart, joins as it groups, and goes through Python.
    name = F.to_json(F.struct(*keys), {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"}).alias("_k")
    sides = [
        df.select(F.struct(*keys).alias("_keys"), name, F.lit(s).alias("side"), F.col(no).cast("bigint").alias("no"), F.col(line).alias("line"))
        for s, df in enumerate((old, new))
    ]
    lines = _kept(sides[0].unionByName(sides[1]), "lines")
    if dict(lines.dtypes)["line"] != "string":
        out = _large(lines, rounds)
    else:
        # Rows without a number, and those of more lines or copies of lines than a slice, go the long way.
        many = f"count(no) < count(*) OR min(no) < 0 OR max(no) >= {SLICE} OR count(*) > {4 * SLICE}"
        wide = _kept(lines.groupBy("_k").agg(F.expr(many).alias("_wide")).where("_wide").select("_k"), "wide")
        out = _small(lines.join(wide, "_k", "left_anti"), rounds)
        if not wide.isEmpty():
            out = out.unionByName(_large(lines.join(wide, "_k", "left_semi"), rounds))
    return out.select(*(F.col("_keys")[k].alias(k) for k in keys), "old_line_no", "new_line_no", "change_type", F.col("line").alias("content"))


def _large(lines: DataFrame, rounds: int) -> DataFrame:
    """The diffs of sources of any size, slice by slice and block by block."""
    left, pairs = lines.drop("_keys").withColumn("block", F.lit(-1).cast("bigint")), None
    for _ in range(rounds):
        found = _kept(_anchors(left), "anchors")
        pairs = found if pairs is None else pairs.unionByName(found)
        left = _kept(_blocks(lines, pairs), "blocks")
    both = left.groupBy("_k", "block").agg(F.min("side").alias("x"), F.max("side").alias("y")).where("x < y").select("_k", "block")
    rest = left.join(both, ["_k", "block"], "left_semi").groupBy("_k", "block").applyInPandas(_aligned, pairs.schema)
    pairs = _kept(pairs.unionByName(rest), "pairs")
    texts = lines.where("side = 0").select("_keys", "_k", F.col("no").alias("a"), "line")
    equal = texts.join(pairs, ["_k", "a"], "left").select(
        "_keys", F.col("a").alias("old_line_no"), F.col("b").alias("new_line_no"), F.when(F.col("b").isNull(), "delete").otherwise("equal").alias("change_type"), "line"
    )
    added = lines.where("side = 1").select("_keys", "_k", F.col("no").alias("b"), "line").join(pairs, ["_k", "b"], "left_anti").select(
        "_keys", F.lit(None).cast("bigint").alias("old_line_no"), F.col("b").alias("new_line_no"), F.lit("add").alias("change_type"), "line"
    )
    return equal.unionByName(added)
