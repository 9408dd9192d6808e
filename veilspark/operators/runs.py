"""Runs over tables that hold one line per row, where one source may own most of the rows.

A run is a maximal stretch of neighbouring rows that belong together. Rows are cut into slices along
their order, so a source of any size is spread over many groups. Each slice finds its own runs. Only
its first and last run can go on in a neighbour, so these alone go up a tree of coarser slices, where
neighbours are merged in the same way: merging is associative, and no step sees a whole source.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from veilspark.functions.lines import PRUNED_PREFIX, PRUNED_SUFFIX, is_framework_frame


def _merged(rows: DataFrame, by: list[str], equal_lines: bool, gap: Column | None) -> DataFrame:
    """Neighbouring rows of each group merged to runs, which are rows of the same form.

    ``first`` and ``last`` order the rows; a row that is not ``head`` never joins the one before it, as
    rows between the two were left out. A run is ``head`` if it may go on before the group, ``tail`` if
    it may after it. One shuffle and one sort: all windows are the same.
    """
    along = W.partitionBy(*by).orderBy("first")

    def joined(before: Callable[[str], Column], after: Callable[[str], Column]) -> Column:
        """Whether two neighbours are of one run; beyond the ends of the group ``joinable`` is null."""
        same = after("head") & after("joinable") & before("joinable")
        if equal_lines:
            same = same & after("line").eqNullSafe(before("line"))
        if gap is not None:
            same = same & (after("_at") - before("_until") <= gap)
        return F.coalesce(same, F.lit(False))

    def behind(name: str) -> Column:
        return F.lag(name).over(along)

    def ahead(name: str) -> Column:
        return F.lead(name).over(along)

    marked = rows.select(
        "*",
        joined(behind, F.col).alias("_on"),
        (~joined(F.col, ahead)).alias("_end"),
        behind("n").isNull().alias("_front"),
        ahead("n").isNull().alias("_back"),
        F.sum("n").over(along.rowsBetween(W.unboundedPreceding, W.currentRow)).alias("_upto"),
    )
    # Only the two ends of a run stay; the first learns from the row after it where the run ends.
    ends = marked.where(~F.col("_on") | F.col("_end")).withColumn("_here", F.struct("last", "_until", "_upto", "_back"))
    ends = ends.withColumn("_stop", F.when(F.col("_end"), F.col("_here")).otherwise(ahead("_here")))
    kept = [c for c in rows.columns if c not in ("n", "last", "_until", "head")]
    return ends.where(~F.col("_on")).select(
        *kept,
        (F.col("_stop._upto") - F.col("_upto") + F.col("n")).alias("n"),
        F.col("_stop.last").alias("last"),
        F.col("_stop._until").alias("_until"),
        (F.col("head") & F.col("_front")).alias("head"),
        F.col("_stop._back").alias("tail"),
    )


def find_runs(
    df: DataFrame,
    keys: list[str],
    order: list[str],
    line: str,
    slice_by: Column | Sequence[Column],
    joinable: Column | None = None,
    equal_lines: bool = True,
    weight: str | None = None,
    time: str | None = None,
    gap: str | None = None,
) -> DataFrame:
    """Runs as (keys, line, n, first, last, joinable, is_last).

    ``order`` must be unique within a key. ``slice_by`` must not decrease along it and should cut a key
    into pieces that fit one task; several columns go from fine to coarse, each slice within one of the
    next, and the coarsest should leave a few thousand slices of a key at most. Neighbours form one run
    if both are ``joinable`` and, unless ``equal_lines`` is off, hold the same line; with ``gap`` (an
    interval such as ``1 hour``) also if no more time than that lies between them by the timestamp
    ``time``. ``weight`` names a column with the number of rows that an input row stands for.

    Rows are shuffled once, and the first and last run of each slice once for each further level.
    """
    slices = [slice_by] if isinstance(slice_by, Column) else list(slice_by)
    names = [f"_slice{i}" for i in range(len(slices))]
    moment = F.unix_micros(F.col(time)) if gap is not None else F.lit(None).cast("long")
    limit = F.unix_micros(F.timestamp_seconds(F.lit(0)) + F.expr(f"INTERVAL {gap}")) if gap is not None else None
    # The coarser slices travel in the ordering column: unused columns would be pruned from one branch of
    # the union below and not from the other, which could then not share one shuffle.
    rows = df.select(
        *keys,
        slices[0].alias(names[0]),
        F.struct(*order, *(c.alias(n) for c, n in zip(slices[1:], names[1:], strict=True))).alias("first"),
        F.struct(*order).alias("last"),
        moment.alias("_at"),
        moment.alias("_until"),
        F.col(line).alias("line"),
        (F.col(weight).cast("long") if weight else F.lit(1).cast("long")).alias("n"),
        (F.lit(True) if joinable is None else F.coalesce(joinable, F.lit(False))).alias("joinable"),
        F.lit(True).alias("head"),
    )
    begin = F.struct(*(F.col("first")[o].alias(o) for o in order)).alias("first")
    columns = [*keys, "line", "n", begin, "last", "joinable"]
    done = []
    for i, name in enumerate(names):
        if i:
            rows = rows.withColumn(name, F.col("first")[name])
        runs = _merged(rows, [*keys, name], equal_lines, limit).drop(name)
        done.append(runs.where(~F.col("head") & ~F.col("tail")).select(*columns, F.lit(False).alias("is_last")))
        rows = runs.where(F.col("head") | F.col("tail")).drop("tail")
    out = _merged(rows, keys, equal_lines, limit).select(*columns, F.col("tail").alias("is_last"))
    for part in done:
        out = out.unionByName(part)
    return out


def collapse_rows(
    df: DataFrame, keys: list[str], order: list[str], line: str, slice_by: Column | Sequence[Column],
    time: str | None = None, gap: str | None = None,
) -> DataFrame:
    """Repeats that follow each other within a key, as one row ``line (Repeated kx)``."""
    runs = find_runs(df, keys, order, line, slice_by, time=time, gap=gap)
    shown = F.when(
        F.col("n") > 1, F.concat(F.col("line"), F.lit(" (Repeated "), F.col("n").cast("string"), F.lit("x)"))
    ).otherwise(F.col("line"))
    return runs.select(*keys, F.col("first.*"), "n", shown.alias(line))


def prune_rows(df: DataFrame, keys: list[str], order: list[str], line: str, slice_by: Column | Sequence[Column]) -> DataFrame:
    """Framework frames that follow each other within a key, as one summary row."""
    frame = is_framework_frame(F.col(line))
    runs = find_runs(df, keys, order, line, slice_by, joinable=frame, equal_lines=False)
    shown = F.when(
        F.col("joinable"), F.concat(F.lit(PRUNED_PREFIX), F.col("n").cast("string"), F.lit(PRUNED_SUFFIX))
    ).otherwise(F.col("line"))
    return runs.select(*keys, F.col("first.*"), "n", shown.alias(line))
