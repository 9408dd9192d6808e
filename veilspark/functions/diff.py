"""Line diff of two texts inside the row.

Lines are paired natively by their n-th occurrence.  That pairing uses as many lines as any
alignment could, so where it keeps the order of both sides it is a longest common
subsequence.  Only rows whose pairs cross need the alignment helper, an Arrow UDF that sees
nothing of the other rows.
"""

from __future__ import annotations

from math import isqrt

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilspark.functions.core import held, let
from veilspark.functions.lines import split_lines


def _line(kind: str, old: Column | None, new: Column | None, content: Column) -> Column:
    null = F.lit(None).cast("int")
    return F.struct(
        F.lit(kind).alias("change_type"),
        (null if old is None else old.cast("int")).alias("old_line_no"),
        (null if new is None else new.cast("int")).alias("new_line_no"),
        content.alias("content"),
    )


def occurrence_pairs(old: Column, new: Column) -> Column:
    """Index pairs (a, b) of lines with equal content and equal occurrence number, ordered by a."""
    tagged = F.array_sort(
        F.concat(
            F.transform(old, lambda x, i: F.struct(x.alias("line"), F.lit(0).alias("side"), i.alias("at"))),
            F.transform(new, lambda x, i: F.struct(x.alias("line"), F.lit(1).alias("side"), i.alias("at"))),
        )
    )

    def pair_up(rows: Column) -> Column:
        size = F.size(rows)
        starts = F.filter(
            F.sequence(F.lit(0), size - 1),
            lambda i: (i == 0) | (F.get(rows, i)["line"] != F.get(rows, i - 1)["line"]),
        )

        def one_group(start: Column, end: Column) -> Column:
            group = F.slice(rows, start + 1, end - start)
            olds = F.size(F.filter(group, lambda r: r["side"] == 0))
            return let(
                olds,
                lambda n: F.transform(
                    F.sequence(F.lit(0), F.least(n, end - start - n) - 1),
                    lambda k: F.struct(
                        F.get(rows, start + k)["at"].alias("a"), F.get(rows, start + n + k)["at"].alias("b")
                    ),
                ),
            )

        def all_groups(cut: Column) -> Column:
            # A line that occurs on one side only has a group without two sides; skip it.
            two_sided = F.filter(
                F.transform(
                    cut, lambda s, k: F.struct(s.alias("s"), F.coalesce(F.get(cut, k + 1), size).alias("e"))
                ),
                lambda g: F.get(rows, g["s"])["side"] != F.get(rows, g["e"] - 1)["side"],
            )
            return F.array_sort(F.flatten(F.transform(two_sided, lambda g: one_group(g["s"], g["e"]))))

        return F.when(size > 0, let(starts, all_groups)).otherwise(
            F.array().cast("array<struct<a:int,b:int>>")
        )

    return let(tagged, pair_up)


def pairs_cross(pairs: Column) -> Column:
    """True if the pairs do not keep the order of the new side."""
    return F.when(
        F.size(pairs) > 1,
        F.exists(
            F.sequence(F.lit(1), F.size(pairs) - 1), lambda i: F.get(pairs, i)["b"] < F.get(pairs, i - 1)["b"]
        ),
    ).otherwise(False)


def assemble(old: Column, new: Column, pairs: Column) -> Column:
    """Diff lines in display order: before each kept line the deletions, then the additions."""

    def block(s: Column, j: Column) -> Column:
        last, here = F.get(s["pairs"], j - 1), F.get(s["pairs"], j)
        start = F.struct(
            F.coalesce(last["a"] + 1, F.lit(0)).alias("a"),
            F.coalesce(last["b"] + 1, F.lit(0)).alias("b"),
            F.coalesce(here["a"], F.size(s["old"])).alias("to_a"),
            F.coalesce(here["b"], F.size(s["new"])).alias("to_b"),
        )
        return let(
            start,
            lambda p: F.concat(
                F.transform(
                    F.slice(s["old"], p["a"] + 1, p["to_a"] - p["a"]),
                    lambda x, i: _line("delete", p["a"] + i + 1, None, x),
                ),
                F.transform(
                    F.slice(s["new"], p["b"] + 1, p["to_b"] - p["b"]),
                    lambda x, i: _line("add", None, p["b"] + i + 1, x),
                ),
                F.transform(
                    F.slice(s["old"], p["to_a"] + 1, F.when(here.isNotNull(), 1).otherwise(0)),
                    lambda x: _line("equal", p["to_a"] + 1, p["to_b"] + 1, x),
                ),
            ),
        )

    def apart(s: Column) -> Column:
        """Nothing is kept: all deletions, then all additions."""
        return F.concat(
            F.transform(s["old"], lambda x, i: _line("delete", i + 1, None, x)),
            F.transform(s["new"], lambda x, i: _line("add", None, i + 1, x)),
        )

    return let(
        F.struct(old.alias("old"), new.alias("new"), pairs.alias("pairs")),
        lambda s: F.when(F.size(s["pairs"]) == 0, apart(s)).otherwise(
            F.flatten(F.transform(F.sequence(F.lit(0), F.size(s["pairs"])), lambda j: block(s, j)))
        ),
    )


def aligned_lines(old: list, new: list, every: int | None = None) -> list[tuple[int, int]]:
    """A longest common subsequence as index pairs.

    One tie rule for texts of every size: from the end backwards, an old line without which the
    rest before it aligns as well is deleted; a kept one goes with the earliest new line for which
    that still holds.  Where the pairs of n-th occurrences do not cross, they are this alignment.

    For each new line a big integer marks the old lines at which the alignment grows, so a row
    costs (old lines x new lines / 64) word operations.  Only every ``every``-th integer is kept;
    the way back makes those between anew, a block at a time.
    """
    head = 0
    while head < min(len(old), len(new)) and old[head] == new[head]:
        head += 1
    pairs = [(k, k) for k in range(head)]
    old, new = old[head:], new[head:]
    if not old or not new:
        return pairs
    where: dict = {}
    for i, line in enumerate(old):
        where[line] = where.get(line, 0) | (1 << i)
    full = (1 << len(old)) - 1
    every = every or isqrt(len(new)) + 1

    def block(state: int, lines: list) -> list[int]:
        states = [state]
        for line in lines:
            hit = state & where.get(line, 0)
            state = ((state + hit) | (state - hit)) & full
            states.append(state)
        return states

    kept = [full]
    for at in range(0, len(new), every):
        kept.append(block(kept[-1], new[at : at + every])[-1])
    found, i = [], len(old) - 1
    for n in range(len(kept) - 2, -1, -1):
        states = block(kept[n], new[n * every : (n + 1) * every])
        k = len(states) - 1  # a bit that is not set: the alignment grows at this old line
        while k > 0 and i >= 0:
            if states[k] >> i & 1:
                i -= 1
            elif states[k - 1] >> i & 1:
                found.append((head + i, head + n * every + k - 1))
                i, k = i - 1, k - 1
            else:
                k -= 1
    return pairs + found[::-1]


def _aligner():
    """Arrow UDF: the alignment as a flat array a0, b0, a1, b1, ...; null in, null out."""

    @F.pandas_udf("array<int>")
    def align(old: pd.Series, new: pd.Series) -> pd.Series:
        def one(a, b):
            if a is None or b is None:
                return None
            return [n for pair in aligned_lines(list(a), list(b)) for n in pair]

        return pd.Series([one(a, b) for a, b in zip(old, new)], dtype="object")

    return align


def lines_with_ends(text: Column) -> Column:
    """Lines that keep their newline; the last one has none if the text does not end with one."""
    return F.filter(F.split(text, r"(?<=\n)", -1), lambda x: x != "")


def with_diff(
    df: DataFrame, raw: str = "text", clean: str = "sanitized_text", out: str = "diff_lines", keep_ends: bool = False
) -> DataFrame:
    """Add the ordered diff of two text columns as an array of structs; nothing is shuffled.

    With ``keep_ends`` lines are compared with their terminators, and only the newline is left out
    of the content: a final newline on one side shows its line as deleted and added.
    """
    raw_col, clean_col = F.col(raw), F.col(clean)
    split = lines_with_ends if keep_ends else split_lines
    none = F.array().cast("array<struct<a:int,b:int>>")
    sides = let(
        F.struct(split(raw_col).alias("old"), split(clean_col).alias("new")),
        lambda s: F.when(
            s["old"] != s["new"],
            let(
                # Different sides of one line each have nothing to pair.
                F.when((F.size(s["old"]) < 2) & (F.size(s["new"]) < 2), none).otherwise(
                    occurrence_pairs(s["old"], s["new"])
                ),
                lambda p: F.struct(
                    s["old"].alias("old"), s["new"].alias("new"), p.alias("pairs"), pairs_cross(p).alias("cross")
                ),
            ),
        ),
    )
    changed = df.withColumn("_sides", F.when(raw_col != clean_col, sides))
    cross = F.col("_sides.cross")
    aligned = changed.withColumn(
        "_flat", _aligner()(F.when(cross, F.col("_sides.old")), F.when(cross, F.col("_sides.new")))
    )
    realigned = let(
        F.col("_flat"),
        lambda f: F.transform(
            F.filter(F.sequence(F.lit(0), F.size(f)), lambda k: (k % 2 == 0) & (k < F.size(f))),
            lambda k: F.struct(F.get(f, k).alias("a"), F.get(f, k + 1).alias("b")),
        ),
    )
    side = F.col("_sides")
    pairs = F.when(F.col("_flat").isNotNull(), realigned).otherwise(side["pairs"])
    unchanged = F.transform(split(raw_col), lambda x, i: _line("equal", i + 1, i + 1, x))
    diff = F.when(side.isNotNull(), assemble(side["old"], side["new"], pairs)).when(
        clean_col.isNotNull(), unchanged
    )
    if keep_ends:
        diff = F.transform(diff, lambda d: d.withField("content", F.rtrim(d["content"], F.lit("\n"))))
    return held(aligned, diff, out).drop("_sides", "_flat")


def diff_matches(content: Column, query: str) -> Column:
    """Case-insensitive search within diff lines; the empty query keeps all."""
    return F.lit(True) if query == "" else F.lower(content).contains(F.lower(F.lit(query)))


def render_line(line: Column) -> Column:
    """One diff line as text: the two numbers, the sign, the content."""
    sign = F.when(line["change_type"] == "delete", "-").when(line["change_type"] == "add", "+").otherwise(" ")

    def number(n: Column) -> Column:
        return F.coalesce(n.cast("string"), F.lit(""))

    return F.concat_ws(
        "\t", number(line["old_line_no"]), number(line["new_line_no"]), F.concat(sign, F.lit(" "), line["content"])
    )


def render_diff(diff: Column) -> Column:
    """The whole diff as one unified text."""
    return F.array_join(F.transform(diff, render_line), "\n")
