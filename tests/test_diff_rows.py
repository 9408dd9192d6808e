"""Diffs of line tables: rebuilt sides, agreement with the diff in the row, the subsequence of anchors."""

import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from veilspark.functions.diff import with_diff
from veilspark.operators import diff_rows as module
from veilspark.operators.diff_rows import diff_rows, increasing

SCHEMA = "source string, line_no long, line string"


def line_table(spark, sources):
    rows = [(k, i + 1, x) for k, lines in sources.items() for i, x in enumerate(lines)]
    return spark.createDataFrame(rows, SCHEMA).withColumn("content", F.lit(1)).repartition(4)


def by_source(df):
    out = {}
    for r in df.collect():
        out.setdefault(r.source, []).append((r.old_line_no, r.new_line_no, r.change_type, r.content))
    return out


def rebuilt(rows, side):
    return [r[3] for r in sorted((r for r in rows if r[side] is not None), key=lambda r: r[side])]


def longest(values):
    best = []
    for i, v in enumerate(values):
        best.append(1 + max([best[j] for j in range(i) if values[j] < v], default=0))
    return max(best, default=0)


def test_longest_increasing_subsequence():
    rng = random.Random(4)
    for n in [0, 1, 2, 5, 9, 30] * 10:
        values = rng.sample(range(100), n)
        places = increasing(values)
        picked = [values[i] for i in places]
        assert places == sorted(places) and picked == sorted(picked) and len(picked) == longest(values)


@pytest.mark.parametrize("width", [3, 20_000])
def test_diff_rows(spark, monkeypatch, width):
    monkeypatch.setattr(module, "SLICE", width)
    rng = random.Random(7)
    base = [f"line {i}" for i in range(120)]
    moved = base[:20] + base[60:70] + base[20:60] + base[70:]
    edited = [x + "!" if rng.random() < 0.1 else x for x in base if rng.random() > 0.1]
    repeats = [rng.choice("abc") for _ in range(60)]
    old = {"moved": base, "edited": base, "same": base[:9], "repeats": repeats, "gone": ["x", "x"], None: ["n", None, "m"], "turned": base[:12]}
    new = {"moved": moved, "edited": edited, "same": base[:9], "repeats": rng.sample(repeats, 50), "new": ["y"], None: ["m", None, "n", "q"],
           "turned": base[:12][::-1]}
    got = by_source(diff_rows(line_table(spark, old), line_table(spark, new), ["source"]))
    assert set(got) == set(old) | set(new)
    for k, rows in got.items():
        assert rebuilt(rows, 0) == old.get(k, []) and rebuilt(rows, 1) == new.get(k, [])
        equal = sorted((a, b) for a, b, kind, _ in rows if kind == "equal")
        assert all(x[1] < y[1] for x, y in zip(equal, equal[1:], strict=False))
        assert all((kind == "equal") == (a is not None and b is not None) for a, b, kind, _ in rows)
        assert all(old[k][a - 1] == new[k][b - 1] for a, b in equal)
    count = lambda k: sum(r[2] == "equal" for r in got[k])
    assert count("moved") == 110 and count("same") == 9 and count("turned") == 1
    assert count("edited") == len([x for x in edited if not x.endswith("!")])


def test_agrees_with_the_diff_in_the_row(spark):
    """Where pairs of n-th occurrences do not cross, both pair the same lines."""
    rng = random.Random(9)
    old, new = {}, {}
    for k in range(60):
        lines = [rng.choice("abcdef") if rng.random() < 0.4 else f"u{k}-{i}" for i in range(rng.randrange(1, 30))]
        cut = rng.randrange(len(lines) + 1)  # what is dropped lies at the end of each line's occurrences
        tail = [f"t{i}" for i in range(rng.randrange(4))]
        old[str(k)], new[str(k)] = lines, [x + "?" if x.startswith("u") and rng.random() < 0.3 else x for x in lines[:cut]] + tail
    got = by_source(diff_rows(line_table(spark, old), line_table(spark, new), ["source"]))
    texts = spark.createDataFrame([(k, "\n".join(old[k]), "\n".join(new[k])) for k in old], "source string, text string, sanitized_text string")
    agree = 0
    for r in with_diff(texts).collect():
        want = sorted((d.old_line_no or 0, d.new_line_no or 0, d.change_type, d.content) for d in r.diff_lines)
        agree += sorted((a or 0, b or 0, kind, c) for a, b, kind, c in got[r.source]) == want
    assert agree == len(old)


def test_empty_tables(spark):
    none, some = spark.createDataFrame([], SCHEMA), line_table(spark, {"s": ["a", "b"]})
    assert diff_rows(none, none, ["source"]).collect() == []
    assert [r.change_type for r in diff_rows(none, some, ["source"]).collect()] == ["add"] * 2
    assert [r.change_type for r in diff_rows(some, none, ["source"]).collect()] == ["delete"] * 2


def test_short_and_long_sources_are_paired_alike(spark, monkeypatch):
    """Sources within a slice are aligned in one pass; the steps for long ones give the same rows."""
    rng = random.Random(3)
    old = {str(k): [rng.choice("abcdefgh") + str(rng.randrange(3)) for _ in range(rng.randrange(25))] for k in range(40)}
    new = {k: rng.sample(v, len(v)) if rng.random() < 0.3 else [x for x in v if rng.random() < 0.8] + ["z", None] for k, v in old.items()}
    sides = [line_table(spark, x) for x in (old, new)]
    monkeypatch.setattr(module, "_large", lambda *_: pytest.fail("a source within a slice takes the long way"))
    short = by_source(diff_rows(*sides, ["source"]))
    monkeypatch.undo()
    monkeypatch.setattr(module, "SLICE", 1)
    long = by_source(diff_rows(*sides, ["source"]))
    order = lambda r: tuple((x is not None, x) for x in r)
    assert {k: sorted(v, key=order) for k, v in short.items()} == {k: sorted(v, key=order) for k, v in long.items()}


def test_sources_across_batches():
    rows = [(f"k{i // 7}", int(i % 7 > 3), i % 7, f"l{i % 5}") for i in range(70)]
    names = ["_k", "side", "no", "line"]

    def batch(part):
        columns = [pa.array(c) for c in zip(*part, strict=True)]
        return pa.record_batch([pa.StructArray.from_arrays([columns[0]], names=["source"]), *columns], ["_keys", *names])

    def run(width):
        return [r for b in module._by_source((batch(rows[i : i + width]) for i in range(0, 70, width)), 2) for r in b.to_pylist()]

    assert run(1) == run(3) == run(7) == run(10) == run(70) and len(run(70)) >= 40
