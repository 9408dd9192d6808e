import random
from itertools import groupby

from pyspark.sql import functions as F

from veilspark.functions.diff import aligned_lines, diff_matches, render_diff, with_diff
from veilspark.functions.lines import clean_lines, collapse_duplicates, prune_frames, split_lines
from veilspark.operators.runs import collapse_rows, find_runs, prune_rows

FRAME = "    at f (node_modules/a/b.js:1:2)"


def lines_of(text):
    parts = text.split("\n")
    if parts[-1] == "":
        parts.pop()
        return [p[:-1] if p.endswith("\r") else p for p in parts]
    return [p[:-1] if p.endswith("\r") else p for p in parts[:-1]] + parts[-1:]


def collapsed(lines):
    out = []
    for line, run in groupby(lines):
        n = len(list(run))
        out.append(f"{line} (Repeated {n}x)" if n > 1 else line)
    return out


def pruned(lines):
    out = []
    for frame, run in groupby(lines, lambda l: l.strip().startswith("at ") and "node_modules/" in l):
        run = list(run)
        out += [f"    ... [Pruned {len(run)} framework stack frames]"] if frame else run
    return out


def texts(n, seed):
    rng = random.Random(seed)
    pool = ["a", "b", "", FRAME, "at x", "é", "node_modules/ at", "c\r"]
    ends = ["\n", "\n", "\r\n"]
    return ["".join(rng.choice(pool) + rng.choice(ends) for _ in range(rng.randint(0, 9))) + rng.choice(["", "z"]) for _ in range(n)]


def test_split_lines(run):
    cases = ["", "\n", "a", "a\n", "a\n\n", "\na", "a\r\nb\r", "a\r\r\n"]
    assert run(split_lines, cases) == [[], [""], ["a"], ["a"], ["a", ""], ["", "a"], ["a", "b\r"], ["a\r"]]


def test_line_operators_against_brute_force(run):
    data = texts(300, 1)
    assert run(split_lines, data) == [lines_of(t) for t in data]
    assert run(prune_frames, data) == ["\n".join(pruned(lines_of(t))) for t in data]
    assert run(collapse_duplicates, data) == ["\n".join(collapsed(lines_of(t))) for t in data]
    assert run(clean_lines, data) == ["\n".join(collapsed(pruned(lines_of(t)))) for t in data]


def test_collapse_cases(run):
    got = run(collapse_duplicates, ["cannot reach mirror\n" * 3, "\n\n\n", "x\nx (Repeated 2x)\nx (Repeated 2x)"])
    assert got == ["cannot reach mirror (Repeated 3x)", " (Repeated 3x)", "x\nx (Repeated 2x) (Repeated 2x)"]


def test_bare_at_is_no_frame(run):
    assert run(prune_frames, ["at node_modules/", "at   ", "by vendor/bundle/ x"]) == [
        "    ... [Pruned 1 framework stack frames]", "at   ", "    ... [Pruned 1 framework stack frames]",
    ]


def test_runs_over_rows_do_not_depend_on_slices(spark):
    """One source owns nearly all rows; any slicing gives the runs of the whole."""
    rng = random.Random(3)
    lines = [rng.choice(["a", "b", FRAME, FRAME]) for _ in range(300)]
    rows = [("hot", i, l) for i, l in enumerate(lines)] + [("cold", 0, "a")]
    df = spark.createDataFrame(rows, "source string, seq long, line string")
    for width in (1, 50):
        cut = F.floor(F.col("seq") / width)
        for fn, brute in ((collapse_rows, collapsed), (prune_rows, pruned)):
            got = fn(df, ["source"], ["seq"], "line", cut).where("source = 'hot'").orderBy("seq")
            assert [r.line for r in got.collect()] == brute(lines)
        runs = find_runs(df, ["source"], ["seq"], "line", cut)
        assert runs.where("is_last").count() == 2
        assert runs.agg(F.sum("n")).first()[0] == len(rows)


def test_runs_over_a_tree_of_slices(spark):
    """One source of 10,000 slices, some of whose runs span many slices and levels; no window over the source."""
    rng = random.Random(6)
    lines, at = [], 0
    while at < 40_000:
        n = rng.choice([1, 1, 1, 2, 3, 40, 2500])
        lines += [rng.choice(["a", "b", FRAME, None])] * n
        at += n
    df = spark.createDataFrame(list(enumerate(lines)), "seq long, line string").withColumn("source", F.lit("hot"))
    df = df.repartition(8)
    fine, middle, coarse = (F.floor(F.col("seq") / k) for k in (4, 200, 10_000))
    want = [(len(list(run)), line) for line, run in groupby(lines)]
    for cut in ([fine, middle, coarse], [fine], [fine, middle], F.lit(1)):
        runs = find_runs(df, ["source"], ["seq"], "line", cut).orderBy("first").collect()
        assert [(r.n, r.line) for r in runs] == want
        assert [r.is_last for r in runs] == [False] * (len(want) - 1) + [True]
        assert all(r.last.seq - r.first.seq + 1 == r.n for r in runs)
        frames = prune_rows(df, ["source"], ["seq"], "line", cut).orderBy("seq").collect()
        assert [r.line for r in frames] == pruned([x or "" for x in lines]) or [r.line or "" for r in frames] == pruned([x or "" for x in lines])
    weights = [rng.randrange(1, 9) for _ in range(500)]
    rows = [(i, "x" if i % 7 else "y", w) for i, w in enumerate(weights)]
    heavy = spark.createDataFrame(rows, "seq long, line string, w int").withColumn("source", F.lit(None).cast("string"))
    runs = find_runs(heavy, ["source"], ["seq"], "line", [F.floor(F.col("seq") / 3), F.floor(F.col("seq") / 30)], weight="w").orderBy("first")
    assert [r.n for r in runs.collect()] == [sum(r[2] for r in run) for _, run in groupby(rows, key=lambda r: r[1])]


def test_a_gap_ends_a_run(spark):
    seconds = [0, 10, 20, 80, 81, 200, 260, 261]
    df = spark.createDataFrame([(i, s, "x") for i, s in enumerate(seconds)], "seq long, s long, line string")
    df = df.withColumn("ts", F.timestamp_seconds("s")).withColumn("source", F.lit(1))
    for cut in (F.lit(0), F.col("seq"), [F.col("seq"), F.floor(F.col("seq") / 3)]):
        got = collapse_rows(df, ["source"], ["seq"], "line", cut, time="ts", gap="1 minute").orderBy("seq").collect()
        assert [(r.seq, r.n) for r in got] == [(0, 5), (5, 3)]


def lcs_length(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        last = row[:]
        for j, y in enumerate(b):
            row[j + 1] = last[j] + 1 if x == y else max(row[j], last[j + 1])
    return row[-1]


def diff_of(spark, pairs):
    df = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(pairs)], "i int, text string, sanitized_text string")
    return [r.diff_lines for r in with_diff(df).orderBy("i").collect()]


def test_diff_rebuilds_both_sides_and_is_shortest(spark):
    rng = random.Random(5)
    make = lambda: "\n".join(rng.choice("abcdef") for _ in range(rng.randint(0, 14)))
    pairs = [(make(), make()) for _ in range(400)] + [("X\nX\nY\nX", "X (Repeated 2x)\nY\nX"), ("a\nb", "a\nb"), ("", "")]
    for (old, new), diff in zip(pairs, diff_of(spark, pairs)):
        olds, news = lines_of(old), lines_of(new)
        assert [d.content for d in diff if d.change_type != "add"] == olds
        assert [d.content for d in diff if d.change_type != "delete"] == news
        assert [d.old_line_no for d in diff if d.old_line_no] == list(range(1, len(olds) + 1))
        assert [d.new_line_no for d in diff if d.new_line_no] == list(range(1, len(news) + 1))
        assert sum(d.change_type == "equal" for d in diff) == lcs_length(olds, news)
        kinds = "".join(d.change_type[0] for d in diff)
        assert "ad" not in kinds  # between kept lines, deletions come first


def walked(a, b):
    """The alignment by its tie rule, read off the table of all prefixes."""
    table = [[0] * (len(b) + 1)]
    for x in a:
        row = [0]
        for j, y in enumerate(b):
            row.append(table[-1][j] + 1 if x == y else max(row[j], table[-1][j + 1]))
        table.append(row)
    pairs, i, j = [], len(a), len(b)
    while i and j:
        if table[i][j] == table[i - 1][j]:
            i -= 1
        elif table[i][j - 1] > table[i - 1][j - 1]:
            j -= 1
        else:
            i, j = i - 1, j - 1
            pairs.append((i, j))
    return pairs[::-1]


def test_alignment_follows_one_tie_rule(spark):
    """The same pairs whatever the block size, and whether the occurrence pairs cross or not."""
    rng = random.Random(8)
    make = lambda: [rng.choice("abcde") for _ in range(rng.randint(0, 16))]
    pairs = [(make(), make()) for _ in range(1500)]
    for a, b in pairs:
        expected = walked(a, b)
        assert all(aligned_lines(a, b, every) == expected for every in (None, 1, 2, 3, 50))
    diffs = diff_of(spark, [("\n".join(a), "\n".join(b)) for a, b in pairs[:300]])
    for (a, b), diff in zip(pairs, diffs):
        equal = [(d.old_line_no - 1, d.new_line_no - 1) for d in diff if d.change_type == "equal"]
        assert equal == walked(a, b)


def test_diff_of_large_crossing_texts(spark):
    old = [f"l{i % 701}" for i in range(21_000)]
    new = old[9_000:] + old[:6_000]
    diff = diff_of(spark, [("\n".join(old), "\n".join(new))])[0]
    assert [d.content for d in diff if d.change_type != "add"] == old
    assert [d.content for d in diff if d.change_type != "delete"] == new
    assert sum(d.change_type == "equal" for d in diff) >= 14_000
    old, new = old[:3_000], new[:2_500]
    assert aligned_lines(old, new, 7) == aligned_lines(old, new, 10_000) == aligned_lines(old, new)


def test_diff_with_terminators(spark):
    rows = [("a\nb\n", "a\nb"), ("a\r\nb", "a\nb"), ("", "x\n"), (None, "x")]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, text string, sanitized_text string")
    got = [r.diff_lines for r in with_diff(df, keep_ends=True).orderBy("i").collect()]
    assert [[(d.change_type, d.content) for d in diff or []] for diff in got[:3]] == [
        [("equal", "a"), ("delete", "b"), ("add", "b")], [("delete", "a\r"), ("add", "a"), ("equal", "b")], [("add", "x")],
    ]


def test_diff_case_search_and_render(spark):
    old = "boot\nhost db-7 asked for pin 4471\nbye"
    new = "boot\nhost db-7 asked for pin [HIDDEN]\nbye"
    df = with_diff(spark.createDataFrame([(old, new), (None, None)], "text string, sanitized_text string"))
    rows = df.select("diff_lines", render_diff(F.col("diff_lines")).alias("u")).collect()
    assert [d.change_type for d in rows[0].diff_lines] == ["equal", "delete", "add", "equal"]
    assert rows[0].u.split("\n")[1:3] == ["2\t\t- host db-7 asked for pin 4471", "\t2\t+ host db-7 asked for pin [HIDDEN]"]
    assert rows[1].diff_lines is None
    long = df.select(F.explode("diff_lines").alias("d")).select("d.*")
    assert long.where(diff_matches(F.col("content"), "HIDDEN")).count() == 1
    assert long.where(diff_matches(F.col("content"), "")).count() == 4


def test_diff_of_single_lines_and_of_nothing_kept(spark):
    """Sides of one line each are not paired, and sides without a common line are not cut into blocks."""
    texts = [("a", "b"), ("", "b"), ("a", ""), ("a\n", "b"), ("a", "a"), ("a\nb", "c\nd"), ("a\nb", "b")]
    df = spark.createDataFrame([(i, *t) for i, t in enumerate(texts)], "i int, text string, sanitized_text string")
    got = [[tuple(d)[:3] for d in r.diff_lines] for r in with_diff(df).orderBy("i").collect()]
    gone, new = ("delete", 1, None), ("add", None, 1)
    assert got == [
        [gone, new], [new], [gone], [gone, new], [("equal", 1, 1)],
        [gone, ("delete", 2, None), new, ("add", None, 2)], [gone, ("equal", 2, 1)],
    ]
