"""Deduplication, decontamination and scoring operators against plain versions on small tables."""

import hashlib
import math
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from veilspark.llm.backoff_lm import backoff_scores
from veilspark.llm.components import components
from veilspark.llm.decontaminate import benchmark_leaks, drop_leaks
from veilspark.llm.exact_dedup import drop_copies, exact_groups
from veilspark.llm.near_dedup import drop_near_copies, near_groups
from veilspark.llm.substring_dedup import remove_repeats

WORD = re.compile(r"[^\x20\x09-\x0D]+")
UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def prose(seed: int, n: int) -> list[str]:
    return [f"w{hashlib.md5(f'{seed}.{i}'.encode()).hexdigest()[:4]}" for i in range(n)]


@pytest.fixture(scope="module")
def rows():
    """(doc_id, text): copies, near copies, a shared passage, short, blank, empty, null and long texts."""
    base, passage, long = prose(1, 120), prose(2, 60), prose(3, 30_000)
    out = [(1, " ".join(base)), (2, "\t".join(base) + "\n"), (3, " ".join(base).upper())]
    for i in range(4, 44):
        edited = list(base)
        for k in range(i % 9):
            edited[(i * 7 + k * 13) % 120] = f"x{i}.{k}"
        out.append((i, " ".join(edited)))
    for i in range(44, 64):
        out.append((i, " ".join(prose(i, i - 40) + passage + prose(-i, i - 44))))
    out += [(70, None), (71, ""), (72, " \n\t "), (73, "one two"), (74, "One  two"), (75, "é É é"), (76, "one")]
    out += [(77, " ".join(long)), (78, " ".join(long[:25_000])), (79, " ".join(["same"] * 50)), (80, "a b c d e")]
    return out


def table(spark, rows):
    # Columns whose names the operators use themselves.
    extra = ["chunk", "share", "digest", "key", "rep", "n", "size", "_kept_id", "words", "label"]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    return df.select("*", *[F.lit("extra").alias(c) for c in extra], F.lit("s").alias("source"), F.lit("en").alias("lang"))


def empty(spark):
    return table(spark, [(1, "x")]).where("false")


def jaccard_components(rows):
    sets = {}
    for i, text in rows:
        words = WORD.findall((text or "").translate(UPPER))
        sets[i] = {tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))} if words else set()
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            both, union = len(sets[a] & sets[b]), len(sets[a] | sets[b])
            if a < b and both and 100 * both >= 75 * union:
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {i: (len(sets[i]), find(i)) for i in ids}


def test_near_groups(spark, rows):
    got = near_groups(table(spark, rows)).collect()
    want = jaccard_components(rows)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == want
    assert {r.doc_id for r in got if r.kept} == {i for i, (_, c) in want.items() if i == c}
    kept = drop_near_copies(table(spark, rows))
    assert {r.doc_id for r in kept.collect()} == {i for i, (_, c) in want.items() if i == c}
    assert kept.columns == table(spark, rows).columns


def test_near_groups_of_odd_tables(spark):
    assert near_groups(empty(spark)).count() == 0
    got = near_groups(table(spark, [(None, "a b c d e f"), (None, None), (5, "a b c d e f"), (5, "a b c d e f")]))
    assert sorted((str(r.doc_id), str(r.component_id), r.kept) for r in got.collect()) == [
        ("5", "5", True), ("5", "5", True), ("None", "5", False), ("None", "None", True),
    ]


def test_one_row_of_each_near_group_stays(spark):
    x, y = "one two three four five six", "some other words that are long enough"
    rows = [(2, x, "p"), (5, y, "q"), (5, x, "r"), (5, y, "s"), (None, y, "t"), (None, "", "u"), (None, "z", "v"), (None, "z", "w"), (7, None, "x")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, component_id string")
    first = sorted((str(r.doc_id), str(r.text), r.component_id) for r in drop_near_copies(df).collect())
    assert [r[:2] for r in first] == [("2", x), ("5", y), ("7", "None"), ("None", ""), ("None", "z")]
    again = drop_near_copies(df.repartition(7))
    assert sorted((str(r.doc_id), str(r.text), r.component_id) for r in again.collect()) == first and again.columns == df.columns
    assert drop_near_copies(df.where("false")).count() == 0


def test_copies_that_differ_elsewhere(spark):
    rows = [(1, "a  b", "p", {"k": 1}), (1, "a b", "q", None), (1, "a b", "r", {}), (2, "a b", "s", {}), (None, "c", "t", {}), (None, "c", "u", {})]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, _kept_id string, m map<string,int>")
    first = sorted(str(r) for r in drop_copies(df).collect())
    assert len(first) == 2 and "text='a  b'" in first[1] or "text='a  b'" in first[0]
    assert all(sorted(str(r) for r in drop_copies(df.repartition(n)).collect()) == first for n in (1, 5))
    assert drop_copies(df).columns == df.columns and drop_copies(df.where("false")).count() == 0


def test_components_of_a_chain(spark):
    links = spark.range(1, 60).select(F.col("id").alias("a"), (F.col("id") - 1).alias("b"))
    links = links.union(spark.createDataFrame([(100, 101), (102, 101)], "a bigint, b bigint"))
    got = {r.node: r.component for r in components(links).collect()}
    assert got == {i: 0 for i in range(60)} | {100: 100, 101: 100, 102: 100}


def normal(text):
    return re.sub(r"[\x20\x09-\x0D]+", " ", text or "")


@pytest.mark.parametrize("weak", [False, True])
def test_exact_groups(spark, rows, weak):
    digest = {"digest": lambda c: (F.crc32(c.cast("binary")) % 3).cast("string")} if weak else {}
    got = {r.doc_id: r for r in exact_groups(table(spark, rows), **digest).collect()}
    groups = {}
    for i, text in rows:
        groups.setdefault(normal(text), []).append(i)
    assert len(got) == len(rows)
    for text, ids in groups.items():
        for i in ids:
            r = got[i]
            assert (r.keep_id, r.group_size, r.kept) == (min(ids), len(ids), i == min(ids))
            assert weak or r.digest == hashlib.sha256(text.encode()).hexdigest()


def test_exact_groups_of_odd_tables(spark):
    assert exact_groups(empty(spark)).count() == 0
    df = table(spark, [(None, "a"), (None, "a"), (3, "b"), (3, "b"), (4, "b"), (None, "b")])
    got = sorted((str(r.doc_id), str(r.keep_id), r.group_size, r.kept) for r in exact_groups(df).collect())
    assert got == [("3", "3", 4, True), ("4", "3", 4, False), ("None", "3", 4, False), ("None", "None", 2, True)]
    kept = drop_copies(df)
    assert sorted((str(r.doc_id), r.text) for r in kept.collect()) == [("3", "b"), ("None", "a")]
    assert kept.columns == df.columns


def repeats(rows, width=20):
    seen, out = set(), {}
    for i, text in sorted(rows):
        words, gone = WORD.findall(text or ""), set()
        for k in range(len(words) - width + 1):
            key = tuple(words[k : k + width])
            if key in seen:
                gone.update(range(k, k + width))
            seen.add(key)
        out[i] = (len(words), len(gone), " ".join(w for k, w in enumerate(words) if k not in gone))
    return out


@pytest.mark.parametrize("bytes_", [2_000, 8 << 20])
def test_remove_repeats(spark, rows, bytes_):
    got = remove_repeats(table(spark, rows), chunk_bytes=bytes_, share_bytes=bytes_ * 3).collect()
    assert {r.doc_id: (r.n_words, r.n_removed, r.kept_text) for r in got} == repeats(rows)
    assert all(sum(s["to"] - s["from"] for s in r.spans) == r.n_removed for r in got)


def test_remove_repeats_of_odd_tables(spark):
    assert remove_repeats(empty(spark)).count() == 0
    text = " ".join(prose(9, 25))
    got = remove_repeats(table(spark, [(None, text), (2, text), (2, text), (3, None)]))
    assert sorted((str(r.doc_id), r.n_removed) for r in got.collect()) == [("2", 0), ("2", 25), ("3", 0), ("None", 25)]
    with pytest.raises(ValueError):
        remove_repeats(empty(spark), width=10, block=10)


def backoff(rows, alpha=0.4):
    total, own = Counter(), []
    for _, text in rows:
        words, c = WORD.findall(text or ""), Counter()
        for n in (0, 1, 2, 3):
            c.update(tuple(words[k : k + n]) for k in range(len(words) - n + 1 if n else len(words)))
        total.update(c)
        own.append((words, c))
    out = []
    for words, c in own:
        score = 0.0
        for k in range(len(words)):
            value, back = None, 1.0
            for n in range(min(k + 1, 3), 0, -1):
                gram = tuple(words[k - n + 1 : k + 1])
                if total[gram] > c[gram]:
                    value = back * (total[gram] - c[gram]) / (total[gram[:-1]] - c[gram[:-1]])
                    break
                back *= alpha if n > 1 else 1
            score += math.log(value if value else back / (total[()] - c[()] + 1))
        out.append((len(words), round(score, 5)))
    return sorted(out)


@pytest.mark.parametrize("bytes_", [2_000, 8 << 20])
def test_backoff_scores(spark, rows, bytes_):
    odd = [*rows, (None, "one two three"), (73, "one two")]
    got = backoff_scores(table(spark, odd), chunk_bytes=bytes_, share_bytes=bytes_ * 3).collect()
    assert sorted((r.n_words, round(r.score, 5)) for r in got) == backoff(odd)
    assert all((r.mean_score is None) == (r.n_words == 0) for r in got)
    assert backoff_scores(empty(spark)).count() == 0


def leaks(docs, items):
    """The best similarity of an item to all windows of its length, wherever they lie, and the windows that have it."""

    def grams(words):
        return [tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))] if words else []

    out = {}
    for item, itext in items:
        iw = WORD.findall((itext or "").lower())
        for doc, text in docs:
            w = WORD.findall((text or "").lower())
            y = Counter(grams(iw))
            for start in range(max(0, len(w) - len(iw)) + 1) if iw and w and doc is not None else []:
                x = Counter(grams(w[start : start + len(iw)]))
                value = (x & y).total() / (x | y).total()
                if value >= 0.75:
                    out.setdefault((doc, item), []).append((round(value, 9), start))
    return {k: (max(v)[0], {s for x, s in v if x == max(v)[0]}) for k, v in out.items()}


def test_benchmark_leaks(spark, rows):
    item = prose(5, 40)
    edited = item[:17] + ["other"] + item[18:]
    docs = [r for r in rows if r[0] not in (77, 78)] + [
        (90, " ".join(prose(6, 30) + item + prose(7, 30))),
        (91, " ".join(prose(8, 10) + edited + prose(7, 3)).upper()),
        (92, " ".join(item[:15] + prose(9, 50))),
        (93, " ".join(item[:37])),
        (94, " ".join(prose(6, 30) + item[20:] + item[:20] + prose(7, 30))),  # halves swapped
        (95, " ".join(prose(6, 33) + item[3:])),  # ends with the text
        (96, " ".join(["same"] * 60)),
        (96, "a clean text with the id of another"),
        (None, " ".join(item)),
    ]
    items = [(1, " ".join(item)), (2, " ".join(prose(2, 60)[5:45])), (3, "one two"), (4, None), (5, ""), (6, " ".join(["same"] * 20)), (1, " ".join(item))]
    bench = spark.createDataFrame(items, "item_id bigint, text string").withColumn("doc_id", F.lit(1))
    df = table(spark, docs)
    got = {(r.doc_id, r.item_id): (round(r.similarity, 9), r.start) for r in benchmark_leaks(df, bench).collect()}
    want = leaks(docs, items)
    assert {k: v for k, (v, _) in got.items()} == {k: v for k, (v, _) in want.items()}
    assert all(start in want[k][1] for k, (_, start) in got.items())
    assert {(90, 1), (91, 1), (93, 1), (94, 1), (95, 1), (96, 6), (44, 2), (73, 3)} <= set(got) and (92, 1) not in got
    kept = drop_leaks(df.withColumn("_leak_a", F.lit(1)), bench)
    assert kept.columns == [*df.columns, "_leak_a"]
    bad = {t for i, t in docs if (i, t) != (96, "a clean text with the id of another") and (i in {d for d, _ in got} or i is None)}
    assert sorted((str(r.doc_id), str(r.text)) for r in kept.collect()) == sorted((str(i), str(t)) for i, t in docs if t not in bad)
    assert drop_leaks(empty(spark), bench).count() == 0 and drop_leaks(df, bench.where("false")).count() == len(docs)
    assert benchmark_leaks(empty(spark), bench).count() == 0
    assert benchmark_leaks(df, bench.where("false")).count() == 0


def test_words_that_polynomials_confuse_stay_apart(spark):
    """A Thue-Morse word and its complement have one polynomial hash modulo 2^64."""
    pairs = []
    for n in (1024, 4096):
        bits = [bin(i).count("1") % 2 for i in range(n)]
        pairs.append(("".join("ab"[b] for b in bits), "".join("ab"[1 - b] for b in bits)))
    rest = " ".join(prose(9, 30))
    rows = [(10 * i + j, f"{word} {rest}" if alone else " ".join([word] * 25)) for i, (pair, alone) in enumerate((p, a) for p in pairs for a in (0, 1)) for j, word in enumerate(pair)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    single = [(i, t) for i, t in rows if len(set(t.split())) == 1]
    groups = near_groups(spark.createDataFrame(single, "doc_id bigint, text string")).collect()
    assert {r.doc_id: r.component_id for r in groups} == {i: i for i, _ in single}
    kept = {r.doc_id: r.n_removed for r in remove_repeats(docs, width=20).collect()}
    seen, expected = set(), {}
    for i, text in rows:
        words = text.split()
        gone = set()
        for p in range(len(words) - 19):
            window = tuple(words[p : p + 20])
            if window in seen:
                gone |= set(range(p, p + 20))
            seen.add(window)
        expected[i] = len(gone)
    assert kept == expected
