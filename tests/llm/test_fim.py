"""Fill-in-middle against a version that splits the text."""

import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from veilspark.llm.fim import Marked, fill_in_middle, followers, line_feeds, restored

SCHEMA = "doc_id bigint, text string"


def plain_version(doc_id, text, rate=100, spm=50, seed=7):
    text = text or ""
    units = re.findall(r"[^\n]*\n|[^\n]+", text)
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * i : 8 * i + 8], 16) for i in range(4)]
    n = len(units)
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h[2] % 100 >= rate:
        return doc_id, n, "plain", None, None, text
    if h[3] % 100 < spm:
        return doc_id, n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return doc_id, n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def texts():
    rng = random.Random(3)
    odd = [
        None, "", "\n", "\n\n", "a", "a\n", "\na", "x\r\ny", "<P>", "a<S>\nb\n", "<M", "<\n<\nP>\n", "S>\n<P\n>\n",
        "é\n漢字\n😀 z\n", "\x00\n\x0b\x0c\x85\n", "\x8a\nਊ\n", "\n" * 5000, "long " * 90_000 + "\n" + "ü" * 70_000,
    ]
    drawn = ["".join(rng.choice("ab\n\n é漢😀<P>S") for _ in range(rng.randrange(60))) for _ in range(400)]
    return odd + drawn


def test_rank_and_select_match_a_scan():
    rng = np.random.default_rng(5)
    for size in (0, 1, 7, 8, 9, 64, 1000):
        data = rng.choice(np.array([0x0A, 0x8A, 0x0B, 0x09, 0x00, 0xFF, 0x80, 0xBF, 0xC3, 0x7F], np.uint8), size)
        padded = np.zeros((size + 8) // 8 * 8, np.uint8)
        padded[:size] = data
        for marks, hit in ((line_feeds, padded == 0x0A), (followers, (padded & 0xC0) == 0x80)):
            marked, where = Marked(marks(padded.view("<u8"))), np.flatnonzero(hit)
            assert marked.rank(np.arange(size + 1)).tolist() == np.concatenate(([0], np.cumsum(hit)))[: size + 1].tolist()
            assert marked.select(np.arange(1, len(where) + 1)).tolist() == where.tolist()


@pytest.mark.parametrize("rate,spm,seed", [(100, 50, 7), (60, 0, 1), (0, 50, 7), (100, 100, 2)])
def test_fill_in_middle_matches_plain_version(spark, rate, spm, seed):
    rows = [(i, t) for i, t in enumerate(texts())] + [(None, "p\nq\nr"), (3, "\n\n"), (3, "\n\n")]
    df = spark.createDataFrame(rows, SCHEMA).withColumn("n", F.lit("x")).withColumn("output", F.lit(1))
    made = fill_in_middle(df, rate=rate, spm=spm, seed=seed)
    got = made.withColumn("back", restored(F.col("output"), F.col("form"))).collect()
    want = [plain_version(i, t, rate, spm, seed) for i, t in rows]
    key = lambda r: tuple((x is not None, x) for x in r)
    assert sorted((tuple(r)[:6] for r in got), key=key) == sorted(want, key=key)
    texts_of = {i: t or "" for i, t in rows}
    assert all(r.back == texts_of[r.doc_id] for r in got)
    if (rate, spm) == (100, 50):
        assert {r.form for r in got} == {"plain", "psm", "spm"}


def test_other_ids_and_empty_table(spark):
    df = spark.createDataFrame([("a", "1\n2\n3"), ("ü", None)], "key string, body string")
    got = {r.doc_id: r for r in fill_in_middle(df, text="body", doc_id="key").collect()}
    assert tuple(got["a"]) == plain_version("a", "1\n2\n3") and got["ü"].form == "plain"
    assert fill_in_middle(spark.createDataFrame([], SCHEMA)).collect() == []
    with pytest.raises(ValueError):
        fill_in_middle(df, text="body", doc_id="key", marks=("<P>", "<P>", "<M>"))
