"""Collocations against plain counting."""

import random
import re
from collections import Counter, defaultdict

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from veilspark.llm.collocations import _shards, collocations, frequent_phrases

SCHEMA = "doc_id bigint, text string, lang string"


def ascii_lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def plain_counts(rows, longest):
    f, n = Counter(), Counter()
    for _, text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\n\x0b\x0c\r]", ascii_lower(text or "")):
            words = re.findall(r"[^ \t]+", piece)
            n[lang] += len(words)
            for size in range(1, longest + 1):
                for i in range(len(words) - size + 1):
                    f[lang, tuple(words[i : i + size])] += 1
    return f, n


def plain_version(rows, longest=3, support=10, absorb=50, top=2000):
    f, n = plain_counts(rows, longest)
    often = {k: a for k, a in f.items() if a >= support and len(k[1]) > 1}
    most = defaultdict(int)
    for (lang, words), a in often.items():
        for size in range(2, len(words)):
            for i in range(len(words) - size + 1):
                most[lang, words[i : i + size]] = max(most[lang, words[i : i + size]], a)
    out = defaultdict(list)
    for (lang, words), a in often.items():
        if (lang, words) in most and 100 * most[lang, words] >= absorb * a:
            continue
        cuts = []
        for k in range(1, len(words)):
            left, right = f[lang, words[:k]], f[lang, words[k:]]
            cuts.append((10**6 * a * a // (left * right), k, left, right))
        score, _, left, right = min(cuts)
        out[lang].append((-score, -a, " ".join(words).encode(), left, right))
    rows = []
    for lang, found in out.items():
        for rank, (score, a, phrase, left, right) in enumerate(sorted(found)[:top], 1):
            rows.append((lang, rank, phrase.decode(), -a, left, right, n[lang], -score))
    return sorted(rows)


def corpus(seed=1, docs=300):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(25)] + ["É", "A", "a", "x\x00y", "漢", "b c", "New", "york", "city"]
    rows = []
    for i in range(docs):
        text = "".join(rng.choice(words) + rng.choice([" ", " ", " ", "  ", "\t", ". ", ",", "\n", "; ", "\x0b"]) for _ in range(rng.randrange(60)))
        rows.append((i, text, rng.choice(["en", "fr", None, "und", ""])))
    rows += [(400, "New York City " * 400, "en"), (401, None, "fr"), (402, "", None), (None, "a a a a a a a a a a a a", "es")]
    return rows + rows[:20] + [(500, "no phrase here", "xx")]


@pytest.mark.parametrize("longest,support,absorb,top,shard", [(3, 10, 50, 2000, 1 << 24), (3, 2, 50, 40, 500), (4, 5, 90, 2000, 20_000), (2, 3, 50, 5, 1)])
def test_collocations_match_plain_version(spark, longest, support, absorb, top, shard):
    rows = corpus()
    df = spark.createDataFrame(rows, SCHEMA).repartition(5).withColumn("phrase", F.lit("x")).withColumn("n", F.lit(0))
    got = collocations(df, longest, support, absorb, top, shard)
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    assert sorted(map(tuple, got.collect())) == plain_version(rows, longest, support, absorb, top)


def test_counts_do_not_depend_on_shards(spark):
    rows = corpus(2)
    f, n = plain_counts(rows, 3)
    want = {(lang, len(w), " ".join(w), a) for (lang, w), a in f.items() if a >= 10} | {(k, 0, "", v) for k, v in n.items()}
    df = spark.createDataFrame(rows, SCHEMA)
    for parts, shard in ((1, 100), (1, 3000), (7, 1 << 20)):
        got = frequent_phrases(df.coalesce(1).repartition(parts), 3, 10, shard).where("size > 0 OR f > 0").collect()
        assert {tuple(r) for r in got} == {w for w in want if w[1] or w[3]}


def test_exact_beyond_64_bits(spark):
    """The product of a million and two counts of some 4e6 passes 2**63."""
    many = "p q." * 1_100_000
    got = collocations(spark.createDataFrame([(i, many, "en") for i in range(4)], SCHEMA)).collect()
    assert [tuple(r) for r in got] == [("en", 1, "p q", 4_400_000, 4_400_000, 4_400_000, 8_800_000, 1_000_000)]


def test_long_texts_are_cut_where_pieces_end():
    text = "a b c. " * 500 + "q" * 3000 + " r s." + "t u. " * 300
    batch = pa.record_batch([pa.array(["en", "en", "fr"]), pa.array(["x y.", text, "z"])], ["lang", "text"])
    parts = [t.as_py() for held in _shards(iter([batch]), 200) for b in held for t in b.column("text")]
    assert "".join(parts) == "x y." + text + "z" and max(map(len, parts)) < 3600 and len(parts) > 10
    assert all(p[-1] in ". " or p == "z" for p in parts)


def test_empty_table(spark):
    assert collocations(spark.createDataFrame([], SCHEMA)).collect() == []
    assert collocations(spark.createDataFrame([(1, None, None), (2, " .\t", "en")], SCHEMA)).collect() == []
