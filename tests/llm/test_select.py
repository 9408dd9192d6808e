"""Mixing, quality, languages, licences and token counts."""

import base64
import re
from collections import Counter

import pytest
import tiktoken
from pyspark.sql import functions as F

from tests.llm.test_dedup import empty, prose, table
from veilspark.llm.langid import detect_language
from veilspark.llm.licenses import bigrams, dice, scan_licenses
from veilspark.llm.mixing import mix, sainte_lague
from veilspark.llm.quality import drop_poor, kth_largest, quality_weights
from veilspark.llm.queries import VOCABULARY, op2_token_counts
from veilspark.llm.token_rollup import PATTERN, Rollup, _stretches, count_tokens, revised, signed

SF = "/root/testdata/sf0.001"


def test_sainte_lague(spark):
    votes = [(g, k, v) for g in range(6) for k, v in enumerate([53 * (g + 1), 24, 23, 7 * g, 7 * g, 1, 0, 900 * g][: g + 3])]
    df = spark.createDataFrame(votes, "g int, k int, v bigint").withColumn("seats", F.col("g") * 37 + 5)
    got = {(r.g, r.k): r.quota for r in sainte_lague(df, ["g"], "v", "seats", [F.col("k")]).collect()}
    for g in range(6):
        quotients = sorted(((-v / (2 * i + 1), k, i) for h, k, v in votes if h == g for i in range(400)))
        want = Counter(k for _, k, _ in quotients[: g * 37 + 5])
        assert {k: n for (h, k), n in got.items() if h == g and n} == want


def test_mix(spark):
    sources = ["b", "a", None, "é", "c", "z"]
    rows = [(i, " ".join(prose(i, i % 97)), sources[(i * i) % 7 % 6]) for i in range(900)] + [(900, None, "a"), (None, "x y", "a"), (7, "x y z", "b")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, source string").withColumn("size", F.lit("x"))
    got = mix(df).collect()
    again = mix(df.repartition(5)).collect()
    assert Counter(map(tuple, got)) == Counter(map(tuple, again)) and len(got) == len(rows)
    size = Counter()
    for _, text, source in rows:
        size[source] += len((text or "").split())
    order = sorted(size, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    open_, target = set(order), {}
    while True:
        rest = sum(size.values()) - sum(target.values())
        share = {s: rest * weight[s] / sum(weight[x] for x in open_) for s in open_}
        over = {s for s in open_ if share[s] > 3 * size[s]}
        if not over:
            target |= share
            break
        target |= {s: 3 * size[s] for s in over}
        open_ -= over
    taken = Counter()
    for r in got:
        assert r.target == pytest.approx(target[r.source]) and r.source_size == size[r.source]
        assert 0 <= r.taken <= 3 * r.size
        taken[r.source] += r.taken
    for s in order:
        assert abs(taken[s] - target[s]) <= max(3, 0.02 * target[s])
    assert mix(empty(spark)).count() == 0
    assert [r.taken for r in mix(table(spark, [(1, None), (2, " ")])).collect()] == [0, 0]


def test_quality(spark):
    good = [(i, " ".join(prose(i % 7, 40))) for i in range(60)]
    poor = [(i, " ".join(f"{w}%%%" for w in prose(i % 5, 40))) for i in range(60, 90)]
    odd = [(90, None), (91, ""), (92, " "), (None, good[0][1]), (3, good[3][1])]
    df = table(spark, good + poor + odd)
    labels = spark.createDataFrame([(i, int(i < 60), 0) for i in range(0, 90, 2)] + [(None, 1, 0), (1, None, 0)], "doc_id bigint, quality int, toxic int")
    kept = {(r.doc_id, r.kept) for r in quality_weights(df, labels).collect()}
    assert {i for i, k in kept if k} == {i for i, _ in good} | {None}
    rest = drop_poor(df, labels)
    assert rest.columns == df.columns and rest.count() == 62
    assert all(r.kept == (r.n_grams > 0) for r in quality_weights(df, labels.where("false")).collect())
    assert quality_weights(empty(spark), labels).count() == 0 and drop_poor(empty(spark), labels).count() == 0
    named = df.withColumn("doc_id", F.concat(F.lit("k"), "doc_id"))
    marks = labels.withColumn("doc_id", F.concat(F.lit("k"), "doc_id"))
    assert drop_poor(named, marks).count() == 62
    assert quality_weights(df, labels, keep=0.25).where("kept").count() == round(0.25 * 92)


def test_kth_largest(spark):
    df = spark.range(5000).select(F.pow(F.lit(1.01), F.col("id") % 1900).alias("x"))
    values = sorted((r.x for r in df.collect()), reverse=True)
    for part in (0.001, 0.3, 0.77, 1.0):
        assert kth_largest(df, "x", part, bins=16) == values[round(5000 * part) - 1]


def test_language(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    held_out = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2
    got = detect_language(docs, held_out).join(docs.select("doc_id", "lang"), "doc_id").where("held_out")
    right, n = got.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int")), F.count("*")).first()
    assert n > 2000 and right > 0.95
    odd = table(spark, [(1, None), (2, ""), (3, "12 !"), (None, "and the thing"), (4, "and the thing")])
    rows = detect_language(odd, F.col("doc_id") == 9).collect()
    assert [(r.doc_id, r.lang_pred) for r in rows] == [(1, "und"), (2, "und"), (3, "und"), (None, "en"), (4, "en")]
    assert all(0 <= r.score <= 1 for r in rows)
    assert {r.lang_pred for r in detect_language(odd, F.lit(True)).collect()} == {"und"}
    assert detect_language(empty(spark), F.lit(False)).count() == 0


def test_licenses(spark):
    known = {"A": ["alpha beta gamma delta epsilon", "single"], "B": ["alpha beta gamma delta zeta eta theta iota"]}
    texts = ["Alpha, beta; GAMMA delta epsilon!", "x\nalpha beta gamma delta epsilon\ny", "alpha beta gamma delta epsilon more", "single", "a single word",
             "alpha beta\ngamma delta\nzeta eta\ntheta iota\n\nnothing here", "delta gamma beta alpha", "", None, " ", "long " * 5000]
    got = scan_licenses(table(spark, list(enumerate(texts))), known, 0.8).collect()
    want = set()
    for i, text in enumerate(texts):
        lines = (text or "").split("\n")
        parts = [("line", k, p) for k, p in enumerate(lines)]
        parts += [("text", 0, text)] if len(lines) > 1 else []
        parts += [("paragraph", k, p) for k, p in enumerate(text.split("\n\n"))] if text and "\n\n" in text else []
        for kind, k, part in parts:
            for name, templates in known.items():
                value = max(dice(bigrams(part), bigrams(t)) for t in templates)
                if value >= 0.8:
                    want.add((i, name, kind, k, round(value, 9)))
    assert {(r.doc_id, r.license, r.unit, r.number, round(r.dice, 9)) for r in got} == want and len(got) == len(want) > 4
    assert scan_licenses(empty(spark)).count() == 0


def test_token_counts(spark):
    import tiktoken

    path = VOCABULARY.removeprefix("file://")
    with open(path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    plain = tiktoken.Encoding("plain", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "source", "lang")
    docs = docs.unionByName(spark.createDataFrame([(1000, None, None, "en"), (1001, "", "s", None)], docs.schema))
    counted = count_tokens(docs, VOCABULARY)
    texts = {r.doc_id: r.text for r in docs.collect()}
    assert {r.doc_id: r.tokens for r in counted.collect()} == {i: len(plain.encode_ordinary(t or "")) for i, t in texts.items()}
    long = "word  of\n many lengths, and 3 numbers; " * 9000
    assert "".join(_stretches(long)) == long
    assert sum(len(plain.encode_ordinary(s)) for s in _stretches(long)) == len(plain.encode_ordinary(long))


def test_query_of_token_counts_equals_a_recount(spark):
    ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in open(VOCABULARY.removeprefix("file://")))}
    plain = tiktoken.Encoding("plain", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    expected: dict = {}
    for r in spark.read.parquet(f"{SF}/documents.parquet").collect():
        counts = {"byte_bpe_50k": len(plain.encode_ordinary(r.text or "")), "words": len(re.findall(r"[^\x20\x09-\x0D]+", r.text or ""))}
        for tokenizer, n in counts.items():
            docs, tokens = expected.get((r.source, r.lang, tokenizer), (0, 0))
            expected[r.source, r.lang, tokenizer] = (docs + 1, tokens + n)
    got = {(r.source, r.lang, r.tokenizer): (r.documents, r.tokens) for r in op2_token_counts(spark, SF).collect()}
    assert got == expected


def test_rollup(spark, tmp_path):
    rows = [("a", "en", 10), ("a", "en", 5), (None, "de", 7), ("b", None, None)]
    docs = spark.createDataFrame(rows, "source string, lang string, tokens bigint")
    rollup = Rollup(spark, str(tmp_path))
    read = lambda: {(r.source, r.lang, r.tokenizer): (r.documents, r.tokens) for r in rollup.totals().collect()}
    assert read() == {}
    rollup.commit("b1", signed(docs, 1, "v1"))
    first = {("a", "en", "v1"): (2, 15), (None, "de", "v1"): (1, 7), ("b", None, "v1"): (1, 0)}
    assert read() == first
    rollup.commit("b1", signed(docs, 1, "v1"))
    assert read() == first
    rollup.commit("b2", revised(docs.where("tokens = 5"), docs.where("tokens = 5").withColumn("tokens", F.lit(9)), "v1"))
    rollup.commit("b3", signed(docs.where("source IS NULL"), -1, "v1"))
    after = {("a", "en", "v1"): (2, 19), ("b", None, "v1"): (1, 0)}
    assert read() == after
    rollup.compact("fold")
    assert read() == after
    rollup.commit("b1", signed(docs, 1, "v1"))
    assert read() == after
    rollup.commit("b4", signed(docs.limit(0), 1, "v1"))
    assert read() == after
    rollup.compact("fold")
    assert read() == after
    with pytest.raises(ValueError):
        rollup.commit("../x", signed(docs, 1, "v1"))
