"""The convolutional classifier: its arithmetic against plain loops, its accuracy on held-out rows."""

import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from veilspark.llm import toxicity as module
from veilspark.llm.toxicity import BEGINNINGS, DIM, FILTERS, WIDTHS, Net, _threshold, encode, toxicity, train

SCHEMA = "doc_id bigint, text string, lang string"


def test_encode_hashes_words_and_their_beginnings():
    cells, first = encode(pa.array(["abcd abce abcd", "", "...", "x,y abcdefgh abcdefghi", "ab"]))
    assert first.tolist() == [0, 3, 3, 3, 7, 8]
    assert (cells[0] == cells[2]).all() and cells[0, 0] != cells[1, 0]
    assert cells[0, 1] == cells[1, 1] != 0 and cells[0, 2] != cells[1, 2]  # three bytes shared, four not
    assert (cells[7, 1:] == 0).all() and cells[7, 0] != 0
    assert (cells[5, 1:] == cells[6, 1:]).all() and BEGINNINGS[-1] == 8
    again, _ = encode(pa.array(["abcdefghi"]))
    assert (again[0] == cells[6]).all()


def plain_logit(net, cells):
    """One text through the net, a window at a time."""
    rows = [net.words[c].sum(0) for c in cells] + [np.zeros(DIM, np.float32)] * max(WIDTHS)
    features = []
    for w, kernel, bias in zip(WIDTHS, net.filters, net.bias, strict=True):
        best = np.zeros(FILTERS)
        for i in range(len(cells)):
            best = np.maximum(best, sum(rows[i + j] @ kernel[j] for j in range(w)) + bias)
        features.append(best)
    return float(np.concatenate(features) @ net.out + net.out_bias[0])


@pytest.mark.parametrize("run", [100_000, 7, 1])
def test_net_matches_plain_loops(monkeypatch, run):
    monkeypatch.setattr(module, "RUN", run)
    rng = random.Random(4)
    texts = [" ".join(rng.choice(["ab", "abcde", "x1", "longwordlong"]) for _ in range(rng.choice([0, 1, 2, 5, 40]))) for _ in range(30)]
    net = Net.fresh(3)
    net.words[1:] *= 5
    cells, first = encode(pa.array(texts))
    got = net.logits(cells, first)
    want = [plain_logit(net, cells[a:b]) for a, b in zip(first[:-1], first[1:], strict=True)]
    assert got == pytest.approx(want, abs=1e-4)


def test_step_follows_the_gradient():
    """The step's direction agrees in sign with differences of the loss."""
    texts = pa.array(["good day to you", "you bad thing", "bad", "", "a good day"])
    target, weight = np.array([0, 1, 1, 0, 0], np.float32), np.ones(5)
    cells, first = encode(texts)

    def loss(net):
        z = net.logits(cells, first)
        return float(np.mean(np.logaddexp(0, z) - target * z))

    net = Net.fresh(9)
    base, word = Net.fresh(9), cells[4, 0]
    checks = [("out", (3,)), ("out_bias", (0,)), ("words", (word, 2))]
    grads = []
    for name, at in checks:
        getattr(base, name)[at] += 1e-2
        up = loss(base)
        getattr(base, name)[at] -= 2e-2
        grads.append((up - loss(base)) / 2e-2)
        getattr(base, name)[at] += 1e-2
    before = loss(net)
    net.step(cells, first, target, weight, 1e-3)
    for (name, at), g in zip(checks, grads, strict=True):
        moved = getattr(net, name)[at] - getattr(base, name)[at]
        assert abs(g) < 1e-4 or np.sign(moved) == -np.sign(g)
    for _ in range(60):
        net.step(cells, first, target, weight, 1e-2)
    assert loss(net) < before / 4


def test_threshold_lies_in_the_best_gap():
    assert _threshold(np.array([0.0, 1.0, 5.0, 6.0]), np.array([False, False, True, True])) == 3.0
    assert _threshold(np.array([6.0, 5.0, 1.0, 0.0]), np.array([True, False, False, True])) > 5.0  # a false hit costs more
    assert _threshold(np.array([2.0, 2.0, 2.0]), np.array([True, False, False])) > 2.0


def corpus(n=900, seed=2):
    rng = random.Random(seed)
    calm = {"aa": [f"w{i}la" for i in range(60)], "bb": [f"{i}zu" for i in range(60)]}
    stems = {"aa": ["scumo", "trashi"], "bb": ["wekol"]}
    rows, labels = [], []
    for i in range(n):
        lang, bad = rng.choice(["aa", "bb"]), rng.random() < 0.25
        words = [rng.choice(calm[lang]) for _ in range(rng.randrange(3, 60))]
        if bad:
            for _ in range(3):  # endings are drawn, so that held-out words were not seen as such
                words.insert(rng.randrange(len(words)), rng.choice(stems[lang]) + "".join(rng.choice("abcdefg") for _ in range(4)))
        rows.append((i, " ".join(words), lang))
        labels.append((i, int(bad)))
    return rows, labels


def test_held_out_accuracy_and_columns(spark):
    rows, labels = corpus()
    docs = spark.createDataFrame(rows, SCHEMA).withColumn("score", F.lit("x")).withColumn("toxic", F.lit(1)).withColumn("row", F.lit(0))
    known = spark.createDataFrame(labels, "doc_id bigint, toxic int").withColumn("text", F.lit("x")).withColumn("lang", F.lit("y"))
    out = toxicity(docs, known, F.col("doc_id") % 5 == 0)
    assert out.columns == ["doc_id", "held_out", "score", "predicted"]
    got = {r.doc_id: r for r in out.collect()}
    label = dict(labels)
    held = [r for r in got.values() if r.held_out]
    assert len(held) == 180 and len(got) == 900
    assert sum(r.predicted == label[r.doc_id] for r in held) >= 0.95 * len(held)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got.values())


def test_inputs_of_a_score(spark):
    """Held-out labels, languages, ids and other columns change nothing; text alone decides."""
    rows, labels = corpus(400)
    held = F.col("doc_id") % 5 == 0
    first = toxicity(spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(labels, "doc_id bigint, toxic int"), held)
    turned = [(i, 1 - t if i % 5 == 0 else t) for i, t in labels]
    others = [(i, t, lang if i % 5 else "zz") for i, t, lang in rows]
    second = toxicity(spark.createDataFrame(others, SCHEMA).repartition(3), spark.createDataFrame(turned, "doc_id bigint, toxic int"), held)
    a, b = ({r.doc_id: r.score for r in df.collect()} for df in (first, second))
    assert a.keys() == b.keys() and all(abs(a[k] - b[k]) < 1e-4 for k in a)


def test_odd_rows_and_tables(spark):
    rows, labels = corpus(200)
    odd = [(1000, None, None), (1001, "", "aa"), (1002, " \n.,!", None), (None, "scumoabcd", "aa"), (7, rows[7][1], rows[7][2]), (1003, "w1la " * 150_000 + "scumoaaaa", "aa")]
    marks = labels + [(7, 1), (None, 1), (1003, None), (1002, 5), (9999, 1)]
    docs, known = spark.createDataFrame(rows + odd, SCHEMA), spark.createDataFrame(marks, "doc_id bigint, toxic int")
    got = toxicity(docs, known, F.col("doc_id") % 5 == 0).collect()
    assert len(got) == len(rows) + len(odd) and all(r.score is not None and 0 <= r.score <= 1 for r in got)
    empty = {r.score for r in got if r.doc_id in (1000, 1001, 1002)}
    assert len(empty) == 1
    assert [r.held_out for r in got if r.doc_id is None] == [False]
    none = spark.createDataFrame([], "doc_id bigint, toxic int")
    assert {(r.score, r.predicted) for r in toxicity(docs, none, F.lit(False)).collect()} == {(0.0, 0)}
    one = spark.createDataFrame([(i, 1) for i in range(50)], "doc_id bigint, toxic int")
    assert {(r.score, r.predicted) for r in toxicity(docs, one, F.lit(False)).collect()} == {(0.0, 0)}
    assert toxicity(spark.createDataFrame([], SCHEMA), known, F.lit(False)).collect() == []
    names = docs.select(F.concat(F.lit("k"), "doc_id").alias("key"), F.col("text").alias("body"), "lang")
    marked = known.select(F.concat(F.lit("k"), "doc_id").alias("key"), F.col("toxic").alias("bad"))
    assert toxicity(names, marked, F.lit(False), text="body", doc_id="key", label="bad", labelled={1: 9, 0: 9}, learn_bytes=9000).count() == len(got)


def test_train_is_repeatable():
    rows, labels = corpus(120)
    texts, toxic, langs = pa.array([r[1] for r in rows]), np.array([t for _, t in labels]), [r[2] for r in rows]
    a, b = train(texts, toxic, langs), train(texts, toxic, langs)
    assert np.allclose(a.scores(texts), b.scores(texts))


def test_all_labelled_rows_are_learned_from(spark, monkeypatch):
    """Every labelled row is in one shard, and what only a few rows show is learned however many others there are."""
    rows, labels = corpus(1200)
    docs, known = spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(labels, "doc_id bigint, toxic int")
    monkeypatch.setattr(module, "SHARD_ROWS", 300)
    table = module.labelled_rows(docs.unionByName(docs), known).collect()
    assert sorted(r.text for r in table) == sorted(t for _, t, _ in rows) and len({r.shard for r in table}) == 8
    out = toxicity(docs, known, F.col("doc_id") % 5 == 0).where("held_out").collect()
    label = dict(labels)
    assert sum(r.predicted == label[r.doc_id] for r in out) >= 0.95 * len(out)


def test_shards_of_batches():
    shard = [3] * 4 + [1] * 5 + [2]
    whole = pa.record_batch([pa.array(shard), pa.array(range(10))], ["shard", "row"])
    for width in (1, 2, 3, 10):
        parts = [t.column("row").to_pylist() for t in module._shards(whole.slice(i, width) for i in range(0, 10, width))]
        assert parts == [[0, 1, 2, 3], [4, 5, 6, 7, 8], [9]]


def test_threshold_of_counted_rows():
    logits, toxic, n = np.array([0.0, 1.0, 2.0, 3.0]), np.array([0, 1, 0, 1]), np.array([5, 1, 2, 4])
    assert _threshold(logits, toxic, n) == _threshold(np.repeat(logits, n), np.repeat(toxic, n))
