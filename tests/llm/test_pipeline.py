"""The pipeline on small tables against plain versions of its stages, one after the other."""

from collections import Counter

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tests.llm.test_dedup import WORD, jaccard_components, leaks, normal, prose

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"
POOR = 3  # every third topic of a poor text


def poor_text(seed):
    return " ".join(f"{w}%%%" for w in prose(seed % POOR, 40))


@pytest.fixture
def folder(spark, tmp_path):
    item = prose(500, 40)
    good = {i: prose(i % 40 + 1000, 60) for i in range(80)}  # each text twice
    good |= {i: [*prose(i - 80 + 1000, 58), "other", f"end{i}"] for i in range(80, 90)}  # near copies
    good |= {90: prose(7, 20) + item + prose(8, 20), 91: prose(9, 10) + item[20:] + item[:20] + prose(8, 5), 92: item[:12] + prose(10, 50)}
    rows = [(i, " ".join(words), "en", "abc"[i % 3], 1) for i, words in good.items()]
    rows += [(i, poor_text(i), "en", "a", 1) for i in range(100, 130)] + [(200, None, "en", "a", 0), (201, "", None, None, 0), (202, " \n", "en", "b", 2)]
    rows += rows[:3] + [(3, "\t".join(good[3]), None, "z", 0)]
    labels = [(i, int(i < 100), 0) for i in [*range(0, 90, 2), *range(100, 130, 2)]]
    spark.createDataFrame(rows, SCHEMA).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    bench = spark.createDataFrame([(1, " ".join(item)), (2, None), (3, "")], "item_id bigint, text string")
    bench.write.parquet(str(tmp_path / "benchmark.parquet"))
    return str(tmp_path), rows, [(1, " ".join(item))]


def test_run_matches_plain_stages(spark, folder):
    path, rows, items = folder
    left = [r for r in rows if (r[1] or "").strip() and "%%%" not in r[1]]
    first = {}
    for r in sorted(left, key=lambda r: (r[0], r[1])):
        first.setdefault(normal(r[1]), r)
    left = list(first.values())
    component = jaccard_components([(r[0], r[1]) for r in left])
    left = [r for r in left if component[r[0]][1] == r[0]]
    bad = {doc for doc, _ in leaks([(r[0], r[1]) for r in left], items)}
    left = [r for r in left if r[0] not in bad]
    assert bad == {90, 91} and 30 < len(left) < 45
    got = corpus_pipeline.run(spark, path)
    assert got.columns == ["doc_id", "source", "size", "source_size", "target", "taken"]
    size = {r[0]: len(WORD.findall(r[1])) for r in left}
    of_source = Counter()
    for r in left:
        of_source[r[3]] += size[r[0]]
    found = got.collect()
    assert sorted((r.doc_id, r.source, r.size, r.source_size) for r in found) == sorted((r[0], r[3], size[r[0]], of_source[r[3]]) for r in left)
    assert all(0 <= r.taken <= 3 * r.size for r in found)
    taken = Counter()
    for r in found:
        taken[r.source] += r.taken
    target = {r.source: r.target for r in found}
    assert sum(target.values()) == pytest.approx(sum(size.values()))
    assert all(abs(taken[s] - target[s]) <= 0.05 * target[s] + 5 for s in target)


def test_stages_keep_the_columns_and_empty_tables(spark, folder):
    path, rows, _ = folder
    docs = spark.read.parquet(f"{path}/documents.parquet").withColumn("_kept_row", F.lit("x"))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, path).columns == docs.columns, name
        assert stage(spark, docs.where("false"), path).count() == 0, name
    assert corpus_pipeline.STAGES[-1][1](spark, docs.where("false"), path).count() == 0
