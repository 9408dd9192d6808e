"""Reports kept by batches against reports over the whole table."""

import pytest
from pyspark.sql import functions as F

from tests.conftest import SF
from veilspark.operators.kept_report import KeptReport
from veilspark.operators.report import redaction_report, token_report
from veilspark.operators.sanitize import process_table
from veilspark.plans.corpus import corpus


@pytest.fixture(scope="module")
def processed(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("processed"))
    odd = spark.createDataFrame(
        [("x", None, 0, None, "en", None), ("x", None, 1, None, None, ""), ("x", 3, 0, "s", None, "mail a@b.example")],
        "corpus string, id bigint, part bigint, source string, lang string, text string",
    )
    rows = corpus(spark, SF).where("corpus <> 'logs' OR id % 5 = 0").unionByName(odd)
    process_table(rows, ["corpus", "id", "part"], diff=False).write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def rows_of(df):
    return sorted(map(str, df.collect()))


def test_batches_merge_to_the_whole(spark, processed, tmp_path):
    kept = KeptReport(spark, str(tmp_path), ["source", "lang"], ["corpus", "id", "part"], merge_every=2)
    with pytest.raises(ValueError):
        kept.redaction()
    parts = [processed.where(F.pmod(F.xxhash64("id", "part"), F.lit(4)) == i) for i in range(4)]
    for number, part in enumerate([*parts, processed.limit(0)]):
        kept.add(number, part)
        kept.add(number, part)
    kept.add(0, parts[0])  # a merge covers it
    redaction, tokens = kept.redaction().cache(), kept.tokens("source").cache()
    assert rows_of(redaction.drop("distinct_docs")) == rows_of(redaction_report(processed, ["source", "lang"]))
    assert rows_of(tokens.drop("median_tokens", "p90_tokens")) == rows_of(token_report(processed, "source"))
    assert all(abs(r.distinct_docs / r.n_docs - 1) <= 0.05 for r in redaction.collect())
    folders = [p.name for p in tmp_path.iterdir() if p.name.startswith("batch=")]
    assert "batch=1" not in folders or len(folders) <= 5


def test_copies_count_once_among_different_documents(spark, processed, tmp_path):
    kept = KeptReport(spark, str(tmp_path), ["lang"], ["corpus", "id", "part"])
    for number in range(3):
        kept.add(number, processed)
    for r in kept.redaction().collect():
        assert abs(r.distinct_docs * 3 / r.n_docs - 1) <= 0.05


def test_sizes_within_the_rank_error(spark, processed, tmp_path):
    kept = KeptReport(spark, str(tmp_path), ["source", "lang"], ["corpus", "id", "part"])
    for i in range(3):
        kept.add(i, processed.where(F.pmod(F.xxhash64("id"), F.lit(3)) == i))
    whole = sorted(r[0] for r in processed.select("token_stats.raw_tokens").collect() if r[0] is not None)
    total = next(r for r in kept.tokens("source").collect() if r.source_total)
    for p, got in ((0.5, total.median_tokens), (0.9, total.p90_tokens)):
        low, high = (whole[min(len(whole) - 1, max(0, int((p + e) * len(whole))))] for e in (-0.03, 0.03))
        assert low <= got <= high


def test_stream_and_one_shuffle_of_counts(spark, processed, tmp_path):
    folder = str(tmp_path / "in")
    processed.repartition(6).write.parquet(folder)
    stream = spark.readStream.schema(processed.schema).option("maxFilesPerTrigger", 2).parquet(folder)
    kept = KeptReport(spark, str(tmp_path / "out"), ["source", "lang"], ["corpus", "id", "part"], merge_every=2)
    kept.follow(stream, str(tmp_path / "checkpoint")).awaitTermination()
    assert rows_of(kept.redaction().drop("distinct_docs")) == rows_of(redaction_report(processed, ["source", "lang"]))
    plan = kept.partial(processed)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "Python" not in plan
