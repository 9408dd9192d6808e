"""Batches written again, dying writers, and sessions of a stream against plain ones."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from veilspark.plans import queries as Q
from veilspark.sources.batches import counted_batches, read_batches, write_batch
from veilspark.streaming.sessions import late_rows, session_stream

SCHEMA = "id bigint, text string, lang string"


def rows_of(df):
    return sorted(map(str, df.collect()))


def test_batches_replace_themselves(spark, tmp_path):
    path = str(tmp_path)
    df = spark.createDataFrame([(i, None if i % 7 == 0 else f"t{i}", [None, "en", "de"][i % 3]) for i in range(60)], SCHEMA)
    assert read_batches(spark, path, SCHEMA).count() == 0
    first, second = df.where("id < 40"), df.where("id >= 40")
    write_batch(first, path, 0, partition_by=("lang",))
    write_batch(second, path, 1, partition_by=("lang",), compact=True)
    for _ in range(3):
        write_batch(first, path, 0, partition_by=("lang",))
    assert rows_of(read_batches(spark, path, SCHEMA).drop("batch")) == rows_of(df)
    assert {(r.batch, r.n_rows) for r in counted_batches(spark, path, SCHEMA).collect()} == {(0, 40), (1, 20)}
    assert len([p for p in (tmp_path / "batch=0").iterdir()]) == 2
    assert rows_of(read_batches(spark, path, SCHEMA, [1]).drop("batch")) == rows_of(second)
    # A writer that dies leaves the batch as it was, and the next one takes over.
    dying = df.withColumn("text", F.when(F.col("id") == 55, F.raise_error(F.lit("lost"))).otherwise(F.col("text")))
    with pytest.raises(Exception, match="lost"):
        write_batch(dying.repartition(8), path, 0)
    assert rows_of(read_batches(spark, path, SCHEMA).drop("batch")) == rows_of(df)
    # Attempts without Spark's mark do not count, whatever files they hold.
    left = tmp_path / "batch=1" / "attempt=7"
    first.write.parquet(str(left))
    (left / "_SUCCESS").unlink()
    assert rows_of(read_batches(spark, path, SCHEMA).drop("batch")) == rows_of(df)
    write_batch(df.limit(0), path, 1, partition_by=("lang",))
    assert rows_of(read_batches(spark, path, SCHEMA).drop("batch")) == rows_of(first)
    with pytest.raises(ValueError):
        write_batch(df.withColumn("Attempt", F.lit(1)), path, 2)


def at(minute):
    return dt.datetime(2031, 5, 9) + dt.timedelta(minutes=minute)


def test_sessions_replayed_and_late_rows(spark, tmp_path):
    steps = [
        [(1, "a", 0, "x@y.example"), (2, "a", 9, "none"), (3, None, 5, "x@y.example"), (4, "a", 30, None)],
        [(2, "a", 9, "none"), (5, "a", 12, "x@y.example 12:34:56"), (6, "b", 45, "x")],  # 2 again; 5 joins the first session
        [(7, "b", 200, "end")],
        [(8, "a", 20, "too late"), (9, "b", 201, "x@y.example"), (9, "b", 201, "x@y.example")],
        [(10, "b", 400, "end")],
    ]
    folder, out = tmp_path / "in", str(tmp_path / "out")
    schema, late = "event_id bigint, source string, ts timestamp, text string", 0
    for number, step in enumerate(steps):
        rows = [(i, s, at(m), t) for i, s, m, t in step]
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(folder))
        stream = spark.readStream.schema(schema).parquet(str(folder))
        job = session_stream(stream, out, str(tmp_path / "checkpoint"), ["event_id"], gap="10 minutes", delay="1 hour")
        job.awaitTermination()
        late += late_rows(job)
    got = {(r.source, r.session_start, r.n_texts, r.n_findings) for r in spark.read.parquet(out).collect()}
    assert got == {("a", at(0), 3, 3), (None, at(5), 1, 1), ("a", at(30), 1, 0), ("b", at(45), 1, 0), ("b", at(200), 2, 1)}
    assert late == 1


def test_sink_batches_cleans_each_text_once(spark, monkeypatch):
    cleaned = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def clean(text):
        cleaned.add(1)
        return text and text.upper()

    rows = [(c, i, 0, [None, "en"][i % 2], [None, "a"][i % 3 > 0]) for c in ("documents", "logs") for i in (*range(20), 5)]
    df = spark.createDataFrame(rows, "corpus string, id bigint, part bigint, lang string, text string")
    monkeypatch.setattr(Q, "_sanitized", lambda spark, sf: df.withColumn("sanitized_text", clean("text")))
    got = [str(tuple(row)) for row in Q.sink_batches(spark, "").collect()]
    assert sorted(got) == sorted(str((c, i, p, lang, text and text.upper())) for c, i, p, lang, text in rows)
    assert cleaned.value == len(rows)
