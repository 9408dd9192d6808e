"""Structured Streaming jobs over arriving texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from veilspark.functions.findings import findings
from veilspark.functions.sanitize import sanitize_text_column
from veilspark.operators.runs import find_runs
from veilspark.operators.sanitize import sanitize_table
from veilspark.streaming.sinks import batch_sink


def _trigger(writer, every: str | None):
    return writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)


def sanitize_stream(stream: DataFrame, out: str, checkpoint: str, every: str | None = None) -> StreamingQuery:
    """Stateless cleaning into a parquet sink; exactly once by way of the checkpoint."""
    clean = sanitize_table(stream).drop("text")
    writer = clean.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint)
    return _trigger(writer.outputMode("append"), every).start()


def marker_count_stream(
    stream: DataFrame,
    out: str,
    checkpoint: str,
    time: str = "ts",
    source: str = "source",
    window: str = "1 hour",
    slide: str | None = None,
    delay: str = "10 minutes",
    every: str | None = None,
) -> StreamingQuery:
    """Findings per event-time window, source and rule; late rows count within ``delay``."""
    found = stream.withWatermark(time, delay).select(
        time, source, F.explode(findings(sanitize_text_column("text"))).alias("f")
    )
    span = F.window(time, window, slide) if slide else F.window(time, window)
    counts = (
        found.groupBy(span.alias("w"), source, F.col("f.rule").alias("rule"))
        .agg(F.sum("f.n").alias("n"))
        .select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), source, "rule", "n")
    )
    return batch_sink(counts, out, checkpoint, every, keys=["window_start", "window_end", source, "rule"])


def latest_stream(
    stream: DataFrame, out: str, checkpoint: str, order: list[str], source: str = "source", every: str | None = None
) -> StreamingQuery:
    """Latest sanitized text per source along ``order``, whenever its row arrives.

    The stream keeps no state: a micro-batch yields its newest row of each source, cleaned, and the sink keeps
    the newest of those (read with ``read_updates(spark, out, [source], order)``).
    """

    def prepare(batch: DataFrame) -> DataFrame:
        latest = batch.groupBy(source).agg(F.max(F.struct(*order, "text")).alias("v")).select(source, "v.*")
        return sanitize_table(latest).drop("text")

    return batch_sink(stream, out, checkpoint, every, keys=[source], order=order, prepare=prepare, mode="append")


def collapse_stream(
    stream: DataFrame,
    out: str,
    checkpoint: str,
    keys: list[str],
    order: list[str],
    line: str,
    slice_by: Column,
    every: str | None = None,
) -> StreamingQuery:
    """Collapse repeats per source across micro-batches.

    A micro-batch joins its rows with the runs left open by the one before, both spread over
    slices, and writes closed and open runs to a folder of its own.  A replayed batch reads
    the same open runs and overwrites the same folder, so the result is exactly once.  Rows
    are ordered within a batch; a late row counts after the batches already done.
    """
    spark = stream.sparkSession

    def save(batch: DataFrame, number: int) -> None:
        fresh = batch.select(
            *keys,
            F.lit(1).alias("_age"),
            *order,
            F.col(line).alias("line"),
            F.lit(1).cast("long").alias("n"),
            slice_by.alias("_cut"),
            F.struct(*order).alias("_first"),
        )
        rows = fresh
        if number > 0:
            left_open = spark.read.parquet(f"{out}/batch={number - 1}").where("is_last")
            rows = fresh.unionByName(
                left_open.select(
                    *keys, F.lit(0).alias("_age"), "last.*", "line", "n", F.col("first").alias("_first")
                ).withColumn("_cut", F.lit(None).cast(fresh.schema["_cut"].dataType))
            )
        # Carried runs sort before all fresh rows, in a slice of their own; a carried run keeps
        # the start that it was first seen with.
        runs = find_runs(
            rows, keys, ["_age", *order, "_first"], "line", F.struct("_age", "_cut"), weight="n"
        )
        runs.select(
            *keys, "line", "n", F.col("first._first").alias("first"),
            F.struct(*[F.col(f"last.{o}").alias(o) for o in order]).alias("last"), "is_last",
        ).write.mode("overwrite").parquet(f"{out}/batch={number}")

    writer = stream.writeStream.option("checkpointLocation", checkpoint)
    return _trigger(writer.foreachBatch(save), every).start()


def read_collapsed(spark: SparkSession, out: str) -> DataFrame:
    """Closed runs of all micro-batches and the runs still open after the last one."""
    runs = spark.read.parquet(out)
    newest = runs.agg(F.max("batch")).first()[0]
    return runs.where(~F.col("is_last") | (F.col("batch") == newest)).drop("batch", "is_last")
