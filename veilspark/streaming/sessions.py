"""Findings by session: stretches of a source's texts that no long silence divides."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from veilspark.functions.findings import findings
from veilspark.functions.sanitize import sanitize_text_column


def session_stream(
    stream: DataFrame,
    out: str,
    checkpoint: str,
    keys: list[str],
    time: str = "ts",
    source: str = "source",
    gap: str = "30 minutes",
    delay: str = "1 hour",
    every: str | None = None,
) -> StreamingQuery:
    """Texts and findings per session of each source, written once when the watermark passes the session's end.

    An event that is delivered again within ``delay`` counts once (``keys`` identify it). Rows later than the
    watermark are dropped and counted (``late_rows``). State holds open sessions and the keys of the last ``delay``.
    A null source is a source; a text of null has no findings.
    """
    fresh = stream.withWatermark(time, delay).dropDuplicatesWithinWatermark(keys)
    counted = fresh.select(
        time, source,
        F.aggregate(findings(sanitize_text_column("text")), F.lit(0).cast("bigint"), lambda acc, f: acc + f["n"]).alias("n"),
    )
    sessions = (
        counted.groupBy(F.session_window(time, gap).alias("w"), source)
        .agg(F.count(F.lit(1)).alias("n_texts"), F.sum(F.coalesce("n", F.lit(0))).alias("n_findings"))
        .select(F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), source, "n_texts", "n_findings")
    )
    writer = sessions.writeStream.outputMode("append").format("parquet").option("path", out)
    writer = writer.option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()


def late_rows(query: StreamingQuery) -> int:
    """Rows that came behind the watermark, of the micro-batches that the query still reports."""
    return sum(
        operator["numRowsDroppedByWatermark"] for progress in query.recentProgress for operator in progress["stateOperators"]
    )
