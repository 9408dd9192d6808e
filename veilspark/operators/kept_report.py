"""Redaction and token reports kept up to date batch by batch.

A batch adds one small folder of partial counts, and a report merges the folders without reading a text again.
Everything kept can be merged: counts and the histogram of the token saving add up exactly; the number of different
documents is an HLL sketch and the sizes of texts are a KLL sketch, both within the error that their sizes give.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from veilspark.functions.findings import findings
from veilspark.operators.report import cubed, token_quantiles, with_total
from veilspark.streaming.sinks import MERGE_EVERY, merge_folders, written_rows

#: 2^14 registers: a standard error of 0.8 % in the number of different documents.
HLL_BITS = 14
#: A rank error of about 0.65 % (for one quantile) in the sizes of texts.
KLL_SIZE = 400


class KeptReport:
    """Reports over the batches in a folder that all executors share.

    ``dims`` are the dimensions of the reports and ``keys`` what identifies a document. A batch added again
    replaces itself, and one that a merge covers no longer changes anything; a batch counts once its folder is
    complete. Null dimensions and keys are values of their own; a null text has no findings.
    """

    def __init__(self, spark: SparkSession, path: str, dims: list[str], keys: list[str], merge_every: int = MERGE_EVERY):
        self.spark, self.path, self.dims, self.keys, self.merge_every = spark, path, dims, keys, merge_every

    def partial(self, processed: DataFrame) -> DataFrame:
        """The partial counts of texts with ``sanitized_text`` and ``token_stats``: one pass, one shuffle of counts.

        Rows with a rule count findings; rows without one are the histogram of the token saving.
        """
        stats = F.col("token_stats")
        none = F.lit(None)

        def row(rule, n, pct, raw, saved):
            return F.struct(
                rule.cast("string").alias("rule"), n.cast("bigint").alias("n"), pct.cast("double").alias("pct"),
                raw.cast("bigint").alias("raw"), saved.cast("bigint").alias("saved"),
            )

        found = F.transform(with_total(findings(F.col("sanitized_text"))), lambda f: row(f["rule"], f["n"], none, none, none))
        saving = F.array(row(none, none, stats["reduction_percent"], stats["raw_tokens"], stats["saved_tokens"]))
        each = processed.select(
            *self.dims,
            F.xxhash64(*self.keys).alias("_document"),
            F.explode(F.concat(F.coalesce(found, F.filter(saving, lambda x: F.lit(False))), saving)).alias("_f"),
        ).select(*self.dims, "_document", "_f.*")
        return each.groupBy(*self.dims, "rule", "pct").agg(
            F.count(F.lit(1)).alias("n_docs"),
            F.sum("n").alias("n_findings"),
            F.sum("raw").alias("raw"),
            F.sum("saved").alias("saved"),
            F.hll_sketch_agg(F.when(F.col("rule").isNotNull(), F.col("_document")), HLL_BITS).alias("documents"),
            F.kll_sketch_agg_bigint("raw", KLL_SIZE).alias("sizes"),
        )

    def _merged(self, rows: DataFrame) -> DataFrame:
        return rows.groupBy(*self.dims, "rule", "pct").agg(
            *[F.sum(c).alias(c) for c in ("n_docs", "n_findings", "raw", "saved")],
            F.hll_union_agg("documents").alias("documents"),
            F.kll_merge_agg_bigint("sizes", KLL_SIZE).alias("sizes"),
        )

    def add(self, number: int, processed: DataFrame) -> None:
        """Make batch ``number`` count, once, however often it is added; merge folders from time to time."""
        self.partial(processed).write.mode("overwrite").parquet(f"{self.path}/batch={number}")
        if number % self.merge_every == self.merge_every - 1:
            self.merge(number)

    def merge(self, number: int) -> None:
        """Merge all batches up to ``number`` into one folder."""
        merge_folders(self.spark, self.path, number, self._merged)

    def follow(self, processed: DataFrame, checkpoint: str, every: str | None = None) -> StreamingQuery:
        """Add each micro-batch of a stream of processed texts."""
        writer = processed.writeStream.option("checkpointLocation", checkpoint)
        writer = writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)
        return writer.foreachBatch(lambda batch, number: self.add(number, batch)).start()

    def _rows(self) -> DataFrame:
        rows = written_rows(self.spark, self.path)
        if rows is None:
            raise ValueError(f"no batch in {self.path}")
        return self._merged(rows)

    def redaction(self) -> DataFrame:
        """``redaction_report`` of all batches, and ``distinct_docs``: documents told by their keys, an estimate."""
        distinct = F.hll_sketch_estimate(F.hll_union_agg("documents")).alias("distinct_docs")
        return cubed(self._rows().where("rule IS NOT NULL"), self.dims, distinct)

    def tokens(self, dim: str) -> DataFrame:
        """``token_report`` of all batches, and estimated quantiles of the raw tokens of a text."""
        histogram = self._rows().where("rule IS NULL").groupBy(dim, "pct").agg(
            F.sum("n_docs").alias("n"), F.sum("raw").alias("raw"), F.sum("saved").alias("saved"),
            F.kll_merge_agg_bigint("sizes", KLL_SIZE).alias("sizes"),
        )
        report = token_quantiles(histogram, dim, F.kll_merge_agg_bigint("sizes", KLL_SIZE).alias("_sizes"))
        sizes = [
            F.kll_sketch_get_quantile_bigint("_sizes", F.lit(p)).alias(name)
            for name, p in (("median_tokens", 0.5), ("p90_tokens", 0.9))
        ]
        return report.select(*[c for c in report.columns if c != "_sizes"], *sizes)
