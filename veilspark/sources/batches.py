"""A table of batches in which writing a batch again replaces it.

``path/batch=B/attempt=K`` holds the K-th attempt at batch B. An attempt counts from the moment Spark marks it
complete, and the newest complete one is the batch: so a repeated write does not double rows, one that dies halfway
leaves the batch as it was, and other batches are never touched. The attempt before stays for those who still read it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilspark.streaming.sinks import folder_numbers, remove_folder

_PLACE = ("batch", "attempt")


def _batch(path: str, batch: int) -> str:
    return f"{path.rstrip('/')}/batch={batch}"


def write_batch(df: DataFrame, path: str, batch: int, partition_by: tuple[str, ...] = (), compact: bool = False) -> None:
    """Write a batch, or write it again. A batch has one writer at a time, different batches may have several.

    All batches of a table are partitioned alike. ``compact`` rebalances rows by the partition columns first. An empty table is an empty batch.
    """
    taken = [c for c in df.columns if c.lower() in _PLACE]
    if taken:
        raise ValueError(f"the folders of a batch need the column names {taken}")
    spark, folder = df.sparkSession, _batch(path, batch)
    attempts = folder_numbers(spark, folder, "attempt")
    number = attempts[-1] + 1 if attempts else 0
    before = folder_numbers(spark, folder, "attempt", complete=True)
    if compact and partition_by:
        df = df.hint("rebalance", *partition_by)
    df.write.mode("errorifexists").partitionBy(*partition_by).parquet(f"{folder}/attempt={number}")
    for old in attempts:
        if not before or old != before[-1]:
            remove_folder(spark, f"{folder}/attempt={old}")


def read_batches(spark: SparkSession, path: str, schema: str, batches: list[int] | None = None) -> DataFrame:
    """The rows of all batches, or of some, with the number of each in ``batch``.

    ``schema`` is that of the rows, partition columns included, so an empty batch or none needs no guess.
    """
    path = path.rstrip("/")
    numbers = folder_numbers(spark, path, "batch")
    newest = {
        n: folder_numbers(spark, _batch(path, n), "attempt", complete=True)
        for n in numbers if batches is None or n in batches
    }
    places = [f"{_batch(path, n)}/attempt={attempts[-1]}" for n, attempts in newest.items() if attempts]
    whole = f"{schema}, batch bigint, attempt bigint"
    if not places:
        return spark.createDataFrame([], whole).drop("attempt")
    return spark.read.schema(whole).option("basePath", path).parquet(*places).drop("attempt")


def counted_batches(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """(batch, n_rows) of the batches that hold rows."""
    return read_batches(spark, path, schema).groupBy("batch").agg(F.count(F.lit(1)).alias("n_rows"))
