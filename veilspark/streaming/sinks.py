"""Folders that a stream writes micro-batch by micro-batch, merged from time to time so that few remain.

``out/batch=N`` holds the rows of micro-batch N; a replay overwrites it. Every so many batches the newest
row of each key goes to ``out/_merged/upto=N``, which counts only once Spark has marked it complete. Batches
that the merge before covers are then removed, so a reader that has just begun still finds its folders.
Dying at any point leaves either the old state or the new one, and a replay gives the same rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

#: Micro-batches between two merges.
MERGE_EVERY = 20

_MERGED = "_merged"


def _folder(spark: SparkSession, path: str):
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()), place


def folder_numbers(spark: SparkSession, path: str, name: str, complete: bool = False) -> list[int]:
    """The numbers N of the folders ``name=N`` below a path, in order; on request only complete ones."""
    files, place = _folder(spark, path)
    if not files.exists(place):
        return []
    names = [status.getPath().getName() for status in files.listStatus(place) if status.isDirectory()]
    found = sorted(int(n.split("=")[1]) for n in names if n.startswith(f"{name}="))
    return [n for n in found if not complete or files.exists(_folder(spark, f"{path}/{name}={n}/_SUCCESS")[1])]


def remove_folder(spark: SparkSession, path: str) -> None:
    files, place = _folder(spark, path)
    files.delete(place, True)


def written_rows(spark: SparkSession, out: str, upto: int | None = None) -> DataFrame | None:
    """The rows of the newest complete merge and of the batches after it (``batch`` tells them apart)."""
    merged = [n for n in folder_numbers(spark, f"{out}/{_MERGED}", "upto", complete=True) if upto is None or n <= upto]
    after = merged[-1] if merged else -1
    batches = [n for n in folder_numbers(spark, out, "batch", complete=True) if n > after and (upto is None or n <= upto)]
    parts = [spark.read.parquet(f"{out}/{_MERGED}/upto={after}")] if merged else []
    if batches:
        fresh = spark.read.option("basePath", out).parquet(*(f"{out}/batch={n}" for n in batches))
        parts.append(fresh.withColumn("batch", F.col("batch").cast("long")))
    if not parts:
        return None
    return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1], allowMissingColumns=True)


def newest(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The last row of each key along ``order``, of equal ones that of the later batch."""
    values = [c for c in rows.columns if c not in keys]
    last = F.max_by(F.struct(*values), F.struct(*order, "batch")).alias("_v")
    return rows.groupBy(*keys).agg(last).select(*keys, "_v.*")


def merge_folders(spark: SparkSession, out: str, number: int, combine: Callable[[DataFrame], DataFrame]) -> None:
    """Merge all up to batch ``number`` by ``combine``, then remove what the merge before this one covers."""
    before = folder_numbers(spark, f"{out}/{_MERGED}", "upto", complete=True)
    if number not in before:
        rows = written_rows(spark, out, number)
        if rows is None:
            return
        combine(rows).write.mode("overwrite").parquet(f"{out}/{_MERGED}/upto={number}")
    older = [n for n in before if n < number]
    if older:
        for n in folder_numbers(spark, out, "batch"):
            if n <= older[-1]:
                remove_folder(spark, f"{out}/batch={n}")
        for n in folder_numbers(spark, f"{out}/{_MERGED}", "upto"):
            if n < older[-1]:
                remove_folder(spark, f"{out}/{_MERGED}/upto={n}")


def saved(
    batch: DataFrame, number: int, out: str, keys: list[str] | None, order: list[str], merge_every: int
) -> None:
    """Write one micro-batch to its folder, and merge if it is time."""
    spark = batch.sparkSession
    batch.write.mode("overwrite").parquet(f"{out}/batch={number}")
    if keys and number % merge_every == merge_every - 1:
        merge_folders(spark, out, number, lambda rows: newest(rows, keys, order))


def batch_sink(
    stream: DataFrame,
    out: str,
    checkpoint: str,
    every: str | None = None,
    keys: list[str] | None = None,
    order: list[str] | None = None,
    prepare: Callable[[DataFrame], DataFrame] | None = None,
    merge_every: int = MERGE_EVERY,
    mode: str = "update",
) -> StreamingQuery:
    """Write each micro-batch, after ``prepare``, to a folder of its own; with ``keys``, keep few folders.

    Without ``order`` the row of the later batch is the newer one.
    """

    def save(batch: DataFrame, number: int) -> None:
        saved(prepare(batch) if prepare else batch, number, out, keys, order or [], merge_every)

    writer = stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint)
    writer = writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)
    return writer.foreachBatch(save).start()


def read_updates(spark: SparkSession, out: str, keys: list[str], order: list[str] | None = None) -> DataFrame:
    """Current state of a sink: the newest row of each key. An empty folder is an error."""
    rows = written_rows(spark, out)
    if rows is None:
        raise ValueError(f"no micro-batch in {out}")
    return newest(rows, keys, order or []).drop("batch")
