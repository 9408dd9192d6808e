"""Reading and writing tables of texts."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from veilspark.functions.core import is_nonblank


def load_texts(
    spark: SparkSession,
    path: str,
    text: str = "text",
    id: str | None = None,
    fmt: str = "parquet",
    keep: tuple[str, ...] = (),
    schema: str | None = None,
    **options,
) -> DataFrame:
    """Texts as (id, text, *keep) from parquet, ORC, JSON, CSV or plain text files.

    For ``fmt='text'`` a row is a whole file and its id the file's path. Other formats need ``id``,
    as an id made up while reading would be another one in every run.
    """
    if fmt == "text":
        if keep or str(options.setdefault("wholetext", "true")).lower() != "true":
            raise ValueError("a text file is one row of id and text")
        df = spark.read.format("text").options(**options).load(path)
        return df.select(F.input_file_name().alias("id"), F.col("value").alias("text"))
    if id is None:
        raise ValueError("name the column that identifies a text")
    reader = spark.read.format(fmt).options(**options)
    df = (reader.schema(schema) if schema else reader).load(path)
    return df.select(F.col(id).alias("id"), F.col(text).alias("text"), *keep)


SPREAD_BYTES = 64 << 20


def spread_tasks(df: DataFrame) -> int | None:
    """Number of tasks to spread a small input over, or None if its files suffice.

    Cleaning is bound by the processor, and a file that is one parquet row group is one task.
    Inputs of more files than cores, or of more bytes than one split per core, are None.
    """
    context, files = df.sparkSession.sparkContext, df.inputFiles()
    cores = context.defaultParallelism
    if not files or len(files) >= cores:
        return None
    total = df.sparkSession.read.format("binaryFile").load(files).agg(F.sum("length")).first()[0]
    return cores if total is not None and total <= SPREAD_BYTES * cores else None


def spread(df: DataFrame) -> DataFrame:
    """Give every core work where a small input has fewer files than there are cores."""
    tasks = spread_tasks(df)
    return df.repartition(tasks) if tasks else df


def nonblank(df: DataFrame, text: str = "text") -> DataFrame:
    """Rows whose text has more than white space."""
    return df.where(is_nonblank(F.col(text)))


def write_texts(
    df: DataFrame,
    path: str,
    fmt: str = "parquet",
    partition_by: tuple[str, ...] = (),
    mode: str = "errorifexists",
    compact: bool = False,
) -> None:
    """Write a result table.

    ``compact`` rebalances rows by the partition columns first; AQE then splits a partition
    value that holds a large share of the rows over several tasks.
    """
    if compact and partition_by:
        df = df.hint("rebalance", *partition_by)
    df.write.format(fmt).mode(mode).partitionBy(*partition_by).save(path)


_local_dirs: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, as the session names it in ``spark.checkpoint.dir``.

    Only a local session may do without: it gets one new temporary folder.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    context = spark.sparkContext
    if not context.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors can reach")
    if context.applicationId not in _local_dirs:
        _local_dirs[context.applicationId] = tempfile.mkdtemp(prefix="veilspark-")
    return _local_dirs[context.applicationId]


def new_dir(spark: SparkSession, name: str) -> str:
    """A fresh path under the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
