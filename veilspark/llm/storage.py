"""Intermediate tables in the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``; a local session without one gets a temporary folder."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if root is None:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = tempfile.mkdtemp(prefix="veilspark-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


def new_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


def written(df: DataFrame, label: str) -> DataFrame:
    """The same rows, read from a Parquet table: evaluated once, without lineage."""
    path = new_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def one_of_each(df: DataFrame, keys: list[str]) -> DataFrame:
    """One row for each combination of ``keys`` (nulls are equal): that whose other columns, as JSON, have the
    smallest SHA-256. So reruns agree, whatever types the other columns have."""
    others = [F.col(f"`{c}`") for c in df.columns if c not in keys]
    order = F.sha2(F.to_json(F.struct(*others)), 256) if others else F.lit("")
    whole = F.struct(*(F.col(f"`{c}`") for c in df.columns))
    picked = df.groupBy(*(F.col(f"`{k}`").alias(f"_key{i}") for i, k in enumerate(keys))).agg(F.min_by(whole, order).alias("_row"))
    return picked.select("_row.*")
