"""Exact deduplication of texts in three steps, none of which gathers a group in one task.

Texts are grouped by (salt, digest, whole normalised text): Spark combines equal texts inside each map
task first, then merges what the tasks of one salt have left, and last the winners of all salts. The
text itself is a grouping key at every step, so a digest shared by different texts merges nothing.
Only then do narrow (digest, winner) rows go back to the documents.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilspark.llm.storage import written

SPACE = r"[\x20\x09-\x0D]+"


def normalised(text: Column) -> Column:
    """Every run of white space as one space; null as empty."""
    return F.regexp_replace(F.coalesce(text.cast("string"), F.lit("")), SPACE, " ")


def sha256(text: Column) -> Column:
    return F.sha2(text, 256)


def exact_groups(
    docs: DataFrame,
    text: str = "text",
    doc_id: str = "doc_id",
    salts: int = 16,
    digest: Callable[[Column], Column] = sha256,
) -> DataFrame:
    """One row per document: doc_id, keep_id (smallest id of the equal texts), group_size (rows), kept, digest.

    A null text equals an empty one. Rows that share id and text are one document: they return one row
    and each counts in group_size. Rows without id give way to any with one; where a group has none,
    keep_id is null and the row is kept. Other columns are not read. ``digest`` may be weak: documents
    of one digest and different texts are then told apart by their texts.
    """
    rows = docs.select(F.col(doc_id).alias("doc_id"), normalised(F.col(text)).alias("content")).select(
        "doc_id", "content", digest(F.col("content")).alias("digest")
    )
    salted = rows.groupBy(F.pmod(F.xxhash64("doc_id"), F.lit(salts)).alias("salt"), "digest", "content").agg(
        F.min("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("n")
    )
    whole = salted.groupBy("digest", "content").agg(F.min("keep_id").alias("keep_id"), F.sum("n").alias("group_size"))
    by_digest = written(
        whole.groupBy("digest").agg(
            F.count(F.lit(1)).alias("contents"),
            F.min("keep_id").alias("keep_id"),
            F.sum("group_size").alias("group_size"),
        ),
        "exact",
    )
    single, shared = by_digest.where("contents = 1"), by_digest.where("contents > 1")
    members = rows.select("doc_id", "digest").distinct()
    out = members.join(single.drop("contents"), "digest")
    if not shared.isEmpty():
        unsure = rows.join(shared.select("digest"), "digest", "left_semi").distinct()
        out = out.unionByName(
            unsure.join(whole.join(shared.select("digest"), "digest", "left_semi"), ["digest", "content"]).drop("content")
        )
    return out.select(
        "doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "digest"
    )


def drop_copies(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", salts: int = 16) -> DataFrame:
    """The documents that stay, one row each, with all their columns.

    Of rows that share id and normalised text the smallest text stays, and of equal ones the one that
    ``one_of_each`` names, so reruns agree. A null text equals an empty one; of a group without ids one
    row stays. An empty table stays empty; columns may have any names.
    """
    kept = exact_groups(docs, text, doc_id, salts).where("kept").select(
        F.col("doc_id").alias("_kept_id"), F.col("digest").alias("_kept_digest")
    )
    content = F.struct(docs[doc_id].alias("id"), sha256(normalised(docs[text])).alias("digest"))
    marked = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("whole"), content.alias("key"))
    same = F.col("key.id").eqNullSafe(F.col("_kept_id")) & (F.col("key.digest") == F.col("_kept_digest"))
    stay = marked.join(kept, same, "left_semi")
    others = F.to_json("whole")
    order = F.struct(F.col("whole")[text].alias("text"), F.sha2(others, 256).alias("rest"))
    return stay.groupBy("key").agg(F.min_by("whole", order).alias("whole")).select("whole.*")
