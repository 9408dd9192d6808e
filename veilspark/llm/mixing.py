"""Mixing sources to target weights: Sainte-Lague apportionment of equal-token blocks.

Sizes are counted in words. A source's documents are laid end to end in a seeded order, within shards
of about ``shard_blocks`` blocks, and cut into blocks of equal numbers of words. Blocks are allotted to
sources, and a source's blocks to its shards, by highest quotients; a shard then takes every block as
often as its quota holds all of them, and the rest by a seeded choice. Only DataFrame functions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veilspark.llm.storage import written

WORD = r"[^\x20\x09-\x0D]+"
#: A table of sources with at most so many rows is broadcast.
FEW_SOURCES = 100_000


def sainte_lague(parties: DataFrame, groups: list[str], votes: str, seats: str, tie: list[Column]) -> DataFrame:
    """``parties`` with a column ``quota``: the seats of each group by the highest quotients votes / (2k + 1).

    Ties go to the first in ``tie`` order. Rounding votes * seats / all votes misses the number of
    seats by no more than half the number of parties, so that only so many quotients on either side of
    a party's rounded share (and its part of that surplus) are in doubt; only these are ranked.
    """
    group = Window.partitionBy(*groups) if groups else Window.partitionBy(F.lit(0))
    share = F.when(F.sum(votes).over(group) > 0, F.col(votes) / F.sum(votes).over(group)).otherwise(F.lit(0.0))
    spread = (F.ceil(share * 1.5 * F.count(F.lit(1)).over(group)) + 1).cast("bigint")
    guess = F.floor(share * F.col(seats) + 0.5).cast("bigint")
    bound = parties.withColumn("_sure", F.greatest(F.lit(0).cast("bigint"), guess - spread)).withColumn(
        "_most", guess + spread
    )
    bound = bound.withColumn("_open", F.col(seats) - F.sum("_sure").over(group))
    ranked = bound.withColumn("_k", F.explode(F.sequence("_sure", "_most"))).withColumn(
        "_rank",
        F.row_number().over(group.orderBy((F.col(votes) / (2 * F.col("_k") + 1)).desc(), *tie, "_k")),
    )
    taken = F.sum(F.when(F.col("_rank") <= F.col("_open"), 1).otherwise(0)).cast("bigint")
    return (
        ranked.groupBy(*parties.columns, "_sure")
        .agg(taken.alias("_taken"))
        .withColumn("quota", F.col("_sure") + F.col("_taken"))
        .drop("_sure", "_taken")
    )


def targets(sizes: DataFrame, weights: tuple[int, ...], limit: int) -> DataFrame:
    """Per source: source_size, weight, total, target, capped.

    The sources, ordered by code point with null last, weigh ``weights`` over and over, and share the
    size of all; no target is above ``limit`` times its source's size, what is left over goes to the
    others by weight. One row per source passes through a single window.
    """
    all_rows = Window.partitionBy(F.lit(0))
    listed = F.array(*[F.lit(w).cast("bigint") for w in weights])
    sources = (
        sizes.groupBy("source")
        .agg(F.sum("size").alias("source_size"))
        .withColumn("_no", F.row_number().over(all_rows.orderBy(F.col("source").asc_nulls_last())))
        .withColumn("weight", F.element_at(listed, ((F.col("_no") - 1) % len(weights) + 1).cast("int")))
        .withColumn("total", F.sum("source_size").over(all_rows))
        .withColumn("_cap", F.col("source_size") * limit)
    )
    before = all_rows.orderBy(F.col("_cap") / F.col("weight"), "_no").rowsBetween(Window.unboundedPreceding, -1)
    earlier = lambda c: F.coalesce(F.sum(c).over(before), F.lit(0))
    open_weight = F.sum("weight").over(all_rows) - earlier("weight")
    open_size = F.col("total") - earlier("_cap")
    capped = F.col("_cap").cast("double") * open_weight <= F.col("weight").cast("double") * open_size
    sources = sources.withColumn("capped", capped)
    rest = F.col("total") - F.sum(F.when(F.col("capped"), F.col("_cap")).otherwise(0)).over(all_rows)
    of = F.sum(F.when(F.col("capped"), 0).otherwise(F.col("weight"))).over(all_rows)
    target = F.when(F.col("capped"), F.col("_cap").cast("double")).otherwise(
        F.col("weight") * rest.cast("double") / of
    )
    return sources.withColumn("target", target).drop("_cap")


def mix(
    docs: DataFrame,
    weights: tuple[int, ...] = (5, 2, 1),
    limit: int = 3,
    seed: int = 7,
    block_words: int | None = None,
    shard_blocks: int = 256,
    text: str = "text",
    source: str = "source",
    doc_id: str = "doc_id",
) -> DataFrame:
    """One row per input row: doc_id, source, size, source_size, target, taken (words, repeats counted).

    ``block_words`` defaults to the size of all over 4000 times the sum of weights, but 1 to 4096. A null
    text has size 0; a null source is a source of its own, the last. A source at its limit is taken
    ``limit`` times whole. Rows that share an id are laid out one after the other, each by itself. Rows
    without id are laid out by size. Other columns are not read. Reruns give the same rows.
    """
    key = F.md5(F.concat_ws("|", F.lit(seed), F.col("doc_id").cast("string"), F.col("size").cast("string")))
    sizes = written(
        docs.select(
            F.col(doc_id).alias("doc_id"),
            F.col(source).cast("string").alias("source"),
            F.coalesce(F.regexp_count(F.col(text).cast("string"), F.lit(WORD)), F.lit(0)).cast("bigint").alias("size"),
        ),
        "sizes",
    )
    all_rows = Window.partitionBy(F.lit(0))
    if block_words is None:
        words = F.floor(F.col("total") / (4000 * F.sum("weight").over(all_rows)))
        words = F.greatest(F.lit(1), F.least(F.lit(4096), words)).cast("bigint")
    else:
        words = F.lit(block_words).cast("bigint")
    free = F.when(F.col("capped"), F.lit(0.0)).otherwise(F.col("target"))
    planned = (
        targets(sizes, weights, limit)
        .withColumn("block", words)
        .withColumn("_votes", free)
        .withColumn("_seats", F.floor(F.sum(free).over(all_rows) / F.col("block") + 0.5).cast("bigint"))
    )
    sources = written(
        sainte_lague(planned, [], "_votes", "_seats", [F.col("_no")]).withColumn(
            "shards", F.greatest(F.lit(1), F.ceil(F.col("source_size") / (F.col("block") * shard_blocks))).cast("bigint")
        ),
        "sources",
    ).drop("_votes", "_seats", "_no", "weight", "total")
    if sources.count() <= FEW_SOURCES:
        sources = F.broadcast(sources)
    named = sources.withColumnRenamed("source", "_source")
    laid = sizes.join(named, sizes["source"].eqNullSafe(named["_source"])).drop("_source")
    laid = laid.withColumn("_key", key).withColumn(
        "shard", F.pmod(F.conv(F.substring("_key", 1, 8), 16, 10).cast("bigint"), "shards")
    )
    in_shard = Window.partitionBy("source", "shard")
    laid = laid.withColumn(
        "_from", F.sum("size").over(in_shard.orderBy("_key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, 0))
    ).withColumn("_from", F.col("_from") - F.col("size"))

    shards = (
        laid.groupBy("source", "shard")
        .agg(
            F.sum("size").alias("_shard_size"),
            *[F.first(c).alias(c) for c in ("quota", "block", "capped")],
        )
        .withColumn("_blocks", F.ceil(F.col("_shard_size") / F.col("block")).cast("bigint"))
        .withColumnRenamed("quota", "_source_quota")
    )
    shards = sainte_lague(shards, ["source"], "_shard_size", "_source_quota", [F.col("shard")])
    most = F.col("_blocks") * limit
    shards = shards.where("_blocks > 0").withColumn(
        "quota", F.when(F.col("capped"), most).otherwise(F.least("quota", most))
    )
    shards = shards.withColumn("_passes", F.floor(F.col("quota") / F.col("_blocks")).cast("bigint")).withColumn(
        "_some", F.col("quota") % F.col("_blocks")
    )
    order = F.md5(F.concat_ws("|", F.lit(seed), "source", F.col("shard").cast("string"), F.col("_b").cast("string")))
    chosen = (
        shards.where("_some > 0")
        .withColumn("_b", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("_blocks") - 1)))
        .withColumn("_rank", F.row_number().over(in_shard.orderBy(order, "_b")))
        .where("_rank <= _some")
        .groupBy("source", "shard")
        .agg(F.collect_list("_b").alias("_chosen"))  # at most shard_blocks, or so many as the longest text has
        .withColumnsRenamed({"source": "_source", "shard": "_shard"})
    )
    mine = F.col("source").eqNullSafe(F.col("_source")) & (F.col("shard") == F.col("_shard"))
    quotas = shards.join(chosen, mine, "left").select(
        F.col("source").alias("_source"), F.col("shard").alias("_shard"), "_passes", "_chosen"
    )
    overlap = lambda b: F.greatest(
        F.lit(0).cast("bigint"),
        F.least(F.col("_from") + F.col("size"), (b + 1) * F.col("block")) - F.greatest(F.col("_from"), b * F.col("block")),
    )
    partly = F.aggregate(
        F.coalesce("_chosen", F.array().cast("array<bigint>")), F.lit(0).cast("bigint"), lambda a, b: a + overlap(b)
    )
    joined = laid.join(quotas, mine, "left")
    taken = F.coalesce(F.col("size") * F.col("_passes") + partly, F.lit(0)).cast("bigint")
    return joined.select("doc_id", "source", "size", "source_size", "target", taken.alias("taken"))
