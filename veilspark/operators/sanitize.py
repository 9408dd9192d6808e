"""DataFrame operators: sanitize a table, merge rewrites, build the full result record."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilspark.functions.core import held, is_nonblank
from veilspark.functions.diff import with_diff
from veilspark.functions.rewrite import distill_eligible, reply_text, rewrite_accepted, strip_fences
from veilspark.functions.sanitize import sanitize_column, sanitize_text_column
from veilspark.functions.tokens import token_stats


RESULT_SCHEMA = (
    "raw_text string, sanitized_text string, stage1_text string, is_distilled boolean, "
    "token_stats struct<raw_tokens: bigint, sanitized_tokens: bigint, saved_tokens: bigint, reduction_percent: double>, "
    "diff_lines array<struct<change_type: string, old_line_no: int, new_line_no: int, content: string>>"
)


def sanitize_table(df: DataFrame, text: str = "text", region: str | Column = "FR", **lexicon) -> DataFrame:
    """Add ``sanitized_text`` and ``flagged_profanity``; one map stage, no shuffle."""
    cleaned = held(df, sanitize_column(text, region, **lexicon), "_clean")
    return cleaned.select(
        *df.columns, F.col("_clean.text").alias("sanitized_text"), F.col("_clean.flagged_profanity")
    )


def apply_rewrites(
    df: DataFrame,
    rewrites: DataFrame,
    on: list[str],
    text: str = "stage1_text",
    reply: str = "reply",
    order: str | None = None,
) -> DataFrame:
    """Merge replies of an external rewriter; add ``distilled_text`` and ``is_distilled``.

    A reply counts for an eligible text only, after its fences are gone, and if it keeps
    enough of the text; otherwise the text stays. A null key is a key of its own. Of several replies to a key the last along
    ``order`` counts; without ``order``, several different ones are an error.
    """
    several = F.raise_error(F.lit("several replies to a key: name the column that orders them"))
    chosen = F.max_by(reply, order) if order else F.when(F.min(reply) != F.max(reply), several).otherwise(F.max(reply))
    replies = (
        rewrites.groupBy(*on)
        .agg(chosen.alias("_reply"))
        .select(*[F.col(k).alias(f"_{k}") for k in on], strip_fences(reply_text(F.col("_reply"))).alias("_rewrite"))
    )
    match = distill_eligible(F.col(text))
    for key in on:
        match = match & F.col(key).eqNullSafe(F.col(f"_{key}"))
    accepted = rewrite_accepted(F.col(text), F.col("_rewrite"))
    kept = F.when(is_nonblank(F.col(text)), F.col(text)).when(F.col(text).isNotNull(), F.lit(""))
    return (
        df.join(replies, match, "left")
        .withColumn("is_distilled", accepted)
        .withColumn("distilled_text", F.when(F.col("is_distilled"), F.col("_rewrite")).otherwise(kept))
        .drop("_reply", "_rewrite", *[f"_{k}" for k in on])
    )


def safety_pass(df: DataFrame, region: str | Column = "FR", **lexicon) -> DataFrame:
    """Sanitize accepted rewrites again; rows without one keep their stage-1 text."""
    accepted = df.withColumn("_accepted", F.when(F.col("is_distilled"), F.col("distilled_text")))
    again = sanitize_text_column("_accepted", region, **lexicon)
    return accepted.withColumn("sanitized_text", F.coalesce(again, F.col("stage1_text"))).drop("_accepted")


def process_table(
    df: DataFrame,
    on: list[str],
    text: str = "text",
    rewrites: DataFrame | None = None,
    region: str | Column = "FR",
    tokenizer="pretoken",
    diff: bool = True,
    order: str | None = None,
    **lexicon,
) -> DataFrame:
    """The full record per text: stages, optional rewrite with safety pass, token stats, diff.

    ``order`` names the column of ``rewrites`` along which the last of several replies to a key counts.
    """
    staged = (
        sanitize_table(df, text, region, **lexicon)
        .withColumnRenamed("sanitized_text", "stage1_text")
        .withColumnRenamed(text, "raw_text")
    )
    if rewrites is None:
        merged = staged.withColumn("is_distilled", F.lit(False)).withColumn("sanitized_text", F.col("stage1_text"))
    else:
        merged = safety_pass(apply_rewrites(staged, rewrites, on, order=order), region, **lexicon).drop("distilled_text")
    counted = merged.withColumn(
        "token_stats", token_stats(F.col("raw_text"), F.col("sanitized_text"), tokenizer)
    )
    return with_diff(counted, "raw_text", "sanitized_text") if diff else counted


def result_json(df: DataFrame, out: str = "result_json") -> DataFrame:
    """The record as one JSON text per row."""
    fields = ["raw_text", "sanitized_text", "stage1_text", "is_distilled", "token_stats"]
    if "diff_lines" in df.columns:
        fields.append("diff_lines")
    return df.withColumn(out, F.to_json(F.struct(*fields), {"ignoreNullFields": "false"}))
