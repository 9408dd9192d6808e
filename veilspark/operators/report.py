"""Corpus reports over sanitized tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilspark.functions.core import held, let
from veilspark.functions.findings import findings
from veilspark.functions.lines import clean_lines, split_lines
from veilspark.functions.pii import redact_pii
from veilspark.functions.secrets import normalize_values, redact_secrets
from veilspark.functions.tokens import reduction_percent

TOTAL = "ALL"


def findings_table(df: DataFrame, keys: list[str], clean: str = "sanitized_text") -> DataFrame:
    """(keys, rule, n): counted inside the row, so nothing is shuffled."""
    return df.select(*keys, F.explode(findings(F.col(clean))).alias("f")).select(*keys, "f.rule", "f.n")


def with_total(found: Column) -> Column:
    """The findings of a text and, if there are any, their sum under the rule ``ALL``."""

    def body(f: Column) -> Column:
        everything = F.aggregate(f, F.lit(0).cast("long"), lambda acc, x: acc + x["n"])
        total = F.struct(F.lit(TOTAL).alias("rule"), everything.alias("n"))
        return F.when(F.size(f) > 0, F.concat(f, F.array(total))).otherwise(f)

    return let(found, body)


def cubed(counts: DataFrame, dims: list[str], *more: Column) -> DataFrame:
    """Counts by (dims, rule) with the subtotals of all dimensions, but not of the rule."""
    cube = counts.cube(*dims, "rule").agg(
        *[(F.grouping(d) == 1).alias(f"{d}_total") for d in dims],
        F.sum("n_docs").alias("n_docs"),
        F.sum("n_findings").alias("n_findings"),
        *more,
        F.grouping("rule").alias("_g"),
    )
    return cube.where("_g = 0").drop("_g")


def redaction_report(df: DataFrame, dims: list[str], clean: str = "sanitized_text") -> DataFrame:
    """Documents and findings per dimension value and rule, with all subtotals.

    In a subtotal over a dimension ``<dim>_total`` is true and the dimension is null; a null with
    ``<dim>_total`` false is a null of the data. The rule ``ALL`` counts documents and findings of any rule.

    Each text adds one row per rule plus one for the total, which replaces a distinct count.
    The cube runs over the small pre-aggregated table, not over the texts.
    """
    base = (
        df.select(*dims, F.explode(with_total(findings(F.col(clean)))).alias("f"))
        .groupBy(*dims, "f.rule")
        .agg(F.count(F.lit(1)).alias("n_docs"), F.sum("f.n").alias("n_findings"))
    )
    return cubed(base, dims)


def token_report(df: DataFrame, dim: str, stats: str = "token_stats") -> DataFrame:
    """Token saving per value of ``dim`` and overall (``<dim>_total``), with quantiles of the reduction.

    The reduction has one decimal, so at most 1,001 values per group: a histogram of it comes
    first, and exact quantiles cost no more than that.
    """
    s = F.col(stats)
    histogram = (
        df.select(
            dim, s["raw_tokens"].alias("raw"), s["saved_tokens"].alias("saved"),
            s["reduction_percent"].alias("pct"),
        )
        .groupBy(dim, "pct")
        .agg(F.count(F.lit(1)).alias("n"), F.sum("raw").alias("raw"), F.sum("saved").alias("saved"))
    )
    return token_quantiles(histogram, dim)


def token_quantiles(histogram: DataFrame, dim: str, *more: Column) -> DataFrame:
    """The token report from a histogram (dim, pct, n, raw, saved) of the reduction."""

    def quantile(p: float) -> Column:
        return F.round(F.percentile("pct", F.lit(p), F.col("n")), 4)

    sums = histogram.rollup(dim).agg(
        (F.grouping(dim) == 1).alias(f"{dim}_total"),
        F.sum("n").alias("n_docs"),
        F.sum("raw").alias("raw_tokens"),
        F.sum("saved").alias("saved_tokens"),
        quantile(0.5).alias("median_percent"),
        quantile(0.9).alias("p90_percent"),
        *more,
    )
    reduction = reduction_percent(F.col("raw_tokens"), F.col("saved_tokens")).alias("reduction_percent")
    first = [dim, f"{dim}_total", "n_docs", "raw_tokens", "saved_tokens"]
    return sums.select(*first, reduction, *sums.columns[len(first):])


def publishable(
    df: DataFrame, clean: str = "sanitized_text", region: str | Column = "FR", raw: str | None = None
) -> DataFrame:
    """Rows in whose clean text a second detection pass finds nothing to replace; a null text is not published.

    With the ``raw`` column at hand, texts that the first pass left as they were need no second
    one: no rule undoes another, so every rule has already found nothing in them.

    The text is held, so that the test cannot move below the cleaning and repeat it.
    """
    again = redact_pii(redact_secrets(F.col("_held")), region)
    clear = again == F.col("_held")
    if raw is not None:
        clear = F.when(F.col(raw) == F.col("_held"), True).otherwise(clear)
    return held(df, F.col(clean), "_held").where(clear).select(*df.columns)


def noise_share(text: Column) -> Column:
    """Struct of the number of lines before and after pruning and collapsing."""

    def count(v: Column) -> Column:
        before, after = F.size(split_lines(v)), F.size(split_lines(clean_lines(v)))
        return F.struct(before.cast("long").alias("lines_before"), after.cast("long").alias("lines_after"))

    return let(normalize_values(redact_secrets(text)), count)


def noisiest(df: DataFrame, keys: list[str], k: int, text: str = "text") -> DataFrame:
    """The k texts that lose the largest share of their lines; ties go to the smaller key."""
    counted = df.select(*keys, noise_share(F.col(text)).alias("s")).select(*keys, "s.*")
    share = F.when(
        F.col("lines_before") > 0, F.round((F.col("lines_before") - F.col("lines_after")) / F.col("lines_before"), 6)
    ).otherwise(0.0)
    return counted.withColumn("noise_share", share).orderBy(F.desc("noise_share"), *keys).limit(k)
