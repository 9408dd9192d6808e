"""What the plans must look like, and a sample of the SQL comparison."""

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry_point
from tests.compare import compare, connect
from tests.conftest import SF
from veilspark.functions.diff import with_diff
from veilspark.functions.sanitize import sanitize_text_column
from veilspark.operators.report import findings_table, publishable, redaction_report
from veilspark.operators.sanitize import process_table, sanitize_table
from veilspark.plans.oracle import ORACLE
from veilspark.plans.queries import QUERIES


def physical(df):
    return df._jdf.queryExecution().executedPlan().toString()


def optimized(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def test_cleaning_needs_no_shuffle_and_reads_two_columns(spark):
    plan = physical(sanitize_table(docs(spark)).select("doc_id", "sanitized_text"))
    assert "Exchange" not in plan and "Python" not in plan
    assert "ReadSchema: struct<doc_id:bigint,text:string>" in plan


def test_filters_reach_the_scan(spark):
    plan = physical(sanitize_table(docs(spark)).where("lang = 'fr'").select("sanitized_text"))
    assert "EqualTo(lang,fr)" in plan


def test_texts_are_cleaned_once(spark):
    clean = sanitize_table(docs(spark))
    once = optimized(clean).count("<JWT truncated>")
    for df in (
        findings_table(clean, ["doc_id"]), redaction_report(clean, ["source", "lang"]), with_diff(clean),
        process_table(docs(spark), ["doc_id"]),
    ):
        assert optimized(df).count("<JWT truncated>") <= once + 2  # the marker list names it again
    assert optimized(publishable(clean)).count("eyJ[a-zA-Z0-9_-]{10,}\\.") == 2 * optimized(clean).count("eyJ[a-zA-Z0-9_-]{10,}\\.")


def test_requests_clean_a_text_once(spark):
    once = optimized(docs(spark).select(sanitize_text_column("text").alias("clean"))).count("<JWT truncated>")
    for name in ("prompt_rows", "chat_rows"):
        assert optimized(QUERIES[name](spark, SF)).count("<JWT truncated>") == once


def test_diff_shuffles_nothing(spark):
    plan = physical(with_diff(sanitize_table(docs(spark))))
    assert "Exchange" not in plan and plan.count("ArrowEvalPython") == 1


def test_plan_size_is_bounded(spark):
    assert len(optimized(sanitize_table(docs(spark)))) < 40_000


def test_report_shuffles_aggregates_only(spark):
    plan = physical(redaction_report(sanitize_table(docs(spark)), ["source", "lang"]))
    assert all("text" not in line for line in plan.split("\n") if "Exchange" in line)


def test_entry(spark):
    df = entry_point.entry(spark)
    assert df.columns == ["source", "lang", "rule", "source_total", "lang_total", "n_docs", "n_findings"]
    assert set(entry_point.oracle_sql()) <= set(entry_point.queries())


SAMPLE = [
    "sanitize_full", "sanitize_pipeline", "diff_lines", "redaction_report", "token_report", "collapse_rows",
    "sanitize_conversations", "noisiest_docs", "record_full", "leak_gate", "result_json", "prompt_rows", "stream_collapse", "entropy_scalar",
]


@pytest.mark.parametrize("name", SAMPLE)
def test_against_sql(spark, name):
    assert compare(spark, connect(SF), SF, name, QUERIES[name], ORACLE[name]) is None
