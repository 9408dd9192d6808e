"""Registered queries: every operator over the whole supplied tables."""

from __future__ import annotations

from collections.abc import Callable
from functools import lru_cache

from pyspark import SparkContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from veilspark.functions import diff as D
from veilspark.functions.core import held, is_nonblank, shannon_entropy
from veilspark.functions.lines import collapse_duplicates, prune_frames, split_lines
from veilspark.functions.pii import redact_card, redact_email, redact_iban, redact_phone, redact_pii
from veilspark.functions.profanity import censor_profanity, flag_profanity, fold_word, profanity_hits
from veilspark.functions.rewrite import chat_request, distill_eligible, prompt_request, reply_text, rewrite_accepted, strip_fences
from veilspark.functions.rules import ALL_RULES
from veilspark.functions.sanitize import sanitize_text_column
from veilspark.functions.skeleton import WORD_PATTERN
from veilspark.functions.spans import spans_table
from veilspark.functions.secrets import clean_stage1, redact_high_entropy
from veilspark.functions.tokens import count_pretokens, count_words, stats_label, token_stats
from veilspark.operators import report as R
from veilspark.operators.diff_rows import diff_rows
from veilspark.operators.kept_report import KeptReport
from veilspark.operators.runs import collapse_rows, prune_rows
from veilspark.operators.sanitize import (
    RESULT_SCHEMA,
    apply_rewrites,
    process_table,
    result_json,
    safety_pass,
    sanitize_table,
)
from veilspark.operators.tables import (
    censor_by_lexicon,
    find_by_lexicon,
    flag_by_lexicon,
    latest_per_source,
    sanitize_conversations,
    sanitize_turns,
)
from veilspark.plans.corpus import corpus, logs, logs_from, replies, table, texts
from veilspark.sources.batches import read_batches, write_batch
from veilspark.sources.texts import load_texts, new_dir, nonblank, spread_tasks, write_texts
from veilspark.streaming import jobs as S
from veilspark.streaming.collapse import collapse_event_stream, read_event_runs
from veilspark.streaming.sessions import session_stream
from veilspark.streaming.sinks import read_updates

Query = Callable[[SparkSession, str], DataFrame]

KEYS = ["corpus", "id", "part"]


def _mapped(fn: Callable[[Column], Column], name: str = "text") -> Query:
    """A query that maps every text of the corpus; the expression is put together once."""

    @lru_cache(maxsize=1)
    def expression(gateway: object) -> Column:
        return fn(F.col("text")).alias(name)

    return lambda spark, sf: corpus(spark, sf).select(*KEYS, expression(SparkContext._gateway))


def _sanitized(spark: SparkSession, sf: str) -> DataFrame:
    return sanitize_table(corpus(spark, sf))


def _processed(spark: SparkSession, sf: str) -> DataFrame:
    return process_table(corpus(spark, sf), KEYS, diff=False)


def scan_documents(spark, sf):
    return load_texts(spark, f"{sf}/documents.parquet", id="doc_id", keep=("lang", "source"))


def nonblank_docs(spark, sf):
    return nonblank(corpus(spark, sf)).select(*KEYS, "text")


def sanitize_full(spark, sf):
    return _sanitized(spark, sf).select(*KEYS, F.col("sanitized_text").alias("text"), "flagged_profanity")


def sanitize_pipeline(spark, sf):
    documents = texts(spark, sf, "documents")
    done = process_table(documents, ["doc_id"], rewrites=replies(spark, sf), diff=False)
    return done.select(
        "doc_id", "raw_text", "stage1_text", "sanitized_text", "is_distilled", "flagged_profanity", "token_stats.*"
    )


def sink_roundtrip(spark, sf):
    path = new_dir(spark, "roundtrip")
    write_texts(
        _sanitized(spark, sf).select(*KEYS, "lang", "sanitized_text"), path, partition_by=("lang",), compact=True
    )
    return spark.read.parquet(path).select(*KEYS, F.col("lang").cast("string").alias("lang"), "sanitized_text")


def sink_batches(spark, sf):
    """Two batches, the first written again after an attempt with other rows."""
    path, once = new_dir(spark, "batches"), new_dir(spark, "batches-clean")
    # Cleaning costs far more than a folder of clean texts, from which every attempt is written.
    write_texts(_sanitized(spark, sf).select("corpus", "id", "part", "lang", "sanitized_text"), once, partition_by=("corpus",))
    clean = spark.read.schema("id bigint, part bigint, lang string, sanitized_text string, corpus string").parquet(once)
    clean = clean.select(*KEYS, "lang", "sanitized_text")
    documents = F.col("corpus") == "documents"
    write_batch(clean.where(~documents), path, 0, partition_by=("lang",), compact=True)
    write_batch(clean.where(documents), path, 1, partition_by=("lang",), compact=True)
    write_batch(clean.where(~documents), path, 0, partition_by=("lang",), compact=True)
    schema = "corpus string, id bigint, part bigint, sanitized_text string, lang string"
    return read_batches(spark, path, schema).select(*KEYS, "lang", "sanitized_text")


def latest(spark, sf):
    newest = latest_per_source(logs(spark, sf), "source", ["ts", "event_id"])
    return newest.select("source", "event_id", sanitize_text_column("text").alias("text"))


def result_json_query(spark, sf):
    """The record as JSON, read back by its schema."""
    done = process_table(texts(spark, sf, "documents"), ["doc_id"])
    read = result_json(done).select("doc_id", F.from_json("result_json", RESULT_SCHEMA).alias("r"))
    return read.select(
        "doc_id", "r.raw_text", "r.sanitized_text", "r.stage1_text", "r.is_distilled", "r.token_stats.*",
        F.size("r.diff_lines").cast("long").alias("n_diff_lines"),
        F.size(F.filter("r.diff_lines", lambda d: d["new_line_no"].isNull())).cast("long").alias("n_deleted"),
    )


def split_lines_query(spark, sf):
    lines = F.posexplode(split_lines(F.col("text")))
    return corpus(spark, sf).select(*KEYS, lines.alias("pos", "line")).select(
        *KEYS, (F.col("pos") + 1).cast("long").alias("line_no"), "line"
    )


def lexicon_flag(spark, sf):
    """Flags against a lexicon table: here all words of the benchmark texts."""
    words = F.explode(F.regexp_extract_all(F.col("text"), F.lit(WORD_PATTERN), F.lit(0))).alias("term")
    lexicon = table(spark, sf, "benchmark").select(words)
    return flag_by_lexicon(corpus(spark, sf), KEYS, lexicon)


def lexicon_censor(spark, sf):
    words = F.explode(F.regexp_extract_all(F.col("text"), F.lit(WORD_PATTERN), F.lit(0))).alias("term")
    return censor_by_lexicon(corpus(spark, sf), KEYS, table(spark, sf, "benchmark").select(words))


def lexicon_phrases(spark, sf):
    """Where texts hold a two-word term: here all pairs of neighbours of the benchmark texts, graded by how
    many items have them."""
    words = F.regexp_extract_all(F.col("text"), F.lit(WORD_PATTERN), F.lit(0))
    pairs = F.transform(F.slice(words, 2, F.size(words)), lambda w, i: F.concat(F.get(words, i), F.lit(" "), w))
    items = table(spark, sf, "benchmark").select(F.explode(F.array_distinct(F.transform(pairs, fold_word))).alias("term"))
    lexicon = items.groupBy("term").agg(F.count(F.lit(1)).alias("n")).select(
        "term",
        F.when(F.col("n") > 1, "shared").otherwise("single").alias("category"),
        F.least("n", F.lit(3)).cast("int").alias("severity"),
    )
    return find_by_lexicon(corpus(spark, sf), KEYS, lexicon, longest=2)


LINE_ORDER = ["id", "part", "line_no"]


def _line_slices() -> list[Column]:
    """From fine to coarse: some thousand lines to a slice, and 100 slices to one of the next."""
    return [F.floor(F.col("id") / size) for size in (200, 20_000)]


def _line_table(spark, sf) -> DataFrame:
    """Lines of all texts, one per row, as a log table would hold them: one source per corpus part."""
    return split_lines_query(spark, sf).select(F.col("corpus").alias("source"), *LINE_ORDER, "line")


def prune_rows_query(spark, sf):
    return prune_rows(_line_table(spark, sf), ["source"], LINE_ORDER, "line", _line_slices())


def collapse_rows_query(spark, sf):
    return collapse_rows(_line_table(spark, sf), ["source"], LINE_ORDER, "line", _line_slices())


def profanity_hits_query(spark, sf):
    hits = F.posexplode(profanity_hits(F.col("text"))).alias("pos", "h")
    return corpus(spark, sf).select(*KEYS, hits).select(*KEYS, (F.col("pos") + 1).cast("long").alias("pos"), "h.*")


def token_stats_query(spark, sf):
    return _processed(spark, sf).select(*KEYS, "token_stats.*")


def stats_label_query(spark, sf):
    return _processed(spark, sf).select(*KEYS, stats_label(F.col("token_stats"), F.col("is_distilled")).alias("label"))


def _diffed(spark, sf) -> DataFrame:
    return D.with_diff(_sanitized(spark, sf).select(*KEYS, "text", "sanitized_text"))


def diff_lines(spark, sf):
    return _diffed(spark, sf).select(*KEYS, F.posexplode("diff_lines").alias("pos", "d")).select(
        *KEYS, (F.col("pos") + 1).cast("long").alias("pos"), "d.*"
    )


def diff_terminated(spark, sf):
    """The diff of lines with their terminators."""
    both = _sanitized(spark, sf).select(*KEYS, "text", "sanitized_text")
    return D.with_diff(both, keep_ends=True).select(*KEYS, F.posexplode("diff_lines").alias("pos", "d")).select(
        *KEYS, (F.col("pos") + 1).cast("long").alias("pos"), "d.*"
    )


def diff_rows_query(spark, sf):
    """The diff of raw and cleaned lines, both as tables with one line per row."""

    def lines(df: DataFrame, column: str) -> DataFrame:
        return df.select(*KEYS, F.posexplode(split_lines(F.col(column))).alias("pos", "line")).select(
            *KEYS, (F.col("pos") + 1).alias("line_no"), "line"
        )

    return diff_rows(lines(corpus(spark, sf), "text"), lines(_sanitized(spark, sf), "sanitized_text"), KEYS)


def diff_search(spark, sf):
    return diff_lines(spark, sf).where(D.diff_matches(F.col("content"), "redacted"))


def diff_summary(spark, sf):
    def count(kind: str) -> Column:
        return F.size(F.filter("diff_lines", lambda d: d["change_type"] == kind)).cast("long").alias(f"n_{kind}")

    return _diffed(spark, sf).select(
        *KEYS, F.size("diff_lines").cast("long").alias("n_lines"), count("add"), count("delete"), count("equal")
    )


def diff_render(spark, sf):
    return _diffed(spark, sf).select(*KEYS, D.render_diff(F.col("diff_lines")).alias("unified"))


def _staged(spark, sf) -> DataFrame:
    return sanitize_table(texts(spark, sf, "documents")).withColumnRenamed("sanitized_text", "stage1_text")


def distill_guard(spark, sf):
    read = replies(spark, sf).select("doc_id", strip_fences(reply_text(F.col("reply"))).alias("cleaned"))
    both = _staged(spark, sf).join(read, "doc_id")
    return both.select("doc_id", rewrite_accepted(F.col("stage1_text"), F.col("cleaned")).alias("accepted"))


def record_full(spark, sf):
    """Stages, rewrites, safety pass, token stats and diff over all texts."""
    answers = replies(spark, sf).select(
        F.lit("documents").alias("corpus"), F.col("doc_id").alias("id"), F.lit(0).cast("bigint").alias("part"), "reply"
    )
    done = process_table(corpus(spark, sf), KEYS, rewrites=answers)

    def count(kind: str) -> Column:
        return F.size(F.filter("diff_lines", lambda d: d["change_type"] == kind)).cast("long").alias(f"n_{kind}")

    return done.select(
        *KEYS, "raw_text", "stage1_text", "sanitized_text", "is_distilled", "flagged_profanity", "token_stats.*",
        count("equal"), count("add"), count("delete"),
    )


def apply_rewrites_query(spark, sf):
    merged = apply_rewrites(_staged(spark, sf), replies(spark, sf), ["doc_id"])
    return merged.select("doc_id", F.col("distilled_text").alias("text"), "is_distilled")


def safety_pass_query(spark, sf):
    merged = safety_pass(apply_rewrites(_staged(spark, sf), replies(spark, sf), ["doc_id"]))
    return merged.select("doc_id", F.col("sanitized_text").alias("text"), "is_distilled")


def strip_fences_query(spark, sf):
    return replies(spark, sf).select("doc_id", strip_fences(reply_text(F.col("reply"))).alias("text"))


def reply_text_query(spark, sf):
    return replies(spark, sf).select("doc_id", reply_text(F.col("reply")).alias("text"))


def _eligible(spark, sf) -> DataFrame:
    """Requests hold cleaned text only."""
    cleaned = held(texts(spark, sf, "documents"), sanitize_text_column("text"), "_clean")
    return cleaned.select("doc_id", F.col("_clean").alias("text")).where(distill_eligible(F.col("text")))


def prompt_rows(spark, sf):
    request = prompt_request(F.col("text"), "any-model")
    return _eligible(spark, sf).select("doc_id", request.alias("request")).select(
        "doc_id",
        F.get_json_object("request", "$.prompt").alias("prompt"),
        F.get_json_object("request", "$.options.num_predict").cast("long").alias("num_predict"),
        F.get_json_object("request", "$.options.temperature").cast("double").alias("temperature"),
    )


def chat_rows(spark, sf):
    request = chat_request(F.col("text"), "any-model")
    return _eligible(spark, sf).select("doc_id", request.alias("request")).select(
        "doc_id",
        F.get_json_object("request", "$.messages[0].role").alias("first_role"),
        F.get_json_object("request", "$.messages[0].content").alias("instruction"),
        F.get_json_object("request", "$.messages[1].role").alias("second_role"),
        F.get_json_object("request", "$.messages[1].content").alias("text"),
        F.get_json_object("request", "$.max_tokens").cast("long").alias("max_tokens"),
        F.get_json_object("request", "$.temperature").cast("double").alias("temperature"),
    )


def findings_query(spark, sf):
    return R.findings_table(_sanitized(spark, sf), KEYS)


def finding_spans(spark, sf):
    """Where in the raw texts each rule fires."""
    return spans_table(corpus(spark, sf), KEYS)


def redaction_report(spark, sf):
    return R.redaction_report(_sanitized(spark, sf), ["source", "lang"])


def token_report(spark, sf):
    return R.token_report(_processed(spark, sf), "source")


def _kept(spark, sf) -> KeptReport:
    """Reports from four batches, one of them added twice, and a merge in between."""
    report = KeptReport(spark, new_dir(spark, "report"), ["source", "lang"], KEYS)
    parts = ["corpus = 'documents'", "corpus = 'pages'", "corpus = 'conversations'", "corpus = 'logs'"]
    done = process_table(corpus(spark, sf), KEYS, diff=False)
    for number, part in enumerate(parts):
        report.add(number, done.where(part))
        if number == 1:
            report.add(number, done.where(part))
            report.merge(number)
    return report


def kept_redactions(spark, sf):
    """The redaction report from batches; the estimate of different documents is tested, not returned."""
    near = F.abs(F.col("distinct_docs") / F.col("n_docs") - 1) <= 0.05
    return _kept(spark, sf).redaction().withColumn("distinct_near", near).drop("distinct_docs")


def kept_tokens(spark, sf):
    return _kept(spark, sf).tokens("source").drop("median_tokens", "p90_tokens")


def publishable(spark, sf):
    return R.publishable(_sanitized(spark, sf), raw="text").select(*KEYS, F.col("sanitized_text").alias("text"))


def leak_gate(spark, sf):
    """The gate before raw texts, which it must refuse where they hold a secret or personal data."""
    return R.publishable(corpus(spark, sf), clean="text").select(*KEYS, "text")


def noisiest_docs(spark, sf):
    return R.noisiest(corpus(spark, sf), KEYS, 50)


def conversations(spark, sf):
    return sanitize_conversations(texts(spark, sf, "conversations"), segment_turns=256)


def conversation_turns(spark, sf):
    return sanitize_turns(texts(spark, sf, "conversations"))


def _events_stream(spark, sf) -> DataFrame:
    events = table(spark, sf, "events")
    stream = spark.readStream.schema(events.schema).option("pathGlobFilter", "events*.parquet").parquet(sf)
    tasks = spread_tasks(events)
    spread_out = stream.repartition(tasks) if tasks else stream
    return spread_out.withColumn("ts", F.col("ts").cast("timestamp"))


def stream_sanitize(spark, sf):
    out = new_dir(spark, "stream-sanitize")
    source = logs_from(_events_stream(spark, sf)).select("event_id", "source", "text")
    S.sanitize_stream(source, out, out + "-checkpoint").awaitTermination()
    return spark.read.parquet(out)


def stream_collapse(spark, sf):
    out = new_dir(spark, "stream-collapse")
    source = _events_stream(spark, sf).select(
        F.col("user_id").alias("source"), "ts", "event_id", F.col("event_type").alias("line")
    )
    job = S.collapse_stream(
        source, out, out + "-checkpoint", ["source"], ["ts", "event_id"], "line", F.date_trunc("day", "ts")
    )
    job.awaitTermination()
    return S.read_collapsed(spark, out).select(
        "source", F.col("first.event_id").alias("first_event"), F.col("last.event_id").alias("last_event"), "line", "n"
    )


def stream_marker_counts(spark, sf):
    out = new_dir(spark, "stream-markers")
    S.marker_count_stream(logs_from(_events_stream(spark, sf)), out, out + "-checkpoint", window="1 day").awaitTermination()
    state = read_updates(spark, out, ["window_start", "window_end", "source", "rule"])
    return state.select(
        F.date_format("window_start", "yyyy-MM-dd HH:mm:ss").alias("window_start"), "source", "rule", "n"
    )


def stream_latest(spark, sf):
    out = new_dir(spark, "stream-latest")
    S.latest_stream(logs_from(_events_stream(spark, sf)), out, out + "-checkpoint", ["ts", "event_id"]).awaitTermination()
    state = read_updates(spark, out, ["source"], ["ts", "event_id"])
    return state.select("source", "event_id", F.col("sanitized_text").alias("text"))


def stream_event_runs(spark, sf):
    """Repeated event types of each user along event time; a day's silence ends a run."""
    out = new_dir(spark, "stream-runs")
    events = _events_stream(spark, sf).select("user_id", "ts", "event_id", "event_type")
    job = collapse_event_stream(
        events, out, out + "-checkpoint", ["user_id"], "ts", ["event_id"], "event_type", delay="1 hour", gap="1 day"
    )
    job.awaitTermination()
    runs = read_event_runs(spark, out, ["user_id"], "ts")
    return runs.select("user_id", "first_event_id", "last_event_id", "line", "n")


def stream_sessions(spark, sf):
    """Sessions of each kind of event, closed by six minutes of silence; those still open at the end are not out."""
    out = new_dir(spark, "stream-sessions")
    source = logs_from(_events_stream(spark, sf))
    session_stream(source, out, out + "-checkpoint", ["event_id"], gap="6 minutes", delay="1 hour").awaitTermination()
    sessions = spark.read.parquet(out)
    return sessions.select(
        F.date_format("session_start", "yyyy-MM-dd HH:mm:ss").alias("session_start"), "source", "n_texts", "n_findings"
    )


QUERIES: dict[str, Query] = {
    "scan_documents": scan_documents,
    "sanitize_pipeline": sanitize_pipeline,
    "record_full": record_full,
    "sink_roundtrip": sink_roundtrip,
    "sink_batches": sink_batches,
    "stream_sanitize": stream_sanitize,
    "latest_per_source": latest,
    "result_json": result_json_query,
    "nonblank_docs": nonblank_docs,
    "diff_search": diff_search,
    "distill_eligible": _mapped(distill_eligible, "eligible"),
    "distill_guard": distill_guard,
    **{f"rule_{r.name}": _mapped(r.apply) for r in ALL_RULES},
    "high_entropy": _mapped(redact_high_entropy),
    "email": _mapped(redact_email),
    "card": _mapped(redact_card),
    "iban": _mapped(redact_iban),
    "phone": _mapped(redact_phone),
    "entropy_scalar": _mapped(lambda t: F.round(shannon_entropy(t), 6), "entropy"),
    "profanity_flag": _mapped(flag_profanity, "flagged"),
    "profanity_censor": _mapped(censor_profanity),
    "profanity_hits": profanity_hits_query,
    "lexicon_flag": lexicon_flag,
    "lexicon_censor": lexicon_censor,
    "lexicon_phrases": lexicon_phrases,
    "split_lines": split_lines_query,
    "prune_frames": _mapped(prune_frames),
    "collapse_duplicates": _mapped(collapse_duplicates),
    "prune_rows": prune_rows_query,
    "collapse_rows": collapse_rows_query,
    "token_estimate": _mapped(count_pretokens, "tokens"),
    "token_words": _mapped(count_words, "tokens"),
    "token_stats": token_stats_query,
    "stats_label": stats_label_query,
    "diff_lines": diff_lines,
    "diff_terminated": diff_terminated,
    "diff_rows": diff_rows_query,
    "diff_summary": diff_summary,
    "diff_render": diff_render,
    "apply_rewrites": apply_rewrites_query,
    "strip_fences": strip_fences_query,
    "reply_text": reply_text_query,
    "prompt_rows": prompt_rows,
    "chat_rows": chat_rows,
    "safety_pass": safety_pass_query,
    "clean_stage1": _mapped(clean_stage1),
    "redact_pii": _mapped(redact_pii),
    "sanitize_full": sanitize_full,
    "findings": findings_query,
    "finding_spans": finding_spans,
    "redaction_report": redaction_report,
    "token_report": token_report,
    "kept_redactions": kept_redactions,
    "kept_tokens": kept_tokens,
    "publishable": publishable,
    "leak_gate": leak_gate,
    "noisiest_docs": noisiest_docs,
    "sanitize_conversations": conversations,
    "conversation_turns": conversation_turns,
    "stream_collapse": stream_collapse,
    "stream_marker_counts": stream_marker_counts,
    "stream_latest": stream_latest,
    "stream_event_runs": stream_event_runs,
    "stream_sessions": stream_sessions,
}
