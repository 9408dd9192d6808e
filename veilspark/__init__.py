"""Text sanitization at corpus scale as native Spark operators.

Column functions rewrite or inspect one text column; table operators work on DataFrames;
streaming jobs do the same for arriving rows.
"""

from veilspark.functions.diff import diff_matches, render_diff, with_diff
from veilspark.functions.findings import findings
from veilspark.functions.lines import clean_lines, collapse_duplicates, prune_frames, split_lines
from veilspark.functions.pii import redact_card, redact_email, redact_iban, redact_phone, redact_pii, redact_ssn
from veilspark.functions.profanity import censor_profanity, flag_profanity, profanity_hits
from veilspark.functions.rewrite import chat_request, distill_eligible, prompt_request, reply_text, rewrite_accepted, strip_fences
from veilspark.functions.rules import apply_rule, rules_table
from veilspark.functions.sanitize import sanitize, sanitize_text
from veilspark.functions.secrets import clean_stage1, normalize_values, redact_high_entropy, redact_secrets
from veilspark.functions.spans import spans_table
from veilspark.functions.tokens import count_pretokens, count_words, stats_label, token_stats
from veilspark.operators.diff_rows import diff_rows
from veilspark.operators.kept_report import KeptReport
from veilspark.operators.report import findings_table, noisiest, publishable, redaction_report, token_report
from veilspark.operators.runs import collapse_rows, find_runs, prune_rows
from veilspark.operators.sanitize import apply_rewrites, process_table, result_json, safety_pass, sanitize_table
from veilspark.operators.tables import (
    censor_by_lexicon,
    find_by_lexicon,
    flag_by_lexicon,
    latest_per_source,
    sanitize_conversations,
    sanitize_turns,
)
from veilspark.sources.batches import read_batches, write_batch
from veilspark.sources.texts import load_texts, nonblank, spread, write_texts
from veilspark.streaming.collapse import collapse_event_stream, read_event_runs
from veilspark.streaming.jobs import collapse_stream, latest_stream, marker_count_stream, read_collapsed, sanitize_stream
from veilspark.streaming.sessions import session_stream
from veilspark.streaming.sinks import read_updates

__all__ = [
    "KeptReport", "apply_rewrites", "apply_rule", "censor_by_lexicon", "censor_profanity", "chat_request", "clean_lines", "clean_stage1",
    "collapse_duplicates", "collapse_event_stream", "collapse_rows", "collapse_stream", "count_pretokens", "count_words", "diff_matches", "diff_rows",
    "distill_eligible", "find_by_lexicon", "find_runs", "findings", "findings_table", "flag_by_lexicon", "flag_profanity",
    "latest_per_source", "latest_stream", "load_texts", "marker_count_stream", "noisiest", "nonblank",
    "normalize_values", "process_table", "profanity_hits", "prompt_request", "prune_frames", "prune_rows", "publishable",
    "read_batches", "read_collapsed", "read_event_runs", "read_updates", "redact_card", "redact_email", "redact_high_entropy", "redact_iban",
    "redact_phone", "redact_pii", "redact_secrets", "redact_ssn", "redaction_report", "render_diff", "reply_text",
    "result_json", "rewrite_accepted", "rules_table", "safety_pass", "sanitize", "sanitize_conversations",
    "sanitize_stream", "sanitize_table", "sanitize_text", "sanitize_turns", "session_stream", "spans_table", "split_lines", "spread", "stats_label", "strip_fences",
    "token_report", "token_stats", "with_diff", "write_batch", "write_texts",
]
