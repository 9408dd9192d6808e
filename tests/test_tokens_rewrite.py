import json

import pytest
from pyspark.sql import functions as F

from veilspark.functions.rewrite import distill_eligible, prompt_request, reply_text, rewrite_accepted, strip_fences
from veilspark.functions.tokens import count_pretokens, count_words, stats_label, token_stats
from veilspark.operators.sanitize import process_table, result_json

RAW = "2031-02-03T04:05:06Z worker 7 crashed at 0xdeadbeef42, token sk-proj-zz9yy8xx7ww6vv5uu4tt3ss2rr1qq0pp"
CLEAN = "<TIME> worker 7 crashed at <ADDR>, token [REDACTED_OPENAI_KEY]"


def test_counts(run):
    assert run(count_pretokens, ["", "  \n", None, "a1234 b!", " x "]) == [0, 0, 0, 5, 1]
    assert run(count_words, ["", None, " a b c ", "a"]) == [0, 0, 3, 1]


def test_token_stats(spark):
    df = spark.createDataFrame([(RAW, CLEAN), ("", "a"), ("same", "same")], "a string, b string")
    rows = [r[0] for r in df.select(token_stats(F.col("a"), F.col("b"))).collect()]
    assert rows[0].raw_tokens > rows[0].sanitized_tokens and rows[0].saved_tokens > 0 and rows[0].reduction_percent > 0
    assert (rows[0].raw_tokens, rows[0].sanitized_tokens) == (47, 18)
    assert rows[1].asDict() == {"raw_tokens": 0, "sanitized_tokens": 1, "saved_tokens": 0, "reduction_percent": 0.0}
    assert rows[2].reduction_percent == 0.0
    words = df.select(token_stats(F.col("a"), F.col("b"), "words")).first()[0]
    assert words.raw_tokens == 10


def test_label(spark):
    df = spark.sql("SELECT named_struct('raw_tokens', 142, 'sanitized_tokens', 48, 'reduction_percent', p) AS s, d FROM VALUES (66.0D, true), (66.2D, false) t(p, d)")
    assert [r[0] for r in df.select(stats_label(F.col("s"), F.col("d"))).collect()] == [
        "AI Distilled | 142 → 48 tokens | -66%", "Stage 1 Rule | 142 → 48 tokens | -66.2%",
    ]


def test_tokenizer_hook(spark):
    df = spark.createDataFrame([("hello", "hell")], "a string, b string")
    stats = df.select(token_stats(F.col("a"), F.col("b"), F.octet_length)).first()[0]
    assert (stats.raw_tokens, stats.sanitized_tokens) == (5, 4)


def test_strip_fences(run):
    cases = [
        ("```text\nlost the disk\n    in unit 4\n```", "lost the disk\n    in unit 4"),
        ("```log\n[WARN] queue is full\n```", "[WARN] queue is full"),
        ("plain words stay", "plain words stay"),
        ("```abc```", "abc"), ("```", ""), ("a\n````", "a\n`"), (None, None), (" x\n", "x"),
    ]
    assert run(strip_fences, [c[0] for c in cases]) == [c[1] for c in cases]


def test_reply_text(run):
    chat = {"choices": [{"message": {"content": " c "}}]}
    cases = [
        ('{"response": " hi "}', "hi"), ('{"response": 5}', None), (json.dumps({"response": " ", **chat}), "c"),
        (json.dumps(chat), "c"), ("not json", None), (None, None), ('{"choices": []}', None),
    ]
    assert run(reply_text, [c[0] for c in cases]) == [c[1] for c in cases]


def test_eligibility_and_guard(run, spark):
    texts = ["x" * 29, "x" * 30, "x" * 15 + "\n" + "x" * 14, "x" * 60, " " * 90, "é" * 30, "Error 404: Not Found"]
    assert run(distill_eligible, texts) == [False, False, True, True, False, True, False]
    long = "y" * 400
    df = spark.createDataFrame([(long, "z" * 79), (long, "z" * 80), (long, long), (long, ""), (long, None), ("q" * 50, "z" * 30)], "o string, c string")
    got = [r[0] for r in df.select(rewrite_accepted(F.col("o"), F.col("c"))).collect()]
    assert got == [False, True, False, False, False, True]


def test_prompt(run):
    body = json.loads(run(lambda t: prompt_request(t, "m"), ['a "quoted"\nlog'])[0])
    assert body["prompt"].endswith('LOG:\na "quoted"\nlog') and body["stream"] is False
    assert body["options"] == {"num_predict": 512, "temperature": 0.1} and body["model"] == "m"


def test_process_table(spark):
    log = "Error: disk full on host alpha\nretry\nretry\nplease call 06 12 34 56 78 for help with it"
    docs = spark.createDataFrame([(1, log), (2, log), (3, "   "), (4, "Error 404: Not Found"), (5, None)], "id int, text string")
    reply = json.dumps({"response": "```\nError: disk full on host alpha, write to a@b.com\n```"})
    rewrites = spark.createDataFrame([(1, reply), (1, reply), (3, reply), (4, reply)], "id int, reply string")
    rows = {r.id: r for r in process_table(docs, ["id"], rewrites=rewrites).collect()}
    assert len(rows) == 5
    assert rows[1].is_distilled and rows[1].sanitized_text == "Error: disk full on host alpha, write to [REDACTED_EMAIL]"
    assert not rows[2].is_distilled and "retry (Repeated 2x)" in rows[2].sanitized_text and "[REDACTED_PHONE]" in rows[2].sanitized_text
    assert (rows[3].sanitized_text, rows[3].is_distilled) == ("", False)
    assert (rows[4].sanitized_text, rows[4].is_distilled) == ("Error 404: Not Found", False)
    assert rows[5].sanitized_text is None and rows[5].diff_lines is None and rows[5].token_stats.raw_tokens == 0
    record = json.loads(result_json(process_table(docs, ["id"])).where("id = 2").first().result_json)
    assert set(record) == {"raw_text", "sanitized_text", "stage1_text", "is_distilled", "token_stats", "diff_lines"}
    assert record["diff_lines"][0]["change_type"] == "equal"
