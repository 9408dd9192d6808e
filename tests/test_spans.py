"""Places of findings: putting the markers there gives the chain's own result."""

import re

from pyspark.sql import functions as F

from tests.conftest import SF
from veilspark.functions.pii import redact_pii
from veilspark.functions.rules import ALL_RULES, STAGE1_RULES, rule
from veilspark.functions.secrets import normalize_values, redact_secrets
from veilspark.functions.spans import running, spans_table
from veilspark.plans.corpus import corpus

WRITTEN = {r.name: r.replacement for r in ALL_RULES} | {
    "aws_secret": ': "[REDACTED_AWS_SECRET]"',
    "json_secret": '"[REDACTED_SECRET]"',
    "kv_secret": "[REDACTED_SECRET]",
    "db_uri": "[REDACTED_PASS]",
    "high_entropy": "[REDACTED_HIGH_ENTROPY]",
    "email": "[REDACTED_EMAIL]",
    "card": "[REDACTED_CARD]",
    "iban": "[REDACTED_IBAN]",
    "phone": "[REDACTED_PHONE]",
}
CODES = re.compile(STAGE1_RULES[0].pattern)


def rendered(raw, spans):
    out, at = [], 0
    for name, start, end in sorted(spans, key=lambda s: s[1]):
        # kv_secret keeps "=" as it stands in front of the value.
        out += [CODES.sub("", raw[at:start]), WRITTEN[name]]
        at = end
    return "".join(out) + CODES.sub("", raw[at:])


def places(df, keys):
    found = {}
    for r in spans_table(df, keys).collect():
        found.setdefault(tuple(r[k] for k in keys), []).append((r.rule, r.span_start, r.span_end))
    return found


def check(df, keys):
    found = places(df, keys)
    clean = df.select(*keys, "text", redact_pii(normalize_values(redact_secrets(F.col("text")))).alias("clean"))
    rows = clean.collect()
    for r in rows:
        spans = found.get(tuple(r[k] for k in keys), [])
        if r.text is None:
            assert not spans
        else:
            assert rendered(r.text, spans) == r.clean, (r.text, spans)
    return found, rows


def test_whole_corpus_is_rebuilt(spark):
    keys = ["corpus", "id", "part"]
    found, _ = check(corpus(spark, SF), keys)
    assert {name for spans in found.values() for name, _, _ in spans} >= {"openai_key", "db_uri", "email", "iban", "iso_time"}


HEX = "0123456789abcdef" * 3
ODD = [
    None,
    "",
    "mail \x1b[31ma@b.example\x1b[0m and\x1b[1m \x1b[2mc@d.example",
    "a@b\x1b[31m.example is split by a code",
    "[REDACTED_EMAIL] is spoofed, x@y.example is not <TIME>",
    " own private use x@y.example ",
    '{"password": "sk-proj-' + HEX + '"} secret=\'' + "q" * 12 + "'",
    "postgres://" + "Ab1Cd2Ef3Gh4Ij5Kl6Mn7Op8Qr" + ":pw@db and mysql://u:p:w@h",
    "\U0001f600 12:34:5612:34:56 2031-05-09T07:11:02Z \U0001f600 0xdeadbeef tel 06 12 34 56 78",
    "aws_secret = " + HEX[:40] + " Bearer   " + HEX + "==",
    "123-45-6789 card 4024007130551186 iban GB82WEST12345698765432",
    "x@y.example\x1b[0m " * 700,
    "\x1b[0m" * 900 + "x@y.example",
]


def test_odd_texts(spark):
    df = spark.createDataFrame(list(enumerate(ODD)) * 2, "id int, text string")
    found, _ = check(df.dropDuplicates(["id"]), ["id"])
    sliced = {i: [(name, ODD[i][a:b]) for name, a, b in spans] for (i,), spans in found.items()}
    assert sliced[4] == [("email", "x@y.example")]
    assert sliced[2] == [("email", "a@b.example"), ("email", "c@d.example")]
    assert sliced[3] == [("email", "a@b\x1b[31m.example")]
    assert sliced[6] == [("json_secret", ODD[6].split(": ")[1].split("}")[0]), ("kv_secret", "'" + "q" * 12 + "'")]
    assert [n for n, _ in sliced[7]] == ["high_entropy", "db_uri", "db_uri"]
    assert sliced[7][2] == ("db_uri", "p:w")
    assert len(sliced[11]) == 700 and set(sliced[11]) == {("email", "x@y.example")}
    assert (0,) not in found and (1,) not in found
    # Repeated rows give their findings each, and an empty table none.
    assert spans_table(df, ["id"]).where("id = 4").count() == 2
    assert spans_table(df.limit(0), ["id"]).count() == 0


def test_plain_slices_match_their_rule(spark):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(ODD) if t], "id int, text string")
    for (i,), spans in places(df, ["id"]).items():
        for name, start, end in spans:
            if name in {r.name for r in ALL_RULES} and name not in ("aws_secret", "json_secret", "kv_secret", "db_uri"):
                flags = re.IGNORECASE if rule(name).ignore_case else 0
                assert re.fullmatch(rule(name).pattern, ODD[i][start:end], flags)


def test_region_of_the_row_and_clashing_names(spark):
    df = spark.createDataFrame(
        [(1, "FR", "tel 06 12 34 56 78", "x"), (2, "US", "tel 06 12 34 56 78", "y")], "id int, rule string, text string, f string"
    )
    rows = spans_table(df.withColumnRenamed("rule", "region"), ["id"], region=F.col("region")).collect()
    assert [(r.id, r.rule, r.span_start) for r in rows] == [(1, "phone", 4)]


def test_running_sums(spark):
    for n in (0, 1, 255, 256, 257, 1000):
        got = spark.range(1).select(running(F.lit([i % 7 for i in range(n)]) if n else F.array().cast("array<int>")).alias("r")).first().r
        assert got == [sum(j % 7 for j in range(i)) for i in range(n)]


def test_stays_in_the_row(spark):
    plan = spans_table(corpus(spark, SF), ["id"])._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Window" not in plan and "SortMergeJoin" not in plan
