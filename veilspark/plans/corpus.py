"""The supplied tables as one corpus of texts, and log lines and replies derived from them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from veilspark.sources.texts import spread

# Valid in Spark SQL and in DuckDB: one log text per event, 32 kinds that reach every rule.
LOGS_SQL = """
SELECT event_id, ts, event_type AS source, event_id % 32 AS kind,
  CASE event_id % 32
    WHEN 0 THEN concat(chr(27), '[31mERROR', chr(27), '[0m user ', u)
    WHEN 1 THEN concat('-----BEGIN PRIVATE KEY-----', chr(10), h, chr(10), '-----END PRIVATE KEY-----')
    WHEN 2 THEN concat('-----BEGIN RSA PRIVATE KEY-----', chr(10), h, chr(10), '-----END RSA PRIVATE KEY-----')
    WHEN 3 THEN concat('key sk-proj-', h)
    WHEN 4 THEN concat('key sk-ant-', substr(h, 1, 12))
    WHEN 5 THEN concat('id AKIA', upper(substr(h, 1, 16)))
    WHEN 6 THEN concat('aws_secret_access_key = "', substr(concat(h, g), 1, 40), '"')
    WHEN 7 THEN concat('git ghp_', substr(concat(h, g), 1, 36))
    WHEN 8 THEN concat('Authorization: bearer ', h)
    WHEN 9 THEN concat('https://hooks.slack.com/services/T', upper(substr(h, 1, 8)), '/B', upper(substr(g, 1, 8)), '/', substr(h, 9, 24))
    WHEN 10 THEN concat('xoxb-', substr(h, 1, 24))
    WHEN 11 THEN concat('sk_live_', substr(h, 1, 24))
    WHEN 12 THEN concat('sid SK', h)
    WHEN 13 THEN concat('SG.', substr(h, 1, 22), '.', substr(concat(h, g), 1, 43))
    WHEN 14 THEN concat('AIza', substr(concat(h, g), 1, 35))
    WHEN 15 THEN concat('npm_', substr(concat(h, g), 1, 36))
    WHEN 16 THEN concat('DefaultEndpointsProtocol=https;AccountName=acct;AccountKey=', h)
    WHEN 17 THEN concat('{"password": "', h, '"}')
    WHEN 18 THEN concat('login password=', substr(h, 1, 12), ' ok')
    WHEN 19 THEN concat('postgres://u', u, ':', substr(h, 1, 10), '@db.internal:5432/prod')
    WHEN 20 THEN concat('data:image/png;base64,', h, g, '==')
    WHEN 21 THEN concat('eyJ', h, '.eyJ', g, '.', h)
    WHEN 22 THEN concat('build cache entry Qw7Lr2Vx9Tn4Bz6Hc1Yp8Gd3Ks5Mf0Ja', e)
    WHEN 23 THEN concat('token = "', substr(concat(h, g), 1, 40), '"')
    WHEN 24 THEN concat('2031-05-09T07:11:02Z worker stopped at 0x', substr(h, 1, 12), ' while reading')
    WHEN 25 THEN concat('12:34:56.789 tick ', e)
    WHEN 26 THEN concat('SSN 123-45-', lpad(CAST(event_id % 10000 AS string), 4, '0'))
    WHEN 27 THEN concat('mail u', u, '@example.com and a..b@example.com')
    WHEN 28 THEN concat('card 4024007130551186 ref 7701234567890019 n', e)
    WHEN 29 THEN 'iban GB82WEST12345698765432 bad GB82WEST12345698765433'
    WHEN 30 THEN concat('tel 06 12 34 56 78, intl +33 6 12 34 56 78, bad 0000000000 n', e, ' what a bastard, s h i t and bullshitter, call +81 90 1234 5678 or +48 512 345 678')
    ELSE concat('Error ', e, chr(10), 'retry', chr(10), 'retry', chr(10), '    at f (node_modules/a/b.js:1:2)', chr(10),
                '    at g (node_modules/a/c.js:3:4)', chr(10), 'done', chr(10),
                CASE WHEN event_id % 64 = 31 THEN concat('retry', chr(10)) ELSE '' END)
  END AS text
FROM (SELECT *, CAST(event_id AS string) AS e, CAST(user_id AS string) AS u,
             md5(CAST(event_id AS string)) AS h, md5(concat('b', CAST(user_id AS string))) AS g FROM events)
"""

CORPUS_SQL = """
SELECT 'documents' AS corpus, doc_id AS id, 0::BIGINT AS part, source, lang, text FROM documents
UNION ALL SELECT 'pages', page_id, 0, 'web', 'html', html FROM pages
UNION ALL SELECT 'conversations', conv_id, turn, role, 'chat', text FROM conversations
UNION ALL SELECT 'logs', event_id, 0, source, 'log', text FROM logs
"""

# A reply for every document: fenced text, chat form, too short a text, a fallback, a failure.
# Also valid in both engines; chr(92) is the backslash, which the two quote differently.
REPLY_SQL = """
CASE doc_id % 5
  WHEN 0 THEN concat('{"response":"```text', chr(92), 'n', body, ' mail me at a.b@example.com', chr(92), 'n```"}')
  WHEN 1 THEN concat('{"choices":[{"message":{"content":"', body, '"}}]}')
  WHEN 2 THEN '{"response":"too short"}'
  WHEN 3 THEN concat('{"response":"  ","choices":[{"message":{"content":" ```x ', body, '``` "}}]}')
  ELSE '{"error":"busy"}'
END
"""
REPLY_BODY_SQL = """
replace(replace(replace(text, chr(92), ' '), chr(34), ' '), chr(10), concat(chr(92), 'n'))
"""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def texts(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table whose texts are about to be cleaned."""
    return spread(table(spark, sf_dir, name))


def logs_from(events: DataFrame) -> DataFrame:
    """Log texts (event_id, ts, source, kind, text) for a table or stream of events."""
    head, _, _ = LOGS_SQL.partition("FROM (SELECT *")
    text = head[head.index("CASE event_id"): head.rindex(" AS text")]
    number, user = F.col("event_id").cast("string"), F.col("user_id").cast("string")
    hashed = events.withColumns(
        {"e": number, "u": user, "h": F.md5(number), "g": F.md5(F.concat(F.lit("b"), user))}
    )
    return hashed.select(
        "event_id", "ts", F.col("event_type").alias("source"), (F.col("event_id") % 32).alias("kind"),
        F.expr(text).alias("text"),
    )


def logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return logs_from(texts(spark, sf_dir, "events"))


def corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All texts as (corpus, id, part, source, lang, text); part is the turn of a conversation, else 0."""
    c, lit = F.col, F.lit

    def some(df: DataFrame, name: str, id: str, source: Column, lang: Column, text: str, part: Column = lit(0)) -> DataFrame:
        return df.select(
            lit(name).alias("corpus"), c(id).alias("id"), part.cast("bigint").alias("part"),
            source.alias("source"), lang.alias("lang"), c(text).alias("text"),
        )

    return (
        some(texts(spark, sf_dir, "documents"), "documents", "doc_id", c("source"), c("lang"), "text")
        .unionByName(some(texts(spark, sf_dir, "pages"), "pages", "page_id", lit("web"), lit("html"), "html"))
        .unionByName(some(texts(spark, sf_dir, "conversations"), "conversations", "conv_id", c("role"), lit("chat"), "text", c("turn")))
        .unionByName(some(logs(spark, sf_dir), "logs", "event_id", c("source"), lit("log"), "text"))
    )


def replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, reply): a JSON reply for every document."""
    bodies = table(spark, sf_dir, "documents").select("doc_id", F.expr(REPLY_BODY_SQL).alias("body"))
    return bodies.select("doc_id", F.expr(REPLY_SQL).alias("reply"))
