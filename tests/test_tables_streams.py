import json
import random
import time

import pandas as pd
import pytest
from pyspark.sql import functions as F

from veilspark.functions.pii import redact_pii
from veilspark.functions.sanitize import sanitize_text
from veilspark.operators.report import publishable, redaction_report, token_report
from veilspark.operators.runs import find_runs
from veilspark.operators.sanitize import apply_rewrites, process_table
from veilspark.operators.tables import censor_by_lexicon, find_by_lexicon, flag_by_lexicon, latest_per_source, sanitize_conversations, sanitize_turns
from veilspark.sources.texts import load_texts, new_dir, nonblank, write_texts
from veilspark.streaming import jobs as S
from veilspark.streaming.collapse import _advanced, collapse_event_stream, read_event_runs
from veilspark.streaming.sinks import merge_folders, newest, read_updates, saved


def test_sources_and_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, "a@b.com", "en"), (2, " ", "fr")], "doc long, body string, lang string")
    for fmt in ("parquet", "json", "orc"):
        path = str(tmp_path / fmt)
        write_texts(df, path, fmt)
        read = load_texts(spark, path, text="body", id="doc", fmt=fmt, keep=("lang",))
        assert read.columns == ["id", "text", "lang"] and read.count() == 2
        assert nonblank(read).count() == 1
    (tmp_path / "one.txt").write_text("l1\nl2\n")
    assert load_texts(spark, str(tmp_path / "one.txt"), fmt="text").first().text == "l1\nl2\n"
    write_texts(df, str(tmp_path / "parts"), partition_by=("lang",), compact=True)
    assert {p.name for p in (tmp_path / "parts").glob("lang=*")} == {"lang=en", "lang=fr"}


def test_shared_dir_comes_from_the_session(spark):
    assert new_dir(spark, "x").startswith(spark.conf.get("spark.checkpoint.dir"))


def test_latest_per_source(spark):
    rows = [("hot", i, f"t{i}") for i in range(300)] + [("cold", 5, "c")]
    got = latest_per_source(spark.createDataFrame(rows, "source string, seq long, text string"), "source", ["seq"]).collect()
    assert sorted((r.source, r.text) for r in got) == [("cold", "c"), ("hot", "t299")]


def test_conversations_are_whole(spark):
    turns = [(1, i, "user" if i % 2 else "bot", f"m{i} a@b.com") for i in range(50)]
    random.Random(1).shuffle(turns)
    df = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string")
    rows = sanitize_conversations(df, segment_turns=8).orderBy("segment").collect()
    assert [r.n_turns for r in rows] == [8] * 6 + [2]
    joined = "\n".join(r.transcript for r in rows).split("\n")
    assert joined == [f"{'user' if i % 2 else 'bot'}: m{i} [REDACTED_EMAIL]" for i in range(50)]


def test_flag_by_lexicon(spark):
    docs = spark.createDataFrame([(1, "so DARN bad"), (2, "fine"), (3, "d4rn"), (4, None)], "id int, text string")
    terms = spark.createDataFrame([("darn",), ("drat",), ("darn",)], "term string")
    got = {r.id: r.flagged for r in flag_by_lexicon(docs, ["id"], terms).collect()}
    assert got == {1: True, 2: False, 3: True, 4: False}


def _write_batches(spark, path, batches, schema):
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(path)


def _stream(spark, path):
    return spark.readStream.schema(spark.read.parquet(path).schema).option("maxFilesPerTrigger", 1).parquet(path)


def test_stream_sanitize_equals_batch(spark, tmp_path):
    path, out = str(tmp_path / "in"), str(tmp_path / "out")
    _write_batches(spark, path, [[(i, f"u{i}@x.org") for i in range(b, b + 5)] for b in (0, 5, 10)], "id int, text string")
    S.sanitize_stream(_stream(spark, path), out, str(tmp_path / "cp")).awaitTermination()
    batch = spark.read.parquet(path).select("id", sanitize_text(F.col("text")).alias("sanitized_text"))
    assert sorted(spark.read.parquet(out).select("id", "sanitized_text").collect()) == sorted(batch.collect())
    S.sanitize_stream(_stream(spark, path), out, str(tmp_path / "cp")).awaitTermination()
    assert spark.read.parquet(out).count() == 15


def test_stream_collapse_joins_runs_across_batches(spark, tmp_path):
    rng = random.Random(2)
    rows = [(rng.choice(["hot", "hot", "hot", "cold"]), i, rng.choice(["a", "a", "b"])) for i in range(120)]
    path, out = str(tmp_path / "in"), str(tmp_path / "out")
    _write_batches(spark, path, [rows[i : i + 24] for i in range(0, 120, 24)], "source string, seq long, line string")

    def start():
        S.collapse_stream(
            _stream(spark, path), out, str(tmp_path / "cp"), ["source"], ["seq"], "line", F.floor(F.col("seq") / 7)
        ).awaitTermination()

    start()
    whole = find_runs(spark.read.parquet(path), ["source"], ["seq"], "line", F.lit(0))
    pick = ["source", F.col("first.seq").alias("a"), F.col("last.seq").alias("b"), "line", "n"]
    expected = sorted(tuple(r) for r in whole.select(*pick).collect())
    assert sorted(tuple(r) for r in S.read_collapsed(spark, out).select(*pick).collect()) == expected
    # A source that stays silent keeps its open run through later batches.
    spark.createDataFrame([("hot", 500, "zz")], "source string, seq long, line string").coalesce(1).write.mode("append").parquet(path)
    start()
    assert S.read_collapsed(spark, out).agg(F.sum("n")).first()[0] == 121


def test_stream_windows_and_latest(spark, tmp_path):
    path = str(tmp_path / "in")
    rows = [(i, i * 600, "s1" if i % 3 else "s2", f"m{i}@x.org and 12:00:0{i % 10}") for i in range(24)]
    _write_batches(spark, path, [rows[:8], rows[8:16], rows[16:]], "id int, sec long, source string, text string")
    stream = _stream(spark, path).withColumn("ts", F.timestamp_seconds("sec"))
    out = str(tmp_path / "w")
    S.marker_count_stream(stream, out, out + "cp").awaitTermination()
    got = read_updates(spark, out, ["window_start", "window_end", "source", "rule"])
    assert got.agg(F.sum("n")).first()[0] == 48
    assert got.where("rule = 'email'").groupBy("window_start").agg(F.sum("n").alias("n")).collect()[0].n == 6
    out = str(tmp_path / "l")
    S.latest_stream(stream.select("id", "ts", "source", "text"), out, out + "cp", ["ts", "id"]).awaitTermination()
    latest = {r.source: r.id for r in read_updates(spark, out, ["source"], ["ts", "id"]).collect()}
    assert latest == {"s1": 23, "s2": 21}


def test_null_sources_and_keys(spark):
    rows = [("a", 1, "x"), ("a", 2, "y"), (None, 1, "old"), (None, 3, "new")]
    df = spark.createDataFrame(rows, "source string, at int, text string")
    assert {tuple(r) for r in latest_per_source(df, "source", ["at"]).collect()} == {("a", 2, "y"), (None, 3, "new")}
    lexicon = spark.createDataFrame([("New",)], "term string")
    flags = flag_by_lexicon(df, ["source", "at"], lexicon).collect()
    assert {(r.source, r.at) for r in flags if r.flagged} == {(None, 3)} and len(flags) == 4


def test_several_replies(spark):
    text = "one line of the log\nand another line of the log that stays"
    docs = spark.createDataFrame([(1, text)], "id int, stage1_text string")
    good = text.replace("another ", "")
    replies = spark.createDataFrame([(1, json.dumps({"response": good}), 2), (1, json.dumps({"response": "zz"}), 1)], "id int, reply string, no int")
    row = apply_rewrites(docs, replies, ["id"], order="no").first()
    assert row.is_distilled and row.distilled_text == good
    with pytest.raises(Exception, match="several replies"):
        apply_rewrites(docs, replies, ["id"]).collect()
    record = process_table(docs.withColumnRenamed("stage1_text", "text"), ["id"], rewrites=replies, order="no", diff=False).first()
    assert record.is_distilled and record.sanitized_text == good
    unnamed = apply_rewrites(docs.withColumn("id", F.lit(None).cast("int")), replies.withColumn("id", F.lit(None).cast("int")), ["id"], order="no")
    assert unnamed.first().is_distilled


def test_lexicon_censors_every_word_it_has(spark):
    docs = spark.createDataFrame([(1, "So DARN bad, d4rn"), (None, "drat it"), (3, None), (4, "")], "id int, text string")
    terms = spark.createDataFrame([("darn",), ("drat",), ("unused",)], "term string")
    got = {r.id: r.text for r in censor_by_lexicon(docs, ["id"], terms).collect()}
    assert got == {1: "So D*** bad, d***", None: "d*** it", 3: None, 4: ""}


def test_terms_of_several_words(spark):
    rows = [(1, "Old  SCUM, bag and scúm-bag"), (2, "bag scum"), (3, None), (4, "scum bag"), (5, "a b c a b"), (6, "")]
    docs = spark.createDataFrame(rows, "id int, text string")
    terms = [("scum bag", "insult", 2), ("Old", "age", 1), ("a b c", "abc", 3), ("b", "b", 1), ("!!", "none", 1), ("b c a b x y", "", 0)]
    lexicon = spark.createDataFrame(terms, "term string, category string, severity int")
    with pytest.raises(Exception, match="more than 3 words"):
        find_by_lexicon(docs, ["id"], lexicon).collect()
    lexicon = lexicon.where("severity > 0")
    got = {(r.id, r.pos, r.n_words, r.term, r.category, r.severity) for r in find_by_lexicon(docs, ["id"], lexicon).collect()}
    assert got == {
        (1, 1, 1, "old", "age", 1), (1, 2, 2, "scum bag", "insult", 2), (1, 5, 2, "scum bag", "insult", 2),
        (4, 1, 2, "scum bag", "insult", 2), (5, 1, 3, "a b c", "abc", 3), (5, 2, 1, "b", "b", 1), (5, 5, 1, "b", "b", 1),
    }
    flags = {r.id: r.flagged for r in flag_by_lexicon(docs, ["id"], lexicon, longest=3).collect()}
    assert flags == {1: True, 2: False, 3: False, 4: True, 5: True, 6: False}
    clean = {r.id: r.text for r in censor_by_lexicon(docs, ["id"], lexicon, longest=3).collect()}
    assert clean == {1: "O**  S***, b** and s***-b**", 2: "bag scum", 3: None, 4: "s*** b**", 5: "a b c a b", 6: ""}


def test_turns_of_long_conversations_stay(spark):
    turns = [(c, i, "user", f"m{i} a@b.com") for c in (1, None) for i in (0, 100_000, 1 << 40)]
    df = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string")
    got = sanitize_turns(df).collect()
    assert len(got) == 6 and {(r.conv_id, r.turn) for r in got} == {t[:2] for t in turns}
    assert all(r.text.endswith(" [REDACTED_EMAIL]") for r in got)


def test_reports_tell_subtotals_from_nulls(spark):
    rows = [("ALL", "m <TIME>"), ("", "m <TIME>"), (None, "<TIME> <TIME>")]
    df = spark.createDataFrame(rows, "source string, sanitized_text string")
    got = {(r.source, r.source_total): (r.n_docs, r.n_findings) for r in redaction_report(df, ["source"]).where("rule = 'ALL'").collect()}
    assert got == {("ALL", False): (1, 1), ("", False): (1, 1), (None, False): (1, 2), (None, True): (3, 4)}
    stats = F.struct(
        F.lit(4).cast("long").alias("raw_tokens"), F.lit(1).cast("long").alias("saved_tokens"), F.lit(25.0).alias("reduction_percent")
    )
    report = token_report(df.withColumn("token_stats", stats), "source").collect()
    assert {(r.source, r.source_total): r.n_docs for r in report} == {("ALL", False): 1, ("", False): 1, (None, False): 1, (None, True): 3}


def test_gate_refuses_and_keeps(spark):
    df = spark.createDataFrame([(1, "mail a@b.com"), (2, "plain")], "id int, text string")
    assert [r.id for r in publishable(df, clean="text").collect()] == [2]


def test_requests_hold_cleaned_text(spark):
    from veilspark.plans.queries import chat_rows, prompt_rows

    sf = "/root/testdata/sf0.001"
    for rows, column in ((prompt_rows(spark, sf), "prompt"), (chat_rows(spark, sf), "text")):
        assert rows.count() > 0
        assert rows.where(redact_pii(F.col(column)) != F.col(column)).count() == 0


def test_texts_need_an_id(spark, tmp_path):
    spark.createDataFrame([("x",)], "text string").write.parquet(str(tmp_path / "t"))
    with pytest.raises(ValueError):
        load_texts(spark, str(tmp_path / "t"))
    with pytest.raises(ValueError):
        load_texts(spark, str(tmp_path / "t"), fmt="text", keep=("lang",))


def _event_runs(spark, rows):
    """Runs of the whole by a batch job, for the same gap."""
    df = spark.createDataFrame(rows, "source string, s long, id long, line string").withColumn("ts", F.timestamp_seconds("s"))
    runs = find_runs(df, ["source"], ["ts", "id"], "line", F.lit(0), time="ts", gap="10 minutes")
    return sorted((str(r.source), r.first.id, r.last.id, str(r.line), r.n) for r in runs.collect())


def test_event_runs_equal_the_batch_result(spark, tmp_path):
    """Runs span batches; rows come out of order and twice; a silent source is closed by its timer."""
    rng = random.Random(12)
    rows = [(rng.choice(["hot", "hot", None]), i * 20 + rng.randrange(20), i, rng.choice(["a", "a", "a", "b", None])) for i in range(160)]
    rows = [r for r in rows if not 1200 < r[1] < 2200] + [("silent", 100, 900, "x"), ("silent", 130, 901, "x")]
    rows.sort(key=lambda r: r[1])
    batches = [rows[i : i + 20] for i in range(0, len(rows), 20)]
    for batch in batches:
        rng.shuffle(batch)
    mixed = [list(b) for b in batches]
    mixed[2].append(batches[1][0])  # replayed within the delay or after it: either way without effect
    mixed[-1] += batches[-1][:3]
    # A row moved one batch on is still in time: 20 rows span less than the delay.
    mixed[4].append(mixed[3].pop())
    path, out, cp = (str(tmp_path / x) for x in ("in", "out", "cp"))
    schema = "source string, s long, id long, line string"

    def start():
        stream = _stream(spark, path).withColumn("ts", F.timestamp_seconds("s"))
        query = collapse_event_stream(stream, out, cp, ["source"], "ts", ["id"], "line", delay="10 minutes", gap="10 minutes")
        query.awaitTermination()
        return sum(op["numRowsDroppedByWatermark"] for p in query.recentProgress for op in p["stateOperators"])

    _write_batches(spark, path, mixed[:5], schema)
    start()
    runs = read_event_runs(spark, out, ["source"], "ts")
    part = [r for b in mixed[:5] for r in b]
    got = sorted((str(r.source), r.first_id, r.last_id, str(r.line), r.n) for r in runs.collect())
    assert got == _event_runs(spark, list(dict.fromkeys(part)))
    _write_batches(spark, path, mixed[5:], schema)
    start()
    runs = read_event_runs(spark, out, ["source"], "ts").collect()
    got = sorted((str(r.source), r.first_id, r.last_id, str(r.line), r.n) for r in runs)
    assert got == _event_runs(spark, list(dict.fromkeys(r for b in mixed for r in b)))
    assert [(r.n, r.closed) for r in runs if r.source == "silent"] == [(2, True)]
    _write_batches(spark, path, [[("hot", 1, 5000, "late"), ("silent", 2, 5001, "late"), ("new", 3, 5002, "late")]], schema)
    assert start() == 3
    again = read_event_runs(spark, out, ["source"], "ts").collect()
    assert sorted(map(str, again)) == sorted(map(str, runs))


class _State:
    """The state of one source, before its first micro-batch."""

    exists, hasTimedOut = False, False

    def getCurrentWatermarkMs(self):
        return 0

    def update(self, value):
        self.value = value

    def setTimeoutTimestamp(self, at):
        self.at = at


def test_a_source_of_the_event_stream_costs_little():
    """A micro-batch has many sources of a few rows each."""
    batch = pd.DataFrame({"us": [3, 1, 2, 2], "id": [7, 5, 6, 6], "line": ["a", "b", "a", "z"]})
    began = time.process_time()
    for source in range(500):
        out = next(_advanced((source,), iter([batch]), _State(), ["source"], ["id"], 10))
    assert time.process_time() - began < 1.5
    assert out.drop(columns=["source", "closed"]).values.tolist() == [[1, 1, 5, 5, "b", 1], [2, 3, 6, 7, "a", 2]]


def test_sinks_keep_few_folders(spark, tmp_path):
    """Many micro-batches, a death in the middle of a merge, replays: the same rows, and few folders."""
    out, rng, want = str(tmp_path / "sink"), random.Random(3), {}

    def folders():
        return [p.name for p in (tmp_path / "sink").rglob("*=*")]

    def rows_of(number):
        draw = random.Random(number)
        return [(draw.randrange(9), draw.randrange(1000), f"b{number}-{i}") for i in range(4)]

    def save(number):
        df = spark.createDataFrame(rows_of(number), "k int, at int, v string").coalesce(1)
        saved(df.groupBy("k").agg(F.max(F.struct("at", "v")).alias("x")).select("k", "x.*"), number, out, ["k"], ["at"], 4)

    for number in range(30):
        save(number)
        for k, at, v in rows_of(number):
            want[k] = max(want.get(k, (-1, -1, "")), (at, number, v))
        if number in (6, 7, 19):  # a replay, also of a batch that has just been merged
            save(number)
        if number == 13:  # a merge that died: its folder is not complete
            (tmp_path / "sink" / "_merged" / "upto=13").mkdir()
            (tmp_path / "sink" / "_merged" / "upto=13" / "part-0.parquet").write_bytes(b"broken")
        assert len(folders()) <= 2 * 4 + 3
    got = {r.k: (r.at, r.v) for r in read_updates(spark, out, ["k"], ["at"]).collect()}
    assert got == {k: (at, v) for k, (at, _, v) in want.items()}
    merge_folders(spark, out, 29, lambda rows: newest(rows, ["k"], ["at"]))
    merge_folders(spark, out, 29, lambda rows: newest(rows, ["k"], ["at"]))
    assert {r.k: (r.at, r.v) for r in read_updates(spark, out, ["k"], ["at"]).collect()} == got
    with pytest.raises(ValueError):
        read_updates(spark, str(tmp_path / "none"), ["k"])
