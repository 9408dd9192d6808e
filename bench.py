"""Time the headline queries and print one JSON line.

``BENCH_SF_DIR`` names the tables, ``BENCH_CPUS`` the cores of the local session.
"""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from pyspark.sql import SparkSession  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402

from veilspark.plans.corpus import corpus  # noqa: E402
from veilspark.plans.queries import QUERIES  # noqa: E402

HEADLINE = [
    "clean_stage1",
    "redact_pii",
    "profanity_censor",
    "sanitize_full",
    "token_stats",
    "diff_lines",
    "sanitize_pipeline",
    "findings",
    "redaction_report",
    "token_report",
    "publishable",
    "noisiest_docs",
    "collapse_rows",
    "prune_rows",
    "sanitize_conversations",
    "latest_per_source",
    "stream_sanitize",
    "stream_collapse",
    "stream_marker_counts",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("bench")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", os.environ.get("BENCH_MEMORY", "12g"))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        # Recording a call site for every expression costs more than planning does.
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("OFF")
    texts, size = corpus(spark, sf_dir).agg(F.count(F.lit(1)), F.sum(F.octet_length("text"))).first()

    # Load classes and compile the hot paths before anything is timed.
    for _ in range(2):
        QUERIES["sanitize_full"](spark, sf_dir).write.format("noop").mode("overwrite").save()

    names = [n for n in os.environ.get("BENCH_QUERIES", "").split(",") if n] or HEADLINE
    repeats = int(os.environ.get("BENCH_REPEATS", "2"))
    seconds: dict[str, float] = {}
    for name in names:
        best = None
        for _ in range(repeats):
            start = time.perf_counter()
            QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            took = time.perf_counter() - start
            best = took if best is None else min(best, took)
        seconds[name] = round(best, 3)
        print(f"{name:24s} {best:.2f}s", file=sys.stderr, flush=True)

    full = seconds.get("sanitize_full")
    result = {
        "metric": "total_seconds",
        "value": round(sum(seconds.values()), 3),
        "unit": "sec",
        "queries": seconds,
        "sf": Path(sf_dir).name.removeprefix("sf"),
        "texts": texts,
        "text_mb": round(size / 1e6, 1),
        "sanitize_full_texts_per_sec": round(texts / full) if full else None,
        "sanitize_full_mb_per_sec": round(size / 1e6 / full, 1) if full else None,
        "sanitize_full_core_ms_per_text": round(full * int(cpus) * 1000 / texts, 3) if full else None,
    }
    print(json.dumps(result))
    spark.stop()


if __name__ == "__main__":
    main()
