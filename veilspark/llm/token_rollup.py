"""Token counts by source, language and tokenizer version, kept up to date by signed deltas.

Every change of a document becomes signed counts: an insert adds, a delete subtracts, a revision does
both. A batch of changes is summed by key and committed as one Parquet folder named after the batch;
committing a batch again replaces that folder, so a retried or repeated batch counts once. Totals are
the sums of all folders, and compaction folds folders into one without changing them.
"""

from __future__ import annotations

import base64
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

KEYS = ["source", "lang", "tokenizer"]
MEASURES = ["documents", "tokens"]
SCHEMA = "source string, lang string, tokenizer string, documents bigint, tokens bigint"

#: Fixed value: the split pattern that belongs to the byte-level vocabulary files.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"""
#: A text is encoded in stretches of about this many characters that end before a space.
STRETCH = 1 << 16


def _encoding(ranks: dict[bytes, int], pattern: str):
    import tiktoken

    return tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def _stretches(text: str) -> Iterator[str]:
    """Cuts a long text between a character and one space before a letter, where no token crosses."""
    import regex

    at = 0
    for cut in regex.finditer(r"(?<=[^\s]) (?=\p{L})", text) if len(text) > STRETCH else ():
        if cut.start() - at >= STRETCH:
            yield text[at : cut.start()]
            at = cut.start()
    yield text[at:]


def count_tokens(docs: DataFrame, vocabulary: str, text: str = "text", pattern: str = PATTERN) -> DataFrame:
    """``docs`` with a column ``tokens`` in place of the text: its number of byte-level BPE tokens.

    ``vocabulary`` is a file of base64 tokens and ranks that Spark can read; it is bounded (some 50,000
    lines). A null or empty text has no tokens. Other columns pass through.
    """
    lines = docs.sparkSession.read.text(vocabulary).where("value <> ''").collect()
    ranks = {base64.b64decode(a): int(b) for a, b in (r["value"].split() for r in lines)}
    packed = docs.sparkSession.sparkContext.broadcast(ranks)
    others = [c for c in docs.columns if c != text]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoding = _encoding(packed.value, pattern)
        for batch in batches:
            counts = [
                sum(len(encoding.encode_ordinary(s)) for s in _stretches(t.as_py())) if t.is_valid else 0
                for t in batch.column(text)
            ]
            yield pa.record_batch([*(batch.column(c) for c in others), pa.array(counts, pa.int64())], [*others, "tokens"])

    kinds = dict(docs.dtypes)
    schema = ", ".join([f"`{c}` {kinds[c]}" for c in others] + ["tokens bigint"])
    return docs.select(*others, F.col(text).cast("string").alias(text)).mapInArrow(run, schema)


def signed(counted: DataFrame, sign: int, tokenizer: str) -> DataFrame:
    """Deltas of documents that come (1) or go (-1): rows (source, lang, tokens) become signed counts."""
    return counted.select(
        F.col("source").cast("string").alias("source"),
        F.col("lang").cast("string").alias("lang"),
        F.lit(tokenizer).alias("tokenizer"),
        F.lit(sign).cast("bigint").alias("documents"),
        (F.coalesce("tokens", F.lit(0)) * sign).cast("bigint").alias("tokens"),
    )


def revised(before: DataFrame, after: DataFrame, tokenizer: str) -> DataFrame:
    """Deltas of documents whose counts, source or language change: the old rows go, the new ones come."""
    return signed(before, -1, tokenizer).unionByName(signed(after, 1, tokenizer))


class Rollup:
    """Totals in a folder that all executors share. Null keys are keys of their own."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _summed(self, df: DataFrame) -> DataFrame:
        sums = df.groupBy(*KEYS).agg(*[F.sum(m).alias(m) for m in MEASURES])
        return sums.where(" OR ".join(f"{m} <> 0" for m in MEASURES))

    def _folder(self, batch: str) -> str:
        if not batch.replace("-", "").replace("_", "").isalnum():
            raise ValueError("a batch is named by letters, digits, - and _")
        return f"{self.path}/deltas/batch={batch}"

    def commit(self, batch: str, deltas: DataFrame) -> None:
        """Sum the batch's deltas and make them count, once, however often the batch is committed."""
        self._summed(deltas).withColumn("folded", F.lit(None).cast("string")).write.mode("overwrite").parquet(self._folder(batch))

    def _batches(self) -> DataFrame:
        try:
            read = self.spark.read.schema(f"{SCHEMA}, folded string, batch string").parquet(f"{self.path}/deltas")
        except Exception as missing:
            if "PATH_NOT_FOUND" not in str(missing):
                raise
            return self.spark.createDataFrame([], f"{SCHEMA}, folded string, batch string")
        # A folder that a compaction has folded counts no more.
        done = read.where("folded IS NOT NULL").select(F.explode(F.split("folded", ",")).alias("gone")).distinct()
        return read.join(F.broadcast(done), read["batch"] == done["gone"], "left_anti")

    def totals(self) -> DataFrame:
        """source, lang, tokenizer, documents, tokens; keys whose counts are all zero are left out."""
        return self._summed(self._batches().drop("folded", "batch"))

    def compact(self, name: str) -> None:
        """Fold all batches into the new folder ``name``; committing a folded batch again has no effect."""
        live = self._batches()
        names = sorted(r["batch"] for r in live.select("batch").distinct().collect())
        if names:
            mark = zlib.crc32(",".join(names).encode())
            self._summed(live).withColumn("folded", F.lit(",".join(names))).write.mode("error").parquet(
                self._folder(f"{name}-{mark:08x}")
            )
