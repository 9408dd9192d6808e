"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilspark.llm.backoff_lm import backoff_scores
from veilspark.llm.collocations import collocations
from veilspark.llm.decontaminate import benchmark_leaks
from veilspark.llm.exact_dedup import exact_groups
from veilspark.llm.fim import fill_in_middle, restored
from veilspark.llm.langid import detect_language
from veilspark.llm.licenses import scan_licenses
from veilspark.llm.mixing import WORD, mix
from veilspark.llm.near_dedup import near_groups
from veilspark.llm.quality import quality_weights
from veilspark.llm.storage import new_path, written
from veilspark.llm.substring_dedup import remove_repeats
from veilspark.llm.token_rollup import Rollup, count_tokens, signed
from veilspark.llm.toxicity import toxicity

#: The vocabulary that op2 counts with.
VOCABULARY = "file:///opt/tokenizers/byte_bpe_50k.tiktoken"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_groups(table(spark, sf_dir, "documents"))


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals of all documents after a history of batches, under a BPE vocabulary and under plain words.

    All documents come without a language and, for words, with an estimate; labelled ones come twice. Then their
    languages and counts are revised and the second copies deleted, the first batch is repeated, batches are folded
    and a folded one is repeated. The totals are those of one count over all documents.
    """
    docs = table(spark, sf_dir, "documents").select(
        "doc_id", "source", "lang", "text",
        F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).alias("words"),
        F.ceil(F.coalesce(F.char_length("text"), F.lit(0)) / 6).alias("guess"),
    )
    counted = written(count_tokens(docs, VOCABULARY), "counted")
    extra = counted.join(table(spark, sf_dir, "labels").select("doc_id").distinct(), "doc_id", "left_semi")

    def rows(df: DataFrame, tokens: str, known: bool) -> DataFrame:
        lang = F.col("lang") if known else F.lit(None)
        return df.select("source", lang.cast("string").alias("lang"), F.col(tokens).alias("tokens"))

    def deltas(df: DataFrame, sign: int, guessed: bool) -> DataFrame:
        bpe = signed(rows(df, "tokens", not guessed), sign, "byte_bpe_50k")
        return bpe.unionByName(signed(rows(df, "guess" if guessed else "words", not guessed), sign, "words"))

    rollup = Rollup(spark, new_path(spark, "rollup"))
    rollup.commit("insert-1", deltas(counted, 1, True))
    rollup.commit("insert-2", deltas(extra, 1, True))
    rollup.commit("revise-1", deltas(counted, -1, True).unionByName(deltas(counted, 1, False)))
    rollup.commit("insert-1", deltas(counted, 1, True))
    rollup.compact("folded")
    rollup.commit("delete-1", deltas(extra, -1, True))
    rollup.commit("revise-1", deltas(counted, -1, True).unionByName(deltas(counted, 1, False)))
    return rollup.totals()


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return benchmark_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents"), width=20).select(
        "doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256")
    )


def op5_backoff_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return backoff_scores(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", F.round("score", 4).alias("score")
    )


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents")).drop("source")


def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(table(spark, sf_dir, "documents"))


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_groups(table(spark, sf_dir, "documents")).withColumnRenamed("digest", "text_sha256")


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    weights = quality_weights(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return weights.select("doc_id", "n_grams", "score", "weight", "kept")


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2
    return detect_language(table(spark, sf_dir, "documents"), held_out)


def op11_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), held_out)


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(table(spark, sf_dir, "documents"))


def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fill_in_middle(table(spark, sf_dir, "documents")).select(
        "doc_id",
        "n",
        "form",
        "prefix_chars",
        "middle_chars",
        F.sha2("output", 256).alias("output_sha256"),
        F.sha2(restored(F.col("output"), F.col("form")), 256).alias("restored_sha256"),
    )


QUERIES = {
    "op1_minhash_dedup": op1_minhash_dedup,
    "op2_token_counts": op2_token_counts,
    "op3_decontamination": op3_decontamination,
    "op4_substring_dedup": op4_substring_dedup,
    "op5_backoff_lm": op5_backoff_lm,
    "op6_mixing": op6_mixing,
    "op7_license_scan": op7_license_scan,
    "op8_exact_dedup": op8_exact_dedup,
    "op9_quality": op9_quality,
    "op10_language_id": op10_language_id,
    "op11_toxicity": op11_toxicity,
    "op12_collocations": op12_collocations,
    "op13_fill_in_middle": op13_fill_in_middle,
}

WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

ORACLE = {
    "op4_substring_dedup": f"""
        WITH d AS (SELECT doc_id, {WORDS} AS w FROM documents),
        s AS (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 18, 1))) AS p FROM d),
        k AS (SELECT doc_id, p, sha256(array_to_string(w[p:p + 19], ' ')) AS h FROM s),
        later AS (SELECT doc_id, p, row_number() OVER (PARTITION BY h ORDER BY doc_id, p) AS n FROM k),
        gone AS (SELECT DISTINCT doc_id, p + i AS q FROM later, range(20) r(i) WHERE n > 1),
        cut AS (SELECT doc_id, list(q) AS qs FROM gone GROUP BY doc_id)
        SELECT doc_id, len(w) AS n_words, coalesce(len(qs), 0) AS n_removed,
               sha256(coalesce(array_to_string(
                   [x FOR x, i IN w IF NOT list_contains(coalesce(qs, []), i)], ' '), '')) AS kept_sha256
        FROM d LEFT JOIN cut USING (doc_id)""",
    "op5_backoff_lm": f"""
        WITH d AS (SELECT doc_id, {WORDS} AS w FROM documents),
        p AS (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM d),
        g AS (SELECT doc_id, i, w[i] AS a, CASE WHEN i > 1 THEN w[i-1] || ' ' || w[i] END AS b,
                     CASE WHEN i > 2 THEN w[i-2] || ' ' || w[i-1] || ' ' || w[i] END AS c,
                     CASE WHEN i > 1 THEN w[i-1] END AS pa,
                     CASE WHEN i > 2 THEN w[i-2] || ' ' || w[i-1] END AS pb FROM p),
        own AS (SELECT x, doc_id, count(*) AS n FROM
                (SELECT a AS x, doc_id FROM g UNION ALL SELECT b, doc_id FROM g UNION ALL SELECT c, doc_id FROM g)
                WHERE x IS NOT NULL GROUP BY x, doc_id),
        other AS (SELECT x, doc_id, sum(n) OVER (PARTITION BY x) - n AS n FROM own),
        words AS (SELECT doc_id, len(w) AS n, sum(len(w)) OVER () - len(w) AS rest FROM d),
        s AS (SELECT g.doc_id, CASE
              WHEN nc.n > 0 THEN ln(nc.n / nb0.n)
              WHEN nb.n > 0 THEN ln(nb.n / na0.n) + CASE WHEN i > 2 THEN ln(0.4) ELSE 0 END
              ELSE CASE WHEN na.n > 0 THEN ln(na.n / rest) ELSE ln(1.0 / (rest + 1)) END
                   + (least(i, 3) - 1) * ln(0.4) END AS v
              FROM g JOIN words USING (doc_id)
              LEFT JOIN other nc ON nc.x = c AND nc.doc_id = g.doc_id
              LEFT JOIN other nb ON nb.x = b AND nb.doc_id = g.doc_id
              LEFT JOIN other na ON na.x = a AND na.doc_id = g.doc_id
              LEFT JOIN other nb0 ON nb0.x = pb AND nb0.doc_id = g.doc_id
              LEFT JOIN other na0 ON na0.x = pa AND na0.doc_id = g.doc_id)
        SELECT doc_id, words.n AS n_words, round(coalesce(sum(v), 0), 4) AS score
        FROM words LEFT JOIN s USING (doc_id) GROUP BY doc_id, words.n""",
    "op6_mixing": f"""
        WITH z AS (SELECT doc_id, source, len({WORDS}) AS size FROM documents),
        s0 AS (SELECT source, sum(size)::BIGINT AS source_size FROM z GROUP BY source),
        s1 AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) AS no, sum(source_size) OVER () AS total,
               3 * source_size AS cap FROM s0),
        s2 AS (SELECT *, [5, 2, 1][(no - 1) % 3 + 1] AS weight FROM s1),
        s3 AS (SELECT *, sum(weight) OVER () AS wsum,
               coalesce(sum(weight) OVER b, 0) AS wbefore, coalesce(sum(cap) OVER b, 0) AS cbefore FROM s2
               WINDOW b AS (ORDER BY cap / weight, no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
        s4 AS (SELECT *, cap::DOUBLE * (wsum - wbefore) <= weight::DOUBLE * (total - cbefore) AS capped FROM s3),
        s5 AS (SELECT *, CASE WHEN capped THEN cap::DOUBLE ELSE weight
                 * (total - sum(CASE WHEN capped THEN cap ELSE 0 END) OVER ())::DOUBLE
                 / sum(CASE WHEN capped THEN 0 ELSE weight END) OVER () END AS target,
               greatest(1, least(4096, floor(total / (4000 * wsum))))::BIGINT AS block FROM s4),
        s6 AS (SELECT *, CASE WHEN capped THEN 0.0 ELSE target END AS votes,
               floor(sum(CASE WHEN capped THEN 0.0 ELSE target END) OVER () / block + 0.5)::BIGINT AS seats FROM s5),
        s7 AS (SELECT no, unnest(range(0, ceil(2 * votes / block)::BIGINT + 3)) AS k, votes, seats FROM s6),
        s8 AS (SELECT no, row_number() OVER (ORDER BY votes / (2 * k + 1) DESC, no, k) AS r, seats FROM s7),
        s9 AS (SELECT s6.*, coalesce(q.quota, 0) AS quota,
               greatest(1, ceil(source_size / (block * 256)))::BIGINT AS shards
               FROM s6 LEFT JOIN (SELECT no, count(*) AS quota FROM s8 WHERE r <= seats GROUP BY no) q USING (no)),
        l0 AS (SELECT z.doc_id, z.size, s9.*, md5(concat_ws('|', 7, z.doc_id, z.size)) AS key
               FROM z JOIN s9 ON z.source IS NOT DISTINCT FROM s9.source),
        l1 AS (SELECT *, ('0x' || substr(key, 1, 8))::BIGINT % shards AS shard FROM l0),
        l2 AS (SELECT *, sum(size) OVER (PARTITION BY no, shard ORDER BY key, doc_id, size
                 ROWS UNBOUNDED PRECEDING) - size AS pos FROM l1),
        h0 AS (SELECT no, shard, any_value(source) AS source, sum(size) AS ssize, any_value(quota) AS squota,
               any_value(block) AS block, any_value(capped) AS capped FROM l1 GROUP BY no, shard),
        h1 AS (SELECT no, shard, squota,
                 unnest(range(0, ceil(2 * squota * ssize / greatest(1, sum(ssize) OVER (PARTITION BY no)))::BIGINT + 3)) AS k,
                 ssize FROM h0),
        h2 AS (SELECT no, shard, squota,
                 row_number() OVER (PARTITION BY no ORDER BY ssize / (2 * k + 1) DESC, shard, k) AS r FROM h1),
        h3 AS (SELECT h0.*, ceil(ssize / block)::BIGINT AS blocks, coalesce(n, 0) AS n FROM h0 LEFT JOIN
               (SELECT no, shard, count(*) AS n FROM h2 WHERE r <= squota GROUP BY no, shard) USING (no, shard)),
        h4 AS (SELECT *, CASE WHEN capped THEN 3 * blocks ELSE least(n, 3 * blocks) END AS q FROM h3 WHERE blocks > 0),
        b0 AS (SELECT no, shard, source, q % blocks AS rest, unnest(range(0, blocks)) AS b FROM h4),
        b1 AS (SELECT no, shard, b, rest, row_number() OVER (PARTITION BY no, shard
                 ORDER BY md5(concat_ws('|', 7, source, shard, b)), b) AS r FROM b0),
        b2 AS (SELECT l2.doc_id, sum(greatest(0, least(pos + size, (b + 1) * block) - greatest(pos, b * block))) AS part
               FROM l2 JOIN b1 ON b1.no = l2.no AND b1.shard = l2.shard AND r <= rest
               AND b BETWEEN pos // block AND (pos + size) // block GROUP BY l2.doc_id)
        SELECT l2.doc_id, size::BIGINT AS size, source_size, target,
               (coalesce(size * (q // blocks), 0) + coalesce(part, 0))::BIGINT AS taken
        FROM l2 LEFT JOIN h4 USING (no, shard) LEFT JOIN b2 USING (doc_id)""",
    "op8_exact_dedup": r"""
        WITH t AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS c FROM documents)
        SELECT doc_id, min(doc_id) OVER (PARTITION BY c) AS keep_id, count(*) OVER (PARTITION BY c) AS group_size,
               doc_id = min(doc_id) OVER (PARTITION BY c) AS kept, sha256(c) AS text_sha256 FROM t""",
    "op12_collocations": r"""
        WITH p AS (SELECT doc_id, coalesce(lang, 'und') AS lang, unnest(string_split_regex(
                     translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                     '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
        w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM p),
        g AS (SELECT lang, s, array_to_string(w[i:i + s - 1], ' ') AS phrase FROM
              (SELECT lang, w, s, unnest(range(1, len(w) - s + 2)) AS i FROM w, (VALUES (1), (2), (3)) t(s))),
        f AS (SELECT lang, s, phrase, count(*) AS f FROM g GROUP BY ALL),
        n AS (SELECT lang, sum(f)::BIGINT AS n FROM f WHERE s = 1 GROUP BY lang),
        c AS (SELECT lang, s, phrase, string_split(phrase, ' ') AS w, f AS a FROM f WHERE s > 1 AND f >= 10),
        m AS (SELECT lang, sub, max(a) AS b FROM (SELECT lang, a, unnest([array_to_string(w[1:2], ' '), array_to_string(w[2:3], ' ')])
              AS sub FROM c WHERE s = 3) GROUP BY ALL),
        k AS (SELECT c.*, unnest(range(1, s)) AS k FROM c LEFT JOIN m ON m.lang = c.lang AND m.sub = c.phrase
              WHERE b IS NULL OR 100 * b < 50 * a),
        x AS (SELECT k.lang, k.phrase, a, k, l.f AS l, r.f AS r, (1000000::HUGEINT * a * a // (l.f::HUGEINT * r.f))::BIGINT AS score
              FROM k JOIN f l ON l.lang = k.lang AND l.phrase = array_to_string(w[1:k], ' ')
              JOIN f r ON r.lang = k.lang AND r.phrase = array_to_string(w[k + 1:], ' ')),
        y AS (SELECT * FROM x QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1)
        SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank,
               phrase, a, l, r, n, score FROM y JOIN n USING (lang) QUALIFY rank <= 2000""",
    "op13_fill_in_middle": r"""
        WITH d AS (SELECT doc_id, coalesce(text, '') AS t, sha256('7:' || doc_id) AS h,
                          regexp_extract_all(coalesce(text, ''), '[^\n]*\n|[^\n]+') AS u FROM documents),
        c AS (SELECT *, len(u) AS n, ('0x' || substr(h, 1, 8))::BIGINT % (len(u) + 1) AS x,
                     ('0x' || substr(h, 9, 8))::BIGINT % (len(u) + 1) AS y,
                     CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') THEN 'plain'
                          WHEN ('0x' || substr(h, 25, 8))::BIGINT % 100 < 50 THEN 'spm' ELSE 'psm' END AS form FROM d),
        p AS (SELECT *, array_to_string(u[1:least(x, y)], '') AS a, array_to_string(u[least(x, y) + 1:greatest(x, y)], '') AS b,
                     array_to_string(u[greatest(x, y) + 1:], '') AS z FROM c)
        SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(a) END AS prefix_chars,
               CASE WHEN form <> 'plain' THEN length(b) END AS middle_chars,
               sha256(CASE form WHEN 'plain' THEN t WHEN 'spm' THEN '<S>' || z || '<P>' || a || '<M>' || b
                      ELSE '<P>' || a || '<S>' || z || '<M>' || b END) AS output_sha256,
               sha256(t) AS restored_sha256 FROM p""",
}
