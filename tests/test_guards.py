"""What the cheap guards let pass, and what they must not."""

import random

from pyspark.sql import functions as F

from veilspark.functions.core import let, utrim, utrim_end
from veilspark.functions.profanity import censor_profanity, fold_word, starred
from veilspark.functions.reference_data import PROFANE_ENDINGS, PROFANE_STEMS, profane_opening, profane_pattern
from veilspark.functions.rules import apply_rule, rule
from veilspark.functions.skeleton import WORD_PATTERN, WORD_SEARCH
from veilspark.functions.tokens import _BLANK, _SPACE, _TOKEN_SEARCH, TOKEN_PATTERN

ODD = "aZ09@$ \t\n\x0b\f\r\x00\x1c\x7f\x85\xa0\xadéßΣς́​ 　Ⓐ™字٣𝐚😀K_-.'"


def _noise(n: int, seed: int = 3) -> list[str]:
    rng = random.Random(seed)
    return ["".join(rng.choice(ODD) for _ in range(rng.randrange(14))) for _ in range(n)]


def test_classes_with_an_ascii_table_match_the_same(spark):
    df = spark.createDataFrame([(t,) for t in _noise(3000) + list(map(chr, range(0xD800)))], "t string")
    for plain, fast in ((WORD_PATTERN, WORD_SEARCH), (TOKEN_PATTERN, _TOKEN_SEARCH), (f"[{_SPACE}]+", f"{_BLANK}+")):
        both = [F.regexp_extract_all("t", F.lit(p), F.lit(0)) for p in (plain, fast)]
        assert df.where(both[0] != both[1]).limit(3).collect() == []


def test_trimming_looks_at_both_ends(spark):
    texts = _noise(2000, 5) + ["", " ", "　", "a ", "\xa0a", " a  ", None]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    both = (r"(?U)\A\s++|(?<!\s)\s++\z", utrim), (r"(?U)(?<!\s)\s++\z", utrim_end)
    for pattern, trim in both:
        assert df.where(~trim(F.col("t")).eqNullSafe(F.regexp_replace("t", pattern, ""))).collect() == []
    assert "CASE WHEN" in spark.createDataFrame([("a",)], "t string").select(utrim(F.col("t")))._jdf.queryExecution().optimizedPlan().toString()


def test_words_behind_any_separator_are_censored(spark):
    words = ["shit", "ShItty", "sh1t", "$hit", "şhit", "s​hit", "SHIIIT", "asshole", "xshit", "shitx", "7shit", "shit7", "ｆｕｃｋ"]
    seps = ["", " ", "-", "_", "é ", "0 ", "™", "\n", "'", "Σ"]
    texts = [a + w + b for w in words for a in seps for b in seps]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    pattern = profane_pattern(PROFANE_STEMS, PROFANE_ENDINGS)

    def starred_word(w):
        return F.when(fold_word(w).rlike(pattern), starred(w)).otherwise(w)

    gaps = F.split("t", WORD_PATTERN, -1)
    shown = F.transform(F.regexp_extract_all("t", F.lit(WORD_PATTERN), F.lit(0)), starred_word)
    unguarded = F.array_join(F.flatten(F.zip_with(gaps, shown, lambda g, w: F.array(g, w))), "")
    assert df.where(censor_profanity(F.col("t")) != unguarded).collect() == []
    assert df.where(let(F.col("t"), lambda v: v.rlike(profane_opening())) & (F.col("t") == "xshit")).collect() == []


def test_secret_rules_pass_over_texts_without_their_keys(spark, run):
    assert run(rule("kv_secret").possible, ['<a class="x" href="y">', "PASSWORD=12345678", "toKen=12345678", "a=b"]) == [False, True, True, False]
    texts = ["api-key=abcdefgh", "Auth_TOKEN=abcdefgh", "ſecret=abcdefgh", "passwd=abcdefgh", "access-token='abcdefgh'"]
    assert run(lambda t: apply_rule(t, "kv_secret"), texts) == run(rule("kv_secret").rewrite, texts)
    texts = [f'{{"{t.split("=")[0]}" : "abcdefgh"}}' for t in texts] + ['"private_key":"abcdefgh"', '"apikey": "abcdefgh"']
    assert run(lambda t: apply_rule(t, "json_secret"), texts) == run(rule("json_secret").rewrite, texts)
