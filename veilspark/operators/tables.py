"""Operators over whole tables: latest text per source, conversations, large lexicons."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilspark.functions.core import let, replace_where
from veilspark.functions.profanity import fold_word, starred
from veilspark.functions.skeleton import WORD_SEARCH
from veilspark.functions.sanitize import sanitize_text_column


def latest_per_source(df: DataFrame, source: str, order: list[str]) -> DataFrame:
    """The last row of each source along ``order`` (unique within a source); a null source is one too.

    Rows are combined before they are shuffled, so each task sends one row per source.
    """
    last = F.max_by(F.struct(*df.columns), F.struct(*order)).alias("_row")
    return df.groupBy(F.col(source).alias("_source")).agg(last).select("_row.*")


def sanitize_conversations(
    df: DataFrame,
    conversation: str = "conv_id",
    turn: str = "turn",
    role: str = "role",
    text: str = "text",
    segment_turns: int = 256,
    region: str | Column = "FR",
) -> DataFrame:
    """Conversations put together again from sanitized turns, in order.

    Turns are cleaned before they move.  A row holds at most ``segment_turns`` turns, so a
    conversation of any length is spread over as many rows as it needs.
    """
    turns = df.select(
        conversation,
        F.floor(F.col(turn) / segment_turns).alias("segment"),
        F.struct(
            F.col(turn).alias("turn"),
            F.concat(F.col(role), F.lit(": "), sanitize_text_column(text, region)).alias("line"),
        ).alias("t"),
    )
    grouped = turns.groupBy(conversation, "segment").agg(F.sort_array(F.collect_list("t")).alias("ts"))
    return grouped.select(
        conversation,
        F.col("segment").cast("long").alias("segment"),
        F.size("ts").cast("long").alias("n_turns"),
        F.array_join(F.col("ts.line"), "\n").alias("transcript"),
    )


def sanitize_turns(
    df: DataFrame,
    conversation: str = "conv_id",
    turn: str = "turn",
    role: str = "role",
    text: str = "text",
    region: str | Column = "FR",
) -> DataFrame:
    """One sanitized row per turn, with the turn as its position: whole conversations without a shuffle."""
    return df.select(conversation, turn, role, sanitize_text_column(text, region).alias(text))


def _same(keys: list[str]) -> Column:
    """Keys equal to their copies ``_key``; nulls are equal."""
    same = F.lit(True)
    for key in keys:
        same = same & F.col(key).eqNullSafe(F.col(f"_{key}"))
    return same


def _words(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(WORD_SEARCH), F.lit(0))


def _folded_words(text: Column) -> Column:
    return F.transform(_words(text), fold_word)


def _phrases(words: Column, size: int) -> Column:
    """All stretches of ``size`` words, each as one string, in order."""
    if size == 1:
        return words
    starts = F.when(F.size(words) >= size, F.sequence(F.lit(1), F.size(words) - (size - 1))).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda i: F.array_join(F.slice(words, i, size), " "))


def _terms(lexicon: DataFrame, term: str, longest: int, *kept: str) -> DataFrame:
    """The lexicon by folded term; an entry of more words than are looked for is an error."""
    words = _folded_words(F.col(term))
    long = F.concat(F.lit(f"a term has more than {longest} words: "), F.col(term))
    key = F.when(F.size(words) > longest, F.raise_error(long)).otherwise(F.array_join(words, " "))
    return lexicon.select(key.alias("_term"), *kept).where("_term <> ''")


def _lexicon_hits(df: DataFrame, keys: list[str], lexicon: DataFrame, text: str, term: str, longest: int) -> DataFrame:
    """(_keys, _term): the folded terms of each text that the lexicon has.

    Terms are made unique per text before they move; a hot word then costs one row per text.
    Spark broadcasts the lexicon if it is small and splits hot words if it is not.
    """
    terms = _terms(lexicon, term, longest).distinct()
    if longest == 1:  # most words come again and again, so each is folded once
        found = F.array_distinct(F.transform(F.array_distinct(_words(F.col(text))), fold_word))
    else:
        found = let(
            _folded_words(F.col(text)),
            lambda words: F.array_distinct(F.concat(*(_phrases(words, n) for n in range(1, longest + 1)))),
        )
    found = df.select(*keys, F.explode(found).alias("_term")).join(terms, "_term", "left_semi")
    return found.select(*[F.col(k).alias(f"_{k}") for k in keys], "_term")


def flag_by_lexicon(
    df: DataFrame, keys: list[str], lexicon: DataFrame, text: str = "text", term: str = "term", longest: int = 1
) -> DataFrame:
    """(keys, flagged) against a lexicon table of any size, of terms of up to ``longest`` words.

    Words are compared by their skeleton; the words of a term follow each other, whatever stands between.
    """
    hits = _lexicon_hits(df, keys, lexicon, text, term, longest).drop("_term").distinct().withColumn("_hit", F.lit(True))
    return df.select(*keys).join(hits, _same(keys), "left").select(*keys, F.coalesce("_hit", F.lit(False)).alias("flagged"))


def find_by_lexicon(
    df: DataFrame, keys: list[str], lexicon: DataFrame, text: str = "text", term: str = "term", longest: int = 3
) -> DataFrame:
    """(keys, pos, n_words, term, other columns of the lexicon): one row for each place at which a term stands.

    ``pos`` counts words from 1; ``term`` is the folded form. Overlapping terms are all found, and a term
    that the lexicon has several times gives a row for each.
    """
    kept = [c for c in lexicon.columns if c != term]

    def at(size: int) -> Column:
        def place(term: Column, i: Column) -> Column:
            return F.struct((i + 1).cast("long").alias("pos"), F.lit(size).alias("n_words"), term.alias("_term"))

        return F.transform(_phrases(F.col("_words"), size), place)

    places = F.concat(*(at(n) for n in range(1, longest + 1)))
    words = df.select(*keys, F.explode(F.array(_folded_words(F.col(text)))).alias("_words"))
    places = words.select(*keys, F.explode(places).alias("p")).select(*keys, "p.*")
    terms = _terms(lexicon, term, longest, *kept)
    return places.join(terms, "_term").select(*keys, "pos", "n_words", F.col("_term").alias("term"), *kept)


def censor_by_lexicon(
    df: DataFrame, keys: list[str], lexicon: DataFrame, text: str = "text", term: str = "term", longest: int = 1
) -> DataFrame:
    """(keys, text) with all words of the terms of a lexicon table starred but for their first character.

    Only the terms found in a text come back to it, so the size of the lexicon does not matter.
    Rows that share all keys share their hits.
    """
    if longest == 1:  # a word tells by itself, so the words come back as they are written and are folded once only
        written = F.explode(F.array_distinct(_words(F.col(text)))).alias("_word")
        hits = df.select(*[F.col(k).alias(f"_{k}") for k in keys], written).withColumn("_term", fold_word(F.col("_word")))
        hits = hits.join(_terms(lexicon, term, longest).distinct(), "_term", "left_semi").drop("_term")
    else:
        hits = _lexicon_hits(df, keys, lexicon, text, term, longest).withColumnRenamed("_term", "_word")
    hits = hits.groupBy(*[f"_{k}" for k in keys]).agg(F.collect_set("_word").alias("_found"))
    both = df.select(*keys, text).join(hits, _same(keys), "left")

    def starred_at(covered: Column) -> Column:
        gaps = F.split(F.col(text), WORD_SEARCH, -1)
        words = F.regexp_extract_all(F.col(text), F.lit(WORD_SEARCH), F.lit(0))
        shown = F.transform(words, lambda w, i: F.when(F.array_contains(covered, i), starred(w)).otherwise(w))
        return F.array_join(F.flatten(F.zip_with(gaps, shown, lambda g, w: F.array(g, w))), "")

    def covered(words: Column) -> Column:
        """Positions, from 0, of the words that lie in a found term."""

        def spans(size: int) -> Column:
            def span(term: Column, i: Column) -> Column:
                none = F.array().cast("array<int>")
                return F.when(F.array_contains("_found", term), F.sequence(i, i + (size - 1))).otherwise(none)

            return F.flatten(F.transform(_phrases(words, size), span))

        return F.concat(*(spans(n) for n in range(1, longest + 1)))

    if longest == 1:
        # In the order in which they come: frequent words come early and are found soon.
        censored = let(
            F.array_intersect(_words(F.col(text)), F.col("_found")),
            lambda found: replace_where(
                F.col(text), WORD_SEARCH, lambda w: F.when(F.array_contains(found, w), starred(w)).otherwise(w)
            ),
        )
    else:
        censored = let(let(_folded_words(F.col(text)), covered), starred_at)
    return both.select(*keys, F.when(F.col("_found").isNotNull(), censored).otherwise(F.col(text)).alias(text))
