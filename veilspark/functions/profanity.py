"""Stage 3: flag and censor profanity.

A word is profane if its skeleton (``functions/skeleton.py``) is a stem of the lexicon with one of its
endings; letters may be drawn out. A run of single letters between separators (``x.y.z w``) is profane if the letters
spell a stem somewhere.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from veilspark.functions.core import is_ascii, let, replace_where, when_guarded
from veilspark.functions.reference_data import (
    PROFANE_ENDINGS,
    PROFANE_LEXICON,
    PROFANE_STEMS,
    profane_opening,
    profane_pattern,
    profane_search,
)
from veilspark.functions.skeleton import SIGNS, WORD_SEARCH, skeleton

#: Four or more single letters with one blank, dot, dash or underscore between each.
SPACED_PATTERN = r"\b[A-Za-z](?:[ ._\-][A-Za-z]){3,}\b"
_SIGNS = "".join(pair[0] for pair in SIGNS.split())
# A sign next to a letter (starts with the rare character, so that most positions fail at once).
_SIGN_PATTERN = rf"[{_SIGNS}](?:(?<=[A-Za-z][{_SIGNS}])|(?=[A-Za-z]))"


def fold_word(word: Column) -> Column:
    """Lower case, without marks, and with look-alikes turned into letters; a plain word is only lowered."""
    return F.when(word.rlike("^[A-Za-z]*+$"), F.lower(word)).otherwise(skeleton(word))


def starred(word: Column) -> Column:
    """The first character, and a star for each other one."""
    return F.concat(F.left(word, F.lit(1)), F.repeat(F.lit("*"), F.char_length(word) - 1))


def _has_profane(text: Column, opening: str) -> Column:
    """A necessary condition for a profane word; the skeleton of a text without disguise is its lower case."""
    plain = is_ascii(text) & ~text.rlike(_SIGN_PATTERN)
    return F.when(plain, text.rlike(f"(?i){opening}")).otherwise(skeleton(text).rlike(opening))


def _has_spaced(text: Column) -> Column:
    """A necessary condition for a run of single letters; it starts with a rare character, so most places fail at once."""
    return text.rlike(r"[ ._\-][A-Za-z][ ._\-][A-Za-z][ ._\-][A-Za-z]")


def _spells(run: Column, stem: str) -> Column:
    return F.lower(F.regexp_replace(run, r"[ ._\-]", "")).rlike(stem)


def censor_profanity(
    text: Column, stems: tuple[str, ...] = PROFANE_STEMS, endings: tuple[str, ...] = PROFANE_ENDINGS
) -> Column:
    """Keep the first character of each offending word or run of letters and star the rest."""
    pattern, stem, opening = profane_pattern(stems, endings), profane_search(stems), profane_opening(stems)

    def star(word: Column) -> Column:
        return F.when(fold_word(word).rlike(pattern), starred(word)).otherwise(word)

    def star_run(run: Column) -> Column:
        masked = F.concat(F.left(run, F.lit(1)), F.regexp_replace(F.substr(run, F.lit(2)), "[A-Za-z]", "*"))
        return F.when(_spells(run, stem), masked).otherwise(run)

    words = when_guarded(text, lambda v: _has_profane(v, opening), lambda v: replace_where(v, WORD_SEARCH, star))
    return when_guarded(words, _has_spaced, lambda v: replace_where(v, SPACED_PATTERN, star_run))


def flag_profanity(
    text: Column, stems: tuple[str, ...] = PROFANE_STEMS, endings: tuple[str, ...] = PROFANE_ENDINGS
) -> Column:
    """True if ``censor_profanity`` has something to star."""
    pattern, stem, opening = profane_pattern(stems, endings), profane_search(stems), profane_opening(stems)

    def hit(v: Column) -> Column:
        words = F.exists(F.regexp_extract_all(v, F.lit(WORD_SEARCH), F.lit(0)), lambda w: fold_word(w).rlike(pattern))
        runs = F.exists(F.regexp_extract_all(v, F.lit(SPACED_PATTERN), F.lit(0)), lambda r: _spells(r, stem))
        return F.when(_has_profane(v, opening), words).otherwise(False) | F.when(_has_spaced(v), runs).otherwise(False)

    return let(text, lambda v: F.when(v.isNotNull(), hit(v)))


def profanity_hits(
    text: Column, lexicon: dict[str, tuple[str, int]] = PROFANE_LEXICON, endings: tuple[str, ...] = PROFANE_ENDINGS
) -> Column:
    """Profane words in order, then runs of single letters that spell a stem, as structs of word, category and
    severity. A word that fits several stems has the greatest severity (and the last category) of them.
    There are hits where ``flag_profanity`` is true. Null in, null out."""
    kinds: dict[tuple[int, str], list[str]] = {}
    for stem, (category, severity) in lexicon.items():
        kinds.setdefault((severity, category), []).append(stem)
    kind_type = "struct<word:string,category:string,severity:int>"

    def graded(word: Column, fits: Callable[[tuple[str, ...]], Column]) -> Column:
        out = F.lit(None).cast(kind_type)
        for severity, category in sorted(kinds):
            kind = F.struct(word.alias("word"), F.lit(category).alias("category"), F.lit(severity).alias("severity"))
            out = F.when(fits(tuple(kinds[severity, category])), kind).otherwise(out)
        return out

    def word_kind(word: Column) -> Column:
        return let(fold_word(word), lambda f: graded(word, lambda stems: f.rlike(profane_pattern(stems, endings))))

    def run_kind(run: Column) -> Column:
        return graded(run, lambda stems: _spells(run, profane_search(stems)))

    def found(v: Column, pattern: str, kind: Callable[[Column], Column]) -> Column:
        return F.filter(F.transform(F.regexp_extract_all(v, F.lit(pattern), F.lit(0)), kind), lambda h: h.isNotNull())

    none = F.array().cast(f"array<{kind_type}>")
    opening = profane_opening(tuple(lexicon))

    def hits(v: Column) -> Column:
        words = F.when(_has_profane(v, opening), found(v, WORD_SEARCH, word_kind)).otherwise(none)
        return F.concat(words, F.when(_has_spaced(v), found(v, SPACED_PATTERN, run_kind)).otherwise(none))

    return let(text, lambda v: F.when(v.isNotNull(), hits(v)))
