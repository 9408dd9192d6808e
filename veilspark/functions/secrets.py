"""Stage 1: vendor secrets, opaque blobs, high-entropy tokens, timestamps, addresses, log lines."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from veilspark.functions.core import has_piece, in_turn, is_nonblank, let, redact_where, shannon_entropy, when_guarded
from veilspark.functions.lines import clean_lines
from veilspark.functions.rules import (
    HIGH_ENTROPY_BITS,
    HIGH_ENTROPY_CANDIDATE,
    HIGH_ENTROPY_MARKER,
    NORMALIZE_RULES,
    STAGE1_RULES,
    WIDE_PIECE,
    Rule,
)

_OTHER_NORMALIZE_RULES = tuple(r for r in NORMALIZE_RULES if r.replacement != "<TIME>")


def has_wide_piece(text: Column) -> Column:
    return has_piece(text, WIDE_PIECE)


def is_high_entropy(token: Column) -> Column:
    """At least 4 bits per character; rounded so that exact ties do not hang on summation order.

    Fewer than 16 different characters cannot carry 4 bits, which settles most tokens.
    """
    varied = F.size(F.array_distinct(F.split(token, ""))) >= 2**HIGH_ENTROPY_BITS
    return varied & (F.round(shannon_entropy(token), 9) >= HIGH_ENTROPY_BITS)


def redact_high_entropy(text: Column) -> Column:
    return when_guarded(
        text,
        lambda v: has_wide_piece(v),
        lambda v: redact_where(v, HIGH_ENTROPY_CANDIDATE, is_high_entropy, HIGH_ENTROPY_MARKER),
    )


def _apply_all(text: Column, rules: tuple[Rule, ...]) -> Column:
    """Apply rules in order, passing over those that are not possible."""
    return in_turn(text, [r.step for r in rules])


def _any_possible(text: Column, rules: tuple[Rule, ...]) -> Column:
    test = rules[0].possible(text)
    for r in rules[1:]:
        test = test | r.possible(text)
    return test


def redact_secrets(text: Column) -> Column:
    """All secret and blob rules plus the entropy pass, in registry order.

    Most rules need one long unbroken piece of text, and most texts have none.  Of those a
    single scan leaves only the few that could match a rule without such a piece.
    """
    opening, rest = STAGE1_RULES[:2], STAGE1_RULES[2:]
    short = tuple(r for r in rest if r.width < WIDE_PIECE)
    opened = when_guarded(text, lambda v: _any_possible(v, opening), lambda v: _apply_all(v, opening))
    return when_guarded(
        opened,
        lambda v: has_wide_piece(v) | _any_possible(v, short),
        lambda v: redact_high_entropy(_apply_all(v, rest)),
    )


def normalize_values(text: Column) -> Column:
    """Timestamps and memory addresses."""
    return when_guarded(
        text,
        lambda v: (v.contains(":") & v.rlike(r"(?U)\d:\d{2}:\d")) | _any_possible(v, _OTHER_NORMALIZE_RULES),
        lambda v: _apply_all(v, NORMALIZE_RULES),
    )


def clean_stage1(text: Column) -> Column:
    """Secrets, blobs, entropy, timestamps, addresses, framework frames and repeated lines."""
    return let(
        text,
        lambda t: F.when(is_nonblank(t), clean_lines(normalize_values(redact_secrets(t)))).when(
            t.isNotNull(), F.lit("")
        ),
    )
