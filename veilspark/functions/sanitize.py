"""The three stages in one expression."""

from __future__ import annotations

from functools import lru_cache

from pyspark import SparkContext
from pyspark.sql import Column
from pyspark.sql import functions as F

from veilspark.functions.core import let
from veilspark.functions.pii import redact_pii
from veilspark.functions.profanity import censor_profanity
from veilspark.functions.secrets import clean_stage1


def sanitize(text: Column, region: str | Column = "FR", **lexicon) -> Column:
    """Struct of clean text and profanity flag: secrets and noise, personal data, profanity."""
    return let(
        redact_pii(clean_stage1(text), region),
        lambda t: let(
            censor_profanity(t, **lexicon),
            lambda c: F.when(
                t.isNotNull(), F.struct(c.alias("text"), (c != t).alias("flagged_profanity"))
            ),
        ),
    )


def sanitize_text(text: Column, region: str | Column = "FR", **lexicon) -> Column:
    """Clean text only."""
    return censor_profanity(redact_pii(clean_stage1(text), region), **lexicon)


@lru_cache(maxsize=64)
def _built(whole: bool, name: str, region: str, gateway: object) -> Column:
    return (sanitize if whole else sanitize_text)(F.col(name), region)


def _column(whole: bool, name: str, region: str | Column, lexicon: dict) -> Column:
    if isinstance(region, str) and not lexicon:
        return _built(whole, name, region, SparkContext._gateway)
    return (sanitize if whole else sanitize_text)(F.col(name), region, **lexicon)


def sanitize_column(name: str, region: str | Column = "FR", **lexicon) -> Column:
    """``sanitize`` of a named column.

    Putting the expression together takes thousands of calls into the JVM, so it is kept and
    used again for every table with a column of that name.
    """
    return _column(True, name, region, lexicon)


def sanitize_text_column(name: str, region: str | Column = "FR", **lexicon) -> Column:
    """``sanitize_text`` of a named column, kept like ``sanitize_column``."""
    return _column(False, name, region, lexicon)
