"""Read back which rules fired from the markers in clean text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from veilspark.functions.core import contains_any, let
from veilspark.functions.rules import MARKERS

# Begins with one character class, so that the search steps over most positions at once.
_SEARCH = r"[\[<](?:(?<=\[)REDACTED_[A-Z_]+\]|(?<=<)[A-Z0-9_]+(?: truncated)?>)"
_HINTS = ("[REDACTED_", *(m for m in MARKERS if m.startswith("<")))


def findings(clean: Column) -> Column:
    """Array of (rule, n) for one clean text; empty where no marker occurs."""
    empty = F.array().cast("array<struct<rule:string,n:bigint>>")

    def count(text: Column) -> Column:
        names = F.create_map(*[F.lit(x) for item in MARKERS.items() for x in item])

        def per_marker(marks: Column) -> Column:
            counted = F.transform(
                F.array_distinct(marks),
                lambda m: F.struct(
                    F.try_element_at(names, m).alias("rule"),
                    F.size(F.filter(marks, lambda x: x == m)).cast("long").alias("n"),
                ),
            )
            return F.filter(counted, lambda f: f["rule"].isNotNull())

        found = let(F.regexp_extract_all(text, F.lit(_SEARCH), F.lit(0)), per_marker)
        return F.when(contains_any(text, _HINTS), found).otherwise(empty)

    return let(clean, count)
