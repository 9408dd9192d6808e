"""Line operators over one text: split, prune framework frames, collapse adjacent repeats.

They stay inside the row, so no line is ever shuffled.  Tables that already hold one line
per row are served by ``veilspark.operators.runs``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from veilspark.functions.core import contains_any, let, when_guarded

# ---- Fixed values: what counts as a stack frame and as framework code.
FRAME_PATTERN = r"(?s)^\s*(?:at|by) .*\S|\.js:|\.py:|\.java:|\.rs:"
INTERNAL_FRAGMENTS: tuple[str, ...] = (
    "node_modules/",
    "node:internal/",
    "java.base/",
    "site-packages/",
    "/usr/lib/",
    "/rustc/",
    "v8/src/",
    "vendor/bundle/",
    "System.Private.CoreLib",
    "internal/process/",
)
PRUNED_PREFIX = "    ... [Pruned "
PRUNED_SUFFIX = " framework stack frames]"
# ---- End of fixed values.


def normalize_newlines(text: Column) -> Column:
    """``\\r\\n`` becomes ``\\n`` and one final newline goes, as splitting and re-joining lines does."""


    def unify(v: Column) -> Column:
        unified = F.replace(v, F.lit("\r\n"), F.lit("\n"))
        return when_guarded(
            unified, lambda u: u.endswith("\n"), lambda u: F.left(u, F.char_length(u) - 1)
        )

    return when_guarded(text, lambda v: v.contains("\r") | v.endswith("\n"), unify)


def split_lines(text: Column) -> Column:
    """Lines of a text as an array; the empty text has none."""
    return let(
        text,
        lambda t: F.when(t == "", F.array().cast("array<string>")).otherwise(
            F.split(normalize_newlines(t), "\n", -1)
        ),
    )


def is_framework_frame(line: Column) -> Column:
    """A stack frame that lies in framework or library code."""
    return line.rlike("(?U)" + FRAME_PATTERN) & contains_any(line, INTERNAL_FRAGMENTS)


def _render_runs(
    lines: Column,
    starts_run: Callable[[Column], Column],
    render: Callable[[Column, Column], Column],
) -> Column:
    """Cut ``lines`` where ``starts_run(i)`` holds and render each run from (first index, length)."""
    size = F.size(lines)
    starts = F.filter(F.sequence(F.lit(0), size - 1), lambda i: (i == 0) | starts_run(i))

    def body(cut: Column) -> Column:
        return F.transform(
            cut, lambda start, k: render(start, F.coalesce(F.get(cut, k + 1), size) - start)
        )

    return F.when(size > 0, let(starts, body)).otherwise(lines)


def prune_frame_lines(lines: Column) -> Column:
    """Array form: each maximal run of framework frames becomes one summary line."""

    def body(pair: Column) -> Column:
        text, frame = pair["lines"], pair["frame"]
        return _render_runs(
            text,
            lambda i: ~(F.get(frame, i) & F.get(frame, i - 1)),
            lambda start, n: F.when(
                F.get(frame, start),
                F.concat(F.lit(PRUNED_PREFIX), n.cast("string"), F.lit(PRUNED_SUFFIX)),
            ).otherwise(F.get(text, start)),
        )

    return let(
        F.struct(lines.alias("lines"), F.transform(lines, is_framework_frame).alias("frame")), body
    )


def collapse_repeat_lines(lines: Column) -> Column:
    """Array form: each run of k > 1 equal lines becomes ``line (Repeated kx)``."""

    def body(text: Column) -> Column:
        return _render_runs(
            text,
            lambda i: F.get(text, i) != F.get(text, i - 1),
            lambda start, n: F.when(
                n > 1, F.concat(F.get(text, start), F.lit(" (Repeated "), n.cast("string"), F.lit("x)"))
            ).otherwise(F.get(text, start)),
        )

    return let(lines, body)


def _may_have_frames(text: Column) -> Column:
    slashed = tuple(f for f in INTERNAL_FRAGMENTS if "/" in f)
    plain = tuple(f for f in INTERNAL_FRAGMENTS if "/" not in f)
    return (text.contains("/") & contains_any(text, slashed)) | contains_any(text, plain)


def _may_repeat(text: Column) -> Column:
    """Adjacent repeats need a repeated line somewhere; hashing the lines finds out in one pass."""
    return let(F.split(text, "\n", -1), lambda ls: F.size(ls) != F.size(F.array_distinct(ls)))


def _on_lines(text: Column, guard, lines_fn) -> Column:
    return when_guarded(
        text, guard, lambda v: F.array_join(lines_fn(F.split(v, "\n", -1)), "\n")
    )


def prune_frames(text: Column) -> Column:
    """Text form of frame pruning; also normalizes newlines."""
    return _on_lines(normalize_newlines(text), _may_have_frames, prune_frame_lines)


def collapse_duplicates(text: Column) -> Column:
    """Text form of repeat collapsing; also normalizes newlines."""
    return _on_lines(normalize_newlines(text), _may_repeat, collapse_repeat_lines)


def clean_lines(text: Column) -> Column:
    """Prune frames, then collapse repeats, splitting only texts that need it.

    Two pruned runs can never become neighbours, so repeats exist after pruning only if they
    did before, and one guard covers both steps.
    """
    return _on_lines(
        normalize_newlines(text),
        lambda v: _may_have_frames(v) | _may_repeat(v),
        lambda ls: collapse_repeat_lines(prune_frame_lines(ls)),
    )
