"""Runs of equal lines over an event stream, kept as state by source, in event time.

Rows wait in the state until the watermark has passed them, so that those that come out of order fall in
place; then they extend the source's open run or close it. A source that stays silent for longer than
``gap`` has its run closed by a timer. What a row of the same source and order brings twice, and what
comes later than the watermark, changes nothing.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from veilspark.streaming.sinks import batch_sink


def _runs(rows: list[tuple], gap: int) -> list[tuple]:
    """Rows (place, line, n, first) in order as runs of the same form: place is then the last row's.

    A place is the time in microseconds and the ties; ``first`` is the place of the first row.
    """
    out: list[tuple] = []
    for place, line, n, first in rows:
        if out and out[-1][1] == line and place[0] - out[-1][0][0] <= gap:
            _, _, before, first = out.pop()
            n += before
        out.append((place, line, n, first))
    return out


def _order(place: tuple) -> tuple:
    """The order of places; a null tie comes last."""
    return tuple((value is None, value) for value in place)


def _known(values: pd.Series) -> list:
    """The values as Python objects, a missing one as None."""
    return [None if value is None or value != value else value for value in values.tolist()]


def _advanced(
    key: tuple, batches: Iterator[pd.DataFrame], state: GroupState, keys: list[str], ties: list[str], gap: int
) -> Iterator[pd.DataFrame]:
    """New closed runs of a source, and those that are still open, for one micro-batch or timer.

    A source brings few rows to a micro-batch, so they are plain tuples here: a table operation for each source
    costs more than all of its rows.
    """
    held = json.loads(state.get[0]) if state.exists else {"open": [], "pending": []}
    mark = state.getCurrentWatermarkMs() * 1000  # 0 before the first watermark
    places: dict[tuple, str | None] = {tuple(place): text for *place, text in held["pending"]}
    for batch in [] if state.hasTimedOut else batches:
        columns = [batch["us"].tolist(), *(_known(batch[t]) for t in ties), _known(batch["line"])]
        for *place, text in zip(*columns, strict=True):
            if place[0] >= mark:
                places.setdefault(tuple(place), text)
    rows = [(place, places[place], 1, place) for place in sorted(places, key=_order)]

    waiting = [r for r in rows if r[0][0] >= mark]
    before = [(tuple(place), text, n, tuple(first)) for *place, text, n, first in held["open"]]
    done = _runs([*before, *(r for r in rows if r[0][0] < mark)], gap)
    # The last run can still go on, unless the next row would come after the gap.
    last_open = bool(done) and done[-1][0][0] + gap >= mark
    closed, left = (done[:-1], done[-1:]) if last_open else (done, [])
    shown = _runs([*left, *waiting], gap)

    if left or waiting:
        times = [*(place[0] + gap for place, *_ in left), *(place[0] for place, *_ in waiting[:1])]
        opened = [[*place, text, n, list(first)] for place, text, n, first in left]
        state.update((json.dumps({"open": opened, "pending": [[*place, text] for place, text, _, _ in waiting]}),))
        state.setTimeoutTimestamp(max(min(times), mark) // 1000 + 1)
    elif state.exists:
        state.remove()
    out = [*closed, *shown]
    rows = [
        (*key, *(at for pair in zip(first, place, strict=True) for at in pair), text, n, k < len(closed))
        for k, (place, text, n, first) in enumerate(out)
    ]
    sides = [f"{side}_{name}" for name in ("us", *ties) for side in ("first", "last")]
    yield pd.DataFrame(rows, columns=[*keys, *sides, "line", "n", "closed"], dtype=object)


def collapse_event_stream(
    stream: DataFrame,
    out: str,
    checkpoint: str,
    keys: list[str],
    time: str,
    ties: list[str],
    line: str,
    delay: str = "10 minutes",
    gap: str = "1 hour",
    every: str | None = None,
) -> StreamingQuery:
    """Collapse repeats of each source along event time (``time``, then ``ties``: integers or strings).

    Rows up to ``delay`` behind the newest one seen are put in order. Later ones are dropped; the query's progress
    counts them as ``numRowsDroppedByWatermark``. A run
    ends with another line or with more than ``gap`` between two rows, as with ``collapse_rows(..., gap=...)``,
    which gives the same runs for the rows that were not late. State holds a source's open run and the rows of
    the last ``delay``; it is empty once the source has been silent for ``gap``. One task has a source in a
    micro-batch; for a source too large for that there is ``collapse_stream``. Read with ``read_event_runs``.
    """
    limit = int(pd.Timedelta(gap) / pd.Timedelta(microseconds=1))
    types = dict(stream.dtypes)
    rows = stream.withWatermark(time, delay).where(F.col(time).isNotNull()).select(
        *keys, time, F.unix_micros(time).alias("us"), *ties, F.col(line).alias("line")
    )
    places = [("us", "bigint"), *((t, types[t]) for t in ties)]
    fields = [
        *(f"`{k}` {types[k]}" for k in keys),
        *(f"`{side}_{name}` {kind}" for name, kind in places for side in ("first", "last")),
        "line string, n bigint, closed boolean",
    ]

    def advance(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        return _advanced(key, batches, state, keys, ties, limit)

    runs = rows.groupBy(*keys).applyInPandasWithState(
        advance, ", ".join(fields), "held string", "update", GroupStateTimeout.EventTimeTimeout
    )
    return batch_sink(runs, out, checkpoint, every)


def read_event_runs(spark: SparkSession, out: str, keys: list[str], time: str) -> DataFrame:
    """Closed runs of all micro-batches, and the runs that a source's newest one left open (``closed`` false)."""
    rows = spark.read.parquet(out)
    newest = rows.groupBy(*keys).agg(F.max("batch").alias("_newest"))
    named = [F.col(k).alias(f"_{k}") for k in keys]
    same = F.lit(True)
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_{k}"))
    current = rows.join(newest.select(*named, "_newest"), same).where("closed OR batch = _newest")
    moments = [F.timestamp_micros(f"{side}_us").alias(f"{side}_{time}") for side in ("first", "last")]
    ties = [c for c in rows.columns if c.startswith(("first_", "last_")) and c not in ("first_us", "last_us")]
    return current.select(*keys, *moments, *ties, "line", "n", "closed")
