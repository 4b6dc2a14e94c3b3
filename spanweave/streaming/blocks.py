"""Blocks over a stream: by session windows over time, or by keyed state over positions."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def event_blocks(events: DataFrame, gap: str = "30 minutes", late: str = "1 hour", key: str = "user_id", ts: str = "ts") -> DataFrame:
    """Blocks of a key's events with no silence of ``gap`` inside.

    Works on static tables and on streams; on a stream, state is dropped when
    the watermark passes a block, and rows later than ``late`` are left out.
    """
    if events.isStreaming:
        events = events.withWatermark(ts, late)
    by = events.groupBy(F.col(key), F.session_window(F.col(ts), gap).alias("w"))
    return by.agg(F.count(F.lit(1)).alias("n"), F.min(ts).alias("first_ts"), F.max(ts).alias("last_ts")).select(key, "first_ts", "last_ts", "n")


def _joined(rows: pd.DataFrame, join: int) -> pd.DataFrame:
    """Blocks (``start, end, n``) of intervals that already carry a count."""
    rows = rows.sort_values(["start", "end"], kind="stable")
    border = rows["end"].cummax().shift()
    number = (border.isna() | (rows["start"] > border + 1 + join)).cumsum()
    return rows.groupby(number).agg(start=("start", "min"), end=("end", "max"), n=("n", "sum")).reset_index(drop=True)


def position_blocks(intervals: DataFrame, keys: Sequence[str], left: str = "left", right: str = "right", join: int = 5) -> DataFrame:
    """Blocks of a stream of intervals that comes in about the order of their position: ``keys, start, end, n, late``.

    A key's state is its open block.  A block is given out once the key has an
    interval that begins over ``join`` + 1 behind its end, or a row without ``left``,
    which closes the key.  Intervals that begin within ``join`` + 1 of a block that
    was given out, or before it, are late: they join nothing and are counted in
    ``late`` of the key's next block.  Inside a micro-batch order doesn't matter.
    Intervals are joined as they come in, so a task holds blocks and one Arrow batch,
    never all rows of a key.
    """
    schema = intervals.schema
    out = ", ".join(f"`{k}` {schema[k].dataType.simpleString()}" for k in keys) + ", start long, end long, n long, late long"

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        start, end, n, gone, late = state.get if state.exists else (None, None, 0, None, 0)
        held, closes = pd.DataFrame({"start": [start], "end": [end], "n": [n]}) if n else pd.DataFrame({"start": [], "end": [], "n": []}), False
        for frame in frames:
            closes |= bool(frame[left].isna().any())
            rows = frame.dropna(subset=[left, right])
            rows = pd.DataFrame({"start": rows[left].astype("int64"), "end": rows[right].astype("int64"), "n": 1})
            if gone is not None:
                behind = rows["start"] <= gone + 1 + join
                late += int(behind.sum())
                rows = rows[~behind]
            if len(rows):
                held = _joined(pd.concat([held, rows]) if len(held) else rows, join)
        done = held if closes else held.iloc[:-1]
        if len(done):
            gone = int(done["end"].iloc[-1])
            given = pd.DataFrame({**{k: [v] * len(done) for k, v in zip(keys, key, strict=True)}, "start": done["start"], "end": done["end"], "n": done["n"], "late": 0})
            given.iloc[0, given.columns.get_loc("late")] = late
            late = 0
            yield given.astype({c: "int64" for c in ("start", "end", "n", "late")})
        last = (None, None, 0) if closes or not len(held) else tuple(int(x) for x in held.iloc[-1])
        state.update((*last, gone, late))

    grouped = intervals.groupBy(*keys)
    return grouped.applyInPandasWithState(step, out, "start long, end long, n long, gone long, late long", "append", GroupStateTimeout.NoTimeout)
