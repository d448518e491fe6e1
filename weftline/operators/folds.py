"""Order-dependent rules over a session: throttling, skipping while busy, dropping late frames, batches by count.

The rules run over pieces of sessions. ``ordered_fold`` is the plain form for any rule, one pass over sorted rows with a small
state: a session of any length needs no more memory than a batch, but is one task.
"""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.operators import pieces


def ordered_fold(df: DataFrame, key: str, order: list[str], reads: list[str], start: Callable, step: Callable, to: str = "kept") -> DataFrame:
    """Adds boolean ``to``: ``step(state, *reads)`` returns the next state and the value, ``start()`` the first state
    of each key. Rows with a null key are one session."""
    kept = [c for c in df.columns if c != to]

    def run(batches):
        at, state, fresh = None, None, True
        for batch in batches:
            out = []
            for k, *values in zip(*(batch.column(c).to_pylist() for c in [key, *reads]), strict=True):
                if fresh or k != at:
                    at, state, fresh = k, start(), False
                state, value = step(state, *values)
                out.append(value)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array(out, pa.bool_())], [*kept, to])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.select(*kept).schema.fields)
    return df.select(*kept).repartition(key).sortWithinPartitions(key, *order).mapInArrow(run, f"{schema}, `{to}` boolean")


def throttle_step(interval_us: int) -> Callable:
    """State: when the last frame was kept."""

    def step(last, us):
        ok = last is None or us - last[0] >= interval_us
        return ((us,) if ok else last), ok

    return step


def busy_step(until, us, cost):
    """State: until when the last frame kept is served."""
    ok = until is None or us >= until[0]
    return ((us + cost,) if ok else until), ok


def late_step(most_us: int, resets_after: int) -> Callable:
    """State: the clock's first frame, when it came, and the drops since the last one kept."""

    def step(state, us, now):
        if state is None or most_us <= 0:
            return (us, now, 0), True
        first, begun, drops = state
        if now - begun - (us - first) <= most_us:
            return (first, begun, 0), True
        return ((first, begun, drops + 1), False) if drops < resets_after else ((us, now, 0), True)

    return step


def throttle(df: DataFrame, interval_us: int) -> DataFrame:
    """kept: the first frame of a session, then each that comes ``interval_us`` or more after the last one kept."""
    return pieces.fold(df, "session", ["us", "event_id"], pieces.Busy(None, interval_us))


def busy_skip(df: DataFrame, service: str) -> DataFrame:
    """kept: a frame is dropped while the last one kept is being served for column ``service`` microseconds."""
    return pieces.fold(df, "session", ["us", "event_id"], pieces.Busy(service))


def late_drop(df: DataFrame, wall: str, most_us: int, resets_after: int = 100) -> DataFrame:
    """kept: frames no older than ``most_us`` against the session's clock, which the first frame starts and which
    starts anew with the frame after more than ``resets_after`` drops in a row. 0 keeps all."""
    if most_us <= 0:
        return df.withColumn("kept", F.lit(True))
    return pieces.fold(df, "session", ["us", "event_id"], pieces.Late(wall, most_us, resets_after))


def count_batches(kept: DataFrame, size: int) -> DataFrame:
    """The kept frames with batch (from 0) and place in it."""
    from pyspark.sql import Window

    n = F.row_number().over(Window.partitionBy("session").orderBy("us", "event_id")) - 1
    return kept.where("kept").withColumn("n", n).withColumns({"batch": F.floor(F.col("n") / size).cast("bigint"), "place": (F.col("n") % size).cast("bigint")}).drop("n")
