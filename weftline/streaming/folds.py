"""The order-dependent rules and session ends on streams.

The state of a session is what the batch folds keep, so a stream that arrives in order gives the batch's rows.
Within a micro-batch a session's rows are sorted; across them arrival counts. A micro-batch is what is held of a
session at once: bound it at the source (``maxFilesPerTrigger``).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from weftline.operators import folds as rules

FIELDS = "session bigint, event_id bigint, us bigint, kept boolean"


def fold(df: DataFrame, reads: list[str], state: str, step: Callable) -> DataFrame:
    """session, event_id, us, kept of a stream of frames. ``step(state, *reads)`` returns the next state, a tuple of
    the DDL ``state``, and the value; the first state is None."""

    def run(key: tuple, parts: Iterator[pd.DataFrame], held: GroupState) -> Iterator[pd.DataFrame]:
        at = held.get if held.exists else None
        rows = pd.concat(list(parts)).sort_values(["us", "event_id"], kind="stable")
        kept = []
        for values in zip(*(rows[c].tolist() for c in reads), strict=True):
            at, ok = step(at, *values)
            kept.append(ok)
        held.update(at)
        yield rows[["session", "event_id", "us"]].assign(kept=kept)

    return df.groupBy("session").applyInPandasWithState(run, FIELDS, state, "append", GroupStateTimeout.NoTimeout)


def throttle(df: DataFrame, interval_us: int) -> DataFrame:
    """kept: the first frame of a session, then each ``interval_us`` or more after the last one kept."""
    return fold(df, ["us"], "last bigint", rules.throttle_step(interval_us))


def busy_skip(df: DataFrame, service: str) -> DataFrame:
    """kept: a frame is dropped while the last one kept is being served for column ``service`` microseconds."""
    return fold(df, ["us", service], "until bigint", rules.busy_step)


def late_drop(df: DataFrame, wall: str, most_us: int, resets_after: int = 100) -> DataFrame:
    """kept: frames no older than ``most_us`` by the session's clock; see the batch fold."""
    return fold(df, ["us", wall], "first bigint, begun bigint, drops bigint", rules.late_step(most_us, resets_after))


def sessions(df: DataFrame, gap: str, late: str) -> DataFrame:
    """session, first_us, last_us, n_turns of every session that has ended: nothing for ``gap`` and the watermark,
    ``late`` behind the newest frame of all, past its end."""
    timed = df.withColumn("ts", F.timestamp_micros("us")).withWatermark("ts", late)
    g = timed.groupBy("session", F.session_window("ts", gap).alias("w"))
    return g.agg(F.min("us").alias("first_us"), F.max("us").alias("last_us"), F.count("*").alias("n_turns")).select("session", "first_us", "last_us", "n_turns")
