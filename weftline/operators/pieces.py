"""Order-dependent rules over pieces of a session, so that one session of any length is done by many tasks.

Rows are range-partitioned by session and order and packed into pieces of at most ``PIECE`` rows, one row of a table
each. A rule's state enters a piece and leaves it by a step function, and that function is found without knowing what
enters: it is the piece's summary. One light pass over the summaries of each session, a row for ``PIECE`` rows, gives
the state that enters each piece, and then all pieces run at once.
"""

from __future__ import annotations

from bisect import bisect_left

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.sinks.files import shared

PIECE = 2048


class Busy:
    """A frame is kept once the last one kept is served: ``us`` at or after its time plus its cost.

    The state is until when. Of a piece, the first row at or after it is kept, and from row i on the next kept is fixed, so
    the state that leaves depends only on that first row: a step for each run of rows that lead to the same one. A
    state after all rows leaves as it came. Rows without a time are never kept; no cost counts as 0.
    """

    def __init__(self, cost: str | None, least: int = 0):
        self.reads, self.least = ["us", *[cost] * (cost is not None)], least

    def columns(self, us: pa.Array, cost: pa.Array | None = None):
        timed = pa.compute.is_valid(us).to_numpy(zero_copy_only=False)
        at = pa.compute.fill_null(us, 0).to_numpy(zero_copy_only=False).astype(np.int64)[timed]
        free = at + (self.least if cost is None else pa.compute.fill_null(cost, 0).to_numpy(zero_copy_only=False).astype(np.int64)[timed])
        after = np.maximum(np.searchsorted(at, free), np.arange(len(at)) + 1)
        return timed, at, free, after

    def summary(self, *values: pa.Array) -> list[int]:
        _, at, free, after = self.columns(*values)
        last = np.where(after < len(at), after, np.arange(len(at)))
        while not np.array_equal(further := last[last], last):  # doubling jumps to the last row kept
            last = further
        leaves = free[last]
        ends = np.flatnonzero(np.append(leaves[1:] != leaves[:-1], True)) if len(at) else []
        return np.concatenate([at[ends], leaves[ends]]).astype(np.int64).tolist() if len(at) else []

    def leave(self, state: list[int] | None, summary: list[int]) -> list[int] | None:
        n = len(summary) // 2
        i = 0 if state is None else bisect_left(summary, state[0], 0, n)
        return [summary[n + i]] if i < n else state

    def kept(self, state: list[int] | None, *values: pa.Array) -> np.ndarray:
        timed, at, _, after = self.columns(*values)
        own, i = np.zeros(len(at), bool), 0 if state is None else int(np.searchsorted(at, state[0]))
        while i < len(at):
            own[i] = True
            i = int(after[i])
        out = np.zeros(len(timed), bool)
        out[timed] = own
        return out


class Budget:
    """How much of a budget is left for each file: a file offers its first rows, as many as are left, and those that succeed use
    it up. ``flags`` of a file are its first rows as text, 1 for a success.

    The state is what is left. Of a piece, what leaves is known for each amount that may enter: a table of ``most`` + 1
    numbers, which all files of the piece are taken through at once.
    """

    kind, made = "bigint", pa.int64()

    def __init__(self, flags: str, most: int):
        self.reads, self.most = [flags], most

    def used(self, offered: str | None) -> np.ndarray:
        """Successes among the first 0, 1, ... rows."""
        return np.concatenate([[0], np.cumsum(np.frombuffer((offered or "").encode(), np.uint8) == ord("1"))])

    def summary(self, flags: pa.Array) -> list[int]:
        left = np.arange(self.most + 1)
        for offered in flags.to_pylist():
            used = self.used(offered)
            left = left - used[np.minimum(left, len(used) - 1)]
        return left.tolist()

    def leave(self, state: list[int] | None, summary: list[int]) -> list[int]:
        return [summary[self.most if state is None else state[0]]]

    def kept(self, state: list[int] | None, flags: pa.Array) -> np.ndarray:
        left, out = self.most if state is None else state[0], []
        for offered in flags.to_pylist():
            out.append(left)
            left -= (offered or "")[:left].count("1")
        return np.array(out, np.int64)


class Late:
    """A frame is kept if it is at most ``most`` later than the clock, which the first frame starts; the frame after more
    than ``after`` late ones in a row starts it anew and is kept. A frame without a time or an arrival has no delay.

    The state is the clock's own delay and the late frames since the last one kept. Only a frame that starts the clock
    changes the delay. So a piece's summary has, for each range of delays under which the same frames are late: how
    many lead, and what leaves if those do not start the clock; and for each of the first frames, what leaves if it does.
    """

    def __init__(self, wall: str, most: int, after: int):
        self.reads, self.most, self.after = ["us", wall], most, after

    def delays(self, us: pa.Array, wall: pa.Array) -> np.ndarray:
        return pa.compute.fill_null(pa.compute.subtract(wall.cast(pa.int64()), us.cast(pa.int64())), 0).to_numpy(zero_copy_only=False)

    def _next(self, late: np.ndarray, begin: int, drops: int) -> int:
        """The row of ``late`` from ``begin`` on that starts the clock, with ``drops`` before; the length if none does."""
        rows = np.arange(begin, len(late))
        good = np.maximum.accumulate(np.where(late[begin:], begin - 1 - drops, rows)) if len(rows) else rows
        starts = np.flatnonzero(rows - good > self.after)
        return int(rows[starts[0]]) if len(starts) else len(late)

    def _run(self, d: np.ndarray, clock: int, begin: int, drops: int):
        """(clock, drops) that leave, and the rows that start the clock on the way."""
        started = []
        while True:
            late = d > clock + self.most
            at = self._next(late, begin, drops)
            if at == len(d):
                good = np.flatnonzero(~late[begin:])
                return clock, len(d) - 1 - begin - int(good[-1]) if len(good) else drops + len(d) - begin, started
            started.append(at)
            clock, begin, drops = int(d[at]), at + 1, 0

    def summary(self, *values: pa.Array) -> list[int]:
        d = self.delays(*values)
        heads = [self._run(d, int(d[i]), i + 1, 0)[:2] for i in range(min(len(d), self.after + 1))]
        rows: list[tuple] = []
        for edge in np.unique(d - self.most).tolist():  # delays at or above it, below the next
            late = d > edge + self.most
            lead = int(np.argmin(late)) if not late.all() else len(d)
            # The clock that enters is told by the row that changes it, -1 if none does.
            at = self._next(late, lead, 0) if lead < len(d) else len(d)
            out = (-1, *self._run(d, edge, lead, 0)[1:2]) if at == len(d) else (1, *self._run(d, int(d[at]), at + 1, 0)[:2])
            row = (lead, *(out if len(out) == 3 else (-1, 0, out[1])))
            if not rows or rows[-1][1:] != row:
                rows.append((edge, *row))
        return [len(d), len(heads), *(x for h in heads for x in h), *(x for r in rows for x in r)]

    def leave(self, state: list[int] | None, summary: list[int]) -> list[int]:
        n, heads = summary[:2]
        if state is None:
            return summary[2:4]
        clock, drops = state
        table = summary[2 + 2 * heads :]
        edges = table[::5]
        i = bisect_left(edges, clock + 1) - 1
        lead, changed, new, trail = (n, -1, 0, 0) if i < 0 else table[5 * i + 1 : 5 * i + 5]
        if drops + lead > self.after:
            at = 2 + 2 * (self.after - drops)
            return summary[at : at + 2]
        if lead == n:
            return [clock, drops + n]
        return [clock, trail] if changed < 0 else [new, trail]

    def kept(self, state: list[int] | None, *values: pa.Array) -> np.ndarray:
        d = self.delays(*values)
        clock, begin, drops = (int(d[0]), 1, 0) if state is None else (state[0], 0, state[1])
        out = np.ones(len(d), bool)
        while begin < len(d):
            late = d > clock + self.most
            at = self._next(late, begin, drops)
            out[begin:at] = ~late[begin:at]
            if at == len(d):
                break
            clock, begin, drops = int(d[at]), at + 1, 0
        return out


def packed(df: DataFrame, key: str, order: list[str], rule) -> DataFrame:
    """(key, piece, rows, summary): the rows of each session in order, at most ``PIECE`` in a piece; pieces ascend. The order is
    part of the key that rows are dealt by, so one session fills as many partitions as it needs."""
    own = ", ".join(f"`{f.name}`: {f.dataType.simpleString()}" for f in df.schema)

    def run(batches):
        nth = TaskContext.get().partitionId() << 32
        held = None  # rows that may go on in the next batch
        for batch in batches:
            table = pa.Table.from_batches([batch] if held is None else [held, batch]).combine_chunks()
            keys = table.column(key).combine_chunks()
            codes = pa.compute.fill_null(keys.dictionary_encode(null_encoding="encode").indices, -1).to_numpy(zero_copy_only=False)
            cuts = [0, *(np.flatnonzero(np.diff(codes)) + 1).tolist(), len(codes)]
            for a, b in zip(cuts, cuts[1:], strict=False):
                while b - a > PIECE or (b - a > 0 and b < len(codes)):
                    yield piece(table.slice(a, min(PIECE, b - a)), nth)
                    nth, a = nth + 1, min(b, a + PIECE)
                rest = a
            held = table.slice(rest).combine_chunks().to_batches()[0] if rest < len(codes) else None
        if held is not None:
            yield piece(pa.Table.from_batches([held]), nth)

    def piece(table: pa.Table, nth: int) -> pa.RecordBatch:
        batch = table.combine_chunks().to_batches()[0]
        rows = pa.StructArray.from_arrays(batch.columns, fields=list(batch.schema))
        found = pa.array([rule.summary(*(batch.column(c) for c in rule.reads))], pa.list_(pa.int64()))
        return pa.RecordBatch.from_arrays([batch.column(key).slice(0, 1), pa.array([nth]), pa.ListArray.from_arrays(pa.array([0, len(rows)], pa.int32()), rows), found], ["key", "piece", "rows", "summary"])

    kind = df.schema[key].dataType.simpleString()
    dealt = df.repartitionByRange(key, *order).sortWithinPartitions(key, *order)
    return dealt.mapInArrow(run, f"key {kind}, piece bigint, rows array<struct<{own}>>, summary array<bigint>")


def entered(pieces: DataFrame, rule) -> DataFrame:
    """(piece, state): what enters each piece, null in a session's first: one pass over summaries alone."""

    def run(batches):
        at, state, fresh = None, None, True
        for batch in batches:
            out = []
            for k, summary in zip(batch.column("key").to_pylist(), batch.column("summary").to_pylist(), strict=True):
                if fresh or k != at:
                    at, state, fresh = k, None, False
                out.append(state)
                state = rule.leave(state, summary)
            yield pa.RecordBatch.from_arrays([batch.column("piece"), pa.array(out, pa.list_(pa.int64()))], ["piece", "state"])

    return pieces.select("key", "piece", "summary").repartition("key").sortWithinPartitions("key", "piece").mapInArrow(run, "piece bigint, state array<bigint>")


def fold(df: DataFrame, key: str, order: list[str], rule, to: str = "kept") -> DataFrame:
    """Adds ``to``, the rule's choice (boolean unless the rule says otherwise); an existing column of that name is replaced. ``order`` has to settle the order
    within a session, as equal rows may be dealt to either side of a boundary. Rows with a null key are one session.
    An empty table gives no rows. The pieces are written once to the shared folder."""
    spark, kept = df.sparkSession, df.select(*(c for c in df.columns if c != to))
    path = shared(spark, "pieces")
    packed(kept, key, order, rule).write.parquet(path)
    pieces = spark.read.parquet(path)
    own = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema)

    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                rows = batch.column("rows")[i].values
                columns = rows.flatten()
                names = [f.name for f in rows.type]
                found = rule.kept(batch.column("state")[i].as_py(), *(columns[names.index(c)] for c in rule.reads))
                yield pa.RecordBatch.from_arrays([*columns, pa.array(found, getattr(rule, "made", pa.bool_()))], [*names, to])

    return pieces.select("piece", "rows").join(entered(pieces, rule), "piece").select("rows", "state").mapInArrow(run, f"{own}, `{to}` {getattr(rule, 'kind', 'boolean')}")
