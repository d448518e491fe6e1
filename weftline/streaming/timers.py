"""Rules with clocks on streams: what ends when nothing comes, after a pause, an idle time, a total time or at a sweep.

A session's rows wait in its state until the watermark has passed them, so they are taken in order of time whatever the
micro-batches were and however rows were mixed within the watermark's delay. Timers on event time wake a session for its
next waiting row or for what its rule awaits, so ends are told without a further row of that session. A rule is a few
functions of a small state, and gives the rows that its batch query gives.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from contextlib import contextmanager
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

PACKED = 1 << 17  # rows of a task that are packed at a time
STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class Pauses:
    """A pause (click) that nothing follows within ``grace``, or that a new utterance (signup) follows, makes a final result
    of the last text heard (view, purchase)."""

    reads, state = "kind string", "heard bigint, pause bigint, since bigint"
    gives = "event_id bigint, text string, at_us bigint, ended_by string"

    def __init__(self, grace: int):
        self.grace = grace

    def _final(self, state, at, why):
        return state[1], "" if state[0] is None else f"text {state[0]}", at, why

    def due(self, state):
        return None if state is None or state[2] is None else state[2] + self.grace

    def fire(self, state):
        return (state[0], None, None), [self._final(state, self.due(state), "grace")]

    def step(self, state, us, event_id, kind):
        heard, pause, _ = state or (None, None, None)
        out = [self._final(state, us, "superseded")] if pause is not None and kind == "signup" else []
        heard = event_id if kind in ("view", "purchase") else heard
        return ((heard, event_id, us) if kind == "click" else (heard, None, None)), out


class Ends:
    """A stream ends after ``idle`` without a message or ``total`` after its first one, whichever comes first; a message
    at that very time is still in time. What comes after the end is not part of it."""

    reads, state = "kind string", "first bigint, last bigint, n bigint, over boolean"
    gives = "why string, at_us bigint, n_turns bigint"

    def __init__(self, idle: int, total: int):
        self.idle, self.total = idle, total

    def due(self, state):
        return None if state is None or state[3] else min(state[1] + self.idle, state[0] + self.total)

    def fire(self, state):
        at = self.due(state)
        return (*state[:3], True), [("idle" if at == state[1] + self.idle else "total", at, state[2])]

    def step(self, state, us, event_id, kind):
        if state is None:
            return (us, us, 1, False), []
        return (state if state[3] else (state[0], us, state[2] + 1, False)), []


class Lives:
    """What a session remembers lasts until a reset (error), or until the first of the sweeps, ``every`` apart, at which it
    has been idle for more than ``timeout``; a row before that sweep keeps it alive. The state is gone with it."""

    reads, state = "kind string", "first bigint, last bigint, n bigint"
    gives = "first_us bigint, last_us bigint, n_turns bigint, ended_by string, at_us bigint"

    def __init__(self, timeout: int, every: int):
        self.timeout, self.every = timeout, every

    def due(self, state):
        return None if state is None else ((state[1] + self.timeout) // self.every + 1) * self.every

    def fire(self, state):
        return None, [(*state, "expired", self.due(state))]

    def step(self, state, us, event_id, kind):
        first, _, n = state or (us, us, 0)
        return (None, [(first, us, n, "reset", us)]) if kind == "error" else ((first, us, n + 1), [])


class Slices:
    """Packets of bytes in slices of ``size``, up to the final packet; what is left over from one packet waits for the next.
    The last slice has the rest, at the final packet or ``idle`` after the last one; what comes then is dropped."""

    reads, state = "audio binary, final boolean", "upto bigint, rest binary, last bigint, over boolean"
    gives = "slice bigint, audio binary"

    def __init__(self, size: int, idle: int):
        self.size, self.idle = size, idle

    def due(self, state):
        return None if state is None or state[3] else state[2] + self.idle

    def fire(self, state):
        return (state[0], b"", state[2], True), [(state[0], bytes(state[1]))] if state[1] else []

    def step(self, state, us, event_id, audio, final):
        upto, rest, _, over = state or (0, b"", us, False)
        if over:
            return state, []
        whole = bytes(rest) + bytes(audio or b"")
        cut = len(whole) - len(whole) % self.size
        out = [(upto + n, whole[at : at + self.size]) for n, at in enumerate(range(0, cut, self.size))]
        state = upto + len(out), whole[cut:], us, False
        if final:
            state, last = self.fire(state)
            out += last
        return state, out


class Fill:
    """The query in force at each row: the last prompt so far, from another stream than the rows it holds for. A prompt that
    repeats the one in force opens no epoch."""

    reads, state = "kind string, prompt string", "query string, epoch bigint, start bigint, n bigint"
    gives = "t bigint, query string, epoch bigint, query_start bigint"

    def due(self, state):
        return None

    def step(self, state, us, event_id, kind, prompt):
        query, epoch, start, n = state or (None, 0, None, 0)
        if prompt is not None and prompt != query:
            query, epoch, start = prompt, epoch + 1, n + 1
        return (query, epoch, start, n + 1), [(n + 1, query, epoch, start)]


class Slot:
    """Results (signup) of one stream wait in one place for the next response (view, purchase) of another: the last one rides
    on it, those before it are lost."""

    reads, state = "kind string", "n bigint, task bigint, queued bigint"
    gives = "emitted_at bigint, task bigint, n_queued bigint"

    def due(self, state):
        return None

    def step(self, state, us, event_id, kind):
        n, task, queued = state or (0, None, 0)
        if kind == "signup":
            return (n + 1, event_id, queued + 1), []
        if kind not in ("view", "purchase"):
            return (n + 1, task, queued), []
        return (n + 1, None, 0), [] if task is None else [(n + 1, task, queued)]


def drained(rule, state, rows, seen: int | None):
    """The state and the rule's rows after ``rows`` (us, event_id and what it reads) in order and all that is due before ``seen``."""
    out = []
    for us, event_id, *values in rows:
        while (due := rule.due(state)) is not None and due < us:
            state, made = rule.fire(state)
            out += made
        state, made = rule.step(state, us, event_id, *values)
        out += made
    while (due := rule.due(state)) is not None and (seen is None or due < seen):
        state, made = rule.fire(state)
        out += made
    return state, out


class InOrder(StatefulProcessor):
    """Lets a session's rows wait for the watermark and hands them to a rule in order. Rows wait packed, those of a
    micro-batch as one value, as a state's value takes much longer to store and read than a row to pack."""

    def __init__(self, rule):
        self.rule = rule

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "packed binary")
        self.held = handle.getValueState("held", self.rule.state)

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        names = ["us", "event_id", *(f.split()[0] for f in self.rule.reads.split(", "))]
        new = [tuple(r[n] for n in names) for r in rows]
        return self.wait(new)

    def wait(self, new: list[tuple]) -> Iterator[Row]:
        self.waiting.appendValue((pickle.dumps(new),))
        self.handle.registerTimer(min(r[0] for r in new) // 1000 + 1)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        seen = timerValues.getCurrentWatermarkInMs() * 1000
        held = list(self.waiting.get()) if self.waiting.exists() else []
        rows = sorted((r for packed in held for r in pickle.loads(bytes(packed[0]))), key=lambda r: r[:2])
        rest = [r for r in rows if r[0] >= seen]
        before = self.held.get() if self.held.exists() else None
        state, out = drained(self.rule, before, rows[: len(rows) - len(rest)], seen)
        if len(rest) < len(rows):
            self.waiting.put([(pickle.dumps(rest),)]) if rest else self.waiting.clear()
        if state is not None:
            self.held.update(state)
        elif before is not None:
            self.held.clear()
        due = self.rule.due(state)
        wake = [x // 1000 + 1 for x in (rest[0][0] if rest else None, due) if x is not None]
        if wake:
            self.handle.registerTimer(min(wake))
        named = Row("session", *(f.split()[0] for f in self.rule.gives.split(", ")))
        for r in out:
            yield named(key[0], *r)

    def close(self) -> None:
        pass


class InOrderPacked(InOrder):
    """The same for rows that come packed, as ``packed`` gives them; those that the watermark has passed are lost."""

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        seen = timerValues.getCurrentWatermarkInMs() * 1000
        new = [r for p in rows for r in pickle.loads(bytes(p["packed"])) if r[0] >= seen]
        return self.wait(new) if new else iter(())


def packed(df: DataFrame, reads: str, most: int = PACKED) -> DataFrame:
    """(session, ts, packed): the rows of ``df`` (session, event_id, us and ``reads``), those of a session in a micro-batch as
    one value, of about ``most`` rows of a task at a time, and the newest time among them. Spark hands a stateful function
    its rows cell by cell, which takes many times longer than to pack them here."""
    names = ["us", "event_id", *(f.split()[0] for f in reads.split(", "))]

    def rows_of(held, kind):
        sessions, values = list(held), list(held.values())
        newest = pa.array([max(r[0] for r in v) for v in values], pa.int64())
        return pa.RecordBatch.from_arrays([pa.array(sessions, kind), newest, pa.array([pickle.dumps(v) for v in values], pa.binary())], ["session", "us", "packed"])

    def run(batches):
        held, n = {}, 0
        for batch in batches:
            kind = batch.column("session").type
            for session, *row in zip(*(batch.column(c).to_pylist() for c in ("session", *names)), strict=True):
                held.setdefault(session, []).append(tuple(row))
            n += batch.num_rows
            if n >= most:
                yield rows_of(held, kind)
                held, n = {}, 0
        if held:
            yield rows_of(held, kind)

    dealt = df.select("session", *names).repartition("session")
    out = dealt.mapInArrow(run, f"session {df.schema['session'].dataType.simpleString()}, us bigint, packed binary")
    return out.select("session", F.timestamp_micros("us").alias("ts"), "packed")


def ended(df: DataFrame | list[DataFrame], rule, late: str) -> DataFrame:
    """What ``rule`` gives for each session of a stream (session, event_id, us and what it reads), ``late`` behind its newest
    row of all; of several streams the one that is furthest behind counts, so none runs ahead of another. Rows without a
    time are left out, and so are those that come later than that. Start it within ``timer_store``."""
    every = df if isinstance(df, list) else [df]
    timed = [packed(x.where("us IS NOT NULL AND event_id IS NOT NULL"), rule.reads).withWatermark("ts", late) for x in every]
    one = reduce(DataFrame.unionByName, timed)
    return one.groupBy("session").transformWithState(InOrderPacked(rule), f"session {every[0].schema['session'].dataType.simpleString()}, {rule.gives}", "append", "eventTime")


def first_within(left: DataFrame, right: DataFrame, within: str, late: str) -> DataFrame:
    """(session, event_id, us, first_us): of each row of the stream ``left`` (session, event_id, us) the first row of the stream
    ``right`` (session, us) after it, at most ``within`` later; left rows without one give none; rows of a null session are one session. An interval join behind both
    watermarks keeps a row no longer than that."""
    a = left.select("session", "event_id", "us", F.timestamp_micros("us").alias("ts")).withWatermark("ts", late).alias("a")
    b = right.select("session", F.col("us").alias("first_us"), F.timestamp_micros("us").alias("ts")).withWatermark("ts", late).alias("b")
    met = a.join(b, F.expr(f"a.session <=> b.session AND b.ts > a.ts AND b.ts <= a.ts + INTERVAL {within}"))
    first = met.groupBy(F.col("a.session").alias("session"), "event_id", "us", F.window("a.ts", "1 second")).agg(F.min("first_us").alias("first_us"))
    return first.select("session", "event_id", "us", "first_us")


@contextmanager
def timer_store(spark: SparkSession):
    """The state store that keeps timers, for the queries started within; the session's own comes back after."""
    before = spark.conf.get(STORE, None)
    spark.conf.set(STORE, ROCKS)
    try:
        yield
    finally:
        spark.conf.unset(STORE) if before is None else spark.conf.set(STORE, before)
