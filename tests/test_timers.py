"""Rules with clocks: streams in any cut and with mixed rows give what the rule gives on sorted rows."""

import os
import pickle
import random
from types import SimpleNamespace

import pytest
from pyspark.sql import Row

from weftline.functions import audio
from weftline.sinks import files
from weftline.streaming import timers

SCHEMA = "session bigint, event_id bigint, us bigint, kind string"
KINDS = ["view", "click", "signup", "purchase", "error"]


@pytest.mark.parametrize("rule", [timers.Pauses(3_000_000), timers.Ends(9_000_000, 60_000_000), timers.Lives(6_000_000, 5_000_000)], ids=["pauses", "ends", "lives"])
def test_streams_equal_sorted_rows(spark, tmp_path, rule):
    r = random.Random(3)
    rows = sorted((r.randrange(0, 120_000_000, 1000), i, r.randrange(6), r.choice(KINDS)) for i in range(160))
    rows = sorted([*rows, (rows[5][0], 1000, rows[5][2], "click")])  # a tie
    rows.append((400_000_000, 1001, -1, "view"))  # moves the watermark past all
    want = []
    for s in {x[2] for x in rows} - {-1}:
        own = sorted((us, i, kind) for us, i, session, kind in rows if session == s)
        want += [(s, *x) for x in timers.drained(rule, None, own, None)[1]]
    mixed = [x[1] for x in sorted(enumerate(rows), key=lambda x: x[0] + r.randrange(3))]  # within the delay
    src = tmp_path / "in"
    for n, at in enumerate(range(0, len(mixed), 41)):
        spark.createDataFrame([(s, i, us, k) for us, i, s, k in mixed[at : at + 41]], SCHEMA).coalesce(1).write.parquet(f"{src}/{n}")
        for f in (src / str(n)).iterdir():
            os.utime(f, (1_000_000 + 10 * n,) * 2)
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(str(src))
    out = timers.ended(stream, rule, "20 seconds")
    before = spark.conf.get(timers.STORE)
    with timers.timer_store(spark):
        files.write_stream(out, f"{tmp_path}/out", f"{tmp_path}/state")
    assert spark.conf.get(timers.STORE) == before
    got = spark.read.schema(out.schema).parquet(f"{tmp_path}/out").where("session >= 0").collect()
    assert sorted(map(tuple, got)) == sorted(want) and len(want) > 5


class Held:
    """A state without Spark that counts what it is given."""

    def __init__(self):
        self.values, self.calls = [], 0

    def exists(self):
        return bool(self.values)

    def get(self):
        return iter(self.values)

    def appendValue(self, v):
        self.values, self.calls = [*self.values, v], self.calls + 1

    def put(self, v):
        self.values = list(v)

    def clear(self):
        self.values = []


def test_rows_wait_as_one_value_a_batch():
    rule = timers.Ends(5_000, 1_000_000)
    own = timers.InOrder(rule)
    own.waiting, one = Held(), Held()
    own.handle = SimpleNamespace(registerTimer=lambda at: None)
    own.held = SimpleNamespace(exists=one.exists, get=lambda: one.values[0], update=lambda v: one.put([v]), clear=one.clear)
    rows = [(us, i, "view") for i, us in enumerate(range(0, 400_000, 4_000))]
    for part in (rows[1::2], rows[::2]):
        assert list(own.handleInputRows((7,), iter([Row(us=u, event_id=i, kind=k) for u, i, k in part]), None)) == []
    assert own.waiting.calls == 2  # was a value a row
    clock = lambda ms: SimpleNamespace(getCurrentWatermarkInMs=lambda: ms)
    assert list(own.handleExpiredTimer((7,), clock(200), None)) == [] and len(own.waiting.values) == 1
    assert [tuple(r) for r in own.handleExpiredTimer((7,), clock(10_000), None)] == [(7, *x) for x in timers.drained(rule, None, rows, None)[1]]


def test_rows_come_packed_one_value_a_session(spark):
    rows = [(None if i % 5 == 0 else i % 5, i, 7_000_000 - i, None if i % 7 == 0 else "view") for i in range(2000)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    got = timers.packed(df, "kind string").collect()
    assert sorted(r.session or 0 for r in got) == [0, 1, 2, 3, 4]  # was a row of the stateful step for each of 2,000
    for r in got:
        want = sorted((us, i, kind) for session, i, us, kind in rows if session == r.session)
        assert sorted(pickle.loads(bytes(r.packed)), key=lambda x: x[:2]) == want and r.ts.microsecond == want[-1][0] % 1_000_000
    assert sum(len(pickle.loads(bytes(r.packed))) for r in timers.packed(df, "kind string", 100).collect()) == 2000
    assert timers.packed(df.limit(0), "kind string").count() == 0


def test_packed_rows_that_the_watermark_has_passed_are_lost():
    own = timers.InOrderPacked(timers.Ends(5_000, 1_000_000))
    own.waiting, own.handle = Held(), SimpleNamespace(registerTimer=lambda at: None)
    clock = SimpleNamespace(getCurrentWatermarkInMs=lambda: 3)
    come = [[(2_999, 1, "view"), (3_000, 2, "view")], [(4_000, 3, "view")], [(10, 4, "view")]]
    for part in (come[:2], come[2:]):
        assert list(own.handleInputRows((7,), iter([Row(packed=pickle.dumps(x)) for x in part]), clock)) == []
    assert [pickle.loads(v[0]) for v in own.waiting.values] == [[(3_000, 2, "view"), (4_000, 3, "view")]]


def test_edges_of_time():
    ends = timers.Ends(10, 25)
    assert timers.drained(ends, None, [(0, 1, "a"), (10, 2, "a"), (21, 3, "a")], None)[1] == [("idle", 20, 2)]
    assert timers.drained(ends, None, [(0, 1, "a"), (10, 2, "a"), (20, 3, "a"), (25, 4, "a"), (26, 5, "a")], None)[1] == [("total", 25, 4)]
    lives = timers.Lives(10, 7)
    assert timers.drained(lives, None, [(0, 1, "a"), (14, 2, "a"), (30, 3, "error"), (31, 4, "error")], 100)[1] == [(0, 14, 2, "expired", 28), (30, 30, 0, "reset", 30), (31, 31, 0, "reset", 31)]
    assert timers.drained(lives, None, [(0, 1, "a")], 14) == ((0, 0, 1), []) and timers.drained(lives, None, [], None) == (None, [])
    pauses = timers.Pauses(5)
    assert timers.drained(pauses, None, [(0, 1, "click"), (5, 2, "signup"), (6, 3, "view"), (7, 4, "click")], None)[1] == [(1, "", 5, "superseded"), (4, "text 3", 12, "grace")]


PACKETS = "session bigint, event_id bigint, us bigint, audio binary, final boolean, t bigint"


@pytest.mark.parametrize("cut", [7, 200])
def test_slices_of_any_cut(spark, tmp_path, cut):
    r = random.Random(cut)
    rows = []
    for i in range(120):
        rows.append((r.randrange(4), i, i * 1_000_000, None if i % 17 == 0 else r.randbytes(r.choice([0, 1, 5, 40])), i in (60, 77), i))
    rows.append((9, 500, 10_000_000_000, b"x", True, 500))
    src = tmp_path / "in"
    for n, at in enumerate(range(0, len(rows), cut)):
        spark.createDataFrame(rows[at : at + cut], PACKETS).coalesce(1).write.parquet(f"{src}/{n}")
        for f in (src / str(n)).iterdir():
            os.utime(f, (1_000_000 + 10 * n,) * 2)
    stream = spark.readStream.schema(PACKETS).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(str(src))
    out = timers.ended(stream, timers.Slices(16, 5_000_000_000), "1 second")
    with timers.timer_store(spark):
        files.write_stream(out, f"{tmp_path}/out", f"{tmp_path}/state")
    got = sorted((x.session, x.slice, bytes(x.audio)) for x in spark.read.schema(out.schema).parquet(f"{tmp_path}/out").where("session < 9").collect())
    want = []
    for s in range(4):
        said = b""
        for session, _, _, packet, final, _ in rows:
            if session == s:
                said += packet or b""
                if final:
                    break
        want += [(s, n, said[at : at + 16]) for n, at in enumerate(range(0, len(said), 16))]
    assert got == want
    batch = audio.slices(audio.until_final(spark.createDataFrame(rows[:-1], PACKETS)), 16).collect()
    assert sorted((x.session, x.slice, bytes(x.audio)) for x in batch) == want


def put(spark, rows, schema, place, at):
    """``rows`` as a file of the folder, later than those before."""
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{place}/{at}")
    for f in (place / str(at)).iterdir():
        os.utime(f, (1_000_000 + 10 * at,) * 2)


def test_two_streams_at_their_own_pace(spark, tmp_path):
    r = random.Random(8)
    schema = f"session bigint, event_id bigint, us bigint, {timers.Fill.reads}"
    rows = [(r.randrange(3), i, r.randrange(300) * 1_000_000, "view", None) for i in range(120)]
    prompts = [(r.randrange(3), 1000 + i, r.randrange(300) * 1_000_000, "signup", f"ask {r.randrange(2)}") for i in range(40)]
    end = lambda i: (None, i, 10_000_000_000, "clock", None)
    sources = [(tmp_path / "rows", sorted(rows, key=lambda x: x[2]) + [end(-1)], 30), (tmp_path / "prompts", sorted(prompts, key=lambda x: x[2]) + [end(-2)], 5)]
    for place, own, cut in sources:
        for n, at in enumerate(range(0, len(own), cut)):
            put(spark, own[at : at + cut], schema, place, n)
    streams = [spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(str(place)) for place, _, _ in sources]
    fill, slot, rides = timers.ended(streams, timers.Fill(), "1 second"), timers.ended([s.drop("prompt") for s in streams], timers.Slot(), "1 second"), timers.first_within(streams[1], streams[0], "20 SECONDS", "1 second")
    with timers.timer_store(spark):
        for name, s in (("fill", fill), ("slot", slot), ("rides", rides)):
            files.write_stream(s, f"{tmp_path}/{name}", f"{tmp_path}/{name}-state")
    read = lambda name, s: sorted(tuple(x) for x in spark.read.schema(s.schema).parquet(f"{tmp_path}/{name}").where("session IS NOT NULL").collect())
    for name, s, rule in (("fill", fill, timers.Fill()), ("slot", slot, timers.Slot())):
        want = []
        for k in range(3):
            own = sorted((x[2], x[1], *x[3 : 5 if name == "fill" else 4]) for x in [*rows, *prompts] if x[0] == k)
            want += [(k, *x) for x in timers.drained(rule, None, own, None)[1]]
        assert read(name, s) == sorted(want)
    met = [(k, i, us, min((x[2] for x in rows if x[0] == k and us < x[2] <= us + 20_000_000), default=None)) for k, i, us, *_ in prompts]
    assert read("rides", rides) == sorted(x for x in met if x[3] is not None)
