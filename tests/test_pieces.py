"""Rules over pieces of sessions against the plain fold, row by row."""

import numpy as np
import pyarrow as pa
import pytest

from weftline.operators import folds, pieces

FRAMES = "session bigint, event_id bigint, us bigint, cost bigint, wall bigint, key string, piece string, rows array<int>"


def plain(rule, columns):
    """The choices of the step functions, in order."""
    step, state = (folds.busy_step, None) if isinstance(rule, pieces.Busy) else (folds.late_step(rule.most, rule.after), None)
    out = []
    for values in zip(*columns, strict=True):
        state, ok = step(state, *values)
        out.append(ok)
    return out


@pytest.mark.parametrize("seed", range(40))
def test_summaries(seed):
    r = np.random.default_rng(seed)
    n = int(r.integers(1, 300))
    us = np.sort(r.integers(0, int(r.choice([20, 300, 5000])), n))
    cost = r.integers(0, int(r.choice([1, 5, 60])), n)
    wall = us + np.cumsum(r.integers(-3, 4, n)) + (r.random(n) < 0.2) * r.integers(0, 40, n)
    for rule, columns in ((pieces.Busy("cost"), (us, cost)), (pieces.Late("wall", int(r.integers(1, 12)), int(r.choice([0, 1, 2, 5, 30]))), (us, wall))):
        want = plain(rule, [c.tolist() for c in columns])
        size, state, got = int(r.integers(1, 40)), None, []
        for at in range(0, n, size):
            part = [pa.array(c[at : at + size]) for c in columns]
            got += rule.kept(state, *part).tolist()
            state = rule.leave(state, rule.summary(*part))
        assert got == want


def test_one_session_over_many_pieces(spark, monkeypatch):
    monkeypatch.setattr(pieces, "PIECE", 50)
    r = np.random.default_rng(7)
    rows = []
    for session, n in ((1, 3000), (2, 1), (3, 49), (None, 51), (4, 100)):
        us = np.sort(r.integers(0, 20 * n, n))
        wall = us + np.cumsum(r.integers(-3, 4, n))
        rows += [(session, len(rows) + i, int(u), int(r.integers(0, 90)), int(w), "clash", "clash", [1]) for i, (u, w) in enumerate(zip(us, wall, strict=True))]
    r.shuffle(rows)
    df = spark.createDataFrame([tuple(x) for x in rows], FRAMES)
    for new, step, reads in (
        (folds.throttle(df, 37), folds.throttle_step(37), ["us"]),
        (folds.busy_skip(df, "cost"), folds.busy_step, ["us", "cost"]),
        (folds.late_drop(df, "wall", 9, 4), folds.late_step(9, 4), ["us", "wall"]),
    ):
        old = folds.ordered_fold(df, "session", ["us", "event_id"], reads, lambda: None, step)
        assert new.columns == old.columns and sorted(map(repr, new.collect())) == sorted(map(repr, old.collect()))
    assert folds.throttle(df.limit(0), 5).count() == 0
    assert folds.late_drop(df, "wall", 0).where("kept").count() == len(rows)


def test_a_million_rows_of_one_session(spark):
    df = spark.range(1_000_000).selectExpr("1L AS session", "id AS event_id", "id * 40 + id * 7919 % 37 AS us", "(id * 31 % 100) * 10 AS cost", "id * 40 + id * 7919 % 37 + id * 104729 % 400 AS wall")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "8")
    try:
        for new, step, reads in ((folds.busy_skip(df, "cost"), folds.busy_step, ["us", "cost"]), (folds.late_drop(df, "wall", 150, 2), folds.late_step(150, 2), ["us", "wall"])):
            old = folds.ordered_fold(df, "session", ["us", "event_id"], reads, lambda: None, step)
            both = new.where("kept").select("event_id").unionAll(old.where("kept").select("event_id")).groupBy("event_id").count()
            assert both.where("count <> 2").count() == 0 and both.count() > 10_000
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_no_times():
    busy = pieces.Busy("cost")
    columns = pa.array([None, 3, 5, 9], pa.int64()), pa.array([1, None, 4, 1], pa.int64())
    assert busy.kept(None, *columns).tolist() == [False, True, True, True]
    nothing = pa.array([None, None], pa.int64()), pa.array([1, 1], pa.int64())
    assert busy.summary(*nothing) == [] and busy.leave([4], []) == [4] and busy.leave(None, []) is None


def test_budget_over_many_files(spark, monkeypatch):
    from weftline.operators import convert

    r = np.random.default_rng(11)
    files = [(f"f{i:06d}", r.integers(0, 9)) for i in range(100_000)]
    ok = [r.random(n) < 0.001 for _, n in files]
    for most in (0, 7, 300):
        left, want = most, []
        for (name, _), flags in zip(files, ok, strict=True):
            taken = [(name, i) for i, x in enumerate(flags[:left]) if x]
            left -= len(taken)
            want += taken
        if most == 7:  # small inputs, small pieces
            monkeypatch.setattr(pieces, "PIECE", 10)
        rows = [(name, i, bool(x)) for (name, _), flags in zip(files, ok, strict=True) for i, x in enumerate(flags)]
        df = spark.createDataFrame(pa.table({"file": [x[0] for x in rows], "n": [x[1] for x in rows], "ok": [x[2] for x in rows]}))
        assert sorted((x.file, x.n) for x in convert.within_budget(df, "file", "n", most).collect()) == want
        assert len(want) == min(most, sum(int(x.sum()) for x in ok)) or left > 0
