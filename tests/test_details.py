"""Settings, addresses, labels and model slots on edge rows; wrapping against brute force."""

import base64

import numpy as np
from pyspark.sql import functions as F

from weftline.functions import values
from weftline.operators import slots


def column(spark, make, rows):
    df = spark.createDataFrame([(i, x) for i, x in enumerate(rows)], "i int, x string")
    return [r.y for r in df.select("i", make(F.col("x")).alias("y")).orderBy("i").collect()]


def test_bounded(spark):
    assert column(spark, lambda x: values.bounded(x, 10, 1, 100), [None, "", "x", "12.5", " 7 ", "-3", "+4", "999", "9" * 30]) == [10, 10, 10, 10, 7, 1, 4, 100, 10]


def test_flags(spark):
    rows = [None, "", " YES\t", "on", "No", "0", "maybe"]
    assert column(spark, lambda x: values.is_yes(x, False), rows) == [False, False, True, True, False, False, False]
    assert column(spark, lambda x: values.is_not_no(x, False), rows) == [False, True, True, True, False, False, True]


def test_voice(spark):
    assert column(spark, lambda x: values.voice(x, "a"), [None, "", " default", "Default", " b "]) == ["a", "a", "a", "Default", "b"]


def test_image_bytes(spark):
    good = base64.b64encode("é\0".encode("latin-1")).decode()
    got = column(spark, values.image_bytes, [None, "", good, "data:image/png;base64," + good, "data:image/png;base64,", "data:image/png;base64,@@", "data:text/plain;base64," + good, "data:image/png," + good])
    assert [None if x is None else bytes(x) for x in got] == [None, None, None, b"\xe9\0", b"", None, None, None]


def test_percent_encoded(spark):
    assert column(spark, values.percent_encoded, [None, "", "/a b+c*~é%"]) == [None, "", "%2Fa%20b%2Bc%2A~%C3%A9%25"]


def test_joined_range(spark):
    made = spark.createDataFrame([(0, ["a", "a"]), (1, ["a", None, "b", "a"]), (2, []), (3, [None])], "i int, x array<string>")
    assert [r.y for r in made.select("i", values.joined_range(F.col("x")).alias("y")).orderBy("i").collect()] == ["a", "a ~ b ~ a", "", ""]


def brute_lines(text, width):
    lines, line, used = [], [], 0
    for word in text.split():
        if used + len(word) + 1 > width:
            lines.append(line)
            line, used = [], -1
        line.append(word)
        used += len(word) + 1
    return "\n".join(" ".join(x) for x in [*lines, line] if x)


def test_wrapped(spark):
    r = np.random.default_rng(5)
    rows = [" ".join("x" * n for n in r.integers(1, 70 if i % 3 == 0 else 12, i * 5)) for i in range(30)]
    got = column(spark, values.wrapped, [None, "", " \n", *rows, " ".join(["word"] * 50_000)])
    assert got[:3] == [None, "", ""] and got[3:-1] == [brute_lines(t, 60) for t in rows]
    assert len(got[-1].split()) == 50_000


def test_model_slots(spark):
    model = lambda texts: [f"{t}!" for t in texts if t is not None]
    assert column(spark, lambda x: slots.asked(x, model), ["a", None, "", "a"]) == ["a!", None, "!", "a!"]
    assert column(spark, lambda x: slots.asked(x, model), [None, None]) == [None, None]
    df = spark.createDataFrame([(1, None, "p"), (2, "q", "p"), (3, "q", None)], "t int, query string, prompt string")
    assert [r.output for r in slots.decided(df, "query", "prompt", model).orderBy("t").collect()] == ["</silence>", "p!", None]
    assert slots.decided(df.limit(0), "query", "prompt", model).count() == 0
    rows = spark.createDataFrame([(1, 2, "l2", "b"), (1, 1, "l1", "a"), (2, 1, "l1", None)], "k int, t int, label string, text string")
    got = {r.k: r.body for r in slots.compressed(rows, ["k"], "t", "label", "text", model).collect()}
    assert got == {1: "<l1 - l2>\na\nb!", 2: "<l1 - l1>\n!"}
