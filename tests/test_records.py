"""Edge rows of JSON, links, WAV, ranges, readers, sinks and stream sessions."""

import json
import wave

import pytest
from pyspark.sql import functions as F

from weftline.functions import audio, html, jsontext
from weftline.functions import text as X
from weftline.operators import convert, links
from weftline.plans import record_queries
from weftline.sinks import files
from weftline.sources import readers
from weftline.streaming import folds


def column(spark, values, f, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, x {kind}")
    return [r[0] for r in df.orderBy("i").select(f(F.col("x"))).collect()]


def test_first_object(spark):
    got = column(spark, [None, "", "{", "{x} [1]", 'a {"b": {"a": 1}, "a": 2} {"c": 3}', '{"a": {1} {"z": 0}'], jsontext.first_object)
    assert got == [None, None, None, None, '{"a": 2, "b": {"a": 1}}', '{"z": 0}']


def test_flexible_text(spark):
    got = column(spark, [None, "", " plain ", '" a "', "7", '[{"text": ""}, {"content": [{"value": "v"}]}, "s"]', '{"text": " ", "content": "c"}', "{}"], jsontext.flexible_text)
    assert got == ["", "", "plain", "a", "7", "v", "c", "{}"]


@pytest.mark.parametrize("text, want", [
    ("see /a/b.txt.", "see [b.txt](/api/local-file?path=%2Fa%2Fb.txt)."),
    ("`/a/b.txt` and x/a/b.txt", "`/a/b.txt` and x/a/b.txt"),
    ("(/a/b.txt)", "(/api/local-file?path=%2Fa%2Fb.txt)"),
    ("/a/none.txt", "/a/none.txt"),
    ("```\n/a/b.txt", "```\n/a/b.txt"),
    (None, ""),
])
def test_links(spark, text, want):
    df = spark.createDataFrame([(1, text, "p"), (None, text, "q")], "id bigint, text string, path string")
    got = {r.id: r.text for r in links.rewrite(df, spark.createDataFrame([("/a/b.txt",), ("/a/b.txt",), (None,)], "path string")).collect()}
    assert got[1] == want and len(got) == 2


def test_times(spark):
    got = column(spark, ["<1s>", "x <1.25 seconds ~ 3s> y", "2s-4.05s", "2s ~ 4 second", "2", "", None, "now"], X.time_range)
    assert got == ["1.0 seconds", "1.3 seconds ~ 3.0 seconds", "2.0 seconds-4.1 seconds", "2.0 seconds ~ 4.0 seconds", None, None, None, None]
    assert column(spark, ["a ~ b-c", "a-b-c", " a "], X.split_range) == [("a", "b-c"), ("a", "b-c"), ("a", "a")]
    assert column(spark, ["1.2", "1.x.3", "v", "1.10rc"], X.version) == [[1, 2], [1], [], [1, 10]]


def test_text_rules(spark):
    assert column(spark, ["<think>a", "a<think>b</think>c", "x\nAnswer: y", None], X.strip_reasoning) == ["a", "ac", "y", None]
    assert column(spark, [" q  r\n\n\n\ns ", "[IMPORTANT] a", "[imported] a"], X.clean_question) == ["q r\ns", "a", "[imported] a"]
    assert column(spark, ["a<summary>总结: b</summary>c", " n "], X.split_summary) == [("b", "ac"), ("", "n")]
    assert column(spark, ["", "See a chart! Yes.", "x" * 300], lambda c: X.handoff(F.lit("q"), c, None, 200)) == ["", "用户委托问题: q\n\n核心内容摘录:\nYes.", "用户委托问题: q\n\n核心内容摘录:\n" + "x" * 80 + "\n...[已截断]"]


def test_html(spark):
    got = column(spark, ["", "plain", "<p>a", "<html>a", "```html\n<p>...</p>\n```\n```html\n<div>long enough</div>\n```", "```html\n<p>open", '```json\n{"type": "html", "html": "<p>j"}\n```', '```json\n{"type": "bar_chart"}\n```'], html.best)
    assert [g and (g.place, g.complete) for g in got] == [None, None, (0, True), (0, False), (-1, True), (0, False), (0, True), None]


def test_wav(spark, tmp_path):
    made = column(spark, [bytearray(b"\x01\x00\x02\x00"), bytearray()], lambda c: audio.wav(c, 16000), "binary")
    path = tmp_path / "a.wav"
    path.write_bytes(made[0])
    with wave.open(str(path)) as w:
        assert (w.getnchannels(), w.getsampwidth(), w.getframerate(), w.readframes(9)) == (1, 2, 16000, b"\x01\x00\x02\x00")
    (tmp_path / "b.wav").write_bytes(b"no")
    got = {r.path[-5:]: (r.rate, r.pcm and bytes(r.pcm), r.reason) for r in readers.wav(spark, str(tmp_path)).collect()}
    assert got == {"a.wav": (16000, b"\x01\x00\x02\x00", None), "b.wav": (None, None, "no wav")}


def test_readers(spark, tmp_path):
    row = {"video_name": "v", "video_path": "p", "question": [{"content": "q", "time": "4"}]}
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "1.json").write_text(json.dumps([row | {"response": [{"content": "r", "time": "7"}]}, row | {"response": [[{"content": "s", "time": "1"}], []]}]))
    (tmp_path / "2.json").write_text(json.dumps(row))
    (tmp_path / "example.json").write_text(json.dumps(row))
    got = sorted(tuple(e.content for e in r.response or ()) for r in readers.annotations(spark, str(tmp_path)).collect())
    assert got == [(), ("r",), ("s",)]
    (tmp_path / "log.jsonl").write_text('{"type": "t", "item": {"type": "i", "text": "x"}}\nbroken {\n[1]\n')
    assert sorted((r.type or "", r.item_type or "", r.valid) for r in readers.log_lines(spark, str(tmp_path / "log.jsonl")).collect()) == [("", "", False), ("", "", False), ("t", "i", True)]
    assert column(spark, [2, 0], lambda c: readers.frame_names(F.lit("d"), c), "int") == [["d/frame_000000.jpg", "d/frame_000001.jpg"], []]


def test_converted_files_are_left_alone(spark, tmp_path):
    out = str(tmp_path / "out")
    rows = lambda *r: spark.createDataFrame(list(r), "rel_path string, n int")
    files.write_converted(rows(("a", 1)), out)
    files.write_converted(rows(("a", 2), ("b", 3)), out)
    read = lambda: sorted((r.rel_path, r.n) for r in spark.read.schema("n int, rel_path string").json(out).collect())
    assert read() == [("a", 1), ("b", 3)]
    files.write_converted(rows(("b", 4)), out, rewrite=True)
    assert read() == [("a", 1), ("b", 4)]


def test_large_arrays_are_written_in_pieces(spark, tmp_path):
    samples = spark.createDataFrame([(f"{i % 2}.json", 500 - i, i, "x" * 300) for i in range(200)], "rel_path string, ord int, n int, text string")
    few, many = tmp_path / "few", tmp_path / "many"
    files.write_arrays(samples, str(few))
    files.write_arrays(samples, str(many), 5000)
    for k in (0, 1):
        want = [{"n": i, "text": "x" * 300} for i in reversed(range(200)) if i % 2 == k]
        (whole,) = (few / f"rel_path={k}.json" / "piece=0").glob("*.txt")
        assert json.loads(whole.read_text()) == want
        assert whole.read_text().strip() == samples.where(f"n % 2 = {k}").agg(F.to_json(F.transform(F.array_sort(F.collect_list(F.struct("ord", F.struct("n", "text").alias("r")))), lambda x: x.r), {"pretty": "true"})).first()[0]
        pieces = sorted((many / f"rel_path={k}.json").glob("piece=*"), key=lambda p: int(p.name[6:]))
        parts = [f.read_text() for p in pieces for f in p.glob("*.txt")]
        assert len(parts) == len(pieces) > 5 and max(map(len, parts)) < 6000  # an input file was one value and one file, whatever its size
        assert [x for part in parts for x in json.loads(part)] == want
    assert spark.read.schema("n int").option("multiLine", True).json(str(many)).count() == 200


def test_budget_against_a_loop(spark):
    rows = [(i % 3, i, i * 7 % 5 != 0) for i in range(40)]
    df = spark.createDataFrame(rows, "file bigint, n bigint, ok boolean")
    for most in (0, 5, 20, 100):
        left, want = most, []
        for f in range(3):
            taken = [r for r in sorted(r for r in rows if r[0] == f)[: max(left, 0)] if r[2]]
            left -= len(taken)
            want += taken
        assert sorted(map(tuple, convert.within_budget(df, "file", "n", most).collect())) == sorted(want)


def test_stream_sessions_and_state_across_batches(spark, tmp_path):
    parts = [[(1, 1, 0), (2, 2, 0), (1, 3, 5_000_000)], [(1, 4, 11_000_000)], [(2, 5, 100_000_000)], [(2, 6, 200_000_000)]]
    schema, src = "session bigint, event_id bigint, us bigint", tmp_path / "in"
    src.mkdir()
    kept, ended = str(tmp_path / "kept"), str(tmp_path / "ended")
    for part in parts:  # one file a run: the state is carried by the checkpoint
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(str(src))
        stream = spark.readStream.schema(schema).parquet(str(src))
        files.write_stream(folds.throttle(stream, 10_000_000), kept, kept + "-state")
        files.write_stream(folds.sessions(stream, "20 seconds", "0 seconds"), ended, ended + "-state")
    assert sorted(r.event_id for r in spark.read.parquet(kept).where("kept").collect()) == [1, 2, 4, 5, 6]
    assert sorted((r.session, r.last_us, r.n_turns) for r in spark.read.parquet(ended).collect()) == [(1, 11_000_000, 3), (2, 0, 1), (2, 100_000_000, 1)]


def test_first_json_against_brute_force(spark):
    sf = "/root/testdata/sf0.001"

    def brute(text):
        for i in range(len(text)):
            for j in range(len(text), i + 1, -1):
                if text[i] == "{" and text[j - 1] == "}":
                    try:
                        return json.dumps(json.loads(text[i:j]), ensure_ascii=False, sort_keys=True)
                    except ValueError:
                        pass

    want = {r.event_id: brute(f"log {{x}} {r.props} tail {{") for r in spark.read.parquet(f"{sf}/events.parquet").collect()}
    assert {r.event_id: r.found for r in record_queries.first_json(spark, sf).collect()} == want
