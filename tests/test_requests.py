"""Requests, paths, references, results, readers and converter rules on edge rows; character references and delegations
against brute force."""

import html as stdlib
import json
import re

import pytest
from pyspark.sql import functions as F

from weftline.functions import audio, html, jsontext, messages, paths, values
from weftline.functions import text as X
from weftline.operators import convert, slots
from weftline.plans import registry
from weftline.sinks import files
from weftline.sources import readers


def column(spark, rows, make, kind="string"):
    df = spark.createDataFrame(list(enumerate(rows)), f"i int, x {kind}")
    return [r.y for r in df.select("i", make(F.col("x")).alias("y")).orderBy("i").collect()]


def test_character_references(spark):
    rows = [None, "", "plain", "&amp;lt; &lt &ltfoo &amp", "&eacute;&Eacute&notit;&notin;", "&#233;&#xE9;&#Xe9 &#0;&#13;&#128;&#129;&#159;", "&#xD800;&#1114112;&#99999999999999999999;&#11;&#1;&#xFDD0;&#x1FFFF;&#65x", "& &; &# &#; &#x; &a &nosuchname; &copycat", "&NotEqualTilde;&bne;", "a&b&&c;&amp;&quot;", "x" * 40 + "&" + "y" * 40]
    assert column(spark, rows, html.unescape) == [r and stdlib.unescape(r) for r in rows]


def test_pages_behind_fences(spark):
    got = column(spark, [None, "```html\n<p>x</p>\n```", "```\n<html>a</html>b\n```", "&lt;p&gt;x", "text"], html.document)
    assert [g and (g.complete, "<p>x" in g.doc or g.doc == "<html>a</html>") for g in got] == [None, (True, True), (True, True), (True, True), None]


def test_rich_content(spark):
    chart = '{"type": "bar_chart", "labels": ["a"], "values": [1]}'
    got = column(spark, ["", "say", chart, f"```json\n{{}}\n```\n```json\n{chart}\n```\n```html\n<p>x", f"```json\n{chart[:-1]}\n```"], html.rich)
    assert [(g.html is not None, g.html_incomplete, g.chart and g.chart.labels) for g in got] == [(False, None, None), (False, None, None), (False, None, ["a"]), (True, True, ["a"]), (False, None, None)]


MESSAGES = "array<struct<role: string, text: string, parts: array<struct<type: string, text: string, url: string>>>>"


def test_prompts_and_images(spark):
    part = lambda kind, text=None, url=None: (kind, text, url)
    rows = [
        [],
        None,
        [("user", " a ", None), ("assistant", "b", None)],
        [("user", "old", None), ("user", None, [part("text", " x "), part("text", None), part("image_url", None, "file:///a%20b.png"), part("text", "y")])],
        [("user", None, [part("image_url", None, "file://other/a.png"), part("image_url", None, "data:image/png;base64,AA")]), ("user", None, [part("text", "no image"), part("image_url", None, "")])],
        [("user", None, []), ("system", "s", None)],
    ]
    assert column(spark, rows, messages.user_prompt, MESSAGES) == ["", "", "a", "x\ny", "no image", ""]
    refs = [[(r.kind, r.value) for r in x or ()] for x in column(spark, rows, messages.image_refs, MESSAGES)]
    assert refs == [[], [], [], [("path", "/a b.png")], [("data_url", "file://other/a.png"), ("data_url", "data:image/png;base64,AA")], []]
    own = [[(r.kind, r.value) for r in x or ()] for x in column(spark, rows, lambda m: messages.image_refs(m, F.lit(" /l.png ")), MESSAGES)]
    assert own[3] == [("path", "/l.png"), ("path", "/a b.png")] and own[4] == [("path", "/l.png")] and own[0] == [("path", "/l.png")]
    faults = column(spark, ["data:image/png;base64,A", "data:image/png;base64,", "http://x"], lambda u: messages.ref_fault(messages.image_ref(u)))
    assert faults == [None, "invalid data URL format", "invalid data URL format"]


def test_images_split_at_any_depth(spark):
    big = "data:image/png;base64," + "A" * 200
    got = column(spark, [[], ["a", big, "data:image/x", big, None]], messages.marked, "array<string>")
    assert [[p.text for p in g] for g in got] == [[], ["a", "__image_0__", "data:image/x", "__image_1__", None]]


def test_paths(spark):
    import posixpath

    rows = ["/", "/a/./b//c/", "/a/../../b", "/a/b/..", "/é/.x"]
    assert column(spark, rows, paths.normal) == [posixpath.normpath(r) for r in rows]
    assert column(spark, ["/a/b.TXT", "/a.b/c", "/.hidden", "x.tar.gz", ""], paths.suffix) == ["txt", "", "", "gz", ""]
    assert column(spark, ["*", " ", "/a:/b, /a/,", None], paths.roots) == [None, [], ["/a", "/b"], None]
    got = column(spark, ["/a", "/ab", "/a/x", "/"], lambda p: F.concat_ws(",", paths.under(p, F.lit("/a")).cast("string"), paths.under(p, F.lit("/")).cast("string")))
    assert got == ["true,true", "false,true", "true,true", "false,true"]
    assert column(spark, ["x.png"], lambda p: paths.image_fault(p, F.lit(True), F.array().cast("array<string>"))) == ["disabled"]
    assert column(spark, [None, " ", "a/b", "/c/./d"], lambda p: paths.save_dir(p, "/r")) == [None, None, "/r/a/b", "/c/d"]
    assert column(spark, ["/r/output", "/r/output_x", "/r/other/"], paths.light_dir) == ["/r/output_light", "/r/output_light_x", "/r/other_light"]
    assert column(spark, ["rtsp://u:p@h", "rtsp://h/a", None], paths.without_password) == ["rtsp://u:****@h", "rtsp://h/a", None]
    assert column(spark, ["abcd", "abcde", "EMPTY", ""], paths.last_four) == ["EMPTY", "***bcde", "EMPTY", "EMPTY"]
    assert column(spark, ["é", 'a"\\b'], lambda n: paths.disposition("inline", n)) == ["inline; filename=\"download\"; filename*=UTF-8''%C3%A9", "inline; filename=\"a__b\"; filename*=UTF-8''a%22%5Cb"]


def brute_delegation(raw):
    low, tag = raw.lower(), "<|background_call|>"
    marks = r"(?i)\s*\[[^\]]*\b(?:User\s+(?:Query|Prompt|Request)|IMPORTANT)\b[^\]]*\]\s*"
    if tag in raw:
        at, payload = raw.index(tag), raw[raw.index(tag) + len(tag) :].strip()
        question = payload
        for i, c in enumerate(payload):
            if c == "{":
                try:
                    found = json.JSONDecoder().raw_decode(payload[i:])[0]
                except ValueError:
                    continue
                if isinstance(found.get("query"), str) and found["query"].strip():
                    question = found["query"].strip()
                break
    else:
        places = [(low.index(t), len(t)) for t in ("</delegation>", "<delegation>") if t in low]
        if not places:
            return None
        at, size = min(places)
        question = raw[at + size :].strip()
    shown = re.sub(r"([:：])\s+", r"\1", re.sub(marks, " ", question).strip())
    if not shown and not (question and not shown):
        return None
    return raw[:at].strip(), shown, question


def test_delegations_against_brute_force(spark):
    rows = ["", "none", "a</delegation>", "a</delegation>q", "A <DELEGATION> q </delegation> r", "x<|background_call|>", 'x<|background_call|>{"query": " q "} t', 'x<|background_call|>{"query": ""} t', 'x<|background_call|>{"query": [1]}', 'x<|background_call|>{ {"query": "in"}', "x </delegation> [User Query (IMPORTANT)]", "</delegation> [important] q", "b </delegation> <|background_call|> last"]
    got = column(spark, rows, X.delegation)
    assert [g and tuple(g) for g in got] == [brute_delegation(r) for r in rows]
    assert column(spark, [None], X.delegation) == [None]
    assert column(spark, [None, "", " [IMPORTANT] ", "mine"], lambda p: X.asked_question(p, F.lit("q"))) == ["q", "q", "q", "mine"]


def test_background_results(spark):
    make = lambda t: X.background_result(F.lit(None).cast("string"), F.lit(None).cast("string"), t, F.lit(None).cast("string"))
    got = column(spark, [None, "", "a <summary> s </summary> b", "<think>only"], make)
    assert [(g.error is None, g.body, g.summary) for g in got] == [(False, None, None), (False, None, None), (True, "a  b", "s"), (True, "only", "")]


def test_times(spark):
    rows = [None, "", "0", "5,6,7", "7.9", "-3.9", " 4 ,5", "abc", "1,,2", "1e1"]
    assert column(spark, rows, X.parse_times) == [[], [], [0], [5, 6, 7], [7], [-3], [4, 5], None, [1, 2], [10]]


def test_converter_rules(spark):
    samples = spark.createDataFrame([("late", 10), ("cut", 400), ("bad", 10), ("fine", 10), ("none", 5), ("order", 10)], "session string, duration bigint")
    events = [("late", 1, "3", "q"), ("late", 2, "10.9", "r"), ("late", 3, "11", "r"), ("cut", 1, "500,2", "q"), ("bad", 1, "99", "r"), ("bad", 2, "x", "q"), ("fine", 1, "10", "r"), ("fine", 2, "9", "r"), ("fine", 3, "-1,4,4", "q"), ("order", 1, "12", "r"), ("order", 2, "13", "q")]
    events = spark.createDataFrame([(*e, f"c{e[1]}") for e in events], "session string, ord bigint, time string, kind string, content string")
    assert {tuple(r) for r in convert.rejects(samples, events).select("session", "reason", "first_late").collect()} == {("late", "late r", 11), ("bad", "bad time", None), ("order", "late q", 13)}
    grid = {(r.session, r.sec): (r.question, r.answer) for r in convert.grid(samples, events).collect()}
    assert len(grid) == 320 + 10 + 5
    assert grid["fine", 9] == ("", "</response> c2") and grid["fine", 4][0] == "c3" and grid["cut", 2][0] == "c1" and grid["none", 0] == ("", "</silence>")
    assert [tuple(r) for r in convert.truncated(samples, events).collect()] == [("cut", 400, 320, 320)]


def test_canonical_hash(spark):
    same = [{"a": "1", "b": "2"}, {"b": "2", "a": "1"}, {"a": "1", "b": "3"}, {}]
    got = column(spark, same, jsontext.canonical_hash, "map<string,string>")
    assert got[0] == got[1] and len(set(got)) == 3


def test_agent_digest(spark):
    lines = ['{"type": "thread.started", "thread_id": "a"}', '{"type": "thread.started", "thread_id": ""}', "[1]", "", '{"item": {"type": "web_search"}}', '{"type": "item.completed", "item": {"type": "agent_message", "text": " "}}', '{"type": "turn.completed", "usage": 5}', '{"type": "x", "item": "no"}']
    log = spark.createDataFrame([(1, i, line) for i, line in enumerate(lines)] + [(None, 0, "{}"), (2, 0, None)], "session bigint, line_no bigint, line string")
    got = {r.session: r for r in jsontext.agent_digest(log).collect()}
    assert (got[1].events, got[1].items) == ("item.completed=1,thread.started=2,turn.completed=1,unknown=1,x=1", "agent_message=1,web_search=1")
    assert (got[1].thread_id, got[1].usage, got[1].last_message, got[1].n_searches, got[1].n_commands, got[1].n_errors) == ("a", None, None, 1, 0, 2)
    assert got[2].n_errors == 1 and None in got


def test_slots(spark):
    assert column(spark, [None, "", "a b", "abcde"], lambda t: slots.token_count(t, lambda ts: [t.split() for t in ts])) == [0, 0, 2, 1]
    assert column(spark, [None, "", "abcde"], lambda t: slots.token_count(t, None)) == [0, 0, 1]
    asked = []

    def model(texts):
        asked.extend(texts)
        return [t.upper() for t in texts]

    got = column(spark, ["a", None], lambda t: slots.summarised(F.when(t.isNull(), 0).otherwise(1), t, F.lit("0s-9s"), "none in {range}", model))
    assert got == ["A", "none in 0s-9s"]


def test_solver_and_recogniser_slots(spark):
    answers = {"a": '{"text": "A"}', "b": "B", "c": '{"status": "late", "error": "e"}', "d": '{"text": ""}', "e": "[1]"}
    got = column(spark, ["a", None, "b", "c", "d", "e"], lambda q: slots.solved(q, lambda qs: [answers[x] for x in qs]))
    empty = "Background service returned empty text"
    assert [g and tuple(g) for g in got] == [(None, "A", ""), None, (None, "B", ""), ("e", None, None), (empty, None, None), (empty, None, None)]
    rows = [bytearray(b"\1\2"), None, bytearray(), bytearray(b"\1")]
    assert column(spark, rows, lambda x: slots.transcribed(x, 8000, lambda xs, rate: [f"{len(x)}@{rate}" for x in xs]), "binary") == ["2@8000", None, None, None]


def test_solver_reads_an_answer_once(spark):
    made = spark.createDataFrame([("a",)], "x string").select(slots.solved(F.col("x"), lambda qs: qs).alias("y"))
    plan = made._jdf.queryExecution().analyzed().toString()
    assert [plan.count(x) for x in ("from_json", "regexp_instr(", "<summary")] == [1, 4, 3]  # not once for each field and step


def test_payload_reads_an_output_once(spark):
    every = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x10FFFF)]))
    assert column(spark, [every], lambda x: F.regexp_replace(x, f"(?:(?!{X.WS})[\\s\\S])+", "")) == ["".join(sorted(X.BLANKS))]
    texts = ["\u3000a b\x85", "\r\r\n \x1c", "", None, "x" + " " * 200_000 + "y"]  # a long run of blanks within took minutes
    assert column(spark, texts, X.bare) == ["a b", "", "", None, texts[-1]]
    assert column(spark, [f"{X.RESPONSE}\r {t}" for t in ("a\rb", " ", texts[-1])], lambda x: X.response_payload(X.normalise_output(x))) == ["a", None, "x y"]
    plan = spark.createDataFrame([("a",)], "x string").select(X.response_payload(X.normalise_output(F.col("x"))).alias("y"))._jdf.queryExecution().analyzed().toString()
    assert plan.count("regexp_extract(") == 1


def test_speech(spark):
    got = column(spark, [None, "  ", "hello  world, hello"], audio.speech_messages)
    assert [[tuple(m) for m in g or ()] for g in got] == [[], [("error", None)], [("append", "hello world,"), ("append", " hello"), ("commit", None)]]
    back = column(spark, ["t", None], lambda t: audio.read_asr(audio.asr_result(F.lit("m"), t, F.lit("IS_END"), F.lit(0), F.lit("ok"))))
    assert [tuple(b) for b in back] == [("IS_END", "t", "ok", 0), ("IS_END", None, "ok", 0)]
    config = column(spark, [None, " glad "], lambda e: values.speech_config(F.lit(None).cast("string"), e, F.lit(None).cast("string"), F.lit(24000), F.lit("mp3"), "alto"))
    assert [tuple(c) for c in config] == [("", "alto", "output format"), ("glad", "alto", "output format")]


def test_speech_reads_a_text_once(spark):
    text = "".join(f"w{i}  \t" for i in range(900)) + "😀é\n" * 99
    said = " ".join(text.split())[:2000]
    assert column(spark, [text, "", None, "😀" * 13], X.speech_parts) == [[said[i : i + 12] for i in range(0, len(said), 12)], [], None, ["😀" * 12, "😀"]]
    for made in (X.speech_parts, audio.speech_messages):  # not once for each part
        plan = spark.createDataFrame([("a",)], "x string").select(made(F.col("x")).alias("y"))._jdf.queryExecution().analyzed().toString()
        assert plan.count("regexp_replace(") == 1


@pytest.mark.parametrize("name", ["tts_chunks", "tts_messages"])
def test_speech_of_whole_texts(spark, tmp_path, name):
    text = "".join(f"w{i} 😀 " for i in range(3000)).strip()
    spark.createDataFrame([(1, text), (2, " a  b ")], "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    rows = registry.queries()[name](spark, str(tmp_path)).collect()
    part = {(r.id, r.place if name == "tts_chunks" else r.seq): r.part if name == "tts_chunks" else r.text for r in rows}
    assert ["".join(part[i, k] or "" for i, k in sorted(part) if i == n) for n in (1, 2)] == [text, "a b"]


def test_response_records_of_all_outputs(spark, tmp_path):
    texts = {0: "a", 2: "a", 4: "plain\nmore", 8: "a", 14: " \n", 24: "a </silence> b", 34: "</silence>", 44: "</response>\n\n", 54: None, 3: "a"}
    spark.createDataFrame(list(texts.items()), "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    assert sorted(r.id for r in registry.queries()["response_records"](spark, str(tmp_path)).collect()) == [2, 4, 8]
    assert column(spark, ["</response> a\n b\n\nc", "x\ry", "a </silence>\nb", " "], lambda x: X.normalise_output(x, whole=True)) == ["</response> a b c", "</response> x y", "</silence>", "</silence>"]


def test_settings(spark):
    assert column(spark, [None, "x", "-5", "100", "900", "9999"], lambda x: values.long_edge(x, 640)) == [640, 640, 0, 256, 900, 2048]
    assert column(spark, [None, "x", "0", "7", "900"], lambda x: values.frame_limit(x, 30)) == [None, None, 30, 7, 100]
    assert column(spark, [None, -1.0, 0.5, 99.0], lambda x: values.frame_rate(x, 1.0), "double") == [1.0, 1.0, 0.5, 60.0]


def test_annotation_files(spark, tmp_path):
    row = {"video_name": "v", "video_path": "p", "question": [{"content": "q", "time": "4"}]}
    (tmp_path / "example.json").write_text(json.dumps(row))
    (tmp_path / "other.txt").write_text(json.dumps([row, row]))
    (tmp_path / "broken.json").write_text('[{"video_name": ')
    read = lambda p: readers.annotations(spark, str(p)).count()
    assert (read(tmp_path / "example.json"), read(tmp_path / "other.txt"), read(tmp_path)) == (1, 2, 0)
    assert [(r.file[-11:], r.n_chars) for r in readers.annotation_faults(spark, str(tmp_path)).collect()] == [("broken.json", 16)]
    (tmp_path / "f").mkdir()
    for i in (10, 2, 1):
        (tmp_path / "f" / f"frame_{i:06d}.jpg").write_bytes(b"x")
    assert [[n[-10:] for n in r.names] for r in readers.listing(spark, str(tmp_path), "*.jpg").collect()] == [["000001.jpg", "000002.jpg", "000010.jpg"]]


def test_arrays_by_input_file(spark, tmp_path):
    rows = spark.createDataFrame([("a", 2, "y"), ("a", 1, "x"), ("b/c", 1, None)], "rel_path string, ord int, v string")
    out = tmp_path / "out"
    files.write_arrays(rows, str(out))
    got = sorted((json.loads(p.read_text()) for p in out.rglob("part-*") if not p.name.endswith("crc")), key=str)
    assert got == [[{"v": "x"}, {"v": "y"}], [{}]]


@pytest.mark.parametrize("name", ["html_entities"])
def test_queries_without_sql(spark, name):
    from weftline.plans import registry

    got = {r.page_id: r.text for r in registry.queries()[name](spark, "/root/testdata/sf0.001").collect()}
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet").collect()
    assert got == {p.page_id: stdlib.unescape("&amp;lt; &eacute;&#233;&#xE9; &notit; &copy &#0;&#128; " + (p.html or "")) for p in pages}
