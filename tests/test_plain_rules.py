"""Rules on markers, times, fences and charts, on odd inputs, against plain statements of them."""

import json
import math
import random
import re

import pytest
from pyspark.sql import functions as F

from weftline.functions import html, messages
from weftline.functions import text as X


def column(spark, rows, make):
    df = spark.createDataFrame([(i, x) for i, x in enumerate(rows)], "i int, x string")
    return [r.y for r in df.select("i", make(F.col("x")).alias("y")).orderBy("i").collect()]


def mixed(parts, n, most, seed):
    r = random.Random(seed)
    return ["".join(r.choice(parts) for _ in range(r.randint(0, most))) for _ in range(n)]


def output(raw):
    text = re.sub("\r\n?", "\n", raw or "").strip()
    first = {m: text.find(m) for m in ("</response>", "</silence>") if m in text}
    marker = min(first, key=first.get, default=None)
    if not text or marker == "</silence>":
        return "</silence>"
    said = (text[first[marker] + len(marker) :] if marker else text).strip()
    line = " ".join(said.splitlines()[0].split()) if said else ""
    return f"</response> {line}" if line else "</response>"


def test_outputs(spark):
    blanks = ["\n", "\t", " ", "\r", "\x0b", "\x0c", "\x1c", "\x1f", "\x85", "\xa0", " ", " ", "　"]
    rows = [None, "", "\n", "\t\t", *blanks, "</response>", "</response>\n", "a\x0bb", *mixed([*blanks, "a", "b c", "</response>", "</silence>"], 800, 9, 1)]
    assert column(spark, rows, X.normalise_output) == [output(t) for t in rows]


def numeric(part):
    """What float() makes of ASCII text, else None."""
    try:
        return float(part)
    except ValueError:
        return None


def times(text):
    found = [numeric(p.strip()) for p in (text or "").split(",") if p.strip()]
    return None if any(v is None or not math.isfinite(v) for v in found) else [int(v) for v in found]


def start(text):
    head = re.split("[-~]", text or "", maxsplit=1)[0].strip()
    v = numeric(re.sub(r"\s*seconds?\Z", "", head).strip().removesuffix("s"))
    return -1.0 if v is None else v


PARTS = ["5", "12", ".", ",", "e", "E2", "s", "d", "f", "nan", "inf", "infinity", "+", "-", "_", " ", "\t", "\xa0", "x", "0"]


def test_times(spark):
    rows = [None, "", ",", "5,,6", "5,", " ", "5d", "1f", "nan", "inf", "-inf", "1e1", "1_0,2", "1__0", ".5", "5.", "0x1p3", "+7.9", "5\x0b,6", *mixed([*PARTS, ",", "5"], 800, 5, 2)]
    assert column(spark, rows, X.parse_times) == [times(t) for t in rows]
    assert column(spark, ["1e30", "-1e30"], X.parse_times) == [[9_200_000_000_000_000_000], [-9_200_000_000_000_000_000]]  # held within a long


def test_starts(spark):
    rows = [None, "", "<5.0 seconds>", "1e1s", ".5s", "5 second", "0s-10s", "5.0 seconds ~ 9", "5ss", "5 s", "-5s", "seconds", "5seconds\n", "nan", "infs", "+inf s", *mixed([*PARTS, "seconds", "second", "~", "<", ">"], 800, 5, 3)]
    got = column(spark, rows, X.start_second)
    assert [repr(v) for v in got] == [repr(start(t)) for t in rows]


def blocks(text, language, unclosed):
    out, at = [], 0
    while (at := text.find("```", at)) >= 0:
        head = re.compile(r"[ \t]*([a-zA-Z0-9_-]*)[ \t]*\r?\n?").match(text, at + 3)
        at = head.end()
        end = text.find("```", at)
        if language in ("", head.group(1).lower()) and (end >= 0 or unclosed):
            out.append((text[at : end if end >= 0 else len(text)].strip(), end < 0))
    return out


@pytest.mark.parametrize(("language", "unclosed"), [("html", False), ("html", True), ("json", False), ("", True)])
def test_fences(spark, language, unclosed):
    rows = ["", "``` html\nx```", "```html <p>a</p>```", "```htmlx\ny```", "```HTML\r\n a \n", "````html\nb````", "```html a```html b```", *mixed(["```", "`", "html", "json", " ", "\n", "\r\n", "x", "<p>", "-"], 600, 12, 4)]
    got = column(spark, rows, lambda x: html.fences(x, language, unclosed))
    assert [[tuple(b) for b in r] for r in got] == [blocks(t, language, unclosed) for t in rows]


def bars(text):
    try:
        made = json.loads(text)
    except ValueError:
        return None
    if not isinstance(made, dict) or made.get("type") != "bar_chart":
        return None
    labels, values = made.get("labels"), made.get("values")
    if not isinstance(labels, list) or not isinstance(values, list) or len(labels) != len(values):
        return None
    try:
        return str(made.get("title") or ""), [str(x) for x in labels], [float(v) for v in values]
    except (TypeError, ValueError):
        return None


def test_charts(spark):
    one = lambda **changed: json.dumps({"type": "bar_chart", "title": "T", "labels": ["a"], "values": [1]} | changed)
    rows = [one(), one(title=None), one(title=""), one(title="0"), one(title=0), one(title=7), one(title=False), one(title=True), one(title=1.5), one(values=[True]), one(values=["1d"]), one(values=["2.5"]), one(values=[None]), one(values=[[1]]), one(values=["x"]), one(values=[" 3 "])]
    rows += [one(labels=[1]), one(labels=[True]), one(labels=[None]), one(labels=[2.5]), one(labels=["true"]), one(labels=["a", "b"]), one(labels="a"), one(labels=[], values=[]), one(type="pie"), one(type=None), "[]", "{", "", '{"type": "bar_chart"}']
    got = column(spark, rows, html.chart)
    assert [g and tuple(g) for g in got] == [bars(t) for t in rows]


def test_whole_answers_come_first(spark):
    chart = lambda name: json.dumps({"type": "bar_chart", "title": name, "labels": [], "values": []})
    rows = [f" {chart('whole')} ", f"``` json {chart('block')}```", '{"note": "```json\\n' + chart("inner").replace('"', '\\"') + '\\n```"}', chart("a") + f"\n```json\n{chart('b')}\n```"]
    assert [g.chart and g.chart.title for g in column(spark, rows, html.rich)] == ["whole", "block", None, "b"]


def test_labels_by_language(spark):
    got = column(spark, ["en", "zh", "de", None], messages.prompt_labels)
    assert [tuple(g) for g in got] == [("Query", "Response"), *[("提问", "回复")] * 3]


def test_types_by_the_standard_table(spark):
    from mimetypes import MimeTypes

    from weftline.functions import paths

    ends = sorted(MimeTypes().types_map[True])
    rows = [f"/w/a{e}" for e in ends] + [f"/w.d/b{e.upper()}" for e in ends] + ["/a/.gz", "/a/x.tar.gz", "/a/x.txt.gz", "/a/x.tgz", "/a/X.TGZ", "/a/x.svgz", "/a/x.Z", "/a/x.html.z", "/a/..txt", "/a/.a.txt", "/a/x", "/a/x.", "/a.txt/x", "x.py", "x.unknown", "/a/.tar.bz2", "/a/y.c.xz"]
    want = [MimeTypes().guess_type(p)[0] or "application/octet-stream" for p in rows]
    got = column(spark, rows, paths.content_type)
    assert [(p, g) for p, g in zip(rows, got, strict=True)] == list(zip(rows, want, strict=True))


def test_result_records(spark):
    from weftline.functions import results

    rows = [None, "", "plain <summary>s</summary> text", '"quoted"', "[]", '{"text": ""}', '{"text": 0, "answer": "a"}', '{"text": "t", "summary_text": ["x", {"text": "总结：y"}], "rich": [1]}', '{"status": "bad", "error": 7}', '{"text": "t", "metrics": {"usage": null, "own": [1]}, "usage": 3, "rich": {"k": 1}}', '{"text": {"value": "<think>x</think>v"}, "summary_text": "", "background_summary": "b"}']
    df = spark.createDataFrame(list(enumerate(rows)), "i int, raw string")
    got = [tuple(x.r) for x in results.result_records(df, "raw", "r").orderBy("i").collect()]
    run = lambda **more: {"thread_id": "null", "usage": "null", "duration_ms": "null", "events_digest": "null"} | more
    empty = "Background service returned empty text"
    assert got == [
        (None, "", "", None, {}),
        (None, "", "", None, {}),
        (None, "plain  text", "s", None, {}),
        (None, "quoted", "", None, {}),
        (None, "", "", None, {}),
        (empty, None, None, None, None),
        (None, "a", "", None, run()),
        (None, "t", "y", None, run()),
        ("7", None, None, None, None),
        (None, "t", "", '{"k":1}', run(usage="null", own="[1]")),
        (None, "v", "b", None, run()),
    ]


def walked(node, images):
    if isinstance(node, str) and node.startswith("data:image/") and len(node) > 200:
        images.append(node)
        return f"__image_{len(images) - 1}__"
    if isinstance(node, list):
        return [walked(x, images) for x in node]
    return {k: walked(v, images) for k, v in node.items()} if isinstance(node, dict) else node


def test_images_at_any_depth(spark):
    r = random.Random(9)
    image = lambda n: "data:image/png;base64," + "Ab+/="[r.randrange(5)] * (n - 22)

    def node(depth):
        kind = r.randrange(6 if depth else 4)
        if kind < 4:
            return [image(200), image(201), image(300), 'say "data:image/" \\ \\/ é\n'][kind]
        inside = [node(depth - 1) for _ in range(r.randrange(4))]
        return inside if kind == 4 else {image(300) if i == 2 else f"k{9 - i}": x for i, x in enumerate(inside)}

    made = [node(4) for _ in range(200)] + [{"a": image(3_000_000)}, "x", 1, None]
    rows = [json.dumps(m, ensure_ascii=i % 2 == 0) for i, m in enumerate(made)]
    rows = [t.replace("/", "\\/") if i % 7 == 0 and "\\" not in t else t for i, t in enumerate(rows)]
    got = column(spark, [*rows, None, "{", ""], messages.without_images)
    for m, g in zip(made, got, strict=False):
        images = []
        want = walked(m, images)
        assert json.loads(g.record) == want and [x.image for x in g.images] == images and [x.key for x in g.images] == [f"__image_{i}__" for i in range(len(images))]
    assert got[-3:] == [None, None, None]
