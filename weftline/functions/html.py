"""Column functions on HTML answers and chart JSON."""

from __future__ import annotations

import json
from functools import reduce
from html.entities import html5
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

from weftline.functions.text import bare, let, number, strip


# The tags that make a fragment a page, that show something, and that count.
FRAGMENT = r"(?i)<(?:head|body|main|section|style|div|h1|p)\b"
SHOWS = r"(?i)<(?:body|main|section|article|aside|header|footer|nav|div|h[1-6]|p|button|ul|ol|li|span|img|figure|table)\b"
COUNTED = r"(?i)<(?:div|section|main|header|nav|footer|button|h[1-6]|p|li)\b"
HEAD, FOOT = '<!doctype html>\n<html><head><meta charset="UTF-8"></head><body>', "</body></html>"


END_TAG = r"(?i)</html[ \t\r\n]*>"


def _names() -> Column:
    """The names of character references, the standard library's table, as a constant map."""
    return F.from_json(F.lit(json.dumps(html5)), "map<string,string>")


def _numbered(n: Column) -> Column:
    """The character of a numeric reference: those of Windows' code page for 128 to 159, the replacement character for
    none, nothing for control characters and what is no character."""
    old = {0: "\ufffd", 13: "\r"} | {i: bytes([i]).decode("cp1252", "ignore") or chr(i) for i in range(128, 160)}
    table = F.from_json(F.lit(json.dumps({str(k): v for k, v in old.items()})), "map<string,string>")
    none = n.between(1, 8) | n.between(14, 31) | n.between(127, 159) | n.between(0xFDD0, 0xFDEF) | (n == 11) | (n % 0x10000 >= 0xFFFE)
    char = F.decode(F.unhex(F.lpad(F.hex(n), 8, "0")), "UTF-32")
    return F.coalesce(F.try_element_at(table, n.cast("string")), F.when(n.isNull() | n.between(0xD800, 0xDFFF) | (n > 0x10FFFF), "\ufffd").when(none, "").otherwise(char))


def unescape(x: Column) -> Column:
    """Character references as the characters they stand for, the longest known name first; what names none stays."""
    names = _names()
    found = lambda value, size: F.when(value.isNotNull(), F.struct(value.alias("value"), size.alias("size")))

    def piece(p):
        ref = F.regexp_extract(p, r"^(#[0-9]+;?|#[xX][0-9a-fA-F]+;?|[^\t\n\f <&#;]{1,32};?)", 1)
        digits, hexes = F.regexp_extract(ref, "^#([0-9]+)", 1), F.regexp_extract(ref, "^#[xX]([0-9a-fA-F]+)", 1)
        number = F.when(digits != "", digits.try_cast("bigint")).otherwise(F.conv(hexes, 16, 10).try_cast("bigint"))
        shorter = [F.when(F.length(ref) > n, found(F.try_element_at(names, F.left(ref, F.lit(n))), F.lit(n))) for n in range(6, 1, -1)]
        named = F.coalesce(found(F.try_element_at(names, ref), F.length(ref)), *shorter)
        hit = F.when((digits != "") | (hexes != ""), F.struct(_numbered(number).alias("value"), F.length(ref).alias("size"))).when(ref != "", named)
        return let(hit, lambda h: F.when(h.isNull(), F.concat(F.lit("&"), p)).otherwise(F.concat(h["value"], F.substr(p, h["size"] + 1))))

    def read(v):
        pieces = F.split(v, "&")
        return F.concat(F.get(pieces, F.lit(0)), F.array_join(F.transform(F.slice(pieces, F.lit(2), F.size(pieces)), piece), ""))

    return let(x, lambda v: F.when(F.contains(v, F.lit("&")), read(v)).otherwise(v))


def left_open(x: Column) -> Column:
    """Whether a html, body, head or style tag is opened and never closed."""
    return reduce(or_, [F.rlike(x, F.lit(rf"(?i)<{t}\b")) & ~F.rlike(x, F.lit(rf"(?i)</{t}[ \t\r\n]*>")) for t in ("html", "body", "head", "style")])


def document(x: Column, cut: bool = False) -> Column:
    """struct(doc, complete): from the doctype or html tag to its end tag, or else to the end and then incomplete; a
    fragment is wrapped; null for text without markup. ``cut``: the source ended early."""
    made = lambda d, ok: F.struct(d.alias("doc"), ok.alias("complete"))

    def page(v):
        start = F.regexp_instr(v, F.lit(r"(?i)<!doctype[ \t\r\n]+html\b|<html\b"))
        fragment = F.when(F.rlike(v, F.lit(FRAGMENT)), made(F.concat(F.lit(HEAD), v, F.lit(FOOT)), ~left_open(v) & F.lit(not cut)))
        return F.when(start > 0, let(F.substr(v, F.greatest(start, F.lit(1))), to_end)).otherwise(fragment)

    def to_end(rest):
        end = F.regexp_instr(rest, F.lit(END_TAG))
        return F.when(end > 0, made(F.substr(rest, F.lit(1), end - 1 + F.length(F.regexp_extract(rest, END_TAG, 0))), F.lit(True))).otherwise(made(rest, F.lit(False)))

    opened = lambda v: strip(F.regexp_replace(v, r"(?i)^```[ \t]*(?:html)?[ \t]*\r?\n?", ""))
    closed = lambda v: strip(F.regexp_replace(v, r"\r?\n?```[ \t]*$", ""))
    return let(closed(opened(strip(unescape(x)))), page)


def tags(doc: Column) -> Column:
    """How many blocks, headings, paragraphs, items and buttons a document opens."""
    return F.regexp_count(doc, F.lit(COUNTED)).cast("bigint")


def score(doc: Column, complete: Column) -> Column:
    """Long, complete, styled documents with a body and many tags score high; every ellipsis costs, more where it is
    all that an element holds."""
    part = lambda test, n: F.when(test, n).otherwise(0)
    total = F.least(F.length(doc), F.lit(20000)) + part(complete, 5000) + part(F.rlike(doc, F.lit("(?i)<style")), 2500) + part(F.rlike(doc, F.lit("(?i)<body")), 1500) + part(F.rlike(doc, F.lit(SHOWS)), 1500)
    dots = F.regexp_count(doc, F.lit(r"\.\.\.|\x{2026}")) * 3000 + F.regexp_count(doc, F.lit(r">[ \t\r\n]*\.\.\.[ \t\r\n]*<")) * 5000
    return (total + F.least(120 * tags(doc), F.lit(3000)) - dots).cast("bigint")


def fences(x: Column, language: str = "", unclosed: bool = False) -> Column:
    """array<struct(text, incomplete)> of an answer's fenced blocks of a language, or of all, in order: from each fence that
    names it to the next fence, white space off the ends. A closing fence that names a language opens a block as well.
    With ``unclosed`` a last block without a fence behind it counts and is incomplete."""
    mark = r"```[ \t]*([a-zA-Z0-9_-]*)[ \t]*\r?\n?"
    part = lambda g: F.regexp_extract_all(x, F.lit(rf"(?s){mark}(?=(.*?)(```|\z))"), F.lit(g))
    found = F.filter(F.arrays_zip(part(1).alias("language"), part(2).alias("text"), part(3).alias("close")), lambda b: (F.lower(b["language"]) == language if language else F.lit(True)) & ((b["close"] != "") | F.lit(unclosed)))
    return F.transform(found, lambda b: F.struct(bare(b["text"]).alias("text"), (b["close"] == "").alias("incomplete")))


def candidates(x: Column) -> Column:
    """Documents an answer holds, in order: its fenced html blocks, an open last one cut, and JSON blocks of type html;
    or else the whole answer."""
    page = F.transform(fences(x, "html", True), lambda b: F.when(b["incomplete"], document(b["text"], True)).otherwise(document(b["text"])))
    in_json = F.transform(fences(x, "json"), lambda b: F.when(F.get_json_object(b["text"], "$.type") == "html", document(F.get_json_object(b["text"], "$.html"))))
    found = F.filter(F.concat(page, in_json), lambda d: d.isNotNull())
    return let(found, lambda f: F.when(F.size(f) > 0, f).otherwise(F.filter(F.array(document(x)), lambda d: d.isNotNull())))


def best(x: Column) -> Column:
    """struct(score, place, doc, complete) of the candidate with the highest score, the first of equals; null where
    an answer holds no markup."""
    scored = F.transform(candidates(x), lambda d, i: F.struct(score(d["doc"], d["complete"]).alias("score"), (-i).alias("place"), d["doc"].alias("doc"), d["complete"].alias("complete")))
    return F.array_max(scored)


def rich(x: Column) -> Column:
    """struct(html, html_incomplete, chart): the best page of an answer and its first valid chart; null parts where it has
    none. A whole answer that is JSON comes before its JSON blocks."""
    whole = F.filter(F.array(bare(x)), lambda b: F.startswith(b, F.lit("{")) & F.endswith(b, F.lit("}")))
    blocks = F.concat(whole, F.transform(fences(x, "json"), lambda b: b["text"]))
    charts = F.filter(F.transform(blocks, chart), lambda c: c.isNotNull())
    return let(best(x), lambda b: F.struct(b["doc"].alias("html"), (~b["complete"]).alias("html_incomplete"), F.get(charts, F.lit(0)).alias("chart")))


def fenced(x: Column, language: str) -> Column:
    """The first closed block of a language; null if there is none or it is empty."""
    return F.nullif(F.get(fences(x, language), F.lit(0))["text"], F.lit(""))


def _kind(v: Column) -> Column:
    return F.regexp_extract(F.schema_of_variant(v), "^[A-Z]*", 0)


def _shown(v: Column) -> Column:
    """A JSON value as text: strings as they are, true as True, null as None, fractions with a point."""
    kind, text = _kind(v), F.try_variant_get(v, "$", "string")
    fraction = F.try_variant_get(v, "$", "double").cast("string")
    return F.when(kind == "BOOLEAN", F.initcap(text)).when(kind == "VOID", "None").when(kind.isin("DECIMAL", "DOUBLE", "FLOAT"), fraction).otherwise(text)


def chart(text: Column) -> Column:
    """struct(title, labels, values) of a valid bar chart: lists of one length whose values are numbers, or text that names
    one, or true and false; else null. Labels and a title that is not empty, zero or false are shown as text."""
    whole = F.try_parse_json(text)
    each = lambda name: F.try_variant_get(whole, f"$.{name}", "array<variant>")
    value = lambda v: F.when(_kind(v) == "BOOLEAN", F.try_variant_get(v, "$", "boolean").cast("double")).when(_kind(v) == "STRING", number(F.try_variant_get(v, "$", "string"))).when(_kind(v).isin("BIGINT", "DECIMAL", "DOUBLE", "FLOAT"), F.try_variant_get(v, "$", "double"))
    values, labels = F.transform(each("values"), value), F.transform(each("labels"), _shown)
    title = F.try_variant_get(whole, "$.title", "variant")
    told = F.when(title.isNull() | _kind(title).isin("VOID") | _shown(title).isin("", "False", "0", "0.0", "-0.0", "[]", "{}"), "").otherwise(_shown(title))
    told = F.when((_kind(title) == "STRING"), F.try_variant_get(title, "$", "string")).otherwise(told)
    ok = (_kind(F.try_variant_get(whole, "$.type", "variant")) == "STRING") & (F.try_variant_get(whole, "$.type", "string") == "bar_chart")
    ok = ok & (F.size(labels) == F.size(values)) & labels.isNotNull() & values.isNotNull() & F.forall(values, lambda v: v.isNotNull())
    return F.when(ok, F.struct(told.alias("title"), labels.alias("labels"), values.alias("values")))
