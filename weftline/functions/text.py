"""Column functions on text: markers, times, names, shortening. White space is the ASCII and Unicode kind."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The control markers.
SILENCE, RESPONSE, DELEGATION = "</silence>", "</response>", "</delegation>"


# White space as Java and RE2 both write it.
WS = r"[\s\x0B\x{1C}-\x{1F}\x{85}\p{Z}]"
# The same characters one by one.
BLANKS = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"


def strip(x: Column) -> Column:
    """Without blanks, tabs and line ends at the ends."""
    return F.trim(x, F.lit(" \t\r\n\x0b\x0c"))


def bare(x: Column) -> Column:
    """Without white space of any kind at the ends."""
    return F.trim(x, F.lit(BLANKS))


# A number as written in plain text: digits in groups, a fraction, an exponent.
DIGITS = "[0-9]+(?:_[0-9]+)*"
NUMBER = rf"[+-]?(?:{DIGITS}(?:\.(?:{DIGITS})?)?|\.{DIGITS})(?:[eE][+-]?{DIGITS})?"


def number(x: Column) -> Column:
    """The double that a text names, by itself but for white space: digits, or an infinity or NaN by name. Null for other text,
    such as Java's ``1d``."""
    text = bare(x)
    named = F.rlike(text, F.lit(r"(?i)^[+-]?(?:inf|infinity|nan)\z"))
    return F.when(F.rlike(text, F.lit(rf"^{NUMBER}\z")), F.replace(text, F.lit("_"), F.lit("")).try_cast("double")).when(named, F.regexp_replace(text, "^[+-](?=[nN])", "").try_cast("double"))


# The characters that end a line.
LINE_END = r"[\n\r\x0B\x0C\x{1C}-\x{1E}\x{85}\x{2028}\x{2029}]"


def let(x: Column, body) -> Column:
    """``body`` of ``x`` evaluated once, however often the body names it."""
    return F.get(F.transform(F.array(x), body), F.lit(0))


def present(x: Column) -> Column:
    """A row for ``x`` unless it is null. As a filter on a computed column would be pushed below and compute it twice."""
    return F.explode(F.filter(F.array(x), lambda v: v.isNotNull()))


def collapse(x: Column) -> Column:
    """Runs of white space as one blank, none at the ends."""
    return F.trim(F.regexp_replace(x, r"(?U)\s+", " "))


def normalise_output(raw: Column, whole: bool = False) -> Column:
    """The canonical output: the earliest of the two markers decides; a response keeps its first line, or all lines as one
    if ``whole``; text without a marker is a response; nothing, or white space alone, is silence."""

    def decided(text):
        silent, said = F.locate(SILENCE, text), F.locate(RESPONSE, text)
        body = bare(F.when(said > 0, F.substr(text, said + len(RESPONSE))).otherwise(text))
        kept = body if whole else F.regexp_extract(body, rf"^{LINE_END.replace('[', '[^', 1)}*", 0)
        line = F.trim(F.regexp_replace(kept, f"{WS}+", " "))
        quiet = (text == "") | ((silent > 0) & ((said == 0) | (silent < said)))
        return let(line, lambda x: F.when(quiet, F.lit(SILENCE)).when(x == "", F.lit(RESPONSE)).otherwise(F.concat(F.lit(RESPONSE + " "), x)))

    ends = F.replace(F.replace(F.coalesce(raw, F.lit("")), F.lit("\r\n"), F.lit("\n")), F.lit("\r"), F.lit("\n"))
    return let(bare(ends), decided)


def response_payload(output: Column) -> Column:
    """What a normalised response says; null for silence and for a response that says nothing."""
    said = lambda v: let(F.trim(F.substr(v, F.lit(len(RESPONSE) + 1))), lambda t: F.nullif(t, F.lit("")))
    return let(output, lambda v: F.when(F.startswith(v, F.lit(RESPONSE)), said(v)))


def seconds_label(seconds: Column) -> Column:
    """``x.y seconds``, rounded half up."""
    return F.format_string("%.1f seconds", F.floor(seconds * 10 + 0.5) / 10)


def start_second(text: Column) -> Column:
    """The number before the first ``-`` or ``~`` of a range such as ``5.0 seconds`` or ``0s-10s``, its unit taken off; -1 where
    there is none."""
    first = bare(F.regexp_extract(text, r"^[^~-]*", 0))
    plain = F.regexp_replace(bare(F.regexp_replace(first, rf"{WS}*seconds?\z", "")), r"s\z", "")
    return F.coalesce(number(plain), F.lit(-1.0))


def compact_seconds(seconds: Column) -> Column:
    """``Ns`` for whole seconds, else up to three decimals without zeros at the end."""
    return F.when(seconds == F.floor(seconds), F.concat(F.floor(seconds).cast("bigint").cast("string"), F.lit("s"))).otherwise(F.concat(F.rtrim(F.format_string("%.3f", seconds), F.lit("0")), F.lit("s")))


def parse_times(text: Column) -> Column:
    """Whole seconds of a list such as ``5,6.7``, cut toward zero; null or nothing between commas gives none, a part that is no
    finite number fails all (null). Seconds beyond a long count as the greatest one."""
    most = 9.2e18
    parts = F.filter(F.split(text, ","), lambda p: bare(p) != "")
    seconds = F.transform(parts, lambda p: let(number(p), lambda d: F.when(~F.isnan(d) & (F.abs(d) < float("inf")), F.greatest(F.lit(-most), F.least(F.lit(most), d)).cast("bigint"))))
    return let(seconds, lambda v: F.when(text.isNull(), F.array().cast("array<bigint>")).when(F.exists(v, lambda x: x.isNull()), F.lit(None)).otherwise(v))


def safe_name(x: Column, default: str = "default", most: int = 120) -> Column:
    """Runs outside ``[A-Za-z0-9_.-]`` become ``_``, dots and underscores go from the ends, ``most`` characters stay."""
    out = F.regexp_replace(F.regexp_replace(F.coalesce(x, F.lit("")), "[^A-Za-z0-9_.-]+", "_"), "^[._]+|[._]+$", "")
    return F.coalesce(F.nullif(F.substring(out, 1, most), F.lit("")), F.lit(default))


def shorten(x: Column, most: int, tail: str = "...", room: int = 3) -> Column:
    """Texts over ``most`` characters are cut ``room`` short of it and end in ``tail``."""
    return F.when(F.length(x) > most, F.concat(F.substring(x, 1, most - room), F.lit(tail))).otherwise(x)


def mask(x: Column) -> Column:
    return F.when(F.length(x) <= 8, F.lit("***")).otherwise(F.concat(F.substring(x, 1, 4), F.lit("..."), F.right(x, F.lit(4))))


# The tags of reasoning, the labels of a final answer, and what is left out of shown questions.
REASONING = "(?:think|thinking|reasoning)"
FINAL = rf"(?im)^{WS}*(?:final answer|answer|final response|最终答案|正式答案|给用户的答案){WS}*[:：]{WS}*"
ROUTING = rf"(?i){WS}*\[[^\]]*\b(?:User{WS}+(?:Query|Prompt|Request)|IMPORTANT)\b[^\]]*\]{WS}*"
PREAMBLE = rf"^{WS}*请(?:回答|解答)这道(?:简答题|数学题|题目|问题)[，,、\s]*(?:并(?:提供|给出)必要的推理过程和最终答案)?[：:]{WS}*"
SUMMARY = r"(?is)<summary\b[^>]*>(.*?)</summary>"
SUMMARY_LABEL = rf"^{WS}*(?:摘要|总结|简要摘要|简述){WS}*[:：]{WS}*"
VISUAL = "(?i)json|代码块|图表数据|绘图数据|可直接用于绘图|可视化数据|chart"
SENTENCE_END = "。！？!?"
CUT_MARK, QUESTION_LABEL, EXCERPT_LABEL = "\n...[已截断]", "用户委托问题: ", "核心内容摘录:\n"


def strip_reasoning(x: Column, reach: int = 4000) -> Column:
    """Without closed reasoning blocks and loose reasoning tags, and from behind the first final-answer label on, if
    it starts within ``reach`` characters."""
    x = strip(F.regexp_replace(x, rf"(?is)<{REASONING}[^>]*>.*?</{REASONING}>", ""))
    x = strip(F.regexp_replace(x, rf"(?i)</?{REASONING}[^>]*>", ""))

    def answer(v):
        behind = lambda at: F.when((at > 0) & (at <= reach + 1), strip(F.substr(v, at + F.length(F.regexp_extract(v, FINAL, 0))))).otherwise(v)
        return let(F.regexp_instr(v, F.lit(FINAL)), behind)

    return let(x, answer)


def clean_question(x: Column) -> Column:
    """A delegated question as shown: no routing marks, no preamble, runs of blanks and empty lines squeezed."""
    x = let(strip(x), lambda v: F.when(F.contains(v, F.lit("[")), F.regexp_replace(v, ROUTING, " ")).otherwise(v))
    x = F.regexp_replace(F.regexp_replace(x, PREAMBLE, ""), "[ \t]{2,}", " ")
    x = let(x, lambda v: F.when(F.contains(v, F.lit(":")) | F.contains(v, F.lit("：")), F.regexp_replace(v, f"([:：]){WS}+", "$1")).otherwise(v))
    return strip(F.regexp_replace(F.regexp_replace(x, f"{WS}+\n", "\n"), "\n{3,}", "\n\n"))


def clean_summary(x: Column) -> Column:
    """A summary as shown: no reasoning, no label before it, at most one empty line in a row."""
    said = F.regexp_replace(strip_reasoning(strip(x)), SUMMARY_LABEL, "")
    return strip(F.regexp_replace(said, "\n{3,}", "\n\n"))


def split_summary(x: Column) -> Column:
    """struct(summary, body): the first summary tag's cleaned text and all around the tag; without one the summary is
    empty."""

    def parts(v):
        def cut(at):
            body = strip(F.concat(F.substr(v, F.lit(1), at - 1), F.substr(v, at + F.length(F.regexp_extract(v, SUMMARY, 0)))))
            return F.when(at > 0, F.struct(clean_summary(F.regexp_extract(v, SUMMARY, 1)).alias("summary"), body.alias("body"))).otherwise(F.struct(F.lit("").alias("summary"), v.alias("body")))

        return let(F.regexp_instr(v, F.lit(SUMMARY)), cut)

    return let(strip(x), parts)


def without_sentences(x: Column, pattern: str) -> Column:
    """The text without each sentence that has the pattern, its end mark included; line ends stay."""
    parts = F.regexp_extract_all(x, F.lit(f"[^{SENTENCE_END}\n]+[{SENTENCE_END}]?|[{SENTENCE_END}\n]"), F.lit(0))
    return F.array_join(F.filter(parts, lambda p: ~F.rlike(p, F.lit(pattern))), "")


def cut_handoff(x: Column, most: int) -> Column:
    """At most ``most`` characters; a longer text ends in a mark."""
    return let(F.regexp_replace(strip(x), "\n{3,}", "\n\n"), lambda v: F.when(F.length(v) <= most, v).otherwise(F.concat(F.rtrim(F.left(v, F.lit(most - 20)), F.lit(" \t\r\n")), F.lit(CUT_MARK))))


def handoff(question: Column, answer: Column, notes: Column | None = None, most: int = 3500) -> Column:
    """The digest of an answer: the question, notes on what it made, and an excerpt of at most half the length without
    code, chart sentences and pages; empty for an empty answer."""

    def prose(v):
        v = F.regexp_replace(v, r"(?is)```[ \t]*(?:html|json)[ \t]*\r?\n.*?(?:\r?\n```|$)", "")
        return strip(F.regexp_replace(without_sentences(v, VISUAL), r"(?is)(?:<!doctype\s+html\b|<html\b).*$", ""))

    def digest(v):
        told = let(prose(v), lambda p: F.when(p != "", p).otherwise(v if notes is None else p))
        excerpt = let(told, lambda p: F.when(p != "", F.concat(F.lit(EXCERPT_LABEL), cut_handoff(p, most // 2))))
        whole = F.concat_ws("\n\n", F.concat(F.lit(QUESTION_LABEL), strip(F.coalesce(question, F.lit("")))), *([] if notes is None else [notes]), excerpt)
        return F.when(v == "", F.lit("")).otherwise(cut_handoff(whole, most))

    return let(strip(answer), digest)


# A time and how two of them make a range.
TIME = r"([0-9]+(?:\.[0-9]+)?)\s*(?:seconds?|s)"
RANGE = rf"{TIME}\s*([~-])\s*{TIME}"


def time_range(x: Column) -> Column:
    """``x.y seconds`` or a range of two such from a marker anywhere in the text, or from a text that is nothing
    else; ``~`` has blanks around it, ``-`` none. Null where there is no time."""
    inner = lambda v: F.coalesce(F.nullif(F.regexp_extract(v, rf"<({TIME}(?:\s*[~-]\s*{TIME})?)>", 1), F.lit("")), v)

    def label(v):
        part = lambda pattern, g: seconds_label(F.regexp_extract(v, pattern, g).try_cast("double"))
        mark = F.when(F.regexp_extract(v, f"^{RANGE}$", 2) == "~", " ~ ").otherwise("-")
        return F.when(F.rlike(v, F.lit(f"^{TIME}$")), part(f"^{TIME}$", 1)).when(F.rlike(v, F.lit(f"^{RANGE}$")), F.concat(part(f"^{RANGE}$", 1), mark, part(f"^{RANGE}$", 3)))

    return let(let(strip(x), inner), label)


def without_time_lines(x: Column) -> Column:
    """The lines that are more than a time marker."""
    lines = F.split(x, rf"\r\n|{LINE_END}")
    return strip(F.array_join(F.filter(lines, lambda line: ~F.rlike(strip(line), F.lit(rf"^<{TIME}(?:\s*[~-]\s*{TIME})?>$"))), "\n"))


def split_range(x: Column) -> Column:
    """struct(start, end): cut at the first `` ~ ``, or else at the first ``-``, or else twice the whole."""
    mark = F.when(F.contains(x, F.lit(" ~ ")), F.lit(" ~ ")).otherwise("-")
    at = F.locate(" ~ ", x)
    at = F.when(at > 0, at).otherwise(F.locate("-", x))
    return F.when(at > 0, F.struct(strip(F.substr(x, F.lit(1), at - 1)).alias("start"), strip(F.substr(x, at + F.length(mark))).alias("end"))).otherwise(F.struct(strip(x).alias("start"), strip(x).alias("end")))


def version(x: Column) -> Column:
    """Leading digits of each dotted part up to the first part without any; such arrays compare in order."""
    digits = F.transform(F.split(x, r"\."), lambda p: F.regexp_extract(p, "^[0-9]+", 0))
    bad = F.array_position(digits, "")
    return F.transform(F.when(bad > 0, F.slice(digits, F.lit(1), (bad - 1).cast("int"))).otherwise(digits), lambda p: p.try_cast("bigint"))


# The tags by which an output delegates, and terms as users see them.
INTERNAL, TAGS = "<|background_call|>", (DELEGATION, "<delegation>")
TERMS = (("背景模型", "后台模型"), ("背景 model", "后台模型"))


def user_terms(x: Column) -> Column:
    for term, shown in TERMS:
        x = F.replace(x, F.lit(term), F.lit(shown))
    return x


def delegation(raw: Column) -> Column:
    """struct(foreground, question, raw_question) of an output that delegates; null for others.

    The internal tag comes first: what follows is a JSON object's ``query``, or else the question itself. Otherwise the
    earlier of the two tags counts. The question is cleaned; an empty one is no delegation unless only routing marks
    were left out of it.
    """
    from weftline.functions.jsontext import first_object

    low = F.lower(raw)
    inner = F.locate(INTERNAL, raw)
    places = [F.nullif(F.locate(tag, low), F.lit(0)) for tag in TAGS]
    outer = F.coalesce(F.least(*places), F.lit(0))
    size = F.when(outer == places[0], len(TAGS[0])).otherwise(len(TAGS[1]))
    payload = strip(F.substr(raw, inner + len(INTERNAL)))
    call = F.try_parse_json(first_object(F.when(inner > 0, payload)))
    query = F.when(F.schema_of_variant(F.try_variant_get(call, "$.query", "variant")) == "STRING", strip(F.try_variant_get(call, "$.query", "string")))
    asked = F.when(inner > 0, F.coalesce(F.nullif(query, F.lit("")), payload)).when(outer > 0, strip(F.substr(raw, outer + size)))
    at = F.when(inner > 0, inner).otherwise(outer)

    def made(q):
        marks_only = F.when(F.startswith(q, F.lit("[")), strip(F.regexp_replace(q, ROUTING, " ")) == "").otherwise(False)
        found = lambda clean: F.when((clean != "") | marks_only, F.struct(user_terms(strip(F.substr(raw, F.lit(1), at - 1))).alias("foreground"), clean.alias("question"), q.alias("raw_question")))
        return let(clean_question(q), found)

    return F.when(at > 0, let(asked, made))


def asked_question(prompt: Column, question: Column) -> Column:
    """What a delegation asks: the user's own prompt, cleaned, or else the question of the output; empty for neither."""
    return F.coalesce(F.nullif(clean_question(F.coalesce(prompt, F.lit(""))), F.lit("")), question, F.lit(""))


def background_result(status: Column, error: Column, text: Column, given: Column) -> Column:
    """struct(error, body, summary) of a background answer: an error without success or text; a summary given with it
    comes before that of its tag."""
    state = F.coalesce(F.nullif(status, F.lit("")), F.lit("completed"))

    def made(parts):
        fault = F.when(state != "completed", F.coalesce(F.nullif(error, F.lit("")), F.concat(F.lit("Background service returned status="), state))).when(parts["body"] == "", "Background service returned empty text")
        told = let(clean_summary(given), lambda g: F.coalesce(F.nullif(g, F.lit("")), parts["summary"]))
        return let(fault, lambda f: F.struct(f.alias("error"), F.when(f.isNull(), parts["body"]).alias("body"), F.when(f.isNull(), told).alias("summary")))

    return let(split_summary(strip_reasoning(strip(F.coalesce(text, F.lit(""))))), made)


def index_range(low: Column, high: Column, first: Column, last: Column) -> Column:
    """The range of frames ``low`` to ``high`` in seconds: from their labels where those name a range with ``-``, else
    from their places; never empty."""
    bound = lambda label, which: F.when(F.contains(label, F.lit("-")), F.regexp_replace(strip(F.regexp_extract(label, "^([^-]*)-(.*)$", which)), "s$", "").try_cast("double"))
    start, end = F.coalesce(bound(first, 1), low.cast("double")), F.coalesce(bound(last, 2), high.cast("double") + 1)
    return F.concat(compact_seconds(start), F.lit("-"), compact_seconds(F.when(end <= start, start + 1).otherwise(end)))


def speech_parts(x: Column, size: int = 12, most: int | None = 2000) -> Column:
    """The collapsed text, ``most`` characters of it or all, in pieces of ``size``."""
    said = collapse(x)
    return F.regexp_extract_all(said if most is None else F.substring(said, 1, most), F.lit(rf"(?s).{{1,{size}}}"), F.lit(0))
