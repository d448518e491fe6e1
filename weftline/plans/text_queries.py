"""Queries on texts, pages, samples and packets, each with its SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from weftline.functions import audio, html
from weftline.functions import text as X
from weftline.operators import convert
from weftline.sources.views import FRAMES, OUTPUTS, frames, outputs, table, turns

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def put(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return put


def squeeze(x: str) -> str:
    r"""DuckDB for runs of white space as one blank; the class names what Java's (?U)\s has."""
    return f"trim(regexp_replace({x}, '[\\s\\x0B\\x{{1C}}-\\x{{1F}}\\x{{85}}\\p{{Z}}]+', ' ', 'g'))"


# White space of any kind.
WHITE = r"[\s\x0B\x{1C}-\x{1F}\x{85}\p{Z}]"

NORMAL = f"""norm AS (SELECT id, raw, CASE WHEN txt = '' OR (silent > 0 AND (said = 0 OR silent < said)) THEN '</silence>' WHEN line = '' THEN '</response>' ELSE '</response> ' || line END AS output
 FROM (SELECT *, trim(regexp_replace(regexp_extract(regexp_replace(CASE WHEN said > 0 THEN substr(txt, said + 11) ELSE txt END, '^{WHITE}+|{WHITE}+$', '', 'g'), '^[^\\n\\r\\x0B\\x0C\\x{{1C}}-\\x{{1E}}\\x{{85}}\\x{{2028}}\\x{{2029}}]*'), '{WHITE}+', ' ', 'g')) AS line
 FROM (SELECT *, instr(txt, '</silence>') AS silent, instr(txt, '</response>') AS said FROM (SELECT id, raw, regexp_replace(regexp_replace(coalesce(raw, ''), '\\r\\n?', chr(10), 'g'), '^{WHITE}+|{WHITE}+$', '', 'g') AS txt FROM outputs))))"""


@query(f"WITH {OUTPUTS}, {NORMAL} SELECT id, output FROM norm")
def normalise_output(spark, d):
    return outputs(spark, d).select("id", X.normalise_output(F.col("raw")).alias("output"))


@query(f"WITH {OUTPUTS}, {NORMAL} SELECT id, CASE WHEN starts_with(output, '</response>') THEN nullif(trim(substr(output, 12)), '') END AS payload FROM norm")
def response_payload(spark, d):
    return outputs(spark, d).select("id", X.response_payload(X.normalise_output(F.col("raw"))).alias("payload"))


@query(f"WITH {FRAMES} SELECT session, t, printf('%.1f seconds', floor(value * 10 + 0.5) / 10) AS label, CASE WHEN event_id % 3 = 0 THEN event_id % 60 ELSE -1 END::DOUBLE AS start_s FROM frames WHERE value IS NOT NULL")
def time_labels(spark, d):
    """Labels of seconds, and the start read back from a range text that one in three frames has."""
    text = F.when(F.col("event_id") % 3 == 0, F.concat((F.col("event_id") % 60).cast("string"), F.lit(".0 seconds ~ 99 seconds"))).otherwise("soon")
    return frames(spark, d).where("value IS NOT NULL").select("session", "t", X.seconds_label(F.col("value")).alias("label"), X.start_second(text).alias("start_s"))


@query("SELECT doc_id AS id, coalesce(nullif(left(regexp_replace(regexp_replace(text, '[^A-Za-z0-9_.-]+', '_', 'g'), '^[._]+|[._]+$', '', 'g'), 120), ''), 'default') AS name, CASE WHEN length(text) > 80 THEN left(text, 77) || '...' ELSE text END AS short, CASE WHEN length(text) <= 8 THEN '***' ELSE left(text, 4) || '...' || right(text, 4) END AS masked FROM documents")
def names_paths(spark, d):
    """A name made of the text, and the shortened and masked text."""
    t = F.col("text")
    return table(spark, d, "documents").select(F.col("doc_id").alias("id"), X.safe_name(t).alias("name"), X.shorten(t, 80).alias("short"), X.mask(t).alias("masked"))


CLEANED = r"""trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace({x}, '(?i)[\s\x0B\x{{1C}}-\x{{1F}}\x{{85}}\p{{Z}}]*\[[^\]]*\b(?:User[\s\x0B\x{{1C}}-\x{{1F}}\x{{85}}\p{{Z}}]+(?:Query|Prompt|Request)|IMPORTANT)\b[^\]]*\][\s\x0B\x{{1C}}-\x{{1F}}\x{{85}}\p{{Z}}]*', ' ', 'g'),
 '^[\s\x0B\x{{1C}}-\x{{1F}}\x{{85}}\p{{Z}}]*请(?:回答|解答)这道(?:简答题|数学题|题目|问题)[，,、\s]*(?:并(?:提供|给出)必要的推理过程和最终答案)?[：:][\s\x0B\x{{1C}}-\x{{1F}}\x{{85}}\p{{Z}}]*', '', 'g'), '[ \t]{{2,}}', ' ', 'g'), '([:：])[\s\x0B\x{{1C}}-\x{{1F}}\x{{85}}\p{{Z}}]+', '\1', 'g'), '[\s\x0B\x{{1C}}-\x{{1F}}\x{{85}}\p{{Z}}]+\n', chr(10), 'g'), '\n{{3,}}', chr(10) || chr(10), 'g'), ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))"""
ASKED = f"""asked AS (SELECT doc_id AS id, trim(CASE doc_id % 8 WHEN 0 THEN text WHEN 1 THEN text || ' </delegation> x' WHEN 2 THEN 'Q ' || doc_id WHEN 3 THEN 'plain ' || doc_id WHEN 4 THEN '' WHEN 5 THEN '[User Query (IMPORTANT)]' WHEN 6 THEN '{{"query": 5}} x' ELSE NULL END, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS raw_question,
 CASE doc_id % 8 WHEN 0 THEN '</response> 后台模型 at work' WHEN 1 THEN 'Go' WHEN 2 THEN 'see </delegation> first' ELSE 'a' END AS foreground FROM documents WHERE text IS NOT NULL AND doc_id % 8 <> 7),
delegated AS (SELECT * FROM (SELECT id, foreground, raw_question, {CLEANED.format(x="raw_question")} AS question FROM asked) WHERE question <> '' OR raw_question = '[User Query (IMPORTANT)]')"""


def _delegating(spark, d):
    """Documents as outputs that delegate by either tag, by the internal one with and without JSON, with an empty question,
    with routing marks only, or not at all."""
    i, k = F.col("doc_id").cast("string"), F.col("doc_id") % 8
    raw = F.when(k == 0, F.concat(F.lit(" </response> 背景模型 at work </delegation> "), "text")).when(k == 1, F.concat(F.lit("Go <Delegation>"), "text", F.lit(" </delegation> x"))).when(k == 2, F.concat(F.lit('see </delegation> first <|background_call|> {no {"query": " Q '), i, F.lit(' "} tail'))).when(k == 3, F.concat(F.lit("a <|background_call|> plain "), i)).when(k == 4, "a </DELEGATION>  \n").when(k == 5, "a <delegation> [User Query (IMPORTANT)] ").when(k == 6, 'a <|background_call|>{"query": 5} x').otherwise(F.col("text"))
    return table(spark, d, "documents").where("text IS NOT NULL").select(F.col("doc_id").alias("id"), raw.alias("raw"))


@query(f"WITH {ASKED} SELECT id, foreground, question, raw_question FROM delegated")
def delegation_parse(spark, d):
    """Delegations: what is said meanwhile, the question as shown and as it came."""
    return _delegating(spark, d).select("id", X.present(X.delegation(F.col("raw"))).alias("r")).select("id", "r.*")


@query(f"WITH {ASKED} SELECT id, CASE WHEN id % 3 = 0 THEN 'asked ' || id ELSE question END AS question, id % 3 = 0 OR question <> '' AS started FROM delegated")
def delegation_question(spark, d):
    """The user's own prompt comes before the delegated question; with neither no task starts."""
    prompt = F.when(F.col("id") % 3 == 0, F.concat(F.lit(" [Important User Request] asked "), F.col("id").cast("string"))).when(F.col("id") % 3 == 1, " [IMPORTANT] ")
    q = _delegating(spark, d).select("id", X.present(X.delegation(F.col("raw"))).alias("r"), prompt.alias("prompt")).select("id", X.asked_question(F.col("prompt"), F.col("r.question")).alias("question"))
    return q.withColumn("started", F.col("question") != "")


def strip(x: str) -> str:
    return f"trim({x}, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))"


def gsub(x: str, pattern: str, to: str) -> str:
    return f"regexp_replace({x}, '{pattern}', {to}, 'g')"


THOUGHT = f"""thought AS (SELECT id, {strip(gsub(strip(gsub("raw", f"(?is)<{X.REASONING}[^>]*>.*?</{X.REASONING}>", "''")), f"(?i)</?{X.REASONING}[^>]*>", "''"))} AS v FROM {{source}}),
unthought AS (SELECT id, CASE WHEN regexp_matches(v, '{X.FINAL}') AND length(string_split_regex(v, '{X.FINAL}')[1]) <= 4000 THEN {strip(f"substr(v, length(string_split_regex(v, '{X.FINAL}')[1]) + length(regexp_extract(v, '{X.FINAL}')) + 1)")} ELSE v END AS clean FROM thought)"""
LABELLED = "labelled AS (SELECT id, CASE id % 7 WHEN 0 THEN '<thinking a>' || raw || chr(10) || ' Final Answer: 42 ' || chr(10) || raw WHEN 1 THEN raw || '</REASONING>' ELSE raw END AS raw FROM outputs)"


@query(f"WITH {OUTPUTS}, {LABELLED}, {THOUGHT.replace('{source}', 'labelled')} SELECT id, clean FROM unthought")
def strip_thinking(spark, d):
    """Outputs without reasoning: blocks, tags that were never closed or opened, all before a final-answer label."""
    raw = F.when(F.col("id") % 7 == 0, F.concat(F.lit("<thinking a>"), "raw", F.lit("\n Final Answer: 42 \n"), "raw")).when(F.col("id") % 7 == 1, F.concat("raw", F.lit("</REASONING>"))).otherwise(F.col("raw"))
    return outputs(spark, d).select("id", X.strip_reasoning(raw).alias("clean"))


@query(f"""WITH q AS (SELECT doc_id AS id, {strip("'  [User  Query (IMPORTANT)] Task:  ' || text || chr(10) || chr(10) || chr(10) || chr(10) || '[important] end'")} AS v FROM documents),
r AS (SELECT id, {gsub(gsub(gsub(gsub("v", X.ROUTING, "' '"), X.PREAMBLE, "''"), "[ \\t]{2,}", "' '"), f"([:：]){X.WS}+", "'\\1'")} AS v FROM q)
SELECT id, {strip(gsub(gsub("v", f"{X.WS}+\\n", "chr(10)"), "\\n{3,}", "chr(10) || chr(10)"))} AS question FROM r""")
def delegation_clean(spark, d):
    """Delegated questions as they are shown."""
    made = F.concat(F.lit("  [User  Query (IMPORTANT)] Task:  "), "text", F.lit("\n\n\n\n[important] end"))
    return table(spark, d, "documents").select(F.col("doc_id").alias("id"), X.clean_question(made).alias("question"))


@query(f"""WITH outputs AS (SELECT doc_id AS id, 'A ' || text || ' <SUMMARY n="1"> 摘要: <think>x</think>' || text || '</Summary> ' || chr(10) || '<summary>two</summary>' AS x FROM documents),
tagged AS (SELECT id, {strip("regexp_extract(x, '" + X.SUMMARY + "', 1)")} AS raw, {strip("regexp_replace(" + strip("x") + ", '" + X.SUMMARY + "', '')")} AS body FROM outputs), {THOUGHT.replace('{source}', 'tagged')}
SELECT id, {strip(gsub(f"regexp_replace(clean, '{X.SUMMARY_LABEL}', '')", "\\n{3,}", "chr(10) || chr(10)"))} AS summary, body FROM unthought JOIN tagged USING (id)""")
def summary_split(spark, d):
    """The first summary tag of an answer and the rest of it."""
    made = F.concat(F.lit("A "), "text", F.lit(' <SUMMARY n="1"> 摘要: <think>x</think>'), "text", F.lit("</Summary> \n<summary>two</summary>"))
    return table(spark, d, "documents").select(F.col("doc_id").alias("id"), X.split_summary(made).alias("s")).select("id", "s.*")


def cut(x: str, most: int) -> str:
    v = gsub(strip(x), "\\n{3,}", "chr(10) || chr(10)")
    return f"CASE WHEN length({v}) <= {most} THEN {v} ELSE rtrim(left({v}, {most - 20}), ' ' || chr(9) || chr(13) || chr(10)) || chr(10) || '...[已截断]' END"


@query(f"""WITH a AS (SELECT doc_id AS id, {strip("text")} AS question, {strip("text || chr(10) || '```json' || chr(10) || '[1]' || chr(10) || '```' || '! See the Chart below. Or not! More.<html><p>x'")} AS answer FROM (SELECT doc_id, coalesce(text, '') AS text FROM documents)),
b AS (SELECT *, {gsub(gsub("answer", "(?is)```[ \\t]*(?:html|json)[ \\t]*\\r?\\n.*?(?:\\r?\\n```|$)", "''"), f"(?i)[^{X.SENTENCE_END}\\n]*(?:{X.VISUAL[4:]})[^{X.SENTENCE_END}\\n]*[{X.SENTENCE_END}]?", "''")} AS v FROM a),
c AS (SELECT *, {strip("regexp_replace(v, '(?is)(<!doctype\\s+html\\b|<html\\b).*$', '')")} AS v2 FROM b), e AS (SELECT id, question, CASE WHEN v2 = '' THEN answer ELSE v2 END AS prose FROM c)
SELECT id, {cut(f"'用户委托问题: ' || question || chr(10) || chr(10) || '核心内容摘录:' || chr(10) || {cut('prose', 600)}", 1200)} AS digest FROM e""")
def handoff(spark, d):
    """The bounded digest of an answer that the foreground may use."""
    text = F.coalesce("text", F.lit(""))
    made = F.concat(text, F.lit("\n```json\n[1]\n```! See the Chart below. Or not! More.<html><p>x"))
    return table(spark, d, "documents").select(F.col("doc_id").alias("id"), X.handoff(text, made, None, 1200).alias("digest"))


TIMES = """times AS (SELECT session, t, CASE event_id % 6 WHEN 0 THEN 'at <' || event_id % 50 || ' seconds ~ ' || event_id % 50 + 5 || '.25s> x' WHEN 1 THEN event_id % 50 || '.55 seconds' WHEN 2 THEN event_id % 50 || 's-' || event_id % 50 + 3 || 's' WHEN 3 THEN event_id % 50 || 's ~  ' || event_id % 50 + 3 || 'second' WHEN 4 THEN 'soon' ELSE '' END AS x FROM frames)"""
LABEL = "printf('%.1f seconds', floor(regexp_extract(y, '{p}', {g})::DOUBLE * 10 + 0.5) / 10)"
NORMAL_TIMES = f"""inner_times AS (SELECT session, t, CASE WHEN regexp_matches(x, '<{X.TIME}(?:\\s*[~-]\\s*{X.TIME})?>') THEN regexp_extract(x, '<({X.TIME}(?:\\s*[~-]\\s*{X.TIME})?)>', 1) ELSE x END AS y FROM times),
ranges AS (SELECT session, t, CASE WHEN regexp_matches(y, '^{X.TIME}$') THEN {LABEL.format(p=f"^{X.TIME}$", g=1)} WHEN regexp_matches(y, '^{X.RANGE}$') THEN {LABEL.format(p=f"^{X.RANGE}$", g=1)} || CASE WHEN contains(y, '~') THEN ' ~ ' ELSE '-' END || {LABEL.format(p=f"^{X.RANGE}$", g=3)} END AS r FROM inner_times)"""


def _time_texts(spark, d):
    s = F.col("event_id") % 50
    n = lambda add=0: (s + add).cast("string")
    k = F.col("event_id") % 6
    x = F.when(k == 0, F.concat(F.lit("at <"), n(), F.lit(" seconds ~ "), n(5), F.lit(".25s> x"))).when(k == 1, F.concat(n(), F.lit(".55 seconds"))).when(k == 2, F.concat(n(), F.lit("s-"), n(3), F.lit("s"))).when(k == 3, F.concat(n(), F.lit("s ~  "), n(3), F.lit("second"))).when(k == 4, "soon").otherwise("")
    return frames(spark, d).select("session", "t", x.alias("x"))


@query(f"WITH {FRAMES}, {TIMES}, {NORMAL_TIMES} SELECT session, t, r AS label, CASE WHEN contains(r, ' ~ ') THEN split_part(r, ' ~ ', 1) ELSE split_part(r, '-', 1) END AS start_label, CASE WHEN contains(r, ' ~ ') THEN split_part(r, ' ~ ', 2) WHEN contains(r, '-') THEN split_part(r, '-', 2) ELSE r END AS end_label FROM ranges")
def time_normalise(spark, d):
    """Range texts as one form, with their ends; null where the text is no time."""
    r = _time_texts(spark, d).select("session", "t", X.time_range(F.col("x")).alias("label"))
    part = X.split_range(F.col("label"))
    return r.select("session", "t", "label", part["start"].alias("start_label"), part["end"].alias("end_label"))


@query(f"""WITH {FRAMES}, {TIMES}, {NORMAL_TIMES}, f AS (SELECT session, t, (t - 1) // 10 AS batch, (t - 1) % 10 AS place FROM frames),
ok AS (SELECT session, r, (t - 1) // 10 AS batch, row_number() OVER (PARTITION BY session, (t - 1) // 10 ORDER BY t) - 1 AS place FROM ranges WHERE r IS NOT NULL)
SELECT f.session, f.batch, f.place, coalesce(ok.r, printf('%.1f seconds', f.place * 0.5)) AS label FROM f LEFT JOIN ok ON f.session = ok.session AND f.batch = ok.batch AND f.place = ok.place""")
def zip_ranges(spark, d):
    """The n-th image of a request gets its n-th readable range, so that later ones shift over unreadable ones; images
    beyond have their place in half seconds. A request has ten images at most."""
    t = _time_texts(spark, d).withColumn("r", X.time_range(F.col("x")))
    g = t.groupBy("session", F.floor((F.col("t") - 1) / 10).cast("bigint").alias("batch")).agg(F.array_sort(F.collect_list(F.struct("t", "r"))).alias("all"))
    g = g.withColumn("ok", F.transform(F.filter("all", lambda x: x.r.isNotNull()), lambda x: x.r))
    label = lambda x, i: F.struct(i.cast("bigint").alias("place"), F.coalesce(F.get("ok", i), F.format_string("%.1f seconds", i * F.lit(0.5))).alias("label"))
    return g.select("session", "batch", F.inline(F.transform("all", label)))


@query(f"""WITH l AS (SELECT doc_id AS id, string_split_regex('<' || doc_id % 60 || ' seconds>' || chr(10) || text || chr(13) || ' <3s - 4.5s> ' || chr(10) || 'last <5s>', '\\r\\n|[\\n\\r\\x0B\\x0C\\x{{1C}}-\\x{{1E}}\\x{{85}}\\x{{2028}}\\x{{2029}}]') AS l FROM documents)
SELECT id, {strip(f"array_to_string(list_filter(l, lambda x: NOT regexp_matches({strip('x')}, '^<{X.TIME}(?:\\s*[~-]\\s*{X.TIME})?>$')), chr(10))")} AS clean FROM l""")
def strip_time_lines(spark, d):
    made = F.concat(F.lit("<"), (F.col("doc_id") % 60).cast("string"), F.lit(" seconds>\n"), "text", F.lit("\r <3s - 4.5s> \nlast <5s>"))
    return table(spark, d, "documents").select(F.col("doc_id").alias("id"), X.without_time_lines(made).alias("clean"))


@query("""WITH v AS (SELECT event_id, '1.' || event_id % 20 || '.' || event_id % 3 || CASE event_id % 4 WHEN 0 THEN 'rc1.9' WHEN 1 THEN '.beta' ELSE '' END AS version FROM events)
SELECT event_id, version, CASE WHEN event_id % 4 = 0 THEN [1, event_id % 20, event_id % 3, 9] ELSE [1, event_id % 20, event_id % 3] END >= [1, 10, 1] AS enough FROM v""")
def version_compare(spark, d):
    """Versions of at least 1.10.1, compared part by part."""
    k = F.col("event_id") % 4
    made = F.concat(F.lit("1."), (F.col("event_id") % 20).cast("string"), F.lit("."), (F.col("event_id") % 3).cast("string"), F.when(k == 0, "rc1.9").when(k == 1, ".beta").otherwise(""))
    return table(spark, d, "events").select("event_id", made.alias("version"), (X.version(made) >= X.version(F.lit("1.10.1"))).alias("enough"))


@query(f"WITH s AS (SELECT doc_id AS id, {squeeze('text')} AS said FROM documents), p AS (SELECT id, said, unnest(range(0, length(said), 12)) AS i FROM s) SELECT id, (i // 12)::BIGINT AS place, substr(said, i + 1, 12) AS part FROM p")
def tts_chunks(spark, d):
    return table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.posexplode(X.speech_parts(F.col("text"), most=None)).alias("place", "part")).withColumn("place", F.col("place").cast("bigint"))


@query("SELECT conv_id AS session, arg_max(text, turn) FILTER (role = 'user') AS prompt, arg_min(text, turn) FILTER (role = 'user') AS first_prompt FROM conversations GROUP BY 1")
def prompt_text(spark, d):
    """The newest and the first user message of each session."""
    at = F.when(F.col("role") == "user", F.col("turn"))
    return turns(spark, d).groupBy("session").agg(F.max_by("text", at).alias("prompt"), F.min_by("text", at).alias("first_prompt"))


def plain_markup(x: str) -> str:
    """DuckDB for the character references that the pages have."""
    for entity, char in (("&lt;?", "<"), ("&gt;?", ">"), ("&quot;?", '"'), ("&copy;?", "©"), ("&middot;?", "·"), ("&#39;", "''"), ("&amp;?", "&")):
        x = f"regexp_replace({x}, '{entity}', '{char}', 'g')"
    return f"trim({x}, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))"


OPEN = " OR ".join(f"(regexp_matches(h, '(?i)<{t}\\b') AND NOT regexp_matches(h, '(?i)</{t}[ \\t\\r\\n]*>'))" for t in ("html", "body", "head", "style"))
PAGES = rf"""p AS (SELECT page_id, {plain_markup("coalesce(html, '')")} AS h FROM pages),
c AS (SELECT page_id, h, regexp_extract(h, '(?is)(?:<!doctype[ \t\r\n]+html\b|<html\b).*$') AS rest FROM p),
x AS (SELECT page_id, h, rest, regexp_extract(rest, '(?is)^.*?</html[ \t\r\n]*>') AS whole FROM c),
d AS (SELECT page_id, CASE WHEN whole <> '' THEN whole WHEN rest <> '' THEN rest WHEN regexp_matches(h, '{html.FRAGMENT}') THEN '<!doctype html>' || chr(10) || '{html.HEAD.split(chr(10))[1]}' || h || '{html.FOOT}' END AS doc, CASE WHEN rest <> '' THEN whole <> '' ELSE NOT ({OPEN}) END AS complete FROM x),
s AS (SELECT page_id, doc, complete, length(doc)::BIGINT AS n_chars, len(regexp_extract_all(doc, '{html.COUNTED}'))::BIGINT AS n_tags,
 (least(length(doc), 20000) + CASE WHEN complete THEN 5000 ELSE 0 END + CASE WHEN regexp_matches(doc, '(?i)<style') THEN 2500 ELSE 0 END + CASE WHEN regexp_matches(doc, '(?i)<body') THEN 1500 ELSE 0 END + CASE WHEN regexp_matches(doc, '{html.SHOWS}') THEN 1500 ELSE 0 END
 + least(120 * len(regexp_extract_all(doc, '{html.COUNTED}')), 3000) - 3000 * len(regexp_extract_all(doc, '\.\.\.|\x{{2026}}')) - 5000 * len(regexp_extract_all(doc, '>[ \t\r\n]*\.\.\.[ \t\r\n]*<')))::BIGINT AS score FROM d WHERE doc IS NOT NULL)"""


@query(f"WITH {PAGES} SELECT page_id, complete, n_chars, n_tags, score FROM s")
def html_score(spark, d):
    doc = html.document(F.coalesce("html", F.lit("")))
    return table(spark, d, "pages").select("page_id", X.present(doc).alias("r")).select("page_id", F.col("r.complete").alias("complete"), F.length("r.doc").cast("bigint").alias("n_chars"), html.tags(F.col("r.doc")).alias("n_tags"), html.score(F.col("r.doc"), F.col("r.complete")).alias("score"))


@query(f"WITH {PAGES} SELECT page_id, -((page_id % 2 = 1)::BIGINT) AS place, doc, complete, score FROM s")
def html_extract(spark, d):
    """The best document of an answer: a page after prose, in a fence, or after a fenced scrap that scores below it."""
    page = F.coalesce("html", F.lit(""))
    return table(spark, d, "pages").select("page_id", F.when(F.col("page_id") % 2 == 1, F.concat(F.lit("See\n```html\n<p>...</p>\n```\n```html\n"), page, F.lit("\n```\nDone"))).otherwise(F.concat(F.lit("```html\n"), page, F.lit("\n```"))).alias("answer")).select("page_id", X.present(html.best(F.col("answer"))).alias("b")).select("page_id", F.col("b.place").cast("bigint").alias("place"), F.col("b.doc").alias("doc"), "b.complete", "b.score")


@query("""SELECT doc_id AS id, nullif(regexp_replace(split_part(text || chr(10) || '```', '```', 1), '^[\\s\\x0B\\x{1C}-\\x{1F}\\x{85}\\p{Z}]+|[\\s\\x0B\\x{1C}-\\x{1F}\\x{85}\\p{Z}]+$', '', 'g'), '') AS block FROM documents""")
def fenced_blocks(spark, d):
    """The first fenced html block of an answer, to the next fence, wherever that is."""
    made = F.concat(F.lit("\n```html\n"), "text", F.lit("\n``` tail"))
    return table(spark, d, "documents").select(F.col("doc_id").alias("id"), html.fenced(made, "html").alias("block"))


@query("""WITH b AS (SELECT user_id AS session, event_type AS label, count(*) AS n FROM events GROUP BY 1, 2)
SELECT session, string_agg(label, ',' ORDER BY label) AS labels, sum(n)::BIGINT AS total, count(*) >= 3 AS valid FROM b GROUP BY 1""")
def chart_extract(spark, d):
    """Bar charts are read back from JSON: labels and values of equal length and at least three bars."""
    b = table(spark, d, "events").groupBy(F.col("user_id").alias("session"), F.col("event_type").alias("label")).agg(F.count("*").alias("n"))
    rows = F.array_sort(F.collect_list(F.struct("label", "n")))
    made = b.groupBy("session").agg(F.to_json(F.struct(F.lit("bar_chart").alias("type"), F.transform(rows, lambda r: r.label).alias("labels"), F.transform(rows, lambda r: r.n).alias("values"))).alias("j"))
    c = html.chart(F.col("j"))
    return made.select("session", c.alias("c")).select("session", F.array_join("c.labels", ",").alias("labels"), F.aggregate("c.values", F.lit(0.0), lambda a, v: a + v).cast("bigint").alias("total"), (F.size("c.values") >= 3).alias("valid"))


SAMPLES = f"""{FRAMES}, samples AS (SELECT session, 20 + (session * 37) % 400 AS dur FROM (SELECT DISTINCT session FROM frames)),
raw AS (SELECT f.session, t, CASE WHEN session % 4 = 1 THEN event_id % 450 ELSE event_id % (dur + 1) END AS s, event_id % 10 AS k, session % 8 = 3 AND t = 5 AS bad, CASE WHEN prompt IS NOT NULL THEN 'q' ELSE 'r' END AS kind, coalesce(prompt, event_type) AS content, dur, least(dur, 320) AS eff, dur > 320 AS cut FROM frames f JOIN samples USING (session)),
faults AS (SELECT session, dur, CASE WHEN bad THEN 'bad time' ELSE 'late ' || kind END AS reason, CASE WHEN NOT bad THEN s END AS first_late FROM raw WHERE bad OR (NOT cut AND k NOT IN (2, 3) AND s > eff) QUALIFY row_number() OVER (PARTITION BY session ORDER BY kind = 'r', t) = 1),
bad AS (SELECT session FROM faults),
ev AS (SELECT session, t, kind, content, eff, unnest(CASE WHEN k = 0 THEN [s, s - 1] ELSE [s] END) AS sec FROM raw WHERE k NOT IN (2, 3) AND NOT bad),
grid AS (SELECT session, dur, least(dur, 320) AS eff, unnest(range(0, least(dur, 320))) AS sec FROM samples WHERE session NOT IN (SELECT session FROM bad)),
lasts AS (SELECT session, least(sec, eff - 1) AS sec, arg_max(content, t) FILTER (kind = 'q') AS q, arg_max(content, t) FILTER (kind = 'r') AS r FROM ev WHERE sec <= eff AND sec >= 0 GROUP BY 1, 2)"""


@query(f"WITH {SAMPLES} SELECT grid.session, grid.sec, coalesce(q, '') AS question, CASE WHEN r IS NULL THEN '</silence>' ELSE '</response> ' || r END AS answer FROM grid LEFT JOIN lasts USING (session, sec)")
def convert_grid(spark, d):
    """One user and assistant pair a second of each accepted sample; the last event of a second wins."""
    samples, events = convert.role_samples(frames(spark, d))
    return convert.grid(samples, events).select("session", "sec", "question", "answer")


@query(f"WITH {SAMPLES} SELECT session, dur::BIGINT AS duration, reason, first_late FROM faults")
def convert_rejects(spark, d):
    """Samples with a time that cannot be read or that lies beyond a duration that was not cut: the first such event,
    questions before responses."""
    samples, events = convert.role_samples(frames(spark, d))
    return convert.rejects(samples, events)


@query(f"WITH {SAMPLES}, g AS (SELECT DISTINCT session, dur FROM grid) SELECT session, dur::BIGINT AS original, 320::BIGINT AS used, 320::BIGINT * CASE WHEN dur >= 160 THEN 1 WHEN dur >= 64 THEN 2 ELSE 4 END AS frames FROM g WHERE dur > 320")
def convert_truncated(spark, d):
    """A record of every accepted sample that was cut."""
    samples, events = convert.role_samples(frames(spark, d))
    return convert.truncated(samples, events)


@query(f"WITH {SAMPLES}, g AS (SELECT DISTINCT session, dur FROM grid) SELECT CASE WHEN dur >= 160 THEN 1 WHEN dur >= 64 THEN 2 ELSE 4 END AS fps, count(*) AS processed, sum((dur > 320)::INT)::BIGINT AS truncated, sum(greatest(least(dur, 320) * CASE WHEN dur >= 160 THEN 1 WHEN dur >= 64 THEN 2 ELSE 4 END, 1))::BIGINT AS n_images FROM g GROUP BY 1")
def convert_counters(spark, d):
    samples, events = convert.role_samples(frames(spark, d))
    return convert.counters(samples, events)


@query("SELECT event_id, 12 + 8 AS n_bytes, CASE WHEN event_id % 5 = 0 THEN -(event_id % 1000) ELSE event_id % 1000 END AS seqid, event_id % 5 = 0 AND event_id % 1000 > 0 AS final, 8::BIGINT AS n_audio FROM events")
def pcm_unpack(spark, d):
    """Events packed as big-endian packets and read again: a negative number is the final one."""
    seq = F.when(F.col("event_id") % 5 == 0, -(F.col("event_id") % 1000)).otherwise(F.col("event_id") % 1000)
    p = table(spark, d, "events").select("event_id", audio.pack(seq, F.lit(0), F.lit(0), F.unhex(F.lpad(F.hex("event_id"), 16, "0"))).alias("frame"))
    u = audio.unpack(F.col("frame"))
    return p.select("event_id", F.length("frame").alias("n_bytes"), u.alias("u")).select("event_id", "n_bytes", F.col("u.seqid").alias("seqid"), (F.col("u.seqid") < 0).alias("final"), F.length("u.audio").cast("bigint").alias("n_audio"))


@query(f"""WITH {FRAMES}, last_packets AS (SELECT session, min(t) FILTER (event_type = 'error') AS fin FROM frames GROUP BY 1), p AS (SELECT f.session, f.t, f.event_id FROM frames f JOIN last_packets USING (session) WHERE fin IS NULL OR t <= fin)
SELECT session, md5(string_agg(lpad(lower(to_hex(event_id)), 16, '0'), '' ORDER BY t)) AS digest, count(*) * 8 AS n_bytes FROM p GROUP BY 1""")
def pcm_assemble(spark, d):
    """Payloads in order up to the first final packet (an error event), as one hex text's digest."""
    f = frames(spark, d)
    p = audio.until_final(f.withColumn("final", F.col("event_type") == "error"))
    hexes = F.transform(F.array_sort(F.collect_list(F.struct("t", F.lower(F.lpad(F.hex("event_id"), 16, "0")).alias("h")))), lambda x: x.h)
    return p.groupBy("session").agg(F.md5(F.array_join(hexes, "").cast("binary")).alias("digest"), (F.count("*") * 8).alias("n_bytes"))


@query(f"""WITH {FRAMES}, o AS (SELECT session, t, 100 + event_id % 50 AS n, sum(100 + event_id % 50) OVER (PARTITION BY session ORDER BY t ROWS UNBOUNDED PRECEDING) AS upto FROM frames),
x AS (SELECT session, unnest(range((upto - n)::BIGINT // 128, (upto - 1)::BIGINT // 128 + 1)) AS slice, upto - n AS a, upto AS b FROM o)
SELECT session, slice, sum(least(b, (slice + 1) * 128) - greatest(a, slice * 128))::BIGINT AS n_bytes, count(*) AS n_packets FROM x GROUP BY 1, 2""")
def pcm_rechunk(spark, d):
    """Packets of any size cut into slices of 128 bytes by their running offset; the last slice has the rest."""
    return audio.rechunk(frames(spark, d).withColumn("n", F.col("event_id") % 50 + 100), 128)


@query("SELECT event_id, least(0.5 * pow(2, event_id % 7), 5)::DOUBLE AS wait_s, greatest(1, floor((100 + event_id % 900) * least(1.0, sqrt(50000.0 / ((100 + event_id % 900) * 300)))))::BIGINT AS width FROM events")
def backoff_fit(spark, d):
    """Waits that double up to five seconds, and widths scaled to an area."""
    w = F.col("event_id") % 900 + 100
    return table(spark, d, "events").select("event_id", F.least(0.5 * F.pow(F.lit(2.0), F.col("event_id") % 7), F.lit(5.0)).alias("wait_s"), F.greatest(F.lit(1), F.floor(w * F.least(F.lit(1.0), F.sqrt(F.lit(50000.0) / (w * 300))))).cast("bigint").alias("width"))
