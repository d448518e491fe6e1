"""Queries on chat requests, paths and records, each with its SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from weftline.functions import messages as M
from weftline.functions import paths as P
from weftline.functions import text as X
from weftline.functions import values as V
from weftline.operators import convert
from weftline.plans.text_queries import WHITE
from weftline.sources.views import FRAMES, OUTPUTS, TURNS, frames, outputs, table, turns

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def put(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return put


def requests(spark, d):
    """Conversations as requests: session and messages, a third of them plain, a third with a file, a third with an inline
    image and a blank text."""
    part = lambda kind, text, url: F.struct(F.lit(kind).alias("type"), text.alias("text"), url.alias("url"))
    none, text = F.lit(None).cast("string"), F.col("text")
    file = F.concat(F.when(F.col("turn") % 2 == 0, F.lit("file://")).otherwise("file://localhost"), F.lit("/data/a%20b+"), F.col("turn").cast("string"), F.lit(".jpg"))
    k = F.col("turn") % 3
    parts = F.when(k == 1, F.array(part("text", F.concat(F.lit(" "), text), none), part("image_url", none, file))).when(k == 2, F.array(part("image_url", none, F.concat(F.lit("data:image/png;base64,"), text)), part("text", F.lit(" \n"), none), part("text", text, none), part("image_url", none, F.lit(""))))
    row = F.struct("t", F.struct("role", F.when(k == 0, text).alias("text"), parts.alias("parts")).alias("m"))
    return turns(spark, d).groupBy("session").agg(F.array_sort(F.collect_list(row), lambda a, b: F.when(a.t < b.t, -1).otherwise(1)).alias("rows")).select("session", F.transform("rows", lambda r: r.m).alias("messages"))


STRIP = "trim({}, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))"


@query(f"""WITH {TURNS}, last_user AS (SELECT session, max(t) AS t FROM turns WHERE role = 'user' GROUP BY 1), sessions AS (SELECT DISTINCT session FROM turns)
SELECT s.session, coalesce({STRIP.format('u.text')}, '') AS prompt FROM sessions s LEFT JOIN (SELECT session, text FROM last_user JOIN turns USING (session, t)) u ON s.session IS NOT DISTINCT FROM u.session""")
def user_prompts(spark, d):
    """The newest user message's text, whichever form it has."""
    return requests(spark, d).select("session", M.user_prompt(F.col("messages")).alias("prompt"))


REFS = f"""{TURNS}, r AS (SELECT session, t, turn, CASE WHEN turn % 3 = 1 THEN 'path' ELSE 'data_url' END AS kind, CASE WHEN turn % 3 = 1 THEN '/data/a b+' || turn || '.jpg' ELSE 'data:image/png;base64,' || text END AS value FROM turns WHERE turn % 3 > 0),
newest AS (SELECT session, kind, value FROM r QUALIFY row_number() OVER (PARTITION BY session ORDER BY t DESC) = 1)"""


@query(f"WITH {REFS} SELECT session, kind, value, CASE WHEN kind = 'data_url' AND value = 'data:image/png;base64,' THEN 'invalid data URL format' END AS fault FROM newest")
def image_refs(spark, d):
    """The images of the newest message with any, and why one is refused."""
    ref = requests(spark, d).select("session", F.explode(M.image_refs(F.col("messages"))).alias("r"))
    return ref.select("session", "r.kind", "r.value", M.ref_fault(F.col("r")).alias("fault"))


@query(f"WITH {REFS} SELECT session, 0::BIGINT AS place, 'path' AS kind, '/local/' || session || '.png' AS value FROM (SELECT DISTINCT session FROM turns) WHERE session % 2 = 0 UNION ALL SELECT session, CASE WHEN session % 2 = 0 THEN 1 ELSE 0 END::BIGINT, kind, value FROM newest")
def local_image_refs(spark, d):
    """Requests of every second session name a path themselves, which comes first."""
    local = F.when(F.col("session") % 2 == 0, F.concat(F.lit(" /local/"), F.col("session").cast("string"), F.lit(".png ")))
    ref = requests(spark, d).select("session", F.posexplode(M.image_refs(F.col("messages"), local)).alias("place", "r"))
    return ref.select("session", F.col("place").cast("bigint").alias("place"), "r.kind", "r.value")


@query(f"WITH {TURNS} SELECT session, bool_or(turn % 3 > 0) AS remembered, count(*) AS n_messages FROM turns GROUP BY 1")
def memory_bypass(spark, d):
    """Requests without any image are passed on and leave no turn."""
    return requests(spark, d).select("session", (F.size(M.image_refs(F.col("messages"))) > 0).alias("remembered"), F.size("messages").cast("bigint").alias("n_messages"))


FILES = """f AS (SELECT page_id, CASE page_id % 6 WHEN 0 THEN '/data/./pics//p' || page_id || '.JPG' WHEN 1 THEN '/data/pics/../../etc/p' || page_id || '.png' WHEN 2 THEN '/data/pics/p' || page_id || '.html' WHEN 3 THEN '/data/picsx/p' || page_id || '.webp' WHEN 4 THEN '/../data/pics/' || page_id || '/../p' || page_id || '.bmp' ELSE '/data/pics/p' || page_id END AS raw,
 CASE page_id % 6 WHEN 0 THEN '/data/pics/p' || page_id || '.JPG' WHEN 1 THEN '/etc/p' || page_id || '.png' WHEN 2 THEN '/data/pics/p' || page_id || '.html' WHEN 3 THEN '/data/picsx/p' || page_id || '.webp' WHEN 4 THEN '/data/pics/p' || page_id || '.bmp' ELSE '/data/pics/p' || page_id END AS path FROM pages)"""


def _files(spark, d):
    name = F.concat(F.lit("p"), F.col("page_id").cast("string"))
    at = lambda before, after: F.concat(F.lit(before), name, F.lit(after))
    k = F.col("page_id") % 6
    raw = F.when(k == 0, at("/data/./pics//", ".JPG")).when(k == 1, at("/data/pics/../../etc/", ".png")).when(k == 2, at("/data/pics/", ".html")).when(k == 3, at("/data/picsx/", ".webp")).when(k == 4, F.concat(F.lit("/../data/pics/"), F.col("page_id").cast("string"), F.lit("/../"), name, F.lit(".bmp"))).otherwise(at("/data/pics/", ""))
    return table(spark, d, "pages").select("page_id", raw.alias("raw"))


@query(f"""WITH {FILES}, e AS (SELECT page_id, path, page_id % 5 > 0 AS found FROM f)
SELECT page_id, path, CASE WHEN NOT found THEN 'missing' WHEN page_id % 6 IN (2, 5) THEN 'suffix' WHEN page_id % 6 IN (1, 3) THEN 'outside' END AS fault FROM e""")
def image_guard(spark, d):
    """Image paths against the files there are (four of five pages'), the suffixes allowed and the roots."""
    f = _files(spark, d).withColumn("path", P.normal(F.col("raw")))
    there = f.where("page_id % 5 > 0").select("path", F.lit(True).alias("found"))
    f = f.join(there, "path", "left").withColumn("found", F.coalesce("found", F.lit(False)))
    return f.select("page_id", "path", P.image_fault(F.col("path"), F.col("found"), F.array(F.lit("/data/pics"), F.lit("/srv"))).alias("fault"))


@query(f"""WITH {FILES} SELECT page_id, CASE page_id % 3 WHEN 0 THEN NULL WHEN 1 THEN '/data/pics,/srv' ELSE '/' END AS roots, CASE page_id % 3 WHEN 1 THEN page_id % 6 NOT IN (1, 3) ELSE TRUE END AS allowed FROM f""")
def path_roots(spark, d):
    """Lists of roots, each once, and whether a path lies under one."""
    k = F.col("page_id") % 3
    listed = F.when(k == 0, " * ").when(k == 1, "/data/pics:/srv/, /data/x/../pics").otherwise("/")
    f = _files(spark, d).withColumn("roots", P.roots(listed))
    return f.select("page_id", F.array_join("roots", ",").alias("roots"), P.allowed(P.normal(F.col("raw")), F.col("roots")).alias("allowed"))


@query("""SELECT page_id, CASE page_id % 7 WHEN 0 THEN 'text/html' WHEN 1 THEN 'image/png' WHEN 2 THEN 'application/x-tar' WHEN 3 THEN 'application/pdf' WHEN 4 THEN 'video/mp4' WHEN 5 THEN 'image/svg+xml' ELSE 'application/octet-stream' END AS kind, page_id % 7 IN (0, 1, 3, 5) AS inline FROM pages""")
def inline_display(spark, d):
    """Which files a browser shows and which it saves."""
    ends = [".html", ".PNG", ".tar", ".pdf", ".mp4", ".x.svg", ""]
    path = F.concat(F.lit("/w/.p"), F.col("page_id").cast("string"), F.element_at(F.array(*map(F.lit, ends)), (F.col("page_id") % 7 + 1).cast("int")))
    return table(spark, d, "pages").select("page_id", P.content_type(path).alias("kind"), P.shown_inline(path).alias("inline"))


@query("""WITH s AS (SELECT event_id, CASE event_id % 5 WHEN 0 THEN NULL WHEN 1 THEN NULL WHEN 2 THEN '/abs/output_' || user_id WHEN 3 THEN '/root/runs/' || user_id || '/output' ELSE '/x/s' || user_id END AS dir FROM events)
SELECT event_id, dir, CASE event_id % 5 WHEN 2 THEN replace(dir, '/output_', '/output_light_') ELSE dir || CASE WHEN event_id % 5 = 3 THEN '_light' ELSE '_light' END END AS light FROM s""")
def save_dirs(spark, d):
    """Folders of full and of light records."""
    u = F.col("user_id").cast("string")
    k = F.col("event_id") % 5
    raw = F.when(k == 1, "  ").when(k == 2, F.concat(F.lit(" /abs//output_"), u)).when(k == 3, F.concat(F.lit("./"), u, F.lit("/output/"))).when(k == 4, F.concat(F.lit("/x/y/../s"), u))
    out = P.save_dir(raw, "/root/runs")
    return table(spark, d, "events").select("event_id", out.alias("dir"), P.light_dir(out).alias("light"))


@query("SELECT event_id, 'rtsp://' || event_type || CASE WHEN event_id % 3 > 0 THEN ':****@h/' ELSE '@h/' END || event_id AS url, CASE WHEN event_id < 10000 THEN 'EMPTY' ELSE '***' || right(event_id::VARCHAR, 4) END AS secret FROM events")
def url_masks(spark, d):
    """Addresses without their passwords and the ends of long secrets."""
    who = F.concat(F.lit("rtsp://"), "event_type", F.when(F.col("event_id") % 3 > 0, F.concat(F.lit(":p"), F.col("event_id").cast("string"))).otherwise(""), F.lit("@h/"), F.col("event_id").cast("string"))
    return table(spark, d, "events").select("event_id", P.without_password(who).alias("url"), P.last_four(F.col("event_id").cast("string")).alias("secret"))


@query("""WITH n AS (SELECT doc_id AS id, CASE WHEN doc_id % 4 = 0 THEN 'é"' ELSE text END AS name FROM documents), a AS (SELECT id, name, regexp_replace(name, '[^\\x00-\\x7F]', '', 'g') AS plain FROM n)
SELECT id, 'attachment; filename="' || replace(replace(CASE WHEN plain = '' THEN 'download' ELSE plain END, '\\', '_'), '"', '_') || '"; filename*=UTF-8''''' || replace(url_encode(name), '%2F', '/') AS header FROM a""")
def download_header(spark, d):
    """The header of a download named by a text."""
    name = F.when(F.col("doc_id") % 4 == 0, 'é"').otherwise(F.col("text"))
    return table(spark, d, "documents").select(F.col("doc_id").alias("id"), P.disposition("attachment", name).alias("header"))


@query("SELECT doc_id AS id, CASE WHEN doc_id % 3 = 0 THEN 'task-' || doc_id || '-x' ELSE 'random' || doc_id END || '.html' AS name FROM documents")
def artefact_names(spark, d):
    """The files of pages that answers make."""
    i = F.col("doc_id").cast("string")
    task = F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit(" -task 任务 "), i, F.lit("//x- "))).when(F.col("doc_id") % 3 == 1, " -/- ")
    return table(spark, d, "documents").select(F.col("doc_id").alias("id"), P.artefact_name(task, F.concat(F.lit("random"), i)).alias("name"))


@query(f"""WITH {TURNS} SELECT session, string_agg('prediction=' || coalesce(text, '') || ';turn=' || t, '|' ORDER BY t) AS kept FROM turns GROUP BY 1""")
def light_predictions(spark, d):
    """A session's predictions with the entries that a light record keeps."""
    made = F.map_from_arrays(F.array(*map(F.lit, ("turn", "prediction", "image", "messages"))), F.array(F.col("t").cast("string"), F.coalesce("text", F.lit("")), F.lit("x"), F.col("role")))
    entries = lambda m: F.array_join(F.array_sort(F.transform(F.map_entries(m), lambda e: F.concat(e.key, F.lit("="), e.value))), ";")
    p = turns(spark, d).select("session", "t", entries(M.light_prediction(made)).alias("kept"))
    return p.groupBy("session").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("t", "kept"))), lambda r: r.kept), "|").alias("kept"))


@query(f"""WITH {TURNS}, f AS (SELECT *, last_value(prompt IGNORE NULLS) OVER (PARTITION BY session ORDER BY t ROWS UNBOUNDED PRECEDING) AS query FROM turns)
SELECT session, t, query IS NULL AS skipped, CASE WHEN query IS NULL THEN 'no query' END AS reason, CASE WHEN query IS NOT NULL THEN 'm' || session % 2 END AS model, text AS messages, CASE WHEN query IS NOT NULL THEN '0.7' END AS temperature FROM f""")
def model_inputs(spark, d):
    """What the model was sent at each turn, or would have been."""
    known = F.last("prompt", True).over(Window.partitionBy("session").orderBy("t").rowsBetween(Window.unboundedPreceding, 0))
    r = M.model_input(F.col("query").isNull(), F.lit("no query"), F.concat(F.lit("m"), (F.col("session") % 2).cast("string")), F.col("text"), F.create_map(F.lit("temperature"), F.lit("0.7")))
    f = turns(spark, d).withColumn("query", known).select("session", "t", r.alias("r"))
    return f.select("session", "t", "r.skipped", "r.reason", "r.model", "r.messages", F.col("r.settings")["temperature"].alias("temperature"))


@query(f"""WITH {FRAMES}, f AS (SELECT *, 1 + (t - 1) // 10 AS chunk, last_value(prompt IGNORE NULLS) OVER (PARTITION BY session ORDER BY t ROWS UNBOUNDED PRECEDING) AS query FROM frames)
SELECT session, chunk, min(t) AS turn, 'chunk_' || lpad(chunk::VARCHAR, 4, '0') || '__turn_' || lpad(min(t)::VARCHAR, 4, '0') AS name FROM f WHERE query IS NOT NULL GROUP BY 1, 2""")
def chunk_start_inputs(spark, d):
    """The first turn of each chunk for which the model was asked."""
    from weftline.operators import turns as T

    f = T.fill_query(frames(spark, d)).where("query IS NOT NULL").groupBy("session", T.chunk(F.col("t"), 10).alias("chunk")).agg(F.min("t").alias("turn"))
    return f.select("session", "chunk", "turn", F.format_string("chunk_%04d__turn_%04d", "chunk", "turn").alias("name"))


@query(f"""WITH {TURNS}, p AS (SELECT session, t, CASE WHEN turn % 2 = 1 THEN 'data:image/png;base64,' || text END AS image, text FROM turns), m AS (SELECT *, coalesce(length(image) > 200, FALSE) AS big FROM p), n AS (SELECT *, sum(big::INT) OVER (PARTITION BY session ORDER BY t ROWS UNBOUNDED PRECEDING) - 1 AS i FROM m)
SELECT session, string_agg(coalesce(text, '') || '>' || coalesce(CASE WHEN big THEN '__image_' || i::BIGINT || '__' ELSE image END, '-'), '|' ORDER BY t) AS record, count(*) FILTER (big) AS n_images FROM n GROUP BY 1""")
def record_images(spark, d):
    """Records in which inline images stand at any depth: each long one leaves a mark, numbered through the record."""
    image = F.when(F.col("turn") % 2 == 1, F.concat(F.lit("data:image/png;base64,"), "text"))
    rows = F.array_sort(F.collect_list(F.struct("t", F.coalesce("text", F.lit("")).alias("text"), F.coalesce(image, F.lit("-")).alias("image"))))
    g = turns(spark, d).groupBy("session").agg(rows.alias("rows"))
    split = M.marked(F.flatten(F.transform("rows", lambda r: F.array(r.text, r.image))))
    g = g.select("session", split.alias("s"))
    pairs = F.transform(F.sequence(F.lit(0), F.size("s") - 1, F.lit(2)), lambda i: F.concat(F.get("s", i)["text"], F.lit(">"), F.get("s", i + 1)["text"]))
    return g.select("session", F.array_join(pairs, "|").alias("record"), F.size(F.filter("s", lambda x: x.image.isNotNull())).cast("bigint").alias("n_images"))


@query("SELECT event_id, CASE WHEN event_id % 3 = 0 THEN 'Query: ' ELSE '提问: ' END || event_type AS asked, CASE WHEN event_id % 3 = 0 THEN 'Response: ' ELSE '回复: ' END || user_id AS said FROM events")
def prompt_labels(spark, d):
    """Archived questions and answers under the labels of a session's language."""
    language = F.element_at(F.array(F.lit("en"), F.lit("zh"), F.lit("de")), (F.col("event_id") % 3 + 1).cast("int"))
    e = table(spark, d, "events").withColumn("l", M.prompt_labels(language))
    return e.select("event_id", F.concat("l.query", F.lit(": "), "event_type").alias("asked"), F.concat("l.response", F.lit(": "), F.col("user_id").cast("string")).alias("said"))


@query(f"""WITH {OUTPUTS}, c AS (SELECT id, regexp_replace(regexp_replace(coalesce(raw, ''), '\\r\\n?', chr(10), 'g'), '^{WHITE}+|{WHITE}+$', '', 'g') AS txt FROM outputs), m AS (SELECT *, instr(txt, '</silence>') AS silent, instr(txt, '</response>') AS said FROM c)
SELECT id, true AS has_payload, true AS asked FROM m WHERE id % 2 = 0 AND NOT (silent > 0 AND (said = 0 OR silent < said)) AND regexp_replace(CASE WHEN said > 0 THEN substr(txt, said + 11) ELSE txt END, '{WHITE}+', '', 'g') <> ''""")
def response_records(spark, d):
    """Responses that say something, in any line, while a query is active."""
    o = outputs(spark, d).withColumn("asked", F.col("id") % 2 == 0).where("asked")
    return o.select("id", X.response_payload(X.normalise_output(F.col("raw"), whole=True)).isNotNull().alias("has_payload"), "asked").where("has_payload")


@query(f"""WITH {TURNS}, i AS (SELECT session, t, 'data:image/png;base64,' || repeat(md5(coalesce(text, '')), CASE WHEN t % 2 = 1 THEN 7 ELSE 3 END) AS image, 'data:image/jpeg;base64,' || repeat(md5(role), 9) AS other FROM turns)
SELECT session, t, CASE WHEN t % 2 = 1 THEN '__image_0__' ELSE image END AS first, CASE WHEN t % 2 = 1 THEN '__image_1__' ELSE '__image_0__' END AS second, CASE WHEN t % 2 = 1 THEN image || ' ' || other ELSE other END AS images FROM i""")
def nested_images(spark, d):
    """Records with images at several depths: long ones leave numbered marks, depth-first."""
    image = F.concat(F.lit("data:image/png;base64,"), F.repeat(F.md5(F.coalesce("text", F.lit(""))), F.when(F.col("t") % 2 == 1, 7).otherwise(3)))
    other = F.concat(F.lit("data:image/jpeg;base64,"), F.repeat(F.md5("role"), 9))
    part = lambda kind, text, url: F.struct(F.lit(kind).alias("type"), text.alias("text"), F.struct(url.alias("url")).alias("image_url"))
    none = F.lit(None).cast("string")
    deep = F.struct(F.array(part("text", F.col("text"), none), part("image_url", none, image)).alias("content"))
    record = F.to_json(F.struct(F.array(deep).alias("messages"), F.create_map(F.lit("last"), other).alias("extra")))
    r = turns(spark, d).select("session", "t", M.without_images(record).alias("r"))
    at = lambda path: F.get_json_object("r.record", path)
    return r.select("session", "t", at("$.messages[0].content[1].image_url.url").alias("first"), at("$.extra.last").alias("second"), F.array_join("r.images.image", " ").alias("images"))


@query(f"""WITH {FRAMES}, s AS (SELECT session, 20 + session * 37 % 400 AS dur FROM frames GROUP BY 1), n AS (SELECT *, CASE WHEN session % 3 = 0 THEN session % 5 ELSE 0 END AS have, dur * CASE WHEN dur >= 160 THEN 1 WHEN dur >= 64 THEN 2 ELSE 4 END AS made FROM s)
SELECT 'v/' || session AS dir, have > 0 AS reused, CASE WHEN have > 0 THEN have ELSE made END AS n, 'v/' || session || '/' || CASE WHEN have > 0 THEN 'old_0.jpg' ELSE 'frame_000000.jpg' END AS first FROM n""")
def frame_reuse(spark, d):
    """Frames that a folder has are used again; others are named as extraction does."""
    f = frames(spark, d).select("session").distinct()
    place = F.concat(F.lit("v/"), F.col("session").cast("string"))
    listed = f.where("session % 3 = 0 AND session % 5 > 0").select(place.alias("dir"), F.transform(F.sequence(F.lit(0), (F.col("session") % 5).cast("int")), lambda i: F.when(i < F.col("session") % 5, F.concat(F.lit("old_"), i.cast("string"), F.lit(".jpg"))).otherwise("note.txt")).alias("names"))
    r = convert.frame_paths(f.select(place.alias("dir"), (F.col("session") * 37 % 400 + 20).alias("duration")), listed)
    return r.select("dir", "reused", F.size("paths").cast("bigint").alias("n"), F.get("paths", F.lit(0)).alias("first"))


@query(f"""WITH {FRAMES}, s AS (SELECT session, count(*) AS cached FROM frames GROUP BY 1), r AS (SELECT *, least(greatest(0.1, (session % 9)::DOUBLE * (session % 5)::DOUBLE * 4), 60.0)::DOUBLE AS rate, least(greatest(1, CASE WHEN session % 150 = 0 THEN 100 ELSE session % 150 END), 100) AS wanted FROM s)
SELECT session, rate, round(1.0 / rate, 9)::DOUBLE AS interval_s, wanted::BIGINT AS wanted, least(cached, wanted)::BIGINT AS taken FROM r""")
def sampling_records(spark, d):
    """What the background service tells of its sampling."""
    s = frames(spark, d).groupBy("session").agg(F.count("*").alias("cached"))
    k = F.col("session")
    r = s.select("session", V.background_config(F.lit(True), (k % 9).cast("double"), k % 5 * 4, k % 150, F.col("cached")).alias("r"))
    return r.select("session", F.col("r.background_fps").alias("rate"), F.round("r.sample_interval_seconds", 9).alias("interval_s"), F.col("r.target_frame_count").alias("wanted"), F.col("r.cached_frame_count").alias("taken"))
