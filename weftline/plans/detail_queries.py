"""Queries on settings, labels, speech messages and model slots, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from weftline.functions import audio, values
from weftline.functions import text as X
from weftline.operators import convert, slots
from weftline.plans.session_queries import FT
from weftline.plans.text_queries import NORMAL, SAMPLES
from weftline.sources.views import FRAMES, OUTPUTS, TURNS, frames, outputs, table, turns

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def put(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return put


def chosen(key, *options):
    """The option whose place is ``key``; the last for all others."""
    out = None
    for i, v in enumerate(options[:-1]):
        out = F.when(key == i, v) if out is None else out.when(key == i, v)
    return out.otherwise(options[-1])


@query("SELECT event_id, least(greatest(CASE event_id % 4 WHEN 2 THEN event_id % 300 WHEN 3 THEN -5 ELSE 10 END, 1), 100)::BIGINT AS frames, value BETWEEN 0.1 AND 60 AS in_range FROM events")
def clamp_settings(spark, d):
    """Stated numbers of frames within 1 to 100, 10 where none is stated, and whether an interval is allowed."""
    stated = chosen(F.col("event_id") % 4, F.lit(None), F.lit("12.5"), (F.col("event_id") % 300).cast("string"), F.lit("-5"))
    return table(spark, d, "events").select("event_id", values.bounded(stated, 10, 1, 100).alias("frames"), F.col("value").between(0.1, 60).alias("in_range"))


@query("SELECT event_id, event_id % 6 IN (0, 3, 5) AS yes, event_id % 6 <> 1 AS not_no FROM events")
def env_flags(spark, d):
    """Settings read by both rules; null takes the default, yes."""
    raw = chosen(F.col("event_id") % 6, F.lit(" Yes "), F.lit("OFF"), F.lit(""), F.lit(None), F.lit("maybe"), F.lit("1"))
    return table(spark, d, "events").select("event_id", values.is_yes(raw, True).alias("yes"), values.is_not_no(raw, True).alias("not_no"))


@query("SELECT event_id, CASE WHEN event_id % 3 = 0 THEN 'min_p=0.1,' ELSE '' END || 'top_k=' || user_id AS passed FROM events")
def sampling_params(spark, d):
    """What a request passes on of its settings."""
    e = table(spark, d, "events")
    always = F.create_map(F.lit("top_k"), F.col("user_id").cast("string"), F.lit("model"), F.col("event_type"))
    made = F.when(F.col("event_id") % 3 == 0, F.map_concat(always, F.create_map(F.lit("min_p"), F.lit("0.1")))).otherwise(always)
    entries = F.transform(F.map_entries(values.passed_on(made)), lambda x: F.concat(x.key, F.lit("="), x.value))
    return e.select("event_id", F.array_join(F.array_sort(entries), ",").alias("passed"))


@query("SELECT conv_id AS session, turn, CASE WHEN turn % 5 = 3 THEN role ELSE 'alto' END AS voice FROM conversations")
def voice_default(spark, d):
    asked = chosen(F.col("turn") % 5, F.lit(" default "), F.lit("\t"), F.lit(None), F.concat(F.lit(" "), "role", F.lit("\n")), F.lit(""))
    return turns(spark, d).select("session", "turn", values.voice(asked, "alto").alias("voice"))


@query("SELECT doc_id AS id, octet_length(encode(text))::BIGINT AS n_bytes, md5(text) AS digest, TRUE AS refused FROM documents WHERE text IS NOT NULL")
def image_url_bytes(spark, d):
    """Inline images decoded; other addresses and broken base64 have no bytes."""
    coded = F.base64(F.encode("text", "utf-8"))
    kind = chosen(F.col("doc_id") % 3, F.lit("png"), F.lit("jpeg"), F.lit("webp"))
    other = chosen(F.col("doc_id") % 3, F.concat(F.lit("data:text/plain;base64,"), coded), F.lit("data:image/png,x"), F.lit("data:image/png;base64,@@@="))
    raw = values.image_bytes(F.concat(F.lit("data:image/"), kind, F.lit(";base64,"), coded))
    docs = table(spark, d, "documents").where("text IS NOT NULL").select(F.col("doc_id").alias("id"), raw.alias("raw"), values.image_bytes(other).isNull().alias("refused"))
    return docs.select("id", F.octet_length("raw").cast("bigint").alias("n_bytes"), F.md5("raw").alias("digest"), "refused")


@query("SELECT doc_id AS id, '/api/local-file?path=' || url_encode(text) AS url FROM documents")
def percent_encoding(spark, d):
    return table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.concat(F.lit("/api/local-file?path="), values.percent_encoded(F.col("text"))).alias("url"))


@query(f"WITH {FRAMES} SELECT session, (t - 1) // 10 AS batch, arg_min(prompt, t) FILTER (prompt IS NOT NULL) AS query FROM frames GROUP BY 1, 2")
def first_query(spark, d):
    """The first query of each batch of ten frames."""
    at = F.when(F.col("prompt").isNotNull(), F.col("t"))
    return frames(spark, d).groupBy("session", F.floor((F.col("t") - 1) / 10).cast("bigint").alias("batch")).agg(F.min_by("prompt", at).alias("query"))


@query(f"""WITH {FRAMES}, l AS (SELECT session, t, (t - 1) // 4 AS batch, printf('%.1f seconds', CASE WHEN session % 2 = 0 THEN (t - 1) // 4 ELSE t - 1 END * 0.5) AS label FROM frames)
SELECT session, batch, CASE WHEN count(DISTINCT label) = 1 THEN min(label) ELSE string_agg(label, ' ~ ' ORDER BY t) END AS label FROM l GROUP BY 1, 2""")
def turn_range_label(spark, d):
    """One label a turn of four frames: the common one, or all of them."""
    batch = F.floor((F.col("t") - 1) / 4).cast("bigint")
    label = X.seconds_label(F.when(F.col("session") % 2 == 0, batch).otherwise(F.col("t") - 1) * 0.5)
    rows = F.transform(F.array_sort(F.collect_list(F.struct("t", label.alias("label")))), lambda r: r.label)
    return frames(spark, d).groupBy("session", batch.alias("batch")).agg(values.joined_range(rows).alias("label"))


@query("SELECT event_id, CASE WHEN event_id % 8 = 0 THEN (event_id % 4000 // 8)::VARCHAR ELSE rtrim(printf('%.3f', event_id % 4000 / 8), '0') END || 's' AS compact, printf('%.3f relative seconds', event_id % 4000 / 8) AS stamp FROM events")
def compact_labels(spark, d):
    """Eighths of seconds in their short form and as a time stamp."""
    s = F.col("event_id") % 4000 / 8
    return table(spark, d, "events").select("event_id", X.compact_seconds(s).alias("compact"), F.format_string("%.3f relative seconds", s).alias("stamp"))


@query(f"WITH {OUTPUTS}, {NORMAL} SELECT id, output AS content, CASE WHEN id % 3 = 0 THEN 0 ELSE id END::BIGINT AS prompt_tokens, CASE WHEN id % 3 = 0 THEN 0 ELSE id + 7 END::BIGINT AS total_tokens FROM norm")
def completion_envelope(spark, d):
    """Answers with their usage; every third has none and counts as zeros."""
    usage = F.when(F.col("id") % 3 != 0, F.struct(F.col("id").alias("prompt_tokens"), (F.col("id") + 7).alias("total_tokens")))
    o = outputs(spark, d).select("id", X.normalise_output(F.col("raw")).alias("content"), usage.alias("usage"))
    return o.select("id", "content", *[F.coalesce(F.col(f"usage.{c}"), F.lit(0)).cast("bigint").alias(c) for c in ("prompt_tokens", "total_tokens")])


SPEECH = f"""{FRAMES}, s AS (SELECT *, min(t) FILTER (event_type = 'error') OVER (PARTITION BY session) AS fin, first_value(event_type) OVER (PARTITION BY session ORDER BY t) = 'signup' AS configured FROM frames)"""


@query(f"""WITH {SPEECH} SELECT session, bool_and(configured) AS configured, coalesce(string_agg(event_id::VARCHAR, '' ORDER BY t) FILTER (event_type <> 'signup' AND event_type <> 'error'), '') AS text,
 arg_max(event_id % 5, t) FILTER (event_id % 5 > 0) AS emotion FROM s WHERE fin IS NULL OR t <= fin GROUP BY 1""")
def tts_session(spark, d):
    """A speech request's text up to its commit (error), the last emotion named, and whether it began by configuring
    (signup)."""
    f = audio.until_final(frames(spark, d).withColumn("final", F.col("event_type") == "error"))
    said = F.when(~F.col("event_type").isin("signup", "error"), F.struct("t", F.col("event_id").cast("string").alias("x")))
    emotion = F.col("event_id") % 5
    g = f.groupBy("session").agg(F.min_by("event_type", "t").alias("first"), F.array_sort(F.collect_list(said)).alias("parts"), F.max_by(emotion, F.when(emotion > 0, F.col("t"))).alias("emotion"))
    return g.select("session", (F.col("first") == "signup").alias("configured"), F.array_join(F.transform("parts", lambda p: p.x), "").alias("text"), "emotion")


@query(f"WITH {SPEECH} SELECT session, sum(CASE WHEN event_type IN ('view', 'click') THEN event_id % 100 ELSE 0 END)::BIGINT AS n_bytes, bool_or(fin IS NOT NULL) AS done FROM s WHERE fin IS NULL OR t <= fin GROUP BY 1")
def tts_audio_bytes(spark, d):
    """Audio bytes (views, clicks) of a speech stream until it is done (error)."""
    f = audio.until_final(frames(spark, d).withColumn("final", F.col("event_type") == "error"))
    n = F.when(F.col("event_type").isin("view", "click"), F.col("event_id") % 100).otherwise(0)
    return f.groupBy("session").agg(F.sum(n).cast("bigint").alias("n_bytes"), F.max(F.col("event_type") == "error").alias("done"))


@query()
def word_wrap(spark, d):
    """Captions filled into lines of 60. No SQL: each line depends on the one before; tests hold it against brute
    force."""
    return table(spark, d, "documents").select(F.col("doc_id").alias("id"), values.wrapped(F.col("text")).alias("lines"))


def _backwards(texts: list[str]) -> list[str]:
    return ["</response> " + t[::-1] for t in texts]


@query(f"WITH {TURNS}, {FT} SELECT session, turn, CASE WHEN query IS NULL THEN '</silence>' ELSE '</response> ' || array_to_string(list_reverse(string_split(text, '')), '') END AS output FROM filled")
def model_decisions(spark, d):
    """Turns through a model slot, here one that says texts backwards; not asked before the first query."""
    from pyspark.sql import Window

    known = F.last("prompt", ignorenulls=True).over(Window.partitionBy("session").orderBy("t").rowsBetween(Window.unboundedPreceding, 0))
    return slots.decided(turns(spark, d).withColumn("query", known), "query", "text", _backwards).select("session", "turn", "output")


@query(f"""WITH {FRAMES} SELECT session, (t - 1) // 12 AS batch, '<' || min(t) || 's - ' || max(t) || 's>' || chr(10) || '</response> ' || reverse(string_agg(event_type, chr(10) ORDER BY t)) AS body FROM frames GROUP BY 1, 2""")
def compress_longterm(spark, d):
    """Batches of twelve summaries through a compressing slot."""
    f = frames(spark, d).withColumns({"batch": F.floor((F.col("t") - 1) / 12).cast("bigint"), "label": F.concat(F.col("t").cast("string"), F.lit("s"))})
    return slots.compressed(f, ["session", "batch"], "t", "label", "event_type", _backwards)


@query(f"""WITH {SAMPLES}, g AS (SELECT session, sec, CASE WHEN dur >= 160 THEN 1 WHEN dur >= 64 THEN 2 ELSE 4 END AS fps FROM grid)
SELECT session, sec, unnest(range(0, fps)) AS nth, printf('frame_%06d.jpg', sec * fps + unnest(range(0, fps))) AS path FROM g""")
def convert_images(spark, d):
    """The images of each second of an accepted sample, in order."""
    samples, events = convert.role_samples(frames(spark, d))
    g = convert.grid(samples, events).select("session", "sec").join(samples.select("session", "duration"), "session")
    g = g.select("session", "sec", convert.fps(F.col("duration")).alias("fps")).withColumn("nth", F.explode(F.expr("sequence(0L, fps - 1)")))
    return g.select("session", "sec", "nth", F.format_string("frame_%06d.jpg", F.col("sec") * F.col("fps") + F.col("nth")).alias("path"))
