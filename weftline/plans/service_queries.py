"""Queries on runs, results, prompts, buffers and clocks, each with its SQL."""

from __future__ import annotations

import json
import re

from pyspark.sql import Window
from pyspark.sql import functions as F

from weftline.functions import html, jsontext, values
from weftline.functions import results as R
from weftline.functions import text as X
from weftline.operators import folds
from weftline.operators import turns as T
from weftline.plans.session_queries import FF
from weftline.sources.views import FRAMES, TURNS, frames, table, turns

QUERIES, SQL = {}, {}
HOUR = 3_600_000_000


def query(sql: str | None = None):
    def put(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return put


def session_window():
    return Window.partitionBy("session").orderBy("t")


LINES = """l AS (SELECT user_id AS session, event_id, CASE event_type WHEN 'signup' THEN 'thread.started' WHEN 'error' THEN 'broken' WHEN 'purchase' THEN 'turn.completed' ELSE 'item.completed' END AS type,
 CASE WHEN event_type = 'view' THEN CASE WHEN event_id % 3 = 0 THEN 'web_search' ELSE 'agent_message' END WHEN event_type = 'click' THEN 'command_execution' END AS item, event_id % 4 > 0 AS speaks FROM events)"""


@query(f"""WITH {LINES}, good AS (SELECT * FROM l WHERE type <> 'broken'), c AS (SELECT session, type, count(*) AS n FROM good GROUP BY 1, 2), i AS (SELECT session, item, count(*) AS n FROM good WHERE item IS NOT NULL GROUP BY 1, 2),
ct AS (SELECT session, string_agg(type || '=' || n, ',' ORDER BY type) AS events FROM c GROUP BY 1), it AS (SELECT session, string_agg(item || '=' || n, ',' ORDER BY item) AS items FROM i GROUP BY 1)
SELECT l.session, max(ct.events) AS events, coalesce(max(it.items), '') AS items, 'th' || max(event_id) FILTER (type = 'thread.started') AS thread_id, max(event_id) FILTER (type = 'turn.completed') AS last_usage,
 'said ' || max(event_id) FILTER (item = 'agent_message' AND speaks) AS last_message, count(*) FILTER (item = 'web_search') AS n_searches, count(*) FILTER (item = 'command_execution') AS n_commands, count(*) FILTER (type = 'broken') AS n_errors
FROM l LEFT JOIN ct USING (session) LEFT JOIN it USING (session) GROUP BY l.session""")
def agent_digest(spark, d):
    """Each run's log read line by line: counts by type and by item type, the last thread, usage and message, searches,
    commands and lines that are no JSON."""
    k, i = F.col("event_type"), F.col("event_id").cast("string")
    item = F.when(k == "view", F.when(F.col("event_id") % 3 == 0, F.lit('{"type": "web_search"}')).otherwise(F.concat(F.lit('{"type": "agent_message", "text": "'), F.when(F.col("event_id") % 4 > 0, F.concat(F.lit(" said "), i)).otherwise("  "), F.lit('"}')))).when(k == "click", '{"type": "command_execution"}')
    line = F.when(k == "signup", F.concat(F.lit('{"type": "thread.started", "thread_id": "th'), i, F.lit('"}'))).when(k == "error", F.concat(F.lit("{oops "), i)).when(k == "purchase", F.concat(F.lit('{"type": "turn.completed", "usage": {"total": '), i, F.lit("}}"))).otherwise(F.concat(F.lit('{"type": "item.completed", "item": '), item, F.lit("}")))
    log = table(spark, d, "events").select(F.col("user_id").alias("session"), F.col("event_id").alias("line_no"), line.alias("line"))
    r = jsontext.agent_digest(log)
    return r.withColumn("last_usage", F.get_json_object("usage", "$.total").cast("bigint")).drop("usage")


@query(f"""WITH {FRAMES}, q AS (SELECT session, event_id, t, event_type = 'signup' AS queued, answered, sum(answered::INT) OVER (PARTITION BY session ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM frames),
r AS (SELECT session, coalesce(before, 0) AS before, max(event_id) FILTER (queued) AS task, count(*) FILTER (queued) AS n_queued, max(t) FILTER (answered) AS emitted_at FROM q GROUP BY 1, 2)
SELECT session, emitted_at, task, n_queued FROM r WHERE emitted_at IS NOT NULL AND task IS NOT NULL""")
def handoff_slot(spark, d):
    """Results that are queued (signup) wait in one place: the last of them rides on the next response, once, and those
    before it are lost. One running sum a session, no join."""
    f = frames(spark, d).withColumn("before", F.coalesce(F.sum(F.col("answered").cast("bigint")).over(T.so_far(-1)), F.lit(0)))
    queued = F.col("event_type") == "signup"
    g = f.groupBy("session", "before").agg(F.max_by("event_id", F.when(queued, F.col("t"))).alias("task"), F.count_if(queued).alias("n_queued"), F.max(F.when(F.col("answered"), F.col("t"))).alias("emitted_at"))
    return g.where("emitted_at IS NOT NULL AND task IS NOT NULL").select("session", "emitted_at", "task", "n_queued")


@query(f"""WITH {FRAMES}, p AS (SELECT *, CASE WHEN event_type = 'signup' THEN t END AS set_at, last_value(CASE WHEN answered THEN t END IGNORE NULLS) OVER (PARTITION BY session ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS used_at FROM frames),
s AS (SELECT *, last_value(set_at IGNORE NULLS) OVER (PARTITION BY session ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS latest, last_value(prompt IGNORE NULLS) OVER (PARTITION BY session ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS said FROM p)
SELECT session, t, CASE WHEN latest > coalesce(used_at, 0) THEN said END AS prompt FROM s WHERE answered""")
def one_shot_prompt(spark, d):
    """A prompt serves the next processed turn and is gone then; a new one that came meanwhile is kept for the turn
    after."""
    before = T.so_far(-1)
    f = frames(spark, d).withColumns({"set_at": F.last(F.when(F.col("prompt").isNotNull(), F.col("t")), True).over(before), "said": F.last("prompt", True).over(before), "used_at": F.last(F.when(F.col("answered"), F.col("t")), True).over(before)}).where("answered")
    return f.select("session", "t", F.when(F.col("set_at") > F.coalesce("used_at", F.lit(0)), F.col("said")).alias("prompt"))


@query(f"""WITH {FRAMES}, r AS (SELECT *, coalesce(sum((event_type = 'error')::INT) OVER (PARTITION BY session ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS life FROM frames)
SELECT session, life, min(t) AS first_turn, max(t) AS last_turn, count(*) FILTER (event_type <> 'error') AS n_turns, bool_or(event_type = 'error') AS reset FROM r GROUP BY 1, 2""")
def session_resets(spark, d):
    """A reset (error) ends what a session remembers and is flushed with it; the next frame begins anew."""
    f = frames(spark, d).withColumn("reset", F.col("event_type") == "error")
    f = f.withColumn("life", F.coalesce(F.sum(F.col("reset").cast("bigint")).over(T.so_far(-1)), F.lit(0)))
    return f.groupBy("session", "life").agg(F.min("t").alias("first_turn"), F.max("t").alias("last_turn"), F.count_if(~F.col("reset")).alias("n_turns"), F.max("reset").alias("reset"))


@query(f"""WITH {FRAMES}, r AS (SELECT *, coalesce(sum((event_type = 'error')::INT) OVER (PARTITION BY session ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS life FROM frames),
n AS (SELECT *, row_number() OVER (PARTITION BY session, life ORDER BY t) AS k FROM r), j AS (SELECT session, life, (k - 1) // 10 + 1 AS job, max(event_id % 7 = 0 AND k % 10 = 8) AS failed, count(*) AS size FROM n GROUP BY 1, 2, 3),
b AS (SELECT session, life, min(job) AS job FROM j WHERE failed GROUP BY 1, 2)
SELECT session, t, coalesce(k > 10 * b.job, FALSE) AS failed FROM n LEFT JOIN b USING (session, life)""")
def summary_failures(spark, d):
    """A summary that fails stays at the head of its queue: every turn from its chunk's end on fails until a reset (error).
    Here the job submitted at the eighth turn of a chunk of ten fails where the turn's event is a multiple of seven."""
    f = frames(spark, d).withColumn("life", F.coalesce(F.sum((F.col("event_type") == "error").cast("bigint")).over(T.so_far(-1)), F.lit(0)))
    life = Window.partitionBy("session", "life").orderBy("t")
    f = f.withColumn("k", F.row_number().over(life)).withColumn("bad_job", F.when((F.col("event_id") % 7 == 0) & (F.col("k") % 10 == 8), F.floor((F.col("k") - 1) / 10) + 1))
    first_bad = F.min("bad_job").over(life.rowsBetween(Window.unboundedPreceding, 0))
    return f.select("session", "t", F.coalesce(F.col("k") > 10 * first_bad, F.lit(False)).alias("failed"))


@query(f"""WITH {FRAMES}, p AS (SELECT *, lead(us) OVER w AS nx, lead(event_type) OVER w AS nt, last_value(CASE WHEN event_type IN ('view', 'purchase') THEN event_id END IGNORE NULLS) OVER (PARTITION BY session ORDER BY t ROWS UNBOUNDED PRECEDING) AS heard, row_number() OVER w AS rn FROM frames WINDOW w AS (PARTITION BY session ORDER BY t))
SELECT session, event_id, coalesce('text ' || heard, '') AS text, CASE WHEN nx IS NULL OR nx - us > {12 * HOUR} THEN us + {12 * HOUR} ELSE nx END AS at_us FROM p WHERE event_type = 'click' AND (nx IS NULL OR nx - us > {12 * HOUR} OR nt = 'signup')""")
def synthetic_finals(spark, d):
    """A pause (click) that nothing follows within the grace time, or that a new utterance (signup) follows, makes a final
    result of the last text heard (view, purchase)."""
    w = session_window()
    heard = F.last(F.when(F.col("event_type").isin("view", "purchase"), F.col("event_id")), True).over(T.so_far())
    p = frames(spark, d).withColumns({"nx": F.lead("us").over(w), "nt": F.lead("event_type").over(w), "heard": heard}).where("event_type = 'click'")
    late = F.col("nx").isNull() | (F.col("nx") - F.col("us") > 12 * HOUR)
    p = p.where(late | (F.col("nt") == "signup"))
    return p.select("session", "event_id", F.coalesce(F.concat(F.lit("text "), F.col("heard").cast("string")), F.lit("")).alias("text"), F.when(late, F.col("us") + 12 * HOUR).otherwise(F.col("nx")).alias("at_us"))


@query(f"""WITH {FRAMES}, g AS (SELECT session, t, us, us - lag(us) OVER (PARTITION BY session ORDER BY t) AS gap, us - first_value(us) OVER (PARTITION BY session ORDER BY t) AS spent FROM frames),
e AS (SELECT session, t, CASE WHEN gap > {30 * HOUR} THEN 'idle' WHEN spent > {500 * HOUR} THEN 'total' END AS why FROM g)
SELECT session, arg_min(why, t) AS why, min(t) AS at_turn FROM e WHERE why IS NOT NULL GROUP BY 1""")
def stream_timeouts(spark, d):
    """How a stream ends: after a wait for the next message, or when it takes too long in all; whichever comes first."""
    w = session_window()
    f = frames(spark, d).withColumns({"gap": F.col("us") - F.lag("us").over(w), "spent": F.col("us") - F.first("us").over(w)})
    f = f.withColumn("why", F.when(F.col("gap") > 30 * HOUR, "idle").when(F.col("spent") > 500 * HOUR, "total")).where("why IS NOT NULL")
    return f.groupBy("session").agg(F.min_by("why", "t").alias("why"), F.min("t").alias("at_turn"))


@query(f"""WITH {FRAMES} SELECT session, t, (us - first_value(us) OVER w)::DOUBLE * (1.0 / 90000) AS relative_s, greatest(0, value)::DOUBLE AS interval_s, (us + 5000 * (event_id % 3)) - (first_value(us + 5000 * (event_id % 3)) OVER w + (us - first_value(us) OVER w)) AS latency_us FROM frames WINDOW w AS (PARTITION BY session ORDER BY t)""")
def frame_clock(spark, d):
    """Time stamps of frames from their counts and the stream's time base, and how late each frame is."""
    w = session_window()
    wall = F.col("us") + 5000 * (F.col("event_id") % 3)
    since = F.col("us") - F.first("us").over(w)
    return frames(spark, d).select("session", "t", (since.cast("double") * F.lit(1.0 / 90000)).alias("relative_s"), F.greatest(F.lit(0.0), "value").alias("interval_s"), (wall - (F.first(wall).over(w) + since)).alias("latency_us"))


@query(f"""WITH {FRAMES}, m AS (SELECT session, t, event_type || '|' || (event_id % 2) AS record FROM frames) SELECT session, t FROM (SELECT *, lag(record) OVER (PARTITION BY session ORDER BY t) AS p FROM m) WHERE p IS DISTINCT FROM record""")
def canonical_change(spark, d):
    """A memory record is passed on where its canonical form differs from the last one; maps filled in another order are the
    same record."""
    kind, bit = F.col("event_type"), (F.col("event_id") % 2).cast("string")
    one = F.create_map(F.lit("kind"), kind, F.lit("bit"), bit)
    other = F.create_map(F.lit("bit"), bit, F.lit("kind"), kind)
    h = jsontext.canonical_hash(F.when(F.col("t") % 2 == 0, one).otherwise(other))
    m = frames(spark, d).select("session", "t", h.alias("h"))
    return m.withColumn("p", F.lag("h").over(session_window())).where("NOT (p <=> h)").select("session", "t")


@query(f"""WITH {FRAMES}, k AS (SELECT session, t - 1 AS i, count(*) OVER (PARTITION BY session) AS n, CASE WHEN session % 2 = 0 THEN printf('%.1f seconds', (t - 1) * 2.0) ELSE ((t - 1) * 2)::VARCHAR || 's-' || (t * 2)::VARCHAR || 's' END AS label FROM frames),
p AS (SELECT session, i AS lo, least(i + 3, n - 1) AS hi FROM k WHERE i % 4 = 0)
SELECT session, lo, CASE WHEN session % 2 = 0 THEN lo || 's-' || (hi + 1) || 's' ELSE lo * 2 || 's-' || ((hi + 1) * 2) || 's' END AS range FROM p""")
def range_texts(spark, d):
    """Ranges of four frames from the labels of the first and the last, or from their places where labels name no range."""
    i = F.col("t") - 1
    label = F.when(F.col("session") % 2 == 0, X.seconds_label(i * 2.0)).otherwise(F.concat((i * 2).cast("string"), F.lit("s-"), (F.col("t") * 2).cast("string"), F.lit("s")))
    f = frames(spark, d).select("session", i.alias("i"), label.alias("label"))
    g = f.groupBy("session", (F.col("i") - F.col("i") % 4).alias("lo")).agg(F.max("i").alias("hi"), F.min_by("label", "i").alias("a"), F.max_by("label", "i").alias("b"))
    return g.select("session", "lo", X.index_range(F.col("lo"), F.col("hi"), F.col("a"), F.col("b")).alias("range"))


@query("SELECT user_id AS session, count(DISTINCT event_id % 40) - count(DISTINCT event_id % 40) FILTER (event_id % 40 < 10) AS to_probe FROM events GROUP BY 1")
def video_probes(spark, d):
    """Videos that a session names and whose duration is not known yet (the first ten are), each once."""
    v = table(spark, d, "events").select(F.col("user_id").alias("session"), (F.col("event_id") % 40).alias("video"))
    known = spark.range(10).withColumnRenamed("id", "video")
    every = v.select("session").distinct()
    n = v.distinct().join(F.broadcast(known), "video", "left_anti").groupBy("session").agg(F.count("*").alias("n"))
    return every.join(n, "session", "left").select("session", F.coalesce("n", F.lit(0)).alias("to_probe"))


@query(f"WITH {FRAMES} SELECT session, sum(event_id % 1000)::BIGINT AS n_bytes, sum(event_id % 1000) / 32000.0 AS seconds FROM frames GROUP BY 1")
def audio_seconds(spark, d):
    """Bytes of a session's 16-bit audio at 16 kHz, and how long it lasts."""
    return frames(spark, d).groupBy("session").agg(F.sum(F.col("event_id") % 1000).alias("n_bytes")).withColumn("seconds", F.col("n_bytes") / (16000 * 2.0))


@query(f"""WITH RECURSIVE {FRAMES}, g AS (SELECT *, us + (event_id * 7919 % 20) * 1000000 AS wall FROM frames),
run AS (SELECT session, t, us AS p0, wall AS w0, 0::BIGINT AS drops, TRUE AS kept FROM g WHERE t = 1
 UNION ALL SELECT g.session, g.t, CASE WHEN late AND drops >= 5 THEN g.us ELSE p0 END, CASE WHEN late AND drops >= 5 THEN wall ELSE w0 END, CASE WHEN late AND drops < 5 THEN drops + 1 ELSE 0 END, NOT (late AND drops < 5)
 FROM (SELECT g.*, r.p0, r.w0, r.drops, g.wall - r.w0 - (g.us - r.p0) > 4000000 AS late FROM run r JOIN g ON g.session = r.session AND g.t = r.t + 1) g)
SELECT session, count(*) FILTER (NOT kept) AS n_dropped, count(*) AS n_frames FROM run GROUP BY 1""")
def dropped_frames(spark, d):
    """How many frames each session lost for being late."""
    f = frames(spark, d).withColumn("wall", F.col("us") + (F.col("event_id") * 7919 % 20) * 1_000_000)
    return folds.late_drop(f, "wall", 4_000_000, 5).groupBy("session").agg(F.count_if(~F.col("kept")).alias("n_dropped"), F.count("*").alias("n_frames"))


@query("SELECT event_id, CASE WHEN event_id % 13 < 3 OR event_id % 13 IN (5, 7, 11) THEN TRUE ELSE FALSE END AS retried FROM events")
def retried_errors(spark, d):
    """Which failed connections are tried again: timeouts and broken ones, and some statuses."""
    states = ["timeout", "os", "connection", "400", "401", "408", "404", "429", "501", "302", "200", "503", "418"]
    at = F.element_at(F.array(*map(F.lit, states)), (F.col("event_id") % 13 + 1).cast("int"))
    return table(spark, d, "events").select("event_id", values.retried(F.when(at.isin("timeout", "os", "connection"), at), at.try_cast("int")).alias("retried"))


@query("""SELECT event_id, value BETWEEN 0.1 AND 60 AS interval_ok, event_id % 40 BETWEEN 1 AND 30 AS batch_ok, event_id % 12 <= 10 AS latency_ok FROM events""")
def setting_ranges(spark, d):
    """Whether an interval, a batch and a latency are within what is allowed."""
    return table(spark, d, "events").select("event_id", values.within(F.col("value"), "interval").alias("interval_ok"), values.within(F.col("event_id") % 40, "batch").alias("batch_ok"), values.within(F.col("event_id") % 12, "latency").alias("latency_ok"))


@query("""WITH e AS (SELECT event_id, event_id % 8 AS k, event_id % 3000 - 500 AS v FROM events)
SELECT event_id, CASE WHEN k IN (0, 1) THEN 1.0 WHEN v <= 0 THEN 1.0 ELSE least(v / 7.0, 60) END AS fps, CASE WHEN k IN (0, 1) THEN 640 WHEN v <= 0 THEN 0 ELSE least(greatest(256, v), 2048) END::BIGINT AS long_edge, CASE WHEN k IN (0, 1) THEN NULL WHEN v <= 0 THEN 30 ELSE least(v, 100) END::BIGINT AS frames, least(greatest(1, v), 10)::BIGINT AS multiplier FROM e""")
def bounded_settings(spark, d):
    """Rates, long edges and numbers of frames as they are taken; none and words take the defaults."""
    v = F.col("event_id") % 3000 - 500
    stated = F.when(F.col("event_id") % 8 == 0, F.lit(None)).when(F.col("event_id") % 8 == 1, F.lit("x")).otherwise(v.cast("string"))
    return table(spark, d, "events").select("event_id", values.frame_rate(stated.try_cast("double") / F.lit(7.0), 1.0).alias("fps"), values.long_edge(stated, 640).alias("long_edge"), values.frame_limit(stated, 30).alias("frames"), F.least(F.greatest(F.lit(1), v), F.lit(10)).alias("multiplier"))


@query("""WITH e AS (SELECT event_id, 100 + event_id % 900 AS w, 300 AS h, event_id % 7 AS a FROM events)
SELECT event_id, least(0.5 * pow(2, a), 5)::DOUBLE AS wait_s, CASE WHEN a = 0 THEN 0 ELSE 2 * pow(2, a - 1) END::DOUBLE AS reconnect_s, greatest(1, floor(w * least(1.0, sqrt(50000.0 / (w * h)))))::BIGINT AS fit_w, greatest(1, floor(h * least(1.0, sqrt(50000.0 / (w * h)))))::BIGINT AS fit_h,
 CASE WHEN greatest(w, h) > 640 THEN greatest(1, round_even(w * (640 / greatest(w, h)::DOUBLE), 0)) ELSE w END::BIGINT AS edge_w, CASE WHEN greatest(w, h) > 640 THEN greatest(1, round_even(h * (640 / greatest(w, h)::DOUBLE), 0)) ELSE h END::BIGINT AS edge_h FROM e""")
def image_fits(spark, d):
    """Waits before a new try, and the sides of images that fit an area or a long edge."""
    w, h, a = F.col("event_id") % 900 + 100, F.lit(300), F.col("event_id") % 7
    area, edge = values.fit_area(w, h, 50000), values.fit_edge(w, h, 640)
    return table(spark, d, "events").select("event_id", values.wait(a, 0.5, 5.0).alias("wait_s"), values.reconnect_wait(a, 2.0).alias("reconnect_s"), area["width"].alias("fit_w"), area["height"].alias("fit_h"), edge["width"].alias("edge_w"), edge["height"].alias("edge_h"))


@query(f"""WITH {FRAMES}, s AS (SELECT session, string_agg(event_type, ' ' ORDER BY t) AS told, sum((event_type = 'click')::INT) AS keys, min(t) AS a, max(t) AS b, 1 + (t - 1) // 10 AS chunk FROM frames GROUP BY session, chunk)
SELECT session, chunk, CASE WHEN keys = 0 THEN '[No key frames] ' || a || 's-' || b || 's' ELSE '</response> ' || reverse(told) END AS summary FROM s""")
def midterm_summaries(spark, d):
    """A chunk's summary by a model slot, or, for a chunk without key frames (clicks), a sentence by a template."""
    from weftline.operators import slots
    from weftline.plans.detail_queries import _backwards

    g = frames(spark, d).groupBy("session", T.chunk(F.col("t"), 10).alias("chunk")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("t", "event_type"))), lambda r: r.event_type), " ").alias("told"), F.count_if(F.col("event_type") == "click").alias("keys"), F.min("t").alias("a"), F.max("t").alias("b"))
    label = F.concat(F.col("a").cast("string"), F.lit("s-"), F.col("b").cast("string"), F.lit("s"))
    return g.select("session", "chunk", slots.summarised(F.col("keys"), F.col("told"), label, "[No key frames] {range}", _backwards).alias("summary"))


@query(f"""WITH {FRAMES} SELECT session, t AS phase, event_id AS frame, coalesce(CASE WHEN t % 3 = 0 THEN 'src ' || t END, CASE WHEN t % 3 = 1 THEN t || 's' END, 'unknown') AS label FROM frames WHERE event_type = 'click'""")
def prompt_phases(spark, d):
    """A prompt has one phase for each key frame (click), under its source's range, else its own, else none."""
    source, own = F.when(F.col("t") % 3 == 0, F.concat(F.lit("src "), F.col("t").cast("string"))), F.when(F.col("t") % 3 == 1, F.concat(F.col("t").cast("string"), F.lit("s")))
    return frames(spark, d).where("event_type = 'click'").select("session", F.col("t").alias("phase"), F.col("event_id").alias("frame"), F.coalesce(source, own, F.lit("unknown")).alias("label"))


def _words(texts: list[str]) -> list[list[str]]:
    return [[w for w in re.split("[ \t\n\v\f\r]+", t) if w] for t in texts]


@query("SELECT doc_id AS id, len(list_filter(string_split_regex(coalesce(text, ''), '[ \\t\\n\\x0B\\f\\r]+'), lambda x: x <> ''))::BIGINT AS by_slot, coalesce(length(text) // 4, 0) AS by_length FROM documents")
def token_estimates(spark, d):
    """Tokens of a text by a tokenizer slot, here one that cuts at white space, and by its length where there is none."""
    from weftline.operators import slots

    return table(spark, d, "documents").select(F.col("doc_id").alias("id"), slots.token_count(F.col("text"), _words).alias("by_slot"), slots.token_count(F.col("text"), None).alias("by_length"))


@query(f"""WITH {FRAMES}, p AS (SELECT session, t, event_id, row_number() OVER (PARTITION BY session ORDER BY t) AS i, count(*) OVER (PARTITION BY session) AS n FROM frames)
SELECT session, i - 1 AS place, event_id AS frame, CASE WHEN i <= n - session % 4 THEN 'payload ' || event_id END AS payload FROM p""")
def cached_payloads(spark, d):
    """Frames with the payloads cached for them, by place; the list of payloads may be the shorter one."""
    rows = F.array_sort(F.collect_list(F.struct("t", "event_id")))
    g = frames(spark, d).groupBy("session").agg(rows.alias("rows"))
    payloads = F.slice(F.transform("rows", lambda r: F.concat(F.lit("payload "), r.event_id.cast("string"))), F.lit(1), F.greatest(F.lit(0), F.size("rows") - (F.col("session") % 4).cast("int")))
    z = g.select("session", F.posexplode(F.arrays_zip(F.col("rows.event_id").alias("frame"), payloads.alias("payload"))).alias("place", "z"))
    return z.select("session", F.col("place").cast("bigint").alias("place"), "z.frame", "z.payload")


@query(f"""WITH {FRAMES}, s AS (SELECT session, count(*) AS n, max(us) AS last_us FROM frames WHERE event_type = 'view' GROUP BY 1) SELECT DISTINCT f.session, coalesce(s.n, 0) AS n_frames, s.last_us, coalesce(s.n > 0, FALSE) AS live FROM frames f LEFT JOIN s USING (session) WHERE f.event_type = 'signup'""")
def stream_status(spark, d):
    """A row for each active stream (with a signup) with its figures, if it has any."""
    f = frames(spark, d)
    active = f.where("event_type = 'signup'").select("session").distinct()
    stats = f.where("event_type = 'view'").groupBy("session").agg(F.count("*").alias("n"), F.max("us").alias("last_us"))
    return active.join(stats, "session", "left").select("session", F.coalesce("n", F.lit(0)).alias("n_frames"), "last_us", F.coalesce(F.col("n") > 0, F.lit(False)).alias("live"))


@query(f"WITH {FRAMES}, o AS (SELECT session, event_id, row_number() OVER (PARTITION BY session ORDER BY event_id) - 1 AS place FROM frames) SELECT session, place, event_id FROM o")
def restored_order(spark, d):
    """Results that came back in any order, each with its place in the input."""
    done = frames(spark, d).select("session", "event_id").repartition(F.col("event_id") % 5)
    return done.select("session", (F.row_number().over(Window.partitionBy("session").orderBy("event_id")) - 1).cast("bigint").alias("place"), "event_id")


@query(f"""WITH {TURNS} SELECT session, t, 'IS_FINAL' AS kind, text, CASE WHEN t % 2 = 0 THEN 'ok' ELSE 'late' END AS msg, (t % 2)::BIGINT AS code FROM turns WHERE text IS NOT NULL""")
def asr_messages(spark, d):
    """Recognition results written as messages and read back."""
    from weftline.functions import audio

    f = turns(spark, d).where("text IS NOT NULL")
    msg = audio.asr_result(F.col("session").cast("string"), F.col("text"), F.lit("IS_FINAL"), F.col("t") % 2, F.when(F.col("t") % 2 == 0, "ok").otherwise("late"))
    return f.select("session", "t", audio.read_asr(msg).alias("r")).select("session", "t", "r.kind", "r.text", "r.msg", "r.code")


@query(f"""WITH s AS (SELECT doc_id AS id, trim(regexp_replace(text, '[\\s\\x0B\\x{{1C}}-\\x{{1F}}\\x{{85}}\\p{{Z}}]+', ' ', 'g')) AS said FROM documents), p AS (SELECT id, said, unnest(range(0, length(said), 12)) AS i FROM s)
SELECT id, i // 12 AS seq, 'append' AS kind, substr(said, i + 1, 12) AS text FROM p UNION ALL SELECT id, (length(said) + 11) // 12, CASE WHEN said = '' THEN 'error' ELSE 'commit' END, NULL FROM s WHERE said IS NOT NULL""")
def tts_messages(spark, d):
    """The messages of a speech request: a whole text in parts of twelve, then a commit; an empty text is an error."""
    from weftline.functions import audio

    m = table(spark, d, "documents").where("text IS NOT NULL").select(F.col("doc_id").alias("id"), F.posexplode(audio.speech_messages(F.col("text"), most=None)).alias("seq", "m"))
    return m.select("id", F.col("seq").cast("bigint").alias("seq"), "m.kind", "m.text")


@query("""SELECT event_id, CASE event_id % 3 WHEN 0 THEN 'Speak.' WHEN 1 THEN 'glad Speak.' ELSE 'glad' END AS instructions, CASE WHEN event_id % 5 = 0 THEN 'sample rate' END AS fault, 'alto' AS voice FROM events""")
def tts_configs(spark, d):
    """The settings of a speech session: an emotion comes before the instructions; other formats and rates are refused."""
    k = F.col("event_id") % 3
    r = values.speech_config(F.when(k < 2, " Speak. "), F.when(k > 0, "glad "), F.lit("default"), F.when(F.col("event_id") % 5 == 0, 8000).otherwise(24000), F.lit("pcm16"), "alto")
    return table(spark, d, "events").select("event_id", r.alias("r")).select("event_id", "r.instructions", "r.fault", "r.voice")


@query("""WITH b AS (SELECT page_id, CASE page_id % 4 WHEN 0 THEN 'completed' WHEN 1 THEN 'failed' END AS status, CASE WHEN page_id % 6 = 0 THEN '' ELSE 'answer ' || page_id END AS text FROM pages)
SELECT page_id, CASE WHEN status = 'failed' THEN 'Background service returned status=failed' WHEN text = '' THEN 'Background service returned empty text' END AS error, CASE WHEN coalesce(status, 'completed') = 'completed' AND text <> '' THEN text END AS body, CASE WHEN coalesce(status, 'completed') = 'completed' AND text <> '' THEN CASE WHEN page_id % 5 = 0 THEN 'given' ELSE 'tagged' END END AS summary FROM b""")
def background_results(spark, d):
    """Results of the background service: refused without success or text; a summary that comes with one beats its tag."""
    k = F.col("page_id")
    text = F.when(k % 6 == 0, " <think>x</think> <summary>s</summary> ").otherwise(F.concat(F.lit("<think>plan</think>answer "), k.cast("string"), F.lit("<summary>tagged</summary>")))
    r = X.background_result(F.when(k % 4 == 0, "completed").when(k % 4 == 1, "failed"), F.lit(None).cast("string"), text, F.when(k % 5 == 0, " given "))
    return table(spark, d, "pages").select("page_id", r.alias("r")).select("page_id", "r.error", "r.body", "r.summary")


@query(f"""WITH {TURNS}, r AS (SELECT session, t, t % 5 AS k, role, trim(regexp_replace(coalesce(text, ''), '[<>]', '', 'g'), chr(32) || chr(9) || chr(10) || chr(13)) AS said FROM turns)
SELECT session, t, CASE WHEN k = 3 THEN 'Background service returned status=failed' WHEN k IN (1, 2) AND said = '' THEN 'Background service returned empty text' END AS error,
CASE WHEN k = 3 OR (k IN (1, 2) AND said = '') THEN NULL WHEN k = 4 THEN '' ELSE said END AS body, CASE WHEN k = 3 OR (k IN (1, 2) AND said = '') THEN NULL WHEN k = 2 THEN role ELSE '' END AS summary,
CASE WHEN k = 1 AND said <> '' THEN '{{"n":' || t || '}}' END AS rich, CASE WHEN k = 1 AND said <> '' THEN '"th"|' || t WHEN k = 2 AND said <> '' THEN 'null|null' END AS told FROM r""")
def result_records(spark, d):
    """Background answers of all shapes: plain text, text or answer of a record, a record that failed, and nothing."""
    said = F.regexp_replace(F.coalesce("text", F.lit("")), "[<>]", "")
    k, t = F.col("t") % 5, F.col("t")
    record = lambda **fields: F.to_json(F.struct(*[v.alias(n) for n, v in fields.items()]))
    raw = F.when(k == 0, said).when(k == 1, record(text=said, thread_id=F.lit("th"), usage=F.lit(0), rich=F.struct(t.alias("n")), metrics=F.struct(t.alias("usage"))))
    raw = raw.when(k == 2, record(answer=F.array(F.struct(said.alias("content"))), background_summary=F.concat(F.lit("摘要: "), "role"))).when(k == 3, record(text=said, status=F.lit("failed")))
    r = R.result_records(turns(spark, d).select("session", "t", raw.alias("raw")), "raw", "r")
    told = F.concat_ws("|", F.expr("r.metrics['thread_id']"), F.expr("r.metrics['usage']"))
    return r.select("session", "t", "r.error", "r.body", "r.summary", "r.rich", F.when(F.size("r.metrics") > 0, told).alias("told"))


@query("""SELECT page_id, page_id % 3 = 0 AS has_html, CASE WHEN page_id % 3 = 0 THEN page_id % 2 = 1 END AS html_incomplete, CASE WHEN page_id % 3 > 0 THEN 'a,b' END AS labels FROM pages""")
def rich_contents(spark, d):
    """What an answer shows besides text: a page, whether it is whole, and a chart."""
    k = F.col("page_id")
    page = F.when(k % 2 == 1, F.lit("See\n```html\n<html><body><p>x</p>")).otherwise(F.lit("```html\n<html><body><p>x</p></body></html>\n```"))
    answer = F.when(k % 3 == 0, page).otherwise(F.lit('```json\n{"type": "bar_chart", "labels": ["a", "b"], "values": [1, "2.5"]}\n``` text'))
    r = html.rich(answer)
    return table(spark, d, "pages").select("page_id", r.alias("r")).select("page_id", F.col("r.html").isNotNull().alias("has_html"), F.when(F.col("r.html").isNotNull(), F.col("r.html_incomplete")).alias("html_incomplete"), F.array_join("r.chart.labels", ",").alias("labels"))


@query(f"WITH {FRAMES}, l AS (SELECT session, t, sum(length(event_type) + 7) OVER (PARTITION BY session ORDER BY t ROWS UNBOUNDED PRECEDING) AS upto FROM frames) SELECT session, count(*) FILTER (upto <= 600) AS n_read, max(upto)::BIGINT AS n_bytes, max(upto) > 600 AS failed FROM l GROUP BY 1")
def log_limit(spark, d):
    """A run's log is read up to a limit, here of 600 bytes; a longer one fails the run."""
    n = F.sum(F.length("event_type").cast("bigint") + 7).over(T.so_far())
    f = frames(spark, d).select("session", n.alias("upto"))
    return f.groupBy("session").agg(F.count_if(F.col("upto") <= 600).alias("n_read"), F.max("upto").alias("n_bytes"), (F.max("upto") > 600).alias("failed"))


def _solve(questions: list[str]) -> list[str]:
    return [json.dumps({"status": "failed"} if q.endswith("7") else {"text": f"<think>hm</think>{q}!<summary>of {q}</summary>"}) if not q.endswith("3") else f"plain {q}" for q in questions]


@query("""WITH q AS (SELECT event_id, event_type || ' ' || event_id AS q, event_id % 10 AS k FROM events)
SELECT event_id, CASE WHEN k = 7 THEN 'Background service returned status=failed' END AS error, CASE k WHEN 7 THEN NULL WHEN 3 THEN 'plain ' || q ELSE q || '!' END AS body, CASE k WHEN 7 THEN NULL WHEN 3 THEN '' ELSE 'of ' || q END AS summary FROM q""")
def background_solver(spark, d):
    """Questions through a solver slot, here one that fails on some and answers without JSON to others."""
    from weftline.operators import slots

    question = F.concat("event_type", F.lit(" "), F.col("event_id").cast("string"))
    return table(spark, d, "events").select("event_id", slots.solved(question, _solve).alias("r")).select("event_id", "r.*")


def _hear(samples: list[bytes], rate: int) -> list[str]:
    return [f"{len(x) // 2} samples at {rate}: {x[:2].hex()}" for x in samples]


@query("SELECT event_id, CASE WHEN event_id % 5 > 0 THEN '4 samples at 16000: ' || substr(lpad(lower(to_hex(event_id)), 16, '0'), 1, 4) END AS heard FROM events")
def transcriptions(spark, d):
    """Samples through a recogniser slot; those of odd length are not sent."""
    from weftline.operators import slots

    pcm = F.unhex(F.lpad(F.hex("event_id"), 16, "0"))
    pcm = F.when(F.col("event_id") % 5 == 0, F.substring(pcm, 1, 7)).otherwise(pcm)
    return table(spark, d, "events").select("event_id", slots.transcribed(pcm, 16000, _hear).alias("heard"))


@query()
def html_entities(spark, d):
    """Texts and pages with their character references read. No SQL: the references are a table of two thousand names; tests
    hold it against the standard library."""
    page = F.concat(F.lit("&amp;lt; &eacute;&#233;&#xE9; &notit; &copy &#0;&#128; "), F.coalesce("html", F.lit("")))
    return table(spark, d, "pages").select("page_id", html.unescape(page).alias("text"))
