"""Queries on records, files and streams: message parts, links, budgets, WAV and log tails, each with its SQL."""

from __future__ import annotations

from contextlib import nullcontext

from pyspark.sql import Window
from pyspark.sql import functions as F

from weftline.functions import audio, jsontext
from weftline.operators import convert, links
from weftline.plans.service_queries import SQL as SERVICE_SQL
from weftline.plans.session_queries import FF
from weftline.plans.session_queries import SQL as SESSION_SQL
from weftline.plans.text_queries import SAMPLES
from weftline.sinks import documents, files
from weftline.sources import readers
from weftline.sources.views import FRAMES, TURNS, frames, table, turns
from weftline.streaming import folds, timers

QUERIES, SQL = {}, {}
HOUR = 3_600_000_000


def query(sql: str | None = None):
    def put(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return put


@query()
def first_json(spark, d):
    """The first JSON object in an event's log text, behind a brace that opens none. No SQL: decoding that tolerates
    text after the object is not expressible; tests hold it against brute force."""
    made = F.concat(F.lit("log {x} "), F.col("props"), F.lit(" tail {"))
    return table(spark, d, "events").select("event_id", jsontext.first_object(made).alias("found"))


@query("""SELECT event_id, event_type || chr(10) || user_id || CASE WHEN event_id % 2 = 0 THEN chr(10) || 'x' ELSE '' END AS text FROM events""")
def flexible_text(spark, d):
    """The text of lists of parts of several shapes; parts that are no objects have none."""
    item = lambda k, v: F.concat(F.lit(f'{{"{k}": "'), v, F.lit('"}'))
    more = F.when(F.col("event_id") % 2 == 0, F.lit(', {"value": {"text": " x "}}')).otherwise(', "loose"')
    made = F.concat(F.lit("["), item("text", F.col("event_type")), F.lit(", "), item("content", F.col("user_id").cast("string")), more, F.lit("]"))
    return table(spark, d, "events").select("event_id", jsontext.flexible_text(made).alias("text"))


@query("""SELECT page_id AS id, CASE WHEN page_id % 3 = 0 THEN 'See [p' || page_id || '.html](/api/local-file?path=%2Fdata%2Fp' || page_id || '.html), or (/api/local-file?path=%2Fdata%2Fp' || page_id || '.html) not `/data/p' || page_id || '.html`.' ELSE 'See /data/p' || page_id || '.html, or (/data/p' || page_id || '.html) not `/data/p' || page_id || '.html`.' END AS text FROM pages""")
def link_rewrite(spark, d):
    """Paths of files that exist (every third page's) become links, outside code."""
    path = F.concat(F.lit("/data/p"), F.col("page_id").cast("string"), F.lit(".html"))
    p = table(spark, d, "pages").select(F.col("page_id").alias("id"), path.alias("path"))
    texts = p.select("id", F.concat(F.lit("See "), "path", F.lit(", or ("), "path", F.lit(") not `"), "path", F.lit("`.")).alias("text"))
    return links.rewrite(texts, p.where("id % 3 = 0").select("path")).select("id", "text")


@query(f"""WITH {TURNS}, p AS (SELECT session, t, CASE WHEN turn % 2 = 1 THEN 'data:image/png;base64,' || text ELSE text END AS part FROM turns), q AS (SELECT *, starts_with(part, 'data:image/') AND length(part) > 200 AS is_image FROM p)
SELECT session, t, CASE WHEN is_image THEN '__image_' || (sum(is_image::INT) OVER (PARTITION BY session ORDER BY t ROWS UNBOUNDED PRECEDING) - 1)::BIGINT || '__' ELSE part END AS part, CASE WHEN is_image THEN part END AS image FROM q""")
def inline_image_split(spark, d):
    """Long inline images leave a session's parts and get a number in order."""
    p = turns(spark, d).withColumn("part", F.when(F.col("turn") % 2 == 1, F.concat(F.lit("data:image/png;base64,"), "text")).otherwise(F.col("text")))
    p = p.withColumn("is_image", F.startswith("part", F.lit("data:image/")) & (F.length("part") > 200))
    n = F.sum(F.col("is_image").cast("bigint")).over(Window.partitionBy("session").orderBy("t").rowsBetween(Window.unboundedPreceding, 0)) - 1
    return p.select("session", "t", F.when(F.col("is_image"), F.concat(F.lit("__image_"), n.cast("string"), F.lit("__"))).otherwise(F.col("part")).alias("part"), F.when(F.col("is_image"), F.col("part")).alias("image"))


@query(f"""WITH {TURNS}, u AS (SELECT *, (t - 1) // 4 AS chunk, min(t) FILTER (role = 'user') OVER (PARTITION BY session, (t - 1) // 4) AS first_user FROM turns)
SELECT session, t, CASE WHEN t = first_user THEN 'memory of ' || chunk || ' chunks' || chr(10) || text ELSE text END AS content FROM u""")
def prefix_injection(spark, d):
    """The memory's prefix goes before the first user message of each chunk of four turns."""
    w = Window.partitionBy("session", "chunk")
    u = turns(spark, d).withColumn("chunk", F.floor((F.col("t") - 1) / 4).cast("bigint"))
    u = u.withColumn("first_user", F.min(F.when(F.col("role") == "user", F.col("t"))).over(w))
    return u.select("session", "t", F.when(F.col("t") == F.col("first_user"), F.concat(F.lit("memory of "), F.col("chunk").cast("string"), F.lit(" chunks\n"), "text")).otherwise(F.col("text")).alias("content"))


@query(f"""WITH {TURNS} SELECT session, t, coalesce(role, 'user') AS role, unnest([0, 1]) AS place, unnest(CASE WHEN turn % 2 = 1 THEN ['image_url', 'text'] ELSE ['text', 'other'] END) AS kind, unnest(CASE WHEN turn % 2 = 1 THEN ['data:image/jpeg;base64,x', text] ELSE [text, 'kept'] END) AS value FROM turns""")
def message_parts(spark, d):
    """Messages in the chat form: images as addresses, texts as they are, other parts kept."""
    part = lambda kind, v: F.struct(F.lit(kind).alias("kind"), v.alias("value"))
    made = F.when(F.col("turn") % 2 == 1, F.array(part("image", F.lit("x")), part("text", F.col("text")))).otherwise(F.array(part("text", F.col("text")), part("other", F.lit("kept"))))
    chat = F.transform(made, lambda p: F.when(p.kind == "image", F.struct(F.lit("image_url").alias("kind"), F.concat(F.lit("data:image/jpeg;base64,"), p.value).alias("value"))).otherwise(p))
    return turns(spark, d).select("session", "t", F.coalesce("role", F.lit("user")).alias("role"), F.posexplode(chat).alias("place", "p")).select("session", "t", "role", "place", "p.kind", "p.value")


@query(f"WITH {FRAMES} SELECT session, t, sum((event_type = 'click')::INT) OVER (PARTITION BY session ORDER BY t ROWS UNBOUNDED PRECEDING)::BIGINT - 1 AS image_idx FROM frames QUALIFY answered")
def response_index(spark, d):
    """The latest image (click) at each response; -1 before the first."""
    seen = F.sum((F.col("event_type") == "click").cast("bigint")).over(Window.partitionBy("session").orderBy("t").rowsBetween(Window.unboundedPreceding, 0)) - 1
    return frames(spark, d).withColumn("image_idx", seen).where("answered").select("session", "t", "image_idx")


@query(f"WITH {FRAMES} SELECT session, event_id, CASE WHEN event_type IN ('view', 'purchase', 'error') THEN 'said ' || event_id ELSE '' END AS text, event_type IN ('purchase', 'error') AS final FROM frames")
def asr_visibility(spark, d):
    """Recognised text shows for partial (view), final (purchase) and end (error) results only."""
    shows = F.col("event_type").isin("view", "purchase", "error")
    return frames(spark, d).select("session", "event_id", F.when(shows, F.concat(F.lit("said "), F.col("event_id").cast("string"))).otherwise("").alias("text"), F.col("event_type").isin("purchase", "error").alias("final"))


@query("SELECT event_id, CASE WHEN event_id % 20 < 12 THEN 'short header' WHEN event_id % 20 = 12 THEN 'empty audio' WHEN event_id % 2 = 1 THEN 'odd length' END AS fault FROM events")
def packet_faults(spark, d):
    frame = F.encode(F.repeat(F.lit("x"), (F.col("event_id") % 20).cast("int")), "utf-8")
    return table(spark, d, "events").select("event_id", audio.packet_fault(frame).alias("fault"))


@query("SELECT event_id, 52::INT AS n_bytes, 16000::BIGINT AS rate, lpad(to_hex(event_id), 16, '0') AS pcm, NULL::VARCHAR AS reason FROM events")
def wav_roundtrip(spark, d):
    """Samples as WAV files and read back."""
    e = table(spark, d, "events").select("event_id", audio.wav(F.unhex(F.lpad(F.hex("event_id"), 16, "0")), 16000).alias("w"))
    return e.select("event_id", F.length("w").alias("n_bytes"), audio.read_wav(F.col("w")).alias("r")).select("event_id", "n_bytes", "r.rate", F.hex("r.pcm").alias("pcm"), "r.reason")


@query(f"""WITH {FRAMES}, b AS (SELECT session, t, event_type || ' ' || event_id || chr(10) AS line FROM frames), s AS (SELECT *, sum(length(line)) OVER (PARTITION BY session ORDER BY t DESC ROWS UNBOUNDED PRECEDING) - length(line) AS after FROM b)
SELECT session, right(string_agg(line, '' ORDER BY t), 200) AS tail FROM s WHERE after < 200 GROUP BY session""")
def log_tail(spark, d):
    """The last 200 characters of each session's log; only the lines that reach into them are gathered."""
    b = frames(spark, d).select("session", "t", F.concat("event_type", F.lit(" "), F.col("event_id").cast("string"), F.lit("\n")).alias("line"))
    w = Window.partitionBy("session").orderBy(F.desc("t")).rowsBetween(Window.unboundedPreceding, 0)
    s = b.withColumn("after", F.sum(F.length("line").cast("bigint")).over(w) - F.length("line")).where("after < 200")
    return s.groupBy("session").agg(F.right(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("t", "line"))), lambda x: x.line), ""), F.lit(200)).alias("tail"))


@query(f"WITH {SAMPLES} SELECT session, dur::BIGINT AS duration FROM samples WHERE session % 4 <> 0")
def convert_skip(spark, d):
    """Inputs whose output (every fourth session's) is not there yet."""
    samples, _ = convert.role_samples(frames(spark, d))
    return samples.join(samples.where("session % 4 = 0").select("session"), "session", "left_anti").select("session", "duration")


@query(f"""WITH RECURSIVE {SAMPLES}, i AS (SELECT session, session % 7 AS file, row_number() OVER (PARTITION BY session % 7 ORDER BY session) AS n, session NOT IN (SELECT session FROM bad) AS ok FROM samples),
run AS (SELECT 0::BIGINT AS file, 60::BIGINT AS room, 60 - (SELECT count(*) FROM i WHERE file = 0 AND n <= 60 AND ok) AS rest
 UNION ALL SELECT run.file + 1, run.rest, run.rest - (SELECT count(*) FROM i WHERE i.file = run.file + 1 AND n <= run.rest AND ok) FROM run WHERE run.file < 6 AND run.rest > 0)
SELECT i.session, i.file FROM i JOIN run ON i.file = run.file AND i.n <= run.room WHERE ok""")
def sample_budget(spark, d):
    """The accepted samples within a budget of 60: a file offers as many inputs as are left of it, successes use it up."""
    samples, events = convert.role_samples(frames(spark, d))
    bad = convert.rejects(samples, events).select("session", F.lit(False).alias("ok"))
    i = samples.join(bad, "session", "left").select("session", (F.col("session") % 7).alias("file"), F.coalesce("ok", F.lit(True)).alias("ok"))
    return convert.within_budget(i, "file", "session", 60).select("session", "file")


@query(f"WITH {FRAMES} SELECT session, count(*) AS total_turns, max(us) - min(us) AS total_us, string_agg(t || ':' || event_type, ',' ORDER BY t) AS predictions FROM frames GROUP BY 1")
def session_output(spark, d):
    """Each session's record."""
    r = files.session_records(frames(spark, d).withColumn("output", F.col("event_type")))
    return r.select("session", "total_turns", "total_us", F.array_join(F.transform("predictions", lambda p: F.concat(p.t.cast("string"), F.lit(":"), p.output)), ",").alias("predictions"))


@query(f"WITH {SAMPLES}, g AS (SELECT session, count(*) AS n, count(*) FILTER (r IS NOT NULL) AS answers FROM grid LEFT JOIN lasts USING (session, sec) GROUP BY 1) SELECT session, n, answers FROM g")
def converted_files(spark, d):
    """Accepted samples written as one JSON array a file and read back as annotations are."""
    samples, events = convert.role_samples(frames(spark, d))
    g = convert.grid(samples, events).withColumn("pair", F.struct("sec", "question", "answer"))
    g = g.groupBy("session").agg(F.array_sort(F.collect_list("pair")).alias("messages"))
    out = files.shared(spark, "converted")
    files.write_arrays(g.withColumns({"rel_path": F.concat((F.col("session") % 3).cast("string"), F.lit(".json")), "ord": F.col("session")}), out)
    back = spark.read.schema("session bigint, messages array<struct<sec: bigint, question: string, answer: string>>").option("multiLine", True).json(out)
    return back.select("session", F.size("messages").cast("bigint").alias("n"), F.size(F.filter("messages", lambda m: F.startswith(m.answer, F.lit("</response>")))).cast("bigint").alias("answers"))


def _streamed(spark, d, rule, name):
    """The frames of the events table, read as a stream, through ``rule``; what it wrote."""
    batch = spark.read.parquet(f"{d}/events.parquet")
    e = spark.readStream.schema(batch.schema).option("maxFilesPerTrigger", 16).parquet(f"{d}/events.parque[t]")  # a pattern may be one file
    us = F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', ts)")
    f = rule(e.select(F.col("user_id").alias("session"), "event_id", us.alias("us")))
    out = files.shared(spark, name)
    files.write_stream(f, out, files.shared(spark, name + "-state"))
    return spark.read.schema(f.schema).parquet(out)


@query(SESSION_SQL["throttle_foreground"])
def stream_throttle(spark, d):
    """The foreground throttle on a stream: the batch's rows where events arrive in order."""
    return _streamed(spark, d, lambda f: folds.throttle(f, 12 * HOUR), "stream-throttle").where("kept").select("session", "event_id", "us")


@query(SESSION_SQL["busy_skip"])
def stream_busy_skip(spark, d):
    return _streamed(spark, d, lambda f: folds.busy_skip(f.withColumn("cost", (F.col("event_id") % 5 + 1) * 6 * HOUR), "cost"), "stream-busy").select("session", "event_id", "kept")


@query(SESSION_SQL["late_drop"])
def stream_late_drop(spark, d):
    return _streamed(spark, d, lambda f: folds.late_drop(f.withColumn("wall", F.col("us") + (F.col("event_id") * 7919 % 20) * 1_000_000), "wall", 4_000_000, 5), "stream-late").select("session", "event_id", "kept")


def _said():
    """An event's bytes as a packet of speech."""
    return F.repeat(F.concat(F.col("event_type"), F.col("event_id").cast("string")), (F.col("event_id") % 9).cast("int")).cast("binary")


def _replayed(spark, d, made, fields, name, streams=None, store=timers.timer_store):
    """What ``made`` gives of the events table as streams of files in any order, one for each condition: rows wait for ten
    years, and when all have come, a row of no session moves each stream's clock past them."""
    batch = spark.read.parquet(f"{d}/events.parquet")
    us = F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', ts)")
    read = {"kind": F.col("event_type"), "audio": _said(), "final": F.col("event_type") == "error", "prompt": F.when(F.col("event_type") == "signup", F.concat(F.lit("ask "), (F.col("event_id") % 3).cast("string")))}
    fields = ["session bigint", "event_id bigint", "us bigint", *fields.split(", ")]
    rows = lambda e: e.select(F.col("user_id").alias("session"), "event_id", us.alias("us"), *(read[f.split()[0]].alias(f.split()[0]) for f in fields[3:]))
    schema = ", ".join(fields)
    clock, out, state = (files.shared(spark, f"{name}-{part}") for part in ("clock", "out", "state"))
    spark.createDataFrame([], schema).write.parquet(clock)

    def run():
        e = spark.readStream.schema(batch.schema).option("maxFilesPerTrigger", 16).parquet(f"{d}/events.parque[t]")
        s = made([rows(e.where(c)).unionByName(spark.readStream.schema(schema).parquet(clock)) for c in streams or [F.lit(True)]])
        with store(spark):
            files.write_stream(s, out, state)
        return s.schema

    run()
    last = rows(batch).agg(F.max("us")).first()[0]
    if last is not None:
        spark.createDataFrame([(None, -1, last + 4000 * 24 * HOUR, *[None] * len(fields[3:]))], schema).write.mode("append").parquet(clock)
    return spark.read.schema(run()).parquet(out).where("session IS NOT NULL")


def _ruled(spark, d, rule, name, streams=None):
    return _replayed(spark, d, lambda s: timers.ended(s, rule, "3650 days"), rule.reads, name, streams)


@query(f"""WITH {FRAMES}, p AS (SELECT *, lead(us) OVER w AS nx, lead(event_type) OVER w AS nt, last_value(CASE WHEN event_type IN ('view', 'purchase') THEN event_id END IGNORE NULLS) OVER (PARTITION BY session ORDER BY t ROWS UNBOUNDED PRECEDING) AS heard FROM frames WINDOW w AS (PARTITION BY session ORDER BY t))
SELECT session, event_id, coalesce('text ' || heard, '') AS text, CASE WHEN nx IS NULL OR nx - us > {12 * HOUR} THEN us + {12 * HOUR} ELSE nx END AS at_us, CASE WHEN nx IS NULL OR nx - us > {12 * HOUR} THEN 'grace' ELSE 'superseded' END AS ended_by
FROM p WHERE event_type = 'click' AND (nx IS NULL OR nx - us > {12 * HOUR} OR nt = 'signup')""")
def stream_pauses(spark, d):
    """Final results of pauses on a stream: a timer tells of a grace time that nothing came in."""
    return _ruled(spark, d, timers.Pauses(12 * HOUR), "stream-pauses")


@query(f"""WITH {FRAMES}, g AS (SELECT session, us, lead(us) OVER (PARTITION BY session ORDER BY t) AS nx FROM frames),
e AS (SELECT session, min(us) + {500 * HOUR} AS total_end, min(us + {30 * HOUR}) FILTER (nx IS NULL OR nx - us > {30 * HOUR}) AS idle_end FROM g GROUP BY 1)
SELECT session, CASE WHEN idle_end <= total_end THEN 'idle' ELSE 'total' END AS why, least(idle_end, total_end) AS at_us, count(*) FILTER (us <= least(idle_end, total_end)) AS n_turns FROM e JOIN g USING (session) GROUP BY session, idle_end, total_end""")
def stream_ends(spark, d):
    """Ends of streams by idle and total time, told by timers when nothing more comes."""
    return _ruled(spark, d, timers.Ends(30 * HOUR, 500 * HOUR), "stream-ends")


@query(f"""WITH {FRAMES}, g AS (SELECT *, lag(us) OVER w AS pu, lag(event_type) OVER w AS pt FROM frames WINDOW w AS (PARTITION BY session ORDER BY t)),
l AS (SELECT *, sum((pu IS NULL OR pt = 'error' OR ((pu + {24 * HOUR}) // 300000000 + 1) * 300000000 < us)::INT) OVER (PARTITION BY session ORDER BY t ROWS UNBOUNDED PRECEDING) AS life FROM g)
SELECT session, min(us) AS first_us, max(us) AS last_us, count(*) FILTER (event_type <> 'error') AS n_turns, CASE WHEN bool_or(event_type = 'error') THEN 'reset' ELSE 'expired' END AS ended_by,
CASE WHEN bool_or(event_type = 'error') THEN max(us) ELSE ((max(us) + {24 * HOUR}) // 300000000 + 1) * 300000000 END AS at_us FROM l GROUP BY session, life""")
def stream_lives(spark, d):
    """What sessions remember, until a reset or the sweep, every 300 seconds, that finds them idle for over a day."""
    return _ruled(spark, d, timers.Lives(24 * HOUR, 300_000_000), "stream-lives")


SLICES = f"""WITH {FRAMES}, p AS (SELECT session, t, repeat(event_type || event_id, (event_id % 9)::INT) AS said, coalesce(sum((event_type = 'error')::INT) OVER (PARTITION BY session ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS over FROM frames),
w AS (SELECT session, string_agg(said, '' ORDER BY t) AS said FROM p WHERE over = 0 GROUP BY 1),
s AS (SELECT session, said, unnest(range((length(said) + 63) // 64)) AS slice FROM w) SELECT session, slice, substr(said, slice * 64 + 1, 64) AS said FROM s"""


@query(SLICES)
def pcm_slices(spark, d):
    """The bytes of packets up to the final one (error) in slices of 64."""
    f = frames(spark, d).withColumns({"audio": _said(), "final": F.col("event_type") == "error"})
    return audio.slices(audio.until_final(f), 64).select("session", "slice", F.col("audio").cast("string").alias("said"))


@query(SLICES)
def stream_slices(spark, d):
    """The same on a stream: what a packet leaves over waits in the state for the next one."""
    return _ruled(spark, d, timers.Slices(64, 3000 * 24 * HOUR), "stream-slices").select("session", "slice", F.col("audio").cast("string").alias("said"))


def _two():
    """Results and prompts (signup) are one stream, all else another."""
    return [F.col("event_type") == "signup", F.col("event_type") != "signup"]


@query(f"WITH {FRAMES}, {FF} SELECT session, t, query, epoch::BIGINT AS epoch, query_start FROM filled")
def stream_query_fill(spark, d):
    """The query in force at each row, of prompts that come on a stream of their own."""
    return _ruled(spark, d, timers.Fill(), "stream-fill", _two())


@query(SERVICE_SQL["handoff_slot"])
def stream_handoff(spark, d):
    """Results of one stream ride on the responses of another."""
    return _ruled(spark, d, timers.Slot(), "stream-handoff", _two())


@query(f"WITH {FRAMES} SELECT r.session, r.event_id AS task, r.us, min(f.us) AS emitted_us FROM frames r JOIN frames f ON r.session = f.session WHERE r.event_type = 'signup' AND f.answered AND f.us > r.us AND f.us <= r.us + {48 * HOUR} GROUP BY ALL")
def stream_rides(spark, d):
    """Each result with the first response within two days, by an interval join of two streams."""
    made = lambda s: timers.first_within(s[0], s[1].where("kind IN ('view', 'purchase') OR kind IS NULL"), "48 HOURS", "3650 days")
    return _replayed(spark, d, made, "kind string", "stream-rides", _two(), nullcontext).select("session", F.col("event_id").alias("task"), "us", F.col("first_us").alias("emitted_us"))


@query(f"WITH {SAMPLES}, g AS (SELECT session, count(*) AS n, count(*) FILTER (r IS NOT NULL) AS answers FROM grid LEFT JOIN lasts USING (session, sec) GROUP BY 1) SELECT 'qa/' || session % 3 || '/' || session % 5 || '.json' AS rel_path, session, n, answers FROM g")
def converted_documents(spark, d):
    """Accepted samples as one JSON array at each input file's relative path; a second run leaves the files that are there."""
    samples, events = convert.role_samples(frames(spark, d))
    g = convert.grid(samples, events).withColumn("pair", F.struct("sec", "question", "answer"))
    g = g.groupBy("session").agg(F.array_sort(F.collect_list("pair")).alias("messages"))
    place = F.format_string("qa/%d/%d.json", F.col("session") % 3, F.col("session") % 5)
    made = g.withColumns({"rel_path": place, "ord": F.col("session")})
    out = files.shared(spark, "documents")
    documents.write_json_arrays(made, out)
    documents.write_json_arrays(made.withColumn("messages", F.array()), out)
    samples = F.from_json(F.col("content").cast("string"), "array<struct<session: bigint, messages: array<struct<sec: bigint, question: string, answer: string>>>>")
    back = documents.stored(spark, out, "*.json").select("rel_path", F.inline(samples))
    return back.select("rel_path", "session", F.size("messages").cast("bigint").alias("n"), F.size(F.filter("messages", lambda m: F.startswith(m.answer, F.lit("</response>")))).cast("bigint").alias("answers"))


@query(SLICES[: SLICES.index(",\ns AS")] + " SELECT 's' || session || '.wav' AS name, 16000::BIGINT AS rate, length(said) AS n_bytes, md5(said) AS digest FROM w")
def written_wavs(spark, d):
    """Each session's packets up to the final one as a WAV file, read back."""
    f = audio.until_final(frames(spark, d).withColumns({"audio": _said(), "final": F.col("event_type") == "error"}))
    whole = F.aggregate(F.array_sort(F.collect_list(F.struct("t", "audio"))), F.lit(b""), lambda made, p: F.concat(made, p["audio"]))
    g = f.groupBy("session").agg(whole.alias("pcm"))
    out = files.shared(spark, "wavs")
    documents.write_documents(documents.wavs(g, F.concat(F.lit("s"), F.col("session").cast("string"), F.lit(".wav")), F.col("pcm"), 16000), out)
    return readers.wav(spark, out).select(F.regexp_extract("path", "[^/]*$", 0).alias("name"), "rate", F.length("pcm").cast("bigint").alias("n_bytes"), F.md5("pcm").alias("digest"))
