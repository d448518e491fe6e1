"""Queries over sessions of turns and frames, each with its SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from weftline.operators import folds
from weftline.operators import turns as T
from weftline.sources.views import FRAMES, TURNS, frames, table, turns

C, L, N, W = 10, 3, 2, 2  # chunk, lead, summaries a long-term batch, long-term window
HOUR = 3_600_000_000
QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def put(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return put


FILLED = """filled AS (SELECT *, last_value(prompt IGNORE NULLS) OVER w AS query, sum(is_new::INT) OVER w AS epoch, max(CASE WHEN is_new THEN t END) OVER w AS query_start
 FROM (SELECT *, prompt IS NOT NULL AND prompt IS DISTINCT FROM last_value(prompt IGNORE NULLS) OVER (PARTITION BY session ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS is_new FROM {v})
 WINDOW w AS (PARTITION BY session ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))"""
FT, FF = FILLED.replace("{v}", "turns"), FILLED.replace("{v}", "frames")


@query(f"WITH {TURNS} SELECT session, turn, role, t FROM turns")
def turn_numbering(spark, d):
    return turns(spark, d).select("session", "turn", "role", "t")


@query(f"WITH {TURNS}, {FT} SELECT session, t, query, epoch::BIGINT AS epoch, query_start FROM filled")
def current_query_fill(spark, d):
    return T.fill_query(turns(spark, d)).select("session", "t", "query", "epoch", "query_start")


@query(f"WITH {FRAMES}, {FF} SELECT session, epoch::BIGINT AS epoch, min(t) AS first_turn, max(t) AS last_turn, count(*) AS n_turns FROM filled GROUP BY session, epoch")
def query_epochs(spark, d):
    return T.fill_query(frames(spark, d)).groupBy("session", "epoch").agg(F.min("t").alias("first_turn"), F.max("t").alias("last_turn"), F.count("*").alias("n_turns"))


@query(f"WITH {TURNS}, {FT} SELECT session, t, CASE WHEN query IS NULL THEN '</silence>' ELSE '</response> ' || t END AS output FROM filled")
def forced_silence(spark, d):
    """The default decision: silence until a query is seen, before any model is asked."""
    out = F.when(F.col("query").isNull(), F.lit("</silence>")).otherwise(F.concat(F.lit("</response> "), F.col("t").cast("string")))
    return T.fill_query(turns(spark, d)).select("session", "t", out.alias("output"))


@query(f"WITH {FRAMES} SELECT session, event_id, t, 1 + (t - 1) // {C} AS chunk FROM frames")
def chunk_assign(spark, d):
    return frames(spark, d).select("session", "event_id", "t", T.chunk(F.col("t"), C).alias("chunk"))


@query(f"WITH {FRAMES} SELECT session, 1 + (t - 1) // {C} AS chunk, count(*) AS n_turns, min(us) AS first_us, max(us) AS last_us FROM frames GROUP BY 1, 2")
def chunk_counts(spark, d):
    return frames(spark, d).groupBy("session", T.chunk(F.col("t"), C).alias("chunk")).agg(F.count("*").alias("n_turns"), F.min("us").alias("first_us"), F.max("us").alias("last_us"))


SEGMENT = f"CASE WHEN t <= {C - L + 1} THEN 1 ELSE 2 + (t - {C - L + 1} - 1) // {C} END"


@query(f"WITH {FRAMES} SELECT session, {SEGMENT} AS segment, min(t) AS first_turn, max(t) AS last_turn, count(*) AS n_turns, arg_min(us, t) AS range_start, arg_max(us, t) AS range_end FROM frames GROUP BY 1, 2")
def summary_segments(spark, d):
    return frames(spark, d).groupBy("session", T.segment(F.col("t"), C, L).alias("segment")).agg(F.min("t").alias("first_turn"), F.max("t").alias("last_turn"), F.count("*").alias("n_turns"), F.min_by("us", "t").alias("range_start"), F.max_by("us", "t").alias("range_end"))


VIEW = f"""view AS (SELECT *, (t - 1) // {C} AS mid_to, ((t - 1) // {C}) // {N} AS long_to FROM frames)"""


@query(f"WITH {FRAMES}, {VIEW} SELECT session, t, long_to * {N} + 1 AS mid_from, mid_to, greatest(1, long_to - {W} + 1) AS long_from, long_to FROM view")
def visible_midterm(spark, d):
    return T.memory_view(frames(spark, d), C, L, N, W).select("session", "t", "mid_from", "mid_to", "long_from", "long_to")


@query(f"WITH {FRAMES}, {VIEW} SELECT session, t, CASE WHEN mid_to = 0 THEN 1 ELSE mid_to * {C} - {L} + 2 END AS context_from, t - CASE WHEN mid_to = 0 THEN 1 ELSE mid_to * {C} - {L} + 2 END + 1 AS n_context FROM view")
def context_span(spark, d):
    return T.memory_view(frames(spark, d), C, L, N, W).select("session", "t", "context_from", (F.col("t") - F.col("context_from") + 1).alias("n_context"))


@query(f"""WITH {FRAMES}, s AS (SELECT session, {SEGMENT} AS segment, count(*) AS n FROM frames GROUP BY 1, 2)
SELECT session, 1 + (segment - 1) // {N} AS batch, string_agg('summary ' || segment || ': ' || n || ' turns', chr(10) || chr(10) ORDER BY segment) AS body, sum(n)::BIGINT AS n_turns FROM s GROUP BY 1, 2""")
def longterm_batches(spark, d):
    s = frames(spark, d).groupBy("session", T.segment(F.col("t"), C, L).alias("segment")).agg(F.count("*").alias("n"))
    text = F.concat(F.lit("summary "), F.col("segment").cast("string"), F.lit(": "), F.col("n").cast("string"), F.lit(" turns"))
    batch = (F.floor((F.col("segment") - 1) / N) + 1).cast("bigint")
    return s.groupBy("session", batch.alias("batch")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("segment", text.alias("x")))), lambda r: r.x), "\n\n").alias("body"), F.sum("n").alias("n_turns"))


@query(f"""WITH {FRAMES}, b AS (SELECT session, 1 + ({SEGMENT} - 1) // {N} AS batch, count(*) AS n FROM frames GROUP BY 1, 2)
SELECT session, batch, string_agg(n::VARCHAR, ',') OVER (PARTITION BY session ORDER BY batch ROWS BETWEEN {W - 1} PRECEDING AND CURRENT ROW) AS kept FROM b""")
def longterm_window(spark, d):
    batch = (F.floor((T.segment(F.col("t"), C, L) - 1) / N) + 1).cast("bigint")
    b = frames(spark, d).groupBy("session", batch.alias("batch")).agg(F.count("*").alias("n"))
    last = Window.partitionBy("session").orderBy("batch").rowsBetween(-(W - 1), 0)
    return b.select("session", "batch", F.array_join(F.collect_list(F.col("n").cast("string")).over(last), ",").alias("kept"))


QA = f"""{FRAMES}, {FF}, starts AS (SELECT session, epoch, lead(min(t)) OVER (PARTITION BY session ORDER BY epoch) AS next_begun FROM filled WHERE epoch > 0 GROUP BY session, epoch),
last_turns AS (SELECT session, max(t) AS last_t FROM frames GROUP BY 1),
found AS (SELECT f.session, f.epoch, f.t, f.query, 1 + (f.t - 1) // {C} AS k, coalesce(next_begun, last_t + 1) AS x FROM filled f JOIN starts USING (session, epoch) JOIN last_turns USING (session) WHERE answered AND epoch > 0),
qa AS (SELECT session, epoch::BIGINT AS epoch, CASE WHEN t <= k * {C} - {L} + 1 OR x <= k * {C} + 1 THEN k ELSE k + 1 END AS archived_in, min(query) AS query, string_agg(t::VARCHAR, ',' ORDER BY t) AS turns FROM found GROUP BY 1, 2, 3)"""


@query(f"WITH {QA} SELECT * FROM qa")
def qa_archive(spark, d):
    return T.qa_archive(frames(spark, d), C, L)


@query(f"WITH {QA}, c AS (SELECT DISTINCT session, 1 + (t - 1) // {C} AS chunk FROM frames) SELECT c.session, chunk, count(*) AS n_entries, string_agg(query, '; ' ORDER BY archived_in, epoch) AS queries FROM c JOIN qa ON c.session = qa.session AND archived_in < chunk GROUP BY 1, 2")
def qa_visible(spark, d):
    """Archived entries that each chunk of a session sees: those archived before it. A chunk's row lists them all, so the
    result itself grows with chunks times entries."""
    f = frames(spark, d)
    c = f.select("session", T.chunk(F.col("t"), C).alias("chunk")).distinct()
    seen = c.join(T.qa_archive(f, C, L), "session").where("archived_in < chunk")
    listed = F.array_sort(F.collect_list(F.struct("archived_in", "epoch", "query")))
    return seen.groupBy("session", "chunk").agg(F.count("*").alias("n_entries"), F.array_join(F.transform(listed, lambda x: x.query), "; ").alias("queries"))


@query(f"WITH {FRAMES} SELECT session, 1 + (t - 1) // {C} AS chunk, arg_min(us, t) || ' ~ ' || arg_max(us, t) AS merged, arg_min(prompt, t) FILTER (prompt IS NOT NULL) AS first_query FROM frames GROUP BY 1, 2")
def merged_range(spark, d):
    g = frames(spark, d).groupBy("session", T.chunk(F.col("t"), C).alias("chunk"))
    return g.agg(F.concat(F.min_by("us", "t").cast("string"), F.lit(" ~ "), F.max_by("us", "t").cast("string")).alias("merged"), F.min_by("prompt", F.when(F.col("prompt").isNotNull(), F.col("t"))).alias("first_query"))


KEYS = f"""n AS (SELECT session, count(*) AS n FROM frames GROUP BY 1), k AS (SELECT session, n, unnest(CASE WHEN n <= 8 THEN range(0, n) ELSE list_transform(range(0, 8), lambda s: round_even(s * (n - 1) / 7, 0)::BIGINT) END) AS idx FROM n)"""


@query(f"WITH {FRAMES}, {KEYS} SELECT session, idx, us FROM k JOIN frames USING (session) WHERE t = idx + 1")
def keyframe_sample(spark, d):
    f = frames(spark, d)
    k = f.groupBy("session").agg(F.count("*").alias("n")).select("session", F.explode(T.even_positions(F.col("n"), 8)).alias("idx"))
    return k.join(f.withColumn("idx", F.col("t") - 1), ["session", "idx"]).select("session", "idx", "us")


@query(f"WITH {FRAMES}, {KEYS} SELECT session, idx, coalesce((lag(idx) OVER w + idx) // 2 + 1, 0) AS left_idx, coalesce((idx + lead(idx) OVER w) // 2, n - 1) AS right_idx FROM k WINDOW w AS (PARTITION BY session ORDER BY idx)")
def keyframe_ranges(spark, d):
    k = frames(spark, d).groupBy("session").agg(F.count("*").alias("n")).select("session", "n", F.explode(T.even_positions(F.col("n"), 8)).alias("idx"))
    w = Window.partitionBy("session").orderBy("idx")
    return k.select("session", "idx", F.coalesce(F.floor((F.lag("idx").over(w) + F.col("idx")) / 2) + 1, F.lit(0)).cast("bigint").alias("left_idx"), F.coalesce(F.floor((F.col("idx") + F.lead("idx").over(w)) / 2), F.col("n") - 1).cast("bigint").alias("right_idx"))


@query(f"""WITH {FRAMES}, b AS (SELECT session, t, prompt, list(t) OVER (PARTITION BY session ORDER BY t ROWS BETWEEN 99 PRECEDING AND CURRENT ROW) AS buf FROM frames)
SELECT session, t, len(buf) AS n_buffered, array_to_string(buf[-50:], ',') AS agent_frames, CASE WHEN session % 2 = 0 THEN array_to_string(buf[-30:], ',') ELSE array_to_string(buf, ',') END AS kept FROM b WHERE prompt IS NOT NULL""")
def recent_buffer(spark, d):
    """At a delegation: the last 100 frames are held, the last 50 reach the agent; a buffer made smaller, to 30 in every
    second session, keeps the newest."""
    w = Window.partitionBy("session").orderBy("t").rowsBetween(-99, 0)
    b = frames(spark, d).withColumn("buf", F.collect_list("t").over(w)).where("prompt IS NOT NULL")
    last = lambda n: F.array_join(F.transform(F.slice("buf", F.greatest(F.lit(1), F.size("buf") - n + 1), F.lit(n)), lambda x: x.cast("string")), ",")
    return b.select("session", "t", F.size("buf").cast("bigint").alias("n_buffered"), last(50).alias("agent_frames"), F.when(F.col("session") % 2 == 0, last(30)).otherwise(last(100)).alias("kept"))


@query(f"WITH {FRAMES} SELECT session, t, (t - 1) * 500 AS clock_ms, us - first_value(us) OVER w AS relative_us FROM frames WINDOW w AS (PARTITION BY session ORDER BY t)")
def turn_clock(spark, d):
    w = Window.partitionBy("session").orderBy("t")
    return frames(spark, d).select("session", "t", ((F.col("t") - 1) * 500).alias("clock_ms"), (F.col("us") - F.first("us").over(w)).alias("relative_us"))


@query(f"WITH {FRAMES} SELECT session, t, event_type FROM (SELECT *, lag(event_type) OVER (PARTITION BY session ORDER BY t) AS p FROM frames) WHERE p IS DISTINCT FROM event_type")
def memory_change(spark, d):
    """Emitted only where the record differs from the last one."""
    before = F.lag("event_type").over(Window.partitionBy("session").orderBy("t"))
    return frames(spark, d).withColumn("p", before).where("NOT (p <=> event_type)").select("session", "t", "event_type")


@query(f"""WITH {FRAMES}, r AS (SELECT *, sum(answered::INT) OVER w AS n, coalesce(last_value(CASE WHEN event_id % 3 = 0 THEN event_type END IGNORE NULLS) OVER w, '') AS said FROM frames WINDOW w AS (PARTITION BY session ORDER BY t ROWS UNBOUNDED PRECEDING))
SELECT session, t, n::BIGINT AS n, said FROM (SELECT *, lag(n) OVER (PARTITION BY session ORDER BY t) AS pn, lag(said) OVER (PARTITION BY session ORDER BY t) AS ps FROM r) WHERE n > 0 AND (n > coalesce(pn, 0) OR said <> ps)""")
def fresh_callback(spark, d):
    """A response is told when there was a further inference or its text is another than the last one told."""
    said = F.coalesce(F.last(F.when(F.col("event_id") % 3 == 0, F.col("event_type")), True).over(T.so_far()), F.lit(""))
    r = frames(spark, d).withColumns({"n": F.sum(F.col("answered").cast("bigint")).over(T.so_far()), "said": said})
    w = Window.partitionBy("session").orderBy("t")
    r = r.withColumns({"pn": F.coalesce(F.lag("n").over(w), F.lit(0)), "ps": F.lag("said").over(w)})
    return r.where("n > 0 AND (n > pn OR said <> ps)").select("session", "t", "n", "said")


def _greedy(gap: str, rest: str) -> str:
    return f"""WITH RECURSIVE {FRAMES}, kept AS (SELECT session, min(us) AS us FROM frames GROUP BY 1
 UNION ALL SELECT k.session, (SELECT min(f.us) FROM frames f WHERE f.session = k.session AND f.us >= k.us + {gap}) FROM kept k WHERE (SELECT min(f.us) FROM frames f WHERE f.session = k.session AND f.us >= k.us + {gap}) IS NOT NULL),
kf AS (SELECT f.session, f.us, min(f.event_id) AS event_id FROM kept JOIN frames f USING (session, us) GROUP BY 1, 2) {rest}"""


@query(_greedy(str(12 * HOUR), "SELECT session, event_id, us FROM kf"))
def throttle_foreground(spark, d):
    return folds.throttle(frames(spark, d), 12 * HOUR).where("kept").select("session", "event_id", "us")


@query(_greedy(str(30 * HOUR), "SELECT session, count(*) AS n_kept, min(us) AS first_us, max(us) AS last_us FROM kf GROUP BY 1"))
def throttle_background(spark, d):
    return folds.throttle(frames(spark, d), 30 * HOUR).where("kept").groupBy("session").agg(F.count("*").alias("n_kept"), F.min("us").alias("first_us"), F.max("us").alias("last_us"))


@query(_greedy(str(3 * HOUR), "SELECT session, event_id, (n - 1) // 4 AS batch, (n - 1) % 4 AS place FROM (SELECT *, row_number() OVER (PARTITION BY session ORDER BY us) AS n FROM kf)"))
def batch_frames(spark, d):
    """Batches of four frames, captured at a quarter of the interval of twelve hours."""
    return folds.count_batches(folds.throttle(frames(spark, d), 3 * HOUR), 4).select("session", "event_id", "batch", "place")


@query(f"""WITH RECURSIVE {FRAMES}, g AS (SELECT *, (1 + event_id % 5) * {6 * HOUR} AS cost FROM frames),
run AS (SELECT session, t, event_id, us + cost AS until, TRUE AS kept FROM g WHERE t = 1
 UNION ALL SELECT g.session, g.t, g.event_id, CASE WHEN g.us >= r.until THEN g.us + g.cost ELSE r.until END, g.us >= r.until FROM run r JOIN g ON g.session = r.session AND g.t = r.t + 1)
SELECT session, event_id, kept FROM run""")
def busy_skip(spark, d):
    f = frames(spark, d).withColumn("cost", (F.col("event_id") % 5 + 1) * 6 * HOUR)
    return folds.busy_skip(f, "cost").select("session", "event_id", "kept")


@query(f"""WITH RECURSIVE {FRAMES}, g AS (SELECT *, us + (event_id * 7919 % 20) * 1000000 AS wall FROM frames),
run AS (SELECT session, t, event_id, us AS p0, wall AS w0, 0::BIGINT AS drops, TRUE AS kept FROM g WHERE t = 1
 UNION ALL SELECT g.session, g.t, g.event_id, CASE WHEN late AND drops >= 5 THEN g.us ELSE p0 END, CASE WHEN late AND drops >= 5 THEN wall ELSE w0 END, CASE WHEN late AND drops < 5 THEN drops + 1 ELSE 0 END, NOT (late AND drops < 5)
 FROM (SELECT g.*, r.p0, r.w0, r.drops, g.wall - r.w0 - (g.us - r.p0) > 4000000 AS late FROM run r JOIN g ON g.session = r.session AND g.t = r.t + 1) g)
SELECT session, event_id, kept FROM run""")
def late_drop(spark, d):
    """Frames older than four seconds are dropped; the clock starts anew after five drops in a row."""
    f = frames(spark, d).withColumn("wall", F.col("us") + (F.col("event_id") * 7919 % 20) * 1_000_000)
    return folds.late_drop(f, "wall", 4_000_000, 5).select("session", "event_id", "kept")


@query(f"""WITH {FRAMES}, s AS (SELECT session, us, sum((gap > {24 * HOUR})::INT) OVER (PARTITION BY session ORDER BY t ROWS UNBOUNDED PRECEDING) AS part
 FROM (SELECT *, coalesce(us - lag(us) OVER (PARTITION BY session ORDER BY t), 0) AS gap FROM frames))
SELECT session, min(us) AS first_us, max(us) AS last_us, count(*) AS n_turns FROM s GROUP BY session, part""")
def session_expiry(spark, d):
    """A session ends when nothing comes for longer than a day; exactly a day keeps it."""
    f = frames(spark, d).withColumn("ts", F.timestamp_micros("us"))
    w = F.session_window("ts", "24 hours 1 microsecond")
    return f.groupBy("session", w.alias("w")).agg(F.min("us").alias("first_us"), F.max("us").alias("last_us"), F.count("*").alias("n_turns")).drop("w")


@query(f"WITH {FRAMES} SELECT session, arg_max((value * 1000)::BIGINT, t) AS last_ms, sum((value * 1000)::BIGINT)::BIGINT // count(*) AS avg_ms, count(*) AS total_inferences FROM frames WHERE event_type <> 'error' GROUP BY 1")
def latency_metrics(spark, d):
    ms = F.rint(F.col("value") * 1000).cast("bigint")
    return frames(spark, d).where("event_type <> 'error'").groupBy("session").agg(F.max_by(ms, "t").alias("last_ms"), F.floor(F.sum(ms) / F.count("*")).cast("bigint").alias("avg_ms"), F.count("*").alias("total_inferences"))


@query(f"WITH {FRAMES} SELECT session, count(*) AS n_turns, max(us) - min(us) AS total_us, sum((event_type = 'error')::INT)::BIGINT AS n_errors FROM frames GROUP BY 1")
def session_totals(spark, d):
    return frames(spark, d).groupBy("session").agg(F.count("*").alias("n_turns"), (F.max("us") - F.min("us")).alias("total_us"), F.count_if(F.col("event_type") == "error").alias("n_errors"))


@query("""WITH e AS (SELECT user_id AS session, event_type, event_id, try_cast(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events),
c AS (SELECT session, event_type, count(*) AS n FROM e GROUP BY 1, 2)
SELECT session, (SELECT string_agg(event_type || '=' || n, ',' ORDER BY event_type) FROM c WHERE c.session IS NOT DISTINCT FROM e.session) AS counts, arg_max(k, event_id) FILTER (k IS NOT NULL) AS last_k, sum((event_type = 'view')::INT)::BIGINT AS n_searches FROM e GROUP BY session""")
def event_digest(spark, d):
    """Counts by type, the last usage and the searches of each run's log."""
    e = table(spark, d, "events").select(F.col("user_id").alias("session"), "event_type", "event_id", F.get_json_object("props", "$.k").try_cast("bigint").alias("k"))
    c = e.groupBy("session", "event_type").agg(F.count("*").alias("n"), F.max_by("k", F.when(F.col("k").isNotNull(), F.col("event_id"))).alias("k"), F.max(F.when(F.col("k").isNotNull(), F.col("event_id"))).alias("at"))
    pairs = F.array_sort(F.collect_list(F.struct("event_type", "n")))
    return c.groupBy("session").agg(F.array_join(F.transform(pairs, lambda x: F.concat(x.event_type, F.lit("="), x.n.cast("string"))), ",").alias("counts"), F.max_by("k", "at").alias("last_k"), F.coalesce(F.sum(F.when(F.col("event_type") == "view", F.col("n"))), F.lit(0)).alias("n_searches"))


@query(f"WITH {FRAMES}, e AS (SELECT *, row_number() OVER (PARTITION BY session ORDER BY t DESC) AS r FROM frames WHERE event_type = 'error') SELECT session, string_agg(event_id::VARCHAR, ',' ORDER BY t) AS last_errors FROM e WHERE r <= 5 GROUP BY 1")
def last_errors(spark, d):
    w = Window.partitionBy("session").orderBy(F.desc("t"))
    e = frames(spark, d).where("event_type = 'error'").withColumn("r", F.row_number().over(w)).where("r <= 5")
    return e.groupBy("session").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("t", "event_id"))), lambda x: x.event_id.cast("string")), ",").alias("last_errors"))


@query(f"WITH {FRAMES}, {FF} SELECT session, epoch::BIGINT AS task, min(us) AS started_us, min(us) FILTER (answered) AS ready_us, CASE WHEN min(us) FILTER (answered) IS NULL THEN 'error' WHEN min(us) FILTER (answered) - min(us) > {48 * HOUR} THEN 'timeout' ELSE 'ready' END AS status FROM filled WHERE epoch > 0 GROUP BY 1, 2")
def delegation_lifecycle(spark, d):
    """Each query as a task: ready with its first response, too late after two days, in error without one."""
    ready = F.min(F.when(F.col("answered"), F.col("us")))
    g = T.fill_query(frames(spark, d)).where("epoch > 0").groupBy("session", F.col("epoch").alias("task")).agg(F.min("us").alias("started_us"), ready.alias("ready_us"))
    return g.withColumn("status", F.when(F.col("ready_us").isNull(), "error").when(F.col("ready_us") - F.col("started_us") > 48 * HOUR, "timeout").otherwise("ready"))


@query(f"WITH {FRAMES}, s AS (SELECT session, event_id, us, lead(us) OVER (PARTITION BY session ORDER BY t) AS nx FROM frames WHERE answered) SELECT session, event_id, coalesce(nx < us + {20 * HOUR}, FALSE) AS cancelled FROM s")
def superseded_speech(spark, d):
    nx = F.lead("us").over(Window.partitionBy("session").orderBy("t"))
    return frames(spark, d).where("answered").select("session", "event_id", F.coalesce(nx < F.col("us") + 20 * HOUR, F.lit(False)).alias("cancelled"))


@query(f"WITH {FRAMES}, p AS (SELECT session, event_id, t, event_type, us, lead(us) OVER w AS nx, lead(event_type) OVER w AS nt FROM frames WINDOW w AS (PARTITION BY session ORDER BY t)) SELECT session, event_id, CASE WHEN nx IS NULL OR nx - us > {12 * HOUR} THEN 'grace' ELSE 'superseded' END AS ended_by FROM p WHERE event_type = 'click' AND (nx IS NULL OR nx - us > {12 * HOUR} OR nt = 'signup')")
def endpointing(spark, d):
    """A pause (click) ends an utterance when nothing comes within the grace time or a new one (signup) begins."""
    w = Window.partitionBy("session").orderBy("t")
    p = frames(spark, d).withColumns({"nx": F.lead("us").over(w), "nt": F.lead("event_type").over(w)}).where("event_type = 'click'")
    late = F.col("nx").isNull() | (F.col("nx") - F.col("us") > 12 * HOUR)
    return p.where(late | (F.col("nt") == "signup")).select("session", "event_id", F.when(late, "grace").otherwise("superseded").alias("ended_by"))


@query(f"WITH {FRAMES} SELECT m.session, m.event_id, s.event_id AS subscriber FROM frames m JOIN frames s ON m.session = s.session WHERE m.event_type = 'purchase' AND s.event_type = 'signup'")
def fanout(spark, d):
    """Each message (purchase) to every subscription (signup) of its session: as many rows as a session's messages times
    its subscriptions, which is what a fan-out is."""
    f = frames(spark, d)
    s = f.where("event_type = 'signup'").select("session", F.col("event_id").alias("subscriber"))
    return f.where("event_type = 'purchase'").select("session", "event_id").join(s, "session")


@query(f"WITH {FRAMES}, r AS (SELECT session, event_id AS task, us FROM frames WHERE event_type = 'signup') SELECT session, task, min(f.t) AS emitted_at FROM r JOIN frames f USING (session) WHERE f.us > r.us AND f.answered GROUP BY 1, 2")
def handoff_join(spark, d):
    """A ready result rides on the first response after it: a running minimum from the session's end, not a range join."""
    f = frames(spark, d)
    later = Window.partitionBy("session").orderBy(-F.col("us")).rangeBetween(Window.unboundedPreceding, -1)
    nxt = f.withColumn("emitted_at", F.min(F.when(F.col("answered"), F.col("t"))).over(later))
    return nxt.where("event_type = 'signup' AND emitted_at IS NOT NULL").select("session", F.col("event_id").alias("task"), "emitted_at")


@query(f"WITH {FRAMES} SELECT session, t, 'm' || (event_id % 4) AS model, CASE event_id % 4 WHEN 1 THEN 'alpha' WHEN 2 THEN 'beta' ELSE 'default' END AS backend, CASE event_type WHEN 'click' THEN 'Describe.' WHEN 'view' THEN 'Watch.' ELSE 'Help.' END AS system_prompt FROM frames")
def backend_route(spark, d):
    """Exact backend by model name, else the default one; system prompt by key, else the default text."""
    f = frames(spark, d).withColumn("model", F.concat(F.lit("m"), (F.col("event_id") % 4).cast("string")))
    backends = spark.createDataFrame([("m1", "alpha"), ("m2", "beta")], "model string, backend string")
    prompts = F.create_map(F.lit("click"), F.lit("Describe."), F.lit("view"), F.lit("Watch."))
    return f.join(F.broadcast(backends), "model", "left").select("session", "t", "model", F.coalesce("backend", F.lit("default")).alias("backend"), F.coalesce(F.try_element_at(prompts, "event_type"), F.lit("Help.")).alias("system_prompt"))


@query("SELECT conv_id AS session, string_agg(role, ',' ORDER BY turn) AS roles, sum(length(text))::BIGINT AS n_chars, sum(length(text) // 4)::BIGINT AS n_tokens FROM conversations GROUP BY 1")
def light_projection(spark, d):
    """A session's record without its texts; tokens are estimated as a quarter of the characters."""
    c = table(spark, d, "conversations")
    return c.groupBy(F.col("conv_id").alias("session")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "role"))), lambda x: x.role), ",").alias("roles"), F.sum(F.length("text").cast("bigint")).alias("n_chars"), F.sum(F.floor(F.length("text") / 4)).cast("bigint").alias("n_tokens"))
