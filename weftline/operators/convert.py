"""Annotations to a dense grid of seconds: samples with a duration, timed questions and responses."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftline.functions.text import parse_times
from weftline.operators import pieces

MAX_DURATION = 320


def fps(duration: Column) -> Column:
    return F.when(duration >= 160, 1).when(duration >= 64, 2).otherwise(4)


def role_samples(frames: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Frames as samples (session, duration) and events (session, ord, time, kind, content), time a text as annotations have
    it: a second, a list of seconds, with a fraction, empty, none; one in every eighth session cannot be read, and those
    of every fourth session run over the duration."""
    duration = F.col("session") * 37 % 400 + 20
    s = F.when(F.col("session") % 4 == 1, F.col("event_id") % 450).otherwise(F.col("event_id") % (duration + 1))
    k, text = F.col("event_id") % 10, s.cast("string")
    time = F.when((F.col("session") % 8 == 3) & (F.col("t") == 5), "abc").when(k == 0, F.concat(text, F.lit(", "), text, F.lit(".9,"), (s - 1).cast("string"))).when(k == 1, F.concat(text, F.lit(".5"))).when(k == 2, "").when(k > 3, text)
    events = frames.select("session", F.col("t").alias("ord"), time.alias("time"), F.when(F.col("prompt").isNotNull(), "q").otherwise("r").alias("kind"), F.coalesce("prompt", "event_type").alias("content"))
    return frames.select("session").distinct().withColumn("duration", duration), events


def rejects(samples: DataFrame, events: DataFrame, most: int = MAX_DURATION) -> DataFrame:
    """(session, duration, reason, first_late): samples with an event whose time cannot be read, or that runs over a duration
    which was not cut; the first such event decides, questions before responses."""
    timed = events.join(samples, "session").withColumn("seconds", parse_times(F.col("time")))
    late = F.filter("seconds", lambda x: (x > F.col("duration")) & (F.col("duration") <= most))
    timed = timed.withColumn("late", F.get(late, F.lit(0))).where("seconds IS NULL OR late IS NOT NULL")
    reason = F.when(F.col("seconds").isNull(), "bad time").otherwise(F.concat(F.lit("late "), "kind"))
    first = F.min(F.struct((F.col("kind") == "r").alias("later"), "ord", reason.alias("reason"), F.col("late").alias("first_late"))).alias("f")
    return timed.groupBy("session", "duration").agg(first).select("session", "duration", "f.reason", "f.first_late")


def accepted(samples: DataFrame, events: DataFrame, most: int = MAX_DURATION) -> DataFrame:
    return samples.join(rejects(samples, events, most), "session", "left_anti")


def grid(samples: DataFrame, events: DataFrame, most: int = MAX_DURATION) -> DataFrame:
    """One row a second of each accepted sample: the last question and response of that second, or silence."""
    used = F.least("duration", F.lit(most))
    kept = accepted(samples, events, most).withColumn("used", used)
    timed = events.select("session", "ord", "kind", "content", F.explode(parse_times(F.col("time"))).alias("sec"))
    last = timed.join(kept, "session").where("sec <= used AND sec >= 0").withColumn("sec", F.least("sec", F.greatest(F.col("used") - 1, F.lit(0))))
    pick = lambda k: F.max_by("content", F.when(F.col("kind") == k, F.col("ord")))
    last = last.groupBy("session", "sec").agg(pick("q").alias("q"), pick("r").alias("r"))
    seconds = kept.select("session", F.explode(F.sequence(F.lit(0).cast("bigint"), F.greatest(F.col("used"), F.lit(1)).cast("bigint") - 1)).alias("sec"))
    answer = F.when(F.col("r").isNull(), F.lit("</silence>")).otherwise(F.concat(F.lit("</response> "), "r"))
    return seconds.join(last, ["session", "sec"], "left").select("session", "sec", F.coalesce("q", F.lit("")).alias("question"), answer.alias("answer"))


def truncated(samples: DataFrame, events: DataFrame, most: int = MAX_DURATION) -> DataFrame:
    """(session, original, used, frames) of the accepted samples that were cut to ``most`` seconds."""
    s = accepted(samples, events, most).where(F.col("duration") > most)
    return s.select("session", F.col("duration").alias("original"), F.lit(most).cast("bigint").alias("used"), (F.lit(most) * fps(F.col("duration"))).cast("bigint").alias("frames"))


def counters(samples: DataFrame, events: DataFrame, most: int = MAX_DURATION) -> DataFrame:
    """Processed and truncated samples and their images, by frame rate."""
    s = accepted(samples, events, most).withColumn("fps", fps(F.col("duration")))
    images = F.greatest(F.least("duration", F.lit(most)) * F.col("fps"), F.lit(1))
    return s.groupBy("fps").agg(F.count("*").alias("processed"), F.count_if(F.col("duration") > most).alias("truncated"), F.sum(images).alias("n_images"))


def within_budget(inputs: DataFrame, file: str, order: str, most: int) -> DataFrame:
    """Rows with ``ok`` that a budget of ``most`` successes admits, files in order: each offers its first rows, as many
    as the budget has left, and its successes use it up.

    How much is left for a file depends on all files before it. What a run of files leaves of any amount is a small table, so
    runs are summed up apart and one light pass over the tables tells what enters each; no task walks over all files.
    """
    rank = F.row_number().over(Window.partitionBy(file).orderBy(order))
    ranked = inputs.withColumn("__n", rank).where(F.col("__n") <= most)
    flags = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("__n", F.coalesce(F.col("ok").cast("int"), F.lit(0)).alias("ok")))), lambda r: r.ok), "")
    files = ranked.groupBy(file).agg(flags.alias("__flags")).withColumn("__all", F.lit(0))
    room = pieces.fold(files, "__all", [file], pieces.Budget("__flags", most), "__room")
    return ranked.join(room.select(F.col(file).alias("__file"), "__room"), F.col(file).eqNullSafe(F.col("__file"))).where("__n <= __room AND ok").select(*inputs.columns)


def frame_paths(samples: DataFrame, listed: DataFrame, rewrite: bool = False) -> DataFrame:
    """(dir, paths, reused) of ``samples`` (dir, duration): the frames that ``listed`` (dir, names) has of a folder, in order of
    their names, unless ``rewrite``; else the names that extraction gives, one for each frame of the whole video and one at
    least. A duration of 0 or less has none (null). Folders that samples share are one row."""
    from weftline.sources.readers import frame_names

    one = samples.groupBy("dir").agg(F.max("duration").alias("duration"))
    have = listed.select("dir", F.array_sort(F.filter("names", lambda n: F.endswith(n, F.lit(".jpg")))).alias("names"))
    n = F.greatest(F.floor(F.col("duration") * fps(F.col("duration"))).cast("bigint"), F.lit(1))
    reused = (F.coalesce(F.size("names"), F.lit(0)) > 0) & F.lit(not rewrite)
    old = F.transform("names", lambda x: F.concat(F.col("dir"), F.lit("/"), x))
    return one.join(have, "dir", "left").select("dir", F.when(F.col("duration") > 0, F.when(reused, old).otherwise(frame_names(F.col("dir"), n))).alias("paths"), (reused & (F.col("duration") > 0)).alias("reused"))
