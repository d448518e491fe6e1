"""Turns of a session: current query, chunks, segments, memory and the question-and-answer archive.

With chunk size C and lead L (1 <= L <= C) summary segment k is submitted at turn k*C-L+1 and visible from turn k*C+1
on, so every position in the memory is arithmetic on the turn number and needs no state.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def so_far(last: int = 0):
    """The rows of a session up to the present one, or up to ``last`` rows from it."""
    return Window.partitionBy("session").orderBy("t").rowsBetween(Window.unboundedPreceding, last)


def fill_query(df: DataFrame) -> DataFrame:
    """Adds query (the last prompt so far), epoch (0 before the first; a repeated prompt opens none) and query_start."""
    new = F.col("prompt").isNotNull() & ~F.col("prompt").eqNullSafe(F.last("prompt", True).over(so_far(-1)))
    df = df.withColumn("new_query", new)
    return df.withColumns({"query": F.last("prompt", True).over(so_far()), "epoch": F.sum(F.col("new_query").cast("bigint")).over(so_far()), "query_start": F.max(F.when(F.col("new_query"), F.col("t"))).over(so_far())}).drop("new_query")


def chunk(t: Column, size: int) -> Column:
    return (F.floor((t - 1) / size) + 1).cast("bigint") if size > 0 else F.lit(1).cast("bigint")


def segment(t: Column, size: int, lead: int) -> Column:
    """The summary segment of a turn: the first is shorter by the lead less one, the others have ``size`` turns."""
    first = size - lead + 1
    return F.when(t <= first, F.lit(1)).otherwise(F.floor((t - first - 1) / size) + 2).cast("bigint")


def memory_view(df: DataFrame, size: int, lead: int, every: int, keep: int) -> DataFrame:
    """What each turn sees: mid-term summaries [mid_from, mid_to], long-term batches [long_from, long_to], and the
    turns [context_from, t] that no visible summary covers."""
    done = chunk(F.col("t"), size) - 1
    df = df.withColumn("mid_to", done).withColumn("long_to", F.floor(F.col("mid_to") / every).cast("bigint"))
    return df.withColumns({"mid_from": F.col("long_to") * every + 1, "long_from": F.greatest(F.lit(1), F.col("long_to") - keep + 1).cast("bigint"), "context_from": F.when(F.col("mid_to") == 0, F.lit(1)).otherwise(F.col("mid_to") * size - lead + 2).cast("bigint")})


def qa_archive(df: DataFrame, size: int, lead: int) -> DataFrame:
    """(session, epoch, archived_in, query, turns): responses to each query by the chunk they are archived in.

    ``df``: session, t, prompt, answered. A response moves to the archive when its chunk's summary is cut or its
    query is replaced, and is carried into the next chunk otherwise.
    """
    whole = Window.partitionBy("session")
    after = whole.orderBy(F.desc("t")).rowsBetween(Window.unboundedPreceding, -1)
    found = fill_query(df).withColumns({"next_begun": F.min(F.when(F.col("t") == F.col("query_start"), F.col("t"))).over(after), "last_t": F.max("t").over(whole)})
    found = found.where("answered AND epoch > 0")
    k = chunk(F.col("t"), size)
    out = F.coalesce("next_begun", F.col("last_t") + 1)
    stays = (F.col("t") <= k * size - lead + 1) | (out <= k * size + 1)
    found = found.withColumn("archived_in", F.when(stays, k).otherwise(k + 1))
    return found.groupBy("session", "epoch", "archived_in").agg(F.first("query").alias("query"), F.array_join(F.transform(F.array_sort(F.collect_list("t")), lambda x: x.cast("string")), ",").alias("turns"))


def even_positions(n: Column, budget: int) -> Column:
    """Even sample of 0..n-1: all if they fit, the middle for a budget of one, else half-even rounded places."""
    every = F.sequence(F.lit(0).cast("bigint"), n - 1)
    if budget <= 0:
        return every
    if budget == 1:
        return F.when(n <= 1, every).otherwise(F.array(F.floor(n / 2).cast("bigint")))
    slots = F.sequence(F.lit(0), F.lit(budget - 1))
    return F.when(n <= budget, every).otherwise(F.transform(slots, lambda s: F.rint(s * (n - 1) / (budget - 1)).cast("bigint")))
