"""Mixing sources to target weights by min-cost flow over membership patterns.

Documents are summed by the set of sources they belong to. Words flow from a pattern, whose first, second and third
use cost more each, to the quotas of its sources. The cheapest flow says how many words each pattern gives; whole
documents are then taken in an order that a seed fixes.
"""

from __future__ import annotations

from collections import deque

import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weftline.llm.common import as_bytes, small_batches, written

REPEATS, PIECE_ROWS, RUN_PIECES, MOST_PATTERNS = 3, 2_000, 1_000, 2048


def word_sizes(docs: DataFrame) -> DataFrame:
    """doc_id, source, size: the number of runs of ``[^\\x20\\x09-\\x0D]`` in the text, null as 0; and text_hash."""

    def run(batches):
        for b in small_batches(batches, 1024):
            raw = as_bytes(b.column("text"))
            n, h = pa.array([len(x.split()) for x in raw], pa.int64()), pa.array([xxhash.xxh64_intdigest(x) - 2**63 for x in raw], pa.int64())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("source"), n, h], ["doc_id", "source", "size", "text_hash"])

    return docs.select("doc_id", "source", "text").mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, source string, size bigint, text_hash bigint")


def targets(sizes: dict, most: float = REPEATS) -> dict:
    """Target words of each source: shares of all words by weight 1, 2, 3, repeating over the sources by code point
    (null last); a source's target stops at ``most`` times its size and the excess is shared again by weight."""
    order = sorted((s for s in sizes if s is not None), key=lambda s: [ord(c) for c in s]) + [None] * (None in sizes)
    weight = {s: 1 + i % 3 for i, s in enumerate(order)}
    free, out, rest = list(order), dict.fromkeys(order, 0.0), float(sum(sizes.values()))
    while free:
        share = {s: rest * weight[s] / sum(weight[x] for x in free) for s in free}
        full = [s for s in free if share[s] > most * sizes[s]]
        if not full:
            return out | share
        for s in full:
            out[s] = float(most * sizes[s])
            rest -= out[s]
        free = [s for s in free if s not in full]
    return out


def cheapest_flow(patterns: list[tuple[tuple, int]], quotas: dict, repeats: int = REPEATS) -> list[int]:
    """Words that each pattern (its sources, its size) gives: a maximum flow to the quotas of least cost, where use k
    of a pattern costs k a word. Shortest augmenting paths; only patterns and sources are nodes."""
    source_of = {s: len(patterns) + i for i, s in enumerate(quotas)}
    start, end = len(patterns) + len(quotas), len(patterns) + len(quotas) + 1
    arcs: list[list] = []  # to, room, cost; arc i ^ 1 is the way back
    out: list[list[int]] = [[] for _ in range(end + 1)]

    def arc(a, b, room, cost):
        for u, v, r, c in ((a, b, room, cost), (b, a, 0, -cost)):
            out[u].append(len(arcs))
            arcs.append([v, r, c])

    for i, (members, size) in enumerate(patterns):
        for k in range(1, repeats + 1):
            arc(start, i, size, k)
        for s in members:
            arc(i, source_of[s], repeats * size, 0)
    for s, q in quotas.items():
        arc(source_of[s], end, q, 0)
    while True:
        cost, via, queue = {start: 0}, {}, deque([start])
        while queue:
            u = queue.popleft()
            for e in out[u]:
                v, room, c = arcs[e]
                if room and cost[u] + c < cost.get(v, 1 << 60):
                    cost[v], via[v] = cost[u] + c, e
                    queue.append(v)
        if end not in cost:
            break
        path, v = [], end
        while v != start:
            path.append(via[v])
            v = arcs[via[v] ^ 1][0]
        room = min(arcs[e][1] for e in path)
        for e in path:
            arcs[e][1] -= room
            arcs[e ^ 1][1] += room
    back = [0] * len(patterns)
    for e in out[start]:
        back[arcs[e][0]] += arcs[e ^ 1][1]
    return back


def mix(rows: DataFrame, seed: int = 5) -> DataFrame:
    """``rows``: doc_id, sources (array of the sources a document belongs to) and size, with any other columns, which
    are kept; columns named pattern, times, taken, source_size and target are replaced.

    Adds ``times`` (how often the whole document is taken, at most 3), ``taken`` (times * size), and of the
    document's first source ``source_size`` and ``target``. Only one row a pattern comes to the driver; more than
    2048 patterns raise. Rows equal in all columns share a lot. A pattern's last words are filled by the first documents that fit, in seeded order, among
    the few thousand around the boundary, so its words differ from the flow by less than the smallest of those. Null
    sources are a source of their own, an empty list belongs to none and is not taken; null sizes count as 0.
    """
    own = ["pattern", "times", "taken", "source_size", "target"]
    kept = [c for c in rows.columns if c not in own]
    rows = rows.select(*kept).withColumns({"size": F.coalesce(F.col("size").cast("bigint"), F.lit(0)), "pattern": F.to_json(F.array_sort(F.array_distinct("sources")), {"ignoreNullFields": "false"})})
    rows = rows.withColumn("pattern", F.coalesce("pattern", F.lit("[]")))
    found = rows.groupBy("pattern").agg(F.sum("size").alias("size"), F.count("*").alias("n"), F.first("sources").alias("sources")).limit(MOST_PATTERNS + 1).collect()
    if len(found) > MOST_PATTERNS:
        raise ValueError(f"more than {MOST_PATTERNS} membership patterns")
    found.sort(key=lambda r: r.pattern)
    sizes: dict = {}
    for r in found:
        for s in dict.fromkeys(r.sources or ()):
            sizes[s] = sizes.get(s, 0) + r["size"]
    wanted = targets(sizes)
    given = cheapest_flow([(tuple(dict.fromkeys(r.sources or ())), r["size"]) for r in found], {s: round(t) for s, t in wanted.items()})
    spark = rows.sparkSession
    plan = []
    for r, words in zip(found, given, strict=True):
        full, rest = divmod(words, r["size"]) if r["size"] else (0, 0)
        first = (r.sources or [None])[0]
        plan.append((r.pattern, full, rest, max(1, r.n // PIECE_ROWS), sizes.get(first, 0), float(wanted.get(first, 0.0))))
    plan = spark.createDataFrame(plan, "pattern string, full bigint, rest bigint, pieces bigint, source_size bigint, target double")
    told = [c for c in kept if "map<" not in rows.schema[c].dataType.simpleString() and "variant" not in rows.schema[c].dataType.simpleString()]
    lot = F.xxhash64(F.lit(seed), *told)  # rows that share an id, or have none, are told apart by their other columns
    dealt = rows.join(F.broadcast(plan), "pattern").withColumns({"lot": lot, "piece": F.expr("pmod(xxhash64(lot, 3), pieces)")})
    sums = dealt.groupBy("pattern", "piece", "rest").agg(F.sum("size").alias("words"))
    sums = written(sums.withColumn("run", F.expr(f"piece div {RUN_PIECES}")), "mix-pieces")
    earlier = Window.partitionBy("pattern").orderBy("run").rowsBetween(Window.unboundedPreceding, -1)  # one row a run of pieces
    runs = sums.groupBy("pattern", "run").agg(F.sum("words").alias("n"))
    runs = runs.select("pattern", "run", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    to_here = Window.partitionBy("pattern", "run").orderBy("piece").rowsBetween(Window.unboundedPreceding, 0)
    sums = sums.join(runs, ["pattern", "run"]).withColumn("upto", F.col("before") + F.sum("words").over(to_here))
    where = F.when(F.col("upto") <= F.col("rest"), 1).when(F.col("upto") - F.col("words") < F.col("rest"), 0).otherwise(-1)
    sides = sums.select("pattern", "piece", where.alias("side"), (F.col("rest") - F.col("upto") + F.col("words")).alias("room"))
    dealt = dealt.join(sides, ["pattern", "piece"])
    whole = dealt.where("side != 0").withColumn("extra", (F.col("side") == 1).cast("bigint"))
    columns = [*kept, "source_size", "target", "full", "extra"]

    def fill(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["lot", "doc_id", "size"], kind="stable")
        room, extra = int(pdf.room.iloc[0]) if len(pdf) else 0, []
        for size in pdf["size"]:
            extra.append(int(size <= room))
            room -= size if size <= room else 0
        return pdf.assign(extra=extra)[columns]

    edge = dealt.where("side = 0").withColumn("extra", F.lit(0).cast("bigint"))
    edge = edge.groupBy("pattern").applyInPandas(fill, edge.select(*columns).schema)
    both = whole.select(*columns).unionByName(edge)
    return both.withColumn("times", F.col("full") + F.col("extra")).withColumn("taken", F.col("times") * F.col("size")).drop("full", "extra")


def mix_documents(docs: DataFrame) -> DataFrame:
    """doc_id, size, source_size, target, taken of every document, each a member of its own source. Null texts have size 0
    and are taken with nothing; null ids and repeated rows are rows of their own; no documents give no rows."""
    sized = written(word_sizes(docs), "word-sizes")
    return mix(sized.withColumn("sources", F.array("source"))).select("doc_id", "size", "source_size", "target", "taken")
