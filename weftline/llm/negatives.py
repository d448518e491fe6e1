"""Hard negatives of anchors: the best rows of other labels inside a window below each positive's score.

A stated set of anchors meets all rows in cells of bounded blocks, so no task holds more than one block of each. The
windows of one anchor overlap, so they are not searched one by one: the upper limits of its positives cut the scores
into disjoint slots, each cell keeps the first few rows of every slot, the same is done again over all cells, and a walk
from the lowest slot upward merges each slot into the answer of those below it. What is merged so far is the answer of
the window that begins at that slot's upper limit, and its lower limit cuts off the tail.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftline.llm.common import one_row_each, written

ROWS, ANCHORS, TILE = 16_384, 2_048, 64  # rows and anchors of a cell, anchors scored at a time
LIMIT = 1 << 53  # where a score is held: up to there doubles are exact


def taking_part(df: DataFrame, label: Column) -> DataFrame:
    """vec_id, label, embedding of the rows that count, one of each id (the smallest by label and vector)."""
    whole = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    rows = df.where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull()).where(whole)
    return one_row_each(rows.select("vec_id", label.alias("label"), "embedding").where("label IS NOT NULL"), "vec_id")


def quantised(vectors: pa.Array, width: int) -> np.ndarray:
    """floor(256 x) of every component, shorter vectors filled with zeros, as whole numbers in doubles."""
    out = np.zeros((len(vectors), width))
    values = np.clip(np.floor(256.0 * vectors.flatten().to_numpy(zero_copy_only=False).astype(float)), -(2.0**60), 2.0**60)
    lengths = pa.compute.list_value_length(vectors).to_numpy()
    row = np.repeat(np.arange(len(vectors)), lengths)
    out[row, np.arange(len(values)) - np.repeat(np.cumsum(lengths) - lengths, lengths)] = values
    return out


def inner_products(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Exact products, held at +-2^53. Doubles are exact below 2^53; beyond, Python's own integers are used."""
    if float(np.abs(x).max(initial=0)) * float(np.abs(y).max(initial=0)) * x.shape[1] < 2.0**53:
        return x @ y.T
    own = np.array([[int(v) for v in r] for r in x], object).reshape(x.shape) @ np.array([[int(v) for v in r] for r in y], object).reshape(y.shape).T
    return np.clip(own, -LIMIT, LIMIT).astype(float)


def firsts(scores: np.ndarray, mask: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, column) of the ``k`` highest masked scores of each row, ties to the lower column, in that order."""
    if mask.sum() > 16 * k * len(mask) and mask.shape[1] > k:
        least = np.partition(np.where(mask, scores, -np.inf), -k, axis=1)[:, -k]
        mask = mask & (scores >= least[:, None])
    row, column = np.nonzero(mask)
    order = np.lexsort((column, -scores[row, column], row))
    row, column = row[order], column[order]
    nth = np.arange(len(row)) - np.searchsorted(row, row)
    return row[nth < k], column[nth < k]


def cells(rows: DataFrame, anchors: DataFrame, run, schema: str, n_rows: int, n_anchors: int) -> DataFrame:
    """``run`` over every block of anchors with every block of rows; blocks are dealt by the hash of the id."""
    groups, blocks = max(1, -(-n_rows // ROWS)), max(1, -(-n_anchors // ANCHORS))
    left = anchors.withColumns({"a_block": F.expr(f"pmod(xxhash64(vec_id, 1), {blocks})"), "r_block": F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(groups - 1).cast("bigint")))})
    rows = rows.select(*(F.col(c).alias(c) for c in rows.columns))  # anchors come from the same table
    right = rows.withColumns({"r_block": F.expr(f"pmod(xxhash64(vec_id, 2), {groups})"), "a_block": F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(blocks - 1).cast("bigint")))})
    return left.groupBy("a_block", "r_block").cogroup(right.groupBy("a_block", "r_block")).applyInArrow(run, schema)


def scored(anchors: pa.Table, rows: pa.Table):
    """(tile, scores, same) for tiles of anchors against rows in order of their ids."""
    width = max((pa.compute.max(pa.compute.list_value_length(t.column("embedding"))).as_py() or 0) for t in (anchors, rows))
    x, y = (quantised(t.column("embedding").combine_chunks(), width) for t in (anchors, rows))
    mine, theirs = (t.column("label").to_numpy() for t in (anchors, rows))
    for at in range(0, len(x), TILE):
        yield slice(at, at + TILE), inner_products(x[at : at + TILE], y), mine[at : at + TILE, None] == theirs[None]


def _best_positives(k: int):
    fields = pa.schema([("anchor_id", pa.int64()), ("score", pa.int64()), ("id", pa.int64())])

    def run(anchors: pa.Table, rows: pa.Table) -> pa.Table:
        if not anchors.num_rows or not rows.num_rows:
            return fields.empty_table()
        rows = rows.sort_by("vec_id")
        a, r, out = anchors.column("vec_id").to_numpy(), rows.column("vec_id").to_numpy(), []
        for tile, scores, same in scored(anchors, rows):
            own = a[tile]
            row, column = firsts(scores, same & (own[:, None] != r[None]), k)
            out.append((own[row], scores[row, column].astype(np.int64), r[column]))
        return pa.table([np.concatenate(c) for c in zip(*out, strict=True)], schema=fields)

    return run, "anchor_id bigint, score bigint, id bigint"


def _best_of_slots(k: int):
    fields = pa.schema([("anchor_id", pa.int64()), ("slot", pa.int32()), ("score", pa.int64()), ("id", pa.int64())])

    def run(anchors: pa.Table, rows: pa.Table) -> pa.Table:
        if not anchors.num_rows or not rows.num_rows:
            return fields.empty_table()
        rows = rows.sort_by("vec_id")
        a, r, out = anchors.column("vec_id").to_numpy(), rows.column("vec_id").to_numpy(), []
        limits = anchors.column("uppers").to_pylist()
        upper = np.full((len(limits), max(map(len, limits)) + 1), -np.inf)
        for i, own in enumerate(limits):
            upper[i, : len(own)] = own
        least = anchors.column("least").to_numpy().astype(float)
        for tile, scores, same in scored(anchors, rows):
            fits = ~same & (scores >= least[tile, None])
            for slot in range(upper.shape[1] - 1):
                row, column = firsts(scores, fits & (scores <= upper[tile, slot, None]) & (scores > upper[tile, slot + 1, None]), k)
                out.append((a[tile][row], np.full(len(row), slot, np.int32), scores[row, column].astype(np.int64), r[column]))
        return pa.table([np.concatenate(c) for c in zip(*out, strict=True)], schema=fields)

    return run, "anchor_id bigint, slot int, score bigint, id bigint"


def ranked(df: DataFrame, by: list[str], k: int) -> DataFrame:
    """The first ``k`` rows of each group by score, then by id; Spark limits each partition's groups before the shuffle."""
    return df.withColumn("nth", F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("score"), "id"))).where(F.col("nth") <= k).drop("nth")


def mine(df: DataFrame, anchor: Column, label: Column, positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score of ``df`` (vec_id, label, embedding).

    ``anchor`` says which rows are anchors, ``label`` is the label to go by. Vectors are scored by the inner product of
    floor(256 x); a shorter one counts as filled with zeros, a component beyond 2^60 as that and a score beyond 2^53 as that. Rows with
    a null id, label, vector or component or one that is not finite take no part; of rows that repeat an id the smallest
    by label and vector does. A positive below zero has an empty window, an anchor without positives no rows. Columns
    but these three are not read; an empty table gives no rows.
    """
    rows = written(taking_part(df, label), "negatives-rows")
    anchors = rows.where(anchor)
    n_rows, n_anchors = rows.count(), anchors.count()
    run, schema = _best_positives(positives)
    best = written(ranked(cells(rows, anchors, run, schema, n_rows, n_anchors), ["anchor_id"], positives), "negatives-positives").where("score >= 0")
    upper, lower = F.expr(f"(score * {high}) div 100"), F.expr(f"(score * {low} + 99) div 100")
    windows = best.groupBy("anchor_id").agg(F.sort_array(F.collect_list(F.struct((-F.col("score")).alias("neg"), "id", upper.alias("upper"), lower.alias("lower")))).alias("windows"))
    limits = windows.select(F.col("anchor_id").alias("vec_id"), F.col("windows.upper").alias("uppers"), F.array_min("windows.lower").alias("least"))
    run, schema = _best_of_slots(negatives)
    slots = ranked(cells(rows, anchors.join(limits, "vec_id"), run, schema, n_rows, n_anchors), ["anchor_id", "slot"], negatives)
    tops = slots.groupBy("anchor_id").agg(F.collect_list(F.struct((-F.col("score")).alias("neg"), "id", "slot")).alias("tops"))
    entry = "struct<neg: bigint, id: bigint, slot: int>"
    merged = f"slice(array_sort(concat(element_at(done, -1), filter(tops, t -> t.slot = i))), 1, {negatives})"
    walk = f"aggregate(sequence(size(windows) - 1, 0, -1), array(cast(array() AS array<{entry}>)), (done, i) -> concat(done, array({merged})))"
    answers = windows.join(tops, "anchor_id").withColumn("merges", F.expr(f"reverse({walk})"))  # of slots 0, 1, ... and none
    each = answers.select("anchor_id", F.posexplode("windows").alias("i", "w"), "merges")
    found = each.select("anchor_id", "w", F.posexplode(F.expr("filter(merges[i], t -> -t.neg >= w.lower)")).alias("at", "t"))
    return found.select("anchor_id", F.col("w.id").alias("positive_id"), (F.col("at") + 1).alias("rank"), F.col("t.id").alias("negative_id"), (-F.col("w.neg")).alias("positive_score"), (-F.col("t.neg")).alias("negative_score"))


def mine_embeddings(df: DataFrame) -> DataFrame:
    """Negatives of the rows whose vec_id is divisible by 100; where it is divisible by 7, the label is the next of ten."""
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label").cast("bigint") + 1) % 10).otherwise(F.col("label").cast("bigint"))
    return mine(df, F.col("vec_id") % 100 == 0, label)
