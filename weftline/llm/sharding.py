"""Sharding by sampled splitters: near-equal bytes a shard, rows in key order.

Rows are keyed by the hash of their text, then of their id, so equal texts are neighbours. Splitters are quantiles
of a size-weighted sample; a range with more rows than one task should sort is subdivided by the hash of the id. Sums
over these pieces give each row its exact place in bytes and rows, and a shard is an equal share of the bytes.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weftline.llm.common import written


def _composite(k1: np.ndarray, k2: np.ndarray) -> np.ndarray:
    """The two signed keys as 16 bytes that sort as the pair does."""
    top = np.uint64(1 << 63)
    return np.ascontiguousarray(np.stack([k1.view(np.uint64) ^ top, k2.view(np.uint64) ^ top], 1).astype(">u8")).view("S16").ravel()


def sampled_splitters(keys: DataFrame, total: int, ranges: int, samples: int) -> np.ndarray:
    """``ranges`` - 1 or fewer boundaries. A row is drawn with probability size * samples / total, so ``samples``
    bounds the expected number of drawn rows; a row larger than a sample's share counts by its size."""
    share = max(1.0, total / samples)
    lot = (F.xxhash64("k1", "k2", "doc_id", F.lit("draw")).cast("double") / F.lit(2.0**64) + 0.5) * share
    drawn = keys.where(lot < F.col("size")).select("k1", "k2", "size").toPandas()
    if drawn.empty or ranges < 2:
        return np.array([], "S16")
    keyed = _composite(drawn.k1.to_numpy(np.int64), drawn.k2.to_numpy(np.int64))
    order = np.argsort(keyed)
    weight = np.cumsum(np.maximum(drawn["size"].to_numpy()[order], share))
    at = np.searchsorted(weight, weight[-1] * np.arange(1, ranges) / ranges)
    return np.unique(keyed[order][at])


def shard(docs: DataFrame, shards: int = 8, ranges: int = 256, samples: int = 8192, piece_rows: int = 50_000) -> DataFrame:
    """doc_id, size, text_crc32, law (``bytes``), shard, slot, grown_shard (null under this law).

    Shards differ from an equal share of the bytes by one row's size at most; slots count from 0 without gaps. Null
    texts count as empty; repeated rows take slots of their own; null ids sort as hash 42. Empty input: no rows.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    text = F.coalesce("text", F.lit(""))
    keys = docs.select("doc_id", (F.octet_length(text).cast("bigint") + 1).alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.xxhash64(text).alias("k1"), F.xxhash64("doc_id").alias("k2"))
    keys = written(keys, "shard-keys")
    n, total = keys.agg(F.count("*"), F.coalesce(F.sum("size"), F.lit(0))).first()
    splitters = sampled_splitters(keys, total, ranges, samples)

    def place(batches):
        for b in batches:
            at = np.searchsorted(splitters, _composite(b.column("k1").to_numpy(), b.column("k2").to_numpy()), side="right")
            yield b.append_column("range", pa.array(at, pa.int32()))

    ranged = keys.mapInArrow(place, f"doc_id {kind}, size bigint, text_crc32 bigint, k1 bigint, k2 bigint, `range` int")
    filled = ranged.groupBy("range").count()
    parts = filled.select("range", F.ceil(F.col("count") / piece_rows).cast("int").alias("parts"))
    pieces = ranged.join(F.broadcast(parts), "range").withColumn("piece", F.expr("pmod(xxhash64(k2, 7), parts)").cast("int")).drop("parts")
    pieces = written(pieces, "shard-pieces")
    sums = pieces.groupBy("range", "piece").agg(F.sum("size").alias("b"), F.count("*").alias("r"))
    before = Window.orderBy("range", "piece").rowsBetween(Window.unboundedPreceding, -1)  # one row a piece
    starts = sums.select("range", "piece", F.coalesce(F.sum("b").over(before), F.lit(0)).alias("b0"), F.coalesce(F.sum("r").over(before), F.lit(0)).alias("r0"))
    within = Window.partitionBy("range", "piece").orderBy("k1", "k2", "doc_id", "size")
    placed = pieces.withColumns({"b": F.sum("size").over(within.rowsBetween(Window.unboundedPreceding, 0)), "r": F.row_number().over(within)})
    placed = placed.join(starts, ["range", "piece"])
    middle = F.col("b0") + F.col("b") - F.col("size") / 2
    placed = placed.select("doc_id", "size", "text_crc32", F.least(F.floor(middle * shards / max(total, 1)), F.lit(shards - 1)).cast("int").alias("shard"), (F.col("r0") + F.col("r") - 1).alias("rank"))
    placed = written(placed, "shard-places")
    first = placed.groupBy("shard").agg(F.min("rank").alias("first"))
    return placed.join(F.broadcast(first), "shard").select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("rank") - F.col("first")).alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
