"""SimHash near-duplicates by deletion-variant signatures.

64 bits cut into 3 segments: of 4 differing bits some segment holds one at most. A segment with one bit wildcarded
agrees between two fingerprints that differ there by that bit or by none, so each fingerprint is indexed under its
64 one-wildcard variants, equal variants are joined, and the full distance is verified.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.llm.common import as_bytes, small_batches, words_of, written
from weftline.llm.components import connected_components

SEED, SHINGLE, BITS = 42, 4, 64
SEGMENTS = ((0, 21), (21, 42), (42, 64))  # low bit, high bit


def fingerprint(raw: bytes) -> int:
    """Bit i is set if it is set in over half the shingle hashes; no words: 0."""
    words = words_of(raw)
    if not words:
        return 0
    joined = b" ".join(words)
    n = max(1, len(words) - SHINGLE + 1)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])[:n].tolist()
    stops = ends[min(SHINGLE, len(words)) - 1 :].tolist()
    digest = xxhash.xxh64_digest
    hashes = b"".join([digest(joined[a:b], SEED) for a, b in zip(starts, stops, strict=True)])
    bits = np.unpackbits(np.frombuffer(hashes, np.uint8).reshape(n, 8), axis=1).sum(0, dtype=np.int64) * 2 > n
    return int.from_bytes(np.packbits(bits).tobytes(), "big")


def fingerprints(docs: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, ``keep`` and fp (the 64 bits as a signed long) of every row; null text counts as empty."""
    kept = ["doc_id", *keep]

    def run(batches):
        for batch in small_batches(batches):
            fps = np.array([fingerprint(x) for x in as_bytes(batch.column("text"))], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array(fps)], [*kept, "fp"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*kept).schema)
    return docs.select(*kept, "text").mapInArrow(run, f"{fields}, fp bigint")


def _segment(x: str, low: int, high: int) -> str:
    return f"(shiftrightunsigned({x}, {low}) & {(1 << (high - low)) - 1}L)"


def variants(fps: DataFrame) -> DataFrame:
    """(variant, fp): the number of the wildcarded bit and the rest of its segment, in one long."""
    made = []
    for low, high in SEGMENTS:
        for bit in range(low, high):
            rest = f"({_segment('fp', low, high)} & ~{1 << (bit - low)}L)"
            made.append(f"(shiftleft({bit}L, 32) | {rest})")
    return fps.select("fp", F.explode(F.expr(f"array({', '.join(made)})")).alias("variant"))


def first_variant(x: str) -> str:
    """SQL for the wildcarded bit under which a pair with the differing bits ``x`` meets first; each pair meets there
    once. A segment without a difference meets under its lowest bit, else under the bit that differs."""
    cases = []
    for low, high in SEGMENTS:
        seg = _segment(x, low, high)
        cases.append(f"WHEN {seg} = 0 THEN {low} WHEN bit_count({seg}) = 1 THEN {low} + bit_count({seg} - 1)")
    return f"CASE {' '.join(cases)} END"


def links(fps: DataFrame, most: int = 4) -> DataFrame:
    """Pairs (a, b), a < b, of distinct fingerprints at ``most`` or fewer differing bits, each once.

    Spark takes the index, 64 rows a fingerprint, to be as large as the fingerprints; without the hint it would be sent to
    the driver whole and broadcast.
    """
    index = variants(fps)
    pairs = index.alias("l").hint("merge").join(index.alias("r"), F.expr(f"l.variant = r.variant AND l.fp < r.fp AND bit_count(l.fp ^ r.fp) <= {most} AND shiftright(l.variant, 32) = {first_variant('(l.fp ^ r.fp)')}"))
    return pairs.select(F.col("l.fp").alias("a"), F.col("r.fp").alias("b"))


def near_duplicates(docs: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, ``keep``, fingerprint, component_id (smallest doc_id reachable by links) and root (the smallest
    fingerprint of the component, as a signed long) of every row of ``docs``.

    Copies share a fingerprint and meet by a grouped minimum, never as pairs. Rows with a null doc_id keep their
    fingerprint and join its component; a component of null ids only has a null component_id, and its root tells it
    from others. Columns of ``docs`` other than doc_id, text and ``keep`` are not read; empty input gives no rows.
    """
    found = written(fingerprints(docs, keep), "fingerprints")
    groups = written(found.groupBy("fp").agg(F.min("doc_id").alias("least")), "groups")
    linked = connected_components(links(groups.select("fp")), "a", "b")
    root = groups.join(linked, groups.fp == linked.node, "left").select("fp", "least", F.coalesce("component", "fp").alias("root"))
    smallest = root.groupBy("root").agg(F.min("least").alias("component_id"))
    named = root.join(smallest, "root").select("fp", "component_id", "root")
    return found.join(named, "fp").select("doc_id", *keep, F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id", "root")
