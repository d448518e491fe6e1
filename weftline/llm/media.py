"""Media columns by content-defined chunking.

A payload is stored as an 8-bit mono WAV, lossless. A rolling gear hash over the last 32 samples cuts it, so equal
passages are cut alike wherever they stand. A medium is a header and an ordered list of chunk digests. Joins on digests
alone find which medium owns each chunk, the one with the smallest digest of its own; a medium's own chunks are packed
together, and the packs, each once, are a table bucketed by medium. Reading puts a medium together from its pack and
from chunks fetched out of other packs, and verifies the digest of every chunk and of the whole medium.
"""

from __future__ import annotations

import hashlib
import io
import uuid
import wave
import zlib

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.llm.common import as_bytes, in_share, removed, small_batches, smallest, table_path, written

UNIT, HEADER, RATE = 64, 44, 8000
SAMPLES, SAMPLE_BYTES, DICTIONARY = 1500, 65_536, 65_536  # texts that a packing dictionary is made of, bytes of each, its bytes


def gear_table(seed: int = 11) -> np.ndarray:
    return np.random.default_rng(seed).integers(0, 1 << 32, 256, dtype=np.uint64).astype(np.uint32)


def rolling_gear(data: np.ndarray, gear: np.ndarray) -> np.ndarray:
    """h[i] = sum of gear[data[i-k]] << k over the last 32 bytes, by doubling the covered width five times."""
    h = gear[data]
    for width in (1, 2, 4, 8, 16):
        h[width:] += h[:-width] << np.uint32(width)
    return h


def cut_points(data: bytes, least: int, average: int, most: int, gear: np.ndarray) -> list[int]:
    """Ends of the chunks: the first place after ``least`` bytes where the hash's top bits are zero, ``most`` at the
    latest. Empty data has no chunk."""
    if len(data) <= least:
        return [len(data)] if data else []
    bits = average.bit_length() - 1
    hits = np.flatnonzero(rolling_gear(np.frombuffer(data, np.uint8), gear) >> np.uint32(32 - bits) == 0) + 1
    ends, at = [], 0
    while len(data) - at > least:
        k = np.searchsorted(hits, at + least)
        at = min(int(hits[k]) if k < len(hits) else len(data), at + most, len(data))
        ends.append(at)
    if not ends or ends[-1] < len(data):
        ends.append(len(data))
    return ends


def padded(raw: bytes) -> bytes:
    return raw + bytes(-len(raw) % UNIT if raw else UNIT)


def as_wav(payload: bytes) -> bytes:
    with io.BytesIO() as out:
        with wave.open(out, "wb") as w:
            w.setnchannels(1)
            w.setsampwidth(1)
            w.setframerate(RATE)
            w.writeframes(payload)
        return out.getvalue()


def samples_of(medium: bytes) -> bytes:
    with wave.open(io.BytesIO(medium)) as w:
        return w.readframes(w.getnframes())


def features(payload: bytes, chunks: int) -> str:
    """Integers only: sum and peak of the samples, crossings of the middle, number of chunks."""
    s = np.frombuffer(payload, np.uint8)
    return f"sum={int(s.sum(dtype=np.int64))};peak={int(s.max())};cross={int(np.count_nonzero((s[1:] > 127) != (s[:-1] > 127)))};chunks={chunks}"


def cut(body: bytes, sizes: tuple[int, int, int], gear: np.ndarray) -> tuple[list[bytes], list[int]]:
    """Digests and ends of the chunks."""
    ends = cut_points(body, *sizes, gear)
    return [hashlib.sha256(body[a:b]).digest() for a, b in zip([0, *ends], ends, strict=False)], ends


def dictionary(docs: DataFrame) -> bytes:
    """What packs of ``docs`` have in common, learnt from at most ``SAMPLES`` texts of at most ``SAMPLE_BYTES`` bytes, those
    with the smallest hashes; empty where they are fewer than 100 or hold less than 16 times its size."""
    texts = docs.select("text").where((F.octet_length("text") > 0) & (F.octet_length("text") <= SAMPLE_BYTES)).withColumn("lot", F.xxhash64("text"))
    total = texts.select("lot").distinct().count()
    once = texts.where(in_share("lot", 2 * SAMPLES + 100, total)).groupBy("lot").agg(F.first("text").alias("text"))  # copies count once
    sample = [r.text.encode() for r in smallest(once, "lot", SAMPLES, total).select("text").collect()]
    return zstandard.train_dictionary(DICTIONARY, sample).as_bytes() if len(sample) >= 100 and sum(map(len, sample)) >= 16 * DICTIONARY else b""


def presses(common: bytes) -> tuple[zstandard.ZstdCompressor, zstandard.ZstdDecompressor]:
    known = {"dict_data": zstandard.ZstdCompressionDict(common)} if common else {}
    return zstandard.ZstdCompressor(level=9, **known), zstandard.ZstdDecompressor(**known)


def chunk_lists(docs: DataFrame, sizes: tuple[int, int, int]) -> DataFrame:
    """doc_id, n_bytes, medium (its SHA-256) and digests of the chunks in order; a row for every row of ``docs`` (doc_id,
    text; null text is empty, repeated rows stay rows)."""
    gear = gear_table()

    def run(batches):
        for batch in small_batches(batches, 1024):
            out = []
            for raw in as_bytes(batch.column("text")):
                medium = as_wav(padded(raw))
                out.append((len(raw), hashlib.sha256(medium).digest(), cut(medium[HEADER:], sizes, gear)[0]))
            kinds = (pa.int64(), pa.binary(), pa.list_(pa.binary()))
            cols = list(zip(*out, strict=True)) or [()] * len(kinds)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(c, t) for c, t in zip(cols, kinds, strict=True))], ["doc_id", "n_bytes", "medium", "digests"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_bytes bigint, medium binary, digests array<binary>")


def borrowed_chunks(media: DataFrame) -> DataFrame:
    """(medium, digest, owner): the chunks that a medium of ``media`` (medium, digests) does not own. The owner of a chunk
    is the smallest medium that holds it; only digests are moved."""
    held = media.groupBy("medium").agg(F.first("digests").alias("digests"))
    held = held.select("medium", F.explode(F.array_distinct("digests")).alias("digest"))
    owners = held.groupBy("digest").agg(F.min("medium").alias("owner"), F.count("*").alias("n")).where("n > 1").drop("n")
    return held.join(owners, "digest").where("medium != owner").select("medium", "digest", "owner")


def own_parts(digests: list[bytes], ends: list[int], borrowed: set[bytes]) -> list[tuple[bytes, int, int]]:
    """(digest, start, end) of the chunks that a medium's pack holds, in order: its own ones, each once."""
    seen, out = set(borrowed), []
    for digest, start, end in zip(digests, [0, *ends], ends, strict=False):
        if digest not in seen:
            seen.add(digest)
            out.append((digest, start, end))
    return out


KEPT = pa.schema([("medium", pa.binary()), ("header", pa.binary()), ("digests", pa.list_(pa.binary())), ("ends", pa.list_(pa.int32())), ("gone", pa.list_(pa.binary())), ("pack", pa.binary())])
KEPT_SQL = "medium binary, header binary, digests array<binary>, ends array<int>, gone array<binary>, pack binary"


def store(docs: DataFrame, borrowed: DataFrame, sizes: tuple[int, int, int], common: bytes, name: str, path: str) -> DataFrame:
    """Every medium once, in a table bucketed by medium at ``path``, so that reading it moves no pack: header, digests and
    ends of its chunks, those that are borrowed (gone), and the pack of all others. Equal media meet by a grouped
    first() that combines before the shuffle; behind it, chunks that are borrowed or repeated are taken out."""
    spark, gear = docs.sparkSession, gear_table()

    def pack(batches):
        press, _ = presses(common)
        for batch in small_batches(batches, 1024):
            found = {}
            for raw in as_bytes(batch.column("text")):
                whole = as_wav(padded(raw))
                medium = hashlib.sha256(whole).digest()
                if medium not in found:
                    digests, ends = cut(whole[HEADER:], sizes, gear)
                    found[medium] = {"medium": medium, "header": whole[:HEADER], "digests": digests, "ends": ends, "pack": press.compress(whole[HEADER:])}
            yield pa.RecordBatch.from_pylist(list(found.values()), schema=KEPT)

    def keep_own(batches):
        press, unpress = presses(common)
        for batch in small_batches(batches, 512):
            rows = batch.to_pylist()
            for r in rows:
                parts = own_parts(r["digests"], r["ends"], set(r["gone"] or ()))
                if sum(b - a for _, a, b in parts) < r["ends"][-1]:
                    body = unpress.decompress(r["pack"])
                    r["pack"] = press.compress(b"".join(body[a:b] for _, a, b in parts))
            yield pa.RecordBatch.from_pylist(rows, schema=KEPT)

    columns = ("header", "digests", "ends", "pack")
    once = docs.select("text").mapInArrow(pack, KEPT_SQL).groupBy("medium").agg(F.first(F.struct(*columns)).alias("r")).select("medium", "r.*")
    gone = borrowed.groupBy("medium").agg(F.collect_list("digest").alias("gone"))
    own = once.join(gone.hint("merge"), "medium", "left").select(*KEPT.names).mapInArrow(keep_own, KEPT_SQL)
    own.write.option("path", path).bucketBy(int(spark.conf.get("spark.sql.shuffle.partitions")), "medium").saveAsTable(name)
    return spark.table(name)


def read_back(stored: DataFrame, borrowed: DataFrame, common: bytes) -> DataFrame:
    """Each medium of the store: its bytes put together, verified and described; a missing or wrong chunk fails the task.
    No more than one medium's bytes are in one row, and a chunk leaves its owner's pack only if it is asked for."""
    asked = borrowed.groupBy(F.col("owner").alias("medium")).agg(F.collect_set("digest").alias("asked"))

    def lend(batches):
        _, unpress = presses(common)
        for batch in small_batches(batches, 256):
            out: list[tuple[bytes, bytes]] = []
            for r in batch.to_pylist():
                body, at, wanted = unpress.decompress(r["pack"]), 0, set(r["asked"])
                for digest, start, end in own_parts(r["digests"], r["ends"], set(r["gone"] or ())):
                    if digest in wanted:
                        out.append((digest, body[at : at + end - start]))
                    at += end - start
            yield pa.RecordBatch.from_arrays([pa.array([o[i] for o in out], pa.binary()) for i in (0, 1)], ["digest", "chunk"])

    def whole(batches):
        _, unpress = presses(common)
        for batch in small_batches(batches, 64):
            rows = []
            for r in batch.to_pylist():
                body, at, chunks = unpress.decompress(r["pack"]), 0, {x["digest"]: x["chunk"] for x in r["lent"] or ()}
                for digest, start, end in own_parts(r["digests"], r["ends"], set(r["gone"] or ())):
                    chunks[digest] = body[at : at + end - start]
                    at += end - start
                if any(hashlib.sha256(chunk).digest() != digest for digest, chunk in chunks.items()):
                    raise ValueError("a stored chunk does not have its digest")
                medium = r["header"] + b"".join(chunks[digest] for digest in r["digests"])
                if hashlib.sha256(medium).digest() != r["medium"]:
                    raise ValueError("a medium was not put together as it was")
                payload = samples_of(medium)
                rows.append({"medium": r["medium"], "payload_bytes": len(payload), "payload_sha256": hashlib.sha256(payload).hexdigest(), "tail_crc32": zlib.crc32(payload[-UNIT:]), "media_bytes": len(medium), "media_sha256": r["medium"].hex(), "feature": features(payload, len(r["digests"]))})
            yield pa.RecordBatch.from_pylist(rows, schema=kinds)

    kinds = pa.schema([("medium", pa.binary()), ("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()), ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("feature", pa.string())])
    chunks = stored.join(asked.hint("merge"), "medium").mapInArrow(lend, "digest binary, chunk binary")
    lent = borrowed.select("medium", "digest").join(chunks, "digest").groupBy("medium").agg(F.collect_list(F.struct("digest", "chunk")).alias("lent"))
    return stored.join(lent.hint("merge"), "medium", "left").mapInArrow(whole, "medium binary, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, feature string")


def chunked_media(docs: DataFrame, least: int = 512, average: int = 2048, most: int = 8192) -> DataFrame:
    """One row per row of ``docs`` with the stored medium's figures; other columns of ``docs`` are not read. Null texts
    are empty ones and have a medium of silence; equal texts have one medium; no documents give no rows.

    The result is written before it is returned, so that the packs and their table can be dropped.
    """
    spark, sizes = docs.sparkSession, (least, average, most)
    media = written(chunk_lists(docs, sizes), "media")
    borrowed = written(borrowed_chunks(media), "media-borrowed")
    name, path = f"weftline_packs_{uuid.uuid4().hex}", table_path(spark, "packs")
    common = written(spark.createDataFrame([(dictionary(docs),)], "common binary"), "packs-dictionary")
    stored = store(docs, borrowed, sizes, bytes(common.first().common), name, path)
    described = read_back(stored, borrowed, bytes(common.first().common))
    out = written(media.select("doc_id", "n_bytes", "medium").join(described, "medium").drop("medium"), "media-figures")
    spark.sql(f"DROP TABLE {name}")
    removed(spark, path)
    return out
