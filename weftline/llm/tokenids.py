"""Token ids in files: frequency-ranked ids, byte-aligned, with control bytes apart from the data.

A block holds whole documents. Its ids are numbered anew by how often the block has them, so the 256 most frequent take one
byte and nearly all others two; the block carries the id of each rank, so it can be read alone, and texts are tokenised
once, with no pass before that counts. Beside the ranks stand one control byte for four ids (two bits each: bytes less one)
and the bytes themselves, low first. A decoder looks up four lengths by control byte, sums them to offsets and gathers. Blocks
are rows of Parquet files, so Spark commits them and any store that Spark reaches holds them; files follow each other in
ascending order of the documents' ids.
"""

from __future__ import annotations

import functools
import itertools
import os
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.llm.bpe import byte_chars
from weftline.llm.common import as_bytes, small_batches, table_path

BLOCK, FILE, FILES = 524_288, 8_000_000, 8_192  # ids of a block, bytes of text of a file, and files at most
LENGTHS = np.array([[1 + (c >> 2 * i & 3) for i in range(4)] for c in range(256)], np.uint8)


def pack(ranks: np.ndarray) -> tuple[bytes, bytes]:
    """Control bytes and data of unsigned 32-bit numbers."""
    most = int(ranks.max(initial=0))
    lengths = np.ones(len(ranks), np.uint8)
    for k in (1, 2, 3):
        if most >> 8 * k:
            lengths += ranks >= 1 << 8 * k
    codes = np.zeros(-(-len(ranks) // 4) * 4, np.uint8)
    codes[: len(ranks)] = lengths - 1
    control = codes[::4] | codes[1::4] << 2 | codes[2::4] << 4 | codes[3::4] << 6
    starts = np.cumsum(lengths, dtype=np.int64) - lengths
    data = np.empty(int(lengths.sum(dtype=np.int64)), np.uint8)
    data[starts] = ranks.astype(np.uint8)
    for k in range(1, int(lengths.max(initial=1))):
        more = np.flatnonzero(lengths > k)
        data[starts[more] + k] = (ranks[more] >> 8 * k).astype(np.uint8)
    return control.tobytes(), data.tobytes()


def unpack(control: bytes, data: bytes, n: int) -> np.ndarray:
    """The ``n`` numbers that ``pack`` was given."""
    lengths = LENGTHS[np.frombuffer(control, np.uint8)].ravel()[:n]
    starts = np.cumsum(lengths, dtype=np.int64) - lengths
    raw = np.frombuffer(data, np.uint8)
    out = raw[starts].astype(np.uint32)
    for k in range(1, int(lengths.max(initial=1))):
        more = np.flatnonzero(lengths > k)
        out[more] |= raw[starts[more] + k].astype(np.uint32) << 8 * k
    return out


class Words(dict):
    """The tokenizer of a file, once in each Python worker: the ids of chunks between ASCII white space, which no token spans.

    It holds what it has met, up to ``KEPT`` bytes; when full it keeps what it met first, as frequent chunks come early. New
    chunks of ASCII and Latin-1 letters, for which the file's normaliser only lower-cases, are cut by its own pattern and
    merged by its own model; all others, and all chunks of files with another normaliser or pattern, go through the
    library's whole pipeline.
    """

    KEPT, SHORT, ENTRY = 240_000_000, 40, 150
    #: The normaliser and pattern that the short way holds for.
    STEPS = ["NFC", "Replace", "Lowercase"]
    PIECES = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"

    def __init__(self, path: str):
        super().__init__()
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import json
        import re

        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            made = json.load(f)
        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.vocabulary = self.tokenizer.get_vocab_size(with_added_tokens=True)
        steps = [s["type"] for s in (made.get("normalizer") or {}).get("normalizers", [])]
        cuts = [s.get("pattern", {}).get("Regex") for s in (made.get("pre_tokenizer") or {}).get("pretokenizers", [])]
        marked = all("<" in t["content"] for t in made.get("added_tokens", []))
        self.short = marked and steps == self.STEPS and cuts == [self.PIECES, None] and made["model"].get("dropout") is None
        self.plain = re.compile("[\x21-\x3b\x3d-\x7e\xc0-\xd6\xd8-\xf6\xf8-\xff]+").fullmatch  # no "<"
        # The same pattern over what is plain and lower-case.
        self.cut = re.compile(self.PIECES.replace(r"\p{L}", "a-zß-öø-ÿ").replace(r"\p{N}", "0-9")).findall
        self.raw = [np.uint32(i).tobytes() for i in range(self.vocabulary)]
        self.to_chars = dict(enumerate(byte_chars()))
        self.size = 0

    def __missing__(self, chunk: bytes) -> bytes:
        text = chunk.decode()
        if self.short and self.plain(text):
            low = text.lower()
            pieces = [low] if low.isalpha() else self.cut(low)
            if pieces == [text]:
                shown = text if text.isascii() else chunk.decode("latin-1").translate(self.to_chars)
                ids = b"".join([self.raw[t.id] for t in self.model.tokenize(shown)])
            else:
                ids = b"".join([self[p.encode()] for p in pieces])
        else:
            ids = np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, np.uint32).tobytes()
        if len(chunk) <= self.SHORT:
            self[chunk] = ids
            self.size += len(chunk) + len(ids) + self.ENTRY
        return ids

    def encode(self, texts: list[bytes]) -> list[bytes]:
        """The ids of each text as unsigned 32-bit integers in bytes."""
        if self.size > self.KEPT:
            early = dict(itertools.islice(self.items(), len(self) // 2))
            self.clear()
            self.update(early)
            self.size = self.size // 2
        return [b"".join(map(self.__getitem__, t.split())) for t in texts]


@functools.cache
def words(path: str) -> Words:
    return Words(path)


def block_of(ids: np.ndarray) -> tuple[bytes, bytes, bytes]:
    """The ids by rank (most frequent first, ties to the smaller id), control bytes and data of a block."""
    n = np.bincount(ids)
    used = np.flatnonzero(n)
    by_rank = used[np.lexsort((used, -n[used]))]
    rank = np.zeros(len(n), np.uint32)
    rank[by_rank] = np.arange(len(by_rank), dtype=np.uint32)
    return (by_rank.astype("<u4").tobytes(), *pack(rank[ids]))


def write(docs: DataFrame, out: str, path: str, end: int) -> None:
    """Writes the blocks of ``docs`` (doc_id, text) to ``out`` by the tokenizer file ``path``, the id ``end`` after each document.
    Documents stand in ascending order of doc_id, null first, those of one id by the hash of their text; equal rows
    are dealt over as many files as they need. Null text counts as empty, an empty table gives no blocks."""
    field = docs.select("doc_id").schema[0]
    kind = field.dataType.simpleString()
    size = docs.agg(F.coalesce(F.sum(F.octet_length("text") + 8), F.lit(0))).first()[0]
    files = int(min(FILES, max(1, -(-size // FILE))))

    def run(batches):
        own, part, nth, before, size = words(path), TaskContext.get().partitionId(), 0, 0, 0
        last, held, named = np.array([end], np.uint32).tobytes(), [], None

        def block():
            ids = np.frombuffer(b"".join([h[1] for h in held]), np.uint32)
            rows = pa.array([[h[0] for h in held]], pa.list_(named)), pa.array([[len(h[1]) // 4 for h in held]], pa.list_(pa.int64()))
            return pa.RecordBatch.from_arrays([pa.array([part]), pa.array([nth]), pa.array([before]), pa.array([len(ids)]), *rows, *(pa.array([x]) for x in block_of(ids))], ["part", "nth", "before", "n_ids", "doc_ids", "counts", "ranks", "control", "data"])

        for batch in small_batches(batches, 64):
            named = batch.column("doc_id").type
            for i, x in zip(batch.column("doc_id").to_pylist(), own.encode(as_bytes(batch.column("text"))), strict=True):
                held.append((i, x + last))
                size += len(x) // 4 + 1
                if size >= BLOCK:
                    yield block()
                    held, nth, before, size = [], nth + 1, before + size, 0
        if held:
            yield block()

    rows = docs.select("doc_id", "text", F.xxhash64("text").alias("k0"), F.monotonically_increasing_id().alias("k1"))
    dealt = rows.repartitionByRange(files, "doc_id", "k0", "k1").sortWithinPartitions("doc_id", "k0", "k1").select("doc_id", "text")
    blocks = dealt.mapInArrow(run, f"part bigint, nth bigint, before bigint, n_ids bigint, doc_ids array<{kind}>, counts array<bigint>, ranks binary, control binary, data binary")
    blocks.write.option("compression", "none").parquet(out)


def read(spark: SparkSession, out: str, digest: bool = False) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens and ids (array<bigint>), or ids_crc32 if ``digest``, of what
    ``write`` left in ``out``. Ids in files before a document's own are summed from the blocks' heads: a number for each file."""
    blocks = spark.read.parquet(out)
    ends = {r.part: r.n for r in blocks.groupBy("part").agg(F.sum("n_ids").alias("n")).collect()}
    at, offsets = 0, {}
    for part in sorted(ends):
        offsets[part], at = at, at + ends[part]
    kind = blocks.schema["doc_ids"].dataType.elementType.simpleString()
    last = ("ids_crc32", "bigint") if digest else ("ids", "array<bigint>")

    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                row = {c: batch.column(c)[i] for c in batch.schema.names}
                counts = row["counts"].values.to_numpy()
                ids = np.frombuffer(row["ranks"].as_py(), "<u4")[unpack(row["control"].as_py(), row["data"].as_py(), row["n_ids"].as_py())]
                stops = np.cumsum(counts)
                if digest:
                    raw = memoryview(ids.tobytes())
                    made = pa.array([zlib.crc32(raw[4 * (b - n) : 4 * b]) for n, b in zip(counts.tolist(), stops.tolist(), strict=True)], pa.int64())
                else:
                    made = pa.ListArray.from_arrays(pa.array([0, *stops], pa.int32()), pa.array(ids.astype(np.int64)))
                start = stops - counts + row["before"].as_py() + offsets[row["part"].as_py()]
                yield pa.RecordBatch.from_arrays([row["doc_ids"].values, pa.array(start), pa.array(counts), made], ["doc_id", "start", "n_tokens", last[0]])

    return blocks.mapInArrow(run, f"doc_id {kind}, start bigint, n_tokens bigint, {last[0]} {last[1]}")


def write_and_read(docs: DataFrame, path: str, end: int) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of all documents, read back from files in a new folder of the shared one."""
    out = table_path(docs.sparkSession, "token-ids")
    write(docs, out, path, end)
    return read(docs.sparkSession, out, digest=True)
