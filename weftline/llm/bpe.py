"""Byte-level BPE encoding and decoding: the tokenizers library over Arrow batches.

The vocabulary file holds base64 tokens with ranks. Two neighbouring parts merge when their joined bytes have a rank,
lowest rank first, so every split of a token into two tokens is a merge of that rank. Bytes are mapped to printable
characters, pieces are cut by the pattern, and decoding maps the characters back to bytes, whichever way a
multi-byte character was split over tokens.
"""

from __future__ import annotations

import base64
import functools
import hashlib
import os

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from weftline.llm.common import small_batches


@functools.cache
def byte_chars() -> list[str]:
    """The printable character of each byte: itself where printable, else the next free one from 256 on."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(others)) for b in range(256)]


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines if line.strip())}


class Codec:
    """The tokenizer of a ranks file; built once in each Python worker.

    The pattern cuts a text into pieces, the byte table turns a piece into characters, and the library merges those.
    Pieces repeat as words do, so the ids of short ones are kept, as 32-bit integers in bytes, in a table of at most
    ``KEPT`` bytes, which is emptied when it is full.
    """

    KEPT, SHORT, ENTRY = 24_000_000, 40, 170  # ENTRY: bytes of an entry besides its ids

    def __init__(self, path: str, pattern: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import regex
        from tokenizers import Tokenizer
        from tokenizers.models import BPE

        ranks, chars = read_ranks(path), byte_chars()
        shown = {token: "".join(chars[b] for b in token) for token in ranks}
        merges = []
        for token, rank in ranks.items():
            for cut in range(1, len(token)):
                left, right = token[:cut], token[cut:]
                if left in ranks and right in ranks:
                    merges.append((rank, ranks[left], ranks[right], shown[left], shown[right]))
        merges.sort()
        self.tokenizer = Tokenizer(BPE({shown[t]: r for t, r in ranks.items()}, [m[3:] for m in merges], ignore_merges=True))
        self.to_chars = {byte: char for byte, char in enumerate(chars)}
        back = {char: byte for byte, char in enumerate(chars)}
        self.table = {i: bytes(map(back.__getitem__, self.tokenizer.id_to_token(i))) for i in ranks.values()}
        self.names = {i: str(i) for i in self.table}
        self.cut = regex.compile(pattern).findall
        self.known: dict[str, bytes] = {}
        self.size = 0

    def _learn(self, pieces: list[str]) -> dict[str, bytes]:
        """Ids of pieces, merged by the library in one call."""
        mapped = [p.encode().decode("latin-1").translate(self.to_chars) for p in pieces]
        found = self.tokenizer.encode(mapped, is_pretokenized=True, add_special_tokens=False)
        ids = np.array(found.ids, np.int32).tobytes()
        ends = (4 * np.cumsum(np.bincount(np.asarray(found.word_ids, int), minlength=len(pieces)))).tolist()
        return {p: ids[start:end] for p, start, end in zip(pieces, [0, *ends], ends)}

    def encode_batch(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as 32-bit integers in bytes."""
        if self.size > self.KEPT:
            self.known, self.size = {}, 0
        cut = [self.cut(t) for t in texts]
        found = [list(map(self.known.get, pieces)) for pieces in cut]
        new = {p for pieces, ids in zip(cut, found, strict=True) if None in ids for p, x in zip(pieces, ids, strict=True) if x is None}
        learnt = self._learn(list(new)) if new else {}
        for pieces, ids in zip(cut, found, strict=True):
            if None in ids:
                ids[:] = [learnt[p] if x is None else x for p, x in zip(pieces, ids, strict=True)]
        short = {p: x for p, x in learnt.items() if len(p) <= self.SHORT}
        self.known.update(short)
        self.size += sum(map(len, short.values())) + self.ENTRY * len(short)
        return [b"".join(ids) for ids in found]

    def offsets(self, text: str, ids: list[int]) -> list[list[int]]:
        """Code points [start, end) of each token; a token inside a character spans the whole of it."""
        raw = np.frombuffer(text.encode(), np.uint8)
        starts = (raw & 0xC0) != 0x80
        nth = np.concatenate([np.cumsum(starts) - 1, [starts.sum()]])
        ends = np.cumsum([len(self.table[i]) for i in ids]).astype(int)
        begins = np.concatenate([[0], ends[:-1]]).astype(int) if len(ids) else ends
        return np.stack([nth[begins], nth[ends - 1] + 1], 1).tolist() if len(ids) else []


@functools.cache
def codec(path: str, pattern: str) -> Codec:
    return Codec(path, pattern)


def encode(df: DataFrame, path: str, pattern: str, text: str = "text", offsets: bool = False) -> DataFrame:
    """Adds ``ids`` (array<int>) and, if asked, ``offsets`` (array of [start, end) code points, a token inside a
    character spanning it). Null text counts as empty and gives empty arrays; other columns stay as they are, and an
    existing ``ids`` or ``offsets`` column is replaced."""
    names = ["ids", *["offsets"] * offsets]
    rest = [c for c in df.columns if c not in names]
    kinds = "ids array<int>" + ", offsets array<array<int>>" * offsets

    def run(batches):
        own = codec(path, pattern)
        for batch in small_batches(batches, 128):
            texts = [t or "" for t in batch.column(text).to_pylist()]
            found = own.encode_batch(texts)
            out = {c: batch.column(c) for c in rest}
            ends = np.cumsum([0, *(len(x) // 4 for x in found)]).astype(np.int32)
            out["ids"] = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(found), np.int32)))
            if offsets:
                out["offsets"] = pa.array([own.offsets(t, np.frombuffer(x, np.int32).tolist()) for t, x in zip(texts, found, strict=True)], pa.list_(pa.list_(pa.int32())))
            yield pa.RecordBatch.from_pydict(out)

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.select(*rest).schema.fields)
    return df.select(*dict.fromkeys([*rest, text])).mapInArrow(run, f"{schema}, {kinds}" if rest else kinds)


def decode(df: DataFrame, path: str, pattern: str, ids: str = "ids", to: str = "decoded") -> DataFrame:
    """Adds the decoded bytes of ``ids`` as binary; null ids give null. An unknown id fails the task."""
    rest = [c for c in df.columns if c != to]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.select(*rest).schema.fields)

    def run(batches):
        table = codec(path, pattern).table
        for batch in small_batches(batches, 128):
            raw = [None if x is None else b"".join(map(table.__getitem__, x)) for x in batch.column(ids).to_pylist()]
            yield pa.RecordBatch.from_pydict({**{c: batch.column(c) for c in rest}, to: pa.array(raw, pa.binary())})

    return df.select(*rest).mapInArrow(run, f"{schema}, `{to}` binary")


def encode_digest(df: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256: ids and bytes are digested where they are made, so that no
    batch of token arrays is passed between Python and the JVM. Null text counts as empty."""

    def run(batches):
        own = codec(path, pattern)
        for batch in small_batches(batches, 128):
            n, first, second = [], [], []
            for raw in own.encode_batch([t or "" for t in batch.column("text").to_pylist()]):
                ids = np.frombuffer(raw, np.int32).tolist()
                n.append(len(ids))
                first.append(hashlib.sha256(",".join(map(own.names.__getitem__, ids)).encode()).hexdigest())
                second.append(hashlib.sha256(b"".join(map(own.table.__getitem__, ids))).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(first, pa.string()), pa.array(second, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return df.select("doc_id", "text").mapInArrow(run, f"doc_id {df.schema['doc_id'].dataType.simpleString()}, n_tokens bigint, ids_sha256 string, decoded_sha256 string")
