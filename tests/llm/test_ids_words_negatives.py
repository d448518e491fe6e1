"""Token-id files, spelling variants and hard negatives by the library, by deletions of letters and by plain loops."""

import math
import random
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from weftline.llm import negatives, queries, spelling, tokenids

PATH = public_tokenizers.path("word_bpe_49k.json")
DOCS = "doc_id bigint, text string, id string, n bigint, part string, k0 string, word string"
ODD = ["", None, " \n\t", "Hello, World's 12 éclair é ǅ İx", "a\u0085b c\x1cd e \u0000", "x" * 9000, "<|endoftext|> tail <|startoftext|>x", "it's 'S we'LL Kµßŉ", "\U0001f600́ ok", "ÀÖØß×÷ÿ", "the the the"]


def docs(spark, rows):
    return spark.createDataFrame([(i, t, "clash", 7, "clash", "clash", "clash") for i, t in rows], DOCS)


def test_pack_round_trip():
    r = np.random.default_rng(1)
    for n in (0, 1, 3, 4, 5, 1000):
        ranks = (2 ** r.uniform(0, 32, n)).astype(np.uint32)
        control, data = tokenids.pack(ranks)
        assert len(control) == -(-n // 4) and len(data) == sum(max(1, -(-int(x).bit_length() // 8)) for x in ranks.tolist())
        assert tokenids.unpack(control, data, n).tolist() == ranks.tolist()


def library(rows, end):
    t, at, out = Tokenizer.from_file(PATH), 0, []
    for i, text in rows:
        ids = t.encode(text or "", add_special_tokens=False).ids + [end]
        out.append((i, at, len(ids), ids))
        at += len(ids)
    return out


def test_words_are_the_library_s():
    r = random.Random(2)
    letters = "abcXYZ'019.,!-<|>_éÀß÷ \u0085́İK　\x1c\x00  \n\tſ你😀"
    texts = ["".join(r.choice(letters) for _ in range(r.randint(0, 60))) for _ in range(3000)] + [t or "" for t in ODD]
    own, lib = tokenids.Words(PATH), Tokenizer.from_file(PATH)
    for _ in range(2):  # the second time from the table
        got = [np.frombuffer(x, np.uint32).tolist() for x in own.encode([t.encode() for t in texts])]
        assert got == [e.ids for e in lib.encode_batch(texts, add_special_tokens=False)]
    assert own.short and not tokenids.Words(public_tokenizers.path("byte_bpe_50k.json")).short


def test_ids_of_files(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(tokenids, "FILE", 3000)
    monkeypatch.setattr(tokenids, "BLOCK", 500)
    r = random.Random(3)
    rows = list(enumerate([*ODD, *(" ".join(r.choice(["one", "Two", "tre9"]) for _ in range(r.randint(0, 400))) for _ in range(80))]))
    r.shuffle(rows)
    out = f"file://{tmp_path}/ids"
    tokenids.write(docs(spark, rows), out, PATH, 2)
    want = library(sorted(rows), 2)
    assert sorted((x.doc_id, x.start, x.n_tokens, x.ids) for x in tokenids.read(spark, out).collect()) == want
    got = {x.doc_id: x for x in tokenids.read(spark, out, digest=True).collect()}
    for i, start, n, ids in want:
        assert (got[i].start, got[i].n_tokens, got[i].ids_crc32) == (start, n, zlib.crc32(np.array(ids, "<u4").tobytes()))
    blocks = spark.read.parquet(out).orderBy("part", "nth").collect()
    assert len({b.part for b in blocks}) > 2 and [i for b in blocks for i in b.doc_ids] == sorted(i for i, _ in rows)
    of = {i: ids for i, _, _, ids in want}
    for b in blocks:
        often = Counter(i for d in b.doc_ids for i in of[d])
        assert np.frombuffer(b.ranks, "<u4").tolist() == sorted(often, key=lambda i: (-often[i], i))


def test_ids_of_nulls_repeats_and_nothing(spark, monkeypatch):
    rows = [(None, "b"), (None, None), (5, "a"), (5, "a"), (5, "c d"), (1, "")]
    got = sorted(tokenids.write_and_read(docs(spark, rows), PATH, 2).collect(), key=lambda x: x.start)
    assert [x.doc_id for x in got] == [None, None, 1, 5, 5, 5]
    assert [x.start for x in got] == np.cumsum([0, *(x.n_tokens for x in got)])[:-1].tolist()
    assert sorted(x.n_tokens for x in got) == sorted(n for _, _, n, _ in library(rows, 2))
    none = tokenids.write_and_read(docs(spark, []), PATH, 2)
    assert none.count() == 0 and none.columns == ["doc_id", "start", "n_tokens", "ids_crc32"]
    monkeypatch.setattr(tokenids, "FILE", 100)  # one row many times over takes several files
    same = tokenids.write_and_read(docs(spark, [(1, "same text")] * 400), PATH, 2).collect()
    assert sorted(x.start for x in same) == list(range(0, 1200, 3)) and len({x.ids_crc32 for x in same}) == 1


def is_near(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    short, long = sorted((a, b), key=len)
    return any(long[:i] + long[i + 1 :] == short for i in range(len(long)))


def brute_variants(rows):
    c = Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = re.sub("[A-Z]", lambda m: m.group().lower(), run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            c[run[: h % len(run)] + run[h % len(run) + 1 :] if h % 31 == 0 else run] += 1
    c = {w: n for w, n in c.items() if len(w) >= 7 and n >= 2}
    near = {w: [v for v in c if is_near(w, v)] for w in c}
    form = {w: min(near[w], key=lambda v: (-c[v], v)) for w in c if near[w]}
    form = {w: v for w, v in form.items() if c[v] >= 10 * c[w]}

    def root(w):
        while w in form:
            w = form[w]
        return w

    return sorted((w, form.get(w), root(w), n, len(near[w]), c[form[w]] if w in form else None) for w, n in c.items())


@pytest.mark.parametrize(("few", "part", "bins"), [(64, 40_000, 20_000), (2, 5, 30)])
def test_spelling(spark, monkeypatch, few, part, bins):
    for name, value in (("FEW", few), ("PART", part), ("BIN", bins), ("KEPT", 50)):
        monkeypatch.setattr(spelling, name, value)
    r, rows = random.Random(4), []
    letters = "abé÷"
    base = ["constant" + "".join(r.choice(letters) for _ in range(r.randint(0, 4))) for _ in range(20)] + ["".join(r.choice(letters) for _ in range(r.randint(6, 9))) for _ in range(60)]
    for i in range(300):
        w = r.choice(base)
        k = r.randrange(len(w))
        w = r.choice([w, w, w, w[:k] + w[k + 1 :], w[:k] + r.choice(letters) + w[k:], w[:k] + r.choice(letters) + w[k + 1 :]])
        rows.append((i % 90, " ".join([w.upper() if i % 5 == 0 else w] * r.choice([1, 2, 30]))))
    # a chain of three steps, ties, a run longer than any word, and what has no words
    rows += [(210 + i, t) for i, t in enumerate(["abcdefgh " * 3, "abcdefgx " * 40, "abcdefyx " * 500, "abcdezyx " * 6000, "z" * 3000 + " " + "z" * 3000, "z" * 2999 + " " + "z" * 2999, "", None, "short x", "ÀÉÎõü÷× " * 4])]
    rows += [rows[0], rows[0], (None, "nameless nameless")]
    got = spelling.variants(docs(spark, rows)).collect()
    want = brute_variants(rows)
    assert sorted(map(tuple, got)) == want and any(w[1] and w[2] != w[1] for w in want)


def test_spelling_of_nothing(spark):
    assert spelling.variants(docs(spark, [])).count() == 0
    assert spelling.variants(docs(spark, [(1, None), (2, "a b"), (3, "oneword")])).count() == 0


def test_index_by_branches(monkeypatch):
    for seed in range(12):
        r = random.Random(seed)
        letters = ["ab", "abcdé", "abcdefghijklmnopqrstuvwxyzàé÷"][seed % 3]
        words = list({"".join(r.choice(letters) for _ in range(r.randint(7, 9))) for _ in range(150)})
        words = list({*words, *(w[:3] + r.choice(letters) + w[4:] for w in words), *(w + r.choice(letters) for w in words)})
        for few in (0, 3, 64):
            monkeypatch.setattr(spelling, "FEW", few)
            found = []
            for first in (True, False):
                index = spelling.Index(words if first else [w[::-1] for w in words])
                middle = np.array([len(w) // 2 if first else len(w) - len(w) // 2 for w in words])
                found += map(tuple, index.near(np.arange(len(words)), middle).tolist())
            assert set(found) == {(i, j) for i, a in enumerate(words) for j, b in enumerate(words) if is_near(a, b)}


VECS = "vec_id bigint, embedding array<float>, label int, score string, id string, slot string"


def brute_negatives(rows):
    own = {}
    for i, v, label in rows:
        if i is not None and v is not None and label is not None and all(x is not None and math.isfinite(x) for x in v):
            own.setdefault(i, []).append(((label + 1) % 10 if i % 7 == 0 else label, v))
    own = {i: min(x) for i, x in own.items()}
    q = {i: [math.floor(256 * float(np.float32(x))) for x in v] for i, (_, v) in own.items()}
    out = []
    for a in own:
        if a % 100:
            continue
        s = {b: sum(x * y for x, y in zip(q[a], q[b], strict=False)) for b in own if b != a}
        for p in sorted((b for b in s if own[b][0] == own[a][0]), key=lambda b: (-s[b], b))[:5]:
            fits = sorted((b for b in s if own[b][0] != own[a][0] and 30 * s[p] <= 100 * s[b] <= 90 * s[p]), key=lambda b: (-s[b], b))
            out += [(a, p, nth, b, s[p], s[b]) for nth, b in enumerate(fits[:10], 1)]
    return sorted(out)


def vectors(spark, rows):
    return spark.createDataFrame([(*r, "clash", "clash", "clash") for r in rows], VECS)


@pytest.mark.parametrize(("block", "anchors", "tile"), [(16_384, 2_048, 64), (60, 2, 1)])
def test_negatives(spark, monkeypatch, block, anchors, tile):
    for name, value in (("ROWS", block), ("ANCHORS", anchors), ("TILE", tile)):
        monkeypatch.setattr(negatives, name, value)
    r = np.random.default_rng(6)
    centre = r.normal(size=6)
    made = (centre + r.normal(size=(600, 6)) * 0.7).round(1)  # many ties
    rows = [(i, v.tolist(), int(r.integers(0, 3))) for i, v in enumerate(made)]
    rows += [(1000 + i, [0.5] * 6, 1) for i in range(120)]  # equal vectors
    rows += [(2000, None, 1), (2100, [0.0] * 6, 1), (2200, [1.0, None, 1.0, 1.0, 1.0, 1.0], 1), (2300, [float("nan")] * 6, 1), (2400, [float("inf")] * 6, 0), (2500, [1.0] * 6, None), (None, [1.0] * 6, 1), (2600, [-1.0] * 6, 2), (2700, [], 0), (2800, [2.0, 1.0], 0), (2900, [1.0] * 6, 9), (-100, [0.3] * 6, 1), rows[0], rows[1], (3, [9.0] * 6, 0), (100, [0.1] * 6, 2)]
    got = sorted(map(tuple, negatives.mine_embeddings(vectors(spark, rows)).collect()))
    assert got == brute_negatives(rows) and len(got) > 100


def test_negatives_of_huge_and_of_no_vectors(spark):
    rows = [(100, [6e5, 1e5], 1), (101, [2e5, 1e5], 1), (102, [1e5, 1e5], 2), (103, [2e5, -1e5], 2), (104, [1e5, 1e5], 2)]
    assert sorted(map(tuple, negatives.mine_embeddings(vectors(spark, rows)).collect())) == brute_negatives(rows) != []
    huge = negatives.mine_embeddings(vectors(spark, [(100, [3e38], 1), (101, [3e38], 1), (102, [1.0], 2)])).collect()
    assert huge == []  # beyond 2^53: held there
    assert negatives.mine_embeddings(vectors(spark, [])).count() == 0
    assert negatives.mine_embeddings(vectors(spark, [(1, [1.0], 1)])).count() == 0


def test_negatives_match_sql(spark):
    sf = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.sql(f"CREATE VIEW embeddings AS SELECT * FROM '{sf}/embeddings.parquet'")
    got = queries.QUERIES["op13_slot_negatives"](spark, sf)
    want = con.sql(queries.ORACLE_SQL["op13_slot_negatives"])
    assert got.columns == want.columns and sorted(map(tuple, got.collect())) == sorted(want.fetchall())


def test_positives_need_another_row(spark):
    df = vectors(spark, [(0, [1.0], 1), (100, [1.0], 2), (200, [1.0], 2), (5, [0.5], 3)])
    got = negatives.mine(df, F.col("vec_id") % 100 == 0, F.col("label"))
    assert sorted((r.anchor_id, r.positive_id, r.negative_id) for r in got.collect()) == [(100, 200, 5), (200, 100, 5)]
