"""Language-model scoring by Brown class bigrams.

Words are counted over all training documents. Exchange clustering assigns the most frequent ones to classes, one word
at a time on their bigram counts. Then come all words counted at least ``FEW`` times, in rounds: each is taken out of
its class and put where it gains the most mutual information, by the classes of all its neighbours in all training
documents. Only rarer words share a class. A text's log10 probability is the sum of class transitions and of word
emissions. Frequent words are looked up in a broadcast table of bounded length; the counts and classes of rarer ones reach
the documents by a join.
"""

from __future__ import annotations

from collections import Counter
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.llm.common import as_bytes, doc_crc, small_batches, words_of, written

END = b"\n"  # no word holds white space
HEAD, SEEDS, CLASSES, FEW, ROUNDS, ALPHA = 131_072, 1000, 32, 2, 2, 0.1
BLOCK, HELD = 512, 1_000_000  # head words in a block, tokens that a task gathers before it counts them


def word_counts(texts: DataFrame, held: int = 150_000) -> DataFrame:
    """(word binary, n) over all rows of ``texts``; each text adds one END. Tasks pass on sums of at most ``held``
    words at a time."""

    def run(batches):
        found: Counter = Counter()
        for batch in small_batches(batches):
            for raw in as_bytes(batch.column("text")):
                found.update(words_of(raw))
            found[END] += batch.num_rows
            if len(found) > held:
                yield flushed(found)
                found = Counter()
        yield flushed(found)

    def flushed(found):
        return pa.RecordBatch.from_arrays([pa.array(list(found.keys()), pa.binary()), pa.array(list(found.values()), pa.int64())], ["word", "n"])

    return texts.select("text").mapInArrow(run, "word binary, n bigint").groupBy("word").agg(F.sum("n").alias("n")).where("n > 0")


def frequent_words(counts: DataFrame, most: int) -> tuple[list[bytes], np.ndarray, int]:
    """The words of every count that still fits into ``most`` words, most frequent first, and the smallest such count
    (rarer words go by a join). Only the number of words of each count is gathered before."""
    by_count = counts.where(F.col("word") != F.lit(END)).groupBy("n").count().orderBy(F.desc("n")).limit(most).collect()
    total, least = 0, None
    for r in by_count:
        if (total := total + r["count"]) > most:
            break
        least = r["n"]
    if least is None:
        return [], np.array([], np.int64), 1 << 62
    rows = counts.where((F.col("n") >= least) & (F.col("word") != F.lit(END))).toArrow().sort_by([("n", "descending"), ("word", "ascending")])
    return rows.column("word").to_pylist(), rows.column("n").to_numpy(), least


def bigram_counts(texts: DataFrame, words: list[bytes]) -> np.ndarray:
    """Counts of neighbours among ``words``, then all others as one, then the end (also before the first word)."""
    spark, size = texts.sparkSession, len(words) + 2
    shared = spark.sparkContext.broadcast({w: i for i, w in enumerate(words)})

    def run(batches):
        get, total = shared.value.get, np.zeros(size * size, np.int64)
        for batch in small_batches(batches):
            ids = [size - 1]
            for raw in as_bytes(batch.column("text")):
                ids.extend(map(get, words_of(raw), repeat(size - 2)))
                ids.append(size - 1)
            at = np.array(ids, np.int64)
            total += np.bincount(at[:-1] * size + at[1:], minlength=size * size)
        keys = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(total[keys], pa.int64())], ["pair", "n"])

    rows = texts.select("text").mapInArrow(run, "pair bigint, n bigint").groupBy("pair").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(size * size)
    out[rows.column("pair").to_numpy()] = rows.column("n").to_numpy()
    return out.reshape(size, size)


def xlogx(x):
    return x * np.log(np.maximum(x, 1e-300))


def gains(between: np.ndarray, own: np.ndarray, after: np.ndarray, before: np.ndarray, itself: np.ndarray) -> np.ndarray:
    """Mutual information that each class gains by each of some words once it has left its class ``own``.

    ``between``: counts of class pairs. A row of ``after`` and ``before`` counts the classes that stand after and before
    a word in other words, ``itself`` how often it follows itself. Only non-zero counts are looked at.
    """
    n, k = after.shape
    rows = np.arange(n)
    left, right = np.tile(between.sum(1), (n, 1)), np.tile(between.sum(0), (n, 1))
    nl, nr = after.sum(1) + itself, before.sum(1) + itself
    left[rows, own] -= nl
    right[rows, own] -= nr
    gain = xlogx(left) - xlogx(left + nl[:, None]) + xlogx(right) - xlogx(right + nr[:, None])
    for counts, other, table in ((after, before, between.T), (before, after, between)):
        w, c = np.nonzero(counts)
        a = counts[w, c]
        cells = table[c].copy()  # a cell for each class and the neighbour's class c, without the word
        cells[np.arange(len(w)), own[w]] -= a
        same = np.flatnonzero(c == own[w])
        cells[same] -= other[w[same]]
        cells[same, own[w[same]]] -= itself[w[same]]
        add = xlogx(cells + a[:, None]) - xlogx(cells)
        add[np.arange(len(w)), c] = 0  # pairs within a class come below, once
        np.add.at(gain, w, add)
    within = np.tile(np.diag(between), (n, 1))
    within[rows, own] -= after[rows, own] + before[rows, own] + itself
    return gain + xlogx(within + after + before + itself[:, None]) - xlogx(within)


def information(between: np.ndarray) -> float:
    return float(xlogx(between).sum() - xlogx(between.sum(1)).sum() - xlogx(between.sum(0)).sum() + xlogx(between.sum()))


def exchange(pairs: np.ndarray, classes: int) -> np.ndarray:
    """Class of each row of ``pairs``: words move, one at a time, to the class that gains the most mutual information,
    until a sweep moves none. The last two rows (other words, the end) keep classes of their own."""
    n = len(pairs) - 2
    k = min(classes, max(n, 1)) + 2
    of = np.concatenate([np.arange(n) % (k - 2), [k - 2, k - 1]])
    onehot = np.eye(k)[of]
    between = onehot.T @ pairs @ onehot
    least = 1e-9 * max(pairs.sum(), 1.0)  # what rounding alone can gain
    moved = n
    while moved:
        moved = 0
        for w in range(n):
            own = of[w]
            onehot[w, own] = 0
            after, before, itself = pairs[w] @ onehot, pairs[:, w] @ onehot, pairs[w, w]
            gain = gains(between, of[w : w + 1], after[None], before[None], np.array([itself]))[0, : k - 2]
            best = int(np.argmax(gain))
            if gain[best] > gain[own] + least:
                moved += 1
                of[w] = best
                for c, sign in ((own, -1), (best, 1)):
                    between[c] += sign * after
                    between[:, c] += sign * before
                    between[c, c] += sign * itself
            onehot[w, of[w]] = 1
    return of


def head_profiles(texts: DataFrame, words: list[bytes], of: np.ndarray) -> DataFrame:
    """(block, at, n): of each block of ``BLOCK`` words, several rows a block, how often each class stands after a word
    (column c), before it (column k + c), and how often it follows itself (column 2k): places in the block's table
    and counts there, one or eight bytes each. Block -1 has the counts of all class pairs."""
    k = int(of[-1]) + 1
    width = 2 * k + 1
    shared = texts.sparkSession.sparkContext.broadcast((words, np.concatenate([of[:-2], of[-1:], of[-2:-1]])))

    def run(batches):
        words, of = shared.value  # the last but one: the end, -2; the last: other words, -1
        get = {w: i for i, w in enumerate(words)}.get
        table, between = np.zeros(len(words) * width, np.int32), np.zeros(k * k, np.int64)
        held, size = [np.array([-2])], 0

        def count():
            ids = np.concatenate(held)
            classes = of[ids]
            a, b, ca, cb = ids[:-1], ids[1:], classes[:-1], classes[1:]
            between[:] += np.bincount(ca * k + cb, minlength=k * k)
            for keys in ((a * width + cb)[a >= 0], (b * width + k + ca)[b >= 0], (a * width + 2 * k)[(a == b) & (a >= 0)]):
                np.add.at(table, keys, 1)

        for batch in small_batches(batches):
            for raw in as_bytes(batch.column("text")):
                tokens = words_of(raw)
                held.append(np.fromiter(map(get, tokens, repeat(-1)), np.int64, len(tokens)))
                held.append(held[0])
                size += len(tokens) + 1
            if size > HELD:
                count()
                held, size = held[:1], 0
        count()
        out = [(-1, b"", between.tobytes())]
        for block in range(0, -(-len(words) // BLOCK)):
            part = table[block * BLOCK * width : (block + 1) * BLOCK * width]
            at = np.flatnonzero(part)
            if len(at):
                n = part[at]
                out.append((block, at.astype(np.uint16).tobytes(), n.astype(np.uint8 if n.max() < 256 else np.int64).tobytes()))
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int32(), pa.binary(), pa.binary()), strict=True)], ["block", "at", "n"])

    return texts.select("text").mapInArrow(run, "block int, at binary, n binary")


def pair_counts(profile: DataFrame, k: int) -> np.ndarray:
    """The counts of all class pairs: added up within each task, then over tasks."""

    def run(batches):
        total = np.zeros(k * k, np.int64)
        for batch in batches:
            for raw in batch.column("n").to_pylist():
                total += np.frombuffer(raw, np.int64)
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["n"])

    rows = profile.where("block = -1").select("n").mapInArrow(run, "n binary").toArrow().column("n").to_pylist()
    return np.sum([np.frombuffer(r, np.int64) for r in rows], 0).reshape(k, k).astype(float) if rows else np.zeros((k, k))


def moved(profile: DataFrame, of: np.ndarray, between: np.ndarray) -> np.ndarray:
    """``of`` with each word of ``profile`` in the class that gains the most, where all others stay as they are. A task
    adds up the blocks that it gets; no more than a class a word comes to the driver."""
    k = len(between)
    width = 2 * k + 1
    shared = profile.sparkSession.sparkContext.broadcast((of[:-2], between))

    def run(batches):
        of, between = shared.value
        tables: dict[int, np.ndarray] = {}
        for batch in batches:
            for block, at, n in zip(*(batch.column(c).to_pylist() for c in ("block", "at", "n")), strict=True):
                table = tables.setdefault(block, np.zeros(BLOCK * width))
                where = np.frombuffer(at, np.uint16)
                table[where] += np.frombuffer(n, np.uint8 if len(n) == len(where) else np.int64)
        found = []
        for block, table in tables.items():
            own = of[block * BLOCK : (block + 1) * BLOCK]
            seen, rows = table.reshape(BLOCK, width)[: len(own)], np.arange(len(own))
            after, before, itself = seen[:, :k].copy(), seen[:, k : 2 * k].copy(), seen[:, 2 * k]
            after[rows, own] -= itself
            before[rows, own] -= itself
            found.append(gains(between, own, after, before, itself)[:, : k - 2].argmax(1).astype(np.int8).tobytes())
        yield pa.RecordBatch.from_arrays([pa.array(list(tables), pa.int32()), pa.array(found, pa.binary())], ["block", "classes"])

    out = of.copy()
    rows = profile.where("block >= 0").repartition("block").mapInArrow(run, "block int, classes binary").toArrow()
    for block, classes in zip(rows.column("block").to_pylist(), rows.column("classes").to_pylist(), strict=True):
        out[block * BLOCK : block * BLOCK + len(classes)] = np.frombuffer(classes, np.int8)
    return out


def head_classes(train: DataFrame, words: list[bytes], n: np.ndarray) -> np.ndarray:
    """Classes of ``words`` (counted ``n`` times, most frequent first), of other words and of the end."""
    m = min(SEEDS, len(words))
    seeds = exchange(bigram_counts(train, words[:m]), CLASSES)
    k = int(seeds[-1]) + 1
    of = np.concatenate([seeds[:m], np.full(len(words) - m, k - 2), [k - 2, k - 1]])
    often = int((n >= FEW).sum())
    of[often:-2] = k - 2
    for _ in range(ROUNDS):
        part = np.append(of[:often], of[-2:])
        profile = written(head_profiles(train, words[:often], part), "head-profiles")
        of[:often] = moved(profile, part, pair_counts(profile, k))[:often]
    return of


def classed(rows: DataFrame, head: tuple, k: int, keep: list[str]) -> DataFrame:
    """``keep`` of ``rows`` (text): how many tokens are in ``head`` and the sums of their base and emission logs
    (known, base, log_p), the class of each token in order (classes; -1 outside the head), and of each token outside the
    head its word (rare), place and the classes on both sides (codes: k * class before + class after)."""
    shared = rows.sparkSession.sparkContext.broadcast(head)
    schema = rows.select(*keep).schema

    def run(batches):
        words, emit, base, classes = shared.value
        get = {w: i for i, w in enumerate(words)}.get
        for batch in small_batches(batches):
            texts = [words_of(raw) for raw in as_bytes(batch.column("text"))]
            ends = np.cumsum([0, *map(len, texts)])
            tokens = list(chain.from_iterable(texts))
            row = np.repeat(np.arange(len(texts)), np.diff(ends))
            at = np.fromiter(map(get, tokens, repeat(-1)), np.int64, len(tokens))
            own = classes[at]
            rare = np.flatnonzero(at < 0)
            seen = np.where(own < 0, k - 2, own)
            before, after = np.append(k - 1, seen[:-1])[: len(seen)], np.append(seen[1:], k - 1)[: len(seen)]
            before[ends[:-1][np.diff(ends) > 0]] = after[ends[1:][np.diff(ends) > 0] - 1] = k - 1
            total = lambda x, row=row, n=len(texts): np.bincount(row, x, n).astype(float)  # noqa: E731 -- of nothing it is whole numbers
            raw = own.astype(np.int8).tobytes()
            lists = pa.array(np.searchsorted(rare, ends).astype(np.int32))
            cols = [pa.array(total(at >= 0).astype(np.int64)), pa.array(total(base[at])), pa.array(total(emit[at])), pa.array([raw[a:b] for a, b in zip(ends[:-1], ends[1:], strict=True)], pa.binary())]
            cols += [pa.ListArray.from_arrays(lists, x) for x in (pa.array([tokens[i] for i in rare.tolist()], pa.binary()), pa.array((rare - ends[row[rare]]).astype(np.int32)), pa.array((before * k + after)[rare].astype(np.int32)))]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), *cols], [*keep, "known", "base", "log_p", "classes", "rare", "places", "codes"])

    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in schema)
    return rows.mapInArrow(run, f"{fields}, known bigint, base double, log_p double, classes binary, rare array<binary>, places array<int>, codes array<int>")


def bounded(raw: bytes, k: int) -> np.ndarray:
    """Classes of a text's tokens between two ends; those not known yet are other words."""
    own = np.full(len(raw) + 2, k - 1)
    own[1:-1] = np.frombuffer(raw, np.int8)
    own[own < 0] = k - 2
    return own


def class_pairs(texts: DataFrame, k: int) -> np.ndarray:
    """How often each class follows each other one in ``texts`` (classes)."""

    def run(batches):
        seen = np.zeros(k * k, np.int64)
        for batch in small_batches(batches):
            for raw in batch.column("classes").to_pylist():
                own = bounded(raw, k)
                seen += np.bincount(own[:-1] * k + own[1:], minlength=k * k)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(k * k), pa.int32()), pa.array(seen, pa.int64())], ["pair", "n"])

    out = np.zeros(k * k)
    for r in texts.select("classes").mapInArrow(run, "pair int, n bigint").groupBy("pair").agg(F.sum("n").alias("n")).collect():
        out[r["pair"]] = r["n"]
    return out.reshape(k, k)


def tail_classes(train: DataFrame, between: np.ndarray) -> DataFrame:
    """(word, n, class) of each word outside the head in ``train`` (rare, codes): its count, and the class that gains the
    most by its neighbours, that of other words if it is counted less than ``FEW`` times. Such a word is rarer than
    every one in the head, so no word holds many rows; its neighbours are summed to at most k * k numbers."""
    k = len(between)
    shared = train.sparkSession.sparkContext.broadcast(between)
    seen = train.select(F.explode(F.arrays_zip("rare", "codes")).alias("t")).select(F.col("t.rare").alias("word"), F.col("t.codes").alias("code"))
    seen = seen.repartition("word").groupBy("word", "code").agg(F.count("*").alias("n"))
    seen = seen.groupBy("word").agg(F.sum("n").alias("n"), F.collect_list(F.struct("code", "n")).alias("sides"))

    def run(batches):
        for batch in small_batches(batches, 4096):
            sides = batch.column("sides")
            n, flat = batch.column("n").to_numpy(), sides.flatten()
            word = np.repeat(np.arange(batch.num_rows), np.diff(sides.offsets.to_numpy()))
            code, times = flat.field("code").to_numpy(), flat.field("n").to_numpy()
            after = np.bincount(word * k + code % k, times, batch.num_rows * k).reshape(-1, k)
            before = np.bincount(word * k + code // k, times, batch.num_rows * k).reshape(-1, k)
            gain = gains(shared.value, np.full(batch.num_rows, k - 2), after, before, np.zeros(batch.num_rows))
            classes = np.where(n < FEW, k - 2, gain[:, : k - 2].argmax(1))
            yield pa.RecordBatch.from_arrays([batch.column("word"), batch.column("n"), pa.array(classes, pa.int32())], ["word", "n", "class"])

    return seen.mapInArrow(run, "word binary, n bigint, class int")


def score(docs: DataFrame) -> DataFrame:
    """Scores every row of ``docs`` (doc_id, text, held_out) by a model of those not held out: doc_id, held_out,
    n_tokens, n_known, train_tokens, base_score, score and perplexity (10 ** (-score / n_tokens)).

    Null text is empty and has one token, the end. Without training rows nothing is known and every token has the
    same probability. Rows are told apart by their place, so repeated rows and null ids are scored one by one; other
    columns of ``docs`` are not read.
    """
    train = docs.where(~F.col("held_out"))
    counts = written(word_counts(train), "word-counts")
    total, kinds = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    ends = int(counts.where(F.col("word") == F.lit(END)).agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0])
    words, n, _ = frequent_words(counts, HEAD)
    of = head_classes(train, words, n)
    k, c = int(of[-1]) + 1, of[:-2]
    base_of = float(total + kinds + 1)
    base, end_base = np.append(np.log10((n + 1) / base_of), 0.0), float(np.log10((ends + 1) / base_of))
    head = (words, np.append(np.log10(n + (c == k - 2)), 0.0), base, np.append(c, -1))
    rows = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", "held_out", "text")
    scored = written(classed(rows, head, k, ["row", "doc_id", "held_out"]), "scored")
    seen = scored.where(~F.col("held_out"))
    tail = written(tail_classes(seen, class_pairs(seen, k)), "tail-classes")
    size = np.bincount(c, n, k) + np.bincount(c, minlength=k) * (np.arange(k) == k - 2)
    for r in tail.groupBy("class").agg(F.sum("n").alias("n"), F.count("*").alias("kinds")).collect():
        size[r["class"]] += r["n"] + r["kinds"] * (r["class"] == k - 2)
    size[k - 2] += 1  # other words count one more each, and one is left to unknown ones
    class_size = np.log10(np.maximum(size, 1))[: k - 1]

    ends_known = ends > 0
    found = scored.select("row", F.explode(F.arrays_zip("rare", "places")).alias("t")).select("row", F.col("t.rare").alias("word"), F.col("t.places").alias("place"))
    found = found.join(tail, "word", "left").groupBy("row").agg(F.collect_list(F.struct("place", "n", "class")).alias("found"))

    def fill(batches):
        names = ["doc_id", "held_out", "n_tokens", "n_known", "base", "log_p", "classes"]
        for batch in small_batches(batches):
            rows, raws, found = batch.num_rows, batch.column("classes").to_pylist(), batch.column("found")
            ends = np.cumsum([0, *map(len, raws)])
            own = np.frombuffer(b"".join(raws), np.int8).astype(np.int64)
            flat, n_found = found.flatten(), np.asarray(found.value_lengths().fill_null(0))
            there = flat.field("class").fill_null(k - 2).to_numpy(zero_copy_only=False)
            times = flat.field("n").fill_null(0).to_numpy(zero_copy_only=False)
            row = np.repeat(np.arange(rows), n_found)
            own[ends[row] + flat.field("place").to_numpy(zero_copy_only=False)] = there
            log_p = np.bincount(row, np.log10(np.maximum(times + (there == k - 2), 1)), rows) - np.bincount(np.repeat(np.arange(rows), np.diff(ends)), class_size[own], rows)
            cols = (np.diff(ends) + 1, batch.column("known").to_numpy() + np.bincount(row, times > 0, rows).astype(np.int64) + int(ends_known), batch.column("base").to_numpy() + np.bincount(row, np.log10((times + 1) / base_of), rows) + end_base, batch.column("log_p").to_numpy() + log_p)
            raw = own.astype(np.int8).tobytes()
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), *map(pa.array, cols), pa.array([raw[a:b] for a, b in zip(ends[:-1], ends[1:], strict=True)], pa.binary())], names)

    kind = docs.schema["doc_id"].dataType.simpleString()
    whole = scored.drop("rare", "places", "codes").join(found, "row", "left")
    whole = written(whole.mapInArrow(fill, f"doc_id {kind}, held_out boolean, n_tokens bigint, n_known bigint, base double, log_p double, classes binary"), "filled")

    step = class_pairs(whole.where(~F.col("held_out")), k) + ALPHA
    step = np.log10(step / step.sum(1, keepdims=True))

    def run(batches):
        names = ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score", "perplexity"]
        for batch in small_batches(batches):
            own = [bounded(raw, k) for raw in batch.column("classes").to_pylist()]
            log_p = batch.column("log_p").to_numpy() + np.array([step[x[:-1], x[1:]].sum() for x in own])
            size = np.array([len(x) - 1 for x in own])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), batch.column("n_tokens"), batch.column("n_known"), pa.array(np.full(len(own), total), pa.int64()), batch.column("base"), pa.array(log_p), pa.array(10.0 ** (-log_p / size))], names)

    return whole.mapInArrow(run, f"doc_id {kind}, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double, perplexity double")


def score_documents(docs: DataFrame) -> DataFrame:
    """All documents, by a model of those whose crc32(doc_id as text) mod 7 is not 2."""
    return score(docs.select("doc_id", "text", (doc_crc(F.col("doc_id")) % 7 == 2).alias("held_out")))
