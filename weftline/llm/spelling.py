"""Spelling variants of words: near words by a bidirectional FM-index, and the more frequent form each leads to.

The vocabulary is counted over all texts and written. One error leaves one half of a word as it is, so a word and its
near word agree in their first letters or in their last ones: words are dealt out by both, to bins of bounded size.
A bin's words, each between delimiters, are one text with a suffix array in both directions. A search matches half a
word exactly from its middle to its delimiter, which narrows the intervals of both directions together, turns, and
goes over the other half with one error: an interval's next letters are its branches, a branch that has spent its
error goes on exactly, and an interval of few suffixes is settled by comparing the words it stands for.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.llm.common import small_batches, written

LEAST, EVERY = 7, 31  # code points of a word; one in so many spellings of a document loses a letter
KEY = 3  # letters that words are dealt by: half of the shortest word
BIN, PART = 20_000, 40_000  # words of a bin, and of a key before it is split
KEPT = 200_000  # distinct words a task counts before it hands them on
FEW, CHECK = 64, 32  # suffixes that are compared as words, and letters between two counts of a rank


def occurrences(docs: DataFrame) -> DataFrame:
    """(word, n): how often each spelling of at least ``LEAST`` code points occurs in ``docs`` (doc_id, text), counted
    within tasks; a word may come more than once. A null id counts as the empty text, null text has no words."""
    run_of = re.compile(f"[a-zÀ-ÿ]{{{LEAST},}}").findall

    def run(batches):
        held: Counter = Counter()

        def out():
            return pa.RecordBatch.from_arrays([pa.array(held.keys(), pa.string()), pa.array(held.values(), pa.int64())], ["word", "n"])

        for batch in small_batches(batches, 128):
            for i, text in zip(batch.column("id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                head = zlib.crc32(f"{i}:".encode())
                for word, n in Counter(run_of(text.encode().lower().decode())).items():
                    h = zlib.crc32(word.encode(), head)
                    if h % EVERY == 0:
                        at = h % len(word)
                        word = word[:at] + word[at + 1 :]
                        if len(word) < LEAST:
                            continue
                    held[word] += n
            if len(held) > KEPT:
                yield out()
                held.clear()
        if held:
            yield out()

    rows = docs.where("text IS NOT NULL").select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("id"), "text")
    return rows.mapInArrow(run, "word string, n bigint")


class Direction:
    """The FM-index of words, sorted and between delimiters, in one direction of reading.

    Delimiters are the least letter; the last one of the text stands before the others, which follow the order of the words
    after them, so that stepping from a suffix to the one before it keeps the order at delimiters as well.
    """

    def __init__(self, words: list[str], letters: dict[str, int]):
        order = sorted(range(len(words)), key=words.__getitem__)
        joined = "".join(["\0" + words[i] for i in order]) + "\0"
        points = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
        table = np.zeros(max(map(ord, letters)) + 1, np.uint8)
        table[[ord(c) for c in letters]] = list(letters.values())
        self.text, n = table[points], len(points)
        self.n, self.sigma = n, len(letters)
        ends = np.flatnonzero(points == 0)
        self.starts = np.empty(len(words), np.int64)  # of each word's first letter, by its place in ``words``
        self.starts[order] = ends[:-1] + 1
        rank = self.text.astype(np.int64) + n
        rank[ends] = [*range(1, len(ends)), 0]
        step = 1
        while True:
            after = np.zeros(n, np.int64)
            after[: n - step] = rank[step:] + 1
            key = rank * (2 * n + 600) + after
            suffixes = np.argsort(key, kind="stable")
            rank = np.empty(n, np.int64)
            rank[suffixes] = np.cumsum(np.concatenate([[0], np.diff(key[suffixes]) != 0]))
            if rank[suffixes[-1]] == n - 1:
                break
            step *= 2
        self.suffixes = suffixes
        before = self.text[suffixes - 1]
        self.before = before
        self.keys = np.sort(before.astype(np.int64) * (n + 1) + np.arange(n))
        blocks = np.bincount(np.arange(n) // CHECK * self.sigma + before, minlength=(n // CHECK + 2) * self.sigma).reshape(-1, self.sigma)
        counts = np.cumsum(blocks, 0) - blocks  # of each letter before each block
        self.lower = np.cumsum(counts, 1) - counts  # of all lesser letters
        self.padded = np.concatenate([before, np.full(2 * CHECK, 255, np.uint8)])
        # The word that a suffix, one that starts with a delimiter, stands before.
        place = np.full(n, -1, np.int64)
        place[ends[:-1]] = order
        self.word = place[suffixes]

    def step(self, letter, at):
        """Where the suffixes that ``letter`` stands before begin, of those before ``at``."""
        return np.searchsorted(self.keys, letter * np.int64(self.n + 1) + at)

    def lesser(self, letter, at):
        """How many of the letters before the first ``at`` suffixes are less than ``letter``."""
        block = at // CHECK
        near = self.padded[block[:, None] * CHECK + np.arange(CHECK)]
        inside = (near < letter[:, None]) & (np.arange(CHECK) < (at % CHECK)[:, None])
        return self.lower[block, letter] + inside.sum(1)


class Index:
    """Both directions of a bin's distinct words: ``left`` narrows by the letter before, ``right`` by the one after.

    An interval is (low, high) of the suffixes that begin with what is matched, and (mirrored low) of the same in
    the reversed texts; both have one size.
    """

    def __init__(self, words: list[str]):
        self.words = words
        letters = {c: i for i, c in enumerate(["\0", *sorted(set("".join(words)))])}
        self.forward = Direction(words, letters)
        self.backward = Direction([w[::-1] for w in words], letters)
        self.lengths = np.array([len(w) for w in words])

    def half(self, query: np.ndarray, middle: np.ndarray):
        """(low, size) in the backward index of the first ``middle`` letters of each query after its delimiter, matched from
        the middle to the left in the forward index, while the mirrored interval is kept with it."""
        f = self.forward
        low, high, mirrored = np.zeros(len(query), np.int64), np.full(len(query), f.n), np.zeros(len(query), np.int64)
        for back in range(1, int(middle.max(initial=0)) + 2):
            on = np.flatnonzero(back <= middle + 1)  # at middle + 1 stands the delimiter
            letter = f.text[f.starts[query[on]] + middle[on] - back].astype(np.int64)
            mirrored[on] += f.lesser(letter, high[on]) - f.lesser(letter, low[on])
            low[on], high[on] = f.step(letter, low[on]), f.step(letter, high[on])
        return mirrored, high - low

    def branches(self, low: np.ndarray, size: np.ndarray):
        """(state, letter) of all letters that follow in each interval of the backward index, delimiters left out."""
        few = size <= 2 * self.backward.sigma
        rows = np.repeat(low[few] - (np.cumsum(size[few]) - size[few]), size[few]) + np.arange(size[few].sum())
        seen = np.unique(np.repeat(np.flatnonzero(few), size[few]) * 256 + self.backward.before[rows])
        many = np.flatnonzero(~few)
        every = np.repeat(many, self.backward.sigma) * 256 + np.tile(np.arange(self.backward.sigma), len(many))
        both = np.concatenate([seen, every])
        return (pair := both[both % 256 > 0]) // 256, pair % 256

    def near(self, query: np.ndarray, middle: np.ndarray) -> np.ndarray:
        """Rows (query, word) at one error, in the letters from ``middle`` on, each once."""
        f, b = self.forward, self.backward
        low, size = self.half(query, middle)
        exact = (query, middle.astype(np.int64), low, low + size)
        spent = tuple(np.zeros(0, np.int64) for _ in range(4))
        found = []
        while len(exact[0]) or len(spent[0]):
            # Few suffixes: compare the words they stand for.
            few = exact[3] - exact[2] <= FEW
            found.append(self.compared(*(x[few] for x in exact)))
            q, at, lo, hi = (x[~few] for x in exact)
            letter = f.text[f.starts[q] + at].astype(np.int64)
            state, other = self.branches(lo, hi - lo)
            other_lo, other_hi = b.step(other, lo[state]), b.step(other, hi[state])
            alive = other_hi > other_lo
            state, other, other_lo, other_hi = state[alive], other[alive], other_lo[alive], other_hi[alive]
            replaced = (other != letter[state]) & (letter[state] > 0)
            less = letter > 0
            made = [
                (q[state][replaced], at[state][replaced] + 1, other_lo[replaced], other_hi[replaced]),
                (q[state], at[state], other_lo, other_hi),  # a letter more
                (q[less], at[less] + 1, lo[less], hi[less]),  # a letter less
            ]
            go = letter > 0
            exact = (q[go], at[go] + 1, b.step(letter[go], lo[go]), b.step(letter[go], hi[go]))
            exact = tuple(x[exact[3] > exact[2]] for x in exact)
            # Those that have spent their error go on exactly, up to the delimiter that ends the word.
            q, at, lo, hi = (np.concatenate(x) for x in zip(spent, *made, strict=True))
            letter = f.text[f.starts[q] + at].astype(np.int64)
            lo, hi = b.step(letter, lo), b.step(letter, hi)
            whole, alive = (letter == 0) & (hi > lo), (letter > 0) & (hi > lo)
            found.append(np.stack([q[whole], b.word[lo[whole]]], 1))
            spent = (q[alive], at[alive] + 1, lo[alive], hi[alive])
        pairs = np.concatenate([np.zeros((0, 2), np.int64), *found])
        return np.unique(pairs[pairs[:, 0] != pairs[:, 1]], axis=0)

    def compared(self, query, at, low, high) -> np.ndarray:
        """Rows (query, word) of the words in small intervals that differ from the query by one error behind ``at``."""
        size = high - low
        rows = np.repeat(low - (np.cumsum(size) - size), size) + np.arange(size.sum())
        q, at = np.repeat(query, size), np.repeat(at, size)
        w = self.backward_word(rows, at)
        text, x, y = self.forward.text, self.forward.starts[q], self.forward.starts[w]
        more = self.lengths[w] - self.lengths[q]
        fits = np.flatnonzero((np.abs(more) <= 1) & (q != w))
        i, j = x[fits] + at[fits], y[fits] + at[fits]
        same = np.arange(len(fits))
        while len(same):  # to the first letter that differs; of distinct words one does before the end of both
            same = same[(text[i[same]] == text[j[same]]) & (text[i[same]] > 0)]
            i[same] += 1
            j[same] += 1
        i, j = i + (more[fits] <= 0), j + (more[fits] >= 0)
        alive = np.ones(len(fits), bool)
        same = np.arange(len(fits))
        while len(same):
            alive[same[text[i[same]] != text[j[same]]]] = False
            same = same[(text[i[same]] == text[j[same]]) & (text[i[same]] > 0)]
            i[same] += 1
            j[same] += 1
        return np.stack([q[fits][alive], w[fits][alive]], 1)

    def backward_word(self, rows, at):
        """The words of suffixes of the reversed texts that begin with the first ``at`` letters, reversed, and a delimiter."""
        if not hasattr(self, "suffix_word"):
            b = self.backward
            ends = np.flatnonzero(b.text == 0)
            owner = np.empty(len(ends), np.int64)
            owner[np.searchsorted(ends, b.starts - 1)] = np.arange(len(self.words))
            self.suffix_word = owner[np.searchsorted(ends, b.suffixes, "right") - 1]
        return self.suffix_word[rows]


def near_words(words: list[str], n: np.ndarray, indexed: np.ndarray, ask: np.ndarray, first: bool):
    """For each word of ``ask``: how many of the ``indexed`` words are near it by an error behind its first half (with ``first``),
    or before its second half and not behind its first; and the most frequent of them, ties to the least."""
    own = words if first else [w[::-1] for w in words]
    index = Index(own)
    length = np.array([len(w) for w in words])
    middle = length // 2 if first else length - length // 2
    pairs = index.near(ask, middle[ask])
    pairs = pairs[indexed[pairs[:, 1]]]
    if not first:
        twice = [words[b].startswith(words[a][: len(words[a]) // 2]) for a, b in pairs.tolist()]
        pairs = pairs[~np.array(twice, bool)]
    order = np.empty(len(words), np.int64)
    order[sorted(range(len(words)), key=words.__getitem__)] = np.arange(len(words))
    pairs = pairs[np.lexsort((order[pairs[:, 1]], -n[pairs[:, 1]], pairs[:, 0]))]
    heads = np.flatnonzero(np.diff(pairs[:, 0], prepend=-1))
    count, best = np.zeros(len(words), np.int64), np.full(len(words), -1, np.int64)
    count[pairs[heads, 0]] = np.diff(heads, append=len(pairs))
    best[pairs[heads, 0]] = pairs[heads, 1]
    return count[ask], best[ask]


def dealt(vocabulary: DataFrame, total: int) -> DataFrame:
    """(bin, first, word, n, indexed): each word under its first letters and under its last ones. The words of a key with more
    than ``PART`` are indexed in several bins and asked in each of them, so no bin grows with its key."""
    ends = F.array(F.struct(F.lit(True).alias("first"), F.substring("word", 1, KEY).alias("key")), F.struct(F.lit(False).alias("first"), F.right("word", F.lit(KEY)).alias("key")))
    keyed = vocabulary.withColumn("e", F.explode(ends)).select("word", "n", "e.first", "e.key")
    large = keyed.groupBy("first", "key").count().where(F.col("count") > PART).select("first", "key", F.ceil(F.col("count") / PART).cast("int").alias("parts"))
    parted = keyed.join(F.broadcast(large), ["first", "key"], "left").withColumn("parts", F.coalesce("parts", F.lit(1)))  # one row for PART words
    parted = parted.withColumns({"own": F.expr("pmod(xxhash64(word), parts)"), "part": F.explode(F.expr("sequence(0, parts - 1)"))})
    bins = max(1, -(-total // BIN))
    return parted.select(F.concat_ws(":", F.expr("int(first)"), F.expr(f"pmod(xxhash64(key, part), {bins})")).alias("bin"), "first", "word", "n", (F.col("own") == F.col("part")).alias("indexed"))


def searched(rows: DataFrame) -> DataFrame:
    """(word, n, near, best_n, best) of each word in each of its bins."""
    fields = pa.schema([("word", pa.string()), ("n", pa.int64()), ("near", pa.int64()), ("best_n", pa.int64()), ("best", pa.string())])

    def run(table: pa.Table) -> pa.Table:
        first = table.column("first")[0].as_py()
        table = table.group_by(["word", "n"]).aggregate([("indexed", "any")])  # several parts of a key may be in one bin
        words, n = table.column("word").to_pylist(), table.column("n").to_numpy()
        count, best = near_words(words, n, table.column("indexed_any").to_numpy(), np.arange(len(words)), first)
        none = best < 0
        return pa.table([pa.array(words), pa.array(n), pa.array(count), pa.array(n[best], mask=none), pa.array([None if b < 0 else words[b] for b in best.tolist()], pa.string())], schema=fields)

    return rows.groupBy("bin").applyInArrow(run, "word string, n bigint, near bigint, best_n bigint, best string")


def variants(docs: DataFrame, least: int = 2, times: int = 10) -> DataFrame:
    """word, form, root, n, n_near, form_n of every word of ``docs`` (doc_id, text) with ``least`` occurrences or more.

    Texts are taken whole; null texts and texts without words add nothing, no words give no rows. Repeated rows count
    again. Other columns are not read. Each step to a form multiplies n by ``times``, so the way to the root is as
    short as the logarithm of the largest n, and doubling joins follow it.
    """
    counted = occurrences(docs).groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least)
    vocabulary = written(counted, "vocabulary")
    total, most = vocabulary.agg(F.count("*"), F.coalesce(F.max("n"), F.lit(0))).first()
    found = searched(dealt(vocabulary, total)).groupBy("word", "n").agg(F.sum("near").alias("n_near"), F.min(F.when(F.col("best").isNotNull(), F.struct((-F.col("best_n")).alias("neg"), F.col("best").alias("form")))).alias("b"))
    form = F.col("b.neg") * -1 >= F.col("n") * times
    words = written(found.select("word", "n", "n_near", F.when(form, F.col("b.form")).alias("form"), F.when(form, -F.col("b.neg")).alias("form_n")), "variants")
    roots = words.where("form IS NOT NULL").select("word", F.col("form").alias("root"))
    reach, hops = 1, 0
    while most >= least * times ** (hops + 1):
        hops += 1
    while reach < hops:
        after = roots.select(F.col("word").alias("root"), F.col("root").alias("next"))
        roots = written(roots.join(after, "root", "left").select("word", F.coalesce("next", "root").alias("root")), "roots")
        reach *= 2
    return words.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
