"""Toxicity by class-conditional Kneser-Ney models of words, with spelling behind them.

Two models, of toxic and of ordinary text, count words by token, each in its own class, and discount the counts
absolutely. What they take off backs off to counts that both classes share: Kneser-Ney continuation counts, before how
many different words a word stands behind. A rare word is tilted there by its spelling, and a word that neither class knows
is read by its spelling alone: a second pair of models over n-grams of ``ORDER`` bytes, with marks at the ends of words and
shared continuation counts of all shorter n-grams below, so that a new form of a known stem is read by its stem, and one
of no known stem says nothing. Texts are compared by the length-normalised difference of their two log-likelihoods: over
the whole text, over its most toxic passage and its three most toxic words, in its most toxic known and new word. These are
calibrated to a probability on sampled rows that the models have not seen.
"""

from __future__ import annotations

import string
from collections import Counter
from functools import reduce
from operator import add

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.llm.common import bounded_sample, doc_crc, one_row_each, small_batches, written

TOXIC_SAMPLE, ORDINARY_SAMPLE = 2000, 4000
ORDER, FOLDS, PASSAGE, WORST = 6, 3, 8, 3
TEMPER = 0.5  # how much of a spelling's log ratio counts: n-grams of one word repeat each other
KEPT, SHORT = 200_000, 64  # words whose ratio a worker remembers, and the bytes of one at most
BLANK = bytes(32 if i < 32 or chr(i) in string.punctuation else i for i in range(256))
START, END = 1, 2  # no word holds these bytes


def tokens(text: str) -> list[bytes]:
    """Words in lower case, with ASCII punctuation and control characters as white space."""
    return text.lower().encode("utf-8", "surrogatepass").translate(BLANK).split()


def grams(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The n-gram of ``ORDER`` bytes that ends at each byte and at the end of each word, first byte highest, and the
    place of its word in ``words``."""
    sizes = np.fromiter(map(len, words), np.int64, len(words)) + 1
    joined = np.frombuffer(bytes([END]).join(words) + bytes([END]), np.uint8).astype(np.uint64) if words else np.zeros(0, np.uint64)
    word = np.repeat(np.arange(len(words)), sizes)
    within = np.arange(len(joined)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    keys = np.zeros(len(joined), np.uint64)
    for back in range(ORDER - 1, -1, -1):
        byte = np.full(len(joined), START, np.uint64)
        byte[back:] = np.where(within[back:] >= back, joined[: max(0, len(joined) - back)], np.uint64(START))
        keys = keys << np.uint64(8) | byte
    return keys, word


def discount(counts: np.ndarray) -> float:
    """What absolute discounting takes off each count, from how many are 1 and 2."""
    one, two = np.count_nonzero(counts == 1), np.count_nonzero(counts == 2)
    return one / (one + 2 * two) if one and two else 0.75


def shared_backoff(types: np.ndarray) -> np.ndarray:
    """P(last byte | the bytes between) of each distinct n-gram: interpolated Kneser-Ney on continuation counts, how
    many different bytes stand before an n-gram one shorter, down to a uniform byte."""
    levels, keys = [], types
    for size in range(ORDER - 1, 0, -1):
        keys = np.unique(keys) if size == ORDER - 1 else levels[-1][0]
        short, at, n = np.unique(keys & np.uint64((1 << 8 * size) - 1), return_inverse=True, return_counts=True)
        levels.append((short, n, at))
    p = np.full(1, 1 / 256.0)
    for level in range(len(levels) - 1, -1, -1):
        keys, n, _ = levels[level]
        _, context = np.unique(keys >> np.uint64(8), return_inverse=True)
        off = discount(n)
        total, kinds = np.bincount(context, n), np.bincount(context)
        lower = p[levels[level + 1][2]] if level + 1 < len(levels) else p[0]
        p = np.maximum(n - off, 0) / total[context] + off * kinds[context] / total[context] * lower
    return p[levels[0][2]]


class Model:
    """Log-likelihood ratios of words, from the words of texts and how often each class has them."""

    def __init__(self, words: list[bytes], times: np.ndarray):
        """``times``: for each word a row of its counts in ordinary and in toxic texts."""
        keys, word = grams(words)
        self.types, at = np.unique(keys, return_inverse=True)
        self.contexts, context = np.unique(self.types >> np.uint64(8), return_inverse=True)
        backoff, logs, lefts = shared_backoff(self.types), [], []
        for label in (0, 1):
            n = np.bincount(at, times[word, label], len(self.types))
            off = discount(n)
            total = np.bincount(context, n, len(self.contexts))
            kinds = np.bincount(context, n > 0, len(self.contexts))
            left = np.where(total > 0, off * kinds / np.maximum(total, 1), 1.0)
            logs.append(np.log(np.maximum(n - off, 0) / np.maximum(total, 1)[context] + left[context] * backoff))
            lefts.append(np.log(left))
        self.ratio, self.by_context = logs[1] - logs[0], lefts[1] - lefts[0]
        self.known: dict[bytes, float] = {}

    def __getstate__(self):
        return {**self.__dict__, "known": {}}

    def spelled(self, words: list[bytes]) -> np.ndarray:
        """log P(word | toxic) - log P(word | ordinary) of each word. An n-gram that neither class has differs by what
        its context leaves to backoff; one of an unknown context by nothing."""
        keys, word = grams(words)
        out = np.zeros(len(keys))
        for table, value, key in ((self.contexts, self.by_context, keys >> np.uint64(8)), (self.types, self.ratio, keys)):
            if len(table):
                at = np.minimum(np.searchsorted(table, key), len(table) - 1)
                out = np.where(table[at] == key, value[at], out)
        return np.bincount(word, out, len(words))

    def ratios(self, words: list[bytes]) -> np.ndarray:
        """``spelled`` of each word, by a table of bounded size in which repeated words are found again."""
        new = set(words).difference(self.known)
        if len(self.known) + len(new) > KEPT:
            self.known, new = {}, set(words)
        found = dict(zip(new, self.spelled(list(new)).tolist(), strict=True)) if new else {}
        self.known.update((w, r) for w, r in found.items() if len(w) <= SHORT)
        known = self.known if all(len(w) <= SHORT for w in found) else self.known | found
        return np.fromiter(map(known.__getitem__, words), np.float64, len(words))


class Words:
    """Log-likelihood ratios of words: class counts first, shared continuation counts tilted by spelling next, spelling
    alone for a word of neither class."""

    def __init__(self, words: list[bytes], times: np.ndarray, before: np.ndarray):
        """``times``: for each word a row of its counts in ordinary and in toxic texts; ``before``: behind how many
        different words (a text's start is one) it stands."""
        self.spelling = Model(words, times)
        tilt = TEMPER * self.spelling.spelled(words)
        share = np.log(before / max(before.sum(), 1)) if len(words) else np.zeros(0)
        logs = []
        for label in (0, 1):
            n = times[:, label]
            off, total = discount(n), max(n.sum(), 1)
            left = off * np.count_nonzero(n) / total if n.any() else 1.0
            with np.errstate(divide="ignore"):
                logs.append(np.logaddexp(np.log(np.maximum(n - off, 0) / total), np.log(left) + share + (label - 0.5) * tilt))
        self.ratio = dict(zip(words, (logs[1] - logs[0]).tolist(), strict=True))

    def describe(self, text: str) -> np.ndarray:
        """1, then the length-normalised ratio: of the whole text, of its most toxic passage of ``PASSAGE`` words, of its most
        toxic word of those known and of those new, and of its ``WORST`` most toxic words. A text of fewer words is its
        own passage, a kind of word that it lacks counts 0, and one without words is all 0."""
        words = tokens(text)
        if not words:
            return np.array([1.0, 0.0, 0.0, 0.0, 0.0, 0.0])
        r = np.fromiter((self.ratio.get(w, np.nan) for w in words), np.float64, len(words))
        new = np.isnan(r)
        at = np.flatnonzero(new)
        r[at] = TEMPER * self.spelling.ratios([words[i] for i in at])
        sums = np.concatenate([[0.0], np.cumsum(r)])
        passage = (sums[PASSAGE:] - sums[:-PASSAGE]).max() / PASSAGE if len(r) > PASSAGE else r.mean()
        worst = np.partition(r, len(r) - WORST)[-WORST:] if len(r) > WORST else r
        return np.array([1.0, r.mean(), passage, r[~new].max() if not new.all() else 0.0, r[at].max() if len(at) else 0.0, worst.mean()])


def logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1e-2) -> np.ndarray:
    """Weighted logistic regression by Newton steps."""
    w = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x.T * (weight * p * (1 - p))) @ x + ridge * np.eye(len(w)), x.T @ (weight * (p - y)) + ridge * w)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w


def counted(sample: DataFrame) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """Words of ``sample`` (text, toxic, fold) in order, and for each its counts (fold, class) and behind how many
    different words it stands: in all folds but each, then in all. Texts are cut in tasks and counted on Spark; the driver
    gets a row a word."""
    cells = [(f, c) for f in range(FOLDS) for c in (0, 1)]

    def run(batches):
        for batch in small_batches(batches, 256):
            n: Counter = Counter()
            for text, toxic, fold in zip(*(batch.column(c).to_pylist() for c in ("text", "toxic", "fold")), strict=True):
                words = tokens(text)
                n.update(zip([b"", *words], words, [fold * 2 + int(toxic)] * len(words), strict=False))
            before, word, cell = zip(*n, strict=True) if n else ((), (), ())
            columns = pa.array(before, pa.binary()), pa.array(word, pa.binary()), pa.array(cell, pa.int32()), pa.array(n.values(), pa.int64())
            yield pa.RecordBatch.from_arrays([*columns], ["before", "word", "cell", "n"])

    pairs = sample.select("text", "toxic", "fold").mapInArrow(run, "before binary, word binary, cell int, n bigint")
    pairs = pairs.groupBy("before", "word").agg(*(F.sum(F.when(F.col("cell") == f * 2 + c, F.col("n")).otherwise(0)).alias(f"n{f}{c}") for f, c in cells))
    others = [[f for f in range(FOLDS) if f != k] for k in range(FOLDS)] + [list(range(FOLDS))]
    behind = [F.count_if(reduce(add, (F.col(f"n{f}{c}") for f in folds for c in (0, 1))) > 0).alias(f"b{k}") for k, folds in enumerate(others)]
    rows = pairs.groupBy("word").agg(*(F.sum(f"n{f}{c}").alias(f"n{f}{c}") for f, c in cells), *behind).toArrow().sort_by("word")
    times = np.stack([rows.column(f"n{f}{c}").to_numpy() for f, c in cells], 1).astype(float).reshape(-1, FOLDS, 2)
    before = np.stack([rows.column(f"b{k}").to_numpy() for k in range(FOLDS + 1)], 1).astype(float)
    return rows.column("word").to_pylist(), times, before


def described(sample: DataFrame, models: list[Words]) -> list[tuple[str, int, list[float]]]:
    """(id as text, label, description) of each row of ``sample`` by the model that has not seen its fold, in order."""
    shared = sample.sparkSession.sparkContext.broadcast(models)

    def run(batches):
        for batch in small_batches(batches, 256):
            x = [shared.value[f].describe(t).tolist() for t, f in zip(batch.column("text").to_pylist(), batch.column("fold").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("toxic"), pa.array(x, pa.list_(pa.float64()))], ["id", "toxic", "x"])

    rows = sample.select(F.col("doc_id").cast("string").alias("id"), F.col("toxic").cast("int").alias("toxic"), "text", "fold")
    found = sorted((r.id, r.toxic, list(r.x)) for r in rows.mapInArrow(run, "id string, toxic int, x array<double>").collect())
    shared.unpersist()
    return found


def fit(docs: DataFrame, labels: DataFrame, seed: int = 23) -> tuple[Words, np.ndarray] | None:
    """Learns from the rows of ``docs`` (doc_id, text) that ``labels`` (doc_id, toxic 0/1) marks: at most
    ``TOXIC_SAMPLE`` toxic and ``ORDINARY_SAMPLE`` other ids, weighted to the shares of all labels, one row an id however
    often it is repeated. The calibration sees each row by a model of the other folds; equal texts share a fold. The driver
    gets counts of words and descriptions, no text. None without labelled rows of either kind."""
    labels = labels.select("doc_id", "toxic").where("doc_id IS NOT NULL AND toxic IN (0, 1)").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    share = {r.toxic: r["count"] for r in labels.groupBy("toxic").count().collect()}
    if len(share) < 2:
        return None
    picked = bounded_sample(labels.where("toxic = 1"), TOXIC_SAMPLE, seed).unionByName(bounded_sample(labels.where("toxic = 0"), ORDINARY_SAMPLE, seed))
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(picked), "doc_id")
    sample = written(one_row_each(rows).withColumn("fold", F.expr(f"int(pmod(xxhash64(text, {seed}), {FOLDS}))")), "toxic-sample")
    words, times, before = counted(sample)

    def model(folds: list[int], column: int) -> Words:
        kept = np.flatnonzero(before[:, column] > 0)
        return Words([words[i] for i in kept], times[kept][:, folds].sum(1), before[kept, column])

    found = described(sample, [model([f for f in range(FOLDS) if f != k], k) for k in range(FOLDS)])
    y = np.array([r[1] for r in found], float)
    n = np.bincount(y.astype(int), minlength=2)
    if not n.all():
        return None
    weight = np.where(y == 1, share[1] / n[1], share[0] / n[0]) * len(y) / (share[0] + share[1])
    return model(list(range(FOLDS)), FOLDS), logistic(np.array([r[2] for r in found]), y, weight)


def score(docs: DataFrame, fitted) -> DataFrame:
    """Adds ``score`` (0 to 1, the calibrated probability of toxic) and ``predicted`` (score >= 0.3) to every row.
    Null text counts as empty; nothing learnt scores 0. Columns of these names are replaced, all others kept."""
    shared = docs.sparkSession.sparkContext.broadcast(fitted)
    kept = [c for c in docs.columns if c not in ("score", "predicted")]

    def run(batches):
        for batch in small_batches(batches, 1024):
            if shared.value is None:
                p = np.zeros(batch.num_rows)
            else:
                model, w = shared.value
                x = np.array([model.describe(t or "") for t in batch.column("text").to_pylist()]).reshape(-1, len(w))
                p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array(p, pa.float64()), pa.array((p >= 0.3).astype(np.int32))], [*kept, "score", "predicted"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*kept).schema.fields)
    return docs.select(*kept).mapInArrow(run, f"{schema}, score double, predicted int")


def score_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted of all documents, learnt from labels whose crc32(doc_id as text) mod 4 is
    not 2."""
    marked = docs.select("doc_id", "text", (doc_crc(F.col("doc_id")) % 4 == 2).alias("held_out"))
    fitted = fit(docs, labels.where(doc_crc(F.col("doc_id")) % 4 != 2))
    return score(marked, fitted).select("doc_id", "held_out", "score", "predicted")
