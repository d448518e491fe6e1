"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams.

Document frequencies of hashed 1- to 3-grams are counted over all labelled training rows. The weights are learnt from
a bounded sample by follow-the-regularised-leader with elastic-net penalties; a fifth of the sample sets the
temperature that calibrates the probabilities.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.llm.common import doc_crc, in_share, one_row_each, small_batches

SLOTS, GRAMS, SAMPLE, LEAST, LANGUAGES = 1 << 14, 3, 3000, 50, 200
LETTER = re.compile(r"[^\W\d_]")


def gram_counts(text: str) -> np.ndarray:
    """How often each slot is hit by the n-grams of the lower-cased whole text."""
    codes = np.frombuffer(f" {text.lower()} ".encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    h, slots = codes * np.uint64(0x9E3779B97F4A7C15), []
    for n in range(1, GRAMS + 1):
        if n > 1:
            h = (h[:-1] ^ (h[:-1] >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) + codes[n - 1 :] * np.uint64(0x94D049BB133111EB)
        slots.append((h ^ (h >> np.uint64(31))) * np.uint64(0xD6E8FEB86659FD93) >> np.uint64(50))
    return np.bincount(np.concatenate(slots).astype(np.int64), minlength=SLOTS)


def tf_idf(text: str, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    counts = gram_counts(text)
    at = np.flatnonzero(counts)
    v = (1 + np.log(counts[at])) * idf[at]
    return at, v / np.sqrt(v @ v)


def inverse_frequencies(texts: DataFrame) -> np.ndarray:
    """Smoothed inverse document frequency of each slot over all rows of ``texts``; null text is not counted."""

    def run(batches):
        df, n = np.zeros(SLOTS, np.int64), 0
        for batch in batches:
            for text in batch.column("text").to_pylist():
                if text:
                    df += gram_counts(text) > 0
                    n += 1
        at = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array([-1, *at.tolist()], pa.int64()), pa.array([n, *df[at].tolist()], pa.int64())], ["slot", "n"])

    rows = texts.select("text").mapInArrow(run, "slot bigint, n bigint").groupBy("slot").agg(F.sum("n").alias("n")).collect()
    df, n = np.zeros(SLOTS), 0
    for r in rows:
        if r.slot < 0:
            n = r.n
        else:
            df[r.slot] = r.n
    return np.log((1 + n) / (1 + df)) + 1


class Ftrl:
    """Follow the regularised leader, proximal, with an L1 and an L2 penalty; a row of weights a slot and the bias."""

    def __init__(self, classes: int, alpha=0.5, beta=1.0, l1=1e-3, l2=1e-4):
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2
        self.z, self.n = np.zeros((SLOTS + 1, classes)), np.zeros((SLOTS + 1, classes))

    def weights(self, at) -> np.ndarray:
        z = self.z[at]
        w = -(z - np.sign(z) * self.l1) / ((self.beta + np.sqrt(self.n[at])) / self.alpha + self.l2)
        return np.where(np.abs(z) > self.l1, w, 0.0)

    def learn(self, at: np.ndarray, v: np.ndarray, label: int) -> None:
        at, v = np.append(at, SLOTS), np.append(v, 1.0)
        w = self.weights(at)
        p = softmax(v @ w)
        p[label] -= 1
        g = v[:, None] * p
        sigma = (np.sqrt(self.n[at] + g * g) - np.sqrt(self.n[at])) / self.alpha
        self.z[at] += g - sigma * w
        self.n[at] += g * g


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(-1, keepdims=True))
    return e / e.sum(-1, keepdims=True)


def by_language(labelled: DataFrame, n: int, seed: int) -> DataFrame:
    """About ``n`` rows of ``labelled`` (doc_id, text, lang) with a text and an id, dealt to languages by their shares but
    about ``LEAST`` to each that has them, so that a rare one is learnt too: those whose ids have hashes in the language's
    share of all hashes, so nothing is ranked or gathered. Of more than ``LANGUAGES`` languages the most frequent are
    learnt."""
    rows = labelled.where("length(text) > 0 AND doc_id IS NOT NULL AND lang IS NOT NULL").select("doc_id", "text", "lang").withColumn("lot", F.xxhash64("doc_id", F.lit(seed)))
    counts = rows.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(LANGUAGES).collect()
    total, picked = sum(r["count"] for r in counts), F.lit(False)
    for r in counts:
        picked = picked | ((F.col("lang") == r.lang) & in_share("lot", max(LEAST, n * r["count"] / total), r["count"]))
    return rows.where(picked).select("doc_id", "text", "lang")


def fit(labelled: DataFrame, sample: int = SAMPLE, epochs: int = 3, seed: int = 9) -> dict:
    """Learns from ``labelled`` (doc_id, text, lang): frequencies from all rows, weights from about ``sample`` ids, of
    which each gives one row however often it is repeated. Null and empty texts teach nothing; without rows no
    language is known."""
    idf = inverse_frequencies(labelled)
    rows = sorted(one_row_each(by_language(labelled, sample, seed)).collect(), key=lambda r: str(r.doc_id))
    langs = sorted({r.lang for r in rows})
    kept = [(*tf_idf(r.text, idf), langs.index(r.lang)) for r in rows]
    order = np.random.default_rng(seed).permutation(len(kept))
    cut = len(kept) - len(kept) // 5
    model = Ftrl(max(len(langs), 1))
    for _ in range(epochs):
        for i in order[:cut]:
            model.learn(*kept[i])
    w = model.weights(np.arange(SLOTS + 1))
    held = [(v @ w[at] + w[SLOTS], y) for at, v, y in (kept[i] for i in order[cut:])]
    scale = np.geomspace(0.1, 20, 80)
    loss = [sum(-np.log(softmax(x * s)[y] + 1e-12) for x, y in held) + 1e-3 * abs(np.log(s)) for s in scale]
    return {"idf": idf, "w": w, "langs": langs, "scale": float(scale[int(np.argmin(loss))])}


def predict(docs: DataFrame, model: dict) -> DataFrame:
    """Adds ``lang_pred`` and ``score`` (the calibrated probability) to all rows; ``und`` and 0 where the text is null
    or has no letter, or nothing was learnt. Columns of these names are replaced, all others kept."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kept = [c for c in docs.columns if c not in ("lang_pred", "score")]

    def run(batches):
        m = shared.value
        for batch in small_batches(batches, 1024):
            langs, scores = [], []
            for text in batch.column("text").to_pylist():
                if not text or not m["langs"] or not LETTER.search(text):
                    langs.append("und")
                    scores.append(0.0)
                    continue
                at, v = tf_idf(text, m["idf"])
                p = softmax((v @ m["w"][at] + m["w"][SLOTS]) * m["scale"])
                best = int(np.argmax(p))
                langs.append(m["langs"][best])
                scores.append(float(p[best]))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array(langs, pa.string()), pa.array(scores, pa.float64())], [*kept, "lang_pred", "score"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*kept).schema.fields)
    return docs.select(*kept).mapInArrow(run, f"{schema}, lang_pred string, score double")


def identify_documents(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score of all documents, by a model of the labelled ones whose
    crc32(doc_id as text) mod 5 is not 0. Repeated rows and null ids are rows of their own; without labels all are
    ``und``."""
    marked = docs.select("doc_id", "text", "lang", (doc_crc(F.col("doc_id")) % 5 == 0).alias("held_out"))
    model = fit(marked.where(~F.col("held_out") & F.col("lang").isNotNull()))
    return predict(marked.select("doc_id", "held_out", "text"), model).select("doc_id", "held_out", "lang_pred", "score")
