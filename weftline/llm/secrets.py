"""Secret scans: fixed patterns, and a character convolutional network over every candidate.

A candidate is a run of 12 or more characters of the secrets' alphabet, words included. The network reads it with its
surrounding context. It learns from every candidate of all documents, labelled by the fixed findings. So that it learns
what a secret looks like rather than the patterns themselves, each finding is also shown in disguise: its value without
keyword or prefix, in another alphabet, amid the surroundings of an ordinary candidate. The threshold is the highest that
keeps the wanted recall on all labelled values, plain and in disguise, that it has not seen.

Training runs on Spark: candidates are dealt to shards by hash, each shard trains a copy of the network on its rows in their
order, and the copies' mean goes into the next round. Shards depend on the candidates alone, so reruns agree on any cluster.
"""

from __future__ import annotations

import copy
import hashlib
import re
import string

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.llm.common import small_batches, smallest, written

KEYWORDS = ("passw", "secret", "token", "api")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")
CANDIDATE = re.compile(r"[A-Za-z0-9+/_.=-]{12,}")
KINDS = ("assign", "access", "hex", "cnn")
CONTEXT, RECALL = 24, 0.98
DISGUISES, EPOCHS = (2, 12), 4  # disguises of a finding, more where findings are few among the others
SHARD, PARTS, TRAINERS = 4096, 8, 128  # candidates of a shard on average, rounds of an epoch and tasks of a round at most
BLOCK, CHARACTERS = 512, 1 << 20  # candidates that a task holds at once, and after how many characters no more
SHARE = 0.75  # what all findings together weigh against all ordinary candidates
ALPHABETS = (string.hexdigits[:16], string.ascii_uppercase + string.digits, string.ascii_letters + string.digits, string.ascii_letters + string.digits + "+/", string.ascii_letters + string.digits + "_-")


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the fixed findings, leftmost and not overlapping within a kind."""
    low, out = text.lower(), []
    if any(k in low for k in KEYWORDS):
        out += [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 12]
    if "AKIA" in text:
        out += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text) if m.end() - m.start() >= 18]
    out += [(m.start(), m.end(), "hex") for m in HEX.finditer(text)]
    return sorted(out, key=lambda s: (s[0], KINDS.index(s[2])))


def candidates(text: str) -> list[tuple[int, int]]:
    return [m.span() for m in CANDIDATE.finditer(text)]


def value(found: str) -> str:
    """What a fixed finding keeps secret: what an assignment assigns, any other finding itself."""
    m = ASSIGN.match(found)
    return m.group(2) if m else found


def touched(found: list[tuple[int, int]], spans) -> list[bool]:
    """Whether each of ``found`` overlaps one of ``spans``, both in order of their starts: one walk over both."""
    out, reach, nth = [], 0, 0
    for start, end in found:
        while nth < len(spans) and spans[nth][0] < end:
            reach = max(reach, spans[nth][1])
            nth += 1
        out.append(reach > start)
    return out


def window(text: str, start: int, end: int) -> tuple[str, int, int]:
    """The candidate with its context, and where it lies therein."""
    left = max(0, start - CONTEXT)
    return text[left : end + CONTEXT], start - left, end - left


def coded(windows) -> np.ndarray:
    """Codes with two places or more of padding at either end, 0 there: printable ASCII 1 to 95, all others 96; those of the candidate shifted by 96."""
    lengths = np.array([len(w[0]) for w in windows])
    out = np.zeros((len(windows), int(lengths.max()) + 4), np.int64)
    c = np.frombuffer("".join(w[0] for w in windows).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    at = np.arange(len(c)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    a, b = (np.repeat([w[i] for w in windows], lengths) for i in (1, 2))
    out[np.repeat(np.arange(len(windows)), lengths), at + 2] = np.where((c >= 32) & (c < 127), c - 31, 96) + 96 * ((at >= a) & (at < b))
    return out


class Network:
    """Embedding, convolution of width 5, ReLU, maximum over all places, logistic output; trained by Adam."""

    WIDTH, PLACES = 5, 1 << 14

    def __init__(self, dims: int = 12, filters: int = 32, seed: int = 4):
        r = np.random.default_rng(seed)
        self.p = {"e": r.normal(0, 0.3, (193, dims)), "k": r.normal(0, 0.2, (self.WIDTH * dims, filters)), "kb": np.zeros(filters), "w": r.normal(0, 0.2, filters), "b": np.zeros(1)}
        self.m, self.v, self.t = {k: np.zeros_like(x) for k, x in self.p.items()}, {k: np.zeros_like(x) for k, x in self.p.items()}, 0.0
        self.scale, self.shift, self.threshold = 1.0, 0.0, 2.0

    def forward(self, codes: np.ndarray):
        """``codes`` with two more places at either end. Places without a character do not count for the maximum, so
        that a score does not depend on what it is batched with."""
        places = np.lib.stride_tricks.sliding_window_view(codes, self.WIDTH, 1)
        x = self.p["e"][places].reshape(*places.shape[:2], -1)
        h = x @ self.p["k"] + self.p["kb"]
        h[codes[:, 2:-2] == 0] = -np.inf
        at = h.argmax(1)
        top = np.maximum(np.take_along_axis(h, at[:, None], 1)[:, 0], 0)
        return places, x, at, top, top @ self.p["w"] + self.p["b"][0]

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k != "tables"}

    def maxima(self, codes: np.ndarray) -> np.ndarray:
        """As ``forward``, the maximum of each filter only."""
        return np.maximum(self.responses(codes).max(1) + self.p["kb"], 0)

    def responses(self, codes: np.ndarray) -> np.ndarray:
        """What each filter gives at each place, less its constant: a filter's share of every code at each of its places
        is looked up instead of multiplied."""
        if not hasattr(self, "tables"):
            dims = self.p["e"].shape[1]
            self.tables = [(self.p["e"] @ self.p["k"][i * dims : (i + 1) * dims]).astype(np.float32) for i in range(self.WIDTH)]
        n = codes.shape[1] - self.WIDTH + 1
        h = self.tables[0][codes[:, :n]]
        for i in range(1, self.WIDTH):
            h += self.tables[i][codes[:, i : i + n]]
        h[codes[:, 2:-2] == 0] = -np.inf
        return h

    def gradient(self, codes: np.ndarray, labels: np.ndarray, weights: np.ndarray) -> dict[str, np.ndarray]:
        """Of the weighted logistic loss: places are looked up as by ``maxima``, and only those that give a filter's maximum
        are followed back."""
        size, filters = self.PLACES, len(self.p["w"])
        top, at = np.full((len(codes), filters), -np.inf), np.zeros((len(codes), filters), np.int64)
        for start in range(0, codes.shape[1] - self.WIDTH + 1, size):  # very long ones in pieces
            h = self.responses(codes[:, start : start + size + self.WIDTH - 1])
            best = h.argmax(1)
            found = np.take_along_axis(h, best[:, None], 1)[:, 0]
            at, top = np.where(found > top, best + start, at), np.maximum(top, found)
        top = np.maximum(top + self.p["kb"], 0)
        d = (1 / (1 + np.exp(-np.clip(top @ self.p["w"] + self.p["b"][0], -30, 30))) - labels) * weights
        dh = d[:, None] * self.p["w"] * (top > 0)
        taps = np.arange(self.WIDTH)
        places = codes[np.arange(len(codes))[:, None, None], at[:, :, None] + taps]
        cells = (np.arange(filters)[:, None] * self.WIDTH + taps) * len(self.p["e"]) + places
        seen = np.bincount(cells.ravel(), np.repeat(dh.ravel(), self.WIDTH), filters * self.WIDTH * len(self.p["e"])).reshape(-1, len(self.p["e"]))
        k = (seen @ self.p["e"]).reshape(filters, -1).T  # seen: what each code at each of a filter's places answers for
        e = seen.T @ self.p["k"].T.reshape(len(seen), -1)
        return {"w": top.T @ d, "b": np.array([d.sum()]), "k": k, "kb": dh.sum(0), "e": e}

    def learn(self, windows, labels: np.ndarray, weights: np.ndarray, rate: float = 3e-3) -> None:
        """One step of Adam."""
        g: dict = dict.fromkeys(self.p, 0.0)
        for part in self.alike(windows):
            for k, x in self.gradient(coded([windows[i] for i in part]), labels[part], weights[part] / len(windows)).items():
                g[k] = g[k] + x
        self.t += 1
        for k in self.p:
            self.m[k] = 0.9 * self.m[k] + 0.1 * g[k]
            self.v[k] = 0.999 * self.v[k] + 0.001 * g[k] ** 2
            self.p[k] = self.p[k] - rate * (self.m[k] / (1 - 0.9**self.t)) / (np.sqrt(self.v[k] / (1 - 0.999**self.t)) + 1e-8)
        self.__dict__.pop("tables", None)

    def train(self, windows, labels: np.ndarray, epochs: int = 8, batch: int = 64, rate: float = 3e-3, seed: int = 4, weights: np.ndarray | None = None) -> None:
        r, weights = np.random.default_rng(seed), np.ones(len(windows)) if weights is None else weights
        for _ in range(epochs):
            order = r.permutation(len(windows))
            for i in range(0, len(order), batch):
                part = order[i : i + batch]
                self.learn([windows[j] for j in part], labels[part], weights[part], rate)

    def vector(self) -> np.ndarray:
        """All that training has changed, as one row of numbers."""
        return np.concatenate([x.ravel() for held in (self.p, self.m, self.v) for x in held.values()] + [[self.t]])

    def take(self, vector: np.ndarray) -> None:
        """The inverse of ``vector``."""
        at = 0
        for held in (self.p, self.m, self.v):
            for k, x in held.items():
                held[k], at = vector[at : at + x.size].reshape(x.shape), at + x.size
        self.t = float(vector[at])
        self.__dict__.pop("tables", None)

    def alike(self, windows):
        """Numbers of windows of like length together, at most ``PLACES`` places at a time."""
        order = sorted(range(len(windows)), key=lambda i: -len(windows[i][0]))
        while order:
            n = max(1, min(64, self.PLACES // len(windows[order[0]][0])))
            part, order = order[:n], order[n:]
            yield part

    def logits(self, windows) -> np.ndarray:
        """Scores of candidates of like length together, at most ``PLACES`` places at a time: neither many nor very
        long ones take more memory."""
        out = np.zeros(len(windows))
        for part in self.alike(windows):
            codes = coded([windows[i] for i in part])
            tops = [self.maxima(codes[:, at : at + self.PLACES + 4]) for at in range(0, codes.shape[1] - 4, self.PLACES)]
            out[part] = np.max(tops, axis=0) @ self.p["w"] + self.p["b"][0]
        return out

    def probabilities(self, windows) -> np.ndarray:
        return self.probability(self.logits(windows)) if windows else np.zeros(0)

    def probability(self, logits: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(logits * self.scale + self.shift, -30, 30)))

    def calibrate(self, windows, labels: np.ndarray, recall: float) -> None:
        """Platt scaling on unseen labels, and the highest threshold at which ``recall`` of them is kept."""
        z = self.logits(windows)

        def sums(scale, shift, high, low):
            p = 1 / (1 + np.exp(-np.clip(z * scale + shift, -30, 30)))
            d, c = p - np.where(labels == 1, high, low), p * (1 - p)
            return (d @ z, d.sum(), c @ (z * z), c @ z, c.sum())

        self.platt(sums, labels.sum(), (1 - labels).sum())
        p = np.sort(self.probabilities(windows)[labels == 1])
        self.threshold = float(p[int((1 - recall) * len(p))]) if len(p) else 2.0


    def platt(self, sums, ones: float, zeros: float) -> None:
        """Scale and shift by Newton's method, no step longer than 1. ``sums`` gives, for a scale, a shift and the targets
        of either label, the sums over all logits z of d * z, d, c * z * z, c * z and c, where d is the probability less
        its target and c its slope."""
        w, start = np.array([1.0, 0.0]), np.array([1.0, 0.0])
        for _ in range(50):
            gz, g, czz, cz, c = sums(*w.tolist(), float((ones + 1) / (ones + 2)), float(1 / (zeros + 2)))
            step = np.linalg.solve(np.array([[czz, cz], [cz, c]]) + 1e-3 * np.eye(2), np.array([gz, g]) + 1e-3 * (w - start))
            w = w - step / max(1.0, float(np.abs(step).max()))
            if np.abs(step).max() < 1e-9:
                break
        self.scale, self.shift = w.tolist()


def examples(docs: DataFrame, seed: int) -> DataFrame:
    """Every distinct candidate with its surroundings, of all documents: lot (a hash of what it says), w, a, b (its window and
    where it lies therein) and said, the value of the fixed finding that overlaps it, else empty."""

    def run(batches):
        for batch in small_batches(batches):
            rows = set()
            for text in batch.column("text").to_pylist():
                found = candidates(text or "")
                spans = base_spans(text) if found else []
                for (a, b), hit in zip(found, touched(found, spans), strict=True):
                    said = next(value(text[s:e]) for s, e, _ in spans if s < b and a < e) if hit else ""
                    lot = xxhash.xxh64_intdigest((said or text[a:b]).encode("utf-8", "surrogatepass"), seed) - 2**63
                    rows.add((lot, *window(text, a, b), said))
            cols = list(zip(*rows, strict=True)) or [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.string(), pa.int32(), pa.int32(), pa.string()), strict=True)], ["lot", "w", "a", "b", "said"])

    return written(docs.select("text").mapInArrow(run, "lot bigint, w string, a int, b int, said string").distinct(), "candidates")


def labelled(docs: DataFrame, findings: int, ordinary: int, seed: int) -> list[tuple[str, int, int, str]]:
    """(window, start, end, value) of ``findings`` examples that a fixed finding overlaps and ``ordinary`` others (value
    empty), each value once, to look at: those with the smallest hashes. Nothing is learned from them."""
    once = examples(docs, seed).groupBy("lot").agg(F.min(F.struct("w", "a", "b", "said")).alias("r")).select("lot", "r.*")
    rows = [smallest(once.where(test), "lot", n, once.where(test).count()).collect() for test, n in (("said != ''", findings), ("said = ''", ordinary))]
    return [(r.w, r.a, r.b, r.said) for part in rows for r in part]


def disguised(said: str, around: tuple[str, int, int], r: np.random.Generator) -> tuple[str, int, int]:
    """A window of what a finding said, its prefix left out, each character replaced by another one throughout, amid the
    surroundings of an ordinary candidate."""
    text, a, b = around
    letters = ALPHABETS[int(r.integers(len(ALPHABETS)))]
    said = said.removeprefix("AKIA")
    to = dict(zip(sorted(set(said)), r.permutation(len(letters)).tolist() * len(set(said)), strict=False))
    other = "".join(letters[to[c]] for c in said)
    return text[:a] + other + text[b:], a, a + len(other)


def shown(batches, disguises: int, seed: int):
    """(shard, windows, labels) of the rows, which come ordered by shard, ``BLOCK`` of a shard at a time: ordinary
    candidates, findings, and each finding in disguise amid the surroundings of ordinary ones beside it."""

    def block(shard, nth, rows):
        r = np.random.default_rng((seed, shard, nth))
        plain = [w[:3] for w in rows if not w[3]]
        said = [w for w in rows if w[3]]
        amid = plain or [w[:3] for w in said]
        hidden = [disguised(w[3], amid[int(r.integers(len(amid)))], r) for w in said for _ in range(disguises)]
        return shard, plain + [w[:3] for w in said] + hidden, np.array([0.0] * len(plain) + [1.0] * (len(said) + len(hidden)))

    now, nth, size, held = None, 0, 0, []
    for batch in small_batches(batches):
        for shard, *row in zip(*(batch.column(c).to_pylist() for c in ("shard", "w", "a", "b", "said")), strict=True):
            if held and (shard != now or len(held) == BLOCK or size > CHARACTERS):
                yield block(now, nth, held)
                nth, size, held = nth + 1 if shard == now else 0, 0, []
            now, size = shard, size + len(row[0]) + len(row[3])
            held.append(row)
    if held:
        yield block(now, nth, held)


def dealt(rows: DataFrame, shards: int) -> DataFrame:
    """Rows by shard, those of one shard in the order of their hashes, whatever the tasks."""
    return rows.repartition(min(shards, TRAINERS), "shard").sortWithinPartitions("shard", "row", "w", "a", "b", "said").select("shard", "w", "a", "b", "said")


def taught(net: Network, rows: DataFrame, shards: int, disguises: int, weights: tuple[float, float], seed: int) -> None:
    """One round: each shard trains a copy of ``net`` on its rows, then ``net`` becomes the mean of the copies."""

    def run(batches):
        total, own, shards = np.zeros(len(net.vector())), net, []
        for shard, windows, labels in shown(batches, disguises, seed):
            if shard not in shards[-1:]:
                total += own.vector() if shards else 0
                own = copy.deepcopy(net)
                shards.append(shard)
            own.train(windows, labels, 1, seed=seed, weights=np.where(labels == 1, weights[1], weights[0]))
        if shards:
            yield pa.RecordBatch.from_pydict({"first": pa.array(shards[:1], pa.int32()), "n": pa.array([len(shards)], pa.int32()), "total": pa.array([total + own.vector()], pa.list_(pa.float64()))})

    sums = sorted(dealt(rows, shards).mapInArrow(run, "first int, n int, total array<double>").collect())
    if sums:
        net.take(np.sum([np.array(s.total) for s in sums], axis=0) / sum(s.n for s in sums))


def calibrated(net: Network, rows: DataFrame, shards: int, disguises: int, recall: float, seed: int) -> None:
    """``Network.calibrate`` on all ``rows`` and the disguises of their findings; logits stay on Spark."""

    def run(batches):
        for _, windows, labels in shown(batches, disguises, seed):
            yield pa.RecordBatch.from_arrays([pa.array(net.logits(windows), pa.float64()), pa.array(labels, pa.float64())], ["z", "y"])

    logits = written(dealt(rows, shards).mapInArrow(run, "z double, y double"), "logits")
    ones, every = logits.agg(F.sum("y"), F.count("*")).first()

    def sums(scale, shift, high, low):
        p = 1 / (1 + F.exp(-F.least(F.greatest(F.col("z") * scale + shift, F.lit(-30.0)), F.lit(30.0))))
        d, c = F.col("p") - F.when(F.col("y") == 1, high).otherwise(low), F.col("p") * (1 - F.col("p"))
        return tuple(logits.withColumn("p", p).select("z", d.alias("d"), c.alias("c")).agg(F.sum(F.expr("d * z")), F.sum("d"), F.sum(F.expr("c * z * z")), F.sum(F.expr("c * z")), F.sum("c")).first())

    net.platt(sums, ones, every - ones)
    last = logits.where("y = 1").orderBy("z").offset(int((1 - recall) * ones)).limit(1).first()
    net.threshold = float(net.probability(np.array([last.z]))[0])


def fit(docs: DataFrame, recall: float = RECALL, seed: int = 31) -> Network:
    """Trained on every example of four fifths of all values, calibrated on every example of the rest; a value is on one side
    with all its copies and disguises, so that near copies of a document do not tell. With fewer than 20 values of either
    label no candidate passes and the fixed findings stand alone; so it is for empty ``docs``. Null texts hold nothing,
    examples that repeat count once."""
    every, net = examples(docs, seed), Network()
    found = {r.hit: r for r in every.groupBy((F.col("said") != "").alias("hit")).agg(F.count("*").alias("n")).collect()}
    values = {r.hit: r.n for r in every.select("lot", (F.col("said") != "").alias("hit")).distinct().groupBy("hit").agg(F.count("*").alias("n")).collect()}
    if min(values.get(True, 0), values.get(False, 0)) < 20:
        return net
    n, (least, most) = found[True].n + found[False].n, DISGUISES
    disguises = max(least, min(most, found[False].n // (4 * found[True].n)))
    hits = found[True].n * (1 + disguises)
    parts = max(1, min(PARTS, n // SHARD))
    shards = -(-n // (parts * SHARD))
    rows = every.withColumn("row", F.xxhash64("w", "a", "b", "said")).withColumn("part", F.pmod("row", F.lit(parts))).withColumn("shard", F.pmod(F.xxhash64("row"), F.lit(shards)).cast("int"))
    unseen = F.pmod("lot", F.lit(5)) == 0
    positive = SHARE * found[False].n / hits
    mean = (found[False].n + positive * hits) / (found[False].n + hits)
    for epoch in range(EPOCHS):
        for part in range(parts):
            taught(net, rows.where(~unseen & (F.col("part") == part)), shards, disguises, (1 / mean, positive / mean), seed + 1 + epoch * parts + part)
    apart = not rows.where(unseen & (F.col("said") != "")).isEmpty()  # of few values none may be unseen
    calibrated(net, rows.where(unseen) if apart else rows, shards, least, recall, seed)
    return net


def scan_text(text: str, net: Network) -> tuple[list[tuple[int, int, str]], int]:
    """All spans of a text, the fixed ones first where they start together, and how many candidates that a fixed one
    overlaps the network finds as well."""
    spans = base_spans(text)
    found = candidates(text)
    hit = touched(found, spans)
    keep = (net.probabilities([window(text, a, b) for a, b in found]) >= net.threshold).tolist()
    new = [(a, b, "cnn") for (a, b), k, h in zip(found, keep, hit, strict=True) if k and not h]
    return sorted(spans + new, key=lambda s: (s[0], KINDS.index(s[2]))), sum(k and h for k, h in zip(keep, hit, strict=True))


def scan(docs: DataFrame, net: Network) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_cnn and n_confirmed (candidates overlapping a fixed
    finding that the network finds as well) of every row; null text counts as empty."""
    shared = docs.sparkSession.sparkContext.broadcast(net)
    joined = lambda spans: ",".join(f"{k}:{a}:{b}" for a, b, k in spans)
    names = ("n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_cnn", "n_confirmed")
    kinds = (*(pa.int64(),) * 3, *(pa.string(),) * 2, *(pa.int64(),) * 2)

    def run(batches):
        for batch in small_batches(batches):
            out = []
            for text in batch.column("text").to_pylist():
                spans, confirmed = scan_text(text or "", shared.value)
                n = [sum(s[2] == k for s in spans) for k in KINDS]
                out.append((*n[:3], hashlib.sha256(joined([s for s in spans if s[2] != "cnn"]).encode()).hexdigest(), joined(spans), n[3], confirmed))
            cols = list(zip(*out, strict=True)) or [()] * len(kinds)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(c, t) for c, t in zip(cols, kinds, strict=True))], ["doc_id", *names])

    fields = ", ".join(f"{n} {'string' if k == pa.string() else 'bigint'}" for n, k in zip(names, kinds, strict=True))
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, {fields}")


def redact(docs: DataFrame, net: Network, text: str = "text") -> DataFrame:
    """``docs`` with every span of ``text`` replaced by ``[SECRET]``, overlapping ones as one; nulls stay null and all
    other columns and rows stay as they are."""
    shared = docs.sparkSession.sparkContext.broadcast(net)

    def run(batches):
        for batch in small_batches(batches):
            out = []
            for t in batch.column(text).to_pylist():
                made, at = [], 0
                for a, b, _ in scan_text(t or "", shared.value)[0]:
                    if a >= at:
                        made += [t[at:a], "[SECRET]"]
                    at = max(at, b)
                out.append("".join([*made, t[at:]]) if made else t)
            yield batch.set_column(batch.schema.get_field_index(text), text, pa.array(out, pa.string()))

    return docs.mapInArrow(run, docs.schema)
