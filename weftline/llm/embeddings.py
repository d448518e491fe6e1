"""Near-duplicate vectors by sorted projection passes.

Each pass draws random hyperplanes anew, orders the vectors by the concatenated signs, and compares each with the next
ones in that order; pairs at the wanted cosine are united over all passes. A pass moves vectors at one byte a component:
the error of that bounds every cosine, so most pairs are settled by it and the few too close to call are compared in
double precision. Signs hardly tell vectors apart that crowd around one direction. All vectors are counted by their signs, and
those of each place that holds more than a window are asked for such crowds; each crowd, of any size, then has all its
vectors compared block against block, and with those outside of it that may link with one. Components are found on those links,
and within each component, block against block, every vector's links are counted exactly.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftline.llm.common import written
from weftline.llm.components import connected_components

BITS, WIDTH, MISSED, BLOCK, CHUNK = 64, 128, 0.005, 4096, 4096
ALIKE, CROWD, DRAWS, PIECE = 0.6, WIDTH // 4, 4, 4096  # cosine to a crowd's leader; members in a piece that make a crowd; counts; rows of a piece
CROWD_BLOCK, CROWD_BLOCKS = 8192, 4  # rows of a block of a crowd; of a crowd of more blocks they are larger, as each is sent to each other
WIDE, COMPONENTS = 4, 1 << 22  # how many times as large at most, and the components of a larger block


def pass_count(n: int, least: float, width: int = WIDTH, missed: float = MISSED) -> int:
    """How many passes leave ``missed`` of the pairs at cosine ``least``, by chance, among ``n`` vectors: in one pass such
    a pair lies within a window if it agrees in about as many signs as tell windows apart."""
    agree = 1 - math.acos(max(-1.0, min(1.0, least))) / math.pi
    once = agree ** (math.log2(max(n / width, 1)) + 1)
    return 1 if once >= 1 else max(4, math.ceil(math.log(missed) / math.log(1 - once)))


def directed(raw: np.ndarray) -> np.ndarray | None:
    """The unit vector in double precision; None without a direction."""
    x = raw.astype(np.float64)
    big = np.abs(x).max() if len(x) else 0.0
    if not (np.isfinite(big) and big > 0):
        return None
    x = x / big
    return x / np.sqrt(x @ x)


def vectors(df: DataFrame) -> DataFrame:
    """vec_id, raw (the components as they are, in bytes) and digest (128 bits of the unit vector); both null for null,
    empty or zero vectors and those with null or non-finite parts."""
    kind = np.float32 if isinstance(df.schema["embedding"].dataType.elementType, T.FloatType) else np.float64

    def run(batches):
        for b in batches:
            raws, digests = [], []
            for v in b.column("embedding").to_pylist():
                x = np.array([np.nan if c is None else c for c in v or ()], kind)
                unit = directed(x)
                raws.append(None if unit is None else x.tobytes())
                digests.append(None if unit is None else hashlib.blake2b(unit.tobytes(), digest_size=16).digest())
            yield pa.RecordBatch.from_arrays([b.column("vec_id"), pa.array(raws, pa.binary()), pa.array(digests, pa.binary())], ["vec_id", "raw", "digest"])

    return df.select("vec_id", "embedding").mapInArrow(run, f"vec_id {df.schema['vec_id'].dataType.simpleString()}, raw binary, digest binary")


def coded(unit: np.ndarray) -> bytes:
    """A unit vector at a byte a component, behind its scale and the length of what that loses."""
    scale = np.float32(np.abs(unit).max() / 127)
    q = np.rint(unit / scale).astype(np.int8)
    return np.array([scale, np.sqrt(((unit - q * np.float64(scale)) ** 2).sum()) * 1.0001], np.float32).tobytes() + q.tobytes()


def pass_rows(nodes: DataFrame, kind: type, passes: int, seed: int) -> DataFrame:
    """(grp, key, node, code) of each node in each pass: grp is the pass and the vector's length, key the signs of ``BITS``
    projections that both draw."""

    def run(batches):
        planes: dict[int, np.ndarray] = {}
        for b in batches:
            for at in range(0, b.num_rows, 1024):
                part = b.slice(at, 1024)
                units = [directed(np.frombuffer(x, kind)) for x in part.column("raw").to_pylist()]
                node = part.column("node").to_numpy()
                for size in {len(u) for u in units}:
                    if size not in planes:
                        planes[size] = np.random.default_rng([seed, size]).standard_normal((passes * BITS, size))
                    own = [i for i, u in enumerate(units) if len(u) == size]
                    x = np.stack([units[i] for i in own])
                    keys = np.packbits((x @ planes[size].T > 0).reshape(len(own), passes, BITS), axis=2).reshape(len(own), passes, 8).view(">u8")[..., 0]
                    keys = (keys.astype(np.uint64) ^ np.uint64(1 << 63)).view(np.int64)  # signed, in the same order
                    codes = pa.array([coded(u) for u in x], pa.binary())
                    group = pa.array(np.arange(passes) + size * (1 << 20))
                    again = pa.array(np.repeat(np.arange(len(own)), passes))
                    yield pa.RecordBatch.from_arrays([pa.concat_arrays([group] * len(own)), pa.array(keys.ravel()), pa.array(node[own]).take(again), codes.take(again)], ["grp", "key", "node", "code"])

    return nodes.select("node", "raw").mapInArrow(run, "grp bigint, key bigint, node bigint, code binary")


def united(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For each of ``n`` rows the smallest row that links (a, b) join it with."""
    label = np.arange(n)
    while len(a):
        low = np.minimum(label[a], label[b])
        np.minimum.at(label, label[a], low)
        np.minimum.at(label, label[b], low)
        while (label[label] != label).any():
            label = label[label]
        apart = label[a] != label[b]
        a, b = a[apart], b[apart]
    return label


def compared(node: np.ndarray, codes: list[bytes], fresh: int, least: float, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(sure, close) pairs of nodes of one group in order, the last ``fresh`` rows with the ``width`` before each.

    ``sure`` joins rows that surely linked pairs connect, each row with one other at most; ``close`` has the pairs that
    the codes leave open and ``sure`` does not connect.
    """
    table = np.frombuffer(b"".join(codes), np.uint8).reshape(len(codes), -1)
    scale, lost = np.ascontiguousarray(table[:, :8]).view(np.float32).T
    x = table[:, 8:].view(np.int8).astype(np.float32) * scale[:, None]
    links: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    for at in range(len(x) - fresh, len(x), 256):
        to = min(at + 256, len(x))
        start = max(0, at - width)
        dots = x[start:to] @ x[at:to].T
        slack = lost[start:to, None] + lost[None, at:to] + 3 * lost[start:to, None] * lost[None, at:to] + 1e-5
        i, j = np.nonzero(dots + slack >= least)
        a, b = i + start, j + at
        within = (a < b) & (b - a <= width)
        links.append((a[within], b[within], (dots - slack)[i, j][within] >= least))
    a, b, sure = (np.concatenate([x[k] for x in links]) if links else np.zeros(0, bool if k == 2 else np.int64) for k in range(3))
    label = united(len(x), a[sure], b[sure])
    joined = np.flatnonzero(label != np.arange(len(x)))
    left = ~sure & (label[a] != label[b])
    return np.stack([node[joined], node[label[joined]]], 1), np.stack([node[a[left]], node[b[left]]], 1)


def window_rows(ordered: DataFrame, least: float, width: int, group: tuple[str, ...]) -> DataFrame:
    """(kind, a, b, part, grp, code) of sorted rows, partition by partition: kind 0 for a pair that links connect, 1 for a
    pair to be compared in double precision; 2 and 3 for node a, in order b, among the last and the first ``width``
    rows of partition ``part``, which meet those of the next and of the one before."""
    names = ["kind", "a", "b", "part", "grp", "code"]
    types = (pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.binary())

    def batch_of(kind, a, b, grp=None, code=None):
        n = len(a)
        cols = (np.full(n, kind), a, b, np.full(n, TaskContext.get().partitionId() - (kind == 3)), np.zeros(n, np.int64) if grp is None else grp, [b""] * n if code is None else code)
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names)

    def run(batches):
        held: list = []  # the last rows: group, node, grp, code
        opening: list = []
        for batch in batches:
            for at in range(0, batch.num_rows, CHUNK):
                part = batch.slice(at, CHUNK)
                keys = list(zip(*(part.column(g).to_pylist() for g in group), strict=True))
                rows = list(zip(keys, part.column("node").to_pylist(), part.column("grp").to_pylist(), part.column("code").to_pylist(), strict=True))
                opening += rows[: width - len(opening)]
                cuts = [0, *(i for i in range(1, len(rows)) if keys[i] != keys[i - 1]), len(rows)]
                for a, b in zip(cuts, cuts[1:], strict=False):
                    own = [r for r in held if r[0] == keys[a]] + rows[a:b]
                    sure, close = compared(np.array([r[1] for r in own]), [r[3] for r in own], b - a, least, width)
                    for kind, pairs in ((0, sure), (1, close)):
                        if len(pairs):
                            yield batch_of(kind, pairs.min(1), pairs.max(1))
                held = (held + rows)[-width:]
        for kind, rows in ((2, held), (3, opening)):
            if rows:
                yield batch_of(kind, [r[1] for r in rows], range(len(rows)), [r[2] for r in rows], [r[3] for r in rows])

    return ordered.mapInArrow(run, "kind int, a bigint, b bigint, part int, grp bigint, code binary")


def linked_pairs(nodes: DataFrame, kind: type, least: float, passes: int, width: int, seed: int) -> DataFrame:
    """(a, b): pairs of nodes that links connect. Rows are range-partitioned and sorted by pass and key, ties in an order of
    the pass's own; a task compares what it holds, and the rows at its ends meet those of its neighbours after."""
    tie = F.xxhash64("node", "grp")
    rows = pass_rows(nodes, kind, passes, seed).repartitionByRange("grp", "key", tie).sortWithinPartitions("grp", "key", tie)
    found = written(window_rows(rows, least, width, ("grp",)), "pass-links")
    ends = found.where("kind > 1").select("part", (-F.col("kind")).alias("side"), "b", "grp", F.col("a").alias("node"), "code")
    ends = ends.repartition("part").sortWithinPartitions("part", F.desc("side"), "b")
    every = found.unionByName(written(window_rows(ends, least, width, ("part", "grp")), "end-links"))
    sure, close = every.where("kind = 0").select("a", "b").distinct(), every.where("kind = 1").select("a", "b").distinct()

    def exact(batches):
        for batch in batches:
            near = [bool(directed(np.frombuffer(x, kind)) @ directed(np.frombuffer(y, kind)) >= least) for x, y in zip(batch.column("left").to_pylist(), batch.column("right").to_pylist(), strict=True)]
            yield batch.select(["a", "b"]).filter(pa.array(near, pa.bool_()))

    vector = lambda end, name: nodes.select(F.col("node").alias(end), F.col("raw").alias(name))
    close = close.join(vector("a", "left"), "a").join(vector("b", "right"), "b").select("a", "b", "left", "right").mapInArrow(exact, "a bigint, b bigint")
    return sure.unionByName(close)


def leading(x: np.ndarray, members: int) -> np.ndarray:
    """The leaders among the rows of ``x``, in their order, that ``members`` rows at least belong to. None is within ``ALIKE``
    of one before; a row belongs to the nearest."""
    kept, n = np.empty_like(x), 0
    for v in x:
        if not n or (kept[:n] @ v).max() < ALIKE:
            kept[n] = v
            n += 1
    kept = kept[:n]
    return kept[np.bincount((x @ kept.T).argmax(1), minlength=n) >= members] if n else kept


def crowds(nodes: DataFrame, kind: type, total: int, seed: int) -> list[np.ndarray]:
    """The leader of each crowd of ``nodes`` (digest, node, raw), none within ``ALIKE`` of one before.

    All nodes are counted by as many signs as leave half a window of even vectors in a place, ``DRAWS`` times. Windows cover a
    place of up to ``WIDTH`` nodes; every node of a fuller one is asked, in pieces of about ``PIECE``, for the leaders
    there. Only leaders reach the driver, one for ``CROWD`` nodes of a piece at most.
    """
    bits = math.ceil(math.log2(max(1, 2 * total / WIDTH)))
    place = F.shiftright("key", BITS - bits) if bits else F.lit(0)
    keys = written(pass_rows(nodes, kind, DRAWS, seed + 1).select("grp", place.cast("bigint").alias("place"), "node"), "places")
    full = keys.groupBy("grp", "place").agg(F.count("*").alias("n")).where(F.col("n") > WIDTH)
    own = keys.join(full, ["grp", "place"]).groupBy("node").agg(F.min(F.struct("grp", "place", "n")).alias("p"))
    lot = F.xxhash64("digest", F.lit(seed))
    piece = F.concat_ws(":", "p.grp", "p.place", F.pmod(lot, F.ceil(F.col("p.n") / PIECE)))
    asked = nodes.join(own, "node").select(piece.alias("piece"), lot.alias("lot"), "raw")

    def lead(pdf: pd.DataFrame) -> pd.DataFrame:
        found = leading(np.stack([directed(np.frombuffer(r, kind)) for r in pdf.sort_values(["lot", "raw"]).raw]), CROWD)
        return pd.DataFrame({"lot": pdf.lot.min(), "raw": [x.tobytes() for x in found]})

    units = [np.frombuffer(r.raw) for r in sorted(asked.groupBy("piece").applyInPandas(lead, "lot bigint, raw binary").collect())]
    return [x for size in sorted({len(u) for u in units}) for x in leading(np.stack([u for u in units if len(u) == size]), 1)]


def crowd_of(nodes: DataFrame, kind: type, leaders: list[np.ndarray], least: float | None = None) -> DataFrame:
    """(node, raw, crowd) of the nodes within ``ALIKE`` of one of ``leaders``: crowd is the place of the nearest. With ``least``,
    also guest, and a row with guest true for each other crowd that may have a member at that cosine to the node: such a
    member is within ``ALIKE`` of its leader and on the leader's side of the plane between this and the node's nearest."""
    shared = nodes.sparkSession.sparkContext.broadcast(leaders)
    names = ["node", "raw", "crowd", *([] if least is None else ["guest"])]
    reach = -1.0 if least is None else math.cos(min(math.pi, math.acos(ALIKE) + math.acos(max(-1.0, min(1.0, least)))))

    def run(batches):
        places = {size: np.array([k for k, u in enumerate(shared.value) if len(u) == size]) for size in {len(u) for u in shared.value}}
        tables = {size: np.stack([shared.value[k] for k in own]) for size, own in places.items()}
        for batch in batches:
            units = [directed(np.frombuffer(x, kind)) for x in batch.column("raw").to_pylist()]
            for size in {len(u) for u in units} & set(tables):
                own = np.array([i for i, u in enumerate(units) if len(u) == size])
                table = tables[size]
                for at in range(0, len(own), 512):
                    rows = own[at : at + 512]
                    near = np.stack([units[i] for i in rows]) @ table.T
                    first, most = near.argmax(1), near.max(1)
                    home = most >= ALIKE
                    sides = [(rows[home], first[home], False)]
                    if least is not None:
                        apart = np.sqrt(np.maximum(0, 2 - 2 * table @ table.T))[first] * math.sqrt(max(0.0, 2 - 2 * least))
                        meets = (near >= reach - 1e-9) & (most[:, None] - near <= apart + 1e-9)
                        meets[np.flatnonzero(home), first[home]] = False
                        i, k = np.nonzero(meets)
                        sides.append((rows[i], k, True))
                    for i, k, guest in sides:
                        columns = [batch.column("node").take(pa.array(i)), batch.column("raw").take(pa.array(i)), pa.array(places[size][k], pa.int32()), pa.array(np.full(len(i), guest))]
                        yield pa.RecordBatch.from_arrays(columns[: len(names)], names)

    return nodes.select("node", "raw").mapInArrow(run, "node bigint, raw binary, crowd int" + ("" if least is None else ", guest boolean"))


def joined_by_all(x: np.ndarray, least: float, first: int | None = None) -> np.ndarray:
    """For each row of ``x`` the smallest row that pairs at ``least`` join it with: of all pairs, or of those of one of the
    ``first`` rows and one of the others. A stripe at a time, so that no more than 128 rows' pairs are held."""
    label, end, start = np.arange(len(x)), len(x) if first is None else first, first or 0
    for at in range(0, end, 128):
        a, b = np.nonzero(x[at : min(at + 128, end)] @ x[start:].T >= least)
        a, b = label[a + at], label[b + start]
        apart = a != b
        label = united(len(x), a[apart], b[apart])[label]
    return label


def block_pairs(members: DataFrame, kind: type, least: float) -> DataFrame:
    """(a, b): pairs of nodes that links connect, from all pairs of each crowd of ``members`` (node, raw, crowd, guest, blocks,
    guest_blocks) but those of two guests. Each of its blocks meets itself and each other one, two in a task at a time; a
    node is joined with one other a meeting at most. Links of the crowd and these pairs have the same components."""
    m = members.withColumn("own", F.expr("IF(guest, blocks + pmod(xxhash64(node), guest_blocks), pmod(xxhash64(node), blocks))").cast("int"))
    m = m.withColumn("other", F.explode(F.expr("sequence(0, IF(guest, blocks, blocks + guest_blocks) - 1)")))
    low, high = F.least("own", "other"), F.greatest("own", "other")
    met = m.select(F.concat_ws(":", "crowd", low, high).alias("meeting"), (F.col("own") != low).alias("later"), (low == high).alias("same"), "node", "raw")

    def pairs(rows):
        node = np.array([r[2] for r in rows])
        first = None if rows[0][1] else sum(not r[0] for r in rows)
        label = joined_by_all(np.stack([directed(np.frombuffer(r[3], kind)) for r in rows]), least, first)
        moved = np.flatnonzero(label != np.arange(len(node)))
        return pa.RecordBatch.from_arrays([pa.array(node[moved], pa.int64()), pa.array(node[label[moved]], pa.int64())], ["a", "b"])

    def run(batches):
        now, rows = None, []
        for batch in batches:
            for meeting, *row in zip(*(batch.column(c).to_pylist() for c in ("meeting", "later", "same", "node", "raw")), strict=True):
                if meeting != now:
                    if rows:
                        yield pairs(rows)
                    now, rows = meeting, []
                rows.append(row)
        if rows:
            yield pairs(rows)

    return met.repartition("meeting").sortWithinPartitions("meeting", "later").mapInArrow(run, "a bigint, b bigint")


def crowded_pairs(nodes: DataFrame, kind: type, least: float, total: int, width: int, seed: int) -> DataFrame | None:
    """(a, b): pairs of nodes that links connect, from all pairs with a node in a crowd, whatever its size; None without crowds.
    The work grows with the square of a crowd, a task's memory does not grow with it."""
    leaders = crowds(nodes, kind, total, seed)
    if not leaders:
        return None
    members = written(crowd_of(nodes, kind, leaders, least), "crowds")
    sizes = members.groupBy("crowd").agg(F.count_if(~F.col("guest")).alias("members"), F.count_if("guest").alias("guests"))  # a row a leader
    components = F.element_at(F.array([F.lit(len(x)) for x in leaders]), F.col("crowd") + 1)
    wider = F.greatest(F.lit(CROWD_BLOCK), F.least(F.lit(WIDE * CROWD_BLOCK), F.floor(COMPONENTS / components)))
    rows = F.when(F.col("members") + F.col("guests") > CROWD_BLOCK * CROWD_BLOCKS, wider).otherwise(CROWD_BLOCK)
    blocks = sizes.where("members > 0").select("crowd", F.ceil(F.col("members") / rows).cast("int").alias("blocks"), F.ceil(F.col("guests") / rows).cast("int").alias("guest_blocks"))
    return block_pairs(members.join(F.broadcast(blocks), "crowd"), kind, least)


def count_links(members: DataFrame, kind: type, least: float, block: int = BLOCK) -> DataFrame:
    """(node, near): to how many copies of other vectors of its component each node of ``members`` (component, node,
    weight, raw) is linked; ``weight`` counts the copies of a node. A component is cut into blocks by the hash of the node
    and each block meets each other one, so no task holds more than about two blocks of it at a time; pairs are
    counted, not returned."""
    sized = members.groupBy("component").agg(F.count("*").alias("n")).where("n > 1")
    m = members.join(sized, "component").withColumn("blocks", F.ceil(F.col("n") / block).cast("int")).withColumn("own", F.expr("pmod(xxhash64(node), blocks)").cast("int"))
    m = m.withColumn("other", F.explode(F.expr("sequence(0, blocks - 1)"))).withColumns({"low": F.least("own", "other"), "high": F.greatest("own", "other")})
    # One text as the key: a component's meetings are dealt out by all three, not by the component alone.
    met = m.select(F.concat_ws(":", "component", "low", "high").alias("meeting"), (F.col("own") == F.col("low")).alias("first"), (F.col("low") == F.col("high")).alias("same"), "node", "weight", "raw")

    def counts(rows):
        left = [r for r in rows if r[0]]
        right = left if rows[0][1] else [r for r in rows if not r[0]]
        if not left or not right:
            return
        x, y = (np.stack([directed(np.frombuffer(r[4], kind)) for r in side]) for side in (left, right))
        (n, m), (wx, wy) = ([np.array([r[2] for r in side]) for side in (left, right)], [np.array([r[3] for r in side]) for side in (left, right)])
        back = np.zeros(len(m), np.int64)
        for at in range(0, len(n), 512):
            near = (x[at : at + 512] @ y.T >= least) & (n[at : at + 512, None] != m[None])
            yield n[at : at + 512], near @ wy
            back += wx[at : at + 512] @ near
        if not rows[0][1]:
            yield m, back

    def run(batches):
        now, rows = None, []

        def done():
            for node, near in counts(rows):
                yield pa.RecordBatch.from_arrays([pa.array(node, pa.int64()), pa.array(near, pa.int64())], ["node", "near"])

        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("meeting", "first", "same", "node", "weight", "raw")]
            for meeting, *row in zip(*columns, strict=True):
                if meeting != now:
                    if rows:
                        yield from done()
                    now, rows = meeting, []
                rows.append(row)
        if rows:
            yield from done()

    counted = met.repartition("meeting").sortWithinPartitions("meeting").mapInArrow(run, "node bigint, near bigint")
    return counted.groupBy("node").agg(F.sum("near").alias("near"))


def near_duplicates(df: DataFrame, least: float = 0.95, passes: int | None = None, width: int = WIDTH, seed: int = 3) -> DataFrame:
    """vec_id, n_links, component_id, kept of every row of ``df`` (vec_id, embedding); other columns are not read.

    Without ``passes`` their number follows that of the vectors. Equal vectors (as unit vectors) are one node with a
    weight, so copies are never compared in pairs; they link with each other. Vectors without a direction link with
    nothing and are components of their own; so are vectors of different lengths to each other. A repeated vec_id is a
    row of its own that links like any other vector; null ids take part and name no component unless all of it is null.
    Empty input gives no rows.
    """
    kind = np.float32 if isinstance(df.schema["embedding"].dataType.elementType, T.FloatType) else np.float64
    rows = written(vectors(df), "vectors")
    nodes = rows.where("digest IS NOT NULL").groupBy("digest").agg(F.min("vec_id").alias("least"), F.count("*").alias("weight"), F.first("raw").alias("raw"))
    nodes = written(nodes.withColumn("node", F.monotonically_increasing_id()), "nodes")
    total = nodes.count()
    found = linked_pairs(nodes, kind, least, passes or pass_count(total, least, width), width, seed)
    crowded = crowded_pairs(nodes, kind, least, total, width, seed)
    found = found if crowded is None else found.unionByName(crowded)
    joined = written(connected_components(found, "a", "b"), "vector-components")
    near = count_links(nodes.join(joined, "node").select("component", "node", "weight", "raw"), kind, least)
    named = nodes.select("digest", "node", "least", "weight").join(joined, "node", "left").withColumn("component", F.coalesce("component", "node"))
    smallest = named.groupBy("component").agg(F.min("least").alias("component_id"))
    node_rows = named.join(smallest, "component").join(near, "node", "left").select("digest", (F.col("weight") - 1 + F.coalesce("near", F.lit(0))).alias("n_links"), "component_id")
    linked = rows.where("digest IS NOT NULL").select("vec_id", "digest").join(node_rows, "digest").select("vec_id", "n_links", "component_id")
    alone = rows.where("digest IS NULL").select("vec_id", F.lit(0).cast("bigint").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.unionByName(alone).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))
