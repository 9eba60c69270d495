"""Near-duplicate vectors by spherical-cap filters (operator 4).

0. Vectors are centred on their mean and whitened as far as their mean variance (a sum of products over all vectors gives both), so that
   vectors that lie around one direction, as real embeddings do, spread over the sphere. Filters work on these; links are judged on the vectors themselves.
1. Filter directions come from a structured random product code: after one random rotation the space is cut into two halves,
   each has a codebook of b random unit vectors, and the b * b directions are all pairs of codewords. A vector passes
   the filters whose direction it exceeds the cap's height on. They are list-decoded: scores of the halves are sorted, and
   only pairs of codewords that reach the height are visited.
2. Vectors that share a filter are compared exactly, as products of blocks of at most BLOCK vectors.

The height is set so that about BUCKET vectors pass each filter, whatever their number: by the share of the sphere that a
cap of it covers, for the vectors' own length. Hits within one code depend on each other, through the halves, so CODES independent codes are
used: a pair is lost only if it shares no filter of any of them. b grows (and where that does not help, the height falls) until at most MISSED of
PAIRS simulated pairs at the threshold are lost: vectors of the table, each with another at exactly the threshold from it in a random direction. So the
loss follows neither the number of vectors nor how they lie (measured: README).

Equal vectors are one class and are never compared with each other. A filter that more than BLOCK vectors pass is
compared in pairs of blocks, each a task of its own. A comparison hands over two numbers for each vector of a
block (how many it links with there, and the smallest vector of its component there), never its pairs; a pair is
counted under the smallest filter that both pass.

Defined cases: vectors that are null, empty, zero or hold null or non-finite components link with nothing, and so do
vectors of different lengths with each other. A null vec_id links with nothing and has a null component. Rows that repeat a
vec_id are one vector in components and several in counts of links, as long as the rows' vectors are equal.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.llm.common import connected_components, durable

BUCKET = 1024
CODES = 24
#: Pairs at the threshold that may be lost, and how many are simulated; closer pairs are lost far more rarely.
MISSED = 0.001
PAIRS = 4096
BLOCK = 2048
#: Products of a block are made for so many of its vectors at a time.
STRIPE = 512
#: Links of a block that are held before they are folded into components.
MOST_LINKS = 1 << 20
#: The largest share of the vectors in a filter, for small tables.
MOST_SHARE = 0.02
#: Filters that a vector passes on average, beyond which caps are widened instead of added.
MOST_FILTERS = 64
#: Shorter vectors are padded with zeros, as few dimensions have too few directions for a product code.
LEAST_DIMS = 32


def _tail(dims: int) -> tuple[np.ndarray, np.ndarray]:
    """Points, and the share of the unit sphere whose coordinate is above each."""
    # Cosines of even angles: fine steps where caps of many dimensions end, none lost at the poles.
    angle = np.linspace(np.pi, 0, 40_001)
    dense = np.sin(angle) ** (dims - 2)
    below = np.concatenate([[0.0], np.cumsum((dense[1:] + dense[:-1]) / 2)])
    return np.cos(angle), 1 - below / below[-1]


def units_of(v: np.ndarray) -> np.ndarray:
    x = v.astype(np.float64)
    x /= np.abs(x).max(axis=1)[:, None]
    return x / np.linalg.norm(x, axis=1)[:, None]


class Space:
    """Where filters work: unit vectors, centred, whitened as far as their mean variance, and made units again."""

    def __init__(self, n: int, total: np.ndarray, products: np.ndarray):
        self.mean = total / max(n, 1)
        spread = products / max(n, 1) - np.outer(self.mean, self.mean)
        values, axes = np.linalg.eigh(spread)
        level = max(float(values.mean()), 1e-12)
        self.turn = (axes * np.sqrt(2 * level / (np.maximum(values, 0) + level))) @ axes.T

    def __call__(self, units: np.ndarray) -> np.ndarray:
        x = (units - self.mean) @ self.turn
        size = np.linalg.norm(x, axis=1)[:, None]
        return np.where(size > 1e-12, x / np.maximum(size, 1e-12), units)


def missed(space: Space, sample: np.ndarray, height: float, b: int, least: float) -> float:
    """Share of pairs that no filter of any code holds: the sample's vectors, each with another at the threshold in a random direction."""
    n, dims = sample.shape
    y = np.random.default_rng([97, dims]).normal(size=(n, dims))
    y -= (sample * y).sum(axis=1)[:, None] * sample
    y = least * sample + math.sqrt(1 - least * least) * y / np.maximum(np.linalg.norm(y, axis=1)[:, None], 1e-12)
    one, two = space(sample), space(y)
    found = np.zeros(n, bool)
    for c in range(CODES):
        code = Code(dims, height, b, 41 + c)
        for s in range(0, n, 256):
            own = s + np.flatnonzero(~found[s : s + 256])
            p, q = (row * b * b + f for row, f in (code.decode(v[own]) for v in (one, two)))
            found[own[np.intersect1d(p, q, assume_unique=True) // (b * b)]] = True
    return 1 - float(found.mean())


def plan(n: int, least: float, space: Space, sample: np.ndarray) -> tuple[float, int]:
    """Height of the caps, in standard deviations of a score, and codewords of each half, for n vectors of which these are a sample (repeated to PAIRS)."""
    dims = max(sample.shape[1], LEAST_DIMS)
    at, above = _tail(dims)
    low = float(np.interp(-min(MOST_SHARE, BUCKET / max(n, 1)), -above, at)) * math.sqrt(dims)
    sample = np.resize(sample, (PAIRS, sample.shape[1]))
    b = start = 2
    while missed(space, sample, low, b, least) > MISSED:
        b = max(b + 1, math.ceil(b * 1.15))
        if b > max(64, 4 * start) and b * b * CODES * min(MOST_SHARE, BUCKET / max(n, 1)) > MOST_FILTERS:
            # More directions no longer help: wider caps do, up to the whole sphere.
            low, b = low - 0.25, start
    return low, b


class Code:
    """The product code for vectors of a length."""

    def __init__(self, dims: int, height: float, b: int, seed: int = 41):
        dims = max(dims, LEAST_DIMS)
        draw = np.random.default_rng([seed, dims])
        self.turn = np.linalg.qr(draw.normal(size=(dims, dims)))[0]
        self.half, self.b = dims // 2, b
        self.books = []
        for d in (self.half, dims - self.half):
            c = draw.normal(size=(b, d))
            self.books.append(c / np.maximum(np.linalg.norm(c, axis=1), 1e-12)[:, None] * math.sqrt(d / dims) if d else np.zeros((b, 0)))
        self.height = height / math.sqrt(dims)

    def decode(self, units: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, filter) for all filters that the unit vectors exceed."""
        turned = units @ self.turn[: units.shape[1]]
        one, two = turned[:, : self.half] @ self.books[0].T, turned[:, self.half :] @ self.books[1].T
        order = np.argsort(-two, axis=1)
        two = -np.take_along_axis(two, order, axis=1)  # ascending
        row, i = np.nonzero(one >= self.height + two[:, :1])
        # For each codeword of the first half, the prefix of the second half's sorted scores that reaches the height.
        step = 8.0
        flat = (two + step * np.arange(len(two))[:, None]).ravel()
        n = np.searchsorted(flat, one[row, i] - self.height + step * row, "right") - row * self.b
        row_of, first = np.repeat(row, n), np.repeat(i, n)
        place = np.arange(len(row_of)) - np.repeat(np.cumsum(n) - n, n)
        return row_of, first * self.b + order[row_of, place]


def _vectors(batch: pa.RecordBatch, column: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(dims, rows, vectors) of a batch, some hundred vectors of one length at a time."""
    lengths = batch.column(column).value_lengths().to_numpy(zero_copy_only=False)
    for dims in np.unique(lengths):
        at = np.flatnonzero(lengths == dims)
        for s in range(0, len(at), 512):
            own = at[s : s + 512]
            yield int(dims), own, batch.column(column).take(pa.array(own)).flatten().to_numpy(zero_copy_only=False).reshape(len(own), dims)


def _moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each length: number of vectors, and the sums of the units and of their products."""
    sums: dict[int, list] = {}
    for batch in batches:
        for dims, _, v in _vectors(batch, 0):
            x = units_of(v)
            n, total, products = sums.setdefault(dims, [0, np.zeros(dims), np.zeros((dims, dims))])
            sums[dims] = [n + len(x), total + x.sum(axis=0), products + x.T @ x]
    for dims, (n, total, products) in sums.items():
        yield pa.RecordBatch.from_arrays([pa.array([dims], pa.int32()), pa.array([n], pa.int64()), pa.array([total.tobytes()], pa.binary()), pa.array([products.tobytes()], pa.binary())], ["dims", "n", "total", "products"])


def _assign(sent):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes: dict[int, list[Code]] = {}
        for batch in batches:
            ids, copies = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            for dims, own, v in _vectors(batch, 2):
                space, height, b = sent.value[dims]
                if dims not in codes:
                    codes[dims] = [Code(dims, height, b, 41 + c) for c in range(CODES)]
                seen = space(units_of(v))
                parts = [code.decode(seen) for code in codes[dims]]
                row, f = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] + c * b * b for c, p in enumerate(parts)])
                if not len(row):
                    continue
                order = np.lexsort((f, row))
                row, f = row[order], f[order].astype(np.int32)
                first = np.searchsorted(row, row)
                raw = [x.tobytes() for x in v]
                # With a filter go the smaller ones that the vector passes too: a pair is counted under the smallest that it shares.
                before = [f[a:i].tobytes() for i, a in enumerate(first)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(row), dims), pa.int32()), pa.array(f, pa.int32()), pa.array(ids[own][row]), pa.array(copies[own][row]), pa.array([raw[r] for r in row], pa.binary()), pa.array(before, pa.binary())],
                    ["dims", "filter", "rep", "copies", "v", "before"],
                )

    return run


def _components(n: int, u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """The smallest place that each place reaches over the links (u, v)."""
    low = np.arange(n)
    while True:
        now = low.copy()
        np.minimum.at(now, u, low[v])
        np.minimum.at(now, v, low[u])
        # The places themselves follow, and with them all that hangs on them.
        np.minimum.at(now, low, now)
        now = now[now]
        if (now == low).all():
            return low
        low = now


def _compare(least: float, kind: str):
    def run(key, table):
        i_block, j_block = key[2].as_py(), key[3].as_py()
        ids, copies, side = (table.column(c).to_numpy() for c in ("rep", "copies", "side"))
        order = np.argsort(ids)
        ids, copies, side = ids[order], copies[order], side[order]
        v = table.column("v").to_pylist()
        x = units_of(np.frombuffer(b"".join(v), kind).reshape(len(ids), -1)[order])
        lists = [np.frombuffer(f, np.int32) for f in table.column("before").to_pylist()]
        del v
        # Smaller filters as rows of equal length; the fill differs on both sides of a comparison.
        width = max(1, max(map(len, lists)))
        before = np.full((len(ids), width), -1, np.int32)
        for place, i in enumerate(order):
            before[place, : len(lists[i])] = lists[i]
        rows = np.flatnonzero(side == i_block)
        cols = rows if i_block == j_block else np.flatnonzero(side == j_block)
        n_links, links = np.zeros(len(ids), np.int64), []
        low = np.arange(len(ids))
        for s in range(0, len(rows), STRIPE):
            r, c = np.nonzero(x[rows[s : s + STRIPE]] @ x[cols].T >= least)
            r, c = rows[s : s + STRIPE][r], cols[c]
            if i_block == j_block:
                r, c = r[r < c], c[r < c]
            links.append((r, c))
            if sum(len(p[0]) for p in links) > MOST_LINKS:
                low = _joined(len(ids), low, links)
                links = []
            for t in range(0, len(r), 1 << 16):
                a, z = r[t : t + (1 << 16)], c[t : t + (1 << 16)]
                again = np.zeros(len(a), bool)
                for k in range(width):
                    own = before[a, k]
                    again |= (own >= 0) & (before[z] == own[:, None]).any(axis=1)
                a, z = a[~again], z[~again]
                np.add.at(n_links, a, copies[z])
                np.add.at(n_links, z, copies[a])
        low = ids[_joined(len(ids), low, links)]
        keep = (n_links > 0) | (low != ids)
        return pa.table({"rep": pa.array(ids[keep]), "n_links": pa.array(n_links[keep]), "low": pa.array(low[keep])})

    return run


def _joined(n: int, low: np.ndarray, links: list) -> np.ndarray:
    """Components of what was joined before and of new links."""
    u, v = (np.concatenate([np.arange(n) if k == 0 else low, *(p[k] for p in links)]) for k in (0, 1))
    return _components(n, u, v)


def near_duplicates(vectors: DataFrame, least: float = 0.95) -> DataFrame:
    """Per row of vectors (vec_id, embedding): vec_id, n_links, component_id, kept.

    Links vectors whose cosine in double precision is at least ``least``.
    """
    if not 0 < least < 1:
        raise ValueError("the least cosine must lie between 0 and 1")
    kind = vectors.schema["embedding"].dataType.elementType.simpleString()
    dtype = {"float": "float32", "double": "float64"}[kind]
    sound = F.coalesce(F.expr(f"vec_id is not null and size(embedding) > 0 and forall(embedding, x -> x is not null and not isnan(x) and abs(x) < cast('infinity' as {kind})) and exists(embedding, x -> x <> 0)"), F.lit(False))
    # Zero is written one way, so that equal vectors have equal text.
    plain = F.expr(f"transform(embedding, x -> if(x = 0, cast(0 as {kind}), x))")
    rows = vectors.select("vec_id", F.when(sound, F.md5(F.array_join(plain.cast("array<string>"), ","))).alias("same"), "embedding")
    classes = durable(
        rows.where("same is not null").groupBy("same").agg(F.min("vec_id").alias("rep"), F.count("*").alias("copies"), F.min_by("embedding", "vec_id").alias("embedding")), "vectors"
    )
    # Filters hold vectors of one length, so each length has a space and a plan of its own. What the driver gets follows the lengths, not the vectors.
    moments = classes.select("embedding").mapInArrow(_moments, "dims int, n long, total binary, products binary").collect()
    sums: dict[int, list] = {}
    for r in moments:
        n, total, products = sums.get(r.dims, (0, 0, 0))
        sums[r.dims] = [n + r.n, total + np.frombuffer(r.total), products + np.frombuffer(r.products).reshape(r.dims, r.dims)]
    plans = {}
    for dims, (n, total, products) in sorted(sums.items()):
        space = Space(n, total, products)
        share = min(1.0, 1.5 * PAIRS / n)
        own = classes.where((F.size("embedding") == dims) & (F.pmod(F.xxhash64("rep"), F.lit(1 << 30)) < int(share * (1 << 30)))).select("rep", "embedding").orderBy("rep").limit(PAIRS).collect()
        plans[dims] = (space, *plan(n, least, space, units_of(np.array([r.embedding for r in own] or [[1.0] * dims]))))
    sent = vectors.sparkSession.sparkContext.broadcast(plans)
    passed = classes.select("rep", "copies", "embedding").repartition("rep").mapInArrow(_assign(sent), "dims int, filter int, rep long, copies long, v binary, before binary")
    sizes = passed.groupBy("dims", "filter").agg(F.count("*").alias("n")).where("n > 1").select("dims", "filter", F.ceil(F.col("n") / BLOCK).cast("int").alias("g"))
    side = passed.join(sizes, ["dims", "filter"]).withColumn("side", F.pmod(F.xxhash64("rep"), "g").cast("int"))
    blocks = side.withColumn("o", F.explode(F.sequence(F.lit(0), F.col("g") - 1))).select("dims", "filter", F.least("side", "o").alias("i"), F.greatest("side", "o").alias("j"), "side", "rep", "copies", "v", "before")
    found = durable(blocks.groupBy("dims", "filter", "i", "j").applyInArrow(_compare(least, dtype), "rep long, n_links long, low long"), "links")
    counts = found.groupBy("rep").agg(F.sum("n_links").alias("others"))
    roots = connected_components(found.select(F.col("rep").alias("u"), F.col("low").alias("v")))
    whole = classes.select("same", "rep", "copies").join(counts, "rep", "left").join(roots.withColumnRenamed("node", "rep"), "rep", "left")
    whole = whole.select("same", (F.col("copies") - 1 + F.coalesce("others", F.lit(0))).alias("n_links"), F.coalesce("root", "rep").alias("root"))
    out = rows.select("vec_id", "same").join(whole, "same", "left")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("root", "vec_id").alias("component_id")).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))
