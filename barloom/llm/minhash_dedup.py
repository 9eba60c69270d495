"""Near-duplicate documents by MinHash, with odd sketches for the banded candidates (operator 10).

1. One pass over the texts hashes the distinct word shingles of each document, takes PERMUTATIONS minima and
   folds them into a parity bitmap (the odd sketch); a second bitmap folds the whole set, where it is small enough for that.
   Texts leave that pass as a few hundred bytes each.
2. Documents with equal shingle sets are one class, so exact copies never meet as pairs.
3. Classes that share a band of minima are candidates. Each class is first paired with one class only, so that
   a band with thousands of members yields no more pairs than members. The population count of two sketches' XOR estimates how similar
   the two are; pairs far below the threshold go, and of the rest of a class the most similar one stays.
4. Pairs are confirmed on the full shingle sets of the two texts, and components are formed.
5. Bands whose members lie in several components are looked at again, in blocks. By the bitmaps of the whole sets a block is
   joined to as few components as they allow, each join by the most similar pair at hand; again a member names a few pairs at most.
6. In what is then left in different components, all pairs of a band are compared by their bitmaps, and those that come near the threshold
   are confirmed. Nothing is left out: a pair of a band either lies in one component, or has been compared.

Defined cases: null, empty and blank texts have an empty set and no links. A null doc_id has no links and a
null component. Rows that share a doc_id are one document whose links are merged. Repeated rows count once.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.llm.common import connected_components, durable, text_bytes
from barloom.llm.grams import U, mix, run_hashes, slices

BANDS, ROWS = 28, 4
PERMUTATIONS = BANDS * ROWS
SKETCH_BITS = 256
#: A pair whose estimated similarity is this far below the threshold is not compared in full: about five
#: standard deviations of the estimate at the threshold.
MARGIN = 0.4
#: The whole set is folded into a bitmap of its own if it has at most so many shingles; its estimate is within
#: CLOSE of the true similarity, by five standard deviations of the largest sets.
WHOLE_BITS, MOST_WHOLE, CLOSE = 2048, 1500, 0.035
#: Members of a band that are compared with each other in one task.
BLOCK = 4096


def _signatures(k: int):
    """From Arrow batches of (doc_id, bytes): doc_id, n, set digest, bands, sketch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        draw = np.random.default_rng(103)
        times = (draw.integers(0, 1 << 62, PERMUTATIONS).astype(U) * U(2) + U(1))[:, None]
        plus = draw.integers(0, 1 << 62, PERMUTATIONS).astype(U)[:, None]
        band_seed = mix(np.arange(1, BANDS + 1).astype(U))
        for batch in slices(batches):
            ids, n_set, digests, bands, sketches, wholes = batch.column(0), [], [], [], [], []
            for text in batch.column(1):
                _, one, two = run_hashes(text.as_py().lower(), k, whole_if_short=True)
                one, at = np.unique(one, return_index=True)
                n_set.append(len(one))
                if not len(one):
                    digests.append(None), bands.append(None), sketches.append(None), wholes.append(None)
                    continue
                # Equal digests are equal sets: of all shingles' 128 bits, in order.
                digests.append(hashlib.blake2b(one.tobytes() + two[at].tobytes(), digest_size=32).digest())
                low = np.full(PERMUTATIONS, ~U(0))
                for i in range(0, len(one), 2048):
                    np.minimum(low, (one[None, i : i + 2048] * times + plus).min(axis=1), out=low)
                bit = mix(low + np.arange(PERMUTATIONS).astype(U) * U(0x9E3779B97F4A7C15)) % U(SKETCH_BITS)
                odd = np.bincount(bit.astype(np.int64), minlength=SKETCH_BITS) & 1
                sketches.append(np.packbits(odd.astype(np.uint8)).tobytes())
                if len(one) <= MOST_WHOLE:
                    odd = np.bincount((mix(one) % U(WHOLE_BITS)).astype(np.int64), minlength=WHOLE_BITS) & 1
                    wholes.append(np.packbits(odd.astype(np.uint8)).tobytes())
                else:
                    wholes.append(b"")
                band = band_seed.copy()
                for r in range(ROWS):
                    band = mix(band ^ low[r::ROWS])
                bands.append(band.view(np.int64))
            yield pa.RecordBatch.from_arrays(
                [ids, pa.array(n_set, pa.int64()), pa.array(digests, pa.binary()), pa.array(bands, pa.list_(pa.int64())), pa.array(sketches, pa.binary()), pa.array(wholes, pa.binary())],
                ["doc_id", "n_shingles", "digest", "bands", "sketch", "whole"],
            )

    return run


def signatures(docs: DataFrame, k: int) -> DataFrame:
    """doc_id, n_shingles, digest of the set, bands, odd sketch and bitmap of the whole set of each row; null where the set is empty."""
    return docs.select("doc_id", text_bytes(F.col("text")).alias("b")).mapInArrow(_signatures(k), "doc_id long, n_shingles long, digest binary, bands array<long>, sketch binary, whole binary")


def estimate(one, two):
    """Similarity estimated from two odd sketches given as longs: the XOR's population count d over n bits says
    that the samples differ in about -n/2 ln(1 - 2d/n) elements, of twice PERMUTATIONS."""
    d = sum((F.bit_count(a.bitwiseXOR(b)) for a, b in zip(one, two, strict=True)), F.lit(0))
    left = F.greatest(F.lit(1.0) - 2.0 * d / SKETCH_BITS, F.lit(1e-9))
    return F.lit(1.0) + SKETCH_BITS / (4.0 * PERMUTATIONS) * F.log(left)


def _longs(column: str) -> list:
    return [F.conv(F.hex(F.substring(column, 8 * i + 1, 8)), 16, -10).cast("long") for i in range(SKETCH_BITS // 64)]


def _similar(k: int, percent: int):
    """Keeps the pairs whose full sets reach the percentage."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: dict[int, frozenset] = {}

        def shingles(text: bytes) -> frozenset:
            if (found := kept.get(key := hash(text))) is not None and found[0] == text:
                return found[1]
            w = text.lower().split()
            made = frozenset([b" ".join(w[i : i + k]) for i in range(len(w) - k + 1)] if len(w) >= k else [b" ".join(w)] if w else [])
            if len(kept) >= 16:
                kept.pop(next(iter(kept)))
            kept[key] = (text, made)
            return made

        for batch in slices(batches):
            u, v, a, b = (c.to_pylist() for c in batch.columns)
            keep = []
            for i in range(len(u)):
                x, y = shingles(a[i]), shingles(b[i])
                both = len(x & y)
                if both and 100 * both >= percent * (len(x) + len(y) - both):
                    keep.append(i)
            yield pa.RecordBatch.from_arrays([pa.array([u[i] for i in keep], pa.int64()), pa.array([v[i] for i in keep], pa.int64())], ["u", "v"])

    return run


def confirmed(pairs: DataFrame, docs: DataFrame, k: int, percent: int) -> DataFrame:
    """The pairs (u, v) whose whole texts are similar enough. Texts are shuffled once for both sides."""
    texts = docs.where("doc_id is not null").select("doc_id", text_bytes(F.col("text")).alias("b"))
    with_u = pairs.join(texts.withColumnsRenamed({"doc_id": "u", "b": "a"}), "u")
    with_v = with_u.join(texts.withColumnsRenamed({"doc_id": "v"}), "v")
    return with_v.select("u", "v", "a", "b").mapInArrow(_similar(k, percent), "u long, v long").distinct()


def _bits(column) -> np.ndarray:
    rows = column.to_pylist()
    return np.frombuffer(b"".join(rows), np.uint64).reshape(len(rows), -1)


def _across(percent: int, join: bool):
    """Pairs (u, v) of a block of a band that lie in different components and may reach the percentage.

    With ``join`` only such as join the block's components, first by pairs that surely reach it, then by one pair that may for each
    member; otherwise all of them.
    """

    def run(key, table):
        ids, roots, sides, sizes = (table.column(c).to_numpy() for c in ("rep", "root", "side", "n"))
        i_block, j_block = key[1].as_py(), key[2].as_py()
        _, part = np.unique(roots, return_inverse=True)
        whole = table.column("whole").to_pylist()
        small = np.array([len(w) > 0 for w in whole])
        coarse, fine = _bits(table.column("sketch")), _bits(pa.array([w or b"\0" * (WHOLE_BITS // 8) for w in whole], pa.binary()))

        def near(r: int, least: float) -> tuple[np.ndarray, np.ndarray]:
            """Members of other components than r's that may be so similar, and their estimates."""
            # The bounds on sizes are exact: more than the percentage cannot be shared otherwise.
            ok = (part != part[r]) & (100 * np.minimum(sizes, sizes[r]) >= percent * np.maximum(sizes, sizes[r]))
            cols = np.flatnonzero(ok & (sides != sides[r]) if i_block != j_block else ok)
            d = np.bitwise_count(coarse[cols] ^ coarse[r]).sum(axis=1, dtype=np.int64)
            alike = 1 + SKETCH_BITS / (4 * PERMUTATIONS) * np.log(np.maximum(1 - 2 * d / SKETCH_BITS, 1e-9))
            keep = alike >= percent / 100 - MARGIN
            cols, alike = cols[keep], alike[keep]
            both = small[cols] & small[r]
            at = cols[both]
            d = np.bitwise_count(fine[at] ^ fine[r]).sum(axis=1, dtype=np.int64)
            apart = -WHOLE_BITS / 2 * np.log(np.maximum(1 - 2 * d / WHOLE_BITS, 1e-9))
            total = sizes[at] + sizes[r]
            alike[both] = (total - apart) / (total + apart)
            keep = alike >= np.where(both, least, percent / 100 - MARGIN)
            return cols[keep], alike[keep]

        out: list[np.ndarray] = []
        for least in (percent / 100 + 0.01, percent / 100 - CLOSE) if join else (percent / 100 - CLOSE,):
            largest = np.argmax(np.bincount(part))
            for r in np.flatnonzero(part != largest):
                if join and part[r] == largest:
                    continue
                cols, alike = near(r, least)
                if not len(cols):
                    continue
                if join:
                    best = cols[np.lexsort((ids[cols], -alike))[0]]
                    out.append(np.array([[ids[r], ids[best]]]))
                    one, other = part[r], part[best]
                    # The largest keeps its number.
                    part[part == (one if other == largest else other)] = other if other == largest else one
                else:
                    out.append(np.stack([np.full(len(cols), ids[r]), ids[cols]], axis=1))
        pairs = np.unique(np.sort(np.concatenate(out), axis=1), axis=0) if out else np.empty((0, 2), np.int64)
        return pa.table({"u": pa.array(pairs[:, 0], pa.int64()), "v": pa.array(pairs[:, 1], pa.int64())})

    return run


def _still_apart(classes: DataFrame, roots: DataFrame, percent: int, join: bool) -> DataFrame:
    """What ``_across`` finds in the bands whose members lie in several components: u, v."""
    placed = classes.select("rep", "bands").join(roots.withColumnRenamed("node", "rep"), "rep", "left").select("rep", F.coalesce("root", "rep").alias("root"), "bands")
    members = placed.select("rep", "root", F.explode("bands").alias("band"))
    split = members.groupBy("band").agg(F.count("*").alias("k"), F.min("root").alias("a"), F.max("root").alias("z")).where("a <> z").select("band", F.ceil(F.col("k") / BLOCK).cast("int").alias("g"))
    slim = members.join(split, "band").withColumn("side", F.pmod(F.xxhash64("rep"), "g").cast("int"))
    rows = slim.join(classes.select("rep", "n", "sketch", "whole"), "rep")
    blocks = rows.withColumn("o", F.explode(F.sequence(F.lit(0), F.col("g") - 1))).select("band", F.least("side", "o").alias("i"), F.greatest("side", "o").alias("j"), "rep", "root", "side", "n", "sketch", "whole")
    return blocks.groupBy("band", "i", "j").applyInArrow(_across(percent, join), "u long, v long").distinct()


def near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """Per row of docs (doc_id, text): doc_id, n_shingles, component_id, kept.

    Links two documents whose sets of k-word shingles share at least the percentage of their union. The
    component is the smallest doc_id that links reach.
    """
    least = percent / 100 - MARGIN
    sig = durable(signatures(docs, k), "signatures")
    classes = durable(
        sig.where("digest is not null and doc_id is not null").groupBy("digest").agg(F.min_by(F.struct("bands", "sketch", "whole", "n_shingles"), "doc_id").alias("x"), F.min("doc_id").alias("rep")).select("digest", "rep", "x.bands", "x.sketch", "x.whole", F.col("x.n_shingles").alias("n")), "classes"
    )
    bands = classes.select("rep", F.explode("bands").alias("band"))
    low = bands.groupBy("band").agg(F.min("rep").alias("low"), F.count("*").alias("n")).where("n > 1")
    longs = classes.select("rep", F.array(*_longs("sketch")).alias("s"))
    pairs = bands.join(low, "band").where("rep <> low").select("rep", "low").distinct()
    n = SKETCH_BITS // 64
    near = estimate([F.col("s")[i] for i in range(n)], [F.col("t")[i] for i in range(n)])
    scored = pairs.join(longs, "rep").join(longs.withColumnsRenamed({"rep": "low", "s": "t"}), "low").withColumn("near", near).where(F.col("near") >= least)
    first = scored.groupBy("rep").agg(F.max_by("low", F.struct("near", -F.col("low"))).alias("u")).select("u", F.col("rep").alias("v"))
    first = durable(first, "pairs")
    links = durable(confirmed(first, docs, k, percent), "links")
    roots = connected_components(links)
    for join in (True, False):
        rest = durable(_still_apart(classes, roots, percent, join), "pairs")
        more = durable(confirmed(rest, docs, k, percent), "links")
        # Components so far stand for their links.
        roots = connected_components(more.unionByName(roots.select(F.col("node").alias("u"), F.col("root").alias("v"))))
    grouped = classes.select("digest", "rep").join(roots.withColumnRenamed("node", "rep"), "rep", "left").select("digest", F.coalesce("root", "rep").alias("component_id"))
    out = sig.select("doc_id", "n_shingles", "digest").join(grouped, "digest", "left")
    linked = F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id")).alias("component_id")
    return out.select("doc_id", "n_shingles", linked).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)))
