"""Exact removal of repeated word windows, behind a count-min prefilter (operator 8).

0. Copies: a text that a smaller document has as well is covered by that document's windows, whole; it is left out of
   the next steps. Its smallest document stands for it.
1. Sketch: every task counts its window hashes in DEPTH rows of cells, once for each document, and hands over
   only which cells it saw once and which more often, by pieces of the rows. Pieces are merged over all tasks.
   A cell seen by two documents is full. The merged sketch overestimates: a repeated window's cells are all full.
2. Windows whose cells are all full go to an exact pass that groups them by a 128-bit hash and finds the
   smallest document of each. A window that is not repeated but has full cells drops out here; no
   repeated one is lost, however full the sketch is.
3. Words covered by a window that also starts in a document with a smaller id are removed.

The sketch has twice as many cells a row as there are windows, up to MOST_CELLS, so what is broadcast is at most
DEPTH * MOST_CELLS / 8 = 128 MB; beyond about 270 million windows more windows go to the exact pass, which is an
ordinary distributed aggregation and join.

Defined cases: null and blank texts have no words and hash the empty string. A document with a null doc_id
neither loses nor removes anything; rows with the same doc_id do not remove from each other. Repeated rows
get equal results. Texts shorter than a window lose nothing.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.llm.common import durable, partitions, small_side, text_bytes
from barloom.llm.grams import U, run_hashes, slices

DEPTH = 2
LEAST_CELLS, MOST_CELLS = 1 << 16, 1 << 29
PIECE = 1 << 20
#: A task hands its cells over after so many windows, which bounds its memory.
FLUSH = 2 << 20
#: Texts that are Python objects at a time, and windows that a task hands over at once.
ROWS, PIECE_ROWS = 100, 1 << 16
#: Stands for all windows of a text.
WHOLE = -1


def cells_for(docs: DataFrame) -> int:
    """Cells in a row of the sketch: twice the words, estimated from the bytes, in whole pieces; so it is equally full at every size."""
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    unit = PIECE if size / 3 >= PIECE else LEAST_CELLS
    return min(MOST_CELLS, max(LEAST_CELLS, -(-size // 3 // unit) * unit))


def _cells(h: np.ndarray, row: int, cells: int) -> np.ndarray:
    out = h * U((0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)[row])
    out >>= U(32)
    out *= U(cells)
    out >>= U(32)
    return out.astype(np.uint32)


def _packed(sorted_cells: np.ndarray) -> bytes:
    """Gaps between sorted cells as bytes, 255 for each 255 skipped, compressed."""
    gaps = np.diff(sorted_cells.astype(np.int64), prepend=-1) - 1
    more = gaps // 255
    out = np.full(int(more.sum()) + len(gaps), 255, np.uint8)
    out[np.cumsum(more + 1) - 1] = gaps % 255
    return zstandard.ZstdCompressor(level=1).compress(out.tobytes())


def _unpacked(data: bytes) -> np.ndarray:
    gaps = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8)
    ends = gaps != 255
    at = np.cumsum(gaps.astype(np.int64))[ends]
    return at + np.arange(len(at))


def _count(width: int, cells: int):
    size = min(PIECE, cells)

    def rows(found: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        every = np.concatenate(found) if found else np.empty(0, U)
        for row in range(DEPTH):
            at = _cells(every, row, cells)
            at.sort()
            once = np.ones(len(at), bool)
            once[1:] = at[1:] != at[:-1]
            again = np.unique(at[~once])
            at = at[once]
            edges = np.arange(0, cells + size, size)
            for (values, twice) in ((at, False), (again, True)):
                cut = np.searchsorted(values, edges)
                for piece in np.flatnonzero(cut[1:] > cut[:-1]):
                    yield pa.RecordBatch.from_pydict({"row": pa.array([row], pa.int32()), "piece": pa.array([int(piece)], pa.int32()), "twice": [twice], "cells": [_packed(values[cut[piece] : cut[piece + 1]] - np.uint32(piece * size))]})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, n = [], 0
        for batch in slices(batches, ROWS):
            for text in batch.column(0):
                _, h, _ = run_hashes(text.as_py(), width)
                if len(h):
                    found.append(np.unique(h))
                    n += len(found[-1])
                    if n >= FLUSH:
                        yield from rows(found)
                        found, n = [], 0
        yield from rows(found)

    return run


def _merge(cells: int):
    """Of pieces that lie together in a partition: which cells are full."""
    size = min(PIECE, cells)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, one, full = None, None, None

        def done():
            return pa.RecordBatch.from_pydict({"row": pa.array([now[0]], pa.int32()), "piece": pa.array([now[1]], pa.int32()), "full": [zstandard.ZstdCompressor(level=1).compress(np.packbits(full).tobytes())]})

        for batch in batches:
            for row, piece, twice, packed in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if now != (row, piece):
                    if now:
                        yield done()
                    now, one, full = (row, piece), np.zeros(size, bool), np.zeros(size, bool)
                at = _unpacked(packed)
                if twice:
                    full[at] = True
                else:
                    full[at] |= one[at]
                    one[at] = True
        if now:
            yield done()

    return run


def sketch(docs: DataFrame, width: int, cells: int) -> DataFrame:
    """row, piece, full: the merged sketch's full cells as compressed bits."""
    parts = docs.select(text_bytes(F.col("text")).alias("b")).mapInArrow(_count(width, cells), "row int, piece int, twice boolean, cells binary")
    return parts.repartition(partitions(docs), "row", "piece").sortWithinPartitions("row", "piece", "twice").mapInArrow(_merge(cells), "row int, piece int, full binary")


def _repeated(width: int, cells: int, sent):
    """Windows whose cells are all full, the first of each in its document, handed over in bounded pieces."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # The merged sketch as bits, one array for each row, as the broadcast holds it: a worker has no second copy.
        rows, out, n = sent.value, [], 0

        def done():
            return pa.RecordBatch.from_arrays([pa.array(np.concatenate(c).view(np.int64)) for c in zip(*out, strict=True)], ["doc_id", "h", "g", "at"])

        for batch in slices(batches, ROWS):
            ids, keys = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            for i, text in enumerate(batch.column(2)):
                _, h, g = run_hashes(text.as_py(), width)
                full = np.ones(len(h), bool)
                for row, bits in enumerate(rows):
                    c = _cells(h, row, cells)
                    full &= (bits[c >> np.uint32(3)] >> (np.uint32(7) - (c & np.uint32(7))).astype(np.uint8)) & 1 == 1
                at = np.flatnonzero(full)
                if len(at):
                    at = at[np.unique(_both(h[at], g[at]), return_index=True)[1]]
                    out.append((np.full(len(at), ids[i]), h[at], g[at], at + (keys[i] << 32)))
                    n += len(at)
                if n >= PIECE_ROWS:
                    yield done()
                    out, n = [], 0
        if out:
            yield done()

    return run


def _both(h: np.ndarray, g: np.ndarray) -> np.ndarray:
    """Hashes as values of 128 bits that can be compared."""
    return np.stack([h, g], axis=1).view("V16").ravel()


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Lists of positions as their runs: pairs of the first and last, packed, as most windows to remove follow one another."""
    for batch in batches:
        out = []
        for row in batch.column(2):
            at = np.sort(row.values.to_numpy(zero_copy_only=False))
            ends = np.flatnonzero(np.diff(at) != 1)
            out.append(np.stack([at[np.append(0, ends + 1)], at[np.append(ends, len(at) - 1)]], axis=1).astype(np.int32).tobytes())
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.binary())], ["doc_id", "key", "at"])


def _positions(runs: bytes) -> np.ndarray:
    pairs = np.frombuffer(runs, np.int32).reshape(-1, 2)
    return np.concatenate([np.arange(a, z + 1) for a, z in pairs])


def _remove(width: int):
    """Words left of each text: given the first positions of the windows to remove."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, ROWS):
            texts, marks = batch.column(1).to_pylist(), {i: _positions(m) for i, m in enumerate(batch.column(2).to_pylist()) if m}
            todo = [i for i, m in marks.items() if m[0] != WHOLE]
            gone = {}
            for i in (i for i, m in marks.items() if m[0] == WHOLE):
                n = len(texts[i].split())
                gone[i] = np.full(n, n >= width)
            for i in todo:
                n, h, g = run_hashes(texts[i], width)
                both = _both(h, g)
                begins = np.flatnonzero(np.isin(both, both[marks[i]]))
                edge = np.zeros(n + 1, np.int64)
                np.add.at(edge, begins, 1), np.add.at(edge, begins + width, -1)
                gone[i] = np.cumsum(edge)[:n] > 0
            n_words, n_removed, kept = [], [], []
            for i, t in enumerate(texts):
                words = t.split()
                n_words.append(len(words))
                n_removed.append(int(gone[i].sum()) if i in gone else 0)
                if n_removed[-1]:
                    words = [w for w, g in zip(words, gone[i], strict=True) if not g]
                kept.append(b" ".join(words))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(kept, pa.binary())], ["doc_id", "n_words", "n_removed", "kept"])

    return run


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        digest = pa.array([hashlib.sha256(t).hexdigest() for t in batch.column(3).to_pylist()], pa.string())
        yield pa.RecordBatch.from_arrays([*batch.columns[:3], digest], ["doc_id", "n_words", "n_removed", "kept_sha256"])


def _key():
    """Tells texts apart that share a doc_id."""
    return F.shiftright(F.xxhash64("text"), 33).alias("key")


def copies(docs: DataFrame) -> DataFrame:
    """(doc_id, key) of texts that a document with a smaller id has as well. Only digests are shuffled; equal ones combine before that."""
    rows = docs.where("doc_id is not null and text is not null").select("doc_id", _key(), F.unhex(F.md5("text")).alias("same"))
    several = rows.groupBy("same").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high")).where("low < high").select("same", "low")
    return rows.join(several, "same").where("doc_id > low").select("doc_id", "key").distinct()


def removals(docs: DataFrame, width: int) -> DataFrame:
    """(doc_id, key, at): for each text the first positions of windows that start in a smaller document, or WHOLE for copies, as packed runs."""
    spark = docs.sparkSession
    again = durable(copies(docs), "copies")
    docs = docs.select("doc_id", "text", _key()).join(small_side(again), ["doc_id", "key"], "left_anti")
    cells = cells_for(docs)
    bits, size = [np.zeros(cells // 8, np.uint8) for _ in range(DEPTH)], min(PIECE, cells) // 8
    for row, piece, full in sketch(docs, width, cells).collect():  # at most DEPTH * MOST_CELLS bits
        bits[row][piece * size : (piece + 1) * size] = np.frombuffer(zstandard.ZstdDecompressor().decompress(full), np.uint8)
    sent = spark.sparkContext.broadcast(bits)
    rows = docs.where("doc_id is not null").select("doc_id", "key", text_bytes(F.col("text")).alias("b"))
    found = rows.mapInArrow(_repeated(width, cells, sent), "doc_id long, h long, g long, at long")
    least = found.groupBy("h", "g").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high")).where("low < high").select("h", "g", "low")
    later = found.join(least, ["h", "g"]).where("doc_id > low")
    marks = later.groupBy("doc_id", F.shiftright("at", 32).alias("key")).agg(F.collect_set(F.col("at").bitwiseAND(F.lit(0xFFFFFFFF))).alias("at"))
    every = marks.unionByName(again.withColumn("at", F.array(F.lit(WHOLE).cast("long"))))
    return every.mapInArrow(_runs, "doc_id long, key long, at binary")


def remove_repeats(docs: DataFrame, width: int = 13) -> DataFrame:
    """Per row of docs (doc_id, text): doc_id, n_words, n_removed and kept (UTF-8 of the words left)."""
    marks = small_side(durable(removals(docs, width), "removals"))
    rows = docs.select("doc_id", _key(), text_bytes(F.col("text")).alias("b")).join(marks, ["doc_id", "key"], "left")
    return rows.select("doc_id", "b", "at").mapInArrow(_remove(width), "doc_id long, n_words long, n_removed long, kept binary")


def removal_digests(docs: DataFrame, width: int = 13) -> DataFrame:
    """As remove_repeats, with the SHA-256 of the words left instead of the words."""
    return remove_repeats(docs, width).mapInArrow(_digest, "doc_id long, n_words long, n_removed long, kept_sha256 string")
