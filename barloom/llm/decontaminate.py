"""Benchmark passages in documents, by a distributed positional inverted index (operator 7).

0. The benchmark is taken in parts of about PART_BYTES, one after another, so that what is held at once does not grow with it: of a part the items as
   numbers of terms, and the places of their windows' rarest terms. Most benchmarks are one part.
1. Forward pass: every document becomes the list of the part's terms by number, zero for any other word.
2. How often each term occurs is counted over all documents. Each window of a benchmark item gets its RAREST
   terms; only those are looked up, so only their postings (term, document, position) are stored, as segments
   sorted by term, as the forward pass leaves them: nothing is shuffled by term, so a term in a third of
   all documents makes no hot task.
3. Look-up: a posting at position p of a term at offset o of an item says that the item would start at p - o.
   Postings of the rarest terms are intersected after that adjustment.
4. Where all rarest terms of a window agree, the forward list of the document is compared with the item, which gives
   the exact phrases.

``proximity_matches`` uses the same index for windows all of whose terms lie near each other in any order.

Defined cases: null, empty and wordless texts have no words and no hits; such items occur nowhere. Rows with the same
doc_id and text get equal results, as do repeated items; a null doc_id is one like any other. An item without an item_id hits words like any other, and is not
listed among the items. Very long texts are handled whole.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.llm.common import durable, small_side, text_bytes
from barloom.llm.grams import slices

RAREST = 3
#: Text of the benchmark that is looked up at a time. An item is never divided.
PART_BYTES = 16 << 20
_NOT_WORD = bytes(b for b in range(128) if not (0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A))
_TO_SPACE = bytes.maketrans(_NOT_WORD, b" " * len(_NOT_WORD))


def words(text: bytes) -> list[bytes]:
    return text.lower().translate(_TO_SPACE).split()


class Benchmark:
    """Items of a part as term numbers, from 1 on."""

    def __init__(self, rows: list[tuple[object, bytes]], width: int):
        self.width, self.terms, self.items, self.ids = width, {}, [], []
        for item_id, text in sorted(((None if i is None else str(i), t) for i, t in rows if t), key=lambda r: (r[0] is None, r)):
            w = words(text)
            if w:
                self.items.append(np.array([self.terms.setdefault(x, len(self.terms) + 1) for x in w], np.int32))
                self.ids.append(item_id)

    def anchors(self, counts: np.ndarray) -> list[np.ndarray]:
        """For each item its windows' rarest places: a row of (at most) RAREST offsets in rising order for each window."""
        out = []
        for w in self.items:
            n = min(self.width, len(w))
            # Places by how rare their terms are, then by term and place: a window has those of the least rank.
            rank = np.empty(len(w), np.int64)
            rank[np.lexsort((np.arange(len(w)), w, counts[w]))] = np.arange(len(w))
            k = min(RAREST, n)
            within = np.argsort(np.lib.stride_tricks.sliding_window_view(rank, n), axis=1)[:, :k]
            out.append(np.sort(within + np.arange(len(within))[:, None], axis=1).astype(np.int32))
        return out


def _forward(terms):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = terms.value
        for batch in slices(batches):
            n_words, flat, ends = [], [], [0]
            for t in batch.column(2).to_pylist():
                w = words(t)
                n_words.append(len(w))
                ids = np.fromiter((number.get(x, 0) for x in w), np.int32, len(w))
                if not ids.any():
                    ids = ids[:0]
                flat.append(ids)
                ends.append(ends[-1] + len(ids))
            lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(flat) if flat else np.empty(0, np.int32)))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(n_words, pa.int64()), lists], ["doc_id", "key", "n_words", "terms"])

    return run


def forward_lists(docs: DataFrame, benchmark: Benchmark) -> DataFrame:
    """doc_id, key (of the text), n_words, terms (numbers of the benchmark's terms, 0 for other words, by position)."""
    sent = docs.sparkSession.sparkContext.broadcast(benchmark.terms)
    return docs.select("doc_id", F.xxhash64("text").alias("key"), text_bytes(F.col("text")).alias("b")).mapInArrow(_forward(sent), "doc_id long, key long, n_words long, terms array<int>")


def term_counts(forward: DataFrame, benchmark: Benchmark) -> np.ndarray:
    """How often each term occurs in all documents."""
    most = len(benchmark.terms) + 1

    def run(batches):
        total = np.zeros(most, np.int64)
        for batch in batches:
            total += np.bincount(batch.column(0).flatten().to_numpy(zero_copy_only=False), minlength=most)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(total[at])], ["term", "n"])

    out = np.zeros(most, np.int64)
    for term, n in forward.select("terms").mapInArrow(run, "term long, n long").groupBy("term").agg(F.sum("n")).collect():
        out[term] = n
    return out


def postings(forward: DataFrame, terms: np.ndarray, most: int) -> DataFrame:
    """The index: term, doc_id, key, at (positions), in segments sorted by term."""
    wanted = np.zeros(most, bool)
    wanted[terms] = True

    def run(batches):
        for batch in batches:
            lists = batch.column(2)
            flat = lists.flatten().to_numpy(zero_copy_only=False)
            ends = lists.offsets.to_numpy()
            at = np.flatnonzero(wanted[flat])
            doc = np.searchsorted(ends - ends[0], at, "right") - 1
            order = np.lexsort((at, doc, flat[at]))
            at, doc = at[order], doc[order]
            rows = pa.array(doc)
            yield pa.RecordBatch.from_arrays(
                [pa.array(flat[at]), batch.column(0).take(rows), batch.column(1).take(rows), pa.array((at - (ends - ends[0])[doc]).astype(np.int32))], ["term", "doc_id", "key", "at"]
            )

    return forward.select("doc_id", "key", "terms").mapInArrow(run, "term int, doc_id long, key long, at int")


def parts(benchmark: DataFrame) -> list[DataFrame]:
    """The benchmark (item_id, text) in parts of about PART_BYTES, dealt by a hash of the item."""
    size = benchmark.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    k = max(1, -(-size // PART_BYTES))
    rows = benchmark.select("item_id", "text")
    return [rows.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(k)) == i) for i in range(k)] if k > 1 else [rows]


class Index:
    """Forward lists, term counts and stored postings of a corpus for one part of a benchmark."""

    def __init__(self, docs: DataFrame, part: DataFrame, width: int = 10):
        self.spark = docs.sparkSession
        self.benchmark = Benchmark([(r[0], bytes(r[1])) for r in part.select("item_id", text_bytes(F.col("text"))).collect()], width)
        self.forward = durable(forward_lists(docs, self.benchmark), "forward")
        self.counts = term_counts(self.forward, self.benchmark)
        self.windows = self.benchmark.anchors(self.counts)
        terms = np.unique(np.concatenate([w[np.unique(o)] for w, o in zip(self.benchmark.items, self.windows, strict=True)] or [np.empty(0, np.int32)]))
        self.postings = durable(postings(self.forward, terms, len(self.counts)), "postings")

    def anchor_table(self) -> DataFrame:
        """term, item, offset, and need: the number of rarest terms that a window of the item has. Made in tasks from the part's items."""
        sent = self.spark.sparkContext.broadcast((self.benchmark.items, self.windows))

        def run(batches):
            for batch in batches:
                for i in batch.column(0).to_pylist():
                    w, o = sent.value[0][i], sent.value[1][i]
                    own = np.unique(o)
                    yield pa.RecordBatch.from_arrays([pa.array(w[own]), pa.array(np.full(len(own), i, np.int32)), pa.array(own), pa.array(np.full(len(own), o.shape[1], np.int32))], ["term", "item", "offset", "need"])

        rows = self.spark.range(len(self.benchmark.items)).mapInArrow(run, "term int, item int, offset int, need int")
        return small_side(durable(rows, "anchors"))

    def starts(self) -> DataFrame:
        """Per document: the (item, start) at which all rarest terms of some window of the item agree."""
        hits = self.postings.join(self.anchor_table(), "term").select("doc_id", "key", "item", (F.col("at") - F.col("offset")).alias("start"), "offset", "need")
        # Fewer agreeing terms than a window of the item has cannot be a window; most starts end here.
        found = hits.groupBy("doc_id", "key", "item", "start", "need").agg(F.collect_set("offset").alias("offsets")).where("size(offsets) >= need").drop("need")
        sent = self.spark.sparkContext.broadcast(self.windows)

        def run(batches):
            for batch in batches:
                items, sets = batch.column(2).to_pylist(), batch.column(4).to_pylist()
                keep = [bool(np.isin(sent.value[item], have).all(axis=1).any()) for item, have in zip(items, sets, strict=True)]
                yield pa.RecordBatch.from_arrays([c.filter(pa.array(keep, pa.bool_())) for c in batch.columns[:4]], ["doc_id", "key", "item", "start"])

        kept = found.mapInArrow(run, "doc_id long, key long, item int, start int")
        return kept.groupBy("doc_id", "key").agg(F.collect_list(F.struct("item", "start")).alias("starts"))

    def exact_matches(self) -> DataFrame:
        """Per row of the corpus: doc_id, key, n_words, n_hit, items (list of item ids), spans (list of [from, to) in words)."""
        sent = self.spark.sparkContext.broadcast((self.benchmark.items, self.benchmark.ids, self.benchmark.width))
        # Rows without a doc_id are told apart by their text alone, and must meet their starts all the same.
        found = self.starts().withColumnRenamed("doc_id", "_doc_id").withColumnRenamed("key", "_key")
        rows = self.forward.join(found, F.col("doc_id").eqNullSafe(F.col("_doc_id")) & (F.col("key") == F.col("_key")), "left")

        def run(batches):
            items, ids, width = sent.value
            for batch in batches:
                flat = batch.column(3)
                hits, names, spans = [], [], []
                for i, starts in enumerate(batch.column(4).to_pylist()):
                    covered, found = None, set()
                    if starts:
                        doc = flat[i].values.to_numpy(zero_copy_only=False)
                        covered = np.zeros(len(doc) + 1, np.int64)
                        for s in starts:
                            item, start = items[s["item"]], s["start"]
                            n = min(width, len(item))
                            a, b = max(0, -start), min(len(item), len(doc) - start)
                            if b - a < n:
                                continue
                            run_of = np.concatenate([[0], np.cumsum(item[a:b] == doc[start + a : start + b])])
                            begin = np.flatnonzero(run_of[n:] - run_of[:-n] == n) + start + a
                            if len(begin):
                                if ids[s["item"]] is not None:
                                    found.add(ids[s["item"]])
                                np.add.at(covered, begin, 1), np.add.at(covered, begin + n, -1)
                    inside = np.cumsum(covered)[:-1] > 0 if covered is not None else np.zeros(0, bool)
                    hits.append(int(inside.sum()))
                    names.append(sorted(found))
                    edge = np.flatnonzero(np.diff(np.concatenate([[0], inside.astype(np.int8), [0]])))
                    spans.append(edge.reshape(-1, 2).tolist())
                yield pa.RecordBatch.from_arrays(
                    [*batch.columns[:3], pa.array(hits, pa.int64()), pa.array(names, pa.list_(pa.string())), pa.array(spans, pa.list_(pa.list_(pa.int64())))],
                    ["doc_id", "key", "n_words", "n_hit", "items", "spans"],
                )

        kinds = "doc_id long, key long, n_words long, n_hit long, items array<string>, spans array<array<bigint>>"
        return rows.select("doc_id", "key", "n_words", "terms", "starts").mapInArrow(run, kinds)

    def proximity_matches(self, slop: int = 5) -> DataFrame:
        """(doc_id, key, item, at): documents in which all terms of a window of an item occur, in any order, as often as there, within the window's length and
        slop words from position at on. item is its number in ``benchmark.ids``.

        Postings of the windows' rarest terms that lie near each other are candidates, which are then compared with the forward list.
        """
        items, width = self.benchmark.items, self.benchmark.width
        sent = self.spark.sparkContext.broadcast((items, self.windows))

        def wanted(batches):
            for batch in batches:
                for i in batch.column(0).to_pylist():
                    w, o = sent.value[0][i], sent.value[1][i]
                    for s, places in enumerate(o):
                        terms = np.unique(w[places])
                        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(terms), x, np.int32)) for x in (i, s, len(terms))] + [pa.array(terms)], ["item", "s", "need", "term"])

        rows = self.spark.range(len(items)).mapInArrow(wanted, "item int, s int, need int, term int")
        near = self.postings.join(small_side(durable(rows, "proximity")), "term")
        reach = width + slop
        # Each posting belongs to two overlapping stretches, so that any span of the reach lies within one.
        cut = near.withColumn("cell", F.explode(F.array(F.floor(F.col("at") / reach), F.floor(F.col("at") / reach) - 1)))
        met = cut.groupBy("doc_id", "key", "item", "s", "need", "cell").agg(F.count_distinct("term").alias("k")).where("k = need")
        spots = met.groupBy("doc_id", "key").agg(F.collect_set(F.struct("item", "s", "cell")).alias("spots"))
        placed = spots.withColumnRenamed("doc_id", "_d").withColumnRenamed("key", "_k")
        lists = self.forward.join(placed, F.col("doc_id").eqNullSafe(F.col("_d")) & (F.col("key") == F.col("_k"))).dropDuplicates(["doc_id", "key"])

        def checked(batches):
            for batch in batches:
                docs, keys, lists, spots = (c.to_pylist() for c in batch.columns)
                out = set()
                for d, k, doc, found in zip(docs, keys, lists, spots, strict=True):
                    for x in found:
                        w = sent.value[0][x["item"]]
                        window = w[x["s"] : x["s"] + width]
                        size = len(window) + slop
                        terms, need = np.unique(window, return_counts=True)
                        for at in range(max(0, x["cell"] * reach), min(len(doc), (x["cell"] + 2) * reach)):
                            have, n = np.unique(np.array(doc[at : at + size], np.int32), return_counts=True)
                            counts = dict(zip(have.tolist(), n.tolist(), strict=True))
                            if doc[at] in terms and all(counts.get(t, 0) >= c for t, c in zip(terms.tolist(), need.tolist(), strict=True)):
                                out.add((d, k, x["item"], at))
                yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(zip(*sorted(out, key=str), strict=True) if out else [[]] * 4, (pa.int64(), pa.int64(), pa.int32(), pa.int32()), strict=True)], ["doc_id", "key", "item", "at"])

        return lists.select("doc_id", "key", "terms", "spots").mapInArrow(checked, "doc_id long, key long, item int, at int").distinct()


def decontaminate(docs: DataFrame, benchmark: DataFrame, width: int = 10) -> DataFrame:
    """Per row of docs (doc_id, text): doc_id, key (of the text), n_words, n_hit, items, spans; words are those of ``words``."""
    found = [Index(docs, part, width).exact_matches() for part in parts(benchmark)]
    if len(found) == 1:
        return found[0]
    # Documents that parts hit are few; their spans are laid together, and the rest have none.
    found = [durable(f, "part") for f in found]
    hits = None
    for f in found:
        some = f.where("n_hit > 0").select(F.col("doc_id").alias("_d"), F.col("key").alias("_k"), "items", "spans").dropDuplicates(["_d", "_k"])
        hits = some if hits is None else hits.unionByName(some)
    spans = F.array_sort(F.flatten(F.collect_list("spans")))
    # Sorted spans are walked through with the place that is covered so far.
    zero = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("until"))
    covered = F.aggregate("spans", zero, lambda a, s: F.struct((a["n"] + F.greatest(F.lit(0), s[1] - F.greatest(s[0], a["until"]))).alias("n"), F.greatest(a["until"], s[1]).alias("until")), lambda a: a["n"])
    whole = hits.groupBy("_d", "_k").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"), spans.alias("spans")).withColumn("n_hit", covered)
    rows = found[0].select("doc_id", "key", "n_words").join(whole, F.col("doc_id").eqNullSafe(F.col("_d")) & (F.col("key") == F.col("_k")), "left")
    return rows.select("doc_id", "key", "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"), F.coalesce("items", F.array().cast("array<string>")).alias("items"), F.coalesce("spans", F.array().cast("array<array<bigint>>")).alias("spans"))


def digests(matches: DataFrame) -> DataFrame:
    joined = F.array_join("items", ",")
    return matches.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(joined.cast("binary"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated")
    )


def item_hash(ids: list[str]) -> str:
    return hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest()
