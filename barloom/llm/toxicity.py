"""Toxicity by gradient-boosted trees over dense features, with isotonic calibration (operator 2).

Features of a text: densities and counts of lexicon words and of lexicon word beginnings, their closeness to second-person
words, shares of capitals, punctuation, digits, repeated letters and of words spelt with signs for letters. The lexicon is
learned from the labels: words and word beginnings that toxic texts use far more often than others.

1. ``sample``: at most about SAMPLE_ROWS different labelled texts, whole, picked by a hash of the text over all rows. Near copies (texts
   that share the least hash of their word triples) count once, so that a group of copies does not fill the lexicon with its own words.
2. ``lexicons``: in how many texts of each label and fold a word or beginning is found is counted in tasks; only the up to MOST_LEXICON
   most telling ones (a bound of the model's size) go to the driver.
3. Features of the sample are made in tasks, from a lexicon that has not seen the row; the driver gets one row of numbers for each sampled text, and
   grows the trees and the calibration on different folds.
4. ``score``: the model, a few megabytes whatever the table's size, goes to the tasks.

Defined cases: null, empty and blank texts have all features 0 and get the score of such a text. Rows whose label is
null, or whose doc_id is null, are not learned from; a doc_id with several labels has the largest. Without labelled
rows of both kinds every score is the share of toxic rows (0 without any). Repeated rows are learned from once. Very long texts are read whole.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barloom.llm.common import durable
from barloom.llm.grams import run_hashes, slices

SAMPLE_ROWS = 16_000
#: A word or beginning belongs to the lexicon if so many toxic texts have it, and have it so many times as often as others.
LEAST_ROWS, LEAST_ODDS = 4, 12.0
#: Words that a task counts before it hands its counts over.
FLUSH = 200_000
THRESHOLD = 0.3
BEGINNINGS = (4, 5, 6, 7)
MOST_LEXICON = 4_000
#: Second-person words of the four languages (fixed values).
SECOND_PERSON = frozenset("you your yours yourself u ur du dich dir dein deine deiner ihr euch euer tu te ti toi ton ta tes vous votre vos usted ustedes tus vosotros vuestro".split())
_SIGNS = str.maketrans("013457@$!", "oieastasi")
_WORD = re.compile(r"[^\W_]+")
_RAW = re.compile(r"\S+")
_DIGIT = re.compile(r"\d")
_UPPER = re.compile(r"[A-Z\u00C0-\u00DE]")
_SHOUTED = re.compile(r"\b[A-Z\u00C0-\u00DE]{3,}\b")
_REPEATED = re.compile(r"(\w)\1\1")
#: What (?:\b\w[ .*_-]){3,}\w\b finds; without a way back, so that a run of any length takes no memory. An underscore
#: is part of a word, hence it can only stand before the last letter.
_SPOKEN = re.compile(r"\b\w(?:(?:[ .*-]\w\b)++[ .*-]\w_\w\b|(?:[ .*-]\w\b){3,}+)")
NAMES = ("words", "word_hits", "word_rate", "word_weight", "start_hits", "start_rate", "start_weight", "most_weight", "signed_hits", "near_you", "you_rate", "capitals", "shouted", "punctuation", "marks", "digits", "repeated", "spaced")


class Lexicon:
    """Weights of words and of word beginnings."""

    def __init__(self, words: dict[str, float], starts: dict[str, float]):
        self.words, self.starts = words, starts
        self.lengths = tuple(sorted({len(s) for s in starts}))

    def features(self, text: str | None) -> list[float]:
        if not text or not text.strip():
            return [0.0] * len(NAMES)
        low = text.lower()
        found = _WORD.findall(low)
        counts = Counter(found)
        n = max(1, len(found))
        word_hits = word_weight = start_hits = start_weight = most = you = 0.0
        toxic = set()
        words, starts, lengths = self.words, self.starts, self.lengths
        for w, k in counts.items():
            if (x := words.get(w)) is not None:
                word_hits += k
                word_weight += k * x
                most = max(most, x)
                toxic.add(w)
            best = 0.0
            for size in lengths:
                if len(w) < size:
                    break
                x = starts.get(w[:size], 0.0)
                if x > best:
                    best = x
            if best:
                start_hits += k
                start_weight += k * best
                most = max(most, best)
                toxic.add(w)
            if w in SECOND_PERSON:
                you += k
        near = 0
        if toxic and you:
            at = [i for i, w in enumerate(found) if w in SECOND_PERSON]
            hits = np.array([i for i, w in enumerate(found) if w in toxic])
            near = int((np.abs(hits - np.array(at)[np.clip(np.searchsorted(at, hits), 0, len(at) - 1)]) <= 5).sum())
        signed = 0
        if "$" in text or "@" in text or any(c in low for c in "01345"):
            for raw in _RAW.findall(low):
                if not raw.isalpha():
                    plain = raw.translate(_SIGNS).strip(".,;:!?\"'()")
                    if plain != raw and plain in words and raw.strip(".,;:!?\"'()") not in words:
                        signed += 1
        size = len(text)
        digits = len(_DIGIT.findall(text))
        letters = max(1, sum(k * len(w) for w, k in counts.items()) - digits)
        upper = len(_UPPER.findall(text))
        shouted = len(_SHOUTED.findall(text)) if upper > 2 else 0
        marks = text.count("!") + text.count("?")
        points = max(0, size - letters - digits - text.count(" ") - text.count("\n"))
        return [
            float(np.log1p(len(found))), word_hits, word_hits / n, word_weight / n, start_hits, start_hits / n, start_weight / n, most, float(signed), float(near), you / n,
            upper / letters, shouted / n, points / size, marks / n, digits / size, len(_REPEATED.findall(low)) / n, float(sum(1 for _ in _SPOKEN.finditer(text))),
        ]


def grams_of(text: str) -> tuple[set[str], set[str]]:
    """A text's different words and word beginnings."""
    found = set(_WORD.findall(text.lower()))
    return found, {w[:k] for w in found for k in BEGINNINGS if len(w) >= k}


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From (text, y, fold): kind (0 word, 1 beginning), gram, and in how many texts it is: of each half and label."""
    counts: dict[tuple[int, str], list[int]] = {}

    def done():
        rows = list(counts.items())
        columns = [pa.array([k[0] for k, _ in rows], pa.int32()), pa.array([k[1] for k, _ in rows], pa.string()), *(pa.array([v[i] for _, v in rows], pa.int64()) for i in range(4))]
        counts.clear()
        return pa.RecordBatch.from_arrays(columns, ["kind", "gram", "c0", "t0", "c1", "t1"])

    for batch in slices(batches):
        for text, y, fold in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            place = 2 * (fold % 2) + y
            for kind, grams in enumerate(grams_of(text)):
                for g in grams:
                    if (c := counts.get((kind, g))) is None:
                        c = counts[(kind, g)] = [0, 0, 0, 0]
                    c[place] += 1
            if len(counts) >= FLUSH:
                yield done()
    yield done()


def lexicons(picked: DataFrame) -> list[Lexicon]:
    """Learned from rows (text, y, fold) of even folds, of odd folds, and of all: what is found in toxic texts LEAST_ODDS times as often
    as in others, by number of texts."""
    sizes = picked.agg(*(F.count_if((F.col("fold") % 2 == half) & (F.col("y") == y)).alias(f"{k}{half}") for half in (0, 1) for y, k in enumerate("ct"))).first()
    parts = picked.select("text", "y", "fold").mapInArrow(_counted, "kind int, gram string, c0 long, t0 long, c1 long, t1 long")
    grams = durable(parts.groupBy("kind", "gram").agg(*(F.sum(c).alias(c) for c in ("c0", "t0", "c1", "t1"))).where(f"t0 + t1 >= {LEAST_ROWS}"), "grams")
    out = []
    for clean, toxic, n_clean, n_toxic in ((F.col("c0"), F.col("t0"), sizes.c0, sizes.t0), (F.col("c1"), F.col("t1"), sizes.c1, sizes.t1), (F.col("c0") + F.col("c1"), F.col("t0") + F.col("t1"), sizes.c0 + sizes.c1, sizes.t0 + sizes.t1)):
        odds = (toxic / max(1, n_toxic)) / ((clean + 0.5) / max(1, n_clean))
        both = []
        for kind in (0, 1):
            best = grams.where((F.col("kind") == kind) & (toxic >= LEAST_ROWS)).select("gram", odds.alias("odds")).where(F.col("odds") >= LEAST_ODDS)
            both.append({r.gram: float(np.log(r.odds)) for r in best.orderBy(F.desc("odds"), "gram").limit(MOST_LEXICON).collect()})
        # A beginning says nothing that a shorter one does not say as clearly.
        words, starts = both
        out.append(Lexicon(words, {s: x for s, x in starts.items() if not any(s[:k] in starts and starts[s[:k]] >= x for k in BEGINNINGS if k < len(s))}))
    return out


class Trees:
    """Boosted regression trees on binned features, logistic loss."""

    def __init__(self, rounds: int = 60, depth: int = 3, rate: float = 0.15, bins: int = 48, least: float = 8.0):
        self.rounds, self.depth, self.rate, self.bins, self.least = rounds, depth, rate, bins, least
        self.trees: list[list[tuple[int, float, float]]] = []
        self.base = 0.0

    def fit(self, x: np.ndarray, y: np.ndarray) -> Trees:
        n, m = x.shape
        edges = [np.unique(np.concatenate([np.quantile(x[:, j], np.linspace(0, 1, self.bins)), [0.0]])) for j in range(m)]
        binned = np.stack([np.searchsorted(edges[j], x[:, j], "left") for j in range(m)], axis=1)
        width = max(len(e) for e in edges) + 1
        self.base = float(np.log((y.mean() + 1e-6) / (1 - y.mean() + 1e-6)))
        score = np.full(n, self.base)
        for _ in range(self.rounds):
            p = 1 / (1 + np.exp(-score))
            grad, hess = y - p, np.maximum(p * (1 - p), 1e-6)
            node, tree = np.zeros(n, np.int64), []
            for level in range(self.depth):
                first = (1 << level) - 1
                g = np.zeros((1 << level, m, width))
                h = np.zeros_like(g)
                at = node - first
                for j in range(m):
                    np.add.at(g[:, j], (at, binned[:, j]), grad)
                    np.add.at(h[:, j], (at, binned[:, j]), hess)
                gl, hl = g.cumsum(axis=2), h.cumsum(axis=2)
                gt, ht = gl[:, :, -1:], hl[:, :, -1:]
                gain = gl**2 / (hl + 1) + (gt - gl) ** 2 / (ht - hl + 1) - gt**2 / (ht + 1)
                gain[(hl < self.least / 8) | (ht - hl < self.least / 8)] = -1
                for k in range(1 << level):
                    j, b = np.unravel_index(int(np.argmax(gain[k])), gain[k].shape)
                    ok = gain[k, j, b] > 1e-9 and b < len(edges[j])
                    tree.append((int(j), float(edges[j][b]) if ok else np.inf, 0.0))
                split = np.array([t[1] for t in tree])[node]
                feature = np.array([t[0] for t in tree])[node]
                node = 2 * node + 1 + (x[np.arange(n), feature] > split)
            first = (1 << self.depth) - 1
            leaf = node - first
            value = np.bincount(leaf, grad, 1 << self.depth) / (np.bincount(leaf, hess, 1 << self.depth) + 1)
            tree += [(0, 0.0, float(self.rate * v)) for v in value]
            self.trees.append(tree)
            score += self.rate * value[leaf]
        return self

    def decide(self, x: np.ndarray) -> np.ndarray:
        score = np.full(len(x), self.base)
        for tree in self.trees:
            feature, split, value = (np.array(c) for c in zip(*tree, strict=True))
            node = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                node = 2 * node + 1 + (x[np.arange(len(x)), feature[node]] > split[node])
            score += value[node]
        return score


def isotonic(score: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators: nondecreasing shares by score, as points to interpolate between."""
    order = np.argsort(score, kind="stable")
    blocks: list[list[float]] = []
    for s, v in zip(score[order], y[order], strict=True):
        blocks.append([v, 1.0, s, s])
        while len(blocks) > 1 and blocks[-2][0] / blocks[-2][1] >= blocks[-1][0] / blocks[-1][1]:
            b = blocks.pop()
            a = blocks[-1]
            blocks[-1] = [a[0] + b[0], a[1] + b[1], a[2], b[3]]
    xs, ys = [], []
    for total, n, low, high in blocks:
        share = (total + 0.01) / (n + 0.1) if n > 1 else total / n * 0.9
        for at in (low, high) if high > low else (low,):
            xs.append(at), ys.append(share)
    return np.array(xs), np.maximum.accumulate(np.array(ys))


class Model:
    """From the features x of the sample, its labels y and folds (0 to 3), and the lexicon of all of it. Without rows of both labels in
    both halves there are no trees, and every score is the share of toxic rows."""

    def __init__(self, x: np.ndarray, y: np.ndarray, fold: np.ndarray, lexicon: Lexicon):
        self.share = float(y.mean()) if len(y) else 0.0
        self.lexicon = None
        held = fold >= 2
        if len(y) < 20 or y.sum() < 4 or (y == 0).sum() < 4 or not 0 < y[~held].sum() < (~held).sum() or not 0 < y[held].sum() < held.sum():
            return
        first, second = Trees().fit(x[~held], y[~held]), Trees().fit(x[held], y[held])
        out = np.empty(len(y))
        out[held], out[~held] = first.decide(x[held]), second.decide(x[~held])
        self.trees = (first, second)
        self.at, self.to = isotonic(out, y.astype(float))
        self.lexicon = lexicon

    def scores(self, texts) -> np.ndarray:
        if self.lexicon is None:
            return np.full(len(texts), self.share)
        x = np.array([self.lexicon.features(t) for t in texts]).reshape(len(texts), len(NAMES))
        raw = (self.trees[0].decide(x) + self.trees[1].decide(x)) / 2
        return np.clip(np.interp(raw, self.at, self.to), 0.0, 1.0)


def _copies_key(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows with the least hash of their texts' word triples."""
    for batch in slices(batches):
        keys = []
        for text in batch.column("text"):
            _, h, _ = run_hashes(text.as_py().lower().encode(), 3, whole_if_short=True)
            keys.append(int(h.min().astype(np.int64)) if len(h) else 0)
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(keys, pa.int64())], [*batch.schema.names, "copy"])


def sample(docs: DataFrame, labels: DataFrame, learn: Column) -> DataFrame:
    """h (hash of the text), text, y (1 toxic) and fold of different labelled texts, at most about SAMPLE_ROWS, evenly over all labelled rows."""
    marks = labels.where("toxic is not null and doc_id is not null").groupBy("doc_id").agg(F.max("toxic").alias("_toxic"))
    hashed = docs.where(learn & (F.octet_length("text") > 0)).select("doc_id", F.xxhash64("text").alias("h"))
    # Only ids and hashes meet the labels; the texts of the few that are picked are fetched after that.
    rows = durable(hashed.join(marks, "doc_id"), "labelled")
    n = rows.agg(F.approx_count_distinct("h", 0.03)).first()[0]
    share = min(1.0, SAMPLE_ROWS / max(1, n))
    few = rows.where(F.pmod("h", F.lit(1 << 32)) < int(share * (1 << 32))).groupBy("h").agg(F.min("doc_id").alias("doc_id"), F.max("_toxic").alias("_toxic"))
    texts = docs.select("doc_id", "text", F.xxhash64("text").alias("h")).join(F.broadcast(few), ["doc_id", "h"]).select("h", "text", (F.col("_toxic") > 0).cast("int").alias("y"))
    keyed = texts.mapInArrow(_copies_key, "h long, text string, y int, copy long")
    picked = keyed.groupBy("copy").agg(F.min_by(F.struct("h", "text", "y"), "h").alias("x")).select("x.*")
    return durable(picked.withColumn("fold", F.pmod(F.xxhash64("h", F.lit(7)), F.lit(4)).cast("int")), "sample")


def _features(sent):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            x = [np.array(sent.value[1 - fold % 2].features(text)).tobytes() for text, fold in zip(batch.column(1).to_pylist(), batch.column(3).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), batch.column(3), pa.array(x, pa.binary())], ["h", "y", "fold", "x"])

    return run


def fit(docs: DataFrame, labels: DataFrame, learn: Column) -> Model:
    """A model of the rows of docs (doc_id, text) that ``learn`` picks and labels (doc_id, toxic) mark."""
    picked = sample(docs, labels, learn)
    even, odd, whole = lexicons(picked)
    sent = docs.sparkSession.sparkContext.broadcast((even, odd))
    # Features come from a lexicon that has not seen the row, so that the trees see them as they will be. At most about SAMPLE_ROWS rows.
    rows = picked.select("h", "text", "y", "fold").mapInArrow(_features(sent), "h long, y int, fold int, x binary").orderBy("h").toPandas()
    sent.destroy()
    x = np.frombuffer(b"".join(rows["x"]), np.float64).reshape(len(rows), len(NAMES))
    return Model(x, rows["y"].to_numpy(np.int64), rows["fold"].to_numpy(np.int64), whole)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """docs with the column score, from the column text alone; a column of that name is replaced."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def scored(texts):
        return pd.Series(sent.value.scores(texts.tolist()))

    scored.__annotations__.clear()
    return docs.withColumn("score", F.pandas_udf(scored, "double")("text"))
