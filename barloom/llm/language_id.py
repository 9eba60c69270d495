"""Language of a text by compression (operator 1).

Each language has a raw-content zstandard dictionary, cut from texts of that language. A text is encoded with every
dictionary, in blocks of BLOCK characters so that no part of a long text outweighs what the dictionary tells;
the language with the fewest bytes wins. The margin is the share of bytes that the winner saves on the runner-up;
``accepted`` says whether it reaches the least margin.

Defined cases: null texts and texts without a letter are ``und`` with score 0. Ties go to the language first in
code point order. Rows without a language, or with a null doc_id, are never learned from. Without any learned language all are
``und``. Very long texts are encoded whole, block by block.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bound of the sample that a dictionary is made of, for each language: texts, and characters of the block that is drawn from anywhere in each.
SAMPLE_ROWS, SAMPLE_CHARS = 200, 600
#: A dictionary takes whole blocks up to this size; with many languages less, so that all dictionaries together keep within MODEL_BYTES.
DICTIONARY_BYTES, MODEL_BYTES = 128 << 10, 64 << 20
BLOCK = 1000
#: Short matches tell languages apart best: on held-out texts far better than the presets for speed or for size.
SEARCH = {"window_log": 18, "chain_log": 16, "hash_log": 16, "search_log": 4, "min_match": 4, "target_length": 32, "strategy": zstandard.STRATEGY_GREEDY}


def sample(docs: DataFrame, learn: Column) -> dict[str, list[str]]:
    """For each language blocks from up to SAMPLE_ROWS different texts, picked by a hash of the text, evenly over all rows, each from a place that
    another hash picks.

    The rows are cut down by hash before they are ranked, so that no task ranks all rows of a language.
    """
    place = F.pmod(F.xxhash64("text", F.lit("place")), F.greatest(F.lit(1), F.char_length("text") - SAMPLE_CHARS + 1)) + 1
    rows = docs.where(learn & F.col("lang").isNotNull() & (F.col("lang") != "und") & (F.octet_length("text") > 0)).select("lang", F.pmod(F.xxhash64("text"), F.lit(1 << 32)).alias("h"), F.substring("text", place.cast("int"), F.lit(SAMPLE_CHARS)).alias("t"))
    # One row for each language: what the driver gets follows the languages.
    sizes = rows.groupBy("lang").agg(F.approx_count_distinct("h", 0.05).alias("n")).collect()
    if not sizes:
        return {}
    part = docs.sparkSession.createDataFrame([(r.lang, int(min(1.0, 2.0 * SAMPLE_ROWS / max(1, r.n)) * (1 << 32))) for r in sizes], "lang string, below long")
    few = rows.join(F.broadcast(part), "lang").where("h < below").select("lang", "h", "t").dropDuplicates(["lang", "h"])
    out: dict[str, list[tuple]] = {}
    for r in few.collect():
        out.setdefault(r.lang, []).append((r.h, r.t))
    return {k: [t for _, t in sorted(v)[:SAMPLE_ROWS]] for k, v in sorted(out.items())}


def plain(text: str) -> str:
    """Letters in lower case with one space between words; all else says little about the language."""
    return " ".join("".join(c if c.isalpha() else " " for c in text.lower()).split())


def _joined(blocks: list[bytes], most: int) -> bytes:
    """Whole blocks up to a size; the first is taken in any case."""
    out, size = [], 0
    for b in blocks:
        if out and size + len(b) + 1 > most:
            break
        out.append(b)
        size += len(b) + 1
    return b" ".join(out)


class Model:
    def __init__(self, texts: dict[str, list[str]]):
        self.languages = sorted(texts)
        most = min(DICTIONARY_BYTES, MODEL_BYTES // max(1, len(texts)))
        self.dictionaries = [_joined([plain(t).encode() for t in texts[x]], most) for x in self.languages]
        self.coders = None

    def __getstate__(self):
        return {"languages": self.languages, "dictionaries": self.dictionaries, "coders": None}

    def sizes(self, text: str) -> np.ndarray:
        """Bytes of the text under each language's dictionary."""
        if self.coders is None:
            self.coders = []
            for d in self.dictionaries:
                z = zstandard.ZstdCompressionDict(d, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
                how = zstandard.ZstdCompressionParameters(**SEARCH, write_content_size=False, write_checksum=False, write_dict_id=False)
                self.coders.append(zstandard.ZstdCompressor(compression_params=how, dict_data=z))
        blocks = [text[i : i + BLOCK].encode() for i in range(0, len(text), BLOCK)]
        return np.array([sum(len(c.compress(b)) for b in blocks) for c in self.coders])

    def predict(self, text: str | None) -> tuple[str, float, float]:
        """Language, score and margin."""
        clean = plain(text) if text else ""
        if not clean or not self.languages:
            return "und", 0.0, 0.0
        sizes = self.sizes(" " + clean + " ").astype(float)
        best = int(np.argmin(sizes))
        others = np.delete(sizes, best)
        if not len(others):
            return self.languages[0], 1.0, 1.0
        margin = float((others.min() - sizes[best]) / others.min())
        share = np.exp(-(sizes - sizes[best]))
        return self.languages[best], float(1 / share.sum()), margin


def fit(docs: DataFrame, learn: Column) -> Model:
    return Model(sample(docs, learn))


def identify(docs: DataFrame, model: Model, least_margin: float = 0.02) -> DataFrame:
    """docs with lang_pred, score (0 to 1), margin and accepted (margin reached), from the column text alone; columns of these names are replaced."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("lang_pred string, score double, margin double")
    def predicted(texts):
        import pandas as pd

        return pd.DataFrame([sent.value.predict(t) for t in texts], columns=["lang_pred", "score", "margin"])

    predicted.func.__annotations__.clear()
    out = docs.withColumn("_p", predicted("text"))
    made = ("lang_pred", "score", "margin", "accepted")
    return out.select(*(c for c in docs.columns if c not in made), "_p.lang_pred", "_p.score", "_p.margin", (F.col("_p.margin") >= least_margin).alias("accepted"))
