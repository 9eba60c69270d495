"""Secrets in texts: three patterns, and strings that look random to character Markov models (operator 6).

DataFrame functions only. Positions are code points; a pattern's matches are located by splitting the text at them and adding up
lengths. A candidate of the Markov part is a run of TOKEN characters; its characters' transitions are scored by the log-likelihood
ratio of two first-order models, one of random strings and one of ordinary identifiers. It is a secret if the ratio reaches
LEAST_RATIO in all and LEAST_MEAN on average, and no pattern match overlaps it.

The models are trained from labelled samples: random strings made from digests (in hexadecimal, base 64, and capitals with digits), and identifiers: the words of
at most about SAMPLE_DOCS texts, picked by hash from the whole table, that no pattern matches, and NAMES.

Defined cases: null and empty texts have no spans. Matches are leftmost and do not overlap within a kind; kinds may overlap. An empty table trains
on NAMES alone. Very long texts are searched whole.
"""

from __future__ import annotations

from math import log

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KINDS = ("assign", "access", "hex", "markov")
#: The patterns; the first takes part only if its second group has LEAST_VALUE characters.
ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
LEAST_VALUE = 12
ACCESS = r"AKIA[A-Z0-9]{14,}"
HEX = r"[0-9a-f]{16,}"
TOKEN = r"[A-Za-z0-9+/_=-]{20,}"
LEAST_RATIO, LEAST_MEAN = 12.0, 0.55
SAMPLE_DOCS = 2_000
RANDOM_STRINGS = 4_000
SYMBOLS, FIRST = 96, 32
#: Identifiers as programs have them (fixed values).
NAMES = (
    "getElementById addEventListener XMLHttpRequest application_name max_connections userAccountId HttpServletRequest toString hashCode is_enabled DEFAULT_TIMEOUT_SECONDS "
    "background-color content-type text/html application/json src/main/java/org/example node_modules package_lock readFileSync createServer __init__ test_case_number "
    "org/apache/spark SparkSession partitionBy createDataFrame numberOfPartitions com/example/service/UserController internationalization_settings AbstractFactoryBean "
    "en-US utf-8 user_name first_name last_name created_at updated_at configuration/environment/production very-long-css-class-name my_variable_name anotherVariableName"
).split()


def _running(values: Column, kind: str, pick: str) -> Column:
    """Running sum or maximum of an array, in blocks, so that time does not grow with the square of its length."""
    op = {"sum": lambda a, x: a + x, "max": lambda a, x: F.greatest(a, x)}[pick]
    zero = F.lit(0).cast(kind)
    size = 64
    blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(values) - 1) / size).cast("int")), lambda b: F.slice(values, b * size + 1, F.lit(size)))
    whole = F.transform(blocks, lambda x: F.aggregate(x, zero, op))
    before = F.transform(whole, lambda _, i: F.aggregate(F.slice(whole, F.lit(1), i), zero, op))
    joined = F.zip_with(blocks, before, lambda x, start: F.transform(x, lambda _, i: F.aggregate(F.slice(x, F.lit(1), i + 1), start, op)))
    return F.flatten(joined)


_SPAN = "struct<start:int,kind:int,end:int,value:string>"


def _located(df: DataFrame, name: str, pattern: str, kind: int, group: int | None = None) -> DataFrame:
    """df with the column ``name``: the pattern's matches in ``t`` as spans."""
    found, gaps, value, ends = (f"_{name}{x}" for x in ("m", "g", "v", "e"))
    df = df.withColumn(found, F.regexp_extract_all("t", F.lit(pattern), F.lit(0)))
    some = F.size(found) > 0
    df = df.withColumn(gaps, F.when(some, F.transform(F.split("t", pattern, -1), lambda x: F.char_length(x))))
    df = df.withColumn(value, F.when(some, F.regexp_extract_all("t", F.lit(pattern), F.lit(group))) if group else F.col(found))
    # What lies between two matches, and the match.
    step = F.zip_with(F.slice(gaps, F.lit(1), F.size(found)), found, lambda g, m: g + F.char_length(m))
    df = df.withColumn(ends, F.when(some, step))
    df = df.withColumn(ends, F.when(some, _running(F.col(ends), "int", "sum")))
    spans = F.zip_with(F.arrays_zip(F.col(found).alias("m"), F.col(value).alias("v")), F.col(ends), lambda x, e: F.struct((e - F.char_length(x["m"])).alias("start"), F.lit(kind).alias("kind"), e.alias("end"), x["v"].alias("value")))
    if group:
        spans = F.filter(spans, lambda s: F.char_length(s["value"]) >= LEAST_VALUE)
    return df.withColumn(name, F.coalesce(F.when(some, spans), F.array().cast(f"array<{_SPAN}>"))).drop(found, gaps, value, ends)


def _codes(t: Column) -> Column:
    """Numbers of a string's characters, those that are not printable ASCII as the last."""
    return F.transform(F.split(t, ""), lambda c: F.when(F.ascii(c).between(FIRST, FIRST + SYMBOLS - 2), F.ascii(c) - FIRST).otherwise(SYMBOLS - 1))


def _pairs(strings: DataFrame) -> DataFrame:
    """How often each pair of characters follows one another in the column t: a, b, n."""
    codes = strings.select(_codes(F.col("t")).alias("c")).where("size(c) > 1")
    pair = F.explode(F.arrays_zip(F.slice("c", F.lit(1), F.size("c") - 1).alias("a"), F.slice("c", F.lit(2), F.size("c") - 1).alias("b")))
    return codes.select(pair.alias("p")).groupBy("p.a", "p.b").agg(F.count("*").alias("n"))


def train(docs: DataFrame) -> list[float]:
    """The log-likelihood ratio of each pair of characters, rounded, row by row."""
    spark = docs.sparkSession
    digest = F.sha2(F.concat(F.lit("random"), F.col("id").cast("string")), 256)
    kind = F.col("id") % 4
    upper = F.regexp_replace(F.upper(F.base64(F.unhex(digest))), "[^A-Z0-9]", "")
    text = F.when(kind < 2, F.regexp_replace(F.base64(F.unhex(digest)), "=", "")).when(kind == 2, digest).otherwise(upper)
    random = spark.range(RANDOM_STRINGS).select(text.alias("t"))
    rows = docs.where(F.octet_length("text") > 0)
    n = rows.count()
    below = int(min(1.0, SAMPLE_DOCS / max(1, n)) * (1 << 30))
    words = rows.where(F.pmod(F.xxhash64("text"), F.lit(1 << 30)) < below).select(F.explode(F.regexp_extract_all("text", F.lit(r"[A-Za-z0-9+/_=-]{4,}"), F.lit(0))).alias("t"))
    ordinary = words.where(~F.col("t").rlike(f"{HEX}|{ACCESS}|[0-9]{{6,}}")).select("t")
    # A name weighs as much as some dozen words, since the texts may have few.
    names = spark.createDataFrame([(x,) for x in NAMES], "t string").select(F.explode(F.array_repeat("t", 12)).alias("t"))
    counts = _pairs(random).withColumn("y", F.lit(1)).unionByName(_pairs(ordinary.unionByName(names)).withColumn("y", F.lit(0))).collect()  # at most 2 * SYMBOLS ** 2 rows
    by = [{}, {}]
    for r in counts:
        by[r.y][(r.a, r.b)] = r.n
    share = []
    for own in by:
        total = [sum(own.get((a, b), 0) for b in range(SYMBOLS)) for a in range(SYMBOLS)]
        share.append([log((own.get((a, b), 0) + 0.5) / (total[a] + 0.5 * SYMBOLS)) for a in range(SYMBOLS) for b in range(SYMBOLS)])
    # No single pair decides.
    return [round(max(-2.5, min(2.5, r - o)), 2) for r, o in zip(share[1], share[0], strict=True)]


def _ratio(value: Column, model: list[float]) -> Column:
    table = F.expr("cast(split('" + ",".join(f"{x:g}" for x in model) + "', ',') as array<double>)")
    codes = _codes(value)
    pairs = F.zip_with(F.slice(codes, F.lit(1), F.size(codes) - 1), F.slice(codes, F.lit(2), F.size(codes) - 1), lambda a, b: F.element_at(table, a * SYMBOLS + b + 1))
    return F.aggregate(pairs, F.lit(0.0), lambda s, x: s + x)


#: What looks random and is not secret: UUIDs, as identifiers have them (fixed pattern).
PUBLIC = r"^[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}$"


def _listing(value: Column) -> Column:
    """Whether at least half of a string's characters are followed by the next one of the alphabet, as in written-out alphabets."""
    codes = _codes(value)
    steps = F.zip_with(F.slice(codes, F.lit(1), F.size(codes) - 1), F.slice(codes, F.lit(2), F.size(codes) - 1), lambda a, b: (b - a == 1).cast("int"))
    return 2 * F.aggregate(steps, F.lit(0), lambda s, x: s + x) >= F.char_length(value)


def _found(docs: DataFrame, model: list[float] | None) -> DataFrame:
    """_row (all columns of docs), text, and assign, access, hex, markov and spans: so that columns of the same names do not meet."""
    model = train(docs) if model is None else model
    df = docs.select(F.struct(*docs.columns).alias("_row"), "text", F.coalesce("text", F.lit("")).alias("t"))
    df = _located(df, "assign", ASSIGN, 0, 2)
    df = _located(df, "access", ACCESS, 1)
    df = _located(df, "hex", HEX, 2)
    df = _located(df, "_token", TOKEN, 3)
    open_token = F.filter("_token", lambda x: ~x["value"].rlike(f"{HEX}|{ACCESS}") & ~x["value"].rlike(PUBLIC))
    df = df.withColumn("_token", F.when(F.size("_token") > 0, open_token).otherwise(F.col("_token")))

    def random(x: Column) -> Column:
        return (_ratio(x["value"], model) >= F.greatest(F.lit(LEAST_RATIO), LEAST_MEAN * F.char_length(x["value"]))) & ~_listing(x["value"])

    free = F.filter("_token", lambda x: ~F.exists("assign", lambda a: (a["start"] < x["end"]) & (x["start"] < a["end"])) & random(x))
    df = df.withColumn("markov", F.when(F.size("_token") > 0, free).otherwise(F.col("_token"))).drop("_token", "t")
    return df.withColumn("spans", F.sort_array(F.concat("assign", "access", "hex", "markov")))


def find(docs: DataFrame, model: list[float] | None = None) -> DataFrame:
    """docs (text and more) with assign, access, hex, markov and spans (all of them by start, then kind), which replace columns of these names: arrays of
    struct(start, kind, end, value), end exclusive, kind a place in KINDS."""
    made = ("assign", "access", "hex", "markov", "spans")
    return _found(docs, model).select(*(F.col("_row")[c].alias(c) for c in docs.columns if c not in made), *made)


def listed(spans: Column) -> Column:
    """kind:start:end of each, joined by commas."""
    name = F.array(*(F.lit(k) for k in KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(name, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def digests(found: DataFrame) -> DataFrame:
    base = listed(F.sort_array(F.concat("assign", "access", "hex")))
    counts = [F.size(k).cast("long").alias(f"n_{k}") for k in ("assign", "access", "hex", "markov")]
    return found.select("doc_id", *counts, F.sha2(base.cast("binary"), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"))


def redact(docs: DataFrame, marker: str = "[SECRET]", model: list[float] | None = None) -> DataFrame:
    """docs with each secret in text replaced; overlapping ones by one marker. A text without any stays as it is."""
    found = _found(docs, model).withColumn("_n", F.size("spans")).withColumn("_ends", F.when(F.col("_n") > 0, F.transform("spans", lambda s: s["end"])))
    found = found.withColumn("_ends", F.when(F.col("_n") > 0, _running(F.col("_ends"), "int", "max")))
    before = F.concat(F.array(F.lit(0)), F.slice("_ends", F.lit(1), F.col("_n") - 1))
    piece = F.zip_with("spans", before, lambda s, p: F.when(s["start"] >= p, F.concat(F.substring(F.col("text"), p + 1, s["start"] - p), F.lit(marker))).otherwise(F.lit("")))
    tail = F.substring(F.col("text"), F.element_at("_ends", -1) + 1, F.char_length("text"))
    text = F.when(F.col("_n") > 0, F.concat(F.array_join(piece, ""), tail)).otherwise(F.col("text"))
    return found.select(*((text if c == "text" else F.col("_row")[c]).alias(c) for c in docs.columns))
