"""Mixing sources to target weights by entropy balancing (operator 9), with DataFrame functions only.

1. Sizes: words of each document, once; sums for each source.
2. Targets: sources in code point order (null last) have weights that repeat; they share ``share`` times all words, but none gets
   more than ``most_copies`` times its own; the excess goes to the others by weight.
3. Rates: documents get rates r that stay closest to 1 in relative entropy, weighted by size, such that each source's words meet
   its target. A source's words are its only constraint, so the tilt is the same for all its documents: the optimum is
   r = exp(lambda) = target / source_size, one multiplier for each source, held below most_copies. The multipliers
   solve the convex dual, whose gradient and curvature are grouped sums over documents. Newton steps are taken until no
   gradient exceeds TOLERANCE of its target. All sources step at once; the sums combine before they shuffle.
4. Copies: a rate's whole part, and one more for documents whose hash falls below a cut of the source. The cut is set where the
   words taken meet the target, first by the sums of BINS ranges of the hash, then document by document within the one range
   that the cut falls into; so a source's words miss its target by half a document at most. What is missing is then made up, CORRECTIONS
   times, by one more or one less copy of the largest document that fits into it.

Defined cases: null and blank texts have size 0 and are taken as 0 words. A null source is a source of its own and comes last. Sources
without words have target 0. Rows that repeat are documents of their own. An empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from barloom.llm.common import durable, small_side

WEIGHTS = (3, 1, 2)
SHARE = 1.5
MOST_COPIES = 2
TOLERANCE = 1e-9
BINS = 4096
MOST_STEPS = 100
CORRECTIONS = 4


def sized(docs: DataFrame) -> DataFrame:
    """docs with size: its number of words."""
    return docs.withColumn("size", F.coalesce(F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long"))


def ranked(sources: DataFrame) -> DataFrame:
    """sources with place: from 0 on in code point order, null last. Sorted by ranges over all machines; only the sizes of the
    ranges are numbered in one place."""
    parts = durable(sources.repartitionByRange(F.col("source").isNull(), F.col("source")).withColumn("part", F.spark_partition_id()), "ranges")
    within = parts.withColumn("n", F.row_number().over(Window.partitionBy("part").orderBy(F.col("source").asc_nulls_last())))
    sizes = parts.groupBy("part").agg(F.count("*").alias("k"))
    before = sizes.select("part", F.coalesce(F.sum("k").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    return within.join(before, "part").select(*sources.columns, (F.col("before") + F.col("n") - 1).alias("place"))


def targets(sums: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: int = MOST_COPIES) -> DataFrame:
    """sums (source, source_size) with weight and target.

    A source is held at its limit if the level that the others share by weight reaches it; each round is one sum over sources.
    """
    w = F.element_at(F.array(*(F.lit(float(x)) for x in weights)), (F.col("place") % len(weights) + 1).cast("int"))
    rows = durable(ranked(sums).withColumn("weight", w).withColumn("limit", F.lit(float(most)) * F.col("source_size")), "weights")
    total = rows.agg(F.sum("source_size")).first()[0] or 0
    level, held = 0.0, -1
    while True:
        free, fixed, n = rows.agg(F.sum(F.when(F.col("limit") > F.col("weight") * level, F.col("weight")).otherwise(0.0)), F.sum(F.when(F.col("limit") <= F.col("weight") * level, F.col("limit")).otherwise(0.0)), F.count(F.when(F.col("limit") <= F.col("weight") * level, 1))).first()
        if not free or n == held:
            break
        level, held = (share * total - fixed) / free, n
    return rows.select("source", "source_size", "weight", F.least("limit", F.col("weight") * F.lit(level)).alias("target"))


def rates(sizes: DataFrame, goals: DataFrame, most: int = MOST_COPIES) -> DataFrame:
    """goals (source, target) with rate: exp of the multiplier that meets the target.

    Documents enter by the words of each size, so that a step reads one row for each size of a source and not each document.
    """
    by_size = durable(sizes.where("size > 0").groupBy("source", "size").agg((F.count("*") * F.col("size")).alias("words")), "sizes")
    now = durable(goals.select("source", "target", F.lit(0.0).alias("lam")), "multipliers")
    for _ in range(MOST_STEPS):
        r = F.least(F.exp("lam"), F.lit(float(most)))
        at = by_size.join(small_side(now), by_size["source"].eqNullSafe(now["source"])).select(now["source"], "target", "lam", "words", r.alias("r"))
        # The dual's gradient is the target less the words taken; its curvature is the words taken. The words are added as integers, so that
        # reruns agree to the last digit.
        sums = at.groupBy("source", "target", "lam").agg((F.sum("words") * F.max("r")).alias("taken"))
        gap = F.col("target") - F.col("taken")
        # The multiplier stays below the logarithm of the limit, which every target allows.
        step = F.least(F.col("lam") + F.greatest(F.lit(-2.0), F.least(F.lit(2.0), gap / F.col("taken"))), F.log(F.lit(float(most))))
        small = F.abs(gap) <= TOLERANCE * F.greatest(F.col("target"), F.lit(1.0))
        after = durable(sums.select("source", "target", F.when(small, F.col("lam")).otherwise(step).alias("lam"), small.alias("done")), "multipliers")
        left = after.where(~F.col("done")).count()
        now = after.select("source", "target", "lam")
        now.written_to = after.written_to
        if not left:
            break
    else:
        raise RuntimeError("the multipliers did not settle")
    out = goals.join(small_side(now).select(F.col("source").alias("s"), "lam"), F.col("source").eqNullSafe(F.col("s")), "left")
    return out.select("source", "source_size", "target", F.coalesce(F.least(F.exp("lam"), F.lit(float(most))), F.lit(0.0)).alias("rate"))


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: int = MOST_COPIES) -> DataFrame:
    """doc_id, source, size, source_size, target, rate, copies and taken (copies times size) of each row of docs (doc_id, text, source); other columns
    are left out."""
    hashed = F.pmod(F.xxhash64("doc_id", "text", F.lit("mix")), F.lit(1 << 52)) / float(1 << 52)
    rows = durable(sized(docs.select("doc_id", "text", "source")).withColumn("u", hashed).withColumn("bin", F.floor(F.col("u") * BINS).cast("int")).drop("text"), "sized")
    sums = rows.groupBy("source").agg(F.sum("size").alias("source_size"))
    goals = durable(targets(sums, weights, share, most), "targets")
    by_source = durable(rates(rows, goals, most).withColumn("base", F.floor(F.col("rate") + 1e-9)).withColumn("wanted", F.col("target") - F.col("base") * F.col("source_size")), "rates")
    # The range of hashes in which the words taken once more pass what is wanted.
    bins = rows.groupBy("source", "bin").agg(F.sum("size").alias("words"))
    so_far = Window.partitionBy("source").orderBy("bin")
    s = by_source.select(F.col("source").alias("s"), "source_size", "target", "rate", "base", "wanted")
    placed = bins.withColumn("before", F.sum("words").over(so_far) - F.col("words")).join(s, F.col("source").eqNullSafe(F.col("s")))
    cut = placed.where((F.col("before") + F.col("words") >= F.col("wanted")) & (F.col("wanted") > 0)).groupBy("s").agg(F.min(F.struct("bin", "before")).alias("x")).select(F.col("s").alias("c"), F.col("x.bin").alias("cut"), F.col("x.before").alias("before"))
    plan = durable(s.join(cut, F.col("s").eqNullSafe(F.col("c")), "left").drop("c"), "cuts")
    side = small_side(plan)
    at = rows.join(side, F.col("source").eqNullSafe(F.col("s")), "left").drop("s")
    extra = F.when(F.col("cut").isNull() | (F.col("wanted") <= 0), 0).when(F.col("bin") < F.col("cut"), 1).when(F.col("bin") > F.col("cut"), 0)
    at = at.withColumn("extra", extra)
    # Within that range the documents are taken in the order of the hash; it holds a BINS-th part of a source.
    inside = at.where("extra is null")
    order = Window.partitionBy("source").orderBy("u", "doc_id", "size").rowsBetween(Window.unboundedPreceding, 0)
    inside = inside.withColumn("sum", F.col("before") + F.sum("size").over(order)).withColumn("extra", (F.col("sum") - F.col("size") / 2.0 <= F.col("wanted")).cast("int")).drop("sum")
    done = at.where("extra is not null").unionByName(inside)
    copies = F.when(F.col("size") > 0, F.least(F.col("base") + F.col("extra"), F.lit(most))).otherwise(F.lit(0)).cast("long")
    done = durable(done.withColumn("copies", copies).drop("bin", "base", "wanted", "cut", "before", "extra"), "copies")
    done = corrected(done, most)
    return done.withColumn("taken", F.col("copies") * F.col("size")).drop("u")


def corrected(rows: DataFrame, most: int) -> DataFrame:
    """rows with copies changed by one for at most CORRECTIONS documents of a source, such that its words come nearer to its target.

    Each time a source's largest document that fits into what is missing (or is too much) is found by a grouped maximum. Rows that
    repeat change together, if they fit together.
    """
    keys = ("source", "size", "u", "doc_id")

    def same(a: str, b: str):
        out = F.lit(True)
        for k in keys:
            out = out & F.col(f"{a}.{k}").eqNullSafe(F.col(f"{b}.{k}"))
        return out

    gaps = durable(rows.groupBy("source").agg(F.max("target").alias("target"), F.sum(F.col("copies") * F.col("size")).alias("taken")).select("source", (F.col("target") - F.col("taken")).alias("gap")), "gaps")
    changes = None
    for _ in range(CORRECTIONS):
        open_ = rows.alias("r") if changes is None else rows.alias("r").join(small_side(changes).alias("c"), same("r", "c"), "left_anti")
        fits = (F.col("size") > 0) & (F.col("size") <= F.abs("gap")) & F.when(F.col("gap") > 0, F.col("copies") < most).otherwise(F.col("copies") > 0)
        at = open_.join(small_side(gaps).select(F.col("source").alias("s"), "gap"), F.col("r.source").eqNullSafe(F.col("s"))).where(fits)
        best = at.groupBy("s").agg(F.max(F.struct("size", "u", "doc_id")).alias("x"), F.max("gap").alias("gap"))
        best = durable(best.select(F.col("s").alias("source"), "x.size", "x.u", "x.doc_id", "gap"), "best")
        n = rows.alias("r").join(small_side(best).alias("b"), same("r", "b")).groupBy(*(f"b.{k}" for k in keys)).agg(F.count("*").alias("n"), F.max("gap").alias("gap"))
        delta = F.when(F.col("n") * F.col("size") <= F.abs("gap"), F.signum("gap").cast("int")).otherwise(F.lit(0))
        new = durable(n.select(*keys, delta.alias("delta"), (delta * F.col("n") * F.col("size")).alias("moved")), "changes")
        changes = new if changes is None else durable(changes.unionByName(new), "changes")
        moved = small_side(new).select(F.col("source").alias("s"), "moved")
        gaps = durable(gaps.join(moved, F.col("source").eqNullSafe(F.col("s")), "left").select("source", (F.col("gap") - F.coalesce("moved", F.lit(0))).alias("gap")), "gaps")
    out = rows.alias("r").join(small_side(changes).alias("c"), same("r", "c"), "left")
    return out.select(*(F.col(f"r.{c}") for c in rows.columns if c != "copies"), (F.col("r.copies") + F.coalesce("c.delta", F.lit(0))).alias("copies"))
