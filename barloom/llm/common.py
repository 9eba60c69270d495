"""What several operators share: durable tables, document scans and connected components."""

from __future__ import annotations

import contextlib
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Sides of at most this many bytes may be broadcast; larger ones are shuffled.
BROADCAST_BYTES = 64 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, from ``spark.checkpoint.dir``.

    Where it is unset, a folder of our own is set, which is only right when everything runs on one machine; on
    a cluster without the setting this raises instead of writing to a disk that other machines cannot see.
    """
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
        at = "file://" + tempfile.mkdtemp(prefix="barloom-")
        spark.conf.set("spark.checkpoint.dir", at)
    return at.rstrip("/")


_WRITTEN: list[DataFrame] = []


@contextlib.contextmanager
def scratch() -> Iterator[list[DataFrame]]:
    """Deletes the tables that ``durable`` wrote within it, but those that are put into its list: for steps whose results are written when it ends."""
    first, keep = len(_WRITTEN), []
    yield keep
    for df in _WRITTEN[first:]:
        if not any(df.written_to == k.written_to for k in keep):
            drop(df)
    del _WRITTEN[first:]


def durable(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once as Parquet into the shared folder and read back: cuts the lineage, and survives the
    loss of any executor."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    schema = df.schema
    df.write.parquet(path)
    out = spark.read.schema(schema).parquet(path)
    out.written_to = path
    _WRITTEN.append(out)
    return out


def drop(df: DataFrame) -> None:
    """Deletes the files of a table that ``durable`` wrote and that no later plan reads."""
    spark = df.sparkSession
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(df.written_to)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def stored_bytes(df: DataFrame) -> int:
    """Size on disk of a table that ``durable`` wrote."""
    spark = df.sparkSession
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(df.written_to)
    return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getContentSummary(path).getLength()


def small_side(df: DataFrame, most: int = BROADCAST_BYTES) -> DataFrame:
    """A durable table with a broadcast hint if its files are small enough; else as it is, to be shuffled."""
    return F.broadcast(df) if stored_bytes(df) * 4 <= most else df


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def held_out(doc_id: Column) -> Column:
    """True where crc32 of the id as text leaves 2 modulo 4. A null id counts as held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(True))


def text_bytes(text: Column) -> Column:
    """UTF-8 of a text, null as empty."""
    return F.coalesce(text.cast("binary"), F.lit("").cast("binary"))


def partitions(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def _stars(edges: DataFrame) -> DataFrame:
    """One round of large-star and small-star over edges (u, v)."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
    down = large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    low = down.groupBy("u").agg(F.min("v").alias("m"))
    near = down.join(low, "u")
    return near.select("u", F.col("m").alias("v")).unionByName(near.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))).distinct()


def connected_components(edges: DataFrame, most_rounds: int = 64) -> DataFrame:
    """Components of an undirected graph given as edges (u long, v long).

    Returns (node, root), root the smallest node reachable, one row for each node that has an edge to another
    one. Alternates large-star and small-star; each round is two grouped minima, which combine before they
    shuffle, and joins in which only the edge side can be skewed, so that adaptive execution splits a hot node.
    Rounds grow with the logarithm of the longest path. Nothing but a checksum goes to the driver.
    Self loops and null ends are ignored; no edges give no rows.
    """
    now = durable(edges.select("u", "v").where("u <> v").distinct(), "edges")
    before = None
    for _ in range(most_rounds):
        stars = durable(_stars(now), "stars")
        sums = tuple(stars.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        drop(now)
        now = stars
        if sums == before:
            return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
        before = sums
    raise RuntimeError("components did not settle")
