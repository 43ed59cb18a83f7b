"""Helpers shared by the corpus operators: scratch tables, hashing and components."""

from __future__ import annotations

import re
import sys
import tempfile
import types
import uuid
from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words of a text: maximal runs without ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"

#: Bitmaps of values are this large, whatever the number of values.
BITMAP_BITS = 20


def worker_cache() -> dict:
    """A dictionary that lives as long as the Python process (worker or driver)."""
    name = "_beadframe_worker_cache"
    return sys.modules.setdefault(name, types.ModuleType(name)).__dict__


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder that spark.checkpoint.dir names.

    Only where the setting is absent and Spark runs on one machine (tests) a local folder
    is made; on a cluster executors would not share it, so that is an error. The path is
    removed when the application ends.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    context = spark.sparkContext
    if not base:
        if not re.fullmatch(r"local(\[.*\])?", context.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = worker_cache().setdefault("scratch", None) or tempfile.mkdtemp(prefix="spark-")
        worker_cache()["scratch"] = base
    path = f"{base}/{name}-{uuid.uuid4().hex}"
    hadoop = context._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(context._jsc.hadoopConfiguration()).deleteOnExit(hadoop)
    return path


def materialise(df: DataFrame, name: str, compression: str = "zstd", file_rows: int = 0) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage is cut, and a lost
    executor costs a reread, not a recomputation. With ``file_rows`` a file has at most so
    many rows: large ones are not held together by whoever writes or reads them."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.option("compression", compression).option("maxRecordsPerFile", file_rows).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def read_table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*columns) if columns else df


def bitmap_slot(column: Column) -> Column:
    return F.pmod(F.xxhash64(column), F.lit(1 << BITMAP_BITS))


def bitmap_of(df: DataFrame, column: str) -> bytes:
    """A bitmap of 2**BITMAP_BITS bits, whatever the number of rows, with each value's bit set."""
    out = np.zeros(1 << BITMAP_BITS, bool)
    out[df.select(bitmap_slot(F.col(column)).alias("s")).distinct().toPandas()["s"].to_numpy(np.int64)] = True
    return np.packbits(out, bitorder="little").tobytes()


def in_bitmap(column: Column, bitmap: bytes) -> Column:
    """False only for values that are not in the bitmap."""
    slot = bitmap_slot(column)
    byte = F.conv(F.hex(F.substring(F.lit(bitmap), F.shiftright(slot, 3).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    return F.getbit(byte, slot.bitwiseAND(7).cast("int")) == 1


def free_names(df: DataFrame, *names: str) -> list[str]:
    """Each name, with underscores after it until no column of ``df`` has it."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def join_totals(rows: DataFrame, totals: DataFrame, key: str, how: str = "inner") -> DataFrame:
    """``rows`` joined with a table of one row a ``key`` (long), such as an aggregation by it.

    Joined by the key itself, the aggregation's exchange would serve the join too, and a
    hot key would stay in one task. By an expression of the key the join gets exchanges
    of its own, whose large partitions adaptive execution splits.
    """
    own = totals.select(F.bitwise_not(key).alias("__own"), *(c for c in totals.columns if c != key))
    return rows.withColumn("__own", F.bitwise_not(key)).join(own, "__own", how).drop("__own")


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(u, v) long pairs -> (node, root): root is the smallest node reachable.

    Alternating large-star and small-star rounds; each round is one aggregation and one
    equi-join per step and its result is written to the shared folder. Null ends are
    dropped, self links are ignored. Rounds grow with the logarithm of the diameter.
    """

    def smallest(pairs: DataFrame) -> DataFrame:
        return pairs.groupBy("u").agg(F.min("v").alias("m"))

    def large_star(e: DataFrame) -> DataFrame:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = smallest(both).select("u", F.least("u", "m").alias("m"))
        return join_totals(both.where("v > u"), low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))

    def small_star(e: DataFrame) -> DataFrame:
        down = e.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        low = smallest(down)
        moved = join_totals(down, low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        return moved.unionByName(low.select("u", F.col("m").alias("v")))

    def state(e: DataFrame) -> tuple:
        return tuple(e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first())

    e = materialise(edges.select("u", "v").where("u <> v").distinct(), "links")
    before = state(e)
    for _ in range(max_rounds if before[0] else 0):
        e = large_star(e).where("u <> v").distinct()
        e = materialise(small_star(e).where("u <> v").distinct(), "links")
        if (now := state(e)) == before:
            break
        before = now
    else:
        if before[0]:
            raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    roots = e.select(F.col("v").alias("node")).distinct().select("node", F.col("node").alias("root"))
    # Written, so that a join with it has exchanges of its own, whose large partitions can be split.
    return materialise(e.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots), "components")


def across(buckets: DataFrame, verified: Callable[[DataFrame], DataFrame], links: DataFrame | None, plausible: Callable[[str, str], Column]) -> DataFrame:
    """(u, v) links that, with ``links``, connect all that a bucket's pairs connect.

    ``buckets``: (key, node, ...), key and node long. Members already connected by
    ``links`` are not compared: in each bucket, every member outside of its largest
    component meets those of other components. ``plausible(a, b)`` is a condition on two
    aliased members that every link meets; ``verified`` keeps the true (u, v) pairs.
    """
    rooted = buckets
    if links is not None:
        parts = connected_components(links)
        rooted = rooted.join(parts, "node", "left").withColumn("root", F.coalesce("root", "node"))
    else:
        rooted = rooted.withColumn("root", F.col("node"))
    rooted = materialise(rooted, "bucket-roots", "lz4")
    parted = rooted.groupBy("key", "root").count().groupBy("key").agg(F.max(F.struct("count", "root")).alias("most"), F.count("*").alias("roots"))
    parted = materialise(parted.where("roots > 1").select("key", F.col("most.root").alias("main")), "bucket-parts", "lz4")
    mixed = join_totals(rooted, parted, "key")
    a, b = mixed.where("root <> main").alias("a"), mixed.alias("b")
    # A pair outside of the largest component would be met from both ends.
    once = (F.col("b.root") == F.col("b.main")) | (F.col("a.node") < F.col("b.node"))
    pairs = a.join(b, (F.col("a.key") == F.col("b.key")) & (F.col("a.root") != F.col("b.root")) & once & plausible("a", "b"))
    return verified(pairs.select(F.least("a.node", "b.node").alias("u"), F.greatest("a.node", "b.node").alias("v")).distinct())


def stars(buckets: DataFrame, verified: Callable[[DataFrame], DataFrame], plausible: Callable[[str, str], Column]) -> DataFrame:
    """(u, v) links of each node with one hub: of its buckets' members, the one that meets most others.

    One pair a node, which connects most of a group of near copies, however large: what
    they are copies of is in more of their buckets than any of them.
    """
    own = [c for c in buckets.columns if c not in ("key", "node")]
    sizes = buckets.groupBy("key").agg(F.count("*").alias("met"))
    met = join_totals(buckets.select("key", "node"), sizes, "key").groupBy("node").agg(F.sum("met").alias("met"))
    weighed = materialise(join_totals(buckets, met, "node"), "bucket-met", "lz4")
    hubs = weighed.groupBy("key").agg(F.max(F.struct("met", "node", *own)).alias("b"))
    pairs = join_totals(weighed.select("key", F.struct("node", *own).alias("a")), hubs, "key")
    pairs = pairs.where((F.col("a.node") != F.col("b.node")) & plausible("a", "b"))
    best = pairs.groupBy(F.col("a.node").alias("v")).agg(F.max(F.struct("b.met", "b.node")).alias("b"))
    return verified(best.select(F.col("b.node").alias("u"), "v"))
