"""Near-duplicate texts by Jaccard similarity of their five-word shingles, or by SimHash.

Two texts link if their sets of distinct shingles have a similarity of ``SIMILAR`` or
more, or if op5's fingerprints link them. Of the former, a pair is a candidate if one of 32 bands of five MinHash values agrees: a pair at
0.8 is missed with probability (1 - 0.8**5)**32 = 3e-6, a closer one less often, whatever
the texts. Each candidate is verified on its whole sets. (SimHash's deletion variants
alone cannot find them: at 13 bits, seven segments would leave keys of eight bits.)

Work is on *distinct* sets, so groups of copies cost one row. Each set is first verified
against one other set of its buckets; then sets that are still in different classes are
paired. A large group of near copies is one class after the first step, so its pairs need
not be made. Where a passage that many texts share crowds a bucket, its sets are paired
by their rarest shingles instead. No set is left out in any step.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import across, bitmap_of, connected_components, in_bitmap, join_totals, materialise, stars
from .decontam import MIX, multipliers, shingle_hashes
from .simhash import LOWER, fingerprint, keep_first
from .simhash import links as simhash_links

SHINGLE, SIMILAR, BANDS, ROWS = 5, 0.8, 32, 5


def shingle_set(text: str | None) -> np.ndarray:
    """Sorted distinct hashes of a text's shingles (under five words: of the whole text)."""
    words = (text or "").encode("utf-8", "replace").translate(LOWER).split()
    return np.unique(shingle_hashes(b" ".join(words), SHINGLE)[0])


def band_keys(h: np.ndarray) -> np.ndarray:
    """A key for each band of a set's MinHash signature; none for an empty set."""
    if not len(h):
        return np.zeros(0, np.int64)
    mult = multipliers(BANDS * ROWS)
    low = np.full(len(mult), np.iinfo(np.uint64).max, np.uint64)
    with np.errstate(over="ignore"):
        for a in range(0, len(h), 1024):
            low = np.minimum(low, (h[None, a : a + 1024] * mult[:, None]).min(axis=1))
        out = np.arange(BANDS, dtype=np.uint64)
        for column in low.reshape(BANDS, ROWS).T:
            out = (out ^ column) * MIX
            out ^= out >> np.uint64(29)
    return out.view(np.int64)


def with_sets(rows: DataFrame) -> DataFrame:
    """(id, extra, text) -> (id, extra, node, size, keys, fp): node names the set of shingles, fp is SimHash's."""

    def run(batches):
        for b in (b.slice(k, 200) for b in batches for k in range(0, len(b), 200)):
            sets = [shingle_set(t) for t in b.column(2).to_pylist()]
            node = np.array([xxhash.xxh64_intdigest(s.tobytes()) for s in sets], "<u8").view("<i8")
            keys = pa.array([band_keys(s) for s in sets], pa.list_(pa.int64()))
            size = pa.array([len(s) for s in sets], pa.int64())
            fp = np.array([fingerprint(t) for t in b.column(2).to_pylist()], "<u8").view("<i8")
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(node), size, keys, pa.array(fp)], names=["id", "extra", "node", "size", "keys", "fp"])

    return rows.select("id", "extra", "text").mapInArrow(run, "id long, extra long, node long, size long, keys array<long>, fp long")


def sets_of(texts: DataFrame) -> DataFrame:
    """(node, text) -> (node, shingles)."""

    def run(batches):
        for b in (b.slice(k, 200) for b in batches for k in range(0, len(b), 200)):
            sets = [shingle_set(t).view(np.int64) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(sets, pa.list_(pa.int64()))], names=["node", "shingles"])

    return texts.select("node", "text").mapInArrow(run, "node long, shingles array<long>")


def verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The (u, v) pairs whose sets are similar."""
    left, right = (sets.select(F.col("node").alias(n), F.col("shingles").alias(s)) for n, s in (("u", "x"), ("v", "y")))
    return pairs.join(right, "v").join(left, "u").withColumn("n", F.size(F.array_intersect("x", "y"))).where("10L * n >= 8L * (size(x) + size(y) - n)").select("u", "v")


def plausible(a: str, b: str) -> Column:
    """Sets whose sizes differ by more than a fifth are not similar."""
    p, q = F.col(f"{a}.size"), F.col(f"{b}.size")
    return 10 * F.least(p, q) >= 8 * F.greatest(p, q)


def rare_shingles(sets: DataFrame) -> DataFrame:
    """(key, node, size, rank): shingles of which two similar sets share one, whatever the sets.

    A set's shingles are put in order, the rarest first; of two similar sets with n and m
    shingles, one of the first n - 0.8 n + 1 of the one is among the first m - 0.8 m + 1 of
    the other. So what very many sets have in common brings no two of them together.
    """
    each = sets.select("node", F.size("shingles").cast("long").alias("size"), F.explode("shingles").alias("key"))
    times = each.groupBy("key").agg(F.count("*").alias("times"))
    order = W.partitionBy("node").orderBy("times", "key")  # the shingles of one text
    ranked = join_totals(each, times, "key").withColumn("rank", F.row_number().over(order).cast("long"))
    return ranked.where("times > 1 AND rank <= size - (8 * size + 9) DIV 10 + 1").select("key", "node", "size", "rank")


def may_share_enough(a: str, b: str) -> Column:
    """At the first shingle in order that similar sets share, enough are left in both: 8/18 of both sizes."""
    left = F.least(F.col(f"{a}.size") - F.col(f"{a}.rank"), F.col(f"{b}.size") - F.col(f"{b}.rank")) + 1
    return plausible(a, b) & (18 * left >= 8 * (F.col(f"{a}.size") + F.col(f"{b}.size")))


def links(nodes: DataFrame, sets_for, dense: int = 64) -> DataFrame:
    """Distinct (node, size, keys) -> (u, v) with the same components as all links.

    ``sets_for`` gives (node, shingles) of the nodes it is given. Bands that over ``dense``
    sets share give way to :func:`rare_shingles` of these sets, which finds the same pairs.
    """
    index = materialise(nodes.select("node", "size", F.explode("keys").alias("key")), "near-index", "lz4")
    sizes = materialise(index.groupBy("key").agg(F.count("*").alias("n")).where("n > 1"), "near-sizes", "lz4")
    shared = materialise(join_totals(index, sizes, "key"), "near-shared", "lz4")
    sets = materialise(sets_for(shared.select("node").distinct()), "near-sets")
    check = lambda pairs: verified(pairs, sets)
    buckets = shared.select("key", "node", "size")
    first = materialise(stars(buckets, check, plausible), "near-stars")
    out = first.unionByName(materialise(across(shared.where(F.col("n") <= dense).select("key", "node", "size"), check, first, plausible), "near-sparse"))
    crowded = shared.where(F.col("n") > dense).select("node").distinct()
    if not crowded.isEmpty():
        rare = materialise(rare_shingles(sets.join(crowded, "node", "left_semi")), "near-rare", "lz4")
        out = out.unionByName(materialise(across(rare, check, out, may_share_enough), "near-crowded"))
    return out


def fingerprint_links(nodes: DataFrame) -> DataFrame:
    """(node, fp) -> (u, v): the links of fingerprints, between the smallest node of each, and of each one's nodes."""
    low = materialise(nodes.groupBy("fp").agg(F.min("node").alias("low")), "near-fps")
    found = simhash_links(low.select("fp"))
    ends = [low.select(F.col("fp").alias(x), F.col("low").alias(f"low_{x}")) for x in "uv"]
    between = found.join(ends[0], "u").join(ends[1], "v").select(F.col("low_u").alias("u"), F.col("low_v").alias("v"))
    within = nodes.join(low, "fp").where("node <> low").select(F.col("low").alias("u"), F.col("node").alias("v"))
    return between.unionByName(within)


def near_duplicates(docs: DataFrame, text: str = "text", id: str = "doc_id") -> DataFrame:
    """One row a row of ``docs``: (id, extra, root); extra is the text's xxhash64, root names the class.

    Texts without words (null too) are copies of one another. Repeated rows are kept. An
    empty table gives an empty result.
    """
    whole = F.coalesce(F.col(text).cast("string"), F.lit(""))
    source = docs.select(F.col(id).cast("long").alias("id"), F.xxhash64(whole).alias("extra"), whole.alias("text"))
    rows = materialise(with_sets(source), "near-rows")
    nodes = rows.groupBy("node").agg(F.min("size").alias("size"), F.any_value("keys").alias("keys"), F.min("extra").alias("extra"))

    def sets_for(wanted: DataFrame) -> DataFrame:
        some = materialise(nodes.select("node", "extra").join(wanted, "node", "left_semi"), "near-texts")
        # A bitmap of fixed size says which texts may be wanted; one of each is shuffled.
        texts = source.where(in_bitmap(F.col("extra"), bitmap_of(some, "extra"))).groupBy("extra").agg(F.any_value("text").alias("text"))
        return sets_of(texts.join(some, "extra").select("node", "text"))

    every = links(nodes, sets_for).unionByName(fingerprint_links(rows.select("node", "fp").distinct()))
    parts = connected_components(every).withColumnRenamed("node", "part")
    out = rows.join(parts, rows["node"] == parts["part"], "left")
    return out.select("id", "extra", F.coalesce("root", "node").alias("root"))


def deduplicate(docs: DataFrame, text: str = "text", id: str = "doc_id") -> DataFrame:
    """Keeps, of each class, the row with the smallest id, as ``simhash.deduplicate`` does."""
    return keep_first(docs, lambda keyed, text, id, mark: near_duplicates(keyed, text, id), text, id)
