"""SimHash near-duplicates by deletion-variant signatures.

A text's fingerprint has 64 bits. Two fingerprints link at ``distance`` or fewer
differing bits. Cut into ``distance // 2 + 1`` segments, two linked fingerprints differ
by at most one bit in some segment, so both have, in that segment, a variant in which
one bit is wildcarded that is equal. The index holds each segment's one-wildcard
variants (64 a fingerprint); an equality join finds the candidates and a bit count on
the whole fingerprint verifies them. A pair is reported by its first common variant
only. Recall is exact, for any data.

Work is on *distinct* fingerprints, so groups of copies cost one row. Pairs in a bucket
grow with the square of its members, so fingerprints of variants that many share are
bucketed anew, exactly: of ``distance + 2`` blocks of the bits two at least are equal, which
is 15 keys a fingerprint however many of its variants are crowded. In those, each member is
first linked with one other; only members that are still in different components are
paired.

Before all that, each fingerprint is linked with one other of those that share a whole
segment (a row a segment, not one a variant). What that connects is not paired again, so
a large group of near copies costs about a link a member, whatever the buckets' sizes.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import across, connected_components, free_names, join_totals, materialise, stars

BITS, DISTANCE, SHINGLE = 64, 4, 4
OCTET_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.int64)
LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """Unsigned 64-bit SimHash of a whole text; zero for null or no words."""
    words = (text or "").encode("utf-8", "replace").translate(LOWER).split()
    if not words:
        return 0
    joined = b" ".join(words)
    digest = xxhash.xxh64_intdigest
    if len(words) <= shingle:
        return digest(joined, 42)
    starts = np.cumsum([0, *map(len, words)])[:-1] + np.arange(len(words))
    ends = starts + np.fromiter(map(len, words), np.int64, len(words))
    total, n = np.zeros(BITS, np.int64), len(words) - shingle + 1
    for at in range(0, n, 65536):
        a, b = starts[at : min(at + 65536, n)].tolist(), ends[at + shingle - 1 : min(at + 65536, n) + shingle - 1].tolist()
        h = np.array([digest(joined[i:j], 42) for i, j in zip(a, b, strict=True)], "<u8")
        octets = h.view(np.uint8).reshape(-1, 8)
        for i in range(8):
            total[8 * i : 8 * i + 8] += np.bincount(octets[:, i], minlength=256) @ OCTET_BITS
    return int(np.packbits(2 * total > n, bitorder="little").view("<u8")[0])


def with_fingerprint(docs: DataFrame, text: str = "text", id: str = "doc_id", extra: str | None = None) -> DataFrame:
    """(id, extra, fp): fp is the fingerprint as a signed long. Null texts have zero."""

    def run(batches):
        for b in batches:
            fp = np.array([fingerprint(t) for t in b.column(2).to_pylist()], "<u8").view("<i8")
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(fp)], names=["id", "extra", "fp"])

    other = F.col(extra) if extra else F.lit(None).cast("long")
    rows = docs.select(F.col(id).cast("long").alias("id"), other.alias("extra"), F.col(text).cast("string").alias("text"))
    return rows.mapInArrow(run, "id long, extra long, fp long")


def segments(distance: int = DISTANCE) -> list[tuple[int, int]]:
    """(first bit, width) of each segment: as few as leave one with at most one difference."""
    n = distance // 2 + 1
    cuts = [round(BITS * i / n) for i in range(n + 1)]
    return [(a, b - a) for a, b in zip(cuts, cuts[1:])]

def index_variants(fps: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """Distinct (fp, ...) -> (k, value, fp, ...): for each bit k the segment around it, k wildcarded."""
    rows = [(k, ((1 << w) - 1) << a, 1 << k) for a, w in segments(distance) for k in range(a, a + w)]
    signed = lambda x: (x & (2**64 - 1)) - ((x & (2**64 - 1)) >> 63 << 64)
    variants = F.array(*[
        F.struct(F.lit(k).alias("k"), F.col("fp").bitwiseAND(F.lit(signed(mask & ~bit)).cast("long")).alias("value"))
        for k, mask, bit in rows
    ])
    return fps.select(F.explode(variants).alias("x"), *fps.columns).select("x.k", "x.value", *fps.columns)


def is_first_variant(x: str, k: str, distance: int = DISTANCE) -> str:
    """SQL: k is the first variant that two fingerprints with this XOR have in common."""
    signed = lambda v: f"{v - (v >> 63 << 64)}L" if v != 1 << 63 else "(-9223372036854775807L - 1L)"
    arms = []
    for a, w in segments(distance):
        m = f"({x} & {signed(((1 << w) - 1) << a)})"
        arms.append(f"WHEN bit_count({m}) = 0 THEN {k} = {a} WHEN bit_count({m}) = 1 THEN {m} = shiftleft(1L, {k})")
    return f"(CASE {' '.join(arms)} ELSE false END)"


def block_pairs(fp: str = "fp", distance: int = DISTANCE) -> Column:
    """array<long>: keys of which two linked fingerprints share one, whatever the fingerprints.

    Of ``distance + 2`` blocks of the bits two at least are equal: a key a pair of blocks.
    """
    signed = lambda x: x - (x >> 63 << 64)
    blocks = [sum(1 << int(i) for i in x) for x in np.array_split(range(BITS), distance + 2)]
    masks = [signed(a | b) for a, b in combinations(blocks, 2)]
    return F.array(*(F.xxhash64(F.lit(j), F.col(fp).bitwiseAND(F.lit(m).cast("long"))) for j, m in enumerate(masks)))


def close(pairs: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """The (u, v) pairs that link."""
    return pairs.where(F.bit_count(F.col("u").bitwiseXOR(F.col("v"))) <= distance)


def plausible(a: str, b: str, distance: int = DISTANCE) -> Column:
    return F.bit_count(F.col(f"{a}.node").bitwiseXOR(F.col(f"{b}.node"))) <= distance


def hub_links(fps: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """Distinct (fp) -> (u, v): a link of each fingerprint with one of those that share a whole segment.

    Not all are found so, but most of a large group of near copies, for a row a segment.
    """
    signed = lambda x: x - (x >> 63 << 64)
    keys = F.array(*(F.xxhash64(F.lit(a), F.col("fp").bitwiseAND(F.lit(signed(((1 << w) - 1) << a)).cast("long"))) for a, w in segments(distance)))
    buckets = fps.select(F.explode(keys).alias("key"), F.col("fp").alias("node"))
    sizes = materialise(buckets.groupBy("key").count().where("count > 1"), "simhash-hub-sizes", "lz4")
    shared = materialise(join_totals(buckets, sizes.select("key"), "key"), "simhash-hub-buckets", "lz4")
    return stars(shared, lambda x: close(x, distance), lambda x, y: plausible(x, y, distance))


def links(fps: DataFrame, distance: int = DISTANCE, dense: int = 256, known: DataFrame | None = None) -> DataFrame:
    """Distinct (fp) -> (u, v) with the same components as all links.

    Buckets of up to ``dense`` members give every link once; the members of larger ones
    are bucketed anew by :func:`block_pairs` and give links that connect the same
    fingerprints. No member is left out in either way, and no bucket is gathered in one task.

    ``known``: (node, root) of fingerprints that are connected already. Their pairs are not
    found again, and links between two components are given as pairs of their roots.
    """
    rows = fps.withColumn("root", F.lit(None).cast("long")) if known is None else fps.join(known.withColumnRenamed("node", "fp"), "fp", "left")
    index = materialise(index_variants(rows.select("fp", "root"), distance), "simhash-index", "lz4")
    top = F.coalesce("root", "fp")
    crowded = index.groupBy("k", "value").agg(F.count("*").alias("n"), F.min(top).alias("first"), F.max(top).alias("last")).where(F.col("n") > dense)
    crowded = materialise(crowded.select("k", "value", (F.col("first") < F.col("last")).alias("mixed")), "simhash-crowded")
    sparse = index.join(crowded, ["k", "value"], "left_anti") if not crowded.isEmpty() else index
    near = F.expr(
        f"a.fp < b.fp AND bit_count(a.fp ^ b.fp) <= {distance} AND {is_first_variant('(a.fp ^ b.fp)', 'a.k', distance)}"
        " AND coalesce(a.root <> b.root, true)"
    )
    a, b = sparse.alias("a"), sparse.alias("b")
    out = a.join(b, (F.col("a.k") == F.col("b.k")) & (F.col("a.value") == F.col("b.value")) & near)
    out = out.select(F.coalesce("a.root", "a.fp").alias("u"), F.coalesce("b.root", "b.fp").alias("v"))
    mixed = crowded.where("mixed")
    if not mixed.isEmpty():
        members = index.join(mixed.select("k", "value"), ["k", "value"], "left_semi").select("fp").distinct()
        buckets = members.select(F.explode(block_pairs("fp", distance)).alias("key"), F.col("fp").alias("node"))
        buckets = materialise(buckets, "simhash-blocks", "lz4")
        check, may = lambda x: close(x, distance), lambda x, y: plausible(x, y, distance)
        first = materialise(stars(buckets, check, may), "simhash-stars")
        have = first if known is None else first.unionByName(known.select(F.col("node").alias("u"), F.col("root").alias("v")))
        out = out.unionByName(first).unionByName(across(buckets, check, have, may))
    return out


def connecting(fps: DataFrame, distance: int = DISTANCE, dense: int = 256) -> DataFrame:
    """Distinct (fp) -> (u, v) pairs of fingerprints that connect what all links connect, about one a fingerprint."""
    known = connected_components(hub_links(fps, distance))
    return known.select(F.col("node").alias("u"), F.col("root").alias("v")).unionByName(links(fps, distance, dense, known))


def near_duplicates(docs: DataFrame, text: str = "text", id: str = "doc_id", distance: int = DISTANCE, dense: int = 256, extra: str | None = None) -> DataFrame:
    """One row a row of ``docs``: (id, extra, fp, root, component_id); extra: a long column.

    ``component_id`` is the smallest id reachable over links. Null texts and texts
    without words have fingerprint zero and link like any other. Null ids never name a
    class (``component_id`` is null only if the class has no id). Repeated rows are kept.
    Texts of any length are read whole; other columns of ``docs``, whatever their names,
    are not read. An empty table gives an empty result.
    """
    rows = materialise(with_fingerprint(docs, text, id, extra), "simhash-rows")
    fps = materialise(rows.groupBy("fp").agg(F.min("id").alias("low")), "simhash-fps")
    parts = connected_components(connecting(fps.select("fp"), distance, dense))
    named = fps.join(parts.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    named = materialise(named, "simhash-named")
    lows = named.groupBy("root").agg(F.min("low").alias("component_id"))
    label = materialise(join_totals(named.select("fp", "root"), lows, "root"), "simhash-labels")
    return rows.join(label, "fp", "left").select("id", "extra", "fp", "root", "component_id")


def deduplicate(docs: DataFrame, text: str = "text", id: str = "doc_id", **options) -> DataFrame:
    """Keeps, of each class, the row with the smallest id; all columns stay as they were.

    Rows of a class that share the smallest id count as one if their texts are equal; if
    not, the one with the smallest text hash stays. A class without any id keeps one row.
    """
    return keep_first(docs, lambda keyed, text, id, mark: near_duplicates(keyed, text, id, extra=mark, **options), text, id)


def keep_first(docs: DataFrame, find, text: str, id: str) -> DataFrame:
    """What ``deduplicate`` says, of the classes that ``find(docs, text, id, mark)`` gives as (id, extra, root); extra: the text's hash."""
    key, mark = free_names(docs, "__id", "__mark")
    keyed = docs.withColumns({key: F.col(id).cast("long"), mark: F.xxhash64(F.coalesce(F.col(text).cast("string"), F.lit("")))})
    found = find(keyed, text, key, mark)
    best = found.groupBy("root").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "extra")).alias("x"))
    best = materialise(best.select(F.col("x.id").alias(key), F.col("x.extra").alias(mark)), "dedup-best")
    same = keyed[key].eqNullSafe(best[key]) & (keyed[mark] == best[mark])
    kept = keyed.join(best, same, "left_semi")
    # Whole texts are compared for repeated rows only if ids and text hashes show that there are some.
    again = found.groupBy("id", "extra").count().where("count > 1")
    return (kept if again.isEmpty() else kept.dropDuplicates([key, mark])).select(*docs.columns)
