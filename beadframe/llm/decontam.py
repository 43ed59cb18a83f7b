"""Benchmark decontamination by size-partitioned MinHash containment search.

Test items are short and documents long, so whole-document MinHash cannot see them.
Items are partitioned by size (powers of two); for each size class present, a document
is covered by overlapping windows of twice that size, so that an item contained in the
document has a Jaccard similarity of about 0.2 or more with some window. A window whose
signature agrees with an item's in one of 64 positions makes the document a candidate:
an item with containment 0.8 in one passage is missed with probability below 2e-6.

A candidate's shingles are then joined with the items' by their text, and the exact share
of an item's distinct shingles decides. A document that holds that share of an item's
shingles holds one of its few rarest, so pairs come from those only: a phrase that many
items and documents share makes no pairs. Joins by a shingle or an item are salted.

What executors get of the benchmark are two bitmaps, sized by its rows up to 32 MB each; a
fuller bitmap lets more rows through to the join and loses none.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import free_names, materialise, worker_cache
from .simhash import LOWER

SHINGLE, CONTAINMENT, PERMUTATIONS, SALTS = 5, 0.8, 64, 32
#: A filter has 2**LEAST_BITS to 2**MOST_BITS bits: 64 a value, as far as that goes.
LEAST_BITS, MOST_BITS = 22, 28
MIX = np.uint64(0x9E3779B97F4A7C15)


def multipliers(n: int = PERMUTATIONS) -> np.ndarray:
    return np.random.default_rng(17).integers(0, 2**63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


BASE = 0x5851F42D4C957F2D
INVERSE = pow(BASE, -1, 2**64)


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n - 1) modulo 2**64, kept by the worker for the next text."""
    kept = worker_cache().get(("powers", base))
    if kept is None or len(kept) < n:
        with np.errstate(over="ignore"):
            kept = np.full(max(n, 1 << 16), base, np.uint64)
            kept[0] = 1
            kept = np.multiply.accumulate(kept)
        worker_cache()["powers", base] = kept
    return kept[:n]


def shingle_hashes(joined: bytes, shingle: int = SHINGLE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hashes, starts, ends) of the runs of ``shingle`` words in words joined by one space
    (fewer words: of the whole sequence; none: empty).

    A run's hash is its bytes' polynomial modulo 2**64, from prefix sums, so no word is
    touched one by one.
    """
    if not joined:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    data = np.frombuffer(joined, np.uint8)
    gaps = np.flatnonzero(data == 32)
    starts, ends = np.append(0, gaps + 1), np.append(gaps, len(data))
    width = min(shingle, len(starts))
    starts, ends = starts[: len(starts) - width + 1], ends[width - 1 :]
    out = np.empty(len(starts), np.uint64)
    with np.errstate(over="ignore"):
        for a in range(0, len(out), 16384):
            first, last = starts[a : a + 16384], ends[a : a + 16384]
            part = data[first[0] : last[-1]]
            sums = np.zeros(len(part) + 1, np.uint64)
            np.cumsum(part * powers(BASE, len(part)), out=sums[1:])
            h = (sums[last - first[0]] - sums[first - first[0]]) * powers(INVERSE, len(part))[first - first[0]]
            h ^= h >> np.uint64(29)
            h *= np.uint64(0xBF58476D1CE4E5B9)
            out[a : a + 16384] = h ^ (h >> np.uint64(32))
    return out, starts, ends


def size_class(n: int) -> int:
    return 1 << max(n - 1, 0).bit_length()


def scrambled(values: np.ndarray, size: int = 0, at: np.ndarray | int = 0) -> np.ndarray:
    """What a filter's bits are taken from: a shingle hash, or value ``at`` of a size class's signature."""
    with np.errstate(over="ignore"):
        x = (values ^ (np.uint64(size) << np.uint64(40))) + np.uint64(0xD6E8FEB86659FD93) * np.asarray(at, np.uint64)
        x ^= x >> np.uint64(31)
        x *= MIX
        return x


def filter_bits(values: int) -> int:
    return min(max((64 * values).bit_length(), LEAST_BITS), MOST_BITS)


def slots(x: np.ndarray, probe: int, bits: int) -> np.ndarray:
    return (x >> np.uint64((64 - bits) // 2 * (2 - probe))).astype(np.int64) & ((1 << bits) - 1)


def all_slots(x: np.ndarray, bits: int) -> np.ndarray:
    return np.concatenate([slots(x, p, bits) for p in range(3)], axis=None)


def present(bits: np.ndarray, values: np.ndarray, size: int = 0, at: np.ndarray | int = 0) -> np.ndarray:
    """Places (in flat order) of the values that have all three bits in a filter."""
    x = scrambled(values, size, at).ravel()
    found, width = np.arange(len(x)), (8 * len(bits)).bit_length() - 1
    for probe in range(3):
        p = slots(x[found] if probe else x, probe, width)
        found = found[(bits[p >> 3] >> (p & 7) & 1).astype(bool)]
        if not len(found):
            break
    return found


def segment_minima(h: np.ndarray, width: int, mult: np.ndarray) -> np.ndarray:
    """Minimum of each permutation over each run of ``width`` hashes."""
    parts, step = [], max(width, 2048 // width * width)
    with np.errstate(over="ignore"):
        for a in range(0, len(h), step):
            block = h[None, a : a + step] * mult[:, None]
            parts.append(np.minimum.reduceat(block, np.arange(0, block.shape[1], width), axis=1))
    return np.concatenate(parts, axis=1)


def is_candidate(h: np.ndarray, sizes: list[int], bits: np.ndarray, mult: np.ndarray) -> bool:
    """Some window's signature agrees with the filter of the items' signatures."""
    if not len(h) or not sizes:
        return False
    low, width, at = segment_minima(h, sizes[0], mult), sizes[0], np.arange(len(mult))[:, None]
    for size in sizes:
        while width < size:
            low = np.minimum.reduceat(low, np.arange(0, low.shape[1], 2), axis=1)
            width *= 2
        window = np.minimum(low[:, :-1], low[:, 1:]) if low.shape[1] > 1 else low
        if len(present(bits, window, size, at)):
            return True
    return False


def words_of(text: str | None) -> bytes:
    """The words of a text in lower case (A-Z), joined by one space."""
    return b" ".join((text or "").encode("utf-8", "replace").translate(LOWER).split())


def item_rows(items: DataFrame, text: str, id: str) -> DataFrame:
    """(item_id, item_mark, text): an item each, those equal in id and text once."""
    body = F.col(text).cast("string")
    return items.select(F.col(id).cast("long").alias("item_id"), text_mark(text).alias("item_mark"), body.alias("text")).distinct()


def item_shingles(rows: DataFrame) -> DataFrame:
    """(item_id, item_mark, n, size, h, shingle): an item's distinct shingles."""

    def run(batches):
        for b in batches:
            out = []
            for item, mark, t in zip(*(c.to_pylist() for c in b.columns)):
                joined = words_of(t)
                h, first, last = shingle_hashes(joined)
                own = {joined[i:j].decode(): x for i, j, x in zip(first.tolist(), last.tolist(), h.view("<i8").tolist())}
                out += [(item, mark, len(own), size_class(len(own)), x, s) for s, x in own.items()]
            names = ["item_id", "item_mark", "n", "size", "h", "shingle"]
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], t) for k, t in enumerate(kinds)], names=names)

    return rows.mapInArrow(run, "item_id long, item_mark long, n long, size long, h long, shingle string")


def filters(rows: DataFrame, shingles: DataFrame) -> tuple[list[int], np.ndarray, np.ndarray]:
    """Size classes and the two bitmaps (signatures, shingles)."""
    known = shingles.groupBy("size").agg(F.sum(1 / F.col("n")).alias("items"), F.count("*").alias("shingles")).collect()  # at most 64 powers of two
    mult = multipliers()
    of_items, of_shingles = filter_bits(PERMUTATIONS * round(sum(r["items"] for r in known))), filter_bits(sum(r["shingles"] for r in known))

    def signatures(batches):
        for b in batches:
            for t in b.column(2):
                h = np.unique(shingle_hashes(words_of(t.as_py()))[0])
                if len(h):
                    low = segment_minima(h, len(h), mult)[:, 0]
                    found = scrambled(low, size_class(len(h)), np.arange(len(mult)))
                    yield pa.RecordBatch.from_arrays([pa.array(all_slots(found, of_items))], names=["bit"])

    def singles(batches):
        for b in batches:
            h = b.column(0).to_numpy(zero_copy_only=False).astype("<i8").view("<u8")
            yield pa.RecordBatch.from_arrays([pa.array(all_slots(scrambled(h), of_shingles))], names=["bit"])

    def bitmap(df: DataFrame, bits: int) -> np.ndarray:
        """Spark packs stretches of 2**15 bits, so at most 2**bits / 8 bytes reach the driver."""
        packed = df.groupBy(F.shiftright("bit", 15).alias("part")).agg(F.bitmap_construct_agg(F.col("bit").bitwiseAND(32767)).alias("bits"))
        out = np.zeros((1 << bits) // 8, np.uint8)
        for r in packed.toLocalIterator():
            out[r["part"] * 4096 : r["part"] * 4096 + 4096] = np.frombuffer(r["bits"], np.uint8)
        return out

    return sorted(r["size"] for r in known), bitmap(rows.mapInArrow(signatures, "bit long"), of_items), bitmap(shingles.select("h").mapInArrow(singles, "bit long"), of_shingles)


def salted(many: DataFrame, few: DataFrame, key: str) -> DataFrame:
    """``many`` joined with ``few`` by ``key``; the rows of a key in ``many`` are dealt over SALTS parts by document."""
    left = many.withColumn("__salt", F.pmod(F.xxhash64("doc"), F.lit(SALTS)))
    right = few.withColumn("__salt", F.explode(F.sequence(*(F.lit(x).cast("long") for x in (0, SALTS - 1)))))
    return left.join(right, [key, "__salt"]).drop("__salt")


def contained_items(docs: DataFrame, items: DataFrame, text: str = "text", id: str = "doc_id", item_text: str = "text", item_id: str = "item_id", containment: float = CONTAINMENT) -> DataFrame:
    """One row a document and item found in it: (doc_id, mark, item_id, n_shared, n_item, containment).

    ``mark`` is the hash of the document's text, so rows that share an id are judged each
    by its own text; equal rows give one result. Texts with fewer than five words have
    one shingle, their whole sequence; null texts and texts without words have none and
    never match. Items equal in id and text count once. Null ids stay null. Empty tables
    give an empty result.
    """
    listed = item_rows(items, item_text, item_id)
    shingles = materialise(item_shingles(listed), "decontam-items")
    sizes, sig_bits, own_bits = filters(listed, shingles)
    mult = multipliers()

    def run(batches):
        for b in batches:
            ids, marks, found = [], [], []
            for i, mark, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2)):
                joined = words_of(t.as_py())
                h, first, last = shingle_hashes(joined)
                hits = present(own_bits, h)
                # A signature value is an item's shingle: without any shingle no window can agree.
                if len(hits) and is_candidate(h, sizes, sig_bits, mult):
                    own = list({joined[x:y].decode() for x, y in zip(first[hits].tolist(), last[hits].tolist())})
                    ids += [i] * len(own)
                    marks += [mark] * len(own)
                    found += own
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(marks, pa.int64()), pa.array(found, pa.string())], names=["doc_id", "mark", "shingle"])

    rows = docs.select(F.col(id).cast("long"), text_mark(text), F.col(text).cast("string"))
    hits = materialise(rows.mapInArrow(run, "doc_id long, mark long, shingle string").distinct(), "decontam-shared")
    hits = hits.select(F.struct("doc_id", "mark").alias("doc"), "shingle")
    own = shingles.select(F.struct("item_id", "item_mark", "n").alias("item"), "shingle")
    met = own.join(hits.groupBy("shingle").agg(F.count("*").alias("docs")), "shingle", "left")
    turn = F.row_number().over(W.partitionBy("item").orderBy(F.coalesce("docs", F.lit(0)), "shingle"))
    most_missing = F.col("item.n") - F.floor(F.col("item.n") * F.lit(containment))
    rare = met.withColumn("turn", turn).where((F.col("turn") <= most_missing + 1) & F.col("docs").isNotNull()).select("item", "shingle")
    pairs = salted(hits, rare, "shingle").select("doc", "item").distinct()
    shared = salted(pairs, own, "item").join(hits, ["doc", "shingle"]).groupBy("doc", "item").agg(F.count("*").alias("n_shared"))
    share = F.col("n_shared") / F.col("item.n")
    found = shared.where(share >= containment)
    return found.select("doc.doc_id", "doc.mark", "item.item_id", "n_shared", F.col("item.n").alias("n_item"), share.alias("containment"))


def text_mark(text: str):
    return F.xxhash64(F.coalesce(F.col(text).cast("string"), F.lit("")))


def remove_contaminated(docs: DataFrame, items: DataFrame, text: str = "text", id: str = "doc_id", **options) -> DataFrame:
    """The rows of ``docs`` without those that contain a test item; columns as they were."""
    key, mark = free_names(docs, "__id", "__mark")
    found = contained_items(docs, items, text, id, **options)
    found = materialise(found.select(F.col("doc_id").alias(key), F.col("mark").alias(mark)).distinct(), "decontam-hits")
    keyed = docs.withColumns({key: F.col(id).cast("long"), mark: text_mark(text)})
    return keyed.join(found, keyed[key].eqNullSafe(found[key]) & (keyed[mark] == found[mark]), "left_anti").select(*docs.columns)
