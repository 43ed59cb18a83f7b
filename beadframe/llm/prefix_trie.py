"""Prefix trie of conversations rebuilt from a base's head and their own suffix.

The fingerprint of a sequence of turns is an element of a monoid: four polynomial hashes
modulo 2**31 - 1, and the four powers that say how far to shift what stands before. From
the fingerprints of the stored conversations' prefixes, that of any prefix of any rebuilt
one follows by one product (head with suffix) and one division (a suffix is a prefix
without a shorter prefix), so rebuilt texts never exist; an entry is the fingerprint and a
reference to the stored turn it ends with, which is 120 bits of the SHA-256 of role and
text, and the text's length.

Entries with the same depth and fingerprint are a node. It is verified that all entries of
a node end with the same turn: as a fingerprint and its last turn give the fingerprint
before it, nodes then hold equal sequences, depth by depth. Else all is done anew with
other bases.

A conversation of any length, and a node with any number of members, is spread over
tasks: stored turns are sorted by range, and prefixes are products of what tasks find in
their ranges (a scan).
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import materialise

PRIME, LANES, HEAD, GROUP = (1 << 31) - 1, 4, 6, 100
#: Conversation ids whose list is joined in one value; attempts with other bases.
BLOCK, TRIES = 8192, 5
KEY = ["depth", "k1", "k2"]


def bases(salt: int) -> list[int]:
    digests = [hashlib.sha256(f"{salt}-{k}".encode()).digest() for k in range(LANES)]
    return [int.from_bytes(d[:8], "big") % (PRIME - 1000) + 500 for d in digests]


def times(x: Column, y: Column) -> Column:
    return x * y % PRIME


def product(left: Column, right: Column, shift: Column) -> Column:
    """The hash of two sequences one after the other; ``shift`` is the second one's power."""
    return (times(left, shift) + right) % PRIME


def letters(a: Column, b: Column) -> list[Column]:
    """What each lane adds for a turn: 30 bits of its digest."""
    low = (1 << 30) - 1
    return [a.bitwiseAND(low), F.shiftright(a, 30), b.bitwiseAND(low), F.shiftright(b, 30)]


def stored(turns: DataFrame, conv: str, turn: str, role: str, text: str) -> DataFrame:
    """(conv, turn, role, tie, a, b, len): a row a stored turn, without its text.

    ``tie`` is the text of turns that share conversation and number with another, which are
    ordered by role and text; there are few, so it is looked for first.
    """
    r, t = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (role, text))
    rows = turns.where(F.col(conv).isNotNull()).select(F.col(conv).cast("long").alias("conv"), F.col(turn).alias("turn"), r.alias("role"), t.alias("text"))
    digest = F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text"), 256)
    a, b = (F.conv(F.substring(digest, at, 15), 16, 10).cast("long") for at in (1, 16))
    ties = rows.groupBy("conv", "turn").count().where("count > 1").select("conv", "turn", F.lit(True).alias("tied"))
    if ties.isEmpty():
        tied, tie = rows, F.lit("")
    else:
        same = F.col("x.conv").eqNullSafe(F.col("y.conv")) & F.col("x.turn").eqNullSafe(F.col("y.turn"))
        tied, tie = rows.alias("x").join(ties.alias("y"), same, "left").select("x.*", "tied"), F.when(F.col("tied"), F.col("text")).otherwise("")
    return tied.select("conv", "turn", "role", tie.alias("tie"), a.alias("a"), b.alias("b"), F.length("text").cast("long").alias("len"))


SCAN = "part long, row long, conv long, i long, f array<long>, q array<long>, a long, b long, len long"


def scanned(rows: DataFrame, salt: int) -> DataFrame:
    """Turns in order, with number ``i`` and prefix fingerprint (f, q) within their conversation
    as far as the task's range has it."""
    base = np.array(bases(salt), np.int64)[:, None]
    inverse = np.array([pow(int(x), -1, PRIME) for x in base[:, 0]], np.int64)[:, None]

    def powers(x: np.ndarray, n: int) -> np.ndarray:
        out = np.ones((LANES, 1), np.int64)
        while out.shape[1] < n:
            out = np.append(out, out * (out[:, -1:] * x % PRIME) % PRIME, axis=1)
        return out[:, :n]

    def run(batches):
        part, row = TaskContext.get().partitionId(), 0
        last, count, f0, q0 = None, 0, np.zeros((LANES, 1), np.int64), np.ones((LANES, 1), np.int64)
        for batch in batches:
            n = len(batch)
            if not n:
                continue
            conv, a, b = (batch.column(k).to_numpy() for k in (0, 1, 2))
            t = np.stack([a & (1 << 30) - 1, a >> 30, b & (1 << 30) - 1, b >> 30])
            up, down = powers(base, n + 1), powers(inverse, n + 1)
            starts = np.flatnonzero(np.append(True, conv[1:] != conv[:-1]))
            start = np.repeat(starts, np.diff(np.append(starts, n)))
            at = np.arange(n)
            total = np.cumsum(np.append(np.zeros((LANES, 1), np.int64), t * down[:, :n] % PRIME, axis=1), axis=1)
            f, q, i = (total[:, 1:] - total[:, start]) % PRIME * up[:, at] % PRIME, up[:, at - start + 1], at - start + 1
            if last == conv[0]:  # goes on from the batch before
                run_on = start == 0
                f[:, run_on] = (f0 * q[:, run_on] + f[:, run_on]) % PRIME
                q[:, run_on] = q0 * q[:, run_on] % PRIME
                i[run_on] += count
            last, count, f0, q0 = conv[-1], int(i[-1]), f[:, -1:], q[:, -1:]
            lists = [pa.FixedSizeListArray.from_arrays(pa.array(x.T.reshape(-1)), LANES).cast(pa.list_(pa.int64())) for x in (f, q)]
            columns = [pa.array(np.full(n, part)), pa.array(row + at), batch.column(0), pa.array(i), *lists, *(batch.column(k) for k in (1, 2, 3))]
            row += n
            yield pa.RecordBatch.from_arrays(columns, names=[c.split()[0] for c in SCAN.split(", ")])

    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = ["conv", "turn", "role", "tie"]
    sorted_rows = rows.repartitionByRange(n, *order).sortWithinPartitions(*order)
    return materialise(sorted_rows.select("conv", "a", "b", "len").mapInArrow(run, SCAN), "trie-scan")


def prefixes(found: DataFrame) -> DataFrame:
    """(conv, i, f, q, a, b, len): the scan's rows, from their conversations' begin on.

    What a range lacks is the product of what the ranges before it hold of the conversation
    that it begins with: one row a range, folded on the driver and sent to the tasks.
    """
    spark, shape = found.sparkSession, "part long, conv long, n long, f0 array<long>, q0 array<long>"
    ends = found.groupBy("part").agg(F.min(F.struct("row", "conv")).alias("first"), F.max(F.struct("row", "conv", "i", "f", "q")).alias("last"))
    carried, conv, n, f, q = [], None, 0, [0] * LANES, [1] * LANES
    for r in sorted(ends.collect(), key=lambda r: r["part"]):
        first, last = r["first"], r["last"]
        if first["conv"] == conv:
            carried.append((r["part"], conv, n, f, q))
        if last["conv"] == conv:  # then the whole range is of this conversation
            f = [(x * s + y) % PRIME for x, s, y in zip(f, last["q"], last["f"])]
            n, q = n + last["i"], [x * y % PRIME for x, y in zip(q, last["q"])]
        else:
            conv, n, f, q = last["conv"], last["i"], list(last["f"]), list(last["q"])
    if not carried:
        return found.drop("part", "row")
    rows = found.join(F.broadcast(spark.createDataFrame(carried, shape)), ["part", "conv"], "left")  # at most a row a range
    lanes = range(LANES)
    some = F.col("n").isNotNull()
    joined = F.array(*(product(F.col("f0")[k], F.col("f")[k], F.col("q")[k]) for k in lanes))
    shift = F.array(*(times(F.col("q0")[k], F.col("q")[k]) for k in lanes))
    i = F.col("i") + F.coalesce("n", F.lit(0))
    return rows.select("conv", i.alias("i"), F.when(some, joined).otherwise(F.col("f")).alias("f"), F.when(some, shift).otherwise(F.col("q")).alias("q"), "a", "b", "len")


def plans(turns: DataFrame) -> DataFrame:
    """(conv, h, length, head, left, own): how each conversation is rebuilt.

    ``head`` are the base's turns that it begins with, ``left`` their product, ``own`` the
    product of its own turns that they replace.
    """
    firsts = [F.max(F.when(F.col("i") == k, F.struct("f", "a", "b", "len"))).alias(f"t{k}") for k in range(1, HEAD)]
    counted = turns.groupBy("conv").agg(F.max("i").alias("n"), *firsts)
    firsts_of = F.filter(F.array(*(f"t{k}" for k in range(1, HEAD))), lambda x: x.isNotNull())
    own = materialise(counted.select("conv", "n", firsts_of.alias("firsts")), "trie-conversations")
    held = own.where(F.col("conv") % GROUP == 0).select(F.col("conv").alias("base"), F.col("firsts").alias("base_firsts"))
    h = (F.crc32(F.col("conv").cast("string")) % HEAD).cast("int")
    rows = own.withColumns({"h": h, "base": F.col("conv") - F.col("conv") % GROUP}).join(held, "base", "left")
    none = F.array(*(F.lit(0).cast("long") for _ in range(LANES)))
    head = F.coalesce(F.slice("base_firsts", F.lit(1), F.col("h")), F.slice("firsts", F.lit(1), F.lit(0)))
    rows = rows.withColumn("head", head)
    left = F.coalesce(F.try_element_at("head", F.lit(-1))["f"], none)
    replaced = F.when(F.col("h") > 0, F.try_element_at("firsts", F.greatest("h", F.lit(1)))["f"])
    length = F.size("head") + F.greatest(F.col("n") - F.col("h"), F.lit(0))
    return materialise(rows.select("conv", "h", "head", length.alias("length"), left.alias("left"), F.coalesce(replaced, none).alias("own")), "trie-plans")


def packed(f: list[Column]) -> list[Column]:
    return [(F.shiftleft(f[0], 31) + f[1]).alias("k1"), (F.shiftleft(f[2], 31) + f[3]).alias("k2")]


def entries(turns: DataFrame, plan: DataFrame, salt: int) -> DataFrame:
    """(conv, depth, k1, k2, a, b, len, last), a row a prefix of a rebuilt conversation; the empty one is a root of zeros."""
    zero, lanes = F.lit(0).cast("long"), range(LANES)
    last = (F.col("depth") == F.col("length")).alias("last")
    root = plan.select("conv", zero.alias("depth"), zero.alias("k1"), zero.alias("k2"), zero.alias("a"), zero.alias("b"), zero.alias("len"), (F.col("length") == 0).alias("last"))
    head = plan.select("conv", "length", F.posexplode("head").alias("at", "x")).withColumn("depth", F.col("at") + F.lit(1).cast("long"))
    head = head.select("conv", "depth", *packed([F.col("x.f")[k] for k in lanes]), "x.a", "x.b", "x.len", last)
    own = turns.join(plan.select("conv", "h", F.size("head").alias("begun"), "length", "left", "own"), "conv").where("i > h")
    f = []
    for k, base in enumerate(bases(salt)):
        # The suffix's power is that of all turns so far, divided by that of the h replaced ones.
        back = F.array(*(F.lit(pow(base, -j, PRIME)).cast("long") for j in range(HEAD)))
        shift = times(F.col("q")[k], F.element_at(back, F.col("h") + 1))
        suffix = F.pmod(F.col("f")[k] - times(F.col("own")[k], shift), F.lit(PRIME))
        f.append(product(F.col("left")[k], suffix, shift))
    own = own.withColumn("depth", F.col("begun") + F.col("i") - F.col("h")).select("conv", "depth", *packed(f), "a", "b", "len", last)
    return materialise(root.unionByName(head).unionByName(own), "trie-entries")


def nodes_of(found: DataFrame, salt: int) -> DataFrame | None:
    """(depth, k1, k2, n_convs, rep, len, p1, p2), a row a node, (p1, p2) its parent's; None: a fingerprint has two sequences."""
    nodes = found.groupBy(*KEY).agg(
        F.count("*").alias("n_convs"), F.min("conv").alias("rep"), F.min("len").alias("len"),
        F.min("a").alias("a"), F.min("b").alias("b"), F.max("a").alias("a2"), F.max("b").alias("b2"),
    )
    low = (1 << 31) - 1
    f = [F.shiftright("k1", 31), F.col("k1").bitwiseAND(low), F.shiftright("k2", 31), F.col("k2").bitwiseAND(low)]
    before = [times(F.pmod(x - t, F.lit(PRIME)), F.lit(pow(base, -1, PRIME))) for x, t, base in zip(f, letters(F.col("a"), F.col("b")), bases(salt))]
    p1, p2 = packed(before)
    nodes = materialise(nodes.withColumns({"p1": p1, "p2": p2}), "trie-nodes")
    return nodes.drop("a", "b", "a2", "b2") if nodes.where("a <> a2 OR b <> b2").isEmpty() else None


def ends_of(found: DataFrame) -> DataFrame:
    """(depth, k1, k2, ends_sha256): the digest of the ids that end at a node, in ascending order.

    Ids are joined by blocks of ids, in all tasks; what one task does for a node, however
    many end there, is to pass the blocks' texts through one digest.
    """

    def run(batches):
        key, digest, out = None, None, []
        for batch in batches:
            for *own, ids in zip(*(c.to_pylist() for c in batch.columns)):
                if own != key:
                    if key:
                        out.append((*key, digest.hexdigest()))
                    key, digest = own, hashlib.sha256(ids.encode())
                else:
                    digest.update(f",{ids}".encode())
            if out:
                yield closed(out)
                out = []
        if key:
            yield closed([(*key, digest.hexdigest())])

    def closed(rows):
        return pa.RecordBatch.from_pylist([dict(zip([*KEY, "ends_sha256"], r)) for r in rows], schema=pa.schema([(k, pa.int64()) for k in KEY] + [("ends_sha256", pa.string())]))

    n = int(found.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    blocks = found.where("last").groupBy(*KEY, F.expr(f"conv div {BLOCK}").alias("block")).agg(F.array_sort(F.collect_list("conv")).alias("ids"))
    blocks = blocks.select(*KEY, "block", F.array_join(F.col("ids").cast("array<string>"), ",").alias("ids"))
    dealt = blocks.repartition(n, *KEY).sortWithinPartitions(*KEY, "block").select(*KEY, "ids")
    return dealt.mapInArrow(run, "depth long, k1 long, k2 long, ends_sha256 string")


def trie(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """A row a node: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    Conversation c begins with the first h turns of conversation c - c % 100 (the remainder
    has the sign of c), where h is the CRC-32 of its decimal id modulo 6, and goes on with its own turns after its first
    h. Turns are ordered by number, null first; equal numbers by role and text. Null roles
    and texts are empty; rows without a conversation are left out; repeated rows are turns
    of their own. Texts are hashed whole, other columns are not read whatever their names,
    and an empty table gives an empty result.
    """
    light = stored(turns, conv, turn, role, text)
    for salt in range(TRIES):
        ordered = prefixes(scanned(light, salt))
        found = entries(ordered, plans(ordered), salt)
        if nodes := nodes_of(found, salt):
            return measured(found, nodes)
    raise RuntimeError(f"fingerprints had equal values of different sequences with {TRIES} choices of bases")


def measured(found: DataFrame, nodes: DataFrame) -> DataFrame:
    """Sums over subtrees, without walking them.

    A node's weight belongs to its smallest member. That conversation is the smallest of
    all its deeper nodes too, so a subtree's weights are those of the members' own nodes,
    but for what its smallest member has above it; likewise its leaves are the members
    that are the smallest of a leaf.
    """
    children = nodes.where("depth > 0").groupBy((F.col("depth") - 1).alias("depth"), F.col("p1").alias("k1"), F.col("p2").alias("k2")).agg(F.count("*").alias("n_children"))
    weight = (F.col("n_convs") - 1) * F.col("len")
    nodes = materialise(nodes.join(children, KEY, "left").withColumns({"n_children": F.coalesce("n_children", F.lit(0).cast("long")), "weight": weight}), "trie-children")
    own = nodes.groupBy(F.col("rep").alias("conv")).agg(F.sum("weight").alias("weights"), F.max((F.col("n_children") == 0).cast("long")).alias("leaf"))
    own = own.where("weights > 0 OR leaf > 0")
    sums = found.join(own, "conv").groupBy(*KEY).agg(F.sum("leaf").alias("n_leaves"), F.sum("weights").alias("below"))
    # Nodes of a single member weigh nothing, so the window holds a conversation's shared turns only.
    above = F.sum("weight").over(W.partitionBy("rep").orderBy("depth").rowsBetween(W.unboundedPreceding, -1))
    shared = nodes.where("n_convs > 1").select(*KEY, F.coalesce(above, F.lit(0)).alias("above"))
    parents = nodes.select((F.col("depth") + 1).alias("depth"), F.col("k1").alias("p1"), F.col("k2").alias("p2"), F.col("rep").alias("parent_conv_id"))
    out = nodes.join(shared, KEY, "left").join(sums, KEY, "left").join(ends_of(found), KEY, "left").join(parents, ["depth", "p1", "p2"], "left")
    saved = F.when(F.col("above").isNotNull(), F.coalesce("below", F.lit(0)) - F.col("above")).otherwise(0)
    return out.select(
        F.col("rep").alias("conv_id"), "depth", "parent_conv_id", "n_convs", "n_children", F.coalesce("n_leaves", F.lit(0)).cast("long").alias("n_leaves"),
        saved.cast("long").alias("saved_tokens"), F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256"),
    )
