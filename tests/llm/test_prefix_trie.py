import hashlib
import math
import random
import zlib

import pytest
from beadframe.llm import prefix_trie as pt

SCHEMA = "conv_id long, turn long, role string, text string, depth string, k1 int, conv string"
COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def plain(rows):
    """Every conversation rebuilt, every prefix a tuple."""
    own = {}
    for c, turn, role, text in rows:
        if c is not None:
            own.setdefault(c, []).append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [x[2:] for x in sorted(v)] for c, v in own.items()}
    rebuilt = {}
    for c, v in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        rebuilt[c] = tuple(own.get(c - int(math.fmod(c, 100)), [])[:h] + v[h:])
    nodes = {}
    for c, v in rebuilt.items():
        for d in range(len(v) + 1):
            nodes.setdefault(v[:d], []).append(c)
    out = []
    for s, members in nodes.items():
        under = [t for t in nodes if t[: len(s)] == s]
        leaf = [t for t in under if not any(u[:-1] == t and len(u) == len(t) + 1 for u in under)]
        ends = ",".join(str(c) for c in sorted(c for c in members if len(rebuilt[c]) == len(s)))
        saved = sum((len(nodes[t]) - 1) * len(t[-1][1]) for t in under if t)
        out.append((min(members), len(s), min(nodes[s[:-1]]) if s else None, len(members), sum(len(t) == len(s) + 1 for t in under), len(leaf), saved, hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out)


def table(spark, rows, parts=3):
    return spark.createDataFrame([(*r, "x", 1, "y") for r in rows], SCHEMA).repartition(parts)


def result(df):
    got = pt.trie(df)
    assert got.columns == COLUMNS
    return sorted(tuple(r) for r in got.collect())


def some_rows(seed, n):
    rnd = random.Random(seed)
    texts = ["", None, "hi", "hello there", "é😀", "x" * 50]
    rows = []
    for _ in range(n):
        c = rnd.choice([*range(12), *range(95, 112), 200, 205, 301, 302])
        for t in range(rnd.randrange(1, 5)):
            rows.append((c, rnd.choice([None, t, t, t + 3]), rnd.choice(["user", "assistant", None]), rnd.choice(texts)))
    return rows + [(None, 1, "user", "nobody"), (7, 1, "user", "twice"), (7, 1, "user", "twice")]


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_against_brute_force(spark, seed):
    rows = some_rows(seed, 40)
    assert result(table(spark, rows)) == plain(rows)


def test_a_conversation_over_many_ranges_and_batches(spark):
    rows = [(c, t, "user", str(t % 7)) for c in (3, 100, 103, 104) for t in range(90)] + [(c, 0, "user", "only") for c in range(105, 140)]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 5)
    spark.conf.set("spark.sql.shuffle.partitions", 9)
    try:
        assert result(table(spark, rows)) == plain(rows)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
        spark.conf.set("spark.sql.shuffle.partitions", 4)


def test_many_ends_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(pt, "BLOCK", 4)
    rows = [(c, 0, "user", "same") for c in range(-30, 60)]
    assert result(table(spark, rows)) == plain(rows)


def test_equal_fingerprints_are_found(spark, monkeypatch):
    """With bases that forget what stands before, two sequences meet; the next bases tell them apart."""
    real, asked = pt.bases, set()

    def weak(salt):
        asked.add(salt)
        return [1] * pt.LANES if salt == 0 else real(salt)

    monkeypatch.setattr(pt, "bases", weak)
    x, y = [c for c in range(1, 99) if zlib.crc32(str(c).encode()) % 6 == 0][:2]
    rows = [(x, 0, "u", "a"), (x, 1, "u", "b"), (x, 2, "u", "c"), (y, 0, "u", "b"), (y, 1, "u", "a"), (y, 2, "u", "c")]
    assert result(table(spark, rows)) == plain(rows)
    assert asked == {0, 1} and len(plain(rows)) == 7


def test_empty_and_turnless(spark):
    assert result(table(spark, [(1, 0, "u", "x")]).limit(0)) == []
    # 5 has h > 0 and no base: nothing is left of it, and it ends at the root.
    lone = [c for c in range(1, 50) if zlib.crc32(str(c).encode()) % 6][:2]
    rows = [(c, 0, "u", "gone") for c in lone]
    assert result(table(spark, rows)) == plain(rows) and len(plain(rows)) == 1


def test_given_conversations(spark):
    rows = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.01/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert result(table(spark, rows)) == plain(rows)
