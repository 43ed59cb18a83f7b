import hashlib
import math
import random

import numpy as np
import pytest
from beadframe.functions import normal
from beadframe.operators import ranges, sets
from pyspark.sql import functions as F


def test_upper_tail(spark):
    z = [-30.0, -3.0, -0.7, -0.5, 0.0, 0.4, 0.67, 3.0, 6.0, 25.0]
    df = spark.createDataFrame([(v, v / math.sqrt(2)) for v in z], "z double, y double")
    for r in df.select("z", F.expr(normal.upper_tail("y")).alias("p")).collect():
        assert r.p == pytest.approx(0.5 * math.erfc(r.z / math.sqrt(2)), rel=1e-12)


def plain_null(n, k, draw, seed=1):
    order = sorted(range(1, n + 1), key=lambda at: hashlib.md5(f"{seed}-{draw}-{at}".encode()).hexdigest())
    s = np.full(n, -1 / (n - k))
    s[np.array(order[:k]) - 1] = 1 / k
    cs = np.cumsum(s)
    return max(cs.max(), 0), min(cs.min(), 0)


def test_null_scores_are_walks_over_hashed_sets(spark):
    sizes = spark.createDataFrame([(40, 3), (40, 12), (40, 39)], "n long, overlap long")
    got = {(r.overlap, r.draw): (r.high, r.low) for r in sets.null_scores(sizes, 20).collect()}
    assert len(got) == 60
    for (k, draw), pair in got.items():
        assert pair == pytest.approx(plain_null(40, k, draw), abs=1e-12)


@pytest.mark.parametrize("precise", [False, True])
def test_enrichment_of_values_by_hand(spark, precise):
    n = 60
    values = spark.createDataFrame([(f"p{i:02}", float(i)) for i in range(n)], "probe_id string, value double")
    held = {"low": range(12), "high": range(45, 60), "mixed": range(0, 60, 4), "all": range(n), "one": [30]}
    members = spark.createDataFrame([(k, f"p{i:02}") for k, v in held.items() for i in v] + [("low", "unknown")], "dbname string, probe_id string")
    got = {r.dbname: r for r in sets.enrich_values(values, members, 50, precise, most=200).collect()}
    assert got.keys() == held.keys() and (got["all"].estimate, got["all"].p) == (0.0, 1.0)
    for name, at in held.items():
        k = len(list(at))
        if k == n:
            continue
        s = np.full(n, -1 / (n - k))
        s[list(at)] = 1 / k
        hi, lo = max(np.cumsum(s).max(), 0), min(np.cumsum(s).min(), 0)

        def p(draws):
            null = np.array([plain_null(n, k, i) for i in range(draws)])
            sides = [(null[:, 0] > hi + 1e-12).mean(), (null[:, 1] <= lo + 1e-12).mean()]
            far = [(hi - null[:, 0].mean()) / max(null[:, 0].std(ddof=1), 1e-12), (null[:, 1].mean() - lo) / max(null[:, 1].std(ddof=1), 1e-12)]
            return sides, [0.5 * math.erfc(z / math.sqrt(2)) if s == 0 else s for s, z in zip(sides, far)]

        sides, out = p(50)
        if precise and min(sides) < 0.01:
            sides, out = p(200)
        large = -lo > hi
        assert (got[name].n, got[name].overlap) == (n, k) and got[name].estimate == pytest.approx(lo if large else hi, abs=1e-9)
        assert got[name].p == pytest.approx(out[1] if large else out[0], abs=1e-6)


def naive(rows, least):
    rows = [list(r) for r in sorted(rows)]
    while rows:
        i = min(range(len(rows)), key=lambda k: rows[k][2])
        if rows[i][2] >= least:
            break
        if i and rows[i - 1][1] + 1 == rows[i][0]:
            rows[i - 1][1:] = rows[i][1], rows[i - 1][2] + rows[i][2]
        elif i + 1 < len(rows) and rows[i][1] + 1 == rows[i + 1][0]:
            rows[i + 1][0], rows[i + 1][2] = rows[i][0], rows[i + 1][2] + rows[i][2]
        rows.pop(i)
    return [tuple(r) for r in rows]


def test_merging_equals_the_plain_search(spark):
    rnd, rows = random.Random(9), []
    for c in range(30):
        at = 1
        for _ in range(rnd.randrange(1, 40)):
            at += rnd.choice([0, 0, 0, 5])
            rows.append((f"c{c:02}", at, at + 9, rnd.choice([0, 0, 1, 3, 7, 12, 25])))
            at += 10
    got = ranges.merge_small(spark.createDataFrame(rows, "chrom string, start long, end long, n long"), 20).collect()
    for c in {r[0] for r in rows}:
        assert sorted(tuple(r)[1:] for r in got if r.chrom == c) == naive([r[1:] for r in rows if r[0] == c], 20)
