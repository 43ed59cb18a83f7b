import random

import pytest
from beadframe.functions.windows import benjamini_hochberg
from beadframe.operators import model


def adjusted(p):
    order = sorted(range(len(p)), key=lambda i: p[i])
    out, low = [None] * len(p), 1.0
    for rank, i in reversed(list(enumerate(order, 1))):
        low = min(low, p[i] * len(p) / rank)
        out[i] = low
    return out


@pytest.mark.parametrize("n", [0, 1, 5, 300])
def test_adjustment_over_many_tasks(spark, n):
    rnd = random.Random(n)
    rows = [(i, rnd.choice([0.001, 0.5, rnd.random(), rnd.random() ** 4]), i % 3) for i in range(n)] + [(-1, None, 0), (-2, None, 1)]
    got = {r.i: r.q for r in benjamini_hochberg(spark.createDataFrame(rows, "i int, p double, g int"), "p", "q", ties=["i"]).collect()}
    want = dict(zip([r[0] for r in rows[:n]], adjusted([r[1] for r in rows[:n]])))
    assert got.pop(-1) is None and got.pop(-2) is None and got == pytest.approx(want, rel=1e-12)
    by = {r.i: r.q for r in benjamini_hochberg(spark.createDataFrame(rows, "i int, p double, g int"), "p", "q", by=["g"]).collect()}
    for g in range(3):
        mine = [r for r in rows[:n] if r[2] == g]
        assert {r[0]: by[r[0]] for r in mine} == pytest.approx(dict(zip([r[0] for r in mine], adjusted([r[1] for r in mine]))), rel=1e-12)


@pytest.mark.parametrize("run", [2, 3, 64])
def test_distances_skip_unmapped_probes(spark, monkeypatch, run):
    monkeypatch.setattr(model, "RUN", run)
    rnd = random.Random(run)
    place = {f"p{i:02}": (rnd.choice(["chr1", "chr2", "*", None]), 10 * i) for i in range(40)}
    coords = spark.createDataFrame([(p, c, at, at + 1) for p, (c, at) in place.items()], "probe_id string, chrom string, start long, end long")
    beta = {(s, p): (None if rnd.random() < 0.2 else rnd.random()) for s in "abc" for p in place if p != "p07" and rnd.random() < 0.9}
    betas = spark.createDataFrame([(s, p, v) for (s, p), v in beta.items()], "sample_id string, probe_id string, beta double")
    got = {r.probe_id: (r.dist, r.changed) for r in model.neighbour_distance(betas, coords).collect()}
    known = {p for (_, p), v in beta.items() if v is not None}
    want = {}
    for chrom in ("chr1", "chr2"):
        mine = [p for p in sorted(place, key=lambda p: place[p][1]) if place[p][0] == chrom and p in known]
        for before, p in zip([None, *mine], mine):
            pairs = [(beta.get((s, p)), beta.get((s, before))) for s in "abc"]
            want[p] = (None, True) if before is None else (pytest.approx(sum((x - y) ** 2 for x, y in pairs if x is not None and y is not None)), False)
    assert got == want
