import numpy as np
import pytest
from beadframe.functions import stats
from beadframe.operators import routing


def table(spark, rows):
    return spark.createDataFrame(rows, "sample_id string, probe_id string, beta double")


def test_platform_from_ids(spark):
    signatures = spark.createDataFrame([("P", "a"), ("P", "b"), ("Q", "b"), ("Q", "c"), ("P", "a")], "platform string, probe_id string")
    rows = table(spark, [("s1", "a", 0.1), ("s1", "a", 0.1), ("s1", "c", None), ("s2", "b", 0.2), ("s2", "c", 0.3), ("s3", "none", 0.5)])
    got = {r.sample_id: r.platform for r in routing.platform_from_ids(rows, signatures).collect()}
    assert got == {"s1": "P", "s2": "Q", "s3": None}  # s1 is a tie


def test_lift_to(spark):
    betas = table(spark, [("t", "x", 0.1), ("v", "x_1", 0.2), ("v", "x_2", 0.9), ("n", "nx", 0.4), ("none", "x", 0.5), ("w", "wx", 0.6)])
    platforms = spark.createDataFrame([("t", "T"), ("v", "V"), ("n", "N"), ("none", None), ("w", "W")], "sample_id string, platform string")
    mappings = spark.createDataFrame([("V", "x_2", "x"), ("V", "x_1", "x"), ("V", None, "y"), ("V", "x_1", None)], "platform string, id_source string, id_target string")
    rows = lambda **o: sorted((tuple(r) for r in routing.lift_to(betas, platforms, mappings, "T", ("N",), **o).collect()), key=str)
    some = [("n", "N", "nx", 0.4), ("t", "T", "x", 0.1), ("v", "V", "x", 0.2)]
    assert rows(complete=False) == some
    assert rows() == sorted([*some, ("v", "V", "y", None)], key=str)


@pytest.mark.parametrize("samples, tumors, markers", [(12, 0, 15), (9, 0, 15), (3, 11, 15), (4, 0, None)])
def test_leukocyte_fraction_by_hand(spark, samples, tumors, markers):
    rng = np.random.default_rng(samples)
    probes = [f"p{i:03}" for i in range(60)]
    draw = lambda n: {f"s{k:02}": {p: (None if rng.random() < 0.1 else float(rng.random())) for p in probes} for k in range(n)}
    tissue, tumor, leuko = draw(samples), draw(tumors), draw(2)
    flat = lambda d: table(spark, [(s, p, b) for s, v in d.items() for p, b in v.items()])
    got = {r.sample_id: (r.fraction, r.n) for r in routing.leukocyte_fraction(flat(tissue), flat(leuko), tumor=flat(tumor) if tumors else None, markers=markers).collect()}
    mean = lambda d: {p: np.mean([v[p] for v in d.values() if v[p] is not None]) for p in probes if any(v[p] is not None for v in d.values())}
    l, t = mean(leuko), mean(tissue)
    d = sorted((l[p] - t[p], p) for p in probes if p in l and p in t)
    low = [p for _, p in d][: markers or 1000]
    high = [p for _, p in sorted((-x, p) for x, p in d)][: markers or 1000]
    measured = tumor if tumors else tissue
    values = lambda p: [v[p] for v in measured.values() if v[p] is not None]
    whole = len(measured) >= 10
    for s, v in measured.items():
        x = [(v[p] - (min(values(p)) if whole else 0.0)) / (l[p] - (min(values(p)) if whole else 0.0)) for p in high if v[p] is not None]
        x += [(v[p] - (max(values(p)) if whole else 1.0)) / (l[p] - (max(values(p)) if whole else 1.0)) for p in low if v[p] is not None]
        assert got[s][1] == len(x) and abs(got[s][0] - stats.mode(np.array(x))) < 1e-9


def test_markers_by_platform(spark):
    probes = [f"p{i:03}" for i in range(150)]
    rows = [(s, f"{s}{p}", i / 200) for s in ("a", "b") for i, p in enumerate(probes)]
    platforms = spark.createDataFrame([("a", "HM27"), ("b", "EPIC")], "sample_id string, platform string")
    leuko = spark.createDataFrame([(q, f"{s}{p}", 0.9) for q, s in (("HM27", "a"), ("EPIC", "b")) for p in probes], "platform string, probe_id string, beta double")
    got = {r.sample_id: r.n for r in routing.leukocyte_fraction(table(spark, rows), leuko, platforms).collect()}
    assert got == {"a": 200, "b": 300}


def test_too_few_values_give_none(spark):
    rows = [("s", f"p{i}", 0.5 if i < 4 else None) for i in range(30)] + [("t", f"p{i}", None) for i in range(30)]
    leuko = table(spark, [("l", f"p{i}", 0.8) for i in range(30)])
    got = sorted(tuple(r) for r in routing.leukocyte_fraction(table(spark, rows), leuko).collect())
    assert got == [("s", None, 8), ("t", None, 0)]
    assert routing.leukocyte_fraction(table(spark, []), leuko).count() == 0
