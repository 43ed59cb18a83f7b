"""Rows that showed the findings of round 4."""

import math
import time

import numpy as np
from beadframe.functions import stats
from beadframe.operators import detect, infer, normalize, sets
from beadframe.queries import QUERIES

from test_joins import planned, tables  # noqa: F401


def test_tail_of_a_large_set_takes_time_in_proportion(spark):
    """Before, each term looked for the largest of all again."""
    nd, nq, ndq, nu = 300_000, 400_000, 20_300, 6_000_000
    counts = spark.createDataFrame([("a", nd, ndq, nq, nu)], "dbname string, nd long, ndq long, nq long, nu long")
    began = time.time()
    got = sets.fisher_columns(counts, "two.sided").first()
    assert time.time() - began < 40
    c = lambda n, k: math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1)
    least = [c(nd, x) + c(nu - nd, nq - x) - c(nu, nq) for x in range(ndq - 3000, ndq + 3001)]
    sides = [math.log(sum(math.exp(y) for y in part)) for part in (least[3000:], least[:3001])]
    assert abs(got.p / min(1.0, 2 * math.exp(min(sides))) - 1) < 1e-4


def test_means_are_ranked_against_themselves(spark, tables):  # noqa: F811
    out = QUERIES["qc_rank"](spark, tables)
    assert "lineitem" not in planned(out)  # summed once: a sum in another order may differ in its last bit
    rows = sorted((r.value, r.sample_id, r["rank"]) for r in out.collect() if r.sample_id < "s06" and r.value is not None)
    assert [r[2] for r in rows] == [(i + 1) / len(rows) for i in range(len(rows))]


def test_a_beta_halfway_falls_to_one_side(spark):
    """Cells count in order of their names, however their rows arrive."""
    shares = {"a": 0.1, "b": 0.2, "c": 0.3}
    for k in range(10_000):
        v = {"a": k % 101 / 100, "b": k * 3 % 101 / 100, "c": k * 7 % 101 / 100}
        own, other = (sum((v[c] * shares[c] for c in names), 0.0) for names in ("abc", "cba"))
        beta = own + 0.2
        if (beta - own < 0.2) != (beta - other < 0.2):
            break
    rows = spark.createDataFrame([("s", "p", beta)], "sample_id string, probe_id string, beta double")
    refs = spark.createDataFrame([(c, "p", v[c]) for c in "cba"], "cell string, probe_id string, beta double").coalesce(1)
    fractions = spark.createDataFrame([("s", c, x) for c, x in [*shares.items(), ("unknown", 0.4)]], "sample_id string, cell string, fraction double")
    assert infer.unknown_state(rows, refs, fractions).first().state == int(beta - own >= 0.2)


def test_fractions_of_a_whole(spark):
    """Three of ten is not 0.3 in the last bit."""
    x, beta = next((x, b) for x in (k / 100 for k in range(101)) for b in (x * 3 / 10 + 0.2,) if (b - x * 3 / 10 < 0.2) != (b - x * 0.3 < 0.2))
    rows = spark.createDataFrame([("s", "p", beta)], "sample_id string, probe_id string, beta double")
    refs = spark.createDataFrame([("a", "p", x)], "cell string, probe_id string, beta double")
    fractions = spark.createDataFrame([("s", "a", 3.0, 10.0), ("s", "unknown", 4.0, 10.0)], "sample_id string, cell string, fraction double, whole double")
    assert infer.unknown_state(rows, refs, fractions).first().state == int(beta - x * 3 / 10 >= 0.2)


def test_first_of_the_largest_arcs(spark):
    """As from all arcs, with ties; before, each permutation looked at all."""
    rng = np.random.default_rng(3)
    for r in range(60):
        n, least = int(rng.integers(12, 200)), int(rng.integers(1, 6))
        v = rng.normal(0, 1, n) if r % 2 else rng.integers(0, 3, n).astype(float)
        s = np.append(0, np.cumsum(v - v.mean()))
        arcs = [(abs(s[j] - s[i]) / np.sqrt((j - i) * (n - j + i) / n), -i, -j) for i in range(n) for j in range(i + least, n + 1) if least <= n - j + i]
        t, i, j = max(arcs)
        assert stats.widest_arc(v, least) == (t, -i, -j)
        assert stats.widest_arc(v, least, t) and not stats.widest_arc(v, least, np.nextafter(t, np.inf))
    began, v = time.time(), rng.normal(0, 1, 20_000)
    assert stats.widest_arc(v, 5, 9.0) is None and stats.widest_arc(v, 5)
    assert sum(stats.widest_arc(rng.permutation(v), 5, 9.0) is not None for _ in range(20)) == 0 and time.time() - began < 10


def test_null_scores_of_all_positions_and_of_few(spark, monkeypatch):
    """The same whether a draw's low hashes suffice or its other positions must come to them."""
    sizes = spark.createDataFrame([(500, 3), (500, 40), (500, 499)], "n long, overlap long")
    rows = lambda: {(r.overlap, r.draw): (r.high, r.low) for r in sets.null_scores(sizes.where("overlap < 100"), 5).collect()}
    want = {k: v for k, v in ((tuple(r[:2]), tuple(r[2:])) for r in sets.null_scores(sizes, 5).collect()) if k[0] < 100}
    assert rows() == want and len(want) == 10
    monkeypatch.setattr(sets.math, "sqrt", lambda x: 0.0)  # no margin
    assert rows() == want


def _reading(rng, name, n):
    return [(name, f"p{i}", *(float(x) for x in rng.integers(1, 900, 4)), "GR2"[i % 3], i % 11 == 0) for i in range(n)]


SIGNALS = "sample_id string, probe_id string, mg double, mr double, ug double, ur double, col string, mask boolean"


def test_curves_go_by_distinct_values(spark):
    """As on whole samples; before, all of a sample's probes went to one Python group."""
    rows = _reading(np.random.default_rng(5), "a", 900) + _reading(np.random.default_rng(6), "b", 30)
    rows += [("b", "none", None, None, None, 5.0, "2", False)]
    df = spark.createDataFrame(rows, SIGNALS)
    out = normalize.dye_nonlinear(df, most_distorted=1e9)
    assert "InPandas" not in planned(out) and out.columns == df.columns
    got = {(r.sample_id, r.probe_id): r for r in out.collect()}
    for s in "ab":
        own = [r for r in rows if r[0] == s]
        g, r = (np.array([x for q in own if q[6] == k for x in (q[i], q[i + 2])]) for k, i in (("G", 2), ("R", 3)))
        for i, own_values, other in ((2, g, r), (3, r, g), (4, g, r), (5, r, g)):
            x = np.sort(own_values)
            at, back = np.unique(x, return_inverse=True)
            mid = (x + stats.to_target(x, other)) / 2
            y = np.bincount(back, mid) / np.bincount(back)
            for q in own:
                v, new = q[i], got[s, q[1]][i]
                if v is None:
                    assert new is None
                    continue
                want = v - x[-1] + mid.max() if v > x[-1] else mid.min() / x[0] * v if v < x[0] else np.interp(v, at, y)
                assert abs(new - want) < 1e-9
    masked = normalize.dye_nonlinear(df, most_distorted=-1.0).collect()
    assert all(r.mask == (r.col == "G" or dict(((q[0], q[1]), q[7]) for q in rows)[r.sample_id, r.probe_id]) for r in masked)


def test_background_from_the_firsts_of_ranges(spark):
    """The limit of whole samples from a bounded part of them; before, all of a sample's probes went to one Python group."""
    rng = np.random.default_rng(8)
    rows = []
    for s, n in (("a", 3000), ("b", 40), ("c", 1)):
        for i in range(n):
            total = float(rng.integers(0 if i < 5 else 20, 4000))
            share = rng.uniform(0.05, 0.95) if total < 700 else rng.choice([0.02, 0.97]) if s == "a" else 0.5
            m = float(round(total * share))
            rows.append((s, f"p{i}", m, m, total - m, total - m, "GR2"[i % 3], False))
    df = spark.createDataFrame(rows, SIGNALS)
    options = {"windows": 40, "size": 60, "cap": 3000}
    got = {}
    for r in detect.background_values(df, **options).collect():
        got.setdefault(r.sample_id, []).append(r.v)
    for s in "abc":
        m, u = [], []
        for q in (q for q in rows if q[0] == s):
            a, b = (q[2], q[4]) if q[6] == "G" else (q[3], q[5]) if q[6] == "R" else (q[4], q[5])
            m, u = [*m, a], [*u, b]
            if q[6] != "2":
                a, b = (q[3], q[5]) if q[6] == "G" else (q[2], q[4])
                m, u = [*m, a], [*u, b]
        assert sorted(got.get(s, [])) == sorted(_whole(np.array(m), np.array(u), **options)), s


def _whole(m, u, margin=0.05, cap=3000, jump=0.2, windows=500, size=500):
    with np.errstate(all="ignore"):
        total, beta = m + u, m / (m + u)
    ok = ~np.isnan(beta)
    order = np.lexsort((beta[ok], total[ok]))
    total, beta, top = total[ok][order], beta[ok][order], np.fmax(m[ok], u[ok])[order]
    first = np.searchsorted(total, 2 ** np.linspace(np.log2(max(1.0, total[0] - 1)), np.log2(total[-1] + 1), windows), side="right")
    spans = np.array([np.quantile(beta[i : i + size], [margin, 1 - margin]) if i < len(beta) else [np.nan] * 2 for i in first])
    if spans[0, 1] - spans[0, 0] > 0.5:
        limit = total[min(9, len(total) - 1)]
    else:
        wide = np.flatnonzero((spans[:, 0] - spans[0, 0] < -jump) | (spans[:, 1] - spans[0, 1] > jump))
        at = first[wide[0]] + size - 1 if len(wide) else len(total)
        limit = total[at] if at < len(total) else np.inf
    return top[total <= min(limit, cap)].tolist()
