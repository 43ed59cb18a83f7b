import math

import numpy as np
from beadframe.functions import normal, stats
from beadframe.operators import normalize
from pyspark.sql import functions as F

SIGNALS = "sample_id string, probe_id string, mg double, mr double, ug double, ur double, col string, mask boolean"


def test_hazard_against_the_error_function(spark):
    z = [-35.0, -20.0, -6.0, -5.65, -2.0, -0.67, -0.66, -0.1, 0.0, 0.3, 0.66, 0.67, 2.0, 8.0]
    df = spark.createDataFrame([(v, v / math.sqrt(2)) for v in z], "z double, y double")
    for r in df.select("z", F.expr(normal.hazard("y")).alias("h")).collect():
        want = math.exp(-0.5 * r.z * r.z) / math.sqrt(2 * math.pi) / (0.5 * math.erfc(-r.z / math.sqrt(2)))
        assert abs(r.h / want - 1) < 1e-12


def test_expected_signal_equals_the_numpy_form(spark):
    x = np.concatenate([np.linspace(1, 400, 50), [1e4, 6e4]])
    df = spark.createDataFrame([(float(v), 120.0, 35.0, 900.0) for v in x], "x double, m double, s double, a double")
    got = df.withColumn("y", F.expr(normal.standardised("x", "m", "s", "a"))).select("x", F.expr(normal.expected_signal("x", "m", "s", "a", "y")).alias("e")).collect()
    want = dict(zip(x.tolist(), stats.normal_exponential(x, 120.0, 35.0, 900.0).tolist()))
    assert all(abs(r.e / want[r.x] - 1) < 1e-9 for r in got)


def test_huber_of_all_groups_at_once(spark):
    rng = np.random.default_rng(3)
    groups = {f"g{i}": np.round(np.concatenate([rng.normal(100 * i, 20, 200), rng.exponential(2000, 3 * i)])) for i in range(6)} | {"flat": np.full(9, 4.0)}
    rows = [(k, float(v), int(c)) for k, x in groups.items() for v, c in zip(*np.unique(x, return_counts=True))]
    got = {r.k: (r.mu, r.s) for r in normalize.huber(spark.createDataFrame(rows, "k string, v double, c long"), ["k"]).collect()}
    assert got.pop("flat") == (None, None)
    for k, (mu, s) in got.items():
        want_mu, want_s = stats.huber(groups[k])
        assert abs(mu - want_mu) < 2e-6 * want_s and abs(s - want_s) < 1e-9


def test_noob_leaves_samples_without_background_as_they_are(spark):
    rng = np.random.default_rng(4)
    few = [("few", f"p{i}", 10.0 + i, 20.0, 30.0, 40.0, "GR"[i % 2], False) for i in range(30)]
    many = [("many", f"p{i}", *map(float, rng.integers(0, 3000, 4)), "GR"[i % 2], False) for i in range(300)]
    flat = [("flat", f"p{i}", 100.0, 100.0, 100.0, 100.0, "GR"[i % 2], False) for i in range(300)]
    df = spark.createDataFrame([*few, *many, *flat, ("few", "q", None, None, 1.0, 2.0, "2", True)], SIGNALS)
    got = normalize.noob(df)
    assert got.columns == df.columns
    same = lambda name, d: sorted(map(str, d.where(F.col("sample_id") == name).collect()))
    assert same("few", got) == same("few", df) and same("flat", got) == same("flat", df)
    rows = got.where("sample_id = 'many'").collect()
    assert len(rows) == 300 and all(r[c] > 0 for r in rows for c in ("mg", "mr", "ug", "ur"))
    assert normalize.noob_fits(df.limit(0)).count() == 0 and normalize.noob(df.limit(0)).count() == 0
