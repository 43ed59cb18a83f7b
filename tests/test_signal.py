import math

import pytest
from beadframe.operators import detect, masks, qc, signal
from pyspark.sql import functions as F

SIGNALS = "sample_id string, probe_id string, mg double, mr double, ug double, ur double, col string, mask boolean"
ROWS = [
    ("a", "cg1", 300.0, 10.0, 100.0, 20.0, "G", False), ("a", "cg2", None, 10.0, 100.0, 20.0, "G", False), ("a", "cg3", 5.0, 0.0, 6.0, 0.0, "R", False),
    ("a", "ch4", 5.0, 80.0, None, 20.0, "R", True), ("a", "rs5", None, None, 30.0, 70.0, "2", False), ("a", "ctl_6", None, None, None, 70.0, "2", False),
]


@pytest.fixture
def table(spark):
    return spark.createDataFrame(ROWS, SIGNALS)


def by_probe(df, *cols):
    return {r.probe_id: tuple(r[c] for c in cols) if len(cols) > 1 else r[cols[0]] for r in df.collect()}


def test_betas_follow_null_rules(table):
    assert by_probe(signal.betas(table), "beta") == {"cg1": 0.75, "cg2": None, "cg3": 0.5, "ch4": None, "rs5": 0.3, "ctl_6": None}
    assert by_probe(signal.betas(table, mask=False), "beta")["ch4"] == 0.8
    assert by_probe(signal.betas(table, sum_type_one=True), "beta")["cg1"] == 310 / 430


def test_views(table):
    assert by_probe(signal.mu(table, drop_masked=True, total=True), "m", "u", "mu")["cg1"] == (300, 100, 400)
    assert by_probe(signal.mu_out_of_band(table), "m", "u") == {"cg1": (10, 20), "cg2": (10, 20), "cg3": (5, 6), "ch4": (5, None)}
    got = {(r.probe_id, r.channel, r.v) for r in signal.out_of_band(table).collect()}
    assert ("cg1", "R", 10) in got and ("cg3", "G", 6) in got and len(got) == 8


def test_m_values_round_trip(spark):
    df = spark.range(101).select((F.col("id") / 100).alias("b"))
    rows = df.select("b", signal.beta_to_m(F.col("b")).alias("m")).withColumn("back", signal.m_to_beta(F.col("m"))).collect()
    assert rows[0].m == -math.inf and rows[100].m == math.inf
    assert all(abs(r.b - r.back) < 1e-12 for r in rows)


def test_prefix_collapse(spark):
    b = spark.createDataFrame([("a", "x_T1", 0.2), ("a", "x_B1", 0.6), ("a", "y_T1", None), ("b", "x_T1", None)], "sample_id string, probe_id string, beta double")
    once = signal.collapse_mean(b)
    want = {("a", "x", 0.4), ("a", "y", None), ("b", "x", None)}
    assert set(map(tuple, once.collect())) == want == set(map(tuple, signal.collapse_mean(once).collect()))


def test_design_type_needs_a_suffix(spark):
    df = spark.createDataFrame([("cg1_TC21",)], "probe_id string")
    assert df.select(signal.design_type(F.col("probe_id")).alias("d")).first().d == "2"
    with pytest.raises(Exception, match="without a design suffix"):
        spark.createDataFrame([("cg1",)], "probe_id string").select(signal.design_type(F.col("probe_id"))).collect()


def test_zeroed_snps_have_half_frequency(spark):
    zero = spark.createDataFrame([("a", "rs1", 0.0, 0.0, 0.0, 0.0, "G", False), ("a", "rs2", None, None, 0.0, 0.0, "2", False)], SIGNALS)
    assert {r.af for r in signal.allele_frequencies(zero).collect()} == {0.5}


def test_masks(table, spark):
    hit = spark.createDataFrame([("cg1",), ("none",)], "probe_id string")
    assert by_probe(masks.add_mask(table, hit), "mask")["cg1"] is True
    assert sum(by_probe(masks.set_mask(table, hit), "mask").values()) == 1
    assert sum(by_probe(masks.prefix_mask_but_cg(table), "mask").values()) == 3
    assert not any(by_probe(masks.add_mask_where(masks.reset_mask(table), F.lit(None).cast("boolean")), "mask").values())


def test_ecdf_with_ties(spark):
    bg = spark.createDataFrame([("g", float(v)) for v in (1, 2, 2, 3)] + [("g", None)], "k string, v double")
    qs = spark.createDataFrame([("g", v) for v in (0.0, 1.0, 2.0, 2.5, 3.0, 4.0, None)], "k string, v double")
    got = {r.v: r.f for r in detect.ecdf(bg, qs, ["k"]).collect()}
    assert got == {0: 0, 1: 0.25, 2: 0.75, 2.5: 0.75, 3: 1, 4: 1, None: None}
    default = {r.v: r.f for r in detect.ecdf(bg, qs, ["k"], least=100).collect()}
    assert default[4.0] == 0.004 and default[0.0] == 0


def test_detection_masks_and_missing_p(table, spark):
    p = spark.createDataFrame([("a", "cg1", 0.5), ("a", "cg2", None), ("a", "rs5", 0.01)], "sample_id string, probe_id string, p double")
    got = by_probe(detect.mask_undetected(table, p), "mask")
    assert got["cg1"] is True and got["cg2"] is False and got["rs5"] is False
    assert detect.success_rate(p).first().rate is None


def test_bright_probes_are_detected(spark):
    rows = [("a", f"cg{i}", float(20 + i % 40), float(20 + i % 37), 3000.0, 30.0, "G", False) if i % 2 else ("a", f"cg{i}", 20.0 + i % 31, 2500.0, 25.0, 40.0, "R", False) for i in range(400)]
    p = detect.detect_oob(spark.createDataFrame(rows, SIGNALS))
    assert max(r.p for r in p.collect()) < 0.01


def test_channel_inference(spark):
    rows = [("a", f"cg{i}", 4000.0, 30.0, 3000.0, 20.0, "R" if i == 0 else "G", False) for i in range(60)] + [("a", "dim", 1.0, 2.0, 1.0, 1.0, "G", False)]
    df = spark.createDataFrame(rows, SIGNALS)
    got = by_probe(detect.infer_channel(df), "old_col", "col")
    assert got["cg0"] == ("R", "G") and got["dim"] == ("G", "G")
    assert by_probe(detect.infer_channel(df, switch_failed=True), "col")["dim"] == "R"
    assert by_probe(detect.infer_channel(df, mask_failed=True), "mask")["dim"] is True
    assert tuple(detect.channel_summary(df).first())[1:] == (0, 60, 1, 0)


def test_metrics_join(table):
    p = table.select("sample_id", "probe_id", F.lit(0.01).alias("p"))
    row = qc.metrics(table, p, signal.betas(table)).first()
    assert row.num_probes == 6 and row.num_dt == 6 and row.num_na == 3
    with pytest.raises(ValueError):
        qc.metrics(table, groups=["nothing"])
