import math
import random

import numpy as np
import pandas as pd
import pytest
from beadframe.functions import stats
from beadframe.functions.windows import benjamini_hochberg
from beadframe.operators import copynumber, infer, model, normalize, ranges, sets
from pyspark.sql import functions as F


def test_tails_against_known_values():
    assert stats.normal_cdf(1.959963985) == pytest.approx(0.975, abs=1e-9)
    assert stats.normal_quantile([0.975, 1e-10])[1] == pytest.approx(-6.361340902, abs=1e-8)
    assert stats.t_two_sided([2.0], [10])[0] == pytest.approx(0.07338803, abs=1e-8)
    assert stats.f_upper([4.0], [1], [10])[0] == pytest.approx(0.07338803, abs=1e-8)
    assert stats.log_normal_cdf([-40.0])[0] == pytest.approx(-804.608442, abs=1e-5)


def test_quantile_map_and_mode():
    rng = np.random.default_rng(0)
    x, y = rng.normal(0, 1, 500), rng.normal(5, 2, 800)
    m = stats.to_target(x, y)
    assert abs(m.mean() - y.mean()) < 0.1 and (np.argsort(m) == np.argsort(x)).all()
    assert stats.mode(y) == pytest.approx(5, abs=0.6)
    assert stats.to_target(np.array([1.0, 1.0, 2.0]), np.array([0.0, 10.0, 20.0]))[0] == pytest.approx(5.0)


def test_segmentation_finds_a_gain():
    rng = np.random.default_rng(1)
    x = np.concatenate([rng.normal(0, 0.3, 40), rng.normal(1.5, 0.3, 25), rng.normal(0, 0.3, 40)])
    got = stats.circular_segments(x, permutations=200)
    assert len(got) == 3 and abs(got[0][1] - 40) <= 2 and abs(got[1][1] - 65) <= 2
    assert stats.circular_segments(rng.normal(0, 1, 60), permutations=200) == [(0, 60)]


def test_benjamini_hochberg(spark):
    df = spark.createDataFrame([(p,) for p in (0.01, 0.02, 0.03, 0.04, 0.05)] + [(None,)], "p double")
    assert {round(r.q, 12) for r in benjamini_hochberg(df, "p", "q").where("p is not null").collect()} == {0.05}


def test_hypergeometric_tails(spark):
    row = spark.createDataFrame([(5, 6, 3, 20)], "nd long, nq long, ndq long, nu long")
    term = lambda x: math.comb(5, x) * math.comb(15, 6 - x) / math.comb(20, 6)
    for name, want in (("greater", sum(map(term, range(3, 6)))), ("less", sum(map(term, range(0, 4))))):
        assert 10 ** row.select(sets.log10_tail(name).alias("x")).first().x == pytest.approx(want, rel=1e-10)
    both = 10 ** row.select(sets.log10_tail("two.sided").alias("x")).first().x
    assert both == pytest.approx(2 * sum(map(term, range(3, 6))), rel=1e-10)
    big = spark.createDataFrame([(40000, 40000, 39000, 900000)], "nd long, nq long, ndq long, nu long")
    assert big.select(sets.log10_tail().alias("x")).first().x < -10000


def test_a_set_is_most_enriched_in_itself(spark):
    universe = spark.range(600).select(F.concat(F.lit("cg"), F.col("id").cast("string")).alias("probe_id"))
    members = universe.withColumn("dbname", F.concat(F.lit("set"), (F.substring("probe_id", 3, 9).cast("int") % 7).cast("string")))
    out = sets.ordered(sets.enrich(members.where("dbname = 'set3'"), members, universe)).collect()
    assert out[0].dbname == "set3" and out[0].estimate == 1024 and out[0].jaccard == 1 and out[1].ndq == 0


@pytest.mark.parametrize("hits, want", [((1, 2, 3), (1.0, 0.0)), ((8, 9, 10), (0.0, -1.0)), ((2, 5, 9), None)])
def test_running_scores(spark, hits, want):
    values = spark.createDataFrame([(f"p{i}", float(i)) for i in range(1, 11)], "probe_id string, value double")
    members = spark.createDataFrame([("s", f"p{i}") for i in hits], "dbname string, probe_id string")
    row = sets.running_scores(values, members).first()
    plain = stats.enrichment_score(np.isin(np.arange(1, 11), hits))
    assert (row.es_max, row.es_min) == pytest.approx((max(plain[0], 0), min(plain[1], 0)), abs=1e-12)
    if want:
        assert (row.es_max, row.es_min) == pytest.approx(want, abs=1e-12)
    r = sets.enrich_values(values, members).first()
    assert 0 <= r.p <= 1 and (r.estimate < 0) == (hits == (8, 9, 10))


def test_overlap_join_against_brute_force(spark):
    rnd = random.Random(6)
    make = lambda n, w: [(f"c{rnd.randrange(2)}", s, s + rnd.randrange(w), i) for i in range(n) for s in [rnd.randrange(1, 5000)]]
    a, b = make(60, 900), make(80, 40)
    left, right = spark.createDataFrame(a, "chrom string, start long, end long, i long"), spark.createDataFrame(b, "chrom string, start long, end long, j long")
    got = sorted((r.i, r.j) for r in ranges.overlap_join(left, right, width=100).collect())
    assert got == sorted((x[3], y[3]) for x in a for y in b if x[0] == y[0] and x[1] <= y[2] and y[1] <= x[2])


def test_tiles_gaps_and_merging(spark):
    lengths = spark.createDataFrame([("c1", 250)], "chrom string, length long")
    gaps = spark.createDataFrame([("c1", 1, 10), ("c1", 90, 120), ("c1", 200, 260)], "chrom string, start long, end long")
    left = sorted((r.start, r.end) for r in ranges.minus_gaps(ranges.tiles(lengths, 100), gaps, 100).collect())
    assert left == [(11, 89), (121, 199)]
    bins = spark.createDataFrame([("c", 1, 10, 5), ("c", 11, 20, 30), ("c", 21, 30, 4), ("d", 1, 10, 3)], "chrom string, start long, end long, n long")
    assert [tuple(r) for r in ranges.merge_small(bins, 20).collect()] == [("c", 1, 30, 39)]


def study(spark, seed=0):
    rng = np.random.default_rng(seed)
    samples = pd.DataFrame({"sample_id": [f"s{i}" for i in range(12)], "sex": list("FM") * 6, "tissue": ["x", "y", "z"] * 4, "age": rng.normal(40, 10, 12)})
    rows = []
    for p in range(20):
        for i, s in samples.iterrows():
            y = 0.4 + 0.2 * (p == 3) * (s.sex == "M") + 0.15 * (p == 5) * (s.tissue == "y") + rng.normal(0, 0.05)
            rows.append((f"cg{p:02}", s.sample_id, None if rng.random() < 0.1 else float(y)))
    return spark.createDataFrame(samples), spark.createDataFrame(rows, "probe_id string, sample_id string, beta double"), samples, rows


DESIGN = model.Design(numeric=["age"], factors={"sex": ["F", "M"], "tissue": ["x", "y", "z"]})


def test_regression_equals_least_squares(spark):
    samples, betas, plain, rows = study(spark)
    coef, tests = model.fit(betas, samples, DESIGN)
    got = {(r.probe_id, r.term): r for r in coef.collect()}
    f = {(r.probe_id, r.contrast): r for r in tests.collect()}
    x_all = np.column_stack([np.ones(12), plain.age, plain.sex == "M", plain.tissue == "y", plain.tissue == "z"]).astype(float)
    for p in ("cg00", "cg03", "cg05"):
        y = np.array([b for q, _, b in rows if q == p], float)
        ok = ~np.isnan(y)
        x, v = x_all[ok], y[ok]
        b, res, *_ = np.linalg.lstsq(x, v, rcond=None)
        s2 = res[0] / (ok.sum() - 5)
        se = np.sqrt(s2 * np.diag(np.linalg.inv(x.T @ x)))
        for t, e, s in zip(DESIGN.terms, b, se):
            assert got[p, t].estimate == pytest.approx(e, abs=1e-8) and got[p, t].std_error == pytest.approx(s, rel=1e-6)
        res0 = np.linalg.lstsq(x[:, :3], v, rcond=None)[1][0]
        assert f[p, "tissue"].f == pytest.approx((res0 - res[0]) / 2 / s2, rel=1e-6)
    assert f["cg03", "sex"].p < 0.01


def test_two_levels_t_equals_f(spark):
    samples, betas, *_ = study(spark)
    design = model.Design(factors={"sex": ["F", "M"]})
    coef, tests = model.fit(betas, samples, design)
    both = coef.where("term = 'sex_M'").withColumnRenamed("p", "tp").join(tests.select("probe_id", "f", F.col("p").alias("fp")), "probe_id").collect()
    assert all(r.t**2 == pytest.approx(r.f, rel=1e-6) and r.tp == pytest.approx(r.fp, abs=1e-9) for r in both)
    wide = model.summary(model.fit_rows(betas, samples, design), design).collect()
    assert all(r.eff_sex == pytest.approx(abs(r.est_sex_M)) for r in wide)


def test_aliased_terms(spark):
    samples, betas, *_ = study(spark)
    design = model.Design(factors={"sex": ["F", "M"], "copy": ["F", "M"]})
    coef, _ = model.fit(betas, samples.withColumn("copy", F.col("sex")), design)
    assert {r.term for r in coef.where("aliased").collect()} == {"copy_M"}


def test_prediction_and_effect(spark):
    samples, betas, *_ = study(spark)
    design = model.Design(factors={"sex": ["F", "M"], "tissue": ["x", "y", "z"]})
    pred = model.predict(model.fit(betas, samples, design)[0], design)
    assert pred.count() == 20 * 6
    best = model.effect_size(pred, ["sex", "tissue"]).orderBy(F.desc("eff_sex")).first()
    assert best.probe_id == "cg03" and best.eff_sex == pytest.approx(0.2, abs=0.08)


def test_imputation_literals(spark):
    nan = None
    cols = {"a": (nan, 2, 3, 4), "b": (1, 6, 5, nan), "c": (3, 6, 7, 8)}
    rows = [(s, f"p{i + 1}", float(v) if v is not None else None) for s, vs in cols.items() for i, v in enumerate(vs)]
    df = spark.createDataFrame(rows, "sample_id string, probe_id string, beta double")
    at = lambda d: {(r.probe_id, r.sample_id): r.beta for r in d.collect()}
    by_sample, by_probe = at(infer.impute_mean(df, "sample_id")), at(infer.impute_mean(df, "probe_id"))
    assert by_sample["p1", "a"] == 3 and by_sample["p4", "b"] == 4 and by_probe["p1", "a"] == 2 and by_probe["p4", "b"] == 6
    with pytest.raises(ValueError):
        infer.impute_mean(df, "x")


def test_lift_over(spark):
    ids = spark.createDataFrame([("cg1_TC1",), ("cg1_BC1",), ("cg2_TC1",), ("cg9_TC1",)], "probe_id string")
    targets = spark.createDataFrame([("cg1",), ("cg2",), ("cg3",)], "probe_id string")
    m = infer.lift_ids(ids, targets, prefix_only=True, include_new=True)
    assert {tuple(r) for r in m.collect()} == {("cg1_BC1", "cg1"), ("cg2_TC1", "cg2"), (None, "cg3")}
    b = spark.createDataFrame([("s", "cg1_BC1", 0.5), ("s", "cg2_TC1", 1.0)], "sample_id string, probe_id string, beta double")
    assert {(r.probe_id, r.beta) for r in infer.lift_betas(b, m).collect()} == {("cg1", 0.5), ("cg2", 1.0), ("cg3", None)}


def test_sex_strain_and_mixture(spark):
    rng = np.random.default_rng(2)
    rows = [(s, f"{k}{i}", float(np.clip((0.9 if k == "h" and s == "m" else 0.1 if k == "l" and s == "m" else 0.5) + rng.normal(0, 0.03), 0, 1))) for s in "mf" for k in "hl" for i in range(60)]
    df = spark.createDataFrame(rows, "sample_id string, probe_id string, beta double")
    ids = lambda k: df.select("probe_id").distinct().where(F.col("probe_id").startswith(k))
    assert {r.sample_id: r.sex for r in infer.infer_sex(df, ids("h"), ids("l")).collect()} == {"m": "MALE", "f": "FEMALE"}
    cells = {"x": rng.random(200), "y": rng.random(200)}
    refs = spark.createDataFrame([(c, f"p{i}", float(v)) for c, vs in cells.items() for i, v in enumerate(vs)], "cell string, probe_id string, beta double")
    mix = spark.createDataFrame([("s", f"p{i}", float(0.7 * a + 0.3 * b)) for i, (a, b) in enumerate(zip(*cells.values()))], "sample_id string, probe_id string, beta double")
    got = {r.cell: r.fraction for r in infer.cell_mixture(mix, refs, ["x", "y"]).collect()}
    assert got["x"] == pytest.approx(0.7, abs=0.1) and got["y"] == pytest.approx(0.3, abs=0.1)


def test_mixture_with_an_unknown_part_against_a_grid(spark):
    rng = np.random.default_rng(4)
    g, g0 = rng.random((150, 2)), rng.integers(0, 2, 150)
    y = 0.5 * g[:, 0] + 0.2 * g[:, 1] + 0.3 * g0 + rng.normal(0, 0.01, 150)
    refs = spark.createDataFrame([(c, f"p{i}", float(g[i, k])) for k, c in enumerate("xy") for i in range(150)], "cell string, probe_id string, beta double")
    mix = spark.createDataFrame([("s", f"p{i}", float(v)) for i, v in enumerate(y)], "sample_id string, probe_id string, beta double")
    out = infer.cell_mixture(mix, refs, ["x", "y"])
    got = {r.cell: r for r in out.collect()}
    grid = [np.array([a, b, 100 - a - b]) / 100 for a in range(101) for b in range(101 - a)]
    least = min(sum(min(abs(r), abs(r - f[2])) if r >= f[2] / 2 else abs(r) for r in (y - g @ f[:2]).tolist()) for f in grid)
    assert got["x"].error <= least * 1.05 and sum(r.fraction for r in got.values()) == pytest.approx(1)
    assert [got[c].fraction for c in ("x", "y", "unknown")] == pytest.approx([0.5, 0.2, 0.3], abs=0.03)
    state = {r.probe_id: r.state for r in infer.unknown_state(mix, refs, out.select("sample_id", "cell", "fraction")).collect()}
    assert sum(state[f"p{i}"] == v for i, v in enumerate(g0.tolist())) >= 149


def test_set_groups(spark):
    rows = [("KYCG.A.gene", "g1", "p1"), ("KYCG.B.gene", "g2", "p1"), ("KYCG.B.tissue", "t1", "p2")]
    members = spark.createDataFrame(rows, "group string, dbname string, probe_id string")
    assert {r.dbname for r in sets.find_groups(members, platform="B").collect()} == {"g2", "t1"}
    assert {r.dbname for r in sets.take_groups(members, ["KYCG.B.tissue"]).collect()} == {"t1"}
    with pytest.raises(ValueError):
        sets.take_groups(members, ["KYCG.B.tissue", "none"])
    with pytest.raises(ValueError):
        sets.universe(members.withColumn("platform", F.lit("A")), "B")


SIGNALS = "sample_id string, probe_id string, mg double, mr double, ug double, ur double, col string, mask boolean"


def array(seed=0, n=900, shift=1.6):
    rng = np.random.default_rng(seed)
    out = []
    for i in range(n):
        b, t = float(rng.choice([0.05, 0.5, 0.95], p=[0.4, 0.2, 0.4])), float(rng.gamma(6, 600))
        bg = lambda: float(rng.normal(200, 30))
        m, u = b * t, (1 - b) * t
        if i % 3 == 0:
            out.append(("s", f"cg{i:04}", None, None, m + bg(), shift * u + bg(), "2", False))
        elif i % 3 == 1:
            out.append(("s", f"cg{i:04}", m + bg(), bg(), u + bg(), bg(), "G", False))
        else:
            out.append(("s", f"cg{i:04}", bg(), shift * m + bg(), bg(), shift * u + bg(), "R", False))
    return out


def test_background_correction_removes_background(spark):
    df = spark.createDataFrame(array(), SIGNALS)
    fits = {r.channel: r for r in normalize.noob_fits(df).collect()}
    assert fits["G"].mu == pytest.approx(200, abs=8) and fits["G"].sigma == pytest.approx(30, abs=8)
    out = normalize.noob(df).toPandas()
    off = out.loc[out.col == "R", ["mg", "ug"]].to_numpy().ravel()
    assert np.median(off) < 60 and off.min() >= 15
    few = spark.createDataFrame(array(n=60), SIGNALS)
    assert sorted(map(tuple, normalize.noob(few).collect()), key=str) == sorted(map(tuple, few.collect()), key=str)


def test_dye_bias_is_levelled(spark):
    df = spark.createDataFrame(array(), SIGNALS)
    gap = lambda d: abs(np.log(np.nanmedian(d.loc[d.col == "R", ["mr", "ur"]]) / np.nanmedian(d.loc[d.col == "G", ["mg", "ug"]])))
    before = gap(df.toPandas())
    assert gap(normalize.dye_nonlinear(df).toPandas()) < before / 4
    lin = normalize.dye_linear(df, both_beads=True).toPandas()
    assert gap(lin) < before / 4
    hard = normalize.dye_nonlinear(df, most_distorted=0.0).toPandas()
    assert hard.loc[hard.col == "G", "mask"].all()


def test_design_matching_keeps_order_and_type_two(spark):
    df = spark.createDataFrame(array(), SIGNALS)
    a, b = df.toPandas().sort_values("probe_id"), normalize.match_design(df).toPandas().sort_values("probe_id")
    two = (a.col == "2").to_numpy()
    assert (a[two].fillna(-1).to_numpy() == b[two].fillna(-1).to_numpy()).all()
    assert not np.allclose(a[~two].mg, b[~two].mg)


def test_copy_number_finds_a_gain(spark):
    rng = np.random.default_rng(4)
    rows = []
    for s in ("n1", "n2", "t"):
        for i in range(3000):
            base = 4000 + (i * 37) % 900
            gain = 2.0 if s == "t" and 1000 <= i < 1800 else 1.0
            rows.append((s, f"p{i}", None, None, base * gain + float(rng.normal(0, 80)), 10.0, "2", False))
    df = spark.createDataFrame(rows, SIGNALS)
    coords = spark.range(3000).select(F.concat(F.lit("p"), F.col("id").cast("string")).alias("probe_id"), F.lit("chr1").alias("chrom"), (F.col("id") * 1000 + 1).alias("start"), (F.col("id") * 1000 + 2).alias("end"))
    lengths = spark.createDataFrame([("chr1", 3_000_000)], "chrom string, length long")
    gaps = spark.createDataFrame([], "chrom string, start long, end long")
    cn = copynumber.signal(df, ["n1", "n2"])
    segs = copynumber.segments(copynumber.bin_signals(cn, coords, copynumber.bins(lengths, gaps, coords)), permutations=200).orderBy("start").collect()
    assert len(segs) == 3 and segs[1].mean > segs[0].mean + 0.5
