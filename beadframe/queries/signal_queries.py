"""Signal views, masks, joins by id, detection and quality metrics."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.store import stored
from ..operators import detect, masks, qc, sets, signal
from ..sources import adapters as a
from .registry import query, r6

# ---- views and arithmetic


@query("SELECT sample_id, probe_id, round(m, 6) AS m, round(u, 6) AS u, round(m + u, 6) AS mu FROM mu WHERE NOT mask")
def mu_view(spark, sf):
    return signal.mu(a.signals(spark, sf), drop_masked=True, total=True).select("sample_id", "probe_id", r6("m"), r6("u"), r6("mu"))


@query("SELECT sample_id, probe_id, CASE col WHEN 'G' THEN mr ELSE mg END AS m, CASE col WHEN 'G' THEN ur ELSE ug END AS u FROM signals WHERE col <> '2'")
def mu_oob(spark, sf):
    return signal.mu_out_of_band(a.signals(spark, sf)).select("sample_id", "probe_id", "m", "u")


@query("SELECT sample_id, probe_id, channel, v FROM oob", more="""
oob AS (SELECT sample_id, probe_id, 'G' AS channel, unnest([mg, ug]) AS v FROM signals WHERE col = 'R'
  UNION ALL SELECT sample_id, probe_id, 'R', unnest([mr, ur]) FROM signals WHERE col = 'G')""")
def oob_channels(spark, sf):
    return signal.out_of_band(a.signals(spark, sf)).select("sample_id", "probe_id", "channel", "v")


@query("SELECT sample_id, probe_id, round(beta, 6) AS beta FROM betas")
def betas(spark, sf):
    return signal.betas(a.signals(spark, sf)).select("sample_id", "probe_id", r6("beta"))


@query("""SELECT sample_id, probe_id, round(CASE WHEN mask THEN NULL
  WHEN col <> '2' THEN CASE WHEN mg + mr + ug + ur IS NOT NULL THEN greatest(mg + mr, 1) / greatest(mg + mr + ug + ur, 2) END
  ELSE b0 END, 6) AS beta FROM raw_betas""")
def betas_sum_type1(spark, sf):
    return signal.betas(a.signals(spark, sf), sum_type_one=True).select("sample_id", "probe_id", r6("beta"))


@query("SELECT sample_id, count(*) AS n, avg(m + u) AS mean_total, median(m + u) AS median_total, count(m + u) AS n_total FROM mu GROUP BY 1")
def total_intensity(spark, sf):
    t = signal.total_intensities(a.signals(spark, sf))
    return t.groupBy("sample_id").agg(F.count("*").alias("n"), F.avg("total").alias("mean_total"), F.median("total").alias("median_total"), F.count("total").alias("n_total"))


@query("SELECT sample_id, (coalesce(sum(m), 0) + coalesce(sum(u), 0)) / nullif(count(m) + count(u), 0) AS mean_intensity FROM mu WHERE NOT mask GROUP BY 1")
def mean_intensity(spark, sf):
    return signal.mean_intensity(a.signals(spark, sf))


@query("SELECT sample_id, median(m + u) AS median_total FROM mu WHERE NOT mask GROUP BY 1")
def median_total(spark, sf):
    return signal.median_total_intensity(a.signals(spark, sf))


@query("SELECT sample_id, probe_id, round(log2(beta / (1 - beta)), 6) AS m_value, true AS comes_back FROM betas WHERE beta > 0 AND beta < 1")
def m_values(spark, sf):
    b = signal.betas(a.signals(spark, sf)).where("beta > 0 AND beta < 1").withColumn("m_value", signal.beta_to_m(F.col("beta")))
    return b.select("sample_id", "probe_id", r6("m_value"), (F.abs(signal.m_to_beta(F.col("m_value")) - F.col("beta")) < 1e-9).alias("comes_back"))


AF = """af AS (SELECT sample_id, pk, probe_id, col, CASE WHEN o + i IS NOT NULL THEN greatest(o, 1) / greatest(o + i, 2) END AS af FROM (
  SELECT *, CASE col WHEN 'G' THEN mr + ur ELSE mg + ug END AS o, CASE col WHEN 'G' THEN mg + ug ELSE mr + ur END AS i FROM signals WHERE col <> '2'))"""


@query("SELECT sample_id, probe_id, round(af, 6) AS af FROM af", more=AF)
def type1_af(spark, sf):
    return signal.type_one_af(a.signals(spark, sf)).select("sample_id", "probe_id", r6("af"))


@query("SELECT sample_id, probe_id, round(af, 6) AS af FROM af UNION ALL SELECT sample_id, probe_id, round(b0, 6) FROM raw_betas WHERE starts_with(probe_id, 'rs')", more=AF)
def allele_freqs(spark, sf):
    return signal.allele_frequencies(a.signals(spark, sf)).select("sample_id", "probe_id", r6("af"))


@query("""SELECT probe_id, sample_id, CASE WHEN l0 >= l1 AND l0 >= l2 THEN '0/0' WHEN l1 >= l2 THEN '0/1' ELSE '1/1' END AS gt FROM (
  SELECT *, k * ln(0.1) + (40 - k) * ln(0.9) AS l0, 40 * ln(0.5) AS l1, k * ln(0.9) + (40 - k) * ln(0.1) AS l2
  FROM (SELECT *, round(b0 * 40) AS k FROM raw_betas WHERE starts_with(probe_id, 'rs') AND b0 IS NOT NULL))""")
def genotypes(spark, sf):
    b = signal.betas(a.signals(spark, sf), mask=False).where("startswith(probe_id, 'rs') AND beta IS NOT NULL")
    return b.select("probe_id", "sample_id", signal.genotype(F.col("beta"))["gt"].alias("gt"))


@query("SELECT sample_id, probe_id, round(CASE WHEN beta > 0.85 THEN 1.0 WHEN beta < 0.15 THEN 0.0 ELSE (beta - 0.15) / 0.7 END, 6) AS d FROM betas")
def dichotomised(spark, sf):
    return signal.betas(a.signals(spark, sf)).select("sample_id", "probe_id", r6(signal.dichotomised(F.col("beta")), "d"))


HALF = """half AS (SELECT sample_id, pk, CASE WHEN h % 20 < 17 THEN 'cg' WHEN h % 20 = 17 THEN 'ch' WHEN h % 20 = 18 THEN 'rs' ELSE 'ctl_' END || lpad(h::VARCHAR, 8, '0') AS pfx,
  CASE WHEN pk % 2 = 0 THEN '_TC21' ELSE '_BO11' END AS sfx, beta, mask FROM (SELECT *, pk // 2 AS h FROM betas))"""


@query("SELECT sample_id, split_part(pfx || sfx, '_', 1) AS probe_id, round(avg(beta), 6) AS beta FROM half GROUP BY 1, 2", more=HALF)
def collapse_prefix_mean(spark, sf):
    return signal.collapse_mean(signal.betas(a.suffixed(a.signals(spark, sf)))).select("sample_id", "probe_id", r6("beta"))


@query("SELECT design, count(*) AS n FROM (SELECT substr(split_part(pfx || sfx, '_', -1), 3, 1) AS design FROM half WHERE NOT starts_with(pfx, 'ctl_')) GROUP BY 1", more=HALF)
def design_digits(spark, sf):
    s = a.suffixed(a.signals(spark, sf)).where("NOT startswith(probe_id, 'ctl_')")
    return s.groupBy(signal.design_type(F.col("probe_id")).alias("design")).agg(F.count("*").alias("n"))


# ---- masks


@query("SELECT sample_id, probe_id, mask OR pk % 41 = 0 OR pk % 37 = 0 AS mask FROM signals")
def mask_quality(spark, sf):
    return masks.quality_mask(a.signals(spark, sf), a.mask_members(spark, sf)).select("sample_id", "probe_id", "mask")


@query("SELECT sample_id, sum((mask OR NOT (starts_with(probe_id, 'cg') OR starts_with(probe_id, 'ch')))::INT)::BIGINT AS but_c, sum((mask OR NOT starts_with(probe_id, 'cg'))::INT)::BIGINT AS but_cg FROM signals GROUP BY 1")
def mask_prefix(spark, sf):
    s = a.signals(spark, sf)
    one = masks.prefix_mask_but_c(s).groupBy("sample_id").agg(F.count_if("mask").alias("but_c"))
    return one.join(masks.prefix_mask_but_cg(s).groupBy("sample_id").agg(F.count_if("mask").alias("but_cg")), "sample_id")


@query("SELECT probe_id FROM probes WHERE pk % 41 = 0")
def mask_nonunique(spark, sf):
    return masks.nonunique_probes(a.mask_members(spark, sf))


@query("SELECT dbname, count(DISTINCT probe_id) AS n FROM (SELECT 'M_nonuniq' AS dbname, probe_id FROM probes WHERE pk % 41 = 0 UNION ALL SELECT 'mapping', probe_id FROM probes WHERE pk % 37 = 0) GROUP BY 1")
def mask_names(spark, sf):
    return masks.available(a.mask_members(spark, sf))


@query("SELECT sample_id, sum(mask::INT)::BIGINT AS n_mask, sum((mask OR col = 'G')::INT)::BIGINT AS n_green, sum((pk % 37 = 0)::INT)::BIGINT AS n_set FROM signals GROUP BY 1")
def mask_set_and_green(spark, sf):
    s = a.signals(spark, sf)
    n = lambda df, name: df.groupBy("sample_id").agg(F.count_if("mask").alias(name))
    chosen = masks.mask_probes(a.mask_members(spark, sf), ["mapping"])
    return n(s, "n_mask").join(n(masks.mask_green(s), "n_green"), "sample_id").join(n(masks.set_mask(s, chosen), "n_set"), "sample_id")


@query("SELECT probe_id, bool_and(n > 0) AS complete FROM (SELECT probe_id, tissue, count(beta) AS n FROM betas JOIN samples USING (sample_id) GROUP BY 1, 2) GROUP BY 1")
def level_completeness(spark, sf):
    return masks.complete_levels(signal.betas(a.signals(spark, sf)), a.samples(spark, sf), "tissue")


# ---- detection

BG = """oob AS (SELECT sample_id, 'G' AS channel, unnest([mg, ug]) AS v FROM signals WHERE col = 'R' AND pk % 41 <> 0
  UNION ALL SELECT sample_id, 'R', unnest([mr, ur]) FROM signals WHERE col = 'G' AND pk % 41 <> 0),
neg AS (SELECT sample_id, 'G' AS channel, ug AS v FROM signals WHERE pk % 20 = 19 AND pk % 3 = 0 UNION ALL SELECT sample_id, 'R', ur FROM signals WHERE pk % 20 = 19 AND pk % 3 = 0)"""


def _ecdf(background: str, least: int) -> str:
    return f"""{BG}, bg AS (SELECT sample_id, channel, v FROM ({background}) WHERE v IS NOT NULL),
qq AS (SELECT sample_id, probe_id, 'G' AS channel, greatest(mg, ug) AS v FROM signals UNION ALL SELECT sample_id, probe_id, 'R', greatest(mr, ur) FROM signals),
un AS (SELECT sample_id, NULL AS probe_id, channel, v, 1 AS is_bg FROM bg UNION ALL SELECT sample_id, probe_id, channel, v, 0 FROM qq),
rk AS (SELECT *, sum(is_bg) OVER (PARTITION BY sample_id, channel ORDER BY v NULLS FIRST RANGE UNBOUNDED PRECEDING) AS k, sum(is_bg) OVER (PARTITION BY sample_id, channel) AS n FROM un),
fs AS (SELECT *, CASE WHEN v IS NULL THEN NULL WHEN n <= {least} THEN greatest(0, least(1000, floor(v))) / 1000 ELSE k / n END AS f FROM rk WHERE is_bg = 0),
pv AS (SELECT sample_id, probe_id, CASE WHEN count(f) = 2 THEN 1 - max(f) END AS p FROM fs GROUP BY 1, 2)"""


OOB = _ecdf("SELECT * FROM oob UNION ALL SELECT * FROM neg", 100)


def _detected(spark, sf):
    return detect.detect_oob(a.signals(spark, sf), masks.nonunique_probes(a.mask_members(spark, sf)), a.controls(spark, sf))


@query("SELECT sample_id, probe_id, round(p, 6) AS p FROM pv", more=OOB)
def detect_oob(spark, sf):
    return _detected(spark, sf).select("sample_id", "probe_id", r6("p"))


@query("SELECT sample_id, probe_id, round(p, 6) AS p FROM pv", more=_ecdf("SELECT * FROM neg", 0))
def detect_negctl(spark, sf):
    return detect.detect_negative(a.signals(spark, sf), a.controls(spark, sf)).select("sample_id", "probe_id", r6("p"))


@query("SELECT sample_id, CASE WHEN count(p) > 100 THEN round(sum((p < 0.05)::INT) / count(p), 6) END AS rate FROM pv GROUP BY 1", more=OOB)
def success_rate(spark, sf):
    return detect.success_rate(_detected(spark, sf)).select("sample_id", r6("rate"))


@query("""SELECT sample_id, CASE WHEN starts_with(probe_id, 'cg') THEN 'cg' WHEN starts_with(probe_id, 'ch') THEN 'ch' ELSE 'other' END AS kind, count(*) AS n,
  round(avg(b), 6) AS mean_beta, round(sum((b < 0.3)::INT) / nullif(count(b), 0), 6) AS frac_low, round(sum((b > 0.7)::INT) / nullif(count(b), 0), 6) AS frac_high, (count(*) - count(b))::BIGINT AS n_na
  FROM (SELECT r.sample_id, r.probe_id, CASE WHEN NOT (r.mask OR NOT starts_with(r.probe_id, 'c') OR coalesce(p > 0.05, false)) THEN b0 END AS b FROM raw_betas r JOIN pv USING (sample_id, probe_id)) GROUP BY ALL""", more=OOB)
def detected_betas(spark, sf):
    s = masks.prefix_mask(a.signals(spark, sf), ["c"], invert=True)
    b = signal.betas(detect.mask_undetected(s, _detected(spark, sf)))
    kind = F.when(F.col("probe_id").startswith("cg"), "cg").when(F.col("probe_id").startswith("ch"), "ch").otherwise("other")
    n = F.count("beta")
    return b.groupBy("sample_id", kind.alias("kind")).agg(
        F.count("*").alias("n"), r6(F.avg("beta"), "mean_beta"), r6(F.try_divide(F.count_if(F.col("beta") < 0.3), n), "frac_low"),
        r6(F.try_divide(F.count_if(F.col("beta") > 0.7), n), "frac_high"), (F.count("*") - n).alias("n_na"),
    )


@query("""SELECT sample_id, probe_id, round(p, 6) AS p, mask FROM (SELECT *, row_number() OVER (PARTITION BY sample_id, pfx ORDER BY mask::INT + p NULLS LAST, id) AS n
  FROM (SELECT h.sample_id, split_part(pfx || sfx, '_', 1) AS pfx, split_part(pfx || sfx, '_', 1) AS probe_id, pfx || sfx AS id, h.mask, p FROM half h JOIN (SELECT pv.*, pk FROM pv JOIN probes USING (probe_id)) x ON x.sample_id = h.sample_id AND x.pk = h.pk)) WHERE n = 1""", more=OOB + ", " + HALF)
def collapse_prefix_minp(spark, sf):
    s = a.signals(spark, sf)
    both = s.join(_detected(spark, sf), ["sample_id", "probe_id"])
    return signal.collapse_least_p(a.suffixed(both)).select("sample_id", "probe_id", r6("p"), "mask")


# Betas in order of total signal, in windows of 500 that start at 500 even steps of its logarithm.
DISPERSION = """io AS (SELECT sample_id, m, u FROM mu UNION ALL SELECT sample_id, CASE col WHEN 'G' THEN mr ELSE mg END, CASE col WHEN 'G' THEN ur ELSE ug END FROM signals WHERE col <> '2'),
bt AS (SELECT sample_id, m + u AS total, m / (m + u) AS beta, greatest(m, u) AS v, row_number() OVER (PARTITION BY sample_id ORDER BY m + u, m / (m + u)) - 1 AS i FROM io WHERE m + u > 0),
eg AS (SELECT sample_id, j, pow(2, l + (h - l) * j / 499) AS e FROM (SELECT sample_id, log2(greatest(1, min(total) - 1)) AS l, log2(max(total) + 1) AS h FROM bt GROUP BY 1), range(500) r(j)),
fi AS (SELECT eg.sample_id, j, count(bt.i) AS f FROM eg LEFT JOIN bt ON bt.sample_id = eg.sample_id AND total <= e GROUP BY 1, 2),
sp AS (SELECT fi.sample_id, j, f, quantile_cont(beta, 0.05) AS a, quantile_cont(beta, 0.95) AS b FROM fi JOIN bt ON bt.sample_id = fi.sample_id AND i >= f AND i < f + 500 GROUP BY 1, 2, 3),
w0 AS (SELECT sample_id, a AS a0, b AS b0 FROM sp WHERE j = 0),
wd AS (SELECT sample_id, arg_min(f, j) AS f FROM sp JOIN w0 USING (sample_id) WHERE a - a0 < -0.2 OR b - b0 > 0.2 GROUP BY 1),
li AS (SELECT w0.sample_id, least(3000, CASE WHEN b0 - a0 > 0.5 THEN t9.total ELSE coalesce(tw.total, 1e18) END) AS lim FROM w0 LEFT JOIN wd USING (sample_id) LEFT JOIN bt t9 ON t9.sample_id = w0.sample_id AND t9.i = 9 LEFT JOIN bt tw ON tw.sample_id = w0.sample_id AND tw.i = wd.f + 499),
un AS (SELECT bt.sample_id, NULL AS probe_id, v, 1 AS is_bg FROM bt JOIN li USING (sample_id) WHERE total <= lim UNION ALL SELECT sample_id, probe_id, CASE WHEN m + u IS NOT NULL THEN greatest(m, u) END, 0 FROM mu),
rk AS (SELECT *, sum(is_bg) OVER (PARTITION BY sample_id ORDER BY v NULLS FIRST RANGE UNBOUNDED PRECEDING) AS k, sum(is_bg) OVER (PARTITION BY sample_id) AS n FROM un)"""


@query("SELECT sample_id, probe_id, CASE WHEN v IS NULL THEN 1.0 ELSE round(1 - k / n, 6) END AS p FROM rk WHERE is_bg = 0", more=DISPERSION)
def detect_background(spark, sf):
    return detect.detect_background(a.signals(spark, sf)).select("sample_id", "probe_id", r6("p"))


CHANNEL = """ch AS (SELECT *, CASE WHEN mr IS NOT NULL AND ur IS NOT NULL THEN greatest(mr, ur) END AS rm, CASE WHEN mg IS NOT NULL AND ug IS NOT NULL THEN greatest(mg, ug) END AS gm FROM signals WHERE col <> '2'),
nw AS (SELECT *, CASE WHEN rm > gm THEN 'R' WHEN rm IS NOT NULL AND gm IS NOT NULL THEN 'G' END AS nc FROM ch),
lim AS (SELECT sample_id, quantile_cont(v, 0.95) AS lim FROM (SELECT sample_id, unnest(CASE nc WHEN 'R' THEN [mg, ug] WHEN 'G' THEN [mr, ur] ELSE [] END) AS v FROM nw) GROUP BY 1),
res AS (SELECT nw.*, CASE WHEN rm IS NULL OR gm IS NULL OR greatest(rm, gm) < lim THEN col ELSE nc END AS new_col FROM nw LEFT JOIN lim USING (sample_id))"""


@query("SELECT sample_id, probe_id, col AS old_col, new_col AS col FROM res UNION ALL SELECT sample_id, probe_id, col, col FROM signals WHERE col = '2'", more=CHANNEL)
def channel_infer(spark, sf):
    return detect.infer_channel(a.signals(spark, sf)).select("sample_id", "probe_id", "old_col", "col")


_SUMMARY = "SELECT sample_id, " + ", ".join(f"sum((col = '{x}' AND new_col = '{y}')::INT)::BIGINT AS {{}}{x.lower()}2{y.lower()}" for x, y in ("RR", "GG", "RG", "GR")) + " FROM res GROUP BY 1"


@query(_SUMMARY.format("", "", "", ""), more=CHANNEL)
def channel_summary(spark, sf):
    return detect.channel_summary(a.signals(spark, sf))


# ---- quality metrics


@query("""SELECT sample_id, sum((p IS NULL)::INT)::BIGINT AS num_dtna, round(sum((p IS NULL)::INT) / count(*), 6) AS frac_dtna, sum((p <= 0.05)::INT)::BIGINT AS num_dt, round(sum((p <= 0.05)::INT) / count(p), 6) AS frac_dt,
  """ + ", ".join(f"count(*) FILTER (p <= 0.05 AND {w})::BIGINT AS num_dt_{n}, round(count(*) FILTER (p <= 0.05 AND {w}) / nullif(count(p) FILTER ({w}), 0), 6) AS frac_dt_{n}" for n, w in (("mk", "NOT mask"), ("cg", "starts_with(probe_id, 'cg')"), ("ch", "starts_with(probe_id, 'ch')"), ("rs", "starts_with(probe_id, 'rs')"))) + " FROM pv JOIN probes USING (probe_id) GROUP BY 1", more=OOB)
def qc_detection(spark, sf):
    out = qc.detection(a.signals(spark, sf), _detected(spark, sf))
    return out.select(*(r6(c) if c.startswith("frac") else F.col(c) for c in out.columns))


@query("""SELECT sample_id, count(*) AS num_probes, count(*) FILTER (col = '2') AS num_probes_ii, count(*) FILTER (col = 'R') AS num_probes_ir, count(*) FILTER (col = 'G') AS num_probes_ig,
  count(*) FILTER (starts_with(probe_id, 'cg')) AS num_probes_cg, count(*) FILTER (starts_with(probe_id, 'ch')) AS num_probes_ch, count(*) FILTER (starts_with(probe_id, 'rs')) AS num_probes_rs FROM signals GROUP BY 1""")
def qc_counts(spark, sf):
    return qc.counts(a.signals(spark, sf))


def _mean(pairs: str, where: str) -> str:
    x, y = pairs.split()
    return f"round((coalesce(sum({x}) FILTER ({where}), 0) + coalesce(sum({y}) FILTER ({where}), 0)) / nullif(count({x}) FILTER ({where}) + count({y}) FILTER ({where}), 0), 6)"


@query(f"""SELECT sample_id, {_mean('m u', 'NOT mask')} AS mean_intensity, {_mean('m u', 'true')} AS mean_intensity_mu, {_mean('m u', "col = '2'")} AS mean_ii, {_mean('mg ug', "col = 'G'")} AS mean_inb_grn,
  {_mean('mr ur', "col = 'R'")} AS mean_inb_red, {_mean('mg ug', "col = 'R'")} AS mean_oob_grn, {_mean('mr ur', "col = 'G'")} AS mean_oob_red,
  count(*) FILTER (m IS NULL AND NOT mask) AS na_intensity_m, count(*) FILTER (u IS NULL AND NOT mask) AS na_intensity_u, """ + ", ".join(
    f"count(*) FILTER (m IS NULL AND NOT mask AND col = '{c}') + count(*) FILTER (u IS NULL AND NOT mask AND col = '{c}') AS na_intensity_{k}" for k, c in (("ig", "G"), ("ir", "R"), ("ii", "2"))) + " FROM mu GROUP BY 1")
def qc_intensity(spark, sf):
    out = qc.intensity(a.signals(spark, sf))
    return out.select(*(r6(c) if c.startswith("mean") else F.col(c) for c in out.columns))


@query(_SUMMARY.format(*["switch_"] * 4), more=CHANNEL)
def qc_channel(spark, sf):
    return qc.channel(a.signals(spark, sf))


DYE = """ib AS (SELECT sample_id, col AS channel, unnest(CASE col WHEN 'G' THEN [mg, ug] ELSE [mr, ur] END) AS v FROM signals WHERE col <> '2'),
rk AS (SELECT *, row_number() OVER (PARTITION BY sample_id, channel ORDER BY v DESC) AS n FROM ib WHERE v IS NOT NULL),
dye AS (SELECT sample_id, median(v) FILTER (channel = 'R') AS medr, median(v) FILTER (channel = 'G') AS medg, median(v) FILTER (channel = 'R' AND n <= 20) AS topr, median(v) FILTER (channel = 'G' AND n <= 20) AS topg FROM rk GROUP BY 1)"""


@query("SELECT sample_id, medr, medg, topr, topg, round(medr / medg, 6) AS rgratio, round((topr / topg) / (medr / medg), 6) AS rgdistort FROM dye", more=DYE)
def qc_dyebias(spark, sf):
    out = qc.dye_bias(a.signals(spark, sf))
    return out.select("sample_id", "medr", "medg", "topr", "topg", r6("rgratio"), r6("rgdistort"))


@query("""SELECT c.*, medr, medg, topr, topg, round(medr / medg, 6) AS rgratio, round((topr / topg) / (medr / medg), 6) AS rgdistort FROM (
  SELECT sample_id, count(*) AS num_probes, count(*) FILTER (col = '2') AS num_probes_ii, count(*) FILTER (col = 'R') AS num_probes_ir, count(*) FILTER (col = 'G') AS num_probes_ig,
  count(*) FILTER (starts_with(probe_id, 'cg')) AS num_probes_cg, count(*) FILTER (starts_with(probe_id, 'ch')) AS num_probes_ch, count(*) FILTER (starts_with(probe_id, 'rs')) AS num_probes_rs FROM signals GROUP BY 1) c JOIN dye USING (sample_id)""", more=DYE)
def qc_metrics(spark, sf):
    """The driver of the metric groups, with two of them side by side."""
    out = qc.metrics(a.signals(spark, sf), groups=["numProbes", "dyeBias"])
    return out.select(*(r6(c) if c.startswith("rg") else F.col(c) for c in out.columns))


@query("SELECT sample_id, " + ", ".join(
    f"round(avg(beta) FILTER ({w}), 6) AS mean_beta{n}, round(median(beta) FILTER ({w}), 6) AS median_beta{n}, round(count(*) FILTER ({w} AND beta < 0.3) / nullif(count(beta) FILTER ({w}), 0), 6) AS frac_unmeth{n}, "
    f"round(count(*) FILTER ({w} AND beta > 0.7) / nullif(count(beta) FILTER ({w}), 0), 6) AS frac_meth{n}, count(*) FILTER ({w}) - count(beta) FILTER ({w}) AS num_na{n}, "
    f"round((count(*) FILTER ({w}) - count(beta) FILTER ({w})) / nullif(count(*) FILTER ({w}), 0), 6) AS frac_na{n}"
    for n, w in (("", "true"), ("_cg", "starts_with(probe_id, 'cg')"), ("_ch", "starts_with(probe_id, 'ch')"), ("_rs", "starts_with(probe_id, 'rs')"))) + " FROM betas GROUP BY 1")
def qc_betas(spark, sf):
    out = qc.beta_metrics(signal.betas(a.signals(spark, sf)))
    return out.select(*(F.col(c) if c == "sample_id" or c.startswith("num") else r6(c) for c in out.columns))


@query("""SELECT s.sample_id, 'mean_beta' AS metric, round(s.v, 6) AS value, (SELECT count(*) FROM st o WHERE o.v <= s.v AND o.sample_id < 's06') / (SELECT count(*) FROM st WHERE sample_id < 's06') AS rank,
  (SELECT count(*) FROM st WHERE sample_id < 's06') AS n FROM st s""", more="st AS (SELECT sample_id, avg(beta) AS v FROM betas GROUP BY 1)")
def qc_rank(spark, sf):
    # Worked out once: a mean that is summed again in another order may not equal itself.
    stats = stored(signal.betas(a.signals(spark, sf)).groupBy("sample_id").agg(F.avg("beta").alias("mean_beta")), "means")
    return qc.rank_against(stats, stats.where("sample_id < 's06'"), ["mean_beta"]).select("sample_id", "metric", r6("value"), "rank", "n")


@query("SELECT sample_id, round(avg(v) FILTER (pk % 3 = 0) / avg(v) FILTER (pk % 3 = 1), 6) AS gct FROM (SELECT sample_id, pk, unnest([mg, ug]) AS v FROM signals WHERE col = 'R') GROUP BY 1")
def bisulfite_control(spark, sf):
    pick = lambda k: a.table(spark, sf, "part").where(F.col("p_partkey") % 3 == k).select(a.probe_name(F.col("p_partkey")).alias("probe_id"))
    return qc.bisulfite_control(a.signals(spark, sf), pick(0), pick(1)).select("sample_id", r6("gct"))


# ---- sets on betas


@query("SELECT sample_id, p_brand AS dbname, count(beta) AS n, CASE WHEN count(beta) >= 0.1 * count(*) AND count(beta) > 0 THEN round(avg(beta), 6) END AS value FROM betas b JOIN probes p USING (pk) GROUP BY 1, 2".replace("betas b", "(SELECT sample_id, pk, beta FROM betas) b"))
def set_stats(spark, sf):
    members = a.set_members(spark, sf).where("group = 'brand'")
    out = sets.set_statistics(signal.betas(a.signals(spark, sf)), members)
    return out.select("sample_id", "dbname", "n", r6("value"))
