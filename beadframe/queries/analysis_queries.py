"""Sets, ranges, models, inference, normalisation, copy number, sources and plot tables."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from ..functions import normal
from ..functions.store import shared_path
from ..operators import copynumber, frames, infer, masks, model, normalize, ranges, routing, sets, signal
from ..plans import prep
from ..sources import adapters as a
from ..sources import idat, idat_source, tables
from .registry import query, r6
from .signal_queries import AF, DYE, HALF, OOB, _detected


def _betas(spark, sf):
    return signal.betas(a.signals(spark, sf))


def _brands(spark, sf):
    return a.set_members(spark, sf).where("group = 'brand'")


def _universe(spark, sf):
    return a.coords(spark, sf).select("probe_id")


# ---- sets

COUNTS = """cnt AS (SELECT p_brand AS dbname, count(*) AS nd, count(*) FILTER (p_size <= 10) AS ndq, (SELECT count(*) FROM probes WHERE p_size <= 10) AS nq, (SELECT count(*) FROM probes) AS nu FROM probes GROUP BY 1),
lc AS (SELECT *, greatest(0, nq + nd - nu) AS lo, least(nq, nd) AS hi FROM cnt)"""


def _tail(low: str, high: str) -> str:
    term = "exp(lgamma(nd + 1) - lgamma(x + 1) - lgamma(nd - x + 1) + lgamma(nu - nd + 1) - lgamma(nq - x + 1) - lgamma(nu - nd - nq + x + 1) - lgamma(nu + 1) + lgamma(nq + 1) + lgamma(nu - nq + 1))"
    return f"least(1.0, list_sum([{term} for x in range({low}, {high} + 1)]))"


def _fisher(p: str) -> str:
    return f""", fp AS (SELECT *, {p} AS p FROM lc),
bh AS (SELECT *, least(1.0, min(p * n / i) OVER (ORDER BY i DESC ROWS UNBOUNDED PRECEDING)) AS fdr FROM (SELECT *, count(*) OVER () AS n, row_number() OVER (ORDER BY p, dbname) AS i FROM fp))"""


FISHER_SQL = """SELECT dbname, nd, ndq, nq, nu, round(log2((ndq::DOUBLE * (nu - nq - nd + ndq)) / ((nq - ndq)::DOUBLE * (nd - ndq))), 6) AS estimate, round(p, 6) AS p, round(fdr, 6) AS fdr,
  round(ndq / (nd + nq - ndq), 6) AS jaccard, round(ndq / least(nd, nq), 6) AS overlap_coef, round((log2(nd) + log2(nq) - 2 * log2(nu)) / (log2(ndq) - log2(nu)) - 1, 6) AS npmi, round(2 * ndq / (nd + nq), 6) AS dice FROM bh"""


def _enriched(spark, sf, alternative):
    out = sets.enrich(a.query_set(spark, sf), _brands(spark, sf), _universe(spark, sf), alternative)
    return out.select("dbname", "nd", "ndq", "nq", "nu", *(r6(c) for c in ("estimate", "p", "fdr", "jaccard", "overlap_coef", "npmi", "dice")))


@query(FISHER_SQL, more=COUNTS + _fisher(_tail("ndq", "hi")))
def enrich_fisher_greater(spark, sf):
    return _enriched(spark, sf, "greater")


@query(FISHER_SQL, more=COUNTS + _fisher(_tail("lo", "ndq")))
def enrich_fisher_less(spark, sf):
    return _enriched(spark, sf, "less")


@query(FISHER_SQL, more=COUNTS + _fisher(f"least(1.0, 2 * least({_tail('ndq', 'hi')}, {_tail('lo', 'ndq')}))"))
def enrich_fisher_two_sided(spark, sf):
    return _enriched(spark, sf, "two.sided")


GENE = """gs AS (SELECT DISTINCT g.gene, p.probe_id, p.p_size FROM probes p JOIN genes g ON g.chrom = p.chrom AND g.start <= p."end" + 10000 AND p.start - 10000 <= g."end"),
cnt AS (SELECT gene AS dbname, count(*) AS nd, count(*) FILTER (p_size <= 10) AS ndq, (SELECT count(*) FROM probes WHERE p_size <= 10) AS nq, (SELECT count(*) FROM probes) AS nu FROM gs GROUP BY 1 HAVING count(*) FILTER (p_size <= 10) > 0),
lc AS (SELECT *, greatest(0, nq + nd - nu) AS lo, least(nq, nd) AS hi FROM cnt)"""


@query("SELECT dbname, nd, ndq, round(p, 6) AS p, round(fdr, 6) AS fdr FROM bh", more=GENE + _fisher(_tail("ndq", "hi")))
def enrich_gene(spark, sf):
    members = ranges.gene_sets(a.coords(spark, sf), a.genes(spark, sf), a.query_set(spark, sf))
    out = sets.enrich(a.query_set(spark, sf), members, _universe(spark, sf))
    return out.select("dbname", "nd", "ndq", r6("p"), r6("fdr"))


@query("SELECT gene AS dbname, count(*) AS n FROM gs GROUP BY 1", more=GENE.split("cnt AS")[0].rstrip().rstrip(","))
def gene_sets(spark, sf):
    return ranges.gene_sets(a.coords(spark, sf), a.genes(spark, sf)).groupBy("dbname").agg(F.count("*").alias("n"))


@query("""SELECT query, max(CASE WHEN dbname = 'ECONOMY' THEN r END) AS economy, max(CASE WHEN dbname = 'SMALL' THEN r END) AS small FROM (
  SELECT query, dbname, round(log2((ndq::DOUBLE * (nu - nq - nd + ndq)) / ((nq - ndq)::DOUBLE * (nd - ndq))), 6) AS r FROM (
  SELECT q.query, p_type AS dbname, count(*) AS nd, count(*) FILTER (p_size <= q.s) AS ndq, (SELECT count(*) FROM probes WHERE p_size <= q.s) AS nq, (SELECT count(*) FROM probes) AS nu
  FROM probes, (VALUES ('a', 10), ('b', 25)) q(query, s) GROUP BY q.query, q.s, p_type)) GROUP BY 1""")
def enrich_aggregate(spark, sf):
    members, parts = a.set_members(spark, sf).where("group = 'type'"), a.table(spark, sf, "part")
    out = None
    for name, size in (("a", 10), ("b", 25)):
        chosen = parts.where(f"p_size <= {size}").select(a.probe_name(F.col("p_partkey")).alias("probe_id"))
        one = sets.enrich(chosen, members, _universe(spark, sf)).withColumn("query", F.lit(name))
        out = one if out is None else out.unionByName(one)
    wide = sets.aggregate_results(out, ["ECONOMY", "SMALL"])
    return wide.select("query", r6("ECONOMY", "economy"), r6("SMALL", "small"))


MEMB = """mem AS (SELECT p_brand AS dbname, probe_id, pk FROM probes UNION ALL SELECT p_type, probe_id, pk FROM probes)"""


@query("""SELECT a, b, shared, round(shared / (na + nb - shared), 6) AS jaccard FROM (SELECT x.dbname AS a, y.dbname AS b, count(*) AS shared FROM mem x JOIN mem y USING (probe_id) WHERE x.dbname < y.dbname GROUP BY 1, 2)
  JOIN (SELECT dbname AS a, count(*) AS na FROM mem GROUP BY 1) USING (a) JOIN (SELECT dbname AS b, count(*) AS nb FROM mem GROUP BY 1) USING (b)""", more=MEMB)
def set_overlap(spark, sf):
    return sets.set_overlap(a.set_members(spark, sf).where("group <> 'price'")).select("a", "b", "shared", r6("jaccard"))


@query("SELECT 'node' AS kind, count(DISTINCT dbname) AS n FROM mem UNION ALL SELECT 'edge', count(*) FROM (SELECT DISTINCT x.dbname, y.dbname FROM mem x JOIN mem y USING (probe_id) WHERE x.dbname < y.dbname)", more=MEMB)
def overlap_edges(spark, sf):
    nodes, edges = sets.network(a.set_members(spark, sf).where("group <> 'price'"))
    n = lambda df, kind: df.agg(F.count("*").alias("n")).select(F.lit(kind).alias("kind"), "n")
    return n(nodes, "node").unionByName(n(edges, "edge"))


@query("SELECT probe_id, string_agg(dbname, ',' ORDER BY dbname) AS sets FROM mem GROUP BY 1", more=MEMB)
def probe_annotation(spark, sf):
    return sets.annotate(_universe(spark, sf), a.set_members(spark, sf).where("group <> 'price'"))


@query("SELECT probe_id, (p_type = 'ECONOMY')::BIGINT AS economy, (p_type = 'SMALL')::BIGINT AS small FROM probes")
def probe_indicator(spark, sf):
    out = sets.indicator(_universe(spark, sf), a.set_members(spark, sf).where("group = 'type'"), ["ECONOMY", "SMALL"])
    return out.select("probe_id", F.col("ECONOMY").alias("economy"), F.col("SMALL").alias("small"))


@query("""SELECT dbname, n, overlap, round(CASE WHEN overlap = n THEN 0 ELSE max(cs) END, 6) AS es_max, round(CASE WHEN overlap = n THEN 0 ELSE least(min(cs), 0) END, 6) AS es_min FROM (
  SELECT *, sum(CASE WHEN hit THEN 1.0 / overlap ELSE -1.0 / (n - overlap) END) OVER (PARTITION BY dbname ORDER BY price, probe_id ROWS UNBOUNDED PRECEDING) AS cs FROM (
  SELECT d.dbname, p.price, p.probe_id, p.p_brand = d.dbname AS hit, (SELECT count(*) FROM probes) AS n, d.overlap FROM probes p, (SELECT p_brand AS dbname, count(*) AS overlap FROM probes GROUP BY 1) d)) GROUP BY dbname, n, overlap""")
def enrich_es(spark, sf):
    values = a.set_members(spark, sf).where("group = 'price'").select("probe_id", "value")
    out = sets.running_scores(values, _brands(spark, sf))
    return out.select("dbname", "n", "overlap", r6("es_max"), r6("es_min"))


# Random sets of each size by 100 hashed orders of the positions; sides that none reaches take a normal tail.
_NULL = """ps AS (SELECT p_brand, row_number() OVER (ORDER BY price, probe_id) AS pos FROM probes), nn AS (SELECT count(*) AS n FROM ps), sz AS (SELECT p_brand AS dbname, count(*) AS k FROM ps GROUP BY 1),
dr AS (SELECT draw, pos, row_number() OVER (PARTITION BY draw ORDER BY md5('1-' || draw || '-' || pos)) AS r FROM range(100) d(draw), (SELECT pos FROM ps)),
ex AS (SELECT k, n, draw, pos, row_number() OVER (PARTITION BY k, draw ORDER BY pos) AS j FROM dr JOIN (SELECT DISTINCT k FROM sz) ON r <= k, nn),
nl AS (SELECT k, draw, max(j / k - (pos - j) / (n - k)) AS hi, least(min((j - 1) / k - (pos - j) / (n - k)), 0) AS lo FROM ex GROUP BY 1, 2),
ob AS (SELECT dbname, k, n, max(j / k - (pos - j) / (n - k)) AS es_max, least(min((j - 1) / k - (pos - j) / (n - k)), 0) AS es_min
  FROM (SELECT p_brand AS dbname, pos, row_number() OVER (PARTITION BY p_brand ORDER BY pos) AS j FROM ps) JOIN sz USING (dbname), nn GROUP BY 1, 2, 3),
sh AS (SELECT dbname, n, k, es_max, es_min, avg((hi > es_max)::INT) AS ph, avg((lo <= es_min)::INT) AS pl, (es_max - avg(hi)) / (greatest(stddev_samp(hi), 1e-12) * sqrt(2)) AS yh, (avg(lo) - es_min) / (greatest(stddev_samp(lo), 1e-12) * sqrt(2)) AS yl FROM ob JOIN nl USING (k) GROUP BY 1, 2, 3, 4, 5)"""


@query(f"SELECT dbname, n, k AS overlap, round(CASE WHEN -es_min > es_max THEN es_min ELSE es_max END, 6) AS estimate, round(CASE WHEN -es_min > es_max THEN CASE WHEN pl = 0 THEN {normal.upper_tail('yl')} ELSE pl END WHEN ph = 0 THEN {normal.upper_tail('yh')} ELSE ph END, 6) AS p FROM sh", more=_NULL)
def enrich_es_permuted(spark, sf):
    values = a.set_members(spark, sf).where("group = 'price'").select("probe_id", "value")
    return sets.enrich_values(values, _brands(spark, sf)).select("dbname", "n", "overlap", r6("estimate"), r6("p"))


RANK = "(rank() OVER (PARTITION BY sample_id ORDER BY {0}) + (count(*) OVER (PARTITION BY sample_id, {0}) - 1) / 2.0)"


@query(f"SELECT sample_id AS dbname, count(*) AS n, round(corr(rx, ry), 6) AS rho FROM (SELECT sample_id, {RANK.format('price')} AS rx, {RANK.format('beta')} AS ry FROM (SELECT sample_id, beta, price FROM betas JOIN probes USING (pk) WHERE beta IS NOT NULL)) GROUP BY 1")
def enrich_spearman(spark, sf):
    members = _betas(spark, sf).select(F.col("sample_id").alias("dbname"), "probe_id", F.col("beta").alias("value"))
    out = sets.spearman(a.set_members(spark, sf).where("group = 'price'").select("probe_id", "value"), members)
    return out.select("dbname", "n", r6("rho"))


@query("SELECT 'brand' AS \"group\", p_brand AS dbname, count(*) AS n FROM probes GROUP BY 2")
def set_discovery(spark, sf):
    return sets.find_groups(a.set_members(spark, sf), "bran")


@query("SELECT 'type' AS \"group\", p_type AS dbname, count(*) AS n, CASE WHEN p_type LIKE 'S%' THEN 's' END AS label FROM probes GROUP BY 2")
def set_metadata(spark, sf):
    members = sets.take_groups(a.set_members(spark, sf), ["type"])
    meta = members.where("startswith(dbname, 'S')").select("group", "dbname", F.lit("s").alias("label")).distinct()
    return sets.set_metadata(members, meta)


@query("SELECT probe_id FROM probes")
def platform_universe(spark, sf):
    return sets.universe(a.manifest(spark, sf), "TP")


# ---- ranges and copy number

LENGTHS = """len AS (SELECT chrom, max("end") + 10000 AS length FROM probes GROUP BY 1),
gap AS (SELECT chrom, unnest(range(100000, length, 100000)) AS gs FROM len),
tile AS (SELECT chrom, unnest(range(1, length + 1, 50000)) AS s, length FROM len),
piece AS (SELECT t.chrom, s, least(s + 49999, length) AS e, gs, gs + 2999 AS ge FROM tile t LEFT JOIN gap g ON g.chrom = t.chrom AND gs <= least(s + 49999, length) AND gs + 2999 >= s),
bins AS (SELECT chrom, s, CASE WHEN gs IS NULL THEN e ELSE gs - 1 END AS e FROM piece WHERE gs IS NULL OR gs > s UNION ALL SELECT chrom, ge + 1, e FROM piece WHERE gs IS NOT NULL AND ge < e)"""


def _genome(spark, sf):
    coords = a.coords(spark, sf)
    lengths = coords.groupBy("chrom").agg((F.max("end") + 10_000).alias("length"))
    step = F.lit(100_000).cast("long")
    gaps = lengths.where("length > 100000").select("chrom", F.explode(F.sequence(step, F.col("length") - 1, step)).alias("start")).withColumn("end", F.col("start") + 2999)
    return coords, lengths, gaps


@query('SELECT gene, p.probe_id, p.start AS probe_start FROM genes g JOIN probes p ON p.chrom = g.chrom AND p.start <= g."end" AND g.start <= p."end"')
def interval_overlap(spark, sf):
    out = ranges.overlap_join(a.genes(spark, sf).drop("strand"), a.coords(spark, sf).select("chrom", "start", "end", "probe_id"))
    return out.select("gene", "probe_id", F.col("r_start").alias("probe_start"))


@query('SELECT chrom, s AS start, e AS "end" FROM bins', more=LENGTHS)
def tiles_minus_gaps(spark, sf):
    _, lengths, gaps = _genome(spark, sf)
    return ranges.minus_gaps(ranges.tiles(lengths), gaps)


@query('SELECT b.chrom, s AS start, e AS "end", count(p.pk) AS n FROM bins b LEFT JOIN probes p ON p.chrom = b.chrom AND p.start <= e AND p."end" >= s GROUP BY 1, 2, 3', more=LENGTHS)
def bin_counts(spark, sf):
    coords, lengths, gaps = _genome(spark, sf)
    return ranges.count_overlaps(ranges.minus_gaps(ranges.tiles(lengths), gaps), coords, ["chrom", "start", "end"], 50_000)


# A bin a round and chromosome: the smallest goes into the neighbour that it touches, the left one first.
_MERGE = LENGTHS + """, bc AS (SELECT b.chrom, s, e, count(p.pk) AS n FROM bins b LEFT JOIN probes p ON p.chrom = b.chrom AND p.start <= e AND p."end" >= s GROUP BY 1, 2, 3),
mg AS (SELECT 0 AS round, chrom, list({'s': s, 'e': e, 'n': n} ORDER BY s) AS b FROM bc GROUP BY 2
  UNION ALL SELECT round + 1, chrom, CASE WHEN i > 1 AND b[i - 1].e + 1 = b[i].s THEN list_slice(b, 1, i - 2) || [{'s': b[i - 1].s, 'e': b[i].e, 'n': b[i - 1].n + b[i].n}] || list_slice(b, i + 1, len(b))
    WHEN i < len(b) AND b[i].e + 1 = b[i + 1].s THEN list_slice(b, 1, i - 1) || [{'s': b[i].s, 'e': b[i + 1].e, 'n': b[i].n + b[i + 1].n}] || list_slice(b, i + 2, len(b)) ELSE list_slice(b, 1, i - 1) || list_slice(b, i + 1, len(b)) END
  FROM (SELECT *, list_position(ns, list_min(ns)) AS i FROM (SELECT *, [x.n for x in b] AS ns FROM mg)) WHERE list_min(ns) < 20)"""


@query('SELECT chrom, x.s AS start, x.e AS "end", x.n AS n FROM (SELECT chrom, unnest(b) AS x FROM mg QUALIFY round = max(round) OVER (PARTITION BY chrom))', more=_MERGE)
def bins_merged(spark, sf):
    coords, lengths, gaps = _genome(spark, sf)
    return copynumber.bins(lengths, gaps, coords)


# The normal equations of the three normals by Cramer's rule, from covariances.
_COV = [[f"covar_pop(x{i}, x{j})" for j in range(3)] for i in range(3)]
_TARGET = [f"covar_pop(x{i}, t)" for i in range(3)]


def _determinant(m: list[list[str]]) -> str:
    minor = lambda i, j: f"({m[1][i]} * {m[2][j]} - {m[1][j]} * {m[2][i]})"
    return f"({m[0][0]} * {minor(1, 2)} - {m[0][1]} * {minor(0, 2)} + {m[0][2]} * {minor(0, 1)})"


_SLOPES = ", ".join(f"{_determinant([[_TARGET[i] if j == k else _COV[i][j] for j in range(3)] for i in range(3)])} / {_determinant(_COV)} AS w{k}" for k in range(3))
CN = f"""tot AS (SELECT sample_id, probe_id, m + u AS t FROM mu JOIN (SELECT DISTINCT probe_id AS pid FROM probes WHERE chrom IS NOT NULL) ON pid = probe_id WHERE m + u IS NOT NULL),
base AS (SELECT probe_id, max(t) FILTER (sample_id = 's01') AS x0, max(t) FILTER (sample_id = 's02') AS x1, max(t) FILTER (sample_id = 's03') AS x2 FROM tot GROUP BY 1),
j AS (SELECT * FROM tot JOIN base USING (probe_id) WHERE sample_id NOT IN ('s01', 's02', 's03') AND x0 + x1 + x2 IS NOT NULL),
ln AS (SELECT sample_id, {_SLOPES}, avg(t) AS mt, avg(x0) AS m0, avg(x1) AS m1, avg(x2) AS m2 FROM j GROUP BY 1),
cn AS (SELECT sample_id, probe_id, CASE WHEN t > 0 THEN log2(t / greatest(mt + w0 * (x0 - m0) + w1 * (x1 - m1) + w2 * (x2 - m2), 1)) END AS cn FROM j JOIN ln USING (sample_id))"""


def _cn(spark, sf):
    return copynumber.signal(a.signals(spark, sf), ["s01", "s02", "s03"], a.coords(spark, sf).where("chrom IS NOT NULL"))


@query("SELECT sample_id, probe_id, round(cn, 6) AS cn FROM cn", more=CN)
def cn_signal(spark, sf):
    return _cn(spark, sf).select("sample_id", "probe_id", r6("cn"))


@query('SELECT sample_id, b.chrom, s AS start, e AS "end", count(*) AS n, round(median(cn), 6) AS cn FROM bins b JOIN probes p ON p.chrom = b.chrom AND p.start <= e AND p."end" >= s JOIN cn USING (probe_id) GROUP BY 1, 2, 3, 4', more=CN + ", " + LENGTHS)
def bin_signals(spark, sf):
    coords, lengths, gaps = _genome(spark, sf)
    out = copynumber.bin_signals(_cn(spark, sf), coords, ranges.minus_gaps(ranges.tiles(lengths), gaps))
    return out.select("sample_id", "chrom", "start", "end", "n", r6("cn"))


@query()
def cn_segments(spark, sf):
    coords, lengths, gaps = _genome(spark, sf)
    binned = copynumber.bin_signals(_cn(spark, sf), coords, copynumber.bins(lengths, gaps, coords))
    return copynumber.segments(binned)


# ---- models

TWO = """y AS (SELECT probe_id, pk, sex, tissue, age, beta, sid FROM (SELECT sample_id, probe_id, pk, beta FROM effect) JOIN samples USING (sample_id) WHERE beta IS NOT NULL),
g AS (SELECT probe_id, count(*) FILTER (sex = 'F') AS nf, count(*) FILTER (sex = 'M') AS nm, avg(beta) FILTER (sex = 'F') AS mf, avg(beta) FILTER (sex = 'M') AS mm,
  sum(beta * beta) - coalesce(count(*) FILTER (sex = 'F') * pow(avg(beta) FILTER (sex = 'F'), 2), 0) - coalesce(count(*) FILTER (sex = 'M') * pow(avg(beta) FILTER (sex = 'M'), 2), 0) AS rss FROM y GROUP BY 1),
t AS (SELECT *, nf + nm - 2 AS df, (mm - mf) / sqrt(rss / (nf + nm - 2) * (1.0 / nf + 1.0 / nm)) AS t FROM g WHERE nf >= 2 AND nm >= 2)"""


def _effect(spark, sf):
    return a.with_effect(_betas(spark, sf))


SEX = model.Design(factors={"sex": ["F", "M"]})
BOTH = model.Design(factors={"sex": ["F", "M"], "tissue": ["t0", "t1", "t2"]})


def _balanced(spark, sf):
    """Probes with two betas or more in each sex."""
    rows = _effect(spark, sf).where("beta IS NOT NULL").join(a.samples(spark, sf), "sample_id")
    n = rows.groupBy("probe_id").agg(F.count_if(F.col("sex") == "F").alias("f"), F.count_if(F.col("sex") == "M").alias("m"))
    return n.where("f >= 2 AND m >= 2").select("probe_id")


def _fit(spark, sf, design, how=model.fit):
    return how(_effect(spark, sf).join(_balanced(spark, sf), "probe_id", "left_semi"), a.samples(spark, sf), design)


@query("SELECT probe_id, term, round(CASE term WHEN 'intercept' THEN mf ELSE mm - mf END, 6) AS estimate, round(CASE term WHEN 'intercept' THEN mf / sqrt(rss / df / nf) ELSE t END, 4) AS t, df FROM t, (VALUES ('intercept'), ('sex_M')) x(term) WHERE rss > 1e-9", more=TWO)
def ols_coef(spark, sf):
    coef, _ = _fit(spark, sf, SEX)
    return coef.where("std_error > 1e-6").select("probe_id", "term", r6("estimate"), F.round("t", 4).alias("t"), "df")


@query("SELECT probe_id, 'sex' AS contrast, round(t * t, 4) AS f FROM t WHERE rss > 1e-9", more=TWO)
def ols_ftest(spark, sf):
    _, tests = _fit(spark, sf, SEX)
    return tests.where("f IS NOT NULL").select("probe_id", "contrast", F.round("f", 4).alias("f"))


@query("SELECT probe_id, round(mf, 6) AS est_intercept, round(mm - mf, 6) AS est_sex_m, round(greatest(0, mm - mf) - least(0, mm - mf), 6) AS eff_sex FROM t", more=TWO)
def ols_summary(spark, sf):
    out = model.summary(_fit(spark, sf, SEX, model.fit_rows), SEX)
    return out.select("probe_id", r6("est_intercept"), r6("est_sex_M", "est_sex_m"), r6("eff_sex"))


@query("SELECT probe_id, sex, round(CASE sex WHEN 'F' THEN mf ELSE mm END, 6) AS prediction FROM t, (VALUES ('F'), ('M')) x(sex)", more=TWO)
def ols_predict(spark, sf):
    return model.predict(_fit(spark, sf, SEX)[0], SEX).select("probe_id", "sex", r6("prediction"))


@query("SELECT probe_id, round(abs(mm - mf), 6) AS eff_sex FROM t", more=TWO)
def ols_effect(spark, sf):
    return model.effect_size(model.predict(_fit(spark, sf, SEX)[0], SEX), ["sex"]).select("probe_id", r6("eff_sex"))


# Intercept, sex M, tissue t1 and t2 made orthogonal in this order; v is the inverse of the triangle
# that leads back. Tails of t are closed sums for the degrees that twelve samples leave.
_QR = TWO + """, x0 AS (SELECT probe_id, beta, (sex = 'M')::DOUBLE AS s, (tissue = 't1')::DOUBLE AS a, (tissue = 't2')::DOUBLE AS b FROM y JOIN t USING (probe_id)),
x1 AS (SELECT *, s - avg(s) OVER w AS s1, a - avg(a) OVER w AS a1, b - avg(b) OVER w AS b1, beta - avg(beta) OVER w AS y1 FROM x0 WINDOW w AS (PARTITION BY probe_id)),
x2 AS (SELECT *, sum(s1 * a1) OVER w / sum(s1 * s1) OVER w AS usa, sum(s1 * b1) OVER w / sum(s1 * s1) OVER w AS usb FROM x1 WINDOW w AS (PARTITION BY probe_id)),
x3 AS (SELECT *, a1 - usa * s1 AS a2, b1 - usb * s1 AS b2 FROM x2),
x4 AS (SELECT *, sum(a2 * b2) OVER w / nullif(sum(a2 * a2) OVER w, 0) AS uab, sum(a2 * a2) OVER w AS aa FROM x3 WINDOW w AS (PARTITION BY probe_id)),
m AS (SELECT probe_id, count(*) AS n, avg(beta) AS c1, avg(s) AS u1s, avg(a) AS u1a, avg(b) AS u1b, any_value(usa) AS usa, any_value(usb) AS usb, any_value(uab) AS uab, any_value(aa) AS aa,
  sum(s1 * s1) AS ss, sum(pow(b2 - uab * a2, 2)) AS bb, sum(y1 * s1) / sum(s1 * s1) AS cs, sum(y1 * a2) / any_value(aa) AS ca, sum(y1 * (b2 - uab * a2)) / sum(pow(b2 - uab * a2, 2)) AS cb, sum(y1 * y1) AS yy FROM x4 WHERE aa > 1e-9 GROUP BY 1),
v AS (SELECT *, n - 4 AS df, -usb + usa * uab AS vsb, -u1a + u1s * usa AS v1a, u1s * (usb - usa * uab) + u1a * uab - u1b AS v1b, yy - cs * cs * ss AS rss0, yy - cs * cs * ss - ca * ca * aa - cb * cb * bb AS rss FROM m WHERE bb > 1e-9),
cf AS (SELECT *, c1 - u1s * cs + v1a * ca + v1b * cb AS e1, cs - usa * ca + vsb * cb AS es, ca - uab * cb AS ea, cb AS eb, CASE WHEN df > 0 THEN rss / df END AS s2 FROM v),
tt AS (SELECT *, abs(e1) / sqrt(s2 * (1.0 / n + u1s * u1s / ss + v1a * v1a / aa + v1b * v1b / bb)) AS t1, abs(es) / sqrt(s2 * (1.0 / ss + usa * usa / aa + vsb * vsb / bb)) AS ts, abs(ea) / sqrt(s2 * (1.0 / aa + uab * uab / bb)) AS ta, abs(eb) / sqrt(s2 / bb) AS tb FROM cf)"""


def _t_tail(t: str) -> str:
    c2 = f"(df / (df + {t} * {t}))"
    even = f"sqrt(1 - {c2}) * (1 + (df >= 4)::INT * {c2} / 2 + (df >= 6)::INT * 3 * pow({c2}, 2) / 8 + (df >= 8)::INT * 5 * pow({c2}, 3) / 16)"
    odd = f"2 / pi() * (atan({t} / sqrt(df)) + (df >= 3)::INT * sqrt({c2} * (1 - {c2})) * (1 + (df >= 5)::INT * 2 * {c2} / 3 + (df >= 7)::INT * 8 * pow({c2}, 2) / 15))"
    return f"round(1 - CASE WHEN df % 2 = 0 THEN {even} ELSE {odd} END, 6)"


@query(f"""SELECT probe_id, round(e1, 6) AS est_intercept, round(es, 6) AS est_sex_m, round(ea, 6) AS est_tissue_t1, round(eb, 6) AS est_tissue_t2, {_t_tail('t1')} AS pval_intercept, {_t_tail('ts')} AS pval_sex_m,
  {_t_tail('ta')} AS pval_tissue_t1, {_t_tail('tb')} AS pval_tissue_t2, {_t_tail('ts')} AS fpval_sex, round(pow(rss / rss0, df / 2), 6) AS fpval_tissue, round(abs(es), 6) AS eff_sex, round(greatest(0, ea, eb) - least(0, ea, eb), 6) AS eff_tissue
  FROM (SELECT * REPLACE (CASE WHEN df > 0 THEN df END AS df) FROM tt)""", more=_QR)
def ols_two_factors(spark, sf):
    out = model.summary(_fit(spark, sf, BOTH, model.fit_rows), BOTH)
    return out.select("probe_id", *(r6(c, c.lower()) for c in out.columns if c != "probe_id"))


@query("SELECT probe_id, round(regr_slope(beta, age), 6) AS estimate FROM y GROUP BY 1 HAVING count(*) >= 3 AND var_pop(age) > 0", more=TWO.split("g AS")[0].rstrip().rstrip(","))
def ols_numeric(spark, sf):
    design = model.Design(numeric=["age"])
    coef, _ = model.fit(_effect(spark, sf), a.samples(spark, sf), design)
    return model.coefficients(coef, "age").where("NOT aliased AND df >= 1").select("probe_id", r6("estimate"))


REGION = TWO + """, kn AS (SELECT DISTINCT probe_id FROM effect WHERE beta IS NOT NULL),
pl AS (SELECT p.probe_id, chrom, start, "end", lag(p.probe_id) OVER w AS prev, row_number() OVER w AS ord FROM probes p JOIN kn USING (probe_id) WHERE p.pk % 97 <> 0 WINDOW w AS (PARTITION BY chrom ORDER BY start, "end", p.probe_id)),
ds AS (SELECT pl.*, CASE WHEN prev IS NOT NULL THEN coalesce(d, 0) END AS dist FROM pl LEFT JOIN (SELECT x.probe_id, sum(pow(e1.beta - e2.beta, 2)) AS d FROM pl x JOIN effect e1 ON e1.probe_id = x.probe_id JOIN effect e2 ON e2.probe_id = x.prev AND e2.sample_id = e1.sample_id GROUP BY 1) USING (probe_id)),
sg AS (SELECT *, sum((prev IS NULL OR dist > (SELECT quantile_cont(dist, 0.5) FROM ds))::INT) OVER (PARTITION BY chrom ORDER BY ord ROWS UNBOUNDED PRECEDING)::BIGINT AS seg FROM ds)"""


def _mapped(spark, sf):
    """Coordinates of a manifest that places some probes nowhere."""
    return a.coords(spark, sf).withColumn("chrom", F.when(F.col("probe_ord") % 97 == 0, "*").otherwise(F.col("chrom")))


@query('SELECT probe_id, chrom, start, "end", round(dist, 6) AS dist, seg FROM sg', more=REGION)
def region_segments(spark, sf):
    return model.segments(_effect(spark, sf), _mapped(spark, sf)).select("probe_id", "chrom", "start", "end", r6("dist"), "seg")


@query('SELECT chrom, seg, min(start) AS start, max("end") AS "end", count(*) AS n, round(avg(mm - mf), 6) AS estimate FROM sg JOIN t USING (probe_id) GROUP BY 1, 2', more=REGION)
def regions(spark, sf):
    segs = model.segments(_effect(spark, sf), _mapped(spark, sf))
    out = model.regions(segs, _fit(spark, sf, SEX)[0], "sex_M")
    return out.select("chrom", "seg", "start", "end", "n", r6("estimate"))


@query()
def region_pvalues(spark, sf):
    segs = model.segments(_effect(spark, sf), _mapped(spark, sf))
    return model.regions(segs, _fit(spark, sf, SEX)[0], "sex_M")


@query('SELECT probe_id, chrom, seg, start AS seg_start, "end" AS seg_end, n AS seg_n, round(est, 6) AS seg_estimate, round(mm - mf, 6) AS estimate FROM sg0 JOIN t USING (probe_id)',
       more=REGION + ', sg0 AS (SELECT sg.probe_id, chrom, seg, min(start) OVER w AS start, max("end") OVER w AS "end", count(*) OVER w AS n, avg(mm - mf) OVER w AS est FROM sg JOIN t USING (probe_id) WINDOW w AS (PARTITION BY chrom, seg))')
def region_probes(spark, sf):
    segs, coef = model.segments(_effect(spark, sf), _mapped(spark, sf)), _fit(spark, sf, SEX)[0]
    out = model.region_probes(segs, model.regions(segs, coef, "sex_M"), coef, "sex_M")
    return out.select("probe_id", "chrom", "seg", "seg_start", "seg_end", "seg_n", r6("seg_estimate"), r6("estimate"))


# ---- inference


def _clock(spark, sf):
    pk = F.col("p_partkey")
    return a.table(spark, sf, "part").where(pk % 7 == 0).select(a.probe_name(pk).alias("probe_id"), ((pk % 13 - 6) / 100.0).alias("slope"), F.when(pk % 3 == 0, F.lit(0.5)).alias("na_fallback"))


@query("SELECT sample_id, count(beta) AS n, round(CASE WHEN count(beta) >= 10 THEN sum((pk % 13 - 6) / 100.0 * coalesce(beta, CASE WHEN pk % 3 = 0 THEN 0.5 END)) + 2.5 END, 6) AS age FROM betas WHERE pk % 7 = 0 GROUP BY 1")
def age_clock(spark, sf):
    return infer.predict_age(_betas(spark, sf), _clock(spark, sf), intercept=2.5).select("sample_id", "n", r6("age"))


SIG = """sig AS (SELECT probe_id, pk, 'branch' || (pk % 6) AS branch, ((pk % 21) - 10) / 10.0 AS db FROM probes),
top AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY branch ORDER BY abs(db) DESC, probe_id) AS n FROM sig WHERE abs(db) >= 0.3) WHERE n <= 15),
sc AS (SELECT sample_id, branch, avg(CASE WHEN db < 0 THEN 1 - beta ELSE beta END) AS score FROM betas JOIN top USING (pk) GROUP BY 1, 2)"""


def _tissue(spark, sf):
    pk = F.col("p_partkey")
    sig = a.table(spark, sf, "part").select(a.probe_name(pk).alias("probe_id"), F.concat(F.lit("branch"), (pk % 6).cast("string")).alias("branch"), ((pk % 21 - 10) / 10.0).alias("delta_beta"))
    return infer.tissue_scores(_betas(spark, sf), sig)


@query("SELECT sample_id, branch, round(score, 6) AS score FROM sc", more=SIG)
def tissue_scores(spark, sf):
    return _tissue(spark, sf).select("sample_id", "branch", r6("score"))


@query("""SELECT sample_id, string_agg(branch, ' ' ORDER BY n) AS best FROM (SELECT *, row_number() OVER (PARTITION BY sample_id ORDER BY score DESC, branch) AS n FROM sc) WHERE n <= 2 GROUP BY 1""", more=SIG)
def tissue_best(spark, sf):
    out = infer.best_tissues(_tissue(spark, sf))
    return out.select("sample_id", F.regexp_replace("tissue", r"\[|\]\([-0-9.]+\)", "").alias("best"))


STRAIN = """st AS (SELECT sample_id, 'strain' || s AS strain, sum(-0.5 * pow((((pk + s) % 2) - CASE WHEN pk % 5 = 0 THEN 1 - coalesce(b0, 0.5) ELSE coalesce(b0, 0.5) END) / 0.8, 2) - ln(0.8 * sqrt(2 * pi()))) AS ll
  FROM raw_betas, range(4) r(s) WHERE pk % 4 <> 1 GROUP BY 1, 2)"""


def _strain_likelihood(spark, sf):
    pk, s = F.col("p_partkey"), F.col("s")
    strains = a.table(spark, sf, "part").where(pk % 4 != 1).withColumn("s", F.explode(F.sequence(F.lit(0), F.lit(3))))
    strains = strains.select(a.probe_name(pk).alias("probe_id"), F.concat(F.lit("strain"), s.cast("string")).alias("strain"), ((pk + s) % 2).cast("double").alias("genotype"), (pk % 5 == 0).alias("flip"))
    return infer.strain_likelihood(signal.betas(a.signals(spark, sf), mask=False), strains)


@query("SELECT sample_id, strain, round(1 - 1 / e, 6) AS pval FROM (SELECT *, row_number() OVER (PARTITION BY sample_id ORDER BY ll DESC, strain) AS n, sum(exp(ll - mx)) OVER (PARTITION BY sample_id) AS e FROM (SELECT *, max(ll) OVER (PARTITION BY sample_id) AS mx FROM st)) WHERE n = 1", more=STRAIN)
def strain_call(spark, sf):
    return infer.infer_strain(_strain_likelihood(spark, sf)).select("sample_id", "strain", r6("pval"))


@query("SELECT sample_id, strain, round(ll, 4) AS loglik, round(exp(ll - max(ll) OVER w) / sum(exp(ll - mx)) OVER w, 6) AS prob FROM (SELECT *, max(ll) OVER (PARTITION BY sample_id) AS mx FROM st) WINDOW w AS (PARTITION BY sample_id)", more=STRAIN)
def strain_loglik(spark, sf):
    return _strain_likelihood(spark, sf).select("sample_id", "strain", F.round("loglik", 4).alias("loglik"), r6("prob"))


SPECIES = OOB + """, kp AS (SELECT sample_id, pk, p, probe_id FROM pv JOIN probes USING (probe_id) WHERE p IS NOT NULL),
pn AS (SELECT *, 1 AS y, row_number() OVER (PARTITION BY sample_id ORDER BY p, probe_id) AS n FROM kp WHERE p <= 0.4 UNION ALL SELECT *, 0, row_number() OVER (PARTITION BY sample_id ORDER BY p DESC, probe_id) FROM kp WHERE p >= 0.6),
sz AS (SELECT sample_id, least(count(*) FILTER (y = 1), count(*) FILTER (y = 0), 200) AS k FROM pn GROUP BY 1),
sr AS (SELECT sample_id, k, y, 'species' || s AS species, (pk * (s + 3)) % 60 AS score FROM pn JOIN sz USING (sample_id), range(3) r(s) WHERE n <= k),
rr AS (SELECT *, rank() OVER (PARTITION BY sample_id, species ORDER BY score) + (count(*) OVER (PARTITION BY sample_id, species, score) - 1) / 2.0 AS r FROM sr)"""


@query("SELECT sample_id, species, max(k) AS n, round((sum(r * y) - sum(y) * (sum(y) + 1) / 2) / (sum(y) * sum(1 - y)), 8) AS auc FROM rr GROUP BY 1, 2", more=SPECIES)
def species_auc(spark, sf):
    return _species_auc(spark, sf).select("sample_id", "species", F.col("n").cast("long").alias("n"), F.round("auc", 8).alias("auc"))


def _species_auc(spark, sf):
    pk, s = F.col("p_partkey"), F.col("s")
    scores = a.table(spark, sf, "part").withColumn("s", F.explode(F.sequence(F.lit(0), F.lit(2))))
    scores = scores.select(a.probe_name(pk).alias("probe_id"), F.concat(F.lit("species"), s.cast("string")).alias("species"), ((pk * (s + 3)) % 60).alias("score"))
    return infer.species_auc(_detected(spark, sf), scores, top=200, positive=0.4, negative=0.6)


@query("SELECT r.sample_id, CASE WHEN auc IS NULL OR rate >= 0.95 OR (rate >= 0.8 AND auc < 0.5) THEN 'none' ELSE species END AS species FROM (SELECT sample_id, count(*) FILTER (p <= 0.05) / count(p) AS rate FROM pv GROUP BY 1) r LEFT JOIN (SELECT sample_id, species, round((sum(r * y) - sum(y) * (sum(y) + 1) / 2) / (sum(y) * sum(1 - y)), 8) AS auc FROM rr GROUP BY 1, 2 QUALIFY row_number() OVER (PARTITION BY sample_id ORDER BY auc DESC NULLS LAST, species) = 1) b ON b.sample_id = r.sample_id", more=SPECIES)
def species_call(spark, sf):
    auc = _species_auc(spark, sf).withColumn("auc", F.round("auc", 8))
    return infer.infer_species(auc, _detected(spark, sf), "none")


@query("SELECT probe_id, round(coalesce(beta, avg(beta) OVER (PARTITION BY probe_id)), 6) AS beta, sample_id FROM betas")
def impute_mean_row(spark, sf):
    return infer.impute_mean(_betas(spark, sf).select("sample_id", "probe_id", "beta")).select("probe_id", r6("beta"), "sample_id")


@query("SELECT probe_id, round(coalesce(beta, avg(beta) OVER (PARTITION BY sample_id)), 6) AS beta, sample_id FROM betas")
def impute_mean_col(spark, sf):
    return infer.impute_mean(_betas(spark, sf).select("sample_id", "probe_id", "beta"), "sample_id").select("probe_id", r6("beta"), "sample_id")


IMPUTE = """rf AS (SELECT probe_id, pk, 'cell' || c AS celltype, ((pk * (c + 2)) % 101) / 100.0 AS md, ((pk + c) % 10) / 20.0 AS sd FROM probes, range(3) r(c)),
bc AS (SELECT sample_id, celltype FROM (SELECT sample_id, celltype, row_number() OVER (PARTITION BY sample_id ORDER BY corr(beta, md) DESC, celltype DESC) AS n FROM (SELECT * FROM betas WHERE beta IS NOT NULL) b JOIN rf USING (pk) GROUP BY 1, 2) WHERE n = 1)"""


def _cells(spark, sf, n=3):
    pk, c = F.col("p_partkey"), F.col("c")
    rows = a.table(spark, sf, "part").withColumn("c", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    return rows.select(F.concat(F.lit("cell"), c.cast("string")).alias("celltype"), a.probe_name(pk).alias("probe_id"), ((pk * (c + 2)) % 101 / 100.0).alias("median"), ((pk + c) % 10 / 20.0).alias("sd"))


@query("SELECT b.sample_id, b.probe_id, round(coalesce(beta, CASE WHEN sd <= 0.3 THEN md END), 6) AS beta FROM betas b JOIN bc USING (sample_id) JOIN rf ON rf.pk = b.pk AND rf.celltype = bc.celltype", more=IMPUTE)
def impute_reference(spark, sf):
    out = infer.impute_reference(_betas(spark, sf).select("sample_id", "probe_id", "beta"), _cells(spark, sf), most_sd=0.3)
    return out.select("sample_id", "probe_id", r6("beta"))


MEANS = """gm AS (SELECT probe_id, avg(beta) FILTER (tissue = 't0') AS mi, avg(beta) FILTER (tissue <> 't0') AS mo, count(*) FILTER (tissue = 't0' AND beta IS NULL) AS ai, count(*) FILTER (tissue <> 't0' AND beta IS NULL) AS ao,
  count(*) FILTER (tissue = 't0') AS ni, count(*) FILTER (tissue <> 't0') AS no FROM (SELECT sample_id, probe_id, beta FROM betas) JOIN samples USING (sample_id) GROUP BY 1)"""


def _means(spark, sf):
    return infer.group_means(_betas(spark, sf), a.samples(spark, sf), "tissue", "t0")


@query("SELECT probe_id, round(mi, 6) AS mean_in, round(mo, 6) AS mean_out FROM gm WHERE mi < 0.4 AND mo > 0.5 AND ai <= 0.5 * ni AND ao <= 0.5 * no", more=MEANS)
def signature_u(spark, sf):
    return infer.signature_low(_means(spark, sf), 0.4, 0.5).select("probe_id", r6("mean_in"), r6("mean_out"))


@query("SELECT probe_id, round(mi - mo, 6) AS delta FROM gm WHERE mi IS NOT NULL AND mo IS NOT NULL AND ai <= 0.5 * ni AND ao <= 0.5 * no ORDER BY mi - mo, probe_id LIMIT 100", more=MEANS)
def signature_top(spark, sf):
    return infer.signature_top(_means(spark, sf), 100).select("probe_id", r6("delta"))


def _two_cells(spark, sf):
    two = _cells(spark, sf, 2)
    return two.groupBy("probe_id").agg(F.max(F.when(F.col("celltype") == "cell0", F.col("median"))).alias("a"), F.max(F.when(F.col("celltype") == "cell1", F.col("median"))).alias("b"))


@query("""SELECT probe_id, side FROM (SELECT probe_id, 'high' AS side FROM d2 WHERE d > 0 ORDER BY d DESC, probe_id LIMIT 100) UNION ALL SELECT probe_id, side FROM (SELECT probe_id, 'low' AS side FROM d2 WHERE d < 0 ORDER BY d, probe_id LIMIT 100)""",
       more="d2 AS (SELECT probe_id, ((pk * 2) % 101) / 100.0 - ((pk * 3) % 101) / 100.0 AS d FROM probes)")
def leukocyte_probes(spark, sf):
    ref = _two_cells(spark, sf).withColumns({"a": F.round("a", 2), "b": F.round("b", 2)})
    return infer.two_component_probes(ref.select("probe_id", F.round(F.col("a") - F.col("b"), 2).alias("a"), F.lit(0.0).alias("b")), 100).select("probe_id", "side")


def _mode(values: str) -> str:
    """Modes (k, n, mode) of kernel densities of (k, x) on 512 points."""
    return f"""vals AS ({values}), sp AS (SELECT k, count(*) AS n, min(x) AS lo, max(x) AS hi, stddev_samp(x) AS sd, (quantile_cont(x, 0.75) - quantile_cont(x, 0.25)) / 1.34 AS iq FROM vals GROUP BY 1),
bw AS (SELECT *, 0.9 * coalesce(nullif(least(sd, iq), 0), nullif(sd, 0), nullif(abs(lo), 0), 1) * pow(n, -0.2) AS bw FROM sp),
gr AS (SELECT k, n, bw, lo - 3 * bw + (hi - lo + 6 * bw) * i / 511 AS g FROM bw, range(512) r(i)),
md AS (SELECT k, any_value(n) AS n, arg_max(g, d) AS mode FROM (SELECT gr.k, n, g, sum(exp(-0.5 * pow((g - x) / bw, 2))) AS d FROM gr JOIN vals USING (k) GROUP BY gr.k, n, g) GROUP BY 1)"""


@query("SELECT s.sample_id, CASE WHEN n >= 10 THEN round(greatest(0, least(1, mode)), 6) END AS fraction, n FROM md JOIN (SELECT k, k AS sample_id FROM sp) s USING (k)", more="""lk AS (SELECT pk, probe_id, ((pk * 2) % 101)::DOUBLE / 100 AS a, ((pk * 3) % 101)::DOUBLE / 100 AS b FROM probes),
lp AS (SELECT * FROM (SELECT * FROM lk WHERE a - b > 0 ORDER BY a - b DESC, probe_id LIMIT 1000) UNION ALL SELECT * FROM (SELECT * FROM lk WHERE a - b < 0 ORDER BY a - b, probe_id LIMIT 1000)), """ + _mode("SELECT sample_id AS k, (beta - b) / (a - b) AS x FROM (SELECT pk, sample_id, beta FROM betas) JOIN lp USING (pk) WHERE beta IS NOT NULL"))
def two_component_share(spark, sf):
    out = infer.two_component_fraction(_betas(spark, sf), infer.two_component_probes(_two_cells(spark, sf), 1000))
    return out.select("sample_id", r6("fraction"), "n")


# Leukocyte fractions: markers by the difference of means, a base line by marker from the cohort or 0 and 1.
_LEUKO = """lk AS (SELECT DISTINCT pf, pk, ((pk * 2) % 101)::DOUBLE / 100 AS l FROM pb),
tm AS (SELECT pf, pk, any_value(probe_id) AS probe_id, avg(beta) AS t FROM pb GROUP BY 1, 2),
df AS (SELECT pf, pk, probe_id, l, l - t AS d FROM lk JOIN tm USING (pf, pk) WHERE t IS NOT NULL),
mk AS (SELECT pf, pk, l, 'high' AS side FROM df QUALIFY row_number() OVER (PARTITION BY pf ORDER BY d DESC, probe_id) <= 1000
  UNION ALL SELECT pf, pk, l, 'low' FROM df QUALIFY row_number() OVER (PARTITION BY pf ORDER BY d, probe_id) <= 1000),
nb AS (SELECT pf, count(DISTINCT sample_id) AS samples FROM pb GROUP BY 1),
bd AS (SELECT pf, pk, side, any_value(l) AS l, CASE WHEN any_value(samples) >= 10 THEN CASE side WHEN 'high' THEN min(beta) ELSE max(beta) END WHEN side = 'high' THEN 0.0 ELSE 1.0 END AS t
  FROM mk JOIN pb USING (pf, pk) JOIN nb USING (pf) GROUP BY 1, 2, 3),
"""
_RATIOS = "SELECT sample_id AS k, (beta - t) / (l - t) AS x FROM pb JOIN bd USING (pf, pk) WHERE beta IS NOT NULL AND l <> t"
_FRACTION = "SELECT k AS sample_id, CASE WHEN n >= 10 THEN round(mode, 6) END AS fraction, n FROM md"


def _leukocyte_betas(spark, sf):
    return _cells(spark, sf, 1).select("probe_id", F.col("median").alias("beta"))


@query(_FRACTION, more="pb AS (SELECT '' AS pf, sample_id, pk, probe_id, beta FROM betas), " + _LEUKO + _mode(_RATIOS))
def leukocyte(spark, sf):
    return routing.leukocyte_fraction(_betas(spark, sf), _leukocyte_betas(spark, sf)).select("sample_id", r6("fraction"), "n")


# Samples of three platforms by number: T has the ids as they are, V has ids with a suffix (every seventh twice, the second one's betas turned round), N has ids of its own.
_PLATFORMS = """pb AS (SELECT CASE sid % 3 WHEN 0 THEN 'T' WHEN 1 THEN 'V' ELSE 'N' END AS pf, sample_id, pk, probe_id, beta FROM effect WHERE NOT starts_with(probe_id, 'ctl_'))"""


def _three_platforms(spark, sf):
    """(betas, signatures, mappings) of samples of platforms T, V and N."""
    pk, kind = F.col("p_partkey"), F.substring("sample_id", 2, 2).cast("int") % 3
    twice = (F.col("pk") % 7 == 0) & (kind == 1)
    b = _effect(spark, sf).where("NOT startswith(probe_id, 'ctl_')").withColumn("copy", F.explode(F.when(twice, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))))
    name = F.when(kind == 0, F.col("probe_id")).when(kind == 1, F.concat("probe_id", F.lit("_BC1"), "copy")).otherwise(F.concat(F.lit("n"), "probe_id"))
    b = b.select("sample_id", name.alias("probe_id"), F.when(F.col("copy") == 2, 1 - F.col("beta")).otherwise(F.col("beta")).alias("beta"))
    ids = a.table(spark, sf, "part").select(a.probe_name(pk).alias("id"), pk.alias("pk")).where("NOT startswith(id, 'ctl_')")
    other = F.explode(F.when(F.col("pk") % 7 == 0, F.array(F.lit("_BC11"), F.lit("_BC12"))).otherwise(F.array(F.lit("_BC11"))))
    v = ids.select("id", other.alias("end")).select(F.lit("V").alias("platform"), F.concat("id", "end").alias("probe_id"))
    signatures = ids.select(F.lit("T").alias("platform"), F.col("id").alias("probe_id")).unionByName(v).unionByName(ids.select(F.lit("N").alias("platform"), F.concat(F.lit("n"), "id").alias("probe_id")))
    mappings = infer.lift_ids(v.select("probe_id"), ids.select(F.col("id").alias("probe_id")), prefix_only=True, unique=False).withColumn("platform", F.lit("V"))
    return b, signatures, mappings


@query("SELECT DISTINCT sample_id, pf AS platform FROM pb", more=_PLATFORMS)
def platform_from_ids(spark, sf):
    b, signatures, _ = _three_platforms(spark, sf)
    return routing.platform_from_ids(b, signatures)


@query("SELECT sample_id, pf AS platform, CASE WHEN pf = 'N' THEN 'n' ELSE '' END || probe_id AS probe_id, round(beta, 6) AS beta FROM pb", more=_PLATFORMS)
def lift_platforms(spark, sf):
    b, signatures, mappings = _three_platforms(spark, sf)
    out = routing.lift_to(b, routing.platform_from_ids(b, signatures), mappings, "T", ("N",))
    return out.select("sample_id", "platform", "probe_id", r6("beta"))


@query("SELECT k AS sample_id, round(mode, 6) AS mode, CASE WHEN mode > 0.4 THEN 'MALE' ELSE 'FEMALE' END AS sex FROM md", more=_PLATFORMS + """,
hm AS (SELECT sample_id, avg(beta) AS h FROM pb WHERE pk % 50 = CASE WHEN pf = 'N' THEN 2 ELSE 0 END GROUP BY 1), """ + _mode("SELECT sample_id AS k, h - beta AS x FROM pb JOIN hm USING (sample_id) WHERE pk % 50 = CASE WHEN pf = 'N' THEN 3 ELSE 1 END AND beta IS NOT NULL"))  # fmt: skip
def sex_platforms(spark, sf):
    b, signatures, mappings = _three_platforms(spark, sf)
    pk, parts = F.col("p_partkey"), a.table(spark, sf, "part")
    pick = lambda t, n: parts.where(pk % 50 == t).select(a.probe_name(pk).alias("probe_id")).unionByName(parts.where(pk % 50 == n).select(F.concat(F.lit("n"), a.probe_name(pk)).alias("probe_id")))
    out = routing.sex_by_platform(b, routing.platform_from_ids(b, signatures), mappings, pick(0, 2), pick(1, 3), target="T", native=("N",))
    return out.select("sample_id", r6("mode"), "sex")


@query(_FRACTION, more=_PLATFORMS + ", " + _LEUKO + _mode(_RATIOS))
def leukocyte_platforms(spark, sf):
    b, signatures, mappings = _three_platforms(spark, sf)
    own = routing.platform_from_ids(b, signatures)
    lifted = routing.lift_to(b, own, mappings, "T", ("N",)).select("sample_id", "probe_id", "beta")
    pk = F.col("p_partkey")
    refs = a.table(spark, sf, "part").select(F.explode(F.array(*map(F.lit, "TVN"))).alias("platform"), a.probe_name(pk).alias("id"), ((pk * 2) % 101 / 100.0).alias("beta"))
    refs = refs.select("platform", F.concat(F.when(F.col("platform") == "N", "n").otherwise(""), "id").alias("probe_id"), "beta")
    return routing.leukocyte_fraction(lifted, refs, own).select("sample_id", r6("fraction"), "n")


@query("SELECT k AS sample_id, round(mode, 6) AS mode, CASE WHEN mode > 0 THEN 'MALE' ELSE 'FEMALE' END AS sex FROM md", more=_mode("SELECT sample_id AS k, h - beta AS x FROM (SELECT sample_id, beta FROM effect WHERE pk % 50 = 1 AND beta IS NOT NULL) JOIN (SELECT sample_id, avg(beta) AS h FROM effect WHERE pk % 50 = 0 GROUP BY 1) USING (sample_id)"))
def sex(spark, sf):
    pk = F.col("p_partkey")
    parts = a.table(spark, sf, "part")
    pick = lambda k: parts.where(pk % 50 == k).select(a.probe_name(pk).alias("probe_id"))
    return infer.infer_sex(_effect(spark, sf), pick(0), pick(1), cut=0.0).select("sample_id", r6("mode"), "sex")


@query()
def cell_mix(spark, sf):
    refs = _cells(spark, sf).where("sd < 0.1").select(F.col("celltype").alias("cell"), "probe_id", F.col("median").alias("beta"))
    return infer.cell_mixture(_betas(spark, sf), refs, ["cell0", "cell1", "cell2"])


@query("SELECT sample_id, probe_id, (beta - s >= 0.2)::INT AS state FROM (SELECT sample_id, pk, probe_id, beta FROM betas WHERE beta IS NOT NULL) JOIN (SELECT pk, sum(((pk * (c + 2)) % 101) / 100.0 * (c + 1) / 10) AS s FROM probes, range(3) r(c) GROUP BY 1) USING (pk)")
def unknown_state(spark, sf):
    b = _betas(spark, sf)
    tenths = (("cell0", 1.0), ("cell1", 2.0), ("cell2", 3.0), ("unknown", 4.0))
    parts = F.array(*(F.struct(F.lit(c).alias("cell"), F.lit(v).alias("fraction"), F.lit(10.0).alias("whole")) for c, v in tenths))
    refs = _cells(spark, sf).select(F.col("celltype").alias("cell"), "probe_id", F.col("median").alias("beta"))
    return infer.unknown_state(b, refs, b.select("sample_id").distinct().select("sample_id", F.inline(parts)))


@query("SELECT cell, probe_id, round(md, 6) AS beta FROM (SELECT 'cell' || c AS cell, probe_id, ((pk * (c + 2)) % 101) / 100.0 AS md FROM probes, range(3) r(c) WHERE starts_with(probe_id, 'cg')) x WHERE probe_id IN (SELECT probe_id FROM (SELECT probe_id, ((pk * (c + 2)) % 101) AS v FROM probes, range(3) r(c)) GROUP BY 1 HAVING min(v) <> max(v))")
def reference_cells(spark, sf):
    refs = _cells(spark, sf).select(F.col("celltype").alias("cell"), "probe_id", F.col("median").alias("beta"))
    return infer.differential(infer.reference_set(refs, a.coords(spark, sf))).select("cell", "probe_id", r6("beta"))


LIFT = """src AS (SELECT DISTINCT pfx, pfx || sfx AS id FROM half), tgt AS (SELECT probe_id FROM probes WHERE pk % 3 <> 0),
mp AS (SELECT id_source, id_target FROM (SELECT s.id AS id_source, t.probe_id AS id_target, row_number() OVER (PARTITION BY t.probe_id ORDER BY s.id NULLS LAST) AS n FROM src s RIGHT JOIN tgt t ON split_part(s.id, '_', 1) = split_part(t.probe_id, '_', 1)) WHERE n = 1)"""


def _mapping(spark, sf, **options):
    pk = F.col("p_partkey")
    targets = a.table(spark, sf, "part").where(pk % 3 != 0).select(a.probe_name(pk).alias("probe_id"))
    ids = a.suffixed(a.signals(spark, sf)).select("probe_id").distinct().where("NOT startswith(probe_id, 'ctl_')")
    return infer.lift_ids(ids, targets.where("NOT startswith(probe_id, 'ctl_')"), prefix_only=True, **options)


LIFT = HALF + ", " + LIFT.replace("FROM half)", "FROM half WHERE NOT starts_with(pfx, 'ctl_'))").replace("WHERE pk % 3 <> 0)", "WHERE pk % 3 <> 0 AND NOT starts_with(probe_id, 'ctl_'))")


@query("SELECT id_source, id_target FROM mp", more=LIFT)
def lift_ids(spark, sf):
    return _mapping(spark, sf, include_new=True)


@query("SELECT s.sample_id, mp.id_target AS probe_id, round(h.beta, 6) AS beta FROM mp CROSS JOIN (SELECT DISTINCT sample_id FROM half) s LEFT JOIN half h ON h.pfx || h.sfx = mp.id_source AND h.sample_id = s.sample_id", more=LIFT)
def lift_betas(spark, sf):
    b = signal.betas(a.suffixed(a.signals(spark, sf))).select("sample_id", "probe_id", "beta")
    return infer.lift_betas(b, _mapping(spark, sf, include_new=True)).select("sample_id", "probe_id", r6("beta"))


@query("SELECT s.sample_id, count(*) AS n, sum(coalesce(h.mask, true)::INT)::BIGINT AS n_mask FROM mp CROSS JOIN (SELECT DISTINCT sample_id FROM half) s LEFT JOIN half h ON h.pfx || h.sfx = mp.id_source AND h.sample_id = s.sample_id GROUP BY 1", more=LIFT)
def lift_signals(spark, sf):
    out = infer.lift_signals(a.suffixed(a.signals(spark, sf)).drop("pk"), _mapping(spark, sf, include_new=True))
    return out.groupBy("sample_id").agg(F.count("*").alias("n"), F.count_if("mask").alias("n_mask"))


@query("SELECT sample_id, probe_id, CASE WHEN col <> '2' AND pk % 3 = 0 THEN CASE WHEN pk % 2 = 0 THEN 'G' ELSE 'R' END ELSE col END AS col, mask OR pk % 43 = 0 AS mask FROM signals")
def species_update(spark, sf):
    pk = F.col("p_partkey")
    ref = a.table(spark, sf, "part").select(a.probe_name(pk).alias("probe_id"), F.when(pk % 3 == 0, F.when(pk % 2 == 0, "G").otherwise("R")).alias("col"), (pk % 43 == 0).alias("mask"))
    return infer.update_design(a.signals(spark, sf), ref).select("sample_id", "probe_id", "col", "mask")


# ---- normalisation


def _beads(df):
    return df.select("sample_id", "probe_id", *(r6(c) for c in ("mg", "mr", "ug", "ur")))


@query("""SELECT sample_id, probe_id, """ + ", ".join(f"CASE WHEN {c} IS NOT NULL THEN round(greatest(1, {c} - coalesce({b}, 0)), 6) END AS {c}" for c, b in (("mg", "bg"), ("mr", "br"), ("ug", "bg"), ("ur", "br"))) + """
  FROM signals LEFT JOIN (SELECT sample_id, median(v) FILTER (channel = 'G') AS bg, median(v) FILTER (channel = 'R') AS br FROM (
    SELECT sample_id, 'G' AS channel, unnest([mg, ug]) AS v FROM signals WHERE col = 'R' AND NOT mask UNION ALL SELECT sample_id, 'R', unnest([mr, ur]) FROM signals WHERE col = 'G' AND NOT mask) GROUP BY 1) USING (sample_id)""")
def scrub(spark, sf):
    return _beads(normalize.scrub(a.signals(spark, sf)))


MI = "mi AS (SELECT sample_id, (coalesce(sum(m), 0) + coalesce(sum(u), 0)) / nullif(count(m) + count(u), 0) AS ref FROM mu WHERE NOT mask GROUP BY 1)"
SCALED = "SELECT sample_id, probe_id, round(mg * fg, 6) AS mg, round(mr * fr, 6) AS mr, round(ug * fg, 6) AS ug, round(ur * fr, 6) AS ur FROM signals JOIN fac USING (sample_id)"


@query(SCALED, more=MI + ", fac AS (SELECT sample_id, ref / median(mg) FILTER (col = 'G') AS fg, ref / median(mr) FILTER (col = 'R') AS fr FROM signals JOIN mi USING (sample_id) WHERE col <> '2' AND NOT mask GROUP BY sample_id, ref)")
def dye_linear(spark, sf):
    return _beads(normalize.dye_linear(a.signals(spark, sf)))


CTL = "ctl AS (SELECT sample_id, avg(ug) FILTER (pk % 3 = 1) AS g, avg(ur) FILTER (pk % 3 = 2) AS r FROM signals WHERE pk % 20 = 19 GROUP BY 1)"


@query(SCALED, more=MI + ", " + CTL + ", fac AS (SELECT sample_id, ref / g AS fg, ref / r AS fr FROM ctl JOIN mi USING (sample_id))")
def dye_controls(spark, sf):
    return _beads(normalize.dye_controls(a.signals(spark, sf), a.controls(spark, sf)))


@query(SCALED, more=CTL + ", best AS (SELECT (g + r) / 2 AS ref FROM ctl ORDER BY abs(g / r - 1), sample_id LIMIT 1), fac AS (SELECT sample_id, ref / g AS fg, ref / r AS fr FROM ctl, best)")
def dye_balanced(spark, sf):
    s, c = a.signals(spark, sf), a.controls(spark, sf)
    return _beads(normalize.dye_controls(s, c, normalize.most_balanced(s, c)))


# Huber's location by rounds over all groups: bg is the background of a sample and channel, ib the in-band signal.
_FITS = """nv AS (SELECT * FROM ({values}) WHERE v IS NOT NULL), nn AS (SELECT sample_id, channel, count(*) FILTER (bg AND v > 0) AS n FROM nv GROUP BY 1, 2),
n1 AS (SELECT sample_id, channel, bg, CASE WHEN v = 0 THEN 1 ELSE v END AS v FROM nv),
nq AS (SELECT sample_id, channel, quantile_cont(v, 0.5) + 10 * (quantile_cont(v, 0.75) - quantile_cont(v, 0.25)) AS cap FROM n1 WHERE bg GROUP BY 1, 2),
nk AS (SELECT n1.* FROM n1 LEFT JOIN nq USING (sample_id, channel) WHERE NOT bg OR v < cap),
n0 AS (SELECT sample_id, channel, bg, median(v) AS mu FROM nk GROUP BY 1, 2, 3),
ns AS (SELECT sample_id, channel, bg, mu, 1.4826 * median(abs(v - mu)) AS s FROM nk JOIN n0 USING (sample_id, channel, bg) GROUP BY 1, 2, 3, 4),
hu AS (SELECT 0 AS round, sample_id, channel, bg, mu, s, false AS rests FROM ns WHERE s > 0
  UNION ALL SELECT round + 1, sample_id, channel, bg, CASE WHEN abs(mu - new) < 1e-6 * s THEN mu ELSE new END, s, abs(mu - new) < 1e-6 * s
  FROM (SELECT round, sample_id, channel, bg, mu, s, avg(least(greatest(v, mu - 1.5 * s), mu + 1.5 * s)) AS new FROM hu JOIN nk USING (sample_id, channel, bg) WHERE NOT rests GROUP BY ALL)),
hf AS (SELECT sample_id, channel, max(mu) FILTER (bg) AS mu, max(s) FILTER (bg) AS sigma, max(mu) FILTER (NOT bg) AS ins FROM hu WHERE rests GROUP BY 1, 2),
fits AS (SELECT sample_id, channel, CASE WHEN ok THEN mu END AS mu, CASE WHEN ok THEN sigma END AS sigma, CASE WHEN ok THEN greatest(ins - mu, 10) END AS alpha, n
  FROM (SELECT *, n >= 100 AND mu IS NOT NULL AND ins IS NOT NULL AS ok FROM nn LEFT JOIN hf USING (sample_id, channel)))"""
# Background and in-band values of the probes that are kept, by channel.
_VALUES = """SELECT sample_id, channel, v, false AS bg FROM (SELECT sample_id, pk, unnest(CASE col WHEN 'G' THEN [{{'channel': 'G', 'v': mg}}, {{'channel': 'G', 'v': ug}}] WHEN 'R' THEN [{{'channel': 'R', 'v': mr}}, {{'channel': 'R', 'v': ur}}]
  ELSE [{{'channel': 'G', 'v': ug}}, {{'channel': 'R', 'v': ur}}] END, recursive := true) FROM signals WHERE {keep})
UNION ALL SELECT sample_id, channel, v, true FROM (SELECT sample_id, unnest(CASE col WHEN 'G' THEN [{{'channel': 'R', 'v': mr}}, {{'channel': 'R', 'v': ur}}] ELSE [{{'channel': 'G', 'v': mg}}, {{'channel': 'G', 'v': ug}}] END, recursive := true) FROM signals WHERE col <> '2' AND {keep})"""
_NEGATIVE = " UNION ALL SELECT sample_id, channel, v, true FROM (SELECT sample_id, unnest([{'channel': 'G', 'v': ug}, {'channel': 'R', 'v': ur}], recursive := true) FROM signals WHERE pk % 20 = 19 AND pk % 3 = 0)"
_NOOB = _FITS.replace("{values}", _VALUES.format(keep="pk % 41 <> 0") + _NEGATIVE)
_SOFT = _FITS.replace("{values}", _VALUES.format(keep="NOT mask"))


def _corrected(offset: int) -> tuple[str, str]:
    """(query, table expressions) of signals under normal-exponential correction."""
    fit = {c: [f"{n}_{k.lower()}" for n in ("mu", "sigma", "alpha")] for c, k in normalize.CHANNELS.items()}
    wide = ", ".join(f"max({n}) FILTER (channel = '{k.upper()}') AS {n}_{k}" for n in ("mu", "sigma", "alpha") for k in "gr")
    place = ", ".join(f"{normal.standardised(c, *f)} AS y_{c}" for c, f in fit.items())
    out = ", ".join(f"round(CASE WHEN mu_g IS NOT NULL AND mu_r IS NOT NULL AND {c} IS NOT NULL THEN {normal.expected_signal(c, *f, f'y_{c}')} + {offset} ELSE {c} END, 4) AS {c}" for c, f in fit.items())
    return f"SELECT sample_id, probe_id, {out} FROM nz", f", fw AS (SELECT sample_id, {wide} FROM fits GROUP BY 1), nz AS (SELECT *, {place} FROM signals LEFT JOIN fw USING (sample_id))"


def _beads4(df):
    return df.select("sample_id", "probe_id", *(F.round(c, 4).alias(c) for c in ("mg", "mr", "ug", "ur")))


@query("SELECT sample_id, channel, round(mu, 4) AS mu, round(sigma, 4) AS sigma, round(alpha, 4) AS alpha, n FROM fits", more=_NOOB)
def noob_fits(spark, sf):
    fits = normalize.noob_fits(a.signals(spark, sf), masks.nonunique_probes(a.mask_members(spark, sf)), a.controls(spark, sf))
    return fits.select("sample_id", "channel", *(F.round(c, 4).alias(c) for c in ("mu", "sigma", "alpha")), "n")


@query(_corrected(15)[0], more=_NOOB + _corrected(15)[1])
def noob(spark, sf):
    return _beads4(normalize.noob(a.signals(spark, sf), masks.nonunique_probes(a.mask_members(spark, sf)), a.controls(spark, sf)))


@query(_corrected(0)[0], more=_SOFT + _corrected(0)[1])
def scrub_soft(spark, sf):
    return _beads4(normalize.scrub_soft(a.signals(spark, sf)))


# Each channel's values move halfway to the other's quantile of the same mean rank; what lies between, by lines.
CURVE = DYE + """, ls AS (SELECT sample_id, channel, list(v ORDER BY v) AS l FROM ib WHERE v IS NOT NULL GROUP BY 1, 2),
ow AS (SELECT sample_id, channel, v, count(*) AS c, sum(count(*)) OVER w - count(*) AS below, sum(count(*)) OVER (PARTITION BY sample_id, channel) AS n FROM ib WHERE v IS NOT NULL GROUP BY 1, 2, 3 WINDOW w AS (PARTITION BY sample_id, channel ORDER BY v)),
ps AS (SELECT ow.*, l, (below + (c - 1) / 2) / greatest(n - 1, 1) * (len(l) - 1) AS p FROM ow JOIN ls ON ls.sample_id = ow.sample_id AND ls.channel <> ow.channel),
kn AS (SELECT sample_id, channel, v AS x, (v + l[floor(p)::INT + 1] + (p - floor(p)) * (l[least(floor(p)::INT + 2, len(l))] - l[floor(p)::INT + 1])) / 2 AS y FROM ps),
kp AS (SELECT *, lead(x) OVER w AS x1, lead(y) OVER w AS y1 FROM kn WINDOW w AS (PARTITION BY sample_id, channel ORDER BY x)),
ed AS (SELECT sample_id, channel, min(x) AS lo, max(x) AS hi, min(y) AS ylo, max(y) AS yhi FROM kn GROUP BY 1, 2),
rd AS (SELECT sample_id, pk, probe_id, bead, CASE WHEN bead IN ('mg', 'ug') THEN 'G' ELSE 'R' END AS channel, v FROM signals UNPIVOT (v FOR bead IN (mg, mr, ug, ur))),
nv AS (SELECT r.sample_id, r.probe_id, bead, CASE WHEN v > hi THEN v - hi + yhi WHEN v < lo THEN ylo / lo * v WHEN x1 IS NULL THEN y ELSE y + (y1 - y) * (v - x) / (x1 - x) END AS v FROM rd r JOIN ed ON ed.sample_id = r.sample_id AND ed.channel = r.channel ASOF LEFT JOIN kp k ON k.sample_id = r.sample_id AND k.channel = r.channel AND r.v >= k.x),
wd AS (SELECT sample_id, probe_id, """ + ", ".join(f"max(v) FILTER (bead = '{c}') AS {c}" for c in ("mg", "mr", "ug", "ur")) + """ FROM nv GROUP BY 1, 2)"""


@query("SELECT s.sample_id, s.probe_id, " + ", ".join(f"round(CASE WHEN ok THEN w.{c} ELSE s.{c} END, 6) AS {c}" for c in ("mg", "mr", "ug", "ur")) + " FROM signals s LEFT JOIN wd w ON w.sample_id = s.sample_id AND w.probe_id = s.probe_id LEFT JOIN (SELECT sample_id, coalesce((topr / topg) / (medr / medg) <= 10, false) AS ok FROM dye) d ON d.sample_id = s.sample_id", more=CURVE)
def dye_nonlinear(spark, sf):
    return _beads(normalize.dye_nonlinear(a.signals(spark, sf)))


@query()
def match_design(spark, sf):
    return _beads(normalize.match_design(a.signals(spark, sf)))


@query()
def prepared_betas(spark, sf):
    """The default preparation, end to end, over all samples in one plan."""
    ref = prep.Reference(a.mask_members(spark, sf), a.controls(spark, sf))
    return prep.run(a.signals(spark, sf), "QCDPB", reference=ref).select("sample_id", "probe_id", "beta")


# ---- sources and sinks

RAW = """rawm AS (SELECT probe_id, pk, CASE WHEN pk % 17 <> 0 THEN 20 + pk % 40 END AS as_a, CASE WHEN pk % 10 < 4 THEN 30 + pk % 30 END AS as_b, (pk * 7) % 60 AS q_a, CASE WHEN pk % 10 < 4 THEN (pk * 3) % 60 END AS q_b,
  CASE WHEN pk % 23 = 0 THEN 'CA' ELSE 'CG' END AS target FROM probes),
un AS (SELECT *, as_a IS NULL OR coalesce(as_a < 35, false) OR coalesce(as_b < 35, false) AS unmapped FROM rawm)"""


def _raw_manifest(spark, sf):
    pk = F.col("p_partkey")
    one = pk % 10 < 4
    known = {
        "Probe_ID": a.probe_name(pk), "mapAS_A": F.when(pk % 17 != 0, 20 + pk % 40), "mapAS_B": F.when(one, 30 + pk % 30), "mapQ_A": (pk * 7) % 60, "mapQ_B": F.when(one, (pk * 3) % 60),
        "target": F.when(pk % 23 == 0, "CA").otherwise("CG"), "address_A": 2 * pk, "address_B": F.when(one, 2 * pk + 1), "channel": F.when(one, a.design(pk)),
        "CpG_chrm": F.when(pk % 29 == 0, "weird_1").otherwise(F.concat(F.lit("chr"), (pk % 5 + 1).cast("string"))), "CpG_beg": 1000 + 137 * pk, "CpG_end": 1002 + 137 * pk, "mapFlag_A": F.when(pk % 2 == 0, 0).otherwise(16),
    }
    fields = [f.split() for f in tables.MANIFEST.split(", ")]
    return a.table(spark, sf, "part").select(*((known.get(n, F.lit(None))).cast(t).alias(n) for n, t in fields))


@query("""SELECT probe_id, unmapped, NOT unmapped AND (q_a = 0 OR coalesce(q_b = 0, false)) AS nonunique, NOT unmapped AND target <> 'CG' AND starts_with(probe_id, 'cg') AS missing_target,
  q_a < 30 OR coalesce(q_b < 30, false) AS low_mapq, starts_with(probe_id, 'ctl') AS control FROM un""", more=RAW)
def manifest_masks(spark, sf):
    m = tables.mapping_masks(_raw_manifest(spark, sf))
    return m.select(F.col("Probe_ID").alias("probe_id"), "unmapped", "nonunique", "missing_target", "low_mapq", "control")


@query("SELECT probe_id, CASE WHEN pk % 10 < 4 THEN 2 * pk + 1 END AS addr_m, 2 * pk AS addr_u, CASE WHEN pk % 10 < 2 THEN 'G' WHEN pk % 10 < 4 THEN 'R' END AS col, unmapped OR (NOT unmapped AND target <> 'CG' AND starts_with(probe_id, 'cg')) AS mask FROM un", more=RAW)
def address_table(spark, sf):
    out = tables.address_table(_raw_manifest(spark, sf))
    return out.select("probe_id", F.col("addr_m").cast("long").alias("addr_m"), F.col("addr_u").cast("long").alias("addr_u"), "col", "mask")


@query("""SELECT probe_id, CASE WHEN pk % 29 = 0 THEN '*' ELSE chrom END AS chrom, CASE WHEN pk % 29 = 0 THEN -1 ELSE 1001 + 137 * pk END AS start, CASE WHEN pk % 29 = 0 THEN 0 ELSE 1002 + 137 * pk END AS "end",
  CASE WHEN pk % 29 = 0 THEN '*' WHEN pk % 2 = 0 THEN '+' ELSE '-' END AS strand, CASE WHEN pk % 29 = 0 THEN 9999 ELSE pk % 5 + 1 END AS chrom_ord FROM probes""")
def manifest_ranges(spark, sf):
    out = tables.manifest_ranges(_raw_manifest(spark, sf))
    return out.select("probe_id", "chrom", F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end"), "strand", F.col("chrom_ord").cast("long").alias("chrom_ord"))


@query("""SELECT sample_id, chrom AS chrm, start - 1 AS beg, "end", p.probe_id AS name, coalesce(floor(beta * 1000)::INT, 0) AS score, strand, start - 1 AS thick_start, "end" AS thick_end,
  CASE WHEN beta IS NULL THEN '0,0,0' WHEN beta < 0.3 THEN '0,0,255' WHEN beta > 0.7 THEN '255,0,0' ELSE '50,150,0' END AS item_rgb FROM probes p JOIN (SELECT pk, sample_id, beta FROM betas) b USING (pk)""")
def bed_track(spark, sf):
    return tables.bed_track(_betas(spark, sf), a.coords(spark, sf))


VCF = AF + """, snp AS (SELECT pk, probe_id, CASE WHEN pk % 40 < 20 THEN 'ALT' ELSE 'REF_InfI' END AS u0 FROM probes WHERE starts_with(probe_id, 'rs')),
vf AS (SELECT b.sample_id, b.probe_id, CASE WHEN b.col <> '2' THEN a.af WHEN u0 = 'ALT' THEN 1 - b0 ELSE b0 END AS v0, CASE WHEN u0 = 'ALT' THEN 1 - b0 WHEN u0 = 'REF_InfI' THEN a.af ELSE b0 END AS vaf
  FROM raw_betas b JOIN snp ON snp.pk = b.pk LEFT JOIN af a ON a.pk = b.pk AND a.sample_id = b.sample_id)"""


def _snps(spark, sf):
    pk = F.col("p_partkey")
    rows = a.table(spark, sf, "part").where(pk % 20 == 18)
    return rows.select(
        a.probe_name(pk).alias("probe_id"), F.concat(F.lit("chr"), (pk % 5 + 1).cast("string")).alias("chrm"), (1001 + 137 * pk).alias("pos"), F.lit("A").alias("ref"),
        F.when(pk % 3 == 0, "ACT").otherwise("G").alias("alt"), F.when(pk % 40 < 20, "ALT").otherwise("REF_InfI").alias("u"),
    )


@query("SELECT sample_id, probe_id, round(vaf, 6) AS vaf FROM vf", more=VCF)
def variant_frequency(spark, sf):
    s = a.signals(spark, sf)
    out = tables.variant_frequency(_snps(spark, sf), signal.betas(s, mask=False), signal.type_one_af(s))
    return out.select("sample_id", "probe_id", r6("vaf"))


@query("""SELECT v.sample_id, p.chrom AS chrm, 1001 + 137 * p.pk AS pos, '.' AS id, 'A' AS ref, CASE WHEN p.pk % 3 = 0 THEN 'H' ELSE 'G' END AS alt, gt, CASE WHEN vaf IS NOT NULL THEN v.probe_id END AS named
  FROM vf v JOIN probes p USING (probe_id) LEFT JOIN (SELECT sample_id, probe_id, CASE WHEN l0 >= l1 AND l0 >= l2 THEN '0/0' WHEN l1 >= l2 THEN '0/1' ELSE '1/1' END AS gt FROM (
    SELECT *, k * ln(0.1) + (40 - k) * ln(0.9) AS l0, 40 * ln(0.5) AS l1, k * ln(0.9) + (40 - k) * ln(0.1) AS l2 FROM (SELECT *, round(vaf * 40) AS k FROM vf WHERE vaf IS NOT NULL))) g ON g.sample_id = v.sample_id AND g.probe_id = v.probe_id""", more=VCF)
def vcf_lines(spark, sf):
    s = a.signals(spark, sf)
    out = tables.vcf_lines(_snps(spark, sf), signal.betas(s, mask=False), signal.type_one_af(s))
    part = lambda n: F.nullif(F.regexp_extract("info", n + "=([^;]+)", 1), F.lit(""))
    return out.select("sample_id", "chrm", "pos", "id", "ref", "alt", part("GT").alias("gt"), part("Probe_ID").alias("named"))


def _bead_list(spark, sf):
    """(sample_id, address, g, r) of all readings."""
    s = a.signals(spark, sf).where("ug IS NOT NULL")
    two = F.array(F.struct((2 * F.col("pk")).alias("address"), F.col("ug").alias("g"), F.col("ur").alias("r")), F.struct((2 * F.col("pk") + 1).alias("address"), F.col("mg").alias("g"), F.col("mr").alias("r")))
    return s.select("sample_id", F.inline(two)).where("g IS NOT NULL").withColumn("address", F.col("address").cast("int"))


def _idat_files(spark, sf):
    """(prefix, channel, content): the readings as scanner files, a file a sample and channel."""
    long = _bead_list(spark, sf).select("sample_id", "address", F.inline(F.array(*(F.struct(F.lit(n).alias("channel"), F.col(c).alias("v")) for n, c in (("Grn", "g"), ("Red", "r"))))))

    def build(key, beads):
        address, v = (beads[c].to_numpy() for c in ("address", "v"))
        order = np.argsort(address, kind="stable")
        content = idat.build(address[order], v[order], np.full(len(order), 9, np.uint8))
        return pa.table({"prefix": pa.array([key[0].as_py()], pa.string()), "channel": pa.array([key[1].as_py()], pa.string()), "content": pa.array([content], pa.binary())})

    return long.groupBy("sample_id", "channel").applyInArrow(build, "prefix string, channel string, content binary")


@query("SELECT sample_id, probe_id, mg, mr, ug, ur, col, mask OR ug IS NULL AS mask FROM signals")
def idat_signals(spark, sf):
    """Scanner files of every sample, read back to signals by the platform given for all."""
    beads = idat.pair_beads(_idat_files(spark, sf))
    return idat.to_signals(beads, a.manifest(spark, sf).drop("probe_ord"), platforms=idat.sample_platforms(beads, platform="TP"))


def _written(spark, files, name):
    """The folder of files (path, content), written by the data source."""
    folder = shared_path(spark, name)
    files.write.format("idat").mode("append").save(folder)
    return folder


def _without_ids(spark, sf, seed):
    """(folder of de-identified files, secret addresses): the beads of the rs probes are secret."""
    idat_source.register(spark)
    rs = a.manifest(spark, sf).where("startswith(probe_id, 'rs')")
    secret = [r[0] for r in rs.select(F.explode(F.array_compact(F.array("addr_m", "addr_u")))).collect()]  # the array's SNP beads
    files = _idat_files(spark, sf).select(F.concat("prefix", F.lit("_"), "channel", F.lit(".idat")).alias("path"), "content")
    return _written(spark, idat.deidentify(files, secret, seed), "idat-noid"), secret


@query("SELECT sample_id || '_noid' AS sample_id, probe_id, CASE WHEN NOT starts_with(probe_id, 'rs') THEN mg ELSE mg * 0 END AS mg, CASE WHEN NOT starts_with(probe_id, 'rs') THEN mr ELSE mr * 0 END AS mr, CASE WHEN NOT starts_with(probe_id, 'rs') THEN ug ELSE ug * 0 END AS ug, CASE WHEN NOT starts_with(probe_id, 'rs') THEN ur ELSE ur * 0 END AS ur, col, mask OR ug IS NULL AS mask FROM signals")
def idat_deidentified(spark, sf):
    """Scanner files with the SNP beads zeroed, written and read by the data source."""
    folder, _ = _without_ids(spark, sf, None)
    beads = spark.read.format("idat").load(folder)
    return idat.to_signals(beads, a.manifest(spark, sf).drop("probe_ord"), platforms=idat.sample_platforms(beads, platform="TP"))


@query("SELECT sample_id, probe_id, mg, mr, ug, ur, col, mask OR ug IS NULL AS mask FROM signals")
def idat_reidentified(spark, sf):
    """De-identified with a secret seed, written, read, re-identified, written and read: the signals as they were."""
    folder, secret = _without_ids(spark, sf, 20)
    mixed = spark.read.format("binaryFile").load(folder).select("path", "content")
    back = idat.deidentify(mixed, secret, 20, undo=True).withColumn("path", F.regexp_replace("path", "_noid_", "_"))
    beads = spark.read.format("idat").load(_written(spark, back, "idat-reid"))
    return idat.to_signals(beads, a.manifest(spark, sf).drop("probe_ord"), platforms=idat.sample_platforms(beads, platform="TP"))


@query("""SELECT sample_id, CASE WHEN n >= 50 THEN platform END AS platform FROM (SELECT sample_id, platform, count(*) AS n, row_number() OVER (PARTITION BY sample_id ORDER BY count(*) DESC, platform DESC) AS i FROM signals JOIN (
  SELECT pk, 'P' || pk % 3 AS platform FROM probes UNION ALL SELECT pk, 'small' FROM probes WHERE pk <= 50) USING (pk) WHERE ug IS NOT NULL GROUP BY 1, 2) WHERE i = 1""")
def platform_call(spark, sf):
    pk = F.col("p_partkey")
    parts = a.table(spark, sf, "part")
    marks = parts.select(F.concat(F.lit("P"), (pk % 3).cast("string")).alias("platform"), (2 * pk).alias("address")).unionByName(parts.where(pk <= 50).select(F.lit("small").alias("platform"), (2 * pk).alias("address")))
    return idat.sample_platforms(_bead_list(spark, sf), marks)


@query("SELECT sample_id, probe_id, round(beta, 6) AS beta FROM betas WHERE sample_id IN ('s01', 's02') AND pk IN (SELECT pk FROM probes WHERE p_size <= 10)")
def file_slice(spark, sf):
    store = _betas(spark, sf).select("sample_id", "probe_id", "beta")
    return tables.slice_file_set(store, ["s01", "s02"], a.query_set(spark, sf), most=None).select("sample_id", "probe_id", r6("beta"))


# ---- tables behind plots


@query("SELECT dbname, round(-log10(fdr), 6) AS neg_log10_fdr FROM bh WHERE ndq > 0 ORDER BY fdr, abs(log2((ndq::DOUBLE * (nu - nq - nd + ndq)) / ((nq - ndq)::DOUBLE * (nd - ndq)))) DESC, dbname LIMIT 10", more=COUNTS + _fisher(_tail("ndq", "hi")))
def plot_enrich_frame(spark, sf):
    results = sets.enrich(a.query_set(spark, sf), _brands(spark, sf), _universe(spark, sf)).withColumn("fdr", F.round("fdr", 9))
    return frames.enrichment_frame(results, 10).select("dbname", r6("neg_log10_fdr"))


@query("SELECT dbname, round(avg(v), 6) AS mean, round(avg(v) - stddev_samp(v), 6) AS low, round(avg(v) + stddev_samp(v), 6) AS high FROM (SELECT sample_id, p_brand AS dbname, avg(beta) AS v FROM (SELECT sample_id, pk, beta FROM betas) JOIN probes USING (pk) GROUP BY 1, 2) GROUP BY 1")
def plot_point_range(spark, sf):
    out = frames.point_range(sets.set_statistics(_betas(spark, sf), _brands(spark, sf)))
    return out.select("dbname", r6("mean"), r6("low"), r6("high"))


@query('SELECT probe_id, chrom, start + off AS x, price AS value FROM probes JOIN (SELECT chrom, coalesce(sum(l) OVER (ORDER BY chrom ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS off FROM (SELECT chrom, max("end") AS l FROM probes GROUP BY 1)) USING (chrom)')
def plot_manhattan(spark, sf):
    return frames.manhattan(a.set_members(spark, sf).where("group = 'price'").select("probe_id", "value"), a.coords(spark, sf))


@query("""SELECT probe_id, start, round(max(beta) FILTER (sample_id = 's01'), 6) AS s01, round(max(beta) FILTER (sample_id = 's02'), 6) AS s02 FROM betas b JOIN (SELECT pk, start FROM probes WHERE chrom = 'chr2' AND start <= 20000 AND "end" >= 5000) USING (pk) GROUP BY 1, 2""")
def region_matrix(spark, sf):
    out = frames.region_matrix(_betas(spark, sf), a.coords(spark, sf), "chr2", 5000, 20000, ["s01", "s02"])
    return out.select("probe_id", "start", r6("s01"), r6("s02"))


@query("SELECT sample_id, col AS design, least(floor(beta * 20), 19)::INT AS bin, count(*) AS n FROM betas WHERE beta IS NOT NULL GROUP BY 1, 2, 3")
def plot_beta_design(spark, sf):
    return frames.beta_histogram(a.signals(spark, sf))


@query("SELECT sample_id, least(floor(b0 * 20), 19)::INT AS bin, count(*) AS n, round(avg(m + u), 6) AS mean_total FROM raw_betas WHERE b0 IS NOT NULL GROUP BY 1, 2")
def plot_intensity_beta(spark, sf):
    return frames.intensity_by_beta(a.signals(spark, sf)).select("sample_id", "bin", "n", r6("mean_total"))


@query("""SELECT sample_id, unnest(QS)::DOUBLE AS q, round(unnest(quantile_cont(v, QS) FILTER (col = 'R')), 6) AS red, round(unnest(quantile_cont(v, QS) FILTER (col = 'G')), 6) AS green FROM (
  SELECT sample_id, col, unnest(CASE col WHEN 'G' THEN [mg, ug] ELSE [mr, ur] END) AS v FROM signals WHERE col <> '2') GROUP BY 1""".replace("QS", "[0.0, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1.0]"))
def plot_red_green(spark, sf):
    return frames.red_green_quantiles(a.signals(spark, sf)).select("sample_id", "q", r6("red"), r6("green"))


@query("SELECT sample_id, probe_id, round(af, 6) AS af FROM x WHERE probe_id IN (SELECT probe_id FROM x GROUP BY 1 HAVING max(af) - min(af) > 0.3)", more=AF + ", x AS (SELECT * FROM (SELECT sample_id, probe_id, af FROM af UNION ALL SELECT sample_id, probe_id, b0 FROM raw_betas WHERE starts_with(probe_id, 'rs')) WHERE starts_with(probe_id, 'rs'))")
def plot_snps(spark, sf):
    return frames.variable_snps(a.signals(spark, sf)).select("sample_id", "probe_id", r6("af"))


@query("SELECT sample_id, p_type AS bin, round(avg(beta), 6) AS beta FROM (SELECT sample_id, pk, beta FROM betas) JOIN probes USING (pk) GROUP BY 1, 2")
def plot_metagene(spark, sf):
    return frames.metagene(_betas(spark, sf), a.set_members(spark, sf).where("group = 'type'")).select("sample_id", "bin", r6("beta"))


@query("SELECT probe_id, 'strain' || s AS strain, (CASE WHEN (pk % 5 = 0) <> (pk % 7 = 0) THEN 1 - (pk + s) % 2 ELSE (pk + s) % 2 END)::DOUBLE AS genotype FROM probes, range(3) r(s)")
def strain_heat(spark, sf):
    pk, s = F.col("p_partkey"), F.col("s")
    rows = a.table(spark, sf, "part").withColumn("s", F.explode(F.sequence(F.lit(0), F.lit(2))))
    ref = rows.select(a.probe_name(pk).alias("probe_id"), F.concat(F.lit("strain"), s.cast("string")).alias("strain"), ((pk + s) % 2).cast("double").alias("genotype"), (pk % 5 == 0).alias("flip_to_af"), (pk % 7 == 0).alias("flip_for_ref_bias"))
    return frames.reference_heat(ref)


@query("SELECT sample_id, CASE WHEN pk % 3 = 0 THEN 'negative' WHEN pk % 3 = 1 THEN 'norm_c' ELSE 'norm_t' END AS type, count(*) AS n, round(avg(ug), 6) AS g, round(avg(ur), 6) AS r FROM signals WHERE pk % 20 = 19 GROUP BY 1, 2")
def control_summary(spark, sf):
    rows = masks.control_rows(a.signals(spark, sf), a.controls(spark, sf))
    return rows.groupBy("sample_id", "type").agg(F.count("*").alias("n"), r6(F.avg("ug"), "g"), r6(F.avg("ur"), "r"))


@query("SELECT s.sample_id, t.probe_id, round(avg(beta), 6) AS beta FROM (SELECT probe_id FROM probes WHERE pk % 3 = 1 AND NOT starts_with(probe_id, 'ctl_')) t CROSS JOIN (SELECT DISTINCT sample_id FROM half) s LEFT JOIN half h ON h.pfx = t.probe_id AND h.sample_id = s.sample_id GROUP BY 1, 2", more=HALF)
def reindex_by_prefix(spark, sf):
    pk = F.col("p_partkey")
    targets = a.table(spark, sf, "part").where((pk % 3 == 1) & (pk % 20 != 19)).select(a.probe_name(pk).alias("probe_id"))
    return infer.reindex_by_prefix(signal.betas(a.suffixed(a.signals(spark, sf))), targets).select("sample_id", "probe_id", r6("beta"))


@query("""SELECT dbname, "group", off + row_number() OVER (PARTITION BY "group" ORDER BY p, dbname) AS x FROM (
  SELECT *, CASE "group" WHEN 'brand' THEN 0 ELSE (SELECT count(DISTINCT p_brand) FROM probes) END AS off FROM (
  SELECT 'brand' AS "group", p_brand AS dbname, avg(price) AS p FROM probes GROUP BY 2 UNION ALL SELECT 'type', p_type, avg(price) FROM probes GROUP BY 2))""")
def plot_enrich_all(spark, sf):
    rows = a.table(spark, sf, "part")
    one = lambda g, c: rows.groupBy(F.col(c).alias("dbname")).agg(F.avg("p_retailprice").alias("fdr")).withColumns({"group": F.lit(g), "estimate": F.lit(1.0)})
    return frames.enrich_all_frame(one("brand", "p_brand").unionByName(one("type", "p_type")), most_fdr=1e9).select("dbname", "group", F.col("x").cast("long").alias("x"))


@query("SELECT sample_id, 'n_green' AS metric, count(*) FILTER (col = 'G')::DOUBLE AS value FROM signals GROUP BY 1 UNION ALL SELECT sample_id, 'n_red', count(*) FILTER (col = 'R')::DOUBLE FROM signals GROUP BY 1")
def plot_metric_bars(spark, sf):
    stats = a.signals(spark, sf).groupBy("sample_id").agg(F.count_if(F.col("col") == "G").alias("n_green"), F.count_if(F.col("col") == "R").alias("n_red"))
    return frames.metric_bars(stats, ["n_green", "n_red"])


@query('SELECT chrom, min(start) - 1000 AS start, max("end") + 1000 AS "end" FROM probes WHERE p_size <= 10 GROUP BY 1')
def probe_window(spark, sf):
    return frames.probe_window(a.coords(spark, sf), a.query_set(spark, sf))


@query("SELECT dbname, place, round(k / m - (place - k) / (n - m), 6) AS score FROM (SELECT dbname, place, n, m, row_number() OVER (PARTITION BY dbname ORDER BY place) AS k FROM (SELECT p_brand AS dbname, row_number() OVER (ORDER BY price, probe_id) AS place, count(*) OVER () AS n, count(*) OVER (PARTITION BY p_brand) AS m FROM probes))")
def plot_score_curve(spark, sf):
    values = a.set_members(spark, sf).where("group = 'price'").select("probe_id", "value")
    return frames.score_curve(values, _brands(spark, sf)).select("dbname", F.col("at").alias("place"), r6("score"))


@query('SELECT gene, chrom, start - CASE WHEN strand = \'+\' THEN 2000 ELSE 1500 END AS start, "end" + CASE WHEN strand = \'+\' THEN 1500 ELSE 2000 END AS "end" FROM genes')
def gene_windows(spark, sf):
    return frames.gene_windows(a.genes(spark, sf), 2000, 1500)


@query('SELECT gene, p.probe_id FROM genes g JOIN probes p ON p.chrom = g.chrom AND p.start BETWEEN g.start - 2000 AND g."end" + 2000 AND g.strand = p.strand')
def stranded_overlap(spark, sf):
    wide = a.genes(spark, sf).select("gene", "chrom", F.col("strand").alias("gs"), (F.col("start") - 2000).alias("start"), (F.col("end") + 2000).alias("end"))
    points = a.coords(spark, sf).select("chrom", "start", F.col("start").alias("end"), "probe_id", "strand")
    return ranges.overlap_join(wide, points).where("gs = strand").select("gene", "probe_id")


@query("SELECT probe_id, side FROM (SELECT probe_id, CASE WHEN a > 0.7 AND b < 0.3 THEN 'high' WHEN a < 0.3 AND b > 0.7 THEN 'low' END AS side FROM (SELECT probe_id, ((pk * 2) % 101) / 100.0 AS a, ((pk * 3) % 101) / 100.0 AS b FROM probes)) WHERE side IS NOT NULL")
def two_component_strict(spark, sf):
    return infer.two_component_strict(_two_cells(spark, sf)).select("probe_id", "side")
