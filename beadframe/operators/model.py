"""Per-probe linear models from sufficient statistics, hold-out F-tests, and regions.

A model is a formula over sample covariates. Each sample's design row is joined to its
betas; one aggregation a probe sums x'x, x'y and y'y on the JVM, and an Arrow stage
solves the small systems, a batch of probes at once. No probe's rows are ever gathered.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions.joins import small_side
from ..functions.stats import f_upper, normal_cdf, normal_quantile, t_two_sided
from ..functions.windows import benjamini_hochberg


@dataclass
class Design:
    """Covariates of a model; factors list their levels, the first is the reference."""

    numeric: list[str] = field(default_factory=list)
    factors: dict[str, list[str]] = field(default_factory=dict)

    @property
    def terms(self) -> list[str]:
        return ["intercept", *self.numeric, *(f"{f}_{v}" for f, levels in self.factors.items() for v in levels[1:])]

    def contrast(self, factor: str) -> list[int]:
        return [i for i, t in enumerate(self.terms) if t in {f"{factor}_{v}" for v in self.factors[factor][1:]}]

    def columns(self, samples: DataFrame) -> DataFrame:
        """(sample_id, x): design rows; samples with a missing covariate are left out."""
        x = [F.lit(1.0), *(F.col(c).cast("double") for c in self.numeric)]
        x += [(F.col(f) == v).cast("double") for f, levels in self.factors.items() for v in levels[1:]]
        needed = [F.col(c).isNotNull() for c in [*self.numeric, *self.factors]]
        rows = samples
        for c in needed:
            rows = rows.where(c)
        return rows.select("sample_id", F.array(*x).alias("x"))

    def grid(self) -> pd.DataFrame:
        """All combinations of factor levels, numeric covariates at zero, with design rows."""
        import itertools

        rows = []
        for combo in itertools.product(*self.factors.values()):
            named = dict(zip(self.factors, combo))
            x = [1.0, *[0.0] * len(self.numeric), *(float(named[f] == v) for f, levels in self.factors.items() for v in levels[1:])]
            rows.append({**named, "x": x})
        return pd.DataFrame(rows)


def sufficient(betas: DataFrame, samples: DataFrame, design: Design) -> DataFrame:
    """(probe_id, n, yy, xy array, xx array): sums over samples with a beta.

    y is centred at 0.5, where betas live, so that squares do not cancel.
    """
    k = len(design.terms)
    rows = betas.where("beta IS NOT NULL").join(small_side(design.columns(samples)), "sample_id")
    x = lambda i: F.col("x")[i]
    y = F.col("beta") - 0.5
    xy = [F.sum(x(i) * y) for i in range(k)]
    xx = [F.sum(x(i) * x(j)) for i in range(k) for j in range(i, k)]
    return rows.groupBy("probe_id").agg(F.count("*").alias("n"), F.sum(y * y).alias("yy"), F.array(*xy).alias("xy"), F.array(*xx).alias("xx"))


def _sweep(a: np.ndarray, use: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """Sweeps columns ``use`` of stacked cross products (n, k + 1, k + 1), y last: (swept, kept).

    A column whose rest after the earlier ones is nil is aliased and stays unswept. In the
    result the kept block is the inverse, the last column holds coefficients, the corner
    the residual sum of squares.
    """
    a, whole = a.copy(), np.einsum("nii->ni", a).copy()
    kept = np.zeros(whole.shape, bool)
    for j in use:
        pivot = a[:, j, j].copy()
        ok = kept[:, j] = (whole[:, j] > 0) & (pivot > 1e-10 * whole[:, j])
        m, d = a[ok], pivot[ok, None]
        row, column = m[:, j, :] / d, m[:, :, j].copy()
        m -= column[:, :, None] * row[:, None, :]
        m[:, j, :], m[:, :, j] = row, -column / d
        m[:, j, j] = 1 / d[:, 0]
        a[ok] = m
    return a, kept


#: Arrays go by ``Design.terms``; those of F-tests by ``Design.factors``.
FIT_ROWS = "probe_id string, df long, estimate array<double>, std_error array<double>, t array<double>, p array<double>, aliased array<boolean>, f array<double>, fp array<double>"


def fit_rows(betas: DataFrame, samples: DataFrame, design: Design) -> DataFrame:
    """A row a probe with arrays of coefficients and of F-tests; all probes of a batch are solved at once."""
    k = len(design.terms)
    contrasts = [design.contrast(f) for f in design.factors]
    upper = np.triu_indices(k)

    def run(batches):
        for pdf in batches:
            n = len(pdf)
            if not n:
                continue
            a = np.zeros((n, k + 1, k + 1))
            a[:, upper[0], upper[1]] = np.stack(pdf["xx"].to_numpy())
            a[:, :k, k] = np.stack(pdf["xy"].to_numpy())
            a[:, k, k] = pdf["yy"]
            a = np.triu(a) + np.triu(a, 1).transpose(0, 2, 1)
            swept, kept = _sweep(a, list(range(k)))
            kept = kept[:, :k]
            df = pdf["n"].to_numpy() - kept.sum(axis=1)
            rss = np.maximum(swept[:, k, k], 0.0)
            with np.errstate(all="ignore"):
                s2 = np.where(df > 0, rss / df, np.nan)
                estimate = np.where(kept, swept[:, :k, k], np.nan)
                se = np.where(kept, np.sqrt(s2[:, None] * np.einsum("nii->ni", swept)[:, :k]), np.nan)
                estimate[:, 0] += 0.5
                t = np.where(se != 0, estimate / se, np.nan)
                p = t_two_sided(t, np.maximum(df, 1e-9)[:, None])
                f, fp = np.full((n, len(contrasts)), np.nan), np.full((n, len(contrasts)), np.nan)
                for i, drop in enumerate(contrasts):
                    less, kept0 = _sweep(a, [j for j in range(k) if j not in drop])
                    d1 = kept.sum(axis=1) - kept0.sum(axis=1)
                    f[:, i] = np.where((d1 > 0) & (s2 > 0), (less[:, k, k] - rss) / d1 / s2, np.nan)
                    fp[:, i] = f_upper(f[:, i], np.maximum(d1, 1e-9), np.maximum(df, 1e-9))
            columns = {"estimate": estimate, "std_error": se, "t": t, "p": p, "aliased": ~kept, "f": f, "fp": fp}
            yield pd.DataFrame({"probe_id": pdf["probe_id"], "df": df, **{c: list(v) for c, v in columns.items()}})

    return sufficient(betas, samples, design).mapInPandas(run, FIT_ROWS)


def fit(betas: DataFrame, samples: DataFrame, design: Design) -> tuple[DataFrame, DataFrame]:
    """(coefficients, F-tests) as tidy tables.

    coefficients: probe_id, term, estimate, std_error, t, p, aliased, df; F-tests:
    probe_id, contrast, f, p, one a factor, against the model without its columns.
    """
    rows = fit_rows(betas, samples, design)
    nan = lambda c, name: F.when(~F.isnan(c), F.col(c)).alias(name)
    named = lambda names, *arrays: F.inline(F.arrays_zip(F.array(*map(F.lit, names)).alias("name"), *arrays))
    coef = rows.select("probe_id", "df", named(design.terms, "estimate", "std_error", "t", "p", "aliased"))
    coef = coef.select("probe_id", F.col("name").alias("term"), *(nan(c, c) for c in ("estimate", "std_error", "t", "p")), "aliased", "df")
    if not design.factors:
        return coef, rows.where("false").select("probe_id", F.lit("").alias("contrast"), F.lit(0.0).alias("f"), F.lit(0.0).alias("p"))
    tests = rows.select("probe_id", named(list(design.factors), "f", "fp"))
    return coef, tests.select("probe_id", F.col("name").alias("contrast"), nan("f", "f"), nan("fp", "p"))


def summary(rows: DataFrame, design: Design) -> DataFrame:
    """A wide row a probe of ``fit_rows``: est_*, pval_*, fpval_* and eff_* (range of a factor's estimates with 0).

    Probes with fewer coefficients than the fullest one are left out.
    """
    number = lambda c: F.when(~F.isnan(c), c)
    full = F.size(F.filter("aliased", lambda x: ~x))
    most = rows.agg(F.max(full).alias("__most"))
    at = {t: i for i, t in enumerate(design.terms)}
    wide = rows.join(F.broadcast(most)).where(full == F.col("__most")).select(  # one row
        "probe_id",
        *(number(F.col("estimate")[i]).alias(f"est_{t}") for t, i in at.items()),
        *(number(F.col("p")[i]).alias(f"pval_{t}") for t, i in at.items()),
        *(number(F.col("fp")[i]).alias(f"fpval_{c}") for i, c in enumerate(design.factors)),
    )
    for c, levels in design.factors.items():
        held = [F.coalesce(F.col(f"est_{c}_{v}"), F.lit(0.0)) for v in levels[1:]]
        wide = wide.withColumn(f"eff_{c}", F.greatest(F.lit(0.0), *held) - F.least(F.lit(0.0), *held) if held else F.lit(0.0))
    return wide


def coefficients(coef: DataFrame, term: str) -> DataFrame:
    """One term's rows; aliased ones have nulls."""
    return coef.where(F.col("term") == term)


def predict(coef: DataFrame, design: Design) -> DataFrame:
    """(probe_id, factor columns, prediction) on the grid of factor levels."""
    grid = design.grid()
    spark = coef.sparkSession
    long = [(*(r[f] for f in design.factors), t, float(v)) for _, r in grid.iterrows() for t, v in zip(design.terms, r["x"])]
    schema = ", ".join([*(f"{f} string" for f in design.factors), "term string", "x double"])
    points = spark.createDataFrame(long, schema)  # levels times terms
    rows = coef.select("probe_id", "term", "estimate").join(F.broadcast(points), "term")
    return rows.groupBy("probe_id", *design.factors).agg(F.sum(F.coalesce("estimate", F.lit(0.0)) * F.col("x")).alias("prediction"))


def effect_size(predictions: DataFrame, factors: list[str]) -> DataFrame:
    """(probe_id, one column a factor): its widest range with the other factors fixed."""
    out = None
    for f in factors:
        others = [g for g in factors if g != f]
        spread = predictions.groupBy("probe_id", *others).agg((F.max("prediction") - F.min("prediction")).alias("r"))
        one = spread.groupBy("probe_id").agg(F.max("r").alias(f"eff_{f}"))
        out = one if out is None else out.join(one, "probe_id")
    return out


#: Neighbouring probes that are dealt together.
RUN = 64


def neighbour_distance(betas: DataFrame, coords: DataFrame) -> DataFrame:
    """(probe_id, chrom, start, end, ord, dist, changed): against the probe before in genome order.

    ``dist`` sums squared beta differences over samples. Only mapped probes (chromosome
    neither null nor ``*``) with some beta count as neighbours. A chromosome is one group
    of a light table (a row a probe, no betas); betas are dealt by runs of RUN neighbours,
    the last of each also to the next run, so each finds the one before it in its own task.
    """
    known = betas.where("beta IS NOT NULL").select("probe_id").distinct()
    mapped = coords.where("chrom IS NOT NULL AND chrom <> '*'")
    placed = mapped.join(known, "probe_id", "left_semi").select("probe_id", "chrom", "start", "end")
    order = W.partitionBy("chrom").orderBy("start", "end", "probe_id")
    placed = placed.withColumns({"changed": F.lag("probe_id").over(order).isNull(), "ord": F.row_number().over(order)})
    own = F.expr(f"ord div {RUN}")
    runs = F.when((F.col("ord") + 1) % RUN == 0, F.array(own, own + 1)).otherwise(F.array(own))
    rows = betas.select("sample_id", "probe_id", "beta").join(placed.select("probe_id", "chrom", "ord"), "probe_id").withColumn("run", F.explode(runs))
    near = W.partitionBy("chrom", "run", "sample_id").orderBy("ord")
    apart = F.when(F.lag("ord").over(near) == F.col("ord") - 1, F.pow(F.col("beta") - F.lag("beta").over(near), F.lit(2)))
    dist = rows.withColumn("d", apart).where(F.col("run") == own).groupBy("chrom", "ord").agg(F.sum("d").alias("d"))
    out = placed.join(dist, ["chrom", "ord"], "left")
    return out.select("probe_id", "chrom", "start", "end", "ord", F.when(~F.col("changed"), F.coalesce("d", F.lit(0.0))).alias("dist"), "changed")


def segments(betas: DataFrame, coords: DataFrame, per_locus: float = 0.5, cutoff: float | None = None) -> DataFrame:
    """(probe_id, chrom, start, end, seg): a segment ends where the distance exceeds the cutoff.

    The cutoff is the 1 - per_locus quantile of the distances within chromosomes.
    """
    rows = neighbour_distance(betas, coords)
    if cutoff is None:
        limit = rows.agg(F.percentile("dist", F.lit(1 - per_locus)).alias("__cut"))
        rows = rows.join(F.broadcast(limit))  # one row
    else:
        rows = rows.withColumn("__cut", F.lit(cutoff))
    breaks = F.col("changed") | (F.col("dist") > F.col("__cut"))
    running = W.partitionBy("chrom").orderBy("ord").rowsBetween(W.unboundedPreceding, 0)
    return rows.withColumn("seg", F.sum(breaks.cast("long")).over(running)).select("probe_id", "chrom", "start", "end", "dist", "seg")


def regions(segs: DataFrame, coef: DataFrame, term: str) -> DataFrame:
    """A row a segment: chrom, start, end, n, estimate (mean), p (Stouffer) and p_adj (BH)."""
    rows = segs.join(coefficients(coef, term).select("probe_id", "estimate", "p"), "probe_id")

    @F.pandas_udf("double")
    def z(p: pd.Series) -> pd.Series:
        return pd.Series(normal_quantile(np.clip(p.to_numpy(float), 1e-300, 1 - 1e-16)))

    @F.pandas_udf("double")
    def phi(x: pd.Series) -> pd.Series:
        return pd.Series(normal_cdf(x.to_numpy(float)))

    rows = rows.withColumn("z", z("p"))
    out = rows.groupBy("chrom", "seg").agg(
        F.min("start").alias("start"), F.max("end").alias("end"), F.count("*").alias("n"), F.avg("estimate").alias("estimate"), (F.sum("z") / F.sqrt(F.count("z"))).alias("zs")
    )
    return benjamini_hochberg(out.withColumn("p", phi("zs")).drop("zs"), "p", "p_adj", ties=["chrom", "seg"])


def region_probes(segs: DataFrame, found: DataFrame, coef: DataFrame, term: str) -> DataFrame:
    """A row a probe with a coefficient: its region's columns as seg_*, then the probe's own estimate, t and p."""
    own = coefficients(coef, term).select("probe_id", "estimate", "std_error", "t", "p")
    names = [c for c in found.columns if c not in ("chrom", "seg")]
    rows = segs.select("probe_id", "chrom", "seg").join(own, "probe_id")
    return rows.join(found.select("chrom", "seg", *(F.col(c).alias(f"seg_{c}") for c in names)), ["chrom", "seg"])
