"""Inference on samples: age, tissue, strain, species, sex, cell fractions, signatures, imputation."""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions.joins import every_sample, sample_side, small_side, sorted_side
from ..functions.stats import mode
from ..functions.windows import mean_rank
from .signal import collapse_mean


def horvath_age(x: Column, adult: float = 20.0) -> Column:
    """Response to years: exponential before adulthood, linear after."""
    return F.when(x < 0, (1 + adult) * F.exp(x) - 1).otherwise((1 + adult) * x + adult)


TRANSFORMS = {"identity": lambda x: x, "horvath": horvath_age, "log2": lambda x: F.pow(F.lit(2.0), x)}


def predict_age(betas: DataFrame, clock: DataFrame, intercept: float = 0.0, transform: str = "identity", least: int = 10) -> DataFrame:
    """(sample_id, n, age) from a clock (probe_id, slope, na_fallback).

    A missing beta takes its fallback, or is left out without one; fewer than ``least``
    betas give null.
    """
    rows = every_sample(clock, betas).join(betas.select("sample_id", "probe_id", "beta"), ["sample_id", "probe_id"], "left")
    value = F.col("slope") * F.coalesce("beta", "na_fallback")
    out = rows.groupBy("sample_id").agg(F.count("beta").alias("n"), F.sum(value).alias("s"))
    age = TRANSFORMS[transform](F.col("s") + intercept)
    return out.select("sample_id", "n", F.when(F.col("n") >= least, age).alias("age"))


def tissue_scores(betas: DataFrame, signature: DataFrame, least_delta: float = 0.3, top: int = 15) -> DataFrame:
    """(sample_id, branch, score): mean of beta (or 1 - beta where the signature falls) over the top probes."""
    strong = signature.where(F.abs("delta_beta") >= least_delta)
    order = W.partitionBy("branch").orderBy(F.abs("delta_beta").desc(), "probe_id")
    chosen = strong.withColumn("n", F.row_number().over(order)).where(F.col("n") <= top)
    value = F.when(F.col("delta_beta") < 0, 1 - F.col("beta")).otherwise(F.col("beta"))
    rows = betas.join(F.broadcast(chosen.select("probe_id", "branch", "delta_beta")), "probe_id")  # top probes a branch
    return rows.groupBy("sample_id", "branch").agg(F.avg(value).alias("score"))


def best_tissues(scores: DataFrame) -> DataFrame:
    """(sample_id, tissue): the two best branches as text."""
    w = W.partitionBy("sample_id").orderBy(F.col("score").desc_nulls_last(), "branch")
    two = scores.withColumn("n", F.row_number().over(w)).where("n <= 2")
    said = F.format_string("[%s](%1.1f)", "branch", "score")
    return two.groupBy("sample_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", said.alias("t")))), lambda x: x["t"]), " ").alias("tissue"))


def strain_likelihood(betas: DataFrame, strains: DataFrame, sd: float = 0.8) -> DataFrame:
    """(sample_id, strain, loglik, prob) from genotypes (strain, probe_id, genotype, flip); missing betas count as 0.5."""
    af = F.coalesce("beta", F.lit(0.5))
    af = F.when(F.col("flip"), 1 - af).otherwise(af)
    rows = betas.select("sample_id", "probe_id", "beta").join(strains, "probe_id")
    log_density = -0.5 * F.pow((F.col("genotype") - af) / sd, 2) - F.lit(float(np.log(sd * np.sqrt(2 * np.pi))))
    out = rows.groupBy("sample_id", "strain").agg(F.sum(log_density).alias("loglik"))
    w = W.partitionBy("sample_id")
    e = F.exp(F.col("loglik") - F.max("loglik").over(w))
    return out.withColumn("prob", e / F.sum(e).over(w))


def infer_strain(likelihood: DataFrame, rate: DataFrame | None = None, least_rate: float = 0.2) -> DataFrame:
    """(sample_id, strain, pval); null where the detection rate is too low."""
    w = W.partitionBy("sample_id").orderBy(F.col("prob").desc(), "strain")
    best = likelihood.withColumn("n", F.row_number().over(w)).where("n = 1").select("sample_id", "strain", (1 - F.col("prob")).alias("pval"))
    if rate is None:
        return best
    ok = F.col("rate") >= least_rate
    return best.join(rate, "sample_id", "left").select("sample_id", F.when(ok, F.col("strain")).alias("strain"), F.when(ok, F.col("pval")).alias("pval"))


def species_auc(p: DataFrame, scores: DataFrame, top: int = 1000, positive: float = 0.01, negative: float = 0.1) -> DataFrame:
    """(sample_id, species, n, auc): how alignment scores part detected from undetected probes.

    As many of the most and least detected probes are taken, ``top`` at most of each.
    """
    known = p.where("p IS NOT NULL").join(scores.select("probe_id").distinct(), "probe_id", "left_semi")
    pos = known.where(F.col("p") <= positive).withColumn("n", F.row_number().over(W.partitionBy("sample_id").orderBy("p", "probe_id"))).withColumn("y", F.lit(1))
    neg = known.where(F.col("p") >= negative).withColumn("n", F.row_number().over(W.partitionBy("sample_id").orderBy(F.col("p").desc(), "probe_id"))).withColumn("y", F.lit(0))
    both = pos.where(F.col("n") <= top).unionByName(neg.where(F.col("n") <= top))  # so the windows keep no more
    sizes = both.groupBy("sample_id").agg(F.count_if(F.col("y") == 1).alias("a"), F.count_if(F.col("y") == 0).alias("b"))
    size = F.least("a", "b", F.lit(top))
    rows = both.join(sample_side(sizes.select("sample_id", size.alias("k"))), "sample_id").where("n <= k")
    ranked = rows.join(scores, "probe_id").withColumn("r", mean_rank("score", ["sample_id", "species"]))
    n1, n2 = F.sum("y"), F.sum(1 - F.col("y"))
    auc = F.try_divide(F.sum(F.col("r") * F.col("y")) - n1 * (n1 + 1) / 2, n1 * n2)
    return ranked.groupBy("sample_id", "species").agg(F.max("k").alias("n"), auc.alias("auc"))


def infer_species(auc: DataFrame, p: DataFrame, reference: str) -> DataFrame:
    """(sample_id, species): the best AUC, or the reference where negative probes are lacking."""
    rate = p.groupBy("sample_id").agg((F.count_if(F.col("p") <= 0.05) / F.count("p")).alias("rate"))
    w = W.partitionBy("sample_id").orderBy(F.col("auc").desc_nulls_last(), "species")
    best = auc.withColumn("i", F.row_number().over(w)).where("i = 1")
    rows = rate.join(best, "sample_id", "left")
    lacking = F.col("auc").isNull() | (F.col("rate") >= 0.95) | ((F.col("rate") >= 0.8) & (F.col("auc") < 0.5))
    return rows.select("sample_id", F.when(lacking, F.lit(reference)).otherwise(F.col("species")).alias("species"))


def species_info(calls: DataFrame, info: DataFrame) -> DataFrame:
    """Calls (sample_id, species) with the species' scientificName, taxonID, commonName and assembly; unknown species have nulls."""
    names = ["scientificName", "taxonID", "commonName", "assembly"]
    return calls.join(info.select("species", *names), "species", "left").select(*calls.columns, *names)


def update_design(signals: DataFrame, reference: DataFrame) -> DataFrame:
    """Signals with the colour of type I probes and the mask of a species or strain (probe_id, col, mask)."""
    ref = reference.select("probe_id", F.col("col").alias("__col"), F.col("mask").alias("__mask"))
    rows = signals.join(ref, "probe_id", "left")
    col = F.when((F.col("col") != "2") & F.col("__col").isNotNull(), F.col("__col")).otherwise(F.col("col"))
    return rows.withColumns({"col": col, "mask": F.col("mask") | F.coalesce("__mask", F.lit(False))}).drop("__col", "__mask")


def density_mode(df: DataFrame, by: list[str], value: str, out: str = "mode") -> DataFrame:
    """Mode of a Gaussian kernel density of each group's values; a group is a sample's marker probes."""
    schema = ", ".join(f"{c} string" for c in by) + f", {out} double, n long"

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        x = pdf[value].to_numpy(float)
        return pd.DataFrame([[*(pdf[c].iloc[0] for c in by), mode(x), int((~np.isnan(x)).sum())]], columns=[*by, out, "n"])

    return df.select(*by, value).groupBy(*by).applyInPandas(run, schema)


def infer_sex(betas: DataFrame, high_in_males: DataFrame, low_in_males: DataFrame, cut: float = 0.4) -> DataFrame:
    """(sample_id, mode, sex): mode of (mean of the first set - each beta of the second) above the cut is MALE."""
    mean = betas.join(high_in_males.select("probe_id"), "probe_id", "left_semi").groupBy("sample_id").agg(F.avg("beta").alias("high"))
    rows = betas.join(low_in_males.select("probe_id"), "probe_id", "left_semi").join(mean, "sample_id")
    modes = density_mode(rows.withColumn("d", F.col("high") - F.col("beta")), ["sample_id"], "d")
    return modes.select("sample_id", "mode", F.when(F.col("mode") > cut, "MALE").when(F.col("mode").isNotNull() & ~F.isnan("mode"), "FEMALE").alias("sex"))


def group_means(betas: DataFrame, samples: DataFrame, factor: str, level: str) -> DataFrame:
    """(probe_id, mean_in, mean_out, na_in, na_out, n_in, n_out) of the level's samples and the others."""
    rows = betas.join(small_side(samples.select("sample_id", factor)), "sample_id")
    inside = F.col(factor) == level
    b, null = F.col("beta"), F.col("beta").isNull()
    return rows.groupBy("probe_id").agg(
        F.avg(F.when(inside, b)).alias("mean_in"), F.avg(F.when(~inside, b)).alias("mean_out"), F.count_if(inside & null).alias("na_in"),
        F.count_if(~inside & null).alias("na_out"), F.count_if(inside).alias("n_in"), F.count_if(~inside).alias("n_out"),
    )


def signature_low(means: DataFrame, low: float = 0.2, high: float = 0.7, na_share: float = 0.5) -> DataFrame:
    """Probes low in the group and high elsewhere, with few missing values in either."""
    ok = (F.col("na_in") <= na_share * F.col("n_in")) & (F.col("na_out") <= na_share * F.col("n_out"))
    return means.where((F.col("mean_in") < low) & (F.col("mean_out") > high) & ok).select("probe_id", "mean_in", "mean_out")


def signature_top(means: DataFrame, n: int = 100, na_share: float = 0.5) -> DataFrame:
    """The n probes whose group mean lies furthest below the others'."""
    ok = (F.col("na_in") <= na_share * F.col("n_in")) & (F.col("na_out") <= na_share * F.col("n_out"))
    rows = means.where(ok & F.col("mean_in").isNotNull() & F.col("mean_out").isNotNull())
    return rows.select("probe_id", (F.col("mean_in") - F.col("mean_out")).alias("delta")).orderBy("delta", "probe_id").limit(n)


def two_component_probes(reference: DataFrame, n: int = 1000) -> DataFrame:
    """(probe_id, a, b, side): the probes where a most exceeds b (high) and where b most exceeds a (low)."""
    d = reference.where("a IS NOT NULL AND b IS NOT NULL").withColumn("d", F.col("a") - F.col("b"))
    high = d.where("d > 0").orderBy(F.col("d").desc(), "probe_id").limit(n).withColumn("side", F.lit("high"))
    low = d.where("d < 0").orderBy("d", "probe_id").limit(n).withColumn("side", F.lit("low"))
    return high.unionByName(low).select("probe_id", "a", "b", "side")


def two_component_fraction(betas: DataFrame, probes: DataFrame, least: int = 10) -> DataFrame:
    """(sample_id, fraction of a): mode of (beta - b) / (a - b) over the marker probes, in [0, 1]."""
    rows = betas.where("beta IS NOT NULL").join(F.broadcast(probes), "probe_id")  # 2 n probes at most
    modes = density_mode(rows.withColumn("x", F.try_divide(F.col("beta") - F.col("b"), F.col("a") - F.col("b"))), ["sample_id"], "x")
    return modes.select("sample_id", F.when(F.col("n") >= least, F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("mode")))).alias("fraction"), "n")


def reference_set(references: DataFrame, coords: DataFrame) -> DataFrame:
    """Reference betas (cell, probe_id, beta) of autosomal cg probes that every cell type has."""
    cells = references.agg(F.countDistinct("cell").alias("c"))
    ok = coords.where(~F.col("chrom").isin("chrX", "chrY", "chrM", "*")).select("probe_id")
    rows = references.where(F.col("beta").isNotNull() & F.col("probe_id").startswith("cg")).join(ok, "probe_id", "left_semi")
    whole = rows.groupBy("probe_id").agg(F.countDistinct("cell").alias("n")).join(F.broadcast(cells)).where("n = c")  # one row
    return rows.join(whole, "probe_id", "left_semi")


def differential(references: DataFrame) -> DataFrame:
    """Rows of probes whose reference betas are not all equal."""
    keep = references.groupBy("probe_id").agg(F.min("beta").alias("a"), F.max("beta").alias("b")).where("a <> b")
    return references.join(keep, "probe_id", "left_semi")


def cell_mixture(betas: DataFrame, references: DataFrame, cells: list[str], rounds: int = 1000, temperature: float = 0.5, seed: int = 1) -> DataFrame:
    """(sample_id, cell, fraction, error) by simulated annealing over fractions of cells and an unknown part.

    The unknown part is methylated or not at each probe, whichever lies nearer, so a probe's
    error is what the cells leave, or its distance from the unknown fraction; errors are
    summed. A random share moves between two parts, in wide steps and then in narrow ones
    from the best so far; a pass ends after ``rounds`` steps without a gain.
    """
    wide = references.groupBy("probe_id").pivot("cell", cells).agg(F.first("beta"))
    rows = betas.where("beta IS NOT NULL").select("sample_id", "probe_id", "beta").join(wide, "probe_id")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        name = pdf["sample_id"].iloc[0]
        pdf = pdf.sort_values("probe_id")
        rng = np.random.default_rng([seed, zlib.crc32(name.encode())])
        y, g = pdf["beta"].to_numpy(float), pdf[cells].to_numpy(float)
        best_f = np.append(np.zeros(len(cells)), 1.0)  # the last part is unknown
        best = mixture_error(best_f, g, y)
        for widest in (1.0, 0.05):
            f, now, still = best_f, best, 0
            while still < rounds:
                source, target = rng.choice(len(f), 2, replace=False)
                move = widest * rng.random()
                if move > f[source]:
                    continue
                new = f.copy()
                new[source] -= move
                new[target] += move
                e = mixture_error(new, g, y)
                still += 1
                if e < best:
                    still = 0 if best - e > 1e-4 * best else still
                    best, best_f = e, new
                if e <= now or rng.random() < np.exp((now - e) / temperature):
                    f, now = new, e
        return pd.DataFrame({"sample_id": name, "cell": [*cells, "unknown"], "fraction": best_f, "error": best})

    return rows.groupBy("sample_id").applyInPandas(run, "sample_id string, cell string, fraction double, error double")


def mixture_error(f: np.ndarray, g: np.ndarray, y: np.ndarray) -> float:
    """Sum over probes of the distance of ``y`` from cells mixed by ``f`` (the last part unknown, 0 or 1 a probe)."""
    rest = y - g @ f[:-1]
    return float(np.nansum(np.where(rest < f[-1] / 2, np.abs(rest), np.abs(rest - f[-1]))))


def unknown_state(betas: DataFrame, references: DataFrame, fractions: DataFrame) -> DataFrame:
    """(sample_id, probe_id, state): 0 or 1 for the unknown part of ``cell_mixture``'s fractions, by the nearer.

    ``fractions`` (sample_id, cell, fraction[, whole]): a fraction is of ``whole``, or of 1.
    A probe's cells are summed in order of their names, so a beta halfway falls to one side.
    """
    packed = lambda df, key, v, *more: df.groupBy(key).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("cell", v)))).alias(f"__{v}"), *more)
    whole = F.max(F.col("whole").cast("double") if "whole" in fractions.columns else F.lit(1.0)).alias("__whole")
    rows = betas.where("beta IS NOT NULL").select("sample_id", "probe_id", "beta").join(sorted_side(packed(references, "probe_id", "beta")), "probe_id")
    rows = rows.join(sample_side(packed(fractions, "sample_id", "fraction", whole)), "sample_id")
    part = lambda x, c: x * F.coalesce(F.col("__fraction")[c], F.lit(0.0)) / F.col("__whole")
    rest = F.col("beta") - F.aggregate(F.map_entries("__beta"), F.lit(0.0), lambda s, e: s + part(e["value"], e["key"]))
    return rows.select("sample_id", "probe_id", F.when(rest < part(F.lit(1.0), F.lit("unknown")) / 2, 0).otherwise(1).alias("state"))


def impute_mean(betas: DataFrame, by: str = "probe_id") -> DataFrame:
    """Missing betas take the mean of their probe (``probe_id``) or sample (``sample_id``)."""
    if by not in ("probe_id", "sample_id"):
        raise ValueError("by must be probe_id or sample_id")
    means = betas.groupBy(by).agg(F.avg("beta").alias("__mean"))
    return betas.join(means, by, "left").withColumn("beta", F.coalesce("beta", "__mean")).drop("__mean")


def impute_reference(betas: DataFrame, reference: DataFrame, cell: str | None = None, most_sd: float | None = None) -> DataFrame:
    """Missing betas take the median (celltype, probe_id, median, sd) of the best correlated cell type, or of ``cell``."""
    if cell is None:
        pairs = betas.where("beta IS NOT NULL").select("sample_id", "probe_id", "beta").join(reference, "probe_id")
        fit = pairs.groupBy("sample_id", "celltype").agg(F.corr("beta", "median").alias("r"))
        best = fit.groupBy("sample_id").agg(F.max_by("celltype", F.struct(F.coalesce("r", F.lit(-2.0)).alias("r"), "celltype")).alias("celltype"))
        rows = betas.join(sample_side(best), "sample_id", "left")
    else:
        rows = betas.withColumn("celltype", F.lit(cell))
    ref = reference.select("celltype", "probe_id", F.col("median").alias("__m"), F.col("sd").alias("__sd"))
    ok = F.lit(True) if most_sd is None else F.col("__sd") <= most_sd
    return rows.join(ref, ["celltype", "probe_id"], "left").withColumn("beta", F.coalesce("beta", F.when(ok, F.col("__m")))).drop("__m", "__sd")


def lift_ids(ids: DataFrame, targets: DataFrame, prefix_only: bool, unique: bool = True, include_new: bool = False, include_old: bool = False) -> DataFrame:
    """(id_source, id_target) of two platforms' ids, equal as a whole or before the underscore."""
    key = lambda c: F.element_at(F.split(c, "_"), 1) if prefix_only else F.col(c)
    a = ids.select(F.col("probe_id").alias("id_source")).distinct().withColumn("k", key("id_source"))
    b = targets.select(F.col("probe_id").alias("id_target")).distinct().withColumn("k", key("id_target"))
    out = a.join(sorted_side(b), "k", "full").drop("k")
    if not include_new:
        out = out.where("id_source IS NOT NULL")
    if not include_old:
        out = out.where("id_target IS NOT NULL")
    if unique:
        w = W.partitionBy("id_target").orderBy(F.col("id_source").asc_nulls_last())
        out = out.withColumn("n", F.row_number().over(w)).where("n = 1 OR id_target IS NULL").drop("n")
    return out


def lift_betas(betas: DataFrame, mapping: DataFrame) -> DataFrame:
    """Betas under target ids (sample_id, probe_id, beta); targets without a source get null for every sample."""
    pairs = mapping.where("id_target IS NOT NULL").select("id_source", F.col("id_target").alias("__t"))
    rows = betas.select("sample_id", F.col("probe_id").alias("id_source"), "beta").join(pairs, "id_source")
    found = rows.select("sample_id", F.col("__t").alias("probe_id"), "beta")
    return every_sample(pairs.select(F.col("__t").alias("probe_id")).distinct(), betas).join(found, ["sample_id", "probe_id"], "left").select("sample_id", "probe_id", "beta")


def lift_signals(signals: DataFrame, mapping: DataFrame) -> DataFrame:
    """Signals under target ids; a target without a source is masked and empty."""
    names = [c for c in signals.columns if c not in ("sample_id", "probe_id")]
    rows = signals.withColumnRenamed("probe_id", "id_source").join(sorted_side(mapping.where("id_target IS NOT NULL")), "id_source")
    found = rows.select("sample_id", F.col("id_target").alias("probe_id"), *names)
    targets = mapping.where("id_target IS NOT NULL").select(F.col("id_target").alias("probe_id")).distinct()
    return every_sample(targets, signals).join(sorted_side(found), ["sample_id", "probe_id"], "left").withColumn("mask", F.coalesce("mask", F.lit(True)))


def reindex_by_prefix(betas: DataFrame, targets: DataFrame) -> DataFrame:
    """Betas averaged by id prefix, for the given target ids and every sample (null where there is none)."""
    means = collapse_mean(betas)
    return every_sample(targets.select("probe_id").distinct(), betas).join(means, ["sample_id", "probe_id"], "left").select("sample_id", "probe_id", "beta")


def two_component_strict(reference: DataFrame, low: float = 0.3, high: float = 0.7) -> DataFrame:
    """Marker probes where one part is below ``low`` and the other above ``high``."""
    side = F.when((F.col("a") > high) & (F.col("b") < low), "high").when((F.col("a") < low) & (F.col("b") > high), "low")
    return reference.withColumn("side", side).where("side IS NOT NULL").select("probe_id", "a", "b", "side")
