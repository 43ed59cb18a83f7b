"""The tables behind plots: what is drawn, not how."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .ranges import chrom_key
from .signal import allele_frequencies, beta_column, in_band


def enrichment_frame(results: DataFrame, top: int = 20) -> DataFrame:
    """The best sets with an overlap: -log10 FDR (zero FDR takes the least double), one row a label."""
    rows = results.where("ndq > 0").withColumn("neg_log10_fdr", -F.log10(F.when(F.col("fdr") <= 0, F.lit(2.2250738585072014e-308)).otherwise(F.col("fdr"))))
    rows = rows.withColumn("estimate", F.greatest(F.lit(-1000.0), F.least(F.lit(1000.0), F.col("estimate"))))
    w = W.partitionBy("dbname").orderBy("fdr")
    return rows.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n").orderBy("fdr", F.abs("estimate").desc_nulls_last(), "dbname").limit(top)


def point_range(stats: DataFrame) -> DataFrame:
    """(dbname, mean, low, high): mean of a set's values over samples, plus and minus their sd."""
    out = stats.groupBy("dbname").agg(F.avg("value").alias("mean"), F.stddev_samp("value").alias("sd"))
    return out.select("dbname", "mean", (F.col("mean") - F.col("sd")).alias("low"), (F.col("mean") + F.col("sd")).alias("high"))


def manhattan(values: DataFrame, coords: DataFrame) -> DataFrame:
    """(probe_id, chrom, x, value): positions along the genome, chromosomes end to end."""
    lengths = coords.groupBy("chrom").agg(F.max("end").alias("len"))
    before = W.orderBy(chrom_key(F.col("chrom")), "chrom").rowsBetween(W.unboundedPreceding, -1)  # a row a chromosome
    offsets = lengths.select("chrom", F.coalesce(F.sum("len").over(before), F.lit(0)).alias("off"))
    rows = values.join(coords.select("probe_id", "chrom", "start"), "probe_id").join(F.broadcast(offsets), "chrom")
    return rows.select("probe_id", "chrom", (F.col("start") + F.col("off")).alias("x"), "value")


def region_matrix(betas: DataFrame, coords: DataFrame, chrom: str, start: int, end: int, samples: list[str], most: int = 1000) -> DataFrame:
    """(probe_id, start, one column a sample) of the probes in a region; an error for none or too many."""
    inside = coords.where((F.col("chrom") == chrom) & (F.col("start") <= end) & (F.col("end") >= start))
    n = inside.count()
    if not 0 < n <= most:
        raise ValueError(f"the region has {n} probes")
    rows = betas.join(F.broadcast(inside.select("probe_id", "start")), "probe_id")  # at most ``most`` rows
    return rows.groupBy("probe_id", "start").pivot("sample_id", samples).agg(F.first("beta"))


def gene_windows(genes: DataFrame, upstream: int = 2000, downstream: int = 2000, gene: str | None = None) -> DataFrame:
    """(gene, chrom, start, end) of genes (or one) with their flanks, by strand."""
    plus = F.col("strand") == "+"
    rows = genes if gene is None else genes.where(F.col("gene") == gene)
    return rows.select("gene", "chrom", (F.col("start") - F.when(plus, upstream).otherwise(downstream)).alias("start"), (F.col("end") + F.when(plus, downstream).otherwise(upstream)).alias("end"))


def beta_histogram(signals: DataFrame, bins: int = 20) -> DataFrame:
    """(sample_id, design, bin, n): betas by design, for density curves."""
    b = signals.where("NOT mask").withColumn("beta", beta_column()).where("beta IS NOT NULL")
    place = F.least(F.floor(F.col("beta") * bins), F.lit(bins - 1)).cast("int")
    return b.groupBy("sample_id", F.col("col").alias("design"), place.alias("bin")).agg(F.count("*").alias("n"))


def red_green_quantiles(signals: DataFrame, points: int = 10) -> DataFrame:
    """(sample_id, q, red, green): paired quantiles of in-band type I signal."""
    qs = [i / points for i in range(points + 1)]
    v = in_band(signals)
    of = lambda c: F.percentile(F.when(F.col("channel") == c, F.col("v")), F.array(*(F.lit(q) for q in qs)))
    wide = v.groupBy("sample_id").agg(of("R").alias("r"), of("G").alias("g"))
    return wide.select("sample_id", F.posexplode(F.arrays_zip(F.col("r").alias("red"), F.col("g").alias("green"))).alias("i", "x")).select("sample_id", (F.col("i") / points).alias("q"), "x.red", "x.green")


def intensity_by_beta(signals: DataFrame, bins: int = 20) -> DataFrame:
    """(sample_id, bin, n, mean_total): total intensity along beta."""
    b = signals.withColumn("beta", beta_column()).where("beta IS NOT NULL")
    from .signal import methylated, unmethylated

    place = F.least(F.floor(F.col("beta") * bins), F.lit(bins - 1)).cast("int")
    return b.groupBy("sample_id", place.alias("bin")).agg(F.count("*").alias("n"), F.avg(methylated() + unmethylated()).alias("mean_total"))


def variable_snps(signals: DataFrame, least_range: float = 0.3) -> DataFrame:
    """(sample_id, probe_id, af) of rs probes whose allele frequency varies over samples."""
    af = allele_frequencies(signals).where(F.col("probe_id").startswith("rs"))
    keep = af.groupBy("probe_id").agg((F.max("af") - F.min("af")).alias("r")).where(F.col("r") > least_range)
    return af.join(keep, "probe_id", "left_semi")


def metagene(betas: DataFrame, members: DataFrame) -> DataFrame:
    """(sample_id, bin, beta): mean beta of each bin of a metagene group."""
    return betas.join(members.select("probe_id", F.col("dbname").alias("bin")), "probe_id").groupBy("sample_id", "bin").agg(F.avg("beta").alias("beta"))


def segment_frame(segs: DataFrame, lengths: DataFrame, least_share: float = 0.01) -> DataFrame:
    """Segments of chromosomes of at least a share of the genome, at genome positions."""
    total = lengths.agg(F.sum("length").alias("t"))
    big = lengths.join(F.broadcast(total)).where(F.col("length") > least_share * F.col("t"))  # one row
    before = W.orderBy(chrom_key(F.col("chrom")), "chrom").rowsBetween(W.unboundedPreceding, -1)  # a row a chromosome
    off = big.select("chrom", F.coalesce(F.sum("length").over(before), F.lit(0)).alias("off"))
    return segs.join(F.broadcast(off), "chrom").withColumns({"x0": F.col("start") + F.col("off"), "x1": F.col("end") + F.col("off")})


def reference_heat(references: DataFrame) -> DataFrame:
    """(probe_id, strain, genotype): flipped where exactly one of the two flip flags is set."""
    flip = F.col("flip_to_af") != F.col("flip_for_ref_bias")
    return references.select("probe_id", "strain", F.when(flip, 1 - F.col("genotype")).otherwise(F.col("genotype")).alias("genotype"))


def enrich_all_frame(results: DataFrame, least_estimate: float = 0.0, most_fdr: float = 0.01, cap: float = 300.0) -> DataFrame:
    """(group, dbname, x, estimate, neg_log10_fdr): sets of all groups end to end, groups by name, best sets first."""
    kept = results.where((F.col("estimate") > least_estimate) & (F.col("fdr") < most_fdr))
    kept = kept.withColumn("neg_log10_fdr", F.least(F.lit(cap), -F.log10(F.greatest("fdr", F.lit(2.2250738585072014e-308)))))
    sizes = results.groupBy("group").agg(F.count("*").alias("n"))
    before = W.orderBy("group").rowsBetween(W.unboundedPreceding, -1)  # a row a group
    off = sizes.select("group", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("off"))
    place = F.row_number().over(W.partitionBy("group").orderBy("fdr", "dbname"))
    return kept.withColumn("place", place).join(F.broadcast(off), "group").select("group", "dbname", (F.col("off") + F.col("place")).alias("x"), "estimate", "neg_log10_fdr")


def probe_window(coords: DataFrame, probes: DataFrame, flank: int = 1000) -> DataFrame:
    """(chrom, start, end): the span of some probes with flanks, a row a chromosome."""
    rows = coords.join(probes.select("probe_id").distinct(), "probe_id", "left_semi")
    return rows.groupBy("chrom").agg((F.min("start") - flank).alias("start"), (F.max("end") + flank).alias("end"))


def metric_bars(stats: DataFrame, metrics: list[str]) -> DataFrame:
    """(sample_id, metric, value): a wide metric table made long."""
    pairs = F.array(*(F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value")) for m in metrics))
    return stats.select("sample_id", F.explode(pairs).alias("x")).select("sample_id", "x.*")


def score_curve(values: DataFrame, members: DataFrame) -> DataFrame:
    """(dbname, at, score): the running score of each set where it turns, at its members."""
    from .sets import _positions

    v = values.where("value IS NOT NULL")
    total = v.agg(F.count("*").alias("n"))
    held = members.select("dbname", "probe_id").distinct().join(_positions(v), "probe_id")
    sizes = held.groupBy("dbname").agg(F.count("*").alias("m"))
    rows = held.join(sizes, "dbname").join(F.broadcast(total))  # one row
    k = F.row_number().over(W.partitionBy("dbname").orderBy("at"))
    return rows.select("dbname", "at", (k / F.col("m") - F.try_divide(F.col("at") - k, F.col("n") - F.col("m"))).alias("score"))
