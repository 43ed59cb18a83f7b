"""Copy number: signal against normal samples, bins, and segments."""

from __future__ import annotations

import numpy as np
import pandas as pd
import zlib

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.stats import circular_segments
from .ranges import count_overlaps, merge_small, minus_gaps, overlap_join, tiles
from .signal import total_intensities


def signal(signals: DataFrame, normals: list[str], coords: DataFrame | None = None) -> DataFrame:
    """(sample_id, probe_id, cn): log2 of a target's total intensity over its fit on all the normals.

    One regression a target, with a coefficient for each normal, over the probes that
    ``coords`` has and that are measured in the target and in all normals. It is solved
    from means and covariances, one row a target; normals that depend on each other share
    their weight. The fit is floored at 1; a target without intensity has no signal.
    """
    total = total_intensities(signals).select("sample_id", "probe_id", "total").where("total IS NOT NULL")
    if coords is not None:
        total = total.join(coords.select("probe_id").distinct(), "probe_id", "left_semi")
    xs = [f"x{i}" for i in range(len(normals))]
    each = [F.max(F.when(F.col("sample_id") == n, F.col("total"))).alias(x) for n, x in zip(normals, xs)]
    base = total.where(F.col("sample_id").isin(normals)).groupBy("probe_id").agg(*each).dropna(subset=xs)
    rows = total.where(~F.col("sample_id").isin(normals)).join(base, "probe_id")
    pairs = [F.covar_pop(x, y) for i, x in enumerate(xs) for y in xs[: i + 1]]
    moments = rows.groupBy("sample_id").agg(F.array(*pairs).alias("xx"), F.array(*(F.covar_pop(x, "total") for x in xs)).alias("xy"), F.array(*map(F.avg, xs), F.avg("total")).alias("mean"))

    @F.pandas_udf("array<double>")
    def solved(xx: pd.Series, xy: pd.Series, mean: pd.Series) -> pd.Series:
        k, out = len(xs), []
        low = np.tril_indices(k)
        for a, b, m in zip(xx, xy, mean):  # a row a target
            full = np.zeros((k, k))
            full[low] = a
            full = full + np.tril(full, -1).T
            slope = np.linalg.pinv(full, rcond=1e-12, hermitian=True) @ np.asarray(b, float)
            out.append([*slope, m[k] - slope @ np.asarray(m[:k], float)])
        return pd.Series(out)

    line = moments.select("sample_id", solved("xx", "xy", "mean").alias("w"))
    fit = F.col("w")[len(xs)]
    for i, x in enumerate(xs):
        fit = fit + F.col("w")[i] * F.col(x)
    return rows.join(line, "sample_id").select("sample_id", "probe_id", F.when(F.col("total") > 0, F.log2(F.col("total") / F.greatest(fit, F.lit(1.0)))).alias("cn"))


def bins(lengths: DataFrame, gaps: DataFrame, coords: DataFrame, width: int = 50_000, least: int = 20) -> DataFrame:
    """(chrom, start, end, n): tiles less gaps, small ones merged."""
    pieces = minus_gaps(tiles(lengths, width), gaps, width)
    counted = count_overlaps(pieces, coords.select("chrom", "start", "end"), ["chrom", "start", "end"], width)
    return merge_small(counted, least)


def bin_signals(cn: DataFrame, coords: DataFrame, bins: DataFrame, width: int = 50_000) -> DataFrame:
    """(sample_id, chrom, start, end, n, cn): a bin's median signal."""
    placed = overlap_join(bins.select("chrom", "start", "end"), coords.select("chrom", "start", "end", "probe_id"), width)
    rows = placed.select("chrom", "start", "end", "probe_id").join(cn, "probe_id")
    return rows.groupBy("sample_id", "chrom", "start", "end").agg(F.count("*").alias("n"), F.median("cn").alias("cn"))


def segments(binned: DataFrame, alpha: float = 0.001, least: int = 5, permutations: int = 10_000, undo: float = 2.2, seed: int = 1) -> DataFrame:
    """(sample_id, chrom, start, end, bins, mean): circular binary segmentation of each chromosome."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("start")
        name, chrom = pdf["sample_id"].iloc[0], pdf["chrom"].iloc[0]
        x, a, b = (pdf[c].to_numpy() for c in ("cn", "start", "end"))
        x = x.astype(float)
        found = circular_segments(x, alpha, least, permutations, undo, seed + zlib.crc32(f"{name}{chrom}".encode()))
        return pd.DataFrame([(name, chrom, int(a[i]), int(b[j - 1]), j - i, float(np.mean(x[i:j]))) for i, j in found], columns=["sample_id", "chrom", "start", "end", "bins", "mean"])

    return binned.where("cn IS NOT NULL").groupBy("sample_id", "chrom").applyInPandas(run, "sample_id string, chrom string, start long, end long, bins long, mean double")
