"""Detection: p-values from empirical distributions of background, and channel inference."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions.joins import sample_side, sorted_side
from ..functions.store import stored
from . import masks
from .signal import methylated, mu, mu_out_of_band, out_of_band, unmethylated


def ecdf(background: DataFrame, queries: DataFrame, by: list[str], least: int = 0) -> DataFrame:
    """Adds ``f``, the share of the background (by.., v) at or below each query's v.

    One sort a group: a running count over the tagged union. A group with ``least`` or
    fewer background values (none: zero) is ranked against 1..1000. A null v gives null.
    """
    bg = background.where("v IS NOT NULL").select(*by, "v", F.lit(1).alias("__bg"))
    both = bg.unionByName(queries.withColumn("__bg", F.lit(0)), allowMissingColumns=True)
    running = W.partitionBy(*by).orderBy("v").rangeBetween(W.unboundedPreceding, 0)
    whole = W.partitionBy(*by)
    out = both.withColumns({"__at": F.sum("__bg").over(running), "__n": F.sum("__bg").over(whole)})
    default = F.greatest(F.lit(0.0), F.least(F.lit(1000.0), F.floor("v").cast("double"))) / 1000
    f = F.when(F.col("v").isNull(), F.lit(None)).when(F.col("__n") <= least, default).otherwise(F.col("__at") / F.col("__n"))
    return out.where("__bg = 0").withColumn("f", f).drop("__bg", "__at", "__n")


def p_values(signals: DataFrame, background: DataFrame, least: int = 100) -> DataFrame:
    """(sample_id, probe_id, p): p = min over channels of 1 - F(brighter bead); null if a channel is."""
    ch = F.array(
        F.struct(F.lit("G").alias("channel"), F.greatest("mg", "ug").alias("v")),
        F.struct(F.lit("R").alias("channel"), F.greatest("mr", "ur").alias("v")),
    )
    queries = signals.select("sample_id", "probe_id", F.explode(ch).alias("x")).select("sample_id", "probe_id", "x.*")
    ranked = ecdf(background, queries, ["sample_id", "channel"], least)
    p = F.when(F.count("f") == 2, 1 - F.max("f"))
    return ranked.groupBy("sample_id", "probe_id").agg(p.alias("p"))


def oob_background(signals: DataFrame, nonunique: DataFrame | None = None, controls: DataFrame | None = None) -> DataFrame:
    rows = signals.join(nonunique.select("probe_id").distinct(), "probe_id", "left_anti") if nonunique is not None else signals
    bg = out_of_band(rows).select("sample_id", "channel", "v")
    return bg.unionByName(masks.negative_controls(signals, controls)) if controls is not None else bg


def detect_oob(signals: DataFrame, nonunique: DataFrame | None = None, controls: DataFrame | None = None) -> DataFrame:
    """p-values against out-of-band signal of uniquely mapped probes and negative controls."""
    return p_values(signals, oob_background(signals, nonunique, controls))


def detect_negative(signals: DataFrame, controls: DataFrame) -> DataFrame:
    """p-values against negative controls only."""
    return p_values(signals, masks.negative_controls(signals, controls), least=0)


def mask_undetected(signals: DataFrame, p: DataFrame, threshold: float = 0.05) -> DataFrame:
    out = signals.join(p, ["sample_id", "probe_id"], "left")
    return masks.add_mask_where(out, F.col("p") > threshold).drop("p")


def success_rate(p: DataFrame, threshold: float = 0.05, least: int = 100) -> DataFrame:
    """(sample_id, rate): share of non-null p below the threshold; null with ``least`` or fewer."""
    n = F.count("p")
    return p.groupBy("sample_id").agg(F.when(n > least, F.count_if(F.col("p") < threshold) / n).alias("rate"))


def background_limit(near: pd.DataFrame, counts: np.ndarray, cap: float, jump: float, size: int, margin: float) -> float:
    """The total up to which one sample's signals are background: where betas stop being dispersed.

    ``counts`` has the values of each of the ranges that the windows' starts part, ``near``
    (bin, total, beta) the first ``size`` of each, which is all that a window can hold.
    """
    near = near.sort_values(["bin", "total", "beta"], ignore_index=True)  # ties in one order, however rows arrive
    offset = np.append(0, np.cumsum(counts))
    place = offset[near["bin"].to_numpy()] + near.groupby("bin").cumcount().to_numpy()
    total, beta, first = near["total"].to_numpy(), near["beta"].to_numpy(), offset[1:-1]
    held = np.searchsorted(place, first), np.searchsorted(place, first + size)
    spans = np.array([np.quantile(beta[i:j], [margin, 1 - margin]) if i < j else [np.nan] * 2 for i, j in zip(*held)])
    if spans[0, 1] - spans[0, 0] > 0.5:
        limit = total[min(9, len(total) - 1)]
    else:
        wide = np.flatnonzero((spans[:, 0] - spans[0, 0] < -jump) | (spans[:, 1] - spans[0, 1] > jump))
        at = first[wide[0]] + size - 1 if len(wide) else offset[-1]
        limit = total[np.searchsorted(place, at)] if at < offset[-1] else np.inf
    return float(min(limit, cap))


def background_values(signals: DataFrame, margin: float = 0.05, cap: float = 3000, jump: float = 0.2, windows: int = 500, size: int = 500) -> DataFrame:
    """(sample_id, v): the brighter bead of signals, in and out of band, up to the total where betas stop being dispersed.

    Windows start at ``windows`` totals, evenly on a log scale, and hold ``size`` betas
    each. Values are counted between the starts; of each range only the first ``size``
    values go to their sample's group, so that has (windows + 1) * size rows at most.
    """
    in_ = mu(signals).select("sample_id", "probe_id", "m", "u")
    oo = mu_out_of_band(signals).select("sample_id", "probe_id", F.col("m").alias("m_oo"), F.col("u").alias("u_oo"))
    both = in_.join(sorted_side(oo), ["sample_id", "probe_id"], "left").select("sample_id", F.inline(F.array(F.struct("m", "u"), F.struct(F.col("m_oo").alias("m"), F.col("u_oo").alias("u")))))
    rows = stored(both.where("m IS NOT NULL AND u IS NOT NULL"), "background").withColumn("total", F.col("m") + F.col("u"))
    rows = rows.select("sample_id", "total", F.try_divide("m", "total").alias("beta"), F.greatest("m", "u").alias("v")).where("NOT isnan(total) AND NOT isnan(beta)")

    @F.pandas_udf("array<double>")
    def starts(least: pd.Series, most: pd.Series) -> pd.Series:
        return pd.Series([2 ** np.linspace(np.log2(max(1.0, a - 1)), np.log2(b + 1), windows) for a, b in zip(least, most)])

    def beside(df: DataFrame, side: DataFrame) -> DataFrame:
        return df.join(sample_side(side.withColumnRenamed("sample_id", "__of")), F.col("sample_id").eqNullSafe(F.col("__of"))).drop("__of")

    edges = rows.groupBy("sample_id").agg(F.min("total").alias("least"), F.max("total").alias("most")).select("sample_id", starts("least", "most").alias("edges"))
    # The number of starts below a total: from its logarithm, then set right by the starts beside it.
    low, high = F.log2(F.get("edges", F.lit(0))), F.log2(F.get("edges", F.lit(windows - 1)))
    near = F.coalesce(F.ceil(F.try_divide((F.log2("total") - low) * (windows - 1), high - low)).cast("int"), F.lit(0))
    k = F.least(F.greatest(near, F.lit(0)), F.lit(windows))
    binned = beside(rows, edges).withColumn("bin", k)
    over, under = F.get("edges", F.col("bin") - 1) >= F.col("total"), F.get("edges", F.col("bin")) < F.col("total")
    binned = binned.select("sample_id", "total", "beta", (F.col("bin") - F.when(over, 1).otherwise(0) + F.when(under, 1).otherwise(0)).alias("bin"))
    counts = binned.groupBy("sample_id", "bin").agg(F.count("*").alias("n"))
    rank = F.row_number().over(W.partitionBy("sample_id", "bin").orderBy("total", "beta"))
    firsts = binned.withColumn("rank", rank).where(F.col("rank") <= size).drop("rank")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        known = pdf["n"].notna()
        n = np.zeros(windows + 1, np.int64)
        n[pdf.loc[known, "bin"].to_numpy()] = pdf.loc[known, "n"].to_numpy(np.int64)
        return pd.DataFrame({"sample_id": [pdf["sample_id"].iloc[0]], "limit": [background_limit(pdf[~known], n, cap, jump, size, margin)]})

    tagged = firsts.withColumn("n", F.lit(None).cast("long")).unionByName(counts, allowMissingColumns=True)
    limits = tagged.groupBy("sample_id").applyInPandas(run, "sample_id string, limit double")
    return beside(rows, limits).where(F.col("total") <= F.col("limit")).select("sample_id", "v")


def detect_background(signals: DataFrame, **options) -> DataFrame:
    """(sample_id, probe_id, p): background found from the dispersion of betas; null p becomes 1."""
    queries = mu(signals).select("sample_id", "probe_id", F.when(F.col("m").isNotNull() & F.col("u").isNotNull(), F.greatest("m", "u")).alias("v"))
    ranked = ecdf(background_values(signals, **options), queries, ["sample_id"], least=0)
    return ranked.select("sample_id", "probe_id", F.coalesce(1 - F.col("f"), F.lit(1.0)).alias("p"))


def infer_channel(signals: DataFrame, switch_failed: bool = False, mask_failed: bool = False) -> DataFrame:
    """Signals with ``col`` of type I probes set to the brighter channel, and the old one as ``old_col``.

    Probes below the 95 % quantile of what is out of band under the new colours (or with a
    missing reading) keep their design unless ``switch_failed``.
    """
    r = F.when(F.col("mr").isNotNull() & F.col("ur").isNotNull(), F.greatest("mr", "ur"))
    g = F.when(F.col("mg").isNotNull() & F.col("ug").isNotNull(), F.greatest("mg", "ug"))
    one = F.col("col") != "2"
    rows = signals.withColumns({"__r": F.when(one, r), "__g": F.when(one, g)})
    rows = rows.withColumn("__new", F.when(F.col("__r") > F.col("__g"), "R").when(F.col("__r").isNotNull() & F.col("__g").isNotNull(), "G"))
    outs = F.when(F.col("__new") == "R", F.array("mg", "ug")).when(F.col("__new") == "G", F.array("mr", "ur"))
    limit = rows.select("sample_id", F.explode(outs).alias("v")).groupBy("sample_id").agg(F.percentile("v", F.lit(0.95)).alias("__limit"))
    rows = rows.join(sample_side(limit), "sample_id", "left")
    failed = one & (F.col("__r").isNull() | F.col("__g").isNull() | F.coalesce(F.greatest("__r", "__g") < F.col("__limit"), F.lit(False)))
    new = F.col("__new") if switch_failed else F.when(~failed, F.col("__new"))
    rows = rows.withColumns({"old_col": F.col("col"), "__failed": failed, "__to": F.when(one, F.coalesce(new, "col")).otherwise(F.col("col"))})
    mask = F.col("mask") | F.col("__failed") if mask_failed else F.col("mask")
    return rows.withColumns({"col": F.col("__to"), "mask": mask}).drop("__r", "__g", "__new", "__limit", "__failed", "__to")


def channel_summary(signals: DataFrame, **options) -> DataFrame:
    """(sample_id, r2r, g2g, r2g, g2r) counts of type I probes."""
    rows = infer_channel(signals, **options).where("old_col <> '2'")
    count = lambda a, b: F.count_if((F.col("old_col") == a) & (F.col("col") == b)).alias(f"{a}2{b}".lower())
    return rows.groupBy("sample_id").agg(count("R", "R"), count("G", "G"), count("R", "G"), count("G", "R"))
