"""Background, dye-bias and design normalisation of signals."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions import normal, stats
from ..functions.joins import sample_side, small_side
from ..functions.store import stored
from . import masks
from .detect import oob_background
from .qc import dye_bias
from .signal import in_band, mean_intensity, out_of_band

CHANNELS = {"mg": "G", "ug": "G", "mr": "R", "ur": "R"}


def _per_channel(signals: DataFrame, values: DataFrame, names: list[str]) -> DataFrame:
    """Joins (sample_id, channel, names..) as <name>_g and <name>_r; a row a sample."""
    wide = values.groupBy("sample_id").agg(*(F.max(F.when(F.col("channel") == c.upper(), F.col(n))).alias(f"{n}_{c}") for n in names for c in "gr"))
    return signals.join(sample_side(wide), "sample_id", "left")


def scrub(signals: DataFrame) -> DataFrame:
    """Subtracts each channel's median of unmasked out-of-band signal; floor 1."""
    bg = out_of_band(signals).where("NOT mask").groupBy("sample_id", "channel").agg(F.median("v").alias("bg"))
    rows = _per_channel(signals, bg, ["bg"])
    new = {c: F.when(F.col(c).isNotNull(), F.greatest(F.lit(1.0), F.col(c) - F.coalesce(f"bg_{k.lower()}", F.lit(0.0)))) for c, k in CHANNELS.items()}
    return rows.withColumns(new).drop("bg_g", "bg_r")


def noob_fits(signals: DataFrame, nonunique: DataFrame | None = None, controls: DataFrame | None = None, least: int = 100, cap_iqr: float = 10, floor: float = 10) -> DataFrame:
    """(sample_id, channel, mu, sigma, alpha, n): normal-exponential parameters from background and in-band signal."""
    keep = signals.join(nonunique.select("probe_id").distinct(), "probe_id", "left_anti") if nonunique is not None else signals
    two = keep.where("col = '2'").select("sample_id", F.explode(F.array(F.struct(F.lit("G").alias("channel"), F.col("ug").alias("v")), F.struct(F.lit("R").alias("channel"), F.col("ur").alias("v")))).alias("x"))
    inside = in_band(keep).select("sample_id", "channel", "v").unionByName(two.select("sample_id", "x.*")).withColumn("bg", F.lit(False))
    both = inside.unionByName(oob_background(signals, nonunique, controls).withColumn("bg", F.lit(True))).where("v IS NOT NULL")

    # Intensities repeat, so a value is a row, however many probes have it.
    whole = F.count_if(F.col("bg") & (F.col("v") > 0))
    n = both.groupBy("sample_id", "channel").agg(whole.alias("n"))
    x = stored(both.groupBy("sample_id", "channel", "bg", F.when(F.col("v") == 0, 1.0).otherwise(F.col("v")).cast("double").alias("v")).agg(F.count("*").alias("c")), "noob-values")
    quartiles = x.where("bg").groupBy("sample_id", "channel").agg(F.percentile("v", [0.25, 0.5, 0.75], F.col("c")).alias("q"))
    cap = F.col("q")[1] + cap_iqr * (F.col("q")[2] - F.col("q")[0])
    kept = x.join(quartiles.select("sample_id", "channel", cap.alias("cap")), ["sample_id", "channel"], "left").where("NOT bg OR v < cap").drop("cap")
    found = huber(stored(kept, "noob-kept"), ["sample_id", "channel", "bg"])
    side = lambda name, bg: F.max(F.when(F.col("bg") == bg, F.col(name)))
    wide = found.groupBy("sample_id", "channel").agg(side("mu", True).alias("mu"), side("s", True).alias("sigma"), side("mu", False).alias("inside"))
    rows = n.join(wide, ["sample_id", "channel"], "left")
    ok = (F.col("n") >= least) & F.col("inside").isNotNull() & F.col("mu").isNotNull()
    fit = {"mu": F.col("mu"), "sigma": F.col("sigma"), "alpha": F.greatest(F.col("inside") - F.col("mu"), F.lit(float(floor)))}
    return rows.select("sample_id", "channel", *(F.when(ok, v).alias(k) for k, v in fit.items()), "n")


def huber(values: DataFrame, by: list[str], k: float = 1.5, tol: float = 1e-6, chained: int = 8) -> DataFrame:
    """(by.., mu, s): Huber's location of weighted values (by.., v, c) and the scaled median deviation.

    All groups go through their rounds together: a round is one aggregation of the values
    clipped at their group's bounds, summed by part before it is shuffled, and a group that
    moves by less than ``tol`` deviations rests. A group without spread has no location.
    """
    start = values.groupBy(*by).agg(F.percentile("v", F.lit(0.5), F.col("c")).alias("mu"))
    apart = values.join(start, by).groupBy(*by, "mu").agg((F.percentile(F.abs(F.col("v") - F.col("mu")), F.lit(0.5), F.col("c")) * 1.4826).alias("s"))
    state = stored(apart.select(*by, F.when(F.col("s") > 0, F.col("mu")).alias("mu"), F.when(F.col("s") > 0, F.col("s")).alias("s"), (F.col("s") <= 0).alias("rests")), "huber")
    groups = state.count()
    side = F.broadcast if groups <= 500_000 else (lambda df: df)  # a row a group, counted
    while not state.where("NOT rests").isEmpty():
        for _ in range(chained):
            clipped = F.least(F.greatest(F.col("v"), F.col("mu") - k * F.col("s")), F.col("mu") + k * F.col("s"))
            moved = values.join(side(state), by).groupBy(*by).agg(F.first("mu").alias("mu"), F.first("s").alias("s"), F.first("rests").alias("rests"), (F.sum(F.col("c") * clipped) / F.sum("c")).alias("new"))
            near = F.col("rests") | (F.abs(F.col("mu") - F.col("new")) < tol * F.col("s"))
            state = moved.select(*by, F.when(near, F.col("mu")).otherwise(F.col("new")).alias("mu"), "s", near.alias("rests"))
        state = stored(state, "huber")
    return state.select(*by, "mu", "s")


def noob(signals: DataFrame, nonunique: DataFrame | None = None, controls: DataFrame | None = None, offset: float = 15) -> DataFrame:
    """Normal-exponential background correction; samples without enough background are left as they are."""
    fits = stored(noob_fits(signals, nonunique, controls), "noob-fits")
    wide = fits.groupBy("sample_id").agg(*(F.max(F.when(F.col("channel") == c.upper(), F.col(n))).alias(f"{n}_{c}") for n in ("mu", "sigma", "alpha") for c in "gr"))
    rows = signals.join(small_side(wide), "sample_id", "left")
    rows = rows.withColumns({f"y_{c}": F.expr(normal.standardised(c, *(f"{n}_{k.lower()}" for n in ("mu", "sigma", "alpha")))) for c, k in CHANNELS.items()})
    new, ok = {}, F.col("mu_g").isNotNull() & F.col("mu_r").isNotNull()
    for c, k in CHANNELS.items():
        fixed = F.expr(normal.expected_signal(c, *(f"{n}_{k.lower()}" for n in ("mu", "sigma", "alpha")), f"y_{c}"))
        new[c] = F.when(F.col(c).isNotNull() & ok, fixed + offset).otherwise(F.col(c))
    return rows.withColumns(new).select(*signals.columns)


def scrub_soft(signals: DataFrame) -> DataFrame:
    """As noob, from unmasked out-of-band signal alone and without an offset."""
    masked = signals.where("mask").select("probe_id").distinct()
    return noob(signals, masked, None, offset=0)


def dye_linear(signals: DataFrame, reference: DataFrame | None = None, both_beads: bool = False) -> DataFrame:
    """Scales each channel so that the median of its unmasked in-band M meets the reference.

    The reference (sample_id, ref) is the mean intensity by default. ``both_beads`` takes M
    and U for the median.
    """
    ref = reference if reference is not None else mean_intensity(signals).select("sample_id", F.col("mean_intensity").alias("ref"))
    m = F.when(F.col("col") == "G", F.col("mg")).otherwise(F.col("mr"))
    one = signals.where("col <> '2' AND NOT mask")
    beads = in_band(one) if both_beads else one.select("sample_id", F.col("col").alias("channel"), m.alias("v"))
    med = beads.groupBy("sample_id", "channel").agg(F.median("v").alias("med")).join(ref, "sample_id")
    return _scaled(signals, med.withColumn("factor", F.try_divide("ref", "med")))


def _scaled(signals: DataFrame, factors: DataFrame) -> DataFrame:
    rows = _per_channel(signals, factors, ["factor"])
    return rows.withColumns({c: F.col(c) * F.coalesce(f"factor_{k.lower()}", F.lit(1.0)) for c, k in CHANNELS.items()}).drop("factor_g", "factor_r")


def dye_controls(signals: DataFrame, controls: DataFrame, reference: DataFrame | None = None) -> DataFrame:
    """Scales each channel so that its normalisation controls' mean meets the reference."""
    ref = reference if reference is not None else mean_intensity(signals).select("sample_id", F.col("mean_intensity").alias("ref"))
    mean = masks.normalisation_controls(signals, controls).groupBy("sample_id", "channel").agg(F.avg("v").alias("m"))
    return _scaled(signals, mean.join(ref, "sample_id").withColumn("factor", F.try_divide("ref", "m")))


def most_balanced(signals: DataFrame, controls: DataFrame) -> DataFrame:
    """(sample_id, ref): the mean of control intensities of the sample whose channels are most alike, for all samples."""
    mean = masks.normalisation_controls(signals, controls).groupBy("sample_id").agg(
        F.avg(F.when(F.col("channel") == "G", F.col("v"))).alias("g"), F.avg(F.when(F.col("channel") == "R", F.col("v"))).alias("r")
    )
    best = mean.agg(F.min_by((F.col("g") + F.col("r")) / 2, F.struct(F.abs(F.try_divide("g", "r") - 1), "sample_id")).alias("ref"))
    return signals.select("sample_id").distinct().join(F.broadcast(best))  # one row


def _curve(own: tuple[np.ndarray, np.ndarray], other: tuple[np.ndarray, np.ndarray], v: np.ndarray) -> np.ndarray:
    """``v`` by the map of a channel's values halfway to the other's distribution.

    Both channels are (distinct values in order, how often each is there); the mean rank of
    a value is read off the other's values.
    """
    x, c = own
    rank = np.cumsum(c) - c + (c - 1) / 2
    n, l = c.sum(), other[1].sum()
    at = rank / max(n - 1, 1) * (l - 1)
    below, upto = np.floor(at), np.cumsum(other[1])
    low, high = (other[0][np.searchsorted(upto, np.minimum(i, l - 1), side="right")] for i in (below, below + 1))
    y = (x + low + (at - below) * (high - low)) / 2
    out = np.where(v > x[-1], v - x[-1] + y[-1], np.interp(v, x, y))
    return np.where(v < x[0], y[0] / x[0] * v if x[0] else v, out)


def dye_nonlinear(signals: DataFrame, include_masked: bool = True, most_distorted: float = 10) -> DataFrame:
    """Maps red and green in-band distributions onto their middle.

    Where the channels' distortion is unknown or too large, the green type I probes are
    masked instead. Readings repeat, so they are counted by value; a sample's group has a
    row a distinct value, and readings meet their new values in joins.
    """
    sides = sample_side(dye_bias(signals).select("sample_id", F.coalesce(F.col("rgdistort") <= most_distorted, F.lit(False)).alias("__ok")))
    rows = signals.join(sides, "sample_id", "left").withColumn("__ok", F.coalesce("__ok", F.lit(False)))
    used = lambda k: (F.col("col") == k) & (F.lit(True) if include_masked else ~F.col("mask"))
    beads = F.array(*(F.struct(F.lit(k).alias("channel"), F.col(c).cast("double").alias("v"), used(k).alias("own")) for c, k in CHANNELS.items()))
    values = rows.where("__ok").select("sample_id", F.inline(beads)).where("v IS NOT NULL AND NOT isnan(v)").groupBy("sample_id", "channel", "v").agg(F.count_if("own").alias("n"))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        parts = {k: pdf[pdf["channel"] == k].sort_values("v") for k in "GR"}
        own = {k: (d["v"].to_numpy()[(n := d["n"].to_numpy()) > 0], n[n > 0]) for k, d in parts.items()}
        if not all(len(x) and x[-1] > 0 for x, _ in own.values()):
            return pdf[["sample_id", "channel", "v"]].assign(new=pdf["v"])
        return pd.concat([d[["sample_id", "channel", "v"]].assign(new=_curve(own[k], own["R" if k == "G" else "G"], d["v"].to_numpy())) for k, d in parts.items()])

    curves = stored(values.groupBy("sample_id").applyInPandas(run, "sample_id string, channel string, v double, new double"), "dye-curves")
    for c, k in CHANNELS.items():
        one = curves.where(F.col("channel") == k).select("sample_id", F.col("v").alias(c), F.col("new").alias(f"__{c}"))
        rows = rows.join(small_side(one), ["sample_id", c], "left")
    rows = rows.withColumns({c: F.when(F.col("__ok"), F.col(f"__{c}")).otherwise(F.col(c)) for c in CHANNELS})
    return rows.withColumn("mask", F.when(F.col("__ok"), F.col("mask")).otherwise(F.col("mask") | (F.col("col") == "G"))).select(*signals.columns)


def match_design(signals: DataFrame, min_gap: float = 0.3) -> DataFrame:
    """Maps unmasked type I betas onto type II's, state by state of a beta mixture; M = U b / (1 - b)."""
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in signals.schema)

    def betas(pdf: pd.DataFrame, m: str, u: str) -> np.ndarray:
        a, b = pdf[m].to_numpy(float), pdf[u].to_numpy(float)
        return np.where(np.isnan(a) | np.isnan(b), np.nan, np.fmax(a, 1) / np.fmax(a + b, 2))

    def states(x: np.ndarray, starts: list[float]) -> np.ndarray:
        cuts = stats.beta_mixture(x, starts)
        return np.where(np.isnan(x), -1, np.searchsorted(sorted(cuts), x, side="left"))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.reset_index(drop=True)
        shown = ~pdf["mask"].to_numpy(bool)
        two = betas(pdf[(pdf["col"] == "2") & shown], "ug", "ur")
        two = np.sort(two[~np.isnan(two)])
        if len(two) < 2:
            return pdf
        s = states(two, [0.5])
        low, high = two[s == 0], two[s == 1]
        gap = abs(stats.mode(low) - stats.mode(high)) if len(low) > 1 and len(high) > 1 else 0.0
        if len(low) > 100 and len(high) > 100 and gap > 0.7:
            starts = [0.2, 0.7]
        elif len(low) < 10 or len(high) < 10 or gap < min_gap or stats.valley(low, high) >= 0.8:
            starts = []
        else:
            starts = [0.5]
        target = states(two, starts) if starts else np.zeros(len(two), int)
        for c, m, u in (("G", "mg", "ug"), ("R", "mr", "ur")):
            at = np.flatnonzero((pdf["col"] == c).to_numpy() & shown)
            b = betas(pdf.loc[at], m, u)
            own = states(b, starts) if starts else np.where(np.isnan(b), -1, 0)
            new = pdf[m].to_numpy(float).copy()
            for k in range(len(starts) + 1):
                if (own == k).any() and (target == k).any():
                    mapped = np.clip(stats.to_target(b[own == k], two[target == k]), 0, 1 - 1e-9)
                    new[at[own == k]] = pdf[u].to_numpy(float)[at[own == k]] * mapped / (1 - mapped)
            pdf[m] = new
        return pdf

    return signals.groupBy("sample_id").applyInPandas(run, schema)
