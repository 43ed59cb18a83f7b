"""Quality metrics: one row a sample, a group of columns for each metric group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .detect import channel_summary, ecdf
from .signal import methylated, mu, unmethylated

KINDS = ("cg", "ch", "rs")


def detection(signals: DataFrame, p: DataFrame, threshold: float = 0.05) -> DataFrame:
    """num_dtna, frac_dtna, num_dt, frac_dt: missing and detected (p <= threshold) probes; _mk: unmasked only."""
    rows = signals.select("sample_id", "probe_id", "mask").join(p, ["sample_id", "probe_id"], "left")
    hit, total = F.col("p") <= threshold, F.count("*")
    out = [
        F.count_if(F.col("p").isNull()).alias("num_dtna"), (F.count_if(F.col("p").isNull()) / total).alias("frac_dtna"),
        F.count_if(hit).alias("num_dt"), F.try_divide(F.count_if(hit), F.count("p")).alias("frac_dt"),
    ]
    for name, where in [("mk", ~F.col("mask"))] + [(k, F.col("probe_id").startswith(k)) for k in KINDS]:
        out += [F.count_if(hit & where).alias(f"num_dt_{name}"), F.try_divide(F.count_if(hit & where), F.count(F.when(where, F.col("p")))).alias(f"frac_dt_{name}")]
    return rows.groupBy("sample_id").agg(*out)


def counts(signals: DataFrame) -> DataFrame:
    n = [F.count("*").alias("num_probes")]
    n += [F.count_if(F.col("col") == c).alias(f"num_probes_{k}") for k, c in (("ii", "2"), ("ir", "R"), ("ig", "G"))]
    n += [F.count_if(F.col("probe_id").startswith(k)).alias(f"num_probes_{k}") for k in KINDS]
    return signals.groupBy("sample_id").agg(*n)


def _mean(columns: list[Column], where: Column) -> Column:
    held = [F.when(where, c) for c in columns]
    total = sum((F.coalesce(F.sum(c), F.lit(0.0)) for c in held[1:]), F.coalesce(F.sum(held[0]), F.lit(0.0)))
    return F.try_divide(total, sum((F.count(c) for c in held[1:]), F.count(held[0])))


def intensity(signals: DataFrame) -> DataFrame:
    """Mean intensities in and out of band, and missing beads of unmasked probes."""
    rows = mu(signals)
    shown, always = ~F.col("mask"), F.lit(True)
    m, u = F.col("m"), F.col("u")
    g, r, two = F.col("col") == "G", F.col("col") == "R", F.col("col") == "2"
    green, red = [F.col("mg"), F.col("ug")], [F.col("mr"), F.col("ur")]
    missing = lambda c, w: F.count_if(c.isNull() & w)
    return rows.groupBy("sample_id").agg(
        _mean([m, u], shown).alias("mean_intensity"), _mean([m, u], always).alias("mean_intensity_mu"), _mean([m, u], two).alias("mean_ii"),
        _mean(green, g).alias("mean_inb_grn"), _mean(red, r).alias("mean_inb_red"), _mean(green, r).alias("mean_oob_grn"), _mean(red, g).alias("mean_oob_red"),
        missing(m, shown).alias("na_intensity_m"), missing(u, shown).alias("na_intensity_u"),
        *((missing(m, w & shown) + missing(u, w & shown)).alias(f"na_intensity_{k}") for k, w in (("ig", g), ("ir", r), ("ii", two))),
    )


def channel(signals: DataFrame) -> DataFrame:
    out = channel_summary(signals)
    return out.select("sample_id", *(F.col(c).alias(f"switch_{c}") for c in ("r2r", "g2g", "r2g", "g2r")))


def dye_bias(signals: DataFrame, top: int = 20) -> DataFrame:
    """medr, medg, topr, topg (median of the brightest), rgratio and rgdistort of type I in-band signal."""
    from .signal import in_band

    v = in_band(signals).where("v IS NOT NULL")
    ranked = v.withColumn("n", F.row_number().over(W.partitionBy("sample_id", "channel").orderBy(F.col("v").desc())))
    of = lambda c, w=F.lit(True): F.median(F.when((F.col("channel") == c) & w, F.col("v")))
    first = F.col("n") <= top
    out = ranked.groupBy("sample_id").agg(of("R").alias("medr"), of("G").alias("medg"), of("R", first).alias("topr"), of("G", first).alias("topg"))
    ratio = F.try_divide("medr", "medg")
    return out.withColumns({"rgratio": ratio, "rgdistort": F.try_divide(F.try_divide("topr", "topg"), ratio)})


def beta_metrics(betas: DataFrame) -> DataFrame:
    """Mean, median, shares below 0.3 and above 0.7, and nulls; of all probes and of each kind."""
    out = []
    for name, where in [("", F.lit(True))] + [(f"_{k}", F.col("probe_id").startswith(k)) for k in KINDS]:
        b = F.when(where, F.col("beta"))
        n, all_ = F.count(b), F.count_if(where)
        out += [
            F.avg(b).alias(f"mean_beta{name}"), F.median(b).alias(f"median_beta{name}"), F.try_divide(F.count_if(b < 0.3), n).alias(f"frac_unmeth{name}"),
            F.try_divide(F.count_if(b > 0.7), n).alias(f"frac_meth{name}"), (all_ - n).alias(f"num_na{name}"), F.try_divide(all_ - n, all_).alias(f"frac_na{name}"),
        ]
    return betas.groupBy("sample_id").agg(*out)


GROUPS = {"numProbes": counts, "intensity": intensity, "channel": channel, "dyeBias": dye_bias}


def metrics(signals: DataFrame, p: DataFrame | None = None, betas: DataFrame | None = None, groups: list[str] | None = None) -> DataFrame:
    """The chosen groups side by side; detection needs ``p`` and betas need ``betas``."""
    chosen = groups or [*GROUPS, *(["detection"] if p is not None else []), *(["betas"] if betas is not None else [])]
    parts = []
    for g in chosen:
        if g == "detection":
            parts.append(detection(signals, p))
        elif g == "betas":
            parts.append(beta_metrics(betas))
        elif g in GROUPS:
            parts.append(GROUPS[g](signals))
        else:
            raise ValueError(f"no metric group {g}")
    out = parts[0]
    for other in parts[1:]:
        out = out.join(other, "sample_id", "full")
    return out


def rank_against(stats: DataFrame, public: DataFrame, columns: list[str]) -> DataFrame:
    """(sample_id, metric, value, rank, n): share of public samples at or below each value."""
    pairs = F.array(*(F.struct(F.lit(c).alias("metric"), F.col(c).cast("double").alias("v")) for c in columns))
    long = lambda df, *keep: df.select(*keep, F.explode(pairs).alias("x")).select(*keep, "x.*")
    bg = long(public)
    out = ecdf(bg, long(stats, "sample_id"), ["metric"])
    n = bg.where("v IS NOT NULL").groupBy("metric").agg(F.count("*").alias("n"))
    return out.join(F.broadcast(n), "metric", "left").select("sample_id", "metric", F.col("v").alias("value"), F.col("f").alias("rank"), "n")  # a row a metric


def bisulfite_control(signals: DataFrame, extended_c: DataFrame, extended_t: DataFrame) -> DataFrame:
    """(sample_id, gct): mean green signal of red type I probes that extend into C over that of probes that extend into T.

    Complete conversion gives about one. Null where either set has no reading.
    """
    side = lambda df, name: df.select("probe_id").distinct().withColumn("__ext", F.lit(name))
    red = signals.where("col = 'R'").select("sample_id", "probe_id", F.explode(F.array("mg", "ug")).alias("v"))
    rows = red.join(side(extended_c, "C").unionByName(side(extended_t, "T")), "probe_id")
    mean = lambda name: F.avg(F.when(F.col("__ext") == name, F.col("v")))
    return rows.groupBy("sample_id").agg(F.try_divide(mean("C"), mean("T")).alias("gct"))
