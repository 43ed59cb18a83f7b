"""Views and arithmetic on signal tables (sample_id, probe_id, mg, mr, ug, ur, col, mask).

Missing readings are nulls. Where arithmetic floors a value, a null stays null: Spark's
``greatest`` skips nulls, so floors are guarded.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def floored(x: Column, low: float) -> Column:
    return F.when(x.isNotNull(), F.greatest(x, F.lit(low)))


def methylated() -> Column:
    return F.when(F.col("col") == "G", F.col("mg")).when(F.col("col") == "R", F.col("mr")).otherwise(F.col("ug"))


def unmethylated() -> Column:
    return F.when(F.col("col") == "G", F.col("ug")).otherwise(F.col("ur"))


def signal_table(df: DataFrame) -> DataFrame:
    """Keeps the seven columns of a signal table; a missing design is type II."""
    have = {c.lower(): c for c in df.columns}
    named = [F.col(have[c]).cast("double").alias(c) for c in ("mg", "mr", "ug", "ur")]
    return df.select("sample_id", F.col(have["probe_id"]).alias("probe_id"), *named, F.coalesce(F.col("col"), F.lit("2")).alias("col"), F.coalesce(F.col("mask"), F.lit(False)).alias("mask"))


def mu(signals: DataFrame, drop_masked: bool = False, total: bool = False) -> DataFrame:
    """In-band (m, u) of each probe, and m + u on request."""
    out = signals.where(~F.col("mask")) if drop_masked else signals
    out = out.withColumns({"m": methylated(), "u": unmethylated()})
    return out.withColumn("mu", F.col("m") + F.col("u")) if total else out


def mu_out_of_band(signals: DataFrame) -> DataFrame:
    """(m, u) of type I probes in the channel that their design does not use."""
    green = F.col("col") == "G"
    rows = signals.where(F.col("col") != "2")
    return rows.withColumns({"m": F.when(green, F.col("mr")).otherwise(F.col("mg")), "u": F.when(green, F.col("ur")).otherwise(F.col("ug"))})


def out_of_band(signals: DataFrame) -> DataFrame:
    """(sample_id, probe_id, channel, v): green from red probes and red from green probes; both beads."""
    green = F.col("col") == "R"
    beads = F.when(green, F.array("mg", "ug")).otherwise(F.array("mr", "ur"))
    rows = signals.where(F.col("col") != "2").withColumn("channel", F.when(green, "G").otherwise("R"))
    keep = [c for c in ("pk", "mask") if c in signals.columns]
    return rows.select("sample_id", "probe_id", *keep, "channel", F.explode(beads).alias("v"))


def in_band(signals: DataFrame) -> DataFrame:
    """(sample_id, probe_id, channel, v): both in-band beads of type I probes."""
    green = F.col("col") == "G"
    beads = F.when(green, F.array("mg", "ug")).otherwise(F.array("mr", "ur"))
    rows = signals.where(F.col("col") != "2")
    keep = [c for c in ("pk", "mask") if c in signals.columns]
    return rows.select("sample_id", "probe_id", *keep, F.col("col").alias("channel"), F.explode(beads).alias("v"))


def beta_column(sum_type_one: bool = False) -> Column:
    m, u = methylated(), unmethylated()
    out = floored(m, 1.0) / floored(m + u, 2.0)
    if sum_type_one:
        top, all_ = F.col("mg") + F.col("mr"), F.col("mg") + F.col("mr") + F.col("ug") + F.col("ur")
        out = F.when(F.col("col") != "2", floored(top, 1.0) / floored(all_, 2.0)).otherwise(out)
    return out


def betas(signals: DataFrame, mask: bool = True, sum_type_one: bool = False) -> DataFrame:
    """Adds ``beta``; masked probes get null unless ``mask`` is false."""
    value = beta_column(sum_type_one)
    return signals.withColumn("beta", F.when(~F.col("mask"), value) if mask else value)


def total_intensities(signals: DataFrame, mask: bool = False) -> DataFrame:
    out = mu(signals, total=True).withColumnRenamed("mu", "total")
    return out.withColumn("total", F.when(~F.col("mask"), F.col("total"))) if mask else out


def beta_to_m(beta: Column) -> Column:
    """log2(b / (1 - b)); minus and plus infinity at 0 and 1."""
    inf = F.lit(float("inf"))
    return F.when(beta <= 0, -inf).when(beta >= 1, inf).otherwise(F.log2(F.try_divide(beta, 1 - beta)))


def m_to_beta(m: Column) -> Column:
    return F.when(m == float("inf"), F.lit(1.0)).otherwise(F.pow(F.lit(2.0), m) / (1 + F.pow(F.lit(2.0), m)))


def design_type(probe_id: Column) -> Column:
    """Design digit of a suffixed id (third character after the underscore)."""
    suffix = F.try_element_at(F.split(probe_id, "_"), F.lit(2))
    return F.when(suffix.isNull(), F.raise_error(F.concat(F.lit("id without a design suffix: "), probe_id))).otherwise(F.substring(suffix, 3, 1))


def dichotomised(x: Column, low: float = 0.15, high: float = 0.85) -> Column:
    return F.when(x > high, F.lit(1.0)).when(x < low, F.lit(0.0)).otherwise((x - low) / (high - low))


def type_one_af(signals: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """Allele frequency of type I probes: out-of-band over all beads, with floors 1 and 2."""
    o = mu_out_of_band(signals)
    out = F.col("m") + F.col("u")
    in_ = methylated() + unmethylated()
    rows = o.withColumn("af", floored(out, 1.0) / floored(out + in_, 2.0))
    rows = rows.join(known.select("probe_id").distinct(), "probe_id", "left_semi") if known is not None else rows
    return rows.select("sample_id", "probe_id", "af")


def allele_frequencies(signals: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """Betas of the ``rs`` probes and allele frequencies of type I probes."""
    rs = betas(signals, mask=False).where(F.col("probe_id").startswith("rs"))
    return rs.select("sample_id", "probe_id", F.col("beta").alias("af")).unionByName(type_one_af(signals, known))


def genotype(af: Column, n: int = 40) -> Column:
    """Struct (gt, gs, l0, l1, l2): binomial likelihoods at allele frequencies 0.1, 0.5 and 0.9."""
    k = F.round(af * n)
    log_choose = F.element_at(F.array(*(F.lit(v) for v in _log_choose(n))), k.cast("int") + 1)
    like = [F.exp(log_choose + k * F.ln(F.lit(p)) + (n - k) * F.ln(F.lit(1 - p))) for p in (0.1, 0.5, 0.9)]
    top, total = F.greatest(*like), like[0] + like[1] + like[2]
    gt = F.when(like[0] == top, "0/0").when(like[1] == top, "0/1").otherwise("1/1")
    wrong = total - top
    gs = F.when(wrong / total <= 0, F.lit(2147483647)).otherwise(F.floor(-10 * F.log10(wrong / total)).cast("int"))
    return F.struct(F.when(af.isNotNull(), gt).alias("gt"), F.when(af.isNotNull(), gs).alias("gs"))


def _log_choose(n: int) -> list[float]:
    from math import lgamma

    return [lgamma(n + 1) - lgamma(k + 1) - lgamma(n - k + 1) for k in range(n + 1)]


def prefix(probe_id: Column) -> Column:
    return F.element_at(F.split(probe_id, "_"), 1)


def collapse_mean(betas: DataFrame) -> DataFrame:
    """Mean beta a sample and id prefix; nulls are left out, all-null prefixes stay null."""
    return betas.groupBy("sample_id", prefix(F.col("probe_id")).alias("probe_id")).agg(F.avg("beta").alias("beta"))


def collapse_least_p(signals: DataFrame, p: str = "p") -> DataFrame:
    """One row a sample and prefix: the least mask + p (ties: first id); ids become prefixes."""
    out = signals.withColumn("__pfx", prefix(F.col("probe_id")))
    key = F.struct((F.col("mask").cast("double") + F.col(p)).isNull().alias("none"), (F.col("mask").cast("double") + F.col(p)).alias("v"), "probe_id")
    rest = F.struct(*[c for c in signals.columns if c != "sample_id"])
    best = out.groupBy("sample_id", "__pfx").agg(F.min_by(rest, key).alias("x"))  # partial aggregation, no sort
    return best.select("sample_id", F.col("__pfx").alias("probe_id"), *(f"x.{c}" for c in signals.columns if c not in ("sample_id", "probe_id")))


def mean_intensity(signals: DataFrame, mask: bool = True) -> DataFrame:
    rows = mu(signals, drop_masked=mask)
    return rows.groupBy("sample_id").agg(((F.coalesce(F.sum("m"), F.lit(0.0)) + F.coalesce(F.sum("u"), F.lit(0.0))) / F.nullif(F.count("m") + F.count("u"), F.lit(0))).alias("mean_intensity"))


def median_total_intensity(signals: DataFrame, mask: bool = True) -> DataFrame:
    return mu(signals, drop_masked=mask, total=True).groupBy("sample_id").agg(F.median("mu").alias("median_total"))


def first_row(df: DataFrame, keys: list[str], order: list) -> DataFrame:
    """The first row a key in a given order."""
    w = W.partitionBy(*keys).orderBy(*order)
    return df.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")
