"""Soft filters: a mask is a column that is OR-ed over time and applied when betas are taken."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.joins import small_side

# Mask sets recommended for each platform.
RECOMMENDED = {
    "EPICv2": ["M_1baseSwitchSNPcommon_5pt", "M_2extBase_SNPcommon_5pt", "M_mapping", "M_nonuniq", "M_SNPcommon_5pt"],
    "MM285": ["ref_issue", "nonunique", "design_issue"],
    "EPIC": ["mapping", "channel_switch", "snp5_GMAF1p", "extension", "sub30_copy"],
    "HM450": ["mapping", "channel_switch", "snp5_GMAF1p", "extension", "sub30_copy"],
    "HM27": ["mask"],
    "TP": ["M_nonuniq", "mapping"],
}
NONUNIQUE = ["M_nonuniq", "nonunique", "sub35_copy", "multi", "design_issue"]


def recommended_names(platform: str) -> list[str]:
    return RECOMMENDED.get(platform, [])


def available(members: DataFrame, platform: str | None = None) -> DataFrame:
    """(dbname, n): the mask sets there are."""
    rows = members.where(F.col("group").isin("Mask", f"{platform}.Mask"))
    return rows.groupBy("dbname").agg(F.countDistinct("probe_id").alias("n"))


def mask_probes(members: DataFrame, names: list[str]) -> DataFrame:
    """(probe_id): distinct members of the named sets."""
    return members.where(F.col("dbname").isin(*names)).select("probe_id").distinct() if names else members.select("probe_id").limit(0)


def nonunique_probes(members: DataFrame) -> DataFrame:
    return mask_probes(members, NONUNIQUE)


def add_mask(signals: DataFrame, probes: DataFrame) -> DataFrame:
    """ORs the mask with membership in ``probes`` (probe_id)."""
    flag = probes.select("probe_id").distinct().withColumn("__hit", F.lit(True))
    return signals.join(flag, "probe_id", "left").withColumn("mask", F.col("mask") | F.coalesce("__hit", F.lit(False))).drop("__hit")


def add_mask_where(signals: DataFrame, condition: Column) -> DataFrame:
    """ORs the mask with a condition; where it is null the mask stays."""
    return signals.withColumn("mask", F.col("mask") | F.coalesce(condition, F.lit(False)))


def reset_mask(signals: DataFrame) -> DataFrame:
    return signals.withColumn("mask", F.lit(False))


def set_mask(signals: DataFrame, probes: DataFrame) -> DataFrame:
    return add_mask(reset_mask(signals), probes)


def unmasked(signals: DataFrame) -> DataFrame:
    return signals.where(~F.col("mask"))


def quality_mask(signals: DataFrame, members: DataFrame, names: list[str] | None = None, platform: str = "TP") -> DataFrame:
    return add_mask(signals, mask_probes(members, names or recommended_names(platform)))


def prefix_mask(signals: DataFrame, prefixes: list[str], invert: bool = False) -> DataFrame:
    hit = reduce(lambda a, b: a | b, [F.col("probe_id").startswith(p) for p in prefixes])
    return add_mask_where(signals, ~hit if invert else hit)


def prefix_mask_but_c(signals: DataFrame) -> DataFrame:
    return prefix_mask(signals, ["cg", "ch"], invert=True)


def prefix_mask_but_cg(signals: DataFrame) -> DataFrame:
    return prefix_mask(signals, ["cg"], invert=True)


def mask_green(signals: DataFrame) -> DataFrame:
    return add_mask_where(signals, F.col("col") == "G")


def negative_controls(signals: DataFrame, controls: DataFrame) -> DataFrame:
    """(sample_id, channel, v) of negative controls: green is UG and red is UR."""
    named = F.lower("probe_id").contains("negative")
    known = controls.where(F.lower("type").contains("negative")).select("probe_id").distinct().withColumn("__neg", F.lit(True))
    rows = signals.join(known, "probe_id", "left").where(named | F.coalesce("__neg", F.lit(False)))
    beads = F.array(F.struct(F.lit("G").alias("channel"), F.col("ug").alias("v")), F.struct(F.lit("R").alias("channel"), F.col("ur").alias("v")))
    return rows.select("sample_id", F.explode(beads).alias("x")).select("sample_id", "x.*")


def normalisation_controls(signals: DataFrame, controls: DataFrame) -> DataFrame:
    """(sample_id, channel, v): controls norm_c and norm_g are green, norm_a and norm_t red."""
    kind = F.lower("type")
    rows = signals.join(controls.where(kind.rlike(r"norm(_|\.)")), "probe_id")
    green = kind.rlike("norm_(c|g)|norm.green")
    return rows.select("sample_id", F.when(green, "G").otherwise("R").alias("channel"), F.when(green, F.col("ug")).otherwise(F.col("ur")).alias("v"))


def complete_levels(betas: DataFrame, samples: DataFrame, factor: str) -> DataFrame:
    """(probe_id, complete): every level of the factor has a beta."""
    rows = betas.join(small_side(samples.select("sample_id", factor)), "sample_id")
    levels = rows.groupBy("probe_id", factor).agg(F.count("beta").alias("n"))
    return levels.groupBy("probe_id").agg(F.bool_and(F.col("n") > 0).alias("complete"))


def control_rows(signals: DataFrame, controls: DataFrame | None = None) -> DataFrame:
    """Signals of control probes with their type: by the controls table, else by the id's prefix ``ctl``."""
    if controls is None:
        return signals.where(F.col("probe_id").startswith("ctl")).withColumn("type", F.lit(None).cast("string"))
    return signals.join(controls.select("probe_id", "type").dropDuplicates(["probe_id"]), "probe_id")
