"""Inference over samples of several platforms: each sample takes its own platform's way."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions.joins import sample_side, small_side, sorted_side
from ..functions.store import stored
from .infer import density_mode, infer_sex

# The platform whose ids the sex sets use, one with ids of its own among the sets, and markers a side.
SEX_TARGET, SEX_NATIVE, MARKERS, FEWER_MARKERS = "HM450", ("MM285",), 1000, {"HM27": 100}


def platform_from_ids(rows: DataFrame, signatures: DataFrame) -> DataFrame:
    """(sample_id, platform): the platform that most of a sample's probe ids belong to; ties by name, null without any.

    ``signatures`` (platform, probe_id) lists the ids that tell platforms apart.
    """
    ids = rows.select("sample_id", "probe_id").distinct()
    n = ids.join(sorted_side(signatures.select("platform", "probe_id").distinct()), "probe_id").groupBy("sample_id", "platform").count()
    best = n.groupBy("sample_id").agg(F.min_by("platform", F.struct(-F.col("count"), "platform")).alias("platform"))
    return rows.select("sample_id").distinct().join(best, "sample_id", "left")


def routed(rows: DataFrame, platforms: DataFrame) -> DataFrame:
    """``rows`` with the platform of their sample; samples without one are left out."""
    return rows.join(sample_side(platforms.where("platform IS NOT NULL").select("sample_id", "platform")), "sample_id")


def lift_to(betas: DataFrame, platforms: DataFrame, mappings: DataFrame, target: str, native: tuple[str, ...] = (), complete: bool = True) -> DataFrame:
    """(sample_id, platform, probe_id, beta) under the target platform's ids.

    Samples of ``target`` or of a ``native`` platform keep their ids; any other takes its
    platform's part of ``mappings`` (platform, id_source, id_target), one source a target:
    the first by id. With ``complete`` a lifted sample has every target of its mapping,
    null where it has no source. A sample whose platform has no mapping gives no rows.
    """
    own = F.col("platform").isin(target, *native)
    platforms = stored(platforms.select("sample_id", "platform"), "platforms")
    rows = routed(betas.select("sample_id", "probe_id", "beta"), platforms)
    pairs = mappings.where(~own & F.col("id_target").isNotNull()).groupBy("platform", F.col("id_target").alias("target")).agg(F.min("id_source").alias("probe_id"))
    lifted = rows.where(~own).join(sorted_side(pairs), ["platform", "probe_id"]).select("sample_id", "platform", F.col("target").alias("probe_id"), "beta")
    if complete:
        asked = platforms.where(F.col("platform").isNotNull() & ~own).select("sample_id", "platform")
        grid = pairs.select("platform", F.col("target").alias("probe_id")).join(small_side(asked), "platform")
        lifted = grid.join(sorted_side(lifted), ["sample_id", "platform", "probe_id"], "left")
    names = ["sample_id", "platform", "probe_id", "beta"]
    return rows.where(own).select(*names).unionByName(lifted.select(*names))


def sex_by_platform(
    betas: DataFrame, platforms: DataFrame, mappings: DataFrame, high_in_males: DataFrame, low_in_males: DataFrame, target: str = SEX_TARGET, native: tuple[str, ...] = SEX_NATIVE, cut: float = 0.4
) -> DataFrame:
    """(sample_id, mode, sex) of samples of any platform.

    The probe sets hold ids of ``target`` and of the ``native`` platforms; only what the
    sets name is lifted, and only of samples that are of neither. A platform's part of the
    lists is told by the ids themselves.
    """
    sets = high_in_males.select("probe_id").unionByName(low_in_males.select("probe_id")).distinct()
    wanted = mappings.join(sets.withColumnRenamed("probe_id", "id_target"), "id_target", "left_semi")
    rows = lift_to(betas, platforms, wanted, target, native, complete=False)
    return infer_sex(rows.select("sample_id", "probe_id", "beta"), high_in_males, low_in_males, cut)


def leukocyte_markers(tissue: DataFrame, leukocyte: DataFrame, markers: Column | int = MARKERS) -> DataFrame:
    """(platform, probe_id, side, leukocyte): by platform, the probes whose leukocyte mean lies
    furthest above the tissue mean (high), and furthest below (low); ties by id.

    A platform's probes are ranked together; of the rows, each task keeps at most the first ``markers``.
    """
    means = lambda df, name: df.groupBy("platform", "probe_id").agg(F.avg("beta").alias(name))
    both = means(leukocyte, "leukocyte").join(sorted_side(means(tissue, "tissue")), ["platform", "probe_id"]).withColumn("d", F.col("leukocyte") - F.col("tissue")).where("d IS NOT NULL")
    most = F.lit(markers) if isinstance(markers, int) else markers

    def side(name: str, order: Column) -> DataFrame:
        rank = F.row_number().over(W.partitionBy("platform").orderBy(order, "probe_id"))
        limit = MARKERS if not isinstance(markers, int) else markers
        ranked = both.withColumn("rank", rank).where(F.col("rank") <= limit)
        return ranked.where(F.col("rank") <= most).select("platform", "probe_id", F.lit(name).alias("side"), "leukocyte")

    return side("high", F.col("d").desc()).unionByName(side("low", F.col("d").asc()))


def leukocyte_fraction(
    tissue: DataFrame, leukocyte: DataFrame, platforms: DataFrame | None = None, tumor: DataFrame | None = None, markers: int | None = None, cohort: int = 10, least: int = 10
) -> DataFrame:
    """(sample_id, fraction, n): the mode of (beta - t) / (leukocyte - t) over the marker probes.

    t is what a sample without leukocytes shows: the least (high markers) or greatest (low
    markers) beta of the platform's samples if there are ``cohort`` or more, else 0 or 1.
    Markers come from ``tissue``; betas measured and bounded are those of ``tumor`` if
    given. With ``platforms`` (sample_id, platform) the references (platform, probe_id,
    beta) and the bounds are each sample's own platform's. Fewer than ``least`` ratios
    give null; a ratio by zero is none. The fraction is not clamped.
    """
    if platforms is None:
        constant = F.lit("")
        tissue, leukocyte = tissue.withColumn("platform", constant), leukocyte.withColumn("platform", constant)
        measured = tumor.withColumn("platform", constant) if tumor is not None else tissue
    else:
        tissue = stored(routed(tissue, platforms).select("platform", "sample_id", "probe_id", "beta"), "tissue")  # read for markers, bounds and ratios
        measured = routed(tumor, platforms) if tumor is not None else tissue
    fewer = F.lit(markers if markers is not None else MARKERS)
    if markers is None:
        for name, n in FEWER_MARKERS.items():
            fewer = F.when(F.upper("platform") == name, F.lit(n)).otherwise(fewer)
    chosen = F.broadcast(leukocyte_markers(tissue, leukocyte, markers if markers is not None else fewer))  # 2 * markers rows a platform, as have the bounds
    rows = measured.join(chosen, ["platform", "probe_id"]).select("platform", "sample_id", "probe_id", "side", "leukocyte", "beta")
    sizes = F.broadcast(measured.groupBy("platform").agg(F.countDistinct("sample_id").alias("samples")))  # a row a platform
    bounds = rows.groupBy("platform", "probe_id", "side").agg(F.min("beta").alias("low"), F.max("beta").alias("high")).join(sizes, "platform")
    high = F.col("side") == "high"
    t = F.when(F.col("samples") >= cohort, F.when(high, F.col("low")).otherwise(F.col("high"))).otherwise(F.when(high, 0.0).otherwise(1.0))
    bounded = rows.join(F.broadcast(bounds.select("platform", "probe_id", "side", t.alias("t"))), ["platform", "probe_id", "side"])
    ratio = F.try_divide(F.col("beta") - F.col("t"), F.col("leukocyte") - F.col("t"))
    modes = density_mode(bounded.withColumn("x", ratio).where("x IS NOT NULL"), ["sample_id"], "x")
    found = modes.select("sample_id", F.when(F.col("n") >= least, F.col("mode")).alias("fraction"), "n")
    every = measured.select("sample_id").distinct()
    return every.join(found, "sample_id", "left").withColumn("n", F.coalesce("n", F.lit(0).cast("long")))
