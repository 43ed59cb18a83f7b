"""Preparation codes: a string of letters becomes one lazy plan over all samples."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.store import stored
from ..operators import detect, frames, infer, masks, normalize, signal
from ..sources import idat, tables


@dataclass
class Reference:
    """Tables that steps may need; each is optional where its step is not used."""

    mask_members: DataFrame | None = None
    controls: DataFrame | None = None
    species: DataFrame | None = None
    strain: DataFrame | None = None
    platform: str = "TP"

    @property
    def nonunique(self) -> DataFrame | None:
        return masks.nonunique_probes(self.mask_members) if self.mask_members is not None else None


Step = Callable[..., DataFrame]

#: The letters and what they stand for.
CODES: dict[str, tuple[str, Step]] = {
    "0": ("reset mask", lambda s, r, **k: masks.reset_mask(s)),
    "Q": ("mask probes of poor design", lambda s, r, **k: masks.quality_mask(s, r.mask_members, platform=r.platform, **k)),
    "G": ("mask all but cg", lambda s, r, **k: masks.prefix_mask_but_cg(s)),
    "H": ("mask all but cg and ch", lambda s, r, **k: masks.prefix_mask_but_c(s)),
    "C": ("infer type I channel", lambda s, r, **k: detect.infer_channel(s, **k).drop("old_col")),
    "D": ("dye bias, non-linear", lambda s, r, **k: normalize.dye_nonlinear(s, **k)),
    "E": ("dye bias, linear", lambda s, r, **k: normalize.dye_linear(s, **k)),
    "P": ("mask undetected, out-of-band", lambda s, r, threshold=0.05, **k: detect.mask_undetected(s, detect.detect_oob(s, r.nonunique, r.controls), threshold)),
    "I": ("mask undetected, background", lambda s, r, threshold=0.05, **k: detect.mask_undetected(s, detect.detect_background(s, **k), threshold)),
    "B": ("background, normal-exponential", lambda s, r, **k: normalize.noob(s, r.nonunique, r.controls, **k)),
    "S": ("set species", lambda s, r, **k: infer.update_design(s, r.species)),
    "T": ("set strain", lambda s, r, **k: infer.update_design(s, r.strain)),
    "M": ("match designs", lambda s, r, **k: normalize.match_design(s, **k)),
}


def describe() -> list[tuple[str, str]]:
    return [(c, text) for c, (text, _) in CODES.items()]


#: Steps that read their input more than once; it is settled before them.
READ_AGAIN = frozenset("CDEPIB")


def settle(df: DataFrame) -> DataFrame:
    """Stored rows to start from, in the shared folder that spark.checkpoint.dir names."""
    return stored(df, "prep")


def prepare(signals: DataFrame, codes: str = "QCDPB", reference: Reference | None = None, arguments: dict[str, dict] | None = None) -> DataFrame:
    """Applies the steps from left to right; ``arguments`` maps a code to its step's options."""
    out, reference = signals, reference or Reference()
    for c in codes:
        if c not in CODES:
            raise ValueError(f"no preparation code {c}")
        out = CODES[c][1](settle(out) if c in READ_AGAIN else out, reference, **(arguments or {}).get(c, {}))
    return out


def prefixes(signals: DataFrame, codes: str = "QCDPB", reference: Reference | None = None, arguments: dict[str, dict] | None = None) -> DataFrame:
    """(codes, sample_id, design, bin, n): densities of betas after each prefix of the steps, the empty one first.

    Each step starts from the stored rows of the one before, so every step runs once.
    """
    now, reference, out = signals, reference or Reference(), None
    for k in range(len(codes) + 1):
        if k:
            now = settle(prepare(now, codes[k - 1], reference, arguments))
        frame = frames.beta_histogram(now).withColumn("codes", F.lit(codes[:k]))
        out = frame if out is None else out.unionByName(frame)
    return out.select("codes", "sample_id", "design", "bin", "n")


def run(signals: DataFrame, codes: str = "QCDPB", function: Callable[[DataFrame], DataFrame] = signal.betas, **options) -> DataFrame:
    """Preparation, then ``function`` (betas by default), over all samples at once."""
    return prepare(signals, codes, **options).transform(function)


def run_folder(
    spark: SparkSession, path: str, manifest: DataFrame, codes: str = "QCDPB", min_beads: int | None = 1, platform: str | None = None, signatures: DataFrame | None = None, **options
) -> DataFrame:
    """From a folder of IDAT files to ``run``'s result.

    A manifest with a ``platform`` column holds several arrays: each sample takes that of
    ``platform``, or of the platform that its addresses show (``signatures``).
    """
    beads = idat.beads(spark, path)
    platforms = idat.sample_platforms(beads, signatures, platform) if "platform" in manifest.columns else None
    return run(idat.to_signals(beads, manifest, min_beads, platforms), codes, **options)


def folder_to_file_set(spark: SparkSession, path: str, out: str, manifest: DataFrame, codes: str = "QCDPB", platform: str | None = None, signatures: DataFrame | None = None, **options) -> DataFrame:
    """Betas of a folder's sound samples into a file set; returns ``idat.folder_status``, a row a sample."""
    tables.write_file_set(run_folder(spark, path, manifest, codes, platform=platform, signatures=signatures, **options), out)
    platforms = idat.sample_platforms(idat.beads(spark, path), signatures, platform) if "platform" in manifest.columns else None
    return idat.folder_status(spark, path, platforms)


def to_file_set(signals: DataFrame, path: str, codes: str = "QCDPB", **options) -> None:
    """Betas of all samples into a file set, one plan and one write; samples already there are replaced."""
    tables.write_file_set(run(signals, codes, **options), path)
