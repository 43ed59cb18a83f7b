"""IDAT bead files: prefixes, reading, de-identification, and joining beads with a manifest.

A file holds, for one sample and channel, each bead address's mean (unsigned 16-bit) and
bead count. Files are read whole by Spark's binary source, one row a file, and parsed on
executors; gzip is seen by content.
"""

from __future__ import annotations

import gzip
import struct

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions.joins import every_sample, sample_side, sorted_side

# Fixed values of the file format: magic, version and field codes.
MAGIC, VERSION = b"IDAT", 3
N_BEADS, ADDRESS, SD, MEAN, BEADS = 1000, 102, 103, 104, 107
#: Bead rows that leave a task at once.
ROWS = 1 << 16
NAME = r"^(.*)_(Grn|Red)\.idat(\.gz)?$"


def fields(data: bytes) -> dict[int, int]:
    """Field code -> byte offset; ValueError if the bytes are no IDAT file."""
    if len(data) < 16 or data[:4] != MAGIC or struct.unpack_from("<q", data, 4)[0] != VERSION:
        raise ValueError("not an IDAT file of version 3")
    n = struct.unpack_from("<i", data, 12)[0]
    return {code: at for code, at in (struct.unpack_from("<Hq", data, 16 + 10 * i) for i in range(n))}


def parse(data: bytes) -> dict[str, np.ndarray]:
    """address, mean and beads of a file's bytes (gzip or plain)."""
    data = gzip.decompress(data) if data[:2] == b"\x1f\x8b" else data
    at = fields(data)
    n = struct.unpack_from("<i", data, at[N_BEADS])[0]
    read = lambda code, kind: np.frombuffer(data, kind, n, at[code])
    return {"address": read(ADDRESS, "<i4"), "mean": read(MEAN, "<u2"), "beads": read(BEADS, "u1")}


def build(address: np.ndarray, mean: np.ndarray, beads: np.ndarray) -> bytes:
    """The bytes of a file with the given columns."""
    n = len(address)
    parts = [(N_BEADS, struct.pack("<i", n)), (ADDRESS, np.asarray(address, "<i4").tobytes()), (SD, np.zeros(n, "<u2").tobytes()), (MEAN, np.asarray(mean, "<u2").tobytes()), (BEADS, np.asarray(beads, "u1").tobytes())]
    place, table = 16 + 10 * len(parts), b""
    for code, body in parts:
        table += struct.pack("<Hq", code, place)
        place += len(body)
    return MAGIC + struct.pack("<qi", VERSION, len(parts)) + table + b"".join(b for _, b in parts)


def files(spark: SparkSession, path: str) -> DataFrame:
    """(path, prefix, channel, content) of the IDAT files below a folder."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.idat*").load(path)
    return raw.select("path", F.regexp_extract("path", NAME, 1).alias("prefix"), F.regexp_extract("path", NAME, 2).alias("channel"), "content").where("channel <> ''")


def prefixes(spark: SparkSession, path: str) -> DataFrame:
    """(prefix): those with exactly a green and a red file; an error when used if there is none."""
    found = files(spark, path).groupBy("prefix").agg(F.sort_array(F.collect_list("channel")).alias("c"))
    return found.where(F.col("c") == F.array(F.lit("Grn"), F.lit("Red"))).select("prefix")


BEAD_ROWS = "prefix string, channel string, address int, mean double, beads int, error string"


def bead_rows(files: DataFrame) -> DataFrame:
    """A row a bead; a file that cannot be parsed gives one row with its error."""

    def run(batches):
        for b in batches:
            for prefix, channel, content in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2)):
                try:
                    got, error = parse(content.as_py()), None
                except (ValueError, KeyError, struct.error, OSError, EOFError) as e:
                    got, error = {"address": [0], "mean": [0], "beads": [0]}, str(e)
                for at in range(0, len(got["address"]), ROWS):
                    address, mean, beads = (np.asarray(got[k][at : at + ROWS], kind) for k, kind in (("address", np.int32), ("mean", float), ("beads", np.int32)))
                    n = len(address)
                    columns = [pa.array([prefix] * n), pa.array([channel] * n), pa.array(address), pa.array(mean), pa.array(beads), pa.array([error] * n, pa.string())]
                    yield pa.RecordBatch.from_arrays(columns, names=[c.split()[0] for c in BEAD_ROWS.split(", ")])

    return files.select("prefix", "channel", "content").mapInArrow(run, BEAD_ROWS)


def beads(spark: SparkSession, path: str) -> DataFrame:
    """(sample_id, address, g, r, gn, rn) of the complete pairs; the sample is the file name's prefix."""
    return pair_beads(files(spark, path).join(F.broadcast(prefixes(spark, path)), "prefix", "left_semi"))  # a row a sample


def pair_beads(pairs: DataFrame) -> DataFrame:
    """Beads that both files (prefix, channel, content) of a sample hold; a pair with a damaged file has none."""
    rows = bead_rows(pairs).where("error IS NULL").withColumn("sample_id", F.element_at(F.split("prefix", "/"), -1))
    of = lambda c, v: F.max(F.when(F.col("channel") == c, F.col(v)))
    both = rows.groupBy("sample_id", "address").agg(of("Grn", "mean").alias("g"), of("Red", "mean").alias("r"), of("Grn", "beads").alias("gn"), of("Red", "beads").alias("rn"))
    return both.dropna(subset=["g", "r"])


def infer_platform(beads: DataFrame, signatures: DataFrame) -> DataFrame:
    """(sample_id, platform): the platform with most signature addresses present.

    Null if even that one has fewer than the shortest signature.
    """
    size = signatures.groupBy("platform").count().agg(F.min("count").alias("least"))
    n = beads.select("sample_id", "address").join(sorted_side(signatures), "address").groupBy("sample_id", "platform").count()
    best = n.groupBy("sample_id").agg(F.max_by("platform", F.struct("count", "platform")).alias("platform"), F.max("count").alias("n"))
    all_ = beads.select("sample_id").distinct().join(best, "sample_id", "left").join(F.broadcast(size))  # one row
    return all_.select("sample_id", F.when(F.col("n") >= F.col("least"), F.col("platform")).alias("platform"))


def sample_platforms(beads: DataFrame, signatures: DataFrame | None = None, platform: str | None = None) -> DataFrame:
    """(sample_id, platform): ``platform`` for all samples if given, else inferred from signature addresses."""
    if platform is not None:
        return beads.select("sample_id").distinct().withColumn("platform", F.lit(platform))
    if signatures is None:
        raise ValueError("give a platform, or the platforms' signature addresses")
    return infer_platform(beads, signatures)


def to_signals(beads: DataFrame, manifest: DataFrame, min_beads: int | None = 1, platforms: DataFrame | None = None) -> DataFrame:
    """Signals of every manifest probe: type I reads two addresses, type II one.

    A probe is masked if a bead count it uses is missing or below ``min_beads``, or if the
    manifest masks it. Two left equi-joins on (sample, address). With ``platforms``
    (sample_id, platform) a sample takes its own platform's part of the manifest; a sample
    without a platform gives no rows (``folder_status`` names it).
    """
    if platforms is not None:
        grid = manifest.join(sample_side(platforms), "platform").drop("platform")
    else:
        grid = every_sample(manifest, beads)
    m, u = (beads.select("sample_id", F.col("address").cast("long").alias(f"addr_{s}"), *(F.col(c).alias(f"{s}_{c}") for c in ("g", "r", "gn", "rn"))) for s in "mu")
    rows = grid.join(sorted_side(u), ["sample_id", "addr_u"], "left").join(sorted_side(m), ["sample_id", "addr_m"], "left")
    one = F.col("col").isNotNull()
    few = F.lit(False)
    if min_beads is not None:
        low = lambda c: F.coalesce(F.col(c) < min_beads, F.lit(True))
        few = low("u_gn") | low("u_rn") | (one & (low("m_gn") | low("m_rn")))
    return rows.select(
        "sample_id", "probe_id", F.when(one, F.col("m_g")).alias("mg"), F.when(one, F.col("m_r")).alias("mr"), F.col("u_g").alias("ug"), F.col("u_r").alias("ur"),
        F.coalesce("col", F.lit("2")).alias("col"), (F.coalesce("mask", F.lit(False)) | few).alias("mask"),
    )


def rewrite(data: bytes, secret: np.ndarray, seed: int | None, undo: bool = False) -> bytes:
    """A file with the means at ``secret`` addresses set to zero, or permuted by a seed (or put back)."""
    packed = data[:2] == b"\x1f\x8b"
    plain = gzip.decompress(data) if packed else data
    at, got = fields(plain), parse(plain)
    mean = got["mean"].copy()
    places = np.flatnonzero(np.isin(got["address"], secret))
    if seed is None:
        mean[places] = 0
    else:
        order = np.random.default_rng(seed).permutation(len(places))
        if undo:
            mean[places[order]] = got["mean"][places]
        else:
            mean[places] = got["mean"][places[order]]
    start = at[MEAN]
    out = plain[:start] + mean.astype("<u2").tobytes() + plain[start + 2 * len(mean) :]
    return gzip.compress(out, mtime=0) if packed else out


def deidentify(files: DataFrame, secret: list[int], seed: int | None = None, undo: bool = False) -> DataFrame:
    """(path, content) with the means of identifying addresses zeroed (no seed) or permuted; names get ``_noid``."""
    addresses = np.array(sorted(secret), np.int64)  # the array's SNP beads

    def run(batches):
        for b in batches:
            out = [rewrite(c.as_py(), addresses, seed, undo) for c in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.binary())], names=["path", "content"])

    new = F.col("path") if undo else F.regexp_replace("path", r"_(Grn|Red)\.idat", "_noid_$1.idat")
    return files.select("path", "content").mapInArrow(run, "path string, content binary").withColumn("path", new)


def first_per_address(beads: DataFrame) -> DataFrame:
    """One row a sample and address, where a file repeats an address."""
    w = W.partitionBy("sample_id", "address").orderBy(F.col("gn").desc_nulls_last(), F.col("rn").desc_nulls_last(), "g", "r")
    return beads.withColumn("n", F.row_number().over(w)).where("n = 1").drop("n")


def read_controls(beads: DataFrame, controls: DataFrame) -> DataFrame:
    """(sample_id, address, type, g, r) of control beads (address, type); those that were not read are left out."""
    return beads.join(sorted_side(controls.select(F.col("address").cast("int").alias("address"), "type")), "address").select("sample_id", "address", "type", "g", "r").dropna(subset=["g", "r"])


def file_status(files: DataFrame) -> DataFrame:
    """(prefix, status, error): a row a sample; a damaged file fails its own sample only."""
    return bead_rows(files).groupBy("prefix").agg(F.max("error").alias("error")).select("prefix", F.when(F.col("error").isNull(), "ok").otherwise("failed").alias("status"), "error")


def folder_status(spark: SparkSession, path: str, platforms: DataFrame | None = None) -> DataFrame:
    """(sample_id, status, error) of every sample in a folder: ok, failed (damaged), incomplete or no platform.

    A sample that is not ok fails alone; the others go on.
    """
    name = F.element_at(F.split("prefix", "/"), -1).alias("sample_id")
    have = files(spark, path).groupBy("prefix").agg(F.countDistinct("channel").alias("n"), F.count("*").alias("all"))
    rows = have.join(file_status(files(spark, path)), "prefix").select(name, "n", "all", "status", "error")
    rows = rows.join(platforms, "sample_id", "left") if platforms is not None else rows.withColumn("platform", F.lit(""))
    whole = (F.col("n") == 2) & (F.col("all") == 2)
    status = F.when(F.col("status") == "failed", "failed").when(~whole, "incomplete").when(F.col("platform").isNull(), "no platform").otherwise("ok")
    return rows.select("sample_id", status.alias("status"), "error")
