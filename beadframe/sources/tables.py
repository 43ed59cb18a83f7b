"""Text and Parquet tables: signals, manifests, sets, file sets, tracks and variant lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.ranges import chrom_key
from ..operators.signal import genotype

SIGNALS = "sample_id string, probe_id string, mg double, mr double, ug double, ur double, col string, mask boolean"
MANIFEST = (
    "CpG_chrm string, CpG_beg int, CpG_end int, address_A int, address_B int, target string, nextBase string, channel string, Probe_ID string, "
    "mapFlag_A int, mapChrm_A string, mapPos_A int, mapQ_A int, mapCigar_A string, AlleleA_ProbeSeq string, mapNM_A string, mapAS_A int, mapYD_A string, "
    "mapFlag_B int, mapChrm_B string, mapPos_B int, mapQ_B int, mapCigar_B string, AlleleB_ProbeSeq string, mapNM_B string, mapAS_B int, mapYD_B string, type string"
)


def write_signals(signals: DataFrame, path: str) -> None:
    names = [f.split()[0] for f in SIGNALS.split(", ")]
    signals.select(*names).write.option("sep", "\t").option("header", True).option("nullValue", "NA").csv(path)


def read_signals(spark: SparkSession, path: str) -> DataFrame:
    rows = spark.read.schema(SIGNALS).option("sep", "\t").option("header", True).option("nullValue", "NA").csv(path)
    return rows.withColumns({"col": F.coalesce("col", F.lit("2")), "mask": F.coalesce("mask", F.lit(False))})


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(MANIFEST).option("sep", "\t").option("header", True).option("nullValue", "NA").csv(path)


def address_table(manifest: DataFrame) -> DataFrame:
    """(probe_id, addr_m, addr_u, col, mask) of a raw manifest; the mask is its reference issue."""
    m = mapping_masks(manifest)
    return m.select(F.col("Probe_ID").alias("probe_id"), F.col("address_B").alias("addr_m"), F.col("address_A").alias("addr_u"), F.col("channel").alias("col"), F.col("ref_issue").alias("mask"))


def mapping_masks(manifest: DataFrame) -> DataFrame:
    """Adds unmapped, nonunique, missing_target, control, design_issue, low_mapq and ref_issue."""
    no = lambda c: F.coalesce(c, F.lit(False))
    unmapped = F.col("mapAS_A").isNull() | no(F.col("mapAS_A") < 35) | no(F.col("mapAS_B") < 35)
    out = manifest.withColumn("unmapped", unmapped)
    out = out.withColumns({
        "nonunique": ~F.col("unmapped") & (no(F.col("mapQ_A") == 0) | no(F.col("mapQ_B") == 0)),
        "missing_target": ~F.col("unmapped") & no(F.coalesce("target", F.lit("")) != "CG") & F.col("Probe_ID").startswith("cg"),
        "control": F.col("Probe_ID").startswith("ctl"), "design_issue": F.col("Probe_ID").startswith("uk"),
        "low_mapq": no(F.col("mapQ_A") < 30) | no(F.col("mapQ_B") < 30),
    })
    return out.withColumn("ref_issue", F.col("unmapped") | F.col("missing_target"))


def manifest_ranges(manifest: DataFrame, decoy: bool = False, keep: list[str] | None = None) -> DataFrame:
    """(probe_id, chrom, start, end, strand, chrom_ord, ...): 1-based ranges; unmapped probes lie at ``*``, -1 to 0."""
    name = F.col("CpG_chrm")
    good = name.rlike("^chr([0-9]+|X|Y|M)$") | (F.lit(decoy) & name.rlike("_"))
    ok = F.coalesce(good, F.lit(False)) & F.col("CpG_beg").isNotNull()
    strand = F.when(~ok | F.col("mapFlag_A").isNull(), "*").when(F.col("mapFlag_A").bitwiseAND(16) == 0, "+").otherwise("-")
    chrom = F.when(ok, name).otherwise("*")
    return manifest.select(
        F.col("Probe_ID").alias("probe_id"), chrom.alias("chrom"), F.when(ok, F.col("CpG_beg") + 1).otherwise(-1).alias("start"),
        F.when(ok, F.col("CpG_end")).otherwise(0).alias("end"), strand.alias("strand"), F.when(ok, chrom_key(chrom)).otherwise(9999).alias("chrom_ord"), *(keep or []),
    )


def read_sets(spark: SparkSession, path: str, group_from_name: bool = False) -> DataFrame:
    """(group, dbname, probe_id) of tables (Probe_ID, Knowledgebase), where the latter is ``group;set``."""
    rows = spark.read.option("sep", "\t").option("header", True).csv(path)
    parts = F.split("Knowledgebase", ";", 2)
    file = F.regexp_extract(F.input_file_name(), r"([^/]+?)(\.tsv)?(\.gz)?$", 1)
    group = file if group_from_name else F.when(F.size(parts) > 1, parts[0]).otherwise(file)
    return rows.select(group.alias("group"), F.element_at(parts, -1).alias("dbname"), F.col("Probe_ID").alias("probe_id"))


def write_file_set(betas: DataFrame, path: str) -> None:
    """Betas by sample: a folder a sample, sorted by probe; samples written again replace their folder only."""
    rows = betas.select("sample_id", "probe_id", F.col("beta").cast("float")).repartition("sample_id").sortWithinPartitions("sample_id", "probe_id")
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("sample_id").parquet(path)


def read_file_set(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("probe_id string, beta float, sample_id string").parquet(path)


def slice_file_set(store: DataFrame, samples: list[str], probes: DataFrame, most: int | None = 100_000) -> DataFrame:
    """Betas of some samples (partitions are pruned) and probes; refused beyond ``most`` cells (None: never)."""
    rows = store.where(F.col("sample_id").isin(*samples)).join(probes.select("probe_id").distinct(), "probe_id", "left_semi")
    if most is not None and rows.limit(most + 1).count() > most:
        raise ValueError(f"the slice has more than {most} cells")
    return rows.select("sample_id", "probe_id", "beta")


def missing_from_file_set(store: DataFrame, samples: DataFrame, probes: DataFrame) -> DataFrame:
    """(kind, name) of the samples (sample_id) and probes (probe_id) that a file set does not have; a slice leaves them out."""
    lost = lambda df, c: df.select(c).distinct().join(store.select(c).distinct(), c, "left_anti").select(F.lit(c.removesuffix("_id")).alias("kind"), F.col(c).alias("name"))
    return lost(samples, "sample_id").unionByName(lost(probes, "probe_id"))


def bed_track(betas: DataFrame, coords: DataFrame) -> DataFrame:
    """BED-9 columns of every probe in ``coords`` for each sample that has it; missing betas score 0 in black."""
    b = F.col("beta")
    colour = F.when(b.isNull(), "0,0,0").when(b < 0.3, "0,0,255").when(b > 0.7, "255,0,0").otherwise("50,150,0")
    rows = coords.join(betas.select("sample_id", "probe_id", "beta"), "probe_id", "left")
    start = F.col("start") - 1
    return rows.select(
        "sample_id", F.col("chrom").alias("chrm"), start.alias("beg"), "end", F.col("probe_id").alias("name"), F.coalesce(F.floor(b * 1000).cast("int"), F.lit(0)).alias("score"),
        "strand", start.alias("thick_start"), F.col("end").alias("thick_end"), colour.alias("item_rgb"),
    )


def write_bed(track: DataFrame, path: str) -> None:
    track.drop("sample_id").write.option("sep", "\t").csv(path)


def vcf_header(genome: str = "hg38", date: str | None = None) -> list[str]:
    """Header lines, the column line last."""
    from datetime import date as day

    # The INFO fields that lines carry.
    info = [
        ("PVF", "Float", "Pseudo Variant Frequency"), ("GT", "String", "Genotype"), ("GS", "Integer", "Genotyping score from 7 to 85"),
        ("Probe_ID", "String", "Probe ID"), ("rs_ID", "String", "Overlapping rs ID from dbSNP"),
    ]
    lines = ["##fileformat=VCFv4.0", f"##fileDate={date or day.today().strftime('%Y%m%d')}", f"##reference={genome}"]
    lines += [f'##INFO=<ID={n},Number=1,Type={t},Description="{d}">' for n, t, d in info]
    return [*lines, "#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO"]


def variant_frequency(snps: DataFrame, betas: DataFrame, af: DataFrame) -> DataFrame:
    """Adds vaf to snps (probe_id, chrm, pos, ref, alt, u): 1 - beta where u is ALT, the type I frequency where it is REF_InfI, else beta."""
    rows = snps.join(betas.select("sample_id", "probe_id", "beta"), "probe_id").join(af.select("sample_id", "probe_id", "af"), ["sample_id", "probe_id"], "left")
    return rows.withColumn("vaf", F.when(F.col("u") == "ALT", 1 - F.col("beta")).when(F.col("u") == "REF_InfI", F.col("af")).otherwise(F.col("beta")))


def vcf_lines(snps: DataFrame, betas: DataFrame, af: DataFrame) -> DataFrame:
    """(sample_id, chrm, pos, id, ref, alt, qual, filter, info); the ambiguous alleles ACT and AGT become H and D.

    ``snps`` may have a column rs, which goes into INFO.
    """
    rows = variant_frequency(snps, betas, af).withColumn("g", genotype(F.col("vaf")))
    code = lambda c: F.when(F.col(c) == "ACT", "H").when(F.col(c) == "AGT", "D").otherwise(F.col(c)).alias(c)
    info = F.format_string("PVF=%1.3f;GT=%s;GS=%d;Probe_ID=%s", "vaf", "g.gt", "g.gs", "probe_id")
    if "rs" in snps.columns:
        info = F.concat(info, F.coalesce(F.concat(F.lit(";rs_ID="), "rs"), F.lit("")))
    return rows.select(
        "sample_id", "chrm", "pos", F.lit(".").alias("id"), code("ref"), code("alt"), F.col("g.gs").alias("qual"),
        F.when(F.col("g.gs") > 20, "PASS").otherwise("FAIL").alias("filter"), F.when(F.col("vaf").isNotNull(), info).alias("info"),
    )


def write_vcf(lines: DataFrame, path: str, genome: str = "hg38") -> None:
    """Lines by chromosome and position below the header, as text parts that read in order."""
    line = F.concat_ws("\t", "chrm", F.col("pos").cast("string"), "id", "ref", "alt", F.col("qual").cast("string"), "filter", "info")
    rows = lines.orderBy(chrom_key(F.col("chrm")), "chrm", "pos", "info").select(line.alias("value"))
    head = lines.sparkSession.createDataFrame([("\n".join(vcf_header(genome)),)], "value string")
    head.coalesce(1).unionByName(rows).write.text(path)


def import_mu(matrix: DataFrame, manifest: DataFrame, mean: float = 500, sd: float = 300, seed: int = 1) -> DataFrame:
    """Signals from processed (sample_id, probe_id, m, u); out-of-band beads are drawn, at least 50."""
    noise = lambda k: F.greatest(F.lit(50.0), F.randn(seed + k) * sd + mean)
    rows = matrix.join(manifest.select("probe_id", F.coalesce("col", F.lit("2")).alias("col"), "mask"), "probe_id", "right")
    g, r, two = (F.col("col") == c for c in ("G", "R", "2"))

    def bead(own: Column, value: str, k: int) -> Column:
        return F.when(own, F.col(value)).when(~two, noise(k))

    return rows.select(
        "sample_id", "probe_id", bead(g, "m", 0).alias("mg"), bead(r, "m", 1).alias("mr"), F.when(two, F.col("m")).when(g, F.col("u")).otherwise(noise(2)).alias("ug"),
        F.when(two, F.col("u")).when(r, F.col("u")).otherwise(noise(3)).alias("ur"), "col", F.coalesce("mask", F.lit(False)).alias("mask"),
    )


def from_slots(type_ii: DataFrame, green: DataFrame, red: DataFrame, oob_green: DataFrame, oob_red: DataFrame) -> DataFrame:
    """Signals from the older layout of five tables (sample_id, probe_id, m, u): type II, in-band and out-of-band type I."""
    key = ["sample_id", "probe_id"]
    two = type_ii.select(*key, F.lit(None).cast("double").alias("mg"), F.lit(None).cast("double").alias("mr"), F.col("m").alias("ug"), F.col("u").alias("ur"), F.lit("2").alias("col"))

    def one(inside: DataFrame, outside: DataFrame, c: str) -> DataFrame:
        rows = inside.join(outside.select(*key, F.col("m").alias("mo"), F.col("u").alias("uo")), key, "left")
        own, other = ("m", "u"), ("mo", "uo")
        (mg, ug), (mr, ur) = (own, other) if c == "G" else (other, own)
        return rows.select(*key, F.col(mg).alias("mg"), F.col(mr).alias("mr"), F.col(ug).alias("ug"), F.col(ur).alias("ur"), F.lit(c).alias("col"))

    return two.unionByName(one(green, oob_red, "G")).unionByName(one(red, oob_green, "R")).withColumn("mask", F.lit(False))
