"""Files written and read again, masks by prefix, control beads, and all quality metrics together."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.joins import sorted_side
from ..functions.store import shared_path
from ..operators import frames, infer, masks, qc, signal
from ..plans import prep
from ..sources import adapters as a
from ..sources import idat, tables
from .analysis_queries import LENGTHS, _bead_list, _genome
from .registry import ORACLES, query, r6
from .signal_queries import _detected


@query("SELECT sample_id, probe_id, mask OR NOT (starts_with(probe_id, 'cg') OR starts_with(probe_id, 'ch')) AS but_c, mask OR NOT starts_with(probe_id, 'cg') AS but_cg FROM signals")
def mask_all_but(spark, sf):
    s = a.signals(spark, sf)
    one = lambda df, name: df.select("sample_id", "probe_id", F.col("mask").alias(name))
    return one(masks.prefix_mask_but_c(s), "but_c").join(sorted_side(one(masks.prefix_mask_but_cg(s), "but_cg")), ["sample_id", "probe_id"])


@query("SELECT sample_id, probe_id, mg, mr, ug, ur, col FROM signals WHERE NOT mask")
def unmasked_rows(spark, sf):
    return masks.unmasked(a.signals(spark, sf)).select("sample_id", "probe_id", "mg", "mr", "ug", "ur", "col")


@query("SELECT sample_id, 2 * pk AS address, CASE WHEN pk % 3 = 0 THEN 'negative' WHEN pk % 3 = 1 THEN 'norm_c' ELSE 'norm_t' END AS type, ug AS g, ur AS r FROM signals WHERE pk % 20 = 19 AND ug IS NOT NULL")
def control_beads(spark, sf):
    controls = a.controls(spark, sf).join(sorted_side(a.manifest(spark, sf).select("probe_id", F.col("addr_u").alias("address"))), "probe_id")
    return idat.read_controls(_bead_list(spark, sf), controls)


@query("SELECT sample_id, probe_id, mg, mr, ug, ur, col, mask FROM signals")
def signal_text(spark, sf):
    """Signals as tab-separated text, written and read."""
    path = shared_path(spark, "signal-text")
    tables.write_signals(a.signals(spark, sf), path)
    return tables.read_signals(spark, path)


@query("SELECT 'brand' AS \"group\", p_brand AS dbname, probe_id FROM probes UNION ALL SELECT 'type', p_type, probe_id FROM probes")
def set_files(spark, sf):
    """Probe sets as text tables of ids and ``group;set`` names, written and read."""
    path = shared_path(spark, "set-files")
    members = a.set_members(spark, sf).where("value IS NULL")
    lines = members.select(F.col("probe_id").alias("Probe_ID"), F.concat_ws(";", "group", "dbname").alias("Knowledgebase"))
    lines.write.option("sep", "\t").option("header", True).csv(path)
    return tables.read_sets(spark, path)


def _file_set(spark, sf):
    """A file set of all samples' betas; those of the third part are then written again, one less their betas."""
    path = shared_path(spark, "file-set")
    betas = signal.betas(a.signals(spark, sf)).select("sample_id", "probe_id", "beta")
    tables.write_file_set(betas, path)
    again = betas.where(F.substring("sample_id", 2, 2).cast("int") % 3 == 0).withColumn("beta", 1 - F.col("beta"))
    tables.write_file_set(again, path)
    return tables.read_file_set(spark, path)


@query("SELECT sample_id, probe_id, round((CASE WHEN sid % 3 = 0 THEN 1 - beta ELSE beta END)::FLOAT::DOUBLE, 5) AS beta FROM betas")
def file_set(spark, sf):
    return _file_set(spark, sf).select("sample_id", "probe_id", F.round(F.col("beta").cast("double"), 5).alias("beta"))


@query("SELECT 'sample' AS kind, 'nobody' AS name UNION ALL SELECT 'probe', 'n' || probe_id FROM probes WHERE p_size <= 10")
def file_set_missing(spark, sf):
    samples = a.samples(spark, sf).select("sample_id").unionByName(spark.range(1).select(F.lit("nobody").alias("sample_id")))
    asked = a.query_set(spark, sf)
    return tables.missing_from_file_set(_file_set(spark, sf), samples, asked.unionByName(asked.select(F.concat(F.lit("n"), "probe_id").alias("probe_id"))))


@query("""SELECT gene, g.chrom, start, "end", start + off AS x0, "end" + off AS x1 FROM genes g JOIN (SELECT chrom, coalesce(sum(length) OVER (ORDER BY chrom ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS off FROM len) o ON o.chrom = g.chrom""", more=LENGTHS)
def copy_number_frame(spark, sf):
    _, lengths, _ = _genome(spark, sf)
    out = frames.segment_frame(a.genes(spark, sf).drop("strand"), lengths)
    return out.select("gene", "chrom", "start", "end", "x0", "x1")


_ALL = ["qc_detection", "qc_counts", "qc_intensity", "qc_channel", "qc_dyebias", "qc_betas"]


def qc_all(spark, sf):
    """All six metric groups of every sample, side by side."""
    s = a.signals(spark, sf)
    out = qc.metrics(s, _detected(spark, sf), signal.betas(s))
    return out.select(*(r6(f.name) if f.dataType.simpleString() == "double" and not f.name.startswith(("med", "top")) else F.col(f.name) for f in out.schema))


query()(qc_all)
ORACLES["qc_all"] = "SELECT * FROM " + " JOIN ".join(f"({ORACLES[name]}) q{i}" + (" USING (sample_id)" if i else "") for i, name in enumerate(_ALL))


# Betas of the rows that three prefixes leave: none, those of good design, of these the cg probes.
_PREFIX = """SELECT codes, sample_id, col AS design, least(floor(b0 * 20), 19)::INT AS bin, count(*) AS n FROM raw_betas, (VALUES ('', 0), ('Q', 1), ('QG', 2)) x(codes, k)
WHERE b0 IS NOT NULL AND NOT mask AND (k < 1 OR NOT {quality}) AND (k < 2 OR starts_with(probe_id, 'cg')) GROUP BY ALL"""


@query(_PREFIX.format(quality="(pk % 37 = 0 OR pk % 41 = 0)"))
def densities_by_step(spark, sf):
    ref = prep.Reference(a.mask_members(spark, sf))
    return prep.prefixes(a.signals(spark, sf), "QG", ref, {"Q": {"names": ["mapping", "M_nonuniq"]}})


@query("""SELECT sample_id, p_type AS species, 'Latin ' || p_type AS "scientificName", 9000 + length(p_type) AS "taxonID", CASE WHEN p_type LIKE 'S%' THEN 'short' END AS "commonName", NULL::VARCHAR AS assembly
FROM (SELECT sample_id, p_type, row_number() OVER (PARTITION BY sample_id ORDER BY sum(beta) DESC, p_type) AS i FROM (SELECT sample_id, pk, beta FROM betas) JOIN probes USING (pk) GROUP BY 1, 2) WHERE i = 1""")
def species_info(spark, sf):
    """The type of probes with the largest sum of betas stands for a call."""
    parts = a.table(spark, sf, "part").select(a.probe_name(F.col("p_partkey")).alias("probe_id"), F.col("p_type").alias("species"))
    sums = signal.betas(a.signals(spark, sf)).join(parts, "probe_id").groupBy("sample_id", "species").agg(F.sum("beta").alias("s"))
    calls = sums.groupBy("sample_id").agg(F.min_by("species", F.struct(-F.col("s"), "species")).alias("species"))
    info = parts.select("species").distinct().withColumns({
        "scientificName": F.concat(F.lit("Latin "), "species"), "taxonID": (9000 + F.length("species")).cast("long"),
        "commonName": F.when(F.col("species").startswith("S"), "short"), "assembly": F.lit(None).cast("string"),
    })
    return infer.species_info(calls, info)
