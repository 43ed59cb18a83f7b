"""Domain tables derived from star-schema tables by integer arithmetic.

One cell of ``lineitem`` (part, supplier modulo 12) is the reading of one probe in one
sample; cells that do not exist are readings that are missing. Everything is an
expression over the given tables, so work grows with them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.joins import sorted_side

SAMPLES = 12


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def probe_name(pk: Column) -> Column:
    kind = F.when(pk % 20 < 17, "cg").when(pk % 20 == 17, "ch").when(pk % 20 == 18, "rs").otherwise("ctl_")
    return F.concat(kind, F.lpad(pk.cast("string"), 8, "0"))


def design(pk: Column) -> Column:
    return F.when(pk % 10 < 2, "G").when(pk % 10 < 4, "R").otherwise("2")


def sample_name(sid: Column) -> Column:
    return F.concat(F.lit("s"), F.lpad(sid.cast("string"), 2, "0"))


def signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(sample_id, probe_id, pk, mg, mr, ug, ur, col, mask): a row a probe and sample."""
    pk, sid = F.col("l_partkey").alias("pk"), (F.col("l_suppkey") % SAMPLES).alias("sid")
    whole = lambda c: F.sum(F.floor(c)).cast("long")
    cells = table(spark, sf_dir, "lineitem").groupBy(pk, sid).agg(
        whole("l_quantity").alias("q"), whole("l_extendedprice").alias("e"), F.sum("l_linenumber").cast("long").alias("ln")
    )
    grid = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("pk"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SAMPLES - 1).cast("long"))).alias("sid"))
    rows = grid.join(sorted_side(cells), ["pk", "sid"], "left").withColumn("col", design(F.col("pk")))
    one = F.col("col") != "2"
    number = lambda c: c.cast("double")
    return rows.select(
        sample_name(F.col("sid")).alias("sample_id"), probe_name(F.col("pk")).alias("probe_id"), "pk",
        number(F.when(one, 50 + (F.col("q") * 53 + F.col("ln") * 101) % 4001)).alias("mg"),
        number(F.when(one, 50 + (F.col("e") * 7) % 3967)).alias("mr"),
        number(50 + (F.col("q") * 37) % 4000).alias("ug"), number(50 + F.col("e") % 3989).alias("ur"),
        "col", (F.col("pk") % 41 == 0).alias("mask"),
    )


def suffixed(signals: DataFrame) -> DataFrame:
    """The same readings under ids with a design suffix; two probes share a prefix."""
    half = F.floor(F.col("pk") / 2).cast("long")
    tail = F.when(F.col("pk") % 2 == 0, "_TC21").otherwise("_BO11")
    return signals.withColumn("probe_id", F.concat(probe_name(half), tail))


def manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(platform, probe_id, probe_ord, addr_m, addr_u, col, mask); type II has no col and addr_m."""
    pk = F.col("p_partkey")
    one = design(pk) != "2"
    return table(spark, sf_dir, "part").select(
        F.lit("TP").alias("platform"), probe_name(pk).alias("probe_id"), pk.alias("probe_ord"),
        F.when(one, 2 * pk + 1).alias("addr_m"), (2 * pk).alias("addr_u"), F.when(one, design(pk)).alias("col"), (pk % 41 == 0).alias("mask"),
    )


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(sample_id, sex, tissue, age); sample ids are those that readings can have."""
    sid = (F.col("s_suppkey") % SAMPLES).alias("sid")
    return table(spark, sf_dir, "supplier").select(sid).distinct().select(
        sample_name(F.col("sid")).alias("sample_id"), F.when(F.col("sid") % 2 == 0, "F").otherwise("M").alias("sex"),
        F.concat(F.lit("t"), (F.col("sid") % 3).cast("string")).alias("tissue"), (10 + (7 * F.col("sid")) % 40).cast("double").alias("age"),
    )


def coords(spark: SparkSession, sf_dir: str) -> DataFrame:
    pk = F.col("p_partkey")
    return table(spark, sf_dir, "part").select(
        probe_name(pk).alias("probe_id"), F.concat(F.lit("chr"), (pk % 5 + 1).cast("string")).alias("chrom"), (1000 + 137 * pk).alias("start"),
        (1001 + 137 * pk).alias("end"), F.when(pk % 2 == 0, "+").otherwise("-").alias("strand"), pk.alias("probe_ord"),
    )


def genes(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("n_nationkey").cast("long")
    return table(spark, sf_dir, "nation").select(
        F.col("n_name").alias("gene"), F.concat(F.lit("chr"), (n % 5 + 1).cast("string")).alias("chrom"), (1000 + 8000 * n).alias("start"),
        (4999 + 8000 * n).alias("end"), F.when(n % 2 == 0, "+").otherwise("-").alias("strand"),
    )


def set_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(group, dbname, probe_id, value): categorical groups brand and type, numeric group price."""
    parts = table(spark, sf_dir, "part").withColumn("probe_id", probe_name(F.col("p_partkey")))
    pick = lambda g, name, value: parts.select(F.lit(g).alias("group"), name.alias("dbname"), "probe_id", value.cast("double").alias("value"))
    none = F.lit(None)
    return pick("brand", F.col("p_brand"), none).unionByName(pick("type", F.col("p_type"), none)).unionByName(pick("price", F.lit("retail"), F.col("p_retailprice")))


def query_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").where("p_size <= 10").select(probe_name(F.col("p_partkey")).alias("probe_id"))


def mask_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Members of the group Mask: M_nonuniq and mapping."""
    pk = F.col("p_partkey")
    names = F.array(F.when(pk % 41 == 0, "M_nonuniq"), F.when(pk % 37 == 0, "mapping"))
    rows = table(spark, sf_dir, "part").select(probe_name(pk).alias("probe_id"), F.explode(names).alias("dbname"))
    return rows.where("dbname IS NOT NULL").select(F.lit("Mask").alias("group"), "dbname", "probe_id")


def controls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(probe_id, type, channel) of control probes: negative, norm_c and norm_t."""
    pk = F.col("p_partkey")
    kind = F.when(pk % 3 == 0, "negative").when(pk % 3 == 1, "norm_c").otherwise("norm_t")
    return table(spark, sf_dir, "part").where(pk % 20 == 19).select(probe_name(pk).alias("probe_id"), kind.alias("type"))


def with_effect(betas: DataFrame) -> DataFrame:
    """Adds 0.3 to the betas of every fiftieth probe in samples with an odd number."""
    odd = F.substring("sample_id", 2, 2).cast("int") % 2
    moved = F.least(F.lit(1.0), F.col("beta") + 0.3 * odd)
    return betas.withColumn("beta", F.when((F.col("pk") % 50 == 0) & F.col("beta").isNotNull(), moved).otherwise(F.col("beta")))


#: The same tables as DuckDB common table expressions, for oracles.
ORACLE = """
cells AS (SELECT l_partkey AS pk, l_suppkey % 12 AS sid, sum(floor(l_quantity))::BIGINT AS q,
  sum(floor(l_extendedprice))::BIGINT AS e, sum(l_linenumber)::BIGINT AS ln FROM lineitem GROUP BY ALL),
probes AS (SELECT p_partkey AS pk, CASE WHEN p_partkey % 20 < 17 THEN 'cg' WHEN p_partkey % 20 = 17 THEN 'ch' WHEN p_partkey % 20 = 18 THEN 'rs' ELSE 'ctl_' END
  || lpad(p_partkey::VARCHAR, 8, '0') AS probe_id, CASE WHEN p_partkey % 10 < 2 THEN 'G' WHEN p_partkey % 10 < 4 THEN 'R' ELSE '2' END AS col,
  p_partkey % 41 = 0 AS mask, 'chr' || (p_partkey % 5 + 1) AS chrom, 1000 + 137 * p_partkey AS start, 1001 + 137 * p_partkey AS "end",
  CASE WHEN p_partkey % 2 = 0 THEN '+' ELSE '-' END AS strand, p_brand, p_type, p_size, p_retailprice::DOUBLE AS price FROM part),
signals AS (SELECT 's' || lpad(g.sid::VARCHAR, 2, '0') AS sample_id, g.sid, p.pk, p.probe_id, p.col, p.mask,
  CASE WHEN p.col <> '2' THEN 50 + (q * 53 + ln * 101) % 4001 END::DOUBLE AS mg, CASE WHEN p.col <> '2' THEN 50 + (e * 7) % 3967 END::DOUBLE AS mr,
  (50 + (q * 37) % 4000)::DOUBLE AS ug, (50 + e % 3989)::DOUBLE AS ur
  FROM (SELECT pk, unnest(range(12)) AS sid FROM probes) g JOIN probes p ON p.pk = g.pk LEFT JOIN cells c ON c.pk = g.pk AND c.sid = g.sid),
mu AS (SELECT *, CASE col WHEN 'G' THEN mg WHEN 'R' THEN mr ELSE ug END AS m, CASE col WHEN 'G' THEN ug WHEN 'R' THEN ur ELSE ur END AS u FROM signals),
raw_betas AS (SELECT *, CASE WHEN m IS NOT NULL AND u IS NOT NULL THEN greatest(m, 1) / greatest(m + u, 2) END AS b0 FROM mu),
betas AS (SELECT * EXCLUDE (b0), CASE WHEN NOT mask THEN b0 END AS beta FROM raw_betas),
samples AS (SELECT DISTINCT s_suppkey % 12 AS sid, 's' || lpad((s_suppkey % 12)::VARCHAR, 2, '0') AS sample_id,
  CASE WHEN s_suppkey % 12 % 2 = 0 THEN 'F' ELSE 'M' END AS sex, 't' || (s_suppkey % 12 % 3) AS tissue, (10 + (7 * (s_suppkey % 12)) % 40)::DOUBLE AS age FROM supplier),
genes AS (SELECT n_name AS gene, 'chr' || (n_nationkey % 5 + 1) AS chrom, 1000 + 8000 * n_nationkey AS start, 4999 + 8000 * n_nationkey AS "end",
  CASE WHEN n_nationkey % 2 = 0 THEN '+' ELSE '-' END AS strand FROM nation),
effect AS (SELECT * REPLACE (CASE WHEN pk % 50 = 0 AND beta IS NOT NULL THEN least(1.0, beta + 0.3 * (sid % 2)) ELSE beta END AS beta) FROM betas)
"""


def oracle(body: str, more: str = "") -> str:
    return f"WITH{' RECURSIVE' if 'SELECT round + 1' in more else ''} {ORACLE.strip()}{', ' + more.strip() if more else ''}\n{body}"
