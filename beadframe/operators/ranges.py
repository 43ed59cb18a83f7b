"""Genomic ranges: overlap joins, tiles, gaps and coordinate helpers. Ranges are 1-based and closed."""

from __future__ import annotations

import heapq

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def overlap_join(left: DataFrame, right: DataFrame, width: int = 10_000) -> DataFrame:
    """Pairs of ranges (chrom, start, end) that overlap; right's ends come as r_start, r_end.

    Both sides are dealt to the bins that they touch and joined by (chrom, bin); a pair is
    reported only in the first bin that both touch, so there is nothing to de-duplicate.
    """
    bins = lambda a, b: F.sequence(F.floor(a / width).cast("long"), F.floor(b / width).cast("long"))
    l = left.withColumn("__bin", F.explode(bins(F.col("start"), F.col("end"))))  # noqa: E741
    r = right.withColumnsRenamed({"start": "r_start", "end": "r_end"}).withColumn("__bin", F.explode(bins(F.col("r_start"), F.col("r_end"))))
    meet = (F.col("r_start") <= F.col("end")) & (F.col("start") <= F.col("r_end"))
    first = F.col("__bin") == F.floor(F.greatest("start", "r_start") / width)
    return l.join(r, ["chrom", "__bin"]).where(meet & first).drop("__bin")


def count_overlaps(left: DataFrame, right: DataFrame, keys: list[str], width: int = 10_000) -> DataFrame:
    """Left rows' keys with ``n``, the number of right ranges that they overlap (0 too)."""
    n = overlap_join(left, right.select("chrom", "start", "end"), width).groupBy(*keys).agg(F.count("*").alias("n"))
    return left.select(*keys).distinct().join(n, keys, "left").withColumn("n", F.coalesce("n", F.lit(0)))


def tiles(lengths: DataFrame, width: int = 50_000) -> DataFrame:
    """(chrom, start, end): consecutive tiles over (chrom, length)."""
    starts = F.sequence(F.lit(1).cast("long"), F.col("length").cast("long"), F.lit(width).cast("long"))
    return lengths.select("chrom", "length", F.explode(starts).alias("start")).select("chrom", "start", F.least(F.col("start") + width - 1, "length").alias("end"))


def minus_gaps(pieces: DataFrame, gaps: DataFrame, width: int = 50_000) -> DataFrame:
    """What is left of disjoint ranges when gaps are cut out."""
    cut = overlap_join(pieces, gaps.select("chrom", "start", "end"), width).groupBy("chrom", "start", "end").agg(F.sort_array(F.collect_list(F.struct("r_start", "r_end"))).alias("gaps"))
    rows = pieces.join(cut, ["chrom", "start", "end"], "left")
    # Gaps in order; a piece lies between the furthest end so far and the next gap's start.
    left = F.expr("""
      aggregate(coalesce(gaps, CAST(array() AS array<struct<r_start: bigint, r_end: bigint>>)),
        struct(CAST(start AS BIGINT) AS at, CAST(array() AS array<struct<s: bigint, e: bigint>>) AS out),
        (a, g) -> struct(greatest(a.at, g.r_end + 1) AS at,
          CASE WHEN g.r_start > a.at THEN concat(a.out, array(struct(a.at AS s, CAST(g.r_start - 1 AS BIGINT) AS e))) ELSE a.out END AS out),
        a -> CASE WHEN a.at <= end THEN concat(a.out, array(struct(a.at AS s, CAST(end AS BIGINT) AS e))) ELSE a.out END)""")
    return rows.select("chrom", F.explode(left).alias("x")).select("chrom", F.col("x.s").alias("start"), F.col("x.e").alias("end"))


def merge_small(bins: DataFrame, least: int = 20) -> DataFrame:
    """Bins (chrom, start, end, n) with each small one merged into a neighbour that it touches.

    The smallest bin (the first of equals) goes into its left neighbour if they touch, else
    into its right one; a small bin that touches none is dropped. One chromosome's bins are
    one group: their number is set by the genome, not by the data. A heap finds the
    smallest, a linked list its neighbours, so n bins take n log n steps.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("start")
        start, end, n = (pdf[c].tolist() for c in ("start", "end", "n"))
        size = len(n)
        left, right = list(range(-1, size - 1)), [*range(1, size), -1]
        held, alive = [(x, i) for i, x in enumerate(n)], [True] * size
        heapq.heapify(held)
        while held and held[0][0] < least:
            x, i = heapq.heappop(held)
            if not alive[i] or x != n[i]:
                continue  # it was merged, or has grown since
            a, b, alive[i] = left[i], right[i], False
            into = a if a >= 0 and end[a] + 1 == start[i] else b if b >= 0 and end[i] + 1 == start[b] else -1
            if into >= 0:
                start[into], end[into], n[into] = min(start[into], start[i]), max(end[into], end[i]), n[into] + x
                heapq.heappush(held, (n[into], into))
            if a >= 0:
                right[a] = b
            if b >= 0:
                left[b] = a
        rows = [(pdf["chrom"].iloc[0], start[i], end[i], n[i]) for i in range(size) if alive[i]]
        return pd.DataFrame(rows, columns=["chrom", "start", "end", "n"])

    return bins.select("chrom", "start", "end", F.col("n").cast("long")).groupBy("chrom").applyInPandas(run, "chrom string, start long, end long, n long")


def chrom_key(chrom: Column) -> Column:
    """Order of chromosomes: numbers, then X, Y and M."""
    name = F.regexp_replace(chrom, "^chr", "")
    return F.coalesce(name.try_cast("int"), F.when(name == "X", 1001).when(name == "Y", 1002).when(name == "M", 1003).otherwise(1004))


def gene_sets(probes: DataFrame, genes: DataFrame, query: DataFrame | None = None, distance: int = 10_000) -> DataFrame:
    """(dbname, probe_id): probes within ``distance`` of a gene that has a query probe within it."""
    wide = probes.select("probe_id", "chrom", (F.col("start") - distance).alias("start"), (F.col("end") + distance).alias("end"))
    g = genes.select("gene", "chrom", "start", "end")
    if query is not None:
        near = overlap_join(wide.join(query.select("probe_id").distinct(), "probe_id", "left_semi"), g)
        g = g.join(near.select("gene").distinct(), "gene", "left_semi")
    return overlap_join(wide, g).select(F.col("gene").alias("dbname"), "probe_id").distinct()


def exon_cds(exons: DataFrame) -> DataFrame:
    """Exons (start, end, cds_start, cds_end) clipped to their coding part; those without are dropped."""
    out = exons.withColumns({"start": F.greatest("start", "cds_start"), "end": F.least("end", "cds_end")})
    return out.where("start <= end")
