"""Column builders shared by operators: BH adjustment, mean ranks, log-factorials."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .store import stored


def benjamini_hochberg(df: DataFrame, p: str, out: str, by: list[str] | None = None, ties: list[str] | None = None) -> DataFrame:
    """Adds adjusted p-values within ``by``; null p stay null and do not count.

    With ``by`` a group's values are ordered together: it is a result table (a row a set or
    segment). Without, all rows are one group, and are ranked over many tasks.
    """
    if not by:
        return _adjusted(df, p, out, ties or [])
    keys = [F.col(c) for c in by]
    held = F.col(p).isNotNull()
    n = F.sum(held.cast("int")).over(W.partitionBy(*keys))
    rank = F.row_number().over(W.partitionBy(*keys, held).orderBy(F.col(p), *(ties or [])))
    rows = df.withColumns({"__n": n, "__i": rank})
    down = W.partitionBy(*keys, held).orderBy(F.col("__i").desc()).rowsBetween(W.unboundedPreceding, 0)
    best = F.min(F.col(p) * F.col("__n") / F.col("__i")).over(down)
    return rows.withColumn(out, F.when(held, F.least(F.lit(1.0), best))).drop("__n", "__i")


def _adjusted(df: DataFrame, p: str, out: str, ties: list[str]) -> DataFrame:
    """The rank is the place within a range of p plus the rows of the ranges before, and the
    running minimum from above is the range's own or that of the ranges after: one row a range
    tells both."""
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = df.where(F.col(p).isNotNull()).repartitionByRange(parts, p, *ties).sortWithinPartitions(p, *ties)
    mono = F.monotonically_increasing_id()
    rows = stored(dealt.withColumn("__mono", mono), "ranked").withColumns({"__part": F.shiftright("__mono", 33), "__i": F.col("__mono").bitwiseAND((1 << 33) - 1) + 1})
    order = W.orderBy("__part")  # a row a range
    counts = rows.groupBy("__part").agg(F.count("*").alias("__c"))
    offsets = counts.select("__part", F.coalesce(F.sum("__c").over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("__off"), F.sum("__c").over(order.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)).alias("__n"))
    rows = rows.join(F.broadcast(offsets), "__part").withColumn("__v", F.col(p) * F.col("__n") / (F.col("__i") + F.col("__off")))
    lows = rows.groupBy("__part").agg(F.min("__v").alias("__low"))
    later = lows.select("__part", F.min("__low").over(order.rowsBetween(1, W.unboundedFollowing)).alias("__later"))
    down = W.partitionBy("__part").orderBy(F.col("__i").desc()).rowsBetween(W.unboundedPreceding, 0)
    rows = rows.join(F.broadcast(later), "__part").withColumn(out, F.least(F.lit(1.0), F.min("__v").over(down), "__later"))
    return rows.select(*df.columns, out).unionByName(df.where(F.col(p).isNull()).withColumn(out, F.lit(None).cast("double")))


def mean_rank(value: str | Column, by: list[str]) -> Column:
    """Rank with ties sharing their mean."""
    v = F.col(value) if isinstance(value, str) else value
    order = W.partitionBy(*by).orderBy(v)
    ties = F.count("*").over(W.partitionBy(*by, v))
    return F.rank().over(order) + (ties - 1) / 2.0


def log_factorial(n: str) -> str:
    """SQL for ln n!: exact below 10, Stirling's series above (error under 1e-12)."""
    import math

    small = ", ".join(f"{math.lgamma(k + 1)!r}D" for k in range(10))
    x = f"CAST({n} AS DOUBLE)"
    big = f"({x} + 0.5D) * ln({x}) - {x} + {0.5 * math.log(2 * math.pi)!r}D + 1D / (12D * {x}) - 1D / (360D * pow({x}, 3)) + 1D / (1260D * pow({x}, 5))"
    return f"(CASE WHEN {n} < 10 THEN element_at(array({small}), CAST({n} AS INT) + 1) ELSE {big} END)"
