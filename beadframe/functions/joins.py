"""Joins with sides of a checked size."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import stored


def sorted_side(df: DataFrame) -> DataFrame:
    """``df`` as the side of a sort-merge join, however small Spark takes it for.

    Rows that are made from others (a row a sample and probe, ids of several platforms) are
    judged by the files they come from, which can be far smaller: such a side would be sent
    to all tasks by way of the driver.
    """
    return df.hint("merge")


def small_side(df: DataFrame, most: int = 500_000) -> DataFrame:
    """``df`` to be broadcast if it has at most ``most`` rows; beyond that a plain side, whose many keys part evenly.

    Rows are counted when the plan is made, so this is for tables that are cheap to read,
    such as a study's covariates.
    """
    return F.broadcast(df) if df.limit(most + 1).count() <= most else sorted_side(df)


def sample_side(df: DataFrame) -> DataFrame:
    """``df``, computed with a row a sample, as the side of a join: worked out once, and then as :func:`small_side`."""
    return small_side(stored(df, "by-sample"))


def every_sample(rows: DataFrame, samples: DataFrame, blocks: int = 64) -> DataFrame:
    """``rows`` once for each distinct sample_id of ``samples``.

    Samples are listed in ``blocks`` lists, and the rows of a block are an equi-join, so no
    task has to hold the list of a large study.
    """
    block = F.pmod(F.xxhash64("sample_id"), F.lit(blocks)).cast("int").alias("__block")
    lists = samples.select("sample_id").distinct().groupBy(block).agg(F.collect_list("sample_id").alias("__ids"))
    dealt = rows.withColumn("__block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    return dealt.join(lists, "__block").withColumn("sample_id", F.explode("__ids")).drop("__block", "__ids")
