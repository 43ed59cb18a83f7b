"""Sides that are not broadcast by Spark's estimate of the files they come from."""

import re

import pytest
from beadframe.functions.joins import small_side
from beadframe.queries import QUERIES

#: Joins with a row a probe, or a row a probe and sample, on both sides.
MANY = r"BroadcastHashJoin \[(sample_id#\d+, )?(cast\()?(pk|probe_id|address|addr_[mu]|id_source|k)#.*(Inner|LeftOuter|RightOuter)"


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    """240 parts, each read in six samples of twelve."""
    at = str(tmp_path_factory.mktemp("tables"))
    write = lambda rows, schema, name: spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{at}/{name}.parquet")
    write([(i, f"B{i % 3}", f"T{i % 2}", i % 20, 900.0 + i) for i in range(240)], "p_partkey long, p_brand string, p_type string, p_size int, p_retailprice double", "part")
    write([(i, (i + 2 * k) % 12 + 12 * i, 1 + k, float(1 + i % 50), float(100 + 7 * i + k)) for i in range(240) for k in range(6)], "l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double", "lineitem")
    write([(i,) for i in range(24)], "s_suppkey long", "supplier")
    return at


def planned(df):
    return df._jdf.queryExecution().sparkPlan().toString()


@pytest.mark.parametrize("name", ["control_beads", "mask_all_but", "platform_call", "platform_from_ids", "lift_platforms", "lift_signals", "sex_platforms", "leukocyte_platforms", "idat_signals", "idat_deidentified", "idat_reidentified", "unknown_state"])
def test_many_rows_are_not_broadcast_by_an_estimate(spark, tables, name):
    out = QUERIES[name](spark, tables)
    assert not re.search(MANY, planned(out)), planned(out)
    assert out.count() > 0


def test_a_side_beyond_the_limit_is_plain(spark):
    rows = spark.range(100)
    assert "SortMergeJoin" in planned(rows.join(small_side(spark.range(11), most=10), "id"))
    assert "BroadcastHashJoin" in planned(rows.join(small_side(spark.range(10), most=10), "id"))
