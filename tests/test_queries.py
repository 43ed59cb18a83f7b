"""Queries against their DuckDB oracles, on the small tables."""

import math
import os

import duckdb
import pytest

SF = "/root/testdata/sf0.01"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
SOME = [
    "betas", "detected_betas", "collapse_prefix_minp", "channel_summary", "qc_detection", "enrich_fisher_greater", "enrich_es", "set_overlap", "ols_summary",
    "ols_two_factors", "leukocyte", "sex", "platform_from_ids", "sex_platforms", "noob_fits", "noob", "enrich_es_permuted", "bins_merged", "idat_reidentified", "file_set", "qc_all", "dye_nonlinear", "detect_background", "bisulfite_control", "idat_signals", "region_probes", "unknown_state", "regions", "bin_signals", "species_auc", "impute_reference", "lift_betas", "scrub", "variant_frequency",
]


def plain(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return None
    return float(f"{v:.6g}") if isinstance(v, float) else v


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        path = f"{SF}/{t}.parquet"
        con.sql(f"create view {t} as select * from '{path if os.path.isfile(path) else path + '/*.parquet'}'")
    return con


@pytest.mark.parametrize("name", SOME)
def test_query_equals_oracle(spark, duck, name):
    from beadframe.queries import ORACLES, QUERIES

    got, want = QUERIES[name](spark, SF), duck.sql(ORACLES[name])
    columns = sorted(want.columns)
    assert sorted(got.columns) == columns
    rows = lambda it: sorted((tuple(plain(v) for v in r) for r in it), key=str)
    a = rows(tuple(r[c] for c in columns) for r in got.collect())
    at = [want.columns.index(c) for c in columns]
    b = rows(tuple(r[i] for i in at) for r in want.fetchall())
    assert len(a) == len(b)
    for x, y in zip(a, b):
        assert all(p == q or (isinstance(p, float) and abs(p - q) < 1e-5) for p, q in zip(x, y)), (x, y)


def test_oracles_belong_to_queries():
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
