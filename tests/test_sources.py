import gzip

import numpy as np
import pytest
from beadframe.operators import masks
from beadframe.plans import prep
from beadframe.sources import idat, tables
from beadframe.streaming import ingest
from pyspark.sql import functions as F


@pytest.fixture
def folder(tmp_path):
    rng = np.random.default_rng(7)
    for s in ("1_R01", "2_R01"):
        for c in ("Grn", "Red"):
            data = idat.build(np.arange(1, 41), rng.integers(100, 5000, 40), rng.integers(0, 20, 40))
            name = tmp_path / "sub" / f"{s}_{c}.idat"
            name.parent.mkdir(exist_ok=True)
            if c == "Red":
                (tmp_path / "sub" / f"{s}_{c}.idat.gz").write_bytes(gzip.compress(data))
            else:
                name.write_bytes(data)
    (tmp_path / "lone_Grn.idat").write_bytes(idat.build([1], [5], [1]))
    return str(tmp_path)


def test_read_beads(spark, folder):
    assert idat.prefixes(spark, folder).count() == 2
    rows = idat.beads(spark, folder).collect()
    assert len(rows) == 80 and all(r.g is not None and r.r is not None for r in rows)
    one = idat.parse(open(f"{folder}/sub/1_R01_Grn.idat", "rb").read())
    got = {r.address: (r.g, r.gn) for r in rows if r.sample_id == "1_R01"}
    assert got == {int(a): (float(m), int(b)) for a, m, b in zip(one["address"], one["mean"], one["beads"])}


def test_damaged_file_gives_an_error_row(spark, folder):
    open(f"{folder}/sub/1_R01_Grn.idat", "wb").write(b"IDATnonsense")
    assert idat.bead_rows(idat.files(spark, folder)).where("error is not null").count() == 1


def test_signals_from_beads(spark, folder):
    manifest = spark.createDataFrame([("cg1", 2, 1, "G", False), ("cg2", None, 3, None, False), ("cg3", None, 999, None, True)], "probe_id string, addr_m long, addr_u long, col string, mask boolean")
    beads = idat.beads(spark, folder)
    s = {(r.sample_id, r.probe_id): r for r in idat.to_signals(beads, manifest, 5).collect()}
    b = {(r.sample_id, r.address): r for r in beads.collect()}
    x = s["1_R01", "cg1"]
    assert (x.mg, x.mr, x.ug, x.ur, x.col) == (b["1_R01", 2].g, b["1_R01", 2].r, b["1_R01", 1].g, b["1_R01", 1].r, "G")
    assert x.mask == any(n < 5 for a in (1, 2) for n in (b["1_R01", a].gn, b["1_R01", a].rn))
    y, z = s["1_R01", "cg2"], s["2_R01", "cg3"]
    assert y.col == "2" and y.mg is None and y.ug == b["1_R01", 3].g and z.ug is None and z.mask


def test_platform(spark, folder):
    sig = spark.createDataFrame([("A", i) for i in range(1, 11)] + [("B", i) for i in range(900, 915)], "platform string, address int")
    assert {r.platform for r in idat.infer_platform(idat.beads(spark, folder), sig).collect()} == {"A"}


def test_platform_override_and_status(spark, folder, tmp_path):
    manifest = spark.createDataFrame([("A", "cg1", 2, 1, "G", False), ("B", "cg2", None, 3, None, False)], "platform string, probe_id string, addr_m long, addr_u long, col string, mask boolean")
    sig = spark.createDataFrame([("A", i) for i in range(1, 11)] + [("B", i) for i in range(900, 915)], "platform string, address int")
    probes = lambda **o: {(r.sample_id, r.probe_id) for r in prep.run_folder(spark, folder, manifest, "0", **o).collect()}
    assert probes(signatures=sig) == {("1_R01", "cg1"), ("2_R01", "cg1")} and probes(platform="B") == {("1_R01", "cg2"), ("2_R01", "cg2")}
    with pytest.raises(ValueError):
        probes()
    open(f"{folder}/sub/2_R01_Grn.idat", "wb").write(b"IDATnonsense")
    out = str(tmp_path / "fs")
    status = {r.sample_id: r.status for r in prep.folder_to_file_set(spark, folder, out, manifest, "0", signatures=sig).collect()}
    assert status == {"1_R01": "ok", "2_R01": "failed", "lone": "incomplete"}
    assert {r.sample_id for r in tables.read_file_set(spark, out).collect()} == {"1_R01"}
    unknown = idat.infer_platform(idat.beads(spark, folder), sig.where("platform = 'B'"))
    assert {r.status for r in idat.folder_status(spark, folder, unknown).where("sample_id = '1_R01'").collect()} == {"no platform"}


def test_deidentify_round_trip(spark, folder):
    files = idat.files(spark, folder)
    secret = [3, 8, 9, 20, 33]
    before = {r.path: bytes(r.content) for r in files.collect()}
    mixed = idat.deidentify(files, secret, seed=5)
    assert all("_noid_" in r.path for r in mixed.collect())
    back = {r.path.replace("_noid", ""): idat.parse(bytes(r.content))["mean"].tolist() for r in idat.deidentify(mixed, secret, seed=5, undo=True).collect()}
    assert back == {p: idat.parse(c)["mean"].tolist() for p, c in before.items()}
    zero = idat.parse(bytes(idat.deidentify(files, secret).first().content))
    assert (zero["mean"][np.isin(zero["address"], secret)] == 0).all() and (zero["mean"] > 0).sum() == 35


def test_signal_text_round_trip(spark, tmp_path):
    df = spark.createDataFrame([("a", "cg1", 1.5, None, 2.0, 3.0, "G", True), ("a", "cg2", None, None, 2.0, 3.0, "2", False)], tables.SIGNALS)
    tables.write_signals(df, str(tmp_path / "t"))
    assert sorted(map(tuple, tables.read_signals(spark, str(tmp_path / "t")).collect()), key=str) == sorted(map(tuple, df.collect()), key=str)


def test_file_set(spark, tmp_path):
    make = lambda s, v: spark.createDataFrame([(s, f"p{i}", v) for i in range(5)], "sample_id string, probe_id string, beta double")
    path = str(tmp_path / "fs")
    tables.write_file_set(make("a", 0.25).unionByName(make("b", 0.5)), path)
    tables.write_file_set(make("b", 0.75), path)
    store = tables.read_file_set(spark, path)
    assert {(r.sample_id, r.beta) for r in store.select("sample_id", "beta").distinct().collect()} == {("a", 0.25), ("b", 0.75)}
    probes = spark.createDataFrame([("p1",), ("p9",)], "probe_id string")
    assert [tuple(r) for r in tables.slice_file_set(store, ["b"], probes).collect()] == [("b", "p1", 0.75)]
    with pytest.raises(ValueError):
        tables.slice_file_set(store, ["a", "b"], probes, most=1)


def test_sets_and_vcf_files(spark, tmp_path):
    (tmp_path / "g.tsv").write_text("Probe_ID\tKnowledgebase\ncg1\tgrp;a;b\ncg2\tgrp;c\n")
    assert {tuple(r) for r in tables.read_sets(spark, str(tmp_path / "g.tsv")).collect()} == {("grp", "a;b", "cg1"), ("grp", "c", "cg2")}
    lines = spark.createDataFrame([("chr10", 5, "x", "A", "G", 30, "PASS", "i"), ("chr2", 7, "y", "A", "H", 3, "FAIL", "i")], "chrm string, pos long, id string, ref string, alt string, qual int, filter string, info string")
    tables.write_vcf(lines, str(tmp_path / "v"))
    text = [r.value for r in spark.read.text(str(tmp_path / "v")).collect()]
    assert any(t.startswith("#CHROM") for t in text) and sum(t.startswith("chr") for t in text) == 2


def test_matrix_import(spark):
    m = spark.createDataFrame([("s", "cg1", 11436.0, 1476.0), ("s", "cg2", 6068.0, 804.0), ("s", "cg3", 2864.0, 393.0)], "sample_id string, probe_id string, m double, u double")
    manifest = spark.createDataFrame([("cg1", "G", False), ("cg2", "R", False), ("cg3", None, False)], "probe_id string, col string, mask boolean")
    got = {r.probe_id: r for r in tables.import_mu(m, manifest).collect()}
    assert (got["cg1"].mg, got["cg1"].ug) == (11436, 1476) and got["cg1"].mr >= 50 and (got["cg2"].mr, got["cg2"].ur) == (6068, 804)
    assert (got["cg3"].mg, got["cg3"].ug, got["cg3"].ur) == (None, 2864, 393)


SIGNALS = "sample_id string, probe_id string, mg double, mr double, ug double, ur double, col string, mask boolean"


def test_prep_codes(spark):
    df = spark.createDataFrame([("a", "cg1", 900.0, 10.0, 100.0, 20.0, "G", True), ("a", "rs2", None, None, 30.0, 70.0, "2", False)], SIGNALS)
    assert [c for c, _ in prep.describe()][:3] == ["0", "Q", "G"]
    got = {r.probe_id: r.beta for r in prep.run(df, "0G").collect()}
    assert got == {"cg1": 0.9, "rs2": None}
    assert {r.probe_id: r.mask for r in masks.prefix_mask_but_cg(masks.reset_mask(df)).collect()} == {"cg1": False, "rs2": True}
    with pytest.raises(ValueError):
        prep.prepare(df, "X")


def test_streams(spark, folder, tmp_path):
    out = ingest.bead_stream(spark, f"{folder}/sub").writeStream.format("memory").queryName("bead_rows").option("checkpointLocation", str(tmp_path / "c1")).trigger(availableNow=True).start()
    out.awaitTermination(60)
    assert spark.table("bead_rows").count() == 160
    src, path = str(tmp_path / "src"), str(tmp_path / "set")
    spark.createDataFrame([("a", "cg1", 900.0, 10.0, 100.0, 20.0, "G", False)], SIGNALS).write.parquet(src)
    ingest.betas_to_file_set(spark.readStream.schema(SIGNALS).parquet(src), path, str(tmp_path / "c2")).awaitTermination(60)
    assert tables.read_file_set(spark, path).first().beta == pytest.approx(0.9)
    timed = spark.createDataFrame([("a", 1.0, 2.0)], "sample_id string, m double, u double").withColumn("time", F.current_timestamp())
    assert ingest.intensity_windows(timed).first().n == 1
