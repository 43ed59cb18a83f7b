import os
import shutil

import numpy as np
import pytest
from beadframe.sources import idat, idat_source
from beadframe.streaming import pairing
from pyspark.sql import functions as F


@pytest.fixture
def session(spark):
    idat_source.register(spark)
    return spark


def pair(rng, n=40):
    return {c: idat.build(np.arange(1, n + 1), rng.integers(100, 5000, n), rng.integers(0, 20, n)) for c in ("Grn", "Red")}


def rows(files):
    return [(f"elsewhere/{s}_{c}.idat", bytearray(data)) for s, f in files.items() for c, data in f.items()]


def test_write_then_read(session, tmp_path):
    rng = np.random.default_rng(1)
    files = {f"s{k}": pair(rng, 30 + k) for k in range(5)}
    out = str(tmp_path / "out")
    df = session.createDataFrame(rows(files), idat_source.FILES).repartition(3)
    df.write.format("idat").mode("append").save(out)
    assert sorted(os.listdir(out)) == sorted(os.path.basename(p) for p, _ in rows(files))
    for n in (1, 2, 50):
        got = session.read.format("idat").option("pairs", n).load(out)
        want = {(s, i + 1): (float(x["mean"][i]), float(y["mean"][i]), int(x["beads"][i]), int(y["beads"][i])) for s, f in files.items() for x, y in [(idat.parse(f["Grn"]), idat.parse(f["Red"]))] for i in range(len(x["address"]))}
        assert {(r.sample_id, r.address): (r.g, r.r, r.gn, r.rn) for r in got.collect()} == want
        assert got.rdd.getNumPartitions() == -(-5 // n)
    same = idat.beads(session, out)
    assert sorted(map(tuple, same.collect())) == sorted(tuple(r[c] for c in same.columns) for r in got.collect())


def test_append_overwrite_and_failure(session, tmp_path):
    rng, out = np.random.default_rng(2), str(tmp_path / "out")
    make = lambda *names: session.createDataFrame(rows({n: pair(rng) for n in names}), idat_source.FILES)
    make("a").write.format("idat").mode("append").save(out)
    make("b").write.format("idat").mode("append").save(out)
    assert len(os.listdir(out)) == 4
    make("c").write.format("idat").mode("overwrite").save(out)
    assert sorted(os.listdir(out)) == ["c_Grn.idat", "c_Red.idat"]
    with pytest.raises(Exception, match="same file name"):
        make("d").unionByName(make("d")).write.format("idat").mode("append").save(out)
    bad = make("e", "f").withColumn("content", F.when(F.col("path").contains("f_Red"), F.raise_error("lost").cast("binary")).otherwise(F.col("content")))
    with pytest.raises(Exception, match="lost"):
        bad.write.format("idat").mode("append").save(out)
    assert sorted(os.listdir(out)) == ["c_Grn.idat", "c_Red.idat"]


def test_damaged_and_lone_files(session, tmp_path):
    rng = np.random.default_rng(3)
    files = {"ok": pair(rng), "bad": pair(rng) | {"Red": b"IDATnonsense"}}
    for p, data in rows(files):
        (tmp_path / os.path.basename(p)).write_bytes(data)
    (tmp_path / "lone_Grn.idat").write_bytes(idat.build([1], [5], [1]))
    read = lambda **o: session.read.format("idat").options(**o).load(str(tmp_path))
    assert {r.sample_id for r in read(damaged="skip").select("sample_id").distinct().collect()} == {"ok"}
    with pytest.raises(Exception, match="not an IDAT"):
        read().count()
    with pytest.raises(Exception, match="fail or skip"):
        read(damaged="maybe").count()
    empty = tmp_path / "none"
    empty.mkdir()
    assert session.read.format("idat").load(str(empty)).count() == 0


def drain(files, out, checkpoint):
    q = files.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert q.exception() is None


def arrive(folder, source, name, at):
    shutil.copy(source / name, folder / name)
    os.utime(folder / name, (at, at))


def test_pairs_over_batches_and_restarts(session, tmp_path):
    rng = np.random.default_rng(4)
    source, folder, out, checkpoint = (tmp_path / x for x in ("source", "in", "out", "checkpoint"))
    source.mkdir(), folder.mkdir()
    files = {s: pair(rng) for s in ("a", "b", "c", "d")}
    for p, data in rows(files):
        (source / os.path.basename(p)).write_bytes(data)
    stream = lambda: pairing.pair_arrivals(pairing.arrivals(session, str(folder)), "1 hour", event_time=True)
    start = 1_700_000_000
    arrive(folder, source, "a_Grn.idat", start)
    arrive(folder, source, "c_Grn.idat", start)
    arrive(folder, source, "b_Red.idat", start + 60)
    arrive(folder, source, "b_Grn.idat", start + 60)
    drain(stream(), str(out), str(checkpoint))
    found = lambda: sorted((os.path.basename(r.prefix), r.green is not None, r.red is not None, r.status) for r in session.read.schema(pairing.PAIRS).parquet(str(out)).collect())
    assert found() == [("b", True, True, "pair")]
    arrive(folder, source, "a_Red.idat", start + 600)  # another run of the query: state comes from the checkpoint
    drain(stream(), str(out), str(checkpoint))
    assert found() == [("a", True, True, "pair"), ("b", True, True, "pair")]
    arrive(folder, source, "d_Grn.idat", start + 7200)
    arrive(folder, source, "d_Red.idat", start + 7200)
    drain(stream(), str(out), str(checkpoint))
    assert found() == [("a", True, True, "pair"), ("b", True, True, "pair"), ("c", True, False, "lone"), ("d", True, True, "pair")]
    beads = pairing.pair_beads(session.read.schema(pairing.PAIRS).parquet(str(out)))
    assert {r.sample_id: r["count"] for r in beads.groupBy("sample_id").count().collect()} == {"a": 40, "b": 40, "d": 40}
