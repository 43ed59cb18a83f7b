import gzip
import hashlib

from beadframe.llm import warc

SCHEMA = "page_id long, url string, html string, payload int, low string"


def record(i, body):
    http = b"HTTP/1.1 200 OK\r\nContent-Length: %d\r\n\r\n" % len(body)
    head = f"WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:x-page:{i}>\r\nWARC-Payload-Digest: sha256:{hashlib.sha256(body).hexdigest()}\r\nContent-Length: {len(http) + len(body)}\r\n\r\n"
    return head.encode() + http + body + b"\r\n\r\n"


def ids(data):
    return [(x[0], x[1], x[2], x[3].get("warc-record-id") if x[0] == "record" else None) for x in warc.salvage(data)]


def covered(data):
    at = 0
    for _, a, b, *_ in warc.salvage(data):
        assert a == at
        at = b
    assert at == len(data)


def test_round_trip(spark):
    long = "é<p>" * 40
    rows = [(5, "u5", long), (3, "u3", long), (9, "u9", long), (1, None, "short"), (2, "u\r\n2", "short"), (4, "u4", None), (None, "x", long), (7, "u7", "a\r\n\r\nWARC/1.1\r\nb" * 20), (9, "u9", long)]
    df = spark.createDataFrame([(*r, 1, "z") for r in rows], SCHEMA)
    got = sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in warc.round_trip(df).collect()), key=str)
    want = []
    for i, _, h in rows:
        b = (h or "").encode()
        low = 3 if h == long and i != 3 else None
        want.append((i, len(b), hashlib.sha256(b).hexdigest(), "revisit" if low else "response", low))
    assert got == sorted(want, key=str)


def test_empty_table(spark):
    assert warc.round_trip(spark.createDataFrame([], SCHEMA)).count() == 0


def test_payloads_come_back(spark, tmp_path):
    df = spark.createDataFrame([(i, f"u{i}", f"page {i} é " * 30, 1, "z") for i in range(50)], SCHEMA)
    warc.write(df, str(tmp_path / "w"), file_bytes=1 << 18)
    assert len(list((tmp_path / "w").glob("part-*"))) >= 50 // 4
    got = {r.page_id: bytes(r.payload).decode() for r in warc.read(spark, str(tmp_path / "w")).collect()}
    assert got == {i: f"page {i} é " * 30 for i in range(50)}


def test_salvage_of_damage():
    parts = [record(i, b"body %d " % i * 30) for i in range(6)]
    whole = b"".join(parts)
    assert [x[3] for x in ids(whole)] == [f"<urn:x-page:{i}>" for i in range(6)]
    for damage in (
        lambda b: b.replace(b"WARC/1.1", b"WXRC/1.1"),
        lambda b: b.replace(b"Content-Length: ", b"Content-Length: 9", 1),
        lambda b: b.replace(b"body 2", b"b0dy 2", 1),
        lambda b: b[:150],
        lambda b: b"",
    ):
        data = b"".join(parts[:2]) + damage(parts[2]) + b"".join(parts[3:])
        found = ids(data)
        assert [x[3] for x in found if x[0] == "record"] == [f"<urn:x-page:{i}>" for i in (0, 1, 3, 4, 5)]
        assert len([x for x in found if x[0] == "gap"]) == (damage(parts[2]) != b"")
        covered(data)
    covered(b"\x00" * 500)
    covered(whole[:-3])


def test_salvage_of_gzip_members():
    parts = [gzip.compress(record(i, b"body %d " % i * 30)) for i in range(5)]
    broken = bytearray(parts[2])
    broken[40] ^= 0xFF
    data = parts[0] + parts[1] + bytes(broken) + b"junk" + parts[3] + parts[4][:-9]
    assert [x[3] for x in ids(data) if x[0] == "record"] == [f"<urn:x-page:{i}>" for i in (0, 1, 3)]
    covered(data)


def test_files_are_bounded_by_bytes(spark, tmp_path):
    df = spark.createDataFrame([(i, f"u{i}" + "x" * 100_000 * (i == 3), "y" * (300_000 if i % 5 == 0 else 50), 1, "z") for i in range(40)], SCHEMA).coalesce(1)
    warc.write(df, str(tmp_path / "w"), file_bytes=1 << 21)
    sizes = [p.stat().st_size for p in (tmp_path / "w").glob("part-*")]
    assert max(sizes) < (1 << 21) + 200_000 and len(sizes) > 2
    got = warc.read(spark, str(tmp_path / "w"), with_payload=False).collect()
    assert sorted(r.page_id for r in got) == list(range(40)) and {r.kind for r in got} == {"record"}


def test_gaps_are_logged_through_spark(spark, tmp_path):
    parts = [record(i, b"body %d " % i * 30) for i in range(5)]
    (tmp_path / "a.warc").write_bytes(parts[0] + parts[1].replace(b"WARC/1.1", b"WXRC/1.1") + parts[2])
    (tmp_path / "b.warc.gz").write_bytes(gzip.compress(parts[3]) + b"\x1f\x8b\x08 junk" + gzip.compress(parts[4]))
    rows = warc.read(spark, str(tmp_path)).collect()
    assert sorted(r.page_id for r in rows if r.kind == "record") == [0, 2, 3, 4]
    gaps = [(r.path.rpartition("/")[2], r.offset, r.length) for r in rows if r.kind == "gap"]
    assert sorted(gaps) == [("a.warc", len(parts[0]), len(parts[1])), ("b.warc.gz", len(gzip.compress(parts[3])), 8)] and all(r.reason for r in rows if r.kind == "gap")


def test_a_member_is_bounded():
    import pytest

    data = gzip.compress(record(1, b"a" * 10**6))
    assert warc.parse_member(data, 0)[0] == len(data)
    with pytest.raises(warc.Damaged):
        warc.parse_member(data, 0, most=10**5)
