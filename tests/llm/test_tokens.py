import zlib

import numpy as np
import pytest
from beadframe.llm import token_output as t
from beadframe.llm import token_scan
from beadframe.llm.tokens import WordIds

TEXTS = [
    "", " \n", "á ́x é", "ΣΑΣ ΟΔΟΣ, ΣΑΣ", "I'M don't  it's'll 'S don't, it's.", "x<|endoftext|>y <|startoftext|> z <|endoftext|>", "ﬁ ① Ⅷ İstanbul b\x85c　d",
    "\x1c\x1d x\x1fy\x00z", "\U0001f600\U0001f601 中文字", "1234 5,6 word, word. word., w..", "ß ẞ ŉ ª º µ À×Þ÷ÿ", "a" * 3000, "é, è. Ö,x", "a\tb\r\nc\x0bd",
]


@pytest.fixture(scope="module")
def tokenizer():
    public = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    return public.path("word_bpe_49k.json"), Tokenizer.from_file(public.path("word_bpe_49k.json"))


def test_words_give_the_librarys_ids(tokenizer):
    import duckdb

    path, library = tokenizer
    texts = TEXTS + [r[0] for r in duckdb.sql("select text from '/root/testdata/sf0.001/documents.parquet'").fetchall()]
    want = [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]
    assert [x.tolist() for x in WordIds(path).encode(texts)] == want
    assert [x.tolist() for x in WordIds(path, most=5).encode(texts)] == want


@pytest.mark.parametrize("n", [0, 1, 5, 1023, 1024, 1025, 200_000])
def test_block_round_trip(n):
    ids = np.append((np.random.default_rng(n).zipf(1.3, n) % 49408).astype(np.uint32), 1)[: max(n, 0)]
    table = t.Table(t.scaled(np.bincount(np.append(ids, 1), minlength=10)))
    data = t.encode_block(ids, table)
    assert (t.decode_block(data, table) == ids).all()
    for c in range(1, -(-(-(-n // t.LANES)) // t.CHECK_STEPS)):
        assert (t.decode_block(data, table, c) == ids[c * t.CHECK_STEPS * t.LANES :]).all()
    for at in (0, len(data) // 2, len(data) - 1):
        bad = bytearray(data)
        bad[at] ^= 4
        with pytest.raises(ValueError):
            t.decode_block(bytes(bad), table)


def test_scaled_frequencies():
    for counts in ([5], [1, 0, 1], [10**12, 1, 1], list(range(5000))):
        f = t.scaled(np.array(counts))
        assert f.sum() == 1 << t.PRECISION and ((f > 0) == (np.array(counts) > 0)).all()
    assert t.scaled(np.zeros(3, int)).sum() == 0


ROWS = [(7, "seven words"), (3, None), (3, "again"), (3, "again"), (None, "no id"), (-2, ""), (5, "long text, " * 30000), (9, "x<|endoftext|>y")]


def expected(rows, library):
    out, at = [], 0
    for i, x in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        ids = library.encode(x or "", add_special_tokens=False).ids + [1]
        out.append((i, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
    return sorted(out, key=str)


def test_files_round_trip(spark, tokenizer):
    df = spark.createDataFrame([(*r, 1, b"x") for r in ROWS], "doc_id long, text string, part int, ids binary")
    got = t.round_trip(df).collect()
    assert sorted(((r.doc_id, r.n_tokens, r.ids_crc32) for r in got), key=str) == expected(ROWS, tokenizer[1])
    placed = sorted(got, key=lambda r: r.start)
    assert [r.start for r in placed] == [sum(x.n_tokens for x in placed[:k]) for k in range(len(placed))]
    names = [r.doc_id for r in placed]
    assert names[0] is None and names[1:] == sorted(names[1:])


def test_empty_tables(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert t.round_trip(df).count() == 0
    assert token_scan.count_documents(df).count() == 0


@pytest.mark.parametrize("block", [1, 2, 7, 65536])
def test_separator_scan(spark, tokenizer, block):
    library = tokenizer[1]
    library.encode_special_tokens = True
    rows = [(i, x if len(x or "") < 2000 or block > 100 else "cut " * 30) for i, x in ROWS]
    want = sorted(((i, len(library.encode(x or "", add_special_tokens=False).ids)) for i, x in rows), key=str)
    library.encode_special_tokens = False
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = token_scan.count_documents(df, block=block, lines=1).collect()
    assert sorted(((r.doc_id, r.n_tokens) for r in got), key=str) == want and all(r.closed for r in got)


def test_scan_of_foreign_files(spark, tmp_path):
    ids = np.array([5, 6, 9, 9, 7, 9, 1, 2], "<u2")
    parts = {"part-00000-x-c000.txt": ids[:4], "part-00000-x-c001.txt": ids[4:], "part-00001-x-c000.txt": ids[:0], "part-00002-x.txt": np.array([9], "<u2")}
    for name, data in parts.items():
        (tmp_path / name).write_bytes(data.tobytes())
    got = token_scan.scan(token_scan.files(spark, str(tmp_path)), end=9, block=3)
    assert sorted(map(tuple, got.collect())) == [(0, 0, 0, 2, True), (0, 1, 3, 0, True), (0, 2, 4, 1, True), (0, 3, 6, 2, False), (2, 0, 0, 0, True)]


def test_flat_files_hold_ids_alone(spark, tokenizer, tmp_path):
    df = spark.createDataFrame([(1, "one word"), (None, None), (3, "x<|endoftext|>")], "doc_id long, text string").coalesce(1)
    token_scan.write_flat(df, str(tmp_path / "flat"))
    data = b"".join(p.read_bytes() for p in (tmp_path / "flat/kind=ids").glob("part-*"))
    library = tokenizer[1]
    library.encode_special_tokens = True
    want = [i for t in ("one word", "", "x<|endoftext|>") for i in [*library.encode(t, add_special_tokens=False).ids, token_scan.END]]
    library.encode_special_tokens = False
    assert np.frombuffer(data, "<u2").tolist() == want


def test_equal_rows_are_spread_over_parts(spark):
    df = spark.range(0, 40_000, 1, 4).selectExpr("cast(null as long) as doc_id", "cast(null as string) as text")
    sizes = [r["count"] for r in t.tokenised(df).groupBy("part").count().collect()]
    assert sum(sizes) == 40_000 and max(sizes) < 20_000


def test_files_of_a_part_keep_their_turns(spark, tmp_path):
    df = spark.createDataFrame([(i, "word " * (70_000 if i % 2 else 2)) for i in range(5)], "doc_id long, text string").coalesce(1)
    token_scan.write_flat(df, str(tmp_path / "f"), lines=1)
    found = token_scan.files(spark, str(tmp_path / "f")).where("kind = 'ids'")
    assert found.select("turn").distinct().count() == found.count() > 2
    got = token_scan.joined(spark, str(tmp_path / "f")).orderBy("ordinal").collect()
    assert [(r.doc_id, r.n_tokens) for r in got] == [(i, 70_000 if i % 2 else 2) for i in range(5)]
