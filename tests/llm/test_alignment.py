import hashlib
import random
from collections import Counter

import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece
from beadframe.llm import alignment as al
from tokenizers import Tokenizer

A, B = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")), sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
A.encode_special_tokens = True
ALPHABET = ["a", "the ", " ", "   ", "\n", "\n\n", "\t", "é", " naïve", "日本", "😀", " ", " ", "<|endoftext|>", "</s>", "<0x0A>", "hello", "'s", "1234", " .", "...", "\x1c", "\x85", "​"]


def byte_of(c):
    """The byte that the vocabulary writes as ``c``, by the decoder of the library."""
    shown = set(range(33, 127)) | set(range(161, 173)) | set(range(174, 256))
    rest = [b for b in range(256) if b not in shown]
    return ord(c) if ord(c) < 256 else rest[ord(c) - 256]


def plain(texts):
    """Every pair of tokens of a text, compared by their byte ranges."""
    rows, links = [], []
    for text in texts:
        a = A.encode(" " + (text or ""), add_special_tokens=False).ids
        b = B.encode(text or "")
        ab = [bytes(map(byte_of, A.id_to_token(i))) for i in a]
        names = [B.id_to_piece(i) for i in b]
        bb = [bytes([int(x[3:5], 16)]) if B.is_byte(i) else x.replace("▁", " ").encode() for i, x in zip(b, names)]
        if not text or not b"".join(ab) == b"".join(bb) == (" " + text).encode():
            rows.append((0, 0, 0, 0, ""))
            links.append([])
            continue
        ae, be = ([sum(map(len, x[: k + 1])) for k in range(len(x))] for x in (ab, bb))
        both = sorted(set(ae) & set(be))
        parts = []
        for lo, hi in zip([0, *both], both):
            parts.append(",".join(str(i) for i, e in zip(a, ae) if lo < e <= hi) + "|" + ",".join(str(i) for i, e in zip(b, be) if lo < e <= hi))
        found = [(x, y) for x, xe, xb in zip(a, ae, ab) for y, ye, yb in zip(b, be, bb) if max(xe - len(xb), ye - len(yb)) < min(xe, ye)]
        rows.append((len(a), len(b), len(both), len(found), ";".join(parts)))
        links.append(found)
    counts = Counter(x for f in links for x in f)
    most = {}
    for (_, y), n in counts.items():
        most[y] = max(most.get(y, 0), n)
    return [(*r[:4], sum(counts[x] == most[x[1]] for x in f), sum(counts[x] for x in f), hashlib.sha256(r[4].encode()).hexdigest() if r[4] else "", r[4]) for r, f in zip(rows, links)]


def some_texts(n, seed):
    rnd = random.Random(seed)
    return ["".join(rnd.choices(ALPHABET, k=rnd.randrange(14))) for _ in range(n)] + [None, "", " ", "▁ mark", "a▁b", "x" * 300, "same text", "same text"]


def test_chunks_give_the_libraries_ids():
    both = al.aligner()
    assert both.b.local
    texts = some_texts(1500, 8)
    _, a, b = both.encode(pa.array(texts, pa.string()))
    assert a.to_pylist() == [A.encode(" " + (t or ""), add_special_tokens=False).ids for t in texts]
    assert [y for t, y in zip(texts, b.to_pylist()) if t] == [B.encode(t) for t in texts if t]


def test_what_is_forgotten_is_learned_again():
    from beadframe.llm.chunks import ChunkIds

    cache = ChunkIds(lambda chunks: [[len(x), 7] for x in chunks], most=3)
    for words in (["a", "bb", "a"], ["a", "ccc", "d"], ["a", "ee"], ["f", "g", "h", "a"], ["bb"], []):
        ((ids, sizes),) = cache.gather(pa.array(words, pa.large_string()))
        assert ids.tolist() == [x for w in words for x in (len(w), 7)] and sizes.tolist() == [2] * len(words)


@pytest.mark.parametrize("size", [1 << 20, 200])
def test_against_brute_force(spark, monkeypatch, size):
    monkeypatch.setattr(al, "SLICE", size)
    monkeypatch.setattr(al, "ENCODED", 2 * size)
    texts = some_texts(150, 4) + [" ".join(["word", "naïve"] * 40), None]
    rows = [(None if i == 3 else i // 2, t, "x", i, "y") for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_a string, batch long, pair string").repartition(3)
    want = plain(texts)
    got = sorted((str(r.doc_id), r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, r.groups_sha256) for r in al.align(df).collect())
    assert got == sorted((str(i), *w[:7]) for (i, *_), w in zip(rows, want))
    shown = sorted((str(r.doc_id), r.groups) for r in al.groups(df).collect())
    assert shown == sorted((str(i), w[7]) for (i, *_), w in zip(rows, want))


def test_tables_without_tokens(spark):
    df = spark.createDataFrame([(1, None), (2, ""), (2, "▁")], "doc_id long, text string")
    assert sorted(tuple(r) for r in al.align(df).collect()) == [(1, 0, 0, 0, 0, 0, 0, ""), (2, 0, 0, 0, 0, 0, 0, ""), (2, 0, 0, 0, 0, 0, 0, "")]
    assert al.align(df.limit(0)).count() == 0


def test_pair_counts(spark):
    texts = some_texts(60, 6)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    counted = al.pair_counts(al.batches_of(df)).collect()
    assert sum(r.n for r in counted) == sum(w[3] for w in plain(texts))
    assert all(r.best == (r.n == max(x.n for x in counted if x.b == r.b)) for r in counted)
