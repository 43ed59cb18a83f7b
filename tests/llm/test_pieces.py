import random

import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece
from beadframe.llm import pieces as p

PATH = public_tokenizers.path(p.VOCABULARY)
ALPHABET = ["a", "the ", " ", "  ", "\n", "\t", "▁", "é", "é", "ﬁ", "Ａ", "㍿", "日本", "😀", " ", "　", "<s>", "<0x0A>", "</s>", "word", ".", "1", "​", "\x00", "½"]


def some_texts(n=400, seed=5):
    rnd = random.Random(seed)
    return ["".join(rnd.choices(ALPHABET, k=rnd.randrange(12))) for _ in range(n)] + [None, "", " ", "▁", "x" * 30_000, "word " * 20_000, " \n" * 5000]


def test_ids_spans_and_text_equal_the_library():
    model, library = p.PieceModel(PATH), sentencepiece.SentencePieceProcessor(model_file=PATH)
    texts = some_texts()
    ids, begins, ends, counts = model.encode_batch(pa.array(texts, pa.string()))
    at = 0
    for text, n in zip(texts, counts):
        own, text = list(zip(ids[at : at + n].tolist(), begins[at : at + n].tolist(), ends[at : at + n].tolist())), text or ""
        at += n
        assert [x[0] for x in own] == library.encode(text)
        assert not own or (own[0][1], own[-1][2]) == (0, len(text.encode()))
        assert all(x[2] == y[1] and x[1] <= x[2] for x, y in zip(own, own[1:]))
        for k, (i, begin, end) in enumerate(own):
            want = model.surface[i]
            got = text.encode()[begin:end].replace("▁".encode(), b" ")
            assert got == (want[1:] if k == 0 else want)  # the first piece has the dummy prefix
    assert at == len(ids)
    assert model.decode([library.encode(t or "") for t in texts]) == [library.decode(library.encode(t or "")) for t in texts]


def normaliser(rule, **options):
    """A model without pieces whose character map is one of the library's own."""
    n = sentencepiece.SentencePieceNormalizer(rule_name=rule, **options)
    model = p.PieceModel.__new__(p.PieceModel)
    spec = {k: v for k, v, _ in p.fields(next(v for k, v, _ in p.fields(n.serialized_model_proto()) if k == p.NORMALIZER_SPEC))}
    model.charmap = p.CharMap(spec.get(p.CHARSMAP, b""))
    model.prefix, model.remove, model.escape = (bool(spec.get(k, 1)) for k in (p.DUMMY_PREFIX, p.REMOVE_EXTRA, p.ESCAPE))
    return n, model


@pytest.mark.parametrize("rule", ["nmt_nfkc", "nfkc_cf", "nmt_nfkc_cf"])
@pytest.mark.parametrize("remove", [False, True])
def test_longest_prefixes_of_compiled_maps(rule, remove):
    library, model = normaliser(rule, add_dummy_prefix=True, escape_whitespaces=True, remove_extra_whitespaces=remove)
    assert model.remove == remove and model.prefix and model.escape
    texts = [t or "" for t in some_texts(600, 9) if "\x00" not in (t or "")]
    out, source, bounds, offsets = model.normalise(pa.array(texts))
    for i, text in enumerate(texts):
        want, at = library.normalize(text, with_offsets=True)
        lo, hi = bounds[i], bounds[i + 1]
        assert out[lo:hi].tobytes().decode() == want
        # The library gives a code point for each normalised one; ours are bytes.
        heads = [k for k in range(lo, hi) if out[k] & 0xC0 != 0x80]
        assert [len(text.encode()[: source[k] - offsets[i]].decode()) for k in heads] == at[:-1]


def test_encode_table(spark):
    texts = some_texts(60, 3)
    rows = [(None if i == 5 else i // 2, t, "z", 1.5, i) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids string, begins double, id int").repartition(3)
    library = sentencepiece.SentencePieceProcessor(model_file=PATH)
    got = p.encode(df, decoded=True)
    assert got.columns == ["doc_id", "ids", "begins", "ends", "decoded"]
    want = sorted(((i, library.encode(t or "") + [2], library.decode(library.encode(t or "") + [2])) for i, t, *_ in rows), key=str)
    assert sorted(((r.doc_id, r.ids, r.decoded) for r in got.collect()), key=str) == want
    again = p.decode(got.drop("decoded"))
    assert sorted(((r.doc_id, r.decoded) for r in again.collect()), key=str) == sorted(((i, d) for i, _, d in want), key=str)
    assert p.encode(df.limit(0), decoded=True).count() == p.decode(got.limit(0)).count() == 0


def test_query_on_given_documents(spark):
    import hashlib

    from beadframe.llm.queries import op13_pieces

    library = sentencepiece.SentencePieceProcessor(model_file=PATH)
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    want = {}
    for d, text in docs:
        ids = library.encode(text or "", add_eos=True)
        want[d] = (len(ids), sha(" ".join(map(str, ids))), sha(library.decode(ids)))
    got = {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in op13_pieces(spark, "/root/testdata/sf0.001").collect()}
    assert got == want
