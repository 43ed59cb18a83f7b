import itertools
import zlib

import numpy as np
import pytest
from beadframe.llm import line_crf

SF = "/root/testdata/sf0.1"


def test_marginals_equal_enumeration():
    rng = np.random.default_rng(3)
    sizes = np.array([1, 4, 3, 6])
    e, t = rng.normal(size=sizes.sum()), rng.normal(size=(2, 2))
    got, at = line_crf.marginals(e, sizes, t), 0
    for n in sizes:
        total, good = 0.0, np.zeros(n)
        for y in itertools.product((0, 1), repeat=int(n)):
            w = np.exp(sum(e[at + i] * y[i] for i in range(n)) + sum(t[y[i - 1], y[i]] for i in range(1, n)))
            total += w
            good += w * np.array(y)
        assert np.allclose(got[at : at + n], good / total)
        at += n


@pytest.mark.parametrize("text", [None, "", " \n\t\n", "x", "a\n\nb\n", "é " * 50000, "\n" * 9999, "#\n" * 3000])
def test_features_of_any_text(text):
    x, w = line_crf.line_features(text)
    assert len(x) == len(w) == sum(bool(s.strip(" \t\r\v\f")) for s in (text or "").split("\n")) and np.isfinite(x).all()


def test_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    known = {r.doc_id: r.quality for r in labels.collect()}
    rows = line_crf.classify(docs, labels).collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and r.predicted == (r.score >= 0.3) for r in rows)
    held = [(known[r.doc_id], r.predicted) for r in rows if r.held_out and r.doc_id in known]
    assert np.mean([a == b for a, b in held]) > 0.97
    assert np.mean([b for a, b in held if a]) > 0.98


def test_edges(spark):
    docs = spark.createDataFrame([(1, None, 0.5), (None, "good text", 0.1), (1, "", 0.2), (1, "", 0.2)], "doc_id long, text string, score double")
    labels = spark.createDataFrame([(1, None, 1.0), (None, 1, 1.0)], "doc_id long, quality int, text double")
    assert [r.score for r in line_crf.classify(docs, labels).collect()] == [1.0] * 4
    assert line_crf.classify(docs.limit(0), labels).count() == 0


def plain_likelihood(flat, target, weight, sizes, theta):
    """Sum over chains of weight times log P(labels), by enumeration."""
    emission, t = theta[: flat.shape[1]], theta[flat.shape[1] :].reshape(2, 2)
    e, at, out = flat @ emission, 0, 0.0
    score = lambda y, at: sum(e[at + i] * v for i, v in enumerate(y)) + sum(t[a, b] for a, b in zip(y, y[1:]))
    for n in sizes:
        every = [score(y, at) for y in itertools.product((0, 1), repeat=int(n))]
        out += weight[at] * (score(target[at : at + n].astype(int).tolist(), at) - np.logaddexp.reduce(every))
        at += n
    return out


def test_gradient_is_that_of_the_likelihood():
    rng = np.random.default_rng(8)
    sizes = np.array([1, 5, 3, 7])
    flat, target = rng.normal(size=(sizes.sum(), 4)), rng.integers(0, 2, sizes.sum()).astype(float)
    weight = np.repeat(1 / sizes, sizes)
    theta = rng.normal(size=8)
    got = line_crf.gradient(flat, target, weight, sizes, theta[:4], theta[4:].reshape(2, 2))
    for k in range(8):
        step = np.eye(8)[k] * 1e-5
        want = (plain_likelihood(flat, target, weight, sizes, theta + step) - plain_likelihood(flat, target, weight, sizes, theta - step)) / 2e-5
        assert abs(got[k] - want) < 1e-6


def test_scores_equal_a_plain_reading():
    rng = np.random.default_rng(4)
    chain = line_crf.Chain(rng.normal(size=line_crf.WIDTH), rng.normal(size=(2, 2)), (5.0, -2.0))
    texts = ["One line.", "Two lines.\n\n### !!! |", "a\nb b b\nC | d\na\n", None, ""]
    for text, got in zip(texts, chain.scores(texts)):
        x, w = line_crf.line_features(text)
        if not len(x):
            assert got == 0
            continue
        total, good = 0.0, np.zeros(len(x))
        for y in itertools.product((0, 1), repeat=len(x)):
            p = np.exp(sum((x[i] @ chain.emission) * v for i, v in enumerate(y)) + sum(chain.transition[a, b] for a, b in zip(y, y[1:])))
            total, good = total + p, good + p * np.array(y)
        mean = (good / total) @ w / w.sum()
        assert abs(got - 1 / (1 + np.exp(-(5 * mean - 2)))) < 1e-9


def test_one_row_an_id_is_collected(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, "c d")], "doc_id long, text string")
    many = docs.crossJoin(spark.range(500)).select("doc_id", "text")
    labels = spark.createDataFrame([(1, 1), (1, 0), (2, 1)], "doc_id long, quality int")
    rows = line_crf.training_rows(many.unionByName(docs), labels, "text", "doc_id", "quality", 10, 1 << 30)
    assert rows[["__id", "__y"]].to_numpy().tolist() == [[1, 0], [2, 1]]


def test_collected_texts_have_a_bound(spark):
    docs = spark.createDataFrame([(i, "x" * (10 * i)) for i in range(1, 30)] + [(99, None)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in [*range(1, 30), 99]], "doc_id long, quality int")
    take = lambda n: line_crf.training_rows(docs, labels, "text", "doc_id", "quality", 1000, 1 << 30, n)
    assert len(take(1 << 20)) == 30
    some = take(900)
    assert 0 < len(some) < 30 and some["__text"].dropna().str.len().sum() <= 900
