import random
from collections import defaultdict

import pytest
from beadframe.llm import mixing

SCHEMA = "doc_id long, text string, source string, lang string, p double, tokens int"


def rows(n=3000, seed=3):
    rnd = random.Random(seed)
    out = []
    for i in range(n):
        source = "hot" if rnd.random() < 0.4 else f"s{rnd.randrange(6)}"
        out.append((i, "word " * rnd.randrange(1, 60) + rnd.choice(["", "", "| x | y ", "a@b.c", "License"]), source, rnd.choice(["en", "en", "de"]), 0.5, 1))
    return out


def share(parts, tokens):
    total, out = sum(tokens), defaultdict(float)
    for k, t in zip(parts, tokens):
        out[k] += t / total
    return out


def test_marginals_meet_their_targets(spark):
    df = spark.createDataFrame(rows(), SCHEMA)
    target = spark.createDataFrame([("hot", 0.2), ("s0", 0.3)], "value string, share double")
    got = mixing.mixed(df, targets={"source": target}, share=0.3).select("__mix.*").collect()
    assert len(got) == 3000 and all(0 < r.p <= 1 for r in got)
    weight = [r.n_tokens * r.p for r in got]
    total = sum(r.n_tokens for r in got)
    assert sum(weight) == pytest.approx(0.3 * total, rel=1e-6)
    if max(r.p for r in got) < 1:
        own = share([r.source for r in got], [r.n_tokens for r in got])
        wish = {k: {"hot": 0.2, "s0": 0.3}.get(k, v) for k, v in own.items()}
        fit = share([r.source for r in got], weight)
        for k in wish:
            assert fit[k] == pytest.approx(wish[k] / sum(wish.values()), abs=0.01)
    assert sum(r.n_tokens for r in got if r.kept) == pytest.approx(0.3 * total, rel=0.1)


@pytest.mark.parametrize("part", [0.05, 0.5, 0.8, 0.95, 1.0])
def test_share_of_tokens_is_kept(spark, part):
    df = spark.createDataFrame(rows(), SCHEMA)
    got = mixing.mixed(df, share=part).select("__mix.*").collect()
    assert sum(r.n_tokens * r.p for r in got) == pytest.approx(part * sum(r.n_tokens for r in got), rel=1e-6)


def test_given_documents_keep_most(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    kept = mixing.sample(docs)
    assert kept.columns == docs.columns and 0.6 < kept.count() / docs.count() < 0.95


def test_edges(spark):
    df = spark.createDataFrame([(None, None, None, None, 1.0, 1), (1, "", "a", "en", 1.0, 1), (1, "", "a", "en", 1.0, 1), (2, "x y", "a", "en", 1.0, 1)], SCHEMA)
    got = mixing.mixed(df).select("doc_id", "__mix.*").collect()
    assert len(got) == 4 and [r.kept for r in got if r.n_tokens == 0].count(True) in (0, 1, 3)
    assert {r.source for r in got if r.doc_id is None} == {"unknown"}
    assert mixing.mixed(df.limit(0)).count() == 0
    assert mixing.sample(df.where("text is null or text = ''")).count() == 3


def test_sparse_cells_meet_their_targets(spark):
    rnd = random.Random(11)
    cells = {(f"s{a}", f"l{b}", f"t{c}"): rnd.randrange(1, 10**6) for a in range(8) for b in range(8) for c in range(4) if rnd.random() < 0.35 or a == b}
    df = spark.createDataFrame([(*k, v) for k, v in cells.items()], "source string, lang string, topic string, tokens long")
    fitted, gap = mixing.rake(df, temper=0.5)
    assert gap < 1e-9
    rows, total = fitted.collect(), sum(cells.values())
    for k, d in enumerate(mixing.DIMENSIONS):
        mass, now = defaultdict(float), defaultdict(float)
        for c, v in cells.items():
            mass[c[k]] += v
        for r in rows:
            now[r[d]] += r.fitted
        wish = sum(v**0.5 for v in mass.values())
        for name, v in mass.items():
            assert now[name] == pytest.approx(v**0.5 / wish * total, rel=1e-6)


def test_slow_progress_is_no_contradiction(spark, recwarn):
    """Near-empty cells on the diagonal, and the marginals of another table on the same cells: feasible, and slow."""
    rnd = random.Random(75)
    held = {(a, b): 1 if a == b else rnd.randrange(10**4, 10**6) for a in range(6) for b in range(6) if a == b or rnd.random() < 0.35}
    other = {k: rnd.random() * (50 if k[0] == k[1] else 1) for k in held}
    df = spark.createDataFrame([(f"s{a}", f"l{b}", "t", n) for (a, b), n in held.items()], "source string, lang string, topic string, tokens long")
    marginal = lambda at, v: sum(x for k, x in other.items() if k[at] == v)
    table = lambda at, name: spark.createDataFrame([(f"{name}{v}", marginal(at, v)) for v in range(6)], "value string, share double")
    fitted, gap = mixing.rake(df, {"source": table(0, "s"), "lang": table(1, "l")}, tolerance=1e-10)
    assert gap <= 1e-10 and not [w for w in recwarn if "contradict" in str(w.message) or "settled" in str(w.message)]
    total, whole, now = sum(held.values()), sum(other.values()), defaultdict(float)
    for r in fitted.collect():
        now[r.source] += r.fitted
        now[r.lang] += r.fitted
    for v in range(6):
        assert now[f"s{v}"] / total == pytest.approx(marginal(0, v) / whole, abs=1e-9)
        assert now[f"l{v}"] / total == pytest.approx(marginal(1, v) / whole, abs=1e-9)


@pytest.mark.parametrize("cells_a_task", [100_000, 0])
def test_contradictions_are_proved(spark, monkeypatch, cells_a_task):
    """Source a has only x and y, which want less than a wants; the other cells are free."""
    monkeypatch.setattr(mixing, "CELLS_A_TASK", cells_a_task)
    cells = [("a", "x", 5), ("a", "y", 3), ("b", "x", 4), ("b", "z", 9), ("c", "z", 2), ("c", "y", 6)]
    df = spark.createDataFrame([(s, v, "t", n) for s, v, n in cells], "source string, lang string, topic string, tokens long")
    share = lambda **v: spark.createDataFrame(list(v.items()), "value string, share double")
    with pytest.warns(UserWarning, match="contradict"):
        _, gap = mixing.rake(df, {"source": share(a=0.6, b=0.3, c=0.1), "lang": share(x=0.3, y=0.2, z=0.5)})
    assert gap > 0.01
    fitted, gap = mixing.rake(df, {"source": share(a=0.45, b=0.35, c=0.2), "lang": share(x=0.3, y=0.2, z=0.5)}, tolerance=1e-11 if cells_a_task else 1e-5)
    assert gap < 1e-4 and fitted.columns == [*df.columns, "fitted"]


def test_targets_that_contradict_each_other_are_reported(spark):
    df = spark.createDataFrame([("a", "x", "t", 10), ("b", "y", "t", 10)], "source string, lang string, topic string, tokens long")
    targets = {d: spark.createDataFrame([(v, s) for v, s in t], "value string, share double") for d, t in {"source": [("a", 0.9), ("b", 0.1)], "lang": [("x", 0.1), ("y", 0.9)]}.items()}
    with pytest.warns(UserWarning, match="contradict"):
        fitted, gap = mixing.rake(df, targets)
    assert gap == pytest.approx(0.8) and fitted.count() == 2


def test_ties_long_texts_given_tokens_and_clashing_names(spark):
    df = spark.createDataFrame([(i, "w " * (200_000 if i == 0 else 3), "a", "en", i, i, i, i, 7) for i in range(40)], "doc_id long, text string, source string, lang string, __key int, __p int, __cell int, __mix int, n int")
    kept = mixing.sample(df)
    assert kept.columns == df.columns and all(r["__key"] == r["__p"] == r["__mix"] == r.doc_id for r in kept.collect())
    got = mixing.mixed(df.drop("__mix"), tokens_column="n").select("__mix.*").collect()
    assert {r.n_tokens for r in got} == {7} and len({r.p for r in got}) == 1
    assert max(r.n_tokens for r in mixing.mixed(df.drop("__mix")).select("__mix.*").collect()) == 200_000
