import numpy as np
import pytest
from beadframe.llm import quality_rules as q
import re

SF = "/root/testdata/sf0.1"


def plain(text):
    text = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = [tuple(w[i : i + 8]) for i in range(len(w) - 7)]
    count = {x: windows.count(x) for x in set(windows)} if len(w) < 400 else {}
    if not count:
        for x in windows:
            count[x] = count.get(x, 0) + 1
    covered = {j for i, x in enumerate(windows) if count[x] > 1 for j in range(i, i + 8)}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    return [len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(covered)]


TEXTS = [None, "", " \n ", "a b c d e f g h a b c d e f g h", "x " * 9, "l\nl \nl\n\nl\r\n", "é ü #*$%&|<> \U0001f600", "a b c d e f g h i " * 2000, "w " * 30000, "\x0b\x0c\x1c"]


@pytest.mark.parametrize("text", TEXTS)
def test_base_counts(text):
    assert q.statistics(text)[:5] == plain(text)


def test_base_counts_on_documents():
    import duckdb

    for (t,) in duckdb.sql(f"select text from '{SF[:-3]}0.01/documents.parquet'").fetchall():
        assert q.statistics(t)[:5] == plain(t)


def test_constraints_hold():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(3000, 3))
    y = (np.sin(3 * x[:, 0]) + x[:, 1] - x[:, 2] + rng.normal(size=3000) > 0).astype(float)
    model = q.fit_trees(x, y, [0, 1, -1], rounds=40)
    base, grid = rng.normal(size=(200, 3)), np.linspace(-3, 3, 25)
    for f, sign in ((1, 1), (2, -1)):
        s = []
        for v in grid:
            b = base.copy()
            b[:, f] = v
            s.append(model.score(b))
        assert (sign * np.diff(np.array(s), axis=0) >= -1e-12).all()
    assert ((model.score(x) > 0.5) == y).mean() > 0.75


def test_rules_keep_good_and_drop_bad(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    rows = q.judge(docs, labels.where("doc_id % 3 <> 0")).collect()
    known = {r.doc_id: r.quality for r in labels.where("doc_id % 3 = 0").collect()}
    held = [(known[r.doc_id], r) for r in rows if r.doc_id in known]
    assert len(rows) == docs.count()
    assert np.mean([r.kept for y, r in held if y and not r.base_failed]) > 0.99
    assert np.mean([r.kept for y, r in held if not y]) < 0.05


def test_edges(spark):
    docs = spark.createDataFrame([(1, None, 1), (None, "w " * 40, 2), (1, "a " * 5, 3), (1, "a " * 5, 3)], "doc_id long, text string, n_words int")
    labels = spark.createDataFrame([], "doc_id long, quality int")
    got = [(r.doc_id, r.n_words, r.base_failed, r.kept) for r in q.judge(docs, labels).collect()]
    assert got == [(1, 0, True, False), (None, 40, True, False), (1, 5, True, False), (1, 5, True, False)]
    assert q.keep_good(docs, labels).columns == docs.columns
    assert q.judge(docs.limit(0), labels).count() == 0


def walked(trees, row):
    """One row down every tree, node by node."""
    total = trees.start
    for at in trees.roots.tolist():
        while trees.left[at] != at:
            at = int(trees.left[at] if row[trees.feature[at]] <= trees.cut[at] else trees.right[at])
        total += trees.value[at]
    return 1 / (1 + np.exp(-total))


def test_flat_arrays_score_as_a_plain_walk_does():
    rng = np.random.default_rng(12)
    x = np.round(rng.normal(size=(400, 5)), 1)
    y = (x[:, 0] + x[:, 1] * x[:, 2] + rng.normal(size=400) * 0.3 > 0).astype(float)
    trees = q.fit_trees(x, y, [1, 0, 0, -1, 0], rounds=20)
    new = np.vstack([x[:50], np.round(rng.normal(size=(50, 5)) * 4, 1), [trees.cut[np.isfinite(trees.cut)][:5]]])
    assert np.allclose(trees.score(new), [walked(trees, r) for r in new], atol=1e-12)


@pytest.mark.parametrize("sign", [-1, 0, 1])
def test_a_stump_is_the_best_of_all_splits(sign):
    rng = np.random.default_rng(7)
    x = rng.integers(0, 12, (120, 3)).astype(float)
    y = (rng.random(120) < 0.2 + 0.6 * (x[:, 1] > 6)).astype(float)
    stump = q.fit_trees(x, y, [sign] * 3, rounds=1, depth=1, rate=1.0)
    p = y.mean()
    g, h = p - y, np.full(len(y), p * (1 - p))
    leaf = lambda rows: float(np.clip(-g[rows].sum() / (h[rows].sum() + 1), -4, 4))
    part = lambda rows, v: -(g[rows].sum() * v + 0.5 * (h[rows].sum() + 1) * v * v)
    best = (1e-6, None)
    for f in range(3):
        for cut in np.unique(np.quantile(x[:, f], np.linspace(0, 1, 65)[1:-1])):
            a, b = x[:, f] <= cut, x[:, f] > cut
            if a.sum() >= 8 and b.sum() >= 8 and sign * (leaf(b) - leaf(a)) >= 0:
                gain = part(a, leaf(a)) + part(b, leaf(b)) - part(a | b, leaf(a | b))
                best = max(best, (gain, (f, cut)), key=lambda z: z[0] if z[0] > best[0] + 1e-12 else -np.inf)
    root = int(stump.roots[0])
    if best[1] is None:
        assert stump.left[root] == root
    else:
        f, cut = best[1]
        assert int(stump.feature[root]) == f and ((x[:, f] <= cut) == (x[:, f] <= stump.cut[root])).all()
