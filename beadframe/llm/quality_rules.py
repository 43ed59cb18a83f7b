"""Quality rules: fixed floor rules and gradient-boosted trees over document statistics.

Statistics come from one pass over the whole text. The trees are fitted on a bounded
sample of labelled rows, kept as flat numpy node arrays and scored for a whole batch at
once. Chosen statistics may only lower (or only raise) the score: the trees respect
that in every split and leaf.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WINDOW = 8
SYMBOLS = b"#*$%&|<>"
SPACES = b" \t\n\v\f\r"
BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
#: Statistic -> sign of its monotonic constraint (0: none).
FEATURES = {
    "log_words": 0, "mean_word": 0, "symbols": -1, "dup_lines": -1, "repeat_words": -1, "upper": -1, "bangs": -1,
    "digits": 0, "distinct_words": 0, "top_word": -1, "ends": 0, "line_words": 0,
}
STATS_TYPE = ", ".join(f"{x} long" for x in BASE) + ", " + ", ".join(f"{x} double" for x in FEATURES)


def repeated_words(ids: np.ndarray, window: int = WINDOW) -> int:
    """Words that lie in a window of ``window`` words found twice or more."""
    n = len(ids) - window + 1
    if n < 2:
        return 0
    with np.errstate(over="ignore"):
        h, m = np.zeros(n, np.uint64), np.uint64(0x9E3779B97F4A7C15)
        for i in range(window):
            h = h * m + ids[i : i + n].astype(np.uint64)
    s = np.sort(h)
    if not (s[1:] == s[:-1]).any():  # no equal hashes: no equal windows
        return 0
    names, span = ids.astype(np.int64), 1
    while span < window:  # windows of double length get exact names from pairs of names
        step = min(span, window - span)
        a, b = names[: len(names) - step], names[step:]
        names, span = np.unique(a * (int(names.max()) + 1) + b, return_inverse=True)[1], span + step
    again = np.bincount(names)[names] > 1
    edges = np.zeros(len(ids) + 1, np.int64)
    np.add.at(edges, np.flatnonzero(again), 1)
    np.add.at(edges, np.flatnonzero(again) + window, -1)
    return int((np.cumsum(edges) > 0).sum())


def statistics(text: str | None) -> list:
    """The five base counts and the features, of a whole text (null: empty)."""
    raw = (text or "").encode("utf-8", "replace")
    words, counts = raw.split(), np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    points = int(counts.sum() - counts[128:192].sum())
    n_words, word_chars = len(words), points - int(counts[list(SPACES)].sum())
    n_symbols = int(counts[list(SYMBOLS)].sum())
    seen, n_dup_lines, n_lines, ends = set(), 0, 0, 0
    for line in raw.split(b"\n"):
        if bare := line.strip():
            n_lines += 1
            n_dup_lines += line in seen
            ends += bare[-1] in b".?\""
            seen.add(line)
    names: dict = {}
    ids = np.fromiter((names.setdefault(w, len(names)) for w in words), np.int64, n_words)
    n_repeat = repeated_words(ids)
    some, chars, lines = max(n_words, 1), max(word_chars, 1), max(n_lines, 1)
    top = int(np.bincount(ids).max()) / some if n_words else 0.0
    return [
        n_words, word_chars, n_symbols, n_dup_lines, n_repeat,
        float(np.log1p(n_words)), word_chars / some, n_symbols / chars, n_dup_lines / lines, n_repeat / some,
        float(counts[65:91].sum()) / chars, float(counts[33]) / chars, float(counts[48:58].sum()) / chars,
        len(names) / some / (1 + np.log1p(n_words) / 50), top, ends / lines, n_words / lines,
    ]


def base_failed(n_words, n_repeat_words):
    return (n_words < 20) | (100 * n_repeat_words > 30 * n_words)


@dataclass
class Trees:
    """A forest in flat arrays; node 0 of tree t is ``roots[t]``; leaves point to themselves."""

    feature: np.ndarray
    cut: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    roots: np.ndarray
    depth: int
    start: float

    def score(self, x: np.ndarray) -> np.ndarray:
        at = np.broadcast_to(self.roots, (len(x), len(self.roots))).copy()
        rows = np.arange(len(x))[:, None]
        for _ in range(self.depth):
            at = np.where(x[rows, self.feature[at]] <= self.cut[at], self.left[at], self.right[at])
        return 1 / (1 + np.exp(-(self.start + self.value[at].sum(axis=1))))


def fit_trees(x: np.ndarray, y: np.ndarray, signs: list[int], rounds: int = 60, depth: int = 3, rate: float = 0.15, bins: int = 64, ridge: float = 1.0, least: int = 8) -> Trees:
    """Boosting on logistic loss over histograms; ``signs`` holds the monotonic constraints."""
    cuts = [np.unique(np.quantile(c, np.linspace(0, 1, bins + 1)[1:-1])) for c in x.T]
    codes = np.stack([np.searchsorted(c, v, side="left") for c, v in zip(cuts, x.T)], axis=1)
    share = min(max(float(y.mean()), 1e-3), 1 - 1e-3)
    start = float(np.log(share / (1 - share)))
    margin = np.full(len(y), start)
    nodes: list[list] = []  # feature, cut, left, right, value
    roots = []

    def grow(rows: np.ndarray, g: np.ndarray, h: np.ndarray, low: float, high: float, left_depth: int) -> int:
        me = len(nodes)
        value = float(np.clip(-g[rows].sum() / (h[rows].sum() + ridge), low, high))
        nodes.append([0, np.inf, me, me, rate * value])
        best = (1e-6, None)
        if left_depth and len(rows) >= 2 * least:
            for f, sign in enumerate(signs):
                c, size = codes[rows, f], len(cuts[f]) + 1
                G, H, N = (np.cumsum(np.bincount(c, w, size)) for w in (g[rows], h[rows], None))
                gl, hl, nl, gr, hr, nr = G[:-1], H[:-1], N[:-1], G[-1] - G[:-1], H[-1] - H[:-1], N[-1] - N[:-1]
                vl, vr = np.clip(-gl / (hl + ridge), low, high), np.clip(-gr / (hr + ridge), low, high)
                part = lambda a, b, v: -(a * v + 0.5 * (b + ridge) * v * v)
                gain = part(gl, hl, vl) + part(gr, hr, vr) - part(G[-1], H[-1], value)
                gain[(nl < least) | (nr < least) | (sign * (vr - vl) < 0)] = -1
                if len(gain) and gain.max() > best[0]:
                    i = int(gain.argmax())
                    best = (float(gain[i]), (f, i, float(vl[i] + vr[i]) / 2))
        if best[1]:
            f, i, middle = best[1]
            goes = codes[rows, f] <= i
            bounds = {1: ((low, middle), (middle, high)), -1: ((middle, high), (low, middle)), 0: ((low, high), (low, high))}[signs[f]]
            nodes[me][:2] = f, float(cuts[f][i])
            nodes[me][2] = grow(rows[goes], g, h, *bounds[0], left_depth - 1)
            nodes[me][3] = grow(rows[~goes], g, h, *bounds[1], left_depth - 1)
        return me

    for _ in range(rounds):
        p = 1 / (1 + np.exp(-margin))
        roots.append(grow(np.arange(len(y)), p - y, p * (1 - p), -4.0, 4.0, depth))
        one = Trees(*(np.array(c) for c in zip(*nodes)), np.array(roots[-1:]), depth, 0.0)
        s = one.score(x)
        margin += np.log(s / (1 - s))
    return Trees(*(np.array(c) for c in zip(*nodes)), np.array(roots), depth, start)


def stats_column(text: str) -> Column:
    @F.pandas_udf(STATS_TYPE)
    def run(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([statistics(t) for t in texts], columns=[*BASE, *FEATURES])

    return run(F.col(text).cast("string"))


def fit_rules(docs: DataFrame, labels: DataFrame, text: str = "text", id: str = "doc_id", label: str = "quality", max_rows: int = 6000) -> Trees | None:
    """Trees from at most ``max_rows`` labelled rows, those with the smallest id hashes.

    Null labels and ids are left out; of repeated labels the smallest counts, and of an
    id's rows the one with the smallest text hash. Without
    both labels there is nothing to learn and the result is None.
    """
    known = labels.where(F.col(label).isNotNull() & F.col(id).isNotNull()).groupBy(F.col(id).cast("long").alias("__id")).agg(F.min(label).cast("double").alias("__y"))
    known = known.orderBy(F.xxhash64("__id"), "__id").limit(max_rows)  # bounded, so it is broadcast
    rows = docs.select(F.col(id).cast("long").alias("__id"), F.col(text).alias("__text")).join(F.broadcast(known), "__id")
    # One row an id, that with the smallest text hash, before anything is collected.
    rows = rows.groupBy("__id", "__y").agg(F.min(F.struct(F.xxhash64("__text").alias("h"), "__text"))["__text"].alias("__text"))
    got = rows.select("__y", "__id", stats_column("__text").alias("s")).select("__y", "__id", *(f"s.{f}" for f in FEATURES)).toPandas()
    got = got.sort_values("__id")  # the same model whatever the partitions
    if got["__y"].nunique() < 2:
        return None
    return fit_trees(got[list(FEATURES)].to_numpy(float), (got["__y"] > 0).to_numpy(float), list(FEATURES.values()))


def rule_column(model: Trees | None, text: str = "text", keep_from: float = 0.3) -> Column:
    """Struct of the base counts, ``base_failed``, ``score`` and ``kept`` for a text column."""

    @F.pandas_udf(", ".join(f"{x} long" for x in BASE) + ", base_failed boolean, score double, kept boolean")
    def run(texts: pd.Series) -> pd.DataFrame:
        s = pd.DataFrame([statistics(t) for t in texts], columns=[*BASE, *FEATURES])
        out = s[BASE].copy()
        out["base_failed"] = base_failed(s["n_words"], s["n_repeat_words"])
        out["score"] = model.score(s[list(FEATURES)].to_numpy(float)) if model and len(s) else 1.0
        out["kept"] = ~out["base_failed"] & (out["score"] >= keep_from)
        return out

    return run(F.col(text).cast("string"))


def judge(docs: DataFrame, labels: DataFrame, text: str = "text", id: str = "doc_id", keep_from: float = 0.3, max_rows: int = 6000) -> DataFrame:
    """One row a document: id, base counts, base_failed, score, kept.

    Null and empty texts have no words, so they fail the base rules. Repeated rows and
    ids are judged one by one; a null id stays null. Texts of any length are read whole;
    other columns, whatever their names, are not read. Without usable labels the base
    rules alone decide. An empty table gives an empty result.
    """
    model = fit_rules(docs, labels, text, id, max_rows=max_rows)
    out = docs.select(F.col(id), rule_column(model, text, keep_from).alias("__r"))
    return out.select(id, *(f"__r.{c}" for c in [*BASE, "base_failed", "score", "kept"]))


def keep_good(docs: DataFrame, labels: DataFrame, text: str = "text", id: str = "doc_id", **options) -> DataFrame:
    """The rows of ``docs`` that the rules keep; columns as they were, whatever their names."""
    model = fit_rules(docs, labels, text, id, **{k: v for k, v in options.items() if k == "max_rows"})
    keep = rule_column(model, text, options.get("keep_from", 0.3))["kept"]
    return docs.where(keep)
