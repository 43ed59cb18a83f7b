"""Quality by a linear-chain conditional random field over lines.

Every line of a document gets the label good or bad. A line's features come from the
line and from its neighbours; transitions tie neighbouring labels. The model is fitted
on a bounded sample of labelled documents, whose lines all carry the document's label
at first: training maximises the likelihood of the chains, re-labels a bad document's
lines that look like good documents' lines, and maximises it again. A
document's score is the mean of its lines' forward-backward marginals for "good",
weighted by line length, put on a probability scale by a fitted logistic curve.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import materialise

KINDS = 10
WIDTH = 3 * KINDS + 3


def line_features(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """(lines x WIDTH features, line lengths) of the non-empty lines of a whole text."""
    raw = (text or "").encode("utf-8", "replace")
    lines = [x for x in raw.split(b"\n") if x.strip()]
    if not lines:
        return np.zeros((0, WIDTH)), np.zeros(0)
    kept = np.frombuffer(b"\n".join(lines), np.uint8)
    breaks = np.flatnonzero(kept == 10)
    starts = np.append(0, breaks + 1)
    ends = np.append(breaks, len(kept))
    # Character classes counted for each line from running sums.
    classes = CLASS_OF[kept]
    counts = np.stack([np.add.reduceat((classes == c).astype(np.int64), starts) for c in range(1, 7)], axis=1)
    size = np.maximum(ends - starts, 1).astype(float)
    words = [x.split() for x in lines]
    n = np.array([max(len(w), 1) for w in words], float)
    distinct = np.array([len(set(w)) for w in words]) / n
    again = np.array([sum(map(bytes.__eq__, w[1:], w[:-1])) for w in words]) / n
    seen: set = set()
    dup = np.zeros(len(lines))
    for i, x in enumerate(lines):
        dup[i] = x in seen
        seen.add(x)
    symbol, bar, upper, bang, digit, letter = (counts[:, i] for i in range(6))
    own = np.stack([
        np.minimum(symbol / size * 5, 2), np.minimum(bar / n * 2, 2), upper / np.maximum(upper + letter, 1),
        np.minimum(bang / n * 2, 2), np.minimum(digit / size * 3, 2), 1 - distinct / (1 + np.log(n) / 20),
        again, dup, np.minimum(letter / n, 15) / 10, np.log1p(size) / 8,
    ], axis=1)
    x = np.zeros((len(lines), WIDTH))
    x[:, :KINDS] = own
    x[1:, KINDS : 2 * KINDS] = own[:-1]
    x[:-1, 2 * KINDS : 3 * KINDS] = own[1:]
    x[0, 3 * KINDS], x[-1, 3 * KINDS + 1], x[:, 3 * KINDS + 2] = 1, 1, 1
    return x, size


def class_table() -> np.ndarray:
    out = np.zeros(256, np.uint8)
    out[list(b"#*$%&<>")], out[list(b"|")], out[65:91], out[list(b"!")], out[48:58] = 1, 2, 3, 4, 5
    out[97:123], out[128:] = 6, 6
    return out


CLASS_OF = class_table()


@dataclass
class Chain:
    """Weights of the field and of the curve from mean marginals to probabilities."""

    emission: np.ndarray  # score of "good" minus "bad", by feature
    transition: np.ndarray  # 2 x 2
    curve: tuple[float, float]

    def marginals(self, xs: list[np.ndarray]) -> list[np.ndarray]:
        """P(good) of each line of each chain, all chains advanced together."""
        sizes = np.array([len(x) for x in xs], np.int64)
        if not sizes.sum():
            return [np.zeros(0) for _ in xs]
        p = marginals(np.concatenate(xs) @ self.emission, sizes, self.transition)
        return np.split(p, np.cumsum(sizes)[:-1])

    def means(self, texts) -> np.ndarray:
        """Length-weighted mean marginal of each text; NaN for texts without lines."""
        out = []
        for at in range(0, len(texts), 512):
            both = [line_features(t) for t in texts[at : at + 512]]
            for p, (_, w) in zip(self.marginals([x for x, _ in both]), both):
                out.append(float(p @ w / w.sum()) if len(w) else np.nan)
        return np.array(out)

    def scores(self, texts) -> np.ndarray:
        m = np.clip(self.means(texts), 0, 1)
        a, b = self.curve
        return np.where(np.isnan(m), 0.0, 1 / (1 + np.exp(-(a * np.nan_to_num(m) + b))))


def messages(e: np.ndarray, sizes: np.ndarray, transition: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Forward (with the line's own score) and backward (without) messages of chains laid end to end.

    e: log odds of "good" of each line. Two labels need one number a line: messages are
    log odds too.
    """
    (t00, t01), (t10, t11) = transition
    order = np.argsort(-sizes, kind="stable")
    starts, lengths = (np.cumsum(sizes) - sizes)[order], sizes[order]
    forward, backward = e.copy(), np.zeros(len(e))
    active = np.searchsorted(-lengths, -np.arange(int(lengths[0])), side="left")  # chains longer than t
    for t in range(1, int(lengths[0])):
        at = starts[: active[t]] + t
        f = forward[at - 1]
        forward[at] += np.logaddexp(t01, t11 + f) - np.logaddexp(t00, t10 + f)
    for t in range(1, int(lengths[0])):
        at = starts[: active[t]] + lengths[: active[t]] - 1 - t
        b = backward[at + 1] + e[at + 1]
        backward[at] = np.logaddexp(t10, t11 + b) - np.logaddexp(t00, t01 + b)
    return forward, backward


def odds_to_share(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -500, 500)))


def marginals(e: np.ndarray, sizes: np.ndarray, transition: np.ndarray) -> np.ndarray:
    """P(good) of each line, by forward-backward."""
    forward, backward = messages(e, sizes, transition)
    return odds_to_share(forward + backward)


def pair_marginals(e: np.ndarray, forward: np.ndarray, backward: np.ndarray, at: np.ndarray, transition: np.ndarray) -> np.ndarray:
    """P(labels of lines at - 1 and at), (len(at), 2, 2): what comes from the left, the transition, what comes from the right."""
    left, right, none = forward[at - 1], e[at] + backward[at], np.zeros(len(at))
    pair = np.stack([none, left], axis=1)[:, :, None] + transition[None] + np.stack([none, right], axis=1)[:, None, :]
    pair = np.exp(pair - pair.max(axis=(1, 2), keepdims=True))
    return pair / pair.sum(axis=(1, 2), keepdims=True)


def gradient(flat: np.ndarray, target: np.ndarray, weight: np.ndarray, sizes: np.ndarray, emission: np.ndarray, transition: np.ndarray) -> np.ndarray:
    """Of the chains' log-likelihood, each chain times its lines' ``weight``: emission, then transition weights."""
    inner = np.ones(len(flat), bool)
    inner[np.cumsum(sizes) - sizes] = False
    at, e = np.flatnonzero(inner), flat @ emission
    forward, backward = messages(e, sizes, transition)
    by_feature = (flat * ((target - odds_to_share(forward + backward)) * weight)[:, None]).sum(axis=0)
    by_pair = -(pair_marginals(e, forward, backward, at, transition) * weight[at, None, None]).sum(axis=0)
    np.add.at(by_pair, (target[at - 1].astype(int), target[at].astype(int)), weight[at])
    return np.append(by_feature, by_pair)


def fit(texts: list, labels: np.ndarray, steps: int = 60, rate: float = 0.15, ridge: float = 1e-3) -> Chain:
    """Adam ascent on the chains' likelihood, all documents a step, in two passes."""
    both = [line_features(t) for t in texts]
    use = [i for i, (x, _) in enumerate(both) if len(x)]
    x, y = [both[i][0] for i in use], labels[use].astype(float)
    sizes = np.array([len(v) for v in x], np.int64)
    flat, owner = np.concatenate(x), np.repeat(np.arange(len(x)), sizes)
    target = y[owner]
    weight = 1 / sizes[owner] / len(x)  # a document counts once, however many lines it has
    chain = Chain(np.zeros(WIDTH), np.zeros((2, 2)), (6.0, -3.0))
    for round_ in range(2):
        if round_:  # a bad document may hold good lines: they take the label that they look like
            alone = odds_to_share(flat @ chain.emission)
            target = np.where((y[owner] == 0) & (alone > 0.9), 1.0, target)
            worst = np.zeros(len(x))
            np.maximum.at(worst, owner, 1 - target)
            target = np.where((worst[owner] == 0) & (y[owner] == 0), 0.0, target)
        theta, m, v = np.concatenate([chain.emission, chain.transition.ravel()]), 0.0, 0.0
        for step in range(1, steps + 1):
            g = gradient(flat, target, weight, sizes, chain.emission, chain.transition) - ridge * theta
            m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
            theta = theta + rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
            chain = Chain(theta[:WIDTH], theta[WIDTH:].reshape(2, 2), chain.curve)
    s = np.array([float(p @ w / w.sum()) for p, w in zip(chain.marginals(x), (both[i][1] for i in use))])
    a, b = 6.0, -3.0
    for _ in range(400):  # logistic curve of one variable, kept rising
        q = 1 / (1 + np.exp(-(a * s + b)))
        a, b = max(a + 2 * ((y - q) * s).mean() - 1e-4 * a, 0.5), b + 2 * (y - q).mean()
    return Chain(chain.emission, chain.transition, (float(a), float(b)))


def training_rows(docs: DataFrame, labels: DataFrame, text: str, id: str, label: str, max_rows: int, folds: int, max_bytes: int = 1 << 26) -> pd.DataFrame:
    """At most ``max_rows`` labelled documents outside fold 0, of ``max_bytes`` of text together, by smallest id hash.

    Of an id's rows one is taken, the one with the smallest text hash, before anything is
    collected; of its labels the smallest counts. Texts are added up in the order of the
    hash, and those that would go beyond ``max_bytes`` are not collected.
    """
    fold = F.pmod(F.crc32(F.col(id).cast("string").cast("binary")), F.lit(folds))
    known = labels.where(F.col(id).isNotNull() & F.col(label).isNotNull() & (fold != 0))
    known = known.groupBy(F.col(id).cast("long").alias("__id")).agg(F.min(label).cast("int").alias("__y"))
    known = known.orderBy(F.xxhash64("__id"), "__id").limit(max_rows)  # bounded, so it is broadcast
    rows = docs.select(F.col(id).cast("long").alias("__id"), F.col(text).cast("string").alias("__text")).join(F.broadcast(known), "__id")
    first = F.min(F.struct(F.xxhash64("__text").alias("h"), "__text"))["__text"]
    rows = rows.groupBy("__id", "__y").agg(first.alias("__text")).withColumn("__size", F.coalesce(F.octet_length("__text"), F.lit(0)).cast("long"))
    rows = materialise(rows, "training-texts")
    total = F.sum("__size").over(W.orderBy(F.xxhash64("__id"), "__id").rowsBetween(W.unboundedPreceding, 0))  # max_rows rows, without texts
    held = rows.select("__id", total.alias("total")).where(F.col("total") <= max_bytes).select("__id")
    return rows.join(F.broadcast(held), "__id").select("__id", "__y", "__text").toPandas().sort_values("__id")


def fit_documents(docs: DataFrame, labels: DataFrame, text: str = "text", id: str = "doc_id", label: str = "quality", max_rows: int = 2000, folds: int = 5, max_bytes: int = 1 << 26) -> Chain | None:
    rows = training_rows(docs, labels, text, id, label, max_rows, folds, max_bytes)
    y = (rows["__y"].to_numpy() > 0).astype(float)
    if len(set(y)) < 2:
        return None
    return fit(rows["__text"].tolist(), y)


def score_column(model: Chain | None, text: str) -> Column:
    @F.pandas_udf("double")
    def run(texts: pd.Series) -> pd.Series:
        return pd.Series(model.scores(texts.tolist()) if model else np.ones(len(texts)))

    return run(F.col(text).cast("string"))


def classify(docs: DataFrame, labels: DataFrame, text: str = "text", id: str = "doc_id", keep_from: float = 0.3, folds: int = 5, **options) -> DataFrame:
    """(id, held_out, score, predicted), a row a document.

    Null, empty and blank texts have no line and score 0; of a text of any length every
    line counts. Other columns of ``docs``, whatever their names, are not read. ``held_out`` marks fold 0, from
    which nothing is learned; a null id is not held out. Repeated rows are scored one by
    one. Without both labels nothing can be learned and every score is 1. An empty table
    gives an empty result.
    """
    model = fit_documents(docs, labels, text, id, folds=folds, **options)
    held = F.coalesce(F.pmod(F.crc32(F.col(id).cast("string").cast("binary")), F.lit(folds)) == 0, F.lit(False))
    out = docs.select(F.col(id), held.alias("held_out"), score_column(model, text).alias("score"))
    return out.select(id, "held_out", "score", (F.col("score") >= keep_from).cast("int").alias("predicted"))
