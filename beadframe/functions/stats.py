"""Numerical helpers in numpy: tails, robust fits, densities, mixtures and quantile maps."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd


def _each(f, x) -> np.ndarray:
    x = np.asarray(x, float)
    return np.array([f(v) for v in x.ravel().tolist()]).reshape(x.shape)


def _erfc(x) -> np.ndarray:
    return _each(math.erfc, x)


def _lgamma(x) -> np.ndarray:
    return _each(math.lgamma, x)


def normal_cdf(x) -> np.ndarray:
    return 0.5 * _erfc(-np.asarray(x, float) / math.sqrt(2))


def log_normal_cdf(x) -> np.ndarray:
    """log of the standard normal distribution function, accurate in the far lower tail."""
    x = np.asarray(x, float)
    out = np.full(x.shape, np.nan)
    near = x > -30
    out[near] = np.log(np.maximum(normal_cdf(x[near]), 1e-320))
    far = x <= -30
    z = x[far]
    out[far] = -0.5 * z * z - np.log(-z) - 0.5 * math.log(2 * math.pi) + np.log1p(-1 / z**2 + 3 / z**4 - 15 / z**6)
    return out


def normal_quantile(p) -> np.ndarray:
    """Inverse of the normal distribution function: bisection on its logarithm, then Newton steps."""
    p = np.asarray(p, float)
    out = np.full(p.shape, np.nan)
    out[p <= 0], out[p >= 1] = -np.inf, np.inf
    ok = (p > 0) & (p < 1)
    upper = p[ok] > 0.5
    q = np.log(np.where(upper, 1 - p[ok], p[ok]))
    low, high = np.full(q.shape, -45.0), np.full(q.shape, 0.0)
    for _ in range(60):
        mid = (low + high) / 2
        less = log_normal_cdf(mid) < q
        low, high = np.where(less, mid, low), np.where(less, high, mid)
    x = (low + high) / 2
    out[ok] = np.where(upper, -x, x)
    return out


def incomplete_beta(a, b, x) -> np.ndarray:
    """Regularised incomplete beta function by its continued fraction (modified Lentz)."""
    a, b, x = np.broadcast_arrays(*(np.asarray(v, float) for v in (a, b, x)))
    swap = x > (a + 1) / (a + b + 2)
    p, q, z = np.where(swap, b, a), np.where(swap, a, b), np.where(swap, 1 - x, x)
    with np.errstate(all="ignore"):
        front = np.exp(_lgamma(p + q) - _lgamma(p) - _lgamma(q) + p * np.log(z) + q * np.log1p(-z)) / p
        tiny = 1e-300
        c, d = np.ones_like(z), 1 - (p + q) * z / (p + 1)
        d = 1 / np.where(np.abs(d) < tiny, tiny, d)
        h = d.copy()
        for m in range(1, 400):
            for top in (m * (q - m) * z / ((p + 2 * m - 1) * (p + 2 * m)), -(p + m) * (p + q + m) * z / ((p + 2 * m) * (p + 2 * m + 1))):
                d = 1 + top * d
                c = 1 + top / c
                d, c = 1 / np.where(np.abs(d) < tiny, tiny, d), np.where(np.abs(c) < tiny, tiny, c)
                h = h * d * c
            if np.nanmax(np.abs(d * c - 1), initial=0) < 1e-15:
                break
        out = front * h
    out = np.where(z <= 0, 0.0, out)
    return np.where(swap, 1 - out, out)


def t_two_sided(t, df) -> np.ndarray:
    t, df = np.asarray(t, float), np.asarray(df, float)
    return incomplete_beta(df / 2, 0.5, df / (df + t * t))


def f_upper(f, d1, d2) -> np.ndarray:
    f, d1, d2 = (np.asarray(v, float) for v in (f, d1, d2))
    return incomplete_beta(d2 / 2, d1 / 2, d2 / (d2 + d1 * f))


def huber(x: np.ndarray, k: float = 1.5, tol: float = 1e-6) -> tuple[float, float]:
    """Huber's location with the scaled median absolute deviation: (mu, s)."""
    x = x[~np.isnan(x)]
    mu = float(np.median(x))
    s = float(np.median(np.abs(x - mu)) * 1.4826)
    if s == 0:
        raise ValueError("no spread")
    while True:
        new = float(np.clip(x, mu - k * s, mu + k * s).mean())
        if abs(mu - new) < tol * s:
            return new, s
        mu = new


def density(x: np.ndarray, n: int = 512) -> tuple[np.ndarray, np.ndarray]:
    """Gaussian kernel density on n points from min - 3 bw to max + 3 bw; bandwidth by the rule of thumb."""
    x = x[~np.isnan(x)]
    q75, q25 = np.quantile(x, [0.75, 0.25]) if len(x) else (np.nan, np.nan)
    sd = float(np.std(x, ddof=1)) if len(x) > 1 else 0.0
    low = min(sd, (q75 - q25) / 1.34) or sd or abs(float(x[0])) or 1.0
    bw = 0.9 * low * len(x) ** -0.2
    grid = np.linspace(x.min() - 3 * bw, x.max() + 3 * bw, n)
    y = np.zeros(n)
    for a in range(0, len(x), 20_000):  # bounds memory, not data
        y += np.exp(-0.5 * ((grid[:, None] - x[None, a : a + 20_000]) / bw) ** 2).sum(axis=1)
    return grid, y / (len(x) * bw * math.sqrt(2 * math.pi))


def mode(x: np.ndarray) -> float:
    if not (~np.isnan(x)).any():
        return float("nan")
    grid, y = density(x)
    return float(grid[y.argmax()])


def valley(a: np.ndarray, b: np.ndarray) -> float:
    """Least density between the modes of two groups over the lower mode's density."""
    m = sorted((mode(a), mode(b)))
    both = np.concatenate([a, b])
    both = both[~np.isnan(both)]
    grid, y = density(both)
    inside = both[(both >= m[0]) & (both <= m[1])]
    top = np.interp(m, grid, y).min()
    return float(np.interp(inside, grid, y).min() / top) if len(inside) else float("nan")


def to_target(x: np.ndarray, target: np.ndarray) -> np.ndarray:
    """x with the target's distribution: mean ranks (ties share one) read off its sorted values."""
    target = np.sort(target[~np.isnan(target)])
    ok = ~np.isnan(x)
    out = np.full(len(x), np.nan)
    n = int(ok.sum())
    if n and len(target):
        at = (pd.Series(x[ok]).rank().to_numpy() - 1) / max(n - 1, 1)
        out[ok] = np.interp(at * (len(target) - 1), np.arange(len(target)), target)
    return out


def normal_exponential(x: np.ndarray, mu: float, sigma: float, alpha: float) -> np.ndarray:
    """Expected signal given signal plus background, under exponential signal and normal background."""
    s2 = sigma * sigma
    m = x - mu - s2 / alpha
    z = m / sigma
    log_density = -0.5 * z * z - math.log(sigma) - 0.5 * math.log(2 * math.pi)
    out = m + s2 * np.exp(log_density - log_normal_cdf(z))
    return np.where(out < 0, np.maximum(out, 1e-6), out)


def beta_mixture(x: np.ndarray, starts: list[float], rounds: int = 5) -> list[float]:
    """Cut points between states of a mixture of beta distributions.

    Memberships start from the cuts ``starts`` and are refined for a few rounds with moment
    fits. A cut is the largest value that falls to the lower state. All values are used,
    sorted first, so their order does not matter.
    """
    v = np.clip(np.sort(x[~np.isnan(x)]), 1e-4, 1 - 1e-4)
    k = len(starts) + 1
    w = np.eye(k)[np.searchsorted(starts, v, side="left")] if len(v) else np.zeros((0, k))
    for _ in range(rounds):
        logs = np.full((len(v), k), -np.inf)
        for j in range(k):
            n = w[:, j].sum()
            if n < 2:
                continue
            m = float((w[:, j] * v).sum() / n)
            s2 = max(float((w[:, j] * (v - m) ** 2).sum() / n), 1e-6)
            size = max(m * (1 - m) / s2 - 1, 1e-2)
            a, b = m * size, (1 - m) * size
            logs[:, j] = math.log(n / len(v)) + (a - 1) * np.log(v) + (b - 1) * np.log1p(-v) - (math.lgamma(a) + math.lgamma(b) - math.lgamma(a + b))
        new = np.exp(logs - logs.max(axis=1, keepdims=True))
        new /= new.sum(axis=1, keepdims=True)
        if np.abs(new - w).max(initial=0) < 1e-3:
            break
        w = new
    state = w.argmax(axis=1)
    return [float(v[state <= j].max()) if (state <= j).any() else s for j, s in enumerate(starts)]


def enrichment_score(present: np.ndarray) -> tuple[float, float]:
    """(largest, smallest) running sum of +1/n for members and -1/(N - n) for the others."""
    n = int(present.sum())
    s = np.cumsum(np.where(present, 1 / n, -1 / (len(present) - n)))
    return float(s.max()), float(s.min())


def widest_arc(v: np.ndarray, least: int, reach: float | None = None, block: int = 16) -> tuple[float, int, int] | None:
    """(statistic, start, end) of the arc that differs most from the rest: the first of equals, as from a look at all.

    With ``reach``, some arc whose statistic is at least that, or None if none is. Arcs end in
    two blocks of the running sum; by the largest difference between these and the shortest
    lengths, pairs of blocks that stay below what is asked are left out as a whole, the others are halved.
    """
    n = len(v)
    s = np.append(0, np.cumsum(v - v.mean()))
    levels = max(0, int(np.ceil(np.log2((n + 1) / block))))
    padded = np.append(s, np.full((block << levels) - n - 1, np.nan))
    lows, highs = [np.fmin.reduce(padded.reshape(-1, block), axis=1)], [np.fmax.reduce(padded.reshape(-1, block), axis=1)]
    for _ in range(levels):
        lows.append(np.fmin(lows[-1][::2], lows[-1][1::2]))
        highs.append(np.fmax(highs[-1][::2], highs[-1][1::2]))

    def arcs(i: np.ndarray, j: np.ndarray) -> np.ndarray:
        k = j - i
        ok = (k >= least) & (k <= n - least) & (j <= n)
        k = np.where(ok, k, 1)
        return np.where(ok, np.abs(padded[j] - padded[i]) / np.sqrt(k * (n - k) / n), -1)

    top = (-1.0, 0, 0)
    if reach is None:  # what a few arcs reach bounds the largest from below
        ends = np.unique(np.linspace(0, n, 65).astype(int))
        floor = arcs(ends[:, None], ends[None, :]).max()
    else:
        floor = reach
    p = q = np.zeros(1, int)
    for level in range(levels, -1, -1):
        size = block << level
        if level < levels:
            p, q = (np.concatenate([2 * p, 2 * p, 2 * p + 1, 2 * p + 1]), np.concatenate([2 * q, 2 * q + 1, 2 * q, 2 * q + 1]))
            p, q = p[p <= q], q[p <= q]
        short, long = np.maximum(least, (q - p - 1) * size + 1), np.minimum(n - least, (q - p + 1) * size - 1)
        p, q, short, long = (z[short <= long] for z in (p, q, short, long))
        apart = np.fmax(highs[level][q] - lows[level][p], highs[level][p] - lows[level][q])
        # Rounding may not lose an arc.
        bound = apart / np.sqrt(np.minimum(short * (n - short), long * (n - long)) / n) * (1 + 1e-9)
        kept = np.flatnonzero(bound >= floor)
        p, q, bound = p[kept], q[kept], bound[kept]
    order = np.argsort(-bound, kind="stable")
    p, q, bound = p[order], q[order], bound[order]
    inside, at, each = np.arange(block), 0, 256
    while at < len(p) and bound[at] >= floor:
        i = p[at : at + each, None, None] * block + inside[:, None]
        j = q[at : at + each, None, None] * block + inside[None, :]
        t = arcs(i, j)
        if (most := t.max()) >= floor and most > -1:
            c, a, b = np.nonzero(t == most)
            found = min(zip((i[c, a, 0]).tolist(), (j[c, 0, b]).tolist()))
            if reach is not None:
                return float(most), *found
            top = min(top, (float(most), *found), key=lambda z: (-z[0], z[1], z[2]))
            floor = max(floor, most)
        at, each = at + each, min(4 * each, 8192)
    return top if reach is None else None


def circular_segments(x: np.ndarray, alpha: float = 0.001, least: int = 5, permutations: int = 1000, undo: float = 2.2, seed: int = 1) -> list[tuple[int, int]]:
    """[start, end) segments of a sequence by circular binary segmentation (Olshen et al., 2004).

    The arc that differs most from the rest is cut out if permutations seldom give as large
    a statistic; ends closer than ``undo`` standard deviations are joined again.
    """
    rng = np.random.default_rng(seed)

    def split(a: int, b: int) -> list[int]:
        v = x[a:b]
        if len(v) < 2 * least or v.std() == 0:
            return []
        t, i, j = widest_arc(v, least)
        worse, allowed = 0, int(alpha * permutations) + 1
        for _ in range(permutations):
            worse += widest_arc(rng.permutation(v), least, t) is not None
            if worse >= allowed:
                return []
        cuts = [c for c in (a + i, a + j) if a < c < b]
        out = list(cuts)
        for u, w in zip([a, *cuts], [*cuts, b]):
            out += split(u, w)
        return out

    cuts = sorted(set(split(0, len(x))))
    sd = np.std(np.diff(x), ddof=1) / math.sqrt(2) if len(x) > 2 else 0.0
    while cuts:
        edges = [0, *cuts, len(x)]
        means = [x[u:w].mean() for u, w in zip(edges, edges[1:])]
        gaps = [abs(p - q) for p, q in zip(means, means[1:])]
        k = int(np.argmin(gaps))
        if gaps[k] >= undo * sd:
            break
        cuts.pop(k)
    edges = [0, *cuts, len(x)]
    return list(zip(edges, edges[1:])) if len(x) else []
