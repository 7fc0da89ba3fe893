"""Gaps: classes, filling from the subspace, iterative filling, and low-rank approximation."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np

from lagweave.kernels.decompose import Triples, refitted
from lagweave.kernels.forecast import apply_lrr, lrr
from lagweave.kernels.trajectory import Trajectory

MOST_ROUNDS = 10_000


def clusters(known: np.ndarray, window: int) -> list[tuple[int, int]]:
    """First and last index of each gap; missing cells at most `window` apart are one gap."""
    out: list[list[int]] = []
    for i in np.flatnonzero(~known).tolist():
        if out and i - out[-1][1] <= window:
            out[-1][1] = i
        else:
            out.append([i, i])
    return [tuple(c) for c in out]


def classified(known: np.ndarray, window: int) -> list[tuple[int, int, str, str]]:
    """Gaps as (first, last from 1, left | internal | right, dense | sparse)."""
    n, out = len(known), []
    for a, b in clusters(known, window):
        place = "left" if a + 1 < window else "right" if b + 1 >= n - window + 1 else "internal"
        out.append((a + 1, b + 1, place, "sparse" if known[a : b + 1].any() else "dense"))
    return out


def sequential(t: Triples, group, base: str = "original", alpha: float | Callable[[int], np.ndarray] | None = None, keep_known: bool = False) -> list[np.ndarray]:
    """Gaps filled by recurrences from both sides; alpha weights the one from the right.

    What lies inside a sparse gap is replaced too, unless keep_known.
    """
    if isinstance(alpha, (int, float)) and not 0 <= alpha <= 1:
        raise ValueError("alpha lies between 0 and 1")
    if all(b.known.all() for b in t.x.blocks):
        raise ValueError("there are no gaps")
    window = t.x.rows
    space = t.column_space(t.pick(group))
    ahead, back = lrr(space, orthonormalize=False), lrr(space, reverse=True, orthonormalize=False)
    rec, out = t.series(group), []
    for b, r in zip(t.x.blocks, rec, strict=True):
        full = (r if base == "reconstructed" else b.values).copy()
        source = full.copy()
        for first, last, place, _ in classified(b.known, window):
            a, e = first - 1, last
            size = e - a
            left = source[max(0, a - window) : a][-(window - 1) :]
            right = source[e : e + window][: window - 1]
            forward = apply_lrr(left, ahead, size, True) if place != "left" and len(left) >= window - 1 else None
            backward = apply_lrr(right, back, size, True, reverse=True) if place != "right" and len(right) >= window - 1 else None
            if forward is None and backward is None:
                continue
            if forward is None or backward is None:
                fill = forward if backward is None else backward
            else:
                w = np.linspace(0, 1, size) if alpha is None and size > 1 else np.zeros(size) if alpha is None else np.full(size, alpha) if isinstance(alpha, (int, float)) else np.asarray(alpha(size))
                fill = (1 - w) * forward + w * backward
            spot = slice(a, e)
            full[spot] = np.where(b.known[spot], full[spot], fill) if keep_known else fill
        out.append(full)
    return out


def simultaneous(t: Triples, group, base: str = "original") -> list[np.ndarray]:
    """Lag vectors, incomplete ones completed inside the subspace, averaged over diagonals."""
    if len(t.x.blocks) > 1:
        raise ValueError("systems are filled sequentially")
    b = t.x.blocks[0]
    if b.known.all():
        raise ValueError("there are no gaps")
    window, n = t.x.rows, len(b.values)
    space = t.column_space(t.pick(group))
    total, count = np.zeros(n, b.values.dtype), np.zeros(n)
    for start in range(n - window + 1):
        x, known = b.values[start : start + window], b.known[start : start + window]
        if known.all():
            y = space @ (np.conj(space.T) @ x)
        else:
            w, v = space[~known], space[known]
            m = np.eye(len(w)) - w @ np.conj(w.T)
            if not known.any() or np.linalg.cond(m) > 1e8:
                continue
            core = np.conj(v.T) @ x[known]
            y = np.empty(window, total.dtype)
            y[~known] = np.linalg.solve(m, w @ core)
            y[known] = v @ core + v @ (np.conj(w.T) @ np.linalg.solve(m, w @ core))
        total[start : start + window] += y
        count[start : start + window] += 1
    filled = np.where(count > 0, total / np.maximum(count, 1), np.nan)
    return [filled if base == "reconstructed" else np.where(b.known, b.values, filled)]


def largest(x: np.ndarray) -> float:
    return float(np.abs(x).max(initial=0))


def iterative(fit: Callable[[list[np.ndarray]], Triples], arrays: list[np.ndarray], groups: list[list[int]], fill=None, tolerance: float = 1e-6, rounds: int = 0, norm: Callable[[np.ndarray], float] = largest, base: str = "original") -> tuple[list[list[np.ndarray]], int, bool]:
    """Gaps filled by repeated decomposition. fit: decomposes complete arrays.

    Starts from each array's mean, or from fill: a number, or arrays with a value for each gap.
    Returns the filled arrays of each group, the rounds taken and whether they settled; rounds = 0
    goes on until they do, MOST_ROUNDS at most.
    """
    gaps = [~np.isfinite(a) for a in arrays]
    if not any(g.any() for g in gaps):
        raise ValueError("there are no gaps")
    start = []
    for i, (a, g) in enumerate(zip(arrays, gaps, strict=True)):
        value = np.full(a.shape, a[~g].mean(), a.dtype) if fill is None else np.broadcast_to(np.asarray(fill if np.isscalar(fill) else fill[i]), a.shape)
        if not np.isfinite(value[g]).all():
            raise ValueError("fill has no value for some gaps")
        start.append(np.where(g, value, a))
    now, top, settled = start, max(i for g in groups for i in g), False
    for done in range(1, (rounds or MOST_ROUNDS) + 1):
        rec = fit(now).series(range(1, top + 1))
        new = [np.where(g, r, a) for g, r, a in zip(gaps, rec, arrays, strict=True)]
        change = norm(np.concatenate([(x - y)[g] for x, y, g in zip(new, now, gaps, strict=True)]))
        now = new
        if change < tolerance:
            settled = True
            break
    final = fit(now)
    out = []
    for group in groups:
        rec = final.series(group)
        out.append(rec if base == "reconstructed" else [np.where(g, r, a) for g, r, a in zip(gaps, rec, arrays, strict=True)])
    return out, done, settled


def cadzow(t: Triples, rank: int, correct: bool = True, tolerance: float = 1e-6, rounds: int = 0, norm: Callable[[np.ndarray], float] = largest) -> tuple[list[np.ndarray], int, bool]:
    """The nearest series of finite rank that alternating projections reach."""
    flat = lambda arrays: np.concatenate([a.ravel() for a in arrays])
    now, settled = t.series(range(1, rank + 1)), False
    for done in range(1, (rounds or MOST_ROUNDS) + 1):
        new = refitted(t, now, rank).series(range(1, rank + 1))
        ok = np.isfinite(flat(new))
        change = norm((flat(new) - flat(now))[ok])
        if change < tolerance:
            settled = True
            break
        now = new
    if correct:
        w, f, g = (np.concatenate([x.ravel() for x in y]) for y in ([b.weights for b in t.x.blocks], [b.values for b in t.x.blocks], now))
        ok = w > 0
        scale = (w[ok] * f[ok] * np.conj(g[ok])).sum() / (w[ok] * np.abs(g[ok]) ** 2).sum()
        now = [scale * a for a in now]
    return now, done, settled


def high_rank_rate(t: Triples, rank: int) -> float:
    return float(1 - (t.sigma[:rank] ** 2).sum() / t.x.norm2)


def heterogeneity(f: np.ndarray, base_start: int, base: int, test: int, window: int, count: int) -> np.ndarray:
    """How far the lag vectors of each test segment lie from the subspace of one base segment."""
    from lagweave.kernels.decompose import leading
    from lagweave.kernels.trajectory import Block

    piece = f[base_start : base_start + base + 1]
    x = Trajectory([Block(piece, np.ones(window, bool), (False,))])
    u = leading(x, min(2 * count, 50, x.rows, x.columns))[1][:, :count]
    lag = np.lib.stride_tricks.sliding_window_view(f, window)
    kept, total = ((lag @ u) ** 2).sum(1), (lag**2).sum(1)
    k = test - window + 1
    sums = lambda v: np.convolve(v, np.ones(k), "valid")
    return 1 - sums(kept)[: len(f) - test] / sums(total)[: len(f) - test]
