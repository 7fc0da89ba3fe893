"""Recurrences, recurrent and vector forecasts, and frequency estimates from the signal's subspace."""

from __future__ import annotations

import warnings

import numpy as np

from lagweave.kernels.decompose import Triples, orthonormal, refitted
from lagweave.kernels.trajectory import Block, Trajectory

EPS = float(np.sqrt(np.finfo(float).eps))


def lrr(u: np.ndarray, eps: float = EPS, reverse: bool = False, orthonormalize: bool = True) -> np.ndarray:
    """Coefficients, in time order, of the recurrence that vectors in the span of u obey."""
    if not u.shape[1]:
        return np.zeros(len(u) - 1)
    if orthonormalize:
        u = orthonormal(u)
    at = 0 if reverse else len(u) - 1
    p = np.conj(u) @ u[at]
    nu2 = p[at].real
    if 1 - nu2 < eps:
        raise ValueError("the verticality coefficient is 1: there is no recurrence")
    return np.delete(p, at) / (1 - nu2)


def roots(coefficients: np.ndarray, method: str = "companion") -> np.ndarray:
    """Characteristic roots of a recurrence, by decreasing modulus: eigenvalues of the companion
    matrix, or (polyroot) these after Newton's steps on the polynomial."""
    if method not in ("companion", "polyroot"):
        raise ValueError("method is companion or polyroot")
    n = len(coefficients)
    m = np.zeros((n, n), coefficients.dtype)
    m[1:, :-1] = np.eye(n - 1)
    m[:, -1] = coefficients
    z = np.linalg.eigvals(m)
    if method == "polyroot":
        p = np.concatenate([[1], -coefficients[::-1]])
        for _ in range(3):
            slope = np.polyval(np.polyder(p), z)
            step = np.polyval(p, z) / np.where(slope == 0, 1, slope)
            z = z - np.where((slope != 0) & (np.abs(step) < 1e-3), step, 0)
    return z[np.lexsort((-z.imag, -np.round(np.abs(z), 12)))]


def apply_lrr(series: np.ndarray, coefficients: np.ndarray, length: int, only_new: bool = False, drift=0.0, reverse: bool = False) -> np.ndarray:
    """The series continued by a recurrence; with reverse, before its beginning (coefficients of the
    first value by the next ones)."""
    n = len(coefficients)
    if n > len(series):
        raise ValueError("the recurrence is longer than the series")
    drift = np.broadcast_to(drift, (length,))
    if reverse:
        return apply_lrr(series[::-1], coefficients[::-1], length, only_new, drift)[::-1]
    out = np.concatenate([series, np.zeros(length, np.result_type(series, coefficients, drift))])
    for i in range(len(series), len(out)):
        out[i] = out[i - n : i] @ coefficients + drift[i - len(series)]
    return out[len(series) :] if only_new else out


def _check(t: Triples, circular_ok: bool) -> None:
    if t.x.shaped and not (circular_ok and t.x.circular) or t.x.circular and not circular_ok:
        raise ValueError("gapped, shaped or circular data cannot be forecast this way")
    if t.x.blocks[0].values.ndim > 1:
        raise ValueError("only series can be forecast")


def flipped(t: Triples) -> Triples:
    """The fit of the series run backwards."""
    from dataclasses import replace

    x = Trajectory([Block(b.values[::-1].copy(), b.window, b.circular) for b in t.x.blocks])
    v = np.concatenate([part[::-1] for part in np.split(t.v, t.x.ends[:-1])])
    return replace(t, x=x, u=t.u[::-1], v=v)


def _finish(base: list[np.ndarray], new: list[np.ndarray], only_new: bool, reverse: bool) -> list[np.ndarray]:
    out = new if only_new else [np.concatenate([a, b]) for a, b in zip(base, new, strict=True)]
    return [x[::-1] for x in out] if reverse else out


def recurrent(t: Triples, group, length: int = 1, base: str = "reconstructed", only_new: bool = True, reverse: bool = False, direction: str = "row") -> list[np.ndarray]:
    """Recurrent forecast of each block. direction is for systems."""
    _check(t, True)
    if reverse:
        t = flipped(t)
    at = t.pick(group)
    start = t.series(group) if base == "reconstructed" else [b.values for b in t.x.blocks]
    if len(t.x.blocks) > 1 and direction == "row":
        new = _row_recurrent(t.row_space(at), t.x, start, length)
    else:
        right = at[at < t.right]
        other = at[at >= t.right]
        c = lrr(t.column_space(other), orthonormalize=False)
        drift = 0.0
        if len(right):
            tail = np.append(-c, 1) @ (t.u[:, right] * t.sigma[right]) @ np.conj(t.v[:, right].T)
            rows = lrr(orthonormal(t.v[:, right]), orthonormalize=False)
            drift = apply_lrr(tail, rows, length, only_new=True)
        new = [apply_lrr(s, c, length, True, drift) for s in start]
    return _finish(start, new, only_new, reverse)


def _row_recurrent(v: np.ndarray, x: Trajectory, start: list[np.ndarray], length: int) -> list[np.ndarray]:
    ends = x.ends - 1
    others = np.delete(np.arange(x.columns), ends)
    w, q = v[ends], v[others]
    m = np.eye(len(ends)) - w @ np.conj(w.T)
    if np.linalg.cond(m) > 1 / EPS:
        raise ValueError("the row space is vertical: there is no recurrence")
    step = np.linalg.solve(m, w @ np.conj(q.T))
    tails = [s[len(s) - k + 1 :] for s, k in zip(start, x.widths, strict=True)]
    out = [[] for _ in start]
    for _ in range(length):
        new = step @ np.concatenate(tails)
        for i, value in enumerate(new):
            out[i].append(value)
            tails[i] = np.append(tails[i][1:], value) if len(tails[i]) else tails[i]
    return [np.array(o) for o in out]


def shift_matrix(u: np.ndarray, first: np.ndarray | None = None, second: np.ndarray | None = None, solve: str = "ls") -> np.ndarray:
    """Z with u[first] Z = u[second], by least squares or total least squares."""
    a = u[:-1] if first is None else u[first]
    b = u[1:] if second is None else u[second]
    if solve == "ls":
        return np.linalg.lstsq(a, b, rcond=None)[0]
    if solve != "tls":
        raise ValueError("solve method is ls or tls")
    r = u.shape[1]
    v = np.linalg.svd(np.concatenate([a, b], 1), full_matrices=False)[2].conj().T[:, :r]
    return np.conj(np.linalg.solve(v[:r].T, v[r:].T)) if np.iscomplexobj(u) else np.linalg.solve(v[:r].T, v[r:].T)


def enlarged(u: np.ndarray, more: int, solve: str = "ls") -> np.ndarray:
    """A basis with `more` rows after its last one, which its shift matrix gives."""
    z, rows = shift_matrix(u, solve=solve), [u[-1]]
    for _ in range(more):
        rows.append(rows[-1] @ z)
    return np.concatenate([u, np.stack(rows[1:])]) if more else u


def vector(t: Triples, group, length: int = 1, only_new: bool = True, direction: str = "row") -> list[np.ndarray]:
    """Vector forecast of each block."""
    _check(t, False)
    at = t.pick(group)
    window, base = t.x.rows, t.series(group)
    more = length + window - 1
    if len(t.x.blocks) > 1 and direction == "row":
        return _finish(base, _row_vector(t, at, length), only_new, False)
    right, other = at[at < t.right], at[at >= t.right]
    u = t.column_space(other)
    new = []
    for b, part in zip(t.x.blocks, t.x.parts(np.arange(t.x.columns)), strict=True):
        z = (t.u[:, at] * t.sigma[at]) @ np.conj(t.v[np.ix_(part, at)].T)
        head = np.zeros((window, 0))
        if len(right):  # the row projector's part goes on by itself
            p = orthonormal(t.v[:, right])
            turn = np.linalg.lstsq(p[:-1], p[1:], rcond=None)[0].T
            coefficients = p[part].T
            ahead, state = [], coefficients[:, -1]
            for _ in range(more):
                state = turn @ state
                ahead.append(state)
            map_ = (t.u[:, right] * t.sigma[right]) @ t.v[:, right].T @ p
            head = map_ @ np.stack(ahead, 1)
        solve = np.linalg.pinv(u[:-1]) if u.shape[1] else np.zeros((0, window - 1))
        columns, last = [], z[:, -1]
        for j in range(more):
            own = head[:, j] if len(right) else np.zeros(window, z.dtype)
            last = u @ (solve @ (last[1:] - own[:-1])) + own
            columns.append(last)
        full = np.concatenate([z, np.stack(columns, 1)], 1)
        new.append(_diagonal_means(full)[len(b.values) : len(b.values) + length])
    return _finish(base, new, only_new, False)


def _row_vector(t: Triples, at: np.ndarray, length: int) -> list[np.ndarray]:
    """Rows of the system's matrix continued in its row space."""
    x = t.x
    z = (t.u[:, at] * t.sigma[at]) @ np.conj(t.v[:, at].T)
    v = t.row_space(at)
    starts = x.ends - x.widths
    first, second = (np.delete(np.arange(x.columns), e) for e in (x.ends - 1, starts))
    # The next row agrees with this one, moved by a position in each channel, in all but the ends.
    solve = np.linalg.pinv(v[first])
    rows, more = [z[-1]], length + max(x.widths) - 1
    for _ in range(more):
        rows.append(v @ (solve @ rows[-1][second]))
    ahead = np.stack(rows[1:], 0)
    full = np.concatenate([z, ahead], 0)
    return [_diagonal_means(part)[len(b.values) : len(b.values) + length] for b, part in zip(x.blocks, np.split(full, x.ends[:-1], axis=1), strict=True)]


def _diagonal_means(m: np.ndarray) -> np.ndarray:
    rows, columns = m.shape
    at = np.add.outer(np.arange(rows), np.arange(columns)).ravel()
    n = np.bincount(at)
    if np.iscomplexobj(m):
        return (np.bincount(at, m.real.ravel()) + 1j * np.bincount(at, m.imag.ravel())) / n
    return np.bincount(at, m.ravel()) / n


def bootstrap(t: Triples, group, length: int, seed: int, kind: str = "recurrent", count: int | None = None, only_new: bool = True) -> np.ndarray:
    """One replicate: residuals are drawn anew, the series fitted again and forecast."""
    rec = t.series(group)[0]
    residual = t.x.blocks[0].values - rec
    rng = np.random.default_rng(seed)
    again = refitted(t, [rec + rng.choice(residual, len(residual))], count or len(t.sigma))
    return (recurrent if kind == "recurrent" else vector)(again, group, length, only_new=only_new)[0]


def parameters(z: np.ndarray) -> dict[str, np.ndarray]:
    angle = np.angle(z)
    with np.errstate(divide="ignore"):
        return {"period": np.where(np.abs(angle) < EPS, np.inf, 2 * np.pi / np.where(np.abs(angle) < EPS, 1, angle)), "frequency": angle / (2 * np.pi), "modulus": np.abs(z), "rate": np.log(np.abs(z))}


def moved(cells: np.ndarray, axis: int, shape: tuple[int, ...], wrap: bool) -> tuple[np.ndarray, np.ndarray]:
    """Indices of cells that have a next one along an axis, and of those next ones."""
    number = {tuple(c): i for i, c in enumerate(cells.tolist())}
    step = cells.copy()
    step[:, axis] += 1
    if wrap:
        step[:, axis] %= shape[axis]
    to = np.array([number.get(tuple(c), -1) for c in step.tolist()])
    return np.flatnonzero(to >= 0), to[to >= 0]


def esprit(t: Triples, group, subspace: str = "column", solve: str = "ls", pairing: str = "diag", beta: float = 8, normalize: bool | None = None) -> np.ndarray:
    """Signal roots of a group: roots x dimensions."""
    at, b = t.pick(group), t.x.blocks[0]
    if subspace == "column":
        space, cells, shape, wrap = t.column_space(at), b.cells()[0], b.window.shape, [c and n == w for c, n, w in zip(b.circular, b.shape, b.window.shape, strict=True)]
    elif len(t.x.blocks) > 1:
        parts, first, second, start = t.x.parts(np.arange(t.x.columns)), [], [], 0
        space = t.row_space(at)
        for part, block in zip(parts, t.x.blocks, strict=True):
            f, s = moved(block.cells()[1], 0, block.places, False)
            first.append(f + start)
            second.append(s + start)
            start += len(part)
        z = np.linalg.eigvals(shift_matrix(np.conj(space), np.concatenate(first), np.concatenate(second), solve))
        return _ordered(z[:, None])
    else:
        space, cells, shape, wrap = np.conj(t.row_space(at)), b.cells()[1], b.places, list(b.circular)
    shifts = [shift_matrix(space, *moved(cells, d, shape, wrap[d]), solve) for d in range(b.values.ndim)]
    if len(shifts) == 1:
        out = np.linalg.eigvals(shifts[0])[:, None]
    elif pairing == "diag":
        weights = np.array([0.0, *[beta**k for k in range(1, len(shifts))]])
        weights[0] = 1 - weights.sum()
        e = np.linalg.eig(sum(w * z for w, z in zip(weights, shifts, strict=True)))[1]
        out = np.stack([np.diag(np.linalg.solve(e, z @ e)) for z in shifts], 1)
    elif pairing == "memp":
        values, vectors = zip(*[np.linalg.eig(z) for z in shifts], strict=True)
        out = [values[0]]
        for value, e in zip(values[1:], vectors[1:], strict=True):
            match = np.abs(np.linalg.solve(vectors[0], e))
            take = np.zeros(len(value), int)
            for _ in range(len(value)):
                i, j = np.unravel_index(match.argmax(), match.shape)
                take[i] = j
                match[i, :] = match[:, j] = -1
            out.append(value[take])
        out = np.stack(out, 1)
    else:
        raise ValueError("pairing is diag or memp")
    if normalize if normalize is not None else (t.x.circular or t.kind == "toeplitz"):
        out = out / np.abs(out)
    return _ordered(out)


def _ordered(z: np.ndarray) -> np.ndarray:
    return z[np.lexsort((np.round(-z[:, 0].imag, 10), np.round(-np.abs(z[:, 0]), 10)))]


def pairs(t: Triples, group) -> np.ndarray:
    """Root of a pair of triples from the turns of the curve that their vectors draw."""
    at = t.pick(group)
    if len(at) != 2:
        raise ValueError("pairs need groups of two")
    if t.x.shaped or t.x.complex or t.x.blocks[0].values.ndim > 1:
        raise ValueError("pairs are for complete real series")
    steps = np.diff(t.u[:, at], axis=0)
    size = np.linalg.norm(steps, axis=1)
    cosine = (steps[1:] * steps[:-1]).sum(1) / (size[1:] * size[:-1])
    angle = np.arccos(np.clip(cosine, -1, 1))
    middle = np.median(angle)
    if middle and 1.4826 * np.median(np.abs(angle - middle)) / middle > 0.3:
        warnings.warn("the pair's turns vary; it may not be a harmonic", stacklevel=2)
    return np.array([[np.exp(1j * np.arccos(np.clip(np.median(cosine), -1, 1)))]])
