"""Decompositions of a trajectory matrix into eigentriples, and what is read off them."""

from __future__ import annotations

import warnings
from dataclasses import dataclass, field, replace

import numpy as np

from lagweave.kernels.trajectory import Trajectory

DENSE_BELOW = 500
LANCZOS = ("nutrlan", "propack", "rspectra", "primme", "lanczos")
METHODS = ("auto", "svd", "eigen", *LANCZOS)


@dataclass(frozen=True)
class Triples:
    """sigma, U and V of a fit. The first `right` triples come from the row projector, the next
    `left` ones from the column projector. row_weight and column_weight belong to the weighted kind;
    oblique marks vectors that need not be orthogonal."""

    x: Trajectory
    sigma: np.ndarray
    u: np.ndarray
    v: np.ndarray
    right: int = 0
    left: int = 0
    kind: str = "1d"
    oblique: bool = False
    column_weight: np.ndarray | None = None
    row_weight: np.ndarray | None = None
    nested: tuple[tuple[int, ...], ...] = ()
    report: dict = field(default_factory=dict)

    @property
    def special(self) -> int:
        return self.right + self.left

    def pick(self, indices) -> np.ndarray:
        """0-based indices of 1-based ones; repeated ones count once."""
        at = np.unique(np.asarray(list(indices), int)) - 1
        if len(at) and (at[0] < 0 or at[-1] >= len(self.sigma)):
            raise ValueError(f"groups name eigentriple {at[-1] + 1} of {len(self.sigma)}")
        return at

    def elementary(self, i: int) -> list[np.ndarray]:
        """The i-th component (from 0) as arrays."""
        u, v = self.u[:, i], self.v[:, i]
        if self.column_weight is None:
            return [self.sigma[i] * a for a in self.x.averaged(u, v)]
        c, r = self.column_weight, self.row_weight
        over = self.x.averaged(u * c, v * r)
        with np.errstate(invalid="ignore", divide="ignore"):
            return [self.sigma[i] * a / b for a, b in zip(over, self.x.averaged(c, r), strict=True)]

    def series(self, indices) -> list[np.ndarray]:
        """The sum of components; zeros for none; NaN where no window reaches."""
        out = [np.where(b.weights > 0, 0.0, np.nan).astype(complex if self.x.complex else float) for b in self.x.blocks]
        for i in self.pick(indices):
            out = [a + b for a, b in zip(out, self.elementary(i), strict=True)]
        return out

    def column_space(self, at: np.ndarray) -> np.ndarray:
        return orthonormal(self.u[:, at]) if self.oblique or self.column_weight is not None or self.special else self.u[:, at]

    def row_space(self, at: np.ndarray) -> np.ndarray:
        return orthonormal(self.v[:, at]) if self.oblique or self.row_weight is not None or self.special or self.kind == "toeplitz" else self.v[:, at]

    def contributions(self) -> np.ndarray:
        if self.oblique:
            warnings.warn("components are not orthogonal; contributions need not sum to one", stacklevel=2)
        return self.sigma**2 / self.x.norm2


def orthonormal(x: np.ndarray) -> np.ndarray:
    return np.linalg.qr(x)[0] if x.size else x


def rank_limit(x: Trajectory, special: int = 0) -> int:
    return min(x.rows, x.columns) - special


def default_count(x: Trajectory, special: int = 0) -> int:
    return min(50, rank_limit(x, special))


def signed(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Vectors whose largest entry in u is positive, so that equal inputs give equal outputs."""
    if not u.size:
        return u, v
    top = u[np.abs(u).argmax(0), np.arange(u.shape[1])]
    turn = np.where(top == 0, 1, np.conj(top) / np.where(top == 0, 1, np.abs(top)))
    return u * turn, v * turn


def lanczos(times, adjoint, rows: int, columns: int, count: int, kind=float, tolerance: float = 1e-11) -> tuple[np.ndarray, ...] | None:
    """Leading singular triples by Golub-Kahan bidiagonalisation with full reorthogonalisation.

    The basis grows until the wanted residuals are small; None where that takes a full basis.
    """
    rng = np.random.default_rng(0)
    limit, size = min(rows, columns), 0
    steps = min(limit, 2 * count + 20)
    p = rng.standard_normal(columns).astype(kind)
    vs, us = [p / np.linalg.norm(p)], []
    alpha, beta = [], []
    while True:
        while size < steps:
            u = without(times(vs[size]), us)
            a = np.linalg.norm(u)
            if a < 1e-300:
                return None
            us.append(u / a)
            alpha.append(a)
            v = without(adjoint(us[size]), vs)
            b = np.linalg.norm(v)
            beta.append(b)
            size += 1
            if b < 1e-14 * max(alpha):
                break
            vs.append(v / b)
        m = np.diag(alpha) + np.diag(beta[: size - 1], 1)
        p, s, q = np.linalg.svd(m)
        done = len(vs) == size or (size >= count and (beta[size - 1] * np.abs(p[-1, :count]) <= tolerance * s[0]).all())
        if done and size >= count:
            return s[:count], np.stack(us[:size], 1) @ p[:, :count], np.stack(vs[:size], 1) @ np.conj(q[:count].T)
        if size >= limit or len(vs) == size:
            return None
        steps = min(limit, 2 * steps)


def without(x: np.ndarray, basis: list[np.ndarray]) -> np.ndarray:
    """x less its part in the span of an orthonormal basis, taken off twice for accuracy."""
    if basis:
        b = np.stack(basis)
        for _ in range(2):
            x = x - b.T @ (np.conj(b) @ x)
    return x


def leading(x: Trajectory, count: int, method: str = "auto", matrix=None, times=None, adjoint=None) -> tuple[np.ndarray, ...]:
    """sigma, U and V of the leading triples of x, or of a matrix of its shape, given by a function
    that builds it and by its products with vectors."""
    if method not in METHODS:
        raise ValueError(f"svd method {method!r} is not one of {METHODS}")
    rows, columns = x.rows, x.columns
    if method == "auto":
        method = "svd" if min(rows, columns) < DENSE_BELOW or count > min(rows, columns) / 2 else "lanczos"
    if method in LANCZOS:
        kind = complex if x.complex else float
        found = lanczos(times or x.times, adjoint or x.adjoint, rows, columns, count, kind)
        if found is not None:
            return (found[0], *signed(*found[1:]))
    dense = x.dense() if matrix is None else matrix()
    if method == "eigen":
        values, u = np.linalg.eigh(dense @ np.conj(dense.T))
        order = np.argsort(-values, kind="stable")[:count]
        sigma, u = np.sqrt(np.maximum(values[order], 0)), u[:, order]
        return (sigma, *signed(u, right_vectors(np.conj(dense.T) @ u, sigma)))
    u, s, vh = np.linalg.svd(dense, full_matrices=False)
    return (s[:count], *signed(u[:, :count], np.conj(vh[:count].T)))


def right_vectors(xu: np.ndarray, sigma: np.ndarray) -> np.ndarray:
    small = sigma <= np.finfo(float).eps * max(sigma.max(initial=0), 1e-300)
    if small.any():
        warnings.warn("some singular values are zero; their right vectors are set to zero", stacklevel=3)
    return np.where(small, 0, xu / np.where(small, 1, sigma))


def basic(x: Trajectory, count: int | None = None, method: str = "auto", kind: str = "1d") -> Triples:
    return Triples(x, *leading(x, min(count or default_count(x), rank_limit(x)), method), kind=kind)


def lag_correlations(f: np.ndarray, window: int, circular: bool = False) -> np.ndarray:
    """Mean products at lags 0 to window - 1; the mean is not removed."""
    n = len(f)
    if circular:
        return np.array([(f * np.roll(f, -k)).sum() / n for k in range(window)])
    return np.array([(f[: n - k] * f[k:]).sum() / (n - k) for k in range(window)])


def toeplitz(x: Trajectory, count: int | None = None, method: str = "auto") -> Triples:
    b = x.blocks[0]
    if x.shaped:
        raise ValueError("a Toeplitz decomposition takes no gaps or shapes")
    window = x.rows
    c = lag_correlations(b.values, window, any(b.circular))
    wanted = min(count or default_count(x), window)
    if method not in METHODS:
        raise ValueError(f"svd method {method!r} is not one of {METHODS}")
    u = None
    if method in LANCZOS or method == "auto" and window >= DENSE_BELOW and wanted <= window / 2:
        u = toeplitz_vectors(c, wanted)
    if u is None:
        values, u = np.linalg.eigh(c[np.abs(np.subtract.outer(np.arange(window), np.arange(window)))])
        u = u[:, np.argsort(-values, kind="stable")[:wanted]]
    z = np.stack([x.adjoint(y) for y in u.T], 1)
    sigma = np.linalg.norm(z, axis=0)
    v = right_vectors(z, sigma)
    order = np.argsort(-sigma, kind="stable")
    return Triples(x, sigma[order], *signed(u[:, order], v[:, order]), kind="toeplitz")


def toeplitz_vectors(c: np.ndarray, count: int) -> np.ndarray | None:
    """Eigenvectors of the largest eigenvalues of the symmetric Toeplitz matrix with first row c,
    from products by FFT; None where the iteration does not settle.

    The matrix is lifted by its norm's bound, so that the largest eigenvalues are the largest
    singular values too.
    """
    n, lift = len(c), 2 * np.abs(c).sum() - abs(c[0])
    spectrum = np.fft.rfft(np.concatenate([c, [0.0], c[:0:-1]]))
    times = lambda v: np.fft.irfft(spectrum * np.fft.rfft(v, 2 * n), 2 * n)[:n] + lift * v
    found = lanczos(times, times, n, n, count)
    return None if found is None else np.linalg.qr(found[1])[0]


BASES = {"none": 0, "constant": 1, "centering": 1, "linear": 2, "quadratic": 3, "qubic": 4, "cubic": 4}


def orthopoly(degrees: int | str, n: int) -> np.ndarray:
    """Orthonormal polynomials of the first degrees over n points."""
    d = BASES[degrees] if isinstance(degrees, str) else int(degrees)
    if d == 0:
        return np.zeros((n, 0))
    t = np.linspace(-1, 1, n) if n > 1 else np.zeros(1)
    return np.linalg.qr(np.stack([t**k for k in range(d)], 1))[0]


def basis(given, cells: np.ndarray, shape: tuple[int, ...], mask: np.ndarray) -> np.ndarray:
    """An orthonormal basis over the cells of a mask, from a name, a number of degrees or a matrix."""
    if not isinstance(given, (str, int, np.integer)):
        return orthonormal(np.asarray(given, float))
    d = BASES[given] if isinstance(given, str) else int(given)
    if d <= 1 or len(shape) == 1:
        full = orthopoly(d, int(np.prod(shape)))
        return orthonormal(full[mask.T.ravel()])
    raise ValueError("polynomials beyond constants are for series only")


def projected(x: Trajectory, count: int | None = None, column_projector="none", row_projector="none", method: str = "auto", kind: str = "1d") -> Triples:
    """Special triples from the projectors, then ordinary ones of what both leave.

    The row projector's basis has the length of rows of X (positions), the column projector's that
    of columns (window).
    """
    b = x.blocks[0]
    lu = basis(column_projector, b.cells()[0], b.window.shape, b.window)
    rv = basis(row_projector, b.cells()[1], b.places, b.used)
    product = lambda f, m: np.stack([f(c) for c in m.T], 1) if m.shape[1] else np.zeros((len(f(np.zeros(len(m)))), 0))
    ru = product(x.times, rv)
    lv = product(x.adjoint, lu) - rv @ (ru.T @ lu)
    special = rv.shape[1] + lu.shape[1]
    n = min(count or default_count(x, max(rv.shape[1], lu.shape[1])), rank_limit(x, max(rv.shape[1], lu.shape[1])))
    # What both projectors leave, as products; the matrix itself is built for dense methods only.
    s, u, v = leading(x, n, method, lambda: x.dense() - ru @ rv.T - lu @ lv.T,
                      lambda a: x.times(a) - ru @ (rv.T @ a) - lu @ (lv.T @ a), lambda a: x.adjoint(a) - rv @ (ru.T @ a) - lv @ (lu.T @ a))
    rs, ls = np.linalg.norm(ru, axis=0), np.linalg.norm(lv, axis=0)
    safe = lambda a, n: np.where(n > 0, a / np.where(n > 0, n, 1), 0)
    return Triples(x, np.concatenate([rs, ls, s]), np.concatenate([safe(ru, rs), lu, u], 1), np.concatenate([rv, safe(lv, ls), v], 1), rv.shape[1], lu.shape[1], kind) if special else basic(x, count, method, kind)


def weighted(x: Trajectory, count: int | None = None, column_weight=None, row_weight=None, method: str = "auto", kind: str = "1d", least: float = 1e-6) -> Triples:
    """Decomposition in the inner products of diagonal weights; weights over columns' and rows' cells."""
    if x.shaped:
        raise ValueError("weights take no gaps or shapes")
    c = np.ones(x.rows) if column_weight is None else np.asarray(column_weight, float)
    r = np.ones(x.columns) if row_weight is None else np.asarray(row_weight, float)
    if c.shape != (x.rows,) or r.shape != (x.columns,):
        raise ValueError("weights are vectors of the window's and of the positions' length")
    a, b = np.sqrt(c), np.sqrt(r)
    inverse = lambda w: np.where(w > least * w.max(), 1 / np.where(w > 0, w, 1), 0)
    s, u, v = leading(x, min(count or default_count(x), rank_limit(x)), method, lambda: a[:, None] * x.dense() * b,
                      lambda y: a * x.times(b * y), lambda y: b * x.adjoint(a * y))
    u, v = inverse(a)[:, None] * u, inverse(b)[:, None] * v
    nu, nv = np.linalg.norm(u, axis=0), np.linalg.norm(v, axis=0)
    return Triples(x, s * nu * nv, u / nu, v / nv, kind=kind, column_weight=c, row_weight=r)


def refitted(t: Triples, arrays: list[np.ndarray], count: int) -> Triples:
    """A fit of the same kind to other values."""
    x = t.x.with_values(arrays)
    if t.kind == "toeplitz":
        return toeplitz(x, count)
    if t.special:
        return projected(x, count - t.special if count > t.special else count, t.u[:, t.right : t.special] if t.left else "none", t.v[:, : t.right] if t.right else "none", kind=t.kind)
    if t.column_weight is not None:
        return weighted(x, count, t.column_weight, t.row_weight, kind=t.kind)
    return basic(x, count, kind=t.kind)


def wcor(components: list[list[np.ndarray]], x: Trajectory) -> np.ndarray:
    """Weighted correlations of components; absolute values for complex ones."""
    flat = np.stack([np.concatenate([a.T.ravel() for a in arrays]) for arrays in components])
    w = np.concatenate([b.weights.T.ravel() for b in x.blocks])
    return weighted_correlations(flat[:, w > 0], w[w > 0])


def weighted_correlations(rows: np.ndarray, w: np.ndarray) -> np.ndarray:
    if not np.isfinite(rows).all():
        raise ValueError("components hold values that are not finite")
    g = (rows * w) @ np.conj(rows.T)
    d = np.sqrt(np.diag(g).real)
    with np.errstate(invalid="ignore", divide="ignore"):
        out = g / np.outer(d, d)
    out = np.abs(out) if np.iscomplexobj(out) else np.clip(out, -1, 1)
    np.fill_diagonal(out, 1)
    return out


def frobenius(t: Triples, groups: list[list[int]]) -> np.ndarray:
    """Correlations of the groups' matrices in the Frobenius inner product."""
    g = ((np.conj(t.u.T) @ t.u) * np.conj(np.conj(t.v.T) @ t.v) * np.outer(t.sigma, t.sigma)).real
    m = np.zeros((len(groups), len(t.sigma)))
    for i, x in enumerate(groups):
        m[i, t.pick(x)] = 1
    c = m @ g @ m.T
    d = np.sqrt(np.diag(c))
    out = np.clip(c / np.outer(d, d), -1, 1)
    np.fill_diagonal(out, 1)
    return out


def frobenius_orthogonal(t: Triples, groups: list[list[int]], tolerance: float = 1e-8) -> bool | float:
    c = np.abs(frobenius(t, groups) - np.eye(len(groups)))
    return True if c.max(initial=0) < tolerance else float(c.max())


def distance2(x: Trajectory, y: np.ndarray, sigma: np.ndarray, z: np.ndarray) -> float:
    """Squared Frobenius distance of a trajectory matrix from sum of sigma y z*, by products alone."""
    cross = sum(s * np.vdot(b, x.times(a)).real for a, s, b in zip(z.T, sigma, y.T, strict=True))
    own = ((np.conj(y.T) @ y) * np.conj(np.conj(z.T) @ z) * np.outer(sigma, sigma)).real.sum()
    return float(max(x.norm2 - 2 * cross + own, 0.0))


def oblique_correlations(t: Triples, groups: list[list[int]]) -> np.ndarray:
    """Correlations after the bases of nested groups are made orthogonal by their pseudo-inverses."""
    if not t.nested:
        raise ValueError("only nested decompositions have oblique correlations")
    inside = sorted({i for g in t.nested for i in g})
    if not {i for g in groups for i in g} <= set(inside):
        raise ValueError("groups must lie inside the nested groups")
    at = t.pick(inside)
    left, right = np.linalg.pinv(t.u[:, at]), np.linalg.pinv(t.v[:, at])
    rows = []
    for g in groups:
        part = np.zeros((t.x.rows, t.x.columns), t.u.dtype)
        for i in t.pick(g):
            part += t.sigma[i] * np.outer(t.u[:, i], np.conj(t.v[:, i]))
        rows.append((left @ part @ np.conj(right.T)).ravel())
    return weighted_correlations(np.stack(rows), np.ones(len(at) ** 2))


def with_triples(t: Triples, sigma: np.ndarray, u: np.ndarray, v: np.ndarray, **more) -> Triples:
    return replace(t, sigma=sigma, u=u, v=v, oblique=True, right=0, left=0, **more)
