"""Trajectory matrices as operators: embedding of one or several n-D arrays by a window.

All kinds share one structure. A block is an n-D array with a mask, embedded by a window that may
have a shape of its own and may wrap around in some dimensions; a system has several blocks side by
side. Products and diagonal averages are FFTs of the array's own size: a window of L and L-1 less
positions than N fill N exactly, so nothing wraps that should not. Flattening is column-major.
"""

from __future__ import annotations

import numpy as np


def circle(radius: int, rank: int = 2) -> np.ndarray:
    """Ball-shaped window: cells whose distance from the middle is at most radius - 1."""
    axes = np.meshgrid(*[np.arange(2 * radius - 1) - (radius - 1)] * rank, indexing="ij")
    return sum(a**2 for a in axes) <= (radius - 1) ** 2


def triangle(side: int, rank: int = 2) -> np.ndarray:
    """Simplex-shaped window: cells whose indices from 1 sum to at most side + rank - 1."""
    axes = np.meshgrid(*[np.arange(1, side + 1)] * rank, indexing="ij")
    return sum(axes) <= side + rank - 1


def hankel_weights(n: int, window: int) -> np.ndarray:
    """How many times each of n cells appears in the trajectory matrix."""
    t = np.arange(1, n + 1)
    return np.minimum.reduce([t, np.full(n, window), np.full(n, n - window + 1), n - t + 1])


def positions(shape: tuple[int, ...], window: tuple[int, ...], circular: tuple[bool, ...]) -> tuple[int, ...]:
    return tuple(n if c else n - w + 1 for n, w, c in zip(shape, window, circular, strict=True))


class Block:
    """One array (NaN outside the mask) with its window."""

    def __init__(self, values: np.ndarray, window: np.ndarray, circular: tuple[bool, ...], mask: np.ndarray | None = None):
        self.values, self.window, self.circular = values, window, circular
        self.known = np.isfinite(values) if mask is None else np.isfinite(values) & mask
        self.shape, self.axes = values.shape, tuple(range(values.ndim))
        self.places = positions(self.shape, window.shape, circular)
        if min(self.places) < 1:
            raise ValueError("the window is larger than the data")
        self.complex = np.iscomplexobj(values)
        # Known cells keep their values, others their mean, so that sums lose no digits.
        filled = np.where(self.known, values, values[self.known].mean() if self.known.any() else 0)
        self.spectrum = np.fft.fftn(filled)
        if self.known.all():
            self.used = np.ones(self.places, bool)
        else:
            count = self._correlate(np.fft.fftn(self.known.astype(float)), window.astype(float)).real
            self.used = np.rint(count[tuple(slice(p) for p in self.places)]).astype(int) == window.sum()
        self.weights = np.rint(self._convolve(window.astype(float), self.used.astype(float)).real).astype(int)

    def _correlate(self, spectrum: np.ndarray, x: np.ndarray) -> np.ndarray:
        """At every place, the sum of the array (given by its spectrum) times x laid there."""
        return np.fft.ifftn(spectrum * np.conj(np.fft.fftn(np.conj(x), self.shape, self.axes)))

    def _convolve(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return np.fft.ifftn(np.fft.fftn(a, self.shape, self.axes) * np.fft.fftn(b, self.shape, self.axes))

    def _real(self, x: np.ndarray, *of: np.ndarray) -> np.ndarray:
        return x if self.complex or any(np.iscomplexobj(v) for v in of) else x.real

    def times(self, v: np.ndarray) -> np.ndarray:
        full = np.zeros(self.places, v.dtype)
        full.T[self.used.T] = v
        out = self._correlate(self.spectrum, full)[tuple(slice(w) for w in self.window.shape)]
        return self._real(out, v).T[self.window.T]

    def adjoint(self, u: np.ndarray) -> np.ndarray:
        full = np.zeros(self.window.shape, u.dtype)
        full.T[self.window.T] = np.conj(u)
        out = np.conj(self._correlate(self.spectrum, full)[tuple(slice(p) for p in self.places)])
        return self._real(out, u).T[self.used.T]

    def sums(self, u: np.ndarray, v: np.ndarray) -> np.ndarray:
        """Sums of u v^H over the cells that stand for each cell of the array."""
        a, b = np.zeros(self.window.shape, u.dtype), np.zeros(self.places, v.dtype)
        a.T[self.window.T] = u
        b.T[self.used.T] = np.conj(v)
        return self._real(self._convolve(a, b), u, v)

    def averaged(self, u: np.ndarray, v: np.ndarray) -> np.ndarray:
        """Diagonal averages of u v^H; NaN in cells that no window covers."""
        with np.errstate(invalid="ignore", divide="ignore"):
            return np.where(self.weights > 0, self.sums(u, v) / self.weights, np.nan)

    def cells(self) -> tuple[np.ndarray, np.ndarray]:
        """Column-major cells of the window, and of the used positions, as index rows."""
        order = lambda m: np.argwhere(m.T)[:, ::-1]
        return order(self.window), order(self.used)

    def dense(self) -> np.ndarray:
        w, p = self.cells()
        at = tuple((w[:, None, d] + p[None, :, d]) % self.shape[d] for d in self.axes)
        return self.values[at]


class Trajectory:
    """The trajectory matrix of one or several blocks that share a window."""

    def __init__(self, blocks: list[Block]):
        self.blocks = blocks
        self.widths = [int(b.used.sum()) for b in blocks]
        self.ends = np.cumsum(self.widths)
        self.rows, self.columns = int(blocks[0].window.sum()), int(self.ends[-1])
        self.complex = any(b.complex for b in blocks)
        if not self.columns:
            raise ValueError("no complete window in the data")

    def parts(self, v: np.ndarray) -> list[np.ndarray]:
        return np.split(v, self.ends[:-1])

    def times(self, v: np.ndarray) -> np.ndarray:
        return sum(b.times(x) for b, x in zip(self.blocks, self.parts(v), strict=True))

    def adjoint(self, u: np.ndarray) -> np.ndarray:
        return np.concatenate([b.adjoint(u) for b in self.blocks])

    def averaged(self, u: np.ndarray, v: np.ndarray) -> list[np.ndarray]:
        return [b.averaged(u, x) for b, x in zip(self.blocks, self.parts(v), strict=True)]

    def dense(self) -> np.ndarray:
        return np.concatenate([b.dense() for b in self.blocks], axis=1)

    def with_values(self, arrays: list[np.ndarray]) -> Trajectory:
        """The same masks over other values."""
        new = []
        for b, x in zip(self.blocks, arrays, strict=True):
            new.append(Block(np.where(b.known, x, np.nan), b.window, b.circular))
        return Trajectory(new)

    @property
    def norm2(self) -> float:
        """Weighted sum of squares, which is the squared Frobenius norm of the matrix."""
        return float(sum((b.weights[b.weights > 0] * np.abs(b.values[b.weights > 0]) ** 2).sum() for b in self.blocks))

    @property
    def shaped(self) -> bool:
        return any(not b.used.all() or not b.window.all() for b in self.blocks)

    @property
    def circular(self) -> bool:
        return any(any(b.circular) for b in self.blocks)


def convolved(x: np.ndarray, y: np.ndarray, kind: str = "circular", reverse: bool = True) -> np.ndarray:
    """n-D convolution by FFT; with reverse, correlation: sums of x moved on against y.

    circular: of x's shape, wrapping around; open: zeros around, all overlaps; filter: full overlaps
    only. One kind for all dimensions, or one for each.
    """
    kinds = (kind,) * x.ndim if isinstance(kind, str) else tuple(kind)
    if len(kinds) != x.ndim or x.ndim != y.ndim or not {*kinds} <= {"circular", "open", "filter"}:
        raise ValueError("kind is circular, open or filter, for each dimension of both arrays")
    size = tuple(n + m - 1 if k == "open" else n for n, m, k in zip(x.shape, y.shape, kinds, strict=True))
    out = tuple(n - m + 1 if k == "filter" else s for n, m, s, k in zip(x.shape, y.shape, size, kinds, strict=True))
    axes = tuple(range(x.ndim))
    fy = np.fft.fftn(y, size, axes)
    full = np.fft.ifftn(np.fft.fftn(x, size, axes) * (np.conj(fy) if reverse else fy))[tuple(slice(n) for n in out)]
    return full if np.iscomplexobj(x) or np.iscomplexobj(y) else full.real
