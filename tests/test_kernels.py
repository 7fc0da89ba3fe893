"""Kernels against formulas, dense matrices and the exact small values that are known."""

import numpy as np
import pytest

from lagweave.kernels import decompose as D
from lagweave.kernels import forecast as P
from lagweave.kernels import gaps as G
from lagweave.kernels import nested as N
from lagweave.kernels import trajectory as T
from lagweave.kernels.trajectory import Block, Trajectory, circle, hankel_weights, triangle


def one(f, window, circular=False):
    return Trajectory([Block(np.asarray(f), np.ones(window, bool), (circular,))])


def g(t):
    return np.exp(0.005 * t) + np.sin(2 * np.pi * t / 7)


@pytest.fixture(scope="module")
def fit():
    return D.basic(one(g(np.arange(1, 101.0)), 40))


def test_hankel_weights():
    assert [hankel_weights(5, k).tolist() for k in (1, 2, 3, 4, 5)] == [[1] * 5, [1, 2, 2, 2, 1], [1, 2, 3, 2, 1], [1, 2, 2, 2, 1], [1] * 5]


def test_products_of_a_binary_field():
    f = np.array([[1, 1, 0, 1, 1, 0], [0, 1, 1, 0, 1, 1], [1, 0, 1, 1, 0, 1], [1, 1, 0, 1, 1, 0.0]])
    x = Trajectory([Block(f, np.ones((2, 3), bool), (False, False))])
    rng = np.random.default_rng(0)
    v, u, d = rng.random(x.columns), rng.random(x.rows), x.dense()
    np.testing.assert_allclose(x.times(v), d @ v)
    np.testing.assert_allclose(x.adjoint(u), d.T @ u)
    np.testing.assert_allclose(d[:, 0], f[:2, :3].T.ravel())  # column-major


@pytest.mark.parametrize("window", [circle(3), triangle(4), np.ones((3, 2), bool)])
@pytest.mark.parametrize("circular", [(False, False), (True, False), (True, True)])
def test_shaped_and_circular_products(window, circular):
    rng = np.random.default_rng(1)
    f = rng.random((11, 13))
    f[4, 5] = np.nan
    x = Trajectory([Block(f, window, circular)])
    d = x.dense()
    assert np.isfinite(d).all()
    v, u = rng.random(x.columns), rng.random(x.rows)
    np.testing.assert_allclose(x.times(v), d @ v)
    np.testing.assert_allclose(x.adjoint(u), d.T @ u)
    w, p = x.blocks[0].cells()
    at = (w[:, None] + p[None]) % np.array(f.shape)
    total = np.zeros(f.shape)
    np.add.at(total, tuple(at.reshape(-1, 2).T), np.outer(u, v).ravel())
    np.testing.assert_allclose(x.blocks[0].sums(u, v), total, atol=1e-12)


def test_gapped_system_wcor():
    a, b = np.arange(1, 101.0), np.arange(1, 201.0)
    a[[4, 50, 51]] = np.nan
    t = D.basic(Trajectory([Block(x, np.ones(10, bool), (False,)) for x in (a, b)]), 3, kind="mssa")
    w = D.wcor([t.series([1]), t.series([2])], t.x)
    assert abs(w[0, 1]) < 1 and w[0, 0] == 1


def test_identities(fit):
    np.testing.assert_allclose((fit.sigma**2).sum(), fit.x.norm2)
    np.testing.assert_allclose(fit.series([1, 2, 3])[0], g(np.arange(1, 101.0)), atol=1e-12)
    np.testing.assert_allclose(fit.contributions().sum(), 1)
    np.testing.assert_allclose(D.frobenius(fit, [[1], [2, 3]]), np.eye(2), atol=1e-12)
    assert D.frobenius_orthogonal(fit, [[1], [2, 3]]) is True
    f = fit.x.blocks[0].values
    np.testing.assert_allclose(D.basic(one(f, 100, True)).sigma, np.sort(np.abs(np.fft.fft(f)))[::-1][:50], atol=1e-9)
    np.testing.assert_allclose(D.toeplitz(one(f, 30), 30).series(range(1, 31))[0], f, atol=1e-10)
    w = D.weighted(one(f, 20), None, np.linspace(1, 2, 20), np.linspace(1, 3, 81))
    np.testing.assert_allclose(w.series(range(1, 21))[0], f, atol=1e-10)


@pytest.mark.parametrize("method", ["svd", "eigen", "lanczos"])
def test_methods_agree(method):
    f = g(np.arange(1, 201.0)) + np.random.default_rng(2).normal(size=200)
    np.testing.assert_allclose(D.leading(one(f, 60), 8, method)[0], D.basic(one(f, 60), 8, "svd").sigma, rtol=1e-8)


def test_long_series_by_lanczos():
    f = g(np.arange(1, 3001.0) / 10)
    t = D.basic(one(f, 1200), 3)
    np.testing.assert_allclose(t.series([1, 2, 3])[0], f, atol=1e-8)


def test_forecasts(fit):
    ahead = g(np.arange(101, 121.0))
    np.testing.assert_allclose(P.recurrent(fit, [1, 2, 3], 20)[0], ahead, atol=1e-10)
    np.testing.assert_allclose(P.vector(fit, [1, 2, 3], 20)[0], ahead, atol=1e-10)
    np.testing.assert_allclose(P.recurrent(fit, [1, 2, 3], 10, reverse=True)[0], g(np.arange(-9, 1.0)), atol=1e-10)
    np.testing.assert_allclose(P.bootstrap(fit, [1, 2, 3], 20, 1, count=3), ahead, atol=1e-8)
    with pytest.raises(ValueError):
        P.apply_lrr(np.ones(3), np.ones(4), 1)
    with pytest.raises(ValueError):
        P.lrr(np.eye(3)[:, 2:])


def test_roots(fit):
    z = P.esprit(fit, [1, 2, 3])[:, 0]
    np.testing.assert_allclose(sorted(z.real), sorted([np.exp(0.005), *[np.cos(2 * np.pi / 7)] * 2]), atol=1e-10)
    for subspace in ("column", "row"):
        for solve in ("ls", "tls"):
            np.testing.assert_allclose(P.esprit(fit, [1, 2, 3], subspace, solve)[:, 0], z, atol=1e-8)
    with pytest.raises(ValueError):
        P.pairs(fit, [1, 2, 3])


def test_gaps():
    h = g(np.arange(1, 121.0))
    k = h.copy()
    k[40:45] = k[80] = np.nan
    t = D.basic(one(k, 20))
    np.testing.assert_allclose(G.sequential(t, [1, 2, 3])[0], h, atol=1e-10)
    np.testing.assert_allclose(G.simultaneous(t, [1, 2, 3])[0], h, atol=1e-10)
    out, _, settled = G.iterative(lambda a: D.basic(one(a[0], 20)), [k], [[1, 2, 3]], tolerance=1e-10)
    assert settled
    np.testing.assert_allclose(out[0][0], h, atol=1e-8)
    assert G.classified(np.isfinite(k), 20) == [(41, 45, "internal", "dense"), (81, 81, "internal", "dense")]
    assert G.classified(np.isfinite(k), 40) == [(41, 81, "right", "sparse")]
    with pytest.raises(ValueError):
        G.sequential(D.basic(one(h, 20)), [1])
    with pytest.raises(ValueError):
        G.sequential(t, [1], alpha=2)


def test_cadzow(fit):
    np.testing.assert_allclose(G.cadzow(fit, 3)[0][0], fit.x.blocks[0].values, atol=1e-8)
    assert G.high_rank_rate(fit, 3) < 1e-12


def test_nested():
    n = np.arange(1, 151.0)
    a, b = 2 * np.sin(2 * np.pi * n / 5), 2 * np.sin(2 * np.pi * n / 10)
    t = D.basic(one(a + b, 70), 4)
    f = N.filtered(t, [[1, 2, 3, 4]], normalize=False)
    np.testing.assert_allclose(f.series([1, 2])[0], a, atol=1e-10)
    for subspace in ("column", "row"):
        e, groups = N.esprit_oblique(t, [[1, 2, 3, 4]], subspace=subspace)
        np.testing.assert_allclose(e.series(groups[0])[0], b, atol=1e-9)
    with pytest.raises(ValueError):
        N.iterative_oblique(t, [[1, 2], [2, 3]])
    with pytest.raises(ValueError):
        D.oblique_correlations(t, [[1]])


@pytest.mark.parametrize("pairing", ["diag", "memp"])
def test_field_roots(pairing):
    i, j = np.meshgrid(np.arange(1, 31), np.arange(1, 29), indexing="ij")
    t = D.basic(Trajectory([Block(np.sin(2 * np.pi * i / 5) * np.sin(2 * np.pi * j / 8), circle(6), (False, False))]), 6)
    z = np.angle(P.esprit(t, [1, 2, 3, 4], pairing=pairing)) / (2 * np.pi)
    assert sorted(map(tuple, np.round(z, 6).tolist())) == sorted([(0.2, 0.125), (0.2, -0.125), (-0.2, 0.125), (-0.2, -0.125)])


def test_by_frequency_takes_first_of_ties():
    share, groups = N.by_frequency([np.ones(8)], 2)
    assert groups == [[0], []] and share[0, 0] == 1


def test_field_split():
    i, j = np.meshgrid(np.arange(1, 31), np.arange(1, 29), indexing="ij")
    a, b = np.sin(2 * np.pi * i / 5) * np.exp(j / 40), np.cos(2 * np.pi * j / 7) * np.exp(-i / 50)
    t = D.basic(Trajectory([Block(a + b, np.ones((10, 11), bool), (False, False))]), 4)
    e, groups = N.esprit_oblique(t, [[1, 2, 3, 4]])
    got = [e.series(g)[0] for g in groups]
    assert min(np.abs(got[0] - a).max(), np.abs(got[0] - b).max()) < 1e-8
    np.testing.assert_allclose(got[0] + got[1], a + b, atol=1e-9)


def test_lanczos_fits_equal_dense_ones():
    r = np.random.default_rng(2)
    t = np.arange(500)
    x = Trajectory([Block(np.sin(t / 7) + 0.3 * np.cos(t / 3) + 0.01 * t + 0.1 * r.normal(size=500), np.ones(120, bool), (False,))])
    w = r.uniform(0.5, 2, 120)
    for fit in (lambda m: D.toeplitz(x, 6, m), lambda m: D.projected(x, 6, "linear", "constant", m), lambda m: D.weighted(x, 6, w, None, m)):
        dense, quick = fit("svd"), fit("nutrlan")
        np.testing.assert_allclose(quick.sigma, dense.sigma, rtol=1e-8)
        np.testing.assert_allclose(quick.series(range(1, 7))[0], dense.series(range(1, 7))[0], atol=1e-7)


def test_convolutions_equal_sums():
    r = np.random.default_rng(1)
    x, y = r.normal(size=(7, 5)), r.normal(size=(3, 2))
    got = T.convolved(x, y, "filter")
    for i in range(5):
        for j in range(4):
            assert got[i, j] == pytest.approx((x[i : i + 3, j : j + 2] * y).sum())
    np.testing.assert_allclose(T.convolved(x[:, 0], y[:, 0], "open", reverse=False), np.convolve(x[:, 0], y[:, 0]))
    np.testing.assert_allclose(T.convolved(x[:, 0], y[:, 0]), [(np.roll(x[:, 0], -i)[:3] * y[:, 0]).sum() for i in range(7)])


def test_basis_distance_and_orthogonalization():
    z = np.array([0.9 * np.exp(0.7j), 0.9 * np.exp(-0.7j), 1.05])
    full = (z[None, :] ** np.arange(25)[:, None]) @ np.array([[1, 1j, 0], [1, -1j, 0], [0, 0, 1]])
    full = full.real
    np.testing.assert_allclose(P.enlarged(full[:20], 5), full, atol=1e-9)
    r = np.random.default_rng(4)
    y, w, s = r.normal(size=(9, 3)), r.normal(size=(12, 3)), np.array([3.0, 2, 1])
    x = Trajectory([Block(r.normal(size=20), np.ones(9, bool), (False,))])
    assert D.distance2(x, y, s, w) == pytest.approx(((x.dense() - (y * s) @ w.T) ** 2).sum())
    for side in ("bi", "left", "right"):
        sigma, a, b = N.orthogonalized(y, w, s, side)
        np.testing.assert_allclose((a * sigma) @ b.T, (y * s) @ w.T, atol=1e-10)
        for m in (a,) * (side != "right") + (b,) * (side != "left"):
            np.testing.assert_allclose(m.T @ m, np.eye(3), atol=1e-10)
    assert N.merged_groups([[1, 2], [3], [5]], [2, 4]) == [[3], [5], [2, 4, 1]]


def test_kept_apart_is_stepwise_scaling():
    r = np.random.default_rng(0)
    for _ in range(30):
        sigmas = [r.uniform(0.1, 5, r.integers(1, 4)) for _ in range(5)]
        scaled, by = [s.copy() for s in sigmas], [1.0] * 5
        for i in range(4):
            ratio = scaled[i].min() / scaled[i + 1].max()
            if ratio < 2:
                scaled[i + 1] *= ratio / 2
                by[i + 1] = 2 / ratio
        np.testing.assert_allclose(N.kept_apart(sigmas, 2), by)
