"""Known answers of the numerical kernels."""

import numpy as np
import pytest

from lumenfold.functions import kernels as K


def noise(n, seed=0):
    return np.random.default_rng(seed).normal(size=n)


def test_dfa_orders_noise_kinds():
    white = np.mean([K.dfa(noise(1024, s)) for s in range(5)])
    brown = np.mean([K.dfa(np.cumsum(noise(1024, s))) for s in range(5)])
    assert 0.4 < white < 0.6 and 1.35 < brown < 1.65


@pytest.mark.parametrize("series", [[1.0] * 40, list(range(10)), [np.nan] * 40])
def test_dfa_refuses_short_and_constant(series):
    with pytest.raises(ValueError):
        K.dfa(series)


def test_drift_is_positive_for_growing_persistence():
    assert K.dfa_drift(np.r_[noise(300), np.cumsum(noise(100, 1))], 100)["drift"] > 0.5


@pytest.mark.parametrize("window", [5, 10])
def test_change_point_of_a_step(window):
    assert K.change_points([0.0] * 20 + [5.0] * 20, window, 1.0) == [20]


def test_periodogram_finds_the_period():
    p = K.periodogram(np.sin(2 * np.pi * np.arange(144) / 12) + 0.1 * noise(144))
    assert abs(p["freqs"][0] - 1 / 12) < 0.01


def test_entropy_of_tone_noise_and_constant():
    t = np.arange(128)
    tone = K.spectral_entropy(np.sin(2 * np.pi * t / 8), 32, 16)
    assert len(tone) == 7 and max(tone) < 0.5
    assert np.mean(K.spectral_entropy(noise(128), 32, 16)) > 0.7
    assert K.spectral_entropy([3.0] * 48, 32, 16) == [0.0, 0.0]


def test_box_dimension_tells_ring_from_disc():
    a = np.linspace(0, 2 * np.pi, 4000, endpoint=False)
    ring = K.box_dimension(np.stack([np.cos(a), np.sin(a)], axis=1).ravel(), 2)
    disc = K.box_dimension(np.random.default_rng(0).uniform(size=8000), 2)
    assert ring + 0.3 < disc
    with pytest.raises(ValueError):
        K.box_dimension([0.0] * 8, 2)


def test_lacunarity_grows_with_a_hole():
    grid = [(r, c) for r in range(20) for c in range(20)]
    holed = [(r, c) for r, c in grid if not (6 <= r < 14 and 6 <= c < 14)]
    assert K.lacunarity(np.array(holed).ravel(), 2) > K.lacunarity(np.array(grid).ravel(), 2)


def test_persistence_of_a_ring():
    a = np.arange(8) * np.pi / 4
    ring = np.stack([3 * np.cos(a), 3 * np.sin(a)], axis=1).ravel()
    assert K.persistence(ring, 2, 1, 2.5)["betti1"] == 1
    assert K.persistence(ring, 2, 0, 2.5)["betti1"] is None


def test_hull_of_a_cube_with_two_faces():
    v = [x for p in ((a, b, c) for a in (0, 1) for b in (0, 1) for c in (0, 1)) for x in p]
    r = K.cortical_folding(v, [0, 1, 3, 0, 3, 2, 4, 5, 7, 4, 7, 6])
    assert abs(r["gyrification_index"] - 2 / 6) < 1e-9
    with pytest.raises(ValueError):
        K.cortical_folding([0, 0, 0, 1, 0, 0, 0, 1, 0, 1, 1, 0], [0, 1, 2])


def test_cycles():
    a, b, c = b"\x01", b"\x02", b"\x04"
    assert K.detect_cycle([a, b] * 4) == {"detected": True, "cycle_len": 2, "at_index": 3}
    assert K.detect_cycle([a, b, c] * 4) == {"detected": True, "cycle_len": 3, "at_index": 6}
    assert not K.detect_cycle([bytes([k]) for k in range(20)])["detected"]
    assert len(K.fingerprint(noise(12), 64)) == 8


def test_search_converges_on_the_direction():
    assert K.diffusion_search([0.3, -0.4, 0.5, 0.1])["best_fit"] < 1e-6


def test_portfolio_and_subset_are_feasible_and_best():
    rng = np.random.default_rng(3)
    mu, a = rng.uniform(0.01, 0.1, 6), rng.normal(size=(6, 12))
    cov = a @ a.T / 12
    r = K.portfolio(mu, cov.ravel(), 2)
    w = np.array(r["weights"])
    assert abs(w.sum() - 1) < 1e-9 and (w >= 0).all() and (w > 0).sum() <= 2
    grid = max((i * mu[p] + (1 - i) * mu[q]) / np.sqrt(np.array([i, 1 - i]) @ cov[np.ix_([p, q], [p, q])] @ np.array([i, 1 - i])) for p in range(6) for q in range(p) for i in np.linspace(0, 1, 101))
    assert r["sharpe"] >= grid - 1e-9
    assert all(x["sharpe"] <= r["sharpe"] + 1e-9 for x in K.portfolios(mu, cov.ravel(), 2))
    front = K.pareto_front(mu, cov.ravel(), 3)
    assert all(x["return"] < y["return"] for x, y in zip(front, front[1:]))
    s = K.subset([3, 2, 1, 5], [0.5, 0.5, 0.5, 0.25], 3)
    assert abs(s["score"] - (0.25 * 5 + 0.5 * 3 + 0.25 * 2)) < 1e-9
    with pytest.raises(ValueError):
        K.subset([1, 2], [0.1, 0.1], 2)
    with pytest.raises(ValueError):
        K.portfolios(mu, cov.ravel(), 2, n_restarts=65)
