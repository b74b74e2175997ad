"""Numerical kernels on arrays: no Spark in here.

A kernel gets flat sequences of numbers and returns plain numbers, lists or dicts. Series
too short or constant, and point sets too small or flat, raise ValueError; the wrappers in
`functions.udfs` turn that into null or an error.
"""

from __future__ import annotations

from itertools import combinations
from math import comb

import numpy as np

# ---- series -------------------------------------------------------------------------------

MIN_BOX, SCALE_GROWTH = 4, 1.25


def dfa_scales(n: int) -> list[int]:
    out, k = [], 0
    while (s := int(MIN_BOX * SCALE_GROWTH**k + 0.5)) <= n // 4:
        if not out or s != out[-1]:
            out.append(s)
        k += 1
    return out


def dfa(series) -> float:
    """Fluctuation exponent: slope of log F(s) on log s, linear detrending in whole boxes of s readings."""
    x = np.asarray(series, dtype=float)
    if len(x) < 16 or not np.isfinite(x).all():
        raise ValueError("at least 16 finite readings are needed")
    y = np.cumsum(x - x.mean())
    logs = []
    scales = dfa_scales(len(x))
    for s in scales:
        m = len(y) // s
        box = y[: m * s].reshape(m, s)
        t = np.arange(s) - (s - 1) / 2
        centred = box - box.mean(axis=1, keepdims=True)
        rest = (centred**2).sum(axis=1) - (centred @ t) ** 2 / (t @ t)
        logs.append(np.sqrt(max(rest.sum(), 0.0) / (m * s)))
    f = np.array(logs)
    if len(scales) < 3 or not (f > 0).all():
        raise ValueError("the series is too short or constant")
    return float(np.polyfit(np.log(scales), np.log(f), 1)[0])


def dfa_drift(series, window: int) -> dict:
    """Exponent of the last `window` readings less that of all before them."""
    x = np.asarray(series, dtype=float)
    if window < 16 or len(x) < window + 16:
        raise ValueError("window must be at least 16 and leave 16 readings before it")
    recent, baseline = dfa(x[-window:]), dfa(x[:-window])
    return {"drift": recent - baseline, "recent_alpha": recent, "baseline_alpha": baseline}


def change_points(series, window: int, threshold: float, max_points: int = 64) -> list[int]:
    """Boundaries where the windows before and after differ in mean or variance, one per run of flagged boundaries."""
    x = np.asarray(series, dtype=float)
    n = len(x)
    if window < 2 or n < 2 * window or threshold <= 0 or max_points < 1:
        raise ValueError("the series must hold two windows")
    s1, s2 = np.r_[0, np.cumsum(x)], np.r_[0, np.cumsum(x * x)]
    b = np.arange(window, n - window + 1)
    m1, m2 = (s1[b] - s1[b - window]) / window, (s1[b + window] - s1[b]) / window
    v1 = np.maximum((s2[b] - s2[b - window]) / window - m1**2, 0)
    v2 = np.maximum((s2[b + window] - s2[b]) / window - m2**2, 0)
    v1[v1 < 1e-12 * np.maximum(1, m1**2)] = 0
    v2[v2 < 1e-12 * np.maximum(1, m2**2)] = 0
    gap, pooled = np.abs(m2 - m1), np.sqrt((v1 + v2) / 2)
    low, high = np.minimum(v1, v2), np.maximum(v1, v2)
    by_mean = gap > threshold * pooled
    by_var = high > threshold**2 * low
    flagged = np.flatnonzero(by_mean | by_var)
    out = []
    for run in np.split(flagged, np.flatnonzero(np.diff(flagged) > 1) + 1) if len(flagged) else []:
        means = run[by_mean[run]]
        if len(means):
            out.append(int(b[means[gap[means].argmax()]]))
        else:
            ratio = np.log(np.maximum(high[run], 1e-300)) - np.log(np.maximum(low[run], 1e-300))
            out.append(int(b[run[ratio.argmax()]]))
    return out[:max_points]


def periodogram(series, max_peaks: int = 8) -> dict:
    """Frequencies k/n and powers |X_k|^2/n of the mean-removed series, strongest first."""
    x = np.asarray(series, dtype=float)
    if len(x) < 4 or max_peaks < 1:
        raise ValueError("at least 4 readings are needed")
    power = np.abs(np.fft.rfft(x - x.mean())) ** 2 / len(x)
    k = np.arange(1, len(x) // 2 + 1)
    order = np.lexsort((k, -np.round(power[k], 9)))[:max_peaks]
    return {"freqs": (k[order] / len(x)).tolist(), "power": power[k[order]].tolist()}


def spectral_entropy(series, window: int = 64, hop: int = 32, max_frames: int = 4096) -> list[float]:
    """Normalized entropy of the power spectrum of each frame (mean removed, periodic Hann window), 0 without energy."""
    x = np.asarray(series, dtype=float)
    if not 8 <= window <= 512 or hop < 1 or len(x) < window:
        raise ValueError("window must be in 8..512 and fit the series")
    frames = np.lib.stride_tricks.sliding_window_view(x, window)[::hop][:max_frames]
    hann = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(window) / window)
    p = np.abs(np.fft.rfft((frames - frames.mean(axis=1, keepdims=True)) * hann, axis=1)[:, 1 : window // 2 + 1]) ** 2
    total = p.sum(axis=1, keepdims=True)
    q = p / np.where(total > 1e-18, total, 1)
    h = -np.where(q > 0, q * np.log(np.where(q > 0, q, 1)), 0).sum(axis=1) / np.log(window // 2)
    return np.where(total[:, 0] > 1e-18, h, 0.0).tolist()


# ---- points, meshes, graphs ------------------------------------------------------------------

def _points(points, dim: int, least: int) -> np.ndarray:
    p = np.asarray(points, dtype=float)
    if dim < 1 or p.size % dim:
        raise ValueError("the number of coordinates is no multiple of dim")
    p = p.reshape(-1, dim)
    if len(p) < least or not np.isfinite(p).all():
        raise ValueError(f"at least {least} finite points are needed")
    return p


def box_dimension(points, dim: int) -> float:
    """Slope of log box count on log 1/size over octaves that are not yet saturated by the number of points."""
    p = _points(points, dim, 8)
    extent = float(np.ptp(p, axis=0).max())
    if extent <= 0:
        raise ValueError("the points are all the same")
    u = (p - p.min(axis=0)) / extent
    ks, counts = [], []
    for k in range(1, 21):
        cells = np.minimum((u * 2**k).astype(np.int64), 2**k - 1)
        n = len(np.unique(cells, axis=0))
        if n > 0.316 * len(p):
            break
        ks.append(k)
        counts.append(n)
    if len(ks) < 3:
        raise ValueError("fewer than three octaves can be used")
    return float(np.polyfit(np.array(ks) * np.log(2), np.log(counts), 1)[0])


def lacunarity(points, dim: int, per_axis: int = 8) -> float:
    """E[m^2] / E[m]^2 of the points per box of a fixed grid."""
    p = _points(points, dim, 8)
    span = np.ptp(p, axis=0)
    cell = np.minimum(((p - p.min(axis=0)) / np.where(span > 0, span, 1) * per_axis).astype(np.int64), per_axis - 1)
    m = np.bincount(np.ravel_multi_index(cell.T, (per_axis,) * dim), minlength=per_axis**dim)
    return float((m.astype(float) ** 2).mean() / m.mean() ** 2)


def _dimension_or_none(points, dim: int) -> float | None:
    """None for sets too small for a box dimension, so that the other figures still come out."""
    try:
        return box_dimension(points, dim)
    except ValueError:
        return None


def morphology(points, dim: int) -> dict:
    return {"dimension": box_dimension(points, dim), "lacunarity": lacunarity(points, dim)}


def _edges(edges, n: int) -> np.ndarray:
    e = np.asarray(edges, dtype=float).reshape(-1, 2)
    if len(e) == 0 or (np.abs(e - np.round(e)) > 1e-6).any() or (e < 0).any() or (e >= n).any():
        raise ValueError("edges must be pairs of node numbers")
    return np.round(e).astype(np.int64)


def vascular_network(coords, edges, arcs) -> dict:
    """Mean arc over chord, branch nodes per arc length, and box dimension of a network in space."""
    p = _points(coords, 3, 8)
    e, arc = _edges(edges, len(p)), np.asarray(arcs, dtype=float)
    chord = np.linalg.norm(p[e[:, 0]] - p[e[:, 1]], axis=1)
    if len(arc) != len(e) or (chord <= 0).any() or (arc <= 0).any():
        raise ValueError("every edge needs an arc length and two different ends")
    branches = int((np.bincount(e.ravel(), minlength=len(p)) >= 3).sum())
    return {"mean_tortuosity": float((arc / chord).mean()), "branch_density": branches / float(arc.sum()), "fractal_dimension": _dimension_or_none(coords, 3)}


def nerve_plexus(coords, dim: int, edges) -> dict:
    """Edge length and branch nodes per measure of the bounding box (flat axes dropped), and box dimension."""
    p = _points(coords, dim, 8)
    e = _edges(edges, len(p))
    span = np.ptp(p, axis=0)
    measure = float(np.prod(span[span > 0]))
    length = float(np.linalg.norm(p[e[:, 0]] - p[e[:, 1]], axis=1).sum())
    branches = int((np.bincount(e.ravel(), minlength=len(p)) >= 3).sum())
    return {"fiber_length_density": length / measure, "branch_density": branches / measure, "fractal_dimension": _dimension_or_none(coords, dim)}


def _areas(v: np.ndarray, f: np.ndarray) -> float:
    return float(np.linalg.norm(np.cross(v[f[:, 1]] - v[f[:, 0]], v[f[:, 2]] - v[f[:, 0]]), axis=1).sum() / 2)


def hull_faces(p: np.ndarray) -> np.ndarray:
    """Triangles of the convex hull of points in space, outward, by adding points one at a time."""
    scale = float(np.ptp(p, axis=0).max())
    eps = 1e-9 * max(scale, 1e-300)
    a = int(p[:, 0].argmin())
    b = int(((p - p[a]) ** 2).sum(axis=1).argmax())
    c = int(np.linalg.norm(np.cross(p - p[a], p[b] - p[a]), axis=1).argmax())
    normal = np.cross(p[b] - p[a], p[c] - p[a])
    side = (p - p[a]) @ normal
    d = int(np.abs(side).argmax())
    if np.linalg.norm(normal) <= eps * scale or abs(side[d]) <= eps * np.linalg.norm(normal):
        raise ValueError("the points lie in one plane")
    if side[d] > 0:
        b, c = c, b
    faces = [(a, b, c), (a, d, b), (b, d, c), (c, d, a)]
    for k in range(len(p)):
        f = np.array(faces)
        n = np.cross(p[f[:, 1]] - p[f[:, 0]], p[f[:, 2]] - p[f[:, 0]])
        seen = ((p[k] - p[f[:, 0]]) * n).sum(axis=1) > eps * np.linalg.norm(n, axis=1)
        if not seen.any():
            continue
        rim: dict[tuple[int, int], int] = {}
        for x, y, z in f[seen].tolist():
            for u, v in ((x, y), (y, z), (z, x)):
                if (v, u) in rim:
                    del rim[(v, u)]
                else:
                    rim[(u, v)] = 1
        faces = [tuple(t) for t in f[~seen].tolist()] + [(u, v, k) for u, v in rim]
    return np.array(faces)


def cortical_folding(verts, faces) -> dict:
    """Mesh area, area of its convex hull, and their ratio."""
    p = _points(verts, 3, 4)
    f = np.asarray(faces, dtype=float).reshape(-1, 3)
    if len(f) == 0 or (np.abs(f - np.round(f)) > 1e-6).any() or (f < 0).any() or (f >= len(p)).any():
        raise ValueError("faces must be triples of vertex numbers")
    mesh, hull = _areas(p, np.round(f).astype(np.int64)), _areas(p, hull_faces(p))
    return {"mesh_area": mesh, "hull_area": hull, "gyrification_index": mesh / hull}


def persistence(points, dim: int, max_dim: int, threshold: float, max_bars: int = 64) -> dict:
    """Deaths of connected components up to `threshold` (edges of the least spanning tree) and the cycle rank of the graph there; more than 512 points are an error, which array functions turn into null."""
    p = _points(points, dim, 2)
    if len(p) > 512 or max_dim not in (0, 1) or threshold <= 0:
        raise ValueError("at most 512 points, max_dim 0 or 1, a positive threshold")
    d = np.sqrt(((p[:, None] - p[None]) ** 2).sum(axis=2))
    i, j = np.triu_indices(len(p), 1)
    order = np.argsort(d[i, j], kind="stable")
    parent = list(range(len(p)))

    def root(k: int) -> int:
        while parent[k] != k:
            parent[k] = parent[parent[k]]
            k = parent[k]
        return k

    bars, within = [], int((d[i, j] <= threshold).sum())
    for q in order:
        if d[i[q], j[q]] > threshold:
            break
        a, b = root(int(i[q])), root(int(j[q]))
        if a != b:
            parent[a] = b
            bars.append(float(d[i[q], j[q]]))
    parts = len(p) - len(bars)
    return {"n_h0_bars": min(len(bars), max_bars), "h0_bars": bars[:max_bars], "betti1": within - len(p) + parts if max_dim == 1 else None}


# ---- fingerprints and cycles ---------------------------------------------------------------

def plane_signs(n_bits: int, dim: int, seed: int = 0) -> np.ndarray:
    """Signs of the projection planes: a parity of an integer mix, so that SQL can compute them too."""
    b, i = np.meshgrid(np.arange(n_bits, dtype=np.int64), np.arange(dim, dtype=np.int64), indexing="ij")
    mix = (b * 7919 + i * 104729 + (seed % 1000003) * 15485863 + 12345) % 2147483647
    mix = (mix * 48271) % 2147483647
    mix = (mix * 48271 + b + 1) % 2147483647
    return np.where((mix // 65536) % 2 == 0, 1.0, -1.0)


def fingerprint(vec, n_bits: int, seed: int = 0) -> bytes:
    """Sign bits of n_bits projections, first bit highest."""
    v = np.asarray(vec, dtype=float)
    if n_bits < 1 or len(v) < 1:
        raise ValueError("n_bits must be positive")
    return np.packbits(plane_signs(n_bits, len(v), seed) @ v >= 0).tobytes()


class CycleDetector:
    """Brent's cycle search over a stream of fingerprints: constant state, armed again after each hit."""

    def __init__(self, hamming: int = 0, power: int = 1, lam: int = 0, checkpoint: bytes | None = None):
        self.hamming, self.power, self.lam, self.checkpoint = hamming, power, lam, checkpoint

    def feed(self, state: bytes) -> int:
        """Length of the cycle that this state closes, 0 if none."""
        if self.checkpoint is None:
            self.checkpoint = state
            return 0
        self.lam += 1
        if (int.from_bytes(self.checkpoint, "big") ^ int.from_bytes(state, "big")).bit_count() <= self.hamming:
            found, self.power, self.lam, self.checkpoint = self.lam, 1, 0, state
            return found
        if self.lam == self.power:
            self.power, self.lam, self.checkpoint = 2 * self.power, 0, state
        return 0


def detect_cycle(states: list[bytes], hamming: int = 0) -> dict:
    d = CycleDetector(hamming)
    for k, s in enumerate(states):
        if n := d.feed(s):
            return {"detected": True, "cycle_len": n, "at_index": k}
    return {"detected": False, "cycle_len": None, "at_index": None}


def detect_loop(states, dim: int, n_bits: int = 64, seed: int = 42, hamming: int = 0) -> dict:
    """Loop if the norms of the states are persistent (exponent above 0.9) or their fingerprints cycle."""
    p = _points(states, dim, 1)
    try:
        alpha = dfa(np.linalg.norm(p, axis=1))
    except ValueError:
        alpha = 0.0
    cycle = detect_cycle([fingerprint(v, n_bits, seed) for v in p], hamming)
    return {"dfa_exponent": alpha, "is_loop_detected": bool(alpha > 0.9 or cycle["detected"])}


# ---- search and optimization -----------------------------------------------------------------

def diffusion_search(query, generations: int = 30, population: int = 50, diffusion: int = 2, walk: float = 0.5, seed: int = 1) -> dict:
    """Stochastic search by diffusing particles for the point of [-1, 1]^d closest to the query by cosine.

    Steps use nothing of the query but the fitness of points tried: particles diffuse around
    the weighted mean of the best quarter (or, with probability 1 - walk, each around a
    particle of that quarter), with a width that grows while successive means move the
    same way and shrinks while they undo one another.
    """
    q = np.asarray(query, dtype=float)
    rng = np.random.default_rng(seed)
    unit = q / max(np.linalg.norm(q), 1e-300)

    def fit(x: np.ndarray) -> np.ndarray:
        n = np.linalg.norm(x, axis=-1)
        return np.where(n > 0, 1 - (x @ unit) / np.where(n > 0, n, 1), 1.0)

    d, few = len(q), max(1, population // 4)
    weight = np.log(few + 0.5) - np.log(np.arange(1, few + 1))
    weight /= weight.sum()
    mass = 1 / (weight**2).sum()
    keep = (mass + 2) / (d + mass + 5)
    usual = np.sqrt(d) * (1 - 1 / (4 * d) + 1 / (21 * d * d))  # length of a standard normal vector
    pop = rng.uniform(-1, 1, (population, d))
    score = fit(pop)
    order = np.argsort(score, kind="stable")
    mean, sigma, drift = weight @ pop[order[:few]], 0.5, np.zeros(d)
    best, best_fit = pop[order[0]].copy(), float(score[order[0]])
    history = []
    for _ in range(generations):
        for _ in range(max(1, diffusion)):
            elite = pop[order[:few]]
            own = rng.random(population) >= walk
            centre = np.where(own[:, None], 0.9 * mean + 0.1 * elite[rng.integers(0, len(elite), population)], mean)
            pop = np.clip(centre + sigma * rng.normal(size=(population, d)), -1, 1)
            score = fit(pop)
            order = np.argsort(score, kind="stable")
            if score[order[0]] < best_fit:
                best, best_fit = pop[order[0]].copy(), float(score[order[0]])
            new = weight @ pop[order[:few]]
            drift = (1 - keep) * drift + np.sqrt(keep * (2 - keep) * mass) * (new - mean) / sigma
            mean, sigma = new, float(np.clip(sigma * np.exp(keep * (np.linalg.norm(drift) / usual - 1)), 1e-9, 1.0))
        history.append(best_fit)
    return {"dim": d, "generations": generations, "population_size": population, "best_point": best.tolist(), "best_fit": best_fit, "best_fit_per_gen": history}


def _long_only(mu: np.ndarray, cov: np.ndarray) -> np.ndarray:
    """Weights >= 0 with sum 1 that make return over risk greatest: active sets over the tangency solution."""
    active = np.arange(len(mu))
    while len(active):
        try:
            z = np.linalg.solve(cov[np.ix_(active, active)] + 1e-12 * np.eye(len(active)), mu[active])
        except np.linalg.LinAlgError:
            z = mu[active]
        if (z > 0).all():
            w = np.zeros(len(mu))
            w[active] = z / z.sum()
            return w
        if (z <= 0).all():
            break
        active = active[z > 0]
    w = np.zeros(len(mu))
    w[int((mu / np.sqrt(np.maximum(np.diag(cov), 1e-300))).argmax())] = 1.0
    return w


def _sharpe(w: np.ndarray, mu: np.ndarray, cov: np.ndarray) -> float:
    risk = float(np.sqrt(max(w @ cov @ w, 0.0)))
    return float(w @ mu) / risk if risk > 0 else 0.0


def _market(mu, cov, k: int) -> tuple[np.ndarray, np.ndarray]:
    m = np.asarray(mu, dtype=float)
    c = np.asarray(cov, dtype=float).reshape(len(m), -1)
    if c.shape != (len(m), len(m)) or not 1 <= k <= len(m) or not np.isfinite(m).all() or not np.isfinite(c).all():
        raise ValueError("cov must be n x n and k in 1..n")
    return m, c


def portfolio(mu, cov, k: int, seed: int = 0) -> dict:
    """At most k weights >= 0, sum 1, with the greatest return over risk: all k-subsets up to 5000, else greedy growth and swaps."""
    m, c = _market(mu, cov, k)
    n = len(m)

    def solve(pick: tuple[int, ...]) -> tuple[float, np.ndarray]:
        idx = np.array(pick)
        w = np.zeros(n)
        w[idx] = _long_only(m[idx], c[np.ix_(idx, idx)])
        return _sharpe(w, m, c), w

    if comb(n, k) <= 5000:
        best = max((solve(s) for s in combinations(range(n), k)), key=lambda r: r[0])
    else:
        rng = np.random.default_rng(seed)
        chosen: list[int] = []
        best = (-np.inf, np.zeros(n))
        while len(chosen) < k:
            best, j = max(((solve((*chosen, j)), j) for j in range(n) if j not in chosen), key=lambda r: r[0][0])
            chosen.append(j)
        for _ in range(4 * k):
            out, into = rng.integers(k), int(rng.integers(n))
            if into not in chosen:
                trial = [*chosen[:out], into, *chosen[out + 1:]]
                if (r := solve(tuple(trial)))[0] > best[0]:
                    best, chosen = r, trial
    return {"sharpe": best[0], "weights": best[1].tolist()}


def _restarts(m: np.ndarray, c: np.ndarray, k: int, n_restarts: int, seed: int) -> list[np.ndarray]:
    out = []
    for r in range(n_restarts):
        rng = np.random.default_rng(seed * 1000003 + r)
        pick = rng.choice(len(m), k, replace=False)
        w = np.zeros(len(m))
        w[pick] = _long_only(m[pick], c[np.ix_(pick, pick)])
        for _ in range(8 * k):
            trial = pick.copy()
            trial[rng.integers(k)] = rng.integers(len(m))
            if len(set(trial.tolist())) < k:
                continue
            t = np.zeros(len(m))
            t[trial] = _long_only(m[trial], c[np.ix_(trial, trial)])
            if _sharpe(t, m, c) > _sharpe(w, m, c):
                w, pick = t, trial
        out.append(w)
    return out


def portfolios(mu, cov, k: int, n_restarts: int = 8, overlap: float = 0.15, quality: float = 0.9, seed: int = 0) -> list[dict]:
    """Good portfolios that share few assets: at least `quality` of the best ratio, pairwise Jaccard overlap of holdings at most `overlap`."""
    m, c = _market(mu, cov, k)
    if not 1 <= n_restarts <= 64:
        raise ValueError("n_restarts must be in 1..64")
    found = sorted(_restarts(m, c, k, n_restarts, seed), key=lambda w: -_sharpe(w, m, c))
    best, kept = _sharpe(found[0], m, c), []
    for w in found:
        held = set(np.flatnonzero(w > 1e-9).tolist())
        if _sharpe(w, m, c) >= quality * best and all(len(held & h) <= overlap * len(held | h) for _, h in kept):
            kept.append((w, held))
    return [{"sharpe": _sharpe(w, m, c), "weights": w.tolist()} for w, _ in kept]


def pareto_front(mu, cov, k: int, n_restarts: int = 8, max_front: int = 8, seed: int = 0) -> list[dict]:
    """Portfolios not dominated in return and risk, thinned by crowding distance, by ascending risk."""
    m, c = _market(mu, cov, k)
    if not 1 <= max_front <= n_restarts <= 64:
        raise ValueError("1 <= max_front <= n_restarts <= 64")
    found = {tuple(np.round(w, 6)): w for w in _restarts(m, c, k, n_restarts, seed)}
    rows = [(float(w @ m), float(np.sqrt(max(w @ c @ w, 0))), w) for w in found.values()]
    front = [a for i, a in enumerate(rows) if not any((b[0] >= a[0] and b[1] <= a[1] and (b[0] > a[0] or b[1] < a[1] or j < i)) for j, b in enumerate(rows) if j != i)]
    front.sort(key=lambda r: r[1])
    while len(front) > max_front:
        r, s = np.array([x[0] for x in front]), np.array([x[1] for x in front])
        crowd = [abs(r[i + 1] - r[i - 1]) / max(np.ptp(r), 1e-300) + (s[i + 1] - s[i - 1]) / max(np.ptp(s), 1e-300) for i in range(1, len(front) - 1)]
        front.pop(1 + int(np.argmin(crowd)))
    return [{"return": a, "risk": b, "weights": w.tolist()} for a, b, w in front]


def subset(values, upper, k: int, previous=None, penalty: float = 0.0) -> dict:
    """Weights of at most k items, each in 0..upper, sum 1, with the greatest sum of weight times value.

    A turnover penalty against `previous` steers the choice but is not in the score.
    """
    v, u = np.asarray(values, dtype=float), np.asarray(upper, dtype=float)
    if len(v) != len(u) or not 1 <= k <= len(v) or (u < 0).any():
        raise ValueError("values and upper must have the same length, k be in 1..n")
    prev = np.zeros(len(v)) if previous is None else np.asarray(previous, dtype=float)
    room = np.minimum(u, 1.0)
    if np.sort(room)[::-1][:k].sum() < 1 - 1e-12:
        raise ValueError("the upper bounds cannot reach 1")

    def fill(pick: list[int]) -> tuple[float, np.ndarray]:
        w, left = np.zeros(len(v)), 1.0
        if penalty:  # what was held costs nothing to keep
            order = sorted(pick, key=lambda i: -(v[i] + (penalty if prev[i] > 0 else 0)))
        else:
            order = sorted(pick, key=lambda i: -v[i])
        for i in order:
            w[i] = min(room[i], left)
            left -= w[i]
        return (float(w @ v) - penalty * float(np.abs(w - prev).sum()) if left <= 1e-9 else -np.inf), w

    order = np.argsort(-v, kind="stable")
    pick = order[:k].tolist()
    best, w = fill(pick)
    while best == -np.inf:  # give up the smallest bound for the best value that helps
        worst = min(pick, key=lambda i: room[i])
        pick.remove(worst)
        pick.append(next(i for i in order.tolist() if i not in pick and room[i] > room[worst]))
        best, w = fill(pick)
    improved = True
    while improved:
        improved = False
        for i in list(pick):
            for j in range(len(v)):
                if j not in pick:
                    score, t = fill([*[x for x in pick if x != i], j])
                    if score > best + 1e-12:
                        best, w, pick, improved = score, t, [*[x for x in pick if x != i], j], True
                        break
            if improved:
                break
    return {"score": float(w @ v), "weights": w.tolist()}
