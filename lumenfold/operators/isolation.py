"""Isolation forests over many sources at once, as array operations.

A forest belongs to one segment (one source, or one block of a long one): `trees` trees of
the given depth, each grown on a random sample of the segment's rows. All trees of all
segments grow level by level together; no step loops over rows or segments.

A node covers a box of feature space. The root's box reaches from 0 to the largest value
of the sample, or to the feature's `reach` where that is larger, and cuts are drawn inside the
box: so a sample without a single outlier still has empty leaves where outliers would lie,
and rows that end there are isolated at once. Scores then mean the same in every segment.
"""

from __future__ import annotations

import numpy as np

EULER = 0.5772156649


def expected_path(n: np.ndarray) -> np.ndarray:
    """Mean path length of an unsuccessful search among n rows."""
    n = np.asarray(n, dtype=np.float64)
    h = np.log(np.maximum(n - 1, 1)) + EULER
    return np.where(n > 2, 2 * h - 2 * (n - 1) / np.maximum(n, 1), np.where(n == 2, 1.0, 0.0))


def grow(x: np.ndarray, starts: np.ndarray, sizes: np.ndarray, trees: int, sample: int, depth: int, reach: np.ndarray, rng: np.random.Generator) -> dict:
    """Forests of the segments [start, start + size) of the rows of x (features x rows, float32, none negative)."""
    features, roots = len(x), len(starts) * trees
    width = np.minimum(sizes, sample)
    pick = (np.repeat(starts, trees)[:, None] + (rng.random((roots, sample)) * np.repeat(sizes, trees)[:, None]).astype(np.int64))
    used = np.arange(sample)[None, :] < np.repeat(width, trees)[:, None]
    tree, row = np.nonzero(used)[0], pick[used]
    node = np.zeros(len(row), dtype=np.int64)
    feature = np.zeros((depth, roots, 1 << (depth - 1)), dtype=np.int8)
    split = np.full((depth, roots, 1 << (depth - 1)), np.inf, dtype=np.float32)
    path = np.zeros((roots, 1 << depth), dtype=np.float32)
    # nodes that are cut at a level: their tree, place and box; at first the roots
    at, place = np.arange(roots), np.zeros(roots, dtype=np.int64)
    high = np.maximum(np.maximum.reduceat(x, starts, axis=1) if len(starts) else np.empty((features, 0), dtype=np.float32), reach[:, None].astype(np.float32))
    low, high = np.zeros((features, roots), dtype=np.float32), np.repeat(np.minimum(high, 4 * reach[:, None].astype(np.float32)), trees, axis=1)
    for level in range(depth):
        chosen = rng.integers(0, features, len(at))
        which = np.arange(len(at))
        a, b = low[chosen, which], high[chosen, which]
        cut = a + (b - a) * rng.random(len(at), dtype=np.float32)
        feature[level, at, place], split[level, at, place] = chosen, cut
        lookup = np.full((roots, 1 << level), -1, dtype=np.int64)
        lookup[at, place] = which
        of = lookup[tree, node]  # rows sit only in nodes that are cut
        right = x[chosen[of], row] > cut[of]
        node = 2 * node + right
        count = np.stack([np.bincount(of[~right], minlength=len(at)), np.bincount(of[right], minlength=len(at))])
        for side in (0, 1):
            ended = count[side] <= 1
            path[at[ended], (2 * place[ended] + side) << (depth - level - 1)] = level + 1
        # an ended child keeps its path at its first place; rows that reach it go on to the left, as splits are infinite there
        stay = count > 1
        new_at, new_place, new_low, new_high = [], [], [], []
        for side in (0, 1):
            k = np.flatnonzero(stay[side])
            new_at.append(at[k])
            new_place.append(2 * place[k] + side)
            lo, hi = low[:, k].copy(), high[:, k].copy()
            (hi if side == 0 else lo)[chosen[k], np.arange(len(k))] = cut[k]
            new_low.append(lo)
            new_high.append(hi)
        live = stay[right.astype(np.int64), of]
        tree, node, row = tree[live], node[live], row[live]
        at, place, low, high = np.concatenate(new_at), np.concatenate(new_place), np.concatenate(new_low, axis=1), np.concatenate(new_high, axis=1)
    leaf, count = np.unique(tree * (1 << depth) + node, return_counts=True)
    path[leaf >> depth, leaf & ((1 << depth) - 1)] = depth + expected_path(count)
    return {"depth": depth, "feature": feature, "split": split, "path": path, "trees": trees, "width": width, "sample": sample}


def score(forest: dict, x: np.ndarray, segment: np.ndarray) -> np.ndarray:
    """Anomaly score 2^(-mean path / expected path) of every row under the forest of its segment."""
    n, trees = x.shape[1], forest["trees"]
    flat, at = np.ascontiguousarray(x).ravel(), np.arange(n)
    half = forest["feature"].shape[2]
    total = np.zeros(n, dtype=np.float32)
    for t in range(trees):
        root = segment * trees + t
        node = np.zeros(n, dtype=np.int64)
        for level in range(forest["depth"]):
            place = root * half + node
            f = forest["feature"][level].ravel()[place]
            node = 2 * node + (flat[f.astype(np.int64) * n + at] > forest["split"][level].ravel()[place])
        total += forest["path"].ravel()[root * forest["path"].shape[1] + node]
    return 2.0 ** (-(total / trees) / float(expected_path(np.array(forest["sample"]))))
