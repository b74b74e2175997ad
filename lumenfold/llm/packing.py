"""Filling containers of fixed capacity with documents.

The plan for one capacity depends only on the histogram of item sizes (at most `capacity`
numbers, whatever the number of documents). Lengths are put into bins of about as many
documents each; patterns of a few lengths, each taken once or many times, with a last
length that closes the container are enumerated, and their repeat counts fitted to the
histogram by non-negative least squares, weighted by length. Rounded counts are then filled with
actual lengths, the last one being the largest that fits. This is repeated for what
rounding has left, and the rest is packed best fit first, in counts, into the gaps and into
further containers. Documents are then given ranks within their length, from counts per
(length, hash bucket), so no length gathers in one task, and look up their container in
the plan.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lumenfold.llm.tokens import TOKENIZER_DIR, encode
from lumenfold.runtime import materialize

#: Bins of lengths at most, rounds of fitting at most, and the shares of a container that a pattern of bins, and one of lengths, may leave empty.
PATTERN_BINS, PATTERN_ROUNDS, GAP, LAST_GAP = 256, 12, 1 / 64, 1 / 1024


def length_bins(left: np.ndarray, most: int = PATTERN_BINS) -> list[np.ndarray]:
    """The lengths that are there, in runs of neighbours of about as many documents each; at most about `most` runs."""
    sizes = np.flatnonzero(left)
    if len(sizes) <= most:
        return [sizes[k:k + 1] for k in range(len(sizes))]
    ahead = np.cumsum(left[sizes]) - left[sizes]
    # a run ends after its share of the documents, or where lengths double in 32 steps
    by_number = ahead * most // (2 * int(left.sum()))
    by_length = (np.log2(sizes) * (most / 2 / np.log2(sizes[-1] + 1))).astype(np.int64)
    edge = np.flatnonzero(np.r_[True, (np.diff(by_number) > 0) | (np.diff(by_length) > 0)])
    return np.split(sizes, edge[1:])


def patterns(b: np.ndarray, whole: int) -> np.ndarray:
    """Ways to fill `whole` with a few of the ascending lengths b: rows (i, m, j, n, k), places in b with their numbers of times.

    m x b[i] + n x b[j] + b[k], where k is the longest that closes what is left, or -1 for none. i
    and j go through all pairs, m through all numbers up to 3 and quarters of the most that fit.
    """
    one = np.arange(len(b))
    i, j = (g.ravel() for g in np.meshgrid(one, np.r_[-1, one], indexing="ij"))
    pair = (j < i)
    i, j = i[pair], j[pair]
    out = []
    most = whole // b[i]
    for m in (1, 2, 3, most // 4, most // 2, most * 3 // 4, most):
        ok = (m >= 1) & (m <= most)
        bi, bj = i[ok], j[ok]
        mm = np.broadcast_to(m, i.shape)[ok]
        rest = whole - mm * b[bi]
        fit = np.where(bj >= 0, rest // b[np.maximum(bj, 0)], 0)
        for n in (0, 1, 2, fit - 1, fit):
            n = np.broadcast_to(n, fit.shape)
            good = np.where(bj < 0, n == 0, (n >= 1) & (n <= fit))
            gi, gm, gj, gn = bi[good], mm[good], bj[good], n[good]
            space = whole - gm * b[gi] - np.where(gj >= 0, gn * b[np.maximum(gj, 0)], 0)
            k = np.searchsorted(b, space, side="right") - 1
            k = np.where(space == 0, -1, k)
            full = space - np.where(k >= 0, b[np.maximum(k, 0)], 0) <= whole * GAP
            out.append(np.stack([gi, gm, gj, gn, k], axis=1)[full])
    found = np.concatenate(out) if out else np.empty((0, 5), dtype=np.int64)
    base, key = (len(b), whole + 1, len(b) + 1, whole + 1, len(b) + 1), np.zeros(len(found), dtype=np.int64)
    for c, (size, plus) in enumerate(zip(base, (0, 0, 1, 0, 1))):
        key = key * size + found[:, c] + plus
    return found[np.unique(key, return_index=True)[1]]


def fit_counts(p: np.ndarray, h: np.ndarray, b: np.ndarray, rounds: int = 300) -> np.ndarray:
    """x >= 0 that makes the summed patterns fit the histogram h of lengths b least squares, weighted by length: accelerated projected gradient."""
    parts = [(p[:, 0], p[:, 1]), (np.maximum(p[:, 2], 0), p[:, 3] * (p[:, 2] >= 0)), (np.maximum(p[:, 4], 0), (p[:, 4] >= 0).astype(np.int64))]
    target = h * b.astype(np.float64)
    # columns of length 1 make the step the same for short and long patterns
    norm = np.sqrt(sum((m * b[at]) ** 2.0 for at, m in parts))
    parts = [(at, m * b[at] / norm) for at, m in parts]
    used = lambda x: sum(np.bincount(at, x * w, len(b)) for at, w in parts)
    back = lambda r: sum(r[at] * w for at, w in parts)
    v, step = np.ones(len(p)), 1.0
    for _ in range(12):  # the largest eigenvalue of the normal matrix bounds the step
        v = back(used(v))
        step = float(np.linalg.norm(v))
        v /= max(step, 1e-12)
    step *= 1.1
    x = y = np.zeros(len(p))
    t = 1.0
    for _ in range(rounds):
        new = np.maximum(0.0, y - back(used(y) - target) / step)
        t_new = (1 + np.sqrt(1 + 4 * t * t)) / 2
        y = new + (t - 1) / t_new * (new - x)
        x, t = new, t_new
    return x / norm


#: Of what is left a round fits this share, and rounds end when this share of all is left: a like mixture of lengths packs best into the gaps.
FIT, LEAVE = 0.83, 0.185


@dataclass
class Plan:
    """Segments of the items of each size, sorted: item ranks [first, first + count) of a size go `mult` to a container from `base` on, at `offset`; `fitted` where a fitted pattern put them there."""

    capacity: int
    size: np.ndarray
    first: np.ndarray
    mult: np.ndarray
    base: np.ndarray
    offset: np.ndarray
    fitted: np.ndarray
    containers: int


def plan_packing(hist: np.ndarray, capacity: int) -> Plan:
    """Containers for hist[s] items of each size s in 1..capacity."""
    left = hist.astype(np.int64).copy()
    left[0] = 0
    groups: list[tuple[int, list[tuple[int, int, bool]]]] = []  # (number of containers, [(size, items in each, fitted)])
    open_by_space: dict[int, list[tuple[int, list[tuple[int, int, bool]]]]] = {}

    def keep(number: int, items: list[tuple[int, int, bool]]) -> None:
        space = capacity - sum(s * m for s, m, _ in items)
        if space:
            open_by_space.setdefault(space, []).append((number, items))
        else:
            groups.append((number, items))

    whole = int(left.sum())
    for _ in range(PATTERN_ROUNDS):
        if _place(left, capacity, keep) < 0.02 * left.sum() or left.sum() <= LEAVE * whole:
            break
    # best fit of what is left, largest sizes first, in counts
    spaces = sorted(open_by_space)
    import bisect

    for s in np.flatnonzero(left)[::-1].tolist():
        c = int(left[s])
        while c:
            at = bisect.bisect_left(spaces, s)
            if at == len(spaces):
                each = capacity // s
                number = c // each
                if number:
                    spare = capacity - each * s
                    entry = (number, [(s, each, False)])
                    if spare:
                        if spare not in open_by_space:
                            bisect.insort(spaces, spare)
                        open_by_space.setdefault(spare, []).append(entry)
                    else:
                        groups.append(entry)
                    c -= number * each
                if c:
                    spare = capacity - c * s
                    if spare not in open_by_space:
                        bisect.insort(spaces, spare)
                    open_by_space.setdefault(spare, []).append((1, [(s, c, False)]))
                    c = 0
                continue
            space = spaces[at]
            number, items = open_by_space[space].pop()
            if not open_by_space[space]:
                del open_by_space[space]
                spaces.pop(at)
            each = min(space // s, c)
            full = min(number, c // each)
            if number > full:
                if space not in open_by_space:
                    bisect.insort(spaces, space)
                open_by_space.setdefault(space, []).append((number - full, items))
            spare = space - each * s
            entry = (full, [*items, (s, each, False)])
            if spare:
                if spare not in open_by_space:
                    bisect.insort(spaces, spare)
                open_by_space.setdefault(spare, []).append(entry)
            else:
                groups.append(entry)
            c -= full * each
    for entries in open_by_space.values():
        groups += entries
    rows, base = [], 0
    used = np.zeros(capacity + 1, dtype=np.int64)
    for number, items in groups:
        offset = 0
        for s, m, fitted in items:
            rows.append((s, int(used[s]), m, base, offset, fitted))
            used[s] += number * m
            offset += s * m
        base += number
    cols = np.array(rows, dtype=np.int64).reshape(-1, 6)
    cols = cols[np.lexsort((cols[:, 1], cols[:, 0]))]
    return Plan(capacity, *(np.ascontiguousarray(c) for c in cols.T), containers=base)


def _closing(left: np.ndarray, taken: dict[int, int], space: int) -> list[int]:
    """One or two lengths (of which some are left beside those taken) that fill `space` exactly, else the largest that fit."""
    if space <= 0:
        return []
    free = left[: space + 1].copy()
    for s, c in taken.items():
        if s <= space:
            free[s] -= c
    free[0] = 0
    if free[space] > 0:
        return [space]
    pair = np.minimum(free, free[::-1])
    if space % 2 == 0:
        pair[space // 2] //= 2
    if pair.any():  # the one with the longest length: short ones are easier to place later
        s = int(np.flatnonzero(pair)[-1])
        return [s, space - s]
    there = np.flatnonzero(free > 0)
    if not len(there):
        return []
    s = int(there[-1])
    free[s] -= 1
    there = np.flatnonzero(free[: space - s + 1] > 0)
    return [s, int(there[-1])] if len(there) else [s]


def _place(left: np.ndarray, capacity: int, keep) -> int:
    """Fit patterns to left[s] items of each size s and fill them; the items placed, which are taken from `left`."""
    bins = length_bins(left, max(PATTERN_BINS // 2, min(PATTERN_BINS, 131_072 // capacity)))
    if not bins:
        return 0
    h = np.array([left[x].sum() for x in bins], dtype=np.float64)
    b = np.array([round(float((x * left[x]).sum() / left[x].sum())) for x in bins], dtype=np.int64)
    p = patterns(b, capacity)
    if not len(p):
        return 0
    x = fit_counts(p, h * FIT, b)
    # error is carried from pattern to like pattern, so many small counts add up to whole ones
    room = int((np.arange(len(left)) * left).sum()) // capacity
    ahead = np.floor(np.cumsum(x[::-1]) + 0.5).astype(np.int64)
    repeats = np.diff(np.r_[0, ahead])[::-1]
    placed = 0

    def draw(taken: dict[int, int], sizes: np.ndarray, m: int) -> bool:
        for s in sizes[np.argsort(-left[sizes], kind="stable")].tolist():
            t = min(m, int(left[s]) - taken.get(s, 0))
            if t > 0:
                taken[s] = taken.get(s, 0) + t
                m -= t
            if not m:
                return True
        return False

    for at in np.flatnonzero(repeats)[::-1].tolist():  # longest lengths first
        i, m, j, n, k = p[at].tolist()
        repeat = min(int(repeats[at]), room)
        while repeat > 0:
            taken: dict[int, int] = {}
            if not draw(taken, bins[i], m) or (j >= 0 and not draw(taken, bins[j], n)):
                break
            space = capacity - sum(s * c for s, c in taken.items())
            if space < 0:  # the drawn lengths are above their bins' means: one less of the shortest
                s = min(taken)
                taken[s] -= -(-(-space) // s)
                if taken[s] < 0:
                    break
                taken = {s: c for s, c in taken.items() if c}
                space = capacity - sum(s * c for s, c in taken.items())
            for s in _closing(left, taken, space):
                taken[s] = taken.get(s, 0) + 1
                space -= s
            if space > capacity * LAST_GAP or not taken:
                break
            number = min(repeat, *(int(left[s]) // c for s, c in taken.items()))
            if number < 1:
                break
            for s, c in taken.items():
                left[s] -= number * c
                placed += number * c
            keep(number, [(s, c, True) for s, c in sorted(taken.items(), reverse=True)])
            repeat -= number
            room -= number
    return placed


def ranked_sizes(sizes: DataFrame, id: str, per_bucket: int = 100_000) -> DataFrame:
    """(id, n_tokens, rank): the rank of every document among those of its length, from 0, without gaps."""
    total = sizes.count()
    buckets = max(1, -(-total // per_bucket))
    rows = sizes.withColumn("bucket", F.pmod(F.xxhash64(id), F.lit(buckets)))
    counts = rows.groupBy("n_tokens", "bucket").agg(F.count(F.lit(1)).alias("m"))
    before = Window.partitionBy("n_tokens").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("n_tokens", "bucket", F.coalesce(F.sum("m").over(before), F.lit(0)).alias("start"))
    own = F.row_number().over(Window.partitionBy("n_tokens", "bucket").orderBy(id)) - 1
    return rows.withColumn("own", own).join(starts, ["n_tokens", "bucket"]).select(id, "n_tokens", (F.col("start") + F.col("own")).alias("rank"))


def pack_documents(df: DataFrame, id: str, text: str, limits: list[tuple[int, int]], tokenizer: str, folder: str = TOKENIZER_DIR) -> DataFrame:
    """(limit_id, id, piece, container_id, start_token, n_tokens, offset, fitted) for every (limit_id, capacity) of `limits`.

    A document of more tokens than the capacity is cut into pieces of exactly the capacity
    and a rest, the only split there is; every piece has its own row. start_token is the
    piece's place in the document, offset its place in the container, fitted whether a fitted
    pattern put it there (no full piece is). Documents without
    tokens (null or empty text) do not come out. Container ids count from 0 per limit.
    The histogram of lengths is collected: one row per distinct length, at most as many as
    the longest document has tokens.
    """
    sizes = materialize(encode(df, id, text, tokenizer, folder, counts_only=True).where("n_tokens > 0"), "sizes")
    counts = {int(n): int(m) for n, m in sizes.groupBy("n_tokens").count().collect()}
    lengths = np.array(sorted(counts), dtype=np.int64)
    number = np.array([counts[n] for n in lengths.tolist()], dtype=np.int64)
    work = []
    for limit_id, capacity in sorted(limits):
        rest = np.where(lengths > capacity, lengths % capacity, lengths)
        hist = np.bincount(rest, number, capacity + 1).astype(np.int64)
        plan = plan_packing(hist, capacity)
        order = np.lexsort((lengths, rest))
        offset = np.empty(len(lengths), dtype=np.int64)
        ahead = np.cumsum(number[order]) - number[order]
        # of every rest the first length starts at 0
        group = np.flatnonzero(np.r_[True, rest[order][1:] != rest[order][:-1]]) if len(order) else order
        offset[order] = ahead - np.repeat(ahead[group], np.diff(np.r_[group, len(order)]))
        full = np.where(lengths > capacity, lengths // capacity, 0)
        full_start = plan.containers + np.cumsum(number * full) - number * full
        work.append((int(limit_id), capacity, plan, rest, offset, full, full_start))

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            n, rank, ident = pdf["n_tokens"].to_numpy(np.int64), pdf["rank"].to_numpy(np.int64), pdf[id].to_numpy()
            at = np.searchsorted(lengths, n)
            for limit_id, capacity, plan, rest, offset, full, full_start in work:
                size, item, whole = rest[at], offset[at] + rank, full[at]
                has = size > 0
                key = plan.size * (1 << 40) + plan.first
                seg = np.searchsorted(key, size[has] * (1 << 40) + item[has], side="right") - 1
                nth = item[has] - plan.first[seg]
                yield pd.DataFrame({"limit_id": limit_id, id: ident[has], "piece": whole[has], "container_id": plan.base[seg] + nth // plan.mult[seg],
                                    "start_token": whole[has] * capacity, "n_tokens": size[has], "offset": plan.offset[seg] + nth % plan.mult[seg] * size[has], "fitted": plan.fitted[seg] > 0})
                if whole.any():
                    row = np.repeat(np.arange(len(n)), whole)
                    piece = np.arange(len(row)) - np.repeat(np.cumsum(whole) - whole, whole)
                    yield pd.DataFrame({"limit_id": limit_id, id: ident[row], "piece": piece, "container_id": full_start[at][row] + rank[row] * whole[row] + piece,
                                        "start_token": piece * capacity, "n_tokens": capacity, "offset": 0, "fitted": False})

    schema = f"limit_id int, {id} {df.schema[id].dataType.simpleString()}, piece bigint, container_id bigint, start_token bigint, n_tokens bigint, offset bigint, fitted boolean"
    return ranked_sizes(sizes, id).mapInPandas(place, schema)


def packing_report(packed: DataFrame, limits: DataFrame) -> DataFrame:
    """Per limit: containers, tokens, the least number of containers any packing needs at least, fill, overfull containers, share of the items below the capacity that fitted patterns placed."""
    partial = F.col("n_tokens") < F.col("capacity_tokens")
    packed = packed.join(F.broadcast(limits.select("limit_id", "capacity_tokens")), "limit_id")
    by = packed.groupBy("limit_id", "capacity_tokens", "container_id").agg(F.sum("n_tokens").alias("t"), F.count_if(partial).alias("items"), F.count_if(partial & F.col("fitted")).alias("by_pattern"))
    out = by.groupBy("limit_id", "capacity_tokens").agg(
        F.count(F.lit(1)).alias("containers"), F.sum("t").alias("tokens"), F.count_if(F.col("t") > F.col("capacity_tokens")).alias("overfull"),
        F.round(F.sum("by_pattern") / F.sum("items"), 6).alias("fitted_share"))
    return out.withColumn("at_least", F.ceil(F.col("tokens") / F.col("capacity_tokens"))).withColumn("fill", F.round(F.col("tokens") / F.col("containers") / F.col("capacity_tokens"), 6))
