"""Similarity clusters of points: parallel pivot correlation clustering over occupied cells of space.

Points are first folded into cubes whose diagonal is the similarity distance, so all points
of a cube are similar to one another and a crowd of any size is one node; of a cube at most
64 points stay as representatives (one per sub-cube). Which cubes hold similar points is
found block by block of space, with a rim of the neighbouring blocks.

Pivot clustering over that graph runs in rounds: a cube whose hash is smaller than those of
all its unassigned neighbours becomes a pivot and absorbs them. Members are then reassigned
to their closest pivot and medoids recomputed. For groups joined by chains of steps, the
pivot clusters are folded into nodes themselves and clustered again until no two of them
are linked. Where representatives cannot decide whether a step exists between two cubes,
ever smaller parts of them are compared, and at last points.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenfold.runtime import discard, join_hot, join_sized, materialize

#: Cubes per side of a block of space that one task links.
BLOCK = 16
SUB = 4
#: From here on doubles have no fractions.
WHOLE = float(1 << 52)

_HALF = np.array([(x, y, z) for x in range(-2, 3) for y in range(-2, 3) for z in range(-2, 3) if (x, y, z) > (0, 0, 0)], dtype=np.int64)


def usable_points(df: DataFrame, id: str, coord: str) -> DataFrame:
    """(id, x, y, z) of the rows with an id and three finite coordinates, each id once."""
    c = F.col(coord).cast("array<double>")
    ok = F.coalesce((F.size(c) == 3) & F.forall(c, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf"))), F.lit(False))
    return (df.where(ok & F.col(id).isNotNull()).select(F.col(id).alias("id"), c[0].alias("x"), c[1].alias("y"), c[2].alias("z"))
            .groupBy("id").agg(F.min(F.struct("x", "y", "z")).alias("p")).select("id", "p.*"))


def _floor(q: Column) -> Column:
    """Floor as a double, whatever the size."""
    return F.when(F.abs(q) < WHOLE, F.floor(q).cast("double")).otherwise(q)


def with_cubes(points: DataFrame, step: float) -> DataFrame:
    """points with cx, cy, cz, the cube they lie in, and node, its name.

    Names are unique wherever the cube lies. Beyond about 1e15, where doubles are 0.1 and
    more apart, cubes are those of the rounded coordinates.
    """
    side = step / np.sqrt(3.0)
    out = points.select("*", *[_floor(F.col(c) / side).alias(f"c{c}") for c in "xyz"])
    name = [F.when(F.abs(F.col(f"c{c}")) < WHOLE, F.col(f"c{c}").cast("bigint").cast("string")).otherwise(F.col(f"c{c}").cast("string")) for c in "xyz"]
    return out.withColumn("node", F.concat_ws(",", *name))


def _link(step: float):
    side = step / np.sqrt(3.0)
    width = BLOCK + 8  # cubes of a block, two of rim on either side, and two more to look beyond it

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        """Links among the cubes of a block and its rim: (a, b, sure)."""
        within = (pdf[["cx", "cy", "cz"]].to_numpy(np.float64) - BLOCK * np.array(key, dtype=np.float64) + 4).astype(np.int64)
        place = (within[:, 0] * width + within[:, 1]) * width + within[:, 2]
        by = np.lexsort((pdf["id"].to_numpy(), place))
        pdf, place, within = pdf.iloc[by], place[by], within[by]
        p = pdf[["x", "y", "z"]].to_numpy(np.float64)
        first = np.flatnonzero(np.r_[True, place[1:] != place[:-1]])
        cubes, count, name = place[first], np.diff(np.r_[first, len(place)]), pdf["node"].to_numpy()[first]
        core = pdf["core"].to_numpy()[first]
        complete = np.add.reduceat(pdf["m"].to_numpy(np.int64), first) == count
        # of all points of a cube, not of its representatives only
        low = np.minimum.reduceat(pdf[["lx", "ly", "lz"]].to_numpy(np.float64), first)
        high = np.maximum.reduceat(pdf[["hx", "hy", "hz"]].to_numpy(np.float64), first)
        # one representative near the middle of each cube decides most pairs
        cube = pdf[["cx", "cy", "cz"]].to_numpy(np.float64)[first]
        off = ((p - np.repeat((cube + 0.5) * side, count, axis=0)) ** 2).sum(axis=1)
        order = np.lexsort((off, np.repeat(np.arange(len(cubes)), count)))
        mid = p[order[first]]
        out_a, out_b, sure = [], [], []
        for d in _HALF:
            other = cubes + (d[0] * width + d[1]) * width + d[2]
            at = np.minimum(np.searchsorted(cubes, other), len(cubes) - 1)
            i = np.flatnonzero((cubes[at] == other) & (core | core[at]))
            j = at[i]
            # boxes further apart than a step hold no link
            gap = np.maximum(0.0, np.maximum(low[j] - high[i], low[i] - high[j]))
            near = (gap**2).sum(axis=1) <= step * step
            i, j = i[near], j[near]
            linked = ((mid[i] - mid[j]) ** 2).sum(axis=1) <= step * step
            for k in np.flatnonzero(~linked):
                a, b = p[first[i[k]]:first[i[k]] + count[i[k]]], p[first[j[k]]:first[j[k]] + count[j[k]]]
                linked[k] = (((a[:, None] - b[None]) ** 2).sum(axis=2) <= step * step).any()
            keep = linked | ~(complete[i] & complete[j])
            out_a.append(name[i[keep]])
            out_b.append(name[j[keep]])
            sure.append(linked[keep])
        return pd.DataFrame({"a": np.concatenate(out_a), "b": np.concatenate(out_b), "sure": np.concatenate(sure)})

    return run


def cube_links(points: DataFrame, step: float) -> DataFrame:
    """(a, b, sure): pairs of cubes that hold, or (sure false) may hold, two points at most `step` apart.

    `points` has id, x, y, z, cx, cy, cz, node. A block gets at most (BLOCK + 4)^3 cubes of
    at most 64 representatives, however many points there are.
    """
    side = step / np.sqrt(3.0)
    sub = [F.least(F.lit(SUB - 1), F.floor((F.col(c) / side - F.col(f"c{c}")) * SUB)).cast("int").alias(f"s{c}") for c in "xyz"]
    reps = points.select("*", *sub).groupBy("node", "cx", "cy", "cz", "sx", "sy", "sz").agg(
        F.count(F.lit(1)).alias("m"), F.min(F.struct("id", "x", "y", "z")).alias("p"),
        *[F.min(c).alias(f"l{c}") for c in "xyz"], *[F.max(c).alias(f"h{c}") for c in "xyz"])
    box = [f"{e}{c}" for e in "lh" for c in "xyz"]
    blocks = reps.select("node", "cx", "cy", "cz", "m", "p.id", "p.x", "p.y", "p.z", *box)
    for c in "xyz":  # a cube near the border of its block is in the rim of the next one too
        edge = F.array_distinct(F.array(_floor((F.col(f"c{c}") - 2) / BLOCK), _floor((F.col(f"c{c}") + 2) / BLOCK)))
        blocks = blocks.withColumn(f"b{c}", F.explode(edge))
    home = F.lit(True)
    for c in "xyz":
        home = home & (_floor(F.col(f"c{c}") / BLOCK) == F.col(f"b{c}"))
    blocks = blocks.select("bx", "by", "bz", "node", "cx", "cy", "cz", "id", "x", "y", "z", "m", *box, home.alias("core"))
    return blocks.groupBy("bx", "by", "bz").applyInPandas(_link(step), "a string, b string, sure boolean").distinct()


def pivot_rounds(edges: DataFrame, salt: int = 0) -> DataFrame:
    """(node, pivot) of every node that has an edge: parallel pivot clustering of the graph.

    `edges` has each edge in both directions as (a, b). The order of the nodes is that of
    their hashes. In each round every unassigned node that comes before all its unassigned
    neighbours is a pivot, and its unassigned neighbours join it (of several pivots, the
    first). Rounds go on until no edge between unassigned nodes is left.
    """
    order = lambda c: F.struct(F.xxhash64(F.col(c), F.lit(salt)).alias("h"), F.col(c).alias("n"))
    done, written = None, []
    live = edges.select("a", "b")
    while True:
        least = live.groupBy("a").agg(F.min(order("b")).alias("best"))
        own = least.withColumn("is_pivot", order("a") < F.col("best"))
        pivots = own.where("is_pivot").select(F.col("a").alias("pivot"))
        taken = live.join(pivots.withColumnRenamed("pivot", "b"), "b", "left_semi").groupBy("a").agg(F.min(order("b")).alias("first")).select(F.col("a").alias("node"), F.col("first.n").alias("pivot"))
        assigned = materialize(taken.unionByName(pivots.select(F.col("pivot").alias("node"), "pivot")), "assigned")
        done = assigned if done is None else done.unionByName(assigned)
        written.append(assigned)
        gone = assigned.select("node")
        rest = materialize(live.join(gone.withColumnRenamed("node", "a"), "a", "left_anti").join(gone.withColumnRenamed("node", "b"), "b", "left_anti"), "live")
        # nodes that lost all their neighbours are pivots of their own
        lone = live.select(F.col("a").alias("node")).distinct().join(gone, "node", "left_anti").join(rest.select(F.col("a").alias("node")), "node", "left_anti")
        done = done.unionByName(lone.select("node", F.col("node").alias("pivot")))
        written.append(rest)
        live = rest
        if live.isEmpty():
            out = materialize(done, "pivots")
            discard(*written)
            return out


def both_ways(edges: DataFrame) -> DataFrame:
    return edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct()


def fold_linked(assigned: DataFrame, edges: DataFrame) -> DataFrame:
    """(node, pivot) with pivots merged along edges (a, b) until no edge joins two of them.

    The clusters become nodes of a smaller graph, which is pivot-clustered in turn; every
    level leaves a fraction of the nodes.
    """
    level, spent = 0, []
    while True:
        left = assigned.select(F.col("node").alias("a"), F.col("pivot").alias("pa"))
        right = assigned.select(F.col("node").alias("b"), F.col("pivot").alias("pb"))
        e = edges.join(left, "a", "left").join(right, "b", "left").select(F.coalesce("pa", "a").alias("a"), F.coalesce("pb", "b").alias("b")).where("a <> b").distinct()
        edges = materialize(e, "folded")
        if edges.isEmpty():
            discard(edges, *spent)
            return assigned
        level += 1
        both = materialize(both_ways(edges), "both")
        tops = pivot_rounds(both, level)
        up = tops.select(F.col("node").alias("pivot"), F.col("pivot").alias("top"))
        # nodes that only the edges name, and those assigned before
        known = assigned.join(up, "pivot", "left").select("node", F.coalesce("top", "pivot").alias("pivot"))
        new = up.join(assigned.select(F.col("node").alias("pivot")), "pivot", "left_anti").select(F.col("pivot").alias("node"), F.col("top").alias("pivot"))
        last, assigned = assigned, materialize(known.unionByName(new), "assigned")
        discard(both, tops, *([last] if level > 1 else []), *spent)
        spent = [edges]


def _gap(a: str, b: str) -> Column:
    """Squared distance of two boxes."""
    out = F.lit(0.0)
    for c in "xyz":
        g = F.greatest(F.lit(0.0), F.col(f"{b}.l{c}") - F.col(f"{a}.h{c}"), F.col(f"{a}.l{c}") - F.col(f"{b}.h{c}"))
        out = out + g * g
    return out


def decide(points: DataFrame, pairs: DataFrame, step: float, levels: int = 6, block: int = 4096) -> DataFrame:
    """Of pairs (a, b) of cubes, those that do hold two points at most `step` apart.

    Cubes are cut into parts of a quarter of the side in turn; each part is known by its box
    and one of its points, however many it has. Pairs of parts whose boxes are further apart
    than a step are dropped; a pair whose two points are within a step decides its cubes.
    What is still open at the last level (parts of a 4096th of the side) is compared point by
    point, in blocks.
    """
    side = step / np.sqrt(3.0)
    square = step * step
    open_pairs = pairs.select("a", "b", F.col("a").alias("pa"), F.col("b").alias("pb"))
    nodes = materialize(pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))).distinct(), "open-nodes")
    mine = materialize(join_sized(points.select("node", "id", "x", "y", "z", "cx", "cy", "cz"), nodes, ["node"]), "open-points")
    found = None

    def part_at(level: int) -> Column:
        grid = 4**level
        return F.concat_ws("/", "node", *[F.least(F.lit(grid - 1), F.floor((F.col(c) / side - F.col(f"c{c}")) * grid)).cast("string") for c in "xyz"]) if level else F.col("node")

    for level in range(1, levels + 1):
        cells = mine.select(part_at(level - 1).alias("parent"), part_at(level).alias("part"), "id", "x", "y", "z").groupBy("parent", "part").agg(
            F.count(F.lit(1)).alias("m"), F.min(F.struct("id", "x", "y", "z")).alias("p"), *[F.min(c).alias(f"l{c}") for c in "xyz"], *[F.max(c).alias(f"h{c}") for c in "xyz"])
        side_of = lambda s: cells.select(F.col("parent").alias(f"p{s}"), F.struct("part", "m", "p", *[f"{e}{c}" for e in "lh" for c in "xyz"]).alias(f"s{s}"))
        near = open_pairs.join(side_of("a"), "pa").join(side_of("b"), "pb").where(_gap("sa", "sb") <= square)
        apart = sum(((F.col(f"sa.p.{c}") - F.col(f"sb.p.{c}")) * (F.col(f"sa.p.{c}") - F.col(f"sb.p.{c}")) for c in "xyz"), F.lit(0.0))
        near = materialize(near.select("a", "b", F.col("sa.part").alias("pa"), F.col("sb.part").alias("pb"), (apart <= square).alias("linked"), ((F.col("sa.m") == 1) & (F.col("sb.m") == 1)).alias("single")), "near-parts")
        yes = materialize(near.where("linked").select("a", "b").distinct(), "decided")
        found = yes if found is None else found.unionByName(yes)
        still = materialize(near.where("not linked and not single").select("a", "b", "pa", "pb").join(yes, ["a", "b"], "left_anti"), "open-parts")
        discard(near, *([open_pairs] if level > 1 else []))
        open_pairs = still
        if open_pairs.isEmpty():
            discard(mine, nodes, still)
            return found
    part = part_at(levels)
    sites = mine.select(part.alias("part"), "x", "y", "z").distinct()
    sizes = sites.groupBy("part").agg(F.ceil(F.count(F.lit(1)) / block).cast("bigint").alias("k"))
    p = open_pairs.join(sizes.select(F.col("part").alias("pa"), F.col("k").alias("ka")), "pa").join(sizes.select(F.col("part").alias("pb"), F.col("k").alias("kb")), "pb")

    def blocks(own: str, i: str, j: str, k_own: str, k_other: str) -> DataFrame:
        # new columns on either side: cogroup cannot tell apart those of one table
        q = sites.select(F.col("part").alias(own), *[F.col(c).alias(c) for c in "xyz"]).join(p, own)
        return q.withColumn(i, F.pmod(F.xxhash64("x", "y", "z"), F.col(k_own))).withColumn(j, F.explode(F.sequence(F.lit(0).cast("bigint"), F.col(k_other) - 1))).select("a", "b", "pa", "pb", "i", "j", "x", "y", "z")

    def compare(key: tuple, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        u, v = left[["x", "y", "z"]].to_numpy(), right[["x", "y", "z"]].to_numpy()
        hit = len(u) > 0 and len(v) > 0 and any((((u[s:s + 512, None] - v[None]) ** 2).sum(axis=2) <= square).any() for s in range(0, len(u), 512))
        return pd.DataFrame({"a": [key[0]], "b": [key[1]]}) if hit else pd.DataFrame({"a": [], "b": []})

    by = ["a", "b", "pa", "pb", "i", "j"]
    last = blocks("pa", "i", "j", "ka", "kb").groupBy(*by).cogroup(blocks("pb", "j", "i", "kb", "ka").groupBy(*by)).applyInPandas(compare, "a string, b string")
    return found.unionByName(last.distinct())


class CellClusters:
    """The clusters of one table of points: pivots of its cubes, and groups joined by chains of steps."""

    def __init__(self, df: DataFrame, id: str, coord: str, step: float = 3.0):
        self.step = step
        self.points = materialize(with_cubes(usable_points(df, id, coord), step), "points")
        self.links = materialize(cube_links(self.points, step), "links")
        self.cubes = materialize(self.points.groupBy("node").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("least")), "cubes")
        both = materialize(both_ways(self.links.where("sure")), "both")
        self.pivots = pivot_rounds(both)
        discard(both)

    def members(self) -> DataFrame:
        """(id, pivot): every point in the cluster of the closest pivot among those its cube is linked to."""
        own = self.cubes.join(self.pivots, "node", "left").select("node", F.coalesce("pivot", "node").alias("pivot"))
        heads = materialize(own.select(F.col("pivot").alias("node")).distinct(), "heads")
        # a pivot stands for the point of its cube that is closest to the cube's mean
        mean = self.points.groupBy("node").agg(F.avg("x").alias("mx"), F.avg("y").alias("my"), F.avg("z").alias("mz"), F.count(F.lit(1)).alias("n"))
        mean = materialize(mean.join(heads, "node"), "means")
        centre = join_hot(self.points, mean, "node", "n").groupBy("node").agg(
            F.min_by(F.struct("x", "y", "z"), F.struct(_square("x", "mx") + _square("y", "my") + _square("z", "mz"), F.col("id"))).alias("c"))
        near = both_ways(self.links.where("sure")).join(heads.select(F.col("node").alias("b")), "b", "left_semi").select(F.col("a").alias("node"), F.col("b").alias("pivot"))
        choice = near.unionByName(own).distinct().join(centre.select(F.col("node").alias("pivot"), "c"), "pivot")
        # a cube touches at most 124 others, so its pivots are a short list
        lists = materialize(choice.groupBy("node").agg(F.collect_list(F.struct("pivot", "c")).alias("pivots")).join(self.cubes.select("node", "n"), "node"), "choices")
        d = lambda v: (F.col("x") - v["c"]["x"]) ** 2 + (F.col("y") - v["c"]["y"]) ** 2 + (F.col("z") - v["c"]["z"]) ** 2
        best = F.array_min(F.transform("pivots", lambda v: F.struct(d(v).alias("d"), v["pivot"].alias("pivot"))))["pivot"]
        return join_hot(self.points.select("node", "id", "x", "y", "z"), lists, "node", "n").select("id", best.alias("pivot"), "x", "y", "z")

    def clusters(self, typical: int = 3) -> DataFrame:
        """(pivot, size, medoid ids, ..): each cluster with its size and most typical members."""
        return describe(self.members().withColumnRenamed("pivot", "cluster"), typical)

    def groups(self, least: int = 5) -> DataFrame:
        """(root_id, id): points in groups of at least `least` joined by chains of steps; the root is the smallest id."""
        top = fold_linked(self.pivots, self.links.where("sure"))
        of = self.cubes.join(top, "node", "left").select("node", F.coalesce("pivot", "node").alias("pivot"))
        open_pairs = self.links.where("not sure").select("a", "b") \
            .join(of.select(F.col("node").alias("a"), F.col("pivot").alias("pa")), "a").join(of.select(F.col("node").alias("b"), F.col("pivot").alias("pb")), "b").where("pa <> pb").select("a", "b")
        open_pairs = materialize(open_pairs, "open")
        spent = [top, open_pairs]
        if not open_pairs.isEmpty():
            more, tops = materialize(decide(self.points, open_pairs, self.step), "decided"), materialize(of, "tops")
            last = fold_linked(tops, more)
            spent += [more, tops, last]
            of = self.cubes.join(last, "node", "left").select("node", F.coalesce("pivot", "node").alias("pivot"))
        of = materialize(self.cubes.join(of, "node"), "cube-tops")
        discard(*(t for t in spent if t is not self.pivots))
        roots = materialize(of.groupBy("pivot").agg(F.sum("n").alias("size"), F.min("least").alias("root_id")).where(F.col("size") >= least).select("pivot", "root_id"), "roots")
        labels = materialize(of.join(roots, "pivot").select("node", "n", "root_id"), "labels")
        discard(of, roots)
        return join_hot(self.points.select("node", "id"), labels, "node", "n").select("root_id", "id")


def _square(a: str, b: str) -> Column:
    return (F.col(a) - F.col(b)) * (F.col(a) - F.col(b))


def describe(members: DataFrame, typical: int = 3) -> DataFrame:
    """(cluster, size, typical): of members (cluster, id, x, y, z) the size and the ids closest to the mean, closest first."""
    mean = members.groupBy("cluster").agg(F.count(F.lit(1)).alias("size"), F.avg("x").alias("mx"), F.avg("y").alias("my"), F.avg("z").alias("mz"))
    away = members.join(mean, "cluster").select("cluster", "id", F.sqrt(_square("x", "mx") + _square("y", "my") + _square("z", "mz")).alias("d"))
    best = away
    picks = None
    for _ in range(typical):  # each of the few rounds is a partial aggregation, so a huge cluster is never sorted in one task
        one = best.groupBy("cluster").agg(F.min(F.struct("d", "id")).alias("m"))
        one = materialize(one.select("cluster", F.col("m.d").alias("d"), F.col("m.id").alias("id")), "typical")
        picks = one if picks is None else picks.unionByName(one)
        best = best.join(one.select("cluster", F.col("d").alias("ld"), F.col("id").alias("lid")), "cluster").where("d > ld or (d = ld and id > lid)").select("cluster", "id", "d")
    typical_ids = picks.groupBy("cluster").agg(F.transform(F.array_sort(F.collect_list(F.struct("d", "id"))), lambda s: s["id"]).alias("typical"))
    return mean.select("cluster", "size").join(typical_ids, "cluster")


__all__ = ["CellClusters", "both_ways", "cube_links", "decide", "describe", "fold_linked", "pivot_rounds", "usable_points", "with_cubes"]
