"""Trees of boxes over points in Morton order, for questions about distances between all points.

Points are sorted along a Morton curve and cut into leaves of BLOCK, so leaves are small where
points are dense and wide where they are rare. FAN nodes make one of the next level. A node
tells the number, box, mean and central second moments of its points. Whoever asks is a leaf:
it is shown the top nodes, opens those that it cannot settle, and so descends level by level,
one join and one job for each; the number of levels is the logarithm of the number of points.

k_nearest() keeps an upper bound for each point: the nearest points of its own leaf, then the
far corners of the boxes it is shown. A node further away than that is settled for the point.

sums() settles a node for a leaf by the expansion of the distance about the node's mean up to
second order. What is left out is at most BEND / 6 times the sum of cubes of the distances to
the mean, over the squared distance of the boxes; BEND bounds the third derivative of a distance
1 away. The node is opened if that exceeds `tolerance` times its points' distances, so a
tolerance of 0 gives exact sums. Clusters do not share a leaf, and a node of several is opened.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from strata.operators.transfer import with_rows
from strata.session import removed, written

BLOCK, FAN = 512, 64
BEND = 2 / math.sqrt(3)
#: Distances computed at once, and what rounding may do to a bound.
AT_ONCE, SLACK = 1 << 20, 1 + 1e-9


class Nodes:
    """Nodes of one level as arrays; s holds number, box, mean and second moments of each."""

    def __init__(self, ids: np.ndarray, c: np.ndarray, s: np.ndarray, dims: int):
        self.ids, self.c, self.n = ids, c, s[:, 0]
        self.lo, self.hi, self.mean = (s[:, 1 + k * dims : 1 + (k + 1) * dims] for k in range(3))
        self.second = s[:, 1 + 3 * dims :].reshape(-1, dims, dims)

    @classmethod
    def of(cls, nodes: pa.Array, dims: int) -> Nodes:
        s = nodes.field("s").flatten().to_numpy().reshape(len(nodes), -1)
        return cls(nodes.field("id").to_numpy(), nodes.field("c").to_numpy(zero_copy_only=False), s, dims)


class Leaf:
    """The points of a leaf: places in the order, numbers of copies, coordinates."""

    def __init__(self, row: dict, dims: int, end: str = ""):
        self.id, self.c = row[f"id{end}"].as_py(), row[f"c{end}"].as_py()
        self.places, self.copies = (np.frombuffer(row[f"{name}{end}"].as_py(), np.int64) for name in ("places", "copies"))
        self.x = np.frombuffer(row[f"xs{end}"].as_py()).reshape(-1, dims)


def rows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        for r in range(batch.num_rows):
            yield {name: batch.column(name)[r] for name in batch.schema.names}


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.sqrt(sum((a[:, None, j] - b[None, :, j]) ** 2 for j in range(a.shape[1])))


def to_boxes(x: np.ndarray, nodes: Nodes, far: bool) -> np.ndarray:
    """The largest (far) or smallest distance of each point to the points of each box."""
    lo, hi = (x[:, None, :] - nodes.lo[None]), (nodes.hi[None] - x[:, None, :])
    side = np.maximum(lo, hi) if far else np.maximum(np.maximum(-lo, -hi), 0)
    return np.sqrt((side * side).sum(2))


def moments(n: np.ndarray, lo: np.ndarray, hi: np.ndarray, mean: np.ndarray, second: np.ndarray | float) -> list[float]:
    """s of the union of parts."""
    total = n.sum()
    m = (n[:, None] * mean).sum(0) / total
    off = mean - m
    return np.concatenate([[total], lo.min(0), hi.max(0), m, (n[:, None, None] * off[:, :, None] * off[:, None, :] + second).sum(0).ravel()]).tolist()


@dataclass
class Tree:
    placed: DataFrame  # the points with their places
    leaves: DataFrame  # id, c, places, copies, xs
    levels: list[DataFrame]  # id, c, s and parent, from the leaves up
    top: Nodes  # of the last level
    dims: int

    def shown(self, asked: DataFrame, level: int, *state: str) -> DataFrame:
        """The leaves that ask (id, node and state), with the children of their nodes."""
        children = self.levels[level].select(F.col("parent").alias("node"), F.struct("id", "c", "s").alias("one"))
        lists = asked.select("id", "node").join(children, "node").groupBy("id").agg(F.collect_list("one").alias("nodes"))
        if state:
            lists = lists.join(asked.select("id", *state).dropDuplicates(["id"]), "id")
        return self.leaves.join(lists, "id")


def morton(x: Column, lo: list[float], width: float) -> Column:
    """A point's place on the curve; ties are left to the caller."""
    axes = min(len(lo), 62)
    bits = min(62 // axes, 31)
    cells = [F.least(F.floor((x[j] - lo[j]) / width * float(1 << bits)), F.lit((1 << bits) - 1)).cast("long") for j in range(axes)]
    terms = [F.shiftleft(F.shiftright(F.col("_cells")[j], b).bitwiseAND(F.lit(1).cast("long")), b * axes + j) for b in range(bits) for j in range(axes)]
    return F.array(*cells), functools.reduce(Column.bitwiseOR, terms)


def tree(points: DataFrame) -> Tree | None:
    """The tree of points (x, copies, c); none of an empty table."""
    first = points.first()
    if first is None:
        return None
    dims = len(first["x"])
    ends = points.agg(F.count(F.lit(1)).alias("n"), *[f(F.col("x")[j]).alias(f"{f.__name__}{j}") for j in range(dims) for f in (F.min, F.max)]).first()
    lo = [ends[f"min{j}"] for j in range(dims)]
    width = max(ends[f"max{j}"] - ends[f"min{j}"] for j in range(dims)) or 1.0
    cells, code = morton(F.col("x"), lo, width)
    placed = with_rows(points.withColumn("_cells", cells).withColumn("_code", code).drop("_cells"), ["c", "_code", "x"], "place")
    lists = placed.groupBy("c", F.expr(f"place div {BLOCK}").alias("block")).agg(F.collect_list(F.struct("place", "copies", "x")).alias("points"))

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in rows_of(batches):
            p = row["points"].values
            places, copies, x = p.field("place").to_numpy(), p.field("copies").to_numpy(), p.field("x").flatten().to_numpy().reshape(-1, dims)
            s = moments(copies.astype(float), x, x, x, 0.0)
            blobs = [pa.array([np.ascontiguousarray(v).tobytes()], pa.binary()) for v in (places, copies, x)]
            yield pa.record_batch([pa.array([int(places.min())], pa.int64()), pa.array([row["c"].as_py()], pa.string()), *blobs, pa.array([s], pa.list_(pa.float64()))], ["id", "c", "places", "copies", "xs", "s"])

    def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in rows_of(batches):
            one = Nodes.of(row["nodes"].values, dims)
            c = one.c[0] if len(set(one.c.tolist())) == 1 else None
            s = moments(one.n, one.lo, one.hi, one.mean, one.second)
            yield pa.record_batch([pa.array([row["parent"].as_py()], pa.int64()), pa.array([c], pa.string()), pa.array([s], pa.list_(pa.float64()))], ["id", "c", "s"])

    leaves = written(lists.mapInArrow(packed, "id long, c string, places binary, copies binary, xs binary, s array<double>"), "leaves")
    span = BLOCK * FAN
    levels = [leaves.select("id", "c", "s", F.expr(f"id div {span}").alias("parent"))]
    while ends["n"] > span:
        up = levels[-1].groupBy("parent").agg(F.collect_list(F.struct("id", "c", "s")).alias("nodes"))
        up = written(up.mapInArrow(merged, "id long, c string, s array<double>"), "nodes")
        levels.append(up.withColumn("parent", F.expr(f"id div {FAN}")))
        span *= FAN
    top = levels[-1].select(F.struct("id", "c", "s").alias("one")).toArrow().column("one").combine_chunks()  # FAN nodes, or a leaf for each of at most BLOCK x FAN points
    return Tree(placed, leaves.drop("s"), levels, Nodes.of(top, dims), dims)


def nearby(leaf: Leaf, k: int) -> np.ndarray:
    """Upper bounds for the distances to the k-th neighbours, by the leaf's own points."""
    d = distances(leaf.x, leaf.x)
    np.fill_diagonal(d, np.inf)
    need = np.minimum(k - (leaf.copies - 1), len(d))
    return np.where(need <= 0, 0.0, np.sort(d, 1)[np.arange(len(d)), np.maximum(need - 1, 0)])


def narrowed(x: np.ndarray, bound: np.ndarray, nodes: Nodes, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Bounds made smaller by the nodes' far corners, and whether each node can have one of the k nearest of each point."""
    bound, open_ = bound.copy(), np.zeros((len(x), len(nodes.ids)), bool)
    step = max(1, AT_ONCE // len(nodes.ids))
    for i in range(0, len(x), step):
        far = to_boxes(x[i : i + step], nodes, True)
        order = np.argsort(far, 1)
        enough = np.cumsum(nodes.n[order], 1) > k  # the point itself is in some node
        at = enough.argmax(1)
        reach = np.where(enough.any(1), far[np.arange(len(far)), order[np.arange(len(far)), at]], np.inf)
        bound[i : i + step] = np.minimum(bound[i : i + step], reach)
        open_[i : i + step] = to_boxes(x[i : i + step], nodes, False) <= bound[i : i + step, None] * SLACK
    return bound, open_


def k_nearest(found: Tree, k: int) -> DataFrame:
    """place and d, the distance to the k-th neighbour; copies of a point count as neighbours, a point itself does not."""
    dims, top, lowest = found.dims, found.top, len(found.levels) - 1

    def descend(at_leaves: bool, first: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for row in rows_of(batches):
                leaf = Leaf(row, dims)
                nodes = top if first else Nodes.of(row["nodes"].values, dims)
                bound, open_ = narrowed(leaf.x, nearby(leaf, k) if first else np.frombuffer(row["bound"].as_py()), nodes, k)
                kept = np.flatnonzero(open_.any(0))
                if not at_leaves:
                    yield pa.record_batch([pa.array([leaf.id] * len(kept), pa.int64()), pa.array(nodes.ids[kept]), pa.array([bound.tobytes()] * len(kept), pa.binary())], ["id", "node", "bound"])
                    continue
                for j in kept.tolist():
                    some = open_[:, j]
                    blobs = [pa.array([np.ascontiguousarray(v[some]).tobytes()], pa.binary()) for v in (leaf.places, leaf.copies, leaf.x, bound)]
                    yield pa.record_batch([pa.array([int(nodes.ids[j])], pa.int64()), *blobs], ["id", "places_q", "copies_q", "xs_q", "bound"])

        return run

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in rows_of(batches):
            leaf = Leaf(row, dims)
            places, x, bound = np.frombuffer(row["places_q"].as_py(), np.int64), np.frombuffer(row["xs_q"].as_py()).reshape(-1, dims), np.frombuffer(row["bound"].as_py())
            d = distances(x, leaf.x)
            copies = leaf.copies[None, :] - (places[:, None] == leaf.places[None, :])
            near = (d <= bound[:, None] * SLACK) & (copies > 0)
            if d.shape[1] > k + 1:  # of so many places at least k are others
                near &= d <= np.partition(d, k, 1)[:, k, None]
            i, j = np.nonzero(near)
            yield pa.record_batch([pa.array(places[i]), pa.array(d[i, j]), pa.array(copies[i, j])], ["place", "d", "copies"])

    asked = None
    for level in range(lowest, -1, -1):
        rows = found.leaves if asked is None else found.shown(asked, level, "bound")
        schema = "id long, places_q binary, copies_q binary, xs_q binary, bound binary" if level == 0 else "id long, node long, bound binary"
        before, asked = asked, written(rows.mapInArrow(descend(level == 0, asked is None), schema), "asked")
        if before is not None:
            removed(before)
    near = asked.join(found.leaves, "id").mapInArrow(measure, "place long, d double, copies long")
    total = F.sum("copies").over(Window.partitionBy("place").orderBy("d").rangeBetween(Window.unboundedPreceding, Window.currentRow))
    return near.withColumn("total", total).where(F.col("total") >= k).groupBy("place").agg(F.min("d").alias("d"))


def expanded(leaf: Leaf, nodes: Nodes, tolerance: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Which nodes the expansion settles; for those the sum of distances of each point, and the bound of its error."""
    gap = np.maximum(np.maximum(nodes.lo - leaf.x.max(0), leaf.x.min(0) - nodes.hi), 0)
    apart = np.sqrt((gap * gap).sum(1))
    spread = np.trace(nodes.second, axis1=1, axis2=2)
    reach = np.sqrt((np.maximum(nodes.hi - nodes.mean, nodes.mean - nodes.lo) ** 2).sum(1))
    left_out = BEND / 6 * spread * reach
    one = np.array([c is not None for c in nodes.c])
    settled = one & (((apart > 0) & (left_out <= tolerance * nodes.n * apart**3)) | (spread == 0))
    n, mean, second, spread = nodes.n[settled], nodes.mean[settled], nodes.second[settled], spread[settled]
    off = [leaf.x[:, None, j] - mean[None, :, j] for j in range(mean.shape[1])]
    r = np.sqrt(sum(v * v for v in off))
    safe = np.where(r > 0, r, 1.0)
    along = sum(u * v * second[None, :, i, j] for i, u in enumerate(off) for j, v in enumerate(off)) / safe**2
    s = n * r + np.where(spread > 0, (spread - along) / safe / 2, 0.0)
    return settled, s, np.where(spread > 0, left_out[settled] / np.where(apart > 0, apart, 1.0)[settled] ** 2, 0.0)


TOLD = ["id", "node", "i", "ci", "cj", "s", "e", "n"]


def told(leaf: Leaf, cj: str, s: np.ndarray, e: float, n: float) -> pa.RecordBatch:
    m = len(leaf.places)
    parts = [pa.nulls(m, pa.int64()), pa.nulls(m, pa.int64()), pa.array(leaf.places), pa.array([leaf.c] * m, pa.string()), pa.array([cj] * m, pa.string()), pa.array(s), pa.array(np.full(m, float(e))), pa.array(np.full(m, float(n)))]
    return pa.record_batch(parts, TOLD)


def sums(found: Tree, tolerance: float = 0.0) -> DataFrame:
    """i (place), ci, cj, s, e and n: the sum of each point's distances to cluster cj, within e, and that cluster's size; copies count each."""
    dims, top = found.dims, found.top
    schema = "id long, node long, i long, ci string, cj string, s double, e double, n double"

    def descend(first: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for row in rows_of(batches):
                leaf, nodes = Leaf(row, dims), top if first else Nodes.of(row["nodes"].values, dims)
                by: dict[str, list] = {}
                for i in range(0, len(nodes.ids), 1024):
                    part = slice(i, i + 1024)
                    some = Nodes.__new__(Nodes)
                    some.__dict__ = {name: v[part] for name, v in vars(nodes).items()}
                    settled, s, e = expanded(leaf, some, tolerance)
                    for cj in set(some.c[settled].tolist()):
                        at = np.flatnonzero(some.c[settled] == cj)
                        one = by.setdefault(cj, [0.0, 0.0, 0.0])
                        one[0], one[1], one[2] = one[0] + s[:, at].sum(1), one[1] + e[at].sum(), one[2] + some.n[settled][at].sum()
                    m = int((~settled).sum())
                    rest = [pa.nulls(m, pa.int64()), pa.nulls(m, pa.string()), pa.nulls(m, pa.string()), *[pa.nulls(m, pa.float64())] * 3]
                    yield pa.record_batch([pa.array([leaf.id] * m, pa.int64()), pa.array(some.ids[~settled]), *rest], TOLD)
                for cj, (s, e, n) in by.items():
                    yield told(leaf, cj, s, e, n)

        return run

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in rows_of(batches):
            mine, theirs = Leaf(row, dims), Leaf(row, dims, "_b")
            yield told(mine, theirs.c, distances(mine.x, theirs.x) @ theirs.copies.astype(float), 0.0, theirs.copies.sum())

    steps, asked = [], None
    for level in range(len(found.levels) - 1, -1, -1):
        rows = found.leaves if asked is None else found.shown(asked, level)
        step = written(rows.mapInArrow(descend(asked is None), schema), "sums")
        asked = step.where("node IS NOT NULL").select("id", "node")
        steps.append(step.where("i IS NOT NULL"))
    theirs = found.leaves.select(F.col("id").alias("node"), *[F.col(c).alias(f"{c}_b") for c in found.leaves.columns])
    steps.append(asked.join(theirs, "node").join(found.leaves, "id").mapInArrow(measure, schema))
    both = functools.reduce(DataFrame.unionByName, steps)
    return both.groupBy("i", "ci", "cj").agg(F.sum("s").alias("s"), F.sum("e").alias("e"), F.sum("n").alias("n"))
