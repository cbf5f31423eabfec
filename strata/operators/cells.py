"""Density clusters from a graph of grid cells.

The side of a cell is a little under eps / sqrt(d), so points of one cell are within eps of
each other. A cell with `least` points holds only cores, and no distance is computed for
that. The points of other cells are few in each; they ask the cells around them for how many
points are within eps. A cell's box answers alone where it lies inside or outside; else its
points, in chunks of CHUNK, count for all that ask at once, and only counts leave the task.

Cells with cores are nodes. Two are linked if their cores' boxes lie within eps altogether,
not at all if they lie further apart, and else by the closest pair: first the REACH cores of
each that are nearest to the other's box, then, for cells that other links do not join
anyway, all cores within eps of the other's box, chunk by chunk. A point that is no core
belongs to the first cluster with a core within eps, found like the counts. So there is no
table of pairs of points, and a crowd of any size costs its own scan.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from strata.operators.transfer import with_rows
from strata.session import removed, written

CHUNK, REACH = 4096, 32


def squares(x: list[Column]) -> Column:
    return sum((v * v for v in x[1:]), x[0] * x[0])


def farthest(a: Column, lo: Column, hi: Column, dims: int, b: Column | None = None) -> Column:
    """The largest squared distance from a point a, or a box (a, b), to a box."""
    b = a if b is None else b
    return squares([F.greatest(F.abs(hi[j] - a[j]), F.abs(b[j] - lo[j])) for j in range(dims)])


def nearest(a: Column, lo: Column, hi: Column, dims: int, b: Column | None = None) -> Column:
    """The smallest squared distance from a point a, or a box (a, b), to a box."""
    b = a if b is None else b
    return squares([F.greatest(lo[j] - b[j], a[j] - hi[j], F.lit(0.0)) for j in range(dims)])


def around(cell: str, dims: int, half: bool = False) -> Column:
    """The cells that can hold points within eps of a cell's; half: one of each pair of cells."""
    reach = math.floor(math.sqrt(dims) * (1 + 1e-9)) + 1
    steps = [s for s in itertools.product(range(-reach, reach + 1), repeat=dims) if not half or s > (0,) * dims]
    return F.explode(F.array(*[F.array(*[F.col(cell)[j] + F.lit(s) for j, s in enumerate(step)]) for step in steps]))


def box(dims: int, of: str = "x") -> list[Column]:
    return [F.array(*[end(F.col(of)[j]) for j in range(dims)]).alias(name) for name, end in (("lo", F.min), ("hi", F.max))]


def chunked(points: DataFrame, dims: int) -> DataFrame:
    """cell and xs (bytes): the points of a cell, at most about CHUNK in a row."""
    sizes = points.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / CHUNK).cast("int").alias("of"))
    dealt = points.join(sizes, "cell").withColumn("part", F.when(F.col("of") > 1, F.floor(F.rand(7) * F.col("of")).cast("int")).otherwise(0))
    lists = dealt.groupBy("cell", "part").agg(F.collect_list("x").alias("xs"))

    @F.arrow_udf("binary")
    def packed(xs: pa.Array) -> pa.Array:
        return pa.array([np.asarray(x.values.flatten()).astype(float).tobytes() for x in xs], pa.binary())

    return lists.select("cell", packed("xs").alias("xs"))


def met(asks: DataFrame, chunks: DataFrame, eps: float, dims: int) -> DataFrame:
    """asks (a, x, cell) with n, the number of points of that cell's chunks within eps."""
    kind = asks.schema["a"].dataType.simpleString()
    lists = asks.groupBy("cell").agg(F.collect_list("a").alias("as"), F.collect_list("x").alias("x"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for asked, x, xs in zip(*(batch.column(c) for c in ("as", "x", "xs"))):
                x, y = np.asarray(x.values.flatten()).reshape(-1, dims), np.frombuffer(xs.as_py()).reshape(-1, dims)
                n = np.zeros(len(x), np.int64)
                for i in range(0, len(x), 256):
                    d = (x[i : i + 256, None, 0] - y[None, :, 0]) ** 2
                    for j in range(1, dims):
                        d += (x[i : i + 256, None, j] - y[None, :, j]) ** 2
                    n[i : i + 256] = (d <= eps * eps).sum(1)
                yield pa.record_batch([asked.values, pa.array(n)], ["a", "n"])

    return lists.join(chunks, "cell").select("as", "x", "xs").mapInArrow(count, f"a {kind}, n long")


def components(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """cell and comp, the smallest first (of nodes: cell, first) that links (a, b; both ways, a table) lead to."""
    comp, before = nodes.select("cell", F.col("first").alias("comp"), F.col("first").alias("own")), None
    while True:
        low = links.join(comp.select(F.col("cell").alias("b"), "comp"), "b").groupBy(F.col("a").alias("cell")).agg(F.min("comp").alias("low"))
        hooked = comp.join(low, "cell", "left").select("cell", "own", F.least("comp", F.coalesce("low", "comp")).alias("to"), F.col("comp").alias("was"))
        up = comp.select(F.col("own").alias("to"), F.col("comp").alias("up"))  # what the cell of that first core leads to
        moved = Observation()
        new = hooked.join(up, "to").select("cell", "own", F.least("to", "up").alias("comp"), "was")
        comp = written(new.observe(moved, F.count_if(F.col("comp") != F.col("was")).alias("n")).drop("was"), "comp")
        if before is not None:
            removed(before)
        before = comp
        if not moved.get["n"]:
            return comp.select("cell", "comp")


def linked(boxes: DataFrame, cores: DataFrame, eps: float, dims: int) -> DataFrame:
    """cell and comp of the cells with cores; boxes: cell, first, lo, hi; cores: cell, x."""
    far = boxes.select(*[F.col(c).alias(f"{c}_b") for c in ("cell", "lo", "hi")])
    pairs = boxes.select(F.col("cell").alias("a"), "lo", "hi", around("cell", dims, half=True).alias("cell_b")).join(far, "cell_b")
    e2 = eps * eps
    pairs = pairs.where(nearest(F.col("lo"), F.col("lo_b"), F.col("hi_b"), dims, F.col("hi")) <= e2)
    whole = farthest(F.col("lo"), F.col("lo_b"), F.col("hi_b"), dims, F.col("hi")) <= e2
    pairs = written(pairs.select("a", F.col("cell_b").alias("b"), "lo", "hi", "lo_b", "hi_b", whole.alias("whole")), "pairs")
    sure, open_ = pairs.where("whole").select("a", "b"), pairs.where("NOT whole")

    def near(some: DataFrame, most: int | None) -> tuple[DataFrame, DataFrame]:
        """Of both sides of pairs the cores (a, b, x) within eps of the other's box, at most so many, the nearest."""
        out = []
        for side, other in (("a", "_b"), ("b", "")):
            d = nearest(F.col("x"), F.col(f"lo{other}"), F.col(f"hi{other}"), dims)
            own = cores.withColumnRenamed("cell", side).join(some, side).withColumn("d", d).where(F.col("d") <= e2)
            if most:
                own = own.withColumn("r", F.row_number().over(Window.partitionBy("a", "b").orderBy("d"))).where(F.col("r") <= most)
            out.append(own.select("a", "b", "x"))
        return out[0], out[1]

    def touching(some: DataFrame, most: int | None) -> DataFrame:
        """The pairs of which two cores are within eps."""
        key = F.array_join(F.concat("a", "b"), " ")
        left, right = near(some, most)
        left = left.select("a", "b", "x", key.alias("cell"))
        pair = F.struct("a", "b")
        found = met(left.select(pair.alias("a"), "x", "cell"), chunked(right.select("x", key.alias("cell")), dims), eps, dims)
        return found.where("n > 0").select("a.a", "a.b").distinct()

    def both(links: DataFrame) -> DataFrame:
        return written(links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))), "links")

    some = both(sure.unionByName(touching(open_, REACH)))
    comp = components(boxes, some)
    of = lambda c: comp.select(F.col("cell").alias(c), F.col("comp").alias(f"comp_{c}"))
    left = Observation()
    apart = open_.join(of("a"), "a").join(of("b"), "b").where("comp_a != comp_b").drop("comp_a", "comp_b")
    apart = written(apart.observe(left, F.count(F.lit(1)).alias("n")), "apart")
    if not left.get["n"]:
        return comp
    return components(boxes, some.unionByName(both(touching(apart, None))))


def clustered(points: DataFrame, eps: float, least: int, row: str = "_row") -> DataFrame:
    """row and no (from 0, by the clusters' smallest core rows; null: noise) of points (row, x)."""
    dims = len((points.first() or {"x": [0]})["x"])
    side, e2 = eps / math.sqrt(dims) * (1 - 1e-9), eps * eps
    cell = F.array(*[F.floor(F.col("x")[j] / side).cast("long") for j in range(dims)])
    points = written(points.select(F.col(row).alias("a"), "x", cell.alias("cell")), "points")
    boxes = written(points.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.min("a").alias("first"), *box(dims)), "boxes")
    # Two points of a cell are within eps but for the rounding of very large numbers, where the box tells.
    full = (F.col("n") >= least) & (farthest(F.col("lo"), F.col("lo"), F.col("hi"), dims, F.col("hi")) <= e2)
    dense, rest = boxes.where(full), boxes.where(~full)
    sparse = points.join(rest.select("cell"), "cell")
    # Each point of the other cells asks the cells around it, itself included; boxes answer where they can.
    asks = sparse.select("a", "x", around("cell", dims).alias("cell")).join(boxes.select("cell", F.col("n").alias("of"), "lo", "hi"), "cell")
    inside, touches = farthest(F.col("x"), F.col("lo"), F.col("hi"), dims) <= e2, nearest(F.col("x"), F.col("lo"), F.col("hi"), dims) <= e2
    asks = asks.where(touches).select("a", "x", "cell", "of", inside.alias("inside"))
    counts = asks.where("inside").select("a", F.col("of").alias("n")).unionByName(met(asks.where("NOT inside").select("a", "x", "cell"), chunked(points, dims), eps, dims))
    found = written(counts.groupBy("a").agg(F.sum("n").alias("n")).where(F.col("n") >= least).select("a"), "cores")
    alone = sparse.join(found, "a", "left_semi")
    cores = written(alone.unionByName(points.join(dense.select("cell"), "cell").select(alone.columns)).select("cell", "x"), "core_points")
    nodes = dense.select("cell", "first", "lo", "hi").unionByName(alone.groupBy("cell").agg(F.min("a").alias("first"), *box(dims)).select("cell", "first", "lo", "hi"))
    nodes = written(nodes, "nodes")
    comp = linked(nodes, cores, eps, dims)
    numbers = with_rows(comp.select("comp").distinct(), ["comp"], "no")
    nodes = nodes.join(comp.join(numbers, "comp").select("cell", "no"), "cell")
    # Points that are no cores take the first cluster with a core within eps.
    border = sparse.join(found, "a", "left_anti").select("a", "x", around("cell", dims).alias("cell")).join(nodes.select("cell", "no", "lo", "hi"), "cell").where(touches)
    border = border.select("a", "x", "cell", "no", inside.alias("inside"))
    open_ = border.where("NOT inside")
    told = chunked(cores, dims).join(open_.select("cell").distinct(), "cell", "left_semi")
    near = met(open_.select(F.struct("a", "no").alias("a"), "x", "cell"), told, eps, dims).where("n > 0").select("a.a", "a.no")
    edge = border.where("inside").select("a", "no").unionByName(near).groupBy("a").agg(F.min("no").alias("no"))
    inner = points.select("a", "cell").join(nodes.select("cell", "no"), "cell")
    inner = inner.join(rest.select("cell", F.lit(True).alias("mixed")), "cell", "left").join(found.withColumn("core", F.lit(True)), "a", "left").where("mixed IS NULL OR core").select("a", "no")
    out = points.select("a").join(inner.unionByName(edge), "a", "left")
    return out.select(F.col("a").alias(row), "no")
