"""Clustering on two or three axes, and the diagnostics that go with it.

K-means comes in two forms: `kmeans_scaled` (MLlib) and `kmeans_reference`, whose sequential
random numbers and row order give reproducible labels; both fit all rows. DBSCAN is stated without an order: cores, the
components of cores within eps, and border points, so it runs on a graph of grid cells.
"""

from __future__ import annotations

import math
import pickle
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strata.functions.draws import Mulberry32
from strata.functions.values import number
from strata.operators import cells, rows, trees
from strata.operators.filters import complete
from strata.operators.rows import imputed, z_scores
from strata.session import written

STARTS, PASSES, SAMPLE = range(42, 52), 300, 100_000
#: Parts of a step's sums that reach the driver at most.
MERGED = 16
#: The seed of diagnostics' samples, a fixed value.
SEED = 0x5CA7


def axes_of(df: DataFrame, axes: list[str], standardise: bool = False, row: str = "_row") -> DataFrame:
    """_row and x (array<double>): axes filled with their medians, standardised before that if asked for."""
    table = z_scores(df, axes) if standardise else df
    return imputed(table, axes).select(row, F.array(*[F.col(f"`{c}`") for c in axes]).alias("x"))


def squared(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return ((x[:, None, :] - centres[None]) ** 2).sum(2)


def lloyd(x: np.ndarray, k: int, seed: int) -> tuple[float, np.ndarray, np.ndarray]:
    """Inertia, labels and centres from one start; ties go to the lowest centre, an empty one moves to the farthest point."""
    draw = Mulberry32(seed)
    chosen = [int(draw() * len(x))]
    near = squared(x, x[chosen])[:, 0]
    while len(chosen) < k:
        mark = draw() * near.sum()
        at = int(np.searchsorted(np.cumsum(near), mark)) if near.sum() > 0 else int(draw() * len(x))
        chosen.append(min(at, len(x) - 1))
        near = np.minimum(near, squared(x, x[chosen[-1:]])[:, 0])
    centres, labels = x[chosen].copy(), np.full(len(x), -1)
    for _ in range(PASSES):
        d = squared(x, centres)
        new = d.argmin(1)
        for c in range(k):
            mine = new == c
            if mine.any():
                centres[c] = x[mine].mean(0)
            else:
                far = int(d[np.arange(len(x)), new].argmax())
                centres[c], new[far] = x[far], c
        if (new == labels).all():
            break
        labels = new
    return float(squared(x, centres)[np.arange(len(x)), labels].sum()), labels, centres


def sampled(points: DataFrame, most: int, seed: int = SEED, row: str = "_row") -> pd.DataFrame:
    """At most `most` points on the driver, in row order, at the places of a seeded shuffle; for diagnostics."""
    return rows.sampled(points, most, [row], seed).toPandas()


def kmeans_reference(points: DataFrame, k: int, row: str = "_row") -> DataFrame:
    """_row and Cluster: the best of ten seeded starts over all rows in row order.

    Up to SAMPLE rows are one chunk, of which a task takes all steps of a start; more are
    fitted in chunks, whose sums are added up by tasks before they reach the driver. Both take
    the same steps, and the driver holds sums and centres only.
    """
    n = points.count()
    if not n:
        return points.select(row, F.lit(None).cast("string").alias("Cluster"))
    k = max(1, min(k, n))
    if n <= SAMPLE:
        def one(pdf: pd.DataFrame) -> pd.DataFrame:
            x = np.stack(pdf.sort_values(row)["x"].to_numpy()).astype(float)
            inertia, _, centres = lloyd(x, k, int(pdf["seed"].iloc[0]))
            return pd.DataFrame({"seed": pdf["seed"].iloc[:1], "inertia": [inertia], "centres": [centres.tobytes()], "dims": [x.shape[1]]})

        each = points.select(row, "x", F.explode(F.array(*map(F.lit, STARTS))).alias("seed")).groupBy("seed")
        best = min(each.applyInPandas(one, "seed int, inertia double, centres binary, dims int").collect(), key=lambda r: (r["inertia"], r["seed"]))
        centres = np.frombuffer(bytes(best["centres"])).reshape(-1, best["dims"])
    else:
        centres = Chunks(points, n, row).fitted(k)
    return assigned(points, centres, row)


class Chunks:
    """Points in row order, in chunks that tasks work on; all starts take each step together."""

    def __init__(self, points: DataFrame, n: int, row: str):
        parts = -(-n // SAMPLE)
        ranged = points.select(row, "x").repartitionByRange(parts, row).sortWithinPartitions(row)

        def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if batch.num_rows:
                    x = np.array(batch.column("x").to_pylist(), float)
                    yield pa.RecordBatch.from_pydict({"first": batch.column(row).slice(0, 1), "x": pa.array([x.tobytes()], pa.binary()), "dims": pa.array([x.shape[1]], pa.int32())})

        self.table = written(ranged.mapInArrow(pack, f"first {points.schema[row].dataType.simpleString()}, x binary, dims int"), "chunks")
        self.n = n

    def each(self, work) -> list[tuple]:
        """(first row, what work gives for the chunk), in row order."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for k in range(batch.num_rows):
                    x = np.frombuffer(batch.column("x")[k].as_py()).reshape(-1, batch.column("dims")[k].as_py())
                    yield pa.RecordBatch.from_pydict({"first": batch.column("first").slice(k, 1), "out": pa.array([pickle.dumps(work(x, batch.column("first")[k].as_py()))], pa.binary())})

        rows = self.table.mapInArrow(run, f"first {self.table.schema['first'].dataType.simpleString()}, out binary").collect()
        return [(r["first"], pickle.loads(r["out"])) for r in sorted(rows, key=lambda r: r["first"])]

    def added(self, work) -> dict:
        """The sums over chunks of what work gives, by start (see summed()): tasks add them up, some at a time, and the driver the last few."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            out: dict = {}
            for batch in batches:
                for k in range(batch.num_rows):
                    x = np.frombuffer(batch.column("x")[k].as_py()).reshape(-1, batch.column("dims")[k].as_py())
                    out = summed(out, work(x, batch.column("first")[k].as_py()))
            yield pa.RecordBatch.from_pydict({"out": pa.array([pickle.dumps(out)], pa.binary())})

        def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            out: dict = {}
            for batch in batches:
                for one in batch.column("out").to_pylist():
                    out = summed(out, pickle.loads(one))
            yield pa.RecordBatch.from_pydict({"out": pa.array([pickle.dumps(out)], pa.binary())})

        out: dict = {}
        for r in self.table.mapInArrow(run, "out binary").repartition(MERGED).mapInArrow(merge, "out binary").collect():
            out = summed(out, pickle.loads(r["out"]))
        return out

    def at(self, wanted: dict[int, tuple]) -> dict[int, np.ndarray]:
        """For each start the point at a place of a chunk; wanted: start to (chunk's first row, a function from points to the place)."""
        found = self.each(lambda x, first: {s: x[place(x)] for s, (chunk, place) in wanted.items() if chunk == first})
        return {s: v for _, one in found for s, v in one.items()}

    def fitted(self, k: int) -> np.ndarray:
        """The centres with the least inertia."""
        draws = [Mulberry32(seed) for seed in STARTS]
        sizes = self.each(lambda x, first: len(x))

        def numbered(index: int) -> tuple:
            for first, n in sizes:
                if index < n:
                    return first, lambda x, index=index: index
                index -= n
            return sizes[-1][0], lambda x: len(x) - 1

        one = self.at({s: numbered(int(draw() * self.n)) for s, draw in enumerate(draws)})
        chosen = [one[s][None] for s in range(len(draws))]
        while len(chosen[0]) < k:
            now = chosen
            near = self.each(lambda x, first: [float(squared(x, c).min(1).sum()) for c in now])
            wanted = {}
            for s, draw in enumerate(draws):
                sums = np.cumsum([v[s] for _, v in near])
                mark = draw() * sums[-1]
                if sums[-1] <= 0:
                    wanted[s] = numbered(int(draw() * self.n))
                    continue
                c = min(int(np.searchsorted(sums, mark)), len(near) - 1)
                rest = mark - (sums[c - 1] if c else 0.0)
                wanted[s] = near[c][0], lambda x, rest=rest, centres=now[s]: min(int(np.searchsorted(np.cumsum(squared(x, centres).min(1)), rest)), len(x) - 1)
            one = self.at(wanted)
            chosen = [np.concatenate([c, one[s][None]]) for s, c in enumerate(chosen)]
        centres, before, live = [c.copy() for c in chosen], [None] * len(chosen), set(range(len(chosen)))
        for _ in range(PASSES):
            state = {s: (centres[s], before[s]) for s in live}
            told = self.added(lambda x, first: {s: step(x, *c, first) for s, c in state.items()})
            for s in sorted(live):
                total, count, changed, far = told[s]
                before[s], new = centres[s], centres[s].copy()
                for c in range(k):
                    if count[c]:
                        new[c] = total[c] / count[c]
                    elif far:
                        _, _, label, new[c] = far.pop(0)
                        total[label] -= new[c]
                        count[label] -= 1
                centres[s] = new
                if not changed:
                    live.discard(s)
            if not live:
                break
        last = centres
        inertia = self.each(lambda x, first: [float(squared(x, c).min(1).sum()) for c in last])
        return centres[int(np.argmin([sum(v[s] for _, v in inertia) for s in range(len(centres))]))]


def summed(a: dict, b: dict) -> dict:
    """Of each start the sums of two parts' steps; of the farthest points as many as there are centres, those of earlier rows first on ties."""
    out = dict(a)
    for s, (total, count, changed, far) in b.items():
        if s in out:
            t, n, c, f = out[s]
            total, count, changed = t + total, n + count, c + changed
            far = sorted(f + far, key=lambda x: (-x[0], x[1]))[: len(count)]
        out[s] = (total, count, changed, far)
    return out


def step(x: np.ndarray, centres: np.ndarray, before: np.ndarray | None, first):
    """A chunk's sums and counts by centre, how many labels changed, and its farthest points as (distance, the chunk's first row, label, point)."""
    d = squared(x, centres)
    new = d.argmin(1)
    own = d[np.arange(len(x)), new]
    count = np.bincount(new, minlength=len(centres))
    total = np.stack([np.bincount(new, weights=v, minlength=len(centres)) for v in x.T], 1)
    changed = len(x) if before is None else int((squared(x, before).argmin(1) != new).sum())
    far = np.argsort(-own, kind="stable")[: len(centres)]
    return total, count, changed, [(float(own[i]), first, int(new[i]), x[i]) for i in far]


def assigned(points: DataFrame, centres: np.ndarray, row: str = "_row") -> DataFrame:
    """The nearest centre of each point, the lowest on ties."""
    terms = [sum(((F.col("x")[j] - float(v)) ** 2 for j, v in enumerate(c)), F.lit(0.0)) for c in centres]
    d = points.select(row, F.array(*terms).alias("d"))
    return d.select(row, F.concat(F.lit("Cluster "), (F.array_position("d", F.array_min("d")) - 1).cast("string")).alias("Cluster"))


def kmeans_scaled(points: DataFrame, k: int, seed: int = 42, row: str = "_row") -> DataFrame:
    """_row and Cluster by MLlib's distributed k-means."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    ready = points.select(row, array_to_vector("x").alias("features"))
    model = KMeans(k=k, seed=seed, maxIter=PASSES).fit(ready)
    return model.transform(ready).select(row, F.concat(F.lit("Cluster "), F.col("prediction").cast("string")).alias("Cluster"))


def dbscan(points: DataFrame, eps: float, least: int, row: str = "_row") -> DataFrame:
    """_row and Cluster (Cluster 0, 1, ... by their smallest core row, or Noise).

    A core has `least` points within eps, itself included. Cores within eps are one cluster;
    another point takes the lowest cluster of the cores within eps of it.
    """
    found = cells.clustered(points, eps, least, row)
    return found.select(row, F.coalesce(F.concat(F.lit("Cluster "), F.col("no").cast("string")), F.lit("Noise")).alias("Cluster"))


def numbers(df: DataFrame, axes: list[str], row: str = "_row") -> DataFrame:
    """_row and x of the rows whose axes are all numbers."""
    return complete(df, axes).select(row, F.array(*[number(df, c) for c in axes]).alias("x"))


def silhouette(labelled: DataFrame, row: str = "_row", tolerance: float = 0.0) -> DataFrame:
    """silhouette, error and n: the mean silhouette (Euclidean; 0 for a point alone in its cluster) over all rows of _row, x and Cluster.

    Mean distances are right to a share `tolerance` of themselves, and the silhouette to
    `error`, which is told by the bounds of each point. With a tolerance of 0 the work is
    that of all pairs, which the exact mean over them asks for; with 1e-3 it is a bounded
    number of nodes for each point. Equal points of a cluster are one with a multiplicity.
    Rows without a cluster or a point are left out.
    """
    whole = labelled.where(F.col("Cluster").isNotNull() & F.col("x").isNotNull()).groupBy("x", F.col("Cluster").cast("string").alias("c"))
    points = written(whole.agg(F.count(F.lit(1)).alias("copies")).select("x", "copies", "c"), "points")
    found = trees.tree(points)
    if found is None:
        return labelled.limit(0).agg(F.avg(F.lit(0.0)).alias("silhouette"), F.avg(F.lit(0.0)).alias("error"), F.count(F.lit(1)).alias("n"))
    own = F.col("ci") == F.col("cj")
    each = trees.sums(found, tolerance).withColumn("n", F.col("n") - own.cast("int")).where("n > 0")
    each = each.select("i", own.alias("own"), (F.col("s") / F.col("n")).alias("m"), (F.col("e") / F.col("n")).alias("e"))
    a = lambda k: F.max(F.when(F.col("own"), F.greatest(F.col("m") + k * F.col("e"), F.lit(0.0))))
    b = lambda k: F.min(F.when(~F.col("own"), F.greatest(F.col("m") + k * F.col("e"), F.lit(0.0))))
    ends = each.groupBy("i").agg(*[f(k).alias(f"{name}{j}") for name, f in (("a", a), ("b", b)) for j, k in enumerate((-1, 0, 1))])
    ends = ends.join(found.placed.select(F.col("place").alias("i"), "copies"), "i")

    def of(a: str, b: str):
        s = F.coalesce(F.try_divide(F.col(b) - F.col(a), F.greatest(a, b)), F.lit(0.0))
        return F.sum(F.when(F.col(a).isNull() | F.col(b).isNull(), 0.0).otherwise(s) * F.col("copies")) / F.sum("copies")

    # A silhouette grows with b and falls with a. A point without other points has no row of sums.
    means = ends.agg(of("a1", "b1").alias("s"), of("a2", "b0").alias("low"), of("a0", "b2").alias("high"), F.sum("copies").alias("told"))
    share, n = F.coalesce(F.col("told") / F.col("n"), F.lit(0.0)), found.placed.agg(F.sum("copies").alias("n")).first()["n"]
    error = F.greatest(F.col("high") - F.col("s"), F.col("s") - F.col("low"))
    return means.withColumn("n", F.lit(n).cast("long")).select((F.coalesce("s", F.lit(0.0)) * share).alias("silhouette"), (F.coalesce(error, F.lit(0.0)) * share).alias("error"), "n")


def mean_silhouette(x: np.ndarray, labels: np.ndarray) -> float:
    """The same on the driver, for a sample that is there already."""
    d = np.sqrt(squared(x, x))
    out = np.zeros(len(x))
    for i, c in enumerate(labels):
        mine = labels == c
        others = [d[i, labels == o].mean() for o in set(labels.tolist()) - {c}]
        if mine.sum() > 1 and others:
            a, b = d[i, mine].sum() / (mine.sum() - 1), min(others)
            out[i] = (b - a) / max(a, b) if max(a, b) else 0.0
    return float(out.mean())


def silhouette_by_k(points: DataFrame, most_k: int = 8, cap: int = 1200, row: str = "_row") -> list[dict]:
    """k and silhouette for k from 2, over at most `cap` complete rows (a sampling diagnostic); none under ten."""
    some = sampled(points, cap, row=row)
    if len(some) < 10:
        return []
    x = np.stack(some["x"].to_numpy()).astype(float)
    out = []
    for k in range(2, min(most_k, len(x) // 3) + 1):
        _, labels, _ = min((lloyd(x, k, seed) for seed in STARTS), key=lambda r: r[0])
        out.append({"k": k, "silhouette": mean_silhouette(x, labels)})
    return out


def k_distances(points: DataFrame, least: int, row: str = "_row") -> DataFrame:
    """The distance of each point to its (least - 1)-th neighbour, itself not counted.

    Equal points count as one with a multiplicity. Points of any density are found in a
    tree of boxes (`trees`), in a number of jobs that grows with the logarithm of the rows.
    Under `least` points there is no such neighbour, and no row. Rows without a point are left out.
    """
    k = least - 1
    some = points.where(F.col("x").isNotNull())
    sites = written(some.groupBy("x").agg(F.count(F.lit(1)).alias("copies")).withColumn("c", F.lit("")), "sites")
    if k < 1 or (sites.agg(F.sum("copies")).first()[0] or 0) <= k:
        return points.select(row, F.lit(None).cast("double").alias("d")).where("false")
    found = trees.tree(sites)
    each = found.placed.select("place", "x").join(trees.k_nearest(found, k), "place").select("x", "d")
    return some.select(row, "x").join(each, "x").select(row, "d")


def k_distance_percentiles(points: DataFrame, least: int, cap: int = 2000, row: str = "_row", at: tuple[int, ...] = (50, 75, 90, 95, 99)) -> dict | None:
    """The values at floor(p / 100 n) of the sorted k-distances; none for under two samples."""
    if least < 2:
        return None
    some = rows.sampled(points, cap, [row], SEED)
    d = sorted(r["d"] for r in k_distances(written(some, "sample"), least, row).select("d").collect())  # at most `cap`
    if not d:
        return None
    return {"n": len(d), "kth": least - 1, "percentiles": {f"p{p}": d[min(len(d) - 1, math.floor(p / 100 * len(d)))] for p in at}}
