"""Moments of rows with gaps, by which cells a row lacks, carried through affine refills.

A refill sets a row's missing cells to an affine function of all its cells, so after any
number of refills they are an affine function of the cells that are there: the maps compose.
So n, mean and cross-products of the observed cells, taken once for each pattern of gaps,
give the moments of the filled rows in every round, and no row is touched before the end,
where each is filled once by the composed map of its pattern.

The PATTERNS commonest patterns are carried on the driver. What is rarer stays in the table
of patterns, where tasks compose the maps again and give sums; that costs a small job a
round, and only where a table has more patterns.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strata.session import written

PATTERNS, HELD = 1024, 512
SCHEMA = "mask binary, n long, mean binary, m2 binary"
FIELDS = pa.schema([("mask", pa.binary()), ("n", pa.int64()), ("mean", pa.binary()), ("m2", pa.binary())])


class Moments:
    """n, mean and centred cross-products."""

    def __init__(self, p: int, n: int = 0, mean: np.ndarray | None = None, m2: np.ndarray | None = None):
        self.n, self.mean, self.m2 = n, np.zeros(p) if mean is None else mean, np.zeros((p, p)) if m2 is None else m2

    def add(self, other: Moments) -> Moments:
        n = self.n + other.n
        if other.n:
            shift = other.mean - self.mean
            self.m2 = self.m2 + other.m2 + np.outer(shift, shift) * (self.n * other.n / n)
            self.mean = self.mean + shift * (other.n / n)
        self.n = n
        return self

    @classmethod
    def of(cls, x: np.ndarray) -> Moments:
        d = x - x.mean(0)
        return cls(x.shape[1], len(x), x.mean(0), d.T @ d)

    @classmethod
    def read(cls, r: dict) -> Moments:
        mean = np.frombuffer(r["mean"])
        return cls(len(mean), r["n"], mean, np.frombuffer(r["m2"]).reshape(len(mean), -1))

    def row(self, mask: bytes) -> dict:
        return {"mask": mask, "n": self.n, "mean": self.mean.tobytes(), "m2": np.ascontiguousarray(self.m2).tobytes()}


def matrix(column: pa.Array, p: int) -> np.ndarray:
    """Rows of an array column of p doubles; a gap is NaN."""
    return column.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, p)


def patterns(rows: DataFrame, p: int) -> DataFrame:
    """mask (a byte for each cell, 1: missing) and the moments of the rows (x) with it, missing cells counted as 0."""

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[bytes, Moments] = {}
        for batch in batches:
            if not batch.num_rows:
                continue
            x = matrix(batch.column("x"), p)
            gap = np.isnan(x)
            kinds, which = np.unique(gap, axis=0, return_inverse=True)
            order = np.argsort(which.ravel(), kind="stable")
            ends = np.cumsum(np.bincount(which.ravel(), minlength=len(kinds)))
            x = np.where(gap, 0.0, x)[order]
            for k, (a, b) in enumerate(zip([0, *ends], ends)):
                mask = kinds[k].astype(np.uint8).tobytes()
                seen.setdefault(mask, Moments(p)).add(Moments.of(x[a:b]))
            if len(seen) > HELD:
                yield pa.RecordBatch.from_pylist([m.row(k) for k, m in seen.items()], FIELDS)
                seen = {}
        if seen:
            yield pa.RecordBatch.from_pylist([m.row(k) for k, m in seen.items()], FIELDS)

    def merge(table: pa.Table) -> pa.Table:
        out, mask = Moments(p), table.column("mask")[0].as_py()
        for r in table.to_pylist():
            out.add(Moments.read(r))
        return pa.Table.from_pylist([out.row(mask)], FIELDS)

    parts = rows.select("x").mapInArrow(sums, SCHEMA)
    # A mask's parts from many tasks meet in groups of some first.
    some = parts.withColumn("g", F.pmod(F.spark_partition_id(), F.lit(64))).groupBy("mask", "g").applyInArrow(merge, SCHEMA)
    return written(some.groupBy("mask").applyInArrow(merge, SCHEMA), "patterns")


class Refill:
    """The composed map of one pattern: its missing cells are c @ observed + d."""

    def __init__(self, mask: bytes, start: np.ndarray):
        self.gap = np.frombuffer(mask, np.uint8) > 0
        self.c, self.d = np.zeros((int(self.gap.sum()), int((~self.gap).sum()))), start[self.gap]

    def then(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """One more refill by x -> a @ x + b; gives by how much the map changes."""
        inner = a[np.ix_(self.gap, self.gap)]
        c, d = inner @ self.c + a[np.ix_(self.gap, ~self.gap)], inner @ self.d + b[self.gap]
        change = c - self.c, d - self.d
        self.c, self.d = c, d
        return change

    def filled(self, own: Moments) -> Moments:
        """The moments of the filled rows."""
        seen = ~self.gap
        full = np.zeros((len(seen), int(seen.sum())))
        full[seen] = np.eye(full.shape[1])
        full[self.gap] = self.c
        mean = full @ own.mean[seen]
        mean[self.gap] += self.d
        return Moments(len(seen), own.n, mean, full @ own.m2[np.ix_(seen, seen)] @ full.T)

    def squares(self, own: Moments, c: np.ndarray, d: np.ndarray) -> float:
        """The sum over rows of the squares of c @ observed + d."""
        seen = ~self.gap
        at = c @ own.mean[seen] + d
        return float(np.trace(c @ own.m2[np.ix_(seen, seen)] @ c.T) + own.n * (at @ at))


class Filled:
    """Rows with gaps between refills."""

    def __init__(self, rows: DataFrame, p: int, start: np.ndarray):
        self.rows, self.p, self.start, self.maps = rows, p, start, []
        table = patterns(rows, p)
        common = table.orderBy(F.desc("n"), "mask").limit(PATTERNS).collect()
        self.held = [(Refill(r["mask"], start), Moments.read(r.asDict())) for r in common]
        self.rare = None
        if len(common) == PATTERNS and table.count() > PATTERNS:
            n, mask = common[-1]["n"], bytes(common[-1]["mask"])
            self.rare = table.where((F.col("n") < n) | (F.col("n") == n) & (F.col("mask") > F.lit(mask)))
        self.moments = self._moments()

    def _moments(self) -> Moments:
        out = Moments(self.p)
        for refill, own in self.held:
            out.add(refill.filled(own))
        if self.rare is not None:
            out.add(self._rare(len(self.maps))[0])
        return out

    def _rare(self, turns: int) -> tuple[Moments, float, float]:
        """Moments of the rare patterns' rows after so many refills, and of the last one what moved and how large it is."""
        p, start = self.p, self.start
        sent = self.rows.sparkSession.sparkContext.broadcast(self.maps[:turns])

        def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            out, moved, size = Moments(p), 0.0, 0.0
            for batch in batches:
                for r in batch.to_pylist():
                    refill, own = Refill(r["mask"], start), Moments.read(r)
                    change = None
                    for a, b in sent.value:
                        change = refill.then(a, b)
                    if change:
                        moved, size = moved + refill.squares(own, *change), size + refill.squares(own, refill.c, refill.d)
                    out.add(refill.filled(own))
            yield pa.RecordBatch.from_pylist([out.row(np.array([moved, size]).tobytes())], FIELDS)

        def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            out, told = Moments(p), np.zeros(2)
            for batch in batches:
                for r in batch.to_pylist():
                    out.add(Moments.read(r))
                    told = told + np.frombuffer(r["mask"])
            yield pa.RecordBatch.from_pylist([out.row(told.tobytes())], FIELDS)

        parts = self.rare.mapInArrow(sums, SCHEMA).repartition(32).mapInArrow(merge, SCHEMA).collect()
        out = Moments(p)
        for r in parts:
            out.add(Moments.read(r.asDict()))
        moved, size = sum(np.frombuffer(bytes(r["mask"])) for r in parts)
        return out, float(moved), float(size)

    def refill(self, a: np.ndarray, b: np.ndarray) -> tuple[float, float]:
        """Set missing cells by x -> a @ x + b; the sums of squares of what moved and of what they are now."""
        self.maps.append((a, b))
        moved = size = 0.0
        out = Moments(self.p)
        for refill, own in self.held:
            change = refill.then(a, b)
            moved, size = moved + refill.squares(own, *change), size + refill.squares(own, refill.c, refill.d)
            out.add(refill.filled(own))
        if self.rare is not None:
            rest, m, s = self._rare(len(self.maps))
            out.add(rest)
            moved, size = moved + m, size + s
        self.moments = out
        return moved, size

    def table(self) -> DataFrame:
        """The rows as x, filled once by the composed maps."""
        p, start = self.p, self.start
        sent = self.rows.sparkSession.sparkContext.broadcast(self.maps)

        def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            @lru_cache(HELD)
            def composed(mask: bytes) -> Refill:
                out = Refill(mask, start)
                for a, b in sent.value:
                    out.then(a, b)
                return out

            for batch in batches:
                x = matrix(batch.column("x"), p)
                gap = np.isnan(x)
                kinds, which = np.unique(gap, axis=0, return_inverse=True) if len(x) else (gap, np.zeros(0, int))
                for k, kind in enumerate(kinds):
                    if kind.any():
                        at, one = np.flatnonzero(which.ravel() == k), composed(kind.astype(np.uint8).tobytes())
                        x[np.ix_(at, kind)] = x[np.ix_(at, ~kind)] @ one.c.T + one.d
                ends = pa.array(np.arange(len(x) + 1, dtype=np.int32) * p)
                yield pa.record_batch([pa.ListArray.from_arrays(ends, pa.array(x.ravel()))], ["x"])

        return self.rows.select("x").mapInArrow(fill, "x array<double>")
