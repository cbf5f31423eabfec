"""Nearest vectors by randomly rotated one-bit codes.

A unit vector, less the mean of all, is rotated at random and kept as the signs of its
components: one bit each, packed into words, with its length, the part of it that the
signs explain and its product with the mean. A query is rotated too and its components
rounded to PLANES bits, so that its product with the signs is a few counts of common bits.
That estimates the cosine without bias, with an error bound that holds but for a chance
set by ERRORS. Vectors whose upper bound does not reach the k-th best exact cosine found
so far are passed over; the rest are ranked by their exact cosine in double precision.

The index is written once, in chunks, and never moved: queries go to it in blocks of
bounded bytes, and each task gives the k best of its chunks for each query. So the
shuffle holds results only. Every row is indexed; nothing is fitted but the mean, over
all rows.

A vector that is null, empty or zero, or has null or non-finite components, takes no part,
nor does one without an id. Vectors of different lengths are not compared. Repeated rows
are candidates each; a query id that repeats asks once, with its smallest vector, and no
row of its id is its candidate. Ties go to the smaller id. An empty table gives an empty
one. Columns besides the id and the vector play no part.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from strata.session import written

#: Bytes of vectors in a block of queries, vectors in a chunk of the index, queries compared at once.
BLOCK, CHUNK, TILE, SEED = 1 << 24, 8192, 32, 20240917
#: Standard errors within which an estimate is trusted, and bits of a query's component.
ERRORS, PLANES = 3.0, 4


def usable(vectors: DataFrame, name: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """vec_id, v (array<double>) and dim of the vectors that take part."""
    v = F.col(vector).cast("array<double>")
    good = F.col(name).isNotNull() & (F.size(v) > 0) & F.forall(v, lambda x: F.coalesce(F.abs(x) < float("inf"), F.lit(False))) & F.exists(v, lambda x: x != 0)
    return vectors.where(F.col(vector).isNotNull()).where(good).select(F.col(name).cast("long").alias("vec_id"), v.alias("v"), F.size(v).alias("dim"))


@functools.lru_cache(2)
def rotation(dim: int) -> np.ndarray:
    q, r = np.linalg.qr(np.random.default_rng(SEED).standard_normal((dim, dim)))
    return q * np.sign(np.diag(r))


def units(m: np.ndarray) -> np.ndarray:
    m = m / np.abs(m).max(1, keepdims=True)
    return m / np.linalg.norm(m, axis=1, keepdims=True)


def summed(m: np.ndarray) -> np.ndarray:
    """Sums of rows, from left to right."""
    return np.cumsum(m, axis=-1)[..., -1]


def by_length(batch: pa.RecordBatch, most: int = CHUNK) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Ids and vectors (rows) of a batch of usable(), one length and at most so many at a time."""
    dims, ids = batch.column("dim").to_numpy(), batch.column("vec_id").to_numpy()
    for dim in np.unique(dims).tolist():
        some = np.flatnonzero(dims == dim)
        for i in range(0, len(some), most):
            part = some[i : i + most]
            yield ids[part], batch.column("v").take(pa.array(part)).flatten().to_numpy().reshape(-1, dim)


def means(vectors: DataFrame) -> dict[int, np.ndarray]:
    """Of each length, the mean of its unit vectors."""

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for _, m in by_length(batch):
                dim = m.shape[1]
                total[dim] = total.get(dim, 0) + np.append(units(m).sum(0), len(m))
        for dim, s in total.items():
            yield pa.RecordBatch.from_pydict({"dim": pa.array([dim] * len(s), pa.int32()), "i": pa.array(range(len(s)), pa.int32()), "s": pa.array(s)})

    found: dict[int, np.ndarray] = {}
    for r in vectors.mapInArrow(sums, "dim int, i int, s double").groupBy("dim", "i").agg(F.sum("s").alias("s")).collect():
        found.setdefault(r["dim"], np.zeros(r["dim"] + 1))[r["i"]] = r["s"]
    return {dim: s[:-1] / s[-1] for dim, s in found.items()}


def packed(signs: np.ndarray) -> np.ndarray:
    """Rows of booleans as rows of 64-bit words."""
    words = -(-signs.shape[-1] // 64)
    bits = np.packbits(signs, axis=-1)
    return np.pad(bits, [(0, 0)] * (bits.ndim - 1) + [(0, 8 * words - bits.shape[-1])]).view(np.uint64)


class Codes:
    """Vectors of one length with their codes."""

    def __init__(self, ids: np.ndarray, m: np.ndarray, bits: np.ndarray, scalars: np.ndarray):
        self.ids, self.m, self.bits, self.scalars = ids, m, bits, scalars

    @classmethod
    def of(cls, ids: np.ndarray, m: np.ndarray, mean: np.ndarray) -> Codes:
        rest = units(m) - mean
        turned = rest @ rotation(m.shape[1]).T
        length = np.linalg.norm(rest, axis=1)
        explained = np.abs(turned).sum(1) / np.sqrt(m.shape[1]) / np.maximum(length, 1e-300)
        size = np.sqrt(summed(m * m))
        return cls(ids, m, packed(turned > 0), np.stack([length, np.maximum(explained, 1e-9), rest @ mean, size]))

    @classmethod
    def read(cls, row: dict) -> Codes:
        ids = np.frombuffer(row["ids"], np.int64)
        return cls(ids, np.frombuffer(row["vectors"]).reshape(len(ids), -1), np.frombuffer(row["bits"], np.uint64).reshape(len(ids), -1), np.frombuffer(row["scalars"]).reshape(4, -1))

    def record(self) -> pa.RecordBatch:
        parts = {"ids": self.ids, "vectors": self.m, "bits": self.bits, "scalars": self.scalars}
        return pa.RecordBatch.from_pydict({"dim": pa.array([self.m.shape[1]], pa.int32())} | {k: pa.array([np.ascontiguousarray(v).tobytes()], pa.binary()) for k, v in parts.items()})


class Asked:
    """A block of queries of one length, ready to be held against codes, and what was found for them."""

    def __init__(self, names: np.ndarray, q: np.ndarray, mean: np.ndarray, k: int):
        dim = q.shape[1]
        self.names, self.q, self.k = names, q, k
        rest = units(q) - mean
        turned = rest @ rotation(dim).T
        low = turned.min(1, keepdims=True)
        self.step = np.maximum(turned.max(1, keepdims=True) - low, 1e-300) / ((1 << PLANES) - 1)
        level = np.rint((turned - low) / self.step).astype(np.uint8)
        self.planes = [packed(level >> b & 1 > 0) for b in range(PLANES)]
        self.low, self.total = low, turned.sum(1, keepdims=True)
        self.length, self.with_mean = np.linalg.norm(rest, axis=1)[:, None], (units(q) @ mean)[:, None]
        self.size = np.sqrt(summed(q * q))
        self.score, self.found = np.full((len(q), k), -np.inf), np.zeros((len(q), k), np.int64)

    def meet(self, codes: Codes) -> None:
        """Take what is nearer in codes than what was found so far."""
        dim = self.q.shape[1]
        length, explained, with_mean, _ = codes.scalars
        ones = np.bitwise_count(codes.bits).sum(1).astype(np.float32)
        scale = (length / explained / np.sqrt(dim)).astype(np.float32)
        unexplained = np.maximum(1 - explained**2, 0) / max(dim - 1, 1)
        for i in range(0, len(self.q), TILE):
            part = slice(i, i + TILE)
            shared = np.zeros((len(self.q[part]), len(codes.ids)), np.float32)
            for b, plane in enumerate(self.planes):
                for w in range(plane.shape[1]):
                    shared += np.bitwise_count(plane[part, w, None] & codes.bits[:, w]).astype(np.float32) * np.float32(1 << b)
            step, low, total = (x[part].astype(np.float32) for x in (self.step, self.low, self.total))
            estimate = (2 * (step * shared + low * ones) - total) * scale
            # What the signs leave out, and what rounding the query adds: up to half a step for each component.
            error = np.sqrt((length**2 * unexplained / explained**2).astype(np.float32) * self.length[part].astype(np.float32) ** 2 + (step * scale) ** 2 * np.float32(dim / 6))
            upper = estimate + with_mean.astype(np.float32) + self.with_mean[part].astype(np.float32) + np.float32(ERRORS) * error + np.float32(1e-5)
            bar = self.score[part, -1].copy()
            if len(codes.ids) > self.k:  # where nothing was found yet, the exact scores of the best estimates are the bar
                for r in np.flatnonzero(~np.isfinite(bar)):
                    some = np.argpartition(-upper[r], self.k)[: self.k + 1]
                    score = self.exact(i + r, some[codes.ids[some] != self.names[i + r]], codes)
                    bar[r] = np.sort(score)[-self.k] if len(score) >= self.k else -np.inf
            for r, c in self.rows(upper >= bar[:, None].astype(np.float32) - np.float32(1e-6)):
                self.take(i + r, c[codes.ids[c] != self.names[i + r]], codes)

    @staticmethod
    def rows(mask: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        row, column = np.nonzero(mask)
        ends = np.searchsorted(row, np.arange(len(mask) + 1))
        return ((r, column[ends[r] : ends[r + 1]]) for r in range(len(mask)) if ends[r] < ends[r + 1])

    def exact(self, i: int, some: np.ndarray, codes: Codes) -> np.ndarray:
        return summed(codes.m[some] * self.q[i]) / (self.size[i] * codes.scalars[3, some])

    def take(self, i: int, some: np.ndarray, codes: Codes) -> None:
        """Add some of the codes to what query i has, as far as they are among its k nearest."""
        if len(some) > self.k:  # exact sums only where they can matter
            rough = np.einsum("ij,j->i", codes.m[some], self.q[i]) / codes.scalars[3, some]  # in one thread
            some = some[rough >= max(np.partition(rough, len(some) - self.k)[len(some) - self.k], self.score[i, -1] * self.size[i]) - 1e-9 * np.abs(rough).max()]
        known = np.isfinite(self.score[i])
        score, ids = np.append(self.score[i][known], self.exact(i, some, codes)), np.append(self.found[i][known], codes.ids[some])
        order = np.lexsort((ids, -score))[: self.k]
        self.score[i, : len(order)], self.found[i, : len(order)] = score[order], ids[order]

    def record(self) -> pa.RecordBatch:
        real = np.isfinite(self.score)
        return pa.RecordBatch.from_pydict({"query_id": pa.array(np.repeat(self.names, real.sum(1))), "vec_id": pa.array(self.found[real]), "score": pa.array(self.score[real])})


def coded(index: DataFrame, mean: dict[int, np.ndarray]) -> DataFrame:
    """The index: a row for each chunk of vectors of one length."""
    sent = index.sparkSession.sparkContext.broadcast(mean)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, m in by_length(batch):
                yield Codes.of(ids, m, sent.value[m.shape[1]]).record()

    return index.mapInArrow(encode, "dim int, ids binary, vectors binary, bits binary, scalars binary")


def met(codes: DataFrame, mean: dict[int, np.ndarray], block: pa.Table, k: int) -> DataFrame:
    """query_id, vec_id and score of the k best in each task's part of the index for each query of a block."""
    asked = {m.shape[1]: (ids, m) for b in block.combine_chunks().to_batches() for ids, m in by_length(b, b.num_rows)}
    sent = codes.sparkSession.sparkContext.broadcast((asked, {dim: mean[dim] for dim in asked if dim in mean}))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked, mean = sent.value
        found: dict[int, Asked] = {}
        for batch in batches:
            for row in range(batch.num_rows):
                one = {c: batch.column(c)[row].as_py() for c in batch.schema.names}
                if (dim := one["dim"]) in asked:
                    if dim not in found:
                        found[dim] = Asked(*asked[dim], mean[dim], k)
                    found[dim].meet(Codes.read(one))
        for one in found.values():
            yield one.record()

    return codes.mapInArrow(search, "query_id long, vec_id long, score double")


def nearest(index: DataFrame, queries: DataFrame, k: int = 5) -> DataFrame:
    """query_id, rank (from 1), vec_id and score of each query's k nearest; both of usable()."""
    spark = index.sparkSession
    mean = means(index)
    codes = written(coded(index, mean), "codes")
    asked = queries.groupBy("vec_id", "dim").agg(F.min("v").alias("v"))
    size = asked.agg(F.coalesce(F.sum("dim"), F.lit(0))).first()[0]
    blocks = max(1, -(-8 * size // BLOCK))
    number = F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).alias("block")
    asked = written(asked.select("vec_id", "dim", "v", number).repartitionByRange(blocks, "block"), "asked")
    out = spark.createDataFrame([], "query_id long, vec_id long, score double")
    for b in range(blocks):
        block = asked.where(F.col("block") == b).drop("block").toArrow()  # about BLOCK bytes
        if block.num_rows:
            out = out.unionByName(written(met(codes, mean, block, k), "found"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return out.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def query(spark, sf_dir: str) -> DataFrame:
    """op2: the five nearest of every row whose vec_id is divisible by 50."""
    rows = usable(spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding"))
    return nearest(rows, rows.where(F.col("vec_id") % 50 == 0))


SQL = """
WITH v AS (
  SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
n AS (SELECT vec_id, e, sqrt(list_dot_product(e, e)) AS s FROM v),
q AS (SELECT vec_id, len(e) AS d, min(e) AS e FROM n WHERE vec_id % 50 = 0 GROUP BY vec_id, len(e))
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM (
  SELECT q.vec_id AS query_id, n.vec_id, list_dot_product(q.e, n.e) / (sqrt(list_dot_product(q.e, q.e)) * n.s) AS score,
         row_number() OVER (PARTITION BY q.vec_id ORDER BY list_dot_product(q.e, n.e) / (sqrt(list_dot_product(q.e, q.e)) * n.s) DESC, n.vec_id) AS rank
  FROM q JOIN n ON q.vec_id <> n.vec_id AND q.d = len(n.e)) WHERE rank <= 5
"""
