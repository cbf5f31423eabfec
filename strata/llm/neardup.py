"""Near-duplicate documents by SetSketch.

A document is the set of its five-word shingles. Documents with equal sets form a class,
and only classes are compared. A class has 128 SetSketch registers: each is the smallest
of exponentially distributed hashes, on an exponential scale and truncated, so registers
of a union are the larger of the parts', and two sets agree in a register about as often
as they share elements. Four registers make a band; classes that agree in a band are
candidates, which misses a pair at the least similarity once in 200,000 times.

No bucket's pairs are listed. First each class is held against one class of its buckets,
the one that lies in most large buckets, and links are followed to components. What stays
in different components of one bucket goes on: pairs of small buckets whose similarity,
estimated by likelihood from the registers that are larger, equal and smaller, comes near
the least; and large buckets in blocks, each compared in one task, of which only the links
that join components come back. Every link is confirmed on the full sets.

Nulls and ties: a text that is null or without words has an empty set and is linked with
nothing. A null doc_id is no candidate for the smallest id of a component unless the
component has no other. Very long texts are read a window of bytes at a time, and their sets
take eight bytes a shingle. Repeated rows are in one class, and each keeps its row. An empty
table gives an empty one. Columns besides doc_id and text play no part.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strata.llm.bpe import CLASS, LOWER, portions, stretches, text_buffers, window_end
from strata.llm.sieve import passing
from strata.session import removed, written

WORDS, LEAST, OF = 5, 75, 100
REGISTERS, PER_BAND = 128, 4
BASE, RATE, TOP = 1.001, 20.0, (1 << 16) - 1
#: The estimate's standard deviation is at most 0.039 at the least similarity; five of them are allowed for.
NEAR = LEAST / OF - 5 * 0.039
#: Buckets up to SMALL classes give pairs; larger ones are compared in blocks of BLOCK.
SMALL, BLOCK = 16, 512


def scattered(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that mixes all bits."""
    x = (x ^ x >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ x >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
    return x ^ x >> np.uint64(31)


with np.errstate(over="ignore"):
    SEEDS = scattered(np.arange(1, 2 * REGISTERS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
FLIP, FACTOR = SEEDS[:REGISTERS, None], SEEDS[REGISTERS:, None] | np.uint64(1)
STEP = np.uint64(0xD6E8FEB86659FD93)


def tokens(part: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of texts, one text's after the other's, and where each text's begin, then where the last end.

    Lower-cases A-Z only, and splits at ASCII white space only. The different words of a
    window are hashed once; nothing is remembered.
    """
    data, begins = text_buffers(part)
    out, at, here, done = [np.zeros(0, np.uint64)], [], 0, 0
    while here < len(data):
        end = window_end(data, begins, here)
        own = begins[np.searchsorted(begins, here) : np.searchsorted(begins, end)] - here
        piece = LOWER[data[here:end]]
        solid = CLASS[piece] > 0
        start = solid.copy()
        start[1:] &= ~solid[:-1]
        start[own] = solid[own]
        coded = stretches(piece, solid, start).dictionary_encode()
        raw, ends = text_buffers(coded.dictionary)
        raw, ends = raw.tobytes(), ends.tolist()
        hashes = np.fromiter((xxhash.xxh3_64_intdigest(raw[a:b]) for a, b in zip(ends, ends[1:])), np.uint64, len(ends) - 1)
        out.append(hashes[coded.indices.to_numpy()])
        at.append(np.searchsorted(np.flatnonzero(start), own) + done)
        done += len(out[-1])
        here = end
    at.append(np.full(len(begins) - sum(map(len, at)), done, np.int64))
    return np.concatenate(out), np.concatenate(at)


def shingle_sets(part: pa.Array) -> list[np.ndarray]:
    """Of each text the sorted hashes of its different shingles."""
    h, at = tokens(part)

    def rolled(h: np.ndarray, width: int) -> np.ndarray:
        out = np.full(len(h) - width + 1, width, np.uint64)
        for k in range(width):
            out = out * STEP + h[k : len(h) - width + 1 + k]
        return scattered(out)

    every = rolled(h, WORDS) if len(h) >= WORDS else h[:0]
    return [np.unique(every[a : b - WORDS + 1]) if b - a >= WORDS else rolled(h[a:b], b - a) if b > a else h[:0] for a, b in zip(at[:-1].tolist(), at[1:].tolist())]


def shingles(text: str | None) -> np.ndarray:
    return shingle_sets(pa.array([text], pa.string()))[0]


def registers(s: np.ndarray) -> np.ndarray:
    least = np.full(REGISTERS, np.iinfo(np.uint64).max)
    for i in range(0, len(s), 1024):
        least = np.minimum(least, ((s[i : i + 1024] ^ FLIP) * FACTOR).min(1))
    u = (least.astype(np.float64) + 0.5) / 2.0**64
    return np.clip(np.floor(1 - np.log(-np.log1p(-np.minimum(u, 1 - 1e-16)) / RATE) / np.log(BASE)), 0, TOP).astype("<u2")


def estimated(a: np.ndarray, b: np.ndarray, na: np.ndarray, nb: np.ndarray) -> np.ndarray:
    """Similarities by maximum likelihood, from rows of registers and the sets' sizes."""
    more, less = (a > b).sum(1), (a < b).sum(1)
    same = a.shape[1] - more - less
    u, v = na / (na + nb), nb / (na + nb)

    def p(x: np.ndarray) -> np.ndarray:
        return -np.log1p(-np.clip(x, 0, 1) * (BASE - 1) / BASE) / np.log(BASE)

    def likelihood(j: np.ndarray) -> np.ndarray:
        up, down = p(u - v * j), p(v - u * j)
        return sum(n * np.log(np.maximum(x, 1e-12)) for n, x in ((more, up), (less, down), (same, 1 - up - down)))

    low, high = np.zeros(len(u)), np.minimum(u / v, v / u)
    for _ in range(40):  # the likelihood has one maximum
        a3, b3 = low + (high - low) / 3, high - (high - low) / 3
        right = likelihood(a3) < likelihood(b3)
        low, high = np.where(right, a3, low), np.where(right, high, b3)
    return (low + high) / 2


def similar(a: np.ndarray, b: np.ndarray) -> bool:
    if OF * min(len(a), len(b)) < LEAST * max(len(a), len(b)):
        return False
    both = len(np.intersect1d(a, b, assume_unique=True))
    return OF * both >= LEAST * (len(a) + len(b) - both)


def sketched(docs: DataFrame) -> DataFrame:
    """doc_id, n, cls (digest of the set; null if it is empty), sketch."""

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = 0
            for _, part in portions(batch.column(1), 512):
                sets = shingle_sets(part)
                yield pa.record_batch([
                    batch.column(0).slice(at, len(part)), pa.array([len(s) for s in sets], pa.int64()),
                    pa.array([xxhash.xxh128_digest(s.tobytes()) if len(s) else None for s in sets], pa.binary()),
                    pa.array([registers(s).tobytes() if len(s) else None for s in sets], pa.binary()),
                ], ["doc_id", "n", "cls", "sketch"])
                at += len(part)

    return docs.select("doc_id", "text").mapInArrow(sketch, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n long, cls binary, sketch binary")


def banded(classes: DataFrame) -> DataFrame:
    """cid, n and band: a row for each band of a class."""
    bands = REGISTERS // PER_BAND

    def band(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        which = scattered(np.arange(1, bands + 1, dtype=np.uint64))
        for batch in batches:
            rows = np.frombuffer(b"".join(batch.column(2).to_pylist()), "<u8").reshape(-1, bands)
            keys = scattered(rows + which).view(np.int64).ravel()
            yield pa.record_batch([pa.array(np.repeat(batch.column(k).to_numpy(zero_copy_only=False), bands), pa.int64()) for k in (0, 1)] + [pa.array(keys)], ["cid", "n", "band"])

    return classes.select("cid", "n", "sketch").mapInArrow(band, "cid long, n long, band long")


def full_sets(docs: DataFrame, rows: DataFrame, classes: DataFrame, shared: DataFrame) -> DataFrame:
    """cid and set (sorted hashes) of the classes in shared, computed again from one text each."""
    needed = classes.join(shared.select("cid").distinct(), "cid", "left_semi").select("cid", "cls")
    ids = written(rows.select("doc_id", "cls").join(needed, "cls").groupBy("cid").agg(F.min("doc_id").alias("_one")).select("_one").distinct(), "ids")
    may = passing(ids, "_one", ids.count())  # most texts are in no pair and need not move
    texts = docs.select("doc_id", "text").where(may("doc_id")).join(ids, F.col("doc_id").eqNullSafe(F.col("_one")), "left_semi").select("text")

    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, part in portions(batch.column(0), 512):
                raw = [s.tobytes() for s in shingle_sets(part) if len(s)]
                yield pa.record_batch([pa.array([xxhash.xxh128_digest(x) for x in raw], pa.binary()), pa.array(raw, pa.binary())], ["cls", "set"])

    sets = texts.mapInArrow(compute, "cls binary, set binary")
    return sets.join(needed, "cls").groupBy("cid").agg(F.first("set").alias("set"))


def confirmed(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) that are similar."""

    @F.arrow_udf("boolean")
    def check(a: pa.Array, b: pa.Array) -> pa.Array:
        return pa.array([similar(np.frombuffer(x.as_py(), np.uint64), np.frombuffer(y.as_py(), np.uint64)) for x, y in zip(a, b)], pa.bool_())

    left = pairs.join(sets.select(F.col("cid").alias("b"), F.col("set").alias("_b")), "b")
    both = left.join(sets.select(F.col("cid").alias("a"), F.col("set").alias("_a")), "a")
    return both.where(check("_a", "_b")).select("a", "b")


def components(links: DataFrame) -> DataFrame:
    """node and comp, the smallest node that links lead to; nodes without links are left out.

    Each round takes the smallest component of the neighbours and then that component's own.
    """
    both = written(links.select("a", "b").union(links.select("b", "a")).distinct(), "links")
    comp = written(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("comp")), "comp")
    while True:
        near = both.join(comp.select(F.col("node").alias("b"), "comp"), "b").groupBy("a").agg(F.min("comp").alias("near"))
        hooked = comp.join(near.withColumnRenamed("a", "node"), "node").select("node", F.least("comp", "near").alias("to"), F.col("comp").alias("was"))
        own = comp.select(F.col("node").alias("to"), F.col("comp").alias("top"))
        moved = written(hooked.join(own, "to").select("node", F.least("to", "top").alias("comp"), "was"), "comp")
        removed(comp)
        if not moved.where(F.col("comp") != F.col("was")).limit(1).count():
            removed(both)
            return moved
        comp = moved


def starred(shared: DataFrame) -> DataFrame:
    """(a, b): for each class b the class a that leads most of its buckets; a bucket's leader lies in the most and largest buckets."""
    weight = shared.groupBy("cid").agg(F.sum("k").alias("w"))
    leaders = shared.join(weight, "cid").groupBy("band").agg(F.max_by("cid", "w").alias("a"))
    stars = shared.select("cid", "band").join(leaders, "band").where(F.col("cid") != F.col("a"))
    return stars.groupBy("cid", "a").agg(F.count(F.lit(1)).alias("n")).groupBy("cid").agg(F.max_by("a", "n").alias("a")).select("a", F.col("cid").alias("b"))


def mixed(shared: DataFrame, comp: DataFrame) -> DataFrame:
    """The rows, with comp, of the buckets that hold several components."""
    told = shared.join(comp.select(F.col("node").alias("cid"), "comp"), "cid", "left").withColumn("comp", F.coalesce("comp", "cid"))
    torn = told.groupBy("band").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo < hi").select("band")
    return told.join(torn, "band").select("band", "cid", "n", "comp", "k")


def small_pairs(rows: DataFrame, classes: DataFrame) -> DataFrame:
    """Pairs of small buckets and different components whose estimated similarity is near enough."""
    x, y = (rows.where(F.col("k") <= SMALL).select("band", *[F.col(c).alias(f"{c}_{t}") for c in ("cid", "n", "comp")]) for t in "ab")
    fits = (F.col("cid_a") < F.col("cid_b")) & (F.col("comp_a") != F.col("comp_b")) & (OF * F.least("n_a", "n_b") >= LEAST * F.greatest("n_a", "n_b"))
    pairs = x.join(y, "band").where(fits).select(F.col("cid_a").alias("a"), F.col("cid_b").alias("b"), "n_a", "n_b").distinct()

    @F.arrow_udf("boolean")
    def near(a: pa.Array, b: pa.Array, na: pa.Array, nb: pa.Array) -> pa.Array:
        r = [np.frombuffer(b"".join(c.to_pylist()), "<u2").reshape(-1, REGISTERS) for c in (a, b)]
        return pa.array(estimated(*r, na.to_numpy().astype(float), nb.to_numpy().astype(float)) >= NEAR)

    sketch = {t: classes.select(F.col("cid").alias(t), F.col("sketch").alias(f"s_{t}")) for t in "ab"}
    return pairs.join(sketch["a"], "a").join(sketch["b"], "b").where(near("s_a", "s_b", "n_a", "n_b")).select("a", "b")


def block_links(rows: DataFrame, sets: DataFrame) -> DataFrame:
    """Links that join components within the large buckets, each pair of blocks in a task of its own."""
    large = rows.where(F.col("k") > SMALL).withColumn("_of", F.ceil(F.col("k") / BLOCK).cast("int")).withColumn("_block", F.pmod(F.xxhash64("cid"), F.col("_of")).cast("int"))
    dealt = large.join(sets, "cid").withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_of") - 1)))
    dealt = dealt.select("band", F.least("_block", "_other").alias("i"), F.greatest("_block", "_other").alias("j"), "cid", "comp", "set")

    def join(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("cid")
        sets, comps, ids = [np.frombuffer(s, np.uint64) for s in pdf["set"]], pdf["comp"].to_numpy(), pdf["cid"].to_numpy()
        size = np.array([len(s) for s in sets])
        _, column, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
        number = np.cumsum(count > 1) - 1
        row = np.repeat(np.arange(len(sets)), size)
        again = count[column] > 1
        row, column = row[again], number[column[again]]
        order = np.argsort(column, kind="stable")
        row, column = row[order], column[order]
        both = np.zeros((len(sets), len(sets)), np.float32)
        for first in range(0, int(column[-1]) + 1 if len(column) else 0, 4096):
            lo, hi = np.searchsorted(column, (first, first + 4096))
            has = np.zeros((len(sets), 4096), np.float32)
            has[row[lo:hi], column[lo:hi] - first] = 1
            both += has @ has.T
        linked = OF * both >= LEAST * (size[:, None] + size - both)
        top = {c: c for c in comps.tolist()}

        def find(c: int) -> int:
            while top[c] != c:
                top[c] = c = top[top[c]]
            return c

        out = []
        for x, y in zip(*np.nonzero(np.triu(linked & (comps[:, None] != comps), 1))):
            p, q = find(int(comps[x])), find(int(comps[y]))
            if p != q:
                top[max(p, q)] = min(p, q)
                out.append((ids[x], ids[y]))
        return pd.DataFrame(out, columns=["a", "b"], dtype="int64")

    return dealt.groupBy("band", "i", "j").applyInPandas(join, "a long, b long")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id and kept for each row of docs (doc_id, text)."""
    docs = docs.select("doc_id", "text")
    rows = written(sketched(docs), "rows")
    classes = written(rows.where("n > 0").groupBy("cls").agg(F.min("doc_id").alias("least"), F.first("n").alias("n"), F.first("sketch").alias("sketch")).withColumn("cid", F.monotonically_increasing_id()), "classes")
    bands = banded(classes)
    counts = bands.groupBy("band").agg(F.count(F.lit(1)).alias("k")).where("k > 1")
    shared = written(bands.join(counts, "band"), "shared")
    sets = written(full_sets(docs, rows, classes, shared), "sets")
    links = written(confirmed(starred(shared), sets), "starred")
    left = written(mixed(shared, components(links)), "mixed")
    more = written(confirmed(small_pairs(left, classes), sets).union(block_links(left, sets)), "confirmed")
    removed(shared, sets, left)
    comp = components(links.union(more))
    told = classes.select("cid", "cls", "least").join(comp.select(F.col("node").alias("cid"), "comp"), "cid", "left").withColumn("comp", F.coalesce("comp", "cid"))
    smallest = told.groupBy("comp").agg(F.min("least").alias("component_id"))
    named = told.join(smallest, "comp").select("cls", "component_id")
    out = rows.select("doc_id", F.col("n").alias("n_shingles"), "cls").join(named, "cls", "left")
    return out.select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id")).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def query(spark, sf_dir: str) -> DataFrame:
    """op3: one row per row of documents."""
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))


SQL = r"""
WITH RECURSIVE words AS (
  SELECT row_number() OVER () AS r, doc_id,
         list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w
  FROM documents),
shingles AS (
  SELECT DISTINCT r, g FROM (
    SELECT r, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
                     ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i+4], ' ')) END) AS g FROM words)),
sizes AS (SELECT r, count(*) AS n FROM shingles GROUP BY r),
common AS (
  SELECT a.r AS x, b.r AS y, count(*) AS n FROM shingles a JOIN shingles b ON a.g = b.g AND a.r <> b.r GROUP BY a.r, b.r),
links AS (
  SELECT x, y FROM common c JOIN sizes p ON p.r = c.x JOIN sizes q ON q.r = c.y WHERE 100 * c.n >= 75 * (p.n + q.n - c.n)),
reach AS (
  SELECT r AS x, r AS y FROM words UNION SELECT reach.x, links.y FROM reach JOIN links ON reach.y = links.x)
SELECT d.doc_id, coalesce(sizes.n, 0)::BIGINT AS n_shingles, m.component_id, d.doc_id = m.component_id AS kept
FROM words d LEFT JOIN sizes USING (r)
JOIN (SELECT reach.x AS r, min(words.doc_id) AS component_id FROM reach JOIN words ON words.r = reach.y GROUP BY reach.x) m USING (r)
"""
