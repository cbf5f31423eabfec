"""Sharding by sampled splitters.

A sample of keys, weighted by size, gives quantiles that cut the keys into ranges; a range
that turns out overfull is cut again from a sample of its own. Within a range rows are
ordered and their sizes added up; with the sums of the ranges before it, every row knows
how many bytes precede it, which decides its shard. So shards differ by about one row.

The key is the text's hash and the row's number in the scan: equal texts stand together
and are only parted where a shard is full. A null text has no bytes. An empty table gives
an empty one; repeated rows are rows like any other; very long texts are whole rows. Columns
besides the id and the text play no part. At most MOST ranges are cut, so beyond MOST x ROWS
rows a range, and with it a task, grows with the table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from strata.session import written

#: Sampled keys for each range, and rows that a range should have; at most MOST ranges.
SAMPLED, ROWS, MOST = 40, 500_000, 20_000


def sampled(table: DataFrame, count: float, total: int) -> list[tuple[int, int, float]]:
    """About `count` keys with the size that each stands for; a key's chance grows with its size."""
    chance = F.least(F.lit(1.0), F.col("size") * F.lit(count / max(total, 1)))
    draw = F.pmod(F.xxhash64("_hash", "_row", F.lit("draw")), F.lit(1 << 30)) / F.lit(float(1 << 30))
    rows = table.select("_hash", "_row", (F.col("size") / chance).alias("w")).where(draw < chance).collect()
    return sorted((r["_hash"], r["_row"], r["w"]) for r in rows)


def quantiles(sample: list[tuple[int, int, float]], parts: int) -> list[tuple[int, int]]:
    """The first keys of parts 2, 3, ... of about equal size."""
    if not sample:
        return []
    sums = np.cumsum([w for *_, w in sample])
    at = np.searchsorted(sums, sums[-1] * np.arange(1, parts) / parts)
    return sorted({sample[min(k, len(sample) - 1)][:2] for k in at.tolist()})


def ranged(table: DataFrame, cuts: list[tuple[int, int]]) -> DataFrame:
    """table with _range: the number of cuts that are not above the row's key."""
    hashes, rows = np.array([c[0] for c in cuts], np.int64), np.array([c[1] for c in cuts], np.int64)

    @F.pandas_udf("int")
    def place(h: pd.Series, r: pd.Series) -> pd.Series:
        h, r = h.to_numpy(np.int64), r.to_numpy(np.int64)
        low, high = np.searchsorted(hashes, h, "left"), np.searchsorted(hashes, h, "right")
        for k in np.flatnonzero(low < high):  # the hash of a cut
            low[k] += np.searchsorted(rows[low[k] : high[k]], r[k], "right")
        return pd.Series(low.astype(np.int32))

    return table.withColumn("_range", place("_hash", "_row"))


def sharded(docs: DataFrame, shards: int = 40, overhead: int = 16) -> DataFrame:
    """docs (doc_id, text) by bytes: doc_id, size, text_crc32, shard, slot."""
    text = F.coalesce("text", F.lit(""))
    sized = docs.select("doc_id", (F.octet_length(text) + overhead).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.xxhash64(text).alias("_hash"), F.monotonically_increasing_id().alias("_row"))
    table = written(sized, "sized")
    rows, total = table.agg(F.count(F.lit(1)), F.coalesce(F.sum("size"), F.lit(0))).first()
    parts = int(min(MOST, max(4 * shards, rows // ROWS)))
    cuts = quantiles(sampled(table, parts * SAMPLED, total), parts)
    for again in range(5):
        parted = ranged(table, cuts)
        sums = {r["_range"]: (r["n"], r["s"]) for r in parted.groupBy("_range").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("s")).collect()}
        full = [k for k, (n, s) in sums.items() if n > 1 and s > 4 * total / parts]
        if not full or again == 4:  # the sums are always those of the last cuts
            break
        within = sum(sums[k][1] for k in full)
        inside = sampled(parted.where(F.col("_range").isin(full)), SAMPLED * parts * within / total, within)
        more = set(cuts) | {c for c in quantiles(inside, max(2, round(2 * parts * within / total)))}
        if len(more) == len(cuts):
            break
        cuts = sorted(more)
    last = max(sums, default=-1) + 1
    counts, sizes = np.zeros(last + 1, np.int64), np.zeros(last + 1, np.int64)
    for k, (n, s) in sums.items():
        counts[k + 1], sizes[k + 1] = n, s
    counts, sizes = np.cumsum(counts), np.cumsum(sizes)

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            at = pdf.pop("_range").to_numpy()
            before = sizes[at] + pdf.pop("_sum").to_numpy(np.int64) - pdf["size"].to_numpy(np.int64)
            yield pdf.assign(_order=counts[at] + pdf.pop("_number").to_numpy(np.int64) - 1, shard=np.minimum(before * shards // max(total, 1), shards - 1).astype(np.int32))

    order = Window.partitionBy("_range").orderBy("_hash", "_row")
    summed = ranged(table, cuts).select("doc_id", "size", "text_crc32", "_range", F.row_number().over(order).alias("_number"), F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, 0)).alias("_sum"))
    id_type = docs.schema["doc_id"].dataType.simpleString()
    placed = written(summed.mapInPandas(place, f"doc_id {id_type}, size long, text_crc32 long, _order long, shard int"), "placed")
    first = {r["shard"]: r["o"] for r in placed.groupBy("shard").agg(F.min("_order").alias("o")).collect()}
    begins = F.array(*[F.lit(first.get(k, 0)).cast("long") for k in range(shards)])
    return placed.select("doc_id", "size", "text_crc32", "shard", (F.col("_order") - F.get(begins, F.col("shard"))).alias("slot"))


def query(spark, sf_dir: str) -> DataFrame:
    """op9: one row per row of documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return sharded(docs).select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
