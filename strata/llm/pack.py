"""Best-fit packing by minimum bin slack.

Documents become pieces of at most the capacity. How many pieces there are of each
length is a table with at most as many rows as the capacity, so the packing is found on
those counts: a bin takes the longest length left and, by a subset-sum over a bit set,
the combination of the lengths left that fills the rest of the bin best. The same
combination is then used as often as the counts allow, which empties a length each time;
so there are at most `capacity` combinations, however many pieces there are.
Pieces of a length are then numbered, and a piece's number finds its bin in that table.
Very long texts are encoded a window of bytes at a time; repeated rows have pieces each.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from strata.llm.bpe import portions, text_buffers, vocabulary
from strata.session import written

#: Pieces of one length that are numbered in one task: a share of all, but within these.
SHARE, LEAST, MOST = 4000, 1000, 1_000_000


def fullest(lengths: list[int], counts: list[int], room: int) -> list[tuple[int, int]]:
    """(index, times) of the combination of lengths whose sum is the largest up to room.

    Bit s of a step's set says that sum s can be made of the lengths up to that step.
    """
    mask, sets, used = (1 << room + 1) - 1, [1], []
    for k, (length, count) in enumerate(zip(lengths, counts)):
        if length > room:
            continue
        reach, times, left = sets[-1], 1, min(count, room // length)
        while left:  # 1, 2, 4, ... copies at a time give every number up to count
            take = min(times, left)
            reach |= reach << take * length & mask
            used.append((k, take))
            sets.append(reach)
            left -= take
            times *= 2
        if reach >> room & 1:
            break
    at, out = sets[-1].bit_length() - 1, {}
    for step in range(len(used), 0, -1):
        k, take = used[step - 1]
        if not sets[step - 1] >> at & 1:
            at -= take * lengths[k]
            out[k] = out.get(k, 0) + take
    return sorted(out.items())


def combinations(counts: dict[int, int], capacity: int) -> list[tuple[int, list[tuple[int, int]]]]:
    """(bins, [(length, times), ...]) until every piece is in a bin; longest lengths first."""
    left, out = {k: v for k, v in counts.items() if v}, []
    while left:
        lengths = sorted(left, reverse=True)
        seed = lengths[0]
        rest = [left[k] - (k == seed) for k in lengths]
        chosen = {seed: 1}
        for k, n in fullest(lengths, rest, capacity - seed):
            chosen[lengths[k]] = chosen.get(lengths[k], 0) + n
        bins = min(left[k] // n for k, n in chosen.items())
        out.append((bins, sorted(chosen.items(), reverse=True)))
        for k, n in chosen.items():
            left[k] -= n * bins
            if not left[k]:
                del left[k]
    return out


def pieces(docs: DataFrame, path: str, capacity: int = 2048, end_id: int = 0, with_ids: bool = True) -> DataFrame:
    """Each document's ids with end_id after them, cut every `capacity` ids.

    doc_id, piece (from 0), start, length, ids_crc32 and, if asked for, ids; both are of
    little-endian unsigned 32-bit integers. A null or empty text is the single id end_id.
    Other columns are left out.
    """
    id_type = docs.schema["doc_id"].dataType

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = vocabulary(path)
        for batch in batches:
            for here, part in portions(batch.column(1)):
                ids, at = bpe.encoded(*text_buffers(part))
                ids, at = np.insert(ids, at[1:], np.uint32(end_id)), at + np.arange(len(at))
                count = -(-np.diff(at) // capacity)  # pieces of each document
                row = np.repeat(np.arange(len(part)), count)
                piece = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
                first = at[row] + piece * capacity
                ends = np.append(first[1:], at[-1])
                raw = memoryview(ids.view(np.uint8))
                parts = [raw[4 * a : 4 * b] for a, b in zip(first.tolist(), ends.tolist())]
                out = {"doc_id": batch.column(0).take(pa.array(here + row)), "piece": pa.array(piece.astype(np.int32)), "start": pa.array(piece * capacity), "length": pa.array(ends - first)}
                out["ids_crc32"] = pa.array(map(zlib.crc32, parts), pa.int64())
                yield pa.RecordBatch.from_pydict(out | ({"ids": pa.array(parts, pa.binary())} if with_ids else {}))

    schema = f"doc_id {id_type.simpleString()}, piece int, start long, length long, ids_crc32 long"
    return docs.select("doc_id", "text").mapInArrow(cut, schema + ", ids binary" * with_ids)


def packed(table: DataFrame, capacity: int = 2048, order: tuple[str, ...] = ()) -> DataFrame:
    """table, which has a long column `length` of 1 to `capacity`, with sequence_id and offset.

    Every row is kept. Rows of one length are interchangeable; `order` only fixes which of
    them goes where. table is read twice and should be a written one. Columns named
    sequence_id or offset are replaced. An empty table gives an empty one.
    """
    table = table.drop("sequence_id", "offset")
    lengths = table.groupBy("length").count().collect()  # at most capacity rows
    if any(not 1 <= r["length"] <= capacity for r in lengths):
        raise ValueError(f"there are pieces that do not fit into {capacity}")
    # A common length is dealt over many parts, which are numbered apart; so no length is one task's.
    together = min(MOST, max(LEAST, sum(r["count"] for r in lengths) // SHARE))
    parts = {r["length"]: max(1, -(-r["count"] // together)) for r in lengths}
    common = {k: n for k, n in parts.items() if n > 1}
    of = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kn in common.items() for x in kn]), F.col("length")), F.lit(1)) if common else F.lit(1)
    salted = table.withColumn("_part", F.pmod(F.xxhash64(*(order or table.columns)), of).cast("int"))
    sizes = salted.groupBy("length", "_part").count().collect()  # at most capacity + SHARE + pieces / MOST rows
    counts: dict[int, int] = {}
    before: dict[int, int] = {}
    for r in sorted(sizes, key=lambda r: (r["length"], r["_part"])):
        before[r["length"] << 32 | r["_part"]] = counts.get(r["length"], 0)
        counts[r["length"]] = counts.get(r["length"], 0) + r["count"]
    keys, first, each, bins, places = [], [], [], [], []
    taken: dict[int, int] = {}
    done = 0
    for n, content in combinations(counts, capacity):
        place = 0
        for length, times in content:  # pieces taken[length] ... of that length, `times` to a bin
            keys.append(length << 44 | taken.get(length, 0))
            first.append(taken.get(length, 0))
            each.append(times)
            bins.append(done)
            places.append(place)
            taken[length] = taken.get(length, 0) + n * times
            place += length * times
        done += n
    order_of = np.argsort(np.array(keys, np.int64))
    keys, first, each, bins, places = (np.array(x, np.int64)[order_of] for x in (keys, first, each, bins, places))
    slots, starts = np.array(sorted(before), np.int64), np.array([before[k] for k in sorted(before)], np.int64)

    def place_rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            length = pdf["length"].to_numpy(np.int64)
            number = pdf.pop("_number").to_numpy(np.int64) - 1 + starts[np.searchsorted(slots, length << 32 | pdf.pop("_part").to_numpy(np.int64))]
            at = np.searchsorted(keys, length << 44 | number, side="right") - 1
            beyond = number - first[at]
            yield pdf.assign(sequence_id=bins[at] + beyond // each[at], offset=places[at] + beyond % each[at] * length)

    numbered = salted.withColumn("_number", F.row_number().over(Window.partitionBy("length", "_part").orderBy(*(order or ("length",)))))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in table.schema) + ", sequence_id long, offset long"
    return numbered.mapInPandas(place_rows, schema)


def query(spark, sf_dir: str) -> DataFrame:
    """op6: every document's pieces of at most 2048 ids and their places."""
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return packed_documents(docs, public_tokenizers.path("word_bpe_49k.json"))


def packed_documents(docs: DataFrame, path: str, capacity: int = 2048) -> DataFrame:
    """The places of all pieces; pieces() gives their ids again when sequences are written out."""
    return packed(written(pieces(docs, path, capacity, with_ids=False), "pieces"), capacity, ("doc_id", "piece"))
