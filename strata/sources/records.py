"""CSV records that may hold line breaks, read block by block.

A quoted cell may go on over lines, so where a record begins depends on all that stands
before. Each block of a file is scanned once for both cases, "begins inside quotes" and
"outside", and tells in which it ends for each. These are functions of two states, which
compose: a running window over the blocks of a file, a row for each, says in which state
every block really begins. Then each task joins the lines of its own blocks to records; what
a record has in later blocks comes to it by its file and number.

A quote counts where a cell begins with it; inside, two stand for one. A quote that is never
closed takes the rest of the file into one cell.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from strata.session import written

#: Bytes of a file's beginning in which the ends of lines are looked for.
HEAD = 1 << 16
COMPRESSED = (".gz", ".bz2", ".zst", ".lz4", ".snappy", ".deflate")


def line_end(spark: SparkSession, path: str) -> str:
    """The byte that ends the lines of the first file of a path: a carriage return only if there is no line feed."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
    some = [f for s in fs.globStatus(at) or [] for f in (fs.listStatus(s.getPath()) if s.isDirectory() else [s]) if f.isFile() and not f.getPath().getName().startswith(("_", "."))]
    if not some or some[0].getPath().getName().endswith(COMPRESSED):
        return "\n"
    stream = fs.open(some[0].getPath())
    try:
        head = bytes(stream.readNBytes(HEAD))
    finally:
        stream.close()
    return "\r" if b"\r" in head and b"\n" not in head else "\n"


def lines(spark: SparkSession, path: str, end: str) -> DataFrame:
    """value, file, block (where its part of the file begins) and place (grows by one from line to line of a block)."""
    text = spark.read.text(path, lineSep=end).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"))
    return text.withColumn("place", F.monotonically_increasing_id())


def after(line: str, separator: str, inside: bool) -> bool:
    """Whether a line ends inside quotes."""
    at = 0
    while True:
        if inside or line.startswith('"', at):
            at += not inside
            while True:
                close = line.find('"', at)
                if close < 0:
                    return True
                at = close + 1
                if not line.startswith('"', at):
                    break
                at += 1
            inside = False
        at = line.find(separator, at)
        if at < 0:
            return False
        at += len(separator)


def by_block(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple[str, int] | None, list[str], int]]:
    """(file and block, lines, place of the first) for each stretch of a block; None at the end."""
    for batch in batches:
        files, blocks = batch.column("file").dictionary_encode().indices.to_numpy(), batch.column("block").to_numpy()
        cuts = [0, *(np.flatnonzero((files[1:] != files[:-1]) | (blocks[1:] != blocks[:-1])) + 1).tolist(), len(blocks)]
        for a, b in zip(cuts, cuts[1:]):
            if a < b:
                yield (batch.column("file")[a].as_py(), int(blocks[a])), batch.column("value").slice(a, b - a), batch.column("place")[a].as_py()
    yield None, [], 0


def scanned(table: DataFrame, separator: str) -> DataFrame:
    """file, block, n_lines, first (place), outside and inside: whether a block that begins so ends inside quotes,
    and spans: whether a line that begins outside ends inside."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of, n, first, state, spans = None, 0, 0, [False, True], False
        for block, values, place in by_block(batches):
            if block != of:
                if of:
                    yield pa.RecordBatch.from_pylist([{"file": of[0], "block": of[1], "n_lines": n, "first": first, "outside": state[0], "inside": state[1], "spans": spans}])
                of, n, first, state, spans = block, 0, place, [False, True], False
            n += len(values)
            for line in values.filter(pc.match_substring(values, '"')).to_pylist() if block else []:
                state = [after(line, separator, s) for s in state]
                spans = spans or state[0] or state[1]

    return table.mapInArrow(scan, "file string, block long, n_lines long, first long, outside boolean, inside boolean, spans boolean")


def begun(blocks: DataFrame) -> DataFrame:
    """blocks with begins: whether a block begins inside quotes."""
    order = Window.partitionBy("file").orderBy("block")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    sure = F.col("outside") == F.col("inside")
    turns = blocks.withColumn("turns", F.sum((F.col("outside") & ~F.col("inside")).cast("int")).over(order))
    last = F.last(F.when(sure, F.struct(F.col("outside").cast("int").alias("state"), "turns")), ignorenulls=True).over(before)
    told = turns.withColumn("last", last).withColumn("so_far", F.coalesce(F.lag("turns").over(order), F.lit(0)))
    state = F.coalesce(F.col("last.state"), F.lit(0)) + F.col("so_far") - F.coalesce(F.col("last.turns"), F.lit(0))
    return told.select(*blocks.columns, (state % 2 == 1).alias("begins"))


def pieces(table: DataFrame, separator: str, end: str, blocks: DataFrame) -> DataFrame:
    """file, block, place, kind and value: whole records (kind 0), the beginning of a record that goes on in a later
    block (1), and what a block has of a record that began before it (2)."""
    # The blocks that begin inside quotes: a pair for each such block of a file, however long.
    inside = blocks.where("begins").select("file", "block").toArrow()
    sent = table.sparkSession.sparkContext.broadcast(set(zip(inside["file"].to_pylist(), inside["block"].to_pylist())))

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of, held, began, kind, inside = None, [], 0, 0, False

        def told(rows: list[tuple]) -> pa.RecordBatch:
            kinds = (pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string())
            return pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], ["file", "block", "place", "kind", "value"])

        for block, values, place in by_block(batches):
            out = []
            if block != of:
                if held:
                    out.append((*of, began, 2 if kind == 2 else 1, end.join(held)))
                of, held = block, []
                inside = block in sent.value
                kind = 2 if inside else 0
            for k, line in enumerate(values.to_pylist() if block else []):
                if not held:
                    began = place + k
                held.append(line)
                if '"' in line:
                    inside = after(line, separator, inside)
                if not inside:
                    out.append((*of, began, kind, end.join(held).removesuffix("\r")))
                    held, kind = [], 0
            if out:
                yield told(out)

    return table.mapInArrow(join, "file string, block long, place long, kind long, value string")


def records(table: DataFrame, separator: str, end: str, blocks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """file, block, place (of the first line) and value of each record, and those that are never closed (file, block, place); blocks: of begun()."""
    found = written(pieces(table, separator, end, blocks), "pieces")  # read for faults, kinds of columns and the rows themselves
    torn = written(found.where("kind > 0"), "torn")  # two for each block at most
    order = Window.partitionBy("file").orderBy("block", "place")
    numbered = torn.withColumn("no", F.sum((F.col("kind") == 1).cast("int")).over(order))
    parts = F.array_sort(F.collect_list(F.struct("block", "place", "value")))
    joined = numbered.groupBy("file", "no").agg(F.min_by("block", "place").alias("block"), F.min("place").alias("place"), parts.alias("parts"))
    whole = joined.select("file", "block", "place", F.array_join(F.transform("parts", lambda p: p["value"]), end).alias("value"))
    ends = blocks.withColumn("state", F.when(F.col("begins"), F.col("inside")).otherwise(F.col("outside"))).groupBy("file").agg(F.max_by("state", "block").alias("open")).where("open")
    unclosed = whole.groupBy("file").agg(F.max(F.struct("block", "place")).alias("at")).join(ends, "file").select("file", "at.block", "at.place")
    return found.where("kind = 0").select("file", "block", "place", "value").unionByName(whole), unclosed
