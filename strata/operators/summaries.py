"""Mergeable summaries of columns: one pass over any number of them.

Each task reads its part of all columns as Arrow batches and gives, for each column, counts,
extremes, votes for numbers and times, and its different values with their counts, as far as
there are at most MOST. Summaries are merged in one grouped step, so a table of a thousand
columns is still one scan and two small shuffles. Where a column has more values, their
exact number comes from a second pass over such columns alone, in one shuffle of (column,
hash) for all of them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strata.functions.values import EDGE, NUMBER, TEMPORAL, TIME, kind_of, plain

#: Different values of a column that are told one by one.
MOST = 50
SCHEMA = "k int, value string, num double, n long, missing long, numbers long, filled long, dates long, lo double, hi double, over boolean"
FIELDS = pa.schema([("k", pa.int32()), ("value", pa.string()), ("num", pa.float64()), ("n", pa.int64()), ("missing", pa.int64()), ("numbers", pa.int64()), ("filled", pa.int64()), ("dates", pa.int64()), ("lo", pa.float64()), ("hi", pa.float64()), ("over", pa.bool_())])


def chosen(df: DataFrame, names: list[str]) -> list[str]:
    """Expressions for columns c0, c1, ... as they are summarised: numbers and texts as they are read, times as milliseconds."""
    out = []
    for k, c in enumerate(names):
        kind, name = kind_of(df, c), "`" + c.replace("`", "``") + "`"
        decimal = isinstance(df.schema[c].dataType, T.DecimalType)
        how = {"number": "CAST({} AS DOUBLE)" if decimal else "{}", "text": "{}", "boolean": "CAST({} AS INT)", "time": "unix_millis(CAST({} AS TIMESTAMP))", "other": "CAST({} AS STRING)"}[kind]
        out.append(f"{how.format(name)} AS c{k}")
    return out


def as_numbers(texts: pa.Array) -> pa.Array:
    """The finite numbers that texts of the form NUMBER are."""
    try:
        value = texts.cast(pa.float64())
    except pa.ArrowInvalid:  # some are out of range
        value = pa.array([None if t is None else float(t) for t in texts.to_pylist()], pa.float64())
    return pc.if_else(pc.is_finite(value), value, None)


def normal(kind: str, column: pa.Array) -> pa.Array:
    """A column's cells as they are told apart: numbers without NaN and negative zero, trimmed texts; null: missing."""
    if kind == "number" and pa.types.is_floating(column.type):
        column = pc.cast(column, pa.float64())
        return pc.if_else(pc.is_finite(column), pc.add(column, 0.0), None)
    if kind in ("text", "other"):
        text = pc.utf8_trim(column, characters=EDGE)
        return pc.if_else(pc.equal(text, ""), None, text)
    return column.cast(pa.string()) if kind == "boolean" else column


class Part:
    """What a task has seen of a column of a kind (see kind_of())."""

    def __init__(self, k: int, kind: str):
        self.k, self.kind = k, kind
        self.missing = self.numbers = self.filled = self.dates = 0
        self.lo = self.hi = None
        self.values: dict | None = {}

    def add(self, column: pa.Array) -> None:
        if self.kind == "number":
            column = normal(self.kind, column)
            self.count(column, column)
        elif self.kind in ("text", "other"):
            # Each different text of the batch is trimmed and read once.
            coded = column.dictionary_encode()
            label, which = normal(self.kind, coded.dictionary), coded.indices
            if self.kind == "other":
                self.count(label.take(which), None)
                return
            value = as_numbers(pc.if_else(pc.match_substring_regex(label, NUMBER), pc.replace_substring_regex(label, r"^\+", ""), None))
            self.filled += len(column) - column.null_count
            self.dates += pc.sum(pc.match_substring_regex(label, TEMPORAL).take(which)).as_py() or 0
            self.count(label.take(which), value.take(which))
        elif self.kind == "time":
            self.filled += len(column) - column.null_count
            self.dates = self.filled
            self.count(column, None)
        else:
            self.count(normal(self.kind, column), column.cast(pa.float64()))

    def count(self, own: pa.Array, v: pa.Array | None) -> None:
        """Labels of cells (null: missing) and their numbers."""
        self.missing += own.null_count
        if v is not None and (some := len(v) - v.null_count):
            self.numbers += some
            ends = pc.min_max(v)
            lo, hi = float(ends["min"].as_py()), float(ends["max"].as_py())
            self.lo, self.hi = (lo, hi) if self.lo is None else (min(lo, self.lo), max(hi, self.hi))
        if self.values is not None and own.null_count < len(own):
            counts = own.value_counts()
            if len(counts) > MOST + 1:
                self.values = None
                return
            for x in counts.to_pylist():
                if x["values"] is not None:
                    self.values[x["values"]] = self.values.get(x["values"], 0) + x["counts"]
            if len(self.values) > MOST:
                self.values = None

    def rows(self) -> list[dict]:
        told = [{"k": self.k, "num" if isinstance(v, float) else "value": v if isinstance(v, (float, str)) else str(v), "n": n} for v, n in (self.values or {}).items()]
        return [{"k": self.k, "missing": self.missing, "numbers": self.numbers, "filled": self.filled, "dates": self.dates, "lo": self.lo, "hi": self.hi, "over": self.values is None}, *told]


class Summary:
    """The summaries of some columns of a table.

    Of each column, by name: missing cells, numbers, lowest and highest number (None without
    any), filled cells and times among them, and n_values (None: more than MOST).
    """

    def __init__(self, df: DataFrame, names: list[str] | None = None):
        self.df, self.names = df, list(df.columns if names is None else names)
        parts = self.names
        table, kinds = df.selectExpr(*chosen(df, parts)), [kind_of(df, c) for c in parts]

        def summarise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            seen = [Part(k, kind) for k, kind in enumerate(kinds)]
            for batch in batches:
                for part in seen:
                    part.add(batch.column(part.k))
            yield pa.RecordBatch.from_pylist([r for part in seen for r in part.rows()], FIELDS)

        self.by, self.told = {}, {}
        for c in parts:  # what a table without partitions has
            self.by[c], self.told[c] = {"missing": 0, "numbers": 0, "filled": 0, "dates": 0, "lo": None, "hi": None, "n_values": 0}, []
        if not parts:
            return
        times = [k for k, kind in enumerate(kinds) if kind == "time"]
        name = F.when(F.col("k").isin(times), F.date_format(F.timestamp_millis(F.col("value").try_cast("long")), TIME)).otherwise(F.coalesce("value", plain(F.col("num"))))
        sums = [F.sum(c).alias(c) for c in ("missing", "numbers", "filled", "dates")]
        ends = [F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.bool_or("over").alias("over")]
        merged = table.mapInArrow(summarise, SCHEMA).groupBy("k", "value", "num").agg(F.sum("n").alias("n"), *sums, *ends)
        # A row for each column, with its values in order, or MOST + 1 of them where it has more.
        values = F.slice(F.sort_array(F.collect_list(F.when(F.col("n").isNotNull(), F.struct((-F.col("n")).alias("less"), name.alias("name"))))), 1, MOST + 1)
        for r in merged.groupBy("k").agg(*sums, *ends, values.alias("told")).collect():
            c, many = parts[r["k"]], r["over"] or len(r["told"]) > MOST
            self.by[c] = {x: r[x] for x in ("missing", "numbers", "filled", "dates", "lo", "hi")} | {"n_values": None if many else len(r["told"])}
            self.told[c] = [] if many else [(v["name"], -v["less"]) for v in r["told"]]

    def exact(self) -> dict[str, int]:
        """The number of different values of each column, also of those with many."""
        many = [c for c in self.names if self.by[c]["n_values"] is None]
        out = {c: self.by[c]["n_values"] for c in self.names if c not in many}
        if many:
            kinds = [kind_of(self.df, c) for c in many]
            columns = [(pa.string(), "text"), (pa.float64(), "num"), (pa.int64(), "whole")]

            def different(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                """The different cells of each column of a batch."""
                for batch in batches:
                    parts = [normal(kind, batch.column(k)).unique().drop_null() for k, kind in enumerate(kinds)]
                    number_of = pa.array(np.repeat(np.arange(len(parts), dtype=np.int32), [len(x) for x in parts]))
                    fits = lambda t, x: pa.types.is_integer(x.type) if t == pa.int64() else x.type == t
                    told = [pa.concat_arrays([x.cast(t) if fits(t, x) else pa.nulls(len(x), t) for x in parts]) for t, _ in columns]
                    yield pa.record_batch([number_of, *told], ["k", *(name for _, name in columns)])

            rows = self.df.selectExpr(*chosen(self.df, many)).mapInArrow(different, "k int, text string, num double, whole long")
            # Texts are moved as 96 bits of hash, numbers as they are.
            keys = rows.select("k", "num", "whole", F.xxhash64("text").alias("h"), F.hash("text").alias("g")).distinct()
            found = {r["k"]: r["count"] for r in keys.groupBy("k").count().collect()}
            out |= {c: found.get(k, 0) for k, c in enumerate(many)}
        return out

    def groups(self, names: list[str]) -> dict[str, list[tuple[str, int]]]:
        """(label, n) of the values of columns that have few, the most frequent first."""
        return {c: self.told[c] for c in names}
