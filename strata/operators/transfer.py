"""Copying a column from another table, by position or by key; no row is ever multiplied."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strata.functions.names import is_identifier
from strata.functions.values import label


def by_order(df: DataFrame, source: DataFrame, column: str, name: str, row: str = "_row") -> DataFrame:
    """The source's cell with the same row number; null past its end."""
    return df.join(source.select(F.col(row), F.col(f"`{column}`").alias(name)), row, "left")


def by_key(df: DataFrame, source: DataFrame, column: str, key: str, name: str, row: str = "_row") -> DataFrame:
    """The cell of the source row with the same key as text; of several the last, a missing key matches a missing key.

    The source is reduced to a row for each key first, so a hot key costs one row.
    """
    text = lambda t: F.coalesce(label(t, key), F.lit("null"))
    # max_by ignores nothing: the last row wins even if its cell is null, so the cell is wrapped.
    last = source.groupBy(text(source).alias("_key")).agg(F.max_by(F.struct(F.col(f"`{column}`").alias("c")), row).alias("_cell"))
    return df.withColumn("_key", text(df)).join(last, "_key", "left").withColumn(name, F.col("_cell.c")).drop("_key", "_cell")


def fill_counts(df: DataFrame, source: DataFrame, column: str, key: str, row: str = "_row") -> DataFrame:
    """filled (cells that are not null) and found (keys that the source has)."""
    text = lambda t: F.coalesce(label(t, key), F.lit("null"))
    last = source.groupBy(text(source).alias("_key")).agg(F.max_by(F.struct(F.col(f"`{column}`").alias("c")), row).alias("_cell"))
    joined = df.select(text(df).alias("_key")).join(last, "_key", "left")
    return joined.agg(F.count("_cell.c").alias("filled"), F.count("_cell").alias("found"))


def probe(a: DataFrame, b: DataFrame, row: str = "_row") -> dict | None:
    """How many rows of two tables agree on a shared column: an identifier if there is one, else the one with most values."""
    shared = [c for c in a.columns if c in b.columns and c != row]
    if not shared:
        return None
    ids = [c for c in shared if is_identifier(c)]
    if ids:
        column = ids[0]
    else:
        n = a.agg(*[F.count_distinct(label(a, c)).alias(c) for c in shared]).first()
        column = max(shared, key=lambda c: n[c])
    both = a.select(row, label(a, column).alias("x")).join(b.select(row, label(b, column).alias("y")), row)
    one = both.agg(F.count_if(F.col("x").eqNullSafe(F.col("y"))).alias("agree"), F.count(F.lit(1)).alias("total")).first()
    return {"column": column, "agree": one["agree"], "total": one["total"]}


def order_allowed(a: DataFrame, b: DataFrame, row: str = "_row") -> tuple[bool, str]:
    """Positional copies need equal row counts and, on a shared column, 90 % agreement."""
    if a.count() != b.count():
        return False, "the tables differ in their number of rows"
    found = probe(a, b, row)
    if found and found["total"] and found["agree"] / found["total"] < 0.9:
        return False, f'only {found["agree"]} of {found["total"]} rows agree on "{found["column"]}"'
    return True, ""


def with_rows(df: DataFrame, order: list, name: str = "_row") -> DataFrame:
    """A row number from 0 in a given order: sorted ranges are numbered apart and their sizes added up.

    The sorted table is written first: which range a row is in must not change between the two looks at it.
    """
    return added_up(df.repartitionByRange(*order).sortWithinPartitions(*order), name)


def numbered(df: DataFrame) -> DataFrame:
    """A row number from 0 in the order in which rows are read."""
    return added_up(df)


def added_up(df: DataFrame, name: str = "_row") -> DataFrame:
    """A row number over a table's partitions, in their order."""
    from strata.session import written

    ranged = written(df.withColumn("_part", F.spark_partition_id()).withColumn("_place", F.monotonically_increasing_id()), "ordered")
    starts = {r["_part"]: (r["m"], r["n"]) for r in ranged.groupBy("_part").agg(F.min("_place").alias("m"), F.count(F.lit(1)).alias("n")).collect()}
    offsets, run = {}, 0
    for k in sorted(starts):
        offsets[k] = run - starts[k][0]
        run += starts[k][1]
    if not offsets:
        return df.withColumn(name, F.lit(0).cast("long"))
    at = F.array(*[F.lit(offsets.get(k, 0)).cast("long") for k in range(max(offsets) + 1)])
    return ranged.withColumn(name, F.col("_place") + F.get(at, F.col("_part"))).drop("_part", "_place")
