"""Row access: top rows, seeded samples, cells cut to length, search, codes blanked, columns standardised."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strata.functions.draws import sample_places
from strata.functions.values import kind_of, label, listed, number
from strata.operators.ranks import quantiles
from strata.operators.transfer import with_rows
from strata.session import written

MOST_ROWS, MOST_COLUMNS = 50, 20


def columns_of(df: DataFrame, columns: list[str] | None = None) -> list[str]:
    """The requested columns, at most MOST_COLUMNS; ValueError names unknown ones."""
    wanted = columns or df.columns
    unknown = [c for c in wanted if c not in df.columns]
    if unknown:
        raise ValueError(f"unknown columns: {', '.join(unknown)}")
    return wanted[:MOST_COLUMNS]


def shown(df: DataFrame, columns: list[str]) -> DataFrame:
    """Cells as they are listed: numbers as they are, texts cut to 200 characters."""
    return df.select(*[F.col(f"`{c}`") if kind_of(df, c) in ("number", "boolean") else listed(df, c).alias(c) for c in columns])


def top(df: DataFrame, by: str, k: int, tie: list, ascending: bool = False, columns: list[str] | None = None) -> DataFrame:
    """The first k rows by a column, missing ones last in either direction; ties in the order of `tie`."""
    key = F.col(f"`{by}`") if kind_of(df, by) in ("number", "time") else F.lower(label(df, by))
    order = key.asc_nulls_last() if ascending else key.desc_nulls_last()
    return shown(df.orderBy(order, *tie).limit(min(k, MOST_ROWS)), columns_of(df, columns))


def sampled(df: DataFrame, k: int, key: list[str], seed: int) -> DataFrame:
    """k rows in the order of their key, at the places that a seeded shuffle gives; all rows if there are no more."""
    n = df.count()
    if n <= k:
        return df.orderBy(*key)
    return with_rows(df, key, "_at").where(F.col("_at").isin(*sample_places(n, k, seed))).drop("_at").orderBy(*key)


def sample(df: DataFrame, k: int, key: list[str], seed: int = 1, columns: list[str] | None = None) -> DataFrame:
    """At most MOST_ROWS sampled rows, as they are listed."""
    return shown(sampled(df, min(k, MOST_ROWS), key, seed), columns_of(df, columns))


def page(df: DataFrame, order: list, number_of: int, size: int = 100) -> DataFrame:
    """One page of the rows in an order."""
    return df.orderBy(*order).offset(number_of * size).limit(size)


class Pages:
    """A table in an order, kept with its row numbers, so that any page is one range of it.

    The rows are sorted and numbered once and written in their order; a file's footer tells
    which numbers it has, so a page reads the files and row groups it lies in and no other.
    """

    def __init__(self, df: DataFrame, order: list, row: str = "_at"):
        self.row, self.table = row, written(with_rows(df, order, row), "pages")

    def page(self, number_of: int, size: int = 100) -> DataFrame:
        """The rows from number_of * size on, in order."""
        at = F.col(self.row)
        return self.table.where((at >= number_of * size) & (at < (number_of + 1) * size)).orderBy(at).drop(self.row)


def recoded(df: DataFrame, plan: dict[str, list[float]]) -> DataFrame:
    """Named codes in named columns become null."""
    return df.withColumns({c: F.when(~F.coalesce(number(df, c).isin(*codes), F.lit(False)), F.col(f"`{c}`")) for c, codes in plan.items()})


def recode_effect(df: DataFrame, plan: dict[str, list[float]]) -> DataFrame:
    """column_name, replaced, and n, mean and sd (sample) before and after; one pass."""
    parts = []
    for c, codes in plan.items():
        v = number(df, c)
        after = F.when(~v.isin(*codes), v)
        parts.append(F.struct(F.lit(c).alias("column_name"), F.count_if(v.isin(*codes)).alias("replaced"), F.count(v).alias("n_before"), F.avg(v).alias("mean_before"), F.stddev_samp(v).alias("sd_before"), F.count(after).alias("n_after"), F.avg(after).alias("mean_after"), F.stddev_samp(after).alias("sd_after")).alias(c))
    return df.agg(*parts).select(F.inline(F.array(*[F.col(f"`{c}`") for c in plan])))


def z_scores(df: DataFrame, columns: list[str]) -> DataFrame:
    """Columns less their mean over their population sd; a constant column becomes 0, missing cells stay."""
    moments = df.agg(*[f(number(df, c)).alias(f"{n}{k}") for k, c in enumerate(columns) for n, f in (("m", F.avg), ("s", F.stddev_pop))]).first()
    return df.withColumns({c: (number(df, c) - F.lit(moments[f"m{k}"])) / F.lit(moments[f"s{k}"]) if moments[f"s{k}"] else F.when(number(df, c).isNotNull(), 0.0) for k, c in enumerate(columns)})


def medians(df: DataFrame, columns: list[str]) -> list[float]:
    """Exact medians; 0 for a column without numbers."""
    cells = df.select(F.inline(F.array(*[F.struct(F.lit(k).alias("k"), number(df, c).alias("v")) for k, c in enumerate(columns)])))
    found = {r["k"]: r["m"] for r in quantiles(cells, {"m": 0.5}, ("k",)).collect()}  # a row for each column
    return [found.get(k, 0.0) for k in range(len(columns))]


def imputed(df: DataFrame, columns: list[str]) -> DataFrame:
    """Missing cells become their column's exact median."""
    return df.withColumns({c: F.coalesce(number(df, c), F.lit(m)) for c, m in zip(columns, medians(df, columns))})


def points(df: DataFrame, axes: list[str], colour: str, shape: str | None = None, thin: int | None = None, order: str | None = None) -> DataFrame:
    """What a scatter plot draws: colour, shape and the axes' numbers of the rows that have all of them.

    thin keeps every so-many-th row by the `order` column, for a plot's shadow.
    """
    values = {f"axis{k}": number(df, c) for k, c in enumerate(axes)}
    rows = df.where(F.pmod(F.col(order), F.lit(thin)) == 0) if thin and order else df
    out = rows.select(F.coalesce(label(df, colour), F.lit("N/A")).alias("colour"), (F.coalesce(label(df, shape), F.lit("N/A")) if shape else F.lit("")).alias("shape"), *[c.alias(n) for n, c in values.items()])
    return out.dropna(subset=list(values))


def bounds(plotted: DataFrame) -> DataFrame:
    """colour, shape, n and the least and largest number on each axis of points()."""
    axes = [c for c in plotted.columns if c.startswith("axis")]
    return plotted.groupBy("colour", "shape").agg(F.count(F.lit(1)).alias("n"), *[f(a).alias(f"{a}_{n}") for a in axes for n, f in (("min", F.min), ("max", F.max))])
