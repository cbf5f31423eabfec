"""Order without one task: running counts, midranks and quantiles from counted values in ranges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from strata.session import written

#: Different values that are put in order in one task, about.
RANGE = 1_000_000


def range_of(v: Column, cuts: list[float]) -> Column:
    """How many of the sorted cuts are not above v, by halving."""
    if not cuts:
        return F.lit(0)
    every = F.array(*[F.lit(float(c)) for c in cuts])
    steps = F.array(*[F.lit(1 << k) for k in range(len(cuts).bit_length() - 1, -1, -1)])
    return F.aggregate(steps, F.lit(0), lambda at, step: F.when(F.get(every, at + step - 1) <= v, at + step).otherwise(at))


def midranks_by(values: DataFrame, keys: tuple[str, ...] = ("grp",), also: dict[str, Column] | None = None, n: Column | None = None) -> DataFrame:
    """keys, v, n, upto (rows of the key up to and with v), of (its rows) and midrank of every different v.

    also: further counts, which get a running sum upto_NAME each. Values are counted first
    and written, then cut into ranges of about RANGE and added up within each; what the
    ranges before hold is a small table. So no task sees more than a range, however few keys.
    n: what a value counts, its rows if not given; for values that are counted already.
    Rows without a value or a key take no part.
    """
    also, n = also or {}, F.count(F.lit(1)) if n is None else n
    names = ("n", *also)
    counts = written(values.dropna(subset=["v", *keys]).groupBy(*keys, "v").agg(n.alias("n"), *[c.alias(k) for k, c in also.items()]), "counts")
    parts = -(-counts.count() // RANGE)
    upto = lambda k: "upto" if k == "n" else f"upto_{k}"
    key = Window.partitionBy(*keys)
    if parts <= 1:
        out = counts.select("*", *[F.sum(k).over(key.orderBy("v")).alias(upto(k)) for k in names], F.sum("n").over(key).alias("of"))
    else:
        cuts = sorted(set(counts.stat.approxQuantile("v", [k / parts for k in range(1, parts)], min(0.001, 0.25 / parts))))
        ranged = counts.withColumn("_part", range_of(F.col("v"), cuts))
        sums = ranged.groupBy(*keys, "_part").agg(*[F.sum(k).alias(f"_{k}") for k in names])  # keys times parts
        before = sums.select(*keys, "_part", *[(F.sum(f"_{k}").over(key.orderBy("_part")) - F.col(f"_{k}")).alias(f"_before_{k}") for k in names], F.sum("_n").over(key).alias("of"))
        within = Window.partitionBy(*keys, "_part").orderBy("v")
        out = ranged.select("*", *[F.sum(k).over(within).alias(f"_within_{k}") for k in names]).join(before, [*keys, "_part"])
        out = out.withColumns({upto(k): F.col(f"_before_{k}") + F.col(f"_within_{k}") for k in names})
    return out.select(*keys, "v", "n", *map(upto, names), "of", (F.col("upto") - F.col("n") + (F.col("n") + 1) / 2).alias("midrank"))


def midranks(values: DataFrame, n: Column | None = None) -> DataFrame:
    """The same without keys."""
    return midranks_by(values.withColumn("_all", F.lit(0)), ("_all",), n=n).drop("_all", "of")


def quantiles(values: DataFrame, shares: dict[str, float], keys: tuple[str, ...] = ("grp",)) -> DataFrame:
    """keys, n and each share's quantile of v (type 7: between the two nearest places), from counted values."""
    ranks = midranks_by(values, keys)
    place = {c: (F.col("of") - 1) * F.lit(float(p)) for c, p in shares.items()}
    picks = [F.min(F.when(F.col("upto") > end(x), F.col("v"))).alias(f"_{c}_{k}") for c, x in place.items() for k, end in enumerate((F.floor, F.ceil))]
    both = ranks.groupBy(*keys).agg(F.max("of").alias("of"), *picks)
    at = {c: F.when(F.floor(x) == F.ceil(x), F.col(f"_{c}_0")).otherwise((F.ceil(x) - x) * F.col(f"_{c}_0") + (x - F.floor(x)) * F.col(f"_{c}_1")) for c, x in place.items()}
    return both.select(*keys, F.col("of").alias("n"), *[x.alias(c) for c, x in at.items()])
