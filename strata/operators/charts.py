"""The aggregates behind seven chart types; each returns a DataFrame of what would be drawn."""

from __future__ import annotations

import math
from statistics import NormalDist

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strata.functions.distributions import normal_quantile
from strata.functions.values import day, label, number, rounded
from strata.operators.profile import FLOOR
from strata.operators.ranks import midranks_by, quantiles
from strata.session import written

#: Bandwidths beyond which a value adds nothing to a density.
BAND = 9.0


def series(df: DataFrame, column: str, by: str | None = None, groups: list[str] | None = None) -> DataFrame:
    """grp and v: numbers of the visible groups, or of all rows under the column's own name."""
    grp = F.lit(column) if by is None else label(df, by)
    rows = df.select(grp.alias("grp"), number(df, column).alias("v")).where(F.col("v").isNotNull() & F.col("grp").isNotNull())
    return rows if groups is None else rows.where(F.col("grp").isin(*groups))


def five_numbers(s: DataFrame) -> DataFrame:
    """grp, n, and minimum, quartiles and maximum (type 7), to three places."""
    shares = {"lo": 0.0, "q1": 0.25, "med": 0.5, "q3": 0.75, "hi": 1.0}
    return quantiles(s, shares).select("grp", "n", *[rounded(F.col(c)).alias(c) for c in shares])


def ecdf(s: DataFrame) -> DataFrame:
    """grp, v and share: the steps of the cumulative share, one for each different value."""
    return midranks_by(s).select("grp", "v", (F.col("upto") / F.col("of")).alias("share"))


def bins_for(n: int) -> int:
    return max(5, math.ceil(math.log2(max(2, n)) + 1))


def histogram(s: DataFrame, bins: int | None = None) -> DataFrame:
    """grp, bin, lo, hi and n over edges that all groups share; the maximum is in the last bin, a constant has width 1."""
    one = s.agg(F.min("v").alias("lo"), F.max("v").alias("hi"), F.count(F.lit(1)).alias("n")).first()
    n = bins or bins_for(one["n"])
    lo = float(one["lo"] if one["lo"] is not None else 0.0)
    width = (one["hi"] - one["lo"]) / n if one["n"] and one["hi"] > one["lo"] else 1.0
    at = F.least(F.lit(n - 1), F.floor((F.col("v") - lo) / width)).cast("int")
    return s.groupBy("grp", at.alias("bin")).agg(F.count(F.lit(1)).alias("n")).select("grp", "bin", (F.lit(lo) + F.col("bin") * width).alias("lo"), (F.lit(lo) + (F.col("bin") + 1) * width).alias("hi"), "n")


def quartiles(s: DataFrame) -> DataFrame:
    """grp, q1, med and q3, written so that a small table is known to be one."""
    return written(quantiles(s, {"q1": 0.25, "med": 0.5, "q3": 0.75}).drop("n"), "quartiles")


def box(s: DataFrame) -> DataFrame:
    """grp, q1, med, q3, whisker_lo, whisker_hi (extreme values within 1.5 interquartile ranges) and n_outliers."""
    reach = (F.col("q3") - F.col("q1")) * 1.5
    inside = (F.col("v") >= F.col("q1") - reach) & (F.col("v") <= F.col("q3") + reach)
    both = s.join(quartiles(s), "grp")
    return both.groupBy("grp", "q1", "med", "q3").agg(F.min(F.when(inside, F.col("v"))).alias("whisker_lo"), F.max(F.when(inside, F.col("v"))).alias("whisker_hi"), F.count_if(~inside).alias("n_outliers"))


def outliers(s: DataFrame) -> DataFrame:
    reach = (F.col("q3") - F.col("q1")) * 1.5
    return s.join(quartiles(s), "grp").where((F.col("v") < F.col("q1") - reach) | (F.col("v") > F.col("q3") + reach)).select("grp", "v")


def violin(s: DataFrame, points: int = 60) -> DataFrame:
    """grp, i, x and density: a Gaussian kernel density on a grid from two bandwidths below to two above.

    Equal values count once with their number, and each meets only the points within BAND
    bandwidths of it: beyond, the kernel is under 1e-17 of its height.
    """
    shape = s.groupBy("grp").agg(F.stddev_samp("v").alias("sd"), F.min("v").alias("lo"), F.max("v").alias("hi")).join(quantiles(s, {"q1": 0.25, "q3": 0.75}), "grp")
    spread = F.least(F.when(F.col("sd") > 0, F.col("sd")), F.when(F.col("q3") > F.col("q1"), (F.col("q3") - F.col("q1")) / 1.34))
    shape = shape.select("grp", "n", F.coalesce(0.9 * spread * F.pow(F.col("n").cast("double"), F.lit(-0.2)), F.lit(1.0)).alias("h"), "lo", "hi")
    shape = written(shape.select("grp", "n", "h", (F.col("lo") - 2 * F.col("h")).alias("first"), ((F.col("hi") - F.col("lo") + 4 * F.col("h")) / (points - 1)).alias("step")), "shape")
    x = lambda i: F.col("first") + F.col("step") * (points - 1) * F.col(i) / (points - 1)
    place = (F.col("v") - F.col("first")) / F.col("step")
    reach = F.lit(BAND) * F.col("h") / F.col("step")
    inside = F.sequence(F.greatest(F.ceil(place - reach), F.lit(0)).cast("int"), F.least(F.floor(place + reach), F.lit(points - 1)).cast("int"))
    counts = s.groupBy("grp", "v").agg(F.count(F.lit(1)).alias("k")).join(shape, "grp").where(F.ceil(place - reach) <= F.floor(place + reach))
    near = counts.select("grp", "v", "k", "h", "first", "step", F.explode(inside).alias("i"))
    z = (x("i") - F.col("v")) / F.col("h")
    sums = near.groupBy("grp", "i").agg(F.sum(F.col("k") * F.exp(-z * z / 2)).alias("s"))
    grid = shape.withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(points - 1)))).join(sums, ["grp", "i"], "left")
    return grid.select("grp", "i", x("i").alias("x"), (F.coalesce("s", F.lit(0.0)) / (F.col("n") * F.col("h") * math.sqrt(2 * math.pi))).alias("density"))


def qq(s: DataFrame) -> DataFrame:
    """grp, v, n (rows with the value) and theoretical: the normal quantile at the middle of the value's places."""
    @F.pandas_udf("double")
    def quantile(p: pd.Series) -> pd.Series:
        return pd.Series(np.frompyfunc(NormalDist().inv_cdf, 1, 1)(p.to_numpy()).astype(float))

    middle = (F.col("upto") - F.col("n") / 2) / F.col("of")
    return midranks_by(s).select("grp", "v", "n", quantile(middle).alias("theoretical"))


def qq_line(s: DataFrame) -> DataFrame:
    """grp, slope and intercept of the line through the quartiles, and the deciles."""
    high = normal_quantile(0.75)
    slope = (F.col("q3") - F.col("q1")) / (2 * high)
    shares = {"q1": 0.25, "q3": 0.75} | {f"d{k}": k / 10 for k in range(1, 10)}
    return quantiles(s, shares).withColumn("deciles", F.array(*[f"d{k}" for k in range(1, 10)])).select("grp", slope.alias("slope"), (F.col("q1") + slope * high).alias("intercept"), "deciles")


def bar(df: DataFrame, column: str, open_data: bool = False) -> DataFrame:
    """value and n; of private data values under FLOOR rows are pooled as (rare values)."""
    counts = df.select(label(df, column).alias("value")).where(F.col("value").isNotNull()).groupBy("value").agg(F.count(F.lit(1)).alias("n"))
    if open_data:
        return counts
    return counts.groupBy(F.when(F.col("n") < FLOOR, "(rare values)").otherwise(F.col("value")).alias("value")).agg(F.sum("n").alias("n"))


def line(df: DataFrame, x: str, column: str, agg: str = "mean", by: str | None = None, groups: list[str] | None = None) -> DataFrame:
    """grp, day and value: one point for each UTC day; rows without a date or number are left out."""
    grp = F.lit(column) if by is None else label(df, by)
    rows = df.select(grp.alias("grp"), day(df, x).alias("day"), number(df, column).alias("v")).where(F.col("day").isNotNull() & F.col("v").isNotNull() & F.col("grp").isNotNull())
    rows = rows if groups is None else rows.where(F.col("grp").isin(*groups))
    if agg == "median":  # from counted values, so that a day of any size is no single task
        return quantiles(rows, {"value": 0.5}, ("grp", "day")).select("grp", "day", "value")
    value = {"mean": F.avg("v"), "sum": F.sum("v"), "count": F.count("v").cast("double")}[agg]
    return rows.groupBy("grp", "day").agg(value.alias("value"))


def skipped(df: DataFrame, x: str, column: str) -> DataFrame:
    """How many rows line() leaves out for want of a date or a number."""
    return df.agg(F.count_if(day(df, x).isNull() | number(df, column).isNull()).alias("n_skipped"))


def visible_groups(by: str | None, profile: dict) -> list[str] | None:
    """The groups of a column that the profile shows; None without a column."""
    return [g["value"] for g in profile[by]["groups"] if not g["withheld"]] if by else None


def withheld(df: DataFrame, column: str, by: str, groups: list[str]) -> DataFrame:
    """withheld_rows: rows with a number whose group is not among the visible ones."""
    return series(df, column, by).agg(F.count_if(~F.col("grp").isin(*groups)).alias("withheld_rows"))


def compiled(df: DataFrame, plan: dict, profile: dict) -> dict:
    """data (what is drawn), summary (a line for each series), notes and withheld_rows of a checked chart plan."""
    mark, column, by = plan["mark"], plan["column"], plan.get("groupBy")
    out = {"data": drawn(df, plan, profile), "summary": "", "notes": [], "withheld_rows": 0}
    groups = visible_groups(by, profile)
    if by and (rare := sum(g["withheld"] for g in profile[by]["groups"])):
        out["withheld_rows"] = withheld(df, column, by, groups).first()["withheld_rows"]
        out["notes"].append(f"{rare} rare value(s) of {by} ({out['withheld_rows']} rows) are left out for privacy")
    if mark == "line":
        if n := skipped(df, plan["x"], column).first()["n_skipped"]:
            out["notes"].append(f"{n} row(s) without a date or a number are left out")
    elif mark != "bar":
        places = {g: k for k, g in enumerate(groups or [])}
        told = sorted(five_numbers(series(df, column, by, groups)).collect(), key=lambda r: places.get(r["grp"], 0))  # a row for each visible group
        out["summary"] = "\n".join(f"{r['grp']}: n={r['n']}, min={r['lo']:g}, q1={r['q1']:g}, median={r['med']:g}, q3={r['q3']:g}, max={r['hi']:g}" for r in told)
    return out


def drawn(df: DataFrame, plan: dict, profile: dict) -> DataFrame:
    """The data of a checked chart plan, with the groups that the profile shows."""
    mark, column, by = plan["mark"], plan["column"], plan.get("groupBy")
    groups = visible_groups(by, profile)
    if mark == "bar":
        open_data = not any(g["withheld"] for g in profile[column]["groups"])
        return bar(df, column, open_data)
    if mark == "line":
        return line(df, plan["x"], column, plan.get("agg", "mean"), by, groups)
    s = series(df, column, by, groups)
    if mark == "histogram":
        return histogram(s, plan.get("bins"))
    return {"ecdf": ecdf, "box": box, "violin": violin, "qq": qq}[mark](s)
