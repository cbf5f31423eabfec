"""Hypothesis tests. Spark gives moments, counts and ranks; the driver turns a handful of sums into a result."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strata.functions.distributions import chi_square_tail, kolmogorov_tail, normal_below, t_critical, t_two_sided
from strata.operators.groups import crosstab, pairs
from strata.operators.ranks import midranks, midranks_by
from strata.session import written


def chosen(df: DataFrame, column: str, by: str, groups: list[str]) -> DataFrame:
    return pairs(df, column, by).where(F.col("grp").isin(*groups))


def welch_t(df: DataFrame, column: str, by: str, groups: list[str]) -> dict:
    """t, df, p, the 95 % interval of the difference and Cohen's d; null statistics without variance."""
    rows = {r["grp"]: r for r in chosen(df, column, by, groups).groupBy("grp").agg(F.count(F.lit(1)).alias("n"), F.avg("v").alias("m"), F.var_samp("v").alias("s")).collect()}
    a, b = (rows.get(g) for g in groups)
    out = {"test": "t", "groups": groups, "n": [r["n"] if r else 0 for r in (a, b)], "statistic": None, "df": None, "p": None, "ci": None, "effect": None}
    if not (a and b) or a["n"] < 2 or b["n"] < 2 or a["s"] + b["s"] == 0:
        return out
    va, vb = a["s"] / a["n"], b["s"] / b["n"]
    t, free = (a["m"] - b["m"]) / math.sqrt(va + vb), (va + vb) ** 2 / (va**2 / (a["n"] - 1) + vb**2 / (b["n"] - 1))
    half = t_critical(free) * math.sqrt(va + vb)
    pooled = math.sqrt(((a["n"] - 1) * a["s"] + (b["n"] - 1) * b["s"]) / (a["n"] + b["n"] - 2))
    return out | {"statistic": t, "df": free, "p": t_two_sided(t, free), "ci": [a["m"] - b["m"] - half, a["m"] - b["m"] + half], "effect": (a["m"] - b["m"]) / pooled}


def rank_sums(df: DataFrame, column: str, by: str, groups: list[str]) -> tuple[DataFrame, DataFrame]:
    """(grp, n, rank_sum), and (n, tie_term); the ranks are over all chosen groups."""
    rows = chosen(df, column, by, groups)
    ranks = written(midranks(rows), "ranks")
    counted = rows.groupBy("grp", "v").agg(F.count(F.lit(1)).alias("k"))
    sums = counted.join(ranks.select("v", "midrank"), "v").groupBy("grp").agg(F.sum("k").alias("n"), F.sum(F.col("k") * F.col("midrank")).alias("rank_sum"))
    t = F.col("n").cast("double")
    return sums, ranks.agg(F.sum("n").alias("n"), F.sum(t * t * t - t).alias("tie_term"))


def mann_whitney(df: DataFrame, column: str, by: str, groups: list[str]) -> dict:
    """U of the first group, normal p corrected for ties, and the rank-biserial correlation (1: the first is lower throughout)."""
    sums, ties = rank_sums(df, column, by, groups)
    by_group = {r["grp"]: r for r in sums.collect()}
    tie = ties.first()
    n1, n2 = (by_group[g]["n"] if g in by_group else 0 for g in groups)
    out = {"test": "mann_whitney", "groups": groups, "n": [n1, n2], "statistic": None, "p": None, "effect": None}
    if not n1 or not n2:
        return out
    u = by_group[groups[0]]["rank_sum"] - n1 * (n1 + 1) / 2
    n = n1 + n2
    var = n1 * n2 / 12 * ((n + 1) - tie["tie_term"] / (n * (n - 1)))
    p = 2 * (1 - normal_below(abs(u - n1 * n2 / 2) / math.sqrt(var))) if var > 0 else None
    return out | {"statistic": u, "p": p, "effect": 1 - 2 * u / (n1 * n2)}


def kruskal_wallis(df: DataFrame, column: str, by: str, groups: list[str]) -> dict:
    """H corrected for ties, its chi-square p, and epsilon squared."""
    sums, ties = rank_sums(df, column, by, groups)
    rows, tie = sums.collect(), ties.first()
    n = sum(r["n"] for r in rows)
    out = {"test": "kruskal_wallis", "groups": groups, "n": [r["n"] for r in rows], "statistic": None, "df": len(rows) - 1, "p": None, "effect": None}
    fix = 1 - tie["tie_term"] / (n**3 - n) if n > 1 else 0
    if len(rows) < 2 or fix <= 0:
        return out
    h = (12 / (n * (n + 1)) * sum(r["rank_sum"] ** 2 / r["n"] for r in rows) - 3 * (n + 1)) / fix
    return out | {"statistic": h, "p": chi_square_tail(h, len(rows) - 1), "effect": h / (n - 1)}


def ks_distance(df: DataFrame, column: str, by: str, groups: list[str]) -> DataFrame:
    """d, location (the smallest value with the largest distance), n1 and n2; from one count of values by sample."""
    both = chosen(df, column, by, groups).withColumn("_all", F.lit(0))
    ranks = midranks_by(both, ("_all",), {"a": F.count_if(F.col("grp") == groups[0])})
    n1, of = ranks.agg(F.max("upto_a"), F.max("of")).first()
    n1, n2 = n1 or 0, (of or 0) - (n1 or 0)
    d = F.abs(F.try_divide("upto_a", F.lit(n1)) - F.try_divide(F.col("upto") - F.col("upto_a"), F.lit(n2)))
    told = ranks.select("v", d.alias("d"))
    return told.agg(F.max("d").alias("d"), F.max_by("v", F.struct("d", -F.col("v"))).alias("location"), F.lit(n1).alias("n1"), F.lit(n2).alias("n2"))


def ks(df: DataFrame, column: str, by: str, groups: list[str]) -> dict:
    """D, where it lies, and the asymptotic p with Stephens' adjustment."""
    r = ks_distance(df, column, by, groups).first()
    out = {"test": "ks", "groups": groups, "n": [r["n1"] or 0, r["n2"] or 0], "statistic": r["d"], "location": r["location"], "p": None}
    if r["d"] is None:
        return out
    en = math.sqrt(r["n1"] * r["n2"] / (r["n1"] + r["n2"]))
    return out | {"p": kolmogorov_tail((en + 0.12 + 0.11 / en) * r["d"])}


def few_expected(rows: DataFrame, cols: DataFrame, of: int) -> int:
    """How many pairs of levels expect under five, from how many levels there are of each size.

    There are fewer than sqrt(2 of) different sizes.
    """
    sizes = [t.groupBy(F.col(c).alias("s")).count().toPandas().sort_values("s") for t, c in ((rows, "a_n"), (cols, "b_n"))]
    (r, times), (c, each) = ((s["s"].to_numpy(np.int64), s["count"].to_numpy(np.int64)) for s in sizes)
    below = np.append(0, np.cumsum(each))
    return int((times * below[np.searchsorted(c, -(-5 * of // r))]).sum()) if of else 0


def chi_square(df: DataFrame, a: str, b: str, levels: tuple[list[str], list[str]] | None = None) -> dict:
    """Pearson's statistic without correction, its p, Cramér's V and how many cells expect under five."""
    counts = crosstab(df, a, b)
    if levels:
        counts = counts.where(F.col("a").isin(*levels[0]) & F.col("b").isin(*levels[1]))
    counts = written(counts, "crosstab")
    rows, cols = (counts.groupBy(c).agg(F.sum("n").alias(f"{c}_n")) for c in "ab")
    total = counts.agg(F.sum("n").alias("of"))
    # Cells that are empty add their expectation, and all expectations add up to n: so only cells with rows are needed.
    of = total.first()["of"] or 0
    expected = F.col("a_n") * F.col("b_n") / of
    cells = counts.join(rows, "a").join(cols, "b") if of else counts.withColumns({"a_n": F.lit(1), "b_n": F.lit(1)})
    some = cells.agg(F.sum((F.col("n") - expected) ** 2 / expected - expected if of else F.lit(0.0)).alias("x")).first()
    one = {"x": (some["x"] or 0.0) + of, "n": of, "r": rows.count(), "c": cols.count(), "low": few_expected(rows, cols, of)}
    free = (one["r"] - 1) * (one["c"] - 1)
    out = {"test": "chi_square", "n": one["n"] or 0, "statistic": None, "df": free, "p": None, "effect": None, "low_expected": one["low"]}
    if free < 1:
        return out
    return out | {"statistic": one["x"], "p": chi_square_tail(one["x"], free), "effect": math.sqrt(one["x"] / (one["n"] * min(one["r"] - 1, one["c"] - 1)))}


def run(df: DataFrame, test: str, column: str, by: str, groups: list[str], levels: list[str] | None = None) -> dict:
    """The test of a plan, on the groups in the plan's order."""
    if test == "chi_square":
        return chi_square(df, column, by, (levels, groups) if levels is not None else None)
    return {"t": welch_t, "mann_whitney": mann_whitney, "kruskal_wallis": kruskal_wallis, "ks": ks}[test](df, column, by, groups)


def told(result: dict) -> str:
    """A result in a line."""
    shown = lambda x: "n/a" if x is None else f"{x:.4g}" if isinstance(x, float) else ", ".join(map(shown, x)) if isinstance(x, list) else str(x)
    return "; ".join(f"{k} {shown(v)}" for k, v in result.items())
