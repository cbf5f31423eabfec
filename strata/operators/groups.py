"""Group comparison, crosstabs and midranks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from strata.functions.values import label, natural, number
from strata.operators.profile import FLOOR
from strata.operators.ranks import midranks
from strata.operators.transfer import with_rows
from strata.session import written


def pairs(df: DataFrame, column: str, by: str) -> DataFrame:
    """grp and v of the rows that have both."""
    return df.select(label(df, by).alias("grp"), number(df, column).alias("v")).where(F.col("grp").isNotNull() & F.col("v").isNotNull())


def compare(df: DataFrame, column: str, by: str) -> DataFrame:
    """grp, n, mean and sd (sample; null for one row) of each group."""
    return pairs(df, column, by).groupBy("grp").agg(F.count(F.lit(1)).alias("n"), F.avg("v").alias("mean"), F.stddev_samp("v").alias("sd"))


def effect(df: DataFrame, column: str, by: str) -> DataFrame:
    """n, mean, sd, n_groups, min_group_n, singletons, eta_squared and omega_squared, from group moments in one shuffle."""
    parts = pairs(df, column, by).groupBy("grp").agg(F.count(F.lit(1)).alias("n"), F.avg("v").alias("m"), F.var_pop("v").alias("var"))
    totals = parts.agg(
        F.sum("n").alias("n"), (F.sum(F.col("n") * F.col("m")) / F.sum("n")).alias("mean"), F.count(F.lit(1)).alias("n_groups"), F.min("n").alias("min_group_n"),
        F.count_if(F.col("n") == 1).alias("singletons"), F.sum(F.col("n") * F.col("var")).alias("within"),
    )
    # The squared distances of group means need the overall mean, so they come from a second look at the groups.
    between = parts.join(F.broadcast(totals.select(F.col("mean").alias("_mean")))).agg(F.sum(F.col("n") * (F.col("m") - F.col("_mean")) ** 2).alias("between"))
    both = totals.join(F.broadcast(between))
    total = F.col("between") + F.col("within")
    left = F.col("n") - F.col("n_groups")
    ms = F.when(left > 0, F.try_divide(F.col("within"), left))
    return both.select(
        "n", "mean", F.when(F.col("n") > 1, F.sqrt(F.try_divide(total, F.col("n") - 1))).alias("sd"), "n_groups", "min_group_n", "singletons",
        F.when(total > 0, F.try_divide(F.col("between"), total)).alias("eta_squared"),
        F.when(total + ms > 0, F.try_divide(F.col("between") - (F.col("n_groups") - 1) * ms, total + ms)).alias("omega_squared"),
    )


def report(df: DataFrame, column: str, by: str, open_data: bool = False) -> dict:
    """ok, or a reason why the grouping is refused; the groups that may be shown (a DataFrame, all of them); how many are withheld; caveats."""
    from strata.functions.names import is_identifier

    whole = effect(df, column, by).first()
    if not whole["n"]:
        return {"ok": False, "message": "no complete observations"}
    if whole["n_groups"] >= whole["n"] or whole["n_groups"] > whole["n"] / 2:
        return {"ok": False, "message": f'"{by}" has {whole["n_groups"]} values over {whole["n"]} observations, so it identifies rows rather than groups them'}
    if not open_data and is_identifier(by):
        return {"ok": False, "message": f'"{by}" is an identifier'}
    groups = written(compare(df, column, by), "groups")
    shown = groups if open_data else groups.where(F.col("n") >= FLOOR)
    one = shown.agg(F.count(F.lit(1)).alias("groups"), F.min("n").alias("least")).first()
    if not one["groups"]:
        return {"ok": False, "message": f'"{by}" has no value with enough rows'}
    least = one["least"]
    caveats = [c for c, on in (("some groups have one observation and no standard deviation", open_data and whole["singletons"]), (f"the smallest group listed has n={least}, so its mean is unstable", least < 30), ("eta-squared is inflated by the number of groups; omega-squared corrects for it", whole["omega_squared"] is not None and whole["eta_squared"] - whole["omega_squared"] > 0.05)) if on]
    return {"ok": True, "groups": shown.orderBy(F.desc("mean"), "grp"), "overall": whole, "withheld_groups": whole["n_groups"] - one["groups"], "caveats": caveats}


def crosstab(df: DataFrame, a: str, b: str, blank: str | None = None) -> DataFrame:
    """a, b and n of every pair of labels that occurs; blank names missing labels, else they are left out."""
    x, y = (F.coalesce(label(df, c), F.lit(blank)) if blank is not None else label(df, c) for c in (a, b))
    rows = df.select(x.alias("a"), y.alias("b"))
    return rows.where(F.col("a").isNotNull() & F.col("b").isNotNull()).groupBy("a", "b").agg(F.count(F.lit(1)).alias("n"))


def filled(counts: DataFrame) -> DataFrame:
    """A crosstab with its zeros, which has a row for every pair of levels; the counts are written, so their size is known to the join."""
    counts = written(counts, "crosstab")
    return counts.select("a").distinct().crossJoin(counts.select("b").distinct()).join(counts, ["a", "b"], "left").fillna(0, ["n"])


def heat_map(df: DataFrame, cluster: str, attribute: str, per: str = "cluster") -> DataFrame:
    """a (cluster), b (attribute), n and share of the row total, of clusters or of attribute values."""
    counts = filled(crosstab(df, cluster, attribute, "N/A"))
    total = F.sum("n").over(Window.partitionBy("a" if per == "cluster" else "b"))
    return counts.withColumn("share", F.coalesce(F.try_divide("n", total), F.lit(0.0)))


def breakdown(df: DataFrame, cluster: str, attribute: str, open_data: bool = False, top: int = 6) -> DataFrame:
    """The most frequent attribute values of each cluster; of private data only those with FLOOR rows."""
    counts = crosstab(df, cluster, attribute, "N/A")
    counts = counts if open_data else counts.where(F.col("n") >= FLOOR)
    return counts.withColumn("rank", F.row_number().over(Window.partitionBy("a").orderBy(F.desc("n"), "b"))).where(F.col("rank") <= top)


def sizes(df: DataFrame, cluster: str = "Cluster") -> DataFrame:
    """value and n of each cluster, rows without one left out."""
    return df.select(label(df, cluster).alias("value")).where(F.col("value").isNotNull()).groupBy("value").agg(F.count(F.lit(1)).alias("n"))


def palette(df: DataFrame, column: str) -> DataFrame:
    """value, n and index: the labels in natural order (digits by value, Noise last), numbered from 0 without gaps."""
    return with_rows(sizes(df, column), natural(F.col("value"))).withColumnRenamed("_row", "index")


def correlation(df: DataFrame, a: str, b: str) -> DataFrame:
    """n, pearson and spearman of the rows that have both numbers; null under three rows or without variance.

    Equal pairs are counted first, so what meets the ranks is a row for each different pair,
    however many rows have it.
    """
    both = df.select(number(df, a).alias("x"), number(df, b).alias("y")).where(F.col("x").isNotNull() & F.col("y").isNotNull())
    pairs = written(both.groupBy("x", "y").agg(F.count(F.lit(1)).alias("k")), "pairs")
    weighted = lambda e: F.sum(F.col("k") * e)
    one = pairs.agg(F.coalesce(F.sum("k"), F.lit(0)).alias("n"), *[F.try_divide(weighted(F.col(c)), F.sum("k")).alias(c) for c in ("x", "y")]).first()
    middle = {"x": one["x"], "y": one["y"], "rx": (one["n"] + 1) / 2, "ry": (one["n"] + 1) / 2}
    ranked = pairs
    for c in ("x", "y"):
        rank = midranks(pairs.select(F.col(c).alias("v"), "k"), F.sum("k")).select(F.col("v").alias(c), F.col("midrank").alias(f"r{c}"))
        ranked = ranked.join(rank, c)

    def of(x: str, y: str):
        dx, dy = (F.col(c) - F.lit(middle[c]).cast("double") for c in (x, y))
        vary = (F.min(x) < F.max(x)) & (F.min(y) < F.max(y))
        return F.when(vary & F.lit(one["n"] >= 3), F.try_divide(weighted(dx * dy), F.sqrt(weighted(dx * dx)) * F.sqrt(weighted(dy * dy))))

    return ranked.agg(F.lit(one["n"]).cast("long").alias("n"), of("x", "y").alias("pearson"), of("rx", "ry").alias("spearman"))
