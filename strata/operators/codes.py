"""Missing-value codes: numbers such as -99 that stand apart from a column's own values.

The whole scan is over counts of (column, value): one shuffle with partial counts, after
which nothing depends on the number of rows.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strata.functions.values import number
from strata.operators.profile import long_form

# The numbers that may be codes.
CANDIDATES = [
    -1111, -999999, -99999, -9999, -999, -99, -9, -8, -7, -6, -5, -4, -3,
    9, 66, 77, 88, 97, 98, 99, 777, 888, 997, 998, 999, 6666, 7777, 8888, 9997, 9998, 9999,
    99999, 999999,
]
LEAST_ROWS, LEAST_CORE, LEVELS, GAP, FAR, SHARE, LIFT, PAIRS = 8, 2, 20, 0.5, 3.0, 0.05, 3.0, 3


def counted(df: DataFrame, columns: list[str]) -> DataFrame:
    """column_name, value and n of every number."""
    return long_form(df, columns, number).where(F.col("value").isNotNull()).groupBy("column_name", "value").agg(F.count(F.lit(1)).alias("n"))


def found(df: DataFrame, columns: list[str], counts: DataFrame | None = None) -> DataFrame:
    """column_name, value, n, numbers, confidence (certain, likely, possible) and reasons.

    A candidate is reported if it is negative where nothing else is, lies further from the
    other values than half their spread, or leaves a hole of two or more in a short
    integer scale.
    """
    counts = counted(df, columns) if counts is None else counts
    marked = counts.withColumn("candidate", F.col("value").isin(*map(float, CANDIDATES)))
    core = lambda c: F.when(~F.col("candidate"), c)
    about = marked.groupBy("column_name").agg(
        F.sum("n").alias("numbers"), F.sum(core(F.col("n"))).alias("core_n"), F.min(core(F.col("value"))).alias("lo"), F.max(core(F.col("value"))).alias("hi"),
        F.bool_and(core(F.col("value") == F.floor("value"))).alias("whole"), F.count(core(F.col("value"))).alias("levels"),
    )
    rows = marked.where("candidate").join(about, "column_name").where((F.col("numbers") >= LEAST_ROWS) & (F.col("core_n") >= LEAST_CORE))
    gap, spread = F.when(F.col("value") < F.col("lo"), F.col("lo") - F.col("value")).when(F.col("value") > F.col("hi"), F.col("value") - F.col("hi")).otherwise(0.0), F.col("hi") - F.col("lo")
    sign = (F.col("value") < 0) & (F.col("lo") >= 0)
    apart = gap > spread * GAP
    hole = F.col("whole") & (F.col("levels") <= LEVELS) & (gap >= 2)
    reasons = F.array_compact(F.array(F.when(sign, "impossible-sign"), F.when(apart, "far-outside"), F.when(hole, "scale-hole")))
    confidence = F.when(sign | F.coalesce(F.try_divide(gap, spread) >= FAR, F.lit(False)), "certain").when(F.col("n") / F.col("numbers") >= SHARE, "likely").otherwise("possible")
    return rows.where(sign | apart | hole).select("column_name", "value", "n", "numbers", confidence.alias("confidence"), reasons.alias("reasons"))


def together(df: DataFrame, columns: list[str], values: list[float]) -> DataFrame:
    """column_name, value, peers, observed, expected, lift and supports: whether a code falls on the rows where other columns have it.

    A row is an array of the columns that hold the value, so it never meets another row.
    """
    cells = F.array(*[F.struct(F.lit(c).alias("column_name"), number(df, c).alias("value")) for c in columns])
    each = F.array(*[F.struct(F.lit(float(v)).alias("value"), F.transform(F.filter("_cells", holds(v)), lambda x: x["column_name"]).alias("names")) for v in values])
    rows = df.select(cells.alias("_cells")).select(F.inline(each)).where(F.size("names") > 0)
    hit = rows.select("value", (F.size("names") - 1).alias("more"), F.explode("names").alias("column_name"))
    per = hit.groupBy("value", "column_name").agg(F.count(F.lit(1)).alias("n"), F.sum("more").alias("observed"))
    whole = per.groupBy("value").agg(F.sum("n").alias("total"), F.count(F.lit(1)).alias("holders"))
    n_rows = df.agg(F.count(F.lit(1)).alias("n_rows"))
    both = per.join(whole, "value").where(F.col("holders") > 1).crossJoin(F.broadcast(n_rows)).where(F.col("n_rows") >= LEAST_ROWS)
    expected = F.col("n") * (F.col("total") - F.col("n")) / F.col("n_rows")
    lift = F.when(expected > 0, F.try_divide(F.col("observed"), expected)).otherwise(0.0)
    return both.select("column_name", "value", (F.col("holders") - 1).alias("peers"), "observed", expected.alias("expected"), lift.alias("lift"), ((F.col("observed") >= PAIRS) & (lift >= LIFT)).alias("supports"))


def holds(v: float):
    return lambda x: x["value"] == F.lit(float(v))


def scanned(df: DataFrame, columns: list[str], declared: list[float] | None = None) -> DataFrame:
    """found() and declared codes in one table, a step more confident where rows coincide.

    column_name, value, n, confidence (null for a code that is only declared), reasons,
    declared, lift and suggested; the surest first.
    """
    counts = counted(df, columns)
    codes = found(df, columns, counts).select("column_name", "value", "n", "confidence", "reasons")
    named = [float(v) for v in declared or []]
    extra = counts.where(F.col("value").isin(*named)).select("column_name", "value", "n") if named else None
    values = sorted({r["value"] for r in codes.select("value").distinct().collect()} | set(named))  # at most the candidates and the declared
    both = codes if extra is None else codes.join(extra.withColumnRenamed("n", "_n"), ["column_name", "value"], "full").withColumn("n", F.coalesce("n", "_n")).drop("_n")
    if values:
        both = both.join(together(df, columns, values), ["column_name", "value"], "left")
    else:
        both = both.withColumns({"lift": F.lit(None).cast("double"), "supports": F.lit(None).cast("boolean")})
    up = F.coalesce("supports", F.lit(False))
    raised = F.when(up & (F.col("confidence") == "possible"), "likely").when(up & F.col("confidence").isNotNull(), "certain").otherwise(F.col("confidence"))
    told = both.select("column_name", "value", "n", raised.alias("confidence"), F.when(up & F.col("confidence").isNotNull(), F.array_append("reasons", F.lit("co-occurs"))).otherwise(F.col("reasons")).alias("reasons"), F.col("value").isin(*named).alias("declared") if named else F.lit(False).alias("declared"), "lift", up.alias("supports"))
    tier = F.when(F.col("confidence") == "certain", 0).when(F.col("confidence") == "likely", 1).when(F.col("confidence") == "possible", 2).otherwise(3)
    place = reduce(lambda a, k: F.when(F.col("column_name") == columns[k], k).otherwise(a), range(len(columns)), F.lit(len(columns)))
    return told.withColumn("suggested", F.coalesce(F.col("confidence").isin("certain", "likely"), F.lit(False)) | F.col("supports")).orderBy(tier, place, F.desc("n"), "value")


def told(rows: list) -> list[str]:
    """A sentence for each column of scanned()'s rows."""
    by: dict[str, list[str]] = {}
    for r in rows:
        by.setdefault(r["column_name"], []).append(f"{r['value']:g} ({r['n']} rows, {r['confidence'] or 'declared'})")
    return [f"{c}: {', '.join(x)} may stand for missing values; blank them before analysing if so." for c, x in by.items()]
