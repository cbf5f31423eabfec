"""Daily series of a stream: the line chart's points, each given out once its day is over."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strata.functions.values import label, moment, number

#: What a running aggregate can give without keeping a day's values.
AGGREGATES = {"mean": F.avg, "sum": F.sum, "count": F.count}


def daily(stream: DataFrame, x: str, column: str, agg: str = "mean", by: str | None = None, late: str = "1 day") -> DataFrame:
    """grp, day and value of each finished UTC day; rows later than `late` are left out.

    State is one running aggregate for each open day and group.
    """
    grp = F.lit(column) if by is None else label(stream, by)
    rows = stream.select(grp.alias("grp"), moment(stream, x).alias("at"), number(stream, column).alias("v"))
    rows = rows.where(F.col("grp").isNotNull() & F.col("v").isNotNull() & F.col("at").isNotNull()).withWatermark("at", late)
    value = AGGREGATES[agg]("v").cast("double").alias("value")
    return rows.groupBy("grp", F.window("at", "1 day").alias("w")).agg(value).select("grp", F.to_date("w.start").alias("day"), "value")
