"""Profiles of columns, from their summaries or one grouped aggregate over their values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from strata.functions.names import is_component, is_derived, is_identifier
from strata.functions.values import DATE_LIKE, cleaned, kind_of, label, listed, number, parsed_bare, pattern, rounded, trimmed
from strata.operators.ranks import midranks_by
from strata.operators.summaries import Summary

#: Distinct numbers from which a column is continuous, distinct labels that a category may have,
#: and rows that a value must have to be shown of private data.
CONTINUOUS, CATEGORIES, FLOOR = 20, 50, 5


def long_form(df: DataFrame, columns: list[str], value) -> DataFrame:
    """column_name and value, a row for each cell; value maps (df, name) to a Column."""
    pairs = F.array(*[F.struct(F.lit(c).alias("column_name"), value(df, c).alias("value")) for c in columns])
    return df.select(F.inline(pairs))


def scan(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """column_name, missing, is_numeric, min_value, max_value, n_unique, kind.

    kind: continuous (numbers with more than 20 values), too-many (others with more than 50),
    else categorical; an empty column is categorical.
    """
    found = Summary(df, columns)
    counts, rows = found.exact(), []
    for c in found.names:
        x, typed = found.by[c], kind_of(df, c) == "number"
        rows.append((c, x["missing"], x["numbers"] > 0, x["lo"], x["hi"], counts[c], kind_by(typed, counts[c])))
    return df.sparkSession.createDataFrame(rows, "column_name string, missing long, is_numeric boolean, min_value double, max_value double, n_unique long, kind string")


def kind_by(typed: bool, n: int | None) -> str:
    """The kind of a column, numeric by type or not, with so many different values (None: more than CATEGORIES)."""
    n = CATEGORIES + 1 if n is None else n
    return "continuous" if typed and n > CONTINUOUS else "too-many" if not typed and n > CATEGORIES else "categorical"


def numeric_columns(df: DataFrame) -> list[str]:
    one = df.agg(*[F.coalesce(F.bool_or(number(df, c).isNotNull()), F.lit(False)).alias(c) for c in df.columns]).first()
    return [c for c in df.columns if one[c]]


def numeric_summary(df: DataFrame, columns: list[str], open_data: bool = False, keep: Column | None = None) -> DataFrame:
    """column_name, n, missing, mean, sd (population), q1, median, q3, lowest and highest, to 4 places.

    Private data shows an extreme only if FLOOR rows share it.
    """
    table = df if keep is None else df.where(keep)
    one = table.agg(*[F.struct(F.lit(c).alias("column_name"), F.count(number(df, c)).alias("n"), F.count_if(number(df, c).isNull()).alias("missing"), F.avg(number(df, c)).alias("mean"), F.stddev_pop(number(df, c)).alias("sd")).alias(f"c{k}") for k, c in enumerate(columns)])
    whole = one.select(F.inline(F.array(*[f"c{k}" for k in range(len(columns))])))
    ranks = midranks_by(long_form(table, columns, number).withColumnRenamed("value", "v"), ("column_name",))
    floor = 1 if open_data else FLOOR
    # The value at place min(n - 1, floor(p n)) in order.
    picks = [F.min(F.when(F.col("upto") > F.least(F.col("of") - 1, F.floor(F.col("of") * p)), F.col("v"))).alias(name) for name, p in (("q1", 0.25), ("median", 0.5), ("q3", 0.75))]
    ends = [F.when(by("n", "v") >= floor, end("v")).alias(name) for name, by, end in (("lowest", F.min_by, F.min), ("highest", F.max_by, F.max))]
    out = whole.join(ranks.groupBy("column_name").agg(*picks, *ends), "column_name", "left")
    return out.select("column_name", "n", "missing", *[rounded(F.col(c), 4).alias(c) for c in ("mean", "sd", "q1", "median", "q3", "lowest", "highest")])


def value_counts(df: DataFrame, columns: list[str]) -> DataFrame:
    """column_name, value and n of every label, missing ones left out."""
    return long_form(df, columns, label).where(F.col("value").isNotNull()).groupBy("column_name", "value").agg(F.count(F.lit(1)).alias("n"))


def categorical_summary(df: DataFrame, columns: list[str], open_data: bool = False, top: int = 8) -> DataFrame:
    """column_name, value, n and rank of the most frequent values; of private data only those with FLOOR rows."""
    counts = value_counts(df, columns)
    counts = counts if open_data else counts.where(F.col("n") >= FLOOR)
    rank = F.row_number().over(Window.partitionBy("column_name").orderBy(F.desc("n"), "value"))
    return counts.withColumn("rank", rank).where(F.col("rank") <= top)


def categories(df: DataFrame, column: str, most: int = 200) -> DataFrame:
    """value (cut to 200 characters) and n, the most frequent first."""
    # Missing cells are a group of number 0: a filter on the value would compute it twice.
    counts = df.select(listed(df, column).alias("value")).groupBy("value").agg(F.count("value").alias("n")).where(F.col("n") > 0)
    return counts.orderBy(F.desc("n"), "value").limit(most)


def analysis_profile(df: DataFrame, open_data: bool = False) -> dict[str, dict]:
    """What plans are checked against: name to roles and, for categories, groups of (value, n, withheld)."""
    found = Summary(df)
    kinds = {c: kind_by(kind_of(df, c) == "number", found.by[c]["n_values"]) for c in df.columns}
    groups = found.groups([c for c in df.columns if kinds[c] == "categorical"])
    out = {}
    for c in df.columns:
        x, secret = found.by[c], is_identifier(c)
        told = [{"value": v, "n": n, "withheld": not open_data and (secret or n < FLOOR)} for v, n in groups[c]] if c in groups else None
        temporal = x["filled"] > 0 and x["dates"] >= 0.8 * x["filled"]
        out[c] = {"numeric": x["numbers"] > 0, "categorical": c in groups, "temporal": temporal, "identifier": secret, "groups": told, "values": {g["value"] for g in told or [] if not g["withheld"]}}
    return out


def told_text(df: DataFrame, c: str) -> Column:
    """A cell's label as far as a diagnosis depends on it: of a number or time only that it is there."""
    kind = kind_of(df, c)
    if kind in ("number", "boolean"):
        return F.when(number(df, c).isNotNull(), F.lit("0"))
    return F.when(F.col(f"`{c}`").isNotNull(), F.lit("2000-01-01")) if kind == "time" else label(df, c)


def diagnosis(df: DataFrame) -> DataFrame:
    """column_name, non_null, numeric_now, numeric_after_fix, date_like, kind and patterns (most frequent first)."""
    cells = F.array(*[F.struct(F.lit(k).alias("k"), F.lit(kind_of(df, c) == "text").alias("is_text"), F.lit(kind_of(df, c) in ("text", "number", "boolean")).alias("may_be"), told_text(df, c).alias("text")) for k, c in enumerate(df.columns)])
    # Equal cells are told once, with their number: those of a column whose cells are no texts are all equal.
    long = df.select(F.inline(cells)).where(F.col("text").isNotNull()).groupBy("k", "is_text", "may_be", "text").agg(F.count(F.lit(1)).alias("n"))
    text, now = F.col("text"), F.col("now")
    # A number or time is told as one (told_text), so its label says whether it is a number now.
    read = F.when(now.isNull() & F.col("is_text"), F.struct(cleaned(text).alias("v"), trimmed(text).rlike(DATE_LIKE).alias("date")))
    told = long.withColumn("now", F.when(F.col("may_be"), parsed_bare(text))).withColumn("read", read).withColumn("p", F.when(F.col("read.v").isNotNull(), pattern(text)))
    strange = F.when(F.col("is_text"), F.col("read.v").isNull() & now.isNull()).otherwise(now.isNull())
    date = F.coalesce("read.date", F.when(~F.col("is_text"), trimmed(text).rlike(DATE_LIKE)), F.lit(False))
    counted = lambda c: F.coalesce(F.sum(F.when(c, F.col("n"))), F.lit(0))
    # A row for each column and pattern, whatever the number of rows.
    parts = told.groupBy("k", "p").agg(F.sum("n").alias("n"), counted(now.isNotNull()).alias("now"), counted(~strange).alias("fixed"), counted(strange & date).alias("dates"))
    named = df.sparkSession.createDataFrame(list(enumerate(df.columns)), "k int, column_name string")
    found = parts.groupBy("k").agg(*[F.sum(x).alias(y) for x, y in (("n", "non_null"), ("now", "numeric_now"), ("fixed", "numeric_after_fix"), ("dates", "date_like"))], F.collect_list(F.when(F.col("p").isNotNull(), F.struct("n", "p"))).alias("found"))
    rows = F.broadcast(named).join(found, "k", "left").fillna(0, ["non_null", "numeric_now", "numeric_after_fix", "date_like"]).orderBy("k")
    most = F.ceil(F.col("non_null") * 0.8)
    kind = F.when(F.col("non_null") == 0, "empty").when(F.col("numeric_now") > 0, "numeric").when(F.col("numeric_after_fix") >= F.greatest(F.lit(1), most), "fixable").when(F.col("date_like") >= most, "date-like").otherwise("text")
    ordered = F.transform(F.filter(F.sort_array("found", asc=False), lambda x: x["n"] > 0), lambda x: x["p"])
    return rows.select("column_name", "non_null", "numeric_now", "numeric_after_fix", "date_like", kind.alias("kind"), F.array_join(ordered, "; ").alias("patterns"))


def diagnosis_text(rows: list) -> str:
    """A sentence on the rows of diagnosis()."""
    by = {k: [r["column_name"] for r in rows if r["kind"] == k] for k in ("numeric", "fixable", "date-like")}
    out = [f"{len(by['numeric'])} numeric column(s)."] if by["numeric"] else []
    if by["fixable"]:
        out.append(f"Numbers written as formatted text, which can be cleaned: {', '.join(by['fixable'])}.")
    elif len(by["numeric"]) < 2:
        out.append("No column holds numbers, even as text, that could be an axis.")
        if by["date-like"]:
            out.append(f"Dates, which are no axis: {', '.join(by['date-like'])}.")
    return " ".join(out)


def with_numbers_cleaned(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.withColumns({c: F.coalesce(number(df, c), cleaned(label(df, c))) for c in columns if c in df.columns})


def sparkline(df: DataFrame, column: str, bins: int = 14) -> DataFrame:
    """bin and height (share of the fullest bin); no rows if there are under two values or only one."""
    cells = df.select(number(df, column).alias("v")).where(F.col("v").isNotNull())
    ends = cells.agg(F.min("v").alias("lo"), F.max("v").alias("hi"), F.count("v").alias("n")).where((F.col("n") > 1) & (F.col("hi") > F.col("lo")))
    placed = cells.join(F.broadcast(ends)).select(F.least(F.lit(bins - 1), F.floor((F.col("v") - F.col("lo")) * bins / (F.col("hi") - F.col("lo")))).cast("int").alias("bin"))
    counts = placed.groupBy("bin").count()
    return counts.join(F.broadcast(counts.agg(F.max("count").alias("top")))).select("bin", (F.col("count") / F.col("top")).alias("height"))


def shares(df: DataFrame, column: str, top: int = 6) -> DataFrame:
    """value, n and share of the most frequent values."""
    counts = value_counts(df, [column]).drop("column_name")
    return counts.join(F.broadcast(counts.agg(F.sum("n").alias("of")))).select("value", "n", (F.col("n") / F.col("of")).alias("share")).orderBy(F.desc("n"), "value").limit(top)


def widest_half_span(df: DataFrame, columns: list[str]) -> DataFrame:
    """The largest distance worth offering as a neighbourhood: half of the widest axis."""
    ends = df.agg(*[(F.max(number(df, c)) - F.min(number(df, c))).alias(f"s{k}") for k, c in enumerate(columns)])
    spans = F.array(*[F.col(f"s{k}") for k in range(len(columns))])
    return ends.select((F.array_max(spans) / 2).alias("half_span"))


def suggest_standardise(df: DataFrame, columns: list[str]) -> bool:
    """Whether axes differ so much in range (over 3 times) that they should be scaled; component scores never."""
    if all(map(is_component, columns)):
        return False
    ends = df.agg(*[(F.max(number(df, c)) - F.min(number(df, c))).alias(f"s{k}") for k, c in enumerate(columns)]).first()
    spans = [s for s in ends if s]
    return len(spans) > 1 and max(spans) / min(spans) > 3


def imputed_cells(df: DataFrame, columns: list[str]) -> DataFrame:
    """column_name, imputed (cells without a number) and total."""
    return long_form(df, columns, number).groupBy("column_name").agg(F.count_if(F.col("value").isNull()).alias("imputed"), F.count(F.lit(1)).alias("total"))


def without_numbers(df: DataFrame, columns: list[str]) -> list[str]:
    found = numeric_columns(df.select(*[F.col(f"`{c}`") for c in columns]))
    return [c for c in columns if c not in found]


def default_axes(df: DataFrame) -> list[str]:
    """Up to three columns: component scores if there are two, else numbers that are no identifiers."""
    scores = [c for c in ("PC1", "PC2", "PC3") if c in df.columns]
    if len(scores) >= 2:
        return scores
    numeric = numeric_columns(df)
    own = [c for c in numeric if not is_identifier(c)]
    return (own if len(own) >= 2 else numeric)[:3]


def default_colour(df: DataFrame, current: str = "") -> str:
    """The current column; Cluster; the column of fewest values, from 2 to 20, that is neither identifier nor boolean."""
    if current in df.columns:
        return current
    if "Cluster" in df.columns:
        return "Cluster"
    names = [c for c in df.columns if not is_identifier(c)]
    if names:
        found = Summary(df, names)
        few = [c for c in names if 2 <= (found.by[c]["n_values"] or 0) <= CONTINUOUS]
        flags = {"number": {"0", "1"}, "text": {"true", "false"}, "boolean": {"0", "1"}}
        values = found.groups(few) if few else {}
        fit = [(len(values[c]), k, c) for k, c in enumerate(few) if not {v for v, _ in values[c]} <= flags.get(kind_of(df, c), set())]
        return min(fit)[2] if fit else names[0]
    return df.columns[0] if df.columns else ""


def derived_columns(df: DataFrame) -> list[str]:
    return [c for c in df.columns if is_derived(c)]
