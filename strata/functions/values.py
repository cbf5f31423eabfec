"""Cells as Column expressions: numbers, labels, formatted text, dates, rounding.

A column that is already numeric skips the text guard, so its filters still reach the
Parquet scan.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: How a time is written as a label.
TIME = "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'"
NUMBER = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"
#: White space that a cell is trimmed of.
EDGES = r"^[\s   -     　﻿]+|[\s   -     　﻿]+$"
CURRENCY = "[$€£¥₹]"
#: The same characters, one by one.
EDGE = "".join(chr(c) for c in range(1 << 16) if re.match(EDGES, chr(c), re.ASCII))
GAPS = r"[\s   ]"

# Names and patterns of formatted numbers, in the order in which they are tried, and the forms of dates.
PATTERNS = [
    ("currency symbol", rf"^{CURRENCY}\s*[-+]?[\d.,\s ]+$|^[-+]?[\d.,\s ]+\s*{CURRENCY}$"),
    ("percent sign", r"^[-+]?[\d.,]+\s*%$"),
    ("thousands separators (1,234)", r"^[-+]?\d{1,3}(,\d{3})+(\.\d+)?$"),
    ("European format (1.234,56)", r"^[-+]?\d{1,3}(\.\d{3})+(,\d+)?$"),
    ("comma as decimal (3,14)", r"^[-+]?\d+,\d{1,2}$"),
    ("space-grouped digits (1 234)", rf"^[-+]?\d{{1,3}}({GAPS}\d{{3}})+([.,]\d+)?$"),
    ("parentheses negative (123)", r"^\([\d.,\s ]+\)$"),
]
DATE_LIKE = r"^\d{4}-\d{2}-\d{2}([T ]|$)|^\d{1,2}[/.-]\d{1,2}[/.-]\d{2,4}$"
TEMPORAL = r"^\d{4}-\d{2}-\d{2}([T ]\d{2}:\d{2}(:\d{2})?)?|^\d{4}/\d{1,2}/\d{1,2}$|^\d{1,2}/\d{1,2}/\d{4}$"


def kind_of(df: DataFrame, name: str) -> str:
    """number, boolean, time, text or other."""
    t = df.schema[name].dataType
    if isinstance(t, T.NumericType):
        return "number"
    if isinstance(t, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        return "time"
    return "boolean" if isinstance(t, T.BooleanType) else "text" if isinstance(t, T.StringType) else "other"


def trimmed(c: Column) -> Column:
    return F.btrim(c, F.lit(EDGE))


def finite(c: Column) -> Column:
    return F.when(~F.isnan(c) & (F.abs(c) < float("inf")), c)


def parsed(text: Column) -> Column:
    """The finite number that a text is, or null."""
    return parsed_bare(trimmed(text))


def parsed_bare(t: Column) -> Column:
    """The same of a text without white space at its ends. A number's text is never NaN, but may be too large."""
    return F.when(t.rlike(NUMBER) & (F.abs(t.try_cast("double")) < float("inf")), t.try_cast("double"))


def number(df: DataFrame, name: str) -> Column:
    """A column's cells as numbers (double); null where a cell is none. Times and nested values are never numbers."""
    kind, c = kind_of(df, name), F.col(f"`{name}`")
    if kind == "number":
        return finite(c.cast("double")) if isinstance(df.schema[name].dataType, T.FractionalType) else c.cast("double")
    if kind == "boolean":
        return c.cast("double")
    return parsed(c) if kind == "text" else F.lit(None).cast("double")


def plain(c: Column) -> Column:
    """A double as the shortest text: 5.0 is 5."""
    return F.when((c == F.floor(c)) & (F.abs(c) < 1e15), c.cast("decimal(18,0)").cast("string")).otherwise(c.cast("string"))


def label(df: DataFrame, name: str) -> Column:
    """A cell as a group label; null stays null."""
    kind, c = kind_of(df, name), F.col(f"`{name}`")
    if kind == "number":
        return plain(number(df, name)) if isinstance(df.schema[name].dataType, T.FractionalType) else c.cast("string")
    if kind == "boolean":
        return c.cast("int").cast("string")
    if kind == "time":
        return F.date_format(c.cast("timestamp"), TIME)
    return F.nullif(trimmed(c.cast("string")), F.lit(""))


def normalised(df: DataFrame) -> DataFrame:
    """Every cell in the value domain: double or trimmed text, NaN, infinities and blanks as null; times stay times."""
    out = {}
    for f in df.schema:
        kind = kind_of(df, f.name)
        out[f.name] = F.col(f"`{f.name}`") if kind == "time" else number(df, f.name) if kind in ("number", "boolean") else label(df, f.name)
    return df.select(*[c.alias(n) for n, c in out.items()])


def pattern(text: Column) -> Column:
    """Which formatted-number pattern a text has, or null."""

    def of(t: Column) -> Column:
        out = F.lit(None).cast("string")
        for name, regex in reversed(PATTERNS):
            out = F.when(t.rlike(regex), name).otherwise(out)
        return out

    return let(trimmed(text), of)


def let(value: Column, use) -> Column:
    """use(value), with value computed once."""
    return F.transform(F.array(value), use)[0]


def bare_digits(s: Column) -> Column:
    """A number's text with a point for decimals and nothing between groups of digits."""
    by = dict(PATTERNS)
    comma, point = s.contains(","), s.contains(".")
    return (
        F.when(comma & s.rlike(by["thousands separators (1,234)"]), F.translate(s, ",", ""))
        .when(point & s.rlike(by["European format (1.234,56)"]), F.translate(s, ",.", "."))
        .when(comma & s.rlike(by["comma as decimal (3,14)"]), F.translate(s, ",", "."))
        .when(s.rlike(by["space-grouped digits (1 234)"]), F.translate(F.regexp_replace(s, GAPS, ""), ",", "."))
        .otherwise(s)
    )


def cleaned(text: Column) -> Column:
    """The number that a formatted text stands for; null where that is unclear."""

    def of(t: Column) -> Column:
        negative = t.startswith("(") & t.rlike(r"^\((.+)\)$")
        inner = F.when(negative, F.substring(t, F.lit(2), F.greatest(F.length(t) - 2, F.lit(0)))).otherwise(t)
        unit = let(trimmed(F.translate(inner, CURRENCY[1:-1], "")), lambda s: F.when(s.endswith("%"), F.regexp_replace(s, r"\s*%$", "")).otherwise(s))
        n = let(trimmed(let(unit, bare_digits)), parsed_bare)
        return F.when(t != "", F.when(negative, -n).otherwise(n))

    return let(trimmed(text), of)


def listed(df: DataFrame, name: str, most: int = 200) -> Column:
    """A cell as it is listed: its label, cut to so many characters.

    A text is longer if anything but white space follows its first `most` characters, so its end
    is not sought: Spark notes the place of every character of a text that it trims at the end.
    """
    if kind_of(df, name) in ("number", "boolean", "time"):
        return label(df, name)

    def of(t: Column) -> Column:
        more = F.ltrim(F.substr(t, F.lit(most + 1)), F.lit(EDGE)) != ""
        return F.when(more, F.concat(F.substring(t, 1, most - 1), F.lit("…"))).otherwise(F.nullif(F.rtrim(F.substring(t, 1, most), F.lit(EDGE)), F.lit("")))

    return let(F.ltrim(F.col(f"`{name}`").cast("string"), F.lit(EDGE)), of)


def temporal(df: DataFrame, name: str) -> Column:
    """Whether a cell is a date or time; numbers never are."""
    kind = kind_of(df, name)
    if kind == "time":
        return F.col(f"`{name}`").isNotNull()
    return F.coalesce(trimmed(F.col(f"`{name}`")).rlike(TEMPORAL), F.lit(False)) if kind == "text" else F.lit(False)


def moment(df: DataFrame, name: str) -> Column:
    """A cell as a timestamp in the session's zone; slash dates are month/day/year or year/month/day."""
    c = F.col(f"`{name}`")
    if kind_of(df, name) == "time":
        return c.cast("timestamp")
    t = trimmed(c.cast("string"))
    return F.coalesce(F.when(t.rlike(r"^\d{4}-\d{2}-\d{2}"), F.try_to_timestamp(t)), F.when(t.rlike(r"^\d{1,2}/"), F.try_to_timestamp(t, F.lit("M/d/yyyy"))), F.when(t.rlike(r"^\d{4}/"), F.try_to_timestamp(t, F.lit("yyyy/M/d"))))


def day(df: DataFrame, name: str) -> Column:
    return F.date_trunc("day", moment(df, name)).cast("date")


def rounded(c: Column, places: int = 3) -> Column:
    """Half-way cases go up."""
    return F.floor(c * 10**places + 0.5) / float(10**places)


def boolean_like(df: DataFrame, name: str) -> Column:
    """Whether a cell is 0, 1, true or false (null: null)."""
    kind, c = kind_of(df, name), F.col(f"`{name}`")
    return c.isin(0, 1) if kind == "number" else c.isin("true", "false") if kind == "text" else c.isNotNull() if kind == "boolean" else F.when(c.isNotNull(), False)


def natural(label: Column) -> list[Column]:
    """Sort keys for labels: Noise last, digits by value."""
    return [F.lower(label) == "noise", F.lower(F.regexp_extract(label, r"^(\D*)", 1)), F.regexp_extract(label, r"^\D*(\d{1,18})", 1).try_cast("long"), label]


def csv_cell(c: Column) -> Column:
    """Text that a spreadsheet would run as a formula gets a quote mark before it; numbers never do."""
    return F.when(c.rlike(r"^[=+\-@\t\r]") & ~c.rlike(NUMBER), F.concat(F.lit("'"), c)).otherwise(c)


def tsv_cell(c: Column) -> Column:
    return F.regexp_replace(csv_cell(c), r"[\t\r\n]+", " ")
