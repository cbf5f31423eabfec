"""Row filters: conjunctions of typed conditions. A missing cell matches nothing, not even neq."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strata.functions.values import kind_of, label, number

OPERATORS = ("eq", "neq", "lt", "lte", "gt", "gte", "in", "contains")


def as_number(value) -> float | None:
    if isinstance(value, bool):
        return float(value)
    if isinstance(value, (int, float)):
        return float(value) if abs(value) < float("inf") else None
    try:
        found = float(str(value).strip())
    except ValueError:
        return None
    return found if abs(found) < float("inf") and str(value).strip().lower().lstrip("+-")[:3] not in ("inf", "nan") else None


def as_text(value) -> str:
    n = as_number(value) if not isinstance(value, str) else None
    return str(int(n)) if n is not None and n == int(n) else str(value)


def equals(df: DataFrame, name: str, value) -> Column:
    n = as_number(value)
    if kind_of(df, name) == "number" and n is not None:
        return F.col(f"`{name}`") == n
    same = label(df, name) == as_text(value).strip()
    return same if n is None else F.coalesce(number(df, name) == n, same)


def matches(df: DataFrame, condition: dict) -> Column:
    """One condition ({column, op, value}) as a boolean; not true where the cell is missing."""
    name, op, value = condition["column"], condition["op"], condition["value"]
    first = value[0] if isinstance(value, (list, tuple)) and value else value
    if op in ("eq", "neq"):
        found = equals(df, name, first)
        return found if op == "eq" else ~found
    if op == "in":
        values = list(value) if isinstance(value, (list, tuple)) else [value]
        numbers = [n for n in map(as_number, values) if n is not None]
        if kind_of(df, name) == "number" and len(numbers) == len(values):
            return F.col(f"`{name}`").isin(*numbers)
        return reduce(lambda a, b: a | b, [equals(df, name, v) for v in values], F.lit(False))
    if op == "contains":
        return F.lower(label(df, name)).contains(as_text(first).lower())
    n = as_number(first)
    if n is None:
        return F.lit(False)
    c = F.col(f"`{name}`") if kind_of(df, name) == "number" else number(df, name)
    return {"lt": c < n, "lte": c <= n, "gt": c > n, "gte": c >= n}[op]


def mask(df: DataFrame, conditions: list[dict]) -> Column:
    """All conditions; an empty list keeps every row."""
    return F.coalesce(reduce(lambda a, b: a & b, [matches(df, c) for c in conditions], F.lit(True)), F.lit(False))


def kept(df: DataFrame, conditions: list[dict]) -> DataFrame:
    return df.where(reduce(lambda a, b: a & b, [matches(df, c) for c in conditions], F.lit(True)))


def counted(df: DataFrame, conditions: list[dict]) -> DataFrame:
    """shown and total rows."""
    return df.agg(F.count_if(mask(df, conditions)).alias("shown"), F.count(F.lit(1)).alias("total"))


def scattered(df: DataFrame, conditions: list[dict], name: str, value: Column) -> DataFrame:
    """A column that holds value on the rows shown and null elsewhere."""
    return df.withColumn(name, F.when(mask(df, conditions), value))


def problems(df: DataFrame, conditions) -> list[str]:
    """What is wrong with the conditions' structure."""
    if not isinstance(conditions, list):
        return ["conditions must be a list"]
    out = []
    for c in conditions:
        if not isinstance(c, dict) or not isinstance(c.get("column"), str):
            out.append("each condition needs a column")
        elif c["column"] not in df.columns:
            out.append(f'"{c["column"]}" is not a column')
        elif c.get("op") not in OPERATORS:
            out.append(f'"{c.get("op")}" is not an operator; use {", ".join(OPERATORS)}')
        elif c.get("value") is None or c["op"] == "in" and not isinstance(c["value"], (list, tuple)):
            out.append(f'the condition on "{c["column"]}" needs a {"list of values" if c["op"] == "in" else "value"}')
    return out


def described(conditions: list[dict]) -> str:
    signs = {"eq": "=", "neq": "≠", "lt": "<", "lte": "≤", "gt": ">", "gte": "≥", "in": "in", "contains": "contains"}
    return " and ".join(f"{c['column']} {signs[c['op']]} {', '.join(map(as_text, c['value'])) if isinstance(c['value'], (list, tuple)) else as_text(c['value'])}" for c in conditions)


def anywhere(df: DataFrame, text: str) -> DataFrame:
    """Rows in which some column contains a text, in either case."""
    return df.where(reduce(lambda a, b: a | b, [F.coalesce(F.lower(label(df, c)).contains(text.lower()), F.lit(False)) for c in df.columns], F.lit(False)))


def where(df: DataFrame, column: str, op: str, value, order: list, limit: int = 50) -> DataFrame:
    """The first rows, in the given order, that meet a condition."""
    return kept(df, [{"column": column, "op": op, "value": value}]).orderBy(*order).limit(limit)


def complete(df: DataFrame, names: list[str]) -> DataFrame:
    """Rows whose named cells are all numbers."""
    return df.where(reduce(lambda a, b: a & b, [number(df, c).isNotNull() for c in names], F.lit(True)))


def visible(df: DataFrame, name: str, hidden: list[str]) -> DataFrame:
    """Rows whose label is not among the hidden ones; rows without a label stay."""
    return df.where(F.coalesce(~label(df, name).isin(*hidden), F.lit(True)))


def policy_problems(profile: dict, conditions: list[dict], open_data: bool) -> list[str]:
    """Private data may be filtered by profiled values only. profile: name to {identifier, numeric, values}."""
    if open_data:
        return []
    out = []
    for c in conditions:
        column = profile.get(c["column"])
        if not column or column["identifier"]:
            out.append(f'"{c["column"]}" is not available as a filter')
        elif not column["numeric"]:
            wanted = c["value"] if isinstance(c["value"], (list, tuple)) else [c["value"]]
            if c["op"] not in ("eq", "neq", "in") or any(as_text(v) not in column["values"] for v in wanted):
                out.append(f'the condition on "{c["column"]}" must name available values')
    return out
