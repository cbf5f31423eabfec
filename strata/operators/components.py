"""Principal components: moments in one or two aggregates, a small eigenproblem on the driver, scores as expressions."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strata.functions.names import clean_label, component_names, normal_name, owned_by
from strata.functions.values import number, rounded
from strata.operators.filters import complete
from strata.operators.gaps import Filled
from strata.operators.rows import medians


@dataclass
class Components:
    """A fitted run. weights: variables by components; scores are centred and, if asked for, scaled by the population sd."""

    variables: list[str]
    names: list[str]
    centre: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    eigenvalues: np.ndarray
    fill: list[float]
    missing: str
    report: dict = field(default_factory=dict)

    @property
    def share(self) -> np.ndarray:
        return self.eigenvalues / self.eigenvalues.sum()

    def loadings(self, c: int) -> list[tuple[str, float]]:
        order = sorted(range(len(self.variables)), key=lambda j: -abs(self.weights[j, c]))
        return [(self.variables[j], float(np.floor(self.weights[j, c] * 1000 + 0.5) / 1000)) for j in order]

    def transform(self, df: DataFrame, label: str = "") -> DataFrame:
        """df with the scores; columns of an earlier run with the same label go. A row left out of the fit has none."""
        rest = df.drop(*[c for c in df.columns if owned_by(label, c)])
        cells = [number(df, v) for v in self.variables]
        if self.missing != "complete":
            cells = [F.coalesce(c, F.lit(float(m))) for c, m in zip(cells, self.fill)]
        scores = {}
        for k, name in enumerate(self.names):
            terms = [(c - float(m)) * float(w / s) for c, m, s, w in zip(cells, self.centre, self.scale, self.weights[:, k]) if w]
            scores[name] = sum(terms[1:], terms[0]) if terms else F.lit(0.0)
        return rest.withColumns(scores)


def gram(rows: DataFrame, p: int) -> tuple[int, np.ndarray, np.ndarray]:
    """n, means and centred cross-products of an array column x: partial matrices from tasks, added up by entry."""

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, mean, m2 = 0, np.zeros(p), np.zeros((p, p))
        for batch in batches:
            if not batch.num_rows:
                continue
            x = batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(-1, p)
            k, centre = len(x), x.mean(0)
            d, shift = x - centre, centre - mean
            m2 += d.T @ d + np.outer(shift, shift) * (n * k / (n + k))
            mean += shift * (k / (n + k))
            n += k
        if n:
            yield pa.RecordBatch.from_pylist([{"n": n, "mean": mean.tolist(), "m2": m2.ravel().tolist()}])

    parts = rows.select("x").mapInArrow(sums, "n long, mean array<double>, m2 array<double>")

    def merge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n, mean, m2 = 0, np.zeros(p), np.zeros(p * p)
        for pdf in batches:
            for r in pdf.itertuples():
                shift = np.array(r.mean) - mean
                m2 += np.array(r.m2) + np.outer(shift, shift).ravel() * (n * r.n / (n + r.n))
                mean += shift * (r.n / (n + r.n))
                n += r.n
        if n:
            yield pd.DataFrame({"n": [n], "mean": [mean.tolist()], "m2": [m2.tolist()]})

    schema = "n long, mean array<double>, m2 array<double>"
    # Two levels: no more than 32 matrices reach the driver, however many tasks there were.
    found = parts.repartition(32).mapInPandas(merge, schema).toPandas()
    total = list(merge(iter([found])))
    if not total:
        return 0, np.zeros(p), np.zeros((p, p))
    one = total[0].iloc[0]
    return int(one["n"]), np.array(one["mean"]), np.array(one["m2"]).reshape(p, p)


def eigen(matrix: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues, largest first, and vectors whose largest weight is positive (the first, if several are as large)."""
    values, vectors = np.linalg.eigh(matrix)
    values, vectors = values[::-1], vectors[:, ::-1]
    size = np.abs(vectors)
    top = np.argmax(size >= size.max(0) - 1e-9, axis=0)
    return np.maximum(values, 0), vectors * np.where(vectors[top, np.arange(len(top))] < 0, -1, 1)


def vectors_of(df: DataFrame, variables: list[str], fill: list[float] | None = None) -> DataFrame:
    cells = [number(df, v) for v in variables]
    return df.select(F.array(*(cells if fill is None else [F.coalesce(c, F.lit(float(m))) for c, m in zip(cells, fill)])).alias("x"))


def fit(df: DataFrame, variables: list[str], k: int = 3, scale: bool = True, label: str = "", missing: str = "median") -> Components:
    """missing: median, complete (rows with gaps are left out) or iterative (see impute())."""
    p = len(variables)
    if p < 2:
        raise ValueError("a component analysis needs at least two variables")
    counts = df.agg(F.count(F.lit(1)).alias("n"), *[F.count(number(df, v)).alias(f"c{j}") for j, v in enumerate(variables)]).first()
    if counts["n"] < 3:
        raise ValueError("too few rows")
    empty = [v for j, v in enumerate(variables) if not counts[f"c{j}"]]
    if empty:
        raise ValueError(f"no numbers in {', '.join(empty)}")
    k = max(1, min(k, p, counts["n"] - 1))
    fill = medians(df, variables)
    if missing == "iterative":
        rows = impute(df, variables, rank=k, scale=scale)[0].select("x")
    elif missing == "complete":
        rows = vectors_of(complete(df, variables), variables)
    else:
        rows = vectors_of(df, variables, fill)
    n, mean, m2 = gram(rows, p)
    if n < 3:
        raise ValueError(f"only {n} rows have all variables")
    sd = np.sqrt(np.diag(m2) / n)
    if scale and (sd == 0).any():
        raise ValueError(f"constant: {', '.join(v for v, s in zip(variables, sd) if s == 0)}")
    unit = sd if scale else np.ones(p)
    values, vectors = eigen(m2 / n / np.outer(unit, unit))
    gaps = {v: counts["n"] - counts[f"c{j}"] for j, v in enumerate(variables) if counts[f"c{j}"] < counts["n"]}
    report = {"by_variable": gaps, "imputed_cells": 0 if missing == "complete" else sum(gaps.values()), "rows_used": n, "rows_dropped": counts["n"] - n}
    return Components(variables, component_names(clean_label(label), k), mean, unit, vectors[:, :k], values, fill, missing, report)


def impute(df: DataFrame, variables: list[str], rank: int = 2, scale: bool = True, rounds: int = 200, tolerance: float = 1e-8) -> tuple[DataFrame, dict]:
    """Rows as an array column x with gaps filled by regularised iterative components, and how it went.

    Between rounds only moments are carried, for each pattern of gaps (see gaps.py); rows are
    filled once at the end.
    """
    p = len(variables)
    rank = max(1, min(rank, p - 1))
    raw = vectors_of(df, variables)
    means = df.agg(*[F.avg(number(df, v)).alias(f"m{j}") for j, v in enumerate(variables)]).first()
    rows = Filled(raw, p, np.array([float(means[f"m{j}"]) for j in range(p)]))
    done, turn = False, 0
    for turn in range(1, rounds + 1):
        n, mean, m2 = rows.moments.n, rows.moments.mean, rows.moments.m2
        unit = np.sqrt(np.diag(m2) / n) if scale else np.ones(p)
        unit = np.where(unit > 0, unit, 1.0)
        values, vectors = eigen(m2 / n / np.outer(unit, unit))
        noise = values[rank:].sum() / (p - rank)
        shrink = np.where(values[:rank] > 0, np.maximum(0, (values[:rank] - noise) / np.maximum(values[:rank], 1e-300)), 0)
        plane = (vectors[:, :rank] * shrink) @ vectors[:, :rank].T
        a = unit[:, None] * plane / unit  # x goes to the plane and back: a @ (x - mean) + mean
        moved, size = rows.refill(a, mean - a @ mean)
        if moved <= tolerance * max(size, 1e-12):
            done = True
            break
    return rows.table(), {"iterations": turn, "converged": done, "rank": rank}


def project(df: DataFrame, loadings: DataFrame) -> tuple[DataFrame, dict]:
    """Scores from a loadings table: its first column names variables, the others are components, of which three are used.

    Columns are filled with their median and standardised (population sd, 0 counts as 1).
    """
    index = "Unnamed: 0" if "Unnamed: 0" in loadings.columns else loadings.columns[0]
    parts = [c for c in loadings.columns if c != index]
    cells = loadings.select(F.col(f"`{index}`").cast("string").alias("v"), *[number(loadings, c).alias(f"l{k}") for k, c in enumerate(parts)]).collect()  # a row for each variable
    if not cells or all(r["v"] is not None and r["v"].replace(".", "", 1).lstrip("-").isdigit() for r in cells):
        raise ValueError("the first column must hold variable names")
    loose: dict[str, str] = {}
    for c in df.columns:
        loose.setdefault(normal_name(c), c)
    found = [(r, r["v"] if r["v"] in df.columns else loose.get(normal_name(r["v"] or ""))) for r in cells]
    used = [(r, c) for r, c in found if c]
    if not used:
        raise ValueError("no variable of the loadings is a column")
    warnings = []
    if len(used) < len(cells):
        warnings.append(f"{len(cells) - len(used)} of {len(cells)} variables are missing: {', '.join(r['v'] for r, c in found if not c)}")
    if len(used) < len(cells) / 2:
        warnings.append("fewer than half of the variables were found")
    if fuzzy := sum(r["v"] != c for r, c in used):
        warnings.append(f"{fuzzy} names match only without case and blanks")
    k = min(3, len(parts))
    if bad := sum(r[f"l{j}"] is None for r, _ in used for j in range(len(parts))):
        warnings.append(f"{bad} loadings are no numbers and count as 0")
    columns = [c for _, c in used]
    fill = medians(df, columns)
    filled = [F.coalesce(number(df, c), F.lit(float(m))) for c, m in zip(columns, fill)]
    one = df.agg(*[f(x).alias(f"{n}{j}") for j, x in enumerate(filled) for n, f in (("m", F.avg), ("s", F.stddev_pop))], *[F.count(number(df, c)).alias(f"n{j}") for j, c in enumerate(columns)]).first()
    if empty := [c for j, c in enumerate(columns) if not one[f"n{j}"]]:
        raise ValueError(f"no numbers in {', '.join(empty)}")
    scores = {}
    for c in range(k):
        terms = [(x - one[f"m{j}"]) * (r[f"l{c}"] / (one[f"s{j}"] or 1.0)) for j, (x, (r, _)) in enumerate(zip(filled, used)) if r[f"l{c}"]]
        scores[f"PC{c + 1}"] = sum(terms[1:], terms[0]) if terms else F.lit(0.0)
    top = {f"PC{c + 1}": sorted(((r["v"], round(r[f"l{c}"] or 0.0, 3)) for r, _ in used), key=lambda x: -abs(x[1]))[:5] for c in range(k)}
    return df.drop(*scores).withColumns(scores), {"warnings": warnings, "contributors": top, "used": columns}


def explained(model: Components) -> list[dict]:
    """component, eigenvalue, share and cumulative share."""
    share = model.share
    return [{"component": k + 1, "eigenvalue": float(v), "share": float(s), "cumulative": float(c)} for k, (v, s, c) in enumerate(zip(model.eigenvalues, share, np.cumsum(share)))]


def loading_table(spark, model: Components) -> DataFrame:
    """component, variable, loading and rank by its size."""
    rows = [(name, v, w, i + 1) for c, name in enumerate(model.names) for i, (v, w) in enumerate(model.loadings(c))]
    return spark.createDataFrame(rows, "component string, variable string, loading double, rank int").withColumn("loading", rounded(F.col("loading")))
