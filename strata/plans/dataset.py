"""A dataset: a table with a row order, a filter, a policy and a record of what was done."""

from __future__ import annotations

import json
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strata.functions.names import is_component, is_identifier
from strata.operators import charts, clusters, codes, components, filters, groups, hypothesis, profile, rows, transfer
from strata.plans import plan as plans
from strata.plans import policy
from strata.sources import tables


@dataclass
class Dataset:
    """df has a long column _row. Every method returns results or a new Dataset; none changes this one."""

    df: DataFrame
    name: str = "data"
    mode: str = "private"
    conditions: list[dict] = field(default_factory=list)
    log: tuple[str, ...] = ()
    known: dict = field(default_factory=dict, repr=False, compare=False)  # profiles of this table by filter and mode

    @classmethod
    def of(cls, df: DataFrame, order: list, **more) -> Dataset:
        return cls(transfer.with_rows(df, order), **more)

    @classmethod
    def from_path(cls, spark: SparkSession, path: str, order: list | None = None, repair: bool = False, sheet: str | None = None, **more) -> Dataset:
        """A file as a dataset, with its warnings in the log. ValueError unless two columns hold numbers.

        repair reads numbers written as formatted text as numbers first. Without an order,
        rows are numbered as they are read.
        """
        df, said = tables.read_table(spark, path, sheet)
        log = [f"read {path}", *said]
        told = profile.diagnosis(df).collect()  # a row for each column
        if repair and (fix := [r["column_name"] for r in told if r["kind"] == "fixable"]):
            df = profile.with_numbers_cleaned(df, fix)
            log.append(f"formatted text read as numbers: {', '.join(fix)}")
        else:
            fix = []
        if sum(r["kind"] == "numeric" or r["column_name"] in fix for r in told) < 2:
            raise ValueError(f"two columns of numbers are needed. {profile.diagnosis_text(told)}")
        ds = cls.of(df, order, **more) if order else cls(transfer.numbered(df), **more)
        return replace(ds, log=(*log, *ds.log))

    @property
    def open(self) -> bool:
        return policy.mode_of(self.mode) == "open"

    def noted(self, what: str, **changes) -> Dataset:
        return replace(self, log=(*self.log, what), **({"known": {}} | changes if "df" in changes else changes))

    def columns(self) -> list[str]:
        return [c for c in self.df.columns if c != "_row"]

    def filtered(self, conditions: list[dict], how: str = "replace") -> Dataset:
        """Replace or add conditions; an empty list clears them."""
        if found := filters.problems(self.df, conditions):
            raise ValueError("; ".join(found))
        if not self.open and (found := filters.policy_problems(self._profiled(self.df, []), conditions, False)):
            raise ValueError("; ".join(found))
        every = [*self.conditions, *conditions] if how == "add" else conditions
        return self.noted(f"filter: {filters.described(every) or 'none'}", conditions=every)

    def visible(self) -> DataFrame:
        """The rows every analysis starts from; ValueError if the policy's floor forbids the filter."""
        if not self.conditions:
            return self.df
        n = filters.counted(self.df, self.conditions).first()
        if (floor := policy.filter_floor(n["shown"], n["total"], self.mode)) != "ok":
            raise ValueError(f"the filter is not allowed on private data: {floor}")
        return filters.kept(self.df, self.conditions)

    def profile(self) -> dict:
        return self._profiled(self.visible(), self.conditions)

    def _profiled(self, table: DataFrame, conditions: list[dict]) -> dict:
        """The profile of the rows that meet the conditions, taken once for each table, filter and mode."""
        key = (json.dumps(conditions, sort_keys=True, default=str), self.open)
        if key not in self.known:
            self.known[key] = profile.analysis_profile(table.drop("_row"), self.open)
        return self.known[key]

    def run_plan(self, plan: dict):
        """A test's result as a dict, or a chart's data as a DataFrame."""
        known = self.profile()
        if found := plans.problems(plan, known):
            raise ValueError(plans.told(found))
        if plan["kind"] == "chart":
            return charts.drawn(self.visible(), plan, known)
        chosen = plan.get("groups") or plans.shown(known[plan["groupBy"]])
        levels = plans.shown(known[plan["column"]]) if plan["test"] == "chi_square" else None
        return hypothesis.run(self.visible(), plan["test"], plan["column"], plan["groupBy"], chosen, levels)

    def chart(self, plan: dict) -> dict:
        """A chart's data with its summary, notes and how many rows are withheld."""
        known = self.profile()
        if found := plans.problems(plan, known):
            raise ValueError(plans.told(found))
        return charts.compiled(self.visible(), plan, known)

    def correlate(self, a: str, b: str) -> dict:
        r = groups.correlation(self.visible(), a, b).first().asDict()
        return r if policy.correlation_allowed(r["n"], self.mode) else {"n": r["n"], "pearson": None, "spearman": None}

    def compare_groups(self, column: str, by: str) -> dict:
        return groups.report(self.visible(), column, by, self.open)

    def analysis_columns(self) -> list[str]:
        return [c for c in profile.numeric_columns(self.df.drop("_row")) if not is_component(c) and not is_identifier(c) and c != "Cluster"]

    def run_pca(self, variables: list[str] | None = None, k: int = 3, scale: bool = True, label: str = "", missing: str = "median") -> tuple[Dataset, components.Components]:
        """Scores on the visible rows, null elsewhere."""
        rows_in = self.visible()
        model = components.fit(rows_in, variables or self.analysis_columns(), k, scale, label, missing)
        # The mask is taken before columns that it may name are replaced; a score needs its own row only.
        scored = model.transform(self.df.withColumn("_shown", filters.mask(self.df, self.conditions)), label)
        scored = scored.withColumns({c: F.when(F.col("_shown"), F.col(f"`{c}`")) for c in model.names}).drop("_shown")
        return self.noted(f"PCA of {', '.join(model.variables)}", df=scored), model

    def run_clustering(self, axes: list[str], method: str = "kmeans", k: int = 3, eps: float = 0.5, least: int = 5, standardise: bool = False) -> Dataset:
        """A Cluster column on the visible rows, null elsewhere."""
        rows_in = self.visible()
        if bad := profile.without_numbers(rows_in, axes):
            raise ValueError(f"no numbers in {', '.join(bad)}")
        points = clusters.axes_of(rows_in, axes, standardise)
        found = clusters.dbscan(points, eps, least) if method == "dbscan" else clusters.kmeans_scaled(points, k) if method == "kmeans_scaled" else clusters.kmeans_reference(points, k)
        return self.noted(f"{method} on {', '.join(axes)}", df=self.df.drop("Cluster").join(found, "_row", "left"))

    def suggest_k(self, axes: list[str], most: int = 8, standardise: bool = False) -> list[dict]:
        return clusters.silhouette_by_k(self._diagnosed(axes, standardise), most)

    def suggest_eps(self, axes: list[str], least: int = 5, standardise: bool = False) -> dict | None:
        return clusters.k_distance_percentiles(self._diagnosed(axes, standardise), least)

    def _diagnosed(self, axes: list[str], standardise: bool) -> DataFrame:
        table = self.visible()
        return clusters.numbers(rows.z_scores(table, axes) if standardise else table, axes)

    def breakdown(self, attribute: str) -> DataFrame:
        return groups.breakdown(self.visible(), "Cluster", attribute, self.open)

    def transferred(self, source: Dataset, column: str, how: str = "order", key: str | None = None, name: str | None = None) -> Dataset:
        target = name or f"{column}·{source.name}"
        if how == "order":
            ok, why = transfer.order_allowed(self.df, source.df)
            if not ok:
                raise ValueError(why)
            return self.noted(f"{column} from {source.name} by order", df=transfer.by_order(self.df, source.df, column, target), mode=policy.combined([self.mode, source.mode]))
        return self.noted(f"{column} from {source.name} by {key}", df=transfer.by_key(self.df, source.df, column, key, target), mode=policy.combined([self.mode, source.mode]))

    def recoded(self, plan: dict[str, list[float]]) -> Dataset:
        return self.noted(f"recode {plan}", df=rows.recoded(self.df, plan))

    def find_codes(self, declared: list[float] | None = None) -> DataFrame:
        return codes.scanned(self.visible(), [c for c in self.columns() if profile.kind_of(self.df, c) in ("number", "text")], declared)

    def sample_rows(self, k: int, columns: list[str] | None = None, seed: int = 1) -> DataFrame:
        self._must_be_open()
        return rows.sample(self.visible(), k, ["_row"], seed, ["_row", *rows.columns_of(self.df, columns)])

    def rows_where(self, column: str, op: str, value, limit: int = 50) -> DataFrame:
        self._must_be_open()
        return filters.where(self.visible(), column, op, value, ["_row"], limit)

    def categories(self, column: str) -> DataFrame:
        self._must_be_open()
        return profile.categories(self.visible(), column)

    def _must_be_open(self) -> None:
        if not self.open:
            raise PermissionError("rows of private data are not shown")

    def summary(self) -> dict:
        one = self.visible().agg(F.count(F.lit(1)).alias("n")).first()
        return {"name": self.name, "mode": self.mode, "rows": one["n"], "columns": self.columns(), "filter": filters.described(self.conditions), "log": list(self.log)}
