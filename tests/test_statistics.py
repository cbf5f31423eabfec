"""Operators against published values, closed forms and small brute-force versions."""

import math
import random
import time
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from strata.functions import distributions as d
from strata.functions import names, values
from strata.operators import charts, clusters, codes, components, filters, gaps, groups, hypothesis, profile, ranks, rows, transfer, trees
from strata.plans import plan, policy
from strata.plans.dataset import Dataset
from strata.session import written


def pairs(spark, **samples):
    return spark.createDataFrame([(g, float(v)) for g, vs in samples.items() for v in vs], "g string, v double")


def test_distributions():
    assert d.t_two_sided(-5.4349, 21.982) == pytest.approx(1.855e-5, rel=1e-3)
    assert d.t_critical(10) == pytest.approx(2.228139, abs=1e-5)
    assert d.chi_square_tail(7.2, 2) == pytest.approx(math.exp(-3.6))
    assert d.chi_square_tail(3.841459, 1) == pytest.approx(0.05, abs=1e-6)
    assert d.normal_quantile(0.975) == pytest.approx(1.959964, abs=1e-6)


def test_welch_matches_published_values(spark):
    r = hypothesis.welch_t(pairs(spark, a=range(1, 11), b=range(7, 21)), "v", "g", ["a", "b"])
    assert r["statistic"] == pytest.approx(-5.4349, abs=1e-4)
    assert r["df"] == pytest.approx(21.982, abs=1e-3)
    assert r["p"] == pytest.approx(1.855e-5, rel=1e-3)
    assert r["ci"] == pytest.approx([-11.052802, -4.947198], abs=1e-5)


def test_rank_tests(spark):
    r = hypothesis.mann_whitney(pairs(spark, a=[1, 2, 3], b=[4, 5, 6]), "v", "g", ["a", "b"])
    assert (r["statistic"], r["effect"]) == (0, 1)
    r = hypothesis.kruskal_wallis(pairs(spark, a=[1, 2, 3], b=[4, 5, 6], c=[7, 8, 9]), "v", "g", ["a", "b", "c"])
    assert r["statistic"] == pytest.approx(7.2) and r["effect"] == pytest.approx(0.9)
    assert hypothesis.ks(pairs(spark, a=range(1, 6), b=range(6, 11)), "v", "g", ["a", "b"])["statistic"] == 1
    same = hypothesis.ks(pairs(spark, a=range(5), b=range(5)), "v", "g", ["a", "b"])
    assert (same["statistic"], same["p"]) == (0, 1)


def test_chi_square(spark):
    rows_ = [("p", "x")] * 10 + [("p", "y")] * 20 + [("q", "x")] * 30 + [("q", "y")] * 40
    r = hypothesis.chi_square(spark.createDataFrame(rows_, "a string, b string"), "a", "b")
    assert r["statistic"] == pytest.approx(0.79365, abs=1e-4) and r["df"] == 1
    assert r["effect"] == pytest.approx(math.sqrt(r["statistic"] / 100))


def test_group_effect(spark):
    r = groups.effect(pairs(spark, A=[1, 2, 3], B=[5, 6, 7]), "v", "g").first()
    assert r["eta_squared"] == pytest.approx(24 / 28)
    assert groups.report(pairs(spark, **{f"g{k}": [k] for k in range(6)}), "v", "g")["ok"] is False


def test_midranks_and_correlation(spark):
    got = {r["v"]: r["midrank"] for r in ranks.midranks(spark.createDataFrame([(x,) for x in (1.0, 2.0, 2.0, 3.0)], "v double")).collect()}
    assert got == {1.0: 1.0, 2.0: 2.5, 3.0: 4.0}
    flat = spark.createDataFrame([(1.0, 2.0)] * 4, "a double, b double")
    assert groups.correlation(flat, "a", "b").first()["pearson"] is None
    rng = random.Random(3)
    pairs = [(float(rng.randrange(5)), rng.choice([1e9, 1e9 + 1, None])) for _ in range(200)]
    one = groups.correlation(spark.createDataFrame(pairs, "a double, b double"), "a", "b").first()
    known = np.array([p for p in pairs if p[1] is not None])
    middle = lambda v: np.array([(v < x).sum() + ((v == x).sum() + 1) / 2 for x in v])
    assert one["n"] == len(known) and abs(one["pearson"] - np.corrcoef(known.T)[0, 1]) < 1e-9
    assert abs(one["spearman"] - np.corrcoef(middle(known[:, 0]), middle(known[:, 1]))[0, 1]) < 1e-9
    assert groups.correlation(spark.createDataFrame([], "a double, b double"), "a", "b").collect() == [(0, None, None)]
    assert groups.correlation(spark.createDataFrame([(0.1, k * 0.3) for k in range(7)], "a double, b double"), "a", "b").collect() == [(7, None, None)]


def test_number_coercion(spark):
    cells = {"12": 12, " 12 ": 12, "1e3": 1000, "NaN": None, "Infinity": None, "inf": None, "1d": None, "1f": None, "": None, "  ": None, "1,000": None, ".5": 0.5, "1e999": None}
    df = spark.createDataFrame([(c,) for c in cells], "s string")
    assert {r["s"]: r["n"] for r in df.select("s", values.number(df, "s").alias("n")).collect()} == cells


def test_formatted_numbers(spark):
    cells = {"$1,234.50": 1234.5, "€ 1.234,56": 1234.56, "45%": 45, "3,14": 3.14, "1 234": 1234, "(120)": -120, "abc": None, "1,2345": None}
    df = spark.createDataFrame([(c,) for c in cells], "s string")
    assert {r["s"]: r["n"] for r in df.select("s", values.cleaned(F.col("s")).alias("n")).collect()} == cells


def test_cells_are_cleaned_in_few_steps(spark):
    """White space of all kinds, signs, units and groups; trimming looks at the ends of a text only."""
    cells = {"\u2009\u00a0 1\u202f234\ufeff": 1234.0, "($1,234.50)": -1234.5, "(1\n234)": None, " 6.500\u2009%": 6.5, "1.234,5 €": 1234.5, "1e999": None, "-7 %": -7.0, "()": None, "": None, "5 % %": None}
    df = spark.createDataFrame(list(cells.items()), "t string, v double")
    assert [r["got"] for r in df.select(values.cleaned(F.col("t")).alias("got")).collect()] == list(cells.values())
    gaps = spark.range(1).select(F.concat(F.lit("a"), F.repeat(F.lit(" "), 300_000), F.lit("b ")).alias("t"))
    began = time.monotonic()
    assert gaps.select(F.length(values.label(gaps, "t")).alias("n")).first()["n"] == 300_002
    assert time.monotonic() - began < 20  # a pattern for the end tries every blank: 4.5e10 steps


def test_long_texts_are_listed_by_their_first_characters(spark):
    """Equal to trimming and cutting the whole text, and no more work than trimming it once."""
    draw, letters = random.Random(8), list("ab é漢😀") + list(values.EDGE)[:3]
    texts = [None, "", " \t", "a" * 200, "a" * 201, "a" * 200 + " \n", "a" * 199 + " b", " " * 300 + "b" * 200 + "\u3000" * 300, "a" + " " * 300 + "b", "a" + " " * 300]
    texts += ["".join(draw.choices(values.EDGE, k=draw.choice([0, 1, 60]))) + "".join(draw.choices(letters, k=draw.randint(195, 205))) + "".join(draw.choices(values.EDGE, k=draw.choice([0, 1, 60]))) for _ in range(500)]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    bare = [t.strip(values.EDGE) or None if t is not None else None for t in texts]
    expected = [t[:199] + "…" if t and len(t) > 200 else t for t in bare]
    assert [r["t"] for r in rows.shown(df, ["t"]).collect()] == expected
    told = sorted(Counter(v for v in expected if v is not None).items(), key=lambda x: (-x[1], x[0].encode()))
    assert [tuple(r) for r in profile.categories(df, "t").collect()] == told[:200]

    long = written(spark.range(0, 40_000, 1, 4).select(F.concat(F.lit(" "), F.repeat(F.lit("ab cd "), 1000), F.col("id").cast("string")).alias("t")), "texts")

    def seconds(query) -> float:
        began = time.monotonic()
        assert query().collect()  # planned anew: a plan that has run keeps its shuffle
        return time.monotonic() - began

    listing, trimming = [min(seconds(q) for _ in range(3)) for q in (lambda: profile.categories(long, "t"), lambda: long.agg(F.max(F.length(F.btrim("t", F.lit(values.EDGE))))))]
    assert listing < 2 * trimming


def test_names():
    assert [n for n in ("id", "user_id", "userID", "ID", "width", "VALID", "GUID") if names.is_identifier(n)] == ["id", "user_id", "userID", "ID", "GUID"]
    assert names.component_names("x", 1) == ["COMP_x"] and names.component_names("", 2) == ["PC1", "PC2"]
    assert names.shared_label(["sepal_len", "petal_len"]) == "al_len"
    assert names.declared_codes("-99, , 7;7") == [-99.0, 7.0]


def test_filters(spark):
    df = spark.createDataFrame([(1, 5, "a"), (2, None, "b"), (3, 9, None)], "id int, score int, grp string")
    ids = lambda *c: [r["id"] for r in filters.kept(df, list(c)).orderBy("id").collect()]
    assert ids({"column": "score", "op": "neq", "value": 5}) == [3]
    assert ids({"column": "grp", "op": "in", "value": ["a", "b"]}) == [1, 2]
    assert ids({"column": "score", "op": "gt", "value": "x"}) == []
    assert ids() == [1, 2, 3]
    assert filters.problems(df, [{"column": "z", "op": "eq", "value": 1}])
    plan_ = filters.kept(df, [{"column": "score", "op": "gte", "value": 5}])._jdf.queryExecution().optimizedPlan().toString()
    assert "score" in plan_ and "regexp" not in plan_


def test_components_closed_form(spark):
    rng = np.random.default_rng(42)
    f = rng.standard_normal(2000)
    x = np.stack([f + 0.6 * rng.standard_normal(2000), f + 0.6 * rng.standard_normal(2000)], 1)
    df = spark.createDataFrame(x.tolist(), "a double, b double")
    model = components.fit(df, ["a", "b"], k=2)
    r = np.corrcoef(x.T)[0, 1]
    assert model.eigenvalues == pytest.approx([1 + r, 1 - r])
    scores = model.transform(df).agg(F.var_pop("PC1").alias("v1"), F.var_pop("PC2").alias("v2")).first()
    assert (scores["v1"], scores["v2"]) == pytest.approx((1 + r, 1 - r))
    with pytest.raises(ValueError, match="constant"):
        components.fit(df.withColumn("c", F.lit(5.0)), ["a", "c"])


def test_iterative_imputation_beats_the_median(spark):
    rng = random.Random(1)
    full = [(t + rng.gauss(0, 0.1), 2 * t + rng.gauss(0, 0.1), -t + rng.gauss(0, 0.1)) for t in (rng.gauss(0, 1) for _ in range(200))]
    holed = [(a if k % 5 else None, b, c) for k, (a, b, c) in enumerate(full)]
    df = spark.createDataFrame(holed, "a double, b double, c double")
    got = {tuple(r["x"][1:]): r["x"][0] for r in components.impute(df, ["a", "b", "c"], rank=1, rounds=20)[0].collect()}
    seen = sorted(a for a, *_ in holed if a is not None)
    middle = seen[len(seen) // 2]
    error = lambda guess: sum(abs(guess(r) - r[0]) for k, r in enumerate(full) if not k % 5)
    assert error(lambda r: got[r[1:]]) < 0.7 * error(lambda r: middle)
    assert all(got[r[1:]] == r[0] for k, r in enumerate(full) if k % 5)


def plain_imputation(x, rank, rounds, tolerance=1e-8):
    """Rows refilled one round after the other."""
    gap = np.isnan(x)
    x = np.where(gap, np.nanmean(x, 0), x)
    for turn in range(1, rounds + 1):
        mean, unit = x.mean(0), x.std(0)
        values, vectors = components.eigen(np.corrcoef(x.T))
        shrink = np.maximum(0, values[:rank] - values[rank:].mean()) / values[:rank]
        new = ((x - mean) / unit) @ ((vectors[:, :rank] * shrink) @ vectors[:, :rank].T) * unit + mean
        moved, size = ((new - x)[gap] ** 2).sum(), (new[gap] ** 2).sum()
        x = np.where(gap, new, x)
        if moved <= tolerance * size:
            break
    return x, turn


@pytest.mark.parametrize("held", [1024, 3])
def test_imputation_by_patterns_is_that_by_rows(spark, monkeypatch, held):
    monkeypatch.setattr(gaps, "PATTERNS", held)
    rng = np.random.default_rng(3)
    x = rng.normal(size=(200, 2)) @ rng.normal(size=(2, 5)) * 3 + rng.normal(size=(200, 5)) + np.arange(5) * 10
    x[rng.uniform(size=x.shape) < 0.2] = np.nan
    df = spark.createDataFrame([tuple(None if np.isnan(v) else float(v) for v in r) for r in x], "a double, b double, c double, d double, e double").repartition(3)
    rounds = 200 if held > 3 else 8
    got, told = components.impute(df, list("abcde"), rank=2, rounds=rounds)
    want, turns = plain_imputation(x, 2, rounds)
    assert told["iterations"] == turns and told["converged"] == (held > 3)
    found, want = (np.array(sorted(map(tuple, v))) for v in ([r["x"] for r in got.collect()], want))
    assert np.abs(found - want).max() < 1e-9


def test_kmeans_dbscan_silhouette(spark):
    rng = random.Random(0)
    blobs = [(k, [rng.gauss(10 * (k % 2), 0.5), rng.gauss(0, 0.5)]) for k in range(100)]
    df = spark.createDataFrame(blobs, "_row long, x array<double>")
    for labels in (clusters.kmeans_reference(df, 2), clusters.kmeans_scaled(df, 2), clusters.dbscan(df, 1.5, 4)):
        got = {r["_row"]: r["Cluster"] for r in labels.collect()}
        assert len(set(got.values())) == 2 and all(got[k] == got[k % 2] for k in got)
    best = max(clusters.silhouette_by_k(df, 4), key=lambda r: r["silhouette"])
    assert best["k"] == 2
    lattice = spark.createDataFrame([(k, [float(k), 0.0]) for k in range(40)], "_row long, x array<double>")
    assert {r["d"] for r in clusters.k_distances(lattice, 2).collect()} == {1.0}


def dbscan_by_scan(x, eps, least):
    near = [[j for j in range(len(x)) if (x[i][0] - x[j][0]) ** 2 + (x[i][1] - x[j][1]) ** 2 <= eps * eps] for i in range(len(x))]
    label, n = [None] * len(x), -1
    for i in range(len(x)):
        if label[i] is not None or len(near[i]) < least:
            continue
        n += 1
        todo = [i]
        while todo:
            j = todo.pop()
            if label[j] is None:
                label[j] = f"Cluster {n}"
                if len(near[j]) >= least:
                    todo += near[j]
    return [v or "Noise" for v in label]


def test_dbscan_against_the_sequential_scan(spark):
    rng = random.Random(5)
    x = [[float(rng.randint(0, 9)), float(rng.randint(0, 9))] for _ in range(70)]
    df = spark.createDataFrame(list(enumerate(x)), "_row long, x array<double>")
    assert [r["Cluster"] for r in clusters.dbscan(df, 1.0, 4).orderBy("_row").collect()] == dbscan_by_scan(x, 1.0, 4)


def test_codes(spark):
    df = spark.createDataFrame([(float(v),) for v in [1] * 12 + [3] * 20 + [5] * 25 + [7] * 15 + [9] * 8], "q double")
    assert [(r["value"], r["confidence"]) for r in codes.found(df, ["q"]).collect()] == [(9.0, "likely")]
    clean = spark.createDataFrame([(float(v),) for v in range(100)], "q double")
    assert codes.found(clean, ["q"]).count() == 0


def test_histogram_and_ecdf(spark):
    s = charts.series(pairs(spark, a=[0, 1, 2, 3, 5]), "v")
    assert {r["bin"]: r["n"] for r in charts.histogram(s, 5).collect()} == {0: 1, 1: 1, 2: 1, 3: 1, 4: 1}
    assert {r["v"]: r["share"] for r in charts.ecdf(s).collect()} == {0: 0.2, 1: 0.4, 2: 0.6, 3: 0.8, 5: 1.0}


def test_transfer_last_wins_and_null_matches_null(spark):
    left = spark.createDataFrame([(0, "a"), (1, None), (2, "z")], "_row long, k string")
    right = spark.createDataFrame([(0, "a", 1), (1, "a", None), (2, None, 7)], "_row long, k string, v int")
    got = {r["_row"]: r["n"] for r in transfer.by_key(left, right, "v", "k", "n").collect()}
    assert got == {0: None, 1: 7, 2: None}
    numbered = transfer.with_rows(spark.range(1000).withColumn("r", F.rand(1)), ["r"]).orderBy("r").collect()
    assert [r["_row"] for r in numbered] == list(range(1000))


def table(spark, **more):
    data = [(k, float(k % 7), "abc"[min(2, k // 6)] if k < 11 else "c", f"2024-01-{k + 1:02d}") for k in range(12)]
    return Dataset.of(spark.createDataFrame(data, "participant_id int, sepal_len double, species string, day string"), ["participant_id"], **more)


def test_plans_and_policy(spark):
    private, open_ = table(spark), table(spark, mode="open")
    codes_of = lambda ds, p: [x["code"] for x in plan.problems(p, ds.profile())]
    t = {"kind": "test", "test": "t", "column": "sepal_len", "groupBy": "species"}
    assert codes_of(open_, {"kind": "x"}) == ["bad_plan_shape"]
    assert codes_of(open_, t | {"column": "nope"}) == ["unknown_column"]
    assert codes_of(open_, t | {"column": "species"}) == ["wrong_column_type"]
    assert codes_of(open_, {"kind": "chart", "mark": "line", "column": "sepal_len", "x": "species"}) == ["not_temporal"]
    assert codes_of(open_, {"kind": "chart", "mark": "histogram", "column": "sepal_len", "bins": 3}) == ["bad_bins"]
    hidden = plan.problems(t | {"groups": ["a", "c"]}, private.profile())
    missing = plan.problems(t | {"groups": ["a", "q"]}, private.profile())
    assert [str(x).replace('"c"', '"q"') for x in hidden] == [str(x) for x in missing] or all(x["code"] != "unknown_group_value" for x in hidden)
    assert open_.run_plan({"kind": "chart", "mark": "bar", "column": "species"}).count() >= 2
    assert policy.filter_floor(4, 100, "private") == "too-few-shown" and policy.filter_floor(98, 100, "private") == "too-few-excluded"
    with pytest.raises(PermissionError):
        private.sample_rows(3)


def test_dataset_flow(spark):
    ds = table(spark, mode="open").filtered([{"column": "sepal_len", "op": "lt", "value": 6}])
    scored, model = ds.run_pca(["participant_id", "sepal_len"], k=1, label="x")
    assert model.names == ["COMP_x"] and scored.df.where("COMP_x IS NULL").count() == 1
    assert ds.run_clustering(["participant_id", "sepal_len"], k=2).df.where("Cluster IS NULL").count() == 1
    assert ds.correlate("participant_id", "sepal_len")["n"] == 11


def test_scores_are_added_without_a_join(spark):
    df = spark.range(60).select("id", (F.col("id") % 7).alias("a"), (F.col("id") % 11).alias("b"), F.expr("if(id % 4 > 0, 'x', null)").alias("g"))
    ds = Dataset.of(df, ["id"], mode="open").run_pca(["a", "b"], 2, label="r")[0]
    ds = ds.filtered([{"column": ds.columns()[-1], "op": "gt", "value": 0}, {"column": "g", "op": "eq", "value": "x"}])  # by a column that goes
    shown = {r["id"] for r in ds.visible().collect()}
    again, model = ds.run_pca(["a", "b"], 1, label="r")
    assert {r["id"] for r in again.df.where(F.col(f"`{model.names[0]}`").isNotNull()).collect()} == shown and again.df.count() == 60
    assert "Join" not in again.df._jdf.queryExecution().optimizedPlan().toString()


def test_sources_and_sinks(spark, tmp_path):
    from strata.sources import sinks, tables

    path = tmp_path / "a.csv"
    path.write_text('x,x,,note\n1,2,3,"=cmd, ""q"""\n\n4,,6,plain\n')
    df, said = tables.read_table(spark, str(path))
    assert df.columns == ["x", "x_1", "note"] and dict(df.dtypes)["x"] == "double" and len(said) == 2
    sinks.write_csv(df, str(tmp_path / "out"))
    text = "".join(p.read_text(encoding="utf-8") for p in sorted((tmp_path / "out").glob("part*")))
    assert "'=cmd" in text and '""q""' in text
    (tmp_path / "b.xlsx").write_bytes(sinks.xlsx_bytes(df))
    back, _ = tables.read_table(spark, str(tmp_path / "b.xlsx"))
    assert back.columns == df.columns and back.count() == df.count()
    empty = df.where("x > 100")
    sinks.write_csv(empty, str(tmp_path / "none"))
    assert "".join(p.read_text(encoding="utf-8") for p in (tmp_path / "none").glob("part*")) == "\ufeffx,x_1,note\n"
    ds = table(spark)
    sinks.save_workspace(spark, str(tmp_path), "w", [ds, ds])
    assert [w["name"] for w in sinks.list_workspaces(spark, str(tmp_path))] == ["w"]
    first, second = sinks.load_workspace(spark, str(tmp_path), "w")
    assert first.df.count() == 12 and second.mode == "private"
    assert "newer" in sinks.manifest_problems({"version": 2})[0]
    assert sinks.delete_workspace(spark, str(tmp_path), "w") and not sinks.delete_workspace(spark, str(tmp_path), "w")
    assert not sinks.list_workspaces(spark, str(tmp_path)) and (tmp_path / "a.csv").exists()


def test_csv_warnings_name_lines(spark, tmp_path):
    from strata.sources import tables

    def read(text, **conf):
        path = tmp_path / f"f{len(list(tmp_path.iterdir()))}.csv"
        path.write_text(text)
        df, said = tables.read_csv(spark, str(path))
        return [tuple(r) for r in df.collect()], said

    got, said = read("a,b,c\n1,2,3\n4,5,6,7\n\n,,\n8,9\n")
    assert got == [(1, 2, 3), (4, 5, 6), (8, 9, None)]
    assert "1 row(s) had more values" in said[0] and "(line 3)" in said[0] and "1 row(s) had fewer" in said[1] and "(line 6)" in said[1]
    got, said = read('a,b\n1,"x, ""y"""\n2,z\n')
    assert got == [(1, 'x, "y"'), (2, "z")] and not said
    got, said = read('a,b\n1,"two\nlines"\n2,z\n')
    assert got == [(1, "two\nlines"), (2, "z")] and not said
    got, said = read('a,b\n"oops,2\n3,4\n5,6\n')
    assert len(got) == 1 and "unclosed quotation mark near line 2" in said[0]
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "64b")
    try:
        got, said = read("a,b\n" + "".join(f"{k},{k}\n" if k % 40 else f"{k}\n" for k in range(300)))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert len(got) == 300 and "8 row(s) had fewer" in said[0] and "(line 2, 42, 82, 122, 162, …)" in said[0]


def test_dataset_from_a_file(spark, tmp_path):
    from strata.plans.dataset import Dataset

    path = tmp_path / "sales.csv"
    path.write_text('region,price,amount\nn,"1,234",5\ns,"2,500",6\ns,"3,000"\n')
    with pytest.raises(ValueError, match="two columns"):
        Dataset.from_path(spark, str(path))
    ds = Dataset.from_path(spark, str(path), repair=True, name="sales", mode="open")
    assert [(r["_row"], r["price"]) for r in ds.df.orderBy("_row").collect()] == [(0, 1234), (1, 2500), (2, 3000)]
    assert any("fewer values" in x for x in ds.log) and any("price" in x for x in ds.log)
    assert ds.profile() is ds.profile() and ds.recoded({"price": [1234.0]}).profile() is not ds.profile()


def test_profile_floor_and_colour(spark):
    df = spark.createDataFrame([(float(v), "ab"[v % 2]) for v in (1, 2, 3, 4, 5, 6, 7, 7, 7, 7, 7)], "v double, g string")
    r = profile.numeric_summary(df, ["v"]).first()
    assert r["lowest"] is None and r["highest"] == 7
    assert profile.default_colour(df) == "g" and profile.default_axes(df) == ["v"]
    assert rows.z_scores(df.withColumn("c", F.lit(1.0)), ["c"]).where("c = 0").count() == 11


def test_silhouette_and_k_distances_cover_every_row(spark):
    rng = np.random.default_rng(5)
    x = np.concatenate([rng.normal(0, 1, (1300, 2)), rng.normal(40, 0.01, (1195, 2)), np.full((5, 2), -900.0)]).round(3)
    labels = np.array(["a" if p[0] < 20 else "b" for p in x])
    df = spark.createDataFrame([(i, p.tolist(), c) for i, (p, c) in enumerate(zip(x, labels.tolist()))], "_row long, x array<double>, Cluster string")
    d = np.sqrt(clusters.squared(x, x))
    np.fill_diagonal(d, np.inf)
    got = {r["_row"]: r["d"] for r in clusters.k_distances(df, 7).collect()}
    assert len(got) == len(x) and np.allclose([got[i] for i in range(len(x))], np.sort(d, 1)[:, 5])
    one = clusters.silhouette(df).first()
    assert one["n"] == len(x) and abs(one["silhouette"] - clusters.mean_silhouette(x, labels)) < 1e-9


@pytest.mark.parametrize("dims", [1, 3])
def test_trees_of_boxes(spark, monkeypatch, dims):
    """Clusters of very different density, outliers and copies, over several levels."""
    monkeypatch.setattr(trees, "BLOCK", 16)
    monkeypatch.setattr(trees, "FAN", 4)
    rng = np.random.default_rng(6)
    x = np.concatenate([rng.normal(0, 1, (300, dims)), rng.normal(9, 1e-4, (300, dims)), rng.uniform(-1e3, 1e3, (60, dims)), np.zeros((30, dims))])
    labels = np.array([f"{int(p[0] > 3)}{int(abs(p[0]) > 20)}" for p in x])
    labels[0] = "alone"
    df = spark.createDataFrame([(i, p.tolist(), c) for i, (p, c) in enumerate(zip(x, labels.tolist()))], "_row long, x array<double>, Cluster string")
    d = np.sqrt(clusters.squared(x, x))
    np.fill_diagonal(d, np.inf)
    for least in (5, 60):  # fewer and more than a leaf has
        got = {r["_row"]: r["d"] for r in clusters.k_distances(df, least).collect()}
        assert len(got) == len(x) and np.allclose([got[i] for i in range(len(x))], np.sort(d, 1)[:, least - 2], rtol=1e-9, atol=0)
    want = clusters.mean_silhouette(x, labels)
    for tolerance in (0.0, 0.1):
        one = clusters.silhouette(df, tolerance=tolerance).first()
        assert one["n"] == len(x) and abs(one["silhouette"] - want) <= one["error"] + 1e-12
        assert one["error"] == 0 if tolerance == 0 else 0 < one["error"] < 0.1


def test_sums_of_distances_are_within_their_bounds(spark, monkeypatch):
    monkeypatch.setattr(trees, "BLOCK", 16)
    x = np.random.default_rng(7).uniform(0, 1, (400, 2))
    df = spark.createDataFrame([(p.tolist(), 1, "a" if p[0] < 0.5 else "b") for p in x], "x array<double>, copies long, c string")
    found = trees.tree(df)
    of = {tuple(r["x"]): r["place"] for r in found.placed.collect()}
    d, place = np.sqrt(clusters.squared(x, x)), [of[tuple(p)] for p in x]
    got = {(r["i"], r["cj"]): r for r in trees.sums(found, 0.05).collect()}
    settled = 0
    for c, side in (("a", x[:, 0] < 0.5), ("b", x[:, 0] >= 0.5)):
        for i, want in zip(place, d[:, side].sum(1)):
            one = got[i, c]
            assert abs(one["s"] - want) <= one["e"] + 1e-9 and one["e"] <= 0.05 * want and one["n"] == side.sum()
            settled += one["e"] > 0
    assert settled > 100


def test_silhouette_of_copies_is_that_of_all_rows(spark, monkeypatch):
    """Equal points are one place of the tree, however often they occur."""
    monkeypatch.setattr(trees, "BLOCK", 4)
    rng = np.random.default_rng(3)
    x = rng.integers(0, 6, (40, 2)).astype(float)
    x, c = np.concatenate([x] * 5), np.array([str(int(k) % 3) for k in range(40)] * 5)
    df = spark.createDataFrame([(k, p.tolist(), l) for k, (p, l) in enumerate(zip(x, c.tolist()))], "_row long, x array<double>, Cluster string")
    taken, tree = [], trees.tree
    monkeypatch.setattr(trees, "tree", lambda points: taken.append(points.count()) or tree(points))
    got = clusters.silhouette(df).first()
    assert got["n"] == 200 and got["silhouette"] == pytest.approx(clusters.mean_silhouette(x, c)) and taken[0] <= 40


def test_diagnosis_counts_equal_cells_together(spark):
    df = spark.createDataFrame([("$1",)] * 6 + [("5",), ("2020-01-02",), (None,)], "a string").withColumn("raw", F.lit(bytearray(b"12"))).withColumn("n", F.lit(2))
    got = {r["column_name"]: tuple(r)[1:6] for r in profile.diagnosis(df).collect()}
    assert got == {"a": (8, 1, 7, 1, "numeric"), "raw": (9, 0, 0, 0, "text"), "n": (9, 9, 9, 0, "numeric")}


def test_diagnostics_of_few_or_no_points(spark):
    schema = "_row long, x array<double>, Cluster string"
    none, one = spark.createDataFrame([], schema), spark.createDataFrame([(0, [1.0, 2.0], "a"), (1, None, "a"), (2, [1.0, 2.0], None)], schema)
    assert clusters.silhouette(none).collect() == [(None, None, 0)]
    assert clusters.silhouette(one).collect() == [(0.0, 0.0, 1)]
    assert clusters.k_distances(none, 3).count() == 0 and clusters.k_distances(one, 3).count() == 0
    assert sorted((r["_row"], r["d"]) for r in clusters.k_distances(one, 2).collect()) == [(0, 0.0), (2, 0.0)]


def test_running_counts_in_ranges(spark, monkeypatch):
    rng = random.Random(5)
    rows = [(rng.choice("ab"), float(rng.randint(0, 400))) for _ in range(3000)] + [("c", 1.0), ("c", None), (None, 2.0)]
    df = spark.createDataFrame(rows, "grp string, v double")
    whole = {(r["grp"], r["v"]): tuple(r) for r in ranks.midranks_by(df).collect()}
    monkeypatch.setattr(ranks, "RANGE", 7)
    assert {(r["grp"], r["v"]): tuple(r) for r in ranks.midranks_by(df).collect()} == whole
    for r in ranks.quantiles(df, {"q": 0.3, "m": 0.5, "hi": 1.0}).where("grp IS NOT NULL").collect():
        own = [v for g, v in rows if g == r["grp"] and v is not None]
        assert r["n"] == len(own) and [r["q"], r["m"], r["hi"]] == pytest.approx(np.quantile(own, [0.3, 0.5, 1.0]).tolist())


def test_kmeans_on_all_rows_is_the_reference_on_one_chunk(spark, monkeypatch):
    rng = np.random.default_rng(3)
    x = np.concatenate([rng.normal(c, 0.4, (300, 2)) for c in ((0, 0), (4, 0), (0, 5), (6, 6))])
    rng.shuffle(x)
    points = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "_row long, x array<double>")
    small = {r["_row"]: r["Cluster"] for r in clusters.kmeans_reference(points, 5).collect()}
    monkeypatch.setattr(clusters, "SAMPLE", 137)
    assert {r["_row"]: r["Cluster"] for r in clusters.kmeans_reference(points, 5).collect()} == small


def test_chi_square_of_many_levels(spark):
    rng = random.Random(9)
    rows = [(f"a{rng.randint(0, 30)}", f"b{rng.randint(0, 20)}") for _ in range(900)]
    got = hypothesis.chi_square(spark.createDataFrame(rows, "a string, b string"), "a", "b")
    n, r, c, both = len(rows), Counter(a for a, _ in rows), Counter(b for _, b in rows), Counter(rows)
    want = sum((both[a, b] - r[a] * c[b] / n) ** 2 / (r[a] * c[b] / n) for a in r for b in c)
    assert got["statistic"] == pytest.approx(want) and got["low_expected"] == sum(r[a] * c[b] / n < 5 for a in r for b in c)


def test_seeded_sample_is_the_first_steps_of_a_shuffle(spark):
    from strata.functions.draws import Mulberry32, sample_places

    def shuffled(n, k, seed):
        draw, every = Mulberry32(seed), list(range(n))
        for i in range(k):
            j = i + int(draw() * (n - i))
            every[i], every[j] = every[j], every[i]
        return sorted(every[:k])

    for n, k, seed in ((10, 3, 1), (500, 499, 7), (4800, 1200, 0x5CA7), (5, 9, 1)):
        assert sample_places(n, k, seed) == (shuffled(n, k, seed) if n > k else list(range(n)))
    df = spark.range(300).select((F.col("id") * 3).alias("key"))
    assert [r["key"] for r in rows.sample(df, 20, ["key"], 5).collect()] == [3 * p for p in shuffled(300, 20, 5)]
    assert rows.sample(df.limit(4), 20, ["key"]).count() == 4


def test_charts_tell_what_they_leave_out(spark):
    from strata.plans.dataset import Dataset

    data = [(i, "a" if i % 2 else "b", float(i)) for i in range(20)] + [(20, "c", 1.0), (21, "c", None)]
    ds = Dataset(spark.createDataFrame(data, "_row long, g string, v double"))
    got = ds.chart({"kind": "chart", "mark": "histogram", "column": "v", "groupBy": "g"})
    assert got["withheld_rows"] == 1 and "1 rare value(s) of g (1 rows)" in got["notes"][0]
    assert got["summary"].splitlines() == ["a: n=10, min=1, q1=5.5, median=10, q3=14.5, max=19", "b: n=10, min=0, q1=4.5, median=9, q3=13.5, max=18"]
