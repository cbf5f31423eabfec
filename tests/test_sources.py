"""CSV in blocks against the standard library's reader, and workspaces that are saved over themselves."""

import csv
import io
import json
import random

import pytest
from pyspark.sql import functions as F

from strata.plans.dataset import Dataset
from strata.sources import records, sinks, tables


@pytest.fixture
def small_blocks(spark):
    """Files are cut every few hundred bytes."""
    before = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.maxPartitionBytes", "300")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    yield
    for k, v in before.items():
        spark.conf.set(k, v)


def test_after_a_line_like_the_standard_reader():
    rng = random.Random(4)
    for _ in range(4000):
        line = "".join(rng.choice('ab,"" ') for _ in range(rng.randrange(12)))
        for inside in (False, True):
            # inside: the line follows an open quote; a further record tells whether the quote is closed by then
            text = ('"' if inside else "") + line + "\nZ"
            rows = list(csv.reader(io.StringIO(text, newline="")))
            assert records.after(line, ",", inside) == (rows[-1] != ["Z"]), (line, inside)


def random_csv(seed, n, end):
    rng = random.Random(seed)
    cell = lambda: "".join(rng.choice(["a", "b", " ", ",", '"', end, "é", "\t"]) for _ in range(rng.choice([0, 1, 3, 9, 60])))
    rows = [[f"k{k}", cell(), cell()] for k in range(n)]
    out = io.StringIO(newline="")
    w = csv.writer(out, lineterminator=end)
    w.writerow(["key", "one\nname" if end == "\n" else "one", "two"])
    w.writerows(rows)
    return out.getvalue(), rows


@pytest.mark.parametrize("end", ["\n", "\r\n", "\r"])
def test_line_breaks_in_cells_are_read_in_blocks(spark, tmp_path, small_blocks, end):
    text, rows = random_csv(len(end), 300, end)
    (tmp_path / "a.csv").write_bytes(text.encode())
    got, said = tables.read_csv(spark, str(tmp_path / "a.csv"))
    blank = lambda v: v.strip() or None
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(str((a, blank(b), blank(c))) for a, b, c in rows)
    assert not said and spark.read.text(str(tmp_path / "a.csv")).rdd.getNumPartitions() > 10


def test_ragged_records_and_open_quotes_are_told(spark, tmp_path, small_blocks):
    lines = ["a,b,c"] + [f'{k},"x\n\ny{k}",z' for k in range(60)] + ["1,2", '3,"4\n",5,6', ""] + ["7,8,9"] * 30
    (tmp_path / "r.csv").write_text("\n".join(lines) + "\n")
    got, said = tables.read_csv(spark, str(tmp_path / "r.csv"))
    assert got.count() == 92
    assert said == ["1 row(s) had more values than the header has columns (line 183); the extra values were discarded", "1 row(s) had fewer values than the header has columns (line 182); the missing values are blank"]
    (tmp_path / "o.csv").write_text("\n".join(["a,b"] + [f"{k},text {k}" for k in range(80)] + ['"oops,2'] + ["3,4"] * 100))
    got, said = tables.read_csv(spark, str(tmp_path / "o.csv"))
    assert got.count() == 81 and "unclosed quotation mark near line 82" in said[0]
    assert got.where(F.col("a").startswith("oops,2\n3,4")).count() == 1


def test_quotes_within_cells_and_long_cells(spark, tmp_path):
    (tmp_path / "q.csv").write_text('a,b\n5" pipe,1\n6" pipe,2\n')
    got, said = tables.read_csv(spark, str(tmp_path / "q.csv"))
    assert sorted(map(tuple, got.collect())) == [('5" pipe', 1.0), ('6" pipe', 2.0)] and not said
    long = "x y " * 250_000
    (tmp_path / "l.csv").write_text(f'a,b\n"{long}",1\n"{long.replace("x", chr(34) * 2)}",2\n')
    got, said = tables.read_csv(spark, str(tmp_path / "l.csv"))
    assert sorted(r[1] for r in got.select("b", F.length("a")).collect()) == [999_999, 999_999] and not said


def test_records_are_joined_once_and_blank_rows_go_without_lambdas(spark, tmp_path):
    """What is read of a file again and again is a written table, and its cells are plain expressions."""
    (tmp_path / "t.csv").write_text('a,b\n1,"x\ny"\n" ", \n2,"$1,5"\n')
    got, _ = tables.read_csv(spark, str(tmp_path / "t.csv"))
    assert sorted(map(tuple, got.collect())) == [(1.0, "x\ny"), (2.0, "$1,5")]
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "MapInArrow" not in plan and "forall" not in plan
    rows = spark.createDataFrame([(v,) for v in ["1,2", "1,2,3", '"a,""b",2,3,4', " , ,", "", '1,"2', "1;2;3"]], "value string")
    told = [tuple(r)[1:] for r in tables.with_faults(rows, ",", 3).collect()]
    assert told == [(True, False, False), (False, False, False), (False, True, False), (False, False, False), (False, False, False), (True, False, True), (True, False, False)]


def table_of(spark, n=20):
    return Dataset.of(spark.range(n).select(F.col("id").cast("double").alias("x"), (F.col("id") % 3).cast("double").alias("y")), ["x"], name="one", mode="open")


def test_a_workspace_is_saved_over_itself(spark, tmp_path):
    folder = str(tmp_path)
    sinks.save_workspace(spark, folder, "w", [table_of(spark)])
    (ds,) = sinks.load_workspace(spark, folder, "w")
    sinks.save_workspace(spark, folder, "w", [ds.recoded({"y": [2.0]}), ds])
    again, same = sinks.load_workspace(spark, folder, "w")
    assert again.df.where("y IS NULL").count() == 6 and same.df.where("y IS NULL").count() == 0
    (old,) = sinks.load_workspace(spark, folder, "w", version=1)
    assert old.df.count() == 20
    assert sinks.cleared(spark, folder, "w") == ["manifest-000000001"]  # the unchanged table is the second version's too
    sinks.save_workspace(spark, folder, "w", [again])
    assert len(sinks.cleared(spark, folder, "w")) == 2 and sinks.load_workspace(spark, folder, "w")[0].df.count() == 20
    assert [w["datasets"] for w in sinks.list_workspaces(spark, folder)] == [["one"]]


def test_a_failed_save_keeps_the_last_version(spark, tmp_path):
    folder = str(tmp_path)
    sinks.save_workspace(spark, folder, "w", [table_of(spark)])
    bad = table_of(spark)
    bad.df = bad.df.withColumn("z", F.raise_error(F.lit("no")).cast("double"))
    with pytest.raises(Exception, match="no"):
        sinks.save_workspace(spark, folder, "w", [bad])
    assert sinks.load_workspace(spark, folder, "w")[0].df.count() == 20
    assert len(sinks.cleared(spark, folder, "w")) == 1  # what the failed save left
    assert not sinks.save_session(spark, folder, [bad])


def test_sessions_are_saved_loaded_and_cleared(spark, tmp_path):
    folder = str(tmp_path)
    assert sinks.load_session(spark, folder) == [] and not sinks.clear_session(spark, folder)
    for k in range(4):
        assert sinks.save_session(spark, folder, [table_of(spark, 10 + k)])
    (ds,) = sinks.load_session(spark, folder)
    assert ds.df.count() == 13 and sinks.list_workspaces(spark, folder) == []
    assert sinks.save_session(spark, folder, [ds.recoded({"y": [1.0]})]) and sinks.load_session(spark, folder)[0].df.where("y IS NULL").count() == 4
    assert ds.df.count() == 13  # what the session still reads is not cleared
    assert sinks.clear_session(spark, folder) and sinks.load_session(spark, folder) == []


def test_inline_tables_and_json_arrays(spark, tmp_path):
    rows = [{"a": 1, "b": "x"}, {"a": None, "b": "2"}, {"b": None, "c": True}]
    (tmp_path / "w.json").write_text(json.dumps({"version": 1, "tables": {"t0": rows}, "datasets": [{"name": "d", "table": "t0", "mode": "open"}, {"name": "e", "table": "t0"}]}, indent=1))
    d, e = sinks.import_workspace(spark, str(tmp_path / "w.json"))
    assert [tuple(r) for r in d.df.orderBy("_row").select("a", "b", "c").collect()] == [(1.0, "x", None), (None, "2", None), (None, None, 1.0)]
    assert d.mode == "open" and e.name == "e" and e.df is d.df
    for bad in ("{", json.dumps({"version": 2}), json.dumps({"version": 1, "tables": {"t0": [1]}, "datasets": []}), json.dumps({"version": 1, "tables": {}, "datasets": [{"name": "d", "table": "t"}]})):
        (tmp_path / "bad.json").write_text(bad)
        with pytest.raises(ValueError):
            sinks.import_workspace(spark, str(tmp_path / "bad.json"))
    df = spark.createDataFrame([(k, None if k % 2 else f"t\n{k}") for k in range(7)], "k long, t string").repartition(2)
    sinks.write_json(df, str(tmp_path / "j"), array=True)
    read = [r for f in sorted((tmp_path / "j").glob("part-*")) for r in json.loads(f.read_text())]
    assert sorted((r["k"], r["t"]) for r in read) == [(k, None if k % 2 else f"t\n{k}") for k in range(7)]


def test_summaries_are_what_expressions_say(spark):
    """Cells of every kind, in several parts, against the same notions as Column expressions."""
    from strata.functions.values import label, number, temporal
    from strata.operators import profile, summaries

    rng = random.Random(9)
    texts = [" 12 ", "12", "+1.5", ".5", "5.", "1e400", "-0", "0", "NaN", "x", "", "  ", None, "2020-01-02", "2020-01-02T10:00", "1/2/2020", " 7 ", "1,000", "1e3", "é"]
    rows = [(rng.choice(texts), rng.choice([None, 1.5, float("nan"), float("inf"), -0.0, 0.0, 2.0]), rng.choice([None, True, False]), rng.choice([None, 7, 2**60]), rng.choice(["a", "b"]) + str(k % 70), [1, None]) for k in range(400)]
    df = spark.createDataFrame(rows, "t string, d double, b boolean, i long, many string, other array<int>").withColumn("time", F.expr("timestampadd(DAY, i % 5, timestamp'2020-01-01 00:00:00.123')")).withColumn("dec", F.expr("CAST(i % 9 AS DECIMAL(5,1))")).repartition(5)
    found = summaries.Summary(df)
    exact, few = found.exact(), [c for c in df.columns if found.by[c]["n_values"] is not None]
    assert "many" not in few
    groups = found.groups(few)
    for c in df.columns:
        x, v, t = found.by[c], number(df, c), label(df, c)
        if c == "i":
            v = F.col("i").cast("double")
        one = df.agg(F.count_if(v.isNull() if c in ("d", "i", "dec") else t.isNull()).alias("missing"), F.count(v).alias("numbers"), F.min(v).alias("lo"), F.max(v).alias("hi"), F.count_if(temporal(df, c)).alias("dates"), F.count_distinct(v if c in ("d", "dec") else t).alias("n")).first()
        assert (x["missing"], x["numbers"], x["lo"], x["hi"], x["dates"]) == tuple(one[:5]), c
        assert exact[c] == one["n"], c
        if c in groups:
            want = {r["t"]: r["count"] for r in df.select(t.alias("t")).where("t IS NOT NULL").groupBy("t").count().collect()}
            assert dict(groups[c]) == want, c
    assert profile.scan(df.where("false")).select("missing", "n_unique", "kind").distinct().collect() == [(0, 0, "categorical")]
