"""Every registered query of the reference's operators, with its SQL.

Means and other sums of doubles are rounded on both sides, as the order of addition is free.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strata.functions import values
from strata.operators import charts, clusters, codes, components, filters, groups, hypothesis, profile, ranks, rows, transfer
from strata.session import shared_folder
from strata.sources import sinks, tables

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
FLAGSHIP = "group_compare"


def query(name: str, *tables: str, sql: str | None = None):
    """Register a function of the named tables' DataFrames."""

    def register(f):
        QUERIES[name] = lambda spark, sf_dir: f(*[spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in tables])
        if sql:
            ORACLES[name] = sql
        return f

    return register


def rounded(df: DataFrame, places: int, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(F.col(c), places) for c in columns})


# --- groups -------------------------------------------------------------------------------

@query("group_compare", "lineitem", sql="SELECT l_returnflag AS grp, count(*) AS n, round(avg(l_extendedprice), 4) AS mean, round(stddev_samp(l_extendedprice), 4) AS sd FROM lineitem GROUP BY l_returnflag")
def _(lineitem):
    return rounded(groups.compare(lineitem, "l_extendedprice", "l_returnflag"), 4, "mean", "sd")


@query("group_compare_events", "events", sql="SELECT event_type AS grp, count(*) AS n, round(avg(value), 6) AS mean, round(stddev_samp(value), 6) AS sd FROM events GROUP BY event_type")
def _(events):
    return rounded(groups.compare(events, "value", "event_type"), 6, "mean", "sd")


@query("group_effect", "customer", sql="""
WITH g AS (SELECT c_mktsegment AS grp, count(*) AS n, avg(c_acctbal) AS m, var_pop(c_acctbal) * count(*) AS w FROM customer GROUP BY 1),
t AS (SELECT sum(n) AS n, count(*) AS k, min(n) AS least, count(*) FILTER (n = 1) AS single, sum(w) AS w, sum(n * m) / sum(n) AS mean FROM g),
b AS (SELECT t.*, (SELECT sum(g.n * (g.m - t.mean) ** 2) FROM g) AS b FROM t)
SELECT n::BIGINT AS n, round(mean, 4) AS mean, round(sqrt((b + w) / (n - 1)), 4) AS sd, k AS n_groups, least AS min_group_n, single AS singletons,
       round(b / (b + w), 9) AS eta_squared, round((b - (k - 1) * w / (n - k)) / (b + w + w / (n - k)), 9) AS omega_squared FROM b""")
def _(customer):
    return rounded(rounded(groups.effect(customer, "c_acctbal", "c_mktsegment"), 4, "mean", "sd"), 9, "eta_squared", "omega_squared")


@query("crosstab", "lineitem", sql="SELECT l_returnflag AS a, l_linestatus AS b, count(*) AS n FROM lineitem GROUP BY 1, 2")
def _(lineitem):
    return groups.crosstab(lineitem, "l_returnflag", "l_linestatus")


@query("heat_map", "orders", sql="""
WITH c AS (SELECT o_orderstatus AS a, o_orderpriority AS b, count(*) AS n FROM orders GROUP BY 1, 2),
f AS (SELECT x.a, y.b, coalesce(c.n, 0) AS n FROM (SELECT DISTINCT a FROM c) x CROSS JOIN (SELECT DISTINCT b FROM c) y LEFT JOIN c ON c.a = x.a AND c.b = y.b)
SELECT a, b, n, round(n / sum(n) OVER (PARTITION BY a), 9) AS share FROM f""")
def _(orders):
    return rounded(groups.heat_map(orders, "o_orderstatus", "o_orderpriority"), 9, "share")


@query("cluster_breakdown", "part", sql="""
SELECT * FROM (SELECT a, b, n, row_number() OVER (PARTITION BY a ORDER BY n DESC, b) AS rank FROM (SELECT p_type AS a, p_brand AS b, count(*) AS n FROM part GROUP BY 1, 2) WHERE n >= 5) WHERE rank <= 6""")
def _(part):
    return groups.breakdown(part, "p_type", "p_brand")


@query("midranks", "part", sql="SELECT v, n, upto, upto - n + (n + 1) / 2 AS midrank FROM (SELECT v, n, (sum(n) OVER (ORDER BY v))::BIGINT AS upto FROM (SELECT p_retailprice AS v, count(*) AS n FROM part GROUP BY 1))")
def _(part):
    return ranks.midranks(part.select(values.number(part, "p_retailprice").alias("v")))


@query("correlation", "lineitem", sql="""
WITH r AS (SELECT l_quantity AS x, l_extendedprice AS y, rank() OVER (ORDER BY l_quantity) + (count(*) OVER (PARTITION BY l_quantity) - 1) / 2 AS rx,
  rank() OVER (ORDER BY l_extendedprice) + (count(*) OVER (PARTITION BY l_extendedprice) - 1) / 2 AS ry FROM lineitem)
SELECT count(*) AS n, round(corr(x, y), 9) AS pearson, round(corr(rx, ry), 9) AS spearman FROM r""")
def _(lineitem):
    return rounded(groups.correlation(lineitem, "l_quantity", "l_extendedprice"), 9, "pearson", "spearman")


# --- profiles -----------------------------------------------------------------------------

def scan_sql(table: str, numbers: list[str], texts: list[str]) -> str:
    parts = [f"SELECT '{c}' AS column_name, count(*) - count({c}) AS missing, count({c}) > 0 AS is_numeric, min({c})::DOUBLE AS min_value, max({c})::DOUBLE AS max_value, count(DISTINCT {c}) AS n_unique, CASE WHEN count(DISTINCT {c}) > 20 THEN 'continuous' ELSE 'categorical' END AS kind FROM {table}" for c in numbers]
    parts += [f"SELECT '{c}', count(*) - count({c}), false, NULL, NULL, count(DISTINCT {c}), CASE WHEN count(DISTINCT {c}) > 50 THEN 'too-many' ELSE 'categorical' END FROM {table}" for c in texts]
    return " UNION ALL ".join(parts)


@query("column_scan", "lineitem", sql=scan_sql("lineitem", ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax"], ["l_returnflag", "l_linestatus", "l_shipdate"]))
def _(lineitem):
    return profile.scan(lineitem)


@query("column_scan_part", "part", sql=scan_sql("part", ["p_partkey", "p_size", "p_retailprice"], ["p_name", "p_brand", "p_type"]))
def _(part):
    return profile.scan(part)


@query("numeric_summary", "lineitem", sql=" UNION ALL ".join(f"""
SELECT '{c}' AS column_name, count(*) AS n, 0::BIGINT AS missing, floor(avg(v) * 1e4 + 0.5) / 1e4 AS mean, floor(stddev_pop(v) * 1e4 + 0.5) / 1e4 AS sd, floor(q1 * 1e4 + 0.5) / 1e4 AS q1, floor(med * 1e4 + 0.5) / 1e4 AS median, floor(q3 * 1e4 + 0.5) / 1e4 AS q3,
  CASE WHEN count(*) FILTER (v = lo) >= 5 THEN floor(lo * 1e4 + 0.5) / 1e4 END AS lowest, CASE WHEN count(*) FILTER (v = hi) >= 5 THEN floor(hi * 1e4 + 0.5) / 1e4 END AS highest
FROM (SELECT v, min(v) OVER () AS lo, max(v) OVER () AS hi, max(CASE WHEN r = least(n - 1, n // 4) THEN v END) OVER () AS q1, max(CASE WHEN r = least(n - 1, n // 2) THEN v END) OVER () AS med, max(CASE WHEN r = least(n - 1, 3 * n // 4) THEN v END) OVER () AS q3
  FROM (SELECT {c}::DOUBLE AS v, row_number() OVER (ORDER BY {c}) - 1 AS r, count(*) OVER () AS n FROM lineitem)) GROUP BY q1, med, q3, lo, hi""" for c in ("l_quantity", "l_discount", "l_extendedprice")))
def _(lineitem):
    return profile.numeric_summary(lineitem, ["l_quantity", "l_discount", "l_extendedprice"])


@query("categorical_summary", "orders", sql=" UNION ALL ".join(f"SELECT * FROM (SELECT '{c}' AS column_name, {c} AS value, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, {c}) AS rank FROM orders GROUP BY {c} HAVING count(*) >= 5) WHERE rank <= 8" for c in ("o_orderstatus", "o_orderpriority")))
def _(orders):
    return profile.categorical_summary(orders, ["o_orderstatus", "o_orderpriority"])


@query("value_counts", "part", sql=" UNION ALL ".join(f"SELECT '{c}' AS column_name, {c}::VARCHAR AS value, count(*) AS n FROM part GROUP BY {c}" for c in ("p_brand", "p_type", "p_size")))
def _(part):
    return profile.value_counts(part, ["p_brand", "p_type", "p_size"])


@query("list_categories", "documents", sql="SELECT source AS value, count(*) AS n FROM documents WHERE source IS NOT NULL GROUP BY source ORDER BY n DESC, value LIMIT 200")
def _(documents):
    return profile.categories(documents, "source")


@query("list_categories_long", "documents", sql="SELECT * FROM (SELECT CASE WHEN length(v) > 200 THEN substr(v, 1, 199) || '…' ELSE v END AS value, count(*) AS n FROM (SELECT trim(regexp_replace(text, '^\\s+|\\s+$', '', 'g')) AS v FROM documents) WHERE v <> '' GROUP BY 1) ORDER BY n DESC, value LIMIT 200")
def _(documents):
    return profile.categories(documents, "text")


@query("sparkline", "lineitem", sql="""
WITH e AS (SELECT min(l_extendedprice) AS lo, max(l_extendedprice) AS hi FROM lineitem),
b AS (SELECT least(13, floor((l_extendedprice - lo) * 14 / (hi - lo)))::INTEGER AS bin, count(*) AS n FROM lineitem, e GROUP BY 1)
SELECT bin, n / max(n) OVER () AS height FROM b""")
def _(lineitem):
    return profile.sparkline(lineitem, "l_extendedprice")


@query("category_shares", "customer", sql="SELECT c_mktsegment AS value, count(*) AS n, count(*) / sum(count(*)) OVER () AS share FROM customer GROUP BY 1 ORDER BY n DESC, value LIMIT 6")
def _(customer):
    return profile.shares(customer, "c_mktsegment")


@query("eps_bounds", "supplier", sql="SELECT greatest(max(s_acctbal) - min(s_acctbal), max(s_nationkey) - min(s_nationkey)) / 2 AS half_span FROM supplier")
def _(supplier):
    return profile.widest_half_span(supplier, ["s_acctbal", "s_nationkey"])


GAPS = "CASE WHEN l_linenumber % 7 = 0 THEN NULL ELSE l_quantity END"


@query("imputed_cells", "lineitem", sql=f"SELECT 'q' AS column_name, count(*) - count({GAPS}) AS imputed, count(*) AS total FROM lineitem UNION ALL SELECT 'l_tax', 0, count(*) FROM lineitem")
def _(lineitem):
    return profile.imputed_cells(lineitem.withColumn("q", F.expr(GAPS)), ["q", "l_tax"])


@query("diagnosis", "lineitem", sql="""
SELECT 'money' AS column_name, count(*) AS non_null, 0::BIGINT AS numeric_now, count(*) AS numeric_after_fix, 0::BIGINT AS date_like, 'fixable' AS kind, 'currency symbol' AS patterns FROM lineitem
UNION ALL SELECT 'share', count(*), 0, count(*), 0, 'fixable', 'percent sign' FROM lineitem
UNION ALL SELECT 'date', count(*), 0, 0, count(*), 'date-like', '' FROM lineitem
UNION ALL SELECT 'flag', count(*), 0, 0, 0, 'text', '' FROM lineitem
UNION ALL SELECT 'l_tax', count(*), count(*), count(*), 0, 'numeric', '' FROM lineitem""")
def _(lineitem):
    return profile.diagnosis(lineitem.select(F.format_string("$%.2f", "l_extendedprice").alias("money"), F.concat(F.col("l_linenumber").cast("string"), F.lit("%")).alias("share"), F.date_format("l_shipdate", "yyyy-MM-dd").alias("date"), F.col("l_returnflag").alias("flag"), "l_tax"))


# --- cells --------------------------------------------------------------------------------

@query("clean_numbers", "lineitem", sql="SELECT l_orderkey, l_linenumber, l_quantity * 1000 AS grouped, -l_extendedprice AS negative, l_linenumber / 10 AS comma FROM lineitem")
def _(lineitem):
    text = lineitem.select("l_orderkey", "l_linenumber", F.format_number(F.col("l_quantity") * 1000, 0).alias("a"), F.format_string("($%.2f)", "l_extendedprice").alias("b"), F.concat(F.lit("0,"), F.col("l_linenumber").cast("string")).alias("c"))
    return text.select("l_orderkey", "l_linenumber", values.cleaned(F.col("a")).alias("grouped"), values.cleaned(F.col("b")).alias("negative"), values.cleaned(F.col("c")).alias("comma"))


@query("text_numbers", "documents", sql=r"SELECT doc_id, CASE WHEN regexp_full_match(t, '[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?') THEN t::DOUBLE END AS number FROM (SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN ' 12 ' WHEN 1 THEN '1e3' WHEN 2 THEN 'NaN' WHEN 3 THEN n_chars::VARCHAR ELSE source END AS s, trim(s) AS t FROM documents)")
def _(documents):
    text = documents.select("doc_id", F.expr("CASE doc_id % 5 WHEN 0 THEN ' 12 ' WHEN 1 THEN '1e3' WHEN 2 THEN 'NaN' WHEN 3 THEN cast(n_chars AS STRING) ELSE source END").alias("s"))
    return text.select("doc_id", values.number(text, "s").alias("number"))


@query("formula_guard", "documents", sql="SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN '''=' || source WHEN 1 THEN '-5' WHEN 2 THEN '''@' || source ELSE source END AS cell FROM documents")
def _(documents):
    return documents.select("doc_id", values.csv_cell(F.expr("CASE doc_id % 4 WHEN 0 THEN '=' || source WHEN 1 THEN '-5' WHEN 2 THEN '@' || source ELSE source END")).alias("cell"))


@query("recode", "lineitem", sql="SELECT l_orderkey, l_linenumber, CASE WHEN l_quantity IN (1, 50) THEN NULL ELSE l_quantity END AS l_quantity FROM lineitem")
def _(lineitem):
    return rows.recoded(lineitem, {"l_quantity": [1.0, 50.0]}).select("l_orderkey", "l_linenumber", "l_quantity")


@query("recode_effect", "lineitem", sql="""
SELECT 'l_quantity' AS column_name, count(*) FILTER (l_quantity IN (1, 50)) AS replaced, count(*) AS n_before, round(avg(l_quantity), 6) AS mean_before, round(stddev_samp(l_quantity), 6) AS sd_before,
  count(*) FILTER (l_quantity NOT IN (1, 50)) AS n_after, round(avg(l_quantity) FILTER (l_quantity NOT IN (1, 50)), 6) AS mean_after, round(stddev_samp(l_quantity) FILTER (l_quantity NOT IN (1, 50)), 6) AS sd_after FROM lineitem""")
def _(lineitem):
    return rounded(rows.recode_effect(lineitem, {"l_quantity": [1.0, 50.0]}), 6, "mean_before", "sd_before", "mean_after", "sd_after")


@query("z_scores", "part", sql="SELECT p_partkey, round((p_retailprice - avg(p_retailprice) OVER ()) / stddev_pop(p_retailprice) OVER (), 6) AS p_retailprice, round((p_size - avg(p_size) OVER ()) / stddev_pop(p_size) OVER (), 6) AS p_size FROM part")
def _(part):
    return rounded(rows.z_scores(part, ["p_retailprice", "p_size"]).select("p_partkey", "p_retailprice", "p_size"), 6, "p_retailprice", "p_size")


@query("median_impute", "lineitem", sql=f"SELECT l_orderkey, l_linenumber, coalesce(q, median(q) OVER ()) AS q FROM (SELECT l_orderkey, l_linenumber, {GAPS} AS q FROM lineitem)")
def _(lineitem):
    return rows.imputed(lineitem.select("l_orderkey", "l_linenumber", F.expr(GAPS).alias("q")), ["q"])


# --- filters and rows ---------------------------------------------------------------------

CONDITIONS = [{"column": "l_quantity", "op": "gte", "value": 10}, {"column": "l_returnflag", "op": "in", "value": ["A", "R"]}, {"column": "l_linestatus", "op": "neq", "value": "O"}]


@query("filter_rows", "lineitem", sql="SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_quantity >= 10 AND l_returnflag IN ('A', 'R') AND l_linestatus <> 'O'")
def _(lineitem):
    return filters.kept(lineitem, CONDITIONS).select("l_orderkey", "l_linenumber", "l_quantity")


@query("filter_count", "lineitem", sql="SELECT count(*) FILTER (l_quantity >= 10 AND l_returnflag IN ('A', 'R') AND l_linestatus <> 'O') AS shown, count(*) AS total FROM lineitem")
def _(lineitem):
    return filters.counted(lineitem, CONDITIONS)


@query("filter_scatter", "part", sql="SELECT p_partkey, CASE WHEN p_size = 10 THEN p_retailprice END AS v FROM part")
def _(part):
    return filters.scattered(part, [{"column": "p_size", "op": "eq", "value": "10"}], "v", F.col("p_retailprice")).select("p_partkey", "v")


@query("filter_contains", "part", sql="SELECT p_partkey, p_name FROM part WHERE contains(lower(p_name), 're')")
def _(part):
    return filters.kept(part, [{"column": "p_name", "op": "contains", "value": "RE"}]).select("p_partkey", "p_name")


@query("filter_compare", "orders", sql="SELECT o_orderkey FROM orders WHERE o_totalprice < 100000 AND o_totalprice > 1000 AND o_orderkey <= 1000000")
def _(orders):
    return filters.kept(orders, [{"column": "o_totalprice", "op": "lt", "value": 100000}, {"column": "o_totalprice", "op": "gt", "value": 1000}, {"column": "o_orderkey", "op": "lte", "value": 1000000}]).select("o_orderkey")


@query("search_any_column", "customer", sql="SELECT c_custkey FROM customer WHERE contains(lower(c_name), '77') OR contains(lower(c_mktsegment), '77') OR contains(c_custkey::VARCHAR, '77') OR contains(c_nationkey::VARCHAR, '77')")
def _(customer):
    return filters.anywhere(customer.drop("c_acctbal"), "77").select("c_custkey")


@query("rows_where", "orders", sql="SELECT * FROM (SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus = 'F' ORDER BY o_orderkey LIMIT 50)")
def _(orders):
    return filters.where(orders, "o_orderstatus", "eq", "F", ["o_orderkey"]).select("o_orderkey", "o_totalprice")


@query("complete_cases", "lineitem", sql=f"SELECT count(*) AS n FROM lineitem WHERE {GAPS} IS NOT NULL AND l_tax IS NOT NULL")
def _(lineitem):
    return filters.complete(lineitem.withColumn("q", F.expr(GAPS)), ["q", "l_tax"]).agg(F.count(F.lit(1)).alias("n"))


@query("visible_categories", "orders", sql="SELECT o_orderkey FROM orders WHERE o_orderstatus NOT IN ('O', 'P')")
def _(orders):
    return filters.visible(orders, "o_orderstatus", ["O", "P"]).select("o_orderkey")


@query("top_rows", "customer", sql="SELECT * FROM (SELECT c_custkey, c_name, c_acctbal FROM customer ORDER BY c_acctbal DESC NULLS LAST, c_custkey LIMIT 50)")
def _(customer):
    return rows.top(customer, "c_acctbal", 50, ["c_custkey"], columns=["c_custkey", "c_name", "c_acctbal"])


@query("sample_rows", "customer")
def _(customer):
    return rows.sample(customer, 50, ["c_custkey"])


@query("plot_bounds", "lineitem", sql="SELECT l_returnflag AS colour, l_linestatus AS shape, count(*) AS n, min(l_quantity) AS axis0_min, max(l_quantity) AS axis0_max, min(l_extendedprice) AS axis1_min, max(l_extendedprice) AS axis1_max FROM lineitem GROUP BY 1, 2")
def _(lineitem):
    return rows.bounds(rows.points(lineitem, ["l_quantity", "l_extendedprice"], "l_returnflag", "l_linestatus"))


@query("plot_thinned", "lineitem", sql="SELECT l_returnflag AS colour, '' AS shape, l_quantity AS axis0, l_extendedprice AS axis1 FROM lineitem WHERE l_orderkey % 4 = 0 AND l_quantity IS NOT NULL AND l_extendedprice IS NOT NULL")
def _(lineitem):
    return rows.points(lineitem, ["l_quantity", "l_extendedprice"], "l_returnflag", thin=4, order="l_orderkey")


@query("row_page", "orders", sql="SELECT * FROM (SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC NULLS LAST, o_orderkey LIMIT 100 OFFSET 200)")
def _(orders):
    return rows.page(orders, [F.desc_nulls_last("o_totalprice"), "o_orderkey"], 2).select("o_orderkey", "o_totalprice")


#: A label in natural order: text before digits, digits by value, the label.
NATURAL = "lower({0}) = 'noise', lower(regexp_extract({0}, '^([^0-9]*)', 1)), TRY_CAST(nullif(regexp_extract({0}, '^[^0-9]*([0-9]{{1,18}})', 1), '') AS BIGINT) NULLS FIRST, {0}"


@query("palette", "customer", sql="WITH c AS (SELECT 'Segment ' || c_nationkey AS value, count(*) AS n FROM customer GROUP BY 1) SELECT value, n, row_number() OVER (ORDER BY " + NATURAL.format("value") + ") - 1 AS index FROM c")
def _(customer):
    return groups.palette(customer.select(F.concat(F.lit("Segment "), "c_nationkey").alias("s")), "s")


@query("cluster_sizes", "orders", sql="SELECT CASE WHEN o_totalprice < 1000 THEN 'Noise' ELSE 'Cluster ' || (o_custkey % 7) END AS value, count(*) AS n FROM orders WHERE o_custkey % 11 > 0 GROUP BY 1")
def _(orders):
    return groups.sizes(orders.select(F.expr("CASE WHEN o_custkey % 11 > 0 THEN CASE WHEN o_totalprice < 1000 THEN 'Noise' ELSE concat('Cluster ', o_custkey % 7) END END").alias("Cluster")))


@query("analysis_profile", "labels", sql="""
WITH q AS (SELECT 'quality' AS column_name, quality::VARCHAR AS v FROM labels UNION ALL SELECT 'toxic', toxic::VARCHAR FROM labels), c AS (SELECT column_name, v, count(*) AS n FROM q WHERE v IS NOT NULL GROUP BY 1, 2), t AS (SELECT typeof(quality) AS quality, typeof(toxic) AS toxic FROM labels LIMIT 1)
SELECT column_name, count(*) AS n_groups, count(*) FILTER (n < 5) AS n_withheld, sum(n)::BIGINT AS n FROM c GROUP BY 1""")
def _(labels):
    found = profile.analysis_profile(labels.select("quality", "toxic"))
    told = [(c, len(p["groups"]), sum(g["withheld"] for g in p["groups"]), sum(g["n"] for g in p["groups"])) for c, p in found.items()]
    return labels.sparkSession.createDataFrame(told, "column_name string, n_groups long, n_withheld long, n long")


@query("column_roles", "events", sql="""
SELECT 'event_type' AS column_name, false AS is_numeric, false AS is_temporal, false AS is_identifier UNION ALL SELECT 'ts', false, count(ts) >= 0.8 * count(*), false FROM events UNION ALL SELECT 'value', count(value) > 0, false, false FROM events UNION ALL SELECT 'user_id', count(user_id) > 0, false, true FROM events""")
def _(events):
    found = profile.analysis_profile(events.select("event_type", "ts", "value", "user_id"))
    return events.sparkSession.createDataFrame([(c, p["numeric"], p["temporal"], p["identifier"]) for c, p in found.items()], "column_name string, is_numeric boolean, is_temporal boolean, is_identifier boolean")


@query("default_view", "customer", sql="""
WITH s AS (SELECT 's' || c_mktsegment AS seg, c_nationkey + 0.0 AS nation, c_acctbal FROM customer), n AS (SELECT count(DISTINCT seg) AS a, count(DISTINCT nation) AS b, count(DISTINCT c_acctbal) AS c FROM s)
SELECT 'nation, c_acctbal' AS axes, CASE WHEN a BETWEEN 2 AND 20 AND (b > 20 OR b < 2 OR a <= b) AND (c > 20 OR c < 2 OR a <= c) THEN 'seg' WHEN b BETWEEN 2 AND 20 AND (c > 20 OR c < 2 OR b <= c) THEN 'nation' WHEN c BETWEEN 2 AND 20 THEN 'c_acctbal' ELSE 'seg' END AS colour, (SELECT greatest(max(nation) - min(nation), max(c_acctbal) - min(c_acctbal)) > 3 * least(max(nation) - min(nation), max(c_acctbal) - min(c_acctbal)) FROM s) AS standardise FROM n""")
def _(customer):
    table = customer.select(F.concat(F.lit("s"), "c_mktsegment").alias("seg"), (F.col("c_nationkey") + 0.0).alias("nation"), "c_acctbal")
    axes = profile.default_axes(table)
    return customer.sparkSession.createDataFrame([(", ".join(axes), profile.default_colour(table), profile.suggest_standardise(table, axes))], "axes string, colour string, standardise boolean")


@query("clean_columns", "orders", sql="SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN -round(o_totalprice, 0) WHEN o_orderkey % 3 = 1 THEN round(o_totalprice, 0) ELSE o_orderkey % 100 END AS price FROM orders")
def _(orders):
    price = "CASE WHEN o_orderkey % 3 = 0 THEN concat('($', format_number(round(o_totalprice, 0), 0), ')') WHEN o_orderkey % 3 = 1 THEN concat(' ', format_number(round(o_totalprice, 0), 0)) ELSE concat(o_orderkey % 100, ' %') END"
    return profile.with_numbers_cleaned(orders.select("o_orderkey", F.expr(price).alias("price")), ["price"])


@query("diagnosis_sentence", "orders", sql="SELECT '2 numeric column(s). Numbers written as formatted text, which can be cleaned: price.' AS sentence FROM orders HAVING count(*) > 0")
def _(orders):
    table = orders.select("o_orderkey", "o_custkey", F.concat(F.lit("$"), F.format_number("o_totalprice", 2)).alias("price"))
    return orders.sparkSession.createDataFrame([(profile.diagnosis_text(profile.diagnosis(table).collect()),)], "sentence string")


@query("csv_round_trip", "customer", sql="SELECT c_custkey::DOUBLE AS c_custkey, c_name, c_acctbal, CASE WHEN c_custkey % 2 = 0 THEN chr(39) || '=a, ' || chr(34) || c_custkey || chr(34) ELSE 'b;' || c_custkey END AS note FROM customer")
def _(customer):
    table = customer.select("c_custkey", "c_name", "c_acctbal", F.expr("""CASE WHEN c_custkey % 2 = 0 THEN concat('=a, "', c_custkey, '"') ELSE concat('b;', c_custkey) END""").alias("note"))
    path = f"{shared_folder(customer.sparkSession)}/customers-{uuid.uuid4().hex}"
    sinks.write_csv(table, path)
    return tables.read_csv(customer.sparkSession, path)[0]


@query("csv_line_faults", "orders", sql="SELECT count(*) FILTER (o_orderkey % 5 = 1) AS few, count(*) FILTER (o_orderkey % 5 = 2) AS many, count(*) AS n_lines FROM orders")
def _(orders):
    spark = orders.sparkSession
    path = f"{shared_folder(spark)}/lines-{uuid.uuid4().hex}"
    orders.select(F.concat("o_orderkey", F.lit(","), F.expr("CASE o_orderkey % 5 WHEN 1 THEN '' WHEN 2 THEN '7,8' ELSE '\"7,8\"' END"), F.expr("CASE o_orderkey % 5 WHEN 1 THEN '' ELSE ',9' END"))).write.text(path)
    return tables.line_faults(spark, path, ",", 3).agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("few", "many", "n_lines")])


# --- transfers ----------------------------------------------------------------------------

@query("transfer_by_key", "labels", "documents", sql="SELECT d.doc_id, l.quality FROM documents d LEFT JOIN (SELECT doc_id, max_by(quality, doc_id) AS quality FROM labels GROUP BY doc_id) l USING (doc_id)")
def _(labels, documents):
    source = labels.withColumn("_row", F.col("doc_id"))
    return transfer.by_key(documents, source, "quality", "doc_id", "quality").select("doc_id", "quality")


@query("transfer_last_wins", "orders", "customer", sql="SELECT c.c_custkey, o.o_totalprice FROM customer c LEFT JOIN (SELECT o_custkey, arg_max(o_totalprice, o_orderkey) AS o_totalprice FROM orders GROUP BY o_custkey) o ON o.o_custkey = c.c_custkey")
def _(orders, customer):
    source = orders.select(F.col("o_custkey").alias("c_custkey"), "o_totalprice", F.col("o_orderkey").alias("_row"))
    return transfer.by_key(customer, source, "o_totalprice", "c_custkey", "o_totalprice").select("c_custkey", "o_totalprice")


@query("transfer_fill_counts", "labels", "documents", sql="SELECT count(l.quality) AS filled, count(l.doc_id) AS found FROM documents d LEFT JOIN (SELECT doc_id, max(quality) AS quality FROM labels GROUP BY doc_id) l USING (doc_id)")
def _(labels, documents):
    return transfer.fill_counts(documents, labels.withColumn("_row", F.col("doc_id")), "quality", "doc_id")


@query("transfer_by_order", "customer", "supplier", sql="""
SELECT c.c_custkey, s.s_acctbal AS v FROM (SELECT c_custkey, row_number() OVER (ORDER BY c_custkey) AS r FROM customer) c LEFT JOIN (SELECT s_acctbal, row_number() OVER (ORDER BY s_suppkey) AS r FROM supplier) s USING (r)""")
def _(customer, supplier):
    return transfer.by_order(transfer.with_rows(customer, ["c_custkey"]), transfer.with_rows(supplier, ["s_suppkey"]), "s_acctbal", "v").select("c_custkey", "v")


@query("transfer_probe", "customer", sql="SELECT count(*) FILTER (c_custkey % 10 > 0 OR c_custkey IS NULL) AS agree, count(*) AS total FROM customer")
def _(customer):
    numbered = transfer.with_rows(customer, ["c_custkey"]).select("_row", F.col("c_custkey").alias("customer_id"), "c_nationkey")
    other = numbered.withColumn("customer_id", F.expr("if(customer_id % 10 > 0 OR customer_id IS NULL, customer_id, -customer_id - 1)"))
    found = transfer.probe(numbered, other)
    return customer.sparkSession.createDataFrame([(found["agree"], found["total"])], "agree long, total long")


# --- tests --------------------------------------------------------------------------------

def one_row(table: DataFrame, result: dict, **columns: str) -> DataFrame:
    """Numbers of a test's result as a row."""
    return table.sparkSession.createDataFrame([tuple(None if result[k] is None else round(float(result[k]), 6) for k in columns.values())], ", ".join(f"{c} double" for c in columns))


TWO = "WITH a AS (SELECT count(*) AS n, avg(l_extendedprice) AS m, var_samp(l_extendedprice) AS s FROM lineitem WHERE l_returnflag = 'A'), b AS (SELECT count(*) AS n, avg(l_extendedprice) AS m, var_samp(l_extendedprice) AS s FROM lineitem WHERE l_returnflag = 'R')"


@query("test_welch_t", "lineitem", sql=TWO + " SELECT round((a.m - b.m) / sqrt(a.s / a.n + b.s / b.n), 6) AS statistic, round((a.s / a.n + b.s / b.n) ** 2 / ((a.s / a.n) ** 2 / (a.n - 1) + (b.s / b.n) ** 2 / (b.n - 1)), 6) AS df, round((a.m - b.m) / sqrt(((a.n - 1) * a.s + (b.n - 1) * b.s) / (a.n + b.n - 2)), 6) AS effect FROM a, b")
def _(lineitem):
    return one_row(lineitem, hypothesis.welch_t(lineitem, "l_extendedprice", "l_returnflag", ["A", "R"]), statistic="statistic", df="df", effect="effect")


#: Simpson's rule over 4,000 steps from 0 to hi: weights and places for an integrand of x.
SIMPSON = ", s AS (SELECT i, hi / 4000 AS h, hi * i / 4000 AS x, CASE WHEN i IN (0, 4000) THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END AS w FROM r, range(0, 4001) t(i))"


@query("test_welch_t_p", "lineitem", sql=TWO + ", r AS (SELECT abs(a.m - b.m) / sqrt(a.s / a.n + b.s / b.n) AS hi, a.m - b.m AS diff, sqrt(a.s / a.n + b.s / b.n) AS se, (a.s / a.n + b.s / b.n) ** 2 / ((a.s / a.n) ** 2 / (a.n - 1) + (b.s / b.n) ** 2 / (b.n - 1)) AS df FROM a, b), c AS (SELECT *, 1.959963984540054 AS z FROM r), d AS (SELECT *, z + (z ** 3 + z) / (4 * df) + (5 * z ** 5 + 16 * z ** 3 + 3 * z) / (96 * df ** 2) AS crit FROM c)" + SIMPSON + " SELECT round(1 - 2 * exp(lgamma((max(df) + 1) / 2) - lgamma(max(df) / 2)) / sqrt(max(df) * pi()) * sum(w * h / 3 * (1 + x * x / df) ** (-(df + 1) / 2)), 6) AS p, round(max(diff - crit * se), 4) AS ci_low, round(max(diff + crit * se), 4) AS ci_high FROM s, d")
def _(lineitem):
    r = hypothesis.welch_t(lineitem, "l_extendedprice", "l_returnflag", ["A", "R"])
    low, high = (round(x, 4) for x in r["ci"])
    return one_row(lineitem, {"p": r["p"], "low": low, "high": high}, p="p", ci_low="low", ci_high="high")


RANKED = "WITH x AS (SELECT c_mktsegment AS grp, c_acctbal AS v FROM customer{where}), r AS (SELECT grp, v, rank() OVER (ORDER BY v) + (count(*) OVER (PARTITION BY v) - 1) / 2 AS r FROM x), t AS (SELECT sum(k ** 3 - k) AS tie, sum(k) AS n FROM (SELECT count(*) AS k FROM x GROUP BY v)), g AS (SELECT grp, count(*) AS n, sum(r) AS s FROM r GROUP BY grp)"


@query("test_mann_whitney", "customer", sql=RANKED.format(where=" WHERE c_mktsegment IN ('BUILDING', 'MACHINERY')") + " SELECT round(a.s - a.n * (a.n + 1) / 2, 6) AS statistic, round(1 - 2 * (a.s - a.n * (a.n + 1) / 2) / (a.n * b.n), 6) AS effect FROM g a, g b WHERE a.grp = 'BUILDING' AND b.grp = 'MACHINERY'")
def _(customer):
    return one_row(customer, hypothesis.mann_whitney(customer, "c_acctbal", "c_mktsegment", ["BUILDING", "MACHINERY"]), statistic="statistic", effect="effect")


@query("test_mann_whitney_p", "customer", sql=RANKED.format(where=" WHERE c_mktsegment IN ('BUILDING', 'MACHINERY')") + ", r2 AS (SELECT a.s - a.n * (a.n + 1) / 2 - a.n * b.n / 2 AS u, a.n * b.n / 12 * (a.n + b.n + 1 - t.tie / ((a.n + b.n) * (a.n + b.n - 1))) AS var FROM g a, g b, t WHERE a.grp = 'BUILDING' AND b.grp = 'MACHINERY')" + SIMPSON.replace("FROM r,", "FROM (SELECT abs(u) / sqrt(var) AS hi FROM r2),") + " SELECT round(1 - 2 / sqrt(2 * pi()) * sum(w * h / 3 * exp(-x * x / 2)), 5) AS p FROM s")
def _(customer):
    return rounded(one_row(customer, hypothesis.mann_whitney(customer, "c_acctbal", "c_mktsegment", ["BUILDING", "MACHINERY"]), p="p"), 5, "p")


#: The chance that chi square of df is over x, by x = u * u.
CHI_TAIL = SIMPSON + " SELECT round(1 - 2 / (2 ** (max(df) / 2) * gamma(max(df) / 2)) * sum(w * h / 3 * CASE WHEN df = 1 THEN 1 ELSE x ** (df - 1) END * exp(-x * x / 2)), 6) AS p, max(df)::DOUBLE AS df FROM s, r"


@query("test_kruskal_wallis", "customer", sql=RANKED.format(where="") + ", h AS (SELECT (12 / (t.n * (t.n + 1)) * (SELECT sum(s * s / n) FROM g) - 3 * (t.n + 1)) / (1 - t.tie / (t.n ** 3 - t.n)) AS h, t.n FROM t) SELECT round(h, 6) AS statistic, round(h / (n - 1), 6) AS effect FROM h")
def _(customer):
    segments = [r["value"] for r in profile.value_counts(customer, ["c_mktsegment"]).collect()]
    return one_row(customer, hypothesis.kruskal_wallis(customer, "c_acctbal", "c_mktsegment", segments), statistic="statistic", effect="effect")


@query("test_kruskal_wallis_p", "customer", sql=RANKED.format(where="").replace(", r AS (SELECT grp", ", q AS (SELECT grp").replace("FROM r GROUP BY grp", "FROM q GROUP BY grp") + ", r AS (SELECT sqrt((12 / (t.n * (t.n + 1)) * (SELECT sum(s * s / n) FROM g) - 3 * (t.n + 1)) / (1 - t.tie / (t.n ** 3 - t.n))) AS hi, (SELECT count(*) - 1 FROM g) AS df FROM t)" + CHI_TAIL)
def _(customer):
    segments = [r["value"] for r in profile.value_counts(customer, ["c_mktsegment"]).collect()]
    return one_row(customer, hypothesis.kruskal_wallis(customer, "c_acctbal", "c_mktsegment", segments), p="p", df="df")


@query("test_ks_p", "events", sql="""
WITH x AS (SELECT event_type AS grp, value AS v FROM events WHERE event_type IN ('click', 'view')), n AS (SELECT count(*) FILTER (grp = 'click') AS a, count(*) FILTER (grp = 'view') AS b FROM x),
c AS (SELECT v, sum(count(*) FILTER (grp = 'click')) OVER (ORDER BY v) AS a, sum(count(*) FILTER (grp = 'view')) OVER (ORDER BY v) AS b FROM x GROUP BY v),
d AS (SELECT max(abs(c.a / n.a - c.b / n.b)) AS d, sqrt(max(n.a) * max(n.b) / (max(n.a) + max(n.b))) AS en FROM c, n), l AS (SELECT (en + 0.12 + 0.11 / en) * d AS l FROM d)
SELECT round(least(1, greatest(0, 2 * sum(CASE WHEN j % 2 = 1 THEN 1 ELSE -1 END * exp(-2 * j * j * l * l)))), 6) AS p FROM l, range(1, 101) t(j)""")
def _(events):
    return one_row(events, hypothesis.ks(events, "value", "event_type", ["click", "view"]), p="p")


@query("test_ks", "events", sql="""
WITH x AS (SELECT event_type AS grp, value AS v FROM events WHERE event_type IN ('click', 'view')), n AS (SELECT count(*) FILTER (grp = 'click') AS a, count(*) FILTER (grp = 'view') AS b FROM x),
c AS (SELECT v, sum(count(*) FILTER (grp = 'click')) OVER (ORDER BY v) AS a, sum(count(*) FILTER (grp = 'view')) OVER (ORDER BY v) AS b FROM x GROUP BY v)
SELECT round(max(abs(c.a / n.a - c.b / n.b)), 9) AS d, max(n.a)::BIGINT AS n1, max(n.b)::BIGINT AS n2 FROM c, n""")
def _(events):
    return rounded(hypothesis.ks_distance(events, "value", "event_type", ["click", "view"]).drop("location"), 9, "d")


@query("test_chi_square", "labels", sql="""
WITH c AS (SELECT quality AS a, toxic AS b, count(*) AS n FROM labels GROUP BY 1, 2), r AS (SELECT a, sum(n) AS n FROM c GROUP BY a), k AS (SELECT b, sum(n) AS n FROM c GROUP BY b), t AS (SELECT sum(n) AS n FROM c),
e AS (SELECT r.n * k.n / t.n AS e, coalesce(c.n, 0) AS o, t.n AS n FROM r CROSS JOIN k CROSS JOIN t LEFT JOIN c ON c.a = r.a AND c.b = k.b)
SELECT round(sum((o - e) ** 2 / e), 6) AS statistic, round(sqrt(sum((o - e) ** 2 / e) / max(n)), 6) AS effect FROM e""")
def _(labels):
    return one_row(labels, hypothesis.chi_square(labels, "quality", "toxic"), statistic="statistic", effect="effect")


@query("test_chi_square_p", "labels", sql="""
WITH c AS (SELECT quality AS a, toxic AS b, count(*) AS n FROM labels GROUP BY 1, 2), m AS (SELECT a, sum(n) AS n FROM c GROUP BY a), k AS (SELECT b, sum(n) AS n FROM c GROUP BY b), t AS (SELECT sum(n) AS n FROM c),
e AS (SELECT m.n * k.n / t.n AS e, coalesce(c.n, 0) AS o FROM m CROSS JOIN k CROSS JOIN t LEFT JOIN c ON c.a = m.a AND c.b = k.b),
r AS (SELECT sqrt(sum((o - e) ** 2 / e)) AS hi, (SELECT count(*) - 1 FROM m) * (SELECT count(*) - 1 FROM k) AS df FROM e)""" + CHI_TAIL)
def _(labels):
    return one_row(labels, hypothesis.chi_square(labels, "quality", "toxic"), p="p", df="df")


# --- charts -------------------------------------------------------------------------------

def lines(lineitem: DataFrame) -> DataFrame:
    return charts.series(lineitem, "l_extendedprice", "l_returnflag", ["A", "N", "R"])


@query("chart_ecdf", "events", sql="SELECT grp, v, max(s) AS share FROM (SELECT event_type AS grp, value AS v, round(cume_dist() OVER (PARTITION BY event_type ORDER BY value), 9) AS s FROM events) GROUP BY grp, v")
def _(events):
    return rounded(charts.ecdf(charts.series(events, "value", "event_type")), 9, "share")


@query("chart_histogram", "lineitem", sql="""
WITH e AS (SELECT min(l_quantity) AS lo, max(l_quantity) AS hi FROM lineitem), b AS (SELECT l_returnflag AS grp, least(19, floor((l_quantity - lo) / ((hi - lo) / 20)))::INTEGER AS bin, count(*) AS n FROM lineitem, e GROUP BY 1, 2)
SELECT grp, bin, round(lo + bin * ((hi - lo) / 20), 9) AS lo, round(lo + (bin + 1) * ((hi - lo) / 20), 9) AS hi, n FROM b, e""")
def _(lineitem):
    return rounded(charts.histogram(charts.series(lineitem, "l_quantity", "l_returnflag"), 20), 9, "lo", "hi")


@query("chart_five_numbers", "lineitem", sql="SELECT l_returnflag AS grp, count(*) AS n, " + ", ".join(f"floor(quantile_cont(l_extendedprice, {p}) * 1000 + 0.5) / 1000 AS {c}" for c, p in (("lo", 0), ("q1", 0.25), ("med", 0.5), ("q3", 0.75), ("hi", 1))) + " FROM lineitem GROUP BY 1")
def _(lineitem):
    return charts.five_numbers(lines(lineitem))


QUARTILES = "WITH q AS (SELECT event_type AS grp, quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.5) AS med, quantile_cont(value, 0.75) AS q3 FROM events GROUP BY 1), s AS (SELECT q.*, e.value AS v, e.value BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1) AS inside FROM events e JOIN q ON q.grp = e.event_type)"


@query("chart_box", "events", sql=QUARTILES + " SELECT grp, round(q1, 6) AS q1, round(med, 6) AS med, round(q3, 6) AS q3, min(v) FILTER (inside) AS whisker_lo, max(v) FILTER (inside) AS whisker_hi, count(*) FILTER (NOT inside) AS n_outliers FROM s GROUP BY grp, s.q1, s.med, s.q3")
def _(events):
    return rounded(charts.box(charts.series(events, "value", "event_type")), 6, "q1", "med", "q3")


@query("chart_outliers", "events", sql=QUARTILES + " SELECT grp, v FROM s WHERE NOT inside")
def _(events):
    return charts.outliers(charts.series(events, "value", "event_type"))


@query("chart_violin", "lineitem", sql="""
WITH g AS (SELECT l_returnflag AS grp, count(*) AS n, stddev_samp(l_quantity) AS sd, quantile_cont(l_quantity, 0.75) - quantile_cont(l_quantity, 0.25) AS iqr, min(l_quantity) AS lo, max(l_quantity) AS hi FROM lineitem GROUP BY 1),
h AS (SELECT grp, n, lo, hi, 0.9 * least(sd, iqr / 1.34) * n ** -0.2 AS h FROM g), x AS (SELECT grp, n, h, i, lo - 2 * h + (hi - lo + 4 * h) * i / 59 AS x FROM h, range(0, 60) t(i)),
c AS (SELECT l_returnflag AS grp, l_quantity AS v, count(*) AS k FROM lineitem GROUP BY 1, 2)
SELECT x.grp, i::INTEGER AS i, round(x, 6) AS x, round(sum(k * exp(-0.5 * ((x - v) / h) ** 2)) / (n * h * sqrt(2 * pi())), 9) AS density FROM x JOIN c ON c.grp = x.grp GROUP BY x.grp, i, x, n, h""")
def _(lineitem):
    return rounded(rounded(charts.violin(charts.series(lineitem, "l_quantity", "l_returnflag")), 6, "x"), 9, "density")


@query("chart_qq", "part")
def _(part):
    return charts.qq(charts.series(part, "p_retailprice", "p_type"))


@query("chart_qq_line", "lineitem", sql="""
SELECT l_returnflag AS grp, round((quantile_cont(l_extendedprice, 0.75) - quantile_cont(l_extendedprice, 0.25)) / (2 * 0.6744897501960817), 3) AS slope, round(quantile_cont(l_extendedprice, 0.25) + (quantile_cont(l_extendedprice, 0.75) - quantile_cont(l_extendedprice, 0.25)) / 2, 3) AS intercept, round(quantile_cont(l_extendedprice, 0.5), 3) AS middle FROM lineitem GROUP BY 1""")
def _(lineitem):
    return rounded(charts.qq_line(lines(lineitem)).select("grp", "slope", "intercept", F.col("deciles")[4].alias("middle")), 3, "slope", "intercept", "middle")


@query("chart_bar", "customer", sql="SELECT CASE WHEN n < 5 THEN '(rare values)' ELSE value END AS value, sum(n)::BIGINT AS n FROM (SELECT (c_nationkey)::VARCHAR AS value, count(*) AS n FROM customer GROUP BY 1) GROUP BY 1")
def _(customer):
    return charts.bar(customer, "c_nationkey")


@query("chart_line", "events", sql="SELECT event_type AS grp, strftime(ts, '%Y-%m-%d') AS day, round(avg(value), 6) AS value FROM events GROUP BY 1, 2")
def _(events):
    return rounded(charts.line(events, "ts", "value", "mean", "event_type"), 6, "value").withColumn("day", F.col("day").cast("string"))


@query("chart_line_orders", "orders", sql="SELECT 'o_totalprice' AS grp, strftime(o_orderdate, '%Y-%m-%d') AS day, round(median(o_totalprice), 4) AS value FROM orders GROUP BY 2")
def _(orders):
    return rounded(charts.line(orders, "o_orderdate", "o_totalprice", "median"), 4, "value").withColumn("day", F.col("day").cast("string"))


@query("chart_withheld", "orders", sql="""
WITH s AS (SELECT least(o_orderkey % 7919, 40)::VARCHAR AS grp, o_totalprice AS v FROM orders), c AS (SELECT grp, count(*) AS n FROM s GROUP BY grp)
SELECT count(DISTINCT grp) FILTER (n < 5) AS withheld_groups, count(v) FILTER (n < 5) AS withheld_rows FROM s JOIN c USING (grp)""")
def _(orders):
    table = orders.select(F.expr("concat('', least(o_orderkey % 7919, 40))").alias("g"), "o_totalprice")
    known = profile.analysis_profile(table)
    rare = sum(x["withheld"] for x in known["g"]["groups"])
    return charts.withheld(table, "o_totalprice", "g", charts.visible_groups("g", known)).select(F.lit(rare).cast("long").alias("withheld_groups"), "withheld_rows")


# --- missing-value codes ------------------------------------------------------------------

def coded(lineitem: DataFrame) -> DataFrame:
    return lineitem.select(F.expr("CASE WHEN l_orderkey % 9 = 0 THEN -99 ELSE l_quantity END").alias("q"), F.expr("CASE WHEN l_orderkey % 9 = 0 AND l_linenumber < 5 THEN -99 ELSE l_linenumber END").alias("l"), F.expr("CASE WHEN l_orderkey % 50 = 1 THEN 999 ELSE l_discount END").alias("d"))


CODED = "WITH t AS (SELECT CASE WHEN l_orderkey % 9 = 0 THEN -99 ELSE l_quantity END AS q, CASE WHEN l_orderkey % 9 = 0 AND l_linenumber < 5 THEN -99 ELSE l_linenumber END::DOUBLE AS l, CASE WHEN l_orderkey % 50 = 1 THEN 999 ELSE l_discount END AS d FROM lineitem)"


#: Candidate codes (g) with what sets them apart, and which of them stand (FOUND).
GAPPED = CODED + """
, u AS (SELECT 'q' AS column_name, q AS value, count(*) AS n FROM t GROUP BY 2 UNION ALL SELECT 'l', l, count(*) FROM t GROUP BY 2 UNION ALL SELECT 'd', d, count(*) FROM t GROUP BY 2),
m AS (SELECT *, value IN (""" + ", ".join(map(str, codes.CANDIDATES)) + """) AS cand FROM u),
a AS (SELECT column_name, sum(n) AS numbers, min(value) FILTER (NOT cand) AS lo, max(value) FILTER (NOT cand) AS hi, bool_and(value = floor(value)) FILTER (NOT cand) AS whole, count(*) FILTER (NOT cand) AS levels FROM m GROUP BY 1),
g AS (SELECT m.column_name, value, n, numbers, value < 0 AND lo >= 0 AS sign, CASE WHEN value < lo THEN lo - value WHEN value > hi THEN value - hi ELSE 0 END AS gap, hi - lo AS spread, whole, levels FROM m JOIN a USING (column_name) WHERE cand)"""
FOUND = """CASE WHEN sign OR gap / spread >= 3 THEN 'certain' WHEN n / numbers >= 0.05 THEN 'likely' ELSE 'possible' END AS confidence
FROM g WHERE sign OR gap > spread * 0.5 OR (whole AND levels <= 20 AND gap >= 2)"""


@query("code_scan", "lineitem", sql=GAPPED + " SELECT column_name, value, n, numbers::BIGINT AS numbers, " + FOUND)
def _(lineitem):
    return codes.found(coded(lineitem), ["q", "l", "d"]).drop("reasons")


@query("code_cooccurrence", "lineitem", sql=CODED + """
, r AS (SELECT count(*) FILTER (q = -99) AS nq, count(*) FILTER (l = -99) AS nl, count(*) FILTER (q = -99 AND l = -99) AS m, count(*) AS n FROM t)
SELECT 'q' AS column_name, -99.0::DOUBLE AS value, 1::BIGINT AS peers, m AS observed, round(nq * nl / n, 6) AS expected, round(m / (nq * nl / n), 6) AS lift FROM r
UNION ALL SELECT 'l', -99.0, 1, m, round(nq * nl / n, 6), round(m / (nq * nl / n), 6) FROM r""")
def _(lineitem):
    return rounded(codes.together(coded(lineitem), ["q", "l", "d"], [-99.0]).drop("supports").withColumn("peers", F.col("peers").cast("long")), 6, "expected", "lift")


@query("code_report", "lineitem", sql=GAPPED + ", found AS (SELECT column_name, value, n, " + FOUND + f"""),
held AS (SELECT r, column_name, value, count(*) OVER (PARTITION BY r, value) AS k FROM (SELECT r, unnest(['q', 'l', 'd']) AS column_name, unnest([q, l, d]) AS value FROM (SELECT *, row_number() OVER () AS r FROM t)) WHERE value = 5 OR value IN (SELECT value FROM found)),
hit AS (SELECT column_name, value, count(*) AS n, sum(k - 1) AS observed FROM held GROUP BY 1, 2),
shared AS (SELECT *, sum(n) OVER (PARTITION BY value) AS total, count(*) OVER (PARTITION BY value) AS holders, (SELECT count(*) FROM t) AS n_rows FROM hit),
together AS (SELECT column_name, value, observed, coalesce(observed / nullif(n * (total - n) / n_rows, 0), 0) AS lift FROM shared WHERE holders > 1 AND n_rows >= {codes.LEAST_ROWS}),
named AS (SELECT column_name, value, n AS n5 FROM u WHERE value = 5),
told AS (SELECT column_name, value, coalesce(n, n5) AS n, confidence AS c, lift, coalesce(observed >= {codes.PAIRS} AND lift >= {codes.LIFT}, false) AS supports FROM found FULL JOIN named USING (column_name, value) LEFT JOIN together USING (column_name, value))
SELECT column_name, value, n, CASE WHEN supports AND c = 'possible' THEN 'likely' WHEN supports AND c IS NOT NULL THEN 'certain' ELSE c END AS confidence, value = 5 AS declared, round(lift, 6) AS lift, supports, coalesce(c IN ('certain', 'likely'), false) OR supports AS suggested FROM told""")
def _(lineitem):
    return rounded(codes.scanned(coded(lineitem), ["q", "l", "d"], [5.0]).drop("reasons"), 6, "lift")


# --- components and clusters --------------------------------------------------------------

MEASURES = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


@query("pca_explained", "lineitem")
def _(lineitem):
    found = components.explained(components.fit(lineitem, MEASURES))
    return lineitem.sparkSession.createDataFrame([(r["component"], r["eigenvalue"], r["share"], r["cumulative"]) for r in found], "component int, eigenvalue double, share double, cumulative double")


@query("pca_two_variables", "lineitem", sql="SELECT 1 AS component, round(1 + abs(corr(l_quantity, l_extendedprice)), 9) AS eigenvalue FROM lineitem UNION ALL SELECT 2, round(1 - abs(corr(l_quantity, l_extendedprice)), 9) FROM lineitem")
def _(lineitem):
    found = components.explained(components.fit(lineitem, ["l_quantity", "l_extendedprice"]))
    return lineitem.sparkSession.createDataFrame([(r["component"], round(r["eigenvalue"], 9)) for r in found], "component int, eigenvalue double")


@query("pca_three_variables", "lineitem", sql="""
WITH r AS (SELECT corr(l_quantity, l_extendedprice) AS a, corr(l_quantity, l_discount) AS b, corr(l_extendedprice, l_discount) AS c FROM lineitem), p AS (SELECT sqrt((a * a + b * b + c * c) / 3) AS p, a * b * c AS d FROM r), e AS (SELECT 1 + 2 * p * cos(acos(d / p ** 3) / 3) AS e1, 1 + 2 * p * cos(acos(d / p ** 3) / 3 + 2 * pi() / 3) AS e3 FROM p)
SELECT 1 AS component, round(e1, 6) AS eigenvalue, round(e1 / 3, 6) AS share, round(e1 / 3, 6) AS cumulative FROM e UNION ALL SELECT 2, round(3 - e1 - e3, 6), round((3 - e1 - e3) / 3, 6), round((3 - e3) / 3, 6) FROM e UNION ALL SELECT 3, round(e3, 6), round(e3 / 3, 6), 1 FROM e""")
def _(lineitem):
    found = components.explained(components.fit(lineitem, ["l_quantity", "l_extendedprice", "l_discount"]))
    return lineitem.sparkSession.createDataFrame([(r["component"], round(r["eigenvalue"], 6), round(r["share"], 6), round(r["cumulative"], 6)) for r in found], "component int, eigenvalue double, share double, cumulative double")


@query("pca_scores", "lineitem", sql="""
WITH z AS (SELECT l_orderkey, l_linenumber, (l_quantity - avg(l_quantity) OVER ()) / stddev_pop(l_quantity) OVER () AS a, (l_extendedprice - avg(l_extendedprice) OVER ()) / stddev_pop(l_extendedprice) OVER () AS b FROM lineitem)
SELECT l_orderkey, l_linenumber, round((a + sign((SELECT corr(a, b) FROM z)) * b) / sqrt(2), 6) AS PC1 FROM z""")
def _(lineitem):
    model = components.fit(lineitem, ["l_quantity", "l_extendedprice"], k=1)
    return rounded(model.transform(lineitem).select("l_orderkey", "l_linenumber", "PC1"), 6, "PC1")


@query("pca_loadings", "lineitem")
def _(lineitem):
    return components.loading_table(lineitem.sparkSession, components.fit(lineitem, MEASURES))


@query("pca_iterative_imputation", "lineitem")
def _(lineitem):
    table = lineitem.select(F.expr(GAPS).alias("q"), "l_extendedprice", "l_tax")
    return components.impute(table, ["q", "l_extendedprice", "l_tax"])[0].select(*[F.col("x")[k].alias(c) for k, c in enumerate(("q", "price", "tax"))])


@query("projection", "part", sql="SELECT p_partkey, round(0.6 * (p_size - avg(p_size) OVER ()) / stddev_pop(p_size) OVER () - 0.8 * (p_retailprice - avg(p_retailprice) OVER ()) / stddev_pop(p_retailprice) OVER (), 6) AS PC1 FROM part")
def _(part):
    loadings = part.sparkSession.createDataFrame([("p_size", 0.6), (" P_RETAILPRICE", -0.8)], "variable string, first double")
    return rounded(components.project(part, loadings)[0].select("p_partkey", "PC1"), 6, "PC1")


def suppliers(supplier: DataFrame) -> DataFrame:
    return clusters.axes_of(supplier.withColumn("_row", F.col("s_suppkey")), ["s_acctbal", "s_nationkey"], standardise=True)


@query("kmeans", "customer")
def _(customer):
    return clusters.kmeans_reference(clusters.axes_of(customer.withColumn("_row", F.col("c_custkey")), ["c_acctbal", "c_nationkey"], standardise=True), 3)


@query("kmeans_scaled", "customer")
def _(customer):
    return clusters.kmeans_scaled(clusters.axes_of(customer.withColumn("_row", F.col("c_custkey")), ["c_acctbal", "c_nationkey"], standardise=True), 3)


@query("dbscan", "supplier", sql="""
WITH RECURSIVE z AS (SELECT s_suppkey AS r, (s_acctbal - avg(s_acctbal) OVER ()) / stddev_pop(s_acctbal) OVER () AS x, (s_nationkey - avg(s_nationkey) OVER ()) / stddev_pop(s_nationkey) OVER () AS y FROM supplier),
near AS (SELECT a.r AS a, b.r AS b FROM z a, z b WHERE (a.x - b.x) ** 2 + (a.y - b.y) ** 2 <= 0.4 * 0.4),
core AS (SELECT a FROM near GROUP BY a HAVING count(*) >= 4),
link AS (SELECT near.a, near.b FROM near JOIN core p ON p.a = near.a JOIN core q ON q.a = near.b),
reach AS (SELECT a, a AS b FROM core UNION SELECT reach.a, link.b FROM reach JOIN link ON link.a = reach.b),
comp AS (SELECT a, min(b) AS c FROM reach GROUP BY a),
no AS (SELECT c, row_number() OVER (ORDER BY c) - 1 AS no FROM (SELECT DISTINCT c FROM comp)),
mine AS (SELECT near.a AS r, min(comp.c) AS c FROM near JOIN comp ON comp.a = near.b GROUP BY near.a)
SELECT z.r AS _row, coalesce('Cluster ' || no.no, 'Noise') AS "Cluster" FROM z LEFT JOIN mine USING (r) LEFT JOIN no USING (c)""")
def _(supplier):
    return clusters.dbscan(suppliers(supplier), 0.4, 4)


@query("k_distance", "supplier", sql="""
WITH z AS (SELECT s_suppkey AS r, s_acctbal AS x, s_nationkey AS y FROM supplier), d AS (SELECT a.r, sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2) AS d FROM z a, z b WHERE a.r <> b.r)
SELECT r AS _row, round(d, 6) AS d FROM (SELECT r, d, row_number() OVER (PARTITION BY r ORDER BY d) AS k FROM d) WHERE k = 4""")
def _(supplier):
    return rounded(clusters.k_distances(clusters.numbers(supplier.withColumn("_row", F.col("s_suppkey")), ["s_acctbal", "s_nationkey"]), 5), 6, "d")


@query("silhouette", "supplier", sql="""
WITH z AS (SELECT s_suppkey AS r, s_acctbal AS x, s_nationkey AS y, CASE WHEN s_acctbal < 3000 THEN 'a' ELSE 'b' END AS c FROM supplier),
d AS (SELECT a.r, a.c AS ca, b.c AS cb, avg(sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2)) AS m FROM z a, z b WHERE a.r <> b.r GROUP BY 1, 2, 3),
s AS (SELECT r, max(m) FILTER (ca = cb) AS a, min(m) FILTER (ca <> cb) AS b FROM d GROUP BY r)
SELECT round(avg(CASE WHEN a IS NULL OR b IS NULL THEN 0 ELSE (b - a) / greatest(a, b) END), 6) AS silhouette, count(*) AS n FROM s""")
def _(supplier):
    points = clusters.numbers(supplier.withColumn("_row", F.col("s_suppkey")), ["s_acctbal", "s_nationkey"])
    labelled = points.withColumn("Cluster", F.when(F.col("x")[0] < 3000, "a").otherwise("b"))
    return rounded(clusters.silhouette(labelled), 6, "silhouette").drop("error")


@query("silhouette_bounded", "customer", sql="""
WITH z AS (SELECT c_custkey AS r, c_acctbal AS x, c_nationkey * 400 AS y, CASE WHEN c_acctbal < 1000 THEN 'a' WHEN c_acctbal < 6000 THEN 'b' ELSE 'c' END AS c FROM customer),
d AS (SELECT a.r, a.c AS ca, b.c AS cb, avg(sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2)) AS m FROM z a, z b WHERE a.r <> b.r GROUP BY 1, 2, 3),
s AS (SELECT r, max(m) FILTER (ca = cb) AS a, min(m) FILTER (ca <> cb) AS b FROM d GROUP BY r)
SELECT round(avg(CASE WHEN a IS NULL OR b IS NULL THEN 0 ELSE (b - a) / greatest(a, b) END), 3) AS silhouette, true AS bounded, count(*) AS n FROM s""")
def _(customer):
    points = clusters.numbers(customer.select(F.col("c_custkey").alias("_row"), "c_acctbal", (F.col("c_nationkey") * 400).alias("y")), ["c_acctbal", "y"])
    at = F.col("x")[0]
    labelled = points.withColumn("Cluster", F.when(at < 1000, "a").when(at < 6000, "b").otherwise("c"))
    found = clusters.silhouette(labelled, tolerance=1e-4)
    return rounded(found.withColumn("bounded", F.col("error") < 1e-3), 3, "silhouette").drop("error")


from strata.plans import feature_queries  # noqa: E402, F401  (it registers more)
