"""Every registered query with SQL gives DuckDB's rows on the smallest tables."""

import duckdb
import pytest

from pyspark.sql import functions as F

from compare import assert_same, connected
from strata.plans import registry

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connected(FOLDER)


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, con, name):
    df = registry.QUERIES[name](spark, FOLDER)
    if name in registry.ORACLES:
        assert_same(df, con, registry.ORACLES[name])
    else:
        assert df.count() > 0


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() == 3
    assert set(registry.QUERIES) <= set(__spark_entry__.queries())
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_k_distance_percentiles_of_more_rows_than_the_diagnostic_takes(spark, tmp_path):
    supplier = spark.range(1, 2501).select(F.col("id").alias("s_suppkey"), ((F.col("id") * 7919) % 10007 / 7).alias("s_acctbal"), (F.col("id") % 25).cast("int").alias("s_nationkey"))
    supplier.toPandas().to_parquet(tmp_path / "supplier.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW supplier AS SELECT * FROM '{tmp_path}/supplier.parquet'")
    assert_same(registry.QUERIES["k_distance_percentiles"](spark, str(tmp_path)), con, registry.ORACLES["k_distance_percentiles"])
