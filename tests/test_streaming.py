from pyspark.sql import functions as F

from strata.operators import charts
from strata.streaming.daily import daily

EVENTS = "/root/testdata/sf0.001/events.parquet"


def test_daily_stream_gives_the_finished_days_of_the_batch(spark, tmp_path):
    batch = spark.read.parquet(EVENTS)
    batch.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(batch.schema).parquet(str(tmp_path / "in"))
    q = daily(stream, "ts", "value", "sum", "event_type").writeStream.format("memory").queryName("daily").outputMode("append").start()
    q.processAllAvailable()
    q.stop()
    got = {(r["grp"], r["day"]): round(r["value"], 6) for r in spark.table("daily").collect()}
    want = {(r["grp"], r["day"]): round(r["value"], 6) for r in charts.line(batch, "ts", "value", "sum", "event_type").collect()}
    last = batch.agg(F.max("ts")).first()[0].date()
    assert got and got.items() <= want.items()
    assert {d for _, d in want if (last - d).days > 2} <= {d for _, d in got}
