import pandas as pd

from echoframe.params import Trains
from echoframe.streaming import trains


def test_trains_close_in_a_stream(spark, tmp_path):
    src = str(tmp_path / "in")
    first = [(1, 0.0), (1, 0.02), (1, 0.05), (2, 0.0), (1, 5.0), (1, 5.01)]
    last = [(1, 100.0), (2, 100.0)]
    schema = "src long, t double, ts timestamp"
    for k, rows in enumerate((first, last, [(3, 300.0)])):
        pdf = pd.DataFrame([(s, t, pd.Timestamp(1_700_000_000 + t, unit="s")) for s, t in rows], columns=["src", "t", "ts"])
        spark.createDataFrame(pdf, schema).coalesce(1).write.mode("append").parquet(f"{src}/{k}")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(src)
    out = trains.train_stream(stream, "ts", Trains(0.009, 0.15, 2), "1 second")
    q = out.writeStream.format("memory").queryName("closed").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = {(r.src, round(r.start_time, 3), r.n_clicks) for r in spark.table("closed").collect()}
    assert got == {(1, 0.0, 3), (1, 5.0, 2)}


def test_duplicates_within_the_watermark(spark, tmp_path):
    src = str(tmp_path / "in")
    spark.createDataFrame([(1, "2024-01-01 00:00:00"), (1, "2024-01-01 00:00:01"), (2, "2024-01-01 00:00:00")], "id long, s string").selectExpr("id", "cast(s as timestamp) as ts").coalesce(1).write.parquet(src)
    stream = spark.readStream.schema("id long, ts timestamp").parquet(src)
    q = trains.distinct_within(stream, "ts", ["id"], "1 minute").writeStream.format("memory").queryName("once").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert sorted(r.id for r in spark.table("once").collect()) == [1, 2]
