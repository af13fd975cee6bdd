from pyspark.sql import functions as F

from tessera.streaming.bins import binned_stream

SCHEMA = "series_id long, band string, ts timestamp, m double, w double"


def test_stream_gives_what_the_table_gives(spark, tmp_path):
    rows = [(1, "a", 0, 1.0, 1.0), (1, "a", 3600, 3.0, 3.0), (1, "a", 90_000, 5.0, 2.0), (2, "b", 10, 7.0, 1.0), (1, "a", 900_000, 9.0, 1.0)]
    df = spark.createDataFrame(rows, "series_id long, band string, s long, m double, w double").select("series_id", "band", F.timestamp_seconds("s").alias("ts"), "m", "w")
    df.write.parquet(str(tmp_path / "in"))
    stream = binned_stream(spark.readStream.schema(SCHEMA).parquet(str(tmp_path / "in")), window="1 day")
    query = stream.writeStream.format("memory").queryName("binned").outputMode("complete").option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    assert query.awaitTermination(120)
    got = sorted(tuple(r) for r in spark.table("binned").collect())
    want = sorted(tuple(r) for r in binned_stream(df, window="1 day").collect())
    assert got == want and len(got) == 4
    first = next(r for r in got if r[0] == 1 and r[6] == 2)
    assert first[4:] == (2.5, 2.0, 2)
