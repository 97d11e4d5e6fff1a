"""A stream gives what the table gives."""

from pyspark.sql import functions as F

from glyphmill.streaming import detectors

SCHEMA = "ts timestamp, event_type string, value double, text string"


def test_stream_equals_table(spark, tmp_path):
    rows = spark.range(200).select(F.timestamp_seconds(F.col("id") * 30 + 1_700_000_000).alias("ts"), F.concat(F.lit("t"), (F.col("id") % 3).cast("string")).alias("event_type"), F.col("id").cast("double").alias("value"), F.concat(F.lit("these are words of text "), (F.col("id") % 50).cast("string")).alias("text"))
    rows.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(SCHEMA).parquet(str(tmp_path / "in"))
    table = spark.read.schema(SCHEMA).parquet(str(tmp_path / "in"))
    for name, make in {"counts": lambda d: detectors.windowed_counts(d).select("window", "event_type", "n", "total"), "languages": lambda d: detectors.language_stream(d).groupBy("language").count()}.items():
        query = make(stream).writeStream.outputMode("complete").format("memory").queryName(name).option("checkpointLocation", str(tmp_path / name)).start()
        query.processAllAvailable()
        query.stop()
        assert sorted(map(str, spark.table(name).collect())) == sorted(map(str, make(table).collect()))
    query = detectors.first_seen(stream).writeStream.outputMode("append").format("memory").queryName("seen").option("checkpointLocation", str(tmp_path / "seen")).start()
    query.processAllAvailable()
    query.stop()
    assert spark.table("seen").count() == 50
