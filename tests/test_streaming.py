"""Streams against the same functions on stored tables."""

from pyspark.sql import functions as F

from tidepeak.streaming import live


def table(spark, folder):
    rows = [(t % 2, 1_700_000_000 + t * t % 97, f"w{t % 3} w{t % 5}", t) for t in range(60)]
    df = spark.createDataFrame(rows, "room long, s long, content string, t int").withColumn("ts", F.timestamp_seconds("s")).drop("s")
    df.repartition(2).write.parquet(f"{folder}/chat.parquet")
    return spark.read.parquet(f"{folder}/chat.parquet")


def test_counts_of_a_stream_equal_those_of_its_table(spark, tmp_path):
    stored = table(spark, tmp_path)
    stream = spark.readStream.schema(stored.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/chat.parquet")
    query = live.tumbling_counts(stream, "10 seconds", "1 hour").writeStream.format("memory").queryName("counts").outputMode("complete").trigger(availableNow=True).start()
    query.awaitTermination(120)
    got = sorted(tuple(r) for r in spark.table("counts").collect())
    assert got == sorted(tuple(r) for r in live.tumbling_counts(stored, "10 seconds").collect()) and got


def test_appended_rows_are_all_there(spark, tmp_path):
    stored = table(spark, tmp_path)
    stream = spark.readStream.schema(stored.schema).parquet(f"{tmp_path}/chat.parquet")
    live.append_json(stream.select("room", "t"), f"{tmp_path}/out", f"{tmp_path}/state").awaitTermination(120)
    assert spark.read.json(f"{tmp_path}/out").count() == stored.count()
