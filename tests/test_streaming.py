from pyspark.sql import functions as F

from papyrite.streaming import events


def test_windows_on_a_stream_equal_those_of_the_batch(spark, tmp_path):
    rows = [(i, f"2024-01-01 0{i % 5}:{i % 60:02d}:00", "ab"[i % 2]) for i in range(100)]
    df = spark.createDataFrame(rows, "id int, t string, kind string").withColumn("t", F.to_timestamp("t"))
    df.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    query = events.windowed_counts(stream, "t", "kind", "1 hour").writeStream.format("memory").queryName("counts").outputMode("complete").trigger(availableNow=True).start()
    query.awaitTermination(60)
    assert sorted(spark.table("counts").collect()) == sorted(events.windowed_counts(df, "t", "kind", "1 hour").collect())


def test_upsert_of_the_same_batch_twice(spark, tmp_path):
    write = events.upsert_batches(str(tmp_path / "t"), "id")
    write(spark.createDataFrame([(1, "a"), (2, "b")], "id int, v string"), 0)
    for _ in range(2):
        write(spark.createDataFrame([(2, "c"), (3, "d")], "id int, v string"), 1)
    assert sorted(map(tuple, spark.read.parquet(str(tmp_path / "t" / "v=1")).collect())) == [(1, "a"), (2, "c"), (3, "d")]
