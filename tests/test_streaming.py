from __future__ import annotations

from custodia.streaming import progress


def test_reached_stream_is_what_the_table_gives(spark, data, tmp_path):
    events = spark.read.parquet(f"{data}/events.parquet").select("user_id", "ts", "value")
    folder = str(tmp_path / "in")
    for k, part in enumerate(events.randomSplit([0.3, 0.3, 0.4], seed=1)):
        part.coalesce(1).write.mode("append").parquet(folder)
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(folder)
    query = progress.reached_stream(stream, "user_id", "ts", "value").writeStream.outputMode("update").format("memory").queryName("reached").option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    query.awaitTermination(120)
    got = {r["user_id"]: r["high"] for r in spark.sql("select user_id, max(reached) as high from reached group by user_id").collect()}
    assert got == {r["user_id"]: r["high"] for r in events.groupBy("user_id").agg({"value": "max"}).withColumnRenamed("max(value)", "high").collect()}


def test_repeated_messages_are_left_out(spark):
    rows = [("k", 1, 1, "a"), ("k", 2, 3, "a"), ("k", 3, 2, "b"), ("k", 4, 5, None), ("k", 5, 4, None)]
    df = spark.createDataFrame(rows, "key string, at int, step int, message string")
    assert [(r["at"], r["reached"]) for r in progress.reached(df, "key", ["at"], "step", "message").orderBy("at").collect()] == [(1, 1), (3, 3), (4, 5), (5, 5)]
