from pyspark.sql import functions as F

from graphtables.streaming import upkeep


def test_running_degrees_and_windows(spark, tmp_path):
    rows = [(1, 2, "2024-01-01 00:10:00"), (2, 3, "2024-01-01 00:50:00"), (1, 2, "2024-01-01 01:10:00")]
    df = spark.createDataFrame(rows, "src long, dst long, t string").withColumn("t", F.to_timestamp("t"))
    df.write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(df.schema).parquet(f"{tmp_path}/in")
    for name, out, mode in (("degrees", upkeep.running_degrees(stream), "complete"), ("windows", upkeep.windowed_events(stream, "t", "src"), "complete"), ("edges", upkeep.new_edges(stream, "t"), "append")):
        q = out.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).option("checkpointLocation", f"{tmp_path}/c_{name}").start()
        q.awaitTermination(120)
    assert {r.node_id: r.degree for r in spark.table("degrees").collect()} == {1: 2, 2: 3, 3: 1}
    assert sorted((r.src, r.n) for r in spark.table("windows").collect()) == [(1, 1), (1, 1), (2, 1)]
    assert spark.table("edges").count() == 2
    assert upkeep.new_edges(df, "t").count() == 2 and upkeep.windowed_events(df, "t", "src").count() == 3
