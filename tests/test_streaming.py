"""A chain over the micro-batches of a stream gives what it gives over each batch."""

from labelcube import Cube
from labelcube.streaming import each_batch


def test_each_batch_of_a_stream(spark, tmp_path):
    for k in range(3):
        rows = [("a", k * 10 + i % 2, float(i)) for i in range(4)] + [("b", k * 10, 1.0)]
        spark.createDataFrame(rows[:1] + rows[2:], "name string, t long, x double").dropDuplicates(["name", "t"]).coalesce(1).write.parquet(str(tmp_path / "in" / f"part{k}"))
    found = {}
    step = each_batch(lambda df: Cube.from_frame(df, ["name", "t"], ["x"]), lambda p: p.max("t"), lambda df, n: found.update({n: sorted(map(tuple, df.collect()))}))
    stream = spark.readStream.schema("name string, t long, x double").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in" / "*"))
    stream.writeStream.foreachBatch(step).trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "checkpoint")).start().awaitTermination(120)
    assert len(found) == 3 and all([name for name, _ in rows] == ["a", "b"] for rows in found.values())
