from strandlake.operators import intervals
from strandlake.streaming import depth_deltas


def test_deltas_of_a_stream_add_up(spark, tmp_path):
    parts = [[("a", 0, 5), ("a", 3, 9)], [("a", 4, 6), ("b", 1, 2)]]
    for k, rows in enumerate(parts):
        spark.createDataFrame(rows, "k string, start long, end long").coalesce(1).write.parquet(f"{tmp_path}/in/{k}")
    stream = spark.readStream.schema("k string, start long, end long").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*")
    q = depth_deltas(stream, ["k"]).writeStream.outputMode("complete").format("memory").queryName("deltas").option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start()
    q.awaitTermination(60)
    got = {(r.k, r.pos): r.d for r in spark.table("deltas").where("d != 0").collect()}
    want = {}
    for k, s, e in parts[0] + parts[1]:
        want[k, s] = want.get((k, s), 0) + 1
        want[k, e] = want.get((k, e), 0) - 1
    assert got == {x: d for x, d in want.items() if d}
    whole = spark.createDataFrame(parts[0] + parts[1], "k string, start long, end long")
    assert intervals.depth_runs(whole, ["k"]).count() == 6
