import pytest
from pyspark.sql import functions as F

from gridloom.streaming import batch as B


def windows(spark):
    rows = [(1, 2, "b", None), (1, 1, "a", None), (2, 1, "c", None), (2, 2, "d", "timeout"), (3, 7, "e", None)]
    return spark.createDataFrame(rows, "group_idx long, band_pos long, payload string, error string")


def test_a_failure_takes_its_group_only(spark):
    out = {r.group_idx: (r.failed, r.payloads) for r in B.stacked(windows(spark)).collect()}
    assert out == {1: (False, ["a", "b"]), 2: (True, None), 3: (False, ["e"])}
    assert {(r.group_idx, r.band_pos) for r in B.unstacked(windows(spark)).where("failed").collect()} == {(2, 2)}


def test_paths(spark):
    s = spark.createDataFrame([(1, 1, "t1", "B1"), (1, 2, "t1", ""), (2, 1, None, "B1")], "group_idx int, band_pos int, group_name string, band_name string")
    assert {r.path for r in B.require_distinct(B.output_paths(s, "d/x.tif", False)).collect()} == {"d/x_t1_B1.tif", "d/x_t1_2.tif", "d/x_2_B1.tif"}
    assert {r.path for r in B.output_paths(s, "x", True).collect()} == {"x_t1.tif", "x_2.tif"}
    with pytest.raises(ValueError, match="duplicate output paths"):
        B.require_distinct(B.output_paths(s.withColumn("group_name", F.lit("t")), "x.tif", True))


@pytest.mark.parametrize("per_trigger", [1, 3])
def test_stream_gives_the_same_groups_whatever_the_batch_size(spark, tmp_path, per_trigger):
    rows = windows(spark).withColumn("need", F.when(F.col("group_idx") == 3, 1).otherwise(2).cast("long"))
    rows.repartition(5).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", per_trigger).parquet(f"{tmp_path}/in")
    q = B.stack_stream(stream).writeStream.format("memory").queryName(f"stacks{per_trigger}").outputMode("append").option("checkpointLocation", f"{tmp_path}/state").start()
    try:
        q.processAllAvailable()
    finally:
        q.stop()
    out = {r.group_idx: (r.failed, r.payloads) for r in spark.table(f"stacks{per_trigger}").collect()}
    assert out == {1: (False, ["a", "b"]), 2: (True, None), 3: (False, ["e"])}


def run(out, folder, name, until=None):
    q = out.writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", folder).start()
    try:
        q.processAllAvailable() if until is None else until(q)
        return q.recentProgress
    finally:
        q.stop()


def test_state_is_written_once_a_window(spark, tmp_path):
    """One group of many windows, one at a time: each batch writes its own window and the count, not all before it."""
    n = 12
    rows = spark.createDataFrame([(1, i % 5, f"p{i:02d}", None, n) for i in range(n)], "group_idx long, band_pos long, payload string, error string, need long")
    stream = B.window_stream(rows, f"{tmp_path}/in", per_file=1, files_per_batch=1)
    progress = run(B.stack_stream(stream), f"{tmp_path}/state", "once")
    assert [p["numInputRows"] for p in progress if p["numInputRows"]] == [1] * n
    written = [p["stateOperators"][0]["numRowsUpdated"] for p in progress if p["numInputRows"]]
    assert max(written) <= 3 and sum(written) <= 3 * n
    (out,) = spark.table("once").collect()
    assert out.payloads == [f"p{i:02d}" for i in sorted(range(n), key=lambda i: (i % 5, i))] and out.n_windows == n


def test_a_lost_window_ends_its_group(spark, tmp_path):
    rows = windows(spark).withColumn("need", F.lit(2).cast("long")).where("group_idx <> 2")
    rows.write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(rows.schema).parquet(f"{tmp_path}/in")

    def until(q):
        import time

        ends = time.time() + 60
        while time.time() < ends and spark.table("lost").count() < 2:
            time.sleep(0.5)

    run(B.stack_stream(stream, patience=2), f"{tmp_path}/state", "lost", until)
    out = {r.group_idx: (r.failed, r.n_windows, r.payloads) for r in spark.table("lost").collect()}
    assert out == {1: (False, 2, ["a", "b"]), 3: (True, 1, None)}


def test_a_stopped_stream_goes_on_and_equals_the_batch(spark, tmp_path):
    """Two runs over one checkpoint: the first takes one admitted batch, the second the rest, each group comes once."""
    rows = spark.createDataFrame([(g, b, f"{g}-{b}", "x" if (g, b) == (4, 1) else None) for g in range(1, 9) for b in range(g % 3 + 1)], "group_idx long, band_pos long, payload string, error string")
    planned = B.needed(rows)
    got, sizes = [], []
    for _ in range(2):
        stream = B.window_stream(planned, f"{tmp_path}/in", per_file=2, files_per_batch=2)
        sink = B.stack_stream(stream).writeStream.format("parquet").outputMode("append").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/state")
        q = sink.start()
        try:
            while not any(p["numInputRows"] for p in q.recentProgress) and q.isActive:
                q.awaitTermination(0.2)
            if sizes:
                q.processAllAvailable()
        finally:
            q.stop()
        sizes += [p["numInputRows"] for p in q.recentProgress if p["numInputRows"]]
        got.append(spark.read.parquet(f"{tmp_path}/out").count())
    # After a stop, files that were admitted but not taken join the next batch.
    assert sizes[0] == 4 and max(sizes) <= 8 and sum(s > 4 for s in sizes) <= 1 and got[0] < 8 and got[1] == 8
    after = {r.group_idx: (r.failed, r.n_windows, r.payloads) for r in spark.read.parquet(f"{tmp_path}/out").collect()}
    assert after == {r.group_idx: (r.failed, r.n_windows, r.payloads) for r in B.stacked(rows).collect()}
