"""Groups of sources, in batch and as a stream of completed windows.

A completed window is a row (group_idx, band_pos, payload, error); error is null if it succeeded.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def unstacked(done: DataFrame) -> DataFrame:
    """An output for each window; a failed one's is missing."""
    return done.select("group_idx", "band_pos", F.when(F.col("error").isNull(), F.col("payload")).alias("payload"), F.col("error").isNotNull().alias("failed"))


def stacked(done: DataFrame) -> DataFrame:
    """An output for each group, its windows by position; one failure makes the whole group's output missing, a source
    without overlap (no row) is just left out."""
    got = F.array_sort(F.collect_list(F.struct("band_pos", "payload")))
    per = done.groupBy("group_idx").agg(F.bool_or(F.col("error").isNotNull()).alias("failed"), F.count("*").alias("n_windows"), got.alias("windows"))
    return per.select("group_idx", "failed", "n_windows", F.when(~F.col("failed"), F.transform("windows", lambda w: w["payload"])).alias("payloads"))


def failures(done: DataFrame) -> DataFrame:
    return done.groupBy("group_idx").agg(F.count_if(F.col("error").isNotNull()).alias("n_failed"), F.count("*").alias("n_windows"))


def output_paths(sources: DataFrame, template: str, stack: bool) -> DataFrame:
    """``dir/stem_group[_band].ext`` for each output; blank names give way to positions. n_same over 1 is a collision."""
    folder, _, name = template.rpartition("/")
    stem, dot, ext = name.rpartition(".")
    stem, ext = (stem, ext) if dot else (name, "tif")
    named = lambda c, i: F.when(F.coalesce(F.col(c), F.lit("")) == "", (F.col(i)).cast("string")).otherwise(F.col(c))
    parts: list[Column] = [F.lit(stem), named("group_name", "group_idx")] + ([] if stack else [named("band_name", "band_pos")])
    keys = ["group_idx"] if stack else ["group_idx", "band_pos"]
    path = F.concat(F.lit(f"{folder}/" if folder else ""), F.concat_ws("_", *parts), F.lit(f".{ext}"))
    out = sources.select(*keys, path.alias("path")).distinct()
    return out.withColumn("n_same", F.count("*").over(Window.partitionBy("path")))


def explicit_paths(sources: DataFrame, stack: bool) -> DataFrame:
    """Paths as given in ``out``: one for each source, or with stack one for each group (of its first source)."""
    if stack:
        out = sources.groupBy("group_idx").agg(F.min_by("out", "band_pos").alias("path"))
    else:
        out = sources.select("group_idx", "band_pos", F.col("out").alias("path"))
    return out.withColumn("n_same", F.count("*").over(Window.partitionBy("path")))


def fetched(planned: DataFrame, bands: list[int]) -> DataFrame:
    """Completed windows, batch or stream: group_idx, band_pos, need, payload (the window's values as bands x ysize x xsize
    little-endian doubles, null if it failed) and error of planned windows that carry the first three. A task reads a
    window at a time, which the request's limit of bytes bounds."""
    import numpy as np

    from gridloom.sources import tiff

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            for r in rows.itertuples():
                payload, error = None, None
                try:
                    out = np.zeros((len(bands), r.ysize, r.xsize), "<f8")
                    ty = range(r.yoff // r.tile_height, (r.yoff + r.ysize - 1) // r.tile_height + 1)
                    tx = range(r.xoff // r.tile_width, (r.xoff + r.xsize - 1) // r.tile_width + 1)
                    with tiff.open_file(r.src) as f:
                        for b, row, col, w, values in tiff.tiles_of(f, tiff.directories(f), r.level, [(y, x) for y in ty for x in tx], sorted(set(bands)), 0.0 if pd.isna(r.nodata) else r.nodata):
                            part, top, left = values.reshape(-1, w), row - r.yoff, col - r.xoff
                            cut = part[max(0, -top) : r.ysize - top, max(0, -left) : r.xsize - left]
                            for k in [k for k, x in enumerate(bands) if x == b]:
                                out[k, max(0, top) : max(0, top) + cut.shape[0], max(0, left) : max(0, left) + cut.shape[1]] = cut
                    payload = out.tobytes()
                except Exception as e:
                    error = f"{r.src}: {e}"
                yield pd.DataFrame({"group_idx": [r.group_idx], "band_pos": [r.band_pos], "need": [r.need], "payload": [payload], "error": [error]})

    return planned.mapInPandas(run, "group_idx long, band_pos long, need long, payload binary, error string")


def needed(planned: DataFrame) -> DataFrame:
    """Planned windows with ``need``, the number of windows of their group: only sources that overlap have one."""
    return planned.withColumn("need", F.count("*").over(Window.partitionBy("group_idx")))


def require_distinct(paths: DataFrame) -> DataFrame:
    if not paths.where("n_same > 1").isEmpty():
        raise ValueError("the template expands to duplicate output paths; give groups and bands distinct names")
    return paths


def relist(outputs: DataFrame) -> DataFrame:
    """Outputs (group_idx, band_pos, path) back in the shape of the request: an array for each group."""
    return outputs.groupBy("group_idx").agg(F.transform(F.array_sort(F.collect_list(F.struct("band_pos", "path"))), lambda x: x["path"]).alias("paths"))


def window_stream(planned: DataFrame, folder: str, per_file: int = 64, files_per_batch: int = 8) -> DataFrame:
    """Planned windows (see needed) as a stream that admits at most per_file x files_per_batch of them a batch (twice as many
    in the first after a stop, if some had been admitted and not taken), groups after each other. They are written to folder first, unless it has them already; so a query that was stopped goes on from its
    checkpoint, over the same files, where it was."""
    spark = planned.sparkSession
    jvm = spark.sparkContext._jvm
    done = jvm.org.apache.hadoop.fs.Path(f"{folder}/_SUCCESS")
    if not done.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(done):
        near = planned.repartitionByRange("group_idx", "band_pos").sortWithinPartitions("group_idx", "band_pos")
        near.write.mode("overwrite").option("maxRecordsPerFile", per_file).parquet(folder)
    return spark.readStream.schema(planned.schema).option("maxFilesPerTrigger", files_per_batch).parquet(folder)


ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def stack_stream(done: DataFrame, group_type: str = "long", payload_type: str = "string", patience: int | None = None) -> DataFrame:
    """As stacked(), over a stream whose rows also carry ``need``, the group's number of windows: a group comes out once,
    when its last window arrives, and its state is freed. The order of arrival and the batch size don't matter.

    A window's payload is written to the state once, under its own key, and not at all once its group has failed; what is
    rewritten with each batch is the group's count. With patience (seconds), a group whose windows stay away for so long
    comes out as failed with those that came; a window that comes later still begins the group anew. The session's state
    store becomes RocksDB, which keyed states need."""
    from pyspark.sql.streaming import StatefulProcessor

    class Groups(StatefulProcessor):
        def init(self, handle):
            self.handle = handle
            self.count = handle.getValueState("count", "n long, need long, failed boolean, due long")
            self.windows = handle.getMapState("windows", "band_pos long, at long", f"payload {payload_type}")

        def finished(self, key, n, failed):
            payloads = None
            if not failed:
                have = [(k[0], v[0]) for k, v in self.windows.iterator()]
                # Windows of equal place come in the order of their payloads, those without one first.
                have.sort(key=lambda x: (x[0], x[1] is not None, x[1] if x[1] is not None else 0))
                payloads = [p for _, p in have]
            self.count.clear()
            self.windows.clear()
            return pd.DataFrame({"group_idx": [key[0]], "failed": [failed], "n_windows": [n], "payloads": [payloads]})

        def handleInputRows(self, key, rows, timerValues):
            n, need, failed, due = self.count.get() if self.count.exists() else (0, 0, False, None)
            for part in rows:
                for pos, payload, error, most in zip(part.band_pos, part.payload, part.error, part.need, strict=True):
                    failed, need, n = failed or not pd.isna(error), int(most), n + 1
                    if not failed:
                        self.windows.updateValue((int(pos), n), (None if payload is None or payload is pd.NA or payload != payload else payload,))
            if due is not None:
                self.handle.deleteTimer(due)
            if n >= need:
                yield self.finished(key, n, failed)
                return
            if failed:
                self.windows.clear()
            if patience is not None:
                due = timerValues.getCurrentProcessingTimeInMs() + patience * 1000
                self.handle.registerTimer(due)
            self.count.update((n, need, failed, due))

        def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
            if self.count.exists():
                yield self.finished(key, self.count.get()[0], True)

        def close(self):
            pass

    done.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    out = f"group_idx {group_type}, failed boolean, n_windows long, payloads array<{payload_type}>"
    return done.groupBy("group_idx").transformWithStateInPandas(Groups(), out, "append", "none" if patience is None else "processingTime")
