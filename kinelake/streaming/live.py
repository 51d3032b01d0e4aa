"""Structured Streaming versions of scoring, windowed statistics and active bouts."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from operator import and_

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def windowed_statistics(
    frames: DataFrame, keys: list[str], value: str, width: str = "1 hour", late: str = "10 minutes", ts: str = "ts"
) -> DataFrame:
    """Mean, std, slope, max, min per key and event-time window; later rows than the watermark drop."""
    x = F.unix_micros(F.col(ts)) / F.lit(1e6)
    start = F.unix_micros(F.col("window.start")) / F.lit(1e6)
    w = frames.withWatermark(ts, late).withColumn("window", F.window(ts, width)).withColumn("_x", x - start)
    slope = F.try_divide(F.covar_pop(value, F.col("_x")), F.var_pop("_x"))
    out = w.groupBy(*keys, "window").agg(
        F.count(F.lit(1)).alias("n"),
        F.avg(value).alias("mean"),
        F.stddev_pop(value).alias("std"),
        F.coalesce(slope, F.lit(0.0)).alias("slope"),
        F.max(value).alias("max"),
        F.min(value).alias("min"),
    )
    return out.withColumn("window_start", F.col("window.start")).drop("window")


def active_bouts(
    frames: DataFrame, keys: list[str], value: str, threshold: float, gap: str = "30 minutes", late: str = "10 minutes", ts: str = "ts"
) -> DataFrame:
    """Sessions of above-threshold rows separated by at most ``gap``."""
    above = frames.withWatermark(ts, late).filter(F.col(value) > threshold)
    s = above.groupBy(*keys, F.session_window(ts, gap).alias("_w")).agg(
        F.count(F.lit(1)).alias("n"), F.min(ts).alias("onset"), F.max(ts).alias("offset"), F.max(value).alias("peak")
    )
    return s.drop("_w")


def score_new_recordings(
    stream: DataFrame, score: Callable[[DataFrame], DataFrame], out: str, checkpoint: str, keys: list[str], length: str, waiting: str
) -> StreamingQuery:
    """Score recordings with the batch operators once all their frames have come; runs until caught up.

    ``length`` is a column that states the number of frames of the row's recording. Frames of unfinished recordings are
    carried from batch to batch under ``waiting``, a folder that driver and executors share, so a recording split over
    batches, in any order, is scored once and whole.

    Each batch writes its scores and what it carries to folders named by its number and overwrites them when it is
    repeated, so a retry changes nothing. Scores are read from ``out``, with ``epoch`` as a partition column.
    """
    spark = stream.sparkSession

    def folder(epoch: int):
        return f"{waiting.rstrip('/')}/epoch={epoch}"

    def handle(batch: DataFrame, epoch: int) -> None:
        at = spark._jvm.org.apache.hadoop.fs.Path(folder(epoch - 1))
        files = at.getFileSystem(spark._jsc.hadoopConfiguration())
        rows = batch
        if files.exists(at):
            rows = batch.unionByName(spark.read.schema(batch.schema).parquet(folder(epoch - 1)))
        counts = rows.groupBy(*[F.col(k).alias(f"_d_{k}") for k in keys]).agg(F.count(F.lit(1)).alias("_n"), F.max(length).alias("_all"))
        done = counts.filter("_n >= _all")  # one row per recording
        same = reduce(and_, [rows[k].eqNullSafe(done[f"_d_{k}"]) for k in keys])
        rows.join(done, same, "left_anti").write.mode("overwrite").parquet(folder(epoch))
        score(rows.join(done, same, "left_semi")).write.mode("overwrite").parquet(f"{out.rstrip('/')}/epoch={epoch}")
        # Only the folder before may be needed again.
        files.delete(spark._jvm.org.apache.hadoop.fs.Path(folder(epoch - 2)), True)

    return stream.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def run_to_table(df: DataFrame, path: str, checkpoint: str, mode: str = "append") -> StreamingQuery:
    """Write a streaming result to parquet until the source is exhausted."""
    return (
        df.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint)
        .outputMode(mode).trigger(availableNow=True).start()
    )
