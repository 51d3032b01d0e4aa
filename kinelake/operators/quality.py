"""Recording quality reports and duration outliers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinelake.config import RECORDING
from kinelake.operators import ordering

# Thresholds of a usable recording and of the outlier rules.
MIN_QUALITY, MIN_FRAMES, MIN_DURATION = 100.0, 25, 0.1
IQR_MULTIPLIER, Z_THRESHOLD = 3.0, 3.0
PERCENTILE_LOWER, PERCENTILE_UPPER = 1, 100


def completeness(df: DataFrame, channels: list[str], keys: list[str] = RECORDING) -> DataFrame:
    """Percent of non-null values per channel and their mean."""
    n = F.count(F.lit(1))
    out = df.groupBy(*keys).agg(
        n.alias("total_frames"), *[(100.0 * F.count(c) / n).alias(f"{c}_pct") for c in channels]
    )
    overall = sum((F.col(f"{c}_pct") for c in channels), F.lit(0.0)) / len(channels)
    return out.withColumn("missing_frames_pct", F.lit(0.0)).withColumn("overall_quality_score", overall)


def temporal_quality(df: DataFrame, time: str, keys: list[str] = RECORDING, idx: str = "frame_idx") -> DataFrame:
    """Rate, interval mean/std, duration and consistency of the time column."""
    x = ordering.neighbours(df, keys, {"_pt": (time, -1)}, idx)
    gap = F.col(time) - F.col("_pt")
    out = x.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"),
        F.avg(gap).alias("mean_frame_interval"),
        F.stddev_pop(gap).alias("frame_interval_std"),
        F.coalesce(F.sum(gap), F.lit(0.0)).alias("duration"),
    )
    mean, std = F.col("mean_frame_interval"), F.col("frame_interval_std")
    return out.select(
        *keys,
        F.when(F.col("duration") > 0, F.try_divide(F.col("n"), F.col("duration"))).alias("sampling_rate"),
        "mean_frame_interval",
        "frame_interval_std",
        "duration",
        F.when((F.col("n") >= 2) & (mean > 0), 1.0 - F.try_divide(std, mean))
        .otherwise(0.0)
        .alias("frame_interval_consistency"),
    )


def failure_reasons() -> Column:
    """Short codes, name and value, of the thresholds a recording misses (empty = passes)."""
    q, n, d = (F.col(c) for c in ("overall_quality_score", "total_frames", "duration"))
    low_quality = F.when(q < MIN_QUALITY, F.format_string("quality:%.1f", q))
    few_frames = F.when(n < MIN_FRAMES, F.format_string("frames:%d", n))
    too_short = F.when(d < MIN_DURATION, F.format_string("duration:%.3f", d))
    return F.array_compact(F.array(low_quality, few_frames, too_short))


def quality_report(df: DataFrame, channels: list[str], time: str, keys: list[str] = RECORDING) -> DataFrame:
    """Movement and temporal quality as nested structs plus the pass flag and reasons."""
    m = completeness(df, channels, keys)
    t = temporal_quality(df, time, keys)
    j = m.join(t, keys).withColumn("failure_reasons", failure_reasons())
    nested = [c for c in m.columns if c not in keys]
    timed = [c for c in t.columns if c not in keys]
    return j.select(
        *keys,
        F.struct(*nested).alias("movement_quality"),
        F.struct(*timed).alias("temporal_quality"),
        (F.size("failure_reasons") == 0).alias("passes_quality_check"),
        "failure_reasons",
    )


def validate(df: DataFrame, channels: list[str], time: str, keys: list[str] = RECORDING, idx: str = "frame_idx"):
    """NaN/null share, infinity count, length mismatch and time order per recording."""
    x = ordering.neighbours(df, keys, {"_pt": (time, -1)}, idx)
    bad = sum((F.when(F.isnan(F.col(c).cast("double")) | F.col(c).isNull(), 1).otherwise(0) for c in channels), F.lit(0))
    inf = sum(
        (F.when(F.abs(F.col(c).cast("double")) == float("inf"), 1).otherwise(0) for c in channels), F.lit(0)
    )
    n = F.count(F.lit(1))
    return x.groupBy(*keys).agg(
        (n - F.count(time)).alias("length_mismatch"),
        (100.0 * F.sum(bad) / (n * len(channels))).alias("nan_pct"),
        F.sum(inf).alias("inf_count"),
        F.coalesce(F.min(F.col(time) - F.col("_pt")) >= 0, F.lit(True)).alias("time_ordered"),
    )


def outlier_bounds(trials: DataFrame, method: str, caps: dict[int, float | None] | None = None) -> DataFrame:
    """Bounds table: one row overall, or one per task for ``task_specific``."""
    d = F.col("duration_seconds")
    if method == "iqr":
        q = ordering.quantiles(trials, [], "duration_seconds", {"q1": 0.25, "q3": 0.75})
        iqr = F.col("q3") - F.col("q1")
        return q.select(
            (F.col("q1") - IQR_MULTIPLIER * iqr).alias("lower_bound"),
            (F.col("q3") + IQR_MULTIPLIER * iqr).alias("upper_bound"),
        )
    if method == "percentile":
        return ordering.quantiles(
            trials,
            [],
            "duration_seconds",
            {"lower_bound": PERCENTILE_LOWER / 100.0, "upper_bound": PERCENTILE_UPPER / 100.0},
        )
    if method == "zscore":
        return trials.agg(F.avg(d).alias("mean"), F.stddev_pop(d).alias("std"))
    if method == "task_specific":
        if caps is None:
            raise ValueError("task_specific needs a cap per task")
        rows = [(int(t), None if c is None else float(c)) for t, c in caps.items()]
        return trials.sparkSession.createDataFrame(rows, "task_number INT, upper_bound DOUBLE")
    raise ValueError(f"unknown outlier method {method!r}")


def flag_outliers(trials: DataFrame, method: str = "iqr", caps: dict[int, float | None] | None = None) -> DataFrame:
    """Add ``is_outlier`` by iqr, zscore, percentile or task_specific."""
    bounds = F.broadcast(outlier_bounds(trials, method, caps))  # one row, or one per configured task
    d = F.col("duration_seconds")
    if method == "task_specific":
        out = trials.join(bounds, "task_number", "left")
        return out.withColumn("is_outlier", F.coalesce(d > F.col("upper_bound"), F.lit(False)))
    out = trials.crossJoin(bounds)
    if method == "zscore":
        z = F.when(F.col("std") > 0, F.abs(F.try_divide(d - F.col("mean"), F.col("std")))).otherwise(0.0)
        return out.withColumn("zscore", z).withColumn("is_outlier", F.col("zscore") > Z_THRESHOLD)
    return out.withColumn("is_outlier", (d < F.col("lower_bound")) | (d > F.col("upper_bound")))


def outlier_counts(flagged: DataFrame) -> DataFrame:
    aggs = [
        F.count(F.lit(1)).alias("n_trials"),
        F.sum(F.col("is_outlier").cast("long")).alias("n_outliers"),
        F.avg(F.col("is_outlier").cast("double")).alias("outlier_rate"),
    ]
    if "lower_bound" in flagged.columns:
        d = F.col("duration_seconds")
        aggs += [
            F.sum((d < F.col("lower_bound")).cast("long")).alias("n_lower_outliers"),
            F.sum((d > F.col("upper_bound")).cast("long")).alias("n_upper_outliers"),
        ]
    return flagged.agg(*aggs)


def task_caps_report(flagged: DataFrame) -> DataFrame:
    """Per-task trials, outliers, longest duration and cap."""
    return flagged.groupBy("task_number").agg(
        F.first("upper_bound").alias("max_allowed"),
        F.count(F.lit(1)).alias("n_trials"),
        F.sum(F.col("is_outlier").cast("long")).alias("n_outliers"),
        F.max("duration_seconds").alias("actual_max"),
    )


def outlier_report(flagged: DataFrame, top: int = 20) -> DataFrame:
    """The first ``top`` outliers in trial order with the reason text."""
    d = F.col("duration_seconds")
    reason = F.lit("statistical outlier")
    if "lower_bound" in flagged.columns:
        reason = F.when(d < F.col("lower_bound"), F.format_string("< %.2fs", "lower_bound")).otherwise(
            F.format_string("> %.2fs", "upper_bound")
        )
    cols = ["window_id", "subject_id", "task_number", "duration_seconds"]
    return flagged.filter("is_outlier").select(*cols, reason.alias("reason")).orderBy("window_id").limit(top)
