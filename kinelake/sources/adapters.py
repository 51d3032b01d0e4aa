"""Extension points: dataset adapters, reshape strategies, models and metrics are plain callables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from kinelake.config import DatasetConfig

Adapter = Callable[[SparkSession, DatasetConfig, str], DataFrame]
Strategy = Callable[..., DataFrame]

ADAPTERS: dict[str, Adapter] = {}
STRATEGIES: dict[str, Strategy] = {}


def adapter(name: str):
    """Register ``fn(spark, config, raw_dir) -> frames``."""

    def add(fn: Adapter) -> Adapter:
        ADAPTERS[name] = fn
        return fn

    return add


def strategy(name: str):
    """Register ``fn(frames, **params) -> frames``."""

    def add(fn: Strategy) -> Strategy:
        STRATEGIES[name] = fn
        return fn

    return add


def ingest(
    spark: SparkSession, config: DatasetConfig, raw_dir: str, out_dir: str, tasks: list[int] | None = None, dry_run: bool = False
) -> DataFrame:
    """Run the dataset's adapter and store its recordings (a dry run stores nothing)."""
    from kinelake.sources.store import write_recordings

    if config.name not in ADAPTERS:
        raise ValueError(f"no adapter for dataset {config.name!r}; have {sorted(ADAPTERS)}")
    frames = ADAPTERS[config.name](spark, config, raw_dir)
    if tasks is not None:
        frames = frames.filter(frames["task"].isin(tasks))
    return write_recordings(frames, out_dir, dry_run)


def prepare(frames: DataFrame, method: str, **params) -> DataFrame:
    if method not in STRATEGIES:
        raise ValueError(f"unknown strategy {method!r}; have {sorted(STRATEGIES)}")
    return STRATEGIES[method](frames, **params)


def _builtin() -> None:
    from kinelake.operators import reshape, spectral

    STRATEGIES.update(
        {
            "truncate": lambda df, channels, **kw: reshape.standardize(reshape.truncate(df, **kw), channels),
            "pad": lambda df, channels, **kw: reshape.standardize(reshape.pad(df, channels, **kw), channels),
            "sliding_window": lambda df, channels, size, overlap=0.5, **kw: reshape.standardize(
                reshape.sliding_windows(df, size, overlap, **kw), channels
            ),
            "variable_length": lambda df, **_: df,
            "phase_shift": lambda df, channels, fraction, **kw: reshape.standardize(
                reshape.truncate(reshape.phase_shift(df, fraction, **kw), **kw), channels
            ),
            "resample": lambda df, channels, ratio, **kw: spectral.resample(df, channels, ratio, **kw),
        }
    )


_builtin()


@adapter("xr_motion")
def xr_motion(spark: SparkSession, config: DatasetConfig, raw_dir: str) -> DataFrame:
    """Raw folder of <subject>/PlayerMovement.csv and <subject>/Master.csv -> recordings, in one scan each."""
    from pyspark.sql import functions as F

    from kinelake.config import RAW_NAMES, rotation_channels
    from kinelake.operators import align, ordering
    from kinelake.sources import logs

    subject = logs.subject_of_path()
    raw = {c: RAW_NAMES[c] for c in config.channels}
    move = logs.read_csv_any(spark, f"{raw_dir}/*/PlayerMovement.csv").withColumn("subject_id", subject)
    move = logs.movement_log(move, config.timestamp_column, list(raw.values()))
    move = align.semantic_names(move, raw, ["subject_id", "t"])
    marks = logs.read_csv_any(spark, f"{raw_dir}/*/Master.csv").withColumn("subject_id", subject)
    # Marker files are a few dozen lines, so a file is one split and its rows are numbered in order.
    marks = logs.marker_log(marks.withColumn("row_no", F.monotonically_increasing_id()))
    labels = {t: f"Task {t}" for t in config.tasks}
    cut = align.slice_recordings(move, align.task_intervals(marks, labels))
    keys = ["subject_id", "task"]
    cut = ordering.position(cut, keys, F.col("t"), ["t"])
    fixed = align.unwrap_rotations(cut, rotation_channels(config.channels), keys)
    grp = F.when(F.lower("subject_id").startswith("fx"), "control").otherwise("patient")
    return fixed.select(
        "subject_id", "task", grp.alias("grp"), "frame_idx", align.frame_time("frame_idx", config.sampling_rate).alias("t_s"), *config.channels
    )
