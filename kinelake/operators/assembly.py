"""All feature modules of a recording in one table.

Frames are laid out once, as a table bucketed by recording: each module reads only its channels from it, and its
windows and groupings find recordings together, so no module moves frames again. A recording that is too long for one
task gives up the buckets; the modules then cut it into blocks as they do everywhere else.

Each module is a job of its own. A job that fails is run again on parts of the recordings, dealt by a hash, until the
recordings that break it stand alone: they lose this module, with a reason, and nothing else. A job that needs every
value asks for ``strict``: it ends with an error instead. Finished modules are marked, so a job that is started again on
the same folder computes only what is missing.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import reduce

from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinelake.config import CHANNELS, RECORDING, SENSORS
from kinelake.operators import complexity, features, kernel_ops, ordering, spectral
from kinelake.operators.features import axes
from kinelake.sources.store import discard, exists, scratch_path

#: Frames of the longest recording that may lie in one bucket.
BUCKET_FRAMES = 1 << 18
#: Parts into which the recordings of a failed job are dealt, and how often.
PARTS, SPLITS = 8, 6

MAGS = {f"{s}_mag": s for s in SENSORS}
SPEEDS = {f"{s}_speed": s for s in SENSORS}
# Names of the channels in feature names.
DISPLAY = {c: f"{'HLR'[i // 6]}_{c[-5:-2].title()}{c[-1].upper()}" for i, c in enumerate(CHANNELS)}

Module = Callable[[DataFrame], list[DataFrame]]


class ModuleFailed(RuntimeError):
    """A module could not be computed for some recordings."""


def named(table: DataFrame, names: dict[str, str] | None = None, prefix: str = "") -> DataFrame:
    """Feature columns to rows; a ``channel`` column is written into the names as ``names`` says."""
    by_channel = "channel" in table.columns
    ids = [*RECORDING, "channel"] if by_channel else RECORDING
    long = features.to_long(table, ids, [c for c in table.columns if c not in ids])
    if by_channel:
        channel = F.col("channel")
        for written, name in (names or {}).items():
            channel = F.when(F.col("channel") == written, name).otherwise(channel)
        feature = F.concat(channel, F.lit("_"), "feature")
    else:
        feature = F.concat(F.lit(prefix), "feature")
    return long.select(*RECORDING, feature.alias("feature"), "value")


def biomechanical(frames: DataFrame) -> list[DataFrame]:
    return [named(features.biomechanics(frames))]


def joint(frames: DataFrame) -> list[DataFrame]:
    found = features.range_of_motion(frames)
    return [named(found.drop(*[c for c in found.columns if c.endswith("_std")]))]


def asymmetry(frames: DataFrame) -> list[DataFrame]:
    mags = features.derived_signals(frames).select(*RECORDING, "frame_idx", "LeftHand_mag", "RightHand_mag")
    cross = spectral.max_cross_correlation(mags, "LeftHand_mag", "RightHand_mag")
    return [named(features.asymmetry(frames), prefix="hand_"), named(cross, prefix="hand_")]


def movement_quality(frames: DataFrame) -> list[DataFrame]:
    signals = features.derived_signals(frames)
    arc = spectral.spectral_features(spectral.welch(spectral.finite_series(signals.select(*RECORDING, "frame_idx", *SPEEDS), list(SPEEDS))))
    return [named(features.jerk(signals, list(SPEEDS)), SPEEDS), named(arc.select(*RECORDING, "channel", "sparc"), SPEEDS)]


def temporal(frames: DataFrame) -> list[DataFrame]:
    signals = features.derived_signals(frames)
    return [named(features.activity_span(signals, "head_step")), named(kernel_ops.temporal_features(signals, "head_step"))]


def time_domain(frames: DataFrame) -> list[DataFrame]:
    return [named(features.time_domain(frames, CHANNELS), DISPLAY)]


def magnitudes(frames: DataFrame, names: dict[str, str] = MAGS) -> DataFrame:
    return spectral.finite_series(features.derived_signals(frames).select(*RECORDING, "frame_idx", *names), list(names))


def frequency(frames: DataFrame) -> list[DataFrame]:
    series = magnitudes(frames)
    spectrum = spectral.spectral_features(spectral.welch(series)).drop("sparc", "spectral_entropy_normalised")
    return [named(spectrum, MAGS), named(spectral.fft_magnitude(series), MAGS)]


def wavelet(frames: DataFrame) -> list[DataFrame]:
    series = magnitudes(frames, {"Head_mag": "Head"})
    bands = kernel_ops.wavelet_features(series).withColumn("channel", F.concat(F.lit("head_"), "band")).drop("band")
    return [named(bands), named(kernel_ops.continuous_wavelet(series).drop("channel"), prefix="head_")]


def entropy(frames: DataFrame) -> list[DataFrame]:
    signals = features.derived_signals(frames).select(*RECORDING, "frame_idx", *MAGS)
    series = spectral.finite_series(signals, list(MAGS))
    expressions = [complexity.permutation_entropy, complexity.svd_entropy, complexity.hjorth, complexity.detrended_fluctuation, complexity.fractal_dimensions, complexity.higuchi]
    spectrum = spectral.spectral_features(spectral.welch(series)).select(*RECORDING, "channel", "spectral_entropy_normalised")
    tables = [f(signals, list(MAGS)) for f in expressions] + [spectrum, kernel_ops.entropies(series), kernel_ops.lempel_ziv(series)]
    return [named(t, MAGS) for t in tables]


# The nine modules, in the order in which they are computed.
MODULES: dict[str, Module] = {
    "biomechanical": biomechanical, "joint": joint, "asymmetry": asymmetry, "movement_quality": movement_quality, "temporal": temporal,
    "time_domain": time_domain, "frequency": frequency, "wavelet": wavelet, "complexity": entropy,
}


def by_recording(frames: DataFrame, ids: list[str] = RECORDING) -> tuple[DataFrame, int]:
    """The frames as stored, bucketed by recording while no recording is too long; and the longest recording's frames."""
    spark = frames.sparkSession
    path = scratch_path(spark, "frames")
    longest = ordering.largest_group(frames, ids)
    if longest > BUCKET_FRAMES:
        frames.write.parquet(path)
        return spark.read.schema(frames.schema).parquet(path), longest
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    name = f"frames_{uuid.uuid4().hex}"
    arranged = frames.repartition(buckets, *ids)  # one file a bucket
    arranged.write.bucketBy(buckets, *ids).sortBy(*ids, "frame_idx").option("path", path).saveAsTable(name)
    return spark.table(name), longest


def reason_of(error: Exception) -> str:
    """The innermost error that is named in the message: its class and what it says, in one line."""
    lines = [x.strip() for x in str(error).splitlines() if x.strip()]
    named_ = [x for x in lines if x.split(":")[0].endswith(("Error", "Exception")) and " " not in x.split(":")[0]]
    return (named_ or lines or [type(error).__name__])[-1][:200]


def module_values(frames: DataFrame, build: Module, path: str, ids: list[str]) -> list[tuple[Column | None, str]]:
    """Write a module's rows under ``path``; returns which recordings broke it (None: all) and why."""

    def attempt(where: Column | None, name: str) -> str | None:
        rows = frames if where is None else frames.filter(where)
        try:
            reduce(DataFrame.unionByName, build(rows)).write.mode("overwrite").parquet(f"{path}/{name}")
        except Exception as error:
            if not isinstance(error, PySparkException) and not hasattr(error, "java_exception"):  # a gateway error of a job that failed in the executors
                raise
            discard(frames.sparkSession, f"{path}/{name}")  # its parts write these recordings again
            return reason_of(error)
        return None

    why = attempt(None, "part=all")
    if why is None:
        return []
    broken: list[tuple[Column | None, str]] = [(None, why)]
    for split in range(SPLITS):
        found = []
        for k, (where, _) in enumerate(broken):
            for part in range(PARTS):
                inside = F.pmod(F.xxhash64(*ids, F.lit(split)), F.lit(PARTS)) == part
                inside = inside if where is None else where & inside
                why = attempt(inside, f"part={split}-{k}-{part}")
                if why is not None:
                    found.append((inside, why))
        if split == 0 and len(found) == PARTS:  # no recording can be told from another: the module itself is broken
            return [(None, found[0][1])]
        broken = found
        if not broken:
            break
    return broken


def assemble(
    frames: DataFrame, path: str, modules: dict[str, Module] | None = None, ids: list[str] = RECORDING, prefix: str = "ext_", strict: bool = False
) -> tuple[DataFrame, DataFrame]:
    """(ids, module, feature, value) of all modules, and (ids, module, reason) of recordings that a module left out.

    A recording may be left out because a module fails on it or because it gives no value. NULL values are no features.
    ``strict`` raises ``ModuleFailed`` where a module still fails on its smallest part; the module is not marked as finished.
    ``path`` keeps finished modules: only the others are computed when the job is run again.
    """
    spark = frames.sparkSession
    modules = modules or MODULES
    todo = [m for m in modules if not exists(spark, f"{path}/done/{m}/_SUCCESS")]
    if todo:
        stored, longest = by_recording(frames, ids)
        with ordering.bounded(ids, longest):
            for m in todo:
                discard(spark, f"{path}/values/module={m}")
                broken = module_values(stored, modules[m], f"{path}/values/module={m}", ids)
                if broken and strict:
                    raise ModuleFailed(f"module {m} fails on some or all recordings: {broken[0][1]}")
                recordings = stored.select(*ids).distinct()
                failed = [(recordings if where is None else recordings.filter(where)).withColumn("reason", F.lit(why)) for where, why in broken]
                empty = recordings.limit(0).withColumn("reason", F.lit(None).cast("string"))
                reduce(DataFrame.unionByName, failed, empty).write.mode("overwrite").parquet(f"{path}/done/{m}")
        recordings.write.mode("overwrite").parquet(f"{path}/recordings")
    kinds = frames.select(*ids).schema.simpleString()[7:-1].replace(":", " ").replace(",", ", ")
    read = [spark.read.schema(f"{kinds}, feature string, value double").parquet(f"{path}/values/module={m}").drop("part").withColumn("module", F.lit(m)) for m in modules if exists(spark, f"{path}/values/module={m}")]
    empty = spark.createDataFrame([], f"{kinds}, feature string, value double, module string")
    found = reduce(DataFrame.unionByName, read, empty).filter("value IS NOT NULL")
    long = found.select(*ids, "module", F.concat(F.lit(prefix), "feature").alias("feature"), "value")
    every = spark.read.parquet(f"{path}/recordings").withColumn("module", F.explode(F.array(*[F.lit(m) for m in modules])))
    failed = reduce(DataFrame.unionByName, [spark.read.schema(f"{kinds}, reason string").parquet(f"{path}/done/{m}").withColumn("module", F.lit(m)) for m in modules])
    has = long.select(*ids, "module").distinct()
    left_out = every.join(has, [*ids, "module"], "left_anti").join(failed, [*ids, "module"], "left")
    return long, left_out.select(*ids, "module", F.coalesce("reason", F.lit(features.NO_VALUE)).alias("reason"))


def wide_table(frames_ids: DataFrame, long: DataFrame, left_out: DataFrame, names: list[str] | None = None, ids: list[str] = RECORDING) -> DataFrame:
    """One row for each recording of ``frames_ids``: every feature as a column, and ``left_out`` as a map module -> reason.

    ``names`` are the feature columns; without them the names that occur are taken, a number that the modules bound.
    """
    names = names if names is not None else [r["feature"] for r in long.select("feature").distinct().collect()]
    cells = features.pivot_features(long, names, ids)
    why = left_out.groupBy(*ids).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("module", "reason")))).alias("left_out"))
    return frames_ids.select(*ids).distinct().join(cells, ids, "left").join(why, ids, "left")
