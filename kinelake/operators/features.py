"""Per-recording movement features as Spark aggregates (no Python in the plan)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinelake.config import ANATOMICAL_PAIRS, FUNCTIONAL_PAIRS, RECORDING, SAMPLING_RATE, SENSORS
from kinelake.functions.expr import corr, norm
from kinelake.operators import ordering
from kinelake.sources.store import stored

# Output names of the 19 time-domain features.
TIME_DOMAIN = [
    "mean", "median", "std", "variance", "range", "iqr", "mad", "min", "max", "percentile_25", "percentile_75",
    "percentile_95", "kurtosis", "skewness", "rms", "energy", "sma", "zero_crossing_rate", "autocorr_lag1",
]

#: Reason of a recording for which a module ran and gave no value; every other reason is a failure.
NO_VALUE = "no value"


def stacked(df: DataFrame, keys: list[str], channels: list[str], fields: dict[str, str]) -> DataFrame:
    """Long rows (keys, channel, value, <fields>); field columns are named ``{channel}{suffix}``."""
    rows = [
        F.struct(
            F.lit(c).alias("channel"),
            F.col(c).cast("double").alias("value"),
            *[F.col(f"{c}{suffix}").alias(name) for name, suffix in fields.items()],
        )
        for c in channels
    ]
    return df.select(*keys, F.inline(F.array(*rows)))


def time_domain(
    df: DataFrame, channels: list[str], keys: list[str] = RECORDING, max_rows: int | None = None
) -> DataFrame:
    """The 19 time-domain statistics, one row per (sample, channel).

    Lags and means are attached in wide form (one shuffle on the sample key for all channels); only
    then are channels stacked, so the long rows aggregate without another exchange. Percentiles of samples that fit an
    array come from the same exchange and are joined on the sample key, which moves neither side.
    """
    if max_rows is None:
        max_rows = ordering.largest_group(df, keys)
    wide = ordering.neighbours(df, keys, {f"{c}__p": (c, -1) for c in channels}, max_rows=max_rows)
    wide = ordering.attach(wide, keys, {f"{c}__m": F.avg(c) for c in channels}, max_rows)
    long = stacked(wide, keys, channels, {"prev": "__p", "mean_": "__m"})
    v, p = F.col("value"), F.col("prev")
    d = v - F.col("mean_")
    # The mean is on every row, so central moments are plain averages of powers.
    stats = [
        F.count(F.lit(1)).alias("n"),
        F.first("mean_").alias("mean"),
        F.avg(d * d).alias("_m2"),
        F.avg(d * d * d).alias("_m3"),
        F.avg(d * d * d * d).alias("_m4"),
        F.avg(F.abs(d)).alias("mad"),
        F.min(v).alias("min"),
        F.max(v).alias("max"),
        F.sqrt(F.avg(v * v)).alias("rms"),
        F.sum(v * v).alias("energy"),
        F.sum(F.abs(v)).alias("sma"),
        F.sum(F.when(F.signum(v) != F.signum(p), 1).otherwise(0)).alias("crossings"),
        corr(p, v).alias("autocorr_lag1"),
    ]
    probs = {"percentile_25": 0.25, "median": 0.5, "percentile_75": 0.75, "percentile_95": 0.95}
    out = long.groupBy(*keys, "channel").agg(*stats)
    if max_rows <= ordering.COLLECT_ROWS:
        number = F.array_position(F.array(*[F.lit(c) for c in channels]), F.col("channel")).cast("int")
        out = out.join(ordering.quantile_cells(df, keys, channels, probs, ["frame_idx"]), keys)
        out = out.withColumn("_q", F.element_at("_q", number)).select("*", "_q.*").drop("_q")
    else:
        out = out.join(ordering.wide_quantiles(df, keys, channels, probs, max_rows), [*keys, "channel"])
    var = F.when(F.col("max") == F.col("min"), 0.0).otherwise(F.col("_m2"))
    out = out.withColumn("variance", var).withColumn("std", F.sqrt("variance"))
    return out.select(
        *keys,
        "channel",
        *[
            {
                "range": F.col("max") - F.col("min"),
                "kurtosis": F.try_divide(F.col("_m4"), F.col("variance") ** 2) - 3.0,
                "skewness": F.try_divide(F.col("_m3"), F.col("variance") * F.col("std")),
                "iqr": F.col("percentile_75") - F.col("percentile_25"),
                "zero_crossing_rate": F.col("crossings") / F.col("n"),
            }.get(f, F.col(f)).alias(f)
            for f in TIME_DOMAIN
        ],
    )


def to_long(df: DataFrame, ids: list[str], features: list[str]) -> DataFrame:
    """Feature columns to rows (ids, feature, value)."""
    return df.select(*ids, *[F.col(f).cast("double").alias(f) for f in features]).unpivot(
        ids, features, "feature", "value"
    )


def group_zscores(long: DataFrame, by: list[str]) -> DataFrame:
    """Z-score per feature within ``by``; NaN/NULL ignored, std <= 1e-12 gives 0.

    An aggregate joined back instead of a window, so one large group combines map-side.
    """
    v = F.when(F.isnan("value"), None).otherwise(F.col("value"))
    x = long.withColumn("value", v)
    stats = x.groupBy(*by, "feature").agg(F.avg("value").alias("_m"), F.stddev_pop("value").alias("_s"))
    z = F.when(F.col("_s") <= 1e-12, 0.0).otherwise(F.try_divide(F.col("value") - F.col("_m"), F.col("_s")))
    return x.join(stats, [*by, "feature"]).withColumn("z", F.when(F.col("value").isNotNull(), z)).drop("_m", "_s")


def wide_zscores(df: DataFrame, by: list[str], features: list[str], max_rows: int | None = None) -> DataFrame:
    """The same z-scores on a wide feature table: one pass while a group fits a window."""
    clean = {f: F.when(~F.isnan(f), F.col(f)) for f in features}
    x = df.withColumns(clean)
    aggs = {f"{f}__m": F.avg(f) for f in features} | {f"{f}__s": F.stddev_pop(f) for f in features}
    x = ordering.attach(x, by, aggs, max_rows)
    z = {
        f: F.when(F.col(f).isNotNull(), F.when(F.col(f"{f}__s") <= 1e-12, 0.0).otherwise(
            F.try_divide(F.col(f) - F.col(f"{f}__m"), F.col(f"{f}__s"))))
        for f in features
    }
    return x.withColumns(z).drop(*aggs)


def speed(axes: list[str], rate: float, prefix: str = "__p") -> Column:
    """Norm of the frame-to-frame position step times the rate."""
    return norm(*[F.col(a) - F.col(f"{a}{prefix}") for a in axes]) * F.lit(rate)


# ---------------------------------------------------------------- derived signals

PLANES = ["roll", "pitch", "yaw"]


def axes(sensor: str, kind: str) -> list[str]:
    """Channel names of one sensor: kind is 'pos' or 'rot'."""
    return [f"{SENSORS[sensor]}_{kind}_{a}" for a in "xyz"]


def sensor_split(df: DataFrame, keys: list[str] = RECORDING) -> DataFrame:
    """One row per frame and sensor with pos and rot structs (18 wide channels -> 3 x 6)."""
    rows = [
        F.struct(
            F.lit(s).alias("sensor"),
            *[F.col(c).alias(c[-5:]) for c in axes(s, "pos") + axes(s, "rot")],
        )
        for s in SENSORS
    ]
    return df.select(*keys, "frame_idx", F.inline(F.array(*rows)))


def derived_signals(df: DataFrame, keys: list[str] = RECORDING, rate: float = SAMPLING_RATE) -> DataFrame:
    """Speed and position magnitude per sensor and the head step; the first step repeats the second."""
    pos = [c for s in SENSORS for c in axes(s, "pos")]
    shifts = {f"{c}__p": (c, -1) for c in pos} | {f"{c}__n": (c, 1) for c in pos}
    x = ordering.neighbours(df.select(*keys, "frame_idx", *pos), keys, shifts)

    def step(s: str) -> Column:
        back = norm(*[F.col(c) - F.col(f"{c}__p") for c in axes(s, "pos")])
        ahead = norm(*[F.col(f"{c}__n") - F.col(c) for c in axes(s, "pos")])
        return F.coalesce(back, ahead)

    cols = [(step(s) * rate).alias(f"{s}_speed") for s in SENSORS]
    cols += [norm(*axes(s, "pos")).alias(f"{s}_mag") for s in SENSORS]
    return x.select(*keys, "frame_idx", *cols, step("Head").alias("head_step"))


# ---------------------------------------------------------------- movement quality and timing


def jerk(df: DataFrame, signals: list[str], keys: list[str] = RECORDING, dt: float = 1 / SAMPLING_RATE) -> DataFrame:
    """rms jerk and rms * duration^3 / peak^2 of speed signals, one row per (sample, channel)."""
    x = ordering.neighbours(df, keys, {f"{c}__p": (c, -1) for c in signals})
    long = stacked(x, keys, signals, {"prev": "__p"})
    j = (F.col("value") - F.col("prev")) / F.lit(dt)
    out = long.groupBy(*keys, "channel").agg(
        F.sqrt(F.avg(j * j)).alias("jerk_rms"),
        F.max(F.abs("value")).alias("_peak"),
        (F.count(F.lit(1)) * F.lit(dt)).alias("_dur"),
    )
    scaled = F.col("jerk_rms") * F.pow("_dur", F.lit(3.0))
    metric = F.when(F.col("_peak") > 0, F.try_divide(scaled, F.col("_peak") * F.col("_peak"))).otherwise(0.0)
    return out.select(*keys, "channel", metric.alias("jerk_metric"), "jerk_rms")


def activity_span(df: DataFrame, signal: str, keys: list[str] = RECORDING, rate: float = SAMPLING_RATE) -> DataFrame:
    """Duration and onset/offset/active span of frames above mean + 2 std (0 when none)."""
    x = df.select(*keys, "frame_idx", signal)
    x = ordering.attach(
        x, keys, {"_n": F.count(F.lit(1)), "_m": F.avg(signal), "_s": F.stddev_pop(signal)}
    ).withColumn("_thr", F.col("_m") + 2.0 * F.col("_s"))
    above = F.when(F.col(signal) > F.col("_thr"), F.col("frame_idx"))
    on, off = F.min(above), F.max(above)
    return x.groupBy(*keys).agg(
        (F.first("_n") / F.lit(rate)).alias("duration"),
        F.coalesce(on / F.lit(rate), F.lit(0.0)).alias("movement_onset_time"),
        F.coalesce(off / F.lit(rate), F.lit(0.0)).alias("movement_offset_time"),
        F.coalesce((off - on) / F.lit(rate), F.lit(0.0)).alias("active_movement_duration"),
    )


# ---------------------------------------------------------------- asymmetry


def asymmetry(df: DataFrame, left: str = "LeftHand", right: str = "RightHand", keys: list[str] = RECORDING):
    """Bilateral asymmetry of two sensors (the cross-correlation peak is in ``spectral``)."""
    lc, rc = axes(left, "pos") + axes(left, "rot"), axes(right, "pos") + axes(right, "rot")
    ml, mr = F.avg(norm(*lc)), F.avg(norm(*rc))
    return df.groupBy(*keys).agg(
        (ml / (mr + 1e-10)).alias("lr_ratio"),
        ((ml - mr) / (ml + mr + 1e-10)).alias("symmetry_index"),
        *[corr(F.col(a), F.col(b)).alias(f"lr_correlation_axis{i}") for i, (a, b) in enumerate(zip(lc, rc))],
        (F.avg(lc[2]) - F.avg(rc[2])).alias("vertical_asymmetry"),
    )


def position_asymmetry(df: DataFrame, left: str = "LeftHand", right: str = "RightHand", keys: list[str] = RECORDING):
    """Per-axis differences, hand separation and path lengths."""
    lc, rc = axes(left, "pos"), axes(right, "pos")
    x = ordering.neighbours(df, keys, {f"{c}__p": (c, -1) for c in lc + rc})
    rng = lambda c: F.max(c) - F.min(c)
    sep = norm(*[F.col(a) - F.col(b) for a, b in zip(lc, rc)])
    path = lambda cs: F.coalesce(F.sum(norm(*[F.col(c) - F.col(f"{c}__p") for c in cs])), F.lit(0.0))
    aggs = []
    for a, l, r in zip("xyz", lc, rc):
        aggs += [
            (F.avg(l) - F.avg(r)).alias(f"mean_pos_diff_{a}"),
            F.stddev_pop(F.col(l) - F.col(r)).alias(f"std_pos_diff_{a}"),
            (rng(l) - rng(r)).alias(f"rom_asymmetry_{a}"),
            (rng(l) / (rng(r) + 1e-10)).alias(f"rom_ratio_{a}"),
        ]
    return x.groupBy(*keys).agg(
        *aggs,
        F.avg(sep).alias("mean_hand_separation"),
        F.stddev_pop(sep).alias("std_hand_separation"),
        F.min(sep).alias("min_hand_separation"),
        F.max(sep).alias("max_hand_separation"),
        (path(lc) / (path(rc) + 1e-10)).alias("path_length_ratio"),
        (path(lc) - path(rc)).alias("path_length_asymmetry"),
    )


def rotation_asymmetry(df: DataFrame, left: str = "LeftHand", right: str = "RightHand", keys: list[str] = RECORDING):
    lc, rc = axes(left, "rot"), axes(right, "rot")
    rng = lambda c: F.max(c) - F.min(c)
    aggs = []
    for p, l, r in zip(PLANES, lc, rc):
        aggs += [
            (F.avg(l) - F.avg(r)).alias(f"mean_rot_diff_{p}"),
            F.stddev_pop(F.col(l) - F.col(r)).alias(f"std_rot_diff_{p}"),
            (rng(l) - rng(r)).alias(f"rot_rom_asymmetry_{p}"),
        ]
    return df.groupBy(*keys).agg(
        *aggs, (F.avg(norm(*lc)) - F.avg(norm(*rc))).alias("rotation_magnitude_asymmetry")
    )


# ---------------------------------------------------------------- kinematics


def range_of_motion(df: DataFrame, keys: list[str] = RECORDING) -> DataFrame:
    """rom/mean/max/min/std for three sensors x three planes."""
    aggs = []
    for s in SENSORS:
        for p, c in zip(PLANES, axes(s, "rot")):
            aggs += [
                (F.max(c) - F.min(c)).alias(f"{s}_{p}_rom"),
                F.avg(c).alias(f"{s}_{p}_mean"),
                F.max(c).alias(f"{s}_{p}_max"),
                F.min(c).alias(f"{s}_{p}_min"),
                F.stddev_pop(c).alias(f"{s}_{p}_std"),
            ]
    return df.groupBy(*keys).agg(*aggs)


def gradient(
    df: DataFrame, cols: dict[str, str], keys: list[str] = RECORDING, dt: float = 1 / SAMPLING_RATE
) -> DataFrame:
    """Central differences with one-sided ends: ``{'velocity': 'angle'}``."""
    shifts = {f"{o}__p": (c, -1) for o, c in cols.items()} | {f"{o}__n": (c, 1) for o, c in cols.items()}
    x = ordering.neighbours(df, keys, shifts)
    made = {}
    for o, c in cols.items():
        p, n, v = F.col(f"{o}__p"), F.col(f"{o}__n"), F.col(c)
        made[o] = F.coalesce((n - p) / F.lit(2 * dt), (n - v) / F.lit(dt), (v - p) / F.lit(dt))
    return x.withColumns(made).drop(*shifts)


def rotation_kinematics(df: DataFrame, sensor: str, keys: list[str] = RECORDING) -> DataFrame:
    """Range of motion, angular velocity and acceleration per plane, and the rotation magnitude."""
    rot = axes(sensor, "rot")
    x = df.select(*keys, "frame_idx", *rot)
    x = gradient(x, {f"v_{p}": c for p, c in zip(PLANES, rot)}, keys)
    x = gradient(x, {f"a_{p}": f"v_{p}" for p in PLANES}, keys)
    aggs = []
    for p, c in zip(PLANES, rot):
        v, a = F.col(f"v_{p}"), F.col(f"a_{p}")
        aggs += [
            (F.max(c) - F.min(c)).alias(f"{p}_rom"),
            F.max(c).alias(f"{p}_max_angle"),
            F.min(c).alias(f"{p}_min_angle"),
            F.avg(c).alias(f"{p}_mean_angle"),
            F.stddev_pop(c).alias(f"{p}_std_angle"),
            F.max(F.abs(v)).alias(f"{p}_peak_angular_velocity"),
            F.avg(F.abs(v)).alias(f"{p}_mean_angular_velocity"),
            F.stddev_pop(v).alias(f"{p}_std_angular_velocity"),
            F.max(F.abs(a)).alias(f"{p}_peak_angular_acceleration"),
            F.avg(F.abs(a)).alias(f"{p}_mean_angular_acceleration"),
        ]
    m = norm(*rot)
    return x.groupBy(*keys).agg(
        *aggs,
        F.avg(m).alias("rotation_magnitude_mean"),
        F.stddev_pop(m).alias("rotation_magnitude_std"),
        F.max(m).alias("rotation_magnitude_max"),
    )


def functional_angles(pairs: dict[str, tuple[str, str]] = FUNCTIONAL_PAIRS) -> dict[str, Column]:
    """Elevation, azimuth (degrees), distance and z-rotation difference per sensor pair."""
    out = {}
    for name, (ref, target) in pairs.items():
        dx, dy, dz = (F.col(t) - F.col(r) for r, t in zip(axes(ref, "pos"), axes(target, "pos")))
        out[f"{name}_elevation"] = F.degrees(F.atan2(dz, norm(dx, dy)))
        out[f"{name}_azimuth"] = F.degrees(F.atan2(dy, dx))
        out[f"{name}_distance"] = norm(dx, dy, dz)
        out[f"{name}_orientation"] = F.col(axes(target, "rot")[2]) - F.col(axes(ref, "rot")[2])
    return out


def anatomical_angles(
    position: dict[str, list[str]], rotation_z: dict[str, str], pairs: dict[str, tuple[str, str]] = ANATOMICAL_PAIRS
) -> dict[str, Column]:
    """Flexion, abduction and rotation per joint of the eight-sensor layout."""
    out = {}
    for name, (near, far) in pairs.items():
        dx, dy, dz = (F.col(b) - F.col(a) for a, b in zip(position[near], position[far]))
        out[f"{name}_flexion"] = F.degrees(F.atan2(dz, dy))
        out[f"{name}_abduction"] = F.degrees(F.atan2(dx, dz))
        out[f"{name}_rotation"] = F.col(rotation_z[far]) - F.col(rotation_z[near])
    return out


def derivatives(df: DataFrame, channels: list[str], keys: list[str] = RECORDING, rate: float = SAMPLING_RATE):
    """Velocity (NULL on the first frame) and acceleration (NULL on the first two)."""
    x = ordering.neighbours(
        df, keys, {f"{c}__1": (c, -1) for c in channels} | {f"{c}__2": (c, -2) for c in channels}
    )
    made = {}
    for c in channels:
        p, q, v = F.col(f"{c}__1"), F.col(f"{c}__2"), F.col(c)
        made[f"{c}_vel"] = (v - p) * rate
        made[f"{c}_acc"] = ((v - p) - (p - q)) * rate * rate
    return x.withColumns(made).drop(*[f"{c}__{k}" for c in channels for k in (1, 2)])


def biomechanics(df: DataFrame, keys: list[str] = RECORDING, rate: float = SAMPLING_RATE) -> DataFrame:
    """Angle ranges, sensor speeds, angle steps and trial duration."""
    angles = functional_angles()
    pos = [c for s in SENSORS for c in axes(s, "pos")]
    x = df.select(*keys, "frame_idx", *pos, *[e.alias(n) for n, e in angles.items()])
    x = ordering.neighbours(x, keys, {f"{c}__p": (c, -1) for c in [*pos, *angles]})
    aggs = []
    for a in angles:
        d = F.abs(F.col(a) - F.col(f"{a}__p"))
        aggs += [
            (F.max(a) - F.min(a)).alias(f"{a}_rom"),
            F.avg(a).alias(f"{a}_mean"),
            F.stddev_pop(a).alias(f"{a}_std"),
            F.max(a).alias(f"{a}_max"),
            F.min(a).alias(f"{a}_min"),
            F.avg(d).alias(f"{a}_mean_ang_vel"),
            F.max(d).alias(f"{a}_max_ang_vel"),
        ]
    for s in SENSORS:
        v = speed(axes(s, "pos"), rate)
        aggs += [F.max(v).alias(f"{s}_peak_vel"), F.avg(v).alias(f"{s}_mean_vel")]
    return x.groupBy(*keys).agg(*aggs, ((F.max("frame_idx") - F.min("frame_idx")) / F.lit(rate)).alias("trial_duration"))


# ---------------------------------------------------------------- assembly and summaries


def combined(parts: list[DataFrame], ids: list[str] = RECORDING, prefix: str = "ext_") -> DataFrame:
    """Union of long feature frames under one prefix; a name must come from one module only."""
    return reduce(DataFrame.unionByName, parts).withColumn("feature", F.concat(F.lit(prefix), "feature"))


def wide_to_long(df: DataFrame, ids: list[str] = RECORDING, prefix: str = "") -> DataFrame:
    """Every non-id column becomes (feature, value); a ``channel`` column prefixes the name."""
    by_channel = "channel" in df.columns
    keep = [*ids, "channel"] if by_channel else ids
    long = to_long(df, keep, [c for c in df.columns if c not in keep])
    name = F.concat_ws("_", "channel", "feature") if by_channel else F.col("feature")
    return long.select(*ids, F.concat(F.lit(prefix), name).alias("feature"), "value")


def pivot_features(long: DataFrame, names: list[str], ids: list[str] = RECORDING) -> DataFrame:
    """Wide table for the sink: id columns, then the features in sorted order."""
    names = sorted(names)
    return long.groupBy(*ids).pivot("feature", names).agg(F.first("value")).select(*ids, *[F.col(f"`{n}`") for n in names])


def composite_metrics(wide: DataFrame, ids: list[str] = RECORDING) -> DataFrame:
    """Twelve composite metrics from the wide feature row; absent inputs count as 0.

    Where ``left_out`` names a module that failed (not one without a value), all metrics of the recording are NULL.
    """
    have = set(wide.columns)
    failed = F.exists(F.map_values("left_out"), lambda r: r != NO_VALUE) if "left_out" in have else F.lit(False)
    known = F.when(F.coalesce(failed, F.lit(False)), None).otherwise(F.lit(0.0))
    g = lambda n: F.coalesce(F.col(n), F.lit(0.0)) + known if n in have else known
    jerk_col = "RightHand_jerk_metric" if "RightHand_jerk_metric" in have else "LeftHand_jerk_metric"
    out = wide.select(
        *ids,
        F.greatest(g("LeftHand_peak_vel"), g("RightHand_peak_vel")).alias("max_speed"),
        ((g("LeftHand_mean_vel") + g("RightHand_mean_vel")) / 2.0).alias("mean_speed"),
        g("H_PosZ_max").alias("max_acceleration"),
        g(jerk_col).alias("mean_jerk"),
        g("duration").alias("_dur"),
        F.greatest(g("left_reach_elevation_rom"), g("right_reach_elevation_rom")).alias("rom_total"),
        g("movement_onset_time").alias("time_to_peak_speed"),
        g("num_peaks").alias("number_of_movement_units"),
    )
    return out.withColumns(
        {
            "peak_speed_ratio": F.col("max_speed") / (F.col("mean_speed") + 1e-10),
            "normalized_jerk": F.col("mean_jerk"),
            "total_path_length": F.col("_dur") * F.col("mean_speed"),
            "path_efficiency": 1.0 / (1.0 + F.col("mean_jerk") + 1e-10),
            "movement_efficiency": 1.0 / (1.0 + F.col("mean_jerk") + 1e-10),
        }
    ).drop("_dur")


def module_tag(name: Column | str) -> Column:
    """Feature name to module family."""
    n = F.regexp_replace(name, "ext_", "")
    sensor = n.rlike("^(" + "|".join(SENSORS) + ")_")
    return (
        F.when(n.startswith("hand_"), "asymmetry")
        .when(n.startswith("head_"), "wavelet/joint")
        .when(sensor & (n.contains("entropy") | n.contains("sample")), "complexity")
        .when(sensor & (n.contains("freq") | n.contains("dominant")), "frequency")
        .when(sensor & (n.contains("sparc") | n.contains("jerk")), "movement_quality")
        .when(sensor, "biomechanical/joint")
        .when(n.rlike("^[HLR]_(Pos|Rot)[XYZ]_"), "time_domain")
        .otherwise("temporal/other")
    )


def group_summary(long: DataFrame, by: list[str] = ("feature", "grp"), rows_per_bucket: int = ordering.VALUE_MAP):
    """mean, sample std, min, median, max, n per feature and group.

    The values are stored first: exact quantiles of large groups read them several times.
    """
    v = F.col("value")
    return ordering.quantiles(
        stored(long.filter(~F.isnan(v)).select(*by, "value"), "features"),
        list(by),
        "value",
        {"median": 0.5},
        [
            F.avg(v).alias("mean"),
            F.stddev_samp(v).alias("std"),
            F.min(v).alias("min"),
            F.max(v).alias("max"),
            F.count(v).alias("n"),
        ],
        rows_per_bucket,
    )


def cohens_d(long: DataFrame, case: str, control: str, by: list[str] = ("feature",)) -> DataFrame:
    """Effect size with pooled sqrt((s1^2 + s0^2) / 2 + 1e-10), sample std."""
    a, b = (F.when((F.col("grp") == g) & ~F.isnan("value"), F.col("value")) for g in (case, control))
    out = long.groupBy(*by).agg(
        F.avg(a).alias("mean_case"),
        F.stddev_samp(a).alias("std_case"),
        F.avg(b).alias("mean_control"),
        F.stddev_samp(b).alias("std_control"),
    )
    pooled = F.sqrt((F.pow("std_case", F.lit(2.0)) + F.pow("std_control", F.lit(2.0))) / 2.0 + 1e-10)
    diff = F.col("mean_case") - F.col("mean_control")
    out = out.withColumns({"difference": diff, "cohens_d": diff / pooled})
    return out.withColumn("module", module_tag("feature")) if "feature" in by else out


def score_sheet(rows: DataFrame, task_scores: dict[int, str]) -> DataFrame:
    """Distinct subjects with one score column per task."""
    return rows.groupBy("subject_id").agg(
        *[F.max(F.when(F.col("task") == t, F.col("task_score"))).alias(n) for t, n in task_scores.items()]
    )


def zscore_flag(z: Column | str = "z", limit: float = 1.5, near: float = 0.25) -> Column:
    z = F.col(z) if isinstance(z, str) else z
    return F.when(z > limit, "high").when(z < -limit, "low").when(F.abs(z) < near, "near_mean")


def box_statistics(long: DataFrame, by: list[str]) -> DataFrame:
    """Quartiles, whisker ends (furthest point within 1.5 IQR) and outlier count per group."""
    q = ordering.quantiles(long, by, "value", {"q1": 0.25, "median": 0.5, "q3": 0.75})
    iqr = F.col("q3") - F.col("q1")
    inside = F.col("value").between(F.col("q1") - 1.5 * iqr, F.col("q3") + 1.5 * iqr)
    ends = long.join(q, by).groupBy(*by).agg(
        F.min(F.when(inside, F.col("value"))).alias("whisker_low"),
        F.max(F.when(inside, F.col("value"))).alias("whisker_high"),
        F.sum((~inside).cast("long")).alias("n_outliers"),
    )
    return q.join(ends, by)


def histogram(df: DataFrame, value: str, bins: int, by: list[str] = (), lo: float = None, hi: float = None):
    """Equal-width counts; the range is measured unless given, the last bin is closed."""
    if lo is None:
        edges = df.agg(F.min(value).alias("_lo"), F.max(value).alias("_hi"))
        df = df.crossJoin(F.broadcast(edges))  # exactly one row
    else:
        df = df.withColumns({"_lo": F.lit(float(lo)), "_hi": F.lit(float(hi))})
    raw = F.floor(F.try_divide((F.col(value) - F.col("_lo")) * bins, F.col("_hi") - F.col("_lo")))
    b = F.greatest(F.least(F.coalesce(raw, F.lit(0)), F.lit(bins - 1)), F.lit(0)).cast("int")
    inside = F.col(value).between(F.col("_lo"), F.col("_hi"))
    return df.filter(inside).withColumn("bin", b).groupBy(*by, "bin").agg(F.count(F.lit(1)).alias("n"))
