"""Sequence reshaping, scaling and resampling of recordings as column expressions.

Frames carry ``frame_idx`` per sample key; every operator keeps that contract. Sample lengths are a
(partial) aggregate joined back, so no operator needs a whole recording in one task.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinelake.config import RECORDING
from kinelake.functions.expr import normal_hash, unit_hash
from kinelake.operators import ordering


def lengths(df: DataFrame, keys: list[str] = RECORDING) -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_frames"))


def with_length(df: DataFrame, keys: list[str] = RECORDING) -> DataFrame:
    """Every frame with its sample's frame count."""
    return ordering.attach(df, keys, {"n_frames": F.count(F.lit(1))})


def scaler(df: DataFrame, channels: list[str], by: list[str] = ()) -> DataFrame:
    """Population mean/std per channel over all frames (one row per ``by``)."""
    aggs = [a for c in channels for a in (F.avg(c).alias(f"{c}__m"), F.stddev_pop(c).alias(f"{c}__s"))]
    return df.groupBy(*by).agg(*aggs) if by else df.agg(*aggs)


def apply_scaler(df: DataFrame, stats: DataFrame, channels: list[str], on: list[str] = ()) -> DataFrame:
    """Z-score with a scaler table; a zero std divides by 1. A global scaler is exactly one row."""
    joined = df.join(stats, list(on)) if on else df.crossJoin(F.broadcast(stats))
    scaled = {
        c: (F.col(c) - F.col(f"{c}__m")) / F.when(F.col(f"{c}__s") == 0, 1.0).otherwise(F.col(f"{c}__s"))
        for c in channels
    }
    return joined.withColumns(scaled).drop(*[f"{c}__{k}" for c in channels for k in "ms"])


def standardize(df: DataFrame, channels: list[str], by: list[str] = ()) -> DataFrame:
    """Per-channel z-score over all frames of all samples (or within ``by``)."""
    return apply_scaler(df, scaler(df, channels, by), channels, by)


def truncate(df: DataFrame, keys: list[str] = RECORDING, length: int | None = None) -> DataFrame:
    """Keep the last T_min frames of every sample (T_min = shortest sample unless given)."""
    keep = F.lit(length) if length is not None else F.col("t_min")
    out = with_length(df, keys)
    if length is None:
        out = out.crossJoin(F.broadcast(lengths(df, keys).agg(F.min("n_frames").alias("t_min"))))
    start = F.greatest(F.col("n_frames") - keep, F.lit(0))
    out = out.filter(F.col("frame_idx") >= start).withColumn("frame_idx", F.col("frame_idx") - start)
    return out.drop("n_frames", "t_min")


def pad(
    df: DataFrame,
    channels: list[str],
    keys: list[str] = RECORDING,
    value: float = 0.0,
    length: int | None = None,
    front: bool = False,
) -> DataFrame:
    """Extend every sample to T_max frames; pad rows are generated from the length table only."""
    extra = [c for c in df.columns if c not in channels and c not in keys and c != "frame_idx"]
    lens = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_frames"), *[F.first(c).alias(c) for c in extra])
    if length is None:
        lens = lens.crossJoin(F.broadcast(lens.agg(F.max("n_frames").alias("t_max"))))
    else:
        lens = lens.withColumn("t_max", F.lit(length).cast("long"))
    short = lens.filter(F.col("n_frames") < F.col("t_max"))
    if front:
        idx = F.explode(F.sequence(F.lit(0).cast("long"), F.col("t_max") - F.col("n_frames") - 1))
        shift = short.select(*keys, (F.col("t_max") - F.col("n_frames")).alias("shift"))
        df = df.join(shift, keys, "left").withColumn(
            "frame_idx", F.col("frame_idx") + F.coalesce("shift", F.lit(0))
        ).drop("shift")
    else:
        idx = F.explode(F.sequence(F.col("n_frames"), F.col("t_max") - 1))
    rows = short.select(*keys, *extra, idx.alias("frame_idx")).withColumns(
        {c: F.lit(float(value)) for c in channels}
    )
    return df.unionByName(rows.select(*df.columns))


def sliding_windows(
    df: DataFrame, size: int, overlap: float = 0.5, keys: list[str] = RECORDING
) -> DataFrame:
    """Only full windows; each frame is emitted once per window that contains it (``window_no``)."""
    stride = int(size * (1 - overlap))
    if stride < 1:
        raise ValueError("overlap leaves no stride")
    out = with_length(df, keys).filter(F.col("n_frames") >= size)
    idx = F.col("frame_idx")
    first = F.greatest(F.ceil((idx - (size - 1)) / F.lit(float(stride))), F.lit(0)).cast("long")
    last = F.least(
        F.floor(idx / F.lit(float(stride))), F.floor((F.col("n_frames") - size) / F.lit(float(stride)))
    ).cast("long")
    out = out.withColumns({"_f": first, "_l": last}).filter("_f <= _l")
    out = out.withColumn("window_no", F.explode(F.sequence("_f", "_l")))
    return out.withColumn("frame_idx", idx - F.col("window_no") * stride).drop("_f", "_l", "n_frames")


def length_summary(df: DataFrame, keys: list[str] = RECORDING, by: list[str] = (), rate: float = 50.0) -> DataFrame:
    """Series count, min/max/mean length and total duration."""
    lens = lengths(df, [*keys, *[b for b in by if b not in keys]])
    return lens.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n_series"),
        F.min("n_frames").alias("min_frames"),
        F.max("n_frames").alias("max_frames"),
        F.avg("n_frames").alias("mean_frames"),
        (F.sum("n_frames") / F.lit(rate)).alias("total_seconds"),
    )


def interpolate_linear(df: DataFrame, channels: list[str], length: int, keys: list[str] = RECORDING) -> DataFrame:
    """Resample to ``length`` points on [0, 1]: frame i emits the outputs between i and i + 1."""
    nxt = ordering.neighbours(df, keys, {f"{c}__n": (c, 1) for c in channels})
    out = ordering.attach(nxt, keys, {"n_frames": F.count(F.lit(1))}, ordering.largest_group(df, keys))
    gap, steps, i = F.col("n_frames") - 1, length - 1, F.col("frame_idx")
    div = lambda a: F.when(gap > 0, F.expr(f"({a} + n_frames - 2) div greatest(n_frames - 1, 1)"))
    lo = F.coalesce(div(f"frame_idx * {steps}L"), F.lit(0)).cast("long")
    hi = F.when(i == gap, F.lit(steps)).otherwise(div(f"(frame_idx + 1) * {steps}L") - 1).cast("long")
    out = out.withColumns({"_lo": lo, "_hi": hi}).filter("_lo <= _hi")
    out = out.withColumn("_j", F.explode(F.sequence("_lo", "_hi")))
    frac = F.col("_j") * gap / F.lit(float(max(steps, 1))) - i
    cols = {c: F.when(i == gap, F.col(c)).otherwise(F.col(c) + (F.col(f"{c}__n") - F.col(c)) * frac) for c in channels}
    out = out.withColumns(cols).withColumn("frame_idx", F.col("_j"))
    return out.drop("_lo", "_hi", "_j", "n_frames", *[f"{c}__n" for c in channels])


def phase_shift(df: DataFrame, fraction: float, keys: list[str] = RECORDING) -> DataFrame:
    """Roll each sample forward by round-half-even(fraction * T)."""
    fraction = min(max(fraction, 0.0), 0.999)
    out = with_length(df, keys)
    n = F.bround(F.lit(fraction) * F.col("n_frames")).cast("long")
    return out.withColumn("frame_idx", F.pmod(F.col("frame_idx") + n, F.col("n_frames"))).drop("n_frames")


def fold_scalers(
    df: DataFrame, channels: list[str], keys: list[str] = RECORDING, subject: str = "subject_id", trim: bool = True
) -> DataFrame:
    """Leave-one-subject-out scalers: one row per held-out subject, in one pass over the frames.

    Training sums are (total - held-out). With ``trim`` every fold truncates to its own shortest
    training sample; leaving one subject out can only yield two different minima, so sums are kept
    for both lengths.
    """
    lens = lengths(df, keys)
    per_subject = lens.groupBy(subject).agg(F.min("n_frames").alias("own_min"))
    # The two smallest per-subject minima are enough to know any leave-one-out minimum.
    two = per_subject.agg(
        F.min(F.struct("own_min", subject)).alias("a"),
        F.min(F.col("own_min")).alias("lo"),
    )
    second = per_subject.crossJoin(F.broadcast(two)).filter(F.col(subject) != F.col("a")[subject])
    minima = two.crossJoin(second.agg(F.min("own_min").alias("lo2"))).select(
        F.col("a")[subject].alias("_argmin"), "lo", "lo2"
    )
    centre = df.agg(*[F.avg(c).alias(f"{c}__c") for c in channels])
    x = with_length(df, keys).crossJoin(F.broadcast(minima)).crossJoin(F.broadcast(centre))
    sums = []
    for tag, cut in (("1", "lo"), ("2", "lo2")):
        inside = F.col("frame_idx") >= F.col("n_frames") - F.col(cut) if trim else F.lit(True)
        sums.append(F.sum(F.when(inside, 1.0).otherwise(0.0)).alias(f"n{tag}"))
        for c in channels:
            d = F.when(inside, F.col(c) - F.col(f"{c}__c"))
            sums += [F.sum(d).alias(f"{c}__t{tag}"), F.sum(d * d).alias(f"{c}__q{tag}")]
    held = x.groupBy(subject).agg(*sums)
    total = held.agg(*[F.sum(n).alias(f"all_{n}") for n in held.columns if n != subject])
    out = held.crossJoin(F.broadcast(total)).crossJoin(F.broadcast(minima)).crossJoin(F.broadcast(centre))
    own = F.col(subject) == F.col("_argmin")

    def left(name: str):
        rest = [F.col(f"all_{name}{t}") - F.coalesce(F.col(f"{name}{t}"), F.lit(0.0)) for t in "12"]
        return F.when(own, rest[1]).otherwise(rest[0])

    cols = [F.col(subject).alias("fold"), F.when(own, F.col("lo2")).otherwise(F.col("lo")).alias("t_min")]
    for c in channels:
        m = F.try_divide(left(f"{c}__t"), left("n"))
        var = F.try_divide(left(f"{c}__q"), left("n")) - m * m
        cols += [
            (F.col(f"{c}__c") + m).alias(f"{c}__m"),
            F.sqrt(F.when(var < 1e-18, 0.0).otherwise(var)).alias(f"{c}__s"),
        ]
    return out.select(*cols)


def scale_held_out(
    df: DataFrame,
    scalers: DataFrame,
    channels: list[str],
    keys: list[str] = RECORDING,
    subject: str = "subject_id",
    trim: bool = True,
) -> DataFrame:
    """Test rows of every fold under that fold's training scaler.

    With ``trim`` a longer sample keeps its last t_min frames; a shorter one is zero-padded in front.
    """
    s = scalers.withColumnRenamed("fold", subject)
    if not trim:
        return apply_scaler(df, s.drop("t_min"), channels, [subject])
    x = with_length(df, keys).join(s, subject)
    start = F.col("n_frames") - F.col("t_min")
    x = x.filter(F.col("frame_idx") >= start).withColumn("frame_idx", F.col("frame_idx") - start)
    first = x.filter((F.col("frame_idx") == -start) & (start < 0))
    zeros = first.withColumn("frame_idx", F.explode(F.sequence(F.lit(0).cast("long"), -start - 1)))
    zeros = zeros.withColumns({c: F.lit(0.0) for c in channels})
    x = x.unionByName(zeros)
    cols = {
        c: (F.col(c) - F.col(f"{c}__m")) / F.when(F.col(f"{c}__s") == 0, 1.0).otherwise(F.col(f"{c}__s"))
        for c in channels
    }
    return x.withColumns(cols).drop("n_frames", "t_min", *[f"{c}__{k}" for c in channels for k in "ms"])


def fold_rows(
    df: DataFrame, scalers: DataFrame, fold, channels: list[str], held_out: bool = False, keys: list[str] = RECORDING, subject: str = "subject_id", trim: bool = True
) -> DataFrame:
    """Training (or held-out) rows of one fold under its scaler.

    ``scalers`` has one row for each fold, which is all that is kept of the folds: a fold's rows are scaled while they are
    read. With ``trim`` every sample keeps its last t_min frames; a shorter held-out one is padded with zeros in front.
    A fold that ``scalers`` does not have gives no rows.
    """
    own = scalers.filter(F.col("fold") == fold)
    if held_out:
        return scale_held_out(df.filter(F.col(subject) == fold), own, channels, keys, subject, trim)
    rows = df.filter(F.col(subject) != fold)
    if not trim:
        return apply_scaler(rows, own.drop("fold", "t_min"), channels)
    rows = with_length(rows, keys).crossJoin(F.broadcast(own.select("t_min")))  # at most one row
    start = F.col("n_frames") - F.col("t_min")
    rows = rows.filter(F.col("frame_idx") >= start).withColumn("frame_idx", F.col("frame_idx") - start).drop("n_frames", "t_min")
    return apply_scaler(rows, own.drop("fold", "t_min"), channels)


def jitter(df: DataFrame, channels: list[str], keys: list[str] = RECORDING, sigma: float = 0.01, seed: int = 42):
    """Add Gaussian noise drawn from a hash of (sample, frame, channel, seed)."""
    return df.withColumns(
        {c: F.col(c) + sigma * normal_hash(*keys, "frame_idx", F.lit(c), seed=seed) for c in channels}
    )


def random_slice(df: DataFrame, min_length: int, keys: list[str] = RECORDING, seed: int = 42) -> DataFrame:
    """A random contiguous slice of at least ``min_length`` frames per sample, re-indexed from 0."""
    lens = lengths(df, keys)
    span = F.when(
        F.col("n_frames") > min_length,
        min_length + F.floor(unit_hash(*keys, seed=seed) * (F.col("n_frames") - min_length + 1)),
    ).otherwise(F.col("n_frames"))
    lens = lens.withColumn("_span", span)
    start = F.floor(unit_hash(*keys, seed=seed + 1) * (F.col("n_frames") - F.col("_span") + 1))
    lens = lens.withColumn("_start", start).drop("n_frames")
    out = df.join(lens, keys).filter("frame_idx >= _start AND frame_idx < _start + _span")
    return out.withColumn("frame_idx", F.col("frame_idx") - F.col("_start")).drop("_start", "_span")


def window_statistics(df: DataFrame, channels: list[str], size: int, keys: list[str] = RECORDING) -> DataFrame:
    """Mean, population std, slope, max, min per non-overlapping window (a short last one counts)."""
    long = df.unpivot([*keys, "frame_idx"], channels, "channel", "value")
    w = F.floor(F.col("frame_idx") / F.lit(size)).cast("long")
    x = (F.col("frame_idx") - F.col("window_no") * size).cast("double")
    slope = F.try_divide(F.covar_pop("value", x), F.var_pop(x))
    return long.withColumn("window_no", w).groupBy(*keys, "channel", "window_no").agg(
        F.avg("value").alias("mean"),
        F.stddev_pop("value").alias("std"),
        F.coalesce(slope, F.lit(0.0)).alias("slope"),
        F.max("value").alias("max"),
        F.min("value").alias("min"),
    )


def compose(*steps: Callable[[DataFrame], DataFrame]) -> Callable[[DataFrame], DataFrame]:
    """Chain transforms left to right."""

    def run(df: DataFrame) -> DataFrame:
        for step in steps:
            df = df.transform(step)
        return df

    return run


def fit_stored_length(
    df: DataFrame, stats: DataFrame, channels: list[str], length: int, keys: list[str] = RECORDING
) -> DataFrame:
    """New recordings to a trained model's input: last T frames or zeros in front, then the scaler."""
    return apply_scaler(
        pad(truncate(df, keys, length), channels, keys, 0.0, length, front=True), stats, channels
    )


def windows_for_scoring(
    df: DataFrame, stats: DataFrame, channels: list[str], size: int, overlap: float, keys: list[str] = RECORDING
) -> DataFrame:
    """Windows of new data under a stored scaler; raises at run time when a sample fits no window."""
    lens = lengths(df, keys)
    ok = lens.agg(F.min("n_frames").alias("_shortest"))
    guarded = df.crossJoin(F.broadcast(ok)).filter(
        F.when(F.col("_shortest") >= size, True).otherwise(
            F.raise_error(F.lit("a recording is shorter than one window")).isNull()
        )
    )
    return apply_scaler(sliding_windows(guarded.drop("_shortest"), size, overlap, keys), stats, channels)


def channel_first(df: DataFrame, channels: list[str], keys: list[str] = RECORDING, chunk: int = ordering.BLOCK):
    """One array per (sample, channel, chunk) in frame order; chunks bound the array length.

    A frame is collected once for all its channels, so rows that lie by sample are not moved.
    """
    c = F.floor(F.col("frame_idx") / F.lit(chunk)).cast("long")
    packed = df.withColumn("chunk", c).groupBy(*keys, "chunk").agg(
        F.array_sort(F.collect_list(F.struct("frame_idx", *channels))).alias("_p")
    )
    again = F.size(F.array_distinct(F.col("_p")["frame_idx"])) < F.size("_p")

    def values(x: str) -> Column:
        # Frames of one number go by their values, in each channel by its own.
        own = F.array_sort(F.transform("_p", lambda p: F.struct(p["frame_idx"].alias("frame_idx"), p[x].alias("value"))))
        return F.when(F.col("_again"), own["value"]).otherwise(F.col("_p")[x])

    cells = [F.struct(F.lit(x).alias("channel"), values(x).alias("values")) for x in channels]
    out = packed.withColumn("_again", again).select(*keys, "chunk", F.inline(F.array(*cells)))
    return out.select(*keys, "channel", "chunk", "values")


def augmentation_plan(df: DataFrame, methods: list[str], rounds: int, seed: int = 42) -> DataFrame:
    """Fan recordings out to (original + rounds x methods) copies with ids and per-copy seeds.

    ``subject_id`` is kept, so a copy can never end up in a different fold from its original.
    """
    plan = [F.struct(F.lit("original").alias("method"), F.lit(-1).alias("copy_no"), F.lit(seed).alias("seed"))]
    for k in range(rounds):
        for i, m in enumerate(methods):
            plan.append(
                F.struct(
                    F.lit(m).alias("method"),
                    F.lit(k * len(methods) + i).alias("copy_no"),
                    F.lit(seed + k + i).alias("seed"),
                )
            )
    out = df.withColumn("_p", F.explode(F.array(*plan))).select("*", "_p.*").drop("_p")
    tag = F.concat(F.lit("_aug"), F.col("copy_no").cast("string"), F.lit("_"), F.initcap("method"))
    return out.withColumn(
        "sample_id", F.concat("subject_id", F.when(F.col("copy_no") < 0, "").otherwise(tag))
    )
