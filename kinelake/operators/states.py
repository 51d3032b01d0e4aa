"""Hidden-state segments, event alignment and emission summaries.

Decoded states are rows (subject_id, frame_idx, state); any column works as the state label.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kinelake.functions.expr import div
from kinelake.operators import evaluate, ordering

SUBJECT = ["subject_id"]


def runs(states: DataFrame, keys: list[str] = SUBJECT, size: int = ordering.BLOCK) -> DataFrame:
    """Maximal stretches of one state: (keys, run_no, state, start_frame, end_frame)."""
    x = ordering.neighbours(states.select(*keys, "frame_idx", "state"), keys, {"_p": ("state", -1)}, size=size)
    x = x.withColumn("_new", F.when(F.col("_p").isNull() | (F.col("_p") != F.col("state")), 1).otherwise(0))
    x = ordering.running_sum(x, keys, {"run_no": F.col("_new").cast("long")}, size=size)
    return x.groupBy(*keys, "run_no").agg(
        F.first("state").alias("state"), F.min("frame_idx").alias("start_frame"), F.max("frame_idx").alias("end_frame")
    ).withColumn("run_no", F.col("run_no").cast("long") - 1)


def segments(states: DataFrame, keys: list[str] = SUBJECT, rate: float = 50.0) -> DataFrame:
    r = runs(states, keys)
    return r.withColumns(
        {
            "start_time": F.col("start_frame") / F.lit(rate),
            "end_time": F.col("end_frame") / F.lit(rate),
            "duration_s": (F.col("end_frame") - F.col("start_frame") + 1) / F.lit(rate),
        }
    )


def merged_segments(states: DataFrame, min_frames: int, keys: list[str] = SUBJECT, rate: float = 50.0) -> DataFrame:
    """Adjacent short runs become one segment labelled like ``0+1``; from/to labels are attached."""
    r = runs(states, keys)
    short = (F.col("end_frame") - F.col("start_frame") + 1 < min_frames).cast("int")
    r = r.withColumn("_short", short)
    r = ordering.neighbours(r, keys, {"_ps": ("_short", -1)}, "run_no")
    new = F.when((F.col("_short") == 1) & (F.coalesce("_ps", F.lit(0)) == 1), 0).otherwise(1)
    r = ordering.running_sum(r.withColumn("_new", new.cast("long")), keys, {"seg_no": "_new"}, "run_no")
    label = F.array_join(F.transform(F.array_sort(F.collect_set("state")), lambda s: s.cast("string")), "+")
    seg = r.groupBy(*keys, "seg_no").agg(
        label.alias("state"), F.min("start_frame").alias("start_frame"), F.max("end_frame").alias("end_frame")
    )
    seg = seg.withColumn("seg_no", F.col("seg_no").cast("long") - 1)
    seg = ordering.neighbours(seg, keys, {"from_state": ("state", -1), "to_state": ("state", 1)}, "seg_no")
    return seg.withColumns(
        {
            "start_s": F.round(F.col("start_frame") / F.lit(rate), 3),
            "end_s": F.round(F.col("end_frame") / F.lit(rate), 3),
            "duration_s": F.round((F.col("end_frame") - F.col("start_frame") + 1) / F.lit(rate), 3),
        }
    )


def state_summary(states: DataFrame, n_states: int, keys: list[str] = SUBJECT, rate: float = 50.0) -> DataFrame:
    """Frames, seconds, transitions and percent of frames per state."""
    x = ordering.neighbours(states, keys, {"_p": ("state", -1)})
    n = F.count(F.lit(1))
    pct = [
        F.round(100.0 * F.sum((F.col("state") == s).cast("int")) / n, 1).alias(f"state{s}_pct") for s in range(n_states)
    ]
    return x.groupBy(*keys).agg(
        n.alias("n_frames"),
        F.round(n / F.lit(rate), 1).alias("total_s"),
        F.sum(F.when(F.col("_p") != F.col("state"), 1).otherwise(0)).alias("n_transitions"),
        *pct,
    )


def group_means(summary: DataFrame, group: str, columns: list[str]) -> DataFrame:
    return summary.groupBy(group).agg(*[F.round(F.avg(c), 1).alias(c) for c in columns])


def transitions(states: DataFrame, keys: list[str] = SUBJECT, rate: float = 50.0) -> DataFrame:
    """(keys, t, before, after): a boundary sits at the last frame of the earlier run."""
    x = ordering.neighbours(states.select(*keys, "frame_idx", "state"), keys, {"after": ("state", 1)})
    return x.filter("after IS NOT NULL AND after <> state").select(
        *keys, (F.col("frame_idx") / F.lit(rate)).alias("t"), F.col("state").alias("before"), "after"
    )


def align_events(
    events: DataFrame, trans: DataFrame, keys: list[str] = SUBJECT, tolerance: float = 0.5, width: float = 3600.0
) -> DataFrame:
    """Nearest transition per event (the earlier one on ties), error, states around it, matched flag."""
    x = ordering.nearest_sides(events, trans, keys, "t", ["before", "after"], width)
    eb, ea = F.col("t") - F.col("prev")["t"], F.col("next")["t"] - F.col("t")
    use_prev = F.col("next").isNull() | (F.col("prev").isNotNull() & (eb <= ea))
    near = F.when(use_prev, F.col("prev")).otherwise(F.col("next"))
    x = x.withColumn("_n", near).withColumn("temporal_error_s", F.abs(F.col("t") - F.col("_n")["t"]))
    return x.withColumns(
        {
            "nearest_transition_s": F.col("_n")["t"],
            "state_before": F.coalesce(F.col("_n")["before"], F.lit(-1)),
            "state_after": F.coalesce(F.col("_n")["after"], F.lit(-1)),
            "matched": F.coalesce(F.col("temporal_error_s") <= tolerance, F.lit(False)),
        }
    ).drop("_n", "prev", "next")


def alignment_summary(aligned: DataFrame, by: list[str]) -> DataFrame:
    """Events, match rate, mean/median/std error per subject or event type."""
    rate = aligned.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n_events"),
        F.sum(F.col("matched").cast("long")).alias("n_matched"),
        F.avg(F.col("matched").cast("double")).alias("match_rate"),
        F.avg("temporal_error_s").alias("mean_error_s"),
        F.stddev_pop("temporal_error_s").alias("std_error_s"),
    )
    med = ordering.quantiles(aligned, by, "temporal_error_s", {"median_error_s": 0.5})
    return rate.join(med, by, "left")


def states_at_events(
    events: DataFrame, states: DataFrame, keys: list[str] = SUBJECT, rate: int = 50, event_id: str = "event_id"
) -> DataFrame:
    """State at the event, dominant state within 1 s and 0.5 s, any transition within 0.5 s.

    Each event names the 2 * rate frames around it, so the range join is an equality join on frames.
    """
    lens = states.groupBy(*keys).agg((F.max("frame_idx") + 1).alias("_t"))
    f = F.greatest(F.least(F.floor(F.col("t") * rate), F.col("_t") - 1), F.lit(0)).cast("long")
    e = events.join(lens, keys).withColumn("_f", f)
    span = F.sequence(F.greatest(F.col("_f") - rate, F.lit(0)), F.least(F.col("_f") + rate, F.col("_t")) - 1)
    near = e.select(*keys, event_id, "event", "_f", F.explode(span).alias("frame_idx"))
    x = near.join(states.select(*keys, "frame_idx", "state"), [*keys, "frame_idx"])
    half = (F.col("frame_idx") >= F.col("_f") - rate // 2) & (F.col("frame_idx") < F.col("_f") + rate // 2)
    counts = x.groupBy(*keys, event_id, "event", "state").agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(half.cast("long")).alias("h"),
        F.max((F.col("frame_idx") == F.col("_f")).cast("int")).alias("at"),
    )
    first = lambda n: F.min(F.struct((-F.col(n)).alias("k"), "state"))
    out = counts.groupBy(*keys, event_id, "event").agg(
        F.max(F.when(F.col("at") == 1, F.col("state"))).alias("state_at"),
        first("n").alias("_d"),
        first("h").alias("_h"),
        F.sum("n").alias("_n"),
        (F.sum((F.col("h") > 0).cast("int")) > 1).alias("has_transition"),
    )
    return out.select(
        *keys,
        event_id,
        "event",
        "state_at",
        F.col("_d")["state"].alias("dominant_state"),
        (-100.0 * F.col("_d")["k"] / F.col("_n")).alias("dominant_pct"),
        F.col("_h")["state"].alias("profile_state"),
        "has_transition",
    )


def state_profiles(at_events: DataFrame) -> DataFrame:
    """Which events fall predominantly in each state."""
    return at_events.groupBy("profile_state", "event").agg(F.count(F.lit(1)).alias("n"))


# ---------------------------------------------------------------- emission summaries


def state_means(frames: DataFrame, channels: list[str], by: list[str] = ()) -> DataFrame:
    """(by, state, channel, mean) over decoded frames."""
    return frames.unpivot([*by, "state"], channels, "channel", "value").groupBy(*by, "state", "channel").agg(
        F.avg("value").alias("mean")
    )


def emission_importance(means: DataFrame, by: list[str] = ()) -> tuple[DataFrame, DataFrame]:
    """(global: range of state means per channel, per state: deviation x range), as shares."""
    ch = means.groupBy(*by, "channel").agg(
        F.avg("mean").alias("_avg"), (F.max("mean") - F.min("mean")).alias("_range")
    )
    tot = ch.groupBy(*by).agg(F.sum("_range").alias("_sum")) if by else ch.agg(F.sum("_range").alias("_sum"))
    g = ch.join(tot, list(by)) if by else ch.crossJoin(F.broadcast(tot))
    g = g.select(*by, "channel", (F.col("_range") / (F.col("_sum") + 1e-12)).alias("importance"))
    dev = means.join(ch, [*by, "channel"]).withColumn(
        "_s", F.abs(F.col("mean") - F.col("_avg")) * (F.col("_range") + 1e-8)
    )
    sums = dev.groupBy(*by, "state").agg(F.sum("_s").alias("_t"))
    per = dev.join(sums, [*by, "state"]).select(
        *by, "state", "channel", (F.col("_s") / (F.col("_t") + 1e-12)).alias("importance")
    )
    return g, per


def state_averaged_importance(per_state: DataFrame, by: list[str] = ()) -> DataFrame:
    avg = per_state.groupBy(*by, "channel").agg(F.avg("importance").alias("importance"))
    return evaluate.rank_importance(evaluate.normalize_drops(avg, by), by)


def class_difference(means: DataFrame, case, control, label: str = "y") -> DataFrame:
    """Case minus control state means; fails when the classes have different states."""
    a = means.filter(F.col(label) == case).select("state", "channel", F.col("mean").alias("_a"))
    b = means.filter(F.col(label) == control).select("state", "channel", F.col("mean").alias("_b"))
    j = a.join(b, ["state", "channel"], "full")
    ok = F.when(F.col("_a").isNotNull() & F.col("_b").isNotNull(), True).otherwise(
        F.raise_error(F.lit("state counts differ between classes")).isNull()
    )
    return j.filter(ok).select("state", "channel", (F.col("_a") - F.col("_b")).alias("difference"))


def top_channels(means: DataFrame, n: int, by: list[str] = ()) -> DataFrame:
    """Top-n channels per state by |mean| (one row per channel reaches the window)."""
    w = Window.partitionBy(*by, "state").orderBy(F.desc(F.abs("mean")), "channel")
    return means.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= n)


def transition_matrix(states: DataFrame, keys: list[str] = SUBJECT, by: list[str] = ()) -> DataFrame:
    """Empirical transition counts and row shares."""
    x = ordering.neighbours(states, keys, {"to_state": ("state", 1)}).filter("to_state IS NOT NULL")
    c = x.groupBy(*by, F.col("state").alias("from_state"), "to_state").agg(F.count(F.lit(1)).alias("n"))
    rows = Window.partitionBy(*by, "from_state")
    return c.withColumn("probability", F.col("n") / F.sum("n").over(rows))


def merge_parts(parts: DataFrame, n_channels: int) -> DataFrame:
    """Combine per-channel drops; the job fails naming the missing channel ids."""
    want = parts.sparkSession.range(n_channels).withColumnRenamed("id", "channel_id")
    missing = want.join(parts.select("channel_id").distinct(), "channel_id", "left_anti")
    lost = missing.agg(F.array_join(F.array_sort(F.collect_list("channel_id")), ",").alias("_lost"))
    text = F.concat(F.lit("missing channel parts: "), "_lost")
    checked = parts.crossJoin(F.broadcast(lost)).filter(
        F.when(F.col("_lost") == "", True).otherwise(F.raise_error(text).isNull())
    )
    return evaluate.normalize_drops(checked.drop("_lost").withColumnRenamed("drop", "importance"))


def duration_rates(states: DataFrame, n_states: int, keys: list[str] = SUBJECT, by: list[str] = ()) -> DataFrame:
    """Mean run length in frames per state; 1.0 for states never seen."""
    got = runs(states, [*keys, *[b for b in by if b not in keys]]).groupBy(*by, "state").agg(
        F.avg((F.col("end_frame") - F.col("start_frame") + 1).cast("double")).alias("rate")
    )
    every = got.select(*by).distinct() if by else got.sparkSession.range(1).select()
    grid = every.withColumn("state", F.explode(F.sequence(F.lit(0), F.lit(n_states - 1))))
    return grid.join(got, [*by, "state"], "left").withColumn("rate", F.coalesce("rate", F.lit(1.0)))


def dwell_table(
    states: DataFrame, n_states: int, cls: str, keys: list[str] = SUBJECT, rate: float = 50.0, factor: float = 2.5
) -> DataFrame:
    """Seconds per visit, occupancy and outlier flag (>= factor x the longest other state) per class."""
    lam = duration_rates(states, n_states, keys, [cls])
    occ = states.groupBy(cls, "state").agg(F.count(F.lit(1)).alias("_n"))
    tot = occ.groupBy(cls).agg(F.sum("_n").alias("_all"))
    x = lam.join(occ, [cls, "state"], "left").join(tot, cls)
    x = x.withColumns(
        {
            "lambda_s": F.col("rate") / F.lit(rate),
            "empirical_occupancy": F.coalesce("_n", F.lit(0)) / F.col("_all"),
        }
    )
    # One row per state reaches this window.
    w = Window.partitionBy(cls).orderBy(F.desc("lambda_s"), "state")
    full = Window.partitionBy(cls)
    x = x.withColumn("_k", F.row_number().over(w))
    top = F.max(F.when(F.col("_k") == 1, F.col("lambda_s"))).over(full)
    second = F.max(F.when(F.col("_k") == 2, F.col("lambda_s"))).over(full)
    other = F.when(F.col("_k") == 1, second).otherwise(top)
    return x.select(
        cls,
        "state",
        "lambda_s",
        "empirical_occupancy",
        F.coalesce(F.col("lambda_s") >= factor * other, F.lit(False)).alias("is_outlier"),
    )


def dwell_difference(dwell: DataFrame, cls: str, case, control) -> DataFrame:
    v = lambda g: F.max(F.when(F.col(cls) == g, F.col("lambda_s")))
    return dwell.groupBy("state").agg((v(case) - v(control)).alias("difference_s"), div(v(case), v(control)).alias("ratio"))
