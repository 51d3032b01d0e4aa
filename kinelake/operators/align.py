"""Cutting raw logs into task recordings, repairing angles, relating events to frames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinelake.operators import ordering


def task_intervals(markers: DataFrame, labels: dict[int, str]) -> DataFrame:
    """(subject_id, task, start_s, end_s) from marker rows (subject_id, ts, name, row_no).

    Start is the first row named like the task; end is the first row of the next configured task (no
    interval when that is missing); the last task ends at the next row of any kind, else +inf.
    Everything is ``min_by`` per subject, so partial aggregation bounds what a busy subject ships.
    """
    order = sorted(labels)
    name = F.trim("name")
    named = F.struct("row_no", "ts")
    starts = markers.groupBy("subject_id").agg(
        *[F.min(F.when(name == labels[t], named)).alias(f"s{t}") for t in order]
    )
    last = order[-1]
    after = (
        markers.join(
            starts.filter(F.col(f"s{last}").isNotNull()).select(
                "subject_id", F.col(f"s{last}")["row_no"].alias("_from")
            ),
            "subject_id",
        )
        .filter("row_no > _from")
        .groupBy("subject_id")
        .agg(F.min(named).alias("_after"))
    )
    rows = []
    for t, nxt in zip(order, [*order[1:], None]):
        end = F.col(f"s{nxt}")["ts"] if nxt else F.coalesce(F.col("_after")["ts"], F.lit(float("inf")))
        rows.append(F.struct(F.lit(t).alias("task"), F.col(f"s{t}")["ts"].alias("start_s"), end.alias("end_s")))
    out = starts.join(after, "subject_id", "left").select("subject_id", F.inline(F.array(*rows)))
    return out.filter("start_s IS NOT NULL AND end_s IS NOT NULL")


def slice_recordings(movement: DataFrame, intervals: DataFrame, time: str = "t") -> DataFrame:
    """Rows of ``movement`` inside [start, end) of each task; equality on the subject hashes first."""
    joined = movement.join(intervals, "subject_id")
    return joined.filter((F.col(time) >= F.col("start_s")) & (F.col(time) < F.col("end_s"))).drop("start_s", "end_s")


def unwrap_rotations(df: DataFrame, channels: list[str], keys: list[str], size: int = ordering.BLOCK) -> DataFrame:
    """Unwrap degree channels, then shift a channel by -360 when its first frame is above 180."""
    x = ordering.neighbours(df, keys, {f"{c}__p": (c, -1) for c in channels}, size=size)
    steps = {}
    for c in channels:
        d = F.col(c) - F.col(f"{c}__p")
        wrapped = F.pmod(d + 180.0, F.lit(360.0)) - 180.0
        wrapped = F.when((wrapped == -180.0) & (d > 0), 180.0).otherwise(wrapped)
        steps[f"{c}__d"] = F.when(F.abs(d) < 180.0, 0.0).otherwise(F.coalesce(wrapped - d, F.lit(0.0)))
    x = ordering.running_sum(x.withColumns(steps), keys, {f"{c}__u": f"{c}__d" for c in channels}, size=size)
    first = {f"{c}__0": F.max(F.when(F.col("frame_idx") == 0, F.col(c))) for c in channels}
    x = ordering.attach(x, keys, first, ordering.largest_group(df, keys))
    fixed = {
        c: F.col(c) + F.col(f"{c}__u") - F.when(F.col(f"{c}__0") > 180.0, 360.0).otherwise(0.0) for c in channels
    }
    return x.withColumns(fixed).drop(*[f"{c}__{s}" for c in channels for s in "pdu0"])


def semantic_names(df: DataFrame, names: dict[str, str], keep: list[str]) -> DataFrame:
    """Project raw sensor columns under their semantic names (``names``: semantic -> raw)."""
    return df.select(*keep, *[F.col(raw).alias(sem) for sem, raw in names.items()])


def drop_time(df: DataFrame, time: str = "t_s") -> DataFrame:
    return df.drop(time)


def subject_of(key: Column | str) -> Column:
    """The subject part of a window id such as ``fx07_task4_trial1``."""
    return F.split(key, "_")[0]


def complete_channels(df: DataFrame, channels: list[str], keys: list[str]) -> DataFrame:
    """Keep recordings in which every channel has data."""
    missing = [c for c in channels if c not in df.columns]
    if missing:
        raise ValueError(f"recordings lack channels {missing}")
    seen = df.groupBy(*keys).agg(*[F.count(c).alias(f"_n{i}") for i, c in enumerate(channels)])
    ok = seen.filter(" AND ".join(f"_n{i} > 0" for i in range(len(channels)))).select(*keys)
    return df.join(ok, keys, "left_semi")


def frame_time(idx: Column | str, rate: float = 50.0) -> Column:
    return (F.col(idx) if isinstance(idx, str) else idx) / F.lit(rate)


def relative_events(events: DataFrame, ts: str = "ts", subject: str = "subject_id") -> DataFrame:
    """Event times relative to the subject's first event; ids compared upper-case."""
    e = events.withColumn(subject, F.upper(F.trim(subject)))
    first = e.groupBy(subject).agg(F.min(ts).alias("_t0"))
    return e.join(first, subject).withColumn("rel_s", F.col(ts) - F.col("_t0")).drop("_t0")


def event_label(event: Column | str, hand: Column | str) -> Column:
    """Append ``- left`` / ``- right`` when the hand text starts with a side."""
    side = F.lower(F.split(F.trim(hand), r"\s+")[0])
    return F.when(side.isin("left", "right"), F.concat_ws(" - ", event, side)).otherwise(F.col(event))


def parse_hand(hand: Column | str) -> Column:
    """'left' / 'right' found anywhere in the text, else NULL."""
    low = F.lower(hand)
    return F.when(low.contains("left"), "left").when(low.contains("right"), "right")


def subject_test_slice(
    movement: DataFrame, markers: DataFrame, labels: dict[int, str], subject: str, channels: list[str], keys: list[str]
) -> DataFrame:
    """One subject's recordings with repaired angles; the filters reach both scans."""
    own = F.col("subject_id") == subject
    cut = slice_recordings(movement.filter(own), task_intervals(markers.filter(own), labels))
    cut = ordering.position(cut, keys, F.col("t"), ["t"])
    return unwrap_rotations(cut, [c for c in channels if "rot" in c], keys)


def order_stored_vectors(vectors: DataFrame, ids: DataFrame, by: str = "tag") -> DataFrame:
    """Line up an old result's value array with its ids sorted by tag (array position = tag rank)."""
    pos = vectors.select("experiment", F.posexplode("values").alias("pos", "value"))
    ranked = ordering.cumulate(
        ids.withColumn("_h", F.lit(0.0)), ["experiment"], F.col("_h"), [by], {"_r": F.lit(1).cast("long")}
    )
    ranked = ranked.withColumn("pos", F.col("_r") - 1).drop("_r", "_h")
    return ranked.join(pos, ["experiment", "pos"])
