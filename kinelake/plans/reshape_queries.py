"""Queries for reshaping, scaling, resampling and augmentation."""

from __future__ import annotations

from pyspark.sql import functions as F

from kinelake.config import CHANNELS, RECORDING
from kinelake.functions.expr import rnd, unit_sql
from kinelake.operators import reshape
from kinelake.plans.fixtures import frames, frames_sql
from kinelake.plans.registry import query

CH = ["head_pos_x", "head_rot_x"]
COLS = ", ".join(CH)
LENS = "lens AS (SELECT subject_id, task, count(*) AS n FROM frames GROUP BY ALL)"
BASE = f"frames AS ({frames_sql(CH)}), {LENS}"


def scaled_sql(src: str) -> str:
    return ", ".join(
        f"round(({c} - avg({c}) OVER ()) / CASE WHEN stddev_pop({c}) OVER () = 0 THEN 1 ELSE stddev_pop({c}) OVER () END, 6) + 0 AS {c}"
        for c in CH
    )


def out(df, digits=6, ids=("subject_id", "task", "frame_idx")):
    return df.select(*ids, *[rnd(c, digits).alias(c) for c in CH])


@query(
    "truncate_and_scale",
    f"""WITH {BASE}, m AS (SELECT min(n) AS t FROM lens), k AS (SELECT f.subject_id, f.task, f.frame_idx - (n - t) AS frame_idx, {COLS}
      FROM frames f JOIN lens USING (subject_id, task), m WHERE f.frame_idx >= n - t)
    SELECT subject_id, task, frame_idx, {scaled_sql("k")} FROM k""",
)
def truncate_and_scale(spark, sf):
    return out(reshape.standardize(reshape.truncate(frames(spark, sf, CH)), CH))


@query(
    "pad_and_scale",
    f"""WITH {BASE}, m AS (SELECT max(n) AS t FROM lens), g AS (SELECT subject_id, task, unnest(range(0, t)) AS frame_idx FROM lens, m),
    k AS (SELECT g.subject_id, g.task, g.frame_idx, {", ".join(f"coalesce({c}, 0) AS {c}" for c in CH)} FROM g LEFT JOIN frames USING (subject_id, task, frame_idx))
    SELECT subject_id, task, frame_idx, {scaled_sql("k")} FROM k""",
)
def pad_and_scale(spark, sf):
    return out(reshape.standardize(reshape.pad(frames(spark, sf, CH), CH), CH))


WIN_SQL = f"""wins AS (SELECT subject_id, task, unnest(range(0, n - 40 + 1, 10)) // 10 AS window_no FROM lens WHERE n >= 40),
  cut AS (SELECT f.subject_id, f.task, w.window_no, f.frame_idx - w.window_no * 10 AS frame_idx, {COLS} FROM wins w JOIN frames f
    ON f.subject_id = w.subject_id AND f.task = w.task AND f.frame_idx >= w.window_no * 10 AND f.frame_idx < w.window_no * 10 + 40)"""


@query("sliding_windows", f"WITH {BASE}, {WIN_SQL} SELECT subject_id, task, window_no, frame_idx, {scaled_sql('cut')} FROM cut")
def sliding_windows(spark, sf):
    w = reshape.standardize(reshape.sliding_windows(frames(spark, sf, CH), 40, 0.75), CH)
    return out(w, ids=("subject_id", "task", "window_no", "frame_idx"))


@query(
    "variable_length_summary",
    f"WITH {BASE} SELECT task, count(*) AS n_series, min(n) AS min_frames, max(n) AS max_frames, round(avg(n), 6) AS mean_frames, CAST(sum(n) AS BIGINT) / 5e1 AS total_seconds FROM lens GROUP BY ALL",
)
def variable_length_summary(spark, sf):
    s = reshape.length_summary(frames(spark, sf, CH[:1]), by=["task"])
    return s.withColumn("mean_frames", rnd("mean_frames"))


@query(
    "interpolate_linear",
    f"""WITH {BASE}, j AS (SELECT subject_id, task, n, unnest(range(0, 64)) AS j FROM lens), p AS (SELECT *, j * (n - 1) // 63 AS i, j * (n - 1) / 63.0 AS u FROM j)
    SELECT p.subject_id, p.task, j AS frame_idx, {", ".join(f"round(a.{c} + CASE WHEN p.i < n - 1 THEN (b.{c} - a.{c}) * (u - i) ELSE 0 END, 6) + 0 AS {c}" for c in CH)}
    FROM p JOIN frames a ON a.subject_id = p.subject_id AND a.task = p.task AND a.frame_idx = p.i
    LEFT JOIN frames b ON b.subject_id = p.subject_id AND b.task = p.task AND b.frame_idx = p.i + 1""",
)
def interpolate_linear(spark, sf):
    return out(reshape.interpolate_linear(frames(spark, sf, CH), CH, 64))


@query(
    "phase_shift",
    f"""WITH {BASE}, r AS (SELECT f.subject_id, f.task, (f.frame_idx + CAST(round_even(0.37 * n, 0) AS BIGINT)) % n AS frame_idx, {COLS}, n
      FROM frames f JOIN lens USING (subject_id, task)), m AS (SELECT min(n) AS t FROM lens),
    k AS (SELECT subject_id, task, frame_idx - (n - t) AS frame_idx, {COLS} FROM r, m WHERE frame_idx >= n - t)
    SELECT subject_id, task, frame_idx, {scaled_sql("k")} FROM k""",
)
def phase_shift(spark, sf):
    return out(reshape.standardize(reshape.truncate(reshape.phase_shift(frames(spark, sf, CH), 0.37)), CH))


@query("scale_all_frames", f"WITH {BASE} SELECT subject_id, task, frame_idx, {scaled_sql('frames')} FROM frames")
def scale_all_frames(spark, sf):
    return out(reshape.standardize(frames(spark, sf, CH), CH))


def _stats(src: str, cond: str) -> str:
    return ", ".join(f"avg({c}) AS {c}__m, stddev_pop({c}) AS {c}__s" for c in CH)


FOLD_SQL = f"""subj AS (SELECT subject_id, min(n) AS own FROM lens GROUP BY 1),
  tm AS (SELECT a.subject_id AS fold, min(b.own) AS t_min FROM subj a JOIN subj b ON b.subject_id <> a.subject_id GROUP BY 1),
  sc AS (SELECT fold, t_min, {", ".join(f"avg({c}) AS {c}__m, stddev_pop({c}) AS {c}__s" for c in CH)} FROM tm JOIN frames f ON f.subject_id <> fold
    JOIN lens USING (subject_id, task) WHERE f.frame_idx >= n - t_min GROUP BY ALL)"""


@query(
    "fold_scalers",
    f"""WITH {BASE}, {FOLD_SQL} SELECT fold, t_min, {", ".join(f"round({c}__m, 6) AS {c}__m, round({c}__s, 6) AS {c}__s" for c in CH)} FROM sc""",
)
def fold_scalers(spark, sf):
    s = reshape.fold_scalers(frames(spark, sf, CH), CH)
    return s.select("fold", "t_min", *[rnd(f"{c}__{k}").alias(f"{c}__{k}") for c in CH for k in "ms"])


@query(
    "fold_truncate_and_scale",
    f"""WITH {BASE}, {FOLD_SQL}, g AS (SELECT subject_id, task, n, t_min, unnest(range(0, t_min)) AS frame_idx, {", ".join(f"{c}__m, {c}__s" for c in CH)}
      FROM lens JOIN sc ON fold = subject_id)
    SELECT g.subject_id, g.task, g.frame_idx, {", ".join(f"round((coalesce(f.{c}, 0) - {c}__m) / CASE WHEN {c}__s = 0 THEN 1 ELSE {c}__s END, 6) + 0 AS {c}" for c in CH)}
    FROM g LEFT JOIN frames f ON f.subject_id = g.subject_id AND f.task = g.task AND f.frame_idx = g.frame_idx + g.n - g.t_min""",
)
def fold_truncate_and_scale(spark, sf):
    x = frames(spark, sf, CH)
    return out(reshape.scale_held_out(x, reshape.fold_scalers(x, CH), CH))


_FIRST = "(SELECT min(subject_id) FROM frames)"


@query(
    "fold_training_rows",
    f"""WITH {BASE}, {FOLD_SQL} SELECT f.subject_id, f.task, f.frame_idx - (n - t_min) AS frame_idx,
      {", ".join(f"round((f.{c} - {c}__m) / CASE WHEN {c}__s = 0 THEN 1 ELSE {c}__s END, 6) + 0 AS {c}" for c in CH)}
    FROM frames f JOIN lens USING (subject_id, task) JOIN sc ON fold = {_FIRST} WHERE f.subject_id <> fold AND f.frame_idx >= n - t_min""",
)
def fold_training_rows(spark, sf):
    """All training rows of the first subject's fold, cut and scaled as the fold says."""
    x = frames(spark, sf, CH)
    first = x.agg(F.min("subject_id")).first()[0]
    return out(reshape.fold_rows(x, reshape.fold_scalers(x, CH), first, CH))


@query(
    "fold_training_rows_variable_length",
    f"""WITH {BASE}, sc AS (SELECT {", ".join(f"avg({c}) AS {c}__m, stddev_pop({c}) AS {c}__s" for c in CH)} FROM frames WHERE subject_id <> {_FIRST})
    SELECT subject_id, task, frame_idx, {", ".join(f"round(({c} - {c}__m) / {c}__s, 6) + 0 AS {c}" for c in CH)} FROM frames, sc WHERE subject_id <> {_FIRST}""",
)
def fold_training_rows_variable_length(spark, sf):
    x = frames(spark, sf, CH)
    first = x.agg(F.min("subject_id")).first()[0]
    return out(reshape.fold_rows(x, reshape.fold_scalers(x, CH, trim=False), first, CH, trim=False))


@query(
    "fold_scale_variable_length",
    f"""WITH {BASE}, sc AS (SELECT a.subject_id AS fold, {", ".join(f"avg(f.{c}) AS {c}__m, stddev_pop(f.{c}) AS {c}__s" for c in CH)}
      FROM (SELECT DISTINCT subject_id FROM lens) a JOIN frames f ON f.subject_id <> a.subject_id GROUP BY 1)
    SELECT f.subject_id, f.task, f.frame_idx, {", ".join(f"round((f.{c} - {c}__m) / {c}__s, 6) + 0 AS {c}" for c in CH)} FROM frames f JOIN sc ON fold = f.subject_id""",
)
def fold_scale_variable_length(spark, sf):
    x = frames(spark, sf, CH)
    return out(reshape.scale_held_out(x, reshape.fold_scalers(x, CH, trim=False), CH, trim=False))


def _noise_sql(c: str) -> str:
    parts = ("subject_id", "CAST(task AS STRING)", "CAST(frame_idx AS STRING)", f"'{c}'", "'42'")
    return f"1e-2 * (sqrt(-2 * ln({unit_sql(*parts)})) * cos(2 * pi() * {unit_sql(*parts, start=14)}))"


@query(
    "jitter",
    f"WITH {BASE} SELECT subject_id, task, frame_idx, {', '.join(f'round({c} + {_noise_sql(c)}, 6) + 0 AS {c}' for c in CH)} FROM frames",
)
def jitter(spark, sf):
    return out(reshape.jitter(frames(spark, sf, CH), CH))


@query(
    "random_slice",
    f"""WITH {BASE}, sp AS (SELECT *, CASE WHEN n > 40 THEN 40 + CAST(floor({unit_sql("subject_id", "CAST(task AS STRING)", "'42'")} * (n - 40 + 1)) AS BIGINT) ELSE n END AS span FROM lens),
    st AS (SELECT *, CAST(floor({unit_sql("subject_id", "CAST(task AS STRING)", "'43'")} * (n - span + 1)) AS BIGINT) AS start FROM sp)
    SELECT f.subject_id, f.task, f.frame_idx - st.start AS frame_idx, {", ".join(f"round({c}, 6) + 0 AS {c}" for c in CH)}
    FROM frames f JOIN st ON st.subject_id = f.subject_id AND st.task = f.task AND f.frame_idx >= st.start AND f.frame_idx < st.start + span""",
)
def random_slice(spark, sf):
    return out(reshape.random_slice(frames(spark, sf, CH), 40))


@query(
    "augmentation_plan",
    f"""WITH {BASE}, plan(method, copy_no, seed) AS (VALUES ('original', -1, 42), ('jitter', 0, 42), ('slice', 1, 43), ('jitter', 2, 43), ('slice', 3, 44))
    SELECT CASE WHEN copy_no < 0 THEN subject_id ELSE concat(subject_id, '_aug', CAST(copy_no AS STRING), '_', upper(method[1]), method[2:]) END AS sample_id,
      subject_id, task, method, seed, count(*) AS n FROM frames, plan GROUP BY ALL""",
)
def augmentation_plan(spark, sf):
    x = reshape.augmentation_plan(frames(spark, sf, CH), ["jitter", "slice"], 2)
    return x.groupBy("sample_id", "subject_id", "task", "method", "seed").agg(F.count(F.lit(1)).alias("n"))


@query(
    "window_statistics",
    f"""WITH {BASE}, s AS (SELECT subject_id, task, frame_idx, channel, value FROM frames UNPIVOT (value FOR channel IN ({COLS})))
    SELECT subject_id, task, channel, frame_idx // 30 AS window_no, round(avg(value), 6) + 0 AS mean, round(stddev_pop(value), 6) + 0 AS std,
      round(CASE WHEN count(*) < 2 THEN 0 ELSE covar_pop(value, frame_idx) / var_pop(frame_idx) END, 6) + 0 AS slope,
      round(max(value), 6) AS max, round(min(value), 6) AS min FROM s GROUP BY ALL""",
)
def window_statistics(spark, sf):
    w = reshape.window_statistics(frames(spark, sf, CH), CH, 30)
    return w.select(
        *RECORDING, "channel", "window_no", *[rnd(c).alias(c) for c in ("mean", "std", "slope", "max", "min")]
    )


@query(
    "stored_scaler_scoring_input",
    f"""WITH {BASE}, sc AS (SELECT {", ".join(f"avg({c}) AS {c}__m, stddev_pop({c}) AS {c}__s" for c in CH)} FROM frames WHERE subject_id LIKE 'fx%'),
    g AS (SELECT subject_id, task, n, unnest(range(0, 100)) AS frame_idx FROM lens)
    SELECT g.subject_id, g.task, g.frame_idx, {", ".join(f"round((coalesce(f.{c}, 0) - {c}__m) / {c}__s, 6) + 0 AS {c}" for c in CH)}
    FROM g LEFT JOIN frames f ON f.subject_id = g.subject_id AND f.task = g.task AND f.frame_idx = g.frame_idx + g.n - 100, sc""",
)
def stored_scaler_scoring_input(spark, sf):
    x = frames(spark, sf, CH)
    stats = reshape.scaler(x.filter(F.col("subject_id").startswith("fx")), CH)
    return out(reshape.fit_stored_length(x.drop("t_s"), stats, CH, 100))


@query(
    "stored_scaler_windows",
    f"""WITH {BASE}, sc AS (SELECT {", ".join(f"avg({c}) AS {c}__m, stddev_pop({c}) AS {c}__s" for c in CH)} FROM frames WHERE subject_id LIKE 'fx%'),
    wins AS (SELECT subject_id, task, unnest(range(0, n - 20 + 1, 20)) // 20 AS window_no FROM lens WHERE n >= 20)
    SELECT f.subject_id, f.task, w.window_no, f.frame_idx - w.window_no * 20 AS frame_idx, {", ".join(f"round((f.{c} - {c}__m) / {c}__s, 6) + 0 AS {c}" for c in CH)}
    FROM wins w JOIN frames f ON f.subject_id = w.subject_id AND f.task = w.task AND f.frame_idx >= w.window_no * 20 AND f.frame_idx < w.window_no * 20 + 20, sc""",
)
def stored_scaler_windows(spark, sf):
    x = frames(spark, sf, CH)
    stats = reshape.scaler(x.filter(F.col("subject_id").startswith("fx")), CH)
    w = reshape.windows_for_scoring(x, stats, CH, 20, 0.0)
    return out(w, ids=("subject_id", "task", "window_no", "frame_idx"))


@query(
    "composed_transforms",
    f"""WITH {BASE}, m AS (SELECT min(n) AS t FROM lens), k AS (SELECT f.subject_id, f.task, f.frame_idx - (n - t) AS frame_idx, {COLS}
      FROM frames f JOIN lens USING (subject_id, task), m WHERE f.frame_idx >= n - t),
    z AS (SELECT subject_id, task, frame_idx, {scaled_sql("k").replace("round(", "(").replace(", 6) + 0", ")")} FROM k),
    s AS (SELECT subject_id, task, frame_idx, channel, value FROM z UNPIVOT (value FOR channel IN ({COLS})))
    SELECT subject_id, task, channel, frame_idx // 25 AS window_no, round(avg(value), 6) + 0 AS mean FROM s GROUP BY ALL""",
)
def composed_transforms(spark, sf):
    run = reshape.compose(
        reshape.truncate,
        lambda d: reshape.standardize(d, CH),
        lambda d: reshape.window_statistics(d, CH, 25),
    )
    return run(frames(spark, sf, CH)).select(*RECORDING, "channel", "window_no", rnd("mean").alias("mean"))


@query(
    "channel_first_layout",
    f"""WITH frames AS ({frames_sql(CHANNELS)}), s AS (SELECT subject_id, task, frame_idx, channel, round(value, 6) AS value FROM frames UNPIVOT (value FOR channel IN ({", ".join(CHANNELS)})))
    SELECT subject_id, task, channel, CAST(0 AS BIGINT) AS chunk, CAST(count(*) AS BIGINT) AS n, round(sum(value * (frame_idx + 1)), 3) AS digest FROM s GROUP BY subject_id, task, channel""",
)
def channel_first_layout(spark, sf):
    """All values of all channels: each counts by its place."""
    x = reshape.channel_first(frames(spark, sf, CHANNELS), CHANNELS)
    placed = F.transform("values", lambda v, i: F.round(v, 6) * (i + 1))
    digest = F.aggregate(placed, F.lit(0.0), lambda a, b: a + b)
    return x.select(*RECORDING, "channel", "chunk", F.size("values").cast("long").alias("n"), rnd(digest, 3).alias("digest"))
