"""Flagship and time-domain queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from kinelake.config import CHANNELS
from kinelake.functions.expr import rnd
from kinelake.operators import features, reshape
from kinelake.plans.fixtures import frames, frames_sql, largest, long_frames_sql
from kinelake.plans.registry import query

HEAD = CHANNELS[:3]


def time_domain_sql(series: str, keys: str) -> str:
    """SQL for the 19 features from a CTE of (keys, frame_idx, channel, value)."""
    part = f"PARTITION BY {keys}, channel"
    return f"""
    lagged AS (SELECT *, lag(value) OVER ({part} ORDER BY frame_idx) AS prev,
                      avg(value) OVER ({part}) AS mean_ FROM {series}),
    paired AS (SELECT *, CASE WHEN prev IS NULL THEN NULL ELSE value END AS nxt FROM lagged),
    feats AS (
      SELECT {keys}, channel, avg(value) AS mean, quantile_cont(value, 0.5) AS median,
        stddev_pop(value) AS std, var_pop(value) AS variance, max(value) - min(value) AS range,
        quantile_cont(value, 0.75) - quantile_cont(value, 0.25) AS iqr, avg(abs(value - mean_)) AS mad,
        min(value) AS min, max(value) AS max, quantile_cont(value, 0.25) AS percentile_25,
        quantile_cont(value, 0.75) AS percentile_75, quantile_cont(value, 0.95) AS percentile_95,
        CASE WHEN var_pop(value) = 0 THEN NULL
             ELSE avg(pow(value - mean_, 4)) / pow(var_pop(value), 2) - 3 END AS kurtosis,
        CASE WHEN var_pop(value) = 0 THEN NULL
             ELSE avg(pow(value - mean_, 3)) / pow(var_pop(value), 1.5) END AS skewness,
        sqrt(avg(value * value)) AS rms, sum(value * value) AS energy, sum(abs(value)) AS sma,
        CAST(sum(CASE WHEN sign(value) <> sign(prev) THEN 1 ELSE 0 END) AS DOUBLE) / count(*) AS zero_crossing_rate,
        CASE WHEN stddev_pop(prev) * stddev_pop(nxt) = 0 THEN NULL
             ELSE covar_pop(prev, nxt) / (stddev_pop(prev) * stddev_pop(nxt)) END AS autocorr_lag1
      FROM paired GROUP BY {keys}, channel)"""


@query(
    "time_domain_features",
    f"""WITH {long_frames_sql()}, {time_domain_sql("series", "subject_id, task")}
    SELECT subject_id, task, channel, {", ".join(f"round({c}, 6) + 0 AS {c}" for c in features.TIME_DOMAIN)} FROM feats""",
)
def time_domain_features(spark, sf):
    out = features.time_domain(frames(spark, sf), CHANNELS)
    return out.select("subject_id", "task", "channel", *[rnd(c).alias(c) for c in features.TIME_DOMAIN])


@query(
    "windowed_feature_zscores",
    f"""WITH frames AS ({frames_sql(HEAD)}),
    stats AS (SELECT {", ".join(f"avg({c}) AS m{i}, stddev_pop({c}) AS s{i}" for i, c in enumerate(HEAD))} FROM frames),
    scaled AS (SELECT subject_id, task, grp, frame_idx,
       {", ".join(f"({c} - m{i}) / CASE WHEN s{i} = 0 THEN 1 ELSE s{i} END AS {c}" for i, c in enumerate(HEAD))}
       FROM frames, stats),
    lens AS (SELECT subject_id, task, count(*) AS n FROM scaled GROUP BY ALL),
    wins AS (SELECT subject_id, task, unnest(range(0, n - 30 + 1, 15)) // 15 AS window_no FROM lens WHERE n >= 30),
    cut AS (SELECT s.subject_id, s.task, s.grp, w.window_no, s.frame_idx - w.window_no * 15 AS frame_idx,
       {", ".join(HEAD)} FROM wins w JOIN scaled s ON s.subject_id = w.subject_id AND s.task = w.task
       AND s.frame_idx >= w.window_no * 15 AND s.frame_idx < w.window_no * 15 + 30),
    series AS (SELECT subject_id, task, grp, window_no, frame_idx, channel, value
       FROM cut UNPIVOT (value FOR channel IN ({", ".join(HEAD)}))),
    {time_domain_sql("series", "subject_id, task, grp, window_no")},
    longf AS (SELECT subject_id, task, grp, window_no, channel || '_' || feature AS feature, value
       FROM feats UNPIVOT (value FOR feature IN ({", ".join(features.TIME_DOMAIN)}))),
    g AS (SELECT grp, task, feature, avg(value) AS m, stddev_pop(value) AS s FROM longf GROUP BY ALL)
    SELECT l.subject_id, l.task, l.window_no, l.feature,
       round(CASE WHEN s <= 1e-12 THEN 0 ELSE (value - m) / s END, 5) + 0 AS z
    FROM longf l JOIN g ON g.grp = l.grp AND g.task = l.task AND g.feature = l.feature""",
)
def windowed_feature_zscores(spark, sf):
    keys = ["subject_id", "task", "grp", "window_no"]
    x = frames(spark, sf, HEAD).drop("t_s")
    cut = reshape.sliding_windows(reshape.standardize(x, HEAD), 30, 0.5)
    feats = features.time_domain(cut, HEAD, keys, max_rows=30)
    # Every 15 frames start at most one window per channel: a bound on a group's feature rows.
    bound = largest(x, sf, "grp_task", ["grp", "task"]) // 15 + 1
    z = features.wide_zscores(feats, ["grp", "task", "channel"], features.TIME_DOMAIN, bound)
    long = features.to_long(z, ["subject_id", "task", "window_no", "channel"], features.TIME_DOMAIN)
    return long.filter("value IS NOT NULL").select(
        "subject_id", "task", "window_no", F.concat_ws("_", "channel", "feature").alias("feature"), rnd("value", 5).alias("z")
    )
