"""Queries for movement features, complexity measures and feature summaries."""

from __future__ import annotations

from pyspark.sql import functions as F

from kinelake.config import CHANNELS, FUNCTIONAL_PAIRS, RECORDING, SENSORS
from kinelake.functions.expr import rnd
from kinelake.operators import complexity, features
from kinelake.operators.features import PLANES, axes
from kinelake.plans.core import time_domain_sql
from kinelake.plans.fixtures import SUBJECTS_SQL, counted_once, frames, frames_sql, subjects
from kinelake.plans.registry import query

POS = [c for s in SENSORS for c in axes(s, "pos")]
HANDS = [c for c in CHANNELS if "hand" in c]
W = "WINDOW w AS (PARTITION BY subject_id, task ORDER BY frame_idx)"


def n2(*terms: str) -> str:
    return "sqrt(" + " + ".join(f"({t}) * ({t})" for t in terms) + ")"


def rounded(df, digits: int = 6, ids=RECORDING, skip=("channel",)):
    keep = [c for c in df.columns if c in ids or c in skip]
    return df.select(*keep, *[rnd(c, digits).alias(c) for c in df.columns if c not in keep])


def sql_round(cols: dict[str, str], digits: int = 6) -> str:
    return ", ".join(f"round({e}, {digits}) + 0 AS {n}" for n, e in cols.items())


_step = {
    s: (
        n2(*[f"{c} - lag({c}) OVER w" for c in axes(s, "pos")]),
        n2(*[f"lead({c}) OVER w - {c}" for c in axes(s, "pos")]),
    )
    for s in SENSORS
}
SIGNALS_SQL = (
    f"frames AS ({frames_sql(POS)}), sig AS (SELECT subject_id, task, grp, frame_idx, "
    + ", ".join(f"coalesce({a}, {b}) * 50 AS {s}_speed" for s, (a, b) in _step.items())
    + ", "
    + ", ".join(f"{n2(*axes(s, 'pos'))} AS {s}_mag" for s in SENSORS)
    + f", coalesce({_step['Head'][0]}, {_step['Head'][1]}) AS head_step FROM frames {W})"
)
MAGS = [f"{s}_mag" for s in SENSORS]
SPEEDS = [f"{s}_speed" for s in SENSORS]


def long_sql(cols: list[str], name: str = "lng") -> str:
    return (
        f"{name} AS (SELECT subject_id, task, grp, frame_idx, channel, value FROM sig "
        f"UNPIVOT (value FOR channel IN ({', '.join(cols)})))"
    )


def signals(spark, sf):
    return features.derived_signals(frames(spark, sf, POS))


@query(
    "sensor_split",
    f"WITH frames AS ({frames_sql()}) "
    + " UNION ALL ".join(
        f"SELECT '{s}' AS sensor, task, count(*) AS n, round(avg({axes(s, 'pos')[0]}), 6) AS pos_x, round(avg({axes(s, 'rot')[2]}), 6) AS rot_z FROM frames GROUP BY task"
        for s in SENSORS
    ),
)
def sensor_split(spark, sf):
    out = features.sensor_split(frames(spark, sf)).groupBy("sensor", "task")
    return out.agg(F.count(F.lit(1)).alias("n"), rnd(F.avg("pos_x")).alias("pos_x"), rnd(F.avg("rot_z")).alias("rot_z"))


@query(
    "derived_signals",
    f"WITH {SIGNALS_SQL} SELECT subject_id, task, frame_idx, {', '.join(f'round({c}, 6) + 0 AS {c}' for c in [*SPEEDS, *MAGS, 'head_step'])} FROM sig",
)
def derived_signals(spark, sf):
    return rounded(signals(spark, sf), ids=[*RECORDING, "frame_idx"])


@query(
    "jerk_smoothness",
    f"""WITH {SIGNALS_SQL}, {long_sql(SPEEDS)}, j AS (SELECT *, (value - lag(value) OVER (PARTITION BY subject_id, task, channel ORDER BY frame_idx)) / 0.02 AS jk FROM lng),
    a AS (SELECT subject_id, task, channel, sqrt(avg(jk * jk)) AS jerk_rms, max(abs(value)) AS peak, count(*) * 0.02 AS dur FROM j GROUP BY ALL)
    SELECT subject_id, task, channel, round(jerk_rms, 5) AS jerk_rms,
      round(CASE WHEN peak > 0 THEN jerk_rms * pow(dur, 3) / (peak * peak) ELSE 0 END, 5) AS jerk_metric FROM a""",
)
def jerk_smoothness(spark, sf):
    return rounded(features.jerk(signals(spark, sf), SPEEDS), 5)


@query(
    "activity_span",
    f"""WITH {SIGNALS_SQL}, t AS (SELECT *, avg(head_step) OVER p + 2 * stddev_pop(head_step) OVER p AS thr, count(*) OVER p AS n FROM sig
      WINDOW p AS (PARTITION BY subject_id, task))
    SELECT subject_id, task, max(n) / 5e1 AS duration, coalesce(min(frame_idx) FILTER (WHERE head_step > thr) / 5e1, 0) AS movement_onset_time,
      coalesce(max(frame_idx) FILTER (WHERE head_step > thr) / 5e1, 0) AS movement_offset_time,
      coalesce((max(frame_idx) FILTER (WHERE head_step > thr) - min(frame_idx) FILTER (WHERE head_step > thr)) / 5e1, 0) AS active_movement_duration
    FROM t GROUP BY ALL""",
)
def activity_span(spark, sf):
    return features.activity_span(signals(spark, sf), "head_step")


def _corr_sql(a: str, b: str) -> str:
    return (
        f"CASE WHEN stddev_pop({a}) * stddev_pop({b}) = 0 THEN NULL "
        f"ELSE covar_pop({a}, {b}) / (stddev_pop({a}) * stddev_pop({b})) END"
    )


LC = axes("LeftHand", "pos") + axes("LeftHand", "rot")
RC = axes("RightHand", "pos") + axes("RightHand", "rot")
_ml, _mr = f"avg({n2(*LC)})", f"avg({n2(*RC)})"
_ASYM = {
    "lr_ratio": f"{_ml} / ({_mr} + 1e-10)",
    "symmetry_index": f"({_ml} - {_mr}) / ({_ml} + {_mr} + 1e-10)",
    **{f"lr_correlation_axis{i}": _corr_sql(a, b) for i, (a, b) in enumerate(zip(LC, RC))},
    "vertical_asymmetry": f"avg({LC[2]}) - avg({RC[2]})",
}


@query(
    "bilateral_asymmetry",
    f"WITH frames AS ({frames_sql(HANDS)}) SELECT subject_id, task, {sql_round(_ASYM)} FROM frames GROUP BY ALL",
)
def bilateral_asymmetry(spark, sf):
    return rounded(features.asymmetry(frames(spark, sf, HANDS)))


_rng = lambda c: f"(max({c}) - min({c}))"
_sep = n2(*[f"{a} - {b}" for a, b in zip(LC[:3], RC[:3])])
_path = lambda cs: f"coalesce(sum({n2(*[f'd_{c}' for c in cs])}), 0)"
_PASYM = {}
for _a, _l, _r in zip("xyz", LC[:3], RC[:3]):
    _PASYM |= {
        f"mean_pos_diff_{_a}": f"avg({_l}) - avg({_r})",
        f"std_pos_diff_{_a}": f"stddev_pop({_l} - {_r})",
        f"rom_asymmetry_{_a}": f"{_rng(_l)} - {_rng(_r)}",
        f"rom_ratio_{_a}": f"{_rng(_l)} / ({_rng(_r)} + 1e-10)",
    }
_PASYM |= {
    "mean_hand_separation": f"avg({_sep})",
    "std_hand_separation": f"stddev_pop({_sep})",
    "min_hand_separation": f"min({_sep})",
    "max_hand_separation": f"max({_sep})",
    "path_length_ratio": f"{_path(LC[:3])} / ({_path(RC[:3])} + 1e-10)",
    "path_length_asymmetry": f"{_path(LC[:3])} - {_path(RC[:3])}",
}
HAND_POS = LC[:3] + RC[:3]


@query(
    "position_asymmetry",
    f"""WITH frames AS ({frames_sql(HAND_POS)}), d AS (SELECT *, {", ".join(f"{c} - lag({c}) OVER w AS d_{c}" for c in HAND_POS)} FROM frames {W})
    SELECT subject_id, task, {sql_round(_PASYM)} FROM d GROUP BY ALL""",
)
def position_asymmetry(spark, sf):
    return rounded(features.position_asymmetry(frames(spark, sf, HAND_POS)))


_RASYM = {}
for _p, _l, _r in zip(PLANES, LC[3:], RC[3:]):
    _RASYM |= {
        f"mean_rot_diff_{_p}": f"avg({_l}) - avg({_r})",
        f"std_rot_diff_{_p}": f"stddev_pop({_l} - {_r})",
        f"rot_rom_asymmetry_{_p}": f"{_rng(_l)} - {_rng(_r)}",
    }
_RASYM["rotation_magnitude_asymmetry"] = f"avg({n2(*LC[3:])}) - avg({n2(*RC[3:])})"


@query(
    "rotation_asymmetry",
    f"WITH frames AS ({frames_sql(LC[3:] + RC[3:])}) SELECT subject_id, task, {sql_round(_RASYM)} FROM frames GROUP BY ALL",
)
def rotation_asymmetry(spark, sf):
    return rounded(features.rotation_asymmetry(frames(spark, sf, LC[3:] + RC[3:])))


_ROM = {}
for _s in SENSORS:
    for _p, _c in zip(PLANES, axes(_s, "rot")):
        _ROM |= {
            f"{_s}_{_p}_rom": _rng(_c), f"{_s}_{_p}_mean": f"avg({_c})", f"{_s}_{_p}_max": f"max({_c})",
            f"{_s}_{_p}_min": f"min({_c})", f"{_s}_{_p}_std": f"stddev_pop({_c})",
        }
ROTS = [c for s in SENSORS for c in axes(s, "rot")]


@query("range_of_motion", f"WITH frames AS ({frames_sql(ROTS)}) SELECT subject_id, task, {sql_round(_ROM)} FROM frames GROUP BY ALL")
def range_of_motion(spark, sf):
    return rounded(features.range_of_motion(frames(spark, sf, ROTS)))


def _grad_sql(out: str, c: str) -> str:
    return (
        f"coalesce((lead({c}) OVER w - lag({c}) OVER w) / 0.04, (lead({c}) OVER w - {c}) / 0.02, "
        f"({c} - lag({c}) OVER w) / 0.02) AS {out}"
    )


HR = axes("Head", "rot")
_KIN = {}
for _p, _c in zip(PLANES, HR):
    _KIN |= {
        f"{_p}_rom": _rng(_c), f"{_p}_max_angle": f"max({_c})", f"{_p}_min_angle": f"min({_c})",
        f"{_p}_mean_angle": f"avg({_c})", f"{_p}_std_angle": f"stddev_pop({_c})",
        f"{_p}_peak_angular_velocity": f"max(abs(v_{_p}))", f"{_p}_mean_angular_velocity": f"avg(abs(v_{_p}))",
        f"{_p}_std_angular_velocity": f"stddev_pop(v_{_p})", f"{_p}_peak_angular_acceleration": f"max(abs(a_{_p}))",
        f"{_p}_mean_angular_acceleration": f"avg(abs(a_{_p}))",
    }
_KIN |= {
    "rotation_magnitude_mean": f"avg({n2(*HR)})",
    "rotation_magnitude_std": f"stddev_pop({n2(*HR)})",
    "rotation_magnitude_max": f"max({n2(*HR)})",
}


# Every sensor's angles under the head's names, a row per frame and sensor.
SENSOR_SQL = " UNION ALL ".join(
    f"SELECT subject_id, task, frame_idx, '{s}' AS sensor, {', '.join(f'{c} AS {h}' for c, h in zip(axes(s, 'rot'), HR))} FROM wide" for s in SENSORS
)
_W3 = "WINDOW w AS (PARTITION BY subject_id, task, sensor ORDER BY frame_idx)"


@query(
    "rotation_kinematics",
    f"""WITH wide AS ({frames_sql(ROTS)}), frames AS ({SENSOR_SQL}), v AS (SELECT *, {", ".join(_grad_sql(f"v_{p}", c) for p, c in zip(PLANES, HR))} FROM frames {_W3}),
    a AS (SELECT *, {", ".join(_grad_sql(f"a_{p}", f"v_{p}") for p in PLANES)} FROM v {_W3})
    SELECT subject_id, task, sensor, {sql_round(_KIN, 3)} FROM a GROUP BY subject_id, task, sensor""",
)
def rotation_kinematics(spark, sf):
    sensors = F.array(*[F.struct(F.lit(s).alias("sensor"), *[F.col(c).alias(h) for c, h in zip(axes(s, "rot"), HR)]) for s in SENSORS])
    x = frames(spark, sf, ROTS).select(*RECORDING, "frame_idx", F.inline(sensors))
    return rounded(features.rotation_kinematics(x, "Head", [*RECORDING, "sensor"]), 3, [*RECORDING, "sensor"])


_ANG = {}
for _n, (_ref, _tgt) in FUNCTIONAL_PAIRS.items():
    _dx, _dy, _dz = (f"({t} - {r})" for r, t in zip(axes(_ref, "pos"), axes(_tgt, "pos")))
    _ANG |= {
        f"{_n}_elevation": f"degrees(atan2({_dz}, {n2(_dx, _dy)}))",
        f"{_n}_azimuth": f"degrees(atan2({_dy}, {_dx}))",
        f"{_n}_distance": n2(_dx, _dy, _dz),
        f"{_n}_orientation": f"{axes(_tgt, 'rot')[2]} - {axes(_ref, 'rot')[2]}",
    }
ANGLE_CH = POS + [axes(s, "rot")[2] for s in SENSORS]


@query(
    "functional_angles",
    f"WITH frames AS ({frames_sql(ANGLE_CH)}) SELECT subject_id, task, frame_idx, {sql_round(_ANG)} FROM frames",
)
def functional_angles(spark, sf):
    x = frames(spark, sf, ANGLE_CH)
    return x.select(*RECORDING, "frame_idx", *[rnd(e).alias(n) for n, e in features.functional_angles().items()])


# The eight-sensor layout needs more sensors than the frame stream has; the extra five reuse its channels.
EIGHT = {
    "Back": ["head_pos_x", "left_hand_pos_y", "right_hand_pos_z"], "Head": axes("Head", "pos"),
    "LeftHand": axes("LeftHand", "pos"), "RightHand": axes("RightHand", "pos"),
    "LeftHip": ["left_hand_pos_x", "head_pos_y", "head_pos_z"], "RightHip": ["right_hand_pos_x", "head_pos_y", "left_hand_pos_z"],
    "LeftKnee": ["head_pos_x", "right_hand_pos_y", "left_hand_pos_z"], "RightKnee": ["left_hand_pos_x", "right_hand_pos_y", "head_pos_z"],
}
EIGHT_ROT = {s: ROTS[i % len(ROTS)] for i, s in enumerate(EIGHT)}
_ANAT = {}
for _n, (_ref, _tgt) in features.ANATOMICAL_PAIRS.items():
    _dx, _dy, _dz = (f"({t} - {r})" for r, t in zip(EIGHT[_ref], EIGHT[_tgt]))
    _ANAT |= {
        f"{_n}_flexion": f"degrees(atan2({_dz}, {_dy}))",
        f"{_n}_abduction": f"degrees(atan2({_dx}, {_dz}))",
        f"{_n}_rotation": f"{EIGHT_ROT[_tgt]} - {EIGHT_ROT[_ref]}",
    }


@query(
    "anatomical_angles",
    f"WITH frames AS ({frames_sql()}) SELECT subject_id, task, {', '.join(f'round(avg({e}), 5) + 0 AS {n}' for n, e in _ANAT.items())} FROM frames GROUP BY ALL",
)
def anatomical_angles(spark, sf):
    angles = features.anatomical_angles(EIGHT, EIGHT_ROT)
    return frames(spark, sf).groupBy(*RECORDING).agg(*[rnd(F.avg(e), 5).alias(n) for n, e in angles.items()])


@query(
    "velocity_acceleration",
    f"""WITH frames AS ({frames_sql(POS)}) SELECT subject_id, task, frame_idx,
      {", ".join(f"round(({c} - lag({c}) OVER w) * 50, 5) + 0 AS {c}_vel, round((({c} - lag({c}) OVER w) - (lag({c}) OVER w - lag({c}, 2) OVER w)) * 2500, 4) + 0 AS {c}_acc" for c in POS)}
    FROM frames {W}""",
)
def velocity_acceleration(spark, sf):
    out = features.derivatives(frames(spark, sf, POS), POS)
    return out.select(
        *RECORDING,
        "frame_idx",
        *[rnd(f"{c}_{k}", d).alias(f"{c}_{k}") for c in POS for k, d in (("vel", 5), ("acc", 4))],
    )


_BIO = {}
for _n in _ANG:
    _BIO |= {
        f"{_n}_rom": _rng(_n), f"{_n}_mean": f"avg({_n})", f"{_n}_std": f"stddev_pop({_n})", f"{_n}_max": f"max({_n})",
        f"{_n}_min": f"min({_n})", f"{_n}_mean_ang_vel": f"avg(abs({_n} - p_{_n}))", f"{_n}_max_ang_vel": f"max(abs({_n} - p_{_n}))",
    }
for _s in SENSORS:
    _v = n2(*[f"({c} - p_{c}) * 50" for c in axes(_s, "pos")])
    _BIO |= {f"{_s}_peak_vel": f"max({_v})", f"{_s}_mean_vel": f"avg({_v})"}
_BIO["trial_duration"] = "(max(frame_idx) - min(frame_idx)) / 5e1"
BIO_SQL = (
    f"frames AS ({frames_sql(ANGLE_CH)}), ang AS (SELECT *, {', '.join(f'{e} AS {n}' for n, e in _ANG.items())} FROM frames), "
    f"prev AS (SELECT *, {', '.join(f'lag({c}) OVER w AS p_{c}' for c in [*POS, *_ANG])} FROM ang {W})"
)


@query("biomechanics", f"WITH {BIO_SQL} SELECT subject_id, task, {sql_round(_BIO, 5)} FROM prev GROUP BY ALL")
def biomechanics(spark, sf):
    return rounded(features.biomechanics(frames(spark, sf, ANGLE_CH)), 5)


# ---------------------------------------------------------------- complexity

LAGS_SQL = """lags AS (SELECT *, lag(value) OVER c AS l1, lag(value, 2) OVER c AS l2 FROM lng
  WINDOW c AS (PARTITION BY subject_id, task, channel ORDER BY frame_idx))"""


@query(
    "permutation_entropy",
    f"""WITH {SIGNALS_SQL}, {long_sql(MAGS)}, {LAGS_SQL}, p AS (SELECT subject_id, task, channel,
      CAST(l2 <= l1 AS INT) + 2 * CAST(l1 <= value AS INT) + 4 * CAST(l2 <= value AS INT) AS pattern, CAST(count(*) AS DOUBLE) AS n
      FROM lags WHERE l2 IS NOT NULL GROUP BY ALL)
    SELECT subject_id, task, channel, round((log2(sum(n)) - sum(n * log2(n)) / sum(n)) / log2(6), 6) + 0 AS perm_entropy FROM p GROUP BY ALL""",
)
def permutation_entropy(spark, sf):
    return rounded(complexity.permutation_entropy(signals(spark, sf), MAGS))


@query(
    "svd_entropy",
    f"""WITH {SIGNALS_SQL}, {long_sql(MAGS)}, {LAGS_SQL}, g AS (SELECT subject_id, task, channel, sum(l2 * l2) AS a, sum(l1 * l1) AS b, sum(value * value) AS c,
      sum(l2 * l1) AS d, sum(l2 * value) AS e, sum(l1 * value) AS f FROM lags WHERE l2 IS NOT NULL GROUP BY ALL),
    q AS (SELECT *, (a + b + c) / 3 AS q FROM g),
    p AS (SELECT *, sqrt((pow(a - q, 2) + pow(b - q, 2) + pow(c - q, 2) + 2 * (d * d + e * e + f * f)) / 6) AS p FROM q),
    r AS (SELECT *, CASE WHEN p = 0 THEN 0 ELSE ((a - q) * ((b - q) * (c - q) - f * f) - d * (d * (c - q) - f * e) + e * (d * f - (b - q) * e)) / (2 * pow(p, 3)) END AS r FROM p),
    e AS (SELECT *, q + 2 * p * cos(acos(greatest(least(r, 1), -1)) / 3) AS e1, q + 2 * p * cos(acos(greatest(least(r, 1), -1)) / 3 + 2 * pi() / 3) AS e3 FROM r),
    s AS (SELECT *, sqrt(greatest(e1, 0)) AS s1, sqrt(greatest(3 * q - e1 - e3, 0)) AS s2, sqrt(greatest(e3, 0)) AS s3 FROM e),
    n AS (SELECT *, s1 / (s1 + s2 + s3) AS p1, s2 / (s1 + s2 + s3) AS p2, s3 / (s1 + s2 + s3) AS p3 FROM s)
    SELECT subject_id, task, channel, round(-(CASE WHEN p1 > 0 THEN p1 * log2(p1) ELSE 0 END + CASE WHEN p2 > 0 THEN p2 * log2(p2) ELSE 0 END
      + CASE WHEN p3 > 0 THEN p3 * log2(p3) ELSE 0 END) / log2(3), 5) + 0 AS svd_entropy FROM n""",
)
def svd_entropy(spark, sf):
    return rounded(complexity.svd_entropy(signals(spark, sf), MAGS), 5)


@query(
    "hjorth_parameters",
    f"""WITH {SIGNALS_SQL}, {long_sql(MAGS)}, {LAGS_SQL}, v AS (SELECT subject_id, task, channel, var_pop(value) AS v0, var_pop(value - l1) AS v1,
      var_pop(value - 2 * l1 + l2) AS v2 FROM lags GROUP BY ALL)
    SELECT subject_id, task, channel, round(v0, 6) + 0 AS hjorth_activity, round(sqrt(v1 / v0), 6) AS hjorth_mobility,
      round(sqrt(v2 / v1) / sqrt(v1 / v0), 6) AS hjorth_complexity FROM v""",
)
def hjorth_parameters(spark, sf):
    return rounded(complexity.hjorth(signals(spark, sf), MAGS))


@query(
    "detrended_fluctuation",
    f"""WITH {SIGNALS_SQL}, {long_sql(MAGS)}, c AS (SELECT *, value - avg(value) OVER p AS dev, count(*) OVER p AS n FROM lng
      WINDOW p AS (PARTITION BY subject_id, task, channel)),
    walk AS (SELECT *, sum(dev) OVER (PARTITION BY subject_id, task, channel ORDER BY frame_idx ROWS UNBOUNDED PRECEDING) AS y FROM c WHERE n * 0.1 >= 4),
    ns AS (SELECT DISTINCT n FROM walk),
    sizes AS (SELECT DISTINCT n, CAST(floor(4 * pow(1.2, i)) AS BIGINT) AS size FROM (SELECT n, unnest(range(0, CAST(floor(ln(n * 0.1 / 4) / ln(1.2)) AS BIGINT) + 1)) AS i FROM ns)),
    boxes AS (SELECT subject_id, task, channel, size, frame_idx // size AS box, var_pop(y) AS vy, var_pop(frame_idx % size) AS vt, covar_pop(frame_idx % size, y) AS cv
      FROM walk JOIN sizes USING (n) WHERE frame_idx < n - n % size GROUP BY ALL),
    fl AS (SELECT subject_id, task, channel, size, avg(sqrt(greatest(vy - cv * cv / vt, 0))) AS f FROM boxes GROUP BY ALL HAVING f > 0)
    SELECT subject_id, task, channel, round(CASE WHEN var_pop(ln(size)) = 0 THEN NULL ELSE covar_pop(ln(size), ln(f)) / var_pop(ln(size)) END, 5) + 0 AS dfa FROM fl GROUP BY ALL""",
)
@counted_once
def detrended_fluctuation(spark, sf):
    return rounded(complexity.detrended_fluctuation(signals(spark, sf), MAGS), 5)


@query(
    "fractal_dimensions",
    f"""WITH {SIGNALS_SQL}, {long_sql(MAGS)}, {LAGS_SQL}, z AS (SELECT *, first_value(value) OVER (PARTITION BY subject_id, task, channel ORDER BY frame_idx) AS x0 FROM lags),
    a AS (SELECT subject_id, task, channel, CAST(count(*) AS DOUBLE) AS n, sum(CASE WHEN (value - l1 < 0) <> (l1 - l2 < 0) THEN 1 ELSE 0 END) AS flips,
      sum(abs(value - l1)) AS len, max(abs(value - x0)) AS d FROM z GROUP BY ALL)
    SELECT subject_id, task, channel, round(log10(n) / (log10(n) + log10(n / (n + 0.4 * flips))), 6) AS petrosian_fd,
      round(log10(n - 1) / (log10(d / len) + log10(n - 1)), 6) AS katz_fd FROM a""",
)
def fractal_dimensions(spark, sf):
    return rounded(complexity.fractal_dimensions(signals(spark, sf), MAGS))


@query(
    "higuchi_dimension",
    f"""WITH {SIGNALS_SQL}, {long_sql(MAGS)}, x AS (SELECT *, count(*) OVER (PARTITION BY subject_id, task, channel) AS n FROM lng),
    s AS (SELECT a.subject_id, a.task, a.channel, k, a.n, a.frame_idx, abs(a.value - b.value) AS step FROM x a, range(1, 11) r(k), x b
      WHERE b.subject_id = a.subject_id AND b.task = a.task AND b.channel = a.channel AND b.frame_idx = a.frame_idx - k),
    l AS (SELECT subject_id, task, channel, k, sum(step * (n - 1) / (k * k * ((n - frame_idx % k - 1) // k))) / max(k) AS lk FROM s
      WHERE frame_idx // k <= (n - frame_idx % k - 1) // k - 1 GROUP BY ALL)
    SELECT subject_id, task, channel, round(covar_pop(-ln(k), ln(lk)) / var_pop(-ln(k)), 5) AS higuchi_fd FROM l GROUP BY ALL""",
)
def higuchi_dimension(spark, sf):
    return rounded(complexity.higuchi(signals(spark, sf), MAGS), 5)


# ---------------------------------------------------------------- assembly and summaries


def long_table(spark, sf):
    """Long features of two modules for the summary operators."""
    x = frames(spark, sf, HAND_POS)
    grp = F.when(F.col("subject_id").startswith("fx"), "control").otherwise("patient")
    parts = [
        features.wide_to_long(features.time_domain(x, HAND_POS[:2])),
        features.wide_to_long(features.position_asymmetry(x), prefix="hand_"),
    ]
    return features.combined(parts).filter("value IS NOT NULL").withColumn("grp", grp)


TD_SRC = f"series AS (SELECT subject_id, task, frame_idx, channel, value FROM frames UNPIVOT (value FOR channel IN ({', '.join(HAND_POS[:2])})))"
LONG_SQL = f"""frames AS ({frames_sql(HAND_POS)}), d AS (SELECT *, {", ".join(f"{c} - lag({c}) OVER w AS d_{c}" for c in HAND_POS)} FROM frames {W}),
  pa AS (SELECT subject_id, task, {", ".join(f"{e} AS {n}" for n, e in _PASYM.items())} FROM d GROUP BY ALL), {TD_SRC},
  {time_domain_sql("series", "subject_id, task")},
  longf AS (SELECT subject_id, task, CASE WHEN subject_id LIKE 'fx%' THEN 'control' ELSE 'patient' END AS grp, feature, value FROM (
    SELECT subject_id, task, concat('ext_', channel, '_', feature) AS feature, value FROM feats UNPIVOT (value FOR feature IN ({", ".join(features.TIME_DOMAIN)}))
    UNION ALL SELECT subject_id, task, concat('ext_hand_', feature), value FROM pa UNPIVOT (value FOR feature IN ({", ".join(_PASYM)}))))"""


@query(
    "feature_table_pivot",
    f"""WITH {LONG_SQL} SELECT subject_id, task, {", ".join(f"round(max(value) FILTER (WHERE feature = 'ext_hand_{n}'), 5) + 0 AS ext_hand_{n}" for n in list(_PASYM)[:4])}
    FROM longf GROUP BY ALL""",
)
def feature_table_pivot(spark, sf):
    names = [f"ext_hand_{n}" for n in list(_PASYM)[:4]]
    return rounded(features.pivot_features(long_table(spark, sf), names), 5)


@query(
    "group_summary",
    f"""WITH {LONG_SQL} SELECT feature, grp, round(quantile_cont(value, 0.5), 5) + 0 AS median, round(avg(value), 5) + 0 AS mean,
      round(stddev_samp(value), 5) + 0 AS std, round(min(value), 5) + 0 AS min, round(max(value), 5) + 0 AS max, count(*) AS n FROM longf GROUP BY ALL""",
)
def group_summary(spark, sf):
    out = features.group_summary(long_table(spark, sf))
    return out.select("feature", "grp", "n", *[rnd(c, 5).alias(c) for c in ("median", "mean", "std", "min", "max")])


@query(
    "cohens_d",
    f"""WITH {LONG_SQL}, m AS (SELECT feature, avg(value) FILTER (WHERE grp = 'patient') AS m1, stddev_samp(value) FILTER (WHERE grp = 'patient') AS s1,
      avg(value) FILTER (WHERE grp = 'control') AS m0, stddev_samp(value) FILTER (WHERE grp = 'control') AS s0 FROM longf GROUP BY ALL)
    SELECT feature, CASE WHEN feature LIKE 'ext_hand_%' THEN 'asymmetry' ELSE 'temporal/other' END AS module, round(m1, 5) + 0 AS mean_case, round(m0, 5) + 0 AS mean_control,
      round((m1 - m0) / sqrt((s1 * s1 + s0 * s0) / 2 + 1e-10), 5) + 0 AS cohens_d FROM m""",
)
def cohens_d(spark, sf):
    out = features.cohens_d(long_table(spark, sf), "patient", "control")
    return out.select("feature", "module", *[rnd(c, 5).alias(c) for c in ("mean_case", "mean_control", "cohens_d")])


@query(
    "zscore_flags",
    f"""WITH {LONG_SQL}, z AS (SELECT *, CASE WHEN stddev_pop(value) OVER p <= 1e-12 THEN 0 ELSE (value - avg(value) OVER p) / stddev_pop(value) OVER p END AS z
      FROM longf WINDOW p AS (PARTITION BY grp, task, feature))
    SELECT subject_id, task, feature, CASE WHEN z > 1.5 THEN 'high' WHEN z < -1.5 THEN 'low' WHEN abs(z) < 0.25 THEN 'near_mean' END AS flag FROM z""",
)
def zscore_flags(spark, sf):
    z = features.group_zscores(long_table(spark, sf), ["grp", "task"])
    return z.select(*RECORDING, "feature", features.zscore_flag().alias("flag"))


@query(
    "score_sheet",
    f"""WITH px AS ({SUBJECTS_SQL}), frames AS ({frames_sql(CHANNELS[:1])}), r AS (SELECT DISTINCT subject_id, task FROM frames),
    j AS (SELECT r.*, CASE task WHEN 1 THEN c_dash WHEN 2 THEN x_dash WHEN 3 THEN c_and_x END AS s FROM r LEFT JOIN px ON px.id = r.subject_id)
    SELECT subject_id, round(max(s) FILTER (WHERE task = 1), 5) AS q1, round(max(s) FILTER (WHERE task = 2), 5) AS q2,
      round(max(s) FILTER (WHERE task = 3), 5) AS q3 FROM j GROUP BY ALL""",
)
def score_sheet(spark, sf):
    from kinelake.operators import cohort

    rows = frames(spark, sf, CHANNELS[:1]).groupBy(*RECORDING).agg(F.count(F.lit(1)).alias("n"))
    meta = subjects(spark, sf).select("id", "c_dash", "x_dash", "c_and_x")
    scored = cohort.attach_metadata(rows, meta, {1: "c_dash", 2: "x_dash", 3: "c_and_x"})
    return rounded(features.score_sheet(scored, {1: "q1", 2: "q2", 3: "q3"}), 5, ids=["subject_id"])


@query(
    "box_statistics",
    f"""WITH {SIGNALS_SQL}, {long_sql(MAGS)}, q AS (SELECT channel, grp, quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.5) AS median,
      quantile_cont(value, 0.75) AS q3 FROM lng GROUP BY ALL)
    SELECT channel, l.grp, round(any_value(q1), 6) AS q1, round(any_value(median), 6) AS median, round(any_value(q3), 6) AS q3,
      round(min(value) FILTER (WHERE value BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1)), 6) AS whisker_low,
      round(max(value) FILTER (WHERE value BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1)), 6) AS whisker_high,
      CAST(sum(CASE WHEN value BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1) THEN 0 ELSE 1 END) AS BIGINT) AS n_outliers
    FROM lng l JOIN q USING (channel, grp) GROUP BY ALL""",
)
def box_statistics(spark, sf):
    x = signals(spark, sf).withColumn("grp", F.when(F.col("subject_id").startswith("fx"), "control").otherwise("patient"))
    long = x.unpivot(["grp"], MAGS, "channel", "value")
    return rounded(features.box_statistics(long, ["channel", "grp"]), 6, ids=["channel", "grp", "n_outliers"])


@query(
    "speed_histogram",
    f"""WITH {SIGNALS_SQL}, e AS (SELECT min(Head_mag) AS lo, max(Head_mag) AS hi FROM sig)
    SELECT grp, CAST(least(floor((Head_mag - lo) * 20 / (hi - lo)), 19) AS INT) AS bin, count(*) AS n FROM sig, e GROUP BY ALL""",
)
def speed_histogram(spark, sf):
    x = signals(spark, sf).withColumn("grp", F.when(F.col("subject_id").startswith("fx"), "control").otherwise("patient"))
    return features.histogram(x, "Head_mag", 20, ["grp"])
