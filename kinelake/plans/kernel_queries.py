"""Queries for spectra, filters, splines, warps, peaks, wavelets, entropies and DTW."""

from __future__ import annotations

from pyspark.sql import functions as F

from kinelake.config import RECORDING
from kinelake.functions import kernels
from kinelake.functions.expr import rnd, unit_sql
from kinelake.operators import kernel_ops as ko
from kinelake.operators import spectral
from kinelake.plans.evaluation_queries import rounded
from kinelake.plans.feature_queries import MAGS, SIGNALS_SQL, SPEEDS, long_sql, signals
from kinelake.plans.fixtures import counted_once, frames, frames_sql, table
from kinelake.plans.registry import query

CH = ["head_pos_x", "head_rot_x"]
PART = "subject_id, task, channel"


def series(spark, sf, cols):
    return spectral.finite_series(signals(spark, sf).select(*RECORDING, "frame_idx", *cols), cols)


def welch_sql(cols: list[str]) -> str:
    """CTE ``psd`` for the listed signals: every 256-sample (or whole-series) segment as a direct DFT."""
    return f"""{SIGNALS_SQL}, {long_sql(cols)},
    st AS (SELECT {PART}, count(*) AS n, least(count(*), 256) AS w FROM lng GROUP BY {PART} HAVING count(*) >= 10 AND stddev_pop(value) >= 1e-10),
    sg AS (SELECT *, unnest(range(0, (n - w) // (w - w // 2) + 1)) AS seg FROM st),
    sx AS (SELECT {", ".join("s." + c for c in PART.split(", "))}, s.seg, s.w, l.frame_idx - s.seg * (s.w - s.w // 2) AS i, l.value
      FROM sg s JOIN lng l ON l.subject_id = s.subject_id AND l.task = s.task AND l.channel = s.channel
      AND l.frame_idx >= s.seg * (s.w - s.w // 2) AND l.frame_idx < s.seg * (s.w - s.w // 2) + s.w),
    wx AS (SELECT *, (value - avg(value) OVER (PARTITION BY {PART}, seg)) * (0.5 - 0.5 * cos(2 * pi() * i / w)) AS v,
      sum(pow(0.5 - 0.5 * cos(2 * pi() * i / w), 2)) OVER (PARTITION BY {PART}, seg) AS u FROM sx),
    bins AS (SELECT w, unnest(range(0, w // 2 + 1)) AS bin FROM (SELECT DISTINCT w FROM st)),
    sp AS (SELECT {PART}, seg, bin, any_value(w) AS w, any_value(u) AS u, sum(v * cos(2 * pi() * bin * i / w)) AS re, sum(v * sin(2 * pi() * bin * i / w)) AS im
      FROM wx JOIN bins USING (w) GROUP BY {PART}, seg, bin),
    psd AS (SELECT {PART}, bin, any_value(bin * (1e0 / (w * 2e-2))) AS freq,
      avg((re * re + im * im) / (50 * u) * CASE WHEN bin = 0 OR bin * 2 = w THEN 1 ELSE 2 END) AS power FROM sp GROUP BY {PART}, bin)"""


@query("welch_spectrum", f"WITH {welch_sql(MAGS)} SELECT {PART}, bin, round(freq, 6) AS freq, round(power, 7) + 0 AS power FROM psd")
@counted_once
def welch_spectrum(spark, sf):
    p = spectral.welch(series(spark, sf, MAGS))
    return p.select(*RECORDING, "channel", "bin", rnd("freq").alias("freq"), rnd("power", 7).alias("power"))


_W = f"(PARTITION BY {PART} ORDER BY bin)"
FEAT = f"""t AS (SELECT *, sum(power) OVER p AS tot, sum(power) OVER {_W} AS cum, sum(freq * power) OVER p / (sum(power) OVER p + 1e-10) AS mf,
    power / (sum(power) OVER p + 1e-10) AS pn, avg(power) OVER p AS m, var_pop(power) OVER p AS vp, count(*) OVER p AS nb FROM psd WINDOW p AS (PARTITION BY {PART})),
  f AS (SELECT *, lag(pn) OVER {_W} AS pp FROM t)"""
_BAND = ", ".join(
    f"round(coalesce(sum(power) FILTER (WHERE freq >= {a} AND freq <= {b}), 0), 6) AS spectral_energy_{n}" for n, (a, b) in spectral.BANDS.items()
)


@query(
    "spectral_features",
    f"""WITH {welch_sql(MAGS)}, {FEAT} SELECT {PART}, round(sum(power), 6) AS spectral_energy_total, round(arg_min(freq, -power), 6) AS dominant_frequency,
      round(max(power), 6) AS dominant_frequency_magnitude, {_BAND}, round(any_value(mf), 5) AS mean_frequency,
      round(min(freq) FILTER (WHERE cum >= tot / 2), 6) AS median_frequency, round(sqrt(sum(pow(freq - mf, 2) * power) / (sum(power) + 1e-10)), 5) AS spectral_spread,
      round(-sum(pn * log2(pn + 1e-10)), 5) AS spectral_entropy, round(any_value(mf), 5) AS spectral_centroid, round(min(freq) FILTER (WHERE cum >= 0.95 * tot), 6) AS spectral_rolloff,
      round(avg(pow(power - m, 4)) / pow(any_value(vp), 2) - 3, 4) + 0 AS spectral_kurtosis, round(avg(pow(power - m, 3)) / pow(any_value(vp), 1.5), 4) + 0 AS spectral_skewness,
      round(-sum(CASE WHEN power > 0 THEN power / tot * log2(power / tot) ELSE 0 END) / log2(any_value(nb)), 5) AS spectral_entropy_normalised FROM f GROUP BY {PART}""",
)
@counted_once
def spectral_features(spark, sf):
    x = spectral.spectral_features(spectral.welch(series(spark, sf, MAGS))).drop("sparc")
    five = ["mean_frequency", "spectral_spread", "spectral_entropy", "spectral_centroid", "spectral_entropy_normalised"]
    four = ["spectral_kurtosis", "spectral_skewness"]
    rest = [c for c in x.columns if c not in (*RECORDING, "channel", *five, *four)]
    return x.select(
        *RECORDING, "channel", *[rnd(c, d).alias(c) for cs, d in ((rest, 6), (five, 5), (four, 4)) for c in cs]
    )


@query(
    "spectral_arc_length",
    f"WITH {welch_sql(SPEEDS)}, {FEAT} SELECT {PART}, round(-sum(sqrt(1 + pow(pn - pp, 2))), 6) AS sparc FROM f GROUP BY {PART}",
)
@counted_once
def spectral_arc_length(spark, sf):
    x = spectral.spectral_features(spectral.welch(series(spark, sf, SPEEDS)))
    return x.select(*RECORDING, "channel", rnd("sparc").alias("sparc"))


@query(
    "fft_magnitude",
    f"""WITH {SIGNALS_SQL}, {long_sql(MAGS)}, st AS (SELECT {PART}, count(*) AS n FROM lng GROUP BY {PART}), bins AS (SELECT n, unnest(range(0, n // 2)) AS bin FROM (SELECT DISTINCT n FROM st)),
    d AS (SELECT {PART}, bin, sqrt(pow(sum(value * cos(2 * pi() * ((bin * frame_idx) % n) / n)), 2) + pow(sum(value * sin(2 * pi() * ((bin * frame_idx) % n) / n)), 2)) AS mag
      FROM lng JOIN st USING ({PART}) JOIN bins USING (n) GROUP BY {PART}, bin)
    SELECT {PART}, round(max(mag), 5) AS fft_max_magnitude, round(avg(mag), 5) AS fft_mean_magnitude FROM d GROUP BY {PART}""",
)
def fft_magnitude(spark, sf):
    return rounded(spectral.fft_magnitude(series(spark, sf, MAGS)), *RECORDING, "channel", digits=5)




@query(
    "max_cross_correlation",
    f"""WITH {SIGNALS_SQL}, c AS (SELECT subject_id, task, frame_idx, count(*) OVER p AS n, LeftHand_mag - avg(LeftHand_mag) OVER p AS a,
      RightHand_mag - avg(RightHand_mag) OVER p AS v FROM sig WINDOW p AS (PARTITION BY subject_id, task)),
    l AS (SELECT x.subject_id, x.task, x.frame_idx - y.frame_idx AS lag, sum(x.a * y.v) AS s FROM c x JOIN c y ON x.subject_id = y.subject_id AND x.task = y.task
      AND x.frame_idx - y.frame_idx >= -(x.n // 2) AND x.frame_idx - y.frame_idx <= x.n - 1 - x.n // 2 GROUP BY ALL)
    SELECT subject_id, task, round(max(s), 5) + 0 AS max_cross_correlation FROM l GROUP BY ALL""",
)
def max_cross_correlation(spark, sf):
    x = signals(spark, sf).select(*RECORDING, "frame_idx", "LeftHand_mag", "RightHand_mag")
    return rounded(spectral.max_cross_correlation(x, "LeftHand_mag", "RightHand_mag"), *RECORDING, digits=5)


@query(
    "fourier_resample",
    f"""WITH frames AS ({frames_sql(CH)}), lng AS (SELECT subject_id, task, frame_idx, channel, value FROM frames UNPIVOT (value FOR channel IN ({", ".join(CH)}))),
    st AS (SELECT subject_id, task, count(*) AS n, count(*) // 2 AS num FROM frames GROUP BY ALL), bins AS (SELECT n, unnest(range(0, n // 4 + 1)) AS bin FROM (SELECT DISTINCT n FROM st)),
    sp AS (SELECT subject_id, task, channel, bin, any_value(n) AS n, any_value(num) AS num, sum(value * cos(2 * pi() * bin * frame_idx / n)) AS re,
      -sum(value * sin(2 * pi() * bin * frame_idx / n)) AS im FROM lng JOIN st USING (subject_id, task) JOIN bins USING (n) GROUP BY subject_id, task, channel, bin),
    o AS (SELECT subject_id, task, unnest(range(0, num)) AS frame_idx FROM st),
    y AS (SELECT o.subject_id, o.task, o.frame_idx, channel, sum(CASE WHEN bin = 0 THEN re WHEN 2 * bin = num THEN 2 * re * cos(2 * pi() * bin * o.frame_idx / num)
      ELSE 2 * (re * cos(2 * pi() * bin * o.frame_idx / num) - im * sin(2 * pi() * bin * o.frame_idx / num)) END) / any_value(n) AS v
      FROM o JOIN sp ON sp.subject_id = o.subject_id AND sp.task = o.task GROUP BY o.subject_id, o.task, o.frame_idx, channel)
    SELECT subject_id, task, frame_idx, {", ".join(f"round(max(v) FILTER (WHERE channel = '{c}'), 6) + 0 AS {c}" for c in CH)} FROM y GROUP BY ALL""",
)
def fourier_resample(spark, sf):
    return rounded(spectral.resample(frames(spark, sf, CH), CH, 2.0), *RECORDING, "frame_idx")


@query(
    "spectrogram_table",
    f"""WITH {SIGNALS_SQL}, m AS (SELECT subject_id, task, frame_idx, channel, mag FROM sig UNPIVOT (mag FOR channel IN ({", ".join(MAGS)}))),
    st AS (SELECT subject_id, task, count(*) AS n FROM sig GROUP BY ALL), sg AS (SELECT *, unnest(range(0, (n - 64) // 32 + 1)) AS seg FROM st WHERE n >= 64),
    wx AS (SELECT s.subject_id, s.task, s.seg, l.channel, l.frame_idx - s.seg * 32 AS i, (mag - avg(mag) OVER p) * (0.5 - 0.5 * cos(2 * pi() * (l.frame_idx - s.seg * 32) / 64)) AS v
      FROM sg s JOIN m l ON l.subject_id = s.subject_id AND l.task = s.task AND l.frame_idx >= s.seg * 32 AND l.frame_idx < s.seg * 32 + 64
      WINDOW p AS (PARTITION BY s.subject_id, s.task, s.seg, l.channel)),
    sp AS (SELECT subject_id, task, channel, seg, bin, pow(sum(v * cos(2 * pi() * bin * i / 64)), 2) + pow(sum(v * sin(2 * pi() * bin * i / 64)), 2) AS p FROM wx, range(0, 33) b(bin) GROUP BY ALL)
    SELECT subject_id, task, channel, (seg * 32 + 32) / 5e1 AS t, bin * 50 / 64.0::DOUBLE AS freq, round(p / (50 * 24.0) * CASE WHEN bin IN (0, 32) THEN 1 ELSE 2 END, 7) + 0 AS power FROM sp""",
)
def spectrogram_table(spark, sf):
    by = [*RECORDING, "channel"]
    x = signals(spark, sf).unpivot([*RECORDING, "frame_idx"], MAGS, "channel", "value")
    return spectral.spectrogram(x, "value", by).select(*by, "t", "freq", rnd("power", 7).alias("power"))


@query("butterworth_low_pass")
@counted_once
def butterworth_low_pass(spark, sf):
    return rounded(ko.butterworth_filter(frames(spark, sf, CH), CH, "low", 6.0), *RECORDING, "frame_idx")


@query("butterworth_high_pass")
@counted_once
def butterworth_high_pass(spark, sf):
    return rounded(ko.butterworth_filter(frames(spark, sf, CH), CH, "high", 1.0), *RECORDING, "frame_idx")


@query("butterworth_band_pass")
@counted_once
def butterworth_band_pass(spark, sf):
    return rounded(ko.butterworth_filter(frames(spark, sf, CH), CH, "band", [1.0, 6.0]), *RECORDING, "frame_idx")


@query("interpolate_cubic")
@counted_once
def interpolate_cubic(spark, sf):
    return rounded(ko.interpolate_spline(frames(spark, sf, CH), CH, 64, "cubic"), *RECORDING, "frame_idx")


@query("interpolate_quadratic")
@counted_once
def interpolate_quadratic(spark, sf):
    return rounded(ko.interpolate_spline(frames(spark, sf, CH), CH, 64, "quadratic"), *RECORDING, "frame_idx")


def curve_sql(sigma: float, knot: int, seed: int, floor: float | None) -> str:
    """CTEs ``fr`` (frames with T) and ``cv`` (frames with the smooth curve)."""
    coef = ko._curve_coefficients(knot + 2)
    draw = []
    for i in range(knot + 2):
        parts = ("subject_id", "CAST(task AS STRING)", f"'{i}'", f"'{seed}'")
        g = f"1 + {sigma} * (sqrt(-2 * ln({unit_sql(*parts)})) * cos(2 * pi() * {unit_sql(*parts, start=14)}))"
        draw.append(f"{g if floor is None else f'greatest({g}, {floor})'} AS d{i}")
    poly = []
    for m in range(knot + 1):
        terms = []
        for p in range(4):
            lin = " + ".join(f"({float(v)!r}::DOUBLE) * d{i}" for i, v in enumerate(coef[m][p]))
            terms.append(f"pow(u - {m}, {p}) * ({lin})")
        poly.append(f"WHEN {m} THEN {' + '.join(terms)}")
    return f"""frames AS ({frames_sql(CH)}), dr AS (SELECT subject_id, task, count(*) AS n, {", ".join(draw)} FROM frames GROUP BY subject_id, task),
    fr AS (SELECT f.*, n, {", ".join(f"d{i}" for i in range(knot + 2))}, f.frame_idx * {float(knot + 1)}::DOUBLE / greatest(n - 1, 1) AS u FROM frames f JOIN dr USING (subject_id, task)),
    cv AS (SELECT *, CASE CAST(least(floor(u), {knot}) AS INT) {" ".join(poly)} END AS curve FROM fr)"""


@query(
    "magnitude_warp",
    f"WITH {curve_sql(0.2, 4, 42, None)} SELECT subject_id, task, frame_idx, {', '.join(f'round({c} * curve, 6) + 0 AS {c}' for c in CH)} FROM cv",
)
def magnitude_warp(spark, sf):
    return rounded(ko.magnitude_warp(frames(spark, sf, CH).drop("t_s", "grp"), CH), *RECORDING, "frame_idx")


def time_warp_sql(seed: int) -> str:
    return f"""WITH {curve_sql(0.2, 4, seed, 0.1)}, c2 AS (SELECT *, greatest(curve, 0.01) AS cu FROM cv),
    cs AS (SELECT *, sum(cu) OVER (PARTITION BY subject_id, task ORDER BY frame_idx ROWS UNBOUNDED PRECEDING) AS s, sum(cu) OVER (PARTITION BY subject_id, task) AS tot,
      first_value(cu) OVER (PARTITION BY subject_id, task ORDER BY frame_idx) AS c0 FROM c2),
    w AS (SELECT *, CASE WHEN frame_idx = n - 1 THEN n - 1 ELSE (n - 1) * (s - c0) / (tot - c0) END AS w FROM cs),
    nx AS (SELECT *, lead(w) OVER o AS wn, {", ".join(f"lead({c}) OVER o AS n_{c}" for c in CH)} FROM w WINDOW o AS (PARTITION BY subject_id, task ORDER BY frame_idx)),
    g AS (SELECT subject_id, task, unnest(range(0, n)) AS j FROM dr)
    SELECT g.subject_id, g.task, j AS frame_idx, {", ".join(f"round(CASE WHEN wn IS NULL THEN {c} ELSE {c} + (n_{c} - {c}) * (j - w) / (wn - w) END, 5) + 0 AS {c}" for c in CH)}
    FROM g JOIN nx ON nx.subject_id = g.subject_id AND nx.task = g.task AND j >= ceil(w) AND (j < ceil(wn) OR (wn IS NULL AND j = n - 1))"""


@query("time_warp", time_warp_sql(42))
def time_warp(spark, sf):
    return rounded(ko.time_warp(frames(spark, sf, CH), CH), *RECORDING, "frame_idx", digits=5)


def _copy(no: int, method: str, sql: str) -> str:
    name = "subject_id" if no < 0 else f"concat(subject_id, '_aug{no}_{method[0].upper()}{method[1:]}')"
    return f"SELECT {name} AS sample_id, subject_id, task, '{method}' AS method, {no} AS copy_no, frame_idx, {', '.join(CH)} FROM ({sql})"


def _jitter_sql(seed: int) -> str:
    made = []
    for c in CH:
        parts = ("subject_id", "CAST(task AS STRING)", "CAST(frame_idx AS STRING)", f"'{c}'", f"'{seed}'")
        made.append(f"round({c} + 0.01 * (sqrt(-2 * ln({unit_sql(*parts)})) * cos(2 * pi() * {unit_sql(*parts, start=14)})), 5) + 0 AS {c}")
    return f"WITH frames AS ({frames_sql(CH)}) SELECT subject_id, task, frame_idx, {', '.join(made)} FROM frames"


def _rounded_sql(sql: str) -> str:
    return f"SELECT subject_id, task, frame_idx, {', '.join(f'round({c}, 5) + 0 AS {c}' for c in CH)} FROM ({sql})"


def _magnitude_sql(seed: int) -> str:
    return f"WITH {curve_sql(0.2, 4, seed, None)} SELECT subject_id, task, frame_idx, {', '.join(f'round({c} * curve, 5) + 0 AS {c}' for c in CH)} FROM cv"


_COPIES = [(-1, "original", _rounded_sql(frames_sql(CH)))]
_COPIES += [(3 * k + i, m, sql(42 + k + i)) for k in range(2) for i, (m, sql) in enumerate((("jitter", _jitter_sql), ("magnitude_warp", _magnitude_sql), ("time_warp", time_warp_sql)))]


@query("augmented_copies", " UNION ALL ".join(f"({_copy(*c)})" for c in _COPIES))
@counted_once
def augmented_copies(spark, sf):
    """Every recording with two rounds of jitter, magnitude warp and time warp: the values of all copies."""
    x = ko.augmented(frames(spark, sf, CH), CH, ["jitter", "magnitude_warp", "time_warp"], 2)
    return rounded(x, "sample_id", *RECORDING, "method", "copy_no", "frame_idx", digits=5)


def peaks_sql(name: str, sign: str) -> str:
    """CTE ``name``: peaks (or, with a minus, valleys) of head_step; the highest first, those closer than five frames dropped."""
    part = "PARTITION BY subject_id, task"
    return f"""{name}_v AS (SELECT subject_id, task, frame_idx, {sign}head_step AS v, {sign}avg(head_step) OVER ({part}) AS m FROM sig),
    {name}_run AS (SELECT * FROM (SELECT *, lag(v) OVER ({part} ORDER BY frame_idx) AS before FROM {name}_v) WHERE before IS NULL OR before <> v),
    {name}_top AS (SELECT *, lead(v) OVER o AS behind, lead(frame_idx) OVER o AS nxt FROM {name}_run WINDOW o AS ({part} ORDER BY frame_idx)),
    {name}_r AS (SELECT subject_id, task, (frame_idx + nxt - 1) // 2 AS peak, v AS height, row_number() OVER ({part} ORDER BY v DESC, frame_idx DESC) AS r
      FROM {name}_top WHERE before < v AND behind < v AND v >= m),
    {name}_k AS (SELECT subject_id, task, 0::BIGINT AS r, []::BIGINT[] AS kept FROM sig GROUP BY ALL UNION ALL
      SELECT k.subject_id, k.task, p.r, CASE WHEN len(list_filter(k.kept, lambda x: abs(x - p.peak) < 5)) = 0 THEN list_append(k.kept, p.peak) ELSE k.kept END
      FROM {name}_k k JOIN {name}_r p ON p.subject_id = k.subject_id AND p.task = k.task AND p.r = k.r + 1),
    {name}_last AS (SELECT subject_id, task, arg_max(kept, r) AS kept FROM {name}_k GROUP BY ALL),
    {name} AS (SELECT l.subject_id, l.task, p.peak, p.height FROM {name}_last l LEFT JOIN {name}_r p ON p.subject_id = l.subject_id AND p.task = l.task AND list_contains(l.kept, p.peak))"""


PEAK_SQL = f"""WITH RECURSIVE {SIGNALS_SQL}, {peaks_sql("top", "")}, {peaks_sql("low", "-")},
    gaps AS (SELECT *, (peak - lag(peak) OVER (PARTITION BY subject_id, task ORDER BY peak)) / 5e1 AS gap FROM top),
    a AS (SELECT subject_id, task, count(peak) AS num_peaks, avg(height) AS mean_peak_height, max(height) AS max_peak_height, stddev_pop(height) AS std_peak_height,
      avg(gap) AS mean_inter_peak_interval, stddev_pop(gap) AS std_inter_peak_interval, stddev_pop(gap) / (avg(gap) + 1e-10) AS cv_inter_peak_interval FROM gaps GROUP BY ALL),
    b AS (SELECT subject_id, task, count(peak) AS num_valleys FROM low GROUP BY ALL)
    SELECT subject_id, task, num_peaks, num_valleys, round(coalesce(mean_peak_height, 0), 6) AS mean_peak_height, round(coalesce(max_peak_height, 0), 6) AS max_peak_height,
      round(coalesce(std_peak_height, 0), 6) AS std_peak_height, round(coalesce(mean_inter_peak_interval, 0), 6) AS mean_inter_peak_interval,
      round(coalesce(std_inter_peak_interval, 0), 6) AS std_inter_peak_interval, round(coalesce(cv_inter_peak_interval, 0), 6) AS cv_inter_peak_interval
    FROM a JOIN b USING (subject_id, task)"""


@query("peak_and_valley_features", PEAK_SQL)
@counted_once
def peak_and_valley_features(spark, sf):
    return rounded(ko.temporal_features(signals(spark, sf), "head_step"), *RECORDING, "num_peaks", "num_valleys")


# ---------------------------------------------------------------- wavelets

LO = ", ".join(f"({j}, {float(a)!r}::DOUBLE, {float(b)!r}::DOUBLE)" for j, (a, b) in enumerate(zip(kernels.DB4_LOW, kernels.DB4_HIGH)))


def dwt_sql(level: int, packets: bool) -> str:
    """CTEs lv0 .. lv{level}: coefficients of each node as direct tap sums over the mirrored series."""
    parts = [
        f"{SIGNALS_SQL}, taps(j, lo, hi) AS (VALUES {LO}), lv0 AS (SELECT subject_id, task, '' AS path, count(*) OVER (PARTITION BY subject_id, task) AS n, frame_idx AS idx, Head_mag AS value FROM sig)"
    ]
    for step in range(level):
        src = f"lv{step}" if packets else f"(SELECT * FROM lv{step} WHERE path = '{'a' * step}')"
        fold = "CASE WHEN ((2 * o + 1 - j) % (2 * n) + 2 * n) % (2 * n) < n THEN ((2 * o + 1 - j) % (2 * n) + 2 * n) % (2 * n) ELSE 2 * n - 1 - ((2 * o + 1 - j) % (2 * n) + 2 * n) % (2 * n) END"
        parts.append(
            f"""nd{step} AS (SELECT subject_id, task, path, any_value(n) AS n FROM {src} GROUP BY subject_id, task, path),
            ou{step} AS (SELECT *, unnest(range(0, (n + 7) // 2)) AS o FROM nd{step}),
            ix{step} AS (SELECT q.subject_id, q.task, q.path, q.n, o, lo, hi, {fold} AS at FROM ou{step} q, taps),
            cf{step} AS (SELECT i.subject_id, i.task, i.path, o, any_value(i.n) AS n, sum(lo * value) AS a, sum(hi * value) AS d FROM ix{step} i JOIN {src} s
              ON s.subject_id = i.subject_id AND s.task = i.task AND s.path = i.path AND s.idx = i.at GROUP BY i.subject_id, i.task, i.path, o),
            lv{step + 1} AS (SELECT subject_id, task, path || 'a' AS path, (n + 7) // 2 AS n, o AS idx, a AS value FROM cf{step}
              UNION ALL SELECT subject_id, task, path || 'd', (n + 7) // 2, o, d FROM cf{step})"""
        )
    return ", ".join(parts)


_LEAVES = " UNION ALL ".join(
    ["SELECT *, 'approximation' AS band FROM lv5 WHERE path = 'aaaaa'"]
    + [f"SELECT *, 'detail_level{6 - s}' AS band FROM lv{s} WHERE path = '{'a' * (s - 1)}d'" for s in range(1, 6)]
)


@query(
    "wavelet_features",
    f"""WITH {dwt_sql(5, False)}, al AS ({_LEAVES}), s AS (SELECT *, abs(value) / (sum(abs(value)) OVER (PARTITION BY subject_id, task, band) + 1e-10) AS p FROM al),
    b AS (SELECT subject_id, task, band, avg(value) AS mean, stddev_pop(value) AS std, sum(value * value) AS energy, max(abs(value)) AS max, -sum(p * log2(p + 1e-10)) AS entropy FROM s GROUP BY ALL)
    SELECT subject_id, task, band, round(mean, 5) + 0 AS mean, round(std, 5) AS std, round(energy, 5) AS energy, round(max, 5) AS max, round(entropy, 5) AS entropy,
      round(energy / (sum(energy) OVER (PARTITION BY subject_id, task) + 1e-10), 6) AS energy_ratio FROM b""",
)
def wavelet_features(spark, sf):
    x = ko.wavelet_features(series(spark, sf, ["Head_mag"])).drop("channel")
    five = ["mean", "std", "energy", "max", "entropy"]
    return x.select(*RECORDING, "band", *[rnd(c, 5).alias(c) for c in five], rnd("energy_ratio").alias("energy_ratio"))


@query(
    "wavelet_packets",
    f"""WITH {dwt_sql(3, True)} SELECT subject_id, task, path, round(sum(value * value), 5) AS energy, round(avg(value), 5) + 0 AS mean, round(stddev_pop(value), 5) AS std,
      CAST(CASE path WHEN 'aaa' THEN 0 WHEN 'aad' THEN 1 WHEN 'add' THEN 2 WHEN 'ada' THEN 3 WHEN 'dda' THEN 4 WHEN 'ddd' THEN 5 WHEN 'dad' THEN 6 ELSE 7 END AS INT) AS frequency_order FROM lv3 GROUP BY ALL""",
)
def wavelet_packets(spark, sf):
    x = ko.wavelet_packets(series(spark, sf, ["Head_mag"])).drop("channel")
    return rounded(x, *RECORDING, "path", "frequency_order", digits=5)


CWT_SQL = f"""WITH {SIGNALS_SQL}, xs AS (SELECT subject_id, task, list(Head_mag ORDER BY frame_idx) AS v, count(*) AS n FROM sig GROUP BY ALL),
    ks AS (SELECT s, max(top) AS top, list(CASE WHEN abs(g) <= 8 * s THEN exp(-pow(g / CAST(s AS DOUBLE), 2) / 2) * cos(5 * g / CAST(s AS DOUBLE)) / sqrt(s) ELSE 0 END ORDER BY g) AS w
      FROM (SELECT s, top, unnest(range(-top, top + 1)) AS g FROM (SELECT max(n) AS top FROM xs), range(1, 128) r(s)) GROUP BY s),
    pos AS (SELECT subject_id, task, v, n, unnest(range(0, n)) AS k FROM xs),
    c AS (SELECT subject_id, task, list_inner_product(v, w[top + 1 - k:top + n - k]) AS c FROM pos, ks)
    SELECT subject_id, task, round(avg(c * c), 6) AS cwt_mean_energy, round(max(c * c), 6) AS cwt_max_energy FROM c GROUP BY ALL"""


@query("continuous_wavelet", CWT_SQL)
def continuous_wavelet(spark, sf):
    return rounded(ko.continuous_wavelet(series(spark, sf, ["Head_mag"])).drop("channel"), *RECORDING)


# ---------------------------------------------------------------- entropies

def ent_sql(signals: list[str]) -> str:
    """CTE ``ct``: template counts of every position of the signals."""
    out = f"""{SIGNALS_SQL}, {long_sql(signals)}, e AS (SELECT subject_id, task, channel, frame_idx AS i, value AS a, lead(value) OVER o AS b, lead(value, 2) OVER o AS c,
    count(*) OVER q AS n, 0.2 * stddev_pop(value) OVER q AS r, 0.2 * stddev_samp(value) OVER q AS rf FROM lng WINDOW o AS (PARTITION BY subject_id, task, channel ORDER BY frame_idx), q AS (PARTITION BY subject_id, task, channel)),
  t AS (SELECT *, (a + b) / 2 AS m2, (a + b + c) / 3 AS m3 FROM e WHERE b IS NOT NULL),
  pr AS (SELECT x.subject_id, x.task, x.channel, x.i, x.n, x.c IS NOT NULL AS xin, y.c IS NOT NULL AS yin, greatest(abs(x.a - y.a), abs(x.b - y.b)) <= x.r AS two,
    greatest(abs(x.a - y.a), abs(x.b - y.b), abs(x.c - y.c)) <= x.r AS three,
    CASE WHEN x.c IS NOT NULL AND y.c IS NOT NULL AND x.i <> y.i THEN exp(-greatest(abs((x.a - x.m2) - (y.a - y.m2)), abs((x.b - x.m2) - (y.b - y.m2))) / x.rf) ELSE 0 END AS f2,
    CASE WHEN x.c IS NOT NULL AND y.c IS NOT NULL AND x.i <> y.i THEN exp(-greatest(abs((x.a - x.m3) - (y.a - y.m3)), abs((x.b - x.m3) - (y.b - y.m3)), abs((x.c - x.m3) - (y.c - y.m3))) / x.rf) ELSE 0 END AS f3
    FROM t x JOIN t y ON x.subject_id = y.subject_id AND x.task = y.task AND x.channel = y.channel),
  ct AS (SELECT subject_id, task, channel, i, any_value(n) AS n, any_value(xin) AS xin, count(*) FILTER (WHERE two) AS c2, count(*) FILTER (WHERE two AND yin) AS s2,
    count(*) FILTER (WHERE yin AND xin AND three) AS c3, sum(f2) AS f2, sum(f3) AS f3 FROM pr GROUP BY subject_id, task, channel, i)"""
    return out


@query(
    "template_entropies",
    f"""WITH {ent_sql(["Head_mag"])} SELECT subject_id, task, round(-ln(nullif(CAST(sum(c3 - 1) FILTER (WHERE xin) AS DOUBLE) / sum(s2 - 1) FILTER (WHERE xin), 0)), 6) + 0 AS sample_entropy,
      round(avg(ln(c2 / (n - 1))) - avg(CASE WHEN xin THEN ln(c3 / (n - 2)) END), 6) + 0 AS approx_entropy, round(-ln(sum(f3) / sum(f2)), 6) + 0 AS fuzzy_entropy FROM ct GROUP BY ALL""",
)
@counted_once
def template_entropies(spark, sf):
    return rounded(ko.entropies(series(spark, sf, ["Head_mag"])).drop("channel"), *RECORDING)


LZ_SQL = f"""WITH RECURSIVE {SIGNALS_SQL}, {long_sql(MAGS)}, md AS (SELECT *, median(value) OVER (PARTITION BY {PART}) AS md FROM lng),
    b AS (SELECT {PART}, string_agg(CASE WHEN value > md THEN '1' ELSE '0' END, '' ORDER BY frame_idx) AS bits, count(*) AS n FROM md GROUP BY {PART}),
    z AS (SELECT {PART}, bits, n, 0::BIGINT AS first, 1::BIGINT AS size, 0::BIGINT AS phrases FROM b UNION ALL
      SELECT {PART}, bits, n, CASE WHEN seen THEN first ELSE first + size END, CASE WHEN seen THEN size + 1 ELSE 1 END, CASE WHEN seen THEN phrases ELSE phrases + 1 END
      FROM (SELECT *, first + size <= n AND contains(substr(bits, 1, first + size - 1), substr(bits, first + 1, size)) AS seen FROM z WHERE first < n))
    SELECT {PART}, round(phrases / (n / (ln(n) / ln(2e0))), 6) AS lempel_ziv FROM z WHERE first >= n AND n > 1"""


@query("lempel_ziv_complexity", LZ_SQL)
@counted_once
def lempel_ziv_complexity(spark, sf):
    return rounded(ko.lempel_ziv(series(spark, sf, MAGS)), *RECORDING, "channel")


@query("lyapunov_exponent")
def lyapunov_exponent(spark, sf):
    return rounded(ko.lyapunov(series(spark, sf, ["Head_mag"])).drop("channel"), *RECORDING)


# ---------------------------------------------------------------- DTW


@query("dtw_distances")
def dtw_distances(spark, sf):
    return rounded(ko.dtw_distances(table(spark, sf, "embeddings"), "vec_id", "embedding"), "id_a", "id_b")


@query("dtw_embedding")
def dtw_embedding(spark, sf):
    """Classical scaling of the DTW distances of all series."""
    from kinelake.sources.store import reliable

    v = table(spark, sf, "embeddings")
    d = reliable(ko.dtw_distances(v, "vec_id", "embedding"))
    return rounded(ko.classical_mds(d, v.select(F.col("vec_id").alias("id")), 2), "id", "dim", digits=4)


