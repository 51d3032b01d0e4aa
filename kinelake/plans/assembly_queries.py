"""The whole feature table: nine modules, all sensors. Its SQL is put together from that of the modules' own queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from kinelake.config import CHANNELS, RECORDING
from kinelake.operators import assembly, features
from kinelake.plans import feature_queries as fq
from kinelake.plans import kernel_queries as kq
from kinelake.plans.fixtures import counted_once, frames
from kinelake.plans.registry import ORACLES, query
from kinelake.sources.store import scratch_path


def unrounded(sql: str) -> str:
    """The same SQL without its round(.., digits) calls."""
    out, at = "", 0
    while (start := sql.find("round(", at)) >= 0:
        depth, comma, z = 1, -1, start + 6
        while depth:
            c = sql[z]
            depth += (c == "(") - (c == ")")
            comma = z if c == "," and depth == 1 else comma
            z += 1
        out += sql[at:start] + "(" + unrounded(sql[start + 6 : comma]) + ")"
        at = z
    return out + sql[at:]


def five_digits(v):
    """Five significant digits, four decimals below one: sums differ in the last bits between engines."""
    big = F.abs(v) >= 1
    scale = F.when(big, F.pow(F.lit(10.0), F.floor(F.log10(F.when(big, F.abs(v)))).cast("double"))).otherwise(1.0)
    return F.round(v / scale, 4) * scale + F.lit(0.0)


FIVE = "round(v / s, 4) * s + 0"


def long_of(sql: str, name: str, columns: str = "* EXCLUDE (subject_id, task)") -> str:
    """Every value column of a module's SQL as rows; ``name`` makes the feature's name of the column's, ``c``."""
    return (
        f"SELECT subject_id, task, {name} AS feature, v FROM (SELECT * FROM (SELECT subject_id, task, "
        f"{columns} FROM ({unrounded(sql)}))) UNPIVOT (v FOR c IN (COLUMNS(* EXCLUDE (subject_id, task, channel))))"
    )


def plain(sql: str, prefix: str = "", drop: list[str] = ()) -> str:
    """``long_of`` for a table without a channel."""
    keep = f"* EXCLUDE (subject_id, task{''.join(f', {d}' for d in drop)})"
    return long_of(sql, f"concat('{prefix}', c)", f"'' AS channel, COLUMNS({keep})::DOUBLE")


def by_channel(sql: str, names: dict[str, str], drop: list[str] = ()) -> str:
    known = " ".join(f"WHEN '{c}' THEN '{n}'" for c, n in {"": "", **names}.items())
    keep = f"* EXCLUDE (subject_id, task, channel{''.join(f', {d}' for d in drop)})"
    return long_of(sql, f"concat(CASE channel {known} ELSE channel END, '_', c)", f"channel, COLUMNS({keep})::DOUBLE")


TEMPLATE = f"""WITH {kq.ent_sql(list(assembly.MAGS))} SELECT subject_id, task, channel,
  -ln(nullif(CAST(sum(c3 - 1) FILTER (WHERE xin) AS DOUBLE) / sum(s2 - 1) FILTER (WHERE xin), 0)) AS sample_entropy,
  avg(ln(c2 / (n - 1))) - avg(CASE WHEN xin THEN ln(c3 / (n - 2)) END) AS approx_entropy, -ln(sum(f3) / sum(f2)) AS fuzzy_entropy FROM ct GROUP BY ALL"""

STD = [c for c in fq._ROM if c.endswith("_std")]
PARTS = [
    plain(ORACLES["biomechanics"]),
    plain(ORACLES["range_of_motion"], drop=STD),
    plain(ORACLES["bilateral_asymmetry"], "hand_"),
    plain(ORACLES["max_cross_correlation"], "hand_"),
    by_channel(ORACLES["jerk_smoothness"], assembly.SPEEDS),
    by_channel(ORACLES["spectral_arc_length"], assembly.SPEEDS),
    plain(ORACLES["activity_span"]),
    plain(ORACLES["peak_and_valley_features"]),
    by_channel(ORACLES["time_domain_features"], assembly.DISPLAY),
    by_channel(ORACLES["spectral_features"], assembly.MAGS, ["spectral_entropy_normalised"]),
    by_channel(ORACLES["fft_magnitude"], assembly.MAGS),
    by_channel(f"SELECT * EXCLUDE (band), concat('head_', band) AS channel FROM ({unrounded(ORACLES['wavelet_features'])})", {}),
    plain(kq.CWT_SQL, "head_"),
    by_channel(f"SELECT subject_id, task, channel, spectral_entropy_normalised FROM ({ORACLES['spectral_features']})", assembly.MAGS),
    by_channel(TEMPLATE, assembly.MAGS),
    *[by_channel(ORACLES[q], assembly.MAGS) for q in ("permutation_entropy", "svd_entropy", "hjorth_parameters", "detrended_fluctuation", "fractal_dimensions", "higuchi_dimension", "lempel_ziv_complexity")],
]
ALL_SQL = " UNION ALL ".join(f"({p})" for p in PARTS)


def assembled(spark, sf, strict=False):
    return assembly.assemble(frames(spark, sf, CHANNELS), scratch_path(spark, "features"), strict=strict)


@query(
    "feature_assembly",
    f"""SELECT subject_id, task, feature, {FIVE} AS value FROM (SELECT subject_id, task, concat('ext_', feature) AS feature, v,
      CASE WHEN abs(v) >= 1 THEN pow(10e0, floor(log10(abs(v)))) ELSE 1e0 END AS s FROM ({ALL_SQL}) WHERE v IS NOT NULL AND NOT isnan(v))""",
)
@counted_once
def feature_assembly(spark, sf):
    long, _ = assembled(spark, sf, strict=True)
    return long.filter(~F.isnan("value")).select(*RECORDING, "feature", five_digits(F.col("value")).alias("value"))


# Names of the composite metrics and of the features that they are made of.
_IN = {
    "lp": "LeftHand_peak_vel", "rp": "RightHand_peak_vel", "lm": "LeftHand_mean_vel", "rm": "RightHand_mean_vel", "pz": "H_PosZ_max", "jm": "RightHand_jerk_metric",
    "dur": "duration", "le": "left_reach_elevation_rom", "re": "right_reach_elevation_rom", "on_": "movement_onset_time", "pk": "num_peaks",
}
_OUT = {
    "max_speed": "greatest(lp, rp)", "mean_speed": "(lm + rm) / 2", "peak_speed_ratio": "greatest(lp, rp) / ((lm + rm) / 2 + 1e-10)", "max_acceleration": "pz",
    "mean_jerk": "jm", "normalized_jerk": "jm", "total_path_length": "dur * (lm + rm) / 2", "path_efficiency": "1 / (1 + jm + 1e-10)", "rom_total": "greatest(le, re)",
    "time_to_peak_speed": "on_", "number_of_movement_units": "pk", "movement_efficiency": "1 / (1 + jm + 1e-10)",
}
_SOME = " UNION ALL ".join(
    f"({p})" for p in (plain(ORACLES["biomechanics"]), by_channel(ORACLES["jerk_smoothness"], assembly.SPEEDS), plain(ORACLES["activity_span"]), plain(ORACLES["peak_and_valley_features"]), by_channel(ORACLES["time_domain_features"], assembly.DISPLAY))
)


@query(
    "composite_metrics",
    f"""WITH w AS (SELECT subject_id, task, {", ".join(f"coalesce(max(v) FILTER (WHERE feature = '{f}'), 0) AS {n}" for n, f in _IN.items())} FROM ({_SOME}) GROUP BY subject_id, task)
    SELECT subject_id, task, {", ".join(f"round(({e}) / CASE WHEN abs({e}) >= 1 THEN pow(10e0, floor(log10(abs({e})))) ELSE 1e0 END, 4) * CASE WHEN abs({e}) >= 1 THEN pow(10e0, floor(log10(abs({e})))) ELSE 1e0 END + 0 AS {n}" for n, e in _OUT.items())} FROM w""",
)
@counted_once
def composite_metrics(spark, sf):
    """All twelve metrics of every recording, from the modules they draw on; a module that fails ends the query."""
    x = frames(spark, sf, CHANNELS)
    needed = {m: assembly.MODULES[m] for m in ("biomechanical", "movement_quality", "temporal", "time_domain")}
    long, left_out = assembly.assemble(x, scratch_path(spark, "composite"), needed, prefix="", strict=True)
    wide = assembly.wide_table(x, long, left_out, list(_IN.values()))
    out = features.composite_metrics(wide)
    return out.select(*RECORDING, *[five_digits(F.col(c).cast("double")).alias(c) for c in _OUT])


@query(
    "feature_table_gaps",
    """SELECT subject_id, task, 'complexity' AS module, 'no value' AS reason FROM (SELECT 'none' AS subject_id, CAST(0 AS INT) AS task) WHERE false""",
)
@counted_once
def feature_table_gaps(spark, sf):
    """Recordings that a module left out, and why; complete recordings have no row."""
    return assembled(spark, sf)[1]
