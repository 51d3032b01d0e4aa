"""Spectra: Welch segments, whole-series transforms and what is derived from them.

Welch works on overlapping segments, so each task holds at most 256 samples of a series. A transform
over the whole series uses one FFT per series up to ``limit`` samples; longer series go through a
four-step transform in which every group holds about sqrt(length) samples.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kinelake.config import RECORDING, SAMPLING_RATE
from kinelake.functions import kernels
from kinelake.operators import ordering
from kinelake.operators.blocks import SERIES_LIMIT, per_group

# Band edges in Hz, both ends inclusive.
BANDS = {"very_low": (0.0, 0.5), "low": (0.5, 2.0), "mid": (2.0, 5.0), "high": (5.0, 10.0), "very_high": (10.0, 20.0)}


def finite_series(df: DataFrame, signals: list[str], keys: list[str] = RECORDING) -> DataFrame:
    """Long rows (keys, channel, idx, value) without NaN/inf, re-indexed without gaps."""
    # Rows are made by a generator, which leaves them where they lie; an unpivot would forget the partitioning.
    cells = F.array(*[F.struct(F.lit(c).alias("channel"), F.col(c).cast("double").alias("value")) for c in signals])
    long = df.select(*keys, "frame_idx", F.inline(cells)).filter(
        F.col("value").isNotNull() & ~F.isnan("value") & (F.abs("value") != float("inf"))
    )
    max_rows = ordering.largest_group(df, keys)
    return ordering.position(
        long, [*keys, "channel"], F.col("frame_idx"), ["frame_idx"], "idx", max_rows=max_rows
    ).drop("frame_idx")


def welch(series: DataFrame, keys: list[str] = RECORDING, rate: float = SAMPLING_RATE, nperseg: int = 256) -> DataFrame:
    """(keys, channel, freq, power): Hann segments of min(nperseg, n), half overlap, mean removed.

    Series shorter than 10 samples or with std < 1e-10 give no rows.
    """
    k = [*keys, "channel"]
    x = ordering.attach(series, k, {"n": F.count(F.lit(1)), "_sd": F.stddev_pop("value")})
    x = x.filter("n >= 10 AND _sd >= 1e-10").drop("_sd")
    seg = F.least(F.col("n"), F.lit(nperseg))
    step = seg - F.floor(seg / 2)
    first = F.greatest(F.ceil((F.col("idx") - seg + 1) / step), F.lit(0))
    last = F.least(F.floor(F.col("idx") / step), F.floor((F.col("n") - seg) / step))
    x = x.withColumns({"_a": first.cast("long"), "_z": last.cast("long")}).filter("_a <= _z")
    x = x.select(*k, F.explode(F.sequence("_a", "_z")).alias("segment"), "idx", "value")

    def one(c):
        p = kernels.segment_power(c["value"], rate)
        f = np.fft.rfftfreq(len(c["value"]), 1.0 / rate)
        return {"bin": np.arange(len(p)), "freq": f, "power": p}

    power = per_group(x, [*k, "segment"], ["idx"], one, "bin INT, freq DOUBLE, power DOUBLE")
    return power.groupBy(*k, "bin").agg(F.first("freq").alias("freq"), F.avg("power").alias("power"))


def spectral_features(psd: DataFrame, keys: list[str] = RECORDING) -> DataFrame:
    """Energy, dominant frequency, bands, moments, entropy, rolloff and shape per series.

    At most nperseg / 2 + 1 rows per series reach the cumulative window.
    """
    k = [*keys, "channel"]
    f, p = F.col("freq"), F.col("power")
    w = Window.partitionBy(*k).orderBy("bin")
    tot = F.sum("power").over(Window.partitionBy(*k))
    x = psd.withColumns({"_tot": tot, "_cum": F.sum("power").over(w)})
    x = x.withColumn("_mean", F.sum(f * p).over(Window.partitionBy(*k)) / (F.col("_tot") + 1e-10))
    pn = p / (F.col("_tot") + 1e-10)
    x = x.withColumn("_pn", pn).withColumn("_prev", F.lag("_pn").over(w))
    top = F.max(F.struct("power", (-F.col("bin")).alias("b"), "freq"))
    band = [
        F.sum(F.when((f >= a) & (f <= b), p).otherwise(0.0)).alias(f"spectral_energy_{n}") for n, (a, b) in BANDS.items()
    ]
    strict = p / F.col("_tot")
    arc = F.sum(F.sqrt(1.0 + (F.col("_pn") - F.col("_prev")) ** 2))
    return x.groupBy(*k).agg(
        F.sum("power").alias("spectral_energy_total"),
        top["freq"].alias("dominant_frequency"),
        top["power"].alias("dominant_frequency_magnitude"),
        *band,
        F.first("_mean").alias("mean_frequency"),
        F.min(F.when(F.col("_cum") >= F.col("_tot") / 2.0, f)).alias("median_frequency"),
        F.sqrt(F.sum((f - F.col("_mean")) ** 2 * p) / (F.sum("power") + 1e-10)).alias("spectral_spread"),
        (-F.sum(F.col("_pn") * F.log2(F.col("_pn") + 1e-10))).alias("spectral_entropy"),
        F.first("_mean").alias("spectral_centroid"),
        F.min(F.when(F.col("_cum") >= 0.95 * F.col("_tot"), f)).alias("spectral_rolloff"),
        F.kurtosis("power").alias("spectral_kurtosis"),
        F.skewness("power").alias("spectral_skewness"),
        (-F.sum(F.when(strict > 0, strict * F.log2(F.when(strict > 0, strict))).otherwise(0.0)) / F.log2(F.count(p).cast("double"))).alias(
            "spectral_entropy_normalised"
        ),
        (-arc).alias("sparc"),
    )


def spectrogram(df: DataFrame, channel: str, keys: list[str] = RECORDING, rate: float = SAMPLING_RATE, nperseg: int = 64, overlap: int = 32):
    """(keys, t, freq, power) of one channel over sliding windows."""
    step = nperseg - overlap
    lens = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= nperseg)
    x = df.select(*keys, F.col("frame_idx").alias("idx"), F.col(channel).alias("value")).join(lens, keys)
    first = F.greatest(F.ceil((F.col("idx") - nperseg + 1) / F.lit(step)), F.lit(0)).cast("long")
    last = F.least(F.floor(F.col("idx") / F.lit(step)), F.floor((F.col("n") - nperseg) / F.lit(step))).cast("long")
    x = x.withColumns({"_a": first, "_z": last}).filter("_a <= _z")
    x = x.select(*keys, F.explode(F.sequence("_a", "_z")).alias("segment"), "idx", "value")

    def one(c):
        p = kernels.segment_power(c["value"], rate)
        return {"freq": np.fft.rfftfreq(nperseg, 1.0 / rate), "power": p}

    out = per_group(x, [*keys, "segment"], ["idx"], one, "freq DOUBLE, power DOUBLE")
    return out.withColumn("t", (F.col("segment") * step + nperseg / 2.0) / F.lit(rate)).drop("segment")


# ---------------------------------------------------------------- transforms over a whole series


def _twiddle(angle: Column, re: Column, im: Column) -> tuple[Column, Column]:
    return re * F.cos(angle) - im * F.sin(angle), re * F.sin(angle) + im * F.cos(angle)


def _four_step(x: DataFrame, k: list[str], sign: int) -> DataFrame:
    """DFT of (k, _m, idx, re, im) with power-of-two length _m; missing rows count as zero."""
    half = F.floor(F.log2(F.col("_m").cast("double") + 0.5) / 2.0)
    x = x.withColumn("_n1", F.pow(F.lit(2.0), half).cast("long"))
    x = x.withColumn("_n2", F.floor(F.col("_m") / F.col("_n1")).cast("long"))
    x = x.withColumns({"_c": F.pmod("idx", "_n2"), "_r": F.floor(F.col("idx") / F.col("_n2")).cast("long")})

    def transform(size: str, at: str, new: str):
        def one(c):
            n = int(c[size][0])
            v = np.zeros(n, dtype=complex)
            np.add.at(v, c[at].astype(int), c["re"] + 1j * c["im"])
            y = np.fft.fft(v) if sign < 0 else np.fft.ifft(v) * n
            return {
                new: np.arange(n), "re": y.real, "im": y.imag,
                "_m": np.full(n, c["_m"][0]), "_n1": np.full(n, c["_n1"][0]), "_n2": np.full(n, c["_n2"][0]),
            }

        return one

    ddl = "re DOUBLE, im DOUBLE, _m BIGINT, _n1 BIGINT, _n2 BIGINT"
    cols = per_group(x, [*k, "_c"], ["_r"], transform("_n1", "_r", "_q"), f"_q BIGINT, {ddl}")
    angle = F.lit(sign * 2.0 * np.pi) * F.pmod(F.col("_c") * F.col("_q"), F.col("_m")) / F.col("_m")
    re, im = _twiddle(angle, F.col("re"), F.col("im"))
    cols = cols.withColumns({"re": re, "im": im})
    rows = per_group(cols, [*k, "_q"], ["_c"], transform("_n2", "_c", "_p"), f"_p BIGINT, {ddl}")
    return rows.select(*k, "_m", (F.col("_q") + F.col("_n1") * F.col("_p")).alias("idx"), "re", "im")


def dft(x: DataFrame, k: list[str], n: str, sign: int = -1) -> DataFrame:
    """Unnormalised DFT of (k, n, idx, re, im) for any length: chirp product, convolution, chirp product."""
    m = F.pow(F.lit(2.0), F.ceil(F.log2(2.0 * F.col(n) - 1.0))).cast("long")
    x = x.withColumn("_m", m)
    # sign * pi * idx^2 / n with the square reduced modulo 2n first.
    half_angle = lambda i: F.lit(sign * np.pi) * F.pmod(i * i, 2 * F.col(n)) / F.col(n)
    re, im = _twiddle(half_angle(F.col("idx")), F.col("re"), F.col("im"))
    a = x.select(*k, "_m", "idx", re.alias("re"), im.alias("im"))
    lens = x.groupBy(*k).agg(F.max(n).alias(n), F.max("_m").alias("_m"))
    at = F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    chirp = lens.select("*", at.alias("_j")).repartition(*k, "_j")
    ang = half_angle(F.col("_j"))
    both = F.array_distinct(F.array(F.col("_j"), F.pmod(F.col("_m") - F.col("_j"), F.col("_m"))))
    b = chirp.select(*k, "_m", F.explode(both).alias("idx"), F.cos(ang).alias("re"), (-F.sin(ang)).alias("im"))
    fa, fb = _four_step(a, k, -1), _four_step(b, k, -1)
    fb = fb.select(*k, "idx", F.col("re").alias("_br"), F.col("im").alias("_bi"))
    prod = fa.join(fb, [*k, "idx"]).select(
        *k, "_m", "idx",
        (F.col("re") * F.col("_br") - F.col("im") * F.col("_bi")).alias("re"),
        (F.col("re") * F.col("_bi") + F.col("im") * F.col("_br")).alias("im"),
    )
    conv = _four_step(prod, k, 1).join(lens.select(*k, n), k).filter(F.col("idx") < F.col(n))
    re, im = _twiddle(half_angle(F.col("idx")), F.col("re") / F.col("_m"), F.col("im") / F.col("_m"))
    return conv.select(*k, n, "idx", re.alias("re"), im.alias("im"))


def _split(series: DataFrame, k: list[str], limit: int) -> tuple[DataFrame, DataFrame | None]:
    """Series with their length, as (short, long); long is None when no series passes the limit."""
    top = ordering.largest_group(series, k)
    x = ordering.attach(series, k, {"n": F.count(F.lit(1))}, top)
    if top <= limit:
        return x, None
    return x.filter(F.col("n") <= limit), x.filter(F.col("n") > limit)


def fft_magnitude(series: DataFrame, keys: list[str] = RECORDING, limit: int = SERIES_LIMIT) -> DataFrame:
    """Max and mean |FFT| over the first n/2 bins; a series of one frame has no such bin, so both are NULL."""
    k = [*keys, "channel"]
    short, long = _split(series, k, limit)

    def one(c):
        mag = np.abs(np.fft.fft(c["value"]))[: len(c["value"]) // 2]
        if not len(mag):
            return {"fft_max_magnitude": np.array([None], object), "fft_mean_magnitude": np.array([None], object)}
        return {"fft_max_magnitude": mag.max(), "fft_mean_magnitude": mag.mean()}

    out = per_group(short, k, ["idx"], one, "fft_max_magnitude DOUBLE, fft_mean_magnitude DOUBLE")
    if long is None:
        return out
    spec = dft(long.select(*k, "n", "idx", F.col("value").alias("re"), F.lit(0.0).alias("im")), k, "n")
    mag = F.sqrt(F.col("re") ** 2 + F.col("im") ** 2)
    big = spec.filter(F.col("idx") < F.floor(F.col("n") / 2)).groupBy(*k).agg(
        F.max(mag).alias("fft_max_magnitude"), F.avg(mag).alias("fft_mean_magnitude")
    )
    return out.unionByName(big)


def resample(df: DataFrame, channels: list[str], ratio: float, keys: list[str] = RECORDING, limit: int = SERIES_LIMIT):
    """Fourier resampling to int(T / ratio) frames."""
    x = df.select(*keys, F.col("frame_idx").alias("idx"), *channels)
    lens = x.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    big = ordering.largest_group(x, keys) > limit
    whole = ordering.attach(x, keys, {"n": F.count(F.lit(1))})

    def one(c):
        n = len(c["idx"])
        num = int(n / ratio)
        if num < 1:
            return None
        y = kernels.fourier_resample(np.stack([c[ch] for ch in channels], axis=1), num)
        return {"frame_idx": np.arange(num), **{ch: y[:, i] for i, ch in enumerate(channels)}}

    ddl = "frame_idx BIGINT, " + ", ".join(f"{c} DOUBLE" for c in channels)
    out = per_group(whole.filter(F.col("n") <= limit) if big else whole, keys, ["idx"], one, ddl)
    if not big:
        return out
    k = [*keys, "channel"]
    long = whole.filter(F.col("n") > limit).unpivot([*keys, "n", "idx"], channels, "channel", "value")
    spec = dft(long.select(*k, "n", "idx", F.col("value").alias("re"), F.lit(0.0).alias("im")), k, "n")
    spec = spec.withColumn("num", F.floor(F.col("n") / F.lit(float(ratio))).cast("long"))
    keep = F.least("n", "num")
    top = F.floor(keep / 2)
    nyq = (F.pmod(keep, F.lit(2)) == 0) & (F.col("idx") == top) & (F.col("n") != F.col("num"))
    gain = F.when(nyq & (F.col("num") < F.col("n")), 2.0).when(nyq, 0.5).otherwise(1.0)
    kept = spec.filter(F.col("idx") <= top).withColumns({"re": F.col("re") * gain, "im": F.col("im") * gain})
    # A real inverse transform: bins 0 and num/2 count once and by their real part, the others twice.
    edge = (F.col("idx") == 0) | (2 * F.col("idx") == F.col("num"))
    kept = kept.withColumns(
        {"re": F.col("re") * F.when(edge, 1.0).otherwise(2.0), "im": F.when(edge, 0.0).otherwise(2.0 * F.col("im"))}
    )
    back = dft(kept.withColumn("_n0", F.col("n")).drop("n").withColumnRenamed("num", "n").drop("_n0"), k, "n", 1)
    y = back.join(lens.withColumnRenamed("n", "_t"), keys).withColumn("value", F.col("re") / F.col("_t"))
    wide = y.groupBy(*keys, F.col("idx").alias("frame_idx")).pivot("channel", channels).agg(F.first("value"))
    return out.unionByName(wide)


def max_cross_correlation(
    df: DataFrame, left: str, right: str, keys: list[str] = RECORDING, limit: int = SERIES_LIMIT
) -> DataFrame:
    """Largest central-lag value of the mean-removed cross-correlation (same-length window of lags)."""
    stats = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    x = ordering.attach(df, keys, {"n": F.count(F.lit(1)), "_ml": F.avg(left), "_mr": F.avg(right)}).select(
        *keys, "n", F.col("frame_idx").alias("idx"), (F.col(left) - F.col("_ml")).alias("a"), (F.col(right) - F.col("_mr")).alias("v")
    )
    big = ordering.largest_group(df, keys) > limit

    def one(c):
        n = len(c["a"])
        size = 1 << int(np.ceil(np.log2(2 * n)))
        full = np.fft.irfft(np.fft.rfft(c["a"], size) * np.conj(np.fft.rfft(c["v"], size)), size)
        lags = np.arange(-(n // 2), n - n // 2)
        return {"max_cross_correlation": full[lags % size].max()}

    out = per_group(x.filter(F.col("n") <= limit) if big else x, keys, ["idx"], one, "max_cross_correlation DOUBLE")
    if not big:
        return out
    long = x.filter(F.col("n") > limit).withColumn(
        "_m", F.pow(F.lit(2.0), F.ceil(F.log2(2.0 * F.col("n")))).cast("long")
    )
    fa, fv = (
        _four_step(long.select(*keys, "_m", "idx", F.col(c).alias("re"), F.lit(0.0).alias("im")), keys, -1) for c in "av"
    )
    fv = fv.select(*keys, "idx", F.col("re").alias("_vr"), F.col("im").alias("_vi"))
    prod = fa.join(fv, [*keys, "idx"]).select(
        *keys, "_m", "idx",
        (F.col("re") * F.col("_vr") + F.col("im") * F.col("_vi")).alias("re"),
        (F.col("im") * F.col("_vr") - F.col("re") * F.col("_vi")).alias("im"),
    )
    full = _four_step(prod, keys, 1).join(stats.select(*keys, "n"), keys)
    lag = F.when(F.col("idx") >= F.col("_m") / 2, F.col("idx") - F.col("_m")).otherwise(F.col("idx"))
    half = F.floor(F.col("n") / 2)
    peak = full.filter((lag >= -half) & (lag <= F.col("n") - 1 - half)).groupBy(*keys).agg(
        F.max(F.col("re") / F.col("_m")).alias("max_cross_correlation")
    )
    return out.unionByName(peak)
