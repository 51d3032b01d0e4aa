"""Operators that need a numpy helper on bounded blocks: filters, splines, peaks, wavelets, entropies, DTW."""

from __future__ import annotations

from functools import reduce

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kinelake.config import RECORDING, SAMPLING_RATE
from kinelake.functions import kernels
from kinelake.functions.expr import normal_hash
from kinelake.operators import ordering
from kinelake.operators.blocks import SERIES_LIMIT, per_batch, per_group
from kinelake.operators.reshape import augmentation_plan, lengths, with_length

# ---------------------------------------------------------------- filters and splines


def butterworth_filter(
    df: DataFrame,
    channels: list[str],
    kind: str,
    cutoff,
    order: int = 4,
    rate: float = SAMPLING_RATE,
    keys: list[str] = RECORDING,
    size: int = ordering.BLOCK,
) -> DataFrame:
    """Zero-phase Butterworth filter; blocks overlap until the slowest pole has died out.

    A recording of one frame comes back as it is.
    """
    b, a = kernels.butterworth(order, cutoff, rate, kind)
    halo = kernels.settle_length(a)
    size = max(size, halo)
    x = with_length(df.select(*keys, "frame_idx", *channels), keys)
    x = ordering.blocked(x, "frame_idx", halo, halo, size)

    def many(c, starts, ends):
        values = np.stack([c[ch][: ends[-1]] for ch in channels], axis=1).astype(float)
        long = ends - starts > 1
        first, last = starts[long], ends[long]
        at_start, at_end = c["frame_idx"][first] == 0, c["frame_idx"][last - 1] == c["n_frames"][last - 1] - 1
        y = kernels.zero_phase_many(b, a, values, first, last, at_start, at_end)
        core = np.flatnonzero(c["_core"][: ends[-1]].astype(bool))
        return core, {"frame_idx": c["frame_idx"][core], **{ch: y[core, i] for i, ch in enumerate(channels)}}

    ddl = "frame_idx BIGINT, " + ", ".join(f"{ch} DOUBLE" for ch in channels)
    return per_batch(x, [*keys, "_blk"], ["frame_idx"], many, ddl).drop("_blk")


def interpolate_spline(
    df: DataFrame, channels: list[str], length: int, kind: str = "cubic", keys: list[str] = RECORDING, size: int = 512
) -> DataFrame:
    """Quadratic or cubic resampling to ``length`` points.

    A spline forgets a knot by a factor of about four per step, so 64 halo frames on each side give
    the global spline to machine precision. A recording of one frame repeats it ``length`` times.
    """
    degree = {"quadratic": 2, "cubic": 3}[kind]
    x = with_length(df.select(*keys, "frame_idx", *channels), keys)
    x = ordering.blocked(x, "frame_idx", 64, 64, size)

    def one(c):
        idx, n, core = c["frame_idx"], int(c["n_frames"][0]), c["_core"].astype(bool)
        if not core.any():
            return None
        if n < 2:
            return {"frame_idx": np.arange(length), **{ch: np.repeat(c[ch].astype(float), length) for ch in channels}}
        own = idx[core]
        lo, hi = int(own[0]), int(own[-1]) + 1
        first = -(-lo * (length - 1) // (n - 1))
        last = length if hi >= n else -(-hi * (length - 1) // (n - 1))
        j = np.arange(first, last)
        at = np.minimum(j * (n - 1) / (length - 1), n - 1) - idx[0]
        y = kernels.spline_at(np.stack([c[ch] for ch in channels], axis=1), at, degree)
        return {"frame_idx": j, **{ch: y[:, i] for i, ch in enumerate(channels)}}

    ddl = "frame_idx BIGINT, " + ", ".join(f"{ch} DOUBLE" for ch in channels)
    return per_group(x, [*keys, "_blk"], ["frame_idx"], one, ddl).drop("_blk")


# ---------------------------------------------------------------- smooth random curves


def _curve_coefficients(knots: int) -> np.ndarray:
    """(interval, power, knot): cubic pieces of the not-a-knot spline through ``knots`` unit knots."""
    out = np.zeros((knots - 1, 4, knots))
    t = np.array([0.0, 1 / 3, 2 / 3, 1.0])
    vander = np.linalg.inv(np.vander(t, 4, increasing=True))
    for m in range(knots - 1):
        out[m] = vander @ kernels.spline_at(np.eye(knots), m + t, 3)
    return out


def smooth_curve(df: DataFrame, sigma: float, knot: int, seed: int, floor: float | None, keys: list[str]) -> DataFrame:
    """Add ``curve``: a cubic through knot + 2 draws around 1 spread evenly over the recording.

    Draws and piece coefficients are one row per recording; frames evaluate a polynomial.
    """
    coef = _curve_coefficients(knot + 2)
    draws = [1.0 + sigma * normal_hash(*keys, F.lit(i), seed=seed) for i in range(knot + 2)]
    if floor is not None:
        draws = [F.greatest(d, F.lit(floor)) for d in draws]
    per = lengths(df, keys).withColumns({f"_d{i}": d for i, d in enumerate(draws)})
    lin = lambda w: sum((F.col(f"_d{i}") * float(v) for i, v in enumerate(w)), F.lit(0.0))
    pieces = F.array(*[F.array(*[lin(coef[m][p]) for p in range(4)]) for m in range(knot + 1)])
    per = per.select(*keys, F.col("n_frames").alias("_n"), pieces.alias("_pieces"))
    x = df.join(per, keys)
    u = F.col("frame_idx") * F.lit(float(knot + 1)) / F.greatest(F.col("_n") - 1, F.lit(1))
    m = F.least(F.floor(u), F.lit(knot)).cast("int")
    x = x.withColumns({"_t": u - m, "_c": F.get("_pieces", m)})
    c, t = F.col("_c"), F.col("_t")
    return x.withColumn("curve", c[0] + t * (c[1] + t * (c[2] + t * c[3]))).drop("_pieces", "_t", "_c")


def magnitude_warp(df: DataFrame, channels: list[str], sigma: float = 0.2, knot: int = 4, seed: int = 42, keys: list[str] = RECORDING):
    x = smooth_curve(df, sigma, knot, seed, None, keys)
    return x.withColumns({c: F.col(c) * F.col("curve") for c in channels}).drop("curve", "_n")


def time_warp(df: DataFrame, channels: list[str], sigma: float = 0.2, knot: int = 4, seed: int = 42, keys: list[str] = RECORDING):
    """Warp time by the running sum of a positive curve, then read linearly at whole frames.

    Each frame emits the whole frames between its warped time and the next one. The curve is kept
    above 0.01 so that warped time always moves forward.
    """
    x = smooth_curve(df.select(*keys, "frame_idx", *channels), sigma, knot, seed, 0.1, keys)
    x = x.withColumn("curve", F.greatest("curve", F.lit(0.01)))
    ends = x.groupBy(*keys).agg(
        F.sum("curve").alias("_sum"), F.max(F.when(F.col("frame_idx") == 0, F.col("curve"))).alias("_first")
    )
    x = ordering.running_sum(x, keys, {"_cs": "curve"}, max_rows=ordering.largest_group(df, keys)).join(ends, keys)
    w = (F.col("_n") - 1) * F.try_divide(F.col("_cs") - F.col("_first"), F.col("_sum") - F.col("_first"))
    last = F.col("frame_idx") == F.col("_n") - 1
    x = x.withColumn("_w", F.when(last, (F.col("_n") - 1).cast("double")).otherwise(F.coalesce(w, F.lit(0.0))))
    x = ordering.neighbours(x, keys, {"_wn": ("_w", 1), **{f"{c}__n": (c, 1) for c in channels}})
    lo, hi = F.ceil("_w").cast("long"), F.when(last, F.col("_n") - 1).otherwise(F.ceil("_wn") - 1).cast("long")
    x = x.withColumns({"_lo": lo, "_hi": hi}).filter("_lo <= _hi").withColumn("_j", F.explode(F.sequence("_lo", "_hi")))
    f = F.coalesce(F.try_divide(F.col("_j") - F.col("_w"), F.col("_wn") - F.col("_w")), F.lit(0.0))
    made = {c: F.col(c) + (F.coalesce(F.col(f"{c}__n"), F.col(c)) - F.col(c)) * f for c in channels}
    return x.withColumns(made).select(*keys, F.col("_j").alias("frame_idx"), *channels)


def augmented(
    df: DataFrame, channels: list[str], methods: list[str], rounds: int = 1, seed: int = 42, jitter: float = 0.01, sigma: float = 0.2, knot: int = 4, keys: list[str] = RECORDING
) -> DataFrame:
    """(sample_id, keys, method, copy_no, frame_idx, channels): each recording and its copies, each by its own method and seed.

    Methods are jitter, magnitude_warp and time_warp; ids and seeds are those of ``augmentation_plan``. Jitter and
    magnitude warp of all copies are one projection, with curves of one row for each recording and copy; a time warp
    moves frames and is done once for each of its copies. A copy keeps its subject, so it stays in that subject's fold.
    """
    known = {"jitter", "magnitude_warp", "time_warp"}
    if not set(methods) <= known:
        raise ValueError(f"unknown methods: {sorted(set(methods) - known)}")
    x = df.select(*keys, "frame_idx", *channels)
    names = ["sample_id", *keys, "method", "copy_no", "frame_idx", *channels]
    recordings = augmentation_plan(lengths(x, keys), methods, rounds, seed)
    placed = [m for m in methods if m != "time_warp"]
    parts = []
    per = recordings.filter(F.col("method") != "time_warp")
    coef = _curve_coefficients(knot + 2)
    per = per.withColumns({f"_d{i}": 1.0 + sigma * normal_hash(*keys, F.lit(i), seed=F.col("seed")) for i in range(knot + 2)})
    lin = lambda w: sum((F.col(f"_d{i}") * float(v) for i, v in enumerate(w)), F.lit(0.0))
    pieces = F.array(*[F.array(*[lin(coef[m][p]) for p in range(4)]) for m in range(knot + 1)])
    per = per.select("sample_id", *keys, "method", "copy_no", "seed", F.col("n_frames").alias("_n"), F.when(F.col("method") == "magnitude_warp", pieces).alias("_pieces"))
    y = x.join(per, keys) if placed else x.join(per.filter("copy_no < 0"), keys)
    u = F.col("frame_idx") * F.lit(float(knot + 1)) / F.greatest(F.col("_n") - 1, F.lit(1))
    m = F.least(F.floor(u), F.lit(knot)).cast("int")
    y = y.withColumns({"_t": u - m, "_c": F.get("_pieces", m)})
    c, t = F.col("_c"), F.col("_t")
    curve = c[0] + t * (c[1] + t * (c[2] + t * c[3]))
    made = {
        ch: F.when(F.col("method") == "jitter", F.col(ch) + jitter * normal_hash(*keys, "frame_idx", F.lit(ch), seed=F.col("seed")))
        .when(F.col("method") == "magnitude_warp", F.col(ch) * curve)
        .otherwise(F.col(ch))
        for ch in channels
    }
    parts.append(y.withColumns(made).select(*names))
    for k in range(rounds):
        for i, method in enumerate(methods):
            if method == "time_warp":
                copy = recordings.filter(F.col("copy_no") == k * len(methods) + i).select("sample_id", *keys, "method", "copy_no")
                parts.append(time_warp(x, channels, sigma, knot, seed + k + i, keys).join(copy, keys).select(*names))
    return reduce(DataFrame.unionByName, parts)


# ---------------------------------------------------------------- peaks


def peaks(series: DataFrame, keys: list[str], distance: int, max_rows: int | None = None) -> DataFrame:
    """Local maxima (plateau middles) at or above the mean, thinned to ``distance`` by height.

    Input rows (keys, frame_idx, value). Runs of equal values are contracted first, so a plateau of
    any length is two rows. A candidate that tops everything within reach is certainly kept; it
    settles its neighbours and separates what is left into independent stretches for the kernel.
    """
    if max_rows is None:
        max_rows = ordering.largest_group(series, keys)
    x = ordering.neighbours(series, keys, {"_p": ("value", -1)})
    x = x.filter("_p IS NULL OR _p <> value")
    x = ordering.position(x, keys, F.col("frame_idx"), ["frame_idx"], "_run", max_rows=max_rows)
    x = ordering.neighbours(x, keys, {"_ns": ("frame_idx", 1), "_nv": ("value", 1)}, "_run")
    stats = series.groupBy(*keys).agg(F.avg("value").alias("_mean"))
    cand = x.filter("_p < value AND _nv < value").join(stats, keys).filter("value >= _mean")
    mid = F.floor((F.col("frame_idx") + F.col("_ns") - 1) / 2).cast("long")
    cand = cand.select(*keys, mid.alias("peak"), F.col("value").alias("height"))
    reach = distance - 1
    wide = ordering.blocked(cand, "peak", reach, reach)
    near = Window.partitionBy(*keys, "_blk").orderBy("peak").rangeBetween(-reach, reach)
    best = F.max(F.struct("height", "peak")).over(near)
    cand = wide.withColumn("_top", best["peak"] == F.col("peak")).filter("_core").drop("_blk", "_core")
    again = ordering.blocked(cand, "peak", reach, reach)
    touched = F.max(F.col("_top").cast("int")).over(near) == 1
    cand = again.withColumn("_near", touched).filter("_core").drop("_blk", "_core")
    sure = cand.filter("_top")
    rest = cand.select(*keys, "peak", "height", F.col("_top").cast("long").alias("_s"), "_near")
    rest = ordering.cumulate(rest, keys, F.col("peak"), ["peak"], {"_stretch": F.col("_s")}, max_rows=max_rows)
    rest = rest.filter("NOT _near")
    # Many short stretches share one call; they are more than ``distance`` apart.
    rest = rest.withColumn("_chunk", F.floor(F.col("_stretch") / F.lit(256)).cast("long"))

    def one(c):
        k = kernels.greedy_peaks(c["peak"], c["height"], distance)
        return {"peak": c["peak"][k], "height": c["height"][k]}

    kept = per_group(rest, [*keys, "_chunk"], ["peak"], one, "peak BIGINT, height DOUBLE").drop("_chunk")
    return sure.select(*keys, "peak", "height").unionByName(kept)


def temporal_features(df: DataFrame, signal: str, keys: list[str] = RECORDING, rate: float = SAMPLING_RATE) -> DataFrame:
    """Peak, interval and valley statistics (zeros when there are none)."""
    s = df.select(*keys, "frame_idx", F.col(signal).alias("value"))
    d = max(int(rate // 10), 1)
    top = ordering.largest_group(s, keys)
    p = peaks(s, keys, d, top)
    p = ordering.position(p, keys, F.col("peak"), ["peak"], "_i", max_rows=top)
    p = ordering.neighbours(p, keys, {"_prev": ("peak", -1)}, "_i")
    gap = (F.col("peak") - F.col("_prev")) / F.lit(rate)
    a = p.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("num_peaks"),
        F.avg("height").alias("mean_peak_height"),
        F.max("height").alias("max_peak_height"),
        F.stddev_pop("height").alias("std_peak_height"),
        F.avg(gap).alias("mean_inter_peak_interval"),
        F.stddev_pop(gap).alias("std_inter_peak_interval"),
    )
    a = a.withColumn(
        "cv_inter_peak_interval", F.col("std_inter_peak_interval") / (F.col("mean_inter_peak_interval") + 1e-10)
    )
    v = peaks(s.withColumn("value", -F.col("value")), keys, d, top).groupBy(*keys).agg(F.count(F.lit(1)).alias("num_valleys"))
    every = s.select(*keys).distinct()
    out = every.join(a, keys, "left").join(v, keys, "left")
    return out.fillna(0).fillna(0.0)


# ---------------------------------------------------------------- wavelets


def _dwt_level(x: DataFrame, k: list[str], size: int, halo: int = 8) -> DataFrame:
    """One db4 level of (k, n, idx, value) as blocks: adds ``band`` (a/d), new n and idx."""
    x = ordering.blocked(x, "idx", halo, halo, size)

    def one(c):
        idx, n, v = c["idx"].astype(int), int(c["n"][0]), c["value"]
        own = idx[c["_core"].astype(bool)]
        if not len(own):
            return None
        # This block owns outputs o with 2o + 1 inside its core; the last block owns the tail.
        first = own[0] // 2
        last = (n + 7) // 2 if own[-1] == n - 1 else (own[-1] + 1) // 2
        o = np.arange(first, last)
        at = np.mod(2 * o[:, None] + 1 - np.arange(8)[None, :], 2 * n)
        at = np.where(at < n, at, 2 * n - 1 - at)
        w = v[np.clip(at - idx[0], 0, len(v) - 1)]
        both = np.concatenate([w @ kernels.DB4_LOW, w @ kernels.DB4_HIGH])
        return {
            "band": np.repeat(["a", "d"], len(o)), "idx": np.tile(o, 2), "value": both,
            "n": np.full(2 * len(o), (n + 7) // 2),
        }

    return per_group(x, [*k, "_blk"], ["idx"], one, "band STRING, idx BIGINT, value DOUBLE, n BIGINT").drop("_blk")


def _wavelet_tree(series: DataFrame, keys: list[str], level: int, packets: bool, limit: int, size: int) -> DataFrame:
    """Coefficients (keys, channel, path, value) of the full tree's leaves or of the usual pyramid."""
    k = [*keys, "channel"]
    top = ordering.largest_group(series, k)
    x = ordering.attach(series, k, {"n": F.count(F.lit(1))}, top)
    if top <= limit:

        def one(c):
            nodes = {"": c["value"]}
            for step in range(level):
                nxt = {}
                for path, v in nodes.items():
                    if packets or path == "a" * step:
                        a, d = kernels.dwt_step(v)
                        nxt[path + "a"], nxt[path + "d"] = a, d
                    else:
                        nxt[path] = v
                nodes = nxt
            sizes = [len(v) for v in nodes.values()]
            return {
                "path": np.repeat(list(nodes), sizes).astype(object),
                "idx": np.concatenate([np.arange(s) for s in sizes]),
                "value": np.concatenate(list(nodes.values())),
            }

        return per_group(x, k, ["idx"], one, "path STRING, idx BIGINT, value DOUBLE")
    done, cur = [], x.withColumn("path", F.lit(""))
    kp = [*k, "path"]
    for step in range(level):
        nxt = _dwt_level(cur, kp, size).withColumn("path", F.concat("path", "band")).drop("band")
        if packets:
            cur = nxt
        else:
            done.append(nxt.filter(F.col("path").endswith("d")))
            cur = nxt.filter(F.col("path").endswith("a"))
    out = cur
    for part in done:
        out = out.unionByName(part)
    return out.select(*kp, "idx", "value")


def wavelet_features(
    series: DataFrame, keys: list[str] = RECORDING, level: int = 5, limit: int = SERIES_LIMIT, size: int = ordering.BLOCK
) -> DataFrame:
    """mean, std, energy, max |c|, energy ratio and entropy per band, one row per band."""
    c = _wavelet_tree(series, keys, level, False, limit, size)
    k = [*keys, "channel"]
    deepest = F.col("path") == "a" * level
    # Coefficient lists run from the coarsest detail (level 1) to the finest (level ``level``).
    name = F.when(deepest, "approximation").otherwise(
        F.concat(F.lit("detail_level"), (level + 1 - F.length("path")).cast("string"))
    )
    c = c.withColumn("band", name)
    a = F.abs("value")
    c = ordering.attach(c, [*k, "band"], {"_abs": F.sum(a)}, ordering.largest_group(series, k))
    p = a / (F.col("_abs") + 1e-10)
    tot = c.groupBy(*k, "band").agg(
        F.avg("value").alias("mean"),
        F.stddev_pop("value").alias("std"),
        F.sum(F.col("value") ** 2).alias("energy"),
        F.max(a).alias("max"),
        (-F.sum(p * F.log2(p + 1e-10))).alias("entropy"),
    )
    # level + 1 rows per series reach this window.
    total = F.sum("energy").over(Window.partitionBy(*k))
    return tot.withColumn("energy_ratio", F.col("energy") / (total + 1e-10))


def wavelet_packets(
    series: DataFrame, keys: list[str] = RECORDING, level: int = 3, limit: int = SERIES_LIMIT, size: int = ordering.BLOCK
) -> DataFrame:
    """energy, mean, std per packet node, with the node's place in frequency order."""
    c = _wavelet_tree(series, keys, level, True, limit, size)
    # Frequency order is the Gray code of the path: each 'd' flips the meaning of the letters below it.
    place, flipped = F.lit(0), F.lit(0)
    for i in range(level):
        bit = F.when(F.substring("path", i + 1, 1) == "d", 1).otherwise(0)
        flipped = flipped.bitwiseXOR(bit)
        place = place * 2 + flipped
    return c.groupBy(*keys, "channel", "path").agg(
        F.sum(F.col("value") ** 2).alias("energy"), F.avg("value").alias("mean"), F.stddev_pop("value").alias("std")
    ).withColumn("frequency_order", place)


def continuous_wavelet(
    series: DataFrame, keys: list[str] = RECORDING, max_scale: int = 127, size: int = 1 << 14
) -> DataFrame:
    """Mean and max energy of a real Morlet transform over scales 1..max_scale (zero outside the series)."""
    k = [*keys, "channel"]
    x = ordering.blocked(series, "idx", 8 * max_scale, 8 * max_scale, size)

    def one(c):
        core = np.flatnonzero(c["_core"])
        if not len(core):
            return None
        total, top = kernels.morlet_energy(c["value"], max_scale, slice(core[0], core[-1] + 1))
        return {"total": total, "top": top, "rows": len(core)}

    part = per_group(x, [*k, "_blk"], ["idx"], one, "total DOUBLE, top DOUBLE, rows BIGINT")
    return part.groupBy(*k).agg(
        (F.sum("total") / (F.sum("rows") * max_scale)).alias("cwt_mean_energy"), F.max("top").alias("cwt_max_energy")
    )


# ---------------------------------------------------------------- pairwise entropies


def entropies(series: DataFrame, keys: list[str] = RECORDING, size: int = 2048) -> DataFrame:
    """Sample, approximate and fuzzy entropy (m = 2, r = 0.2 std) from template counts.

    Templates are cut into blocks of ``size``; every unordered pair of blocks of a series is one
    bounded task unit, and counts add up per template. Work is quadratic by definition, memory is not.
    """
    k = [*keys, "channel"]
    x = ordering.attach(series, k, {"n": F.count(F.lit(1)), "_sp": F.stddev_pop("value")})
    x = ordering.neighbours(x, k, {"v1": ("value", 1), "v2": ("value", 2)}, "idx").filter("v1 IS NOT NULL")
    x = x.withColumn("r", 0.2 * F.col("_sp")).withColumn("_b", F.floor(F.col("idx") / F.lit(size)).cast("long"))
    nb = F.ceil((F.col("n") - 1) / F.lit(float(size))).cast("long")
    side = F.transform(
        F.sequence(F.lit(0).cast("long"), nb - 1),
        lambda o: F.struct(F.least("_b", o).alias("bi"), F.greatest("_b", o).alias("bj")),
    )
    x = x.select(*k, "idx", "value", "v1", "v2", "n", "r", "_sp", "_b", F.explode(side).alias("_q"))
    x = x.select(*k, "_q.bi", "_q.bj", "_b", "idx", "value", "v1", "v2", "n", "r", "_sp")

    def one(c):
        rows = np.stack([c["value"], c["v1"], np.where(np.isnan(c["v2"]), np.inf, c["v2"])], axis=1)
        n, r = int(c["n"][0]), float(c["r"][0])
        rf = 0.2 * float(c["_sp"][0]) * np.sqrt(n / (n - 1.0))
        left = c["_b"] == c["bi"]
        same = c["bi"][0] == c["bj"][0]
        a, ia = rows[left], c["idx"][left]
        b, ib = (a, ia) if same else (rows[~left], c["idx"][~left])
        full_a, full_b = np.isfinite(a[:, 2]), np.isfinite(b[:, 2])
        # Row i has a length-2 template always, a length-3 one unless it is the last.
        ta, sa, ua = kernels.template_counts(a, b, full_a, full_b, r)
        f2, f3 = kernels.fuzzy_sums(a[full_a], b[full_b], rf) if rf > 0 else (np.nan, np.nan)
        out = {"idx": ia, "c2": ta, "s2": sa, "c3": ua}
        fz = np.zeros((len(ia), 2))
        fz[0] = (f2, f3) if same else (2 * f2, 2 * f3)
        if not same:
            tb, sb, ub = kernels.template_counts(b, a, full_b, full_a, r)
            out = {"idx": np.concatenate([ia, ib]), "c2": np.concatenate([ta, tb]), "s2": np.concatenate([sa, sb]), "c3": np.concatenate([ua, ub])}
            fz = np.concatenate([fz, np.zeros((len(ib), 2))])
        return {**out, "n": np.full(len(fz), n), "f2": fz[:, 0], "f3": fz[:, 1]}

    part = per_group(x, [*k, "bi", "bj"], ["_b", "idx"], one, "idx BIGINT, n BIGINT, c2 DOUBLE, s2 DOUBLE, c3 DOUBLE, f2 DOUBLE, f3 DOUBLE")
    per = part.groupBy(*k, "idx").agg(F.first("n").alias("n"), *[F.sum(c).alias(c) for c in ("c2", "s2", "c3", "f2", "f3")])
    n = F.first("n").cast("double")
    inner = F.col("idx") < F.col("n") - 2
    phi2 = F.avg(F.ln(F.col("c2") / (F.col("n") - 1)))
    phi3 = F.avg(F.when(inner, F.ln(F.when(F.col("c3") > 0, F.col("c3")) / (F.col("n") - 2))))
    own2 = F.sum(F.when(inner, F.col("s2") - 1))
    own3 = F.sum(F.when(inner, F.col("c3") - 1))
    fz2, fz3 = F.sum("f2") - (n - 2), F.sum("f3") - (n - 2)
    return per.groupBy(*k).agg(
        (-F.ln(F.nullif(F.try_divide(own3, own2), F.lit(0.0)))).alias("sample_entropy"),
        (phi2 - phi3).alias("approx_entropy"),
        (-F.ln(F.nullif(F.try_divide(fz3, fz2), F.lit(0.0)))).alias("fuzzy_entropy"),
    )


def lempel_ziv(series: DataFrame, keys: list[str] = RECORDING, limit: int = SERIES_LIMIT) -> DataFrame:
    """Normalised Lempel-Ziv complexity of the median-binarised signal.

    The parse looks back over all earlier symbols, so one series is one call; only this measure cannot be cut into blocks.
    Up to ``limit`` frames the call takes the values and finds their median; longer series come as symbols (one byte a frame).
    Recordings without a name in all of ``keys`` are left out.
    """
    k = [*keys, "channel"]

    def parsed(b):
        n, kinds = len(b), max(len(np.unique(b)), 2)
        return {"lempel_ziv": kernels.lempel_ziv(b.tobytes()) / (n / (np.log(n) / np.log(kinds))) if n > 1 else np.nan}

    if ordering.largest_group(series, k) <= limit:
        whole = lambda c: parsed((c["value"] > np.median(c["value"])).astype(np.uint8))
        return per_group(series.select(*k, "idx", "value").dropna(subset=k), k, ["idx"], whole, "lempel_ziv DOUBLE")
    med = ordering.quantiles(series, k, "value", {"_med": 0.5})
    bits = series.join(med, k).select(*k, "idx", (F.col("value") > F.col("_med")).cast("byte").alias("bit"))
    return per_group(bits, k, ["idx"], lambda c: parsed(c["bit"].astype(np.uint8)), "lempel_ziv DOUBLE")


def _nearest(a, ia, b, ib, gap: int):
    """For each of the points ``a`` (rows, frame numbers) the distance and frame number of its nearest of ``b``."""
    dist, who = [], []
    for s in range(0, len(a), 512):
        d = np.sqrt(((a[s : s + 512, None, :] - b[None, :, :]) ** 2).sum(axis=2))
        d[np.abs(ia[s : s + 512, None] - ib[None, :]) <= gap] = np.inf
        j = d.argmin(axis=1)
        dist.append(d[np.arange(len(d)), j])
        who.append(ib[j])
    return np.concatenate(dist), np.concatenate(who)


def lyapunov(series: DataFrame, keys: list[str] = RECORDING, steps: int = 20, size: int = 2048) -> DataFrame:
    """Largest Lyapunov exponent: slope of the mean log divergence of nearest neighbours.

    Delay 1, dimension 3; neighbours closer in time than the mean period do not count. A series of up to ``size`` frames
    is one group: neighbours and divergences come from it, and one sum for each step leaves it. Longer series go by
    bounded block pairs; a point then carries the frames of its walk, so that each point is joined once, not once a step.
    """
    k = [*keys, "channel"]
    n = series.groupBy(*k).agg(F.count(F.lit(1)).alias("n"))
    # Mean period from the power-weighted mean frequency: by Parseval, sum |X|^2 and the same sum
    # weighted by frequency come from the Welch table of the series.
    from kinelake.operators.spectral import welch

    psd = welch(series, keys, 1.0)
    sep = psd.groupBy(*k).agg(F.try_divide(F.sum("power"), F.sum(F.col("freq") * F.col("power"))).alias("_per"))
    sep = sep.select(*k, F.ceil("_per").cast("long").alias("sep"))
    facts = n.join(sep, k)

    def whole(c):
        v, idx = c["value"], c["idx"]
        m = len(v) - 2
        rows = np.stack([v[:m], v[1 : m + 1], v[2:]], axis=1)
        ok = m - steps + 1
        dist, who = _nearest(rows[:ok], idx[:ok], rows[:ok], idx[:ok], int(c["sep"][0]))
        at = np.flatnonzero(dist < np.inf)
        to = np.searchsorted(idx, who[at])
        sums, counts = np.zeros(steps), np.zeros(steps, np.int64)
        for s in range(steps):
            d = np.sqrt(((rows[at + s] - rows[to + s]) ** 2).sum(axis=1))
            d = d[d > 0]
            sums[s], counts[s] = np.log(d).sum(), len(d)
        return {"step": np.arange(steps, dtype=np.int32), "s": sums, "c": counts}

    least = steps + 2  # a shorter series has no point with a whole walk
    short = series.join(facts.filter((F.col("n") >= least) & (F.col("n") <= size)), k).select(*k, "idx", "value", "sep")
    curve = per_group(short, k, ["idx"], whole, "step INT, s DOUBLE, c BIGINT")
    if ordering.largest_group(series, k) > size:
        curve = curve.union(_long_walks(series.join(facts.filter((F.col("n") >= least) & (F.col("n") > size)), k), k, steps, size))
    curve = curve.filter("c > 0").withColumn("y", F.col("s") / F.col("c"))
    t = F.col("step").cast("double")
    return curve.groupBy(*k).agg(F.try_divide(F.covar_pop(t, "y"), F.var_pop(t)).alias("lyapunov"))


def _long_walks(long: DataFrame, k: list[str], steps: int, size: int) -> DataFrame:
    """(k, step, s, c): sum and number of the log divergences of series over ``size`` frames, by bounded block pairs."""
    tail = steps + 1  # frames after a point that its walk needs
    blocks = ordering.blocked(long, "idx", 0, tail, max(size, tail))
    path = F.collect_list("value").over(Window.partitionBy(*k, "_blk").orderBy("idx").rowsBetween(0, tail))
    x = blocks.withColumn("path", path).filter((F.col("_core")) & (F.col("idx") < F.col("n") - tail)).drop("_blk", "_core")
    nb = F.ceil((F.col("n") - tail) / F.lit(float(size))).cast("long")
    at = x.select(*k, "idx", *[F.get("path", F.lit(i)).alias(c) for i, c in enumerate(("value", "v1", "v2"))], "sep", nb.alias("_nb"))
    at = at.withColumn("_b", F.floor(F.col("idx") / F.lit(size)).cast("long"))
    pairs = F.transform(
        F.sequence(F.lit(0).cast("long"), F.col("_nb") - 1),
        lambda o: F.struct(F.least("_b", o).alias("bi"), F.greatest("_b", o).alias("bj")),
    )
    at = at.select(*k, "idx", "value", "v1", "v2", "sep", "_b", F.explode(pairs).alias("_q"))
    at = at.select(*k, "_q.bi", "_q.bj", "_b", "idx", "value", "v1", "v2", "sep")

    def one(c):
        rows = np.stack([c["value"], c["v1"], c["v2"]], axis=1)
        left, gap = c["_b"] == c["bi"], int(c["sep"][0])
        same = c["bi"][0] == c["bj"][0]
        a, ia = rows[left], c["idx"][left]
        b, ib = (a, ia) if same else (rows[~left], c["idx"][~left])
        both = [(ia, *_nearest(a, ia, b, ib, gap))] + ([] if same else [(ib, *_nearest(b, ib, a, ia, gap))])
        idx, dist, who = (np.concatenate(p) for p in zip(*both))
        return {"idx": idx, "dist": dist, "who": who}

    near = per_group(at, [*k, "bi", "bj"], ["_b", "idx"], one, "idx BIGINT, dist DOUBLE, who BIGINT")
    best = near.filter(F.col("dist") < float("inf")).groupBy(*k, "idx").agg(
        F.min(F.struct("dist", "who"))["who"].alias("who")
    )
    walk = lambda name, tag: x.select(*k, F.col("idx").alias(name), F.col("path").alias(tag))
    d = best.join(walk("idx", "_i"), [*k, "idx"]).join(walk("who", "_j"), [*k, "who"])
    gap2 = F.transform(F.arrays_zip("_i", "_j"), lambda p: (p["_i"] - p["_j"]) * (p["_i"] - p["_j"]))
    d = d.select(*k, gap2.alias("_g"), F.explode(F.sequence(F.lit(0), F.lit(steps - 1))).alias("step"))
    dist = F.sqrt(sum((F.get("_g", F.col("step") + i) for i in range(3)), F.lit(0.0)))
    far = d.select(*k, "step", dist.alias("_d")).filter("_d > 0").groupBy(*k, "step")
    return far.agg(F.sum(F.ln("_d")).alias("s"), F.count(F.lit(1)).alias("c"))


# ---------------------------------------------------------------- DTW and embedding


def dtw_distances(samples: DataFrame, sample_id: str, values: str, block: int = 64) -> DataFrame:
    """Distances of all pairs id_a < id_b for equal-length array samples (ARRAY or ARRAY<ARRAY>).

    All pairs are the result itself. Samples are dealt into blocks by hash; a pair of blocks is one
    bounded unit, so each sample is copied once per block and never once per partner.
    """
    n = samples.count()
    blocks = max(1, -(-n // block))
    x = samples.withColumn("_b", F.pmod(F.xxhash64(sample_id), F.lit(blocks)))
    side = F.transform(
        F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long")),
        lambda o: F.struct(F.least("_b", o).alias("bi"), F.greatest("_b", o).alias("bj")),
    )
    x = x.select(F.col(sample_id).alias("_id"), F.col(values).alias("_v"), "_b", F.explode(side).alias("_q"))
    x = x.select("_q.bi", "_q.bj", "_b", "_id", "_v")

    def one(c):
        left = c["_b"] == c["bi"]
        same = c["bi"][0] == c["bj"][0]
        if same:
            i, j = np.triu_indices(len(left), 1)
        else:
            p, q = np.flatnonzero(left), np.flatnonzero(~left)
            i, j = np.repeat(p, len(q)), np.tile(q, len(p))
        if not len(i):
            return None
        v = [np.stack(s) if s.dtype == object else s for s in c["_v"]]
        v = [s[:, None] if s.ndim == 1 else s for s in v]
        shapes = {s.shape[0] for s in v}
        ids = c["_id"]
        out = np.empty(len(i))
        if len(shapes) == 1:
            m = np.stack(v).astype(float)
            for s in range(0, len(i), 1024):
                out[s : s + 1024] = kernels.dtw_distances(m[i[s : s + 1024]], m[j[s : s + 1024]])
        else:
            for s in range(len(i)):
                out[s] = kernels.dtw_distances(v[i[s]][None].astype(float), v[j[s]][None].astype(float))[0]
        a, b = ids[i], ids[j]
        swap = a > b
        return {"id_a": np.where(swap, b, a), "id_b": np.where(swap, a, b), "distance": out}

    id_type = samples.schema[sample_id].dataType.simpleString()
    out = per_group(x, ["bi", "bj"], ["_id"], one, f"id_a {id_type}, id_b {id_type}, distance DOUBLE")
    return out.drop("bi", "bj")


def _symmetric(dist: DataFrame, ids: DataFrame) -> DataFrame:
    both = dist.unionByName(dist.select(F.col("id_b").alias("id_a"), F.col("id_a").alias("id_b"), "distance"))
    return both.unionByName(ids.select(F.col("id").alias("id_a"), F.col("id").alias("id_b"), F.lit(0.0).alias("distance")))


def classical_mds(dist: DataFrame, ids: DataFrame, dims: int = 2, iterations: int = 30) -> DataFrame:
    """(id, dim, value): double-centred squared distances, leading eigenvectors by subspace iteration.

    Each iteration is one join and one aggregate over the pair table; vectors are (id, v0, v1, ..)
    tables cut with a reliable checkpoint so lineage stays short. Only dims x dims products reach the
    driver. Results are z-scored per dimension.
    """
    from kinelake.sources.store import reliable

    d2 = _symmetric(dist, ids).withColumn("d2", F.col("distance") ** 2)
    row = d2.groupBy("id_a").agg(F.avg("d2").alias("_ra"))
    col = row.select(F.col("id_a").alias("id_b"), F.col("_ra").alias("_rb"))
    allm = d2.agg(F.avg("d2").alias("_all"))
    b = d2.join(row, "id_a").join(col, "id_b").crossJoin(F.broadcast(allm))
    b = reliable(b.select("id_a", "id_b", (-0.5 * (F.col("d2") - F.col("_ra") - F.col("_rb") + F.col("_all"))).alias("g")))
    v = ids.select("id", *[normal_hash(F.col("id").cast("string"), seed=d).alias(f"v{d}") for d in range(dims)])
    names = [f"v{d}" for d in range(dims)]
    size = np.zeros(dims)
    for _ in range(iterations):
        step = b.join(ordering.small_side(v.withColumnRenamed("id", "id_b")), "id_b").groupBy("id_a")
        y = reliable(step.agg(*[F.sum(F.col("g") * F.col(n)).alias(n) for n in names]).withColumnRenamed("id_a", "id"))
        # dims x dims products: orthonormalise the columns with one small Cholesky factor.
        cells = y.agg(*[F.sum(F.col(p) * F.col(q)).alias(f"{p}{q}") for p in names for q in names]).first()
        gram = np.array([[cells[f"{p}{q}"] for q in names] for p in names])
        upper = np.linalg.cholesky(gram + 1e-300 * np.eye(dims)).T
        mix = np.linalg.inv(upper)
        v = y.select("id", *[sum((F.col(names[i]) * float(mix[i, j]) for i in range(j + 1)), F.lit(0.0)).alias(names[j]) for j in range(dims)])
        new = np.diag(upper)
        if np.all(np.abs(new - size) <= 1e-9 * np.maximum(new, 1.0)):
            size = new
            break
        size = new
    scaled = v.select("id", *[(F.col(n) * float(np.sqrt(max(s, 0.0)))).alias(str(d)) for d, (n, s) in enumerate(zip(names, size))])
    out = scaled.unpivot(["id"], [str(d) for d in range(dims)], "dim", "value").withColumn("dim", F.col("dim").cast("int"))
    s = out.groupBy("dim").agg(F.avg("value").alias("_m"), F.stddev_pop("value").alias("_s"))
    z = (F.col("value") - F.col("_m")) / F.when(F.col("_s") == 0, 1.0).otherwise(F.col("_s"))
    return out.join(s, "dim").select("id", "dim", z.alias("value"))


def geodesic_distances(dist: DataFrame, ids: DataFrame, neighbours: int = 5) -> DataFrame:
    """Isomap distances: k nearest neighbours as a graph, shortest paths by min-plus doubling."""
    from kinelake.sources.store import reliable

    full = _symmetric(dist, ids)
    w = Window.partitionBy("id_a").orderBy("distance", "id_b")
    # The window holds one row of the distance matrix; ties break by id.
    near = full.filter("id_a <> id_b").withColumn("_k", F.row_number().over(w)).filter(F.col("_k") <= neighbours)
    edges = near.select("id_a", "id_b", "distance")
    edges = edges.unionByName(edges.select(F.col("id_b").alias("id_a"), F.col("id_a").alias("id_b"), "distance"))
    edges = edges.unionByName(ids.select(F.col("id").alias("id_a"), F.col("id").alias("id_b"), F.lit(0.0).alias("distance")))
    paths = reliable(edges.groupBy("id_a", "id_b").agg(F.min("distance").alias("distance")))
    last = None
    while True:
        left = paths.select("id_a", F.col("id_b").alias("mid"), F.col("distance").alias("d1"))
        right = paths.select(F.col("id_a").alias("mid"), "id_b", F.col("distance").alias("d2"))
        paths = reliable(left.join(right, "mid").groupBy("id_a", "id_b").agg(F.min(F.col("d1") + F.col("d2")).alias("distance")))
        state = paths.agg(F.count(F.lit(1)), F.round(F.sum("distance"), 9)).first()
        if state == last:
            return paths.filter("id_a < id_b")
        last = state
