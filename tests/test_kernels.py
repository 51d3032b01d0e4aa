"""Numpy-backed operators against closed forms and brute force, on plain and blocked paths."""

import re

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from kinelake.functions import kernels
from kinelake.operators import kernel_ops as ko
from kinelake.operators import spectral

KEYS = ["subject_id", "task"]


@pytest.fixture(scope="module")
def data(make_series):
    return make_series({("a", 1): 150, ("b", 1): 61}, ("x", "y"))


def values(pdf, subject, col="x"):
    return pdf[pdf.subject_id == subject][col].to_numpy()


def as_series(df):
    return spectral.finite_series(df, ["x"], KEYS)


def test_sine_peaks_at_its_frequency(spark):
    t = np.arange(1000) / 50.0
    pdf = pd.DataFrame({"subject_id": "s", "task": 1, "frame_idx": np.arange(1000), "x": np.sin(2 * np.pi * 5 * t)})
    psd = spectral.welch(as_series(spark.createDataFrame(pdf)), KEYS)
    f = spectral.spectral_features(psd, KEYS).first()
    assert f["dominant_frequency"] == pytest.approx(5.0, abs=0.2)
    # One-sided density integrates to the variance.
    assert f["spectral_energy_total"] * 50 / 256 == pytest.approx(0.5, rel=0.05)


@pytest.mark.parametrize("limit", [10_000, 40])
def test_whole_series_transforms(data, limit):
    df, pdf = data
    got = spectral.fft_magnitude(as_series(df), KEYS, limit).toPandas().set_index("subject_id")
    cc = spectral.max_cross_correlation(df, "x", "y", KEYS, limit).toPandas().set_index("subject_id")
    rs = spectral.resample(df, ["x"], 2.5, KEYS, limit).toPandas()
    for s in ("a", "b"):
        x, y = values(pdf, s), values(pdf, s, "y")
        mag = np.abs(np.fft.fft(x))[: len(x) // 2]
        assert got.loc[s, "fft_max_magnitude"] == pytest.approx(mag.max(), rel=1e-9)
        assert got.loc[s, "fft_mean_magnitude"] == pytest.approx(mag.mean(), rel=1e-9)
        want = np.correlate(x - x.mean(), y - y.mean(), "same").max()
        assert cc.loc[s, "max_cross_correlation"] == pytest.approx(want, rel=1e-9)
        mine = rs[rs.subject_id == s].sort_values("frame_idx").x.to_numpy()
        np.testing.assert_allclose(mine, kernels.fourier_resample(x, int(len(x) / 2.5)), atol=1e-8)


@pytest.mark.parametrize("kind,cut", [("low", 6.0), ("high", 1.0), ("band", [1.0, 6.0])])
def test_filter_blocks_equal_the_whole_series(make_series, kind, cut):
    b, a = kernels.butterworth(4, cut, 50.0, kind)
    df, pdf = make_series({("a", 1): 6 * kernels.settle_length(a)}, ("x",))
    got = ko.butterworth_filter(df, ["x"], kind, cut, keys=KEYS, size=kernels.settle_length(a)).toPandas().sort_values("frame_idx")
    want = kernels.zero_phase(b, a, values(pdf, "a")[:, None], True, True)[:, 0]
    np.testing.assert_allclose(got.x, want, atol=1e-7 * np.abs(want).max())


def test_butterworth_gain():
    b, a = kernels.butterworth(4, 6.0, 50.0, "low")
    gain = lambda f: abs(np.polyval(b, np.exp(2j * np.pi * f / 50)) / np.polyval(a, np.exp(2j * np.pi * f / 50)))
    assert gain(1e-9) == pytest.approx(1.0) and gain(6.0) == pytest.approx(np.sqrt(0.5), rel=1e-6) and gain(20.0) < 1e-2
    b, a = kernels.butterworth(4, [1.0, 6.0], 50.0, "band")
    gain = lambda f: abs(np.polyval(b, np.exp(2j * np.pi * f / 50)) / np.polyval(a, np.exp(2j * np.pi * f / 50)))
    assert gain(1.0) == pytest.approx(np.sqrt(0.5), rel=1e-5) and gain(6.0) == pytest.approx(np.sqrt(0.5), rel=1e-5)


@pytest.mark.parametrize("kind,degree", [("cubic", 3), ("quadratic", 2)])
def test_spline_blocks_equal_the_whole_series(make_series, kind, degree):
    df, pdf = make_series({("a", 1): 400}, ("x",))
    got = ko.interpolate_spline(df, ["x"], 777, kind, KEYS, size=100).toPandas().sort_values("frame_idx")
    x = values(pdf, "a")
    want = kernels.spline_at(x[:, None], np.arange(777) * 399 / 776, degree)[:, 0]
    assert list(got.frame_idx) == list(range(777))
    np.testing.assert_allclose(got.x, want, atol=1e-9 * np.abs(want).max())
    poly = np.polynomial.Polynomial([1.0, -2.0, 0.5, 0.1][: degree + 1])
    at = np.linspace(0, 11, 40)
    np.testing.assert_allclose(kernels.spline_at(poly(np.arange(12.0))[:, None], at, degree)[:, 0], poly(at), atol=1e-9)


def _peaks(x, distance):
    """Plateau-aware local maxima at or above the mean, thinned by height."""
    found, i = [], 1
    while i < len(x) - 1:
        if x[i - 1] < x[i]:
            j = i
            while j + 1 < len(x) and x[j + 1] == x[i]:
                j += 1
            if j + 1 < len(x) and x[j + 1] < x[i] and x[i] >= x.mean():
                found.append((i + j) // 2)
            i = j + 1
        else:
            i += 1
    found = np.array(found, dtype=int)
    return found[kernels.greedy_peaks(found, x[found], distance)] if len(found) else found


def test_peaks_match_a_direct_scan(spark):
    rng = np.random.default_rng(0)
    rows, want = [], {}
    for s in range(6):
        x = rng.integers(0, 6, 120).astype(float) if s % 2 else rng.normal(size=90)
        want[s] = _peaks(x, 5)
        rows.append(pd.DataFrame({"subject_id": s, "frame_idx": np.arange(len(x)), "value": x}))
    got = ko.peaks(spark.createDataFrame(pd.concat(rows)), ["subject_id"], 5).toPandas()
    for s, w in want.items():
        assert sorted(got[got.subject_id == s].peak) == list(w)


@pytest.mark.parametrize("limit,size", [(10_000, 64), (10, 16)])
def test_wavelets_reconstruct_energy_and_match_direct_steps(data, limit, size):
    df, pdf = data
    s = as_series(df)
    tree = ko._wavelet_tree(s, KEYS, 3, False, limit, size).toPandas()
    packets = ko.wavelet_packets(s, KEYS, 3, limit, size).toPandas()
    for subject in ("a", "b"):
        a, d = kernels.dwt_step(values(pdf, subject))
        mine = tree[(tree.subject_id == subject) & (tree.path == "d")].sort_values("idx").value
        np.testing.assert_allclose(mine, d, atol=1e-9)
        aaa = kernels.dwt_step(kernels.dwt_step(a)[0])[0]
        got = packets[(packets.subject_id == subject) & (packets.path == "aaa")].iloc[0]
        assert got.energy == pytest.approx((aaa**2).sum())
    low, high = kernels.DB4_LOW, kernels.DB4_HIGH
    assert low.sum() == pytest.approx(np.sqrt(2)) and (low**2).sum() == pytest.approx(1.0) and low @ high == pytest.approx(0.0)


def test_continuous_wavelet_matches_direct_sums(data):
    df, pdf = data
    got = ko.continuous_wavelet(as_series(df), KEYS, 6, size=64).toPandas().set_index("subject_id")
    for s in ("a", "b"):
        x = values(pdf, s)
        lag = np.arange(len(x))[:, None] - np.arange(len(x))[None]
        e = []
        for k in range(1, 7):
            t = lag / k
            w = np.where(np.abs(lag) <= 8 * k, np.exp(-t * t / 2) * np.cos(5 * t) / np.sqrt(k), 0.0)
            e.append((w @ x) ** 2)
        assert got.loc[s, "cwt_mean_energy"] == pytest.approx(np.mean(e), rel=1e-7)
        assert got.loc[s, "cwt_max_energy"] == pytest.approx(np.max(e), rel=1e-7)


@pytest.mark.parametrize("size", [2048, 17])
def test_entropies_match_direct_counts(data, size):
    df, pdf = data
    got = ko.entropies(as_series(df), KEYS, size).toPandas().set_index("subject_id")
    for s in ("a", "b"):
        x = values(pdf, s)
        n, r = len(x), 0.2 * x.std()
        t2 = np.stack([x[:-1], x[1:]], axis=1)
        t3 = np.stack([x[:-2], x[1:-1], x[2:]], axis=1)
        near = lambda t: np.abs(t[:, None] - t[None]).max(axis=2)
        c2, c3 = (near(t2) <= r).sum(axis=1), (near(t3) <= r).sum(axis=1)
        inner = (near(t2[:-1]) <= r).sum(axis=1)
        assert got.loc[s, "approx_entropy"] == pytest.approx(np.log(c2 / (n - 1)).mean() - np.log(c3 / (n - 2)).mean())
        assert got.loc[s, "sample_entropy"] == pytest.approx(-np.log((c3 - 1).sum() / (inner - 1).sum()))
        rf, sums = 0.2 * x.std(ddof=1), []
        for t in (t2[:-1], t3):
            t = t - t.mean(axis=1, keepdims=True)
            sums.append(np.exp(-near(t) / rf).sum() - len(t))
        assert got.loc[s, "fuzzy_entropy"] == pytest.approx(-np.log(sums[1] / sums[0]))


def test_lempel_ziv_phrases():
    # 0 | 001 | 10 | 100 | 1000 | 101 is the textbook parse of this string.
    assert kernels.lempel_ziv(bytes(int(c) for c in "0001101001000101")) == 6
    assert kernels.lempel_ziv(bytes(16)) == 2


@pytest.mark.parametrize("size", [2048, 23])
def test_lyapunov_of_blocks(data, size):
    df, _ = data
    a = ko.lyapunov(as_series(df), KEYS, 5).toPandas().sort_values("subject_id").lyapunov
    b = ko.lyapunov(as_series(df), KEYS, 5, size).toPandas().sort_values("subject_id").lyapunov
    np.testing.assert_allclose(a, b, rtol=1e-9)


def test_lyapunov_moves_a_point_once_for_all_steps(data):
    """Equal to the plain computation, and no plan carries a row for each step and point through an exchange."""
    df, pdf = data
    got = {(r.subject_id, r.task): r.lyapunov for r in ko.lyapunov(as_series(df), KEYS, 5).collect()}
    sep = {(r.subject_id, r.task): r.sep for r in _mean_periods(as_series(df))}
    for (s, t), g in pdf.groupby(["subject_id", "task"]):
        v = g.sort_values("frame_idx").x.to_numpy()
        e = np.stack([v[:-2], v[1:-1], v[2:]], axis=1)
        n, logs = len(v) - 6, [[] for _ in range(5)]
        for i in range(n):
            d = np.sqrt(((e[:n] - e[i]) ** 2).sum(axis=1))
            d[np.abs(np.arange(n) - i) <= sep[s, t]] = np.inf
            if d.min() < np.inf:
                for k in range(5):
                    far = np.linalg.norm(e[i + k] - e[d.argmin() + k])
                    logs[k] += [np.log(far)] if far > 0 else []
        assert got[s, t] == pytest.approx(np.polyfit(range(5), [np.mean(x) for x in logs], 1)[0], rel=1e-6)
    plan = ko.lyapunov(as_series(df), KEYS, 5)._jdf.queryExecution().optimizedPlan().toString()
    assert not re.search(r"Generate explode.*step#", plan)


def _mean_periods(series):
    psd = spectral.welch(series, KEYS, 1.0).groupBy(*KEYS)
    return psd.agg(F.ceil(F.sum("power") / F.sum(F.col("freq") * F.col("power"))).alias("sep")).collect()


def _dtw(a, b):
    c = np.full((len(a) + 1, len(b) + 1), np.inf)
    c[0, 0] = 0
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            c[i, j] = abs(a[i - 1] - b[j - 1]) + min(c[i - 1, j], c[i, j - 1], c[i - 1, j - 1])
    return c[-1, -1]


@pytest.mark.parametrize("equal", [True, False])
def test_dtw_pairs_and_embedding(spark, equal):
    rng = np.random.default_rng(1)
    v = [rng.normal(size=9 if equal else int(rng.integers(5, 12))).tolist() for _ in range(11)]
    df = spark.createDataFrame(pd.DataFrame({"id": np.arange(11), "v": v}))
    d = ko.dtw_distances(df, "id", "v", block=4)
    got = d.toPandas()
    assert len(got) == 55
    for r in got.itertuples():
        assert r.distance == pytest.approx(_dtw(v[r.id_a], v[r.id_b]))


def test_scaling_recovers_a_line_and_geodesics_follow_the_graph(spark, tmp_path):
    pts = np.array([0.0, 1.0, 3.0, 4.0, 7.0])
    i, j = np.triu_indices(5, 1)
    d = spark.createDataFrame(pd.DataFrame({"id_a": i, "id_b": j, "distance": np.abs(pts[i] - pts[j])}))
    ids = spark.range(5)
    out = ko.classical_mds(d, ids, 1).toPandas().sort_values("id").value.to_numpy()
    want = (pts - pts.mean()) / pts.std()
    assert min(np.abs(out - want).max(), np.abs(out + want).max()) < 1e-6
    geo = ko.geodesic_distances(d, ids, 1).toPandas()
    assert geo[(geo.id_a == 0) & (geo.id_b == 1)].distance.iloc[0] == pytest.approx(1.0)


def test_warps_stay_in_range(data):
    df, pdf = data
    w = ko.time_warp(df, ["x"], keys=KEYS).toPandas()
    assert w.groupby("subject_id").frame_idx.count().to_dict() == {"a": 150, "b": 61}
    a = w[w.subject_id == "a"].x
    assert a.min() >= values(pdf, "a").min() - 1e-9 and a.max() <= values(pdf, "a").max() + 1e-9
    flat = ko.magnitude_warp(df.withColumn("x", F.lit(1.0)), ["x"], 0.0, keys=KEYS).select("x").toPandas().x
    np.testing.assert_allclose(flat, 1.0)


def test_recordings_of_one_frame_stay(make_series):
    from kinelake.operators import kernel_ops, spectral

    df, pdf = make_series({("a", 1): 1, ("b", 1): 60})
    keys = ["subject_id", "task"]
    one = pdf[pdf.subject_id == "a"].iloc[0]
    got = kernel_ops.butterworth_filter(df, ["x"], "low", 5.0, keys=keys).toPandas()
    assert len(got) == 61 and got[got.subject_id == "a"].x.iloc[0] == one.x
    got = kernel_ops.interpolate_spline(df, ["x", "y"], 5, keys=keys).toPandas()
    assert len(got) == 10 and (got[got.subject_id == "a"].y == one.y).all()
    series = df.selectExpr("subject_id", "task", "'x' AS channel", "frame_idx AS idx", "x AS value")
    got = spectral.fft_magnitude(series, keys).toPandas().set_index("subject_id")
    assert len(got) == 2 and np.isnan(got.loc["a", "fft_max_magnitude"]) and got.loc["b", "fft_max_magnitude"] > 0


def test_many_blocks_are_filtered_side_by_side(monkeypatch):
    draw = np.random.default_rng(4)
    b, a = kernels.butterworth(4, [1.0, 6.0], 50.0, "band")
    sizes = np.array([2, 3, 40, 400, 41, 7] * 20)
    ends = np.cumsum(sizes)
    starts, x = ends - sizes, draw.normal(size=(ends[-1] + 1, 2))
    begins, stops = draw.random(len(sizes)) < 0.5, draw.random(len(sizes)) < 0.5
    alone = [kernels.zero_phase(b, a, x[s:e], p, q) for s, e, p, q in zip(starts, ends, begins, stops)]
    steps, plain = [], kernels._recursive
    monkeypatch.setattr(kernels, "_recursive", lambda b, a, x, start: steps.append(len(x)) or plain(b, a, x, start))
    monkeypatch.setattr(kernels, "FILTER_CELLS", 60_000)  # several tables
    found = kernels.zero_phase_many(b, a, x, starts, ends, begins, stops)
    assert np.array_equal(found, np.concatenate([*alone, x[-1:]]))
    assert sum(steps) < sum(sizes) / 2


def test_a_series_of_known_length_costs_no_new_basis(monkeypatch):
    kernels._SPLINES.clear()
    calls, plain = [], kernels.bspline_basis
    monkeypatch.setattr(kernels, "bspline_basis", lambda *args: calls.append(1) or plain(*args))
    draw, at = np.random.default_rng(5), np.linspace(0, 29, 64)
    for degree in (2, 3):
        for _ in range(10):
            y = draw.normal(size=(30, 2))
            own, there = kernels._spline_parts(30, at, degree)
            assert np.allclose(kernels.spline_at(y, at, degree), there @ np.linalg.solve(own, y), rtol=0, atol=1e-12)
    assert len(calls) == 2 * 2 * 11  # ten of each from the check itself
    cubic = lambda t: 2 * t**3 - t + 1
    assert np.allclose(kernels.spline_at(cubic(np.arange(8.0) / 8)[:, None], np.array([0.25, 6.5]), 3)[:, 0], cubic(np.array([0.25, 6.5]) / 8))


def test_template_counts_equal_pairs_of_rows():
    draw = np.random.default_rng(6)
    a, b = (np.round(draw.normal(size=(n, 3)), 1) for n in (700, 9))
    a[-1, 2] = b[-1, 2] = np.inf
    full_a, full_b = np.isfinite(a[:, 2]), np.isfinite(b[:, 2])
    near = np.abs(a[:, None, :2] - b[None, :, :2]).max(axis=2) <= 0.4
    three = near[:-1, :-1] & (np.abs(a[:-1, None, 2] - b[None, :-1, 2]) <= 0.4)
    n2, s2, n3 = kernels.template_counts(a, b, full_a, full_b, 0.4)
    assert (n2 == near.sum(axis=1)).all() and n2.any()
    assert (s2 == np.append(near[:-1, :-1].sum(axis=1), 0)).all() and (n3 == np.append(three.sum(axis=1), 0)).all()
    apart = lambda x, y: np.exp(-np.abs((x - x.mean()) - (y - y.mean())).max() / 0.3)
    want = [sum(apart(x[:m], y[:m]) for x in a[:-1] for y in b[:-1]) for m in (2, 3)]
    assert np.allclose(kernels.fuzzy_sums(a[:-1], b[:-1], 0.3), want)


def test_lempel_ziv_of_values_and_of_symbols(data):
    series = spectral.finite_series(data[0], ["x", "y"])
    unnamed = series.filter("task = 1 AND channel = 'x'").withColumn("task", F.lit(None).cast(series.schema["task"].dataType))
    series = series.unionByName(unnamed.select(series.columns))
    rows = [sorted(map(tuple, ko.lempel_ziv(series, limit=n).collect())) for n in (500, 10)]
    assert len(rows[0]) == 4 and rows[0] == rows[1]
