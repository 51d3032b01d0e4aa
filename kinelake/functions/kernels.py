"""Numpy helpers that run inside tasks on one bounded block of a series."""

from __future__ import annotations

import numpy as np

# Daubechies-4 decomposition low-pass taps (8 coefficients).
DB4_LOW = np.array(
    [
        -0.010597401784997278, 0.032883011666982945, 0.030841381835986965, -0.18703481171888114,
        -0.02798376941698385, 0.6308807679295904, 0.7148465705525415, 0.23037781330885523,
    ]
)
# Quadrature mirror of the low-pass taps.
DB4_HIGH = DB4_LOW[::-1] * np.where(np.arange(8) % 2 == 0, -1.0, 1.0)


def segment_power(x: np.ndarray, rate: float) -> np.ndarray:
    """One-sided density of one mean-removed Hann segment (columns are signals)."""
    n = len(x)
    w = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(n) / n)
    spec = np.fft.rfft((x - x.mean(axis=0)) * w.reshape((-1,) + (1,) * (x.ndim - 1)), axis=0)
    p = (spec.real**2 + spec.imag**2) / (rate * (w**2).sum())
    p[1 : (n + 1) // 2] *= 2.0
    return p


def fourier_resample(x: np.ndarray, num: int) -> np.ndarray:
    """Resample columns to ``num`` points by truncating or padding the spectrum."""
    n = len(x)
    spec = np.fft.rfft(x, axis=0)
    keep = min(n, num)
    out = np.zeros((num // 2 + 1,) + x.shape[1:], dtype=complex)
    out[: keep // 2 + 1] = spec[: keep // 2 + 1]
    if keep % 2 == 0 and n != num:
        out[keep // 2] *= 2.0 if num < n else 0.5
    return np.fft.irfft(out, num, axis=0) * (num / n)


def bspline_basis(knots: np.ndarray, degree: int, at: np.ndarray) -> np.ndarray:
    """Basis matrix (points x functions) by the Cox-de Boor recursion."""
    last = np.searchsorted(knots, knots[-1], side="left") - 1
    span = np.clip(np.searchsorted(knots, at, side="right") - 1, degree, last)
    b = np.ones((len(at), 1))
    # At a point only the functions span - d .. span of degree d are not zero.
    for d in range(1, degree + 1):
        i = span[:, None] + np.arange(-d, 1)
        lower = np.pad(b, ((0, 0), (1, 1)))
        left, right = knots[i + d] - knots[i], knots[i + d + 1] - knots[i + 1]
        up = (at[:, None] - knots[i]) / np.where(left > 0, left, 1.0) * lower[:, :-1]
        down = (knots[i + d + 1] - at[:, None]) / np.where(right > 0, right, 1.0) * lower[:, 1:]
        b = np.where(left > 0, up, 0.0) + np.where(right > 0, down, 0.0)
    out = np.zeros((len(at), len(knots) - 1 - degree))
    out[np.arange(len(at))[:, None], span[:, None] + np.arange(-degree, 1)] = b
    return out


def _spline_parts(n: int, at: np.ndarray, degree: int) -> tuple[np.ndarray, np.ndarray]:
    """Basis of the interpolating spline through n unit-spaced points: at these points, and at ``at``."""
    degree = min(degree, n - 1)
    x = np.arange(n, dtype=float)
    if degree == 2:
        inner = (x[1:] + x[:-1])[1:-1] / 2.0
    else:
        inner = x[(degree + 1) // 2 : n - (degree + 1) // 2]
    knots = np.r_[[x[0]] * (degree + 1), inner, [x[-1]] * (degree + 1)]
    return bspline_basis(knots, degree, x), bspline_basis(knots, degree, at)


_SPLINES: dict[tuple[int, int, bytes], np.ndarray] = {}
#: Cells of a matrix that is kept for series of the same length, and of all that are kept.
SPLINE_CELLS, SPLINES_CELLS = 1 << 17, 1 << 22


def spline_at(y: np.ndarray, at: np.ndarray, degree: int) -> np.ndarray:
    """Interpolating spline through unit-spaced rows of ``y``, evaluated at ``at`` (not-a-knot ends).

    The values are a fixed matrix times ``y``; matrices of moderate size are kept per process for the next series like it.
    """
    n = len(y)
    if n * len(at) > SPLINE_CELLS:
        own, there = _spline_parts(n, at, degree)
        return there @ np.linalg.solve(own, y)
    kind = (n, degree, at.tobytes())
    if kind not in _SPLINES:
        own, there = _spline_parts(n, at, degree)
        if sum(m.size for m in _SPLINES.values()) + n * len(at) > SPLINES_CELLS:
            _SPLINES.clear()
        _SPLINES[kind] = np.linalg.solve(own.T, there.T).T
    return _SPLINES[kind] @ y


def butterworth(order: int, cutoff, rate: float, kind: str) -> tuple[np.ndarray, np.ndarray]:
    """Digital Butterworth (b, a) for 'low', 'high' or 'band' through the bilinear transform."""
    warp = 4.0 * np.tan(np.pi * np.atleast_1d(np.asarray(cutoff, dtype=float)) / rate)
    m = np.arange(-order + 1, order, 2)
    proto = -np.exp(1j * np.pi * m / (2 * order))
    if kind == "low":
        poles, zeros, gain = proto * warp[0], np.array([]), warp[0] ** order
    elif kind == "high":
        poles, zeros, gain = warp[0] / proto, np.zeros(order), np.real(1.0 / np.prod(-proto))
    else:
        width, centre = warp[1] - warp[0], np.sqrt(warp[0] * warp[1])
        half = proto * width / 2.0
        root = np.sqrt(half**2 - centre**2 + 0j)
        poles, zeros, gain = np.concatenate([half + root, half - root]), np.zeros(order), width**order
    lead = len(poles) - len(zeros)
    gain = gain * np.real(np.prod(4.0 - zeros) / np.prod(4.0 - poles))
    dz = np.concatenate([(4.0 + zeros) / (4.0 - zeros), -np.ones(lead)])
    dp = (4.0 + poles) / (4.0 - poles)
    return gain * np.real(np.poly(dz)), np.real(np.poly(dp))


def settle_length(a: np.ndarray, tol: float = 1e-13) -> int:
    """Samples after which the filter has forgotten its start (slowest pole below ``tol``)."""
    radius = float(np.max(np.abs(np.roots(a))))
    return int(np.ceil(np.log(tol) / np.log(radius))) + 8 * len(a)


def _recursive(b, a, x, start):
    """Direct form II transposed filter over rows; columns are independent signals."""
    state = start.copy()
    out = np.empty_like(x)
    bs, as_ = b[1:-1, None], a[1:-1, None]
    for t in range(len(x)):
        out[t] = b[0] * x[t] + state[0]
        state[:-1] = state[1:] + bs * x[t] - as_ * out[t]
        state[-1] = b[-1] * x[t] - a[-1] * out[t]
    return out


def zero_phase(b, a, x: np.ndarray, at_start: bool, at_end: bool) -> np.ndarray:
    """Forward-backward filter of one block; true ends get the odd extension of 3 * ntaps."""
    return zero_phase_many(b, a, x, np.array([0]), np.array([len(x)]), np.array([at_start]), np.array([at_end]))


#: Cells of the padded table of blocks that are filtered side by side.
FILTER_CELLS = 1 << 20


def zero_phase_many(b, a, x: np.ndarray, starts, ends, at_start, at_end) -> np.ndarray:
    """``zero_phase`` of many blocks, rows starts[i] to ends[i] of ``x``, at least two rows each; other rows stay.

    Blocks of like length are filtered side by side, so a time step costs a few array operations for all of them. Each
    column sees the operations of its own block alone.
    """
    n = len(a)
    comp = np.zeros((n - 1, n - 1))
    comp[:, 0] = -a[1:]
    comp[:-1, 1:] += np.eye(n - 2)
    zi = np.linalg.solve(np.eye(n - 1) - comp, b[1:] - a[1:] * b[0])
    pads = np.minimum(3 * n, ends - starts - 1)
    heads, tails = np.where(at_start, pads, 0), np.where(at_end, pads, 0)
    sizes = ends - starts + heads + tails
    out, width = x.copy(), x.shape[1]
    order, at = np.argsort(sizes, kind="stable")[::-1], 0
    while at < len(order):
        most = sizes[order[at]]
        few = order[at : at + max(1, FILTER_CELLS // (most * width))]
        at += len(few)
        ext = np.zeros((most, len(few), width))
        for k, i in enumerate(few):
            v, head = x[starts[i] : ends[i]], heads[i]
            ext[head : head + len(v), k] = v
            if head:
                ext[:head, k] = 2 * v[0] - v[head:0:-1]
            if tails[i]:
                ext[head + len(v) : sizes[i], k] = 2 * v[-1] - v[-2 : -tails[i] - 2 : -1]
        # Each block is turned around at its own end; what lies behind the end is never read.
        turned = np.maximum(sizes[few] - 1 - np.arange(most)[:, None], 0)[:, :, None]
        y = ext.reshape(most, -1)
        for _ in range(2):
            y = _recursive(b, a, y, np.outer(zi, y[0]))
            y = np.take_along_axis(y.reshape(ext.shape), turned, axis=0).reshape(most, -1)
        y = y.reshape(ext.shape)
        for k, i in enumerate(few):
            out[starts[i] : ends[i]] = y[heads[i] : heads[i] + ends[i] - starts[i], k]
    return out


def greedy_peaks(idx: np.ndarray, height: np.ndarray, distance: int) -> np.ndarray:
    """Keep mask: highest first (later index wins ties), dropping neighbours closer than ``distance``."""
    keep = np.ones(len(idx), dtype=bool)
    for i in np.lexsort((idx, height))[::-1]:
        if keep[i]:
            lo, hi = np.searchsorted(idx, idx[i] - distance + 1), np.searchsorted(idx, idx[i] + distance)
            keep[lo:i] = False
            keep[i + 1 : hi] = False
    return keep


def dwt_step(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """One db4 level with half-sample symmetric edges: (approximation, detail)."""
    n = len(x)
    reach = np.arange(-7, n + 7)
    folded = np.mod(reach, 2 * n)
    ext = x[np.where(folded < n, folded, 2 * n - 1 - folded)]
    size = (n + 7) // 2
    # Tap j of output k meets x[2k + 1 - j]; position p sits at ext[p + 7].
    at = 2 * np.arange(size)[:, None] + 1 - np.arange(8)[None, :] + 7
    return ext[at] @ DB4_LOW, ext[at] @ DB4_HIGH


_MORLETS: dict[tuple[int, int], tuple[int, np.ndarray]] = {}


def _morlet_spectra(n: int, max_scale: int) -> tuple[int, np.ndarray]:
    """(FFT size, conjugate-free spectra of the scaled wavelets) for series of n samples, cached per process."""
    if (n, max_scale) not in _MORLETS:
        size = 1 << int(np.ceil(np.log2(n + min(8 * max_scale, n))))
        bank = np.zeros((max_scale, size))
        for i in range(max_scale):
            half = min(8 * (i + 1), n - 1)  # lags past the series length meet no sample
            lag = np.arange(-half, half + 1)
            t = lag / (i + 1.0)
            bank[i, lag % size] = np.exp(-t * t / 2.0) * np.cos(5.0 * t) / np.sqrt(i + 1.0)
        if len(_MORLETS) > 64:
            _MORLETS.clear()
        _MORLETS[(n, max_scale)] = (size, np.fft.rfft(bank, axis=1))
    return _MORLETS[(n, max_scale)]


def morlet_energy(x: np.ndarray, max_scale: int, core: slice) -> tuple[float, float]:
    """(sum, max) of squared real-Morlet coefficients over the core rows and scales 1..max_scale."""
    size, bank = _morlet_spectra(len(x), max_scale)
    spec = np.fft.rfft(x, size)
    total, top = 0.0, 0.0
    for i in range(0, max_scale, 16):
        c = np.fft.irfft(bank[i : i + 16] * spec, size, axis=1)[:, : len(x)][:, core]
        total += float((c * c).sum())
        top = max(top, float((c * c).max()))
    return total, top


def template_counts(a: np.ndarray, b: np.ndarray, full_a: np.ndarray, full_b: np.ndarray, r: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each row of ``a`` the rows of ``b`` within r (Chebyshev) on the first two columns, those of them that are full,
    and the full ones within r on all three. The last two are zero for rows of ``a`` that are not full."""
    n2, s2, n3 = np.zeros(len(a)), np.zeros(len(a)), np.zeros(len(a))
    b0, b1, b2 = (np.ascontiguousarray(b[:, i]) for i in range(3))
    for s in range(0, len(a), 512):
        p = a[s : s + 512]
        near = np.abs(p[:, 0, None] - b0) <= r
        near &= np.abs(p[:, 1, None] - b1) <= r
        n2[s : s + 512] = np.count_nonzero(near, axis=1)
        near &= full_b
        s2[s : s + 512] = np.count_nonzero(near, axis=1)
        third = np.where(full_a[s : s + 512], p[:, 2], 0.0)
        near &= np.abs(third[:, None] - np.where(full_b, b2, 0.0)) <= r
        n3[s : s + 512] = np.count_nonzero(near, axis=1)
    return n2, np.where(full_a, s2, 0.0), np.where(full_a, n3, 0.0)


def fuzzy_sums(a: np.ndarray, b: np.ndarray, r: float) -> tuple[float, float]:
    """Sums of exp(-distance / r) between mean-removed templates of length 2 and 3."""
    out = []
    for m in (2, 3):
        p = a[:, :m] - a[:, :m].mean(axis=1, keepdims=True)
        q = np.ascontiguousarray((b[:, :m] - b[:, :m].mean(axis=1, keepdims=True)).T)
        total = 0.0
        for s in range(0, len(p), 512):
            d = np.abs(p[s : s + 512, 0, None] - q[0])
            for i in range(1, m):
                np.maximum(d, np.abs(p[s : s + 512, i, None] - q[i]), out=d)
            total += float(np.exp(-d / r).sum())
        out.append(total)
    return out[0], out[1]


def lempel_ziv(bits: bytes) -> int:
    """Number of phrases of the 1976 parsing: each phrase is the shortest one not seen before."""
    n, start, phrases = len(bits), 0, 0
    while start < n:
        size = 1
        while start + size <= n and bits.find(bits[start : start + size], 0, start + size - 1) != -1:
            size += 1
        phrases += 1
        start += size
    return phrases


def dtw_distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """DTW of many pairs at once: a is (P, T1, C), b is (P, T2, C); anti-diagonals are vectorised."""
    pairs, n, m = a.shape[0], a.shape[1], b.shape[1]
    cost = np.full((pairs, n + 1), np.inf)  # diagonal d: cell (i, d - i) stored at i
    prev = np.full((pairs, n + 1), np.inf)
    prev[:, 0] = 0.0  # diagonal 0 holds only the origin
    older = np.full((pairs, n + 1), np.inf)
    for d in range(1, n + m + 1):
        lo, hi = max(1, d - m), min(n, d - 1)
        cost[:] = np.inf
        if lo <= hi:
            i = np.arange(lo, hi + 1)
            step = a[:, i - 1] - b[:, d - i - 1]
            local = np.sqrt((step * step).sum(axis=2))
            cost[:, i] = local + np.minimum(np.minimum(prev[:, i - 1], prev[:, i]), older[:, i - 1])
        older, prev, cost = prev, cost, older
    return prev[:, n]
