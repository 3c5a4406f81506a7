"""Numpy kernels over batches of equally long waveforms (rows of a matrix)."""

from __future__ import annotations

import numpy as np

#: Constants of the converter: 12 bits over 4 volts.
ADC_STEP = 4.0 / 4096


def daubechies(order: int) -> np.ndarray:
    """The 2*order scaling coefficients of the Daubechies wavelet, by factorising its
    half-band polynomial and keeping the roots inside the unit circle."""
    if order == 1:
        return np.array([1.0, 1.0]) / np.sqrt(2)
    binomials = [1.0]
    for k in range(1, order):
        binomials.append(binomials[-1] * (order - 1 + k) / k)
    roots = []
    for y in np.roots(binomials[::-1]):
        z = np.roots([1.0, 4 * y - 2, 1.0])
        roots.append(z[np.argmin(np.abs(z))])
    poly = np.poly(np.concatenate([-np.ones(order), np.array(roots)])).real
    return poly * np.sqrt(2) / poly.sum()


def _filters(order: int) -> tuple[np.ndarray, np.ndarray]:
    low = daubechies(order)
    return low, low[::-1] * (-1.0) ** np.arange(len(low))


def dwt_step(x: np.ndarray, order: int = 4) -> tuple[np.ndarray, np.ndarray]:
    """One level of the transform of each row (mirrored at the ends): (approximation, detail)."""
    low, high = _filters(order)
    taps = len(low)
    n = x.shape[1]
    mirror = np.pad(x, ((0, 0), (taps - 1, taps - 1)), mode="symmetric") if n >= taps - 1 else _mirror(x, taps - 1)
    windows = np.lib.stride_tricks.sliding_window_view(mirror, taps, axis=1)[:, 1::2]
    return windows @ low, windows @ high


def _mirror(x: np.ndarray, width: int) -> np.ndarray:
    n = x.shape[1]
    at = np.arange(-width, n + width)
    at = np.mod(at, 2 * n)
    return x[:, np.where(at < n, at, 2 * n - 1 - at)]


def wavedec(x: np.ndarray, levels: int, order: int = 4) -> tuple[np.ndarray, list[np.ndarray]]:
    """(approximation, [D1, D2, ...]) of each row."""
    details = []
    for _ in range(levels):
        x, d = dwt_step(x, order)
        details.append(d)
    return x, details


def max_level(n: int, taps: int = 8) -> int:
    return int(np.floor(np.log2(n / (taps - 1)))) if n >= taps - 1 else 0


def envelope(x: np.ndarray) -> np.ndarray:
    """Magnitude of the analytic signal of each row."""
    n = x.shape[1]
    weight = np.zeros(n)
    weight[0] = 1
    weight[1 : (n + 1) // 2] = 2
    if n % 2 == 0:
        weight[n // 2] = 1
    return np.abs(np.fft.ifft(np.fft.fft(x, axis=1) * weight, axis=1))


def gaussian(x: np.ndarray, sigma: float) -> np.ndarray:
    """Each row smoothed by a Gaussian cut at four sigma, mirrored at the ends."""
    radius = int(4 * sigma + 0.5)
    k = np.exp(-0.5 * (np.arange(-radius, radius + 1) / sigma) ** 2)
    windows = np.lib.stride_tricks.sliding_window_view(_mirror(x, radius), 2 * radius + 1, axis=1)
    return windows @ (k / k.sum())


def peaks(x: np.ndarray, height: float = -np.inf, distance: int = 1, prominence: float = 0.0) -> np.ndarray:
    """Indexes of the inner peaks of one row: middle of a plateau, at least ``height``
    high, the highest first where two lie closer than ``distance``, then by prominence."""
    n = len(x)
    if n < 3:
        return np.zeros(0, dtype=int)
    starts = np.flatnonzero(np.concatenate([[True], x[1:] != x[:-1]]))
    ends = np.concatenate([starts[1:] - 1, [n - 1]])
    v = x[starts]
    inner = np.flatnonzero((v[1:-1] > v[:-2]) & (v[1:-1] > v[2:])) + 1
    at = (starts[inner] + ends[inner]) // 2
    at = at[x[at] >= height]
    if distance > 1 and len(at) > 1:
        keep = np.ones(len(at), dtype=bool)
        for i in np.argsort(x[at], kind="stable")[::-1]:
            if keep[i]:
                close = np.abs(at - at[i]) < distance
                close[i] = False
                keep &= ~close
        at = at[keep]
    if prominence > 0:
        kept = []
        for p in at:
            higher = np.flatnonzero(x > x[p])
            left, right = higher[higher < p], higher[higher > p]
            low_l = x[(left[-1] + 1 if len(left) else 0) : p + 1].min()
            low_r = x[p : (right[0] if len(right) else n)].min()
            if x[p] - max(low_l, low_r) >= prominence:
                kept.append(p)
        at = np.array(kept, dtype=int)
    return at


def pulse_peaks(w: np.ndarray, dt: float, ratio: float = 0.3, separation_us: float = 0.5) -> np.ndarray:
    """Peaks of |w| that count as pulses."""
    a = np.abs(w)
    top = a.max(initial=0.0)
    if top == 0:
        return np.zeros(0, dtype=int)
    return peaks(a, ratio * top, max(1, int(separation_us * 1e-6 / dt)), ratio * top * 0.5)


def baselined(raw: np.ndarray, head: int = 50) -> np.ndarray:
    part = raw[:, :head] if raw.shape[1] > head else raw
    return raw - part.mean(axis=1, keepdims=True)


def _ratio(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.divide(a, b, out=np.zeros_like(a, dtype=float), where=b != 0)


def polarities(raw: np.ndarray) -> dict[str, np.ndarray]:
    """Sign of each row by six methods; ties and silent rows are positive."""
    w = baselined(raw)
    a = np.abs(w)
    m, n = w.shape
    top = a.max(axis=1)
    sign = lambda up: np.where(up, 1.0, -1.0)
    peak = sign(np.abs(w.max(axis=1)) >= np.abs(w.min(axis=1)))
    first = np.ones(m)
    for i in range(m):
        if top[i] > 0:
            up, down = peaks(w[i], 0.2 * top[i]), peaks(-w[i], 0.2 * top[i])
            first[i] = 1.0 if (up[0] if len(up) else np.inf) <= (down[0] if len(down) else np.inf) else -1.0
    charge = sign(w.sum(axis=1) >= 0)
    e = w * w
    energy = sign(np.where(w > 0, e, 0).sum(axis=1) >= np.where(w < 0, e, 0).sum(axis=1))
    change = np.diff(np.signbit(w), axis=1)
    part = np.concatenate([np.zeros((m, 1), dtype=int), np.cumsum(change, axis=1)], axis=1)
    half = peak.copy()
    for i in np.flatnonzero(change.any(axis=1)):
        total, square = np.bincount(part[i], w[i]), np.bincount(part[i], e[i])
        half[i] = 1.0 if square[total > 0].sum() >= square[total <= 0].sum() else -1.0
    floor = w[:, : 50 if n > 50 else 10].std(axis=1)
    limit = np.maximum(3 * floor, 0.05 * top)
    over = a > limit[:, None]
    start = over.argmax(axis=1)
    slope = np.where(over.any(axis=1) & (n - start >= 3), sign(w[np.arange(m), start] > 0), peak)
    return {
        "peak": peak, "first_peak": first, "integrated_charge": charge, "energy_weighted": energy, "dominant_half_cycle": half,
        "initial_slope": np.where(top == 0, 1.0, slope),
    }


def pulse_features(raw: np.ndarray, dt: float) -> dict[str, np.ndarray]:
    """The features of each row that need no other row."""
    w = baselined(np.asarray(raw, dtype=float))
    m, n = w.shape
    a, at = np.abs(w), np.arange(n)
    top_p, top_n = w.max(axis=1), w.min(axis=1)
    top = np.maximum(np.abs(top_p), np.abs(top_n))
    rms = np.sqrt((w * w).mean(axis=1))
    p = a.argmax(axis=1)
    low, high = 0.1 * top[:, None], 0.9 * top[:, None]
    back, ahead = at <= p[:, None], at >= p[:, None]
    s = np.where((a <= low) & back, at, -1).max(axis=1)
    e = np.where((a <= high) & back & (at > s[:, None]), at, -1).max(axis=1)
    rise = np.where((s >= 0) & (e > s), (e - s) * dt, 0.0)
    f0 = np.where((a <= high) & ahead, at, n).min(axis=1)
    f1 = np.where((a <= low) & ahead, at, n).min(axis=1)
    fall = np.where((f1 < n) & (f1 > f0), (f1 - f0) * dt, 0.0)
    wide = a >= 0.5 * top[:, None]
    width = (n - 1 - wide[:, ::-1].argmax(axis=1) - wide.argmax(axis=1)) * dt
    slew = np.abs(np.diff(w, axis=1)).max(axis=1) / dt if n > 1 else np.zeros(m)
    crossings = np.diff(np.signbit(w), axis=1).sum(axis=1).astype(float)
    edge = np.pad(w, ((0, 0), (3, 3)), mode="edge")
    around = [edge[:, 3 + d : 3 + d + n] for d in (-3, -2, -1, 1, 2, 3)]
    swings = np.logical_and.reduce([w > x for x in around]) | np.logical_and.reduce([w < x for x in around])
    square = w * w
    total = square.sum(axis=1)
    charge = a.sum(axis=1) * dt
    time = at * dt
    mid = _ratio(square @ time, total)
    spread = np.sqrt(np.maximum(_ratio((square * (time - mid[:, None]) ** 2).sum(axis=1), total), 0.0))
    cum = np.cumsum(square, axis=1)
    share = np.divide(cum, total[:, None], out=np.zeros_like(cum), where=total[:, None] != 0)
    reach = [(share < q).sum(axis=1) for q in (0.1, 0.9)]
    half = cum[:, n // 2 if n > 1 else 0]
    up, down = np.where(w > 0, square, 0).sum(axis=1), np.where(w < 0, square, 0).sum(axis=1)
    area = np.where(down > 0, np.divide(up, down, out=np.ones(m), where=down > 0), np.where(up > 0, np.inf, 1.0))
    out = {
        "peak_amplitude_positive": top_p, "peak_amplitude_negative": top_n, "absolute_amplitude": top, "polarity": polarities(raw)["first_peak"],
        "rise_time": rise, "fall_time": fall, "pulse_width": np.where(top > 0, width, (n - 1) * dt), "slew_rate": slew, "energy": total * dt, "charge": charge,
        "equivalent_time": mid, "equivalent_bandwidth": spread, "cumulative_energy_peak": share[np.arange(m), p],
        "cumulative_energy_rise_time": np.where(total > 0, (reach[1] - reach[0]) * dt, 0.0), "cumulative_energy_shape_factor": _ratio(half, total - half),
        "cumulative_energy_area_ratio": area, "peak_to_peak_amplitude": top_p - top_n, "rms_amplitude": rms, "crest_factor": _ratio(top, rms),
        "rise_fall_ratio": _ratio(rise, fall), "zero_crossing_count": crossings, "oscillation_count": swings.sum(axis=1).astype(float),
        "energy_charge_ratio": _ratio(total * dt, charge),
    }
    out |= _spectrum(w, dt) | _wavelets(w)
    count = np.array([len(pulse_peaks(row, dt)) for row in w], dtype=float)
    return out | {"pulse_count": count, "is_multi_pulse": (count > 1).astype(float)}


def _spectrum(w: np.ndarray, dt: float) -> dict[str, np.ndarray]:
    m, n = w.shape
    names = ("dominant_frequency", "center_frequency", "bandwidth_3db", "spectral_power_low", "spectral_power_high", "spectral_flatness", "spectral_entropy")
    f = np.fft.fftfreq(n, dt)
    f = f[f > 0]
    if not len(f):
        return dict.fromkeys(names, np.zeros(m))
    power = np.abs(np.fft.fft(w * np.hanning(n), axis=1)[:, 1 : len(f) + 1]) ** 2
    total = power.sum(axis=1)
    best = power.max(axis=1)
    strong = power >= best[:, None] / 2
    width = f[len(f) - 1 - strong[:, ::-1].argmax(axis=1)] - f[strong.argmax(axis=1)]
    nyquist = 0.5 / dt
    q = np.divide(power, total[:, None], out=np.zeros_like(power), where=total[:, None] != 0)
    flat = _ratio(np.exp(np.log(power + 1e-12).mean(axis=1)), power.mean(axis=1))
    entropy = -(q * np.log2(np.where(q > 0, q, 1.0))).sum(axis=1)
    values = (f[power.argmax(axis=1)], q @ f, width, q[:, f < 0.25 * nyquist].sum(axis=1), q[:, f > 0.75 * nyquist].sum(axis=1), flat, entropy)
    return dict(zip(names, values, strict=True))


def _wavelets(w: np.ndarray, deepest: int = 5) -> dict[str, np.ndarray]:
    m, n = w.shape
    zero = np.zeros(m)
    levels = min(deepest, max_level(n))
    out = {f"wavelet_{k}": zero for k in (
        *(f"{e}_{b}" for e in ("energy", "rel_energy") for b in ("approx", *(f"d{i}" for i in range(1, deepest + 1)))),
        "detail_approx_ratio", "dominant_level", "entropy", *(f"{b}_{s}" for b in ("approx", "d1") for s in ("mean", "std", "max")),
    )}
    if levels < 1:
        return out
    approx, details = wavedec(w, levels)
    bands = np.stack([(approx**2).sum(axis=1), *((d**2).sum(axis=1) for d in details)], axis=1)
    share = np.divide(bands, bands.sum(axis=1, keepdims=True), out=np.zeros_like(bands), where=bands.sum(axis=1, keepdims=True) != 0)
    for i, b in enumerate(("approx", *(f"d{k}" for k in range(1, levels + 1)))):
        out[f"wavelet_energy_{b}"], out[f"wavelet_rel_energy_{b}"] = bands[:, i], share[:, i]
    out["wavelet_detail_approx_ratio"] = _ratio(bands[:, 1:].sum(axis=1), bands[:, 0])
    out["wavelet_dominant_level"] = (levels - bands[:, :0:-1].argmax(axis=1)).astype(float)  # the deepest of equals
    out["wavelet_entropy"] = -(share * np.log2(np.where(share > 0, share, 1.0))).sum(axis=1)
    out["wavelet_approx_mean"], out["wavelet_approx_std"], out["wavelet_approx_max"] = approx.mean(axis=1), approx.std(axis=1), np.abs(approx).max(axis=1)
    d1 = details[0]
    out["wavelet_d1_mean"], out["wavelet_d1_std"], out["wavelet_d1_max"] = np.abs(d1).mean(axis=1), d1.std(axis=1), np.abs(d1).max(axis=1)
    return out


#: Window methods: name -> (kind, its parameter, least window in microseconds).
WINDOW_METHODS = {
    "original": ("whole", 0.0, 0.0), "rise_fall": ("rise_fall", 0.0, 0.0), "energy90": ("energy", 0.90, 0.0), "energy95": ("energy", 0.95, 0.0),
    "peak0.5us": ("peak", 0.5, 0.0), "peak1.0us": ("peak", 1.0, 0.0), "peak2.0us": ("peak", 2.0, 0.0), "adaptive_shrink": ("shrink", 0.5, 0.0), "derivative": ("derivative", 2.0, 0.0),
    "smart3x": ("smart", 3.0, 0.0), "smart5x": ("smart", 5.0, 0.0), "smart2x": ("smart", 2.0, 0.0), "padded0.5us": ("padded", 3.0, 0.5), "padded1.0us": ("padded", 3.0, 1.0),
    "isolated2x1.0us": ("isolated", 2.0, 1.0), "isolated2x0.5us": ("isolated", 2.0, 0.5), "isolated3x1.0us": ("isolated", 3.0, 1.0),
}


def window_bounds(w: np.ndarray, dt: float, method: str) -> tuple[int, int]:
    """(start, end) of the part of one baselined waveform that a method keeps."""
    kind, value, least_us = WINDOW_METHODS[method]
    n = len(w)
    a = np.abs(w)
    if kind == "whole" or n == 0:
        return 0, n
    if kind == "peak":
        half = int(value * 1e-6 / dt) // 2
        return _around(int(a.argmax()), half, n)
    if kind == "energy":
        cum = np.cumsum(w * w)
        if cum[-1] == 0:
            return 0, n
        margin = (1 - value) / 2
        lo, hi = (int(x) for x in np.searchsorted(cum / cum[-1], [margin, 1 - margin]))
        extra = max(10, (hi - lo) // 10)
        return max(0, lo - extra), min(n, hi + extra)
    if kind == "derivative":
        slope = np.abs(np.diff(gaussian(a[None, :], value)[0]))
        steep = np.flatnonzero(slope > 0.05 * slope.max()) if n > 1 else []
        return (max(0, int(steep[0]) - 20), min(n, int(steep[-1]) + 20)) if len(steep) else (0, n)
    if kind == "shrink":
        found = pulse_peaks(w, dt, separation_us=value)
        if len(found) > 1:
            main = int(found[a[found].argmax()])
            return _around(main, max(50, int(np.abs(found[found != main] - main).min()) // 2), n)
    if kind in ("rise_fall", "shrink"):
        over = np.flatnonzero(a > 0.1 * a.max())
        if not len(over):
            return 0, n
        extra = int((over[-1] - over[0]) * 0.25)
        return max(0, int(over[0]) - extra), min(n, int(over[-1]) + extra)
    lo, hi = smart_bounds(w, dt, value, least_us if kind == "isolated" else None)
    if kind == "padded" and hi - lo < int(least_us * 1e-6 / dt):
        return _around(lo + int(a[lo:hi].argmax()), int(least_us * 1e-6 / dt) // 2, n)
    return lo, hi


def _around(at: int, half: int, n: int) -> tuple[int, int]:
    return max(0, at - half), min(n, at + half)


def smart_bounds(w: np.ndarray, dt: float, snr: float = 2.0, least_us: float | None = 1.0, edge: int = 50, separation_us: float = 0.5) -> tuple[int, int]:
    """The part of one waveform around its main pulse where the smoothed envelope exceeds
    ``snr`` times the quieter edge's RMS (a silent edge counts as 1 % of the top).

    With ``least_us`` the window has that width at least and never crosses ten samples
    before another pulse; without it the window may. Waveforms of fewer than two edges
    are kept whole; where nothing exceeds the limit, a small window at the top is kept.
    """
    n = len(w)
    if n < 2 * edge:
        return 0, n
    floor = min(np.sqrt(np.mean(w[:edge] ** 2)), np.sqrt(np.mean(w[-edge:] ** 2)))
    limit = snr * (floor if floor >= 1e-10 else 0.01 * np.abs(w).max())
    env = gaussian(envelope(w[None, :]), 3.0)[0]
    top = int(env.argmax())
    least = int((least_us or 0.0) * 1e-6 / dt)
    if not env[top] > limit:
        return _around(top, max(25, least // 2 if least_us is not None else int(0.2e-6 / dt)), n)
    quiet = np.flatnonzero(env < limit)
    found = pulse_peaks(w, dt, separation_us=separation_us)
    if len(found) > 1:
        main = int(found[env[found].argmax()])
        left, right = found[found < main], found[found > main]
        before, after = quiet[quiet <= main], quiet[quiet >= main]
        lo = int(before[-1]) if len(before) else int(left[0]) + 10 if len(left) else main
        hi = int(after[0]) if len(after) else int(right[0]) - 10 if len(right) else main
        extra = max(10, int(0.1e-6 / dt))
        if least_us is None:
            return max(0, lo - extra), min(n, hi + extra)
        first, last = (int(left[-1]) + 10 if len(left) else 0), (int(right[0]) - 10 if len(right) else n)
        lo, hi = max(first, lo - extra), min(last, hi + extra)
        return (lo, hi) if hi - lo >= least else (max(first, main - least // 2), min(last, main + least // 2))
    before = quiet[quiet <= top]
    lo = int(before[-1]) if len(before) else 0
    # the end is where the envelope stays low, not a dip
    hi = next((int(i) for i in quiet[quiet >= top] if env[i : i + 50].max() < 1.5 * limit), n - 1)
    extra = max(10, (hi - lo) // 10)
    lo, hi = max(0, lo - extra), min(n, hi + extra)
    return (lo, hi) if hi - lo >= least else _around(top, least // 2, n)
