import numpy as np
import pytest

from voltlake.functions import kernels as k

DT = 4e-9


def test_daubechies_is_orthonormal():
    for order in (1, 2, 4, 8):
        h = k.daubechies(order)
        assert len(h) == 2 * order
        assert h.sum() == pytest.approx(np.sqrt(2))
        for shift in range(order):
            assert h[2 * shift :] @ h[: len(h) - 2 * shift] == pytest.approx(1.0 if shift == 0 else 0.0, abs=1e-7)


def test_smooth_signals_have_no_detail():
    x = np.linspace(0, 1, 256)[None, :] ** 2
    _, d = k.dwt_step(x)
    assert np.abs(d[0, 8:-8]).max() < 1e-9


def test_energy_is_kept_inside():
    rng = np.random.default_rng(1)
    x = np.zeros((1, 512))
    x[0, 200:300] = rng.normal(size=100)
    a, d = k.dwt_step(x)
    assert (a**2).sum() + (d**2).sum() == pytest.approx((x**2).sum())


def test_exponential_pulse():
    n, tau = 1000, 100
    w = np.zeros((1, n))
    w[0, 100:] = np.exp(-np.arange(n - 100) / tau)
    f = {name: v[0] for name, v in k.pulse_features(w, DT).items()}
    assert f["absolute_amplitude"] == 1.0
    assert f["rise_time"] == 0.0
    assert f["fall_time"] == pytest.approx((np.ceil(tau * np.log(10)) - np.ceil(-tau * np.log(0.9))) * DT)
    assert f["pulse_width"] == pytest.approx(np.floor(tau * np.log(2)) * DT)
    assert f["cumulative_energy_area_ratio"] == np.inf
    assert f["polarity"] == 1.0
    assert f["pulse_count"] == 1.0


def test_tone_and_silence():
    n = 500
    tone = np.sin(2 * np.pi * 10e6 * np.arange(n) * DT)[None, :]
    f = {name: v[0] for name, v in k.pulse_features(np.vstack([tone, np.zeros((1, n))]), DT).items()}
    assert f["dominant_frequency"] == pytest.approx(10e6)
    assert f["spectral_entropy"] < 2
    silent = {name: v[1] for name, v in k.pulse_features(np.vstack([tone, np.zeros((1, n))]), DT).items()}
    assert all(np.isfinite(v) for v in silent.values())
    assert silent["energy"] == silent["rise_time"] == silent["pulse_count"] == 0.0
    assert silent["cumulative_energy_area_ratio"] == 1.0


@pytest.mark.parametrize("n", [1, 2, 7, 50, 51, 64, 125, 2000])
def test_any_length(n):
    w = np.random.default_rng(n).normal(size=(3, n))
    assert set(k.pulse_features(w, DT)) == set(k.pulse_features(np.zeros((1, 64)), DT))
    for method in k.WINDOW_METHODS:
        lo, hi = k.window_bounds(w[0], DT, method)
        assert 0 <= lo <= hi <= n


def block(n, *spans):
    w = np.zeros(n)
    for lo, hi, size in spans:
        w[lo:hi] = size
    return w


@pytest.mark.parametrize(
    ("method", "want"),
    [
        ("original", (0, 1000)), ("rise_fall", (391, 448)), ("energy90", (391, 447)), ("energy95", (391, 448)), ("peak0.5us", (338, 462)), ("peak1.0us", (276, 524)),
        ("peak2.0us", (151, 649)), ("adaptive_shrink", (391, 448)),
    ],
)
def test_window_bounds_by_hand(method, want):
    """Forty equal samples from 400: edges at 400 and 439, 9 samples of padding to either
    side; the energy margins are two samples (one), the buffer ten. A microsecond is just
    below 250 samples in floating point, so widths are 124, 249 and 499."""
    assert k.window_bounds(block(1000, (400, 440, 1.0)), DT, method) == want


def test_smart_windows_by_hand():
    rng = np.random.default_rng(4)
    w = rng.normal(0, 1e-3, 2000)
    w[900:940] += 1.0
    lo, hi = k.window_bounds(w, DT, "smart3x")
    assert lo < 900 and hi > 940
    assert k.window_bounds(w, DT, "isolated2x1.0us")[1] - k.window_bounds(w, DT, "isolated2x1.0us")[0] >= 250
    assert k.window_bounds(w[:99], DT, "smart2x") == (0, 99)  # shorter than two edges
    noise = rng.normal(0, 1.0, 400)
    top = int(k.gaussian(k.envelope(noise[None, :]), 3.0)[0].argmax())
    assert k.smart_bounds(noise, DT, 1e3, 0.5) == (max(0, top - 62), min(400, top + 62))
    assert k.smart_bounds(noise, DT, 1e3, None) == (max(0, top - 49), min(400, top + 49))


def test_the_least_window_stops_before_another_pulse():
    w = block(1000, (300, 310, 1.0), (480, 490, 0.8)) + np.random.default_rng(0).normal(0, 1e-4, 1000)
    lo, hi = k.window_bounds(w, DT, "isolated2x1.0us")
    other = int(k.pulse_peaks(w, DT)[-1])
    assert lo < 300 < 310 < hi <= other - 10


def test_two_pulses_far_and_near():
    n = 1000
    for gap, count in ((250, 2), (75, 1)):
        w = np.zeros(n)
        for at, size in ((300, 1.0), (300 + gap, 0.8)):
            w += size * np.exp(-0.5 * ((np.arange(n) - at) / 10) ** 2)
        assert len(k.pulse_peaks(w, DT)) == count


def test_peaks():
    assert k.peaks(np.array([0, 1, 1, 1, 0, 2, 0, 3])).tolist() == [2, 5]
    assert k.peaks(np.array([0, 3, 0, 2, 0, 2.5, 0]), distance=3).tolist() == [1, 5]
    assert k.peaks(np.array([0, 5, 4.5, 5.5, 0.0]), prominence=1).tolist() == [3]
    assert k.peaks(np.array([1.0, 1.0])).tolist() == []


def test_polarity_follows_the_sign():
    w = np.zeros((2, 200))
    w[0, 100:110], w[1, 100:110] = 1.0, -1.0
    for method, sign in k.polarities(w).items():
        assert sign[0] == 1.0, method
        assert sign[1] == -1.0, method


def test_envelope_of_a_tone_is_flat():
    x = np.cos(2 * np.pi * np.arange(400) * 0.05)[None, :]
    assert np.abs(k.envelope(x)[0] - 1).max() < 1e-6
