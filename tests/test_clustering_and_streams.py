import numpy as np
import pytest

from voltlake.operators import analytics, clustering, streams
from voltlake.operators.graph import components


@pytest.fixture(scope="module")
def blobs():
    rng = np.random.default_rng(2)
    rows = []
    for g in (1, 2):
        for c, (x, y) in enumerate([(0, 0), (5, 5), (0, 9)]):
            for _ in range(60):
                rows.append((g, len(rows), float(x + rng.normal(0, 0.4)), float(y + rng.normal(0, 0.4)), c))
    rows += [(1, 9000, 30.0, 30.0, -1), (3, 9001, 1.0, 1.0, -1)]
    return rows


@pytest.fixture(scope="module")
def frame(spark, blobs):
    return spark.createDataFrame(blobs, "ds int, id long, x double, y double, truth int").cache()


def test_neighbour_distances_are_exact(frame, blobs):
    got = {r["id"]: r["distance"] for r in clustering.neighbour_distances(frame, "ds", "id", ["x", "y"], k=5).collect()}
    for g in (1, 2):
        pts = [r for r in blobs if r[0] == g]
        xy = np.array([r[2:4] for r in pts])
        d = np.sort(np.sqrt(((xy[:, None] - xy[None]) ** 2).sum(-1)), axis=1)[:, 4]
        for r, want in zip(pts, d, strict=True):
            assert got[r[1]] == pytest.approx(want)
    assert 9001 not in got


def test_dbscan_against_all_pairs(spark, frame, blobs):
    eps = spark.createDataFrame([(1, 0.6), (2, 0.6), (3, 0.6)], "ds int, eps double")
    got = {r["id"]: r["cluster"] for r in clustering.dbscan(frame, "ds", "id", ["x", "y"], eps, 5).collect()}
    for g in (1, 2):
        pts = [r for r in blobs if r[0] == g]
        xy = np.array([r[2:4] for r in pts])
        near = np.sqrt(((xy[:, None] - xy[None]) ** 2).sum(-1)) <= 0.6
        core = near.sum(1) >= 5
        label = np.arange(len(pts))
        for _ in range(len(pts)):
            new = np.array([label[near[i] & core].min() if core[i] else label[i] for i in range(len(pts))])
            if (new == label).all():
                break
            label = new
        for i, r in enumerate(pts):
            if core[i]:
                assert got[r[1]] == pts[label[i]][1]
            elif not (near[i] & core).any():
                assert got[r[1]] is None
    assert got[9000] is None and got[9001] is None


def hard_rows():
    """Ties, a dense spot of all core rows, thin rows around it, far rows, and rows that
    cannot be placed; group 7 has no radius, group None has one."""
    rng = np.random.default_rng(8)
    pts = [(0.5, 0.5)] * 30 + [tuple(p) for p in rng.normal(0, 0.02, (150, 2))] + [tuple(p) for p in rng.normal(0, 0.6, (60, 2))]
    pts += [(9.0, 9.0)] * 4 + [(9.2, 9.0), (-7.0, 3.0)]
    rows = [(None, i, float(x), float(y)) for i, (x, y) in enumerate(pts)]
    return rows + [(None, 900, None, 0.0), (None, 901, float("nan"), 0.0), (None, 902, float("inf"), 0.0), (7, 903, 0.0, 0.0)]


def test_neighbours_among_ties_and_beside_dense_spots(spark):
    rows = hard_rows()
    got = {r["id"]: r["distance"] for r in clustering.neighbour_distances(spark.createDataFrame(rows, "g int, id long, x double, y double"), "g", "id", ["x", "y"], 5).collect()}
    xy = np.array([r[2:] for r in rows[:-4]])
    want = np.sort(np.sqrt(((xy[:, None] - xy[None]) ** 2).sum(-1)), axis=1)[:, 4]
    assert sorted(got) == list(range(len(xy)))
    assert all(got[i] == pytest.approx(d) for i, d in enumerate(want))


@pytest.mark.parametrize("few", [64, 1])
@pytest.mark.parametrize("radius", [0.05, 0.3])
def test_dbscan_of_ties_dense_spots_and_borders(spark, monkeypatch, radius, few):
    monkeypatch.setattr(clustering, "FEW_PAIRS", few)
    rows = hard_rows()
    eps = spark.createDataFrame([(None, radius)], "g int, eps double")
    got = {r["id"]: r["cluster"] for r in clustering.dbscan(spark.createDataFrame(rows, "g int, id long, x double, y double"), "g", "id", ["x", "y"], eps, 5).collect()}
    xy = np.array([r[2:] for r in rows[:-4]])
    gap = xy[:, None] - xy[None]
    d2 = gap[..., 0] * gap[..., 0] + gap[..., 1] * gap[..., 1]
    near = d2 <= radius * radius
    core = near.sum(1) >= 5
    label = np.arange(len(xy))
    while True:
        new = np.array([label[near[i] & core].min() if core[i] else i for i in range(len(xy))])
        if (new == label).all():
            break
        label = new
    for i in range(len(xy)):
        held = np.flatnonzero(near[i] & core)
        want = label[i] if core[i] else label[min(held, key=lambda j: (d2[i, j], j))] if len(held) else None
        assert got[i] == want, i
    assert all(got[i] is None for i in (900, 901, 902, 903)) and len(got) == len(rows)


def test_dbscan_of_no_rows(spark):
    none = spark.createDataFrame([], "g int, id long, x double")
    assert clustering.dbscan(none, "g", "id", ["x"], spark.createDataFrame([], "g int, eps double")).count() == 0
    assert clustering.neighbour_distances(none, "g", "id", ["x"]).count() == 0


def test_kmeans_and_silhouette(spark, frame, blobs):
    sound = frame.where("truth >= 0")
    got = clustering.kmeans(sound, "ds", "id", ["x", "y"], k=3, seed=5)
    assert got.count() == 360
    labels = sound.join(got.select("id", "cluster"), "id")
    sil = {r["ds"]: r["silhouette"] for r in clustering.silhouette(sound, "ds", "truth", ["x", "y"]).collect()}
    for g in (1, 2):
        pts = [r for r in blobs if r[0] == g and r[4] >= 0]
        xy, t = np.array([r[2:4] for r in pts]), np.array([r[4] for r in pts])
        d = ((xy[:, None] - xy[None]) ** 2).sum(-1)
        s = []
        for i in range(len(pts)):
            a = d[i][t == t[i]].sum() / ((t == t[i]).sum() - 1)
            b = min(d[i][t == c].mean() for c in set(t) - {t[i]})
            s.append((b - a) / max(a, b))
        assert sil[g] == pytest.approx(np.mean(s))
    assert labels.count() == 360


def test_kmeans_comes_to_rest_at_the_best_of_its_starts(spark):
    rng = np.random.default_rng(8)
    rows = [(g, 10_000 * g + i, float(rng.uniform()), float(rng.uniform())) for g in (1, 2, 3) for i in range(2500)]
    rows += [(g, 10_000 * g + i, float(20 * (i % 3) + rng.normal(0, 0.3)), float(rng.normal())) for g in (4, 5, 6, 7) for i in range(90)]
    rows += [(8, 80_000 + i, float(i), 0.0) for i in range(2)]
    got = {r["id"]: r for r in clustering.kmeans(spark.createDataFrame(rows, "ds int, id long, x double, y double"), "ds", "id", ["x", "y"], k=3).collect()}
    assert len(got) == len(rows)
    for g in range(1, 8):
        pts = [r for r in rows if r[0] == g]
        xy, label = np.array([r[2:] for r in pts]), np.array([got[r[1]]["cluster"] for r in pts])
        means = np.array([xy[label == c].mean(0) for c in range(3)])
        d = np.sqrt(((xy[:, None] - means[None]) ** 2).sum(-1))
        assert (d.argmin(1) == label).all()
        assert [got[r[1]]["distance"] for r in pts] == pytest.approx(d.min(1), abs=1e-7)
        if g > 3:
            assert len({(label[i], i % 3) for i in range(90)}) == 3
    assert {got[80_000]["cluster"], got[80_001]["cluster"]} == {0, 1}


def test_components(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(30)] + [(90, 80)], "u long, v long")
    got = {r["node"]: r["label"] for r in components(links).collect()}
    assert got == {**dict.fromkeys(range(31), 0), 90: 80, 80: 80}


def test_principal_components(spark):
    rng = np.random.default_rng(8)
    x = rng.normal(size=300)
    rows = [(i, float(x[i]), float(2 * x[i] + 1), float(rng.normal()), 7.0) for i in range(300)]
    df = spark.createDataFrame(rows, "id long, a double, b double, c double, d double")
    _, _, m = analytics.covariance(df, ["a", "b", "c", "d"])
    share, vector = analytics.components(m[:3, :3])
    assert share[0] == pytest.approx(2 / 3, abs=0.05)
    assert np.allclose(vector.T @ vector, np.eye(3))
    chosen = {f: ok for f, _, ok in analytics.recommended(["a", "b", "c", "d"], m, wanted=2)}
    assert sum(chosen.values()) == 2 and chosen["c"] and not chosen["d"]
    assert analytics.project(df, ["id"], ["a", "b", "c", "d"]).count() == 300


@pytest.mark.parametrize("chunk", [1 << 22, 37])
def test_crossings_windows_and_phase(spark, monkeypatch, chunk):
    monkeypatch.setattr(streams, "CHUNK", chunk)
    rng = np.random.default_rng(1)
    x = rng.normal(0, 1, 500)
    x[[60, 61, 200, 203, 420]] = 12
    df = spark.createDataFrame([("c", i, float(v)) for i, v in enumerate(x)], "ch string, i long, x double")
    levels = spark.createDataFrame([("c", 0.0, 6.0)], "ch string, baseline double, threshold double")
    cross = streams.crossings(df, "ch", "i", "x", levels)
    assert sorted(r["i"] for r in cross.collect()) == [60, 200, 203, 420]
    cut = streams.extract_windows(df, cross, "ch", "i", "x", 4, 12).collect()
    assert sorted(r["trigger"] for r in cut) == [60, 200, 420]
    assert all(np.allclose(r["waveform"], x[r["trigger"] - 4 : r["trigger"] + 12]) and r["signed_peak"] == 12 for r in cut)
    wave = np.sin(2 * np.pi * np.arange(500) / 50 + 0.3)
    ref = spark.createDataFrame([("c", i, float(v)) for i, v in enumerate(wave)], "ch string, i long, x double")
    phase = {r["i"]: r["phase"] for r in streams.zero_crossing_phase(ref, "ch", "i", "x").collect()}
    at = [i for i, p in phase.items() if p is not None]
    want = np.array([(i / 50 * 360 + np.degrees(0.3)) % 360 for i in at])
    off = np.abs(np.array([phase[i] for i in at]) - want) % 360
    assert len(at) == 500 and np.minimum(off, 360 - off).max() < 1.0


def test_wavelet_blocks_agree_with_the_whole(spark):
    from voltlake.functions import kernels

    x = np.random.default_rng(3).normal(size=5000)
    df = spark.createDataFrame([("c", i, float(v)) for i, v in enumerate(x)], "ch string, i long, x double")
    got = {(r["band"], r["sample"]): r["coefficient"] for r in streams.wavelet_coefficients(df, "ch", "i", "x", block=1024).collect()}
    _, details = kernels.wavedec(x[None, :], 3)
    for level, d in enumerate(details, 1):
        for k, v in enumerate(d[0]):
            at = (k << level) + (1 << (level - 1))
            if 100 < at < 4900:
                assert got[f"D{level}", at] == pytest.approx(v, abs=1e-9)


def test_rate_threshold_against_a_count(spark):
    x = np.random.default_rng(9).normal(size=3000)
    df = spark.createDataFrame([("c", i, float(v)) for i, v in enumerate(x)], "ch string, i long, x double")
    levels = spark.createDataFrame([("c", 0.0, 1 / 1.4826, 3000)], "ch string, baseline double, mad double, n_values long")
    got = streams.pulse_rate_threshold(df, "ch", "i", "x", levels, 100, 5.0, lowest=0.5, highest=4.0, step=0.1).first()

    def rate(t):
        up = ((x[1:] > t) & (x[:-1] <= t)).sum()
        down = ((-x[1:] > t) & (-x[:-1] <= t)).sum()
        return (up + down) / 30

    assert got["per_cycle"] == pytest.approx(rate(got["threshold"])) and got["per_cycle"] <= 5.0
    assert rate(got["threshold"] - 0.1) > 5.0


def test_sine_fit(spark):
    i = np.arange(4000)
    x = 3.0 * np.sin(2 * np.pi * i / 51.0 + np.radians(40)) + 7.0
    df = spark.createDataFrame([("c", int(k), float(v)) for k, v in enumerate(x)], "ch string, i long, x double")
    got = streams.sine_fit(df, "ch", "i", "x", 50.0, spread=0.1, steps=100).first()
    assert got["period"] == pytest.approx(51.0, abs=0.06)
    assert got["amplitude"] == pytest.approx(3.0, rel=0.1)


def test_mutual_information(spark):
    rng = np.random.default_rng(6)
    rows = [(1, k % 2, float(k % 2), float(rng.random()), 5.0, None) for k in range(2000)]
    df = spark.createDataFrame(rows, "ds int, y int, same double, noise double, flat double, none double")
    got = {r["feature"]: r["information"] for r in analytics.mutual_information(df, "ds", "y", ["same", "noise", "flat", "none"]).collect()}
    assert got["same"] == pytest.approx(1.0) and got["noise"] < 0.05 and got["flat"] == 0.0 and "none" not in got


def test_phase_needs_two_crossings(spark):
    rows = [("one", i, float(i - 5)) for i in range(10)] + [("flat", i, 1.0) for i in range(5)]
    got = streams.zero_crossing_phase(spark.createDataFrame(rows, "ch string, i long, x double"), "ch", "i", "x").collect()
    assert len(got) == 15 and all(r["phase"] is None for r in got)
