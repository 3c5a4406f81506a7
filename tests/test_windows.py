import random

import pytest

from voltlake.operators import windows


def walked(rows, sizes):
    """The windows kept, one event after another."""
    out = set()
    for ch in {r[0] for r in rows}:
        end = -1
        for _, k, x, b in sorted({r for r in rows if r[0] == ch and r[2] is not None}, key=lambda r: (r[2], r[1])):
            if b not in sizes or x - sizes[b][0] < 0 or x - sizes[b][0] <= end:
                continue
            out.add((ch, k, x - sizes[b][0], x + sizes[b][1]))
            end = x + sizes[b][1]
    return out


@pytest.mark.parametrize("sizes", [{"D1": (5, 20), "D2": (10, 40), "D3": (25, 100)}, {"D1": (0, 0)}])
def test_kept_windows_equal_a_walk(spark, monkeypatch, sizes):
    monkeypatch.setattr(windows, "CHUNK", 700)  # many ranges
    rng = random.Random(4)
    rows = [(ch, i + 1000 * (ch or 0), rng.randrange(0, 9000), rng.choice(["D1", "D2", "D3", "D9", None])) for ch in (1, 2, None) for i in range(400)]
    rows += [(3, 9000 + i, x, "D1") for i, x in enumerate([4, 5, 5, 5, 30, 31, 31])] + [(3, 9900, None, "D1")] + rows[:20]
    df = spark.createDataFrame(rows, "ch int, id long, i long, band string")
    got = windows.kept_windows(df.selectExpr("*", "'clash' AS start"), "ch", "i", "id", "band", sizes).collect()
    assert {(r["ch"], r["id"], r["start"], r["stop"]) for r in got} == walked(rows, sizes)
    assert len(got) == len({(r["ch"], r["id"]) for r in got})
    assert windows.kept_windows(df.limit(0), "ch", "i", "id", "band", sizes).count() == 0


def test_bands_at_other_rates():
    assert windows.scaled_windows(125e6)["D1"] == (25, 100) and windows.scaled_windows()["D5"] == (1000, 4000)
    assert windows.band_range(1, 250e6) == (62.5e6, 125e6) and windows.band_range(3, 250e6) == (15.625e6, 31.25e6)
