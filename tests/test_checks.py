import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from voltlake.operators import checks, labels


def test_names_tell_types(spark):
    names = {
        "Surf_PD 3": "SURFACE", "insulator tracking": "SURFACE", "Point-Plane gap": "CORONA", "pointplane": "CORONA", "Grounded needle 2": "CORONA", "VOID": "INTERNAL",
        "cavity in-oil": "INTERNAL", "transformer oil": "INTERNAL", "no pd": "NOISE", "NoPD": "NOISE", "Background": "NOISE", "surface void": "SURFACE", "motor": "UNKNOWN", "": "UNKNOWN", None: "UNKNOWN",
    }
    df = spark.createDataFrame([(n, w) for n, w in names.items()], "name string, want string").withColumn("label", F.lit("clash"))
    got = {r["name"]: r["l"] for r in df.select("name", labels.label_of(F.col("name")).alias("l")).collect()}
    assert got == names
    only = labels.labelled(df, "name", ["NOISE"]).collect()
    assert sorted(r["name"] for r in only) == ["Background", "NoPD", "no pd"] and {r["label"] for r in only} == {"NOISE"}
    assert labels.labelled(df, "name").count() == 12
    own = df.select(labels.label_of(F.col("name"), [("MACHINE", ("motor",))], None).alias("l")).where("l IS NOT NULL")
    assert [r["l"] for r in own.collect()] == ["MACHINE"]


def test_amplitudes_against_peaks(spark):
    rows = [("a", -5.0, 2.0, -5.0), ("a", 5.0, 5.0, -5.0), ("a", 4.0, 5.0, -1.0), ("a", None, 1.0, 1.0), ("a", 1.0, math.nan, 1.0), (None, 0.0, 0.0, 0.0), ("b", math.inf, 1.0, 1.0)]
    got = {r["g"]: r for r in checks.amplitude_agreement(spark.createDataFrame(rows, "g string, a double, p double, n double"), "g", "a", "p", "n").collect()}
    assert (got["a"]["n"], got["a"]["n_agree"]) == (3, 2) and got["a"]["percent"] == pytest.approx(200 / 3)
    assert got[None]["percent"] == 100 and (got["b"]["n"], got["b"]["percent"]) == (0, None)


def test_phases_against_times(spark):
    rng = np.random.default_rng(9)
    t = rng.uniform(-1, 20, 500)
    rows = [("shifted", float(x), float((x * 50 % 1 * 360 + 350) % 360), 50.0) for x in t]
    rows += [("random", float(x), float(rng.uniform(0, 360)), 60.0) for x in t]
    rows += [("shifted", None, 1.0, 50.0), ("shifted", 1.0, math.nan, 50.0), ("still", 1.0, 1.0, 0.0), (None, 0.5, 90.0, 1.0)]
    df = spark.createDataFrame(rows, "g string, s double, p double, f double").withColumn("offset", F.lit("clash"))
    got = {r["g"]: r for r in checks.phase_agreement(df, "g", "s", "p", "f").collect()}
    a, b = got["shifted"], got["random"]
    assert a["n"] == 500 and a["offset"] == pytest.approx(350) and a["concentration"] == pytest.approx(1) and a["percent"] == 100
    assert b["concentration"] < 0.2 and b["percent"] < 15
    assert got[None]["offset"] == pytest.approx(270) and "still" not in got
    assert checks.phase_agreement(df.limit(0), "g", "s", "p", "f").count() == 0
