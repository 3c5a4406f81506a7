import json
import struct

import numpy as np
import pytest

from voltlake.sources import binary, rugged
from voltlake.streaming import events


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    d = tmp_path_factory.mktemp("sets")
    waves = [[0.0, 1.0, -0.5], [0.25, 0.5, 0.75, 1.0]]
    (d / "set a-WFMs.txt").write_text("\n".join("\t".join(f"{x:.10e}" for x in w) for w in waves) + "\n\n")
    (d / "set a-P.txt").write_text("10.0\t20.0\n")
    (d / "set a-Ph.txt").write_text("11.0\t21.0\n")
    (d / "set a-Ti.txt").write_text("0\t.5\t.6")
    (d / "set a-A.txt").write_text("1.0\t\tbad\n")
    (d / "set a-SG.txt").write_text("4\t25\t2000\t0\t0\t1\t1\t1\t0\t60\t8e-09\r\n")
    (d / "short-SG.txt").write_text("4\t25")
    (d / "short-WFMs.txt").write_text("")
    (d / "swapped-A.txt").write_text("0\t1\t2")
    (d / "swapped-Ti.txt").write_text("0.1\t-.2\t.3")
    (d / "set a-metadata.json").write_text(json.dumps({"noise_threshold": 0.5}))
    head = bytearray(300)
    head[2:10] = b":WFM#003"
    struct.pack_into("<I", head, 0x48, 4)
    struct.pack_into("<d", head, 0xA0, 2e-9)
    (d / "x.wfm").write_bytes(bytes(head) + np.array([3200, -3200, 16384, 0] * 100, "<i2").tobytes())
    (d / "bad.wfm").write_bytes(b"nothing")
    (d / "y.pdn").write_bytes(b"headhead" + np.array([1.5, -2.5], ">f4").tobytes() + b"\x00")
    (d / "timing.txt").write_text("1, 16 Sep 2016 15:05:56.172 869 519 614\nno time\n")
    return str(d)


def test_waveforms_and_vectors(spark, folder):
    waves = {(r["dataset"], r["pulse_id"]): r["waveform"] for r in rugged.waveforms(spark, folder).collect()}
    assert waves == {("set a", 0): [0.0, 1.0, -0.5], ("set a", 1): [0.25, 0.5, 0.75, 1.0]}
    phase = [r["value"] for r in rugged.vector(spark, folder, "phase_angle").orderBy("pulse_id").collect()]
    assert phase == [11.0, 21.0]
    amp = [r["value"] for r in rugged.vector(spark, folder, "amplitude").where("dataset = 'set a'").orderBy("pulse_id").collect()]
    assert amp == [1.0, None]


def test_settings_catalog_and_records(spark, folder):
    rows = {r["dataset"]: r for r in rugged.settings(spark, folder).collect()}
    assert rows["set a"]["sample_interval"] == 8e-9 and rows["set a"]["total_records"] == 2000.0
    assert rows["short"]["sample_interval"] == 4e-9 and rows["short"]["ac_frequency"] == 60.0 and rows["short"]["total_records"] is None
    kinds = {r["dataset"]: r["format_type"] for r in rugged.catalog(spark, folder).collect()}
    assert kinds == {"set a": "rugged", "x": "tektronix", "bad": "tektronix", "y": "pdn"}
    joined = rugged.records(spark, folder).orderBy("pulse_id").collect()
    assert [r["trigger_time"] for r in joined] == [0.0, 0.5]
    assert {r["dataset"]: r["swapped"] for r in rugged.swap_flags(spark, folder).collect()} == {"set a": False, "swapped": True}
    assert rugged.metadata(spark, folder).first()["facts"] == {"noise_threshold": 0.5}


def test_lines_are_read_back(spark, folder, tmp_path):
    line = rugged.waveform_lines(rugged.waveforms(spark, folder)).where("pulse_id = 1").first()["line"]
    assert [float(x) for x in line.split("\t")] == [0.25, 0.5, 0.75, 1.0]
    rugged.write_waveforms(rugged.waveforms(spark, folder), str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out")).count() == 2


def test_binary(spark, folder):
    rows = binary.wfm_waveforms(spark, folder).collect()
    good = [r for r in rows if r["error"] is None]
    assert len(good) == 100 and good[0]["waveform"] == [3200 / 32768, -3200 / 32768, 0.5, 0.0] and good[0]["sample_interval"] == 2e-9
    assert [r["error"] for r in rows if r["error"]] == ["no WFM#003 file"]
    pdn = binary.pdn_samples(spark, folder)
    assert pdn.first()["samples"] == [1.5, -2.5]
    same = binary.compare_samples(pdn, pdn.withColumnRenamed("samples", "other"), ["path"], "samples", "other").first()
    assert same["same"] and same["max_difference"] == 0.0


def test_timing(spark, folder):
    r = rugged.timing(spark, folder + "/timing.txt").collect()
    assert len(r) == 1 and r[0]["seconds"] == pytest.approx(54356.172869519614)


def test_streams_equal_batches(spark, tmp_path):
    rows = [("a", i * 3 % 50 + i // 17 * 50, i) for i in range(120)] + [("b", 5, 500)]
    df = spark.createDataFrame(rows, "ch string, i long, event_id long").repartition(1).sortWithinPartitions("i")
    df.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    got = events.run_to_table(events.dead_time_stream(stream, "ch", "i", 7), spark, "append")
    from voltlake.operators.events import dead_time

    assert {tuple(r) for r in got.collect()} == {tuple(r) for r in dead_time(df, "ch", "i", 7).collect()}
