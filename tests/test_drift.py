import json

import pytest

from voltlake.operators import drift

SCHEMA = "file_id long, logger_id int, written_at timestamp, record_no int, payload string, key string"


def table(spark, files):
    """files: (file_id, logger, day, [payload])."""
    import datetime

    rows = []
    for fid, logger, day, payloads in files:
        for n, p in enumerate(payloads):
            text = p if p is None or isinstance(p, str) else json.dumps(p)
            rows.append((fid, logger, datetime.datetime(2024, 1, 1) + datetime.timedelta(days=day), n, text, "clash"))
    return spark.createDataFrame(rows, SCHEMA)


def rec(name, **fields):
    return {"dataset": name, **fields}


def run(spark, files):
    records = table(spark, files)
    ingested = drift.ingest(records)
    changes, renames = drift.field_changes(drift.field_cells(ingested), drift.file_sequence(ingested))
    named = {(r["file_id"], r["before"], r["after"], r["power"]) for r in renames.collect()}
    return {tuple(r) for r in changes.collect()}, named, renames, ingested


def test_rename_retype_add_remove(spark):
    one = [rec(f"d{i}", dt=4e-9 * (i + 1), gone=i, note="x", flip=i) for i in range(4)]
    two = [rec(f"d{i}", dt_ns={"value": 4.0 * (i + 1), "unit": "ns"}, fresh=100 + 7 * i, note="x", flip=str(i)) for i in range(1, 6)]
    changes, renames, *_ = run(spark, [(1, 1, 0, one), (2, 1, 1, two)])
    assert changes == {
        (2, "renamed", "dt", "dt_ns"), (2, "retyped", "dt", "dt_ns"), (2, "retyped", "flip", "flip"),
        (2, "removed", "gone", ""), (2, "added", "", "fresh"),
    }
    assert renames == {(2, "dt", "dt_ns", -3)}


def test_odd_values_and_missing_keys_do_not_hide_a_rename(spark):
    one = [rec("a", f=50.01), rec("b", f="n/a"), rec("c", f=None), rec("d")]
    two = [rec("a", g="50.01 Hz"), rec("b", g="60.1 Hz"), rec("c", g=[49.9]), rec("d", g="1")]
    changes, *_ = run(spark, [(1, 1, 0, one), (2, 1, 1, two)])
    assert (2, "renamed", "f", "g") in changes


def test_no_shared_value_means_added_and_removed(spark):
    changes, *_ = run(spark, [(1, 1, 0, [rec("a", f=1)]), (2, 1, 1, [rec("b", g=1)])])
    assert changes == {(2, "removed", "f", ""), (2, "added", "", "g")}


def test_order_is_by_writing_and_per_logger(spark):
    files = [(5, 1, 3, [rec("a", x=1)]), (3, 1, 9, [rec("a", y=1)]), (4, 2, 1, [rec("a", z=1)])]
    changes, *_ = run(spark, files)
    assert changes == {(3, "renamed", "x", "y")}


def test_broken_null_and_repeated_records(spark):
    files = [(1, 1, 0, [rec("a", x=1), None, "not json", "[1]", ""]), (1, 1, 0, [rec("a", x=1)]), (2, 1, 1, [rec("a", x=None)])]
    changes, _, _, ingested = run(spark, files)
    assert changes == set()
    rows = {(r["file_id"], r["record_no"]): r for r in ingested.collect()}
    assert len(rows) == 6
    assert json.loads(rows[1, 2]["rescued"]) == {"unparsed": "not json"}


def test_empty(spark):
    changes, renames, _, ingested = run(spark, [(1, 1, 0, [])])
    assert changes == renames == set()
    assert ingested.count() == 0


def by_record(table):
    return {(r["file_id"], r["record_no"]): r for r in table.collect()}


def test_ingest_rescues_and_replays(spark):
    one = [rec(f"d{i}", sample_interval=4e-9, ac_frequency="50 Hz", total_records=10 + i, other="kept") for i in range(3)]
    two = [rec(f"d{i}", dt_us=[4e-3], ac_frequency="bad", n={"value": 10 + i}, other="kept") for i in range(3)]
    _, _, renames, first = run(spark, [(1, 1, 0, one), (2, 1, 1, two)])
    before = by_record(first)
    assert before[2, 0]["sample_interval"] is None
    assert json.loads(before[2, 0]["rescued"]) == {"dt_us": [4e-3], "ac_frequency": "bad", "n": {"value": 10}, "other": "kept"}
    after = by_record(drift.replay(first, drift.approved_names(renames)))
    assert after[2, 1]["sample_interval"] == pytest.approx(4e-9)
    assert after[2, 1]["total_records"] == 11
    assert after[2, 1]["ac_frequency"] is None
    assert json.loads(after[2, 1]["rescued"]) == {"ac_frequency": "bad", "other": "kept"}
    assert after[1, 1]["ac_frequency"] == 50.0


def test_what_is_not_promoted_is_unchanged(spark):
    odd = {"i": 5, "f": 1.25, "t": True, "z": None, "o": {"x": 1, "y": ["a", None]}, "l": [1, "2", {}], "s": 'a "quoted" \\ text', "e": "", "u": "\u00b5s"}
    _, _, _, first = run(spark, [(1, 1, 0, [rec("a", fs=50, **odd)])])
    names = spark.createDataFrame([(None, "fs", "ac_frequency", 0)], "logger_id int, key string, target string, power int")
    row = by_record(drift.replay(first, names))[1, 0]
    assert row["ac_frequency"] == 50.0
    assert json.loads(row["rescued"]) == odd


def test_only_the_stored_value_leaves_the_rescue_column(spark):
    _, _, _, first = run(spark, [(1, 1, 0, [rec("a", ac_frequency=60, fs=50), rec("b", fs=50, fs_alias=55), rec("c", total_records=2.5, n=3)])])
    names = spark.createDataFrame([(None, "fs", "ac_frequency", 0), (None, "fs_alias", "ac_frequency", 0), (None, "n", "total_records", 0)], "logger_id int, key string, target string, power int")
    rows = by_record(drift.replay(first, names))
    assert rows[1, 0]["ac_frequency"] == 60.0 and json.loads(rows[1, 0]["rescued"]) == {"fs": 50}
    assert rows[1, 1]["ac_frequency"] == 50.0 and json.loads(rows[1, 1]["rescued"]) == {"fs_alias": 55}
    assert rows[1, 2]["total_records"] == 3 and json.loads(rows[1, 2]["rescued"]) == {"total_records": 2.5}


def test_a_logger_keeps_its_own_unit(spark):
    files = []
    for logger, unit in ((1, 1e6), (2, 1e6), (3, 1e9)):
        files.append((10 * logger, logger, 0, [rec(f"d{i}", sample_interval=4e-9 * (i + 1)) for i in range(3)]))
        files.append((10 * logger + 1, logger, 1, [rec(f"d{i}", dt=4e-9 * (i + 1) * unit) for i in range(3)]))
    files.append((40, 4, 0, [rec("x", dt=4e-3)]))
    _, _, renames, first = run(spark, files)
    rows = by_record(drift.replay(first, drift.approved_names(renames)))
    for file_id in (11, 21, 31, 40):
        assert rows[file_id, 0]["sample_interval"] == pytest.approx(4e-9)


def test_any_power_of_a_thousand_is_a_unit(spark):
    one = [rec(f"d{i}", dt=4e-9 * (i + 1)) for i in range(3)]
    two = [rec(f"d{i}", dt_fs=4e6 * (i + 1)) for i in range(3)]
    _, renames, *_ = run(spark, [(1, 1, 0, one), (2, 1, 1, two)])
    assert renames == {(2, "dt", "dt_fs", -5)}


def test_long_chains_of_renames(spark):
    chain = ["sample_interval", *[f"n{i}" for i in range(15)]]
    edges = spark.createDataFrame([(i, 1, a, b, 0) for i, (a, b) in enumerate(zip(chain, chain[1:], strict=False))], "file_id long, logger_id int, before string, after string, power int")
    got = {(r["logger_id"], r["key"]): r["target"] for r in drift.approved_names(edges).collect()}
    assert got[1, "n14"] == got[None, "n14"] == "sample_interval" and len(got) == 2 * (15 + len(drift.TARGETS))
