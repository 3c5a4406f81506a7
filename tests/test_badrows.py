import pytest

from voltlake.operators import badrows

GOOD = ["50", "1", "200", "0", "0", "1.5", "1e3", "2E+2", "2977", "60.1", "4e-09", "3", "-.5", "0", "1.", "0", "0", "0"]


def line(prefix="set 1", **change):
    cells = list(GOOD)
    for k, v in change.items():
        cells[int(k[1:])] = v
    return "\t".join([prefix, *cells])


CASES = {
    "plain": (line(), None),
    "carriage return": (line() + "\r", None),
    "two carriage returns": (line() + "\r\r", "invalid_value"),
    "empty prefix": (line(""), None),
    "quoted prefix with tab": (line('"a\tb"'), None),
    "doubled quote": (line('"bay ""3"""'), None),
    "percent kept": (line('"5% a\t%09"'), None),
    "quoted number": (line(s8='"2977"'), None),
    "blanks around": (line(s9="  60 "), None),
    "never closed": (line('"open'), "quoting"),
    "goes on": (line('"a" b'), "quoting"),
    "quote inside": (line('2" bore'), "quoting"),
    "quote inside before wrong count": ('a"\tb', "quoting"),
    "short": ("a\tb", "column_count"),
    "empty": ("", "column_count"),
    "null": (None, "column_count"),
    "long": (line() + "\t", "column_count"),
    "blank number": (line(s3=""), "invalid_value"),
    "infinite": (line(s3="1e999"), "invalid_value"),
    "word": (line(s3="nan"), "invalid_value"),
    "other digits": (line(s3="６０"), "invalid_value"),
    "comma": (line(s9="60,0"), "invalid_value"),
    "zero frequency": (line(s9="0e0"), "invalid_value"),
    "negative interval": (line(s10="-4e-9"), "invalid_value"),
    "negative count": (line(s8="-1"), "invalid_value"),
    "part of a record": (line(s8="2.5"), "invalid_value"),
    "zero records": (line(s8="0"), None),
    "very long": (line('"' + "x\t" * 50_000 + '"'), None),
}


@pytest.fixture(scope="module")
def judged(spark):
    rows = [(i, text, "raw_line") for i, (text, _) in enumerate(CASES.values())]
    lines = spark.createDataFrame([*rows, rows[3], rows[9]], "line_id long, raw_line string, reason string")
    parsed = badrows.parsed_lines(lines.drop("reason")).cache()
    rejected = badrows.rejected_lines(parsed)
    return rejected.collect(), badrows.valid_settings(parsed, rejected).collect()


def test_reasons(judged):
    names = list(CASES)
    got = {names[r["line_id"]]: r["reason"] for r in judged[0]}
    assert len(judged[0]) == len(got)
    assert got == {k: reason for k, (_, reason) in CASES.items() if reason}


def test_valid_lines_come_out_typed(judged):
    names = list(CASES)
    rows = {names[r["line_id"]]: r for r in judged[1]}
    assert len(judged[1]) == len(rows)
    assert set(rows) == {k for k, (_, reason) in CASES.items() if reason is None}
    assert rows["quoted prefix with tab"]["prefix"] == "a\tb"
    assert rows["doubled quote"]["prefix"] == 'bay "3"'
    assert rows["percent kept"]["prefix"] == "5% a\t%09"
    assert rows["blanks around"]["sg_9"] == 60.0
    assert rows["plain"]["sg_12"] == -0.5


def test_empty_table(spark):
    lines = spark.createDataFrame([], "line_id long, raw_line string")
    assert badrows.rejected_lines(badrows.parsed_lines(lines)).count() == 0
