import pytest

from voltlake.llm import encoding

SOUND = [
    "Der Kühlkörper misst 4,5 µm ± 0,2 °C über die Länge; die Wärme fällt ab.",
    "La disposición incluye el cárter, la lámina y la válvula de presión.",
    "L’électrode est à côté de la pièce, où l’on mesure 3–5 Hz.",
    "The gap of 3.5 ± 0.2 mm is ≥ 4 µm at 20 °C and 2–3 kΩ.",
    "La inscripción «ЗАВОД Г39 – ВЫСОКОЕ НАПРЯЖЕНИЕ» y São Tamão, ÅNGSTRÖM.",
]


def corpus():
    docs = {i: SOUND[i % len(SOUND)] + f" Absatz {i}." for i in range(400)}
    bad = {}

    def damage(i, text, true, used, times=1):
        for _ in range(times):
            text = text.encode(true).decode(used, "replace")
        bad[i] = text

    damage(1000, SOUND[0], "utf_8", "latin_1")
    damage(1001, SOUND[1], "utf_8", "cp437")
    damage(1002, SOUND[1], "utf_8", "cp850")
    damage(1003, SOUND[0], "utf_8", "mac_roman")
    damage(1004, SOUND[1], "utf_8", "cp1251")
    damage(1005, SOUND[1], "cp1252", "mac_roman")
    damage(1006, SOUND[3][:30], "utf_8", "latin_1", 2)
    bad[1007] = SOUND[3].replace(" ± ", " Â± ")
    bad[1008] = "Der K�hlk�rper misst wenig."
    return docs, bad


@pytest.fixture(scope="module")
def labelled(spark):
    docs, bad = corpus()
    quotes = {2000: "A display showing “Ã¼” in place of “ü” is wrong.", 2001: "The terminal echoes Ã¶ where the sign ö was typed.", 2002: "The terminal echoes â€“ where the sign – was typed.", 2003: "Prior terminals print ‘â€™’ for ‘’’, which is avoided."}
    rest = {3000: None, 3001: "", 3002: "plain ASCII " * 20_000}
    rows = [*docs.items(), *bad.items(), *quotes.items(), *rest.items(), (1000, bad[1000])]
    frame = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, restored string")
    found = encoding.damaged_texts(frame, encoding.context_counts(frame)).collect()
    return {r["doc_id"]: r for r in found}, len(found), bad


def test_finds_damage_only(labelled):
    found, n, bad = labelled
    assert n == len(found)
    assert set(found) == set(bad)


@pytest.mark.parametrize(("doc", "text"), [(1000, SOUND[0]), (1001, SOUND[1]), (1002, SOUND[1]), (1003, SOUND[0]), (1004, SOUND[1]), (1005, SOUND[1]), (1006, SOUND[3][:30]), (1007, SOUND[3])])
def test_restores(labelled, doc, text):
    row = labelled[0][doc]
    assert row["restored"] == text
    assert row["recovered"]


def test_lost_signs_are_reported(labelled):
    assert not labelled[0][1008]["recovered"]


def test_empty(spark):
    frame = spark.createDataFrame([], "doc_id long, text string")
    assert encoding.damaged_texts(frame, encoding.context_counts(frame)).count() == 0


@pytest.mark.parametrize("used", ["cp437", "cp850", "cp1250", "mac_roman", "gb18030"])
def test_undo_is_the_inverse(used):
    for text in ("äöü", "–", "Ωµ"):
        try:
            wrong = text.encode().decode(used)
        except UnicodeDecodeError:
            continue
        assert encoding.undo(wrong, (("utf_8", used),)) == text
