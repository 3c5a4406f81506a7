import random
import unicodedata

from voltlake.llm import leaks

WORDS = [f"w{i}" for i in range(3000)]


def setup_texts():
    rng = random.Random(5)
    filler = lambda n: " ".join(rng.choice(WORDS[:400]) for _ in range(n))
    item = [rng.choice(WORDS[1000:]) for _ in range(60)]
    other = [rng.choice(WORDS[1000:]) for _ in range(60)]
    edited = list(item)
    for i in (5, 17, 29, 41):
        edited[i] = "changed"
    dropped = [w for i, w in enumerate(item) if i % 15 != 7]
    docs = {
        1: filler(80) + " " + " ".join(item) + " " + filler(40),
        2: filler(30) + " " + " ".join(item[10:40]).upper().replace(" ", ",\n ") + " " + filler(30),
        3: " ".join(item[:16]) + " " + filler(90) + " " + " ".join(item[40:56]),
        4: " ".join(item[40:56]) + " " + filler(90) + " " + " ".join(item[:16]),
        5: " ".join(edited),
        6: " ".join(dropped),
        7: filler(20) + " " + " ".join(item[20:36]),
        8: " ".join(reversed(item)),
        9: filler(300),
        10: None,
        11: "",
        12: " ".join(other[:30]) + filler(50_000),
    }
    return docs, {1: " ".join(item), 2: " ".join(other), 3: None, 4: "", 5: "?!"}


def test_pairs(spark):
    docs, items = setup_texts()
    frame = spark.createDataFrame([*docs.items(), (1, docs[1])], "doc_id long, text string")
    tests = spark.createDataFrame([*items.items(), (1, items[1])], "item_id long, item_text string")
    rows = leaks.leaked_pairs(frame, tests).collect()
    got = {(r["doc_id"], r["item_id"]) for r in rows}
    assert len(rows) == len(got)
    assert got == {(1, 1), (2, 1), (3, 1), (5, 1), (6, 1), (12, 2)}
    share = {r["doc_id"]: r["share_found"] for r in rows}
    assert share[1] == 1.0
    assert 0.45 <= share[2] < 0.55


def test_wrong_decoding_does_not_hide_a_passage(spark):
    text = "Près d’Esmidor la façade mesure 71 mètres où Tanrigu a compté 8353 bobines abîmées après soixante coups de sifflet brefs"
    damaged = text.encode().decode("cp1252", "replace")
    frame = spark.createDataFrame([(1, "abc def " + damaged), (2, "rien de commun ici")], "doc_id long, text string")
    tests = spark.createDataFrame([(7, text)], "item_id long, item_text string")
    assert {tuple(r)[:2] for r in leaks.leaked_pairs(frame, tests).collect()} == {(1, 7)}


def found(spark, docs, items):
    frame = spark.createDataFrame(list(docs.items()), "doc_id long, text string")
    tests = spark.createDataFrame(list(items.items()), "item_id long, item_text string")
    return {tuple(r)[:2] for r in leaks.leaked_pairs(frame, tests).collect()}


def test_other_forms_of_signs(spark):
    item = "Die prüfung ergab fünf stille entladungen affine am gehäuse neben dem offenen trichter für messungen"
    forms = {
        1: unicodedata.normalize("NFD", item), 2: item.replace("ff", "\ufb00"), 3: "".join(chr(ord(c) + 0xFEE0) if "!" <= c <= "~" else c for c in item),
        4: "".join(chr(0x1D41A + ord(c) - 97) if "a" <= c <= "z" else c for c in item), 5: "ein anderer satz über den trichter",
    }
    assert found(spark, forms, {7: item}) == {(d, 7) for d in (1, 2, 3, 4)}
    assert found(spark, {1: item}, {d: t for d, t in forms.items() if d < 5}) == {(1, d) for d in (1, 2, 3, 4)}


def test_items_in_other_scripts(spark):
    russian = "испытание показало что трансформатор выдержал напряжение без пробоя в течение шестидесяти минут"
    chinese = "试验表明变压器在六十分钟内承受了电压而没有击穿现象发生"
    docs = {1: "начало текста " + russian + " конец", 2: "前文" + chinese + "后文", 3: "совсем другой текст о погоде", 4: "english only"}
    assert found(spark, docs, {1: russian, 2: chinese, 3: "plain words that no document holds at all"}) == {(1, 1), (2, 2)}


def test_short_items_need_all_words(spark):
    docs = {1: "alpha and omega zeta", 2: "zeta nothing", 3: "kappa", 4: "zeta omega"}
    assert found(spark, docs, {1: "omega zeta", 2: "kappa"}) == {(1, 1), (3, 2)}


def test_an_item_of_frequent_words(spark):
    rng = random.Random(3)
    common = [f"c{i}" for i in range(40)]
    docs = {i: " ".join(rng.sample(common, 30)) for i in range(30)}
    item = " ".join(rng.sample(common, 25))
    docs[99] = "x1 x2 " + item + " x3"
    assert found(spark, docs, {1: item}) == {(99, 1)}


def test_a_whole_index_serves_later_items(spark):
    frame = spark.createDataFrame([(1, "one two three"), (2, None), (3, "")], "doc_id long, text string")
    whole = leaks.build_index(frame)
    assert sorted((r["doc_id"], r["j"]) for r in whole.collect()) == [(1, 0), (1, 1), (1, 2)]
    later = leaks.item_terms(spark.createDataFrame([(5, "Two!")], "item_id long, _t string"), leaks.ascii_words).selectExpr("xxhash64(term) AS term_id")
    assert whole.join(later, "term_id").select("doc_id", "j").collect() == [(1, 1)]


def test_empty_tables(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    tests = spark.createDataFrame([(1, "a b c d e f")], "item_id long, item_text string")
    assert leaks.leaked_pairs(docs, tests).count() == 0
    some = spark.createDataFrame([(1, "a b c d e f")], "doc_id long, text string")
    assert leaks.leaked_pairs(some, spark.createDataFrame([], "item_id long, item_text string")).count() == 0


def test_runs():
    met = [(i, 100 + i, i) for i in range(10)] + [(i, 300 + i, i) for i in range(20, 30)] + [(5, 7, 5)]
    assert leaks.best_runs(met) == (20, 20, 2)
    assert leaks.best_runs([(0, 9, 0), (1, 3, 1)]) == (0, 0, 0)
    assert leaks.best_runs([]) == (0, 0, 0)
