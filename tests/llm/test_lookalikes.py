from loamwork.llm.lookalikes import Rewriter, canonical_texts, look_alike_classes, look_alike_groups, look_alike_pairs, representatives


def test_classes_are_sound():
    members = {m: k for k, v in look_alike_classes().items() for m in v}
    same = lambda a, b: members.get(a, a) == members.get(b, b)
    assert same("e", "е") and same("ﬁ", "fi") and same("Ａ", "Α") and same(" ", "　") and same("V", "Ѵ") and same("v", "ѵ")
    assert not same("a", "A") and not same("0", "O") and not same("1", "l") and not same(".", ",")


def test_marks_in_any_order_syllables_and_far_letters():
    form = Rewriter({m: min(v, key=lambda x: (not x.isascii(), len(x), x)) for v in look_alike_classes().values() for m in v})
    alike = [("a\u0323\u0302", "a\u0302\u0323"), ("가", "\u1100\u1161"), ("V", "\u0474"), ("é", "\u0435\u0301"), ("ế", "\u0435\u0302\u0301"), ("x\u0302", "\u0445\u0302"), ("e\u0316\u0301", "\u0435\u0301\u0316"), ("\U0001109a", "\U00011099\U000110ba"), ("й", "и\u0306"), ("ﬃ", "ffi"), ("ガ", "ｶﾞ")]
    for a, b in alike:
        assert form(a) == form(b) and form(form(a)) == form(a), (a, b)
    for a, b in [("e", "é"), ("a", "A"), ("ё", "е"), ("n", "ñ"), ("и", "й")]:
        assert form(a) != form(b)


TEXTS = [(1, "Café sheet"), (2, "Café sheet"), (3, "С​afé sheet"), (4, "Cafe sheet"), (5, "café sheet"), (6, "Café sheet"), (7, None), (8, ""), (9, "​"), (10, "Café sheet."), (11, "ｃａｆé sheet"), (12, "ﬁne"), (13, "fine"), (14, "x" * 100_000 + "é"), (15, "x" * 100_000 + "é"), (None, "fine")]


def test_pairs(spark):
    df = spark.createDataFrame(TEXTS, "doc bigint, form string").selectExpr("doc", "form", "'a' as raw")
    got = {tuple(x) for x in look_alike_pairs(df, "doc", "form").collect()}
    assert got == {(1, 2), (1, 3), (2, 3), (2, 6), (3, 6), (5, 11), (12, 13), (14, 15), (8, 9)}
    assert look_alike_pairs(df.limit(0), "doc", "form").count() == 0


def test_copies_are_members(spark):
    rows = [(i, "Café") for i in range(40)] + [(100 + i, "Cafe\u0301") for i in range(30)] + [(200, "Cafe"), (200, "Cafe")]
    df = spark.createDataFrame(rows, "doc bigint, form string")
    got = {x["doc"]: (x["same"], x["group"], x["texts"]) for x in look_alike_groups(df, "doc", "form").collect()}
    assert got == {i: (0, 0, 2) for i in range(40)} | {100 + i: (100, 0, 2) for i in range(30)}
    assert look_alike_pairs(df, "doc", "form").count() == 1_200


def test_forms_are_stable_and_frequent(spark):
    df = spark.createDataFrame(TEXTS, "doc bigint, form string")
    reps = representatives(df, "form")
    form = Rewriter(reps)
    for _, t in TEXTS:
        if t is not None:
            assert form(form(t)) == form(t)
    assert form("ｃａｆé") == "café" and form("Привет, мир: 12") == form(form("Привет, мир: 12"))
    rows = {r["doc"]: r["form"] for r in canonical_texts(df, "doc", "form").collect() if r["doc"]}
    assert rows[7] is None and rows[8] == "" and rows[3] == "Café sheet"
    # where the Cyrillic letter is the more frequent one, it stands for the class
    cyr = representatives(spark.createDataFrame([(1, "ссссс c")], "doc bigint, form string"), "form")
    assert Rewriter(cyr)("c") == "с"
