import random

from loamwork.llm import subjects as S

AREAS = {"music": "choir violin chord tempo album".split(), "law": "court clause judge appeal patent".split(), "food": "oven flour stew spice dough".split(), "sport": "coach sprint league goal rowing".split(), "money": "loan broker equity audit payroll".split(), "health": "nurse ward allergy dosage vaccine".split(), "code": "linter compiler daemon monorepo endpoint".split(), "stars": "galaxy telescope orbit comet nebula".split()}
VERBS, NOUNS = "help turn rank parse fold".split(), "draft note branch panel memo sheet".split()


def text(r, mains, passing=None):
    cl = [f"{r.choice(VERBS)} the {w} {r.choice(NOUNS)}" for m in mains for w in r.sample(AREAS[m], 3)]
    cl += [f"{r.choice(VERBS)} one {r.choice(NOUNS)} first"]
    if passing:
        cl.append(f"keep the {r.choice(AREAS[passing])} {r.choice(NOUNS)} out of it")
    r.shuffle(cl)
    return ". ".join(c.capitalize() for c in cl) + "."


def test_held_out_accuracy(spark):
    r = random.Random(5)
    names = list(AREAS)
    ex = [(s, text(r, [s], r.choice([None, *[n for n in names if n != s]]))) for s in names for _ in range(15)]
    docs, truth = [], {}
    for i in range(600):
        mains = r.sample(names, r.choice([0, 1, 1, 2]))
        other = r.choice([None, *[n for n in names if n not in mains]])
        docs.append((f"d{i}", r.choice([f"about-{m}" for m in mains] or ["general"]), text(r, mains, other)))
        truth[f"d{i}"] = set(mains)
    docs += [("x1", "about-law", None), ("x2", "general", None), ("x3", "Music ", " "), ("x4", None, None), (None, "about-law", "court"), ("d0", docs[0][1], docs[0][2])]
    sp = spark.createDataFrame(docs, "id string, category string, text string")
    e = spark.createDataFrame(ex + [(None, "x"), ("law", None)], "subject string, text string")
    a = spark.createDataFrame([(n, " ".join(w)) for n, w in AREAS.items()] + [("music", None)], "subject string, scope_note string")
    got = {}
    for row in S.subject_rows(sp, "id", "text", "category", e, a).collect():
        got.setdefault(row["id"], set()).add(row["subject"])
    named = {"about-law": "law"}
    good = sum(got.get(i, set()) == t for i, t in truth.items() if t)
    assert good >= 0.97 * sum(1 for t in truth.values() if t)
    assert got["x1"] == {"law"} and "x2" not in got and got["x3"] == {"music"} and "x4" not in got and None not in got and named
    assert S.subject_rows(sp.limit(0), "id", "text", "category", e, a).count() == 0


def test_clauses():
    assert S.clauses("One two. Three, then four; five v1.2 six") == [["one", "two"], ["three"], ["four"], ["five", "v1", "2", "six"]]


def test_each_subject_has_its_margin():
    import numpy as np

    m = S.SubjectModel(["a", "b"], {"x": np.array([2.0, 0.0]), "y": np.array([0.0, 2.0])}, {}, np.array([1.0, 3.0]))
    assert m.about("x. x one. y. y two") == ["a"]
    m.margin = 1.0
    assert m.about("x. x one. y. y two") == ["a", "b"] and m.about(None) == []


def test_a_sample_of_the_labelled_rows_keeps_every_subject(spark):
    r = random.Random(9)
    ex = spark.createDataFrame([(s, text(r, [s])) for s in AREAS for _ in range(40)], "subject string, text string")
    texts = spark.createDataFrame([(text(r, [s]),) for s in AREAS for _ in range(10)], "text string")
    a = spark.createDataFrame([(n, " ".join(w)) for n, w in AREAS.items()], "subject string, scope_note string")
    m = S.train(texts, ex, a, labelled=160, rounds=0)
    assert sum(s in m.about(t) for s in AREAS for t in [text(r, [s])]) >= 7
