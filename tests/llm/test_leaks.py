import random

import pytest

from loamwork.llm.leaks import bands, find_leaks, words


def brute(docs, items, p=12):
    out = set()
    for i, t in items:
        w = words(t or "")
        n = min(p, len(w))
        grams = {tuple(w[k : k + n]) for k in range(len(w) - n + 1)} if n else set()
        for d, u in docs:
            x = words(u or "")
            if any(tuple(x[k : k + n]) in grams for k in range(len(x) - n + 1)):
                out.add((d, i))
    return out


def test_matches_exact_search(spark):
    r = random.Random(3)
    vocab = [f"w{i}" for i in range(60)]
    items = [(i, " ".join(r.choices(vocab, k=r.choice([1, 3, 4, 5, 11, 12, 13, 30])))) for i in range(40)] + [(90, None), (91, ""), (92, "--")]
    docs = []
    for d in range(150):
        w = r.choices(vocab, k=r.choice([0, 5, 20, 200]))
        for _ in range(r.choice([0, 1, 2])):
            x = (r.choice(items)[1] or "").split()
            a = r.randrange(len(x) + 1)
            at = r.randrange(len(w) + 1)
            w[at:at] = [s.upper() for s in x[a : a + r.choice([11, 12, 14, 40])]]
        docs.append((d, ", ".join(w)))
    docs += [(900, None), (901, ""), (902, "W1 " * 50_000 + (items[7][1] or ""))]
    df = spark.createDataFrame(docs, "d bigint, t string").selectExpr("d", "t", "'x' as item")
    it = spark.createDataFrame(items, "i bigint, t string")
    expect = brute(docs, items)
    assert {tuple(x) for x in find_leaks(df, "d", "t", it, "i", "t").collect()} == expect and len(expect) > 50
    assert {tuple(x) for x in find_leaks(df, "d", "t", it, "i", "t", block=40).collect()} == expect
    assert find_leaks(df, "d", "t", it.limit(0), "i", "t").count() == 0
    assert find_leaks(df.limit(0), "d", "t", it, "i", "t").count() == 0


def test_larger_windows_need_more_values():
    assert bands(8, 8) == 1 and bands(8, 20) > bands(8, 12) > 1


def test_too_many_hashes_are_an_error_and_not_a_lower_recall():
    assert bands(8, 20) < 100
    with pytest.raises(ValueError, match="MinHash values are needed"):
        bands(1, 5_000)
