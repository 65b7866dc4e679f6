from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from loamwork.llm.topn import top_n_per_group


def brute(rows, n):
    best = {}
    for g, s, i in rows:
        if g is not None and s is not None and i is not None:
            best[(g, i)] = max(s, best.get((g, i), s))
    out = set()
    for g in {g for g, _ in best}:
        order = sorted(((-s, i.encode(), s, i) for (h, i), s in best.items() if h == g))
        out |= {(g, s, i) for _, _, s, i in order[:n]}
    return out


def run(spark, rows, n, **kw):
    df = spark.createDataFrame(rows, "grp string, stars bigint, id string, need string, n int" if rows and len(rows[0]) == 5 else "grp string, stars bigint, id string")
    return {tuple(r) for r in top_n_per_group(df, "grp", "stars", "id", n, **kw).collect()}


def test_ties_nulls_repeats_and_extremes(spark):
    big = (1 << 63) - 1
    rows = [("a", big, "x"), ("a", -big - 1, "y"), ("a", 0, "b"), ("a", 0, "a"), ("a", 0, "aa"), ("a", 0, ""), ("a", 0, "a\0"), ("a", 0, "a"), (None, 1, "q"), ("b", None, "q"), ("b", 1, None), ("c", 5, "long" * 200), ("c", 5, "long" * 200 + "a"), ("c", 5, "ü")]
    for n in (1, 3, 10):
        assert run(spark, rows, n) == brute(rows, n)


def test_clashing_columns_empty_and_zero(spark):
    assert run(spark, [("a", 1, "x", "text", 4), ("a", 2, "y", None, None)], 1) == {("a", 2, "y")}
    assert run(spark, [], 3) == set()
    assert run(spark, [("a", 1, "x")], 0) == set()


def test_integer_identifiers(spark):
    df = spark.createDataFrame([("a", 1, i) for i in (5, -7, 1 << 40, 3)], "grp string, stars int, id bigint")
    assert {r["id"] for r in top_n_per_group(df, "grp", "stars", "id", 2).collect()} == {-7, 3}


@settings(max_examples=4, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.sampled_from(["a", "b", "c"]), st.integers(-3, 3), st.text("abé", max_size=9)), min_size=1, max_size=40), st.integers(1, 4))
def test_matches_sorting(spark, rows, n):
    assert run(spark, rows, n, bits=2) == brute(rows, n)
