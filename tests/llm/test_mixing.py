import numpy as np
import pandas as pd

from loamwork.llm.mixing import _pivot, mixture, mixture_report, token_counts


def sizes(spark, n=900):
    r = np.random.default_rng(2)
    rows = [(i, "abc"[min(2, int(i % 10 / 4))], int(r.integers(1, 400))) for i in range(n)] + [(n, "a", 0), (n + 1, "other", 50)]
    return spark.createDataFrame(rows, "id bigint, source string, tokens bigint")


def test_shares_caps_and_determinism(spark):
    t = spark.createDataFrame([("A ", 0.5, 2), ("b", 0.3, 1), ("c", 0.1, 4), ("gone", 0.1, 2), (None, 0.2, 1)], "source string, target_share double, max_repeats bigint")
    df = sizes(spark)
    for bucket in (20_000, 40):
        used, todo = mixture(df, t, bucket_rows=bucket, fan_in=2)
        report = {r["source"]: r for r in mixture_report(used, todo).collect()}
        largest = 400 / sum(r["used_tokens"] for r in report.values())
        for s, want in (("a", 5 / 9), ("b", 3 / 9), ("c", 1 / 9)):
            assert abs(report[s]["actual_share"] - want) <= 2 * largest and report[s]["most_copies"] <= report[s]["max_repeats"]
        assert report["gone"]["used_tokens"] == 0
        again, _ = mixture(df, t, bucket_rows=bucket, fan_in=2)
        assert {tuple(r) for r in used.collect()} == {tuple(r) for r in again.collect()}
        assert used.filter("source = 'other' or tokens = 0").count() == 0
    empty, _ = mixture(df.limit(0), t)
    assert empty.count() == 0


def test_rounding_keeps_tokens_and_expectation():
    n, hits = 30, np.zeros(30)
    w = np.arange(1, n + 1) * 7
    for seed in range(1_500):
        out = _pivot(pd.DataFrame({"id": np.arange(n), "tokens": w, "p": np.full(n, 0.3)}), seed)
        loose = ((out["p"] > 0) & (out["p"] < 1)).sum()
        assert loose <= 1 and abs((out["p"] * w).sum() - 0.3 * w.sum()) < 1e-6
        hits += out["p"].to_numpy()
    assert np.abs(hits / 1_500 - 0.3).max() < 0.06


def test_tokens_of_whole_texts(spark):
    df = spark.createDataFrame([(1, "hello world", "S"), (2, "", "s"), (3, None, "s"), (4, "x", " "), (5, "<|endoftext|> " * 9_000, "s"), (6, "x", None)], "id bigint, t string, source string")
    got = {r["id"]: (r["source"], r["tokens"]) for r in token_counts(df, "id", "t", "source").collect()}
    assert got[1] == ("s", 2) and got[2] == ("s", 0) and got[5][1] > 9_000 and set(got) == {1, 2, 5}
