import random

from pyspark.sql import functions as F

from loamwork.llm import nearcopies as N


def data(seed=6):
    r = random.Random(seed)
    vocab = [f"w{i}" for i in range(400)]
    rows, i = [], 0
    for _ in range(60):
        base = r.sample(vocab, r.choice([1, 3, 8, 30, 60, 150]))
        for _ in range(r.choice([1, 2, 4])):
            w = list(base)
            for _ in range(r.choice([0, 0, 1, 3, 6])):
                w[r.randrange(len(w))] = r.choice(vocab)
            rows.append((f"d{i:04d}", sorted(set(w))))
            i += 1
    return rows


def brute(rows, t):
    s = [(i, frozenset(w)) for i, w in rows]
    return {(a, b) for a, x in s for b, y in s if a < b and len(x & y) >= t * len(x | y)}


def test_all_links(spark):
    rows = data()
    df = spark.createDataFrame(rows + [("n1", None), ("n2", []), (None, ["w1"])], "id string, w array<string>")
    for t in (0.7, 0.9):
        expect = brute(rows, t)
        links, members = N.similar_sets(df, "id", "w", t)
        rep = {r["id"]: r["set"] for r in members.collect()}
        got = {(r["set_a"], r["set_b"]) for r in links.collect()}
        got = {tuple(sorted(p)) for p in got}
        assert got == {tuple(sorted((rep[a], rep[b]))) for a, b in expect if rep[a] != rep[b]}
        assert {i for i, _ in rows} == set(rep)


def test_crowded_roots_and_tiles_give_the_same(spark, monkeypatch):
    rows = data(8) + [(f"e{i:03d}", sorted({"a", "b", "c", "d", f"x{i % 40}"})) for i in range(120)] + [(f"f{i}", ["a", "b", "c", "d"][: i % 4 + 1]) for i in range(8)]
    df = spark.createDataFrame(rows, "id string, w array<string>")
    plain = {tuple(r) for r in N.near_copy_pairs(df, "id", "w", 0.7).collect()}
    least = {}
    for i, w in sorted(rows):
        least.setdefault(tuple(w), i)
    sets = [(i, list(w)) for w, i in least.items()]
    assert plain == brute(sets, 0.7) | {(least[tuple(w)], i) for i, w in rows if least[tuple(w)] != i}
    for depth in (1, 3, 6):  # roots descended, and cut into tiles at the last depth
        monkeypatch.setattr(N, "CROWD", 2)
        monkeypatch.setattr(N, "DEPTH", depth)
        assert {tuple(r) for r in N.near_copy_pairs(df, "id", "w", 0.7).collect()} == plain
        monkeypatch.undo()


def test_trie_join_alone():
    import numpy as np
    import pyarrow as pa

    rng = np.random.default_rng(3)
    base = rng.integers(0, 1 << 62, 12, dtype=np.int64)
    s = np.concatenate([base, base ^ (1 << rng.integers(0, 60, 12)), rng.integers(0, 1 << 62, 300, dtype=np.int64)])
    n = len(s)
    key, differ, size = rng.integers(0, 3, n), rng.integers(0, 4, n).astype(np.int32), np.full(n, 40, np.int32)
    key[12:24], key[:12] = key[:12], key[:12]
    table = pa.table({"key": key, "tile": np.zeros(n, np.int32), "rid": np.arange(n), "size": size, "differ": differ, "s0": s})
    got = {tuple(map(int, p)) for p in zip(*N._join(0.7, 1)(table).to_pydict().values(), strict=True)}
    bits = lambda i, j: int(differ[i] + differ[j]) + (int(s[i]) ^ int(s[j])).bit_count()
    assert got == {(i, j) for i in range(n) for j in range(i + 1, n) if key[i] == key[j] and bits(i, j) <= int(0.3 / 1.7 * 80)}


def test_copies_are_members_of_one_set(spark):
    df = spark.createDataFrame([(f"c{i:03d}", ["a", "b", "c"]) for i in range(200)] + [("z", ["a", "b", "c", "d"]), ("q", ["x"])], "id string, w array<string>")
    pairs = {tuple(r) for r in N.near_copy_pairs(df, "id", "w", 0.7).collect()}
    assert pairs == {("c000", f"c{i:03d}") for i in range(1, 200)} | {("c000", "z")}
    groups = {r["id"]: (r["group"], r["links"]) for r in N.near_copy_groups(df, "id", "w", 0.7).collect()}
    assert groups["z"] == ("c000", 1) and groups["c000"] == ("c000", 200) and groups["q"] == ("q", 0) and len(groups) == 202


def test_words_and_empty(spark):
    df = spark.createDataFrame([("a", "Héllo WORLD, hello-2", "p/q.MD"), ("b", None, None)], "id string, d string, p string")
    got = {r["id"]: r["w"] for r in df.select("id", N.word_set(F.col("d"), F.col("p")).alias("w")).collect()}
    assert got == {"a": ["2", "h", "hello", "llo", "md", "p", "q", "world"], "b": []}
    assert N.near_copy_pairs(spark.createDataFrame([], "id string, w array<string>"), "id", "w", 0.7).count() == 0
