import random
from collections import Counter

from loamwork.llm.termfreq import mark_terms, term_frequencies


def brute(rows, fields):
    n, ids = Counter(), {}
    for r in rows:
        for f in fields:
            v = r[f]
            t = v.strip(" ").lower() if v is not None else ""
            if t:
                n[(f, t)] += 1
                ids.setdefault((f, t), set()).add(r["id"])
    return {(f, t, n[(f, t)], len(ids[(f, t)] - {None})) for f, t in n}


def test_splits_hot_terms_exactly(spark):
    r = random.Random(4)
    rows = [{"id": r.choice([None, *map(str, range(900))]), "term": r.choice(["Hot", " hot ", "hot", f"t{r.randrange(60)}", "", "  ", None]), "h": r.choice(["x", "y"])} for _ in range(3_000)]
    df = spark.createDataFrame([(x["id"], x["term"], x["h"]) for x in rows], "id string, term string, h string")
    for kw in ({}, {"task_rows": 100, "part_rows": 20, "radix_bits": 3}):
        got = {tuple(x) for x in term_frequencies(df, "id", ["term", "h"], **kw).collect()}
        assert got == brute(rows, ["term", "h"])


def test_marks_and_empty(spark):
    df = spark.createDataFrame([(str(i), "all" if i < 90 else "few" if i < 92 else "mid") for i in range(100)], "id string, c string")
    got = {(x["term"], x["mark"]) for x in mark_terms(term_frequencies(df, "id", ["c"]), 100).collect()}
    assert got == {("all", "common"), ("few", "rare"), ("mid", None)}
    assert term_frequencies(df.limit(0), "id", ["c"]).count() == 0


def test_no_folder_to_spill_to_is_an_error(monkeypatch):
    import pytest

    from loamwork.llm import termfreq

    monkeypatch.delenv("SPARK_LOCAL_DIRS", raising=False)
    with pytest.raises(RuntimeError, match="no folder"):
        list(termfreq._aggregate(None, 10, "64MB")(iter([])))
