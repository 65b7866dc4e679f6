import random

from loamwork.llm.components import connected_components
from loamwork.llm.conversations import chained_reply_pairs, message_links, neighbours, rebuild_conversations, session_reply_pairs


def test_components_match_union_find(spark):
    r = random.Random(1)
    edges = [(r.randrange(300), r.randrange(300)) for _ in range(170)] + [(1000 + i, 1001 + i) for i in range(25)] + [(5, 5), (7, None), (None, 8)]
    up = {}

    def root(x):
        up.setdefault(x, x)
        while up[x] != x:
            x = up[x]
        return x

    for a, b in edges:
        if a is not None and b is not None and a != b:
            a, b = root(a), root(b)
            up[max(a, b)] = min(a, b)
    got = {(x["node"], x["component"]) for x in connected_components(spark.createDataFrame(edges, "a bigint, b bigint"), "a", "b").collect()}
    assert got == {(x, root(x)) for x in up}
    assert connected_components(spark.createDataFrame([], "a bigint, b bigint"), "a", "b").count() == 0


def brute(rows, comp):
    out, by = set(), {}
    for i, at, who in rows:
        by.setdefault(comp[i], []).append((at, who, i))
    for ms in by.values():
        if any(at is None or who is None for at, who, _ in ms):
            continue
        ms.sort()
        if len(ms) % 2 == 0 and all(w == k % 2 for k, (_, w, _) in enumerate(ms)):
            out |= {(ms[k][2], ms[k + 1][2]) for k in range(0, len(ms), 2)}
    return out


def test_reply_chains_without_identifier_and_long_conversations(spark):
    r = random.Random(2)
    rows, links, comp, i = [], [], {}, 0
    for c, size in enumerate([14, 15, 2, 3, 1, 22, 8, 30]):
        prev, bad = None, c in (5,)
        for k in range(size):
            i += 1
            rows.append((i, None if bad and k == 9 else 1_000 * k + c, k % 2 if not (c == 6 and k == 4) else 1))
            comp[i] = c
            links.append((i, i if prev is None else prev))
            prev = i
    r.shuffle(rows)
    m = spark.createDataFrame(rows, "id bigint, at bigint, who int")
    lk = spark.createDataFrame(links, "a bigint, b bigint")
    got = {(x["user_id"], x["assistant_id"]) for x in rebuild_conversations(m, lk).collect()}
    assert got == brute(rows, comp)


def test_ranges_cut_through_conversations(spark):
    """One conversation holds nearly all rows; the ranges of the sort divide it evenly and lose no pair."""
    rows = [(i, 1_000 * i, i % 2) for i in range(4_000)] + [(10_000 + i, 5, i) for i in range(2)] + [(20_000 + i, 7 * i, i % 2) for i in range(3)]
    comp = {i: 0 if i < 4_000 else 1 if i < 20_000 else 2 for i, _, _ in rows}
    m = spark.createDataFrame(rows, "id bigint, at bigint, who int").repartition(7)
    lk = spark.createDataFrame([(i, -comp[i] - 1) for i, _, _ in rows], "a bigint, b bigint")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        met = neighbours(m.selectExpr("id", "at", "who", "cast(if(id < 4000, 0, if(id < 20000, 1, 2)) as bigint) as comp"))
        order = sorted(rows, key=lambda r: (comp[r[0]], r[1], r[2], r[0]))
        assert {(x["id"], x["next_id"]) for x in met.collect()} == {(a[0], b[0] if b else None) for a, b in zip(order, [*order[1:], None], strict=True)}
        got = {(x["user_id"], x["assistant_id"]) for x in rebuild_conversations(m, lk).collect()}
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert got == brute(rows, comp) and len(got) == 2_001


def test_links_from_replies_and_quotes(spark):
    m = spark.createDataFrame([(1, "c", None, None), (2, None, 1, None), (3, None, None, [2, None])], "id bigint, conv string, reply bigint, quotes array<bigint>")
    parts = connected_components(message_links(m, "id", "conv", "reply", "quotes"), "a", "b").filter("node > 0")
    assert {x["component"] for x in parts.collect()} == {parts.first()["component"]} and parts.count() == 3


def entry(i, kind, ts, session, role, content="hello"):
    return (i, kind, ts, session, role, content, "extra")


def test_session_log(spark):
    rows = [
        entry(1, "user", "2025-01-01T10:00:00Z", "s", None), entry(1, "user", "2025-01-01T10:00:00Z", "s", None), entry(2, "assistant", "2025-01-01 11:00:01+01:00", "s", " AI "),
        entry(3, "queue-operation", "soon", "s", None), entry(4, "user", "x", "s", "user", " \n "), entry(5, None, "2025-01-01T10:00:00Z", None, "user"),
        entry(6, "user", "2025-01-01T10:00:00Z", "t", "human"), entry(7, "user", "2025-01-01T10:00:01Z", "t", "?"), entry(None, "user", "2025-01-01T10:00:00Z", "u", "user"),
        entry(8, "user", "yesterday 10:40", "v", "user"), entry(9, "assistant", "2025-01-01T10:00:01Z", "v", "assistant"),
    ]
    df = spark.createDataFrame(rows, "entry_id bigint, type string, timestamp string, session_id string, role string, content string, comp string")
    assert [tuple(x) for x in session_reply_pairs(df).collect()] == [("s", 1, 2)]
    assert session_reply_pairs(df.limit(0)).count() == 0
    assert [tuple(x) for x in chained_reply_pairs(df).collect()] == [(1, 2)]
    assert chained_reply_pairs(df.limit(0)).count() == 0


def test_identifiers_that_share_a_node_get_another_salt(spark, monkeypatch):
    from pyspark.sql import functions as F

    from loamwork.llm import conversations as C

    real = C.conversation_node
    monkeypatch.setattr(C, "conversation_node", lambda key, salt=0: F.lit(-1).cast("long") if salt == 0 else real(key, salt))
    got = C.conversation_nodes(spark.createDataFrame([("a",), ("b",), ("a",)], "k string"), "k").collect()
    assert len(got) == 2 and len({r["node"] for r in got}) == 2
