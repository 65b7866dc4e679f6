import json
import os
import random

import pytest
from pyspark.sql import functions as F

from loamwork import queries
from loamwork.functions import dates, text, versions
from loamwork.operators import aggregates as agg
from loamwork.operators import filters, joins, search, sets, windows
from loamwork.plans.durable import cut
from loamwork.plans.skew import hot_keys, skew_join
from loamwork.sources import files
from loamwork.streaming import metrics


def one(spark, value, f, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(f(F.col("x")).alias("y")).first()["y"]


def test_skew_join_is_a_join(spark):
    big = spark.createDataFrame([(1 if i % 2 else i, i) for i in range(2_000)], "k int, v int")
    small = spark.createDataFrame([(i, str(i)) for i in range(0, 2_000, 3)] + [(1, "one")], "k int, s string")
    hot = hot_keys(big, ["k"], floor=100)
    assert hot == [(1,)]
    for how in ("inner", "left"):
        assert {tuple(r) for r in skew_join(big, small, "k", how, hot).collect()} == {tuple(r) for r in big.join(small, "k", how).select("k", "v", "s").collect()}


def test_cut_keeps_rows_and_empty_tables(spark):
    df = spark.createDataFrame([(1, None, [1, 2]), (None, "x", None)], "a int, b string, c array<int>")
    assert {str(r) for r in cut(df).collect()} == {str(r) for r in df.collect()}
    assert cut(df.limit(0)).count() == 0 and cut(df.filter("a > 5")).columns == ["a", "b", "c"]


@pytest.mark.parametrize(("raw", "want"), [("Hello, World!", "hello world"), ("  a__b\t c-d ", "a__b c d"), ("", ""), (None, None), ("Ärger, ñ!", "ärger ñ")])
def test_normalize(spark, raw, want):
    assert one(spark, raw, text.normalize_text) == want


def test_grams_and_jaccard(spark):
    assert one(spark, "ab", lambda c: text.char_ngrams(c, 3)) == ["ab"] and one(spark, "", lambda c: text.char_ngrams(c, 3)) == [""]
    assert set(one(spark, "hello", lambda c: text.char_ngrams(c, 3))) == {"hel", "ell", "llo"}
    rows = [(["a"], ["a"]), (["a"], ["b"]), (["a", "b", "c"], ["b", "c", "d"]), ([], [])]
    got = [r["j"] for r in spark.createDataFrame(rows, "a array<string>, b array<string>").select(sets.jaccard(F.col("a"), F.col("b")).alias("j")).collect()]
    assert got == [1.0, 0.0, 0.5, 0.0]


def test_near_duplicates(spark):
    df = spark.createDataFrame([("R1", "Best practices for skills", 90), ("R2", "Best practices for skills guide", 50), ("R3", "something else", 1), ("E1", "", 5), ("E2", "", 5), ("R4", "Best practices for skills", 90)], "id string, title string, score int")
    assert {r["id"] for r in sets.drop_near_duplicates(df, "id", "title", "score", 0.6).collect()} == {"R1", "R3", "E1"}


def test_near_duplicates_like_all_pairs(spark):
    """Against all pairs, at thresholds with sizes far apart and with scores that don't follow the length."""
    rnd = random.Random(5)
    word = lambda: "".join(rnd.choices("abc", k=rnd.randint(1, 4)))
    rows = [(f"i{k}", rnd.choice(["alpha beta ", "alpha ", "x", ""]) + " ".join(word() for _ in range(rnd.randint(0, 4))), rnd.randint(1, 6)) for k in range(300)]
    df = spark.createDataFrame([*rows, ("none", None, 1)], "id string, t string, s int")
    grams = {r["id"]: frozenset(r["g"]) for r in df.filter("t is not null").select("id", text.char_ngrams(F.col("t"), 3).alias("g")).collect()}
    alike = lambda a, b: len(grams[a] & grams[b]) / len(grams[a] | grams[b])
    for limit in (0.3, 0.7, 1.0):
        kept = {a for a, _, s in rows if not any(alike(a, b) >= limit and (z > s or (z == s and b < a)) for b, _, z in rows if b != a)}
        assert {r["id"] for r in sets.drop_near_duplicates(df, "id", "t", "s", limit).collect()} == kept | {"none"}
        near, members = (x.collect() for x in sets.similar_pairs(df, "id", "t", limit))
        reps = sorted({r["rep"] for r in members})
        assert {r["id"] for r in members} == set(grams) and all(r["rep"] == min(k for k in grams if grams[k] == grams[r["id"]]) for r in members)
        assert {(r["a"], r["b"], r["similarity"]) for r in near} == {(a, b, alike(a, b)) for a in reps for b in reps if a < b and alike(a, b) >= limit}


def test_near_duplicates_write_little(spark):
    """Names of few words with a random end: each has hundreds of candidates by its words, none of which may be written."""
    rnd = random.Random(6)
    words = [["amber", "cobalt", "indigo"], ["transcript", "scratchpad", "checklist"], ["tracker", "watcher", "builder"]]
    names = {"-".join([*map(rnd.choice, words), "".join(rnd.choices("abcdefghijklmnopqrstuvwxyz", k=5))]) for _ in range(3000)}
    df = spark.createDataFrame([(n, len(n)) for n in sorted(names)], "id string, s int")
    written = lambda: spark._jsc.sc().statusStore().executorSummary("driver").totalShuffleWrite()
    before = written()
    sets.drop_near_duplicates(df, "id", "id", "s", 0.7).write.format("noop").mode("overwrite").save()
    assert written() - before < 10_000_000


def test_distinct_names_scores_normalised_names(spark, tmp_path):
    """The score is the length of the normalised name, as in the SQL."""
    spark.createDataFrame([("abcdefgh--",), ("abcdefghi",), ("other--name",), ("other-name",), (None,)], "id string").write.parquet(str(tmp_path / "skill.parquet"))
    assert {r["id"] for r in queries.distinct_names(spark, str(tmp_path)).collect()} == {"abcdefghi", "other--name", None}


def test_dates(spark):
    assert str(one(spark, "1768435200", dates.parse_date)) == "2026-01-15 00:00:00" and one(spark, "soon", dates.parse_date) is None and one(spark, None, dates.parse_date) is None
    assert str(one(spark, "2026-01-15T10:00:00+05:00", dates.parse_date)) == "2026-01-15 10:00:00"
    assert [one(spark, a, dates.recency, "int") for a in (0, 15, 30, None, -3)] == [100, 50, 0, 0, 100]
    assert [one(spark, d, lambda c: dates.date_confidence(c, "2026-01-01", "2026-01-31")) for d in ("2026-01-31", "2025-12-31", None)] == ["high", "low", "low"]


def test_text_functions(spark):
    assert one(spark, "A  Fine--Title!", text.slugify) == "a-fine-title"
    assert one(spark, "Ünïted  Çafé-Bar", text.fold_accents) == "united cafe bar"
    assert one(spark, "<i>a &amp; b</i>\n c", text.caption_text) == "a & b c"
    assert one(spark, "x" * 300, text.short_description) == "x" * 197 + "..." and one(spark, "x" * 200, text.short_description) == "x" * 200
    assert one(spark, "costs $1,200.50 and $5k/mo, $1 ```$9.99```", text.hide_amounts) == "costs the billed cost and the billed cost, $1 ```$9.99```"
    assert [one(spark, p, text.asset_path) for p in ("/a/b.md", "a/../b", "http://x/y", "a%2Fb", "a//b", "")] == ["a/b.md", None, None, None, None, None]
    assert [one(spark, p, text.is_safe_id) for p in ("game/design", "../x", "a/../b", None)] == [True, False, False, False]
    assert one(spark, '---\nname: "x"\nrisk: safe\nname: y\n---\nbody: no', text.front_matter) == {"name": "y", "risk": "safe"} and one(spark, "no", text.front_matter) == {}
    assert [tuple(r) for r in one(spark, "pre\n## A\none\n## B\ntwo\nx", text.sections)] == [("A", "one"), ("B", "two\nx")]
    assert one(spark, "# t\nkeep\n_Generated by x_", text.clean_lines) == "keep"
    assert one(spark, "@a/b then @c and @a/b", text.mentions) == ["a/b", "c"]
    assert one(spark, "https://www.A.com/x/y?z=1", text.host_of) == "a.com" and one(spark, "https://a.com/x/y/", text.path_depth) == 2 and one(spark, "no url", text.host_of) is None
    assert one(spark, "a|b\nc", text.escape_cell) == "a\\|b c" and one(spark, "a.b*", text.escape_regex) == "a\\.b\\*"


def test_versions(spark):
    assert one(spark, "v3.10", versions.version) == [3, 10, 0] and one(spark, "x", versions.version) is None


def test_buckets_and_classes(spark):
    df = spark.createDataFrame([(249.99,), (250.0,), (999.99,), (1000.0,), (None,)], "v double")
    assert {r["bucket"]: r["n"] for r in agg.bucket_counts(df, "v", [250, 1000], ["lt", "mid", "gt"]).collect()} == {"lt": 1, "mid": 2, "gt": 1}
    assert [one(spark, v, lambda c: agg.classify_metric(c, 60, 85), "double") for v in (60.0, 85.0, 85.1, None)] == ["ok", "warning", "critical", None]
    assert [one(spark, v, lambda c: agg.classify_metric(c, critical_below=10, warning_below=15), "double") for v in (9.9, 10.0, 15.0)] == ["critical", "warning", "ok"]
    assert one(spark, -2.5, agg.round_half_up, "double") == -2
    e = spark.createDataFrame([("a", "500", 2), ("a", "200", None), ("b", "200", 5), (None, "500", 1), ("c", "503", 0)], "k string, s string, w int")
    assert {r["k"]: (r["errors"], r["total"], r["error_rate"]) for r in agg.error_counts(e, "k", F.col("s"), F.col("w")).collect()} == {"a": (2, 2, 1.0), "c": (0, 0, None)}


def test_rules(spark):
    rules = [("error", "a", F.col("x") > 1), ("warning", "b", F.col("x") > 5)]
    got = [[tuple(y) for y in one(spark, v, lambda c: filters.failures(rules, strict=True), "int")] for v in (9, 3, None)]
    assert got == [[], [("error", "b")], [("error", "a"), ("error", "b")]]
    tiers = [("hi", [("pentest", "p")]), ("mid", [(r"rm -rf", "r")])]
    assert tuple(one(spark, "pentest and rm -rf", lambda c: filters.first_tier(c, tiers))) == ("hi", ["p"]) and tuple(one(spark, "x", lambda c: filters.first_tier(c, tiers))) == ("none", [])
    docs = spark.createDataFrame([(1, "never\n```\nnever\n```\nNever x"), (2, None), (3, "")], "id int, t string")
    assert {tuple(r) for r in filters.pattern_findings(docs, "id", "t", {"n": "(?i)never"}).collect()} == {(1, 1, "n"), (1, 5, "n")}
    assert [tuple(r) for r in filters.matches_with_lines(docs, "id", "t", "ever").collect()] == [(1, 1, "ever"), (1, 3, "ever"), (1, 5, "ever")]
    gap = spark.createDataFrame([(1, "set\n\n\nok"), (2, "set\n\n\n\nok"), (3, "ok\nset"), (4, None)], "id int, t string")
    assert {tuple(r) for r in filters.context_gap(gap, "id", "t", "set", "ok", 1, 3).collect()} == {(2, 1)}


def test_bundles(spark):
    b = spark.createDataFrame([("essentials", "Essentials Pack", ["safe-skill", "unsafe&calc", "safe_two"]), ("x-y", "Other", ["z"])], "id string, name string, skills array<string>")
    safe = F.col("id").rlike(r"^[A-Za-z0-9._-]+$")
    assert {r["id"] for r in filters.bundle_members(b, ["Essentials", "X Y", "lonely", "../no"], safe).collect()} == {"safe-skill", "safe_two", "z", "lonely"}
    p = spark.createDataFrame([("skills/a/SKILL.md",), ("README.md",), ("plugins/e/SKILL.md",), ("SKILL.md",)], "path string")
    assert {r["folder"] for r in filters.touched_folders(p).collect()} == {"skills/a", "plugins/e", "."}


def test_boxes_and_folds(spark):
    b = spark.createDataFrame([(1, 1, 0.0, 0.0, 10.0, 10.0), (2, 1, 5.0, 5.0, 50.0, 50.0), (3, 1, 10.0, 0.0, 12.0, 5.0), (4, 2, 5.0, 5.0, 6.0, 6.0), (5, 1, -9.0, -9.0, 90.0, 90.0)], "id int, page int, x0 double, y0 double, x1 double, y1 double")
    assert {(r["a"], r["b"]) for r in joins.overlapping_boxes(b).collect()} == {(1, 2), (1, 5), (2, 5), (3, 5)}
    c = spark.createDataFrame([("v", 1, "so we start"), ("v", 2, "we start with this"), ("v", 3, "with this"), ("v", 4, "one more")], "doc string, seq int, t string")
    assert windows.suffix_fold(c, "doc", "seq", "t").first()["text"] == "so we start with this one more"
    lines = spark.createDataFrame([(1, 1, "a"), (1, 2, "```"), (1, 3, "b"), (1, 4, "```"), (1, 5, "c")], "d int, n int, t string")
    assert [r["fenced"] for r in windows.fence_parity(lines, "d", "n", "t").orderBy("n").collect()] == [False, True, True, True, False]


def test_maps_and_search(spark):
    df = spark.createDataFrame([({"a": 1, "b": 2}, {"b": 5, "c": 6}), ({"a": 1}, None)], "o map<string,bigint>, n map<string,bigint>")
    assert [r["m"] for r in df.select(sets.merge_maps(F.col("o"), F.col("n")).alias("m")).collect()] == [{"a": 1, "b": 5, "c": 6}, {"a": 1}]
    d = spark.createDataFrame([(1, "red fox"), (2, "red red car in the long road"), (3, None), (4, "blue")], "id int, t string")
    assert [r["id"] for r in search.bm25(d, "id", "t", ["RED"]).collect()] == [1, 2] or search.bm25(d, "id", "t", ["RED"]).count() == 2
    assert search.bm25(d, "id", "t", []).count() == 0 and search.bm25(d.limit(0), "id", "t", ["red"]).count() == 0
    assert one(spark, "one two three four five", lambda c: search.snippet(c, "three", 3)) == "two >>>three<<< four"


def test_files(spark, tmp_path):
    for p, body in (("a/SKILL.md", "x"), ("b/c/SKILL.md", "y"), (".hid/SKILL.md", "no"), ("b/notes.md", "no")):
        (tmp_path / p).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / p).write_text(body)
    (tmp_path / "out").mkdir()
    os.symlink(tmp_path / "a/SKILL.md", tmp_path / "out/SKILL.md")
    assert {(r["id"], r["content"]) for r in files.read_documents(spark, str(tmp_path)).collect()} >= {("a", "x"), ("b/c", "y")}
    assert {os.path.relpath(p, tmp_path) for p in files.regular_files(str(tmp_path), "SKILL.md")} == {"a/SKILL.md", "b/c/SKILL.md"}
    assert files.inside(str(tmp_path / "a"), str(tmp_path)) and not files.inside(str(tmp_path / "../x"), str(tmp_path))
    (tmp_path / "m.json").write_text(json.dumps([{"id": "a", "n": 1}, {"id": "b"}]))
    (tmp_path / "bad.json").write_text("<html>")
    assert [tuple(r) for r in files.read_json_array(spark, str(tmp_path / "m.json"), "id: string, n: int").collect()] == [("a", 1), ("b", None)]
    got = files.first_valid([lambda: files.read_json_array(spark, str(tmp_path / "none.json"), "id: string", strict=True), lambda: files.read_json_array(spark, str(tmp_path / "bad.json"), "id: string", strict=True), lambda: files.read_json_array(spark, str(tmp_path / "m.json"), "id: string")])
    assert got.count() == 2
    log = str(tmp_path / "log")
    files.append_log(spark.createDataFrame([("x", 1)], "action string, n int"), log)
    files.append_log(spark.createDataFrame([("y", 2)], "action string, n int"), log)
    (tmp_path / "log/extra.json").write_text('{"action": "z", "n": 3}\n{broken\n')
    assert {r["action"] for r in files.read_log(spark, log, "action string, n int").collect()} == {"x", "y", "z"}
    md = spark.createDataFrame([("# t\n### \"One\"\n- [`a`](x)\n- [`b`](y)\ntext\n### Two\n- [`c`](z)",)], "t string")
    assert [tuple(r) for r in files.markdown_bundles(md, "t").collect()] == [("One", 0, "a"), ("One", 1, "b"), ("Two", 0, "c")]
    before, after = spark.createDataFrame([("a", "1"), ("b", None)], "id string, t string"), spark.createDataFrame([("a", "1"), ("b", "2"), ("c", "3")], "id string, t string")
    assert {r["id"] for r in files.changed_only(before, after, "id", "t").collect()} == {"b", "c"}


def test_markup(spark, tmp_path):
    pages = spark.createDataFrame([(1, "<table><tr><th>Full name</th><th>City</th></tr><tr><td>A &amp; B</td><td>X</td></tr></table>"), (2, "<ul><li>one</li></ul>"), (3, "<p>par</p>"), (4, None)], "id int, h string")
    got = {tuple(r) for r in files.html_records(pages, "id", "h", {"name": ["name"], "city": ["city", "town"]}).collect()}
    assert got == {(1, "table", "A & B", "X"), (2, "list", "one", None), (3, "paragraph", "par", None)}
    v = spark.createDataFrame([(1, "WEBVTT\n\n00:01.500 --> 00:02.000 align:start\n<c>hi</c>\nyou\n\n01:00:00.000 --> 01:00:01.000\nbye")], "id int, t string")
    assert [tuple(r)[2:] for r in files.vtt_cues(v, "id", "t").collect()] == [(1.5, 2.0, "<c>hi</c> you"), (3600.0, 3601.0, "bye")]
    q = spark.createDataFrame([("CREATE TABLE x.y AS SELECT * FROM a JOIN b.c ON 1=1",), ("insert into t select 1 from A",), ("select 1 from z",)], "q string")
    assert {tuple(r) for r in files.lineage_edges(q, "q").collect()} == {("x.y", "a"), ("x.y", "b.c"), ("t", "a")}
    (tmp_path / "t.xml").write_text("<r><row><a>1</a></row><row><a>2</a></row></r>")
    assert {r["a"] for r in files.read_xml_rows(spark, str(tmp_path / "t.xml"), "row", "a int").collect()} == {1, 2}


def test_streams(spark, tmp_path):
    src = tmp_path / "in"
    spark.createDataFrame([(1, "2024-01-01 00:10:00", "error"), (1, "2024-01-01 00:50:00", "view"), (1, "2024-01-01 03:00:00", "view")], "user_id int, t string, event_type string").selectExpr("user_id", "cast(t as timestamp_ntz) ts", "event_type").coalesce(1).write.parquet(str(src))
    schema = spark.read.parquet(str(src)).schema
    ev = lambda: metrics.event_stream(spark, str(src), schema, "*.parquet")
    got = metrics.run_once(metrics.windowed_rates(ev(), "user_id", F.col("event_type") == "error"), str(tmp_path / "r"), str(tmp_path / "c1"))
    assert sorted((r["hits"], r["total"]) for r in got.collect()) == [(0, 1), (1, 2)]
    done = metrics.run_once_to(metrics.sessions(ev(), "user_id", "1 hour", "10 minutes"), str(tmp_path / "o"), str(tmp_path / "c2"))
    assert [r["events"] for r in done.collect()] == [2]


def test_matches_see_their_surroundings(spark):
    docs = spark.createDataFrame([(1, "concat\ncat"), (2, "xset = 1\nset = 2"), (3, None), (4, ""), (5, "cat cat\n\ncat")], "id int, t string")
    assert [tuple(r) for r in filters.matches_with_lines(docs, "id", "t", r"\bcat\b").orderBy("id", "line").collect()] == [(1, 2, "cat"), (5, 1, "cat"), (5, 1, "cat"), (5, 3, "cat")]
    assert [tuple(r) for r in filters.matches_with_lines(docs, "id", "t", r"(?m)^set = ").collect()] == [(2, 2, "set = ")]
    assert [tuple(r) for r in filters.matches_with_lines(docs, "id", "t", r"a(t)", first_only=True).orderBy("id").collect()] == [(1, 1, "at"), (5, 1, "at")]
    assert filters.matches_with_lines(docs.limit(0), "id", "t", "a").count() == 0
    found = filters.matches_without(docs, "id", "t", "cat", "con", 3)
    assert [tuple(r) for r in found.orderBy("id", "line").collect()] == [(1, 2, "cat"), (5, 1, "cat"), (5, 1, "cat"), (5, 3, "cat")]
    lines = filters.pattern_findings(spark.createDataFrame([(1, "a\n```\na\n```\na"), (2, None), (3, "```\na")], "id int, t string"), "id", "t", {"r": "a"})
    assert {tuple(r) for r in lines.collect()} == {(1, 1, "r"), (1, 5, "r")}


def test_optional_joins_mentions_and_bundles(spark):
    left, right = spark.createDataFrame([("a",), ("b",), ("c",)], "k string"), spark.createDataFrame([("a", 0.0), ("b", 0.5)], "k string, v double")
    assert [r["k"] for r in joins.with_optional(left, right, "k", "v", F.col("v") < 0.2).collect()] == ["a"]
    msgs = spark.createDataFrame([(1, "@x then @y and @x and @z"), (2, None), (3, "@q")], "id int, t string")
    index = spark.createDataFrame([("z",), ("x",), ("y",), (None,)], "name string")
    found = lambda most, strict=False: joins.indexed_mentions(msgs, "id", text.mentions(F.col("t")), index, "name", most, strict)
    assert [tuple(r) for r in found(2).orderBy("place").collect()] == [(1, "x", 1), (1, "y", 2)]
    with pytest.raises(Exception, match="more than 2"):
        found(2, strict=True).collect()
    with pytest.raises(ValueError, match="positive"):
        found(0)
    rows = spark.createDataFrame([("law",), ("art",), (None,)], "c string")
    assert filters.by_bundle(rows, "c", {"minimal": ["law"]}, "complete") == (rows, None)
    assert filters.by_bundle(rows, "c", {"minimal": ["law"], "art": ["art"]}, "art")[0].count() == 1


def test_fences_lists_sections_and_updates(spark, tmp_path):
    said = lambda c, v, kind="string": spark.createDataFrame([(v,)], f"t {kind}").select(c.alias("o")).first()["o"]
    assert said(text.hide_amounts(F.col("t")), "pay $1.50 ```code $2.50 and $3.50") == "pay the billed cost ```code the billed cost and the billed cost"
    assert said(text.hide_amounts(F.col("t")), "```a $2.50``` $3.50") == "```a $2.50``` the billed cost"
    got = said(text.joined_sections(F.col("t")), "# Title\nintro\n## A\nx\n## B\n\n## a\ny")
    assert [tuple(x) for x in got] == [("general", "intro"), ("a", "x\ny")]
    assert said(text.joined_sections(F.col("t")), None) is None
    assert said(filters.source_faults(F.col("t"), F.col("t")), "official") == ["repo"] and said(filters.source_faults(F.col("t"), F.col("t")), None) == []
    empty = spark.createDataFrame([], "c string, ok boolean, p string")
    assert agg.tally(empty, "c", F.col("ok"), F.col("p")).count() == 0
    assert tuple(agg.rounded_summary(spark.createDataFrame([], "v double"), F.col("v")).first()) == (0, 0.0, None)
    spark.createDataFrame([("a", "2026-01-01 00:10:00"), ("a", "2026-01-01 00:20:00"), ("b", "2026-01-01 09:00:00")], "k string, t string").select("k", F.to_timestamp("t").alias("ts")).write.parquet(str(tmp_path / "in" / "events.parquet"))
    stream = spark.readStream.schema("k string, ts timestamp").parquet(str(tmp_path / "in" / "events.parquet"))
    done = metrics.run_updates(metrics.windowed_rates(stream, "k", F.col("k") == "a"), ["window", "k"], str(tmp_path / "out"), str(tmp_path / "cp"))
    assert sorted((r["k"], r["hits"], r["total"]) for r in done.collect()) == [("a", 2, 2), ("b", 0, 1)]
