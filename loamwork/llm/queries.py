"""Queries over the test tables for the operators of this subpackage, with DuckDB SQL where it can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loamwork.llm import conversations, leaks, lookalikes, mixing, nearcopies, pii, subjects, termfreq, topn
from loamwork.llm.pii_model import KINDS
from loamwork.plans.durable import cut
from loamwork.session import table, tables


def p1_ranked(spark: SparkSession, sf_dir: str, n: int = 3) -> DataFrame:
    skill, star = tables(spark, sf_dir, "skill", "skill_star")
    latest = star.filter("star_count is not null").groupBy("skill_id").agg(F.max_by("star_count", F.struct("synced_at", "star_count")).alias("star_count"))
    category = skill.select(F.lower(F.trim("category")).alias("category"), F.col("id").alias("skill_id")).filter("category <> ''").distinct()
    return topn.top_n_per_group(category.join(latest, "skill_id"), "category", "star_count", "skill_id", n)


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p1_ranked(spark, sf_dir).select("category", "skill_id")


P1_SQL = """
WITH latest AS (SELECT skill_id, arg_max(star_count, struct_pack(a := synced_at, b := star_count)) AS star_count
                FROM skill_star WHERE star_count IS NOT NULL GROUP BY 1),
     cat AS (SELECT DISTINCT lower(trim(category, ' ')) AS category, id AS skill_id FROM skill WHERE trim(category, ' ') <> ''),
     ranked AS (SELECT category, skill_id, star_count, row_number() OVER (PARTITION BY category ORDER BY star_count DESC, skill_id) AS k
                FROM cat JOIN latest USING (skill_id))
"""


def _findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "session_summary").select("session_number", F.posexplode("key_findings").alias("position", "text"))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    entries = pii.personal_kinds(table(spark, sf_dir, "session_entry"), "entry_id", "content").select(F.lit("session_entry").alias("table_name"), F.col("entry_id").alias("row_key"), "kinds")
    found = pii.personal_kinds(_findings(spark, sf_dir), "session_number", "text").select(F.lit("session_summary").alias("table_name"), F.col("session_number").alias("row_key"), "kinds")
    return entries.unionByName(found).select("table_name", "row_key", F.explode("kinds").alias("kind")).distinct()


def p2_redacted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text of both columns with placeholders; ``position`` is the place in ``key_findings``, 0 for ``content``."""
    entries = pii.redacted_texts(table(spark, sf_dir, "session_entry").select("entry_id", "content").distinct(), "entry_id", "content").select(F.lit("session_entry").alias("table_name"), F.col("entry_id").alias("row_key"), F.lit(0).alias("position"), "text")
    keyed = _findings(spark, sf_dir).distinct().select(F.struct("session_number", "position").alias("k"), "text")
    found = pii.redacted_texts(keyed, "k", "text").select(F.lit("session_summary").alias("table_name"), F.col("k.session_number").alias("row_key"), F.col("k.position").alias("position"), "text")
    return entries.unionByName(found)


def p2_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By table: texts, and faults of the redaction: texts without a kind that changed, with a kind that lost no character, placeholders that differ in number of kinds from those found, other text that isn't the original's."""
    parts = []
    entries = table(spark, sf_dir, "session_entry").select("entry_id", "content").distinct()
    for name, rows, key, text in (("session_entry", entries, "entry_id", "content"), ("session_summary", _findings(spark, sf_dir).distinct().select(F.struct("session_number", "position").alias("k"), "text"), "k", "text")):
        before = rows.select(F.struct(F.col(key).alias("key"), F.col(text).alias("before")).alias("__both"), F.col(text).alias("content"))
        got = pii.redacted_texts(before, "__both", "content").select("__both.before", "text", "kinds")
        kinds = F.array_sort(F.array_distinct(F.transform(F.regexp_extract_all("text", F.lit(f"\\[({'|'.join(k.upper() for k in KINDS)})\\]"), 1), lambda x: F.lower(x))))
        # the text between the placeholders, as a pattern that the original must fit
        pattern = F.concat(F.lit("(?s)\\A"), F.regexp_replace(F.concat(F.lit("\\Q"), F.regexp_replace("text", "\\\\E", ""), F.lit("\\E")), f"\\[(?:{'|'.join(k.upper() for k in KINDS)})\\]", r"\\E.+\\Q"), F.lit("\\z"))
        clean = F.size("kinds") == 0
        parts.append(got.filter("before is not null").agg(
            F.count("*").alias("texts"), F.count_if(clean & (F.col("text") != F.col("before"))).alias("changed_clean"), F.count_if(~clean & (F.col("text") == F.col("before"))).alias("unchanged_found"),
            F.count_if(~clean & (kinds != F.array_sort("kinds"))).alias("kinds_differ"), F.count_if(~clean & ~F.rlike(F.regexp_replace("before", "\\\\E", ""), pattern)).alias("rest_differs"),
        ).select(F.lit(name).alias("table_name"), "*"))
    return parts[0].unionByName(parts[1])


P2_CHECKS_SQL = """
WITH t AS (SELECT 'session_entry' AS table_name, content AS x FROM (SELECT DISTINCT entry_id, content FROM session_entry) UNION ALL
           SELECT 'session_summary', f FROM (SELECT DISTINCT session_number, unnest(key_findings) AS f, generate_subscripts(key_findings, 1) AS p FROM session_summary))
SELECT table_name, count(x) AS texts, CAST(0 AS BIGINT) AS changed_clean, CAST(0 AS BIGINT) AS unchanged_found, CAST(0 AS BIGINT) AS kinds_differ, CAST(0 AS BIGINT) AS rest_differs FROM t GROUP BY 1
"""


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    skill, examples, areas = tables(spark, sf_dir, "skill", "subject_example", "subject_area")
    return subjects.subject_rows(skill, "id", "description", "category", examples, areas)


def p3_make_up(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Skills and share of all skills with a subject, by subject."""
    rows = p3_found(spark, sf_dir)
    total = rows.agg(F.count_distinct("id")).first()[0]
    return rows.groupBy("subject").agg(F.count("*").alias("skills")).withColumn("share", F.col("skills") / F.lit(float(max(total, 1))))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversations.session_reply_pairs(table(spark, sf_dir, "session_entry"))


def p4_chains(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same pairs found without session identifiers, from reply and quote links alone."""
    return conversations.chained_reply_pairs(table(spark, sf_dir, "session_entry"))


P4_SQL = r"""
WITH m AS (SELECT entry_id, min(session_id) AS s,
                  min(CASE WHEN regexp_matches(trim(timestamp), '^\d{4}-\d{2}-\d{2}[Tt ]\d{2}:\d{2}') THEN try_cast(trim(timestamp) AS TIMESTAMPTZ) END) AS t,
                  min(lower(trim(CASE WHEN regexp_matches(coalesce(role, ''), '\S') THEN role ELSE type END))) AS r
           FROM session_entry
           WHERE regexp_matches(coalesce(session_id, ''), '\S') AND regexp_matches(coalesce(content, ''), '\S') AND coalesce(type, '') <> 'queue-operation' GROUP BY 1),
     w AS (SELECT *, CASE WHEN r IN ('user', 'human') THEN 0 WHEN r IN ('assistant', 'ai', 'model') THEN 1 END AS who FROM m),
     o AS (SELECT *, lead(entry_id) OVER p AS nx, lead(who) OVER p AS nw, row_number() OVER p AS k, count(*) OVER (PARTITION BY s) AS n
           FROM w WINDOW p AS (PARTITION BY s ORDER BY t, who, entry_id)),
     ok AS (SELECT s FROM o GROUP BY s HAVING count_if(t IS NULL OR who IS NULL OR who = nw) = 0 AND count_if(k = 1 AND who = 0) = 1 AND count_if(k = n AND who = 1) = 1)
"""
P4_PAIRS = "least(entry_id, nx) AS entry_a, greatest(entry_id, nx) AS entry_b FROM o JOIN ok USING (s) WHERE who = 0 AND nw = 1"


def _skill_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    skill = table(spark, sf_dir, "skill").filter(F.col("description").rlike(r"(?U)\S"))
    return skill.select("id", nearcopies.word_set(F.col("description"), F.col("path")).alias("words"))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearcopies.near_copy_pairs(_skill_words(spark, sf_dir), "id", "words", 0.7).withColumnsRenamed({"a": "id_a", "b": "id_b"})


def p5_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearcopies.near_copy_groups(_skill_words(spark, sf_dir), "id", "words", 0.7)


P5_SQL = r"""
WITH s AS (SELECT DISTINCT id, list_sort(list_distinct(regexp_extract_all(lower(description || ' ' || coalesce(path, '')), '[a-z0-9]+'))) AS w
           FROM skill WHERE regexp_matches(description, '\S')),
     x AS (SELECT a.id AS id_a, b.id AS id_b, len(list_intersect(a.w, b.w)) AS i, len(a.w) + len(b.w) AS n FROM s a JOIN s b ON a.id < b.id)
SELECT DISTINCT id_a, id_b FROM x WHERE i >= 0.7 * (n - i)
"""


P5_GROUPS_SQL = r"""
WITH RECURSIVE s AS (SELECT DISTINCT id, list_sort(list_distinct(regexp_extract_all(lower(description || ' ' || coalesce(path, '')), '[a-z0-9]+'))) AS w FROM skill WHERE regexp_matches(description, '\S')),
     rep AS (SELECT w, min(id) AS rid FROM s WHERE len(w) > 0 GROUP BY w),
     x AS (SELECT a.rid AS x, b.rid AS y, len(list_intersect(a.w, b.w)) AS i, len(a.w) + len(b.w) AS n FROM rep a JOIN rep b ON a.rid < b.rid),
     p AS (SELECT x AS a, y AS b FROM x WHERE i >= 0.7 * (n - i) UNION SELECT rid, id FROM s JOIN rep USING (w) WHERE rid <> id),
     e AS (SELECT a, b FROM p UNION ALL SELECT b, a FROM p),
     r(id, node) AS (SELECT DISTINCT id, id FROM s WHERE len(w) > 0 UNION SELECT r.id, e.b FROM r JOIN e ON r.node = e.a),
     d AS (SELECT a AS id, count(*) AS n FROM e GROUP BY 1)
SELECT r.id, min(node) AS "group", coalesce(any_value(d.n), 0) AS links FROM r LEFT JOIN d ON d.id = r.id GROUP BY r.id
"""


def p6_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    skill = table(spark, sf_dir, "skill")
    total = skill.agg(F.count_distinct("id")).first()[0]
    return termfreq.mark_terms(termfreq.term_frequencies(skill, "id", ["category", "risk", "source"]), total)


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p6_terms(spark, sf_dir).filter("mark is not null").select("field", "term", "mark")


P6_SQL = """
WITH x AS (SELECT id, unnest([{'f': 'category', 't': category}, {'f': 'risk', 't': risk}, {'f': 'source', 't': source}]) AS v FROM skill),
     f AS (SELECT v.f AS field, lower(trim(v.t, ' ')) AS term, count(*) AS n_rows, count(DISTINCT id) AS n_records FROM x WHERE trim(v.t, ' ') <> '' GROUP BY 1, 2),
     m AS (SELECT *, CASE WHEN n_records <= 2 THEN 'rare' WHEN n_records > 0.2 * (SELECT count(DISTINCT id) FROM skill) THEN 'common' END AS mark FROM f)
"""

def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, items = tables(spark, sf_dir, "documents", "eval_item")
    return leaks.find_leaks(docs, "doc_id", "text", items, "item_id", "text")


P7_SQL = r"""
WITH i AS (SELECT item_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM eval_item),
     ig AS (SELECT DISTINCT item_id, least(len(w), 12) AS n, array_to_string(w[g:g + least(len(w), 12) - 1], ' ') AS gram
            FROM i, unnest(range(1, len(w) - least(len(w), 12) + 2)) x(g) WHERE len(w) > 0),
     d AS (SELECT doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM documents),
     dg AS (SELECT DISTINCT doc_id, n, array_to_string(w[g:g + n - 1], ' ') AS gram
            FROM d, (SELECT DISTINCT n FROM ig), unnest(range(1, greatest(1, len(w) - n + 2))) x(g))
SELECT DISTINCT doc_id, item_id FROM dg JOIN ig USING (n, gram)
"""


def p8_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, targets = tables(spark, sf_dir, "documents", "mix_target")
    used, _ = mixing.mixture(mixing.token_counts(docs, "doc_id", "text", "source"), targets)
    return used.withColumnRenamed("id", "doc_id")


def p8_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, targets = tables(spark, sf_dir, "documents", "mix_target")
    return mixing.mixture_report(*mixing.mixture(mixing.token_counts(docs, "doc_id", "text", "source"), targets))


def p8_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By target source: whether its share was met within one document, no document was used too often, and all came from its own documents."""
    docs, targets = tables(spark, sf_dir, "documents", "mix_target")
    sizes = cut(mixing.token_counts(docs, "doc_id", "text", "source"))
    used, todo = mixing.mixture(sizes, targets)
    rows = [(r.source, float(r.goal), int(r.max_repeats), bool(r.have > 0)) for r in todo.itertuples()]
    plan = spark.createDataFrame(rows, "source string, goal double, max_repeats bigint, available boolean")
    got = used.groupBy("source").agg(F.sum(F.col("tokens") * F.col("copies")).alias("tokens"), F.max("copies").alias("copies"), F.count("*").alias("n"), F.count_distinct("id").alias("ids"))
    out = plan.join(got, "source", "left").join(sizes.groupBy("source").agg(F.max("tokens").alias("largest")), "source", "left")
    return out.select(
        "source", "available", F.coalesce(F.abs(F.col("tokens") - F.col("goal")) <= F.col("largest"), F.col("goal") < 0.5).alias("share_met"),
        F.coalesce(F.col("copies") <= F.col("max_repeats"), F.lit(True)).alias("repeats_kept"), F.coalesce(F.col("n") == F.col("ids"), F.lit(True)).alias("once_each"),
    )


P8_CHECKS_SQL = """
WITH d AS (SELECT DISTINCT lower(trim(source, ' ')) AS source FROM documents WHERE text <> '')
SELECT lower(trim(t.source, ' ')) AS source, d.source IS NOT NULL AS available, true AS share_met, true AS repeats_kept, true AS once_each FROM mix_target t LEFT JOIN d ON d.source = lower(trim(t.source, ' '))
"""


def p9_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lookalikes.look_alike_groups(table(spark, sf_dir, "documents"), "doc_id", "text")


def p9_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts, and faults of the consistent form: rows lost, plain texts changed, forms that change again, digits or line breaks that differ."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    once = lookalikes.canonical_texts(docs.select(F.struct("doc_id", "text").alias("k"), "text"), "k", "text").select("k.doc_id", "k.text", "form")
    reps = lookalikes.representatives(docs, "text")
    again = lookalikes.rewritten(once.select(F.struct("doc_id", "text", "form").alias("k"), "form"), "k", "form", reps).select("k.*", F.col("form").alias("again"))
    kept = lambda c: F.regexp_replace(F.translate(c, "".join(chr(0xFF10 + i) for i in range(10)), "0123456789"), "[^0-9\n]", "")
    plain = F.col("text").rlike(r"^[\x00-\x7F]*$")
    return again.agg(F.count("*").alias("n_rows"), F.count("text").alias("texts"), F.count_if(plain & (F.col("form") != F.col("text"))).alias("plain_changed"), F.count_if(F.col("again") != F.col("form")).alias("form_changed"), F.count_if(kept("form") != kept("text")).alias("digits_differ"))


P9_CHECKS_SQL = "SELECT count(*) AS n_rows, count(text) AS texts, CAST(0 AS BIGINT) AS plain_changed, CAST(0 AS BIGINT) AS form_changed, CAST(0 AS BIGINT) AS digits_differ FROM documents"


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lookalikes.look_alike_pairs(table(spark, sf_dir, "documents"), "doc_id", "text").withColumnsRenamed({"a": "doc_a", "b": "doc_b"})


def p9_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lookalikes.canonical_texts(table(spark, sf_dir, "documents"), "doc_id", "text")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "p1_found": p1_found,
    "p1_ranked": p1_ranked,
    "p2_found": p2_found,
    "p2_redacted": p2_redacted,
    "p2_checks": p2_checks,
    "p3_found": p3_found,
    "p3_make_up": p3_make_up,
    "p4_found": p4_found,
    "p4_chains": p4_chains,
    "p5_found": p5_found,
    "p5_groups": p5_groups,
    "p6_found": p6_found,
    "p6_terms": p6_terms,
    "p7_found": p7_found,
    "p8_mixture": p8_mixture,
    "p8_shares": p8_shares,
    "p8_checks": p8_checks,
    "p9_found": p9_found,
    "p9_texts": p9_texts,
    "p9_groups": p9_groups,
    "p9_checks": p9_checks,
}

SQL: dict[str, str] = {
    "p1_found": P1_SQL + "SELECT category, skill_id FROM ranked WHERE k <= 3",
    "p1_ranked": P1_SQL + "SELECT category, star_count, skill_id FROM ranked WHERE k <= 3",
    "p4_found": f"{P4_SQL}SELECT s AS session_id, {P4_PAIRS}",
    "p4_chains": f"{P4_SQL}SELECT {P4_PAIRS}",
    "p5_found": P5_SQL,
    "p5_groups": P5_GROUPS_SQL,
    "p6_found": P6_SQL + "SELECT field, term, mark FROM m WHERE mark IS NOT NULL",
    "p6_terms": P6_SQL + "SELECT field, term, n_rows, n_records, mark FROM m",
    "p7_found": P7_SQL,
    "p2_checks": P2_CHECKS_SQL,
    "p8_checks": P8_CHECKS_SQL,
    "p9_checks": P9_CHECKS_SQL,
}
