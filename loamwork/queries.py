"""Registry of the core queries over the test tables, with the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loamwork.functions import dates, text, versions
from loamwork.operators import aggregates as agg
from loamwork.operators import catalogue, filters, joins, search, sets, windows
from loamwork.operators import rewrite as rewrites
from loamwork.plans.durable import shared_path
from loamwork.session import table, tables
from loamwork.sources import files
from loamwork.streaming import metrics as streams

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a query, with its SQL if there is any."""

    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


@query("error_prone_users", """
SELECT user_id, count_if(event_type = 'error') AS errors, count(*) AS total, count_if(event_type = 'error') / count(*) AS rate
FROM events GROUP BY user_id HAVING count_if(event_type = 'error') > 10 AND count_if(event_type = 'error') / count(*) > 0.2
""")
def error_prone_users(spark: SparkSession, sf_dir: str) -> DataFrame:
    errors = F.count_if(F.col("event_type") == "error")
    return table(spark, sf_dir, "events").groupBy("user_id").agg(errors.alias("errors"), F.count("*").alias("total")).withColumn("rate", F.col("errors") / F.col("total")).filter("errors > 10 and rate > 0.2")


# --- conditional aggregates and threshold rules ---------------------------------------------------


@query("hit_rate", """
SELECT user_id, CAST(sum(CASE WHEN event_type = 'view' THEN 1 ELSE 0 END) AS BIGINT) AS hits, count(*) AS total, sum(CASE WHEN event_type = 'view' THEN 1 ELSE 0 END) / count(*) AS rate
FROM events WHERE user_id IS NOT NULL GROUP BY user_id
""")
def hit_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return agg.rate_by(table(spark, sf_dir, "events"), "user_id", F.col("event_type") == "view")


@query("value_share", """
SELECT event_type, sum(CASE WHEN value > 50 THEN value ELSE 0 END) AS hits, sum(coalesce(value, 0)) AS total, round(sum(CASE WHEN value > 50 THEN value ELSE 0 END) / sum(coalesce(value, 0)), 9) AS rate
FROM events WHERE event_type IS NOT NULL GROUP BY event_type HAVING sum(coalesce(value, 0)) > 0
""")
def value_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    cents = (F.col("value") * 1).cast("double")
    return agg.share_by(table(spark, sf_dir, "events"), "event_type", F.col("value") > 50, cents).withColumn("rate", F.round("rate", 9))


@query("error_rate", """
SELECT user_id, count_if(event_type = 'error') AS errors, count(*) AS total, count_if(event_type = 'error') / count(*) AS error_rate
FROM events WHERE user_id IS NOT NULL GROUP BY user_id HAVING count_if(event_type = 'error') > 0
""")
def error_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return agg.error_counts(table(spark, sf_dir, "events"), "user_id", F.when(F.col("event_type") == "error", "500").otherwise("200"))


@query("share_of_total", """
SELECT count_if(regexp_matches(event_type, '^(click|view)$')) * 1.0 AS matched, count(*) * 1.0 AS total, count_if(regexp_matches(event_type, '^(click|view)$')) / count(*) AS share FROM events
""")
def share_of_total(spark: SparkSession, sf_dir: str) -> DataFrame:
    return agg.share_of_total(table(spark, sf_dir, "events").withColumn("one", F.lit(1.0)), "event_type", "one", "^(click|view)$")


@query("duration_buckets", """
SELECT b.bucket, count(e.value) AS n FROM (VALUES ('short'), ('medium'), ('long'), ('never')) b(bucket)
LEFT JOIN events e ON b.bucket = CASE WHEN e.value < 25 THEN 'short' WHEN e.value < 100 THEN 'medium' WHEN e.value < 1000000 THEN 'long' ELSE 'never' END GROUP BY b.bucket
""")
def duration_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return agg.bucket_counts(table(spark, sf_dir, "events"), "value", [25, 100, 1_000_000], ["short", "medium", "long", "never"])


@query("uniform_regions", """
SELECT s_nationkey AS nation, list_sort(list_distinct(list(s_acctbal > 0))) AS values, count(DISTINCT s_acctbal > 0) = 1 AS uniform FROM supplier GROUP BY 1
""")
def uniform_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("nation"), (F.col("s_acctbal") > 0).alias("v"))
    return agg.is_homogeneous(s, "nation", "v")


@query("write_read_ratio", """
WITH t AS (SELECT coalesce(w.user_id, r.user_id) AS user_id, coalesce(w.n, 0) AS writes, coalesce(r.n, 0) AS reads
  FROM (SELECT user_id, count(*) AS n FROM events WHERE event_type = 'purchase' GROUP BY 1) w FULL OUTER JOIN (SELECT user_id, count(*) AS n FROM events WHERE event_type = 'view' GROUP BY 1) r ON w.user_id = r.user_id)
SELECT user_id, writes, reads, writes / reads AS ratio FROM t WHERE writes > 10 AND reads > 0 AND writes / reads > 0.5
""")
def write_read_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").withColumn("n", F.lit(1))
    both = joins.outer_totals(e.filter("event_type = 'purchase'"), e.filter("event_type = 'view'"), "user_id", "n", ("writes", "reads"))
    return agg.gate_ratio(both, "writes", "reads", least=10, ratio=0.5)


@query("metric_pivot", """
SELECT user_id, max(CASE WHEN event_type = 'click' THEN value END) AS click, max(CASE WHEN event_type = 'view' THEN value END) AS view, max(CASE WHEN event_type = 'purchase' THEN value END) AS purchase
FROM events GROUP BY user_id
""")
def metric_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    return joins.pivot_metrics(table(spark, sf_dir, "events"), "user_id", "event_type", "value", ["click", "view", "purchase"])


@query("slow_and_frequent", """
SELECT user_id, quantile_cont(value, 0.75) AS p75, count(*) AS calls, CAST(floor(quantile_cont(value, 0.75) * count(*) / 1000 + 0.5) AS BIGINT) AS priority
FROM events GROUP BY user_id HAVING quantile_cont(value, 0.75) > 20 AND count(*) >= 50
""")
def slow_and_frequent(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").groupBy("user_id").agg(F.expr("percentile(value, 0.75)").alias("p75"), F.count("*").alias("calls"))
    return e.filter("p75 > 20 and calls >= 50").withColumn("priority", agg.round_half_up(F.col("p75") * F.col("calls") / 1000))


@query("metric_class", """
SELECT event_id, CASE WHEN value <= 60 THEN 'ok' WHEN value <= 85 THEN 'warning' ELSE 'critical' END AS load, CASE WHEN value < 10 THEN 'critical' WHEN value < 15 THEN 'warning' ELSE 'ok' END AS free
FROM events WHERE value IS NOT NULL
""")
def metric_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = F.col("value")
    return table(spark, sf_dir, "events").filter("value is not null").select("event_id", agg.classify_metric(v, 60, 85).alias("load"), agg.classify_metric(v, critical_below=10, warning_below=15).alias("free"))


@query("category_counts", "SELECT lower(trim(category, ' ')) AS category, count(DISTINCT id) AS skills FROM skill WHERE trim(category, ' ') <> '' GROUP BY 1")
def category_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "skill").select(F.lower(F.trim("category")).alias("category"), "id").filter("category <> ''").groupBy("category").agg(F.count_distinct("id").alias("skills"))


@query("audit_record", """
SELECT (SELECT count(*) FROM documents) AS documents, (SELECT count(*) FROM skill) AS skill_rows, (SELECT count(DISTINCT id) FROM skill) AS skills, (SELECT count(*) FROM documents WHERE source IS NULL) AS without_source,
  (SELECT count(*) FROM documents WHERE source IS NULL) <= 100000 AS within_budget
""")
def audit_record(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").agg(F.count("*").alias("documents"), F.count_if(F.col("source").isNull()).alias("without_source"))
    s = table(spark, sf_dir, "skill").agg(F.count("*").alias("skill_rows"), F.count_distinct("id").alias("skills"))
    one = d.withColumn("k", F.lit(1)).join(s.withColumn("k", F.lit(1)), "k").drop("k")
    return one.withColumn("within_budget", F.col("without_source") <= 100_000).select("documents", "skill_rows", "skills", "without_source", "within_budget")


# --- joins and sets -------------------------------------------------------------------------------


@query("dangling_references", """
SELECT 'document_skill' AS "check", skill_id AS ref FROM documents d WHERE skill_id IS NOT NULL AND NOT EXISTS (SELECT 1 FROM skill s WHERE s.id = d.skill_id)
UNION ALL SELECT 'star_skill', skill_id FROM skill_star d WHERE NOT EXISTS (SELECT 1 FROM skill s WHERE s.id = d.skill_id)
UNION ALL SELECT 'summary_session', session_id FROM session_summary d WHERE session_id IS NOT NULL AND NOT EXISTS (SELECT 1 FROM session_entry s WHERE s.session_id = d.session_id)
""")
def dangling_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    doc, star, skill, summ, entry = tables(spark, sf_dir, "documents", "skill_star", "skill", "session_summary", "session_entry")
    return joins.dangling([("document_skill", doc.filter("skill_id is not null"), "skill_id", skill, "id"), ("star_skill", star, "skill_id", skill, "id"), ("summary_session", summ.filter("session_id is not null"), "session_id", entry, "session_id")])


@query("customers_without_orders", "SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderpriority = '1-URGENT')")
def customers_without_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, o = tables(spark, sf_dir, "customer", "orders")
    return c.join(o.filter("o_orderpriority = '1-URGENT'"), F.col("c_custkey") == F.col("o_custkey"), "left_anti").select("c_custkey")


@query("nations_all_positive", """
SELECT n_nationkey, coalesce(bool_and(s_acctbal > 0), true) AS all_positive FROM nation LEFT JOIN supplier ON s_nationkey = n_nationkey GROUP BY 1
""")
def nations_all_positive(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, s = tables(spark, sf_dir, "nation", "supplier")
    every = s.groupBy("s_nationkey").agg(F.bool_and(F.coalesce(F.col("s_acctbal") > 0, F.lit(False))).alias("ok"))
    return n.join(every, F.col("n_nationkey") == F.col("s_nationkey"), "left").select("n_nationkey", F.coalesce("ok", F.lit(True)).alias("all_positive"))


@query("host_latency_defaults", """
SELECT c_custkey, coalesce(n, 0) AS orders FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1) ON o_custkey = c_custkey
""")
def host_latency_defaults(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, o = tables(spark, sf_dir, "customer", "orders")
    n = o.groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("n"))
    return c.join(n, "c_custkey", "left").select("c_custkey", F.coalesce("n", F.lit(0)).alias("orders"))


@query("overlapping_boxes", """
WITH b AS (SELECT p_partkey AS id, p_partkey % 40 AS page, p_retailprice % 100 AS x0, p_size * 1.0 AS y0, p_retailprice % 100 + 5 AS x1, p_size + 3.0 AS y1 FROM part)
SELECT a.page, a.id AS a, b.id AS b FROM b a JOIN b ON a.page = b.page AND a.id < b.id AND a.x0 < b.x1 AND b.x0 < a.x1 AND a.y0 < b.y1 AND b.y0 < a.y1
""")
def overlapping_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    x = F.col("p_retailprice") % 100
    return joins.overlapping_boxes(p.select(F.col("p_partkey").alias("id"), (F.col("p_partkey") % 40).alias("page"), x.alias("x0"), F.col("p_size").cast("double").alias("y0"), (x + 5).alias("x1"), (F.col("p_size") + 3.0).alias("y1")))


@query("interval_overlap", "SELECT event_id FROM events WHERE ts < TIMESTAMP '2024-01-10 12:00:00' AND ts + INTERVAL 1 HOUR > TIMESTAMP '2024-01-10 06:00:00'")
def interval_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    ts = F.col("ts")
    lit = lambda t: F.lit(t).cast("timestamp_ntz")
    return table(spark, sf_dir, "events").filter(joins.within(ts, ts + F.expr("interval 1 hour"), lit("2024-01-10 06:00:00"), lit("2024-01-10 12:00:00"))).select("event_id")


@query("top_parts_of_top_suppliers", """
WITH t AS (SELECT l_suppkey, count(*) AS n FROM lineitem GROUP BY 1 ORDER BY n DESC, l_suppkey LIMIT 10),
     p AS (SELECT l_suppkey, l_partkey, count(*) AS lines FROM lineitem WHERE l_suppkey IN (SELECT l_suppkey FROM t) GROUP BY 1, 2)
SELECT l_suppkey, l_partkey, lines, rank FROM (SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY lines DESC, l_partkey) AS rank FROM p) WHERE rank <= 3
""")
def top_parts_of_top_suppliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    top = li.groupBy("l_suppkey").count().orderBy(F.desc("count"), "l_suppkey").limit(10).select("l_suppkey")
    parts = li.join(F.broadcast(top), "l_suppkey", "left_semi").groupBy("l_suppkey", "l_partkey").agg(F.count("*").alias("lines"))
    return joins.top_per_top(parts, "l_suppkey", [F.desc("lines"), F.col("l_partkey")], top, 3)


@query("index_differences", """
WITH a AS (SELECT id, max(risk) AS risk, max(source) AS source FROM skill GROUP BY 1), b AS (SELECT id, min(risk) AS risk, min(source) AS source FROM skill GROUP BY 1),
     c AS (SELECT coalesce(a.id, b.id) AS id, unnest([{'field': 'risk', 'left_value': a.risk, 'right_value': b.risk}, {'field': 'source', 'left_value': a.source, 'right_value': b.source}]) AS c FROM a FULL OUTER JOIN b ON a.id = b.id)
SELECT id, c.field, c.left_value, c.right_value FROM c WHERE c.left_value IS DISTINCT FROM c.right_value
""")
def index_differences(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "skill")
    a, b = (s.groupBy("id").agg(f("risk").alias("risk"), f("source").alias("source")) for f in (F.max, F.min))
    return joins.index_differences(a, b, "id", ["risk", "source"])


@query("allow_list", """
SELECT d.doc_id, CASE WHEN m.source IS NULL THEN 'unknown' WHEN d.n_chars >= 500 THEN 'kept' ELSE 'version' END AS verdict
FROM documents d LEFT JOIN (SELECT source FROM mix_target) m ON lower(d.source) = m.source
""")
def allow_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    d, m = tables(spark, sf_dir, "documents", "mix_target")
    return joins.split_by_allow_list(d.select("doc_id", F.lower("source").alias("source"), "n_chars"), m.select("source"), "source", F.col("n_chars") >= 500).select("doc_id", "verdict")


@query("repeated_keys", """
SELECT id, indexed_at, occurrence FROM (SELECT id, indexed_at, row_number() OVER (PARTITION BY id ORDER BY indexed_at) AS occurrence FROM skill) WHERE occurrence > 1
""")
def repeated_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sets.repeats(table(spark, sf_dir, "skill").select("id", "indexed_at"), "id", "indexed_at")


@query("wanted_and_available", """
SELECT count_if(s.id IS NOT NULL) AS matched, count_if(s.id IS NULL) AS missing FROM (SELECT DISTINCT skill_id FROM skill_star) w LEFT JOIN (SELECT DISTINCT id FROM skill) s ON s.id = w.skill_id
""")
def wanted_and_available(spark: SparkSession, sf_dir: str) -> DataFrame:
    w, s = tables(spark, sf_dir, "skill_star", "skill")
    return sets.wanted_and_available(w.select(F.col("skill_id").alias("id")), s.select("id"), "id")


@query("token_usage_totals", """
SELECT session_id, CAST(sum(coalesce(token_usage['input'], 0) + coalesce(token_usage['output'], 0)) AS BIGINT) AS tokens
FROM (SELECT DISTINCT entry_id, session_id, token_usage FROM session_entry WHERE session_id IS NOT NULL) GROUP BY 1
""")
def token_usage_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "session_entry").filter("session_id is not null").dropDuplicates(["entry_id"])
    return e.groupBy("session_id").agg(F.sum(F.coalesce(F.try_element_at("token_usage", F.lit("input")), F.lit(0)) + F.coalesce(F.try_element_at("token_usage", F.lit("output")), F.lit(0))).alias("tokens"))


# --- ordered operators and ranks ------------------------------------------------------------------


@query("trailing_window", """
SELECT event_id, recent, recent >= 3 AS exceeded FROM (SELECT event_id, count(*) OVER (ORDER BY ts RANGE BETWEEN INTERVAL 60 SECONDS PRECEDING AND CURRENT ROW) AS recent FROM events)
""")
def trailing_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windows.trailing_count(table(spark, sf_dir, "events"), "ts", 60, 3).select("event_id", "recent", "exceeded")


@query("latest_reading", """
SELECT skill_id, arg_max(star_count, struct_pack(a := synced_at, b := star_count)) AS star_count FROM skill_star WHERE star_count IS NOT NULL GROUP BY 1
""")
def latest_reading(spark: SparkSession, sf_dir: str) -> DataFrame:
    star = table(spark, sf_dir, "skill_star").filter("star_count is not null")
    return windows.latest_by(star, "skill_id", F.struct("synced_at", "star_count"), ["star_count"])


@query("last_events", """
SELECT user_id, event_id FROM (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id) AS k FROM events) WHERE k <= 3
""")
def last_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windows.last_n(table(spark, sf_dir, "events"), "user_id", [F.desc("ts"), F.col("event_id")], 3).select("user_id", "event_id")


@query("reading_gaps", """
WITH g AS (SELECT user_id, epoch_us(ts) / 1e6 AS t, (epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts)) / 1e6 AS gap FROM events)
SELECT user_id, count(*) AS readings, CAST(round((max(t) - min(t)) * 1000) AS BIGINT) AS span_ms, CAST(floor(quantile_cont(gap, 0.5)) AS BIGINT) AS median_gap, CAST(floor(max(gap)) AS BIGINT) AS longest_gap FROM g GROUP BY 1
""")
def reading_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = windows.gaps(table(spark, sf_dir, "events"), "user_id", "ts")
    return g.select("user_id", "readings", F.round(F.col("span_seconds") * 1000).cast("bigint").alias("span_ms"), F.floor("median_gap").alias("median_gap"), F.floor("longest_gap").alias("longest_gap"))


@query("fenced_lines", r"""
WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS n FROM documents),
     f AS (SELECT doc_id, n, CAST(regexp_matches(line, '^\s*(```|~~~)') AS INT) AS m FROM l),
     p AS (SELECT doc_id, n, m, sum(m) OVER (PARTITION BY doc_id ORDER BY n) AS s FROM f)
SELECT doc_id, count_if(s % 2 = 1 OR m = 1) AS fenced, count(*) AS lines FROM p GROUP BY 1
""")
def fenced_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("n", "line"))
    return windows.fence_parity(lines, "doc_id", "n", "line").groupBy("doc_id").agg(F.count_if("fenced").alias("fenced"), F.count("*").alias("lines"))


@query("top_values", "SELECT event_id, value FROM events WHERE value IS NOT NULL ORDER BY value DESC, event_id LIMIT 5")
def top_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windows.last_n(table(spark, sf_dir, "events").filter("value is not null"), None, [F.desc("value"), F.col("event_id")], 5).select("event_id", "value")


@query("largest_documents", "SELECT doc_id, n_chars FROM documents WHERE n_chars >= 1000 ORDER BY n_chars DESC, doc_id LIMIT 20")
def largest_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filters.largest(table(spark, sf_dir, "documents"), "n_chars", 1000, 20, "doc_id").select("doc_id", "n_chars")


@query("shallowest_path", """
WITH p AS (SELECT category, id, len(string_split(path, '/')) AS depth FROM skill WHERE category IS NOT NULL AND path IS NOT NULL)
SELECT category, min(depth) AS depth, arg_min(id, struct_pack(d := depth, i := id)) AS id FROM p GROUP BY 1
""")
def shallowest_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "skill").filter("category is not null and path is not null").select("category", "id", F.size(F.split("path", "/")).alias("depth"))
    return p.groupBy("category").agg(F.min(F.struct("depth", "id")).alias("m")).select("category", "m.depth", "m.id")


@query("page_after_key", "SELECT o_orderkey FROM orders WHERE o_orderkey > 500 ORDER BY o_orderkey LIMIT 50")
def page_after_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").filter("o_orderkey > 500").orderBy("o_orderkey").limit(50).select("o_orderkey")


# --- scalar functions -----------------------------------------------------------------------------


@query("normalized_text", r"""
SELECT doc_id, md5(trim(regexp_replace(regexp_replace(lower(text), '[^\p{L}\p{M}\p{N}_\s]', ' ', 'g'), '\s+', ' ', 'g'), ' ')) AS normal FROM documents
""")
def normalized_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(text.normalize_text(F.col("text"))).alias("normal"))


@query("name_grams", r"""
WITH t AS (SELECT DISTINCT id, trim(regexp_replace(regexp_replace(lower(name), '[^\p{L}\p{M}\p{N}_\s]', ' ', 'g'), '\s+', ' ', 'g')) AS t FROM skill WHERE name IS NOT NULL)
SELECT id, CASE WHEN len(t) < 3 THEN 1 ELSE len(list_distinct([t[i:i + 2] FOR i IN range(1, len(t) - 1)])) END AS grams FROM t
""")
def name_grams(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "skill").filter("name is not null").select("id", "name").distinct().select("id", F.size(text.char_ngrams(F.col("name"), 3)).alias("grams")).distinct()


@query("slugs", "SELECT DISTINCT id, trim(regexp_replace(lower(name), '[^a-z0-9]+', '-', 'g'), '-') AS slug FROM skill WHERE name IS NOT NULL")
def slugs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "skill").filter("name is not null").select("id", text.slugify(F.col("name")).alias("slug")).distinct()


@query("folded_names", "SELECT DISTINCT id, trim(regexp_replace(strip_accents(lower(name)), '[^a-z0-9]+', ' ', 'g')) AS folded FROM skill WHERE name IS NOT NULL")
def folded_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "skill").filter("name is not null").select("id", text.fold_accents(F.col("name")).alias("folded")).distinct()


@query("cache_keys", "SELECT doc_id, substr(sha256(coalesce(lang, '') || '|' || coalesce(source, '') || '|' || coalesce(skill_id, '')), 1, 16) AS key FROM documents")
def cache_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", text.cache_key(F.col("lang"), F.col("source"), F.col("skill_id")).alias("key"))


@query("short_descriptions", "SELECT DISTINCT id, CASE WHEN len(description) > 200 THEN substr(description, 1, 197) || '...' ELSE description END AS description FROM skill")
def short_descriptions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "skill").select("id", text.short_description(F.col("description")).alias("description")).distinct()


@query("text_mentions", r"SELECT entry_id, m FROM (SELECT DISTINCT entry_id, unnest(regexp_extract_all(content, '@([a-zA-Z0-9_./-]+)', 1)) AS m FROM session_entry WHERE content IS NOT NULL)")
def text_mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "session_entry").filter("content is not null").select("entry_id", F.explode(text.mentions(F.col("content"))).alias("m")).distinct()


@query("front_matter", r"""
SELECT doc_id, CASE WHEN text LIKE '---' || chr(10) || '%' THEN nullif(trim(regexp_extract(text, '(?s)\A---\n.*?\bname:([^\n]*)\n.*?\n?---', 1), ' '), '') END AS name,
  CASE WHEN text LIKE '---' || chr(10) || '%' THEN nullif(trim(regexp_extract(text, '(?s)\A---\n.*?\brisk:([^\n]*)\n---', 1), ' '), '') END AS risk
FROM documents
""")
def front_matter(spark: SparkSession, sf_dir: str) -> DataFrame:
    fm = text.front_matter(F.col("text"))
    d = table(spark, sf_dir, "documents").select("doc_id", fm.alias("fm"))
    return d.select("doc_id", F.nullif(F.try_element_at("fm", F.lit("name")), F.lit("")).alias("name"), F.nullif(F.try_element_at("fm", F.lit("risk")), F.lit("")).alias("risk"))


@query("section_counts", r"SELECT doc_id, len(regexp_extract_all(text, '(?m)^## ')) AS sections FROM documents")
def section_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.size(text.sections(F.col("text"))).alias("sections"))


@query("safe_ids", r"SELECT DISTINCT path, regexp_full_match(path, '[A-Za-z0-9._-]+(/[A-Za-z0-9._-]+)*') AND NOT regexp_matches(path, '(^|/)\.{1,2}(/|$)') AS safe FROM skill WHERE path IS NOT NULL")
def safe_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "skill").filter("path is not null").select("path", text.is_safe_id(F.col("path")).alias("safe")).distinct()


@query("recency", """
SELECT event_id, date_diff('day', CAST(ts AS DATE), DATE '2024-01-20') AS age,
  CASE WHEN date_diff('day', CAST(ts AS DATE), DATE '2024-01-20') <= 0 THEN 100 WHEN date_diff('day', CAST(ts AS DATE), DATE '2024-01-20') >= 30 THEN 0 ELSE CAST(trunc(100 * (1 - date_diff('day', CAST(ts AS DATE), DATE '2024-01-20') / 30)) AS INT) END AS score
FROM events
""")
def recency(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("event_id", dates.age_days(F.col("ts"), F.lit("2024-01-20").cast("date")).alias("age"))
    return e.withColumn("score", dates.recency(F.col("age")))


@query("date_confidence", "SELECT DISTINCT session_number, CASE WHEN date BETWEEN '2025-01-01' AND '2025-12-31' THEN 'high' ELSE 'low' END AS confidence FROM session_summary")
def date_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "session_summary").select("session_number", dates.date_confidence(F.col("date"), "2025-01-01", "2025-12-31").alias("confidence")).distinct()


@query("parsed_dates", r"""
SELECT DISTINCT session_number, CASE WHEN regexp_full_match(trim(date), '\d{4}-\d{2}-\d{2}') THEN epoch_us(try_cast(trim(date) AS TIMESTAMP)) WHEN regexp_full_match(trim(date), '-?\d+(\.\d+)?') THEN CAST(trim(date) AS BIGINT) * 1000000 END AS at
FROM session_summary
""")
def parsed_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "session_summary")
    return s.select("session_number", F.unix_micros(dates.parse_date(F.col("date"))).alias("at")).distinct()


@query("version_match", """
SELECT v, r, ok FROM (VALUES ('15.2.1', '*', true), ('15.2.1', '>=15', true), ('14.9', '>=15', false), ('15.2.1', '15', true), ('15.2.1', '15.2', true), ('15.2.1', '15.3', false),
  ('15.2.1', '<15.2', false), ('15.1.9', '<15.2', true), ('3.4.0', '2 || 3', true), ('4.0.0', '2 || 3', false), ('15.2.1', '>=15 <16', true), ('16.0.0', '>= 15 <16', false), ('v15.2', '^15', true), ('gpt4', '4', false)) t(v, r, ok)
""")
def version_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = [("15.2.1", "*"), ("15.2.1", ">=15"), ("14.9", ">=15"), ("15.2.1", "15"), ("15.2.1", "15.2"), ("15.2.1", "15.3"), ("15.2.1", "<15.2"), ("15.1.9", "<15.2"), ("3.4.0", "2 || 3"), ("4.0.0", "2 || 3"), ("15.2.1", ">=15 <16"), ("16.0.0", ">= 15 <16"), ("v15.2", "^15"), ("gpt4", "4")]
    return spark.createDataFrame(rows, "v string, r string").withColumn("ok", versions.in_range(F.col("v"), F.col("r")))


# --- filters, rules and findings ------------------------------------------------------------------


@query("category_filter", "SELECT id, indexed_at FROM skill WHERE CASE WHEN category = '' OR category IS NULL THEN source ELSE category END IN ('development', 'community')")
def category_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "skill")
    return filters.by_category(s, filters.effective_category(F.col("category"), F.array("source")), ["development", "community"]).select("id", "indexed_at")


@query("touched_folders", r"SELECT DISTINCT CASE WHEN path = 'SKILL.md' THEN '.' ELSE regexp_replace(path, '/[^/]*$', '') END AS folder FROM documents WHERE path = 'SKILL.md' OR path LIKE '%/SKILL.md'")
def touched_folders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filters.touched_folders(table(spark, sf_dir, "documents"))


@query("manifest_failures", """
SELECT id, indexed_at, CASE WHEN NOT coalesce(trim(description, ' ') <> '', false) THEN 'description' WHEN NOT coalesce(risk IN ('none', 'safe', 'critical', 'offensive', 'unknown'), false) THEN 'risk' WHEN date_added IS NULL THEN 'date_added' END AS failure FROM skill
""")
def manifest_failures(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = [("description", F.trim("description") != ""), ("risk", F.col("risk").isin("none", "safe", "critical", "offensive", "unknown")), ("date_added", F.col("date_added").isNotNull())]
    return table(spark, sf_dir, "skill").select("id", "indexed_at", filters.first_failure(rules).alias("failure"))


@query("manifest_findings", """
WITH f AS (SELECT id, indexed_at, unnest([CASE WHEN NOT coalesce(trim(description, ' ') <> '', false) THEN {'severity': 'error', 'rule': 'description'} END,
  CASE WHEN NOT coalesce(trim(source, ' ') <> '', false) THEN {'severity': 'error', 'rule': 'source'} END, CASE WHEN date_added IS NULL THEN {'severity': 'advisory', 'rule': 'date_added'} END]) AS x FROM skill)
SELECT id, indexed_at, x.severity, x.rule FROM f WHERE x IS NOT NULL
""")
def manifest_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = [("error", "description", F.trim("description") != ""), ("warning", "source", F.trim("source") != ""), ("advisory", "date_added", F.col("date_added").isNotNull())]
    return table(spark, sf_dir, "skill").select("id", "indexed_at", F.explode(filters.failures(rules, strict=True)).alias("x")).select("id", "indexed_at", "x.*")


_TIERS = [("high", [(r"(?i)\b(?:rootkit|malware|phishing)\b", "attack"), (r"(?i)\bexploit\b", "exploit")]), ("middle", [(r"(?i)\b(?:token|credential)\b", "secret"), (r"(?i)\b(?:delete|drop|update)\b", "change")]), ("low", [(r"(?i)\b(?:review|audit|inspect)\b", "reading")])]


@query("risk_tiers", r"""
WITH t AS (SELECT DISTINCT id, coalesce(description, '') AS d FROM skill),
     h AS (SELECT id, d, list_filter([CASE WHEN regexp_matches(d, '(?i)\b(?:rootkit|malware|phishing)\b') THEN 'attack' END, CASE WHEN regexp_matches(d, '(?i)\bexploit\b') THEN 'exploit' END], lambda x: x IS NOT NULL) AS a,
       list_filter([CASE WHEN regexp_matches(d, '(?i)\b(?:token|credential)\b') THEN 'secret' END, CASE WHEN regexp_matches(d, '(?i)\b(?:delete|drop|update)\b') THEN 'change' END], lambda x: x IS NOT NULL) AS b,
       list_filter([CASE WHEN regexp_matches(d, '(?i)\b(?:review|audit|inspect)\b') THEN 'reading' END], lambda x: x IS NOT NULL) AS c FROM t)
SELECT id, CASE WHEN len(a) > 0 THEN 'high' WHEN len(b) > 0 THEN 'middle' WHEN len(c) > 0 THEN 'low' ELSE 'none' END AS tier,
  array_to_string(CASE WHEN len(a) > 0 THEN a WHEN len(b) > 0 THEN b WHEN len(c) > 0 THEN c ELSE [] END, ',') AS reasons FROM h
""")
def risk_tiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "skill").select("id", F.coalesce("description", F.lit("")).alias("d")).distinct()
    return s.select("id", filters.first_tier(F.col("d"), _TIERS).alias("t")).select("id", "t.tier", F.array_join("t.reasons", ",").alias("reasons"))


@query("secret_scan", r"SELECT doc_id, len(regexp_extract_all(text, 'ghp_[A-Za-z0-9_]{20,}')) + len(regexp_extract_all(text, 'sk-[A-Za-z0-9]{20,}')) + len(regexp_extract_all(text, 'AKIA[0-9A-Z]{16}')) AS hits FROM documents")
def secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", filters.secret_hits(F.col("text")).alias("hits"))


@query("line_findings", r"""
WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS n FROM documents),
     f AS (SELECT *, CAST(regexp_matches(line, '^\s*(```|~~~)') AS INT) AS m FROM l), p AS (SELECT *, sum(m) OVER (PARTITION BY doc_id ORDER BY n) AS s FROM f),
     o AS (SELECT * FROM p WHERE s % 2 = 0 AND m = 0)
SELECT doc_id AS id, n AS line, 'never' AS rule FROM o WHERE regexp_matches(line, '(?i)\bnever\b') UNION ALL SELECT doc_id, n, 'list' FROM o WHERE regexp_matches(line, '^\d+\. ')
""")
def line_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filters.pattern_findings(table(spark, sf_dir, "documents"), "doc_id", "text", {"never": r"(?i)\bnever\b", "list": r"^\d+\. "})


@query("matches_with_lines", r"""
WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS n FROM documents)
SELECT doc_id AS id, n AS line, unnest(regexp_extract_all(line, '[A-Z][a-z]+ one ')) AS evidence FROM l
""")
def matches_with_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filters.matches_with_lines(table(spark, sf_dir, "documents"), "doc_id", "text", "[A-Z][a-z]+ one ")


@query("anchored_matches", r"""
WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS n FROM documents)
SELECT doc_id AS id, n AS line, unnest(regexp_extract_all(line, '^## [^ ]+|\b\d+\. ')) AS evidence FROM l
""")
def anchored_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filters.matches_with_lines(table(spark, sf_dir, "documents"), "doc_id", "text", r"(?m:^## [^ \n]+)|(?:\b\d+\. )")


@query("first_matches", r"""
WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS n FROM documents),
     m AS (SELECT doc_id, n, regexp_extract(line, '\b(?:check|the)\b') AS e FROM l WHERE regexp_matches(line, '\b(?:check|the)\b'))
SELECT doc_id AS id, min(n) AS line, arg_min(e, n) AS evidence FROM m GROUP BY 1
""")
def first_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filters.matches_with_lines(table(spark, sf_dir, "documents"), "doc_id", "text", r"\b(?:check|the)\b", first_only=True)


@query("unexcused_matches", r"""
WITH m AS (SELECT doc_id, text, unnest(list_filter(range(1, length(text) + 1), lambda i: substr(text, i, 4) = 'one ')) AS i FROM documents WHERE contains(text, 'one '))
SELECT doc_id AS id, length(left(text, i - 1)) - length(replace(left(text, i - 1), chr(10), '')) + 1 AS line, 'one ' AS evidence FROM m
WHERE NOT contains(substr(text, greatest(1, i - 40), i - greatest(1, i - 40) + 44), 'draft')
""")
def unexcused_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filters.matches_without(table(spark, sf_dir, "documents"), "doc_id", "text", "one ", "draft", 40)


@query("lacking_documents", r"""
SELECT doc_id AS id, CASE WHEN NOT regexp_matches(coalesce(text, ''), '(?m)^## ') THEN 'absent' ELSE 'broad' END AS why FROM documents
WHERE NOT regexp_matches(coalesce(text, ''), '(?m)^## ') OR regexp_matches(text, '\b(all|every)\b')
""")
def lacking_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filters.lacks(table(spark, sf_dir, "documents"), "doc_id", "text", "(?m)^## ", r"\b(all|every)\b")


@query("outside_parentheses", r"""
SELECT x, y FROM (VALUES ('a cache(b (c) d) e', 'a cache e'), ('cache(', 'cache('), ('no call (x)', 'no call (x)'), ('cache(1) and cache((2))!', 'cache and cache!')) t(x, y)
""")
def outside_parentheses(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.createDataFrame([("a cache(b (c) d) e",), ("cache(",), ("no call (x)",), ("cache(1) and cache((2))!",)], "x string")
    return rows.withColumn("y", filters.outside_parentheses(F.col("x"), r"\bcache(?=\()"))


@query("bundle_rows", "SELECT id, category FROM skill WHERE category IN ('law', 'music')")
def bundle_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, warning = filters.by_bundle(table(spark, sf_dir, "skill"), "category", {"minimal": ["law", "music"], "wide": ["sport"]}, "unheard-of")
    assert warning
    return rows.select("id", "category")


@query("source_faults", r"""
SELECT DISTINCT id, array_to_string(list_filter([CASE WHEN NOT regexp_full_match(source || '/' || category, '[A-Za-z0-9_.-]+/[A-Za-z0-9_.-]+') THEN 'repo' END, CASE WHEN source NOT IN ('official', 'community', 'self') THEN 'kind' END], lambda x: x IS NOT NULL), ',') AS faults FROM skill
""")
def source_faults(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "skill")
    return s.select("id", F.array_join(filters.source_faults(F.concat("source", F.lit("/"), "category"), F.col("source")), ",").alias("faults")).distinct()


@query("when_to_use", r"SELECT doc_id, coalesce(regexp_matches(text, '(?im)^##\s+(when to use|steps|use this)\b'), false) AS ok FROM documents")
def when_to_use(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", filters.has_heading(F.col("text"), ["when to use", "steps", "use this"]).alias("ok"))


@query("size_bands", "SELECT doc_id, CASE WHEN n_chars >= 900 THEN 'good' WHEN n_chars >= 500 THEN 'fair' ELSE 'poor' END AS band FROM documents")
def size_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", filters.band(F.col("n_chars"), [(900, "good"), (500, "fair")], "poor").alias("band"))


@query("known_share_only", """
SELECT c_custkey, share FROM customer LEFT JOIN (SELECT o_custkey, count_if(o_orderpriority = '1-URGENT') / count(*) AS share FROM orders GROUP BY 1) ON o_custkey = c_custkey WHERE share < 0.2
""")
def known_share_only(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, o = tables(spark, sf_dir, "customer", "orders")
    share = o.groupBy(F.col("o_custkey").alias("c_custkey")).agg((F.count_if(F.col("o_orderpriority") == "1-URGENT") / F.count("*")).alias("share"))
    return joins.with_optional(c.select("c_custkey"), share, "c_custkey", "share", F.col("share") < 0.2)


@query("indexed_mentions", r"""
WITH w AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[a-z]+')) AS m, generate_subscripts(regexp_extract_all(lower(text), '[a-z]+'), 1) AS pos FROM documents),
     k AS (SELECT doc_id, m, min(pos) AS pos FROM w WHERE m IN (SELECT lower(trim(category, ' ')) FROM skill) GROUP BY doc_id, m), r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS place FROM k)
SELECT doc_id AS id, m AS mention, place FROM r WHERE place <= 3
""")
def indexed_mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    d, s = tables(spark, sf_dir, "documents", "skill")
    return joins.indexed_mentions(d, "doc_id", F.regexp_extract_all(F.lower("text"), F.lit("([a-z]+)"), 1), s.select(F.lower(F.trim("category")).alias("category")).dropna(), "category", 3)


@query("rounded_summary", "SELECT count(v) AS count, round(sum(round(v, 2)), 2) AS total, max(round(v, 2)) AS worst FROM (SELECT l_quantity / 8 AS v FROM lineitem WHERE l_quantity > 45)")
def rounded_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return agg.rounded_summary(table(spark, sf_dir, "lineitem").filter("l_quantity > 45"), F.col("l_quantity").cast("double") / 8, 2)


@query("risk_tally", """
SELECT coalesce(category, '?') AS category, count_if(ok) AS passed, count_if(NOT ok) AS failed, coalesce(array_to_string(list_sort(list_distinct(list(CASE WHEN NOT ok THEN risk END)))[1:20], ','), '') AS problems
FROM (SELECT category, risk, coalesce(risk IN ('safe', 'none'), false) AS ok FROM skill) GROUP BY 1
""")
def risk_tally(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "skill").withColumn("category", F.coalesce("category", F.lit("?")))
    return agg.tally(s, "category", F.col("risk").isin("safe", "none"), F.col("risk")).withColumn("problems", F.array_join("problems", ","))


@query("top_entries", """
WITH b AS (SELECT skill_id, max(star_count) AS star_count FROM skill_star WHERE star_count IS NOT NULL GROUP BY 1) SELECT skill_id, star_count FROM b ORDER BY star_count DESC, skill_id LIMIT 25
""")
def top_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "skill_star").filter("star_count is not null").select("skill_id", "star_count")
    return catalogue.top_entries(s, "skill_id", [-F.col("star_count")], 25)


@query("filled_ranking", """
SELECT o_custkey, o_orderkey, rank FROM (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY CASE WHEN o_orderpriority = '1-URGENT' THEN 1 ELSE 0 END DESC, o_orderkey) AS rank FROM orders) WHERE rank <= 2
""")
def filled_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").withColumn("score", (F.col("o_orderpriority") == "1-URGENT").cast("int"))
    return catalogue.ranked_with_fill(o, "o_custkey", "score", "o_orderkey", 2).select("o_custkey", "o_orderkey", "rank")


@query("group_states", """
WITH l AS (SELECT event_type, arg_max(user_id, (ts, event_id)) AS u FROM events GROUP BY 1)
SELECT g AS "group", CASE WHEN coalesce(bool_or(u % 2 = 0), false) THEN 'success' ELSE 'pending' END AS state
FROM (VALUES ('a', 'click'), ('a', 'view'), ('b', 'error'), ('c', 'unseen')) t(g, n) LEFT JOIN l ON event_type = n GROUP BY 1
""")
def group_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    latest = windows.latest_by(e, "event_type", F.struct("ts", "event_id"), ["user_id"]).withColumn("state", F.when(F.col("user_id") % 2 == 0, "success").otherwise("failure"))
    return catalogue.state_of_groups(latest, "event_type", "state", {"a": ["click", "view"], "b": ["error"], "c": ["unseen"]})


@query("joined_sections", r"""
WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS n FROM documents),
     h AS (SELECT *, sum(CASE WHEN line LIKE '## %' THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY n) AS k FROM l WHERE line NOT LIKE '# %'),
     g AS (SELECT *, coalesce(max(CASE WHEN line LIKE '## %' THEN lower(trim(substr(line, 4), ' ')) END) OVER (PARTITION BY doc_id, k), 'general') AS heading FROM h),
     b AS (SELECT doc_id, heading, min(n) AS first, regexp_replace(string_agg(line, chr(10) ORDER BY n), '^\s+|\s+$', '', 'g') AS body FROM g WHERE line NOT LIKE '## %' GROUP BY ALL)
SELECT doc_id, count(*) AS sections, string_agg(heading, ',' ORDER BY heading) AS headings FROM b WHERE body <> '' GROUP BY 1
""")
def joined_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", text.joined_sections(F.col("text")).alias("s")).filter("size(s) > 0")
    return d.select("doc_id", F.size("s").cast("long").alias("sections"), F.array_join(F.array_sort(F.transform("s", lambda x: x["heading"])), ",").alias("headings"))


@query("front_matter_lists", """
SELECT n, tags FROM (VALUES (1, 'a,b c'), (2, 'x,y'), (3, NULL)) t(n, tags)
""")
def front_matter_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = [(1, '---\nname: q\ntags: [a, "b c"]\n---\nbody'), (2, "---\ntags:\n  - x\n  - 'y'\nname: z\n---\n"), (3, "no matter\ntags: [a]")]
    return spark.createDataFrame(rows, "n int, t string").select("n", F.array_join(F.element_at(text.front_matter_lists(F.col("t")), "tags"), ",").alias("tags"))


@query("dumped_front_matter", "SELECT DISTINCT id, name, coalesce(risk, '') AS risk FROM skill WHERE name IS NOT NULL AND NOT contains(name, chr(34)) AND NOT contains(coalesce(risk, ''), chr(34))")
def dumped_front_matter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is dumped reads back the same."""
    s = table(spark, sf_dir, "skill").filter("name is not null and not contains(name, '\"') and not contains(coalesce(risk, ''), '\"')")
    doc = text.dump_front_matter(F.create_map(F.lit("name"), F.col("name"), F.lit("risk"), F.coalesce("risk", F.lit(""))), F.col("description"))
    m = text.front_matter(doc)
    return s.select("id", F.element_at(m, "name").alias("name"), F.element_at(m, "risk").alias("risk")).distinct()


@query("fresh_readings", "SELECT skill_id, synced_at, synced_at > TIMESTAMP '2026-06-01' - INTERVAL 24 HOUR AS fresh FROM skill_star WHERE synced_at <= TIMESTAMP '2026-06-01'")
def fresh_readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "skill_star").filter("synced_at <= timestamp_ntz'2026-06-01'")
    return s.select("skill_id", "synced_at", text.fresh(F.col("synced_at").cast("timestamp"), F.lit("2026-06-01").cast("timestamp"), 24).alias("fresh"))


@query("json_defaults", "SELECT n, v FROM (VALUES (1, 'x'), (2, 'none'), (3, 'none'), (4, '0')) t(n, v)")
def json_defaults(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.createDataFrame([(1, '{"a": "x"}'), (2, '{"a": null}'), (3, '{"a": false}'), (4, '{"a": 0}')], "n int, j string")
    return rows.select("n", text.json_default(F.col("j"), "$.a", "none").alias("v"))


@query("stale_stamps", """
SELECT n, s FROM (VALUES (1, '2024-01'), (2, NULL), (3, '2023-05,2020-12')) t(n, s)
""")
def stale_stamps(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.createDataFrame([(1, "Verified 2024-01 and 2025-11"), (2, "dated 2020-01\nlast verified: 2025-12"), (3, "verified 2023-05\nnone\n(verified: 2020-12)")], "n int, t string")
    return rows.select("n", F.nullif(F.array_join(dates.stale_stamps(F.col("t"), 2026, 1, 6), ","), F.lit("")).alias("s"))


@query("date_ranges", "SELECT DISTINCT CAST(ts AS DATE) - 30 AS first, CAST(ts AS DATE) AS last FROM events")
def date_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(dates.date_range(F.col("ts"), 30).alias("r")).select("r.*").distinct()


@query("plain_links", r"""
SELECT n, t, dangling FROM (VALUES (1, 'see [a](here.md) and b and c', 2), (2, '[x](https://e.example/gone.md)', 0), (3, 'no link', 0)) v(n, t, dangling)
""")
def plain_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.createDataFrame([(1, "see [a](here.md) and [b](gone.md) and [c](../far/gone.md)"), (2, "[x](https://e.example/gone.md)"), (3, "no link")], "n int, t string")
    return rewrites.plain_links(docs, "n", "t", spark.createDataFrame([("here.md",)], "p string"), "p").select(F.col("id").alias("n"), F.col("text").alias("t"), "dangling")


@query("replaced_years", "SELECT doc_id, regexp_replace(text, '\\b2025\\b', '2026', 'g') AS text, NOT coalesce(regexp_matches(text, '\\b2025\\b'), false) AS missing FROM documents")
def replaced_years(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", rewrites.replace_or_warn(F.col("text"), r"\b2025\b", "2026").alias("r")).select("doc_id", "r.*")


@query("newest_model", "SELECT 'opal-4.10' AS model")
def newest_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.createDataFrame([("opal-4.9",), ("opal-4.10",), ("gpt4-1.2",), ("opal-3",), ("other-9",)], "model string")
    return catalogue.newest(rows, "model", "^opal-")


@query("untranslated_terms", "SELECT n, missing, ok FROM (VALUES (1, '', true), (2, 'b', false), (3, '', false)) t(n, missing, ok)")
def untranslated_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.createDataFrame([(1, {"a": "x"}, 1), (2, {"a": "x", "b": " "}, 2), (3, {"a": "x"}, 2)], "n int, terms map<string,string>, total int")
    return catalogue.untranslated(rows, "terms", "total").select("n", F.array_join("missing", ",").alias("missing"), "ok")


@query("undeclared_packages", "SELECT n, u FROM (VALUES (1, '@s/p,left-pad'), (2, ''), (3, '')) t(n, u)")
def undeclared_packages(spark: SparkSession, sf_dir: str) -> DataFrame:
    code = "```js\nimport x from '@s/p/sub'\nimport fs from 'fs'\nconst l = require('left-pad')\nimport z from 'zod'\nimport './own'\n```"
    rows = spark.createDataFrame([(1, code, ["zod"]), (2, "import prose from 'prose'", None), (3, None, ["a"])], "n int, t string, d array<string>")
    return rewrites.undeclared(rows, "t", "d").select("n", F.coalesce(F.array_join("undeclared", ","), F.lit("")).alias("u"))


@query("snippet_checks", r"""
SELECT doc_id AS page, s AS snippet, e AS expected, coalesce(contains(text, s), false) = e AS ok FROM documents, (VALUES ('## ', true), ('never', false)) t(s, e)
""")
def snippet_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    rules = d.select(F.col("doc_id").alias("page"), F.explode(F.array(F.struct(F.lit("## ").alias("snippet"), F.lit(True).alias("expected")), F.struct(F.lit("never").alias("snippet"), F.lit(False).alias("expected")))).alias("r")).select("page", "r.*")
    return rewrites.snippet_checks(d, "doc_id", "text", rules)


@query("framework_rules", "SELECT f, v, r, ok FROM (VALUES ('next', '15.1', 'next@>=14 // nuxt@*', true), ('next', '13.0', 'next@>=14 // nuxt@*', false), ('nuxt', '3', 'next@>=14 // nuxt@*', true), ('vite', '5.0', '5', true)) t(f, v, r, ok)")
def framework_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.createDataFrame([("next", "15.1", "next@>=14 // nuxt@*"), ("next", "13.0", "next@>=14 // nuxt@*"), ("nuxt", "3", "next@>=14 // nuxt@*"), ("vite", "5.0", "5")], "f string, v string, r string")
    return rows.withColumn("ok", versions.framework_fits(F.col("f"), F.col("v"), F.col("r")))


@query("secret_positives", "SELECT n, hits FROM (VALUES (1, 2), (2, 1), (3, 0), (4, 0)) t(n, hits)")
def secret_positives(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = [(1, "ghp_" + "a1_" * 8 + " and AKIA" + "Q7" * 8), (2, "sk-" + "Z9" * 10), (3, "ghp_short sk-tiny AKIA12"), (4, None)]
    return spark.createDataFrame(made, "n int, t string").select("n", F.coalesce(filters.secret_hits(F.col("t")), F.lit(0)).alias("hits"))


@query("heading_without_list", r"""
WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS n FROM documents)
SELECT a.doc_id AS id, a.n AS line FROM l a WHERE regexp_matches(a.line, '^## ') AND NOT EXISTS (SELECT 1 FROM l b WHERE b.doc_id = a.doc_id AND b.n BETWEEN a.n - 2 AND a.n + 4 AND regexp_matches(b.line, '^(- |\d+\. )'))
""")
def heading_without_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filters.context_gap(table(spark, sf_dir, "documents"), "doc_id", "text", "^## ", r"^(- |\d+\. )", 2, 4)


# --- near-duplicates and search -------------------------------------------------------------------


@query("distinct_names", r"""
WITH t AS (SELECT DISTINCT id, trim(regexp_replace(regexp_replace(lower(id), '[^\p{L}\p{M}\p{N}_\s]', ' ', 'g'), '\s+', ' ', 'g')) AS t FROM skill),
     g AS (SELECT id, len(t) AS s, list_distinct([t[i:i + 2] FOR i IN range(1, len(t) - 1)]) AS g FROM t)
SELECT a.id FROM g a WHERE NOT EXISTS (SELECT 1 FROM g b WHERE b.id <> a.id AND (b.s > a.s OR (b.s = a.s AND b.id < a.id)) AND len(list_intersect(a.g, b.g)) / (len(a.g) + len(b.g) - len(list_intersect(a.g, b.g))) >= 0.7)
""")
def distinct_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "skill").select("id").distinct().withColumn("score", F.length(text.normalize_text(F.col("id"))))
    return sets.drop_near_duplicates(s, "id", "id", "score", 0.7).select("id")


@query("full_text", r"""
WITH d AS (SELECT doc_id AS id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM documents), a AS (SELECT count(*) AS n, avg(len(w)) AS l FROM d),
     q AS (SELECT unnest(['checklist', 'ledger']) AS t), n AS (SELECT t, (SELECT count(*) FROM d WHERE list_contains(w, t)) AS df FROM q),
     s AS (SELECT id, sum(ln(1 + (a.n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len / a.l))) AS score, count(*) AS terms
           FROM (SELECT id, len(w) AS len, t, df, len(list_filter(w, lambda x: x = t)) AS tf FROM d, n WHERE list_contains(w, t)), a GROUP BY id)
SELECT id, round(score, 6) AS score FROM s WHERE terms = 2 ORDER BY s.score DESC, id LIMIT 10
""")
def full_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.bm25(table(spark, sf_dir, "documents"), "doc_id", "text", ["checklist", "ledger"]).withColumn("score", F.round("score", 6))


@query("term_index", r"""
SELECT w AS term, count(*) AS tf, count(DISTINCT doc_id) AS df FROM (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}]+')) AS w FROM documents) GROUP BY 1
""")
def term_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.term_index(table(spark, sf_dir, "documents"), "doc_id", "text").groupBy("term").agg(F.sum("tf").alias("tf"), F.count("*").alias("df"))


@query("nearest_vectors", """
WITH q AS (SELECT vec_id, embedding FROM embeddings WHERE vec_id % 100 = 0),
     s AS (SELECT q.vec_id AS query, e.vec_id AS id, list_cosine_similarity(CAST(q.embedding AS DOUBLE[]), CAST(e.embedding AS DOUBLE[])) AS similarity FROM q JOIN embeddings e ON e.vec_id <> q.vec_id)
SELECT query, id, round(similarity, 6) AS similarity, rank FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY similarity DESC, id) AS rank FROM s) WHERE rank <= 5
""")
def nearest_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    return search.nearest(e, "vec_id", "embedding", e.filter("vec_id % 100 = 0"), 5).withColumn("similarity", F.round("similarity", 6))


@query("replaced_index", """
SELECT skill_id AS key, path AS content FROM documents WHERE skill_id NOT IN (SELECT id FROM skill WHERE risk = 'critical') UNION ALL SELECT DISTINCT id, description FROM skill WHERE risk = 'critical' AND trim(description, ' ') <> ''
""")
def replaced_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    d, s = tables(spark, sf_dir, "documents", "skill")
    old = d.filter("skill_id is not null").select(F.col("skill_id").alias("key"), F.col("path").alias("content"))
    return search.reindex(old, s.filter("risk = 'critical'").select(F.col("id").alias("key"), F.col("description").alias("content")).distinct(), "key")


@query("push_batches", "SELECT batch, count(*) AS n, min(o_orderkey) AS first FROM (SELECT o_orderkey, (row_number() OVER (ORDER BY o_orderkey) - 1) // 400 AS batch FROM orders) GROUP BY 1")
def push_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files.push_batches(table(spark, sf_dir, "orders").select("o_orderkey"), "o_orderkey", 400).groupBy("batch").agg(F.count("*").alias("n"), F.min("o_orderkey").alias("first"))


@query("stream_hourly", "SELECT date_trunc('hour', ts) AS start, user_id, count_if(event_type = 'error') AS hits, count(*) AS total FROM events GROUP BY 1, 2")
def stream_hourly(spark: SparkSession, sf_dir: str) -> DataFrame:
    schema = table(spark, sf_dir, "events").schema
    s = streams.windowed_rates(streams.event_stream(spark, sf_dir, schema), "user_id", F.col("event_type") == "error")
    out = streams.run_updates(s, ["window", "user_id"], shared_path(spark, "hourly"), shared_path(spark, "stream"))
    return out.select(F.col("window.start").cast("timestamp_ntz").alias("start"), "user_id", "hits", "total")


@query("stream_sessions", """
WITH g AS (SELECT user_id, ts, CASE WHEN ts < lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 6 HOUR THEN 0 ELSE 1 END AS new FROM events),
     s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g)
SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 6 HOUR AS "end", count(*) AS events FROM s GROUP BY user_id, k
""")
def stream_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    schema = table(spark, sf_dir, "events").schema
    s = streams.sessions(streams.event_stream(spark, sf_dir, schema), "user_id", "6 hours")
    out = streams.run_once(s, shared_path(spark, "sessions"), shared_path(spark, "stream"))
    return out.select("user_id", F.col("session_window.start").cast("timestamp_ntz").alias("start"), F.col("session_window.end").cast("timestamp_ntz").alias("end"), "events")


# --- rewriting and catalogue upkeep ---------------------------------------------------------------


@query("rewritten_descriptions", r"""
WITH t AS (SELECT DISTINCT id, description AS d0 FROM skill), a AS (SELECT *, CASE WHEN d0 LIKE '%;%' THEN replace(d0, '; ', '. ') ELSE d0 END AS d1 FROM t), b AS (SELECT *, regexp_replace(d1, ' tasks\.$', ' work.') AS d2 FROM a)
SELECT id, d2 AS description, array_to_string(list_filter([CASE WHEN d1 IS DISTINCT FROM d0 THEN 'sentences' END, CASE WHEN d2 IS DISTINCT FROM d1 THEN 'wording' END], lambda x: x IS NOT NULL), ',') AS trail,
  CASE WHEN d2 IS NULL THEN 'missing' WHEN length(d2) < 100 THEN 'terse' END AS drop_reason FROM b
""")
def rewritten_descriptions(spark: SparkSession, sf_dir: str) -> DataFrame:
    steps = [("sentences", lambda c: F.contains(c, F.lit(";")), lambda c: F.replace(c, F.lit("; "), F.lit(". "))), ("wording", lambda c: F.lit(True), lambda c: F.regexp_replace(c, r" tasks\.$", " work."))]
    drops = [("missing", F.col("description").isNull()), ("terse", F.length("description") < 100)]
    out = rewrites.rewrite(table(spark, sf_dir, "skill").select("id", "description").distinct(), "description", steps, drops)
    return out.withColumn("trail", F.array_join("trail", ","))


@query("stale_names", """
WITH a AS (SELECT id, max(name) AS t FROM skill GROUP BY 1), b AS (SELECT skill_id AS id, max(path) AS t FROM documents WHERE skill_id IS NOT NULL GROUP BY 1)
SELECT coalesce(a.id, b.id) AS id FROM a FULL OUTER JOIN b ON a.id = b.id WHERE a.t IS DISTINCT FROM b.t OR a.id IS NULL OR b.id IS NULL
""")
def stale_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    s, d = tables(spark, sf_dir, "skill", "documents")
    return rewrites.stale(s.groupBy("id").agg(F.max("name").alias("t")), d.filter("skill_id is not null").groupBy(F.col("skill_id").alias("id")).agg(F.max("path").alias("t")), "id", "t")


@query("subject_topics", """
WITH w AS (SELECT subject AS topic, subject AS category, list_filter(regexp_split_to_array(scope_note, '[ ,]+'), lambda x: x <> 'and') AS terms FROM subject_area),
     p AS (SELECT DISTINCT id, lower(coalesce(description, '')) AS t, lower(trim(category, ' ')) AS c FROM skill), x AS (SELECT id, t, c, topic, category, lower(unnest(terms)) AS term FROM p, w)
SELECT id, topic, CAST(max(CASE WHEN c = category THEN 12 ELSE 0 END) + sum(CASE WHEN length(term) < 3 THEN 0 WHEN contains(t, term) THEN 5 ELSE 0 END) AS INT) AS score FROM x GROUP BY id, c, t, topic
""")
def subject_topics(spark: SparkSession, sf_dir: str) -> DataFrame:
    s, a = tables(spark, sf_dir, "skill", "subject_area")
    topics = a.select(F.col("subject").alias("topic"), F.col("subject").alias("category"), F.filter(F.split("scope_note", "[ ,]+"), lambda x: x != "and").alias("terms"))
    items = s.select("id", F.coalesce("description", F.lit("")).alias("d"), F.lower(F.trim("category")).alias("cat")).distinct()
    return catalogue.topic_scores(items, "id", F.col("d"), F.col("cat"), topics).withColumn("score", F.col("score").cast("int"))


@query("first_provider", """
WITH p AS (SELECT lower(source) AS provider, lang, min(n_chars) AS n FROM documents WHERE source IS NOT NULL AND lang IS NOT NULL GROUP BY 1, 2),
     r AS (SELECT *, list_position(['official', 'community', 'self'], provider) AS k FROM p)
SELECT lang, arg_min(provider, k) AS provider, arg_min(n, k) AS n FROM r WHERE k > 0 GROUP BY 1
""")
def first_provider(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").filter("source is not null and lang is not null").groupBy(F.lower("source").alias("provider"), "lang").agg(F.min("n_chars").alias("n"))
    return catalogue.first_provider(d, "lang", "provider", ["official", "community", "self"], ["n"])


@query("upserted_stars", """
WITH old AS (SELECT skill_id, min(star_count) AS stars FROM skill_star GROUP BY 1), new AS (SELECT id AS skill_id, CAST(-1 AS BIGINT) AS stars FROM skill GROUP BY 1 HAVING max(risk) = 'critical')
SELECT * FROM new UNION ALL SELECT * FROM old WHERE skill_id NOT IN (SELECT skill_id FROM new)
""")
def upserted_stars(spark: SparkSession, sf_dir: str) -> DataFrame:
    star, s = tables(spark, sf_dir, "skill_star", "skill")
    new = s.groupBy(F.col("id").alias("skill_id")).agg(F.max("risk").alias("r")).filter("r = 'critical'").select("skill_id", F.lit(-1).cast("bigint").alias("stars"))
    return catalogue.upsert(star.groupBy("skill_id").agg(F.min("star_count").alias("stars")), new, "skill_id")


@query("inferred_category", """
WITH r AS (SELECT id, max(category) AS given, max(coalesce(description, '')) AS d FROM skill GROUP BY 1), k AS (SELECT * FROM (VALUES ('exploit', 'security'), ('malware', 'security'), ('recipe', 'cooking'), ('oven', 'cooking'), ('invoice', 'finance')) v(keyword, category)),
     h AS (SELECT id, category, count(*) AS n FROM (SELECT DISTINCT id, unnest(regexp_split_to_array(lower(d), '[^a-z0-9]+')) AS keyword FROM r) JOIN k USING (keyword) GROUP BY 1, 2),
     b AS (SELECT id, arg_min(category, struct_pack(n := -n, c := category)) AS category, max(n) AS n FROM h GROUP BY 1)
SELECT r.id, CASE WHEN coalesce(trim(given, ' ') <> '', false) THEN trim(given, ' ') ELSE coalesce(b.category, regexp_extract(r.id, '([^-/]+)$', 1)) END AS category,
  CASE WHEN coalesce(trim(given, ' ') <> '', false) THEN 1.0 WHEN b.n IS NOT NULL THEN least(0.9, 0.4 + 0.1 * b.n) ELSE 0.1 END AS confidence FROM r LEFT JOIN b ON b.id = r.id
""")
def inferred_category(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "skill").groupBy("id").agg(F.max("category").alias("given"), F.max(F.coalesce("description", F.lit(""))).alias("d"))
    k = spark.createDataFrame([("exploit", "security"), ("malware", "security"), ("recipe", "cooking"), ("oven", "cooking"), ("invoice", "finance")], "keyword string, category string")
    return catalogue.infer_category(s, "id", F.col("given"), F.col("d"), k)
