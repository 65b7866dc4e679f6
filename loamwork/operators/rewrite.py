"""Ordered row-wise rewriting with a trail, and link and number repair."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A step: name, condition over the row, new text from the old.
Step = tuple[str, Callable[[Column], Column], Callable[[Column], Column]]


def rewrite(df: DataFrame, text: str, steps: list[Step], drops: list[tuple[str, Column]] | None = None) -> DataFrame:
    """Applies the steps in order and then the drop rules; adds ``trail`` (steps that changed the text) and ``drop_reason``.

    A step whose condition is null or false, or that changes nothing, leaves no trail. Every step reads what the one before wrote.
    """
    out = df.withColumn("trail", F.array().cast("array<string>"))
    for name, when, change in steps:
        new = F.when(F.coalesce(when(F.col(text)), F.lit(False)), change(F.col(text))).otherwise(F.col(text))
        out = out.withColumn("_new", new).withColumn("trail", F.when(~F.col("_new").eqNullSafe(F.col(text)), F.concat("trail", F.array(F.lit(name)))).otherwise(F.col("trail"))).withColumn(text, F.col("_new")).drop("_new")
    reason = F.lit(None).cast("string")
    for name, rule in reversed(drops or []):
        reason = F.when(F.coalesce(rule, F.lit(False)), name).otherwise(reason)
    return out.withColumn("drop_reason", reason)


def plain_links(docs: DataFrame, ident: str, text: str, targets: DataFrame, target: str) -> DataFrame:
    """``(id, text, dangling)``: Markdown links to relative targets that don't exist as their plain label, and how many there were."""
    pattern = r"\[([^\]\n]*)\]\(([^)\s]+)\)"
    keyed = docs.select(F.col(ident).alias("id"), F.col(text).alias("text"))
    links = keyed.select("id", F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(pattern), 2))).alias("to")).filter(~F.col("to").rlike(r"^([a-z]+:|#|/)"))
    bad = links.join(targets.select(F.col(target).alias("to")).distinct(), "to", "left_anti").groupBy("id").agg(F.collect_set("to").alias("bad"))
    both = keyed.join(bad, "id", "left")
    labels = F.regexp_extract_all("text", F.lit(pattern), 1)
    to = F.regexp_extract_all("text", F.lit(pattern), 2)
    # walk through the links; a bad one is replaced by its label
    fixed = F.aggregate(F.filter(F.arrays_zip(labels.alias("a"), to.alias("b")), lambda x: F.array_contains("bad", x["b"])), F.col("text"), lambda t, x: F.replace(t, F.concat(F.lit("["), x["a"], F.lit("]("), x["b"], F.lit(")")), x["a"]))
    return both.select("id", F.when(F.col("bad").isNull(), F.col("text")).otherwise(fixed).alias("text"), F.coalesce(F.size("bad"), F.lit(0)).alias("dangling"))


def replace_or_warn(c: Column, pattern: str, by: str) -> Column:
    """Struct (text, missing): the text rewritten, and whether the pattern wasn't there."""
    return F.struct(F.regexp_replace(c, pattern, by).alias("text"), (~F.coalesce(c.rlike(pattern), F.lit(False))).alias("missing"))


def snippet_checks(pages: DataFrame, page: str, text: str, rules: DataFrame) -> DataFrame:
    """``(page, snippet, expected, ok)`` for rules ``(page, snippet, expected)``: expected snippets must be there, others must not."""
    p = pages.select(F.col(page).alias("page"), F.col(text).alias("_t"))
    return rules.join(p, "page", "left").select("page", "snippet", "expected", (F.coalesce(F.contains("_t", F.col("snippet")), F.lit(False)) == F.col("expected")).alias("ok"))


#: Modules that come with the runtime.
BUILT_IN = "assert async_hooks buffer child_process cluster console constants crypto dgram diagnostics_channel dns domain events fs http http2 https inspector module net os path perf_hooks process punycode querystring readline repl stream string_decoder sys timers tls tty url util v8 vm worker_threads zlib".split()


def undeclared(df: DataFrame, text: str, declared: str) -> DataFrame:
    """Adds ``undeclared``: package names imported in the text's code blocks (import ... from / require) that the array column doesn't name; relative and built-in ones don't count."""
    code = F.array_join(F.regexp_extract_all(F.col(text), F.lit(r"(?s)```[^\n]*\n(.*?)```"), 1), "\n")
    names = F.concat(F.regexp_extract_all(code, F.lit(r"""(?:from|import)\s+['"]([^'"]+)['"]"""), 1), F.regexp_extract_all(code, F.lit(r"""require\(\s*['"]([^'"]+)['"]\s*\)"""), 1))
    package = F.transform(F.filter(names, lambda n: ~n.rlike(r"^(\.|/|node:)")), lambda n: F.regexp_extract(n, r"^((?:@[^/]+/)?[^/]+)", 1))
    package = F.filter(package, lambda n: ~n.isin(*BUILT_IN))
    return df.withColumn("undeclared", F.array_sort(F.array_except(F.array_distinct(package), F.coalesce(declared, F.array().cast("array<string>")))))


def stale(rendered: DataFrame, stored: DataFrame, key: str, text: str) -> DataFrame:
    """Keys whose rendered text differs from the stored one, or that one side lacks."""
    a, b = rendered.select(key, F.col(text).alias("_a"), F.lit(1).alias("_ia")), stored.select(key, F.col(text).alias("_b"), F.lit(1).alias("_ib"))
    return a.join(b, key, "full_outer").filter(~F.col("_a").eqNullSafe(F.col("_b")) | F.col("_ia").isNull() | F.col("_ib").isNull()).select(key)
