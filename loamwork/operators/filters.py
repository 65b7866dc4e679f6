"""Filters, predicates, validation rules and rule-based classification."""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


@F.pandas_udf(T.ArrayType(T.IntegerType()))
def fenced(marks: pd.Series) -> pd.Series:
    """1 for each line that lies between two fence lines or is one; the argument says which lines are fences."""
    return marks.map(lambda m: np.maximum(np.cumsum(m) % 2, np.asarray(m, np.int32)).astype(np.int32), na_action="ignore")


def effective_category(category: Column, tags: Column) -> Column:
    """The category, or the first tag where it is null or empty."""
    return F.coalesce(F.nullif(category, F.lit("")), F.get(tags, F.lit(0)))


def by_category(df: DataFrame, category: Column, wanted: list[str] | None) -> DataFrame:
    """Rows of the wanted categories; an empty or missing list means 'core'."""
    return df.filter(category.isin(*(wanted or ["core"])))


def bundle_members(bundles: DataFrame, query: list[str], safe: Column) -> DataFrame:
    """Distinct members of the bundles a query names: a part of the lower-cased name, or the slug of the identifier.

    ``bundles`` has ``id, name, skills``. A query that names no bundle stands for itself where ``safe`` (over ``id``) holds.
    """
    spark = bundles.sparkSession
    q = spark.createDataFrame([(x.lower(),) for x in query], "q string").distinct()
    q = q.withColumn("slug", F.trim(F.regexp_replace("q", "[^a-z0-9]+", "-"), F.lit("-")))
    hit = bundles.join(F.broadcast(q), F.contains(F.lower("name"), F.col("q")) | (F.col("slug") == F.col("id")))
    named = hit.select(F.explode("skills").alias("id"))
    loose = q.join(hit.select("q").distinct(), "q", "left_anti").select(F.col("q").alias("id"))
    return named.unionByName(loose).filter(safe).distinct()


def touched_folders(paths: DataFrame, path: str = "path", name: str = "SKILL.md") -> DataFrame:
    """Distinct folders of the changed files of that name."""
    p = F.col(path)
    return paths.filter((p == name) | p.endswith("/" + name)).select(F.when(p == name, ".").otherwise(F.regexp_replace(p, r"/[^/]*$", "")).alias("folder")).distinct()


def first_failure(rules: list[tuple[str, Column]]) -> Column:
    """Name of the first rule that doesn't hold, null if all do; a null condition fails."""
    out = F.lit(None).cast("string")
    for name, ok in reversed(rules):
        out = F.when(~F.coalesce(ok, F.lit(False)), name).otherwise(out)
    return out


def failures(rules: list[tuple[str, str, Column]], strict: bool = False) -> Column:
    """Array of (severity, rule) for all rules (severity, name, condition) that don't hold; ``strict`` turns warnings into errors."""
    grade = lambda s: "error" if strict and s == "warning" else s
    every = [F.when(~F.coalesce(ok, F.lit(False)), F.struct(F.lit(grade(s)).alias("severity"), F.lit(n).alias("rule"))) for s, n, ok in rules]
    return F.filter(F.array(*every), lambda x: x.isNotNull())


def first_tier(text: Column, tiers: list[tuple[str, list[tuple[str, str]]]]) -> Column:
    """Struct (tier, reasons): of tiers of (pattern, reason) the first with a match, and all its matching reasons; 'none' without any."""
    reasons = [(name, F.filter(F.array(*[F.when(text.rlike(p), r) for p, r in rules]), lambda x: x.isNotNull())) for name, rules in tiers]
    tier, why = F.lit("none"), F.array().cast("array<string>")
    for name, found in reversed(reasons):
        tier, why = F.when(F.size(found) > 0, name).otherwise(tier), F.when(F.size(found) > 0, found).otherwise(why)
    return F.struct(tier.alias("tier"), why.alias("reasons"))


#: Token shapes of three services.
SECRETS = (r"ghp_[A-Za-z0-9_]{20,}", r"sk-[A-Za-z0-9]{20,}", r"AKIA[0-9A-Z]{16}")
#: Noncharacters that mark where a match begins and ends; they can't be part of a text that is exchanged.
_OPEN, _SHUT = "\ufdd0", "\ufdd1"


def secret_hits(text: Column) -> Column:
    """Number of secret-like tokens of the known shapes."""
    return sum((F.size(F.regexp_extract_all(text, F.lit(f"({p})"), 1)) for p in SECRETS), F.lit(0))


def largest(df: DataFrame, size: str, least: int, n: int, tie: str) -> DataFrame:
    """The ``n`` largest rows of at least that size; equal sizes in order of ``tie``."""
    return df.filter(F.col(size) >= least).orderBy(F.desc(size), tie).limit(n)


def pattern_findings(docs: DataFrame, ident: str, text: str, rules: dict[str, str], *, outside_fences: bool = True) -> DataFrame:
    """``(id, rule, line)``, one row for each line and rule that matches, lines counted from 1; fenced lines are left out by default.

    Lines stay in their row's array until they match, so no shuffle is needed.
    """
    lines = F.split(F.col(text), "\n")
    parity = fenced(F.transform(lines, lambda x: x.rlike(r"^\s*(```|~~~)")))
    rows = docs.select(F.col(ident).alias("id"), F.posexplode(F.arrays_zip(lines.alias("line"), parity.alias("fenced")))).select("id", (F.col("pos") + 1).alias("line"), F.col("col.line").alias("text"), F.col("col.fenced").alias("fenced"))
    if outside_fences:
        rows = rows.filter("fenced = 0")
    hits = F.filter(F.array(*[F.when(F.col("text").rlike(p), F.lit(n)) for n, p in rules.items()]), lambda x: x.isNotNull())
    return rows.select("id", "line", F.explode(hits).alias("rule"))


def matches_with_lines(docs: DataFrame, ident: str, text: str, pattern: str, first_only: bool = False) -> DataFrame:
    """``(id, line, evidence)`` of the matches of a pattern with the line they begin in; all of them, or the first of each text.

    The pattern runs over the whole text, so anchors and word boundaries see what stands around a match.
    """
    t = F.translate(F.col(text), _OPEN + _SHUT, "")
    marked = F.split(F.regexp_replace(t, f"({pattern})", f"{_OPEN}$1"), "\n")
    # each line's number once for every match that begins in it
    begins = F.flatten(F.transform(marked, lambda x, i: F.array_repeat(i + 1, F.length(x) - F.length(F.replace(x, F.lit(_OPEN), F.lit(""))))))
    found = F.arrays_zip(begins.alias("line"), F.regexp_extract_all(t, F.lit(f"({pattern})"), 1).alias("evidence"))
    rows = docs.filter(F.col(text).rlike(pattern)).select(F.col(ident).alias("id"), F.explode(F.slice(found, 1, 1) if first_only else found).alias("m"))
    return rows.select("id", "m.line", "m.evidence")


def matches_without(docs: DataFrame, ident: str, text: str, pattern: str, excuse: str, reach: int = 100) -> DataFrame:
    """``(id, line, evidence)`` of matches that hold no ``excuse`` themselves nor within ``reach`` characters on either side."""
    t = F.translate(F.col(text), _OPEN + _SHUT, "")
    parts = F.split(F.regexp_replace(t, f"({pattern})", f"{_OPEN}$1{_SHUT}"), f"[{_OPEN}{_SHUT}]")
    begins = F.flatten(F.transform(F.split(F.regexp_replace(t, f"({pattern})", f"{_OPEN}$1"), "\n"), lambda x, i: F.array_repeat(i + 1, F.length(x) - F.length(F.replace(x, F.lit(_OPEN), F.lit(""))))))
    rows = docs.filter(F.col(text).rlike(pattern)).select(F.col(ident).alias("id"), parts.alias("p"), begins.alias("b"))
    # the nth match is part 2n; what is before and after it is what the other parts say
    around = f"concat(right(array_join(slice(p, 1, 2 * i + 1), ''), {reach}), p[2 * i + 1], left(array_join(slice(p, 2 * i + 3, size(p)), ''), {reach}))"
    found = F.expr(f"transform(b, (l, i) -> struct(l as line, p[2 * i + 1] as evidence, {around} as around))")
    return rows.select("id", F.explode(found).alias("m")).filter(~F.col("m.around").rlike(excuse)).select("id", "m.line", "m.evidence")


def lacks(docs: DataFrame, ident: str, text: str, needed: str, too_broad: str | None = None) -> DataFrame:
    """``(id, why)``: texts without any match of ``needed`` ('absent'), or else with one of ``too_broad`` ('broad'); null counts as without."""
    t = F.coalesce(F.col(text), F.lit(""))
    why = F.when(~t.rlike(needed), "absent")
    if too_broad is not None:
        why = why.when(t.rlike(too_broad), "broad")
    return docs.select(F.col(ident).alias("id"), why.alias("why")).filter("why is not null")


def outside_parentheses(c: Column, opener: str) -> Column:
    """The text without the balanced parentheses that follow each match of ``opener``; one that is never closed stays."""
    start = re.compile(opener)

    def cut_out(t: str | None) -> str | None:
        if t is None:
            return None
        out, at = [], 0
        while m := start.search(t, at):
            i, depth = t.find("(", m.start()), 0
            if i < 0:
                break
            for j in range(i, len(t)):
                depth += (t[j] == "(") - (t[j] == ")")
                if not depth:
                    break
            if depth:
                break
            out.append(t[at:i])
            at = j + 1
        return "".join([*out, t[at:]])

    @F.pandas_udf(T.StringType())
    def run(s: pd.Series) -> pd.Series:
        return s.map(cut_out, na_action="ignore")

    return run(c)


def by_bundle(df: DataFrame, category: str, bundles: dict[str, list[str]], name: str, default: str = "minimal") -> tuple[DataFrame, str | None]:
    """Rows whose category is in the named bundle, and a warning or None: 'complete' is every row, an unknown name stands for ``default``."""
    if name == "complete":
        return df, None
    warning = None if name in bundles else f"unknown bundle {name}, {default} taken"
    return df.filter(F.coalesce(F.col(category).isin(*bundles.get(name, bundles[default])), F.lit(False))), warning


def source_faults(repo: Column, kind: Column) -> Column:
    """Array of faults of a record's origin: 'repo' if it is not OWNER/REPO, 'kind' if it is not one of official, community, self; nulls are no fault."""
    bad_repo = repo.isNotNull() & ~repo.rlike(r"^[A-Za-z0-9_.-]+/[A-Za-z0-9_.-]+$")
    bad_kind = kind.isNotNull() & ~kind.isin("official", "community", "self")
    return F.array_compact(F.array(F.when(bad_repo, "repo"), F.when(bad_kind, "kind")))


def has_heading(c: Column, words: list[str]) -> Column:
    """Whether a second-level heading begins with one of the phrases, in any case; null has none."""
    return F.coalesce(c.rlike(r"(?im)^##\s+(" + "|".join(words) + r")\b"), F.lit(False))


def band(value: Column, steps: list[tuple[float, str]], rest: str) -> Column:
    """The name of the first step (least value, name), from high to low, that the value reaches; below all and null give ``rest``."""
    out = F.lit(rest)
    for least, name in sorted(steps):
        out = F.when(value >= least, name).otherwise(out)
    return out


def context_gap(docs: DataFrame, ident: str, text: str, trigger: str, answer: str, before: int, after: int) -> DataFrame:
    """``(id, line)`` of lines that match ``trigger`` while no line from ``before`` lines above to ``after`` below matches ``answer``."""
    lines = F.split(F.col(text), "\n")
    rows = docs.select(F.col(ident).alias("id"), lines.alias("l"))
    n = F.size("l")
    bad = F.filter(F.sequence(F.lit(1), n), lambda i: F.element_at("l", i).rlike(trigger) & ~F.exists(F.slice(F.col("l"), F.greatest(i - before, F.lit(1)), F.least(F.lit(before), i - 1) + after + 1), lambda x: x.rlike(answer)))
    return rows.filter("l is not null").select("id", F.explode(bad).alias("line"))
