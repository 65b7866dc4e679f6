"""Conditional aggregates over metric rows and the threshold rules on them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def rate_by(df: DataFrame, key: str, hit: Column, weight: Column | None = None) -> DataFrame:
    """``(key, hits, total, rate)`` a key: weighted share of rows for which ``hit`` holds; 0 where the total is 0. Null keys are left out."""
    w = F.lit(1) if weight is None else F.coalesce(weight, F.lit(0))
    out = df.filter(F.col(key).isNotNull()).groupBy(key).agg(F.sum(F.when(hit, w).otherwise(0)).alias("hits"), F.sum(w).alias("total"))
    return out.withColumn("rate", F.coalesce(F.try_divide("hits", "total"), F.lit(0.0)))


def share_by(df: DataFrame, key: str, hit: Column, weight: Column | None = None) -> DataFrame:
    """As ``rate_by``, without keys whose total is not positive."""
    return rate_by(df, key, hit, weight).filter("total > 0")


def error_counts(df: DataFrame, key: str, status: Column, weight: Column | None = None, pattern: str = r"^5\d\d$") -> DataFrame:
    """``(key, errors, total, error_rate)`` for keys with at least one row whose status matches; the rate is null at total 0."""
    w = F.lit(1) if weight is None else F.coalesce(weight, F.lit(0))
    bad = status.cast("string").rlike(pattern)
    out = df.filter(F.col(key).isNotNull()).groupBy(key).agg(F.sum(F.when(bad, w).otherwise(0)).alias("errors"), F.sum(w).alias("total"), F.count_if(bad).alias("seen"))
    return out.filter("seen > 0").drop("seen").withColumn("error_rate", F.try_divide("errors", "total"))


def share_of_total(df: DataFrame, name: str, value: str, pattern: str) -> DataFrame:
    """One row ``(matched, total, share)`` for the rows whose name matches; an empty table gives zeros."""
    v = F.coalesce(F.col(value), F.lit(0.0))
    out = df.agg(F.coalesce(F.sum(F.when(F.col(name).rlike(pattern), v)), F.lit(0.0)).alias("matched"), F.coalesce(F.sum(v), F.lit(0.0)).alias("total"))
    return out.withColumn("share", F.coalesce(F.try_divide("matched", "total"), F.lit(0.0)))


def bucket_counts(df: DataFrame, value: str, edges: list[float], labels: list[str]) -> DataFrame:
    """``(bucket, n)`` for every label, zero buckets too; bucket i holds values from edge i - 1 up to, not with, edge i."""
    which = F.lit(labels[-1])
    for edge, label in reversed(list(zip(edges, labels, strict=False))):
        which = F.when(F.col(value) < edge, label).otherwise(which)
    have = df.filter(F.col(value).isNotNull()).groupBy(which.alias("bucket")).agg(F.count("*").alias("n"))
    every = df.sparkSession.createDataFrame([(x,) for x in labels], "bucket string")
    return every.join(F.broadcast(have), "bucket", "left").select("bucket", F.coalesce("n", F.lit(0)).alias("n"))


def is_homogeneous(df: DataFrame, key: str, value: str) -> DataFrame:
    """``(key, values, uniform)``: the sorted distinct values of a key and whether there is exactly one."""
    got = df.groupBy(key).agg(F.sort_array(F.collect_set(value)).alias("values"))
    return got.withColumn("uniform", F.size("values") == 1)


def gate_ratio(df: DataFrame, numerator: str, denominator: str, *, least: float, ratio: float) -> DataFrame:
    """Rows with numerator above ``least``, a positive denominator and a quotient above ``ratio``; adds ``ratio``."""
    out = df.filter((F.col(numerator) > least) & (F.col(denominator) > 0)).withColumn("ratio", F.col(numerator) / F.col(denominator))
    return out.filter(F.col("ratio") > ratio)


def classify_metric(value: Column, ok: float | None = None, warning: float | None = None, critical_below: float | None = None, warning_below: float | None = None) -> Column:
    """'ok', 'warning' or 'critical': up to ``ok`` and ``warning`` inclusive, or below the strict lower bounds; without bounds 'ok'."""
    if critical_below is not None:
        return F.when(value < critical_below, "critical").when(value < (warning_below or critical_below), "warning").when(value.isNotNull(), "ok")
    out = F.when(value <= (ok if ok is not None else 999_999), "ok").when(value <= (warning if warning is not None else 999_999), "warning")
    return out.when(value.isNotNull(), "critical")


def round_half_up(x: Column) -> Column:
    """Rounding to an integer with halves towards positive infinity."""
    return F.floor(x + 0.5)


def rounded_summary(df: DataFrame, value: Column, digits: int = 2) -> DataFrame:
    """One row ``(count, total, worst)`` of values that are rounded before they are added; an empty table gives 0, 0 and null."""
    v = F.round(value, digits)
    return df.agg(F.count(v).alias("count"), F.coalesce(F.round(F.sum(v), digits), F.lit(0.0)).alias("total"), F.max(v).alias("worst"))


def tally(df: DataFrame, case: str, passed: Column, problem: Column, most: int = 20) -> DataFrame:
    """``(case, passed, failed, problems)``: how often each case held, and up to ``most`` of its distinct problems in order; a null result is a failure."""
    ok = F.coalesce(passed, F.lit(False))
    counts = df.groupBy(case).agg(F.count_if(ok).alias("passed"), F.count_if(~ok).alias("failed"))
    # distinct problems first, so that what a case gathers is bounded by their number
    listed = df.filter(~ok & problem.isNotNull()).select(case, problem.alias("_p")).distinct().groupBy(case).agg(F.slice(F.array_sort(F.collect_list("_p")), 1, most).alias("problems"))
    return counts.join(listed, case, "left").withColumn("problems", F.coalesce("problems", F.array().cast("array<string>")))
