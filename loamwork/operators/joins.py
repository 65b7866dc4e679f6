"""Reference checks and the joins that other engines spell as loops."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def dangling(checks: list[tuple[str, DataFrame, str, DataFrame, str]]) -> DataFrame:
    """``(check, ref)``: references without target. Each check is (name, references, column, targets, column)."""
    parts = [a.select(F.col(x).alias("ref")).join(b.select(F.col(y).alias("ref")), "ref", "left_anti").select(F.lit(name).alias("check"), "ref") for name, a, x, b, y in checks]
    return reduce(DataFrame.unionByName, parts)


def outer_totals(left: DataFrame, right: DataFrame, key: str, value: str, names: tuple[str, str]) -> DataFrame:
    """Sums of both sides by key, full outer, 0 where a side has no row."""
    a = left.filter(F.col(key).isNotNull()).groupBy(key).agg(F.sum(value).alias(names[0]))
    b = right.filter(F.col(key).isNotNull()).groupBy(key).agg(F.sum(value).alias(names[1]))
    return a.join(b, key, "full_outer").select(key, *[F.coalesce(n, F.lit(0)).alias(n) for n in names])


def pivot_metrics(df: DataFrame, key: str, metric: str, value: str, names: list[str]) -> DataFrame:
    """One row a key with the last given value of each named metric: the n-way full outer join in one aggregation."""
    return df.groupBy(key).agg(*[F.max(F.when(F.col(metric) == n, F.col(value))).alias(n) for n in names])


def overlapping_boxes(boxes: DataFrame, page: str = "page") -> DataFrame:
    """Pairs ``(page, a, b)`` of rectangles (id, page, x0, y0, x1, y1) on one page that overlap; touching edges do not.

    Each rectangle is spread over the grid cells it covers, so only neighbours meet; the cell of a pair's common lower corner reports it.
    """
    size = boxes.agg(F.avg(F.col("x1") - F.col("x0")).alias("w"), F.avg(F.col("y1") - F.col("y0")).alias("h")).first()
    w, h = max(size["w"] or 1.0, 1e-9) * 2, max(size["h"] or 1.0, 1e-9) * 2
    cell = lambda c, s: F.floor(F.col(c) / s).cast("long")
    spread = boxes.withColumn("cx", F.explode(F.sequence(cell("x0", w), cell("x1", w)))).withColumn("cy", F.explode(F.sequence(cell("y0", h), cell("y1", h))))
    a, b = spread.alias("a"), spread.alias("b")
    on = (F.col(f"a.{page}") == F.col(f"b.{page}")) & (F.col("a.cx") == F.col("b.cx")) & (F.col("a.cy") == F.col("b.cy")) & (F.col("a.id") < F.col("b.id"))
    meet = (F.col("a.x0") < F.col("b.x1")) & (F.col("b.x0") < F.col("a.x1")) & (F.col("a.y0") < F.col("b.y1")) & (F.col("b.y0") < F.col("a.y1"))
    first = (F.floor(F.greatest("a.x0", "b.x0") / w) == F.col("a.cx")) & (F.floor(F.greatest("a.y0", "b.y0") / h) == F.col("a.cy"))
    return a.join(b, on).filter(meet & first).select(F.col(f"a.{page}").alias(page), F.col("a.id").alias("a"), F.col("b.id").alias("b"))


def within(start: Column, end: Column, lo, hi) -> Column:
    """Whether the interval [start, end) overlaps the window [lo, hi)."""
    return (start < hi) & (end > lo)


def top_per_top(df: DataFrame, key: str, order: list[Column], keys: DataFrame, k: int) -> DataFrame:
    """The first ``k`` rows of each of ``keys`` in the given order, with their rank."""
    from pyspark.sql import Window

    some = df.join(keys, key, "left_semi")
    return some.withColumn("rank", F.row_number().over(Window.partitionBy(key).orderBy(*order))).filter(F.col("rank") <= k)


def index_differences(left: DataFrame, right: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """``(key, field, left_value, right_value)`` where two indexes disagree; a missing side counts as nulls, nulls equal each other."""
    a = left.select(key, *[F.col(f).cast("string").alias(f"l_{f}") for f in fields], F.lit(True).alias("in_l"))
    b = right.select(key, *[F.col(f).cast("string").alias(f"r_{f}") for f in fields], F.lit(True).alias("in_r"))
    both = a.join(b, key, "full_outer")
    cells = F.array(*[F.struct(F.lit(f).alias("field"), F.col(f"l_{f}").alias("left_value"), F.col(f"r_{f}").alias("right_value")) for f in fields])
    return both.select(key, F.explode(cells).alias("c")).select(key, "c.*").filter(~F.col("left_value").eqNullSafe(F.col("right_value")))


def split_by_allow_list(df: DataFrame, allowed: DataFrame, key: str, keep: Column) -> DataFrame:
    """Adds ``verdict``: 'unknown' without an entry in the allow list, else 'kept' where ``keep`` holds, else 'version'."""
    known = allowed.withColumn("_known", F.lit(True))
    out = df.join(known, key, "left")
    return out.withColumn("verdict", F.when(F.col("_known").isNull(), "unknown").when(keep, "kept").otherwise("version")).drop("_known")


def with_optional(left: DataFrame, right: DataFrame, key: str, value: str, keep: Column) -> DataFrame:
    """Left rows with the right side's value, null where there is none, of which those remain for which ``keep`` is true: a missing value is no zero, so a condition on it drops the row."""
    return left.join(right.select(key, value), key, "left").filter(F.coalesce(keep, F.lit(False)))


def indexed_mentions(messages: DataFrame, ident: str, found: Column, index: DataFrame, key: str, most: int, strict: bool = False) -> DataFrame:
    """``(id, mention, place)``: of each message the distinct mentions that the index holds, in order of appearance, at most ``most``; ``strict`` raises where there are more."""
    if most < 1:
        raise ValueError("most must be positive")
    rows = messages.select(F.col(ident).alias("id"), F.posexplode(F.array_distinct(found)).alias("at", "mention"))
    known = rows.join(index.select(F.col(key).alias("mention")).distinct(), "mention", "left_semi")
    listed = known.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("at", "mention"))).alias("m"))
    if strict:
        listed = listed.withColumn("m", F.when(F.size("m") > most, F.raise_error(F.lit(f"more than {most} mentions in one message"))).otherwise(F.col("m")))
    return listed.select("id", F.posexplode(F.slice("m", 1, most)).alias("place", "x")).select("id", "x.mention", (F.col("place") + 1).alias("place"))
