"""Ordered operators: trailing windows, running state, ranks and gaps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def trailing_count(df: DataFrame, ts: str, seconds: int, limit: int, by: list[str] | None = None, bucket_rows: int = 200_000) -> DataFrame:
    """Rows with ``recent``, the rows of the last ``seconds`` up to and with theirs, and ``exceeded`` (recent >= limit).

    The stream is cut into buckets of time of about ``bucket_rows`` rows each, each row also given to the next buckets as far as its window
    reaches, so that no task gets the whole stream, however fast it runs.
    """
    at = F.unix_micros(F.col(ts).cast("timestamp"))
    span = seconds * 1_000_000
    keys = by or []
    extent = df.select(at.alias("a")).agg(F.min("a").alias("lo"), F.max("a").alias("hi"), F.count("a").alias("n")).first()
    width = max(span, 1_000_000, int(((extent["hi"] or 0) - (extent["lo"] or 0)) * bucket_rows / max(extent["n"], 1)))
    marked = df.withColumn("_at", at).withColumn("_home", F.floor(F.col("_at") / width))
    reach = F.floor((F.col("_at") + span) / width)
    spread = marked.withColumn("_bucket", F.explode(F.sequence("_home", reach)))
    w = Window.partitionBy(*keys, "_bucket").orderBy("_at").rangeBetween(-span, 0)
    out = spread.withColumn("recent", F.count("*").over(w)).filter("_bucket = _home")
    return out.withColumn("exceeded", F.col("recent") >= limit).drop("_at", "_home", "_bucket")


def last_n(df: DataFrame, key: str | None, order: list[Column], n: int) -> DataFrame:
    """The first ``n`` rows in the given order, of each key if there is one."""
    if key is None:
        return df.orderBy(*order).limit(n)
    return df.withColumn("_r", F.row_number().over(Window.partitionBy(key).orderBy(*order))).filter(F.col("_r") <= n).drop("_r")


def latest_by(df: DataFrame, key: str, order: Column, fields: list[str]) -> DataFrame:
    """Of each key the fields of its row with the greatest order; no sort, only a map-side combined maximum."""
    return df.groupBy(key).agg(F.max(F.struct(order.alias("_o"), *fields)).alias("m")).select(key, *[F.col(f"m.{f}").alias(f) for f in fields])


def fence_parity(lines: DataFrame, doc: str, line: str, text: str) -> DataFrame:
    """Adds ``fenced``: whether the line lies in a code fence or opens or closes one."""
    mark = F.col(text).rlike(r"^\s*(```|~~~)").cast("int")
    w = Window.partitionBy(doc).orderBy(line)
    return lines.withColumn("_f", mark).withColumn("fenced", (F.sum("_f").over(w) % 2 == 1) | (F.col("_f") == 1)).drop("_f")


def gaps(df: DataFrame, key: str, ts: str) -> DataFrame:
    """``(key, readings, span_seconds, median_gap, longest_gap)`` of consecutive readings; keys with one reading have null gaps."""
    at = F.unix_micros(F.col(ts).cast("timestamp")) / 1e6
    w = Window.partitionBy(key).orderBy("_at")
    seen = df.withColumn("_at", at).withColumn("_gap", F.col("_at") - F.lag("_at").over(w))
    return seen.groupBy(key).agg(F.count("*").alias("readings"), (F.max("_at") - F.min("_at")).alias("span_seconds"), F.expr("percentile(_gap, 0.5)").alias("median_gap"), F.max("_gap").alias("longest_gap"))


def suffix_fold(cues: DataFrame, doc: str, seq: str, text: str, keep: int = 40) -> DataFrame:
    """``(doc, text)``: rolling captions joined, each without the words that repeat the last ``keep`` words so far."""
    rows = cues.groupBy(doc).agg(F.transform(F.array_sort(F.collect_list(F.struct(seq, F.split(F.trim(F.regexp_replace(text, r"\s+", " ")), " ").alias("w")))), lambda x: x["w"]).alias("cues"))
    # the longest run at the start of a cue that the text so far ends with is dropped
    step = f"""aggregate(cues, cast(array() as array<string>), (acc, c) -> concat(acc, slice(c, 1 + coalesce(array_max(filter(sequence(0, least(size(c), size(acc), {keep})),
        k -> slice(acc, size(acc) - k + 1, k) = slice(c, 1, k))), 0), size(c))))"""
    return rows.select(doc, F.array_join(F.expr(step), " ").alias("text"))
