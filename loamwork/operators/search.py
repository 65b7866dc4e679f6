"""Full-text search: a term index, BM25 ranking and snippets; and exact vector similarity."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TOKEN = r"[\p{L}\p{N}]+"


def tokens(c: Column) -> Column:
    """Lower-cased runs of letters and digits."""
    return F.regexp_extract_all(F.lower(c), F.lit(f"({TOKEN})"), 1)


def term_index(df: DataFrame, ident: str, text: str) -> DataFrame:
    """``(term, id, tf, length)`` of every text, partial counts combined before the shuffle."""
    docs = df.select(F.col(ident).alias("id"), tokens(F.col(text)).alias("w")).filter("id is not null")
    return docs.select("id", F.size("w").alias("length"), F.explode("w").alias("term")).groupBy("term", "id", "length").agg(F.count("*").alias("tf"))


def _equals(term: str):
    return lambda x: x == F.lit(term)


def bm25(df: DataFrame, ident: str, text: str, query: list[str], k: int | None = 10, k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """``(id, score)`` of the best texts that hold every query term, score descending, then identifier.

    idf = ln(1 + (N - n + 0.5) / (n + 0.5)). Only the query's terms leave the scan; N and the average length cover all texts. A
    query without terms gives no rows.
    """
    terms = sorted({t.lower() for t in query if t})
    docs = df.select(F.col(ident).alias("id"), tokens(F.col(text)).alias("w")).filter("id is not null and w is not null")
    # one pass for everything the formula needs of the whole corpus
    every = docs.agg(F.count("*").alias("n"), F.avg(F.size("w")).alias("avg"), *[F.count_if(F.array_contains("w", t)).alias(f"n{i}") for i, t in enumerate(terms)]).first()
    hit = docs.filter(F.array_contains("w", terms[0])) if terms else docs.filter(F.lit(False))
    for t in terms[1:]:
        hit = hit.filter(F.array_contains("w", t))
    total = F.lit(0.0)
    for i, t in enumerate(terms):
        n = every[f"n{i}"]
        idf = math.log(1 + (every["n"] - n + 0.5) / (n + 0.5))
        tf = F.size(F.filter("w", _equals(t))).cast("double")
        total = total + F.lit(idf) * tf * (k1 + 1) / (tf + k1 * (1 - b + b * F.size("w") / F.lit(float(every["avg"] or 1))))
    out = hit.select("id", total.alias("score"))
    return out.orderBy(F.desc("score"), "id").limit(k) if k else out


def snippet(text: Column, term: str, width: int = 40, left: str = ">>>", right: str = "<<<") -> Column:
    """About ``width`` words around the first occurrence of a term, which is marked."""
    w = F.split(F.trim(F.regexp_replace(text, r"\s+", " ")), " ")
    at = F.coalesce(F.array_position(F.transform(w, lambda x: F.regexp_replace(F.lower(x), r"[^\p{L}\p{N}]", "")), term.lower()), F.lit(1)).cast("int")
    start = F.greatest(at - width // 2, F.lit(1))
    some = F.transform(F.slice(w, start, F.lit(width)), lambda x, i: F.when(i + start == at, F.concat(F.lit(left), x, F.lit(right))).otherwise(x))
    return F.array_join(some, " ")


def reindex(index: DataFrame, fresh: DataFrame, key: str) -> DataFrame:
    """The index with all rows of the keys in ``fresh`` replaced by its rows; blank contents are left out."""
    return index.join(fresh.select(key).distinct(), key, "left_anti").unionByName(fresh.filter(F.trim("content") != ""))


def cosine(a: Column, b: Column) -> Column:
    dot = F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y), F.lit(0.0), lambda s, x: s + x)
    norm = lambda v: F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x))
    return F.try_divide(dot, norm(a) * norm(b))


def nearest(df: DataFrame, ident: str, vector: str, queries: DataFrame, k: int, block: int = 2_000) -> DataFrame:
    """``(query, id, similarity, rank)``: the ``k`` rows nearest to each vector of a stated query set, by exact cosine.

    The queries are met in blocks of about ``block``, each broadcast to all rows, so that what is broadcast doesn't grow with the data.
    """
    from pyspark.sql import Window

    q = queries.select(F.col(ident).alias("query"), F.col(vector).alias("qv"))
    blocks = max(1, -(-q.count() // block))
    rows = df.select(F.col(ident).alias("id"), F.col(vector).alias("v"))
    best = None
    for i in range(blocks):
        part = q if blocks == 1 else q.filter(F.pmod(F.xxhash64("query"), F.lit(blocks)) == i)
        scored = rows.join(F.broadcast(part), F.col("query") != F.col("id")).select("query", "id", cosine(F.col("qv"), F.col("v")).alias("similarity"))
        best = scored if best is None else best.unionByName(scored)
    return best.withColumn("rank", F.row_number().over(Window.partitionBy("query").orderBy(F.desc("similarity"), "id"))).filter(F.col("rank") <= k)
