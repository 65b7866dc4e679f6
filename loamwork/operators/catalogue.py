"""Catalogue operators: topic scores, category inference, versions, providers, upserts and pagination."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loamwork.functions.versions import named_version

#: Topics that one call can score against; they travel in the plan.
MOST_TOPICS = 1_000


def topic_scores(items: DataFrame, ident: str, text: Column, category: Column, topics: DataFrame, related: int = 12, most: int = 12) -> DataFrame:
    """``(id, topic, score)`` for topics ``(topic, category, terms)``, a bounded table.

    A related category gives ``related``; a term of at least 3 characters found in the text gives 3 + 2 per word, at most ``most``,
    else up to 6 for its words of at least 4 characters that are found. Repeated terms count each time.
    """
    listed = topics.select("topic", "category", "terms").limit(MOST_TOPICS + 1).collect()
    if len(listed) > MOST_TOPICS:
        raise ValueError(f"more than {MOST_TOPICS} topics")
    every = F.array(*[F.struct(F.lit(r["topic"]).alias("topic"), F.lit(r["category"]).alias("category"), F.array(*[F.lit(t) for t in r["terms"]]).cast("array<string>").alias("terms")) for r in listed])
    pairs = items.select(F.col(ident).alias("id"), F.lower(text).alias("t"), category.alias("c"), F.explode(every).alias("p")).select("id", "t", "c", "p.*")

    def term(x: Column) -> Column:
        words = F.split(x, " ")
        whole = F.least(F.lit(most), F.lit(3) + 2 * F.size(words))
        parts = F.least(F.lit(6), F.size(F.filter(words, lambda w: (F.length(w) >= 4) & F.contains(F.col("t"), w))))
        return F.when(F.length(x) < 3, 0).when(F.contains(F.col("t"), x), whole).otherwise(parts)

    total = F.aggregate(F.transform("terms", lambda x: term(F.lower(x))), F.lit(0), lambda a, b: a + b)
    return pairs.select("id", "topic", (F.when(F.col("c") == F.col("category"), related).otherwise(0) + total).alias("score"))


def infer_category(items: DataFrame, ident: str, given: Column, text: Column, keywords: DataFrame) -> DataFrame:
    """``(id, category, confidence)``: the given category with 1.0, else the one with most keywords in the text (0.5 and more), else the identifier's last part with 0.1.

    ``keywords`` is a bounded table ``(keyword, category)``; equal counts go to the smaller name.
    """
    rows = items.select(F.col(ident).alias("id"), given.alias("given"), F.split(F.lower(text), r"[^a-z0-9]+").alias("w"))
    hits = rows.select("id", F.explode(F.array_distinct("w")).alias("keyword")).join(keywords, "keyword").groupBy("id", "category").agg(F.count("*").alias("n"))
    best = hits.groupBy("id").agg(F.min(F.struct((-F.col("n")).alias("n"), "category")).alias("b"))
    own = F.regexp_extract("id", r"([^-/]+)$", 1)
    out = rows.join(best, "id", "left")
    has = F.coalesce(F.trim("given") != "", F.lit(False))
    return out.select(
        "id",
        F.when(has, F.trim("given")).otherwise(F.coalesce("b.category", own)).alias("category"),
        F.when(has, F.lit(1.0)).when(F.col("b").isNotNull(), F.least(F.lit(0.9), 0.4 - 0.1 * F.col("b.n"))).otherwise(0.1).alias("confidence"),
    )


def newest(df: DataFrame, name: str, pattern: str) -> DataFrame:
    """The row with the highest version among those whose name matches; equal versions go to the smaller name."""
    some = df.filter(F.col(name).rlike(pattern)).withColumn("_v", named_version(F.col(name)))
    return some.orderBy(F.desc("_v"), name).limit(1).drop("_v")


def first_provider(df: DataFrame, key: str, provider: str, order: list[str], fields: list[str]) -> DataFrame:
    """Of each key the fields of the first provider in ``order`` that has any of them."""
    rank = F.array_position(F.array(*[F.lit(x) for x in order]), F.col(provider))
    has = F.coalesce(*[F.col(f).cast("string") for f in fields]).isNotNull()
    return df.filter(has & (rank > 0)).groupBy(key).agg(F.min(F.struct(rank.alias("r"), F.col(provider), *fields)).alias("m")).select(key, f"m.{provider}", *[f"m.{f}" for f in fields])


def upsert(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """All rows of ``new`` and those of ``old`` with other keys."""
    return old.join(new.select(key).distinct(), key, "left_anti").unionByName(new)


def untranslated(glossaries: DataFrame, terms: str, total: str) -> DataFrame:
    """Adds ``missing`` (terms with a null or blank translation, sorted) and ``ok``: none missing and as many terms as stated."""
    missing = F.array_sort(F.map_keys(F.map_filter(terms, lambda k, v: v.isNull() | (F.trim(v) == ""))))
    return glossaries.withColumn("missing", missing).withColumn("ok", (F.size("missing") == 0) & (F.size(F.map_keys(terms)) == F.col(total)))


def ranked_with_fill(scores: DataFrame, key: str, score: str, position: str, n: int) -> DataFrame:
    """The ``n`` best rows of each key by score, then by position; rows of score 0 fill up what the positive ones leave. ``n`` below 1 gives none."""
    from pyspark.sql import Window

    w = Window.partitionBy(key).orderBy(F.desc(score), position)
    return scores.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= max(n, 0))


def top_entries(df: DataFrame, ident: str, order: list[Column], n: int) -> DataFrame:
    """The first ``n`` rows in the given order, each identifier once with its best row."""
    best = df.filter(F.col(ident).isNotNull()).groupBy(ident).agg(F.min(F.struct(*[c.alias(f"_{i}") for i, c in enumerate(order)], F.struct(*[F.col(c) for c in df.columns]).alias("_row"))).alias("_m"))
    return best.orderBy("_m", ident).limit(n).select("_m._row.*")


def state_of_groups(latest: DataFrame, name: str, state: str, groups: dict[str, list[str]], done: str = "success") -> DataFrame:
    """``(group, state)`` for groups of alternative names: ``done`` if the latest run of any of them is, 'pending' otherwise, unseen ones too."""
    spark = latest.sparkSession
    wanted = spark.createDataFrame([(g, n) for g, names in groups.items() for n in names], "group string, name string")
    met = wanted.join(latest.select(F.col(name).alias("name"), F.col(state).alias("s")), "name", "left")
    return met.groupBy("group").agg(F.when(F.max(F.coalesce(F.col("s") == done, F.lit(False))), done).otherwise("pending").alias("state"))
