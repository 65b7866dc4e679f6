"""Set operations, similarity of character grams and near-duplicate removal."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loamwork.functions.text import char_ngrams
from loamwork.plans.durable import cut


def jaccard(a: Column, b: Column) -> Column:
    """Shared over all distinct elements; two empty sets give 0."""
    both = F.size(F.array_intersect(a, b))
    return F.coalesce(F.try_divide(both, F.size(F.array_union(a, b))), F.lit(0.0))


#: So many of the most frequent grams, at most, are ordered by their counts and broadcast for it; all others go before them.
FREQUENT = 1 << 16


def _gram_sets(df: DataFrame, ident: str, text: str, first: Column, n: int) -> tuple[DataFrame, DataFrame, str]:
    """Rows ``(id, m, h1, h2)`` with 128 bits of hash of their gram sets, one row ``(h1, h2, c, m, id)`` a set, that of least ``m`` and identifier, and the column with the text."""
    keep = ["id"] if text == ident else ["id", "t"]
    rows = df.select(F.col(ident).alias("id"), F.col(text).alias("t"), first.alias("m"), F.array_join(char_ngrams(F.col(text), n), "\n").alias("g")).filter("id is not null and t is not null")
    rows = rows.withColumns({"h1": F.xxhash64("g"), "h2": F.xxhash64(F.lit("second"), "g")})
    rows = cut(rows.select("m", "h1", "h2", *keep))
    best = F.min(F.struct(F.col("m").isNull(), "m", *keep))
    return rows, rows.groupBy("h1", "h2").agg(F.count("*").alias("c"), best.alias("b")).select("h1", "h2", "c", *[f"b.{c}" for c in ("m", *keep)]), keep[-1]


def _heads(rows: DataFrame, classes: DataFrame, t: str, threshold: float, n: int) -> tuple[DataFrame, DataFrame]:
    """The first grams of each set, once as the smaller (columns ``a_``) and once as the larger set of a pair (``b_``), for `_alike`.

    Grams are ordered from rare to frequent. Sets of a and b grams are alike if they share t / (1 + t) * (a + b) or more, so the first gram of both is
    followed by so many in each. That leaves few places, and in the smaller set fewer than in the larger.
    """
    frequent = cut(rows.select(F.explode(char_ngrams(F.col(t), n)).alias("x")).groupBy("x").agg(F.count("*").alias("df")).orderBy(F.desc("df"), "x").limit(FREQUENT))
    keep = list(dict.fromkeys(["m", "id", t]))
    # the grouping needs no exchange: the sets are where their hashes are
    grams = classes.select("h1", "h2", F.struct(*keep).alias("k"), F.explode(char_ngrams(F.col(t), n)).alias("x")).join(F.broadcast(frequent), "x", "left").withColumn("h", F.xxhash64("x"))
    bit = F.expr("shiftleft(1L, cast(h & 63 as int))")
    parity = [F.bit_xor(F.when(F.col("h").bitwiseAND(64) == v, bit).otherwise(F.lit(0).cast("long"))).alias(k) for v, k in ((0, "p"), (64, "q"))]
    order = F.sort_array(F.collect_list(F.struct(F.coalesce("df", F.lit(0)).alias("df"), "x", "h")))
    size = F.size("o")
    places = lambda share: (size - F.ceil(size * share - 1e-9) + 1).cast("int")
    sets = grams.groupBy("h1", "h2").agg(F.first("k").alias("k"), *parity, order.alias("o"))
    sets = cut(sets.select("k.*", "p", "q", size.alias("n"), F.slice("o.h", F.lit(1), places(threshold)).alias("o"), places(2 * threshold / (1 + threshold)).alias("few")))
    small, large = (sets.select(*keep, "p", "q", "n", F.posexplode(o).alias("i", "h")) for o in (F.slice("o", F.lit(1), F.col("few")), F.col("o")))
    return small.toDF(*[f"a_{c}" for c in small.columns]), large.toDF(*[f"b_{c}" for c in large.columns])


def _alike(rows: DataFrame, classes: DataFrame, t: str, threshold: float, n: int) -> DataFrame:
    """Different gram sets alike by ``threshold`` or more, with their ``similarity``: a row for each gram of `_heads` that both have, columns ``a_`` and ``b_``.

    The join has cheap conditions only (places of the gram, bits in which the parities differ); what passes is compared exactly, in the same stage.
    """
    small, large = _heads(rows, classes, t, threshold, n)
    both = F.col("a_n") + F.col("b_n")
    shared = both * (threshold / (1 + threshold)) - 1e-9
    differ = F.bit_count(F.col("a_p").bitwiseXOR(F.col("b_p"))) + F.bit_count(F.col("a_q").bitwiseXOR(F.col("b_q")))
    once = (F.col("a_n") < F.col("b_n")) | ((F.col("a_n") == F.col("b_n")) & (F.col("a_id") < F.col("b_id")))
    pairs = small.join(large, (F.col("a_h") == F.col("b_h")) & (F.col("a_n") - F.col("a_i") >= shared) & (F.col("b_n") - F.col("b_i") >= shared) & (differ <= both - 2 * shared) & once)
    # generated, as a filter would become a condition of the join and be taken out of the reach of its cheaper conditions
    common = F.size(F.array_intersect(char_ngrams(F.col(f"a_{t}"), n), char_ngrams(F.col(f"b_{t}"), n)))
    return pairs.select("*", F.explode_outer(F.array(common)).alias("common")).withColumn("similarity", F.col("common") / (both - F.col("common"))).filter(F.col("similarity") >= threshold)


def similar_pairs(df: DataFrame, ident: str, text: str, threshold: float, n: int = 3) -> tuple[DataFrame, DataFrame]:
    """``(a, b, similarity)`` with a < b and the members ``(rep, id)`` of equal sets: texts whose sets of character grams are alike by ``threshold`` or more.

    Exact, by `_heads`. Sets are told apart by 128 bits of hash; each is named by its least identifier.
    """
    rows, classes, t = _gram_sets(df, ident, text, F.lit(0), n)
    near = _alike(rows, classes, t, threshold, n).select(F.least("a_id", "b_id").alias("a"), F.greatest("a_id", "b_id").alias("b"), "similarity").distinct()
    return cut(near), cut(rows.join(classes.select("h1", "h2", F.col("id").alias("rep")), ["h1", "h2"]).select("rep", "id").distinct())


def drop_near_duplicates(df: DataFrame, ident: str, text: str, score: str, threshold: float, n: int = 3) -> DataFrame:
    """Rows that lose to no similar row: of two alike ones the lower score loses, at equal scores the larger identifier.

    A row loses even to a row that is itself dropped. Of the pairs only the losers are kept, once a task.
    """
    beats = lambda x, y: (F.col(f"{x}m") < F.col(f"{y}m")) | ((F.col(f"{x}m") == F.col(f"{y}m")) & (F.col(f"{x}id") < F.col(f"{y}id")))
    rows, classes, t = _gram_sets(df, ident, text, -F.col(score), n)
    # within one gram set all but the best lose; between sets the best of one loses if that of another beats it
    several = classes.filter("c > 1").select("h1", "h2", F.col("m").alias("b_m"), F.col("id").alias("b_id"))
    within = rows.join(several, ["h1", "h2"]).filter(beats("b_", "")).select("id")
    # the count is named here so that the choice isn't made for pairs that aren't alike
    alike = F.col("common") >= 0
    between = _alike(rows, classes, t, threshold, n).select(F.when(alike & beats("b_", "a_"), F.col("a_id")).when(alike & beats("a_", "b_"), F.col("b_id")).alias("id"))
    losers = within.unionByName(between).select(F.col("id").alias(ident)).distinct()
    return df.join(losers, ident, "left_anti")


def merge_maps(old: Column, new: Column) -> Column:
    """Both maps in one, entries of ``new`` winning; a null map counts as empty."""
    old, new = F.coalesce(old, F.create_map().cast("map<string,bigint>")), F.coalesce(new, F.create_map().cast("map<string,bigint>"))
    return F.map_zip_with(old, new, lambda k, a, b: F.coalesce(b, a))


def repeats(df: DataFrame, key: str, order: str) -> DataFrame:
    """Rows whose key came before, in the given order, with the number of the occurrence."""
    from pyspark.sql import Window

    return df.withColumn("occurrence", F.row_number().over(Window.partitionBy(key).orderBy(order))).filter("occurrence > 1")


def wanted_and_available(wanted: DataFrame, have: DataFrame, key: str) -> DataFrame:
    """One row ``(matched, missing)``: how many distinct wanted keys are there and how many aren't."""
    w = wanted.select(key).dropna().distinct().join(have.select(key, F.lit(1).alias("_h")).distinct(), key, "left")
    return w.agg(F.count_if(F.col("_h").isNotNull()).alias("matched"), F.count_if(F.col("_h").isNull()).alias("missing"))
