"""Top N items of every group by simultaneous bisection of per-group cutoffs.

Every row gets an order-preserving code: the score, then the identifier's bytes, as a list of integers
("digits") of which larger is better. All groups are refined at once, digit by digit: one pass counts the rows
above 2**BITS - 1 evenly spaced midpoints between each group's bounds (BITS bisections in one), which narrows the
bounds; a group is settled when exactly the missing number of rows lies at or above its cutoff. Only counts by
(group, midpoint) are shuffled, combined map-side, so a group with a third of all rows costs no task more than any other.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loamwork.plans.durable import cut
from loamwork.plans.skew import hot_keys, skew_join

#: Bisections counted in one pass.
BITS = 8
#: Bytes of an identifier in one digit.
WIDTH = 6


def _digit(k: int, textual: bool):
    """Digit ``k`` of the code as a BIGINT whose range never overflows a difference; text digits start at the byte after ``skip``."""
    if k == 0:
        return F.shiftright("__score", 32)
    if k == 1:
        return F.col("__score").bitwiseAND(0xFFFFFFFF)
    if not textual:
        return -F.shiftright("__id", 32) if k == 2 else -F.col("__id").bitwiseAND(0xFFFFFFFF)
    piece = F.expr(f"substring(encode(__id, 'UTF-8'), skip + 1, {WIDTH})")
    value = F.conv(F.rpad(F.hex(piece), 2 * WIDTH, "0"), 16, 10).cast("long")
    # a missing byte sorts before a zero byte: the number of bytes present is the last, lowest part
    return -(value * 8 + F.octet_length(piece))


def _with_skip(rows: DataFrame, hot: list[tuple]) -> DataFrame:
    """Adds ``skip``, the bytes that all identifiers of the group have in common, so that every digit divides its group."""
    ends = rows.groupBy("__g").agg(F.hex(F.encode(F.min("__id"), "UTF-8")).alias("a"), F.hex(F.encode(F.max("__id"), "UTF-8")).alias("b"))
    differ = F.expr("array_position(transform(sequence(1, greatest(1, least(length(a), length(b)) div 2)), i -> substr(a, 2 * i - 1, 2) <> substr(b, 2 * i - 1, 2)), true)")
    common = F.when(differ > 0, differ - 1).otherwise(F.expr("least(length(a), length(b)) div 2")).cast("int")
    return skew_join(rows, ends.select("__g", common.alias("skip")), "__g", hot=hot)


def top_n_per_group(df: DataFrame, group: str, score: str, ident: str, n: int, bits: int = BITS) -> DataFrame:
    """Rows ``(group, score, ident)`` of the ``n`` best identifiers of each group.

    Larger scores win, equal scores go to the smaller identifier (bytes of its UTF-8 form, or numeric). ``score``
    must be integral, ``ident`` integral or string. Rows with a null in any of the three columns take no part; of
    rows with the same group and identifier the best score counts, so repeated rows count once. Other columns
    are ignored, whatever their names. A group with fewer than ``n`` identifiers gives all of them; an empty
    table, or ``n`` below 1, gives no rows.
    """
    kinds = dict(df.dtypes)
    if kinds[score] not in ("tinyint", "smallint", "int", "bigint"):
        raise TypeError(f"{score} must be integral")
    textual = kinds[ident] == "string"
    out = T.StructType([T.StructField(group, df.schema[group].dataType), T.StructField(score, T.LongType()), T.StructField(ident, df.schema[ident].dataType)])
    rows = (
        df.select(F.col(f"`{group}`").alias("__g"), F.col(f"`{score}`").cast("long").alias("__score"), (F.col(f"`{ident}`") if textual else F.col(f"`{ident}`").cast("long")).alias("__id"))
        .dropna()
        .groupBy("__g", "__id")
        .agg(F.max("__score").alias("__score"))
    )
    rows = cut(rows)
    hot = hot_keys(rows, ["__g"])
    need = rows.select("__g").distinct().withColumn("need", F.lit(n).cast("long"))
    kept: list[DataFrame] = []
    k, last = 0, 4 if not textual else 1_000_000
    while n > 0 and k < last:
        stage = (_with_skip(rows, hot) if k >= 2 and textual else rows).withColumn("__v", _digit(k, textual)).drop("skip")
        final = _settle(stage, need, bits, hot)
        if final is None:
            break
        # need 0: settled, the rows at or above the cutoff are in; else rows equal to it tie and go on to the next digit
        met = cut(skew_join(stage, final, "__g", hot=hot).filter("__v >= at"))
        kept.append(met.filter((F.col("__v") > F.col("at")) | ((F.col("__v") == F.col("at")) & (F.col("need") == 0))).select("__g", "__score", "__id"))
        rest = met.filter((F.col("__v") == F.col("at")) & (F.col("need") > 0)).select("__g", "__id", "__score", "need")
        if rest.isEmpty():
            break
        need = rest.groupBy("__g").agg(F.first("need").alias("need"))
        rows = rest.drop("need")
        k += 1
    if not kept:
        return df.sparkSession.createDataFrame([], out)
    got = kept[0]
    for more in kept[1:]:
        got = got.unionByName(more)
    return got.select(F.col("__g").alias(group), F.col("__score").alias(score), F.col("__id").cast(out[ident].dataType).alias(ident))


def _settle(stage: DataFrame, need: DataFrame, bits: int, hot: list[tuple]) -> DataFrame | None:
    """For each group its cutoff ``at`` on this digit and what is still missing among the rows equal to it (0: none)."""
    state = (
        stage.groupBy("__g").agg(F.count("*").alias("n"), F.min("__v").alias("lo"), F.max("__v").alias("hi")).join(need, "__g")
        .select("__g", "lo", "hi", "need", (F.col("n") <= F.col("need")).alias("whole"), "n")
    )
    done: list[DataFrame] = []
    while True:
        state = cut(state)
        settled = F.col("whole") | (F.col("lo") == F.col("hi"))
        done.append(state.filter(settled).select("__g", F.when(F.col("whole"), F.col("lo")).otherwise(F.col("hi")).alias("at"), F.when(F.col("whole"), F.lit(0).cast("long")).otherwise(F.col("need")).alias("need")))
        active = state.filter(~settled)
        if active.isEmpty():
            break
        active = active.select("__g", "lo", "hi", "need", F.expr(f"(hi - lo) div {1 << bits} + 1").alias("step"))
        inside = skew_join(stage.select("__g", "__v"), active, "__g", hot=hot).filter("__v between lo and hi")
        counts = (
            inside.withColumn("slot", F.expr("(__v - lo) div step"))
            .groupBy("__g", "slot").agg(F.count("*").alias("n"), F.min("__v").alias("lo"), F.max("__v").alias("hi"), F.first("need").alias("need"))
        )
        # at most 2**bits slots a group: the cutoff is in the highest slot that brings the rows above it to the number needed
        slots = counts.groupBy("__g", "need").agg(F.sort_array(F.collect_list(F.struct("slot", "n", "lo", "hi")), asc=False).alias("s"))
        found = slots.select(
            "__g", "need",
            F.expr("aggregate(s, struct(0L as above, cast(null as struct<slot:bigint,n:bigint,lo:bigint,hi:bigint>) as hit), (a, x) -> if(a.hit is not null, a, if(a.above + x.n >= need, struct(a.above as above, x as hit), struct(a.above + x.n as above, a.hit as hit))))").alias("f"),
        )
        state = found.select("__g", F.col("f.hit.lo").alias("lo"), F.col("f.hit.hi").alias("hi"), (F.col("need") - F.col("f.above")).alias("need"), (F.col("f.hit.n") == F.col("need") - F.col("f.above")).alias("whole"), F.col("f.hit.n").alias("n"))
    if not done:
        return None
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out
