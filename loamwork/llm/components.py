"""Connected components by alternating large-star and small-star joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loamwork.plans.durable import cut
from loamwork.plans.skew import hot_keys, skew_join


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One star step over edges ``(u, v)`` with ``u > v``.

    Large star: every node ties its larger neighbours to the least of itself and its neighbours. Small star: every
    node ties its smaller neighbours and itself to the least of them.
    """
    if large:
        both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    else:
        both = edges
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    hot = hot_keys(both, ["u"]) if large else []
    met = skew_join(both, least, "u", hot=hot)
    if large:
        out = met.filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = met.filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
    return out.filter("u <> v").distinct()


def connected_components(links: DataFrame, a: str, b: str, max_rounds: int = 60) -> DataFrame:
    """``(node, component)`` for every node of the links ``(a, b)``; the component is its least node.

    Links from a node to itself or with a null end are ignored (a node with no other link has no row, callers
    treat it as its own component). Repeated links count once. The number of rounds is logarithmic in the longest
    chain; after ``max_rounds`` without a fixed point it raises rather than return a partial answer.
    """
    x, y = F.col(f"`{a}`"), F.col(f"`{b}`")
    edges = cut(links.select(F.greatest(x, y).alias("u"), F.least(x, y).alias("v"), x.isNull().alias("n"), y.isNull().alias("k")).filter("u <> v and not n and not k").select("u", "v").distinct())
    print_of = lambda e: e.agg(F.count("*").alias("n"), F.sum(F.hash("u", "v").cast("long")).alias("h"), F.sum(F.xxhash64("u", "v") % 1_000_003).alias("x")).first()
    before = print_of(edges)
    for _ in range(max_rounds):
        edges = cut(_star(_star(edges, large=True), large=False))
        after = print_of(edges)
        if after == before:
            roots = edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
            return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
        before = after
    raise RuntimeError(f"no fixed point after {max_rounds} rounds")
