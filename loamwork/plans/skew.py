"""Joins and groupings that keep a bounded amount of work per task whatever the key distribution."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A key is hot when it has more than 1/HOT_SHARE of all rows, so there are fewer than HOT_SHARE hot keys.
HOT_SHARE = 400


def hot_keys(df: DataFrame, keys: Sequence[str], share: int = HOT_SHARE, floor: int = 20_000) -> list[tuple]:
    """Keys with more than ``max(floor, rows / share)`` rows: fewer than ``share`` of them, whatever the data.

    Counts are combined map-side; only the hot keys reach the driver.
    """
    counts = df.groupBy(*keys).count().filter(F.col("count") > floor)
    rows = counts.orderBy(F.desc("count")).limit(share).collect()
    if not rows:
        return []
    total = df.count()
    return [tuple(r[k] for k in keys) for r in rows if r["count"] > total / share]


def is_hot(keys: Sequence[str], hot: list[tuple]) -> Column:
    if len(keys) == 1:
        return F.coalesce(F.col(keys[0]).isin([h[0] for h in hot if h[0] is not None]), F.lit(False))
    return F.coalesce(F.struct(*keys).isin([F.struct(*[F.lit(v) for v in h]) for h in hot]), F.lit(False))


def skew_join(big: DataFrame, small: DataFrame, key: str, how: str = "inner", hot: list[tuple] | None = None) -> DataFrame:
    """Join ``big`` with ``small``, which has at most one row a key.

    Rows of hot keys meet a broadcast of the fewer than ``HOT_SHARE`` rows that ``small`` has for them; all
    others meet by shuffle, where no key has more than its share of rows.
    """
    hot = hot_keys(big, [key]) if hot is None else hot
    if not hot:
        return big.join(small, key, how)
    flag = is_hot([key], hot)
    warm = big.filter(flag).join(F.broadcast(small.filter(flag)), key, how)
    cold = big.filter(~flag).join(small.filter(~flag), key, how)
    return warm.unionByName(cold)
