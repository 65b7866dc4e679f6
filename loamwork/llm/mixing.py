"""Mixing sources to target weights by pivotal dependent rounding."""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loamwork.plans.durable import cut

#: Fixed value: the splitting pattern that the public vocabulary's ranks were made for.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Partitions whose leftovers meet in one task of the next level of the reduction tree.
FAN_IN = 16
_EPS = 1e-9


def token_counts(df: DataFrame, ident: str, text: str, source: str, tokenizer: str = TOKENIZER, pattern: str = PATTERN) -> DataFrame:
    """``(id, source, tokens)``: whole texts measured by a public byte-level BPE; ``tokenizer`` is the path of its ranks on every node."""
    kind = df.schema[ident].dataType.simpleString()

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import tiktoken

        with open(tokenizer, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        enc = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        for pdf in parts:
            pdf["tokens"] = [len(enc.encode_ordinary(t)) for t in pdf["t"]]
            yield pdf[["id", "source", "tokens"]]

    rows = df.select(F.col(f"`{ident}`").alias("id"), F.lower(F.trim(F.col(f"`{source}`"))).alias("source"), F.col(f"`{text}`").cast("string").alias("t")).filter("id is not null and source <> '' and t is not null")
    return rows.mapInPandas(run, f"id {kind}, source string, tokens bigint")


def plan(sizes: DataFrame, targets: DataFrame) -> pd.DataFrame:
    """One row a target source: its share, the tokens it should give and the expected copies of each of its documents.

    The mixture is the largest for which every source with tokens reaches its share, with the shares of sources without
    tokens spread over the others in proportion. Bounded by the number of target rows.
    """
    want = targets.select(F.lower(F.trim("source")).alias("source"), F.col("target_share").cast("double"), F.col("max_repeats").cast("long")).dropna().filter("source <> '' and target_share > 0 and max_repeats > 0").groupBy("source").agg(F.max("target_share").alias("target_share"), F.max("max_repeats").alias("max_repeats")).toPandas()
    have = sizes.groupBy("source").agg(F.sum("tokens").alias("have"), F.count("*").alias("documents")).filter(F.col("source").isin(list(want["source"]))).toPandas()
    out = want.merge(have, "left", "source").fillna({"have": 0, "documents": 0}).sort_values("source")
    usable = out["have"] > 0
    share = np.where(usable, out["target_share"], 0.0)
    share = share / share.sum() if share.sum() else share
    out["share"] = share
    room = np.divide(out["max_repeats"] * out["have"], share, out=np.full(len(out), np.inf), where=share > 0)
    total = room.min() if usable.any() else 0.0
    out["goal"] = share * total
    out["copies"] = np.divide(out["goal"], out["have"], out=np.zeros(len(out)), where=usable)
    out["copies"] = np.minimum(out["copies"], out["max_repeats"])
    return out


def _pivot(pdf: pd.DataFrame, seed: int) -> pd.DataFrame:
    """Round the probabilities ``p`` of one source's documents, one after another in the order of their ids.

    Two fractional ones meet: tokens are moved from one to the other, in a direction drawn so that both keep their
    expectation, until one is 0 or 1. The expected tokens, sum of p times tokens, stay as they are; at most one document stays fractional.
    """
    p, w = pdf["p"].to_numpy(copy=True), np.maximum(pdf["tokens"].to_numpy(), 1).astype(float)
    rng = np.random.default_rng([seed, int(pd.util.hash_pandas_object(pdf["id"].iloc[:1], index=False).iloc[0] % (1 << 32)), len(p)])
    draws, held = rng.random(len(p)), -1
    for i in range(len(p)):
        if p[i] <= _EPS or p[i] >= 1 - _EPS:
            p[i] = round(p[i])
            continue
        if held < 0:
            held = i
            continue
        j = held
        up = min((1 - p[i]) * w[i], p[j] * w[j])  # tokens that can move from j to i
        down = min(p[i] * w[i], (1 - p[j]) * w[j])
        if draws[i] * (up + down) < down:
            p[i] += up / w[i]
            p[j] -= up / w[j]
        else:
            p[i] -= down / w[i]
            p[j] += down / w[j]
        loose = [k for k in (i, j) if _EPS < p[k] < 1 - _EPS]
        for k in (i, j):
            if k not in loose:
                p[k] = round(p[k])
        held = loose[0] if loose else -1
    return pdf.assign(p=p)


def mixture(sizes: DataFrame, targets: DataFrame, *, seed: int = 1, bucket_rows: int = 20_000, fan_in: int = FAN_IN) -> tuple[DataFrame, pd.DataFrame]:
    """``(id, source, tokens, copies)`` of all documents used at least once, and the plan.

    ``sizes`` is what ``token_counts`` gives, ``targets`` has ``source, target_share, max_repeats``. A document of a source
    with expected copies c is used floor(c) times, and once more with probability c - floor(c) by pivotal rounding: first
    within buckets of about ``bucket_rows`` documents of one source, then the one leftover of each bucket meets those of ``fan_in`` - 1
    other buckets, level by level, until one leftover a source is left, which is rounded by its own draw. So a source
    misses its goal by less than one document. No copy count exceeds ``max_repeats``. Documents of sources without target are
    left out; a document without tokens is never used. Rows with one id count once each.
    """
    spark = sizes.sparkSession
    sizes = cut(sizes)
    todo = plan(sizes, targets)
    use = todo[(todo["goal"] > 0)]
    kind = dict(sizes.dtypes)["id"]
    if not len(use):
        return spark.createDataFrame([], f"id {kind}, source string, tokens bigint, copies bigint"), todo
    pairs = [F.lit(x) for r in use.itertuples() for x in (r.source, float(r.copies))]
    buckets = [F.lit(x) for r in use.itertuples() for x in (r.source, int(-(-r.documents // bucket_rows)))]
    c = F.element_at(F.create_map(*pairs), F.col("source"))
    rows = sizes.filter(F.col("source").isin(list(use["source"])) & (F.col("tokens") > 0)).withColumn("c", c)
    rows = rows.select("id", "source", "tokens", F.floor("c").cast("double").alias("base"), (F.col("c") - F.floor("c")).alias("p"), F.pmod(F.xxhash64("id", F.lit(seed)), F.element_at(F.create_map(*buckets), F.col("source")).cast("long")).alias("bucket"))
    schema = rows.schema

    def level(df: DataFrame, n: int) -> DataFrame:
        return cut(df.groupBy("source", "bucket").applyInPandas(lambda g: _pivot(g.sort_values(["id", "tokens"], kind="stable"), seed + n), schema))

    loose = (F.col("p") > _EPS) & (F.col("p") < 1 - _EPS)
    most, n, settled = int(-(-use["documents"].max() // bucket_rows)), 0, []
    rows = level(rows, n)
    while most > 1:
        settled.append(rows.filter(~loose))
        most, n = -(-most // fan_in), n + 1
        rows = level(rows.filter(loose).withColumn("bucket", F.floor(F.col("bucket") / fan_in)), n)
    last = F.when(loose, (F.pmod(F.xxhash64("id", F.lit(seed + 77)), F.lit(1_000_003)) / 1_000_003 < F.col("p")).cast("double")).otherwise(F.round("p"))
    rows = rows.withColumn("p", last)
    for s in settled:
        rows = rows.unionByName(s)
    return rows.select("id", "source", "tokens", (F.col("base") + F.round("p")).cast("long").alias("copies")).filter("copies > 0"), todo


def mixture_report(used: DataFrame, todo: pd.DataFrame) -> DataFrame:
    """One row a target source: target share, share reachable without the sources that have nothing, and the actual share, documents, copies and tokens."""
    spark = used.sparkSession
    got = used.groupBy("source").agg(F.sum(F.col("tokens") * F.col("copies")).alias("used_tokens"), F.count("*").alias("used_documents"), F.max("copies").alias("most_copies"))
    rows = [(r.source, float(r.target_share), float(r.share), int(r.max_repeats), int(r.have)) for r in todo.itertuples()]
    want = spark.createDataFrame(rows, "source string, target_share double, reachable_share double, max_repeats bigint, available_tokens bigint")
    out = want.join(got, "source", "left").fillna(0, ["used_tokens", "used_documents", "most_copies"])
    total = used.agg(F.sum(F.col("tokens") * F.col("copies"))).first()[0] or 0
    return out.withColumn("actual_share", F.col("used_tokens") / F.lit(float(total)) if total else F.lit(0.0))
