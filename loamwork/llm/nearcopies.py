"""Near-copies of records by a binary trie self-join with a Hamming error budget; exact.

A record is its set of words. Two sets of a and b words with Jaccard similarity t or more differ in at most
E = (1 - t) / (1 + t) * (a + b) words: the error budget of the pair. The trie's bits are, first, the words themselves from the rarest to the most
frequent (is it in the set?), then the bits of a parity sketch of the words that are left.

Two sets pass the first bits together until the first word that both hold: every rarer word of either is a differing bit. So that word and
the number of rarer words of the set name the node where a set waits for its partners, and the node is a root of the distributed join: pairs of
nodes with different words need no meeting, since their first common word is elsewhere. A root with more than ``CROWD`` sets is descended by one more common
word, again and again. Below the roots pairs of nodes are traversed together bit by bit, adding up differing bits, and a pair is pruned when these
exceed its budget (two sketches never differ in more bits than the sets in words). What is left is compared word by word, so no link is lost or made up.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loamwork.llm.components import connected_components
from loamwork.plans.durable import cut

#: Buckets of the word and root counts (bounded whatever the data; two words in one bucket only blur the order of the trie's bits or descend a root early).
BUCKETS = 1 << 18
#: Sets of a root beyond which it is descended by a further common word or cut into tiles, and common words at most by which roots are descended.
CROWD, DEPTH = 4_096, 6
#: A descent makes several rows of one, so each level must be this much more crowded to be descended again; below that tiles are cheaper.
FAN = 8
#: Node pairs expanded at once, rows of a task's group, and pairs of rows below which two nodes are compared directly.
SLICE, GROUP_ROWS, LEAF = 1_000_000, 150_000, 256
#: The virtual word that ends every set.
_END = np.uint64(0x5851F42D4C957F2D)


def word_set(*texts: Column) -> Column:
    """Sorted distinct runs of a-z and 0-9 of the lower-cased texts, joined by blanks; null counts as empty."""
    return F.array_sort(F.array_distinct(F.regexp_extract_all(F.lower(F.concat_ws(" ", *texts)), F.lit("([a-z0-9]+)"))))


def _beta(t: float) -> float:
    """Words in which a pair alike by ``t`` can differ, for each of their words."""
    return (1 - t) / (1 + t)


def _mix(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    x = (a ^ (b + np.uint64(0x9E3779B97F4A7C15))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(31))


def _bucket(x: np.ndarray) -> np.ndarray:
    return (x % np.uint64(BUCKETS)).astype(np.int64)


class _Roots:
    """The roots at which each set waits, by the counts so far: of words, then of roots with 1, 2, ... common words."""

    def __init__(self, t: float, words: np.ndarray, crowds: list[np.ndarray], sketch_words: int, limit: int, depth: int):
        self.t, self.words, self.crowds, self.sketch_words, self.limit, self.depth = t, words, crowds, sketch_words, limit, depth

    def __call__(self, size: np.ndarray, h: np.ndarray, level: int | None = None):
        """(set, root, differing words so far, sketch of the words left); with ``level`` only the roots of that many common words."""
        with np.errstate(over="ignore"):
            return self._run(size.astype(np.int64), h, level)

    def _run(self, size, h, level):
        who = np.repeat(np.arange(len(size)), size)
        seen = self.words[_bucket(h)]
        order = np.lexsort((h, seen, who))
        h, seen = h[order], seen[order]
        start = np.cumsum(size) - size
        # a set of n words can differ in n - ceil(t n) of them
        slack = size - np.ceil(self.t * size - 1e-9).astype(np.int64)
        acc = np.zeros((len(h) + 1, self.sketch_words), np.uint64)
        bit = _mix(h, np.uint64(77)) % np.uint64(64 * self.sketch_words)
        acc[np.arange(1, len(h) + 1), (bit >> np.uint64(6)).astype(np.int64)] = np.uint64(1) << (bit & np.uint64(63))
        acc = np.bitwise_xor.accumulate(acc, axis=0)
        # first common word: a word that no other set holds is none
        n = np.minimum(slack + 1, size)
        rec = np.repeat(np.arange(len(size)), n)
        at = np.arange(len(rec)) - np.repeat(np.cumsum(n) - n, n)
        ok = seen[start[rec] + at] > 1
        rec, at = rec[ok], at[ok]
        key, depth = h[start[rec] + at], 1
        out = []
        while len(rec):
            ended = at >= size[rec]
            crowd = self.crowds[depth - 1][_bucket(key)] if depth <= len(self.crowds) else np.zeros(len(key), np.int64)
            deeper = (crowd > self.limit * FAN ** (depth - 1)) & ~ended & (depth < self.depth)
            if level == depth:
                out.append((rec, key, at - (depth - 1), at, crowd))
                break
            if level is None:
                keep = ~deeper
                out.append((rec[keep], key[keep], at[keep] - (depth - 1), at[keep], crowd[keep]))
            rec, at, key = rec[deeper], at[deeper], key[deeper]
            # the next common word: any later one, or the end, while the words passed over fit the set's slack
            most = np.minimum(slack[rec] + depth, size[rec])
            n = np.maximum(most - at, 0)
            again = np.repeat(np.arange(len(rec)), n)
            step = np.arange(len(again)) - np.repeat(np.cumsum(n) - n, n) + 1
            rec, at, key, depth = rec[again], at[again] + step, key[again], depth + 1
            word = np.where(at < size[rec], h[np.minimum(start[rec] + at, len(h) - 1)], _END)
            lone = (at < size[rec]) & (seen[np.minimum(start[rec] + at, len(h) - 1)] <= 1)
            key = _mix(key, word)
            rec, at, key = rec[~lone], at[~lone], key[~lone]
        if not out:
            return (np.zeros(0, np.int64),) * 3 + (np.zeros((0, self.sketch_words), np.uint64), np.zeros(0, np.int64))
        rec, key, differ, at, crowd = (np.concatenate(z) for z in zip(*out, strict=True))
        after = np.minimum(at + 1, size[rec])
        return rec, key, differ, acc[start[rec] + size[rec]] ^ acc[start[rec] + after], crowd


def _count_roots(roots, level: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(BUCKETS, np.int64)
        for b in batches:
            for at in range(0, b.num_rows, 5_000):
                part = b.slice(at, 5_000)
                _, key, *_ = roots.value(part.column(1).to_numpy(), part.column(2).flatten().to_numpy().view(np.uint64), level)
                total += np.bincount(_bucket(key), minlength=BUCKETS)
        on = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(on.astype(np.int32)), pa.array(total[on])], ["bucket", "n"])

    return run


def _bucket_counts(rows: DataFrame) -> np.ndarray:
    """Sums of ``n`` by ``bucket``: at most ``BUCKETS`` rows reach the driver, whatever the data."""
    got = rows.groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(BUCKETS, np.int64)
    out[got.column("bucket").to_numpy()] = got.column("n").to_numpy()
    return out


def _place(roots, groups: int):
    """Rows (group, key, tile, rid, size, differ, s0, ...): each set at its roots; one in a root still crowded goes to all pairs of tiles with its own."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 5_000):
                part = b.slice(at, 5_000)
                rid, size = part.column(0).to_numpy(), part.column(1).to_numpy()
                rec, key, differ, sketch, crowd = roots.value(size, part.column(2).flatten().to_numpy().view(np.uint64))
                tiles = np.maximum(1, -(-crowd // roots.value.limit))
                again = np.repeat(np.arange(len(rec)), tiles)
                other = np.arange(len(again)) - np.repeat(np.cumsum(tiles) - tiles, tiles)
                rec, key, differ, sketch, tiles = rec[again], key[again], differ[again], sketch[again], tiles[again]
                own = (rid[rec].view(np.uint64) % tiles.astype(np.uint64)).astype(np.int64)
                tile = np.minimum(own, other) * tiles + np.maximum(own, other)
                with np.errstate(over="ignore"):
                    group = (_mix(key, tile.astype(np.uint64)) % np.uint64(groups)).astype(np.int32)
                cols = [pa.array(group), pa.array(key.view(np.int64)), pa.array(tile.astype(np.int32)), pa.array(rid[rec]), pa.array(size[rec].astype(np.int32)), pa.array(differ.astype(np.int32))]
                yield pa.RecordBatch.from_arrays([*cols, *(pa.array(np.ascontiguousarray(c).view(np.int64)) for c in sketch.T)], ["group", "key", "tile", "rid", "size", "differ", *(f"s{i}" for i in range(sketch.shape[1]))])

    return run


def _runs(*columns: np.ndarray) -> np.ndarray:
    new = np.ones(len(columns[0]), bool)
    new[1:] = False
    for c in columns:
        new[1:] |= c[1:] != c[:-1]
    return np.flatnonzero(new)


def _join(t: float, sketch_words: int):
    beta = _beta(t)

    def run(table: pa.Table) -> pa.Table:
        key, tile, rid, size, differ = (table.column(n).to_numpy() for n in ("key", "tile", "rid", "size", "differ"))
        s = [table.column(f"s{i}").to_numpy().view(np.uint64) for i in range(sketch_words)]
        order = np.lexsort((*s[::-1], differ, tile, key))
        key, tile, rid, size, differ = (z[order] for z in (key, tile, rid, size, differ))
        s = [z[order] for z in s]
        n, found, ones = len(key), [], {}
        # a root's children are the sets with equally many differing words so far; below them one level a bit
        roots, nodes = _runs(key, tile), _runs(key, tile, differ)
        ends, child_ends = np.append(roots[1:], n), np.append(nodes[1:], n)
        largest = np.maximum.reduceat(size, nodes)

        def compare(ulo, uhi, vlo, vhi, base, budget) -> None:
            """The rows of one node against those of the other, of a node with itself each two once."""
            nu = uhi - ulo
            node = np.repeat(np.arange(len(nu)), nu)
            x = ulo[node] + np.arange(len(node)) - np.repeat(np.cumsum(nu) - nu, nu)
            first = np.where(ulo[node] == vlo[node], x + 1, vlo[node])
            ny = vhi[node] - first
            room = np.minimum(budget - base, 255)[node].astype(np.int16)
            total = np.cumsum(ny)
            lo = 0
            while lo < len(x):
                hi = max(lo + 1, int(np.searchsorted(total, (total[lo - 1] if lo else 0) + SLICE, "right")))
                n_here = ny[lo:hi]
                ends = np.cumsum(n_here)
                y = np.repeat(first[lo:hi] - ends + n_here, n_here)
                y += np.arange(len(y))
                bits = np.bitwise_count(np.repeat(s[0][x[lo:hi]], n_here) ^ s[0][y])
                if sketch_words > 1:
                    bits = bits.astype(np.int16)
                    for z in s[1:]:
                        bits += np.bitwise_count(np.repeat(z[x[lo:hi]], n_here) ^ z[y])
                hit = np.flatnonzero(bits <= np.repeat(room[lo:hi], n_here))
                if len(hit):
                    a, b, all_bits = x[lo:hi][np.searchsorted(ends, hit, "right")], y[hit], bits[hit].astype(np.int64)
                    all_bits = all_bits + differ[a] + differ[b]
                    ok = all_bits <= np.floor(beta * (size[a].astype(float) + size[b]) + 1e-9)
                    ok &= np.minimum(size[a], size[b]) >= t * np.maximum(size[a], size[b]) - 1e-9
                    a, b = rid[a[ok]], rid[b[ok]]
                    if len(a):
                        found.append(np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)], 1), axis=0))
                lo = hi

        def ones_before(depth: int) -> np.ndarray:
            """Rows with bit ``depth`` set before each row; the rows of a node are sorted, so they are its upper child's."""
            if depth not in ones:
                ones[depth] = np.concatenate([[0], np.cumsum((s[depth // 64] >> np.uint64(63 - depth % 64)) & np.uint64(1))]).astype(np.int64)
            return ones[depth]

        def walk(depth: int, ulo, uhi, vlo, vhi, acc, base, budget) -> None:
            todo = [(depth, ulo, uhi, vlo, vhi, acc, base, budget)]
            while todo:
                depth, *arrays = todo.pop()
                if len(arrays[0]) > SLICE:
                    todo += [(depth, *(z[i : i + SLICE] for z in arrays)) for i in range(0, len(arrays[0]), SLICE)]
                    continue
                ulo, uhi, vlo, vhi, acc, base, budget = arrays
                small = (uhi - ulo) * (vhi - vlo) <= LEAF if depth < 64 * sketch_words else np.ones(len(ulo), bool)
                if small.any():
                    compare(*(z[small] for z in (ulo, uhi, vlo, vhi, base, budget)))
                    big = ~small
                    ulo, uhi, vlo, vhi, acc, base, budget = (z[big] for z in (ulo, uhi, vlo, vhi, acc, base, budget))
                if not len(ulo):
                    continue
                c = ones_before(depth)
                um, vm = uhi - (c[uhi] - c[ulo]), vhi - (c[vhi] - c[vlo])
                same = ulo == vlo
                # equal bits add nothing, different ones add one; a node with itself gives its two children crosswise once
                kids = [(ulo, um, vlo, vm, acc, base, budget), (um, uhi, vm, vhi, acc, base, budget), (ulo, um, vm, vhi, acc + 1, base, budget), tuple(z[~same] for z in (um, uhi, vlo, vm, acc + 1, base, budget))]
                kids = [np.concatenate(z) for z in zip(*kids, strict=True)]
                ok = (kids[0] < kids[1]) & (kids[2] < kids[3]) & (kids[4] <= kids[6]) & ((kids[0] != kids[2]) | (kids[1] - kids[0] > 1))
                if ok.any():
                    todo.append((depth + 1, *(z[ok] for z in kids)))

        # pairs of children of every root, in slices
        first, last = np.searchsorted(nodes, roots), np.searchsorted(nodes, ends)
        several = ends - roots > 1
        first, last = first[several], last[several]
        count = (last - first) ** 2
        total = np.concatenate([[0], np.cumsum(count)])
        for lo in range(0, int(total[-1]), SLICE):
            flat = np.arange(lo, min(lo + SLICE, int(total[-1])))
            which = np.searchsorted(total, flat, "right") - 1
            off, wide = flat - total[which], (last - first)[which]
            u, v = first[which] + off // wide, first[which] + off % wide
            acc = (differ[nodes[u]] + differ[nodes[v]]).astype(np.int64)
            budget = np.floor(beta * (largest[u].astype(float) + largest[v]) + 1e-9).astype(np.int64)
            ok = (u <= v) & (acc <= budget)
            u, v = u[ok], v[ok]
            walk(0, nodes[u], child_ends[u], nodes[v], child_ends[v], acc[ok], acc[ok], budget[ok])
        pairs = np.unique(np.concatenate(found), axis=0) if found else np.zeros((0, 2), np.int64)
        return pa.table({"a": pairs[:, 0], "b": pairs[:, 1]})

    return run


def similar_sets(df: DataFrame, ident: str, words: str, threshold: float) -> tuple[DataFrame, DataFrame]:
    """Links between different word sets, and the membership of identifiers in sets.

    Returns ``(links, members)``: ``links`` is ``(set_a, set_b, similarity)`` of every two different sets alike by ``threshold`` or more,
    each set named by its least identifier; ``members`` is ``(set, id)``. ``words`` holds arrays of distinct words; rows with a null
    identifier or array, or without words, take no part. All rows with one set are one member each, never joined among themselves. Sets are told apart by
    128 bits of hash. Every link is found, whatever the counts of words and roots.
    """
    spark, sc = df.sparkSession, df.sparkSession.sparkContext
    joined = F.array_join("w", " ")
    rows = df.select(F.col(f"`{ident}`").alias("id"), F.array_sort(F.col(f"`{words}`")).alias("w")).filter(F.col("id").isNotNull() & (F.size("w") > 0))
    rows = cut(rows.select("id", "w", F.xxhash64(joined).alias("rid"), F.xxhash64(F.lit("second"), joined).alias("rid2")))
    sets = cut(rows.groupBy("rid", "rid2").agg(F.min("id").alias("set"), F.first("w").alias("w")))
    members = rows.select("id", "rid", "rid2").distinct().join(sets.select("rid", "rid2", "set"), ["rid", "rid2"]).select("set", "id")
    about = sets.agg(F.count("*").alias("n"), F.avg(F.size("w")).alias("size")).first()
    if not about["n"]:
        return spark.createDataFrame([], f"set_a {df.schema[ident].dataType.simpleString()}, set_b {df.schema[ident].dataType.simpleString()}, similarity double"), members
    # wide enough that unrelated sets differ in more sketch bits than a usual budget
    sketch_words = min(16, max(1, math.ceil(_beta(threshold) * 8 * about["size"] / 64)))
    source = sets.select("rid", F.size("w").alias("size"), F.transform("w", lambda x: F.xxhash64(x)).alias("h"))
    # xxhash64 as BIGINT: its unsigned value by BUCKETS, a power of two, leaves the same as pmod
    counts = _bucket_counts(source.select(F.explode("h").alias("x")).groupBy(F.pmod("x", F.lit(BUCKETS)).cast("int").alias("bucket")).agg(F.count("*").alias("n")))
    crowds: list[np.ndarray] = []
    waiting = 0
    for level in range(1, DEPTH + 1):
        roots = sc.broadcast(_Roots(threshold, counts, crowds, sketch_words, CROWD, DEPTH))
        crowd = _bucket_counts(source.mapInArrow(_count_roots(roots, level), "bucket int, n bigint"))
        crowds = [*crowds, crowd]
        waiting += int(crowd.sum())
        if not (crowd > CROWD * FAN ** (level - 1)).any():
            break
    roots = sc.broadcast(_Roots(threshold, counts, crowds, sketch_words, CROWD, DEPTH))
    groups = max(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(waiting / GROUP_ROWS))
    schema = "group int, key bigint, tile int, rid bigint, size int, differ int, " + ", ".join(f"s{i} bigint" for i in range(sketch_words))
    found = source.mapInArrow(_place(roots, groups), schema).groupBy("group").applyInArrow(_join(threshold, sketch_words), "a bigint, b bigint")
    pairs = cut(found.distinct())
    left, right = sets.select(F.col("rid").alias("a"), F.col("set").alias("set_a"), F.col("w").alias("wa")), sets.select(F.col("rid").alias("b"), F.col("set").alias("set_b"), F.col("w").alias("wb"))
    both = F.size(F.array_intersect("wa", "wb"))
    near = pairs.join(left, "a").join(right, "b").withColumn("similarity", both / (F.size("wa") + F.size("wb") - both)).filter(F.col("similarity") >= threshold)
    return near.select("set_a", "set_b", "similarity"), members


def near_copy_pairs(df: DataFrame, ident: str, words: str, threshold: float) -> DataFrame:
    """``(a, b)``, the smaller first: pairs between the sets' least identifiers, and of each set's least identifier with its other members."""
    links, members = similar_sets(df, ident, words, threshold)
    pairs = links.select(F.col("set_a").alias("x"), F.col("set_b").alias("y")).unionByName(members.select(F.col("set").alias("x"), F.col("id").alias("y")))
    return pairs.filter("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()


def near_copy_groups(df: DataFrame, ident: str, words: str, threshold: float) -> DataFrame:
    """``(id, group, links)`` for every identifier that takes part: the least identifier of its group of copies and its number of links.

    Groups are connected components; ``links`` counts the pairs of ``near_copy_pairs`` that hold the identifier (0: no copy).
    """
    pairs = cut(near_copy_pairs(df, ident, words, threshold))
    ids = df.filter(F.col(f"`{ident}`").isNotNull() & (F.size(F.col(f"`{words}`")) > 0)).select(F.col(f"`{ident}`").alias("id")).distinct()
    parts = connected_components(pairs, "a", "b").withColumnsRenamed({"node": "id", "component": "group"})
    degree = pairs.select(F.explode(F.array("a", "b")).alias("id")).groupBy("id").agg(F.count("*").alias("links"))
    return ids.join(parts, "id", "left").join(degree, "id", "left").select("id", F.coalesce("group", "id").alias("group"), F.coalesce("links", F.lit(0)).alias("links"))
