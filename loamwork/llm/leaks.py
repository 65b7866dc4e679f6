"""Evaluation texts inside training text: size-partitioned MinHash containment search, then exact shingle containment.

The query sets are passages: every run of ``passage`` words of an item (a shorter item whole), as sets of word
shingles. Documents are long, so each is cut into overlapping windows in which any passage lies whole. Windows are
partitioned by the size of their shingle set; for a partition with at most u shingles a contained passage of q shingles
has a Jaccard similarity of q / u at least, which fixes how many MinHash values (bands of one row) the partition needs for the wanted
recall. A document with a colliding window is a candidate and is compared with the item word by word.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PASSAGE, SHINGLE = 12, 5
#: Chance that a window with a whole passage is missed; a document with more of an item has many such windows.
MISS = 1e-6
#: Passages that are sent to the tasks at once; more items are searched in blocks.
BLOCK = 200_000
_WORD = re.compile(r"[^\W_]+")
_RNG = np.random.default_rng(20_240_601)
_MULT = _RNG.integers(1, 1 << 62, 1_024, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_ADD = _RNG.integers(0, 1 << 63, 1_024, dtype=np.uint64)


def words(text: str) -> list[str]:
    """The longest runs of letters and digits, lower-cased."""
    return _WORD.findall(text.lower())


class _Hasher:
    """64-bit hashes of words, kept for words seen before; bounded."""

    def __init__(self):
        self.known: dict[str, int] = {}

    def __call__(self, ws: list[str]) -> np.ndarray:
        import xxhash

        known = self.known
        if len(known) > 1_000_000:
            known.clear()
        for w in set(ws).difference(known):
            known[w] = xxhash.xxh64_intdigest(w)
        return np.fromiter(map(known.__getitem__, ws), np.uint64, len(ws))


def shingle_hashes(h: np.ndarray, k: int) -> np.ndarray:
    """Hash of each run of ``k`` words; of all the words if there are fewer."""
    k = min(k, len(h))
    out = np.zeros(max(0, len(h) - k + 1), np.uint64)
    with np.errstate(over="ignore"):
        for i in range(k):
            out = (out ^ h[i : i + len(out)]) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(i + 1)
            out ^= out >> np.uint64(29)
    return out


def minhashes(sh: np.ndarray, k: int) -> np.ndarray:
    """Value ``k`` of each shingle, of which a set keeps the least."""
    with np.errstate(over="ignore"):
        return (sh * _MULT[k] + _ADD[k]) >> np.uint64(16)


def bands(q: int, u: int, miss: float = MISS) -> int:
    """MinHash values needed so that a set of ``u`` shingles with ``q`` of the query's is missed with chance ``miss``."""
    j = q / max(u, q)
    need = 1 if j >= 1 else math.ceil(math.log(miss) / math.log(1 - j))
    if need > len(_MULT):
        raise ValueError(f"{need} MinHash values are needed for passages of {q} shingles, {len(_MULT)} are there: take shorter shingles")
    return need


class _Index:
    """MinHash values of the passages of a block of items."""

    def __init__(self, items: list[tuple[object, list[str]]], passage: int, shingle: int):
        hasher = _Hasher()
        self.passage, self.shingle, self.items, self.grams = passage, shingle, [i for i, _ in items], []
        self.sizes: dict[int, dict] = {}  # by number of words of the passage
        for n, (_, ws) in enumerate(items):
            size = min(passage, len(ws))
            h = hasher(ws)
            self.grams.append({tuple(ws[i : i + size]) for i in range(len(ws) - size + 1)})
            part = self.sizes.setdefault(size, {"sets": [], "owner": []})
            for i in range(len(ws) - size + 1):
                part["sets"].append(shingle_hashes(h[i : i + size], shingle))
                part["owner"].append(n)
        for size, part in self.sizes.items():
            sets, owner = np.array(part["sets"]), np.array(part["owner"])
            part["q"] = sets.shape[1]
            part["stride"], part["span"] = size + 1, 2 * size
            part["bands"] = {}
            most = bands(part["q"], part["span"] - min(shingle, size) + 1)
            part["keys"] = []
            for k in range(most):
                least = minhashes(sets, k).min(axis=1)
                pairs = np.unique(np.stack([least, owner.astype(np.uint64)], 1), axis=0)
                bloom = np.zeros(1 << 18, bool)
                bloom[(pairs[:, 0] & np.uint64((1 << 18) - 1)).astype(np.int64)] = True
                part["keys"].append((pairs[:, 0].copy(), pairs[:, 1].astype(np.int64), bloom))
            del part["sets"], part["owner"]

    def candidates(self, h: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> set[tuple[int, int]]:
        """(document, item) pairs with a collision; documents are runs of ``h``."""
        out: set[tuple[int, int]] = set()
        for size, part in self.sizes.items():
            k, width = min(self.shingle, size), part["span"]
            sh = shingle_hashes(h, k)
            if not len(sh):
                continue
            # windows: every ``stride`` words of each document with at least a passage
            ok = lengths >= size
            count = np.where(ok, np.maximum(1, -(-(lengths - size + 1) // part["stride"])), 0)
            doc = np.repeat(np.arange(len(lengths)), count)
            nth = np.arange(len(doc)) - np.repeat(np.cumsum(count) - count, count)
            first = starts[doc] + nth * part["stride"]
            n_sh = np.minimum(width, lengths[doc] - nth * part["stride"]) - k + 1
            # size partitions: windows by number of shingles, each with its own number of MinHash values
            edges = sorted({part["q"], *(part["q"] + round((width - k + 1 - part["q"]) * i / 4) for i in range(1, 5))})
            low = 0
            for u in edges:
                mine = np.flatnonzero((n_sh > low) & (n_sh <= u))
                low = u
                if not len(mine):
                    continue
                at = first[mine][:, None] + np.minimum(np.arange(u)[None, :], (n_sh[mine] - 1)[:, None])
                sets = sh[at]
                for b in range(bands(part["q"], u)):
                    keys, owner, bloom = part["keys"][b]
                    least = minhashes(sets, b).min(axis=1)
                    hit = np.flatnonzero(bloom[(least & np.uint64((1 << 18) - 1)).astype(np.int64)])
                    if not len(hit):
                        continue
                    left, right = np.searchsorted(keys, least[hit], "left"), np.searchsorted(keys, least[hit], "right")
                    for w, lo, hi in zip(hit, left, right, strict=True):
                        out.update((int(doc[mine[w]]), int(o)) for o in owner[lo:hi])
        return out


def _search(index, id_name: str, rows: int = 256):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ix, hasher = index.value, _Hasher()
        for b in batches:
            for at in range(0, b.num_rows, rows):
                part = b.slice(at, rows)
                docs = [words(t) for t in part.column(1).to_pylist()]
                lengths = np.array([len(d) for d in docs])
                h = hasher([w for d in docs for w in d])
                found = ix.candidates(h, np.cumsum(lengths) - lengths, lengths)
                keep, items = [], []
                for d, n in sorted(found):
                    grams, ws = ix.grams[n], docs[d]
                    size = len(next(iter(grams)))
                    if any(tuple(ws[i : i + size]) in grams for i in range(len(ws) - size + 1)):
                        keep.append(d)
                        items.append(ix.items[n])
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(keep, pa.int64())), pa.array(items, pa.string())], [id_name, "item"])

    return run


def _blocks(items: DataFrame, ident: str, text: str, passage: int, block: int) -> Iterator[list[tuple[str, list[str]]]]:
    held, size = [], 0
    for r in items.select(F.col(f"`{ident}`").cast("string").alias("i"), F.col(f"`{text}`").alias("t")).dropna().distinct().toLocalIterator():
        ws = words(r["t"])
        if ws:
            held.append((r["i"], ws))
            size += max(1, len(ws) - passage + 1)
        if size > block:
            yield held
            held, size = [], 0
    if held:
        yield held


def find_leaks(docs: DataFrame, doc_id: str, doc_text: str, items: DataFrame, item_id: str, item_text: str, *, passage: int = PASSAGE, shingle: int = SHINGLE, block: int = BLOCK) -> DataFrame:
    """``(doc_id, item_id)``: documents that hold ``passage`` consecutive words of an item, or all of a shorter item.

    Items are a stated query set: they are searched in blocks of ``block`` passages, each block against all documents.
    Null texts and texts without words give no rows; repeated rows give one; other columns are ignored.
    """
    spark = docs.sparkSession
    kind = docs.schema[doc_id].dataType.simpleString()
    source = docs.select(F.col(f"`{doc_id}`").alias("d"), F.col(f"`{doc_text}`").cast("string").alias("t")).dropna()
    out = None
    for held in _blocks(items, item_id, item_text, passage, block):
        index = spark.sparkContext.broadcast(_Index(held, passage, shingle))
        found = source.mapInArrow(_search(index, "d"), f"d {kind}, item string")
        out = found if out is None else out.unionByName(found)
    if out is None:
        out = spark.createDataFrame([], f"d {kind}, item string")
    return out.distinct().select(F.col("d").alias(doc_id), F.col("item").cast(items.schema[item_id].dataType).alias(item_id))
