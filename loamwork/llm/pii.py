"""Personal information in free text: found by a character-level BiLSTM with CRF transitions, replaced by typed placeholders.

Texts are cut into overlapping windows, and the model decodes every one of them; equal windows are decoded once a task. Where windows overlap, each
character takes the tag of the window in whose inside it lies deeper, and spans are read from the joined tags.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loamwork.llm import pii_model as M

#: Characters of a window and of the overlap of neighbours; a span longer than the overlap can be cut in two, both parts are replaced.
WINDOW, OVERLAP = 192, 72
#: Windows whose tags a task keeps for the next time they occur.
KEPT = 100_000
_DIGITS = re.compile(r"\d")


def windows(text: str) -> list[tuple[int, str]]:
    """Overlapping windows (start, text) that cover the whole text."""
    if len(text) <= WINDOW:
        return [(0, text)]
    step = WINDOW - OVERLAP
    return [(a, text[a : a + WINDOW]) for a in range(0, len(text) - OVERLAP, step)]


def join_windows(n: int, parts: list[tuple[int, np.ndarray]]) -> np.ndarray:
    """Tags of a text of ``n`` characters from those of its windows; a character follows the window whose edge is farther away."""
    if len(parts) == 1 and len(parts[0][1]) == n:
        return parts[0][1]
    tags, depth = np.zeros(n, np.int8), np.full(n, -1, np.int32)
    for start, y in parts:
        size = len(y)
        at = np.arange(size)
        # the ends of the text are no edges
        left = at + 1 if start else np.full(size, 1 << 20)
        right = size - at if start + size < n else np.full(size, 1 << 20)
        d = np.minimum(left, right)
        here = slice(start, start + size)
        better = d > depth[here]
        tags[here] = np.where(better, y, tags[here])
        depth[here] = np.where(better, d, depth[here])
    return tags


def _sound(kind: int, s: str) -> bool:
    """Exact check of a span the model found: the least that the kind's definition demands, whatever the language."""
    digits = len(_DIGITS.findall(s))
    if kind == 1:
        return re.search(r"(?i)[@＠]|(?<![^\W_])at?(?![^\W_])", s) is not None
    if kind in (2, 3):
        return digits >= (7 if kind == 2 else 5)
    letters = sum(c.isalpha() for c in s)
    return digits >= 1 and letters >= 2 if kind == 4 else digits == 0 and letters >= 2 and len(s.split()) > 1


def spans(text: str, tags: np.ndarray) -> list[tuple[int, int, int]]:
    """(start, end, kind) of the spans of a text, blanks at their ends left out, unsound ones dropped."""
    kind = (tags + 1) // 2
    # a span begins where its first tag is, or where the kind changes at a seam of windows
    begins = np.flatnonzero((kind > 0) & ((tags % 2 == 1) | (np.concatenate([[0], kind[:-1]]) != kind)))
    out = []
    for n, a in enumerate(begins):
        limit = begins[n + 1] if n + 1 < len(begins) else len(tags)
        other = np.flatnonzero(kind[a:limit] != kind[a])
        s = text[a : a + other[0] if len(other) else limit]
        start, end = int(a) + len(s) - len(s.lstrip()), int(a) + len(s.rstrip())
        if end > start and _sound(int(kind[a]), text[start:end]):
            out.append((start, end, int(kind[a])))
    return out


def find(texts: list[str | None], params: dict | None = None, kept: dict[str, np.ndarray | None] | None = None) -> list[list[tuple[int, int, int]]]:
    """Spans of each text; a null text has none. ``kept`` holds the tags of windows seen before."""
    p, kept = params or M.load(), {} if kept is None else kept
    cuts = [windows(t) if t else [] for t in texts]
    new = list({w for c in cuts for _, w in c if w not in kept})
    if len(kept) + len(new) > KEPT:
        kept.clear()
        new = list({w for c in cuts for _, w in c})
    kept.update(zip(new, M.decode(p, [M.encode(w) for w in new]), strict=True))
    out = []
    for t, c in zip(texts, cuts, strict=True):
        parts = [(start, kept[w], len(w)) for start, w in c]
        if all(y is None for _, y, _ in parts):
            out.append([])
        else:
            out.append(spans(t, join_windows(len(t), [(start, np.zeros(n, np.int8) if y is None else y) for start, y, n in parts])))
    return out


def redact(text: str | None, found: list[tuple[int, int, int]]) -> str | None:
    """The text with each span replaced by its placeholder, such as [EMAIL] or [ID_NUMBER]."""
    if text is None:
        return None
    out, at = [], 0
    for a, b, k in found:
        out += [text[at:a], f"[{M.KINDS[k - 1].upper()}]"]
        at = b
    return "".join([*out, text[at:]])


def _run(params: dict, redacted: bool, rows: int = 10_000):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: dict[str, np.ndarray | None] = {}
        for whole in batches:
            for at in range(0, whole.num_rows, rows):
                b = whole.slice(at, rows)
                texts = b.column(1).to_pylist()
                found = find(texts, params, kept)
                kinds = [sorted({M.KINDS[k - 1] for _, _, k in f}) for f in found]
                if redacted:
                    yield pa.RecordBatch.from_arrays([b.column(0), pa.array([redact(t, f) for t, f in zip(texts, found, strict=True)], pa.string()), pa.array(kinds, pa.list_(pa.string()))], ["__id", "text", "kinds"])
                else:
                    keep = [i for i, k in enumerate(kinds) if k]
                    yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(keep, pa.int64())), pa.array([kinds[i] for i in keep], pa.list_(pa.string()))], ["__id", "kinds"])

    return run


def personal_kinds(df: DataFrame, ident: str, text: str, params: dict | None = None) -> DataFrame:
    """``(ident, kinds)`` of the rows whose text holds personal information; rows with null, empty or clean text have none."""
    kind = df.schema[ident].dataType.simpleString()
    rows = df.select(F.col(f"`{ident}`").alias("__id"), F.col(f"`{text}`").cast("string").alias("t")).filter("t is not null")
    return rows.mapInArrow(_run(params or M.load(), False), f"__id {kind}, kinds array<string>").withColumnRenamed("__id", ident)


def redacted_texts(df: DataFrame, ident: str, text: str, params: dict | None = None) -> DataFrame:
    """``(ident, text, kinds)``, one row a row: the text with placeholders (null stays null) and the kinds replaced."""
    kind = df.schema[ident].dataType.simpleString()
    rows = df.select(F.col(f"`{ident}`").alias("__id"), F.col(f"`{text}`").cast("string").alias("t"))
    return rows.mapInArrow(_run(params or M.load(), True), f"__id {kind}, text string, kinds array<string>").withColumnRenamed("__id", ident)


