"""One consistent form for texts that look the same but differ in their characters.

A text is first taken apart into base characters and marks in canonical order (so joined and separate accents, Hangul syllables and letters beyond the basic
plane agree, in whatever order marks were typed). Look-alike classes are the union-find closure, over code points and strings, of: wide and narrow forms,
joined letters, kinds of blank, and look-alike letters of Latin, Greek and Cyrillic; characters that show nothing belong to the empty string. The most frequent
member of a class in the corpus stands for it; a multi-pattern automaton rewrites every text greedily, longest member first, and marks are joined again.
"""

from __future__ import annotations

import functools
import hashlib
import itertools
import re
import sys
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loamwork.plans.durable import cut

#: Letters that look alike, each group Latin first, then Greek, then Cyrillic and others of these scripts; capitals, then small letters.
LETTERS = (
    "AΑА", "BΒВ", "CСϹ", "EΕЕ", "FϜ", "GԌ", "HΗН", "IΙІӀ", "JЈͿ", "KΚК", "MΜМϺ", "NΝ", "OΟО", "PΡР", "QԚ", "SЅ", "TΤТ", "VѴ", "WԜ", "XΧХ", "YΥҮ", "ZΖ", "ÆӔ", "ƏӘ", "ƟӨ", "ƷӠ", "ÞϷ", "ΓГ", "ΠП", "ΦФ",
    "aа", "cсϲ", "dԁ", "eе", "gɡ", "hһ", "iі", "jјϳ", "lӏ", "oοо", "pр", "qԛ", "sѕ", "uυ", "vνѵ", "wԝ", "xх", "yу", "æӕ", "əә", "ɵө", "ʒӡ", "þϸ", "ĸκк",
)
#: Blanks besides the space separators of Unicode.
BLANKS = "⠀ㅤᅟᅠﾠ"
#: Characters that show nothing besides the format characters of Unicode.
SILENT = "͏឴឵᠋᠌᠍᠏"


class _Classes:
    """Union-find over strings."""

    def __init__(self):
        self.up: dict[str, str] = {}

    def find(self, x: str) -> str:
        self.up.setdefault(x, x)
        while self.up[x] != x:
            self.up[x] = self.up[self.up[x]]
            x = self.up[x]
        return x

    def tie(self, a: str, b: str) -> None:
        a, b = self.find(a), self.find(b)
        if a != b:
            self.up[max(a, b)] = min(a, b)

    def members(self) -> dict[str, list[str]]:
        out: dict[str, list[str]] = {}
        for x in list(self.up):
            out.setdefault(self.find(x), []).append(x)
        return {k: sorted(v) for k, v in out.items() if len(v) > 1}


@functools.cache
def silent() -> frozenset[str]:
    """Characters that show nothing: format characters, variation selectors and joiners."""
    out = {chr(c) for c in range(sys.maxunicode + 1) if unicodedata.category(chr(c)) == "Cf" and not 0x600 <= c <= 0x6DD and c not in (0x70F, 0x8E2, 0x890, 0x891, 0x110BD, 0x110CD)}
    return frozenset(out | set(SILENT) | {chr(c) for c in [*range(0xFE00, 0xFE10), *range(0xE0100, 0xE01F0)]})


@functools.cache
def look_alike_classes() -> dict[str, list[str]]:
    """Members by class, from the Unicode tables and ``LETTERS``; no class holds the empty string."""
    c = _Classes()
    for group in LETTERS:
        for other in group[1:]:
            c.tie(group[0], other)
    for x in [chr(i) for i in range(sys.maxunicode + 1) if unicodedata.category(chr(i)) == "Zs"] + list(BLANKS):
        c.tie(" ", x)
    for x in map(chr, itertools.chain(range(0x80, 0xD800), range(0xE000, sys.maxunicode + 1))):
        parts = unicodedata.decomposition(x)
        kind = parts.split(" ", 1)[0] if parts.startswith("<") else ""
        if kind in ("<wide>", "<narrow>"):
            if not unicodedata.category(x).startswith("Z"):
                c.tie(x, unicodedata.normalize("NFKD", x))
        elif kind == "<compat>" and unicodedata.category(x)[0] == "L" and unicodedata.normalize("NFKC", x).isalpha():
            c.tie(x, unicodedata.normalize("NFKD", x))  # joined letters
    return {k: v for k, v in c.members().items() if "" not in v}


@functools.cache
def _ascii_strings() -> tuple[str, ...]:
    return tuple(m for v in look_alike_classes().values() for m in v if m.isascii() and len(m) > 1)


def taken_apart(t: str) -> str:
    """Base characters and marks, the marks in canonical order."""
    return t if t.isascii() else unicodedata.normalize("NFD", t)


def _sign(m: str) -> str:
    """A character that every text with the member ``m`` holds: its rarest kind, a mark before other letters than ASCII."""
    return next((c for c in m if unicodedata.category(c)[0] == "M"), None) or next((c for c in reversed(m) if not c.isascii()), m[0])


def _any_of(chars) -> re.Pattern | None:
    chars = sorted(set(chars))
    return re.compile(f"[{''.join(map(re.escape, chars))}]") if chars else None


def _automaton(words: dict[str, str]):
    import ahocorasick

    a = ahocorasick.Automaton()
    for w, rep in words.items():
        a.add_word(w, (len(w), rep))
    a.make_automaton()
    return a


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Occurrences of every member of every class in the whole texts."""
    singles = np.array(sorted(ord(m) for v in look_alike_classes().values() for m in v if len(m) == 1))
    strings = {m: m for v in look_alike_classes().values() for m in v if len(m) > 1 and not m.isascii()}
    find, counts, seen = _automaton(strings), np.zeros(singles[-1] + 2, np.int64), {}
    signs = _any_of(map(_sign, strings))

    def points(text: str) -> None:
        for at in range(0, len(text), 1_000_000):
            found = np.bincount(np.frombuffer(text[at : at + 1_000_000].encode("utf-32-le", "surrogatepass"), np.uint32))[: len(counts)]
            counts[: len(found)] += found

    for b in batches:
        held, size = [], 0
        for t in map(taken_apart, b.column(0).to_pylist()):
            held.append(t)
            size += len(t)
            if size > 500_000:
                points("".join(held))
                held, size = [], 0
            for m in _ascii_strings():
                if n := t.count(m):
                    seen[m] = seen.get(m, 0) + n
            if signs is not None and not t.isascii() and signs.search(t):
                for _, (_, m) in find.iter(t):
                    seen[m] = seen.get(m, 0) + 1
        points("".join(held))
    rows = [(chr(i), int(counts[i])) for i in singles if counts[i]] + list(seen.items())
    yield pa.RecordBatch.from_pydict({"member": [r[0] for r in rows], "n": [r[1] for r in rows]}, schema=pa.schema([("member", pa.string()), ("n", pa.int64())]))


def representatives(df: DataFrame, text: str) -> dict[str, str]:
    """``{member: representative}`` for all members that are rewritten, from the counts of the whole corpus.

    The most frequent member stands for its class; at equal counts an ASCII one, then the shorter, then the lower one.
    The counts are one row a member of a class, a number fixed by the Unicode tables whatever the corpus.
    """
    rows = df.filter(F.col(f"`{text}`").isNotNull()).select(F.col(f"`{text}`").cast("string")).mapInArrow(_count, "member string, n bigint").groupBy("member").agg(F.sum("n").alias("n")).collect()
    n = {r["member"]: r["n"] for r in rows}
    out = {}
    for members in look_alike_classes().values():
        best = min(members, key=lambda m: (-n.get(m, 0), not m.isascii(), len(m), m))
        out |= {m: best for m in members if m != best or len(m) > 1}
    return out


class Rewriter:
    """Rewrites texts by a map of representatives; one automaton serves all texts."""

    def __init__(self, reps: dict[str, str]):
        self.find = _automaton(reps)
        self.any = _any_of(_sign(m) for m, r in reps.items() if m != r)
        # one class of the basic plane is a table lookup a character; the others are looked for only where there are any
        self.drop = _any_of(c for c in silent() if ord(c) < 0x1_0000)
        self.far, self.drop_far = re.compile("[\U00010000-\U0010ffff]"), _any_of(c for c in silent() if ord(c) >= 0x1_0000)
        self.ascii_safe = not any(m.isascii() for m, r in reps.items() if m != r)

    def __call__(self, t: str) -> str:
        if t.isascii() and self.ascii_safe:
            return t
        t = self.drop.sub("", t)
        if self.far.search(t):
            t = self.drop_far.sub("", t)
        if self.any is not None:
            # a mark hides no look-alike letter: in the joined form of a text its base would not be met
            t = taken_apart(t)
            if self.any.search(t):
                out, at = [], 0
                for end, (length, rep) in self.find.iter_long(t):
                    out += [t[at : end - length + 1], rep]
                    at = end + 1
                t = "".join([*out, t[at:]])
        return unicodedata.normalize("NFC", t)


def _rewrite(reps: dict[str, str], digest: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        form = Rewriter(reps)
        md5 = lambda s: hashlib.md5(s.encode("utf-8", "surrogatepass"), usedforsecurity=False).digest()
        for b in batches:
            texts = b.column(1).to_pylist()
            new = [None if t is None else form(t) for t in texts]
            if digest:
                new, old = [None if t is None else md5(t) for t in new], [None if t is None else md5(t) for t in texts]
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(new, pa.binary()), pa.array(old, pa.binary())], ["__id", "form", "raw"])
            else:
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(new, pa.string())], ["__id", "form"])

    return run


def canonical_texts(df: DataFrame, ident: str, text: str, *, digest: bool = False) -> DataFrame:
    """``(ident, form)`` with every text in its consistent form, one row for each row of ``df``.

    With ``digest`` the columns are ``(ident, form, raw)``, 128-bit digests of the consistent form and of the text as it
    is. A null text keeps a null form, an empty one stays empty; other columns are ignored. Case, wording, punctuation,
    digits, and accents present or absent stay as they are.
    """
    return rewritten(df, ident, text, representatives(df, text), digest=digest)


def rewritten(df: DataFrame, ident: str, text: str, reps: dict[str, str], *, digest: bool = False) -> DataFrame:
    """As ``canonical_texts``, by representatives that are known."""
    kind = df.schema[ident].dataType.simpleString()
    rows = df.select(F.col(f"`{ident}`").alias("__id"), F.col(f"`{text}`").cast("string").alias("t"))
    out = rows.mapInArrow(_rewrite(reps, digest), f"__id {kind}, form " + ("binary, raw binary" if digest else "string"))
    return out.withColumnRenamed("__id", ident)


def look_alike_groups(df: DataFrame, ident: str, text: str) -> DataFrame:
    """``(ident, same, group, texts)`` of the rows that look like another row but consist of other characters.

    ``same`` is the least identifier with identical text, ``group`` the least one that looks the same, ``texts`` the number of different
    texts in the group: membership by representatives, one row a row, so no copies are joined with each other. Null texts and null identifiers take no part.
    """
    forms = canonical_texts(df.filter(F.col(f"`{ident}`").isNotNull() & F.col(f"`{text}`").isNotNull()), ident, text, digest=True).withColumnRenamed(ident, "id")
    forms = cut(forms)
    texts = forms.groupBy("form", "raw").agg(F.min("id").alias("same"))
    groups = cut(texts.groupBy("form").agg(F.min("same").alias("group"), F.count("*").alias("texts")).filter("texts > 1"))
    some = cut(forms.join(groups, "form"))
    own = some.groupBy("form", "raw").agg(F.min("id").alias("same"))
    return some.join(own, ["form", "raw"]).select(F.col("id").alias(ident), "same", "group", "texts").distinct()


def look_alike_pairs(df: DataFrame, ident: str, text: str) -> DataFrame:
    """``(a, b)``, the smaller first: rows whose texts differ in characters but look the same.

    Different texts of a group meet by their representatives, then each side's copies are added: identical texts never meet, and what is joined is what
    comes out. Null texts and null identifiers take no part.
    """
    members = cut(look_alike_groups(df, ident, text).withColumnRenamed(ident, "id"))
    reps = members.filter("id = same").select("group", "same")
    links = reps.withColumnRenamed("same", "x").join(reps.withColumnRenamed("same", "y"), "group").filter("x < y").select("x", "y")
    sides = [members.select(F.col("same").alias(k), F.col("id").alias(n)) for k, n in (("x", "ida"), ("y", "idb"))]
    pairs = links.join(sides[0], "x").join(sides[1], "y")
    return pairs.select(F.least("ida", "idb").alias("a"), F.greatest("ida", "idb").alias("b")).distinct()
