"""Scalar text functions as Spark columns."""

from __future__ import annotations

import html
import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def normalize_text(c: Column) -> Column:
    """Lower case, everything but letters, marks, digits and underscores as a blank, blanks collapsed and trimmed."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(c), r"[^\p{L}\p{M}\p{N}_\s]", " "), r"\s+", " "))


def char_ngrams(c: Column, n: int) -> Column:
    """Distinct character grams of the normalised text; a text shorter than ``n`` is its own only gram, so '' gives ['']."""
    # the text is bound once: in the inner function it would be normalised again for every gram
    grams = lambda t: F.transform(F.sequence(F.lit(1), F.greatest(F.length(t) - n + 1, F.lit(1))), lambda i: F.substring(t, i, F.lit(n)))
    return F.transform(F.array(normalize_text(c)), lambda t: F.array_sort(F.array_distinct(F.when(F.length(t) < n, F.array(t)).otherwise(grams(t)))))[0]


@F.pandas_udf(T.StringType())
def fold_accents(s: pd.Series) -> pd.Series:
    """Lower case without accents, every run of other characters than a-z and 0-9 a blank, trimmed."""
    plain = lambda t: None if t is None else re.sub(r"[^a-z0-9]+", " ", "".join(ch for ch in unicodedata.normalize("NFD", t.lower()) if not unicodedata.combining(ch))).strip()
    return s.map(plain, na_action="ignore")


@F.pandas_udf(T.StringType())
def unescape_html(s: pd.Series) -> pd.Series:
    """HTML entities as their characters."""
    return s.map(html.unescape, na_action="ignore")


def slugify(c: Column) -> Column:
    """Lower case with every run of other characters than a-z and 0-9 as one hyphen, none at the ends."""
    return F.trim(F.regexp_replace(F.lower(c), "[^a-z0-9]+", "-"), F.lit("-"))


def caption_text(c: Column) -> Column:
    """Without tags and entities, blanks collapsed."""
    return F.trim(F.regexp_replace(unescape_html(F.regexp_replace(c, "<[^>]+>", "")), r"\s+", " "))


def short_description(c: Column, most: int = 200) -> Column:
    """Descriptions above ``most`` characters cut so that they end in three dots within it."""
    return F.when(F.length(c) > most, F.concat(F.substring(c, 1, most - 3), F.lit("..."))).otherwise(c)


def cache_key(*parts: Column) -> Column:
    """First 16 hex digits of the SHA-256 of the parts joined by bars; null parts count as empty."""
    return F.substring(F.sha2(F.concat_ws("|", *[F.coalesce(p, F.lit("")) for p in parts]), 256), 1, 16)


def mentions(c: Column) -> Column:
    """Distinct @names in order of first appearance."""
    return F.array_distinct(F.regexp_extract_all(c, F.lit(r"@([a-zA-Z0-9_./-]+)"), 1))


def outside_fences(c: Column, change) -> Column:
    """``change`` applied to the parts of a text outside ``` fences; a fence that is never closed protects nothing."""
    parts = F.split(c, "```")
    last_open = (F.size(parts) % 2 == 0)
    return F.array_join(F.transform(parts, lambda x, i: F.when((i % 2 == 0) | (last_open & (i == F.size(parts) - 1)), change(x)).otherwise(x)), "```")


def hide_amounts(c: Column, by: str = "the billed cost") -> Column:
    """Dollar amounts outside fences replaced; a bare ``$n`` is a placeholder and stays."""
    # an amount has a separator, a magnitude or a unit after its digits
    return outside_fences(c, lambda x: F.regexp_replace(x, r"\$\d+(?:[.,][\d.,]*[kKmMbB]?|[kKmMbB])(?:/[\dA-Za-z]+)?|\$\d+/[\dA-Za-z]+", by))


def asset_path(c: Column) -> Column:
    """A relative path under its root, or null: no scheme, no dot segment, no encoded slash, no blank segment; leading slashes go."""
    raw = F.regexp_replace(F.trim(c), r"^/+", "")
    decoded = F.try_url_decode(raw)
    safe = ~raw.rlike(r"(?i)^[a-z][a-z0-9+.-]*:|%2f|%5c|\\") & decoded.isNotNull() & (decoded != "")
    return F.when(safe & F.forall(F.split(decoded, "/"), lambda s: ~s.isin("", ".", "..")), decoded)


def is_safe_id(c: Column) -> Column:
    """Segments of letters, digits, dots, hyphens and underscores, none of them . or .. alone."""
    return F.coalesce(c.rlike(r"^[A-Za-z0-9._-]+(/[A-Za-z0-9._-]+)*$") & ~c.rlike(r"(^|/)\.{1,2}(/|$)"), F.lit(False))


def front_matter(c: Column) -> Column:
    """Keys and values, as text, between the two --- lines at the start of a document, quotes around values removed; an empty map without them."""
    head = F.regexp_extract(c, r"(?s)\A---\r?\n(.*?)\r?\n---", 1)
    pairs = F.filter(F.split(head, r"\r?\n"), lambda x: x.rlike(r"^[A-Za-z_][\w-]*\s*:"))
    entries = F.transform(pairs, lambda x: F.struct(F.trim(F.regexp_extract(x, r"^([^:]+):", 1)).alias("key"), F.regexp_replace(F.trim(F.regexp_extract(x, r"^[^:]+:(.*)$", 1)), r"""^["']|["']$""", "").alias("value")))
    # a repeated key keeps its last value
    kept = F.filter(entries, lambda e, i: ~F.exists(F.slice(entries, i + 2, F.size(entries)), lambda o: o["key"] == e["key"]))
    return F.map_from_entries(F.coalesce(kept, F.array().cast("array<struct<key:string,value:string>>")))


def sections(c: Column) -> Column:
    """Array of (heading, body) for every '## ' heading; what stands before the first is left out."""
    parts = F.split(c, r"(?m)^## ")
    return F.transform(F.slice(parts, 2, F.size(parts)), lambda p: F.struct(F.trim(F.regexp_extract(p, r"\A([^\n]*)", 1)).alias("heading"), F.regexp_replace(F.regexp_replace(p, r"\A[^\n]*\n?", ""), r"\A\s+|\s+\z", "").alias("body")))


def joined_sections(c: Column) -> Column:
    """Array of (heading, body) in order of first appearance: headings lower-cased, what stands before the first is 'general', repeated headings append.

    First-level headings are left out; empty bodies too.
    """
    parts = F.split(F.regexp_replace(c, r"(?m)^# [^\n]*\n?", ""), r"(?m)^## ")
    pieces = F.transform(parts, lambda p, i: F.struct(F.when(i == 0, F.lit("general")).otherwise(F.lower(F.trim(F.regexp_extract(p, r"\A([^\n]*)", 1)))).alias("heading"), F.when(i == 0, p).otherwise(F.regexp_replace(p, r"\A[^\n]*\n?", "")).alias("body")))
    names = F.array_distinct(F.transform(pieces, lambda x: x["heading"]))
    whole = F.transform(names, lambda n: F.struct(n.alias("heading"), F.regexp_replace(F.array_join(F.transform(F.filter(pieces, lambda x: x["heading"] == n), lambda x: x["body"]), ""), r"\A\s+|\s+\z", "").alias("body")))
    return F.filter(whole, lambda x: x["body"] != "")


def front_matter_lists(c: Column) -> Column:
    """Keys of the front matter whose value is a list, written as ``[a, b]`` or as indented ``- a`` lines, with their items; quotes removed."""
    head = F.concat(F.regexp_extract(c, r"(?s)\A---\r?\n(.*?)\r?\n---", 1), F.lit("\n"))
    bare = lambda x: F.regexp_replace(F.trim(x), r"""^["']|["']$""", "")
    pattern = r"(?m)^([A-Za-z_][\w-]*)[ \t]*:[ \t]*(\[[^\]\n]*\][ \t]*\n|\n(?:[ \t]*-[ \t]+[^\n]*\n)+)"
    keys, values = F.regexp_extract_all(head, F.lit(pattern), 1), F.regexp_extract_all(head, F.lit(pattern), 2)
    flow = lambda v: F.split(F.regexp_replace(F.trim(v), r"^\[|\]\s*$", ""), ",")
    block = lambda v: F.regexp_extract_all(v, F.lit(r"(?m)^[ \t]*-[ \t]+([^\n]*)$"), 1)
    items = F.transform(values, lambda v: F.filter(F.transform(F.when(v.startswith("["), flow(v)).otherwise(block(v)), bare), lambda x: x != ""))
    return F.map_from_entries(F.filter(F.arrays_zip(keys.alias("key"), items.alias("value")), lambda e: e["key"].isNotNull()))


def dump_front_matter(fields: Column, body: Column) -> Column:
    """A document with the map as front matter, keys in order, values with a colon, hash, quote or blank edge in double quotes."""
    quoted = lambda v: F.when(v.rlike(r"""[:#"'\[\]{}]|^\s|\s$|^$"""), F.concat(F.lit('"'), F.replace(v, F.lit('"'), F.lit("'")), F.lit('"'))).otherwise(v)
    lines = F.transform(F.array_sort(F.map_keys(fields)), lambda k: F.concat(k, F.lit(": "), quoted(F.coalesce(F.element_at(fields, k), F.lit("")))))
    return F.concat(F.lit("---\n"), F.array_join(lines, "\n"), F.lit("\n---\n"), F.coalesce(body, F.lit("")))


def fresh(written: Column, now: Column, hours: float) -> Column:
    """Whether a cached entry is younger than ``hours``, strictly; a null time is not fresh."""
    return F.coalesce(F.unix_micros(now) - F.unix_micros(written) < hours * 3_600_000_000, F.lit(False))


def json_default(c: Column, path: str, default: str) -> Column:
    """The value at a JSON path, or the default where it is missing, null or false."""
    return F.coalesce(F.nullif(F.get_json_object(c, path), F.lit("false")), F.lit(default))


def clean_lines(c: Column) -> Column:
    """Without first-level headings and 'Generated by' footers."""
    return F.array_join(F.filter(F.split(c, "\n"), lambda x: ~x.rlike(r"^# |(?i)^[\W_]*generated (by|with|on) ")), "\n")


def escape_regex(c: Column) -> Column:
    """Characters with a meaning in patterns preceded by a backslash."""
    return F.regexp_replace(c, r"([.*+?^${}()|\[\]\\])", r"\\$1")


def escape_cell(c: Column) -> Column:
    """Text for one cell of a Markdown table: bars escaped, line breaks as blanks."""
    return F.trim(F.regexp_replace(F.regexp_replace(c, r"\|", r"\\|"), r"\s*\r?\n\s*", " "))


def host_of(c: Column) -> Column:
    """Host of an address, lower-cased, without a leading 'www.'; null if it is none."""
    return F.regexp_replace(F.lower(F.try_parse_url(c, F.lit("HOST"))), r"^www\.", "")


def path_depth(c: Column) -> Column:
    """Number of path segments of an address."""
    return F.size(F.filter(F.split(F.coalesce(F.try_parse_url(c, F.lit("PATH")), F.lit("")), "/"), lambda s: s != ""))
