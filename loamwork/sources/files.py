"""Reading and writing documents, manifests, logs and tables of many shapes."""

from __future__ import annotations

import html.parser
import os
import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loamwork.plans.durable import cut


def inside(path: str, root: str) -> bool:
    """Whether a path, links resolved, lies in the root."""
    real, base = os.path.realpath(path), os.path.realpath(root)
    return real == base or real.startswith(base + os.sep)


def regular_files(root: str, name: str | None = None) -> list[str]:
    """Regular files below a local root, hidden folders and symbolic links left out."""
    out = []
    for folder, dirs, files in os.walk(root):
        dirs[:] = sorted(d for d in dirs if not d.startswith(".") and not os.path.islink(os.path.join(folder, d)))
        out += [p for f in sorted(files) if (name is None or f == name) and not os.path.islink(p := os.path.join(folder, f)) and inside(p, root)]
    return out


def read_documents(spark: SparkSession, root: str, name: str = "SKILL.md") -> DataFrame:
    """``(id, path, content)`` of all files of a name below a root, hidden folders left out; the identifier is the folder below the root."""
    local = os.path.isdir(root)
    # links are left out where the root is a local folder; other file systems have none
    files = regular_files(root, name) if local else [root]
    if not files:
        return spark.createDataFrame([], "id string, path string, content string")
    raw = (spark.read.text(files, wholetext=True) if local else spark.read.text(root, wholetext=True, recursiveFileLookup=True, pathGlobFilter=name)).select(F.regexp_replace("_metadata.file_path", r"^file:/*", "/").alias("path"), F.col("value").alias("content"))
    base = os.path.abspath(root).rstrip("/") + "/"
    below = F.when(F.col("path").startswith(base), F.substring("path", len(base) + 1, 1 << 30)).otherwise(F.col("path"))
    return raw.withColumn("below", below).filter(~F.col("below").rlike(r"(^|/)\.[^/]")).select(F.regexp_replace("below", r"/?[^/]*$", "").alias("id"), "path", "content")


def read_json_array(spark: SparkSession, path: str, schema: T.StructType | str, strict: bool = False) -> DataFrame:
    """Rows of a file that holds one JSON array; anything but an array gives no rows, or with ``strict`` is an error."""
    raw = spark.read.text(path, wholetext=True)
    kind = schema if isinstance(schema, str) else schema.simpleString()[7:-1]
    if strict and raw.filter(F.ltrim("value").startswith("[") & F.try_parse_json("value").isNotNull()).isEmpty():
        raise ValueError(f"{path} holds no JSON array")
    return raw.filter(F.ltrim("value").startswith("[")).select(F.explode(F.from_json("value", f"array<struct<{kind}>>" if isinstance(schema, str) else T.ArrayType(schema))).alias("r")).filter("r is not null").select("r.*")


def first_valid(attempts: list[Callable[[], DataFrame]]) -> DataFrame:
    """The first source that can be read, be it empty; the last error is raised if there is none."""
    last: Exception = ValueError("no source given")
    for attempt in attempts:
        try:
            df = attempt()
            df.isEmpty()  # reading it is the test
            return df
        except Exception as e:  # noqa: BLE001 - any unreadable source leads to the next
            last = e
    raise last


def append_log(df: DataFrame, path: str) -> None:
    df.write.mode("append").json(path)


def read_log(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Rows of JSON lines; malformed lines are left out."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)


def markdown_bundles(docs: DataFrame, text: str) -> DataFrame:
    """``(name, position, id)`` of the items of the '### ' sections of Markdown bundle lists."""
    parts = docs.select(F.posexplode(F.slice(F.split(F.concat(F.lit("\n"), F.col(text)), r"\n### "), 2, 1 << 20)).alias("section", "body"))
    name = F.trim(F.regexp_replace(F.regexp_extract("body", r"\A([^\n]*)", 1), '["“”]', ""))
    return parts.select(name.alias("name"), F.posexplode(F.regexp_extract_all("body", F.lit(r"(?m)^- \[`([^`]+)`\]"), 1)).alias("position", "id"))


def changed_only(before: DataFrame, after: DataFrame, key: str, text: str) -> DataFrame:
    """Rows whose text is new or differs; these are the ones to write."""
    old = before.select(key, F.col(text).alias("_old"))
    return after.join(old, key, "left").filter(~F.col(text).eqNullSafe(F.col("_old"))).drop("_old")


class _Tables(html.parser.HTMLParser):
    def __init__(self):
        super().__init__()
        self.rows, self.items, self.paragraphs, self.cell, self.into = [], [], [], None, None

    def handle_starttag(self, tag, attrs):
        if tag == "tr":
            self.rows.append([])
        if tag in ("td", "th", "li", "p"):
            self.cell, self.into = [], tag

    def handle_data(self, data):
        if self.cell is not None:
            self.cell.append(data)

    def handle_endtag(self, tag):
        if tag == self.into and self.cell is not None:
            s = re.sub(r"\s+", " ", "".join(self.cell)).strip()
            if tag in ("td", "th") and self.rows:
                self.rows[-1].append(s)
            elif s:
                (self.items if tag == "li" else self.paragraphs).append(s)
            self.cell = None


def html_records(docs: DataFrame, ident: str, text: str, columns: dict[str, list[str]]) -> DataFrame:
    """``(id, level, <columns>)``: rows of HTML tables by header fragments; list items, then paragraphs, where there is no such table.

    A column takes the first header that contains one of its fragments; of lists and paragraphs the whole text is in the first column.
    """
    names = list(columns)
    kind = docs.schema[ident].dataType.simpleString()

    def parse(page: str) -> tuple[str, list[list[str | None]]]:
        p = _Tables()
        p.feed(page or "")
        rows = [r for r in p.rows if r]
        if rows:
            head = [h.lower() for h in rows[0]]
            at = [next((i for i, h in enumerate(head) if any(f in h for f in columns[n])), None) for n in names]
            got = [[r[i] if i is not None and i < len(r) else None for i in at] for r in rows[1:]]
            if any(i is not None for i in at) and got:
                return "table", got
        for level, found in (("list", p.items), ("paragraph", p.paragraphs)):
            if found:
                return level, [[s, *[None] * (len(names) - 1)] for s in found]
        return "none", []

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            rows = [(i, level, *r) for i, t in zip(pdf["id"], pdf["t"], strict=True) for level, got in [parse(t)] for r in got]
            yield pd.DataFrame(rows, columns=["id", "level", *names])

    return docs.select(F.col(ident).alias("id"), F.col(text).alias("t")).mapInPandas(run, f"id {kind}, level string, " + ", ".join(f"{n} string" for n in names))


def vtt_cues(docs: DataFrame, ident: str, text: str) -> DataFrame:
    """``(id, seq, start, end, text)`` of WebVTT cues, times in seconds, tags left in."""
    blocks = docs.select(F.col(ident).alias("id"), F.posexplode(F.split(F.regexp_replace(F.col(text), "\r", ""), r"\n\s*\n")).alias("seq", "b"))
    clock = r"((?:\d+:)?\d+:\d+[.,]\d+)"
    seconds = lambda c: F.aggregate(F.split(F.regexp_replace(c, ",", "."), ":"), F.lit(0.0), lambda s, x: s * 60 + x.cast("double"))
    got = blocks.select("id", "seq", F.regexp_extract("b", clock + r"\s*-->", 1).alias("s"), F.regexp_extract("b", r"-->\s*" + clock, 1).alias("e"), F.trim(F.regexp_replace(F.regexp_extract("b", r"(?s)-->[^\n]*\n(.*)", 1), r"\s*\n\s*", " ")).alias("text"))
    return got.filter("s <> ''").select("id", "seq", seconds(F.col("s")).alias("start"), seconds(F.col("e")).alias("end"), "text")


def read_xml_rows(spark: SparkSession, path: str, tag: str, schema: str) -> DataFrame:
    """Rows of an XML trace by their element's name."""
    return spark.read.format("xml").option("rowTag", tag).schema(schema).load(path)


def lineage_edges(df: DataFrame, sql: str) -> DataFrame:
    """``(target, source)`` of 'create table ... as select' and 'insert into ... select' statements."""
    s = F.regexp_replace(F.col(sql), r"\s+", " ")
    target = F.lower(F.regexp_extract(s, r"(?i)(?:create (?:or replace )?table(?: if not exists)?|insert (?:into|overwrite)(?: table)?) ([\w.]+)", 1))
    sources = F.array_distinct(F.transform(F.regexp_extract_all(s, F.lit(r"(?i)(?:from|join) ([\w.]+)"), 1), F.lower))
    return df.select(target.alias("target"), F.explode(sources).alias("source")).filter("target <> ''").distinct()


def push_batches(df: DataFrame, order: str, size: int) -> DataFrame:
    """Adds ``batch``: rows in order, ``size`` to a batch, numbered without gathering them in one task."""
    # written once, so that counts and numbers are of the same ranges
    ids = cut(df.orderBy(order).select("*", F.monotonically_increasing_id().alias("_m")).withColumn("_p", F.shiftright("_m", 33)))
    counts = {r["_p"]: r["count"] for r in ids.groupBy("_p").count().collect()}
    start, at = {}, 0
    for p in sorted(counts):
        start[p] = at
        at += counts[p]
    if not start:
        return df.withColumn("batch", F.lit(0).cast("long"))
    offset = F.element_at(F.create_map(*[F.lit(x) for kv in start.items() for x in kv]), F.col("_p"))
    return ids.withColumn("batch", F.floor((offset + F.col("_m").bitwiseAND((1 << 33) - 1)) / size)).drop("_m", "_p")
