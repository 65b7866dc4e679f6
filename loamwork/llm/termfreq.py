"""Frequency of every distinct value, by recursive radix spilling and out-of-core aggregation with DuckDB.

Rows go to tasks by the leading bits of their term's hash. A radix that holds more than its share of rows is cut
further by bits of the record's hash: records counted in one part are counted in no other, so both the row
and the record counts of the parts add up. In a task the rows are spilled to disk by the next bits of the hash;
a spilled part above ``part_rows`` is split again by the bits after those, and DuckDB aggregates each part out of core.
"""

from __future__ import annotations

import os
import re
import shutil
import uuid
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loamwork.plans.durable import shared_dir

#: Leading hash bits that choose the task, and bits of each further split in a task.
RADIX_BITS, SPLIT_BITS = 8, 4
#: Rows of a part that DuckDB aggregates at once, and rows that a task should get.
PART_ROWS, TASK_ROWS = 1_000_000, 4_000_000
MEMORY = "256MB"
_IN = pa.schema([("field", pa.string()), ("term", pa.string()), ("rec", pa.string()), ("h", pa.int64()), ("g", pa.int64())])


class _Spill:
    """Rows of one part on disk; splits itself by the next bits when it is read and found too large."""

    def __init__(self, folder: str, level: int, part_rows: int):
        self.folder, self.level, self.part_rows, self.rows = folder, level, part_rows, {}
        self.writers: dict[int, pa.RecordBatchFileWriter] = {}
        os.makedirs(folder, exist_ok=True)

    def add(self, batch: pa.RecordBatch) -> None:
        """Levels below 8 use bits of the term's hash, deeper ones (one huge term) bits of the record's."""
        import numpy as np

        code = batch.column("h" if self.level < 8 else "g").to_numpy().view(np.uint64)
        shift = np.uint64((RADIX_BITS + SPLIT_BITS * (self.level % 8)) % 60)
        slot = (code >> shift) & np.uint64((1 << SPLIT_BITS) - 1)
        order = np.argsort(slot, kind="stable")
        batch, slot = batch.take(pa.array(order)), slot[order]
        edges = np.flatnonzero(np.diff(slot)) + 1
        for start, end in zip([0, *edges], [*edges, len(slot)], strict=True):
            s = int(slot[start])
            if s not in self.writers:
                self.writers[s] = pa.ipc.new_file(os.path.join(self.folder, f"{s}.arrow"), _IN)
            self.writers[s].write_batch(batch.slice(start, end - start))
            self.rows[s] = self.rows.get(s, 0) + int(end - start)

    def parts(self) -> Iterator[pa.Table]:
        for w in self.writers.values():
            w.close()
        for s, n in self.rows.items():
            path = os.path.join(self.folder, f"{s}.arrow")
            with pa.memory_map(path) as source:
                reader = pa.ipc.open_file(source)
                if n > self.part_rows and self.level < 16:
                    # bits that don't divide the rows belong to one huge term: go on with the record's bits
                    level = 8 if len(self.rows) == 1 and self.level < 8 else self.level + 1
                    deeper = _Spill(os.path.join(self.folder, f"{s}.d"), level, self.part_rows)
                    for i in range(reader.num_record_batches):
                        deeper.add(reader.get_batch(i))
                    yield from deeper.parts()
                else:
                    yield reader.read_all()
            os.remove(path)


def _aggregate(base: str | None, part_rows: int, memory: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import duckdb

        # where the shared folder is no file system, the parts lie in the executor's own Spark folder, as its shuffle files do
        place = base or os.environ.get("SPARK_LOCAL_DIRS", "").split(",")[0]
        if not place:
            raise RuntimeError("no folder to spill to: spark.checkpoint.dir is no file system and SPARK_LOCAL_DIRS is unset")
        folder = os.path.join(place, f"radix-{uuid.uuid4().hex}")
        spill = _Spill(folder, 0, part_rows)
        try:
            for b in batches:
                if b.num_rows:
                    spill.add(pa.RecordBatch.from_arrays([b.column(f.name).cast(f.type) for f in _IN], schema=_IN))
            db = duckdb.connect()
            db.execute(f"SET memory_limit='{memory}'; SET threads=1; SET temp_directory='{folder}/duckdb'; SET preserve_insertion_order=false")
            for part in spill.parts():
                db.register("part", part)
                got = db.sql("SELECT field, term, count(*) AS n_rows, count(DISTINCT rec) AS n_records FROM part GROUP BY field, term").to_arrow_table()
                db.unregister("part")
                yield from got.to_batches(max_chunksize=50_000)
            db.close()
        finally:
            shutil.rmtree(folder, ignore_errors=True)

    return run


def term_frequencies(df: DataFrame, record: str, fields: Sequence[str], *, radix_bits: int = RADIX_BITS, task_rows: int = TASK_ROWS, part_rows: int = PART_ROWS, memory: str = MEMORY) -> DataFrame:
    """``(field, term, n_rows, n_records)`` for every distinct value of every field.

    A term is the value as string, trimmed of spaces and lower-cased; null and blank are no value. ``n_rows``
    counts rows, repeated ones too, ``n_records`` distinct ``record`` values (a row without one counts as row only).
    Any other columns are ignored. An empty table gives no rows. ``radix_bits`` sets into how many ranges the hash is cut.
    """
    spark = df.sparkSession
    terms = df.select(
        F.col(f"`{record}`").cast("string").alias("rec"),
        F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.lower(F.trim(F.col(f"`{f}`").cast("string"))).alias("term")) for f in fields])).alias("x"),
    ).select("x.field", "x.term", "rec").filter("term <> ''").withColumn("h", F.xxhash64("field", "term")).withColumn("g", F.xxhash64("rec", F.lit(7)))
    terms = terms.withColumn("radix", F.pmod("h", F.lit(1 << radix_bits)).cast("int"))
    # 2**radix_bits counts at most reach the driver; each radix gets as many tasks as its rows need
    sizes = {r["radix"]: r["count"] for r in terms.groupBy("radix").count().collect()}
    if not sizes:
        return spark.createDataFrame([], "field string, term string, n_rows bigint, n_records bigint")
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    share = max(1, min(task_rows, -(-sum(sizes.values()) // tasks)))
    first, at = {}, 0
    for r, n in sorted(sizes.items()):
        first[r] = (at, max(1, -(-n // share)))
        at += first[r][1]
    start = F.element_at(F.create_map(*[F.lit(v) for r, (a, _) in first.items() for v in (r, a)]), F.col("radix"))
    count = F.element_at(F.create_map(*[F.lit(v) for r, (_, c) in first.items() for v in (r, c)]), F.col("radix"))
    placed = terms.withColumn("part", start + F.pmod("g", count.cast("long")).cast("int")).repartition(max(-(-sum(sizes.values()) // task_rows), min(at, 4 * tasks)), "part")
    base = shared_dir(spark)
    base = re.sub("^file:/+", "/", base)
    base = None if re.match("[a-z0-9]+:/", base) else base
    partial = placed.select("field", "term", "rec", "h", "g").mapInArrow(_aggregate(base, part_rows, memory), "field string, term string, n_rows bigint, n_records bigint")
    return partial.groupBy("field", "term").agg(F.sum("n_rows").alias("n_rows"), F.sum("n_records").alias("n_records"))


def mark_terms(freq: DataFrame, total: int, rare: int = 2, common: float = 0.2) -> DataFrame:
    """Adds ``mark``: 'rare' at ``rare`` records or fewer, else 'common' above the share ``common`` of all ``total`` records, else null."""
    return freq.withColumn("mark", F.when(F.col("n_records") <= rare, "rare").when(F.col("n_records") > common * total, "common"))
