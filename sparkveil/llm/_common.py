"""What the operators of this subpackage share: table access and Arrow batches of texts."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from sparkveil.plans import scratch

#: Texts are handed to an operator's kernel in slices of at most this many rows and characters (one text may be longer).
SLICE_ROWS, SLICE_CHARS = 512, 4_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the data folder, by a path that only Spark needs to read."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def slices(batch: pa.RecordBatch, column: str = "text") -> Iterator[pa.RecordBatch]:
    """Cut a batch so that the memory for its texts stays bounded."""
    sizes = batch.column(column)
    at, chars, start = 0, 0, 0
    for at in range(batch.num_rows):
        cell = sizes[at]
        chars += len(cell.as_buffer()) if cell.is_valid else 0
        if at - start + 1 >= SLICE_ROWS or chars >= SLICE_CHARS:
            yield batch.slice(start, at - start + 1)
            start, chars = at + 1, 0
    if start < batch.num_rows:
        yield batch.slice(start)


def map_slices(df: DataFrame, make: Callable[[], Callable[[pa.RecordBatch], pa.RecordBatch]], schema: str) -> DataFrame:
    """``mapInArrow`` over slices of a frame that has a ``text`` column; ``make`` builds the kernel once a task.  Columns may have any names."""
    names = df.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kernel = make()
        for batch in batches:
            for part in slices(batch.rename_columns(names)):
                yield kernel(part)

    return df.toDF(*(f"c{k}" for k in range(len(names)))).mapInArrow(run, schema)


def remainder(id_col: str, modulus: int):
    """crc32 of an id written as text, modulo ``modulus``."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % modulus


def labelled_sample(labels: DataFrame, label: str, modulus: int, held: int, limit: int) -> DataFrame:
    """At most ``limit`` labelled ids outside the held-out fold, in an order fixed by a hash of the id.

    One row an id: (sample_id, label, place).  Null ids and labels are left out; of
    contradicting labels of one id the smaller counts.
    """
    rows = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull() & (remainder("doc_id", modulus) != held))
    rows = rows.groupBy(F.col("doc_id").alias("sample_id")).agg(F.min(label).cast("int").alias("label"))
    return rows.withColumn("place", F.xxhash64("sample_id")).orderBy("place", "sample_id").limit(limit)


class Replayed:
    """Rows of a bounded sample, decoded, in order of ``place`` and ``tie``, as often as they are asked for.

    The rows are a table in the shared folder.  The first ones, of about ``memory`` bytes, stay with the driver after the first
    pass; the others are read again, a partition at a time, so a sampled document may have any length and none is left out.
    """

    def __init__(self, rows: DataFrame, decode: Callable[[Row], object], memory: int = 48_000_000) -> None:
        self.table, self._path = scratch.write(rows)
        self.decode, self.memory = decode, memory
        self.kept: list = []
        self.last: int | None = None
        self.whole = self.passed = False

    def _read(self, rows: DataFrame) -> Iterator[Row]:
        return rows.orderBy("place", "tie").toLocalIterator()

    def __iter__(self) -> Iterator:
        if self.passed:
            yield from self.kept
            if not self.whole:
                yield from map(self.decode, self._read(self.table if self.last is None else self.table.where(F.col("place") > self.last)))
            return
        used, group, place, kept, full = 0, [], None, [], False
        for row in self._read(self.table):
            item = self.decode(row)
            if row.place != place and group and not full:
                kept += group
                self.last, group = place, []
            place = row.place
            used += sum(len(v) for v in row if isinstance(v, (bytes, bytearray)))
            full = full or used > self.memory
            if not full:
                group.append(item)
            yield item
        self.kept, self.whole, self.passed = kept if full else kept + group, not full, True

    def drop(self) -> None:
        scratch.drop(self.table.sparkSession, self._path)
