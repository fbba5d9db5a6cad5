"""Small helpers shared by the text operators."""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType, _parse_datatype_string

from hitloom.runtime import ship

#: Words of the contracts: runs of anything but ASCII space and the controls 9 to 13.
WORD = r"[^\x20\x09-\x0D]+"
#: Rows that one Python call handles; texts of any length stay whole.
ROWS = 256


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def map_rows(df: DataFrame, make: Callable[[], Callable[[list[list]], list[list]]], schema: str | StructType) -> DataFrame:
    """Apply ``make()`` (called once per task) to column lists, ``ROWS`` rows at a time.

    The function gets one list per column of ``df`` and returns one list per
    field of ``schema``, of any common length.
    """
    fields = schema if isinstance(schema, StructType) else _parse_datatype_string(schema)
    arrow = to_arrow_schema(fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fn = make()
        for batch in batches:
            for start in range(0, batch.num_rows, ROWS):
                part = batch.slice(start, ROWS)
                out = fn([c.to_pylist() for c in part.columns])
                yield pa.record_batch([pa.array(v, type=f.type) for v, f in zip(out, arrow, strict=True)], schema=arrow)

    ship(df.sparkSession)
    return df.mapInArrow(run, fields)


def sum_terms(df: DataFrame, terms: Callable[[], Callable[[list], Iterable]], schema: str, room: int = 200_000) -> DataFrame:
    """Count what ``terms()`` (called once per task) finds in each row: rows of ``schema``, whose last field is the count.

    A task sums what it has seen and hands the sums on when ``room`` different
    ones have come together and at its end, so that far fewer rows than
    findings are shuffled; the caller adds them up.
    """
    fields = _parse_datatype_string(schema)
    arrow = to_arrow_schema(fields)

    def batch(sums: Counter) -> pa.RecordBatch:
        columns = [*zip(*sums, strict=True), list(sums.values())]
        return pa.record_batch([pa.array(v, type=f.type) for v, f in zip(columns, arrow, strict=True)], schema=arrow)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find, sums = terms(), Counter()
        for part in batches:
            for start in range(0, part.num_rows, ROWS):
                for row in zip(*(c.to_pylist() for c in part.slice(start, ROWS).columns), strict=True):
                    sums.update(find(row))
                if len(sums) >= room:
                    yield batch(sums)
                    sums = Counter()
        if sums:
            yield batch(sums)

    ship(df.sparkSession)
    return df.mapInArrow(run, fields)


def sent(spark: SparkSession, path: str) -> Callable[[], str]:
    """Send a local file of the driver to the executors; the function returned tells its place in a task."""
    spark.sparkContext.addFile(path)
    name = path.rsplit("/", 1)[-1]
    return lambda: SparkFiles.get(name)


def held_out(doc_id: str = "doc_id") -> Column:
    """Documents set aside for evaluation: crc32 of the id as text is divisible by 5 (a null id is not)."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 5 == 0, F.lit(False))


class Recent(dict):
    """A dictionary that computes missing values and keeps those of the last two generations of keys.

    A generation ends when the lengths of its keys, with ``EACH`` for what an
    entry takes beside its key, reach ``size``; keys longer than ``LONGEST`` are
    computed each time and never kept, so a corpus of long words without spaces
    takes no more memory than any other.
    """

    LONGEST, EACH = 200, 200

    def __init__(self, compute: Callable, size: int = 24_000_000):
        super().__init__()
        self.compute, self.size, self.used, self.old = compute, size, 0, {}

    def __missing__(self, key):
        if len(key) > self.LONGEST:
            return self.compute(key)
        if self.used >= self.size:
            self.old, self.used = dict(self), 0
            self.clear()
        value = self.old.get(key)
        if value is None:
            value = self.compute(key)
        self[key] = value
        self.used += len(key) + self.EACH
        return value
