"""What the operators of this subpackage share: tables, batches and hashes."""

from __future__ import annotations

import contextlib
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def slices(batches: Iterable[pa.RecordBatch], column: str, most: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """The batches again, cut so that ``column`` holds about ``most`` bytes in each; one long value is never cut."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        ends = np.cumsum(sizes + 64)
        start = 0
        while start < batch.num_rows:
            base = ends[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, base + most, side="right")))
            yield batch.slice(start, stop - start)
            start = stop


def gathered(batches: Iterable[pa.RecordBatch], column: str, most: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """The batches again, cut or joined so that ``column`` holds about ``most`` bytes in each."""
    waiting, size = [], 0
    for batch in slices(batches, column, most):
        waiting.append(batch)
        size += batch.column(column).nbytes
        if size >= most:
            yield pa.Table.from_batches(waiting).combine_chunks().to_batches()[0]
            waiting, size = [], 0
    if waiting:
        yield pa.Table.from_batches(waiting).combine_chunks().to_batches()[0]


def raw(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of each value; null is empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def texts(column: pa.Array) -> list[str]:
    """Each value as str; null is empty, and bytes that are no UTF-8 become U+FFFD."""
    try:
        return [x or "" for x in column.to_pylist()]
    except UnicodeDecodeError:
        return [x.decode("utf-8", "replace") for x in raw(column)]


@contextlib.contextmanager
def arrow_rows(spark: SparkSession, rows: int):
    """Within the block, batches hold ``rows`` rows at most: for rows that are whole tiles."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(rows))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def bounded_batches(df: DataFrame, rows: int = 1024) -> DataFrame:
    """``df``, after lowering the session's default of 10,000 rows in a batch: texts are long, and JVM and worker each hold a batch."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    conf = df.sparkSession.conf
    if int(conf.get(key)) > rows:
        conf.set(key, str(rows))
    return df


def map_texts(df: DataFrame, columns: list[str], text: str, schema: str, work: Callable[[pa.RecordBatch], dict], most: int = 4 << 20) -> DataFrame:
    """Apply ``work`` to slices of ``columns`` and build rows of ``schema`` from the columns it returns."""
    kinds = to_arrow_schema(T._parse_datatype_string(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, text, most):
            out = work(batch)
            yield pa.RecordBatch.from_arrays([out[f.name].cast(f.type) for f in kinds], schema=kinds)

    return bounded_batches(df).select(*columns).mapInArrow(run, schema)


def keep_rows(df: DataFrame, text: str, good: Callable[[pa.RecordBatch], np.ndarray], most: int = 4 << 20) -> DataFrame:
    """The rows of ``df``, all columns as they are, for which ``good`` is true."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, text, most):
            yield batch.filter(pa.array(good(batch), pa.bool_()))

    return bounded_batches(df).mapInArrow(run, df.schema)
