"""What the training-data operators share: tables, scratch tables, batch maps.

Batch maps run numpy over Arrow buffers. They cut a batch into slices of about
``SLICE_BYTES`` of text, so a task's memory follows the slice (or one text, if a
single text is longer) and not the batch.
"""

from __future__ import annotations

import contextlib
import ctypes
import gc
import uuid
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import checkpoint_dir

SLICE_BYTES = 1 << 20
BATCH_ROWS = 1000
#: A side of a join is broadcast when its rows times the width stated by the caller stay under this.
BROADCAST_BYTES = 8 << 20


def bounded_batches(spark: SparkSession) -> None:
    """Whole texts are large rows: fewer of them go to a Python worker at once than Spark's default 10,000."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(name)) > BATCH_ROWS:
        spark.conf.set(name, str(BATCH_ROWS))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One table as it lies in the folder: no repartitioning, any file system Spark reads."""
    bounded_batches(spark)
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def stored(df: DataFrame, by: str | None = None) -> DataFrame:
    """Write ``df`` to the shared checkpoint folder (``by``: a folder for each value of it) and read it back.

    This cuts the lineage like ``checkpoint()``, but keeps the table columnar and
    compressed. The folder is the cluster's ``spark.checkpoint.dir``; its files stay
    until the cluster clears that folder.
    """
    path = f"{checkpoint_dir(df.sparkSession).rstrip('/')}/llm-{uuid.uuid4().hex}"
    (df.write.partitionBy(by) if by else df.write).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def small_side(df: DataFrame, bytes_per_row: int, limit: int = BROADCAST_BYTES) -> DataFrame:
    """Hint a broadcast for a stored table whose counted rows prove it small; else leave the join to Spark."""
    return F.broadcast(df) if df.count() * bytes_per_row <= limit else df


def tidy(run):
    """A batch function that hands freed memory back at the end: workers live on between tasks."""
    def tidied(batches):
        yield from run(batches)
        gc.collect()
        pa.default_memory_pool().release_unused()
        with contextlib.suppress(OSError, AttributeError):      # where the C library has no such call
            ctypes.CDLL(None).malloc_trim(0)
    return tidied


def arrow_schema(fields: Sequence[T.StructField]) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema
    return to_arrow_schema(T.StructType(list(fields)))


def as_fields(ddl: str) -> list[T.StructField]:
    return list(T.StructType.fromDDL(ddl).fields)


def text_buffers(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string column, one text after the other, and the offsets; a null text is empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    wide = pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type)
    if col.null_count:
        col = col.fill_null("")
    _, off, data = col.buffers()
    n = len(col)
    if off is None or n == 0:
        return np.zeros(0, np.uint8), np.zeros(n + 1, np.int64)
    offs = np.frombuffer(off, np.int64 if wide else np.int32)[col.offset:col.offset + n + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offs[0]:offs[-1]], offs - offs[0]


def slices(offs: np.ndarray, most: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of at most ``most`` bytes of text and 20,000 rows, or one row."""
    row, n = 0, len(offs) - 1
    while row < n:
        end = int(np.searchsorted(offs, offs[row] + most, "right")) - 1
        end = min(n, max(row + 1, end), row + 20_000)
        yield row, end
        row = end


Kernel = Callable[[np.ndarray, np.ndarray, pa.RecordBatch], dict]


def map_texts(df: DataFrame, text: str, kernel_maker: Callable[[], Kernel], ddl: str,
              keep: Sequence[str] = (), one_to_one: bool = True, finish: bool = False) -> DataFrame:
    """Run a kernel over slices of the text column, as ``mapInArrow``.

    ``kernel_maker()`` is called once a task. The kernel gets (bytes, offsets, the slice's
    rows) and returns a dict of the columns in ``ddl``. With ``one_to_one`` the columns in
    ``keep`` are put in front unchanged; else the kernel returns those it needs itself.
    With ``finish`` the kernel is called once more with no rows (``None`` for all) at the end.
    """
    src = df.select(*dict.fromkeys([*keep, text]))
    fields = [src.schema[c] for c in keep] if one_to_one else []
    fields = [*fields, *as_fields(ddl)]
    schema, names = arrow_schema(fields), list(keep)

    def run(batches):
        kernel = kernel_maker()
        for batch in batches:
            data, offs = text_buffers(batch.column(batch.schema.get_field_index(text)))
            for a, b in slices(offs):
                rows = batch.slice(a, b - a)
                got = kernel(data[offs[a]:offs[b]], offs[a:b + 1] - offs[a], rows)
                if one_to_one:
                    got = {**{c: rows.column(rows.schema.get_field_index(c)) for c in names}, **got}
                yield record_batch(got, schema)
        if finish and (got := kernel(None, None, None)) is not None:
            yield record_batch(got, schema)

    return src.mapInArrow(tidy(run), T.StructType(fields))


def record_batch(cols: dict, schema: pa.Schema) -> pa.RecordBatch:
    arrays = []
    for f in schema:
        v = cols[f.name]
        if not isinstance(v, (pa.Array, pa.ChunkedArray)):
            v = pa.array(v, type=f.type)
        elif v.type != f.type:
            v = v.cast(f.type)
        arrays.append(v)
    return pa.RecordBatch.from_arrays(arrays, schema=schema)


def binary_rows(values: np.ndarray, bounds: np.ndarray) -> pa.Array:
    """Binary column whose row i is the bytes of values[bounds[i]:bounds[i+1]]."""
    size = values.dtype.itemsize
    return pa.Array.from_buffers(pa.binary(), len(bounds) - 1, [
        None, pa.py_buffer(np.ascontiguousarray(bounds * size, np.int32)),
        pa.py_buffer(np.ascontiguousarray(values))])
