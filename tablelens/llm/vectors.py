"""Vectors of a table as rows of bytes, and bytes as numpy arrays.

A vector takes part when it is not null or empty, holds no null and no
non-finite component, and (unless ``zero`` allows it) is not zero.  Every row
that takes part is numbered and written once, so later jobs name rows alike
whatever happens to the executors.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablelens.llm.util import materialize


def _bytes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Replace the list column v by its components' bytes (little-endian)."""
    for batch in batches:
        if not batch.num_rows:
            continue
        v = batch.column(batch.schema.get_field_index("v"))
        flat = v.flatten()
        width = flat.type.bit_width // 8
        ends = np.asarray(v.offsets.to_numpy(), np.int64)
        ends = ((ends - ends[0]) * width).astype(np.int32)
        data = np.ascontiguousarray(flat.to_numpy(zero_copy_only=False))
        raw = pa.Array.from_buffers(pa.binary(), len(v), [None, pa.py_buffer(ends.tobytes()), pa.py_buffer(data.tobytes())])
        names = batch.schema.names
        yield pa.record_batch([raw if n == "v" else batch.column(n) for n in names], names=names)


def usable(rows: DataFrame, id_col: str, vector_col: str, zero: bool = False, dim: int | None = None) -> DataFrame:
    """(rid, vec_id, dim, v): the vectors that take part, written once; v holds
    floats of 4 bytes if the components are such, else of 8."""
    kind = rows.schema[vector_col].dataType
    narrow = isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.FloatType)
    v = F.col("v") if narrow else F.col("v").cast("array<double>")
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    good = F.coalesce((F.size("v") > 0) & finite, F.lit(False))
    if not zero:
        good = good & F.exists("v", lambda x: x != 0)
    if dim is not None:
        good = good & (F.size("v") == dim)
    named = rows.select(F.col(id_col).alias("vec_id"), F.col(vector_col).alias("v")).withColumn("v", v)
    named = named.where(good).select(F.monotonically_increasing_id().alias("rid"), "vec_id", F.size("v").alias("dim"), "v")
    fields = T.StructType([*named.schema.fields[:3], T.StructField("v", T.BinaryType())])
    return materialize(named.mapInArrow(_bytes, fields).withColumn("wide", F.lit(not narrow)))


def matrix(column: pa.Array, dim: int, kind=None) -> np.ndarray:
    """A binary Arrow column of equally long rows as a matrix of doubles (or
    of ``kind``); floats of 4 bytes are told by the length of a row."""
    n = len(column)
    if not n:
        return np.zeros((0, dim), kind or np.float64)
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, np.int32)[column.offset:column.offset + n + 1]
    raw = np.frombuffer(data, np.uint8)[off[0]:off[-1]]
    if kind is None:
        kind = np.float32 if len(raw) == 4 * dim * n else np.float64
        return np.frombuffer(raw.tobytes(), kind).reshape(n, dim).astype(np.float64)
    return np.frombuffer(raw.tobytes(), kind).reshape(n, dim)


def binaries(rows: np.ndarray) -> pa.Array:
    """Each row of a matrix as one binary value."""
    rows = np.ascontiguousarray(rows)
    step = rows.shape[1] * rows.itemsize
    ends = (np.arange(len(rows) + 1, dtype=np.int64) * step).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(rows), [None, pa.py_buffer(ends.tobytes()), pa.py_buffer(rows.tobytes())])
