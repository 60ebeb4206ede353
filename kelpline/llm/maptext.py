"""Run a NumPy function over every whole text, without a shuffle."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import bytes_np as B
from .store import small_batches

#: (bytes, offsets[, a further column]) of some whole texts -> one Arrow array per result field.
TextFunction = Callable[..., list[pa.Array]]


def let_go() -> None:
    """Give memory that a finished task freed back to the system: workers live on between stages."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


def map_texts(df: DataFrame, column: str, make: Callable[[], TextFunction], result: str, carry: list[str], slice_bytes: int = 1 << 20, with_column: str | None = None) -> DataFrame:
    """The columns ``carry`` of each row, then the fields that ``result`` (DDL) names.

    ``make`` runs once in each task. Carried columns travel inside a struct, so their names can't
    clash with the result's while the function runs. A null text counts as empty. The function also
    gets the column ``with_column``, if there is one.
    """
    small_batches(df.sparkSession)
    fields = T._parse_datatype_string(result)
    more = [F.col(f"`{with_column}`").alias("more")] if with_column else []
    packed = df.select(F.col(f"`{column}`").cast("string").alias("text"), F.struct(*[F.col(f"`{c}`") for c in carry]).alias("carry"), *more)
    schema = T.StructType([packed.schema["carry"], T.StructField("result", fields)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f, names = make(), fields.fieldNames()
        try:
            for batch in batches:
                data, offsets = B.text_buffers(batch.column(0))
                for a, b in B.slices(offsets, slice_bytes):
                    further = [batch.column(2).slice(a, b - a)] if with_column else []
                    arrays = f(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], *further)
                    yield pa.RecordBatch.from_arrays([batch.column(1).slice(a, b - a), pa.StructArray.from_arrays(arrays, names=names)], names=["carry", "result"])
        finally:
            del f
            let_go()

    out = packed.mapInArrow(run, schema)
    return out.select(*[F.col(f"carry.`{c}`") for c in carry], *[F.col(f"result.`{c}`") for c in fields.fieldNames()])
