"""How much of a table Python workers get at a time, and the tables between steps of an operator."""

from __future__ import annotations

import ctypes
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from ..operators.tables import drop, folder, reserved, scope, size, written

#: Bytes of rows that a Python worker gets at a time; workers and the buffers they are fed by hold a few times as much.
BATCH_BYTES = 1 << 20
_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"


def bounded(rows: DataFrame) -> DataFrame:
    """The rows, for Python workers: from here on the session sends ``BATCH_BYTES`` at a time, or less if it is set so."""
    number, unit = re.fullmatch(r"(\d+)([a-z]*)", rows.sparkSession.conf.get(_BATCH).lower()).groups()
    size = int(number) << {"": 0, "b": 0, "k": 10, "kb": 10, "m": 20, "mb": 20}.get(unit, 30)
    if not 0 < size <= BATCH_BYTES:
        rows.sparkSession.conf.set(_BATCH, str(BATCH_BYTES))
    return rows


def released(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``run`` for ``mapInArrow``; at its end the worker, which Spark keeps for other tasks, gives freed memory back to the system."""

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):  # glibc has it
                trim(0)

    return whole


__all__ = ["BATCH_BYTES", "bounded", "drop", "folder", "released", "reserved", "scope", "size", "written"]
