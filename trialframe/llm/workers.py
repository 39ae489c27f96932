"""What Python workers share: parts of batches that are bounded in bytes, and memory that is given back.

Workers are used again by the next task, so what one task leaves with the allocators stays with the
executor for all that follows. ``parts`` hands what is free back to the system after every batch.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import SparkSession

#: Bytes of text in a part, about; a longer text is a part of its own.
PART_BYTES = 2 << 20
PART_ROWS = 1000


def trim() -> None:
    """Return unused memory of Arrow and of the C library to the system."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


def parts(batches: Iterator[pa.RecordBatch], text: int, rows: int = PART_ROWS, most: int = PART_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches in order, cut to at most ``rows`` rows and about ``most`` bytes of column ``text``."""
    for batch in batches:
        ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
        at = 0
        while at < batch.num_rows:
            past = int(ends[at - 1]) if at else 0
            to = min(max(at + 1, int(np.searchsorted(ends, past + most, side="right"))), at + rows, batch.num_rows)
            yield batch.slice(at, to - at)
            at = to
        del batch
        trim()


#: Bytes of an Arrow batch that goes to a worker, about: ten thousand long texts in one would not fit.
BATCH_BYTES = 4 << 20


def bound_batches(spark: SparkSession) -> None:
    """Bound Arrow batches in bytes more closely than by default, unless the application has a bound of its own."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if not spark.sparkContext.getConf().contains(key):
        spark.conf.set(key, str(BATCH_BYTES))
