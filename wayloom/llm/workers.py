"""Memory of Python workers, which Spark keeps from task to task and from stage to stage."""

from __future__ import annotations

import ctypes

import pyarrow as pa
from pyspark.sql import SparkSession

_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"
#: Bytes of one Arrow batch: Spark's own bound of 64 MB is held several times over, by the JVM and by each worker of an executor.
BATCH_BYTES = "4MB"

_caches: list[dict] = []


def small_batches(spark: SparkSession) -> bool:
    """From now on the session sends rows to Python in batches of ``BATCH_BYTES``, unless it has a bound of its own. Whether that is new."""
    if _BATCH in spark.conf.getAll:
        return False
    spark.conf.set(_BATCH, BATCH_BYTES)
    return True


def usual_batches(spark: SparkSession) -> None:
    spark.conf.unset(_BATCH)


def cache(kept: dict) -> dict:
    """``kept`` as a cache that a worker keeps between tasks until another operator needs the memory."""
    _caches.append(kept)
    return kept


def only(kept: dict | None) -> None:
    """Empties the caches of other operators, so that they don't add up in a worker."""
    for other in _caches:
        if other is not kept:
            other.clear()


def give_back() -> None:
    """Returns freed memory to the system: Arrow and the C library both keep it, and a worker lives on."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):  # glibc has it
        trim(0)
