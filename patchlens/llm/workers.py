"""Python workers: they must find this package, as tasks import their helpers, and keep what they have built."""

import ctypes
import gc
import os

import pyarrow as pa
from pyspark.sql import SparkSession

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def find_package(spark: SparkSession) -> None:
    """Add the folder of this package to the workers' path.

    That is enough where executors see the same installation; elsewhere submit the
    package with --py-files.
    """
    environment = spark.sparkContext.environment
    known = environment.get("PYTHONPATH", "")
    if ROOT not in known.split(os.pathsep):
        environment["PYTHONPATH"] = os.pathsep.join(filter(None, [ROOT, known]))


_kept: dict = {}


def give_back() -> None:
    """Return freed memory to the system, which the allocators keep otherwise; where libc has no such call, Arrow's only."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def tool(key: tuple, make):
    """What make() gives, kept by this worker for later tasks that ask for the same key.

    A worker keeps one tool at a time: it serves the stages of a job one after another,
    and what an earlier stage remembers must not take memory from a later one.
    """
    if key not in _kept:
        if _kept:
            _kept.clear()
            give_back()
        _kept[key] = make()
    return _kept[key]
