"""What the operators share: staged tables, words and row keys."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import time
from collections.abc import Callable, Iterator

import pyarrow as pa
from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodeline import scratch
from lodeline.scratch import drop, release, shared_dir, stage_path  # noqa: F401  of the operators' interface

#: A word of the contracts on documents: a run of bytes that are no ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def staged(df: DataFrame, name: str, *by: str, tidy: bool = False) -> DataFrame:
    """df written as Parquet into the shared folder and read again, which cuts the lineage. With tidy
    the shuffle files behind it, which are of no more use, are deleted now: worth it for large
    tables, as it collects the driver's garbage."""
    out = scratch.staged(df, name, *by)
    if tidy:
        free(df.sparkSession)
    return out


def free(spark: SparkSession) -> None:
    """Spark deletes shuffle files once the driver has collected its garbage, so this does it, and
    lets the driver's C library give back what many plans have left there. Where everything runs in
    one process, one collection without waiting has to do."""
    gc.collect()
    if scratch.is_local(spark):
        spark._jvm.System.gc()
        return
    for _ in range(2):  # Python's references reach the JVM a little later
        spark._jvm.System.gc()
        time.sleep(0.2)
    _trim(spark)


#: What a Python worker keeps from task to task: its owner, and how it goes.
kept: dict[str, Callable[[], object]] = {}


def lean(batches: Iterator[pa.RecordBatch], owner: str) -> Iterator[pa.RecordBatch]:
    """batches, of one task of an operator. Python workers live on and serve all operators in turn, so
    what they keep for others goes before, and what the task freed goes back to the system after: an
    executor's memory holds all of its idle workers too."""
    for other, forget in kept.items():
        if other != owner:
            forget()
    try:
        yield from batches
    finally:
        del batches
        give_back()


def give_back() -> None:
    """Memory that Arrow and the C library hold unused goes back to the system, where they can."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(AttributeError, OSError):
        ctypes.CDLL(None).malloc_trim(0)


def _trim(spark: SparkSession) -> None:
    """The JVM's own command for it; a JVM that has none is left alone."""
    jvm, array = spark._jvm, spark.sparkContext._gateway.new_array
    find = jvm.java.lang.Class.forName
    kinds = array(jvm.java.lang.Class, 4)
    for i, name in enumerate(("javax.management.ObjectName", "java.lang.String", "[Ljava.lang.Object;", "[Ljava.lang.String;")):
        kinds[i] = find(name)
    given = array(jvm.java.lang.Object, 4)
    given[0], given[1] = jvm.javax.management.ObjectName("com.sun.management:type=DiagnosticCommand"), "systemTrimNativeHeap"
    given[2], given[3] = array(jvm.java.lang.Object, 0), array(jvm.java.lang.String, 0)
    try:
        find("javax.management.MBeanServer").getMethod("invoke", kinds).invoke(jvm.java.lang.management.ManagementFactory.getPlatformMBeanServer(), given)
    except Py4JJavaError:
        pass


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(c: Column) -> Column:
    """c with A-Z, and nothing else, lower-cased."""
    return F.translate(c, UPPER, LOWER)


def word_count(c: Column) -> Column:
    """How many WORDs c holds; 0 for null."""
    return F.coalesce(F.regexp_count(c, F.lit(WORD)), F.lit(0)).cast("long")
