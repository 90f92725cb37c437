"""Shared helpers: a workspace in the cluster's shared folder and Arrow plumbing.

Whatever one job leaves for another is a table under ``spark.checkpoint.dir``,
the folder that the cluster's machines share.
"""

from __future__ import annotations

import atexit
import ctypes
import shutil
import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Upper to lower case for A-Z only; other letters stay as they are.
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = UPPER.lower()
#: Spark deletes a query's shuffle files when the query ends.
FREE = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share.

    Where none is set, a session on one machine (tests) gets a folder of its
    own; on a cluster that is an error, as executors wouldn't see it.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all machines of the cluster share")
        found = tempfile.mkdtemp(prefix="genoloom-")
        atexit.register(shutil.rmtree, found, ignore_errors=True)
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


class Workspace:
    """Tables that one run of an operator writes to the shared folder."""

    def __init__(self, spark: SparkSession, name: str) -> None:
        self.spark = spark
        self.root = f"{shared_dir(spark)}/genoloom/{name}-{uuid.uuid4().hex}"

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def put(self, df: DataFrame, name: str, free: bool = False) -> DataFrame:
        """Write ``df`` and read it back, which cuts its lineage; ``free``: its shuffles' files go at once, not when the driver collects garbage."""
        before = self.spark.conf.get(FREE)
        try:
            self.spark.conf.set(FREE, str(free or before == "true").lower())
            df.write.mode("overwrite").parquet(self.path(name))
        finally:
            self.spark.conf.set(FREE, before)
        return self.spark.read.schema(df.schema).parquet(self.path(name))

    def drop(self, name: str) -> None:
        """Delete a table that nothing will read again."""
        jvm = self.spark._jvm
        path = jvm.org.apache.hadoop.fs.Path(self.path(name))
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def lower_ascii(column):
    """Lower-case A-Z only."""
    return F.translate(column, UPPER, LOWER)


def text_bytes(column: str = "text"):
    """The text as UTF-8 bytes; a null text is empty."""
    return F.coalesce(F.col(column), F.lit("")).cast("binary")


def text_hash(column="text"):
    """Tells the texts of one doc_id apart; a null text is empty."""
    return F.xxhash64(F.coalesce(F.col(column), F.lit("")))


def give_back() -> None:
    """What this process freed goes back to the system; the C library and Arrow would keep it for later."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError, TypeError):
        pass  # only glibc has it


def need(df: DataFrame, *columns: str) -> DataFrame:
    """Just these columns, so that extra columns of any name do no harm."""
    return df.select(*[F.col(f"`{c}`") for c in columns])
