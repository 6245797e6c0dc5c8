"""What several operators need: the shared folder, materialised tables, pass-through columns."""

from __future__ import annotations

import ctypes
import inspect
import math
import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir of the session.

    Where the setting is missing and the master is in-process (tests), a folder of this run
    takes its place; on a cluster a missing setting is an error.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    set_before = spark.sparkContext.getCheckpointDir()
    if set_before:
        return set_before.rstrip("/")
    master = spark.sparkContext.master
    if not (master == "local" or master.startswith("local[")):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="weftline-"))
    return spark.sparkContext.getCheckpointDir().rstrip("/")


def new_path(spark: SparkSession, tag: str) -> str:
    """An unused path in the shared folder, removed when the application ends."""
    path = f"{shared_dir(spark)}/weftline/{tag}-{uuid.uuid4().hex}"
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(hadoop)
    return path


def remove(spark: SparkSession, path: str) -> None:
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop, True)


_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def dropping_shuffles(spark: SparkSession):
    """Within, a query's shuffle files go when it ends, instead of when the driver happens to collect its garbage."""
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.unset(_CLEANUP) if before is None else spark.conf.set(_CLEANUP, before)


def materialize(df: DataFrame, tag: str) -> DataFrame:
    """Write once, read many: cuts lineage, so that a lost executor costs only a reread."""
    path = new_path(df.sparkSession, tag)
    with dropping_shuffles(df.sparkSession):
        df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"


def small_batches(spark: SparkSession) -> None:
    """Texts are long: where the session leaves Arrow batches at their default of 10,000 rows, they get 1,000."""
    if spark.conf.get(_BATCH, "10000") == "10000":
        spark.conf.set(_BATCH, "1000")


def give_back() -> None:
    """Returns freed memory of this Python worker to the system; workers stay alive between tasks and stages."""
    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library: nothing to do
        pass


def lean(function):
    """The function of a group, or of batches, that gives freed memory back when it ends."""
    if inspect.isgeneratorfunction(function):

        def batches(given):
            try:
                yield from function(given)
            finally:
                give_back()

        return batches

    def ended(*given):
        try:
            return function(*given)
        finally:
            give_back()

    # Spark tells by the number of parameters whether the key is wanted.
    return {1: lambda t: ended(t), 2: lambda a, b: ended(a, b), 3: lambda a, b, c: ended(a, b, c)}[len(inspect.signature(function).parameters)]


def slices(texts: list[bytes], size: int = 1 << 20):
    """Ranges of texts of about `size` bytes, one text at least."""
    at = 0
    while at < len(texts):
        upto, held = at, 0
        while upto < len(texts) and (upto == at or held + len(texts[upto]) <= size):
            held += len(texts[upto])
            upto += 1
        yield at, upto
        at = upto


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))


def others(df: DataFrame, *taken: str) -> list[str]:
    """The columns carried along unread: all but the ones taken, compared as Spark does (without case)."""
    gone = {c.lower() for c in taken}
    return [c for c in df.columns if c.lower() not in gone]


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def text_bytes(df: DataFrame, text_col: str) -> int:
    """UTF-8 bytes of all texts: one column read, one row back."""
    return df.agg(F.sum(F.octet_length(F.col(quoted(text_col)))).alias("n")).first()["n"] or 0


def pieces(total: int, each: int, least: int = 1) -> int:
    return max(least, math.ceil(total / each))
