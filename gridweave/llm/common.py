"""What the training-data operators share: shared-folder tables, session settings, input clean-up.

Every intermediate that is read more than once is a Parquet table under the folder that the
session names in ``spark.checkpoint.dir``; a lost executor costs the tasks it ran, never the
lineage before the table.
"""

from __future__ import annotations

import os
import tempfile
import uuid

from py4j.protocol import Py4JError
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def session(df: DataFrame) -> SparkSession:
    return df.sparkSession


def shared_dir(spark: SparkSession) -> str:
    """A new folder below ``spark.checkpoint.dir``; a local one only where that is unset and all tasks share this machine."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = os.path.join(tempfile.gettempdir(), "gridweave-shared")
    return f"{base.rstrip('/')}/gridweave-{uuid.uuid4().hex}"


#: Drops shuffle files when a query ends: what is needed later has been written as a table.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def trim(spark: SparkSession) -> str | None:
    """The driver's JVM gives back what its C heap holds free, tens of MB after some queries; None where it cannot (before JDK 17.0.9, off glibc)."""
    jvm = spark.sparkContext._jvm
    try:
        invoke = next(m for m in jvm.java.lang.Class.forName("javax.management.MBeanServer").getMethods() if m.getName() == "invoke")
        args = spark.sparkContext._gateway.new_array(jvm.java.lang.Object, 4)
        args[0], args[1] = jvm.javax.management.ObjectName("com.sun.management:type=DiagnosticCommand"), "systemTrimNativeHeap"
        return invoke.invoke(jvm.java.lang.management.ManagementFactory.getPlatformMBeanServer(), args)
    except Py4JError:
        return None


def stored(df: DataFrame, path: str, *partition_by: str) -> DataFrame:
    """Write ``df`` and read it back: lineage ends here."""
    spark = session(df)
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.mode("overwrite").option("compression", "zstd").partitionBy(*partition_by).parquet(path)
    finally:
        spark.conf.unset(CLEANUP) if before is None else spark.conf.set(CLEANUP, before)
    trim(spark)
    return spark.read.schema(df.schema).parquet(path)


def file_system(uri: str):
    """The file system that a shared folder's URI names, and the path in it: for tasks that read or write there themselves."""
    from pyarrow import fs

    if "://" not in uri and not uri.startswith("file:"):
        return fs.LocalFileSystem(), uri
    if uri.startswith("file:"):
        return fs.LocalFileSystem(), "/" + uri.removeprefix("file:").lstrip("/")
    return fs.FileSystem.from_uri(uri)


def discard(spark: SparkSession, *paths: str) -> None:
    """Delete intermediate tables whose readers have finished."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for path in paths:
        at = jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(conf).delete(at, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(c: Column) -> Column:
    """Lower-case A-Z and nothing else."""
    return F.when(c.rlike("[^\\x00-\\x7F]"), F.translate(c, UPPER, LOWER)).otherwise(F.lower(c))


def wrapped(df: DataFrame, **keys: Column) -> DataFrame:
    """``keys`` beside the whole row as ``row``: no name of the caller's can clash.  ``row.*`` gives it back."""
    return df.select(F.struct(*(F.col(f"`{c}`") for c in df.columns)).alias("row"), *(k.alias(n) for n, k in keys.items()))


def crc_mod(c: Column, m: int) -> Column:
    return F.crc32(c.cast("string").cast("binary")) % m
