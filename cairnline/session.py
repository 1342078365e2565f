"""Session factory, code shipping and the shared folder for intermediate tables."""

from __future__ import annotations

import ctypes
import gc
import hashlib
import os
import tempfile
import uuid
import zipfile

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

_shipped: set[str] = set()


def session(master: str | None = None, shuffle_partitions: int = 8, app: str = "cairnline") -> SparkSession:
    """A session with adaptive execution on; ``master`` only where none is configured."""
    builder = SparkSession.builder.appName(app).config("spark.sql.shuffle.partitions", shuffle_partitions)
    builder = builder.config("spark.sql.adaptive.enabled", "true").config("spark.sql.adaptive.skewJoin.enabled", "true")
    builder = builder.config("spark.sql.execution.arrow.pyspark.enabled", "true").config("spark.sql.session.timeZone", "UTC")
    return (builder.master(master) if master else builder).getOrCreate()


def ship(spark: SparkSession) -> None:
    """Send this package to the executors' Python workers, once for each application, and keep Arrow
    batches small where their size was left at its default: rows can be whole sequences."""
    if spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch") == "67108864b":
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", "8m")
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    top = os.path.dirname(os.path.abspath(__file__))
    path = os.path.join(tempfile.mkdtemp(), "cairnline_core.zip")
    with zipfile.ZipFile(path, "w") as z:
        for folder, _, names in os.walk(top):
            for name in (n for n in names if n.endswith(".py")):
                full = os.path.join(folder, name)
                z.write(full, os.path.relpath(full, os.path.dirname(top)))
    spark.sparkContext.addPyFile(path)
    _shipped.add(app)


def release() -> None:
    """Give back to the system what this Python worker no longer uses: workers serve task after task, and
    allocators keep what the largest of them took."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # where the C library has it
    if trim:
        trim(0)


def shared_dir(spark: SparkSession) -> str:
    """The folder driver and executors share; one of our own only in local mode, where none is configured."""
    place = spark.conf.get("spark.checkpoint.dir", None)
    if not place:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        place = "file://" + tempfile.mkdtemp(prefix="cairnline-")
        spark.conf.set("spark.checkpoint.dir", place)
    return place


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Cut lineage with a written table: survives the loss of executors and is computed once."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def fingerprint(df: DataFrame) -> str:
    """A digest of the files a table is read from: their names, sizes and times."""
    spark, parts = df.sparkSession, []
    for name in sorted(df.inputFiles()):
        place = spark._jvm.org.apache.hadoop.fs.Path(name)
        status = place.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(place)
        parts.append(f"{name}:{status.getLen()}:{status.getModificationTime()}")
    return hashlib.md5("\n".join(parts).encode()).hexdigest()


def exists(spark: SparkSession, path: str) -> bool:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place)
