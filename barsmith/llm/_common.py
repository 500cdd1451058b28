"""Helpers shared by the corpus operators."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

#: The white space of every word and normalisation rule here.
SPACE = b" \t\n\x0b\x0c\r"
WORD = r"[^\x20\x09-\x0D]+"


#: Arrow batches that Python gets at most: texts may be very long.
BATCH_BYTES = 16 << 20


def ship(spark: SparkSession) -> None:
    """Send the package to the Python workers, once a context: they needn't find it on a path of their own."""
    sc = spark.sparkContext
    if getattr(sc, "_barsmith_shipped", False):
        return
    package = Path(__file__).resolve().parents[1]
    archive = Path(tempfile.mkdtemp(prefix="barsmith-")) / "barsmith.zip"
    with zipfile.ZipFile(archive, "w") as out:
        for f in sorted(package.rglob("*.py")):
            out.write(f, f.relative_to(package.parent))
    sc.addPyFile(str(archive))  # Spark's file server hands it out
    sc._barsmith_shipped = True


def bounded_batches(spark: SparkSession) -> None:
    """Lower the session's limit of an Arrow batch to BATCH_BYTES, if it is higher; and see that workers have the package."""
    ship(spark)
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = spark.sparkContext._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(key))
    if now <= 0 or now > BATCH_BYTES:
        spark.conf.set(key, str(BATCH_BYTES))


def tidy(f: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """f, and the worker's free memory given back after: workers stay for later stages, beside those stages' own needs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from f(batches)
        finally:
            gc.collect()
            pa.default_memory_pool().release_unused()
            with contextlib.suppress(OSError, AttributeError):  # another C library
                ctypes.CDLL("libc.so.6").malloc_trim(0)

    return run


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the folder the cluster names in spark.checkpoint.dir; pick one only where none is set."""
    bounded_batches(spark)
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isDefined():
        return
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        folder = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_checkpoints"
    sc.setCheckpointDir(folder)


def cut(df: DataFrame) -> DataFrame:
    """Materialise df in the shared checkpoint folder: lineage ends here and lost executors cost nothing before it."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def written(df: DataFrame) -> tuple[DataFrame, Callable[[], None]]:
    """df as a table in the shared checkpoint folder, and what deletes it.

    A checkpointed frame keeps the size that its plan was estimated at, and joins multiply sizes: in a loop the
    number's digits double every round until planning takes minutes. A table has the size of its files.
    """
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    folder = f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/table-{uuid.uuid4().hex}"
    df.write.parquet(folder)
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    return spark.read.parquet(folder), lambda: path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def utf8(column: pa.Array) -> Iterator[bytes]:
    """The UTF-8 bytes of a string column, null as empty."""
    for value in column.cast(pa.binary()):
        yield value.as_py() or b""


def strings(column: pa.Array) -> Iterator[str]:
    """A string column's texts, null as empty, one at a time."""
    for value in column:
        yield value.as_py() or ""
