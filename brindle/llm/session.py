"""Reading tables, and cutting lineage in the folder that the cluster shares."""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession

from brindle.functions.workers import importable

BATCH_BYTES = "2m"


def fresh(df: DataFrame, name: str) -> str:
    """A name that no column of df has."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def plain(names: list[str]) -> list[str]:
    """Names quoted for select(), whatever they hold."""
    return ["`" + n.replace("`", "``") + "`" for n in names]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bounded_batches(df: DataFrame) -> DataFrame:
    """df, whose session's Arrow batches are kept to BATCH_BYTES: rows differ in size by orders of magnitude."""
    conf, key = importable(df.sparkSession).conf, "spark.sql.execution.arrow.maxBytesPerBatch"
    if conf.get(key, None) != BATCH_BYTES:
        conf.set(key, BATCH_BYTES)
    return df


def returning(f: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """f over a task's batches, after which the worker, which Spark keeps for later tasks, gives its free memory back."""

    def run(batches: Iterator) -> Iterator:
        try:
            yield from f(batches)
        finally:
            gc.collect()
            pa.default_memory_pool().release_unused()
            with contextlib.suppress(OSError, AttributeError):
                ctypes.CDLL("libc.so.6").malloc_trim(0)

    return run


_folders: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """This session's own folder in spark.checkpoint.dir, removed when Python ends; a temporary one only on a local master."""
    context = spark.sparkContext
    own = context.applicationId
    if own not in _folders:
        root = context.getConf().get("spark.checkpoint.dir")
        if not root:
            if not context.master.startswith("local"):
                raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
            root = tempfile.mkdtemp(prefix="brindle-")
        _folders[own] = f"{root}/brindle-{uuid.uuid4()}"
        atexit.register(remove, spark, _folders[own])
    return _folders[own]


def remove(spark: SparkSession, place: str) -> None:
    """Deletes a folder through Hadoop's file system; none, or a stopped session, is no error."""
    with contextlib.suppress(Exception):
        path = spark._jvm.org.apache.hadoop.fs.Path(place)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def hold(df: DataFrame) -> DataFrame:
    """df, kept on the executors' disks once it is computed; what is lost with an executor is computed again.

    For results that several steps read and no loop builds on; spark.catalog.clearCache() frees them.
    """
    return df.persist(StorageLevel.DISK_ONLY)


def cut(df: DataFrame) -> DataFrame:
    """df as a table that is written now, in the folder that the cluster shares.

    Unlike checkpoint() this forgets the estimated sizes too, which multiply at each join of
    an iteration, and plans go by the size of the files.
    """
    spark = df.sparkSession
    place = f"{shared_folder(spark)}/{uuid.uuid4()}"
    df.write.parquet(place)
    out = spark.read.schema(df.schema).parquet(place)
    out.written = place
    return out


def drop(df: DataFrame | None) -> None:
    """Deletes what cut() wrote, for tables that nothing reads any more."""
    if df is not None and getattr(df, "written", None):
        remove(df.sparkSession, df.written)
