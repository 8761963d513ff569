"""Written intermediates in the folder that the cluster shares."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``.

    A local one is made up only in a local session, where driver and tasks share a disk; elsewhere a
    missing setting is an error, since executors would not see each other's files.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if folder:
        return folder
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    folder = tempfile.mkdtemp(prefix="spark-")
    spark.conf.set("spark.checkpoint.dir", folder)
    return folder


ROWS_A_FILE = 100_000


def keep(df: DataFrame, rows: int | None = None) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back.

    Cuts the lineage, survives lost executors, and gives later joins exact sizes to plan with. ``rows``, where
    known, bounds the rows of a narrow table: it is then written in files of a fair size, however many
    shuffle partitions there are.
    """
    spark = df.sparkSession
    if rows is not None:
        df = df.coalesce(max(spark.sparkContext.defaultParallelism, rows // ROWS_A_FILE + 1))
    path = f"{shared_folder(spark).rstrip('/')}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def give_back() -> None:
    """Return freed memory to the system: allocators keep it otherwise."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # not every C library has it
    if trim is not None:
        trim(0)


Rows = Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]


def giving_back(rows: Rows) -> Rows:
    """``rows`` for ``mapInArrow``, giving freed memory back at a task's end.

    Python workers are used again by later tasks, also by those of other operators, which would otherwise run
    beside the largest heap that any task before them needed.
    """

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from rows(batches)
        finally:
            give_back()

    return task
