"""The folder that driver and executors share, and tables written to it to cut lineage."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

#: The list that notes what cut writes (see noted), and the temporary folder of a local session that names none.
_NOTES: ContextVar[list[str] | None] = ContextVar("notes", default=None)
_OWN: list[str] = []


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; a temporary one only where none is set and the master is local."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base is None:
        master = spark.conf.get("spark.master", "")
        if master != "local" and not master.startswith("local["):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        if not _OWN:
            _OWN.append(tempfile.mkdtemp(prefix="lodeworks-"))
            atexit.register(shutil.rmtree, _OWN[0], ignore_errors=True)
        base = _OWN[0]
    return base


def new_folder(spark: SparkSession) -> str:
    """The name of a new folder in the shared one; noted like those that cut writes."""
    path = f"{shared_folder(spark)}/lodeworks-{uuid.uuid4().hex}"
    if (notes := _NOTES.get()) is not None:
        notes.append(path)
    return path


def cut(df: DataFrame) -> DataFrame:
    """The same rows, written as Parquet to the shared folder and read again.

    Unlike checkpoint(), the files are compressed and later reads take just the columns they need. The shuffle
    files of the jobs that made the rows are of no more use; a collection lets the driver drop them at once.
    The files stay until whoever has noted them drops them: a lazy result needs them.
    """
    spark = df.sparkSession
    path = new_folder(spark)
    df.write.option("mapreduce.fileoutputcommitter.marksuccessfuljobs", "false").parquet(path)  # nobody waits for a mark
    schema = df.schema
    del df
    spark.sparkContext._jvm.System.gc()
    return spark.read.schema(schema).parquet(path)


@contextmanager
def noted() -> Iterator[list[str]]:
    """Notes the folders that cut writes inside the block, and only those."""
    token = _NOTES.set([])
    try:
        yield _NOTES.get()
    finally:
        _NOTES.reset(token)


def drop(spark: SparkSession, paths: list[str]) -> None:
    """Deletes folders in the shared folder; call it when the results that read them are written."""
    jvm = spark.sparkContext._jvm
    for path in paths:
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def cut_only(spark: SparkSession, build: Callable[[], DataFrame]) -> DataFrame:
    """cut of what build returns; the tables that build itself has cut are deleted once that is written."""
    with noted() as made:
        df = build()
    out = cut(df)
    drop(spark, made)
    return out


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
