"""Tables kept in the folder that all executors share, so that a lost executor costs no lineage."""

from __future__ import annotations

import ctypes
import uuid
from collections.abc import Callable, Iterator

import pyarrow
from pyspark.sql import DataFrame, SparkSession

from chatguard.sources import shared_folder


def new_folder(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder."""
    return f"{shared_folder(spark)}/chatguard/{name}-{uuid.uuid4().hex}"


def keep(df: DataFrame, name: str) -> DataFrame:
    """Write df once as Parquet in the shared folder and read it back: later steps start from the files."""
    spark = df.sparkSession
    path = new_folder(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def free_name(name: str, columns: list[str]) -> str:
    """name, with underscores at its end where a column of that name (in any case) exists."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


def released(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """The task function run, after which the worker gives free memory back: Spark keeps workers for later stages."""

    def wrapped(batches: Iterator) -> Iterator:
        try:
            yield from run(batches)
        finally:
            pyarrow.default_memory_pool().release_unused()
            if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
                trim(0)

    return wrapped
