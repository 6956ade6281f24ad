"""Shared folder, names and column helpers of the text operators."""

from __future__ import annotations

import ctypes
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import shared_dir

#: What ``\\s``-free byte classes mean in every contract here: blank, tab, LF, VT, FF, CR.
ASCII_SPACE = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def ascii_lower(c: Column) -> Column:
    """A-Z become a-z; no other letter changes."""
    return F.translate(c, UPPER, LOWER)


def named(df: DataFrame, name: str) -> str:
    """The column of df that ``name`` means: the one spelt so, else the only one that differs in case alone."""
    if name in df.columns:
        return name
    same = [c for c in df.columns if c.lower() == name.lower()]
    if len(same) != 1:
        raise ValueError(f"{name}: {'several columns' if same else 'no column'} of that name among {df.columns}")
    return same[0]


def whole_text(name: str) -> Column:
    """The column as string, null as empty."""
    return F.coalesce(F.col(quoted(name)).cast("string"), F.lit(""))


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def without(df: DataFrame, *names: str) -> list[Column]:
    """All columns of df but those named (in any case), for an operator's own columns to take their place."""
    gone = {n.lower() for n in names}
    return [F.col(quoted(c)) for c in df.columns if c.lower() not in gone]


class Workspace:
    """A folder of written tables under the shared one. Tables cut lineage: a lost executor costs only the running step.

    What a returned plan still reads must stay until it has run. ``drop`` frees superseded tables before that, the end
    of a ``scope`` all that were made in it, and the end of the driver's JVM whatever is left.
    """

    _open: list[list["Workspace"]] = []

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.path = f"{shared_dir(spark)}/tallyloom-{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex[:12]}"
        fs, p = self._hadoop(self.path)
        fs.mkdirs(p)
        fs.deleteOnExit(p)
        if self._open:
            self._open[-1].append(self)

    def _hadoop(self, path: str) -> tuple:
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()), p

    def at(self, name: str) -> str:
        return f"{self.path}/{name}"

    def table(self, df: DataFrame, name: str, partition_by: list[str] | None = None) -> DataFrame:
        """Write df and return a frame that reads it."""
        writer = df.write.mode("overwrite")
        if partition_by:
            writer = writer.partitionBy(*partition_by)
        writer.parquet(self.at(name))
        return self.read(name, df)

    def read(self, name: str, like: DataFrame) -> DataFrame:
        return self.spark.read.schema(like.schema).parquet(self.at(name))

    def drop(self, *names: str) -> None:
        for n in names:
            fs, p = self._hadoop(self.at(n))
            fs.delete(p, True)

    def close(self) -> None:
        fs, p = self._hadoop(self.path)
        fs.delete(p, True)
        fs.cancelDeleteOnExit(p)


def lean(run: Callable) -> Callable:
    """``run``, a function of Arrow batches, that gives back at its end what the worker's allocators hold without need: a
    worker lives on for other stages, and an executor's memory counts all of its workers."""

    def leaving(batches: Iterator) -> Iterator:
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            if (trim := getattr(ctypes.CDLL(None), "malloc_trim", None)) is not None:
                trim(0)

    return leaving


@contextmanager
def scope() -> Iterator[None]:
    """Frees, at its end, the workspaces that operators made within: write what is to last before."""
    made: list[Workspace] = []
    Workspace._open.append(made)
    try:
        yield
    finally:
        Workspace._open.pop()
        for ws in made:
            ws.close()
