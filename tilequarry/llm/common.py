"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import ctypes
import gc
import os
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar
from functools import wraps

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space of the word rule, as Java and RE2 write it, and its complement.
SPACE = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder driver and executors share: spark.checkpoint.dir, else the context's own.

    Only where neither is set, as on a laptop or in tests, a temporary one is made.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="tilequarry-")
        spark.sparkContext.setCheckpointDir(folder)
    return folder.rstrip("/")


def new_folder(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing else uses."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


_made: ContextVar[list[str] | None] = ContextVar("made", default=None)


@contextmanager
def noting(paths: list[str]) -> Iterator[None]:
    """Notes where written() puts its tables meanwhile."""
    before = _made.set(paths)
    try:
        yield
    finally:
        _made.reset(before)


def delete(spark: SparkSession, *paths: str) -> None:
    """Removes tables that nothing reads any more, wherever they lie."""
    for path in paths:
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def written(df: DataFrame, name: str, compression: str | None = None) -> DataFrame:
    """df as a table in the shared folder: cuts the lineage and survives lost executors."""
    path = new_folder(df.sparkSession, name)
    if (made := _made.get()) is not None:
        made.append(path)
    (df.write.option("compression", compression) if compression else df.write).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


class Scratch:
    """Tables in the shared folder that one job writes, and drops once what follows is written."""

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, {}

    def written(self, df: DataFrame, name: str) -> DataFrame:
        """As written(); the table can be dropped by its DataFrame."""
        own: list[str] = []
        with noting(own):
            table = written(df, name)
        if (made := _made.get()) is not None:
            made.extend(own)
        self.paths[id(table)] = (own[0], table)
        return table

    def drop(self, *tables: DataFrame) -> None:
        """Deletes tables that nothing reads any more; those of others are left alone."""
        for table in tables:
            path, _ = self.paths.pop(id(table), (None, None))
            if path:
                delete(self.spark, path)


def words(text: Column) -> Column:
    """Array of the maximal runs without white space; null and blank texts give an empty array."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), f"{SPACE}+"), "")


def row_struct(df: DataFrame, name: str = "doc") -> Column:
    """All columns of df in one struct, so that no name of theirs can clash with new ones."""
    return F.struct(*[df[f"`{c}`"] for c in df.columns]).alias(name)


def tokenizer_path(name: str) -> str:
    """Where a public vocabulary file lies; TOKENIZER_DIR takes precedence over the package."""
    folder = os.environ.get("TOKENIZER_DIR")
    if folder:
        return os.path.join(folder, name)
    import public_tokenizers

    return public_tokenizers.path(name)


@contextmanager
def no_cycle_search() -> Iterator[None]:
    """Spares work that makes many small objects and no cycles the search for them."""
    was = gc.isenabled()
    gc.disable()
    try:
        yield
    finally:
        if was:
            gc.enable()


def released(task: Callable[..., Iterator]) -> Callable[..., Iterator]:
    """A task that hands the memory it freed back to the system, since Python workers idle on for later stages."""

    @wraps(task)
    def run(*args, **kwargs) -> Iterator:
        try:
            yield from task(*args, **kwargs)
        finally:
            gc.collect()
            try:
                ctypes.CDLL("libc.so.6").malloc_trim(0)
            except (OSError, AttributeError):
                pass  # another C library: it keeps what it has

    return run
