"""Helpers shared by the training-data operators."""

from __future__ import annotations

import tempfile
import threading
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One input table, read by Spark only, so that any Hadoop path works."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share.  Where the session names none, one of our own if all runs on this machine."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        current = spark.sparkContext._jsc.sc().getCheckpointDir()
        if not current.isDefined():
            if not spark.sparkContext.master.startswith("local"):
                raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
            spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="weftline-"))
            current = spark.sparkContext._jsc.sc().getCheckpointDir()
        folder = current.get()
    return folder.rstrip("/")


#: With this, Spark deletes the shuffle files of a query as soon as it has ended.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def materialise(df: DataFrame) -> DataFrame:
    """Cut lineage: write ``df`` as Parquet in the shared folder and read it back.

    The files survive the loss of any executor, unlike a local checkpoint, and the shuffles behind them are freed.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/weftline/{spark.sparkContext.applicationId}/{uuid.uuid4().hex}"
    before = spark.conf.get(_CLEANUP, "false")
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(_CLEANUP, before)
    out = spark.read.schema(df.schema).parquet(path)
    out._materialised_at = path
    if (tables := getattr(_made, "tables", None)) is not None:
        tables.append(out)
    return out


#: The tables of the innermost ``scope`` of each thread.
_made = threading.local()


@contextmanager
def scope() -> Iterator[Callable[[DataFrame], DataFrame]]:
    """Delete the tables that are written inside at its end, but for those that are passed to the function it gives."""
    outer = getattr(_made, "tables", None)
    _made.tables = mine = []
    kept: list[DataFrame] = []

    def keep(df: DataFrame) -> DataFrame:
        kept.append(df)
        return df

    try:
        yield keep
    finally:
        _made.tables = outer
        stay = {df._materialised_at for df in kept}
        discard(*[df for df in mine if df._materialised_at not in stay])
        if outer is not None:
            outer += kept


def discard(*tables: DataFrame) -> None:
    """Delete the files of tables that ``materialise`` returned and that nothing reads any more."""
    for df in tables:
        _delete(df.sparkSession, df._materialised_at)


#: A key is hot if it has more than so many rows, and more than this part of all rows: so there are fewer hot keys than these.
HOT_ROWS, HOT_KEYS = 2_000, 50_000


def skew_join(rows: DataFrame, keyed: DataFrame, on: list[str], many: str, total: int, how: str = "inner") -> DataFrame:
    """``rows`` (``total`` of them) with what ``keyed`` has for their keys, none of which gathers in one task.

    ``keyed`` is a table with one row for each key, and in ``many`` at least the number of its rows.  The few keys
    that can have more than ``total / HOT_KEYS`` rows are broadcast, so that their rows stay where they are; all others
    meet by a shuffle.  ``how``: inner, or left for rows whose key ``keyed`` lacks.  The columns are those of an ordinary join.
    """
    if total <= HOT_ROWS:
        return rows.join(keyed, on, how)
    if getattr(keyed, "_materialised_at", None) is None:
        keyed = materialise(keyed)
    hot = F.col(many) > max(HOT_ROWS, total // HOT_KEYS)
    few = keyed.where(hot)
    if few.isEmpty():
        return rows.join(keyed, on, how)
    rest = rows.join(F.broadcast(few.select(*on)), on, "left_anti").join(keyed.where(~hot), on, how)
    return rows.join(F.broadcast(few), on).unionByName(rest)


def unused(df: DataFrame, name: str) -> str:
    """``name``, or that with as many underscores that ``df`` has no such column."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def release(spark: SparkSession) -> None:
    """Delete every table that ``materialise`` wrote for this application."""
    _delete(spark, f"{shared_dir(spark)}/weftline/{spark.sparkContext.applicationId}")


def _on_its_file_system(spark: SparkSession, name: str):
    path = spark._jvm.org.apache.hadoop.fs.Path(name)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()), path


def _delete(spark: SparkSession, name: str) -> None:
    system, path = _on_its_file_system(spark, name)
    system.delete(path, True)


def _exists(spark: SparkSession, name: str) -> bool:
    system, path = _on_its_file_system(spark, name)
    return system.exists(path)


def held_out(doc_id: Column) -> Column:
    """Whether crc32 of the id as text leaves remainder 2 when divided by 4; a null id is not held out."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))


def lower_ascii(text: Column) -> Column:
    """Lower-case A-Z and nothing else."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def slices(batch: pa.RecordBatch, most: int, column: str = "text", limit: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Parts of a batch with at most ``most`` rows and about ``limit`` bytes of text; a row is never split."""
    if not batch.num_rows:
        return
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    start, total = 0, 0
    for i, n in enumerate(sizes):
        if i > start and (total + n > limit or i - start >= most):
            yield batch.slice(start, i - start)
            start, total = i, 0
        total += int(n)
    yield batch.slice(start)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser, so that sums and products become evenly spread."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x
