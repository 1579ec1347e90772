"""Helpers shared by the training-data operators."""

from __future__ import annotations

import ctypes
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

#: Name under which an operator carries its caller's whole row, so that no column of the caller can clash.
ROW = "row"


_KEPT: dict[str, dict] = {}


def _trim() -> None:
    """Give memory that was let go back to the system; the allocators would keep it."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


def kept(owner: str) -> dict:
    """What an operator keeps in a Python worker between tasks. A worker serves many operators; when one begins, what others have kept is let go."""
    if others := [x for x in _KEPT if x != owner]:
        for other in others:
            del _KEPT[other]
        _trim()
    return _KEPT.setdefault(owner, {})


def trimmed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches, and at their end what the task has let go of back to the system: a worker waits for its next task with little memory."""
    yield from batches
    _trim()


@contextmanager
def small_batches(spark: SparkSession, size: int) -> Iterator[None]:
    """While it lasts, jobs hand Python batches of about ``size`` bytes instead of 64 MB."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(size))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def slices(batch: pa.RecordBatch, column: int, rows: int, size: int) -> Iterator[pa.RecordBatch]:
    """A batch in parts of at most ``rows`` rows and about ``size`` bytes in one of its columns, and of one row at least."""
    lengths = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_pylist()
    start = total = 0
    for i, n in enumerate(lengths):
        if i > start and (i - start >= rows or total + n > size):
            yield batch.slice(start, i - start)
            start, total = i, 0
        total += n
    if len(lengths) > start:
        yield batch.slice(start)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if folder:
        return folder
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("name a folder that driver and executors share in spark.checkpoint.dir")
    import tempfile  # one process: tests and trials

    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="redpen-"))
    return spark.sparkContext.getCheckpointDir()


def checkpoint(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable copy in the shared folder."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


class Scratch:
    """Tables of one run of an operator, in a folder of their own in the shared folder. They cut the lineage, and are deleted once nothing reads them."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.folder = spark, f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
        self.paths: dict[str, list[str]] = {}

    def table(self, df: DataFrame, name: str) -> DataFrame:
        """A copy of ``df``. A later table of the same name leaves the earlier ones as they are until its own is written."""
        earlier = self.paths.setdefault(name, [])
        path = f"{self.folder}/{name}-{uuid.uuid4().hex}"
        df.write.parquet(path)
        for old in earlier[:-1]:
            self._delete(old)
        self.paths[name] = [*earlier[-1:], path]
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *names: str) -> None:
        for name in names:
            for path in self.paths.pop(name, []):
                self._delete(path)

    def _delete(self, path: str) -> None:
        jvm = self.spark.sparkContext._jvm
        at = jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def per_text(df: DataFrame, text: str, schema: str, make: Callable[[], Callable[[list], Iterator | list]], keep: list[str] | None = None, encode: bool = True) -> DataFrame:
    """Run a Python function over whole texts, a record batch at a time, beside the rows it came from.

    ``make()`` is called once a task and returns a function from a list of texts (UTF-8 bytes, or str
    with encode=False; None for null) to a list of dicts of ``schema``. The result has the caller's columns (or those in ``keep``) as the struct
    ``row`` and the function's as the struct ``out``.
    """
    names = df.columns if keep is None else keep
    col = F.col(f"`{text}`").cast("string")
    carried = df.select(F.struct(*[F.col(f"`{n}`") for n in names]).alias(ROW), (col.cast("binary") if encode else col).alias("text"))
    out_type = T._parse_datatype_string(schema)
    from pyspark.sql.pandas.types import to_arrow_type

    arrow_out = to_arrow_type(out_type)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept("texts")
        work = make()
        for batch in batches:
            if batch.num_rows:
                got = work(batch.column(1).to_pylist())
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(got, type=arrow_out)], names=[ROW, "out"])

    return carried.mapInArrow(run, T.StructType([carried.schema[ROW], T.StructField("out", out_type)]))
