"""What the operators of this subpackage share: input columns, shared storage, size checks."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: A table is broadcast only if its values are measured to be no more bytes than this.
BROADCAST_BYTES = 32 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share.

    A cluster names it in ``spark.checkpoint.dir``. Where that is unset, a local
    session gets a temporary folder once; on a cluster, whose executors would not
    see it, that is an error.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        jsc = spark.sparkContext._jsc.sc()
        option = jsc.getCheckpointDir()
        if option.isEmpty():
            if not spark.sparkContext.master.startswith("local"):
                raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
            spark.sparkContext.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="spark-"))
            option = jsc.getCheckpointDir()
        found = option.get()
    return found.rstrip("/")


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write a table to the shared folder and read it back.

    This cuts the lineage, so lost executors don't repeat what stands above, and
    several consumers read one copy.
    """
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path, compression="zstd")
    return df.sparkSession.read.schema(df.schema).parquet(path)


def forget(df: DataFrame) -> None:
    """Delete a table that `stored` wrote and that nothing reads any more."""
    spark = df.sparkSession
    jvm, conf = spark._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for file in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        path = jvm.org.apache.hadoop.fs.Path(file)
        path.getFileSystem(conf).delete(path, True)


#: Bytes that one value of a type takes; other types are measured.
WIDTHS = {T.LongType: 8, T.DoubleType: 8, T.IntegerType: 4, T.BooleanType: 1}


def weight(df: DataFrame) -> int:
    """Bytes of a stored table's values, about: its rows by their fixed widths and the measured lengths of texts and arrays."""
    fixed, measured = 16, []
    for f in df.schema.fields:
        width = WIDTHS.get(type(f.dataType))
        if width is not None:
            fixed += width
        elif isinstance(f.dataType, (T.StringType, T.BinaryType)):
            measured.append(F.octet_length(f"`{f.name}`"))
        else:
            measured.append(F.octet_length(F.to_json(F.struct(F.col(f"`{f.name}`")))))
    cells = [F.coalesce(c, F.lit(0)).cast("long") + 16 for c in measured]
    row = sum(cells, F.lit(fixed).cast("long"))
    return df.agg(F.sum(row)).first()[0] or 0


def small_or_not(df: DataFrame, size: int | None = None) -> DataFrame:
    """A broadcast hint for a stored table if its weight, measured here unless given, is under the bound."""
    return F.broadcast(df) if (weight(df) if size is None else size) <= BROADCAST_BYTES else df


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


@contextmanager
def bounded_batches(spark: SparkSession, rows: int = 1000) -> Iterator[None]:
    """Arrow batches of whole texts carry `rows` rows at most in the jobs run inside; the session's setting comes back after them."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    old = spark.conf.get(key, None)
    if old is None or not 0 < int(old) <= rows:
        spark.conf.set(key, str(rows))
    try:
        yield
    finally:
        spark.conf.unset(key) if old is None else spark.conf.set(key, old)


def parts_of(batches: Iterator[pa.RecordBatch], column: str, most: int = 1 << 22) -> Iterator[pa.RecordBatch]:
    """The batches, cut so that a part has about `most` bytes in a text column; a longer text is a part of its own."""
    for batch in batches:
        lengths = pa.compute.binary_length(batch.column(column)).to_pylist()
        first = size = 0
        for i, n in enumerate(lengths):
            if size and size + (n or 0) > most:
                yield batch.slice(first, i - first)
                first, size = i, 0
            size += n or 0
        if len(lengths) > first or not lengths:
            yield batch.slice(first)


def doc_key(doc_id: Column, text: Column) -> Column:
    """doc_id as a number; a null id gives one after all ids under 2**62 that depends on the text, so that null ids share no key."""
    late = F.lit(1 << 62) + F.xxhash64(F.coalesce(text, F.lit(""))).bitwiseAND(F.lit((1 << 61) - 1))
    return F.coalesce(doc_id.cast("long"), late)


def release_memory() -> None:
    """Give freed memory of a Python worker back to the system; workers live on between tasks."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def utf8_length(text: Column) -> Column:
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long")
