"""Shared plumbing: tables, scratch storage that survives lost executors, hashing."""

from __future__ import annotations

import ctypes
import re
import tempfile
import uuid
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Characters that the contracts call white space at line and word ends.
BLANKS = " \t\n\x0b\x0c\r"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@lru_cache(maxsize=1)
def _own_folder() -> str:
    return "file://" + tempfile.mkdtemp(prefix="scratch-")


def scratch_root(spark: SparkSession) -> str:
    """The shared folder of ``spark.checkpoint.dir``; a local one only where it is unset and all runs in one process."""
    if shared := spark.conf.get("spark.checkpoint.dir", None):
        return shared.rstrip("/")
    if not re.fullmatch(r"local(\[.*\])?", master := spark.sparkContext.master):
        raise ValueError(f"spark.checkpoint.dir must name a folder that all machines share (master {master})")
    return _own_folder()


#: Batches that go to Python workers, where the session has nothing of its own: texts are cut up
#: there anyway, and what a batch takes is held several times over on its way.
_ARROW = {"spark.sql.execution.arrow.maxBytesPerBatch": ("67108864b", "8m")}


class Scratch:
    """Tables written to the shared folder to cut lineage.

    ``save`` writes and rereads a frame; ``drop`` deletes what is no longer needed.
    Files of a finished query stay until the folder is cleaned, since its lazy result
    may still read them.
    """

    def __init__(self, spark: SparkSession, label: str):
        self.spark = spark
        for name, (usual, ours) in _ARROW.items():
            if spark.conf.get(name, None) == usual:
                spark.conf.set(name, ours)
        self.root = f"{scratch_root(spark)}/{label}-{uuid.uuid4().hex[:12]}"

    def save(self, df: DataFrame, name: str, options: dict | None = None, by: str | None = None) -> DataFrame:
        """``by``: a column of whole numbers that has a folder for each of its values."""
        path = f"{self.root}/{name}"
        writer = df.write.mode("overwrite").options(**(options or {}))
        (writer.partitionBy(by) if by else writer).parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *names: str) -> None:
        jvm, conf = self.spark.sparkContext._jvm, self.spark.sparkContext._jsc.hadoopConfiguration()
        for name in names:
            path = jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
            path.getFileSystem(conf).delete(path, True)


def broadcast_if(df: DataFrame, weight: Column, most: int) -> DataFrame:
    """Broadcast if the ``weight`` of all rows (numbers, array entries) is ``most`` at most; else Spark shuffles.

    ``df`` should be written already, since it is read for this.
    """
    return F.broadcast(df) if (df.agg(F.sum(weight)).first()[0] or 0) <= most else df


def quoted(name: str) -> str:
    return f"`{name.replace('`', '``')}`"


def fold(df: DataFrame, *apart: str) -> DataFrame:
    """``apart`` columns as they are, all others in one struct ``kept``, where no name of theirs can clash."""
    rest = [F.col(quoted(c)).alias(c) for c in df.columns if c not in apart]
    return df.select(F.struct(*(rest or [F.lit(0).alias("none")])).alias("kept"), *(F.col(quoted(c)) for c in apart))


def unfold(df: DataFrame, columns: list[str], *more: Column) -> DataFrame:
    """``columns`` again in their order, those that aren't in ``kept`` from ``df`` itself, and ``more``."""
    inside = set(df.schema["kept"].dataType.names)
    return df.select(*(F.col(f"kept.{quoted(c)}").alias(c) if c in inside else F.col(quoted(c)) for c in columns), *more)


def with_fields(schema: StructType, ddl: str) -> StructType:
    """``schema`` and the fields that ``ddl`` names."""
    return StructType([*schema.fields, *StructType.fromDDL(ddl).fields])


def free(name: str, taken: list[str]) -> str:
    """``name``, with underscores before it until no column is named so."""
    while name.lower() in {t.lower() for t in taken}:
        name = f"_{name}"
    return name


def ascii_lower(text: str) -> str:
    """Lower-case A-Z only."""
    return text if text.islower() and text.isascii() else text.encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass")


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def crc_fold(column) -> "F.Column":
    """crc32 of an integer id written in decimal."""
    return F.crc32(column.cast("string").cast("binary"))


def column_list(batch: pa.RecordBatch, name: str) -> list:
    return batch.column(batch.schema.get_field_index(name)).to_pylist()


@lru_cache(maxsize=1)
def _allocator():
    """glibc's call that gives free memory back to the system, where there is one."""
    try:
        return ctypes.CDLL("libc.so.6").malloc_trim
    except (AttributeError, OSError):
        return None


def trim() -> None:
    """Python workers outlive their tasks: what a task no longer holds goes back, or workers grow to the sum of their peaks."""
    pa.default_memory_pool().release_unused()
    if _allocator():
        _allocator()(0)


def pieces(batches, rows: int = 2000, max_bytes: int = 8 << 20):
    """Cut Arrow batches so that a batch of very long texts doesn't fill a worker's memory."""
    trim()
    for batch in batches:
        n = max(1, min(rows, int(batch.num_rows * max_bytes / max(1, batch.nbytes))))
        for at in range(0, batch.num_rows, n):
            yield batch.slice(at, n)
    trim()
