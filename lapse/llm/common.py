"""Shared folder, written tables, Arrow batches and vectorised word hashing."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Rows per Arrow batch: texts are long, and a worker holds a batch or two at a time.
BATCH_ROWS = 512
_OWN: dict[str, str] = {}


def small_batches(spark: SparkSession) -> None:
    """Bound what a Python worker holds: few rows a batch, since one text may have megabytes."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The cluster's ``spark.checkpoint.dir``; a temporary folder only for a one-machine session without it."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    context = spark.sparkContext
    if not context.master.startswith("local[") and context.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if context.applicationId not in _OWN:
        _OWN[context.applicationId] = tempfile.mkdtemp(prefix="run-")
    return _OWN[context.applicationId]


def written(df: DataFrame, name: str) -> DataFrame:
    """The frame as a Parquet table in the shared folder: computed once, and whole if executors are lost.

    The folder goes when the driver ends.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/corpus-{uuid.uuid4().hex}/{name}"
    df.write.parquet(path)
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path).getParent()
    hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(hadoop)
    out = spark.read.schema(df.schema).parquet(path)
    out.written_folder = hadoop
    return out


def dropped(table: DataFrame) -> None:
    """Deletes a ``written`` table that nothing reads any more, before the driver ends."""
    hadoop = table.written_folder
    hadoop.getFileSystem(table.sparkSession._jsc.hadoopConfiguration()).delete(hadoop, True)


def added(sums: DataFrame, shape: tuple[int, int], fan_in: int = 16) -> np.ndarray:
    """Sum of float32 matrices, one per row: added in levels of ``fan_in``, the last one in a task; one comes to the driver."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = np.zeros(shape, np.float64)
        for batch in batches:
            for value in batch.column(0).to_pylist():
                out += np.frombuffer(value, np.float32).reshape(shape)
        yield pa.RecordBatch.from_arrays([pa.array([out.astype(np.float32).tobytes()])], ["m"])

    parts = sums.rdd.getNumPartitions()
    while parts > 1:
        parts = -(-parts // fan_in)
        sums = sums.repartition(parts).mapInArrow(run, "m binary")
    out = np.zeros(shape)
    for row in sums.collect():
        out += np.frombuffer(row["m"], np.float32).reshape(shape)
    return out


def blank(text: Column) -> Column:
    return F.coalesce(text, F.lit(""))


def strings(column: pa.Array) -> list[str]:
    return column.fill_null("").to_pylist()


def octets(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of each text, null as empty."""
    return pc.cast(column, pa.binary()).fill_null(b"").to_pylist()


# ASCII white space, the separators of words.
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
# Odd multiplier of the polynomial word hash and its inverse modulo 2**64.
_BASE = 0x9E3779B97F4A7C15
_BACK = pow(_BASE, -1, 1 << 64)
_powers = np.ones(1, np.uint64), np.ones(1, np.uint64)


def _power_tables(size: int) -> tuple[np.ndarray, np.ndarray]:
    global _powers
    if len(_powers[0]) < size:
        def grown(base: int) -> np.ndarray:
            out = np.full(size, base, np.uint64)
            out[0] = 1
            return np.multiply.accumulate(out)

        size = max(size, 1 << 16)
        _powers = grown(_BASE), grown(_BACK)
    return _powers


def mix(h: np.ndarray) -> np.ndarray:
    """Bijective 64-bit finaliser."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(64-bit hash of every word, index of its text), in order. Words are split at ASCII white space."""
    data = np.frombuffer(b"\n".join(texts), np.uint8)
    if not len(data):
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    inside = ~_SPACE[data]
    edge = np.diff(np.concatenate(([False], inside, [False])).astype(np.int8))
    start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    forth, back = _power_tables(len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * forth[: len(data)], out=sums[1:])
    h = mix((sums[end] - sums[start]) * back[start])
    first = np.cumsum([0] + [len(t) + 1 for t in texts[:-1]])
    return h, np.searchsorted(first, start, side="right") - 1
