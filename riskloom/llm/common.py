"""What the corpus operators share: reading tables, shared folders, byte kernels.

The kernels work on an Arrow string column as one buffer of bytes, with a newline after every
text, so that no Python loop runs over bytes or words.
"""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import AbstractContextManager, contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that a kernel takes at once; a longer text is taken alone.
CHUNK = 2 << 20
#: Words are runs of a-z, 0-9 and bytes of non-ASCII characters, after A-Z are lower-cased.
_b = np.arange(256)
LOWER = np.where((_b >= 65) & (_b <= 90), _b + 32, _b).astype(np.uint8)
WORD = ((_b >= 48) & (_b <= 57)) | ((_b >= 65) & (_b <= 90)) | ((_b >= 97) & (_b <= 122)) | (_b >= 128)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bounded_batches(spark: SparkSession) -> None:
    """Arrow batches end at 4 MB, so that long texts don't add up in a worker."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(4 << 20))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster names for checkpoints; a temporary one only where none is set and all is on one machine."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        context = spark.sparkContext
        if not context._jsc.sc().getCheckpointDir().isDefined():
            if not context._jsc.sc().isLocal():
                raise ValueError("spark.checkpoint.dir must name a folder that the executors share")
            context.setCheckpointDir(tempfile.mkdtemp(prefix="riskloom-shared-"))
        folder = context._jsc.sc().getCheckpointDir().get()
    return folder.rstrip("/")


def saved(df: DataFrame) -> DataFrame:
    """df as a checkpoint in the shared folder: it is computed once and outlives executors."""
    context = df.sparkSession.sparkContext
    if not context._jsc.sc().getCheckpointDir().isDefined():
        context.setCheckpointDir(shared_dir(df.sparkSession))
    return df.checkpoint(eager=True)


def new_folder(spark: SparkSession, kind: str) -> str:
    return f"{shared_dir(spark)}/{kind}-{uuid.uuid4().hex}"


def dropped(spark: SparkSession, folder: str) -> None:
    """Deletes a folder that new_folder named, in whichever store it is."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


@contextmanager
def setting(spark: SparkSession, name: str, value: str) -> Iterator[None]:
    """Within it, a setting of the session has a value; after it, what it had before."""
    before = spark.conf.get(name, None)
    spark.conf.set(name, value)
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def shuffles_dropped(spark: SparkSession) -> AbstractContextManager[None]:
    """Within it, a query's shuffle files go when the query ends."""
    return setting(spark, "spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true")


def local_path(url: str) -> str | None:
    """The path behind a file: URL or a bare path; None for another store."""
    if url.startswith("file:"):
        return "/" + url[5:].lstrip("/")
    return url if os.path.isabs(url) else None


def chunks(batch: pa.RecordBatch, column: str, limit: int = CHUNK) -> Iterator[pa.RecordBatch]:
    """Slices of batch whose texts have about limit bytes together, at least a row each."""
    size = np.asarray(pc.fill_null(pc.binary_length(batch.column(column)), 0), dtype=np.int64)
    total, at = np.cumsum(size), 0
    while at < len(size):
        before = total[at - 1] if at else 0
        end = max(at + 1, int(np.searchsorted(total, before + limit, "right")))
        yield batch.slice(at, end - at)
        at = end


def joined(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The texts as one array of bytes, a newline after each; null is empty.  Offsets has n + 1 places."""
    kind = pa.large_binary()  # a piece of a text may begin or end within a character
    column = pc.fill_null(column.cast(kind), pa.scalar(b"", kind))
    column = pc.binary_join_element_wise(column, pa.scalar(b"", kind), pa.scalar(b"\n", kind))
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64, len(column) + 1, column.offset * 8)
    if data is None or not len(offsets):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    return np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]], offsets - offsets[0]


def runs(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of True."""
    edge = np.flatnonzero(np.diff(np.concatenate(([0], mask.view(np.int8), [0]))))
    return edge[0::2], edge[1::2]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers (the finalizer of splitmix64)."""
    x = np.asarray(x, np.uint64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_power: dict[int, np.ndarray] = {}


def _powers(base: int, n: int) -> np.ndarray:
    have = _power.get(base)
    if have is None or len(have) < n:
        have = np.full(max(n, 1 << 16), base, np.uint64)
        have[0] = 1
        _power[base] = have = np.multiply.accumulate(have)
    return have[:n]


class Spans:
    """64-bit hashes of any spans of a buffer: equal bytes have equal hashes, wherever they stand."""

    def __init__(self, data: np.ndarray):
        weighed = _BYTE[data]
        weighed *= _powers(_BASE, len(data))
        self.sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(weighed, dtype=np.uint64)))

    def hash(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        inverse = _powers(_INVERSE, len(self.sums))
        return mix((self.sums[end] - self.sums[start]) * inverse[start] + (end - start).astype(np.uint64))


def word_spans(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return runs(WORD[data])


def free_name(df: DataFrame, name: str) -> str:
    """name, or name with underscores, so that no column of df has it."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name
