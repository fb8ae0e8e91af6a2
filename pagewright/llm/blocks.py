"""Scratch tables in the shared folder, and packed blocks of rows that later steps can visit again.

Operators that must look at every text more than once pack the rows of each task into blocks of a few MB
(one compressed Arrow stream per row of a Parquet table). A row is then known by its block and place, so null
or repeated ids and any further columns need no care, and what other tasks find out about a block comes back by
an equi-join on its number.
"""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from functools import wraps

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession

BLOCK_BYTES = 8 << 20
NOTING: list[list[str]] = []  # who wants to know of new scratch tables, on the driver


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def scratch(spark: SparkSession) -> str:
    """The shared folder that the cluster names in spark.checkpoint.dir; a temporary one in local mode only."""
    conf = spark.sparkContext.getConf()
    folder = spark.conf.get("spark.checkpoint.dir", None) or conf.get("spark.checkpoint.dir")
    if not folder:
        if not conf.get("spark.master", "local").startswith("local[") and conf.get("spark.master", "local") != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="pagewright-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def saved(df: DataFrame, name: str, codec: str = "zstd") -> DataFrame:
    """Write a DataFrame to the scratch folder and read it back: later steps start from the files."""
    spark = df.sparkSession
    path = f"{scratch(spark)}/{name}-{uuid.uuid4().hex}"
    for tables in NOTING:
        tables.append(path)
    df.write.option("compression", codec).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def noted(tables: list[str]):
    """Adds the folders of the tables that saved() makes meanwhile to ``tables``."""
    NOTING.append(tables)
    try:
        yield
    finally:
        NOTING.remove(tables)


def discard(spark: SparkSession, tables: list[str]) -> None:
    """Delete folders of scratch tables that nothing reads any more."""
    conf = spark._jsparkSession.sessionState().newHadoopConf()
    while tables:
        path = spark._jvm.org.apache.hadoop.fs.Path(tables.pop())
        path.getFileSystem(conf).delete(path, True)


def give_back() -> None:
    """Return freed memory to the system: Python workers are kept for later tasks and stages, and would hold it meanwhile."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def thrifty(work: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """A task's function that gives memory back after each of its results."""

    @wraps(work)
    def run(rows: Iterator) -> Iterator:
        for out in work(rows):
            yield out
            give_back()
        give_back()

    return run


def dump(batches: list[pa.RecordBatch]) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batches[0].schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
        for b in batches:
            out.write_batch(b)
    return sink.getvalue().to_pybytes()


def load(payload: bytes) -> pa.RecordBatch:
    """The rows of a block as one batch."""
    table = pa.ipc.open_stream(payload).read_all().combine_chunks()
    return table.to_batches()[0] if table.num_rows else pa.RecordBatch.from_pylist([], schema=table.schema)


def squeezed(x: np.ndarray) -> bytes:
    """Numbers of at least 0, or floats, in few bytes, low bytes first; loosened() gives them back."""
    if x.dtype.kind != "f":
        x = x.astype(np.min_scalar_type(x.max(initial=0)))
    planes = np.ascontiguousarray(x).view(np.uint8).reshape(-1, x.dtype.itemsize).T
    return x.dtype.char.encode() + len(x).to_bytes(8, "little") + pa.compress(planes.tobytes(), "zstd", asbytes=True)


def loosened(data: bytes) -> np.ndarray:
    kind, n = np.dtype(chr(data[0])), int.from_bytes(data[1:9], "little")
    planes = np.frombuffer(pa.decompress(data[9:], n * kind.itemsize, "zstd", asbytes=True), np.uint8)
    return np.ascontiguousarray(planes.reshape(kind.itemsize, n).T).view(kind)[:, 0]


def pack(
    df: DataFrame, size: int = BLOCK_BYTES, names: tuple[str, ...] = (), made: Callable[[pa.RecordBatch], list[bytes]] | None = None, left_out: tuple[int, ...] = ()
) -> DataFrame:
    """(block_id, payload, *names) rows that hold all rows of ``df``, about ``size`` bytes each before compression.

    ``made`` gives the further columns, binary, of a block's rows. It sees the columns at ``left_out`` too, which payload lacks.
    """

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 24
        held, weight = [], 0

        def out():
            nonlocal number, held, weight
            payload = dump([b.select([i for i in range(b.num_columns) if i not in left_out]) for b in held])
            parts = [payload, *(made(pa.Table.from_batches(held).combine_chunks().to_batches()[0]) if made else [])]
            row = pa.RecordBatch.from_arrays([pa.array([number], pa.int64()), *[pa.array([x], pa.binary()) for x in parts]], ["block_id", "payload", *names])
            number, held, weight = number + 1, [], 0
            return row

        for batch in batches:
            rows = max(1, int(size * batch.num_rows / max(1, batch.nbytes)))
            for i in range(0, batch.num_rows, rows):
                part = batch.slice(i, rows)
                held.append(part)
                weight += part.nbytes
                if weight >= size:
                    yield out()
        if held:
            yield out()

    return df.mapInArrow(blocks, "block_id long, payload binary" + "".join(f", {n} binary" for n in names))
