"""Helpers the text operators share: stored tables, Arrow batches by key, local components."""

from __future__ import annotations

import ctypes
import re
import tempfile
from collections.abc import Iterator, Sequence
from functools import cache
from uuid import uuid4

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_stored: list[str] = []


@cache
def _own_dir(application: str) -> str:
    return tempfile.mkdtemp(prefix="llm-")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``.

    Where it is unset, the context's checkpoint folder, or a temporary one if driver and executors
    are one process.
    """
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if folder is None:
        if not re.fullmatch(r"local(\[.*\])?", context.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = _own_dir(context.applicationId)
    return folder.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    path = f"{shared_dir(spark)}/llm/{spark.sparkContext.applicationId}/{name}-{uuid4().hex}"
    _stored.append(path)
    return path


def store(df: DataFrame, name: str, compression: str | None = None) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts lineage, survives lost executors."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path, compression=compression)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def release(spark: SparkSession, since: int = 0, keep: str | None = None) -> int:
    """Delete what was stored after the first ``since`` tables and files, but for the path ``keep``.

    Call it when the results that read them have been written.
    """
    jvm, removed = spark._jvm, 0
    gone, _stored[since:] = [p for p in _stored[since:] if p != keep], [p for p in _stored[since:] if p == keep]
    for stored in gone:
        path = jvm.org.apache.hadoop.fs.Path(stored)
        fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
        removed += bool(fs.delete(path, True))
    return removed


def stored() -> int:
    """How many tables and files are stored now."""
    return len(_stored)


def fresh(df: DataFrame, name: str) -> str:
    """A column name that ``df`` does not have in any spelling."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def lowest_hashes(df: DataFrame, n: int, *keys: str) -> DataFrame:
    """The ``n`` rows whose keys hash lowest: a sample that a rerun repeats.

    Half as many again are let through by their hash before the rows meet, so the last task gets a
    few times ``n`` rows, however many tasks there are.
    """
    total = df.count()
    hashed = F.xxhash64(*keys)
    if total > 2 * n:
        df = df.where(hashed <= int(1.5 * n / total * 2**64) - 2**63)
    return df.orderBy(hashed, *keys).limit(n)


def without(docs: DataFrame, key: str, gone: DataFrame) -> DataFrame:
    """Rows of ``docs`` whose ``key`` is not in the one column of ``gone``; NULL keys stay."""
    return docs.join(gone.toDF(name := fresh(docs, "_gone")), docs[key] == F.col(name), "left_anti")


def by_key(batches: Iterator[pa.RecordBatch], keys: Sequence[str]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Regroup batches sorted by ``keys`` (integers without nulls) so that no key is cut.

    Yields a table and the bounds of its runs: run i is rows bounds[i] to bounds[i + 1]. The memory
    needed is that of one batch and one run.
    """
    rest: pa.Table | None = None
    parts: list[pa.Table] = []

    def changes(table: pa.Table) -> np.ndarray:
        cut = np.zeros(max(table.num_rows - 1, 0), dtype=bool)
        for key in keys:
            values = table.column(key).to_numpy()
            cut |= values[1:] != values[:-1]
        return np.flatnonzero(cut) + 1

    def first(table: pa.Table) -> tuple:
        return tuple(table.column(k)[0].as_py() for k in keys)

    for batch in batches:
        if not batch.num_rows:
            continue
        table = pa.Table.from_batches([batch])
        cuts = changes(table)
        if rest is not None and first(rest) == first(table):
            if not len(cuts):
                parts.append(table)
                continue
            table = pa.concat_tables([*parts, table])
            parts, rest = [], None
            cuts = changes(table)
        elif rest is not None:
            whole = pa.concat_tables(parts)
            yield whole, np.array([0, whole.num_rows])
            parts, rest = [], None
        if len(cuts):
            yield table.slice(0, cuts[-1]), np.concatenate([[0], cuts])
            table = table.slice(cuts[-1])
        rest, parts = table, [table]
    if rest is not None:
        whole = pa.concat_tables(parts)
        yield whole, np.array([0, whole.num_rows])


def text_slices(batch: pa.RecordBatch, column: str, most: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """``batch`` in slices of at most ``most`` bytes of ``column``, of one row at least."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False))
    start, done = 0, 0
    while start < batch.num_rows:
        stop = max(start + 1, int(np.searchsorted(ends, done + most, side="right")))
        yield batch.slice(start, stop - start)
        start, done = stop, int(ends[stop - 1])


def roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest reachable position of each of ``n`` nodes over the links ``a[i] - b[i]``."""
    root = np.arange(n)
    while len(a):
        low, high = np.minimum(root[a], root[b]), np.maximum(root[a], root[b])
        differ = low != high
        if not differ.any():
            break
        a, b, low, high = a[differ], b[differ], low[differ], high[differ]
        np.minimum.at(root, high, low)
        while (root[root] != root).any():
            root = root[root]
    return root


def trim() -> None:
    """Gives memory that a task no longer uses back to the system; its worker may go on to other work."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):
        pass  # another C library


def binary_column(values: Sequence[bytes]) -> pa.Array:
    return pa.array(values, type=pa.binary())
