"""Token ids of a corpus in Simple-8b files, written in the order of the ids of documents."""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from uuid import uuid4

import numpy as np
import pandas as pd
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stakeline.llm.common import new_path, store, text_slices, trim
from stakeline.llm.simple8b import Reader, Writer
from stakeline.llm.tokens import encoder

# Text per file, about.
FILE_BYTES = 32 << 20
END = 2
# Stands for a document without an id in a file.
NO_ID = -(1 << 63)
FILES = "part bigint, path string, bytes bigint, docs bigint, ids bigint"


def _write(folder: str, tokenizer: str, end: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, part, writer = encoder(tokenizer, strip=True), TaskContext.get().partitionId(), None
        system, path = fs.FileSystem.from_uri(folder)
        # Another attempt of this task writes another file; the list names those that count.
        path, docs = f"{path}/{part:06d}-{uuid4().hex}.s8b", 0
        for batch in batches:
            if writer is None:
                system.create_dir(path.rpartition("/")[0], recursive=True)
                stream = system.open_output_stream(path, compression=None)
                writer = Writer(stream)
            for piece in text_slices(batch, "text"):
                names = piece.column("id").fill_null(NO_ID).to_pylist()
                for doc, ids in zip(names, encode.batches(piece.column("text").to_pylist())):
                    writer.add(doc, np.append(ids, np.uint32(end)))
                    docs += 1
        if writer is not None:
            total = writer.close()
            size = stream.tell()
            stream.close()
            columns = [[part], [f"{folder}/{path.rpartition('/')[2]}"], [size], [docs], [total]]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["part", "path", "bytes", "docs", "ids"])
        trim()

    return run


def write(
    docs: DataFrame, folder: str, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", end: int = END
) -> DataFrame:
    """Encode whole texts, append ``end`` to each, and write files to the shared ``folder``.

    Documents are in ascending order of their ids over all files, those without an id first; rows
    that share an id are in the order of a hash of their texts. Returns the list of files ``part, path, bytes,
    docs, ids`` in that order. NULL texts are empty. No documents, no files.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    files = max(math.ceil(total / FILE_BYTES), 1)
    # Rows that share an id, or have none, may go to several files; the text's hash orders them.
    rows = rows.withColumn("hash", F.xxhash64("text"))
    sorted_ = rows.repartitionByRange(files, "id", "hash").sortWithinPartitions("id", "hash", "text").drop("hash")
    return store(sorted_.mapInArrow(_write(folder, tokenizer, end), FILES), "token-files")


def _read(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for part in parts:
        for file in part.itertuples(index=False):
            system, path = fs.FileSystem.from_uri(file.path)
            with system.open_input_file(path) as stream:
                rows = []
                for doc, start, ids in Reader(stream, file.bytes).documents():
                    data = ids.astype("<u4").tobytes()
                    rows.append((None if doc == NO_ID else doc, file.before + start, len(ids), zlib.crc32(data), data))
                    if len(rows) == 1000:
                        yield _frame(rows)
                        rows = []
                yield _frame(rows)


def _frame(rows: list[tuple]) -> pd.DataFrame:
    frame = pd.DataFrame(rows, columns=["doc_id", "start", "n_tokens", "ids_crc32", "ids"])
    return frame.astype({"doc_id": "Int64"})


def read(spark: SparkSession, files: DataFrame) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32, ids`` per document from the files in a list of them.

    ``start`` counts the ids of all documents before it in all files. The list, one row per file of
    some 32 MB of text, goes through the driver. ``ids`` are little-endian unsigned 32-bit numbers.
    """
    listed, before = [], 0
    for row in files.orderBy("part").collect():
        listed.append((row["path"], row["bytes"], before))
        before += row["ids"]
    frame = spark.createDataFrame(listed, "path string, bytes bigint, before bigint")
    frame = frame.repartition(max(len(listed), 1))
    return frame.mapInPandas(_read, "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint, ids binary")


def round_trip(docs: DataFrame, tokenizer: str, **options) -> DataFrame:
    """``docs`` written and read back, as by ``read``."""
    spark = docs.sparkSession
    return read(spark, write(docs, new_path(spark, "token-ids"), tokenizer, **options))
