"""Packing token sequences: bounded-space online best fit."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stakeline.llm.common import text_slices, trim
from stakeline.llm.tokens import Encoder, encoder

CAPACITY = 1024
OPEN = 8192
# Pieces that one stream of the packer sees, about.
STREAM = 16_384
END = 2

PIECES = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint, ids binary"


def best_fit(lengths: list[int], capacity: int, open_bins: int) -> tuple[list[int], list[int]]:
    """Bin and offset of each length, in the order given.

    At most ``open_bins`` bins take more; they are kept by free space, and a bitset says for which
    amounts of free space there is a bin. A piece goes to the bin that it leaves least room in. If
    none fits, a new bin opens; if there are too many then, the fullest closes first. Of bins with
    equal room the one filled last goes first.
    """
    bits, used, bins = 0, 0, 0
    room: list[list[int]] = [[] for _ in range(capacity + 1)]
    places, offsets = [], []
    for length in lengths:
        fits = bits >> length
        if fits:
            free = length + (fits & -fits).bit_length() - 1
            place = room[free].pop()
            if not room[free]:
                bits ^= 1 << free
        else:
            if used == open_bins:
                fullest = (bits & -bits).bit_length() - 1
                room[fullest].pop()
                if not room[fullest]:
                    bits ^= 1 << fullest
                used -= 1
            place, free = bins, capacity
            bins += 1
            used += 1
        places.append(place)
        offsets.append(capacity - free)
        free -= length
        if free:
            room[free].append(place)
            bits |= 1 << free
        else:
            used -= 1
    return places, offsets


def _cut_texts(part: pa.RecordBatch, encode: Encoder, capacity: int, end: bytes) -> pa.RecordBatch:
    names = ["doc_id", "piece", "start", "length", "ids_crc32", "ids"]
    types = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
    rows: list[tuple] = []
    ids = part.column("doc_id").to_pylist()
    for doc, found in zip(ids, encode.batches(part.column("text").to_pylist())):
        data, total = found.tobytes() + end, len(found) + 1
        start, stop = 0, total % capacity or capacity
        for piece in range(-(-total // capacity)):
            cut = data[4 * start : 4 * stop]
            rows.append((doc, piece, start, stop - start, zlib.crc32(cut), cut))
            start, stop = stop, stop + capacity
    return pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(zip(*rows), types)], names=names)


def _cut(path: str, capacity: int, end: int, remember: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, last = encoder(path, strip=False), end.to_bytes(4, "little")
        for part in (part for whole in batches for part in text_slices(whole, "text")):
            yield _cut_texts(part, encode, capacity, last)
            if not remember:
                trim()
        if not remember:
            del encode
            encoder.cache_clear()
        trim()

    return run


def pieces(
    docs: DataFrame,
    tokenizer: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    capacity: int = CAPACITY,
    end: int = END,
    remember: bool = True,
) -> DataFrame:
    """Each document's ids and the id ``end``, in pieces of at most ``capacity``.

    Only a longer document is cut; its first piece holds what the others, all full, leave over.
    ``ids`` are little-endian unsigned 32-bit numbers. Workers keep the tokenizer and the pieces
    it has seen for their next tasks; unless they ``remember``, each task begins anew, and a worker
    that waits holds neither.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(_cut(tokenizer, capacity, end, remember), PIECES)


def _pack(capacity: int, open_bins: int):
    def run(rows: pa.Table) -> pa.Table:
        encoder.cache_clear()  # all texts are encoded when the first stream is packed
        trim()
        stream = rows.column("_stream")[0].as_py()
        keys = [("length", "descending"), *((c, "ascending") for c in ("_order", "doc_id", "piece", "start"))]
        rows = rows.take(pc.sort_indices(rows, sort_keys=keys))
        places, offsets = best_fit(rows.column("length").to_pylist(), capacity, open_bins)
        rows = rows.drop_columns(["_stream", "_order"])
        rows = rows.append_column("sequence_id", pa.array(np.array(places, dtype=np.int64) + (stream << 32)))
        return rows.append_column("offset", pa.array(offsets, pa.int64()))

    return run


def pack(
    parts: DataFrame, capacity: int = CAPACITY, open_bins: int = OPEN, stream: int = STREAM, rows: int | None = None
) -> DataFrame:
    """The pieces with ``sequence_id`` and ``offset``: each sequence is filled without a gap from 0.

    Pieces, of which there are about ``rows``, are dealt by hash into streams of about ``stream``. In a stream the longest come first and
    hash and id decide ties, so a lost task packs the same way again. With fewer open bins than a
    stream needs the fullest close, which costs some room; the packer never holds more.
    """
    count = max(round((parts.count() if rows is None else rows) / stream), 1)
    order = F.xxhash64("doc_id", "piece", "start", "length", "ids_crc32")
    dealt = parts.withColumn("_order", order).withColumn("_stream", F.pmod(F.xxhash64("_order"), F.lit(count)))
    kinds = [*parts.dtypes, ("sequence_id", "bigint"), ("offset", "bigint")]
    return dealt.groupBy("_stream").applyInArrow(
        _pack(capacity, open_bins), ", ".join(f"{name} {kind}" for name, kind in kinds)
    )


def pack_documents(
    docs: DataFrame,
    tokenizer: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    capacity: int = CAPACITY,
    open_bins: int = OPEN,
    end: int = END,
    remember: bool = True,
) -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32, ids, sequence_id, offset`` per piece of a document.

    A NULL or empty text is the id ``end`` alone. Repeated rows and rows without an id are documents
    of their own. Other columns are ignored; no documents, no pieces. Ids go from the task that makes
    them to the stream that packs them; how many streams there are follows from the texts' sizes.
    ``remember`` is that of ``pieces``.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    # A token for four ASCII characters, and one for each byte more that others take.
    tokens = F.char_length(text) / 4 + F.octet_length(text) - F.char_length(text)
    size = docs.agg(F.count("*").alias("rows"), F.sum(tokens).alias("tokens")).first()
    about = size["rows"] + int((size["tokens"] or 0) / capacity)
    return pack(pieces(docs, tokenizer, id_col, text_col, capacity, end, remember), capacity, open_bins, rows=about)
