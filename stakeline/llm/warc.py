"""Web archives (WARC 1.1) compressed record by record with a dictionary that each file carries."""

from __future__ import annotations

import hashlib
import re
import struct
from collections.abc import Iterator
from uuid import NAMESPACE_URL, uuid4, uuid5

import pandas as pd
import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stakeline.llm.common import new_path, store

# Payloads shorter than this are archived each time.
REVISIT_BYTES = 1000
# Records, uncompressed, per file; what a dictionary is built from; its size.
FILE_BYTES = 64 << 20
SAMPLE_BYTES = 4 << 20
DICTIONARY_BYTES = 64 << 10
LEVEL = 3
DATE = "2024-01-01T00:00:00Z"
# Number of the skippable frame that holds a dictionary in a .warc.zst file.
DICTIONARY_FRAME = 0x184D2A5D
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DICTIONARY_MAGIC = bytes.fromhex("37a430ec")
CHUNK = 1 << 20

INDEX = "path string, page_id bigint, offset bigint, length bigint"
RECORDS = (
    "page_id bigint, url string, payload_bytes bigint, payload_digest string, "
    "record_type string, refers_to bigint, payload binary"
)


def record(
    page: int | None, url: str | None, payload: bytes | None, size: int, digest: str, refers_to: int | None, date: str
) -> bytes:
    """One WARC record: a response with its payload, or a revisit with the HTTP header alone."""
    name = f"urn:page:{page}" if page is not None else f"urn:uuid:{uuid5(NAMESPACE_URL, f'{url} {digest}')}"
    target = re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url or "") or name
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    block = http + payload if refers_to is None else http
    lines = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: <{name}>",
        f"WARC-Date: {date}",
        f"WARC-Target-URI: {target}",
        f"WARC-Payload-Digest: sha1:{digest}",
        *([f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <urn:page:{refers_to}>"] if refers_to is not None else []),
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    return "\r\n".join(lines).encode("utf-8", "surrogatepass") + b"\r\n\r\n" + block + b"\r\n\r\n"


def build_dictionary(samples: list[bytes], size: int = DICTIONARY_BYTES) -> zstandard.ZstdCompressionDict:
    """A dictionary trained on records; their plain bytes where there are too few to train on."""
    if len(samples) >= 16:
        try:
            return zstandard.train_dictionary(size, samples, k=256, d=8)
        except zstandard.ZstdError:
            pass
    plain = b"".join(samples)[-size:]
    return zstandard.ZstdCompressionDict(plain, dict_type=zstandard.DICT_TYPE_RAWCONTENT)


class Writer:
    """A .warc.zst file: a skippable frame with the dictionary, then one frame per record.

    Holds back the first ``SAMPLE_BYTES`` of records, from which it builds the dictionary.
    """

    def __init__(self, stream):
        self.stream, self.place, self.size = stream, 0, 0
        self.held: list[tuple[int | None, bytes]] = []
        self.packer: zstandard.ZstdCompressor | None = None
        self.index: list[tuple[int | None, int, int]] = []

    def add(self, page: int | None, data: bytes) -> None:
        self.size += len(data)
        if self.packer is not None:
            self._write(page, data)
            return
        self.held.append((page, data))
        if self.size >= SAMPLE_BYTES:
            self._start()

    def _start(self) -> None:
        dictionary = build_dictionary([data for _, data in self.held])
        plain = dictionary.as_bytes()
        frame = struct.pack("<II", DICTIONARY_FRAME, len(plain)) + plain
        self.stream.write(frame)
        self.place = len(frame)
        self.packer = zstandard.ZstdCompressor(level=LEVEL, dict_data=dictionary)
        for page, data in self.held:
            self._write(page, data)
        self.held = []

    def _write(self, page: int | None, data: bytes) -> None:
        frame = self.packer.compress(data)
        self.stream.write(frame)
        self.index.append((page, self.place, len(frame)))
        self.place += len(frame)

    def close(self) -> None:
        if self.packer is None:
            self._start()
        self.stream.close()


def read_dictionary(stream) -> zstandard.ZstdCompressionDict | None:
    """The dictionary at the head of a file, with the stream left at the first record; None if it has none."""
    head = stream.read(8)
    if len(head) < 8:
        return None
    magic, size = struct.unpack("<II", head)
    if magic != DICTIONARY_FRAME:
        stream.seek(0)
        return None
    plain = stream.read(size)
    trained = plain[:4] == DICTIONARY_MAGIC
    kind = zstandard.DICT_TYPE_FULLDICT if trained else zstandard.DICT_TYPE_RAWCONTENT
    return zstandard.ZstdCompressionDict(plain, dict_type=kind)




def read_records(stream) -> Iterator[tuple[dict[str, str], bytes]]:
    """Header and block of each record of a file, in order; holds one record."""
    dictionary = read_dictionary(stream)
    unpacker = zstandard.ZstdDecompressor(**({"dict_data": dictionary} if dictionary else {}))
    held = bytearray()
    with unpacker.stream_reader(stream, read_size=CHUNK, read_across_frames=True) as plain:

        def more() -> bool:
            part = plain.read(CHUNK)
            held.extend(part)
            return bool(part)

        while held or more():
            at = 0
            while (end := held.find(b"\r\n\r\n", max(at - 3, 0))) < 0:
                at = len(held)
                if not more():
                    raise ValueError("a record is cut short")
            first, *lines = held[:end].decode("utf-8", "surrogatepass").split("\r\n")
            if not first.startswith("WARC/1."):
                raise ValueError("not a WARC record")
            header = {k.lower(): v.strip() for k, v in (line.split(":", 1) for line in lines)}
            stop = end + 4 + int(header["content-length"])
            while len(held) < stop + 4:
                if not more():
                    raise ValueError("a record is cut short")
            yield header, bytes(held[end + 4 : stop])
            del held[: stop + 4]


def parse(header: dict[str, str], block: bytes) -> tuple:
    """``page_id, url, payload_bytes, payload_digest, record_type, refers_to, payload`` of a record.

    The digest of a response is taken from its payload and has to agree with the header.
    """

    def page(key: str) -> int | None:
        found = re.fullmatch(r"<urn:page:(-?\d+)>", header.get(key, ""))
        return int(found[1]) if found else None

    http, _, payload = block.partition(b"\r\n\r\n")
    size = int(re.search(rb"(?i)\r\ncontent-length: *(\d+)", http)[1])
    digest, kind = header["warc-payload-digest"].removeprefix("sha1:"), header["warc-type"]
    if kind == "response" and (len(payload) != size or hashlib.sha1(payload).hexdigest() != digest):
        raise ValueError(f"record {header['warc-record-id']} doesn't hold what its header says")
    refers_to = page("warc-refers-to") if kind == "revisit" else None
    return page("warc-record-id"), header["warc-target-uri"], size, digest, kind, refers_to, payload


def _write(folder: str, date: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, base = fs.FileSystem.from_uri(folder)
        writer, name, made = None, "", False

        def closed() -> pa.RecordBatch:
            writer.close()
            pages, offsets, lengths = zip(*writer.index)
            columns = [
                pa.array([f"{folder}/{name}"] * len(pages)),
                *(pa.array(x, type=pa.int64()) for x in (pages, offsets, lengths)),
            ]
            return pa.RecordBatch.from_arrays(columns, names=["path", "page_id", "offset", "length"])

        for batch in batches:
            for row in batch.to_pylist():
                if writer is None:
                    if not made:
                        system.create_dir(base, recursive=True)
                        made = True
                    # Another attempt of this task writes other files; the index names those that count.
                    name = f"{uuid4().hex}.warc.zst"
                    writer = Writer(system.open_output_stream(f"{base}/{name}", compression=None))
                writer.add(
                    row["page_id"],
                    record(row["page_id"], row["url"], row["payload"], row["size"], row["digest"], row["refers_to"], date),
                )
                if writer.size >= FILE_BYTES:
                    yield closed()
                    writer = None
        if writer is not None:
            yield closed()

    return run


def write(
    pages: DataFrame,
    folder: str,
    id_col: str = "page_id",
    url_col: str = "url",
    html_col: str = "html",
    revisit_bytes: int = REVISIT_BYTES,
    date: str = DATE,
) -> DataFrame:
    """Archive each row of ``pages`` in files of the shared ``folder``; returns the index of records.

    The index has ``path, page_id, offset, length`` (of the record's frame) per record and is stored.
    Of rows with equal payloads of at least ``revisit_bytes`` the one with the largest id is a
    response and the others revisit it; rows that share that id are all responses. A row without an
    id revisits a response, and is one where no equal row has an id. A NULL payload is empty; a NULL
    url gives way to the record's name, and blanks and the like in a url are percent-encoded, as
    the header needs. Equal payloads meet as digests, counted before the shuffle. A very long payload
    is one record. No rows, no records; other columns are not read, so their names don't matter.
    """
    html = F.coalesce(F.col(html_col), F.lit("")).cast("binary")
    rows = pages.select(
        F.col(id_col).cast("long").alias("page_id"),
        F.col(url_col).cast("string").alias("url"),
        html.alias("payload"),
        F.octet_length(html).cast("long").alias("size"),
        F.sha1(html).alias("digest"),
        F.xxhash64(html).alias("hash"),
    )
    same = ["size", "digest", "hash"]
    latest = (
        rows.where(F.col("size") >= revisit_bytes)
        .groupBy(*same)
        .agg(F.max("page_id").alias("latest"), F.count("*").alias("n"))
        .where("n > 1 and latest is not null")
        .drop("n")
    )
    rows = rows.join(store(latest, "repeated-payloads"), same, "left")
    revisits = F.col("latest").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("latest"))
    rows = rows.select(
        "page_id",
        "url",
        "size",
        "digest",
        F.when(revisits, F.col("latest")).alias("refers_to"),
        F.when(~revisits, F.col("payload")).alias("payload"),
    )
    return store(rows.mapInArrow(_write(folder, date), INDEX), "warc-index")


def _read(with_payload: bool):
    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [c.split()[0] for c in RECORDS.split(", ")]

        def frame(rows: list[tuple]) -> pd.DataFrame:
            return pd.DataFrame(rows, columns=names).astype({"page_id": "Int64", "refers_to": "Int64"})

        for part in parts:
            for path in part["path"]:
                system, place = fs.FileSystem.from_uri(path)
                with system.open_input_file(place) as stream:
                    rows, size = [], 0
                    for header, block in read_records(stream):
                        rows.append(parse(header, block))
                        size += len(block)
                        if not with_payload:
                            rows[-1] = (*rows[-1][:-1], None)
                        if size > 16 * CHUNK:
                            yield frame(rows)
                            rows, size = [], 0
                    yield frame(rows)

    return run


def read(spark: SparkSession, index: DataFrame, with_payload: bool = True) -> DataFrame:
    """The records of all files that ``index`` names, a file to a task.

    ``page_id, url, payload_bytes, payload_digest, record_type, refers_to, payload``; a revisit has
    an empty payload, and its size is that of the HTTP header it repeats.
    """
    paths = index.select("path").distinct()
    files = max(paths.count(), 1)
    return paths.repartition(files, "path").mapInPandas(_read(with_payload), RECORDS)


def round_trip(pages: DataFrame, with_payload: bool = True, **options) -> DataFrame:
    """``pages`` archived and read back, as by ``read``."""
    spark = pages.sparkSession
    return read(spark, write(pages, new_path(spark, "warc"), **options), with_payload)
