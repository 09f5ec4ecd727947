"""Dictionary-compressed WARC writer and reader (operator 9).

A Zstandard dictionary is built from a bounded sample of the records. Each archive
begins with it in a skippable frame; every record is a frame of its own, so a
reader can begin at any record. Payloads that another page has already are written
as revisit records. Archives go to the shared folder, one or more a task, under a
name that a repeated task writes again with the same bytes.
"""

from __future__ import annotations

import hashlib
import io
import struct
import uuid
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
import pyarrow.fs as pafs
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import keep, shared_folder, small_batches

SKIPPABLE = 0x184D2A5D
#: The dictionary is built from about so many records, of so many bytes each; its own size.
SAMPLE, SAMPLE_BYTES, DICTIONARY = 2000, 8192, 65_536
#: Bytes of payloads after which a task begins another archive.
ARCHIVE = 256 << 20
#: Groups of equal payloads (a digest and an id, about 100 bytes each) that are sent to every task.
SENT = 200_000
#: Equal payloads from this size are written once.
LEAST = 100
_NAMESPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")  # the registered namespace of URLs
_FIELDS = ["page_id", "url", "payload", "digest", "record_type", "refers_to"]
#: The date in every record, unless another is given.
DATE = "2024-01-01T00:00:00Z"
_RESULT = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"


def page_records(pages: DataFrame) -> DataFrame:
    """pages with payload (binary), digest, size, record_type and refers_to.

    The response of a group of equal payloads of at least LEAST bytes is the row with
    the smallest page_id (rows that repeat that id are responses too); a group of
    rows whose ids are all null is all response. Groups are found on digests and ids;
    up to SENT of them are sent to every task, so that payloads stay where they are,
    and beyond they are joined by a sort-merge join, which AQE splits where one
    payload is very common.
    """
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html"), F.lit("")).cast("binary").alias("payload"))
    rows = rows.withColumn("size", F.octet_length("payload").cast("long")).withColumn("digest", F.sha2("payload", 256))
    low = rows.where(F.col("size") >= LEAST).groupBy("digest").agg(F.min("page_id").alias("low"), F.count("*").alias("n")).where("n > 1").select("digest", "low")
    low = keep(low, "groups")
    rows = rows.join(F.broadcast(low) if low.limit(SENT + 1).count() <= SENT else low, "digest", "left")
    again = F.col("low").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("low"))
    return rows.select("page_id", "url", "payload", "size", "digest", F.when(again, "revisit").otherwise("response").alias("record_type"), F.when(again, F.col("low")).alias("refers_to"))


def _header(fields: list[tuple[str, str]]) -> bytes:
    return ("WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields) + "\r\n").encode()


def record_id(page_id: int | None) -> str:
    return f"<urn:uuid:{uuid.uuid5(_NAMESPACE, f'page:{page_id}')}>"


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, kind: str, refers_to: int | None, date: str) -> bytes:
    """One WARC record. A revisit has no block; its payload's length and digest are in its header."""
    block = payload if kind == "response" else b""
    target = (url or "about:blank").replace("\r", "%0D").replace("\n", "%0A")
    fields = [("WARC-Type", kind), ("WARC-Record-ID", record_id(page_id)), ("WARC-Date", date), ("WARC-Target-URI", target), ("WARC-Payload-Digest", f"sha256:{digest}")]
    if kind == "revisit":
        fields += [("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("WARC-Refers-To", record_id(refers_to)), ("X-Refers-To-Page", str(refers_to))]
    fields += [("X-Payload-Length", str(len(payload))), ("Content-Type", "text/html; charset=utf-8"), ("Content-Length", str(len(block)))]
    if page_id is not None:
        fields.insert(2, ("X-Page", str(page_id)))
    return _header(fields) + block + b"\r\n\r\n"


def build_dictionary(records: DataFrame, rows: int, date: str = DATE) -> bytes:
    """A dictionary from a bounded sample of the archived records of page_records(), headers included (about SAMPLE, at most twice as many, by a hash of id and url); empty where there are too few to build one.

    Tasks make the records; the first SAMPLE_BYTES of each come to the driver. rows: how
    many records there are, as counting them here would hash every payload once more.
    """
    share = min(1 << 20, SAMPLE * (1 << 20) // max(1, rows) + 1)
    some = records.where(F.pmod(F.xxhash64("page_id", "url"), F.lit(1 << 20)) < share).select(*_FIELDS).limit(2 * SAMPLE)

    def begin(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = zip(*(batch.column(c).to_pylist() for c in _FIELDS))
            yield pa.RecordBatch.from_arrays([pa.array([record(*r, date)[:SAMPLE_BYTES] for r in rows], pa.binary())], ["part"])

    samples = sorted(bytes(r["part"]) for r in some.mapInArrow(begin, "part binary").collect())
    try:
        return zstandard.train_dictionary(DICTIONARY, samples).as_bytes() if len(samples) >= 16 else b""
    except zstandard.ZstdError:
        return b""


def parse(data: bytes) -> tuple[dict[str, str], bytes]:
    head, _, rest = data.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    block = rest[: int(fields["Content-Length"])]
    if rest[len(block) :] != b"\r\n\r\n":
        raise ValueError("a record's length is wrong")
    return fields, block


def _filesystem(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path) if "://" in path else (pafs.LocalFileSystem(), path.removeprefix("file:"))


def write_archives(records: DataFrame, folder: str, dictionary: bytes, date: str = DATE, archive_bytes: int = ARCHIVE) -> DataFrame:
    """Writes the records of page_records() as *.warc.zst files and returns (path, records, bytes) of each file."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filesystem, root = _filesystem(folder)
        filesystem.create_dir(root, recursive=True)
        trained = zstandard.ZstdCompressionDict(dictionary) if dictionary else None
        compressor = zstandard.ZstdCompressor(level=6, dict_data=trained, write_content_size=True)
        task = TaskContext.get()
        out, number, payloads, count, packed, sink = [], 0, 0, 0, 0, None

        def close() -> None:
            nonlocal sink, count, packed, payloads, number
            sink.close()
            filesystem.move(temporary, final)
            out.append((final, count, packed))
            sink, count, packed, payloads, number = None, 0, 0, 0, number + 1

        for batch in batches:
            columns = [batch.column(c) for c in _FIELDS]
            for k in range(batch.num_rows):
                if sink is None:
                    final = f"{root}/part-{task.partitionId():06d}-{number:04d}.warc.zst"
                    temporary = f"{final}.{task.taskAttemptId()}.tmp"
                    sink = filesystem.open_output_stream(temporary, compression=None)
                    if dictionary:
                        packed += sink.write(struct.pack("<II", SKIPPABLE, len(dictionary)) + dictionary) or 0
                values = [c[k].as_py() for c in columns]
                frame = compressor.compress(record(*values, date))
                sink.write(frame)
                payloads, count, packed = payloads + len(values[2]), count + 1, packed + len(frame)
                if payloads >= archive_bytes:
                    close()
        if sink is not None:
            close()
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(list(zip(*out)) or [()] * 3, (pa.string(), pa.int64(), pa.int64()))], ["path", "records", "bytes"])

    return records.select(*_FIELDS).mapInArrow(write, "path string, records long, bytes long")


def read_archive(stream: io.BufferedIOBase) -> Iterator[tuple[dict[str, str], bytes]]:
    """(header, block) of each record of an open archive, one frame at a time."""
    head = stream.read(8)
    trained = None
    pending = head
    if len(head) == 8 and struct.unpack("<II", head)[0] == SKIPPABLE:
        trained = zstandard.ZstdCompressionDict(stream.read(struct.unpack("<II", head)[1]))
        pending = b""
    decompressor = zstandard.ZstdDecompressor(dict_data=trained)
    while pending or (pending := stream.read(1 << 20)):
        frame, parts = decompressor.decompressobj(), []
        while not frame.eof:
            parts.append(frame.decompress(pending))
            pending = frame.unused_data if frame.eof else stream.read(1 << 20)
            if not frame.eof and not pending:
                raise EOFError("an archive ends inside a record")
        yield parse(b"".join(parts))


def read_archives(files: DataFrame, root: str) -> DataFrame:
    """A row for each record of the files: page_id, payload_bytes, payload_digest, record_type, refers_to. Blocks are checked against their digests."""

    def read(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        filesystem, _ = _filesystem(root)
        for part in parts:
            for path in part["path"]:
                rows = []
                with filesystem.open_input_stream(path, compression=None) as stream:
                    for fields, block in read_archive(stream):
                        digest = fields["WARC-Payload-Digest"].removeprefix("sha256:")
                        if fields["WARC-Type"] == "response" and hashlib.sha256(block).hexdigest() != digest:
                            raise ValueError(f"{path}: a payload differs from its digest")
                        size = len(block) if fields["WARC-Type"] == "response" else int(fields["X-Payload-Length"])
                        rows.append((int(fields["X-Page"]) if "X-Page" in fields else None, size, digest, fields["WARC-Type"], int(fields["X-Refers-To-Page"]) if "X-Refers-To-Page" in fields else None))
                yield pd.DataFrame(rows, columns=["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]).astype({"page_id": "Int64", "refers_to": "Int64"})

    return files.select("path").mapInPandas(read, _RESULT)


def archive_round_trip(pages: DataFrame, folder: str | None = None) -> DataFrame:
    """Writes every row of pages (page_id, url, html; further columns are ignored) to archives and reads them back.

    Null html counts as empty; a null url as about:blank; a null page_id stays null.
    An empty table gives an empty result. Repeated rows are written as often as they came.
    """
    spark = pages.sparkSession
    small_batches(spark)
    folder = folder or f"{shared_folder(spark)}/warc-{uuid.uuid4().hex}"
    records = page_records(pages)
    files = keep(write_archives(records, folder, build_dictionary(records, pages.count())), "archives")
    return read_archives(files.repartition(max(1, min(1024, files.count())), F.xxhash64("path")), folder)
