"""WARC archives with one Zstandard frame per record and a shared dictionary.

Each archive file starts with a skippable frame that holds a dictionary built from records of that
file; every record is a frame of its own compressed with it, so a reader can start at any record.
Records with equal payloads are written once: the one with the smallest page id is a ``response``,
the others are ``revisit`` records that refer to it. Which record is which is settled by an
aggregation before anything is written; writing and reading run in parallel over files.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quitanda.llm.common import filesystem, spread
from quitanda.session import materialize

# Fixed values of the formats: magic numbers of a skippable frame with a dictionary and of a dictionary.
SKIPPABLE = 0x184D2A5D
DICTIONARY = b"\x37\xa4\x30\xec"

DICT_BYTES = 32 << 10
SAMPLE_BYTES = 2 << 20
FILE_BYTES = 24 << 20  # of record bytes before compression
LEVEL = 6


# --- one record -----------------------------------------------------------------------------------

def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def build_record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, when: str) -> bytes:
    """A response with its payload, or a revisit with the HTTP header only."""
    http = ("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
            f"Content-Length: {len(payload)}\r\n\r\n").encode()
    block = http if refers_to is not None else http + payload
    uri = (url or "").replace("\r", "%0D").replace("\n", "%0A")
    lines = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
             f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>", f"WARC-Date: {when}",
             f"WARC-Target-URI: {uri}", f"WARC-Payload-Digest: sha1:{digest(payload)}"]
    if refers_to is not None:
        lines += [f"WARC-Refers-To: <urn:page:{refers_to}>",
                  "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def _headers(text: bytes) -> dict[str, str]:
    return {k.lower(): v for k, _, v in (x.partition(": ") for x in text.decode().split("\r\n")[1:])}


def _number(urn: str) -> int | None:
    value = urn.removeprefix("<urn:page:").removesuffix(">")
    return int(value) if value else None


def parse_record(record: bytes) -> dict:
    head, _, rest = record.partition(b"\r\n\r\n")
    fields = _headers(head)
    block = rest[:int(fields["content-length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    return {"page_id": _number(fields["warc-record-id"]), "url": fields["warc-target-uri"],
            "payload": payload if fields["warc-type"] == "response" else None,
            "payload_bytes": int(_headers(http)["content-length"]),
            "payload_digest": fields["warc-payload-digest"].removeprefix("sha1:"),
            "record_type": fields["warc-type"],
            "refers_to": _number(fields["warc-refers-to"]) if "warc-refers-to" in fields else None}


# --- one file -------------------------------------------------------------------------------------

def make_dictionary(records: list[bytes]) -> bytes:
    """A dictionary trained on records spread evenly over the file, at most SAMPLE_BYTES of them.

    Too few or too small records cannot be trained on; their start then serves as plain content.
    """
    total = sum(map(len, records))
    step = max(1, -(-total // SAMPLE_BYTES))
    sample = [r[:SAMPLE_BYTES // 8] for r in records[::step]]
    try:
        return zstandard.train_dictionary(min(DICT_BYTES, max(256, total // 8)), sample, k=200, d=8).as_bytes()
    except zstandard.ZstdError:
        return b"".join(sample[:8])[:DICT_BYTES]


def _dictionary(content: bytes) -> zstandard.ZstdCompressionDict:
    kind = zstandard.DICT_TYPE_FULLDICT if content.startswith(DICTIONARY) else zstandard.DICT_TYPE_RAWCONTENT
    return zstandard.ZstdCompressionDict(content, dict_type=kind)


def encode_file(records: list[bytes]) -> bytes:
    content = make_dictionary(records)
    packer = zstandard.ZstdCompressor(level=LEVEL, dict_data=_dictionary(content), write_checksum=True)
    return b"".join([struct.pack("<II", SKIPPABLE, len(content)), content, *map(packer.compress, records)])


def decode_file(data: bytes) -> Iterator[bytes]:
    magic, size = struct.unpack_from("<II", data)
    if magic != SKIPPABLE:
        raise ValueError("no dictionary frame at the start of the archive")
    reader = zstandard.ZstdDecompressor(dict_data=_dictionary(data[8:8 + size]))
    at, view = 8 + size, memoryview(data)
    while at < len(data):
        one = reader.decompressobj()
        out = one.decompress(view[at:])
        yield out
        at = len(data) - len(one.unused_data)


# --- Spark ----------------------------------------------------------------------------------------

def plan_records(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html",
                 min_bytes: int = 0) -> DataFrame:
    """(page_id, url, payload, refers_to): which record refers to which.

    Payloads are compared by their SHA-1; the smallest id among equal payloads of ``min_bytes`` or
    more has no ``refers_to``.
    """
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"),
                        F.encode(F.coalesce(F.col(html_col).cast("string"), F.lit("")), "UTF-8").alias("payload"))
    rows = rows.withColumn("sum", F.unhex(F.sha1("payload")))
    first = (rows.filter(F.length("payload") >= min_bytes).groupBy("sum")
             .agg(F.min("page_id").alias("first"), F.count("*").alias("n")).filter("n > 1").select("sum", "first"))
    return rows.join(first, "sum", "left").select(
        "page_id", "url", "payload", F.when(~F.col("first").eqNullSafe(F.col("page_id")), F.col("first")).alias("refers_to"))


def write_archives(records: DataFrame, folder: str, when: str = "2024-01-01T00:00:00Z", prefix: str = "pages") -> DataFrame:
    """Write the planned records into ``folder`` and return (file, records, bytes).

    A file is written under a hidden name and then renamed. Its name depends on the partition only and
    the records of a partition are in a fixed order, so a task that runs again cuts the same files and
    replaces what its lost attempt left.
    """
    def run(batches):
        fs, root = filesystem(folder)
        part, seq, held, size, out = TaskContext.get().partitionId(), 0, [], 0, []

        def flush():
            nonlocal seq, held, size
            name = f"{prefix}-{part:06d}-{seq:05d}.warc.zst"
            hidden = f"{root}/_{name}.{uuid.uuid4().hex}"
            data = encode_file(held)
            with fs.open_output_stream(hidden) as sink:
                sink.write(data)
            fs.move(hidden, f"{root}/{name}")
            out.append((name, len(held), len(data)))
            seq, held, size = seq + 1, [], 0

        fs.create_dir(root, recursive=True)
        for batch in batches:
            for page_id, url, payload, refers_to in zip(*(batch.column(i).to_pylist() for i in range(4))):
                held.append(build_record(page_id, url, payload, refers_to, when))
                size += len(held[-1])
                if size >= FILE_BYTES:
                    flush()
        if held:
            flush()
        cols = list(zip(*out)) or [(), (), ()]
        yield pa.RecordBatch.from_arrays(
            [pa.array(cols[0], pa.string()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.int64())],
            ["file", "records", "bytes"])

    return records.select("page_id", "url", "payload", "refers_to").sortWithinPartitions("page_id", "url", "payload").mapInArrow(run, "file string, records long, bytes long")


def read_archives(files: DataFrame, folder: str) -> DataFrame:
    """One row per record of ``files(file)`` in ``folder``: page_id, url, payload (null for revisits),
    payload_bytes, payload_digest, record_type, refers_to. Every file is opened and decoded by one task,
    record by record; other files in the folder are not looked at."""
    kind = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("payload", pa.binary()),
                      ("payload_bytes", pa.int64()), ("payload_digest", pa.string()),
                      ("record_type", pa.string()), ("refers_to", pa.int64())])

    def run(batches):
        fs, root = filesystem(folder)
        for batch in batches:
            for name in batch.column(0).to_pylist():
                with fs.open_input_stream(f"{root}/{name}", compression=None) as source:
                    data = source.read()
                rows, size = [], 0
                for record in decode_file(data):
                    rows.append(parse_record(record))
                    size += len(record)
                    if size > 4 << 20:
                        yield pa.RecordBatch.from_pylist(rows, kind)
                        rows, size = [], 0
                yield pa.RecordBatch.from_pylist(rows, kind)

    return spread(files.select("file")).mapInArrow(
        run, "page_id long, url string, payload binary, payload_bytes long, payload_digest string, record_type string, "
             "refers_to long")


def archive(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html",
            min_bytes: int = 0) -> DataFrame:
    """Write ``pages`` to ``folder`` and give back what the archives hold, one row per page.

    Null html is an empty payload, equal to other empty ones; null urls are written empty and read
    back so; a null id cannot be referred to: rows with null ids refer to the smallest id of equal
    payloads, and where all ids are null each is a response. Repeated ids with equal payloads are
    all responses, for a record cannot refer to itself. Very long payloads are one record. Other
    columns are ignored. An empty table writes no file and gives no rows.
    """
    written = materialize(write_archives(plan_records(pages, id_col, url_col, html_col, min_bytes), folder), "warc-files")
    return read_archives(written, folder)
