"""WARC archives: written with revisit records, read back by byte ranges."""

import base64
import hashlib
import uuid
import zlib
from datetime import datetime, timezone

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..staging import new_path, stage
from .common import shuffle_partitions

MAGIC = b"\x1f\x8b\x08"
READ_BYTES = 1 << 20
HEAD_BYTES = 1 << 16
# Unpacked bytes of a candidate that must show a WARC version line.
VERSION = b"WARC/1."
DATE = datetime(2000, 1, 1, tzinfo=timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ")
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def _urn(number) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_OID, f'page:{number}')}>"


def _record(page_id, url, payload: bytes, first) -> bytes:
    """One gzip member: a response, or a revisit of the page ``first`` without the payload."""
    digest = "sha1:" + base64.b32encode(hashlib.sha1(payload).digest()).decode()
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if first is not None else http + payload
    target = "".join(c for c in url or "" if c not in "\r\n") or "about:blank"
    head = [
        "WARC/1.1",
        f"WARC-Type: {'response' if first is None else 'revisit'}",
        f"WARC-Record-ID: {_urn(page_id)}",
        f"WARC-Target-URI: {target}",
        f"WARC-Date: {DATE}",
        "Content-Type: application/http; msgtype=response",
        f"WARC-Payload-Digest: {digest}",
        f"Content-Length: {len(block)}",
        f"Page-ID: {'' if page_id is None else page_id}",
    ]
    if first is not None:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {_urn(first)}", f"Refers-To-Page-ID: {first}"]
    pack = zlib.compressobj(6, zlib.DEFLATED, 31)
    return pack.compress("\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n") + pack.flush()


def _refers(pages: DataFrame, least_bytes: int) -> DataFrame:
    """Pages with ``first``: the smallest page_id of an equal payload, null for responses."""
    digest = F.when(F.length("payload") >= least_bytes, F.struct(F.sha1("payload"), F.length("payload")))
    keyed = pages.withColumn("_digest", digest)
    firsts = keyed.where("_digest is not null").groupBy("_digest").agg(
        F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n")
    )
    # Payloads that occur once need no partner.
    firsts = firsts.where("n > 1").drop("n")
    found = keyed.join(firsts, "_digest", "left").drop("_digest")
    return found.withColumn("first", F.when(~F.col("first").eqNullSafe(F.col("page_id")), F.col("first")))


def write(
    pages: DataFrame,
    folder: str,
    id_col: str = "page_id",
    url_col: str = "url",
    html_col: str = "html",
    least_bytes: int = 0,
) -> DataFrame:
    """One gzip member per row in ``folder``; returns the list of archives as ``(path, length, records)``.

    Of records with equal payloads (SHA-1 and length) of ``least_bytes`` or more, those with the smallest id are
    responses and the others revisit it; all smaller ones are responses. A null payload is empty; a row without id
    revisits a page that has one, or is a response. Rows that repeat the smallest id are all responses. Every
    attempt of a task writes a file of its own, and only the files named in the returned list count. An empty table
    writes nothing.
    """
    rows = pages.select(
        F.col(id_col).cast("long").alias("page_id"),
        F.col(url_col).cast("string").alias("url"),
        F.coalesce(F.col(html_col), F.lit("")).cast("binary").alias("payload"),
    )

    def run(batches):
        files, place = fs.FileSystem.from_uri(folder)
        files.create_dir(place, recursive=True)
        name, stream, length, records = f"pages-{uuid.uuid4().hex}.warc.gz", None, 0, 0
        for batch in batches:
            for page_id, url, payload, first in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                stream = stream or files.open_output_stream(f"{place}/{name}", compression=None)
                length += stream.write(member := _record(page_id, url, payload, first)) or len(member)
                records += 1
        if stream is not None:
            stream.close()
            yield pa.RecordBatch.from_pydict(
                {"path": [f"{folder}/{name}"], "length": [length], "records": [records]}
            )

    found = _refers(rows, least_bytes).select("page_id", "url", "payload", "first")
    return stage(found.mapInArrow(run, "path string, length long, records long"), "archives")


def archives(spark: SparkSession, path: str) -> DataFrame:
    """``(path, length)`` of the files under ``path``, without reading them."""
    return spark.read.format("binaryFile").load(path).select("path", "length")


class _Source:
    """A file read in blocks."""

    def __init__(self, path: str):
        files, place = fs.FileSystem.from_uri(path)
        self.file = files.open_input_file(place)
        self.size = self.file.size()

    def read(self, at: int, count: int) -> bytes:
        return self.file.read_at(max(0, min(count, self.size - at)), at) if at < self.size else b""


def _valid(source: _Source, at: int) -> bool:
    """Whether a gzip member that unpacks to a WARC header starts here."""
    try:
        return zlib.decompressobj(31).decompress(source.read(at, HEAD_BYTES), len(VERSION)) == VERSION
    except zlib.error:
        return False


def _member(source: _Source, at: int) -> tuple[bytes, int]:
    """The unpacked member that starts here, and where it ends."""
    unpack, parts = zlib.decompressobj(31), []
    while not unpack.eof:
        block = source.read(at, READ_BYTES)
        if not block:
            raise ValueError("an archive ends inside a record")
        parts.append(unpack.decompress(block))
        at += len(block) - len(unpack.unused_data)
    return b"".join(parts), at


def _first_member(source: _Source, start: int, end: int) -> int | None:
    """Where the first record starts in a byte range, by scanning for the magic and decoding candidates."""
    at = start
    while at < end:
        block = source.read(at, min(READ_BYTES, end - at) + len(MAGIC) - 1)
        found = block.find(MAGIC)
        while found >= 0:
            if at + found < end and _valid(source, at + found):
                return at + found
            found = block.find(MAGIC, found + 1)
        at += READ_BYTES
    return None


def _fields(block: bytes) -> dict[str, str]:
    lines = block.decode("utf-8", "replace").split("\r\n")
    return {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in lines[1:])}


def _parse(record: bytes) -> tuple:
    head, _, rest = record.partition(b"\r\n\r\n")
    fields = _fields(head)
    block = rest[: int(fields["content-length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    kind = fields["warc-type"]
    length = int(_fields(http).get("content-length", len(payload)))
    number = fields.get("page-id")
    refers = fields.get("refers-to-page-id")
    return (
        int(number) if number else None,
        fields.get("warc-target-uri"),
        kind,
        fields.get("warc-payload-digest", "").removeprefix("sha1:"),
        length,
        int(refers) if refers else None,
        payload if kind == "response" else None,
    )


RECORD = (
    "page_id long, url string, record_type string, payload_digest string, payload_bytes long, refers_to long, "
    "payload binary"
)
BATCH_BYTES = 4 << 20


def read(files: DataFrame, split_bytes: int = 16 << 20) -> DataFrame:
    """Records of the archives listed in ``files`` (``path``, ``length``).

    Each file is cut into ranges of ``split_bytes``. A task scans its range for the gzip magic, takes a candidate for a
    member if it unpacks to a WARC version line, and owns the records that start inside the range, reading
    the last one past its end. Responses carry their payload, revisits null. Records whose type is neither are left
    out. The folder must be one that the executors can open (local, HDFS or an object store). An archive cut off inside a
    record is an error.
    """
    count = F.greatest(F.ceil(F.col("length") / F.lit(split_bytes)), F.lit(1)).cast("long")
    starts = F.explode(F.transform(F.sequence(F.lit(0), count - 1), lambda k: k * split_bytes))
    ranges = files.select("path", starts.alias("start"))
    ranges = ranges.withColumn("end", F.col("start") + split_bytes).repartition(
        shuffle_partitions(files.sparkSession), "path", "start"
    )
    names = [x.split(" ")[0] for x in RECORD.split(", ")]

    def batch_of(rows):
        columns = list(zip(*rows, strict=True))
        types = [pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.binary()]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names)

    def run(batches):
        for batch in batches:
            for path, start, end in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                source = _Source(path)
                at, rows, held = _first_member(source, start, end), [], 0
                while at is not None and at < min(end, source.size):
                    record, at = _member(source, at)
                    row = _parse(record)
                    if row[2] in ("response", "revisit"):
                        rows.append(row)
                        held += len(record)
                    if held > BATCH_BYTES:
                        yield batch_of(rows)
                        rows, held = [], 0
                if rows:
                    yield batch_of(rows)

    return ranges.mapInArrow(run, RECORD)


def round_trip(pages: DataFrame, folder: str | None = None, least_bytes: int = 0) -> DataFrame:
    """``pages`` written to archives and read back, in a folder of the shared one by default."""
    place = folder or new_path(pages.sparkSession, "warc")
    return read(write(pages, place, least_bytes=least_bytes))
