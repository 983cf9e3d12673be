"""WARC archives: a writer, and a sequential reader in bounded memory.

Each record is a gzip member of its own. The reader takes a file in small
pieces, decompresses member after member, frames the block by its content
length, hashes block and payload as they pass, and holds them against the
digests of the record.
"""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from urllib.parse import quote
from uuid import NAMESPACE_URL, uuid5

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldsift.llm.shared import col, files, new_file, shared_path, store

# Equal payloads of at least this many bytes are stored once.
REVISIT_BYTES = 1000
# A file is closed when it holds this many bytes.
FILE_BYTES = 64 << 20
PIECE = 64 << 10
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
END = b"\r\n\r\n"


def record_id(page_id: int | None) -> str:
    return f"<{uuid5(NAMESPACE_URL, f'page:{page_id}').urn}>"


def _base32(digest: bytes) -> str:
    return "sha1:" + base64.b32encode(digest).decode()


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None) -> bytes:
    """One gzip member: a response, or a revisit of ``refers_to`` without payload."""
    http = (
        "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
        f"Content-Length: {len(payload)}\r\n\r\n"
    ).encode()
    block = http if refers_to is not None else http + payload
    fields = {
        "WARC-Type": "response" if refers_to is None else "revisit",
        "WARC-Record-ID": record_id(page_id),
        "WARC-Date": DATE,
        "WARC-Target-URI": quote(url, safe="%/:=&?~#+!$,;'@()*[]") if url else None,
        "WARC-Payload-Digest": _base32(hashlib.sha1(payload).digest()),
        "WARC-Block-Digest": _base32(hashlib.sha1(block).digest()),
        "WARC-Profile": PROFILE if refers_to is not None else None,
        "WARC-Refers-To": record_id(refers_to) if refers_to is not None else None,
        "X-Page-Id": page_id,
        "X-Refers-To-Page-Id": refers_to,
        "Content-Type": "application/http; msgtype=response",
        "Content-Length": len(block),
    }
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields.items() if v is not None) + "\r\n"
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress(head.encode() + block + END) + packer.flush()


@dataclass
class Record:
    """Fields of a record and what was found in its block."""

    fields: dict[str, str]
    payload_bytes: int
    payload_digest: str


class _Members:
    """Bytes of one gzip member after the other."""

    def __init__(self, read: Callable[[int], bytes]):
        self.read, self.rest = read, b""

    def next(self) -> Iterator[bytes] | None:
        """Pieces of the next member, or None at the end of the file."""
        self.rest = self.rest or self.read(PIECE)
        return self._pieces() if self.rest else None

    def _pieces(self) -> Iterator[bytes]:
        unpacker = zlib.decompressobj(31)
        data = self.rest
        while True:
            piece = unpacker.decompress(data, PIECE)
            if piece:
                yield piece
            if unpacker.eof:
                self.rest = unpacker.unused_data
                return
            data = unpacker.unconsumed_tail or self.read(PIECE)
            if not data and not piece:
                raise ValueError("a record is cut off")


class _Block:
    """Exact numbers of bytes from pieces."""

    def __init__(self, pieces: Iterator[bytes]):
        self.pieces, self.held = pieces, b""

    def until(self, end: bytes) -> bytes:
        while (at := self.held.find(end)) < 0:
            piece = next(self.pieces, None)
            if piece is None:
                raise ValueError("a record has no end of its fields")
            self.held += piece
        found, self.held = self.held[: at + len(end)], self.held[at + len(end) :]
        return found

    def take(self, n: int) -> Iterator[bytes]:
        while n:
            piece = self.held or next(self.pieces, None)
            if piece is None:
                raise ValueError("a record is shorter than its content length")
            self.held = piece[n:]
            piece = piece[:n]
            n -= len(piece)
            yield piece


def _fields(head: bytes) -> dict[str, str]:
    lines = head.decode("utf-8").split("\r\n")[1:]
    return {k.lower(): v.strip() for k, _, v in (line.partition(":") for line in lines) if k}


def read_records(read: Callable[[int], bytes]) -> Iterator[Record]:
    """Records of a file, one at a time; ``read(n)`` gives up to n bytes.

    Raises ValueError for a broken frame or a digest that does not hold.
    """
    members = _Members(read)
    while (pieces := members.next()) is not None:
        block = _Block(pieces)
        head = block.until(END)
        if not head.startswith(b"WARC/1."):
            raise ValueError("a member does not begin with a record")
        fields = _fields(head)
        length = int(fields["content-length"])
        of_block, of_payload, seen, http = hashlib.sha1(), hashlib.sha1(), 0, b""
        inside = False
        for piece in block.take(length):
            of_block.update(piece)
            if not inside:
                http += piece
                at = http.find(END)
                if at < 0:
                    continue
                inside, piece, http = True, http[at + len(END) :], http[: at + len(END)]
            of_payload.update(piece)
            seen += len(piece)
        if b"".join(block.take(len(END))) != END or block.held or any(block.pieces):
            raise ValueError("a record does not end where its content length says")
        if fields["warc-block-digest"] != _base32(of_block.digest()):
            raise ValueError(f"block digest of {fields['warc-record-id']} does not hold")
        digest = fields["warc-payload-digest"]
        if fields["warc-type"] == "response":
            if digest != _base32(of_payload.digest()):
                raise ValueError(f"payload digest of {fields['warc-record-id']} does not hold")
        else:
            seen = int(_fields(http)["content-length"])
        yield Record(fields, seen, base64.b32decode(digest.partition(":")[2]).hex())


def referred(pages: DataFrame, least: int = REVISIT_BYTES) -> DataFrame:
    """(page_id, url, html as bytes, refers_to): equal payloads refer to the largest id.

    Equal means the same SHA-1, length and 64-bit hash. Rows with the largest id
    itself, rows without an id and payloads below ``least`` bytes refer to none.
    """
    keys = ["digest", "size", "hash"]
    keyed = (
        pages.withColumn("digest", F.sha1("html"))
        .withColumn("size", F.octet_length("html"))
        .withColumn("hash", F.xxhash64("html"))
    )
    last = (
        keyed.filter(F.col("size") >= least)
        .groupBy(*keys)
        .agg(F.max("page_id").alias("last"), F.count(F.lit(1)).alias("n"))
        .filter("n > 1")
        .drop("n")
    )
    own = F.col("last").isNotNull() & (F.col("page_id") != F.col("last"))
    return keyed.join(last, keys, "left").select("page_id", "url", "html", F.when(own, F.col("last")).alias("refers_to"))


def write_warc(
    pages: DataFrame, row_id: str = "page_id", url: str = "url", html: str = "html", file_bytes: int = FILE_BYTES
) -> tuple[DataFrame, int]:
    """(path, records) of the archives of all rows, and their number."""
    folder = shared_path(pages.sparkSession, "warc")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, part, ended = TaskContext.get().partitionId(), 0, False
        rows = (row for batch in batches for row in zip(*(c.to_pylist() for c in batch.columns), strict=True))
        while not ended:
            target, size, n = f"{folder}/{number:08d}-{part:05d}.warc.gz", 0, 0
            row = next(rows, None)
            if row is None:
                break
            with new_file(target) as file:
                while row is not None:
                    page_id, address, payload, refers_to = row
                    member = record(page_id, address, payload, refers_to)
                    file.write(member)
                    size, n = size + len(member), n + 1
                    if size >= file_bytes:
                        break
                    row = next(rows, None)
                ended = row is None
            part += 1
            yield pa.RecordBatch.from_arrays([pa.array([target]), pa.array([n], pa.int64())], ["path", "records"])

    clean = pages.select(
        col(row_id).cast("long").alias("page_id"),
        col(url).cast("string").alias("url"),
        F.coalesce(col(html).cast("binary"), F.lit(b"")).alias("html"),
    )
    return files(referred(clean).mapInArrow(write, "path string, records long"), "warc_files")


def read_warc(listed: DataFrame, n_files: int) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to) of every record.

    Fails if a digest does not hold or a file has not all of its records.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for uri, records in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                fs, path = store(uri)
                rows = []
                with fs.open_input_stream(path, compression=None) as file:
                    for r in read_records(file.read):
                        ids = [r.fields.get(f) for f in ("x-page-id", "x-refers-to-page-id")]
                        page, to = (int(i) if i is not None else None for i in ids)
                        rows.append((page, r.payload_bytes, r.payload_digest, r.fields["warc-type"], to))
                if len(rows) != records:
                    raise ValueError(f"{uri} holds {len(rows)} of {records} records")
                columns = list(zip(*rows, strict=True)) or [()] * 5
                kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)],
                    ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"],
                )

    schema = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"
    return listed.repartition(max(1, n_files)).mapInArrow(run, schema)


def archive(pages: DataFrame, row_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """Write an archive of all rows and read it back: one row for each.

    Null html is empty, null ids and urls stay null, repeated rows are repeated
    records, an empty table gives no rows.
    """
    return read_warc(*write_warc(pages, row_id, url, html))
