"""WARC archives under Zstandard: one frame per record, the dictionary in front.

An archive starts with a skippable frame that holds the compression dictionary, as it
is or as a Zstandard frame of its own. Every record after it is one frame, so a reader
can start at any of them. Records with equal payloads are written once; the others are
revisit records that name the first and keep the HTTP head only.

Archives are closed at a size limit, hence an archive fits a task. Writing goes through
the file systems that Arrow knows, reading through Spark's ``binaryFile`` source.
"""

from __future__ import annotations

import base64
import hashlib
import os
import uuid
from collections.abc import Iterator
from urllib.parse import quote

import zstandard
from pyarrow.fs import FileSystem
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F

from solvenza.llm.common import map_rows, written
from solvenza.session import shared_dir

# Fixed values of the formats.
DICTIONARY_MAGIC = (0x184D2A5D).to_bytes(4, "little")
SKIPPABLE_MAGICS = {(0x184D2A50 + i).to_bytes(4, "little") for i in range(16)}
FRAME_MAGIC = (0xFD2FB528).to_bytes(4, "little")
VERSIONS = (b"WARC/1.0", b"WARC/1.1")
REQUIRED = ("warc-type", "warc-record-id", "warc-date", "content-length")
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

REVISIT_FROM = 1000             # bytes of a payload that is worth a revisit record
ARCHIVE_BYTES = 32 << 20        # of records, before compression
DICTIONARY_BYTES = 32 << 10
SAMPLE_RECORDS, SAMPLE_BYTES = 256, 1 << 20     # what a dictionary is trained on
LEVEL = 3
DATE = "2026-01-01T00:00:00Z"   # capture time; the pages table has none


class BadRecord(ValueError):
    """A frame, record or header that breaks the format."""


# --- writing ------------------------------------------------------------------

def _digest(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, date: str = DATE) -> bytes:
    """One response record, or a revisit record if ``refers_to`` names another page."""
    name = "" if page_id is None else str(page_id)
    head = (
        "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
        f"Content-Length: {len(payload)}\r\n\r\n"
    ).encode()
    block = head + payload if refers_to is None else head
    fields = [
        ("WARC-Type", "response" if refers_to is None else "revisit"),
        ("WARC-Record-ID", f"<urn:page:{name}>"),
        ("WARC-Date", date),
        ("WARC-Target-URI", quote(url, safe="%/:=&?~#+!$,;'@()*[]") if url else f"urn:page:{name}"),
        ("WARC-Payload-Digest", _digest(payload)),
        ("WARC-Block-Digest", _digest(block)),
        ("Content-Type", "application/http; msgtype=response"),
        ("Content-Length", str(len(block))),
    ]
    if refers_to is not None:
        fields += [("WARC-Profile", REVISIT_PROFILE), ("WARC-Refers-To", f"<urn:page:{refers_to}>")]
    lines = "".join(f"{k}: {v}\r\n" for k, v in fields)
    return b"WARC/1.1\r\n" + lines.encode() + b"\r\n" + block + b"\r\n\r\n"


def dictionary(samples: list[bytes]) -> zstandard.ZstdCompressionDict:
    """Trained on the samples, or their plain content where they are too few."""
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, samples, k=256, d=8)
    except zstandard.ZstdError:
        content = b"".join(samples)[:DICTIONARY_BYTES]
        return zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)


def archive(records: list[bytes]) -> bytes:
    """An archive of the records, with a dictionary trained on the first of them."""
    samples, size = [], 0
    for r in records[:SAMPLE_RECORDS]:
        samples.append(r[:SAMPLE_BYTES - size])
        size += len(samples[-1])
        if size >= SAMPLE_BYTES:
            break
    trained = dictionary(samples)
    stored = zstandard.ZstdCompressor(level=LEVEL).compress(trained.as_bytes())
    compressor = zstandard.ZstdCompressor(level=LEVEL, dict_data=trained, write_checksum=True)
    front = DICTIONARY_MAGIC + len(stored).to_bytes(4, "little") + stored
    return b"".join([front, *map(compressor.compress, records)])


def _put(folder: str, name: str, data: bytes) -> None:
    """A file that is there whole or not at all; a task that runs again replaces it."""
    files, path = FileSystem.from_uri(folder)
    files.create_dir(path, recursive=True)
    part = os.path.join(path, f"_{name}.{uuid.uuid4().hex}")
    with files.open_output_stream(part) as out:
        out.write(data)
    files.move(part, os.path.join(path, name))


def revisits(pages: DataFrame, smallest: int = REVISIT_FROM) -> DataFrame:
    """(page_id, digest, refers_to) of the pages whose payload another page holds.

    Equal payloads, by SHA-1 and length, are represented by the largest page_id. Only
    digests are shuffled, combined first; both join inputs are written tables, so a
    payload with very many pages is split.
    """
    marked = pages.select("page_id", F.sha1(F.coalesce("html", F.lit(""))).alias("digest"),
                          F.octet_length("html").alias("size")).filter(F.col("size") >= smallest)
    marked = written(marked.select("page_id", "digest"), "warc-digests")
    firsts = marked.groupBy("digest").agg(F.max("page_id").alias("refers_to"), F.count(F.lit(1)).alias("n"))
    shared = written(firsts.filter("n > 1 AND refers_to IS NOT NULL").drop("n"), "warc-shared")
    found = marked.join(shared, "digest").filter("NOT page_id <=> refers_to")
    return found.select("page_id", "digest", "refers_to").distinct()


def write_archives(pages: DataFrame, folder: str, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Writes a record per page to archives in ``folder`` on shared storage.

    Returns the manifest: name, records, bytes. NULL html is an empty payload, a NULL
    url becomes a name made of the page_id; a NULL page_id writes an id without number.
    Of pages with equal payloads of at least ``REVISIT_FROM`` bytes the one with the
    largest page_id is the response (each of them, if that row is repeated), the others
    revisit it; without any page_id all are responses. Only page_id, url and html are
    read. An empty table writes no archive. Rows are sorted in a task, so that a task
    that runs again writes the same files under the same names.
    """
    first = written(revisits(pages), "warc-revisits").select(
        F.col("page_id").alias("_page"), F.col("digest").alias("_digest"), "refers_to"
    )
    own = pages.select("page_id", "url", "html", F.sha1(F.coalesce("html", F.lit(""))).alias("_sha"))
    same = F.col("page_id").eqNullSafe(F.col("_page")) & (F.col("_sha") == F.col("_digest"))
    marked = own.join(first, same, "left").select("page_id", "url", "html", "refers_to")

    def rows(batches: Iterator[list[list]]) -> Iterator[tuple]:
        partition, held, size, number = TaskContext.get().partitionId(), [], 0, 0

        def close() -> tuple:
            name = f"part-{partition:06d}-{number:05d}.warc.zst"
            data = archive(held)
            _put(folder, name, data)
            return name, len(held), len(data)

        for batch in batches:
            for page_id, url, html, refers_to in zip(*batch):
                held.append(record(page_id, url, (html or "").encode(), refers_to))
                size += len(held[-1])
                if size >= archive_bytes:
                    yield close()
                    held, size, number = [], 0, number + 1
        if held:
            yield close()

    # The sizes of the manifest are known when it has been written.
    dealt = marked.sortWithinPartitions("page_id", "url", F.sha1("html"))
    return written(map_rows(dealt, "name string, records bigint, bytes bigint", rows), "warc-manifest")


# --- reading ------------------------------------------------------------------

def frame_end(data: memoryview, at: int) -> int:
    """Where the frame that starts at ``at`` ends, from its headers alone."""
    if data[at:at + 4] in SKIPPABLE_MAGICS:
        end = at + 8 + int.from_bytes(data[at + 4:at + 8], "little")
    else:
        if data[at:at + 4] != FRAME_MAGIC:
            raise BadRecord("no frame starts here")
        flags = data[at + 4]
        single = flags >> 5 & 1
        content = (1 if single else 0, 2, 4, 8)[flags >> 6]
        end = at + 5 + (1 - single) + (0, 1, 2, 4)[flags & 3] + content
        last = False
        while not last:
            if end + 3 > len(data):
                raise BadRecord("the archive ends inside a frame")
            head = int.from_bytes(data[end:end + 3], "little")
            last, kind, size = bool(head & 1), head >> 1 & 3, head >> 3
            if kind == 3:
                raise BadRecord("unknown kind of block")
            end += 3 + (1 if kind == 1 else size)
        end += 4 * (flags >> 2 & 1)
    if end > len(data):
        raise BadRecord("the archive ends inside a frame")
    return end


def read_dictionary(data: memoryview) -> tuple[zstandard.ZstdCompressionDict | None, int]:
    """The dictionary of the leading skippable frame, if any, and where records start."""
    if data[:4] != DICTIONARY_MAGIC:
        return None, 0
    end = frame_end(data, 0)
    stored = bytes(data[8:end])
    if stored[:4] == FRAME_MAGIC:
        stored = zstandard.ZstdDecompressor().decompressobj().decompress(stored)
    return zstandard.ZstdCompressionDict(stored), end


def _fields(head: bytes) -> dict[str, str]:
    found = {}
    for line in head.split(b"\r\n"):
        name, colon, value = line.partition(b":")
        if not colon or not name or name != name.strip():
            raise BadRecord("a header line without a name")
        found.setdefault(name.decode("utf-8", "replace").lower(), value.strip().decode("utf-8", "replace"))
    return found


def _length(fields: dict[str, str]) -> int:
    text = fields.get("content-length", "")
    if not (text.isascii() and text.isdigit()):
        raise BadRecord("Content-Length is no number")
    return int(text)


def parse(data: bytes) -> dict:
    """One validated record: version, required fields, lengths and digests."""
    head, blank, rest = data.partition(b"\r\n\r\n")
    version, _, lines = head.partition(b"\r\n")
    if not blank or version not in VERSIONS:
        raise BadRecord("no WARC header")
    fields = _fields(lines)
    missing = [name for name in REQUIRED if not fields.get(name)]
    if missing:
        raise BadRecord(f"missing {', '.join(missing)}")
    length = _length(fields)
    if len(rest) != length + 4 or rest[length:] != b"\r\n\r\n":
        raise BadRecord(f"Content-Length {length}, but {len(rest) - 4} bytes in the frame")
    block = rest[:length]
    if "warc-block-digest" in fields and fields["warc-block-digest"] != _digest(block):
        raise BadRecord("the block does not match its digest")
    kind = fields["warc-type"]
    found = {
        "record_type": kind, "record_id": fields["warc-record-id"].strip("<>"),
        "target_uri": fields.get("warc-target-uri"), "date": fields["warc-date"],
        "refers_to_id": fields["warc-refers-to"].strip("<>") if "warc-refers-to" in fields else None,
        "payload_bytes": None, "payload_digest": None, "payload": None,
    }
    if kind not in ("response", "revisit"):
        return found
    http, blank, payload = block.partition(b"\r\n\r\n")
    if not blank or not http.startswith(b"HTTP/"):
        raise BadRecord("no HTTP head")
    stated = _length(_fields(http.partition(b"\r\n")[2]))
    digest = fields.get("warc-payload-digest", "")
    if kind == "response" and (stated != len(payload) or digest and digest != _digest(payload)):
        raise BadRecord("the payload does not match its length or digest")
    if kind == "revisit" and (payload or not found["refers_to_id"] or not digest):
        raise BadRecord("a revisit record needs a digest and what it refers to, and no payload")
    found["payload_bytes"] = stated
    try:
        algorithm, _, code = (digest or _digest(payload)).partition(":")
        found["payload_digest"] = base64.b32decode(code).hex() if algorithm == "sha1" else None
    except ValueError:
        raise BadRecord("the payload digest can't be read") from None
    found["payload"] = payload if kind == "response" else None
    return found


READ_SCHEMA = (
    "path string, position bigint, record_type string, record_id string, target_uri string, date string, "
    "refers_to_id string, payload_bytes bigint, payload_digest string, payload binary, problem string"
)
_NAMES = [c.strip().split(" ")[0] for c in READ_SCHEMA.split(",")]


def records_of(data: bytes, strict: bool) -> Iterator[dict]:
    """Every record of an archive; what breaks the format raises, or without ``strict``
    becomes a row with the ``problem``. After a broken frame the rest can't be found."""
    view = memoryview(data)
    at = 0
    try:
        trained, at = read_dictionary(view)
        reader = zstandard.ZstdDecompressor(dict_data=trained) if trained else zstandard.ZstdDecompressor()
        while at < len(view):
            end = frame_end(view, at)
            if view[at:at + 4] == FRAME_MAGIC:
                try:
                    yield {"position": at, **parse(reader.decompressobj().decompress(view[at:end]))}
                except (BadRecord, zstandard.ZstdError) as e:
                    if strict:
                        raise BadRecord(f"record at byte {at}: {e}") from None
                    yield {"position": at, "problem": str(e)}
            at = end
    except (BadRecord, zstandard.ZstdError) as e:
        if strict:
            raise BadRecord(f"byte {at}: {e}") from None
        yield {"position": at, "problem": str(e)}


def read_archives(spark: SparkSession, folder: str, strict: bool = True, with_payload: bool = True) -> DataFrame:
    """Records of all ``*.warc.zst`` archives in ``folder``, one row each.

    ``payload_bytes`` and ``payload_digest`` (hex SHA-1) describe the whole payload, of
    a revisit record too. A broken record raises; without ``strict`` it is a row with
    its ``problem``. An archive is read by one task and must fit it; an empty archive
    gives no rows.
    """
    found = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.zst").load(folder)

    def rows(batches: Iterator[list[list]]) -> Iterator[tuple]:
        for paths, contents in batches:
            for path, content in zip(paths, contents):
                for r in records_of(content, strict):
                    if not with_payload:
                        r.pop("payload", None)
                    yield tuple(path if n == "path" else r.get(n) for n in _NAMES)

    return map_rows(found.select("path", "content"), READ_SCHEMA, rows)


def round_trip(pages: DataFrame) -> DataFrame:
    """Writes all pages to archives in the shared folder and reads them back: page_id,
    payload_bytes, payload_digest, record_type, refers_to and target_uri per page."""
    spark = pages.sparkSession
    folder = shared_dir(spark, "warc")
    kind = pages.schema["page_id"].dataType
    if write_archives(pages, folder).isEmpty():
        read = spark.createDataFrame([], READ_SCHEMA)
    else:
        read = read_archives(spark, folder, with_payload=False)
    page = lambda c: F.nullif(F.substring_index(c, ":", -1), F.lit("")).cast(kind)
    return read.select(
        page(F.col("record_id")).alias("page_id"), "payload_bytes", "payload_digest", "record_type",
        page(F.col("refers_to_id")).alias("refers_to"), "target_uri",
    )
