"""WARC archives of one Zstandard frame per record, with the dictionary in a leading skippable frame."""

from __future__ import annotations

import base64
import hashlib
import re
import struct
import uuid
from collections.abc import Iterator
from typing import BinaryIO

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marlstone.llm.common import quoted
from marlstone.session import new_folder, write_cut

# From the published WARC/Zstandard format (fixed values): the dictionary frame and the frame magic.
DICTIONARY_MAGIC = 0x184D2A5D
FRAME_MAGIC = b"\x28\xb5\x2f\xfd"
SKIPPABLE = range(0x184D2A50, 0x184D2A60)

MIN_REVISIT_BYTES = 1000
ARCHIVE_BYTES = 64 << 20
DICTIONARY_BYTES = 64 << 10
# The dictionary is trained on this many payloads and bytes at most.
SAMPLE_ROWS = 500
SAMPLE_BYTES = 8 << 20
READ_BYTES = 1 << 20
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


class DamagedRecord(ValueError):
    """A frame or record that does not say what the format asks for."""


def train(payloads: list[bytes], size: int = DICTIONARY_BYTES) -> bytes:
    """A dictionary for the payloads; where there is too little to train on, none."""
    try:
        return zstandard.train_dictionary(size, payloads).as_bytes()
    except zstandard.ZstdError:
        return b""


def record(kind: str, uri: str, payload: bytes, digest: str, refers_to: str | None, date: str) -> bytes:
    """One record with its HTTP head; a revisit has the head alone, which still states the payload's length."""
    head = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = head if kind == "revisit" else head + payload
    b32 = lambda b: base64.b32encode(b).decode()
    uri, refers_to = (u and re.sub(r"[\x00-\x1f\x7f]", lambda m: f"%{ord(m[0]):02X}", u) for u in (uri, refers_to))
    fields = [("WARC-Type", kind), ("WARC-Record-ID", f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, kind + uri)}>"),
              ("WARC-Target-URI", uri), ("WARC-Date", date), ("WARC-Payload-Digest", "sha1:" + b32(bytes.fromhex(digest))),
              ("WARC-Block-Digest", "sha1:" + b32(hashlib.sha1(block).digest()))]
    if refers_to is not None:
        fields += [("WARC-Refers-To-Target-URI", refers_to), ("WARC-Profile", PROFILE)]
    fields += [("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(block)))]
    lines = "".join(f"{k}: {v}\r\n" for k, v in fields)
    return b"WARC/1.1\r\n" + lines.encode() + b"\r\n" + block + b"\r\n\r\n"


def parse(data: bytes) -> dict:
    """Fields and payload of one record; every stated length and digest is checked."""
    head, blank, rest = data.partition(b"\r\n\r\n")
    version, *lines = head.decode().split("\r\n")
    if not blank or not re.fullmatch(r"WARC/1\.[01]", version):
        raise DamagedRecord("no WARC head")
    fields = {}
    for line in lines:
        name, colon, value = line.partition(":")
        if not colon:
            raise DamagedRecord(f"no colon in the field {line!r}")
        fields[name.strip().lower()] = value.strip()
    for name in ("warc-type", "warc-record-id", "warc-date", "content-length"):
        if name not in fields:
            raise DamagedRecord(f"no {name}")
    if not fields["content-length"].isdigit():
        raise DamagedRecord("content-length is no number")
    size = int(fields["content-length"])
    block = rest[:size]
    if len(block) != size or rest[size:] != b"\r\n\r\n":
        raise DamagedRecord("the block is not as long as stated")
    _check_digest(fields, "warc-block-digest", block)
    out = {"fields": fields, "type": fields["warc-type"], "block": block, "payload": block, "payload_length": size}
    if fields.get("content-type", "").startswith("application/http"):
        http, blank, payload = block.partition(b"\r\n\r\n")
        stated = re.search(rb"(?im)^content-length:\s*(\d+)\s*$", http)
        if not blank or stated is None:
            raise DamagedRecord("no HTTP head with a length")
        out |= {"payload": payload, "payload_length": int(stated[1])}
        if out["type"] == "response" and len(payload) != out["payload_length"]:
            raise DamagedRecord("the payload is not as long as stated")
    if out["type"] == "response":
        _check_digest(fields, "warc-payload-digest", out["payload"])
    return out


def _check_digest(fields: dict, name: str, data: bytes) -> None:
    stated = fields.get(name)
    if stated and stated.lower().startswith("sha1:") and base64.b32decode(stated[5:]) != hashlib.sha1(data).digest():
        raise DamagedRecord(f"{name} does not fit")


class ArchiveWriter:
    """Appends records to an open file, each a frame of its own."""

    def __init__(self, out: BinaryIO, dictionary: bytes, level: int = 3):
        self.out, self.bytes = out, 0
        self.compressor = zstandard.ZstdCompressor(level=level, write_content_size=True, write_checksum=True,
                                                   dict_data=zstandard.ZstdCompressionDict(dictionary) if dictionary else None)
        if dictionary:
            packed = zstandard.ZstdCompressor(level=9).compress(dictionary)
            self._write(struct.pack("<II", DICTIONARY_MAGIC, len(packed)) + packed)

    def _write(self, data: bytes) -> None:
        self.out.write(data)
        self.bytes += len(data)

    def add(self, data: bytes) -> None:
        self._write(self.compressor.compress(data))


def read_archive(source: BinaryIO) -> Iterator[bytes]:
    """The records of an archive, frame by frame; holds one record and one read buffer at a time."""
    buffer = source.read(READ_BYTES)
    dictionary = None
    if len(buffer) >= 8 and struct.unpack("<I", buffer[:4])[0] == DICTIONARY_MAGIC:
        size = struct.unpack("<I", buffer[4:8])[0]
        while len(buffer) < 8 + size:
            more = source.read(READ_BYTES)
            if not more:
                raise DamagedRecord("the dictionary frame is cut off")
            buffer += more
        raw, buffer = buffer[8:8 + size], buffer[8 + size:]
        dictionary = zstandard.ZstdCompressionDict(zstandard.decompress(raw) if raw[:4] == FRAME_MAGIC else raw)
    decompressor = zstandard.ZstdDecompressor(dict_data=dictionary) if dictionary else zstandard.ZstdDecompressor()
    while True:
        buffer = buffer or source.read(READ_BYTES)
        if not buffer:
            return
        if len(buffer) < 8:
            buffer += source.read(READ_BYTES)
        if struct.unpack("<I", buffer[:4].ljust(4, b"\0"))[0] in SKIPPABLE:
            size = 8 + struct.unpack("<I", buffer[4:8])[0]
            while len(buffer) < size:
                more = source.read(READ_BYTES)
                if not more:
                    raise DamagedRecord("a skippable frame is cut off")
                buffer += more
            buffer = buffer[size:]
            continue
        frame, parts = decompressor.decompressobj(), []
        while True:
            try:
                parts.append(frame.decompress(buffer))
            except zstandard.ZstdError as e:
                raise DamagedRecord(f"no readable frame: {e}") from e
            if frame.eof:
                buffer = frame.unused_data
                break
            buffer = source.read(READ_BYTES)
            if not buffer:
                raise DamagedRecord("the last frame is cut off")
        yield b"".join(parts)


def write_archives(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html",
                   min_revisit_bytes: int = MIN_REVISIT_BYTES, archive_bytes: int = ARCHIVE_BYTES, date: str = "2024-01-01T00:00:00Z") -> DataFrame:
    """Write one record per page to ``*.warc.zst`` files in a shared folder; returns (path, records, bytes) of the files that count.

    Of pages with equal payloads of at least ``min_revisit_bytes`` bytes the one with the largest id is
    the response and the others revisit it.  Equality is that of SHA-1 and length, found by a grouping
    over digests.  A null payload is empty, a null url too; a page with a null id is written under the
    id ``null`` and is never the one referred to; rows alike in id and payload are all responses.  An
    empty table gives no file.  Each attempt of a task writes files of its own, and only the files in
    the returned, written table belong to the result.  The folder may be on any store that pyarrow opens.
    """
    payload = F.coalesce(quoted(payload_col), F.lit("")).cast("binary")
    rows = pages.select(quoted(id_col).cast("long").alias("id"), F.coalesce(quoted(url_col), F.lit("")).alias("url"), payload.alias("payload"))
    rows = rows.withColumn("digest", F.sha1("payload")).withColumn("size", F.octet_length("payload"))
    # Which pages revisit which is found without their payloads.
    pages_of = rows.select("id", "url", "digest", "size").where(F.col("size") >= min_revisit_bytes)
    same = (pages_of.groupBy("digest", "size").agg(F.max(F.struct("id", "url")).alias("first"), F.count(F.lit(1)).alias("n"))
            .where((F.col("n") > 1) & F.col("first.id").isNotNull()))
    revisits = (pages_of.select("id", "digest", "size").distinct().join(same, ["digest", "size"]).where(~F.col("first.id").eqNullSafe(F.col("id")))
                .select("id", "digest", F.col("first.id").alias("refers_to"), F.col("first.url").alias("refers_url")))
    r, s = rows.alias("r"), revisits.alias("s")
    told = (r.join(s, F.col("r.id").eqNullSafe(F.col("s.id")) & (F.col("r.digest") == F.col("s.digest")), "left")
            .select("r.id", "r.url", "r.payload", "r.digest", "s.refers_to", "s.refers_url"))
    # Ids first, then the payloads of these alone: SAMPLE_ROWS rows and SAMPLE_BYTES in all at most.
    small = rows.select(F.xxhash64("id").alias("pick"), "payload", "size").where(F.col("size").between(1, SAMPLE_BYTES // SAMPLE_ROWS))
    picked = [r["pick"] for r in small.select("pick").distinct().orderBy("pick").limit(SAMPLE_ROWS).collect()]
    sample = [bytes(r["payload"]) for r in small.where(F.col("pick").isin(picked)).groupBy("pick").agg(F.min("payload").alias("payload")).orderBy("pick").collect()]
    shared = pages.sparkSession.sparkContext.broadcast(train(sample))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        store, base = fs.FileSystem.from_uri(folder) if "://" in folder or folder.startswith("file:") else (fs.LocalFileSystem(), folder)
        store.create_dir(base, recursive=True)
        out, n, made = None, 0, []

        def close() -> None:
            nonlocal out, n
            if out is not None:
                out.out.close()
                made.append((path, n, out.bytes))
            out, n = None, 0

        for batch in batches:
            for row in (r for at in range(0, batch.num_rows, 64) for r in batch.slice(at, 64).to_pylist()):
                if out is None:
                    path = f"{base}/{uuid.uuid4().hex}.warc.zst"
                    out = ArchiveWriter(store.open_output_stream(path), shared.value)
                page = "null" if row["id"] is None else str(row["id"])
                refers = None if row["refers_to"] is None else f"page:{row['refers_to']} {row['refers_url']}"
                out.add(record("response" if refers is None else "revisit", f"page:{page} {row['url']}", row["payload"] or b"", row["digest"], refers, date))
                n += 1
                if out.bytes >= archive_bytes:
                    close()
        close()
        if made:
            yield pa.RecordBatch.from_arrays([pa.array([m[k] for m in made]) for k in range(3)], names=["path", "records", "bytes"])

    return write_cut(told.mapInArrow(write, "path string, records long, bytes long"), "archives")


RECORD = "archive string, target string, record_type string, refers_to string, payload_length long, payload_digest string, payload binary"


def read_archives(paths: DataFrame, folder: str) -> DataFrame:
    """The records of the archives in column ``path``: (archive, target, record_type, refers_to, payload_length, payload_digest, payload).

    There is a task for each archive; it holds a few records at a time.  Anything that is
    not as stated (frame, head, length, digest, number of records) raises ``DamagedRecord``.  The digest
    is bare lower-case hexadecimal, that of the full payload also for revisits, whose payload is null.
    """
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        store = fs.FileSystem.from_uri(folder)[0] if "://" in folder or folder.startswith("file:") else fs.LocalFileSystem()
        names = [f.split(" ")[0] for f in RECORD.split(", ")]
        types = [pa.string()] * 4 + [pa.int64(), pa.string(), pa.binary()]
        for batch in batches:
            for path, wanted in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                rows, held, n = [], 0, 0
                with store.open_input_stream(path) as source:
                    for data in read_archive(source):
                        r, n = parse(data), n + 1
                        digest = r["fields"].get("warc-payload-digest", "")
                        rows.append((path, r["fields"].get("warc-target-uri"), r["type"], r["fields"].get("warc-refers-to-target-uri"), r["payload_length"],
                                     base64.b32decode(digest[5:]).hex() if digest[:5].lower() == "sha1:" else None, r["payload"] if r["type"] == "response" else None))
                        held += len(data)
                        if held > 8 << 20:
                            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)
                            rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)
                if n != wanted:
                    raise DamagedRecord(f"{path} has {n} records, not {wanted}")

    return paths.select("path", "records").repartition(max(1, paths.count())).mapInArrow(read, RECORD)


def round_trip(pages: DataFrame, **options) -> DataFrame:
    """Write ``pages`` to archives in the shared folder and read them back."""
    folder = new_folder(pages.sparkSession, "warc")
    return read_archives(write_archives(pages, folder, **options), folder)
