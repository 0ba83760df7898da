"""WARC archives of web pages, written and read as a table of chunks.

Payloads are cut into rows (record, chunk number, bytes) on the JVM's side, and from there on no row, Arrow cell or buffer
holds more than a chunk. A pass over a record's consecutive rows carries SHA-1 and length along; its last row has those of
the whole payload. Records of equal payloads of `least` bytes or more are one response, that of the largest id, and
revisits that refer to it: for this only ids and digests move. The chunk table is written once to the shared folder. One
shuffle by record then brings each record's head and chunks together in order, so a writer streams them into a gzip
member, one a record, through whatever file system the shared folder is on. Each task writes files of its own name, and
only those that a finished task reports in the manifest are read, so a task that is run again leaves no second copy. The
manifest gives every record's file, place and length; archives are read back member by member, as chunk rows again.

Defined results: a null or empty payload is a record of 0 bytes; with `least` over 0 smaller records are all responses;
rows with the largest id of their payload are responses, also when that id repeats; a null id ranks below all, and a
payload with null ids only has responses only; a null url has no WARC-Target-URI; an empty table writes no archive;
other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, functions as F

from .util import batches, cut, own, shared_dir, stored

CHUNK = 1 << 18
#: Bytes of payload after which a task begins its next archive.
ARCHIVE_BYTES = 256 << 20
#: A payload of more than one record in so many is looked up by a broadcast; there are at most so many of them.
SHARE = 10_000
_CRLF = b"\r\n"
_END = _CRLF + _CRLF


def base32_sha1(digest: bytes) -> str:
    return base64.b32encode(digest).decode()


def chunk_table(pages: DataFrame, size: int = CHUNK) -> DataFrame:
    """(rid, page_id, url, chunk_no, data, so_far, digest): the chunked record table, in the shared folder.

    rid numbers the rows of pages; digest is set on a record's last chunk; an empty payload has one empty chunk.
    """
    names = ["rid", "page_id", "url", "chunk_no", "data", "so_far", "digest"]
    last = F.greatest(F.lit(1), F.ceil(F.octet_length("payload") / size)) - 1
    rows = _payloads(pages).withColumn("rid", F.monotonically_increasing_id()).select("rid", "page_id", "url", "payload", last.cast("int").alias("last"), F.explode(F.sequence(F.lit(0), last.cast("int"))).alias("chunk_no"))
    rows = rows.select("rid", "page_id", "url", "chunk_no", F.substring("payload", F.col("chunk_no") * size + 1, F.lit(size)).alias("data"), (F.col("chunk_no") == F.col("last")).alias("is_last"))

    def carry(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sha, far = hashlib.sha1(usedforsecurity=False), 0
        for b in it:
            so_far, digests = [], []
            for data, ends in zip(b.column(4), b.column(5).to_pylist(), strict=True):
                sha.update(data.as_buffer())
                far += len(data.as_buffer())
                so_far.append(far)
                digests.append(base32_sha1(sha.digest()) if ends else None)
                if ends:
                    sha, far = hashlib.sha1(usedforsecurity=False), 0
            yield pa.RecordBatch.from_arrays([*b.columns[:5], pa.array(so_far, pa.int64()), pa.array(digests, pa.string())], names)

    shared_dir(pages.sparkSession)
    return stored(rows.mapInArrow(carry, "rid long, page_id long, url string, chunk_no int, data binary, so_far long, digest string"), "chunks", "zstd")


def _payloads(pages: DataFrame) -> DataFrame:
    return own(pages, "page_id", "url", "html").select(F.col("page_id").cast("long"), "url", F.coalesce("html", F.lit("")).cast("binary").alias("payload"))


def _head(kind: str, page_id: int | None, url: str | None, digest: str, length: int, refers_to: int | None, date: str) -> tuple[bytes, bytes]:
    """The WARC header and the HTTP header of a record's block."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % length
    block = len(http) + (length if kind == "response" else 0)
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:page:{'null' if page_id is None else page_id}>", f"WARC-Date: {date}"]
    if url is not None:
        lines.append("WARC-Target-URI: " + re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url))
    lines.append(f"WARC-Payload-Digest: sha1:{digest}")
    if kind == "revisit":
        lines += [f"WARC-Refers-To: <urn:page:{refers_to}>", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {block}"]
    return "\r\n".join(lines).encode() + _CRLF + _CRLF, http


def _file_system(folder: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a path or URI (local, hdfs, s3, gs as the installed Arrow has them), and the path in it."""
    return pafs.FileSystem.from_uri(re.sub(r"^file:/+", "file:///", folder) if ":" in folder else f"file://{folder}")


def responses(heads: DataFrame, least: int = 0) -> DataFrame:
    """heads (rid, page_id, url, bytes, digest) with `first`, the id that a revisit refers to; null for responses.

    Payloads that more than one record in SHARE has are at most SHARE; those few are broadcast, so no key gathers a large
    part of all rows.
    """
    known = heads.where(F.col("bytes") >= least).groupBy("digest", "bytes").agg(F.max("page_id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1 and first is not null")
    known = cut(known.select(F.col("digest").alias("_digest"), F.col("bytes").alias("_bytes"), "first", "n"))
    total = heads.count()
    hot = known.where(F.col("n") * SHARE > total).drop("n")
    same = lambda a, b: (a["digest"] == b["_digest"]) & (a["bytes"] == b["_bytes"])
    met = heads.join(F.broadcast(hot.withColumnRenamed("first", "_hot")), (F.col("digest") == F.col("_digest")) & (F.col("bytes") == F.col("_bytes")), "left").drop("_digest", "_bytes")
    cold = known.where(F.col("n") * SHARE <= total).drop("n")
    often = met.where("_hot is not null").withColumnRenamed("_hot", "first")
    rest = met.where("_hot is null").drop("_hot")
    every = often.unionByName(rest.join(cold, same(rest, cold), "left").drop("_digest", "_bytes"))
    return every.withColumn("first", F.when(~F.col("page_id").eqNullSafe(F.col("first")), F.col("first")))


def write_archives(pages: DataFrame, folder: str | None = None, least: int = 0, size: int = CHUNK, date: str = "2024-01-01T00:00:00Z") -> DataFrame:
    """Write all pages as records; returns the manifest (file, start, length), a row a record."""
    folder = folder or f"{shared_dir(pages.sparkSession)}/warc-{uuid.uuid4().hex}"
    fs, root = _file_system(folder)
    fs.create_dir(root, recursive=True)
    table = chunk_table(pages, size)
    heads = table.where("digest is not null").select("rid", "page_id", "url", F.col("so_far").alias("bytes"), "digest")
    heads = responses(heads, least).withColumn("chunk_no", F.lit(-1)).withColumn("data", F.lit(None).cast("binary"))
    none = lambda kind: F.lit(None).cast(kind)
    body = table.select("rid", none("long").alias("page_id"), none("string").alias("url"), none("long").alias("bytes"), none("string").alias("digest"), none("long").alias("first"), "chunk_no", "data")
    # a record's head sorts before its chunks
    dealt = heads.select(*body.columns).unionByName(body).repartition("rid").sortWithinPartitions("rid", "chunk_no")

    def write(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = _file_system(folder)
        out, path, at, start, gz, kind, left = None, "", 0, 0, None, "", 0
        places: list[tuple] = []

        def put(z: bytes) -> None:
            nonlocal at
            out.write(z)
            at += len(z)

        def end() -> None:
            if gz is not None:
                if left:
                    raise ValueError(f"a record in {path} lacks {left} bytes")
                put(gz.compress(_END))
                put(gz.flush())
                places.append((path, start, at - start))

        for b in it:
            cols = [b.column(i).to_pylist() for i in range(1, 7)]
            for page_id, url, length, digest, first, number, data in zip(*cols, b.column(7), strict=True):
                if number >= 0:
                    if kind == "response":
                        part = data.as_buffer()
                        put(gz.compress(part))
                        left -= len(part)
                    continue
                end()
                if out is None or at >= ARCHIVE_BYTES:
                    if out is not None:
                        out.close()
                    path, at = f"{root}/{uuid.uuid4().hex}.warc.gz", 0
                    out = fs.open_output_stream(path, compression=None)
                start, gz, kind = at, zlib.compressobj(4, zlib.DEFLATED, 31), "response" if first is None else "revisit"
                left = length if first is None else 0
                for part in _head(kind, page_id, url, digest, length, first, date):
                    put(gz.compress(part))
            if places:
                yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*places, strict=True), (pa.string(), pa.int64(), pa.int64()), strict=True)], ["file", "start", "length"])
                places.clear()
        end()
        if out is not None:
            out.close()
        if places:
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*places, strict=True), (pa.string(), pa.int64(), pa.int64()), strict=True)], ["file", "start", "length"])

    return stored(dealt.mapInArrow(write, "file string, start long, length long"), "manifest")


def _member(f: pa.NativeFile, start: int, length: int, size: int) -> Iterator[bytes]:
    """The bytes of one gzip member, at most `size` at a time."""
    f.seek(start)
    gz, left = zlib.decompressobj(31), length
    while left > 0:
        data = f.read(min(size, left))
        if not data:
            raise OSError(f"archive ends {left} bytes early")
        left -= len(data)
        while data:
            yield gz.decompress(data, size)
            data = gz.unconsumed_tail
    while part := gz.decompress(gz.unconsumed_tail, size):
        yield part


def _record(stream: Iterator[bytes]) -> tuple[dict[str, str], dict[str, str], Iterator[bytes]]:
    """The WARC fields, the HTTP fields and the payload's chunks of a record."""
    buffer = b""

    def fields() -> tuple[dict[str, str], int]:
        nonlocal buffer
        while (end := buffer.find(_CRLF + _CRLF)) < 0:
            buffer += next(stream)
        lines = buffer[:end].decode("utf-8").split("\r\n")[1:]
        buffer = buffer[end + 4 :]
        return {k.lower(): v for k, v in (x.split(": ", 1) for x in lines)}, end + 4

    warc, _ = fields()
    http, taken = fields()
    block = int(warc["content-length"]) - taken

    def payload() -> Iterator[bytes]:
        nonlocal buffer
        left = block
        while left > 0:
            if buffer:
                yield buffer[:left]
            left, buffer = left - len(buffer[:left]), buffer[left:]
            if left:
                buffer = next(stream)
        rest = buffer + b"".join(stream)
        if rest != _END:
            raise ValueError(f"record {warc['warc-record-id']} doesn't end where it says")

    return warc, http, payload()


def _page(urn: str | None) -> int | None:
    value = urn[len("<urn:page:") : -1] if urn else "null"
    return None if value == "null" else int(value)


def read_chunks(manifest: DataFrame, size: int = CHUNK, data: bool = True) -> DataFrame:
    """The chunked record table of a manifest's archives: (page_id, chunk_no, data, so_far, digest, record_type, refers_to, url).

    Digest is set on a record's last chunk, and so_far counts to it; a revisit has one chunk, without bytes, with its
    headers' length and digest. A response whose digest isn't its header's fails the read. Without `data` the bytes are null.
    """
    files = manifest.select("file").distinct().count()
    folder = shared_dir(manifest.sparkSession)  # its URI names the file system that the archives' paths are in
    dealt = manifest.repartition(max(1, files), "file").sortWithinPartitions("file", "start")
    schema = pa.schema([("page_id", pa.int64()), ("chunk_no", pa.int32()), ("data", pa.binary()), ("so_far", pa.int64()), ("digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("url", pa.string())])

    def records(it: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        fs, _ = _file_system(folder)
        path, f = None, None
        for b in it:
            for file, start, length in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
                if file != path:
                    if f is not None:
                        f.close()
                    path, f = file, fs.open_input_file(file)
                warc, http, payload = _record(_member(f, start, length, size))
                kind, told, whole = warc["warc-type"], warc["warc-payload-digest"].removeprefix("sha1:"), int(http["content-length"])
                about = {"page_id": _page(warc["warc-record-id"]), "record_type": kind, "refers_to": _page(warc.get("warc-refers-to")), "url": warc.get("warc-target-uri")}
                sha, far, held, n = hashlib.sha1(usedforsecurity=False), 0, b"", 0
                for part in payload:  # a chunk leaves when the next one shows that it isn't the last
                    if n:
                        yield about | {"chunk_no": n - 1, "data": held if data else None, "so_far": far, "digest": None}
                    sha.update(part)
                    far, held, n = far + len(part), part, n + 1
                if kind == "response" and (base32_sha1(sha.digest()) != told or far != whole):
                    raise ValueError(f"record {warc['warc-record-id']} isn't what its digest says")
                yield about | {"chunk_no": max(0, n - 1), "data": held if data else None, "so_far": whole, "digest": told}
        if f is not None:
            f.close()

    def read(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from batches(records(it), schema, 2000, 8 << 20, (lambda r: len(r["data"])) if data else None)

    return dealt.mapInArrow(read, "page_id long, chunk_no int, data binary, so_far long, digest string, record_type string, refers_to long, url string")


def read_archives(manifest: DataFrame, size: int = CHUNK) -> DataFrame:
    """A row a record of a manifest's archives: (page_id, payload_bytes, payload_digest, record_type, refers_to, url).

    Lengths and digests are those carried to each record's last chunk.
    """
    last = read_chunks(manifest, size, data=False).where("digest is not null")
    return last.select("page_id", F.col("so_far").alias("payload_bytes"), F.col("digest").alias("payload_digest"), "record_type", "refers_to", "url")
