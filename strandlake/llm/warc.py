"""WARC archives: written as one gzip stream a file, normalised to a member per record with a sidecar index, and read back."""

from __future__ import annotations

import base64
import gzip
import hashlib
import json
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandlake.llm.common import _run_dir, cut

#: Payload bytes of an archive before the next one is begun; bytes inflated at a time.
ROLL, READ = 64 << 20, 1 << 20
DATE = "2024-01-01T00:00:00Z"
RECORDS = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, archive string, offset long, length long"


def _place(uri: str) -> tuple:
    """Store and path of a URI, in any store that pyarrow knows; file:/x and plain paths are local."""
    from pyarrow import fs

    if uri.startswith("file:") or "://" not in uri:
        return fs.LocalFileSystem(), "/" + uri.removeprefix("file:").lstrip("/")
    return fs.FileSystem.from_uri(uri)


def _open(uri: str, mode: str):
    store, path = _place(uri)
    if mode == "w":
        store.create_dir(path.rpartition("/")[0], recursive=True)
        return store.open_output_stream(path, compression=None)
    return store.open_input_stream(path, compression=None)


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, name: str, refers_to: int | None = None, target: str | None = None) -> bytes:
    """One WARC/1.1 record named name; a revisit (refers_to: a page, target: its record, if that has one name) has no payload of its own."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
    revisit = refers_to is not None
    body = http if revisit else http + payload
    head = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: <{name}>",
        f"WARC-Date: {DATE}",
        f"WARC-Target-URI: {(url or '').replace(chr(13), ' ').replace(chr(10), ' ')}",
        f"WARC-Payload-Digest: sha1:{base64.b32encode(bytes.fromhex(digest)).decode()}",
        f"WARC-Payload-Length: {len(payload)}",
        *(["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"Refers-To-Page: {refers_to}"] if revisit else []),
        *([f"WARC-Refers-To: <{target}>"] if target else []),
        *([f"Page-ID: {page_id}"] if page_id is not None else []),
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(body)}",
    ]
    return "\r\n".join(head).encode("utf-8", "surrogatepass") + b"\r\n\r\n" + body + b"\r\n\r\n"


def _write(folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = zipped = uri = own = None
        size = count = 0
        paths, counts = [], []

        def end() -> None:
            nonlocal out
            if out is not None:
                zipped.close()
                out.close()
                paths.append(uri)
                counts.append(count)
                out = None

        for batch in batches:
            ids, urls, html, last, many, last_many = (batch.column(c) for c in ("page_id", "url", "html", "last", "many", "last_many"))
            for i in range(batch.num_rows):
                payload = (html[i].as_py() or "").encode("utf-8", "surrogatepass")
                page, ref, digest = ids[i].as_py(), last[i].as_py(), batch.column("digest")[i].as_py()
                if out is None:
                    # a retried task writes files of its own; only those named by the task that ends well are read
                    own, size, count = uuid.uuid4().hex, 0, 0
                    uri = f"{folder}/{own}.warc.gz"
                    out = _open(uri, "w")
                    zipped = gzip.GzipFile(fileobj=out, mode="wb", compresslevel=5, mtime=0)
                # a page that comes once names its record; others, and pages without id, by their place in the archive
                name = f"urn:page:{page}" if page is not None and not many[i].as_py() else f"urn:archive:{own}:{count}"
                revisit = ref is not None and ref != page
                target = f"urn:page:{ref}" if revisit and not last_many[i].as_py() else None
                zipped.write(record(page, urls[i].as_py(), payload, digest, name, ref if revisit else None, target))
                size, count = size + len(payload), count + 1
                if size >= ROLL:
                    end()
        end()
        if paths:
            yield pa.RecordBatch.from_arrays([pa.array(paths), pa.array(counts, pa.int64())], names=["path", "records"])

    return run


def inflated(stream) -> Iterator[bytes]:
    """The bytes of a gzip file of one member or many, block by block, inflated once."""
    z = zlib.decompressobj(31)
    while block := stream.read(READ):
        while block:
            if data := z.decompress(block):
                yield data
            block = z.unused_data
            if z.eof:
                z = zlib.decompressobj(31)
            elif not block:
                break
    if tail := z.flush():
        yield tail


def records(blocks: Iterator[bytes]) -> Iterator[bytes]:
    """Whole records, one at a time, by their Content-Length."""
    held, need = bytearray(), None
    for block in blocks:
        held += block
        while True:
            if need is None and (at := held.find(b"\r\n\r\n")) >= 0:
                need = at + 4 + int(next(x for x in bytes(held[:at]).split(b"\r\n") if x.lower().startswith(b"content-length:"))[15:]) + 4
            if need is None or len(held) < need:
                break
            yield bytes(held[:need])
            del held[:need]
            need = None
    if held.strip():
        raise ValueError("a record is cut off")


def parsed(rec: bytes) -> dict:
    """The headers of a record and the payload behind its HTTP headers."""
    head, _, body = rec.partition(b"\r\n\r\n")
    fields = dict(x.split(": ", 1) for x in head.decode("utf-8", "surrogatepass").split("\r\n")[1:])
    fields["payload"] = body[: int(fields["Content-Length"])].partition(b"\r\n\r\n")[2]
    return fields


def _number(text: str | None) -> int | None:
    return None if text is None else int(text)


def _normalise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rewrite each archive with a member per record beside it, with an index of offsets, and say what each record is."""
    for batch in batches:
        for path, expected in zip(batch.column("path").to_pylist(), batch.column("records").to_pylist()):
            target = path.removesuffix(".warc.gz") + f"-{uuid.uuid4().hex[:8]}.members.warc.gz"
            cols: list[list] = [[] for _ in range(8)]
            offset = 0
            with _open(path, "r") as source, _open(target, "w") as out, _open(target + ".idx", "w") as index:
                for rec in records(inflated(source)):
                    member = gzip.compress(rec, 5, mtime=0)
                    out.write(member)
                    f = parsed(rec)
                    digest = base64.b32decode(f["WARC-Payload-Digest"].removeprefix("sha1:")).hex()
                    if f["WARC-Type"] == "response" and hashlib.sha1(f["payload"]).hexdigest() != digest:
                        raise ValueError(f"{path}: a payload differs from its digest")
                    page, ref = _number(f.get("Page-ID")), _number(f.get("Refers-To-Page"))
                    index.write((json.dumps({"page_id": page, "offset": offset, "length": len(member), "digest": digest}) + "\n").encode())
                    for c, v in zip(cols, (page, int(f["WARC-Payload-Length"]), digest, f["WARC-Type"], ref, target, offset, len(member))):
                        c.append(v)
                    offset += len(member)
            if len(cols[0]) != expected:
                raise ValueError(f"{path}: {len(cols[0])} of {expected} records")
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)], names=[x.split()[0] for x in RECORDS.split(", ")])


def read_member(archive: str, offset: int, length: int) -> bytes:
    """One record of a normalised archive, by its index entry alone."""
    store, path = _place(archive)
    with store.open_input_file(path) as f:
        return gzip.decompress(f.read_at(length, offset))


def normalise(archives: DataFrame) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to, archive, offset, length of every record of archives.

    archives: path, records. Each gzip stream is inflated once, block by block; a truncated one fails.
    """
    n = int(archives.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return archives.select("path", "records").repartition(n, "path").mapInArrow(_normalise, RECORDS)


def write_archives(pages: DataFrame, folder: str, least: int = 1000) -> DataFrame:
    """path, records of the archives written to folder: a record per row of pages (page_id, url, html).

    Of the rows with equal payloads of `least` bytes or more, that with the largest page_id is a response and the others
    revisit it; all else are responses. A null html is empty; a row without page_id is never revisited, and revisits where
    another has its payload; rows repeated with the largest page_id are all responses; no rows give no archives. Every record
    has a name of its own: by its page where that comes once in pages, else by its place in an archive. A revisit names the
    page that it refers to, and that page's record where it has one only.
    """
    payload = F.coalesce("html", F.lit("")).cast("binary")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), "html", F.sha1(payload).alias("digest"), F.octet_length(payload).alias("size"))
    # written first, so that the joins' sides are plain shuffles and a crowded digest's or page's rows can be split
    often = cut(rows.where("page_id is not null").groupBy("page_id").count().where("count > 1").select("page_id", F.lit(True).alias("many")))
    groups = rows.where(F.col("size") >= least).groupBy("digest").agg(F.count("*").alias("n"), F.max("page_id").alias("last")).where("n > 1")
    groups = cut(groups.join(often.select(F.col("page_id").alias("last"), F.col("many").alias("last_many")), "last", "left").select("digest", "last", F.coalesce("last_many", F.lit(False)).alias("last_many")))
    marked = rows.join(groups, "digest", "left").join(often, "page_id", "left")
    marked = marked.select("page_id", "url", "html", "digest", F.when(F.col("size") >= least, F.col("last")).alias("last"), F.coalesce("many", F.lit(False)).alias("many"), "last_many")
    return cut(marked.mapInArrow(_write(folder), "path string, records long"))


def round_trip(pages: DataFrame, least: int = 1000) -> DataFrame:
    """Write pages to archives in the shared folder, normalise them once, and return what the records say; see write_archives().

    Archives and records go with the application.
    """
    folder = f"{_run_dir(pages.sparkSession)}/warc-{uuid.uuid4().hex}"
    return cut(normalise(write_archives(pages, folder, least)))
