"""WARC archives: writing, normalising monolithic gzip streams, reading by offset.

Archives that are one gzip stream as a whole can only be read from their start. The
normaliser inflates such a stream once, writes every record as a gzip member of its
own and a sidecar index of offsets beside the archive, from which any record is read
without the others. Records whose payload another record has already are rewritten
as revisits that refer to it. Files are written under a temporary name and renamed,
so a task that is run again after a lost executor replaces what it wrote before.
"""

from __future__ import annotations

import gzip
import hashlib
import io
import json
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logspark.llm.shared import land, new_folder

#: Inflated bytes after which a new archive is begun.
ARCHIVE_BYTES = 1 << 28
#: Payloads at least this long are stored once.
REVISIT_BYTES = 1000
CHUNK = 1 << 20
RAW_LEVEL, LEVEL = 1, 6
_DATE = "1970-01-01T00:00:00Z"
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
MANIFEST = "archive string, record long, page_id long, url string, payload_bytes long, payload_digest string"
INDEX = "archive string, offset long, length long, record long, record_id string, record_type string, payload_digest string"
RECORDS = ("record_id string, record_type string, url string, payload_bytes long, payload_digest string, "
           "refers_to string, payload binary")


def _opened(path: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a path or URI, and the path in it."""
    if path.startswith("file:/") and not path.startswith("file://"):
        path = "file://" + path[5:]
    return pafs.FileSystem.from_uri(path)


class _Output:
    """A file that appears under its name once it is complete."""

    def __init__(self, path: str):
        self.fs, self.path = _opened(path)
        self.fs.create_dir(self.path.rpartition("/")[0], recursive=True)
        self.temporary = f"{self.path}.{uuid.uuid4().hex}"
        self.stream = self.fs.open_output_stream(self.temporary, compression=None)

    def publish(self) -> None:
        self.stream.close()
        self.fs.move(self.temporary, self.path)


def record_id(page_id: int | None, archive: str, record: int) -> str:
    """The id of a page's record; a page without an id is named by its place."""
    return f"<urn:page:{page_id}>" if page_id is not None else f"<urn:record:{archive.rpartition('/')[2]}:{record}>"


def page_of(name: str | None) -> int | None:
    """The page that a record id names."""
    return int(name[10:-1]) if name and name.startswith("<urn:page:") else None


def _http(payload_bytes: int) -> bytes:
    return f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {payload_bytes}\r\n\r\n".encode()


def _record(headers: dict[str, str], block: bytes) -> bytes:
    head = "".join(f"{k}: {v}\r\n" for k, v in headers.items())
    return b"WARC/1.1\r\n" + head.encode() + f"Content-Length: {len(block)}\r\n\r\n".encode() + block + b"\r\n\r\n"


def _uri(url: str | None) -> str:
    return "".join((url or "about:blank").split())


def write_archives(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html",
                   archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Writes a response record for every page into archives that are one gzip stream each.

    Returns the manifest, one row a record. A null page has an empty payload.
    """
    rows = pages.select(F.col(id_col).cast("long"), F.col(url_col).cast("string"), F.col(html_col).cast("string"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, number, out, size, path, record = TaskContext.get().partitionId(), 0, None, 0, "", 0
        for batch in batches:
            listed = []
            for page_id, url, html in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if out is None:
                    path = f"{folder}/raw-{part:06d}-{number:04d}.warc.gz"
                    out, packer, size, record = _Output(path), zlib.compressobj(RAW_LEVEL, wbits=31), 0, 0
                payload = (html or "").encode("utf-8", "replace")
                digest = hashlib.sha1(payload).hexdigest()
                block = _http(len(payload)) + payload
                data = _record({"WARC-Type": "response", "WARC-Record-ID": record_id(page_id, path, record),
                                "WARC-Date": _DATE, "WARC-Target-URI": _uri(url), "WARC-Payload-Digest": f"sha1:{digest}",
                                "Content-Type": "application/http; msgtype=response"}, block)
                out.stream.write(packer.compress(data))
                listed.append((path, record, page_id, url, len(payload), digest))
                record, size = record + 1, size + len(data)
                if size >= archive_bytes:
                    out.stream.write(packer.flush())
                    out.publish()
                    out, number = None, number + 1
            if listed:
                kinds = (pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*listed, strict=True), kinds, strict=True)],
                                                 ["archive", "record", "page_id", "url", "payload_bytes", "payload_digest"])
        if out is not None:
            out.stream.write(packer.flush())
            out.publish()

    return land(rows.mapInArrow(run, MANIFEST), "warc-manifest")


def find_revisits(manifest: DataFrame, least_bytes: int = REVISIT_BYTES) -> DataFrame:
    """(archive, record, refers_to) of the records whose payload another page keeps.

    Of equal payloads of at least ``least_bytes`` the record with the largest page_id
    is kept, of repeated rows of that page all. Records without a page_id are never
    kept while another has one. The group table has a row a payload and is joined
    back by the payload's digest, where Spark splits what a hot payload gathers.
    """
    kept = manifest.where(F.col("payload_bytes") >= least_bytes).groupBy("payload_digest", "payload_bytes").agg(
        F.max("page_id").alias("refers_to"), F.max_by("url", "page_id").alias("refers_url"), F.count("*").alias("n"))
    kept = land(kept.where("n > 1 AND refers_to IS NOT NULL"), "warc-kept")
    return manifest.join(kept, ["payload_digest", "payload_bytes"]).where(
        ~F.col("page_id").eqNullSafe(F.col("refers_to"))).select("archive", "record", "refers_to", "refers_url")


def _records(stream) -> Iterator[tuple[dict[str, str], bytes]]:
    """The records of an inflated stream: headers by lower-case name, and the block."""
    while True:
        line = stream.readline()
        if not line:
            return
        if not line.strip():
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError(f"no WARC record begins with {line[:40]!r}")
        headers: dict[str, str] = {}
        while (line := stream.readline()).strip():
            name, _, value = line.decode("utf-8", "replace").partition(":")
            headers[name.strip().lower()] = value.strip()
        length = int(headers["content-length"])
        block = stream.read(length)
        if len(block) < length:
            raise ValueError(f"record {headers.get('warc-record-id')} is cut off")
        yield headers, block


_NAMES = {"warc-type": "WARC-Type", "warc-record-id": "WARC-Record-ID", "warc-date": "WARC-Date",
          "warc-target-uri": "WARC-Target-URI", "warc-payload-digest": "WARC-Payload-Digest", "content-type": "Content-Type"}


def normalise(archives: DataFrame, revisits: DataFrame, folder: str) -> DataFrame:
    """Rewrites archives that are one gzip stream, and returns the index of the new ones.

    ``archives`` (archive), ``revisits`` as of :func:`find_revisits`. Every archive is
    inflated once, record by record; the new one lies in ``folder`` under its old name
    with the index as JSON lines beside it. A stream that is cut off or holds something
    else raises ``ValueError``.
    """
    wanted = revisits.groupBy("archive").agg(F.collect_list(F.struct("record", "refers_to", "refers_url")).alias("revisits"))
    work = land(archives.select("archive").distinct().join(wanted, "archive", "left"), "warc-work")
    tasks = max(1, work.count())  # rows are small and the work behind them is not, so each gets a task

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for archive, found in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                refers = {r["record"]: r for r in found or []}
                fs, path = _opened(archive)
                target = f"{folder}/{archive.rpartition('/')[2]}"
                out, sidecar, at, listed = _Output(target), _Output(target + ".idx"), 0, []
                with fs.open_input_stream(path, compression=None, buffer_size=CHUNK) as raw:
                    stream = io.BufferedReader(gzip.GzipFile(fileobj=raw, mode="rb"), CHUNK)
                    for i, (headers, block) in enumerate(_records(stream)):
                        new = {_NAMES.get(k, k): v for k, v in headers.items() if k != "content-length"}
                        if i in refers:
                            new["WARC-Type"] = "revisit"
                            new["WARC-Profile"] = _PROFILE
                            new["WARC-Refers-To"] = record_id(refers[i]["refers_to"], archive, i)
                            new["WARC-Refers-To-Target-URI"] = _uri(refers[i]["refers_url"])
                            block = block[:block.index(b"\r\n\r\n") + 4]
                        packer = zlib.compressobj(LEVEL, wbits=31)
                        member = packer.compress(_record(new, block)) + packer.flush()
                        out.stream.write(member)
                        row = (target, at, len(member), i, new["WARC-Record-ID"], new["WARC-Type"],
                               new.get("WARC-Payload-Digest", "").removeprefix("sha1:"))
                        sidecar.stream.write((json.dumps(dict(zip(
                            ("archive", "offset", "length", "record", "record_id", "record_type", "payload_digest"),
                            row, strict=True))) + "\n").encode())
                        at += len(member)
                        listed.append(row)
                out.publish()
                sidecar.publish()
                if listed:
                    kinds = (pa.string(), *[pa.int64()] * 3, *[pa.string()] * 3)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(c, k) for c, k in zip(zip(*listed, strict=True), kinds, strict=True)],
                        ["archive", "offset", "length", "record", "record_id", "record_type", "payload_digest"])

    return land(work.repartition(tasks).mapInArrow(run, INDEX), "warc-index")


def read_records(index: DataFrame, with_payload: bool = True) -> DataFrame:
    """The records that an index lists, each inflated from its own member.

    Length and digest of a response are those of the payload read. A revisit has no
    payload; its digest is in its header and its length in the HTTP header it keeps.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, file = None, None
        for batch in batches:
            out = []
            for archive, offset, length in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if archive != held:
                    fs, path = _opened(archive)
                    file, held = fs.open_input_file(path), archive
                data = zlib.decompress(file.read_at(length, offset), wbits=31)
                (headers, block), = _records(io.BytesIO(data))
                http, _, payload = block.partition(b"\r\n\r\n")
                kind, refers = headers["warc-type"], headers.get("warc-refers-to")
                digest, size = hashlib.sha1(payload).hexdigest(), len(payload)
                if kind == "revisit":
                    digest = headers["warc-payload-digest"].removeprefix("sha1:")
                    size = int(http.lower().rpartition(b"content-length:")[2].split(b"\r\n")[0])
                out.append((headers["warc-record-id"], kind, headers.get("warc-target-uri"), size, digest, refers,
                            payload if with_payload and kind != "revisit" else None))
            if out:
                kinds = (pa.string(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.binary())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)],
                    ["record_id", "record_type", "url", "payload_bytes", "payload_digest", "refers_to", "payload"])

    return index.select("archive", "offset", "length").mapInArrow(run, RECORDS)


def archive_pages(pages: DataFrame, folder: str | None = None, **options) -> DataFrame:
    """Writes ``pages`` to archives, normalises them, and returns the index of the new archives."""
    folder = folder or new_folder(pages.sparkSession, "warc")
    manifest = write_archives(pages, f"{folder}/raw", **options)
    return normalise(manifest.select("archive"), find_revisits(manifest), f"{folder}/archives")
