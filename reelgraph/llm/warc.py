"""WARC archives: written one gzip member a record, read back sequentially with framing and digest checks."""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reelgraph.llm.common import arrow_batches, saved, shared_path

ARCHIVE_BYTES = 64 << 20  # an archive is closed once it has so many compressed bytes
READ_BYTES = 1 << 20  # compressed bytes taken from an archive at once
#: Fixed value: how revisit records say that they are known by their payload digest.
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

MANIFEST = "path string, records long, bytes long"
RECORDS = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary"


def _filesystem(url: str) -> tuple[pa.fs.FileSystem, str]:
    if "://" not in url and not url.startswith("file:"):
        return pa.fs.LocalFileSystem(), url
    return pa.fs.FileSystem.from_uri("file://" + url[5:] if url.startswith("file:/") and not url.startswith("file://") else url)


def digest_of(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_id(page: int | None) -> str:
    """An id that the page number can be read from: <urn:uuid:...> with the number as the UUID's value, 2^64 for none."""
    return f"<urn:uuid:{uuid.UUID(int=(1 << 64) if page is None else page & (1 << 64) - 1)}>"


def page_of(identifier: str) -> int | None:
    value = uuid.UUID(identifier.strip("<>").removeprefix("urn:uuid:")).int
    return None if value >> 64 else value - (1 << 64) if value >> 63 else value


def record(page: int | None, url: str | None, payload: bytes, digest: str, response: int | None) -> bytes:
    """One record; ``response``: the page that a revisit refers to, which then stands without its payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if response is not None else http + payload
    target = "".join(c for c in url or "" if c.isprintable())
    fields = [
        ("WARC-Type", "response" if response is None else "revisit"),
        ("WARC-Record-ID", record_id(page)),
        ("WARC-Target-URI", target),
        ("WARC-Date", "1970-01-01T00:00:00Z"),
        ("WARC-Payload-Digest", f"sha1:{digest}"),
        ("WARC-Block-Digest", f"sha1:{digest_of(block)}"),
        *([] if response is None else [("WARC-Refers-To", record_id(response)), ("WARC-Profile", PROFILE)]),
        ("Content-Type", "application/http; msgtype=response"),
        ("Content-Length", str(len(block))),
    ]
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields) + "\r\n"
    return head.encode() + block + b"\r\n\r\n"


def member(data: bytes) -> bytes:
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress(data) + packer.flush()


def write_archives(pages: DataFrame, folder: str) -> DataFrame:
    """Write ``pages`` (page_id, url, payload, digest, response) as archives; the written (path, records, bytes).

    A task writes under a name of its own attempt and renames each finished archive, so that of a repeated task only
    whole archives with the same names remain.
    """

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fs, root = _filesystem(folder)
        context, done, out, n, size = TaskContext.get(), [], None, 0, 0
        draft = f"{root}/.draft-{context.partitionId()}-{context.taskAttemptId()}"

        def close():
            out.close()
            name = f"part-{context.partitionId():05d}-{len(done):04d}.warc.gz"
            fs.move(draft, f"{root}/{name}")
            done.append((f"{folder}/{name}", n, size))

        for batch in batches:
            for row in batch.itertuples(index=False):
                if out is None:
                    out, n, size = fs.open_output_stream(draft), 0, 0
                page = None if pd.isna(row.page_id) else int(row.page_id)
                response = None if pd.isna(row.response) else int(row.response)
                data = member(record(page, row.url, row.payload or b"", row.digest, response))
                out.write(data)
                n, size = n + 1, size + len(data)
                if size >= ARCHIVE_BYTES:
                    close()
                    out = None
        if out is not None:
            close()
        yield pd.DataFrame(done, columns=["path", "records", "bytes"])

    fs, root = _filesystem(folder)
    fs.create_dir(root, recursive=True)
    with arrow_batches(pages.sparkSession, 512):
        return saved(pages.mapInPandas(write, MANIFEST), "warc-manifest")


class Stream:
    """The decompressed bytes of one archive, member by member, without holding more than a record and one read."""

    def __init__(self, source):
        self.source, self.raw, self.plain = source, b"", bytearray()
        self.unpack = None

    def start(self) -> bool:
        """Begin the next member; False at the end of the archive."""
        if not self.raw:
            self.raw = self.source.read(READ_BYTES)
        self.unpack = zlib.decompressobj(31)
        return bool(self.raw)

    def more(self) -> None:
        if self.unpack.eof:
            raise ValueError("a record is longer than its gzip member")
        if not self.raw:
            self.raw = self.source.read(READ_BYTES)
            if not self.raw:
                raise ValueError("the archive ends within a record")
        self.plain += self.unpack.decompress(self.raw, READ_BYTES)
        self.raw = self.unpack.unconsumed_tail or self.unpack.unused_data

    def until(self, mark: bytes) -> bytes:
        seen = 0
        while (at := self.plain.find(mark, max(0, seen - len(mark)))) < 0:
            seen = len(self.plain)
            self.more()
        return self.take(at + len(mark))

    def take(self, n: int) -> bytes:
        while len(self.plain) < n:
            self.more()
        out = bytes(self.plain[:n])
        del self.plain[:n]
        return out

    def finish(self) -> None:
        """The member ends where the record does."""
        while not self.unpack.eof and not self.plain:
            self.more()
        if self.plain:
            raise ValueError("a gzip member holds more than its record")


def records(source) -> Iterator[tuple]:
    """Rows of RECORDS from one open archive; wrong framing or a wrong digest is an error."""
    stream = Stream(source)
    while stream.start():
        lines = stream.until(b"\r\n\r\n").decode().split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise ValueError(f"no WARC version line: {lines[0][:40]!r}")
        head = dict(x.split(": ", 1) for x in lines[1:] if x)
        block = stream.take(int(head["Content-Length"]))
        if stream.take(4) != b"\r\n\r\n":
            raise ValueError("a record does not end where its length says")
        stream.finish()
        if head["WARC-Block-Digest"] != f"sha1:{digest_of(block)}":
            raise ValueError(f"the block of {head['WARC-Record-ID']} differs from its digest")
        http, _, payload = block.partition(b"\r\n\r\n")
        length = int(dict(x.split(": ", 1) for x in http.decode().split("\r\n")[1:])["Content-Length"])
        digest, kind = head["WARC-Payload-Digest"].removeprefix("sha1:"), head["WARC-Type"]
        if kind == "response" and (len(payload) != length or digest_of(payload) != digest):
            raise ValueError(f"the payload of {head['WARC-Record-ID']} differs from its digest")
        target = head["WARC-Target-URI"] or None
        refers = page_of(head["WARC-Refers-To"]) if kind == "revisit" else None
        yield page_of(head["WARC-Record-ID"]), target, length, digest, kind, refers, payload if kind == "response" else None


def read_archives(manifest: DataFrame, payloads: bool = True) -> DataFrame:
    """The records of all archives in ``manifest`` (path), one archive a task at a time."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [x.split()[0] for x in RECORDS.split(", ")]
        for path in (p for batch in batches for p in batch["path"]):
            fs, name = _filesystem(path)
            rows, held = [], 0
            with fs.open_input_stream(name, compression=None) as source:
                for row in records(source):
                    rows.append(row if payloads else (*row[:-1], None))
                    held += 200 + (len(row[-1] or b"") if payloads else 0)
                    if held > 8 << 20:
                        yield _frame(rows, names)
                        rows, held = [], 0
            if rows:
                yield _frame(rows, names)

    n = max(1, manifest.count())
    return manifest.select("path").repartition(n).mapInPandas(read, RECORDS)


def _frame(rows: list[tuple], names: list[str]) -> pd.DataFrame:
    frame = pd.DataFrame(rows, columns=names)
    for c in ("page_id", "refers_to"):
        frame[c] = frame[c].astype("Int64")
    return frame


def with_responses(pages: DataFrame) -> DataFrame:
    """``pages`` (page_id, url, payload) with the payload's digest and, for a revisit, the page that it refers to.

    Of equal payloads the largest page number is the response. Only digests with several pages take part in the join.
    """
    b32 = F.udf(lambda h: base64.b32encode(bytes.fromhex(h)).decode(), "string")
    pages = pages.withColumn("sha", F.sha1("payload"))
    shared = pages.groupBy("sha").agg(F.max("page_id").alias("last"), F.count("*").alias("n")).filter("n > 1")
    revisit = F.when(F.col("page_id").isNull() | (F.col("page_id") < F.col("last")), F.col("last"))
    joined = pages.join(shared.select("sha", "last"), "sha", "left")
    return joined.select("page_id", "url", "payload", b32("sha").alias("digest"), revisit.alias("response"))


def archive(
    pages: DataFrame, folder: str, *, id_col: str = "page_id", url_col: str = "url", body_col: str = "html"
) -> DataFrame:
    """Write every page as a WARC record below ``folder``; the manifest of the archives.

    A null body is an empty payload. A null page number refers to the numbered page of equal payload if there is one and
    is a response else. Repeated rows with the largest number are responses each. An empty table writes no archive.
    Other columns are ignored, whatever their names.
    """
    chosen = pages.select(
        F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"),
        F.coalesce(F.col(body_col).cast("binary"), F.lit(b"")).alias("payload"),
    )
    return write_archives(with_responses(chosen), folder)


def round_trip(pages: DataFrame, spark: SparkSession | None = None) -> DataFrame:
    """Archive ``pages`` in the shared folder and read the archives back, without the payloads."""
    spark = spark or pages.sparkSession
    back = read_archives(archive(pages, shared_path(spark, "warc")), payloads=False)
    return back.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
