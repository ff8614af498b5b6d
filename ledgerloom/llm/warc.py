"""WARC 1.1 archives: written as monolithic gzip files, normalised to one gzip member a record with a sidecar offset index.

`write_archives` has Spark's own writer make the files, one gzip stream each, so a lost task writes its file anew and nothing
half-written counts. Pages of equal payload (SHA-256; at least `LEAST` bytes) give one response record, that of the smallest
page_id; the others are revisit records that refer to it and hold no payload.

`normalise` inflates each file as one stream, in pieces of bounded size, cuts it into records by their Content-Length, and
writes every record as a gzip member of its own, so that a reader can seek to it. Beside each archive it writes
`<archive>.idx`, a line of JSON for each record; the same rows are the index table it returns. A file that holds several
members, or none (plain WARC), is read as well. The output of a file depends on its bytes alone, and it gets its name once it
is complete, so a task that runs again, or twice, gives the same archive.

`read_archives` seeks to each indexed member, inflates it, parses it and checks payloads against their digests.

Folders are URIs that both Spark and `pyarrow.fs` can open and that all executors share.

Defined cases: a null payload is empty; a null url becomes `about:blank`, white space and control characters in urls are
percent-encoded; rows of equal page_id and payload are records of their own, and no revisit of each other; rows with a null
page_id are always responses; a truncated stream or record raises; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import json
import re
import uuid
import zlib

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, join_hot, prepare, shared_dir, written

LEAST = 100
#: Bytes read at once, and the crawl date that the archives state (the tables have none).
PIECE, DATE = 1 << 20, "2024-01-01T00:00:00Z"
#: Fixed values of the format.
VERSION, PROFILE, SCHEME = "WARC/1.1", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", "urn:page:"

INDEX = "archive string, offset long, length long, record_type string, page_id long, target string, payload_digest string, refers_to long"
_FIELDS = ["archive", "offset", "length", "record_type", "page_id", "target", "payload_digest", "refers_to"]


def _id(page: Column) -> Column:
    return F.concat(F.lit(f"<{SCHEME}"), F.coalesce(page.cast("string"), F.lit("")), F.lit(">"))


def record(page: Column, url: Column, payload: Column, digest: Column, lead: Column, date: str = DATE) -> Column:
    """The text of a record without the two line ends behind it; `lead` is the page that a revisit refers to."""
    again = lead.isNotNull()
    target = F.coalesce(url, F.lit("about:blank"))
    for code in [*range(33), 127]:
        target = F.replace(target, F.lit(chr(code)), F.lit(f"%{code:02X}"))
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.octet_length(payload).cast("string"), F.lit("\r\n\r\n"))
    size = F.octet_length(http).cast("long") + F.when(again, 0).otherwise(F.octet_length(payload))
    kind = F.when(again, F.concat(F.lit(f"revisit\r\nWARC-Profile: {PROFILE}\r\nWARC-Refers-To: "), _id(lead))).otherwise("response")
    head = [F.lit(f"{VERSION}\r\nWARC-Type: "), kind, F.lit("\r\nWARC-Record-ID: "), _id(page), F.lit(f"\r\nWARC-Date: {date}\r\nWARC-Target-URI: "), target]
    head += [F.lit("\r\nWARC-Payload-Digest: sha256:"), digest, F.lit("\r\nContent-Type: application/http;msgtype=response\r\nContent-Length: "), size.cast("string"), F.lit("\r\n\r\n")]
    return F.concat(*head, http, F.when(again, "").otherwise(payload))


def revisits(sized: DataFrame, least: int = LEAST) -> DataFrame:
    """(page_id, digest, lead) of the rows of (page_id, digest, bytes) whose payload a smaller page_id has."""
    long = sized.where((F.col("bytes") >= least) & F.col("page_id").isNotNull())
    leads = cut(long.groupBy("digest").agg(F.min("page_id").alias("lead"), F.count(F.lit(1)).alias("n")).where("n > 1"))
    return join_hot(long.select("page_id", "digest"), leads, ["digest"], "page_id", long.count()).where("page_id <> lead").select("page_id", "digest", "lead").distinct()


def write_archives(pages: DataFrame, folder: str, *, least: int = LEAST, date: str = DATE) -> None:
    """One monolithic gzip WARC file for each task, from (page_id, url, html); payloads move only to meet their verdict."""
    prepare(pages.sparkSession)
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"))
    digest = F.sha2(F.col("html").cast("binary"), 256)
    sized = written(rows.select("page_id", digest.alias("digest"), F.octet_length("html").alias("bytes")))
    known = written(revisits(sized, least))
    met = rows.withColumn("digest", digest).join(known, ["page_id", "digest"], "left")
    met.select(record(F.col("page_id"), F.col("url"), F.col("html"), F.col("digest"), F.col("lead"), date).alias("value")).write.option("compression", "gzip").option("lineSep", "\r\n\r\n").text(folder)


def _open(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(re.sub("^file:/+", "file:///", uri))


def inflated(stream, piece: int = PIECE):
    """The bytes of a gzip file of one or many members, or of a plain file, in pieces."""
    engine, first = None, stream.read(2)
    while data := first + stream.read(piece):
        first = b""
        if engine is None and not data.startswith(b"\x1f\x8b"):
            while data:
                yield data
                data = stream.read(piece)
            return
        engine = engine or zlib.decompressobj(31)
        while data:
            if engine.eof:
                engine = zlib.decompressobj(31)
            out = engine.decompress(data, piece)
            data = engine.unconsumed_tail or engine.unused_data
            if out:
                yield out
    while engine is not None and not engine.eof:
        out = engine.decompress(engine.unconsumed_tail, piece)
        if not out:
            raise ValueError("the gzip stream ends early")
        yield out


def records(pieces):
    """(header fields, whole record with the line ends behind it) of each record of a WARC stream."""
    held, pieces = bytearray(), iter(pieces)

    def more() -> bool:
        data = next(pieces, None)
        if data is not None:
            held.extend(data)
        return data is not None

    while True:
        while len(held) < 4 and more():
            pass
        if not held:
            return
        seen = 0
        while (end := held.find(b"\r\n\r\n", seen)) < 0:
            seen = max(0, len(held) - 3)
            if not more():
                raise ValueError("a WARC record has no end of its header")
        head = header(bytes(held[:end]))
        size = end + 4 + int(head["content-length"]) + 4
        while len(held) < size and more():
            pass
        if len(held) < size or held[size - 4 : size] != b"\r\n\r\n":
            raise ValueError(f"the WARC record {head.get('warc-record-id')} ends early")
        yield head, bytes(held[:size])
        del held[:size]


def header(raw: bytes) -> dict[str, str]:
    """Named fields of a header, by small letters; its first line is the version."""
    first, *lines = raw.decode().split("\r\n")
    if not first.startswith("WARC/"):
        raise ValueError(f"no WARC record: {first[:40]!r}")
    return {k.strip().lower(): v.strip() for k, v in (x.split(":", 1) for x in lines)}


def _page(uri: str | None) -> int | None:
    number = (uri or "").removeprefix(f"<{SCHEME}").removesuffix(">")
    return int(number) if number else None


def _normalised(out_dir: str):
    def run(incoming):
        for b in incoming:
            for path in b.column(0).to_pylist():
                fs, name = _open(path)
                to, root = _open(out_dir)
                # the whole path names it, so that files of one name in two folders don't meet
                final = f"{root}/{hashlib.sha256(path.encode()).hexdigest()[:16]}-{name.rpartition('/')[2].split('.')[0]}.warc.gz"
                part, at, rows = f"{final}.{uuid.uuid4().hex}.part", 0, []
                with fs.open_input_stream(name, compression=None) as stream, to.open_output_stream(part, compression=None) as sink:
                    for head, raw in records(inflated(stream)):
                        engine = zlib.compressobj(6, zlib.DEFLATED, 31)
                        member = engine.compress(raw) + engine.flush()
                        sink.write(member)
                        rows.append((final, at, len(member), head.get("warc-type"), _page(head.get("warc-record-id")), head.get("warc-target-uri"), head.get("warc-payload-digest", "").removeprefix("sha256:") or None, _page(head.get("warc-refers-to"))))
                        at += len(member)
                if not rows:
                    to.delete_file(part)
                    continue
                with to.open_output_stream(f"{part}.idx", compression=None) as sink:
                    for row in rows:
                        sink.write((json.dumps(dict(zip(_FIELDS[1:], row[1:], strict=True))) + "\n").encode())
                to.move(part, final)
                to.move(f"{part}.idx", f"{final}.idx")
                for i in range(0, len(rows), 10_000):
                    cols = zip(*rows[i : i + 10_000], strict=True)
                    kinds = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64()]
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], _FIELDS)

    return run


def normalise(spark: SparkSession, folder: str, out_dir: str) -> DataFrame:
    """Archives of one member a record in `out_dir` for the WARC files of `folder`; the index of all records."""
    prepare(spark)
    to, root = _open(out_dir)
    to.create_dir(root, recursive=True)
    files = spark.read.format("binaryFile").load(folder).where("length > 0").select("path")
    n = files.count()
    return written(files.repartition(max(1, n)).mapInArrow(_normalised(re.sub("^file:/+", "file:///", out_dir)), INDEX))


def _read(scheme: str):
    def run(incoming):
        held, stream = None, None
        for b in incoming:
            rows = []
            for archive, offset, length in zip(*(b.column(k).to_pylist() for k in range(3)), strict=True):
                if archive != held:
                    if stream is not None:
                        stream.close()
                    fs, name = _open(f"{scheme}{archive}")
                    held, stream = archive, fs.open_input_file(name)
                stream.seek(offset)
                head, raw = next(records(inflated(pa.BufferReader(stream.read(length)))))
                body = raw[raw.index(b"\r\n\r\n") + 4 : -4]
                line, _, payload = body.partition(b"\r\n\r\n")
                size = int(re.search(rb"(?i)\r\ncontent-length: *(\d+)", line).group(1))
                digest = head["warc-payload-digest"].removeprefix("sha256:")
                if head["warc-type"] == "response" and (len(payload) != size or hashlib.sha256(payload).hexdigest() != digest):
                    raise ValueError(f"the payload of {head['warc-record-id']} is not the one that was written")
                rows.append((_page(head["warc-record-id"]), head.get("warc-target-uri"), size, digest, head["warc-type"], _page(head.get("warc-refers-to")), payload.decode() if head["warc-type"] == "response" else None))
            if rows:
                cols, kinds = zip(*rows, strict=True), [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], ["page_id", "target", "payload_bytes", "payload_digest", "record_type", "refers_to", "payload"])
        if stream is not None:
            stream.close()

    return run


def read_archives(index: DataFrame, out_dir: str) -> DataFrame:
    """page_id, target, payload_bytes, payload_digest, record_type, refers_to, payload (null in revisits) of each record."""
    scheme = "" if _open(out_dir)[0].type_name == "local" else out_dir.partition("://")[0] + "://"
    places = index.select("archive", "offset", "length").mapInArrow(_read(scheme or "file://"), "page_id long, target string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload string")
    return places


def archived(pages: DataFrame, *, least: int = LEAST) -> DataFrame:
    """Write, normalise and read back all `pages` in the shared folder; the rows that `read_archives` gives."""
    spark = prepare(pages.sparkSession)
    root = f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"
    write_archives(pages, f"{root}/monolithic", least=least)
    index = normalise(spark, f"{root}/monolithic", f"{root}/members")
    fs, path = _open(root)
    fs.delete_dir(f"{path}/monolithic")
    return read_archives(index, f"{root}/members")
