"""Deterministic sharded WARC writer, and its reader.

Records are range-partitioned by page and sorted; each task writes its range as gzip members, one a
record, and rolls to a new file once the compressed size passes `roll_bytes`. Headers and digests are
made anew from the payload; record identifiers follow from page, URL and payload, so the same table and
partitions give the same bytes. A file is written under a temporary name with the task attempt in it and
moved to its final name when complete; it counts only once the manifest, a table that Spark commits as a
whole, lists it with size and SHA-256. The reader opens what the manifest lists, and checks every
file, block and payload digest.

Of records with equal payloads of at least `min_bytes`, that with the largest page is the response and
the others revisit it; smaller payloads are all responses.

Defined results: a null html is an empty payload; a null page sorts first and is never referred to while
an equal payload has a page; rows that repeat the page which is the response are responses too; a null URL
is written as about:blank; a very long html is one record, held once by the task that writes it, and may
make a file larger than `roll_bytes`; other columns aren't read, whatever their names; an empty table gives
no files and an empty result.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.taskcontext import TaskContext

from quillon.llm._common import filesystem, scratch

DATE = "2000-01-01T00:00:00Z"
MANIFEST = "file string, bytes bigint, records bigint, sha256 string"
READ = "page_id bigint, url string, record_type string, payload_bytes bigint, payload_digest string, refers_page bigint, payload binary"


def record_id(page: int | None, url: str | None, sha1: bytes) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page}\0{url}\0{sha1.hex()}')}>"


def _b32(digest: bytes) -> str:
    return "sha1:" + base64.b32encode(digest).decode()


def _header_value(x: str) -> str:
    return re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", x)


def record(page: int | None, url: str | None, payload: bytes, refers: tuple[int, str | None] | None) -> bytes:
    """The bytes of one record before compression."""
    sha1 = hashlib.sha1(payload).digest()
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http + (payload if refers is None else b"")
    lines = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers is None else 'revisit'}",
        f"WARC-Record-ID: {record_id(page, url, sha1)}",
        f"WARC-Date: {DATE}",
        f"WARC-Target-URI: {_header_value(url or 'about:blank')}",
        *([f"X-Page-ID: {page}"] if page is not None else []),
        "Content-Type: application/http;msgtype=response",
        f"Content-Length: {len(block)}",
        f"WARC-Block-Digest: {_b32(hashlib.sha1(block).digest())}",
        f"WARC-Payload-Digest: {_b32(sha1)}",
    ]
    if refers is not None:
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {record_id(refers[0], refers[1], sha1)}", f"X-Refers-To-Page-ID: {refers[0]}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def _gzip(data: bytes) -> bytes:
    return gzip.compress(data, 6, mtime=0)


def _write(root: str, roll_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, base = filesystem(root)
        task = TaskContext.get()
        name = lambda k: f"part-{task.partitionId():06d}-{k:05d}.warc.gz"
        out, k, done, decided = None, 0, [], None

        def close():
            nonlocal out, k
            out["to"].close()
            at.move(out["tmp"], f"{base}/{name(k)}")
            done.append((name(k), out["bytes"], out["records"], out["sha"].hexdigest()))
            out, k = None, k + 1

        for batch in (b.slice(lo, 256) for b in batches for lo in range(0, b.num_rows, 256)):
            for page, url, key, is_page, html, r_page, r_url in zip(*(batch.column(i).to_pylist() for i in range(7)), strict=True):
                if not is_page:
                    decided = (page, url, key), (r_page, r_url)
                    continue
                refers = decided[1] if decided and decided[0] == (page, url, key) else None
                if out is None:
                    at.create_dir(base, recursive=True)
                    tmp = f"{base}/.tmp-{name(k)}-{task.taskAttemptId()}"
                    out = {"tmp": tmp, "to": at.open_output_stream(tmp, compression=None), "bytes": 0, "records": 0, "sha": hashlib.sha256()}
                data = _gzip(record(page, url, html.encode(), refers))
                out["to"].write(data)
                out["sha"].update(data)
                out["bytes"] += len(data)
                out["records"] += 1
                if out["bytes"] >= roll_bytes:
                    close()
        if out is not None:
            close()
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*done, strict=True), (pa.string(), pa.int64(), pa.int64(), pa.string()), strict=True)], names=["file", "bytes", "records", "sha256"])

    return run


def write_warc(pages: DataFrame, root: str, *, page_col: str = "page_id", url_col: str = "url", html_col: str = "html", min_bytes: int = 1000, roll_bytes: int = 16 << 20) -> DataFrame:
    """Writes the archives below `root` (a shared folder) and returns the manifest, read back."""
    html = F.coalesce(F.col(html_col).cast("string"), F.lit(""))
    rows = pages.select(F.col(page_col).cast("bigint").alias("page"), F.col(url_col).cast("string").alias("url"), html.alias("html"))
    # One small row a page decides. The payloads are shuffled once, in the range sort, where the decisions on revisits stand before them.
    keyed = rows.withColumns({"key": F.when(F.octet_length("html") >= min_bytes, F.sha2("html", 256))})
    small = keyed.select("page", "url", "key").where("key IS NOT NULL")
    first = small.where("page IS NOT NULL").groupBy("key").agg(F.max(F.struct("page", "url")).alias("r")).select(F.col("key").alias("r_key"), F.col("r.page").alias("r_page"), F.col("r.url").alias("r_url"))
    revisits = small.join(first, (F.col("key") == F.col("r_key")) & ~F.col("page").eqNullSafe(F.col("r_page"))).select("page", "url", "key", F.lit(False).alias("is_page"), F.lit(None).cast("string").alias("html"), "r_page", "r_url").distinct()
    payloads = keyed.select("page", "url", "key", F.lit(True).alias("is_page"), "html", F.lit(None).cast("bigint").alias("r_page"), F.lit(None).cast("string").alias("r_url"))
    ordered = payloads.unionByName(revisits).repartitionByRange("page", "url").sortWithinPartitions("page", "url", "key", "is_page", "html")
    ordered.mapInArrow(_write(f"{root}/archives", roll_bytes), MANIFEST).write.parquet(f"{root}/manifest")
    return pages.sparkSession.read.schema(MANIFEST).parquet(f"{root}/manifest")


def parse_records(data: Iterator[bytes]) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers and block of each gzip member, from the chunks of one file. Holds one record at a time."""
    buffer, member, plain = b"", zlib.decompressobj(31), []
    for chunk in data:
        buffer += chunk
        while buffer:
            plain.append(member.decompress(buffer))
            buffer = member.unused_data
            if not member.eof:
                break
            whole = b"".join(plain)
            head, block = whole.split(b"\r\n\r\n", 1)
            headers = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
            block = block[:-4]
            if len(block) != int(headers["Content-Length"]) or _b32(hashlib.sha1(block).digest()) != headers["WARC-Block-Digest"]:
                raise ValueError(f"damaged record {headers['WARC-Record-ID']}")
            yield headers, block
            member, plain = zlib.decompressobj(31), []
    if plain:
        raise ValueError("the file ends inside a record")


def _read(root: str, with_payload: bool, chunk: int = 1 << 16):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, base = filesystem(root)
        for batch in batches:
            for name, size, count, sha in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                seen, total, rows, held, n = hashlib.sha256(), 0, [], 0, 0

                def chunks(name=name, seen=seen):
                    nonlocal total
                    with at.open_input_stream(f"{base}/{name}", compression=None) as f:
                        while data := f.read(chunk):
                            seen.update(data)
                            total += len(data)
                            yield data

                def flush():
                    nonlocal rows, held
                    out = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.binary()), strict=True)], names=["page_id", "url", "record_type", "payload_bytes", "payload_digest", "refers_page", "payload"])
                    rows, held = [], 0
                    return out

                for headers, block in parse_records(chunks()):
                    kind, n = headers["WARC-Type"], n + 1
                    http, payload = block.split(b"\r\n\r\n", 1)
                    length = int(re.search(rb"Content-Length: (\d+)", http)[1])
                    if kind == "response" and (_b32(hashlib.sha1(payload).digest()) != headers["WARC-Payload-Digest"] or length != len(payload)):
                        raise ValueError(f"damaged payload {headers['WARC-Record-ID']}")
                    page, refers = headers.get("X-Page-ID"), headers.get("X-Refers-To-Page-ID")
                    rows.append((int(page) if page else None, headers["WARC-Target-URI"], kind, length, base64.b32decode(headers["WARC-Payload-Digest"][5:]).hex(), int(refers) if refers else None, payload if with_payload and kind == "response" else None))
                    held += len(payload) if with_payload else 0
                    if held > 4 << 20 or len(rows) >= 4096:
                        yield flush()
                if rows:
                    yield flush()
                if (total, n, seen.hexdigest()) != (size, count, sha):
                    raise ValueError(f"{name} isn't what the manifest lists")

    return run


def read_warc(spark: SparkSession, root: str, *, with_payload: bool = True) -> DataFrame:
    """The records of all archives in the manifest, their digests checked. A revisit has no payload of its own, and without with_payload none is returned."""
    manifest = spark.read.schema(MANIFEST).parquet(f"{root}/manifest").select("file", "bytes", "records", "sha256")
    # A number of partitions that is given stays: the manifest's few bytes don't tell how much a task reads.
    return manifest.repartition(max(1, manifest.count()), "file").mapInArrow(_read(f"{root}/archives", with_payload), READ)


def round_trip(pages: DataFrame, *, with_payload: bool = True, **options) -> DataFrame:
    """Writes pages to a new set of archives and returns what reading them gives."""
    root = scratch(pages.sparkSession, "warc")
    write_warc(pages, root, **options)
    return read_warc(pages.sparkSession, root, with_payload=with_payload)
