"""WARC archives of pages and a two-level capture index over them.

Writing.  Of captures with equal payloads (SHA-1 and size) of at least ``min_bytes``,
the one with the smallest page_id, then URL, is a response and the others are
revisits of it.  Records are gzip members of their own in .warc.gz files of bounded
size.  Index lines (reversed-host URL key, date, JSON) are sorted over all captures,
cut into blocks of ``block_lines`` lines, each a gzip member, and a sparse directory
keeps each block's first key, file, offset and length.

Reading.  ``search`` finds URLs' captures by a binary search of the parts' first keys,
then of one part's directory; a block that several URLs need is read once.
``lookup`` adds range reads of the records, ``read_back`` what they say of their pages.

Rows: a null html is an empty payload; a null URL has an empty key; characters that are
not printable ASCII are percent-encoded in keys, also those of unreadable URLs; a null page_id
comes after all others and is given back as null; rows alike in page_id, URL and
payload are all responses; extra columns are ignored; an empty table gives no record.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import json
import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from functools import lru_cache
from urllib.parse import quote, urlsplit

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fresh_path, materialise
from .store import get, opened, put

_INDEX = "key string, page_id long, url string, file string, offset long, length long, kind string"
_BLOCKS = "part long, first_key string, file string, offset long, length long, lines long"


_PRINTABLE = "".join(map(chr, range(0x21, 0x7F)))


def url_key(url: str | None) -> str:
    """The URL with its host reversed: ``http://a.example.org/x`` is ``org,example,a)/x``.

    A key holds neither spaces nor line ends, whatever the URL holds.
    """
    try:
        at = urlsplit((url or "").strip())
        host, port = at.hostname or "", at.port
    except ValueError:
        return quote(url or "", safe=_PRINTABLE)
    port = f":{port}" if port else ""
    query = f"?{at.query}" if at.query else ""
    return quote(f"{','.join(reversed(host.split('.')))}{port}){at.path or '/'}{query}", safe=_PRINTABLE)


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: str | None, date: str) -> bytes:
    """One WARC record: a response with the payload, or a revisit with the HTTP header alone."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to else http + payload
    target = re.sub(r"[\r\n]", lambda m: f"%{ord(m[0]):02X}", url or "")
    lines = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if refers_to else 'response'}",
        f"WARC-Record-ID: <urn:page:{page_id}>",
        f"WARC-Date: {date}",
        f"WARC-Target-URI: {target}",
        f"WARC-Payload-Digest: sha1:{digest}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if refers_to:
        lines += [
            "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest",
            f"WARC-Refers-To: <urn:page:{refers_to}>",
        ]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(data: bytes) -> tuple[dict[str, str], dict[str, str], bytes]:
    """(WARC header, HTTP header, payload) of one uncompressed record."""
    head, _, rest = data.partition(b"\r\n\r\n")
    fields = lambda x: dict(line.split(": ", 1) for line in x.decode().split("\r\n")[1:])
    header = fields(head)
    block = rest[: int(header["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    return header, fields(http), payload


def _page(urn: str) -> int | None:
    name = urn[len("<urn:page:") : -1]
    return None if name == "None" else int(name)


def write_archives(
    pages: DataFrame, folder: str, min_bytes: int = 0, date: str = "2024-01-01T00:00:00Z", file_bytes: int = 64 << 20
) -> DataFrame:
    """Write all records; one index row for each, in the order of the files."""
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    rows = pages.select(
        F.col("page_id").cast("long").alias("page_id"), "url", payload.alias("payload"), F.sha1(payload).alias("sha")
    ).withColumn("size", F.octet_length("payload").cast("long"))
    rank = F.struct(F.col("page_id").isNull().alias("n"), "page_id", F.coalesce("url", F.lit("")).alias("u"))
    first = rows.groupBy("sha", "size").agg(F.min(rank).alias("first"), F.count("*").alias("n"))
    # written, so that Spark may split a payload with very many copies in the join
    first = materialise(first.where("n > 1").drop("n"), "warc-first")
    other = (F.col("size") >= min_bytes) & (rank != F.col("first"))
    # only revisits are sent to the payloads, and these go by page
    again = rows.select("page_id", "url", "sha", "size").join(first, ["sha", "size"]).where(other)
    again = again.select("page_id", "url", "sha", F.coalesce(F.col("first.page_id").cast("string"), F.lit("None")).alias("ref"))
    again = materialise(again.dropDuplicates(["page_id", "url", "sha"]), "warc-again").alias("again")
    same = F.expr("rows.page_id <=> again.page_id AND rows.url <=> again.url AND rows.sha = again.sha")
    ready = rows.alias("rows").join(again, same, "left").select("rows.page_id", "rows.url", "payload", "rows.sha", "ref")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, number, held, size = TaskContext.get().partitionId(), 0, [], 0
        index = {k: [] for k in ("key", "page_id", "url", "file", "offset", "length", "kind")}
        uri = f"{folder}/pages-{part:06d}-{number:04d}.warc.gz"

        def flush():
            nonlocal number, held, size, index, uri
            put(uri, b"".join(held))
            out = pa.RecordBatch.from_pydict(index, schema=schema)
            number, held, size, index = number + 1, [], 0, {k: [] for k in index}
            uri = f"{folder}/pages-{part:06d}-{number:04d}.warc.gz"
            return out

        for batch in batches:
            for page, url, body, sha, ref in zip(*batch.columns, strict=True):
                page, url, ref = page.as_py(), url.as_py(), ref.as_py()
                digest = base64.b32encode(bytes.fromhex(sha.as_py())).decode()
                member = gzip.compress(record(page, url, body.as_py(), digest, ref, date), 6, mtime=0)
                line = (url_key(url), page, url, uri, size, len(member), "revisit" if ref else "response")
                for k, v in zip(index, line, strict=True):
                    index[k].append(v)
                held.append(member)
                size += len(member)
                if size >= file_bytes:
                    yield flush()
        if held:
            yield flush()

    schema = pa.schema(
        [("key", pa.string()), ("page_id", pa.int64()), ("url", pa.string()), ("file", pa.string())]
        + [("offset", pa.int64()), ("length", pa.int64()), ("kind", pa.string())]
    )
    return materialise(ready.mapInArrow(work, _INDEX), "warc-index")


def write_index(index: DataFrame, folder: str, block_lines: int = 1000) -> DataFrame:
    """Sort the index lines into compressed blocks; the sparse directory of the blocks."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, members, size, lines, rows = TaskContext.get().partitionId(), [], 0, [], []
        uri = f"{folder}/index-{part:06d}.cdx.gz"

        def close():
            nonlocal size, lines
            member = gzip.compress("".join(line for _, line in lines).encode(), 6, mtime=0)
            rows.append((part, lines[0][0], uri, size, len(member), len(lines)))
            members.append(member)
            size, lines = size + len(member), []

        for batch in batches:
            for key, page, url, file, offset, length, kind in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                facts = {"page": page, "url": url, "file": file, "offset": offset, "length": length, "kind": kind}
                lines.append((key, f"{key} 20240101000000 {json.dumps(facts)}\n"))
                if len(lines) == block_lines:
                    close()
        if lines:
            close()
        if rows:
            put(uri, b"".join(members))
            put(f"{folder}/directory-{part:06d}.json", json.dumps([r[1:2] + r[3:5] for r in rows]).encode())
            yield pa.RecordBatch.from_arrays(
                [pa.array(c) for c in zip(*rows, strict=True)], names=["part", "first_key", "file", "offset", "length", "lines"]
            )

    spread = index.repartitionByRange("key", "page_id", "file", "offset")
    ordered = spread.sortWithinPartitions("key", "page_id", "file", "offset")
    return materialise(ordered.mapInArrow(work, _BLOCKS), "warc-directory")


def block_entries(data: bytes) -> list[tuple[str, dict]]:
    """(key, facts) of each line of one compressed block."""
    lines = gzip.decompress(data).decode().split("\n")[:-1]
    return [(key, json.loads(facts)) for key, _, facts in (line.split(" ", 2) for line in lines)]


def search(urls: DataFrame, directory: DataFrame, folder: str) -> DataFrame:
    """(url, page_id, kind, file, offset, length) of all captures of the distinct ``urls(url)``.

    The parts' first keys are as many as the index has parts; each task opens the
    directories of the parts it needs.  Blocks are then dealt out and each read once.
    """
    firsts = [tuple(r) for r in directory.groupBy("part").agg(F.min("first_key")).orderBy("part").collect()]
    blocks = max(1, min(10_000, directory.count()))

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys = [k for _, k in firsts]

        @lru_cache(256)
        def opened_part(part: int) -> tuple[list, list]:
            listed = json.loads(get(f"{folder}/directory-{part:06d}.json"))
            return listed, [x[0] for x in listed]

        for batch in batches:
            out = {"url": [], "part": [], "offset": [], "length": []}
            for url in batch.column(0).to_pylist():
                key = url_key(url)
                for at in range(max(0, bisect_left(keys, key) - 1), bisect_right(keys, key)):
                    listed, starts = opened_part(firsts[at][0])
                    for _, offset, length in listed[max(0, bisect_left(starts, key) - 1) : bisect_right(starts, key)]:
                        for k, v in zip(out, (url, firsts[at][0], offset, length), strict=True):
                            out[k].append(v)
            yield pa.RecordBatch.from_pydict(out, schema=addresses)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, held = None, {}
        for batch in batches:
            out = {k: [] for k in captures.names}
            for url, part, offset, length in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (part, offset) != last:
                    last, held = (part, offset), {}
                    for _, facts in block_entries(get(f"{folder}/index-{part:06d}.cdx.gz", offset, length)):
                        held.setdefault(facts["url"], []).append(facts)
                for facts in held.get(url, ()):
                    for k, v in zip(out, (url, *(facts[x] for x in ("page", "kind", "file", "offset", "length"))), strict=True):
                        out[k].append(v)
            yield pa.RecordBatch.from_pydict(out, schema=captures)

    addresses = pa.schema([("url", pa.string()), ("part", pa.int64()), ("offset", pa.int64()), ("length", pa.int64())])
    captures = pa.schema(
        [("url", pa.string()), ("page_id", pa.int64()), ("kind", pa.string()), ("file", pa.string()), ("offset", pa.int64()), ("length", pa.int64())]
    )
    found = urls.select("url").distinct().mapInArrow(find, "url string, part long, offset long, length long")
    dealt = found.repartition(blocks, "part", "offset").sortWithinPartitions("part", "offset")
    return dealt.mapInArrow(read, "url string, page_id long, kind string, file string, offset long, length long")


def read_back(urls: DataFrame, directory: DataFrame, folder: str) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to of the captures of ``urls(url)``.

    Captures are dealt by archive and read in the order of their offsets.
    """

    def records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, source = None, None
        for batch in batches:
            rows = []
            for uri, offset, length in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if uri != name:
                    filesystem, path = opened(uri)
                    name, source = uri, filesystem.open_input_file(path)
                rows.append(verdict(gzip.decompress(source.read_at(length, offset))))
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)] if rows else [pa.array([], t) for t in kinds],
                names=["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"],
            )

    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()]
    files = max(1, min(10_000, directory.count()))  # blocks stand for the amount of records
    found = search(urls, directory, folder).select("file", "offset", "length")
    dealt = found.repartition(files, "file").sortWithinPartitions("file", "offset")
    return dealt.mapInArrow(
        records, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"
    )


def verdict(data: bytes) -> tuple[int | None, int, str, str, int | None]:
    """What a record says of its page; a response's payload is checked against its digest."""
    header, http, payload = parse(data)
    digest = header["WARC-Payload-Digest"].removeprefix("sha1:")
    size, kind = int(http["Content-Length"]), header["WARC-Type"]
    if kind == "response" and (len(payload), base64.b32encode(hashlib.sha1(payload).digest()).decode()) != (size, digest):
        raise ValueError(f"{header['WARC-Record-ID']}: the payload differs from its digest")
    refers = _page(header["WARC-Refers-To"]) if kind == "revisit" else None
    return _page(header["WARC-Record-ID"]), size, digest, kind, refers


def lookup(urls: DataFrame, directory: DataFrame, folder: str) -> DataFrame:
    """(url, page_id, record_type, record) of all captures of ``urls(url)``."""

    def records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            url, page, kind, *places = batch.columns
            found = [gzip.decompress(get(*x)) for x in zip(*(c.to_pylist() for c in places), strict=True)]
            yield pa.RecordBatch.from_arrays([url, page, kind, pa.array(found, pa.binary())], names=["url", "page_id", "record_type", "record"])

    return search(urls, directory, folder).mapInArrow(records, "url string, page_id long, record_type string, record binary")


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder, pages = fresh_path(spark, "warc"), spark.read.parquet(f"{sf_dir}/pages.parquet")
    return read_back(pages, write_index(write_archives(pages, folder), folder), folder)
