"""WARC records in ZIP-packaged archives, written and read by Spark tasks.

An archive is a ZIP file with stored members: archive/data.warc.gz (each record a gzip member of its own) and indexes/index.cdxj
(a line for each record: its place in the other). A reader parses the ZIP directory of every archive, finds both members, makes
ranges of neighbouring records from the index, and deals these ranges, some megabytes each, to all tasks, which read them from the
stored member in place. Archives are opened with pyarrow's file systems: mounted folders, hdfs, s3, gs.
"""

from __future__ import annotations

import base64
import contextlib
import hashlib
import json
import re
import zipfile
import zlib
from collections.abc import Iterable, Iterator
from datetime import UTC, datetime
from urllib.parse import quote

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tablewright.llm import zipped
from tablewright.session import checkpointed, partitions_hint, ship_package

#: Digests of repeated payloads that are sent to all tasks at most, some 80 bytes each; more of them are joined by a shuffle.
SENT_DIGESTS = 200_000
ARCHIVE_BYTES = 64 << 20
RANGE_BYTES = 4 << 20
BATCH_BYTES = 8 << 20
PIECE = 1 << 20
DATA, INDEX = "archive/data.warc.gz", "indexes/index.cdxj"
PAGE = "urn:tablewright:page:"
#: The profile of records that repeat a payload, a fixed value of the WARC format.
SAME_PAYLOAD = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

RECORD = "archive string, member string, offset bigint, length bigint, record_type string, record_id string, target_uri string, date string, refers_to string, payload_bytes bigint, payload_digest string, intact boolean"
RANGES = "archive string, member string, start bigint, at bigint, lengths array<bigint>"


def _store(path: str):  # noqa: ANN202
    """File system and path in it."""
    from pyarrow import fs

    if re.match(r"file:/+", path):
        path = re.sub(r"^file:/+", "/", path)
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


# ---- records


def _line(value: str) -> str:
    """A header's value: characters that could end it are percent-encoded."""
    return re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", value)


def _page_uri(page: str | None) -> str:
    return PAGE + quote(page or "", safe="")


def record_bytes(kind: str, fields: list[tuple[str, str]], block: bytes) -> bytes:
    lines = [("WARC-Type", kind), *fields, ("Content-Length", str(len(block)))]
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in lines).encode() + b"\r\n" + block + b"\r\n\r\n"


def _http_head(size: int) -> bytes:
    return f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()


def page_record(page: str | None, url: str | None, payload: bytes, refers_to: str | None, date: str) -> bytes:
    """A response, or without its payload a revisit of the page `refers_to`."""
    digest = "sha1:" + base64.b32encode(hashlib.sha1(payload).digest()).decode()
    fields = [("WARC-Record-ID", f"<{_page_uri(page)}>"), ("WARC-Date", date), ("WARC-Payload-Digest", digest), ("Content-Type", "application/http;msgtype=response")]
    if url is not None:
        fields.append(("WARC-Target-URI", _line(url)))
    if refers_to is None:
        return record_bytes("response", fields, _http_head(len(payload)) + payload)
    return record_bytes("revisit", [*fields, ("WARC-Profile", SAME_PAYLOAD), ("WARC-Refers-To", f"<{_page_uri(refers_to)}>")], _http_head(len(payload)))


def _headers(lines: list[bytes]) -> dict[str, str]:
    """Fields by lower-case name; a line that begins with white space goes on with the field before."""
    found: dict[str, str] = {}
    last = ""
    for line in lines:
        text = line.decode("utf-8", "replace")
        if text[:1] in (" ", "\t") and last:
            found[last] += " " + text.strip()
        elif ":" in text:
            name, _, value = text.partition(":")
            last = name.strip().lower()
            found[last] = value.strip()
    return found


def _split(data: bytes) -> tuple[dict[str, str], bytes]:
    head, _, rest = data.partition(b"\r\n\r\n")
    return _headers(head.split(b"\r\n")[1:]), rest


def _declared(digest: str) -> str | None:
    """Lower-case hex of a digest field that holds a SHA-1 in base 32 or 16."""
    name, _, value = digest.partition(":")
    if name.lower() != "sha1":
        return None
    with contextlib.suppress(ValueError):
        return (bytes.fromhex(value) if len(value) == 40 else base64.b32decode(value)).hex()
    return None


def parsed(data: bytes) -> tuple[dict, bytes]:
    """Columns of a record, and its payload: what follows the HTTP header, or the whole block if it holds none."""
    if not data.startswith(b"WARC/"):
        raise ValueError("no WARC record at this place")
    fields, rest = _split(data)
    size = int(fields["content-length"])
    block = rest[:size]
    if len(block) < size:
        raise ValueError("a WARC record is cut off")
    kind, http = fields.get("warc-type", ""), {}
    if fields.get("content-type", "").lower().replace(" ", "").startswith("application/http"):
        http, payload = _split(block)
    else:
        payload = block
    declared = _declared(fields.get("warc-payload-digest", ""))
    made = hashlib.sha1(payload).hexdigest()
    length: int | None = len(payload)
    intact = None if declared is None else declared == made
    if kind == "revisit":  # its payload is another record's
        length = int(http["content-length"]) if http.get("content-length", "").isdigit() else None
        made, intact = declared, None
    name = lambda key: fields[key].strip("<>") if key in fields else None
    return {"record_type": kind, "record_id": name("warc-record-id"), "target_uri": fields.get("warc-target-uri"), "date": fields.get("warc-date"), "refers_to": name("warc-refers-to"), "payload_bytes": length, "payload_digest": made, "intact": intact}, payload


# ---- writing


class _Archive:
    """One archive being written: its data member, then its index."""

    def __init__(self, path: str, date: str) -> None:
        store, inside = _store(path)
        self.path, self.date, self.records, self.size = path, date, 0, 0
        self.sink = store.open_output_stream(inside)
        self.zip = zipfile.ZipFile(self.sink, "w", zipfile.ZIP_STORED)
        self.data = self.zip.open(zipfile.ZipInfo(DATA), "w", force_zip64=True)
        self.index: list[str] = []
        self.add(record_bytes("warcinfo", [("WARC-Record-ID", f"<{PAGE}archive:{quote(path, safe='')}>"), ("WARC-Date", date), ("Content-Type", "application/warc-fields")], b"software: tablewright\r\nformat: WARC File Format 1.1\r\n"), "warcinfo", "", None)

    def add(self, record: bytes, kind: str, uri: str, url: str | None) -> None:
        press = zlib.compressobj(6, zlib.DEFLATED, 31)
        packed = press.compress(record) + press.flush()
        self.data.write(packed)
        stamp = re.sub(r"[^0-9]", "", self.date)[:14]
        about = {"url": url, "id": uri, "type": kind, "offset": self.size, "length": len(packed), "filename": DATA.rpartition("/")[2]}
        self.index.append(f"{_line(url or '-')} {stamp} {json.dumps(about)}\n")
        self.size += len(packed)
        self.records += 1

    def close(self) -> tuple[str, int, int]:
        self.data.close()
        self.zip.writestr(zipfile.ZipInfo(INDEX), "".join(sorted(self.index)))
        self.zip.close()
        self.sink.close()
        return self.path, self.size, self.records


def write_archives(pages: DataFrame, path: str, least_bytes: int = 1000, archive_bytes: int = ARCHIVE_BYTES, date: str | None = None, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html") -> DataFrame:
    """Write a record for every row of pages into archives below the folder `path`, and return the list of them: archive, bytes, records.

    Of records with equal payloads (by SHA-256) of at least least_bytes bytes, the one with the largest id is a response and the
    others are revisits of it, without payload; all other records are responses. The list is written too (`path`/list): it names
    only what tasks that ended well have written, so files left by lost tasks are never read.

    NULL payload is empty. Rows without an id revisit a row that has one, and are responses if no equal row has; rows that share
    the largest id are all responses, and records of one id have one record id. NULL urls are left out of the record. An empty
    table gives an empty list. Other columns are not read. Payloads are never shuffled unless more than SENT_DIGESTS of them repeat.
    """
    spark = pages.sparkSession
    ship_package(spark)
    date = date or datetime.now(UTC).strftime("%Y-%m-%dT%H:%M:%SZ")
    path = path.rstrip("/")
    payload = F.coalesce(F.col(f"`{payload_col}`").cast("binary"), F.lit(b""))
    digest = F.when(F.octet_length(payload) >= least_bytes, F.unhex(F.sha2(payload, 256)))
    known = pages.select(F.col(f"`{id_col}`").alias("__id"), digest.alias("__digest")).where("__digest is not null")
    repeated = checkpointed(known.groupBy("__digest").agg(F.max("__id").alias("__last"), F.count("*").alias("__n")).where("__n > 1").drop("__n"))
    rows = pages.select(F.col(f"`{id_col}`").alias("__id"), F.col(f"`{url_col}`").alias("__url"), payload.alias("__payload"), digest.alias("__digest"))
    rows = rows.join(F.broadcast(repeated) if repeated.count() <= SENT_DIGESTS else repeated, "__digest", "left")
    refers = F.when(~F.col("__id").eqNullSafe(F.col("__last")), F.col("__last").cast("string"))
    rows = rows.select(F.col("__id").cast("string"), "__url", "__payload", refers.alias("__refers"))

    def write(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, made, archive = TaskContext.get(), [], None
        store, inside = _store(f"{path}/archives")
        store.create_dir(inside, recursive=True)
        for batch in batches:
            for page, url, body, other in zip(*batch.columns, strict=True):
                if archive is None:
                    archive = _Archive(f"{path}/archives/part-{task.partitionId():05d}-{task.taskAttemptId()}-{len(made)}.zip", date)
                page, url, other = page.as_py(), url.as_py(), other.as_py()
                archive.add(page_record(page, url, body.as_buffer().to_pybytes(), other, date), "response" if other is None else "revisit", _page_uri(page), url)
                if archive.size >= archive_bytes:
                    made.append(archive.close())
                    archive = None
        if archive:
            made.append(archive.close())
        yield pa.RecordBatch.from_arrays([pa.array(list(c), kind) for c, kind in zip(zip(*made, strict=True) if made else [[]] * 3, (pa.string(), pa.int64(), pa.int64()), strict=True)], names=["archive", "bytes", "records"])

    rows.mapInArrow(write, "archive string, bytes bigint, records bigint").write.parquet(f"{path}/list")
    return spark.read.parquet(f"{path}/list")


# ---- reading


def archives_in(spark: SparkSession, folder: str) -> DataFrame:
    """The archives below a folder by their names alone: archive, bytes."""
    files = spark.read.format("binaryFile").options(recursiveFileLookup="true", pathGlobFilter="*.{zip,wacz}").load(folder)
    return files.select(F.col("path").alias("archive"), F.col("length").alias("bytes"))


def _stored(member: zipped.Member) -> None:
    if member.method != zipped.STORED or member.encrypted:
        raise ValueError(f"{member.name} is not stored as it is, so its records can not be read in place")


def _index_lines(file: pa.NativeFile, member: zipped.Member) -> Iterator[bytes]:
    """Lines of an index, read in pieces; it may be deflated as a member and packed by gzip as a file."""
    at = zipped.data_start(lambda n, o: file.read_at(n, o), member)
    if member.encrypted or member.method not in (zipped.STORED, zipped.DEFLATED):
        raise ValueError(f"{member.name} can not be read")
    steps = [zlib.decompressobj(-15)] if member.method == zipped.DEFLATED else []
    packed, end, rest = member.name.endswith(".gz"), at + member.packed, b""
    unpack = zlib.decompressobj(31) if packed else None
    while at < end:
        piece = file.read_at(min(PIECE, end - at), at)
        at += len(piece)
        for step in steps:
            piece = step.decompress(piece)
        if unpack:
            plain = b""
            while piece:
                plain += unpack.decompress(piece)
                piece = unpack.unused_data
                if unpack.eof:
                    unpack = zlib.decompressobj(31)
            piece = plain
        *lines, rest = (rest + piece).split(b"\n")
        yield from lines
    yield from [rest] if rest else []


def _walk(file: pa.NativeFile, start: int, size: int, packed: bool) -> Iterator[tuple[int, int]]:
    """Place and length of every record of a member by reading through it, for archives without an index."""
    at, buffer, end = start, b"", start + size
    base = start  # place of the buffer's first byte

    def more() -> bool:
        nonlocal at, buffer
        piece = file.read_at(min(PIECE, end - at), at) if at < end else b""
        at += len(piece)
        buffer += piece
        return bool(piece)

    while buffer or more():
        if packed:
            unpack, used, fresh = zlib.decompressobj(31), 0, buffer
            while True:
                unpack.decompress(fresh)
                used += len(fresh) - len(unpack.unused_data)
                if unpack.eof:
                    break
                buffer = b""
                if not more():
                    raise ValueError("a record is cut off")
                fresh = buffer
            buffer = unpack.unused_data
        else:
            while b"\r\n\r\n" not in buffer:
                if not more():
                    raise ValueError("a record is cut off")
            head, _, _ = buffer.partition(b"\r\n\r\n")
            used = len(head) + 4 + int(_headers(head.split(b"\r\n")[1:])["content-length"]) + 4
            if used > len(buffer):
                at, buffer = base + used, b""
            else:
                buffer = buffer[used:]
        yield base, used
        base += used


def _places(file: pa.NativeFile, length: int) -> Iterator[tuple[str, int, list[tuple[int, int]]]]:
    """Of every archive member: name, first byte, and place and length of its records."""
    read_at = lambda n, o: file.read_at(n, o)
    found = list(m for m in zipped.members(read_at, length) if re.search(r"\.(warc(\.gz)?|cdxj?(\.gz)?)$", m.name))
    indexed: dict[str, list[tuple[int, int]]] = {}
    for member in found:
        if ".cdx" in member.name:
            for line in _index_lines(file, member):
                body = line[line.find(b"{") :]
                if body.startswith(b"{"):
                    about = json.loads(body)
                    indexed.setdefault(str(about.get("filename")), []).append((int(about["offset"]), int(about["length"])))
    for member in found:
        if ".cdx" in member.name:
            continue
        _stored(member)
        start = zipped.data_start(read_at, member)
        places = sorted({(start + o, n) for key in (member.name, member.name.rpartition("/")[2]) for o, n in indexed.get(key, [])})
        whole, end = True, start
        for o, n in places:
            whole, end = whole and o == end, o + n
        if not whole or end != start + member.size:  # no index, or one that leaves records out
            places = list(_walk(file, start, member.size, member.name.endswith(".gz")))
        yield member.name, start, places


def record_ranges(archives: DataFrame, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """Neighbouring records of every archive in ranges of about range_bytes: archive, member, start of the member, place, lengths."""
    ship_package(archives.sparkSession)

    def locate(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("archive", pa.string()), ("member", pa.string()), ("start", pa.int64()), ("at", pa.int64()), ("lengths", pa.list_(pa.int64()))])
        for batch in batches:
            for archive in batch.column(0).to_pylist():
                store, inside = _store(archive)
                with store.open_input_file(inside) as file:
                    rows = []
                    for member, start, places in _places(file, file.size()):
                        at, lengths = start, []
                        for o, n in places:
                            if lengths and sum(lengths) + n > range_bytes:
                                rows.append((archive, member, start, at, lengths))
                                lengths = []
                            at = at if lengths else o
                            lengths.append(n)
                        if lengths:
                            rows.append((archive, member, start, at, lengths))
                    yield pa.RecordBatch.from_pylist([dict(zip(schema.names, r, strict=True)) for r in rows], schema)

    count = archives.count()
    return archives.select("archive").repartition(max(1, min(count, 4 * partitions_hint(archives.sparkSession)))).mapInArrow(locate, RANGES)


def read_records(archives: DataFrame, payloads: bool = True, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """The records of archives (a table with a column `archive`, such as write_archives or archives_in return), one row each.

    Columns: archive, member, offset (in the member) and length of the packed record, record_type, record_id, target_uri, date,
    refers_to, payload_bytes and payload_digest (hex SHA-1) of the full payload, intact (whether the digest the record names is
    that of its payload), and with `payloads` the payload. A revisit has no payload: its size and digest are those it names. An
    index that does not cover its member, or none, is replaced by reading through the member. Members that are not stored, or
    encrypted, raise an error, as do damaged directories and records; nothing is left out silently. Repeated archives are read as
    often as they come; an empty list gives no rows.
    """
    ranges = checkpointed(record_ranges(archives, range_bytes))
    n = max(1, min(ranges.count(), 4 * partitions_hint(archives.sparkSession)))
    names = [*[f.split()[0] for f in RECORD.split(", ")], *["payload"] * payloads]
    kinds = {"offset": pa.int64(), "length": pa.int64(), "payload_bytes": pa.int64(), "intact": pa.bool_(), "payload": pa.binary()}
    schema = pa.schema([(x, kinds.get(x, pa.string())) for x in names])

    def read(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made, held = [], 0
        for batch in batches:
            for r in batch.to_pylist():
                store, inside = _store(r["archive"])
                with store.open_input_file(inside) as file:
                    body, at = file.read_at(sum(r["lengths"]), r["at"]), 0
                for n in r["lengths"]:
                    record = body[at : at + n]
                    about, payload = parsed(zlib.decompress(record, 31) if r["member"].endswith(".gz") else record)
                    made.append({"archive": r["archive"], "member": r["member"], "offset": r["at"] + at - r["start"], "length": n, **about, **({"payload": payload} if payloads else {})})
                    held += len(payload) * payloads + 500
                    at += n
                    if held >= BATCH_BYTES:
                        yield pa.RecordBatch.from_pylist(made, schema)
                        made, held = [], 0
        yield pa.RecordBatch.from_pylist(made, schema)

    # dealt by number, so that small rows that stand for megabytes are not put together
    return ranges.repartition(n).mapInArrow(read, RECORD + ", payload binary" * payloads)


def page_id(uri: Column, kind: str) -> Column:
    """The id a page's record id was made from."""
    return F.url_decode(F.regexp_extract(uri, f"^{PAGE}(.*)$", 1)).try_cast(kind)
