"""WARC archives packed in ZIP files, written and read in place.

A package holds ``archive/data.warc.gz``, records compressed one by one, and
``indexes/index.cdxj`` with each record's offset and length. Both are stored, not
deflated, so a record is one range of the package. The reader finds the members
through the central directory (also in its ZIP64 form), reads the index, and
fetches ranges of records; nothing is extracted to disk.
"""

from __future__ import annotations

import base64
import hashlib
import json
import struct
import zipfile
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tallyweave.llm.common import LAST_ID, filesystem, first_in_order, id_order, partitions, path_of, text_id
from tallyweave.session import cut

DATA, INDEX = "archive/data.warc.gz", "indexes/index.cdxj"
#: A package is closed when its records have so many bytes; a range read is about so long.
PACKAGE_BYTES = 64 << 20
RANGE_BYTES = 4 << 20
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


# --- records -------------------------------------------------------------------

def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _name(page_id: int | None) -> str:
    return f"<urn:x-page:{'null' if page_id is None else page_id}>"


def _page(name: str) -> int | None:
    tail = name.strip("<>").rsplit(":", 1)[1]
    return None if tail == "null" else int(tail)


def _header_text(value: str) -> str:
    return "".join(f"%{ord(c):02X}" if ord(c) < 32 or ord(c) == 127 else c for c in value)


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: tuple[int | None] | None) -> bytes:
    """A compressed record. ``refers_to`` holds the first page of the same payload, for a revisit."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to else http + payload
    head = [f"WARC-Type: {'revisit' if refers_to else 'response'}", f"WARC-Record-ID: {_name(page_id)}", f"WARC-Date: {DATE}"]
    if url is not None:
        head.append(f"WARC-Target-URI: {_header_text(url)}")
    head.append(f"WARC-Payload-Digest: sha1:{digest(payload)}")
    if refers_to:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {_name(refers_to[0])}"]
    head += ["Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}"]
    text = "WARC/1.1\r\n" + "\r\n".join(head) + "\r\n\r\n"
    packer = zlib.compressobj(4, zlib.DEFLATED, 31)
    return packer.compress(text.encode() + block + b"\r\n\r\n") + packer.flush()


def parse(data: bytes) -> dict:
    """Type, page, URL, payload length and digest, and reference of a compressed record."""
    raw = zlib.decompress(data, 31)
    end = raw.index(b"\r\n\r\n")
    head = dict(line.split(": ", 1) for line in raw[:end].decode().split("\r\n")[1:])
    block = raw[end + 4:end + 4 + int(head["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    length = int(dict(line.split(": ", 1) for line in http.decode().split("\r\n")[1:])["Content-Length"])
    stated = head["WARC-Payload-Digest"].removeprefix("sha1:")
    if head["WARC-Type"] == "response" and (len(payload) != length or digest(payload) != stated):
        raise ValueError(f"damaged record {head['WARC-Record-ID']}")
    return {
        "page_id": _page(head["WARC-Record-ID"]), "url": head.get("WARC-Target-URI"), "payload_bytes": length, "payload_digest": stated,
        "record_type": head["WARC-Type"], "refers_to": _page(head["WARC-Refers-To"]) if "WARC-Refers-To" in head else None}


# --- packages ------------------------------------------------------------------

class _Sink:
    """The part of a file that a ZIP writer needs; it can't seek."""

    def __init__(self, stream):
        self.stream = stream

    def write(self, data) -> int:
        self.stream.write(data)
        return len(data)

    def flush(self) -> None:
        pass


class Package:
    """Writer of one package on an output stream."""

    def __init__(self, stream):
        self.zip = zipfile.ZipFile(_Sink(stream), "w", zipfile.ZIP_STORED)
        self.member = self.zip.open(zipfile.ZipInfo(DATA), "w", force_zip64=True)
        self.lines: list[bytes] = []
        self.size = 0

    def add(self, page_id: int | None, data: bytes) -> None:
        self.member.write(data)
        self.lines.append(json.dumps({"page": page_id, "offset": self.size, "length": len(data)}).encode())
        self.size += len(data)

    def close(self) -> None:
        self.member.close()
        self.zip.writestr(zipfile.ZipInfo(INDEX), b"\n".join(self.lines))
        self.zip.close()


def directory(read_at, size: int) -> dict[str, tuple[int, int]]:
    """Where each stored member of a ZIP file lies: name to (offset of its data, length).

    ``read_at(length, offset)`` reads a range. Members that are compressed or encrypted
    are left out. Zip64 records are used wherever the plain fields are full.
    """
    tail_length = min(size, 22 + 0xFFFF)
    tail = read_at(tail_length, size - tail_length)
    at = len(tail) - 22
    while at >= 0 and not (tail[at:at + 4] == b"PK\5\6" and at + 22 + struct.unpack_from("<H", tail, at + 20)[0] == len(tail)):
        at = tail.rfind(b"PK\5\6", 0, at + 3) if at > 0 else -1
    if at < 0:
        raise ValueError("no end of central directory")
    entries, length, start = struct.unpack_from("<HII", tail, at + 10)
    if 0xFFFF == entries or 0xFFFFFFFF in (length, start):
        place = size - tail_length + at - 20
        locator = read_at(20, place) if place >= 0 else b""
        if locator[:4] == b"PK\6\7":
            wide = read_at(56, struct.unpack_from("<Q", locator, 8)[0])
            if wide[:4] != b"PK\6\6":
                raise ValueError("no ZIP64 end of central directory")
            entries, length, start = struct.unpack_from("<QQQ", wide, 32)
    listing = read_at(length, start)
    found: dict[str, tuple[int, int]] = {}
    at = 0
    for _ in range(entries):
        if listing[at:at + 4] != b"PK\1\2":
            raise ValueError("damaged central directory")
        flags, method = struct.unpack_from("<HH", listing, at + 8)
        packed, plain = struct.unpack_from("<II", listing, at + 20)
        names, extras, comments = struct.unpack_from("<HHH", listing, at + 28)
        local = struct.unpack_from("<I", listing, at + 42)[0]
        name = listing[at + 46:at + 46 + names].decode("utf-8" if flags & 0x800 else "cp437")
        extra = listing[at + 46 + names:at + 46 + names + extras]
        at += 46 + names + extras + comments
        while len(extra) >= 4:
            kind, n = struct.unpack_from("<HH", extra)
            if kind == 1:
                values = list(struct.unpack_from(f"<{n // 8}Q", extra, 4))
                plain = values.pop(0) if plain == 0xFFFFFFFF else plain
                packed = values.pop(0) if packed == 0xFFFFFFFF else packed
                local = values.pop(0) if local == 0xFFFFFFFF else local
            extra = extra[4 + n:]
        if method == 0 and not flags & 1:
            own = read_at(30, local)
            if own[:4] != b"PK\3\4":
                raise ValueError("damaged local header")
            found[name] = (local + 30 + sum(struct.unpack_from("<HH", own, 26)), plain)
    return found


def ranges(read_at, size: int, limit: int = RANGE_BYTES) -> Iterator[tuple[int, list[int]]]:
    """Ranges of whole records of a package: offset, and the records' lengths one after the other."""
    members = directory(read_at, size)
    base, _ = members[DATA]
    at, length = members[INDEX]
    begin, held, end = None, [], 0
    for line in read_at(length, at).splitlines():
        entry = json.loads(line)
        if held and (entry["offset"] != end or sum(held) + entry["length"] > limit):
            yield base + begin, held
            held = []
        if not held:
            begin = entry["offset"]
        held.append(entry["length"])
        end = entry["offset"] + entry["length"]
    if held:
        yield base + begin, held


# --- jobs ----------------------------------------------------------------------

def revisits(pages: DataFrame, id_col: str = "page_id", html_col: str = "html", least: int = 0) -> DataFrame:
    """Rows that repeat an earlier payload of at least ``least`` bytes: ``_id, _h, first`` (the first page's id)."""
    payload = F.encode(F.coalesce(F.col(html_col), F.lit("")), "UTF-8")
    rows = pages.select(id_order(id_col).alias("_id"), text_id(html_col).alias("_h"), F.sha1(payload).alias("sha"), F.octet_length(payload).cast("long").alias("size"))
    firsts = first_in_order(cut(rows, "payloads"), ["sha"], ["_id"], label="payloads")
    return firsts.where((F.col("_id") > F.col("first__id")) & (F.col("size") >= least)).select("_id", "_h", F.col("first__id").alias("first")).distinct()


def write_packages(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least: int = 0) -> DataFrame:
    """Write a record for each row; returns the list of packages: ``file, size, records``.

    Names are new for each attempt of a task, and only those of attempts that count are
    listed.
    """
    rows = pages.select(id_order(id_col).alias("_id"), text_id(html_col).alias("_h"), F.col(url_col).cast("string").alias("url"), F.col(html_col).alias("html"))
    marked = rows.join(revisits(pages, id_col, html_col, least).hint("shuffle_hash"), ["_id", "_h"], "left").select("_id", "url", "html", "first")

    def write(batches):
        import uuid

        fs, root = filesystem(folder)
        stream = package = name = None
        count = 0

        def closed():
            package.close()
            size = stream.tell()
            stream.close()
            return pa.RecordBatch.from_pydict({"file": [name], "size": [size], "records": [count]})

        for batch in batches:
            for i, url, html, first in zip(*[batch.column(c).to_pylist() for c in ("_id", "url", "html", "first")], strict=True):
                if package is None:
                    fs.create_dir(root, recursive=True)
                    name, count = f"pages-{uuid.uuid4().hex}.zip", 0
                    stream = fs.open_output_stream(f"{root}/{name}")
                    package = Package(stream)
                page = None if i == LAST_ID else i
                package.add(page, record(page, url, (html or "").encode(), None if first is None else (None if first == LAST_ID else first,)))
                count += 1
                if package.size >= PACKAGE_BYTES:
                    yield closed()
                    package = None
        if package is not None:
            yield closed()

    return cut(marked.mapInArrow(write, "file string, size long, records long"), "packages")


def read_packages(packages: DataFrame, folder: str) -> DataFrame:
    """One row for each record: ``page_id, url, payload_bytes, payload_digest, record_type, refers_to``."""
    n = partitions(packages.sparkSession)

    def locate(batches):
        fs, root = filesystem(folder)
        for batch in batches:
            for name, size in zip(batch.column("file").to_pylist(), batch.column("size").to_pylist(), strict=True):
                with fs.open_input_file(f"{root}/{name}") as file:
                    for at, lengths in ranges(file.read_at, size):
                        yield pa.RecordBatch.from_pydict({"file": [name], "at": [at], "lengths": [lengths]})

    def fetch(batches):
        fs, root = filesystem(folder)
        for batch in batches:
            for row in batch.to_pylist():
                with fs.open_input_file(f"{root}/{row['file']}") as file:
                    data = file.read_at(sum(row["lengths"]), row["at"])
                found, at = [], 0
                for length in row["lengths"]:
                    found.append(parse(data[at:at + length]))
                    at += length
                yield pa.RecordBatch.from_pylist(found, schema=_FOUND)

    spread = packages.select("file", "size").repartition(n, "file").mapInArrow(locate, "file string, at long, lengths array<long>").repartition(n, "file", "at")
    return spread.mapInArrow(fetch, "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long")


_FOUND = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64())])


def archived(pages: DataFrame, folder: str | None = None, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least: int = 0) -> DataFrame:
    """Write ``pages`` as packages under ``folder`` and read every record back.

    A null page is an empty payload, a null URL has no URL header. Of equal payloads the
    smallest identifier is the response, nulls last; rows equal in identifier and payload
    are of one type, and a revisit of a row without identifier refers to null. Without
    rows there are no packages and no rows.
    """
    folder = folder or path_of(pages.sparkSession, "packages")
    return read_packages(write_packages(pages, folder, id_col, url_col, html_col, least), folder)
