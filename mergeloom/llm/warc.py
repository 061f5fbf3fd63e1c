"""Operator 4: reassembly of segmented WARC records (WARC/1.1, ISO 28500).

A record that was cut into segments has a first part with WARC-Segment-Number 1
and ``continuation`` records that name it in WARC-Segment-Origin-ID; the last one
has WARC-Segment-Total-Length. Records are parsed where they lie; whole ones are
decoded there, only segments are shuffled (by origin) and sorted by number within
their partition, so an executor holds one record at a time, however many parts
it has. The block is checked against the total length and decoded from chunked
transfer framing.
"""

from __future__ import annotations

import io
import zlib
from collections.abc import Iterator
from typing import BinaryIO

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mergeloom.llm import common as C

SEGMENT_BYTES, CHUNK_BYTES = 2048, 700
PARTS = "origin string, number long, total long, uri string, block binary, status string"
OUT = "record_id string, url string, body string, segments int, status string"
_PARTS = pa.schema([("origin", pa.string()), ("number", pa.int64()), ("total", pa.int64()), ("uri", pa.string()), ("block", pa.binary()), ("status", pa.string())])
_OUT = pa.schema([("record_id", pa.string()), ("url", pa.string()), ("body", pa.string()), ("segments", pa.int32()), ("status", pa.string())])
HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n"


# --- bytes ------------------------------------------------------------------


def chunked(body: bytes, size: int = CHUNK_BYTES) -> bytes:
    parts = [body[a : a + size] for a in range(0, len(body), size)]
    return b"".join(b"%x\r\n%b\r\n" % (len(p), p) for p in parts) + b"0\r\n\r\n"


def unchunk(data: bytes) -> bytes:
    """The body in chunked framing; ValueError if the framing is broken."""
    out, at = [], 0
    while True:
        eol = data.find(b"\r\n", at)
        if eol < 0:
            raise ValueError("chunk size missing")
        n = int(data[at:eol].split(b";")[0].strip(), 16)
        at = eol + 2
        if n == 0:
            return b"".join(out)
        if n < 0 or data[at + n : at + n + 2] != b"\r\n":
            raise ValueError("chunk cut short")
        out.append(data[at : at + n])
        at += n + 2


def record(kind: str, fields: dict[str, str], block: bytes) -> bytes:
    head = "".join(f"{k}: {v}\r\n" for k, v in {"WARC-Type": kind, **fields, "Content-Length": len(block)}.items())
    return b"WARC/1.1\r\n" + head.encode() + b"\r\n" + block + b"\r\n\r\n"


def segmented(record_id: str, uri: str, block: bytes, size: int = SEGMENT_BYTES) -> list[bytes]:
    """A response as records whose blocks have ``size`` bytes at most."""
    first = {"WARC-Record-ID": record_id, "WARC-Target-URI": uri}
    parts = [block[a : a + size] for a in range(0, len(block), size)] or [b""]
    if len(parts) == 1:
        return [record("response", first, parts[0])]
    out = [record("response", first | {"WARC-Segment-Number": "1"}, parts[0])]
    for k, p in enumerate(parts[1:], 2):
        more = {"WARC-Record-ID": f"{record_id[:-1]}:{k}>", "WARC-Segment-Origin-ID": record_id, "WARC-Segment-Number": str(k)}
        if k == len(parts):
            more["WARC-Segment-Total-Length"] = str(len(block))
        out.append(record("continuation", more, p))
    return out


def number(raw: str | bytes) -> int | None:
    """A header's whole number; None if it isn't one or has more than 18 digits."""
    text = raw.decode("latin-1") if isinstance(raw, bytes) else raw
    text = text.strip()
    return int(text) if text.isascii() and text.isdigit() and len(text) <= 18 else None


def parse(raw: bytes) -> tuple[dict[str, str], bytes]:
    """Fields (names in lower case) and block of one record; ValueError if it isn't one."""
    head, sep, rest = raw.partition(b"\r\n\r\n")
    if not head.startswith(b"WARC/") or not sep:
        raise ValueError("not a WARC record")
    fields = {}
    for line in head.decode("utf-8", "replace").split("\r\n")[1:]:
        k, _, v = line.partition(":")
        fields[k.strip().lower()] = v.strip()
    n = number(fields.get("content-length", ""))
    if n is None or len(rest) < n:
        raise ValueError("block cut short")
    return fields, rest[:n]


def inflated(file: BinaryIO, step: int = 4 << 20) -> Iterator[bytes]:
    """The bytes of a file, plain or in gzip members, piece by piece; broken members end it."""
    data = file.read(step)
    if data[:2] != b"\x1f\x8b":
        while data:
            yield data
            data = file.read(step)
        return
    d = zlib.decompressobj(31)
    while data:
        try:
            out = d.decompress(data, step)
        except zlib.error:
            return
        if out:
            yield out
        data = d.unconsumed_tail
        if d.eof:
            data, d = d.unused_data, zlib.decompressobj(31)
        data = data or file.read(step)


def split(source: bytes | BinaryIO) -> Iterator[bytes]:
    """Records of a file; no more than one of them and a few MB are in memory."""
    pieces, held, at = inflated(io.BytesIO(source) if isinstance(source, bytes) else source), bytearray(), 0

    def more() -> bool:
        nonlocal at
        piece = next(pieces, None)
        if piece is None:
            return False
        del held[:at]
        at = 0
        held.extend(piece)
        return True

    while True:
        while held[at : at + 2] == b"\r\n":
            at += 2
        seen = at
        while (end := held.find(b"\r\n\r\n", seen)) < 0:
            back = max(0, len(held) - at - 3)
            if not more():
                if len(held) > at:
                    yield bytes(held[at:])
                return
            seen = at + back
            while held[at : at + 2] == b"\r\n":
                at += 2
                seen = max(seen, at)
        n = 0
        for line in bytes(held[at:end]).split(b"\r\n"):
            if line.lower().startswith(b"content-length:"):
                n = number(line.split(b":", 1)[1]) or 0
        size = end + 4 - at + n
        while len(held) - at < size and more():
            pass
        yield bytes(held[at : at + size])
        at = min(len(held), at + size)


def payload(block: bytes) -> tuple[str, str]:
    """(text, status) of an HTTP response block; a block without HTTP head is taken as it is."""
    head, sep, body = block.partition(b"\r\n\r\n")
    if not head.startswith(b"HTTP/") or not sep:
        return block.decode("utf-8", "replace"), "ok"
    if any(x.lower().replace(b" ", b"") == b"transfer-encoding:chunked" for x in head.split(b"\r\n")):
        try:
            body = unchunk(body)
        except ValueError:
            return "", "bad chunked framing"
    return body.decode("utf-8", "replace"), "ok"


# --- tables -----------------------------------------------------------------


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """(record): each record of the WARC files under ``path``, as bytes.

    A task reads a file from any file system that pyarrow knows, as a stream, so its
    size does not matter. No files give no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name in b.column(0).to_pylist():
                system, at = pyarrow.fs.FileSystem.from_uri(name)
                held, size = [], 0
                with system.open_input_stream(at, compression=None) as file:
                    for r in split(file):
                        held.append(r)
                        size += len(r)
                        if size > 8 << 20:
                            yield pa.RecordBatch.from_arrays([pa.array(held, pa.binary())], names=["record"])
                            held, size = [], 0
                yield pa.RecordBatch.from_arrays([pa.array(held, pa.binary())], names=["record"])

    return spark.read.format("binaryFile").load(path).select("path").mapInArrow(run, "record binary")


def page_records(pages: DataFrame, segment_bytes: int = SEGMENT_BYTES, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """(record): pages as segmented responses in chunked framing; a null html is an empty body, a null url an empty one.

    The record id has the page_id and a number of the row, so that rows which share a
    page_id, equal or not, short or long, are records of their own. Rows with null page_id are left out.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for i, row, url, html in zip(*(c.to_pylist() for c in b.columns)):
                out += segmented(f"<urn:page:{i}:{row}>", url or "", HTTP + chunked((html or "").encode(), chunk_bytes), segment_bytes)
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["record"])

    C.bounded_batches(pages.sparkSession)
    return pages.where("page_id is not null").select("page_id", F.monotonically_increasing_id(), "url", "html").mapInArrow(run, "record binary")


def reassemble(records: DataFrame) -> DataFrame:
    """(record_id, url, body, segments, status): one row for each record of the column ``record``.

    Status is ``ok`` or what is wrong, with an empty body: ``not a record`` (also
    for a null; its record_id is null), ``bad header`` (a segment number or total length
    that is no whole number of at most 18 digits), ``missing segment`` (numbers are not 1 to n,
    or no last segment gives the length), ``wrong length``, ``conflicting segments``
    (a number twice with unequal blocks; equal repeats count once), ``bad chunked
    framing``. Other columns are not read. No rows give no rows.
    """
    C.bounded_batches(records.sparkSession)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for raw in b.column(0).to_pylist():
                try:
                    f, block = parse(raw or b"")
                except ValueError:
                    rows.append((None, None, None, None, b"", "not a record"))
                    continue
                origin = f.get("warc-segment-origin-id") or f.get("warc-record-id")
                stated = [f.get("warc-segment-number"), f.get("warc-segment-total-length")]
                k, total = (None if x is None else number(x) for x in stated)
                good = (k is None) == (stated[0] is None) and (total is None) == (stated[1] is None)
                rows.append((origin, k if good else None, total, f.get("warc-target-uri"), block if good else b"", "ok" if good else "bad header"))
            yield pa.RecordBatch.from_pylist([dict(zip(_PARTS.names, r)) for r in rows], _PARTS)

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for r in b.to_pylist():
                body, status = payload(r["block"]) if r["status"] == "ok" else ("", r["status"])
                rows.append(dict(zip(_OUT.names, (r["origin"], r["uri"], body, 1, status))))
            yield pa.RecordBatch.from_pylist(rows, _OUT)

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict] = []
        for b in batches:
            rows = []
            for r in b.to_pylist():
                if held and held[0]["origin"] != r["origin"]:
                    rows.append(_join(held))
                    held = []
                held.append(r)
            if rows:
                yield pa.RecordBatch.from_pylist(rows, _OUT)
        if held:
            yield pa.RecordBatch.from_pylist([_join(held)], _OUT)

    parts = records.select("record").mapInArrow(read, PARTS)
    single = parts.where(F.col("number").isNull() | F.col("origin").isNull()).mapInArrow(whole, OUT)
    many = parts.where(F.col("number").isNotNull() & F.col("origin").isNotNull()).repartition("origin").sortWithinPartitions("origin", "number")
    return single.unionByName(many.mapInArrow(joined, OUT))


def _join(parts: list[dict]) -> dict:
    blocks: dict[int, bytes] = {}
    conflict = False
    for p in parts:
        conflict |= blocks.setdefault(p["number"], p["block"]) != p["block"]
    totals = {p["total"] for p in parts if p["total"] is not None}
    body, block = "", b"".join(blocks[k] for k in sorted(blocks))
    if conflict or len(totals) > 1:
        status = "conflicting segments"
    elif min(blocks) != 1 or max(blocks) != len(blocks) or not totals:
        status = "missing segment"
    elif len(block) not in totals:
        status = "wrong length"
    else:
        body, status = payload(block)
    uri = next((p["uri"] for p in parts if p["uri"] is not None), None)
    return dict(zip(_OUT.names, (parts[0]["origin"], uri, body, len(blocks), status)))
