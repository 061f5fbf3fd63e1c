"""Files by segments: where to cut them, and their text."""

from __future__ import annotations

import math
from collections.abc import Iterator
from pathlib import Path

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MODES = ("auto", "eot", "line", "utf8")
WINDOW = 4096
#: Bytes of segments that a task reads, one after the other.
TASK_BYTES = 8 << 20


def _token_start(f, at: int, size: int, token: bytes) -> int:
    """Start of the first token in full windows from ``at`` on. Windows don't overlap: a
    token across two is missed, and so is one in the last, shorter window."""
    for start in range(at, size - WINDOW + 1, WINDOW):
        f.seek(start)
        hit = f.read(WINDOW).find(token)
        if hit >= 0:
            return start + hit
    return size


def _char_start(f, at: int, size: int) -> int:
    f.seek(at)
    for k, b in enumerate(f.read(4)):
        if b & 0xC0 != 0x80:
            return at + k
    return min(size, at + 4)


def _line_start(f, at: int, size: int) -> int:
    f.seek(at - 1)
    window = f.read(WINDOW + 1)
    if window[:1] == b"\n":
        return at
    hit = window.find(b"\n", 1)
    return at + hit if hit >= 0 else _char_start(f, at, size)


def offsets(path: str | Path, *, count: int | None = None, chunk_size: int | None = None, mode: str = "auto", token: str = "<|endoftext|>") -> list[int]:
    """Cut points of a file, 0 and its size included; as many chunks as ``count``, or of ``chunk_size`` bytes."""
    if mode not in MODES:
        raise ValueError(f"Unknown boundary mode: {mode}")
    if count is None and (chunk_size is None or chunk_size < 1):
        raise ValueError("chunk_size must be positive")
    size, mark = Path(path).stat().st_size, token.encode()
    if size == 0:
        return [0, 0]
    n = max(1, count) if count is not None else math.ceil(size / chunk_size)
    step = max(1, size // n) if count is not None else chunk_size
    if n <= 1:
        return [0, size]
    with open(path, "rb") as f:
        if mode in ("auto", "eot"):
            found = _contains(f, mark)
            if not found and mode == "eot":
                return [0, size]
            mode = "eot" if found else "line"
        align = {"eot": lambda a: _token_start(f, a, size, mark), "line": lambda a: _line_start(f, a, size), "utf8": lambda a: _char_start(f, a, size)}[mode]
        return sorted({0, size, *(align(k * step) for k in range(1, n) if k * step < size)})


def _contains(f, mark: bytes) -> bool:
    f.seek(0)
    rest = b""
    while block := f.read(1 << 20):
        if mark in rest + block:
            return True
        rest = block[-len(mark) + 1 :] if len(mark) > 1 else b""
    return False


def boundaries(path: str | Path, **how) -> list[tuple[int, int]]:
    """(offset, length) of each segment."""
    cut = offsets(path, **how)
    return [(a, z - a) for a, z in zip(cut, cut[1:])]


def read_segment(path: str | Path, offset: int, length: int) -> str:
    with open(path, "rb") as f:
        f.seek(offset)
        return f.read(length).decode("utf-8", "replace")


def segment_table(spark: SparkSession, path: str | Path, **how) -> DataFrame:
    """(offset, length, text): the segments of a file in a table. Cuts are found on the driver; executors read
    the file, an absolute path that they share or the URI of a file system that pyarrow knows, a segment at a time."""
    cut, where = boundaries(path, **how), str(path)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, at = pyarrow.fs.FileSystem.from_uri(where)
        with system.open_input_file(at) as f:
            for b in batches:
                for a, n in zip(*(c.to_pylist() for c in b.columns)):
                    text = f.read_at(n, a).decode("utf-8", "replace")
                    yield pa.RecordBatch.from_arrays([pa.array([a]), pa.array([n]), pa.array([text])], names=["offset", "length", "text"])

    tasks = min(len(cut), max(spark.sparkContext.defaultParallelism, math.ceil(cut[-1][0] / TASK_BYTES)))
    table = spark.createDataFrame(cut, "offset long, length long").repartition(max(1, tasks), "offset")
    return table.mapInArrow(read, "offset long, length long, text string")


def binary_segment(spark: SparkSession, path: str, offset: int, length: int) -> DataFrame:
    """One segment as text, malformed bytes replaced, without Python."""
    return spark.read.format("binaryFile").load(path).select(F.make_valid_utf8(F.substring("content", offset + 1, length).cast("string")).alias("text"))
