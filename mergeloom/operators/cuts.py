"""Inventories cut where no merge can be, so that what training needs of them is small.

Whatever stands across two adjacent units (bytes or characters) is at most as frequent as
these two are side by side. So merges at least as frequent as a floor never reach across
units that are side by side less often: words cut there have the same counts of all pairs
that are that frequent, before and after each such merge. Equal parts are one row, and
their number depends on how many merges there are to be, hardly on the size of the corpus.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Distinct pairs that a task adds up before it gives them away.
HELD = 1 << 20


def units(col: pa.Array, unit: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(units of all words, the byte at which each begins and the last ends, the unit with which each word begins and the last ends)."""
    col = col.cast(pa.large_binary())
    ends = np.frombuffer(col.buffers()[1], np.int64, len(col) + 1, col.offset * 8)
    data = np.frombuffer(col.buffers()[2] or b"", np.uint8)[ends[0] : ends[-1]]
    if unit == "byte":
        return data.astype(np.int64), np.arange(len(data) + 1), ends - ends[0]
    at = np.append(np.flatnonzero((data & 0xC0) != 0x80), len(data))
    return np.frombuffer(data.tobytes().decode().encode("utf-32-le"), "<u4").astype(np.int64), at, np.searchsorted(at, ends - ends[0])


def _pairs(code: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(each unit and the next one as a number, whether the next one is of the same word)."""
    inside = np.ones(max(0, len(code) - 1), bool)
    begin = first[(first > 0) & (first < len(code))]
    inside[begin - 1] = False
    return pair_codes(code[:-1], code[1:]), inside


def pair_codes(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    return left << 32 | right


def summed(keys: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(distinct keys, the sum of the weights of each)."""
    found, at = np.unique(keys, return_inverse=True)
    total = np.zeros(len(found), np.int64)
    np.add.at(total, at, weights)
    return found, total


def adjacent(words: DataFrame, unit: str) -> DataFrame:
    """(pair, freq): how often units are side by side in a (word, freq) table; without their sign, should counts be negative."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, weights = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for b in batches:
            code, _, first = units(b.column(0), unit)
            pair, inside = _pairs(code, first)
            weight = np.repeat(np.abs(b.column(1).to_numpy()), np.diff(first))[:-1]
            k, w = summed(pair[inside], weight[inside])
            keys, weights = summed(np.concatenate([keys, k]), np.concatenate([weights, w]))
            if len(keys) > HELD:
                yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(weights)], names=["pair", "freq"])
                keys, weights = keys[:0], weights[:0]
        yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(weights)], names=["pair", "freq"])

    return words.mapInArrow(run, "pair long, freq long").groupBy("pair").agg(F.sum("freq").alias("freq"))


def cut(words: DataFrame, unit: str, keep: np.ndarray) -> DataFrame:
    """(part, freq): words cut at all pairs but those of the sorted ``keep``. A part of one unit goes, unless it is a character beyond ASCII."""
    sent = words.sparkSession.sparkContext.broadcast(keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            code, at, first = units(b.column(0), unit)
            if not len(code):
                continue
            pair, inside = _pairs(code, first)
            if len(sent.value):
                inside &= sent.value[np.minimum(np.searchsorted(sent.value, pair), len(sent.value) - 1)] == pair
            else:
                inside[:] = False
            begin = np.concatenate([[0], np.flatnonzero(~inside) + 1, [len(code)]])
            freq = np.repeat(b.column(1).to_numpy(), np.diff(first))[begin[:-1]]
            useful = np.diff(begin) > 1
            if unit != "byte":
                useful |= code[begin[:-1]] > 127
            raw = b.column(0).cast(pa.large_binary())
            start = np.frombuffer(raw.buffers()[1], np.int64, 1, raw.offset * 8)[0]
            parts = pa.Array.from_buffers(pa.large_binary(), len(begin) - 1, [None, pa.py_buffer(at[begin] + start), raw.buffers()[2]])
            t = pa.table({"part": parts, "freq": pa.array(freq)}).filter(pa.array(useful)).group_by("part").aggregate([("freq", "sum")])
            yield from pa.table({"part": t.column("part").cast(pa.binary()), "freq": t.column("freq_sum")}).to_batches()

    return words.mapInArrow(run, "part binary, freq long").groupBy("part").agg(F.sum("freq").alias("freq"))
