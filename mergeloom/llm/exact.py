"""Operator 9: exact dedup by an exchange of Golomb-coded fingerprints.

1. A partition sorts its fingerprints (the leading bits of a 64-bit hash of the
   text; log2 of the number of documents plus ``SPARE`` bits) and sends each
   owner, who has a range of fingerprints, its share as Golomb-Rice coded gaps:
   some 10 bits a document and not a row each. It keeps the doc_ids, in the same
   order, in a written table.
2. An owner decodes its blocks, finds fingerprints that occur twice, and answers
   each block with a bitmap, one bit a fingerprint.
3. Bitmap and kept doc_ids give the suspects; only their texts are shuffled, and
   only equal bytes make copies. A false suspect costs a shuffled text, no more.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mergeloom.llm import common as C

#: Bits of a fingerprint beyond log2(documents): 2**-SPARE of the documents are false suspects.
SPARE = 8
OWNER_DOCS = 1 << 20


def rice(sorted_values: np.ndarray, least: int, k: int) -> bytes:
    """Gaps of sorted values from ``least`` on: all quotients in unary, then all remainders of k bits."""
    gap = np.diff(np.concatenate([[np.uint64(least)], sorted_values]))
    q = (gap >> np.uint64(k)).astype(np.int64)
    unary = np.ones(int(q.sum()) + len(q), np.uint8)
    unary[np.cumsum(q + 1) - 1] = 0
    rest = ((gap[:, None] >> np.arange(k, dtype=np.uint64)) & np.uint64(1)).astype(np.uint8).reshape(-1)
    return np.packbits(unary).tobytes() + np.packbits(rest).tobytes()


def unrice(code: bytes, n: int, least: int, k: int) -> np.ndarray:
    tail = (n * k + 7) // 8
    raw = np.frombuffer(code, np.uint8)
    stops = np.flatnonzero(np.unpackbits(raw[: len(raw) - tail]) == 0)[:n]
    q = np.diff(np.concatenate([[-1], stops])) - 1
    rest = np.unpackbits(raw[len(raw) - tail :])[: n * k].reshape(n, k).astype(np.uint64)
    gap = (q.astype(np.uint64) << np.uint64(k)) + (rest << np.arange(k, dtype=np.uint64)).sum(axis=1, dtype=np.uint64)
    return np.cumsum(gap, dtype=np.uint64) + np.uint64(least)


def exact_copies(docs: DataFrame, spare: int = SPARE) -> DataFrame:
    """(doc_id, keep_id): every document whose text equals that of another, and the
    least doc_id with that text, which stays and is not listed itself.

    Defined cases: equal means equal bytes, however long a text is; empty texts are copies
    of one another; a null text equals nothing; rows with null doc_id are left out; rows that repeat a
    doc_id with its text are one document. ``doc_id`` is a whole number, others are an
    error. Other columns are not read. No rows give
    no rows.
    """
    C.bounded_batches(docs.sparkSession)
    texts = docs.where(F.col("doc_id").isNotNull() & F.col("text").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    n = docs.count()
    bits = min(64, max(16, math.ceil(math.log2(n + 1)) + spare))
    owners = max(8, math.ceil(n / OWNER_DOCS))
    span = -(-(1 << bits) // owners)

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, fps, pid = [], [], 0
        for b in batches:
            if b.num_rows:
                pid = b.column(0)[0].as_py()
                ids.append(b.column(1).to_numpy())
                fps.append(b.column(2).to_numpy())
        if not ids:
            return
        ids, v = np.concatenate(ids), np.concatenate(fps).view(np.uint64) >> np.uint64(64 - bits)
        order = np.argsort(v, kind="stable")
        ids, v = ids[order], v[order]
        owner = (v // np.uint64(span)).astype(np.int64)
        cut = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1], [True]]))
        rows = []
        for a, z in zip(cut[:-1], cut[1:]):
            k = max(1, int(math.log2(max(2, span / (z - a)))))
            rows.append((pid, int(owner[a]), int(z - a), k, rice(v[a:z], int(owner[a]) * span, k), ids[a:z].tobytes()))
        yield pa.RecordBatch.from_arrays(
            [pa.array(c, t) for c, t in zip(zip(*rows), (pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.binary()))],
            names=["pid", "owner", "n", "k", "code", "ids"],
        )

    narrow = texts.select(F.spark_partition_id().alias("pid"), "doc_id", F.xxhash64("text").alias("fp"))
    sent = C.stored(narrow.mapInArrow(send, "pid int, owner int, n int, k int, code binary, ids binary"))

    def answer(t: pa.Table) -> pa.Table:
        pid, owner, count, k, code = (t.column(c).to_pylist() for c in ("pid", "owner", "n", "k", "code"))
        values = [unrice(x, m, o * span, j) for x, m, o, j in zip(code, count, owner, k)]
        v = np.concatenate(values)
        order = np.argsort(v, kind="stable")
        s = v[order]
        again = np.zeros(len(s) + 1, bool)
        again[1:-1] = s[1:] == s[:-1]
        twice = np.empty(len(s), bool)
        twice[order] = again[1:] | again[:-1]
        maps = [np.packbits(x).tobytes() for x in np.split(twice, np.cumsum(count)[:-1])]
        return pa.table({"pid": pa.array(pid, pa.int32()), "owner": pa.array(owner, pa.int32()), "twice": pa.array(maps, pa.binary())})

    bitmaps = C.stored(sent.select("pid", "owner", "n", "k", "code").groupBy("owner").applyInArrow(answer, "pid int, owner int, twice binary"))

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for raw, bitmap in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                ids = np.frombuffer(raw, "<i8")
                yield pa.RecordBatch.from_arrays([pa.array(ids[np.unpackbits(np.frombuffer(bitmap, np.uint8))[: len(ids)] == 1])], names=["doc_id"])

    suspects = C.stored(sent.join(C.small_side(bitmaps), ["pid", "owner"]).select("ids", "twice").mapInArrow(pick, "doc_id long").distinct())
    # texts are grouped without lists of ids: a hot text is one row for each map task, its ids stay where they are
    held = C.only(texts, suspects).select("doc_id", "text")
    least = C.stored(held.groupBy("text").agg(F.min("doc_id").alias("keep_id"), F.max("doc_id").alias("most")).where("keep_id <> most").drop("most"))
    known = F.broadcast(least) if C.table_bytes(least) * 4 <= C.BROADCAST_BYTES else least
    return held.join(known, "text").where("doc_id <> keep_id").select("doc_id", "keep_id").distinct()
