"""Operator 6: repeated passages by seed and extend on winnowed anchors.

1. Seeds. In each stretch of ``length`` words, the k-gram of least hash is its
   anchor (winnowing), so equal stretches have equal anchors at equal offsets.
   Anchors meet by hash; those found in two documents at least are seeds, and
   the documents learn which of theirs are.
2. Extension. Around a seed occurrence a match extends to the left and to the
   right by as many words as there are stretches with that anchor. All
   occurrences of a seed meet again with the hashes of these stretches; equal
   ones are matches, however many documents have them: no pairs are listed, and
   equal runs of stretches of one slice of documents are sent once, so a passage
   in D documents costs as many entries as there are slices that have it.
3. Maximal repeats. Consecutive matching stretches of a document are chained;
   a chain that cannot grow is a span of the result.

Stretches without a seed cannot match and are never sent.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mergeloom.llm import common as C
from mergeloom.llm.tokens import Words, slices, window_hash

LENGTH, GRAM = 50, 16
SPANS = "doc_id long, start_word int, n_words int, is_first boolean"
#: Runs of a slice in the order of its text: row, position, how many stretches, entry (equal runs are one); the first run and the block of each entry.
LAST = {"ids": "<i8", "local": "<u2", "pos": "<u4", "c": "<u4", "entry": "<u4", "head": "<u4", "block": "<u4"}
LAST_SCHEMA = "slice long, " + ", ".join(f"{x} binary" for x in LAST)
#: ... with the last run of each entry and the hashes of its stretches.
SEEDED = LAST | {"tail": "<u4", "h": "<u8"}
FLAGS = "slice long, block int, again binary, first binary"


def parts_of(t: pa.Table | pa.RecordBatch, dtypes: dict[str, str]) -> Iterator[list]:
    """[slice, arrays...] of each row; small integers are widened."""
    for number, *raw in zip(*(t.column(t.schema.get_field_index(c)).to_pylist() for c in ("slice", *dtypes))):
        yield [number] + [x if d == "<u8" else x.astype(np.int64) for d, x in ((d, np.frombuffer(x, d)) for d, x in zip(dtypes.values(), raw))]


def spread(begin: np.ndarray, many: np.ndarray) -> np.ndarray:
    """begin[0], begin[0] + 1, ... (many[0] of them), then begin[1], ..."""
    end = np.cumsum(many)
    return np.repeat(begin - (end - many), many) + np.arange(end[-1] if len(end) else 0)


def sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    out, span = x, 1
    while span * 2 <= w:
        out = np.minimum(out[:-span], out[span:])
        span *= 2
    return np.minimum(out[: len(x) - w + 1], out[w - span : len(x) - span + 1])


def anchors(words: Words, length: int, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first word of each stretch, its anchor's word, hashes of all k-grams)."""
    n = len(words.hash)
    if n < length:
        none = np.zeros(0, np.int64)
        return none, none, np.zeros(0, np.uint64)
    gram = window_hash(words.hash, k)
    low = np.uint64(0xFFFFFFFF)
    least = sliding_min((gram & ~low) | np.arange(len(gram), dtype=np.uint64), length - k + 1)
    at = np.flatnonzero(words.doc[: n - length + 1] == words.doc[length - 1 :])
    return at, (least[at] & low).astype(np.int64), gram


def texts_of(docs: DataFrame) -> DataFrame:
    return docs.where(F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"), "text")


def met_anchors(texts: DataFrame, length: int, k: int, nb: int, across: bool) -> DataFrame:
    """(doc_id, hits), stored: the anchors of each document that are found at another place too,
    or, with ``across``, in another document.

    Anchors are written once, by slices of documents. A slice sends each of its keys once,
    with its least place and whether the slice itself has two, and gets back a bit for
    each: so a passage that is everywhere costs as many entries as there are slices.
    """

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 33
        for b in slices(batches):
            words = Words(b.column(1))
            _, anchor, gram = anchors(words, length, k)
            if len(anchor):
                a = np.unique(anchor)
                row = words.doc[a]
                held = (b.column(0).to_numpy().astype("<i8"), row.astype("<u2"), (a - words.first[row]).astype("<u4"), gram[a])
                yield pa.RecordBatch.from_arrays([pa.array([number], pa.int64())] + [pa.array([x.tobytes()], pa.binary()) for x in held], names=["slice", "ids", "local", "pos", "key"])
                number += 1

    held = C.stored(texts.mapInArrow(C.trimmed(find), "slice long, ids binary, local binary, pos binary, key binary"))

    def keys(cols: list[bytes]) -> tuple[np.ndarray, ...]:
        """ids, rows, positions, keys of a slice in the order of (key, place), and where each key begins."""
        ids, row, pos, key = (np.frombuffer(x, d) for x, d in zip(cols, ("<i8", "<u2", "<u4", "<u8")))
        order = np.lexsort((pos, ids[row], key))
        row, pos, key = row[order], pos[order], key[order]
        return ids, row, pos, key, np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for number, *cols in zip(*(c.to_pylist() for c in b.columns)):
                ids, row, pos, key, first = keys(cols)
                last = np.append(first[1:], len(key)) - 1
                twice = ids[row[first]] != ids[row[last]]
                if not across:
                    twice |= pos[first] != pos[last]
                row, pos, key = row[first], pos[first], key[first]
                rows = []
                for bucket, i in C.split_by(C.bucket_of(key, nb)):
                    used, local = np.unique(row[i], return_inverse=True)
                    rows.append((bucket, C.pack(np.array([number], "<i8"), ids[used], local.astype("<u2"), pos[i], key[i], twice[i].astype("u1"))))
                yield C.blob_batch(rows)

    def answer(blobs: list[bytes]) -> pa.Table:
        number, ids, local, pos, key, twice = C.gather(blobs, "<i8", "<i8", "<u2", "<u4", "<u8", "u1")
        count = [len(x) for x in key]
        doc, pos, key, twice = np.concatenate([x[y] for x, y in zip(ids, local)]), np.concatenate(pos), np.concatenate(key), np.concatenate(twice)
        bucket = int(C.bucket_of(key[:1], nb)[0])
        order = np.argsort(key, kind="stable")
        begin = np.flatnonzero(np.concatenate([[True], key[order][1:] != key[order][:-1]]))
        many = np.diff(np.append(begin, len(key)))
        place = np.unique(doc, return_inverse=True)[1].astype(np.uint64)
        if not across:
            place = (place << np.uint64(32)) | pos
        again = np.minimum.reduceat(place[order], begin) != np.maximum.reduceat(place[order], begin)
        again |= np.maximum.reduceat(twice[order], begin) > 0
        flag = np.empty(len(key), bool)
        flag[order] = np.repeat(again, many)
        maps = [np.packbits(x).tobytes() for x in np.split(flag, np.cumsum(count)[:-1])]
        return pa.table({"slice": np.concatenate(number), "bucket": pa.array([bucket] * len(maps), pa.int32()), "flags": pa.array(maps, pa.binary())})

    found = C.exchange(held.mapInArrow(C.trimmed(send), C.BLOB), answer, "slice long, bucket int, flags binary")

    def pick(t: pa.Table, flags: pa.Table) -> pa.Table:
        ids, hits = [], []
        known = dict(zip(flags.column("bucket").to_pylist(), flags.column("flags").to_pylist()))
        for cols in zip(*(t.column(c).to_pylist() for c in ("ids", "local", "pos", "key"))):
            who, row, pos, key, first = keys(list(cols))
            hit = np.zeros(len(first), bool)
            for bucket, i in C.split_by(C.bucket_of(key[first], nb)):
                hit[i] = bits(known[bucket], len(i))
            hit = np.repeat(hit, np.diff(np.append(first, len(key))))
            row, pos = row[hit], pos[hit]
            order = np.lexsort((pos, row))
            row, pos = row[order], pos[order]
            begin = np.flatnonzero(np.concatenate([[True], row[1:] != row[:-1]])) if len(row) else np.zeros(0, np.int64)
            ids.append(who[row[begin]])
            hits += [x.tobytes() for x in np.split(pos, begin[1:])] if len(row) else []
        return pa.table({"doc_id": np.concatenate([np.zeros(0, np.int64), *ids]), "hits": pa.array(hits, pa.binary())})

    each = held.groupBy("slice").cogroup(found.groupBy("slice")).applyInArrow(pick, "doc_id long, hits binary")
    hits = C.stored(each.groupBy("doc_id").agg(F.collect_list("hits").alias("hits")))
    C.discard(held)
    return hits


def bits(raw: bytes, n: int) -> np.ndarray:
    return np.unpackbits(np.frombuffer(raw, np.uint8), count=n).astype(bool)


def with_hits(texts: DataFrame, hits: DataFrame) -> DataFrame:
    """``texts`` that have hits, with them. If hits are too many to broadcast, texts without any are still not shuffled."""
    if C.table_bytes(hits) * 4 <= C.BROADCAST_BYTES:
        return texts.join(F.broadcast(hits), "doc_id")
    return C.only(texts, hits.select("doc_id")).join(hits, "doc_id")


def flagged(words: Words, hits: list[list[bytes]]) -> np.ndarray:
    """A flag for each word of a slice, set at the hits of its row."""
    flag = np.zeros(len(words.hash), bool)
    for r, raw in enumerate(hits):
        p = np.frombuffer(b"".join(raw), "<u4")
        p = p[p < words.count[r]]  # rows that share a doc_id share their hits
        flag[words.first[r] + p] = True
    return flag


def pack_runs(doc: np.ndarray, start: np.ndarray, first: np.ndarray) -> bytes:
    """Matching stretches of some documents, consecutive ones as one entry (document, start, how many, first)."""
    order = np.lexsort((start, doc))
    doc, start, first = doc[order], start[order].astype(np.int64), first[order].astype(bool)
    cut = np.flatnonzero(np.concatenate([[True], (doc[1:] != doc[:-1]) | (start[1:] != start[:-1] + 1) | (first[1:] != first[:-1])]))
    return C.pack(doc[cut].astype("<i8"), start[cut].astype("<u4"), np.diff(np.append(cut, len(doc))).astype("<u4"), first[cut].astype("u1"))


def chain(blobs: list[bytes], length: int) -> pa.Table:
    """Matching stretches of a bucket of documents -> spans."""
    ids, start, many, first = (np.concatenate(x) for x in C.gather(blobs, "<i8", "<u4", "<u4", "u1"))
    many = many.astype(np.int64)
    end = np.cumsum(many)
    start = np.repeat(start.astype(np.int64) - (end - many), many) + np.arange(end[-1])
    ids, first = np.repeat(ids, many), np.repeat(first, many)
    order = np.lexsort((start, ids))
    ids, start, first = ids[order], start[order], first[order].astype(bool)
    new = np.concatenate([[True], (ids[1:] != ids[:-1]) | (start[1:] != start[:-1])])
    ids, start, first = ids[new], start[new], first[new]
    cut = np.flatnonzero(np.concatenate([[True], (ids[1:] != ids[:-1]) | (start[1:] != start[:-1] + 1) | (first[1:] != first[:-1])]))
    many = np.diff(np.concatenate([cut, [len(ids)]]))
    return pa.table({"doc_id": ids[cut], "start_word": start[cut].astype(np.int32), "n_words": (many + length - 1).astype(np.int32), "is_first": first[cut]})


def repeated_passages(docs: DataFrame, length: int = LENGTH, k: int = GRAM) -> DataFrame:
    """(doc_id, start_word, n_words, is_first): maximal repeats of ``length`` words or more.

    A span is a maximal run of words in which every ``length`` words also occur in
    another document. Runs are cut where ``is_first`` changes: it is true where no
    other occurrence has a smaller (doc_id, start), so cutting the spans where it
    is false leaves each passage once.

    Defined cases: null or short texts have no span; a very long text is a slice of its
    own, handled whole; rows with null doc_id are left out; rows that share a doc_id
    count as one document, so they do not repeat one another; ``doc_id`` is a whole
    number, others are an error; other columns are not read; no rows give no rows.
    """
    if not 0 < k <= length:
        raise ValueError("0 < k <= length must hold")
    C.bounded_batches(docs.sparkSession)
    texts = texts_of(docs)
    nb = C.bucket_count(texts)
    hits = met_anchors(texts, length, k, nb, True)

    def extend(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 33
        for b in slices(batches):
            words = Words(b.column(1))
            at, anchor, gram = anchors(words, length, k)
            seed = flagged(words, b.column(2).to_pylist())[anchor] if len(anchor) else np.zeros(0, bool)
            at, anchor = at[seed], anchor[seed]
            if not len(at):
                continue
            h, ids = window_hash(words.hash, length)[at], b.column(0).to_numpy()
            begin = np.flatnonzero(np.concatenate([[True], (anchor[1:] != anchor[:-1]) | (at[1:] != at[:-1] + 1)]))
            c = np.diff(np.append(begin, len(at)))
            row = words.doc[at[begin]]
            pos = at[begin] - words.first[row]
            content = np.add.reduceat(C.mix(h + (np.arange(len(h)) - np.repeat(begin, c)).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)), begin)
            order = np.lexsort((pos, ids[row], content))
            first = np.flatnonzero(np.concatenate([[True], content[order][1:] != content[order][:-1]]))
            entry = np.empty(len(order), np.int64)
            entry[order] = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(order))))
            head, tail = order[first], order[np.append(first[1:], len(order)) - 1]
            parts = [ids, row, pos, c, entry, head, C.bucket_of(gram[anchor[begin[head]]], nb), tail, h[spread(begin[head], c[head])]]
            yield pa.RecordBatch.from_arrays([pa.array([number], pa.int64())] + [pa.array([x.astype(d).tobytes()], pa.binary()) for x, d in zip(parts, SEEDED.values())], names=["slice", *SEEDED])
            number += 1

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for number, ids, local, pos, c, _, head, block, tail, h in parts_of(b, SEEDED):
                start, rows = np.cumsum(c[head]) - c[head], []
                for bucket, i in C.split_by(block):
                    j = head[i]
                    rows.append((bucket, C.pack(np.array([number], "<i8"), np.array([bucket], "<u4"), c[j].astype("<u4"), ids[local[j]], pos[j].astype("<u4"), ids[local[tail[i]]], h[spread(start[i], c[j])])))
                yield C.blob_batch(rows)

    held = C.stored(with_hits(texts, hits).mapInArrow(C.trimmed(extend), "slice long, " + ", ".join(f"{x} binary" for x in SEEDED)))
    return spans(held.select("slice", *LAST), C.exchange(held.mapInArrow(C.trimmed(send), C.BLOB), match, FLAGS), nb, length)


def match(blobs: list[bytes]) -> pa.Table:
    """Runs of stretches around the seeds of a bucket -> which are found in another document, and which are the first of theirs."""
    number, bucket, c, doc, pos, last, h = C.gather(blobs, "<i8", "<u4", "<u4", "<i8", "<u4", "<i8", "<u8")
    count = [len(x) for x in h]
    c, doc, pos, last, h = (np.concatenate(x) for x in (c, doc, pos, last, h))
    c = c.astype(np.int64)
    _, who = np.unique(np.concatenate([doc, last]), return_inverse=True)
    low, high = np.repeat(who[: len(doc)], c).astype(np.uint64), np.repeat(who[len(doc) :], c)
    place = (low << np.uint64(32)) | spread(pos.astype(np.int64), c).astype(np.uint64)
    order = np.argsort(h, kind="stable")
    begin = np.flatnonzero(np.concatenate([[True], h[order][1:] != h[order][:-1]]))
    many = np.diff(np.append(begin, len(h)))
    least = np.minimum.reduceat(place[order], begin)
    again, first = np.empty(len(h), bool), np.empty(len(h), bool)
    again[order] = np.repeat((least >> np.uint64(32)).astype(np.int64) != np.maximum.reduceat(high[order], begin), many)
    first[order] = place[order] == np.repeat(least, many)
    return flag_rows(np.concatenate(number), int(bucket[0][0]), count, again, first)


def flag_rows(number: np.ndarray, block: int, count: list[int], again: np.ndarray, first: np.ndarray) -> pa.Table:
    """Two bits for each of the suffixes or stretches that each slice has sent."""
    parts = [[np.packbits(x).tobytes() for x in np.split(y, np.cumsum(count)[:-1])] for y in (again, first)]
    return pa.table({"slice": number, "block": pa.array([block] * len(count), pa.int32()), "again": pa.array(parts[0], pa.binary()), "first": pa.array(parts[1], pa.binary())})


def spans(held: DataFrame, flags: DataFrame, nb: int, length: int) -> DataFrame:
    """Runs of slices (LAST) and what their entries are told (FLAGS) -> SPANS."""

    def settle(t: pa.Table, found: pa.Table) -> pa.Table:
        known = {b: (x, y) for b, x, y in zip(*(found.column(c).to_pylist() for c in ("block", "again", "first")))}
        rows = []
        for _, ids, local, pos, c, entry, head, block in parts_of(t, LAST):
            base = np.cumsum(c[head]) - c[head]
            again, first = np.zeros(int(c[head].sum()), bool), np.zeros(int(c[head].sum()), bool)
            for b, i in C.split_by(block):
                i = i[c[head[i]] > 0]
                if len(i):
                    own = spread(base[i], c[head[i]])
                    again[own], first[own] = (bits(x, len(own)) for x in known[b])
            of = spread(base[entry], c)
            own = np.repeat(head[entry] == np.arange(len(entry)), c)
            hit, first = again[of], first[of] & own
            run = np.repeat(np.arange(len(c)), c)[hit]
            start, first = spread(pos, c)[hit], first[hit]
            doc = ids[local[run]]
            for b, i in C.split_by(C.bucket_of(doc.view(np.uint64), nb)):
                rows.append((b, pack_runs(doc[i], start[i], first[i])))
        return pa.Table.from_batches([C.blob_batch(rows)])

    done = held.groupBy("slice").cogroup(flags.groupBy("slice")).applyInArrow(settle, C.BLOB)
    return C.exchange(done, lambda x: chain(x, length), SPANS)
