"""Operator 8: token ids as canonical, length-limited Huffman codes.

1. Texts become ids of a public byte-level BPE vocabulary (its file is a
   parameter; the driver reads it and broadcasts the ranks). The pieces of a
   slice of texts are found by character class in numpy, tile its bytes, and are
   dictionary-encoded by Arrow, so that merges run once for each distinct piece.
   The ids are written once, in blocks of whole documents.
2. Ids are counted over all blocks (a sum for each id, as many rows as the
   vocabulary has), and package-merge gives the best code lengths up to ``LIMIT``.
3. Each block is coded by itself, with the bit offset of every ``EVERY``-th token.
   A decoder looks ``LIMIT`` bits up in one table and runs all stretches between
   checkpoints abreast.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mergeloom.llm import common as C
from mergeloom.llm.tokens import slices, text_bytes

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
LIMIT, EVERY, BLOCK_BYTES = 20, 1024, 4 << 20
#: Bytes of text (or one longer text) and tokens of a block that are worked on at once; they bound a worker's memory, not results.
TEXT_AT_ONCE, TOKENS_AT_ONCE = 1 << 20, 1 << 17
#: Distinct pieces that a worker remembers; then it starts anew (no effect on results).
REMEMBERED = 200_000
IDS = "block bigint, doc_ids array<bigint>, n_tokens array<int>, ids binary"
CODED = "block bigint, doc_ids array<bigint>, n_tokens array<int>, bits bigint, payload binary, checkpoints array<bigint>"
OTHER, LETTER, NUMBER, SPACE = range(4)


# --- pieces -----------------------------------------------------------------


@lru_cache(1)
def _classes() -> np.ndarray:
    kinds = np.zeros(0x110000, np.uint8)
    points = "".join(map(chr, range(0xD800))) + "" * 0x800 + "".join(map(chr, range(0xE000, 0x110000)))
    for kind, pattern in ((LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+"), (SPACE, r"\s+")):
        for m in regex.finditer(pattern, points):
            kinds[m.start() : m.end()] = kind
    return kinds


def piece_starts(data: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Byte offsets at which a piece of ``PATTERN`` begins in the rows of a column."""
    n = len(data)
    if not n:
        return np.zeros(0, np.int64)
    lead = None
    if data.max() < 128:
        point = data
        edge = off
    else:
        lead = np.flatnonzero((data & 0xC0) != 0x80)
        point = np.frombuffer(data.tobytes().decode().encode("utf-32-le"), np.uint32)
        edge = np.searchsorted(lead, off)
    kind = _classes()[point]
    m = len(kind)
    row_start = np.zeros(m + 3, bool)
    row_start[edge] = True
    start = row_start.copy()
    start[1:m] |= kind[1:] != kind[:-1]
    # white space before something else in its row: the last one stands alone, or belongs to what follows
    last = np.flatnonzero((kind[:-1] == SPACE) & (kind[1:] != SPACE) & ~row_start[1:m])
    start[last] = True
    start[last[point[last] == 32] + 1] = False
    # an apostrophe with no blank of its own, and the letters that it takes along
    q = np.flatnonzero(point[:-1] == 39)
    q = q[start[q] & start[q + 1] & ~row_start[q + 1] & (kind[q + 1] == LETTER)]
    if len(q):
        c1 = point[q + 1]
        c2 = np.where(~row_start[q + 2] & (q + 2 < m), point[np.minimum(q + 2, m - 1)], 0)
        one = np.isin(c1, [115, 116, 109, 100])
        two = ((c1 == 114) & (c2 == 101)) | ((c1 == 118) & (c2 == 101)) | ((c1 == 108) & (c2 == 108))
        start[q[one | two] + 1] = False
        start[q[one] + 2] = True
        start[q[two] + 3] = True
    at = np.flatnonzero(start[:m])
    return at if lead is None else lead[at]


class Tokenizer:
    """Ids of texts, a column at a time."""

    def __init__(self, ranks: dict[bytes, int]):
        self.bpe = tiktoken.Encoding("given", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.width = np.zeros(max(ranks.values()) + 1, np.int64)
        for token, r in ranks.items():
            self.width[r] = len(token)
        self._forget()

    def _forget(self) -> None:
        """No piece is known: ``known`` gives its number, by which its ids lie in ``flat``."""
        self.known: dict[bytes, int] = {}
        self.flat, self.first = np.zeros(0, np.uint32), np.zeros(1, np.int64)

    def _learn(self, pieces: list[bytes]) -> None:
        """Ids of new pieces. Words with a blank before them are sent to the merges in one text, and told apart by their bytes."""
        words = [p for p in pieces if p[:1] == b" " and p[1:].decode().isalpha()]
        rest = [p for p in pieces if not (p[:1] == b" " and p[1:].decode().isalpha())]
        ids = [np.zeros(0, np.uint32)]
        sizes = []
        for a in range(0, len(words), 1 << 16):
            part = words[a : a + (1 << 16)]
            got = np.array(self.bpe.encode_ordinary(b"".join(part).decode()), np.uint32)
            ends = np.searchsorted(np.cumsum(self.width[got]), np.cumsum([len(p) for p in part])) + 1
            ids.append(got)
            sizes.append(np.diff(ends, prepend=0))
        for p in rest:
            got = self.bpe.encode_ordinary(p.decode())
            ids.append(np.array(got, np.uint32))
            sizes.append(np.array([len(got)]))
        for p in words + rest:
            self.known[p] = len(self.known)
        self.flat = np.concatenate([self.flat, *ids])
        self.first = np.concatenate([self.first, self.first[-1] + np.cumsum(np.concatenate(sizes))])

    def column(self, col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(all ids, number of ids of each row)."""
        data, off = text_bytes(col)
        at = piece_starts(data, off)
        if not len(at):
            return np.zeros(0, np.uint32), np.zeros(len(col), np.int64)
        bounds = np.concatenate([at, [len(data)]]).astype(np.int64)
        pieces = pa.Array.from_buffers(pa.large_binary(), len(at), [None, pa.py_buffer(bounds), pa.py_buffer(np.ascontiguousarray(data))]).dictionary_encode()
        distinct = pieces.dictionary.to_pylist()
        if len(self.known) > REMEMBERED:
            self._forget()
        new = [p for p in distinct if p not in self.known]
        if new:
            self._learn(new)
        number = np.fromiter(map(self.known.__getitem__, distinct), np.int64, len(distinct))
        code = number[pieces.indices.to_numpy()]
        first = self.first[code]
        many = self.first[code + 1] - first
        end = np.cumsum(many)
        out = self.flat[np.repeat(first - (end - many), many) + np.arange(end[-1])]
        total = np.concatenate([[0], end])[np.searchsorted(at, off)]
        return out, np.diff(total)


def read_ranks(spark: SparkSession, path: str) -> dict[bytes, int]:
    """A rank file (``base64(token) rank`` a line): a path of the driver, or a URL of any file system of the session."""
    if "://" in path:
        lines = [r.value for r in spark.read.text(path).collect()]
    else:
        with open(path, encoding="ascii") as f:
            lines = f.read().splitlines()
    return {base64.b64decode(a): int(b) for a, _, b in (x.partition(" ") for x in lines) if a}


# --- codes ------------------------------------------------------------------


def code_lengths(counts: np.ndarray, limit: int = LIMIT) -> np.ndarray:
    """Lengths of an optimal prefix code with no code over ``limit`` bits (package-merge); 0 where the count is 0."""
    out = np.zeros(len(counts), np.uint8)
    used = np.flatnonzero(counts)
    if len(used) < 2:
        out[used] = 1
        return out
    if len(used) > 1 << limit:
        raise ValueError(f"{len(used)} ids don't fit codes of {limit} bits")
    used = used[np.argsort(counts[used], kind="stable")]
    leaf = counts[used].astype(np.int64)
    levels, row = [], leaf
    is_leaf = np.ones(len(leaf), bool)
    for _ in range(limit - 1):
        levels.append(is_leaf)
        pack = row[: len(row) // 2 * 2].reshape(-1, 2).sum(axis=1)
        row = np.concatenate([leaf, pack])
        order = np.argsort(row, kind="stable")
        row, is_leaf = row[order], order < len(leaf)
    levels.append(is_leaf)
    take = 2 * len(leaf) - 2
    length = np.zeros(len(leaf), np.int64)
    for is_leaf in reversed(levels):
        leaves = int(is_leaf[:take].sum())
        length[:leaves] += 1
        take = 2 * (take - leaves)
    out[used] = length
    return out


def canonical(lengths: np.ndarray) -> np.ndarray:
    """Code words in the order of (length, id)."""
    code = np.zeros(len(lengths), np.uint64)
    used = np.flatnonzero(lengths)
    order = used[np.argsort(lengths[used], kind="stable")]
    n = lengths[order].astype(np.uint64)
    if len(order):
        top = int(n.max())
        step = np.uint64(1) << (np.uint64(top) - n)
        code[order] = (np.cumsum(step) - step) >> (np.uint64(top) - n)
    return code


def pack_bits(ids: np.ndarray, lengths: np.ndarray, codes: np.ndarray, every: int = EVERY) -> tuple[bytes, int, np.ndarray]:
    """(payload, number of bits, bit offsets of tokens 0, every, 2 every, ...)."""
    if not len(ids):
        return b"", 0, np.zeros(0, np.int64)
    length = lengths[ids]
    bits = int(length.sum(dtype=np.int64))
    out, points, at = np.zeros((bits >> 6) + 2, np.uint64), [], 0
    for a in range(0, len(ids), TOKENS_AT_ONCE):
        n, code = length[a : a + TOKENS_AT_ONCE].astype(np.int64), codes[ids[a : a + TOKENS_AT_ONCE]]
        end = at + np.cumsum(n)
        begin = end - n
        word, room = begin >> 6, 64 - (begin & 63) - n
        left = np.where(room >= 0, code << np.maximum(room, 0).astype(np.uint64), code >> np.maximum(-room, 0).astype(np.uint64))
        first = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
        out[word[first]] |= np.add.reduceat(left, first)
        over = np.flatnonzero(room < 0)
        out[word[over] + 1] |= code[over] << (64 + room[over]).astype(np.uint64)
        points.append(begin[-a % every :: every])
        at = int(end[-1])
    return out.byteswap().tobytes()[: (bits + 7) // 8], bits, np.concatenate(points)


class Decoder:
    """One table of 2**limit entries: the id and the length of the code that begins so."""

    def __init__(self, lengths: np.ndarray, limit: int = LIMIT):
        self.limit = limit
        used = np.flatnonzero(lengths)
        order = used[np.argsort(lengths[used], kind="stable")]
        span = 1 << (limit - lengths[order].astype(np.int64))
        self.id, self.length = np.repeat(order, span).astype(np.uint32), np.repeat(lengths[order], span).astype(np.int64)
        rest = (1 << limit) - len(self.id)
        self.id, self.length = np.pad(self.id, (0, rest)), np.pad(self.length, (0, rest))

    def ids(self, payload: bytes, n: int, checkpoints: np.ndarray, every: int = EVERY) -> np.ndarray:
        """The n ids of a block, or of the stretches from the given checkpoints on."""
        raw = np.frombuffer(payload + bytes(8), np.uint8).astype(np.uint32)
        window = (raw[:-3] << 24) | (raw[1:-2] << 16) | (raw[2:-1] << 8) | raw[3:]
        at = np.asarray(checkpoints, np.int64).copy()
        out = np.zeros((len(at), every), np.uint32)
        for k in range(min(every, n)):
            live = len(at) if (len(at) - 1) * every + k < n else len(at) - 1
            p = at[:live]
            key = (window[p >> 3] >> (32 - self.limit - (p & 7)).astype(np.uint32)) & np.uint32((1 << self.limit) - 1)
            out[:live, k] = self.id[key]
            p += self.length[key]
        return out.reshape(-1)[:n]


# --- tables -----------------------------------------------------------------


def encode(docs: DataFrame, vocabulary: str = VOCABULARY, limit: int = LIMIT, every: int = EVERY, order: list[str] | None = None) -> DataFrame:
    """(block, doc_ids, n_tokens, bits, payload, checkpoints): all texts as coded ids.

    The row of block -1 is the code book: its payload has one byte for each id of
    the vocabulary, the length of its canonical code (0: not used). A block holds
    whole documents in the order read, some ``BLOCK_BYTES`` of text or one longer
    text; ``checkpoints`` are bit offsets of its tokens 0, every, 2 every, ...
    With ``order`` (columns of ``docs``) documents are sorted by it: those of a block,
    and blocks by number, whatever the order in which files are read back.

    Defined cases: a null text has n_tokens -1, an empty one 0; a null doc_id stays
    null; repeated rows are each coded; a very long text is a block of its own; ``doc_id``
    is a whole number, others are an error; other columns are not read. No rows give the
    code book alone, with no code.
    """
    if not 1 <= limit <= 25:
        raise ValueError("1 <= limit <= 25 must hold")
    spark = docs.sparkSession
    C.bounded_batches(spark)
    ranks = read_ranks(spark, vocabulary)
    size = max(ranks.values()) + 1
    dtype = "<u2" if size <= 1 << 16 else "<u4"
    sent = spark.sparkContext.broadcast(ranks)

    def tokenize(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = Tokenizer(sent.value)
        task = TaskContext.get().partitionId() << 33
        for k, b in enumerate(slices(batches, limit=BLOCK_BYTES)):
            parts = [tokenizer.column(x.column(1)) for x in slices([b], limit=TEXT_AT_ONCE)]
            ids, many = (np.concatenate(x) for x in zip(*((i.astype(dtype), m) for i, m in parts)))
            many = np.where(b.column(1).is_null().to_numpy(zero_copy_only=False), -1, many).astype(np.int32)
            span = pa.array([0, b.num_rows], pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array([task + k], pa.int64()), pa.ListArray.from_arrays(span, b.column(0)), pa.ListArray.from_arrays(span, pa.array(many)), pa.array([ids.tobytes()], pa.binary())], names=["block", "doc_ids", "n_tokens", "ids"])

    if order:
        docs = docs.repartitionByRange(*order).sortWithinPartitions(*order)
    held = C.stored(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(C.trimmed(tokenize), IDS))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, np.int64)
        for b in batches:
            for raw in b.column(0).to_pylist():
                total += np.bincount(np.frombuffer(raw, dtype), minlength=size)
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int64()), pa.array(total[used])], names=["id", "n"])

    counts = np.zeros(size, np.int64)
    for r in held.select("ids").mapInArrow(C.trimmed(count), "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).collect():
        counts[r.id] = r.n
    lengths = code_lengths(counts, limit)
    book = spark.sparkContext.broadcast((lengths, canonical(lengths)))

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lengths, codes = book.value
        for b in batches:
            for k, raw in enumerate(b.column(3)):  # a block at a time
                payload, bits, points = pack_bits(np.frombuffer(raw.as_buffer(), dtype), lengths, codes, every)
                one = b.slice(k, 1)
                yield pa.RecordBatch.from_arrays([*one.columns[:3], pa.array([bits], pa.int64()), pa.array([payload], pa.binary()), pa.array([points.tolist()], pa.list_(pa.int64()))], names=["block", "doc_ids", "n_tokens", "bits", "payload", "checkpoints"])

    coded = held.mapInArrow(C.trimmed(code), CODED)
    first = spark.createDataFrame([(-1, [], [], 0, bytearray(lengths.tobytes()), [])], CODED)
    return first.unionByName(coded)


def decode(coded: DataFrame, limit: int = LIMIT, every: int = EVERY) -> DataFrame:
    """(doc_id, ids): the ids of each document of ``encode``; null ids for a null text, none for an empty one.

    A null doc_id and repeated rows come back as they were; blocks may come in any order. A
    code book alone gives no rows; without the row of the code book it is an error.
    """
    lengths = np.frombuffer(bytes(coded.where("block = -1").first().payload), np.uint8)
    book = coded.sparkSession.sparkContext.broadcast(lengths)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoder = Decoder(book.value, limit)
        for b in batches:
            for doc_ids, many, payload, points in zip(*(c.to_pylist() for c in b.columns)):
                size = np.maximum(np.array(many, np.int64), 0)
                ids = decoder.ids(payload, int(size.sum()), np.array(points, np.int64), every)
                cut = np.concatenate([[0], np.cumsum(size)]).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(cut), pa.array(ids.astype(np.int32)), mask=pa.array([m < 0 for m in many]))
                yield pa.RecordBatch.from_arrays([pa.array(doc_ids, pa.int64()), lists], names=["doc_id", "ids"])

    return coded.where("block >= 0").select("doc_ids", "n_tokens", "payload", "checkpoints").mapInArrow(C.trimmed(run), "doc_id long, ids array<int>")
