"""Operator 1: benchmark decontamination with a generalised suffix automaton.

The automaton holds every substring of the normalised test items. As a document
streams through it, the current state and length are the longest suffix of the
words read that occurs in an item. A state also knows the least limit of the
items that contain it, so a match is judged against the limits of the items it
is in: item i is leaked by k(i) = min(``words``, ceil(``coverage`` * words of i))
consecutive words of it, but ``least`` at the least. What is removed is the union
of all such matches.

Only words that can lie in such a match are walked: each run of words whose
``least k``-grams all occur in the items (looked up by hash, in numpy), which
contains every match over the limits whole. Matching is map-only. An automaton is
broadcast; one of more than ``SHARD_WORDS`` words is never built: the benchmark is then
taken a shard at a time, each marking all documents and making room for the next.

An item of fewer than ``least`` words can't be told from chance inside a text; it is a
leak where it is all of a document.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mergeloom.llm import common as C
from mergeloom.llm.tokens import Words, slices, window_hash

#: Words of test items in one automaton, some 150 MB.
SHARD_WORDS = 200_000
WORDS, COVERAGE, LEAST = 12, 0.6, 6


class Automaton:
    """Suffix automaton of several word sequences (each a list of ints)."""

    def __init__(self, items: list[list[int]], limits: list[int]):
        self.next: list[dict[int, int]] = [{}]
        self.link, self.len = [-1], [0]
        for item in items:
            at = 0
            for w in item:
                at = self._add(at, w)
        self.limit = [1 << 60] * len(self.len)
        for item, k in zip(items, limits):
            at = 0
            for w in item:
                at = self.next[at][w]
                up = at
                while up > 0 and self.limit[up] > k:
                    self.limit[up] = k
                    up = self.link[up]
        #: the longest proper suffix of a state's matches that is over its limit
        self.best = [0] * len(self.len)
        for s in sorted(range(1, len(self.len)), key=self.len.__getitem__):
            up = self.link[s]
            self.best[s] = self.len[up] if up > 0 and self.len[up] >= self.limit[up] else self.best[up]

    def _state(self, length: int, edges: dict[int, int], link: int) -> int:
        self.len.append(length)
        self.next.append(edges)
        self.link.append(link)
        return len(self.len) - 1

    def _split(self, p: int, w: int) -> int:
        """The state for the longest string of p followed by w; q = next[p][w] may be longer."""
        q = self.next[p][w]
        if self.len[p] + 1 == self.len[q]:
            return q
        clone = self._state(self.len[p] + 1, dict(self.next[q]), self.link[q])
        self.link[q] = clone
        while p >= 0 and self.next[p].get(w) == q:
            self.next[p][w] = clone
            p = self.link[p]
        return clone

    def _add(self, last: int, w: int) -> int:
        if w in self.next[last]:
            return self._split(last, w)
        new, p = self._state(self.len[last] + 1, {}, 0), last
        while p >= 0 and w not in self.next[p]:
            self.next[p][w] = new
            p = self.link[p]
        if p >= 0:
            self.link[new] = self._split(p, w)
        return new

    def marks(self, words: list[int]) -> np.ndarray:
        """True at the words inside a match over its limit."""
        depth = np.zeros(len(words) + 1, np.int64)
        s = n = 0
        for e, w in enumerate(words):
            while s and w not in self.next[s]:
                s = self.link[s]
                n = self.len[s]
            t = self.next[s].get(w)
            s, n = (t, n + 1) if t is not None else (0, 0)
            over = n if n >= self.limit[s] else self.best[s]
            if over:
                depth[e - over + 1] += 1
                depth[e + 1] -= 1
        return np.cumsum(depth[:-1]) > 0


class Leaks:
    """An automaton with the hashes that find where to use it, and short items."""

    def __init__(self, items: list[list[int]], limits: list[int], short: list[list[int]] | None = None):
        self.automaton = Automaton(items, limits)
        self.k = min(limits, default=1)
        grams = [window_hash(np.array(i, np.uint64), self.k) for i in items]
        self.grams = np.unique(np.concatenate([np.zeros(0, np.uint64), *grams]))
        self.maybe = np.zeros(1 << 20, bool)
        self.maybe[(self.grams >> np.uint64(44)).astype(np.int64)] = True
        self.short = {tuple(i) for i in short or ()}
        self.sizes = {len(i) for i in self.short}

    def find(self, words: Words) -> np.ndarray:
        """A flag for each word of a slice."""
        out = np.zeros(len(words.hash), bool)
        for n in self.sizes:
            for r in np.flatnonzero(words.count == n):
                a = words.first[r]
                out[a : a + n] = tuple(words.hash[a : a + n].tolist()) in self.short
        if not len(self.grams):
            return out
        h, at = words.grams(self.k)
        near = self.maybe[(h >> np.uint64(44)).astype(np.int64)]
        h, at = h[near], at[near]
        at = at[C.among(h, self.grams)]
        if len(at):
            # consecutive hits of one row make one run of words
            cut = np.flatnonzero(np.concatenate([[True], (np.diff(at) > 1) | (np.diff(words.doc[at]) > 0)]))
            for run in np.split(at, cut[1:]):
                a, z = run[0], run[-1] + self.k
                out[a:z] |= self.automaton.marks(words.hash[a:z].tolist())
        return out


def _limits(n: int, words: int, coverage: float, least: int) -> int:
    return max(least, min(words, math.ceil(coverage * n - 1e-9)))


def leaks_of(benchmark: DataFrame, words: int, coverage: float, least: int) -> Iterator[Leaks]:
    """The benchmark, a table of test items, as automata of bounded size, one after another."""
    items, limits, short, size = [], [], [], 0
    for batch in benchmark.select("text").toLocalIterator():
        found = Words(pa.array([batch.text], pa.string())).hash.tolist()
        k = _limits(len(found), words, coverage, least)
        if len(found) < k:
            if found:
                short.append(found)
        else:
            items.append(found)
            limits.append(k)
        size += len(found)
        if size >= SHARD_WORDS:
            yield Leaks(items, limits, short)
            items, limits, short, size = [], [], [], 0
    if items or short:
        yield Leaks(items, limits, short)


def _marked(docs: DataFrame, benchmark: DataFrame, words: int, coverage: float, least: int) -> tuple[DataFrame, object]:
    """``docs`` (text and other columns) with a binary column ``marks`` of the leaks in all shards but the last, and the last, broadcast."""
    context, last = docs.sparkSession.sparkContext, None
    docs = docs.withColumn("marks", F.lit(None).cast("binary"))
    for leaks in leaks_of(benchmark, words, coverage, least):
        if last is not None:
            docs = C.stored(docs.mapInArrow(_mark(last), docs.schema))
            last.destroy()
        last = context.broadcast(leaks)
    return docs, last


def _flags(b: pa.RecordBatch, w: Words, leaks: Leaks | None) -> np.ndarray:
    """Words of a slice that leak by the marks it has or by these items."""
    flag = leaks.find(w) if leaks is not None else np.zeros(len(w.hash), bool)
    for r, raw in enumerate(b.column(b.schema.get_field_index("marks")).to_pylist()):
        if raw:
            flag[w.first[r] : w.first[r + 1]] |= np.unpackbits(np.frombuffer(raw, np.uint8), count=int(w.count[r])).astype(bool)
    return flag


def _mark(sent):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            w = Words(b.column(b.schema.get_field_index("text")))
            flag = _flags(b, w, sent.value)
            marks = [np.packbits(flag[a:z]).tobytes() if flag[a:z].any() else None for a, z in zip(w.first[:-1], w.first[1:])]
            yield b.set_column(b.schema.get_field_index("marks"), "marks", pa.array(marks, pa.binary()))

    return run


def decontaminate(docs: DataFrame, benchmark: DataFrame, words: int = WORDS, coverage: float = COVERAGE, least: int = LEAST) -> DataFrame:
    """(doc_id, text, n_words, n_removed): every document, its leaked spans cut out.

    A span is cut from the first byte of its first word to the last byte of its last
    word; adjoining spans are one. ``n_words`` counts the words before. Rows keep
    their null doc_id and repeated rows stay repeated; a null text stays null and an
    empty one empty, with 0 words; a very long text is searched whole; repeated test
    items count once, null and wordless ones not at all; an empty or wordless benchmark
    cuts nothing. Other columns are not read. No rows give no rows.
    """
    C.bounded_batches(docs.sparkSession)
    marked, sent = _marked(docs.select("doc_id", "text"), benchmark, words, coverage, least)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            w = Words(b.column(1))
            flag = _flags(b, w, sent and sent.value)
            removed = np.bincount(w.doc[flag], minlength=b.num_rows)
            text = _without(w, flag, removed, b.column(1)) if flag.any() else b.column(1)
            yield pa.RecordBatch.from_arrays([b.column(0), text, pa.array(w.count, pa.int32()), pa.array(removed, pa.int32())], names=["doc_id", "text", "n_words", "n_removed"])

    return marked.mapInArrow(C.trimmed(cut), f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, text string, n_words int, n_removed int")


def _without(w: Words, flag: np.ndarray, removed: np.ndarray, text: pa.Array) -> pa.Array:
    rows = text.to_pylist()
    for r in np.flatnonzero(removed):
        a, z = w.first[r], w.first[r + 1]
        f = flag[a:z]
        edge = np.flatnonzero(np.diff(np.concatenate([[False], f, [False]]).astype(np.int8)))
        raw, base, at, parts = w.data[w.off[r] : w.off[r + 1]].tobytes(), w.off[r], 0, []
        for x, y in edge.reshape(-1, 2):
            parts.append(raw[at : w.start[a + x] - base])
            at = w.end[a + y - 1] - base
        rows[r] = (b"".join(parts) + raw[at:]).decode()
    return pa.array(rows, pa.string())


def clean_documents(docs: DataFrame, benchmark: DataFrame, words: int = WORDS, coverage: float = COVERAGE, least: int = LEAST) -> DataFrame:
    """``docs`` with leaked spans cut from ``text`` and ``n_chars`` (if there) counted anew.

    A document whose words all leaked goes; all other rows and columns, of any name,
    stay: rows with null doc_id, repeated rows, and null, empty or wordless texts as they
    are; very long texts are searched whole. An empty benchmark changes nothing. No rows give no rows.
    """
    C.bounded_batches(docs.sparkSession)
    rest = [c for c in docs.columns if c != "text"]
    fields = F.struct(F.lit(0).alias("none"), *[F.col(f"`{c}`").alias(f"c{k}") for k, c in enumerate(rest)]).alias("rest")
    marked, sent = _marked(docs.select("text", fields), benchmark, words, coverage, least)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            w = Words(b.column(0))
            flag = _flags(b, w, sent and sent.value)
            removed = np.bincount(w.doc[flag], minlength=b.num_rows)
            if flag.any():
                b = b.set_column(0, "text", _without(w, flag, removed, b.column(0)))
            yield b.filter(pa.array((removed == 0) | (removed < w.count)))

    out = marked.mapInArrow(C.trimmed(cut), marked.schema)
    found = {c: F.col(f"rest.c{k}") for k, c in enumerate(rest)} | {"text": F.col("text")}
    if "n_chars" in found:
        found["n_chars"] = F.when(F.col("text").isNull(), found["n_chars"]).otherwise(F.length("text")).cast(docs.schema["n_chars"].dataType)
    return out.select(*[found[c].alias(c) for c in docs.columns])
