"""Operator 5: repeats by blockwise suffix sorting with a difference-cover sample.

The text of a document is read as a sequence of symbols, one at each word: the 64-bit
code of the ``gram`` words from there on, whose leading bits are those of the least
hash among the gram's short grams, its anchor. A suffix is the sequence of symbols
from a word to the end. Two suffixes share their first ``length`` words just if they
share their first ``depth`` = length - gram + 1 symbols, and dedup asks no more, so
suffixes are sorted to that depth, symbol by symbol, as numbers.

1. Text that can't repeat goes: every stretch of ``length`` words has an anchor, chosen
   from its words alone (winnowing), and a stretch whose anchor is found at one place
   only has no equal. What is left are intervals of documents.
2. Blocks are ranges of the first symbol. Neighbours often have the same anchor and so
   lie in one block; they are sent as one run with the symbols that follow it. Equal
   runs of one slice of documents are sent once, with their first and last places.
3. Cover sample. A difference cover D of period v has, for any two positions i and j, a
   shift s < v with i + s and j + s both in the sample (position mod v in D). The
   sample of each block is sorted by prefix doubling in memory, to every depth from
   depth - v + 1 to depth, and its ranks go back to their slices.
4. All suffixes come again to their blocks, with the ranks of the |D| sample suffixes
   that follow each. They are sorted by their first v symbols by doubling. Longer ties
   are sorted by quicksort in three parts, all groups of ties at once: i and j compare
   as the ranks of i + s and j + s to depth - s symbols, which lie in one block since
   the ties share v symbols. So a comparison costs one look-up, however long the tie.
5. Suffixes that are equal to the depth are repeats. Runs of them are spans.

A block in memory is BUCKET_BYTES of text and holds a run once for each slice that has
it, not for each document: a passage that is everywhere costs a block as many entries as
there are slices of 4 MB.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from mergeloom.llm import common as C
from mergeloom.llm import substring as S
from mergeloom.llm.tokens import Words, slices, window_hash

#: Perfect difference sets: every residue mod v is a difference of two members.
COVERS = {3: (0, 1), 7: (1, 2, 4), 13: (0, 1, 3, 9), 21: (3, 6, 7, 12, 14)}
PERIOD = 7
#: Leading bits of a symbol that are its anchor's.
ANCHOR_BITS = 24
#: What is kept of a slice: its runs in the order of the text (``base``: where the symbols of each begin),
#: the first and last run and the number of symbols of each entry, and the symbols of all intervals.
PARTS = {"ids": "<i8", "local": "<u2", "pos": "<u4", "begin": "<u4", "base": "<u4", "n": "<u4", "c": "<u4", "entry": "<u4", "head": "<u4", "tail": "<u4", "m": "<u4", "symbols": "<u8"}
SLICE = "slice long, " + ", ".join(f"{x} binary" for x in PARTS)


def cover(v: int) -> np.ndarray:
    """Flags of the residues in the cover, checked to be one."""
    flag = np.zeros(v, bool)
    flag[[x % v for x in COVERS[v]]] = True
    on = np.flatnonzero(flag)
    if len({(a - b) % v for a in on for b in on}) != v:
        raise ValueError(f"no difference cover for period {v}")
    return flag


class Shifts:
    """Where the sample lies after a position: ``ahead[r]`` are the shifts < v from residue r into the cover,
    ``slot[r, q]`` which of r's shifts is the one common to r and q."""

    def __init__(self, v: int):
        self.v, self.flag = v, cover(v)
        self.ahead = np.array([[s for s in range(v) if self.flag[(r + s) % v]] for r in range(v)])
        self.slot = np.zeros((v, v), np.int64)
        for r in range(v):
            for q in range(v):
                both = set(self.ahead[r]) & set(self.ahead[q])
                self.slot[r, q] = list(self.ahead[r]).index(min(both))


def ranked(x: np.ndarray) -> np.ndarray:
    """Dense ranks, from 1 on."""
    order = np.argsort(x, kind="stable")
    y = x[order]
    out = np.empty(len(x), np.uint64)
    out[order] = np.cumsum(np.concatenate([[1], y[1:] != y[:-1]])).astype(np.uint64) if len(x) else 0
    return out


class Doubling:
    """Ranks of the stretches of 1, 2, 3, ... symbols from each place on; a run's end is less than any symbol."""

    def __init__(self, symbol: np.ndarray, m: np.ndarray):
        """Runs of ``m`` symbols each, one after another."""
        self.end = np.repeat(np.cumsum(m), m)
        self.at = np.arange(len(symbol))
        self.of = {1: ranked(symbol)}

    def ranks(self, d: int) -> np.ndarray:
        if d not in self.of:
            half = 1 << (d - 1).bit_length() - 1
            left = self.ranks(half)
            on = self.at + d - half
            right = np.where(on < self.end, left[np.minimum(on, len(left) - 1)], 0)
            self.of[d] = ranked((left << np.uint64(32)) | right)
        return self.of[d]


def sort_ties(group: np.ndarray, residue: np.ndarray, ranks: np.ndarray, shifts: Shifts) -> tuple[np.ndarray, np.ndarray]:
    """(order, class of each suffix): ``group`` sorts the suffixes by their first v symbols; ties
    are sorted by the ranks at the common shift, by quicksort in three parts over all groups at once."""
    order = np.argsort(group, kind="stable")
    g = group[order]
    first = np.concatenate([[True], g[1:] != g[:-1]]) if len(g) else np.zeros(0, bool)
    begin = np.flatnonzero(first)
    many = np.diff(np.append(begin, len(g)))
    bound = first.copy()  # where a class of equal suffixes begins
    begin, many = begin[many > 1], many[many > 1]
    while len(begin):
        at = S.spread(begin, many)
        part = np.repeat(np.arange(len(begin)), many)
        mine, pivot = order[at], order[begin + many // 2][part]
        r, q = residue[mine], residue[pivot]
        x, y = ranks[mine, shifts.slot[r, q]], ranks[pivot, shifts.slot[q, r]]
        third = 1 + (x > y).astype(np.int64) - (x < y)
        third[mine == pivot] = 1
        to = np.argsort(part * 3 + third, kind="stable")
        order[at] = mine[to]
        key = (part * 3 + third)[to]
        cut = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        bound[at[cut]] = True
        size = np.diff(np.append(cut, len(key)))
        again = (key[cut] % 3 != 1) & (size > 1)
        begin, many = at[cut][again], size[again]
    out = np.empty(len(order), np.int64)
    out[order] = np.cumsum(bound)
    return order, out


def symbols(words: Words, gram: int) -> np.ndarray:
    """The symbol at each word; it means nothing where a row has fewer than ``gram`` words left."""
    low = window_hash(words.hash, gram)
    k = min(8, gram)
    short = window_hash(words.hash, k)
    if not len(low):
        return low
    least = S.sliding_min(short, gram - k + 1)
    keep = np.uint64(64 - ANCHOR_BITS)
    return ((C.mix(least) >> keep) << keep) | (low >> np.uint64(ANCHOR_BITS))


def block_of(symbol: np.ndarray, nb: int) -> np.ndarray:
    """The number of the range that a symbol is in."""
    return (((symbol >> np.uint64(32)) * np.uint64(nb)) >> np.uint64(32)).astype(np.int32)


def runs_of(words: Words, flag: np.ndarray, ids: np.ndarray, depth: int, symbol: np.ndarray, v: int, nb: int) -> list[np.ndarray]:
    """PARTS of a slice; ``flag``: words at which a stretch begins that may repeat.

    A run is of consecutive words of one interval of such stretches whose symbols are in one
    block: n suffixes, the first c of which are candidates; those after them are sample
    suffixes that candidates compare by. Runs with equal symbols as far as any candidate
    looks, and equal position mod v, are one entry.
    """
    at = np.flatnonzero(flag)
    new = np.concatenate([[True], (np.diff(at) > 1) | (np.diff(words.doc[at]) > 0)])
    a, z = at[new], at[np.append(np.flatnonzero(new)[1:], len(at)) - 1]
    many = z - a + v
    where, last = S.spread(a, many), np.repeat(z, many)
    block = block_of(symbol[where], nb)
    cut = np.flatnonzero(np.concatenate([[True], (np.diff(last) != 0) | (np.diff(block) != 0)]))
    n, begin, last = np.diff(np.append(cut, len(where))), where[cut], last[cut]
    c = np.clip(last + 1 - begin, 0, n)
    # the last candidate of an interval looks at the symbols before ``last + depth``
    m = np.minimum(n + depth - 1 + v - 1, last + depth - begin)
    held = z - a + depth  # symbols of each interval
    base = begin + (np.cumsum(held) - held - a)[np.searchsorted(z, last)]
    row = words.doc[begin]
    pos = begin - words.first[row]
    taken = symbol[S.spread(begin, m)]
    offset = (np.arange(len(taken)) - np.repeat(np.cumsum(m) - m, m)).astype(np.uint64)
    h = np.add.reduceat(C.mix(taken + offset * np.uint64(0x9E3779B97F4A7C15)), np.cumsum(m) - m)
    h = C.mix(h + (pos % v + v * (c + (n << 28))).astype(np.uint64))
    order = np.lexsort((pos, ids[row], h))
    first = np.flatnonzero(np.concatenate([[True], h[order][1:] != h[order][:-1]]))
    entry = np.empty(len(order), np.int64)
    entry[order] = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(order))))
    head, tail = order[first], order[np.append(first[1:], len(order)) - 1]
    return [ids, row, pos, begin, base, n, c, entry, head, tail, m[head], symbol[S.spread(a, held)]]


def slices_of(t: pa.Table | pa.RecordBatch, *names: str) -> Iterator[list]:
    """[slice, parts...] of each row."""
    return S.parts_of(t, {c: PARTS[c] for c in names})


def suffix_repeats(docs: DataFrame, length: int = S.LENGTH, gram: int | None = None, period: int = PERIOD) -> DataFrame:
    """(doc_id, start_word, n_words, is_first): maximal runs of words in which every
    ``length`` words also occur at another position of any document, this one included.

    Runs are cut where ``is_first`` changes; it is true where no other occurrence
    has a smaller (doc_id, start). ``gram`` words are a symbol, by default as many as
    leave 2 * period + 1 symbols.

    Defined cases: null or short texts have no span; a very long text is a slice of its
    own, handled whole; rows with null doc_id are left out; rows that share a doc_id
    are one document, and equal positions of theirs are one; ``doc_id`` is a whole
    number, others are an error; other columns are not read; no rows give no rows.
    """
    gram = max(1, length - 2 * period) if gram is None else gram
    depth, k = length - gram + 1, min(S.GRAM, length)
    if not 0 < gram <= length or not 1 < period < depth:
        raise ValueError("0 < gram and 1 < period < length - gram + 1 must hold")
    shifts = Shifts(period)
    C.bounded_batches(docs.sparkSession)
    texts = S.texts_of(docs)
    nb = C.bucket_count(texts)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 33
        for b in slices(batches):
            words = Words(b.column(1))
            at, anchor, _ = S.anchors(words, length, k)
            flag = np.zeros(len(words.hash), bool)
            if len(at):
                flag[at] = S.flagged(words, b.column(2).to_pylist())[anchor]
            if flag.any():
                parts = runs_of(words, flag, b.column(0).to_numpy(), depth, symbols(words, gram), period, nb)
                yield pa.RecordBatch.from_arrays([pa.array([number], pa.int64())] + [pa.array([x.astype(d).tobytes()], pa.binary()) for x, d in zip(parts, PARTS.values())], names=["slice", *PARTS])
                number += 1

    held = C.stored(S.with_hits(texts, S.met_anchors(texts, length, k, nb, False)).mapInArrow(C.trimmed(cut), SLICE))

    def send_sample(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for number, pos, base, n, head, m, symbol in slices_of(b, "pos", "base", "n", "head", "m", "symbols"):
                n, at = n[head], base[head]
                size, rows = np.minimum(m, n + depth - 1), []
                for block, i in C.split_by(block_of(symbol[at], nb)):
                    rows.append((block, C.pack(np.array([number], "<i8"), n[i].astype("<u4"), size[i].astype("<u4"), (pos[head[i]] % period).astype("u1"), symbol[S.spread(at[i], size[i])])))
                yield C.blob_batch(rows)

    ranks = C.exchange(held.select("slice", "pos", "base", "n", "head", "m", "symbols").mapInArrow(C.trimmed(send_sample), C.BLOB), lambda x: rank_sample(x, shifts, depth, nb), "slice long, block int, ranks binary")

    def send_suffixes(t: pa.Table, found: pa.Table) -> pa.Table:
        """The candidates of a slice with the ranks after them, for their blocks."""
        known, rows = dict(zip(found.column("block").to_pylist(), found.column("ranks").to_pylist())), []
        for number, ids, local, pos, begin, base, n, c, entry, head, tail, _, symbol in slices_of(t, *PARTS):
            at = base[head]
            blocks = list(C.split_by(block_of(symbol[at], nb)))
            # ranks of the sample suffixes of each entry, then at the words of all runs
            base = np.cumsum(n[head]) - n[head]
            rank, less = np.zeros(int(n[head].sum()), np.uint32), np.zeros((int(n[head].sum()), period), np.uint32)
            for block, i in blocks:
                r, d = C.unpack(known[block], "<u4", "<u4")
                own = S.spread(base[i], n[head[i]])
                own = own[shifts.flag[(own - np.repeat(base[i], n[head[i]]) + np.repeat(pos[head[i]], n[head[i]])) % period]]
                rank[own] = r
                less[own, 1:] = d.reshape(period - 1, -1).T
            where, of = S.spread(begin, n), S.spread(base[entry], n)
            order = np.argsort(where, kind="stable")  # where intervals overlap, the later one looks further
            final = np.append(where[order][1:] != where[order][:-1], True)
            where, of = where[order][final], of[order][final]
            for block, i in blocks:
                i = i[c[head[i]] > 0]
                if not len(i):
                    continue
                h = head[i]
                size = c[h] + period - 1
                far = of[np.searchsorted(where, S.spread(begin[h], size))]
                start = np.cumsum(size) - size
                mine = S.spread(start, c[h])
                residue = (np.repeat(pos[h], c[h]) + mine - np.repeat(start, c[h])) % period
                step = shifts.ahead[residue]
                sample = shifts.flag[(np.repeat(pos[h], size) + np.arange(len(far)) - np.repeat(start, size)) % period]
                delta = less[far[mine[:, None] + step], step]
                rows.append((block, C.pack(np.array([number], "<i8"), c[h].astype("<u4"), (pos[h] % period).astype("u1"), ids[local[h]], pos[h].astype("<u4"), ids[local[tail[i]]], pos[tail[i]].astype("<u4"), symbol[S.spread(at[i], size)], rank[far[sample]], np.ascontiguousarray(delta.T).reshape(-1))))
        return pa.Table.from_batches([C.blob_batch(rows)])

    sent = held.groupBy("slice").cogroup(ranks.groupBy("slice")).applyInArrow(send_suffixes, C.BLOB)
    flags = C.exchange(sent, lambda x: sort_block(x, shifts, nb), S.FLAGS)

    return S.spans(held.mapInArrow(lambda batches: _without_symbols(batches, nb), S.LAST_SCHEMA), flags, nb, length)


def _without_symbols(batches: Iterator[pa.RecordBatch], nb: int) -> Iterator[pa.RecordBatch]:
    """For the last step: the block of each entry in place of its symbols."""
    for b in batches:
        block = [block_of(symbol[base[head]], nb).astype("<u4").tobytes() for _, base, head, symbol in slices_of(b, "base", "head", "symbols")]
        yield pa.RecordBatch.from_arrays([b.column(b.schema.get_field_index(c)) for c in ("slice", *S.LAST) if c != "block"] + [pa.array(block, pa.binary())], names=["slice", *S.LAST])


def rank_sample(blobs: list[bytes], shifts: Shifts, depth: int, nb: int) -> pa.Table:
    """Runs of a block -> ranks of its sample suffixes for each slice.

    A rank is by all ``depth`` symbols; with it goes, for s = 1 to v - 1, how far below it
    the least rank is of those that share depth - s symbols.
    """
    v = shifts.v
    number, n, m, residue, symbol = C.gather(blobs, "<i8", "<u4", "<u4", "u1", "<u8")
    block = int(block_of(symbol[0][:1], nb)[0])
    size = [len(x) for x in n]
    n, m, residue, symbol = (np.concatenate(x) for x in (n, m, residue, symbol))
    n, m = n.astype(np.int64), m.astype(np.int64)
    base = np.cumsum(m) - m
    at = S.spread(base, n)
    take = shifts.flag[(np.repeat(residue, n) + at - np.repeat(base, n)) % v]
    at, run = at[take], np.repeat(np.arange(len(n)), n)[take]
    doubling = Doubling(symbol, m)
    full = ranked(doubling.ranks(depth)[at])
    order = np.argsort(full, kind="stable")
    less = np.zeros((v - 1, len(at)), np.uint32)
    for s in range(1, v):
        level = doubling.ranks(depth - s)[at][order]
        begin = np.flatnonzero(np.concatenate([[True], level[1:] != level[:-1]])) if len(level) else np.zeros(0, np.int64)
        least = np.repeat(full[order][begin], np.diff(np.append(begin, len(level))))
        less[s - 1, order] = (full[order] - least).astype(np.uint32)
    of = np.searchsorted(np.cumsum(size), run, side="right")
    cut = np.searchsorted(of, np.arange(len(size) + 1))
    out = [C.pack(full[a:z].astype("<u4"), np.ascontiguousarray(less[:, a:z]).reshape(-1)) for a, z in zip(cut[:-1], cut[1:])]
    return pa.table({"slice": np.concatenate(number), "block": pa.array([block] * len(out), pa.int32()), "ranks": pa.array(out, pa.binary())})


def sort_block(blobs: list[bytes], shifts: Shifts, nb: int) -> pa.Table:
    """Candidates of a block, with the ranks of their sample suffixes -> which are repeats, and which the first of theirs."""
    v, slots = shifts.v, shifts.ahead.shape[1]
    number, c, residue, doc, pos, last, last_pos, symbol, rank, less = C.gather(blobs, "<i8", "<u4", "u1", "<i8", "<u4", "<i8", "<u4", "<u8", "<u4", "<u4")
    block = int(block_of(symbol[0][:1], nb)[0])
    count = [int(x.sum()) for x in c]
    less = np.concatenate([x.reshape(slots, -1) for x in less], axis=1)
    c, residue, doc, pos, last, last_pos, symbol, rank = (np.concatenate(x) for x in (c, residue, doc, pos, last, last_pos, symbol, rank))
    c = c.astype(np.int64)
    m = c + v - 1
    base = np.cumsum(m) - m
    at = S.spread(base, c)
    step = at - np.repeat(base, c)
    group = Doubling(symbol, m).ranks(v)[at]
    own = np.repeat(residue, c)
    own = (own + step) % v
    flat = np.zeros(len(symbol), np.int64)
    flat[shifts.flag[(np.repeat(residue, m) + np.arange(len(symbol)) - np.repeat(base, m)) % v]] = rank
    ranks = flat[at[:, None] + shifts.ahead[own]] - less.T
    order, same = sort_ties(group, own, ranks, shifts)
    _, who = np.unique(np.concatenate([doc, last]), return_inverse=True)
    place = [(np.repeat(w, c).astype(np.uint64) << np.uint64(32)) | (np.repeat(p, c) + step).astype(np.uint64) for w, p in ((who[: len(doc)], pos), (who[len(doc) :], last_pos))]
    begin = np.flatnonzero(np.concatenate([[True], same[order][1:] != same[order][:-1]]))
    many = np.diff(np.append(begin, len(order)))
    least, most = np.minimum.reduceat(place[0][order], begin), np.maximum.reduceat(place[1][order], begin)
    again, first = np.empty(len(order), bool), np.empty(len(order), bool)
    again[order] = np.repeat(least != most, many)
    first[order] = place[0][order] == np.repeat(least, many)
    return S.flag_rows(np.concatenate(number), block, count, again, first)
