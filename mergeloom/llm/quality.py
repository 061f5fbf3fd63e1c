"""Operator 7: a quality scorer trained on the posterior of weak labellers.

1. ``LABELLERS`` heuristics vote on every document: 1 (good), 0 (bad) or no vote.
2. Votes of all documents are counted by pattern, a table of at most
   3**labellers rows whatever the corpus holds. Expectation-maximisation on it
   (each labeller has an accuracy on good and one on bad documents, given that it
   votes) estimates the accuracies and the share of bad documents; each pattern then
   has a posterior.
3. The posteriors of a bounded sample (``sample`` documents of least hash) train a
   logistic scorer on hashed features of word shapes, their pairs and repeats, by
   frequency, so that a text of any length has a score of the same scale.
4. The scorer is broadcast (2**BITS weights) and goes over every document, whole.

No human label is read. Features are made in numpy from bytes of whole texts.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mergeloom.llm import common as C
from mergeloom.llm.tokens import LOWER, hash_ranges, slices, text_bytes

BITS = 16
SAMPLE = 20_000
LABELLERS = ("symbols", "capitals", "repeats", "variety", "word_length", "stop_words", "sentences")
STOP = "the of and to in is that for it with as was on be by this are or an at de la le et les des en que el los del se un una por con para est une du qui dans der die das und ist zu den von mit sich ein eine nicht auf im".split()
NONE = -1

#: Shape of a byte: a letter, a capital, a digit, the punctuation of sentences (each its own), other symbols.
SHAPE = np.full(256, ord("#"), np.uint8)
SHAPE[128:] = ord("a")
for _c in range(33):
    SHAPE[_c] = 32
for _a, _z, _s in ((48, 58, "0"), (65, 91, "A"), (97, 123, "a")):
    SHAPE[_a:_z] = ord(_s)
for _c in b".,;:!?'\"()-":
    SHAPE[_c] = _c
_STOP = np.sort(hash_ranges(np.frombuffer(" ".join(STOP).encode(), np.uint8), np.cumsum([0] + [len(w) + 1 for w in STOP[:-1]]), np.array([len(w) for w in STOP])))


class Parts:
    """Tokens (runs of anything but ASCII white space) of a column, with their hashes and shapes."""

    def __init__(self, col: pa.Array):
        data, off = text_bytes(col)
        self.rows, n = len(off) - 1, len(data)
        full = data > 32
        begins, ends = full.copy(), full.copy()
        begins[1:] &= ~full[:-1]
        ends[:-1] &= ~full[1:]
        edge = off[(off > 0) & (off < n)]
        begins[edge] = full[edge]
        ends[edge - 1] = full[edge - 1]
        self.start, self.end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
        self.first = np.searchsorted(self.start, off)
        self.count = np.diff(self.first)
        self.row = np.repeat(np.arange(self.rows), self.count)
        self.shape = SHAPE[data]
        low = LOWER[data]
        size = self.end - self.start
        self.hash = hash_ranges(low, self.start, size)
        #: first shape and the last three of each token, as one number
        s = self.shape
        self.key = s[self.start].astype(np.uint64) if len(self.start) else np.zeros(0, np.uint64)
        for k in (1, 2, 3):
            self.key = (self.key << np.uint64(8)) | np.where(size >= k, s[np.maximum(self.end - k, 0)], 0).astype(np.uint64)
        self.length = size
        self.again = np.zeros(len(size), bool)
        self.again[1:] = (self.hash[1:] == self.hash[:-1]) & (self.row[1:] == self.row[:-1])
        self.off = off

    def share(self, flag: np.ndarray) -> np.ndarray:
        """Part of each row's tokens for which the flag holds."""
        return np.bincount(self.row, weights=flag, minlength=self.rows) / np.maximum(self.count, 1)

    def bytes_of(self, *shapes: str) -> np.ndarray:
        """Bytes of each row with these shapes."""
        flag = np.isin(self.shape, [ord(x) for x in shapes])
        total = np.concatenate([[0], np.cumsum(flag, dtype=np.int64)])
        return total[self.off[1:]] - total[self.off[:-1]]

    def features(self) -> tuple[np.ndarray, np.ndarray]:
        """(row, feature) of every token: its shape, its shape with the one before, whether it repeats that one."""
        shape = C.mix(self.key + np.uint64(1)) >> np.uint64(64 - BITS)
        pair = C.mix(self.key[1:] * np.uint64(0x9E3779B97F4A7C15) + self.key[:-1]) >> np.uint64(64 - BITS)
        same = self.row[1:] == self.row[:-1]
        repeat = C.mix(self.again[1:].astype(np.uint64) + np.uint64(77)) >> np.uint64(64 - BITS)
        return np.concatenate([self.row, self.row[1:][same], self.row[1:][same]]), np.concatenate([shape, pair[same], repeat[same]]).astype(np.int64)


def votes(p: Parts) -> np.ndarray:
    """A row of votes for each row, in the order of LABELLERS."""
    n, out = p.count, np.full((p.rows, len(LABELLERS)), NONE, np.int8)

    def vote(k: int, who: np.ndarray, bad: np.ndarray, good: np.ndarray) -> None:
        out[who & bad, k] = 0
        out[who & good & ~bad, k] = 1

    some, many = n > 0, n >= 20
    symbols = p.bytes_of("#") / np.maximum(n, 1)
    vote(0, some, symbols > 0.25, symbols < 0.1)
    capital, letters = p.bytes_of("A"), p.bytes_of("A", "a")
    capitals = capital / np.maximum(letters, 1)
    vote(1, letters >= 20, capitals > 0.3, capitals < 0.2)
    repeats = p.share(p.again)
    vote(2, n >= 5, repeats > 0.2, repeats < 0.1)
    order = np.lexsort((p.hash, p.row))
    h, row = p.hash[order], p.row[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (row[1:] != row[:-1])
    variety = np.bincount(row[new], minlength=p.rows) / np.sqrt(np.maximum(n, 1))
    vote(3, many, variety < 2, variety > 3)
    length = p.bytes_of("a", "A", "0") / np.maximum(n, 1)
    vote(4, some, (length < 1.5) | (length > 25), (length > 2.5) & (length < 15))
    stop = p.share(np.isin(p.hash, _STOP))
    vote(5, many, stop < 0.02, stop > 0.08)
    final = p.share(np.isin(p.key >> np.uint64(16) & np.uint64(0xFF), [ord(x) for x in ".?!"]))
    vote(6, many, (final < 0.005) | (final > 0.5), (final > 0.02) & (final < 0.3))
    return out


def fit_labellers(patterns: np.ndarray, counts: np.ndarray, rounds: int = 100) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """EM over distinct vote patterns: (share of each class, P(vote 1 | class) of each labeller, P(good) of each pattern).

    It starts from the labellers' agreement: a pattern with any vote for bad
    leans to bad by the part of its votes that say so.
    """
    voted, ones = patterns != NONE, patterns == 1
    cast = voted.sum(axis=1)
    good = np.where(cast > 0, (ones.sum(axis=1) + 0.5) / (cast + 1.0), 0.5) ** 2
    prior, rate = np.full(2, 0.5), np.full((2, patterns.shape[1]), 0.5)
    for _ in range(rounds):
        w = np.stack([(1 - good) * counts, good * counts])
        prior = (w.sum(axis=1) + 1) / (w.sum() + 2)
        yes, no = w @ ones, w @ (voted & ~ones)
        # a labeller is right more often than wrong to begin with: one vote that says so
        rate = (yes + np.array([[0.5], [1.5]])) / (yes + no + 2)
        log = np.log(prior)[:, None] + np.log(rate) @ ones.T + np.log(1 - rate) @ (voted & ~ones).T
        now = 1 / (1 + np.exp(np.clip(log[0] - log[1], -500, 500)))
        if np.abs(now - good).max(initial=0) < 1e-9:
            break
        good = now
    return prior, rate, good


@dataclass
class Scorer:
    weights: np.ndarray
    bias: float

    def score(self, p: Parts) -> np.ndarray:
        """P(good) of each row; 0 for a row without tokens."""
        row, feature = p.features()
        z = self.bias + np.bincount(row, weights=self.weights[feature], minlength=p.rows) / np.maximum(p.count, 1)
        return np.where(p.count > 0, 1 / (1 + np.exp(-np.clip(z, -500, 500))), 0.0)


def train_scorer(rows: list[tuple[np.ndarray, np.ndarray]], target: np.ndarray, epochs: int = 30, rate: float = 0.5, l2: float = 1e-6) -> Scorer:
    """Logistic regression by Adagrad over (features, frequencies) of documents and their posteriors."""
    weights, grad2, bias, bias2 = np.zeros(1 << BITS), np.full(1 << BITS, 1e-8), 0.0, 1e-8
    turn = np.random.default_rng(0)
    for _ in range(epochs if rows else 0):
        for batch in np.array_split(turn.permutation(len(rows)), max(1, len(rows) // 128)):
            size = [len(rows[i][0]) for i in batch]
            f, x = np.concatenate([rows[i][0] for i in batch]), np.concatenate([rows[i][1] for i in batch])
            at = np.repeat(np.arange(len(batch)), size)
            z = bias + np.bincount(at, weights=weights[f] * x, minlength=len(batch))
            g = (1 / (1 + np.exp(-np.clip(z, -500, 500))) - target[batch]) / len(batch)
            step = np.bincount(f, weights=g[at] * x, minlength=1 << BITS) + l2 * weights
            grad2 += step * step
            weights -= rate * step / np.sqrt(grad2)
            bias2 += g.sum() ** 2
            bias -= rate * g.sum() / np.sqrt(bias2)
    return Scorer(weights, float(bias))


def fit(docs: DataFrame, sample: int = SAMPLE) -> Scorer:
    """The scorer of a corpus. EM sees the votes of all documents, the scorer ``sample`` different ones at most."""
    spark = docs.sparkSession
    C.bounded_batches(spark)

    def cast(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            v = votes(Parts(b.column(0)))
            code = ((v + 1).astype(np.int32) * 3 ** np.arange(len(LABELLERS), dtype=np.int32)).sum(axis=1)
            kinds, many = np.unique(code, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(kinds, pa.int32()), pa.array(many, pa.int64())], names=["pattern", "n"])

    found = docs.select("text").mapInArrow(C.trimmed(cast), "pattern int, n long").groupBy("pattern").agg(F.sum("n").alias("n")).orderBy("pattern").collect()
    code = np.array([r.pattern for r in found], np.int64)
    patterns = (code[:, None] // 3 ** np.arange(len(LABELLERS)) % 3 - 1).astype(np.int8).reshape(len(code), len(LABELLERS))
    _, _, good = fit_labellers(patterns, np.array([r.n for r in found], float))
    posterior = dict(zip(code.tolist(), good.tolist()))

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            p = Parts(b.column(1))
            code = ((votes(p) + 1).astype(np.int64) * 3 ** np.arange(len(LABELLERS))).sum(axis=1)
            row, feature = p.features()
            key, many = np.unique((row << BITS) | feature, return_counts=True)
            cut = np.searchsorted(key, np.arange(p.rows + 1) << BITS)
            out = [(h, posterior[int(c)], (key[a:z] & ((1 << BITS) - 1)).astype("<u4").tobytes(), (many[a:z] / max(1, n)).astype("<f4").tobytes()) for h, c, n, a, z in zip(b.column(0).to_pylist(), code, p.count, cut[:-1], cut[1:]) if n]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (pa.int64(), pa.float64(), pa.binary(), pa.binary()))], names=["h", "good", "features", "values"])

    hashed = docs.select(F.xxhash64("doc_id", "text").alias("h"), "text").where("text is not null")
    most = hashed.select("h").orderBy("h").limit(sample).agg(F.max("h")).first()[0]
    if most is None:
        return Scorer(np.zeros(1 << BITS), 0.0)
    # measured where the texts lie; equal rows are one
    rows = hashed.where(F.col("h") <= F.lit(most)).mapInArrow(C.trimmed(measure), "h long, good double, features binary, values binary").dropDuplicates(["h"]).collect()
    rows.sort(key=lambda r: (bytes(r.features), bytes(r["values"])))
    return train_scorer([(np.frombuffer(r.features, "<u4").astype(np.int64), np.frombuffer(r["values"], "<f4").astype(float)) for r in rows], np.array([r.good for r in rows]))


def scores(docs: DataFrame, sample: int = SAMPLE, threshold: float = 0.5) -> DataFrame:
    """(doc_id, score, keep): every document with P(good); ``keep`` where it is ``threshold`` or more.

    Defined cases: a null, empty or blank text has score 0 and is not kept; a null
    doc_id stays null; repeated rows each have their score and count once in the
    sample; a very long text is scored whole, by frequencies; other columns are not
    read. No rows give no rows.
    """
    return _with_scores(docs.select("doc_id", "text"), fit(docs, sample)).select("doc_id", "score", (F.col("score") >= threshold).alias("keep"))


def _with_scores(docs: DataFrame, scorer: Scorer) -> DataFrame:
    """``docs`` (whose text is not named otherwise) with a column ``score``."""
    order = [c for c in docs.columns if c != "text"]
    sent = docs.sparkSession.sparkContext.broadcast(scorer)
    packed = docs.select("text", F.struct(*[F.col(f"`{c}`") for c in order]).alias("rest"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(sent.value.score(Parts(b.column(0))))], names=["text", "rest", "score"])

    out = packed.mapInArrow(C.trimmed(run), packed.select("*", F.lit(0.0).alias("score")).schema)
    return out.select("score", *[(F.col("text") if c == "text" else F.col(f"rest.`{c}`")).alias(c) for c in docs.columns])


def keep_good(docs: DataFrame, sample: int = SAMPLE, threshold: float = 0.5) -> DataFrame:
    """``docs`` without the rows that score under ``threshold``; all columns stay (one named ``score`` too).

    The defined cases are those of ``scores``: null, empty and blank texts go, rows with
    null doc_id and repeated rows stay or go by their text.
    """
    names = [f"c{k}" if c != "text" else c for k, c in enumerate(docs.columns)]
    scored = _with_scores(docs.toDF(*names), fit(docs, sample))
    return scored.where(F.col("score") >= threshold).select(*[F.col(n).alias(c) for n, c in zip(names, docs.columns)])
