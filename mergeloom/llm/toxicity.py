"""Operator 2: a toxicity classifier that is regularised by counterfactuals.

Features are hashed: the words of a text, and their first 4 and 5 bytes (so that
inflected and made-up forms of a stem meet), each present or not. A labelled text
that names a group has twins, in which every identity term is exchanged for
another one of its set, as many as it takes for each term to meet all others of its set. Training minimises

    mean log loss(x, y) + ``fairness`` * mean (score(twin) - score(x))**2 + ``l1`` |w|

so a term of itself can neither raise nor lower a score against its
alternatives, and what the labels say of the rest of the text remains. Only
features that a G test ties to the label take part, and ``l1`` leaves few of these,
so chance words of very long texts don't add up.

It is trained on the driver from ``sample`` labelled rows of least hash (hashed
features, not texts, are sent there) and applied to whole texts in numpy.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mergeloom.llm import common as C
from mergeloom.llm.tokens import Words, hash_ranges, slices

BITS = 20
SAMPLE, FAIRNESS, L1 = 20_000, 1.0, 3e-5
#: Sets of terms, each of which could stand in another's place.
IDENTITIES = (
    ("muslim", "christian", "jewish", "hindu", "buddhist", "sikh", "catholic", "protestant", "atheist"),
    ("muslims", "christians", "jews", "hindus", "buddhists", "sikhs", "catholics", "protestants", "atheists"),
    ("black", "white", "asian", "latino", "hispanic", "arab", "african", "european", "indigenous"),
    ("gay", "lesbian", "bisexual", "transgender", "queer", "straight", "heterosexual"),
    ("women", "men"), ("woman", "man"), ("female", "male"), ("girls", "boys"),
    ("immigrants", "refugees", "foreigners", "natives", "migrants"), ("immigrant", "refugee", "foreigner", "native", "migrant"),
    ("deaf", "blind", "disabled", "autistic"), ("old", "young", "elderly"),
    ("frauen", "männer"), ("femmes", "hommes"), ("mujeres", "hombres"),
)


def _hashed(word: np.ndarray, low: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Three features of each word, a row each."""
    out = [C.mix(word)]
    for k in (4, 5):
        out.append(C.mix(hash_ranges(low, start, np.minimum(size, k)) + np.uint64(k)))
    return (np.stack(out) >> np.uint64(64 - BITS)).astype(np.int64)


class Twins:
    """Identity terms by hash, with the features of what takes their place."""

    def __init__(self, sets: Sequence[Sequence[str]]):
        self.shifts = max([0, *(len(s) - 1 for s in sets)])
        words = [[Words(pa.array([t])) for t in s] for s in sets]
        if any(len(w.hash) != 1 for s in words for w in s):
            raise ValueError("an identity term is one word")
        table = {}
        for s in words:
            feats = [_hashed(w.hash, w.low, w.start, w.end - w.start)[:, 0] for w in s]
            for k, w in enumerate(s):
                table[int(w.hash[0])] = [feats[(k + j % (len(s) - 1) + 1) % len(s)] if len(s) > 1 else feats[k] for j in range(self.shifts)]
        self.hash = np.array(sorted(table), np.uint64)
        self.other = np.array([table[int(h)] for h in self.hash]).reshape(len(self.hash), self.shifts, 3)

    def index(self, word: np.ndarray) -> np.ndarray:
        """Number of the term that each word is, or -1."""
        if not len(self.hash):
            return np.full(len(word), -1)
        k = np.minimum(np.searchsorted(self.hash, word), len(self.hash) - 1)
        return np.where(self.hash[k] == word, k, -1)


@dataclass
class Sample:
    """A labelled text: its features, and for each twin what it has more and less."""

    toxic: int
    features: np.ndarray
    twins: list[tuple[np.ndarray, np.ndarray]]


def samples(col: pa.Array, toxic: list[int], twins: Twins) -> Iterator[Sample]:
    w = Words(col)
    f = _hashed(w.hash, w.low, w.start, w.end - w.start)
    term = twins.index(w.hash)
    for r, y in enumerate(toxic):
        a, z = w.first[r], w.first[r + 1]
        own, t = np.unique(f[:, a:z]), term[a:z]
        pairs = []
        if (t >= 0).any():
            rest = f[:, a:z][:, t < 0].reshape(-1)
            for j in range(twins.shifts):
                twin = np.unique(np.concatenate([rest, twins.other[t[t >= 0], j].reshape(-1)]))
                pairs.append((np.setdiff1d(twin, own), np.setdiff1d(own, twin)))
        yield Sample(y, own, pairs)


@dataclass
class Classifier:
    weights: np.ndarray
    bias: float

    def score(self, col: pa.Array) -> np.ndarray:
        """P(toxic) of each text."""
        w = Words(col)
        f = _hashed(w.hash, w.low, w.start, w.end - w.start)
        row, f = np.tile(w.doc.astype(np.int64), 3), f.reshape(-1)
        heavy = self.weights[f] != 0
        key = np.unique((row[heavy] << BITS) | f[heavy])
        z = self.bias + np.bincount(key >> BITS, weights=self.weights[key & ((1 << BITS) - 1)], minlength=len(w.count))
        return 1 / (1 + np.exp(-np.clip(z, -500, 500)))


def _telling(rows: list[Sample], y: np.ndarray, least: float) -> np.ndarray:
    """Features whose presence depends on the label (G test over ``least``), and all that a twin changes."""
    size = 1 << BITS
    n, k = np.zeros(size), np.zeros(size)
    for a in range(0, len(rows), 1000):  # few at a time: all features together would fill the driver's memory
        f = np.concatenate([r.features for r in rows[a : a + 1000]])
        n += np.bincount(f, minlength=size)
        k += np.bincount(f, weights=np.repeat(y[a : a + 1000], [len(r.features) for r in rows[a : a + 1000]]), minlength=size)
    total, toxic = float(len(rows)), float(y.sum())

    def part(seen: np.ndarray, hoped: np.ndarray) -> np.ndarray:
        return np.where(seen > 0, seen * np.log(np.maximum(seen, 1) / np.maximum(hoped, 1e-12)), 0.0)

    rest = total - n
    g = part(k, n * toxic / total) + part(n - k, n * (total - toxic) / total) + part(toxic - k, rest * toxic / total) + part(rest - toxic + k, rest * (total - toxic) / total)
    keep = 2 * g > least
    for r in rows:
        for pair in r.twins:
            for x in pair:
                keep[x] = True
    return np.flatnonzero(keep)


def train(rows: list[Sample], fairness: float = FAIRNESS, l1: float = L1, least: float = 15.0, rounds: int = 600) -> Classifier:
    """Accelerated proximal gradient on the features that tell something (G statistic over ``least``)."""
    size = 1 << BITS
    y = np.array([s.toxic for s in rows], float)
    if not 0 < y.sum() < len(y):
        return Classifier(np.zeros(size), 20.0 if len(y) and y[0] else -20.0)
    used = _telling(rows, y, least)
    number = np.full(size, -1)
    number[used] = np.arange(len(used))

    def pick(lists: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        found = [number[x] for x in lists]
        found = [x[x >= 0] for x in found]
        return np.repeat(np.arange(len(lists)), [len(x) for x in found]), np.concatenate([np.zeros(0, np.int64), *found])

    at, f = pick([s.features for s in rows])
    twins = [t for s in rows for t in s.twins]
    more_at, more = pick([t[0] for t in twins])
    less_at, less = pick([t[1] for t in twins])
    twin_at, twin_f = np.concatenate([more_at, less_at]), np.concatenate([more, less])
    sign = np.concatenate([np.ones(len(more)), -np.ones(len(less))])
    n, m, t = len(rows), len(used), max(1, len(twins))
    # rare features count as much as frequent ones: columns are brought to one curvature
    bent = np.bincount(f, minlength=m) / n + 8 * fairness / t * np.bincount(twin_f, minlength=m)
    scale = 1 / np.sqrt(np.maximum(bent, 1 / n))

    def curve(v: np.ndarray) -> np.ndarray:
        """A bound of the second derivative, times v; the last entry is the bias."""
        u = v[:-1] * scale
        z = np.bincount(at, weights=u[f], minlength=n) + v[-1]
        d = np.bincount(twin_at, weights=u[twin_f] * sign, minlength=t)
        out = np.bincount(f, weights=z[at], minlength=m) / (4 * n) + 2 * fairness / t * np.bincount(twin_f, weights=d[twin_at] * sign, minlength=m)
        return np.append(scale * out, z.sum() / (4 * n))

    v = np.ones(m + 1)
    for _ in range(30):
        v = curve(v)
        bound = float(np.linalg.norm(v))
        v /= bound
    eta = 1 / (1.1 * bound)
    w, ahead, pace = np.zeros(m + 1), np.zeros(m + 1), 1.0
    for _ in range(rounds):
        u = ahead[:-1] * scale
        z = np.bincount(at, weights=u[f], minlength=n) + ahead[-1]
        g = (1 / (1 + np.exp(-np.clip(z, -500, 500))) - y) / n
        d = np.bincount(twin_at, weights=u[twin_f] * sign, minlength=t)
        step = np.bincount(f, weights=g[at], minlength=m) + 2 * fairness / t * np.bincount(twin_f, weights=d[twin_at] * sign, minlength=m)
        new = ahead - eta * np.append(scale * step, g.sum())
        new[:-1] = np.sign(new[:-1]) * np.maximum(0, np.abs(new[:-1]) - eta * l1)
        faster = (1 + (1 + 4 * pace * pace) ** 0.5) / 2
        ahead = new + (pace - 1) / faster * (new - w)
        w, pace = new, faster
    weights = np.zeros(size)
    weights[used] = w[:-1] * scale
    return Classifier(weights, float(w[-1]))


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, identities: Sequence[Sequence[str]] = IDENTITIES, fairness: float = FAIRNESS, l1: float = L1) -> Classifier:
    """The classifier of the labelled rows of ``docs``; ``labels`` has doc_id and toxic (0 or 1)."""
    C.bounded_batches(docs.sparkSession)
    known = labels.where("doc_id is not null and toxic is not null").groupBy(F.col("doc_id").cast("long").alias("__id")).agg(F.max(F.col("toxic").cast("int")).alias("__toxic"))
    taken = C.stored(known.orderBy(F.xxhash64("__id"), "__id").limit(sample))
    twins = Twins(identities)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            out = []
            for s in samples(b.column(0), b.column(1).to_pylist(), twins):
                pairs = [x.astype("<u4").tobytes() for t in s.twins for x in t]
                out.append((s.toxic, s.features.astype("<u4").tobytes(), pairs))
            y, f, t = zip(*out)
            yield pa.RecordBatch.from_arrays([pa.array(y, pa.int32()), pa.array(f, pa.binary()), pa.array(t, pa.list_(pa.binary()))], names=["toxic", "features", "twins"])

    texts = docs.select(F.col("doc_id").cast("long").alias("__id"), "text").where("text is not null")
    got = texts.join(C.small_side(taken), "__id").select("text", "__toxic").mapInArrow(C.trimmed(measure), "toxic int, features binary, twins array<binary>").toArrow()
    rows = []
    for y, f, t in sorted(zip(*(got.column(c).to_pylist() for c in ("toxic", "features", "twins"))), key=lambda r: (r[1], r[0])):
        t = [np.frombuffer(x, "<u4") for x in t]
        rows.append(Sample(y, np.frombuffer(f, "<u4"), list(zip(t[::2], t[1::2]))))
    del got
    return train(rows, fairness, l1)


def toxic_scores(docs: DataFrame, labels: DataFrame, threshold: float = 0.5, **how) -> DataFrame:
    """(doc_id, score, toxic): every document with P(toxic); ``toxic`` where it is ``threshold`` or more.

    Defined cases: a null, empty or wordless text has the score of no feature, which
    rests on the bias alone; a null doc_id stays null; repeated rows each have their
    score; a doc_id labelled twice is toxic if one label says so; null labels and
    labels without a document are left out; with labels of one class only, or none,
    scores are about 1 if that class is toxic and about 0 if not; a very long text is
    scored whole, and as a labelled row it sends its different features (2**BITS at most)
    to the driver; ``doc_id`` is a whole number, others are an error; other columns are
    not read. No rows give no rows.
    """
    sent = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, **how))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(sent.value.score(b.column(1)))], names=["doc_id", "score"])

    scored = docs.select("doc_id", "text").mapInArrow(C.trimmed(run), f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, score double")
    return scored.withColumn("toxic", F.col("score") >= threshold)
