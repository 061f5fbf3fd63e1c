"""BPE training: an exact incremental trainer on the driver over a counted inventory.

Counting is distributed. A small inventory (distinct words) is collected; a larger one is
cut where no merge of the training can be (``cuts``), and its different parts are collected.
``plans.distributed`` trains without collecting anything. Byte training with the usual tie
break runs as compiled code in the driver's JVM (``kernel``) where a session is active,
all other training, and that without a session, in numpy, with the same results.
"""

from __future__ import annotations

import heapq
import math
from collections import defaultdict
from collections.abc import Iterable, Mapping, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mergeloom.functions import alphabets as A
from mergeloom.operators import cuts
from mergeloom.operators import inventory as I
from mergeloom.operators.kernel import Kernel
from mergeloom.plans import model as M

#: Symbols: a character that is no token of its own is its code point, token i is IDS + i. So characters come first.
IDS = 1 << 21
#: What stands where a symbol was merged into the one before it.
GONE = -1
TIE_BREAKS = ("smallest_pair_id", "largest_content")
#: Bytes of the words of a table that are collected as they are.
WHOLE = 8 << 20
#: Symbols and words that are looked at together when training begins.
AT_ONCE = 1 << 20
#: For how many steps more than asked and times as many a table is cut, and by what the floor is divided when that was too few.
AHEAD, SPARE, LOWER = 12, 1.1, 1.5


def rewrite(word: list[int], pair: tuple[int, int], target: int) -> tuple[list[int], dict[tuple[int, int], int]]:
    """The word with the pair replaced from left to right, and by how much each pair's count changed."""
    out, k, (a, b) = [], 0, pair
    while k < len(word):
        if k + 1 < len(word) and word[k] == a and word[k + 1] == b:
            out.append(target)
            k += 2
        else:
            out.append(word[k])
            k += 1
    change: dict[tuple[int, int], int] = defaultdict(int)
    for p in zip(word, word[1:]):
        change[p] -= 1
    for p in zip(out, out[1:]):
        change[p] += 1
    return out, {p: n for p, n in change.items() if n}


class _Greatest:
    """Orders contents from the greatest down."""

    __slots__ = ("content",)

    def __init__(self, content: tuple):
        self.content = content

    def __lt__(self, other: _Greatest) -> bool:
        return self.content > other.content

    def __eq__(self, other: object) -> bool:
        return isinstance(other, _Greatest) and self.content == other.content


def pair_key(left: int, right: int) -> int:
    """A pair as one number; keys are ordered as pairs are."""
    return left << 32 | right


def _groups(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(a stable order of the keys, where in it each distinct one begins)."""
    order = np.argsort(keys, kind="stable")
    k = keys[order]
    return order, np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]])) if len(k) else np.zeros(0, np.int64)


def _collected(table: DataFrame, kind: pa.DataType) -> tuple[pa.Array, np.ndarray]:
    """A table's two columns as arrays, the first one of this type."""
    t = table.toArrow().combine_chunks()
    col = t.column(0).cast(kind)
    return col.combine_chunks() if col.num_chunks != 1 else col.chunk(0), t.column(1).to_numpy()


class Chains:
    """All words as one array of symbols with links, and the frequency and places of each pair.

    A merge looks at the places of its pair alone; what it changes is added up by
    pair in numpy, so its cost is that of its occurrences, not of the inventory.
    """

    def __init__(self, symbol: np.ndarray, size: np.ndarray, weights: np.ndarray):
        n = len(symbol)
        self.symbol = symbol
        self.word, self.weights = np.repeat(np.arange(len(size), dtype=np.int32), size), weights
        self.next, self.before = np.arange(1, n + 1, dtype=np.int32), np.arange(-1, n - 1, dtype=np.int32)
        end = np.cumsum(size)[size > 0]
        self.next[end - 1] = -1
        self.before[np.concatenate([[0], end])[:-1]] = -1 if n else self.before[:0]
        self.freq: dict[int, int] = {}
        self.places: dict[int, list[np.ndarray]] = {}
        for at in range(0, n, AT_ONCE):
            left = (at + np.flatnonzero(self.next[at : at + AT_ONCE] >= 0)).astype(np.int32)
            self._note(self._keys(left), self._weight(left), left)

    def _keys(self, left: np.ndarray) -> np.ndarray:
        return self.symbol[left].astype(np.int64) << 32 | self.symbol[self.next[left]]

    def _weight(self, at: np.ndarray) -> np.ndarray:
        return self.weights[self.word[at]]

    def _note(self, keys: np.ndarray, weight: np.ndarray, place: np.ndarray) -> list[int]:
        """Adds weights by key, and places where they are not -1; the keys that grew."""
        order, begin = _groups(keys)
        if not len(begin):
            return []
        total = np.add.reduceat(weight[order], begin).tolist()
        place, grew = place[order], []
        for k, more, a, z in zip(keys[order][begin].tolist(), total, begin.tolist(), [*begin[1:].tolist(), len(keys)]):
            now = self.freq.get(k, 0) + more
            if now:
                self.freq[k] = now
            else:
                self.freq.pop(k, None)
            at = place[a:z]
            at = at[at >= 0] if at[0] < 0 or at[-1] < 0 else at
            if len(at):
                self.places.setdefault(k, []).append(at)
            if more > 0:
                grew.append(k)
        return grew

    def merge(self, left: int, right: int, target: int) -> list[int]:
        """Puts ``target`` wherever the pair is, from left to right; the pairs that became more frequent."""
        p = np.unique(np.concatenate(self.places.pop(pair_key(left, right), [np.zeros(0, np.int32)])))
        p = p[(self.symbol[p] == left) & (self.next[p] >= 0)]
        p = p[self.symbol[self.next[p]] == right]
        if left == right and len(p):  # of places that overlap, every second one
            first = np.concatenate([[True], p[1:] != self.next[p[:-1]]])
            run = np.flatnonzero(first)
            p = p[(np.arange(len(p)) - run[np.cumsum(first) - 1]) % 2 == 0]
        q = self.next[p]
        before, after = self.before[p], self.next[q]
        old = np.unique(np.concatenate([before[before >= 0], p, q[after >= 0]]))
        lost, lost_weight = self._keys(old), -self._weight(old)
        self.symbol[p], self.symbol[q] = target, GONE
        self.next[p] = after
        self.before[after[after >= 0]] = p[after >= 0]
        before = self.before[p]
        new = np.unique(np.concatenate([before[before >= 0], p[after >= 0]]))
        # what is lost comes first, so that a key's places are at the end of its group
        keys = np.concatenate([lost, self._keys(new)])
        return self._note(keys, np.concatenate([lost_weight, self._weight(new)]), np.concatenate([np.full(len(old), -1, np.int32), new]))


class BpeTrainer:
    """Special tokens have the first ids, then come the 256 bytes; then whatever is most frequent.

    Of equally frequent candidates a character comes before a pair; pairs follow
    the tie break. ``parallel_merge_min_occurs_in`` and ``hot_pair_window_size``
    are accepted for compatibility; results do not depend on them and nor does the work here.
    """

    def __init__(self, special_tokens: Sequence[str] = (), *, unit: str = "byte", initial_alphabet: str | None = None, tie_break: str | None = None, parallel_merge_min_occurs_in: int | None = None, hot_pair_window_size: int | None = None, bigram_cutoff_freq: int | None = None):
        M.check_unit(unit)
        if hot_pair_window_size is not None and hot_pair_window_size < 1:
            raise ValueError("hot_pair_window_size must be positive")
        if bigram_cutoff_freq is not None and bigram_cutoff_freq < 1:
            raise ValueError("bigram_cutoff_freq must be positive")
        if tie_break not in (None, *TIE_BREAKS):
            raise ValueError(f"Unknown tie break: {tie_break}")
        self.unit, self.tie_break, self.cutoff = unit, tie_break or TIE_BREAKS[0], bigram_cutoff_freq
        self.specials = list(special_tokens)
        self.alphabet = initial_alphabet or "raw"
        self.hot_pair_window_size = hot_pair_window_size
        order = A.byte_order(self.alphabet)
        self.tokens: list[bytes] = [s.encode() for s in self.specials] + [bytes([b]) for b in order]
        self._byte_id = {b: len(self.specials) + k for k, b in enumerate(order)}
        self.initial = len(self.tokens)
        #: (left symbol, right symbol, target id, freq)
        self.merges: list[tuple[int, int, int, int]] = []
        self.materialized: dict[int, int] = {}
        self._contents: dict[int, tuple] = {}
        self._words, self._weights = pa.array([], pa.large_string()), np.zeros(0, np.int64)
        self._chains: Chains | None = None
        self._kernel: Kernel | None = None
        #: an inventory that is not collected whole, how often its units are side by side, and the frequency down to which pairs are known
        self._table: DataFrame | None = None
        self._adjacent: DataFrame | None = None
        self._floor = self._made_before = 0
        self._frozen: frozenset[int] = frozenset()
        self._final = self._poisoned = False
        self._last_event = 0

    # --- state

    @property
    def vocab_size(self) -> int:
        return len(self.tokens)

    @property
    def vocab(self) -> dict[bytes, int]:
        return {t: i for i, t in enumerate(self.tokens)}

    @property
    def last_merge_freq(self) -> int | None:
        return self.merges[-1][3] if self.merges else None

    @property
    def hot_pair_window_stats(self) -> dict[str, int] | None:
        if self.hot_pair_window_size is None:
            return None
        return {"window_size": self.hot_pair_window_size, "resident_pairs": self._pairs(), "hydration_scans": 1, "batch_prunes": 0}

    def memory_usage(self) -> dict[str, int]:
        started = self._chains or self._kernel
        return {"words": len(self._words), "symbols": int(pa.compute.sum(pa.compute.binary_length(self._words)).as_py() or 0) if started else 0, "pairs": self._pairs()}

    def _pairs(self) -> int:
        return self._kernel.pairs() if self._kernel else len(self._chains.freq) if self._chains else 0

    def add_words(self, words: Mapping[str, int] | Iterable[tuple[str, int]]) -> None:
        """Replaces the inventory; words that come twice stay two rows; special tokens are skipped."""
        rows = list(words.items() if isinstance(words, Mapping) else words)
        self._take(pa.array([w for w, _ in rows], pa.large_string()), np.array([int(f) for _, f in rows], np.int64))

    def add_inventory(self, words: DataFrame) -> None:
        """The inventory of a (word, freq) table. Up to ``WHOLE`` bytes of words are brought to the driver as Arrow; of more, what training needs."""
        table = I.without(words.select("word", F.col("freq").cast("long").alias("freq")), self.specials).persist(StorageLevel.DISK_ONLY)
        if (table.agg(F.sum(F.octet_length("word"))).first()[0] or 0) <= WHOLE:
            self._take(*_collected(table, pa.large_string()))
            table.unpersist()
        else:
            self._take(pa.array([], pa.large_string()), np.zeros(0, np.int64))
            self._table, self._adjacent = table, cuts.adjacent(table, self.unit).persist(StorageLevel.DISK_ONLY)

    def _take(self, words: pa.Array, weights: np.ndarray) -> None:
        if self.specials:
            keep = pa.compute.invert(pa.compute.is_in(words, pa.array(self.specials, pa.large_string())))
            words, weights = words.filter(keep), weights[keep.to_numpy(zero_copy_only=False)]
        self._unkept()
        self._words, self._weights = words, weights
        self._table = self._adjacent = self._chains = self._kernel = None
        self._floor, self._made_before = 0, len(self.merges)

    def _unkept(self) -> None:
        """What is kept of a table on disk goes; should it be needed again, it is made again."""
        for x in (self._table, self._adjacent):
            if x is not None:
                x.unpersist()

    def _cut_table(self, floor: int) -> None:
        """Collects the parts of words in which all pairs of this frequency are. Pairs inside of tokens stay together whatever their frequency."""
        self._floor, self._words, self._chains, self._kernel, self._heap = floor, pa.array([], pa.large_binary()), None, None, []
        keep = [self._adjacent.where(F.col("freq") >= floor).select("pair").toArrow().column(0).to_numpy()]
        for t in self.tokens[self.initial :]:
            u = np.array(list(t if self.unit == "byte" else map(ord, A.lossy(t))), np.int64)
            keep.append(cuts.pair_codes(u[:-1], u[1:]))
        parts = cuts.cut(self._table, self.unit, np.unique(np.concatenate(keep)))
        self._words, self._weights = _collected(parts, pa.large_binary())

    def _guess(self, steps: int) -> int:
        """A floor under which this many more steps will hardly go."""
        n = AHEAD + round(SPARE * (max(AHEAD, steps) + len(self.tokens) - self.initial))
        top = self._adjacent.orderBy(F.desc("freq")).limit(n).select("freq").toArrow().column(0).to_numpy()
        return int(top.min()) if len(top) == n else 1

    def _lower(self) -> None:
        self._cut_table(max(1, int(self._floor / LOWER)))
        self.init_training()

    def _compiled(self) -> Kernel | None:
        """The loop in the JVM, if it can do this training."""
        spark = SparkSession.getActiveSession()
        if spark is None or self.unit != "byte" or self.tie_break != TIE_BREAKS[0] or self._made_before or self.merges and self._table is None or not len(self._words):
            return None
        _, ends, data = self._words.buffers()
        at = np.frombuffer(ends, np.int64, len(self._words) + 1, self._words.offset * 8)
        if at[-1] - at[0] >= 1 << 30:
            return None
        raw = (data or b"")[at[0] : at[-1]]
        kernel = Kernel(spark, raw if isinstance(raw, bytes) else raw.to_pybytes(), at[1:] - at[0], self._weights, [self._byte_id[b] for b in range(256)])
        if self.merges:  # of this inventory, cut anew: they are made once more
            again = kernel.train(len(self.merges), self.initial)
            assert [(IDS + a, IDS + b, f) for a, b, f in again] == [(a, b, f) for a, b, _, f in self.merges]
        return kernel

    def add_word_counter(self, counter) -> None:
        """Takes a counter's words; it is empty and reusable afterwards."""
        self.add_words(counter.take_counts())

    def _symbols(self) -> tuple[np.ndarray, np.ndarray]:
        """(symbols of all words, how many each word has)."""
        own, symbol, size = np.arange(256), [np.zeros(0, np.int32)], [np.zeros(0, np.int64)]
        for b, i in self._byte_id.items():
            own[b] = IDS + i if self.unit == "byte" or b < 128 else b
        for at in range(0, len(self._words), AT_ONCE >> 3):
            code, _, first = cuts.units(self._words.slice(at, AT_ONCE >> 3), self.unit)
            symbol.append(np.where(code < 256, own[np.minimum(code, 255)], code).astype(np.int32))
            size.append(np.diff(first))
        return np.concatenate(symbol), np.concatenate(size)

    def _content(self, s: int) -> tuple:
        got = self._contents.get(s)
        if got is None:
            if s < IDS:
                got = (s,)
            else:
                t = self.tokens[s - IDS]
                got = tuple(t) if self.unit == "byte" else A.units(t)
            self._contents[s] = got
        return got

    def _bytes(self, s: int) -> bytes:
        return chr(s).encode() if s < IDS else self.tokens[s - IDS]

    def _candidate(self, kind: int, key: int, freq: int) -> tuple:
        """An entry of the heap; kind 0 is a character, which is its own key, kind 1 a pair."""
        if self.tie_break == TIE_BREAKS[0]:
            return (-freq, kind, key)
        content = (self._content(key),) if kind == 0 else (self._content(key >> 32), self._content(key & 0xFFFFFFFF))
        return (-freq, kind, _Greatest(content), key)

    def _usable(self, key: int) -> bool:
        return not self._frozen or (key >> 32) not in self._frozen and (key & 0xFFFFFFFF) not in self._frozen

    def init_training(self, steps: int = 0) -> None:
        """Counts pairs and characters of the inventory as it is now; nothing to do for a finished trainer. ``steps``: how many will come."""
        if self._final or self._poisoned or self._kernel:
            return
        if self._table is not None and not self._floor:
            self._cut_table(self._guess(steps))
        self._chars: dict[int, int] = defaultdict(int) if self._chains is None else self._chars
        if self._chains is None:
            self._kernel = self._compiled()
            if self._kernel:
                return
            symbol, size = self._symbols()
            if self.unit == "unicode":
                own = np.flatnonzero(symbol < IDS)
                self._chars.update(zip(*(x.tolist() for x in cuts.summed(symbol[own], np.repeat(self._weights, size)[own]))))
            self._chains = Chains(symbol, size, self._weights)
            for a, b, t, _ in self.merges:  # an inventory that came, or was cut, after merges were made
                self._chains.merge(a, b, IDS + t)
        heap = [self._candidate(1, k, f) for k, f in self._chains.freq.items() if f > 0 and self._usable(k)]
        heap += [self._candidate(0, c, f) for c, f in self._chars.items() if f > 0 and c not in self.materialized and c not in self._frozen]
        heapq.heapify(heap)
        self._heap = heap

    def _best(self) -> tuple[int, int, int] | None:
        """(kind, key, freq) of the next candidate. Entries of pairs that became rarer are put right as they come up."""
        while self._heap:
            top = self._heap[0]
            kind, key, freq = top[1], top[-1], -top[0]
            if kind == 0:
                if key not in self.materialized and key not in self._frozen:
                    return kind, key, freq
            elif self._usable(key):
                now = self._chains.freq.get(key, 0)
                if now == freq:
                    return kind, key, freq
                if 0 < now < freq:
                    heapq.heapreplace(self._heap, self._candidate(1, key, now))
                    continue
            heapq.heappop(self._heap)
        return None

    def _apply(self, kind: int, key: int, freq: int) -> None:
        heapq.heappop(self._heap)
        new = len(self.tokens)
        self._last_event = freq
        if kind == 0:
            self.tokens.append(chr(key).encode())
            self.materialized[key] = new
            return
        left, right = key >> 32, key & 0xFFFFFFFF
        self.tokens.append(self._bytes(left) + self._bytes(right))
        self.merges.append((left, right, new, freq))
        known = self._chains.freq
        for k in self._chains.merge(left, right, IDS + new):
            f = known.get(k, 0)
            if f > 0 and self._usable(k):
                heapq.heappush(self._heap, self._candidate(1, k, f))

    # --- training

    def step(self) -> int:
        """One more token whatever its frequency; the new size of the vocabulary."""
        self._check_open()
        if self._chains is None:
            self.init_training()
        if not self._train(self.vocab_size + 1, 0):
            raise M.TrainStepError("no candidate is left")
        return self.vocab_size

    def _run_kernel(self, steps: int, cutoff: int) -> int:
        """That many merges or fewer; how many there were."""
        found = self._kernel.train(steps, self.vocab_size, cutoff)
        for left, right, freq in found:
            self.merges.append((IDS + left, IDS + right, len(self.tokens), freq))
            self.tokens.append(self.tokens[left] + self.tokens[right])
            self._last_event = freq
        return len(found)

    def _check_open(self) -> None:
        if self._poisoned:
            raise RuntimeError("training failed before; create a new trainer")
        if self._final:
            raise RuntimeError("the vocabulary is final; create a new trainer")

    def train(self, vocab_size: int) -> None:
        """Up to this size; stops before a pair under the cutoff. Progress stays when candidates run out (TrainStepError)."""
        if vocab_size <= self.vocab_size:
            return
        self._check_open()
        self.init_training(vocab_size - self.vocab_size)
        if not self._train(vocab_size, self.cutoff or 0):
            raise M.TrainStepError(f"no candidate is left at {self.vocab_size} tokens")

    def _train(self, vocab_size: int, cutoff: int) -> bool:
        """Up to this size or before a pair under the cutoff; False if candidates run out. Of a table, what is known is enough as long as the best is not under the floor."""
        try:
            while self.vocab_size < vocab_size:
                if self._kernel:
                    self._run_kernel(vocab_size - self.vocab_size, max(cutoff, self._floor))
                    if self.vocab_size == vocab_size:
                        break
                    kind, freq = 1, self._kernel.best()
                else:
                    best = self._best()
                    kind, freq = (best[0], best[2]) if best else (1, 0)
                    if best and freq >= self._floor and (kind == 0 or freq >= cutoff):
                        self._apply(*best)
                        continue
                if kind == 1 and freq and self._floor <= cutoff:
                    break
                if self._floor <= 1:
                    return False
                self._lower()
        finally:
            self._unkept()
        return True

    train_until = train

    def train_with_bbpe_fallback(self, vocab_size: int, *, primary_vocab_ratio: float = 0.9) -> None:
        """Unicode training for a part of the slots, then byte merges for the characters left over.

        The fallback trains on single characters, each weighted by its frequency, and
        takes no merge rarer than the last primary event; slots it leaves go back to
        the primary training. Merges of both are ranked by frequency, primary first.
        """
        if self.unit != "unicode":
            raise ValueError('bbpe_fallback requires unit="unicode": train_with_bbpe_fallback requires unit="unicode"')
        if not (math.isfinite(primary_vocab_ratio) and 0 <= primary_vocab_ratio <= 1):
            raise ValueError("primary_vocab_ratio must be finite and between 0 and 1")
        self._check_open()
        if primary_vocab_ratio == 1:
            return self.train(vocab_size)
        if self.vocab_size != self.initial:
            raise RuntimeError("the fallback must start before ordinary vocabulary growth")
        if vocab_size <= self.initial:
            return None
        try:
            self._fallback(vocab_size, primary_vocab_ratio)
        except Exception:
            self._poisoned = True
            raise
        self._final = True
        return None

    def _train_while_any(self, vocab_size: int) -> None:
        try:
            self.train(vocab_size)
        except M.TrainStepError:
            pass

    def _fallback(self, vocab_size: int, ratio: float) -> None:
        learned = vocab_size - self.initial
        primary = math.floor(learned * ratio)
        self.init_training(learned)
        self._train_while_any(self.initial + primary)
        least = max(self._last_event, self.cutoff or 0)
        left = {c: f for c, f in self._chars.items() if c not in self.materialized}
        self._frozen = frozenset(left)
        small = BpeTrainer(self.specials, unit="byte", initial_alphabet=self.alphabet, tie_break=self.tie_break, bigram_cutoff_freq=max(1, least))
        small.add_words([(chr(c), f) for c, f in sorted(left.items())])
        small._train_while_any(self.initial + learned - primary)
        self._train_while_any(vocab_size - len(small.merges))
        known = {t: i for i, t in enumerate(self.tokens)}
        number = {IDS + i: IDS + i for i in range(self.initial)}
        second = []
        for a, b, t, f in small.merges:
            token = small.tokens[t]
            if token in known:
                raise RuntimeError(f"fallback token {token!r} is in the vocabulary")
            number[IDS + t] = IDS + len(self.tokens)
            second.append((number[a], number[b], len(self.tokens), f))
            self.tokens.append(token)
        out, i, j = [], 0, 0
        while i < len(self.merges) or j < len(second):
            if j == len(second) or i < len(self.merges) and self.merges[i][3] >= second[j][3]:
                out.append(self.merges[i])
                i += 1
            else:
                out.append(second[j])
                j += 1
        self.merges = out

    # --- results

    def _merge_ids(self) -> list[tuple[int, int, int, int]]:
        one = lambda s: s - IDS if s >= IDS else self.materialized[s]
        return [(one(a), one(b), t, f) for a, b, t, f in self.merges]

    def validate_model(self) -> M.BpeModel:
        """A snapshot, if the model is sound; ValueError says what is not."""
        if self._poisoned:
            raise ValueError("training failed; the model is not usable")
        found = M.problems(self.unit, self.tokens, self._merge_ids(), self.initial, len(self.specials), self.cutoff, self.materialized.values())
        if found:
            raise ValueError("; ".join(found))
        merges = tuple(M.Merge(self._bytes(a), self._bytes(b), f) for a, b, _, f in self.merges)
        return M.BpeModel(self.unit, self.vocab, merges, tuple(self.specials))

    def finish(self):
        from mergeloom.operators.encoder import BpeEncoder

        return BpeEncoder.from_model(self.validate_model())

    def save_files(self, vocab_path, merges_path, *, format: str | None = None) -> None:
        M.resolve_format(self.unit, format)
        self.validate_model().save_files(vocab_path, merges_path, format=format)

    def save(self, name: str, *, outdir=".", format: str | None = None) -> None:
        M.resolve_format(self.unit, format)
        self.validate_model().save(name, outdir=outdir, format=format)
