"""Encoding and decoding: one word or text on the driver, whole tables on the executors.

A table is encoded where it lies: the model is broadcast, texts are split by Catalyst
expressions, and the pieces of an Arrow batch are dictionary-encoded, so that merges run
once for each distinct piece a worker meets and ids are gathered in numpy. Nothing is
shuffled. Decoding gathers the bytes of tokens in the same way.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mergeloom.functions import alphabets as A
from mergeloom.functions import patterns as P
from mergeloom.operators.pretokenizer import PreTokenizer
from mergeloom.plans import model as M

#: Distinct words a worker remembers; then it starts anew.
REMEMBERED = 300_000
#: Pieces of rows that are encoded at once.
AT_ONCE = 200_000
LONG_WORD = 32


class BpeEncoder:
    """Lowest rank first, from left to right; special tokens are found before the pattern is matched.

    Merges are pairs of contents in rank order, or ((left id, right id), target id); the latter may
    have any target, also one that an earlier merge takes as an operand.
    """

    def __init__(self, unit: str = "byte", *, special_tokens: Sequence[str] | None = None, merges: Sequence[tuple[bytes, bytes] | M.Merge] | None = None, vocab: dict[bytes, int] | None = None, pat_str: str | None = None, split_on_vocab_bigrams: bool = True, bigrams: Sequence[str] | None = None, mixed: str = "keep"):
        M.check_unit(unit)
        if vocab is None or merges is None:
            raise ValueError("vocab and merges are both needed")
        self.unit, self.vocab = unit, dict(vocab)
        self.by_id = {i: t for t, i in self.vocab.items()}
        by_id = [m for m in merges if not isinstance(m, M.Merge) and isinstance(m[0], tuple)]
        if by_id:
            if len(by_id) < len(merges):
                raise ValueError("merges are given by ids or by contents, not both")
            for rank, ((a, b), t) in enumerate(by_id):
                for i in (a, b, t):
                    if i not in self.by_id:
                        raise ValueError(f"merge {rank}: id {i} is not in the vocabulary")
            merges = [(self.by_id[a], self.by_id[b]) for (a, b), _ in by_id]
        self.merges = [(m.left, m.right) if isinstance(m, M.Merge) else (bytes(m[0]), bytes(m[1])) for m in merges]
        if special_tokens is None:
            special_tokens = self._leading_specials()
        self.special_tokens = list(special_tokens)
        self.special_ids = {}
        for s in self.special_tokens:
            if s.encode() not in self.vocab:
                raise ValueError(f"special token {s!r} is not in the vocabulary")
            self.special_ids[s] = self.vocab[s.encode()]
        if unit == "unicode":
            for t in self.vocab:
                if not A.is_canonical(t) and t.decode("utf-8", "replace") not in self.special_ids:
                    raise RuntimeError(f"vocabulary token {t!r} is not canonical Unicode content")
        self.ranks: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, ((a, b), t) in enumerate(by_id):
            self.ranks.setdefault((a, b), (rank, t))
        for rank, (a, b) in enumerate([] if by_id else self.merges):
            for part, name in ((a, "left operand"), (b, "right operand"), (a + b, "target")):
                if part not in self.vocab:
                    raise ValueError(f"merge {rank}: {name} {part!r} is not in the vocabulary")
            self.ranks.setdefault((self.vocab[a], self.vocab[b]), (rank, self.vocab[a + b]))
        #: characters that merges of bytes build: their words begin from bytes
        self._built = {a + b for a, b in self.merges if not A.is_canonical(a) or any(u >= A.BYTE_UNIT for u in A.units(a))}
        self.pretokenizer = PreTokenizer(self.special_tokens, pat_str=pat_str, unicode_bigrams=bigrams, unicode_bigram_mixed_boundary=mixed)
        # a target that is not its operands put together may cross any two units: then words are not cut
        self.can_split_on_vocab_bigrams = all(self.by_id[a] + self.by_id[b] == self.by_id[t] for (a, b), (_, t) in self.ranks.items())
        self.split_on_vocab_bigrams = split_on_vocab_bigrams and self.can_split_on_vocab_bigrams
        self._byte = {b: self.vocab[bytes([b])] for b in range(256) if bytes([b]) in self.vocab}
        self._known: dict[str, list[int]] = {}
        self._pairs: set | None = None

    @classmethod
    def from_model(cls, model: M.BpeModel, **how) -> BpeEncoder:
        return cls(model.unit, special_tokens=list(model.specials), merges=model.merges, vocab=model.vocab, **({"pat_str": model.pattern, "bigrams": model.bigrams, "mixed": model.mixed} | how))

    @classmethod
    def load(cls, name: str | None = None, *, unit: str = "byte", format: str | None = None, special_tokens: Sequence[str] | None = None, input_dir: str | Path | None = None, merges_file=None, vocab_file=None, pat_str: str | None = None, split_on_vocab_bigrams: bool = True) -> BpeEncoder:
        fmt = M.resolve_format(unit, format)
        where = Path(input_dir) if input_dir is not None else Path(".")
        if name is not None:
            vocab_file = vocab_file or M.find_file("vocab", name, unit, where).name
            merges_file = merges_file or M.find_file("merges", name, unit, where).name
        if vocab_file is None or merges_file is None:
            raise ValueError("vocab and merges are both needed")
        vocab = M.load_vocab_json(where / vocab_file, fmt, special_tokens or ())
        return cls(unit, special_tokens=special_tokens, merges=M.load_merges_txt(where / merges_file, fmt), vocab=vocab, pat_str=pat_str, split_on_vocab_bigrams=split_on_vocab_bigrams)

    def _leading_specials(self) -> list[str]:
        """Tokens of more than one unit with the first ids, before any of one unit."""
        out = []
        for i in sorted(self.by_id):
            t = self.by_id[i]
            if (len(t) if self.unit == "byte" else len(A.units(t))) <= 1 or i != len(out):
                break
            out.append(A.lossy(t))
        return out if len(out) < len(self.vocab) else []

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k not in ("_codes", "_flat", "_first", "_decoding")} | {"_known": {}}

    # --- words and texts

    def _initial(self, word: str) -> list[int]:
        out = []
        if self.unit == "byte":
            try:
                return [self._byte[b] for b in word.encode()]
            except KeyError as e:
                raise ValueError(f"byte {e.args[0]:#04x} of {word!r} is not in the vocabulary") from None
        parts = [c.encode() for c in word]
        for p in parts:
            i = None if len(p) > 1 and p in self._built else self.vocab.get(p)
            if i is not None:
                out.append(i)
                continue
            for b in p:
                i = self.vocab.get(bytes([b]))
                if i is None:
                    raise ValueError(f"byte {b:#04x} of {word!r} is not in the vocabulary")
                out.append(i)
        return out

    def encode_word(self, word: str, /) -> list[int]:
        """Merges alone: no pattern, no special token, and the vocabulary is not searched for the whole word."""
        ids, get = self._initial(word), self.ranks.get
        while True:
            pairs = [get(p) for p in zip(ids, ids[1:])]
            best = min(filter(None, pairs), default=None)
            if best is None:
                return ids
            out, k, at = [], 0, pairs.index(best)
            while True:
                out += ids[k:at]
                out.append(best[1])
                k = at + 2
                try:
                    at = pairs.index(best, k)
                except ValueError:
                    break
            ids = out + ids[k:]

    def _remembered(self, word: str) -> list[int]:
        got = self._known.get(word)
        if got is None:
            if len(self._known) >= REMEMBERED:
                self._known.clear()
            got = self._known[word] = self._word(word)
        return got

    def _cut(self, word: str) -> list[str]:
        """A long word cut where no token has the two units beside the cut (the ids are the same)."""
        if self.unit == "byte" and len(word) * 4 < LONG_WORD or len(word) < 2:
            return [word]
        if self._pairs is None:
            inner = [t for t in self.vocab if t.decode("utf-8", "replace") not in self.special_ids or t in {a + b for a, b in self.merges}]
            self._pairs = {p for t in inner for p in (zip(t, t[1:]) if self.unit == "byte" else zip(A.units(t), A.units(t)[1:]))}
        if self.unit == "byte":
            if len(word.encode()) < LONG_WORD:
                return [word]
            meet = [(word[k - 1].encode()[-1], word[k].encode()[0]) for k in range(1, len(word))]
        else:
            meet = [(ord(word[k - 1]), ord(word[k])) for k in range(1, len(word))]
        out, at = [], 0
        for k, p in enumerate(meet, 1):
            if p not in self._pairs:
                out.append(word[at:k])
                at = k
        return [*out, word[at:]]

    def words_of(self, text: str) -> dict[str, int]:
        """Words as they are encoded, cut at absent pairs too."""
        out: dict[str, int] = {}
        for p, special in self.pretokenizer.pieces_of(text):
            for w in [] if special else self._cut(p) if self.split_on_vocab_bigrams else [p]:
                out[w] = out.get(w, 0) + 1
        return out

    def encode_words(self, words: Sequence[str], /) -> list[list[int]]:
        return [list(self._remembered(w)) for w in words]

    def encode(self, text: str, /) -> list[int]:
        out: list[int] = []
        for p, special in self.pretokenizer.pieces_of(text):
            if special:
                out.append(self.special_ids[p])
            else:
                out += self._remembered(p)
        return out

    encode_string = encode

    def encode_to_numpy(self, text: str, /) -> np.ndarray:
        return np.array(self.encode(text), np.uint32)

    def encode_file(self, path: str | Path, num_chunks: int = 1024) -> np.ndarray:
        """Ids of a file in order, read by segments that end where ``auto`` boundaries do."""
        from mergeloom.sources.segments import boundaries, read_segment

        if num_chunks < 1:
            raise ValueError("num_chunks must be positive")
        parts = [self.encode_to_numpy(read_segment(path, a, n)) for a, n in boundaries(path, count=num_chunks, token=self.pretokenizer.eot_token)]
        return np.concatenate(parts) if parts else np.zeros(0, np.uint32)

    def pre_tokenizer(self) -> PreTokenizer:
        return self.pretokenizer

    def encode_file_with_cache(self, path: str | Path, words: Sequence[str], num_chunks: int = 1024) -> np.ndarray:
        """``encode_file`` with words known from the start."""
        return self.with_cache(words).encode_file(path, num_chunks)

    def with_cache(self, words: Sequence[str]) -> BpeEncoder:
        """Words known from the start."""
        self.encode_words(words)
        return self

    def tokens_of(self, ids: Sequence[int]) -> list[bytes]:
        try:
            return [self.by_id[int(i)] for i in ids]
        except KeyError as e:
            raise ValueError(f"id {e.args[0]} is not in the vocabulary") from None

    def decode(self, ids: Sequence[int] | np.ndarray, /) -> str:
        """Bytes of all tokens put together, then read as UTF-8 once."""
        if isinstance(ids, np.ndarray) and ids.dtype != np.uint32:
            raise TypeError("ids are a list or a uint32 array")
        if not isinstance(ids, (list, tuple, np.ndarray)):
            raise TypeError("ids are a list or a uint32 array")
        return A.lossy(b"".join(self.tokens_of(ids)))

    # --- tables

    def _marked(self, text: Column) -> Column:
        """Pieces of a text, each after a mark: 1 for a special token, 0 for others."""
        pre = self.pretokenizer
        cut = F.transform(P.pieces(text, pre.special_tokens, pre.pattern), lambda p: F.concat(F.when(p["is_special"], "1").otherwise("0"), p["piece"]))
        return cut if pre.bigrams is None else pre._segmented(cut)

    def _column(self, pieces: pa.ListArray) -> pa.Array:
        """Ids of rows of marked pieces, so many rows at once that memory is bounded, unless one row has more pieces."""
        count = np.cumsum(pa.compute.list_value_length(pieces).fill_null(0).to_numpy())
        out, at = [], 0
        while at < len(pieces):
            done = count[at - 1] if at else 0
            end = max(at + 1, int(np.searchsorted(count, done + AT_ONCE, "right")))
            out.append(self._rows(pieces.slice(at, end - at)))
            at = end
        return pa.concat_arrays(out) if out else self._rows(pieces)

    def _rows(self, pieces: pa.ListArray) -> pa.ListArray:
        """Ids of rows of marked pieces. What a worker has learned stays in ``_codes``, each piece with its place in ``_flat``."""
        if not hasattr(self, "_codes") or len(self._codes) > REMEMBERED:
            self._codes, self._flat, self._first = {}, np.zeros(0, np.int32), np.zeros(1, np.int64)
        flat = pieces.flatten().dictionary_encode()
        found = flat.dictionary.to_pylist()
        new = [p for p in found if p not in self._codes]
        if new:
            ids = [[self.special_ids[p[1:]]] if p[0] == "1" else self._word(p[1:]) for p in new]
            self._codes.update(zip(new, range(len(self._codes), len(self._codes) + len(new))))
            self._flat = np.concatenate([self._flat, np.fromiter((i for x in ids for i in x), np.int32)])
            self._first = np.concatenate([self._first, self._first[-1] + np.cumsum([len(x) for x in ids])])
        code = np.fromiter(map(self._codes.__getitem__, found), np.int64, len(found))[flat.indices.to_numpy()] if len(found) else np.zeros(0, np.int64)
        first = self._first[code]
        many = self._first[code + 1] - first
        end = np.cumsum(many)
        ids = self._flat[np.repeat(first - (end - many), many) + np.arange(end[-1] if len(end) else 0)]
        count = pa.compute.list_value_length(pieces).fill_null(0).to_numpy()
        rows = np.concatenate([[0], end])[np.concatenate([[0], np.cumsum(count)])]
        none = pa.array(pieces.is_null().to_numpy(zero_copy_only=False))
        return pa.ListArray.from_arrays(pa.array(rows.astype(np.int32)), pa.array(ids), mask=none)

    def _word(self, word: str) -> list[int]:
        parts = self._cut(word) if self.split_on_vocab_bigrams else [word]
        return self.encode_word(word) if len(parts) == 1 else [i for p in parts for i in self.encode_word(p)]

    def encode_table(self, docs: DataFrame, text: str = "text", ids: str = "ids") -> DataFrame:
        """All columns, the text replaced by its ids; a null text has null ids."""
        rest = [F.col(f"`{c}`") for c in docs.columns if c != text]
        return docs.select(*rest, self.ids_column(F.col(f"`{text}`"), docs.sparkSession).alias(ids))

    def ids_column(self, text: Column, session) -> Column:
        """array<int> of the ids of a text column."""
        sent = session.sparkContext.broadcast(self)

        @F.arrow_udf("array<int>")
        def run(pieces: pa.Array) -> pa.Array:
            return sent.value._column(pieces)

        return run(self._marked(text))

    def count_column(self, text: Column, session) -> Column:
        """Number of ids of a text column."""
        sent = session.sparkContext.broadcast(self)

        @F.arrow_udf("int")
        def run(pieces: pa.Array) -> pa.Array:
            return pa.compute.list_value_length(sent.value._column(pieces)).cast(pa.int32())

        return run(self._marked(text))

    def encode_word_table(self, words: DataFrame, word: str = "word") -> DataFrame:
        """(word, ids) of the distinct words of a table."""
        sent = words.sparkSession.sparkContext.broadcast(self)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(map(sent.value.encode_word, b.column(0).to_pylist()), pa.list_(pa.int32()))], names=["word", "ids"])

        return words.where(F.col(word).isNotNull()).select(F.col(word).alias("word")).distinct().mapInArrow(run, "word string, ids array<int>")

    def token_array(self) -> list[bytes]:
        size = max(self.by_id, default=-1) + 1
        return [self.by_id.get(i, b"") for i in range(size)]

    def _tokens(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(bytes of all tokens, where each id's begin, its characters read by itself, -1 for no token); made once a worker."""
        if not hasattr(self, "_decoding"):
            tokens = self.token_array()
            chars = [len(A.lossy(t)) if i in self.by_id else -1 for i, t in enumerate(tokens)]
            self._decoding = (np.frombuffer(b"".join(tokens), np.uint8), np.concatenate([[0], np.cumsum([len(t) for t in tokens])]).astype(np.int64), np.array(chars, np.int64))
        return self._decoding

    def _known_ids(self, col: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
        """(all ids of the rows, number of ids before each row); an id without a token is an error."""
        ids = col.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
        _, _, chars = self._tokens()
        bad = (ids < 0) | (ids >= len(chars))
        bad[~bad] = chars[ids[~bad]] < 0
        if bad.any():
            raise ValueError(f"id {ids[bad][0]} is not in the vocabulary")
        return ids, np.concatenate([[0], np.cumsum(pa.compute.list_value_length(col).fill_null(0).to_numpy())]).astype(np.int64)

    def _token_bytes(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(bytes of the tokens, where each begins)."""
        data, first, _ = self._tokens()
        many = first[ids + 1] - first[ids]
        end = np.cumsum(many)
        return data[np.repeat(first[ids] - (end - many), many) + np.arange(end[-1] if len(end) else 0)], np.concatenate([[0], end]).astype(np.int64)

    def _texts(self, col: pa.ListArray) -> pa.Array:
        """Texts of rows of ids, bytes of tokens put together and read as UTF-8 once."""
        ids, row = self._known_ids(col)
        data, at = self._token_bytes(ids)
        raw = pa.Array.from_buffers(pa.large_binary(), len(col), [None, pa.py_buffer(at[row]), pa.py_buffer(np.ascontiguousarray(data))])
        try:
            out = raw.cast(pa.large_string())
        except pa.ArrowInvalid:
            out = pa.array([A.lossy(x) for x in raw.to_pylist()], pa.large_string())
        return pa.compute.if_else(col.is_null(), pa.scalar(None, pa.large_string()), out).cast(pa.string())

    def text_column(self, ids: Column, session) -> Column:
        """The text of a column of ids."""
        sent = session.sparkContext.broadcast(self)

        @F.arrow_udf("string")
        def run(rows: pa.Array) -> pa.Array:
            return sent.value._texts(rows)

        return run(ids)

    def decode_table(self, encoded: DataFrame, ids: str = "ids", text: str = "text") -> DataFrame:
        """Ids back to text; an id without a token is an error; null ids have a null text."""
        rest = [F.col(f"`{c}`") for c in encoded.columns if c != ids]
        return encoded.select(*rest, self.text_column(F.col(f"`{ids}`"), encoded.sparkSession).alias(text))

    def id_columns(self, encoded: DataFrame, ids: str = "ids") -> DataFrame:
        """One row a token: the other columns, (pos, id, token, start): start is the character where it begins, each token read by itself."""
        sent = encoded.sparkSession.sparkContext.broadcast(self)
        rest = [c for c in encoded.columns if c != ids]

        @F.arrow_udf("array<binary>")
        def tokens(rows: pa.Array) -> pa.Array:
            known, row = sent.value._known_ids(rows)
            data, at = sent.value._token_bytes(known)
            raw = pa.Array.from_buffers(pa.large_binary(), len(known), [None, pa.py_buffer(at), pa.py_buffer(np.ascontiguousarray(data))]).cast(pa.binary())
            return pa.ListArray.from_arrays(pa.array(row.astype(np.int32)), raw)

        @F.arrow_udf("array<int>")
        def starts(rows: pa.Array) -> pa.Array:
            known, row = sent.value._known_ids(rows)
            size = sent.value._tokens()[2][known]
            before = np.cumsum(size) - size
            head = np.repeat(np.append(before, 0)[np.minimum(row[:-1], len(before))], np.diff(row))
            return pa.ListArray.from_arrays(pa.array(row.astype(np.int32)), pa.array((before - head).astype(np.int32)))

        each = F.arrays_zip(F.col(f"`{ids}`").alias("id"), tokens(F.col(f"`{ids}`")).alias("token"), starts(F.col(f"`{ids}`")).alias("start"))
        return encoded.select(*[F.col(f"`{c}`") for c in rest], F.posexplode(each).alias("pos", "x")).select(*[F.col(f"`{c}`") for c in rest], "pos", "x.id", "x.token", "x.start")
