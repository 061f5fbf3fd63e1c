"""An encoding by ranks, with the method names that users of rank files know, and a registry."""

from __future__ import annotations

from collections.abc import Collection, Mapping, Sequence
from itertools import accumulate
from pathlib import Path
from typing import Literal

import numpy as np
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mergeloom.functions import alphabets as A
from mergeloom.functions import patterns as P
from mergeloom.operators.encoder import BpeEncoder
from mergeloom.plans import model as M

EOT = P.END_OF_TEXT
ALL: Literal["all"] = "all"


def merges_from_ranks(ranks: Mapping[bytes, int]) -> list[tuple[bytes, bytes]]:
    """For each token in rank order, the split into two earlier tokens whose later part is earliest."""
    out = []
    for token, rank in sorted(ranks.items(), key=lambda x: x[1]):
        splits = []
        for k in range(1, len(token)):
            a, b = ranks.get(token[:k]), ranks.get(token[k:])
            if a is not None and b is not None and max(a, b) < rank:
                splits.append((max(a, b), min(a, b), k))
        if splits:
            k = min(splits)[2]
            out.append((token[:k], token[k:]))
    return out


def raise_disallowed_special_token(token: str) -> None:
    raise ValueError(f"the text holds the special token {token!r}; allow it by allowed_special, or treat it as text by disallowed_special=()")


class Encoding:
    def __init__(self, name: str, *, pat_str: str | None = None, mergeable_ranks: Mapping[bytes, int] | None = None, special_tokens: Mapping[str, int] | None = None, explicit_n_vocab: int | None = None, unit: str = "byte", merges: Sequence[tuple[bytes, bytes]] | None = None):
        self.name, self.unit = name, unit
        self.ranks, self.specials = dict(mergeable_ranks or {}), dict(special_tokens or {})
        self.token_bytes = {i: t for t, i in self.ranks.items()} | {i: s.encode() for s, i in self.specials.items()}
        if explicit_n_vocab is not None:
            if len(self.ranks) + len(self.specials) != explicit_n_vocab or self.max_token_value != explicit_n_vocab - 1:
                raise ValueError(f"the vocabulary does not have the {explicit_n_vocab} tokens stated")
        merges = list(merges) if merges is not None else merges_from_ranks(self.ranks)
        vocab = {t: i for i, t in self.token_bytes.items()}
        self._with_specials = BpeEncoder(unit, special_tokens=list(self.specials), merges=merges, vocab=vocab, pat_str=pat_str)
        self._ordinary = BpeEncoder(unit, special_tokens=[], merges=merges, vocab=vocab, pat_str=pat_str)

    @classmethod
    def from_files(cls, name: str, *, vocab_file: str | Path, merges_file: str | Path, special_tokens: Mapping[str, int] | None = None, pat_str: str | None = None, unit: str = "byte", format: str | None = None) -> Encoding:
        fmt = M.resolve_format(unit, format)
        vocab = M.load_vocab_json(vocab_file, fmt, list(special_tokens or {}))
        merges = [(m.left, m.right) for m in M.load_merges_txt(merges_file, fmt)]
        ranks = {t: i for t, i in vocab.items() if t.decode("utf-8", "ignore") not in (special_tokens or {})}
        return cls(name, pat_str=pat_str, mergeable_ranks=ranks, special_tokens=special_tokens, unit=unit, merges=merges)

    def __repr__(self) -> str:
        return f"<Encoding {self.name!r}>"

    # --- vocabulary

    @property
    def special_tokens_set(self) -> set[str]:
        return set(self.specials)

    @property
    def eot_token(self) -> int:
        return self.specials[EOT]

    @property
    def max_token_value(self) -> int:
        return max(self.token_bytes, default=-1)

    @property
    def n_vocab(self) -> int:
        return self.max_token_value + 1

    def is_special_token(self, token: int) -> bool:
        return token in self.specials.values()

    def token_byte_values(self) -> list[bytes]:
        """Bytes of all tokens, special ones too, in the order of their ids."""
        return [self.token_bytes[i] for i in sorted(self.token_bytes)]

    # --- encoding

    def _banned(self, allowed: Collection[str] | str, disallowed: Collection[str] | str) -> list[str]:
        """Special tokens that a text may not hold: those disallowed, without those allowed."""
        if allowed == ALL:
            return []
        return sorted((self.special_tokens_set if disallowed == ALL else set(disallowed)) - set(allowed))

    def _check(self, text: str, allowed: Collection[str] | str, disallowed: Collection[str] | str) -> bool:
        """Whether special tokens are to be found; a disallowed one in the text is an error."""
        banned = self._banned(allowed, disallowed)
        if banned and (m := regex.search(P.any_of(banned), text)):
            raise_disallowed_special_token(m.group())
        return allowed == ALL or bool(set(allowed))

    def encode_ordinary(self, text: str) -> list[int]:
        return self._ordinary.encode(text)

    def encode(self, text: str, *, allowed_special: Collection[str] | str = (), disallowed_special: Collection[str] | str = ALL) -> list[int]:
        """If any special token is allowed, all of them are found (others are errors first, by default)."""
        return (self._with_specials if self._check(text, allowed_special, disallowed_special) else self._ordinary).encode(text)

    def encode_to_numpy(self, text: str, **policy) -> np.ndarray:
        return np.array(self.encode(text, **policy), np.uint32)

    def encode_batch(self, texts: Sequence[str], *, num_threads: int = 8, **policy) -> list[list[int]]:
        return [self.encode(t, **policy) for t in texts]

    def encode_ordinary_batch(self, texts: Sequence[str], *, num_threads: int = 8) -> list[list[int]]:
        return [self.encode_ordinary(t) for t in texts]

    def encode_with_unstable(self, text: str, **policy) -> tuple[list[int], list[list[int]]]:
        return self.encode(text, **policy), []

    def encode_single_token(self, token: str | bytes) -> int:
        raw = token.encode() if isinstance(token, str) else token
        found = [i for t, i in (*self.ranks.items(), *((s.encode(), i) for s, i in self.specials.items())) if t == raw]
        if not found:
            raise KeyError(token)
        return min(found)

    # --- decoding

    def decode_single_token_bytes(self, token: int) -> bytes:
        return self.token_bytes[token]

    def decode_tokens_bytes(self, tokens: Sequence[int]) -> list[bytes]:
        return [self.token_bytes[int(t)] for t in tokens]

    def decode_bytes(self, tokens: Sequence[int]) -> bytes:
        return b"".join(self.decode_tokens_bytes(tokens))

    def decode(self, tokens: Sequence[int], errors: str = "replace") -> str:
        return self.decode_bytes(tokens).decode("utf-8", errors)

    def decode_with_offsets(self, tokens: Sequence[int]) -> tuple[str, list[int]]:
        """The texts of the tokens, read one by one and put together, and the character at which each begins."""
        parts = [A.lossy(t) for t in self.decode_tokens_bytes(tokens)]
        starts = [0, *accumulate(map(len, parts))]
        return "".join(parts), starts[: len(parts)]

    def decode_batch(self, batch: Sequence[Sequence[int]], *, errors: str = "replace", num_threads: int = 8) -> list[str]:
        return [self.decode(b, errors) for b in batch]

    def decode_bytes_batch(self, batch: Sequence[Sequence[int]], *, num_threads: int = 8) -> list[bytes]:
        return [self.decode_bytes(b) for b in batch]

    # --- tables

    def encode_table(self, docs: DataFrame, text: str = "text", ids: str = "ids", *, allowed_special: Collection[str] | str = (), disallowed_special: Collection[str] | str = ALL) -> DataFrame:
        """Texts to ids; a row with a disallowed special token fails the job, as the single-text method raises."""
        banned = self._banned(allowed_special, disallowed_special)
        checked = docs.withColumn(text, guarded(F.col(text), banned)) if banned else docs
        return (self._with_specials if allowed_special == ALL or set(allowed_special) else self._ordinary).encode_table(checked, text, ids)

    def decode_table(self, encoded: DataFrame, ids: str = "ids", text: str = "text") -> DataFrame:
        return self._with_specials.decode_table(encoded, ids, text)


def guarded(text: Column, banned: Sequence[str]) -> Column:
    """The text; an error where it holds one of these."""
    out = text
    for s in banned:
        out = F.when(F.contains(text, F.lit(s)), F.raise_error(F.lit(f"the text holds the special token {s}"))).otherwise(out)
    return out


# --- registry -------------------------------------------------------------------


class Registry:
    """Encodings by name, from ``vocab.NAME.json`` and ``merges.NAME.txt`` in a directory."""

    def __init__(self, directory: str | Path = ".", models: Mapping[str, str] | None = None, prefixes: Mapping[str, str] | None = None):
        self.directory, self.models, self.prefixes = Path(directory), dict(models or {}), dict(prefixes or {})
        self._loaded: dict[str, Encoding] = {}

    def list_encoding_names(self) -> list[str]:
        names = (p.name[len("vocab.") : -len(".json")] for p in self.directory.glob("vocab.*.json"))
        return sorted(n for n in names if (self.directory / f"merges.{n}.txt").exists())

    def get_encoding(self, name: str) -> Encoding:
        if name not in self._loaded:
            if name not in self.list_encoding_names():
                raise ValueError(f"Unknown encoding {name!r}")
            self._loaded[name] = Encoding.from_files(name, vocab_file=self.directory / f"vocab.{name}.json", merges_file=self.directory / f"merges.{name}.txt", special_tokens={EOT: 0})
        return self._loaded[name]

    def encoding_name_for_model(self, model: str) -> str:
        if model in self.models:
            return self.models[model]
        for prefix, name in self.prefixes.items():
            if model.startswith(prefix):
                return name
        if model in self.list_encoding_names():
            return model
        raise KeyError(f"no encoding is known for {model}")

    def encoding_for_model(self, model: str) -> Encoding:
        return self.get_encoding(self.encoding_name_for_model(model))
