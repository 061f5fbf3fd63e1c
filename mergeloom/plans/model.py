"""A trained model: vocabulary and ranked merges, its checks, and its files."""

from __future__ import annotations

import json
from collections.abc import Iterable, Sequence
from dataclasses import dataclass, field
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from mergeloom.functions import alphabets as A

UNITS = ("byte", "unicode")
#: File formats: printable characters for byte models, escaped text for both.
PRINTABLE, ESCAPED = "gpt2", "escaped"
#: Other names under which a unit is known in file names.
UNIT_NAMES = {"byte": ("byte", "u8"), "unicode": ("unicode", "char")}


class TrainStepError(RuntimeError):
    """No candidate is left to merge."""


@dataclass(frozen=True)
class Merge:
    left: bytes
    right: bytes
    freq: int = 0


def check_unit(unit: str) -> None:
    if unit not in UNITS:
        raise ValueError(f"Unknown unit: {unit}")


def resolve_format(unit: str, fmt: str | None) -> str:
    check_unit(unit)
    fmt = fmt or (ESCAPED if unit == "unicode" else PRINTABLE)
    if fmt not in (PRINTABLE, ESCAPED):
        raise ValueError(f"Unknown format: {fmt}")
    if unit == "unicode" and fmt == PRINTABLE:
        raise ValueError(f'format="{PRINTABLE}" is not compatible with unit="unicode"')
    return fmt


def _show(token: bytes, fmt: str) -> str:
    return A.printable(token) if fmt == PRINTABLE else A.escaped(token)


def _parse(text: str, fmt: str) -> bytes:
    return A.from_printable(text) if fmt == PRINTABLE else A.from_escaped(text)


@dataclass(frozen=True)
class BpeModel:
    """An immutable snapshot; ``vocab`` has ids by token, ``merges`` are in rank order."""

    unit: str
    vocab: dict[bytes, int]
    merges: tuple[Merge, ...]
    specials: tuple[str, ...] = ()
    pattern: str | None = None
    bigrams: tuple[str, ...] | None = None
    mixed: str = "keep"
    extra: dict = field(default_factory=dict)

    @property
    def last_merge_freq(self) -> int | None:
        return self.merges[-1].freq if self.merges else None

    # --- files

    def save_vocab_json(self, path: str | Path, *, format: str | None = None) -> None:
        fmt = resolve_format(self.unit, format)
        specials = {s.encode() for s in self.specials}
        rows = {(t.decode() if t in specials else _show(t, fmt)): i for t, i in sorted(self.vocab.items(), key=lambda x: x[1])}
        Path(path).write_text(json.dumps(rows, ensure_ascii=False, indent=2) + "\n", encoding="utf-8")

    def save_merges_txt(self, path: str | Path, *, format: str | None = None) -> None:
        fmt = resolve_format(self.unit, format)
        Path(path).write_text("".join(f"{_show(m.left, fmt)} {_show(m.right, fmt)} => {m.freq}\n" for m in self.merges), encoding="utf-8")

    def save_files(self, vocab_path: str | Path, merges_path: str | Path, *, format: str | None = None) -> None:
        resolve_format(self.unit, format)
        self.save_vocab_json(vocab_path, format=format)
        self.save_merges_txt(merges_path, format=format)

    def save(self, name: str, *, outdir: str | Path = ".", format: str | None = None) -> None:
        self.save_files(Path(outdir) / f"vocab.{name}[{self.unit}].json", Path(outdir) / f"merges.{name}[{self.unit}].txt", format=format)

    # --- tables

    def vocab_table(self, spark: SparkSession) -> DataFrame:
        specials = {s.encode() for s in self.specials}
        rows = [(i, bytearray(t), "special" if t in specials else "byte" if len(t) == 1 else "token") for t, i in sorted(self.vocab.items(), key=lambda x: x[1])]
        return spark.createDataFrame(rows, "id int, token binary, kind string")

    def merges_table(self, spark: SparkSession) -> DataFrame:
        v = self.vocab
        rows = [(k, v[m.left], v[m.right], v[m.left + m.right], bytearray(m.left), bytearray(m.right), m.freq) for k, m in enumerate(self.merges)]
        return spark.createDataFrame(rows, "rank int, left_id int, right_id int, target_id int, left binary, right binary, freq long")

    def write(self, spark: SparkSession, path: str) -> None:
        """A directory of Parquet tables that keeps the whole model: pattern, specials, bigrams and mode too."""
        meta = json.dumps({"unit": self.unit, "specials": self.specials, "pattern": self.pattern, "bigrams": self.bigrams, "mixed": self.mixed})
        self.vocab_table(spark).coalesce(1).write.mode("overwrite").parquet(f"{path}/vocab")
        self.merges_table(spark).coalesce(1).write.mode("overwrite").parquet(f"{path}/merges")
        spark.createDataFrame([(meta,)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/meta")

    @classmethod
    def read(cls, spark: SparkSession, path: str) -> BpeModel:
        meta = json.loads(spark.read.text(f"{path}/meta").first().value)
        vocab = {bytes(r.token): r.id for r in spark.read.parquet(f"{path}/vocab").collect()}
        merges = [Merge(bytes(r.left), bytes(r.right), r.freq) for r in spark.read.parquet(f"{path}/merges").orderBy("rank").collect()]
        bigrams = None if meta["bigrams"] is None else tuple(meta["bigrams"])
        return cls(meta["unit"], vocab, tuple(merges), tuple(meta["specials"]), meta["pattern"], bigrams, meta["mixed"])


def load_vocab_json(path: str | Path, fmt: str, specials: Sequence[str] = ()) -> dict[bytes, int]:
    """Ids by token. A negative key entry of a character (-1 - code point) is kept as it is in the file."""
    rows = json.loads(Path(path).read_text(encoding="utf-8"))
    out = {}
    for text, i in rows.items():
        if text in specials:
            token = text.encode()
        else:
            try:
                token = _parse(text, fmt)
            except ValueError:
                token = text.encode()  # a special token that the caller did not name
        out[token] = int(i)
    return out


def load_merges_txt(path: str | Path, fmt: str) -> list[Merge]:
    """Lines ``L R`` or ``L R => freq``; blank lines are skipped, a frequency that is no number is 0."""
    out = []
    for k, line in enumerate(Path(path).read_text(encoding="utf-8").split("\n"), 1):
        if not line.strip():
            continue
        pair, _, freq = line.partition(" => ")
        parts = pair.split()
        if len(parts) != 2:
            raise ValueError(f"{path}, line {k}: a merge has two parts")
        freq = freq.strip()
        out.append(Merge(_parse(parts[0], fmt), _parse(parts[1], fmt), int(freq) if freq.lstrip("-").isdigit() else 0))
    return out


def find_file(kind: str, name: str, unit: str, directory: str | Path = ".") -> Path:
    end = "json" if kind == "vocab" else "txt"
    for n in UNIT_NAMES[unit]:
        p = Path(directory) / f"{kind}.{name}[{n}].{end}"
        if p.exists():
            return p
    return Path(directory) / f"{kind}.{name}[{unit}].{end}"


# --- checks -------------------------------------------------------------------


def problems(unit: str, tokens: Sequence[bytes], merges: Iterable[tuple[int, int, int, int]], initial: int, specials: int = 0, cutoff: int | None = None, materialized: Iterable[int] = ()) -> list[str]:
    """What is wrong with a model, in words. ``tokens`` by id; merges are (left, right, target, freq)."""
    found, seen = [], {}
    for i, t in enumerate(tokens):
        if t in seen:
            found.append(f"duplicate vocabulary token {A.lossy(t)}")
        seen[t] = i
        if unit == "unicode" and i >= specials and not A.is_canonical(t):
            found.append(f"token {i} is not canonical Unicode content")
    ready, targets, last = set(range(initial)) | set(materialized), set(), None
    for rank, (a, b, t, freq) in enumerate(merges):
        if max(a, b) >= len(tokens) or min(a, b) < 0:
            found.append(f"merge {rank}: an operand is not in the vocabulary")
            continue
        if not 0 <= t < len(tokens) or tokens[t] != tokens[a] + tokens[b]:
            found.append(f"merge {rank}: the target is not the operands put together")
        elif t in targets or t in ready:
            found.append(f"merge {rank}: target {t} is used twice")
        if not {a, b} <= ready:
            found.append(f"merge {rank}: an operand is neither an initial token nor an earlier target")
        if unit == "unicode" and not A.is_legal_merge(tokens[a], tokens[b]):
            found.append(f"merge {rank}: operands of mixed kinds")
        targets.add(t)
        ready.add(t)
        last = freq
    if cutoff is not None and last is not None and last < cutoff:
        found.append(f"final merge frequency {last} must be at least the cutoff frequency {cutoff}")
    return found
