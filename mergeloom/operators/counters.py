"""Counters that take texts bit by bit on the driver, as the small-data face of the inventories.

A bounded source is read in batches; what a batch has counted stays when the source fails later.
Texts of a table are counted on the executors, and their counts stay there until they are asked for one by one.
"""

from __future__ import annotations

import json
from collections import Counter
from collections.abc import Iterable, Iterator
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mergeloom.operators.inventory import BigramSelection, merged
from mergeloom.operators.pretokenizer import PreTokenizer

MAX = (1 << 63) - 1


def batches(source: Iterator[str], max_records: int, max_bytes: int) -> Iterator[list[str]]:
    """Records in batches; one that would go beyond a bound begins the next, a longer one is a batch alone."""
    held, size = [], 0
    for text in source:
        n = len(text.encode())
        if held and (len(held) >= max_records or size + n > max_bytes):
            yield held
            held, size = [], 0
        held.append(text)
        size += n
        if len(held) >= max_records:
            yield held
            held, size = [], 0
    if held:
        yield held


class _Counter:
    def __init__(self, pretokenizer: PreTokenizer):
        self.pretokenizer = pretokenizer
        self._counts: Counter[str] = Counter()
        #: (key, freq) tables whose counts are not in ``_counts``
        self.tables: list[DataFrame] = []

    @property
    def counts(self) -> Counter[str]:
        """All counts, those of tables brought to the driver."""
        while self.tables:
            rows = Counter({r[0]: r[1] for r in self.tables[-1].toLocalIterator()})
            self.tables.pop()
            self._add(rows)
        return self._counts

    def _of(self, text: str) -> Counter[str]:
        raise NotImplementedError

    def _add(self, more: Counter[str]) -> None:
        for k, n in more.items():
            if self._counts[k] + n > MAX:
                raise OverflowError(f"count of {k!r} is beyond 64 bits")
            self._counts[k] += n

    def add_text(self, text: str) -> None:
        self._add(self._of(text))

    def add_batch(self, texts: Iterable[str]) -> None:
        total: Counter[str] = Counter()
        for t in texts:
            total.update(self._of(t))
        self._add(total)

    def add_source(self, source: Iterable[str], *, max_records: int = 4096, max_bytes: int = 64 << 20, prefetch: int = 1) -> None:
        if max_records < 1:
            raise ValueError("max_records must be positive")
        if max_bytes < 1:
            raise ValueError("max_bytes must be positive")
        if prefetch not in (0, 1):
            raise ValueError("prefetch must be 0 or 1")
        for batch in batches(iter(source), max_records, max_bytes):
            self.add_batch(batch)

    def _of_table(self, docs: DataFrame, text: str) -> DataFrame:
        raise NotImplementedError

    def add_table(self, docs: DataFrame, text: str = "text") -> None:
        """The texts of a column that are not null, counted where they lie."""
        self.tables.append(self._of_table(docs, text))

    def merge(self, other: _Counter) -> None:
        self._add(other._counts)
        self.tables += other.tables

    def table(self, spark: SparkSession) -> DataFrame:
        """All counts as a table; those of tables don't come to the driver."""
        out = spark.createDataFrame(list(self._counts.items()), f"{self.key} string, freq long")
        return merged(out, *self.tables) if self.tables else out

    @property
    def len(self) -> int:
        return len(self.counts)

    def is_empty(self) -> bool:
        return not self.counts

    def clear(self) -> None:
        self._counts.clear()
        self.tables.clear()

    def items(self) -> list[tuple[str, int]]:
        return sorted(self.counts.items())

    def take_counts(self) -> dict[str, int]:
        out = dict(self.counts)
        self.clear()
        return out


class WordCounter(_Counter):
    key = "word"

    def _of(self, text: str) -> Counter[str]:
        return Counter(self.pretokenizer.get_words(text))

    def _of_table(self, docs: DataFrame, text: str) -> DataFrame:
        return self.pretokenizer.words(docs, text)

    def words(self) -> dict[str, int]:
        return dict(self.counts)

    def save(self, path: str | Path) -> None:
        Path(path).write_text(json.dumps(self.counts, ensure_ascii=False, separators=(",", ":")), encoding="utf-8")

    @classmethod
    def load(cls, path: str | Path, pretokenizer: PreTokenizer) -> WordCounter:
        out = cls(pretokenizer)
        out.counts.update({k: int(n) for k, n in json.loads(Path(path).read_text(encoding="utf-8")).items()})
        return out


class BigramCounter(_Counter):
    key = "pair"

    def _of_table(self, docs: DataFrame, text: str) -> DataFrame:
        return self.pretokenizer.bigram_counts(docs, text).select(F.concat("left", "right").alias("pair"), "freq")

    def _of(self, text: str) -> Counter[str]:
        return self.pretokenizer.bigrams_of(text)

    def select(self, top_k: int = 100_000, min_freq: int = 16) -> BigramSelection:
        fit = sorted((n for n in self.counts.values() if n >= min_freq), reverse=True)
        cut = fit[min(top_k, len(fit)) - 1] if fit and top_k > 0 else None
        kept = sorted(b for b, n in self.counts.items() if cut is not None and n >= cut)
        return BigramSelection(kept, cut, max((n for b, n in self.counts.items() if cut is None or n < cut), default=None))

    def selected(self, top_k: int = 100_000, min_freq: int = 16) -> list[str]:
        return self.select(top_k, min_freq).bigrams
