"""Text to pieces, words and bigrams: DataFrame operators with a small API for single texts."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator, Sequence
from pathlib import Path

import pandas as pd
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mergeloom.functions import patterns as P

KEEP, SPLIT = "keep", "split"


def parse_bigrams(bigrams: Sequence[str]) -> frozenset[str]:
    for b in bigrams:
        if len(b) != 2:
            raise ValueError(f"a bigram has exactly 2 characters: {b!r}")
    return frozenset(bigrams)


class PreTokenizer:
    """Special tokens are cut out first (in list order), then the pattern is matched,
    then words are segmented at Unicode bigrams that are not retained."""

    def __init__(self, special_tokens: Sequence[str] = (), eot_token: str | None = None, pat_str: str | None = None, unicode_bigrams: Sequence[str] | None = None, unicode_bigram_mixed_boundary: str = KEEP, script: Sequence[tuple[int, int]] = P.SCRIPT_RANGES):
        if unicode_bigram_mixed_boundary not in (KEEP, SPLIT):
            raise ValueError(f"Unknown mixed boundary mode: {unicode_bigram_mixed_boundary}")
        self.special_tokens = list(special_tokens)
        self.eot_token = eot_token or P.END_OF_TEXT
        self.pattern = pat_str if pat_str is not None else P.DEFAULT_PATTERN
        self.bigrams = parse_bigrams(unicode_bigrams) if unicode_bigrams is not None else None
        self.mixed, self.script = unicode_bigram_mixed_boundary, tuple(script)
        self._regex = regex.compile(self.pattern)

    def with_unicode_bigrams(self, bigrams: Sequence[str]) -> PreTokenizer:
        """A new pretokenizer that also cuts where a bigram is not among these."""
        return PreTokenizer(self.special_tokens, self.eot_token, self.pattern, list(bigrams), self.mixed, self.script)

    # --- tables

    def pieces(self, docs: DataFrame, text: str = "text") -> DataFrame:
        """All columns but the text, with (pos, piece, is_special) for each piece of each row."""
        rest = [c for c in docs.columns if c != text]
        if self.bigrams is None:
            return docs.select(*rest, F.posexplode(P.pieces(F.col(text), self.special_tokens, self.pattern)).alias("pos", "p")).select(*rest, "pos", "p.piece", "p.is_special")
        cut = F.transform(P.pieces(F.col(text), self.special_tokens, self.pattern), lambda p: F.concat(F.when(p["is_special"], "1").otherwise("0"), p["piece"]))
        return docs.select(*rest, F.posexplode(self._segmented(cut)).alias("pos", "p")).select(*rest, "pos", F.expr("substring(p, 2)").alias("piece"), (F.substring("p", 1, 1) == "1").alias("is_special"))

    def _segmented(self, marked: Column) -> Column:
        """Pieces with a leading mark -> their segments with the same mark. Only rows with a character of the scripts go through Python."""
        retained, mixed, script = self.bigrams, self.mixed == SPLIT, self.script

        @F.pandas_udf("array<string>")
        def cut(rows: pd.Series) -> pd.Series:
            return rows.map(lambda row: [p for m in row for p in ([m] if m[0] == "1" else ["0" + s for s in P.segment(m[1:], retained, mixed, script)])])

        return F.when(F.exists(marked, lambda m: m.rlike(P.script_class(script))), cut(marked)).otherwise(marked)

    def words(self, docs: DataFrame, text: str = "text") -> DataFrame:
        """(word, freq): how often each word occurs, special tokens left out. Partial counts are made before the shuffle."""
        texts = docs.where(F.col(text).isNotNull())
        if self.bigrams is None:
            # stretch by stretch: the pieces of a long text with many special tokens are never held together
            stretches = texts.select(F.explode(P.chunks(F.col(text), self.special_tokens)).alias("stretch"))
            return stretches.select(F.explode(P.tokens(F.col("stretch"), self.pattern)).alias("word")).groupBy("word").agg(F.count("*").alias("freq"))
        whole = PreTokenizer(self.special_tokens, self.eot_token, self.pattern).words(docs, text)
        retained, mixed, script = self.bigrams, self.mixed == SPLIT, self.script

        @F.pandas_udf("array<string>")
        def cut(rows: pd.Series) -> pd.Series:
            return rows.map(lambda w: P.segment(w, retained, mixed, script))

        # distinct words only are segmented, and of these only words with two characters side by side that may be cut;
        # others are a branch of their own, so that they don't go through Python
        may = F.col("word").rlike(P.script_class(script)) & (F.char_length("word") > 1)
        parts = whole.where(may).select(F.explode(cut("word")).alias("word"), "freq").unionByName(whole.where(~may))
        return parts.groupBy("word").agg(F.sum("freq").alias("freq"))

    def bigram_counts(self, docs: DataFrame, text: str = "text") -> DataFrame:
        """(left, right, freq) of adjacent characters of the scripts, in stretches without special tokens."""
        runs = F.flatten(F.transform(P.chunks(F.col(text), self.special_tokens), lambda c: F.regexp_extract_all(c, F.lit(P.script_class(self.script) + "{2,}"), F.lit(0))))
        # equal runs are counted first: far fewer rows than one for each pair of characters
        one = docs.where(F.col(text).isNotNull()).select(F.explode(runs).alias("run")).groupBy("run").agg(F.count("*").alias("n"))
        pair = F.explode(F.transform(F.sequence(F.lit(1), F.char_length("run") - 1), lambda i: F.substring(F.col("run"), i, F.lit(2))))
        return one.select(pair.alias("pair"), "n").groupBy("pair").agg(F.sum("n").alias("freq")).select(F.substring("pair", 1, 1).alias("left"), F.substring("pair", 2, 1).alias("right"), "freq")

    # --- one text

    def tokens(self, chunk: str) -> list[str]:
        found = [m.group() for m in self._regex.finditer(chunk)]
        if self.bigrams is None:
            return found
        return [s for w in found for s in P.segment(w, self.bigrams, self.mixed == SPLIT, self.script)]

    def pieces_of(self, text: str) -> Iterator[tuple[str, bool]]:
        for part, special in P.split_special(text, self.special_tokens):
            if special:
                yield part, True
            else:
                yield from ((t, False) for t in self.tokens(part))

    def get_words(self, text: str) -> dict[str, int]:
        return dict(Counter(p for p, special in self.pieces_of(text) if not special))

    def bigrams_of(self, text: str) -> Counter[str]:
        out: Counter[str] = Counter()
        for part, special in P.split_special(text, self.special_tokens):
            if not special:
                out.update(part[k : k + 2] for k in range(len(part) - 1) if P.in_script(part[k], self.script) and P.in_script(part[k + 1], self.script))
        return out

    # --- files and counters, on the driver

    def word_counter(self):
        """An empty counter of words."""
        from mergeloom.operators.counters import WordCounter

        return WordCounter(self)

    def bigram_counter(self):
        """An empty counter of bigrams."""
        from mergeloom.operators.counters import BigramCounter

        return BigramCounter(self)

    def load_word_counter(self, path: str | Path):
        """A counter with the words of a file that ``WordCounter.save`` wrote."""
        from mergeloom.operators.counters import WordCounter

        return WordCounter.load(path, self)

    def find_chunk_boundaries(self, path: str | Path, *, chunk_size: int = 1 << 20, boundary: str = "auto") -> list[tuple[int, int]]:
        """(offset, length) of the segments of a file."""
        from mergeloom.sources.segments import boundaries

        return boundaries(path, chunk_size=chunk_size, mode=boundary, token=self.eot_token)

    def get_words_from_segment(self, path: str | Path, offset: int, length: int) -> dict[str, int]:
        from mergeloom.sources.segments import read_segment

        return self.get_words(read_segment(path, offset, length))

    def get_words_from_file(self, path: str | Path, *, chunk_size: int = 1 << 20, boundary: str = "auto") -> dict[str, int]:
        total: Counter[str] = Counter()
        for a, n in self.find_chunk_boundaries(path, chunk_size=chunk_size, boundary=boundary):
            total.update(self.get_words_from_segment(path, a, n))
        return dict(total)

    def select_unicode_bigrams_from_file(self, path: str | Path, *, chunk_size: int = 1 << 20, boundary: str = "auto", top_k: int = 100_000, min_freq: int = 16):
        """The bigrams of a file that ``select`` of a counter keeps, with its cutoff and the most frequent one left out."""
        from mergeloom.sources.segments import read_segment

        counter = self.bigram_counter()
        counter.add_source(read_segment(path, a, n) for a, n in self.find_chunk_boundaries(path, chunk_size=chunk_size, boundary=boundary))
        return counter.select(top_k, min_freq)

    def build_unicode_bigrams_from_file(self, path: str | Path, **how) -> list[str]:
        return self.select_unicode_bigrams_from_file(path, **how).bigrams
