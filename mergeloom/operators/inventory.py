"""Word and bigram inventories: mergeable counts, selection with ties, summaries, scaling."""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterable
from dataclasses import dataclass

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def merged(*counts: DataFrame) -> DataFrame:
    """Counts of the same schema added up by key; a sum beyond 64 bits is an error (ANSI)."""
    out = counts[0]
    for c in counts[1:]:
        out = out.unionByName(c)
    return out.groupBy(*[c for c in out.columns if c != "freq"]).agg(F.sum("freq").alias("freq"))


def sorted_words(words: DataFrame) -> DataFrame:
    """Most frequent first; of equally frequent words the greater one first."""
    return words.orderBy(F.desc("freq"), F.desc("word"))


def without(words: DataFrame, specials: Iterable[str]) -> DataFrame:
    """Words that are no special token."""
    specials = list(specials)
    return words.where(~F.col("word").isin(specials)) if specials else words


@dataclass(frozen=True)
class BigramSelection:
    """What ``select_bigrams`` keeps; cutoff: the least frequency kept; excluded: the highest that is not."""

    bigrams: list[str]
    cutoff_freq: int | None
    max_excluded_freq: int | None


def cutoff_of(counts: DataFrame, top_k: int, min_freq: int = 1) -> int | None:
    """Frequency of the top_k-th pair of those with min_freq at least (of the last, if fewer); None if none is kept."""
    if top_k <= 0:
        return None
    # how many pairs have each frequency: a table that is short, however many pairs there are
    levels = counts.where(F.col("freq") >= min_freq).groupBy("freq").agg(F.count("*").alias("n"))
    above = F.coalesce(F.sum("n").over(Window.orderBy(F.desc("freq")).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return levels.withColumn("above", above).where(F.col("above") < top_k).agg(F.min("freq")).first()[0]


def top_bigrams(counts: DataFrame, top_k: int, min_freq: int = 1) -> DataFrame:
    """The top_k most frequent pairs and all that tie with the last of them.

    A table of counts that is used more than once is kept: what it is made from is read once.
    """
    counts = counts.persist(StorageLevel.DISK_ONLY)
    cut = cutoff_of(counts, top_k, min_freq)
    return counts.where(F.col("freq") >= cut) if cut is not None else counts.where(F.lit(False))


def select_bigrams(counts: DataFrame, top_k: int = 100_000, min_freq: int = 16) -> BigramSelection:
    counts = counts.persist(StorageLevel.DISK_ONLY)
    cut = cutoff_of(counts, top_k, min_freq)
    rest = counts if cut is None else counts.where(F.col("freq") < cut)
    kept = [] if cut is None else [r.b for r in counts.where(F.col("freq") >= cut).select(F.concat("left", "right").alias("b")).collect()]
    out = BigramSelection(sorted(kept), cut, rest.agg(F.max("freq")).first()[0])
    counts.unpersist()
    return out


def summary(words: DataFrame) -> DataFrame:
    """One row: unique words, occurrences, words seen once, unique per occurrence, word lengths."""
    size = F.char_length("word")
    return words.agg(
        F.count("*").alias("unique_words"),
        F.sum("freq").alias("occurrences"),
        F.count_if(F.col("freq") == 1).alias("singletons"),
        (F.count("*") / F.sum("freq")).alias("unique_ratio"),
        F.min(size).alias("min_length"),
        F.percentile(size, 0.5).alias("median_length"),
        F.percentile(size, 0.9).alias("p90_length"),
        F.max(size).alias("max_length"),
    )


def scaled(words: DataFrame, total: int) -> DataFrame:
    """Frequencies brought to sum ``total`` in proportion, by largest remainder (ties: the lesser word).

    The number of words that get one more is known from the sums; who they are is
    found by the remainders' ranks, taken in two steps: within hash buckets, then
    by the cutoff remainder, so that no task sorts all words.
    """
    words = words.persist(StorageLevel.DISK_ONLY)
    now = words.agg(F.sum("freq")).first()[0] or 0
    if total < 0 or now <= 0:
        raise ValueError("a positive inventory and a total of 0 or more are needed")
    parts = words.select("word", F.expr(f"cast(floor(cast(freq as decimal(19,0)) * cast({total} as decimal(19,0)) / {now}) as bigint)").alias("base"), F.expr(f"cast((cast(freq as decimal(19,0)) * cast({total} as decimal(19,0))) % {now} as bigint)").alias("rest"))
    missing = total - (parts.agg(F.sum("base")).first()[0] or 0)
    levels = parts.groupBy("rest").agg(F.count("*").alias("n"))
    above = F.coalesce(F.sum("n").over(Window.orderBy(F.desc("rest")).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    edge = levels.withColumn("above", above).where((F.col("above") < missing) & (F.col("above") + F.col("n") >= missing)).select("rest", "above").first()
    if edge is None:
        return parts.select("word", F.col("base").alias("freq")).where("freq > 0")
    tied = parts.where(F.col("rest") == edge.rest).orderBy("word").limit(missing - edge.above).select("word", F.lit(1).alias("one"))
    out = parts.join(tied, "word", "left").withColumn("freq", F.col("base") + F.when((F.col("rest") > edge.rest) | F.col("one").isNotNull(), 1).otherwise(0))
    return out.select("word", F.col("freq").cast("long").alias("freq")).where("freq > 0")


def frequency_guard(selection: BigramSelection, last_merge_freq: int | None) -> bool:
    """Whether no bigram left out was as frequent as the last merge: then leaving them out did not change the model."""
    return selection.max_excluded_freq is None or last_merge_freq is not None and selection.max_excluded_freq < last_merge_freq


def unit_frequencies(words: DataFrame) -> DataFrame:
    """(unit, freq) of the characters beyond ASCII, all positions counted."""
    chars = F.explode(F.regexp_extract_all("word", F.lit(r"[^\x00-\x7F]"), F.lit(0)))
    return words.select(chars.alias("unit"), "freq").groupBy("unit").agg(F.sum("freq").alias("freq"))


def pair_frequencies(words: DataFrame) -> DataFrame:
    """(l, r, freq) of adjacent bytes of words, overlaps counted."""
    code = F.transform(F.sequence(F.lit(1), F.length(F.encode("word", "UTF-8"))), lambda i: F.conv(F.hex(F.substring(F.encode("word", "UTF-8"), i, F.lit(1))), 16, 10).cast("int"))
    pairs = F.explode(F.arrays_zip(F.slice("b", F.lit(1), F.size("b") - 1).alias("l"), F.slice("b", F.lit(2), F.size("b") - 1).alias("r")))
    return words.where(F.octet_length("word") > 1).select(code.alias("b"), "freq").select(pairs.alias("p"), "freq").groupBy(F.col("p.l").alias("l"), F.col("p.r").alias("r")).agg(F.sum("freq").alias("freq"))


def duration_summary(durations: DataFrame, value: Column) -> DataFrame:
    return durations.agg(F.count(value).alias("n"), F.min(value).alias("min"), F.median(value).alias("median"), F.percentile(value, 0.9).alias("p90"), F.percentile(value, 0.99).alias("p99"), F.max(value).alias("max"))


def fingerprint(fields: Iterable[bytes | str | int]) -> str:
    """SHA-256 of fields in order, each after its length."""
    h = hashlib.sha256()
    for x in fields:
        raw = struct.pack("<q", x) if isinstance(x, int) else x.encode() if isinstance(x, str) else x
        h.update(struct.pack("<Q", len(raw)) + raw)
    return h.hexdigest()


def words_fingerprint(words: DataFrame) -> str:
    """Of (word, freq) in the order of words, streamed to the driver."""
    return fingerprint(x for r in words.orderBy("word").toLocalIterator(prefetchPartitions=True) for x in (r.word, r.freq))


def bigrams_fingerprint(bigrams: Iterable[str]) -> str:
    return fingerprint(sorted(bigrams))


def vocab_fingerprint(vocab: dict[bytes, int]) -> str:
    """Of (id, token) in the order of ids."""
    return fingerprint(x for t, i in sorted(vocab.items(), key=lambda r: (r[1], r[0])) for x in (i, t))


def merges_fingerprint(merges: Iterable) -> str:
    """Of (left, right, frequency) in rank order."""
    return fingerprint(x for m in merges for x in (m.left, m.right, m.freq))


def ids_fingerprint(ids: Iterable[int]) -> str:
    return fingerprint(map(int, ids))
