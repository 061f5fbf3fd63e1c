"""What is written besides Parquet: inventories, id arrays, manifests."""

from __future__ import annotations

import json
import time
from pathlib import Path

import numpy as np
from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mergeloom.operators.inventory import sorted_words


def save_inventory(words: DataFrame, path: str | Path, ordered: bool = True) -> None:
    """{word: freq} as JSON, streamed to the driver; most frequent first, ties by the greater word."""
    rows = (sorted_words(words) if ordered else words).select("word", "freq")
    with open(path, "w", encoding="utf-8") as f:
        f.write("{")
        for k, r in enumerate(rows.toLocalIterator(prefetchPartitions=True)):
            f.write(("," if k else "") + json.dumps(r.word, ensure_ascii=False) + ":" + str(r.freq))
        f.write("}")


def load_inventory(spark: SparkSession, path: str | Path) -> DataFrame:
    rows = json.loads(Path(path).read_text(encoding="utf-8"))
    return spark.createDataFrame([(w, int(n)) for w, n in rows.items()], "word string, freq long")


def save_bigrams(bigrams: list[str], path: str | Path) -> None:
    Path(path).write_text(json.dumps(bigrams, ensure_ascii=False), encoding="utf-8")


def save_ids(ids: np.ndarray, path: str | Path) -> None:
    """A one-dimensional uint32 array; ``.npz`` keeps it under the key idx."""
    ids = np.asarray(ids, np.uint32)
    np.savez_compressed(path, idx=ids) if str(path).endswith(".npz") else np.save(path, ids)


def save_table_ids(encoded: DataFrame, path: str | Path, order: str = "doc_id", ids: str = "ids") -> None:
    """Ids of all rows in order as one array, written a partition at a time into a mapped file."""
    rows = encoded.where(F.col(ids).isNotNull()).persist(StorageLevel.DISK_ONLY)
    n = rows.agg(F.sum(F.size(ids))).first()[0] or 0
    packed = str(path).endswith(".npz")
    plain = f"{path}.npy" if packed else path
    out, at = np.lib.format.open_memmap(plain, "w+", np.uint32, (n,)) if n else np.zeros(0, np.uint32), 0
    for r in rows.orderBy(order).select(ids).toLocalIterator(prefetchPartitions=True):
        out[at : at + len(r[0])] = r[0]
        at += len(r[0])
    rows.unpersist()
    if packed or not n:
        save_ids(out, path)
    if packed and n:
        Path(plain).unlink()


def write_manifest(path: str | Path, words_file: str | Path, unique_words: int, occurrences: int, source: dict, pretokenizer: dict, bigrams: dict | None = None) -> None:
    data = Path(words_file)
    body = {"contract": {"version": 1, "boundary": "source_record"}, "words": {"file_name": data.name, "bytes": data.stat().st_size, "unique_words": unique_words, "weighted_occurrences": occurrences}, "source": source, "pretokenizer": pretokenizer, "unicode_bigrams": bigrams}
    Path(path).write_text(json.dumps(body, ensure_ascii=False, indent=2), encoding="utf-8")


def read_manifest(path: str | Path) -> dict:
    """The manifest, if the inventory beside it has the size it states."""
    body = json.loads(Path(path).read_text(encoding="utf-8"))
    data = Path(path).parent / body["words"]["file_name"]
    if data.stat().st_size != body["words"]["bytes"]:
        raise ValueError(f"{data} has {data.stat().st_size} bytes; the manifest says {body['words']['bytes']}")
    return body


class Metrics:
    """Counters, gauges and durations of a run, as one JSON object."""

    def __init__(self):
        self.counters: dict[str, int] = {}
        self.gauges: dict[str, float] = {}
        self.durations: dict[str, list[float]] = {}

    def count(self, name: str, n: int = 1) -> None:
        self.counters[name] = self.counters.get(name, 0) + n

    def gauge(self, name: str, value: float) -> None:
        self.gauges[name] = value

    def timed(self, name: str):
        metrics = self

        class Timer:
            def __enter__(self):
                self.began = time.perf_counter()

            def __exit__(self, *_):
                metrics.durations.setdefault(name, []).append(time.perf_counter() - self.began)

        return Timer()

    def snapshot(self) -> dict:
        spans = {}
        for name, xs in self.durations.items():
            q = np.quantile(xs, [0, 0.5, 0.9, 0.99, 1])
            spans[name] = dict(zip(("min", "median", "p90", "p99", "max"), map(float, q))) | {"n": len(xs)}
        return {"counters": self.counters, "gauges": self.gauges, "durations": spans}

    def save(self, path: str | Path) -> None:
        Path(path).write_text(json.dumps(self.snapshot(), indent=2), encoding="utf-8")
