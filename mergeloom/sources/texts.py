"""Corpora as tables with a text column, and the small files around models."""

from __future__ import annotations

import base64
import hashlib
import json
from collections.abc import Iterator, Sequence
from pathlib import Path

import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Bytes of a file of a sample.
FILE_BYTES = 4 << 20


def in_memory(spark: SparkSession, texts: Sequence[str | None]) -> DataFrame:
    return spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id long, text string")


def whole_files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path, wholetext=True).select(F.col("value").alias("text"), F.input_file_name().alias("path"))


def separated(spark: SparkSession, path: str, separator: str = "<|endoftext|>") -> DataFrame:
    """One row for each document between separators; a file is split over tasks."""
    return spark.read.text(path, lineSep=separator).select(F.col("value").alias("text")).where("text <> ''")


def parquet_texts(spark: SparkSession, path: str, column: str = "text", max_bytes: int | None = None, order: Sequence[str] = ()) -> DataFrame:
    """The texts of a column that are not null; only this column is read.

    ``max_bytes``: the first rows (by ``order``) whose bytes sum to no more. Sums
    are taken by range partition first, so no task sees all rows.
    """
    rows = spark.read.parquet(path)
    if max_bytes is None:
        return rows.where(F.col(column).isNotNull()).select(F.col(column).alias("text"))
    if not order:
        raise ValueError("a byte cap needs an order")
    sized = rows.where(F.col(column).isNotNull()).select(*order, F.col(column).alias("text")).repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__part", F.spark_partition_id()).withColumn("__n", F.octet_length("text"))
    sums = sized.groupBy("__part").agg(F.sum("__n").alias("__all"))
    before = sums.select("__part", F.coalesce(F.sum("__all").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__before"))
    inside = F.sum("__n").over(Window.partitionBy("__part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    return sized.withColumn("__in", inside).join(before, "__part").where(F.col("__in") + F.col("__before") <= max_bytes).select(*order, "text")


def write_sample(docs: DataFrame, path: str, separator: str = "<|endoftext|>") -> None:
    """Texts as one stream with a separator behind each, in files of about ``FILE_BYTES``, so that they can be read whole."""
    rows = docs.where("text is not null").select("text")
    mean = rows.agg(F.avg(F.octet_length("text"))).first()[0] or 0
    rows.write.mode("overwrite").option("lineSep", separator).option("maxRecordsPerFile", max(1, int(FILE_BYTES / (mean + len(separator))))).text(path)


def write_joined(docs: DataFrame, path: str, separator: str = "<|endoftext|>") -> None:
    """Texts in one file with a separator behind each. Each task writes its part at its place, in a folder that all machines share."""
    rows, end = docs.where("text is not null").select("text"), separator.encode()

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = sum((pc.sum(pc.binary_length(b.column(0))).as_py() or 0) + len(end) * b.num_rows for b in batches)
        yield pa.RecordBatch.from_pydict({"part": [TaskContext.get().partitionId()], "n": [n]})

    sizes = sorted((r.part, r.n) for r in rows.mapInArrow(measure, "part long, n long").collect())
    place, total = {}, 0
    for part, n in sizes:
        place[part] = (total, total + n)
        total += n
    with open(path, "wb") as f:
        f.truncate(total)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, stop = place[TaskContext.get().partitionId()]
        with open(path, "r+b") as f:
            f.seek(at)
            for b in batches:
                for t in b.column(0).to_pylist():
                    raw = t.encode() + end
                    if f.tell() + len(raw) > stop:
                        raise RuntimeError("the texts of a part are not those that were measured")
                    f.write(raw)
            if f.tell() != stop:
                raise RuntimeError("the texts of a part are not those that were measured")
        yield pa.RecordBatch.from_pydict({"n": [stop - at]})

    rows.mapInArrow(write, "n long").agg(F.sum("n")).first()


def special_tokens_file(path: str | Path) -> list[str]:
    return [x for x in Path(path).read_text(encoding="utf-8").splitlines() if x.strip()]


# --- rank files ---------------------------------------------------------------


def check_hash(data: bytes, expected_hash: str) -> bool:
    return hashlib.sha256(data).hexdigest() == expected_hash


def load_ranks(path: str | Path, expected_hash: str | None = None) -> dict[bytes, int]:
    """Lines ``base64(token) rank``."""
    data = Path(path).read_bytes()
    if expected_hash is not None and not check_hash(data, expected_hash):
        raise ValueError(f"{path} has another hash than expected")
    out = {}
    for line in data.splitlines():
        if line:
            token, rank = line.split()
            out[base64.b64decode(token)] = int(rank)
    return out


def dump_ranks(ranks: dict[bytes, int], path: str | Path) -> None:
    Path(path).write_bytes(b"".join(base64.b64encode(t) + b" %d\n" % r for t, r in sorted(ranks.items(), key=lambda x: x[1])))


def rank_table(spark: SparkSession, path: str) -> DataFrame:
    """(token, rank) of a rank file, read by Spark."""
    part = F.split("value", " ")
    return spark.read.text(path).where("value <> ''").select(F.unbase64(part[0]).alias("token"), part[1].cast("int").alias("rank"))


def load_json_ranks(path: str | Path) -> dict[bytes, int]:
    """A JSON object {token: rank}, tokens as plain text."""
    return {t.encode(): int(r) for t, r in json.loads(Path(path).read_text(encoding="utf-8")).items()}
