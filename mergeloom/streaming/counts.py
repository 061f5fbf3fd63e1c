"""Inventories of streams: the batch plans on readStream, and a folder of counts that each batch adds to."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from mergeloom.operators.inventory import merged
from mergeloom.operators.pretokenizer import PreTokenizer


def text_stream(spark: SparkSession, path: str, schema: StructType | str, files_per_trigger: int = 1) -> DataFrame:
    """Parquet files of a folder as they arrive, some at a time (the bound of a batch)."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def count_words(docs: DataFrame, name: str, checkpoint: str, pretokenizer: PreTokenizer | None = None) -> StreamingQuery:
    """A running (word, freq) in an in-memory table, for looking at small streams."""
    counted = (pretokenizer or PreTokenizer()).words(docs)
    return counted.writeStream.outputMode("complete").format("memory").queryName(name).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def accumulate_words(docs: DataFrame, inventory: str, checkpoint: str, pretokenizer: PreTokenizer | None = None) -> StreamingQuery:
    """Each batch's counts as one folder under ``inventory``, named by the batch: a batch that is
    run again overwrites its own counts, so failures neither lose nor double any. No state is kept."""
    pre = pretokenizer or PreTokenizer()

    def add(batch: DataFrame, number: int) -> None:
        pre.words(batch).write.mode("overwrite").parquet(f"{inventory}/batch={number}")

    return docs.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def read_inventory(spark: SparkSession, inventory: str) -> DataFrame:
    return merged(spark.read.parquet(inventory).select("word", F.col("freq")))


def compact(spark: SparkSession, inventory: str, target: str) -> None:
    """All counts so far as one table."""
    read_inventory(spark, inventory).write.mode("overwrite").parquet(target)
