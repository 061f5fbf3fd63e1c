"""Functions for SQL text: encode, decode and count by a model, and a table function for pieces."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
import pyarrow.compute
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from mergeloom.operators.encoder import BpeEncoder
from mergeloom.operators.pretokenizer import PreTokenizer


def register(spark: SparkSession, encoder: BpeEncoder, prefix: str = "bpe") -> None:
    """``{prefix}_encode(text)``, ``{prefix}_decode(ids)``, ``{prefix}_count(text)``."""
    sent = spark.sparkContext.broadcast(encoder)

    def pieces(rows: pa.Array) -> pa.Array:
        enc = sent.value
        return pa.array([None if t is None else ["01"[special] + p for p, special in enc.pretokenizer.pieces_of(t)] for t in rows.to_pylist()], pa.list_(pa.string()))

    @F.arrow_udf("array<int>")
    def encode(rows: pa.Array) -> pa.Array:
        return sent.value._column(pieces(rows))

    @F.arrow_udf("string")
    def decode(rows: pa.Array) -> pa.Array:
        return sent.value._texts(rows)

    @F.arrow_udf("int")
    def count(rows: pa.Array) -> pa.Array:
        return pa.compute.list_value_length(sent.value._column(pieces(rows))).cast(pa.int32())

    spark.udf.register(f"{prefix}_encode", encode)
    spark.udf.register(f"{prefix}_decode", decode)
    spark.udf.register(f"{prefix}_count", count)


def register_pieces(spark: SparkSession, name: str = "tokenize", special_tokens: Sequence[str] = (), pat_str: str | None = None) -> None:
    """A table function ``name(text)`` with (pos, piece, is_special), for lateral joins."""
    pre = PreTokenizer(special_tokens, pat_str=pat_str)
    specials, pattern = pre.special_tokens, pre.pattern

    class Pieces:
        def __init__(self):
            self.pre = PreTokenizer(specials, pat_str=pattern)

        def eval(self, text: str) -> Iterator[tuple[int, str, bool]]:
            for k, (piece, special) in enumerate(self.pre.pieces_of(text) if text is not None else ()):
                yield k, piece, special

    spark.udtf.register(name, F.udtf(Pieces, returnType="pos int, piece string, is_special boolean"))
