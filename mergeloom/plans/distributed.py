"""Training steps as Catalyst plans, for inventories too large to collect.

A word is a string of symbols ``<0000042>``; replacing ``<l><r>`` from left to right
is one merge, by the JVM's own string code. A step counts pairs (partial sums
before the shuffle; the result has as many rows as distinct pairs), takes the best
one by a partial top-1, and rewrites. The rewriting is narrow, so lineage grows by
one projection a step; every ``every`` steps the words are written to the
checkpoint folder.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mergeloom.functions import alphabets as A
from mergeloom.plans.model import BpeModel, Merge, TrainStepError


def _symbol(i: Column | int) -> Column:
    return F.concat(F.lit("<"), F.lpad(F.lit(i).cast("string") if isinstance(i, int) else i.cast("string"), 7, "0"), F.lit(">"))


def symbols(words: DataFrame, offset: int = 0, alphabet: str = "raw") -> DataFrame:
    """(word, s, freq): the bytes of each word as symbols; ids begin at ``offset``."""
    order = A.byte_order(alphabet)
    ids = {b: offset + k for k, b in enumerate(order)}
    table = F.array(*[F.lit(f"<{ids[b]:07d}>") for b in range(256)])
    hexed = F.regexp_extract_all(F.hex(F.encode("word", "UTF-8")), F.lit(".."), F.lit(0))
    return words.select("word", F.array_join(F.transform(hexed, lambda x: F.element_at(table, F.conv(x, 16, 10).cast("int") + 1)), "").alias("s"), "freq")


def pair_counts(coded: DataFrame) -> DataFrame:
    """(l, r, f) of adjacent symbols, overlaps counted."""
    listed = coded.select(F.regexp_extract_all("s", F.lit("<[0-9]+>"), F.lit(0)).alias("x"), "freq").where(F.size("x") > 1)
    pairs = F.arrays_zip(F.slice("x", F.lit(1), F.size("x") - 1).alias("l"), F.slice("x", F.lit(2), F.size("x") - 1).alias("r"))
    return listed.select(F.explode(pairs).alias("p"), "freq").groupBy(F.col("p.l").alias("l"), F.col("p.r").alias("r")).agg(F.sum("freq").alias("f"))


def train(words: DataFrame, steps: int, specials: list[str] | None = None, alphabet: str = "raw", tie_break: str = "smallest_pair_id", cutoff: int | None = None, every: int = 8) -> tuple[BpeModel, DataFrame]:
    """``steps`` merges of a byte model, and the words encoded with them as (word, s, freq)."""
    specials = list(specials or [])
    tokens = [s.encode() for s in specials] + [bytes([b]) for b in A.byte_order(alphabet)]
    inventory = words.where(~F.col("word").isin(specials)) if specials else words
    coded = symbols(inventory, len(specials), alphabet).persist()
    first, merges = coded, []
    durable = bool(words.sparkSession.conf.get("spark.checkpoint.dir", None) or words.sparkSession.sparkContext._jsc.sc().getCheckpointDir().isDefined())
    for k in range(steps):
        counted = pair_counts(coded)
        if tie_break == "smallest_pair_id":
            best = counted.orderBy(F.desc("f"), "l", "r").limit(1).first()
        else:
            top = counted.agg(F.max("f")).first()[0]
            tied = [] if top is None else counted.where(F.col("f") == top).toLocalIterator()
            best = max(tied, key=lambda r: (tokens[int(r.l[1:-1])], tokens[int(r.r[1:-1])]), default=None)
        if best is None:
            raise TrainStepError("no candidate is left")
        if cutoff is not None and best.f < cutoff:
            break
        a, b = int(best.l[1:-1]), int(best.r[1:-1])
        merges.append(Merge(tokens[a], tokens[b], best.f))
        coded = coded.withColumn("s", F.replace("s", F.lit(best.l + best.r), F.lit(f"<{len(tokens):07d}>")))
        tokens.append(tokens[a] + tokens[b])
        if durable and (k + 1) % every == 0:
            coded = coded.checkpoint()
    first.unpersist() if durable else None
    return BpeModel("byte", {t: i for i, t in enumerate(tokens)}, tuple(merges), tuple(specials)), coded


def encoded_ids(coded: DataFrame) -> DataFrame:
    """(word, ids) of words in symbols."""
    return coded.select("word", F.transform(F.regexp_extract_all("s", F.lit("[0-9]+"), F.lit(0)), lambda x: x.cast("int")).alias("ids"))
