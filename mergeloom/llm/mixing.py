"""Operator 3: mixing sources to weights that change in the course of training.

Training time t runs from 0 to 1. Each source has a weight at each of the evenly
spaced knots, linear between them; at every t the weights of all sources sum to 1.
The tokens asked of a source up to t are its weight integrated from 0 to t, times
the budget of all tokens. A document that comes after c tokens of its source (in an
order by hash) is trained on when c tokens have been asked for: its position is
the inverse of that integral, a root of a quadratic. All are range-sorted by position.

The budget is all tokens there are, and no document is left out. A source with fewer
tokens than are asked of it runs short; from then on its weight passes to the sources
that have more than is asked of them, to each as much as it has left over. So the
documents of a source past the last token asked for are spread over what the short
ones leave open, and t is the share of all tokens trained on. Only with a budget that
the caller states are documents past it left out.

Running sums of a source would put all of a hot source into one task. They are
taken in two steps: within (source, leading digits of the hash), and over the sums
of these buckets, a small table.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mergeloom.llm import common as C

BUCKET_DOCS = 20_000
#: The budget that exhausts no source, and so leaves out most documents if one source is small.
LEAST = "least"
#: Columns of ``place`` that sort documents for training.
ORDER = ["position", "doc_id"]
#: Steps of time between which what short sources leave open is taken as even.
STEPS = 1000
#: Words in a text: runs of anything but ASCII white space.
TOKEN = "[^\\x09-\\x0d ]+"


def position(c: Column, weights: Column, cumulative: Column, knots: int) -> Column:
    """t at which ``c`` (a share of the budget) has been asked for; null if never.

    ``weights`` at the knots, ``cumulative``: their integral up to each knot.
    """
    piece = F.least(F.size(F.filter(cumulative, lambda x: x <= c)), F.lit(knots - 1))
    width = 1.0 / (knots - 1)
    a, b = F.element_at(weights, piece), F.element_at(weights, piece + 1)
    rest = c - F.element_at(cumulative, piece)
    root = F.sqrt(F.greatest(F.lit(0.0), a * a + F.lit(2.0) * (b - a) * rest / F.lit(width)))
    t = (piece - 1) * F.lit(width) + F.when(rest <= 0, 0.0).otherwise(F.lit(2.0) * rest / (a + root))
    return F.when(c < F.element_at(cumulative, F.lit(knots)), F.least(t, F.lit(1.0)))


def left_open(plan: DataFrame, knots: int) -> list[float]:
    """Times by which 0, 1/STEPS, ... 1 of the tokens that short sources leave open have been asked for.

    ``plan``: weights, supply and share of each source, supplies as shares of the
    budget. Sources are added up by the step in which they run short.
    """
    ends = F.ceil(F.coalesce(position(F.col("__have"), F.col("__weights"), F.col("__cumulative"), knots), F.lit(1.0)) * STEPS).cast("int")
    sums = [F.sum(F.col("__weights")[k]).alias(f"w{k}") for k in range(knots)]
    short = plan.where("__have < __share").groupBy(ends.alias("step")).agg(F.sum("__have").alias("have"), *sums).collect()
    weights, have = np.zeros((STEPS + 1, knots)), np.zeros(STEPS + 1)
    for r in short:
        weights[r.step], have[r.step] = [r[f"w{k}"] for k in range(knots)], r.have
    grid, asked = np.linspace(0, 1, STEPS + 1), np.zeros((STEPS + 1, knots))
    for k in range(knots - 1):
        u = np.clip(grid * (knots - 1) - k, 0, 1)
        asked[:, k] += (u - u * u / 2) / (knots - 1)
        asked[:, k + 1] += u * u / 2 / (knots - 1)
    gap = np.maximum.accumulate(np.maximum((weights.cumsum(axis=0) * asked).sum(axis=1) - have.cumsum(), 0))
    if gap[-1] <= 0:
        return [1.0] * (STEPS + 1)
    first = np.flatnonzero(gap <= 0).max(initial=0)
    return np.interp(grid, gap[first:] / gap[-1], grid[first:]).tolist()


def place(docs: DataFrame, schedule: dict[str, list[float]] | None = None, budget: float | str | None = None, seed: int = 0) -> DataFrame:
    """Columns of ``docs`` with ``n_tokens`` and ``position``, in no order.

    ``schedule``: weights of each source at the knots (as many for each, two or
    more), brought to sum 1 at each knot; a source it does not name, or names with
    weight 0 at all knots, is not wanted and left out. By default each source goes
    from its share of all tokens to an equal share.
    ``budget``: tokens in all, documents past them are left out; ``LEAST``: the most
    that exhausts no source; by default all tokens, and every document has a position.

    Defined cases: a null source is the source ''; a null text has 0 tokens and
    takes the position where it comes; equal positions are ordered by doc_id;
    repeated rows each have their own position; a very long text is one document with
    one position, like others. Columns ``n_tokens`` and ``position`` of ``docs`` are
    replaced; others may have any name. No rows give no rows.
    """
    names = [c for c in docs.columns if c not in ("n_tokens", "position")]
    # inside, columns go by their place: names may hold dots or be those used here
    own = {c: f"c{k}" for k, c in enumerate(names)}
    doc_id, text, source = own["doc_id"], own["text"], own["source"]
    docs = docs.select(*[F.col(f"`{c}`").alias(o) for c, o in own.items()])
    digits = max(1, math.ceil(math.log(max(1, docs.count() / BUCKET_DOCS), 16)) + 1)
    order = F.md5(F.concat(F.coalesce(F.col(doc_id).cast("string"), F.lit("")), F.lit(f":{seed}")))
    keyed = docs.select("*", F.coalesce(F.regexp_count(text, F.lit(TOKEN)), F.lit(0)).cast("long").alias("n_tokens"), F.coalesce(source, F.lit("")).alias("__source"), order.alias("__order"))
    keyed = keyed.withColumn("__bucket", F.substring("__order", 1, digits))
    sums = C.stored(keyed.groupBy("__source", "__bucket").agg(F.sum("n_tokens").alias("__tokens")))
    supply = sums.groupBy("__source").agg(F.sum("__tokens").alias("__supply"))
    if schedule is None:
        totals = supply.agg(F.sum("__supply").alias("all"), F.count("*").alias("n"))
        plan = supply.crossJoin(F.broadcast(totals)).select("__source", "__supply", F.array(F.col("__supply") / F.greatest("all", F.lit(1)), F.lit(1.0) / F.col("n")).alias("__weights"))
        knots = 2
    else:
        knots = len(next(iter(schedule.values())))
        if knots < 2 or any(len(w) != knots or min(w) < 0 for w in schedule.values()):
            raise ValueError("a schedule has two or more weights, none negative, as many for each source")
        total = [sum(w[k] for w in schedule.values()) for k in range(knots)]
        if min(total) <= 0:
            raise ValueError("the weights at a knot are all 0")
        rows = [(s, [w[k] / total[k] for k in range(knots)]) for s, w in schedule.items()]
        plan = docs.sparkSession.createDataFrame(rows, "__source string, __weights array<double>").join(supply, "__source", "left")
    steps = [F.lit(0.0)]
    for k in range(1, knots):
        steps.append(steps[-1] + (F.col("__weights")[k - 1] + F.col("__weights")[k]) / F.lit(2.0 * (knots - 1)))
    plan = plan.withColumn("__cumulative", F.array(*steps))
    share = F.element_at("__cumulative", F.lit(knots))
    plan = plan.withColumn("__share", share)
    if budget is None:
        most = F.sum(F.when(F.col("__share") > 0, F.col("__supply"))).cast("double")
    elif budget == LEAST:
        most = F.min(F.when(F.col("__share") > 0, F.col("__supply") / F.col("__share")))
    else:
        most = F.lit(float(budget))
    plan = plan.crossJoin(F.broadcast(plan.agg(F.greatest(most, F.lit(1.0)).alias("__most"))))
    plan = C.stored(plan.withColumn("__have", F.coalesce("__supply", F.lit(0)) / F.col("__most")))
    before = F.sum("__tokens").over(Window.partitionBy("__source").orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1))
    offsets = C.stored(sums.withColumn("__offset", F.coalesce(before, F.lit(0))).join(plan, "__source").select("__source", "__bucket", "__offset", "__weights", "__cumulative", "__most", "__share", "__have"))
    inside = Window.partitionBy("__source", "__bucket").orderBy("__order", doc_id, "n_tokens", F.xxhash64(text)).rowsBetween(Window.unboundedPreceding, -1)
    placed = keyed.withColumn("__c", F.coalesce(F.sum("n_tokens").over(inside), F.lit(0))).join(C.small_side(offsets), ["__source", "__bucket"])
    share_of = (F.col("__c") + F.col("__offset")).cast("double") / F.col("__most")
    placed = placed.withColumn("__asked", share_of)
    t = position(F.col("__asked"), F.col("__weights"), F.col("__cumulative"), knots)
    if budget is None:
        times = F.expr(f"array({', '.join(f'{x!r}D' for x in left_open(plan, knots))})")
        rest = F.greatest(F.col("__have") - F.col("__share"), F.lit(1e-300))
        at = F.least(F.greatest((F.col("__asked") - F.col("__share")) / rest, F.lit(0.0)), F.lit(1.0)) * STEPS
        step = F.least(F.floor(at), F.lit(STEPS - 1)).cast("int")
        low, high = F.element_at(times, step + 1), F.element_at(times, step + 2)
        t = F.when(F.col("__share") > 0, F.coalesce(t, low + (high - low) * (at - step)))
    placed = placed.withColumn("position", t).where("position is not null")
    return placed.select(*[F.col(o).alias(c) for c, o in own.items()], "n_tokens", "position")


def mix(docs: DataFrame, schedule: dict[str, list[float]] | None = None, budget: float | str | None = None, seed: int = 0) -> DataFrame:
    """What ``place`` returns, sorted by position."""
    return place(docs, schedule, budget, seed).repartitionByRange(*ORDER).sortWithinPartitions(*ORDER)


def in_training_order(docs: DataFrame, **how) -> DataFrame:
    """Columns of ``docs`` for the documents that ``mix`` takes, in its order; its defined cases hold here.

    Columns ``n_tokens`` and ``position`` of ``docs``, if there, are those of ``mix``.
    """
    return mix(docs, **how).select(*[f"`{c}`" for c in docs.columns])
